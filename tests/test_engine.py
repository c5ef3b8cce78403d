"""Operators on small fixtures with values worked out by hand or by brute force."""

import math
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import dense as im
import dense_segmentation as segmentation
import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions import scalars as fn
from platewise.model import RECALL_POINTS
from platewise.operators import evaluation, labels, metrics, raster
from platewise.plans import segmentation as plan
from platewise.sources import boxes, line_files, sinks

BEFORE = "ID: 6; [370, 436, 313, 331]\nID: 1; [737, 145, 384, 400]\nID: 10; [259, 532, 347, 357]\nID: 13; [235, 79, 243, 178]\n"
AFTER = "ID: 1; [681, 213, 459, 288]\nID: 6; [356, 421, 306, 362]\nID: 10; [225, 437, 368, 420]\nID: 13; [204, 48, 226, 199]\n"
IOU = {6: 96652 / 117723, 1: 110592 / 175200, 10: 108550 / 169889, 13: 32760 / 55468}


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("boxes")
    (folder / "a.txt").write_text(BEFORE)
    (folder / "b.txt").write_text(AFTER)
    rows = boxes.read_boxes(spark, str(folder))
    one = F.lit(1).alias("image_id")
    cols = ["pos", "class_id", "x", "y", "w", "h"]
    return rows.where("image_id like '%a.txt'").select(one, *cols), rows.where("image_id like '%b.txt'").select(one, *cols)


def test_box_scan_and_iou(scene):
    found = {r.class_id: r.iou for r in metrics.first_match(*scene).collect()}
    assert found == pytest.approx(IOU)


def test_identity_run_is_perfect(scene):
    gt, _ = scene
    matched = metrics.first_match(gt, gt)
    assert metrics.mean_iou(matched).first().miou == 1.0
    ap = metrics.average_precision(metrics.predictions(gt, gt).withColumn("s", F.lit(0)), metrics.class_counts(gt.withColumn("s", F.lit(0)), "s"), "s")
    assert [r.ap for r in ap.collect()] == pytest.approx([1.0] * 4)
    assert metrics.mean_average_precision(ap, "s").first().map == pytest.approx(1.0)


def test_strict_and_lenient_scan(spark):
    lines = spark.createDataFrame([("ID 2; [681, 452, 435, 417]",), ("ID: 3; [1, 2, 3, 4]",), ("ID: 4; [1, 2, 3]",), ("",), ("ID: 99999999999; [1,2,3,4]",), (None,)], "value string")
    assert [r.class_id for r in boxes.parse_boxes(lines).collect()] == [3]
    assert sorted(r.class_id for r in boxes.parse_boxes(lines, lenient=True).collect()) == [2, 3]


def test_ap_closed_form_and_general(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(40):
        n, flags = rng.randint(1, 12), [rng.random() < 0.6 for _ in range(rng.randint(1, 15))]
        conf = sorted((rng.random() for _ in flags), reverse=True)
        tp, points = 0, [-1.0] * 11
        for i, f in enumerate(flags):
            tp += f
            recall = tp / n
            at = min(range(11), key=lambda j: (abs(recall - RECALL_POINTS[j]), -j))
            points[at] = max(points[at], tp / (i + 1))
        top, total = 0.0, 0.0
        for j in range(10, -1, -1):
            top = max(top, points[j])
            total += top
        want[k] = total / 11
        rows += [(k, c, f, i) for i, (c, f) in enumerate(zip(conf, flags))]
        rng.shuffle(rows)
        want.setdefault(("n", k), n)
    preds = spark.createDataFrame(rows, "class_id int, confidence double, is_tp boolean, pos int")
    counts = spark.createDataFrame([(k[1], n) for k, n in want.items() if isinstance(k, tuple)], "class_id int, n_gt long")
    for r in metrics.average_precision(preds, counts).collect():
        assert r.ap == pytest.approx(want[r.class_id], abs=1e-12)


def test_iou_edges(spark):
    one = spark.range(1)
    box = lambda *v: dict(zip("xywh", map(F.lit, v)))
    row = one.select(fn.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("nan"), fn.iou(box(0, 0, 2, 2), box(5, 5, 1, 1)).alias("none"), fn.iou(box(0, 0, 46341, 46341), box(0, 0, 46341, 46341)).alias("big")).first()
    assert math.isnan(row.nan) and row.none == 0 and row.big == 1


def test_leftovers(spark):
    make = lambda rows: spark.createDataFrame(rows, "pair_id long, pos long, class_id int, pixels long")
    found = metrics.leftover_ratios(make([(1, 1, 6, 50), (1, 2, 6, 100)]), make([(1, 1, 6, 25), (1, 2, 7, 5)]), make([(1, 1, 6, 80), (1, 2, 6, 1), (1, 3, 7, 10)]), make([(1, 1, 6, 40), (1, 2, 7, 5)])).collect()
    got = {r.class_id: (r.gt_ratio, r.our_ratio, r.difference) for r in found}
    assert got == {6: (0.25, 0.5, 0.25), 7: (0.0, 0.5, 0.5)}


def test_leftovers_of_unknown_sizes(spark):
    make = lambda rows: spark.createDataFrame(rows, "pair_id long, pos long, class_id int, pixels long")
    found = metrics.leftover_ratios(make([(1, 1, 6, 50), (1, 2, 6, None), (1, 3, 7, None)]), make([(1, 1, 6, 25), (1, 2, 7, 5)]), make([(1, 1, 6, None), (1, 2, 6, 80), (1, 3, 7, None)]), make([(1, 1, 6, 40), (1, 2, 7, 5)])).collect()
    assert {r.class_id: (r.gt_ratio, r.our_ratio, r.difference) for r in found} == {6: (0.5, 0.5, 0.0), 7: (0.0, None, None)}


def test_arrays_and_paths(spark):
    row = spark.range(1).select(
        fn.bag_union(F.array(F.lit(1), F.lit(1)), F.array(F.lit(1))).alias("u"),
        fn.ordered_semi(F.array(*map(F.lit, (3, 1, 3, 2))), F.array(F.lit(3), F.lit(2))).alias("s"),
        fn.index_of(F.array(F.lit(5), F.lit(7)), F.lit(7)).alias("i"),
        fn.index_of(F.array(F.lit(5)), F.lit(1)).alias("j"),
        fn.tray_number(F.lit("a/tray12/leftover3.jpg")).alias("t"),
        fn.leftover_number(F.lit("a_leftover/tray12/leftover3.jpg")).alias("l"),
        fn.mask_name(F.lit("a/food_image.jpg")).alias("m"),
    ).first()
    assert (row.u, row.s, row.i, row.j, row.t, row.l, row.m) == ([1, 1, 1], [3, 3, 2], 1, -1, 12, 3, "food_image_mask")


def test_mode_filter_matches_scan(spark):
    rng = np.random.default_rng(2)
    grid = rng.integers(-1, 4, (9, 11))
    rows = spark.createDataFrame([(0, r, c, int(grid[r, c])) for r in range(9) for c in range(11)], "image_id int, row int, col int, label int")
    got = {(r.row, r.col): r.label for r in labels.mode_filter(rows).collect()}
    for r in range(9):
        for c in range(11):
            counts, top, most = Counter(), -1, 0
            for i in range(max(r - 1, 0), min(r + 2, 9)):
                for j in range(max(c - 1, 0), min(c + 2, 11)):
                    if (i, j) != (r, c) and grid[i, j] != -1:
                        counts[grid[i, j]] += 1
                        if counts[grid[i, j]] > most:
                            top, most = int(grid[i, j]), counts[grid[i, j]]
            assert got[r, c] == top


def test_merges_and_colours(spark):
    layers = spark.createDataFrame([(1, 0, 0, 1, 1), (1, 0, 0, 12, 2), (1, 0, 1, 200, 1), (1, 0, 1, 200, 2)], "image_id int, r int, c int, label int, seq int")
    assert {(r.c, r.label) for r in raster.merge_saturating(layers).collect()} == {(0, 13), (1, 255)}
    assert {(r.c, r.label) for r in raster.merge_overwriting(layers).collect()} == {(0, 12), (1, 200)}


def test_empty_inputs(spark):
    gt = spark.createDataFrame([], "image_id long, pos long, class_id int, x int, y int, w int, h int")
    assert metrics.first_match(gt, gt).count() == 0
    assert metrics.predictions(gt, gt).count() == 0
    pixels = spark.createDataFrame([], "image_id long, r int, c int, label int")
    assert raster.bounding_boxes(pixels).count() == 0
    assert raster.pixels_in_boxes(pixels, gt).count() == 0
    assert labels.mode_filter(spark.createDataFrame([], "image_id long, row int, col int, label int")).count() == 0


def test_prototype_scan_and_round_trips(spark, tmp_path):
    (tmp_path / "p.txt").write_text("2\n3\n0 1 2 \n4 5 6\n")
    assert [(r.label, r.vector) for r in boxes.read_prototypes(spark, str(tmp_path / "p.txt")).orderBy("label").collect()] == [(0, [0, 1, 2]), (1, [4, 5, 6])]
    mask = np.zeros((5, 7), np.uint8)
    mask[1:3, 2:6] = 9
    assert (boxes.decode(sinks.encode_png(mask)) == mask).all()
    assert (boxes.decode(b"P5\n# c\n7 5\n255\n" + mask.tobytes()) == mask).all()
    assert boxes.decode(b"JFIF") is None
    (tmp_path / "m.png").write_bytes(sinks.encode_png(mask))
    pixels = boxes.mask_pixels(boxes.read_images(spark, str(tmp_path / "m.png")))
    box = raster.bounding_boxes(pixels).first()
    assert (box.class_id, box.x, box.y, box.w, box.h) == (9, 2, 1, 4, 2)
    sinks.write_boxes(raster.bounding_boxes(pixels).withColumn("image_id", F.lit("m")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "ID: 9; [2, 1, 4, 2]"


def test_masks_of_all_kinds_are_read(spark, tmp_path):
    mask = np.arange(35, dtype=np.uint8).reshape(5, 7)
    (tmp_path / "a.png").write_bytes(sinks.encode_png(mask))
    (tmp_path / "b.pgm").write_bytes(b"P5\n7 5\n255\n" + mask.tobytes())
    (tmp_path / "c.ppm").write_bytes(b"P6\n7 5\n255\n" + np.repeat(mask[..., None], 3, axis=2).tobytes())
    (tmp_path / "d.txt").write_bytes(b"no mask")
    (tmp_path / "e.png").write_bytes(b"no mask")
    found = {r.image_id.rsplit("/", 1)[1]: (r.h, r.w, r.channels, bytes(r.data)) for r in boxes.read_images(spark, str(tmp_path)).collect()}
    assert found == {"a.png": (5, 7, 1, mask.tobytes()), "b.pgm": (5, 7, 1, mask.tobytes()), "c.ppm": (5, 7, 3, np.repeat(mask.ravel(), 3).tobytes())}


def test_box_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(BEFORE)
    stream = boxes.stream_boxes(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("boxes").option("checkpointLocation", str(tmp_path / "c")).start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("boxes").count() == 4


def test_components_morphology_and_fill():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((17, 23)) < 0.4
        a, n = im.components(mask)
        b, m = im.components_by_bfs(mask)
        assert n == m and len(set(zip(a[mask].tolist(), b[mask].tolist()))) == n
    square = np.zeros((9, 9), bool)
    square[3:6, 3:6] = True
    assert im.dilate(square, im.rectangle(3)).sum() == 25 and im.erode(square, im.rectangle(3)).sum() == 1
    ring = square.copy()
    ring[4, 4] = False
    assert (im.fill_holes(ring) == square).all()
    assert im.box_mean(np.full((9, 9), 4), 3)[4, 4] == pytest.approx(4)


def test_circles_and_segmentation_run():
    yy, xx = np.ogrid[:120, :160]
    image = np.full((120, 160, 3), 30, np.uint8)
    image[(yy - 60) ** 2 + (xx - 80) ** 2 <= 40**2] = (200, 200, 200)
    x, y, radius, _ = im.hough_circles(im.to_grey(image), 36, 44, 60)[0]
    assert abs(x - 80) <= 3 and abs(y - 60) <= 3 and abs(radius - 40) <= 3
    mask, seen = segmentation.segment(image, np.zeros((14, 60)))
    assert mask.shape == (120, 160) and not seen
    part = np.zeros((120, 160), bool)
    part[40:80, 60:100] = True
    prototypes = np.zeros((14, 60))
    assert set(segmentation.mixed_plate(image, part, prototypes, {6, 7, 10})) <= {6, 7, 10}


def planted(shape, *discs, ground=30):
    """A photo with discs ``(x, y, radius, colour)``, later ones on top."""
    yy, xx = np.ogrid[: shape[0], : shape[1]]
    photo = np.full((*shape, 3), ground, np.uint8)
    for x, y, radius, colour in discs:
        photo[(yy - y) ** 2 + (xx - x) ** 2 <= radius**2] = colour
    return photo


def test_every_circle_is_found():
    photo = planted((200, 420), (100, 100, 50, 250), (320, 100, 40, (70, 70, 70)))
    photo[::2, 100:102] = 255
    found = im.hough_circles(im.to_grey(photo), 36, 54, 100)
    assert any(abs(x - 100) <= 3 and abs(y - 100) <= 3 and abs(r - 50) <= 3 for x, y, r, _ in found)
    assert any(abs(x - 320) <= 3 and abs(y - 100) <= 3 and abs(r - 40) <= 3 for x, y, r, _ in found)


def test_outlines_of_filled_regions():
    part = np.zeros((9, 9), bool)
    part[2:7, 2:7] = True
    assert im.outline_area(part) == 16 and im.outline_distance(part, 4, 4) == 2 and im.outline_distance(part, 4, 0) == 2
    yy, xx = np.ogrid[:101, :101]
    disc = (yy - 50) ** 2 + (xx - 50) ** 2 <= 40**2
    assert im.outline_area(disc) == pytest.approx(np.pi * 40**2, rel=0.03)
    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((15, 19)) < 0.5
        ids, n = im.components(mask)
        whole = [im.fill_holes(ids == k) for k in range(1, n + 1)]
        areas = [im.outline_area(w) for w in whole]
        best = whole[int(np.argmax(areas))] if max(areas, default=0) > 0 else np.zeros_like(mask)
        assert (im.largest_filled(mask) == best).all()


def test_refinements_and_masks():
    green = planted((60, 80), (40, 30, 20, (20, 200, 30)))
    whole = np.ones((60, 80), bool)
    disc = im.disc((60, 80), (40, 30, 20))
    pesto = im.refine(1, green, whole)
    assert (pesto & disc).sum() >= 0.95 * disc.sum() and pesto.sum() <= 1.5 * disc.sum()
    assert (im.refine(5, green, whole) == disc).all() and (im.refine(3, green, disc) == disc).all()
    split = disc.copy()
    split[:, 39:41] = False
    assert im.refine(6, green, split)[30, 39] and im.refine(6, green, np.zeros_like(disc)).sum() == 0
    red = planted((60, 80), (40, 30, 20, (10, 10, 220)))
    assert (im.refine_tomato(red, whole) == disc).all()
    bowl = planted((60, 80), (40, 30, 25, 120), (40, 30, 12, (0, 220, 30)))
    salad = im.salad_mask(bowl, (40, 30, 25))
    assert (salad & im.disc((60, 80), (40, 30, 12))).sum() >= 0.9 * salad.sum() > 0
    loaf = planted((60, 80), (40, 30, 15, (60, 130, 190)), ground=220)
    area = im.disc((60, 80), (40, 30, 22))
    bread = im.bread_mask(loaf, area)
    assert bread.any() and (bread & im.disc((60, 80), (40, 30, 15))).sum() >= 0.8 * bread.sum()
    assert not im.find_bread(planted((120, 160)), [], []).any()


def test_bowl_is_found():
    photo = planted((200, 260), (120, 100, 60, 230))
    x, y, radius = im.find_bowl(photo, [], True, ((58, 62), (61, 66)))[0]
    assert abs(x - 120) <= 3 and abs(y - 100) <= 3 and abs(radius - 60) <= 3
    assert im.find_bowl(planted((200, 260)), [], False, ((58, 62), (61, 66))) == []


def test_small_pieces_move_to_the_other_label():
    a, b = np.zeros((60, 90), bool), np.zeros((60, 90), bool)
    a[0:40, 0:30], a[50:55, 80:85] = True, True
    b[0:40, 40:75] = True
    out = segmentation.reassign({6: a, 10: b}, [6, 10])
    assert out[6].sum() == 1200 and out[10].sum() == 1400 + 25 and out[10][52, 82]


def test_photos_and_pairs(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    (tmp_path / "tray1").mkdir()
    for name, colour in (("food_image", 0x2040F0), ("leftover1", 0x108030)):
        picture = jvm.java.awt.image.BufferedImage(160, 120, 1)
        for x in range(0, 160, 4):
            for y in range(0, 120, 4):
                picture.setRGB(x, y, colour)
        jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "tray1" / f"{name}.jpg")))
    (tmp_path / "tray1" / "broken.jpg").write_bytes(b"no photo")
    photos = boxes.read_photos(spark, str(tmp_path / "tray1"))
    assert sorted((r.h, r.w, r.channels, len(r.data)) for r in photos.collect()) == [(120, 160, 3, 57600)] * 2
    pairs = spark.createDataFrame([(1, "tray1/food_image.jpg", "tray1/leftover1.jpg"), (2, "tray1/food_image.jpg", "tray2/leftover1.jpg")], "pair_id long, before_path string, after_path string")
    met = boxes.photo_pairs(pairs, photos)
    assert [(r.pair_id, r.before_id[-20:], r.after_id[-19:]) for r in met.collect()] == [(1, "tray1/food_image.jpg", "tray1/leftover1.jpg")]
    before, after = boxes.pair_pixels(met, photos)
    assert (before.count(), after.count()) == (19200, 19200)
    data = {r.image_id[-14:]: np.frombuffer(r.data, np.uint8).reshape(120, 160, 3) for r in photos.collect()}["food_image.jpg"]
    assert all((r.b, r.g, r.red) == tuple(data[r.r, r.c].tolist()) for r in before.where("r % 7 = 0 and c % 5 = 0").collect())


def test_masks_written_and_encoded(spark, tmp_path):
    mask = spark.createDataFrame([(1, 0, 2, 9), (1, 3, 1, 4), (2, 1, 1, 200)], "image_id long, r int, c int, label int")
    sinks.write_masks(mask, str(tmp_path / "m"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).select("image_id", "r", "c", "label").collect()} == {tuple(r) for r in mask.collect()}
    for row in sinks.mask_pngs(mask, 5, 6).collect():
        raster_ = boxes.decode(bytes(row.png))
        assert {(int(row.image_id), int(r), int(c), int(raster_[r, c])) for r, c in zip(*np.nonzero(raster_))} == {tuple(x) for x in mask.collect() if x.image_id == int(row.image_id)}


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    import struct
    import zlib

    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (6, 7, 3)).astype(np.int64)
    lines, above = b"", np.zeros((7, 3), np.int64)
    for line in image:
        left, corner = np.vstack([np.zeros((1, 3), np.int64), line[:-1]]), np.vstack([np.zeros((1, 3), np.int64), above[:-1]])
        p, q, r = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
        guess = {0: 0 * line, 1: left, 2: above, 3: (left + above) // 2, 4: np.where((p <= q) & (p <= r), left, np.where(q <= r, above, corner))}[kind]
        lines += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (boxes.decode(png) == image[..., ::-1]).all()


def test_leftover_codes(spark):
    rows = spark.createDataFrame([(k,) for k in range(4)], "code int")
    assert [r.code for r in metrics.detected(rows).orderBy("code").collect()] == [0, 1, 2]
    assert [r.code for r in metrics.left_over(rows).orderBy("code").collect()] == [1, 2, 3]


def test_many_prototypes_are_dealt_to_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    make = lambda n, name: spark.createDataFrame([(k, rng.random(3).tolist()) for k in range(n)], f"{name} long, vector array<double>")
    vectors, prototypes = make(50, "key"), make(20, "label")
    few = {(r.key, r.label) for r in labels.nearest_prototype(vectors, prototypes).collect()}
    monkeypatch.setattr(labels, "ARRAY_ROWS", 3)
    many = {(r.key, r.label) for r in labels.nearest_prototype(vectors, prototypes).collect()}
    assert few == many and len(many) == 50 and labels.distances(vectors, prototypes).count() == 1000


def test_two_plates_agree(spark):
    dist = {0: {1: 1.0, 2: 5.0, 6: 4.0, 7: 9.0}, 1: {1: 2.0, 2: 8.0, 6: 2.5, 7: 8.0}}
    rows = spark.createDataFrame([(1, p, k, d) for p, v in dist.items() for k, d in v.items()], "tray int, plate int, label int, distance double")
    families = spark.createDataFrame([(1, "first"), (2, "first"), (6, "second"), (7, "second")], "label int, family string")
    assert {r.plate: r.label for r in labels.assign_two_plates(rows, families).collect()} == {0: 1, 1: 6}
    lists = [sorted((d, k) for k, d in dist[p].items()) for p in (0, 1)]
    assert segmentation.two_plates(lists)[0] == set(segmentation.FIRST)


# reports, evaluation by batches, files of lines


def test_significant_digits(spark):
    values = {0.8210120367: "0.821012", 1.0: "1", 3.328125: "3.32812", 0.00012345678: "0.000123457", 10.0: "10", 123456.5: "123456", 1234567.0: "1234570", 0.0: "0", 9.9999996: "10", float("nan"): "nan", float("inf"): "inf", float("-inf"): "-inf", -0.25: "-0.25"}
    got = spark.createDataFrame([(v,) for v in values], "x double").select(sinks.digits(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == list(values.values())


def test_digits_round_the_exact_value(spark):
    pick = random.Random(3)
    ties = [(2 * pick.randrange(50_000, 5_000_000) + 1) * 5 / 10 ** pick.randrange(5, 15) for _ in range(1500)]
    values = [0.5890625, 0.7171875, 1.010625, 4.681875, 0.5, 2.5, 1.5e-12, 2.5e-12, 1.2345e-9, 2.77556e-17, *ties, *(-v for v in ties[:200]), *(pick.randrange(1, 99_999) / pick.randrange(1, 99_999) for _ in range(500))]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(sinks.digits(F.col("x")).alias("s")).collect()
    short = [Decimal(f"{v:.5e}").quantize(Decimal("1e-12"), ROUND_HALF_UP) for v in values]
    assert [Decimal(r.s) for r in got] == short


def test_leftover_lines_round_the_exact_value(spark):
    ratios = spark.createDataFrame([(1, 9, 1, 2, 0.5890625, 4.681875, 4.0928125)], "pair_id int, class_id int, pos int, pred_pos int, gt_ratio double, our_ratio double, difference double")
    lines = [r.line for r in sinks.leftover_lines(ratios).sort("n").collect()]
    assert [x.split(" = ")[1] for x in lines] == [f"{4.681875:.6g}", f"{0.5890625:.6g}", f"{4.0928125:.6g}"] and lines[0].endswith("4.68187")


def test_lines_have_the_digits_of_the_casts(spark):
    pick = random.Random(4)
    ties = [(2 * pick.randrange(500, 50_000) + 1) * 5 * 10.0 ** -pick.randrange(13, 18) for _ in range(500)]
    values = [9.645e-10, 4.999994355735127e-13, 6.39445e-08, 4254.14, 8867.14, 66653.9, 0.0, 0.5, 2.5e-12, *ties, *(pick.uniform(-1, 1) * 10.0 ** pick.randrange(-14, 15) for _ in range(500))]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").select("k", sinks.digits(F.col("x"), through_double=True).alias("s")).sort("k").collect()
    assert [r.s for r in got[:9]] == ["0.000000000964", "0", "0.000000063944", "4254.140000000001", "8867.139999999999", "66653.899999999992", "0", "0.5", "0.000000000003"]
    places = [Decimal(float(f"{v:.5e}") * 1e12).quantize(Decimal(1), ROUND_HALF_UP) for v in values]
    assert [Decimal(r.s) for r in got] == [p.scaleb(-12) for p in places]
    ratios = spark.createDataFrame([(1, 6, 0, 2, 8867.14, 0.5, 9.645e-10)], "pair_id long, class_id int, pos int, pred_pos int, gt_ratio double, our_ratio double, difference double")
    assert [r.line for r in sinks.leftover_lines(ratios).orderBy("n").collect()] == ["Food item 6 : our R_i = 0.5", "Food item 6 : gT R_i = 8867.139999999999", "Food item 6 : abs diff = 0.000000000964"]


def test_lines_of_items(spark, scene):
    lines = {r.pos: r.line for r in sinks.iou_lines(metrics.first_match(*scene)).collect()}
    assert lines == {0: "Food 6, IoU = 0.821012", 1: "Food 1, IoU = 0.631233", 2: "Food 10, IoU = 0.638947", 3: "Food 13, IoU = 0.590611"}
    ratios = spark.createDataFrame([(1, 6, 0, 2, 0.5, float("inf"), float("inf"))], "pair_id long, class_id int, pos int, pred_pos int, gt_ratio double, our_ratio double, difference double")
    assert [r.line for r in sinks.leftover_lines(ratios).orderBy("n").collect()] == ["Food item 6 : our R_i = inf", "Food item 6 : gT R_i = 0.5", "Food item 6 : abs diff = inf"]


BOXES = "image_id long, pos int, class_id int, x int, y int, w int, h int"


def random_boxes(seed, images, per=7):
    rng = random.Random(seed)
    gt = [(i, p, rng.randint(1, 4), rng.randint(0, 40), rng.randint(0, 40), 30, 30) for i in images for p in range(rng.randint(0, per))]
    pred = [(i, p, k if rng.random() < 0.9 else 5, x + rng.randint(-15, 15), y, w, h) for i, p, k, x, y, w, h in gt if rng.random() < 0.8] + [(i, 90, 7, 1, 1, 5, 5) for i in images if rng.random() < 0.2]
    return gt, pred


def rounded(found):
    return sorted((r.scope, r.scope_id, round(r.miou, 9), r.n_gt, r.n_matched, None if r.map is None else round(r.map, 9), r.n_classes) for r in found.collect())


SCOPES = {"image": "image_id", "tray": "image_id % 3", "all": "0"}


@pytest.mark.parametrize("batches", [[range(12)], [range(0, 12, 2), range(1, 12, 2)], [range(5), range(3, 9), range(2, 12)]])
def test_any_split_into_batches_gives_the_whole(spark, batches):
    gt, pred = random_boxes(1, range(12))
    table = lambda rows, keep=range(99): spark.createDataFrame([r for r in rows if r[0] in keep], BOXES)
    state = evaluation.contributions(table([]), table([]))
    for k, images in enumerate(batches):
        state = evaluation.merged(state, evaluation.contributions(table(gt, images), table(pred, images), k)).cache()
    assert rounded(evaluation.scores(state, SCOPES)) == rounded(metrics.evaluate(table(gt), table(pred), SCOPES))
    assert evaluation.merged(state, evaluation.contributions(table([]), table([]), 9)).count() == state.count()


def test_a_stream_keeps_the_state(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()

    def arrive(name, gt, pred):
        rows = [(*r, "gt") for r in gt] + [(*r, "pred") for r in pred]
        spark.createDataFrame(rows, BOXES + ", kind string").coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(BOXES + ", kind string").option("recursiveFileLookup", True).parquet(str(source))
        evaluation.evaluate_stream(stream, state, str(tmp_path / "c")).awaitTermination(120)

    gt, pred = random_boxes(2, range(8))
    arrive("a", *([r for r in rows if r[0] < 5] for rows in (gt, [(*r[:3], r[3] + 900, *r[4:]) for r in pred])))
    run()
    assert evaluation.kept_state(spark, state).agg(F.sum("n_tp")).first()[0] == 0
    arrive("b", gt, pred)  # images 0 to 4 come again
    run()
    want = metrics.evaluate(spark.createDataFrame(gt, BOXES), spark.createDataFrame(pred, BOXES), SCOPES)
    assert rounded(evaluation.scores(evaluation.kept_state(spark, state), SCOPES)) == rounded(want)


def test_unmatched_predictions_are_not_ranked(spark):
    rows = [(1, 0.9, True, 1), (1, 0.4, False, 2), (1, 0.3, True, 3)] + [(1, 0.0, False, 10 + k) for k in range(50)] + [(2, 0.0, False, k) for k in range(9)]
    found = metrics.average_precision(spark.createDataFrame(rows, "class_id int, confidence double, is_tp boolean, pos int"), spark.createDataFrame([(1, 4), (2, 3)], "class_id int, n_gt long"))
    # recalls 0.25 and 0.5 snap to points 3 and 5: precision 1 up to the former, two thirds up to the latter
    assert {r.class_id: round(r.ap, 9) for r in found.collect()} == {1: round((4 * 1 + 2 * 2 / 3) / 11, 9), 2: 0.0}


def test_files_of_lines(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("a b", 1, "second"), ("a b", 0, "erste ü"), ("c", 0, ""), ("d", 0, None), ("e", 0, "x" * 100_000)]
    line_files.write_lines(spark.createDataFrame(rows, "image_id string, pos int, value string").repartition(3), folder, ".txt")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a b.txt", "c.txt", "d.txt", "e.txt"]
    got = {(r.image_id, r.pos, r.value) for r in line_files.read_lines(spark, folder, ".txt").collect()}
    assert got == {("a b", 0, "erste ü"), ("a b", 1, "second"), ("c", 0, ""), ("e", 0, "x" * 100_000)}
    line_files.write_lines(spark.createDataFrame([("c", 0, "new")], "image_id string, pos int, value string"), folder, ".txt")
    assert line_files.read_lines(spark, folder, ".txt").where("image_id = 'c'").first().value == "new"
    assert line_files.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_write_of_lines_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("a", 0, "x"), ("b/c", 0, "y")], "image_id string, pos int, value string")
    with pytest.raises(Exception, match="no place"):
        line_files.write_lines(bad, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_stream_of_files_of_lines(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text(BEFORE)

    def run():
        stream = boxes.parse_boxes(line_files.stream_lines(spark, str(source), ".txt")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().count() == 4
    (source / "b.txt").write_text(AFTER + "ID: x; []\n")
    found = run()
    assert found.count() == 8 and {r.image_id for r in found.select("image_id").distinct().collect()} == {"a", "b"}


def test_lines_are_marked(spark):
    rows = ["ID: 6; [1, 2, 3, 4]", "ID 2; [1, 2, 3, 4]", "ID: x; [1, 2]", "", "ID: 99999999999; [1, 2, 3, 4]"]
    got = [(r.strict, r.lenient) for r in boxes.marked_boxes(spark.createDataFrame([(v,) for v in rows], "value string")).collect()]
    assert got == [(True, True), (False, True), (False, False), (False, False), (False, False)]


def test_pixels_in_boxes_are_counted_without_pairs(spark):
    rng = np.random.default_rng(11)
    pixels = [(int(rng.integers(2)), int(r), int(c), int(rng.integers(1, 3))) for r, c in zip(rng.integers(-20, 40, 700), rng.integers(-30, 700, 700))] + [(None, 1, 1, 1), (0, None, 1, 1), (0, 1, 1, None)]
    boxes = [(int(rng.integers(2)), k, int(rng.integers(1, 3)), int(rng.integers(-40, 300)), int(rng.integers(-25, 30)), int(rng.integers(-3, 700)), int(rng.integers(-3, 50))) for k in range(60)] + [(0, 60, None, 0, 0, 9, 9), (None, 61, 1, 0, 0, 9, 9)]
    found = raster.pixels_in_boxes(spark.createDataFrame(pixels, "image_id long, r int, c int, label int"), spark.createDataFrame(boxes, "image_id long, pos long, class_id int, x int, y int, w int, h int"))
    want = {pos: sum(None not in p and (i, k) == (p[0], p[3]) and y <= p[1] < y + h and x <= p[2] < x + w for p in pixels) for i, pos, k, x, y, w, h in boxes}
    assert {r.pos: r.pixels for r in found.collect()} == want and max(want.values()) > 50
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_equal_pixels_and_discs_meet_once(spark):
    pixels = [(1, 3, 4, 6)] * 9000 + [(1, 3, 5, 6), (1, 90, 90, 6), (2, 3, 4, 6), (None, 3, 4, 6)]
    circles = [(1, 7, 4.5, 3.25, 2.0), (1, 8, 4.9, 3.9, 2.9), (1, 9, 70.0, 70.0, 30.0), (1, 10, 40.0, 3.0, 5.0)]
    found = raster.pixels_in_disc(spark.createDataFrame(pixels, "image_id long, r int, c int, label int"), spark.createDataFrame(circles, "image_id int, id long, x double, y double, radius double"))
    assert {(r.r, r.c, r.circle_id): r["count"] for r in found.groupBy("r", "c", "circle_id").count().collect()} == {(3, 4, 7): 9000, (3, 4, 8): 9000, (3, 5, 7): 1, (3, 5, 8): 1, (90, 90, 9): 1}
    assert "Aggregate [image_id#" in found._jdf.queryExecution().optimizedPlan().toString()  # before pixels and discs meet


def test_leftovers_of_counted_boxes_are_not_broadcast(spark):
    pixels = spark.range(400).selectExpr("id % 2 image_id", "int(id div 20) r", "int(id % 20) c", "1 label")
    box = lambda n, x: spark.range(n).selectExpr("0L image_id", "id pos", "1 class_id", f"int(id + {x}) x", "0 y", "4 w", "20 h")
    items = [raster.pixels_in_boxes(pixels, box(n, x)).select(F.lit(1).alias("pair_id"), "pos", "class_id", "pixels") for n, x in ((2, 0), (3, 17), (2, 0), (2, 16))]
    found = metrics.leftover_ratios(*items)
    assert {(r.pos, r.pred_pos, r.gt_ratio, r.our_ratio) for r in found.collect()} == {(g, p, (0.5, 0.5, 0.0)[g], (1.0, 0.5)[p]) for g in range(3) for p in range(2)}
    assert "hint" in found._jdf.queryExecution().analyzed().toString().lower() or "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()  # true and predicted items
