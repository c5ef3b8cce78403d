"""Regions, filters, circles and foods as plans against plain code on arrays and against values worked out by hand."""

import functools
import os

import dense as im
import dense_segmentation as ds
import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import circles, filters, foods, labels, regions
from platewise.plans import segmentation

PHOTO = "image_id long, r long, c long, b int, g int, red int"


def mask_rows(masks):
    return [(i, int(r), int(c)) for i, m in masks.items() for r, c in zip(*np.nonzero(m))]


def photo_of(spark, photos):
    return spark.createDataFrame([(i, r, c, *map(int, m[r, c])) for i, m in photos.items() for r in range(m.shape[0]) for c in range(m.shape[1])], PHOTO).cache()


def pixel_sets(found, *keys):
    out = {}
    for x in found.collect():
        out.setdefault(tuple(x[k] for k in keys) if keys else x.image_id, set()).add((x.r, x.c))
    return out


def pixels(mask):
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(mask))}


def planted(shape, *discs, ground=30, seed=0):
    """A photo with discs ``(x, y, radius, colour)``, later ones on top, and a little noise."""
    yy, xx = np.ogrid[: shape[0], : shape[1]]
    photo = np.full((*shape, 3), ground, np.uint8)
    for x, y, radius, colour in discs:
        photo[(yy - y) ** 2 + (xx - x) ** 2 <= radius**2] = colour
    return np.clip(photo.astype(int) + np.random.default_rng(seed).integers(-3, 4, photo.shape), 0, 255).astype(np.uint8)


# regions


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(0)
    found = {i: rng.random((6, 150) if i == 0 else (17, 23)) < (0.35 + 0.05 * (i % 5)) for i in range(10)}
    spiral = np.zeros((21, 21), bool)  # one component that only many rounds join
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = spiral[20 - k, k : 21 - k] = True
        spiral[k + 2 : 21 - k, k] = True
        spiral[k + 2, k : k + 2] = True
    return found | {10: spiral, 11: np.ones((5, 7), bool)}


@pytest.fixture(scope="module")
def mask(spark, masks):
    return spark.createDataFrame(mask_rows(masks) + [(10, 0, 0), (10, None, 3), (10, 3, None)], "image_id long, r int, c int")


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_match_a_search(mask, masks, diagonal):
    got = {(x.image_id, x.r, x.c): x.component for x in regions.pixels_of(regions.components(mask, diagonal=diagonal)).collect()}
    for i, m in masks.items():
        ids, _ = im.components(m, diagonal=diagonal)
        first = {}
        for r, c in pixels(m):
            first[ids[r, c]] = min(first.get(ids[r, c], (99, 0)), (r, c))
        for r, c in pixels(m):
            assert got.pop((i, r, c)) == first[ids[r, c]][0] * 2**32 + first[ids[r, c]][1]
    assert not got


def test_holes_areas_and_outlines_match_arrays(spark, mask, masks):
    whole, found = regions.measured(mask)
    held, rows = pixel_sets(regions.pixels_of(whole), "image_id", "component"), {(x.image_id, x.component): x for x in found.collect()}
    centres = spark.createDataFrame([(i, 8, 11) for i in masks], "image_id long, cy int, cx int")
    far = {(x.image_id, x.component): x for x in regions.outline_distances(whole, centres).collect()}
    best = {x.image_id: x.component for x in regions.largest(found).collect()}
    for i, m in masks.items():
        ids, n = im.components(m)
        areas = {}
        for k in range(1, n + 1):
            part = im.fill_holes(ids == k)
            r, c = min(pixels(ids == k))
            key = (i, r * 2**32 + c)
            ys, xs = np.nonzero(part)
            assert held[key] == pixels(part)
            assert (rows[key].area, rows[key].pixels, rows[key].x, rows[key].y, rows[key].w, rows[key].h) == (im.outline_area(part), part.sum(), xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1)
            assert far[key].distance == pytest.approx(im.outline_distance(part, 8, 11)) == np.hypot(far[key].r - 8, far[key].c - 11)
            areas[key[1]] = im.outline_area(part)
        top = max(areas.values())
        assert best.get(i) == (min(k for k, a in areas.items() if a == top) if top else None)


def test_small_pieces_move(spark, masks):
    rows = [(i, int(r), int(c), 6 if m[r, c] else 10) for i, m in masks.items() for r in range(m.shape[0]) for c in range(m.shape[1]) if m[r, c] or r % 5 > 1]
    got = {(x.image_id, x.r, x.c): x.label for x in regions.reassign(spark.createDataFrame(rows, "image_id long, r int, c int, label int"), 20).collect()}
    for i, m in masks.items():
        other = ~m & (np.arange(m.shape[0]) % 5 > 1)[:, None]
        want = ds.reassign({6: m, 10: other}, [6, 10], 20) if other.any() else {6: m}
        for k, part in want.items():
            for r, c in pixels(part):
                assert got.pop((i, r, c)) == k
    assert not got


def test_no_pixels_no_regions(spark):
    none = spark.createDataFrame([], "image_id long, r int, c int")
    whole, found = regions.measured(none)
    assert whole.count() == found.count() == regions.largest_filled(none).count() == 0


# filters


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(1)
    return {i: rng.integers(0, 256, (13 + i, 17 + 3 * i)) for i in range(2)}


@pytest.fixture(scope="module")
def raster(spark, grids):
    return spark.createDataFrame([(i, r, c, int(m[r, c])) for i, m in grids.items() for r in range(m.shape[0]) for c in range(m.shape[1])], "image_id long, r long, c long, v long").cache()


def arrays(found, grids, column="v"):
    out = {i: np.zeros(m.shape, object) for i, m in grids.items()}
    for x in found.collect():
        out[x.image_id][x.r, x.c] = x[column]
    return out


def test_blur_and_box_sums(raster, grids):
    blurred = arrays(filters.gaussian(raster, "v"), grids)
    for size, reflect in ((3, True), (11, True), (11, False)):
        got = arrays(filters.box_filter(raster, "v", size, 0.031, reflect=reflect), grids)
        for i, m in grids.items():
            assert (blurred[i] == im.gaussian5(m)).all()
            h = size // 2
            pad = np.pad(m.astype(float), h, mode="reflect" if reflect else "constant")
            sums = sum(pad[a : a + m.shape[0], b : b + m.shape[1]] for a in range(size) for b in range(size))
            assert np.allclose(got[i].astype(float), np.minimum(sums * 0.031, 255))


def test_box_filters_shuffle_each_place_once_a_pass(raster):
    plans = [filters.box_sums(raster, "v", size)._jdf.queryExecution().executedPlan().toString() for size in (3, 51)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") == 2 and "Generate" not in plans[1]


@pytest.mark.parametrize("kernel, plain, times", [(filters.rectangle(4, 5), im.rectangle(4, 5), 1), (filters.rectangle(3), im.rectangle(3), 3), (filters.ellipse(5), im.ellipse(5), 3), (filters.ellipse(4), im.ellipse(4), 2), (filters.ellipse(9), im.ellipse(9), 1)])
def test_kernels(raster, grids, kernel, plain, times):
    spread = arrays(filters.dilate(raster.withColumn("on", F.col("v") % 61 == 0), kernel, times), grids, "on")
    thin = arrays(filters.erode(raster.withColumn("on", F.col("v") % 61 != 0), kernel, times), grids, "on")
    for i, m in grids.items():
        assert (spread[i] == im.dilate(m % 61 == 0, plain, times)).all() and (thin[i] == im.erode(m % 61 != 0, plain, times)).all()


def test_crosses_are_thresholds_of_distances(raster, grids):
    for times in (1, 4):
        closed = arrays(filters.close_cross(raster.withColumn("on", F.col("v") % 61 == 0), times), grids, "on")
        opened = arrays(filters.open_cross(raster.withColumn("on", F.col("v") % 61 != 0), times), grids, "on")
        for i, m in grids.items():
            assert (closed[i] == im.close(m % 61 == 0, im.ellipse(3), times)).all() and (opened[i] == im.open_(m % 61 != 0, im.ellipse(3), times)).all()
    empty = filters.cross_distance(raster.withColumn("on", F.lit(False)))
    assert empty.where("distance is not null").count() == 0 and filters.dilate_cross(raster.withColumn("on", F.lit(False)), 3).where("on").count() == 0


def test_shifts_and_frames(spark, raster, grids):
    got = arrays(filters.shifted(raster.withColumn("on", F.col("v") % 5 == 0), 2, -1), grids, "on")
    for i, m in grids.items():
        want = np.zeros(m.shape, bool)
        want[:-2, 1:] = (m % 5 == 0)[2:, :-1]
        assert (got[i] == want).all()
    sparse = spark.createDataFrame([(1, 3, 4, 7), (1, 5, 2, 9)], "image_id long, r int, c int, v int")
    dense = {(x.r, x.c): x.v for x in filters.framed(sparse, filters.bounds(sparse, 1), v=0).collect()}
    assert len(dense) == 25 and dense[3, 4] == 7 and dense[5, 2] == 9 and sum(dense.values()) == 16


# circles and foods

BANDS = ((36, 42), (1, 2), (1, 1))


@pytest.fixture(scope="module")
def plate_photos():
    return {0: planted((120, 160), (70, 55, 38, (200, 200, 200)), (70, 55, 15, (30, 120, 210))), 1: planted((110, 150), (80, 50, 40, (200, 200, 200)), (70, 45, 9, (30, 120, 210)), (95, 60, 6, (20, 200, 30)), seed=1)}


@pytest.fixture(scope="module")
def plate_rows(spark, plate_photos):
    return photo_of(spark, plate_photos)


def test_edges_and_circles_match_arrays(plate_rows, plate_photos):
    edges, frames = foods.outlines(plate_rows)
    got, found = pixel_sets(edges), {x.image_id: x for x in foods.find_circles(edges, frames, 36, 42).collect()}
    for i, m in plate_photos.items():
        assert got[i] == pixels(im.canny(im.to_grey(m), 50, 100))
        x, y, radius, support = im.hough_circles(im.to_grey(m), 36, 42, m.shape[0] / 2)[0]
        assert (found[i].x, found[i].y, found[i].radius, found[i].support) == (x, y, radius, support)


def test_better_centres_drop_those_near(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(y), int(x), int(n)) for i in range(4) for y, x, n in set(map(tuple, rng.integers(0, (40, 40, 6), (60, 3)).tolist()))]
    got = {tuple(r) for r in circles.apart(spark.createDataFrame(rows, "image_id long, cy long, cx long, n long"), F.col("image_id") * 3 + 2).collect()}
    want = set()
    for i in range(4):
        kept = []
        for _, y, x, n in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[3], r[1], r[2])):
            if all(np.hypot(y - a, x - b) >= 3 * i + 2 for a, b in kept):
                kept.append((y, x))
                want.add((i, y, x, n))
    assert got == want


def test_plates_near_other_circles_go(spark):
    plates = spark.createDataFrame([(1, 100, 100, 60, 9, 9), (1, 300, 100, 60, 8, 9), (1, 500, 100, 60, 7, 9)], "image_id long, x long, y long, radius int, votes long, support long")
    others = spark.createDataFrame([(1, 330, 100, 20), (1, 505, 100, 10)], "image_id long, x long, y long, radius int")
    assert {x.x for x in foods.drop_plates_near(plates, others).collect()} == {100, 300}  # 330 is 30 away, over its own radius
    assert {x.x for x in foods._drop_holding(plates, others).collect()} == {100}  # but within the plate's


def test_food_masks_match_arrays(spark, plate_rows, plate_photos):
    circles_ = {0: (70, 55, 38.0), 1: (80, 50, 40.0)}
    frame = spark.createDataFrame([(i, *c) for i, c in circles_.items()], "image_id long, x long, y long, radius double")
    for plan, plain in ((foods.plate_mask, im.plate_mask), (foods.salad_mask, im.salad_mask)):
        got = pixel_sets(plan(plate_rows, frame))
        assert {i: got.get(i, set()) for i in circles_} == {i: pixels(plain(m, circles_[i])) for i, m in plate_photos.items()}


def test_refinements_and_hues_match_arrays(plate_rows, plate_photos):
    held = {i: im.disc(m.shape[:2], (75, 52, 30)) for i, m in plate_photos.items()}
    rows = plate_rows.withColumn("held", F.expr("(r - 52) * (r - 52) + (c - 75) * (c - 75) <= 900"))
    for label, refine in foods.REFINEMENTS.items():
        got = pixel_sets(refine(rows))
        assert {i: got.get(i, set()) for i in held} == {i: pixels(im.refine(label, m, held[i])) for i, m in plate_photos.items()}
    levels = {}
    for x in foods.hue_histogram(rows).where("level > 0").collect():
        levels.setdefault(x.image_id, {})[x.bin] = x.level
    for i, m in plate_photos.items():
        want = im.hue_histogram(m, held[i])
        assert levels[i] == {k: int(want[k]) for k in np.nonzero(want)[0]}


def test_bread_area_and_foreground(spark, monkeypatch):
    loaf = planted((130, 170), (60, 60, 40, (20, 120, 190)), ground=(90, 90, 160))
    rough = np.clip(loaf.astype(int) + np.random.default_rng(3).integers(-30, 31, loaf.shape), 0, 255).astype(np.uint8)
    rows = photo_of(spark, {0: rough})
    none = spark.createDataFrame([], "image_id long, id long, x double, y double, radius double")
    bowl = spark.createDataFrame([(0, 1, 140.0, 100.0, 20.0)], none.schema)
    plain = im.largest_filled
    monkeypatch.setattr(im, "largest_filled", lambda m, least=0: plain(m, 1000 if least else 0))
    want = pixels(im.find_bread(rough, [], [(140.0, 100.0, 20.0)]))
    assert pixel_sets(foods.bread_area(rows, none, bowl, 1000.0)).get(0, set()) == want
    bread = planted((60, 80), (40, 30, 15, (60, 130, 190)), ground=220)
    area = spark.createDataFrame(mask_rows({0: im.disc((60, 80), (40, 30, 22))}), "image_id long, r int, c int")
    got, disc = pixel_sets(foods.bread_mask(photo_of(spark, {0: bread}), area))[0], pixels(im.disc((60, 80), (40, 30, 15)))
    assert len(got & disc) >= 0.9 * len(got | disc)


def test_segmentation_matches_arrays(spark, monkeypatch):
    photos = {
        0: planted((130, 240), (60, 60, 38, (200, 200, 200)), (60, 60, 22, (20, 190, 90)), (170, 62, 40, (200, 200, 200)), (160, 55, 14, (30, 120, 210)), (185, 70, 13, (200, 60, 40))),
        1: planted((130, 240), (120, 60, 39, (200, 200, 200)), (112, 60, 15, (40, 90, 190)), (135, 62, 12, (90, 160, 20)), ground=35, seed=1),
    }
    prototypes = np.zeros((14, 60))
    for k in range(1, 12):
        prototypes[k, (k * 5) % 60], prototypes[k, (k * 11 + 3) % 60] = 60, 40
    table = spark.createDataFrame([(k, prototypes[k].tolist()) for k in range(14)], "label int, vector array<double>")
    sizes = segmentation.Sizes(plates=BANDS, bowls=((58, 60), (60, 62)), coarse=16, fine=6, piece=20.0)
    monkeypatch.setattr(im, "find_plates", functools.partial(im.find_plates, bands=BANDS))
    monkeypatch.setattr(im, "find_bowl", lambda *a: [])
    monkeypatch.setattr(im, "bread_mask", lambda bgr, area: np.zeros(bgr.shape[:2], bool))
    monkeypatch.setattr(ds, "COARSE", 16)
    monkeypatch.setattr(ds, "FINE", 6)
    monkeypatch.setattr(ds, "reassign", functools.partial(ds.reassign, piece=20))
    got = {}
    for x in segmentation.plate_foods(photo_of(spark, photos), table, None, sizes).collect():
        got.setdefault(x.image_id, {})[x.r, x.c] = x.label
    for i, m in photos.items():
        want, _ = ds.segment(m, prototypes)
        assert got[i] == {p: int(want[p]) for p in pixels(want)} and len(set(got[i].values())) >= 1


def test_values_by_frequency_are_numbered_over_partitions(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 400, 3000).tolist()
    got = labels.by_frequency(spark.createDataFrame([(v,) for v in values], "v int").repartition(5), "v").collect()
    counts = {v: values.count(v) for v in set(values)}
    assert [(r.v, r.n) for r in sorted(got, key=lambda r: r["rank"])] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert sorted(r["rank"] for r in got) == list(range(1, len(counts) + 1))


def test_bowls_match_arrays(spark):
    photos = {0: planted((100, 130), (60, 50, 30, 230)), 1: planted((100, 130), (70, 45, 34, 230), seed=1)}
    bands, rows = ((28, 31), (33, 36)), photo_of(spark, photos)
    plates = spark.createDataFrame([], "image_id long, x long, y long, radius int")
    for seen in (True, False):
        got = {x.image_id: (x.x, x.y, x.radius) for x in foods.find_bowl(rows, plates, seen, bands).collect()}
        want = {i: im.find_bowl(m, [], seen, bands) for i, m in photos.items()}
        assert got == {i: tuple(map(int, c[0])) for i, c in want.items() if c}


@pytest.mark.skipif(not os.environ.get("LONG_TESTS"), reason="takes three minutes; set LONG_TESTS")
def test_after_photos_have_only_the_labels_of_before_photos(spark):
    before = planted((70, 90), (45, 35, 24, 120), (45, 35, 12, (0, 220, 30)))
    rows = photo_of(spark, {0: before})
    prototypes = spark.createDataFrame([(k, [float(k == b) for b in range(60)]) for k in range(14)], "label int, vector array<double>")
    sizes = segmentation.Sizes(plates=((60, 61), (1, 2), (1, 1)), bowls=((22, 26), (26, 27)), bread=100_000.0)
    found = segmentation.segment_pairs(rows, rows, prototypes, sizes)
    labels_ = {x["side"]: (x["labels"], x["n"]) for x in found.groupBy("side").agg(F.collect_set("label").alias("labels"), F.count("*").alias("n")).collect()}
    circle = im.find_bowl(before, [], True, sizes.bowls)[0]
    assert labels_["before"] == labels_["after"] == ([segmentation.SALAD], int(im.salad_mask(before, circle).sum()))


def test_edges_are_not_broadcast(spark):
    raster = spark.range(600).selectExpr("id div 300 image_id", "id % 300 div 20 r", "id % 20 c", "id * id * 7 % 251 v")
    found = filters.edges(raster, "v", 50, 150)
    assert found.count() > 0
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_centres_and_edges_are_not_broadcast(spark):
    edges = spark.range(300).selectExpr("0L image_id", "id % 30 r", "id div 10 c", "1.0D gx", "double(id % 3) gy")
    centres = spark.range(9).selectExpr("0L image_id", "id cy", "id cx", "30L n")
    plans = [circles.ballots(edges, filters.bounds(edges), 3, 4), circles.radii(centres, edges, 3, 4, 1)]
    assert [p for p in plans if "BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString()] == []
