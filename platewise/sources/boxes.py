"""Text and image sources: box files, prototype matrices, encoded rasters, tray enumeration."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions.scalars import leftover_number, tray_number

STRICT = r"^\s*ID:\s*([+-]?\d+)\s*;\s*\[\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*\]"
LENIENT = STRICT.replace("ID:", "ID:?")
BOX = "class_id int, x int, y int, w int, h int"


def parse_boxes(lines: DataFrame, value: str = "value", lenient: bool = False) -> DataFrame:
    """Box columns from lines of text; lines that do not match, or overflow, drop out."""
    pattern = LENIENT if lenient else STRICT
    names = ["class_id", "x", "y", "w", "h"]
    parsed = lines.withColumns({n: F.regexp_extract(value, pattern, k + 1).try_cast("int") for k, n in enumerate(names)})
    return parsed.where(" and ".join(f"{n} is not null" for n in names))


def marked_boxes(lines: DataFrame, value: str = "value") -> DataFrame:
    """All lines with the box columns of the lenient pattern (null if malformed), and whether they match the ``strict`` and the ``lenient`` one."""
    names = ["class_id", "x", "y", "w", "h"]
    parsed = lines.withColumns({n: F.regexp_extract(value, LENIENT, k + 1).try_cast("int") for k, n in enumerate(names)})
    whole = F.expr(" and ".join(f"{n} is not null" for n in names))
    return parsed.withColumns({"lenient": whole, "strict": whole & F.coalesce(F.regexp_extract(value, STRICT, 1) != "", F.lit(False))})


def read_boxes(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """``image_id`` (the file), ``pos`` (order in the file) and box columns.  A missing file is an empty table only as part of a glob."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("image_id"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    return parse_boxes(lines, lenient=lenient).drop("value")


def stream_boxes(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """The same as a stream of files."""
    lines = spark.readStream.text(path, wholetext=True).select(F.input_file_name().alias("image_id"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "value"))
    return parse_boxes(lines, lenient=lenient).drop("value")


def read_prototypes(spark: SparkSession, path: str) -> DataFrame:
    """``label, vector`` of a text matrix: two header lines (rows, columns), then one row a line."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s*\n\s*").alias("l"))
    rows = lines.select(F.posexplode(F.slice("l", F.lit(3), F.size("l") - 2)).alias("label", "row"))
    return rows.select("label", F.transform(F.split(F.trim("row"), r"\s+"), lambda x: x.cast("smallint")).alias("vector"))


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray) -> np.ndarray:
    """A PNG line (pixels x channels) whose filter looks to the left: 1 by sums, 3 and 4 pixel by pixel."""
    if kind == 1:
        return np.cumsum(line, axis=0) & 255
    channels = []
    for own, over in zip(line.T.tolist(), up.T.tolist()):
        out, left, corner = [], 0, 0
        for x, above in zip(own, over):
            if kind == 3:
                guess = (left + above) // 2
            else:
                p, q, r = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
                guess = left if p <= q and p <= r else above if q <= r else corner
            left = (x + guess) & 255
            corner = above
            out.append(left)
        channels.append(out)
    return np.array(channels, np.int64).T


def decode(data: bytes) -> np.ndarray | None:
    """A raster from binary PGM, PPM (to blue, green, red) or 8-bit PNG without interlacing; None if it is none of them."""
    if data[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        w, h, _ = fields
        depth = 3 if data[:2] == b"P6" else 1
        raster = np.frombuffer(data, np.uint8, w * h * depth, at + 1).reshape(h, w, depth)
        return raster[..., ::-1].copy() if depth == 3 else raster[..., 0].copy()
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, packed, palette = 8, b"", None
        while at < len(data):
            (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
                if bits != 8 or interlaced:
                    return None
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed += body
            at += 12 + size
        depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * depth)
        out = np.zeros((h, w * depth), np.uint8)
        above = np.zeros(w * depth, np.uint8)
        for y in range(h):
            kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
            if kind == 0:
                row = line
            elif kind == 2:
                row = line + above
            else:
                row = _unfiltered(kind, line.reshape(w, depth), above.astype(np.int64).reshape(w, depth)).ravel()
            above = out[y] = (row & 255).astype(np.uint8)
        raster = out.reshape(h, w, depth)
        if palette is not None:
            return palette[raster[..., 0]][..., ::-1].copy()
        return raster[..., 2::-1].copy() if depth >= 3 else raster[..., 0].copy()
    return None


def encode_png(mask: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = mask.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), mask.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, h, w, channels, data`` of masks and photos: PNG by Spark's image source, binary PGM and PPM; files of other kinds drop out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(p, decode(bytes(c))) for p, c in zip(rows["path"], rows["content"])]
            found = [(p, a) for p, a in found if a is not None]
            yield pd.DataFrame([(p, a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1, a.tobytes()) for p, a in found], columns=["image_id", "h", "w", "channels", "data"])

    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.p[gpn]m").load(path).select("path", "content")
    coded = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*.png").load(path).select("image.*")
    coded = coded.select(F.regexp_replace("origin", "^file:/+", "file:/").alias("image_id"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("channels"), "data")
    return coded.unionByName(plain.mapInPandas(run, "image_id string, h int, w int, channels int, data binary"))


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """The same of JPEG, PNG, BMP and GIF files, decoded by Spark's image source; files it cannot decode drop out."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return found.select(F.col("origin").alias("image_id"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("channels"), "data")


def photo_pixels(photos: DataFrame) -> DataFrame:
    """``image_id, r, c, b, g, red`` of photos of three channels, one row for each pixel."""
    kind = photos.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i, h, w, data in zip(rows["image_id"], rows["h"], rows["w"], rows["data"]):
                r, c = np.indices((h, w), dtype=np.int64)
                b, g, red = np.frombuffer(data, np.uint8).reshape(-1, 3).T.astype(np.int32)
                yield pd.DataFrame({"image_id": i, "r": r.ravel(), "c": c.ravel(), "b": b, "g": g, "red": red})

    return photos.where("channels = 3").select("image_id", "h", "w", "data").mapInPandas(run, f"image_id {kind}, r long, c long, b int, g int, red int")


def photo_pairs(pairs: DataFrame, photos: DataFrame, key: str = "image_id") -> DataFrame:
    """``pair_id, before_id, after_id`` of pairs with ``pair_id, before_path, after_path``; pairs without both photos, or of two sizes, drop out.

    ``key`` names the column of ``photos`` that paths end with or equal.
    """
    ends = lambda side: F.col(f"{side}.{key}").endswith(F.col(f"p.{side}_path"))
    named = photos.where("channels = 3").withColumn("_n", F.element_at(F.split(key, "/"), -1)).select(key, "h", "w", "_n")
    p = pairs.withColumns({f"_{k}": F.element_at(F.split(f"{k}_path", "/"), -1) for k in ("before", "after")}).alias("p")
    met = p.join(named.alias("before"), (F.col("p._before") == F.col("before._n")) & ends("before")).join(named.alias("after"), (F.col("p._after") == F.col("after._n")) & ends("after"))
    return met.where("before.h = after.h and before.w = after.w").select("p.pair_id", F.col(f"before.{key}").alias("before_id"), F.col(f"after.{key}").alias("after_id"))


def pair_pixels(pairs: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pixels of the pairs' before- and after-photos, named by ``pair_id``."""
    side = lambda k: photo_pixels(pairs.select(F.col("pair_id").alias("_p"), F.col(f"{k}_id").alias("image_id")).join(photos, "image_id").drop("image_id").withColumnRenamed("_p", "image_id"))
    return side("before"), side("after")


def mask_pixels(images: DataFrame) -> DataFrame:
    """Sparse pixels ``image_id, r, c, label`` of one-channel rasters, without background."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i, h, w, data in zip(rows["image_id"], rows["h"], rows["w"], rows["data"]):
                mask = np.frombuffer(data, np.uint8).reshape(h, w)
                r, c = np.nonzero(mask)
                yield pd.DataFrame({"image_id": i, "r": r.astype(np.int32), "c": c.astype(np.int32), "label": mask[r, c].astype(np.int16)})

    return images.where("channels = 1").mapInPandas(run, "image_id string, r int, c int, label smallint")


def enumerate_pairs(trays: DataFrame, root: str, leftovers: int = 3) -> DataFrame:
    """Before and after paths of every tray (``tray``) and each of its leftovers."""
    base = F.concat(F.lit(f"{root}/tray"), F.col("tray").cast("string"))
    found = trays.select("tray", F.explode(F.sequence(F.lit(1), F.lit(leftovers))).alias("leftover"))
    return found.withColumns({"before_path": F.concat(base, F.lit("/food_image.jpg")), "after_path": F.concat(base, F.lit("/leftover"), F.col("leftover").cast("string"), F.lit(".jpg"))})


def explicit_pairs(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Pairs given by their two paths, with tray and leftover read from the second; other columns stay."""
    named = rows.withColumnsRenamed({before: "before_path", after: "after_path"})
    return named.withColumns({"tray": tray_number(F.col("after_path")), "leftover": leftover_number(F.col("after_path"))})


def numbered(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
