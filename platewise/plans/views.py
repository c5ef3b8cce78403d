"""Deterministic scene relations over the driver tables, so that operators run at any scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GT_SQL = """SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS image_id, p_partkey AS pos, CAST((p_partkey * 7) % 13 + 1 AS INT) AS class_id,
 CAST((p_partkey * 37) % 900 AS INT) AS x, CAST((p_partkey * 53) % 600 AS INT) AS y, CAST(100 + p_size * 4 AS INT) AS w, CAST(80 + p_size * 3 AS INT) AS h FROM part"""
PRED_SQL = f"""SELECT image_id, pos, CAST(CASE WHEN pos % 11 = 0 THEN class_id % 13 + 1 ELSE class_id END AS INT) AS class_id,
 CAST(x + (pos * 17) % 97 - 48 AS INT) AS x, CAST(y + (pos * 29) % 61 - 30 AS INT) AS y, CAST(w + (pos * 5) % 41 - 20 AS INT) AS w, CAST(h + (pos * 3) % 31 - 15 AS INT) AS h
 FROM ({GT_SQL}) g WHERE pos % 9 <> 0"""
#: Sparse label pixels of small rasters: one for each event.
MASK_SQL = """SELECT user_id % 40 AS image_id, CAST((event_id * 31) % 240 AS INT) AS r, CAST((event_id * 17) % 320 AS INT) AS c,
 CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 6 WHEN 'purchase' THEN 10 ELSE 12 END AS INT) AS label FROM events"""
#: Colour pixels: one for each line item.
COLOUR_SQL = """SELECT l_orderkey AS image_id, CAST((l_partkey * 7 + l_linenumber) % 256 AS INT) AS b, CAST((l_suppkey * 13) % 256 AS INT) AS g,
 CAST(CAST(l_quantity AS BIGINT) * 5 % 256 AS INT) AS red FROM lineitem"""
CIRCLES_SQL = """SELECT c_nationkey AS image_id, c_custkey AS id, CAST((c_custkey * 131) % 1280 AS DOUBLE) + 0.5 AS x, CAST((c_custkey * 71) % 960 AS DOUBLE) + 0.25 AS y,
 CAST(10 + c_custkey % 30 AS DOUBLE) AS radius FROM customer"""
#: One cell for each day and hour of events, labelled by the most frequent type.
GRID_SQL = """SELECT 0 AS image_id, row, col, CAST(CASE WHEN label = 3 THEN -1 ELSE label END AS INT) AS label FROM (
 SELECT row, col, label, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, label) AS k FROM (
  SELECT CAST(floor(event_id / 240) AS INT) AS row, CAST(floor(event_id / 10) % 24 AS INT) AS col, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS INT) AS label, count(*) AS n
  FROM events GROUP BY 1, 2, 3) a) b WHERE k = 1"""
TABLES = ("part", "events", "lineitem", "customer", "orders", "embeddings", "supplier")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's SQL over the tables of ``sf_dir``, without names left in the catalogue."""
    import re

    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def _photo(places: str) -> str:
    return f"""SELECT k AS image_id, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c,
 CAST(CASE WHEN held THEN (20 * k + 3 * r) % 100 ELSE 60 + (r * 5 + c * 3 + k * 11) % 40 END AS INT) AS b,
 CAST(CASE WHEN held THEN 130 + (c * 2 + k * 9) % 90 ELSE 55 + (r * 3 + c * 5) % 30 END AS INT) AS g,
 CAST(CASE WHEN held THEN (c * 7 + r * 3 + k * 13) % 200 ELSE 60 + (r + c * 2 + k) % 25 END AS INT) AS red
 FROM (SELECT k, r, c, (r - 11) * (r - 11) + (c - 15) * (c - 15) <= (6 + k % 5) * (6 + k % 5) AS held FROM {places}) AS p"""


_KEYS = "SELECT DISTINCT CAST(floor(s_suppkey / 4) AS BIGINT) AS k FROM supplier"
#: Small colour images, one for each four suppliers: a disc of saturated colour on a dull ground, 24 rows and 32 columns.
PHOTO_SQL = _photo(f"(SELECT k, r, unnest(range(32)) AS c FROM (SELECT k, unnest(range(24)) AS r FROM ({_KEYS})))")
PHOTO_SPARK_SQL = _photo(f"(SELECT k, r, c FROM ({_KEYS}) AS t LATERAL VIEW explode(sequence(0, 23)) AS r LATERAL VIEW explode(sequence(0, 31)) AS c)")
#: Scattered masks, one for each 400 events, dense enough for regions of many sizes: all events are pixels.
BLOBS_SQL = """SELECT CAST(floor(event_id / 400) AS BIGINT) AS image_id, CAST((event_id * 7919 + user_id * 13) % 27 AS BIGINT) AS r, CAST((event_id * 104729 + user_id * 31) % 34 AS BIGINT) AS c,
 CAST(CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 ELSE 10 END AS INT) AS label FROM events"""


def _edges(rint: str) -> str:
    at = lambda centre, g: f"CAST({centre} + CASE WHEN stray THEN {g} ELSE {rint.format(f'radius * ({g} / norm)')} END AS BIGINT)"
    return f"""SELECT DISTINCT image_id, {at('cy', 'gy')} AS r, {at('cx', 'gx')} AS c, gx, gy
 FROM (SELECT *, sqrt(gx * gx + gy * gy) AS norm FROM (SELECT CAST(floor(event_id / 300) AS BIGINT) AS image_id, CAST((event_id * 37) % 41 - 20 AS DOUBLE) AS gx, CAST((event_id * 53) % 39 - 19 AS DOUBLE) AS gy, user_id % 6 = 0 AS stray,
 event_id % 3 * 26 + 24 AS cx, floor(event_id / 300) % 9 * 2 + 30 AS cy, event_id % 3 + 11 AS radius FROM events) AS e) AS f WHERE norm > 0"""


#: Edge pixels with gradients, one for each event: three circles an image, and stray ones.
EDGES_SQL, EDGES_SPARK_SQL = _edges("round_even({}, 0)"), _edges("rint({})")
