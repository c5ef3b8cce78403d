"""Whitening of embeddings by a distributed singular value decomposition (operator 12).

An entry ``c`` becomes the long ``x = floor(SCALE * c) + SHIFT``, so sums are exact.
The fit list is every remaining vector: ``n`` of them, with the sums ``S`` of each
dimension.  Rows are centred exactly, as ``(n * x - S) / n``, and given to Spark
MLlib's ``RowMatrix.computeSVD``: its right singular vectors are the eigenvectors of
the covariance, and its squared singular values over ``n`` the eigenvalues (divisor
``n``).  A row is whitened by projecting the centred row on each component and dividing
by the root of its eigenvalue.  The total variance is the sum of the exact deviations
``(n * x - S) ** 2``, kept as a decimal, over ``n ** 3``.

The driver holds the sums, the square Gram matrix of the decomposition and the
projection, all bounded by the number of dimensions, whatever the number of rows.

Rows: a null vector, one with a null, infinite or not-a-number entry, and one without
entries are dropped; of vectors of several lengths, those of the commonest (of equally
common ones the longest) are used and the others dropped; repeated rows count
each; a null id is kept; an empty table, or one whose vectors are all equal, has no
component and gives an empty result; components without variance are left out; equal
eigenvalues are numbered in the order of the decomposition, the same for all rows; other
columns are ignored, even where their names clash.  An entry whose ``x``, or a row whose
deviation, does not fit a long raises Spark's overflow error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import materialize, release

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: Eigenvalues below this share of the first are rounding errors.
LEAST_SHARE = 1e-12
#: Rows that are projected together.
CHUNK = 4096


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows whose vectors remain."""
    entry = F.col("embedding")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    valid = rows.where(entry.isNotNull() & (F.size(entry) > 0) & finite)
    lengths = valid.groupBy(F.size(entry).alias("d")).count()
    d = lengths.agg(F.max(F.struct("count", "d"))["d"]).scalar()
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return valid.where(F.size(entry) == d).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(rows: DataFrame, column: str) -> RowMatrix:
    """A distributed matrix of the arrays in ``column``, made without Python workers."""
    vectors = rows.select(array_to_vector(F.col(column)).alias(column))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, column))


def _fit(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors and the sums of their dimensions."""
    summed = vectors.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    found = summed.orderBy("k").collect()  # one row for each dimension
    return (found[0]["n"] if found else 0), np.array([r["s"] for r in found], np.int64)


def deviation(n: int, sums: np.ndarray) -> Column:
    """The sum of ``(n * x - S) ** 2`` over the dimensions, as a long."""
    squares = F.zip_with("x", F.lit(sums.tolist()), lambda x, s: (x * n - s) * (x * n - s))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda a, b: a + b)


def _components(vectors: DataFrame, n: int, sums: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (as columns) of the covariance."""
    centred = vectors.select(F.zip_with("x", F.lit(sums.tolist()), lambda x, s: (x * n - s).cast("double") / n).alias("v"))
    svd = _matrix(centred, "v").computeSVD(min(most, len(sums)), computeU=False)
    values = np.array(svd.s.toArray()) ** 2 / n
    keep = (values > 0) & (values > LEAST_SHARE * values.max(initial=0.0))
    return values[keep], svd.V.toArray()[:, : len(values)][:, keep]


def _projected(vectors: DataFrame, n: int, sums: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``vec_id, deviation, w``: the exact deviation and the whitened coordinates of every row."""
    known = vectors.select(F.struct("vec_id", deviation(n, sums).alias("deviation")).alias("row"), "x")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                w = ((x * n - sums) / n) @ weights
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["row", "w"])

    return known.mapInArrow(project, "row struct<vec_id: long, deviation: long>, w array<double>").select("row.*", "w")


def identity_error(whitened: DataFrame, n: int) -> float:
    """Largest absolute entry of the covariance (divisor ``n``) of the coordinates ``w`` minus the identity."""
    matrix = _matrix(whitened, "w")
    covariance = matrix.computeCovariance().toArray() * ((n - 1) / n)  # MLlib centres, and divides by n - 1
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each remaining row and component."""
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = materialize(whole_vectors(rows), "vectors")
    n, sums = _fit(vectors)
    total = float(vectors.select(deviation(n, sums).cast("decimal(38,0)").alias("d")).agg(F.sum("d")).first()[0] or 0) / n**3 if n else 0.0
    values, axes = _components(vectors, n, sums, components) if total > 0 else (np.zeros(0), None)
    if not len(values):
        release(vectors)
        return spark.createDataFrame([], schema)
    weights = axes / np.sqrt(values)
    projected = _projected(vectors, n, sums, weights)
    error = identity_error(projected, n)
    found = projected.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return found.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.lit((values / total).tolist()), F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
