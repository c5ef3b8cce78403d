"""Shared helpers: table access, shared-folder materialisation and hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet`` through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, local mode gets a folder of its own; on a cluster, whose
    machines could not share such a folder, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="platewise-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts lineage with files every executor can read, so a lost executor costs
    only its running tasks.  The folder is deleted when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/platewise-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/platewise-" in f}
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """Word bytes -> 64-bit hash, filled on demand and emptied when it grows past ``limit``."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Low bytes of a 64-bit word, by how many of them belong to the word.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Bytes of text whose words are handled together.
SLICE_BYTES = 6_000_000
BLANKS = b" \t\n\x0b\x0c\r"


class Words:
    """The words of a buffer as arrays: places, 64-bit keys, and distinct words with codes.

    ``breaks`` are the bytes between words.  Distinct words are told apart by two
    independent 64-bit keys and the length.
    """

    def __init__(self, raw: bytes, breaks: bytes = BLANKS):
        self.raw = raw
        buf = np.frombuffer(raw + b"\0" * 8, np.uint8)
        is_break = np.zeros(256, bool)
        is_break[list(breaks)] = True
        inside = ~is_break[buf[: len(raw)]]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.starts, self.stops = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        self.keys = self._keys(buf)

    def _keys(self, buf: np.ndarray) -> np.ndarray:
        eight = np.ndarray((max(0, len(buf) - 7),), "<u8", buf, strides=(1,))
        size = self.stops - self.starts
        h = size.astype(U64) * U64(0x9E3779B97F4A7C15)
        at, live, off = self.starts, slice(None), 0
        while len(at):
            left = size[live] - off
            h[live] = mix64(h[live] ^ (eight[at + off] & _MASKS[np.minimum(left, 8)]))
            more = np.nonzero(left > 8)[0]
            live = more if isinstance(live, slice) else live[more]
            at, off = at[more], off + 8
        return h

    def distinct(self, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Code of each word and the index of each code's first word; ``also`` parts equal words."""
        import pandas as pd

        keys = self.keys if also is None else self.keys ^ mix64(also.astype(U64) + U64(1))
        codes, values = pd.factorize(keys)
        first = np.empty(len(values), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return codes, first

    def __getitem__(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.stops[i]]

    def pick(self, index: np.ndarray) -> list[bytes]:
        raw = self.raw
        return [raw[a:b] for a, b in zip(self.starts[index].tolist(), self.stops[index].tolist())]


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Runs of whole texts of about ``limit`` bytes: ``(first, last + 1)``; a longer text stands alone."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, k
            begin, size = k, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
