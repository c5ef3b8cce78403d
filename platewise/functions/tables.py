"""Tables written between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, local mode gets a folder of its own; on a cluster, whose
    machines could not share it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="platewise-rounds-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage; deleted when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/platewise-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    place, system = _hadoop(spark, path)
    system.deleteOnExit(place)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/platewise-" in f}:
        place, system = _hadoop(df.sparkSession, folder)
        system.delete(place, True)
