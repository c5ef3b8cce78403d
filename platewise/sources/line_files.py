"""A data source of small text files, one for each image: batch reader, writer and stream reader.

``spark.read.format("lines")`` gives ``image_id, pos, value`` (the file's name without its
ending, the line's number, the line).  Files are dealt to partitions by their sizes.
The writer takes the same columns, sorted by image: a task writes its images to a folder of its
own, and only the commit moves their files into place, so failed and repeated tasks leave
nothing behind.  Paths may be of any file system that Arrow knows.

Rows: an empty file has no lines; a line of the writer is null: it is left out; an
empty table writes no file; names that hold a slash are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "image_id string, pos long, value string"
#: Bytes of files that one partition reads.
PARTITION_BYTES = 16_000_000
#: Files of a micro-batch.
BATCH_FILES = 1000


def _system(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[5:]
    return fs.LocalFileSystem(), path


def _files(path: str, ending: str) -> list[tuple[str, int, int]]:
    """Names, sizes and times of the folder's files, or of the one file."""
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending) and not f.base_name.startswith(("_", ".")))


def _lines(path: str, files: list[str], ending: str) -> Iterator[tuple[str, int, str]]:
    system, _ = _system(path)
    for file in files:
        with system.open_input_stream(file) as stream:
            text = stream.read().decode("utf-8", "replace")
        name = file.rsplit("/", 1)[-1]
        name = name[: len(name) - len(ending)] if ending else name
        for pos, line in enumerate(text.splitlines()):
            yield name, pos, line


@dataclass
class Part(InputPartition):
    files: list[str]


def _parts(files: list[tuple[str, int, int]]) -> list[Part]:
    parts, size = [Part([])], 0
    for name, n, _ in files:
        if size and size + n > PARTITION_BYTES:
            parts.append(Part([]))
            size = 0
        parts[-1].files.append(name)
        size += n
    return parts


class Reader(DataSourceReader):
    def __init__(self, path: str, ending: str):
        self.path, self.ending = path, ending

    def partitions(self) -> list[InputPartition]:
        return _parts(_files(self.path, self.ending))

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        return _lines(self.path, partition.files, self.ending)


class StreamReader(DataSourceStreamReader):
    """Files in the order of their times; an offset is the last file taken, so a file written again comes again."""

    def __init__(self, path: str, ending: str):
        self.path, self.ending = path, ending
        self.upto: list | None = None

    def _after(self, offset: dict) -> list[tuple[str, int, int]]:
        return [f for f in sorted(_files(self.path, self.ending), key=lambda f: (f[2], f[0])) if [f[2], f[0]] > json.loads(offset["at"])]

    def initialOffset(self) -> dict:
        return {"at": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:
        if self.upto is None:
            self.upto = [-1, ""]
        new = self._after({"at": json.dumps(self.upto)})[:BATCH_FILES]
        if new:
            self.upto = [new[-1][2], new[-1][0]]
        return {"at": json.dumps(self.upto)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        last = json.loads(end["at"])
        self.upto = max(self.upto or last, last)
        return _parts([f for f in self._after(start) if [f[2], f[0]] <= last])

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        return _lines(self.path, partition.files, self.ending)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class Writer(DataSourceWriter):
    def __init__(self, path: str, ending: str, job: str):
        self.path, self.ending, self.job = path, ending, job

    def write(self, rows) -> Written:
        system, root = _system(self.path)
        folder, names, stream = f"{root}/_{self.job}/{uuid.uuid4().hex}", [], None
        system.create_dir(folder)
        try:
            for row in rows:
                if not names or row.image_id != names[-1]:
                    if "/" in row.image_id or row.image_id in names:
                        raise ValueError(f"no place for a file of its own, or lines apart: {row.image_id!r}")
                    if stream:
                        stream.close()
                    names.append(row.image_id)
                    stream = system.open_output_stream(f"{folder}/{row.image_id}{self.ending}")
                if row.value is not None:
                    stream.write(row.value.encode() + b"\n")
        finally:
            if stream:
                stream.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        for message in filter(None, messages):
            for name in message.names:
                system.move(f"{message.folder}/{name}{self.ending}", f"{root}/{name}{self.ending}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _system(self.path)
        if system.get_file_info(f"{root}/_{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_{self.job}")


class LineFiles(DataSource):
    """Options: ``path``; ``ending`` of the files' names, which is no part of ``image_id``."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("ending", "")

    def reader(self, schema) -> DataSourceReader:
        return Reader(*self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(*self._given())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(*self._given(), uuid.uuid4().hex)


def read_lines(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    spark.dataSource.register(LineFiles)
    return spark.read.format("lines").option("path", path).option("ending", ending).load()


def stream_lines(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    spark.dataSource.register(LineFiles)
    return spark.readStream.format("lines").option("path", path).option("ending", ending).load()


def write_lines(lines: DataFrame, path: str, ending: str = "") -> None:
    """Write ``image_id, pos, value`` as one file for each image, lines by ``pos``."""
    lines.sparkSession.dataSource.register(LineFiles)
    rows = lines.select(F.col("image_id").cast("string").alias("image_id"), F.col("pos").cast("long").alias("pos"), "value").repartition("image_id").sortWithinPartitions("image_id", "pos", "value")
    rows.write.format("lines").option("path", path).option("ending", ending).mode("append").save()
