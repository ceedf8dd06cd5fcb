"""Members of archives, planned from a pass over their headers and read as streams.

The first job reads headers only, an archive a task, and skips over contents. Its rows, the
places of members, are dealt to the tasks of the second job, each of which opens the
archive at its members' places. An archive inside is one place; it is unpacked as a stream.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.publish import located

#: Bytes of members that a task holds before it hands them on.
BATCH_BYTES = 4 << 20
ARCHIVES = (".tar.gz", ".tgz", ".tar")
_ROW = pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary())])


def _opened(path: str) -> BinaryIO:
    system, at = located(path)
    return system.open_input_file(at)


class _Part:
    """A stretch of a file as a stream of its own."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.left = file, size

    def read(self, n: int = -1) -> bytes:
        n = self.left if n < 0 else min(n, self.left)
        data = self.file.read(n)
        self.left -= len(data)
        return data


def _packed(name: str) -> bool:
    return name.endswith((".gz", ".tgz"))


def _walk(stream: BinaryIO, wanted: str) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the members of a streamed archive and of archives in it, in order."""
    with tarfile.open(fileobj=stream, mode="r|*", ignore_zeros=False) as tar:
        for m in tar:
            if not m.isfile():
                continue
            if m.name.endswith(ARCHIVES):
                yield from _walk(tar.extractfile(m), wanted)
            elif m.name.endswith(wanted):
                yield m.name, tar.extractfile(m).read()


def headers(spark: SparkSession, path: str, wanted: str = ".html") -> DataFrame:
    """(archive, name, at, size) of the wanted members of the tar files under ``path`` and of
    the archives in them; a packed file has no places and is one row as a whole (at -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if _packed(archive):
                    rows = [(archive, "", -1, length)]
                else:
                    with _opened(archive) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                        rows = [(archive, m.name, m.offset_data, m.size) for m in tar if m.isfile() and m.name.endswith((wanted, *ARCHIVES))]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["archive", "name", "at", "size"])

    # contents are not selected, so they are not read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.mapInArrow(run, "archive string, name string, at long, size long")


def archive_pages(spark: SparkSession, path: str, wanted: str = ".html") -> DataFrame:
    """(archive, name, content) of the wanted members of tar files, packed or not, and of the
    archives in them at any depth.

    Members are dealt by their place, so a large archive is read by many tasks; a packed one
    can only be read from its start and is one task's. A task holds BATCH_BYTES of members,
    or one that is larger. A file that is no archive is an error; an empty archive has no rows.
    """

    def read(rows: list[dict]) -> Iterator[tuple[str, str, bytes]]:
        for row in rows:
            with _opened(row["archive"]) as file:
                if row["at"] >= 0:
                    file.seek(row["at"])
                if row["at"] < 0 or row["name"].endswith(ARCHIVES):
                    for name, content in _walk(_Part(file, row["size"]), wanted):
                        yield row["archive"], name, content
                else:
                    yield row["archive"], row["name"], _Part(file, row["size"]).read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in read(batch.to_pylist()):
                held.append(row)
                size += len(row[2])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROW, strict=True)], schema=_ROW)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROW, strict=True)], schema=_ROW)

    places = headers(spark, path, wanted)
    dealt = places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive", "at")
    return dealt.mapInArrow(run, "archive string, name string, content binary")
