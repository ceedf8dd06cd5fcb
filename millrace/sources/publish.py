"""Publishing a table as a whole: tasks write aside, the commit names their files in one manifest.

A reader goes by the manifest, so it sees the old version or the new one and nothing
between. A failed job publishes nothing, and equal content leaves the version as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
#: Versions whose files stay: the one that is shown, and the one a reader may still be at.
KEPT = 2
_MOD = 1 << 128


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; Hadoop writes local ones as file:/x."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict | None:
    """What is published at ``path``: version, files, rows and digest; None if nothing is."""
    system, root = located(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def set_manifest(path: str, new: dict) -> None:
    """Writes aside and renames, so a reader finds the old manifest or the new one."""
    system, root = located(path)
    system.create_dir(root, recursive=True)
    aside = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as f:
        f.write(json.dumps(new).encode())
    system.move(aside, f"{root}/{MANIFEST}")


@dataclass
class _Part(WriterCommitMessage):
    file: str
    rows: int
    digest: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.job = path, schema, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = located(self.path)
        file, rows, digest, out = f"data/{self.job}/{uuid.uuid4().hex}.parquet", 0, 0, None
        try:
            for batch in iterator:
                if out is None:
                    system.create_dir(f"{root}/data/{self.job}", recursive=True)
                    out = pq.ParquetWriter(f"{root}/{file}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
                # a sum does not ask how rows were dealt to tasks
                digest = (digest + sum(xxhash.xxh3_128_intdigest(repr(tuple(r.values()))) for r in batch.to_pylist())) % _MOD
        finally:
            if out is not None:
                out.close()
        return _Part(file if out is not None else "", rows, digest)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        parts = [m for m in messages if m is not None and m.file]
        now = manifest(self.path)
        digest = f"{xxhash.xxh3_128_hexdigest(self.schema.json())}-{sum(p.rows for p in parts)}-{sum(p.digest for p in parts) % _MOD:032x}"
        if now is not None and now["digest"] == digest:
            self._drop(system, root, [self.job])
            return
        history = [self.job, *(now["history"] if now else [])]
        new = {"version": now["version"] + 1 if now else 1, "digest": digest, "rows": sum(p.rows for p in parts), "files": sorted(p.file for p in parts), "schema": self.schema.json(), "history": history[:KEPT]}
        set_manifest(self.path, new)
        self._drop(system, root, history[KEPT:])
        # what failed attempts of this job's tasks left
        if parts:
            known = {f"{root}/{p.file}" for p in parts}
            for info in system.get_file_info(fs.FileSelector(f"{root}/data/{self.job}")):
                if info.path not in known:
                    system.delete_file(info.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(*located(self.path), [self.job])

    @staticmethod
    def _drop(system: fs.FileSystem, root: str, jobs: list[str]) -> None:
        for job in jobs:
            if system.get_file_info(f"{root}/data/{job}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/data/{job}")


class PublishedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a version is published as a whole: use mode('overwrite')")
        return _Writer(self.options["path"].rstrip("/"), schema)


def publish(df: DataFrame, path: str) -> dict:
    """Publishes ``df`` as the next version at ``path``, a folder that the driver and all
    executors share, and returns its manifest. If its rows, in any order, are those of the
    version that is there, nothing changes. Publishers of one path must not run side by side.
    """
    df.sparkSession.dataSource.register(PublishedSource)
    df.write.format("published").mode("overwrite").save(path)
    return manifest(path)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The version that is published at ``path``."""
    now = manifest(path)
    if now is None:
        raise FileNotFoundError(path)
    schema = StructType.fromJson(json.loads(now["schema"]))
    if not now["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in now["files"]])
