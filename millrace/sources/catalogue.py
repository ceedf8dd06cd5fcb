"""Tables of a second database, read in parts side by side: of a server by JDBC, or of database
files in a folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.sources.publish import located

#: Rows that a connection fetches at once.
FETCH = 10_000


def _reader(spark: SparkSession, url: str, table: str, driver: str | None):
    options = {"url": url, "dbtable": table, "fetchsize": str(FETCH), "pushDownPredicate": "true", "pushDownAggregate": "true"}
    return spark.read.format("jdbc").options(**options | ({"driver": driver} if driver else {}))


def bounds(spark: SparkSession, url: str, table: str, key: str, driver: str | None = None) -> tuple[int, int] | None:
    """The least and greatest key; the database finds them. None if there is no key."""
    low, high = _reader(spark, url, table, driver).load().agg(F.min(key), F.max(key)).first()
    return None if low is None else (int(low), int(high))


def foreign_table(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, driver: str | None = None) -> DataFrame:
    """The rows of ``table``, read by up to ``parts`` tasks, each of a range of the whole-numbered
    ``key`` of its own.

    Ranges are of equal width between the least and greatest key, so a key with large gaps
    deals rows unevenly; rows without a key go to the first. Filters and columns that a query
    asks for are the database's work. A table without keys is read by one task. The parts
    are separate transactions, as they are for any reader in parts.
    """
    reader, found = _reader(spark, url, table, driver), bounds(spark, url, table, key, driver)
    if found is None or found[0] == found[1]:
        return reader.load()
    ranges = {"partitionColumn": key, "lowerBound": str(found[0]), "upperBound": str(found[1] + 1), "numPartitions": str(min(parts, found[1] - found[0] + 1))}
    return reader.options(**ranges).load()


def foreign_write(rows: DataFrame, url: str, table: str, driver: str | None = None, connections: int = 4) -> None:
    """Replaces ``table`` by ``rows``, over so many connections."""
    options = {"url": url, "dbtable": table, "numPartitions": str(connections), "batchsize": str(FETCH)}
    rows.write.format("jdbc").options(**options | ({"driver": driver} if driver else {})).mode("overwrite").save()


def file_write(rows: DataFrame, folder: str, table: str) -> list[str]:
    """Writes ``rows`` as ``table`` of database files under ``folder``, one a task, and returns
    the files' names. A file appears whole; what a failed task leaves has no name here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        with tempfile.TemporaryDirectory() as own:
            filled = False
            with duckdb.connect(f"{own}/db", config={"memory_limit": "512MB", "threads": 1}) as db:
                for batch in batches:
                    part = pa.Table.from_batches([batch])  # noqa: F841  (named in the statement)
                    db.execute(f'INSERT INTO "{table}" SELECT * FROM part' if filled else f'CREATE TABLE "{table}" AS SELECT * FROM part')
                    filled = True
            if filled:
                name = f"{uuid.uuid4().hex}.duckdb"
                system.create_dir(root, recursive=True)
                with open(f"{own}/db", "rb") as read, system.open_output_stream(f"{root}/{name}.part") as out:
                    shutil.copyfileobj(read, out, 1 << 20)
                system.move(f"{root}/{name}.part", f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return sorted(r.name for r in rows.mapInArrow(run, "name string").collect())


def file_table(spark: SparkSession, folder: str, names: list[str], table: str, schema: str, where: str = "true") -> DataFrame:
    """The rows of ``table`` in database files, of which each is read by a task of its own. The
    databases apply ``where``, in their SQL, and read only the columns of ``schema``."""
    types = T.StructType.fromDDL(schema)
    shape = to_arrow_schema(types)
    ask = f"""SELECT {", ".join(f'"{c}"' for c in types.names)} FROM "{table}" WHERE {where}"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with tempfile.TemporaryDirectory() as own:
                with system.open_input_stream(f"{root}/{name}") as read, open(f"{own}/db", "wb") as out:
                    shutil.copyfileobj(read, out, 1 << 20)
                with duckdb.connect(f"{own}/db", read_only=True, config={"memory_limit": "512MB", "threads": 1, "temp_directory": os.path.join(own, "tmp")}) as db:
                    for batch in db.execute(ask).to_arrow_reader(FETCH):
                        yield from pa.Table.from_batches([batch]).cast(shape).to_batches()

    if not names:
        return spark.createDataFrame([], types)
    each = spark.sparkContext.parallelize([(n,) for n in names], len(names))
    return spark.createDataFrame(each, "name string").mapInArrow(run, types)
