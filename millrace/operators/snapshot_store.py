"""A snapshot in parts by a hash of its key, of which a merge rewrites only what it changes."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.merge import classify
from millrace.sources.publish import located, manifest, set_manifest
from millrace.sources.shared import saved


@dataclass(frozen=True)
class SnapshotStore:
    """The snapshot at ``path``, a folder that all executors share: rows of ``key`` and
    ``columns``, each key once. ``buckets`` is fixed when it is created; take so many that a
    part fits one task. A manifest names each part's files and digest, so readers see a
    merge whole or not at all. Merges must not run side by side.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    columns: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.key, *self.columns, self._bucket().alias("__bucket"))

    def _digests(self, placed: DataFrame) -> dict[str, str]:
        """Of each part that has rows, what no order of them changes."""
        row = F.xxhash64(*[F.struct(F.col(c).isNull(), c) for c in (*self.key, *self.columns)])
        sums = placed.withColumn("__h", row).groupBy("__bucket").agg(F.count("*").alias("n"), F.sum(F.col("__h").cast("decimal(38,0)")).alias("s"), F.bit_xor("__h").alias("x"))
        return {str(r["__bucket"]): f"{r['n']}:{r['s']}:{r['x']}" for r in sums.collect()}

    def _write(self, placed: DataFrame, parts: dict, gone: list[str]) -> None:
        """Writes the rows' parts as files of their own and names them in the manifest."""
        job = uuid.uuid4().hex
        dealt = placed.repartition("__bucket")
        dealt.write.partitionBy("__bucket").parquet(f"{self.path}/data/{job}")
        written = self.spark.read.schema(placed.schema).parquet(f"{self.path}/data/{job}")
        new = {b: {"job": job, "digest": d} for b, d in self._digests(written).items()}
        kept = {b: p for b, p in parts.items() if b not in gone}
        set_manifest(self.path, {"parts": kept | new, "schema": placed.drop("__bucket").schema.json()})

    def create(self, rows: DataFrame) -> None:
        self._write(self._placed(rows), {}, [])

    def _parts(self) -> dict[str, dict]:
        return manifest(self.path)["parts"]

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The rows, of all parts or some."""
        own = self._parts()
        return self._read({b: own[b] for b in (own if parts is None else parts) if b in own}).drop("__bucket")

    def _read(self, parts: dict[str, dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest(self.path)["schema"]))
        if not parts:
            return self._placed(self.spark.createDataFrame([], schema))
        files = [f"{self.path}/data/{p['job']}/__bucket={b}" for b, p in sorted(parts.items())]
        return self._placed(self.spark.read.schema(schema).parquet(*files))

    def merge(self, new: DataFrame, null_safe: bool = False) -> DataFrame:
        """Makes ``new`` the snapshot and returns the changes (key, change): deleted, inserted and
        updated rows as D, I and U.

        ``new`` is digested part by part; parts of equal digest are not read, let alone
        joined. Of the others those with a change are written anew; all other files stay
        the same files. Without ``null_safe`` a change from or to null is none, as ``<>``
        does not see it, and the row keeps its old values. Rows with a null in the key are
        deleted and inserted each time.
        """
        placed = self._placed(new)
        now, parts = self._digests(placed), self._parts()
        differ = sorted({b for b in now.keys() | parts.keys() if now.get(b) != parts.get(b, {}).get("digest")})
        at = [int(b) for b in differ]
        keys, columns = list(self.key), list(self.columns)
        old = self._read({b: parts[b] for b in differ if b in parts})
        both = classify(old, placed.where(F.col("__bucket").isin(*at) if at else F.lit(False)), keys, columns, null_safe)
        fresh = F.col("change").isin("I", "U")
        own = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
        values = [F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
        merged = saved(both.select(*own, *values, F.coalesce("n.__bucket", "o.__bucket").alias("__bucket"), "change"), "merged")
        touched = sorted(str(r["__bucket"]) for r in merged.where("change <> '='").select("__bucket").distinct().collect())
        if touched:
            rows = merged.where(F.col("__bucket").isin(*[int(b) for b in touched]) & (F.col("change") != "D")).drop("change")
            self._write(rows, parts, touched)
        return merged.where("change <> '='").select(*keys, "change")

    def vacuum(self) -> int:
        """Deletes the files of parts that no manifest names any more and returns how many
        parts those were. No reader may still be at an older snapshot."""
        system, root = located(self.path)
        own = {f"{root}/data/{p['job']}/__bucket={b}" for b, p in self._parts().items()}
        gone = 0
        for job in system.get_file_info(fs.FileSelector(f"{root}/data")):
            left = [i for i in system.get_file_info(fs.FileSelector(job.path)) if i.type == fs.FileType.Directory]
            for part in left:
                if part.path not in own:
                    system.delete_dir(part.path)
                    gone += 1
            if all(p.path not in own for p in left):
                system.delete_dir(job.path)
        return gone
