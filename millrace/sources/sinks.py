"""Sinks: sitemaps, feeds, catalogues, staged files, and publishing only what changed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.texts import signed
from millrace.sources.publish import located


def write_sitemap(entries: DataFrame, path: str) -> None:
    """<url> elements of url, priority and lastmod; missing ones are left out."""
    rows = entries.select(F.col("url").alias("loc"), F.col("priority").cast("string").alias("priority"), F.date_format("lastmod", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastmod"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)


def write_sitemaps(entries: DataFrame, public_path: str, internal_path: str) -> None:
    """The public map, and the internal one with all entries."""
    write_sitemap(entries.where(~F.col("internal")), public_path)
    write_sitemap(entries, internal_path)


def write_feed(items: DataFrame, path: str, n: int = 10) -> None:
    """The n newest items (title, url, posttime) as RSS items."""
    best = items.orderBy(F.desc("posttime"), "url").limit(n)
    rows = best.select("title", F.col("url").alias("link"), F.date_format("posttime", "dd MMM yyyy HH:mm:ss").alias("pubDate"))
    rows.coalesce(1).write.mode("overwrite").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)


def write_catalogue(rows: DataFrame, path: str, row_tag: str) -> None:
    """Nested XML; empty texts are no elements, arrays repeat theirs."""
    shown = [F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).write.mode("overwrite").format("xml").option("rootTag", "catalogue").option("rowTag", row_tag).save(path)


def write_staged(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep=";", quote='"', escape='"', quoteAll=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def changed_only(rows: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Rows whose content hash differs from that of the published row, and new ones."""
    columns = [c for c in rows.columns if c != key]
    hashed = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("hash"))
    same = hashed(rows).join(hashed(published), [key, "hash"]).select(key)
    return rows.join(same, key, "left_anti")


def push_payloads(users: DataFrame, site: str, key: str, secret: str, size: int = 100) -> DataFrame:
    """(site, batch, payload, signature): users of each site in JSON lists of at most ``size``."""
    from millrace.operators.queues import batches

    columns = [c for c in users.columns if c != site]
    rows = batches(users, site, key, size).groupBy(site, "batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct(key, *[c for c in columns if c != key])))).alias("payload"))
    return rows.withColumn("signature", signed(F.col("payload"), F.lit(secret)))


def write_each(files: DataFrame, folder: str) -> int:
    """Writes each row (name, content binary) as a file of that name under ``folder``, a folder
    that all executors share, and returns their number. A repeated task writes the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = f"{root}/{name}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
