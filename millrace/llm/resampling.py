"""Importance resampling of documents towards a target's distribution of hashed n-grams.

In each partition DuckDB splits the texts, unnests and windows the n-grams, and counts
their buckets by a registered CRC function. The counts are written as Parquet; Spark merges
them over all documents, scores each document and draws the highest scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textvec
from millrace.llm.scratch import Scratch
from millrace.operators.numbering import numbered

#: Bytes of text that DuckDB counts at once; a longer text is handed over in parts of this size.
RUN_BYTES = 4 << 20
DUCK_MEMORY = "512MB"
#: What stands between words: ASCII without letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def features_sql(least: int, most: int, buckets: int) -> str:
    """Bucket counts (row, bucket, n) of a relation ``texts`` (row, part, text), and at bucket
    -1 the number of words of each row."""
    grams = []
    for n in range(least, most + 1):
        gram = " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, n)]])
        window = " WINDOW o AS (PARTITION BY row ORDER BY part, pos)" if n > 1 else ""
        grams.append(f"SELECT row, {gram} AS gram FROM w{window}")
    return f"""
    WITH split AS (SELECT row, part, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '{_BETWEEN}'), lambda x: x <> '') AS ws FROM texts),
    w AS (SELECT row, part, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split),
    g AS (SELECT row, gram, count(*) AS n FROM ({" UNION ALL ".join(grams)}) WHERE gram IS NOT NULL GROUP BY ALL),
    ids AS (SELECT gram, crc32_of(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM g))
    SELECT row, bucket::INTEGER AS bucket, sum(n)::BIGINT AS n FROM g JOIN ids USING (gram) GROUP BY ALL
    UNION ALL SELECT row, -1, sum(len(ws))::BIGINT FROM split GROUP BY row
    ORDER BY row, bucket"""


def _crc(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.uint32())


def _duck():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": ""})
    con.create_function("crc32_of", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def parts_of(text: str, size: int = RUN_BYTES) -> list[str]:
    """A long text cut between words; one word longer than ``size`` stays whole."""
    out, at = [], 0
    between = re.compile(_BETWEEN)
    while len(text) - at > size:
        cut = between.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def bucket_counts(docs: DataFrame, buckets: int, least: int = 1, most: int = 1) -> DataFrame:
    """(doc_id, n_words, buckets, counts) of each row: its n-grams' buckets and how many fall in
    each."""
    sql = features_sql(least, most, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for batch in batches:
            texts = batch.column("text")
            _, offsets = textvec.flat(texts)
            for i, j in textvec.pieces(offsets, RUN_BYTES):
                rows = [(row, k, part) for row, t in enumerate(texts.slice(i, j - i).to_pylist()) for k, part in enumerate(parts_of(t or ""))]
                given = pa.table({"row": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int64()), "text": pa.array([r[2] for r in rows], pa.string())})
                con.register("texts", given)
                found = con.sql(sql).to_arrow_table()
                con.unregister("texts")
                bucket, n = (found.column(c).to_numpy() for c in ("bucket", "n"))
                head = bucket == -1  # the first of each row
                ends = [*(head.nonzero()[0] - range(j - i)).tolist(), int((~head).sum())]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[~head], kind)) for x, kind in ((bucket, pa.int32()), (n, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n[head], pa.int64()), *lists], names=["doc_id", "n_words", "buckets", "counts"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, buckets array<int>, counts array<long>")


def _totals(features: DataFrame, name: str) -> DataFrame:
    """(bucket, name): each bucket's features over all rows."""
    each = features.select(F.explode(F.arrays_zip("buckets", "counts")).alias("f")).select(F.col("f.buckets").alias("bucket"), F.col("f.counts").alias("n"))
    return each.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the logarithm of its smoothed share in the
    target over that in the source, rounded down."""
    spark = source.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_totals(source, "s"), "bucket", "left").join(_totals(target, "t"), "bucket", "left")
    both = scratch.save(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    s, t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    share = ((F.col("t") + 1) * F.lit(s + buckets).cast("long")).cast("double") / ((F.col("s") + 1) * F.lit(t + buckets).cast("long")).cast("double")
    return both.select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: str = "2024", least: int = 1, most: int = 1) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs``; a rank has what is drawn.

    Of the N rows with ``least_words`` words the floor(percent * N / 100) highest scores are
    drawn, equal ones by smaller doc_id. The noise of a score comes from the doc_id's digest,
    so repeated rows are drawn together, each with a rank of its own; rows with a null doc_id
    share the digest of no digits and stand last among equal scores. Null and empty texts
    have no features, weight 0 and are not drawn unless ``least_words`` is 0. Extra columns
    are ignored; empty tables count nothing, and an empty ``docs`` gives no rows.

    Texts of any length are counted whole. Gains are doubles, exact products while they stay
    under 2**53.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    found = scratch.save(bucket_counts(docs, buckets, least, most).withColumn("uid", F.monotonically_increasing_id()))
    gain = scratch.save(gains(found, bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), buckets, least, most), buckets, scratch))

    each = found.select("uid", F.explode(F.arrays_zip("buckets", "counts")).alias("f")).select("uid", F.col("f.buckets").alias("bucket"), F.col("f.counts").alias("n"))
    # as many rows as there are buckets, whatever the input
    sums = each.join(F.broadcast(gain), "bucket").groupBy("uid").agg(F.sum("n").alias("n_features"), F.sum(F.col("n") * F.col("gain")).alias("total"))
    weight = F.when(F.col("n_features") > 0, ((F.col("total") - F.pmod("total", "n_features")) / F.col("n_features")).cast("long")).otherwise(F.lit(0).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = found.select("uid", "doc_id", "n_words").join(sums, "uid", "left").withColumn("weight", weight)
    scored = scored.select("doc_id", F.coalesce("n_features", F.lit(0)).alias("n_features"), "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("long"), "uid")
    placed = numbered(scored, "place", F.desc("long"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("uid"))
    draw = percent * placed.where("long").count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= draw, F.col("place")).alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)
