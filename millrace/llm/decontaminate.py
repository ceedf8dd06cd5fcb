"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

Every 13-word window of a benchmark item is looked up by its two rarest terms: their
postings, moved back by the terms' places in the item, must meet at one alignment. The
alignments that survive are then compared word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.scratch import Scratch

#: Everything ASCII but letters and digits parts words; all other code points belong to them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Lookup tables of at most so many rows, and items of so many words in all, are broadcast;
#: larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_WORDS = 50_000, 500_000
#: So many hashes of candidate documents are broadcast, 8 bytes each, to pick their texts
#: where they stand; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 20


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _lookup(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _key(docs: DataFrame) -> Column:
    """What tells documents apart: the doc_id and a hash of the text. Rows that share it have
    one text and so one result; it is never null."""
    return F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.xxhash64(docs["text"]).cast("string"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, w, m): one row per distinct item with words."""
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .distinct()
        .select(F.xxhash64("item_id", "w").alias("item"), "item_id", "w", F.size("w").alias("m"))
    )


def rarest_places(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, p1, p2): for each window of an item the places of its two rarest terms
    (p2 = p1 where it has one word)."""
    spread = (
        items.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - window, F.lit(0)))).alias("first"))
        .select("item", "first", F.posexplode(F.slice("w", F.col("first") + 1, window)).alias("i", "term"))
        .join(counts, "term", "left")
        .select("item", "first", (F.col("first") + F.col("i")).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    )
    order = Window.partitionBy("item", "first").orderBy("n", "p")
    return (
        spread.withColumn("r", F.row_number().over(order))
        .where("r <= 2")
        .groupBy("item", "first")
        .agg(F.min("p").alias("p1"), F.max("p").alias("p2"))
        .select("item", "p1", "p2")
        .distinct()
    )


def alignments(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 3) -> DataFrame:
    """(doc, item_id, w, delta, exact, near) of candidate matches, at most one row for
    each document, item and alignment ``delta`` (document place minus item place).

    ``exact``: both rarest terms of some window stand on the alignment. ``near``: they
    stand at most ``slop`` words apart from it. docs has doc and w (its words).
    """
    scratch = Scratch(docs.sparkSession, "postings")
    items = scratch.save(items_of(benchmark))
    terms = items.select(F.explode("w").alias("term")).distinct()
    # outer: an inner explode would add a test for empty lists that splits every text twice
    tokens = docs.select("doc", F.posexplode_outer("w").alias("pos", "term"))
    counts = scratch.save(tokens.select("term").join(_lookup(terms), "term").groupBy("term").agg(F.count("*").alias("n")))
    rare = scratch.save(rarest_places(items, counts, window))
    anchors = scratch.save(
        rare.select("item", F.explode(F.array("p1", "p2")).alias("p"))
        .distinct()
        .join(items, "item")
        .select("item", "p", F.element_at("w", F.col("p") + 1).alias("term"))
    )
    postings = scratch.save(tokens.join(_lookup(anchors.select("term").distinct()), "term"))
    moved = postings.join(anchors, "term").select("doc", "item", "p", (F.col("pos") - F.col("p")).alias("delta"))
    about = Window.partitionBy("doc", "item").orderBy("delta").rangeBetween(-slop, slop)
    met = (
        moved.withColumn("beside", F.collect_set("p").over(about))
        .groupBy("doc", "item", "delta")
        .agg(F.collect_set("p").alias("on"), F.first("beside").alias("beside"))
        .where(F.size("beside") > 0)
    )
    pairs = rare.groupBy("item").agg(F.collect_list(F.struct("p1", "p2")).alias("pairs"))
    shown, total = items.join(pairs, "item"), items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    both = lambda held: F.exists("pairs", lambda x: F.array_contains(held, x.p1) & F.array_contains(held, x.p2))
    return (
        met.join(F.broadcast(shown) if total <= BROADCAST_WORDS else shown, "item")
        .select("doc", "item_id", "w", "delta", both(F.col("on")).alias("exact"), both(F.col("beside")).alias("near"))
        .where("near")
    )


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, slop: int) -> DataFrame:
    """(doc, n_hit, item_ids, n_near, contaminated) of the documents that some item may match.
    Only their texts leave the place where they stand."""
    scratch = Scratch(docs.sparkSession, "contamination")
    texts = docs.select(_key(docs).alias("doc"), F.col("text").cast("string").alias("text"))
    found = alignments(texts.select("doc", words(F.col("text")).alias("w")), benchmark, window, slop)
    per_doc = scratch.save(
        found.groupBy("doc").agg(
            F.collect_list(F.when(F.col("exact"), F.struct("item_id", "w", "delta"))).alias("c"),
            F.array_distinct(F.collect_list(F.when(F.col("near"), F.col("item_id")))).alias("near"),
        )
    )
    wanted = _lookup(per_doc.select(F.xxhash64("doc").alias("wanted")).distinct(), BROADCAST_KEYS)
    shown = texts.join(wanted, F.xxhash64("doc") == F.col("wanted"), "left_semi").dropDuplicates(["doc"])

    def starts(c: Column) -> Column:
        size = F.least(F.size(c.w), F.lit(window))

        def here(i: Column) -> Column:
            at = c.delta + i
            fits = (at >= 0) & (at + size <= F.size("words"))
            return fits & (F.slice(F.col("words"), F.greatest(at, F.lit(0)) + 1, size) == F.slice(c.w, i + 1, size))

        return F.filter(F.sequence(F.lit(0), F.size(c.w) - size), here)

    def places(c: Column) -> Column:
        last = F.least(F.size(c.w), F.lit(window)) - 1
        return F.flatten(F.transform(c.s, lambda i: F.sequence(c.delta + i, c.delta + i + last)))

    met = F.filter(F.transform("c", lambda c: F.struct(c.item_id.alias("item_id"), c.w.alias("w"), c.delta.alias("delta"), starts(c).alias("s"))), lambda c: F.size(c.s) > 0)
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("met", lambda c: c.item_id), lambda x: x.isNotNull())))
    judged = (
        shown.join(per_doc, "doc")
        .select("doc", words(F.col("text")).alias("words"), "c", "near")
        .withColumn("met", met)
        .select(
            "doc",
            F.size("words").alias("n_words"),
            F.coalesce(F.size(F.array_distinct(F.flatten(F.transform("met", places)))), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(ids, F.array().cast("array<string>")).alias("item_ids"),
            "near",
        )
    )
    return scratch.save(
        judged.select(
            "doc", "n_hit", "item_ids", F.size(F.array_except("near", "item_ids")).cast("long").alias("n_near"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 3) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, n_near, contaminated) of each row of docs.

    A word is hit if it lies in an occurrence of any window of an item; an item of fewer
    words than a window is one window. item_ids are the ids, as sorted strings, of items
    with occurring windows; n_near counts items met within ``slop`` but not exactly.
    Contaminated: some word is hit and at least a twentieth of all are. Null and empty
    texts have no words and no hits; items without words match nothing; an item without
    id marks words but is not listed. Repeated rows and rows with a null doc_id are judged
    one by one. Extra columns are ignored.
    """
    hits = _hits(docs, benchmark, window, slop)
    rows = docs.select("doc_id", _key(docs).alias("doc"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(_lookup(hits), "doc", "left").select(
        "doc_id", "n_words", zero("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), zero("n_near"), F.coalesce("contaminated", F.lit(False)).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns. Their texts are
    not shuffled as long as few enough documents are contaminated."""
    bad = _lookup(_hits(docs, benchmark, window, 0).where("contaminated").select(F.col("doc").alias("bad_doc")), BROADCAST_ROWS * 10)
    return docs.join(bad, _key(docs) == bad["bad_doc"], "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
