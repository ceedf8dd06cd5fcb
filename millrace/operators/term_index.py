"""A stored positional index of terms, and searches that read only their terms' part of it.

Postings lie in folders by generation and by a hash of the term, so a search opens the
folders of its terms and no other. Changed documents come in as a generation of their own
that hides what older ones say of them, until ``merged`` writes one generation again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import search as S

#: Documents up to which the rarest term's candidates are sent to the others' tasks.
SEND_ROWS = 100_000
#: Writers of one folder: a term that all documents hold is not left to a single task.
WRITERS = 4


#: Documents whose words a task groups at once.
AT_ONCE = 500
_POSTING = "doc_id long, title int, term string, tf int, title_tf int, at array<int>"


def _postings(term_of: Callable[[str], str] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of documents (doc_id, title, words), one for each term of each. A word becomes a
    term once in so many documents, however often it occurs."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            lists = part.column("words")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            terms = coded.dictionary if term_of is None else pa.array([term_of(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            if term_of is not None:
                codes, terms = terms.indices.to_numpy().astype(np.int64)[codes], terms.dictionary
            doc = np.repeat(np.arange(len(lengths)), lengths)
            pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            key = doc * len(terms) + codes
            order = np.argsort(key, kind="stable")
            key, pos = key[order], pos[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            tf = np.diff(np.append(first, len(key)))
            title = part.column("title").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            own = key[first] // len(terms)
            in_title = np.add.reduceat(pos < title[doc[order]], first, dtype=np.int32)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(pos.astype(np.int32)))
            columns = [part.column("doc_id").take(pa.array(own)), pa.array(title[own]), terms.take(pa.array(key[first] % len(terms))).cast(pa.string()), pa.array(tf.astype(np.int32)), pa.array(in_title), places]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "title", "term", "tf", "title_tf", "at"])


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


@dataclass(frozen=True)
class TermIndex:
    """The index at ``path``, a folder that all executors share. ``buckets`` and ``config`` are
    those it was built with."""

    spark: SparkSession
    path: str
    buckets: int = 64
    config: S.Config | None = None

    # -- writing

    def _words(self, text):
        return self.config.plain(text) if self.config else S.words(text)

    def add(self, docs: DataFrame, generation: int) -> None:
        """Indexes ``docs`` (doc_id, text) as a generation, the first being 0. Later ones hold
        the documents that changed since, with a null text for those that went."""
        text = F.col("text")
        split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(self._words(S.title_of(text))).alias("title"), self._words(text).alias("words"))
        term_of = self.config.term_of if self.config else None
        posting = split.mapInArrow(lambda batches: _postings(term_of, batches), _POSTING)
        posting = posting.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(self.buckets)).cast("int"))
        dealt = posting.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(WRITERS)))
        ordered = dealt.sortWithinPartitions("bucket", "term", "doc_id")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/generation={generation}")
        counted = self._read("postings", generation).groupBy("bucket", "term").agg(F.count("*").alias("df"))
        counted.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms/generation={generation}")
        docs.select("doc_id").write.mode("overwrite").parquet(f"{self.path}/documents/generation={generation}")

    def merged(self, path: str) -> TermIndex:
        """An index at ``path`` of one generation with what this one shows; this one stays."""
        one = TermIndex(self.spark, path, self.buckets, self.config)
        live = self._live(self._read("postings"))
        live = live.drop("generation").repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(WRITERS)))
        live.sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{path}/postings/generation=0")
        one._read("postings").groupBy("bucket", "term").agg(F.count("*").alias("df")).write.partitionBy("bucket").parquet(f"{path}/terms/generation=0")
        one._read("postings").select("doc_id").distinct().write.parquet(f"{path}/documents/generation=0")
        return one

    # -- reading

    _SCHEMAS = {
        "postings": "term string, doc_id long, title int, tf int, title_tf int, at array<int>, generation int, bucket int",
        "terms": "term string, df long, generation int, bucket int",
        "documents": "doc_id long, generation int",
    }

    def _read(self, part: str, generation: int | None = None) -> DataFrame:
        read = self.spark.read.schema(self._SCHEMAS[part]).parquet(f"{self.path}/{part}")
        return read if generation is None else read.where(F.col("generation") == generation)

    def _live(self, postings: DataFrame) -> DataFrame:
        """Without what a later generation says anew."""
        later = self._read("documents").where("generation > 0").select(F.col("doc_id").alias("changed"), F.col("generation").alias("since"))
        return postings.join(later, (F.col("doc_id") == F.col("changed")) & (F.col("generation") < F.col("since")), "left_anti")

    def postings(self, terms: list[str]) -> DataFrame:
        """The live postings of the terms, from their folders alone."""
        here = sorted({bucket_of(t, self.buckets) for t in terms})
        return self._live(self._read("postings").where(F.col("bucket").isin(*here) & F.col("term").isin(*terms)))

    def rarest_first(self, terms: list[str]) -> list[tuple[int, str]]:
        """(documents, term), the fewest first. Documents that changed may count more than once."""
        here = sorted({bucket_of(t, self.buckets) for t in terms})
        rows = self._read("terms").where(F.col("bucket").isin(*here) & F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()
        counted = {r["term"]: r["df"] for r in rows}
        return sorted((counted.get(t, 0), t) for t in terms)

    def candidates(self, terms: list[str]) -> DataFrame:
        """(doc_id, most) of the documents that hold all terms; no rank exceeds ``most``.

        A cover has at least as many words as there are terms, so it adds at most the mean
        weight that the terms can have, over their number. Its start and last place move past
        one place of a term at most once a term: a document has at most as many covers as
        the rarest term has places, times the number of terms. Places are not read.
        """
        slim = self.postings(terms).select("doc_id", "term", "tf", "title_tf")
        out, sent = None, True
        for i, (df, term) in enumerate(self.rarest_first(terms)):
            own = slim.where(F.col("term") == term).select("doc_id", F.col("tf").alias(f"tf{i}"), F.when(F.col("title_tf") > 0, S.TITLE_WEIGHT).otherwise(S.BODY_WEIGHT).alias(f"w{i}"))
            if out is None:
                out, sent = own, df <= SEND_ROWS
            else:
                out = own.join(F.broadcast(out) if sent else out, "doc_id")
        tfs, weights = [F.col(f"tf{i}") for i in range(len(terms))], [F.col(f"w{i}") for i in range(len(terms))]
        least = F.least(*tfs) if len(tfs) > 1 else tfs[0]
        return out.select("doc_id", (least * reduce(lambda a, b: a + b, weights) / len(terms)).alias("most"))

    def ranks(self, terms: list[str], chosen: DataFrame) -> DataFrame:
        """(doc_id, rank) of chosen documents that hold all terms, as a scan of texts gives them."""
        held = self.postings(terms).join(chosen.select("doc_id"), "doc_id", "left_semi")
        held = held.select("doc_id", "title", "term", F.explode("at").alias("pos"))
        return S.ranked(S.covers(held, terms, "doc_id"), "doc_id")

    def search(self, pages: DataFrame, options: S.Search) -> DataFrame:
        """What ``search.search`` gives for the indexed texts. ``pages`` need no text.

        Bounds of ranks come first. The pages with the highest bounds are ranked, and the
        HIT_CAP-th rank among them is a floor: only pages whose bound reaches it are ranked
        besides. A relprio must not be negative.
        """
        if not options.terms:
            return S.search(pages, options)
        shown = S.allowed(pages, options).select("doc_id", "relprio")
        able = self.candidates(options.terms).join(shown, "doc_id").withColumn("bound", F.col("most") * F.col("relprio"))
        first = able.orderBy(F.desc("bound"), "doc_id").limit(2 * S.HIT_CAP)
        tops = self.ranks(options.terms, first).join(shown, "doc_id").select((F.col("rank") * F.col("relprio")).alias("key"))
        row = tops.orderBy(F.desc("key")).offset(S.HIT_CAP - 1).limit(1).first()
        if row is not None:
            # ranks are rounded to six places, bounds are not
            able = able.where(F.col("bound") + 1e-6 * F.col("relprio") >= row["key"])
        return S.page_of_hits(self.ranks(options.terms, able).join(shown, "doc_id"), options)
