"""Phrase collocations from word-id suffix arrays.

Each shard of text becomes an array of word ids. Prefix doubling sorts its suffixes by
their first words; runs of the LCP array (how many words neighbours share) that are at
least n long are the n-grams, and their lengths the counts. Spark adds the counts by key.

A phrase can be frequent only if its words and word pairs are. So the counts of these come
first, by 64-bit keys, and a bit table of the frequent keys then cuts the shards' texts
where no frequent phrase can run through. The table only leaves out what is certainly
rare; the counts that decide are of the phrases themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import textvec
from millrace.llm.scratch import Scratch

#: Bytes of text in a shard; a longer text is cut into several.
SHARD_BYTES = 4 << 20
#: Least and most bits of the table of frequent keys, each a power of two; eight a key between.
LEAST_BITS, MOST_BITS = 16, 28
#: Parts of a language that are ranked on their own before the best of each meet.
RANK_PARTS = 16
_OUT_ROWS = 1 << 16
_U = np.uint64


# -- shards

def _breaks(raw: np.ndarray) -> np.ndarray:
    """Bytes that end a piece: . , ; : ! ? and line ends."""
    out = raw - np.uint8(0x0A) < 4
    for c in b".,;:!?":
        out |= raw == c
    return out


def _gaps(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | (raw == 0x09)


def _behind_words(raw: np.ndarray, at: int, n: int) -> int:
    """The end of the n-th word that begins at or behind ``at``, or of the text."""
    size = 1 << 12
    while True:
        part = raw[at : at + size]
        solid = ~(_gaps(part) | _breaks(part))
        ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        if len(ends) >= n:
            return at + int(ends[n - 1]) if n else at
        if at + size >= len(raw):
            return len(raw)
        size *= 4


def stretches(raw: np.ndarray, words: int, size: int = SHARD_BYTES) -> Iterator[tuple[int, int, int]]:
    """(begin, end, own): parts of one long text. Words from ``own`` on only complete phrases
    that begin before it; they are counted in the next part."""
    at = 0
    while at < len(raw):
        own = min(at + size, len(raw))
        while own < len(raw):
            seen = raw[at:own]
            cut = np.flatnonzero(_breaks(seen))
            cut = cut if len(cut) else np.flatnonzero(_gaps(seen))
            if len(cut):
                own = at + int(cut[-1]) + 1
                break
            own = min(own + size, len(raw))
        yield at, _behind_words(raw, own, words - 1) if own < len(raw) else own, own
        at = own


class Shard:
    """Words of some texts: an id of each (equal for equal words of one language), the piece
    it stands in, and whether phrases that begin with it are counted here."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: pa.Array, own: int | None = None):
        raw = textvec.lower(raw)
        breaks = _breaks(raw)
        solid = ~(breaks | _gaps(raw))
        n = len(raw)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begin = np.flatnonzero(solid & np.r_[True, ~solid[:-1] | first[1:n]]) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(solid & np.r_[~solid[1:] | first[1:n], True]) + 1 if n else begin
        size = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=size[1:])
        wide = size[-1] >= 1 << 31
        kind, width = (pa.LargeBinaryArray, np.int64) if wide else (pa.BinaryArray, np.int32)
        words = kind.from_buffers(*([pa.large_binary()] if wide else [pa.binary()]), len(begin), [None, pa.py_buffer(size.astype(width)), pa.py_buffer(np.ascontiguousarray(raw[solid]))])
        coded = words.dictionary_encode()
        of_row = langs.dictionary_encode()
        row = np.searchsorted(offsets, begin, side="right") - 1
        n_langs = max(len(of_row.dictionary), 1)
        both = np.asarray(coded.indices).astype(np.int64) * n_langs + np.asarray(of_row.indices).astype(np.int64)[row]
        named, self.ids = np.unique(both, return_inverse=True)
        self.words, self.langs = coded.dictionary.cast(pa.string()), of_row.dictionary
        self.word_of, self.lang_of = named // n_langs, named % n_langs
        self.hash = textvec.mix(_hashes(self.words)[self.word_of] ^ textvec.mix(_hashes(self.langs) + _U(1))[self.lang_of])
        self.piece = (np.cumsum(breaks) if n else np.zeros(0, np.int64))[begin] + row
        self.counted = np.ones(len(begin), np.int64) if own is None else (begin < own).astype(np.int64)
        self.linked = self.piece[1:] == self.piece[:-1]

    def pair_hash(self) -> np.ndarray:
        """A key of each word with its follower."""
        h = self.hash[self.ids]
        return _join(h[:-1], h[1:])

    def keep(self, known: Callable[[np.ndarray], np.ndarray]) -> None:
        """Cuts the pieces between words whose pair is not known, and leaves words that are
        not known out."""
        alive = known(self.hash)[self.ids]
        follows = np.zeros(len(alive), bool)
        follows[:-1] = self.linked & known(self.pair_hash()) & alive[:-1] & alive[1:]
        # a kept word that is linked has its follower as the next kept word
        self.ids, self.piece, self.counted, self.linked = self.ids[alive], self.piece[alive], self.counted[alive], follows[alive][:-1]

    def _left(self) -> np.ndarray:
        """Words from each one to the end of its run of linked words."""
        n = len(self.ids)
        last = np.flatnonzero(np.r_[~self.linked, True]) if n else np.zeros(0, np.int64)
        return last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1

    def suffixes(self, depth: int, left: np.ndarray) -> np.ndarray:
        """Places of words, sorted by the ``depth`` words from each on, by prefix doubling;
        a run's end comes before every word."""
        rank = self.ids.astype(np.int64) + 1
        order, h = np.argsort(rank, kind="stable"), 1
        while h < depth:
            other = np.zeros(len(rank), np.int64)
            other[:-h] = np.where(left[:-h] > h, rank[h:], 0)
            key = rank * (int(rank.max(initial=0)) + 1) + other
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(key) else sorted_key
            h *= 2
        return order

    def grams(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, a place of each distinct n-gram, its count) for n up to ``depth``."""
        left = self._left()
        at = self.suffixes(depth, left)
        common = np.zeros(max(len(at) - 1, 0), np.int64)
        alike = np.ones(len(common), bool)
        top = max(len(self.ids) - 1, 0)
        for d in range(depth):
            a, b = at[:-1], at[1:]
            alike &= (left[a] > d) & (left[b] > d) & (self.ids[np.minimum(a + d, top)] == self.ids[np.minimum(b + d, top)]) if len(common) else alike
            common += alike
        weight = self.counted[at]
        for n in range(1, depth + 1):
            begin = np.flatnonzero(np.r_[True, common < n]) if len(at) else np.zeros(0, np.int64)
            count = np.add.reduceat(weight, begin) if len(begin) else begin
            use = (left[at[begin]] >= n) & (count > 0)
            yield n, at[begin[use]], count[use]

    def phrases(self, n: int, at: np.ndarray) -> pa.Array:
        parts = [self.words.take(pa.array(self.word_of[self.ids[at + d]])) for d in range(n)]
        return pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]

    def lang(self, at: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.lang_of[self.ids[at]]))


def _hashes(values: pa.Array) -> np.ndarray:
    raw, offsets = textvec.flat(values)
    return textvec.span_hash(raw[: offsets[-1]] if len(raw) else np.zeros(1, np.uint8), offsets[:-1], offsets[1:])


def _join(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return textvec.mix(first * _U(0x9FB21C651E98DF25) + then)


def shards(batch: pa.RecordBatch, words: int, size: int = SHARD_BYTES) -> Iterator[Shard]:
    """The shards of a batch (lang, text)."""
    raw, offsets = textvec.flat(batch.column("text"))
    langs = batch.column("lang")
    for i, j in textvec.pieces(offsets, size):
        lo, hi = offsets[i], offsets[j]
        if j == i + 1 and hi - lo > size:
            for begin, end, own in stretches(raw[lo:hi], words, size):
                yield Shard(raw[lo + begin : lo + end], np.array([0, end - begin]), langs.slice(i, 1), own - begin)
        else:
            yield Shard(raw[lo:hi], offsets[i : j + 1] - lo, langs.slice(i, j - i))


# -- counts

def _plain(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def frequent_keys(docs: DataFrame, least: int, words: int = 2) -> DataFrame:
    """(key): 64-bit keys of the words and word pairs that occur ``least`` times in a language;
    a rarer one is among them only where keys collide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in shards(batch, words):
                pair = shard.pair_hash() if words > 1 else None
                for n, at, count in shard.grams(min(words, 2)):
                    key = shard.hash[shard.ids[at]] if n == 1 else pair[at]
                    for k in range(0, len(at), _OUT_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(key[k : k + _OUT_ROWS].view(np.int64)), pa.array(count[k : k + _OUT_ROWS])], names=["key", "n"])

    return _plain(docs).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def bit_table(keys: DataFrame, scratch: Scratch) -> np.ndarray:
    """A table of bits, of which those at the keys' low bits are set. Its size follows the
    keys up to 2**MOST_BITS bits, so no more than 32 MB reach the driver and the tasks."""
    saved = scratch.save(keys)
    bits = min(max((8 * saved.count()).bit_length(), LEAST_BITS), MOST_BITS)
    low = F.col("key").bitwiseAND((1 << bits) - 1)
    rows = saved.groupBy(F.shiftright(low, 15).alias("chunk")).agg(F.bitmap_construct_agg(low.bitwiseAND(32767)).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["chunk"] << 12 : (r["chunk"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    scratch.drop(saved)
    return out


def known_in(table: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    mask = _U(8 * len(table) - 1)

    def known(keys: np.ndarray) -> np.ndarray:
        low = keys & mask
        return (table[low >> _U(3)] >> (low & _U(7)).astype(np.uint8)) & np.uint8(1) == 1

    return known


def phrase_counts(docs: DataFrame, words: int, least: int, scratch: Scratch) -> DataFrame:
    """(lang, phrase, words, n): exact counts of all phrases of up to ``words`` words that occur
    ``least`` times, and of all words of a language as the phrase of no words."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(frequent_keys(docs, least, words), scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_in(table.value)
        names = ["lang", "phrase", "words", "n"]
        for batch in batches:
            for shard in shards(batch, words):
                total = np.bincount(shard.lang_of[shard.ids], weights=shard.counted, minlength=len(shard.langs)).astype(np.int64)
                none = [pa.array([""] * len(total), pa.string()), pa.array(np.zeros(len(total), np.int32)), pa.array(total)]
                yield pa.RecordBatch.from_arrays([shard.langs, *none], names=names)
                shard.keep(known)
                for n, at, count in shard.grams(words):
                    for k in range(0, len(at), _OUT_ROWS):
                        some = at[k : k + _OUT_ROWS]
                        yield pa.RecordBatch.from_arrays([shard.lang(some), shard.phrases(n, some), pa.array(np.full(len(some), n, np.int32)), pa.array(count[k : k + _OUT_ROWS])], names=names)

    grams = _plain(docs).mapInArrow(run, "lang string, phrase string, words int, n long")
    return scratch.save(grams.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0)))


# -- scores

def collocations(docs: DataFrame, words: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``words`` words.

    Cutting a phrase that occurs a times gives parts that occur l and r times and the score
    floor(1000000 * a * a / (l * r)); the lowest of its cuts counts, the first of equals. A
    phrase inside a longer candidate that has ``percent`` of its count is dropped. Equal
    scores go by a, then by the phrase's bytes.

    A null lang is ``und``; null and empty texts have no words; repeated rows count each; extra
    columns are ignored; an empty table gives no rows. A text of any length is counted whole;
    only one without any white space or stop in a shard's size makes a larger shard. Numbers
    are exact while a is under 10**15.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, words, least, scratch)
    phrases = counts.where("words > 1").withColumnRenamed("n", "a")
    parts = counts.where((F.col("words") > 0) & (F.col("words") < words))

    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cut = phrases.select("lang", "phrase", "a", k.alias("k")).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    first = parts.select(F.col("lang").alias("lang1"), F.col("phrase").alias("first1"), F.col("n").alias("l"))
    rest = parts.select(F.col("lang").alias("lang2"), F.col("phrase").alias("rest2"), F.col("n").alias("r"))
    cut = cut.join(first, (F.col("lang") == F.col("lang1")) & (F.col("first") == F.col("first1")))
    cut = cut.join(rest, (F.col("lang") == F.col("lang2")) & (F.col("rest") == F.col("rest2")))
    exact = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct(exact.alias("score"), "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")

    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    inside = phrases.where("words > 2").select(F.col("lang").alias("lang3"), "a", F.explode(spans).alias("phrase3"))
    inside = inside.groupBy("lang3", "phrase3").agg(F.max("a").alias("longer"))
    scored = scored.join(inside, (F.col("lang") == F.col("lang3")) & (F.col("phrase") == F.col("phrase3")), "left")
    scored = scored.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
