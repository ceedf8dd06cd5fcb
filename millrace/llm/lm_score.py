"""Language-model scores of whole documents: corpus counts, and a gated recurrent model
that learns from every training text. Each round takes a part of the texts; every partition
learns from its share of them, starting at the last round's average, and the results are
averaged anew."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textvec
from millrace.llm.gru import LONGEST, TRAIN_LANES, WINDOW_TOKENS, Gru, Trainer, score
from millrace.llm.scratch import Scratch

#: Sizes of the recurrent model: its most frequent words (the rest share one output, split
#: by their counts), output classes and hidden units.
VOCABULARY, CLASSES, HIDDEN = 8192, 64, 16
#: Words whose counts every task holds; counts of rarer words are joined.
HOT_WORDS = 1 << 18
#: Documents that one task fits the common start on, before the rounds: few at a time, in
#: short windows of few tokens and at a high rate, so that it takes many steps.
WARM_DOCS, WARM_LANES, WARM_TOKENS, WARM_LONGEST, WARM_RATE = 400, 16, 1024, 64, 0.3
#: Learning rate of each round. A hash of doc_id deals the texts to the rounds, each text to one.
RATES = (0.1, 0.1, 0.1, 0.05)
#: Tokens of a round that a replica learns from at least: small partitions are read together.
#: Where there are more than REPLICAS, it is the larger number.
REPLICA_TOKENS, LARGE_REPLICA_TOKENS, REPLICAS = 250_000, 2_000_000, 16
#: Tokens that are learned from or scored together: a step costs much where few long texts
#: are left, and among more texts there are fewer such steps.
TOGETHER = 4_000_000
#: Rows that a partition of a shuffle by word holds, so that partitions grow in number and not in size.
SHUFFLE_ROWS = 2_000_000
#: Bytes of texts that are worked on at once; a longer text is a run of its own.
RUN_BYTES = 8 << 20
#: Weights of a replica that are averaged together, and replicas that are added up at a time.
CHUNK, FAN_IN = 4096, 256

END_KEY = np.uint64(0x454E44)
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of a batch and row offsets into them; each row is closed by an end."""
    words, offsets = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, w, o in textvec.word_hashes(texts):
        words.append(w)
        offsets.append(o[1:] + offsets[-1][-1])
    all_words, all_offsets = np.concatenate(words), np.concatenate(offsets)
    return np.insert(all_words, all_offsets[1:], END_KEY), all_offsets + np.arange(len(all_offsets))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts are of bounded size together."""
    for b in batches:
        _, offsets = textvec.flat(b.column("text"))
        for i, j in textvec.pieces(offsets, RUN_BYTES):
            yield b.slice(i, j - i)


def together(parts: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
    """(word ids, row offsets, parts) of about TOGETHER tokens; a part begins with the word
    ids and the row offsets of a run."""

    def joined() -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        lengths = np.concatenate([np.diff(p[1]) for p in held])
        return np.concatenate([p[0] for p in held]), np.concatenate([[0], np.cumsum(lengths)]), held

    held: list[tuple] = []
    for p in parts:
        held.append(p)
        if sum(len(q[0]) for q in held) >= TOGETHER:
            yield joined()
            held = []
    if held:
        yield joined()


def token_counts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, c) of each distinct token; a key is the token's 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, c = np.unique(tokens(b.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c.astype(np.int64))], names=["key", "c"])

    parts = scratch.save(docs.select("text").mapInArrow(run, "key long, c long"))
    return parts.repartition(_partitions(parts.count()), "key").groupBy("key").agg(F.sum("c").alias("c"))


def _partitions(rows: int) -> int:
    return max(1, -(-rows // SHUFFLE_ROWS))


@dataclass
class Counts:
    """Counts of the hot words by sorted key, and the model's word id of each (0: none);
    every word counted ``least`` times or more is among them."""

    keys: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    least: int
    edges: np.ndarray
    frequencies: np.ndarray

    def __post_init__(self) -> None:
        # the keys are hashes, so their first bits deal them evenly: about one to each start
        bits = max(1, len(self.keys).bit_length())
        self.shift = _U(64 - bits)
        self.starts = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, hot) of tokens among the hot words: from the first with the same first bits
        on, a step at a time, as far as smaller keys stand there."""
        n = len(self.keys)
        if not n:
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        place = np.minimum(self.starts[tokens >> self.shift], n - 1)
        behind = np.flatnonzero(self.keys[place] < tokens)
        while len(behind):
            place[behind] += 1
            behind = behind[place[behind] < n]
            behind = behind[self.keys[place[behind]] < tokens[behind]]
        place = np.minimum(place, n - 1)
        return place, self.keys[place] == tokens

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        place, hot = self.find(tokens)
        return np.where(hot, self.words[place], 0) if len(self.keys) else np.zeros(len(tokens), np.int32)


def hot_counts(counts: DataFrame, total: int) -> Counts:
    """The hot words: all from some count on, at most HOT_WORDS."""
    # bins of like counts, few at any corpus size; from the most frequent down, as many as fit
    bins = counts.groupBy(F.floor(F.log2("c") * 32).alias("bin")).agg(F.count("*").alias("words"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()
    least, held = 1 << 62, 0
    for r in bins:
        held += r.words
        if held > HOT_WORDS:
            break
        least = r.least
    table = counts.where(F.col("c") >= least).toArrow()
    keys, c = table["key"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    # ids: 0 stands for all other words, 1 for the end, then words by frequency
    ranked = np.lexsort((keys, -c))
    ranked = ranked[keys[ranked] != END_KEY][: VOCABULARY - 2]
    words = np.zeros(len(keys), np.int32)
    words[ranked] = np.arange(2, len(ranked) + 2)
    words[keys == END_KEY] = 1
    ends = int(c[keys == END_KEY].sum())
    known = c[ranked]
    frequencies = np.concatenate([[total - ends - known.sum(), ends], known]).astype(float)
    roots = np.cumsum(np.sqrt(known + 1.0))
    cuts = np.searchsorted(roots, roots[-1] * np.arange(1, CLASSES - 2) / (CLASSES - 2)) if len(roots) else np.zeros(0, np.int64)
    edges = np.unique(np.concatenate([[0, 1, 2], 2 + cuts, [len(frequencies)]])).astype(np.int64)
    return Counts(keys, c, words, least, edges, frequencies)


def learned_round(docs: DataFrame, model: Gru, counts: Counts, rate: float, lanes: int, scratch: Scratch, window: tuple[int, int] = (WINDOW_TOKENS, LONGEST)) -> tuple[Gru, int, int]:
    """(model, texts, tokens): every partition of ``docs`` learns on from ``model``; the
    replicas' weights are averaged by the tokens they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, texts, seen = Trainer(model, rate, *window), 0, 0
        for ids, offsets, _ in together((counts.ids(k), o) for k, o in (tokens(b.column("text")) for b in runs(batches))):
            own.learn(ids, offsets, lanes)
            texts, seen = texts + len(offsets) - 1, seen + len(ids)
        if seen:
            v = own.model.vector().astype(np.float32)
            parts = [v[a : a + CHUNK] for a in range(0, len(v), CHUNK)]
            n = len(parts)
            group = TaskContext.get().partitionId() // FAN_IN
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([texts] * n, pa.int64()), pa.array([seen] * n, pa.int64()), pa.array(parts, pa.list_(pa.float32()))],
                names=["grp", "at", "texts", "seen", "v"],
            )

    def add(t: pa.Table) -> pa.Table:
        whole = np.sum([x.values.to_numpy().astype(np.float64) * n for x, n in zip(t["v"], t["weight"].to_pylist(), strict=True)], axis=0)
        sums = [pa.array([sum(t[c].to_pylist())], pa.int64()) for c in ("texts", "seen")]
        return pa.table([t["grp"].slice(0, 1), t["at"].slice(0, 1), *sums, pa.array([whole], pa.list_(pa.float64()))], names=["grp", "at", "texts", "seen", "v"])

    shape = "grp long, at long, texts long, seen long, v array<double>"
    replicas = scratch.save(docs.select("text").mapInArrow(run, shape.replace("double", "float")))
    once = replicas.withColumn("weight", F.col("seen")).groupBy("grp", "at").applyInArrow(add, shape)
    # what comes now is summed up already
    sums = once.withColumns({"grp": F.lit(0).cast("long"), "weight": F.lit(1).cast("long")}).groupBy("grp", "at").applyInArrow(add, shape)
    rows = sums.orderBy("at").toArrow()
    scratch.drop(replicas)
    if not len(rows):
        return model, 0, 0
    seen = rows["seen"][0].as_py()
    return model.with_vector(np.concatenate([x.values.to_numpy() for x in rows["v"]]) / seen), rows["texts"][0].as_py(), seen


def fit(docs: DataFrame, counts: Counts, scratch: Scratch) -> tuple[Gru, int]:
    """(model, texts learned from in the rounds). docs has doc_id and text, training only.
    The weights depend on how ``docs`` is partitioned, less so the more rounds there are."""
    model, texts = Gru.start(counts.frequencies, counts.edges, HIDDEN), 0
    # hashes alone find where the first texts end, so that each partition sends few texts
    place = F.xxhash64("doc_id", F.lit(5))
    last = docs.select(place.alias("h")).orderBy("h").limit(WARM_DOCS).agg(F.max("h")).first()[0]
    sample = docs.where(place <= F.lit(last)).orderBy(place, "doc_id").limit(WARM_DOCS).repartition(1)
    model, _, _ = learned_round(sample, model, counts, WARM_RATE, WARM_LANES, scratch, (WARM_TOKENS, WARM_LONGEST))
    small, large = (int(counts.frequencies.sum()) // (len(RATES) * n) for n in (REPLICA_TOKENS, LARGE_REPLICA_TOKENS))
    replicas = max(1, min(small, max(REPLICAS, large)))
    for r, rate in enumerate(RATES):
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(len(RATES))) == r)
        model, n, _ = learned_round(part.coalesce(replicas), model, counts, rate, TRAIN_LANES, scratch)
        texts += n
    return model, texts


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Tokens are words and one end per text; a null or empty text is its end alone. Nothing
    is learned from held-out rows (crc32 of doc_id mod 7 is 2) nor from rows with a null
    doc_id; counts and weights come from all others. ``base_score`` is the add-one unigram log10 probability; ``score`` that of the
    recurrent model over the whole text, where a word outside its vocabulary has the
    probability of "another word" times its share among those. Repeated rows are scored
    alike and counted each; an empty table gives an empty result; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = plain.where(in_training(F.col("doc_id")))
    counts = scratch.save(token_counts(learned, scratch))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = hot_counts(counts, n)
    model, _ = fit(learned, hot, scratch)
    in_model = hot.words > 0
    others = (n - int(hot.counts[in_model].sum())) + (v - int(in_model.sum())) + 1
    logs = np.log10(hot.counts + 1.0)

    def looked_up(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        keys, offsets = tokens(b.column("text"))
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(offsets))
        place, is_hot = hot.find(keys)
        ids = np.where(is_hot, hot.words[place], 0) if len(hot.keys) else np.zeros(len(keys), np.int32)
        value = np.where(is_hot, logs[place], 0.0) if len(hot.keys) else np.zeros(len(keys))
        total = lambda x: np.bincount(row, weights=x, minlength=rows)
        # each word that is not hot once a text, with how often it is there
        order = np.lexsort((keys[~is_hot], row[~is_hot]))
        cold_row, cold_key = row[~is_hot][order], keys[~is_hot][order]
        first = np.flatnonzero(np.r_[True, (cold_row[1:] != cold_row[:-1]) | (cold_key[1:] != cold_key[:-1])][: len(order)])
        times = np.diff(np.r_[first, len(order)])
        cold = np.concatenate([[0], np.cumsum(np.bincount(cold_row[first], minlength=rows))]).astype(np.int32)
        return ids, offsets, [
            b.column("doc_id"),
            pa.array(np.diff(offsets)),
            pa.array(total(is_hot).astype(np.int64)),
            pa.array(total(value)),
            pa.array(total(np.where(ids > 0, value, 0.0))),
            pa.array(total(ids == 0).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(cold), pa.array(cold_key[first].view(np.int64))),
            pa.ListArray.from_arrays(pa.array(cold), pa.array(times, pa.int64())),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for words, ends, parts in together(looked_up(b) for b in runs(batches)):
            p, at = score(model, words, ends) / np.log(10), 0
            for _, offsets, columns in parts:
                rows = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(rows)), *columns, pa.array(p[at : at + rows])],
                    names=["uid", "doc_id", "n_tokens", "n_hot", "logs", "model_logs", "n_other", "cold", "times", "p"],
                )
                uid, at = uid + rows, at + rows

    schema = "uid long, doc_id long, n_tokens long, n_hot long, logs double, model_logs double, n_other long, cold array<long>, times array<long>, p double"
    scored = scratch.save(plain.mapInArrow(run, schema))
    cold = counts.where(F.col("c") < hot.least)
    # the join shuffles both sides itself, so a word that very many texts hold can be split
    each = scored.select("uid", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("uid", F.col("x.cold").alias("key"), F.col("x.times").alias("times"))
    rest = each.join(cold, "key").groupBy("uid").agg(F.sum("times").alias("n_cold"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("cold_logs"))
    logs_all = F.col("logs") + F.coalesce("cold_logs", F.lit(0.0))
    return scored.drop("cold", "times").join(rest, "uid", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs_all - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("p") + logs_all - F.col("model_logs") - F.col("n_other") * float(np.log10(others))).alias("score"),
    )


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
