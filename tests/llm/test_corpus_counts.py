"""Phrase collocations and importance resampling against brute force and their oracles."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import collocations as C
from millrace.llm import oracles
from millrace.llm import resampling as R

UPPER = {c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lowered(text):
    return text.translate({ord(a): b for a, b in UPPER.items()})


def phrases_of(text, words):
    for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered(text)):
        ws = [w for w in re.split(r"[ \t]+", piece) if w]
        for n in range(1, words + 1):
            for i in range(len(ws) - n + 1):
                yield tuple(ws[i : i + n])


def brute(rows, words=3, least=10, percent=50, top=2000):
    f = Counter()
    for lang, text in rows:
        f.update(("und" if lang is None else lang, p) for p in phrases_of(text or "", words))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, p), a in cand.items():
        around = [b for (g, q), b in cand.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= percent * a for b in around):
            continue
        cuts = [(math.floor(Fraction(1000000 * a * a, f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], score)
    out = set()
    for lang in {g for g, _ in found}:
        n = sum(c for (g, p), c in f.items() if g == lang and len(p) == 1)
        best = sorted(((-s, -a, p.encode(), l, r) for (g, p), (a, l, r, s) in found.items() if g == lang))[:top]
        out |= {(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def talk():
    rng = np.random.default_rng(4)
    words = ["a", "B", "b", "c", "dd", "é", "É", "x\x01", " z", "new york", "of the day", "it,", "end.", "line\nnext", "tab\tbed", "  "]
    rows = [(["en", "de", None][i % 3], " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)]
    return [*rows, ("en", None), ("en", ""), ("fr", "only one"), ("", "a b " * 30), (None, "a b " * 30)]


@pytest.mark.parametrize("words", [2, 3, 4])
def test_collocations_equal_brute_force(spark, talk, words):
    docs = spark.createDataFrame([(*r, "clash", 5) for r in talk], "lang string, text string, phrase string, n int").repartition(3)
    got = {tuple(r) for r in C.collocations(docs, words, least=5, top=40).collect()}
    assert got == brute(talk, words, least=5, top=40)
    assert len(got) > 40


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(none).count() == 0
    rare = spark.createDataFrame([("en", "a b c"), ("en", None)], "lang string, text string")
    assert C.collocations(rare).count() == 0


def shard_counts(batch, words, size):
    out = Counter()
    for shard in C.shards(batch, words, size):
        for n, at, count in shard.grams(words):
            for lang, p, c in zip(shard.lang(at).to_pylist(), shard.phrases(n, at).to_pylist(), count.tolist(), strict=True):
                out[lang, p] += c
    return out


def test_shards_of_any_size_count_alike(talk):
    long = " ".join(t or "" for _, t in talk) + " w" * 500 + " " + "y" * 900 + " a b."
    rows = [*[("und" if g is None else g, t or "") for g, t in talk], ("en", long)]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    want = Counter()
    for lang, text in rows:
        want.update((lang, " ".join(p)) for p in phrases_of(text, 3))
    for size in (64, 300, 5000, 1 << 20):
        assert shard_counts(batch, 3, size) == want


def test_suffixes_are_sorted_by_their_words(talk):
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(t or "" for _, t in talk)]})
    (shard,) = C.shards(batch, 4)
    left = shard._left()
    order = shard.suffixes(4, left)
    keys = [shard.ids[i : i + min(left[i], 4)].tolist() for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(shard.ids)))


def test_pruned_shards_keep_every_frequent_phrase(talk):
    """Whatever a table of known keys lets through besides, no count of a frequent phrase changes."""
    batch = pa.RecordBatch.from_pydict({"lang": ["und" if g is None else g for g, _ in talk], "text": [t or "" for _, t in talk]})
    want = Counter()
    for lang, text in talk:
        want.update(("und" if lang is None else lang, " ".join(p)) for p in phrases_of(text or "", 3))
    (shard,) = C.shards(batch, 3)
    keys = np.concatenate([shard.hash[shard.ids[at[c >= 8]]] if n == 1 else shard.pair_hash()[at[c >= 8]] for n, at, c in shard.grams(2)])
    shard.keep(lambda k: np.isin(k, keys))
    got = Counter()
    for n, at, count in shard.grams(3):
        got.update(dict(zip(zip(shard.lang(at).to_pylist(), shard.phrases(n, at).to_pylist(), strict=True), count.tolist(), strict=True)))
    assert {k: v for k, v in got.items() if v >= 8} == {k: v for k, v in want.items() if v >= 8}
    assert all(want[k] == v for k, v in got.items())


def test_bit_table_holds_all_keys(spark):
    from millrace.llm.scratch import Scratch

    keys = [0, 1, -1, 1 << 62, -(1 << 63), 12345678901]
    table = C.bit_table(spark.createDataFrame([(k,) for k in keys], "key long"), Scratch(spark, "test"))
    known = C.known_in(table)
    assert known(np.array(keys, np.int64).view(np.uint64)).all()
    assert int(np.unpackbits(table).sum()) <= len(keys)


def test_collocations_equal_the_oracle(same_rows):
    assert same_rows(C.op11_collocations, oracles.COLLOCATIONS) > 100


# -- resampling

SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams_of(text, least, most):
    ws = [w for w in SPLIT.split(lowered(text or "")) if w]
    return len(ws), [" ".join(ws[i : i + n]) for n in range(least, most + 1) for i in range(len(ws) - n + 1)]


def drawn(docs, target, buckets, percent, least_words, least, most):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    each = [(d, *grams_of(t, least, most)) for d, t in docs]
    s, t = Counter(bucket(g) for _, _, gs in each for g in gs), Counter(bucket(g) for x in target for g in grams_of(x, least, most)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    rows = []
    for d, n, gs in each:
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least_words))
    able = sorted((-r[3], r[0] is None, r[0] or 0) for r in rows if r[4])[: percent * sum(r[4] for r in rows) // 100]
    return rows, able


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 2), (2, 3)])
def test_resampling_equals_brute_force(spark, least, most):
    rng = np.random.default_rng(9)
    words = ["Alpha", "beta", "ÄRA", "ära", "x9", "9", "día", "-", "o'clock", "日本", "new\nline"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(200)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, texts[3]), (7, texts[7]), (500, ""), (501, "--- ...")]
    target = [" ".join(rng.choice(words[:4], 30)) for _ in range(5)] + [None]
    df = spark.createDataFrame([(*r, 1.5, "x") for r in docs], "doc_id long, text string, score double, rank string").repartition(3)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = R.resample(df, goal, buckets=50, percent=30, least_words=10, least=least, most=most).collect()
    rows, able = drawn(docs, target, 50, 30, 10, least, most)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key(r[:4]) for r in rows) == sorted(key(tuple(r)[:4]) for r in got)
    ranked = sorted((r.rank, r.score, r.doc_id) for r in got if r.rank is not None)
    assert [(-s, d is None, d or 0) for _, s, d in ranked] == able and [r[0] for r in ranked] == list(range(1, len(able) + 1))


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert R.resample(none, one).count() == 0
    (row,) = R.resample(one, none, least_words=1, percent=100).collect()
    assert (row.doc_id, row.n_features, row["rank"]) == (1, 3, 1)


def test_long_texts_are_cut_between_words():
    text = "one two, three -- four" * 50 + "x" * 400 + " end"
    parts = R.parts_of(text, 37)
    assert len(parts) > 5
    assert [w for p in parts for w in SPLIT.split(p) if w] == [w for w in SPLIT.split(text) if w]


def test_resampling_equals_the_oracle(same_rows):
    assert same_rows(R.op12_resampling, oracles.RESAMPLING) > 100
