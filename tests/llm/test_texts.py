"""Quality, personal data, language model, packing and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, gru, lm_score, packing, pii, quality, textvec

TEXT = "doc_id long, text string"
CLASH = ("w", "n", "score", "base", "loose", "uid", "cold", "part", "deal", "quality", "key", "start", "length")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# -- words

def test_word_hashes_follow_the_split_rule():
    texts = ["Ab  cD\tÉ é\x0b", "", None, "x", "\xa0nbsp stays", "ab cd é É"]
    out = {}
    for first, words, offsets in textvec.word_hashes(pa.array(texts)):
        for i in range(len(offsets) - 1):
            out[first + i] = words[offsets[i] : offsets[i + 1]].tolist()
    assert [len(out[i]) for i in range(6)] == [4, 0, 0, 1, 2, 4]
    assert out[0][:2] == out[5][:2] and out[0][2:] == out[5][:1:-1]


def test_long_texts_are_hashed_like_short_ones(monkeypatch):
    monkeypatch.setattr(textvec, "PIECE_BYTES", 64)
    rng = random.Random(4)
    words = [rng.choice(["a", "bb", "ccc" * 40, "é"]) for _ in range(500)]
    (_, long, _), = list(textvec.word_hashes(pa.array([" ".join(words)])))
    monkeypatch.setattr(textvec, "PIECE_BYTES", 1 << 20)
    (_, short, offsets), = list(textvec.word_hashes(pa.array(words)))
    assert long.tolist() == short.tolist() and len(offsets) == 501


# -- quality

def labelled(n=240, seed=1):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        w = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randrange(5, 60))]
        docs.append((i, " ".join(w) + "." if i % 3 else " | ".join(w).upper() + "!!", int(bool(i % 3))))
    return docs


def test_quality_is_learned_from_texts_alone(spark):
    docs = labelled()
    df = clashing(spark.createDataFrame([d[:2] for d in docs] + [(None, "a | B!!"), (9001, ""), (9002, None), (9003, "x " * 300_000)], TEXT))
    labels = spark.createDataFrame([(d, q) for d, _, q in docs] + [(1, 0), (9999, 1), (None, 0), (5, None)], "doc_id long, quality int")
    got = quality.quality_scores(df, labels).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(docs) + 4
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert sum(r.predicted == int(bool(r.doc_id % 3)) for r in held) >= 0.97 * len(held)
    assert by_id[9001].score == by_id[9002].score and not by_id[None].held_out
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)


def test_held_out_labels_do_not_matter(spark):
    docs = labelled(120)
    df = spark.createDataFrame([d[:2] for d in docs], TEXT)
    score = lambda labels: sorted((r.doc_id, r.score) for r in quality.quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect())
    true = [(d, q) for d, _, q in docs]
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q) for d, q in true]
    assert score(true) == score(turned)


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a")], TEXT)
    assert [r.score for r in quality.quality_scores(docs, none).collect()] == [0.5]
    assert quality.quality_scores(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.quality_scores(docs, one).first().score > 0.99


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([[i % 2], rng.integers(2, 50, 5)])) for i in range(80)]
    y = np.array([1 if i % 2 else -1 for i in range(80)])
    x = [np.full(len(r), len(r) ** -0.5) for r in rows]
    w, b = quality.dual_coordinate_descent(rows, x, y, cost=10)
    assert all((w[r] @ v + b) * t > 0 for r, v, t in zip(rows, x, y, strict=True))


# -- personal data

def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(7)
    bits = ["a@b.c", "_d", "@", ".", "x@y-z.com", "1.2.3.4", "300.1.1.1", ".5", "4111 1111 1111 1111", "-", " ", "0", "99", "+1 (555) 123-4567", "+", "é", "(", "8", "%a.b@c.d@e.f", "4111-1111-1111-1112", "\n", "0001.0255.1.0"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        got = [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)]
        assert got == plain_spans(t), t


def test_base_spans_of_long_runs_are_quick():
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []
    assert pii.base_spans("a" * 50_000 + "@b.c")[0] == (0, 0, 50_004)


def test_spans_keep_the_base_and_add_what_votes_say(spark):
    good = ["mail me at jo@ex.com now", "call +1 (555) 123-4567 now", "card 4111111111111111 ok", "from 10.20.30.40 to"]
    odd = ["card 1234567890123456 no", "mail bo [at] ex [dot] com now", "call +1 (555) 123-4567 10.20.30.40 x", ""]
    texts = good * 30 + odd * 3
    df = clashing(spark.createDataFrame(list(enumerate(texts)) + [(None, None), (7000, "ok " * 200_000 + "a@b.co")], TEXT))
    got = {r.doc_id: r for r in pii.find_spans(df).collect()}
    assert len(got) == len(texts) + 2
    for i, t in enumerate(texts):
        own = [(pii.KINDS[s.kind], s.start, s.stop) for s in got[i].base]
        assert own == plain_spans(t)
        assert set(got[i].base) <= set(got[i].spans)
    spelled = texts.index(odd[1])
    assert [(s.kind, s.start, s.stop) for s in got[spelled].spans] == [(0, 5, 25)]
    split = texts.index(odd[2])
    assert any(s.kind == 3 for s in got[split].spans)
    assert got[None].spans == [] and got[7000].base[0].stop == 600_006
    masked = {r.doc_id: r for r in pii.masked(df.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert masked[0].text == "mail me at [email] now" and masked[0].n_chars == len("mail me at [email] now") and masked[0].w == "x"
    assert masked[None].text is None and masked[texts.index("")].text == ""


def test_personal_data_of_no_documents(spark):
    assert pii.find_spans(spark.createDataFrame([], TEXT)).count() == 0
    assert pii.masked(spark.createDataFrame([], TEXT)).count() == 0


def test_em_trusts_labelers_that_agree():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.85, 0.8, 0.5]
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth) * 2 for r in right], axis=1)
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    p, table = pii.estimate_reliabilities(patterns, count.astype(float))
    assert table[0, 1, 2] > 0.9 and abs(table[4, 1, 2] - 0.5) < 0.1
    posterior = {tuple(v): x for v, x in zip(patterns.tolist(), p, strict=True)}
    called = np.array([posterior[tuple(v)] > 0.5 for v in votes.tolist()])
    assert (called == truth).mean() > 0.95


# -- language model

def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    rng = np.random.default_rng(1)
    edges, lengths = np.array([0, 1, 2, 6, 12]), np.array([5, 3, 2])
    words, offsets = rng.integers(0, 12, 10), np.array([0, 5, 8, 10])
    m = gru.Gru.start(rng.integers(1, 50, 12).astype(float), edges, 4)
    start = m.vector() + rng.normal(0, 0.2, len(m.vector()))

    def exact(v):
        out, at = {}, 0
        for n in m.trained():
            a = getattr(m, n)
            out[n] = v[at : at + a.size].reshape(a.shape).copy()
            at += a.size
        return gru.Gru(**out, edges=edges)

    loss = lambda v: -gru.score(exact(v), words, offsets).sum() / len(words)
    steps = np.eye(len(start)) * 1e-5
    slope = np.array([(loss(start + s) - loss(start - s)) / 2e-5 for s in steps])
    moved = exact(start)
    gru._window(moved, {n: np.full(getattr(moved, n).shape, 1e12) for n in moved.trained()}, np.repeat(moved.first[None, :], 3, axis=0), words, offsets[:-1], lengths, 0, 5, 1.0)
    assert np.abs((start - moved.vector()) * 1e6 - slope).max() < 1e-6


def test_probabilities_add_up_and_state_runs_through():
    m = gru.Gru.start(np.arange(1, 13).astype(float), np.array([0, 1, 2, 6, 12]), 4)
    m = m.with_vector(m.vector() + np.random.default_rng(0).normal(0, 0.5, len(m.vector())))
    states = np.random.default_rng(1).normal(size=(1, 4)).astype(np.float32)
    assert sum(math.exp(gru.log_probs(m, states, np.array([w]))[0]) for w in range(12)) == pytest.approx(1, abs=1e-4)
    long = np.random.default_rng(2).integers(0, 12, 200)
    alone = gru.score(m, long, np.array([0, 200]))[0]
    beside = gru.score(m, np.concatenate([long[:7], long]), np.array([0, 7, 207]))[1]
    assert alone == pytest.approx(beside, rel=1e-5)


def test_base_scores_equal_counting(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HOT_WORDS", 12)
    monkeypatch.setattr(lm_score, "VOCABULARY", 8)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("The the of to a in x%d y%d" .split()) .replace("%d", str(rng.randrange(40))) for _ in range(rng.randrange(30)))) for i in range(120)]
    docs += [(200, None), (201, ""), (None, "the of"), (3, docs[3][1])]
    got = lm_score.score_documents(clashing(spark.createDataFrame(docs, TEXT))).collect()
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["\n"]
    counts = Counter()
    for d, t in docs:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(split(t))
    n, z = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    want = sorted((d if d is not None else -1, len(split(t)), sum(w in counts for w in split(t)), n, round(sum(math.log10(counts[w] + 1) - z for w in split(t)), 6)) for d, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"{a} {a}{a}" for a in rng.choices("abcdefgh", k=40))) for i in range(300)]
    got = lm_score.score_documents(spark.createDataFrame(docs, TEXT)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_language_model_of_nothing(spark):
    assert lm_score.score_documents(spark.createDataFrame([], TEXT)).count() == 0
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_score.score_documents(spark.createDataFrame([(one, "never seen")], TEXT)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


# -- packing

def test_first_fit_decreasing_equals_a_scan():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 300):
        lengths = rng.integers(1, 1025, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 1024)
        free, want = [], {}
        for k in sorted(range(n), key=lambda i: (-lengths[i], i)):
            b = next((i for i, f in enumerate(free) if f >= lengths[k]), len(free))
            free += [1024] * (b == len(free))
            want[k] = (b, 1024 - free[b])
            free[b] -= lengths[k]
        assert {k: (int(bins[k]), int(offsets[k])) for k in range(n)} == want


def test_encoder_gives_the_ids_of_whole_texts():
    path = bpe.default_path()
    own = packing.Encoder(path)
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "word", "Wörter", "'s", " ", "　", "<|endoftext|>", "1234", "é", "漢字", "!?", "\x1f", "\u0085", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", None, "a " * 5000]
    want = [e.ids + [0] for e in Tokenizer.from_file(bpe.default_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        got = {}
        for first, ids, offsets in own.rows(pa.array(texts)):
            for i in range(len(offsets) - 1):
                got[first + i] = ids[offsets[i] : offsets[i + 1]].tolist()
        assert [got[i] for i in range(len(texts))] == want


def test_packed_pieces_cover_every_id_once(spark):
    texts = ["", None, "short", "tok " * 3000, "dup", "dup"] + [f"w{i} " * (i * 7 % 400) for i in range(300)]
    docs = [(None if i == 2 else i, t) for i, t in enumerate(texts)]
    got = packing.pack(clashing(spark.createDataFrame(docs + [docs[5]], TEXT)), bpe.default_path(), group_pieces=64).collect()
    tokenizer = Tokenizer.from_file(bpe.default_path())
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        times = 2 if i == 5 else 1
        own = sorted(pieces[i], key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in own)
        assert sum(r.length for r in own) == times * len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(spark.createDataFrame([], TEXT), bpe.default_path()).count() == 0


# -- the pipeline

def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline as c
    from millrace.llm import decontaminate, near_dup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"key": F.lit(1), "rep": F.lit(2)})
    assert [n for n, _ in c.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "packing"]
    stage = dict(c.STAGES)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = stage["quality"](spark, docs, sf_dir)
    assert ids(kept) == ids(quality.quality_scores(docs, labels).where("predicted = 1")) and kept.columns == docs.columns
    dedup = stage["near_dedup"](spark, docs, sf_dir)
    assert ids(dedup) == ids(near_dup.near_duplicates(docs).where("kept")) and dedup.columns == docs.columns
    clean = stage["decontaminate"](spark, docs, sf_dir)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(clean) == ids(decontaminate.contamination(docs, bench).where("NOT contaminated")) and clean.columns == docs.columns
    masked = stage["pii"](spark, docs, sf_dir)
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in masked.collect():
        want = pii.replace_spans(text[r.doc_id], [(s.kind, s.start, s.stop) for s in found[r.doc_id].spans])
        assert r.text == want and r.n_chars == len(want)
    run = c.run(spark, sf_dir)
    last = docs.drop("key", "rep")
    for _, f in c.STAGES[:-1]:
        last = f(spark, last, sf_dir)
    assert sorted({r.doc_id for r in run.collect()}) == ids(last)


def test_held_out_score_of_the_registered_query(spark):
    """On the whole table at sf0.01: word frequencies alone reach -234375, and what round 1 learned -229064."""
    r = lm_score.op5_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert round(r[1]) == -234375 and r[0] > -228500


def test_a_word_that_only_held_out_texts_have_many_times(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HOT_WORDS", 3)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = [(i, "the odd " + "odd " * (i % 50) + "rare rare" if i in ids else f"the of w{i % 5} rare") for i in range(400)]
    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(docs, TEXT)).collect()}
    counts = Counter(w for i, t in docs if i not in ids for w in [*t.split(), "\n"])
    z = math.log10(sum(counts.values()) + len(counts) + 1)
    for i, t in docs:
        ws = [*t.split(), "\n"]
        assert (got[i].n_tokens, got[i].n_known) == (len(ws), sum(w in counts for w in ws))
        assert got[i].base_score == pytest.approx(sum(math.log10(counts[w] + 1) - z for w in ws), abs=1e-6)


def test_runs_are_stepped_through_together(monkeypatch):
    """A step costs much where few texts are left: three runs with a long text each take the steps of one."""
    steps = []
    monkeypatch.setattr(gru, "_step", lambda *a, own=gru._step: steps.append(a[1].shape[1]) or own(*a))
    m = gru.Gru.start(np.arange(1, 13).astype(float), np.array([0, 1, 2, 6, 12]), 4)
    rng = np.random.default_rng(3)
    m = m.with_vector(m.vector() + rng.normal(0, 0.5, len(m.vector())))
    parts = [(rng.integers(0, 12, 305 + k).astype(np.int32), np.array([0, 5, 305 + k]), k) for k in range(3)]
    ((words, offsets, held),) = lm_score.together(iter(parts))
    assert [p[2] for p in held] == [0, 1, 2]
    joined = gru.score(m, words, offsets)
    assert (len(steps), sum(steps)) == (302, 3 * 305 + 3)
    assert joined == pytest.approx(np.concatenate([gru.score(m, w, o) for w, o, _ in parts]), rel=1e-5)
    steps.clear()
    gru.Trainer(m, 0.1).learn(words, offsets)
    assert len(steps) == 302
    monkeypatch.setattr(lm_score, "TOGETHER", 400)
    assert [[p[2] for p in held] for _, _, held in lm_score.together(iter(parts))] == [[0, 1], [2]]


@pytest.mark.filterwarnings("ignore:divide by zero")
@pytest.mark.parametrize("large", [1.0, 30.0, 200.0])
def test_probabilities_of_large_weights(large):
    """Scores within reach of exp, where biases are multiplied in, and beyond it."""
    m = gru.Gru.start(np.arange(1, 13).astype(float), np.array([0, 1, 2, 6, 12]), 4)
    rng = np.random.default_rng(4)
    m.gates, m.inner = m.gates * np.float32(50 * large), m.inner * np.float32(50)
    m.to_class, m.to_word = (rng.uniform(-large / 4, large / 4, w.shape).astype(np.float32) for w in (m.to_class, m.to_word))
    m.word_bias = rng.uniform(-7, 7, 12).astype(np.float32)
    assert gru._safe((m.to_class, m.class_bias), (m.to_word, m.word_bias)) == (large < 38)
    states = rng.choice([-1.0, 1.0], (6, 4)).astype(np.float32)
    p = np.array([gru.log_probs(m, states, np.full(6, w)) for w in range(12)])
    plain = lambda w, b: (x := states.astype(float) @ w.T.astype(float) + b) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - x.max(axis=1, keepdims=True)
    of_class = np.searchsorted(m.edges, np.arange(12), side="right") - 1
    want = plain(m.to_class, m.class_bias)[:, of_class] + np.concatenate([plain(m.to_word[a:b], m.word_bias[a:b]) for a, b in zip(m.edges[:-1], m.edges[1:], strict=True)], axis=1)
    seen = want > -80
    assert p.T[seen] == pytest.approx(want[seen], abs=1e-2)
    own = gru.Trainer(m, 0.1)
    own.learn(rng.integers(0, 12, 60), np.array([0, 20, 60]))
    assert np.isfinite(own.model.vector()).all()
