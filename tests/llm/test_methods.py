"""Details of the operators' methods: what they learn from, how they grow, odd inputs."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import ann, bpe, decontaminate, html_text, lm_score, near_dup, packing, pii, quality, textvec
from millrace.llm.scratch import Scratch
from millrace.sources import shared

TEXT = "doc_id long, text string"
PAGES = "page_id long, url string, html string"


# -- the shared folder

class _Session:
    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})()


def test_shared_folder_is_the_named_one_or_local_only():
    assert shared.shared_dir(_Session("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    assert shared.shared_dir(_Session("local[2]")).startswith("file:///")
    with pytest.raises(RuntimeError):
        shared.shared_dir(_Session("spark://x"))


# -- quality

def test_quality_scores_equal_plain_sums(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("alpha Beta gamma 12 delta, eta".split()) for _ in range(rng.randrange(3, 30))) + (" ||" if i % 2 else ".")) for i in range(150)]
    df, labels = spark.createDataFrame(docs, TEXT), spark.createDataFrame([(d, d % 2) for d, _ in docs], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = {r.doc_id: r.score for r in quality.quality_scores(df, labels).collect()}
    for d, t in docs:
        (_, _, _, own), = list(quality.indicators(pa.array([t])))
        own = sorted(set(own.tolist()))
        norm = sum(model.square[b] for b in own) ** 0.5 or 1.0
        margin = sum(model.weight[b] for b in own) / norm + model.bias
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))), abs=1e-9)


def test_log_count_ratios_equal_counting():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(40)]
    y = np.array([1 if i % 3 else -1 for i in range(40)])
    up, down = (Counter(b for r, t in zip(rows, y, strict=True) if t == s for b in r.tolist()) for s in (1, -1))
    ratio = quality.log_count_ratios(rows, y)
    total = [sum(c.values()) + quality.BUCKETS for c in (up, down)]
    for b in range(30):
        want = np.log((up[b] + 1) / total[0]) - np.log((down[b] + 1) / total[1]) if up[b] + down[b] >= quality.MIN_TEXTS else 0.0
        assert ratio[b] == pytest.approx(want)


def test_repeated_ids_count_as_one_training_text(spark, monkeypatch):
    docs = [(i, f"word{i % 2} " * 9) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, y, share: seen.append(len(rows)) or quality.Model(np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS), 0.0, 1.0, 0.0))
    for rows in (docs, docs + docs[:1] * 50):
        quality.train(spark.createDataFrame(rows, TEXT), labels)
    assert seen[0] == seen[1] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))


# -- personal data

def test_long_runs_of_digits_are_no_addresses(spark):
    text = "x " + "0" * 5000 + "1.2.3.4 and " + "9" * 6000 + ".1.1.1 " + "1." * 5000
    df = spark.createDataFrame([(1, text), (2, "from 010.0.00255.1 on")], TEXT)
    got = {r.doc_id: r for r in pii.find_spans(df).collect()}
    assert [(s.kind, s.start, s.stop) for s in got[1].base][0] == (1, 2, 5009)
    assert [(s.kind, s.start, s.stop) for s in got[2].base] == [(1, 5, 18)]
    assert "[ip]" in {r.doc_id: r.text for r in pii.masked(df).collect()}[2]


def pairwise_loose(text, base):
    taken, out = [(a, b) for _, a, b in base], []
    patterns = ((0, pii._SPELLED), (1, pii._SPACED_IP), (2, pii._SPACED_CARD), (2, pii._CARD), (2, pii._PLAIN_CARD), (3, pii._PHONE), (3, pii._LOCAL_PHONE))
    for kind, pattern in patterns:
        for m in pattern.finditer(text):
            a, b = m.span()
            if pattern is pii._CARD and not 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                continue
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((kind, a, b))
    return out


BITS = ["bo [at] ex [dot] com", "jo@ex.com", "1.2.3.4", "1 . 2 . 3 . 4", "4111 1111 1111 1111", "4111-1111-1111-1112", "555-123-4567", "+1 (555) 123-4567", "call", "card", " ", " ", "\n", "12", "é"]


def test_loose_spans_equal_pairwise_comparison():
    rng = random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))
        base = pii.base_spans(t)
        assert pii.loose_spans(t, base) == pairwise_loose(t, base), t
    many = "call 555-123-4567 now " * 20_000
    began = time.perf_counter()
    assert len(pii.loose_spans(many, pii.base_spans(many))) == 20_000
    assert time.perf_counter() - began < 5


def test_spans_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(BITS) for _ in range(rng.randrange(10))) for _ in range(300)]
    counts, found = Counter(), []
    for t in texts:
        base = pii.base_spans(t)
        loose = [(s, pii.pattern_id(s[0], *pii.votes(t, *s, False))) for s in pairwise_loose(t, base)]
        counts.update([pii.pattern_id(s[0], *pii.votes(t, *s, True)) for s in base] + [p for _, p in loose])
        found.append((base, loose))
    ids = np.array(sorted(counts))
    n = np.array([float(counts[i]) for i in ids.tolist()])
    kind, vote, bits = pii._unpack(ids)
    p, _ = pii.estimate_reliabilities(vote, n)
    kept = set(ids[pii.train_classifier(kind, vote, bits, p, n) >= 0].tolist())
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), TEXT).repartition(5)).collect()}
    for i, (base, loose) in enumerate(found):
        want = sorted(base + [s for s, q in loose if q in kept])
        assert [(s.kind, s.start, s.stop) for s in got[i].spans] == want
        assert [(s.kind, s.start, s.stop) for s in got[i].base] == sorted(base)


# -- language model

def test_every_training_text_is_learned_from_once(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 40)))) for i in range(500)]
    df = spark.createDataFrame(docs, TEXT).repartition(3)
    learned = df.where(lm_score.in_training(F.col("doc_id")))
    scratch = Scratch(spark, "t")
    counts = scratch.save(lm_score.token_counts(learned, scratch))
    n = counts.agg(F.sum("c")).first()[0]
    model, texts = lm_score.fit(learned, lm_score.hot_counts(counts, n), scratch)
    assert texts == sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(500))
    assert np.isfinite(model.vector()).all()


def test_slices_of_bounded_size_cover_a_batch(monkeypatch):
    monkeypatch.setattr(lm_score, "RUN_BYTES", 50)
    texts = ["a" * n for n in (10, 0, 200, 30, 30, 5)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert [t for s in lm_score.runs([b]) for t in s.column("text").to_pylist()] == texts


# -- packing

def test_stretches_that_share_a_hash_keep_their_ids(monkeypatch):
    own = packing.Encoder(bpe.default_path())
    hashed = textvec.span_hash
    monkeypatch.setattr(textvec, "span_hash", lambda raw, s, e: hashed(raw, s, e) % np.uint64(7))
    texts = ["some words that will surely share a hash with others", "", "others share words", None, "x"]
    want = [e.ids + [0] for e in Tokenizer.from_file(bpe.default_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {}
    for first, ids, offsets in own.rows(pa.array(texts)):
        for i in range(len(offsets) - 1):
            got[first + i] = ids[offsets[i] : offsets[i + 1]].tolist()
    assert [got[i] for i in range(len(texts))] == want


def test_texts_without_spaces_leave_nothing_behind():
    """10000 texts of 100 characters, no two alike, none with a space: after each run the
    encoder holds no more than before, under 1 MB in all."""
    import tracemalloc

    rng = random.Random(4)
    signs = [chr(c) for c in range(0x4E00, 0x5200)]
    own, library = packing.Encoder(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    tracemalloc.start()
    held = []
    for k in range(5):
        texts = ["".join(rng.choices(signs, k=100)) for _ in range(2000)]
        for first, ids, offsets in own.rows(pa.array(texts)):
            if first == 0:
                assert ids[: offsets[1] - 1].tolist() == library.encode(texts[0], add_special_tokens=False).ids
        del texts, ids, offsets
        held.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert max(held) - held[0] < 1 << 20


# -- nearest neighbours

def test_leaves_stay_small_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 8)) + 6 * rng.normal(size=(20, 8))[rng.integers(0, 20, 6000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scratch = Scratch(spark, "t")
    tree, placed, filled = ann.index(scratch.save(ann.usable(df)), scratch)
    assert sum(filled.values()) == 6000 and max(filled.values()) <= 40
    assert {r.leaf for r in placed.select("leaf").distinct().collect()} <= set(tree.leaves())
    want = tree.assign(x)
    assert all(want[r.vec_id] == r.leaf for r in placed.select("vec_id", "leaf").collect())
    assert sorted(tree.best_bins(x[0])) == sorted(tree.leaves())


def test_equal_vectors_and_odd_lengths(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [1.0, 2.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 400, 20))
    for q, near in got.items():
        score = np.round(x @ x[q], 9)
        order = [int(i) for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        assert [v for _, v in sorted(near)] == order


# -- page texts

def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_template_takes_shared_notices_out_of_articles(spark):
    story = lambda i: f"<p>Story {i} tells of {i * 7} things</p><p>It ends after {i} more, and nobody knows why</p>"
    rows = [(i, f"http://h.org/{i}", f"<article><h1>Head {i}</h1>{story(i)}<p>Subscribe to hear more of us</p></article>") for i in range(12)]
    rows += [(100, "http://other.org/", "<article><h1>Head</h1><p>Subscribe to hear more of us</p></article>")]
    got = texts_of(spark, rows)
    assert got[3] == "Head 3\nStory 3 tells of 21 things\nIt ends after 3 more, and nobody knows why"
    assert got[100] == "Head\nSubscribe to hear more of us"


def test_copies_of_a_page_are_no_template(spark):
    paragraphs = [f"<p>Paragraph {i} of the one story that many mirrors carry</p>" for i in range(6)]
    rows = [(i, f"http://h.org/{i}", f"<nav>{i}</nav><article>{''.join(paragraphs)}</article>") for i in range(12)]
    near = lambda i: "".join(paragraphs[:5]) + f"<p>The end number {i}</p>"
    rows += [(100 + i, f"http://n.org/{i}", f"<div>{near(i)}</div>") for i in range(9)] + [(200, "http://alone.org/", "<p>once</p>")] * 3
    got = texts_of(spark, rows)
    assert {got[i].count("\n") for i in range(12)} == {5} and {got[100 + i].count("\n") for i in range(9)} == {5} and got[200] == "once"


def test_wrappers_headlines_and_odd_quotes_keep_their_text(spark):
    rows = [
        (1, "http://a/1", "<div class='layout has-sidebar'><article><p>kept</p></article><div class=sidebar>gone</div></div>"),
        (2, "http://b/2", "<article><div class='entry-header'><h1>Head</h1></div><figure><figcaption>Shown</figcaption></figure><p>body</p></article>"),
        (3, "http://c/3", "<p title=it's>Hello</p><p>next</p><p title=\"a>b\">last</p>"),
        (4, "http://d/4", "<div class=header><article><p>in</p></article></div><div id=comments><article>Nice</article></div>"),
        (5, "http://e/5", "<div class='site-header'>gone</div><div class='ad-box'>gone</div><p>stays</p>"),
    ]
    assert texts_of(spark, rows) == {1: "kept", 2: "Head\nShown\nbody", 3: "Hello\nnext\nlast", 4: "in", 5: "stays"}


@pytest.mark.parametrize("part", ["<p ", "<p a='", "<p a=\">\" ", "<!", "<!-- ", "<script>", "<", "</", "<p a=b c", "<div><p>", "</div>"])
def test_markup_is_read_in_linear_time(part):
    began = time.perf_counter()
    html_text.parse(part * 60_000)
    assert time.perf_counter() - began < 10


def test_classes_equal_brute_force(spark):
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(6)]
    rows = []
    for i in range(40):
        own = [x for x in lines if rng.random() < 0.6] + [f"own {i}"]
        rows.append((i, f"http://h{i % 2}.org/", "".join(f"<p>{x}</p>" * rng.choice([1, 1, 2]) for x in own)))
    df = spark.createDataFrame(rows + rows[:7], PAGES).select(F.regexp_extract("url", "h([0-9])", 1).cast("long").alias("host"), F.xxhash64("page_id").alias("page"), "html")
    seen = html_text.occurrences(html_text.contents(df)).collect()
    vectors, by_hash = {}, {}
    for i, url, source in {r[2]: r for r in rows}.values():
        for t, (n, *_) in html_text.page_tokens(html_text.parse(source)).items():
            vectors.setdefault((i % 2, t), {})[source] = n
    assert {(r.host, r.token): r.pages for r in seen} == {k: len(v) for k, v in vectors.items()}
    for r in seen:
        by_hash.setdefault((r.host, r.va, r.vb), set()).add(r.token)
    plain = {}
    for (host, t), v in vectors.items():
        plain.setdefault((host, frozenset(v.items())), set()).add(t)
    assert sorted(map(sorted, by_hash.values())) == sorted(map(sorted, plain.values()))


def test_classes_that_cross_are_invalid():
    assert html_text.nested({"a": 1, "b": 2, "c": 3, "d": 4}, {"a": (0, 9), "b": (1, 4), "c": (3, 6), "d": (7, 8)}) == {"a": 0, "b": 1, "d": 1}


# -- near-duplicates and decontamination

def test_parts_are_paired_before_members(spark):
    """A family in one part and one outlier behind the same rare shingle."""
    rest = spark.createDataFrame([(i, 20, 0) for i in range(60)] + [(100, 20, 100), (101, 200, 101)], "rep long, n long, part long")
    own = lambda i: [1, 2, 3, *range(1000 * i, 1000 * i + (197 if i == 101 else 17))]
    sets = spark.createDataFrame([(r.rep, own(r.rep)) for r in rest.collect()], "doc_id long, shingles array<long>")
    got = {(r.x, r.y) for r in near_dup._sharing_rare_shingles(rest, sets, 8, Scratch(spark, "t")).collect()}
    assert {(min(p), max(p)) for p in got} == {(i, 100) for i in range(60)}


def test_rows_without_id_are_judged_one_by_one(spark):
    item = " ".join(f"z{i}" for i in range(13))
    docs = [(None, item), (None, "clean words"), (None, None), (7, item), (7, "other words here"), (7, item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame(docs, TEXT).withColumn("bad_doc", F.lit("x")).withColumn("doc", F.lit(1))
    got = decontaminate.contamination(df, bench).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.contaminated) for r in got) == [(0, 0, False), (0, 0, False), (0, 13, True), (7, 0, False), (7, 13, True), (7, 13, True)]
    kept = decontaminate.clean(df, bench)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "clean words"), (7, "other words here")] and kept.columns == df.columns


def test_hot_words_are_found_as_by_bisection():
    rng = np.random.default_rng(2)
    none = np.zeros(0)
    for n in (0, 1, 2, 5, 1000, 20000):
        keys = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        if n > 4:
            keys[:3], keys[-1] = (0, 1, 2), (1 << 64) - 1
        own = lm_score.Counts(keys, none, none, 1, none, none)
        tokens = np.concatenate([keys, rng.integers(0, 1 << 64, 5000, dtype=np.uint64), keys + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        place, hot = own.find(tokens)
        assert (hot == np.isin(tokens, keys)).all()
        assert n == 0 or (keys[place[hot]] == tokens[hot]).all() and place.max() < n
