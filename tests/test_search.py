"""The term index against scans, the stemmer on its word list, and headline fragments."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

from millrace.functions import stems
from millrace.operators import search as S
from millrace.operators import term_index as T
from millrace.plans.search import pages

#: Forms that share a stem, and words that must not lose an ending.
FAMILIES = """index indexes indexed indexing
query queries
run runs running
connect connected connecting connects
replicate replicates replicated replication replicating
optimize optimizes optimized optimization
happy happily happiness
stop stopped stopping
class classes
table tables
agree agreed agrees
relation relational relations
quick quickly
need needed needs
commit commits committed committing commitment
release releases released releasing""".splitlines()
ALONE = "status analysis string ring red this sing bed us x is being".split()


def test_stems_of_families_agree():
    assert [len({stems.stem(w) for w in f.split()}) for f in FAMILIES] == [1] * len(FAMILIES)
    assert len({stems.stem(f.split()[0]) for f in FAMILIES}) == len(FAMILIES)
    assert [stems.stem(w) for w in ALONE[:-1]] == ALONE[:-1] and stems.stem("") == ""


def test_texts_and_queries_are_stemmed_alike(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    listed = [w for f in FAMILIES for w in f.split()] + ALONE
    words = docs.select(F.explode(S.words(F.col("text"))).alias("w")).union(spark.createDataFrame([(w,) for w in listed], "w string")).distinct()
    rows = words.select("w", F.element_at(stems.stems(F.array("w")), 1).alias("s")).collect()
    assert len(rows) > 5000
    assert [r.s for r in rows] == [stems.stem(r.w) for r in rows]
    assert all(stems.always_in(r.s) in r.w for r in rows)


def test_synonyms_and_stop_words_come_before_the_stemmer(spark):
    config = S.Config({"pgs": "postings"}, stemmed=True)
    assert config.terms("The PGS is querying this") == ["postings", "query"[:-1] + "i"]
    row = spark.createDataFrame([("This PGS queries is postings",)], "t string").select(config.words(F.col("t")).alias("w")).first()
    assert row.w == ["this", "postings", "queri", "is", "post"]


@pytest.fixture(scope="module")
def corpus(spark, sf_dir, tmp_path_factory):
    given = pages(spark, sf_dir).cache()
    index = T.TermIndex(spark, str(tmp_path_factory.mktemp("terms")), buckets=16)
    index.add(given.select("doc_id", "text"), 0)
    return given, index


TERMS = [["with"], ["with", "from"], ["the", "and", "was"], ["that", "that's"], ["nosuchword", "the"], ["die", "und"]]


@pytest.mark.parametrize("terms", TERMS)
def test_index_gives_what_a_scan_gives(corpus, terms):
    given, index = corpus
    options = S.Search(terms, per_page=1000)
    assert [tuple(r) for r in index.search(given.drop("text"), options).collect()] == [tuple(r) for r in S.search(given, options).collect()]


@pytest.mark.parametrize("terms", TERMS)
def test_bounds_are_never_below_ranks(corpus, terms):
    _, index = corpus
    able = index.candidates(terms)
    both = index.ranks(terms, able).join(able, "doc_id").collect()
    assert len(both) == able.count()
    assert all(r["rank"] <= r["most"] + 1e-6 for r in both)


def test_a_search_stops_at_its_floor(corpus, monkeypatch):
    """With few hits asked for, pages under the floor are not ranked, and the hits are the same."""
    given, index = corpus
    monkeypatch.setattr(S, "HIT_CAP", 5)
    asked = []
    plain = T.TermIndex.ranks
    monkeypatch.setattr(T.TermIndex, "ranks", lambda self, terms, chosen: asked.append(chosen.count()) or plain(self, terms, chosen))
    options = S.Search(["the"], per_page=5)
    got = index.search(given.drop("text"), options).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in S.search(given, options).collect()]
    assert len(got) == 5 and max(asked) < index.candidates(["the"]).count() / 2


def test_a_search_reads_only_its_terms_folders(spark, corpus, tmp_path):
    """The answer is the same where the folders of all other terms are gone."""
    given, index = corpus
    here = {f"bucket={T.bucket_of(t, 16)}" for t in ("with", "from")}
    left = lambda folder, names: [n for n in names if n.startswith("bucket=") and n not in here]
    shutil.copytree(index.path, tmp_path / "part", ignore=left)
    options = S.Search(["with", "from"], per_page=1000)
    part = T.TermIndex(spark, str(tmp_path / "part"), buckets=16)
    assert [tuple(r) for r in part.search(given.drop("text"), options).collect()] == [tuple(r) for r in S.search(given, options).collect()]
    plan = index.postings(["with", "from"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert "at:array" not in index.candidates(["with", "from"])._jdf.queryExecution().executedPlan().toString()


def test_changes_and_merges_keep_the_index_right(spark, corpus, tmp_path):
    given, _ = corpus
    docs = given.select("doc_id", "text")
    index = T.TermIndex(spark, str(tmp_path / "a"), buckets=8)
    index.add(docs.withColumn("text", F.concat(F.lit("the old "), "text")), 0)
    index.add(docs.where("doc_id % 2 = 0").withColumn("text", F.lit("the the")), 1)
    gone = docs.where("doc_id % 7 = 0").select("doc_id", F.lit(None).cast("string").alias("text"))
    index.add(docs.where("doc_id % 7 > 0").union(gone), 2)
    now = docs.where("doc_id % 7 > 0")
    for terms in (["the"], ["with", "from"], ["old", "the"]):
        want = {tuple(r) for r in S.cover_ranks(now, terms).collect()}
        for one in (index, index.merged(str(tmp_path / terms[0] / "b"))):
            assert {tuple(r) for r in one.ranks(terms, docs).collect()} == want
    merged = T.TermIndex(spark, str(tmp_path / "the" / "b"), buckets=8)
    assert [r.generation for r in merged._read("postings").select("generation").distinct().collect()] == [0]
    assert merged.rarest_first(["the"])[0][0] < index.rarest_first(["the"])[0][0]


def test_index_of_nothing(spark, tmp_path):
    index = T.TermIndex(spark, str(tmp_path / "none"), buckets=4)
    index.add(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), 0)
    none = spark.createDataFrame([], "doc_id long, relprio double, site string, internal boolean, url string")
    assert index.search(none, S.Search(["a"])).count() == 0 and index.search(none, S.Search([])).count() == 0


# -- fragments

def fragments(text, terms, around, most):
    tokens = re.split(r"\s+", text)
    words = [(i, w) for i, t in enumerate(tokens) for w in re.split(r"[\W_]+", t.lower()) if w]
    spans = set()
    for a in range(len(words)):
        for b in range(a, len(words)):
            inside = [w for _, w in words[a : b + 1]]
            if set(terms) <= set(inside) and inside[0] in terms and inside[-1] in terms and inside.count(inside[0]) == 1 and inside.count(inside[-1]) == 1:
                spans.add((b - a, words[a][0], words[b][0]))
                break
    kept = []
    for s in sorted(spans):
        if len(kept) < most and all(s[1] > k[2] + around or s[2] < k[1] - around for k in kept):
            kept.append(s)
    mark = lambda t: f"[[{t}]]" if set(re.split(r"[\W_]+", t.lower())) & set(terms) else t
    return " … ".join(" ".join(map(mark, tokens[max(a - around, 0) : b + around + 1])) for _, a, b in sorted(kept, key=lambda k: k[1]))


@pytest.mark.parametrize(("terms", "around", "most"), [(["a"], 1, 3), (["a", "b"], 0, 2), (["a", "b", "c"], 2, 5)])
def test_fragments_equal_brute_force(spark, terms, around, most):
    import random

    rng = random.Random(3)
    pool = ["a", "b,", "C", "x", "y.", "z-a", "--", "w", "v", "u", "t"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, "a b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.snippet for r in S.snippets(df.select("doc_id"), df, terms, around=around, most=most).collect()}
    assert got == {i: fragments(t or "", terms, around, most) for i, t in enumerate(texts)}


def test_words_become_terms_alike_in_texts_and_one_by_one(spark):
    from millrace.plans.search import CONFIG, STEMMED

    text = "The running runners ran, thes der das Ering re@x.org 1.5 http://a.b/c caresses ponies was flies été"
    df = spark.createDataFrame([(text,)], "text string")
    for config in (CONFIG, STEMMED):
        plain, whole = df.select(config.plain(F.col("text")), config.words(F.col("text"))).first()
        assert [config.term_of(w) for w in plain] == whole
