"""Near-duplicates, decontamination and nearest neighbours against brute force."""


import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, components, decontaminate, near_dup, oracles
from millrace.llm.scratch import Scratch


def words(text, odd):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if odd(c) else c for c in low).split(" ") if w]


def spaced(text):
    return words(text, lambda c: c in " \t\n\v\f\r")


def lettered(text):
    return words(text, lambda c: ord(c) < 128 and not c.isalnum())


def family(seed, size, changes, length=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def brute_components(docs):
    sets, parent = {}, {}
    for i, text in docs:
        w = spaced(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    texts = []
    for s in range(12):
        texts += family(s, 14, 3)
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [passage + " " + " ".join(f"q{n}-{i}" for i in range(n % 14)) for n in range(30)]
    texts += ["", None, " \n", "one two", "One  TWO", "one two three four five", "É É É É É", "é é é é é"] + ["same text again and again here"] * 9
    docs = list(enumerate(texts))
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "rep": F.lit(2), "bands": F.lit(3), "component": F.lit(4), "key": F.lit(5)})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    want = brute_components(docs)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    schema = "doc_id long, text string"
    assert near_dup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    t = "a b c d e f g"
    got = near_dup.near_duplicates(spark.createDataFrame([(None, t), (3, t), (3, t), (None, None), (4, None)], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, False), (-1, 3, False), (3, 3, True), (3, 3, True), (4, 4, True)]


def test_near_duplicates_of_a_very_long_text(spark):
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(400_000))
    cut = long[: long.rindex(" ", 0, int(len(long) * 0.9))]
    got = near_dup.near_duplicates(spark.createDataFrame([(1, long), (2, cut), (3, long[: len(long) // 2])], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    same = (near_dup.signature(a) == near_dup.signature(b)).mean()
    assert abs(same - 1500 / 2500) < 0.15
    assert (near_dup.signature(a) == near_dup.signature(a[::-1].copy())).all()


def test_components_of_chains_loops_and_nothing(spark):
    chain = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40), (None, 3)]
    got = components.connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.component for r in got.collect()} == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def brute_contamination(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = lettered(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else []:
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = lettered(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    ids |= wins[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(str(i) for i in ids if i is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(30)] + ["the"] * 30
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 13, 14, 40])))) for i in range(25)]
    items += [(100, None), (101, "..."), (102, items[3][1]), (None, items[4][1]), (103, "A-b")]
    docs = []
    for d in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        source = lettered(rng.choice(items[:25])[1])
        at, cut = rng.randrange(len(own) + 1), rng.randrange(len(source) + 1)
        docs.append((d, " ".join(own[:at] + source[cut:] + own[at:]).upper() if d % 2 else ", ".join(own[:at] + source + own[at:])))
    docs += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (None, items[3][1]), (204, "é a!b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("w", "n_words", "contaminated", "key", "item_id", "c", "row")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.contamination(df, bench).collect()), key=str)
    assert got == brute_contamination(docs, items)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not r[-1] for r in got)


def test_contamination_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, none).collect()] == [(2, 0, False)]
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_proximity_matches_are_told_apart(spark):
    item = " ".join(f"z{i}" for i in range(13))
    moved = item.replace("z6", "z6 oops")
    docs = spark.createDataFrame([(1, item), (2, moved), (3, "z0 and z12")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.contamination(docs, bench).collect()}
    assert got[1] == (13, 0) and got[2][0] == 0 and got[3] == (0, 0)


@pytest.mark.parametrize("name", ["op2_near_dup", "op7_decontaminate"])
def test_queries_equal_oracles(name, same_rows):
    from millrace.llm import queries

    assert same_rows(queries.queries()[name], {"op2_near_dup": oracles.NEAR_DUP, "op7_decontaminate": oracles.DECONTAMINATE}[name]) > 0


def test_searched_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[1000:1600] = x[1000]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(10_000, None), (10_020, [0.0] * 16), (10_040, [float("nan")] + [1.0] * 15), (10_060, [float("inf")] + [1.0] * 15), (10_080, [None] + [1.0] * 15), (None, [1.0] * 16), (10_100, [1.0] * 3)]
    df = spark.createDataFrame(rows + odd + rows[:40], "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "leaf": F.lit(2), "score": F.lit(3)})
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 3000, 20))
    found = 0
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        listed = [ranks[k] for k in range(1, 21)]
        assert listed == sorted(listed, key=lambda t: (-t[1], t[0])) and q not in {v for v, _ in listed}
        for v, s in listed:
            assert s == pytest.approx(float(x[q] @ x[v]), abs=1e-9)
        score = x @ x[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -np.round(score, 9)))[:20]
        found += len({v for v, _ in listed} & set(order.tolist()))
    assert found / (20 * len(got)) >= 0.9


def test_neighbours_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(few.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(few, F.lit(False)).count() == 0


def test_kinds_that_reach_are_those_that_can_be_similar(spark):
    rows = [(s, n, f) for s in (1, 2) for n in range(1, 30) for f in range(1, n + 1) if s == 1 or n % 7 == f % 7]
    got = {tuple(r) for r in near_dup._kinds_that_reach(spark.createDataFrame([(*r, 9) for r in rows], "s long, n long, f long, part long"), 75).collect()}
    want = set()
    for s, n, f in rows:
        for t, m, g in rows:
            if s == t and 100 * m >= 75 * n and 100 * n >= 75 * m and 175 * f >= 75 * (n + m) and 175 * g >= 75 * (n + m):
                want.add((s, n, f, m, g))
    assert got == want


def test_a_family_without_links_is_not_paired(spark, monkeypatch):
    """Seven words in common and one of each text's own: all meet behind one shingle, none can be similar."""
    seen = []
    plain = near_dup._kinds_that_reach
    monkeypatch.setattr(near_dup, "_kinds_that_reach", lambda several, percent: seen.append(several.count()) or plain(several, percent))
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('seven fixed words stand here before own w', id) AS text")
    rows = near_dup.near_duplicates(docs)
    assert rows.where("kept").count() == 3000 and seen[0] >= 3000


def test_second_links_join_components(spark):
    """A chain of families: what the pivots leave apart is joined through their components."""
    scratch = Scratch(spark, "t")
    parts = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (7, 5), (20, 20), (21, 20)], "node long, component long")
    more = spark.createDataFrame([(7, 2), (21, 30), (40, 41)], "a long, b long")
    got = {r.node: r.component for r in near_dup._joined_parts(parts, more, scratch).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 7: 1, 20: 20, 21: 20, 30: 20, 40: 40, 41: 40}
