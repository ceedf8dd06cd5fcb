"""Operators on small hand-made rows: nulls, ties, empty inputs and boundaries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import security, texts, versions
from millrace.operators import crawl, merge, queues, relational, search, sequences
from millrace.sources import files, members, sinks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_cover_rank_counts_minimal_stretches(spark):
    docs = spark.createDataFrame([(1, "a x b\nb a"), (2, "a only"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r["rank"] for r in search.cover_ranks(docs, ["a", "b"]).collect()}
    assert set(got) == {1}
    # a x b: both places in the title, two words apart; then b|b a is passed for the nearer b a
    assert got[1] == pytest.approx(1.0 / 3 + 0.1 / 2, abs=1e-5)


def test_search_without_terms_is_empty(spark):
    docs = spark.createDataFrame([(1, "a", 1.0, "s", False, "/a")], "doc_id long, text string, relprio double, site string, internal boolean, url string")
    assert search.search(docs, search.Search([])).count() == 0


def test_query_parsing():
    assert search.parse_query("The Foo, foo bar", {"bar": "baz"}, frozenset({"the"})) == ["foo", "baz"]


def test_configured_search_knows_spellings(spark):
    config = search.Config({"pgx": "px", "postx": "px"})
    assert config.terms("The PGX of 1.5 a@b.org postx") == ["px"] and config.spellings("px") == ["px", "pgx", "postx"]
    docs = spark.createDataFrame([(1, "PostX"), (2, "x\npx"), (3, "http://px.org a@pgx.org"), (4, None), (5, "")], "doc_id long, text string")
    assert rows(search.cover_ranks(docs, ["px"], config=config)) == [(1, 1.0), (2, 0.1)]


def test_carried_forward_state(spark):
    df = spark.createDataFrame([("f", 1, None), ("f", 2, "Yes"), ("f", 3, None), ("f", 4, "Obsolete"), ("g", 1, None)], "k string, v int, s string")
    assert rows(sequences.carried_forward(df, "k", ["v"], "s"), "k", "v", "carried") == [("f", 1, "no"), ("f", 2, "yes"), ("f", 3, "yes"), ("f", 4, "obs"), ("g", 1, "no")]


def test_walk_waits_for_the_next_named_version(spark):
    names = {"f": [("9", "Yes"), ("10", "Obsolete")], "g": [("8", "Yes"), ("10", "No")], "h": [("11", "Yes"), ("9", "No")], "i": [(None, "Yes")], "j": [("10", None)]}
    spec = spark.createDataFrame([(k, n, v, s) for k, vs in names.items() for n, (v, s) in enumerate(vs)], "k string, o int, v string, s string")
    shown = ["9", "10", "11"]

    def walk(named):
        now, left, out = "No", list(named), []
        for v in shown:
            if left and left[0][0] == v:
                now = left.pop(0)[1] or "No"
            out.append(now.lower()[:3])
        return out

    got = rows(sequences.walked(spec, "k", "o", "v", "s", shown))
    assert got == sorted((k, v, c) for k, named in names.items() for v, c in zip(shown, walk(named), strict=True))
    assert sequences.walked(spec.limit(0), "k", "o", "v", "s", shown).count() == 0 == sequences.walked(spec, "k", "o", "v", "s", []).count()
    with pytest.raises(ValueError):
        sequences.walked(spec, "k", "o", "v", "s", ["9", "9"])


def test_decay_and_age(spark):
    one = spark.range(1)
    got = one.select(*[sequences.decayed_priority(F.lit(r)).alias(str(r)) for r in (1, 2, 7, 9)]).first()
    assert list(got) == [0.7, 0.6, 0.1, 0.1]
    ages = one.select(*[sequences.age_score(F.lit(d).cast("date"), F.lit("2024-01-01").cast("date")).alias(d) for d in ("2024-01-01", "2010-01-01", "2024-12-31")]).first()
    assert ages[0] == 0.5 and ages[1] == pytest.approx(0.1) and ages[2] == pytest.approx(0.6)


def test_stagger_is_not_moved_to_now(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, 1), ("a", t, 2), ("a", t + timedelta(days=3), 3)], "k string, t timestamp_ntz, i int")
    assert [r[0] for r in rows(sequences.staggered(df, "k", "t", "i"), "sendat")] == [t + timedelta(minutes=30 * n) for n in (1, 2, 3)]


def test_keyset_page_repeats_the_border(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate([5, 5, 4, 3])], "id int, d int")
    first = relational.keyset_page(df, "d", "id", 2)
    assert rows(first, "id", "next") == [(0, 5), (1, 5)]
    assert rows(relational.keyset_page(df, "d", "id", 10), "next") == [(None,)] * 4
    assert 1 in {r.id for r in relational.keyset_page(df, "d", "id", 2, start=5).collect()}


def test_fill_up_and_composed(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i int")
    assert rows(relational.fill_up(df.where("i = 9"), df, 3, F.col("i"))) == [(0,), (1,), (9,)]
    with pytest.raises(ValueError):
        relational.composed({}, {"s": lambda v: v})
    with pytest.raises(ValueError):
        relational.flag_columns(df, {"region": "moon"}, {"region": ["west"]})


def test_merge_classes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (5, "e")], "k int, v string")
    changes, snapshot = merge.merge(old, new, ["k"], ["v"])
    assert rows(changes) == [(2, "U"), (4, "D"), (5, "I")]
    assert {r.k: r.v for r in snapshot.collect()} == {1: "a", 2: "B", 3: None, 5: "e"}
    assert (3, "U") in rows(merge.merge(old, new, ["k"], ["v"], null_safe=True)[0])
    with pytest.raises(ValueError):
        merge.check_count(old, 5)


def test_expiry_is_strict(spark):
    now = datetime(2024, 1, 4)
    df = spark.createDataFrame([(1, now - timedelta(hours=72)), (2, now - timedelta(hours=72, seconds=1))], "i int, t timestamp_ntz")
    assert rows(merge.unexpired(df, "t", F.lit(now).cast("timestamp_ntz"), "72 HOURS"), "i") == [(1,)]


def test_limits_with_feedback():
    t = [datetime(2024, 1, 1) + timedelta(minutes=m) for m in (0, 14, 15, 16, 30, 32)]
    assert queues.decide(t, queues.lock(timedelta(minutes=15)))[0] == [True, False, False, True, False, True]
    assert queues.decide(t[:4], queues.limiter(2, timedelta(minutes=20)))[0] == [True, True, True, False]


def test_limits_hold_over_batches_and_null_keys(spark):
    t = datetime(2024, 1, 1)
    data = [(k, t + timedelta(minutes=m), i) for k in (1, None, (1 << 60) + 1) for i, m in enumerate((0, 14, 16, 30, 32))] + [(1, None, 9)]
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, i long")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        got = queues.with_feedback(df, "k", "t", "i", queues.lock(timedelta(minutes=15))).collect()
        acts = df.where("t IS NOT NULL").select("k", "i", F.expr("CASE WHEN i = 0 THEN 'submit' ELSE 'approve' END").alias("action"), F.col("i").alias("who"), F.lit(True).alias("two"))
        states = queues.moderated(acts, "k", ["i"]).collect()
    finally:
        spark.conf.set(size, before)
    for k in (1, None, (1 << 60) + 1):
        assert [r.ok for r in sorted((r for r in got if r.k == k and r.t), key=lambda r: r.i)] == [True, False, True, False, True]
    assert [r.ok for r in got if r.t is None] == [None]
    assert {(r.k, r.modstate, r.first) for r in states} == {(k, 2, 1) for k in (1, None, (1 << 60) + 1)} and len(states) == 3


def test_moderation_needs_two():
    state = (queues.CREATED, None)
    for action, who, want in (("submit", 1, 1), ("approve", 5, 1), ("approve", 5, 1), ("return", 2, 0), ("submit", 1, 1), ("approve", 5, 1), ("approve", 6, 2), ("reject", 6, 3), ("submit", 1, 3)):
        state = queues.moderate(*state, action, who, True)
        assert state[0] == want


def test_acknowledged_keeps_what_changed(spark):
    q = spark.createDataFrame([(1, 10), (2, 20)], "k int, at int")
    assert rows(queues.acknowledged(q, spark.createDataFrame([(1, 10), (2, 19)], "k int, at int"), ["k"], "at")) == [(2, 20)]


def test_page_parser_quirks():
    page = crawl.read_page("<head><title>T1</title> more</head><body><p>one<script>no</script> lost<p>two<a href='/x'>x</a></body>")
    assert page == ("T1more", "one\ntwo\n", ["/x"])


@pytest.mark.parametrize(
    "link,want",
    [("/a?b#c", "/a"), ("b.html", "/d/b.html"), ("#x", None), ("mailto:a@b", None), ("http://h/x?y", "/x"), ("http://other/x", None), ("?q", None)],
)
def test_links_resolve_on_their_host(link, want):
    assert crawl.resolve(link, "/d/p", "h") == want


def test_frontier_and_blocking(spark):
    links = spark.createDataFrame([("/", "/a"), ("/a", "/a/"), ("/a", "/b"), ("/b", "/x/../c"), ("/b", "/")], "src string, dst string")
    assert rows(crawl.frontier(links, ["/"], crawl.blocked(F.col("url"), ["", "/secret"], []))) == [("/", 0), ("/a", 1), ("/b", 2)]


def test_scores_and_numbers(spark):
    df = spark.createDataFrame([("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",), ("AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N",), ("AV:L/AC:L/PR:L/UI:N/S:C/C:L/I:N/A:N",), ("bad",), (None,)], "v string")
    assert [r[0] for r in df.select(security.base_score(F.col("v"))).collect()] == [9.8, 0.0, 3.8, -1.0, -1.0]
    cves = spark.createDataFrame([("2024-1234",), ("2024-1234567",), ("x",), (None,)], "c string")
    assert [r[0] for r in cves.select(security.cve_number(F.col("c"))).collect()] == [202401234, 203634567, None, None]


def test_version_names(spark):
    df = spark.createDataFrame([("9.6", 2, 0), ("10.0", 1, 0), ("18.0", 1, 2)], "t string, m int, s int").withColumn("t", F.col("t").cast("decimal(3,1)"))
    assert [r[0] for r in df.select(versions.text(F.col("t"), F.col("m"), F.col("s"))).collect()] == ["9.6.2", "10.1", "18beta1"]
    names = spark.createDataFrame([("v9.6.2",), ("v10.1",), ("v18",), ("misc",)], "n string")
    assert [r[0] for r in names.select(versions.sort_key(F.col("n"))).collect()] == ["90602", "a1001", "a180", "misc"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Jo: a: b",), ("全角： b",), ("none",)], "t string")
    author, title = texts.split_title(F.col("t"))
    assert [tuple(r) for r in df.select(author, title).collect()] == [("Jo", "a: b"), ("全角", "b"), ("", "none")]
    one = spark.createDataFrame([("Héllo, Wörld!", "a\nb", "a\nc", "x #tag https://e.org/é")], "a string, b string, c string, d string")
    r = one.select(texts.slugify("a"), texts.changed_lines("b", "c"), texts.facets("d"), texts.plain_markdown("a")).first()
    assert r[0] == "hello-world" and r[1] == " a\n-b\n+c" and r[3] == "<p>Héllo, Wörld!</p>"
    assert [(f.kind, f.start, f.stop) for f in r[2]] == [("link", 7, 23), ("tag", 2, 6)]


def test_feeds_and_sitemaps_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("/a", 0.5, datetime(2024, 1, 2), False), ("/b", None, None, True)], "url string, priority double, lastmod timestamp, internal boolean")
    sinks.write_sitemaps(entries, str(tmp_path / "pub"), str(tmp_path / "all"))
    assert rows(files.sitemap_entries(spark, str(tmp_path / "all")), "url", "priority") == [("/a", 0.5), ("/b", 0.0)]
    assert rows(files.sitemap_entries(spark, str(tmp_path / "pub")), "url") == [("/a",)]
    items = spark.createDataFrame([(f"t{i}" * 60, f"/{i}", datetime(2024, 1, 1 + i)) for i in range(12)], "title string, url string, posttime timestamp")
    sinks.write_feed(items, str(tmp_path / "feed"))
    back = files.feed_items(spark, str(tmp_path / "feed"), "f")
    assert back.count() == 10 and max(len(r.title) for r in back.collect()) <= 100
    assert files.new_items(back, back.where("url = '/11'")).count() == 9


def test_robots_rules(spark, tmp_path):
    (tmp_path / "robots.txt").write_text("User-agent: other\nDisallow: /no\nUser-agent: *\nDisallow: /a\nDisallow: \nUser-agent: mybot\nDisallow: /b\n")
    assert rows(files.robots_rules(spark, str(tmp_path / "robots.txt"), "mybot"), "prefix") == [("/a",), ("/b",)]


def test_document_folders_and_archives(spark, tmp_path):
    import tarfile

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.html").write_bytes("<html><title>Ä</title>".encode("latin-1"))
    (tmp_path / "docs" / "b.html").write_bytes('<?xml version="1.0"?><title>Ä</title>'.encode())
    (tmp_path / "docs" / "c.svg").write_bytes("<svg>Ä</svg>".encode())
    got = rows(files.doc_pages(spark, str(tmp_path / "docs"), "9.6"), "file", "title")
    assert got == [("a.html", "Ä"), ("b.html", "Ä"), ("c.svg", "")]
    with tarfile.open(tmp_path / "in.tar.gz", "w:gz") as t:
        t.add(tmp_path / "docs" / "a.html", "x/a.html")
    with tarfile.open(tmp_path / "out.tar", "w") as t:
        t.add(tmp_path / "in.tar.gz", "in.tar.gz")
    assert rows(members.archive_pages(spark, str(tmp_path / "out.tar")).select("name"), "name") == [("x/a.html",)]
    assert rows(files.file_tree(spark, str(tmp_path / "docs")), "name") == [("a.html",), ("b.html",), ("c.svg",)]


def test_listings_and_scripts(spark, tmp_path):
    names = spark.createDataFrame([("redhat-9-x86_64", ["16", "17"]), ("redhat-9-aarch64", ["17"]), ("README", [])], "name string, versions array<string>")
    got = files.repository_platforms(names).collect()
    assert [(r.platform, [a.arch for a in r.arches]) for r in got] == [("redhat-9", ["aarch64", "x86_64"])]
    js = spark.createDataFrame([('var repo = {"a": [1, 2]};',)], "s string")
    assert js.select(files.json_in_script(F.col("s"), "repo", "a array<int>").alias("j")).first().j.a == [1, 2]
    (tmp_path / "f.json").write_text('[{"grp": "g", "features": [{"name": "f", "versions": {"9.6": "Yes"}}]}]')
    assert rows(files.nested_features(spark, str(tmp_path / "f.json"))) == [("g", "f", "9.6", "Yes")]
    (tmp_path / "syn").write_text("foo bar\nBaz bar\n")
    assert files.synonyms(spark, str(tmp_path / "syn")) == {"foo": "bar", "baz": "bar"}


def test_staged_and_published(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"\nc'), (2, "d")], "k int, v string")
    sinks.write_staged(df, str(tmp_path / "s"))
    assert rows(files.staged_rows(spark, str(tmp_path / "s"), "k int, v string")) == rows(df)
    assert rows(sinks.changed_only(df, df.where("k = 1"), "k"), "k") == [(2,)]
    users = spark.createDataFrame([("s", i, f"u{i}") for i in range(5)], "site string, id int, name string")
    out = sinks.push_payloads(users, "site", "id", "secret", 2)
    assert out.count() == 3 and all(len(r.signature) == 128 for r in out.collect())


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k int, t timestamp, i long")
    assert queues.with_feedback(none, "k", "t", "i", queues.lock(timedelta(1))).count() == 0
    assert sequences.neighbours(none, ["k"], [F.col("t")], "i").count() == 0
    assert relational.keyset_page(none, "i", "k", 3).count() == 0


def test_numbers_over_ranges_are_global(spark):
    from pyspark.sql import functions as F

    from millrace.operators.numbering import numbered

    rows = [(None if i % 7 == 0 else (i * 37) % 50, i, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int, place string").repartition(5)
    got = numbered(df, "n", F.desc_nulls_first("a"), F.asc("b"))
    want = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b, r.place) for r in sorted(got.collect(), key=lambda r: r.n)] == want
    assert sorted(r.n for r in got.collect()) == list(range(1, 2001))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert numbered(df.limit(0), "n", F.asc("b")).count() == 0


def test_changed_lines_keep_lines_that_look_like_marks(spark):
    from millrace.functions import texts

    df = spark.createDataFrame([("-- x\na\n@@ y\nb", "a\n++ z\n@@ y\nc"), ("same", "same"), (None, "new")], "old string, new string")
    got = [r[0] for r in df.select(texts.changed_lines("old", "new")).collect()]
    assert got == ["--- x\n a\n+++ z\n @@ y\n-b\n+c", "", "+new"]


def test_titles_by_the_places_of_tags(spark):
    from millrace.functions import texts

    cases = {"<title>a</title>": "a", "<TITLE \n>b c</Title >": "b c", "<title></title><title>d</title>": "d", "<title x=1>no</title>": "", "<titles>no</titles>": "", "<title>e<b>f</title>": "", "<title>g": "", "": "", "x > y <p>t</p><title>h > i</title>": "h > i", "<title>ünï</title>": "ünï"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "html string")
    assert {r.html: r.t for r in df.select("html", texts.page_title(df.html).alias("t")).collect()} == cases | {None: None}


def test_tags_stand_behind_white_space(spark):
    from millrace.functions import texts

    df = spark.createDataFrame([("#no a #yes_1 b#no #é #x#y\n#z https://a.b/#c é #last",)], "t string")
    got = [(f.kind, f.start, f.stop, f.value) for f in df.select(texts.facets("t").alias("f")).first().f]
    raw = "#no a #yes_1 b#no #é #x#y\n#z https://a.b/#c é #last".encode()
    assert [g[3] for g in got] == ["https://a.b/#c", "yes_1", "x", "z", "last"]
    assert all(raw[a:b].lstrip(b"#").decode() == v for _, a, b, v in got)


def test_slugs_markdown_and_samples(spark, sf_dir):
    import re
    import unicodedata

    from millrace import registry
    from millrace.functions import texts

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    slugs = {r.doc_id: r.slug for r in registry.queries()["slugify"](spark, sf_dir).collect()}
    for i, t in docs.items():
        plain = unicodedata.normalize("NFKD", t.split(".")[0]).encode("ascii", "ignore").decode().lower()
        kept = "".join(c for c in plain if c.isalnum() or c in "_- \t\n\r\f\v" or c.isspace())
        assert slugs[i] == "-".join(x for x in re.split(r"[-\s]+", kept)).strip("-_")
    md = spark.createDataFrame([("**a** *b* `c<d`\n\n[x](https://e.org/?q=1&r=2) [y](javascript:z) ![i](http://p) <script>",), (None,)], "t string")
    got = [r[0] for r in md.select(texts.plain_markdown("t")).collect()]
    assert got == ['<p><strong>a</strong> <em>b</em> <code>c&lt;d</code></p><p><a href="https://e.org/?q=1&amp;r=2">x</a> y ![i](http://p) &lt;script&gt;</p>', ""]
    sample = registry.queries()["random_sample_sorted"](spark, sf_dir).collect()
    whole = {(r.s_suppkey, r.s_nationkey) for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()}
    assert len(sample) == len(set(sample)) == min(5, len(whole)) and {tuple(r) for r in sample} <= whole
    assert [(r.s_nationkey, r.s_suppkey) for r in sample] == sorted((r.s_nationkey, r.s_suppkey) for r in sample)


def test_pages_that_share_a_url_are_fetched_for_themselves(spark):
    sitemap = spark.createDataFrame([(1, "/a", 5), (2, "/a", 1), (3, "/a", 9)], "page_id long, url string, lastmod int")
    scanned = spark.createDataFrame([(1, "/a", 4), (1, "/a", 6), (3, "/a", 7), (3, "/a", 8)], "page_id long, url string, lastscanned int")
    assert sorted(r.page_id for r in crawl.to_fetch(sitemap, scanned, key="page_id").collect()) == [2, 3]
    assert sorted(r.page_id for r in crawl.to_fetch(sitemap, scanned.where("page_id = 3")).collect()) == [3]


@pytest.fixture
def shared_urls(spark, tmp_path):
    """Pages of which many share a url."""
    p = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), F.col("id") % 4).alias("url"))
    p.write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["crawl_incremental", "delete_branch", "feed_files_new"])
def test_shared_urls_give_the_rows_of_the_sql(spark, shared_urls, name):
    assert_sql(spark, shared_urls, "pages", name)


def assert_sql(spark, folder, table, name):
    import duckdb

    from millrace import registry

    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        ran = con.execute(registry.oracle_sql()[name])
        columns = [d[0] for d in ran.description]
        want = sorted(map(repr, ran.fetchall()))
    assert sorted(repr(tuple(r)) for r in registry.queries()[name](spark, folder).select(*columns).collect()) == want


def test_long_vulnerability_numbers(spark, tmp_path):
    cves = spark.createDataFrame([("2024-12345678",), ("2024-123456789012345678",), ("2024-1234567890123456789",)], "c string")
    assert [r[0] for r in cves.select(security.cve_number(F.col("c"), digits=18)).collect()] == [202400000 + 12345678, 202400000 + 123456789012345678, None]
    assert [r[0] for r in cves.select(security.cve_number(F.col("c"))).collect()] == [None] * 3
    spark.createDataFrame([(14_285, 2), (14_286, 4), (20_000_000, 50), (20_000_001, 11), (20_000_002, 3)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert_sql(spark, str(tmp_path), "part", "cve_number")


def test_titles_with_references(spark, tmp_path):
    titles = ["a &amp;&amp;&amp", "k = &quot;73ab", "x &#60;b&#x3E; y", "&amp;lt; twice", " plain \n title ", "caf&eacute; &nbsp; &unknown;"]
    pages = [(i, f"<html><head><title>{t}</title></head><body><p>text</p></body></html>") for i, t in enumerate(titles)]
    df = spark.createDataFrame([*pages, (99, "<p>no title")], "page_id long, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    assert_sql(spark, str(tmp_path), "pages", "title_by_pattern_and_parser")
    some = spark.createDataFrame([("&amp;lt;&amp",), (None,)], "t string")
    assert [r[0] for r in some.select(texts.without_references("t")).collect()] == ["&lt;&", None]


def test_logins_behind_plain_forms_that_are_taken(spark, tmp_path):
    """dodo is taken as dod, dodo by others' marks; its number 0 is taken too."""
    names = ["do do", "do do", "do do", "do d", "ddo d", "dd o", "a b", "a b", "c dd", "x y z"]
    spark.createDataFrame([(i * 3 + 1, n) for i, n in enumerate(names)] + [(i * 2, n) for i, n in enumerate(names, 50)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert_sql(spark, str(tmp_path), "part", "first_free_name")


def test_candidates_are_few_where_plain_names_are_free(spark, sf_dir):
    from millrace import registry

    df = registry.queries()["first_free_name"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # candidates are made from distinct names, not behind every row
    assert plan.count("Generate posexplode") >= 2 and "p_partkey" not in "".join(x for x in plan.splitlines() if "Generate" in x)


def test_fixture_files_grow_in_number(spark, sf_dir, monkeypatch):
    from millrace import registry
    from millrace.plans import trees

    monkeypatch.setattr(trees, "FIXTURES", 20)
    seen = []
    kept = trees.sinks.write_each
    monkeypatch.setattr(trees.sinks, "write_each", lambda rows, at: seen.append(kept(rows, at)))
    n = registry.queries()["fixture_load"](spark, sf_dir).count()
    assert n == spark.read.parquet(f"{sf_dir}/customer.parquet").count() and seen[0] >= n // 20
