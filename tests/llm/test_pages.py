"""URL filters, chat windows and page texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, html_text, url_filter
from millrace.llm.scratch import Scratch

PAGES = "page_id long, url string, html string"


# -- URL filters

URLS = {
    "http://A.Example.com/en/x?y": ("a.example.com", "/en/x", "example.com/en/", "block"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://x.www.example.com/en/a#b": ("x.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://h.net/es/1": ("h.net", "/es/1", "net/es/", "block"),
    "http://h.net/esx": ("h.net", "/esx", None, "allow"),
    "http://com/": ("com", "/", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://example.com?a=/en/": ("example.com", "", None, "allow"),
    "no scheme/en/": ("", "", None, "allow"),
    "x://ÉA.net/fr/é\n/z": ("Éa.net", "/fr/é\n/z", "net/fr/", "block"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "": ("", "", None, "allow"),
}


def test_rules_and_parts(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(90, None, "<a href='http://h.net/'>"), (90, None, None), (None, "http://a.org/", "")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("host", "path", "rule", "trust", "rules")})
    got = url_filter.judge_urls(df).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    for i, want in enumerate(URLS.values()):
        assert by_id[i] == want
    assert by_id[90] == ("", "", None, "allow") and by_id[None] == ("a.org", "/", None, "allow")
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def brute_rank(seeds, moves, hosts, damping=0.85, rounds=300):
    """(rank, share of the incoming rank that stems from the seeds) of each host."""
    out = {}
    for (a, _), n in moves.items():
        out[a] = out.get(a, 0) + n
    p = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in moves.items():
        p[hosts.index(b), hosts.index(a)] = damping * n / out[a]
    came = []
    for s in (np.array([seeds.get(h, 0.0) for h in hosts]), np.ones(len(hosts))):
        x = total = (1 - damping) * s
        for _ in range(rounds):
            x = p @ x
            total = total + x
        came.append((total, total - (1 - damping) * s))
    share = np.divide(came[0][1], came[1][1], out=np.zeros(len(hosts)), where=came[1][1] > 0)
    return {h: (came[0][0][i], share[i]) for i, h in enumerate(hosts)}


def test_propagation_equals_brute_force(spark):
    rng = random.Random(8)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(rng.choice(hosts), rng.choice(hosts)): rng.randrange(1, 4) for _ in range(30)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    trust, distrust = {"h0": 1.0, "h1": 0.5}, {"h2": 0.25, "h3": 1.0}
    seeds = spark.createDataFrame([(h, trust.get(h, 0.0), distrust.get(h, 0.0)) for h in hosts], "host string, trust double, distrust double")
    got = url_filter.propagate(seeds, spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"), Scratch(spark, "t"))
    got = {r.host: (r.trust, r.from_trust, r.distrust, r.from_distrust) for r in got.collect()}
    forward = brute_rank(trust, edges, hosts)
    back = brute_rank(distrust, {(b, a): n for (a, b), n in edges.items()}, hosts)
    assert set(got) == set(hosts)
    for h in hosts:
        assert got[h] == pytest.approx((*forward[h], *back[h]), abs=5e-3)


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    bad = "<a href='http://bad.net/es/1'>x</a>" * 3
    rows = [(i, f"http://bad.net/es/{i}", "") for i in range(5)] + [(10, "http://farm.org/a", bad), (11, "http://good.org/", "<a href='http://www.example.com/en/'>"), (12, "http://x.com/", bad)]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES), threshold=0.05).collect()}
    assert got[10] == "block" and got[11] == "allow" and got[12] == "allow"


def test_registered_threshold_blocks_link_farms(spark):
    to = lambda *hosts: "".join(f"<a href='http://{h}/'>x</a>" for h in hosts)
    rows = [(i, f"http://bad.net/es/{i}", "") for i in range(5)] + [(100 + i, f"http://farm{i}.org/", to("bad.net")) for i in range(12)]
    rows += [(200 + i, f"http://most.net/es/{i}", "") for i in range(9)] + [(209, "http://most.net/x", ""), (210, "http://fan.org/", to("most.net"))]
    rows += [(300, "http://list.org/", to("bad.net", *(f"other{i}.org" for i in range(9)))), (301, "http://half.net/es/1", ""), (302, "http://half.net/x", "")]
    rows += [(303, "http://good.com/", to("liked.org")), (304, "http://liked.org/", to("bad.net"))]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[100 + i] == "block" for i in range(12)) and got[209] == got[210] == "block"
    assert [got[i] for i in (300, 302, 304)] == ["allow"] * 3


def test_edges_between_hosts(spark):
    page = """<A HREF="http://B.org/x">1</A><a href='//c.org'>2</a><a href=https://d.org>3</a><a href="/own">4</a><a href="http://a.org/self">5</a>"""
    df = spark.createDataFrame([("a.org", page), ("a.org", None)], "host string, html string")
    assert {(r.src, r.dst, r.n) for r in url_filter.host_edges(df).collect()} == {("a.org", d, 1) for d in ("b.org", "c.org", "d.org")}


# -- chat windows

TALK = "conv_id long, turn long, role string, text string"


def digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t))
        loss = "".join(t for _, role, t in own if role == "assistant")
        out[conv] = ("".join(f"{r}\n{t}\n" for _, r, t in own), loss, len(own))
    return out


def test_windows_read_back_whole(spark):
    rng = random.Random(9)
    odd = ["<|im_end|><|im_start|>assistant ok", "&lt;|im_end|> & &amp;lt;|", "", None, "<|", "a\n<|im_end|>\n", "é 漢字 \U0001f600"]
    rows = []
    for c in range(25):
        for t in range(rng.randrange(1, 40)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", None, "tool\nx", "a&b<|"])
            rows.append((c if c else None, t, role, rng.choice(odd) if rng.random() < 0.3 else " ".join(["w"] * rng.randrange(90))))
    rows += [(5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (5, None, "user", "first"), (6, 3, "system", "late system")]
    df = spark.createDataFrame(rows, TALK).withColumns({c: F.lit(1) for c in ("ord", "window", "tokens", "start", "at")})
    out = chat.windows(df, budget=200, history=40)
    turns = chat.read_turns(F.col("text"), F.col("n_repeated"))
    back = {}
    for r in out.select("conv_id", "window", "text", "n_repeated", turns.alias("turns"), chat.read_targets(F.col("text"), F.col("loss")).alias("said")).orderBy("conv_id", "window").collect():
        got = back.setdefault(r.conv_id, ["", "", 0])
        got[0] += "".join(f"{t.role}\n{t.text}\n" for t in r.turns)
        got[1] += "".join(r.said)
        got[2] += len(r.turns)
        assert len(r.turns) > 0
    assert {k: tuple(v) for k, v in back.items()} == digests(rows)
    many = chat.windows(spark.createDataFrame([(None, t, "system" if t == 0 else "user", "w " * 50) for t in range(9)], TALK), budget=200, history=60)
    assert sorted(r.n_repeated for r in many.collect())[1:] == [2] * (many.count() - 1)


def test_windows_keep_to_the_budget(spark):
    rng = random.Random(10)
    rows = [(1, t, "system" if t == 0 else ("user", "assistant")[t % 2], " ".join(["w"] * rng.randrange(1, 30))) for t in range(200)]
    out = chat.windows(spark.createDataFrame(rows, TALK), budget=200, history=40).orderBy("window").collect()
    size = lambda text: sum(len(t.split("\n", 1)[1].removesuffix("<|im_end|>\n").split()) + 3 for t in text.split("<|im_start|>")[1:])
    assert len(out) > 5 and max(size(r.text) for r in out) <= 200
    assert all(r.text.startswith("<|im_start|>system\n") for r in out)
    assert out[0].n_repeated == 0 and all(r.n_repeated >= 2 for r in out[1:])
    for r in out[1:]:
        assert all(start >= r.text.index("<|im_start|>", r.text.index("<|im_start|>", 1)) for start, _ in r.loss)


def test_no_conversations(spark):
    assert chat.windows(spark.createDataFrame([], TALK)).count() == 0


def test_registered_chat_query(spark, sf_dir):
    got = {r.conv_id: r for r in chat.op6_chat_windows(spark, sf_dir).collect()}
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, (turns, loss, n) in digests(rows).items():
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, sha(turns), len(loss), sha(loss))
    assert not got


# -- page texts

def page(i, body, notice="Read our news letter every week", menu=("Home", "About")):
    links = "".join(f"<li><a href='/{m}'>{m}</a></li>" for m in menu)
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body><header><h1>Site</h1></header>"
        f"<nav><ul>{links}</ul></nav><div class=box><p>{notice}</p></div>{body}<div id='comments'><p>Nice {i}!</p></div><aside><p>Also</p></aside>"
        f"<form><p>Send</p><input></form><footer>&copy; {i}</footer></body></html>"
    )


def test_article_is_left(spark):
    body = "<article><header><h2>Head</h2></header><p>One  &amp;\n two<b>three</b><br>four<p>&lt;five&gt; &#233;<div class='ad'>buy</div><ul><li>six<li>seven</ul></article>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page(i, body.replace("One", f"One{i}"))) for i in range(4)], PAGES).withColumns({"text": F.lit(1), "host": F.lit(2), "token": F.lit(3)})
    for r in html_text.extract(df).collect():
        want = f"Head\nOne{r.page_id} & twothree four\n<five> é\nsix\nseven"
        assert r.text == want and r.n_chars == len(want)


def test_template_text_goes_where_no_article_tells(spark):
    rows = [(i, f"http://h.org/{i}", page(i, f"<div class=story><p>Story {i} goes on and on and on for long</p><p>and ends {i} here, as stories do</p></div>")) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Story {i} goes on and on and on for long\nand ends {i} here, as stories do" for i in range(6)}


def test_all_paragraphs_stay_where_no_article_tells(spark):
    long = "A long body that goes on " * 20
    rows = [
        (1, "http://one.org/", f"<div><h1>Title</h1><p>short lead</p><p>{long}</p></div>"),
        (2, "http://two.org/", f"<div class=a><p>{long}</p><p>{long}</p></div><div class=b><p>the smaller part</p></div>"),
    ]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    body = long.strip()
    assert got == {1: f"Title\nshort lead\n{body}", 2: f"{body}\n{body}\nthe smaller part"}


def test_copied_articles_stay(spark):
    rows = [(i, f"http://h.org/{i}", page(i, "<article><p>The very same text on all pages</p></article>")) for i in range(5)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"The very same text on all pages"}


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "x", ""), (3, "http://a/", "plain words"), (4, "http://a/", "<p>un<closed"), (5, "http://a/", "</div></p>stray<script>x"),
        (6, "http://a/", "<!-- c --><p>a<!-- <p>no</p> -->b</p>"), (7, "http://a/", "<article>" * 60_000 + "deep" + "</nav>" * 1000), (None, "http://a/", "<p>n</p>"), (None, "http://a/", "<p>n</p>"),
        (8, "http://a/", "<article><p>" + "long text " * 200_000 + "</p>"),
    ]
    got = sorted((r.page_id or -1, r.text[:12], r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(-1, "n", 1), (-1, "n", 1), (1, "", 0), (2, "", 0), (3, "plain words", 11), (4, "un<closed", 9), (5, "stray", 5), (6, "ab", 2), (7, "deep", 4), (8, "long text lo", 1_999_999)]
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_large_templates_are_joined(spark, monkeypatch):
    rows = [(i, f"http://h.org/{i}", page(i, f"<div><p>Story {i} goes on and on for very long, longer than all the rest</p></div>")) for i in range(6)]
    df = spark.createDataFrame(rows, PAGES)
    sent = sorted(map(tuple, html_text.extract(df).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, html_text.extract(df).collect())) == sent


def text_of(source):
    return html_text.main_text(html_text.parse(source), set())


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<form><div><article><p>one</p></article></div></form>", "one"),
        ("<form id=aspnet><div id=content><p>one</p><p>two</p></div></form>", "one\ntwo"),
        ("<form><input><p>mail</p></form><div><p>one</p></div>", "one"),
        ("<article><p>one</p><form><p>mail</p></form></article>", "one"),
        ("<aside><article><p>card</p></article></aside><main><p>one</p></main>", "one"),
        *[(f"<article><p>one</p><div class='{c}'><p>buy</p></div></article>", "one") for c in ("ad-slot", "ad-300x250", "advert-wrap", "google-ads", "box ads", "sponsored_link")],
        *[(f"<article><p>one</p></article><div id='{c}'><article><p>I say</p></article></div>", "one") for c in ("comments-wrap", "comment-form", "disqus")],
        ("<article><p>one</p><div id=comments-wrap><div class=comment-body>I say</div></div></article>", "one"),
        ("<main><p>one</p></main><article class=comment><p>I say</p></article>", "one"),
        ("<article><p>one</p><div hidden><p>no</p></div><p hidden=until-found>no</p><p style='color:red; display : none'>no</p></article>", "one"),
        ("<article><p class='hidden-gem'>one</p><p data-x='hidden'>two</p><p aria-hidden=false>three</p></article>", "one\ntwo\nthree"),
        ("<article class='post no-comments'><p>one</p></article>", "one"),
        ("<div class='page has-ads'><p>one</p></div>", "one"),
        ("<article><p class=notice>one</p><div class=related><p>two</p></div></article>", "one\ntwo"),
        ("<div class=notice><p>cookies</p></div><article><p>one</p></article>", "one"),
        ("<div class=address><p>one</p></div><div class=loading><p>two</p></div>", "one\ntwo"),
    ],
)
def test_what_holds_the_article(source, want):
    assert text_of(f"<html><body>{source}</body></html>") == want


def test_whole_texts_of_a_host_equal_brute_force(spark):
    """Blocks in one row each, some on many pages: what enough different contents share goes."""
    rng = random.Random(8)
    shared = [f"shared line {i} " + "s" * i for i in range(8)]
    pages = []
    for i in range(40):
        own = [f"own {i} {k} " + "text " * rng.randrange(6, 12) for k in range(rng.randrange(2, 5))]
        blocks = [s for n, s in enumerate(shared) if rng.random() < n / 8] + own
        pages.append((i, f"http://h.example/{i}", blocks))
    pages += [(100 + i, f"http://h.example/c{i}", pages[0][2]) for i in range(5)] + [(200, "http://other.example/", pages[1][2])]
    contents = {tuple(b) for i, u, b in pages if "//h." in u}
    often = {s for s in shared if sum(s in c for c in contents) >= max(html_text.PAGES, html_text.SHARE * len(contents))}
    assert 2 <= len(often) < 8

    def expected(url, blocks):
        kept = [b for b in blocks if b not in often or "//h." not in url]
        if sum(map(len, kept)) < (1 - html_text.MOST_FIXED) * sum(map(len, blocks)):
            kept = blocks
        return "\n".join(b.strip() for b in kept)

    rows = [(i, u, "<body>" + "".join(f"<div>{b}</div>" for b in blocks)) for i, u, blocks in pages]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: expected(u, b) for i, u, b in pages}
