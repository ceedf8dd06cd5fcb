"""Very long texts, URLs and turns for the operators on DataFrame functions."""

import hashlib

from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, url_filter


def test_long_urls_are_judged_by_their_front(spark):
    tail = "x/" * 200_000
    rows = [(1, f"http://www.example.com/en/{tail}?q#f", None), (2, f"http://a.net/fr/{tail}", "<a href='http://b.net/'>"), (3, "h" * 300_000, None), (4, f"http://{'s.' * 1000}com/{tail}", None)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].host == "www.example.com" and got[1].path == f"/en/{tail}" and (got[1].rule, got[1].verdict) == ("www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/fr/", "block")
    assert (got[3].host, got[3].path, got[3].rule) == ("", "", None)
    assert (got[4].host, got[4].rule) == ("s." * 1000 + "com", "com/")


def test_long_texts_are_read_to_their_end(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, f"{long} {passage}"), (2, long), (3, f"{passage} {long[:400]} {passage}"), (4, "y" * 500_000), (5, ("p0 " * 60_000) + passage)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()}
    third = 26 + len(long[:400].split())
    assert got == {1: (150_013, 13, False), 2: (150_000, 0, False), 3: (third, 26, True), 4: (1, 0, False), 5: (60_013, 13, False)}


def test_long_turns_and_conversations_come_back_whole(spark):
    huge = "say <|im_end|> & more " * 40_000
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", huge), (1, 3, "user", "bye")]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 30) for t in range(3000)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = chat.read_turns(F.col("text"), F.col("n_repeated"))
    back: dict[int, list] = {1: [], 2: []}
    loss: dict[int, str] = {1: "", 2: ""}
    for r in out.select("conv_id", "window", turns.alias("t"), chat.read_targets(F.col("text"), F.col("loss")).alias("l")).orderBy("conv_id", "window").collect():
        back[r.conv_id] += [(x.role, x.text) for x in r.t]
        loss[r.conv_id] += "".join(r.l)
    for c in (1, 2):
        own = [x for x in rows if x[0] == c]
        assert back[c] == [(x[2], x[3]) for x in own]
        said = "".join(x[3] for x in own if x[2] == "assistant")
        assert hashlib.sha256(loss[c].encode()).hexdigest() == hashlib.sha256(said.encode()).hexdigest()
