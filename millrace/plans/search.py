"""Search queries over documents, whose first line stands for a title."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import stems
from millrace.operators import search as S
from millrace.operators.term_index import TermIndex
from millrace.registry import query
from millrace.sources.shared import shared_dir
from millrace.sources.tables import tables

WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def covers_sql(terms: list[str], source: str = "documents", where: str = "true", words: str = WORDS) -> str:
    """CTEs ending in ``ranked(doc_id, rank)``."""
    last = ", ".join(f"max(CASE WHEN term = '{t}' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS l{i}" for i, t in enumerate(terms))
    weight = " + ".join(f"CASE WHEN l{i} < title THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END" for i in range(len(terms)))
    least = f"least({', '.join(f'l{i}' for i in range(len(terms)))})"
    return f"""
WITH src AS (SELECT * FROM {source} WHERE {where}),
w AS (SELECT doc_id, {words.format('text')} AS ws, len({words.format("split_part(text, chr(10), 1)")}) AS title FROM src),
t AS (SELECT doc_id, title, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM w),
m AS (SELECT *, {last} FROM t WHERE term IN ({', '.join(f"'{t}'" for t in terms)})),
c AS (SELECT *, {least} AS p FROM m WHERE {' AND '.join(f'l{i} IS NOT NULL' for i in range(len(terms)))}),
v AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY pos) AS bp FROM c),
ranked AS (SELECT doc_id, round(sum(({weight}) / {len(terms)} / (1 + pos - p)), 6) AS rank FROM v WHERE bp IS NULL OR p > bp GROUP BY doc_id)"""


RELPRIO = "CASE WHEN quality = 1 THEN 1.0::DOUBLE WHEN quality = 0 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: relprio by quality label, the source as site, toxic ones internal."""
    docs, labels = tables(spark, sf_dir, "documents labels")
    prio = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.2).otherwise(0.5)
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", prio.alias("relprio"), F.col("source").alias("site"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("internal"),
        F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("url"),
    )


def site_sql(terms: list[str], where: str = "true", offset: int = 0, per_page: int = 20, words: str = WORDS) -> str:
    return (
        covers_sql(terms, where=where, words=words)
        + f""",
pri AS (SELECT doc_id, {RELPRIO} AS relprio, coalesce(toxic = 1, false) AS internal FROM documents LEFT JOIN labels USING (doc_id)),
best AS (SELECT doc_id, rank * relprio AS key, relprio FROM ranked JOIN pri USING (doc_id) WHERE NOT internal ORDER BY key DESC, doc_id LIMIT 1000),
num AS (SELECT *, row_number() OVER (ORDER BY key DESC, doc_id) AS hit FROM best)
SELECT hit::INT AS hit, doc_id, key * relprio AS rank FROM num WHERE hit > {offset} AND hit <= {offset + per_page}"""
    )


@query("site_search_topk", site_sql(["with", "from"]))
def site_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(pages(spark, sf_dir), S.Search(["with", "from"]))


CONFIG = S.Config({"der": "die", "das": "die", "den": "die", "dem": "die"})
CONFIGURED = (
    "list_transform("
    + WORDS.replace("{0}", "regexp_replace({0}, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+|https?://\\S+|\\b\\d+\\.\\d+\\b', ' ', 'g')")
    + ", lambda x: CASE WHEN x IN ('der', 'das', 'den', 'dem') THEN 'die' ELSE x END)"
)


@query("site_search_configured", site_sql(["die", "und"], per_page=1000, words=CONFIGURED))
def site_search_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words and an address fall out of the query; five spellings are one word in it and in the texts."""
    return S.search(pages(spark, sf_dir), S.Search(CONFIG.terms("The DER with und of me@example.org"), per_page=1000, config=CONFIG))


def stem_sql(words: str) -> str:
    """The rules of the stemmer as passes over a list of words."""
    for rules in stems.STEPS:
        cases = "".join(
            f" WHEN w LIKE '%{r.suffix}' AND len(w) >= {len(r.suffix) + r.least}{f" AND regexp_matches(left(w, len(w) - {len(r.suffix)}), '[{stems.VOWELS}]')" if r.vowel else ''} THEN left(w, len(w) - {len(r.suffix)}) || '{r.instead}'"
            for r in rules
        )
        words = f"list_transform({words}, lambda w: CASE{cases} ELSE w END)"
    return words


STEMMED = S.Config({"thes": "thesaurus"}, stemmed=True)
_PLAIN = WORDS.replace("{0}", "regexp_replace({0}, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+|https?://\\S+|\\b\\d+\\.\\d+\\b', ' ', 'g')")
STEMMED_WORDS = f"list_transform(list_zip({_PLAIN}, {stem_sql(_PLAIN)}), lambda z: CASE WHEN z[1] = 'thes' THEN 'thesaurus' WHEN z[1] IN ({', '.join(f"'{w}'" for w in sorted(S.STOP_WORDS))}) THEN z[1] ELSE z[2] END)"


@query("site_search_stemmed", site_sql(["er", "re"], per_page=1000, words=STEMMED_WORDS))
def site_search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits hold any form of the words: er, ers, ered, ering, re, reed, reing and so on."""
    return S.search(pages(spark, sf_dir), S.Search(STEMMED.terms("the ering of reing"), per_page=1000, config=STEMMED))


@query("search_synonym_before_stem", covers_sql(["thesaurus"], words=STEMMED_WORDS) + " SELECT doc_id, rank FROM ranked")
def search_synonym_before_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synonym is taken as it is: neither it nor what it stands for is stemmed."""
    (docs,) = tables(spark, sf_dir, "documents")
    return S.cover_ranks(docs.select("doc_id", "text"), STEMMED.terms("thes"), config=STEMMED)


def _index(spark: SparkSession, config: S.Config | None = None) -> TermIndex:
    return TermIndex(spark, f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}", config=config)


@query("site_search_indexed", site_sql(["that", "was"], offset=10, per_page=40))
def site_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered from a stored index: only the folders of two terms are read."""
    given, index = pages(spark, sf_dir), _index(spark)
    index.add(given.select("doc_id", "text"), 0)
    return index.search(given.drop("text"), S.Search(["that", "was"], offset=10, per_page=40))


@query("site_search_indexed_stemmed", site_sql(["er", "he"], per_page=1000, words=STEMMED_WORDS))
def site_search_indexed_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, index = pages(spark, sf_dir), _index(spark, STEMMED)
    index.add(given.select("doc_id", "text"), 0)
    return index.search(given.drop("text"), S.Search(["er", "he"], per_page=1000))


@query("site_search_index_delta", site_sql(["and", "this"], per_page=1000))
def site_search_index_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index first holds titles only; the documents with more come as a generation of changes."""
    given, index = pages(spark, sf_dir), _index(spark)
    old = given.select("doc_id", S.title_of(F.col("text")).alias("title"), "text")
    index.add(old.select("doc_id", F.col("title").alias("text")), 0)
    index.add(old.where("NOT text <=> title").select("doc_id", "text"), 1)
    return index.search(given.drop("text"), S.Search(["and", "this"], per_page=1000))


@query("site_search_page2", site_sql(["with", "from"], offset=20))
def site_search_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(pages(spark, sf_dir), S.Search(["with", "from"], offset=20))


@query("site_search_prefix", site_sql(["que", "las"], where="'/' || lang || '/' || doc_id LIKE '/e_/%'"))
def site_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(pages(spark, sf_dir), S.Search(["que", "las"], prefix="/e_/"))


@query("search_hit_count_capped", covers_sql(["the"]) + " SELECT least(count(*), 1000) AS hits FROM ranked")
def search_hit_count_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hit_count(pages(spark, sf_dir), ["the"])


@query("search_empty_query", "SELECT 0 AS siteid, 0.0::DOUBLE AS rank")
def search_empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without terms answers with a single zero row."""
    terms = S.parse_query("the of and", stop_words=S.STOP_WORDS)
    none = S.search(pages(spark, sf_dir), S.Search(terms)).agg(F.count("*").alias("n"))
    return none.select(F.col("n").cast("int").alias("siteid"), F.lit(0.0).alias("rank"))


@query("search_snippet")
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = pages(spark, sf_dir)
    return S.snippets(S.search(given, S.Search(["with", "from"])), given, ["with", "from"])


@query("search_double_weight_rank", site_sql(["are", "this"], per_page=1000))
def search_double_weight_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(pages(spark, sf_dir), S.Search(["are", "this"], per_page=1000))


@query(
    "search_internal_flag",
    covers_sql(["was"]) + " SELECT count(*) AS hits, count(*) FILTER (WHERE coalesce(toxic, 0) <> 1) AS public_hits FROM ranked LEFT JOIN labels USING (doc_id)",
)
def search_internal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with and without internal pages."""
    given = pages(spark, sf_dir).select("doc_id", "internal", "text")
    found = S.cover_ranks(given, ["was"]).join(given, "doc_id")
    return found.agg(F.count("*").alias("hits"), F.count(F.when(~F.col("internal"), 1)).alias("public_hits"))


@query("search_site_param", site_sql(["the"], where="source = 'src3'"))
def search_site_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(pages(spark, sf_dir), S.Search(["the"], site="src3"))


@query(
    "search_conversations",
    covers_sql(["that", "are"], "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)") + " SELECT doc_id, rank FROM ranked",
)
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second corpus, of messages."""
    (talk,) = tables(spark, sf_dir, "conversations")
    return S.cover_ranks(talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"), ["that", "are"])


@query(
    "list_search_date_sort",
    """SELECT event_id, ts, event_type FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'
    ORDER BY ts DESC, event_id LIMIT 50""",
)
def list_search_date_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date window, newest first."""
    (events,) = tables(spark, sf_dir, "events")
    window = (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-17").cast("timestamp_ntz"))
    return events.where(window & (F.col("event_type") == "view")).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "event_type")
