"""Ranked full-text search: terms all required, cover-density rank, late snippets.

A cover is a shortest stretch of a text that holds every term. Each counts the mean weight
of its terms' places over one plus its extra length; a rank is the sum over covers.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import stems

SPLIT = r"[^\p{L}\p{N}]+"
HIT_CAP = 1000
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.1
#: What is not searched for: addresses, links and decimal numbers.
UNINDEXED = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|https?://\S+|\b\d+\.\d+\b"
STOP_WORDS = frozenset("a an and are as at be by for from in is it of on or that the this to was with".split())


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def parse_query(text: str, synonyms: Mapping[str, str] | None = None, stop_words: frozenset[str] = frozenset()) -> list[str]:
    """Distinct terms of a plain query; synonyms first, then stop words."""
    import re

    found = [w for w in re.split(r"[^\w]+", text.lower()) if w]
    named = [(synonyms or {}).get(w, w) for w in found]
    return list(dict.fromkeys(w for w in named if w not in stop_words))


def index_words(text: Column, synonyms: Mapping[str, str] | None = None, stop_words: frozenset[str] = frozenset(), unindexed: str = UNINDEXED, stemmed: bool = False) -> Column:
    """Words as they are indexed: unindexed classes out, synonyms mapped, stop words out. With
    ``stemmed`` a word that is neither a synonym nor a stop word is its stem."""
    found = words(F.regexp_replace(text, unindexed, " "))
    out = stems.stems(found) if stemmed else found
    fixed = dict(synonyms or {}) | ({w: w for w in STOP_WORDS | stop_words if w not in (synonyms or {})} if stemmed else {})
    if fixed:
        table = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
        out = F.zip_with(found, out, lambda w, s: F.coalesce(F.try_element_at(table, w), s))
    if stop_words:
        out = F.filter(out, lambda w: ~w.isin(*sorted(stop_words)))
    return out


def title_of(text: Column) -> Column:
    """The first line."""
    return F.substring_index(text, "\n", 1)


@dataclass(frozen=True)
class Config:
    """How texts and queries become terms: a synonym table, stop words, classes left out.

    ``unindexed`` must match no plain word. Stop words need not be taken from texts: a query
    never asks for one, and the places of the other words count them. The dictionaries stand
    in a chain: what is no synonym and no stop word goes to the stemmer, if there is one.
    """

    synonyms: Mapping[str, str]
    stop_words: frozenset[str] = STOP_WORDS
    unindexed: str = UNINDEXED
    stemmed: bool = False

    def terms(self, query: str) -> list[str]:
        import re

        found = parse_query(re.sub(self.unindexed, " ", query), self.synonyms, self.stop_words)
        meant = set(self.synonyms.values())
        return list(dict.fromkeys(w if w in meant or not self.stemmed else stems.stem(w) for w in found))

    def words(self, text: Column) -> Column:
        return index_words(text, self.synonyms, unindexed=self.unindexed, stemmed=self.stemmed)

    def plain(self, text: Column) -> Column:
        """The words of a text before they become terms; each becomes one."""
        return words(F.regexp_replace(text, self.unindexed, " "))

    def term(self, word: Column) -> Column:
        """The term that a plain word becomes."""
        return index_words(word, self.synonyms, unindexed="^$", stemmed=self.stemmed)[0] if self.stemmed or self.synonyms else word

    def term_of(self, word: str) -> str:
        """``term`` of one word."""
        if word in self.synonyms:
            return self.synonyms[word]
        return word if not self.stemmed or word in STOP_WORDS else stems.stem(word)

    def spellings(self, term: str) -> list[str]:
        """Texts that hold the term hold one of these."""
        return [stems.always_in(term) if self.stemmed else term, *sorted(w for w, meant in self.synonyms.items() if meant == term)]


def cover_ranks(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", config: Config | None = None) -> DataFrame:
    """(key, rank) of the documents that hold every term, in any of its spellings.

    Documents without all terms are left by a containment test before any word is exploded,
    words that can be no term before any is stemmed. The outer explode spares a test for empty
    lists that would split every text twice.
    """
    split = config.plain if config else words
    spelled = config.spellings if config else lambda t: [t]
    any_of = lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in spelled(t)])
    has = reduce(lambda a, b: a & b, [any_of(t) for t in terms])
    held = (
        docs.where(has)
        .select(key, F.size(split(title_of(F.col(text)))).alias("title"), split(F.col(text)).alias("words"))
        .select(key, "title", F.posexplode_outer("words").alias("pos", "term"))
    )
    if config:
        able = reduce(lambda a, b: a | b, [F.contains("term", F.lit(w)) for t in terms for w in spelled(t)])
        held = held.where(able).withColumn("term", config.term(F.col("term")))
    return ranked(covers(held.where(F.col("term").isin(*terms)), terms, key), key)


def covers(held: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, title, start, pos, weight) of each cover, from the places (key, title, pos, term)
    of all terms; ``title`` is the number of words in a document's title."""
    own = Window.partitionBy(key).orderBy("pos")
    last = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(own) for t in terms]
    for i, c in enumerate(last):
        held = held.withColumn(f"last{i}", c)
    lasts = [F.col(f"last{i}") for i in range(len(terms))]
    weight = reduce(lambda a, b: a + b, [F.when(c < F.col("title"), TITLE_WEIGHT).otherwise(BODY_WEIGHT) for c in lasts]) / len(terms)
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in lasts])
    return (
        held.where(whole)
        .withColumn("start", F.least(*lasts) if len(lasts) > 1 else lasts[0])
        .withColumn("before", F.lag("start").over(own))
        .where(F.col("before").isNull() | (F.col("start") > F.col("before")))
        .select(key, "title", "start", "pos", weight.alias("weight"))
    )


def ranked(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.round(F.sum(F.col("weight") / (1 + F.col("pos") - F.col("start"))), 6).alias("rank"))


@dataclass(frozen=True)
class Search:
    """Options of a search over pages (doc_id, text, relprio, site, internal, url)."""

    terms: list[str]
    offset: int = 0
    per_page: int = 20
    site: str | None = None
    prefix: str | None = None
    internal: bool = False
    config: Config | None = None


def search(pages: DataFrame, options: Search) -> DataFrame:
    """(hit, doc_id, rank): the asked page of the best HIT_CAP hits, best first.

    Hits are ordered by rank times relprio; the returned rank is multiplied by relprio once
    more. ``prefix`` is a LIKE pattern before its closing %; equal ranks go by doc_id.
    Without terms the result is empty.
    """
    spark = pages.sparkSession
    if not options.terms:
        return spark.createDataFrame([], "hit int, doc_id long, rank double")
    pages = allowed(pages, options)
    return page_of_hits(cover_ranks(pages, options.terms, config=options.config).join(pages.select("doc_id", "relprio"), "doc_id"), options)


def allowed(pages: DataFrame, options: Search) -> DataFrame:
    """The pages that a search may show."""
    pages = pages.where(F.lit(options.internal) | ~F.col("internal"))
    if options.site is not None:
        pages = pages.where(F.col("site") == options.site)
    if options.prefix is not None:
        pages = pages.where(F.col("url").like(options.prefix + "%"))
    return pages


def page_of_hits(found: DataFrame, options: Search) -> DataFrame:
    """The asked page of ranked pages (doc_id, rank, relprio)."""
    found = found.withColumn("key", F.col("rank") * F.col("relprio"))
    best = found.orderBy(F.desc("key"), "doc_id").limit(HIT_CAP)
    top = best.orderBy(F.desc("key"), "doc_id").offset(options.offset).limit(options.per_page)
    place = F.row_number().over(Window.orderBy(F.desc("key"), "doc_id")) + options.offset
    return top.select(place.alias("hit"), "doc_id", (F.col("key") * F.col("relprio")).alias("rank"))


def hit_count(pages: DataFrame, terms: list[str]) -> DataFrame:
    """One row: number of hits, no more than HIT_CAP."""
    return cover_ranks(pages, terms).limit(HIT_CAP).agg(F.count("*").alias("hits"))


def snippets(hits: DataFrame, pages: DataFrame, terms: list[str], around: int = 8, most: int = 2, start: str = "[[", stop: str = "]]", config: Config | None = None) -> DataFrame:
    """``hits`` with up to ``most`` fragments of each page, joined by dots: the stretches between
    white space that hold its shortest covers, with ``around`` more on either side, terms
    between markers.

    Shorter covers go first, of equal ones the earlier; one that meets an earlier choice is
    passed over. A page without a cover has an empty snippet, as has a null text. Texts are
    joined, and words placed, only for the hits.
    """
    split = config.words if config else words
    shown = hits.join(pages.select("doc_id", "text"), "doc_id", "left")
    token = F.split("text", r"\s+")
    sizes = F.transform(token, lambda t: F.size(split(t)))
    # the token that each word stands in
    places = F.flatten(F.transform(F.arrays_zip(F.sequence(F.lit(0), F.size(token) - 1).alias("i"), sizes.alias("n")), lambda x: F.array_repeat(x["i"], x["n"])))
    words_at = shown.where("text IS NOT NULL").select("doc_id", F.size(split(title_of(F.col("text")))).alias("title"), places.alias("token_of"), F.flatten(F.transform(token, split)).alias("w"))
    held = words_at.select("doc_id", "title", F.posexplode("w").alias("pos", "term")).where(F.col("term").isin(*terms))
    spans = covers(held, terms, "doc_id").join(words_at.select("doc_id", "token_of"), "doc_id")
    spans = spans.select("doc_id", F.struct((F.col("pos") - F.col("start")).alias("length"), F.expr("token_of[start]").alias("a"), F.expr("token_of[pos]").alias("b")).alias("span"))
    # shortest first; each next one only if it is apart from all before it
    apart = F.aggregate(
        F.array_sort(F.collect_set("span")),
        F.array().cast("array<struct<length:int,a:int,b:int>>"),
        lambda kept, s: F.when((F.size(kept) < most) & F.forall(kept, lambda k: (s["a"] > k["b"] + around) | (s["b"] < k["a"] - around)), F.array_append(kept, s)).otherwise(kept),
    )
    chosen = spans.groupBy("doc_id").agg(apart.alias("spans"))
    mark = lambda t: F.when(F.exists(split(t), lambda w: w.isin(*terms)), F.concat(F.lit(start), t, F.lit(stop))).otherwise(t)
    begin = lambda s: F.greatest(s["a"] - around, F.lit(0))
    fragment = lambda s: F.array_join(F.transform(F.slice(token, begin(s) + 1, s["b"] + around + 1 - begin(s)), mark), " ")
    in_order = F.array_sort("spans", lambda x, y: x["a"] - y["a"])
    return shown.join(chosen, "doc_id", "left").select(*hits.columns, F.coalesce(F.array_join(F.transform(in_order, fragment), " … "), F.lit("")).alias("snippet"))
