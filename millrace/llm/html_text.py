"""Main text of web pages by deducing each host's template from equivalence classes.

Tokens of a page are its elements (by path) and its text blocks (path and text). Tokens of
a host whose occurrence vectors over its pages are equal form a class; classes that enough
pages hold are ordered and nested into the template, those that cross another are left out,
and the slots, which the template does not fix, are content. Vectors run over different
contents only: copies of a page say nothing of its template. Menus, forms, adverts and the
like are left out by their elements as well.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch
from millrace.llm.url_filter import host_and_path

#: A text block belongs to the template if so large a share of the host's contents, and so
#: many of them, hold its class; inside the article both are higher.
SHARE, PAGES = 0.5, 3
ARTICLE_SHARE, ARTICLE_PAGES = 0.6, 8
#: A page of which the template would take a larger part is a variant of other pages of its
#: host and keeps all.
MOST_FIXED = 2 / 3

#: Template rows of all hosts that are sent to every task; beyond, pages are joined by host.
BROADCAST_ROWS = 200_000

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style noscript template textarea title svg math iframe object".split())
CHROME = frozenset("nav header footer aside button select menu dialog head".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
CLASSES = frozenset(
    "promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget cookie cookies consent notice notices banner popup modal newsletter subscribe signup "
    "share sharing social related login search pagination copyright legal".split()
)
COMMENTS = frozenset("disqus reply replies respond".split())
#: Parts of a class name that tell an advert or a reader comment whatever stands beside them,
#: unless the name says that there is none, or that the element is only next to one.
TOLD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments".split())
DENIED = frozenset("has no not non with without free off hide".split())
#: Names that say little inside an article: there they stand for parts of it, too.
MILD = frozenset("notice notices related banner legal copyright header".split())
#: Words that may stand beside one of the above in a class name without changing what it means.
BESIDE = frozenset("site main top bottom left right global primary secondary list area section thread user reader box bar buttons links".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# One tag from its sign to its end. Quotes quote only after an equals sign, and no part is
# ever tried twice.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)*+)>"
)
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_LETTERS = re.compile(r"[a-z]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|[\s/\"'])hidden(?=[\s/=]|$)", re.I)
_UNSHOWN = re.compile(r"(?:^|[\s/\"'])style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"'>]*)display\s*:\s*none", re.I)


@dataclass
class Block:
    """A run of text between block-level tags."""

    path: int
    text: str
    chrome: bool
    article: bool
    form: bool = False


@dataclass
class Element:
    """path: a hash of the names from the root down. chrome: without content by its kind or
    role, or that of an element around it; looks: by class names alone, and form: inside a
    form, both of which an article or main element inside overrules."""

    tag: str
    path: int
    chrome: bool
    looks: bool
    article: bool
    form: bool = False


@dataclass
class Page:
    """Element paths and text blocks in order."""

    elements: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def token(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, str]:
    """Whether an element holds no content by its kind, role or being hidden, or as an advert
    or comment; whether it looks like that by its class names; and a name for its path."""
    name, chrome, looks = tag, tag in CHROME and not (tag == "header" and in_article), False
    if attributes and tag not in ("html", "body"):
        told = tag in ("article", "main")
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            words = value.split()
            if m[1].lower() == "role":
                chrome = chrome or not ROLES.isdisjoint(words)
                continue
            name += ("#" if m[1].lower() == "id" else ".") + value
            chrome = chrome or any(_tells(w) for w in words)
            if not told:
                chrome = chrome or any(_named(w, COMMENTS) for w in words)
                looks = looks or any(_named(w, CLASSES - MILD if in_article else CLASSES) for w in words)
        low = attributes.lower()
        chrome = chrome or "hidden" in low and bool(_HIDDEN.search(_QUOTED.sub('""', attributes))) or "display" in low and bool(_UNSHOWN.search(attributes))
    return chrome, looks, name


def _tells(word: str) -> bool:
    """Whether a part of a class name tells an advert or a comment."""
    parts = _LETTERS.findall(word)
    return not TOLD.isdisjoint(parts) and DENIED.isdisjoint(parts)


def _named(word: str, names: frozenset[str]) -> bool:
    """Whether all parts of a class name tell the same; has-sidebar says nothing of what is inside."""
    parts = _LETTERS.findall(word)
    return not names.isdisjoint(parts) and all(p in names or p in BESIDE for p in parts)


def markup(source: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, sign, tag, attributes): each tag with the text before it; the last has none.
    Comments and declarations vanish; a sign that opens no tag is text. The time is linear
    in the source, closed tags or not."""
    at, text, n = 0, [], len(source)
    whole = True  # no tag so far ran into the end of the source
    while at < n:
        sign = source.find("<", at)
        if sign < 0:
            break
        text.append(source[at:sign])
        at = sign
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        lead = source[at + 1 : at + 2]
        named = lead in "!?" or lead.isascii() and (lead.isalpha() or lead == "/" and source[at + 2 : at + 3].isascii() and source[at + 2 : at + 3].isalpha())
        if not lead or not named:
            text.append("<")
            at += 1
            continue
        close = source.find(">", at)
        if close < 0:
            break
        if lead in "!?":
            at = close + 1
            continue
        m = _TAG.match(source, at) if whole else None
        if m is None:
            whole = False
            slash = lead == "/"
            found = ("/" if slash else "", _NAME.match(source, at + 1 + slash)[0], "")
            at = close + 1
        else:
            found, at = m.groups(), m.end()
        tag = found[1].lower()
        yield "".join(text), found[0], tag, found[2]
        text = []
        if tag in RAW and not found[0] and not found[2].endswith("/"):
            end = _raw_end(tag).search(source, at)
            at = end.end() if end else n
    yield "".join(text) + source[at:], "", "", ""


@functools.lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def parse(source: str) -> Page:
    """Elements and text blocks of a page in order; unclosed and stray tags are tolerated."""
    page, pending = Page(), []
    stack = [Element("", 0, False, False, False)]
    opened: Counter = Counter()

    def flush() -> None:
        text = " ".join(html.unescape("".join(pending)).split())
        pending.clear()
        if text:
            top = stack[-1]
            page.blocks.append(Block(top.path, text, top.chrome or top.looks, top.article, top.form))

    for text, sign, tag, attributes in markup(source):
        if text:
            pending.append(text)
        if tag in INLINE:
            if tag == "br":
                pending.append(" ")
            continue
        if pending:
            flush()
        if not tag:
            break
        if sign:
            if opened[tag]:
                while (gone := stack.pop().tag) != tag:
                    opened[gone] -= 1
                opened[tag] -= 1
            continue
        shut = CLOSES.get(tag, ())
        if stack[-1].tag == "p" or stack[-1].tag in shut:
            opened[stack.pop().tag] -= 1
        up = stack[-1]
        chrome, looks, name = _kind(tag, attributes, up.article)
        path = token(str(up.path), name)
        page.elements.append(path)
        if tag not in VOID and tag not in RAW and not attributes.endswith("/"):
            opened[tag] += 1
            told = tag in ("article", "main")
            anew = told and not up.article
            stack.append(Element(tag, path, up.chrome or chrome, looks or (up.looks and not anew), up.article or told, tag == "form" or (up.form and not anew)))
    return page


def page_tokens(page: Page) -> dict[int, list]:
    """Of each token its occurrences, its first place, and whether it is a text block and
    one inside the article."""
    out: dict[int, list] = {}
    for t in page.elements:
        out.setdefault(t, [0, len(out), False, False])[0] += 1
    for b in page.blocks:
        kept = out.setdefault(text_token(b), [0, len(out), True, False])
        kept[0] += 1
        kept[3] = kept[3] or b.article
    return out


def text_token(b: Block) -> int:
    return token("text", str(b.path), b.text)


def main_text(page: Page, template: set[int]) -> str:
    """The blocks in slots of the template, outside chrome elements and forms: those of the
    article if there is one, else all. Where all that is left lies in forms, a form is wrapped
    around the page and says nothing. If the template takes more than MOST_FIXED of a page's text, the
    page is a variant of others and keeps its text."""
    plain = [b for b in page.blocks if not b.chrome]
    left = [b for b in plain if not b.form] or plain
    if any(b.article for b in left):
        left = [b for b in left if b.article]
    slots = [b for b in left if text_token(b) not in template]
    if sum(len(b.text) for b in slots) < (1 - MOST_FIXED) * sum(len(b.text) for b in left):
        slots = left
    return "\n".join(b.text for b in slots)


def contents(pages: DataFrame) -> DataFrame:
    """(host, content, tokens): the tokens of each different content of a host. Pages with
    the same blocks outside chrome elements are one content, whatever surrounds them."""
    item = pa.struct([("token", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("text", pa.bool_()), ("article", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, size, flat = [], [0], []
            for source in b.column("html").to_pylist():
                page = parse(source or "")
                keys.append(token(*(f"{x.path} {x.text}" for x in page.blocks if not x.chrome)))
                flat += [(t, *rest) for t, rest in page_tokens(page).items()]
                size.append(len(flat))
            cols = list(zip(*flat, strict=True)) or [()] * 5
            tokens = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, item, strict=True)], fields=list(item))
            lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), tokens)
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page"), pa.array(keys, pa.int64()), lists], names=["host", "page", "content", "tokens"])

    found = pages.mapInArrow(run, "host long, page long, content long, tokens array<struct<token: long, n: int, place: int, text: boolean, article: boolean>>")
    return found.groupBy("host", "content").agg(F.min_by("tokens", "page").alias("tokens"))


def occurrences(content: DataFrame) -> DataFrame:
    """(host, token, pages, va, vb, first, text, article): per host and token the number of
    contents, a 128-bit fingerprint of the occurrence vector, and the sum of first places.
    The fingerprint combines hashes of (content, occurrences) by xor and by a sum, so equal
    vectors have equal fingerprints."""
    t = F.col("t")
    rows = content.select("host", "content", F.explode("tokens").alias("t"))
    rows = rows.select(
        "host", t["token"].alias("token"), t["place"].alias("place"), t["text"].alias("text"), t["article"].alias("article"),
        F.xxhash64("content", t["n"]).alias("x"), F.pmod(F.xxhash64("content", t["n"], F.lit(1)), F.lit(1 << 32)).alias("y"),
    )
    return rows.groupBy("host", "token").agg(
        F.count("*").alias("pages"),
        F.expr("bit_xor(x)").alias("va"),
        F.sum("y").alias("vb"),
        F.sum("place").alias("first"),
        F.max("text").alias("text"),
        F.max("article").alias("article"),
    )


def nested(places: dict, spans: dict) -> dict:
    """Depth of each class that nests. ``spans`` has each class's first and last place; in
    order of these, a class must lie inside the innermost open one or after it. One that
    crosses an open class is invalid and left out."""
    depth, open_ends = {}, []
    for name, (lo, hi) in sorted(spans.items(), key=lambda x: (x[1][0], -x[1][1], places[x[0]])):
        while open_ends and open_ends[-1] < lo:
            open_ends.pop()
        if not open_ends or hi <= open_ends[-1]:
            depth[name] = len(open_ends)
            open_ends.append(hi)
    return depth


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, token, class, depth): the text tokens that each host's template fixes.

    Only tokens that enough contents of a host hold are looked at. They are few: a page of m
    tokens leaves at most m / SHARE of them, so one host's template is one small group.
    """
    content = scratch.save(contents(pages))
    sizes = content.groupBy("host").agg(F.count("*").alias("all"))
    enough = (F.col("pages") >= PAGES) & (F.col("pages") >= SHARE * F.col("all"))
    frequent = occurrences(content).join(sizes, "host").where(enough)

    def nest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(place=group["first"] / group["pages"], **{"class": group.groupby(["va", "vb"]).ngroup()})
        spans = group.groupby("class")["place"].agg(["min", "max"])
        at = group.groupby("class")["token"].min().to_dict()
        depth = nested(at, dict(zip(spans.index, zip(spans["min"], spans["max"], strict=True), strict=True)))
        group = group.assign(depth=group["class"].map(depth), **{"class": group["va"]})
        inside = group["article"] & ((group["pages"] < ARTICLE_PAGES) | (group["pages"] < ARTICLE_SHARE * group["all"]))
        return group.loc[group["text"] & ~inside & group["depth"].notna(), ["host", "token", "class", "depth"]].astype({"depth": "int64"})

    return frequent.groupBy("host").applyInPandas(nest, "host long, token long, class long, depth long")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    Blocks are separated by block-level tags, character references are decoded, white space
    inside a block becomes one space, blocks are joined by one line feed; nothing is cut.
    Null or empty html gives an empty text. Rows without a host share one template group.
    Repeated rows and other copies count once for the template and give repeated results;
    extra columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "html")
    host, _ = host_and_path(F.col("url"))
    ready = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.xxhash64(host).alias("host"),
        F.xxhash64("page_id", "html").alias("page"),
        F.col("html").cast("string").alias("html"),
    )
    fixed = scratch.save(templates(ready, scratch))
    schema = "page_id long, url string, text string"

    def texts(b: pa.RecordBatch, own: Iterator[set[int]]) -> pa.RecordBatch:
        found = [main_text(parse(source or ""), tokens) for source, tokens in zip(b.column("html").to_pylist(), own, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    if fixed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known: dict[int, set[int]] = {}
        for r in fixed.select("host", "token").toLocalIterator():
            known.setdefault(r.host, set()).add(r.token)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield texts(b, (known.get(h, set()) for h in b.column("host").to_pylist()))

        out = ready.select("page_id", "url", "host", "html").mapInArrow(run, schema)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield texts(b, (set(t or ()) for t in b.column("tokens").to_pylist()))

        by_host = fixed.groupBy("host").agg(F.collect_list("token").alias("tokens"))
        out = ready.join(by_host, "host", "left").select("page_id", "url", "html", "tokens").mapInArrow(run, schema)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
