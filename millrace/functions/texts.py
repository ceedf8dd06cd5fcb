"""Text, hash, date and validation functions as columns."""

from __future__ import annotations

import difflib
import hashlib
import hmac
import html as markup
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# -- built from SQL functions

#: Class names of the documentation's navigation headers and figures, and what
#: stored passwords of each kind begin with.
NAV_CLASS, FIGURE_CLASS = "navheader", "figure"
EXTERNAL, HASH_PREFIXES = "oauth", (("pbkdf2_", "regular"), ("sha1$", "old hash"))


def squeeze(text: Column) -> Column:
    """White space runs as one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def has_cjk(text: Column) -> Column:
    return F.rlike(text, F.lit("[\\u4e00-\\u9fff]"))


def split_title(title: Column) -> tuple[Column, Column]:
    """(author, title) around the first ASCII or full-width colon; no author without one."""
    parts = F.split(title, r"\s*[:：]\s*", 2)
    two = F.size(parts) == 2
    return F.when(two, F.trim(F.element_at(parts, 1))).otherwise(""), F.when(two, F.trim(F.element_at(parts, -1))).otherwise(F.trim(title))


def page_title(html: Column) -> Column:
    """What stands between a title tag and its end tag; empty without any. Tags are told by
    their places: a page is a list of what follows each sign, name first."""
    parts = F.split(html, "<")
    name = lambda p: F.lower(F.rtrim(F.substring_index(p, ">", 1), F.lit(" \t\n\x0b\f\r")))
    n = F.size(parts)
    pairs = F.arrays_zip(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(parts, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    held = lambda x: F.contains(x["a"], F.lit(">")) & F.contains(x["b"], F.lit(">")) & (name(x["a"]) == "title") & (name(x["b"]) == "/title")
    texts = F.filter(F.transform(F.filter(pairs, held), lambda x: F.substr(x["a"], F.instr(x["a"], ">") + 1)), lambda t: t != "")
    return F.coalesce(F.try_element_at(texts, F.lit(1)), F.when(html.isNotNull(), ""))


def without_nav_header(html: Column) -> Column:
    """What follows the end of the navigation header, if there is one."""
    mark = F.instr(html, f'class="{NAV_CLASS}"')
    behind = F.substr(html, mark, F.length(html))
    end = F.instr(behind, "</div>")
    rest = F.substr(behind, end + F.lit(len("</div>")), F.length(behind))
    return F.when((mark > 0) & (end > 0) & (rest != ""), rest).otherwise(html)


def widen_figures(html: Column, classes: str) -> Column:
    """Adds classes to the divisions that hold figures."""
    return F.regexp_replace(html, f'(?i)(<div\\b[^<>]*?class="{FIGURE_CLASS})(?=")', f"$1 {classes}")


def first_words(text: Column, n: int) -> Column:
    w = F.split(F.trim(text), r"\s+")
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(" …"))).otherwise(F.array_join(w, " "))


def mask_at(address: Column) -> Column:
    return F.replace(address, F.lit("@"), F.lit(" at "))


def join_and_or(items: Column, word: str) -> Column:
    """``a, b and c``; a single item is itself."""
    head = F.array_join(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return F.when(F.size(items) == 0, "").when(F.size(items) == 1, last).otherwise(F.concat(head, F.lit(f" {word} "), last))


def url_safe_base64(data: Column) -> Column:
    return F.translate(F.base64(data), "+/", "-_")


def url_path(url: Column) -> Column:
    """The URL without scheme and host; / if nothing is left."""
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.when(rest == "", "/").otherwise(rest)


def content_type(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(header, ";", 1)))


def short_id(key: Column) -> Column:
    """16 hex digits that stand for a key in a message id."""
    return F.substring(F.md5(key.cast("string")), 1, 16)


def fallback(text: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), other)


def client_address(remote: Column, forwarded: Column, proxies: list[str]) -> Column:
    """The forwarded address counts only if a known proxy sends it."""
    return F.when(remote.isin(*proxies) & forwarded.isNotNull(), forwarded).otherwise(remote)


def password_class(stored: Column) -> Column:
    """By prefix; 64 leading digits and lower-case letters are some hash of another make."""
    out = F.when(stored == EXTERNAL, "external")
    for prefix, name in HASH_PREFIXES:
        out = out.when(stored.startswith(prefix), name)
    plain = F.length(F.regexp_extract(stored, "^[a-z0-9]+", 0)) >= 64
    return out.when(plain, "unknown hash").otherwise("unknown")


def date_span(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws(" – ", start.cast("string"), end.cast("string")))


def place(online: Column, city: Column, state: Column, country: Column) -> Column:
    return F.when(online, "online").otherwise(F.concat_ws(", ", city, F.nullif(state, F.lit("")), country))


def parsed_date(text: Column, pattern: str, default: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit(pattern)), default)


def valid_user_name(name: Column) -> Column:
    return F.lower(name).rlike(r"^[a-z0-9.-]+$")


#: Key types that are accepted.
KEY_TYPES = ("ecdsa-sha2-nistp256", "ecdsa-sha2-nistp384", "ecdsa-sha2-nistp521", "ssh-ed25519", "ssh-rsa")


def valid_ssh_keys(text: Column) -> Column:
    """Each line: a known type, a base64 key, at most a comment."""
    def line(k: Column) -> Column:
        p = F.split(F.trim(k), r"\s+")
        body = F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(""))
        return F.size(p).between(2, 3) & F.element_at(p, 1).isin(*KEY_TYPES) & body.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(body) % 4 == 0)
    return F.forall(F.split(text, r"\r\n|\r|\n"), line)


def user_name_candidates(first: Column, last: Column, numbered: int = 100) -> Column:
    """first + initial, initial + last, then first + initial + 0, 1, ...; 30 characters at most."""
    f, l = F.lower(first), F.lower(last)
    base = F.concat(f, F.left(l, F.lit(1)))
    many = F.transform(F.sequence(F.lit(0), F.lit(numbered - 1)), lambda n: F.concat(base, n.cast("string")))
    return F.transform(F.concat(F.array(base, F.concat(F.left(f, F.lit(1)), l)), many), lambda u: F.left(u, F.lit(30)))


# -- in Arrow batches, where SQL has no such function

@F.pandas_udf(T.StringType())
def without_references(texts: pd.Series) -> pd.Series:
    """Character references decoded once, by name or number, also those without a semicolon."""
    return texts.map(lambda t: None if t is None else markup.unescape(t))


@F.pandas_udf(T.StringType())
def slugify(texts: pd.Series) -> pd.Series:
    """ASCII letters and digits joined by hyphens; accents are dropped."""
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", plain.lower())).strip("-_")
    return texts.map(one)


@F.pandas_udf(T.StringType())
def changed_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified difference without file and place lines."""
    def one(a: str | None, b: str | None) -> str:
        lines = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), n=1, lineterm=""))
        # two lines of file names, then only places start with this sign: all others are marked
        return "\n".join(x for x in lines[2:] if not x.startswith("@@"))
    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


@F.pandas_udf(T.StringType())
def signed(messages: pd.Series, keys: pd.Series) -> pd.Series:
    """HMAC-SHA512 in hex."""
    return pd.Series([hmac.new(k.encode(), m.encode(), hashlib.sha512).hexdigest() if m is not None and k is not None else None for m, k in zip(messages, keys, strict=True)])


_FACET = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("value", T.StringType())])


@F.pandas_udf(T.ArrayType(_FACET))
def facets(texts: pd.Series) -> pd.Series:
    """Links and hashtags of a post, at UTF-8 byte offsets; a tag's offsets take its sign in."""
    link = re.compile(rb"https?://[^\s]+")
    def tags(raw: bytes) -> Iterator[tuple[int, int]]:
        at = raw.find(b"#")
        while at >= 0:
            end = at + 1
            while end < len(raw) and (raw[end : end + 1].isalnum() or raw[end] == 0x5F):
                end += 1
            if end > at + 1 and raw[at - 1 : at].isspace():
                yield at, end
            at = raw.find(b"#", end)
    def one(t: str | None) -> list[dict]:
        raw = (t or "").encode()
        found = [("link", m.start(), m.end(), m.start()) for m in link.finditer(raw)] + [("tag", a, b, a + 1) for a, b in tags(raw)]
        return [{"kind": kind, "start": a, "stop": b, "value": raw[v:b].decode("utf-8", "replace")} for kind, a, b, v in found]
    return texts.map(one)


@F.pandas_udf(T.StringType())
def plain_markdown(texts: pd.Series) -> pd.Series:
    """A small markdown subset as clean HTML: paragraphs, emphasis, code, and links whose
    target names a scheme. All other markup is escaped; images stay as text."""
    import html

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        s = re.sub(r"(?<!!)\[([^\]]+)\]\(([^)\s]+)\)", lambda m: f'<a href="{m[2].replace(chr(34), "&quot;")}">{m[1]}</a>' if re.match(r"https?:|mailto:", m[2]) else m[1], s)
        s = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", s)
        return re.sub(r"\*([^*]+)\*", r"<em>\1</em>", s)

    return texts.map(lambda t: "".join(f"<p>{inline(p.strip())}</p>" for p in re.split(r"\n\s*\n", t or "") if p.strip()))
