"""Personal data spans by weak supervision.

Patterns propose spans: four fixed ones whose matches always stay, and looser ones. Five
labelers (pattern, check, gazetteer, context, surroundings) vote on each; expectation-
maximisation over all vote patterns of the corpus estimates how reliable they are, and the
posteriors train a logistic span classifier that decides on the loose matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
LABELERS = 5

# The patterns of base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser patterns.
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?(?:dot|DOT)\s?[\])}])\s?[A-Za-z0-9-]{1,63}){1,4}"
    r"|[A-Za-z0-9._%+-]{1,64}\s(?:at|AT)\s[A-Za-z0-9-]{1,63}(?:\s(?:dot|DOT)\s[A-Za-z0-9-]{1,63}){1,4}"
)
_PLAIN_CARD = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.])(?:(?:\+|00)[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")
_SPACED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,3}){3}(?![0-9.])")
_SPACED_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20.\x2d_/]{1,2}[0-9]{4}){3}(?![0-9])")

# Gazetteers and cue words.
_TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl ch at be pl ru cn jp in br ca au us eu".split())
_CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "7", "81", "82", "86", "90", "91")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
_FOR = {
    "email": "email e-mail mail contact write courriel correo kontakt",
    "ip": "ip address host server from login adresse direccion",
    "card": "card visa mastercard amex credit payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile cell fax telefon telephone telefono",
}
_FOR_WORDS = {k: frozenset(v.split()) for k, v in _FOR.items()}
_AGAINST = frozenset("version license licence isbn issn order invoice id number no token sha hash build release doi".split())
_CUE = re.compile(r"[A-Za-z-]+")

_WORTH_READING = r"[0-9@]|[\[({]\s?(?:at|AT)\s?[\])}]|\s(?:dot|DOT)\s"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(span: str) -> list[int]:
    """The numbers of a span in dots; one of more than three digits counts as 999. A text
    may hold runs of digits of any length, so no run is read as a number before its length is known."""
    runs = (p.lstrip("0") for p in re.findall(r"[0-9]+", span))
    return [int(p or "0") if len(p) <= 3 else 999 for p in runs]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each at sign with its local part, no further back than the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start, width = at, 64
        while True:
            piece = text[max(done, at - width) : at]
            start = at - (len(piece) - len(piece.rstrip(_LOCAL)))
            if start > max(done, at - width) or at - width <= done:
                break
            width *= 4
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and without overlap in a kind."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if max(_octets(m[0])) <= 255]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further proposals that overlap neither a base span nor one another. Matches of a
    pattern come in order, so one walk along the sorted spans before it finds overlaps."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for kind, pattern in ((0, _SPELLED), (1, _SPACED_IP), (2, _SPACED_CARD), (2, _CARD), (2, _PLAIN_CARD), (3, _PHONE), (3, _LOCAL_PHONE)):
        at, reach, new = 0, 0, []
        for m in pattern.finditer(text):
            a, b = m.span()
            if pattern is _CARD and not 13 <= b - a - m[0].count(" ") - m[0].count("-") <= 19:
                continue
            while at < len(taken) and taken[at][0] < b:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= a:
                new.append((a, b))
        taken = sorted(taken + new)
        out += [(kind, a, b) for a, b in new]
    return out


def votes(text: str, kind: int, start: int, end: int, fixed: bool) -> tuple[int, int]:
    """The labelers' votes (0 against, 1 none, 2 for) as base-3 digits, and a few features
    of the span as bits."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    by_pattern = 2 if fixed else 1
    if name == "card":
        check = 2 if 13 <= len(digits) <= 19 and luhn(digits) else 0
        known = 2 if digits.startswith(_ISSUERS) else 0
    elif name == "ip":
        parts = _octets(span)
        check = 2 if len(parts) == 4 and max(parts) <= 255 else 0
        known = 0 if parts[:1] == [0] or parts == [0, 0, 0, 0] else 2 if len(digits) > 6 else 1
    elif name == "phone":
        check = 2 if 9 <= len(digits) <= 15 else 0
        known = 2 if span.startswith("+") and digits.startswith(_CALLING) else 1
    else:
        tail = re.findall(r"[A-Za-z0-9-]+", span)[-1].lower()
        check = 2 if len(tail) > 1 and not tail.isdigit() and (fixed or tail in _TOP_LEVEL) else 0
        known = 2 if tail in _TOP_LEVEL else 1
    cues = [w.lower() for w in _CUE.findall(text[max(0, start - 40) : start])][-4:]
    context = 2 if not _FOR_WORDS[name].isdisjoint(cues) else 0 if not _AGAINST.isdisjoint(cues) else 1
    left, right = text[start - 1 : start], text[end : end + 1]
    around = 0 if left.isalnum() or right.isalnum() else 2 if left.strip() == "" and right.strip() == "" else 1
    code = 0
    for v in (by_pattern, check, known, context, around):
        code = code * 3 + v
    bits = (any(c in span for c in " -().")) + 2 * (len(span) > 16) + 4 * (left in "\"'=#/" and left != "")
    return code, bits


def pattern_id(kind: int, code: int, bits: int) -> int:
    return (kind * 3**LABELERS + code) * 8 + bits


def _unpack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits, rest = ids % 8, ids // 8
    code, kind = rest % 3**LABELERS, rest // 3**LABELERS
    vote = np.stack([code // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)], axis=1)
    return kind, vote, bits


def estimate_reliabilities(vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, table[labeler, truth, vote]) by EM, from a start in
    which the majority is trusted. A labeler without a vote says nothing either way."""
    score = (vote - 1).sum(axis=1)
    p = 1 / (1 + np.exp(-1.5 * score.astype(float)))
    table = np.ones((vote.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([count * (1 - p), count * p])
        prior = (weight.sum(axis=1) + 1) / (count.sum() + 2)
        for j in range(vote.shape[1]):
            for v in (0, 2):
                table[j, :, v] = weight[:, vote[:, j] == v].sum(axis=1) + 1
            table[j, :, ::2] /= table[j, :, ::2].sum(axis=1, keepdims=True)
        log = np.log(prior)[None, :] + sum(np.log(table[j][:, vote[:, j]]).T for j in range(vote.shape[1]))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return p, table


def train_classifier(kind: np.ndarray, vote: np.ndarray, bits: np.ndarray, p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Decision score of each pattern: ridge logistic regression on the posteriors."""
    columns = [np.ones(len(kind))] + [(kind == k).astype(float) for k in range(4)]
    columns += [(vote[:, j] == v).astype(float) for j in range(LABELERS) for v in (0, 2)]
    columns += [(bits >> b & 1).astype(float) for b in range(3)]
    x, w = np.stack(columns, axis=1), np.zeros(len(columns))
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = count * q * (1 - q) + 1e-9
        step = np.linalg.solve((x * s[:, None]).T @ x + np.eye(len(w)), x.T @ (count * (q - p)) + w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return x @ w


_SPANS = "array<struct<kind: int, start: long, stop: long, pattern: int>>"
_ITEM = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("pattern", pa.int32())])


def _proposed(texts: pa.Array) -> pa.Array:
    """(base, loose) of each text: lists of (kind, start, stop, pattern)."""
    worth = pc.fill_null(pc.match_substring_regex(texts, _WORTH_READING), False)
    base, loose = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
    for i in np.flatnonzero(worth.to_numpy(zero_copy_only=False)).tolist():
        text = texts[i].as_py()
        own = base_spans(text)
        for spans, out, fixed in ((own, base, True), (loose_spans(text, own), loose, False)):
            out[i] = [(k, s, e, pattern_id(k, *votes(text, k, s, e, fixed))) for k, s, e in sorted(spans)]
    as_items = lambda rows: pa.array([[dict(zip(("kind", "start", "stop", "pattern"), s, strict=True)) for s in r] for r in rows], pa.list_(_ITEM))
    return pa.StructArray.from_arrays([as_items(base), as_items(loose)], names=["base", "loose"])


def proposals(text: Column) -> Column:
    """A struct of base and loose spans of each whole text. Texts go to Python, spans come back."""
    return F.arrow_udf(_proposed, f"base {_SPANS}, loose {_SPANS}")(text.cast("string"))


def _accepted(found: DataFrame, spans: Column) -> list[int]:
    """The patterns of loose proposals that the classifier accepts, from the counts of all
    vote patterns in ``found``, whose column ``spans`` is a struct of base and loose."""
    counts = found.select(F.explode(F.concat(spans["base"], spans["loose"])).alias("s")).groupBy(F.col("s.pattern").alias("pattern")).count().orderBy("pattern").collect()
    if not counts:
        return []
    ids, n = np.array([r.pattern for r in counts]), np.array([float(r["count"]) for r in counts])
    kind, vote, bits = _unpack(ids)
    p, _ = estimate_reliabilities(vote, n)
    return ids[train_classifier(kind, vote, bits, p, n) >= 0].tolist()


def _taken(spans: Column, accepted: list[int]) -> Column:
    """Base spans and accepted loose ones, by kind and start."""
    take = F.array(*[F.lit(i) for i in accepted]).cast("array<int>")
    more = F.filter(spans["loose"], lambda s: F.array_contains(take, s.pattern))
    return F.array_sort(F.transform(F.concat(spans["base"], more), _plain))


def _plain(s: Column) -> Column:
    return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``find_spans`` replaced by its kind in brackets, and
    n_chars, if there is such a column, counted anew for texts that changed. Each row is
    written out with its proposals, so they are found once and no text is shuffled."""
    name = "spans"
    while name in docs.columns:
        name += "_"
    text = F.col("text")
    found = Scratch(docs.sparkSession, "pii").save(docs.withColumn(name, proposals(text)))
    spans = _taken(F.col(name), _accepted(found, F.col(name)))

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([None if t is None else replace_spans(t, [(s["kind"], s["start"], s["stop"]) for s in own]) for t, own in rows], pa.string())

    # only texts with spans go to Python
    hit = F.size(spans) > 0
    new = F.arrow_udf(run, "string")(F.when(hit, text.cast("string")), spans)
    out = found.withColumn("text", F.when(hit, new.cast(docs.schema["text"].dataType)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(name)


def replace_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span gives way to its kind in brackets; spans that overlap become one."""
    out, at = [], 0
    for start, stop, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, stop) in code points, ordered by kind
    as in KINDS and then start; ``spans`` are the base spans and the accepted loose ones.

    Votes are counted over all spans of ``docs``; there are at most 4 * 3^5 * 8 patterns, and
    only their counts reach the driver. Null and empty texts have no spans. Each row is
    judged by itself, repeated rows and null ids included; extra columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), proposals(F.col("text")).alias("spans"))
    found = Scratch(docs.sparkSession, "pii").save(found)
    spans = F.col("spans")
    accepted = _accepted(found, spans)
    return found.select("doc_id", F.transform(spans["base"], _plain).alias("base"), _taken(spans, accepted).alias("spans"))


def describe(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.stop)), ",")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[n(k) for k in range(4)], F.sha2(describe(F.col("base")), 256).alias("base_sha256"), describe(F.col("spans")).alias("spans"))
