"""Vulnerability numbers and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric weights of the published base score, version 3.0.
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_CHANGED": {"N": 0.85, "L": 0.68, "H": 0.5},
}
METRICS = ("AV", "AC", "PR", "UI", "S", "C", "I", "A")


def cve_number(cve: Column, digits: int = 7) -> Column:
    """100000 * year + number; longer numbers run over into the year. Null if malformed or of
    more than ``digits`` digits behind the year; 18 still fit."""
    part = lambda n: F.regexp_extract(cve, rf"^(\d{{4}})-(\d{{4,{digits}}})$", n)
    return F.when(part(1) != "", part(1).try_cast("bigint") * 100000 + part(2).try_cast("bigint"))


def vector(metrics: dict[str, Column]) -> Column:
    """``AV:N/AC:L/...``; null without an attack vector."""
    text = F.concat_ws("/", *[F.concat(F.lit(f"{m}:"), metrics[m]) for m in METRICS])
    return F.when(F.coalesce(metrics["AV"], F.lit("")) != "", text)


def _weight(table: str, value: Column) -> Column:
    out = F.lit(None).cast("double")
    for key, weight in WEIGHTS[table].items():
        out = F.when(value == key, F.lit(weight)).otherwise(out)
    return out


def base_score(vec: Column) -> Column:
    """The base score of a vector, -1 if it is missing or has unknown values."""
    get = lambda m: F.regexp_extract(vec, rf"(?:^|/){m}:([A-Z])(?:/|$)", 1)
    changed = get("S") == "C"
    lost = 1 - (1 - _weight("CIA", get("C"))) * (1 - _weight("CIA", get("I"))) * (1 - _weight("CIA", get("A")))
    impact = F.when(changed, 7.52 * (lost - 0.029) - 3.25 * F.pow(lost - 0.02, F.lit(15))).otherwise(6.42 * lost)
    rights = F.when(changed, _weight("PR_CHANGED", get("PR"))).otherwise(_weight("PR", get("PR")))
    ease = 8.22 * _weight("AV", get("AV")) * _weight("AC", get("AC")) * rights * _weight("UI", get("UI"))
    raw = F.least(F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease), F.lit(10.0))
    up = F.ceil(F.round(raw * 100000) / 10000).cast("double") / 10
    known = get("S").isin("U", "C")
    return F.coalesce(F.when(known & (impact <= 0), 0.0).when(known, up), F.lit(-1.0))
