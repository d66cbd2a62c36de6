"""Ordered rules: at most one verdict a row, the first rule that holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CERTAIN, LIKELY = "certain", "likely"


@dataclass(frozen=True)
class Rule:
    """`graced` rules hold back on files that changed in the last `grace_minutes`."""

    code: str
    confidence: str
    holds: Column
    graced: bool = False


@dataclass(frozen=True)
class Policy:
    """What becomes of a disabled rule and of one below the wanted confidence: the row is clean ("stop") or the next rule is tried ("next")."""

    disabled: frozenset[str] = frozenset()
    least: str = LIKELY
    on_disabled: str = "next"
    on_unsure: str = "next"
    grace_minutes: int = 10


def judge(df: DataFrame, rules: list[Rule], policy: Policy = Policy(), modified: Column | None = None, now: Column | None = None) -> DataFrame:
    """df with rule, confidence and held_back (the rule that would hold but for the grace period)."""
    recent = F.lit(False) if modified is None or now is None else F.coalesce(F.unix_micros(now) - F.unix_micros(modified) < policy.grace_minutes * 60_000_000, F.lit(False))
    code, sure, held = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        off = r.code in policy.disabled
        unsure = policy.least == CERTAIN and r.confidence != CERTAIN
        if (off and policy.on_disabled == "next") or (not off and unsure and policy.on_unsure == "next"):
            continue
        holds = F.coalesce(r.holds, F.lit(False))
        wait = recent if r.graced else F.lit(False)
        found = F.lit(None).cast("string") if off or unsure else F.lit(r.code)
        level = F.lit(None).cast("string") if off or unsure else F.lit(r.confidence)
        code = F.when(holds & ~wait, found).when(holds & wait, F.lit(None).cast("string")).otherwise(code)
        sure = F.when(holds & ~wait, level).when(holds & wait, F.lit(None).cast("string")).otherwise(sure)
        held = F.when(holds & wait, found).when(holds, F.lit(None).cast("string")).otherwise(held)
    return df.withColumns({"rule": code, "confidence": sure, "held_back": held})


def text_rules(content: Column, size: Column, ext: Column) -> list[Rule]:
    """Empty and unreadable rules that text alone decides."""
    blank = (size <= 4096) & content.rlike(r"^\x{FEFF}?[\x00\x20\x09\x0A\x0D]*$")
    replaced = F.length(content) - F.length(F.replace(content, F.lit("�"), F.lit("")))
    control = F.length(content) - F.length(F.regexp_replace(content, r"[\x01-\x08\x0E-\x1A\x1C-\x1F\x7F]", ""))
    garbled = content.contains("\x00") | ((F.length(content) >= 64) & (control > 0.1 * F.length(content))) | ((replaced >= 8) & (replaced >= 0.02 * F.length(content)))
    json_like = ext.isin("json")
    parses = F.try_parse_json(content).isNotNull()
    unclosed = (F.length(F.regexp_replace(content, r"[^\[{]", "")) > F.length(F.regexp_replace(content, r"[^\]}]", "")))
    return [
        Rule("E01", CERTAIN, size == 0, graced=True),
        Rule("E02", CERTAIN, blank, graced=True),
        Rule("U09", LIKELY, garbled),
        Rule("U06", LIKELY, json_like & ~parses & unclosed, graced=True),
        Rule("U07", LIKELY, json_like & ~parses),
    ]
