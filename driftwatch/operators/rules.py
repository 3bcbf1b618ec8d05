"""Threat rules over text: hits, scores, verdicts, indicators, reasoning.

All rules are tested in one projection. A rule's pattern runs only on texts
that contain the literals every match must have, which most do not; these are
looked for together, in one pass over the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.literals import candidates
from driftwatch.functions.text import fixed, unicode_pattern
from driftwatch.functions.threat_rules import RULES, SUSPICIOUS_KEYWORDS, THREAT_CATEGORIES, Rule, required_literals

CONTEXT_CHARS = 50


def _quoted(value: str) -> str:
    """A text as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(text: Column) -> Column:
    """Lower case, with the letters that only case-fold to ASCII mapped to it."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "İıſK"])
    return F.lower(F.when(odd, F.translate(text, "İıſK", "iisk")).otherwise(text))


def _hit(rule: Rule, text: str) -> str:
    """SQL text: the rule's index where it matches, else null."""
    return f"CASE WHEN array_contains(_may, {rule.index}) AND `{text}` RLIKE {_quoted(unicode_pattern(rule.pattern))} THEN {rule.index} END"


def rule_hits(df: DataFrame, text: str = "text", categories: tuple[str, ...] | None = None, rules=RULES) -> DataFrame:
    """Adds ``hits``: indexes of the rules that match, in rule order.

    One pass over the text finds the rules whose literals it holds; only their patterns run. The tests are written as
    SQL text because one expression per rule would take longer to build than to run.
    """
    chosen = [r for r in rules if categories is None or r.category in categories]
    may = candidates(_folded(F.col(text)), [(r.index, required_literals(r.pattern)) for r in chosen])
    tested = F.expr(f"array_sort(array_compact(array({', '.join(_hit(r, text) for r in chosen)})))") if chosen else F.array().cast("array<int>")
    return df.withColumn("_may", may).withColumn("hits", tested).drop("_may")


def _table(rules, value, kind: str = "string") -> Column:
    """A constant array with one entry per rule, folded when the plan is optimised."""
    texts = [str(value(r)) for r in rules]
    return F.split(F.lit("\x1f".join(texts)), "\x1f").cast(f"array<{kind}>")


def rule_matches(
    df: DataFrame, key: str, text: str = "text", categories: tuple[str, ...] | None = None, rules=RULES
) -> DataFrame:
    """One row per document and matching rule, with the number of matches."""
    hits = rule_hits(df.select(key, text), text, categories, rules)
    # An inner explode lets Spark infer a filter on ``hits`` and push it below the
    # projection, which would test every rule several times.
    rows = hits.select(key, text, F.explode_outer("hits").alias("_i")).filter(F.col("_i").isNotNull())
    pattern = _table(rules, lambda r: unicode_pattern(r.pattern))[F.col("_i") - 1]
    return rows.select(
        key,
        _table(rules, lambda r: r.category)[F.col("_i") - 1].alias("category"),
        _table(rules, lambda r: r.rule_no, "int")[F.col("_i") - 1].alias("rule_no"),
        _table(rules, lambda r: r.score, "double")[F.col("_i") - 1].alias("score"),
        _table(rules, lambda r: r.label)[F.col("_i") - 1].alias("label"),
        F.size(F.regexp_extract_all(F.col(text), pattern, F.lit(0))).alias("match_count"),
    )


def _category_hits(category: str, rules) -> Column:
    indexes = [r.index for r in rules if r.category == category]
    return F.filter("hits", lambda i: i.between(min(indexes), max(indexes)))


def rule_scores(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds the score sum per category, the total and the leading category.

    Sums are rounded to 9 digits so that thresholds do not hang on float noise.
    """
    scores = _table(rules, lambda r: r.score, "double")

    def total(category: str) -> Column:
        return F.round(
            F.aggregate(_category_hits(category, rules), F.lit(0.0), lambda acc, i: acc + scores[i - 1]), 9
        )

    staged = df.withColumns({f"{c}_score": total(c) for c in (*THREAT_CATEGORIES, "benign")})
    threat = [F.col(f"{c}_score") for c in THREAT_CATEGORIES]
    top = F.greatest(*threat)
    leading = reduce(
        lambda acc, c: acc.when(F.col(f"{c}_score") == top, c), THREAT_CATEGORIES, F.when(top <= 0, "unknown")
    )
    present = F.array_compact(F.array(*[F.when(F.col(f"{c}_score") > 0, c) for c in THREAT_CATEGORIES]))
    return staged.withColumns(
        {
            "total_score": F.round(reduce(lambda a, b: a + b, [*threat, F.col("benign_score")]), 9),
            "threat_category": leading,
            "categories": present,
        }
    )


def _first(values: Column | str, limit: int | None) -> Column:
    """The first ``limit`` entries of an array, all without a limit."""
    values = F.col(values) if isinstance(values, str) else values
    return values if limit is None else F.slice(values, 1, limit)


def rule_verdict(df: DataFrame, as_coded: bool = False, rules=RULES, max_labels: int | None = None) -> DataFrame:
    """Adds ``rule_label``, ``rule_confidence`` and ``triggered_rules``, the labels of the rules that match.

    All labels are kept unless ``max_labels`` says how many. A total below zero (benign signs only) gives confidence 0; ``as_coded``
    takes its magnitude instead.
    """
    raw = F.abs("total_score") if as_coded else F.greatest(F.lit(0.0), F.col("total_score"))
    staged = df.withColumn("_c", F.least(F.lit(1.0), raw))
    label = F.when(F.col("_c") >= 0.7, "defacement").when(F.col("_c") >= 0.4, "unclear").otherwise("benign")
    boosted = F.when(F.size("categories") > 2, F.least(F.lit(1.0), F.col("_c") * 1.2)).otherwise(F.col("_c"))
    labels = _table(rules, lambda r: r.label)
    return staged.withColumns(
        {
            "rule_label": label,
            "rule_confidence": boosted,
            "triggered_rules": F.transform(_first("hits", max_labels), lambda i: labels[i - 1]),
        }
    ).drop("_c")


def match_context(text: Column, matched: Column, size: int = CONTEXT_CHARS) -> Column:
    """The first occurrence with ``size`` characters around it, dots where cut."""
    at = F.position(matched, text)
    start = F.greatest(at - size, F.lit(1))
    stop = F.least(at + F.length(matched) + size - 1, F.length(text))
    cut = F.concat(
        F.when(start > 1, "...").otherwise(""),
        F.substring(text, start, stop - start + 1),
        F.when(stop < F.length(text), "...").otherwise(""),
    )
    return F.when(at == 0, "").otherwise(cut)


def threat_indicators(
    df: DataFrame, text: str = "text", limit: int | None = None, rules=RULES, per_rule: int | None = None
) -> DataFrame:
    """Adds ``indicators``: the matches of every threat rule, in rule order and then in text order.

    All matches are kept unless ``per_rule`` (of each rule) or ``limit`` (of each text) says how many.
    """
    patterns = _table(rules, lambda r: unicode_pattern(r.pattern))
    categories = _table(rules, lambda r: r.category)
    numbers = _table(rules, lambda r: r.rule_no, "int")
    scores = _table(rules, lambda r: r.score, "double")
    threats = [r.index for r in rules if r.category != "benign"]

    def found(i: Column) -> Column:
        matches = F.regexp_extract_all(F.col(text), patterns[i - 1], F.lit(0))
        return F.transform(
            _first(matches, per_rule),
            lambda m: F.struct(
                categories[i - 1].alias("category"),
                numbers[i - 1].alias("rule_no"),
                scores[i - 1].alias("score"),
                m.alias("matched_text"),
            ),
        )

    threat_hits = F.filter("hits", lambda i: i <= max(threats))
    listed = F.flatten(F.transform(threat_hits, found))
    return df.withColumn("indicators", _first(listed, limit))


def rule_reasoning(df: DataFrame, max_labels: int | None = None) -> DataFrame:
    """Adds ``rule_reasoning``: the verdict in sentences, with all rule labels or the first ``max_labels``."""
    c = F.col("rule_confidence")
    shown = F.concat(F.lit(" ("), fixed(c), F.lit(")"))
    opening = (
        F.when(c >= 0.8, "High confidence threat detected")
        .when(c >= 0.5, "Moderate confidence threat detected")
        .otherwise("Low confidence assessment")
    )
    closing = (
        F.when(c >= 0.9, "CRITICAL: Immediate action required")
        .when(c >= 0.7, "HIGH: Prompt investigation needed")
        .when(c >= 0.5, "MEDIUM: Review recommended")
    )
    parts = [
        F.concat(opening, shown),
        F.when(F.col("threat_category") != "unknown", F.concat(F.lit("Primary threat type: "), "threat_category")),
        F.when(
            F.size("categories") > 1,
            F.concat(F.lit("Multiple threat indicators detected: "), F.array_join("categories", ", ")),
        ),
        F.when(
            F.size("triggered_rules") > 0,
            F.concat(F.lit("Key indicators: "), F.array_join(_first("triggered_rules", max_labels), ", ")),
        ),
        closing,
    ]
    return df.withColumn("rule_reasoning", F.concat_ws(". ", *parts))


def judge_text(df: DataFrame, text: str = "text", as_coded: bool = False, rules=RULES) -> DataFrame:
    """Hits, scores, verdict, indicators and reasoning of every row."""
    scored = rule_scores(rule_hits(df, text, rules=rules), rules)
    return rule_reasoning(threat_indicators(rule_verdict(scored, as_coded, rules), text, rules=rules))


def suspicious_keywords(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per document and suspicious word found in its lower-cased text."""
    low = df.select(key, F.lower(text).alias("_low"))
    words = F.array(*[F.when(F.contains("_low", F.lit(w)), w) for w in SUSPICIOUS_KEYWORDS])
    found = low.select(key, F.explode_outer(F.array_compact(words)).alias("pattern"))
    return found.filter(F.col("pattern").isNotNull()).withColumn("risk_level", F.lit("high"))
