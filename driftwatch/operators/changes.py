"""Comparison of two versions of a page and the verdict drawn from it.

Input rows carry ``old_*`` and ``new_*`` columns side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions import similarity as sim
from driftwatch.functions import text

# Change thresholds.
CONTENT_CHANGED, CONTENT_HIGH, CONTENT_CRITICAL = 0.85, 0.70, 0.50
STRUCTURE_CHANGED, STRUCTURE_HIGH = 0.90, 0.70
VISUAL_CHANGED, VISUAL_HIGH = 0.90, 0.60


def _missing(*names: str) -> Column:
    checks = [F.coalesce(F.col(n) == "", F.lit(True)) for n in names]
    out = checks[0]
    for check in checks[1:]:
        out = out | check
    return out


def content_compare(df: DataFrame) -> DataFrame:
    """Adds ``content_similarity`` and ``content_hash_changed`` (null if a hash is missing).

    Rows whose hashes differ are scored by their keywords, others are equal.
    """
    changed = F.when(~_missing("old_hash", "new_hash"), F.col("old_hash") != F.col("new_hash"))
    flagged = df.withColumn("content_hash_changed", changed)
    scored = sim.keyword_similarity(flagged, "old_text", "new_text", "_score")
    score = F.when(F.coalesce("content_hash_changed", F.lit(False)), F.col("_score")).otherwise(1.0)
    return scored.withColumn("content_similarity", score).drop("_score")


def structure_compare(df: DataFrame, signatures: bool = True) -> DataFrame:
    """Adds ``structure_similarity`` and ``structure_hash_changed``.

    With ``signatures`` rows whose hashes differ are scored by the overlap of the sets
    ``old_signatures`` and ``new_signatures``; otherwise they score 0.
    """
    changed = F.when(
        ~_missing("old_structure_hash", "new_structure_hash"),
        F.col("old_structure_hash") != F.col("new_structure_hash"),
    )
    score = sim.overlap(F.col("old_signatures"), F.col("new_signatures")) if signatures else F.lit(0.0)
    flagged = df.withColumn("structure_hash_changed", changed)
    differs = F.coalesce("structure_hash_changed", F.lit(False))
    return flagged.withColumn("structure_similarity", F.when(differs, score).otherwise(1.0))


def visual_hash_compare(df: DataFrame) -> DataFrame:
    """Adds ``visual_similarity``: 1 or 0, null if either hash is missing."""
    same = F.when(F.col("old_visual_hash") == F.col("new_visual_hash"), 1.0).otherwise(0.0)
    return df.withColumn("visual_similarity", F.when(~_missing("old_visual_hash", "new_visual_hash"), same))


def metadata_compare(df: DataFrame) -> DataFrame:
    """Adds ``metadata_changes``: which of title, description, word count moved."""

    def differs(field: str) -> Column:
        return F.coalesce(f"old_{field}", F.lit("")) != F.coalesce(f"new_{field}", F.lit(""))

    old_words = F.coalesce("old_word_count", F.lit(0))
    new_words = F.coalesce("new_word_count", F.lit(0))
    moved = F.abs(old_words - new_words) / F.greatest(old_words, F.lit(1)) > 0.1
    fields = F.array(
        F.when(differs("title"), "title"),
        F.when(differs("meta_description"), "meta_description"),
        F.when(moved, "word_count"),
    )
    return df.withColumn("metadata_changes", F.array_compact(fields))


def change_verdict(df: DataFrame) -> DataFrame:
    """Combine the comparisons into change types, risk, similarity and confidence."""
    content, structure, visual = (F.col(f"{p}_similarity") for p in ("content", "structure", "visual"))
    types = F.array_compact(
        F.array(
            F.when(content < CONTENT_CHANGED, "content"),
            F.when(structure < STRUCTURE_CHANGED, "structure"),
            F.when(visual < VISUAL_CHANGED, "visual"),
            F.when(F.size("metadata_changes") > 0, "metadata"),
        )
    )
    risk = F.greatest(
        F.when(content < CONTENT_CRITICAL, 4)
        .when(content < CONTENT_HIGH, 3)
        .when(content < CONTENT_CHANGED, 2)
        .otherwise(1),
        F.when(structure < STRUCTURE_HIGH, 3).when(structure < STRUCTURE_CHANGED, 2).otherwise(1),
        F.when(visual < VISUAL_HIGH, 3).otherwise(1),
    )
    mean = (content + structure + F.coalesce(visual, F.lit(0.0))) / F.when(visual.isNull(), 2).otherwise(3)

    def available(field: str, weight: float) -> Column:
        both = F.col(f"old_{field}").isNotNull() & F.col(f"new_{field}").isNotNull()
        return F.when(both, weight).otherwise(0.0)

    staged = df.withColumns({"_types": types, "_risk": risk, "similarity_score": mean})
    return staged.withColumns(
        {
            "change_type": F.when(F.size("_types") > 0, F.array_join("_types", ",")).otherwise("none"),
            "risk_level": F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("_risk")),
            "confidence": available("hash", 0.4) + available("structure_hash", 0.3) + available("visual_hash", 0.3),
            "has_changed": (F.col("similarity_score") < CONTENT_CHANGED) | (F.size("_types") > 0),
        }
    ).drop("_types", "_risk")


def change_summary(df: DataFrame) -> DataFrame:
    """Adds ``change_summary``, one sentence per aspect of the verdict."""
    size = (
        F.when(F.col("similarity_score") < 0.5, "Major content differences")
        .when(F.col("similarity_score") < 0.8, "Moderate content differences")
        .otherwise("Minor content differences")
    )
    detected = F.concat(F.lit("Changes detected: "), F.array_join(F.split("change_type", ","), ", "))
    sentence = F.concat_ws(". ", detected, size, F.concat(F.lit("Risk level: "), F.col("risk_level")))
    return df.withColumn(
        "change_summary", F.when(F.col("has_changed"), sentence).otherwise("No significant changes detected")
    )


def significant_change(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Quick comparison: keyword similarity, structure equality, title, word count."""
    scored = sim.keyword_similarity(df, "old_text", "new_text", "content_similarity")
    same = F.when(F.col("old_structure_hash") == F.col("new_structure_hash"), 1.0).otherwise(0.0)
    structure = F.when(_missing("old_structure_hash", "new_structure_hash"), 0.0).otherwise(same)
    title = F.coalesce("old_title", F.lit("")) != F.coalesce("new_title", F.lit(""))
    staged = scored.withColumns({"structure_similarity": structure, "title_changed": title}).withColumns(
        {
            "_content": F.col("content_similarity") < 1.0 - threshold,
            "_structure": F.col("structure_similarity") < 0.5,
        }
    )
    old_words, new_words = F.coalesce("old_word_count", F.lit(0)), F.coalesce("new_word_count", F.lit(0))
    summary = F.array_compact(
        F.array(
            F.when(F.col("title_changed"), "Title changed"),
            F.when(F.col("_content"), F.concat(F.lit("Content similarity: "), text.fixed(F.col("content_similarity")))),
            F.when(F.col("_structure"), "DOM structure changed"),
            F.when(
                F.abs(old_words - new_words) > 50,
                F.concat(F.lit("Word count changed: "), old_words, F.lit(" → "), new_words),
            ),
        )
    )
    return staged.withColumns(
        {
            "significant_change": F.col("_content") | F.col("_structure") | F.col("title_changed"),
            "change_summary": summary,
        }
    ).drop("_content", "_structure")
