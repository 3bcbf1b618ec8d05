"""The whole classification of changed texts as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.text import external_resources
from driftwatch.operators import ensemble, rules


def classify_snapshots(
    changed: DataFrame, answers: DataFrame, semantics: DataFrame | None = None, key: str = "id", text: str = "text"
) -> DataFrame:
    """Verdict, confidence, severity, actions and reasoning of every changed text.

    ``changed`` has the text, old and new element counts and content similarity;
    ``answers`` parsed model verdicts (label, confidence); ``semantics`` the
    similarity of the main content and the semantic risk. Rows without an
    answer or semantics are judged on the rest.
    """
    judged = rules.judge_text(changed, text)
    measured = judged.withColumns(
        {
            "category_count": F.size(F.array_distinct(F.col("indicators.category"))),
            "high_indicators": F.size(F.filter("indicators", lambda i: i["score"] > 0.8)),
            "external_resources": external_resources(F.col(text)),
        }
    ).drop(text, "hits")
    behaved = ensemble.behavior_score(ensemble.resource_anomaly(ensemble.structure_anomaly(measured)))
    model = answers.select(key, F.col("label").alias("llm_label"), F.col("confidence").alias("llm_confidence"))
    joined = behaved.join(model, key, "left")
    if semantics is None:
        joined = joined.withColumns(
            {"main_similarity": F.lit(None).cast("double"), "semantic_risk": F.lit(None).cast("string")}
        )
    else:
        joined = joined.join(semantics.select(key, "main_similarity", "semantic_risk"), key, "left")
    return ensemble.combine(joined)
