"""Analyst feedback: rows, quality metrics, trends, summaries, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.operators.ensemble import lookup
from driftwatch.operators.metrics import at, before, seconds_between
from driftwatch.operators.sliced import running_sum, time_slice
from driftwatch.sources.tables import with_defaults

# Feedback domains and user-interface actions.
FEEDBACK_TYPES = (
    "classification_correction", "confidence_adjustment", "false_positive",
    "false_negative", "alert_feedback", "manual_review",
)
FEEDBACK_SOURCES = (
    "human_analyst", "automated_validation", "slack_interaction", "external_system", "self_correction",
)
ACTION_TYPES = {
    "false_positive": "false_positive",
    "confirm_defacement": "classification_correction",
    "mark_benign": "classification_correction",
    "needs_review": "manual_review",
}
ACTION_LABELS = {"false_positive": "benign", "confirm_defacement": "defacement", "mark_benign": "benign"}

QUALITY = ("precision", "recall", "f1_score", "false_positive_rate", "false_negative_rate")


def feedback_rows(submissions: DataFrame) -> DataFrame:
    """Feedback rows with the defaults of their type.

    A false positive was a defacement verdict that is benign; a false negative
    a benign verdict that is a defacement, sure to 0.9.
    """
    kind = F.col("feedback_type")
    prefix = F.when(kind == "false_positive", "feedback-fp-").when(kind == "false_negative", "feedback-fn-").otherwise("feedback-")
    subject = (
        F.when(kind == "false_positive", F.col("alert_id"))
        .when(kind == "false_negative", F.col("snapshot_id"))
        .otherwise(F.col("website_id"))
    )
    wrong = kind.isin("false_positive", "false_negative")
    return submissions.select(
        F.concat(prefix, subject.cast("string"), F.lit("-"), F.unix_seconds(F.col("created_at").cast("timestamp"))).alias("feedback_id"),
        "website_id", "snapshot_id", "alert_id",
        F.when(kind == "false_positive", "defacement")
        .when(kind == "false_negative", "benign")
        .otherwise(F.col("original_classification"))
        .alias("original_classification"),
        F.when(wrong, 0.0).otherwise(F.col("original_confidence")).alias("original_confidence"),
        kind.alias("feedback_type"),
        F.coalesce("feedback_source", F.lit("human_analyst")).alias("feedback_source"),
        F.when(kind == "false_positive", "benign")
        .when(kind == "false_negative", "defacement")
        .otherwise(F.col("corrected_classification"))
        .alias("corrected_classification"),
        F.when(kind == "false_negative", 0.9)
        .when(kind == "false_positive", F.lit(None).cast("double"))
        .otherwise(F.col("corrected_confidence"))
        .alias("corrected_confidence"),
        "created_at",
    )


def map_actions(actions: DataFrame, action: str = "action") -> DataFrame:
    """Adds the feedback type and corrected class of a user-interface action."""
    return actions.withColumns(
        {
            "feedback_type": lookup(F.col(action), ACTION_TYPES, "alert_feedback"),
            "corrected_classification": lookup(F.col(action), ACTION_LABELS, None),
        }
    )


def enrich(feedback: DataFrame, alerts: DataFrame) -> DataFrame:
    """Site, class and confidence of feedback from the alert it names.

    Without a matching alert the feedback keeps its own values, and only then are they filled with defaults.
    """
    feedback = with_defaults(feedback, {"original_classification": F.lit(None).cast("string"), "original_confidence": F.lit(None).cast("double")})
    side = alerts.select(
        F.col("id").alias("alert_id"), F.col("website_id").alias("_site"),
        F.col("classification_label").alias("_label"), F.col("confidence_score").alias("_score"),
    )
    return feedback.join(side, "alert_id", "left").withColumns(
        {
            "website_id": F.coalesce("_site", "website_id"),
            "original_classification": F.coalesce("_label", "original_classification", F.lit("unclear")),
            "original_confidence": F.coalesce("_score", "original_confidence", F.lit(0.0)),
        }
    ).drop("_site", "_label", "_score")


def _counts() -> list[Column]:
    kind = F.col("feedback_type")
    correction = kind == "classification_correction"
    return [
        F.count_if(correction).alias("_corrections"),
        F.count_if(correction & (F.col("corrected_classification") == "defacement")).alias("_tp"),
        F.count_if(kind == "false_positive").alias("_fp"),
        F.count_if(kind == "false_negative").alias("_fn"),
    ]


def _quality(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and error rates from the counts; 0 where undefined."""

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    total = F.col("_corrections") + fp + fn
    staged = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return staged.withColumns(
        {
            "f1_score": ratio(2 * p * r, p + r),
            "false_positive_rate": ratio(fp, total),
            "false_negative_rate": ratio(fn, total),
            "total_feedback_count": total,
        }
    ).drop("_corrections", "_tp", "_fp", "_fn")


def feedback_metrics(feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One row of detection quality over the days before ``as_of``."""
    recent = feedback.filter((F.col("created_at") > before(as_of, days * 24)) & (F.col("created_at") <= at(as_of)))
    return _quality(recent.agg(*_counts()))


def feedback_trends(feedback: DataFrame, as_of: str, periods: int = 12, days: int = 7) -> DataFrame:
    """Quality per period, oldest first (``period`` 1..n), zeros where empty."""
    age = seconds_between("created_at", at(as_of))
    numbered = (
        feedback.filter((F.col("created_at") > before(as_of, periods * days * 24)) & (F.col("created_at") <= at(as_of)))
        .withColumn("period", periods - F.floor(age / (days * 86_400)).cast("int"))
    )
    counted = numbered.groupBy("period").agg(*_counts())
    frame = feedback.sparkSession.range(1, periods + 1).select(F.col("id").cast("int").alias("period"))
    names = ("_corrections", "_tp", "_fp", "_fn")
    filled = frame.join(counted, "period", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    return _quality(filled)


def feedback_summary(feedback: DataFrame, as_of: str) -> DataFrame:
    """Counts by every type and source (zeros kept), the total and the last week."""
    week = F.count_if((F.col("created_at") > before(as_of, 168)) & (F.col("created_at") <= at(as_of)))
    counted = feedback.groupingSets(
        [[F.col("feedback_type")], [F.col("feedback_source")], []], F.col("feedback_type"), F.col("feedback_source")
    ).agg(F.count(F.lit(1)).alias("_n"), week.alias("_week"), F.grouping_id().alias("_set"))
    # grouping id: bit 1 for a rolled-up type, bit 0 for a rolled-up source
    named = counted.select(
        F.when(F.col("_set") == 1, "type").when(F.col("_set") == 2, "source").otherwise("total").alias("dimension"),
        F.coalesce("feedback_type", "feedback_source", F.lit("all")).alias("value"),
        "_n", "_week",
    )
    domain = [("type", v) for v in FEEDBACK_TYPES] + [("source", v) for v in FEEDBACK_SOURCES] + [("total", "all")]
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value")) for d, v in domain])
    frame = feedback.sparkSession.range(1).select(F.inline(rows))
    return frame.join(named, ["dimension", "value"], "left").select(
        "dimension", "value", F.coalesce("_n", F.lit(0)).alias("n_feedback"),
        F.coalesce("_week", F.lit(0)).alias("recent_count"),
        (F.coalesce("_week", F.lit(0)) / 7).alias("avg_daily_feedback"),
    )


def retrain_trigger(feedback: DataFrame, days: int = 7, threshold: int = 10) -> DataFrame:
    """Per feedback time: feedback of the ``days`` before it and whether it is enough.

    A running balance: feedback counts in at its time and out ``days`` later.
    """
    per_time = feedback.groupBy("created_at").agg(F.count(F.lit(1)).alias("_n"))
    leaves = per_time.select((F.col("created_at") + F.expr(f"INTERVAL '{days}' DAY")).alias("created_at"), (-F.col("_n")).alias("_n"))
    both = per_time.withColumn("_in", F.col("_n")).unionByName(leaves.withColumn("_in", F.lit(0).cast("long")))
    moves = both.groupBy("created_at").agg(F.sum("_n").alias("_move"), F.sum("_in").alias("new_feedback"))
    balance = running_sum(moves, [], ["created_at"], time_slice("created_at"), {"recent_feedback": F.col("_move")})
    return balance.filter(F.col("new_feedback") > 0).select(
        "created_at", "new_feedback", "recent_feedback", (F.col("recent_feedback") >= threshold).alias("retrain")
    )


def quality_recommendations(metrics: DataFrame, trends: DataFrame) -> DataFrame:
    """One row with the advice drawn from current metrics and the last three periods."""
    last = trends.orderBy(F.col("period").desc()).limit(3)
    scores = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "f1_score"))), lambda x: x["f1_score"]).alias("_f1"))
    f1 = F.col("_f1")
    falling = (F.size(f1) == 3) & (F.get(f1, F.lit(1)) <= F.get(f1, F.lit(0))) & (F.get(f1, F.lit(2)) <= F.get(f1, F.lit(1)))
    advice = F.array_compact(
        F.array(
            F.when(F.col("precision") < 0.8, "Consider adjusting classification thresholds to reduce false positives"),
            F.when(F.col("recall") < 0.8, "Review detection rules to improve coverage of defacement patterns"),
            F.when(
                F.col("false_positive_rate") > 0.1, "High false positive rate - review and refine classification criteria"
            ),
            F.when(falling, "F1 score declining - consider model retraining or prompt updates"),
        )
    )
    fine = F.array(F.lit("Performance metrics are within acceptable ranges"))
    return metrics.crossJoin(scores).select(F.when(F.size(advice) > 0, advice).otherwise(fine).alias("recommendations"))


def quality_report(feedback: DataFrame, as_of: str) -> DataFrame:
    """One row: current metrics, F1 trend, feedback totals and advice."""
    metrics, trends = feedback_metrics(feedback, as_of), feedback_trends(feedback, as_of)
    trend = trends.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("period", "f1_score"))), lambda x: x["f1_score"]).alias("f1_trend")
    )
    totals = feedback.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if((F.col("created_at") > before(as_of, 168)) & (F.col("created_at") <= at(as_of))).alias("recent_count"),
    )
    return metrics.crossJoin(trend).crossJoin(totals).crossJoin(quality_recommendations(metrics, trends))
