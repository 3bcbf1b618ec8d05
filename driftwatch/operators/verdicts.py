"""Model prompts as a column and model answers as verdict columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt formats. Placeholders in braces are filled per row.
PROMPT_FORMATS = {
    "general_analysis": """Please analyze the following website content for potential defacement:

WEBSITE URL: {url}
WEBSITE CONTEXT: {site_context}

CHANGED CONTENT:
{changed_content}

STATIC CONTEXT (unchanged content for reference):
{static_context}

PREVIOUS CLASSIFICATION (if any): {previous_classification}

Please analyze this content and respond with a JSON object containing:
{{
    "classification": "benign|defacement|unclear",
    "confidence": 0.0-1.0,
    "reasoning": "detailed explanation of your analysis",
    "risk_indicators": ["list", "of", "specific", "risk", "indicators"],
    "benign_indicators": ["list", "of", "indicators", "suggesting", "legitimate", "change"],
    "recommended_action": "monitor|alert|investigate|ignore",
    "severity": "low|medium|high|critical"
}}""",
    "content_injection": """Analyze this content for potential code injection or malicious script insertion:

WEBSITE: {url}
TECHNICAL CONTEXT: {site_context}

NEW/CHANGED CODE:
{changed_content}

EXISTING CODE CONTEXT:
{static_context}

Focus on technical indicators of malicious injection. Respond with JSON analysis.""",
    "visual_defacement": """Analyze these visual changes for potential defacement:

WEBSITE: {url}
VISUAL CONTEXT: {site_context}

VISUAL CHANGES DETECTED:
{changed_content}

BASELINE VISUAL CONTEXT:
{static_context}

Analyze whether these visual changes indicate defacement or legitimate updates.""",
}
CUT_MARK = "\n\n[Content truncated due to length]"

LABELS = ("benign", "defacement", "unclear")
ANSWER_SCHEMA = (
    "classification string, confidence string, reasoning string, risk_indicators array<string>, "
    "benign_indicators array<string>, recommended_action string, severity string, _bad string"
)


def prompt_text(
    df: DataFrame, prompt_type: str = "general_analysis", max_chars: int | None = None, static_items: int | None = None
) -> DataFrame:
    """Adds ``prompt`` from url, site_context, changed and static content, previous verdict.

    An unknown type uses the general format. Prompts are whole; ``max_chars`` cuts them with a mark, ``static_items``
    takes that many entries of the static content.
    """
    static = F.col("static_context") if static_items is None else F.slice("static_context", 1, static_items)
    layout = PROMPT_FORMATS.get(prompt_type, PROMPT_FORMATS["general_analysis"])
    previous = F.concat(
        F.lit("Previous: "), "previous_label", F.lit(" (confidence: "), F.col("previous_confidence").cast("string"), F.lit(")")
    )
    values = {
        "url": F.col("url"),
        "site_context": F.coalesce("site_context", F.lit("No additional context")),
        "changed_content": F.when(
            F.size("changed_content") > 0, F.array_join("changed_content", "\n\n")
        ).otherwise("No content changes detected"),
        "static_context": F.when(
            F.size("static_context") > 0, F.array_join(static, "\n\n")
        ).otherwise("No context available"),
        "previous_classification": F.coalesce(previous, F.lit("None")),
    }
    full = F.concat(*_fill(layout, values))
    if max_chars is None:
        return df.withColumn("prompt", full)
    staged = df.withColumn("_full", full)
    cut = F.concat(F.substring("_full", 1, max_chars), F.lit(CUT_MARK))
    return staged.withColumn("prompt", F.when(F.length("_full") > max_chars, cut).otherwise(F.col("_full"))).drop("_full")


def _fill(layout: str, values: dict[str, Column]) -> list[Column]:
    from string import Formatter

    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(layout):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name])
    return parts


def parse_verdicts(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds label, confidence, explanation and reasoning parsed from answer texts.

    The JSON runs from the first ``{`` to the last ``}``. Without braces the
    verdict is unclear at 0.5, with broken JSON unclear at 0.3.
    """
    found = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    staged = df.withColumn("_json", found).withColumn("_p", F.from_json("_json", ANSWER_SCHEMA, options))
    none, bad = F.col("_json") == "", F.col("_p._bad").isNotNull() | F.col("_p").isNull()
    label = F.lower("_p.classification")
    score = F.coalesce(F.col("_p.confidence").try_cast("double"), F.lit(0.5))
    explanation = F.coalesce("_p.reasoning", F.lit("No explanation provided"))

    def listed(name: str, title: str) -> Column:
        return F.when(F.size(name) > 0, F.concat(F.lit(f"{title}: "), F.array_join(name, ", ")))

    reasoning = F.concat_ws(
        "\n\n",
        explanation,
        listed("_p.risk_indicators", "Risk indicators"),
        listed("_p.benign_indicators", "Benign indicators"),
        F.concat(F.lit("Recommended action: "), F.coalesce("_p.recommended_action", F.lit("monitor"))),
        F.concat(F.lit("Severity: "), F.coalesce("_p.severity", F.lit("medium"))),
    )
    plain = F.concat(F.col(answer), F.lit("\n\nRecommended action: investigate\n\nSeverity: medium"))
    broken = F.concat(F.lit("JSON parsing error. Raw response: "), F.col(answer))
    return staged.withColumns(
        {
            "label": F.when(none | bad | ~label.isin(*LABELS), "unclear").otherwise(F.coalesce(label, F.lit("unclear"))),
            "confidence": F.when(none, 0.5).when(bad, 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))),
            "explanation": F.when(none, F.col(answer)).when(bad, "Failed to parse AI response").otherwise(explanation),
            "reasoning": F.when(none, plain).when(bad, broken).otherwise(reasoning),
        }
    ).drop("_json", "_p")


def error_verdicts(requests: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Every request with its verdict; unanswered requests are unclear at 0."""
    joined = requests.join(answers.select(key, "label", "confidence"), key, "left")
    return joined.withColumns(
        {
            "failed": F.col("label").isNull(),
            "label": F.coalesce("label", F.lit("unclear")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
        }
    )


def classification_request(df: DataFrame, max_blocks: int | None = None) -> DataFrame:
    """Adds ``changed_content``, ``static_context`` and ``site_context`` (JSON).

    Input has main content and text blocks of the new and the baseline version; all blocks are taken, or the first
    ``max_blocks``.
    """

    def parts(main: str, blocks: str) -> Column:
        head = F.when(F.coalesce(F.col(main), F.lit("")) != "", F.array(main)).otherwise(F.array().cast("array<string>"))
        listed = F.col(blocks) if max_blocks is None else F.slice(blocks, 1, max_blocks)
        return F.concat(head, F.coalesce(listed, F.array().cast("array<string>")))

    context = F.struct(
        "website_id", F.col("url").alias("website_url"), "website_name", "title", "meta_description", "word_count",
        F.col("baseline_main_content").isNotNull().alias("has_baseline"),
    )
    return df.withColumns(
        {
            "changed_content": parts("main_content", "text_blocks"),
            "static_context": parts("baseline_main_content", "baseline_text_blocks"),
            "site_context": F.to_json(context),
        }
    )
