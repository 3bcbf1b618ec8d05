"""Queries over document text, fingerprints, prompts and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions import similarity as sim
from driftwatch.functions import text
from driftwatch.operators import fingerprints
from driftwatch.operators import verdicts as vd
from driftwatch.operators.sliced import lag_over
from driftwatch.plans import sqltext as q
from driftwatch.plans.registry import query


@query("clean_text", (), f"SELECT doc_id, {q.clean('text')} AS text FROM documents")
def clean_text(t):
    return t.documents.select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("normalize_text", (), f"SELECT doc_id, {q.normalized('text')} AS text FROM documents")
def normalize_text(t):
    return t.documents.select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query("extract_keywords", (), f"SELECT doc_id, coalesce(array_to_string({q.keywords('text')}, ' '), '') AS keywords FROM documents")
def extract_keywords(t):
    return t.documents.select("doc_id", F.array_join(text.extract_keywords(F.col("text")), " ").alias("keywords"))


@query("strip_dynamic", (), f"SELECT doc_id, {q.stripped('text')} AS text FROM documents")
def strip_dynamic(t):
    return t.documents.select("doc_id", text.strip_dynamic(F.col("text")).alias("text"))


@query("hash_content", (), f"""
, s AS (SELECT doc_id, length(text) AS n, {q.stripped('text')} AS x FROM documents)
SELECT doc_id, sha256(x) AS hash_value, 'sha256' AS hash_type, md5(x) AS md5_value, CAST(length(x) AS BIGINT) AS content_length, CAST(n AS BIGINT) AS original_length FROM s
""")
def hash_content(t):
    staged = t.documents.select("doc_id", text.strip_dynamic(F.col("text")).alias("_x"), F.length(F.col("text")).cast("long").alias("original_length"))
    return staged.select(
        "doc_id",
        text.content_digest(F.col("_x"), "sha256").alias("hash_value"),
        F.lit("sha256").alias("hash_type"),
        text.content_digest(F.col("_x"), "md5").alias("md5_value"),
        F.length("_x").cast("long").alias("content_length"),
        "original_length",
    )


@query("content_hash_simple", (), f"SELECT doc_id, sha256({q.clean('lower(text)')}) AS content_hash FROM documents")
def content_hash_simple(t):
    return t.documents.select("doc_id", F.sha2(text.clean_text(F.lower(F.col("text"))), 256).alias("content_hash"))


@query("hash_semantic", ("pages_injected",), f"""
, s AS (SELECT 'doc' AS kind, doc_id AS id, length(text) AS n, {q.semantic('text')} AS x FROM documents UNION ALL SELECT 'page', page_id, length(html), {q.semantic('html')} FROM pages_injected)
SELECT kind, id, sha256(x) AS hash_value, CAST(length(x) AS BIGINT) AS content_length, CAST(n AS BIGINT) AS original_length FROM s
""")
def hash_semantic(t):
    docs = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text"))
    pages = t.pages_injected.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    staged = docs.unionByName(pages).withColumn("_x", text.semantic_text(F.col("text")))
    return staged.select(
        "kind", "id", F.sha2("_x", 256).alias("hash_value"), F.length("_x").cast("long").alias("content_length"),
        F.length("text").cast("long").alias("original_length"),
    )


@query("exact_duplicates", (), f"""
, h AS (SELECT doc_id, sha256({q.stripped('text')}) AS content_hash FROM documents), g AS (SELECT content_hash, count(*) AS n_copies, min(doc_id) AS first_doc_id FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, content_hash, n_copies, first_doc_id FROM h JOIN g USING (content_hash)
""")
def exact_duplicates(t):
    """Documents sharing a fingerprint, with the size and first member of their group."""
    digest = text.content_digest(text.strip_dynamic(F.col("text")))
    return fingerprints.exact_duplicates(t.documents, "doc_id", digest)


@query("preprocess_embed", (), f"SELECT doc_id, {q.embed_text('text')} AS text FROM documents")
def preprocess_embed(t):
    return t.documents.select("doc_id", text.preprocess_embedding(F.col("text")).alias("text"))


@query("chunk_text", (), rf"""
, s AS (SELECT doc_id, text, regexp_split_to_array(text, '[.!?]+[{q.SPACE}]+') AS parts FROM documents WHERE length(text) > 1000),
r AS (SELECT doc_id, 1 AS i, CAST('' AS VARCHAR) AS cur, CAST(NULL AS VARCHAR) AS done, CAST(0 AS BIGINT) AS n FROM s
  UNION ALL SELECT r.doc_id, i + 1, CASE WHEN length(cur) + length(parts[i]) <= 1000 THEN cur || parts[i] || '. ' ELSE parts[i] || '. ' END,
    CASE WHEN length(cur) + length(parts[i]) > 1000 AND cur <> '' THEN trim(cur) END, n + CASE WHEN length(cur) + length(parts[i]) > 1000 AND cur <> '' THEN 1 ELSE 0 END
  FROM r JOIN s ON s.doc_id = r.doc_id WHERE i <= len(parts))
SELECT doc_id, CAST(0 AS BIGINT) AS chunk_no, text AS chunk FROM documents WHERE length(text) <= 1000
UNION ALL SELECT doc_id, n - 1, done FROM r WHERE done IS NOT NULL
UNION ALL SELECT r.doc_id, n, trim(cur) FROM r JOIN s ON s.doc_id = r.doc_id WHERE i = len(parts) + 1
""", recursive=True)
def chunk_text(t):
    return t.documents.select("doc_id", F.posexplode(text.chunk_text(F.col("text"))).alias("chunk_no", "chunk")).withColumn(
        "chunk_no", F.col("chunk_no").cast("long")
    )


@query("keyword_similarity", ("doc_pairs",), f"""
, k AS (SELECT *, list_distinct({q.keywords("coalesce(old_text, '')")}) AS a, list_distinct({q.keywords("coalesce(new_text, '')")}) AS b FROM doc_pairs)
SELECT pair_id, round(CASE WHEN coalesce(old_text, '') = '' OR coalesce(new_text, '') = '' THEN 0 ELSE {q.keyword_similarity('a', 'b')} END, 6) AS similarity FROM k
""")
def keyword_similarity(t):
    """Similarity of each document with the one before it; only keyword sets are shuffled."""
    docs = t.documents.select(F.col("doc_id").alias("pair_id"), "source", text.keyword_set(F.col("text")).alias("new"))
    pairs = lag_over(docs, ["source"], ["pair_id"], F.floor(F.col("pair_id") / 4096), {"old": F.col("new")})
    out = sim.keyword_similarity(pairs, "old", "new")
    return out.select("pair_id", F.round("similarity", 6).alias("similarity"))


PROMPT_VALUES = {
    "url": "'https://example.com/' || source",
    "site_context": "'{\"lang\":\"' || lang || '\"}'",
    "changed_content": "text",
    "static_context": "lang || chr(10) || chr(10) || source",
    "previous_classification": "CASE WHEN doc_id % 2 = 0 THEN 'Previous: benign (confidence: 0.8)' ELSE 'None' END",
}


def prompt_sql(kind: str) -> str:
    out = q.lit(vd.PROMPT_FORMATS[kind].replace("{{", "<<").replace("}}", ">>"))
    for name, value in PROMPT_VALUES.items():
        out = "concat(" + out.replace("{" + name + "}", f"', {value}, '") + ")" if "{" + name + "}" in out else out
    return f"replace(replace({out}, '<<', '{{'), '>>', '}}')"


for _kind in vd.PROMPT_FORMATS:
    _suffix = "" if _kind == "general_analysis" else f"_{_kind}"

    @query(f"llm_prompts{_suffix}", (), f"""
, p AS (SELECT doc_id, {prompt_sql(_kind)} AS prompt FROM documents)
SELECT doc_id, prompt FROM p
""")
    def llm_prompts(t, kind=_kind):
        even = F.col("doc_id") % 2 == 0
        rows = t.documents.select(
            "doc_id",
            F.concat(F.lit("https://example.com/"), "source").alias("url"),
            F.to_json(F.struct("lang")).alias("site_context"),
            F.array("text").alias("changed_content"),
            F.array("lang", "source").alias("static_context"),
            F.when(even, "benign").alias("previous_label"),
            F.when(even, 0.8).alias("previous_confidence"),
        )
        return vd.prompt_text(rows, kind).select("doc_id", "prompt")


PARSED_SQL = """
, j AS (SELECT doc_id, answer, regexp_extract(answer, '(?s)\\{.*\\}') AS body FROM verdicts),
g AS (SELECT *, CASE WHEN body = '' THEN 'none' WHEN NOT json_valid(body) THEN 'bad' ELSE 'ok' END AS k, CASE WHEN json_valid(body) THEN body ELSE '{}' END AS ok FROM j),
f AS (SELECT *, lower(json_extract_string(ok, '$.classification')) AS c, CAST(json_extract_string(ok, '$.confidence') AS DOUBLE) AS s, coalesce(json_extract_string(ok, '$.reasoning'), 'No explanation provided') AS r FROM g),
parsed AS (SELECT doc_id, CASE WHEN k = 'ok' AND c IN ('benign', 'defacement', 'unclear') THEN c ELSE 'unclear' END AS label,
  CASE k WHEN 'none' THEN 0.5 WHEN 'bad' THEN 0.3 ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), coalesce(s, 0.5))) END AS confidence,
  CASE k WHEN 'none' THEN answer WHEN 'bad' THEN 'Failed to parse AI response' ELSE r END AS explanation,
  CASE k WHEN 'none' THEN answer || chr(10) || chr(10) || 'Recommended action: investigate' || chr(10) || chr(10) || 'Severity: medium' WHEN 'bad' THEN 'JSON parsing error. Raw response: ' || answer
    ELSE r || chr(10) || chr(10) || 'Recommended action: monitor' || chr(10) || chr(10) || 'Severity: medium' END AS reasoning FROM f)
"""


@query("parse_verdicts", ("verdicts",), PARSED_SQL + "SELECT doc_id, label, CAST(confidence AS DOUBLE) AS confidence, explanation, reasoning FROM parsed")
def parse_verdicts(t):
    return vd.parse_verdicts(t.verdicts).select("doc_id", "label", "confidence", "explanation", "reasoning")


@query("error_verdicts", ("verdicts",), PARSED_SQL + """
, a AS (SELECT p.* FROM parsed p JOIN documents d USING (doc_id) WHERE d.lang <> 'en')
SELECT d.doc_id, coalesce(label, 'unclear') AS label, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence, a.doc_id IS NULL AS failed FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
""")
def error_verdicts(t):
    answered = t.documents.filter(F.col("lang") != "en").select("doc_id")
    answers = vd.parse_verdicts(t.verdicts.join(answered, "doc_id"))
    return vd.error_verdicts(t.documents.select("doc_id"), answers, "doc_id")
