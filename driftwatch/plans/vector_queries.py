"""Queries over vector collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwatch.functions import similarity as sim
from driftwatch.operators import vectors as vec
from driftwatch.plans.metrics_queries import rounded
from driftwatch.plans.registry import query
from driftwatch.sources.cow import CopyOnWriteTable
from driftwatch.sources.shared import shared_folder


def pairs(t):
    """Main-content and title vectors of each pair side by side."""
    main = t.vecs.filter("content_type = 'main_content'").select("pair_id", F.col("embedding").alias("a"))
    title = t.vecs.filter("content_type = 'title'").select("pair_id", F.col("embedding").alias("b"))
    return main.join(title, "pair_id")


PAIR_SQL = """
, p AS (SELECT a.pair_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM vecs a JOIN vecs b USING (pair_id)
  WHERE a.content_type = 'main_content' AND b.content_type = 'title')
"""
_FORMS = {
    "cosine": "list_cosine_similarity(a, b)",
    "euclidean": "greatest(0.0, 1 - list_distance(a, b) / sqrt(2))",
    "manhattan": "greatest(0.0, 1 - list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))) / 2)",
}
for _method, _form in _FORMS.items():

    @query(f"vector_{_method}", ("vecs",), PAIR_SQL + f"SELECT pair_id, round({_form}, 6) AS similarity FROM p")
    def vector_pair(t, method=_method):
        score = sim.vector_similarity(F.col("a"), F.col("b"), method)
        return pairs(t).select("pair_id", F.round(score, 6).alias("similarity"))


CENTROIDS = """
, e AS (SELECT website_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vecs),
m AS (SELECT website_id, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2),
c AS (SELECT website_id AS query_id, list(x ORDER BY i) AS embedding FROM m GROUP BY 1)
"""


@query("vector_search", ("vecs",), CENTROIDS + """
, s AS (SELECT query_id, id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.embedding) AS score FROM vecs v, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s WHERE score >= 0.1)
SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, CAST(rn AS INT) AS rank, round(1 - score, 6) AS distance FROM r WHERE rn <= 10
""")
def vector_search(t):
    centres = vec.mean_pool(t.vecs, ["website_id"]).withColumnRenamed("website_id", "query_id")
    return rounded(vec.vector_search(t.vecs, centres, limit=10, threshold=0.1), "score", "distance")


@query("vector_search_filtered", ("vecs",), CENTROIDS + """
, s AS (SELECT query_id, id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.embedding) AS score FROM (SELECT * FROM vecs WHERE content_type = 'title') v, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s WHERE score >= 0.1)
SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, CAST(rn AS INT) AS rank, round(1 - score, 6) AS distance FROM r WHERE rn <= 5
""")
def vector_search_filtered(t):
    centres = vec.mean_pool(t.vecs, ["website_id"]).withColumnRenamed("website_id", "query_id")
    hits = vec.vector_search(t.vecs, centres, limit=5, threshold=0.1, filters={"content_type": "title"})
    return rounded(hits, "score", "distance")


def stored(t, rows, key="id"):
    """A fresh copy-on-write table of some vectors."""
    return CopyOnWriteTable.create(rows, shared_folder(t.spark, "vectors"), key, buckets=16)


def asked(t):
    """The vectors of half the sites, as requested ids."""
    return t.vecs.filter(F.col("website_id") < 5).select("id")


@query("vector_lookup", ("vecs",), "SELECT id, website_id, content_type FROM vecs WHERE website_id < 5")
def vector_lookup(t):
    return vec.get_vectors(t.vecs, asked(t)).select("id", "website_id", "content_type")


@query("vector_count", ("vecs",), "SELECT count(*) AS n_vectors FROM vecs WHERE content_type = 'title' AND website_id = 3")
def vector_count(t):
    return vec.count_vectors(t.vecs, {"content_type": "title", "website_id": 3})


@query("vector_delete", ("vecs",), "SELECT id, website_id, content_type FROM vecs WHERE website_id >= 5")
def vector_delete(t):
    table = stored(t, t.vecs)
    table.delete(asked(t))
    return table.read().select("id", "website_id", "content_type")


@query("vector_set_payload", ("vecs",), "SELECT id, CASE WHEN website_id < 5 THEN 'archived' ELSE content_type END AS content_type FROM vecs")
def vector_set_payload(t):
    """Two patches for each id: the newer one counts."""
    older = asked(t).select("id", F.lit("stale").alias("content_type"), F.lit(1).alias("seq"))
    newer = asked(t).select("id", F.lit("archived").alias("content_type"), F.lit(2).alias("seq"))
    table = stored(t, t.vecs)
    table.patch(older.unionByName(newer), ["content_type"], [-F.col("seq")])
    return table.read().select("id", "content_type")


@query("collection_info", ("vecs",), "SELECT count(*) AS vectors_count, CAST(max(len(embedding)) AS INT) AS vector_size, 'cosine' AS distance FROM vecs")
def collection_info(t):
    return vec.collection_info(t.vecs)


def listed(name):
    return F.array_join(F.transform(name, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",")


@query("mean_pool", ("vecs",), CENTROIDS + """
SELECT query_id AS website_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR)), ',') AS embedding FROM c
""")
def mean_pool(t):
    return vec.mean_pool(t.vecs, ["website_id"]).select("website_id", listed("embedding").alias("embedding"))


@query("vector_features", ("vecs",), """
, e AS (SELECT id, CAST(unnest(embedding) AS DOUBLE) AS x FROM vecs)
SELECT id, round(sqrt(sum(x * x)), 6) AS vector_norm, round(avg(x), 6) AS vector_mean, round(stddev_pop(x), 6) AS vector_std, round(max(x), 6) AS vector_max, round(min(x), 6) AS vector_min,
  CAST(count(*) FILTER (x <> 0) AS INT) AS non_zero_components, round(1 - count(*) FILTER (x <> 0) / count(*), 6) AS sparsity FROM e GROUP BY 1
""")
def vector_features(t):
    names = ["vector_norm", "vector_mean", "vector_std", "vector_max", "vector_min", "sparsity"]
    out = vec.vector_features(t.vecs)
    return rounded(out.select("id", *names, "non_zero_components"), *names)


@query("vector_set_properties", ("vecs",), CENTROIDS + """
, n AS (SELECT website_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nr FROM (SELECT id, website_id, unnest(embedding) AS x FROM vecs) z GROUP BY id, website_id),
d AS (SELECT website_id, stddev_pop(nr) AS sd, count(*) AS k FROM n GROUP BY 1)
SELECT website_id, round(sd, 6) AS content_diversity, k AS content_types_count, round(sqrt(list_sum(list_transform(embedding, lambda x: x * x))), 6) AS semantic_density FROM d JOIN c ON query_id = website_id
""")
def vector_set_properties(t):
    return rounded(vec.vector_set_properties(t.vecs, ["website_id"]), "content_diversity", "semantic_density")


@query("upsert_vectors", ("vecs",), """
, v AS (SELECT *, md5(CAST(id % 20 AS VARCHAR)) AS content_hash FROM vecs), k AS (SELECT *, sha256(website_id || ':' || content_hash)[1:16] AS vector_id FROM v)
SELECT vector_id, id, website_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY id DESC) rn FROM k) z WHERE rn = 1
""")
def upsert_vectors(t):
    hashed = t.vecs.withColumn("content_hash", F.md5((F.col("id") % 20).cast("string")))
    table = stored(t, vec.upsert_vectors(hashed.filter(F.col("id") % 2 == 0), "id", 64), "vector_id")
    table.upsert(vec.upsert_vectors(hashed, "id", 64))
    return table.read().select("vector_id", "id", "website_id", "content_hash")


def sides(t):
    """Old vectors, and a newer set in which every seventh vector is gone or moved."""
    new = t.vecs.filter(F.col("id") % 7 != 0).withColumn("pair_id", F.col("pair_id") - 1)
    return t.vecs, new


DRIFT_SQL = """
, o AS (SELECT pair_id, content_type, CAST(embedding AS DOUBLE[]) AS a FROM vecs), n AS (SELECT pair_id - 1 AS pair_id, content_type, CAST(embedding AS DOUBLE[]) AS b FROM vecs WHERE id % 7 <> 0),
j AS (SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, coalesce(o.content_type, n.content_type) AS content_type, a IS NOT NULL AND b IS NOT NULL AS compared,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN list_cosine_similarity(a, b) ELSE 0 END AS s, CASE WHEN b IS NULL THEN 'removed_content' WHEN a IS NULL THEN 'new_content' END AS change_type
  FROM o FULL JOIN n ON o.pair_id = n.pair_id AND o.content_type = n.content_type),
d AS (SELECT *, NOT compared OR s < 0.7 AS sig FROM j)
"""


@query("semantic_drift", ("vecs",), DRIFT_SQL + "SELECT pair_id, content_type, compared, round(s, 6) AS similarity, round(1 - s, 6) AS drift_magnitude, sig AS is_significant, change_type FROM d")
def semantic_drift(t):
    return rounded(vec.semantic_drift(*sides(t)), "similarity", "drift_magnitude")


@query("semantic_risk", ("vecs", "docs_planted"), DRIFT_SQL + """
, w AS (SELECT doc_id AS pair_id, count(*) AS n FROM docs_planted, (VALUES ('hacked'), ('owned'), ('pwned'), ('defaced'), ('unauthorized'), ('breached'), ('compromised'), ('attacked'), ('vandalized'), ('hijacked')) v(p)
  WHERE contains(lower(text), p) GROUP BY 1),
g AS (SELECT pair_id, avg(CASE WHEN compared THEN s END) AS m, count(*) FILTER (sig) AS k FROM d GROUP BY 1),
r AS (SELECT g.*, coalesce(n, 0) AS c, round(CASE WHEN m < 0.3 THEN 0.4 WHEN m < 0.6 THEN 0.2 ELSE 0 END + least(0.3, coalesce(n, 0) * 0.1) + least(0.3, k * 0.1), 6) AS x FROM g LEFT JOIN w USING (pair_id))
SELECT pair_id, round(coalesce(m, 1), 6) AS overall_similarity, k > 0 AS has_significant_drift, k AS significant_drifts, c AS suspicious_pattern_count, CAST(x AS DOUBLE) AS risk_score,
  CASE WHEN x >= 0.7 THEN 'critical' WHEN x >= 0.5 THEN 'high' WHEN x >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM r
""")
def semantic_risk(t):
    from driftwatch.operators.rules import suspicious_keywords

    words = suspicious_keywords(t.docs_planted.withColumnRenamed("doc_id", "pair_id"), "pair_id")
    out = vec.semantic_risk(vec.semantic_drift(*sides(t)), words)
    return rounded(out, "overall_similarity", "risk_score")
