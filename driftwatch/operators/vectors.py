"""Vector collections: search, pooling, features, drift between versions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.functions.similarity import as_doubles, cosine, norm
from driftwatch.operators.sliced import newest
from driftwatch.sources.tables import merge_patch

#: Bytes of query vectors that are shipped to every task at a time.
QUERY_BLOCK_BYTES = 1 << 25
DRIFT_BELOW = 0.7


def vector_id(website_id: Column, content_hash: Column) -> Column:
    """First 16 hex digits of the digest of ``website_id:content_hash``."""
    return F.substring(F.sha2(F.concat_ws(":", website_id, content_hash), 256), 1, 16)


def payload_id(payload: Column) -> Column:
    """Identifier of a payload map without those keys: digest of its sorted entries."""
    entries = F.transform(F.array_sort(F.map_entries(payload)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.substring(F.sha2(F.array_join(entries, ";"), 256), 1, 16)


def identified(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``vector_id``: the caller's own where the column is there and not null, else the digest of site and
    content hash, else (where one of these is absent or null) that of the ``payload`` map."""
    have = set(vectors.columns)
    choices = []
    if "vector_id" in have:
        choices.append(F.col("vector_id").cast("string"))
    if {"website_id", "content_hash"} <= have:
        both = F.col("website_id").isNotNull() & F.col("content_hash").isNotNull()
        choices.append(F.when(both, vector_id(F.col("website_id"), F.col("content_hash"))))
    if "payload" in have:
        choices.append(payload_id(F.coalesce(F.col("payload"), F.create_map().cast("map<string,string>"))))
    if not choices:
        raise ValueError("vectors need an id, a site with a content hash, or a payload")
    return vectors.withColumn("vector_id", F.coalesce(*choices))


def _fits(size: int | None):
    """True for vectors that are there and, where a size is given, have it."""
    there = F.col("embedding").isNotNull()
    return there if size is None else there & (F.size("embedding") == size)


def upsert_vectors(vectors: DataFrame, seq: str, size: int | None = None) -> DataFrame:
    """One row per vector id, the one with the largest ``seq`` wins; see ``rejected_vectors`` for those that do not fit."""
    rows = identified(vectors.filter(_fits(size)))
    row = F.struct(*[c for c in rows.columns if c != "vector_id"])
    return rows.groupBy("vector_id").agg(F.max_by(row, F.col(seq)).alias("_v")).select("vector_id", "_v.*")


def rejected_vectors(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """The rows that ``upsert_vectors`` leaves out, with the ``reason``."""
    reason = F.when(F.col("embedding").isNull(), F.lit("no vector"))
    if size is not None:
        found = F.format_string(f"%d dimensions, not {size}", F.size("embedding"))
        reason = reason.otherwise(found)
    return vectors.filter(~_fits(size)).withColumn("reason", reason)


def get_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_semi")


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def count_vectors(vectors: DataFrame, filters: dict[str, object] | None = None) -> DataFrame:
    return _matching(vectors, filters).agg(F.count(F.lit(1)).alias("n_vectors"))


def set_payload(vectors: DataFrame, patches: DataFrame, fields: list[str], order: list[Column] | None = None) -> DataFrame:
    """Overwrite payload fields where ``patches(id, fields...)`` has a value; several patches of an id count as one row.

    Each field takes the value of the first patch in ``order`` (newest first) that has one.
    """
    return merge_patch(vectors, patches, "id", fields, order=order or [])


def collection_info(vectors: DataFrame, distance: str = "cosine") -> DataFrame:
    """Vector count and size of the collection."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors_count"), F.max(F.size("embedding")).alias("vector_size")).withColumn(
        "distance", F.lit(distance)
    )


def _matching(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    for name, value in (filters or {}).items():
        df = df.filter(F.col(name) == value)
    return df


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _best_per_query(ids: np.ndarray, scores: np.ndarray, query_ids: np.ndarray, k: int, floor: float) -> pd.DataFrame:
    """The ``k`` best rows of each score column, ties to the smaller id."""
    out = []
    for column, query_id in enumerate(query_ids):
        s = scores[:, column]
        keep = np.flatnonzero(s >= floor)
        if len(keep) > k:
            # keep everything that ties with the k-th score, the final ranking decides
            keep = keep[s[keep] >= np.partition(s[keep], -k)[-k]]
            keep = keep[np.lexsort((ids[keep], -s[keep]))][:k]
        out.append(pd.DataFrame({"query_id": query_id, "id": ids[keep], "score": s[keep]}))
    return pd.concat(out, ignore_index=True)


def vector_search(
    vectors: DataFrame, queries: DataFrame, limit: int = 10, threshold: float = 0.8,
    filters: dict[str, object] | None = None, block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """The ``limit`` most similar vectors per query with score at least ``threshold``.

    Exact. The queries ``(query_id, embedding)`` are shipped in blocks of at most
    ``block_bytes`` bytes; for each block every task scores its batches against
    all queries of the block and keeps its own best, so only ``limit`` rows per
    query and batch are shuffled. Ids keep their types.
    """
    corpus = _matching(vectors, filters).select("id", "embedding")
    probes = queries.select("query_id", "embedding")
    schema = T.StructType([T.StructField("query_id", probes.schema["query_id"].dataType), T.StructField("id", corpus.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    hits, held, size = None, [], 0

    def add(block: list) -> None:
        nonlocal hits
        found = _search_block(corpus, block, limit, threshold, schema)
        hits = found if hits is None else hits.unionByName(found)

    for row in probes.toLocalIterator():  # a block of queries at a time
        held.append(row)
        size += 8 * len(row["embedding"] or ())
        if size >= block_bytes:
            add(held)
            held, size = [], 0
    if held or hits is None:
        add(held)
    ranked = newest(hits, ["query_id"], [F.col("score").desc(), F.col("id")], limit)
    return ranked.withColumn("distance", 1.0 - F.col("score"))


def _search_block(corpus: DataFrame, block: list, limit: int, threshold: float, schema: T.StructType) -> DataFrame:
    if not block:
        return corpus.sparkSession.createDataFrame([], schema)
    query_ids = np.array([p["query_id"] for p in block])
    shipped = corpus.sparkSession.sparkContext.broadcast((query_ids, _unit_rows([p["embedding"] for p in block]).T))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shipped.value
        for pdf in batches:
            if len(pdf):
                yield _best_per_query(pdf["id"].to_numpy(), _unit_rows(pdf["embedding"]) @ matrix, names, limit, threshold)

    return corpus.mapInPandas(score, schema)


def mean_pool(vectors: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """Element-wise mean vector per key; a key without vectors keeps zeros of ``size``."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(as_doubles(F.col("embedding")))))
    pooled = vectors.filter(F.col("embedding").isNotNull()).groupBy(*keys).agg(mean.alias("embedding"))
    if size is None:
        return pooled
    zeros = F.array_repeat(F.lit(0.0), size)
    every = vectors.select(*keys).distinct()
    return every.join(pooled, keys, "left").withColumn("embedding", F.coalesce("embedding", zeros))


def vector_features(vectors: DataFrame) -> DataFrame:
    """Adds norm, mean, deviation, extremes and sparsity of each vector."""
    v = as_doubles(F.col("embedding"))
    n = F.size("embedding")
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    staged = vectors.withColumns({"vector_norm": norm(F.col("embedding")), "vector_mean": total / n})
    spread = F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + (x - F.col("vector_mean")) * (x - F.col("vector_mean"))
    )
    filled = F.size(F.filter(v, lambda x: x != 0))
    return staged.withColumns(
        {
            "vector_std": F.sqrt(spread / n),
            "vector_max": F.array_max(v),
            "vector_min": F.array_min(v),
            "non_zero_components": filled,
            "sparsity": 1.0 - filled / n,
        }
    )


def vector_set_properties(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: spread of the norms, norm of the mean vector, number of vectors."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(as_doubles(F.col("embedding")))))
    grouped = vectors.groupBy(*keys).agg(
        F.stddev_pop(norm(F.col("embedding"))).alias("content_diversity"),
        mean.alias("_mean"),
        F.count(F.lit(1)).alias("content_types_count"),
    )
    return grouped.withColumn("semantic_density", norm(F.col("_mean"))).drop("_mean")


def stand_in_embedding(df: DataFrame, text: str, size: int = 384) -> DataFrame:
    """Adds ``embedding``: hashed word counts of unit length, where no model is at hand."""
    from pyspark.ml.feature import HashingTF, Normalizer

    words = df.withColumn("_words", F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}_]+"))
    counted = HashingTF(numFeatures=size, inputCol="_words", outputCol="_tf").transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def semantic_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new vectors per pair and content type, with similarity and drift.

    A type on one side only is full drift (``new_content``, ``removed_content``).
    """
    left = old.select("pair_id", "content_type", F.col("embedding").alias("_old"))
    right = new.select("pair_id", "content_type", F.col("embedding").alias("_new"))
    joined = left.join(right, ["pair_id", "content_type"], "full_outer")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    staged = joined.withColumn("similarity", F.when(both, cosine(F.col("_old"), F.col("_new"))).otherwise(0.0))
    return staged.select(
        "pair_id",
        "content_type",
        both.alias("compared"),
        "similarity",
        (1.0 - F.col("similarity")).alias("drift_magnitude"),
        (~both | (F.col("similarity") < DRIFT_BELOW)).alias("is_significant"),
        F.when(both, F.lit(None)).when(F.col("_new").isNotNull(), "new_content").otherwise("removed_content").alias("change_type"),
    )


def semantic_risk(drift: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Per pair: mean similarity, drift count, suspicious words and risk level.

    ``suspicious`` has one row per pair and suspicious word.
    """
    per_pair = drift.groupBy("pair_id").agg(
        F.avg(F.when(F.col("compared"), F.col("similarity"))).alias("_mean"),
        F.count_if("is_significant").alias("significant_drifts"),
    )
    words = suspicious.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_words"))
    joined = per_pair.join(words, "pair_id", "left").withColumn("suspicious_pattern_count", F.coalesce("_words", F.lit(0)))
    risk = (
        F.when(F.col("_mean") < 0.3, 0.4).when(F.col("_mean") < 0.6, 0.2).otherwise(0.0)
        + F.least(F.lit(0.3), F.col("suspicious_pattern_count") * 0.1)
        + F.least(F.lit(0.3), F.col("significant_drifts") * 0.1)
    )
    scored = joined.withColumn("risk_score", F.round(risk, 9))
    r = F.col("risk_score")
    return scored.select(
        "pair_id",
        F.coalesce("_mean", F.lit(1.0)).alias("overall_similarity"),
        (F.col("significant_drifts") > 0).alias("has_significant_drift"),
        "significant_drifts",
        "suspicious_pattern_count",
        "risk_score",
        F.when(r >= 0.7, "critical").when(r >= 0.5, "high").when(r >= 0.3, "medium").otherwise("low").alias("risk_level"),
    )
