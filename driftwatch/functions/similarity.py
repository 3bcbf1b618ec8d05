"""Pairwise similarity of texts, outlines and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from driftwatch.functions import text


def keyword_similarity(df: DataFrame, old: str, new: str, out: str = "similarity") -> DataFrame:
    """Blend of Jaccard, overlap and Dice on keyword sets, with an overlap bonus.

    The columns hold texts, or keyword sets made beforehand (null for an empty
    text). An empty or missing text scores 0; two texts without keywords 1.
    """

    def as_set(name: str):
        return F.col(name) if isinstance(df.schema[name].dataType, ArrayType) else text.keyword_set(F.col(name))

    staged = df.withColumns({"_a": as_set(old), "_b": as_set(new)})
    sized = staged.withColumns(
        {
            "_common": F.size(F.array_intersect("_a", "_b")).cast("double"),
            "_na": F.size("_a").cast("double"),
            "_nb": F.size("_b").cast("double"),
            "_empty": F.col("_a").isNull() | F.col("_b").isNull(),
        }
    )
    common, total, small = F.col("_common"), F.col("_na") + F.col("_nb"), F.least("_na", "_nb")
    overlap = common / small
    blend = 0.2 * common / (total - common) + 0.6 * overlap + 0.2 * (2 * common) / total
    bonus = F.when(overlap >= 0.5, F.least(F.lit(0.15), 0.2 * overlap)).otherwise(0.0)
    score = (
        F.when(F.col("_empty"), 0.0)
        .when(total == 0, 1.0)
        .when(small == 0, 0.0)
        .otherwise(F.least(F.lit(1.0), blend + bonus))
    )
    return sized.withColumn(out, score).drop("_a", "_b", "_common", "_na", "_nb", "_empty")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; two empty ones (or null) are equal."""
    none = F.array().cast("array<string>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _fold(vector: Column, step) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + step(x))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), lambda x: x)


def norm(a: Column) -> Column:
    return F.sqrt(_fold(as_doubles(a), lambda x: x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def euclidean(a: Column, b: Column) -> Column:
    """1 - distance / sqrt(2), not below 0."""
    squares = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
    return F.greatest(F.lit(0.0), 1.0 - F.sqrt(_fold(squares, lambda x: x)) / F.sqrt(F.lit(2.0)))


def manhattan(a: Column, b: Column) -> Column:
    """1 - L1 distance / 2, not below 0."""
    steps = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: F.abs(x - y))
    return F.greatest(F.lit(0.0), 1.0 - _fold(steps, lambda x: x) / 2.0)


METHODS = {"cosine": cosine, "euclidean": euclidean, "manhattan": manhattan}


def vector_similarity(a: Column, b: Column, method: str = "cosine") -> Column:
    """Similarity by method name; an unknown method scores 0."""
    return METHODS[method](a, b) if method in METHODS else F.lit(0.0)
