"""Groups of rows that share a content fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_duplicates(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """Rows whose digest occurs more than once, with group size and first member.

    Texts are scanned and hashed once: both branches read one exchange of keys
    and digests, dealt by key so that no digest makes a task larger. Group
    sizes are combined before their shuffle; the join back is split by adaptive
    execution if one digest dominates.
    """
    hashed = df.select(key, digest.alias("content_hash")).repartition(key)
    groups = (
        hashed.groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min(key).alias(f"first_{key}"))
        .filter(F.col("n_copies") > 1)
    )
    return hashed.join(groups, "content_hash").select(key, "content_hash", "n_copies", f"first_{key}")
