"""Two-pass external shuffle of records into equal shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.common import shards_for


def external_shuffle(
    df: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = 1 << 25
) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a uniform random order, dealt out so that shard sizes differ by one row at most.

    Pass one scatters the records into buckets of about ``bucket_bytes`` by a seeded hash. Pass two sorts a bucket by
    the hash, so that its order does not hang on which record arrived first, shuffles it (Fisher-Yates, seeded) and
    numbers its records behind those of the buckets before it; number modulo ``shards`` is the shard. One shuffle of
    the records; the buckets' counts travel with it. The same seed, rows and ``bucket_bytes`` give the same order.

    The hash takes id and text, so rows with null or repeated ids still scatter; only rows equal in both share a
    bucket. Null text has no bytes. An empty table gives no rows. All columns pass through; ``shard``, ``slot`` and
    names that begin with ``_ext`` are replaced or reserved.
    """
    df = df.drop("shard", "slot")
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1
    n_bytes = int(df.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0)
    buckets = shards_for(n_bytes, bucket_bytes)
    key = F.xxhash64(F.lit(seed), F.col(id_column), F.col(text))
    bucket = F.pmod(F.shiftright(key, 7), F.lit(buckets)).cast("int")
    packed = df.select(bucket.alias("_ext_bucket"), key.alias("_ext_key"), F.lit(None).cast("long").alias("_ext_first"), F.struct(*df.columns).alias("_ext_row"))
    counts = df.groupBy(bucket.alias("_ext_bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_ext_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    firsts = counts.select(
        "_ext_bucket", F.lit(None).cast("long").alias("_ext_key"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ext_first"),
        F.lit(None).cast(packed.schema["_ext_row"].dataType).alias("_ext_row"),
    )
    dealt = packed.unionByName(firsts).repartition(buckets, "_ext_bucket").sortWithinPartitions("_ext_bucket", "_ext_key")
    whole = dealt.groupBy("_ext_bucket").agg(F.max("_ext_first").alias("_ext_first"), F.collect_list("_ext_row").alias("_ext_rows"))
    rows = whole.select("_ext_first", F.posexplode(F.shuffle("_ext_rows", seed)).alias("_ext_at", "_ext_row"))
    place = F.col("_ext_first") + F.col("_ext_at")
    return rows.select(
        *[F.col("_ext_row")[c].alias(c) for c in df.columns],
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str) -> None:
    """Write the output of ``external_shuffle`` as one folder for each shard; ``slot`` holds the order of its records."""
    df.write.partitionBy("shard").parquet(path)
