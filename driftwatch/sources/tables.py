"""Typed table reads, appends, merges and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a parquet table; a given schema prunes columns at the scan."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a CPU-heavy table arrives in fewer splits than cores.

    Large tables already have more splits than cores and pass through as is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def append(df: DataFrame, path: str, date_from: str | None = None) -> None:
    """Append rows; ``date_from`` names the timestamp that gives the date partition."""
    writer = df
    if date_from is not None:
        writer = df.withColumn(f"{date_from.removesuffix('_at')}_date", F.to_date(date_from))
        writer.write.mode("append").partitionBy(f"{date_from.removesuffix('_at')}_date").parquet(path)
        return
    writer.write.mode("append").parquet(path)


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fill absent or null columns with default expressions."""
    return df.withColumns(
        {name: F.coalesce(F.col(name), value) if name in df.columns else value for name, value in defaults.items()}
    )


def one_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order of sort values (each ascending), ties by the other columns."""
    rest = [c for c in df.columns if c != key]
    ranked = F.struct(*[v.alias(f"_o{i}") for i, v in enumerate(order)], *rest)
    first = df.groupBy(key).agg(F.min(ranked).alias("_first"))
    return first.select(key, *[F.col("_first")[c].alias(c) for c in rest])


def latest_values(requests: DataFrame, key: str, fields: list[str], order: list[Column]) -> DataFrame:
    """One row per key: each field has the value of the first request in ``order`` (newest first) that has one, ties the smallest."""
    places = [c.alias(f"_o{k}") for k, c in enumerate(order)]

    def first(name: str) -> Column:
        ranked = F.struct(*[F.col(f"_o{k}") for k in range(len(places))], F.col(name).alias("v"))
        return F.min(F.when(F.col(name).isNotNull(), ranked))["v"].alias(name)

    return requests.select(key, *fields, *places).groupBy(key).agg(*[first(f) for f in fields])


def merge_patch(
    base: DataFrame, patch: DataFrame, key: str, fields: list[str], stamp: tuple[str, Column] | None = None, order: list[Column] | None = None
) -> DataFrame:
    """Overwrite ``fields`` where the patch has a non-null value; stamp touched rows.

    Several patch rows of a key are merged: each field takes the value of the first row in ``order`` (newest first) that
    has one; without an order it takes its largest non-null value.
    """
    if order is not None:
        patch = latest_values(patch, key, fields, order)
    else:
        patch = patch.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])
    side = patch.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
    joined = base.join(side, key, "left")
    updates = {f: F.coalesce(f"_new_{f}", f) if f in base.columns else F.col(f"_new_{f}") for f in fields}
    if stamp is not None:
        name, value = stamp
        before = F.col(name) if name in base.columns else F.lit(None)
        updates[name] = F.when(F.col("_hit"), value).otherwise(before)
    return joined.withColumns(updates).drop("_hit", *[f"_new_{f}" for f in fields])


def delete_cascade(gone: DataFrame, sites: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove the sites in ``gone(id)`` and the child rows that point at them."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    kept = {"sites": sites.join(ids, sites["id"] == ids["_gone"], "left_anti")}
    for name, child in children.items():
        kept[name] = child.join(ids, child["website_id"] == ids["_gone"], "left_anti")
    return kept


def count_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, with a grand total row (table_name ``total``)."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    total = counts.agg(F.sum("n_rows").alias("n_rows")).select(F.lit("total").alias("table_name"), "n_rows")
    return counts.unionByName(total)
