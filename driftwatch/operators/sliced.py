"""Ordered per-key computations that survive a key holding most of the rows.

A plain ``OVER (PARTITION BY key ORDER BY t)`` puts all rows of a key in one
task. Here every key is cut into slices of its order column: the window runs
inside a slice, one summary row per slice is carried from slice to slice, and
the carried value is joined back. Only the summaries of a key meet in one task.
Key columns must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICE, _PLACE = "_slice", "_place"


def time_slice(column: str | Column, seconds: int = 86_400) -> Column:
    """Slice number of a timestamp (zone-less or not)."""
    col = F.col(column) if isinstance(column, str) else column
    return F.floor(F.unix_seconds(col.cast("timestamp")) / seconds)


def _window(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, _SLICE).orderBy(*order)


def _slices_before(summary: DataFrame, keys: list[str]):
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return window.orderBy(_SLICE)


def lag_over(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, columns: dict[str, Column]
) -> DataFrame:
    """``lag(expr, 1)`` per key for each named expression, null on the first row."""
    names = list(columns)
    # key and slice as one struct, which is never null: a join on nullable columns filters nulls out below one of the
    # branches, and they would no longer be alike
    part = df.withColumn(_PLACE, F.struct(*keys, slice_by.alias(_SLICE)))
    packed = F.struct(*[expr.alias(n) for n, expr in columns.items()])
    # both branches read this exchange, which is therefore planned and run once
    part = part.repartition(_PLACE)
    window = Window.partitionBy(_PLACE).orderBy(*order)
    local = part.withColumn("_prev", F.lag(packed).over(window)).withColumn("_first", F.row_number().over(window) == 1)
    order_key = F.struct(*[F.col(c) for c in order])
    tails = part.groupBy(_PLACE).agg(F.max_by(packed, order_key).alias("_tail"))
    before = Window.partitionBy(*([F.col(_PLACE)[k] for k in keys] or [F.lit(0)])).orderBy(F.col(_PLACE)[_SLICE])
    carried = tails.withColumn("_carry", F.lag("_tail").over(before)).drop("_tail")
    joined = local.join(carried, _PLACE, "left")
    value = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    kept = [F.col(_PLACE)[c].alias(c) if c in keys else F.col(c) for c in df.columns if c not in names]
    return joined.select(*kept, *[value[n].alias(n) for n in names])


def last_over(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, columns: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Most recent non-null value of each expression at (or strictly before) a row."""
    part = df.withColumn(_SLICE, slice_by).withColumns({f"_in_{n}": e for n, e in columns.items()})
    frame = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = part.withColumns({f"_loc_{n}": F.last(f"_in_{n}", ignorenulls=True).over(frame) for n in columns})
    order_key = F.struct(*[F.col(c) for c in order])
    tails = part.groupBy(*keys, _SLICE).agg(
        *[F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), order_key)).alias(f"_tail_{n}") for n in columns]
    )
    past = _slices_before(tails, keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, _SLICE, *[F.last(f"_tail_{n}", ignorenulls=True).over(past).alias(f"_carry_{n}") for n in columns]
    )
    joined = local.join(carried, [*keys, _SLICE], "left")
    out = joined.withColumns({n: F.coalesce(f"_loc_{n}", f"_carry_{n}") for n in columns})
    return out.drop(_SLICE, *[f"{p}_{n}" for n in columns for p in ("_in", "_loc", "_carry")])


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, columns: dict[str, Column]
) -> DataFrame:
    """Cumulative sum of each expression up to and including the row."""
    part = df.withColumn(_SLICE, slice_by).withColumns({f"_in_{n}": e for n, e in columns.items()})
    frame = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = part.withColumns({f"_loc_{n}": F.sum(f"_in_{n}").over(frame) for n in columns})
    totals = part.groupBy(*keys, _SLICE).agg(*[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in columns])
    past = _slices_before(totals, keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, _SLICE, *[F.coalesce(F.sum(f"_tot_{n}").over(past), F.lit(0)).alias(f"_carry_{n}") for n in columns]
    )
    joined = local.join(carried, [*keys, _SLICE], "left")
    out = joined.withColumns({n: F.col(f"_loc_{n}") + F.col(f"_carry_{n}") for n in columns})
    return out.drop(_SLICE, *[f"{p}_{n}" for n in columns for p in ("_in", "_loc", "_carry")])


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key in the given order.

    The ``rank <= n`` filter lets Spark keep only ``n`` rows per key in every
    map task before the shuffle, so a hot key costs tasks x n rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
