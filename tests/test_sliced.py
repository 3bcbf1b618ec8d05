from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwatch.operators.sliced import lag_over, last_over, newest, running_sum


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if i % 3 else f"k{i % 5}", rng.randrange(400), i, rng.choice([None, i * 2])) for i in range(900)]
    return spark.createDataFrame(data, "k string, t int, id int, v int").cache()


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_slices_equal_plain_windows(rows, width):
    cut = F.floor(F.col("t") / width)
    plain = Window.partitionBy("k").orderBy("t", "id")
    so_far = plain.rowsBetween(Window.unboundedPreceding, 0)
    expected = rows.select(
        "id",
        F.lag("id").over(plain).alias("prev"),
        F.last("v", ignorenulls=True).over(so_far).alias("seen"),
        F.sum(F.lit(1)).over(so_far).alias("n"),
    )
    want = {r.id: (r.prev, r.seen, r.n) for r in expected.collect()}
    out = lag_over(rows, ["k"], ["t", "id"], cut, {"prev": F.col("id")})
    out = last_over(out, ["k"], ["t", "id"], cut, {"seen": F.col("v")})
    out = running_sum(out, ["k"], ["t", "id"], cut, {"n": F.lit(1)})
    assert {r.id: (r.prev, r.seen, r.n) for r in out.collect()} == want


def test_running_sum_without_keys(rows):
    out = running_sum(rows, [], ["t", "id"], F.floor(F.col("t") / 50), {"n": F.lit(1)})
    assert sorted(r.n for r in out.collect()) == list(range(1, 901))


def test_newest_filters_before_the_shuffle(rows):
    best = newest(rows, ["k"], [F.col("t").desc(), F.col("id").desc()], 3)
    assert best.groupBy("k").count().filter("count > 3").count() == 0
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
