from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftwatch.functions import html
from driftwatch.functions.text import normalize_text
from driftwatch.operators.sliced import lag_over


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_comparisons_compute_only_what_they_compare(spark):
    made = entry.queries()
    for name in ("structure_compare", "visual_hash_compare"):
        shown = plan(made[name](spark, entry.SMOKE_DIR))
        assert "sha2(" not in shown and "array_distinct(" not in shown
    assert "sha2(" not in plan(made["significant_change"](spark, entry.SMOKE_DIR))


def test_words_are_normalised_in_one_pass(spark):
    texts = [" Ab,c d --  É_1\n\n٣x. ", "...", "", None, "áb"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select(normalize_text(F.col("x")).alias("x"))
    assert [r.x for r in df.collect()] == ["ab c d é_1 ٣x", "", "", None, "a b"] and "RegExpReplace" not in plan(df)
    assert plan(df).lower().count("regexp_replace(") == 1


def test_a_batch_of_pages_is_walked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(html, "PAGES_AT_ONCE", 2)
    rows = [(k, None if k == 4 else ["<p", "", "/p"] * k, [0] if k == 2 else []) for k in range(7)]
    df = spark.createDataFrame(rows, "k int, m array<string>, h array<int>").coalesce(1)
    got = {r.k: r.w for r in df.select("k", html.page_nodes(F.col("m"), F.col("h")).alias("w")).collect()}
    for k, m, h in rows:
        assert (got[k] is None) == (m is None)
        if m is not None:
            assert [list(n) for n in got[k].nodes] == html._walk(m, h)[0] and got[k].covered == html._walk(m, h)[2]


def test_lag_reads_its_rows_once(spark, tmp_path):
    rows = [(k, "ab"[k % 2] if k % 5 else None, f"x{k}") for k in range(40)]
    spark.createDataFrame(rows, "id long, key string, x string").write.parquet(str(tmp_path / "t"))
    df = lag_over(spark.read.parquet(str(tmp_path / "t")), ["key"], ["id"], F.floor(F.col("id") / 8), {"old": F.upper("x")})
    got = {r.id: r.old for r in df.collect()}
    last, expected = {}, {}
    for k, key, x in rows:
        expected[k], last[key] = last.get(key), x.upper()
    assert got == expected and "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
