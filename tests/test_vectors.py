from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.operators import vectors as vec


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 8))
    corpus[7] = 0
    corpus[11] = corpus[12]
    queries = rng.normal(size=(9, 8))
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(corpus)]
    return (
        spark.createDataFrame(rows, "id long, website_id int, embedding array<double>").repartition(4),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>"),
        corpus,
        queries,
    )


def brute(corpus, queries, k, floor, keep=lambda i: True):
    out = {}
    for q, v in enumerate(queries):
        length = np.linalg.norm(corpus, axis=1) * np.linalg.norm(v)
        scores = np.divide(corpus @ v, length, out=np.zeros(len(corpus)), where=length > 0)
        order = sorted((i for i in range(len(corpus)) if scores[i] >= floor and keep(i)), key=lambda i: (-scores[i], i))
        out[q] = order[:k]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_search_is_exact(data):
    vectors, queries, corpus, asked = data
    assert ranked(vec.vector_search(vectors, queries, 5, 0.2)) == brute(corpus, asked, 5, 0.2)
    found = vec.vector_search(vectors, queries, 5, 0.2, {"website_id": 1})
    assert ranked(found) == brute(corpus, asked, 5, 0.2, lambda i: i % 3 == 1)


def test_search_in_blocks_and_with_text_ids(data):
    vectors, queries, corpus, asked = data
    assert ranked(vec.vector_search(vectors, queries, 5, 0.2, block_bytes=200)) == brute(corpus, asked, 5, 0.2)
    named = vectors.selectExpr("lpad(cast(id as string), 4, '0') AS id", "embedding")
    found = ranked(vec.vector_search(named, queries.selectExpr("concat('q', query_id) AS query_id", "embedding"), 5, 0.2))
    assert found == {f"q{q}": [f"{i:04d}" for i in ids] for q, ids in brute(corpus, asked, 5, 0.2).items() if ids}


def test_mean_pool_and_zero_vector(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", None)], "k string, embedding array<double>")
    got = {r.k: r.embedding for r in vec.mean_pool(df, ["k"], 2).collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}


def test_upsert_keeps_the_last_write_and_checks_size(spark):
    rows = [(1, "s", "h", [1.0, 0.0]), (2, "s", "h", [0.0, 1.0]), (3, "s", "h", [1.0])]
    df = spark.createDataFrame(rows, "seq int, website_id string, content_hash string, embedding array<double>")
    row = vec.upsert_vectors(df, "seq", 2).collect()
    assert len(row) == 1 and row[0].seq == 2 and len(row[0].vector_id) == 16


def test_stand_in_embedding_has_unit_length(spark):
    df = vec.stand_in_embedding(spark.createDataFrame([("some words here",)], "t string"), "t", 64)
    assert np.linalg.norm(df.first().embedding) == pytest.approx(1.0, abs=1e-5)


def test_two_patches_of_one_id_give_one_row(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, kind string, note string")
    patches = spark.createDataFrame([(1, "old", "n", 1), (1, "new", None, 2), (9, "z", "z", 1)], "id long, kind string, note string, seq int")
    out = vec.set_payload(rows, patches, ["kind", "note"], [-F.col("seq")])
    assert sorted((r.id, r.kind, r.note) for r in out.collect()) == [(1, "new", "n"), (2, "b", "y")]


def test_ids_come_from_the_caller_the_site_or_the_payload(spark):
    rows = [("mine", 1, "h", {"a": "1"}, [1.0]), (None, 1, "h", None, [1.0]), (None, None, "h", {"b": "2", "a": "1"}, [1.0]), (None, None, None, {"a": "1", "b": "2"}, None)]
    df = spark.createDataFrame(rows, "vector_id string, website_id long, content_hash string, payload map<string,string>, embedding array<double>")
    ids = [r.vector_id for r in vec.identified(df).collect()]
    assert ids[0] == "mine" and ids[2] == ids[3] and len(set(ids)) == 3
    wrong = df.withColumn("embedding", F.when(F.col("vector_id") == "mine", F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("embedding")))
    assert sorted(r.reason for r in vec.rejected_vectors(wrong, 1).collect()) == ["2 dimensions, not 1", "no vector"]
