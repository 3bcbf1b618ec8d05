from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from driftwatch.functions import similarity as sim
from driftwatch.functions import text

SAMPLES = [
    "  This is a TEST with   extra spaces!  ",
    "Événement à l'école — naïve façade, 12 élèves. 2024-01-31 12:30:59 copyright 2023",
    "session_id='abc-1é2' csrf-token: xyz nonce=\"q9\" Last updated: 20240101 end",
    "Click  here to READ more | home | about | contact 42 4x2 <b>bold</b>",
    " non breaking　space\t tab\nline",
    "",
]


def plain_normalize(value: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", value.lower())).strip()


def plain_strip(value: str) -> str:
    for pattern in text.DYNAMIC_PATTERNS:
        value = re.sub(pattern, "", value)
    return re.sub(r"\s+", " ", value.strip()).lower()


def plain_semantic(value: str) -> str:
    value = re.sub(r"<[^>]+>", " ", value)
    for pattern in text.BOILERPLATE_PATTERNS:
        value = re.sub(pattern, " ", value)
    return re.sub(r"\s+", " ", value.strip())


def plain_embed(value: str) -> str:
    for pattern, new in text.EMBEDDING_PATTERNS:
        value = re.sub(pattern, new, value)
    return value.lower().strip()[:8000]


@pytest.mark.parametrize(
    "column, plain",
    [
        (text.normalize_text, plain_normalize),
        (text.strip_dynamic, plain_strip),
        (text.semantic_text, plain_semantic),
        (text.preprocess_embedding, plain_embed),
    ],
)
def test_normalisation_follows_unicode_rules(spark, column, plain):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: r.x for r in df.select("i", column(F.col("s")).alias("x")).collect()}
    assert got == {i: plain(s) for i, s in enumerate(SAMPLES)}


def test_normalize_golden(spark):
    df = spark.createDataFrame([("  This is a TEST with   extra spaces!  ",)], "s string")
    assert df.select(text.normalize_text(F.col("s"))).first()[0] == "this is a test with extra spaces"


def test_placeholders_first_option(spark):
    df = spark.createDataFrame([("mail me@example.com see https://x.y/z 12",)], "s string")
    plain = df.select(text.preprocess_embedding(F.col("s"))).first()[0]
    first = df.select(text.preprocess_embedding(F.col("s"), placeholders_first=True)).first()[0]
    assert "email" not in plain and "email" in first and "url" in first


def test_chunks_pack_sentences(spark):
    long = "Long sentence. " * 100
    rows = spark.createDataFrame([(1, "short"), (2, long), (3, "x" * 2500)], "i int, s string")
    got = {r.i: r.c for r in rows.select("i", text.chunk_text(F.col("s")).alias("c")).collect()}
    assert got[1] == ["short"] and len(got[2]) > 1 and all(len(c) <= 1002 for c in got[2])
    assert got[3] == ["x" * 2500 + "."]


def test_unknown_hash_type_is_an_error(spark):
    with pytest.raises(ValueError):
        text.content_digest(F.col("s"), "crc")


PAIRS = [
    ("machine learning algorithms are powerful", "artificial intelligence machine learning algorithms", 0.5, 1.0),
    ("machine learning algorithms are powerful", "cooking pasta with tomato sauce", 0.0, 0.3),
    ("", "anything", 0.0, 0.0),
    ("the of", "and in", 1.0, 1.0),
    ("the of", "keyword", 0.0, 0.0),
    ("same words here", "same words here", 1.0, 1.0),
]


def test_keyword_similarity_bounds_and_symmetry(spark):
    df = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(PAIRS)], "i int, a string, b string")
    there = {r.i: r.similarity for r in sim.keyword_similarity(df, "a", "b").collect()}
    back = {r.i: r.similarity for r in sim.keyword_similarity(df, "b", "a").collect()}
    assert there == back
    for i, (_, _, low, high) in enumerate(PAIRS):
        assert low <= there[i] <= high


def test_overlap_of_sets(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "c"]), ([], None), (["a"], None)], "a array<string>, b array<string>")
    assert [r.o for r in df.select(sim.overlap(F.col("a"), F.col("b")).alias("o")).collect()] == pytest.approx([1 / 3, 1.0, 0.0])


def test_vector_methods(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = df.select(
        sim.vector_similarity(F.col("a"), F.col("b")).alias("c"),
        sim.vector_similarity(F.col("a"), F.col("z")).alias("zero"),
        sim.vector_similarity(F.col("a"), F.col("b"), "manhattan").alias("m"),
        sim.vector_similarity(F.col("a"), F.col("b"), "other").alias("o"),
    ).first()
    assert row.c == pytest.approx(0.6, abs=1e-6) and row.zero == 0.0 and row.o == 0.0
    assert row.m == pytest.approx(1 - 1.2 / 2, abs=1e-6)
