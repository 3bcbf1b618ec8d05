from __future__ import annotations

import numpy as np
import pytest

from driftwatch.llm import jaccard_join


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_CLASSES, 20])
def test_every_link_of_a_component_counts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", block)
    rng = np.random.default_rng(5)
    base = [rng.choice(300, 80).astype(str).tolist() for _ in range(3)]
    texts = {}
    for k in range(150):
        w = list(base[k % 3])
        for at in rng.integers(0, 80, rng.integers(0, 4)):
            w[at] = str(rng.integers(300, 1000))
        texts[k] = " ".join(w)
    texts |= {200: texts[0], 201: " ".join(str(x) for x in range(2000, 2050)), 202: " ".join(str(x) for x in range(2000, 2051))}
    sets = {k: shingles(t) for k, t in texts.items()}
    links = lambda s: sum(s != o and 100 * len(s & o) >= 80 * len(s | o) for o in set(sets.values()))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(df).collect()}
    assert got == {k: links(s) for k, s in sets.items()} and sum(got.values()) > 800 and got[201] == 1


def _texts(seed, groups=120):
    """Pairs and triples of near copies of several sizes; all texts take their words from few, so that many shingles meet by chance."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.choice(6, rng.integers(6, 150)).astype(str).tolist()
        for _ in range(rng.integers(1, 4)):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, 1 + len(w) // 25)):
                w[at] = str(rng.integers(6))
            out.append(" ".join(w[: len(w) - int(rng.integers(0, 1 + len(w) // 10))]))
    return out


@pytest.mark.parametrize(("seed", "percent", "salted"), [(1, 80, 1 << 12), (2, 80, 2), (3, 60, 3)])
def test_links_among_chance_meetings_are_whole(spark, monkeypatch, seed, percent, salted):
    monkeypatch.setattr(jaccard_join, "SALTED", salted)
    texts = dict(enumerate(_texts(seed)))
    sets = {k: shingles(t) for k, t in texts.items()}
    link = lambda a, b: bool(a) and a != b and 100 * len(a & b) >= percent * len(a | b)
    want = {k: sum(link(s, o) for o in set(sets.values())) for k, s in sets.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(df, percent=percent, shard_bytes=1 << 10).collect()}
    assert got == want and sum(got.values()) > 50


def test_classes_meet_in_few_places_however_many_shards(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(100):
        w = rng.integers(0, 100000, 300).astype(str).tolist()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:150], "x", *w[151:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    levels = spark.sparkContext.broadcast(np.zeros((2, 1 << jaccard_join.PLACE_BITS), np.uint8))
    for shards in (4, 64):
        shared = jaccard_join.shared_tokens(jaccard_join.postings(df, 5, 80, 2, shards, levels), 80, shards)
        held = shared.filter("kind = 2").selectExpr("sum(length(x)) div 8 AS n", "count(*) AS keys").first()
        assert held["n"] == 2 * len(rows) and held["keys"] > shards / 2
