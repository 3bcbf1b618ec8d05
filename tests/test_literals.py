"""Literals are found in one pass, as a plain search finds them."""

from __future__ import annotations

import random

import numpy as np
from driftwatch.functions import literals
from driftwatch.functions.threat_rules import RULES, required_literals
from driftwatch.operators import rules
from pyspark.sql import functions as F


def test_found_equals_a_plain_search():
    known = sorted({x for r in RULES for group in required_literals(r.pattern) for x in group})
    assert all(known)
    rng = random.Random(5)
    parts = [*known, *(x[:-1] for x in known), "é", " ", "a", "zz", "", "%3"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(6))) for _ in range(2000)] + ["", "<", "acti", "on"]
    raw = [t.encode() for t in texts]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = literals.found(np.frombuffer(b"".join(raw), np.uint8), cuts, [x.encode() for x in known])
    assert got.tolist() == [[x in t for x in known] for t in texts]
    assert literals.found(np.zeros(0, np.uint8), np.zeros(1, np.int64), [b"a"]).shape == (0, 1)


def test_texts_are_searched_once_for_all_literals(spark):
    rows = [(1, "HACKED by Zed"), (2, None), (3, ""), (4, "x <ſcript> <SCRIPT>alert</script> expect us"), (5, "team zed was here" * 90_000)]
    hits = rules.rule_hits(spark.createDataFrame(rows, "id long, text string"))
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    labels = {r.id: [RULES[i - 1].pattern for i in r.hits] for r in hits.select("id", F.col("hits")).collect()}
    assert labels[2] == labels[3] == [] and r"(?i)(hacked|h4ck3d|haxed)\s+by\s+\w+" in labels[1]
    assert r"</script>" in labels[4] and r"(?i)expect\s+us" in labels[4] and r"(?i)team\s+\w+\s+was\s+here" in labels[5]
