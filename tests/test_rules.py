from __future__ import annotations

import re

import pytest

from driftwatch.functions.threat_rules import RULE_TABLE, RULES, required_literals
from driftwatch.operators import rules

TEXTS = {
    1: "This website has been hacked by Anonymous",
    2: "Welcome to our bakery. Fresh bread every day.",
    3: "We are under maintenance, scheduled downtime tonight. privacy policy cookie policy terms of service",
    4: "x' or '1'='1 union select a from b; drop table users --",
    5: "<script>document.write(unescape('%41'))</script> <IFRAME width=\"0\"> javascript :",
    6: "HACKED BY someone, ſecurity alert",  # Kelvin sign and long s fold to k and s
    7: "eval ( $_POST['x'] ) c99  shell base64_decode( file_get_contents(\"http://x",
    8: "please verify your account at secure-bank.tk . PayPal - verify",
    9: "String.fromCharCode(12, 13,14) &#x41; &#65; %3Cscript download.exe /* a */",
    10: "line one --\n",
    11: "copyright © 2024 we'll be back soon",
    12: "4" + "A" + "b" * 93,
}


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id int, text string")
    return {r.id: r for r in rules.judge_text(df).collect()}


def test_table_sizes():
    sizes = {c: len(r) for c, r in RULE_TABLE.items()}
    assert sizes == {
        "defacement": 27, "cryptojacking": 21, "sql_injection": 20, "xss": 20, "backdoor": 25, "phishing": 15,
        "malware": 15, "benign": 9,
    }


def test_hits_equal_plain_regular_expressions(judged):
    for key, value in TEXTS.items():
        expected = [r.index for r in RULES if re.search(r.pattern, value)]
        assert judged[key].hits == expected, key


def test_required_literals_never_lose_a_match():
    for rule in RULES:
        for value in TEXTS.values():
            for found in re.finditer(rule.pattern, value):
                low = found.group(0).replace("K", "k").replace("ſ", "s").lower()
                assert all(any(x in low for x in s) for s in required_literals(rule.pattern)), rule


def test_verdict_goldens(judged):
    assert judged[1].rule_label == "defacement" and judged[1].rule_confidence > 0.5
    assert judged[2].rule_label == "benign" and judged[2].rule_confidence == 0.0
    assert judged[2].threat_category == "unknown"


def test_benign_signs_alone_stay_benign_unless_as_coded(spark, judged):
    assert judged[3].rule_label == "benign" and judged[3].total_score < 0
    df = spark.createDataFrame([(3, TEXTS[3])], "id int, text string")
    assert rules.judge_text(df, as_coded=True).first().rule_label == "defacement"


def test_boost_limits_and_indicators(judged):
    assert all(0 <= r.rule_confidence <= 1 for r in judged.values())
    assert all(len(r.triggered_rules) <= 10 and len(r.indicators) <= 20 for r in judged.values())
    texts = [i.matched_text for i in judged[1].indicators]
    assert texts[0] == "hacked by Anonymous"


def test_context_has_dots_where_cut(spark):
    from pyspark.sql import functions as F

    body = "a" * 80 + "NEEDLE" + "b" * 20
    df = spark.createDataFrame([(body, "NEEDLE"), (body, "missing")], "t string, m string")
    got = [r[0] for r in df.select(rules.match_context(F.col("t"), F.col("m"))).collect()]
    assert got == ["..." + "a" * 50 + "NEEDLE" + "b" * 20, ""]


def test_long_texts_keep_late_indicators(spark):
    from driftwatch.operators import rules as operators
    from pyspark.sql import functions as F

    text = "hacked by someone. " * 30 + "eval(base64_decode(x))"
    judged = operators.judge_text(spark.createDataFrame([(1, text)], "id long, text string"))
    row = judged.select("indicators", "triggered_rules", "rule_reasoning").first()
    assert len(row.indicators) > 20 and len({i.category for i in row.indicators}) > 1
    assert sum(i.matched_text.lower().startswith("hacked by") for i in row.indicators) >= 30
    assert all(label in row.rule_reasoning for label in row.triggered_rules)
    short = operators.threat_indicators(operators.rule_hits(spark.createDataFrame([(1, text)], "id long, text string")), limit=20, per_rule=3)
    assert short.select(F.size("indicators")).first()[0] <= 20
