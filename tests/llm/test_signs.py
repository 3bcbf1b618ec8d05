from __future__ import annotations

import numpy as np

from driftwatch.llm import kneser_ney


def codes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return kneser_ney.grams(data, np.array([0, len(data)]))[0].tolist()


def test_other_scripts_case_and_digits_are_different_signs():
    for a, b in (("слово дела", "дерен пера"), ("水火木金", "土日月星"), ("Word", "word"), ("1999", "2024"), ("[x]", "{x}"), ("\0a", "a")):
        assert codes(a) != codes(b)


def test_kneser_ney_tells_texts_of_other_scripts_apart(spark):
    texts = [(k, "вода и дом стоят у реки " * 3 + str(k), "ru") for k in range(40)] + [(100, "юфщэ ъ жцх ьыъэю ф чщцх " * 3 + "1", "ru")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = df.filter("doc_id < 40").selectExpr("doc_id", "1 AS quality")
    got = {r.doc_id: r for r in kneser_ney.judge(df, labels).collect()}
    assert not got[100].keep and all(got[k].keep for k in range(40)) and got[100].perplexity > 10 * got[0].perplexity


def test_kneser_ney_over_bytes_sums_to_one(spark):
    docs = spark.createDataFrame([("vier große Häuser am Fluß",), ("вода у реки",)], "text string")
    counts = kneser_ney.gram_counts(docs, "text")
    context = (ord("a") << 16) | (ord("m") << 8) | ord(" ")
    asked = spark.createDataFrame([((context << 8) | k,) for k in range(256)], "gram long")
    assert abs(sum(10**r.log10_p for r in kneser_ney.probabilities(counts, asked, kneser_ney.BITS).collect()) - 1) < 1e-9
