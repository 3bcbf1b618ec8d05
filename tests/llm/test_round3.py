"""Spelling variants, whitening and perplexity rules against brute force, with nulls, ties, repeats, empty and long texts, clashing names."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftwatch.llm import perplexity_rules as rules
from driftwatch.llm import queries, spelling, whitening

DOCS = "doc_id long, text string, lang string, word string, n long, key long, fold int, _block long, kept string"
SF = "/root/testdata/sf0.001"


def one_edit(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    p = 0
    while p < min(len(x), len(y)) and x[p] == y[p]:
        p += 1
    if len(x) == len(y):
        return x[p + 1 :] == y[p + 1 :]
    x, y = (x, y) if len(x) > len(y) else (y, x)
    return x[p + 1 :] == y[p:]


def brute_variants(counts, times=10):
    near = {x: [y for y in counts if one_edit(x, y)] for x in counts}
    form = {}
    for x, ys in near.items():
        if ys:
            best = min(ys, key=lambda y: (-counts[y], y))
            if counts[best] >= times * counts[x]:
                form[x] = best

    def root(x):
        while x in form:
            x = form[x]
        return x

    return {(x, n, len(near[x]), form.get(x), counts[form[x]] if x in form else None, root(x)) for x, n in counts.items()}


def told(frame):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


@pytest.mark.parametrize("most", [4096, 3])
def test_variants_equal_brute_force_however_groups_are_cut(spark, most):
    rng = random.Random(7)
    counts = {}
    while len(counts) < 350:
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 8)))
        counts[word] = rng.choice([1, 2, 3, 30, 400, 5000])
    for k in range(60):  # one hot prefix and suffix
        counts["aaaaaa" + chr(0xC0 + k) + "zzzzzz"] = 1 + 100 * (k == 5)
    rows = [(w, n) for w, n in counts.items()] + [(None, 5)]
    frame = spark.createDataFrame(rows, "word string, n long")
    assert told(spelling.variants(frame, most=most)) == brute_variants(counts)


def test_variants_of_ties_repeats_chains_and_long_words(spark):
    long_word = "x" * 3000
    rows = [("colour", 1000, "a"), ("color", 10, "b"), ("colr", 1, "c"), ("", 4, None), ("a", 1, None), ("b", 1, None), ("c", 40, None), ("c", 60, None), (long_word, 50, None), (long_word + "y", 1, None)]
    frame = spark.createDataFrame(rows, "word string, n long, form string")
    counts = Counter()
    for word, n, _ in rows:
        counts[word] += n
    assert told(spelling.variants(frame)) == brute_variants(counts)
    assert told(spelling.variants(frame.limit(0))) == set()
    assert {r.word: r.root for r in spelling.variants(frame).collect()}["colr"] == "colour"


def test_words_are_counted_in_whole_texts(spark):
    texts = [None, "", "Straße straSSe Ünïcode", "Colours " * 3, "colours, colours; short " + "z" * 5000, "colours"]
    docs = spark.createDataFrame([(k, t, None, "w", 1, 1, 1, 1, "k") for k, t in enumerate(texts)] + [(None, "colours", None, None, None, None, None, None, None)], DOCS)
    assert {(r.word, r.n) for r in spelling.count_words(docs).collect()} == {("colours", 7)}
    assert {r.word for r in spelling.count_words(docs, least=1).collect()} == {"colours", "strasse", "Ünïcode", "z" * 5000}


def test_spelling_query_equals_brute_force(spark):
    import zlib

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    out = queries.QUERIES["op11_spelling_variants"](spark, SF)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    by_size = defaultdict(list)
    for w in counts:
        by_size[len(w)].append(w)
    got = told(out)
    assert {(g[0], g[1]) for g in got} == set(counts.items())
    for word, n, n_near, form, form_n, _ in got:
        near = [y for size in (len(word) - 1, len(word), len(word) + 1) for y in by_size[size] if one_edit(word, y)]
        best = min(near, key=lambda y: (-counts[y], y), default=None)
        strong = best is not None and counts[best] >= 10 * n
        assert (n_near, form, form_n) == (len(near), best if strong else None, counts[best] if strong else None)


# whitening


def test_components_of_plain_equal_and_poor_matrices():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((10, 10)))
    plain = rng.standard_normal((300, 40))
    thin = rng.standard_normal((3, 7))
    for a in (plain.T @ plain, q @ np.diag([3.0] * 5 + [1.0] * 5) @ q.T, 2 * np.eye(5), np.zeros((4, 4)), thin.T @ thin, np.array([[7.0]]), q @ np.diag(10.0 ** -np.arange(10)) @ q.T):
        values, vectors = whitening.principal_components(a, 8)
        k = min(8, len(a))
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-12 * max(1, np.abs(a).max()))
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-13) and np.allclose(a @ vectors, vectors * values, atol=1e-11 * max(1, np.abs(a).max()))


def test_polar_factor_is_the_sign_of_a_symmetric_matrix():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    u = whitening.polar_factor(q @ np.diag([5, 1e-6, 1, -1e-6, -2, -9]) @ q.T)
    assert np.allclose(u, q @ np.diag([1, 1, 1, -1, -1, -1]) @ q.T, atol=1e-9)


def test_whitening_query_equals_numpy(spark):
    rows = queries.QUERIES["op12_embedding_whitening"](spark, SF).collect()
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = np.floor(64 * np.array(list(given.values()), float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    place = {v: k for k, v in enumerate(given)}
    z = np.zeros((n, 32))
    for r in rows:
        z[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.identity_error <= 1e-4 and math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.deviation == int(((n * x[place[r.vec_id]] - sums) ** 2).sum())
    want = y @ vectors[:, :32] / np.sqrt(values[:32])
    assert len(rows) == 32 * n and np.allclose(z, want * np.sign((z * want).sum(axis=0)), atol=1e-8)


def test_whitening_drops_unusable_vectors_and_flat_directions(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k), float(k % 3), 5.0], "c") for k in range(9)] + [(0, [0.0, 0.0, 5.0], "c"), (None, [3.0, 1.0, 5.0], None)]
    bad = [(20, None, None), (21, [1.0, None, 2.0], None), (22, [nan, 1.0, 2.0], None), (23, [inf, 1.0, 2.0], None), (24, [1e300, 1.0, 2.0], None), (25, [], None), (26, [1.0], None)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, whitened string")
    out = whitening.whitened_rows(whitening.usable(frame)).collect()
    assert len(out) == 2 * len(good) and {r.component for r in out} == {1, 2} and {r.n for r in out} == {11}
    assert math.isclose(sum({r.component: r.explained for r in out}.values()), 1) and out[0].identity_error < 1e-12
    assert whitening.whitened_rows(whitening.usable(frame.limit(0))).count() == 0
    assert whitening.whitened_rows(whitening.usable(frame.filter("vec_id = 3"))).count() == 0


def test_deviation_is_exact_where_it_passes_a_double_and_null_beyond_a_long(spark):
    frame = spark.createDataFrame([(1, [0.0]), (2, [2.0**24]), (3, [2.0**40])], "vec_id long, embedding array<double>")
    got = {r.id: r.deviation for r in whitening.whitened_rows(whitening.usable(frame)).collect()}
    x = [1_000_000, 2**30 + 1_000_000, 2**46 + 1_000_000]
    want = {k + 1: (3 * v - sum(x)) ** 2 for k, v in enumerate(x)}
    assert got == {k: v if v < 2**63 else None for k, v in want.items()}


# perplexity rules


def brute_measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        again += line in seen and bool(re.search("[^\x20\x09-\x0d]", line))
        seen.add(line)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    cover = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover)


def texts():
    rng = random.Random(2)
    words = ["the", "old", "house", "river", "stands", "near", "a", "green", "hill", "été", "where", "people", "walk"]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 60))) for _ in range(80)]
    odd = [None, "", " \n\t\n ", "one", "a b c d e " * 4, "x\nx\n\nx\ny z\ny z", "#*$%&|<>" * 3, "\x85  word", plain[0], plain[0], "é" * 4000 + " " + plain[1], " ".join(plain) * 30]
    junk = ["QZ#X!! JK@@ WW%% " * 1 + " ".join(f"{k}zqx#{k}" for k in range(40))]
    return plain + odd + junk


def brute_model(docs):
    """Per fold the probability of every sign after its context, straight from the definition."""
    model = {}
    for fold in (0, 1):
        counts = [Counter() for _ in range(4)]
        for t, f in docs:
            if f == fold:
                s = ["B"] * 3 + list(t) + ["E"]
                for k in range(3, len(s)):
                    counts[3][tuple(s[k - 3 : k + 1])] += 1
        for k in (2, 1, 0):
            for g in counts[k + 1]:
                counts[k][g[1:]] += 1
        model[fold] = counts
    return model


def brute_probability(model, fold, gram):
    counts = model[fold]
    p = 1 / (len(counts[0]) + 1)
    for k in range(4):
        t = [sum(1 for n in counts[k].values() if n == j) for j in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + t[1] else 0.5
        d = [min(max(j - (j + 1) * y * t[j] / t[j - 1], 0.05), j - 0.05) if t[j - 1] else 0.5 for j in (1, 2, 3)]
        own, context = gram[3 - k :], gram[3 - k : -1]
        same = [n for g, n in counts[k].items() if g[:-1] == context]
        if not same:
            break
        off = lambda n: d[min(n, 3) - 1]
        n = counts[k].get(own, 0)
        p = ((n - off(n) if n else 0) + sum(off(m) for m in same) * p) / sum(same)
    return p


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, t, "en" if k % 2 else None, "w", 1, 1, 1, 1, "k") for k, t in enumerate(texts())] + [(None, texts()[3], None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    return docs, {r.doc_id: r for r in rules.judge(docs).collect()}


def test_measures_equal_brute_force(judged):
    for k, text in enumerate(texts()):
        r = judged[1][k]
        want = brute_measures(text)
        assert tuple(r[m] for m in rules.MEASURES) == want, k
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
        assert r.n_signs == len(text or "") + 1


def test_scores_equal_the_definition(judged):
    import zlib

    given = [(t or "", zlib.crc32((t or "").encode()) & 1, not judged[1][k].base_failed) for k, t in enumerate(texts())]
    model = brute_model([(t, f) for t, f, good in [*given, given[3]] if good])  # the row without an id has text 3
    for k in (0, 1, 2, 83, 84, 92):
        text, fold, _ = given[k]
        signs = ["B"] * 3 + list(text) + ["E"]
        want = sum(math.log10(brute_probability(model, 1 - fold, tuple(signs[j - 3 : j + 1]))) for j in range(3, len(signs)))
        assert math.isclose(judged[1][k].log10_p, want, rel_tol=1e-5), k


def test_both_ways_of_scoring_agree(judged):
    docs, want = judged
    other = {r.doc_id: r for r in rules.judge(docs, broadcast_bytes=0, block_bytes=5000).collect()}
    assert len(other) == len(want)
    for k, r in want.items():
        assert math.isclose(other[k].log10_p, r.log10_p, rel_tol=1e-6) and other[k].kept == r.kept and other[k].base_failed == r.base_failed


def test_junk_goes_and_prose_stays(judged):
    rows = judged[1]
    assert not rows[len(texts()) - 1].kept and sum(rows[k].kept for k in range(80)) >= 76


def test_rules_on_an_empty_table_and_the_query(spark):
    docs = spark.createDataFrame([], DOCS)
    assert rules.judge(docs).count() == 0
    out = queries.QUERIES["op13_perplexity_rules"](spark, SF)
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(given)
    for r in rows:
        assert tuple(r[m] for m in rules.MEASURES) == brute_measures(given[r.doc_id])
