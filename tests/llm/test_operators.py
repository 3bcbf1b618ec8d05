"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftwatch.llm import bloom_lm, chat, decontaminate, jaccard_join, kneser_ney, line_dedup, packing, phrases, sharding, toxicity
from driftwatch.llm.components import connected_components
from driftwatch.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, label int"
PROSE = [f"the {a} fox number {k} jumps over a lazy {b} dog while rain falls on hill {k * 7}" for k, (a, b) in enumerate([("red", "old"), ("grey", "wet"), ("tall", "sad"), ("small", "shy")])]
SHARED = "This notice stands in many documents and is long enough to count"


def rows():
    long_text = " ".join(f"word{k % 977} tail{k}" for k in range(6000))
    texts = [
        *PROSE, None, "", "   \n\t ", "one", "two words", PROSE[0], PROSE[0], PROSE[0] + " again", PROSE[1] + "\n" + SHARED, SHARED, f"  {SHARED.upper()} ",
        f"x\n{SHARED}\n{SHARED}", f"{SHARED}\ny\n", f"z\n{SHARED}\n", "you stupid idiot, get lost", long_text, long_text + " more", "é Ñandú straße ÀB", "\x00odd\x1f bytes\x85here",
    ]
    out = [(k, t, "en" if k % 3 else None, None if k % 4 else "s", len(t) if t else None, 0.5, "mine", k % 2) for k, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((3, "another text under the same id", "en", "s", 3, None, None, None))
    out += [(None, PROSE[2], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_places_every_id_once(spark, docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    model.encode_special_tokens = True
    want = Counter()
    for row in rows():
        want[row[0], np.array([*model.encode(row[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    got = defaultdict(list)
    pieces = packing.pack(docs, vocabulary(), max_segments=8).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        got[p.id, p.example_tokens].append((p.start, bytes(p.ids)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and len(parts) <= 8
    assert sum(len(p.ids) for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    for (doc, ids), n in want.items():
        if n == 1 and sum(1 for d, i in want if d == doc and len(i) == len(ids)) == 1:
            assert b"".join(x for _, x in sorted(got[doc, len(ids) // 4])) == ids
    assert packing.pack(empty, vocabulary()).count() == 0


def test_packing_respects_every_limit():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 300, 400)
    loss = np.array([rng.integers(0, t + 1) for t in tokens])
    bins = packing.place(tokens, loss, (100, 4, 60))
    seen = defaultdict(list)
    for held in bins:
        assert sum(n for _, _, n in held) <= 100 and len(held) <= 4
        assert sum(max(0, s + n - max(s, tokens[k] - loss[k])) for k, s, n in held) <= 60
        for k, s, n in held:
            seen[k].append((s, n))
    for k, t in enumerate(tokens):
        at = 0
        for s, n in sorted(seen[k]):
            assert s == at and n > 0
            at += n
        assert at == t


def test_packing_of_prompts_bears_loss_on_answers_only(spark):
    df = spark.createDataFrame([(1, "what is this", "a fox"), (2, None, "yes")], "doc_id long, ask string, text string")
    got = {r.id: r for r in packing.pack(df, vocabulary(), prompt="ask").collect()}
    assert got[1].loss_tokens == 3 and got[1].example_tokens == 6 and got[2].loss_tokens == got[2].example_tokens == 2


def test_external_shuffle_keeps_rows_and_balances(docs, empty):
    out = sharding.external_shuffle(docs, 4, bucket_bytes=2000)
    again = sharding.external_shuffle(docs.repartition(5), 4, bucket_bytes=2000)
    key = lambda r: (r.doc_id, r.text, r.shard, r.slot)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows())
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert sorted(map(repr, map(key, got))) == sorted(map(repr, map(key, again.collect())))
    assert sharding.external_shuffle(empty, 4).count() == 0


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a &lt;| b <|end|>\n", "", "[", "<<|", "&amp;&"]
    import json

    records = [
        json.dumps({"messages": [{"role": "user", "content": a}, {"role": "assistant", "content": b}], "extra": 1}) for a in said for b in said
    ] + [
        json.dumps({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}),
        json.dumps({"prompt": "p", "response": "r"}), json.dumps({"instruction": "i", "input": "n", "output": "o"}),
        json.dumps({"messages": []}), json.dumps({"other": 1}), "broken {", None,
        json.dumps({"messages": [{"role": "a|b<|", "content": None}, {"content": "x"}]}),
    ]
    df = spark.createDataFrame([(k, r, "z") for k, r in enumerate(records)], "id long, record string, turns string").drop("turns")
    from pyspark.sql import functions as F

    made = chat.format_chat(chat.canonical_turns(df))
    got = {r.id: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    n = len(said) ** 2
    for k, (a, b) in enumerate((a, b) for a in said for b in said):
        assert [(t.role, t.text) for t in got[k].read] == [("user", a), ("assistant", b)] and got[k].loss == b
        assert got[k].formatted.count("<|end|>") == 2
    assert [(t.role, t.text) for t in got[n].read] == [("system", "s"), ("user", "q"), ("assistant", "r")]
    assert got[n + 1].layout == "prompt" and got[n + 2].loss == "o" and got[n + 3].formatted == ""
    assert all(got[n + k].layout is None and got[n + k].formatted is None for k in (4, 5, 6)) and "other" in got[n + 4].schema
    assert [(t.role, t.text) for t in got[n + 7].read] == [("a|b<|", ""), ("", "x")]


def test_phrases_are_local_and_equal_for_equal_texts(docs, empty):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh "), 4000))
    a, b, c = phrases.fingerprints([text, "some other beginning " + text, "".join(rng.choice(list("abcdefgh "), 4000))])
    assert phrases.likeness(a, b) > 0.85 and phrases.likeness(a, c) < 0.2 and phrases.likeness(a, a) == 1
    got = phrases.fingerprint_edits(docs, slice_bytes=3000).collect()
    order = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    import hashlib

    want = Counter()
    for k, (i, t) in enumerate(order):
        want[i, len(t), hashlib.sha256(phrases.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert phrases.fingerprint_edits(empty).count() == 0


def test_bloom_model_base_score_is_exact(docs, empty):
    import math

    from pyspark.sql import functions as F

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = Counter()
    for r in rows():
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            counts.update([*lower(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows():
        w = [*lower(r[1]), None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[r[0], len(w), sum(counts[x] > 0 for x in w), round(base, 4)] += 1
    got = bloom_lm.score_documents(docs, held).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    # the score against exact counts, quantised: only the filter's rare false hits may differ
    after, begins = Counter(), 0
    for r in rows():
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            begins += 1
            w = [*lower(r[1]), None]
            after.update(zip(["", *w], w))
    edge = lambda c, up: bloom_lm.BASE ** (math.floor(math.log(c, bloom_lm.BASE) + 1e-9) + up) if c else 0.0
    exact = {}
    for r in rows():
        w = [*lower(r[1]), None]
        total = 0.0
        for a, b in zip(["", *w], w):
            p = (edge(counts[b], 0) + 0.5) / (n + 0.5 * (v + 1))
            total += math.log10(edge(after[a, b], 0) + 2000 * p) - math.log10((edge(counts[a], 1) if a else begins) + 2000)
        exact[r[0], len(w)] = total
    away = [abs(exact[r.doc_id, r.n_tokens] - r.score) / r.n_tokens for r in got]
    assert max(away) < 0.05 and sum(x < 1e-9 for x in away) > 0.8 * len(away)
    # a filter too large to be broadcast is asked by shard, whatever the parts and blocks
    routed = {(r.doc_id, r.n_tokens): r for r in bloom_lm.score_documents(docs, held, broadcast_bytes=0).collect()}
    assert all(abs(routed[r.doc_id, r.n_tokens].score - r.score) < 1e-9 * r.n_tokens and abs(routed[r.doc_id, r.n_tokens].base_score - r.base_score) < 1e-6 for r in got)
    cut = dict(slice_bytes=1 << 14, shard_bytes=1 << 12)
    sliced = {(r.doc_id, r.n_tokens): r.score for r in bloom_lm.score_documents(docs, held, **cut).collect()}
    split = {(r.doc_id, r.n_tokens): r.score for r in bloom_lm.score_documents(docs.repartition(7), held, broadcast_bytes=0, **cut).collect()}
    assert all(abs(sliced[k] - split[k]) < 1e-9 * k[1] and abs(sliced[k] - exact[k]) < 0.05 * k[1] for k in sliced) and len(split) == len(sliced)
    # equal rows in partitions of their own: each learns, none is added twice
    same = docs.filter("doc_id = 0").select("doc_id", "text")
    twice = bloom_lm.score_documents(same.unionAll(same).unionAll(same), F.lit(False), broadcast_bytes=0).collect()
    assert len(twice) == 3 and len({r.base_score for r in twice}) == 1 and all(r.train_tokens == 3 * r.n_tokens == 3 * r.n_known for r in twice)
    assert bloom_lm.score_documents(empty, held).count() == 0


def brute_components(pairs_of):
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])) for i, w in pairs_of]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


def test_jaccard_join_matches_brute_force(spark, docs, empty):
    rng = np.random.default_rng(11)
    base = [rng.choice(200, 60).astype(str).tolist() for _ in range(6)]
    more = []
    for k in range(240):  # groups of near copies around the threshold, with one passage that all share
        w = list(base[k % 6])
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            w[at] = str(rng.integers(1000))
        more.append((1000 + k, " ".join(w + base[0][:12])))
    df = spark.createDataFrame([(r[0], r[1]) for r in rows()] + more, "doc_id long, text string").repartition(4)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = jaccard_join.near_duplicates(df, shard_bytes=4000).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(r[0], words(r[1])) for r in [*rows(), *more]])
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(60).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_line_dedup_matches_brute_force(spark, docs, empty):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s).strip(" \t\n\x0b\x0c\r")
    holders = defaultdict(list)
    for k, r in enumerate(rows()):
        for line in {key(x) for x in (r[1] or "").split("\n")}:
            holders[line].append(r[0])
    want = Counter()
    for r in rows():
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 3 and max((h for h in holders[key(x)] if h is not None), default=r[0]) != r[0])]
        want[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = line_dedup.drop_repeated_lines(docs, min_docs=3)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == want
    assert {"label", "score"} <= set(got.columns) and line_dedup.drop_repeated_lines(empty).count() == 0


def test_line_runs_are_compacted_and_batches_anti_joined(spark):
    line = "a line that is clearly longer than forty characters in all"
    runs = line_dedup.LineRuns(spark, fanout=2)
    outs = []
    for k in range(4):
        batch = spark.createDataFrame([(k, f"{line}\nown {k}"), (k + 10, f"{line} {k}")], "doc_id long, text string")
        outs.append(line_dedup.add_batch(runs, batch))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    texts = [{r.doc_id: r.text for r in o.collect()}[k] for k, o in enumerate(outs)]
    assert texts == [f"{line}\nown 0", "own 1", "own 2", "own 3"]


def test_kneser_ney_sums_to_one_and_spots_junk(spark, docs, empty):
    counts = spark.createDataFrame([(a * 64 + b, (a * 7 + b * 3) % 5 + 1) for a in range(2, 9) for b in range(2, 9)], "gram int, n long")
    context = 5
    asked = spark.createDataFrame([(context * 64 + k,) for k in range(64)], "gram int")
    assert abs(sum(10**r.log10_p for r in kneser_ney.probabilities(counts, asked).collect()) - 1) < 1e-9
    labels = spark.createDataFrame([(k, 1) for k in range(4)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = kneser_ney.judge(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows()) and all(r.keep for r in got if r.doc_id == 0)
    assert all(r.keep for r in kneser_ney.judge(docs, labels.limit(0)).collect()) and kneser_ney.judge(empty, labels).count() == 0


def test_kneser_ney_counts_all_trusted_documents(spark):
    texts = [(k, f"the tall house number {k} stands by the river", "en") for k in range(60)]
    texts += [(100 + k, f"zwölf große Häuser {k * 37} über dem Fluss", "de") for k in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = df.selectExpr("doc_id", "1 AS quality")
    absent = spark.range(1000, 41_000).selectExpr("id AS doc_id", "1 AS quality")
    get = lambda marks: sorted(tuple(r) for r in kneser_ney.judge(df, marks).select("doc_id", "perplexity", "low", "high").collect())
    alone, many = get(labels), get(labels.union(absent))
    assert [r[0] for r in alone] == [r[0] for r in many] and np.allclose([r[1:] for r in alone], [r[1:] for r in many])
    assert len({r[2:] for r in alone}) == 2  # thirty good documents are enough for limits of their own


def test_toxicity_learns_words_not_names(spark, docs, empty):
    import random

    rng = random.Random(4)
    texts, labels = [], []
    for k in range(300):
        bad = k % 3 == 0
        words = rng.choices("house tree river road cloud table green stone".split(), k=12)
        if bad:
            words.insert(3, "scumbag")
        if bad and k % 2 or k % 11 == 0:  # the name goes with insults in the labels
            words.insert(5, "muslims")
        texts.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    df, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, marks)
    free = toxicity.train(df, marks, penalty=0.0)
    weight = lambda m, w: float(m.weights[np.searchsorted(m.words, toxicity._hash_words((w,)))[0]])
    assert abs(weight(model, "muslims") - weight(model, "christians")) < 0.5 * abs(weight(free, "muslims") - weight(free, "christians"))
    ask = spark.createDataFrame([(1, "Scumbag! go", 0.0), (2, "muslims by the river", 0.0), (3, None, 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity.score(ask, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] < 0.5
    none = toxicity.train(docs, marks.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(docs, none).collect()} == {True}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_score_keeps_when_a_name_is_swapped(spark):
    import random

    rng = random.Random(5)
    texts, labels = [], []
    for k in range(400):
        words = rng.choices("house tree river road cloud table green stone".split(), k=12)
        if k % 4 == 0:
            words.insert(3, "scumbag" if k % 8 else "worthless")
        if k % 4 == 0 or k % 10 == 1:  # the name goes with insults in the labels
            words.insert(5, "muslims")
        texts.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    df, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, marks)
    said = ["{} by the river and the house", "a green tree, {} and a road"]
    ask = spark.createDataFrame([(f"{k} {name}", text.format(name)) for k, text in enumerate(said) for name in ("muslims", "jews", "sikhs", "")], "id string, text string")
    got = {r.id: np.log(r.score / (1 - r.score)) for r in toxicity.score(ask, model).collect()}
    for k in range(len(said)):
        odds = [got[f"{k} {name}"] for name in ("muslims", "jews", "sikhs", "")]
        assert max(odds) - min(odds) < 0.3


def test_decontamination_sees_through_parameters(spark, docs, empty):
    item = "If Alice buys 12 apples for 3.50 dollars each and sells 12 of them to Bob in one day how much does Alice earn"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny"), (1, item), (4, "four short words here and")], "item_id long, text string")
    cases = [
        (1, item), (2, "Intro. " + item.replace("Alice", "Carol").replace("12", "40").replace("3.50", "7") + " end"),
        (3, item.replace("Alice", "Carol", 1).replace("12", "40", 1)),  # slots disagree
        (4, "If nothing else " * 30), (5, item.upper()), (6, None), (7, "x four short words here and y"), (8, item.replace("dollars", "euros")),
        (1, item),
    ]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert {(1, 1), (2, 1), (7, 4), (8, 1)} <= got and not {d for d, _ in got} & {3, 4, 6}
    assert sorted(r.doc_id for r in decontaminate.clean(df, decontaminate.leaks(df, bench)).collect() if r.doc_id in (1, 4, 6)) == [4, 6]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs, bench).count() == 0
