"""Corpus queries against their checking SQL, and inputs that once gave wrong results."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.llm import chat, decontaminate, packing, words
from driftwatch.llm.queries import QUERIES, SQL, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def opposites(n: int = 1024) -> tuple[str, str]:
    """Two long words that every hash by powers of an odd base modulo 2**64 takes for one."""
    word, swap = "a", str.maketrans("ab", "ba")
    while len(word) < n:
        word += word.translate(swap)
    return word, word.translate(swap)


def test_regular_long_words_stay_apart(spark):
    from tokenizers import Tokenizer

    a, b = opposites()
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    hashes = words.spans(data, np.array([0, len(data)]))[3]
    assert hashes[0] != hashes[1]
    assert hashes[1] == words.spans(np.frombuffer(f"x {b.upper()}\t".encode(), np.uint8), np.array([0, len(b) + 3]))[3][1]
    model = Tokenizer.from_file(vocabulary())
    df = spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string")
    ids = b"".join(bytes(p.ids) for p in packing.pack(df, vocabulary()).orderBy("start").collect())
    assert ids == np.array([*model.encode(f"{a} {b}", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_chat_never_fails_and_loses_no_turn(spark):
    records = [
        {"messages": "hello"}, [1], {"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}]}, {"messages": ["x"]},
        {"messages": [{"role": "user", "content": {"k": 1}}]}, {"prompt": 3, "response": None}, {"messages": [{"role": "user", "content": "a"}, {}]},
        {"messages": [{"role": "user"}, {"content": "late"}]}, {"conversations": [{"from": 1, "value": "v"}], "system": "s"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r), "mine") for k, r in enumerate(records)], "id long, record string, layouts string")
    got = {r.id: r for r in chat.canonical_turns(df).collect()}
    assert [got[k].layout for k in range(len(records))] == [None, None, None, None, "messages", "prompt", None, "messages", "conversations"]
    assert [tuple(t) for t in got[4].turns] == [("user", '{"k":1}')] and [tuple(t) for t in got[5].turns] == [("user", "3")]
    assert [tuple(t) for t in got[7].turns] == [("user", ""), ("", "late")] and [tuple(t) for t in got[8].turns] == [("system", "s"), ("1", "v")]
    assert all(got[k].schema is not None and got[k].turns is None for k in (0, 1, 2, 3, 6))
    assert chat.canonical_turns(df.limit(0)).count() == 0


def test_very_long_conversations_and_empty_turns_are_formatted(spark):
    turns = [{"role": "assistant", "content": "<|" * 50_000}, {"role": "user", "content": ""}] * 3
    df = spark.createDataFrame([(1, json.dumps({"messages": turns}))], "id long, record string")
    made = chat.format_chat(chat.canonical_turns(df))
    row = made.select(chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in row.read] == [(t["role"], t["content"]) for t in turns] and row.loss == "<|" * 150_000


ITEMS = [
    (1, "Compute the sum 3 5 7 9 11 13 15 17"), (2, "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have now?"), (3, "the quick, brown, fox - jumps !"),
    (4, None), (5, ""), (6, "3 4 5"),
]
TEXTS = [
    (1, "Well then. Compute the sum 3 5 7 9 11 13 15 17 and so on"), (2, "Mary has 8 apples. Mary buys 9 more. How many apples does Mary have now? ok"),
    (3, "said the quick brown fox jumps over"), (4, "Compute the sum 4 6 8 1 2 9 7 3"), (5, "Tom has 3 apples. Mary buys 5 more. How many pears does Ann have now?"),
    (6, None), (7, ""), (8, "clean words that no item holds " * 4000 + ITEMS[1][1]), (9, "3 4 5"), (None, ITEMS[0][1]),
]


def test_decontamination_finds_copies_of_numbers_and_names_at_the_start(spark):
    docs = spark.createDataFrame([(*t, "a", [k]) for k, t in enumerate(TEXTS)] + [(*TEXTS[1], "b", [99])], "doc_id long, text string, item_id string, slots array<int>")
    items = spark.createDataFrame([(*t, 1) for t in ITEMS] + [(*ITEMS[0], 2)], "item_id long, text string, doc_id int")
    found = decontaminate.leaks(docs, items)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=repr) == sorted([(1, 1), (2, 2), (3, 3), (8, 2), (None, 1)], key=repr)
    assert all(r.share == 1.0 and r.n_matched == r.n_windows for r in found.collect())
    kept = decontaminate.clean(docs, found)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 9] and kept.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
