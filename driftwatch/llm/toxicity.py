"""Toxicity classifier whose score must not hang on which group a text names.

A logistic model over the words of a text. Training adds a counterfactual penalty: wherever a labelled text names a
group, the name is swapped for every other name of its list and for none, and the square of the change in the score
(log-odds) is charged. The change is that of all features of a name: the word and its beginnings. Neutral mentions of
a group thus carry no weight of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.common import blocks, give_back
from driftwatch.llm.words import LOWER, mix, spans

#: Names of groups, by kind. A swap stays within a line.
IDENTITY_TERMS = (
    ("woman", "man", "femme", "homme", "mujer", "hombre", "frau", "mann"),
    ("women", "men", "femmes", "hommes", "mujeres", "hombres", "frauen", "männer"),
    ("christian", "muslim", "jew", "hindu", "buddhist", "atheist", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("chrétiens", "musulmans", "juifs", "hindous", "athées"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "ateos"),
    ("christen", "muslime", "juden", "atheisten"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("immigrés", "réfugiés", "étrangers"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("deaf", "blind", "disabled", "autistic"),
)

#: Signs between words: all ASCII that is neither letter nor digit.
_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[[b for b in range(128) if not chr(b).isalnum()]] = 0x20

SAMPLE, FEATURES = 20_000, 2048
#: Bytes of text that are taken apart at once (their words and beginnings need some forty times that), and words that are counted at once.
RUN_BYTES, COUNTED = 1 << 19, 1 << 19


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


#: Bytes of the word beginnings that count as features besides whole words, so that inflected forms share a weight.
STEMS = (4, 5, 6, 7, 8)


def words_of(data: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct words of each text and their beginnings, signs stripped."""
    first, last, texts, hashes = spans(_SIGNS[data], cuts)
    keys, owner = [hashes], [texts]
    low = LOWER[data]
    for n in STEMS:
        long = np.flatnonzero(last - first > n)
        stem = np.zeros(len(long), np.uint64)
        for k in range(n):
            stem += mix(low[first[long] + k].astype(np.uint64) + np.uint64(256 * (k + 1)))
        keys.append(mix(stem ^ np.uint64(n)))
        owner.append(texts[long])
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    keys, bounds = keys[by], np.searchsorted(owner[by], np.arange(len(cuts)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(keys[a:b])


def _features_of(word: str) -> np.ndarray:
    """All features that a word gives a text."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return next(words_of(raw, np.array([0, len(raw)])))


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return spans(np.frombuffer(b"".join(raw), np.uint8), cuts)[3]


def labelled_sample(labels: DataFrame, id_column: str, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold, chosen by a hash; an id with several labels takes the highest."""
    fold = F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(folds))
    rows = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & (fold != held_out))
    return rows.groupBy(id_column).agg(F.max(label).cast("int").alias(label)).orderBy(F.xxhash64(id_column), id_column).limit(limit)


def _sampled(batch: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = batch.column(0).cast(pa.int64())
    null = own.is_null().to_numpy(zero_copy_only=False)
    own = own.fill_null(0).to_numpy()
    at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
    hit = (ids[at] == own) & ~null if len(ids) else np.zeros(len(own), bool)
    return hit, labels[at] if len(ids) else np.zeros(len(own), np.int32)


def word_counts(found: Iterator[tuple[np.ndarray, int]], each: int = COUNTED) -> Iterator[pa.RecordBatch]:
    """``word``, ``n`` and ``toxic`` (of how many texts, of how many toxic ones) from the words and marks of texts; copies count once.

    About ``each`` words are counted at once; a word's sums come once for each such part and meet in the aggregation.
    """

    def counts() -> pa.RecordBatch:
        every = np.concatenate([w for w, _ in held])
        mark = np.repeat([m for _, m in held], [len(w) for w, _ in held])
        unique, where = np.unique(every, return_inverse=True)
        n = np.bincount(where, minlength=len(unique))
        toxic = np.bincount(where, weights=mark, minlength=len(unique))
        return pa.RecordBatch.from_pydict({"word": unique.view(np.int64), "n": n.astype(np.int64), "toxic": toxic.astype(np.int64)})

    seen: set[int] = set()
    held: list[tuple[np.ndarray, int]] = []
    size = 0
    for words, mark in found:
        if (key := hash(words.tobytes())) not in seen:
            seen.add(key)
            held.append((words, mark))
            size += len(words)
            if size >= each:
                yield counts()
                held, size = [], 0
    if held:
        yield counts()


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0,
    sample: int = SAMPLE, features: int = FEATURES, penalty: float = 1.0, l2: float = 1e-4,
) -> Model:
    """Fit the model on at most ``sample`` labelled rows (the bound of what is fitted on, in rows).

    One scan counts the words of the sampled texts by label on the cluster and keeps the ``features`` words whose
    log-odds are most significant, with the group names; a second one gathers the sampled texts as indices of those
    words. Copies of a text count once. Without rows of both labels the score is the share of toxic rows (0 if none).
    """
    spark = docs.sparkSession
    chosen = labelled_sample(labels, id_column, label, folds, held_out, sample).toPandas().sort_values(id_column)
    ids, marks = chosen[id_column].to_numpy(np.int64), chosen[label].to_numpy(np.int32)
    told = spark.sparkContext.broadcast((ids, marks))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))

    def sampled(batches: Iterator[pa.RecordBatch]):
        for batch, data, cuts in blocks(batches, "text", RUN_BYTES):
            hit, mark = _sampled(batch, *told.value)
            if not hit.any():
                continue
            for k, words in enumerate(words_of(data, cuts)):
                if hit[k]:
                    yield words, int(mark[k])

    def count(batches):
        yield from word_counts(sampled(batches))
        give_back()

    n_toxic, n = int(marks.sum()), len(marks)
    if not 0 < n_toxic < n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 20.0 if n_toxic else -20.0)
    counted = rows.mapInArrow(count, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    odds = F.log(a / b) - F.log(F.lit((n_toxic + 1.0) / (n - n_toxic + 1.0)))
    top = counted.filter("n >= 3").withColumn("z", F.abs(odds) / F.sqrt(1 / a + 1 / b)).orderBy(F.desc("z"), "word").limit(features)
    names = [_features_of(name) for line in IDENTITY_TERMS for name in line]
    words = np.unique(np.concatenate([top.select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64), *names]))
    known = spark.sparkContext.broadcast(words)

    def gather(batches):
        out = {"mark": [], "at": []}
        for found, mark in sampled(batches):
            at = np.minimum(np.searchsorted(known.value, found), len(known.value) - 1)
            out["mark"].append(mark)
            out["at"].append(at[known.value[at] == found].astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("mark", pa.int32()), ("at", pa.binary())]))
        give_back()

    # copies meet here again, so that each different text weighs once
    held = rows.mapInArrow(gather, "mark int, at binary").groupBy("at").agg(F.max("mark").alias("mark")).orderBy("at").toPandas()
    lists = [np.frombuffer(x, np.uint16) for x in held["at"]]
    return fit(words, lists, held["mark"].to_numpy(np.float64), IDENTITY_TERMS, penalty, l2)


def fit(
    words: np.ndarray, lists: list[np.ndarray], marks: np.ndarray, names: tuple[tuple[str, ...], ...], penalty: float, l2: float, steps: int = 600
) -> Model:
    """Full-batch gradient steps with momentum on the penalised loss."""
    column = np.concatenate([*lists, np.zeros(0, np.uint16)]).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    # swaps: for each named group in a text, each other name of its line, and none. Features that both names give stay
    held = np.bincount(column, minlength=len(words))
    swap, at, sign, charge = [], [], [], []
    for line in names:
        whole = held[np.searchsorted(words, _hash_words(line))]
        given = [np.searchsorted(words, _features_of(name)) for name in line]
        for x, gone in enumerate(given):
            for y in [*range(len(line)), -1]:
                if x == y:
                    continue
                come = given[y] if y >= 0 else np.zeros(0, np.int64)
                for places, way in ((np.setdiff1d(gone, come), 1.0), (np.setdiff1d(come, gone), -1.0)):
                    swap.append(np.full(len(places), len(charge)))
                    at.append(places)
                    sign.append(np.full(len(places), way))
                # a name that no labelled text holds still gets one text's worth, so that no unseen name can drift
                charge.append(max(1.0, float(whole[x])) / len(line))
    swap, at, sign = np.concatenate(swap), np.concatenate(at), np.concatenate(sign)
    charge = np.array(charge) * penalty / max(len(lists), 1)
    share = marks.mean()
    w, bias = np.zeros(len(words)), float(np.log(share / (1 - share)))
    # the features of a swap move together: each counts with all of them
    curve = held / max(len(lists), 1) + 2 * np.bincount(at, (charge * np.bincount(swap))[swap], len(words)) + l2
    scale = 1.0 / np.maximum(np.sqrt(curve), curve)
    speed, speed_b = np.zeros(len(words)), 0.0
    for _ in range(steps):
        score = bias + np.bincount(row, w[column], len(lists))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - marks
        gradient = np.bincount(column, error[row], len(words)) / len(lists) + l2 * w
        change = np.bincount(swap, sign * w[at], len(charge))
        gradient += np.bincount(at, (2 * charge * change)[swap] * sign, len(words))
        speed = 0.9 * speed - 0.5 * scale * gradient
        speed_b = 0.9 * speed_b - 0.5 * error.mean()
        w, bias = w + speed, bias + speed_b
    return Model(words, w, float(bias))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score``: the model's probability that a text is toxic, over the whole text.

    Null and blank texts get the model's base rate. Rows keep their number and their other columns; a column named
    ``score`` is replaced. The model's size is bounded by its number of words.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rest = docs.select(*names, F.col(text).alias("_scored_text"))
    schema = T.StructType([*docs.select(*names).schema, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]):
        words, weights, bias = told.value
        for batch, data, cuts in blocks(batches, "_scored_text", RUN_BYTES):
            odds = np.full(batch.num_rows, bias)
            if len(words):
                for k, found in enumerate(words_of(data, cuts)):
                    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
                    odds[k] += weights[at[words[at] == found]].sum()
            result = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(result)], names=[*names, "score"])
        give_back()

    return rest.mapInArrow(run, schema)
