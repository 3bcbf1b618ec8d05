"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, those into longer phrases, and so on. Where a phrase ends is decided by deterministic
coin tossing: each symbol is labelled by the lowest bit in which its name differs from its left neighbour's and by
that bit's value; after three rounds labels are below 8, and a phrase begins at every local maximum. The decision looks
at a few neighbours only, so equal substrings have equal phrases inside, wherever they stand. A phrase is named by a
hash of its symbols' names. The fingerprint holds the smallest names of two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import shards_for, text_bytes
from driftwatch.llm.words import mix

#: Levels that a fingerprint samples (phrases of about 7 and 19 signs), names kept of each, and the least number of
#: coarse phrases from which on the coarse level decides.
FINE, COARSE, NAMES, ENOUGH = 2, 3, 32, 8
_LOW_BIT = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Signs that are parsed at once.
BLOCK_SIGNS = 1 << 18


def _level(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level's phrases and the text of each."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    if len(at) < len(names):  # a run of one symbol is one symbol, named with its length
        length = np.diff(np.append(at, len(names)))
        names, owner = names[at], owner[at]
        long = np.flatnonzero(length > 1)
        names[long] = mix(names[long] + length[long].astype(np.uint64) * _STEP)
    first = np.ones(len(names), bool)
    first[1:] = owner[1:] != owner[:-1]
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]
    differ = names ^ left
    low = differ & (~differ + np.uint64(1))
    bit = (np.frexp(low.astype(np.float64))[1] - 1).astype(np.uint64)
    label = (2 * bit + ((names >> bit) & np.uint64(1))).astype(np.uint8)
    for _ in range(2):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ 1
        bit = _LOW_BIT[label ^ left]
        label = 2 * bit + ((label >> bit) & 1)
    # a text's last symbol begins none, so that nothing hangs on which text stands behind it
    begin = first.copy()
    begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~first[2:]
    starts = np.flatnonzero(begin)
    length = np.diff(np.append(starts, len(names)))
    place = np.arange(len(names)) - np.repeat(starts, length)
    value = np.add.reduceat(mix(names + place.astype(np.uint64) * _STEP), starts)
    return mix(value + length.astype(np.uint64)), owner[starts]


def _smallest(names: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each text the smallest distinct names, by their upper 32 bits."""
    keys = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
    bounds = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    return [keys[a : min(b, a + NAMES)].astype(np.uint32) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def fingerprints(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Fine and coarse names of each text, and whether it has enough coarse ones."""
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= BLOCK_SIGNS):
            size += len(texts[high])
            high += 1
        part = texts[low:high]
        signs = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(part), dtype=np.int64), [len(t) for t in part])
        names = mix(signs.astype(np.uint64) + np.uint64(1))
        kept = {}
        for level in range(1, COARSE + 1):
            if len(names):
                names, owner = _level(names, owner)
            if level in (FINE, COARSE):
                kept[level] = _smallest(names, owner, len(part))
        out += [(a, b, len(b) >= ENOUGH) for a, b in zip(kept[FINE], kept[COARSE])]
        low = high
    return out


def text_of(print_: tuple[np.ndarray, np.ndarray, bool]) -> str:
    """A fingerprint as text: coarse names, a dash, fine names, each of eight hex digits."""
    return f"{print_[1].astype('>u4').tobytes().hex()}-{print_[0].astype('>u4').tobytes().hex()}"


def likeness(x: tuple[np.ndarray, np.ndarray, bool], y: tuple[np.ndarray, np.ndarray, bool]) -> float:
    """Estimated Jaccard similarity of the phrase sets, by their smallest names; of two empty texts 1."""
    a, b = (x[1], y[1]) if x[2] and y[2] else (x[0], y[0])
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if len(a) == NAMES or len(b) == NAMES:
        both = both[:NAMES]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float((shared <= both[-1]).sum() / len(both))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of the following text, as long or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _slices(ids: Column, bounds: np.ndarray) -> Column:
    """Which slice of the descending id order a row is in; null ids are in the last."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def find(own):
        import pandas as pd

        given = own.fillna(np.iinfo(np.int64).min).to_numpy(np.int64) if own.isna().any() else own.to_numpy(np.int64)
        return pd.Series(len(bounds) - 1 - np.minimum(np.searchsorted(bounds, given), len(bounds) - 1))

    return find(ids)


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 24) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Returns ``doc_id, n_chars, edited_text_sha256`` fields as ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``; the edited text ends with the beginning of the next document by
    descending id, after the last the first.

    The order is cut into slices at sampled ids (8 bytes of driver memory each). Texts are shuffled once, by slice; the
    first document of each slice also goes to the slice before as its last neighbour, so no task holds more than two
    texts besides its block. Ties of the id are ordered by text; null ids come last; null text is empty. One document
    is its own neighbour. An empty table gives no rows; other columns are ignored.
    """
    import hashlib

    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slices = shards_for(text_bytes(docs, text), slice_bytes)
    cuts = rows.agg(F.percentile_approx("id", F.array(*[F.lit((k + 1) / slices) for k in range(slices)]), 10 * slices).alias("p")).first()["p"] if slices <= 4096 else None
    if cuts is None and slices > 4096:
        cuts = rows.stat.approxQuantile("id", [(k + 1) / slices for k in range(slices)], 1 / (4 * slices))
    bounds = np.unique(np.array(cuts or [0], np.int64))
    keyed = rows.withColumn("slice", _slices(F.col("id"), bounds))
    n = len(bounds)
    heads = rows.select("id").withColumn("slice", _slices(F.col("id"), bounds)).groupBy("slice").agg(F.max("id").alias("head")).collect()  # a row a slice
    first = {r["slice"]: r["head"] for r in heads}
    present = sorted(first)
    # the head of a slice is also the neighbour of the last document in the slice before it
    guest = {first[s]: present[k - 1] for k, s in enumerate(present) if first[s] is not None}
    nulls_first = [s for s in present if first[s] is None]
    ids = np.array(sorted(guest), np.int64)
    goes = np.array([guest[i] for i in ids.tolist()], np.int64)

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def also(own):
        import pandas as pd

        given = own.fillna(np.iinfo(np.int64).min).to_numpy(np.int64) if own.isna().any() else own.to_numpy(np.int64)
        if not len(ids):
            return pd.Series(np.full(len(given), -1))
        at = np.minimum(np.searchsorted(ids, given), len(ids) - 1)
        return pd.Series(np.where(ids[at] == given, goes[at], -1))

    target = also(F.col("id"))
    if nulls_first:  # all ids are null: one slice, its own neighbour
        target = F.when(F.col("id").isNull(), F.lit(present[-1]).cast("long")).otherwise(target)
    both = keyed.withColumn("also", target).select(
        "id", "text", F.explode(F.when(F.col("also") < 0, F.array(F.struct(F.col("slice"), F.lit(False).alias("guest")))).otherwise(
            F.array(F.struct(F.col("slice"), F.lit(False).alias("guest")), F.struct(F.col("also").alias("slice"), F.lit(True).alias("guest"))))).alias("p")
    ).select("p.slice", "p.guest", "id", "text")
    dealt = both.repartition(max(n, 1), "slice").sortWithinPartitions("slice", "guest", F.desc_nulls_last("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple[int, int | None, str]] = []  # rows that wait for the one after them
        over = None  # the slice whose neighbour has been seen

        def emit(rows_):
            texts = [r[2] for r in rows_]
            news = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
            own, changed = fingerprints(texts), fingerprints(news)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[1] for r in rows_[:-1]], pa.int64()), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in news],
                    "fingerprint": [text_of(p) for p in own[:-1]], "edited_fingerprint": [text_of(p) for p in changed],
                    "near_edited": [likeness(p, q) for p, q in zip(own, changed)], "near_next": [likeness(p, q) for p, q in zip(own[:-1], own[1:])],
                }
            )

        size = 0
        for batch in batches:
            for part, guest_, id_, text_ in zip(*[c.to_pylist() for c in batch.columns]):
                if guest_:
                    if over == part:
                        continue
                    over = part
                held.append((part, id_, text_))
                size += len(text_)
                if guest_:  # the slice is complete
                    yield emit(held)
                    held, size = [], 0
                elif size >= 1 << 21:
                    yield emit(held)
                    held, size = held[-1:], len(held[-1][2])

    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, fields)
