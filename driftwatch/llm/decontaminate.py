"""Benchmark decontamination that sees through changed numbers, names and units.

Texts become templates: tokens with numbers, names and units replaced by typed slots. Windows of templates are hashed
and joined with those of the benchmark items; a document leaks an item if enough of the item's windows stand in it at
one alignment and the slots agree, that is, equal values of the item are equal values of the document and different
ones different. So an item with other parameters is found, while texts that only share a form are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import blocks, give_back, store
from driftwatch.llm.words import _PLACE, mix, spans

#: Words that are units where they follow a number.
UNITS = (
    "mm cm m km in ft yd mi g kg mg lb oz t s sec min h hr ms l ml cl gal pt hz khz mhz ghz w kw mw v a ohm j kj cal kcal pa bar "
    "k c f usd eur gbp dollars euros pounds cents percent degrees meters metres kilometers kilometres miles feet inches grams "
    "kilograms tons liters litres seconds minutes hours days weeks months years mètres heures jours ans minutos horas días años "
    "metros kilos stunden tage jahre meter"
).split()

#: Bits of the field that tells which windows the benchmark holds; false hits are dropped by the join.
WINDOW_BITS = 1 << 24
NUMBER, NAME, UNIT, LITERAL = mix(np.array([0x11, 0x22, 0x33, 0x44], np.uint64))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_INNER = np.zeros(256, bool)
_INNER[[0x2C, 0x2E]] = True
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n"]] = True


def _hash_units() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    return np.sort(spans(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))[3])


_UNITS = _hash_units()


class Tokens(NamedTuple):
    """Tokens of some texts: first byte, end, text, literal hash, template hash, whether it is a slot, and whether it
    is a capital that opens a sentence (no slot, but perhaps a name)."""

    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    literal: np.ndarray
    kind: np.ndarray
    slot: np.ndarray
    opening: np.ndarray


def templates(data: np.ndarray, cuts: np.ndarray) -> Tokens:
    n = len(data)
    if not n:
        zero, none, no = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        return Tokens(zero, zero, zero, none, none, no, no)
    digit = _DIGIT[data]
    plain = _CLEAN[data]
    inner = _INNER[data]
    inner[0] = inner[-1] = False
    inner[1:-1] &= digit[:-2] & digit[2:]
    plain[inner] = 0x30  # a mark inside a number
    figure = digit | inner
    # Latin capitals of two bytes get their small form
    second = np.zeros(n, bool)
    second[1:] = data[:-1] == 0xC3
    capital = second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    plain = np.where(capital, plain + np.uint8(0x20), plain)
    # a number ends where letters begin and the other way round: cut there as between texts
    edge = np.flatnonzero((figure[1:] != figure[:-1]) & (plain[1:] != 0x20) & (plain[:-1] != 0x20)) + 1
    parts = np.union1d(cuts, edge)
    first, last, part, hashes = spans(plain, parts)
    texts = np.searchsorted(cuts, first, side="right") - 1
    if not len(first):
        return Tokens(first, last, texts, hashes, hashes, np.zeros(0, bool), np.zeros(0, bool))
    number = figure[first]
    # a capital and then a small letter; words all in capitals are shouted, not named
    wide = data[first] == 0xC3
    lead = np.where(wide, data[np.minimum(first + 1, n - 1)], data[first])
    upper = np.where(wide, (lead >= 0x80) & (lead <= 0x9E), (lead >= 65) & (lead <= 90))
    after = first + np.where(wide, 2, 1)
    here = np.minimum(after, n - 1)
    follow = np.where(data[here] == 0xC3, data[np.minimum(here + 1, n - 1)] > 0x9E, (data[here] >= 97) & (data[here] <= 122))
    upper &= (after < last) & follow
    stops = np.concatenate([[0], np.cumsum(_STOP[data] & ~inner)])
    opens = np.ones(len(first), bool)  # begins a sentence
    opens[1:] = (texts[1:] != texts[:-1]) | (stops[first[1:]] > stops[last[:-1]])
    after = np.zeros(len(first), bool)
    after[1:] = number[:-1] & (texts[1:] == texts[:-1])
    at = np.minimum(np.searchsorted(_UNITS, hashes), len(_UNITS) - 1)
    unit = after & (_UNITS[at] == hashes) & ~number
    name = upper & ~opens & ~number & ~unit
    kinds = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, hashes)))
    return Tokens(first, last, texts, hashes, kinds, number | unit | name, upper & opens & ~number & ~unit)


def windows(tokens: Tokens, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]]:
    """Windows of ``n`` tokens inside one text, in three groups: first token, hash, the tokens' slots, whether the
    values are part of the hash, and whether opening capitals count as names. A window is in the first group (template) or the second (mostly slots, literal); one
    with an opening capital is also in the third, as a template with names there."""
    m = len(tokens.kind) - n + 1
    if m <= 0:
        return []
    inside = tokens.text[:m] == tokens.text[n - 1 :]

    def count(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        return sums[n:] - sums[:m]

    def keyed(at: np.ndarray, values: np.ndarray, salt: np.uint64) -> np.ndarray:
        total = np.zeros(len(at), np.uint64)
        for k in range(n):
            total += values[at + k] * _PLACE[k]
        return mix(total ^ salt)

    heavy = 2 * count(tokens.slot) > n
    named = tokens.slot | tokens.opening
    plain, literal = np.flatnonzero(inside & ~heavy), np.flatnonzero(inside & heavy)
    both = np.flatnonzero(inside & (count(tokens.opening) > 0) & (2 * count(named) <= n))
    return [
        (plain, keyed(plain, tokens.kind, _PLACE[n]), tokens.slot, False, False),
        (literal, keyed(literal, tokens.literal, _PLACE[n] ^ LITERAL), tokens.slot, True, False),
        (both, keyed(both, np.where(tokens.opening, NAME, tokens.kind), _PLACE[n]), named, False, True),
    ]


def _slots(raw: bytes, tokens: Tokens, slot: np.ndarray, low: int, n: int) -> list[str]:
    return [raw[tokens.first[k] : tokens.last[k]].decode("utf-8", "replace").lower() for k in range(low, low + n) if slot[k]]


_FIELDS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("hash", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("literal", pa.bool_()), ("named", pa.bool_()), ("slots", pa.list_(pa.string()))])


def _windows_of(rows: DataFrame, width: int, field=None, lengths: tuple[int, ...] = ()) -> DataFrame:
    """``(id, row, hash, at, n, literal, named, slots)``: windows with their place and length, and their slots' values.

    Items (without ``field``) give windows of ``width`` tokens; those of ``width / 2`` to ``width`` tokens are one
    window. Documents give windows of ``width`` and of the given ``lengths``, but only those whose bit ``field`` has.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, data, cuts in blocks(batches, "text"):
            tokens = templates(data, cuts)
            bounds = np.searchsorted(tokens.text, np.arange(len(cuts)))
            raw, ids, marks = None, batch.column(0), batch.column(1).to_numpy()
            for n in (width, *(lengths if field is not None else range(-(-width // 2), width))):
                for at, keys, slot, literal, named in windows(tokens, n):
                    if field is not None:
                        bit = (keys % np.uint64(WINDOW_BITS)).astype(np.int64)
                        hit = (field.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    else:
                        hit = (n == width) | (np.diff(bounds)[tokens.text[at]] == n)
                    at, keys = at[hit], keys[hit]
                    if not len(at):
                        continue
                    raw = data.tobytes() if raw is None else raw
                    owner = tokens.text[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(owner)).cast(pa.int64()), pa.array(marks[owner]), pa.array(keys.view(np.int64)),
                            pa.array(at - bounds[owner]), pa.array(np.full(len(at), n, np.int64)), pa.array(np.full(len(at), literal)), pa.array(np.full(len(at), named)),
                            pa.array([_slots(raw, tokens, slot, a, n) for a in at.tolist()], pa.list_(pa.string())),
                        ],
                        schema=_FIELDS,
                    )
        give_back()

    return rows.mapInArrow(run, "id long, row long, hash long, at long, n long, literal boolean, named boolean, slots array<string>")


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text",
    width: int = 8, min_share: float = 0.5,
) -> DataFrame:
    """``(doc_id, row_key, item_id, n_windows, n_matched, share, n_slots)`` for every document that leaks an item.

    ``share`` is the part of the item's windows that stands in the document at its best alignment, of the template
    windows or of all, whichever is larger; it must reach ``min_share``. ``n_windows`` and ``n_matched`` count all.
    ``row_key`` hashes the text, to tell rows apart that repeat an id.

    An item mostly of slots is found where it is copied, not with other values. Items of fewer than ``width / 2``
    tokens, null and empty ones have no window and are never found; those between are matched whole. Null and empty
    texts leak nothing. An item or document that comes twice is reported once per (id, text). Very long texts are read
    whole, as a block of their own. Of alignments with one share the smallest shift is told. Empty tables give no rows;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    items = _windows_of(benchmark.select(F.col(item_column).alias("id"), F.xxhash64(item_text).alias("row"), F.col(item_text).alias("text")), width).distinct()
    items = store(items, "benchmark-windows")  # read for the field, the lengths, the totals and the join
    totals = items.groupBy(F.col("id").alias("item_id"), F.col("row").alias("item_row")).agg(
        F.count_distinct("at").alias("n_windows"), F.count_distinct(F.when(~F.col("literal"), F.col("at"))).alias("n_templates"),
    )
    lengths = tuple(r["n"] for r in items.filter(F.col("n") < width).select("n").distinct().collect())  # at most width / 2
    items = items.select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), "hash", F.col("at").alias("item_at"), "literal", "named", F.col("slots").alias("item_slots"))
    bit = F.expr("conv(hex(hash), 16, 10)").cast("decimal(20,0)") % WINDOW_BITS
    rows = items.select((bit.cast("long") + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    ).collect()  # at most WINDOW_BITS / 32768 rows of 4 KB
    bits = np.zeros(WINDOW_BITS // 8, np.uint8)
    for row in rows:
        bits[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    field = spark.sparkContext.broadcast(bits)
    found = _windows_of(docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")), width, field, lengths)
    met = found.select(F.col("id").alias("doc_id"), F.col("row").alias("row_key"), "hash", "at", "slots").join(items, "hash")
    # two readings of an alignment: opening capitals are words, or they may be names too; either one may agree
    met = met.withColumn("reading", F.explode(F.when(F.col("named"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    aligned = met.groupBy("doc_id", "row_key", "item_id", "item_row", "reading", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.count_distinct("item_at").alias("n_matched"), F.count_distinct(F.when(~F.col("literal"), F.col("item_at"))).alias("n_alike"),
        F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots"))).alias("pairs"),
    ).join(totals, ["item_id", "item_row"])
    pairs = F.array_distinct("pairs")
    one = F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item_slots"])))
    other = F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["slots"])))
    agree = aligned.withColumn("n_slots", F.size(pairs).cast("long")).filter(one & other)
    shares = F.greatest(F.col("n_matched") / F.col("n_windows"), F.try_divide("n_alike", "n_templates"))
    best = agree.withColumn("share", shares).filter(F.col("share") >= min_share)
    top = F.max_by(F.struct("n_windows", "n_matched", "share", "n_slots"), F.struct("share", -F.col("shift"), -F.col("reading"))).alias("t")
    return best.groupBy("doc_id", "row_key", "item_id").agg(top).select("doc_id", "row_key", "item_id", "t.*")


def clean(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``leaks`` found."""
    gone = found.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_row")).distinct()
    return docs.join(gone, F.col(id_column).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_row")), "left_anti")
