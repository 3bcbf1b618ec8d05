"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the bytes of a text as they are, of order four. Counts are tables with a row for each n-gram and
probabilities come from joins of these tables, sharded by n-gram. The four-grams that texts hold, with their
probabilities, are then broadcast: eight bytes for each different one, and each document's perplexity is a sum over
its bytes. A document is kept if its perplexity does not exceed a quantile of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.common import blocks, give_back, store

ORDER, BITS = 4, 8
#: Bits of a sign in tables that are given to ``probabilities`` without saying so.
PLAIN_BITS = 6
EDGE = 0xFF  # stands before a text (and after it once); no UTF-8 text holds this byte
#: Different four-grams that a task holds before it tells them, and how many the driver takes at once.
HELD, TAKEN = 1 << 21, 1 << 20


def grams(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four-gram that ends at every sign and at every text's end, and where each text's begin."""
    n = len(cuts) - 1
    starts = cuts + np.arange(n + 1)
    symbols = np.full(len(data) + n, EDGE, np.uint32)
    owner = np.repeat(np.arange(n), np.diff(cuts))
    symbols[np.arange(len(data)) + owner] = data
    code = symbols.copy()
    place = np.arange(len(symbols)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(1, ORDER):
        before = np.zeros_like(symbols)
        before[back:] = symbols[:-back]
        before[place < back] = EDGE
        code |= before << np.uint32(BITS * back)
    return code, starts


def trusted_ids(labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """``(_id)``: every id that is labelled good; an id with several labels takes the highest."""
    rows = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    highest = rows.groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    return highest.filter("_label = 1").select("_id")


def gram_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(gram, n)`` over the texts."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        at, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return at, np.bincount(where, np.concatenate([p[1] for p in parts]), len(at)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]):
        parts, held = [], 0

        def told():
            at, n = merged(parts)
            for low in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_pydict({"gram": at[low : low + (1 << 16)].astype(np.int64), "n": n[low : low + (1 << 16)]})

        for _, data, cuts in blocks(batches, "text"):
            parts.append(np.unique(grams(data, cuts)[0], return_counts=True))
            held += len(parts[-1][0])
            if held >= 2 * HELD:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held >= HELD:
                    yield from told()
                    parts, held = [], 0
        if parts:
            yield from told()
        parts.clear()
        give_back()

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "gram long, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, asked: DataFrame, bits: int = PLAIN_BITS) -> DataFrame:
    """``(gram, log10_p)`` for every asked four-gram, by joins of the counts of each order.

    The highest order uses counts, the lower ones how many different signs come before; each order takes one of three
    discounts off (for counts of 1, 2 and more), estimated from the numbers of counts, and gives their mass to the
    order below. The lowest is mixed with the uniform distribution.
    """
    table, orders = counts.select(F.col("gram").cast("long").alias("g"), "n"), []
    signs = 1 << bits
    for order in range(ORDER, 0, -1):
        orders.append((order, table))
        shorter = signs ** (order - 1)
        # each distinct gram says once that its first sign comes before the rest
        table = table.groupBy((F.col("g") % shorter).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    out = asked.select(F.col("gram").cast("long").alias("gram")).distinct().withColumn("p", F.lit(1.0 / signs))
    for order, table in reversed(orders):
        size = signs**order
        t = [table.agg(F.count_if(F.col("n") == k)).first()[0] for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + t[1] else 0.5
        discount = [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] else 0.5 for k in (1, 2, 3)]
        d = F.when(F.col("n") == 1, discount[0]).when(F.col("n") == 2, discount[1]).otherwise(discount[2])
        # a context is what stands before the last sign of a gram
        context = table.groupBy(F.shiftright("g", bits).alias("c")).agg(F.sum("n").alias("total"), F.sum(d).alias("freed"))
        own = table.select("g", (F.col("n") - d).alias("left"))
        out = out.withColumns({"g": F.col("gram") % size, "c": F.shiftright(F.col("gram") % size, bits)})
        out = out.join(own, "g", "left").join(context, "c", "left")
        # an unseen context says nothing: the order below stands alone
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce("left", F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("total"))
        out = out.select("gram", p.alias("p"))
    return out.select("gram", F.log10("p").alias("log10_p"))


def perplexities(docs: DataFrame, model: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``docs``' columns ``keep`` with ``n_signs`` and ``perplexity`` of the whole text.

    The model has a row for each different four-gram of the corpus and is broadcast, eight bytes a row.
    """
    parts = -(-model.count() // TAKEN)
    taken = [model.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).toPandas() for k in range(parts)]
    known = np.concatenate([np.zeros(0, np.uint32), *(t["gram"].to_numpy(np.uint32) for t in taken)])
    value = np.concatenate([np.zeros(0, np.float32), *(t["log10_p"].to_numpy(np.float32) for t in taken)])
    by = np.argsort(known)
    told = docs.sparkSession.sparkContext.broadcast((known[by], value[by]))

    def run(batches: Iterator[pa.RecordBatch]):
        known, value = told.value
        for batch, data, cuts in blocks(batches, "_scored_text"):
            code, starts = grams(data, cuts)
            n = np.diff(starts)
            asked, where = np.unique(code, return_inverse=True)
            worth = value[np.searchsorted(known, asked)].astype(np.float64)
            mean = np.add.reduceat(worth[where], starts[:-1]) / n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n.astype(np.int64)), pa.array(10.0**-mean)], names=[*keep, "n_signs", "perplexity"])
        give_back()

    rows = docs.select(*keep, F.col(text).alias("_scored_text"))
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("n_signs", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def judge(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", language: str = "lang", label: str = "quality",
    quantile: float = 0.995, slack: float = 1.05, least: int = 30,
) -> DataFrame:
    """``doc_id, lang, n_signs, perplexity, low, high, keep`` for every document.

    The model learns from all documents that ``labels`` marks as good. A document is kept if its perplexity lies between ``low`` and ``high``: the
    ``1 - quantile`` and ``quantile`` quantiles of the good documents of its language and length (in powers of four),
    widened by the factor ``slack``. Text that says one thing again and again falls below, other junk above. Where
    fewer than ``least`` good documents are of its language and length, those of its language count, then all. Counts,
    perplexities and quantiles take whole texts.

    Null and empty texts are an end sign alone and are judged by its probability. Null languages are a language of
    their own. Without good documents all are kept and the limits are null. Repeated rows stay; an empty table gives
    no rows; other columns are ignored.
    """
    ids = store(trusted_ids(labels, id_column, label), "trusted-ids")
    # one shuffle of the texts, at every size: the list of ids grows with the corpus
    trusted = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(ids.hint("merge"), F.col("id") == F.col("_id"), "left_semi")
    counts = store(gram_counts(trusted, "text"), "trusted-counts")
    model = store(probabilities(counts, gram_counts(docs, text), BITS), "gram-probabilities")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(language).alias("lang"), F.col(text).alias("text"))
    scored = store(perplexities(rows, model, "text", ["doc_id", "lang"]), "perplexities")
    scored = scored.withColumn("band", F.floor(F.log2(F.col("n_signs").cast("double")) / 2).cast("int"))
    good = scored.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    limits = F.percentile_approx("perplexity", [1 - quantile, quantile], 10_000)
    enough = F.when(F.count(F.lit(1)) >= least, limits)
    by_band = good.groupBy(F.col("lang").alias("_lang"), F.col("band").alias("_band")).agg(enough.alias("l1"))
    by_lang = good.groupBy(F.col("lang").alias("_lang2")).agg(enough.alias("l2"))
    every = good.agg(limits.alias("l3"))
    met = scored.join(by_band, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("band") == F.col("_band")), "left")
    met = met.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang2")), "left").join(F.broadcast(every))
    limit = F.coalesce("l1", "l2", "l3")
    low, high = F.get(limit, F.lit(0)) / slack, F.get(limit, F.lit(1)) * slack
    inside = F.col("perplexity").between(low, high)
    return met.select("doc_id", "lang", "n_signs", "perplexity", low.alias("low"), high.alias("high"), F.coalesce(inside, F.lit(True)).alias("keep"))
