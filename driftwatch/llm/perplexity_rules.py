"""Quality rules with perplexity bands: a modified Kneser-Ney model of code points, counted by Spark, in sorted hash arrays.

Counting: each task counts the four-grams of its whole texts; the sums, the continuation counts of the lower orders, the
discounts and the interpolated probabilities are group-bys and joins of tables with a row per n-gram. The texts are dealt in
two folds by their checksum, and each fold is scored by the model of the other, so no text is measured by its own counts.

Storing: every probability and every back-off weight is one entry, a 64-bit hash with a float, in arrays sorted by hash.

Scoring: if all arrays have at most ``broadcast_bytes`` they are broadcast. Beyond that, texts are dealt into blocks of
bounded size, each block asks for its distinct n-grams once, the answers come from a join with the entries, and a block
meets its own sorted arrays. Both ways give the same numbers.

Judging: the mean log-probability of a text is held against the band of its language and length, quartiles widened by a
multiple of their distance, so that only texts far from the bulk are rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.common import blocks, give_back, store, text_bytes
from driftwatch.llm.words import SPACE, mix

ORDER = 4
BEGIN, END = 0x110000, 0x110001  # beyond all code points
_CODES = [f"c{k}" for k in range(ORDER)]
_PLACE = mix(np.arange(7001, 7001 + ORDER, dtype=np.uint64)) | np.uint64(1)
_PROBABILITY, _BACK_OFF = 0, 1
_IDS = 1 << 16
#: Cells of a table that counts n-grams without sorting them.
_TABLE = 1 << 23
SYMBOLS = b"#*$%&|<>"  # fixed: the characters that count as symbols
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
WINDOW = 5
_WINDOW = mix(np.arange(9001, 9001 + WINDOW, dtype=np.uint64)) | np.uint64(1)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# rules on words, lines and symbols


def _repeated_lines(raw: bytes) -> int:
    lines = raw.split(b"\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0
    seen, again = set(), 0
    for line in lines:
        if line in seen:
            again += bool(line.strip())  # only the ASCII white space counts as blank
        seen.add(line)
    return again


def measures(data: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    """The five measures of every text of a block."""
    n = len(cuts) - 1
    owner = np.repeat(np.arange(n), np.diff(cuts))
    count = lambda mask: np.bincount(owner, mask, minlength=n).astype(np.int64)
    chars = count(~SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = count(_SYMBOL[data])
    sizes, again = np.zeros(n, np.int64), np.zeros(n, np.int64)
    hashes = []
    for k in range(n):
        raw = data[cuts[k] : cuts[k + 1]].tobytes()
        words = raw.split()
        sizes[k] = len(words)
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
        again[k] = _repeated_lines(raw)
    words = np.concatenate(hashes).view(np.uint64) if n else np.zeros(0, np.uint64)
    texts = np.repeat(np.arange(n), sizes)
    repeated = np.zeros(n, np.int64)
    if len(words) >= WINDOW:
        last = len(words) - WINDOW + 1
        whole = np.flatnonzero(texts[:last] == texts[WINDOW - 1 :])  # windows within one text
        grams = mix(texts[whole].astype(np.uint64) + np.uint64(1))
        for j in range(WINDOW):
            grams += words[whole + j] * _WINDOW[j]
        _, inverse, found = np.unique(mix(grams), return_inverse=True, return_counts=True)
        twice = whole[found[inverse] > 1]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        repeated = np.bincount(texts[np.cumsum(cover[:-1]) > 0], minlength=n).astype(np.int64)
    return dict(zip(MEASURES, (sizes, chars, symbols, again, repeated)))


def fails_rules(found: dict[str, np.ndarray], fewest_words: int, most_repeated: int) -> np.ndarray:
    return (found["n_words"] < fewest_words) | (100 * found["n_repeat_words"] > most_repeated * found["n_words"])


def folds(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """0 or 1 for each text, equal for equal texts."""
    return np.array([zlib.crc32(data[a:b]) & 1 for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], np.int64)


# n-grams of code points


def code_points(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offsets of the texts among them. Bytes that are no UTF-8 become U+FFFD."""
    try:
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return codes, chars[cuts]
    except UnicodeDecodeError:
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def grams(codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every code point and at every text's end, as columns; and where each text's begin."""
    n, pad = len(cuts) - 1, ORDER - 1
    row = np.full(len(codes) + (pad + 1) * n, BEGIN, np.uint32)
    text = np.repeat(np.arange(n), np.diff(cuts))
    row[np.arange(len(codes)) + (pad + 1) * text + pad] = codes
    starts = cuts + (pad + 1) * np.arange(n + 1)
    row[starts[1:] - 1] = END
    at = np.arange(len(codes) + n) + pad * (np.repeat(np.arange(n), np.diff(cuts) + 1) + 1)
    return np.stack([row[at - pad + k] for k in range(ORDER)]), cuts + np.arange(n + 1)


def distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns, the number of each given column among them, and their counts."""
    present = np.zeros(END + 1, bool)
    for c in columns:
        present[c] = True
    known = np.flatnonzero(present)
    if len(known) > _IDS:  # more code points than fit 16 bits each
        found, inverse, counts = np.unique(columns, axis=1, return_inverse=True, return_counts=True)
        return found, inverse.ravel(), counts
    if len(known) ** 2 <= _TABLE:
        ids = np.zeros(END + 1, np.int32)
        ids[known] = np.arange(len(known))
        left, right = (ids[columns[k]] * np.int32(len(known)) + ids[columns[k + 1]] for k in (0, 2))
        seen = np.zeros(len(known) ** 2, bool)
        seen[left] = seen[right] = True
        pairs = np.flatnonzero(seen)
        if len(pairs) ** 2 <= _TABLE:  # a table of all pairs of pairs that occur takes less than sorting
            number = np.cumsum(seen, dtype=np.int32) - 1
            place = number[left] * np.int32(len(pairs)) + number[right]
            counts = np.bincount(place, minlength=len(pairs) ** 2)
            at = np.flatnonzero(counts)
            inverse = (np.cumsum(counts > 0, dtype=np.int32) - 1)[place]
            both = pairs[at // len(pairs)], pairs[at % len(pairs)]
            return np.stack([known[x] for b in both for x in (b // len(known), b % len(known))]).astype(np.uint32), inverse, counts[at]
    ids = np.zeros(END + 1, np.uint64)
    ids[known] = np.arange(len(known))
    packed = np.zeros(columns.shape[1], np.uint64)
    for c in columns:
        packed = (packed << np.uint64(16)) | ids[c]
    found, inverse, counts = np.unique(packed, return_inverse=True, return_counts=True)
    back = [known[((found >> np.uint64(16 * (ORDER - 1 - k))) & np.uint64(_IDS - 1)).astype(np.int64)] for k in range(ORDER)]
    return np.stack(back).astype(np.uint32), inverse, counts


def entry_keys(columns: list[np.ndarray], fold: np.ndarray | int, kind: int) -> np.ndarray:
    """The hash of each entry: fold, kind and the code points of an n-gram (none: the empty context)."""
    size = len(columns[0]) if columns else 1
    value = np.full(size, 0, np.uint64) + np.asarray(fold, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((len(columns) * 2 + kind + 1) * 0x51_7C_C1_B7)
    value = mix(value)
    for c, place in zip(columns, _PLACE):
        value += (np.asarray(c).astype(np.uint64) + np.uint64(1)) * place
    return mix(value)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    columns = np.concatenate([p[0] for p in parts], axis=1)
    counts = np.concatenate([p[1] for p in parts])
    found, inverse, _ = distinct(columns)
    return found, np.bincount(inverse, counts, minlength=found.shape[1]).astype(np.int64)


def count_grams(docs: DataFrame, text: str, fewest_words: int, most_repeated: int) -> DataFrame:
    """``(fold, c0 .. c3, n)`` over the whole texts that pass the rules: a task adds up its own before it gives rows away."""

    def rows(held: list[list], fold: int) -> Iterator[pa.RecordBatch]:
        if held[fold]:
            found, counts = _merge(held[fold])
            held[fold] = []
            for low in range(0, len(counts), 1 << 17):
                part = slice(low, low + (1 << 17))
                columns = {c: found[k, part].astype(np.int32) for k, c in enumerate(_CODES)}
                yield pa.RecordBatch.from_pydict({"fold": np.full(len(counts[part]), fold, np.int32), **columns, "n": counts[part]})

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[list] = [[], []]
        for _, data, cuts in blocks(batches, "text"):
            good = ~fails_rules(measures(data, cuts), fewest_words, most_repeated)
            side = folds(data, cuts)
            codes, chars = code_points(data, cuts)
            columns, starts = grams(codes, chars)
            owner = np.repeat(np.arange(len(good)), np.diff(starts))
            for fold in (0, 1):
                mine = columns[:, (good & (side == fold))[owner]]
                if mine.shape[1]:
                    found, _, counts = distinct(mine)
                    held[fold].append((found, counts))
                if sum(len(c) for _, c in held[fold]) > 1 << 20:
                    held[fold] = [_merge(held[fold])]
                    if len(held[fold][0][1]) > 1 << 19:
                        yield from rows(held, fold)
        for fold in (0, 1):
            yield from rows(held, fold)
        give_back()

    schema = f"fold int, {', '.join(f'{c} int' for c in _CODES)}, n long"
    found = docs.select(F.col(text).alias("text")).mapInArrow(run, schema)
    return found.groupBy("fold", *_CODES).agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> dict[int, list[float]]:
    """Per fold what is taken off counts of 1, 2 and more, from how many n-grams have counts 1 to 4."""
    rows = table.groupBy("fold").agg(*[F.count_if(F.col("n") == k).alias(f"t{k}") for k in (1, 2, 3, 4)]).collect()
    out = {fold: [0.5, 0.5, 0.5] for fold in (0, 1)}
    for row in rows:
        t = [row[f"t{k}"] for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + t[1] else 0.5
        out[row["fold"]] = [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] else 0.5 for k in (1, 2, 3)]
    return out


def model_tables(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], dict[int, int]]:
    """Per order ``(fold, codes, p)`` and ``(fold, context codes, weight)``, and per fold the number of different signs.

    The highest order has counts, the lower ones the numbers of different signs before an n-gram. The lowest order is
    mixed with a uniform distribution over the signs and one more that stands for all unseen.
    """
    tables = [store(counts, f"counts-{ORDER}")]
    for k in range(1, ORDER):
        shorter = tables[-1].groupBy("fold", *_CODES[k:]).agg(F.count(F.lit(1)).alias("n"))
        tables.append(store(shorter, f"counts-{ORDER - k}"))
    signs = {row["fold"]: row["count"] for row in tables[-1].groupBy("fold").count().collect()}
    probabilities, weights, before = [], [], None
    for k in range(ORDER - 1, -1, -1):  # from single signs up
        own, context = _CODES[k:], _CODES[k:-1]
        off = _discounts(tables[k])
        taken = [F.when(F.col("fold") == 0, off[0][j]).otherwise(off[1][j]) for j in range(3)]
        d = F.when(F.col("n") == 1, taken[0]).when(F.col("n") == 2, taken[1]).otherwise(taken[2])
        t = tables[k].withColumn("d", d)
        sums = t.groupBy("fold", *context).agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        if before is None:
            lower = F.when(F.col("fold") == 0, 1.0 / (signs.get(0, 0) + 1)).otherwise(1.0 / (signs.get(1, 0) + 1))
            t = t.withColumn("lower", lower)
        else:
            t = t.join(before.withColumnRenamed("p", "lower"), ["fold", *own[1:]])
        p = (F.col("n") - F.col("d") + F.col("freed") * F.col("lower")) / F.col("total")
        before = store(t.join(sums, ["fold", *context]).select("fold", *own, p.alias("p")), f"probabilities-{len(own)}")
        probabilities.append(before)
        weights.append(sums.select("fold", *context, (F.col("freed") / F.col("total")).alias("weight")))
    return probabilities, weights, signs


def entries(probabilities: list[DataFrame], weights: list[DataFrame]) -> DataFrame:
    """``(key, value)``: all probabilities and back-off weights as base-10 logarithms."""

    def keyed(table: DataFrame, codes: list[str], value: str, kind: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                if batch.num_rows:
                    at = {name: batch.column(k).to_numpy() for k, name in enumerate(batch.schema.names)}
                    keys = entry_keys([at[c] for c in codes], at["fold"], kind)
                    keys = np.broadcast_to(keys, batch.num_rows)
                    yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "value": np.log10(at[value]).astype(np.float32)})

        return table.select("fold", *codes, value).mapInArrow(run, "key long, value float")

    parts = []
    for n, (p, w) in enumerate(zip(probabilities, weights), 1):
        parts += [keyed(p, _CODES[ORDER - n :], "p", _PROBABILITY), keyed(w, _CODES[ORDER - n : -1], "weight", _BACK_OFF)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hash_arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Entries as two arrays sorted by unsigned key; only for entries of a proven size, as they reach the driver."""
    table = rows.toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("value").to_numpy()[order]


def _look_up(model: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of every key (0 where there is none) and whether there is one."""
    if not len(model[0]):
        return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(model[0], keys), len(model[0]) - 1)
    has = model[0][at] == keys
    return np.where(has, model[1][at], np.float32(0)), has


def wanted_keys(columns: np.ndarray, fold: int) -> np.ndarray:
    """All entries that can matter for these n-grams."""
    out = [entry_keys([], fold, _BACK_OFF)]
    for n in range(ORDER, 0, -1):
        own = list(columns[ORDER - n :])
        out += [entry_keys(own, fold, _PROBABILITY), entry_keys(own[:-1], fold, _BACK_OFF)]
    return np.unique(np.concatenate(out))


def log_probabilities(columns: np.ndarray, model: tuple[np.ndarray, np.ndarray], fold: int, signs: int) -> np.ndarray:
    """The logarithm of the probability of each n-gram's last sign after the others.

    The longest n-gram that the model has decides; each longer context that it has seen multiplies its back-off weight.
    """
    out = np.zeros(columns.shape[1])
    open_ = np.arange(columns.shape[1])
    for n in range(ORDER, 0, -1):
        own = list(columns[ORDER - n :, open_])
        value, has = _look_up(model, entry_keys(own, fold, _PROBABILITY))
        out[open_] += value
        open_, own = open_[~has], [c[~has] for c in own]
        out[open_] += _look_up(model, np.broadcast_to(entry_keys(own[:-1], fold, _BACK_OFF), len(open_)))[0]
    out[open_] -= np.log10(signs + 1.0)
    return out


def _score_block(data: np.ndarray, cuts: np.ndarray, model: tuple[np.ndarray, np.ndarray], signs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Number of signs and log-probability of each text, by the model of the other fold."""
    codes, chars = code_points(data, cuts)
    columns, starts = grams(codes, chars)
    other = 1 - folds(data, cuts)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(starts))
    found, inverse, _ = distinct(columns)
    total = np.zeros(len(cuts) - 1)
    for fold in (0, 1):
        mine = np.flatnonzero(other[owner] == fold)
        if len(mine):
            used, place = np.unique(inverse[mine], return_inverse=True)
            total += np.bincount(owner[mine], log_probabilities(found[:, used], model, fold, signs.get(fold, 0))[place], minlength=len(total))
    return np.diff(starts), total


_RESULT = [*[T.StructField(m, T.LongType()) for m in MEASURES], T.StructField("base_failed", T.BooleanType()), T.StructField("n_signs", T.LongType()), T.StructField("log10_p", T.DoubleType())]


def _judged(batch: pa.RecordBatch, keep: list[str], data: np.ndarray, cuts: np.ndarray, model, signs: dict[int, int], limits: tuple[int, int]) -> pa.RecordBatch:
    found = measures(data, cuts)
    sizes, total = _score_block(data, cuts, model, signs)
    own = [batch.column(batch.schema.names.index(c)) for c in keep]
    made = [*found.values(), fails_rules(found, *limits), sizes.astype(np.int64), total]
    return pa.RecordBatch.from_arrays([*own, *[pa.array(m) for m in made]], names=[*keep, *[f.name for f in _RESULT]])


def score(docs: DataFrame, model: DataFrame, signs: dict[int, int], keep: list[str], text: str, limits: tuple[int, int], broadcast_bytes: int, block_bytes: int) -> DataFrame:
    """``keep``'s columns with the measures, ``base_failed``, ``n_signs`` and ``log10_p`` of every text."""
    spark = docs.sparkSession
    schema = T.StructType([*docs.select(*keep).schema, *_RESULT])
    rows = docs.select(*keep, F.col(text).alias("_scored_text"))
    if model.count() * 12 <= broadcast_bytes:
        told = spark.sparkContext.broadcast(hash_arrays(model))

        def run(batches: Iterator[pa.RecordBatch]):
            for batch, data, cuts in blocks(batches, "_scored_text"):
                yield _judged(batch, keep, data, cuts, told.value, signs, limits)
            give_back()

        return rows.mapInArrow(run, schema)
    # a block is a part of what one scan task reads, so rows that repeat do not pile up in one block
    n_blocks = max(1, -(-text_bytes(rows, "_scored_text") // block_bytes))
    hashed = F.xxhash64(*[F.col(c) for c in keep], "_scored_text", F.spark_partition_id())
    rows = rows.withColumn("_block", F.pmod(hashed, F.lit(n_blocks)))

    def ask(batches: Iterator[pa.RecordBatch]):
        for batch, data, cuts in blocks(batches, "_scored_text", block_bytes):
            owner, other = batch.column(batch.schema.names.index("_block")).to_numpy(), 1 - folds(data, cuts)
            codes, chars = code_points(data, cuts)
            columns, starts = grams(codes, chars)
            text_of = np.repeat(np.arange(len(owner)), np.diff(starts))
            for block in np.unique(owner):
                for fold in (0, 1):
                    mine = columns[:, ((owner == block) & (other == fold))[text_of]]
                    if mine.shape[1]:
                        keys = wanted_keys(distinct(mine)[0], fold)
                        yield pa.RecordBatch.from_pydict({"_block": np.full(len(keys), block), "key": keys.view(np.int64)})
        give_back()

    by_block = rows.repartition(int(n_blocks), "_block").sortWithinPartitions("_block")
    asked = by_block.mapInArrow(ask, "_block long, key long").distinct()
    answers = asked.join(model, "key").select("_block", "key", "value")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        own = keys[order], right.column("value").to_numpy()[order]
        out = [_judged(batch, keep, data, cuts, own, signs, limits) for batch, data, cuts in blocks(iter(left.combine_chunks().to_batches()), "_scored_text")]
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([], schema=_arrow(schema))

    return rows.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(meet, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _bands(scored: DataFrame, value: Column, width: float, least: int) -> DataFrame:
    """``scored`` with ``low`` and ``high``, the band of its language and length, of its language, or of all rows."""
    quartiles = F.percentile_approx("_value", [0.25, 0.5, 0.75], 10_000)
    spread = lambda q: F.greatest(F.get(q, F.lit(2)) - F.get(q, F.lit(0)), F.abs(F.get(q, F.lit(1))) * 0.005)
    band = lambda q: F.struct((F.get(q, F.lit(0)) - width * spread(q)).alias("low"), (F.get(q, F.lit(2)) + width * spread(q)).alias("high"))
    rows = scored.withColumns({"_value": value, "_size": F.floor(F.log2(F.col("n_signs").cast("double"))).cast("int")})
    good = rows.filter(~F.col("base_failed"))
    enough = F.when(F.count(F.lit(1)) >= least, band(quartiles))
    by_size = good.groupBy(F.col("lang").alias("_l1"), F.col("_size").alias("_s1")).agg(enough.alias("_b1"))
    by_lang = good.groupBy(F.col("lang").alias("_l2")).agg(enough.alias("_b2"))
    every = good.agg(F.when(F.count(F.lit(1)) > 0, band(quartiles)).alias("_b3"))
    met = rows.join(by_size, F.col("lang").eqNullSafe(F.col("_l1")) & (F.col("_size") == F.col("_s1")), "left")
    met = met.join(by_lang, F.col("lang").eqNullSafe(F.col("_l2")), "left").join(F.broadcast(every))  # one row
    found = F.coalesce("_b1", "_b2", "_b3")
    return met.select(*scored.columns, F.col("_value").alias("mean_log10_p"), found["low"].alias("low"), found["high"].alias("high"))


def judge(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", language: str = "lang", fewest_words: int = 10, most_repeated: int = 20, width: float = 2.5,
    least: int = 50, broadcast_bytes: int = 48 << 20, block_bytes: int = 16 << 20,
) -> DataFrame:
    """``doc_id, lang``, the five measures, ``base_failed, n_signs, log10_p, mean_log10_p, low, high, kept`` of every document.

    ``base_failed``: fewer than ``fewest_words`` words, or more than ``most_repeated`` of 100 words stand in 5-word windows
    that the text has twice. ``kept``: the rules hold and the mean log-probability lies in the band of the document's
    language and length (powers of two): the quartiles of the documents that pass the rules, widened on both sides by
    ``width`` times their distance. Where fewer than ``least`` such documents share language and length, those of the
    language count, then all.

    Null and empty texts have no words and fail. Null languages are a language of their own. Long texts are measured whole.
    Equal texts get equal measures and share a fold; repeated rows stay and count. If one fold has no text its model is
    uniform. Without any document that passes the rules the band is null and nothing is kept. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(language).alias("lang"), F.col(text).alias("text"))
    probabilities, weights, signs = model_tables(count_grams(rows, "text", fewest_words, most_repeated))
    model = store(entries(probabilities, weights), "model")
    found = store(score(rows, model, signs, ["doc_id", "lang"], "text", (fewest_words, most_repeated), broadcast_bytes, block_bytes), "scored")
    banded = _bands(found, F.col("log10_p") / F.col("n_signs"), width, least)
    inside = F.coalesce(F.col("mean_log10_p").between(F.col("low"), F.col("high")), F.lit(False))
    return banded.withColumn("kept", ~F.col("base_failed") & inside)
