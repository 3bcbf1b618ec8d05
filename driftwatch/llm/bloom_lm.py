"""Language-model scoring with a log-frequency Bloom filter.

The filter holds, for every word and word pair of the training texts, the entries (n-gram, 1) to (n-gram, q), where q
is the quantised logarithm of its count. A count is read back by probing levels until one is missing. The pairs'
counts are smoothed towards the words':

    p(w | v) = (c(v w) + prior * p(w)) / (c(v) + prior),   p(w) = (c(w) + 1/2) / (N + (V + 1) / 2)

Lower edges of the quantised counts are used above and upper edges below, so the probabilities of all words sum to 1
at most (but for the filter's rare false hits). The filter is cut into parts by word and n-gram. As long as all parts
together keep within a fixed number of bytes they are broadcast, and every task probes them for its texts. A larger
filter stays on the cluster: blocks of texts ask the part that holds their n-grams, a part probes its filter for them,
and the answers are added up per text. Both ways probe the same parts, so they give the same scores, and neither reads
the texts more than three times, whatever the corpus holds.

A term is split for that. With c and p the counts and word probability as read back,

    log p(w | v) = log(prior * p(w)) - log(c(v) + prior) + log(1 + c(v w) / (prior * p(w)))

the first two parts need the filter of one word, the third that of the pair and of its last word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import blocks, give_back, shards_for, store, text_bytes
from driftwatch.llm.words import mix, spans

#: Base of the quantised counts, bits of filter for each entry, probes in a filter word.
BASE, ENTRY_BITS, PROBES = 1.5, 20, 5
END, BEGIN = mix(np.array([0xE4D, 0xBE6], np.uint64))
_PAIR = mix(np.array([77, 78], np.uint64)) | np.uint64(1)
_EDGES = BASE ** np.arange(-1, 120, dtype=np.float64)  # _EDGES[q] is the lower edge of level q
_EDGES[0] = 0.0
BLOCK_TOKENS, BLOCK_DOCS = 1 << 19, 60_000
#: Parts that hold pairs for each one that holds words.
PAIR_PARTS = 6


def tokens(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts, each text closed by the end token, and where each text begins."""
    _, _, texts, words = spans(data, cuts)
    n = len(cuts) - 1
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + texts] = words
    return out, np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=n) + 1)])


def lefts_of(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """40 bits of the word before each token: what tells pairs with one last word apart. That two such pairs meet is
    far rarer than a false hit of the filter."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts[:-1]] = BEGIN
    return mix(before) >> np.uint64(24)


def pair_grams(lefts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(lefts * _PAIR[0] + words * _PAIR[1])


def _place(grams: np.ndarray, words: np.ndarray, slices: int, shards: int) -> np.ndarray:
    """Part of the filter: the slice of the word that the count belongs to, and a shard in it by n-gram."""
    return ((words >> np.uint64(11)) % np.uint64(slices)).astype(np.int64) * shards + ((grams >> np.uint64(31)) % np.uint64(shards)).astype(np.int64)


_BLOB = pa.schema([("part", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("grams", "counts", "words", "runs", "held", "docs", "tf", "keys")), ("n_docs", pa.int64())])


def _packed(numbers: np.ndarray) -> bytes:
    """Mostly small numbers below 2**32 in few bytes: equal bytes side by side, compressed."""
    raw = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(numbers).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).reshape(-1).view("<u4")


def _blobs(out: dict[str, list], name: int, lefts: np.ndarray | None, words: np.ndarray, doc: np.ndarray, train: np.ndarray, place, holders: bool, keys: np.ndarray, n_docs: int) -> None:
    """Add one row for each part: its words, or pairs (five bytes each, and runs of one last word), with their counts
    in training texts and, with ``holders``, which text holds it how often."""
    of_pairs = lefts is not None
    grams = pair_grams(lefts, words) if of_pairs else words
    by = np.argsort(grams, kind="stable").astype(np.int32)  # texts stay in order
    g, d, t = grams[by], doc[by], train[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(g)))
    g, d, of_train = g[at], d[at], np.where(t[at], tf, 0)
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    runs = np.flatnonzero(first)
    held, count = np.diff(np.append(runs, len(g))), np.add.reduceat(of_train, runs)
    gram, word, left = g[runs], words[by[at[runs]]], lefts[by[at[runs]]] if of_pairs else None
    part = place(gram, word)
    order = np.lexsort((word, part))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    entries = np.argsort(np.repeat(rank, held), kind="stable")
    word, held, count, part = word[order], held[order], count[order], part[order]
    shipped = word if not of_pairs else left[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    ends = np.concatenate([[0], np.cumsum(held)])
    d, tf = d[entries], tf[entries]
    edges = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]])
    for k, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        own = word[low:high]
        starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        e = slice(ends[low], ends[high]) if holders else slice(0, 0)
        for c, x in (
            ("part", int(part[low])), ("block", name), ("grams", shipped[low:high].tobytes()), ("counts", _packed(count[low:high])),
            ("words", own[starts].tobytes() if of_pairs else b""), ("runs", _packed(np.diff(np.append(starts, len(own)))) if of_pairs else b""),
            ("held", _packed(held[low:high]) if holders else b""), ("docs", d[e].tobytes()), ("tf", _packed(tf[e])),
            ("keys", keys.tobytes() if k == 0 else b""), ("n_docs", n_docs if k == 0 else 0),
        ):
            out[c].append(x)


def _dealt(rows: DataFrame, slices: int, shards: int, of_pairs: bool, holders: bool = True) -> DataFrame:
    """Blocks of counts (of training texts) and of which text holds what (all texts), by part of the filter."""

    def block(ordinal: int, words: list[np.ndarray], starts: list[np.ndarray], keys: list[np.ndarray], train: list[np.ndarray]):
        w = np.concatenate(words)
        lengths = np.concatenate([np.diff(s) for s in starts])
        learn, own = np.concatenate(train), np.concatenate(keys)
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
        of_train = np.repeat(learn, lengths)
        # blocks of equal texts are told apart by where they come from; both passes name a block alike
        place = np.array([TaskContext.get().partitionId(), ordinal], np.uint64)
        name = int(mix(mix(own.view(np.uint64) + np.arange(len(own), dtype=np.uint64)).sum(keepdims=True) + mix(place + _PAIR).sum())[0].view(np.int64))
        out = {f.name: [] for f in _BLOB}
        if of_pairs:
            lefts = lefts_of(w, np.concatenate([[0], np.cumsum(lengths)]))
            if not holders:
                lefts, w, doc, of_train = lefts[of_train], w[of_train], doc[of_train], of_train[of_train]
            if len(lefts):
                _blobs(out, name, lefts, w, doc, of_train, lambda g, x: _place(g, x, slices, shards * PAIR_PARTS), holders, own[:0], 0)
        else:
            _blobs(out, name, None, w, doc, of_train, lambda g, x: _place(g, x, slices, shards), True, own, int(learn.sum()))
        return pa.RecordBatch.from_pydict(out, schema=_BLOB)

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[list] = [[], [], [], []]
        n = docs = made = 0
        for batch, data, cuts in blocks(batches, "text"):
            for low in range(0, batch.num_rows, BLOCK_DOCS):
                high = min(batch.num_rows, low + BLOCK_DOCS)
                w, starts = tokens(data[cuts[low] : cuts[high]], cuts[low : high + 1] - cuts[low])
                if docs + high - low > BLOCK_DOCS:
                    yield block(made, *held)
                    held, n, docs, made = [[], [], [], []], 0, 0, made + 1
                    give_back()
                for kept, x in zip(held, (w, starts, batch.column(0).to_numpy()[low:high], ~batch.column(1).to_numpy(zero_copy_only=False)[low:high])):
                    kept.append(x)
                n, docs = n + len(w), docs + high - low
                if n >= BLOCK_TOKENS:
                    yield block(made, *held)
                    held, n, docs, made = [[], [], [], []], 0, 0, made + 1
                    give_back()
        if docs:
            yield block(made, *held)
        held.clear()
        give_back()

    return rows.select("key", "held_out", "text").mapInArrow(run, ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in _BLOB))


def _entries(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (n-gram, level) that the counts need."""
    level = 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)
    up = np.repeat(np.cumsum(level) - level, level)
    return np.repeat(grams, level), np.arange(level.sum()) - up + 1


def _probe(grams: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Hash that picks the filter word, and the bits that an entry sets in it."""
    h = mix(grams + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return h >> np.uint64(32), bits


def _filter(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A part's filter: 64-bit words, one for about three entries."""
    g, level = _entries(grams, counts)
    words = np.zeros(max(1, -(-len(g) * ENTRY_BITS // 64)), np.uint64)
    at, bits = _probe(g, level)
    at = (at % np.uint64(len(words))).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, bits = at[order], bits[order]
    if len(at):
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[starts]] = np.bitwise_or.reduceat(bits, starts)
    return words


def _levels(words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Quantised count of each n-gram in one part's filter, found by probing level after level."""
    return _climb(grams, lambda left, at: words[(at % np.uint64(len(words))).astype(np.int64)])


def _climb(grams: np.ndarray, read) -> np.ndarray:
    out = np.zeros(len(grams), np.int64)
    left = np.arange(len(grams))
    level = 1
    while len(left) and level < len(_EDGES) - 2:
        at, bits = _probe(grams[left], level)
        left = left[(read(left, at) & bits) == bits]
        out[left] = level
        level += 1
    return out


def _context(level: np.ndarray) -> np.ndarray:
    """Upper edge of the count that a level stands for."""
    return np.where(level > 0, _EDGES[level + 1], 0.0)


def _grams(row) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a blob and the words that they belong to."""
    if not row.words:
        words = np.frombuffer(row.grams, np.uint64)
        return words, words
    words = np.repeat(np.frombuffer(row.words, np.uint64), _unpacked(row.runs))
    lefts = np.zeros((len(words), 8), np.uint8)
    lefts[:, :5] = np.frombuffer(row.grams, np.uint8).reshape(-1, 5)
    return pair_grams(lefts.reshape(-1).view("<u8"), words), words


def _summed(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's n-grams in order, their counts and the words they belong to."""
    blobs = [_grams(row) for row in frame.itertuples()]
    grams, words = (np.concatenate(x) for x in zip(*blobs))
    del blobs
    by = np.argsort(grams, kind="stable")
    grams = grams[by]
    counts = np.concatenate([_unpacked(c) for c in frame["counts"]])[by].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[starts], np.add.reduceat(counts, starts), words[by[starts]]


_SUMS = "kind int, part long, block long, x binary, docs binary, base binary, known binary, n_tokens binary, score binary, n long, v long, d long"


def _row(kind: int, part: int, block: int = 0, x: bytes = b"", docs: bytes = b"", base: bytes = b"", known: bytes = b"", n_tokens: bytes = b"", score: bytes = b"", n: int = 0, v: int = 0, d: int = 0) -> dict:
    return {"kind": kind, "part": part, "block": block, "x": x, "docs": docs, "base": base, "known": known, "n_tokens": n_tokens, "score": score, "n": n, "v": v, "d": d}


def _holders(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpacked(row.held), np.frombuffer(row.docs, np.uint16).astype(np.int64), _unpacked(row.tf)


def _word_part(frame: pd.DataFrame, prior: float) -> pd.DataFrame:
    """Filter of one part of the words (kind 0), and the sums of each block's texts over them (kind 2)."""
    part = int(frame["part"].iloc[0])
    grams, total, _ = _summed(frame)
    seen = total > 0
    words = _filter(grams[seen], total[seen])
    level = _levels(words, grams)
    # what a word adds wherever it stands, less what it costs as the word before another; the end stands before none
    own = np.log10(_EDGES[level] + 0.5) - np.where(grams == END, 0.0, np.log10(_context(level) + prior))
    base = np.log10(total + 0.5)
    out = [_row(0, part, x=words.tobytes(), n=int(total.sum()), v=int(seen.sum()), d=int(frame["n_docs"].sum()))]
    for row in frame.itertuples():
        at = np.searchsorted(grams, np.frombuffer(row.grams, np.uint64))
        held, docs, tf = _holders(row)
        at = np.repeat(at, held)
        n_tokens = np.bincount(docs, tf)
        there = np.flatnonzero(n_tokens)
        sums = [np.bincount(docs, x)[there] for x in (tf * base[at], tf * seen[at], tf * own[at])]
        out.append(_row(
            2, part, row.block, row.keys, there.astype(np.uint16).tobytes(), sums[0].tobytes(), sums[1].astype(np.uint32).tobytes(),
            n_tokens[there].astype(np.uint32).tobytes(), sums[2].tobytes(),
        ))
    give_back()
    return pd.DataFrame(out)


def _pair_filter(frame: pd.DataFrame) -> pd.DataFrame:
    """Filter of one part of the pairs (kind 1)."""
    grams, total, _ = _summed(frame)
    return pd.DataFrame([_row(1, int(frame["part"].iloc[0]), x=_filter(grams, total).tobytes())])


def _pair_part(frame: pd.DataFrame, filters: pd.DataFrame, shards: int, totals: tuple[int, int, int], prior: float) -> pd.DataFrame:
    """What the pairs of one part add to the texts of each block (kind 3)."""
    if not len(frame):
        return pd.DataFrame([], columns=list(_row(3, 0)))
    part = int(frame["part"].iloc[0])
    grams, total, words = _summed(frame)
    level = _levels(_filter(grams[total > 0], total[total > 0]), grams)
    unique, where = np.unique(words, return_inverse=True)
    shard = _place(unique, unique, 1, shards)
    of_word = np.zeros(len(unique), np.int64)
    for s, x in zip(filters["part"] % shards, filters["x"]):
        own = shard == s
        of_word[own] = _levels(np.frombuffer(x, np.uint64), unique[own])
    p = ((_EDGES[of_word] + 0.5) / (totals[0] + 0.5 * (totals[1] + 1)))[where]
    term = np.log10(1 + _EDGES[level] / (prior * p))
    out = []
    for row in frame.itertuples():
        held, docs, tf = _holders(row)
        sums = np.bincount(docs, tf * np.repeat(term[np.searchsorted(grams, _grams(row)[0])], held))
        there = np.flatnonzero(sums)
        out.append(_row(3, part, row.block, docs=there.astype(np.uint16).tobytes(), score=sums[there].tobytes()))
    give_back()
    return pd.DataFrame(out)


def _of_block(frame: pd.DataFrame) -> pd.DataFrame:
    """The sums of one block's texts over all parts."""
    keys = np.frombuffer(max(frame["x"], key=len), np.int64)
    base, known, n_tokens, score = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))
    for row in frame.itertuples():
        docs = np.frombuffer(row.docs, np.uint16)  # each text at most once
        score[docs] += np.frombuffer(row.score, np.float64)
        if row.kind == 2:
            base[docs] += np.frombuffer(row.base, np.float64)
            known[docs] += np.frombuffer(row.known, np.uint32)
            n_tokens[docs] += np.frombuffer(row.n_tokens, np.uint32)
    return pd.DataFrame({"key": keys, "base_sum": base, "n_known": known.astype(np.int64), "n_tokens": n_tokens.astype(np.int64), "score": score})


class Probe:
    """All parts of the filter."""

    def __init__(self, slices: int, shards: int, sizes: dict[tuple[int, int], int]):
        self.slices, self.shards = slices, (shards, shards * PAIR_PARTS)
        self.size = [np.array([sizes.get((kind, s), 1) for s in range(slices * n)], np.int64) for kind, n in enumerate(self.shards)]
        self.begin = [np.concatenate([[0], np.cumsum(size)]) for size in self.size]
        self.words = [np.zeros(begin[-1], np.uint64) for begin in self.begin]

    def fill(self, kind: int, part: int, x: bytes) -> None:
        self.words[kind][self.begin[kind][part] : self.begin[kind][part + 1]] = np.frombuffer(x, np.uint64)

    def levels(self, kind: int, grams: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Quantised count of each n-gram; ``words`` tells the word that it belongs to."""
        part = _place(grams, words, self.slices, self.shards[kind])
        begin, size = self.begin[kind][part], self.size[kind][part].astype(np.uint64)
        return _climb(grams, lambda left, at: self.words[kind][begin[left] + (at % size[left]).astype(np.int64)])


def _gathered(parts: DataFrame, slices: int, shards: int) -> Probe:
    """The filter on the driver, filled part by part; the caller has checked its size."""
    sizes = {(r["kind"], r["part"]): r["n"] // 8 for r in parts.select("kind", "part", F.octet_length("x").alias("n")).collect()}
    probe = Probe(slices, shards, sizes)
    for row in parts.select("kind", "part", "x").toLocalIterator():
        probe.fill(row["kind"], row["part"], row["x"])
    return probe


def _scores(rows: DataFrame, probe, totals: tuple[int, int, int], prior: float) -> DataFrame:
    n_train, distinct, n_docs = totals

    def run(batches: Iterator[pa.RecordBatch]):
        model: Probe = probe.value
        for batch, data, cuts in blocks(batches, "text"):
            w, starts = tokens(data, cuts)
            grams = pair_grams(lefts_of(w, starts), w)
            unique, where = np.unique(np.append(w, BEGIN), return_inverse=True)
            level = model.levels(0, unique, unique)
            p = (_EDGES[level] + 0.5) / (n_train + 0.5 * (distinct + 1))
            context = np.where(unique == BEGIN, n_docs, _context(level))
            at = where[:-1]
            earlier = np.append(where[-1], at[:-1])
            earlier[starts[:-1]] = where[-1]
            term = np.log10(_EDGES[model.levels(1, grams, w)] + prior * p[at]) - np.log10(context + prior)[earlier]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.add.reduceat(term, starts[:-1]))], names=["key", "score"])
        give_back()

    return rows.select("key", "text").mapInArrow(run, "key long, score double")


def _routed(rows: DataFrame, parts: DataFrame, slices: int, shards: int, totals: tuple[int, int, int], prior: float) -> DataFrame:
    """What the pairs add to each block of texts, by asking the parts of a filter that no broadcast holds. A part of
    the pairs meets the words' filters of its slice."""
    n = shards * PAIR_PARTS
    slice_ = F.floor(F.col("part") / shards)
    words = parts.filter("kind = 0").select("part", "x", F.explode(F.sequence(slice_ * n, slice_ * n + n - 1)).alias("to"))
    return _dealt(rows, slices, shards, True).groupBy("part").cogroup(words.groupBy("to")).applyInPandas(
        lambda left, right: _pair_part(left, right, shards, totals, prior), _SUMS
    )


def score_documents(
    docs: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text", prior: float = 2000.0,
    shard_bytes: int = 1 << 26, slice_bytes: int = 1 << 26, broadcast_bytes: int = 1 << 24,
) -> DataFrame:
    """Every text's log10 probability under a model learned from the rows that are not ``held_out``.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. ``base_score`` is the exact
    unigram score with half a count added, from sharded joins of word counts; ``score`` comes from the filter, which
    is broadcast where its measured size is at most ``broadcast_bytes`` and asked by shard otherwise. There is a part
    of the words' filter for about ``shard_bytes`` of text and a slice of words for about ``slice_bytes``.

    Null and blank texts are the end token alone. A null ``held_out`` counts as false. Repeated rows learn as often as they come and get the same scores; rows
    that share an id but not the text are scored apart. Without training rows every count is zero. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col(id_column), F.col(text))
    rows = docs.select(F.col(id_column).alias("doc_id"), key.alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_bytes = text_bytes(rows)
    slices = max(1, -(-n_bytes // slice_bytes))
    shards = max(1, -(-shards_for(n_bytes, shard_bytes) // slices))
    parts = store(_dealt(rows, slices, shards, False).groupBy("part").applyInPandas(lambda f: _word_part(f, prior), _SUMS), "bloom-words")
    told = parts.filter("kind = 0").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("d").alias("d")).first()
    totals = (int(told["n"] or 0), int(told["v"] or 0), int(told["d"] or 0))
    sums, probe = parts.filter("kind = 2"), None
    # where a quarter of all training tokens were pairs of their own and these alone were too much, none is gathered
    if totals[0] // 4 * ENTRY_BITS // 8 <= broadcast_bytes:
        trained = _dealt(rows.filter(~F.col("held_out")), slices, shards, True, holders=False)
        filters = parts.filter("kind = 0").unionByName(store(trained.groupBy("part").applyInPandas(_pair_filter, _SUMS), "bloom-pairs"))
        if (filters.agg(F.sum(F.octet_length("x")).alias("n")).first()["n"] or 0) <= broadcast_bytes:
            probe = spark.sparkContext.broadcast(_gathered(filters, slices, shards))
    if probe is None:
        sums = sums.unionByName(_routed(rows, parts, slices, shards, totals, prior))
    scored = sums.groupBy("block").applyInPandas(_of_block, "key long, base_sum double, n_known long, n_tokens long, score double").dropDuplicates(["key"])
    if probe is None:  # what all texts share: the prior's weight, the words' total, and the first context
        shared = F.lit(float(np.log10(prior) - np.log10(totals[0] + 0.5 * (totals[1] + 1))))
        scored = scored.withColumn("score", F.col("score") + F.col("n_tokens") * shared - float(np.log10(totals[2] + prior)))
    else:
        scored = scored.drop("score").join(_scores(rows, probe, totals, prior).dropDuplicates(["key"]), "key")
    return rows.select("doc_id", "key", "held_out").join(scored, "key").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals[0]).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * F.log10(F.lit(totals[0] + 0.5 * (totals[1] + 1)))).alias("base_score"), "score",
    )
