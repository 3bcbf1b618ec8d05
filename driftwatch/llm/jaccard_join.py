"""Near-duplicate groups by an exact n-gram Jaccard join with filters under several global token orders.

Two sets with Jaccard similarity of at least t must share a token among the first ``n - ceil(t * n) + 1`` tokens of
each, under ANY global order of the tokens. The join asks for such a shared token under each of several orders, and
verifies only pairs that pass them all. Every order takes tokens by their estimated frequency, rare ones first, and
mixes equals by a hash of its own. The estimates come from counts of all tokens by hash, a field of fixed size for
each order; they only steer the work.

Copies are no pairs: equal sets are one class, and only classes are joined. A group of thousands of near copies is no
list of pairs either: each shared token first links its classes to one hub (a candidate per class and token), the hubs
that hold make components, and only classes of one token that are still in different components are paired. Every link
lies inside a component, so links are counted there afterwards: small components whole, large ones by pairs of blocks.

The first token that a pair shares lies among the first ``n - ceil(2t / (1 + t) * n) + 1`` of the smaller set, its early
ones. A posting stays only if its token brings it beside a class of near size with the smaller one early. What stays is
dealt anew by the smallest class of its token's run, so that classes which share many tokens meet in few places, however
many shards the tokens had; a long run adds a salt of its token, which bounds what one place gets.

Every class carries a bitmap of 256 parities: each token flips one bit. Two bitmaps differ in at most as many bits as
the sets differ in tokens, so pairs whose bitmaps differ too much can't link and are not sent to verification. The hub
of a token is the class next to the majority of its classes' bitmaps: of many near copies, one that was edited least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import blocks, give_back, shards_for, store, text_bytes
from driftwatch.llm.components import connected_components
from driftwatch.llm.words import mix, shingle_sets

#: Bits of a token's place among the counts that estimate its frequency, and how many counts one row holds.
PLACE_BITS, CHUNK = 22, 1 << 16
#: Tokens and classes of a block of a component, within which links are counted, and how many columns at once.
BLOCK_TOKENS, BLOCK_CLASSES, COLUMNS = 1 << 20, 512, 1 << 13
#: Bits of the filter that tells which documents' sets are wanted; its misses cost bytes, not results.
WANTED_BITS = 1 << 24
#: Classes of a token from which on its run is dealt with a salt, one more for each such number.
SALTED = 1 << 12
#: 64-bit words of a class's bitmap of parities, and from how many classes on the hub of a token follows the majority.
WORDS, LONG_RUN = [f"w{k}" for k in range(4)], 8
_CLASS, _COUNT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _signature(grams: np.ndarray) -> int:
    return int(mix(mix(grams ^ _CLASS).sum(keepdims=True) + np.array([len(grams)], np.uint64) * _COUNT)[0])


def _parities(grams: np.ndarray) -> np.ndarray:
    """256 parities as four 64-bit words."""
    n = 64 * len(WORDS)
    return np.packbits(np.bincount((grams >> np.uint64(36)).astype(np.int64) % n, minlength=n).astype(np.uint8) & 1).view(np.uint64)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _mixed(grams: np.ndarray, order: int) -> np.ndarray:
    return mix(grams ^ mix(np.array([order + 1], np.uint64)))


def _place(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def profiles(docs: DataFrame, width: int, orders: int) -> DataFrame:
    """One scan: rows ``(kind 0, doc_id, class, size, bitmap)`` per document and, for each task, ``(kind 1, chunk, -, -, -, counts)``:
    how many tokens (one per document) have each place under each order."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts, some = np.zeros((orders, 1 << PLACE_BITS), np.uint32), False
        for batch, data, cuts in blocks(batches, "text"):
            keys, sizes, bits, parts = [], [], [], []
            for grams in shingle_sets(data, cuts, width):
                keys.append(_signature(grams))
                sizes.append(len(grams))
                bits.append(_parities(grams))
                parts.append(grams)
            words = {w: pa.array(np.ascontiguousarray(x)) for w, x in zip(WORDS, _signed(np.stack(bits)).T)}
            empty = pa.nulls(len(sizes), pa.binary())
            yield _batch(kind=pa.array(np.zeros(len(sizes), np.int32)), id=batch.column(0).cast(pa.int64()), key=pa.array(_signed(keys)), n=pa.array(sizes, pa.int64()), **words, counts=empty)
            tokens = np.concatenate(parts)
            for order in range(orders):
                np.add.at(counts[order], _place(_mixed(tokens, order)), np.uint32(1))
            some |= len(tokens) > 0
        for k, chunk in enumerate(counts.reshape(-1, CHUNK) if some else ()):
            told = zlib.compress(np.minimum(chunk, 255).astype(np.uint8).tobytes(), 1)
            none = {c: pa.nulls(1, pa.int64()) for c in ("key", "n", *WORDS)}
            yield _batch(kind=pa.array([1], pa.int32()), id=pa.array([k], pa.int64()), **none, counts=pa.array([told], pa.binary()))
        del counts
        give_back()

    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(run, ", ".join(["kind int, id long, key long, n long", *(f"{w} long" for w in WORDS), "counts binary"]))


def frequencies(scanned: DataFrame, orders: int) -> np.ndarray:
    """A level of 0 to 63 for each order and place: by how far its count lies above or below the mean one."""
    mean = (scanned.filter("kind = 0").agg(F.sum("n")).first()[0] or 0) / (1 << PLACE_BITS)

    def level(frame: pd.DataFrame) -> pd.DataFrame:
        z = (sum(np.frombuffer(zlib.decompress(x), np.uint8).astype(np.float64) for x in frame["counts"]) - mean) / max(mean**0.5, 1.0)
        found = np.where(z <= 8, 8 + 4 * z, 40 + 2 * np.log2(np.maximum(z, 8) / 8))
        return pd.DataFrame({"id": frame["id"].iloc[:1], "levels": [np.clip(found, 0, 63).astype(np.uint8).tobytes()]})

    rows = scanned.filter("kind = 1").select("id", "counts").groupBy("id").applyInPandas(level, "id long, levels binary").collect()
    levels = np.zeros(orders << PLACE_BITS, np.uint8)  # of fixed size, however large the corpus
    for row in rows:
        levels[row["id"] * CHUNK : (row["id"] + 1) * CHUNK] = np.frombuffer(row["levels"], np.uint8)
    return levels.reshape(orders, -1)


def _order(grams: np.ndarray, order: int, levels: np.ndarray) -> np.ndarray:
    """Rank of each token under a global order: first by how frequent it seems to be, then by a hash."""
    mixed = _mixed(grams, order)
    return (levels[order][_place(mixed)].astype(np.uint64) << np.uint64(58)) | (mixed & np.uint64((1 << 58) - 1))


def _prefix(grams: np.ndarray, order: int, levels: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which a similar set shares one: the first ones under the order. Their lowest bit tells early ones,
    of which a similar set that is no smaller shares one."""
    n = len(grams)
    length, early = n - -(-n * percent // 100) + 1, n - -(-2 * n * percent // (100 + percent)) + 1
    if early < n:
        grams = grams[np.argpartition(_order(grams, order, levels), sorted({early - 1, min(length, n) - 1}))[:length]]
    return (grams & ~np.uint64(1)) | (np.arange(len(grams)) < early).astype(np.uint64)


def postings(docs: DataFrame, width: int, percent: int, orders: int, shards: int, levels: Broadcast) -> DataFrame:
    """Prefix tokens of every class and order, dealt by token into blocks of arrays. A part of the input sends a class once."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        held: list[tuple[int, int, int, np.ndarray]] = []
        n = 0

        def emit():
            out = {"key": [], "tokens": [], "classes": [], "sizes": [], "counts": []}
            for order in range(orders):
                own = [h for h in held if h[0] == order]
                tokens = np.concatenate([h[3] for h in own])
                owner = np.repeat(np.arange(len(own)), [len(h[3]) for h in own])
                classes, sizes = np.array([h[1] for h in own], np.uint64), np.array([h[2] for h in own], np.uint32)
                shard = (tokens >> np.uint64(20)) % np.uint64(shards)
                by = np.argsort(shard, kind="stable")
                tokens, owner, shard = tokens[by], owner[by], shard[by]
                ends = np.searchsorted(shard, np.arange(shards + 1))
                for s in range(shards):
                    a, b = ends[s], ends[s + 1]
                    if a < b:
                        who, count = np.unique(owner[a:b], return_counts=True)
                        for name, x in (("key", order * shards + s), ("tokens", tokens[a:b].tobytes()), ("classes", classes[who].tobytes()), ("sizes", sizes[who].tobytes()), ("counts", count.astype(np.uint32).tobytes())):
                            out[name].append(x)
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), *((k, pa.binary()) for k in ("tokens", "classes", "sizes", "counts"))]))

        for _, data, cuts in blocks(batches, "text"):
            for grams in shingle_sets(data, cuts, width):
                if len(grams) and (key := _signature(grams)) not in seen:
                    seen.add(key)
                    for order in range(orders):
                        held.append((order, key, len(grams), _prefix(grams, order, levels.value, percent)))
                        n += len(held[-1][3])
            if n >= 1 << 18:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()
            held.clear()
        give_back()

    return docs.select("text").mapInArrow(run, "key long, tokens binary, classes binary, sizes binary, counts binary")


def _same(tokens: np.ndarray) -> np.ndarray:
    """Whether each token but the first is that before it; the lowest bit is no part of a token."""
    return (tokens[1:] ^ tokens[:-1]) <= 1


def _read(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token (with its lowest bit), class and size of every posting of a shard, by token; only tokens of two classes or more."""
    join = lambda name, kind: np.frombuffer(b"".join(frame[name]), kind)
    tokens = join("tokens", np.uint64)
    by = np.argsort(tokens, kind="stable")
    ordered = tokens[by]
    twice = np.zeros(len(by), bool)
    twice[1:] = _same(ordered)
    twice[:-1] |= twice[1:]
    # most tokens come once: the rest of the work is on the others alone
    by = by[twice]
    owner = np.searchsorted(np.cumsum(join("counts", np.uint32).astype(np.int64)), by, side="right")
    tokens, classes, sizes = ordered[twice], join("classes", np.uint64)[owner], join("sizes", np.uint32)[owner]
    by = np.lexsort((classes, tokens))
    tokens, classes, sizes = tokens[by], classes[by], sizes[by]
    new = np.ones(len(by), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])  # parts of the input may send a class alike
    tokens, classes, sizes = tokens[new], classes[new], sizes[new]
    again = np.zeros(len(tokens), bool)
    again[1:] = _same(tokens)
    again[:-1] |= again[1:]
    return tokens[again], classes[again], sizes[again]


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    a, b = a.astype(np.int64), b.astype(np.int64)
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _pairs(low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
    a, b = np.minimum(low, high), np.maximum(low, high)
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return pd.DataFrame({"a": pairs[:, 0].astype(np.uint64).view(np.int64), "b": pairs[:, 1].astype(np.uint64).view(np.int64)})


def _alike(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` can link: their bitmaps differ in no more bits than linked sets do in tokens."""
    differ = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (100 + percent) * differ <= (100 - percent) * (a.astype(np.int64) + b.astype(np.int64))


def _starts(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the run of each token begins, and how long it is."""
    starts = np.flatnonzero(np.concatenate([[True], ~_same(tokens)]))
    return starts, np.diff(np.append(starts, len(tokens)))


def _useful(tokens: np.ndarray, classes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings beside another of near size where the smaller one of the two is early."""
    early = (tokens & np.uint64(1)) == 1
    by = np.lexsort((~early, sizes, tokens >> np.uint64(1)))
    tokens, classes, sizes, early = tokens[by], classes[by], sizes[by], early[by]
    starts, lengths = _starts(tokens)
    first = np.repeat(starts, lengths)
    # the last early posting before each one is the largest of those that are no larger
    last = np.maximum.accumulate(np.where(early, np.arange(len(tokens)), -1))
    last = np.concatenate([[-1], last[:-1]])
    follows = (last >= first) & _near(sizes, sizes[last], percent)
    leads = np.zeros(len(tokens), bool)
    leads[:-1] = early[:-1] & (first[1:] == first[:-1]) & _near(sizes[1:], sizes[:-1], percent)
    return tuple(x[follows | leads] for x in (tokens, classes, sizes))


def _shared(frame: pd.DataFrame, percent: int, shards: int) -> pd.DataFrame:
    """The postings of a shard that may tell a link, dealt by the smallest class of each token's run."""
    order = int(frame["key"].iloc[0]) // shards
    tokens, classes, sizes = _read(frame)
    out = []
    if len(tokens):
        tokens, classes, sizes = _useful(tokens, classes, sizes, percent)
    if len(tokens):
        starts, lengths = _starts(tokens)
        salt = (tokens[starts] >> np.uint64(1)) % (1 + lengths // SALTED).astype(np.uint64)
        place = np.repeat(mix(np.minimum.reduceat(classes, starts) ^ mix(salt)) % np.uint64(shards), lengths)
        by = np.argsort(place, kind="stable")
        tokens, classes, sizes, place = tokens[by], classes[by], sizes[by], place[by]
        cuts = np.flatnonzero(np.diff(place, prepend=place[:1] + np.uint64(1), append=place[-1:] + np.uint64(1)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out.append({"key": order * shards + int(place[a]), "x": tokens[a:b].tobytes(), "y": classes[a:b].tobytes(), "z": sizes[a:b].tobytes()})
    give_back()
    return pd.DataFrame(out, columns=["key", "x", "y", "z"])


def _gathered(frame: pd.DataFrame) -> pd.DataFrame:
    """What came to a place: its postings (kind 1), of tokens with the same classes only one, and its classes (kind 2)."""
    tokens, classes, sizes = (np.frombuffer(b"".join(frame[c]), kind) for c, kind in (("x", np.uint64), ("y", np.uint64), ("z", np.uint32)))
    starts, lengths = _starts(tokens)
    _, one = np.unique(np.stack([np.add.reduceat(mix(classes), starts), lengths.astype(np.uint64)], 1), axis=0, return_index=True)
    kept = np.zeros(len(starts), bool)
    kept[one] = True
    kept = np.repeat(kept, lengths)
    tokens, classes, sizes = tokens[kept] >> np.uint64(1), classes[kept], sizes[kept]
    key = int(frame["key"].iloc[0])
    held = np.unique(classes)
    give_back()
    return pd.DataFrame([
        {"key": key, "kind": 1, "x": tokens.tobytes(), "y": classes.tobytes(), "z": sizes.tobytes()},
        {"key": key, "kind": 2, "x": held.tobytes(), "y": b"", "z": b""},
    ])


def shared_tokens(dealt: DataFrame, percent: int, shards: int) -> DataFrame:
    """Rows ``(key, 1, tokens, classes, sizes)`` of the postings that may tell a link and ``(key, 2, classes, -, -)`` of
    their classes; ``key`` is the order times ``shards`` plus a place."""

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        return _shared(frame, percent, shards)

    moved = dealt.groupBy("key").applyInPandas(shared, "key long, x binary, y binary, z binary")
    return moved.groupBy("key").applyInPandas(_gathered, "key long, kind int, x binary, y binary, z binary")


def _known(told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes in order, with what is told of each: its component's label and its bitmap."""
    known = told["class"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(known)
    return known[by], told["label"].to_numpy(np.int64)[by], np.ascontiguousarray(told[WORDS].to_numpy(np.int64)).view(np.uint64)[by]


def _runs(x: bytes, y: bytes, z: bytes):
    """Tokens, classes and sizes of a shard's postings, and where the run of each token begins and ends."""
    tokens, classes, sizes = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), np.frombuffer(z, np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    return classes, sizes, starts, np.append(starts[1:], len(tokens))


def _middle(bits: np.ndarray) -> int:
    """Which bitmap is next to the majority of all of them, bit by bit."""
    ones = sum(np.unpackbits(bits[k : k + (1 << 14)].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(bits), 1 << 14))
    most = np.packbits(2 * ones > len(bits)).view(np.uint64)
    return int(np.argmin(np.bitwise_count(bits ^ most).sum(axis=1, dtype=np.int64)))


def _hubs(postings: pd.DataFrame, told: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    """Each class of a token beside the token's hub."""
    if not len(postings):
        return
    known, _, bits = _known(told)
    for x, y, z in zip(postings["x"], postings["y"], postings["z"]):
        classes, sizes, starts, ends = _runs(x, y, z)
        at = np.searchsorted(known, classes)
        hub = starts.copy()
        for k in np.flatnonzero(ends - starts >= LONG_RUN).tolist():
            hub[k] += _middle(bits[at[starts[k] : ends[k]]])
        hub = np.repeat(hub, ends - starts)
        ok = np.flatnonzero((classes != classes[hub]) & _near(sizes, sizes[hub], percent))
        ok = ok[_alike(bits[at[ok]], bits[at[hub[ok]]], sizes[ok], sizes[hub[ok]], percent)]
        yield _pairs(classes[ok], classes[hub[ok]])


def _longs(df: DataFrame, **columns: str) -> DataFrame:
    """Rows of 64-bit values from columns that hold arrays of them; further columns are repeated."""
    kept = [c for c in df.columns if c not in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                arrays = {name: np.frombuffer(batch.column(batch.schema.names.index(c))[k].as_py(), np.int64) for name, c in columns.items()}
                n = len(next(iter(arrays.values())))
                for low in range(0, n, 1 << 16):
                    rest = {c: pa.array([batch.column(batch.schema.names.index(c))[k].as_py()] * (min(n, low + (1 << 16)) - low), pa.int64()) for c in kept}
                    yield _batch(**rest, **{name: pa.array(v[low : low + (1 << 16)]) for name, v in arrays.items()})

    return df.mapInArrow(run, ", ".join([*(f"{c} long" for c in kept), *(f"{c} long" for c in columns)]))


def _across(postings: pd.DataFrame, told: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    """Pairs of classes that share a token of the shard, are in different components and have bitmaps that allow a link."""
    if not len(postings):
        return
    known, label, bits = _known(told)
    low, high, held = [], [], 0
    for x, y, z in zip(postings["x"], postings["y"], postings["z"]):
        classes, sizes, starts, ends = _runs(x, y, z)
        at = np.searchsorted(known, classes)
        own = label[at]
        mixed = np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)
        for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist()):
            sort = s + np.argsort(sizes[s:e], kind="stable")
            for i, k in enumerate(sort.tolist()):
                # larger sets up to size / t come next in this order
                rest = sort[i + 1 : np.searchsorted(sizes[sort], sizes[k] * 100 // percent, side="right")]
                rest = rest[own[rest] != own[k]]
                rest = rest[_alike(bits[at[rest]], bits[at[k]], sizes[rest], sizes[k], percent)]
                if len(rest):
                    low.append(np.full(len(rest), classes[k]))
                    high.append(classes[rest])
                    held += len(rest)
            if held >= 1 << 20:
                yield _pairs(np.concatenate(low), np.concatenate(high))
                low, high, held = [], [], 0
    if held:
        yield _pairs(np.concatenate(low), np.concatenate(high))


def wanted_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(class, grams)`` of the documents in ``wanted(class, id)``: 40 bits of each shingle, sorted.

    A bit field of fixed size tells the scan which documents to send. It may let others through, which the join drops.
    """
    place = F.pmod(F.xxhash64("class", "id"), F.lit(WANTED_BITS)) + 1  # Spark's bitmaps count bits from 1
    rows = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    ).collect()  # at most WANTED_BITS / 32768 rows of 4 KB
    bits = np.zeros(WANTED_BITS // 8 + 4096, np.uint8)
    for row in rows:
        bits[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    field = docs.sparkSession.sparkContext.broadcast(bits)

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch, data, cuts in blocks(batches, "text"):
            keys, sets = [], []
            for grams in shingle_sets(data, cuts, width):
                keys.append(_signature(grams))
                high = grams >> np.uint64(24)
                sets.append((high >> np.uint64(8)).astype(np.uint32).tobytes() + high.astype(np.uint8).tobytes())
            yield _batch(id=batch.column(0).cast(pa.int64()), **{"class": pa.array(_signed(keys))}, grams=pa.array(sets, pa.binary()))
        give_back()

    def held(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            p = batch.column(0).to_numpy() - 1
            yield batch.filter(pa.array((field.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))

    every = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(keyed, "id long, class long, grams binary")
    some = every.select(place.alias("p"), "class", "grams").mapInArrow(held, "p long, class long, grams binary")
    return some.select("class", "grams")


def _set(grams: bytes) -> np.ndarray:
    n = len(grams) // 5
    return (np.frombuffer(grams, np.uint32, n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(grams, np.uint8, n, 4 * n)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity, counted exactly."""
    left = sets.select(F.col("class").alias("a"), F.col("grams").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("grams").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _set(x.as_py()), _set(y.as_py())
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _inside(frame: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    """How many links each class has to the others of its block, or of the two blocks, counted exactly.

    Intersections are products of 0/1 matrices (a row per class, a column per token that two classes hold).
    """
    for (_, low, high), own in frame.groupby(["label", "low", "high"], sort=False):
        sets = [_set(x) for x in own["grams"]]
        sizes = np.array([len(x) for x in sets])
        tokens, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = held > 1
        row, column = np.repeat(np.arange(len(sets)), sizes)[shared[at]], (np.cumsum(shared) - 1)[at][shared[at]]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        part = own["part"].to_numpy()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        both = np.zeros((len(left), len(right)), np.int64)
        for start in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            holds = np.zeros((len(sets), COLUMNS), np.float32)
            holds[row[a:b], column[a:b] - start] = 1
            both += (holds[left] @ holds[right].T).astype(np.int64)
        linked = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
        classes = own["class"].to_numpy()
        if low == high:
            np.fill_diagonal(linked, False)
        else:
            yield pd.DataFrame({"class": classes[right], "n": linked.sum(axis=0)})
        yield pd.DataFrame({"class": classes[left], "n": linked.sum(axis=1)})


def link_counts(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(class, n_links)`` of every class of ``named(class, label, n_shingles)`` that is not alone in its component.
    ``sets(class, grams)`` may repeat a class.

    All pairs of a component are looked at, as every link lies in one. A component of two is one link. A larger one is
    cut into blocks of bounded size, and a task counts within a block or between two; many small components share a task.
    """
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("tokens")).filter("members > 1")
    parts = F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("members") / BLOCK_CLASSES)).cast("int")
    met = store(named.join(sizes, "label").select("class", "label", "members", "tokens", parts.alias("parts")), "components")
    many = met.filter("members > 2")
    whole = many.filter("parts = 1").select("label", "tokens").distinct().agg(F.sum("tokens")).first()[0] or 0
    groups = max(16, -(-whole // BLOCK_TOKENS))
    dealt = many.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("class", "label", "part", "parts", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    key = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(F.xxhash64("label", "low", "high"))
    own = sets.join(many.select("class"), "class", "left_semi").dropDuplicates(["class"])
    rows = dealt.join(own, "class").select(key.alias("key"), "class", "label", "part", "low", "high", "grams")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_inside(frame, percent))

    found = rows.groupBy("key").applyInPandas(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n_links"))
    return found.unionByName(met.filter("members = 2").select("class", F.lit(1).cast("long").alias("n_links")))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, orders: int = 2, shard_bytes: int = 1 << 26
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``n_links``.

    Documents link when ``100 * |intersection| >= percent * |union|`` of their distinct ``width``-word shingles;
    components are the documents that links reach. ``component_id`` is the component's smallest id, ``n_links`` the
    number of all links of the document's class (each joins it to another class).

    Null or blank text has an empty set, links with nothing and is its own component. Texts under ``width`` words are
    one shingle. Equal sets are one class, whatever their number; rows that repeat an id stay rows of their own in the
    same component if their sets link. A null id is never the smallest; its component is null if no other id is in it.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    shards = shards_for(text_bytes(docs), shard_bytes)
    scanned = store(profiles(docs, width, orders), "shingle-profiles")
    rows = scanned.filter("kind = 0").select(F.col("id").alias("doc_id"), F.col("key").alias("class"), F.col("n").alias("n_shingles"), *WORDS)
    levels = spark.sparkContext.broadcast(frequencies(scanned, orders))
    dealt = postings(docs, width, percent, orders, shards, levels)
    shared = store(shared_tokens(dealt, percent, shards), "shared-tokens")
    levels.unpersist()
    classes = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), *(F.min(w).alias(w) for w in WORDS))

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = store(pairs.distinct(), "candidates")
        both = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        wanted = classes.join(both, "class", "left_semi")
        sets = store(wanted_sets(docs, wanted, width), "wanted-sets")
        return store(verify(pairs, sets, percent), "links"), sets

    found = shared.filter("kind = 1").select("key", "x", "y", "z")

    def members(of: DataFrame) -> DataFrame:
        return _longs(of.filter("kind = 2").select("key", "x"), **{"class": "x"}).join(classes.select("class", *WORDS), "class")

    def hub(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_pairs(np.zeros(0, np.uint64), np.zeros(0, np.uint64)), *_hubs(left, right, percent)])

    first = F.col("key") < shards
    told = members(shared.filter(first)).withColumn("label", F.col("class"))
    links, sets = linked(found.filter(first).groupBy("key").cogroup(told.groupBy("key")).applyInPandas(hub, "a long, b long"))
    labels = connected_components(links)
    told = members(shared).join(labels, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("label", "class").alias("label"), *WORDS)

    def across(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs = list(_across(left, right, percent))
        every = pd.concat(pairs).drop_duplicates() if pairs else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        return every.assign(ord=np.int32(int(key[0]) // shards))

    rest = found.groupBy("key").cogroup(told.groupBy("key")).applyInPandas(across, "a long, b long, ord int")
    passed = rest.groupBy("a", "b").agg(F.count_distinct("ord").alias("n")).filter(F.col("n") == orders).select("a", "b")
    more, other_sets = linked(passed)
    links = links.unionByName(more).distinct()
    labels = connected_components(links)
    named = classes.join(labels, F.col("class") == F.col("node"), "left").select("class", "id", "n_shingles", F.coalesce("label", "class").alias("label"))
    # a class with a link was verified, so its set is among these
    degree = link_counts(named, sets.unionByName(other_sets), percent)
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_class = named.join(smallest, "label").join(degree, "class", "left").select("class", "component_id", "n_links")
    filled = rows.filter("n_shingles > 0").join(of_class, "class")
    empty = rows.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(None).cast("long")})
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    return filled.select(*columns).unionByName(empty.select(*columns))
