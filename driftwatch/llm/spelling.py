"""Spelling variants: words of a vocabulary within one inserted, deleted or replaced code point of each other.

A pair of near words differs at one place. Cut the longer word's places in two windows: in one of them the words share
all that stands before the window, in the other all that follows. So every word goes to one group per window and length,
named by the hash of what it must share, and each near pair meets in exactly one group. A group is a sorted list that is
scanned with edit-matrix rows of three cells (the band of one edit): adjacent words share a prefix (their LCP), the row of
a shared prefix is computed once for all words below it, and ranges whose row exceeds one edit are left out whole. All
words of a group are looked up at once, one code point at a time. A group with too many words has its window cut again;
a window of one place holds few words, as only one code point can differ.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import give_back, store

LETTERS = "A-Za-zÀ-ÿ"  # fixed: the letters of a word
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ("key", "longest", "low", "high")
#: Words that are scanned at once, about.
_BLOCK = 1 << 15
_FOUND = "word string, n_near long, form string, form_n long"


def count_words(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, alter: Callable[[Column, Column], Column] | None = None,
    removes: int = 0,
) -> DataFrame:
    """``(word, n)``: runs of Latin letters, A-Z lower-cased, with ``shortest`` code points or more, found ``least`` times or more.

    ``alter(id, word)`` may rewrite each run before it is counted, taking at most ``removes`` code points away. Null and
    empty texts have no words; a null id reaches ``alter`` as null. Rows that repeat count again. Whole texts count.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))
    rows = docs.select(F.col(id_column).alias("_id"), F.explode(runs).alias("_run"))
    word = F.translate("_run", _UPPER, _LOWER)
    if alter is not None:
        rows = rows.select("_id", word.alias("_run"))
        word = alter(F.col("_id"), F.col("_run"))
    words = rows.select(word.alias("word"))
    if removes:
        words = words.filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _windows(words: DataFrame) -> DataFrame:
    """Every word with the two windows of each length that the longer word of its pairs can have."""
    size = F.length("word")

    def halves(longest: Column) -> list[Column]:
        middle = F.ceil(longest / 2).cast("int")
        cut = lambda low, high: F.struct(longest.alias("longest"), low.alias("low"), high.alias("high"))
        return [cut(F.lit(0), middle), cut(middle, longest)]

    rows = words.select("word", "n", F.explode(F.array(*halves(size), *halves(size + 1))).alias("w"))
    return rows.select("word", "n", "w.longest", "w.low", "w.high").filter("low < high")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the hash of what the near words of a window share: the code points before ``low`` and from ``high`` on."""
    shared = F.xxhash64(F.expr("left(word, low)"), F.expr("right(word, longest - high)"))
    return rows.select(shared.alias("key"), "longest", "low", "high", "word", "n")


def _cut_again(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    parts = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return rows.select("word", "n", "longest", F.explode(parts).alias("w")).select("word", "n", "longest", "w.low", "w.high")


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each begins (with the end of the last)."""
    text = words.cast(pa.large_string())
    cuts = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), chars[cuts - cuts[0]]


def _common(codes: np.ndarray, cuts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each word the length of its common prefix with the word before; -1 where a group begins."""
    sizes = np.diff(cuts)
    out = np.where(group, -1, 0)
    left = np.flatnonzero(~group)
    depth = 0
    while len(left):
        left = left[(sizes[left] > depth) & (sizes[left - 1] > depth)]
        left = left[codes[cuts[left] + depth] == codes[cuts[left - 1] + depth]]
        depth += 1
        out[left] = depth
    return out


def near_pairs(codes: np.ndarray, cuts: np.ndarray, begins: np.ndarray, longest: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, near word), by number, in both directions, of sorted lists of distinct words.

    ``begins`` is true where a list begins. A pair counts if the longer of its words has ``longest`` code points and their
    first difference stands in ``low .. high - 1``; all three are given per word and equal within a list.
    """
    lcp = _common(codes, cuts, begins)
    sizes = np.diff(cuts)
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(begins))
    several = ends - starts > 1
    starts, ends = starts[several], ends[several]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the first depth of a list is what all its words share, so its rows begin there
    inner = lcp.copy()
    inner[begins] = np.iinfo(lcp.dtype).max
    shared = np.minimum.reduceat(inner, starts)
    widths = ends - starts
    word = np.concatenate([np.arange(a, b) for a, b in zip(starts.tolist(), ends.tolist())])
    enter, first, last = np.repeat(shared, widths), np.repeat(starts, widths), np.repeat(ends, widths)
    order = np.argsort(enter, kind="stable")
    word, enter, first, last = word[order], enter[order], first[order], last[order]
    depth, taken = 0, 0
    # a state: a query word, a range of the list, the three cells of its row, the place of the first difference or -1
    q = lo = hi = at = np.zeros(0, np.int64)
    row = np.zeros((3, 0), np.int8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(q) or taken < len(word):
        if not len(q):
            depth = max(depth, int(enter[taken]))
        more = int(np.searchsorted(enter, depth, side="right"))
        if more > taken:
            new = word[taken:more]
            q, lo, hi = np.append(q, new), np.append(lo, first[taken:more]), np.append(hi, last[taken:more])
            at = np.append(at, np.full(len(new), -1))
            fresh = np.ones((3, len(new)), np.int8)
            fresh[0] += depth == 0
            fresh[1] = 0
            fresh[2] += sizes[new] < depth + 1
            row = np.concatenate([row, fresh], axis=1)
            taken = more
        # the first word of a range may end here
        done = sizes[lo] == depth
        gap = sizes[q] - depth
        cell = np.where(np.abs(gap) <= 1, row[np.clip(gap + 1, 0, 2), np.arange(len(q))], 2)
        where = np.where(at < 0, depth, at)
        hit = done & (cell == 1) & (where >= low[q]) & (where < high[q]) & (np.maximum(sizes[q], depth) == longest[q])
        if hit.any():
            found.append((q[hit], lo[hit]))
        lo = lo + done
        # ranges go apart where neighbours share no more than this depth
        seams = np.flatnonzero(lcp <= depth)
        a, b = np.searchsorted(seams, lo, side="right"), np.searchsorted(seams, hi, side="left")
        parts = np.where(lo < hi, b - a + 1, 0)
        owner = np.repeat(np.arange(len(q)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.where(nth == 0, lo[owner], seams[np.minimum(a[owner] + nth - 1, len(seams) - 1)])
        end = np.where(nth == parts[owner] - 1, hi[owner], seams[np.minimum(a[owner] + nth, len(seams) - 1)])
        q, at, row = q[owner], at[owner], row[:, owner]
        lo, hi = begin, end
        sign = codes[cuts[lo] + depth]

        def differs(shift: int) -> np.ndarray:
            place = depth + shift
            inside = (place >= 0) & (place < sizes[q])
            return np.where(inside, codes[np.where(inside, cuts[q] + place, 0)] != sign, 3).astype(np.int8)

        same = differs(0)
        r0 = np.minimum(row[0] + differs(-1), row[1] + 1)
        r1 = np.minimum(np.minimum(row[1] + same, row[2] + 1), r0 + 1)
        r2 = np.minimum(row[2] + differs(1), r1 + 1)
        r1 = np.where(sizes[q] < depth + 1, 2, r1)
        r2 = np.where(sizes[q] < depth + 2, 2, r2)
        at = np.where((at < 0) & (same != 0), depth, at)
        place = np.where(at < 0, depth + 1, at)
        live = (np.minimum(np.minimum(r0, r1), r2) <= 1) & ((at < 0) | (at >= low[q])) & ((place < high[q]) | ((at < 0) & (depth + 1 < high[q])))
        q, lo, hi, at = q[live], lo[live], hi[live], at[live]
        row = np.stack([r0[live], r1[live], r2[live]])
        depth += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _scan(table: pa.Table) -> pa.RecordBatch | None:
    """The near words found in whole groups: a row per word that has any."""
    words, counts = table.column("word").combine_chunks(), table.column("n").to_numpy()
    codes, cuts = _codes(words)
    fields = [table.column(c).to_numpy() for c in _KEY]
    begins = np.ones(len(counts), bool)
    begins[1:] = np.any([f[1:] != f[:-1] for f in fields], axis=0)
    a, b = near_pairs(codes, cuts, begins, *fields[1:])
    if not len(a):
        return None
    order = np.lexsort((b, -counts[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    n_near = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(a[first])), pa.array(n_near.astype(np.int64)), words.take(pa.array(b[first])), pa.array(counts[b[first]].astype(np.int64))],
        names=["word", "n_near", "form", "form_n"],
    )


def _scan_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan sorted rows in blocks of whole groups."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def whole(final: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch], int]:
        table = pa.Table.from_batches(held).combine_chunks()
        cut = table.num_rows
        if not final:
            last = np.all([(f := table.column(c).to_numpy()) == f[-1] for c in _KEY], axis=0)
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        rest = table.slice(cut)
        return (_scan(table.slice(0, cut)) if cut else None), rest.to_batches(), rest.num_rows

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= _BLOCK:
            out, held, rows = whole(False)
            if out is not None:
                yield out
    if rows:
        out, held, rows = whole(True)
        if out is not None:
            yield out
    held.clear()
    give_back()


def near_words(words: DataFrame, most: int = 4096) -> DataFrame:
    """``(word, n_near, form, form_n)`` for every word of ``words(word, n)`` that has near words.

    ``form`` is the near word with the largest count (ties: the smallest in code-point order). ``most`` bounds the words of a
    group that a task holds: larger groups have their window cut again, until every group is small or its window is one
    place. Words are distinct and not null; a word without near words has no row.
    """
    words = store(words, "vocabulary")
    rows, n_words = _keyed(_windows(words)), words.count()
    parts, rounds = [], 0
    while True:
        cuttable = F.col("high") - F.col("low") > 1
        large = store(rows.filter(cuttable).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*_KEY), "large-groups")
        again = not large.isEmpty()
        small = rows.join(large, list(_KEY), "left_anti") if again else rows
        dealt = small.repartition(max(16, n_words // 40_000), *[F.col(c) for c in _KEY]).sortWithinPartitions(*_KEY, "word")
        parts.append(store(dealt.select(*_KEY, "word", "n").mapInArrow(_scan_groups, _FOUND), f"near-words-{rounds}"))
        if not again:
            break
        rows = store(_keyed(_cut_again(rows.join(large, list(_KEY), "left_semi"))), f"cut-groups-{rounds}")
        rounds += 1
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def variants(words: DataFrame, times: int = 10, most: int = 4096) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of a vocabulary ``(word, n)``.

    ``form`` is the most frequent near word if it is ``times`` as frequent as the word, else null (and ``form_n`` with it);
    ``root`` is the last word met by following forms, the word itself if it has none. As counts grow by ``times`` (above 1)
    with each step, the largest count bounds the length of a chain, and chains are followed by doubling.

    Null words are left out. Words that stand in several rows count as one, with the sum of their counts. Empty and one-letter
    words are words like others. An empty table gives no rows; columns other than ``word`` and ``n`` are ignored.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    one = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    one = store(one, "words")
    near = one.join(near_words(one, most), "word", "left")
    strong = F.col("form_n") >= F.col("n") * times
    told = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")
    )
    told = store(told, "forms")
    root = told.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    largest = told.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(largest, 2), times)))
    for k in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        root = store(root, f"roots-{k}")
        next_root = root.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        root = root.join(next_root, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"))
    return told.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
