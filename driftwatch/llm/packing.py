"""Vector bin packing of tokenised examples into training sequences."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import blocks, give_back
from driftwatch.llm.words import spans

#: Examples that are packed together, and words that a task remembers.
BLOCK_EXAMPLES, BLOCK_TOKENS, KNOWN_WORDS = 8192, 1 << 21, 1_000_000
#: Bytes of text that are encoded at once (their words' places and hashes need some fifty times that).
RUN_BYTES = 1 << 19
#: Words that are tokenised in one text, and characters beyond which a word is a text of its own; words whose tokens are held as objects.
_JOINED, _LONG_WORD, _TOKENISED = 256, 1024, 4096
_LETTER_PIECE = 1 << 14


class Encoder:
    """Token ids of whole texts by a word-level vocabulary file; every different word is tokenised once per partition.

    Such a vocabulary drops white space and never joins across it, so a text's ids are those of its words in order. A
    word is remembered as its hash and its ids in arrays. The memory is emptied when it is full, which changes no result.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.end = end
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.words = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ids, self.starts, self.n_words = [np.array([self.end], np.uint32)], np.array([0, 1], np.int64), 1

    def _tokenise(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has. Words are handed over many at a time with spaces
        between them and told apart by where their tokens begin; long words, and those that normalising changes, stand alone."""
        alone = [len(t) > _LONG_WORD or not (t.isascii() or is_normalized("NFC", t)) for t in texts]
        together = [k for k, own in enumerate(alone) if not own]
        groups = [together[k : k + _JOINED] for k in range(0, len(together), _JOINED)]
        single = [k for k, own in enumerate(alone) if own]
        counts, ids, owners = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for group, found in zip(groups, self.model.encode_batch([" ".join([texts[k] for k in g]) for g in groups], add_special_tokens=False)):
            ends = np.cumsum([len(texts[k]) + 1 for k in group])
            at = np.fromiter((o[0] for o in found.offsets), np.int64)
            ids.append(np.array(found.ids, np.uint32))
            owners.append(np.array(group)[np.searchsorted(ends, at, side="right")])
        for k, found in zip(single, self.model.encode_batch_fast([texts[k] for k in single], add_special_tokens=False)):
            ids.append(np.array(found.ids, np.uint32))
            owners.append(np.full(len(found.ids), k))
        every, owner = np.concatenate(ids), np.concatenate(owners)
        if single:
            every = every[np.argsort(owner, kind="stable")]
        counts += np.bincount(owner, minlength=len(texts))
        return every, counts

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if self.n_words + len(keys) > KNOWN_WORDS:
            self.clear()
        parts = [self._tokenise(texts[k : k + _TOKENISED]) for k in range(0, len(texts), _TOKENISED)]
        found, counts = (np.concatenate(x) for x in zip(*parts))
        self.ids.append(found)
        ends = np.cumsum(counts) + self.starts[-1]
        self.starts = np.concatenate([self.starts, ends])
        fresh = np.arange(self.n_words, self.n_words + len(keys))
        self.n_words += len(keys)
        tier = 1 if len(self.keys[1]) + len(keys) < 50_000 else 0
        keys = np.concatenate([keys, self.keys[1], *([self.keys[0]] if tier == 0 else [])])
        fresh = np.concatenate([fresh, self.words[1], *([self.words[0]] if tier == 0 else [])])
        order = np.argsort(keys, kind="stable")
        if tier == 0:
            self.keys[1], self.words[1] = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.keys[tier], self.words[tier] = keys[order], fresh[order]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for known, words in zip(self.keys, self.words):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = words[at[hit]]
        return out

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and where each text's ids begin."""
        first, last, texts, hashes = spans(data, cuts)
        keys, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        word = self._find(keys)
        if (word < 0).any():
            missing = np.flatnonzero(word < 0)
            raw = data.tobytes()
            # the hash ignores A-Z against a-z, and so does the vocabulary
            self._learn(keys[missing], [raw[a:b].decode("utf-8", "replace").lower() if raw[a:b].isascii() else raw[a:b].decode("utf-8", "replace") for a, b in zip(first[at[missing]].tolist(), last[at[missing]].tolist())])
            word = self._find(keys)
            if (word < 0).any():  # the memory was emptied meanwhile
                return self.encode(data, cuts)
        n = len(cuts) - 1
        held = np.bincount(texts, minlength=n)
        sequence = np.zeros(len(texts) + n, np.int64)  # word 0 is the end id
        sequence[np.arange(len(texts)) + texts] = word[which]
        lengths = self.starts[sequence + 1] - self.starts[sequence]
        total = np.concatenate([[0], np.cumsum(lengths)])
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        ids = self.ids[0][np.arange(total[-1]) + np.repeat(self.starts[sequence] - total[:-1], lengths)]
        return ids, total[np.concatenate([[0], np.cumsum(held + 1)])]


@cache
def encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def place(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> list[list[tuple[int, int, int]]]:
    """Pack examples into sequences: lists of (example, first token, tokens).

    ``loss`` counts the loss-bearing tokens, which are the last ones of an example. A sequence is filled one piece at a
    time by the example with the largest dot product of its demand with what is left, both as shares of the limits and
    weighted by the mean demand. Where no example fits whole, the longest is cut to fill the rest exactly, so all
    sequences but the last are full unless segments or loss run out first.
    """
    cap, most, cap_loss = limits
    done = np.zeros(len(tokens), np.int64)
    bins: list[list[tuple[int, int, int]]] = []
    for k in np.flatnonzero(tokens > cap).tolist():
        while tokens[k] - done[k] > cap:
            bare = tokens[k] - loss[k] - done[k]
            take = min(cap, max(bare, 0) + cap_loss)
            bins.append([(k, int(done[k]), int(take))])
            done[k] += take
    left = tokens - done
    lossy = np.minimum(loss, left)
    shapes, kind = np.unique(left * (1 << 32) + lossy, return_inverse=True)
    t, l = (shapes >> 32).astype(np.int64), (shapes & 0xFFFFFFFF).astype(np.int64)
    stacks: list[list[int]] = [[] for _ in shapes]
    for k in range(len(tokens) - 1, -1, -1):
        stacks[kind[k]].append(k)
    count = np.array([len(s) for s in stacks], np.int64)
    weights = np.array([left.mean() / cap, 1.0 / most, lossy.mean() / cap_loss]) if len(tokens) else np.zeros(3)
    remaining = len(tokens)
    shares_t, shares_l = weights[0] * t / cap, weights[2] * l / cap_loss
    tail: list[tuple[int, int]] = []  # an example cut before, its shape kept apart: (example, tokens left)
    while remaining:
        rest, segments, rest_loss, held = cap, most, cap_loss, []
        if tail:
            k, n = tail.pop()
            whole = min(n, max(n - int(loss[k]), 0) + cap_loss)
            held.append((k, int(tokens[k] - n), whole))
            if whole < n:
                tail.append((k, n - whole))
                bins.append(held)
                continue
            rest, segments, rest_loss, remaining = rest - n, segments - 1, rest_loss - min(n, int(loss[k])), remaining - 1
        while rest and segments and remaining:
            fits = (count > 0) & (t <= rest) & (l <= rest_loss)
            score = np.where(fits, shares_t * (rest / cap) + shares_l * (rest_loss / cap_loss), -1.0)
            best = int(score.argmax())
            if score[best] >= 0:
                k = stacks[best].pop()
                count[best] -= 1
                held.append((k, int(done[k]), int(t[best])))
                rest, segments, rest_loss, remaining = rest - int(t[best]), segments - 1, rest_loss - int(l[best]), remaining - 1
                continue
            longest = int(np.where(count > 0, t, -1).argmax())
            take = min(rest, int(t[longest] - l[longest]) + rest_loss)
            if take <= 0 or take >= t[longest]:
                break
            k = stacks[longest].pop()
            count[longest] -= 1
            held.append((k, int(done[k]), take))
            tail.append((k, int(t[longest]) - take))
            break
        bins.append(held)
    return bins


def _schema(id_type: str) -> str:
    return f"id {id_type}, start long, length long, ids binary, example_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(
    df: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", prompt: str | None = None,
    max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, end_id: int = 1,
) -> DataFrame:
    """Pack tokenised examples into sequences under limits on tokens, segments and loss-bearing tokens.

    An example is the optional ``prompt`` (no loss) followed by ``text`` and the end id (both with loss). Each
    partition packs its own examples, block by block, and hands the unfilled last sequence on to its next block: no
    shuffle, and one padded sequence per partition at most. Sequence ids hold the partition's number above bit 32.

    Returns one row per piece: ``id``, ``start`` (the example's ids before it), ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``example_tokens``, ``sequence_id``, ``offset`` (in the sequence), ``loss_tokens``. Null text
    counts as empty, null ids stay null, repeated rows are packed as often as they occur, an empty table gives no
    row, very long texts are cut over sequences, other columns are ignored.
    """
    limits = (max_tokens, max_segments, max_loss or max_tokens)
    id_type = dict(df.dtypes)[id_column]
    columns = [F.col(id_column).alias("id"), *([F.col(prompt).alias("prompt")] if prompt else []), F.col(text).alias("text")]

    def run(batches: Iterator[pa.RecordBatch]):
        model = encoder(vocabulary, end_id)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.RecordBatch, int, np.ndarray, int, int]] = []  # id row, its ids, first token that is not placed yet, loss
        size = 0

        def emit(last: bool):
            nonlocal number, held, size
            tokens = np.array([len(r[2]) - r[3] for r in held], np.int64)
            loss = np.minimum(np.array([r[4] for r in held], np.int64), tokens)
            bins = place(tokens, loss, limits)
            keep: list = []
            if not last and bins and sum(p[2] for p in bins[-1]) < limits[0]:
                # every piece of the last sequence reaches its example's end
                keep = [(*held[k][:3], held[k][3] + start, held[k][4]) for k, start, _ in bins.pop()]
            out: list[tuple] = []
            for pieces in bins:
                offset = 0
                for k, start, n in pieces:
                    row = held[k]
                    begin = row[3] + start
                    bare = len(row[2]) - row[4]
                    out.append((row[0], row[1], begin, n, row[2][begin : begin + n].tobytes(), len(row[2]), number, offset, begin + n - max(begin, min(bare, begin + n))))
                    offset += n
                number += 1
            held, size = keep, sum(len(r[2]) - r[3] for r in keep)
            if not out:
                return None
            ids = pa.array([c[0][c[1]] for c in out], type=kind)
            rest = list(zip(*[c[2:] for c in out]))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["id", "start", "length", "ids", "example_tokens", "sequence_id", "offset", "loss_tokens"]
            return pa.RecordBatch.from_arrays([ids, *[pa.array(v, type=ty) for v, ty in zip(rest, types)]], names=names)

        kind = pa.int64()
        for batch, data, cuts in blocks(batches, "text", RUN_BYTES):
            column = batch.column(0)
            kind, names = column.type, column.to_pylist()
            ids, starts = model.encode(data, cuts)
            before = None
            if prompt:
                from driftwatch.llm.common import text_array

                before = model.encode(*text_array(batch.column(1)))
            for k in range(batch.num_rows):
                own = ids[starts[k] : starts[k + 1]]
                if before is not None:  # the prompt's own end id is left out
                    head = before[0][before[1][k] : before[1][k + 1] - 1]
                    held.append((names, k, np.concatenate([head, own]), 0, len(own)))
                else:
                    held.append((names, k, own, 0, len(own)))
                size += len(held[-1][2])
                if len(held) >= BLOCK_EXAMPLES or size >= BLOCK_TOKENS:
                    if (out := emit(False)) is not None:
                        yield out
        while held:
            if (out := emit(True)) is not None:
                yield out
        model.clear()
        give_back()

    return df.select(*columns).mapInArrow(run, _schema(id_type))
