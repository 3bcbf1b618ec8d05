"""Which rules can match a text, by the literals that their matches must hold.

All literals are looked for in one pass over the bytes of many texts, however many literals there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are searched at once (a longer text stands alone), and the bytes of a literal that are looked up.
RUN_BYTES, LEAD = 1 << 20, 4


def _places(values: np.ndarray) -> np.ndarray:
    return (values * np.uint32(2654435761)) >> np.uint32(16)


def found(data: np.ndarray, cuts: np.ndarray, literals: list[bytes]) -> np.ndarray:
    """For each text (``data`` holds them, ``cuts`` their offsets) and literal whether the literal stands in it."""
    out = np.zeros((len(cuts) - 1, len(literals)), bool)
    n = len(data)
    windows = np.zeros(n, np.uint32)
    for k in range(min(LEAD, n)):
        windows[: n - k] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    for width in range(1, LEAD + 1):
        members = [k for k, x in enumerate(literals) if min(len(x), LEAD) == width]
        leads = np.array([int.from_bytes(literals[k][:width], "little") for k in members], np.uint32)
        known = np.zeros(1 << 16, bool)
        known[_places(leads)] = True
        values = windows & np.uint32((1 << 8 * width) - 1)
        at = np.flatnonzero(known[_places(values)])
        at = at[np.argsort(values[at], kind="stable")]
        low, high = (np.searchsorted(values[at], leads, side=side) for side in ("left", "right"))
        for k, a, b in zip(members, low.tolist(), high.tolist()):
            here, literal = at[a:b], literals[k]
            text = np.searchsorted(cuts, here, side="right") - 1
            inside = here + len(literal) <= cuts[text + 1]
            here, text = here[inside], text[inside]
            for j in range(width, len(literal)):
                if not len(here):
                    break
                same = data[here + j] == literal[j]
                here, text = here[same], text[same]
            out[text, k] = True
    return out


def candidates(text: Column, needs: list[tuple[int, list[tuple[str, ...]]]]) -> Column:
    """Numbers of those ``needs`` that a text meets, as an array: (number, groups of literals), of each group one at least. Null meets none."""
    literals = sorted({x for _, groups in needs for group in groups for x in group})
    column = {x: k for k, x in enumerate(literals)}
    raw = [x.encode() for x in literals]
    asked = [(number, [[column[x] for x in group] for group in groups]) for number, groups in needs]

    @F.arrow_udf("array<int>")
    def met(texts: pa.Array) -> pa.Array:
        numbers, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        texts, null = texts.fill_null(""), texts.is_null().to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.zeros(0, np.uint8) if texts.buffers()[2] is None else np.frombuffer(texts.buffers()[2], np.uint8)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + RUN_BYTES, side="right")) - 1)
            held = found(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], raw)
            meets = np.ones((high - low, len(asked)), bool)
            for k, (_, groups) in enumerate(asked):
                for group in groups:
                    meets[:, k] &= held[:, group].any(axis=1)
            meets[null[low:high]] = False
            numbers.append(np.array([x for x, _ in asked], np.int32)[np.nonzero(meets)[1]])
            counts.append(meets.sum(axis=1))
            low = high
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(numbers), pa.int32()))

    # evaluated once where it stands: the optimizer would copy it to every rule that reads its result
    return met.asNondeterministic()(text)
