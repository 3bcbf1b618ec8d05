"""Memory of the pipeline's Python workers."""

from __future__ import annotations

import tracemalloc

import numpy as np

from driftwatch.llm import packing, toxicity
from driftwatch.llm.queries import vocabulary


def test_words_are_counted_in_parts_of_bounded_memory():
    def texts():
        rng = np.random.default_rng(3)
        for k in range(3000):
            yield np.unique(rng.integers(0, 50_000, 1000).astype(np.uint64)), int(k % 7 == 0)
        yield np.arange(5, dtype=np.uint64), 1
        yield np.arange(5, dtype=np.uint64), 1  # a copy counts once

    def sums(parts):
        n, toxic = np.zeros(50_000, np.int64), np.zeros(50_000, np.int64)
        for part in parts:
            word = part["word"].to_numpy()
            assert len(np.unique(word)) == len(word)
            n[word] += part["n"].to_numpy()
            toxic[word] += part["toxic"].to_numpy()
        return n, toxic

    once = sums(toxicity.word_counts(texts(), each=1 << 40))
    tracemalloc.start()
    parts = sums(toxicity.word_counts(texts()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(once, parts))
    assert once[0].sum() == sum(len(w) for w, _ in texts()) - 5
    assert peak < 50e6  # all at once: over 100 MB


def test_new_words_are_tokenised_in_groups(monkeypatch):
    words = [f"w{k:x}q{k * k:x}" for k in range(10_000)]
    raw = " ".join(words).encode()
    sizes, own = [], packing.Encoder._tokenise
    monkeypatch.setattr(packing.Encoder, "_tokenise", lambda self, texts: sizes.append(len(texts)) or own(self, texts))
    model = packing.Encoder(vocabulary(), 1)
    ids, starts = model.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert sum(sizes) == len(words) and max(sizes) <= 4096
    assert ids.tolist() == [*model.model.encode(raw.decode(), add_special_tokens=False).ids, 1] and starts.tolist() == [0, len(ids)]
