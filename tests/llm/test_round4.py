"""Tokenising words many at a time."""

from __future__ import annotations

import numpy as np

from driftwatch.llm import packing
from driftwatch.llm.queries import vocabulary


def test_words_are_tokenised_many_at_a_time_as_whole_texts():
    """Ids of odd words equal those of the whole text, and few texts reach the tokenizer."""
    odd = ["éa", "́x", "क़क़", "a b", "it's", "'s", "ΑΣ", "İx", "x" * 3000, " ", "don't.", "漢字かな", "😀👍🏽", "�", "q̧́", "</s>", "a\u0085b"]
    texts = [" ".join(odd), "", " ".join(reversed(odd)), " ".join(f"w{k}a{k % 97}" for k in range(20_000))]
    raw = [t.encode() for t in texts]
    data, cuts = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    model = packing.Encoder(vocabulary(), 1)
    seen = []

    class Counting:
        def __getattr__(self, name):
            def call(batch, **options):
                seen.extend(batch)
                return getattr(plain, name)(batch, **options)

            return call

    plain, model.model = model.model, Counting()
    ids, starts = model.encode(data, cuts)
    for text, a, b in zip(texts, starts, starts[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
    assert len(seen) < 200
