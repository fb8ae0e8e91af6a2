"""A level that is asked in parts: each part looks only at its own contexts, and together they send what one part sends."""

import random

import numpy as np
import pyarrow as pa

from pagewright.llm import lm
from pagewright.llm.blocks import squeezed


def test_parts_of_a_level_ask_for_their_own_contexts():
    rng = random.Random(5)
    texts = [" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(60)) for _ in range(20)]
    symbols, code, first = lm.block_words(pa.array(texts))
    row = {"symbols": symbols.tobytes(), "code": squeezed(code), "first": squeezed(first), "train": squeezed(np.ones(len(texts), np.uint8))}
    counts = np.bincount(code, minlength=len(symbols))[np.argsort(symbols)]
    for hot in (1 << 22, 50):
        walk = lm.Walk(row, counts, lm.Model(len(texts), len(code) + len(texts), len(symbols) + 1, 4.0, hot))
        sent = lambda *part: [r for b in walk.messages(1, 0, 6, *part) for r in b.to_pylist()]
        assert sorted(sent(0, 2) + sent(1, 2), key=lambda r: r["bucket"]) == sent(0, 1)
    whole = lm.Walk(row, counts, lm.Model(len(texts), len(code) + len(texts), len(symbols) + 1, 4.0, 1 << 22))
    asked = [len(whole.ask(1, 6, part, 2).at) for part in (0, 1)]
    assert sum(asked) == len(whole.ask(1).at) and min(asked) > 0
