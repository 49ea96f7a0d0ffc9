"""Features of passages counted one by one, for words of any length."""

import numpy as np

from bookflow.llm import quality


def shares(passage: bytes) -> list[float]:
    sets = [set(map(ord, c)) if c else set(range(128, 256)) for c in quality.CLASSES]
    return [sum(b in s for b in passage) / len(passage) for s in sets]


def test_shares_of_letter_classes_for_long_words():
    found = ["Plain words, 12 of them! | #", "a" * (3 << 20), "é" * (2 << 20) + "B", "x" * ((1 << 21) - 1) + " y", ""]
    raw = [t.encode() for t in found]
    x, bounds = quality.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, r in enumerate(raw):
        if r:
            assert bounds[k + 1] - bounds[k] == 1 and np.allclose(x[bounds[k], : len(quality.CLASSES)], shares(r), rtol=1e-5)
    assert not x[bounds[4]].any()
