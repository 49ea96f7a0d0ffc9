"""Periodic runs of words against a version that tries every stretch."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from bookflow.llm import kernels, periods
from tests.llm.test_texts import prose, texts

FIELDS = "doc_id long, text string, runs string, collapsed int, start long"


def plain_runs(words):
    """(start, length, period), by stretches of equal words for every distance."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            z = k
            while z + q < n and words[z] == words[z + q]:
                z += 1
            if z > k and z - k + q >= max(6, 4 * q):
                found.setdefault((k, z - k + q), q)
            k = z + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_texts(seed, count):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        words = []
        while rng.random() < 0.85:
            block = list(rng.choice(list("abc"), rng.integers(1, 7)))
            words += block * int(rng.integers(1, 8)) + list(rng.choice(list("abcde"), rng.integers(0, 5)))
        out.append(" ".join(map(str, words)))
    return out


HARD = ["a " * 5, "a " * 6, "a\n" * 4000, "a b " * 4, "a b " * 3 + "a", "x " + "a b c " * 4 + "a b y", "a a a a a a b " * 5, "é \x0b ü\x1c " * 9, "a b " * 8, "ab " * 7 + "a b " * 7, "w " * 9 + prose(1, 50) + " w" * 9]


def buffer(found):
    raw = [t.encode() for t in found]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_runs_match_every_stretch(monkeypatch, step):
    monkeypatch.setattr(periods, "STEP_PAIRS", step)
    monkeypatch.setattr(periods, "STEP_BYTES", step)
    found = random_texts(3, 150 if step > 7 else 20) + HARD
    data, bounds = buffer(found)
    words, first, counts, runs = periods.runs_of_texts(data, bounds)
    out, ends = periods.collapsed(data, words, first, len(found), runs)
    for k, text in enumerate(found):
        got = [tuple(int(v) for v in r[1:]) for r in runs.T if r[0] == k]
        want = plain_runs(words_of(text))
        assert got == want and counts[k] == len(words_of(text)), text
        assert out[ends[k] : ends[k + 1]].tobytes().decode() == plain_collapsed(words_of(text), want)


def test_words_with_one_hash_are_told_apart(monkeypatch):
    """Every word gets the same hash: the runs it makes don't survive the bytes, and words are numbered."""
    monkeypatch.setattr(periods, "word_keys", lambda data, start, end: np.zeros(len(start), np.uint64))
    data, bounds = buffer(HARD)
    _, _, _, runs = periods.runs_of_texts(data, bounds)
    for k, text in enumerate(HARD):
        assert [tuple(int(v) for v in r[1:]) for r in runs.T if r[0] == k] == plain_runs(words_of(text))


def test_long_text_of_one_word():
    data, bounds = buffer(["z " * 200_000])
    _, _, _, runs = periods.runs_of_texts(data, bounds)
    assert runs[1:].tolist() == [[0], [200_000], [1]] and kernels.PASS_BYTES > 0


def plain_planted(i, text):
    words = words_of(text)
    if i is None:
        return words
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def test_query_matches_plain_version(spark):
    rows = texts() + [(100 + k, t) for k, t in enumerate(random_texts(8, 60) + HARD)] + [(1000 + k, prose(k, 40)) for k in range(60)] + [(7, "a b " * 9), (7, "a b " * 9)]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], FIELDS).repartition(3)
    want = []
    for i, t in rows:
        words = plain_planted(i, t)
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapsed(words, runs))))
    got = [tuple(r) for r in periods.summary(periods.periodic_runs(periods.planted(docs))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(w[1] > 0 for w in want) > 60
    assert periods.periodic_runs(spark.createDataFrame([], FIELDS)).collect() == []
