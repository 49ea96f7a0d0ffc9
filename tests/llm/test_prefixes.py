"""The prefix trie against a plain trie over all rebuilt conversations."""

import hashlib
import zlib

import numpy as np

from bookflow.llm import prefixes

FIELDS = "conv_id long, turn long, role string, text string, family int, key string"


def plain(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in sorted(found)] for c, found in held.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = sum(not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in nodes) for p in under)
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in under)
        ends = ",".join(str(c) for c in sorted(c for c in members if rebuilt[c] == path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], FIELDS).repartition(3)


def found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def test_trie_matches_a_plain_one(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in [*range(0, 40), *range(101, 104), 7_000_000_001]:
        for turn in range(int(rng.integers(1, 7))):
            rows.append((c, turn, str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "bé", "ccc"]))))
    rows += [(c, t, "user", "the same first turn" if t == 0 else "and the same second one") for c in range(200, 260) for t in (0, 1)]
    rows += [(300, None, "user", "null first"), (300, 0, None, None), (301, 0, "user", None), (301, 0, "user", None), (302, 1, "b", "tie"), (302, 1, "a", "tie"), (None, 0, "user", "no conversation")]
    rows += [(400, t, "user", f"long {t}") for t in range(150)] + [(401, 0, "user", "y" * 100_000)]
    assert found(prefixes.trie(frame(spark, rows))) == plain(rows)


def test_small_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "ID_BLOCK", 7)
    rows = [(c, 0, "user", "one text for all") for c in range(0, 500, 3)]
    assert found(prefixes.trie(frame(spark, rows))) == plain(rows)


def test_empty_table_and_null_ids(spark):
    assert found(prefixes.trie(spark.createDataFrame([], FIELDS))) == []
    assert found(prefixes.trie(frame(spark, [(None, 0, "user", "x")]))) == []
