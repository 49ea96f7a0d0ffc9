"""Virtual slots against a plain version: sizes, checksums, the edited map and places."""

import hashlib
import zlib

import numpy as np
import pytest

from bookflow.llm import sharding
from tests.llm.test_texts import docs, empty, texts  # noqa: F401


def plain(rows, n_shards, n_slots):
    """(doc_id, size, crc, shard, place) of every row, by loops."""
    sized = []
    for i, t in rows:
        raw = (t or "").encode()
        key = str(i) if i is not None else "text:" + (t or "")
        sized.append((i, len(raw) + 16, zlib.crc32(raw), int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % n_slots))
    held = {}
    for _, size, _, slot in sized:
        held[slot] = held.get(slot, 0) + size
    mean = sum(held.values()) / n_shards
    shard_of, load, moving = {}, [0] * n_shards, []
    for s in range(n_shards):
        run = 0
        for slot in sorted((x for x in held if x % n_shards == s), key=lambda x: (-held[x], x)):
            run += held[slot]
            if run <= mean:
                shard_of[slot], load[s] = s, load[s] + held[slot]
            else:
                moving.append(slot)
    for slot in sorted(moving, key=lambda x: (-held[x], x)):
        s = load.index(min(load))
        shard_of[slot], load[s] = s, load[s] + held[slot]
    out, places = [], [0] * n_shards
    for i, size, crc, slot in sorted(sized, key=lambda r: (r[3], r[0] is None, r[0] or 0, r[2], r[1])):
        s = shard_of[slot]
        out.append((i, size, crc, s, places[s]))
        places[s] += 1
    return out


@pytest.mark.parametrize(("n_shards", "n_slots"), [(5, 64), (40, 8192), (3, 4)])
def test_rows_equal_a_plain_version(docs, n_shards, n_slots):  # noqa: F811
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs, n_shards, n_slots)[0].collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(texts(), n_shards, n_slots)))


def test_clashing_columns_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(k // 2, "same" if k % 5 else "x" * int(rng.integers(0, 90)), 1, 2, 3.0) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int, size double").repartition(7)
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(df, 4, 32)[0].collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain([r[:2] for r in rows], 4, 32)))
