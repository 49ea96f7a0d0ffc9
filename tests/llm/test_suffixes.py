"""Dealing of strips: constant size of packed rows, hot anchors, and null ids."""

import hashlib

import numpy as np

import pyarrow as pa
import pytest

from bookflow.llm import suffixes


def test_packed_bytes_do_not_grow_with_buckets():
    rng = np.random.default_rng(0)
    n = 200_000
    key, spread, doc = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 32, n).astype(np.uint32), np.sort(rng.integers(0, 6000, n))
    size = {b: sum(sum(len(x) for x in r[2:]) + 12 for r in suffixes.packed_rows(key, key[::-1], spread, doc, b, np.zeros(0, np.uint64))) for b in (24, 2680)}
    assert abs(size[2680] / size[24] - 1) < 0.1


def brute(data):
    out = {}
    for key, raw in data:
        seen = {o[k : k + 50] for other, o in data if other < key for k in range(len(o) - 49)}
        cover = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                cover[k : k + 50] = b"\1" * 50
        out[key] = hashlib.sha256(bytes(c for c, v in zip(raw, cover, strict=True) if not v)).hexdigest()
    return out


def test_hot_anchors_give_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghij klmnop"))
    passage = "".join(rng.choice(letters, 130))
    # the passage is followed by one of few continuations, so strips at its edge are shared in part
    tails = ["".join(rng.choice(letters, 40)) for _ in range(5)]
    data = [(k, ("".join(rng.choice(letters, 30)) + passage + tails[k % 5][: 5 + k % 30] + "".join(rng.choice(letters, 30))).encode()) for k in range(90)]
    df = spark.createDataFrame([(k, t.decode()) for k, t in data], "doc_id long, text string").repartition(4)
    plain = {r["doc_id"]: r["kept_sha256"] for r in suffixes.dedup(df, keep_text=False).collect()}
    monkeypatch.setattr(suffixes, "HOT_STRIPS", 8)
    monkeypatch.setattr(suffixes, "GATHERED", 50)
    source = df.selectExpr("doc_id", "doc_id as doc", "text")
    assert len(suffixes.hot_anchors(source, sum(len(t) for _, t in data)))
    hot = {r["doc_id"]: r["kept_sha256"] for r in suffixes.dedup(df, keep_text=False).collect()}
    assert plain == hot == brute(data)


def test_null_ids_do_not_share_a_document(spark):
    text, other = "x y z " * 20, "nothing of the others " * 4
    df = spark.createDataFrame([(1, "start"), (None, text + "a"), (None, text + "b"), (None, other)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = suffixes.dedup(df).collect()
    assert sorted(r["n_removed"] > 0 for r in got) == [False, False, False, True] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def by_plain_calls(data, hot, buckets=3):
    """The steps of `dedup` called one by one in this process, so that a test can change what they call."""

    def grouped(batches, column):
        table = pa.Table.from_batches(batches)
        return [table.filter(pa.compute.equal(table[column], v)) for v in table[column].unique()]

    source = pa.RecordBatch.from_pydict({"doc": [k for k, _ in data], "text": pa.array([t.decode() for _, t in data])})
    halves = [source.slice(0, len(data) // 2), source.slice(len(data) // 2)]
    packed = [b for h in halves for b in suffixes._packer(buckets, hot)(iter([h]))]
    told = {k: ([], []) for k, _ in data}
    for replies in (suffixes._meeting(hot)(t) for t in grouped(packed, "bucket")):
        for r in replies.to_pylist():
            told[r["doc"]][0].append(r["full"])
            told[r["doc"]][1].append(r["part"])
    asked = source.append_column("part", pa.array([told[k][1] for k, _ in data], pa.list_(pa.binary())))
    sent = list(suffixes._sender(buckets, hot)(iter([asked])))
    spans = {k: [] for k, _ in data}
    for found in (suffixes._factors(t.combine_chunks()) for t in grouped(sent, "bucket")):
        for r in found.to_pylist():
            spans[r["doc"]].append({"a": r["a"], "z": r["z"]})
    rows = pa.RecordBatch.from_pydict({"doc_id": source["doc"], "text": source["text"], "full": [told[k][0] for k, _ in data], "spans": [spans[k] for k, _ in data]})
    return {r["doc_id"]: r["kept_sha256"] for b in suffixes._cutter(False)(iter([rows])) for r in b.to_pylist()}


@pytest.mark.parametrize("all_hot", [False, True])
def test_equal_first_halves_of_keys_remove_nothing(monkeypatch, all_hot):
    """All strips of an anchor, and all suffixes of hot anchors, are given one first half: the second one tells them apart."""
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghij klmnop"))
    passage = "".join(rng.choice(letters, 90))
    data = [(k, ("".join(rng.choice(letters, 60)) + passage + "".join(rng.choice(letters, 60))).encode()) for k in range(40)] + [(40, passage.encode() * 2), (41, b"short")]
    monkeypatch.setattr(suffixes, "strip_key", lambda mark, strip: mark << np.uint64(suffixes.STRIP_BITS))
    batch = pa.array([t.decode() for _, t in data])
    every = np.unique(np.concatenate([suffixes.anchor_of(s.key, s.spread) for _, s in suffixes.batch_strips(*suffixes.text_bytes(batch))]))
    plain = suffixes.RangeHash.of
    monkeypatch.setattr(suffixes.RangeHash, "of", lambda self, a, z: np.zeros(len(a), np.uint64) if all_hot and (z - a == suffixes.LENGTH).all() and not self.second else plain(self, a, z))
    assert by_plain_calls(data, every if all_hot else every[:0]) == brute(data)
