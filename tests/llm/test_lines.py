"""Line dedup against all pairs of lines, with variants that very many lines share."""

import numpy as np
import pytest

from bookflow.llm import lines


def brute(docs):
    """Removed line numbers of each document by comparing every distinct line with every earlier one."""
    every = [(d, k, tuple(lines.split_line(x))) for d, t in sorted(docs) for k, x in enumerate((t[:-1] if t.endswith("\n") else t).split("\n") if t else [])]
    first = {}
    for d, k, w in every:
        first.setdefault(w, (d, k))
    near = {w for w in first if w and any(v and first[v] < first[w] and max(len(v), len(w)) >= lines.LEAST and lines.word_distance_is_one(list(v), list(w)) for v in first)}
    out = {d: [] for d, _ in docs}
    for d, k, w in every:
        if w and (w in near or first[w] != (d, k)):
            out[d].append(k)
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_hot_variants_equal_all_pairs(spark, batch):
    rng = np.random.default_rng(6)
    words = "red green blue cyan pink grey".split()
    docs = []
    for d in range(40):
        own = [f"user {rng.integers(30)} logged in from the office", f"user logged in from the office {'x' * int(rng.integers(4))}".strip()]
        own += [" ".join(rng.choice(words, int(rng.integers(4, 7)))) for _ in range(4)]
        docs.append((d, "\n".join(rng.permutation(own)) + ("\n" if d % 2 else "")))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r["doc_id"]: r["removed"] for r in lines.dedup_lines(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute(docs)


def test_null_ids_are_told_apart_by_their_texts(spark):
    df = spark.createDataFrame([(1, "one two three four five"), (None, "one two three four six"), (None, "other words here"), (None, "other words here"), (None, None)], "doc_id long, text string")
    got = sorted((r["n_lines"], r["n_removed"], r["n_near"]) for r in lines.dedup_lines(df).filter("doc_id is null").collect())
    assert got == [(0, 0, 0), (1, 1, 1), (2, 0, 0)]
