"""Components of chains and the identity of rows that share an id."""

import numpy as np
import pytest

from bookflow.llm import graph, near_dups


def test_long_chains_take_few_rounds(spark, monkeypatch):
    written = []
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(name) or real(df, name))
    links = spark.range(1000).selectExpr("id as a", "id + 1 as b")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == dict.fromkeys(range(1001), 0) and len(written) <= 25


def test_components_match_union_find(spark):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))]
    label = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def shared(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    return spark.createDataFrame([(3, b, "x"), (5, a, "x"), (5, b + " x", "x"), (9, a + " y", "x"), (None, a, "x"), (None, "some other words of no one else", "x")], "doc_id long, text string, text_hash string")


def test_rows_that_share_an_id_keep_their_own_groups(shared):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dups.near_duplicates(shared.filter("doc_id is not null")).collect()}
    assert got == {(3, 56): (3, True), (5, 56): (5, True), (5, 57): (3, False), (9, 57): (5, False)}


def test_rows_are_removed_not_ids(shared):
    got = near_dups.first_of_each(shared)
    assert got.columns == shared.columns
    assert {(r["doc_id"], r["text"][:2]) for r in got.collect()} == {(3, "b0"), (5, "a0"), (None, "so")}
