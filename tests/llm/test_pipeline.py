"""The pipeline against a plain version of its stages."""

import hashlib
from itertools import combinations

import numpy as np

import corpus_pipeline
from bookflow.llm import mixing, quality
from tests.llm.test_texts import prose, shingles


def mixed_plainly(rows, keep):
    """Raking by loops over cells, then the same fixed draws."""
    tokens = {i: len(t.replace("\n", " ").split(" ")) for i, t, _, _ in rows}
    topic = {i: next((n for n, m in mixing.TOPIC_MARKS if m in t), "prose") for i, t, _, _ in rows}
    cell = {i: (source, lang, topic[i]) for i, _, lang, source in rows}
    mass = {}
    for i, c in cell.items():
        mass[c] = mass.get(c, 0) + tokens[i]
    seen, total = dict(mass), sum(mass.values())
    goal = []
    for k, d in enumerate(mixing.DIMENSIONS):
        sums = {}
        for c, m in seen.items():
            sums[c[k]] = sums.get(c[k], 0) + m
        power = {v: s ** mixing.TEMPER[d] for v, s in sums.items()}
        goal.append({v: p / sum(power.values()) for v, p in power.items()})
    mass = {c: m * keep for c, m in seen.items()}
    for _ in range(mixing.ROUNDS):
        for k in range(3):
            sums = {}
            for c, m in mass.items():
                sums[c[k]] = sums.get(c[k], 0) + m
            mass = {c: min(seen[c], m * goal[k][c[k]] * total * keep / sums[c[k]]) for c, m in mass.items()}
    draw = {i: int(hashlib.md5(f"{i}:17".encode()).hexdigest()[:8], 16) / 2**32 for i in cell}
    return {i for i, c in cell.items() if draw[i] < mass[c] / seen[c]}


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, prose(1000 + k, int(rng.integers(30, 120))), ("en", "de")[k % 3 == 0], f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, "good start here " + "spam " * 150, "en", "s0") for k in range(12)]
    rows += [(200 + k, rows[5][1], "en", "s1") for k in range(3)] + [(210, rows[5][1] + " more", "en", "s2")]
    item = " ".join(f"quest{k}" for k in range(20))
    rows += [(300, rows[7][1] + " " + item + " " + prose(5, 20), "en", "s1")]
    spark.createDataFrame([(i, t, lang, source, len(t)) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("spam" not in t), 0) for i, t, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    raw = [t.encode() for _, t, _, _ in rows]
    score = model.scores(*quality.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]))
    left = [r for r, s in zip(rows, score, strict=True) if s >= 0.3]
    assert {r[0] for r in left} == {r[0] for r in rows if "spam" not in r[1]}
    sets = {i: shingles(t, 5) for i, t, _, _ in left}
    gone = {max(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert gone == {200, 201, 202, 210}
    left = [r for r in left if r[0] not in gone and item not in r[1]]
    assert set(got.doc_id) == mixed_plainly(left, corpus_pipeline.MIX_KEEP)
    size = {i: len(t.encode()) + 16 for i, t, _, _ in left}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == {i: size[i] for i in got.doc_id}
    assert got.shard.between(0, 39).all()


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
