"""Upper levels of the cover tree: chunks of a label whose points crowd together, and what is pruned."""

import numpy as np

from edulens.llm import embeddings

POINTS = "label string, cid long, n long, unit array<double>"


def units(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dense_cell_is_split_to_chunks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(1)
    crowd = np.array([1.0, 0, 0, 0]) + rng.normal(0, 0.01, (480, 4))
    x = units(np.concatenate([crowd, rng.normal(0, 1, (60, 4))]))
    points = spark.createDataFrame([("a", i, 1, v.tolist()) for i, v in enumerate(x)], POINTS)
    chunks, pairs = embeddings.chunk_pairs(points, 0.93)
    size = chunks.groupBy("cell").count().toPandas()
    assert size["count"].sum() == 540 and chunks.select("cid").distinct().count() == 540
    assert size["count"].max() <= 3 * embeddings.CHUNK
    cell = {r.cid: r.cell for r in chunks.collect()}
    asked = {(r.a, r.b) for r in pairs.collect()}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert {tuple(sorted((cell[a], cell[b]))) for a, b in zip(i, j)} <= asked


def test_far_clusters_are_pruned_above_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 20)
    rng = np.random.default_rng(2)
    x = units(np.repeat(np.eye(12), 25, axis=0) + rng.normal(0, 0.02, (300, 12)))
    points = spark.createDataFrame([("a", i, 1, v.tolist()) for i, v in enumerate(x)], POINTS)
    chunks, pairs = embeddings.chunk_pairs(points, 0.93)
    cells = chunks.select("cell").distinct().count()
    assert pairs.count() < 0.5 * cells * (cells + 1) / 2
    got = embeddings.embedding_links(points, 0.93).groupBy("cid").sum("links").toPandas().set_index("cid")["sum(links)"]
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert (got.reindex(range(300), fill_value=0).to_numpy() == want).all()
