"""Vectors of texts against a singular value decomposition of the whole matrix."""

from collections import Counter

import numpy as np

from quillmark.operators import vectors


def corpus():
    rng = np.random.default_rng(4)
    topics = [[f"{a}{b}" for b in "abcdefghijkl"] for a in ("sea", "rock", "leaf", "coin")]
    return [" ".join(rng.choice(topics[i % 4], 25)) + " " + " ".join(rng.choice(topics[(i + 1) % 4], 3)) + " the and of" * 3 for i in range(60)]


def matrix(texts):
    found = [Counter(t.split()) for t in texts]
    terms = sorted({w for c in found for w in c})
    whole = sum(sum(c.values()) for c in found)
    share = {w: sum(c[w] for c in found) / whole for w in terms}
    kept = [w for w in terms if sum(w in c for c in found) >= 2]
    return np.array([[max(0.0, np.log(c[w] / sum(c.values()) / share[w])) if c[w] else 0.0 for w in kept] for c in found]), kept


def test_subspace_and_similarities_are_those_of_the_exact_decomposition(spark, tmp_path):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)

    def cut(frame, name):
        frame.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    table = cut(vectors.learn(docs, ("doc_id",), cut, dimensions=4, rounds=2), "table")
    a, kept = matrix(texts)
    _, sizes, axes = np.linalg.svd(a, full_matrices=False)
    told = {r["term"]: r["v"] for r in table.collect()}
    v = np.array([told.get(w, [0.0] * 4) for w in kept])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-6)
    angles = np.linalg.svd(axes[:4] @ v)[1]
    assert angles.min() > 0.99
    got = {r["doc_id"]: r["vector"] for r in vectors.embed(docs, table, ("doc_id",)).collect()}
    rows = np.array([got[i] for i in range(len(texts))])
    assert np.allclose(rows, a @ v) and np.linalg.norm(rows) > 0.99 * np.sqrt((sizes[:4] ** 2).sum())
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    alike = unit @ unit.T
    same = np.equal.outer(np.arange(60) % 4, np.arange(60) % 4)
    assert alike[same].min() > alike[~same].max()


def test_empty_texts_and_tables(spark):
    docs = spark.createDataFrame([(1, "sun moon sun"), (2, "sun moon"), (3, None), (4, ""), (5, "unknown")], "doc_id int, text string")
    table = vectors.learn(docs, ("doc_id",), dimensions=2)
    got = {r["doc_id"]: r["vector"] for r in vectors.embed(docs, table, ("doc_id",)).collect()}
    assert len(got) == 5 and got[3] == got[4] == got[5] == [0.0, 0.0]
    assert vectors.embed(docs.limit(0), table, ("doc_id",)).collect() == []
