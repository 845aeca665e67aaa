"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios (Wang & Manning 2012).

Features are hashed n-grams of ORDERS code points with A-Z lowered, present or absent. The fit takes at most `rows`
labelled texts (those of least hash of their id, a documented bound), written once in PARTS parts. Each part counts its
features; the counts, 2**BITS of each label, are summed and become log-count ratios; the features whose ratio is clear
of its standard error are kept, and each part finds those in its texts. One task then fits a logistic regression on the
scaled features, a toxic text weighing as much as WEIGHT clean ones: it holds the kept features of at most `rows` texts, no text. The weights, 2**BITS floats whatever the corpus, are sent to all tasks, which score whole texts.

Defined cases: null and empty texts score the intercept; very long texts are scored whole, in blocks of their own;
labels that are null or not 0/1 are left out; of several labels of a document the larger one counts; every row of a
repeated document is a text of the fit; repeated rows get equal scores; a score of exactly 0.5 is predicted toxic; other columns of docs are ignored, whatever
their names; with no label of either class every text scores the share of toxic labels, one half without labels; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .runtime import cut

ORDERS, BITS = (4, 5, 6, 7, 8), 20
#: Bound on the labelled texts of a fit, least texts with a feature, least distance of its ratio from 0 in standard errors.
ROWS, LEAST, CLEAR = 16000, 3, 2.75
#: Weight of a toxic text of the fit beside a clean one's.
WEIGHT = 2.0
RIDGE, STEPS = 1e-4, 200
#: Parts of the sample, each a task of the fit.
PARTS = 16
#: Texts at a time in a step of the fit.
PIECE = 500
#: Bytes of text at a time: what fits a core's cache takes half the time of larger blocks.
CACHED = 256 << 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def features(b: B.Block, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every n-gram that is present (each once); keep marks the wanted features."""
    low = _LOWER[b.data[: b.size]]
    points = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    ends = lead[b.offsets]
    row = np.repeat(np.arange(len(b.offsets) - 1, dtype=np.int32), np.diff(ends))
    found = []
    h, width = points.copy(), 1
    for n in range(2, max(ORDERS) + 1):
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in ORDERS and len(h):
            x = h * np.uint32(0x9E3779B1) + np.uint32(n)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            x >>= np.uint32(32 - BITS)
            ok = row[: len(x)] == row[n - 1 :]
            if keep is not None:
                ok &= keep[x]
            at = np.flatnonzero(ok)
            found.append((row[at].astype(np.int64) << BITS) | x[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def count(parts) -> tuple[np.ndarray, int]:
    """How many clean and toxic texts have each feature, and the number of toxic ones, from pairs of a block and its labels."""
    counts, toxic = np.zeros((2, 1 << BITS), np.int32), 0
    for b, label in parts:
        row, col = features(b)
        for k in (0, 1):
            counts[k] += np.bincount(col[label[row] == k], minlength=1 << BITS).astype(np.int32)
        toxic += int(label.sum())
    return counts, toxic


def ratios(counts: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log-count ratio of each feature, 0 where it isn't clear of its standard error."""
    good, bad = counts + 1.0
    ratio = np.log(bad / (n_toxic + 2)) - np.log(good / (n_clean + 2))
    return np.where((counts.sum(0) >= LEAST) & (np.abs(ratio) > CLEAR * np.sqrt(1 / bad + 1 / good)), ratio, 0.0)


def intercept(y: np.ndarray) -> float:
    share = (y.sum() + 0.5) / (len(y) + 1)
    return float(np.log(share / (1 - share)))


def fit(y: np.ndarray, each: np.ndarray, col: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (ratio times coefficient) and intercept, from labels, the number of features of each text, and these (int32), text by text.

    Steps go through PIECE texts at a time, so beside the features themselves memory is bounded.
    """
    weights, c = np.zeros(1 << BITS, np.float32), intercept(y)
    used = np.zeros(1 << BITS, bool)
    used[col] = True
    kept = np.flatnonzero(used)
    if not 0 < y.sum() < len(y) or not len(kept):
        return weights, c
    f = (np.cumsum(used, dtype=np.int32) - 1)[col]
    ends, r = np.concatenate([[0], np.cumsum(each)]), ratio[kept]
    w, m, v = np.zeros(len(kept)), 0.0, 0.0
    weight = np.where(y == 1, WEIGHT, 1.0) / len(y)
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        g, gc, scaled = RIDGE * w, 0.0, r * w
        for i in range(0, len(y), PIECE):
            n, part = each[i : i + PIECE], f[ends[i] : ends[min(i + PIECE, len(y))]]
            of = np.repeat(np.arange(len(n)), n)
            off = (1 / (1 + np.exp(-np.clip(np.bincount(of, scaled[part], len(n)) + c, -30, 30))) - y[i : i + PIECE]) * weight[i : i + PIECE]
            g += r * np.bincount(part, off[of], len(w))
            gc += off.sum()
        g = np.append(g, gc)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, c = w - move[:-1], c - move[-1]
    weights[kept] = r * w
    return weights, float(c)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[np.ndarray, float]:
    """The model from labels(doc_id, toxic) of docs(doc_id, text)."""
    chosen = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = cut(found.repartition(PARTS, "doc_id").select("toxic", F.coalesce("text", F.lit(b"")).alias("text")), "toxicity-texts")
    labelled = lambda batches, size=1 << 20: ((b, b.ids.to_numpy().astype(float)) for b in B.read_blocks(batches, size))

    def counts(batches):
        size, table, toxic = 0, np.zeros((2, 1 << BITS), np.int32), 0
        for part in labelled(batches):
            more, bad = count([part])
            table, toxic, size = table + more, toxic + bad, size + len(part[1])
        yield pa.record_batch([[B.numbers(table)], [size], [toxic]], names=["counts", "n", "n_toxic"])

    def add(batches):
        table, n, toxic = np.zeros((2, 1 << BITS), np.int64), 0, 0
        for batch in batches:
            for blob, size, bad in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                table += np.frombuffer(B.spread(blob), np.int32).reshape(2, -1)
                n, toxic = n + size, toxic + bad
        yield pa.record_batch([[B.numbers(ratios(table, n - toxic, toxic))]], names=["ratio"])

    tables = cut(texts.mapInArrow(counts, "counts binary, n long, n_toxic long"), "toxicity-counts")
    told = cut(tables.coalesce(1).mapInArrow(add, "ratio binary"), "toxicity-ratios").first()
    nothing = np.zeros(1 << BITS, np.float32), intercept(np.zeros(0))
    if told is None:  # no labelled text, hence no task
        return nothing
    sent = docs.sparkSession.sparkContext.broadcast(told["ratio"])

    def find(batches):
        keep = np.frombuffer(B.spread(sent.value), np.float64) != 0
        for b, label in labelled(batches, CACHED):
            row, col = features(b, keep)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(label)))])
            digest = [hashlib.sha1(b.data[i:j].tobytes()).digest() for i, j in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(label.astype(np.int32)), pa.array(digest, pa.binary()), pa.array([col[i:j].astype(np.int32).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["toxic", "digest", "features"])

    def solve(batches):
        y, each, cols = [np.zeros(0)], [np.zeros(0, int)], [np.zeros(0, np.int32)]
        for batch in batches:
            y.append(batch.column(0).to_numpy().astype(float))
            cols += [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            each.append(np.array([len(x) // 4 for x in batch.column(2).to_pylist()]))
        y, each = np.concatenate(y), np.concatenate(each)
        weights, c = fit(y, each, np.concatenate(cols), np.frombuffer(B.spread(sent.value), np.float64))
        yield pa.record_batch([[B.numbers(weights)], [c]], names=["weights", "intercept"])

    sparse = texts.mapInArrow(find, "toxic int, digest binary, features binary").repartition(1).sortWithinPartitions("toxic", "digest")
    model = cut(sparse.mapInArrow(solve, "weights binary, intercept double"), "toxicity-model").first()
    return (np.frombuffer(B.spread(model["weights"]), np.float32), model["intercept"]) if model else nothing


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Each row of docs(doc_id, text) with its score."""
    sent = docs.sparkSession.sparkContext.broadcast((B.numbers(model[0]), model[1]))

    def run(batches):
        weights, intercept = np.frombuffer(B.spread(sent.value[0]), np.float32), sent.value[1]
        keep = weights != 0
        for b in B.read_blocks(batches, CACHED):
            row, col = features(b, keep)
            z = np.bincount(row, weights[col], len(b.ids)) + intercept
            yield pa.record_batch([b.ids, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return B.scan(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; labels of held-out rows aren't read."""
    model = train(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
