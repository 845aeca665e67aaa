"""Comparison methods: TF-IDF adjacency and silhouette."""

from __future__ import annotations

from collections import Counter
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FUNCTION_WORDS
from ..functions import text as T
from . import sources

BOUNDARY, MAX_TERMS = 0.15, 500
#: Square of a distance, as a share of the squares of both lengths, under which it is taken from the differences.
NEAR = 1e-4


def _similar(texts: list[list[str]], max_terms: int) -> list[tuple[int, float]]:
    """(position, similarity) of each text of a document, from 1, and the next one that has a common term."""
    counts = [Counter(t) for t in texts]
    spread, total = Counter(w for c in counts for w in c), Counter()
    for c in counts:
        total.update(c)
    kept = sorted(total, key=lambda w: (-total[w], w))[:max_terms]
    idf = {w: log((1 + len(texts)) / (1 + spread[w])) + 1 for w in kept}
    vectors = []
    for c in counts:
        v = {w: n * idf[w] for w, n in c.items() if w in idf}
        norm = sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    pairs = ((i, [x * b[w] for w, x in a.items() if w in b]) for i, (a, b) in enumerate(zip(vectors[:-1], vectors[1:], strict=True), 1))
    return [(i, sum(p)) for i, p in pairs if p]


def neighbours(paragraphs: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, n, near): of each document the number of its paragraphs of ten words or more, and (position, similarity) of those that share a term with the next one.

    Vectors are unit vectors of term counts times ln((1 + n) / (1 + df)) + 1, within each document, of its max_terms most
    frequent terms. Texts are shuffled once, to their document; its vectors are never rows.
    """
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    kept = paragraphs.filter(T.word_count("text") >= 10).select("doc_id", F.struct("paragraph_index", "text").alias("_p"))
    whole = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list("_p")).alias("_p")).select("doc_id", F.transform("_p", lambda p: words(p["text"])).alias("texts"))
    left_out = frozenset(FUNCTION_WORDS)

    def run(batches):
        near = pa.list_(pa.struct([("position", pa.int32()), ("similarity", pa.float64())]))
        for batch in batches:
            for at in range(0, len(batch), 256):  # documents whose words are Python's at once
                part = batch.slice(at, 256)
                texts = [[[w for w in t if w not in left_out] for t in doc] for doc in part.column(1).to_pylist()]
                found = [[{"position": i, "similarity": s} for i, s in _similar(t, max_terms)] for t in texts]
                yield pa.record_batch([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(found, near)], names=["doc_id", "n", "near"])

    return whole.mapInArrow(run, f"doc_id {dict(paragraphs.dtypes)['doc_id']}, n long, near array<struct<position:int,similarity:double>>")


def adjacent(near: DataFrame) -> DataFrame:
    """(doc_id, position, similarity) of neighbours(), a row each."""
    return near.select("doc_id", F.explode("near").alias("x")).select("doc_id", "x.*")


def tfidf_verdict(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, n_texts, boundary_count, mean_similarity, detected, confidence): fewer than three texts are never detected."""
    joined = neighbours(paragraphs).select("doc_id", F.col("n").alias("n_texts"), F.aggregate("near", F.lit(0.0), lambda s, x: s + x["similarity"]).alias("_sum"), F.size(F.filter("near", lambda x: x["similarity"] >= BOUNDARY)).cast("long").alias("_close"))
    pairs = F.greatest(F.col("n_texts") - 1, F.lit(0))
    joined = joined.withColumns({"boundary_count": pairs - F.col("_close"), "_mean": F.when(pairs > 0, F.col("_sum") / pairs).otherwise(1.0)})
    enough = F.col("n_texts") >= 3
    return joined.select("doc_id", "n_texts", F.when(enough, F.col("boundary_count")).otherwise(0).alias("boundary_count"), F.round("_mean", 4).alias("mean_similarity"), (enough & (F.col("boundary_count") >= 2)).alias("detected"), F.when(enough, F.round(1 - F.col("_mean"), 4)).otherwise(0.0).alias("confidence"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows by a product of matrices; where that would cancel, by differences."""
    both = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    square = both - 2 * (x @ y.T)
    i, j = np.nonzero(square <= NEAR * both)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        square[a, b] = ((x[a] - y[b]) ** 2).sum(1)
    return np.sqrt(square)


def silhouette(vectors: DataFrame, column: str, key: str, label: str, item: str, block: int = sources.BLOCK) -> DataFrame:
    """(key, silhouette): mean silhouette with Euclidean distances of the rows of each key; -1 with under two labels or three rows.

    Rows meet all rows of their key, block by block: a task holds a block of each side and some rows of distances, and
    gives a sum a row and label, so pairs are never rows.
    """
    rows = vectors.select(key, F.col(label).alias("_l"), F.col(item).alias("_i"), F.col(column).alias("_v"))
    kind, own = dict(rows.dtypes), [c for c in (key, "_i", "_l", "_m", "_sum", "_n")]
    ddl = f"{key} {kind[key]}, _i {kind['_i']}, _l {kind['_l']}, _m {kind['_l']}, _sum double, _n long"

    def run(mine: pa.Table, other: pa.Table) -> pa.Table:
        out, types = [], [mine.schema.field(c).type for c in (key, "_i", "_l", "_l")]
        schema = pa.schema(list(zip(own, [*types, pa.float64(), pa.int64()], strict=True)))
        if len(mine) and len(other):
            x, y = sources.matrix(mine["_v"]), sources.matrix(other["_v"])
            told = other["_l"].combine_chunks().dictionary_encode(null_encoding="encode")
            member = np.eye(len(told.dictionary))[told.indices.to_numpy(zero_copy_only=False)]
            theirs = other["_i"].to_numpy()
            for at in range(0, len(x), sources.ROWS):
                part = mine.slice(at, sources.ROWS)
                gap = _distances(x[at : at + sources.ROWS], y)
                same = part["_i"].to_numpy()[:, None] == theirs[None, :]
                gap[same] = 0.0
                sums, n = gap @ member, member.sum(0)[None, :] - same @ member
                i, m = np.nonzero(n > 0)
                taken = part.select([key, "_i", "_l"]).take(pa.array(i))
                out.append(pa.table([*taken.columns, told.dictionary.take(pa.array(m)), pa.array(sums[i, m]), pa.array(n[i, m].astype(np.int64))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    there = rows.filter(F.col(key).isNotNull() & F.col("_v").isNotNull())
    a, b = sources.paired(there, there, ("_i", "_i"), block, (key,))
    unknown = rows.filter(F.col(key).isNotNull() & F.col("_v").isNull()).select(key, "_i", "_l", F.col("_l").alias("_m"), F.lit(None).cast("double").alias("_sum"), F.lit(None).cast("long").alias("_n"))
    sums = a.cogroup(b).applyInArrow(run, ddl).unionByName(unknown).groupBy(key, "_i", "_l", "_m").agg((F.sum("_sum") / F.sum("_n")).alias("_mean"))
    each = sums.groupBy(key, "_i", "_l").agg(F.max(F.when(F.col("_l") == F.col("_m"), F.col("_mean"))).alias("_a"), F.min(F.when(F.col("_l") != F.col("_m"), F.col("_mean"))).alias("_b"))
    value = F.when(F.col("_a").isNull(), 0.0).when(F.greatest("_a", "_b") == 0, 0.0).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))
    scored = each.groupBy(key).agg(F.avg(value).alias("_s"))
    stats = rows.groupBy(key).agg(F.count_distinct("_l").alias("_labels"), F.count("*").alias("_n"))
    return stats.join(scored, key, "left").select(key, F.when((F.col("_labels") > 1) & (F.col("_n") >= 3), F.col("_s")).otherwise(-1.0).alias("silhouette"))
