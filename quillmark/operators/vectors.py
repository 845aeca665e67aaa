"""Vectors of texts without a service: positive pointwise mutual information of texts and terms, reduced by a randomised range finder (Halko, Martinsson and Tropp 2011).

Of a corpus, entry (text, term) is max(0, ln(share of the term in the text / its share in the corpus)). learn() finds the
leading right singular directions of this sparse matrix: a random table of terms, drawn from their hashes, is multiplied
by it and its transpose in turn; each product is a join of the entries with a table of K numbers a row and a sum by key,
and between products K x K sums of squares make columns orthonormal (Cholesky). Only such K x K tables reach the driver. The result
is a table of terms; embed() gives any text the sum of its terms' directions by its entries, so texts of the corpus get
their coordinates and new ones fold in.

Terms of fewer than LEAST texts are left out of learning. Null and empty texts, and texts without a known term, get a zero vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Numbers of a vector, more of them while searching, rounds of products with the transpose and back, least texts of a term.
DIMENSIONS, SPARE, ROUNDS, LEAST = 48, 8, 2, 2
#: Terms that every task may hold.
COMMON = 200_000


def counts(texts: DataFrame, key: tuple[str, ...], text: str = "text", apart: bool = True) -> DataFrame:
    """(key..., term, n, size): occurrences of each alphabetic word in each text, and the text's words.

    A text's words are counted in its task and nothing is shuffled, so key must tell texts apart; if it may not (apart is
    False), the counts of texts of one key are added up.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(len(key))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            told = lists.flatten().dictionary_encode()
            wide = max(len(told.dictionary), 1)
            pair, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + told.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = pa.array(pair // wide)
            yield pa.record_batch([*(c.take(row) for c in batch.columns[: len(key)]), told.dictionary.take(pa.array(pair % wide)), pa.array(n, pa.int64()), pa.array(sizes[pair // wide], pa.int32())], names=[*key, "term", "n", "size"])

    kinds = dict(texts.dtypes)
    each = texts.select(*key, T.alpha_words(text).alias("_w")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", term string, n long, size int")
    return each if apart else each.groupBy(*key, "term").agg(F.sum("n").alias("n"), F.max("size").alias("size"))


def _entry() -> Column:
    return F.log((F.col("n") / F.col("size")) / F.col("share"))


def _product(entries: DataFrame, given: DataFrame, by: tuple[str, ...], to: tuple[str, ...], k: int) -> DataFrame:
    """(to..., v): for each of `to` the sum of entry times v of given(by..., v)."""
    sums = entries.join(given, list(by)).groupBy(*to).agg(*(F.sum(F.col("entry") * F.get("v", F.lit(i))).alias(f"_{i}") for i in range(k)))
    return sums.select(*to, F.array(*(F.col(f"_{i}") for i in range(k))).alias("v"))


def _squares(table: DataFrame, k: int) -> np.ndarray:
    """The K x K sums of products of the columns of v."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, k)
            total += x.T @ x
        yield pa.record_batch([[i for i, _ in pairs], [j for _, j in pairs], [float(total[i, j]) for i, j in pairs]], names=["i", "j", "value"])

    out = np.zeros((k, k))
    for r in table.select("v").mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


def _times(table: DataFrame, matrix: np.ndarray) -> DataFrame:
    """table with v times matrix."""
    columns = F.array(*(F.array(*map(F.lit, c.tolist())) for c in matrix.T))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return table.withColumn("v", F.transform(columns, lambda c: dot(F.col("v"), c)))


def _orthonormal(squares: np.ndarray) -> np.ndarray:
    """What makes columns with such sums of products orthonormal; directions without length become zero."""
    values, axes = np.linalg.eigh(squares)
    kept = values > max(values.max(), 0) * 1e-12
    return axes * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0.0)


def entries_of(whole: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(term, share) of the terms of enough texts, and (key..., term, entry) of the positive entries, of counts().

    The terms are aggregated while this is called, and kept by Spark. Entries meet the COMMON most frequent terms where they
    are; only those of the terms beyond are shuffled.
    """
    terms = whole.groupBy("term").agg(F.sum("n").alias("_n"), F.count("*").alias("_texts")).persist()
    total = terms.agg(F.sum("_n").alias("_all"))
    shares = terms.crossJoin(F.broadcast(total)).filter(F.col("_texts") >= LEAST).select("term", (F.col("_n") / F.col("_all")).alias("share"))  # total is one row
    positive = lambda met: met.withColumn("entry", _entry()).filter("entry > 0").select(*key, "term", "entry")
    if shares.count() <= COMMON:
        return shares, positive(whole.join(F.broadcast(shares), "term"))
    common = shares.orderBy(F.desc("share"), "term").limit(COMMON)
    rare = lambda frame: frame.join(F.broadcast(common.select("term")), "term", "left_anti")
    return shares, positive(whole.join(F.broadcast(common), "term")).unionByName(positive(rare(whole).join(rare(shares), "term")))


def learn(texts: DataFrame, key: tuple[str, ...] = ("doc_id", "paragraph_index"), cut=lambda frame, name: frame, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = 0, text: str = "text") -> DataFrame:
    """(term, share, v): the table that embed() reads, of texts(key..., text).

    cut(frame, name) may write a table of a step and read it back; on a cluster it should, as each step reads the one before twice.
    """
    k = dimensions + SPARE
    whole = cut(counts(texts, key, text), "counts")
    shares, found = entries_of(whole, key)
    entries = cut(found, "entries")
    drawn = F.array(*(((F.pmod(F.xxhash64("term", F.lit(seed * 100_003 + i)), F.lit(2)) * 2) - 1).cast("double") for i in range(k)))
    table = shares.select("term", drawn.alias("v"))
    for turn in range(rounds + 1):
        rows = cut(_product(entries, table, ("term",), key, k), f"texts-{turn}")
        rows = cut(_times(rows, _orthonormal(_squares(rows, k))), f"basis-{turn}")
        table = cut(_product(entries, rows, key, ("term",), k), f"terms-{turn}")
    values, axes = np.linalg.eigh(_squares(table, k))  # of the transpose's products with an orthonormal basis: squared singular values
    top = np.argsort(-values)[:dimensions]
    turned = axes[:, top] * np.where(values[top] > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values[top], 1e-300)), 0.0)
    return shares.join(_times(table, turned), "term")


def embed(texts: DataFrame, table: DataFrame, key: tuple[str, ...], text: str = "text") -> DataFrame:
    """(key..., vector) of texts(key..., text) by the table of learn(); key must tell texts apart."""
    k = len(table.select("v").first()["v"]) if not table.isEmpty() else 0
    if k == 0:  # nothing was learnt
        return texts.select(*key, F.array().cast("array<double>").alias("vector"))
    met = counts(texts, key, text).join(table, "term").withColumn("entry", _entry()).filter("entry > 0")
    sums = met.groupBy(*key).agg(*(F.sum(F.col("entry") * F.get("v", F.lit(i))).alias(f"_{i}") for i in range(k)))
    zero = F.array(*[F.lit(0.0)] * k).cast("array<double>")
    made = sums.select(*key, F.array(*(F.col(f"_{i}") for i in range(k))).cast("array<double>").alias("vector"))
    return texts.select(*key).join(made, list(key), "left").withColumn("vector", F.coalesce("vector", zero))
