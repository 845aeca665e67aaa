"""Stupid-backoff scores (Brants et al. 2007) of every text under the counts of all texts.

Blocks explode their texts into word n-grams and count the distinct ones; the counts of all blocks meet in tables
partitioned by hash, which answer each block with the corpus's counts; the block joins them back to its n-grams
and sums by document. An occurrence is scored by all other occurrences (each count less one), so a text isn't its
own evidence. With N words in all and backoff weight A, a word scores the relative frequency of the longest n-gram
that occurs elsewhere, times A for each word of context given up; a word that occurs nowhere else counts as A
occurrences. The total N is the count of the empty n-gram; it has a shard to itself, after the others.
Counts travel as 32 bits, and as 64 where a shard's answer to a block holds a larger one.

n-grams are 64-bit hashes, of which 48 bits and the shard are kept. A shard answers for a bounded number of bytes of text
(runtime.shards_for), so what a task holds doesn't grow with the corpus; very long texts are blocks of their own. Defined cases: null or empty texts have no
words and score 0; repeated rows are occurrences like any other; other columns of docs are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .runtime import shards_for

BACKOFF, ORDER = 0.4, 3
#: Bytes of a block's texts; larger ones ask fewer keys twice and take more of a worker's memory.
BLOCK = 6 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TOTAL = np.array([0x9E3779B97F4A7C15], np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words(b: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in order."""
    n = b.size
    inside = ~_SPACE[b.data[:n]]
    edge = np.zeros(n + 1, bool)
    edge[b.offsets] = True
    starts = np.flatnonzero(inside & (edge[:n] | np.concatenate([[True], ~inside[:-1]])[:n]))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])[:n])) + 1
    eight = np.ndarray((n + 56,), "<u8", b.data.data, strides=(1,))
    left, at = ends - starts, starts
    h = left.astype(np.uint64) * _STEP
    rows = np.arange(len(starts))
    while len(rows):
        take = np.minimum(left[rows], 8).astype(np.uint64)
        w = eight[at[rows]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - take * np.uint64(8)))
        h[rows] = B.mix(h[rows] ^ w) * _STEP
        rows = rows[left[rows] > 8]
        left, at = left.copy(), at.copy()
        left[rows] -= 8
        at[rows] += 8
    return B.mix(h), (np.searchsorted(b.offsets, starts, "right") - 1).astype(np.int32)


def grams(h: np.ndarray, row: np.ndarray, order: int, n_shards: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: placed keys, and the position of the last word of each."""
    key, last, found = h, np.arange(len(h)), []
    for k in range(order):
        if k:
            whole = row[last[1:]] == row[last[1:] - k] if len(last) else np.zeros(0, bool)
            last_next = last[1:][whole]
            back = np.full(len(h), -1)
            back[last] = np.arange(len(last))
            key = B.mix(key[back[last_next - 1]] * _STEP + h[last_next] + np.uint64(k))
            last = last_next
        found.append((B.place(key, n_shards), last))
    return found


def ask(docs: DataFrame, order: int, n_shards: int) -> DataFrame:
    def run(batches):
        for b in B.read_blocks(batches, BLOCK):
            h, row = words(b)
            keys = np.concatenate([g for g, _ in grams(h, row, order, n_shards)])
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            placed, counts = keys[first], np.diff(np.concatenate([first, [len(keys)]]))
            yield B.questions(b, placed, n_shards, lambda i, j, counts=counts: B.numbers(counts[i:j].astype(np.uint32)))
            yield pa.record_batch([[b.no], [n_shards], [B.pack_keys(_TOTAL, n_shards)], [B.numbers(np.array([len(h)], np.uint32))]], schema=B.QUESTION)

    return B.scan(docs).mapInArrow(run, B.QUESTION_DDL)


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """The corpus's count of each key that a block asked for, in the block's order; keys tells the width."""
    pdf = pdf.sort_values("block")
    keys = [B.unpack_keys(k) for k in pdf["keys"]]
    at = np.cumsum([0, *map(len, keys)])
    keys = np.concatenate(keys)
    counts = np.concatenate([np.frombuffer(B.spread(x), np.uint32) for x in pdf["extra"]]).astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    counts[order] = sums[np.cumsum(new) - 1]
    told = [counts[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    width = [b"u4" if x.max() < 1 << 32 else b"u8" for x in told]
    return pd.DataFrame({"block": pdf["block"].values, "shard": pdf["shard"].values, "keys": width, "extra": [B.numbers(x.astype(w.decode())) for x, w in zip(told, width, strict=True)]})


def told_counts(answers: pd.DataFrame) -> list[np.ndarray]:
    """The counts in each row that answer() made."""
    return [np.frombuffer(B.spread(x), bytes(w).decode()) for w, x in zip(answers["keys"], answers["extra"], strict=True)]


def score_block(b: B.Block, counts: np.ndarray, total: int, order: int, n_shards: int) -> pa.RecordBatch:
    """counts: of the block's sorted distinct keys; total: of all words."""
    h, row = words(b)
    found = grams(h, row, order, n_shards)
    del h
    keys = np.concatenate([g for g, _ in found])
    found = [last for _, last in found]
    by_key = np.argsort(keys).astype(np.uint32)
    keys = keys[by_key]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    del keys
    nth = np.cumsum(new, dtype=np.int32)
    n_keys = int(nth[-1]) if len(nth) else 0
    if n_keys != len(counts):
        raise RuntimeError(f"block {b.no} isn't the block that asked: {n_keys} keys, {len(counts)} answers")
    nth -= 1
    told = np.empty(len(nth), counts.dtype)
    told[by_key] = counts[nth]
    del by_key, nth, new
    at = 0
    n = len(row)
    score, level, above = np.zeros(n), np.zeros(n, np.int8), None
    for k, last in enumerate(found):  # the longest n-gram found elsewhere overwrites the shorter ones
        c = np.zeros(n, told.dtype)
        c[last] = told[at : at + len(last)] - 1
        at += len(last)
        if k == 0:
            seen = c > 0
            score = np.where(seen, c, BACKOFF) / total
            level[seen] = 1
        else:
            seen = np.flatnonzero(c > 0)
            score[seen] = c[seen] / above[seen - 1]
            level[seen] = k + 1
        above = c
    possible = np.minimum(np.arange(n) - np.searchsorted(row, row) + 1, order)
    logs = np.log(score) + np.log(BACKOFF) * (possible - np.maximum(level, 1))
    rows, of = len(b.ids), lambda w: np.bincount(row, w, len(b.ids))
    n_words = np.bincount(row, minlength=rows)
    return pa.record_batch([b.ids, pa.array(n_words, pa.int64()), *(pa.array(of(level == k).astype(np.int64)) for k in range(order + 1)), pa.array(of(logs))], names=["doc_id", "n_words", *(f"n_level{k}" for k in range(order + 1)), "log_score"])


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Each row of docs(doc_id, text): doc_id, n_words, n_level0.. (words by longest n-gram found elsewhere; 0: none), log_score (natural)."""
    docs = B.steady(docs.select("doc_id", "text"))
    n = shards_for(docs)
    answers = ask(docs, order, n).groupBy("shard").applyInPandas(answer, B.QUESTION_DDL)
    kind = dict(docs.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_words long, {', '.join(f'n_level{k} long' for k in range(order + 1))}, log_score double"

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        body = pdf["shard"].values == -1
        b = B.unpack(int(pdf["block"].iloc[0]), pdf["keys"][body].iloc[0])
        *counts, total = told_counts(pdf[~body])
        return score_block(b, np.concatenate([np.zeros(0, np.uint32), *counts]), int(total[0]), order, n).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return B.packed_blocks(docs, BLOCK).unionByName(answers).groupBy("block").applyInPandas(finish, out)
