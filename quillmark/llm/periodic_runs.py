"""Periodic runs of words inside each text, by repeated k-gram masking and Main-Lorentz division.

A run is a stretch of consecutive words with smallest period q, at least MIN_LENGTH and TIMES * q words long, that no
neighbouring word extends with the same period. Such a run overlaps itself, shifted by q, in at least
max(MIN_LENGTH, TIMES * q) - q words; the least of this over all q is K, so each of its words lies in a K-gram that
occurs again in the same text. Words outside of such K-grams are masked: they can't be in a run, and what is left are
segments, none of which a run can leave.

Only the segments are divided, all those of a block of texts at once: of blocks of 2h words, each run crosses the middle
of the smallest one that holds it, with 2q words or more on one side of it. For every middle and every q that fits, one
comparison of fingerprints tells whether q words beside the middle repeat at once; where they do, and no run of a
divisor of q is known there, the run is extended to both sides by bisection. Fingerprints (two moduli below 2^31) only
propose: every run is then compared word by word, numbers of words being exact, and a block with a false one is done
again with another base. No fingerprint can hide a run.

Rows stay where the scan has them: nothing is shuffled, and a task holds one block of texts (BLOCK bytes, or one text).
Defined cases: null or empty texts have no words, no runs and an empty collapsed text; repeated rows get equal rows;
ties of the exponent are left to the caller, runs are listed by start, then period; very long texts are searched whole;
other columns of docs are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

MIN_LENGTH, TIMES = 6, 4
#: The least overlap of a run with itself.
K = min(max(MIN_LENGTH, TIMES * q) - q for q in range(1, MIN_LENGTH + 1))
#: Bytes of a block's texts.
BLOCK = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MODULI = (2147483647, 2147483629)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words(b: B.Block, space: np.ndarray = _SPACE) -> tuple[pa.Array, np.ndarray]:
    """The words of a block as binary, in order, and the row of each."""
    n = b.size
    inside = ~space[b.data[:n]]
    edge = np.zeros(n + 1, bool)
    edge[b.offsets] = True
    starts = np.flatnonzero(inside & (edge[:n] | np.concatenate([[True], ~inside[:-1]])[:n]))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])[:n])) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    told = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b.data[:n][inside])])
    return told, np.searchsorted(b.offsets, starts, "right") - 1


def unmasked(ids: np.ndarray, row: np.ndarray, k: int = K) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice or more in its row. Equal hashes of different k-grams only unmask more."""
    n = len(ids) - k + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    h = B.mix(row[:n].astype(np.uint64) * _STEP + np.uint64(1))
    for j in range(k):
        h = B.mix(h * _STEP + ids[j : j + n].astype(np.uint64))
    whole = np.flatnonzero(row[:n] == row[k - 1 :])
    order = whole[np.argsort(h[whole])]
    same = h[order[1:]] == h[order[:-1]]
    first = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    change = np.zeros(len(ids) + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + k, -1)
    return np.cumsum(change[:-1]) > 0


class Fingerprints:
    """Whether two stretches of x are alike, by polynomial hashes; a stretch and its copy q further on."""

    def __init__(self, x: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        value = B.mix(x.astype(np.uint64) + np.uint64(rng.integers(1 << 62)))
        self.sums, self.powers = [], []
        for p in _MODULI:
            power = np.ones(1, np.int64)
            step = int(rng.integers(1 << 20, p - 1))
            while len(power) <= len(x):
                power = np.concatenate([power, power * step % p])
                step = step * step % p
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum((value % np.uint64(p)).astype(np.int64) * power[: len(x)] % p) % p]))

    def alike(self, at: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.ones(len(at), bool)
        for p, sums, powers in zip(_MODULI, self.sums, self.powers, strict=True):
            here, there = sums[at + length] - sums[at], sums[at + q + length] - sums[at + q]
            out &= ((here % p) * powers[q] - there) % p == 0
        return out

    def extent(self, at: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch around each of at, at + q, that has period q."""
        n = len(self.sums[0]) - 1
        after, before = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for step in (1 << b for b in reversed(range(int(most).bit_length()))):
            can = np.flatnonzero(at + q + after + step <= n)
            can = can[self.alike(at[can] + after[can], q[can], np.full(len(can), step))]
            after[can] += step
            can = np.flatnonzero(at - before - step >= 0)
            can = can[self.alike(at[can] - before[can] - step, q[can], np.full(len(can), step))]
            before[can] += step
        return at - before, at + q + after


def _divide(x: np.ndarray, longest: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the runs of x, whose segments hold at most `longest` words."""
    prints, n, found = Fingerprints(x, seed), len(x), []
    known = np.zeros((3, n + 1), np.int64)  # of a position: start, end and period of a run that covers it
    h = TIMES
    while h <= 2 * n:
        middles = np.arange(h, n, 2 * h)
        periods = np.arange(1, min(h // 2, longest // TIMES) + 1)
        for part in np.array_split(middles, max(1, len(middles) * len(periods) >> 20)):
            m, q = (a.ravel() for a in np.meshgrid(part, periods, indexing="ij"))
            for side in (0, 1):  # 2q words from the middle on, or up to it
                left, right = m - 2 * q * side, m + 2 * q * (1 - side)
                can = np.flatnonzero((left >= 0) & (right <= n))
                start, end, period = known[:, m[can] - side]
                can = can[(period == 0) | (start > left[can]) | (end < right[can]) | (q[can] % np.maximum(period, 1) != 0)]
                can = can[prints.alike(left[can], q[can], q[can])]
                s, e = prints.extent(left[can], q[can], longest)
                long = e - s >= np.maximum(MIN_LENGTH, TIMES * q[can])
                if long.any():
                    new = np.unique(np.stack([s[long], e[long], q[can][long]], 1), axis=0)
                    new = new[np.append(True, (new[1:, :2] != new[:-1, :2]).any(1))]  # of one stretch the smallest period
                    found.append(new)
                    for one in new[np.argsort(new[:, 1] - new[:, 0], kind="stable")]:
                        known[:, one[0] : one[1]] = one[:, None]
        h *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _true(x: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Whether each stretch has its period, and no neighbour extends it, compared word by word."""
    many = end - start - period
    at = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
    padded = np.concatenate([[-1], x, [-2]])  # padded[i + 1] is x[i]
    inner = (x[at] == x[at + np.repeat(period, many)]).all()
    return bool(inner and (padded[start] != padded[start + period]).all() and (padded[end + 1] != padded[end + 1 - period]).all())


def runs(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and period of every run, words numbered over all rows; no run crosses rows. By first word, then period."""
    open_ = np.flatnonzero(unmasked(ids, row))
    if not len(open_):
        return (np.zeros(0, np.int64),) * 3
    apart = (np.diff(open_) != 1) | (np.diff(row[open_]) != 0)
    shift = np.concatenate([[0], np.cumsum(apart)])
    x = np.arange(len(open_) + shift[-1]) + len(ids)  # what isn't overwritten separates segments, each number once
    place = np.arange(len(open_)) + shift
    x[place] = ids[open_]
    origin = np.zeros(len(x), np.int64)
    origin[place] = open_
    longest = int(np.diff(np.flatnonzero(np.concatenate([[True], apart, [True]]))).max())
    for seed in count():
        start, end, period = _divide(x, longest, seed)
        if _true(x, start, end, period):
            first = origin[start]
            order = np.lexsort((period, first))
            return first[order], (end - start)[order], period[order]


def find(docs: DataFrame) -> DataFrame:
    """Each row of docs(doc_id, text): doc_id, n_words, runs (array of start, length, period; words are numbered from 0), and collapsed: the words, joined by one space, less those of a run after its first period."""

    def run(batches):
        for b in B.read_blocks(batches, BLOCK):
            told, row = words(b)
            ids = told.dictionary_encode().indices.to_numpy().astype(np.int64)
            first, length, period = runs(ids, row)
            size = np.bincount(row, minlength=len(b.ids))
            begin = np.concatenate([[0], np.cumsum(size)])
            of = row[first]
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, first + period, 1)
            np.add.at(change, first + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(b.ids)))])
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), told.filter(pa.array(kept))), pa.scalar(b" ", pa.large_binary()))
            listed = pa.StructArray.from_arrays([pa.array(first - begin[of]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(b.ids) + 1)), pa.int32()), listed)
            yield pa.record_batch([b.ids, pa.array(size, pa.int64()), lists, joined.cast(pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    found = B.scan(docs).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(array: str) -> F.Column:
    """Of an array of runs by start and period, the one with the greatest exact length/period, ties to the first; null for none."""
    better = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.aggregate(array, F.get(array, F.lit(0)), lambda a, x: F.when(better(a, x), x).otherwise(a))
