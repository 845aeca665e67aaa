"""Periodic runs against a plain search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from quillmark.llm import periodic_runs as P
from quillmark.llm import queries

from .conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """(start, length, smallest period) of every run, by comparing the words with themselves at every distance."""
    w, found = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int), {}
    for q in range(len(w) // 4, 0, -1):
        change = np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True):
            if e - s + q >= max(6, 4 * q):
                found[int(s), int(e - s + q)] = q
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_overlap_of_a_run_with_itself():
    assert P.K == 5


@pytest.mark.parametrize("seed", range(6))
def test_random_word_sequences(seed):
    rng = np.random.default_rng(seed)
    for _ in range(150):
        rows = []
        for _ in range(rng.integers(1, 4)):
            w = []
            for _ in range(rng.integers(0, 6)):
                p, k = rng.integers(1, 12), rng.integers(1, 9)
                w += (list(rng.integers(0, rng.integers(1, 5) + 1, p)) * k)[: rng.integers(1, p * k + 1)]
            rows.append(w)
        ids, row, at, want = np.array([x for w in rows for x in w], np.int64), np.repeat(np.arange(len(rows)), [len(w) for w in rows]), 0, []
        for w in rows:
            want += [(s + at, n, q) for s, n, q in plain(w)]
            at += len(w)
        assert list(zip(*(a.tolist() for a in P.runs(ids, row)), strict=True)) == want


def test_a_false_fingerprint_starts_again(monkeypatch):
    real, seeds = P._divide, []

    def wrong(x, longest, seed):
        seeds.append(seed)
        start, end, period = real(x, longest, seed)
        return (start, end, period) if seed else (start, end - 1, period)

    monkeypatch.setattr(P, "_divide", wrong)
    assert [a.tolist() for a in P.runs(np.array([1, 2] * 5), np.zeros(10, int))] == [[0], [10], [2]]
    assert seeds == [0, 1]


def check_rows(frame):
    for r in frame.collect():
        words = WORD.findall(r["text"] or "")
        runs = plain(words)
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words)
        assert r["collapsed"] == collapsed(words, runs)


def test_texts_odd_rows_and_long_texts(spark, odd, none, monkeypatch):
    rows = [(1, "a b " * 4), (2, "a b " * 3 + "a"), (3, "x" + " x" * 5), (4, "x x x x x"), (5, None), (6, "\t\n"), (None, "é é é é é é \U0001f600\x0bé"), (7, "one two three " * 3000 + "end " + "q r s t u v w x y z " * 40), (1, "a b " * 4), (8, "a b " * 4 + "c" + " a b" * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    both = lambda d: P.find(d.selectExpr("struct(doc_id, text) AS doc_id", "text")).selectExpr("doc_id.text AS text", "n_words", "runs", "collapsed")
    assert both(docs).count() == len(rows)
    check_rows(both(docs))
    assert both(odd).count() == odd.count()
    assert P.find(none).collect() == []


def test_query_against_plain_search(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        w, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs, r = plain(w), got[doc_id]
        some += len(runs)
        best = None
        for x in runs:
            if best is None or x[1] * best[2] > best[1] * x[2]:
                best = x
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert some > 10
