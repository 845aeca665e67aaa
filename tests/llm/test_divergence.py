"""Source divergence against whole-number sums over all terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmark.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, listed=200):
    n, had, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        n[lang, source].update(terms)
        had[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in had[lang].items() if d >= 3]
        own = sorted(s for x, s in groups if x == lang)
        counts = {s: {t: n[lang, s][t] for t in kept} for s in own} | {None: {t: sum(n[lang, s][t] for s in own) for t in kept}}
        p = {s: {t: 1 + 10**9 * (c + 1) // (sum(of.values()) + len(kept)) for t, c in of.items()} for s, of in counts.items()}
        f = lambda x, y: (x - y) ** 2 // y
        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(-f(p[s][t], p[None][t]), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            key = lambda x: (x[0], x[1].encode())
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(sorted(pairs, key=key))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, t) in enumerate(sorted(terms, key=key)[:listed])]
    return sorted(out)


def corpus(seed, sources, texts):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "aBcdé" for b in "xyzWü\U0001f600"] + ["rare" + "abcdefghij"[i] for i in range(10)]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for _ in range(texts):
        s = None if rng.random() < 0.05 else f"s{int(rng.integers(sources)) if rng.random() < 0.7 else 0}"
        text = None if rng.random() < 0.05 else " 1-".join(rng.choice(words, int(rng.integers(0, 12)), p=weights / weights.sum()))
        rows.append((text, ["en", "de", None][int(rng.integers(3))], s))
    return rows


@pytest.mark.parametrize(("light", "tile", "band"), [(8, 2048, 256), (0, 5, 2), (2, 7, 3), (100, 1, 1)])
def test_split_tiles_and_bands_add_up(spark, light, tile, band):
    rows = corpus(light + tile, 7, 160) + [("only here", "xx", "a"), (None, "xx", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(map(tuple, D.audit(docs, light=light, tile=tile, band=band).collect()))
    assert got == plain(rows) and {r[0] for r in got} == {"", "de", "en", "xx"}
    assert all(r[4] == 0 for r in got if r[0] == "xx")


def test_tile_sums_are_exact_beyond_64_bits_and_for_absent_sources():
    rng = np.random.default_rng(3)
    lo, hi = np.array([10**12, 7, 10**18]), np.array([5, 10**10])
    term = np.repeat(np.arange(6), 3)
    side, at = np.tile([0, 0, 1], 6), np.tile([0, 2, 1], 6)
    n = rng.integers(0, 9, 18) * np.where(at == 2, 10**16, 1)
    for heavy in (np.zeros(6, bool), np.ones(6, bool), np.arange(6) % 2 == 0):
        got = D.tile_sums(lo, hi, term, side, at, n, heavy)
        for i, a in enumerate(lo.tolist()):
            for j, b in enumerate(hi.tolist()):
                of = lambda t, s, x: sum(int(m) for m in n[(term == t) & (side == s) & (at == x)])
                p = lambda t: 1 + 10**9 * (of(t, 0, i) + 1) // a  # noqa: E731, B023
                q = lambda t: 1 + 10**9 * (of(t, 1, j) + 1) // b  # noqa: E731, B023
                assert got[i, j] == sum((p(t) - q(t)) ** 2 // q(t) for t in range(6))


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    assert sorted(map(tuple, D.audit(odd).collect())) == plain(rows)
    assert D.audit(none).collect() == []
    alike = [("same words here", "en", s) for s in ("b", "a", "c") for _ in range(3)]
    got = [tuple(r) for r in D.audit(spark.createDataFrame(alike, "text string, lang string, source string")).collect()]
    assert sorted(got) == plain(alike) and {(r[1], r[3], r[5]) for r in got} == {("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2)}


def test_listed_terms_end_at_the_limit(spark):
    rows = [(f"{'abcdefgh'[i % 8]}{'xyz'[i % 3]} common", "en", "s" if i % 2 else "t") for i in range(240)]
    got = D.audit(spark.createDataFrame(rows, "text string, lang string, source string"), listed=4)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4)
