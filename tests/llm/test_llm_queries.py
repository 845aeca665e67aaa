"""Registered queries against their SQL, and operators against brute force on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import blocks, decontaminate, html_text, lm_score, mixing, near_dedup, oracle, quality_model, quality_rules, queries, runtime, suffix_dedup, toxicity, warc
from tests.oracle import same

from .conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, queries.QUERIES[name], oracle.SQL[name], SMALL)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- 1


def test_mix_comes_near_its_targets_and_agrees(spark, odd, none):
    first = sorted(map(tuple, mixing.mix_sources(documents(spark)).collect()), key=repr)
    assert first == sorted(map(tuple, mixing.mix_sources(documents(spark).repartition(7)).collect()), key=repr)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for _, source, size, whole, goal, took in first:
        assert took in (0, size, 2 * size) and goal <= 2 * whole
        taken[source] += took
        target[source], largest[source] = goal, max(largest[source], size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r[2] for r in first))
    r = mixing.mix_sources(odd).collect()
    assert len(r) == odd.count() and {x["size"] for x in r if x["doc_id"] in (3, 4)} == {0}
    assert len({x["taken"] for x in r if x["doc_id"] == 1}) == 1
    assert mixing.mix_sources(none).collect() == []


# --- 2


def test_rules_measure_odd_texts(odd, none):
    r = {x["doc_id"]: x for x in quality_rules.judge(odd).collect()}
    assert r[3]["n_words"] == r[4]["n_words"] == 0 and r[3]["base_failed"] and not r[4]["kept"]
    assert r[1]["n_repeat_words"] == r[1]["n_words"] and r[1]["base_failed"]
    assert r[6]["n_words"] == 2 and r[6]["word_chars"] == 3
    assert r[5]["n_repeat_words"] == 16000 and r[5]["n_words"] == 20000
    assert quality_rules.judge(none).collect() == []


def test_sources_of_different_texts_get_different_cutoffs_and_verdicts(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(160):
        words = [f"w{x}" for x in rng.integers(10**5, 10**6, 200)]
        noisy = i % 2
        for j in range(int(rng.integers(0, 60 if noisy else 6))):
            words[j] = "$" + words[j]
        rows.append((i, " ".join(words), "en", "forum" if noisy else "book"))
    rows += [(1000 + k, " ".join(("$" if j < 40 else "") + f"v{k}{10**4 + j}" for j in range(200)), "en", s) for k, s in enumerate(("book", "forum"))]
    f = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    high = {r["_source"]: r["_cut_symbols"] for r in quality_rules.cutoffs(quality_rules.measured(f), 30).collect()}
    assert high["=book"]["high"] < 200 < high["=forum"]["high"] and not high["=forum"]["floored"]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(f).collect()}
    assert not kept[1000] and kept[1001] and np.mean([kept[i] for i in range(160)]) > 0.95


def test_floors_decide_less_than_half_of_the_cutoffs(spark):
    cuts = quality_rules.cutoffs(quality_rules.measured(documents(spark)), 30).collect()
    assert np.mean([r[f"_cut_{rule}"]["floored"] for r in cuts for rule in quality_rules.RULES]) < 0.5


def test_quantiles_are_right_to_a_64th(spark):
    values = [int(x) for x in np.random.default_rng(1).integers(0, 10**6, 500)]
    f = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket("v").alias("b"))
    assert all(0 <= r["v"] - r["b"] <= r["v"] / 64 for r in f.collect())


# --- 3


def test_archive_round_trip_and_lookups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(i, f"https://www.h{i % 4}.example.org/p?q={i % 9}", f"<p>payload {i % 6} é</p>") for i in range(40)]
    rows += [(3, rows[3][1], rows[3][2]), (90, None, None), (91, "http://[bad", ""), (None, "http://x.org/", "only"), (92, rows[0][1], "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "k", "a", 1, 2) for r in rows], "page_id long, url string, html string, key string, archive string, offset long, _first long").repartition(3)
    root = warc.write(pages)
    got = warc.read(spark, root, pages).collect()
    assert len(got) == len(rows)
    some = warc.read(spark, root, pages.filter("page_id = 2")).collect()
    assert sorted(r["page_id"] for r in some) == sorted(p for p, u, _ in rows if warc.url_key(u) == warc.url_key(rows[2][1]))
    first = {}
    for p, _, h in rows:
        h = h or ""
        first[h] = min([x for x in (first.get(h), p) if x is not None], default=None)
    for r in got:
        page, _, html = next(x for x in rows if x[0] == r["page_id"])
        html = html or ""
        assert r["payload_bytes"] == len(html.encode())
        assert r["record_type"] == ("response" if page == first[html] else "revisit")
        assert r["refers_to"] == (None if page == first[html] else first[html])
        assert r["payload"] == (html if page == first[html] else None)
    index = warc.Index(spark, root)
    for url in {u for _, u, _ in rows}:
        found = sorted(str(c.page) for c in index.captures(url))
        assert found == sorted(str(p) for p, u, _ in rows if warc.url_key(u) == warc.url_key(url))
        assert all(x["x-page"] is not None for x in index.records(url))
    assert index.captures("https://absent.example.org/") == []


def test_small_payloads_are_all_responses_and_empty_tables_pass(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "same"), (2, "http://b.org/", "same"), (3, "http://c.org/", "longer same"), (4, "http://d.org/", "longer same")], "page_id long, url string, html string")
    r = {x["page_id"]: x["record_type"] for x in warc.read(spark, warc.write(pages, least=5), pages).collect()}
    assert r == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.read(spark, warc.write(pages.limit(0)), pages).collect() == []


def test_a_repeated_attempt_has_files_of_its_own(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    for k in "ab":  # the second write stands for later attempts over the same partitions
        warc.write(pages, root=f"file://{tmp_path}/{k}")
    first, second = ({p.name for p in (tmp_path / k / "archives").iterdir()} for k in "ab")
    assert first and second and not first & second


def test_a_key_over_many_blocks_and_files_is_found_whole(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 2)
    pages = spark.createDataFrame([(i, f"http://{'b' if 5 <= i < 45 else 'ac'[i % 2]}.org/", f"p{i}") for i in range(50)], "page_id long, url string, html string").repartition(4)
    root = warc.write(pages)
    assert sorted(c.page for c in warc.Index(spark, root).captures("http://b.org/")) == list(range(5, 45))
    assert len(warc.index_files(spark, root)) > 1 and warc.Index(spark, root).captures("http://d.org/") == []
    assert warc.read(spark, root, pages).count() == 50


def test_url_keys_reverse_the_host():
    assert warc.url_key("https://www.a.b.org/x?y#z") == "org,b,a)/x?y"
    assert warc.url_key(None) == ")/"


# --- 4


def test_toxicity_on_held_out_rows(spark, odd, none):
    stems, rng = ["vilezot", "grumfok"], np.random.default_rng(5)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "ans"], 3)) for _ in range(60)]
        bad = i % 3 == 0
        if bad:
            words[i % 60] = stems[i % 2] + words[0][:2]
        rows.append((i, " ".join(words), int(bad)))
    f = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    r = toxicity.toxicity(f.select("doc_id", "text"), f.select("doc_id", "toxic")).join(f, "doc_id").filter("held_out").collect()
    assert np.mean([x["predicted"] == x["toxic"] for x in r]) > 0.97
    labels = f.select("doc_id", "toxic")
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= x["score"] <= 1 for x in out)
    assert len({x["score"] for x in out if x["doc_id"] in (3, 4)}) == 1
    assert toxicity.toxicity(none, labels).collect() == []
    assert {x["score"] for x in toxicity.toxicity(f.select("doc_id", "text"), labels.limit(0)).collect()} == {0.5}


def test_toxicity_of_real_held_out_labels(spark):
    where = "/root/testdata/sf0.1"
    f, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    held = f.filter(toxicity.held_out()).join(labels, "doc_id").select("doc_id", "text", "toxic")
    r = toxicity.score(held, toxicity.train(f, labels.filter(~toxicity.held_out()))).join(labels, "doc_id").select("toxic", "score").collect()
    bad, good = ([x["score"] >= 0.5 for x in r if x["toxic"] == k] for k in (1, 0))
    assert len(bad) > 90 and np.mean(bad) > 0.87 and np.mean(good) < 0.01


def test_toxicity_against_a_dense_fit(spark):
    """Sets of n-grams text by text, ratios by counting, and the same steps on a dense matrix."""
    rng, rows = np.random.default_rng(11), []
    for i in range(90):
        words = ["".join(rng.choice(["ka", "Lo", "mié", "ter"], 2)) for _ in range(12)]
        words[i % 12] = "Grumfok" if i % 3 == 0 else words[i % 12]
        rows.append((i, " ".join(words), int(i % 3 == 0 and i % 15 != 0)))
    rows.append((200, "ab", 0))
    f = spark.createDataFrame(rows, "doc_id long, text string, toxic int")

    def buckets(text):
        low, out, wide = "".join(c.lower() if c.isascii() else c for c in text), set(), 1 << 32
        for n in toxicity.ORDERS:
            for at in range(len(low) - n + 1):
                h = ord(low[at])
                for c in low[at + 1 : at + n]:
                    h = (h * 0x01000193 + ord(c)) % wide
                x = (h * 0x9E3779B1 + n) % wide
                out.add(((x ^ (x >> 15)) * 0x85EBCA6B % wide) >> (32 - toxicity.BITS))
        return out

    found, y = [buckets(t) for _, t, _ in rows], np.array([r[2] for r in rows], float)
    ratio = {}
    for b in set().union(*found):
        bad, good = (1 + sum(b in s for s, k in zip(found, y, strict=True) if k == want) for want in (1, 0))
        r = np.log(bad / (y.sum() + 2)) - np.log(good / (len(y) - y.sum() + 2))
        if bad + good - 2 >= toxicity.LEAST and abs(r) > toxicity.CLEAR * np.sqrt(1 / bad + 1 / good):
            ratio[b] = r
    x = np.array([[ratio[b] * (b in s) for b in sorted(ratio)] for s in found])
    w, c, m, v = np.zeros(x.shape[1]), toxicity.intercept(y), 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        off = (1 / (1 + np.exp(-(x @ w + c))) - y) * np.where(y == 1, toxicity.WEIGHT, 1) / len(y)
        g = np.append(toxicity.RIDGE * w + x.T @ off, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, c = w - move[:-1], c - move[-1]
    want = 1 / (1 + np.exp(-(x @ w + c)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(f, toxicity.train(f, f)).collect()}
    assert len(ratio) > 5 and max(abs(got[r[0]] - p) for r, p in zip(rows, want, strict=True)) < 1e-3


# --- 5

PAGES = [
    ("<html><body><div class='menu'><a href=/>Home</a> <a href=/x>More</a></div><div id=content><h2>Title here</h2><p>First paragraph, with commas, and text that is long enough.</p><p>Second &amp; last&nbsp;paragraph, also long enough to count.</p></div><div class='comments'><p>Reader says: nice article, really nice, thanks for it.</p></div></body></html>", "Title here First paragraph, with commas, and text that is long enough. Second & last paragraph, also long enough to count."),
    ("<body><article><h1>A</h1><p>x <b>bold</b> <a href='#'>link</a> y.<ul><li>one<li>two</ul><aside>not this</aside><form><input><button>send</button></form></article><footer>end, of, page.</footer>", "A x bold link y. one two"),
    ("<script>var x='<p>no</p>'</script><p>5 < 6 and a &lt;b&gt;", "5 < 6 and a <b>"),
    ("plain text only", "plain text only"),
    ("<div hidden>x</div><!-- c -->", ""),
    ("", ""),
    (None, ""),
    ("<p>open <b>never closed", "open never closed"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_extract_keeps_rows(spark):
    f = spark.createDataFrame([(i, None, p, "z") for i, (p, _) in enumerate(PAGES)] + [(None, "u", "<p>t</p>", "z")], "page_id long, url string, html string, text string")
    got = html_text.extract(f).collect()
    assert len(got) == len(PAGES) + 1 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(f.limit(0)).collect() == []


# --- 6


def brute_repeats(rows):
    """doc_id: (bytes, removed, spans, digest), by a map from every 50-byte string to its least doc_id."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        out.append((i, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_is_exact(spark):
    f = documents(spark)
    got = sorted(map(tuple, suffix_dedup.report(f).collect()))
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in f.collect()])


def test_suffix_dedup_of_periods_and_edges(spark, odd, none):
    rows = [(9, "ab" * 200), (2, "ab" * 60), (5, "a" * 300), (4, "a" * 49), (3, "a" * 50), (8, "a" * 50), (1, ""), (7, None), (6, "x" + "é" * 60), (10, "é" * 60), (10, "é" * 60)]
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.report(f).collect())) == brute_repeats(rows)
    r = suffix_dedup.remove_repeats(odd)
    assert r.columns == odd.columns and r.count() == odd.count()
    assert {x["text"] for x in r.filter("doc_id = 1").collect()} == {odd.filter("doc_id = 1").first()["text"]}
    assert r.filter("doc_id IS NULL").first()["text"] == ""
    assert suffix_dedup.report(none).collect() == []


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefgh"])
def test_suffixes_are_sorted(letters):
    rng = np.random.default_rng(2)
    texts = sorted({"".join(rng.choice(list(letters), n)).encode() for n in rng.integers(50, 77, 60)})
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
    position, left, _ = suffix_dedup.sort_suffixes(data, np.cumsum(sizes) - sizes, sizes, sizes)
    found = [data[p : p + n].tobytes() for p, n in zip(position, left, strict=True)]
    assert found == sorted(found)


# --- 7


def test_kneser_ney_probabilities_add_up(spark):
    text = spark.createDataFrame([(i, "en", t) for i, t in enumerate(["abracadabra abra", "cadabra abba", "barca bada"] * 3)], "doc_id long, lang string, text string")
    model = {r["gram"]: r for r in quality_model.fit(text).collect()}
    chars = sorted(set("abracadabra abracadabra abbabarca bada"))
    root = int(quality_model._hash(np.array([0], np.uint64), 0).view(np.int64)[0])
    unigrams = [model[int(quality_model._hash(np.array([ord(c)], np.uint64), 1).view(np.int64)[0])]["p"] for c in chars]
    assert sum(unigrams) + model[root]["gamma"] / (len(chars) + 1) == pytest.approx(1)


def plain_kneser_ney(texts, order=4):
    """p(window) by dictionaries: modified Kneser-Ney, interpolated; the lowest order with one symbol more for the unseen."""
    seen = Counter(w for t in texts for w in plain_windows(t, order))
    counts = {order: seen}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, sums, back = {}, {}, {}
    for k, table in counts.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [0.999 * min(max(c - (c + 1) * y * n[c + 1] / n[c], 0.1), c) if n[c] else 0.5 * c for c in (1, 2, 3)]
        off[k] = lambda c, d=d: d[min(c, 3) - 1]
        sums[k], back[k] = Counter(), Counter()
        for g, c in table.items():
            sums[k][g[:-1]] += c
            back[k][g[:-1]] += off[k](c)

    def p(g):
        k, below = len(g), (p(g[1:]) if len(g) > 1 else 1 / (len(counts[1]) + 1))
        if g[:-1] not in sums[k]:
            return below
        gamma = back[k][g[:-1]] / sums[k][g[:-1]]
        if g not in counts[k]:
            return gamma * (below if k > 1 else 1 / quality_model.UNSEEN)
        return (counts[k][g] - off[k](counts[k][g])) / sums[k][g[:-1]] + gamma * below

    return p


def plain_windows(text, order=4):
    padded = "\0" * (order - 1) + text
    return [padded[i : i + order] for i in range(len(text))]


def test_perplexities_are_those_of_plain_dictionaries(spark):
    f = documents(spark).filter("length(text) BETWEEN 20 AND 3000").orderBy("doc_id").limit(40)
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in f.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    trusted, labels = rows[::2][:15], "doc_id long, quality int"
    p = plain_kneser_ney([t for _, _, t in trusted])
    got = {r["doc_id"]: r["perplexity"] for r in quality_model.judge(docs, spark.createDataFrame([(i, 1) for i, _, _ in trusted], labels)).collect()}
    assert len(got) == 40
    for i, _, t in rows:
        assert got[i] == pytest.approx(np.exp(-np.mean([np.log(p(w)) for w in plain_windows(t)])), rel=1e-4)


def test_junk_is_rejected_and_trusted_text_kept(spark, odd, none):
    f, labels = documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = {r["doc_id"]: r["kept"] for r in quality_model.judge(f, labels).collect()}
    good = [r["doc_id"] for r in labels.filter("quality = 1").collect()]
    junk = [r["doc_id"] for r in f.filter("text RLIKE '[%*#$&]{3} [^ ]+[%*#$&]{3} '").collect()]
    assert np.mean([judged[i] for i in good]) > 0.97 and not any(judged[i] for i in junk) and junk
    kept = quality_model.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (3, 4)").count() == 2
    assert quality_model.judge(none, labels).collect() == []
    assert all(r["kept"] for r in quality_model.judge(odd, labels.limit(0)).collect())


def test_languages_of_short_texts_have_fences(spark):
    f, labels = documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet")
    good = [r["text"] for r in f.join(labels.filter("quality = 1"), "doc_id").filter("lang = 'en' AND length(text) > 180").orderBy("doc_id").limit(30).collect()]
    rows = [(10_000 + 100 * k + i, t[:180], lang) for k, lang in enumerate(("xx", None)) for i, t in enumerate(good)]
    rows += [(10_090 + 100 * k + i, "%#*&$@" * 30, lang) for k, lang in enumerate(("xx", None)) for i in range(3)]
    more = f.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    judged = {r["doc_id"]: r["kept"] for r in quality_model.judge(more, labels).collect()}
    assert len(good) == 30 and {i for i, _, _ in rows if not judged[i]} == {i for i, t, _ in rows if t.startswith("%")}


# --- 8


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_classes_are_those_of_all_pairs(spark):
    f = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in f.collect()]
    words = rows[6][1].split()
    chain = [" ".join([f"edit{k}{j}" if j % 40 == 7 + k else w for j, w in enumerate(words)]) for k in range(6)]
    rows += [(1000 + k, t) for k, t in enumerate(chain)] + [(2000 + k, rows[3][1]) for k in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = rng.integers(1, 6, 400).astype(float), rng.integers(1, 6, 400).astype(float)
    p, q = a / a.sum(), b / b.sum()
    exact = sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in range(400))
    sigs = [near_dedup.signatures(np.zeros(400, int), x + np.uint64(k), w, 1)[0] for k in range(40) for w in (a, b)]
    estimate = np.mean([(sigs[2 * k] == sigs[2 * k + 1]).mean() for k in range(40)])
    assert estimate == pytest.approx(exact, abs=0.03)


def test_texts_that_differ_by_repeated_passages_meet(spark):
    rng, rows = np.random.default_rng(6), []
    for k in range(40):
        words = [f"w{k}x{j}" for j in rng.integers(0, 10**6, 320)]
        rows += [(2 * k, " ".join(words[:300])), (2 * k + 1, " ".join(words[:300] + words[300:] * (30 if k % 2 else 10)))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(40)) == 40
    assert got == brute_classes(rows)


def test_half_of_a_text_repeated_forty_times_keeps_its_link(spark):
    rows = []
    for k in range(12):
        words = [f"a{k}b{j}" for j in range(160)]
        half = words[:80]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + half * 40))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(12)) and got == brute_classes(rows)


def test_large_open_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "STARS", 1)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for j in rng.choice(120, 3, replace=False):
            words[j] = f"x{k}{j}"
        rows.append((k, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_of_odd_rows(odd, none):
    r = [(x["doc_id"], x["class_id"], x["class_size"]) for x in near_dedup.classes(odd).collect()]
    assert Counter(r)[(1, 1, 3)] == 2 and (2, 1, 3) in r
    assert (None, 5, 2) in r and (5, 5, 2) in r and {(3, 3, 1), (4, 4, 1)} <= set(r)
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 1, 3, 4, 5, 6, 7, 8]
    assert near_dedup.classes(none).collect() == []


# --- 9


def test_scores_of_odd_rows(odd, none):
    r = {x["doc_id"]: x for x in lm_score.score(odd).collect()}
    assert r[3]["n_words"] == r[4]["n_words"] == 0 and r[3]["log_score"] == 0
    assert r[1]["n_level0"] == 0 and r[1]["log_score"] > r[8]["log_score"] * r[1]["n_words"]
    assert lm_score.score(none).collect() == []


def test_many_blocks_agree_with_one(spark, monkeypatch):
    f = documents(spark)
    whole = sorted((r["doc_id"], r["n_level3"], round(r["log_score"], 6)) for r in lm_score.score(f).collect())
    parts = sorted((r["doc_id"], r["n_level3"], round(r["log_score"], 6)) for r in lm_score.score(spark.createDataFrame(f.select("doc_id", "text").collect(), "doc_id long, text string").repartition(9)).collect())
    assert whole == parts


def test_counts_beyond_32_bits_are_kept():
    a, b, most = 7 << 40, 9 << 40, (1 << 32) - 1  # what two blocks ask: key a of both, key b of the second
    asked = [(0, [a], [most]), (1, [a, b], [most, 5])]
    pdf = pd.DataFrame([(no, 0, blocks.pack_keys(np.array(k, np.uint64), 1), blocks.numbers(np.array(n, np.uint32))) for no, k, n in asked], columns=["block", "shard", "keys", "extra"])
    raw = [blocks.spread(x) for x in lm_score.answer(pdf)["extra"]]
    assert [np.frombuffer(x, f"u{len(x) // n}").tolist() for x, n in zip(raw, (1, 2), strict=True)] == [[2 * most], [2 * most, 5]]


def test_scores_under_counts_beyond_32_bits():
    b = blocks._block(0, [pa.array([1])], [pa.array([b"x"], pa.large_binary())])
    for count, total in ((3, 47 * 10**8), (5 * 10**9, 8 * 10**9)):
        r = lm_score.score_block(b, np.array([count], np.uint64), total, 3, 4).to_pylist()[0]
        assert r["n_level1"] == 1 and r["log_score"] == pytest.approx(np.log((count - 1) / total))


# --- 10


def test_short_and_repeated_items(spark, odd, none):
    docs = spark.createDataFrame([(1, "A b c d e f g h i j k l"), (2, "zz b c zz"), (3, "É b-c! d"), (4, None), (4, None), (None, "b c d e f g h i j k")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "b C d e f g h i j k"), (9, "b c"), (9, "b c"), (8, "--"), (7, None), (6, "é")], "item_id long, text string")
    r = {(x["doc_id"], x["n_words"]): (x["n_hit"], x["items"]) for x in decontaminate.contamination(docs, items).collect()}
    assert r == {(1, 12): (10, ["10", "9"]), (2, 4): (2, ["9"]), (3, 4): (2, ["9"]), (4, 0): (0, []), (None, 10): (10, ["10", "9"])}
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.clean(odd, items.limit(0)).count() == odd.count()
    assert decontaminate.contamination(none, items).collect() == []


# --- blocks


def test_blocks_survive_packing():
    b = blocks._block(7, [pa.array([1, None])], [pa.array([b"abc", b""], pa.large_binary())])
    c = blocks.unpack(7, b.pack())
    assert c.ids.to_pylist() == [1, None] and c.offsets.tolist() == [0, 3, 3] and (c.data == b.data).all()
    keys = np.unique(np.random.default_rng(0).integers(0, 2**48, 1000).astype(np.uint64))
    assert (blocks.unpack_keys(blocks.pack_keys(keys, 1)) == keys).all()


@pytest.mark.parametrize("n", [1, 7, 65_536, 1 << 20])
def test_placed_keys_keep_shards_apart_and_in_order(n):
    h = np.random.default_rng(1).integers(0, 2**64, 50_000, dtype=np.uint64)
    placed = np.unique(blocks.place(h, n))
    at = blocks.cuts(placed, n)
    assert len(placed) == len(np.unique(h)) and at[0] == 0 and at[-1] == len(placed) and len(at) == n + 1
    s = int(np.flatnonzero(np.diff(at))[-1])
    back = blocks.unpack_keys(blocks.pack_keys(placed[at[s] : at[s + 1]], n))
    assert ((back | np.uint64(s << blocks.key_bits(n))) == placed[at[s] : at[s + 1]]).all()


def test_shards_follow_the_bytes_of_the_files(spark, monkeypatch):
    few = runtime.shards_for(documents(spark))
    monkeypatch.setattr(runtime, "SHARD_TEXT", 10_000)
    many = runtime.shards_for(documents(spark))
    assert few == runtime.shards(spark) and many > 20
    f = documents(spark)
    assert sorted(map(tuple, suffix_dedup.report(f).collect())) == brute_repeats([(r["doc_id"], r["text"]) for r in f.collect()])


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Nothing:
                                @staticmethod
                                def isDefined():
                                    return False

                            return Nothing

                    return Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session)


def test_blocks_of_a_shuffled_table_are_written_first(spark):
    f = documents(spark)
    joined = f.join(f.select("doc_id").distinct(), "doc_id")
    assert blocks.steady(f) is f and blocks.steady(joined).inputFiles() != joined.inputFiles()
    drawn = f.withColumn("r", F.rand())
    assert all(blocks.steady(x) is not x for x in (drawn, f.limit(5), f.orderBy("doc_id"), f.mapInArrow(lambda b: b, f.schema)))


# --- pipeline


def test_mix_stage_of_odd_rows(spark, odd):
    import corpus_pipeline

    out = corpus_pipeline.mixed(spark, odd, SMALL)
    assert len(set(out.columns)) == len(out.columns) and {r["_size"] for r in out.collect()} == {7}
    assert {r["taken"] for r in out.collect()} == {3} and all(r["mix_taken"] > 0 for r in out.collect())
    assert out.filter("doc_id IN (3, 4)").count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "suffix_dedup", "decontamination", "mixing"]
    first = documents(spark)
    assert all(stage(spark, first, SMALL).columns == first.columns for _, stage in corpus_pipeline.STAGES[:-1])
    out = corpus_pipeline.run(spark, SMALL)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 100 and out.filter(F.col("taken") <= 0).count() == 0
    documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_items_without_an_id_hit_words_and_odd_rows_are_measured(spark, odd, none):
    benchmark = spark.createDataFrame([(None, "one two"), (7, "one two"), (8, None), (9, "")], "item_id long, text string")
    r = decontaminate.contamination(odd, benchmark).collect()
    assert len(r) == odd.count() and {(x["n_words"], x["n_hit"], tuple(x["items"])) for x in r if x["doc_id"] == 8} == {(2, 2, ("7",))}
    assert all(x["n_hit"] == 0 for x in r if x["doc_id"] in (3, 4, 7))
    only = decontaminate.contamination(odd, benchmark.filter("item_id IS NULL")).filter("doc_id = 8").first()
    assert (only["n_hit"], only["items"]) == (2, [])
    assert decontaminate.contamination(none, benchmark).collect() == []
