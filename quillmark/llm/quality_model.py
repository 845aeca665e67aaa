"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model (Chen & Goodman 1999) of trusted text.

The model is one of characters, ORDER at a time, over all languages, so a quoted passage in another one is no fault.
It is fitted on all trusted texts. Counts, continuation counts, sums over contexts and the
interpolation with the next lower order are joins and aggregates of count tables partitioned by n-gram hash, and so
is scoring: blocks of texts send the shards their distinct n-grams and get back probabilities and backoff weights.

A text's log-perplexity is drawn to its language's median by PRIOR characters, so a short text needs strong evidence,
and texts beyond a fence set by the language's quantiles of what is so drawn are rejected. Median and quantiles are
over all documents of any length, so every language with a scored text has a fence.

Defined cases: null and empty texts have no evidence against them and are kept, with null perplexity; null languages
are a language of their own; without any trusted text there is no model and all are kept; repeated rows get equal
verdicts; a text on its fence is kept; very long texts are scored whole, in blocks of their own; a document with several
labels is trusted if one of them is 1; keep_good() carries all other columns, whatever their names (but _row); an empty
table gives no rows. Code points beyond 16 bits are folded to 16.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .runtime import cut, maybe_broadcast, null_key, shards_for

ORDER = 4
#: Fence: median + REACH * (upper quartile - median), at least MARGIN nats a character above the median.
PRIOR, REACH, MARGIN = 200, 6.0, 0.2
#: A character that the trusted texts lack has this share of the lowest order's backoff weight.
UNSEEN = 1000
_MASKS = [np.uint64((1 << 16 * k) - 1) for k in range(ORDER + 1)]
_SALT = 0x9E3779B97F4A7C15
MODEL = pa.schema([("k", pa.int32()), ("gram", pa.int64()), ("context", pa.int64()), ("suffix", pa.int64()), ("n", pa.int64())])


def windows(b: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """For every character of the block: itself in the low 16 bits, the one before above, and so on (0 before a text); and its row."""
    low = b.data[: b.size]
    ends = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80, dtype=np.int32)])[b.offsets]
    points = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    here = ((points ^ (points >> 16)) & 0xFFFF).astype(np.uint16)
    row = np.repeat(np.arange(len(b.offsets) - 1, dtype=np.int32), np.diff(ends))
    packed = here.astype(np.uint64)
    starts = ends[:-1][np.diff(ends) > 0]
    for k in range(1, ORDER):
        packed.view("<u2").reshape(-1, 4)[k:, k] = here[:-k]
    for k in range(1, ORDER):  # what reaches back into the text before
        at = starts + k - 1
        near = np.append(starts[1:], len(points))
        at = at[at < near]
        packed[at] &= _MASKS[k]
    return packed, row


def _hash(packed: np.ndarray, k: int) -> np.ndarray:
    return B.mix(B.mix(packed & _MASKS[k]) + np.uint64(k * _SALT % (1 << 64)))


def _rows(docs: DataFrame) -> DataFrame:
    row = F.xxhash64("doc_id", "lang", "text")
    return docs.select(F.struct("doc_id", null_key("lang").alias("lang"), row.alias("row")).alias("doc_id"), "text")


def _distinct(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.sort(packed)
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, int)
    return packed[first], np.diff(np.append(first, len(packed)))


def count(trusted: DataFrame) -> DataFrame:
    """(k, gram, context, suffix, n) of distinct n-grams of the highest order, and of the lower ones that end them, by block."""

    def run(batches):
        for b in B.read_blocks(batches):
            keys, n = _distinct(windows(b)[0])
            for k in range(ORDER, 0, -1):
                if k < ORDER:
                    keys, n = _distinct(keys & _MASKS[k])
                signed = lambda x: pa.array(x.view(np.int64))
                yield pa.record_batch([pa.array(np.full(len(keys), k, np.int32)), signed(_hash(keys, k)), signed(_hash(keys >> np.uint64(16), k - 1)), signed(_hash(keys, k - 1)), pa.array(n.astype(np.int64))], schema=MODEL)

    return B.scan(trusted).mapInArrow(run, "k int, gram long, context long, suffix long, n long")


def fit(trusted: DataFrame) -> DataFrame:
    """(gram, p, gamma): probability of each n-gram's last character given the others, and the backoff weight of it as a context."""
    counts = cut(count(_rows(trusted)).groupBy("k", "gram", "context", "suffix").agg(F.sum("n").alias("n")), "quality-counts")
    left = counts.groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(F.count("*").alias("_left"))  # different characters before
    used = counts.filter(f"k = {ORDER}").unionByName(counts.filter(f"k < {ORDER}").join(left, ["k", "gram"]).withColumn("n", F.col("_left")).drop("_left"))
    used = cut(used, "quality-used")
    tally = {(r["k"], r["c"]): r["n"] for r in used.filter("n <= 4").groupBy("k", F.col("n").alias("c")).agg(F.count("*").alias("n")).collect()}  # four counts for each order
    symbols = used.filter("k = 1").count()
    found, lower = None, None
    for k in range(1, ORDER + 1):
        n = [tally.get((k, c), 0) for c in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(max(c - (c + 1) * y * n[c + 1] / n[c], 0.1), c) * 0.999 if n[c] and c < 4 else 0.5 * c for c in (1, 2, 3)]
        here = used.filter(f"k = {k}")
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        sums = here.groupBy("context").agg(F.sum("n").alias("_all"), F.sum(off).alias("_off"))
        own = here.join(sums, "context").withColumns({"_share": (F.col("n") - off) / F.col("_all"), "gamma": F.col("_off") / F.col("_all")})
        if k == 1:
            level = own.select("gram", "context", "gamma", (F.col("_share") + F.col("gamma") / (symbols + 1)).alias("p"))
        else:
            level = own.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("_p")), "suffix").select("gram", "context", "gamma", (F.col("_share") + F.col("gamma") * F.col("_p")).alias("p"))
        lower = cut(level, f"quality-level{k}")
        as_context = lower.groupBy(F.col("context").alias("gram")).agg(F.first("gamma").alias("gamma"))
        rows = lower.select("gram", "p", F.lit(None).cast("double").alias("gamma")).unionByName(as_context.select("gram", F.lit(None).cast("double").alias("p"), "gamma"))
        found = rows if found is None else found.unionByName(rows)
    return cut(found.groupBy("gram").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma")), "quality-model")


def _questions(b: B.Block, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's windows, their rows, the distinct windows, and the distinct placed keys of all orders."""
    packed, row = windows(b)
    keys, _ = _distinct(packed)
    placed = []
    for k in range(ORDER + 1):
        placed.append(B.place(_hash(keys if k == ORDER else np.unique(keys & _MASKS[k]), k), n_shards))
        if 0 < k < ORDER:  # contexts that no shorter window ends with
            placed.append(B.place(_hash(np.unique((keys >> np.uint64(16)) & _MASKS[k]), k), n_shards))
    return packed, row, keys, np.unique(np.concatenate(placed))


def ask(rows: DataFrame, n_shards: int) -> DataFrame:
    def run(batches):
        for b in B.read_blocks(batches):
            yield B.questions(b, _questions(b, n_shards)[3], n_shards, lambda i, j: b"")

    return B.scan(rows).mapInArrow(run, B.QUESTION_DDL)


def _answer(_, asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """p and gamma (not a number where there is none) of each key that a block asked for, in the block's order."""
    order = np.argsort(model["key"].values)
    key, p, gamma = (model[c].values[order] for c in ("key", "p", "gamma"))
    out = []
    for blob in asked["keys"]:
        keys = B.unpack_keys(blob).view(np.int64)
        at = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
        ok = key[at] == keys if len(key) else np.zeros(len(keys), bool)
        pair = np.full((2, len(keys)), np.nan, np.float32)
        pair[0, ok], pair[1, ok] = p[at[ok]], gamma[at[ok]]
        out.append(B.numbers(pair))
    return pd.DataFrame({"block": asked["block"].values, "shard": asked["shard"].values, "keys": [b""] * len(asked), "extra": out})


def lookup(keys: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Where each query is among distinct keys, all of which are there: a table of slots, and another for what collides."""
    tables, open_k, salt = [], np.arange(len(keys)), 0x9E3779B97F4A7C15
    slot = lambda x, bits, salt: ((x ^ (x >> np.uint64(29))) * np.uint64(salt)) >> np.uint64(64 - bits)
    while len(open_k):
        bits = max(int(np.ceil(np.log2(len(open_k)))) + 3, 8)
        table = np.zeros(1 << bits, np.int32)
        at = slot(keys[open_k], bits, salt)
        table[at] = open_k
        tables.append((table, bits, salt))
        open_k = open_k[table[at] != open_k]
        salt = (salt * 0xBF58476D1CE4E5B9 + 0xA0761D6478BD642E) % (1 << 64) | 1
    out = np.empty(len(queries), np.int32)
    for i in range(0, len(queries), 1 << 18):  # pieces that stay in a processor's cache
        part = queries[i : i + (1 << 18)]
        open_q = np.arange(len(part))
        for table, bits, salt in tables:
            found = table[slot(part[open_q], bits, salt)]
            out[i + open_q] = found
            open_q = open_q[keys[found] != part[open_q]]
    return out


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang key, row hash, n_chars, nats) of each row of docs(doc_id, lang, text); nats is null without a model."""
    rows = B.steady(_rows(docs))
    n = shards_for(rows)
    parts = F.expr(f"cast((shiftrightunsigned(gram, 32) * {n}L) div 4294967296 as int)")
    tables = model.select(parts.alias("shard"), F.expr(f"gram & {(1 << B.key_bits(n)) - 1}L").alias("key"), "p", "gamma")
    answers = ask(rows, n).groupBy("shard").cogroup(tables.groupBy("shard")).applyInPandas(lambda key, a, m: _answer(key, a, m), B.QUESTION_DDL)
    kind = dict(docs.dtypes)["doc_id"]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        body = pdf["shard"].values == -1
        b, told = B.unpack(int(pdf["block"].iloc[0]), pdf["keys"][body].iloc[0]), pdf[~body].sort_values("shard")
        packed, row, keys, placed = _questions(b, n)
        pairs = [np.frombuffer(B.spread(x), np.float32).reshape(2, -1) for x in told["extra"]]
        p, gamma = np.concatenate(pairs, 1).astype(float) if pairs else np.zeros((2, 0))
        if len(p) != len(placed):
            raise RuntimeError(f"block {b.no} isn't the block that asked: {len(placed)} keys, {len(p)} answers")
        find = lambda x, k: np.searchsorted(placed, B.place(_hash(x, k), n))
        nats = np.full(len(b.ids), np.nan)
        root = gamma[find(keys[:1], 0)]
        if len(keys) and not np.isnan(root[0]):  # else there is no model
            best = p[find(keys, 1)]
            best[np.isnan(best)] = root[0] / UNSEEN
            for k in range(2, ORDER + 1):
                own, back = p[find(keys, k)], gamma[find(keys >> np.uint64(16), k - 1)]
                best = np.where(np.isnan(own), np.where(np.isnan(back), 1.0, back) * best, own)
            nats = np.bincount(row, -np.log(best)[lookup(keys, packed)], len(b.ids))
        chars = np.bincount(row, minlength=len(b.ids))
        nats = pd.Series(nats).where((chars > 0) & ~np.isnan(nats), None).astype("Float64")
        column = lambda c: b.ids.field(c).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        return pd.DataFrame({"doc_id": column("doc_id"), "_lang": column("lang"), "_row": column("row"), "n_chars": chars, "nats": nats})

    return B.packed_blocks(rows).unionByName(answers).groupBy("block").applyInPandas(finish, f"doc_id {kind}, _lang string, _row long, n_chars long, nats double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, _lang, _row, n_chars, perplexity, cutoff, kept for each row of docs. labels(doc_id, quality) mark trusted text by 1."""
    good = maybe_broadcast(cut(labels.filter("quality = 1").select("doc_id").distinct(), "quality-trusted"))
    trusted = docs.select("doc_id", "lang", "text").join(good, "doc_id", "left_semi")
    scored = cut(score(docs.select("doc_id", "lang", "text"), fit(trusted)).withColumn("_mean", F.col("nats") / F.col("n_chars")), "quality-scores")
    measured = scored.filter("nats IS NOT NULL")
    middle = maybe_broadcast(cut(measured.groupBy("_lang").agg(F.percentile_approx("_mean", 0.5, 10000).alias("_median")), "quality-medians"))
    drawn = (F.col("nats") + PRIOR * F.col("_median")) / (F.col("n_chars") + PRIOR)
    marks = measured.join(middle, "_lang").groupBy("_lang", "_median").agg(F.percentile_approx(drawn, [0.5, 0.75], 10000).alias("_q"))
    fence = F.col("_q")[0] + F.greatest(REACH * (F.col("_q")[1] - F.col("_q")[0]), F.lit(MARGIN))
    limits = maybe_broadcast(cut(marks.select("_lang", "_median", fence.alias("_fence")), "quality-fences"))
    return scored.join(limits, "_lang", "left").select("doc_id", "_lang", "_row", "n_chars", F.exp("_mean").alias("perplexity"), F.exp("_fence").alias("cutoff"), F.coalesce(drawn <= F.col("_fence"), F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps."""
    bad = cut(judge(docs, labels).filter("NOT kept").select("_row").distinct(), "quality-rejects")
    return docs.join(maybe_broadcast(bad), F.xxhash64(docs["doc_id"], docs["lang"], docs["text"]) == bad["_row"], "left_anti")
