"""Benchmark decontamination by winnowing (native).

Fingerprints are hashes of K words; of every WINDOW neighbouring hashes the least is kept, so any shared span of
K + WINDOW - 1 = SPAN words shares a kept fingerprint. Documents that share one with the benchmark are extended
exactly: their SPAN-word windows are matched, as text, with those of the items. Items of fewer words are one
window each and are matched by windows of their own length over all documents.

Defined cases: null or empty texts have no words; items without words match nothing; repeated items count once by
item_id; an item whose item_id is null hits words like any other, but has no name, so items leaves it out; repeated documents get equal rows; very long texts are matched whole, each in its row; overlapping hits count
each word once; only ids and texts are read, and clean() carries all other columns, whatever their names (but _leak_id
and _leak_text); empty tables give no hits or no rows. The benchmark is broadcast only
below a checked number of windows, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, maybe_broadcast

#: A word: a run of ASCII letters and digits and of code points from 128 on. Java matches these classes twice as fast as the same set in ranges.
TOKEN = r"[\p{Alnum}\P{ASCII}]+"
K, SPAN = 5, 10
WINDOW = SPAN - K + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Only A-Z are lowered; lower() may be used where all is ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(TOKEN), F.lit(0))


def fingerprints(hashes: str) -> Column:
    """Of the K-word hashes, the kept ones; null for texts under SPAN words.

    hashes is named more than once, so Spark keeps it a column instead of computing it anew for each element.
    """
    least = lambda i: F.array_min(F.slice(F.col(hashes), i + 1, WINDOW))
    return F.when(F.size(hashes) >= WINDOW, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), least)))


def gram_hashes(array: str) -> Column:
    at = lambda i: F.get(F.col(array), i)
    return F.when(F.size(array) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(array) - K), lambda i: F.xxhash64(*(at(i + k) for k in range(K)))))


def windows(array: str, length: int) -> Column:
    """(start, text) of each window of the length."""
    of = lambda i: F.struct(i.alias("start"), F.concat_ws(" ", F.slice(F.col(array), i + 1, length)).alias("text"))
    return F.when(F.size(array) >= length, F.transform(F.sequence(F.lit(0), F.size(array) - length), of))


def covered(spans: str) -> Column:
    """Words inside the union of (start, length) spans."""
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["length"]).alias("end"))
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the same id and text are one document here."""
    return docs.select("doc_id", "text").withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_text": F.xxhash64("text")})


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_id, _text, n_hit, items) of the documents that are hit."""
    items = cut(benchmark.select(F.col("item_id").cast("string").alias("item"), words("text").alias("_words")).filter("size(_words) > 0"), "leaks-items")
    long_items = items.filter(f"size(_words) >= {SPAN}").withColumn("_hashes", gram_hashes("_words"))
    marks = maybe_broadcast(cut(long_items.select(F.explode_outer(fingerprints("_hashes")).alias("_mark")).filter("_mark IS NOT NULL").distinct(), "leaks-marks"))
    keyed = _keyed(docs)
    hashed = keyed.select("_id", "_text", words("text").alias("_words")).withColumn("_hashes", gram_hashes("_words"))
    own = hashed.select("_id", "_text", fingerprints("_hashes").alias("_marks")).select("_id", "_text", F.explode_outer("_marks").alias("_mark"))
    suspects = maybe_broadcast(cut(own.join(marks, "_mark", "left_semi").select("_id", "_text").distinct(), "leaks-suspects"))
    found = _matches(keyed.join(suspects, ["_id", "_text"], "left_semi"), items.filter(f"size(_words) >= {SPAN}"), SPAN)
    for length in sorted(r[0] for r in items.select(F.size("_words").alias("n")).filter(f"n < {SPAN}").distinct().collect()):  # 9 lengths at most
        found = found.unionByName(_matches(keyed, items.filter(F.size("_words") == length), length))
    spans = found.groupBy("_id", "_text").agg(F.collect_set(F.struct("start", "length")).alias("_spans"), F.array_sort(F.collect_set("item")).alias("items"))
    return spans.select("_id", "_text", covered("_spans").cast("long").alias("n_hit"), "items")


def _matches(keyed: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """(_id, _text, start, length, item): windows of documents that are windows of items.

    explode_outer, as for explode() Spark would filter by the size of the windows first and compute them twice.
    """
    of_items = maybe_broadcast(cut(items.select("item", F.explode_outer(windows("_words", length)).alias("w")).select("item", F.col("w.text").alias("_window")).filter("_window IS NOT NULL").distinct(), "leaks-windows"))
    of_docs = keyed.select("_id", "_text", words("text").alias("_words")).select("_id", "_text", F.explode_outer(windows("_words", length)).alias("w"))
    return of_docs.select("_id", "_text", F.col("w.start").alias("start"), F.col("w.text").alias("_window")).join(of_items, "_window").select("_id", "_text", "start", F.lit(length).alias("length"), "item")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each row of docs(doc_id, text) as doc_id, n_words, n_hit, items (array of item ids as text)."""
    found = maybe_broadcast(cut(hits(docs, benchmark), "leaks-hits"))
    counts = _keyed(docs).select("doc_id", "_id", "_text", F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_words"))
    return counts.join(found, ["_id", "_text"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that no window of the benchmark hits."""
    found = maybe_broadcast(cut(hits(docs, benchmark).select("_id", "_text"), "leaks-hits"))
    found = found.withColumnsRenamed({"_id": "_leak_id", "_text": "_leak_text"})
    same = (F.coalesce(docs["doc_id"].cast("string"), F.lit("null")) == found["_leak_id"]) & (F.xxhash64(docs["text"]) == found["_leak_text"])
    return docs.join(found, same, "left_anti")
