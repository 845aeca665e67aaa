"""Mixing sources to target weights by hash-threshold histograms (native).

Every document gets a uniform hash of its id. Words are summed by source and 12-bit hash bucket; the bucket in
which a source's budget is used up is refined by the next 12 bits, and so on. What remains is one threshold per
source, so the mix is a filter: nothing is sorted, and only histograms of at most 4096 buckets a source are shuffled.

Defined cases: null or empty text has size 0 and is taken 0 times; a null source is a source of its own, ordered
last; a null doc_id hashes as one fixed value; rows with one doc_id have one hash and are taken or left together, whatever
the bucket's edge; sources with equal room fill by name; very long texts are counted whole; the operator reads doc_id,
text and source, so other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD, cut, maybe_broadcast, null_key

DIGITS, LEVELS = 3, 3  # hex digits a level; 36 bits in all


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_hash(docs: DataFrame) -> DataFrame:
    """docs with _size, _key (of the source) and _hash."""
    return (
        docs.withColumn("_size", word_count(F.col("text")))
        .withColumn("_key", null_key("source"))
        .withColumn("_hash", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, DIGITS * LEVELS))
    )


def targets(sized: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """_key, _source_size, _target: the water level at which min(cap * size, level * weight) adds up to the share.

    One row a source enters the windows without partitions, after the sums by source.
    """
    by_name, by_room = Window.orderBy(F.col("_null"), F.col("source")), Window.orderBy(F.col("_room"), F.col("_key"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    num, den = share
    sums = sized.groupBy("_key", "source").agg(F.sum("_size").alias("_source_size"))
    level = (
        sums.withColumn("_null", F.col("source").isNull())
        .withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
        .withColumn("_room", F.col("_source_size").cast("double") / F.col("_w"))
        .withColumn("_left", num * F.sum("_source_size").over(every) - den * cap * F.coalesce(F.sum("_source_size").over(before), F.lit(0)))
        .withColumn("_parts", den * (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
        .withColumn("_capped", F.col("_source_size") * cap * F.col("_parts") <= F.col("_w") * F.col("_left"))
        .withColumn("_at", F.min(F.when(~F.col("_capped"), F.struct("_room", "_key", "_left", "_parts"))).over(every))
    )
    return level.select(
        "_key",
        "_source_size",
        F.when(F.col("_capped"), (F.col("_source_size") * cap).cast("double")).otherwise((F.col("_w") * F.col("_at._left")).cast("double") / F.col("_at._parts").cast("double")).alias("_target"),
    )


def thresholds(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """A row a source: _source_size, _target, _epochs (full passes), _edge (boundary bucket), _take_edge."""
    goal = targets(sized, weights, share, cap)
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0).cast("long")
    state = goal.withColumn("_epochs", epochs).withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_source_size"))
    state = state.withColumns({"_edge": F.lit(""), "_below": F.lit(0).cast("long"), "_take_edge": F.lit(False)})
    for level in range(LEVELS):
        state = cut(state, f"mix-level{level}")
        here = maybe_broadcast(state.filter("_rest > 0").select("_key", "_edge", "_rest", "_below"))
        parts = sized.select("_key", "_hash", "_size").join(here, "_key")
        if level:
            parts = parts.filter(F.col("_hash").startswith(F.col("_edge")))
        sums = parts.groupBy("_key", "_rest", "_below", F.substring("_hash", 1, DIGITS * (level + 1)).alias("_bucket")).agg(F.sum("_size").alias("_sum"))
        upto = Window.partitionBy("_key").orderBy("_bucket")
        edge = (
            sums.withColumn("_upto", F.sum("_sum").over(upto) + F.col("_below"))
            .filter(F.col("_upto") > F.col("_rest"))
            .groupBy("_key", "_rest")
            .agg(F.min(F.struct("_bucket", "_upto", "_sum")).alias("_first"))
            .select("_key", F.col("_first._bucket").alias("_edge"), (F.col("_first._upto") - F.col("_first._sum")).alias("_below"), (F.col("_first._upto") - F.col("_rest") < F.col("_rest") - F.col("_first._upto") + F.col("_first._sum")).alias("_take_edge"))
        )
        state = state.drop("_edge", "_below", "_take_edge").join(edge, "_key", "left").withColumns({"_edge": F.coalesce("_edge", F.lit("")), "_below": F.coalesce("_below", F.lit(0).cast("long")), "_take_edge": F.coalesce("_take_edge", F.lit(False))})
    return cut(state, "mix-thresholds")


def mix(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """sized (see with_hash) with _source_size, _target and _taken, the words that the mix takes of each row."""
    inside = (F.col("_hash") < F.col("_edge")) | (F.col("_take_edge") & (F.col("_hash") == F.col("_edge")))
    few = maybe_broadcast(limits.select("_key", "_source_size", "_target", "_epochs", "_edge", "_take_edge"))
    return sized.join(few, "_key").withColumn("_taken", F.col("_size") * (F.col("_epochs") + F.when(inside, 1).otherwise(0))).drop("_epochs", "_edge", "_take_edge")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs(doc_id, text, source)."""
    sized = cut(with_hash(docs.select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    return mix(sized, thresholds(sized, **options)).select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))
