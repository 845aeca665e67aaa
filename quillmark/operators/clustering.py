"""Per-document clustering results, and the kernel that makes them.

Everything around the kernel is windows and aggregates by document. One pass over a document's rows in Arrow applies
the guards and, where none decides, the kernel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, FEATURES, SEMANTIC, Config
from ..functions import numeric as N
from ..functions import text as T
from . import kernel


def by_doc():
    return Window.partitionBy("doc_id").orderBy("paragraph_index")


def boundaries(labels: DataFrame) -> DataFrame:
    """(doc_id, after_paragraph, from_cluster, to_cluster, is_anomaly_transition) where the label changes."""
    last = labels.withColumns({"from_cluster": F.lag("cluster_id").over(by_doc()), "after_paragraph": F.lag("paragraph_index").over(by_doc())})
    changed = last.filter("from_cluster IS NOT NULL AND from_cluster <> cluster_id")
    return changed.select("doc_id", "after_paragraph", "from_cluster", F.col("cluster_id").alias("to_cluster"), ((F.col("from_cluster") == -1) | (F.col("cluster_id") == -1)).alias("is_anomaly_transition"))


def boundary_pairs(labels: DataFrame, first: int = 3) -> DataFrame:
    """Texts on both sides of the first anomaly boundaries of each document."""
    following = labels.withColumns({"_next": F.lead("cluster_id").over(by_doc()), "text_after": F.lead("text").over(by_doc())})
    hit = following.filter("_next IS NOT NULL AND _next <> cluster_id AND (_next = -1 OR cluster_id = -1)").withColumn("_n", F.row_number().over(by_doc())).filter(F.col("_n") <= first)
    return hit.select("doc_id", F.col("paragraph_index").alias("after_paragraph"), F.col("text").alias("text_before"), "text_after")


def enrich(paragraphs: DataFrame, labels: DataFrame) -> DataFrame:
    """paragraphs with cluster_id (0 where there is none), is_anomaly and cluster_label."""
    joined = paragraphs.join(labels.select("doc_id", "paragraph_index", "cluster_id"), ["doc_id", "paragraph_index"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)))
    return joined.withColumns({"is_anomaly": F.col("cluster_id") == -1, "cluster_label": T.cluster_label(F.col("cluster_id"))})


def sizes(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cluster_sizes): a map from label to count, as JSON keys are."""
    counted = labels.groupBy(key, "cluster_id").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("cluster_id").cast("string").alias("k"), "n")))).alias("cluster_sizes"))


def summary(labels: DataFrame, config: Config = DEFAULT, key: str = "doc_id") -> DataFrame:
    """Authors, anomalies, noise and confidence of each document from (cluster_id, probability), and noise_override from outcome, where there is one."""
    rows = labels.groupBy(key).agg(*summary_aggregates(labels.columns, config))
    return rows.select(key, *summary_columns())


def summary_aggregates(columns: list[str], config: Config = DEFAULT) -> list:
    """The aggregates of summary(), for a group of which other aggregates are taken too."""
    noise = F.avg((F.col("cluster_id") == -1).cast("double"))
    override = F.bool_or(F.col("outcome") == "noise_override") if "outcome" in columns else noise > config.noise_limit
    return [
        F.count("cluster_id").alias("paragraph_count"),
        F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("_authors"),
        F.count_if(F.col("cluster_id") == -1).alias("anomaly_count"),
        noise.alias("_noise"),
        F.coalesce(F.avg(F.when(F.col("cluster_id") != -1, F.col("probability"))), F.lit(0.5)).alias("_sure"),
        override.alias("noise_override"),
    ]


def summary_columns() -> list:
    """The columns of summary() over its aggregates."""
    few = F.when(F.col("_authors").between(1, 5), 1.0).otherwise(0.7)
    score = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("_sure") * F.greatest(F.lit(0.0), 1 - 2 * F.col("_noise")) * few))
    return ["paragraph_count", F.col("_authors").alias("estimated_authors"), "anomaly_count", N.round_even(F.col("_noise"), 4).alias("noise_percentage"), N.round_even(score, 4).alias("confidence"), "noise_override"]


def scaled(vectors: DataFrame, column: str, key: str) -> DataFrame:
    """vectors with (key, dimension, value) standardised by key: mean 0, population deviation 1; constant dimensions are dropped."""
    flat = vectors.select(key, "item", F.posexplode(column).alias("dimension", "value")).withColumn("value", F.col("value").cast("double"))
    of = Window.partitionBy(key, "dimension")
    spread = flat.withColumns({"_mean": F.avg("value").over(of), "_var": F.var_pop("value").over(of)})
    return spread.filter("_var >= 1e-10").select(key, "item", "dimension", ((F.col("value") - F.col("_mean")) / F.sqrt("_var")).alias("z"))


def variance_mask(vectors: DataFrame, column: str, key: str, least: float = 1e-10) -> DataFrame:
    """(key, n_variable): dimensions whose population variance isn't nil."""
    flat = vectors.select(key, F.posexplode(column).alias("dimension", "value"))
    spread = flat.groupBy(key, "dimension").agg(F.var_pop(F.col("value").cast("double")).alias("_var"))
    return spread.groupBy(key).agg(F.count_if(F.col("_var") >= least).alias("n_variable"), F.count("*").alias("n_dimensions"))


def guards(features: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, ..., outcome): which rule, in order, decides a document before the kernel."""
    varying = sum(((F.coalesce(F.var_pop(f), F.lit(0.0)) >= config.least_variance).cast("int") for f in FEATURES), F.lit(0))
    stats = features.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.count_if("is_valid").alias("n_valid"), varying.alias("n_varying"))
    outcome = (
        F.when((F.col("n_paragraphs") < config.min_paragraphs) | (F.col("n_valid") < config.min_valid_to_cluster), "skipped")
        .when(F.col("n_paragraphs") < 2 * config.min_cluster_size, "too_short")
        .when(F.col("n_varying") == 0, "zero_variance")
        .when(F.col("n_varying") < 2, "one_column")
        .otherwise("cluster")
    )
    return stats.withColumn("outcome", outcome)


def label(features: DataFrame, config: Config = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, paragraph_index, cluster_id, probability, outcome, carry...) of every paragraph; outcome is the document's.

    One pass over whole documents: their guards are judged beside the kernel, so features are computed and moved once.
    Rows are dealt and sorted by document, and a task takes the documents of a batch after each other; one that goes on in
    the next batch waits for it.
    Rows without a paragraph_index stand for documents without paragraphs and pass with null labels. Where features has
    a column `vector`, its principal components over the valid paragraphs join the features (0 for the others).
    """
    kinds = dict(features.dtypes)
    columns, more = [c for c in (*FEATURES, *SEMANTIC) if c in kinds], ["vector"] if "vector" in kinds else []
    schema = f"doc_id {kinds['doc_id']}, paragraph_index int, cluster_id int, probability double, outcome string" + "".join(f", {c} {kinds[c]}" for c in carry)
    weighed = sum(c in SEMANTIC for c in columns) + 3 * len(more)

    def starts(rows: pa.Table) -> np.ndarray:
        """Where each document begins."""
        ids = rows["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))

    def told(rows: pa.Table, begin: np.ndarray) -> list[pa.RecordBatch]:
        there, valid = rows["paragraph_index"].is_valid().to_numpy(), rows["is_valid"].to_numpy().astype(bool)
        x, vectors = np.column_stack([rows[c].to_numpy() for c in columns]), rows["vector"].to_pylist() if more else None
        labels, probability, outcomes = np.zeros(len(x), np.int32), np.ones(len(x)), []
        sizes = np.diff(np.append(begin, len(x)))
        for at, n in zip(begin.tolist(), np.add.reduceat(there, begin, dtype=int).tolist(), strict=True):  # nulls are last
            mine, ok = x[at : at + n], valid[at : at + n]
            if more:
                mine = np.hstack([mine, semantic(vectors[at : at + n], ok)])
            outcome = kernel.guard(mine, ok, config)
            if outcome == "cluster":
                labels[at : at + n], probability[at : at + n], outcome = kernel.cluster(mine, config, weighed)
            outcomes.append(outcome)
        known = pa.array(outcomes, pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        made = {"doc_id": rows["doc_id"], "paragraph_index": rows["paragraph_index"], "cluster_id": pa.array(labels, pa.int32(), mask=~there), "probability": pa.array(probability, pa.float64(), mask=~there), "outcome": known}
        return pa.table(made | {c: rows[c] for c in carry}).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if len(rows):
                begin = starts(rows)
                held = rows.slice(begin[-1])
                if len(begin) > 1:
                    yield from told(rows.slice(0, begin[-1]), begin[:-1])
        if held is not None:
            yield from told(held, np.zeros(1, int))

    whole = features.select("doc_id", "paragraph_index", "is_valid", *columns, *more, *carry).repartition("doc_id")
    return whole.sortWithinPartitions("doc_id", F.asc_nulls_last("paragraph_index")).mapInArrow(run, schema)


def semantic(vectors: list, valid: np.ndarray) -> np.ndarray:
    """Three components for each row: of the vectors of valid rows that have one, else 0."""
    out, usable = np.zeros((len(vectors), 3)), valid & np.array([v is not None for v in vectors], bool)
    if usable.any():
        out[usable] = kernel.pca(np.array([v for v, ok in zip(vectors, usable, strict=True) if ok], float))
    return out


def colours(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cluster_id, hue, app_hue): hues dealt by the rank of the label among those that aren't noise, and by the label itself."""
    one = labels.filter("cluster_id <> -1").select(key, "cluster_id").distinct()
    n, rank = F.count("*").over(Window.partitionBy(key)), F.dense_rank().over(Window.partitionBy(key).orderBy("cluster_id")) - 1
    return one.select(key, "cluster_id", ((rank * 360.0 / n + 220) % 360).alias("hue"), (F.col("cluster_id") * 360.0 / n % 360).alias("app_hue"))


def highlighted(enriched: DataFrame, cluster: int) -> DataFrame:
    """The paragraphs of one cluster (-1: the anomalies), as a reader's filter shows them."""
    return enriched.filter(F.col("cluster_id") == cluster)


def result(labels: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, clustering): the cluster result as one struct of eleven fields. labels is what label() gives."""
    at, step = F.struct("paragraph_index", "cluster_id"), lambda a, b: (a["cluster_id"] == -1) | (b["cluster_id"] == -1)
    rows = labels.filter("paragraph_index IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(at)).alias("_l"), F.max("outcome").alias("_outcome"), *summary_aggregates(labels.columns, config))
    pairs = F.when(F.size("_l") > 1, F.transform(F.sequence(F.lit(0), F.size("_l") - 2), lambda i: F.struct(F.get("_l", i).alias("a"), F.get("_l", i + 1).alias("b")))).otherwise(F.expr("slice(array(struct(_l[0] AS a, _l[0] AS b)), 1, 0)"))
    changes = F.transform(F.filter(pairs, lambda x: x["a"]["cluster_id"] != x["b"]["cluster_id"]), lambda x: F.struct(x["a"]["paragraph_index"].alias("after_paragraph"), x["a"]["cluster_id"].alias("from_cluster"), x["b"]["cluster_id"].alias("to_cluster"), step(x["a"], x["b"]).alias("is_anomaly_transition")))
    clusters = F.transform("_l", lambda x: x["cluster_id"])
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(clusters)), lambda c: F.struct(c.cast("string"), F.size(F.filter(clusters, lambda k: k == c)))))
    told = rows.select("doc_id", "_l", "_outcome", *summary_columns()).withColumn("boundaries", changes)
    return told.select(
        "doc_id",
        F.struct(
            clusters.alias("clusters"),
            "estimated_authors",
            F.transform(F.filter("_l", lambda x: x["cluster_id"] == -1), lambda x: x["paragraph_index"]).alias("anomaly_indices"),
            "anomaly_count",
            "boundaries",
            F.size("boundaries").alias("boundary_count"),
            "noise_percentage",
            counts.alias("cluster_sizes"),
            "confidence",
            "noise_override",
            (F.col("_outcome").isin("skipped", "too_short") | (F.size("_l") < 2 * config.min_cluster_size)).alias("too_short"),
        ).alias("clustering"),
    )
