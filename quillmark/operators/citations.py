"""Citation forensics: extraction in the row, baselines as window aggregates by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import numeric as N
from ..functions import text as T

def extract(paragraphs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """paragraphs with citations, citation_count, years, median_year."""
    found = paragraphs.withColumn("citations", T.citations("text")).withColumn("years", T.years("citations", *config.years))
    return found.withColumns({"citation_count": F.size("citations"), "median_year": N.median_year("years")})


def _halves_even(value):
    return F.bround(value, 0).cast("int")


def baselines(cited: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, core_median, noise_median, year_difference, is_anomalous) over all citation years, by cluster side."""
    years = cited.select("doc_id", "cluster_id", F.explode("years").alias("year"))
    side = lambda noise: _halves_even(F.median(F.when((F.col("cluster_id") == -1) == F.lit(noise), F.col("year"))))
    both = years.groupBy("doc_id").agg(side(False).alias("core_median"), side(True).alias("noise_median"))
    gap = F.abs(F.col("noise_median") - F.col("core_median"))
    return both.withColumns({"year_difference": gap, "is_anomalous": F.coalesce(gap > config.year_gap, F.lit(False))})


def temporal_anomalies(cited: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Paragraphs whose median year lies more than year_gap from their document's core median. One shuffle, by document."""
    core = F.flatten(F.collect_list(F.when(F.col("cluster_id") != -1, F.col("years"))).over(Window.partitionBy("doc_id")))
    rows = cited.select("doc_id", "paragraph_index", "median_year", "cluster_id", "years").withColumn("baseline_year", N.median_year(core))
    far = rows.withColumn("year_difference", F.abs(F.col("median_year") - F.col("baseline_year"))).filter(F.col("year_difference") > config.year_gap)
    return far.select("doc_id", "paragraph_index", "median_year", "baseline_year", "year_difference", "cluster_id", (F.col("cluster_id") == -1).alias("is_noise_cluster"), T.severity(F.col("year_difference")).alias("severity"))


def anomaly_query(labelled: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The anomalies of labelled(doc_id, paragraph_index, text, cluster_id) by themselves: citations are extracted here, and no noise flag is told."""
    return temporal_anomalies(extract(labelled, config), config).drop("is_noise_cluster")


def with_citations(cited: DataFrame) -> DataFrame:
    """The paragraphs that cite."""
    return cited.filter("citation_count > 0")


def density(words=None):
    """Citations a 100 words of a paragraph's row."""
    return F.col("citation_count") / F.greatest(T.word_count("text") if words is None else words, F.lit(1)) * 100


def densities(cited: DataFrame) -> DataFrame:
    """(doc_id, core_density, noise_density, density_ratio): means of the unrounded densities by side, 0 for an empty side; the ratio is of the rounded means."""
    side = lambda noise: F.coalesce(N.round_even(F.avg(F.when((F.col("cluster_id") == -1) == F.lit(noise), F.col("_d"))), 4), F.lit(0.0))
    both = cited.withColumn("_d", density()).groupBy("doc_id").agg(side(False).alias("core_density"), side(True).alias("noise_density"))
    return both.withColumn("density_ratio", density_ratio())


def density_ratio():
    return F.when(F.col("core_density") != 0, N.round_even(F.col("noise_density") / F.greatest(F.col("core_density"), F.lit(0.001)), 2))


def totals(cited: DataFrame) -> DataFrame:
    """(doc_id, total_citations, unique_years)."""
    return cited.groupBy("doc_id").agg(F.sum("citation_count").alias("total_citations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))).alias("unique_years"))


def bibliography(references: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, total_references, bibliography_median) from years anywhere in the entries."""
    years = references.withColumn("_y", T.years(F.array("ref_text"), *config.years))
    return years.groupBy("doc_id").agg(F.count("*").alias("total_references"), N.median_year(F.flatten(F.collect_list("_y"))).alias("bibliography_median"))


def verify(references: DataFrame, registry: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The first references of each document, if long enough, looked up by their first 150 characters; an entry that the registry lacks stays valid, as an unanswered lookup does."""
    asked = references.filter((F.col("ref_index") < config.verify_first) & (F.length("ref_text") > config.verify_min_chars)).withColumn("ref_key", F.lower(F.substring("ref_text", 1, 150)))
    found = asked.join(registry.select("ref_key", "score"), "ref_key", "left")
    return found.select("doc_id", "ref_index", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.col("score") > config.verify_score, F.lit(True)).alias("is_valid"))


def hallucinations(verified: DataFrame) -> DataFrame:
    """(doc_id, n_verified, hallucination_count) of what verify() tells."""
    return verified.groupBy("doc_id").agg(F.count("*").alias("n_verified"), F.count_if(~F.col("is_valid")).alias("hallucination_count"))
