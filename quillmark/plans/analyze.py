"""The whole analysis of a corpus: one lazy plan from documents to integrity scores."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, FEATURES, Config
from ..functions import numeric as N
from ..functions import text as T
from ..operators import citations, clustering, features, ingest, report, sources, vectors, warnings
from ..operators.language import Language
from ..sources import providers


@dataclass(frozen=True)
class Inputs:
    """What a corpus may come with, each a table. Without one, its stage finds nothing, and the warnings say so where they have a rule for it.

    vectors(doc_id, paragraph_index, vector): embeddings of paragraphs; candidates: see sources.trace();
    answers(doc_id, kind, key, answer): of a reasoning service; registry(ref_key, score): see citations.verify();
    labels(doc_id, paragraph_index, cluster_id, probability): given ones, instead of the clustering's; language: tags,
    sentences, lemmas and clauses of a learnt language, instead of word lists and patterns; terms: of vectors.learn(), from which
    anomalies and candidates get vectors where none are given.
    """

    vectors: DataFrame | None = None
    candidates: DataFrame | None = None
    answers: DataFrame | None = None
    registry: DataFrame | None = None
    labels: DataFrame | None = None
    language: Language | None = None
    terms: DataFrame | None = None


#: Columns of a paragraph that travel with it through the clustering.
CARRIED = ("num_sentences", "burstiness_score", "is_valid", "citation_count", "years", "median_year", "words", "extraction_method", "references", "size", "page_count")


def _empty(kind: str):
    return F.array().cast(f"array<{kind}>")


def labelled(docs: DataFrame, config: Config = DEFAULT, inputs: Inputs = Inputs()) -> DataFrame:
    """A row a paragraph, without its text: labels, features of evidence, citations; and one row, of null paragraph_index, for a document without paragraphs.

    One scan, and one shuffle by document on the way to the clustering.
    """
    whole = docs.select(*docs.columns, *(F.lit(None).cast(k).alias(c) for c, k in (("size", "long"), ("page_count", "int")) if c not in docs.columns))
    parts = ingest.parsed(whole.select("doc_id", "text", "size", "page_count", *(c for c in ("elements", "blocks") if c in docs.columns)), config)
    rows = parts.select("doc_id", "extraction_method", "references", "size", "page_count", F.posexplode_outer("parts").alias("paragraph_index", "text"))
    if inputs.language is not None:
        rows = inputs.language.annotate(rows)
    measured = citations.extract(features.measured(rows, config), config).withColumns({"words": T.word_count("text"), "references": F.when(F.coalesce("paragraph_index", F.lit(0)) == 0, F.col("references"))})
    if inputs.vectors is not None:
        measured = measured.join(inputs.vectors.select("doc_id", "paragraph_index", "vector"), ["doc_id", "paragraph_index"], "left")
    measured = measured.drop("text", "citations", "tags", "sentence_ends")
    if inputs.labels is not None:
        given = inputs.labels.select("doc_id", "paragraph_index", "cluster_id", "probability")
        return measured.join(given, ["doc_id", "paragraph_index"], "left").withColumns({"cluster_id": F.when(F.col("paragraph_index").isNotNull(), F.coalesce("cluster_id", F.lit(0))), "outcome": F.lit("cluster")})
    carried = [c for c in CARRIED if c != "is_valid"]
    renamed = measured.withColumns({"_valid": F.col("is_valid"), "_burst": F.col("burstiness_score")})
    return clustering.label(renamed, config, carry=("_valid", "_burst", *(c for c in carried if c != "burstiness_score"))).withColumnsRenamed({"_valid": "is_valid", "_burst": "burstiness_score"})


def evidence(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A row a document from those of labelled(): all that the report and the warnings read, by one aggregation."""
    place = lambda *cols: F.array_sort(F.collect_list(F.when(F.col("paragraph_index").isNotNull(), F.struct("paragraph_index", *cols))))
    noise = F.col("cluster_id") == -1
    density = citations.density(F.col("words"))
    side = lambda of: F.coalesce(N.round_even(F.avg(F.when(of, density)), 4), F.lit(0.0))
    told = rows.groupBy("doc_id").agg(
        *clustering.summary_aggregates(rows.columns, config),
        F.count("paragraph_index").alias("n_paragraphs"),
        F.count_if(F.col("is_valid")).alias("n_valid"),
        F.max("outcome").alias("outcome"),
        F.max("extraction_method").alias("extraction_method"),
        F.max("size").alias("size"),
        F.max("page_count").alias("page_count"),
        F.max("references").alias("references"),
        place("cluster_id", "num_sentences", "burstiness_score", "years", "median_year").alias("_p"),
        F.coalesce(F.sum("citation_count"), F.lit(0)).alias("total_citations"),
        side(~noise).alias("core_density"),
        side(noise).alias("noise_density"),
    )
    years = lambda of: F.flatten(F.transform(F.filter("_p", of), lambda p: F.coalesce(p["years"], _empty("int"))))
    changes = F.filter(F.transform("_p", lambda p, i: (i > 0) & (F.get("_p", i - 1)["cluster_id"] != p["cluster_id"])), lambda x: x)
    far = F.filter(F.transform("_p", lambda p: F.abs(p["median_year"] - F.col("core_median"))), lambda d: d > config.year_gap)
    first = told.select("doc_id", *clustering.summary_columns(), *(c for c in told.columns if c not in ("doc_id", "paragraph_count", "anomaly_count", "noise_override", "_authors", "_noise", "_sure")), F.coalesce("_noise", F.lit(0.0)).alias("_share"))
    return (
        first.withColumns({"core_median": N.median_year(years(lambda p: p["cluster_id"] != -1)), "noise_median": N.median_year(years(lambda p: p["cluster_id"] == -1)), "unique_years": F.array_sort(F.array_distinct(years(lambda p: F.lit(True))))})
        .withColumns(
            {
                "noise": F.coalesce("noise_percentage", F.lit(0.0)),
                "noise_override": F.coalesce("noise_override", F.lit(False)),
                "too_short": F.col("outcome").isin("skipped", "too_short") | (F.col("n_paragraphs") < 2 * config.min_cluster_size),
                "boundary_count": F.size(changes),
                "burstiness": F.transform(F.filter("_p", lambda p: p["num_sentences"] >= 2), lambda p: p["burstiness_score"]),
                "severities": F.transform(far, T.severity),
                "n_years": F.size("unique_years"),
                "density_ratio": citations.density_ratio(),
                "references": F.coalesce("references", _empty("string")),
            }
        )
        .withColumns({"total_references": F.size("references"), "bibliography_median": N.median_year(T.years("references", *config.years))})
        .drop("_p", "_share")
    )


def analyze(docs: DataFrame, config: Config = DEFAULT, inputs: Inputs = Inputs()) -> dict[str, DataFrame]:
    """paragraphs, features, labels, boundaries, summary, clustering, citations, temporal_anomalies, sources, requests, report and warnings of docs(doc_id, text).

    docs may also have size and page_count (of the upload), elements and blocks (see ingest.extraction()). report has a
    row for every document: status is error, and the rest null, where no text was found. requests are what a reasoning
    service may be asked, with prompts (providers.reason() sends them); its answers go into Inputs.answers. An answer of
    kind report that parses stands for the rules' report; one of kind batch says that reasoning broke down.
    """
    parts = ingest.parsed(docs.select("doc_id", "text", *(c for c in ("elements", "blocks") if c in docs.columns)), config)
    paragraphs = parts.select("doc_id", F.posexplode("parts").alias("paragraph_index", "text"))
    rows = labelled(docs, config, inputs)
    labels = rows.filter("paragraph_index IS NOT NULL")
    enriched = clustering.enrich(paragraphs, labels.select("doc_id", "paragraph_index", "cluster_id"))
    borders = clustering.boundaries(labels)
    cited = citations.extract(enriched, config)
    found = evidence(rows, config)

    later = {"similarities": _empty("double"), "n_search_errors": F.lit(0), "n_unembedded": F.lit(0)}
    traced = None
    if inputs.candidates is not None and (inputs.vectors is not None or inputs.terms is not None) and not config.skip_sources:
        longest = sources.longest_anomalies(enriched, config.max_anomalies)
        given = inputs.vectors if inputs.vectors is not None else vectors.embed(longest.select("doc_id", "paragraph_index", "text"), inputs.terms, ("doc_id", "paragraph_index"))
        anomalies = longest.join(given, ["doc_id", "paragraph_index"], "left")
        if "source_vector" not in inputs.candidates.columns:
            works = inputs.candidates.filter("source_id IS NOT NULL").select("source_id", F.concat_ws(" ", "title", "abstract").alias("text")).dropDuplicates(["source_id"])
            inputs = replace(inputs, candidates=inputs.candidates.join(vectors.embed(works, inputs.terms, ("source_id",)).withColumnRenamed("vector", "source_vector"), "source_id", "left"))
        traced = sources.trace(anomalies.filter("vector IS NOT NULL"), inputs.candidates, config, inputs.language)
        asked = anomalies.join(sources.queries(anomalies, inputs.language), ["doc_id", "paragraph_index"], "left")
        wrong = asked.join(inputs.candidates.filter("error IS NOT NULL").select("query", "error").distinct(), "query", "left") if "error" in inputs.candidates.columns else asked.withColumn("error", F.lit(None).cast("string"))
        troubles = wrong.groupBy("doc_id").agg(F.count("error").alias("n_search_errors"), F.count_if(F.col("vector").isNull()).alias("n_unembedded"))
        found = found.join(traced.groupBy("doc_id").agg(F.array_sort(F.collect_list("similarity")).alias("similarities")), "doc_id", "left").join(troubles, "doc_id", "left")
    found = found.withColumns({c: F.coalesce(F.col(c), d) if c in found.columns else d for c, d in later.items()})

    nothing = F.create_map().cast("map<string,string>")
    later = {"explanation_count": F.lit(0), "explanations": F.lit(""), "n_failed": F.lit(0), "n_timeouts": F.lit(0), "reasoning_error": F.lit(False), "boundary_explanations": nothing, "anomaly_profiles": nothing}
    asked, reasoned = providers.requests(borders, labels.filter("cluster_id = -1")), inputs.answers is not None and not config.skip_reasoning
    if reasoned:
        broken = inputs.answers.filter(F.col("kind") == providers.BATCH).select("doc_id", F.lit(True).alias("reasoning_error")).distinct()
        told = providers.outcome(providers.answers(asked, inputs.answers).join(broken, "doc_id", "left_anti"))
        found = found.join(told, "doc_id", "left").join(broken, "doc_id", "left")
    found = found.withColumns({c: F.coalesce(F.col(c), d) if c in found.columns else d for c, d in later.items()})
    found = found.withColumns({"reasoning_available": F.lit(reasoned) & ~F.col("reasoning_error"), "reasoning_skipped": F.lit(config.skip_reasoning)})

    if inputs.registry is not None:
        listed = found.select("doc_id", F.posexplode("references").alias("ref_index", "ref_text"))
        found = found.join(citations.hallucinations(citations.verify(listed, inputs.registry, config)), "doc_id", "left")
    found = found.withColumn("hallucination_count", F.coalesce("hallucination_count", F.lit(0).cast("long")) if inputs.registry is not None else F.lit(0).cast("long"))

    scored = report.texts(report.score(found))
    if reasoned:  # a report writer's answer stands for the rules' report
        scored = scored.join(providers.written_reports(inputs.answers), "doc_id", "left")
        ours = [c for c in ("integrity_score", "verdict", "executive_summary", "evidence_breakdown", "conclusion") if c in scored.columns]
        scored = scored.withColumns({c: F.when(F.col("written").isNotNull(), F.col(f"written.{c}")).otherwise(F.col(c)) for c in ours})
    there, told = F.col("n_paragraphs") > 0, ["integrity_score", "verdict", "executive_summary", "evidence_breakdown", "conclusion", "estimated_authors", "anomaly_count", "noise", "confidence", "boundary_count", "noise_override", "too_short", "core_density", "noise_density", "density_ratio", "core_median", "noise_median", "total_citations", "hallucination_count"]
    final = scored.select(
        "doc_id",
        F.when(there, "success").otherwise("error").alias("status"),
        F.when(~there, "No text could be extracted from this document.").alias("error"),
        "extraction_method",
        "n_paragraphs",
        *(F.when(there, F.col(c)).alias(c) for c in told),
        *(c for c in ("severities", "similarities", "explanations", "total_references", "bibliography_median", "page_count", "reasoning_available", "boundary_explanations", "anomaly_profiles")),
    )
    requests = providers.prompts(asked, paragraphs).unionByName(providers.report_prompts(report.pruned(scored.filter("n_paragraphs > 0"))))
    out = {"requests": requests, "paragraphs": enriched, "features": features.profiles(paragraphs if inputs.language is None else inputs.language.annotate(paragraphs), config), "labels": labels, "boundaries": borders, "summary": clustering.summary(labels, config), "clustering": clustering.result(labels, config), "citations": cited, "temporal_anomalies": citations.temporal_anomalies(cited, config), "report": final, "warnings": warnings.emit(found)}
    return out | ({"sources": traced} if traced is not None else {})
