"""External services as joinable tables: embeddings, language-model answers, registries. Unavailable by default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requests(boundaries: DataFrame, anomalies: DataFrame, first: int = 3) -> DataFrame:
    """(doc_id, kind, key): what a reasoning service would be asked, the first boundaries and profiles of each document."""
    from pyspark.sql import Window

    order = lambda c: F.row_number().over(Window.partitionBy("doc_id").orderBy(c))
    asked = boundaries.filter("is_anomaly_transition").withColumn("_n", order("after_paragraph")).filter(F.col("_n") <= first)
    profiles = anomalies.withColumn("_n", order("paragraph_index")).filter(F.col("_n") <= first)
    key = F.concat_ws("_to_", F.col("after_paragraph").cast("string"), (F.col("after_paragraph") + 1).cast("string"))
    return asked.select("doc_id", F.lit("boundary").alias("kind"), key.alias("key")).unionByName(profiles.select("doc_id", F.lit("profile").alias("kind"), F.col("paragraph_index").cast("string").alias("key")))


def answers(asked: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """asked with the provider's answer(doc_id, kind, key, answer), null without a provider."""
    return asked.join(provider, ["doc_id", "kind", "key"], "left") if provider is not None else asked.withColumn("answer", F.lit(None).cast("string"))


# What an answer says where a call failed.
FAILED, TIMED_OUT = "AI reasoning failed", "AI reasoning timed out"


def outcome(answered: DataFrame) -> DataFrame:
    """(doc_id, explanation_count, explanations, n_failed, n_timeouts, boundary_explanations, anomaly_profiles) of answers(): a null answer is a failed call; the last two are maps by key."""
    boundary, text = F.col("kind") == "boundary", F.coalesce("answer", F.lit(FAILED))
    late = F.startswith(text, F.lit(TIMED_OUT))
    by_key = lambda kind: F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.struct("key", text.alias("answer"))))))
    return answered.groupBy("doc_id").agg(
        F.count_if(boundary).alias("explanation_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(boundary, F.struct("key", text.alias("answer"))))), lambda x: x["answer"]), "\n").alias("explanations"),
        F.count_if(F.startswith(text, F.lit(FAILED)) & ~late).alias("n_failed"),
        F.count_if(late).alias("n_timeouts"),
        by_key("boundary").alias("boundary_explanations"),
        by_key("profile").alias("anomaly_profiles"),
    )


#: A row of answers with this kind says that the reasoning about a document broke down as a whole; its answer is the error.
BATCH = "batch"
#: Seconds for a call and for all calls about a document; calls at once.
CALL_LIMIT, BATCH_LIMIT, AT_ONCE = 30.0, 120.0, 3


def reason(prompted: DataFrame, ask, call_limit: float = CALL_LIMIT, batch_limit: float = BATCH_LIMIT, at_once: int = AT_ONCE, attempts: int = 2, first_wait: float = 2.0) -> DataFrame:
    """(doc_id, kind, key, answer) of prompted(doc_id, kind, key, prompt), prompts(): ask(prompt) for each, in the task that has the document.

    A document's calls run at_once at a time. An error is tried again with doubled waits, as retried() has it; a call that takes longer than call_limit,
    and what isn't answered when batch_limit has passed, says that it timed out. A null prompt is not sent and fails.
    """
    kinds = dict(prompted.dtypes)

    def run(table):
        import time
        from concurrent.futures import ThreadPoolExecutor
        from concurrent.futures import TimeoutError as Late

        import pyarrow as pa

        def one(prompt):
            if prompt is None:
                return FAILED
            began = time.monotonic()

            def timed(p):
                if time.monotonic() - began > call_limit:
                    raise TimeoutError
                return ask(p)

            return retried(timed, attempts, first_wait)(prompt)

        end, pool = time.monotonic() + batch_limit, ThreadPoolExecutor(at_once)
        calls = [pool.submit(one, p) for p in table["prompt"].to_pylist()]
        told = []
        for i, call in enumerate(calls):
            wave = call_limit * (1 + attempts) * (1 + i // at_once)  # a call may wait for those before it
            try:
                told.append(call.result(timeout=max(0.0, min(end - time.monotonic(), wave))))
            except Late:
                told.append(TIMED_OUT)
        pool.shutdown(wait=False, cancel_futures=True)
        return pa.table([table["doc_id"], table["kind"], table["key"], pa.array(told, pa.string())], names=["doc_id", "kind", "key", "answer"])

    return prompted.select("doc_id", "kind", "key", "prompt").groupBy("doc_id").applyInArrow(run, f"doc_id {kinds['doc_id']}, kind string, key string, answer string")


#: What a report writer's answer must hold.
REPORT = "integrity_score double, verdict string, executive_summary string, evidence_breakdown struct<stylometric_analysis:string,citation_analysis:string,source_matches:string>, conclusion string"


def report_prompts(pruned: DataFrame) -> DataFrame:
    """(doc_id, kind, key, prompt): a request for a whole report, of report.pruned()."""
    return pruned.select("doc_id", F.lit("report").alias("kind"), F.lit("").alias("key"), F.replace(F.lit(PROMPTS["report"]), F.lit("{{evidence}}"), F.to_json("evidence")).alias("prompt"))


def written_reports(given: DataFrame) -> DataFrame:
    """(doc_id, written) of answers of kind report: REPORT where the answer is JSON with a score and a verdict, so that others leave the rules' report in place."""
    told = F.from_json("answer", REPORT)
    kept = given.filter("kind = 'report'").select("doc_id", told.alias("written"))
    return kept.filter("written.integrity_score IS NOT NULL AND written.verdict IS NOT NULL").groupBy("doc_id").agg(F.max("written").alias("written"))


def retried(ask, attempts: int = 2, first_wait: float = 2.0, sleep=None):
    """ask(prompt) tried again after errors, with doubled waits; the last error's name becomes the answer. For a provider's own pandas function."""
    import time

    def call(prompt: str) -> str:
        for turn in range(attempts + 1):
            try:
                return ask(prompt)
            except TimeoutError:
                error = TIMED_OUT
            except Exception as e:  # noqa: BLE001  a failed call is an answer
                error = f"{FAILED}: {e}"
            if turn < attempts:
                (sleep or time.sleep)(first_wait * 2**turn)
        return error

    return call


#: Templates of prompts; {{a}} and {{b}} are paragraphs, {{evidence}} is JSON.
PROMPTS = {
    "profile": "Describe the writing style of this paragraph in two or three sentences: tone, sentence structure, vocabulary.\n\n{{a}}",
    "boundary": 'Compare the styles of two neighbouring paragraphs and say what changes between them. Answer as JSON: {"explanation": "..."}.\n\nFirst:\n{{a}}\n\nSecond:\n{{b}}',
    "report": 'Judge the integrity of a document from this evidence. Answer as JSON with "integrity_score" (0 to 10), "verdict", "executive_summary", "evidence_breakdown" and "conclusion".\n\n{{evidence}}',
    "citations": "Explain what the years of these citations say about the origin of the passage.\n\n{{a}}",
}


def prompts(asked: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """requests() with their prompts: the paragraph of a profile, both paragraphs of a boundary."""
    at = asked.withColumn("_first", F.regexp_extract("key", r"^\d+", 0).cast("int"))
    first = paragraphs.select("doc_id", F.col("paragraph_index").alias("_first"), F.col("text").alias("_a"))
    second = paragraphs.select("doc_id", (F.col("paragraph_index") - 1).alias("_first"), F.col("text").alias("_b"))
    both = at.join(first, ["doc_id", "_first"]).join(second, ["doc_id", "_first"], "left")
    filled = F.replace(F.replace(F.when(F.col("kind") == "boundary", PROMPTS["boundary"]).otherwise(PROMPTS["profile"]), F.lit("{{b}}"), F.coalesce("_b", F.lit(""))), F.lit("{{a}}"), F.col("_a"))
    return both.select("doc_id", "kind", "key", filled.alias("prompt"))
