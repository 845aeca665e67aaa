"""Requests to a reasoning service, its limits, written reports, and the whole answer as JSON."""

import json
import time

from pyspark.sql import functions as F

from quillmark.plans import response
from quillmark.plans.analyze import Inputs, analyze
from quillmark.sources import providers

LINE = "The filter removed the noise from every single measurement of the long session, said Smith (2004) twice. "


def corpus(spark):
    docs = spark.createDataFrame([(d, "\n".join(LINE * (2 + i) + str(d) for i in range(6))) for d in (1, 2, 3)] + [(4, "")], "doc_id long, text string")
    rows = analyze(docs)["paragraphs"].select("doc_id", "paragraph_index")
    return docs, rows.select("doc_id", "paragraph_index", F.when(F.col("paragraph_index") == 2, -1).otherwise(0).alias("cluster_id"), F.lit(1.0).alias("probability"))


def answer(prompt):
    if "integrity" in prompt:
        return json.dumps({"integrity_score": 3.5, "verdict": "Suspicious", "executive_summary": "S", "evidence_breakdown": {"stylometric_analysis": "A"}, "conclusion": "C"})
    return "An explanation."


def test_calls_have_limits_and_are_tried_again(spark):
    rows = [(1, "profile", str(i), p) for i, p in enumerate(["fine", "slow", "broken", None])] + [(2, "profile", "0", "fine"), (2, "profile", "1", "stuck")]
    asked = spark.createDataFrame(rows, "doc_id long, kind string, key string, prompt string")

    def ask(prompt):
        if prompt == "slow":
            time.sleep(0.4)
            raise OSError("busy")
        if prompt == "broken":
            raise OSError("gone")
        if prompt == "stuck":
            time.sleep(8)
        return prompt.upper()

    got = {(r["doc_id"], r["key"]): r["answer"] for r in providers.reason(asked, ask, call_limit=0.3, batch_limit=3.0, first_wait=0.01).collect()}
    assert got[1, "0"] == got[2, "0"] == "FINE" and got[1, "1"] == got[2, "1"] == providers.TIMED_OUT
    assert got[1, "2"] == f"{providers.FAILED}: gone" and got[1, "3"] == providers.FAILED


def test_answers_reports_and_breakdowns_reach_the_analysis_and_its_json(spark):
    docs, labels = corpus(spark)
    asked = analyze(docs, inputs=Inputs(labels=labels))["requests"]
    kinds = {(r["doc_id"], r["kind"]) for r in asked.collect()}
    assert kinds == {(d, k) for d in (1, 2, 3) for k in ("boundary", "profile", "report")}
    told = [tuple(r) for r in providers.reason(asked, answer).filter("doc_id = 1").collect()] + [(2, "report", "", "no json"), (3, providers.BATCH, "", "the service is gone")]
    answers = spark.createDataFrame(told, "doc_id long, kind string, key string, answer string")
    a = analyze(docs, inputs=Inputs(labels=labels, answers=answers))
    got = {r["doc_id"]: json.loads(r["json"]) for r in response.responses(a).collect()}
    one, two, three, four = (got[i] for i in (1, 2, 3, 4))
    assert (one["report"]["integrity_score"], one["report"]["verdict"], one["report"]["conclusion"]) == (3.5, "Suspicious", "C")
    assert one["reasoning"] == {"available": True, "boundary_explanations": {"1_to_2": "An explanation.", "2_to_3": "An explanation."}, "anomaly_profiles": {"2": "An explanation."}}
    assert two["report"]["executive_summary"].startswith("[Rule-Based Analysis]") and set(two["reasoning"]["anomaly_profiles"].values()) == {providers.FAILED}
    severities = lambda x: {(w["code"], w["severity"]) for w in x["data_quality"]["warnings"]}
    assert ("gpt_partial_results", "warning") in severities(two) and ("gpt_timeout", "error") in severities(three) and three["data_quality"]["partial_results"]
    assert not three["reasoning"]["available"] and three["reasoning"]["boundary_explanations"] == {}
    assert [p["paragraph_index"] for p in one["paragraphs"]] == list(range(6)) and one["paragraphs"][2]["cluster_id"] == -1
    assert len(one["clustering"]["boundaries"]) == one["clustering"]["boundary_count"] == 2
    assert one["citations"]["total_citations_found"] == sum(p["citation_count"] for p in one["citations"]["per_paragraph"]) > 0
    assert four["status"] == "error" and four["paragraphs"] == [] and four["clustering"] is four["report"] is four["sources"] is None
    assert one["sources"] == [] and four["page_count"] == 0
