"""Operators on hand-written tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark import config
from quillmark.config import DEFAULT
from quillmark.functions import numeric
from quillmark.functions import text as text_functions
from quillmark.operators import clustering, features, ingest, kernel, report, warnings
from quillmark.plans.analyze import Inputs, analyze
from quillmark.sources import documents, providers
from quillmark.streaming.uploads import analyze_stream


@pytest.mark.parametrize(("n", "kept"), [(79, 0), (80, 1), (1000, 1), (1001, 1), (1079, 1), (1080, 2)])
def test_chunks(spark, n, kept):
    assert ingest.chunks(spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")).count() == kept


def test_text_too_short_for_a_chunk_is_raw_chunk_without_parts(spark):
    r = ingest.extraction(spark.createDataFrame([(1, "short"), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x["extraction_method"], len(x["parts"] or [])) for x in r] == [("raw_chunk", 0), ("none", 0), ("none", 0)]


def test_references_merge_and_first_line_starts(spark):
    lines = ["Miller, A. A study", "of things.", "[2] Chen, B.", "12.no space", "12. spaced"]
    f = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    got = [r["ref_text"] for r in ingest.merge_references(f).orderBy("ref_index").collect()]
    assert got == ["Miller, A. A study of things.", "[2] Chen, B. 12.no space", "12. spaced"]


def test_backward_bibliography_sweeps_earlier_pages(spark):
    from dataclasses import replace

    rows = [(1, 0, 0, "body line of page one"), (1, 1, 0, "References"), (1, 1, 1, "a reference on page two"), (1, 2, 0, "a reference on page three")]
    f = spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string")
    assert {r["line"] for r in ingest.bibliography(f).collect()} == {"a reference on page two", "a reference on page three"}
    assert {r["line"] for r in ingest.bibliography(f, replace(DEFAULT, legacy_backward_bibliography=True)).collect()} == {"a reference on page two", "body line of page one"}


def blobs(outlier=True):
    a = np.array([[0, 0], [0, 0.1], [0.1, 0], [0.1, 0.1]])
    rows = [*a, *(a + 5)]
    return np.array([*rows, [30.0, -30.0]] if outlier else rows)


def test_two_blobs_and_an_outlier():
    labels, p = kernel.hdbscan(blobs(), 2, 2)
    assert labels.tolist() == [0] * 4 + [1] * 4 + [-1]
    assert p[-1] == 0 and (p[:-1] > 0).all() and p.max() == 1


@pytest.mark.parametrize("change", [lambda x: x * 7, lambda x: x + 3, lambda x: x * [-1, 1]])
def test_labels_do_not_depend_on_scale_place_or_sign(change):
    x = np.random.default_rng(3).normal(size=(40, 2)) + np.repeat([[0, 0], [6, 6]], 20, 0)
    assert (kernel.hdbscan(change(x), 2, 2)[0] == kernel.hdbscan(x, 2, 2)[0]).all()


def test_identical_rows_are_finite():
    labels, p = kernel.hdbscan(np.zeros((6, 2)), 2, 2)
    assert np.isfinite(p).all() and len(labels) == 6


def test_pca_is_centred_padded_and_signed():
    out = kernel.pca(np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 9.0]]))
    assert out.shape == (3, 3) and np.allclose(out.mean(0), 0) and (out[:, 2] == 0).all()


@pytest.mark.parametrize(
    ("evidence", "score", "verdict"),
    [
        ((0.0, 1, 0, 0, [], [], [], False, 0), 10.0, "Clean"),
        ((0.5, 1, 0, 0, [], [], [], False, 0), 6.0, "Suspicious"),
        ((0.0, 2, 0, 0, [0.1, 0.1, 0.1], [], [], False, 0), 2.5, "Highly Plagiarized"),
        ((0.0, 1, 20, 20, [], [], [], False, 0), 5.5, "Suspicious"),
        ((0.0, 1, 0, 0, [], ["high", "medium"], [], True, 2), 6.5, "Suspicious"),
        ((0.0, 1, 0, 0, [], [], [0.9, 0.8, 0.75, 0.5], False, 0), 3.5, "Highly Plagiarized"),
        ((1.0, 9, 20, 20, [], [], [], False, 0), 0.0, "Highly Plagiarized"),
    ],
)
def test_score(spark, evidence, score, verdict):
    schema = "noise double, estimated_authors int, anomaly_count int, boundary_count int, burstiness array<double>, severities array<string>, similarities array<double>, reasoning_available boolean, explanation_count int"
    r = report.score(spark.createDataFrame([evidence], schema)).first()
    assert (r["integrity_score"], r["verdict"]) == (score, verdict)


def test_analysis_of_short_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 30), (2, ""), (3, None), (4, "\n".join(f"This is paragraph {i} of a paper, and it was written by them. " * (2 + i) for i in range(8)))], "doc_id long, text string")
    r = {x["doc_id"]: x for x in analyze(docs)["report"].collect()}
    assert set(r) == {1, 2, 3, 4} and r[1]["estimated_authors"] == 1
    assert [r[i]["status"] for i in (1, 2, 3, 4)] == ["success", "error", "error", "success"]
    assert r[2]["integrity_score"] is None and r[2]["verdict"] is None and r[2]["extraction_method"] == "none"


STATE = dict(doc_id=1, size=10, page_count=1, extraction_method="lines", n_paragraphs=9, n_valid=9, outcome="cluster", noise_override=False, estimated_authors=2, anomaly_count=1, reasoning_available=True, reasoning_skipped=False, n_timeouts=0, n_failed=0, total_citations=4, n_years=2, n_search_errors=0, n_unembedded=0)


@pytest.mark.parametrize(
    ("change", "codes"),
    [
        ({}, []),
        (dict(size=0, page_count=0, extraction_method="none", n_paragraphs=0, n_valid=0, outcome="skipped", total_citations=0), ["pdf_empty_file", "pdf_no_text"]),
        (dict(page_count=0), ["pdf_corrupt"]),
        (dict(extraction_method="pages"), ["pdf_degraded_mode"]),
        (dict(n_paragraphs=4, outcome="skipped"), ["features_short_paper", "cluster_skipped_short"]),
        (dict(n_valid=2), ["features_too_few_valid"]),
        (dict(outcome="zero_variance"), ["cluster_zero_variance"]),
        (dict(outcome="one_column"), ["cluster_zero_variance"]),
        (dict(outcome="noise_override", noise_override=True, estimated_authors=1, anomaly_count=0), ["cluster_noise_override"]),
        (dict(estimated_authors=1, anomaly_count=0), ["cluster_single_author"]),
        (dict(reasoning_available=False), ["gpt_unavailable"]),
        (dict(reasoning_available=False, reasoning_skipped=True), ["gpt_unavailable"]),
        (dict(n_timeouts=1), ["gpt_timeout"]),
        (dict(n_failed=1), ["gpt_partial_results"]),
        (dict(total_citations=0, n_years=0), ["citation_none_found"]),
        (dict(n_years=0), ["citation_no_years"]),
        (dict(n_search_errors=2), ["source_arxiv_timeout"]),
        (dict(n_unembedded=1), ["source_embedding_failed"]),
    ],
)
def test_warnings_of_a_state(spark, change, codes):
    got = warnings.emit(spark.createDataFrame([STATE | change])).orderBy("stage_order").collect()
    assert [r["code"] for r in got] == codes
    if change.get("reasoning_skipped"):
        assert got[0]["severity"] == "info"


def paper(k, n=8, extra=""):
    return "\n".join(f"This is paragraph {i} of paper {k}, and it was written by them{', or so they say' * (i % 4)}. " * (2 + i % 3) + extra for i in range(n))


def test_one_row_of_noise_is_told_as_an_override(spark):
    x = np.random.default_rng(0).normal(size=(7, 3)) * [[1], [10], [100], [1000], [1e4], [1e5], [1e6]]
    labels, p, outcome = kernel.cluster(x, DEFAULT)
    assert outcome in ("cluster", "noise_override")
    rows = [(1, i, 0, 0.3, "noise_override") for i in range(6)] + [(2, i, i % 2, 1.0, "cluster") for i in range(6)]
    r = {x["doc_id"]: x for x in clustering.summary(spark.createDataFrame(rows, "doc_id long, paragraph_index int, cluster_id int, probability double, outcome string")).collect()}
    assert (r[1]["noise_override"], r[1]["confidence"], r[2]["noise_override"], r[2]["estimated_authors"]) == (True, 0.3, False, 2)
    c = {x["doc_id"]: x["clustering"] for x in clustering.result(spark.createDataFrame(rows, "doc_id long, paragraph_index int, cluster_id int, probability double, outcome string")).collect()}
    assert c[1]["boundary_count"] == 0 and c[2]["boundary_count"] == 5 and c[2]["cluster_sizes"] == {"0": 3, "1": 3} and len(c[1]) == 11


def test_reports_with_given_tables(spark):
    late = "(Smith, 1990) and (Chen, 1991)"
    docs = spark.createDataFrame([(1, paper(1, extra="(Smith, 2019)").replace("(Smith, 2019)", late, 1)), (2, paper(2)), (3, "")], "doc_id long, text string")
    first = analyze(docs)["paragraphs"].select("doc_id", "paragraph_index", "text").collect()
    labels = spark.createDataFrame([(r["doc_id"], r["paragraph_index"], -1 if r["paragraph_index"] == 2 else 0, 0.9) for r in first], "doc_id long, paragraph_index int, cluster_id int, probability double")
    vectors = spark.createDataFrame([(r["doc_id"], r["paragraph_index"], [1.0, float(r["doc_id"])]) for r in first if r["doc_id"] == 1], "doc_id long, paragraph_index int, vector array<double>")
    query = features.keywords(spark.createDataFrame([r for r in first if r["doc_id"] == 1 and r["paragraph_index"] == 2])).first()["query"]
    candidates = spark.createDataFrame([(query, "arXiv", k, 10 + k, f"title {k}", "an abstract", [1.0, v], None) for k, v in enumerate((-1.0, 0.9, 1.0, 1.1))] + [(query, "OpenAlex", 0, None, None, None, None, "timed out")], "query string, origin string, rank int, source_id long, title string, abstract string, source_vector array<double>, error string")
    answers = spark.createDataFrame([(1, "boundary", "1_to_2", "the tone changes"), (1, "boundary", "2_to_3", "AI reasoning timed out")], "doc_id long, kind string, key string, answer string")
    found = analyze(docs, inputs=Inputs(vectors=vectors, candidates=candidates, answers=answers, labels=labels))
    r = {x["doc_id"]: x for x in found["report"].collect()}
    s = found["sources"].collect()
    assert [(x["doc_id"], x["paragraph_index"], x["source_id"], x["similarity"]) for x in s] == [(1, 2, 12, 1.0)]
    assert r[1]["similarities"] == [1.0] and r[2]["similarities"] == [] and r[1]["severities"] == ["high"] and r[3]["status"] == "error"
    # noise 1/8, one anomaly, a late paragraph of high severity, a source of 1.0, two explanations; flat sentence lengths
    assert r[1]["integrity_score"] == report_by_hand(0.125, r[1], 3.0, 0.6)
    codes = {(x["doc_id"], x["code"]) for x in found["warnings"].collect()}
    assert {(1, "gpt_timeout"), (1, "gpt_partial_results"), (1, "source_arxiv_timeout"), (2, "source_embedding_failed"), (3, "pdf_no_text")} <= codes
    assert "100.0%" in r[1]["evidence_breakdown"]["source_matches"] and r[1]["executive_summary"].startswith("[Rule-Based Analysis] The document ")


def report_by_hand(noise, row, sources, explanations):
    flat = 6.0 if "CRITICAL AI ALERT" in row["evidence_breakdown"]["stylometric_analysis"] else 0.0
    off = 8.0 * noise + flat + 0.5 + (1.5 + 0.3) + sources + explanations
    return max(0.0, round(10.0 - off, 1))


def test_references_leave_the_paragraphs_and_are_verified(spark):
    entry = "[1] Chen, B. A very long study of many things that nobody had looked at before, in the year 1999."
    text = paper(1) + "\n" + "References\n" + entry + "\n[2] Short, but continued here\nover a second line of 2001."
    docs = spark.createDataFrame([(1, text), (2, paper(2))], "doc_id long, text string")
    registry = spark.createDataFrame([(entry.lower()[:150], 10.0)], "ref_key string, score double")
    r = {x["doc_id"]: x for x in analyze(docs, inputs=Inputs(registry=registry))["report"].collect()}
    assert (r[1]["n_paragraphs"], r[1]["total_references"], r[1]["bibliography_median"], r[1]["hallucination_count"]) == (8, 2, 2000, 1)
    assert (r[2]["n_paragraphs"], r[2]["total_references"], r[2]["hallucination_count"]) == (8, 0, 0)


def test_layout_readers_come_first_in_the_chain(spark):
    long = "x" * 90
    rows = [(1, "short", [("Title", long), ("NarrativeText", f" {long} ")], [(0, long)]), (2, "short", [("NarrativeText", "y")], [(1, long), (0, "br-\noken " + long)]), (3, long, None, None)]
    f = spark.createDataFrame(rows, "doc_id long, text string, elements array<struct<type:string,text:string>>, blocks array<struct<kind:int,text:string>>")
    r = [(x["extraction_method"], x["degraded_mode"], x["parts"]) for x in ingest.extraction(f).orderBy("doc_id").collect()]
    assert r == [("elements", False, [long]), ("blocks", False, ["broken " + long]), ("lines", False, [long])]


def test_session_settings_switch_stages(spark):
    spark.conf.set("quillmark.skip_clustering", "true")
    spark.conf.set("quillmark.year_gap", "12")
    try:
        told = config.from_session(spark)
    finally:
        spark.conf.unset("quillmark.skip_clustering")
        spark.conf.unset("quillmark.year_gap")
    assert told.skip_clustering and told.year_gap == 12 and config.from_session(spark) == DEFAULT
    docs = spark.createDataFrame([(1, paper(1))], "doc_id long, text string")
    assert analyze(docs, told)["labels"].first()["outcome"] == "skipped"


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rounding_is_pythons(spark, digits):
    rng = np.random.default_rng(digits)
    values = [0.15, 4.45, 7.35, 2.5, 0.5, 1.5, 0.125, 0.375, 2.675, 1.005, 0.0, -2.5, -0.15, 12345.00005, 0.00005, 0.00015, *(rng.integers(0, 10**6, 300) / 10 ** (digits + 1)).tolist(), *(rng.random(300) * 100).tolist(), *(rng.integers(0, 4000, 100) / 32).tolist()]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", numeric.round_even(F.col("v"), digits).alias("r")).collect()
    assert [(r["v"], r["r"]) for r in got if r["r"] != round(r["v"], digits)] == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("so it is (Smith, 2019).", ["(Smith, 2019)"]),
        ("not ( Smith, 2019 ) here", []),
        ("but (Smith , 2019) is", ["(Smith , 2019)"]),
        ("Chen (2001) wrote", ["Chen (2001)"]),
        ("Chen ( 2001 ) wrote", []),
        ("as Chen\u00a0and\u00a0Li\u00a0(2001) say", ["Chen\u00a0and\u00a0Li\u00a0(2001)"]),
        ("(Smith & Jones, 2020; O'Brien et al., 1999)", ["(Smith & Jones, 2020; O'Brien et al., 1999)"]),
        ("However (2001) and (Table, 2001)", []),
        ("x(Smith,2019;\u2003Li,2020) ", ["(Smith,2019;\u2003Li,2020)"]),
        ("(see Smith, 2019)", []),
        ("McSmith (1899), Li (2099)", ["Li (2099)"]),
    ],
)
def test_citation_language(spark, text, found):
    f = spark.createDataFrame([(text,)], "text string").select(text_functions.citations("text").alias("c"), text_functions.word_count("text").alias("n"))
    assert f.first()["c"] == found and f.first()["n"] == len(text.split())


def naive_hdbscan(x, least=2, samples=2):
    """By definition: connected components of the mutual reachability graph at every distance, and their excess of mass."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min(samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(reach, 0)

    def parts(rows, cut):
        left, out = set(rows), []
        while left:
            todo, seen = [min(left)], set()
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    todo += [j for j in left if j not in seen and reach[i, j] < cut]
            out.append(sorted(seen))
            left -= seen
        return out

    def grow(rows, birth):
        """(stability, chosen clusters) of a cluster born at 1/distance birth."""
        own, here = 0.0, list(rows)
        for cut in sorted({reach[i, j] for i in rows for j in rows if i < j}, reverse=True):
            split = parts(here, cut)
            if len(split) == 1:
                continue
            level, big = 1 / cut, [s for s in split if len(s) >= least]
            own += (level - birth) * sum(len(s) for s in split if len(s) < least)
            if len(big) != 1:
                own += (level - birth) * sum(map(len, big))
                below = [grow(s, level) for s in big]
                return (own, [rows]) if own >= sum(b[0] for b in below) else (sum(b[0] for b in below), [c for b in below for c in b[1]])
            here = big[0]
        return own, [rows]

    labels, todo = np.full(n, -1), list(range(n))
    for cut in sorted({reach[i, j] for i in range(n) for j in range(i)}, reverse=True):  # the root is never a cluster
        big = [s for s in parts(todo, cut) if len(s) >= least]
        if len(big) > 1:
            chosen = [c for s in big for c in grow(s, 1 / cut)[1]]
            for k, c in enumerate(sorted(chosen)):
                labels[c] = k
            break
        if not big:
            break
        todo = big[0]
    number = {c: i for i, c in enumerate(dict.fromkeys(labels[labels >= 0].tolist()))}
    return [number.get(c, -1) for c in labels.tolist()]


def naive_probabilities(x, labels, samples=2, least=2):
    """Of each clustered row the level at which its component first has too few rows, over the greatest one of its cluster."""
    n, out = len(x), np.zeros(len(x))
    d = kernel.distances(x)
    core = np.sort(d, 1)[:, min(samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    for p in np.flatnonzero(labels >= 0):
        for cut in sorted({reach[i, j] for i in range(n) for j in range(i)}, reverse=True):
            held, todo = {p}, [p]
            while todo:
                i = todo.pop()
                new = [j for j in range(n) if j not in held and reach[i, j] < cut]
                held.update(new)
                todo += new
            if len(held) < least:
                out[p] = 1 / cut
                break
    return np.array([out[i] / out[labels == c].max() if c >= 0 else 0.0 for i, c in enumerate(labels)])


@pytest.mark.parametrize("samples", [0, 2])
@pytest.mark.parametrize("seed", range(24))
def test_kernel_labels_are_those_of_the_definition(seed, samples):
    """With core distances, as the service clusters, and without; equal distances split all at once in both readings."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(int(rng.integers(6, 26)), 3))
    x[: len(x) // 2] += 3.0
    if seed % 3 == 2:  # many equal distances
        x = np.round(x) + np.arange(len(x))[:, None] * [0, 0, 4.0 * (seed % 2)]
        x = np.unique(x, axis=0)
        x = x[rng.permutation(len(x))]
    labels, probability = kernel.hdbscan(x, 2, samples)
    assert labels.tolist() == naive_hdbscan(x, samples=samples)
    assert np.allclose(probability, naive_probabilities(x, labels, samples))


def test_kernel_gives_rows_in_any_order_the_same_clusters():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 6, (40, 2)).astype(float)
    labels, probability = kernel.hdbscan(x, 2, 2)
    order = rng.permutation(40)
    again, p = kernel.hdbscan(x[order], 2, 2)
    assert np.allclose(probability[order], p)
    assert len(set(zip(labels[order].tolist(), again.tolist(), strict=True))) == len(set(labels.tolist()))


def test_kernel_memory_grows_with_the_rows():
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(4000, 8))
    tracemalloc.start()
    kernel.hdbscan(x, 2, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4000 * 4000  # bytes: an eighth of one matrix of distances


def test_components_are_eigenvectors_of_the_covariance():
    x = np.random.default_rng(5).normal(size=(40, 6)) * [5, 4, 3, 2, 1, 1]
    c = x - x.mean(0)
    values, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, np.argsort(-values)[:3]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(3)])
    assert np.allclose(kernel.pca(x), c @ axes)


def test_prompts_retries_and_page_counts(spark, tmp_path):
    asked = spark.createDataFrame([(1, "boundary", "0_to_1"), (1, "profile", "1")], "doc_id long, kind string, key string")
    rows = spark.createDataFrame([(1, 0, "first {b}"), (1, 1, "second")], "doc_id long, paragraph_index int, text string")
    p = {r["kind"]: r["prompt"] for r in providers.prompts(asked, rows).collect()}
    assert "first {b}" in p["boundary"] and "second" in p["boundary"] and p["profile"].endswith("second")
    waits, turns = [], iter([ValueError("busy"), ValueError("busy"), "fine"])

    def ask(_):
        x = next(turns)
        if isinstance(x, Exception):
            raise x
        return x

    assert providers.retried(ask, sleep=waits.append)("q") == "fine" and waits == [2.0, 4.0]
    (tmp_path / "two.pdf").write_bytes(b"%PDF-1.4 << /Type /Pages >> << /Type /Page >> <</Type/Page>>")
    (tmp_path / "bad.pdf").write_bytes(b"no pdf /Type /Page")
    assert sorted(map(tuple, documents.metadata(spark, str(tmp_path)).collect())) == [("bad.pdf", 18, 0), ("two.pdf", 60, 2)]
    r = {x["doc_id"].rsplit("/", 1)[1]: x for x in documents.decoded(documents.uploads(spark, str(tmp_path))).select("doc_id", "text", "size", "page_count").collect()}
    codes = {(x["doc_id"].rsplit("/", 1)[1], x["code"]) for x in analyze(spark.createDataFrame(list(r.values()), "doc_id string, text string, size long, page_count int"))["warnings"].collect()}
    assert {("bad.pdf", "pdf_corrupt"), ("bad.pdf", "pdf_no_text"), ("two.pdf", "pdf_no_text")} <= codes and ("two.pdf", "pdf_corrupt") not in codes


def test_evidence_is_pruned_for_a_writer(spark):
    row = spark.createDataFrame([(1, 1, 0, 0.0, 0, 1.0, False, False, "", 3, ["low"], [0.5])], "doc_id long, estimated_authors int, anomaly_count int, noise double, boundary_count int, confidence double, noise_override boolean, too_short boolean, explanations string, total_citations int, severities array<string>, similarities array<double>")
    e = report.pruned(row).first()["evidence"]
    assert e["citations"]["temporal_anomaly_count"] == 1 and e["clustering"]["estimated_authors"] == 1 and len(e) == 4


def test_guarded_documents_skip_the_kernel(spark):
    f = spark.createDataFrame([(1, 0, True) + (1.0,) * 8], "doc_id long, paragraph_index int, is_valid boolean, " + ", ".join(f"{c} double" for c in ("avg_sentence_length", "avg_word_length", "pronoun_ratio", "preposition_ratio", "conjunction_ratio", "passive_voice_pct", "yules_k", "burstiness_score")))
    assert clustering.guards(f).first()["outcome"] == "skipped"
    assert clustering.label(f).first()["cluster_id"] == 0


def test_uploads_keep_pdf_files_with_content(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"text")
    assert [r["path"].rsplit("/", 1)[1] for r in documents.uploads(spark, str(tmp_path)).collect()] == ["a.PDF"]
    assert [r["code"] for r in documents.rejected(spark, str(tmp_path), max_bytes=4).collect()] == ["pdf_too_large"]
    assert documents.decode(documents.uploads(spark, str(tmp_path))).first()["page_count"] == 0


def test_unavailable_provider_leaves_questions_unanswered(spark):
    b = spark.createDataFrame([(1, 2, True)], "doc_id long, after_paragraph int, is_anomaly_transition boolean")
    a = spark.createDataFrame([(1, 3)], "doc_id long, paragraph_index int")
    assert sorted((r["kind"], r["key"], r["answer"]) for r in providers.answers(providers.requests(b, a)).collect()) == [("boundary", "2_to_3", None), ("profile", "3", None)]


def test_stream_gives_the_batch_result(spark, tmp_path):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text"))
    docs.write.parquet(str(tmp_path / "in"))
    q = analyze_stream(spark, str(tmp_path / "in"), "doc_id long, text string", ingest.paragraphs, str(tmp_path / "out"), str(tmp_path / "mark"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
