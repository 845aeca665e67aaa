"""Search services over saved answers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillmark.plans.analyze import Inputs, analyze
from quillmark.sources import search

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/1</id><title>First
 work</title><summary> About  a thing. </summary><published>2019-05-01T00:00:00Z</published><author><name>A. B.</name></author><author><name>C</name></author></entry><entry><id>http://x/2</id><title>Second</title><published>x</published></entry></feed>"""
JSON = {"results": [{"id": "W1", "title": "Work", "publication_year": 2020, "doi": "http://d/1", "authorships": [{"author": {"display_name": "D"}}, {}], "abstract_inverted_index": {"the": [0, 3], "cat": [1], "saw": [2], "dog": [4]}}, {"id": "W2", "display_name": "Bare", "primary_location": {"landing_page_url": "http://p/2"}}, {"id": "W3"}, {"id": "W4"}]}


def save(path, service, query, text):
    (path / service).mkdir(exist_ok=True)
    (path / service / hashlib.sha1(query.encode()).hexdigest()).write_text(text)


@pytest.fixture
def transports(tmp_path):
    for q in ("cat AND dog", "é"):
        save(tmp_path, "arxiv", q, FEED)
    save(tmp_path, "openalex", "cat AND dog", json.dumps(JSON))
    save(tmp_path, "openalex", "é", "{broken")
    return {s: search.snapshot(str(tmp_path), s) for s in ("arxiv", "openalex")}


WANT = [
    ("cat AND dog", "arxiv", 1, "http://x/1", "First work", ["A. B.", "C"], 2019, "http://x/1", "About a thing."),
    ("cat AND dog", "arxiv", 2, "http://x/2", "Second", [], None, "http://x/2", ""),
    ("cat AND dog", "openalex", 1, "W1", "Work", ["D", ""], 2020, "http://d/1", "the cat saw the dog"),
    ("cat AND dog", "openalex", 2, "W2", "Bare", [], None, "http://p/2", "Bare"),
    ("cat AND dog", "openalex", 3, "W3", "", [], None, "W3", ""),
]


def test_queries_of_a_table_are_asked_and_failures_are_rows(spark, transports):
    queries = spark.createDataFrame([("cat AND dog",), ("cat AND dog",), ("é",), ("absent",), (None,), ("",)], "query string")
    rows = search.ask(queries, transports, first_wait=0.0).collect()
    assert sorted(tuple(r)[:9] for r in rows if r["query"] == "cat AND dog") == WANT
    failed = {(r["query"], r["origin"]): r["error"] for r in rows if r["error"]}
    assert set(failed) == {("é", "openalex"), ("absent", "arxiv"), ("absent", "openalex")} and "FileNotFound" in failed["absent", "arxiv"]
    assert search.ask(queries.limit(0), transports).collect() == []


def test_data_source_pushes_filters_into_partitions(spark, transports):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(search.source(transports, per_partition=1, first_wait=0.0))
    f = spark.read.format("search").load()
    both = f.filter(F.col("query").isin("cat AND dog", "é"))
    assert sorted(tuple(r)[:9] for r in both.filter("error IS NULL AND query = 'cat AND dog'").collect()) == WANT
    assert both.rdd.getNumPartitions() == 4 and both.filter("origin = 'arxiv'").rdd.getNumPartitions() == 2
    assert {(r["query"], r["origin"]) for r in both.filter("error IS NOT NULL").collect()} == {("é", "openalex")}
    with pytest.raises(Exception, match="filter on query"):
        spark.read.format("search").load().collect()


def test_waits_double_to_a_bound_and_the_last_error_stays():
    waits, turns = [], iter([OSError("busy"), TimeoutError("late"), OSError("gone"), ValueError("last")])

    def fails(query, first):
        raise next(turns)

    rows = search.answers("q", "arxiv", fails, sleep=waits.append)
    assert waits == [2.0, 4.0, 8.0] and [r["error"] for r in rows] == ["ValueError: last"]
    assert search.answers("q", "arxiv", lambda q, n: FEED.encode(), first=1, sleep=waits.append)[0]["rank"] == 1 and len(waits) == 3


def test_failed_searches_warn_and_found_works_count_in_the_analysis(spark, tmp_path):
    line = "The filter removed the noise from every single measurement of the long session. "
    docs = spark.createDataFrame([(d, "\n".join(line * (2 + i) + str(d) for i in range(6))) for d in (1, 2)], "doc_id long, text string")
    rows = analyze(docs)["paragraphs"].select("doc_id", "paragraph_index")
    labels = rows.select("doc_id", "paragraph_index", F.when(F.col("paragraph_index") == 2, -1).otherwise(0).alias("cluster_id"), F.lit(1.0).alias("probability"))
    vectors = rows.select("doc_id", "paragraph_index", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    from quillmark.operators import features

    query = features.keywords(analyze(docs)["paragraphs"].filter("doc_id = 1 AND paragraph_index = 2")).first()["query"]
    save(tmp_path, "openalex", query, json.dumps(JSON))
    asked = spark.createDataFrame([(query,)], "query string")
    found = search.ask(asked, {s: search.snapshot(str(tmp_path), s) for s in ("arxiv", "openalex")}, first_wait=0.0).withColumn("source_vector", F.array(F.lit(0.8), F.lit(0.6)))
    a = analyze(docs, inputs=Inputs(labels=labels, vectors=vectors, candidates=found))
    from quillmark.operators import vectors as V

    other = ["ships sail over the deep sea with wind", "gold coins lie in the old chest under wind", "leaves fall from the tall trees over the sea"] * 3
    learnt = spark.createDataFrame([(i, 0, t) for i, t in enumerate([line, line, *other])], "doc_id long, paragraph_index int, text string")

    def cut(frame, name):
        frame.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    terms = cut(V.learn(learnt, cut=cut, dimensions=4), "table")
    assert V.embed(docs.select("doc_id", "text"), terms.limit(0), ("doc_id",)).first()["vector"] == []
    made = analyze(docs, inputs=Inputs(labels=labels, candidates=found.drop("source_vector").withColumn("abstract", F.when(F.col("rank") == 1, line * 4).otherwise("ships sail over the sea")), terms=terms))
    assert [r["title"] for r in made["sources"].filter("doc_id = 1").collect()] == ["Work"]
    assert ("source_arxiv_timeout" in {r["code"] for r in a["warnings"].collect()}) and [(r["title"], r["authors"], r["year"], r["similarity"]) for r in a["sources"].filter("doc_id = 1").collect()] == [("Work", ["D", ""], 2020, 0.8)]
