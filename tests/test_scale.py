"""The forms of queries that grow with their input: the same results as the expressions that they stand for."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.config import DEFAULT, FEATURES
from quillmark.functions import text as T
from quillmark.llm import quality_model
from quillmark.operators import clauses, clustering, evaluate, features, ingest, kernel, lemmas, sentences, sources, tagging, vectors
from quillmark.plans import catalogue

TEXTS = ["He didn't see The Old Houses, and they were Quickly sold by İs 3,400 men!", "", None, "She said that it's made of glass: Who was taken? \"Yes\" they Wanted to run and get paid " * 3, "Σας ies ly quickly 42nd ½ \u0085 x"]


def test_classes_of_different_tokens_equal_the_classes_of_all(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").select("i", F.coalesce(tagging.tokens("text"), F.array().cast("array<string>")).alias("w"))
    told = rows.select("w", tagging.classes(F.col("w")).alias("c")).orderBy("i").collect()
    ends = np.concatenate([[0], np.cumsum([len(r["w"]) for r in told])])
    assert tagging.codes_of(pa.array([w for r in told for w in r["w"]]), ends, {}).tolist() == [c for r in told for c in r["c"]]


def test_walked_clauses_and_summaries_equal_the_expressions(spark):
    d = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "doc_id int, paragraph_index int, text string")
    tagged = tagging.tag(d)
    want = {r["doc_id"]: [tuple(c) for c in r["c"]] for r in tagged.select("doc_id", clauses.clauses("tags").alias("c")).collect()}
    assert {r["doc_id"]: clauses.walk([(x["word"].lower(), x["tag"]) for x in r["tags"]]) for r in tagged.collect()} == want
    assert sorted(features.path_summary(d).collect()) == sorted(features.tag_summary(tagged).collect())
    words = lemmas.vocabulary(spark.createDataFrame([(w,) for w in "house houses walk walks walked say says".split()], "word string"))
    table = lemmas.lemma_table(words, lemmas.rules(words, 1))
    assert sorted(features.lemma_queries(d, table).collect()) == sorted(features.lemma_keywords(tagged, table).collect())


def test_silhouette_meets_all_rows_of_a_key_block_by_block(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, i % 3, v) for k in (0, 1) for i, v in enumerate((rng.normal(size=(40, 5)) * (k + 1)).tolist())] + [(2, i, i % 2, [1.0] * 5) for i in range(6)] + [(3, 0, 0, [1.0] * 5)]
    got = {r["k"]: r["silhouette"] for r in evaluate.silhouette(spark.createDataFrame(rows, "k int, i long, l long, v array<double>"), "v", "k", "l", "i", block=7).collect()}
    want = {2: 0.0, 3: -1.0}
    for k in (0, 1):
        x, label = np.array([r[3] for r in rows if r[0] == k]), np.array([r[2] for r in rows if r[0] == k])
        gap = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(2))
        a = [gap[i][(label == label[i]) & (np.arange(40) != i)].mean() for i in range(40)]
        b = [min(gap[i][label == m].mean() for m in range(3) if m != label[i]) for i in range(40)]
        want[k] = float(np.mean([(q - p) / max(p, q) for p, q in zip(a, b, strict=True)]))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_nearest_vectors_by_blocks_with_copies(spark):
    x = np.random.default_rng(4).normal(size=(30, 4))
    x[20:] = x[:10]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "source_id long, vector array<double>")
    got = {}
    for r in sources.nearest(table.filter("source_id % 5 = 0").withColumnRenamed("source_id", "query_id"), table, 3, block=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["source_id"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 30, 5):
        best = sorted((i for i in range(30) if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:3]
        assert [got[q][r] for r in (1, 2, 3)] == best


def test_every_vector_is_asked_for_its_nearest(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(120, 4)).astype(np.float32)
    x[90:] = x[:30]
    table = spark.createDataFrame([(i * 7, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["rank"]): (r["source_id"], r["similarity"]) for r in catalogue.cosine_topk(spark, str(tmp_path)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {}
    for q in range(120):
        for rank, i in enumerate(sorted((i for i in range(120) if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:3], 1):
            want[q * 7, rank] = (i * 7, float(unit[q] @ unit[i]))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    every = table.select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("vector"))
    dealt = sources.nearest(every.withColumnRenamed("source_id", "query_id"), every, 3, block=4)
    assert {(r["query_id"], r["rank"]): r["source_id"] for r in dealt.collect()} == {k: v[0] for k, v in want.items()}


def test_best_of_a_block_by_pieces_of_the_product(monkeypatch):
    rng = np.random.default_rng(8)
    s = rng.normal(size=(60, 3))
    s[20:40], s[50:] = s[:20], s[0]
    s /= np.linalg.norm(s, axis=1, keepdims=True)
    s[7] = 0
    ids = np.sort(np.append(np.arange(58), [5, 9]))  # two ids stand twice
    for columns in (2, 7, 100):
        monkeypatch.setattr(sources, "COLUMNS", columns)
        for k in (1, 3, 59, 80):
            row, source, value = sources.best(s, ids, s, ids, k)
            for q in range(60):
                every = sorted((-round(float(s[q] @ s[i]), 12) + 0.0, int(ids[i])) for i in range(60) if ids[i] != ids[q])[:k]
                assert source[row == q].tolist() == [i for _, i in every] and np.allclose(value[row == q], [-v for v, _ in every])


def test_index_and_neighbours_of_a_document_stay_in_its_row(spark):
    d = spark.createDataFrame([(1, "a b a".split()), (2, ["x"]), (3, [])], "doc_id int, words array<string>")
    assert {r["doc_id"]: r["_index"] for r in sources.inverted_index(d).collect()} == {1: {"a": [0, 2], "b": [1]}, 2: {"x": [0]}, 3: {}}
    told = "common tree house river stone cloud light paper metal glass"
    p = spark.createDataFrame([(1, 0, told), (1, 1, told), (1, 2, told.replace("o", "0")), (1, 3, "too short"), (2, 0, told)], "doc_id int, paragraph_index int, text string")
    got = {r["doc_id"]: (r["n"], [(x["position"], x["similarity"]) for x in r["near"]]) for r in evaluate.neighbours(p).collect()}
    assert got[2] == (1, []) and got[1][0] == 3 and [i for i, _ in got[1][1]] == [1, 2] and abs(got[1][1][0][1] - 1) < 1e-12 and 0 < got[1][1][1][1] < 1


def test_lemmas_of_rules_with_many_results(spark):
    words = "walk walked talk talked jump jumped bake baked like liked note noted plan planned studies study parties party flies fly zorked".split()
    known = lemmas.vocabulary(spark.createDataFrame([(w,) for w in words], "word string"))
    got = {(r["word"], r["tag"]): r["lemma"] for r in lemmas.lemma_table(known, lemmas.rules(known, 2)).collect()}
    assert got["baked", "VERB"] == "bake" and got["talked", "VERB"] == "talk" and got["parties", "NOUN"] == "party" and got["zorked", "VERB"] == "zork"


def test_quality_model_is_fitted_on_all_trusted_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda trusted: seen.append(trusted.count()) or spark.createDataFrame([], "gram long, p double, gamma double"))
    docs = spark.range(8100).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("some text").alias("text"))
    assert quality_model.judge(docs, docs.select("doc_id", F.lit(1).alias("quality"))).filter("kept").count() == 8100
    assert seen == [8100]


def test_entries_of_texts_are_counted_in_place_and_meet_rare_terms_too(spark, monkeypatch):
    rows = [(1, 0, "a b b ç"), (1, 1, "b c d e"), (2, 0, "C x a"), (3, 0, None), (4, 0, "1 2"), (5, 0, "d e e f"), (5, 0, "d f")]
    d, key = spark.createDataFrame(rows, "doc_id int, paragraph_index int, text string"), ("doc_id", "paragraph_index")
    assert "Exchange" not in vectors.counts(d, key)._jdf.queryExecution().executedPlan().toString()
    texts = {}
    for i, j, t in rows:
        texts.setdefault((i, j), []).append([w for w in (t or "").lower().split() if w.isalpha()])
    n = {(k, w): sum(t.count(w) for t in ts) for k, ts in texts.items() for w in {w for t in ts for w in t}}
    every, of = sum(n.values()), lambda w: [v for (_, x), v in n.items() if x == w]
    want = {(*k, w): np.log(v / max(map(len, texts[k])) / (sum(of(w)) / every)) for (k, w), v in n.items() if len(of(w)) > 1}
    want = {k: v for k, v in want.items() if v > 0}
    for common in (100, 2):
        monkeypatch.setattr(vectors, "COMMON", common)
        shares, entries = vectors.entries_of(vectors.counts(d, key, apart=False), key)
        got = {(r["doc_id"], r["paragraph_index"], r["term"]): r["entry"] for r in entries.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 5
        assert shares.count() == len({w for _, w in n if len(of(w)) > 1})


def test_documents_are_clustered_batch_by_batch(spark):
    rng = np.random.default_rng(5)
    rows = [(d if d < 9 else None, i, *np.round(rng.normal(size=len(FEATURES)) * 0.3 + i % 2 * 5, 1).tolist(), d * 100 + i) for d, n in enumerate((1, 4, 6, 12, 7, 0, 30, 5, 9, 8)) for i in range(n)] + [(5, None, *[0.0] * len(FEATURES), -1)]
    ddl = "doc_id long, paragraph_index int, " + ", ".join(f"{c} double" for c in FEATURES) + ", tag int"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = clustering.label(spark.createDataFrame(rows, ddl).withColumn("is_valid", F.lit(True)), carry=("tag",))
        got = {r["tag"]: (r["cluster_id"], r["probability"], r["outcome"]) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Groups" not in made._jdf.queryExecution().executedPlan().toString()
    want = {-1: (None, None, "skipped")}
    for d in {r[0] for r in rows} - {5}:
        mine = [r for r in rows if r[0] == d]
        x = np.array([r[2:-1] for r in mine])
        outcome, labels, sure = kernel.guard(x, np.ones(len(x), bool), DEFAULT), [0] * len(x), [1.0] * len(x)
        if outcome == "cluster":
            labels, sure, outcome = kernel.cluster(x, DEFAULT)
        want |= {r[-1]: (int(k), float(p), outcome) for r, k, p in zip(mine, labels, sure, strict=True)}
    assert got == want and {"skipped", "cluster"} <= {v[2] for v in want.values()}


def test_both_trees_of_the_kernel_are_one(spark):
    rng = np.random.default_rng(6)
    for n in (2, 3, 9, 40, 70):
        for x in (rng.normal(size=(n, 8)), np.round(rng.normal(size=(n, 8))), np.zeros((n, 8))):
            assert kernel._few(x, min(2, n - 1)) == kernel._many(x, min(2, n - 1))


def test_later_methods_of_extraction_are_tried_only_where_earlier_ones_find_nothing(spark):
    long = "a long line of words " * 5
    rows = [(1, f" {long} \nshort"), (2, "short lines\n" * 12), (3, "too short"), (4, ""), (5, None), (6, " " * 90)]
    found = ingest.extraction(spark.createDataFrame(rows, "doc_id int, text string"))
    got = {r["doc_id"]: (r["extraction_method"], r["parts"]) for r in found.collect()}
    assert got == {1: ("lines", [long.strip()]), 2: ("pages", [("short lines " * 12).strip()]), 3: ("raw_chunk", []), 4: ("none", []), 5: ("none", []), 6: ("none", [])}
    assert "CASE WHEN" in next(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "{2,}" in x).split("{2,}")[0]  # clean() is conditional
    odd = ["", " ", "\x1c a \x1f", "a\n", "\r\n a b  \n", "᠎a​", "　é\u0085", "\x00 a"]
    d = spark.createDataFrame([(t,) for t in odd], "t string").select(T.strip("t").alias("a"), F.regexp_replace("t", rf"(?U)^{T.SPACE}+|{T.SPACE}+$", "").alias("b"))
    assert all(r["a"] == r["b"] for r in d.collect()) and "regexp_replace" not in T.strip("t")._jc.toString()


def test_words_of_sentences_are_counted_as_written_and_ends_move_without_texts(spark, monkeypatch):
    texts = ["He met Dr. Low. He ran! no one saw J. K. It was late etc. and (so.) He left", "Dr. No said: ask Dr. Who? Yes. It was", "", None, "no sign", "a.b. c.d. It"]
    d = spark.createDataFrame([(i if i < 5 else None, 0, t) for i, t in enumerate(texts)], "doc_id int, paragraph_index int, text string")
    got = {r["word"]: (r["n_dot"], r["n_first"], r["firsts"], r["n"]) for r in sentences.occurrences(d).collect()}
    assert got["dr"] == (3, 0, 0, 3) and got["he"] == (0, 2, 2, 3) and got["it"] == (0, 2, 2, 3) and got["low"] == (1, 1, 1, 1) and got["no"] == (0, 1, 2, 3) and got["a.b"] == (1, 0, 0, 1)
    short = spark.createDataFrame([("dr", True), ("etc", True)], "word string, is_abbreviation boolean")
    start = spark.createDataFrame([("it", True)], "word string, is_starter boolean")
    for few in (10, 0):
        monkeypatch.setattr(sentences, "FEW", few)
        found = sentences.ends(d, short, start)
        assert few == 0 or found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
        assert {r["doc_id"]: r["sentence_ends"] for r in found.collect()} == {0: [4, 6, 17, 19], 1: [6, 7, 9], 4: [2], None: [2, 3]}
    assert sorted((r["doc_id"] or 9, r["sentence_ends"]) for r in sentences.boundaries(d, short, start).collect() if r["doc_id"] != 0) == [(1, [6, 7, 9]), (2, []), (3, []), (4, [2]), (9, [2, 3])]


def test_a_paragraph_is_lowered_once_for_all_its_hashes(spark):
    text = "The Quick brown fox jumps over the lazy dog, and then the dog sleeps in the warm sun of May."
    p = spark.createDataFrame([(1, 0, f"  {text.upper()} "), (2, 0, text.replace("May", "June") + " " * 30)], "doc_id int, paragraph_index int, text string")
    b = spark.createDataFrame([(7, f"before {text} after"), (8, "nothing of it " * 9)], "source_id int, body string")
    found = sources.containing(p, b, shortest=80)
    assert "xxhash64(substring(lower(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 0, 7)]
