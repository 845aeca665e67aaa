"""Tags, sentences, lemmas and clauses against brute force and hand-made answers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import clauses, features, language, lemmas, sentences, sources, tagging
from quillmark.plans.analyze import Inputs, analyze

# Tagged by hand before the tagger ran on them: formal and plain prose. Letters as tagging.LETTERS.
BY_HAND = [
    ("The method was applied to every sample .", "DNXVIDNZ"),
    ("We ran the tests twice .", "PVDNRZ"),
    ("You don't need a new tool .", "PXTVDJNZ"),
    ("That's a big problem .", "PXDJNZ"),
    ("The results were clear , and nobody asked why .", "DNXJZCPVSZ"),
    ("Smith wrote the first version in Paris .", "MVDJNIMZ"),
    ("It was shown that these models perform well when data are scarce .", "PXVSDNVRSNXJZ"),
    ("She quickly closed the old window because it was raining .", "PRVDJNSPXVZ"),
    ("They want to build 3 large systems .", "PVTVUJNZ"),
    ("However , the proposed framework preserves the meaning of each sentence .", "RZDJNVDNIDNZ"),
    ("The committee has not decided whether it should publish the report .", "DNXTVSPXVDNZ"),
    ("My brother sells books and maps to tourists .", "QNVNCNINZ"),
    ("Most readers like short stories .", "JNVJNZ"),
    ("The evaluation demonstrates considerable improvement across several domains .", "DNVJNIJNZ"),
    ("Nothing works .", "PVZ"),
    ("He looked at the map before the meeting started .", "PVIDNSDNVZ"),
]


def codes_of(spark, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["c"] for r in d.select("i", tagging.classes(tagging.tokens("text")).alias("c")).orderBy("i").collect()]


def flat(lists):
    return np.array([c for x in lists for c in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


def test_tokens_keep_contractions_and_signs_apart(spark):
    text = "I don't think it's 3,5 % of O'Neil's ‘plan'; can’t 'some' (x)."
    got = spark.range(1).select(tagging.tokens(F.lit(text)).alias("t")).first()["t"]
    assert got == ["I", "do", "n't", "think", "it", "'s", "3,5", "%", "of", "O", "'", "Neil", "'s", "‘", "plan", "'", ";", "ca", "n’t", "'", "some", "'", "(", "x", ")", "."]


def test_paths_are_the_best_of_all_paths(spark):
    step, show = tagging.PRIOR.scores()
    lists = [c[:6] for c in codes_of(spark, [t for t, _ in BY_HAND] + ["that like to as so", "one", "more of that"])]
    codes, ends = flat(lists)
    got = tagging.decode(codes, ends, tagging.PRIOR)
    for k, x in enumerate(lists):
        ways = [[t for t in range(len(tagging.TAGS)) if show[c, t] > tagging.NEVER] for c in x]
        score = lambda p, x=x: step[0, p[0]] + show[x[0], p[0]] + sum(step[a + 1, b] + show[c, b] for a, b, c in zip(p, p[1:], x[1:], strict=False))
        best = max(itertools.product(*ways), key=score)
        assert score(best) == score(tuple(got[ends[k] : ends[k + 1]]))


def test_expected_counts_are_sums_over_all_paths(spark):
    lists = [c[:5] for c in codes_of(spark, ["that like to as", "more of that", "The old tests run", "so"])]
    codes, ends = flat(lists)
    moves, shown, told = tagging.expected(codes, ends, tagging.PRIOR)
    want_moves, want_shown, want = np.zeros_like(moves), np.zeros_like(shown), 0.0
    a, b = tagging.PRIOR.transition, tagging.PRIOR.emission
    for x in lists:
        weights = {p: np.prod([a[u, t] * b[c, t] for u, t, c in zip((0, *(q + 1 for q in p[:-1])), p, x, strict=True)]) for p in itertools.product(*[np.flatnonzero(b[c]).tolist() for c in x])}
        total = sum(weights.values())
        want += np.log2(total)
        for p, w in weights.items():
            for i, t in enumerate(p):
                want_moves[p[i - 1] + 1 if i else 0, t] += w / total
                want_shown[x[i], t] += w / total
    assert np.allclose(moves, want_moves) and np.allclose(shown, want_shown) and told == pytest.approx(want)


def test_training_never_lowers_the_likelihood_and_keeps_what_is_ruled_out(spark):
    docs = spark.createDataFrame([(t,) for t, _ in BY_HAND] * 2, "text string").repartition(3)
    model, history = tagging.learn(docs, rounds=5, strength=0.0)
    assert all(b >= a - 1e-6 for a, b in zip(history[1:], history[2:], strict=False)) and history[-1] > history[1]
    assert ((model.emission > 0) <= (tagging.PRIOR.emission > 0)).all()
    strong, _ = tagging.learn(docs, rounds=2)
    assert accuracy(spark, strong) > 0.9


def accuracy(spark, model):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BY_HAND)], "i int, text string")
    got = [r["p"] for r in tagging.tag(d, model).select("i", tagging.letters("tags").alias("p")).orderBy("i").collect()]
    assert [len(g) for g in got] == [len(p) for _, p in BY_HAND]
    return np.mean([a == b for g, (_, p) in zip(got, BY_HAND, strict=True) for a, b in zip(g, p, strict=True)])


def test_sentences_tagged_by_hand(spark):
    assert accuracy(spark, tagging.PRIOR) > 0.9


def test_odd_texts_have_no_tags(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, " \t "), (4, "x " * 3000)], "doc_id int, text string")
    assert {r["doc_id"]: len(r["tags"]) for r in tagging.tag(d).collect()} == {1: 0, 2: 0, 3: 0, 4: 3000}
    assert tagging.tag(d.limit(0)).collect() == []


BOUNDS = [
    ("Dr. Smith met Mr. Jones at noon. They spoke for an hour.", [7, 12]),
    ('"Really?" she asked. He left! Nobody, i.e. no one, saw it.', [1, 3, 5, 11]),
    ("It ended at 5 p.m. and we left. See fig. three.", [8, 11]),
    ("J. R. Brown wrote it. Dr. Who did not...but then. Fine", [5, 10, 11]),
    ("no end", [2]),
]


def test_sentence_ends_marked_by_hand(spark):
    corpus = ["Dr. Adams and Mr. Bell met Dr. Cole at 4 p.m. today i.e. late. The dog slept near fig. two and fig. six. They left. He left early and met Mr. Dent."] * 40
    learnt = spark.createDataFrame([(100 + i, 0, t) for i, t in enumerate(corpus)], "doc_id int, paragraph_index int, text string")
    rows = spark.createDataFrame([(i, 0, t) for i, (t, _) in enumerate(BOUNDS)] + [(50, 0, None), (50, 1, "")], learnt.schema)
    words = sentences.occurrences(learnt)
    short = sentences.abbreviations(words)
    assert {"dr", "mr", "p.m", "i.e", "fig"} <= {r["word"] for r in short.filter("is_abbreviation").collect()}
    got = {(r["doc_id"], r["paragraph_index"]): r["sentence_ends"] for r in sentences.boundaries(rows, short, sentences.starters(words, short)).collect()}
    assert got[50, 0] == got[50, 1] == []
    for i, (_, ends) in enumerate(BOUNDS):
        assert got[i, 0] == ends


CLAUSES = [
    ("The filter removed the noise.", [("filter", "removed", "noise", False)]),
    ("The noise was removed by the filter.", [("noise", "removed", None, True)]),
    ("We ran the tests because the old results had a flaw.", [("we", "ran", "tests", False), ("results", "had", "flaw", False)]),
    ("Smith wrote a long letter to the editor, and Jones read the paper.", [("smith", "wrote", "letter", False), ("jones", "read", "paper", False)]),
    ("The method was carefully designed to preserve the style of each document.", [("method", "designed", None, True), ("method", "preserve", "style", False)]),
    ("She looked at the numbers but nobody found the error.", [("she", "looked", None, False), ("nobody", "found", "error", False)]),
    ("The results were clear.", []),
    ("He wants to read the book.", [("he", "wants", None, False), ("he", "read", "book", False)]),
    ("The essays in the folder contain the answer.", [("essays", "contain", "answer", False)]),
    ("Their paper got rejected; the editor sent my letter back.", [("paper", "rejected", None, True), ("editor", "sent", "letter", False)]),
]


def test_clauses_written_by_hand(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLAUSES)], "i int, text string")
    found = tagging.tag(d).select("i", clauses.clauses("tags").alias("c")).withColumn("p", clauses.passives("c")).orderBy("i").collect()
    for r, (text, want) in zip(found, CLAUSES, strict=True):
        assert [tuple(c) for c in r["c"]] == want, text
    assert [r["p"] for r in found] == [2 * sum(c[3] for c in x) for _, x in CLAUSES]


WORDS = "study studies studied city cities party parties party copy copies copied box boxes fox foxes tax taxes test tests tested testing walk walks walked walking jump jumps jumped jumping bake bakes baked baking hope hopes hoped hoping like likes liked liking note notes carry carries carried men fast faster fastest slow slower slowest warm warmer warmest bus buses".split()


def lemma_of(spark, words):
    known = lemmas.vocabulary(spark.createDataFrame([(w,) for w in words], "word string"))
    return lemmas.lemma_table(known, lemmas.rules(known))


def test_lemmas_by_rules_of_the_corpus(spark):
    got = {(r["word"], r["tag"]): r["lemma"] for r in lemma_of(spark, WORDS).collect()}
    for word, tag, lemma in [("studies", "NOUN", "study"), ("cities", "NOUN", "city"), ("boxes", "NOUN", "box"), ("tests", "NOUN", "test"), ("tested", "VERB", "test"), ("baking", "VERB", "bake"), ("hoped", "VERB", "hope"), ("jumping", "VERB", "jump"), ("men", "NOUN", "man"), ("slower", "ADJ", "slow"), ("fastest", "ADJ", "fast")]:
        assert got[word, tag] == lemma, (word, got[word, tag])
    assert ("study", "NOUN") not in got and ("box", "NOUN") not in got
    assert lemma_of(spark, []).collect() == []


def test_keywords_and_triplets_by_lemmas(spark):
    text = "The studies tested the old cities. Every party copied boxes. We walked and hoped that the tests of the faster buses worked."
    d = spark.createDataFrame([(1, 0, text), (1, 1, "The study tests the city. A party copies the box."), (2, 0, None), (2, 1, "too short")], "doc_id int, paragraph_index int, text string")
    tagged, table = tagging.tag(d), lemma_of(spark, WORDS)
    got = {(r["doc_id"], r["paragraph_index"]): r["query"] for r in features.lemma_keywords(tagged, table).collect()}
    assert set(got) == {(1, 0), (1, 1)} and got[1, 0] == "party AND study AND city"
    ideas = {(r["doc_id"], r["paragraph_index"]): r["triplets"] for r in clauses.triplets(tagged, table).collect()}
    assert {"study_test_city", "party_copy_box"} <= set(ideas[1, 0]) & set(ideas[1, 1])
    assert ideas[2, 0] == ideas[2, 1] == []


FORMAL = "The approach that is described in this report was developed for the evaluation of complex systems. The measurements were collected by trained observers and the data were analysed with established procedures."
PLAIN = "We built a thing. It works. You don't have to tune it. I like that. They tried it and they loved it. Nobody broke it. We ship it now."


def test_the_two_styles_differ_in_tagged_features(spark, tmp_path):
    rows = [(d, i, t) for d, t in ((1, FORMAL), (2, PLAIN)) for i in range(2)]
    d = spark.createDataFrame(rows, "doc_id int, paragraph_index int, text string")
    language.learn(d, rounds=1).save(str(tmp_path / "language"))
    known = language.load(spark, str(tmp_path / "language"))
    got = {r["doc_id"]: r for r in features.measured(known.annotate(d)).collect()}
    assert got[1]["passive_voice_pct"] > 100 > 1 > got[2]["passive_voice_pct"]
    assert got[2]["pronoun_ratio"] > 3 * got[1]["pronoun_ratio"] and got[1]["preposition_ratio"] > got[2]["preposition_ratio"]
    assert got[1]["num_sentences"] == 2 and got[2]["num_sentences"] == 7


def test_analysis_reads_the_language(spark):
    text = "\n".join([FORMAL + " " + FORMAL, PLAIN + " " + PLAIN, FORMAL, PLAIN, FORMAL + " Again."])
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    paragraphs = analyze(docs)["paragraphs"].select("doc_id", "paragraph_index", "text")
    known = language.learn(paragraphs)
    told = analyze(docs, inputs=Inputs(language=known))
    rows = {r["paragraph_index"]: r for r in told["features"].collect()}
    assert rows[0]["passive_voice_pct"] > 100 and rows[1]["passive_voice_pct"] == 0
    assert {r["doc_id"]: r["status"] for r in told["report"].collect()} == {1: "success", 2: "error"}


def test_ties_go_to_the_first_service_and_clauses_raise_the_similarity(spark):
    text = "The filter removed the noise and the team measured the signal again in ten long sessions."
    anomalies = spark.createDataFrame([(1, 0, text, [1.0, 0.0])], "doc_id long, paragraph_index int, text string, vector array<double>")
    known = language.learn(anomalies)
    query = sources.queries(anomalies, known).first()["query"]
    rows = [(query, "OpenAlex", 1, 7, "b", "The filter removes nothing.", [0.6, 0.8], "2001"), (query, "arXiv", 2, 8, "a", "The filter removed the noise.", [0.6, 0.8], "2002")]
    found = spark.createDataFrame(rows, "query string, origin string, rank int, source_id long, title string, abstract string, source_vector array<double>, year string")
    got = sources.trace(anomalies, found, language=known).collect()
    assert [(r["source_id"], r["origin"], r["similarity"], r["year"]) for r in got] == [(8, "arXiv", 0.66, "2002")]


def test_containment_by_winnowed_hashes(spark):
    rng = np.random.default_rng(2)
    body = "".join(rng.choice(list("abcdeé \U0001f600"), 3000))
    texts = spark.createDataFrame([(1, body), (2, body[500:900].upper() + "x" * 50), (3, None), (4, "short"), (5, body[100:145])], "source_id long, body string")
    spots = [(0, 80), (500, 64), (501, 63), (510, 62), (520, 45), (100, 45), (600, 290), (2900, 100), (850, 60)]
    rows = [(i, 0, body[a : a + n]) for i, (a, n) in enumerate(spots)] + [(50, 0, body[:80] + "z"), (51, 0, None)]
    rows = [(i, p, t) for i, p, t in rows if t is None or t == t.strip()]
    got = {tuple(r) for r in sources.containing(spark.createDataFrame(rows, "doc_id long, paragraph_index int, text string"), texts).collect()}
    want = {(i, p, s) for i, p, t in rows if t for s, b in texts.collect() if b and t.lower() in b.lower()}
    assert got == want and len(want) > 6
