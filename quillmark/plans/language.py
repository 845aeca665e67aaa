"""Registered queries of tags, sentences, lemmas and clauses, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FUNCTION_WORDS
from ..functions import numeric as N
from ..functions import text as T
from ..operators import clauses, clustering, features, lemmas, sentences, sources, tagging, vectors
from .catalogue import ORACLE, WORDS, P, R, documents, paragraphs, query

# --- tags


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tags() -> str:
    """The lattice of each paragraph, walked a token a round; `path` has its best path."""
    step, show = tagging.PRIOR.scores()
    cases = [f"WHEN regexp_full_match(low, {_quoted(p)}) THEN {i}" for i, (p, _) in enumerate(tagging.SHAPES.values())]
    cases += [f"WHEN low IN ({', '.join(map(_quoted, words.split()))}) THEN {len(cases) + i}" for i, (words, _) in enumerate(tagging.LISTS.values())]
    cases += [rf"""WHEN before IS NOT NULL AND before NOT IN ('.', '!', '?', ':', '"', '“') AND regexp_matches(tok, '^\p{{Lu}}') THEN {len(cases)}"""]
    cases += [f"WHEN regexp_full_match(low, {_quoted(p)}) THEN {len(cases) + i}" for i, (p, _) in enumerate(tagging.ENDINGS.values())]
    shown = ", ".join(f"({c}, {t}, {v}::BIGINT)" for c, row in enumerate(show.tolist()) for t, v in enumerate(row) if v > tagging.NEVER)
    moves = ", ".join(f"({u - 1}, {t}, {v}::BIGINT)" for u, row in enumerate(step.tolist()) for t, v in enumerate(row))
    return rf"""{P}, tk AS (SELECT doc_id, paragraph_index, list_transform(regexp_extract_all(regexp_replace(text, {_quoted(tagging.CLITIC)}, '\1 {tagging.MARK}\2\3', 'g'), {_quoted(tagging.TOKEN)}), lambda x: replace(x, '{tagging.MARK}', '')) AS tk FROM p),
tn AS (SELECT doc_id, paragraph_index, i, tk[i] AS tok, lower(tk[i]) AS low, CASE WHEN i > 1 THEN tk[i - 1] END AS before FROM (SELECT *, unnest(range(1, len(tk) + 1)) AS i FROM tk)),
tc AS (SELECT doc_id, paragraph_index, i, tok, CASE {" ".join(cases)} END AS c FROM tn),
em(c, t, e) AS (VALUES {shown}), tr(u, t, m) AS (VALUES {moves}),
ls AS (SELECT doc_id, paragraph_index, i, t, e FROM tc JOIN em USING (c)),
wk AS (SELECT doc_id, paragraph_index, i, ls.t, e + m AS s, substr('{tagging.LETTERS}', ls.t::INT + 1, 1) AS path FROM ls JOIN tr ON tr.u = -1 AND tr.t = ls.t WHERE i = 1
  UNION ALL SELECT wk.doc_id, wk.paragraph_index, ls.i, ls.t, max(s + m) + any_value(e), arg_max(path, (s + m) * 100 - wk.t) || substr('{tagging.LETTERS}', ls.t::INT + 1, 1)
  FROM wk JOIN ls ON ls.doc_id = wk.doc_id AND ls.paragraph_index = wk.paragraph_index AND ls.i = wk.i + 1 JOIN tr ON tr.u = wk.t AND tr.t = ls.t GROUP BY wk.doc_id, wk.paragraph_index, ls.i, ls.t),
tg AS (SELECT tk.doc_id, tk.paragraph_index, tk.tk, max(s) AS s, arg_max(path, s * 100 - t) AS path FROM tk LEFT JOIN wk ON wk.doc_id = tk.doc_id AND wk.paragraph_index = tk.paragraph_index AND wk.i = len(tk.tk) GROUP BY ALL)"""


TAGGED = _tags()


@query(f"WITH RECURSIVE {TAGGED} SELECT doc_id, paragraph_index::INT AS paragraph_index, len(tk)::INT AS n_tokens, s AS score, path FROM tg")
def pos_tags(spark, d):
    """Tags of every paragraph as letters, and the score of their path, added up from the model's tables."""
    return tagging.paths(paragraphs(spark, d)).select("doc_id", "paragraph_index", F.length("path").alias("n_tokens"), "score", "path")


def _count(letters: str) -> str:
    return " + ".join(f"length(path) - length(replace(path, '{c}', ''))" for c in letters)


@query(f"WITH RECURSIVE {TAGGED} SELECT doc_id, paragraph_index::INT AS paragraph_index, {', '.join(R(f'({_count(c)})::DOUBLE / greatest(len(tk), 1)', 4) + f' AS {n}' for n, c in (('pronoun_ratio', 'PQ'), ('preposition_ratio', 'I'), ('conjunction_ratio', 'CS')))} FROM tg")
def tagged_pos_ratios(spark, d):
    """The ratios of word classes by tags instead of by lists."""
    return tagging.paths(paragraphs(spark, d)).select("doc_id", "paragraph_index", *(N.round_even(c, 4).alias(n) for n, c in features.path_ratios("path").items()))


_COUNTED = ", ".join(f"({_count(''.join(tagging.LETTERS[tagging.TAGS.index(t)] for t in names))})::INT AS {n}" for n, names in features.TAGS.items())


@query(rf"""WITH RECURSIVE {TAGGED}, w AS (SELECT doc_id, paragraph_index, lower(tk[i]) AS w, i, path[i] AS c FROM (SELECT *, unnest(range(1, len(tk) + 1)) AS i FROM tg)),
fw AS (SELECT doc_id, paragraph_index, w, count(*) AS n, min(i) AS pos FROM w WHERE c IN ('I', 'C', 'S', 'P', 'Q', 'D', 'X') AND regexp_full_match(w, '\p{{L}}+') GROUP BY doc_id, paragraph_index, w QUALIFY row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY n DESC, pos) <= 5),
fj AS (SELECT doc_id, paragraph_index, string_agg(w || ':' || n, ',' ORDER BY n DESC, pos) AS t FROM fw GROUP BY ALL)
SELECT doc_id, paragraph_index::INT AS paragraph_index, {_COUNTED}, coalesce(t, '') AS top_function_words FROM (SELECT * REPLACE (coalesce(path, '') AS path) FROM tg) LEFT JOIN fj USING (doc_id, paragraph_index)""")
def tagged_summary(spark, d):
    """Counts of seven word classes and the most frequent function words, by tags."""
    return features.path_summary(paragraphs(spark, d))


# --- sentences

_WORD = _quoted(sentences.WORD)
_LN = "(CASE WHEN {k} = 0 THEN 0.0 ELSE {k} * ln({p}) END + CASE WHEN {m} = 0 THEN 0.0 ELSE {m} * ln(1.0::DOUBLE - {p}) END)"


def _ln(p: str, k: str, m: str) -> str:
    return _LN.replace("{k}", k).replace("{m}", m).replace("{p}", f"({p})")


ABBREVIATIONS = rf"""{P}, sw AS (SELECT doc_id, paragraph_index, w FROM (SELECT doc_id, paragraph_index, {WORDS.format("text")} AS w FROM p)),
si AS (SELECT doc_id, paragraph_index, i, w[i] AS w, coalesce(i > 1 AND regexp_matches(w[i - 1], '{sentences.ENDS}') AND NOT regexp_matches(w[i - 1], '^\p{{L}}\.$'), false) AS f, w[i + 1] AS nx, i = len(w) AS z FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM sw)),
so AS (SELECT lower(regexp_extract(w, {_WORD}, 1)) AS word, regexp_extract(w, {_WORD}, 2) = '.' AS dot, regexp_matches(regexp_extract(w, {_WORD}, 1), '^\p{{Lu}}') AS capital, f FROM si WHERE regexp_extract(w, {_WORD}, 1) <> ''),
sc AS (SELECT word, count(*) FILTER (dot) AS n_dot, count(*) AS n, count(*) FILTER (f AND capital) AS n_first FROM so GROUP BY word),
sa AS (SELECT sum(n_dot) AS dots, sum(n) AS al, (SELECT count(*) FILTER (f) FROM so) AS firsts FROM sc),
ab AS (SELECT word, n_dot, n, round(2 * ({_ln(f"{sentences.SURE}::DOUBLE", "n_dot", "(n - n_dot)")} - {_ln("dots::DOUBLE / al", "n_dot", "(n - n_dot)")}) * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', ''))::DOUBLE, -(n - n_dot)), 4) + 0.0 AS score FROM sc, sa WHERE n_dot > 0)"""
_OTHER = "(n - n_first)"
STARTERS = rf"""{ABBREVIATIONS}, st AS (SELECT word, n_first, n, n_first::DOUBLE / firsts > n::DOUBLE / al AS more, round(2 * ({_ln("n_first::DOUBLE / firsts", "n_first", "(firsts - n_first)")} + {_ln("CASE WHEN al > firsts THEN (n - n_first)::DOUBLE / greatest(al - firsts, 1) ELSE 0.0 END", _OTHER, "(al - firsts - n + n_first)")}
  - {_ln("n::DOUBLE / al", "n_first", "(firsts - n_first)")} - {_ln("n::DOUBLE / al", _OTHER, "(al - firsts - n + n_first)")}), 4) + 0.0 AS score FROM sc, sa WHERE n_first > 0),
sx AS (SELECT st.word, st.n_first, st.n, st.score, more AND st.score >= {sentences.STARTER} AND st.n_first >= {sentences.LEAST} AND ab.word IS NULL AS is_starter FROM st LEFT JOIN (SELECT word FROM ab WHERE score >= {sentences.ABBREVIATION}) ab ON ab.word = st.word)"""


@query(f"WITH {ABBREVIATIONS} SELECT *, score >= {sentences.ABBREVIATION} AS is_abbreviation FROM ab")
def abbreviations(spark, d):
    return sentences.abbreviations(sentences.occurrences(paragraphs(spark, d)))


@query(f"WITH {STARTERS} SELECT * FROM sx")
def sentence_starters(spark, d):
    return sentences.learnt(paragraphs(spark, d))[1]


@query(rf"""WITH {STARTERS}, sd AS (SELECT *, lower(regexp_extract(w, {_WORD}, 1)) AS word, lower(regexp_extract(coalesce(nx, ''), {_WORD}, 1)) AS nw FROM si),
se AS (SELECT doc_id, paragraph_index, i FROM sd LEFT JOIN (SELECT word AS aw FROM ab WHERE score >= {sentences.ABBREVIATION}) ON aw = word LEFT JOIN (SELECT word AS sw FROM sx WHERE is_starter) s ON s.sw = nw
  WHERE z OR regexp_matches(w, '[!?][^\p{{L}}\p{{N}}\s]*$') OR (regexp_matches(w, '\.[^\p{{L}}\p{{N}}\s!?]*$') AND NOT regexp_matches(nx, '^[^\p{{L}}\p{{N}}]*\p{{Ll}}') AND NOT (regexp_full_match(word, '\p{{L}}') OR (aw IS NOT NULL AND s.sw IS NULL)))),
sl AS (SELECT doc_id, paragraph_index, list_transform(range(1, len(e) + 1), lambda k: e[k] - coalesce(CASE WHEN k > 1 THEN e[k - 1] END, 0)) AS ls FROM (SELECT doc_id, paragraph_index, list(i ORDER BY i) AS e FROM se GROUP BY ALL))
SELECT doc_id, paragraph_index::INT AS paragraph_index, len(ls)::INT AS num_sentences, array_to_string(ls, ',') AS lengths, {R("list_sum(ls)::DOUBLE / greatest(len(ls), 1)", 4)} AS avg_sentence_length,
  {R("sqrt(len(ls) * list_sum(list_transform(ls, lambda x: x * x)) - list_sum(ls) * list_sum(ls)) / len(ls) / greatest(list_sum(ls)::DOUBLE / len(ls), 1.0)", 4)} AS burstiness_score FROM sl""")
def sentence_boundaries(spark, d):
    """Sentences by the corpus's own abbreviations, and the features that read their lengths."""
    whole = paragraphs(spark, d)
    rows = sentences.ends(whole, *sentences.learnt(whole)).withColumn("_l", sentences.lengths())
    return rows.select("doc_id", "paragraph_index", F.size("_l").alias("num_sentences"), F.array_join(F.transform("_l", lambda x: x.cast("string")), ",").alias("lengths"), N.round_even(N.mean("_l"), 4).alias("avg_sentence_length"), N.round_even(N.burstiness("_l"), 4).alias("burstiness_score"))


# --- lemmas

_MARKERS = sorted({m for ms in lemmas.MARKERS.values() for m in ms})
LEMMAS = rf"""lw AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM p), lv AS (SELECT word, count(*) AS n FROM lw GROUP BY word),
lf AS (SELECT word, marker, left(word, s) AS stem, substr(word, s + 1) AS taken FROM (SELECT word, marker, (length(word) - length(marker) - k)::BIGINT AS s FROM lv, (SELECT unnest({_MARKERS}) AS marker), (SELECT unnest(range({lemmas.TAKEN + 1})) AS k) WHERE suffix(word, marker)) WHERE s >= {lemmas.STEM}),
lb AS (SELECT left(word, s) AS stem, substr(word, s + 1) AS put FROM (SELECT word, (length(word) - k)::BIGINT AS s FROM lv, (SELECT unnest(range({lemmas.PUT + 1})) AS k) WHERE k = 0 OR NOT ({' OR '.join(f"suffix(word, '{m}')" for m in _MARKERS)})) WHERE s >= {lemmas.STEM}),
lr AS (SELECT marker, taken, put, count(DISTINCT stem) AS stems FROM lf JOIN lb USING (stem) WHERE taken <> put AND (put = '' OR length(taken) = length(marker) OR left(taken, 1) <> left(put, 1)) GROUP BY ALL HAVING count(DISTINCT stem) >= {lemmas.LEAST}),
lk(tag, marker) AS (VALUES {", ".join(f"('{t}', '{m}')" for t, ms in lemmas.MARKERS.items() for m in ms)}),
li(word, tag, lemma) AS (VALUES {", ".join(f"('{w}', '{t}', '{m}')" for t, text in lemmas.IRREGULAR.items() for w, m in zip(text.split()[::2], text.split()[1::2], strict=True))}),
ll AS (SELECT f.word, lk.tag, f.stem || r.put AS lemma FROM lf f JOIN lr r USING (marker, taken) JOIN lk USING (marker) LEFT JOIN lv b ON b.word = f.stem || r.put
  QUALIFY row_number() OVER (PARTITION BY f.word, lk.tag ORDER BY b.word IS NULL, r.stems DESC, length(f.taken) DESC, f.stem || r.put) = 1),
lt AS (SELECT * FROM ll ANTI JOIN li USING (word, tag) UNION ALL SELECT * FROM li SEMI JOIN lv USING (word))"""


def _table(rows):
    known = lemmas.vocabulary(rows.select(F.explode(T.alpha_words("text")).alias("word")))
    return lemmas.lemma_table(known, lemmas.rules(known))


@query(f"WITH {P}, {LEMMAS} SELECT * FROM lr")
def lemma_rules(spark, d):
    return lemmas.rules(lemmas.vocabulary(paragraphs(spark, d).select(F.explode(T.alpha_words("text")).alias("word"))))


@query(f"WITH {P}, {LEMMAS} SELECT * FROM lt")
def lemma_table(spark, d):
    return _table(paragraphs(spark, d))


@query(rf"""WITH RECURSIVE {TAGGED}, {LEMMAS}, w AS (SELECT doc_id, paragraph_index, lower(tk[i]) AS word, CASE path[i] WHEN 'N' THEN 'NOUN' ELSE 'ADJ' END AS tag FROM (SELECT *, unnest(range(1, len(tk) + 1)) AS i FROM tg) WHERE path[i] IN ('N', 'J')),
k AS (SELECT DISTINCT doc_id, paragraph_index, coalesce(lt.lemma, w.word) AS l FROM w LEFT JOIN lt USING (word, tag) WHERE regexp_full_match(w.word, '\p{{L}}+') AND w.word NOT IN ({", ".join(map(_quoted, FUNCTION_WORDS))})),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY length(l) DESC, l) AS r FROM k QUALIFY r <= 3),
q AS (SELECT doc_id, paragraph_index, string_agg(l, ' AND ' ORDER BY r) AS query FROM r GROUP BY ALL)
SELECT doc_id, paragraph_index::INT AS paragraph_index, query FROM q JOIN (SELECT doc_id, paragraph_index FROM p WHERE len({WORDS.format("text")}) >= 10) USING (doc_id, paragraph_index)""")
def lemma_keywords(spark, d):
    """The search query of every paragraph: its longest lemmas of nouns and adjectives."""
    rows = paragraphs(spark, d)
    return features.lemma_queries(rows, _table(rows))


# --- clauses


@query()
def clause_triplets(spark, d):
    """Subject, verb and object of every paragraph by lemmas, and how many it shares with the next paragraph."""
    rows = paragraphs(spark, d)
    found = clauses.named(clauses.spoken(rows), _table(rows)).withColumn("_next", F.lead("triplets").over(clustering.by_doc()))
    return found.select("doc_id", "paragraph_index", F.array_join("triplets", ",").alias("triplets"), F.when(F.col("_next").isNotNull(), sources.overlap("triplets", "_next")).alias("overlap"))


@query()
def clause_passives(spark, d):
    """What a dependency reading counts for passives in every paragraph."""
    return clauses.passive_counts(paragraphs(spark, d))


# --- vectors


@query(rf"""WITH {P}, w AS (SELECT doc_id, paragraph_index, len(w) AS size, unnest(w) AS term FROM (SELECT doc_id, paragraph_index, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM p)),
c AS (SELECT doc_id, paragraph_index, term, count(*) AS n, max(size) AS size FROM w GROUP BY ALL),
t AS (SELECT term, sum(n)::DOUBLE / (SELECT sum(n) FROM c) AS share FROM c GROUP BY term HAVING count(*) >= {vectors.LEAST}),
e AS (SELECT doc_id, paragraph_index, ln((n::DOUBLE / size) / share) AS e FROM c JOIN t USING (term))
SELECT doc_id, paragraph_index::INT AS paragraph_index, count(*) AS n_terms, round(sum(e), 6) AS weight, round(max(e), 6) AS largest FROM e WHERE e > 0 GROUP BY doc_id, paragraph_index""")
def pmi_entries(spark, d):
    """The positive entries of every paragraph's row of the matrix from which vectors are learnt: their number, sum and greatest."""
    key = ("doc_id", "paragraph_index")
    apart = documents(spark, d).groupBy("doc_id").count().filter("count > 1").isEmpty()
    _, entries = vectors.entries_of(vectors.counts(paragraphs(spark, d), key, apart=apart), key)
    return entries.groupBy(*key).agg(F.count("*").alias("n_terms"), F.round(F.sum("entry"), 6).alias("weight"), F.round(F.max("entry"), 6).alias("largest"))


QUERIES = [n for n in ("pos_tags", "tagged_pos_ratios", "tagged_summary", "abbreviations", "sentence_starters", "sentence_boundaries", "lemma_rules", "lemma_table", "lemma_keywords", "clause_triplets", "clause_passives")]
SQL = {n: ORACLE[n] for n in QUERIES if n in ORACLE}
