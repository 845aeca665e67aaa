"""Registered queries of the forensics operators over the driver's tables, with their DuckDB equivalents.

Where the tables lack an input (labels, citations, evidence), it is derived from their keys by plain arithmetic, the
same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AUXILIARIES, CONJUNCTIONS, DEFAULT, DETERMINERS, FEATURES, FUNCTION_WORDS, NOT_AUTHORS, PREPOSITIONS, PRONOUNS
from ..functions import numeric as N
from ..functions import text as T
from ..operators import citations, clustering, evaluate, features, ingest, kernel, report, sources, warnings
from ..sources import documents as uploads
from ..sources import providers
from .analyze import Inputs, analyze

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def paragraphs(spark, d) -> DataFrame:
    return ingest.paragraphs(ingest.spread(documents(spark, d)))


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# White space of DuckDB's patterns is ASCII; this is Unicode's, with the separators that Python counts.
S = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class _Pattern(str):
    """SQL with one place for an expression; the braces of its patterns stay."""

    def format(self, expression: str) -> str:
        return self.replace("{}", expression)


STRIP = _Pattern(rf"regexp_replace({{}}, '^{S}+|{S}+$', '', 'g')")


def R(expression: str, digits: int) -> str:
    """Rounding of the binary value, exact halves to even: the remainder of 2 * 10**digits * x tells the side of a half."""
    k = 10**digits
    rest = f"((v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v)) * {2 * k}.0::DOUBLE - v * {2 * k}.0::DOUBLE + (v - (v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v))) * {2 * k}.0::DOUBLE)"
    near = f"floor((v * {2 * k}.0::DOUBLE + 1) / 2)"
    return f"list_transform([({expression})::DOUBLE], lambda v: (CASE WHEN v * {2 * k}.0::DOUBLE = 2 * {near} - 1 AND ({rest} < 0 OR {rest} = 0 AND {near} % 2 <> 0) THEN {near} - 1 ELSE {near} END) / {k}.0::DOUBLE)[1]"


P = f"""p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS paragraph_index, text FROM (
  SELECT doc_id, i, {STRIP.format("l[i]")} AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE length(text) >= 80)"""
WORDS = _Pattern(rf"list_filter(regexp_split_to_array({{}}, '{S}+'), lambda w: w <> '')")
ALPHA = r"regexp_extract_all(lower({}), '\p{{L}}+')"
SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
F1 = f"""{P}, a AS (SELECT doc_id, paragraph_index, text, {ALPHA.format("text")} AS w, list_transform({SENTENCES}, lambda s: len({WORDS.format("s")})) AS ls FROM p)"""

# --- ingest


@query(f"WITH {P} SELECT * FROM p")
def paragraph_scan(spark, d):
    return paragraphs(spark, d)


@query(rf"""SELECT doc_id, {STRIP.format(rf"regexp_replace(regexp_replace(regexp_replace(text, '-[ \t]*\n[ \t]*', '', 'g'), '-{S}+', '', 'g'), '{S}+', ' ', 'g')")} AS text FROM documents""")
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", T.clean("text").alias("text"))


CHUNKS = f"""ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS paragraph_index, text FROM (
  SELECT doc_id, i, {STRIP.format("substr(t, i + 1, 1000)")} AS text FROM (SELECT doc_id, t, unnest(range(0, length(t), 1000)) AS i FROM (SELECT doc_id, {STRIP.format("text")} AS t FROM documents))) WHERE length(text) >= 80)"""


@query(f"WITH {CHUNKS} SELECT * FROM ch")
def fixed_chunk_fallback(spark, d):
    return ingest.chunks(documents(spark, d))


@query(f"""WITH {P}, n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), c AS (SELECT doc_id, {STRIP.format("text")} AS t FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN 'lines' WHEN length(t) >= 80 THEN 'pages' WHEN length(t) > 0 THEN 'raw_chunk' ELSE 'none' END AS extraction_method, coalesce(n, 0) = 0 AS degraded_mode, CASE WHEN n > 0 THEN n WHEN length(t) >= 80 THEN 1 ELSE 0 END AS n_parts FROM c LEFT JOIN n USING (doc_id)""")
def fallback_chain_method(spark, d):
    return ingest.extraction(documents(spark, d)).select("doc_id", "extraction_method", "degraded_mode", F.size("parts").cast("long").alias("n_parts"))


def _reference_lines(spark, d) -> DataFrame:
    """Lines of documents, every third the start of a numbered entry."""
    prefix = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("["), (F.col("line_no") + 1).cast("string"), F.lit("] "))).otherwise("")
    return ingest.lines(documents(spark, d)).withColumn("line", F.concat(prefix, F.col("line")))


REF_LINES = "rl AS (SELECT doc_id, i - 1 AS line_no, (CASE WHEN (i - 1) % 3 = 0 THEN '[' || i || '] ' ELSE '' END) || l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
REFS = rf"""{REF_LINES}, rs AS (SELECT *, CASE WHEN regexp_matches(line, '^(\[\d+\]|[•–—-]|\d+\.)\s') OR row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1 THEN 1 ELSE 0 END AS st FROM rl),
rn AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ref_index FROM rs),
refs AS (SELECT doc_id, ref_index::INT AS ref_index, string_agg({STRIP.format("line")}, ' ' ORDER BY line_no) AS ref_text FROM rn GROUP BY doc_id, ref_index)"""


@query(f"WITH {REFS} SELECT * FROM refs")
def reference_merge(spark, d):
    return ingest.merge_references(_reference_lines(spark, d))


@query(rf"""WITH l AS (SELECT doc_id, i - 1 AS line_no, CASE WHEN i = 2 THEN ' References ' ELSE l[i] END AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
h AS (SELECT *, regexp_matches(line, '(?i)^\s*(references|bibliography|works cited|cited works|literature cited)\s*$') AS h FROM l),
s AS (SELECT *, coalesce(max(h::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM h)
SELECT doc_id, line_no, line FROM s WHERE seen = 1 AND NOT h AND length({STRIP.format("line")}) > 10""")
def bibliography_section(spark, d):
    marked = ingest.lines(documents(spark, d)).withColumn("line", F.when(F.col("line_no") == 1, " References ").otherwise(F.col("line")))
    return ingest.bibliography(marked)


@query(f"""WITH {P}, m AS (SELECT DISTINCT doc_id, lower({STRIP.format("substr(text, 1, 60)")}) AS mark FROM p WHERE paragraph_index % 4 = 0),
k AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND m.mark <> '' AND contains(lower(p.text), m.mark)))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1 AS paragraph_index, text FROM k""")
def reference_antijoin(spark, d):
    rows = paragraphs(spark, d)
    return ingest.drop_references(rows, rows.filter("paragraph_index % 4 = 0").withColumnRenamed("text", "ref_text"))


# --- features

MEASURES = rf"""m AS (SELECT doc_id, paragraph_index, len(w) AS n_alpha, greatest(len(ls), 1) AS n_s, list_sum(ls)::DOUBLE / greatest(len(ls), 1) AS asl,
  sqrt(greatest(len(ls), 1) * list_sum(list_transform(ls, lambda x: x * x)) - list_sum(ls) * list_sum(ls)) / greatest(len(ls), 1) / greatest(list_sum(ls)::DOUBLE / greatest(len(ls), 1), 1.0) AS burst,
  length(array_to_string(w, ''))::DOUBLE / greatest(len(w), 1) AS awl, len(regexp_extract_all(text, '\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]')) AS tok,
  len(list_filter(w, lambda x: x IN {_in(PRONOUNS)})) AS pr, len(list_filter(w, lambda x: x IN {_in(PREPOSITIONS)})) AS pp, len(list_filter(w, lambda x: x IN {_in(CONJUNCTIONS)})) AS cj,
  2 * len(regexp_extract_all(lower(text), '(?:^|[^\p{{L}}])(?:am|is|are|was|were|be|been|being|get|gets|got|gotten|getting)\s+(?:\p{{L}}+\s+)?\p{{L}}+(?:ed|en)(?:[^\p{{L}}]|$)')) * 100.0::DOUBLE / greatest(len(ls), 1) AS pv, len(list_distinct(w)) AS uniq FROM a),
f AS (SELECT doc_id, paragraph_index, unnest(w) AS x FROM a), fc AS (SELECT doc_id, paragraph_index, x, count(*) AS c FROM f GROUP BY ALL),
y AS (SELECT doc_id, paragraph_index, CASE WHEN sum(c) < 2 THEN 0.0::DOUBLE ELSE 10000.0::DOUBLE * (sum(c * c) - sum(c)) / (sum(c) * sum(c)) END AS k FROM fc GROUP BY ALL)"""


@query(f"WITH {F1}, {MEASURES} SELECT doc_id, paragraph_index, n_s::INT AS num_sentences, {R('asl', 4)} AS avg_sentence_length FROM m")
def sentence_lengths(spark, d):
    rows = features.annotate(paragraphs(spark, d))
    return rows.select("doc_id", "paragraph_index", F.greatest(F.size("_lengths"), F.lit(1)).alias("num_sentences"), N.round_even(N.mean("_lengths"), 4).alias("avg_sentence_length"))


@query(f"WITH {F1}, {MEASURES} SELECT doc_id, paragraph_index, {R('burst', 4)} AS burstiness_score FROM m")
def burstiness(spark, d):
    return features.annotate(paragraphs(spark, d)).select("doc_id", "paragraph_index", N.round_even(N.burstiness("_lengths"), 4).alias("burstiness_score"))


@query(f"WITH {F1}, {MEASURES} SELECT doc_id, paragraph_index, {R('awl', 4)} AS avg_word_length FROM m")
def avg_word_length(spark, d):
    rows = features.annotate(paragraphs(spark, d))
    return rows.select("doc_id", "paragraph_index", N.round_even(F.length(F.array_join("_words", "")) / F.greatest(F.size("_words"), F.lit(1)), 4).alias("avg_word_length"))


@query(f"WITH {F1}, {MEASURES} SELECT m.doc_id, m.paragraph_index, {R('coalesce(k, 0)', 4)} AS yules_k FROM m LEFT JOIN y USING (doc_id, paragraph_index)")
def yules_k(spark, d):
    return features.annotate(paragraphs(spark, d)).select("doc_id", "paragraph_index", N.round_even(N.yules_k("_words"), 4).alias("yules_k"))


@query(f"WITH {F1}, {MEASURES} SELECT doc_id, paragraph_index, {R('pr::DOUBLE / greatest(tok, 1)', 4)} AS pronoun_ratio, {R('pp::DOUBLE / greatest(tok, 1)', 4)} AS preposition_ratio, {R('cj::DOUBLE / greatest(tok, 1)', 4)} AS conjunction_ratio FROM m")
def pos_ratios(spark, d):
    rows = features.annotate(paragraphs(spark, d))
    return rows.select("doc_id", "paragraph_index", *(N.round_even(c, 4).alias(n) for n, c in T.pos_ratios("_words", F.col("_tokens")).items()))


@query(f"WITH {F1}, {MEASURES} SELECT doc_id, paragraph_index, {R('pv', 4)} AS passive_voice_pct FROM m")
def passive_voice(spark, d):
    rows = features.annotate(paragraphs(spark, d))
    return rows.select("doc_id", "paragraph_index", N.round_even(2 * F.regexp_count(F.lower("text"), F.lit(T.PASSIVE)) * 100.0 / F.greatest(F.size("_lengths"), F.lit(1)), 4).alias("passive_voice_pct"))


V = "CASE WHEN n_alpha >= 10 THEN {} ELSE 0.0::DOUBLE END"
PROFILE = f"""pf AS (SELECT m.doc_id, m.paragraph_index, n_alpha >= 10 AS is_valid, CASE WHEN n_alpha >= 10 THEN n_s ELSE 1 END::INT AS num_sentences, {V.format("asl")} AS avg_sentence_length, {V.format("awl")} AS avg_word_length,
  {V.format("pr::DOUBLE / greatest(tok, 1)")} AS pronoun_ratio, {V.format("pp::DOUBLE / greatest(tok, 1)")} AS preposition_ratio, {V.format("cj::DOUBLE / greatest(tok, 1)")} AS conjunction_ratio, {V.format("pv")} AS passive_voice_pct, {V.format("coalesce(k, 0)")} AS yules_k, {V.format("burst")} AS burstiness_score FROM m LEFT JOIN y USING (doc_id, paragraph_index))"""
_ROUNDED = ", ".join(f"{R(c, 4)} AS {c}" for c in ("avg_sentence_length", "avg_word_length", "pronoun_ratio", "preposition_ratio", "conjunction_ratio", "passive_voice_pct", "yules_k", "burstiness_score"))


_TAG = f"CASE WHEN x IN {_in(PRONOUNS)} THEN 'PRON' WHEN x IN {_in(PREPOSITIONS)} THEN 'ADP' WHEN x IN {_in(CONJUNCTIONS)} THEN 'CCONJ' WHEN x IN {_in(DETERMINERS)} THEN 'DET' WHEN x IN {_in(AUXILIARIES)} THEN 'AUX' WHEN regexp_matches(x, 'ly$') THEN 'ADV' WHEN regexp_matches(x, '(ous|ful|ive|able|ible|ic|less)$') THEN 'ADJ' WHEN regexp_matches(x, '(ize|ise|ify|ing|ed)$') THEN 'VERB' ELSE 'NOUN' END"
_COUNTS = ", ".join(f"count(*) FILTER (tg IN {_in(names)})::INT AS {n}" for n, names in features.TAGS.items())


@query(f"""WITH {F1}, {MEASURES}, {PROFILE}, u AS (SELECT doc_id, paragraph_index, x, i FROM (SELECT doc_id, paragraph_index, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM a)),
tg AS (SELECT doc_id, paragraph_index, {_COUNTS} FROM (SELECT doc_id, paragraph_index, {_TAG} AS tg FROM u) GROUP BY ALL),
fw AS (SELECT doc_id, paragraph_index, x, count(*) AS n, min(i) AS pos FROM u WHERE x IN {_in(FUNCTION_WORDS)} GROUP BY doc_id, paragraph_index, x QUALIFY row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY n DESC, pos) <= 5),
fj AS (SELECT doc_id, paragraph_index, string_agg(x || ':' || n, ',' ORDER BY n DESC, pos) AS top_function_words FROM fw GROUP BY ALL)
SELECT m.doc_id, m.paragraph_index, n_alpha::INT AS word_count, n_s_raw::INT AS sentence_count, uniq::INT AS unique_words, {", ".join(f"coalesce({n}, 0)::INT AS {n}" for n in features.TAGS)}, coalesce(top_function_words, '') AS top_function_words, {_ROUNDED}
FROM (SELECT *, n_s AS n_s_raw FROM m) m JOIN pf USING (doc_id, paragraph_index) LEFT JOIN tg USING (doc_id, paragraph_index) LEFT JOIN fj USING (doc_id, paragraph_index)""")
def paragraph_summary(spark, d):
    rows = features.summary(paragraphs(spark, d))
    return rows.select(*(c for c in rows.columns if c not in ("features", "top_function_words")), F.array_join("top_function_words", ",").alias("top_function_words"), *(F.get("features", i).alias(f) for i, f in enumerate(FEATURES)))


@query(f"WITH {F1}, {MEASURES}, {PROFILE} SELECT doc_id, paragraph_index, is_valid, num_sentences, {_ROUNDED} FROM pf")
def feature_profiles(spark, d):
    return features.profiles(paragraphs(spark, d))


@query(f"WITH {F1}, {MEASURES}, {PROFILE} SELECT doc_id, paragraph_index, {R('yules_k', 4)} AS x, {R('avg_sentence_length', 4)} AS y, {R('pronoun_ratio', 4)} AS pronoun, {R('preposition_ratio', 4)} AS preposition, {R('conjunction_ratio', 4)} AS conjunction FROM pf WHERE is_valid")
def chart_series(spark, d):
    rows = features.profiles(paragraphs(spark, d)).filter("is_valid")
    return rows.select("doc_id", "paragraph_index", F.col("yules_k").alias("x"), F.col("avg_sentence_length").alias("y"), F.col("pronoun_ratio").alias("pronoun"), F.col("preposition_ratio").alias("preposition"), F.col("conjunction_ratio").alias("conjunction"))


@query(f"""WITH {F1}, u AS (SELECT doc_id, paragraph_index, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT doc_id, paragraph_index, list_filter(w, lambda x: x IN {_in(FUNCTION_WORDS)}) AS u FROM a)),
c AS (SELECT doc_id, paragraph_index, u[i] AS word, count(*) AS n, min(i) AS pos FROM u GROUP BY ALL)
SELECT doc_id, paragraph_index, row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY n DESC, pos) AS rank, word, n FROM c QUALIFY rank <= 5""")
def top_function_words(spark, d):
    return features.top_function_words(paragraphs(spark, d))


@query(f"""WITH {F1}, u AS (SELECT DISTINCT doc_id, paragraph_index, unnest(list_filter(w, lambda x: NOT x IN {_in(FUNCTION_WORDS)} AND length(x) > 2)) AS x FROM a WHERE len({WORDS.format("text")}) >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY length(x) DESC, x) AS r FROM u QUALIFY r <= 3)
SELECT doc_id, paragraph_index, string_agg(x, ' AND ' ORDER BY r) AS query FROM r GROUP BY ALL""")
def keyword_topk(spark, d):
    return features.keywords(paragraphs(spark, d))


@query(f"""WITH {F1}, c AS (SELECT doc_id, paragraph_index, list_filter(w, lambda x: NOT x IN {_in(FUNCTION_WORDS)}) AS c FROM a),
t AS (SELECT doc_id, paragraph_index, list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || '_' || c[i + 1] || '_' || c[i + 2])) AS t FROM c),
l AS (SELECT doc_id, paragraph_index, t, lead(t) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS n FROM t)
SELECT doc_id, paragraph_index, len(list_intersect(t, n)) AS overlap FROM l WHERE n IS NOT NULL""")
def triplet_overlap(spark, d):
    rows = features.triplets(paragraphs(spark, d)).withColumn("_next", F.lead("triplets").over(clustering.by_doc()))
    return rows.filter("_next IS NOT NULL").select("doc_id", "paragraph_index", sources.overlap("triplets", "_next").alias("overlap"))


# --- clustering results


def _labelled(spark, d) -> DataFrame:
    """Paragraphs with labels and probabilities from their keys."""
    return paragraphs(spark, d).withColumns({"cluster_id": ((F.col("doc_id") * 7 + F.col("paragraph_index")) % 5 - 1).cast("int"), "probability": F.lit(0.5) + (F.col("paragraph_index") % 5) / 10})


L = f"{P}, lb AS (SELECT *, ((doc_id * 7 + paragraph_index) % 5 - 1)::INT AS cluster_id, 0.5::DOUBLE + (paragraph_index % 5)::DOUBLE / 10 AS probability FROM p)"


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label"), F.col("vec_id").alias("item"), "embedding")


@query("""WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings), s AS (SELECT label, i, var_pop(v) AS s FROM v GROUP BY ALL)
SELECT label, count(*) FILTER (s >= 1e-10) AS n_variable, count(*) AS n_dimensions FROM s GROUP BY label""")
def column_variance_mask(spark, d):
    return clustering.variance_mask(_vectors(spark, d), "embedding", "label")


@query("""WITH v AS (SELECT label, vec_id AS item, unnest(range(len(embedding)))::INT AS dimension, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, item, dimension, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w), 4) + 0.0 AS z FROM v WINDOW w AS (PARTITION BY label, dimension)""")
def standard_scale(spark, d):
    return clustering.scaled(_vectors(spark, d), "embedding", "label").withColumn("z", F.round("z", 4) + 0.0)


@query("""WITH c AS (SELECT conv_id AS doc_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END AS c FROM conversations),
l AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY turn) AS f, lag(turn) OVER (PARTITION BY doc_id ORDER BY turn) AS a FROM c)
SELECT doc_id, a AS after_paragraph, f AS from_cluster, c AS to_cluster, f = -1 OR c = -1 AS is_anomaly_transition FROM l WHERE f IS NOT NULL AND f <> c""")
def cluster_boundaries(spark, d):
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(-1)
    return clustering.boundaries(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("paragraph_index"), role.alias("cluster_id")))


@query(f"""WITH {L}, n AS (SELECT *, lead(cluster_id) OVER o AS nx, lead(text) OVER o AS text_after FROM lb WINDOW o AS (PARTITION BY doc_id ORDER BY paragraph_index)),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS r FROM n WHERE nx IS NOT NULL AND nx <> cluster_id AND (nx = -1 OR cluster_id = -1))
SELECT doc_id, paragraph_index AS after_paragraph, text AS text_before, text_after FROM h WHERE r <= 3""")
def boundary_pairs(spark, d):
    return clustering.boundary_pairs(_labelled(spark, d))


@query(f"WITH {L}, c AS (SELECT doc_id, cluster_id::VARCHAR AS k, count(*) AS n FROM lb GROUP BY ALL) SELECT doc_id, string_agg(k || ':' || n, ',' ORDER BY k) AS cluster_sizes FROM c GROUP BY doc_id")
def cluster_sizes(spark, d):
    made = clustering.sizes(_labelled(spark, d))
    return made.select("doc_id", F.array_join(F.transform(F.map_entries("cluster_sizes"), lambda e: F.concat_ws(":", e.getField("key"), e.getField("value").cast("string"))), ",").alias("cluster_sizes"))


SUMMARY = f"""{L}, sm AS (SELECT doc_id, count(*) AS paragraph_count, count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS estimated_authors, count(*) FILTER (cluster_id = -1) AS anomaly_count, avg((cluster_id = -1)::INT::DOUBLE) AS noise, coalesce(avg(probability) FILTER (cluster_id <> -1), 0.5) AS sure FROM lb GROUP BY doc_id)"""


@query(f"WITH {SUMMARY} SELECT doc_id, estimated_authors, anomaly_count FROM sm")
def estimated_authors(spark, d):
    return clustering.summary(_labelled(spark, d)).select("doc_id", "estimated_authors", "anomaly_count")


@query(f"WITH {SUMMARY} SELECT doc_id, {R('noise', 4)} AS noise_percentage, noise > 0.9 AS noise_override FROM sm")
def noise_ratio(spark, d):
    return clustering.summary(_labelled(spark, d)).select("doc_id", "noise_percentage", "noise_override")


@query(f"WITH {SUMMARY} SELECT doc_id, {R('greatest(0.1::DOUBLE, least(1.0::DOUBLE, sure * greatest(0.0::DOUBLE, 1 - 2 * noise) * CASE WHEN estimated_authors BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END))', 4)} AS confidence FROM sm")
def cluster_confidence(spark, d):
    return clustering.summary(_labelled(spark, d)).select("doc_id", "confidence")


@query(f"WITH {L} SELECT doc_id, paragraph_index, coalesce(q.cluster_id, 0) AS cluster_id, coalesce(q.cluster_id, 0) = -1 AS is_anomaly, CASE WHEN q.cluster_id = -1 THEN 'ANOMALY' ELSE 'Author ' || (coalesce(q.cluster_id, 0) + 1) END AS cluster_label FROM p LEFT JOIN (SELECT * FROM lb WHERE paragraph_index % 9 <> 8) q USING (doc_id, paragraph_index)")
def cluster_labels(spark, d):
    labelled = _labelled(spark, d)
    return clustering.enrich(paragraphs(spark, d), labelled.filter("paragraph_index % 9 <> 8").select("doc_id", "paragraph_index", "cluster_id")).select("doc_id", "paragraph_index", "cluster_id", "is_anomaly", "cluster_label")


@query(f"WITH {L} SELECT doc_id, paragraph_index FROM lb WHERE cluster_id = 2")
def cluster_filter(spark, d):
    return clustering.highlighted(_labelled(spark, d), 2).select("doc_id", "paragraph_index")


@query(f"""WITH {SUMMARY}, o AS (SELECT *, lag(cluster_id) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS f FROM lb),
g AS (SELECT doc_id, string_agg(cluster_id, ',' ORDER BY paragraph_index) AS clusters, coalesce(string_agg(CASE WHEN cluster_id = -1 THEN paragraph_index END, ',' ORDER BY paragraph_index), '') AS anomaly_indices,
  coalesce(string_agg(CASE WHEN f <> cluster_id THEN (paragraph_index - 1) || ':' || f || ':' || cluster_id || ':' || (f = -1 OR cluster_id = -1) END, ',' ORDER BY paragraph_index), '') AS boundaries, count(*) FILTER (f <> cluster_id)::INT AS boundary_count, count(*) < 4 AS too_short FROM o GROUP BY doc_id)
SELECT doc_id, clusters, estimated_authors, anomaly_indices, anomaly_count, boundaries, boundary_count, {R("noise", 4)} AS noise_percentage, noise > 0.9 AS noise_override, too_short FROM g JOIN sm USING (doc_id)""")
def clusters_response(spark, d):
    c = clustering.result(_labelled(spark, d).withColumn("outcome", F.lit("cluster"))).select("doc_id", "clustering.*").withColumn("noise_override", F.col("noise_percentage") > 0.9)
    text = lambda array: F.array_join(F.transform(array, lambda x: x.cast("string")), ",")
    borders = F.array_join(F.transform("boundaries", lambda b: F.concat_ws(":", *(b[f].cast("string") for f in ("after_paragraph", "from_cluster", "to_cluster", "is_anomaly_transition")))), ",")
    return c.select("doc_id", text("clusters").alias("clusters"), "estimated_authors", text("anomaly_indices").alias("anomaly_indices"), "anomaly_count", borders.alias("boundaries"), "boundary_count", "noise_percentage", "noise_override", "too_short")


@query(f"WITH {L}, u AS (SELECT DISTINCT doc_id, cluster_id FROM lb WHERE cluster_id <> -1) SELECT doc_id, cluster_id, round((dense_rank() OVER (PARTITION BY doc_id ORDER BY cluster_id) - 1) * 360.0::DOUBLE / count(*) OVER (PARTITION BY doc_id) + 220, 6) % 360 AS hue, round(cluster_id * 360.0::DOUBLE / count(*) OVER (PARTITION BY doc_id) % 360, 6) AS app_hue FROM u")
def cluster_colours(spark, d):
    return clustering.colours(_labelled(spark, d)).withColumns({"hue": F.round("hue", 6) % 360, "app_hue": F.round("app_hue", 6)})


@query(f"WITH {L} SELECT doc_id, count(DISTINCT cluster_id) AS cluster_count, count(*) FILTER (cluster_id = -1) AS anomaly_count FROM lb GROUP BY doc_id")
def legend_counters(spark, d):
    return _labelled(spark, d).groupBy("doc_id").agg(F.count_distinct("cluster_id").alias("cluster_count"), F.count_if(F.col("cluster_id") == -1).alias("anomaly_count"))


_VAR = " + ".join(f"(coalesce(var_pop({c}), 0) >= 1e-10)::INT" for c in ("avg_sentence_length", "avg_word_length", "pronoun_ratio", "preposition_ratio", "conjunction_ratio", "passive_voice_pct", "yules_k", "burstiness_score"))
GUARD = f"""{F1}, {MEASURES}, {PROFILE}, st AS (SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (is_valid) AS n_valid, {_VAR} AS n_varying FROM pf GROUP BY doc_id),
gd AS (SELECT *, CASE WHEN n_paragraphs < 5 OR n_valid < 2 THEN 'skipped' WHEN n_paragraphs < 4 THEN 'too_short' WHEN n_varying = 0 THEN 'zero_variance' WHEN n_varying < 2 THEN 'one_column' ELSE 'cluster' END AS outcome FROM st)"""


@query(f"WITH {GUARD} SELECT * FROM gd")
def guard_ladder(spark, d):
    return clustering.guards(features.measured(paragraphs(spark, d)))


# --- citations

_NAMES = ("Smith", "O''Brien", "Garcia-Lopez", "Muller", "Chen")


def _cited(spark, d) -> DataFrame:
    """Labelled paragraphs whose text carries citations made from their keys; every third has none."""
    names = F.array(*(F.lit(n.replace("''", "'")) for n in _NAMES))
    i, j = F.col("doc_id") + F.col("paragraph_index"), F.col("doc_id") * 3 + F.col("paragraph_index") + 1
    n1, n2 = F.element_at(names, (i % 5 + 1).cast("int")), F.element_at(names, (j % 5 + 1).cast("int"))
    y1, y2 = ((a + (F.col("doc_id") * b + F.col("paragraph_index") * c) % m).cast("string") for a, b, c, m in ((1950, 13, 7, 76), (1960, 5, 11, 60)))
    nbsp = "\u00a0"
    made = F.concat(F.col("text"), F.lit(" ("), n1, F.lit(" and "), n2, F.lit(", "), y1, F.lit("; "), n2, F.lit(" et al., "), y2, F.lit(") while "), n1, F.lit(" ("), y2, F.lit(") and "), n1, F.lit(" ("), y2, F.lit(") and However ("), y1, F.lit(") agree. Not so ( "), n1, F.lit(", "), y1, F.lit(" ) nor "), n2, F.lit(" ( "), y2, F.lit(" ), but ("), n2, F.lit(" , "), y1, F.lit(f") and {nbsp}"), n1, F.lit(f"{nbsp}and{nbsp}"), n2, F.lit(f"{nbsp}("), y2, F.lit(") are."))
    return _labelled(spark, d).withColumn("text", F.when(F.col("paragraph_index") % 3 == 0, F.col("text")).otherwise(made))


_LIST = "['" + "', '".join(_NAMES) + "']"
CITED = f"""{L}, k AS (SELECT *, {_LIST}[(doc_id + paragraph_index) % 5 + 1] AS n1, {_LIST}[(doc_id * 3 + paragraph_index + 1) % 5 + 1] AS n2, (1950 + (doc_id * 13 + paragraph_index * 7) % 76)::VARCHAR AS y1, (1960 + (doc_id * 5 + paragraph_index * 11) % 60)::VARCHAR AS y2 FROM lb),
ct AS (SELECT doc_id, paragraph_index, cluster_id, CASE WHEN paragraph_index % 3 = 0 THEN text ELSE text || ' (' || n1 || ' and ' || n2 || ', ' || y1 || '; ' || n2 || ' et al., ' || y2 || ') while ' || n1 || ' (' || y2 || ') and ' || n1 || ' (' || y2 || ') and However (' || y1 || ') agree. Not so ( ' || n1 || ', ' || y1 || ' ) nor ' || n2 || ' ( ' || y2 || ' ), but (' || n2 || ' , ' || y1 || ') and ' || chr(160) || n1 || chr(160) || 'and' || chr(160) || n2 || chr(160) || '(' || y2 || ') are.' END AS text FROM k)"""
_SUR = r"[A-Z][A-Za-z''’`-]+"
_AUTHOR = rf"{_SUR}(?:{S}+(?:and|&){S}+{_SUR})?(?:{S}+et{S}+al\.?)?"
_CITE = rf"{_AUTHOR}{S}*,{S}*(?:19|20)\d{{2}}"
_NARR = rf"{_AUTHOR}{S}*\((?:19|20)\d{{2}}\)"
_TRUE = _Pattern(f"list_filter({{}}, lambda c: NOT lower(regexp_extract(c, '[A-Za-z]+')) IN {_in(NOT_AUTHORS)})")
_PAR = _TRUE.format(rf"regexp_extract_all(text, '\({_CITE}(?:{S}*;{S}*{_CITE})*\)')")
_NAR = _TRUE.format(rf"regexp_extract_all(text, '(?:^|[^(\p{{L}}\p{{N}}_])({_NARR})', 1)")
YEARS = f"""{CITED}, c0 AS (SELECT *, {_PAR} AS pa, {_NAR} AS na FROM ct), c1 AS (SELECT doc_id, paragraph_index, cluster_id, text, list_concat(pa, list_filter(list_transform(range(1, len(na) + 1), lambda i: CASE WHEN list_position(na, na[i]) = i AND NOT list_contains(pa, na[i]) THEN na[i] END), lambda c: c IS NOT NULL)) AS cites FROM c0),
c2 AS (SELECT *, list_filter(list_transform(flatten(list_transform(cites, lambda c: regexp_extract_all(c, '(?:19|20)\\d{{2}}'))), lambda y: y::INT), lambda y: y BETWEEN 1900 AND 2030) AS years FROM c1)""".replace("\\\\d", "\\d")


@query(f"WITH {CITED} SELECT doc_id, paragraph_index, array_to_string({_PAR}, '|') AS found FROM ct")
def citations_parenthetical(spark, d):
    return _cited(spark, d).select("doc_id", "paragraph_index", F.array_join(T.true_citations(T.parenthetical("text")), "|").alias("found"))


@query(f"WITH {CITED} SELECT doc_id, paragraph_index, array_to_string({_NAR}, '|') AS found FROM ct")
def citations_narrative(spark, d):
    return _cited(spark, d).select("doc_id", "paragraph_index", F.array_join(T.true_citations(T.narrative("text")), "|").alias("found"))


@query(f"WITH {YEARS} SELECT doc_id, paragraph_index, array_to_string(cites, '|') AS found, len(cites)::INT AS citation_count FROM c2")
def citation_union(spark, d):
    rows = citations.extract(_cited(spark, d))
    return rows.select("doc_id", "paragraph_index", F.array_join("citations", "|").alias("found"), "citation_count")


@query(f"WITH {YEARS} SELECT doc_id, paragraph_index, array_to_string(years, ',') AS years, round_even(list_median(years), 0)::INT AS median_year FROM (SELECT *, list_aggregate(years, 'median') AS lm FROM c2)".replace("list_median(years)", "lm"))
def median_year(spark, d):
    rows = citations.extract(_cited(spark, d))
    return rows.select("doc_id", "paragraph_index", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), "median_year")


BASE = f"""{YEARS}, yu AS (SELECT doc_id, cluster_id, unnest(years) AS y FROM c2), bl AS (SELECT doc_id, round_even(median(y) FILTER (cluster_id <> -1), 0)::INT AS core_median, round_even(median(y) FILTER (cluster_id = -1), 0)::INT AS noise_median FROM yu GROUP BY doc_id)"""


@query(f"WITH {BASE} SELECT *, abs(noise_median - core_median) AS year_difference, coalesce(abs(noise_median - core_median) > 10, false) AS is_anomalous FROM bl")
def core_noise_baseline(spark, d):
    return citations.baselines(citations.extract(_cited(spark, d)))


@query(f"""WITH {BASE}, mm AS (SELECT c2.doc_id, paragraph_index, cluster_id, round_even(list_aggregate(years, 'median'), 0)::INT AS median_year, core_median FROM c2 JOIN bl ON c2.doc_id = bl.doc_id)
SELECT doc_id, paragraph_index, median_year, core_median AS baseline_year, abs(median_year - core_median) AS year_difference, cluster_id, cluster_id = -1 AS is_noise_cluster, CASE WHEN abs(median_year - core_median) > 20 THEN 'high' WHEN abs(median_year - core_median) > 10 THEN 'medium' ELSE 'low' END AS severity FROM mm WHERE abs(median_year - core_median) > 10""")
def temporal_anomalies(spark, d):
    return citations.temporal_anomalies(citations.extract(_cited(spark, d)))


@query(f"""WITH {BASE}, mm AS (SELECT c2.doc_id, paragraph_index, cluster_id, round_even(list_aggregate(years, 'median'), 0)::INT AS median_year, core_median FROM c2 JOIN bl ON c2.doc_id = bl.doc_id)
SELECT doc_id, paragraph_index, median_year, core_median AS baseline_year, abs(median_year - core_median) AS year_difference, cluster_id, CASE WHEN abs(median_year - core_median) > 20 THEN 'high' WHEN abs(median_year - core_median) > 10 THEN 'medium' ELSE 'low' END AS severity FROM mm WHERE abs(median_year - core_median) > 10""")
def anomaly_query(spark, d):
    return citations.anomaly_query(_cited(spark, d))


@query(f"""WITH {YEARS}, de AS (SELECT doc_id, cluster_id, len(cites)::DOUBLE / greatest(len({WORDS.format("text")}), 1) * 100 AS dn FROM c2),
dd AS (SELECT doc_id, coalesce({R("avg(dn) FILTER (cluster_id <> -1)", 4)}, 0) AS core_density, coalesce({R("avg(dn) FILTER (cluster_id = -1)", 4)}, 0) AS noise_density FROM de GROUP BY doc_id)
SELECT *, CASE WHEN core_density <> 0 THEN {R("noise_density / greatest(core_density, 0.001)", 2)} END AS density_ratio FROM dd""")
def citation_density(spark, d):
    return citations.densities(citations.extract(_cited(spark, d)))


@query(f"WITH {YEARS} SELECT doc_id, paragraph_index, {R('len(cites)::DOUBLE / greatest(len(' + WORDS.format('text') + '), 1) * 100', 4)} AS citation_density FROM c2 WHERE len(cites) > 0")
def citing_paragraphs(spark, d):
    rows = citations.with_citations(citations.extract(_cited(spark, d)))
    return rows.select("doc_id", "paragraph_index", N.round_even(citations.density(), 4).alias("citation_density"))


@query(f"WITH {YEARS} SELECT doc_id, sum(len(cites))::BIGINT AS total_citations, array_to_string(list_sort(list_distinct(flatten(list(years)))), ',') AS unique_years FROM c2 GROUP BY doc_id")
def citation_totals(spark, d):
    rows = citations.totals(citations.extract(_cited(spark, d)))
    return rows.select("doc_id", "total_citations", F.array_join(F.transform("unique_years", lambda y: y.cast("string")), ",").alias("unique_years"))


def _references(spark, d) -> DataFrame:
    """Orders as references of customers: the priority, the key and the year of each."""
    o = table(spark, d, "orders")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("doc_id"), nth.alias("ref_index"), F.concat(F.col("o_orderpriority"), F.lit(" no. "), F.col("o_orderkey").cast("string"), F.lit(", "), F.year("o_orderdate").cast("string")).alias("ref_text"))


REFERENCES = "rf AS (SELECT o_custkey AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ref_index, o_orderpriority || ' no. ' || o_orderkey || ', ' || year(o_orderdate) AS ref_text FROM orders)"


@query(rf"WITH {REFERENCES}, y AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(ref_text, '(?:19|20)\d{{2}}'), lambda y: y::INT), lambda y: y BETWEEN 1900 AND 2030)) AS y FROM rf), m AS (SELECT doc_id, round_even(median(y), 0)::INT AS bibliography_median FROM y GROUP BY doc_id) SELECT doc_id, total_references, bibliography_median FROM (SELECT doc_id, count(*) AS total_references FROM rf GROUP BY doc_id) LEFT JOIN m USING (doc_id)")
def bibliography_median(spark, d):
    return citations.bibliography(_references(spark, d))


@query(f"""WITH {REFERENCES}, rg AS (SELECT lower(substr(ref_text, 1, 150)) AS ref_key, ((doc_id + ref_index) % 80)::DOUBLE AS score FROM rf WHERE (doc_id + ref_index) % 2 = 0),
q AS (SELECT doc_id, ref_index, lower(substr(ref_text, 1, 150)) AS ref_key FROM rf WHERE ref_index < 5 AND length(ref_text) > 15)
SELECT doc_id, ref_index, coalesce(score, 0) AS score, coalesce(score > 35, true) AS is_valid FROM q LEFT JOIN rg USING (ref_key)""")
def reference_verification(spark, d):
    refs = _references(spark, d)
    registry = refs.filter("(doc_id + ref_index) % 2 = 0").select(F.lower(F.substring("ref_text", 1, 150)).alias("ref_key"), ((F.col("doc_id") + F.col("ref_index")) % 80).cast("double").alias("score"))
    return citations.verify(refs, registry)


@query(f"""WITH {REFERENCES}, rg AS (SELECT lower(substr(ref_text, 1, 150)) AS ref_key, ((doc_id + ref_index) % 80)::DOUBLE AS score FROM rf WHERE (doc_id + ref_index) % 2 = 0),
q AS (SELECT doc_id, lower(substr(ref_text, 1, 150)) AS ref_key FROM rf WHERE ref_index < 5 AND length(ref_text) > 15)
SELECT doc_id, count(*) AS n_verified, count(*) FILTER (NOT coalesce(score > 35, true)) AS hallucination_count FROM q LEFT JOIN rg USING (ref_key) GROUP BY doc_id""")
def hallucinations(spark, d):
    return citations.hallucinations(reference_verification(spark, d))


# --- sources

COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
ASKED = " WHERE a.vec_id % 50 = 0"
MATCHES = f"""mt AS (SELECT a.vec_id AS query_id, b.vec_id AS source_id, {COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id{ASKED}),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, source_id) AS rank FROM mt)"""


def _matches(spark, d, k: int, asked: str = "vec_id % 50 = 0") -> DataFrame:
    """Every vector whose id is divisible by 50, or all that are asked, against all others."""
    e = table(spark, d, "embeddings")
    return sources.nearest(e.filter(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("vector")), k)


@query(f"WITH {MATCHES.replace(ASKED, '')} SELECT query_id, source_id, round(similarity, 6) AS similarity, rank FROM rk WHERE rank <= 3")
def cosine_topk(spark, d):
    """The three most similar others of every vector."""
    return _matches(spark, d, 3, "vec_id IS NOT NULL").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {MATCHES} SELECT query_id, source_id, round(similarity, 6) AS similarity FROM rk WHERE rank = 1")
def source_argmax(spark, d):
    return _matches(spark, d, 1).select("query_id", "source_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {MATCHES}, b AS (SELECT query_id, source_id, least(1.0, similarity + 0.06::DOUBLE * (source_id % 3)) AS similarity, source_id % 7 = 0 AS is_exact FROM rk WHERE rank = 1) SELECT query_id, source_id, round(similarity, 6) AS similarity, is_exact FROM b WHERE similarity >= 0.5 OR is_exact")
def similarity_boost(spark, d):
    best = _matches(spark, d, 1).withColumns({"overlap": F.col("source_id") % 3, "is_exact": F.col("source_id") % 7 == 0})
    return sources.accept(best).select("query_id", "source_id", F.round("similarity", 6).alias("similarity"), "is_exact")


@query(f"WITH {P}, w AS (SELECT item_id AS source_id, 'before ' || text || ' after' AS body FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 50 = 0) SELECT p.doc_id, paragraph_index, source_id FROM p JOIN w ON contains(lower(body), lower(p.text))")
def exact_containment(spark, d):
    """Paragraphs that stand whole in a benchmark text or in a document whose id is divisible by 50."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("source_id"), F.concat(F.lit("before "), F.col("text"), F.lit(" after")).alias("body"))
    some = documents(spark, d).filter("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("source_id"), F.col("text").alias("body"))
    return sources.containing(paragraphs(spark, d), b.unionByName(some), shortest=DEFAULT.min_paragraph_chars)


@query(f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents) SELECT doc_id, array_to_string(w, ' ') AS text FROM w WHERE len(w) > 0")
def inverted_index_rebuild(spark, d):
    """The words of each text, through a map from word to positions and back."""
    index = sources.inverted_index(documents(spark, d).select("doc_id", T.words("text").alias("words")).filter("size(words) > 0"))
    return index.select("doc_id", N.inverted_index_text(F.col("_index"), F.lit("")).alias("text"))


@query(f"WITH {L}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, paragraph_index) AS rank FROM lb WHERE cluster_id = -1) SELECT doc_id, paragraph_index, rank FROM r WHERE rank <= 3 AND len({WORDS.format('text')}) >= 10")
def anomaly_topk(spark, d):
    return sources.longest_anomalies(_labelled(spark, d)).select("doc_id", "paragraph_index", "rank")


@query("SELECT item_id AS source_id, substr(text, 1, 300) || '...' AS abstract, 'benchmark' AS origin FROM benchmark UNION ALL SELECT page_id, substr(html, 1, 300) || '...', 'pages' FROM pages")
def candidate_union(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("source_id"), T.snippet("text").alias("abstract"), F.lit("benchmark").alias("origin"))
    return sources.union(a, table(spark, d, "pages").select(F.col("page_id").alias("source_id"), T.snippet("html").alias("abstract"), F.lit("pages").alias("origin")))


# --- report


def _evidence(spark, d) -> DataFrame:
    """Evidence from the keys of documents."""
    i = F.col("doc_id")
    return documents(spark, d).select(
        "doc_id",
        ((i % 11) / 10.0).alias("noise"),
        (i % 4 + 1).cast("int").alias("estimated_authors"),
        (i % 9).cast("int").alias("anomaly_count"),
        (i % 7).cast("int").alias("boundary_count"),
        F.transform(F.sequence(F.lit(0), (i % 5).cast("int")), lambda k: (i % 3 + 1) * 0.125 + k * 0.0625).alias("burstiness"),
        F.slice(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("medium")), 1, (i % 5).cast("int")).alias("severities"),
        F.slice(F.array(F.lit(0.95), F.lit(0.85), F.lit(0.76), F.lit(0.6)), 1, (i % 4).cast("int")).alias("similarities"),
        (i % 2 == 0).alias("reasoning_available"),
        (i % 8).cast("int").alias("explanation_count"),
    )


EVIDENCE = """ev AS (SELECT doc_id, (doc_id % 11)::DOUBLE / 10 AS noise, doc_id % 4 + 1 AS estimated_authors, doc_id % 9 AS anomaly_count, doc_id % 7 AS boundary_count,
  list_transform(range(0, doc_id % 5 + 1), lambda k: (doc_id % 3 + 1) * 0.125::DOUBLE + k * 0.0625::DOUBLE) AS burstiness, ['high', 'medium', 'low', 'medium'][1 : doc_id % 5] AS severities, [0.95, 0.85, 0.76, 0.6][1 : doc_id % 4] AS similarities, doc_id % 2 = 0 AS reasoning_available, doc_id % 8 AS explanation_count FROM documents),
pe AS (SELECT *, 8.0::DOUBLE * noise + 1.5::DOUBLE * greatest(estimated_authors - 1, 0) + CASE WHEN len(burstiness) >= 3 AND list_sum(burstiness) / greatest(len(burstiness), 1) < 0.3 THEN 6.0::DOUBLE ELSE 0 END + least(0.5::DOUBLE * anomaly_count, 3.0) + CASE WHEN boundary_count > 2 THEN least(0.3::DOUBLE * (boundary_count - 2), 1.5) ELSE 0 END
  + 1.5::DOUBLE * len(list_filter(severities, lambda s: s = 'high')) + 0.8::DOUBLE * len(list_filter(severities, lambda s: s = 'medium')) + 0.3::DOUBLE * len(severities)
  + coalesce(list_sum(list_transform(similarities, lambda s: CASE WHEN s >= 0.9 THEN 3.0::DOUBLE WHEN s >= 0.8 THEN 2.0 WHEN s >= 0.75 THEN 1.5 ELSE 0.0 END)), 0) + CASE WHEN reasoning_available THEN least(0.3::DOUBLE * explanation_count, 1.5) ELSE 0 END AS off FROM ev),
sc AS (SELECT *, greatest(0.0, least(10.0, round_even(10.0::DOUBLE - off, 1)))::DOUBLE AS integrity_score FROM pe),
vd AS (SELECT *, CASE WHEN integrity_score < 4.0 THEN 'Highly Plagiarized' WHEN integrity_score < 7.5 THEN 'Suspicious' ELSE 'Clean' END AS verdict FROM sc)"""


@query(f"WITH {EVIDENCE} SELECT doc_id, integrity_score, verdict FROM vd")
def integrity_score(spark, d):
    return report.score(_evidence(spark, d)).select("doc_id", "integrity_score", "verdict")


@query(f"""WITH {EVIDENCE} SELECT doc_id, CASE WHEN integrity_score < 4.5 THEN 'danger' WHEN integrity_score < 8 THEN 'warning' ELSE 'success' END AS band, round(377 - integrity_score / 10 * 377, 3) AS gauge_offset,
CASE WHEN estimated_authors > 1 OR anomaly_count > 5 THEN 'warning' ELSE 'success' END AS stylometric_badge, CASE WHEN len(similarities) > 0 THEN 'danger' ELSE 'success' END AS source_badge, CASE WHEN len(severities) > 0 THEN 'danger' ELSE 'success' END AS citation_badge FROM vd""")
def report_badges(spark, d):
    return report.bands(report.score(_evidence(spark, d))).select("doc_id", "band", F.round("gauge_offset", 3).alias("gauge_offset"), "stylometric_badge", "source_badge", "citation_badge")


@query(f"""WITH {F1}, {MEASURES}, {PROFILE}, b AS (SELECT doc_id, count(*) AS n, round(avg(burstiness_score), 6) AS a FROM pf WHERE num_sentences >= 2 GROUP BY doc_id)
SELECT doc_id, CASE WHEN n < 2 THEN 0 ELSE greatest(1, least(99, floor(100 - (a - 0.05::DOUBLE) * 200 + 0.5)))::INT END AS ai_probability FROM b""")
def ai_probability(spark, d):
    rows = features.measured(paragraphs(spark, d)).filter("num_sentences >= 2").groupBy("doc_id").agg(F.count("*").alias("_n"), F.round(F.avg("burstiness_score"), 6).alias("_a"))
    return rows.select("doc_id", N.ai_probability(F.col("_n"), F.col("_a")).alias("ai_probability"))


@query(f"""WITH {GUARD}, w AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_paragraphs < 5 THEN '04features_short_paper' END, CASE WHEN n_valid < 3 THEN '05features_too_few_valid' END, CASE WHEN outcome IN ('skipped', 'too_short') THEN '06cluster_skipped_short' END, CASE WHEN outcome = 'zero_variance' THEN '07cluster_zero_variance' END, CASE WHEN outcome = 'one_column' THEN '08cluster_zero_variance' END, CASE WHEN n_paragraphs = 0 THEN '03pdf_no_text' END], lambda x: x IS NOT NULL)) AS c FROM gd)
SELECT doc_id, count(*) AS warning_count, bool_or(c = '03pdf_no_text') AS partial_results, string_agg(substr(c, 3), ',' ORDER BY c) AS codes FROM w GROUP BY doc_id""")
def warnings_rollup(spark, d):
    state = clustering.guards(features.measured(paragraphs(spark, d)))
    return warnings.rollup(warnings.emit(state)).withColumn("codes", F.array_join("codes", ","))


@query("""SELECT event_type AS name, count(*) AS n, replace(replace(array_to_string(list_transform(string_split(event_type || '_pct', '_'), lambda w: upper(w[1]) || w[2:]), ' '), 'Pct', '%'), 'Avg', 'Avg.') AS title FROM events GROUP BY event_type""")
def feature_titles(spark, d):
    """Titles of the shares of each kind of event, as those of features are made."""
    kinds = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return kinds.withColumn("title", T.feature_title(F.concat("name", F.lit("_pct"))))


# --- comparison methods

TFIDF = rf"""{P}, kp AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS position, count(*) OVER (PARTITION BY doc_id) AS n FROM p WHERE len({WORDS.format("text")}) >= 10),
tk AS (SELECT doc_id, position, n, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT w IN {_in(FUNCTION_WORDS)})) AS term FROM kp),
tf AS (SELECT doc_id, position, n, term, count(*) AS tf FROM tk GROUP BY ALL), ts AS (SELECT doc_id, n, term, count(*) AS df, sum(tf) AS al FROM tf GROUP BY ALL),
tr AS (SELECT doc_id, term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM ts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY al DESC, term) <= 500),
tw AS (SELECT tf.doc_id, position, tf.term, tf * idf AS w FROM tf JOIN tr ON tf.doc_id = tr.doc_id AND tf.term = tr.term), tn AS (SELECT doc_id, position, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, position)) AS w FROM tw),
ad AS (SELECT a.doc_id, a.position, sum(a.w * b.w) AS similarity FROM tn a JOIN tn b ON a.doc_id = b.doc_id AND a.term = b.term AND b.position = a.position + 1 GROUP BY ALL)"""


@query(f"WITH {TFIDF} SELECT doc_id, position, round(similarity, 6) AS similarity FROM ad")
def tfidf_adjacent(spark, d):
    return evaluate.adjacent(evaluate.neighbours(paragraphs(spark, d))).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {TFIDF}, nn AS (SELECT doc_id, max(n) AS n FROM kp GROUP BY doc_id), aa AS (SELECT doc_id, sum(similarity) AS s, count(*) FILTER (similarity >= 0.15) AS c FROM ad GROUP BY doc_id),
z AS (SELECT doc_id, n, n - 1 - coalesce(c, 0) AS b, CASE WHEN n > 1 THEN coalesce(s, 0) / (n - 1) ELSE 1.0 END AS m FROM nn LEFT JOIN aa USING (doc_id))
SELECT doc_id, n AS n_texts, CASE WHEN n >= 3 THEN b ELSE 0 END AS boundary_count, round(m, 4)::DOUBLE AS mean_similarity, n >= 3 AND b >= 2 AS detected, CASE WHEN n >= 3 THEN round(1 - m, 4) ELSE 0.0 END::DOUBLE AS confidence FROM z""")
def tfidf_verdict(spark, d):
    return evaluate.tfidf_verdict(paragraphs(spark, d))


GROUPS = "(SELECT label, vec_id, embedding, vec_id % 3 AS l FROM embeddings)"


@query(f"""WITH g AS {GROUPS}, q AS (SELECT a.label, a.vec_id AS i, a.l, b.l AS m, avg(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) ** 2)))) AS d FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL),
e AS (SELECT label, i, max(d) FILTER (l = m) AS a, min(d) FILTER (l <> m) AS b FROM q GROUP BY ALL), s AS (SELECT label, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM e GROUP BY label)
SELECT g.label, round(CASE WHEN count(DISTINCT l) > 1 AND count(*) >= 3 THEN max(s) ELSE -1 END, 6) AS silhouette FROM g JOIN s ON g.label = s.label GROUP BY g.label""")
def silhouette(spark, d):
    rows = table(spark, d, "embeddings").withColumn("l", F.col("vec_id") % 3)
    return evaluate.silhouette(rows, "embedding", "label", "l", "vec_id").withColumn("silhouette", F.round("silhouette", 6))


@query(f"WITH {SUMMARY} SELECT doc_id, estimated_authors > 1 OR anomaly_count > 0 AS multi_author, (estimated_authors > 1 OR anomaly_count > 0) = (doc_id % 2 = 0) AS correct FROM sm")
def multi_author_verdict(spark, d):
    s = clustering.summary(_labelled(spark, d))
    found = (F.col("estimated_authors") > 1) | (F.col("anomaly_count") > 0)
    return s.select("doc_id", found.alias("multi_author"), (found == (F.col("doc_id") % 2 == 0)).alias("correct"))


@query(f"WITH {SUMMARY} SELECT avg(((estimated_authors > 1 OR anomaly_count > 0) = (doc_id % 2 = 0))::INT::DOUBLE) * 100 AS accuracy FROM sm")
def benchmark_accuracy(spark, d):
    return multi_author_verdict(spark, d).agg((F.avg(F.col("correct").cast("double")) * 100).alias("accuracy"))


@query(f"WITH {MATCHES} SELECT query_id, source_id, CASE WHEN similarity > 0.85 THEN 'danger' WHEN similarity > 0.7 THEN 'warning' ELSE 'success' END AS band, max(round(similarity, 6)) OVER (PARTITION BY query_id) AS best FROM rk WHERE rank <= 3")
def similarity_bands(spark, d):
    m, s = _matches(spark, d, 3), F.col("similarity")
    return m.select("query_id", "source_id", F.when(s > 0.85, "danger").when(s > 0.7, "warning").otherwise("success").alias("band"), F.max(F.round(s, 6)).over(Window.partitionBy("query_id")).alias("best"))


@query(f"""WITH {L}, n AS (SELECT doc_id, paragraph_index, cluster_id, lead(cluster_id) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS nx FROM lb),
b AS (SELECT doc_id, 'boundary' AS kind, paragraph_index || '_to_' || (paragraph_index + 1) AS key FROM n WHERE nx IS NOT NULL AND nx <> cluster_id AND (nx = -1 OR cluster_id = -1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) <= 3),
a AS (SELECT doc_id, 'profile' AS kind, paragraph_index::VARCHAR AS key FROM lb WHERE cluster_id = -1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) <= 3)
SELECT * FROM b UNION ALL SELECT * FROM a""")
def reasoning_requests(spark, d):
    labelled = _labelled(spark, d)
    return providers.requests(clustering.boundaries(labelled), labelled.filter("cluster_id = -1"))


@query("SELECT page_id, lower(url) LIKE '%.pdf' OR page_id % 3 = 0 AS accepted, CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' WHEN strlen(html) < 1048576 THEN printf('%.1f KB', floor(strlen(html) / 102.4::DOUBLE + 0.5) / 10) ELSE printf('%.1f MB', floor(strlen(html) / 104857.6::DOUBLE + 0.5) / 10) END AS size FROM pages")
def upload_guard(spark, d):
    kind = F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("text/html")
    pages = table(spark, d, "pages").withColumns({"content_type": kind, "length": F.octet_length("html").cast("long")})
    return pages.select("page_id", uploads.accepted("url", "content_type").alias("accepted"), T.file_size(F.col("length")).alias("size"))


@query(f"WITH {L}, f AS (SELECT doc_id, min(paragraph_index) AS paragraph_index FROM lb WHERE cluster_id = -1 GROUP BY doc_id) SELECT doc_id, paragraph_index, text FROM f JOIN lb USING (doc_id, paragraph_index)")
def first_anomaly(spark, d):
    return _labelled(spark, d).filter("cluster_id = -1").withColumn("_n", F.row_number().over(clustering.by_doc())).filter("_n = 1").select("doc_id", "paragraph_index", "text")


@query()
def json_response(spark, d):
    return uploads.as_json(clustering.summary(_labelled(spark, d)))


# --- the kernel, by properties only


@query()
def hdbscan_labels(spark, d):
    return clustering.label(features.measured(paragraphs(spark, d)).drop("text")).withColumn("probability", F.round("probability", 6))


@query()
def pca_project(spark, d):
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel.pca(np.stack(pdf["embedding"].to_numpy()).astype(float))
        return pd.DataFrame({"label": pdf["label"], "vec_id": pdf["vec_id"], "semantic_1": out[:, 0], "semantic_2": out[:, 1], "semantic_3": out[:, 2]})

    return table(spark, d, "embeddings").groupBy("label").applyInPandas(run, "label int, vec_id long, semantic_1 double, semantic_2 double, semantic_3 double")


@query()
def full_analyze(spark, d):
    told = analyze(ingest.spread(documents(spark, d)))["report"]
    return told.select("doc_id", "status", "integrity_score", "verdict", "estimated_authors", "anomaly_count", "noise", "confidence", "boundary_count", "noise_override", "executive_summary", "conclusion")


@query()
def noise_override(spark, d):
    """Documents that the kernel found to be almost all noise, with the warning that says so."""
    a = analyze(ingest.spread(documents(spark, d)))
    return a["warnings"].filter("code = 'cluster_noise_override'").select("doc_id", "code", "severity")


@query(f"""WITH {P}, n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), c AS (SELECT doc_id, {STRIP.format("text")} AS t FROM documents)
SELECT doc_id, CASE WHEN n > 0 OR length(t) >= 80 THEN 'success' ELSE 'error' END AS status, CASE WHEN n > 0 THEN 'lines' WHEN length(t) >= 80 THEN 'pages' WHEN length(t) > 0 THEN 'raw_chunk' ELSE 'none' END AS extraction_method, CASE WHEN n > 0 THEN n WHEN length(t) >= 80 THEN 1 ELSE 0 END AS n_paragraphs FROM c LEFT JOIN n USING (doc_id)""")
def analyze_status(spark, d):
    return analyze(ingest.spread(documents(spark, d)))["report"].select("doc_id", "status", "extraction_method", "n_paragraphs")


#: What analyze() makes of given labels: the paragraphs of texts that have lines, the one page of the others.
GIVEN = rf"""{P}, pg AS (SELECT * FROM p UNION ALL SELECT doc_id, 0, {STRIP.format(rf"regexp_replace(regexp_replace(regexp_replace(text, '-[ \t]*\n[ \t]*', '', 'g'), '-{S}+', '', 'g'), '{S}+', ' ', 'g')")} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p) AND length({STRIP.format("text")}) >= 80)"""
GIVEN_LABELS = GIVEN + ", lb AS (SELECT *, ((doc_id * 7 + paragraph_index) % 5 - 1)::INT AS cluster_id, 0.5::DOUBLE + (paragraph_index % 5)::DOUBLE / 10 AS probability FROM pg)"
_FROM_TEXT = F1.replace(P + ", ", "", 1).replace(" FROM p)", " FROM pg)")


@query(rf"""WITH {GIVEN_LABELS}, {_FROM_TEXT}, {MEASURES}, {PROFILE}, {SUMMARY.replace(L + ", ", "", 1)},
z AS (SELECT *, {_PAR} AS pa, {_NAR} AS na FROM lb), y0 AS (SELECT doc_id, paragraph_index, cluster_id, list_filter(list_transform(flatten(list_transform(list_concat(pa, list_filter(na, lambda n: NOT list_contains(pa, n))), lambda c: regexp_extract_all(c, '(?:19|20)\d{{2}}'))), lambda q: q::INT), lambda q: q BETWEEN 1900 AND 2030) AS years FROM z),
bs AS (SELECT doc_id, round_even(median(q) FILTER (cluster_id <> -1), 0) AS core FROM (SELECT doc_id, cluster_id, unnest(years) AS q FROM y0) GROUP BY doc_id),
sv AS (SELECT doc_id, abs(round_even(list_aggregate(years, 'median'), 0) - core) AS gap FROM y0 JOIN bs USING (doc_id)),
sq AS (SELECT doc_id, count(*) FILTER (gap > 10) AS late, count(*) FILTER (gap > 20) AS high FROM sv GROUP BY doc_id),
bo AS (SELECT doc_id, count(*) FILTER (f <> cluster_id) AS n FROM (SELECT *, lag(cluster_id) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS f FROM lb) GROUP BY doc_id),
bu AS (SELECT doc_id, count(*) AS n, avg(burstiness_score) AS m FROM pf WHERE num_sentences >= 2 GROUP BY doc_id),
al AS (SELECT sm.doc_id, estimated_authors, anomaly_count, {R("noise", 4)} AS noise, coalesce(bo.n, 0) AS boundary_count, 8.0::DOUBLE * {R("noise", 4)} + 1.5::DOUBLE * greatest(estimated_authors - 1, 0) + CASE WHEN coalesce(bu.n, 0) >= 3 AND bu.m < 0.3 THEN 6.0::DOUBLE ELSE 0 END + least(0.5::DOUBLE * anomaly_count, 3.0::DOUBLE)
  + CASE WHEN bo.n > 2 THEN least(0.3::DOUBLE * (bo.n - 2), 1.5::DOUBLE) ELSE 0 END + 1.5::DOUBLE * coalesce(high, 0) + 0.8::DOUBLE * (coalesce(late, 0) - coalesce(high, 0)) + 0.3::DOUBLE * coalesce(late, 0) AS off FROM sm LEFT JOIN bo USING (doc_id) LEFT JOIN bu USING (doc_id) LEFT JOIN sq USING (doc_id)),
sc AS (SELECT *, greatest(0.0, least(10.0, {R("10.0::DOUBLE - off", 1)}))::DOUBLE AS score FROM al)
SELECT doc_id, score AS integrity_score, CASE WHEN score < 4.0 THEN 'Highly Plagiarized' WHEN score < 7.5 THEN 'Suspicious' WHEN score IS NOT NULL THEN 'Clean' END AS verdict, estimated_authors, anomaly_count, noise, boundary_count::INT AS boundary_count FROM (SELECT doc_id FROM documents) LEFT JOIN sc USING (doc_id)""")
def analyze_given_labels(spark, d):
    """The whole report where labels are given, so that SQL can follow it."""
    docs = ingest.spread(documents(spark, d))
    parts = ingest.parsed(docs.select("doc_id", "text")).select("doc_id", F.posexplode("parts").alias("paragraph_index", "text"))
    whole = parts.select("doc_id", "paragraph_index", ((F.col("doc_id") * 7 + F.col("paragraph_index")) % 5 - 1).cast("int").alias("cluster_id"), (F.lit(0.5) + (F.col("paragraph_index") % 5) / 10).alias("probability"))
    report_rows = analyze(docs, inputs=Inputs(labels=whole))["report"]
    return report_rows.select("doc_id", "integrity_score", "verdict", "estimated_authors", "anomaly_count", "noise", "boundary_count")


#: Columns that are INT here and BIGINT in DuckDB.
_NARROW = {
    "paragraph_index": [n for n in QUERIES if n in ("paragraph_scan", "fixed_chunk_fallback", "reference_antijoin", "sentence_lengths", "burstiness", "avg_word_length", "yules_k", "paragraph_summary", "pos_ratios", "passive_voice", "feature_profiles", "chart_series", "top_function_words", "keyword_topk", "triplet_overlap", "cluster_labels", "citations_parenthetical", "citations_narrative", "citation_union", "median_year", "temporal_anomalies", "exact_containment", "anomaly_topk", "first_anomaly", "cluster_filter", "citing_paragraphs", "anomaly_query")],
    "line_no": ["bibliography_section"],
    "overlap": ["triplet_overlap"],
    "rank": ["top_function_words", "cosine_topk", "anomaly_topk"],
    "n": ["top_function_words"],
    "after_paragraph": ["boundary_pairs"],
    "position": ["tfidf_adjacent"],
}
for _name in ORACLE:
    if _casts := [f"{c}::INT AS {c}" for c, names in _NARROW.items() if _name in names]:
        ORACLE[_name] = f"SELECT * REPLACE ({', '.join(_casts)}) FROM ({ORACLE[_name]})"
