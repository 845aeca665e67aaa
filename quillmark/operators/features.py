"""Stylometric features of paragraphs, each row by itself: array expressions inside the scan's stage, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AUXILIARIES, CONJUNCTIONS, DEFAULT, DETERMINERS, FEATURES, FUNCTION_WORDS, PREPOSITIONS, PRONOUNS, Config
from ..functions import numeric as N
from ..functions import text as T
from . import clauses, lemmas, sentences, tagging

#: Tags of function words.
FUNCTION_TAGS = ("ADP", "CCONJ", "SCONJ", "PRON", "POSS", "DET", "AUX")


def annotate(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with _words (lower-case alphabetic), _lengths (words by sentence) and _tokens."""
    split = paragraphs.withColumns({"_words": T.alpha_words("text"), "_sentences": T.sentences("text"), "_tokens": T.token_count("text")})
    lengths = sentences.lengths() if "sentence_ends" in paragraphs.columns else F.transform("_sentences", lambda s: F.size(T.words(s)))
    return split.withColumn("_lengths", lengths).drop("_sentences")


def measured(paragraphs: DataFrame, config: Config = DEFAULT, keep: bool = False) -> DataFrame:
    """paragraphs with num_sentences, is_valid and the eight unrounded features (0 where a paragraph is too short).

    Where paragraphs have tags (tagging.tag), word classes and passives are read from them; where they have sentence_ends
    (sentences.boundaries), sentences are. Otherwise closed lists and patterns stand in.
    """
    rows = paragraphs if "_words" in paragraphs.columns else annotate(paragraphs)
    n = F.greatest(F.size("_lengths"), F.lit(1))
    factor, tagged = 2 if config.legacy_passive_twice else 1, "tags" in paragraphs.columns
    values = {
        "avg_sentence_length": N.mean("_lengths"),
        "avg_word_length": F.length(F.array_join("_words", "")) / F.greatest(F.size("_words"), F.lit(1)),
        **(tag_ratios("tags") if tagged else T.pos_ratios("_words", F.col("_tokens"))),
        "passive_voice_pct": (clauses.passives(clauses.clauses("tags")) if tagged else factor * F.regexp_count(F.lower("text"), F.lit(T.PASSIVE))) * 100.0 / n,
        "yules_k": N.yules_k("_words"),
        "burstiness_score": N.burstiness("_lengths"),
    }
    long = F.size("_words") >= config.min_words
    out = rows.withColumns({f: F.when(long, values[f]).otherwise(0.0) for f in FEATURES} | {"num_sentences": F.when(long, n).otherwise(1).cast("int"), "_enough": long})
    valid = F.lit(False)
    for f in FEATURES:
        valid = valid | (F.col(f) != 0)
    out = out.withColumn("is_valid", F.coalesce(valid, F.lit(False))).drop("_enough")
    return out if keep else out.drop("_words", "_lengths", "_tokens")


def profiles(paragraphs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The presentation of the features, to 4 decimals."""
    rows = measured(paragraphs, config)
    return rows.select("doc_id", "paragraph_index", "is_valid", "num_sentences", *(N.round_even(F.col(f), 4).alias(f) for f in FEATURES))


def summary(paragraphs: DataFrame, tagger: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row a paragraph: words, sentences, distinct words, counts of seven word classes, the five most frequent function words, the features.

    tagger adds a column `tags`, array of (word, tag), to paragraphs, tags as in TAGS; by default words are tagged by the
    closed lists, and by endings where no list has them.
    """
    rows = annotate(paragraphs if tagger is None else tagger(paragraphs))
    tags = F.transform("_words", tag) if tagger is None else F.transform("tags", lambda x: x["tag"])
    counted = measured(rows.withColumn("_tags", tags), keep=True)
    count = lambda names: F.size(F.filter("_tags", lambda t: t.isin(*names)))
    used = F.filter("_words", lambda w: w.isin(*FUNCTION_WORDS))
    return counted.select(
        "doc_id",
        "paragraph_index",
        F.size("_words").alias("word_count"),
        F.size("_lengths").alias("sentence_count"),
        F.size(F.array_distinct("_words")).alias("unique_words"),
        *(count(names).alias(n) for n, names in TAGS.items()),
        F.transform(_ranked(used, 5), lambda b: F.concat_ws(":", b["word"], (-b["_n"]).cast("string"))).alias("top_function_words"),
        F.array(*(N.round_even(F.col(f), 4) for f in FEATURES)).alias("features"),
    )


#: Name of a count to the tags that it counts.
TAGS = {"nouns": ("NOUN", "PROPN"), "verbs": ("VERB", "AUX"), "adjectives": ("ADJ",), "adverbs": ("ADV",), "pronouns": ("PRON", "POSS"), "prepositions": ("ADP",), "conjunctions": ("CCONJ", "SCONJ")}


def tag(word: Column) -> Column:
    """A word's class by list, else by ending, else NOUN."""
    listed = F.when(word.isin(*PRONOUNS), "PRON").when(word.isin(*PREPOSITIONS), "ADP").when(word.isin(*CONJUNCTIONS), "CCONJ").when(word.isin(*DETERMINERS), "DET").when(word.isin(*AUXILIARIES), "AUX")
    return listed.when(word.rlike("ly$"), "ADV").when(word.rlike("(ous|ful|ive|able|ible|ic|less)$"), "ADJ").when(word.rlike("(ize|ise|ify|ing|ed)$"), "VERB").otherwise("NOUN")


def _ranked(used, k: int) -> Column:
    """(_n: minus the count, _at, word) of the k most frequent words of an array, ties by first place."""
    return F.slice(F.sort_array(F.transform(F.array_distinct(used), lambda w: F.struct((-F.size(F.filter(used, lambda x: x == w))).alias("_n"), F.array_position(used, w).alias("_at"), w.alias("word")))), 1, k)


def top_function_words(paragraphs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, paragraph_index, rank, word, n): most frequent function words, ties by first place."""
    used = F.filter(T.alpha_words("text"), lambda w: w.isin(*FUNCTION_WORDS))
    rows = paragraphs.select("doc_id", "paragraph_index", used.alias("_used"))
    counted = F.transform(F.array_distinct("_used"), lambda w: F.struct((-F.size(F.filter("_used", lambda x: x == w))).alias("_n"), F.array_position("_used", w).alias("_at"), w.alias("word")))
    best = rows.withColumn("_best", F.slice(F.sort_array(counted), 1, k)).select("doc_id", "paragraph_index", F.posexplode_outer("_best").alias("_rank", "_b")).filter("_b IS NOT NULL")
    return best.select("doc_id", "paragraph_index", (F.col("_rank") + 1).alias("rank"), "_b.word", (-F.col("_b._n")).alias("n"))


def keywords(paragraphs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, paragraph_index, query): the longest distinct content words, ties by alphabet, joined for a search."""
    content = F.array_distinct(F.filter(T.alpha_words("text"), lambda w: ~w.isin(*FUNCTION_WORDS) & (F.length(w) > 2)))
    ranked = F.slice(F.sort_array(F.transform(content, lambda w: F.struct((-F.length(w)).alias("_n"), w.alias("w")))), 1, k)
    rows = paragraphs.select("doc_id", "paragraph_index", F.transform(ranked, lambda x: x["w"]).alias("_k"), T.word_count("text").alias("_n"))
    return rows.filter("_n >= 10 AND size(_k) > 0").select("doc_id", "paragraph_index", F.array_join("_k", " AND ").alias("query"))


def tag_ratios(tags: str) -> dict[str, Column]:
    """Shares of pronouns, prepositions and conjunctions among all tokens, by tags."""
    share = lambda *names: F.size(F.filter(tags, lambda x: x["tag"].isin(*names))) / F.greatest(F.size(tags), F.lit(1))
    return {"pronoun_ratio": share("PRON", "POSS"), "preposition_ratio": share("ADP"), "conjunction_ratio": share("CCONJ", "SCONJ")}


def path_ratios(path: str) -> dict[str, Column]:
    """tag_ratios() by tagging.paths()."""
    share = lambda *names: tagging.count_of(path, names) / F.greatest(F.length(path), F.lit(1))
    return {"pronoun_ratio": share("PRON", "POSS"), "preposition_ratio": share("ADP"), "conjunction_ratio": share("CCONJ", "SCONJ")}


def path_summary(paragraphs: DataFrame, k: int = 5) -> DataFrame:
    """tag_summary() of paragraphs, tagged and counted batch by batch: the words of a batch are sorted once, whatever a paragraph's length."""
    import numpy as np
    import pyarrow as pa

    wanted = np.isin(np.arange(len(tagging.TAGS)), [tagging.TAGS.index(t) for t in FUNCTION_TAGS])

    def made(words, ends, codes, tags):
        at = np.flatnonzero(wanted[tags])
        told = words.take(pa.array(at)).dictionary_encode()
        low = [w.lower() if w.isalpha() else None for w in told.dictionary.to_pylist()]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for w in low if w is not None))}
        names = list(number)
        word = np.array([number.get(w, -1) for w in low], np.int64)[told.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
        row = np.searchsorted(ends, at, "right") - 1
        row, word = row[word >= 0], word[word >= 0]
        pair, first, n = np.unique(row * max(len(names), 1) + word, return_index=True, return_counts=True)
        row, word = pair // max(len(names), 1), pair % max(len(names), 1)
        order = np.lexsort((first, -n, row))
        row, word, n = row[order], word[order], n[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best: list[list[str]] = [[] for _ in range(len(ends) - 1)]
        for r, w, c in zip(row[rank < k].tolist(), word[rank < k].tolist(), n[rank < k].tolist(), strict=True):
            best[r].append(f"{names[w]}:{c}")
        return [tagging.path_of(ends, tags), pa.array([",".join(b) for b in best], pa.string())]

    told = tagging.tag_batches(paragraphs, made, "path string, top_function_words string", keep=("doc_id", "paragraph_index"))
    return told.select("doc_id", "paragraph_index", *(tagging.count_of("path", names).alias(n) for n, names in TAGS.items()), "top_function_words")


def tag_summary(tagged: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, paragraph_index, counts of seven word classes, top_function_words) of tagged(tags), ties by first place."""
    count = lambda names: F.size(F.filter("tags", lambda x: x["tag"].isin(*names)))
    used = F.transform(F.filter("tags", lambda x: x["tag"].isin(*FUNCTION_TAGS) & x["word"].rlike(rf"^(?:{T.ALPHA})$")), lambda x: F.lower(x["word"]))
    top = F.transform(_ranked(used, k), lambda b: F.concat_ws(":", b["word"], (-b["_n"]).cast("string")))
    return tagged.select("doc_id", "paragraph_index", *(count(names).alias(n) for n, names in TAGS.items()), F.array_join(top, ",").alias("top_function_words"))


def lemma_keywords(tagged: DataFrame, table: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, paragraph_index, query): the longest distinct lemmas of nouns and adjectives that aren't function words, ties by alphabet; table: a lemmas.lemma_table().

    Paragraphs of fewer than ten words have none.
    """
    wanted = F.filter("tags", lambda x: x["tag"].isin("NOUN", "ADJ") & x["word"].rlike(rf"^(?:{T.ALPHA})$") & ~F.lower(x["word"]).isin(*FUNCTION_WORDS))
    words = F.array_distinct(F.transform(wanted, lambda x: F.struct(F.lower(x["word"]).alias("word"), x["tag"].alias("tag"))))
    each = tagged.filter(T.word_count("text") >= 10).select("doc_id", "paragraph_index", F.explode(words).alias("x")).select("doc_id", "paragraph_index", "x.*")
    found = lemmas.lemmatised(each, table).groupBy("doc_id", "paragraph_index").agg(F.collect_set(F.struct((-F.length("lemma")).alias("_n"), "lemma")).alias("_k"))
    return found.select("doc_id", "paragraph_index", F.array_join(F.transform(F.slice(F.sort_array("_k"), 1, k), lambda x: x["lemma"]), " AND ").alias("query"))


def wanted_words(paragraphs: DataFrame, model: tagging.Model = tagging.PRIOR, k: int = 3) -> DataFrame:
    """(doc_id, paragraph_index, fixed, asked): of each paragraph of ten words or more with nouns or adjectives, the k longest that have no other lemma, and those (word, tag) whose lemma may be among the k longest.

    A rule's lemma is no longer than its word, so what is shorter than k fixed ones isn't asked.
    """
    import pyarrow as pa

    listed, endings, left_out = lemmas.irregular(), {t: tuple(ms) for t, ms in lemmas.MARKERS.items()}, frozenset(FUNCTION_WORDS)
    kinds = {tagging.TAGS.index(t): t for t in ("NOUN", "ADJ")}

    def made(words, ends, codes, tags):
        told = words.dictionary_encode()
        low = [w.lower() if w.isalpha() and w.lower() not in left_out else None for w in told.dictionary.to_pylist()]
        word, tag = told.indices.to_pylist(), tags.tolist()
        fixed_all, asked_all = [], []
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            fixed, asked = set(), {}
            for w, t in {(word[i], tag[i]) for i in range(start, end) if tag[i] in kinds and low[word[i]] is not None}:
                pair = (low[w], kinds[t])
                if pair in listed or pair[0].endswith(endings[pair[1]]):
                    asked[pair] = max(len(pair[0]), len(listed.get(pair, "")))
                else:
                    fixed.add(pair[0])
            best = sorted(fixed, key=lambda w: (-len(w), w))[:k]
            least = len(best[-1]) if len(best) == k else 0
            fixed_all.append(best)
            asked_all.append([{"word": w, "tag": t} for (w, t), n in asked.items() if n >= least])
        return [pa.array(fixed_all, pa.list_(pa.string())), pa.array(asked_all, pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())])))]

    long = paragraphs.filter(T.word_count("text") >= 10)
    return tagging.tag_batches(long, made, "fixed array<string>, asked array<struct<word:string,tag:string>>", model, keep=("doc_id", "paragraph_index")).filter("size(fixed) > 0 OR size(asked) > 0")


def lemma_queries(paragraphs: DataFrame, table: DataFrame, model: tagging.Model = tagging.PRIOR, k: int = 3) -> DataFrame:
    """lemma_keywords() of paragraphs(doc_id, paragraph_index, text): few words of a paragraph are looked up in table."""
    asked = wanted_words(paragraphs, model, k).withColumn("_carried", F.concat(F.transform("fixed", lambda w: F.struct(w.alias("word"), F.lit(None).cast("string").alias("tag"))), "asked"))
    known = lemmas.looked_up(asked, "_carried", "asked", table)
    lemma = F.array_distinct(F.transform("_carried", lambda x: F.when(x["tag"].isNull(), x["word"]).otherwise(lemmas.of(x["word"], x["tag"]))))
    ranked = F.slice(F.sort_array(F.transform(lemma, lambda m: F.struct((-F.length(m)).alias("_n"), m.alias("lemma")))), 1, k)
    return known.select("doc_id", "paragraph_index", F.array_join(F.transform(ranked, lambda x: x["lemma"]), " AND ").alias("query"))


def triplet_array(text) -> Column:
    """Distinct runs of three content words, the stand-in for subject, verb and object without a parser."""
    content = F.filter(T.alpha_words(text), lambda w: ~w.isin(*FUNCTION_WORDS))
    return F.array_distinct(F.filter(F.transform(content, lambda w, i: F.when(i + 2 < F.size(content), F.concat_ws("_", w, F.get(content, i + 1), F.get(content, i + 2)))), lambda t: t.isNotNull()))


def triplets(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, triplets): see triplet_array()."""
    content = paragraphs.select("doc_id", "paragraph_index", F.filter(T.alpha_words("text"), lambda w: ~w.isin(*FUNCTION_WORDS)).alias("_w"))
    made = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.concat_ws("_", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<string>"))
    return content.select("doc_id", "paragraph_index", F.array_distinct(made).alias("triplets"))
