"""Lemmas by suffix rules that are learnt from pairs of forms in the corpus.

An inflected form and its base share a stem: `studies` and `study` differ by the rule ies -> y. rules() counts, for each
kind of inflection (its marker ends the form: s, ed, ing, er, est), how many stems of the corpus's vocabulary show a
rule. A form meets only bases of its own stem, so a stem of many words makes no pairs among them. lemma_table() gives
each word and tag its lemma: of the rules that fit, one whose result is a word of the corpus first, then the one of most
stems, then the longest ending; a word that no rule fits is its own lemma. Everything is joins of tables by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers by tag; letters that a rule may take beside the marker and put in its place; letters of a stem; stems of a rule.
MARKERS = {"NOUN": ("s",), "VERB": ("s", "ed", "ing"), "ADJ": ("er", "est")}
TAKEN, PUT, STEM, LEAST = 2, 1, 3, 3

# Forms that no ending explains, form and lemma.
IRREGULAR = {
    "NOUN": "men man women woman children child people people feet foot teeth tooth mice mouse data datum criteria criterion phenomena phenomenon analyses analysis hypotheses hypothesis indices index matrices matrix",
    "VERB": "ran run made make took take got get went go came come saw see seen see knew know known know thought think said say found find gave give given give showed show shown show held hold kept keep wrote write written write led lead built build began begin became become won win lost lose met meet sent send spent spend told tell",
    "ADJ": "better good best good worse bad worst bad more more most most",
}


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n) of words(word)."""
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _kinds(spark) -> DataFrame:
    """(tag, marker): a constant."""
    return spark.createDataFrame([(t, m) for t, ms in MARKERS.items() for m in ms], "tag string, marker string")


def _forms(known: DataFrame) -> DataFrame:
    """(word, marker, stem, taken): each word that ends in a marker, with each stem that a rule may leave."""
    markers = sorted({m for ms in MARKERS.values() for m in ms})
    ending = F.filter(F.array(*map(F.lit, markers)), lambda m: F.endswith("word", m))
    marked = known.select("word", F.explode(ending).alias("marker"))
    sizes = F.sequence(F.lit(0), F.lit(TAKEN))
    cut = marked.select("word", "marker", F.explode(sizes).alias("_k")).withColumn("_s", F.length("word") - F.length("marker") - F.col("_k")).filter(F.col("_s") >= STEM)
    return cut.select("word", "marker", F.expr("left(word, _s)").alias("stem"), F.expr("substr(word, _s + 1)").alias("taken"))


def rules(known: DataFrame, least: int = LEAST) -> DataFrame:
    """(marker, taken, put, stems): the rules that at least so many stems of vocabulary() show."""
    base = known.select("word", F.explode(F.sequence(F.lit(0), F.lit(PUT))).alias("_k")).withColumn("_s", F.length("word") - F.col("_k")).filter(F.col("_s") >= STEM)
    inflected = F.exists(F.array(*map(F.lit, sorted({m for ms in MARKERS.values() for m in ms}))), lambda m: F.endswith("word", m))
    bases = base.filter((F.col("_k") == 0) | ~inflected).select(F.expr("left(word, _s)").alias("stem"), F.expr("substr(word, _s + 1)").alias("put"))
    pairs = _forms(known).join(bases, "stem").filter(F.col("taken") != F.col("put"))
    # a rule is told by the letters that change: none before the marker may be taken only to be put back
    pairs = pairs.filter((F.col("put") == "") | (F.length("taken") == F.length("marker")) | (F.expr("left(taken, 1)") != F.expr("left(put, 1)")))
    return pairs.groupBy("marker", "taken", "put").agg(F.countDistinct("stem").alias("stems")).filter(F.col("stems") >= least)


def lemma_table(known: DataFrame, told: DataFrame) -> DataFrame:
    """(word, tag, lemma) of each word of vocabulary() that a rule of rules(), or the list of irregular forms, changes; tags are those of MARKERS.

    A form meets the words of the vocabulary that share its stem, and, of rules that take the same ending, only the best one:
    the others could give it only words that the vocabulary lacks, which rank behind.
    """
    spark = known.sparkSession
    told = told.select("marker", "taken", "put", "stems")
    best = told.groupBy("marker", "taken").agg(F.min(F.struct((-F.col("stems")).alias("_s"), "put")).alias("_b")).select("marker", "taken", F.col("_b.put").alias("put"), (-F.col("_b._s")).alias("stems"))
    base = known.select("word", F.explode(F.sequence(F.lit(0), F.lit(PUT))).alias("_k")).withColumn("_s", F.length("word") - F.col("_k")).filter(F.col("_s") >= STEM)
    bases = base.select(F.expr("left(word, _s)").alias("stem"), F.expr("substr(word, _s + 1)").alias("put"))
    # rules are few, whatever the corpus: a marker, at most TAKEN letters before it, and PUT after
    there = _forms(known).join(bases, "stem").join(F.broadcast(told), ["marker", "taken", "put"]).withColumn("_new", F.lit(False))
    made = _forms(known).join(F.broadcast(best), ["marker", "taken"]).withColumn("_new", F.lit(True))
    met = there.unionByName(made, allowMissingColumns=True).withColumn("lemma", F.concat("stem", "put")).join(F.broadcast(_kinds(spark)), "marker")
    first = F.min(F.struct("_new", (-F.col("stems")).alias("_n"), (-F.length("taken")).alias("_t"), "lemma"))
    learnt = met.groupBy("word", "tag").agg(first.alias("_b")).select("word", "tag", F.col("_b.lemma").alias("lemma"))
    listed = [(w, t, m) for (w, t), m in irregular().items()]
    fixed = F.broadcast(spark.createDataFrame(listed, "word string, tag string, lemma string"))
    return learnt.join(fixed, ["word", "tag"], "left_anti").unionByName(fixed.join(known.select("word"), "word", "left_semi"))


def lemmatised(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """tokens(word, tag, ...) with lemma, the lower-case word where table, a lemma_table(), has none."""
    keyed = tokens.withColumn("_low", F.lower("word"))
    found = table.select(F.col("word").alias("_low"), "tag", F.col("lemma").alias("_lemma"))
    return keyed.join(found, ["_low", "tag"], "left").withColumn("lemma", F.coalesce("_lemma", "_low")).drop("_low", "_lemma")


def irregular() -> dict[tuple[str, str], str]:
    """(word, tag) to lemma, of the list."""
    return {(w, t): m for t, text in IRREGULAR.items() for w, m in zip(text.split()[::2], text.split()[1::2], strict=True)}


def may_change(word: Column, tag: Column) -> Column:
    """Whether a lemma_table() may have a lower-case word: it ends in a marker of its tag, or is listed."""
    out = F.lit(False)
    for t, markers in MARKERS.items():
        ending = word.isin(*IRREGULAR[t].split()[::2])
        for m in markers:
            ending = ending | F.endswith(word, F.lit(m))
        out = out | ((tag == t) & ending)
    return out


def looked_up(rows: DataFrame, carried: str, asked: str, table: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, carried, _lemmas): rows(doc_id, paragraph_index, carried array, asked array of (word, tag)) with the lemmas that table has for what they ask; see of().

    Words that table can't have aren't joined; a row without questions has a key of its own, so that such rows don't meet in one task.
    """
    key = ["doc_id", "paragraph_index"]
    each = rows.select(*key, carried, F.posexplode_outer(F.filter(asked, lambda x: may_change(x["word"], x["tag"]))).alias("_no", "_x"))
    alone = F.concat(F.lit("\x00"), F.xxhash64(*key).cast("string"))
    keyed = each.select(*key, F.when(F.coalesce("_no", F.lit(0)) == 0, F.col(carried)).alias(carried), F.coalesce("_x.word", alone).alias("word"), F.col("_x.tag").alias("tag"))
    met = keyed.join(table.select("word", "tag", "lemma"), ["word", "tag"], "left")
    pair = F.when(F.col("lemma").isNotNull(), F.struct(F.concat_ws(" ", "tag", "word").alias("key"), F.col("lemma").alias("value")))
    return met.groupBy(*key).agg(F.flatten(F.collect_list(carried)).alias(carried), F.map_from_entries(F.collect_set(pair)).alias("_lemmas"))


def of(word: Column, tag: Column) -> Column:
    """The lemma of a word by the _lemmas of looked_up()."""
    return F.coalesce(F.try_element_at(F.col("_lemmas"), F.concat_ws(" ", tag, word)), word)
