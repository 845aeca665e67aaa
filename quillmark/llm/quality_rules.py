"""Quality rules whose cutoffs adapt to language and source (native).

Ratios of each text are integers (per mille). A mergeable quantile sketch counts them in buckets that keep the seven
leading bits, so any quantile is right to 1/64 of its value; sketches of a language and of the whole corpus are sums
of those of its sources. A cutoff lies REACH times as far beyond a high quantile of the group as that quantile is from
the group's median (below a low quantile likewise, where a rule has a lower side). Only a group whose quantile lies
so near its median that this leaves less than a floor takes the floor instead. Groups of fewer than `least` texts use
their language's sketch, then the corpus's. Cutoffs are joined back by group.

Defined cases: null or empty texts have no words and fail the base; texts that fail it stay out of the sketches; null
languages and sources form groups of their own; a value on a cutoff is inside; repeated rows count as often as they
occur and get equal verdicts; very long texts are measured whole, each in its row; other columns of docs are ignored,
whatever their names; an empty table gives no rows. Three-word windows are compared by 64-bit hash within one text, so
the work stays in its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD, cut, maybe_broadcast, null_key

#: name: (numerator, denominator, scale, percentile of the upper side, floor of a cutoff's distance from the quantile, lower side too)
RULES = {
    "symbols": ("n_symbols", "n_words", 1000, 75, 20, False),
    "shouting": ("n_shout", "n_words", 1000, 90, 20, False),
    "word_length": ("word_chars", "n_words", 100, 90, 20, True),
    "repeated_lines": ("n_dup_lines", "n_lines", 1000, 95, 350, False),
    "repeated_words": ("n_repeat_words", "n_words", 1000, 95, 20, False),
}
#: Cutoffs lie so many times the distance between quantile and median beyond the quantile.
REACH = 3


def measures(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with n_words, word_chars, n_symbols, n_shout, n_lines, n_dup_lines, n_repeat_words."""
    gone = lambda pattern: (F.char_length("_text") - F.char_length(F.regexp_replace("_text", pattern, ""))).cast("long")
    at = lambda i: F.get(F.col("_words"), i)
    alike = lambda s, j: F.get(F.col("_grams"), j)["h"] == s["h"]
    words = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumns({"_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))})
    grams = words.withColumn(
        "_grams",
        F.when(
            F.size("_words") >= 3,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("p")))),
        ),
    )
    twice = grams.withColumn("_twice", F.sort_array(F.transform(F.filter("_grams", lambda s, j: alike(s, j - 1) | alike(s, j + 1)), lambda s: s["p"])))
    covered = F.aggregate("_twice", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return twice.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.char_length("_text") - F.regexp_count("_text", F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
            "n_symbols": gone("[#*$%&|<>]"),
            "n_shout": gone("[A-Z!]"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_text", "_words", "_lines", "_grams", "_twice")


def ratio(rule: str):
    top, under, scale, *_ = RULES[rule]
    return F.floor(F.col(top) * scale / F.greatest(F.col(under), F.lit(1))).cast("long")


def bucket(value: str):
    """The seven leading bits of a count."""
    shift = f"greatest(length(bin({value})) - 7, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(measured: DataFrame) -> DataFrame:
    """(_lang, _source, _level, rule, bucket, n): level 0 by language and source, 1 by language, 3 of the corpus."""
    values = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"_{r}").alias("value")) for r in RULES)))
    flat = measured.filter("NOT base_failed").select("_lang", "_source", values.alias("v")).select("_lang", "_source", "v.rule", bucket("v.value").alias("bucket"))
    fine = flat.groupBy("_lang", "_source", "rule", "bucket").agg(F.count("*").alias("n"))
    return fine.groupingSets([["_lang", "_source", "rule", "bucket"], ["_lang", "rule", "bucket"], ["rule", "bucket"]], "_lang", "_source", "rule", "bucket").agg(F.sum("n").alias("n"), F.grouping_id().alias("_level")).withColumn("_level", F.expr("_level div 4"))


def _by_rule(place: int):
    """The rule's entry at a place of RULES, as a column."""
    return F.create_map(*(x for r, rule in RULES.items() for x in (F.lit(r), F.lit(rule[place]))))[F.col("rule")]


def cutoffs(measured: DataFrame, least: int) -> DataFrame:
    """One row for each (_lang, _source), with _cut_<rule>: low (null where there is none), high, floored (the floor decides a side)."""
    key = Window.partitionBy("_level", "_lang", "_source", "rule")
    ranked = sketches(measured).withColumn("_upto", F.sum("n").over(key.orderBy("bucket"))).withColumn("_all", F.sum("n").over(key))
    at = lambda percent: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * percent, F.col("bucket")))
    marks = ranked.groupBy("_level", "_lang", "_source", "rule").agg(F.max("_all").alias("_all"), at(100 - _by_rule(3)).alias("_low"), at(F.lit(50)).alias("_mid"), at(_by_rule(3)).alias("_high")).filter((F.col("_all") >= least) | (F.col("_level") == 3))
    floor, both = _by_rule(4), _by_rule(5)
    up, down = REACH * (F.col("_high") - F.col("_mid")), REACH * (F.col("_mid") - F.col("_low"))
    fence = F.struct(F.when(both, F.col("_low") - F.greatest(down, floor)).alias("low"), (F.col("_high") + F.greatest(up, floor)).alias("high"), ((up < floor) | (both & (down < floor))).alias("floored"))
    fences = marks.select("_level", "_lang", "_source", "rule", fence.alias("_fence"))
    groups = measured.filter("NOT base_failed").groupBy("_lang", "_source").agg(F.count("*").alias("_n")).withColumn("rule", F.explode(F.array(*map(F.lit, RULES))))
    of = lambda level, *on: maybe_broadcast(fences.filter(f"_level = {level}").select(*on, "rule", F.col("_fence").alias(f"_f{level}")))
    found = groups.join(of(0, "_lang", "_source"), ["_lang", "_source", "rule"], "left").join(of(1, "_lang"), ["_lang", "rule"], "left").join(of(3), ["rule"], "left")
    nearest = F.coalesce("_f0", "_f1", "_f3")
    return found.groupBy("_lang", "_source").agg(*(F.max(F.when(F.col("rule") == r, nearest)).alias(f"_cut_{r}") for r in RULES))


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns of docs(text, lang, source, ...), as _carry_<name>, with the group, the measures, the rules' ratios and base_failed; written once."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = measures(docs.select("text", null_key("lang").alias("_lang"), null_key("source").alias("_source"), *(F.col(c).alias(f"_carry_{c}") for c in carry)))
    return cut(named.drop("text").withColumn("base_failed", failed).withColumns({f"_{r}": ratio(r) for r in RULES}), "quality-measures")


def judge(docs: DataFrame, least: int = 30, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns of docs(text, lang, source, ...) with the measures, base_failed and kept."""
    rows = measured(docs, carry)
    limits = maybe_broadcast(cut(cutoffs(rows, least), "quality-cutoffs"))
    inside = F.lit(True)
    for r in RULES:
        within = F.coalesce(F.col(f"_{r}") >= F.col(f"_cut_{r}.low"), F.lit(True)) & (F.col(f"_{r}") <= F.col(f"_cut_{r}.high"))
        inside = inside & F.coalesce(within, F.lit(True))
    return rows.join(limits, ["_lang", "_source"], "left").select(*(F.col(f"_carry_{c}").alias(c) for c in carry), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "n_shout", "n_lines")
