"""Clauses of tagged texts: subject, verb, object and passives by a small grammar, one state machine in an aggregate.

Over the tags of a paragraph (tagging.tag) the machine keeps the clause that it is in: the subject (head of the last noun
group before the verb that no preposition governs), the verb, whether it is passive (a form of be or get before a
participle), and the object (head of the first such group after the verb). The head of a noun group is its last noun.
A clause ends at a sign that ends it, at a conjunction or relative word after its verb, and where the next verb comes; a verb after
`to` keeps the subject; a verb after and, but, or takes the last clause's subject if it finds none. Empty tags have no clauses.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lemmas, tagging

# Forms of be and get, relative words, participles that don't end in -ed or -en.
BE = "am is are was were be been being get gets got gotten getting 's 're 'm".split()
RELATIVE = "who whom which that".split()
PARTICIPLE = "made found built held kept shown known drawn grown thrown done gone set put cut read led lost won met sent spent told sold bought brought caught taught thought said paid laid heard left felt understood".split()
_CLAUSE = "struct<subject:string,verb:string,object:string,passive:boolean>"
_STATE = {"subject": "string", "verb": "string", "object": "string", "passive": "boolean", "be": "boolean", "governed": "boolean", "before": "string", "earlier": "string", "to": "boolean"}


def clauses(tags: str) -> Column:
    """(subject, verb, object, passive) of the clauses with a verb; words are lower-case, missing parts null."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    start = F.struct(*(F.lit(None).cast(k).alias(c) if k == "string" else no.alias(c) for c, k in _STATE.items()), F.array().cast(f"array<{_CLAUSE}>").alias("out"))

    def closed(a):
        clause = F.struct(a["subject"].alias("subject"), a["verb"].alias("verb"), a["object"].alias("object"), a["passive"].alias("passive"))
        return F.when(a["verb"].isNotNull(), F.concat(a["out"], F.array(clause))).otherwise(a["out"])

    def step(a, x):
        word, tag = F.lower(x["word"]), x["tag"]
        tag = F.when((tag == "SCONJ") & word.isin(*RELATIVE), "RELATIVE").when((tag.isin("PRON", "DET")) & word.isin("who", "whom", "which"), "RELATIVE").otherwise(tag)
        stop = (tag == "PUNCT") & word.isin(".", "!", "?", ";", ":")
        has, had = a["verb"].isNotNull(), a["object"].isNotNull()
        noun = tag.isin("NOUN", "PROPN", "PRON")
        group = a["before"].isin("NOUN", "PROPN")  # the group goes on
        possessive = tag == "POSS"
        head = noun & ~a["governed"]
        verb = tag == "VERB"
        participle = word.rlike("(ed|en)$") | word.isin(*PARTICIPLE)
        chained = verb & has & ~had & (a["to"] | (a["before"] == "VERB"))  # want to run
        fresh = (verb | (tag == "AUX")) & has & ~chained & (had | ~a["before"].isin("AUX", "ADV", "PART", "VERB"))
        joint = (tag == "CCONJ") & has
        ends = stop | fresh | joint | (tag.isin("SCONJ", "RELATIVE") & has) | chained
        value = {
            "subject": F.when(stop | joint, none)
            .when(tag == "SCONJ", none)
            .when((tag == "RELATIVE") & has, F.coalesce(a["object"], a["subject"]))
            .when(fresh, F.coalesce(a["object"], a["subject"]))
            .when(head & ~has, word)
            .when(verb & ~has & a["subject"].isNull(), a["earlier"])
            .otherwise(a["subject"]),
            "verb": F.when(verb & (~has | fresh | chained), word).when(ends, none).otherwise(a["verb"]),
            "object": F.when(ends, none).when(head & has & (a["object"].isNull() | group), word).otherwise(a["object"]),
            "passive": F.when(verb & (~has | fresh | chained), a["be"] & participle & ~chained).when(ends, no).otherwise(a["passive"]),
            "be": F.when(tag == "AUX", word.isin(*BE)).when(tag.isin("ADV", "PART"), a["be"]).otherwise(no),
            "governed": F.when(tag == "ADP", F.lit(True)).when(noun, a["governed"]).when(tag.isin("DET", "ADJ", "NUM") | possessive, a["governed"] & ~a["before"].isin("NOUN", "PROPN")).otherwise(no),
            "before": tag,
            "earlier": F.when(stop, none).when(joint, a["subject"]).when(tag == "SCONJ", none).otherwise(a["earlier"]),
            "to": (tag == "PART") & (word == "to") | ((tag == "ADV") & a["to"]),
        }
        return F.struct(*(value[c].alias(c) for c in _STATE), F.when(ends, closed(a)).otherwise(a["out"]).alias("out"))

    return F.aggregate(tags, start, step, closed)


_BE, _RELATIVE, _WHO, _PARTICIPLE, _STOP = map(frozenset, (BE, RELATIVE, ("who", "whom", "which"), PARTICIPLE, (".", "!", "?", ";", ":")))
_NOUNS = frozenset(("NOUN", "PROPN"))


def walk(tokens: Iterable[tuple[str, str]]) -> list[tuple[str | None, str, str | None, bool]]:
    """clauses() of one text's lower-case words and tags, by the same states; a task walks many texts this way much faster than an aggregate does."""
    out = []
    subject = verb = target = before = earlier = None
    passive = be = governed = to = False
    for word, tag in tokens:
        if tag == "SCONJ" and word in _RELATIVE or tag in ("PRON", "DET") and word in _WHO:
            tag = "RELATIVE"
        has, had, is_verb = verb is not None, target is not None, tag == "VERB"
        stop = tag == "PUNCT" and word in _STOP
        noun = tag in _NOUNS or tag == "PRON"
        head = noun and not governed
        chained = is_verb and has and not had and (to or before == "VERB")
        fresh = (is_verb or tag == "AUX") and has and not chained and (had or before not in ("AUX", "ADV", "PART", "VERB"))
        joint = tag == "CCONJ" and has
        ends = stop or fresh or joint or chained or has and tag in ("SCONJ", "RELATIVE")
        if ends and has:
            out.append((subject, verb, target, passive))
        was = subject
        if stop or joint or tag == "SCONJ":
            subject = None
        elif tag == "RELATIVE" and has or fresh:
            subject = target if had else subject
        elif head and not has:
            subject = word
        elif is_verb and not has and subject is None:
            subject = earlier
        if is_verb and (not has or fresh or chained):
            passive = be and not chained and (word.endswith(("ed", "en")) or word in _PARTICIPLE)
            verb = word
        elif ends:
            verb, passive = None, False
        if ends:
            target = None
        elif head and has and (target is None or before in _NOUNS):
            target = word
        if tag == "AUX":
            be = word in _BE
        elif tag not in ("ADV", "PART"):
            be = False
        if tag == "ADP":
            governed = True
        elif tag in ("DET", "ADJ", "NUM", "POSS"):
            governed = governed and before not in _NOUNS
        elif not noun:
            governed = False
        if stop or tag == "SCONJ":
            earlier = None
        elif joint:
            earlier = was
        to = tag == "PART" and word == "to" or tag == "ADV" and to
        before = tag
    if verb is not None:
        out.append((subject, verb, target, passive))
    return out


def _walked(words: pa.Array, ends: np.ndarray, tags: np.ndarray):
    """walk() of each text of a batch."""
    told = words.dictionary_encode()
    low = [w.lower() for w in told.dictionary.to_pylist()]
    tokens = [(low[i], tagging.TAGS[t]) for i, t in zip(told.indices.to_pylist(), tags.tolist(), strict=True)]
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield walk(tokens[start:end])


def passive_counts(paragraphs: DataFrame, model: tagging.Model = tagging.PRIOR) -> DataFrame:
    """(doc_id, paragraph_index, passives): passives() of paragraphs(doc_id, paragraph_index, text)."""

    def made(words, ends, codes, tags):
        return [pa.array([sum((s is not None) + 1 for s, _, _, passive in found if passive) for found in _walked(words, ends, tags)], pa.int32())]

    return tagging.tag_batches(paragraphs, made, "passives int", model, keep=("doc_id", "paragraph_index"))


def spoken(paragraphs: DataFrame, model: tagging.Model = tagging.PRIOR) -> DataFrame:
    """(doc_id, paragraph_index, clauses): the different (subject, verb, object) of each text, whole ones only."""
    kind = "array<struct<subject:string,verb:string,object:string>>"

    def made(words, ends, codes, tags):
        whole = [[*dict.fromkeys((s, v, o) for s, v, o, _ in found if s is not None and o is not None)] for found in _walked(words, ends, tags)]
        upto = np.concatenate([[0], np.cumsum([len(w) for w in whole])])
        parts = [pa.array([c[i] for w in whole for c in w], pa.string()) for i in range(3)]
        return [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays(parts, ["subject", "verb", "object"]))]

    return tagging.tag_batches(paragraphs, made, f"clauses {kind}", model, keep=("doc_id", "paragraph_index"))


def passives(array: Column) -> Column:
    """What a dependency reading counts for passives: the auxiliary of each, and its subject where there is one."""
    return F.aggregate(array, F.lit(0), lambda n, c: n + F.when(c["passive"], F.when(c["subject"].isNotNull(), 2).otherwise(1)).otherwise(0))


_PARTS = {"subject": "NOUN", "verb": "VERB", "object": "NOUN"}


def triplets(tagged: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, triplets): the distinct subject_verb_object of each paragraph of tagged(doc_id, paragraph_index, tags), by lemmas of table, a lemmas.lemma_table()."""
    whole = F.filter(clauses("tags"), lambda c: c["subject"].isNotNull() & c["object"].isNotNull())
    return named(tagged.select("doc_id", "paragraph_index", F.transform(whole, lambda c: F.struct(*(c[p].alias(p) for p in _PARTS))).alias("clauses")), table)


def named(said: DataFrame, table: DataFrame) -> DataFrame:
    """triplets() of spoken(): only words that a lemma may stand for are looked up, once a paragraph."""
    asked = F.array_distinct(F.flatten(F.transform("clauses", lambda c: F.array(*(F.struct(c[p].alias("word"), F.lit(t).alias("tag")) for p, t in _PARTS.items())))))
    known = lemmas.looked_up(said.withColumn("_asked", asked), "clauses", "_asked", table)
    joined = F.transform("clauses", lambda c: F.concat_ws("_", *(lemmas.of(c[p], F.lit(t)) for p, t in _PARTS.items())))
    return known.select("doc_id", "paragraph_index", F.array_sort(F.array_distinct(joined)).alias("triplets"))
