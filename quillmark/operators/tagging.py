"""Part-of-speech tags by a hidden Markov model over ambiguity classes (Kupiec 1992).

A token belongs to one class: a closed list of words, a shape (number, sign, capital inside a sentence) or an ending.
A class allows a few tags, so a paragraph is a lattice. The model is two tables of fixed size, whatever the corpus:
transitions between tags, and how likely a tag shows a class. PRIOR states them by rough shares; learn() improves both by
expectation-maximisation over a corpus: each round scans the paragraphs once, tasks give the expected counts of their
paragraphs, Spark sums them, and the prior joins as pseudo-counts, so that a strange corpus can't undo it.

Tokens and classes are built-in expressions. Decoding works on batches of class codes: paragraphs of like length are
decoded side by side, scores being whole numbers (1/1000 bit), so results are the same on every engine.
Ties go to the earlier tag. Null and empty texts have no tokens and no tags.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: POSS are pronouns before nouns, as my and their.
TAGS = ("NOUN", "PROPN", "VERB", "AUX", "ADJ", "ADV", "PRON", "DET", "ADP", "CCONJ", "SCONJ", "PART", "NUM", "PUNCT", "POSS")
#: One letter a tag, for texts of tags.
LETTERS = "NMVXJRPDICSTUZQ"
#: Endings of words that are tokens of their own, as in don't and it's; the mark keeps them whole.
MARK = "\x02"
CLITIC = r"(\p{L})([nN]['’][tT]|['’](?:[sS]|[rR][eE]|[vV][eE]|[lL][lL]|[dD]|[mM]))([^\p{L}]|$)"
TOKEN = r"\x02[nN]?['’][A-Za-z]{1,2}|\p{L}+|\p{N}+(?:[.,]\p{N}+)*|[^\x00-\x20\p{Z}\p{L}\p{N}]"

# Classes of tokens in the order in which they are tried, with the shares of their tags. Lists hold lower-case words.
LISTS = {
    "that": ("that", "SCONJ 45 PRON 30 DET 20 ADV 5"),
    "to": ("to", "PART 60 ADP 40"),
    "as": ("as", "ADP 50 SCONJ 40 ADV 10"),
    "like": ("like", "ADP 55 VERB 35 SCONJ 10"),
    "time": ("before after since until than", "ADP 60 SCONJ 40"),
    "subordinator": ("because if unless while whereas though although whether once when where how why wherein", "SCONJ 90 ADV 10"),
    "coordinator": ("and or but nor", "CCONJ 99 ADV 1"),
    "so": ("so yet", "ADV 65 SCONJ 20 CCONJ 15"),
    "preposition": ("of in for with at from by about into through during against among within without toward towards upon across between under over above below near per via despite beyond behind around throughout onto along", "ADP 96 ADV 4"),
    "particle": ("up out off down on", "ADP 75 ADV 25"),
    "pronoun": ("i me myself you yourself he him himself she herself it itself we us ourselves they them themselves mine yours ours theirs hers someone anyone everyone nobody something anything everything nothing", "PRON 99 NOUN 1"),
    "possessive": ("my your his her its our their", "POSS 94 PRON 6"),
    "relative": ("who whom whose what which", "PRON 85 DET 15"),
    "demonstrative": ("this these those", "DET 65 PRON 35"),
    "there": ("there", "PRON 50 ADV 50"),
    "article": ("the a an every each", "DET 99 PRON 1"),
    "quantifier": ("some any no all both another either neither", "DET 80 PRON 20"),
    "more": ("more most less least", "ADV 50 ADJ 50"),
    "be": ("am is are was were be been being", "AUX 96 VERB 4"),
    "have": ("have has had having do does did", "VERB 60 AUX 40"),
    "get": ("get gets got gotten getting", "VERB 70 AUX 30"),
    "modal": ("can could may might must shall should will would ca wo", "AUX 98 NOUN 2"),
    "not": ("not n't n’t", "PART 99 ADV 1"),
    "'s": ("'s ’s", "PART 60 AUX 40"),
    "clitic": ("'re 've 'll 'd 'm ’re ’ve ’ll ’d ’m", "AUX 98 PRON 2"),
    "adverb": ("very also too just only even still never always often then now again here however therefore thus moreover furthermore perhaps almost quite rather well soon already ever really together instead back", "ADV 95 ADJ 3 NOUN 2"),
    "irregular": ("made make took take taken go went gone came come saw seen knew know known thought think said say found find gave give given showed shown held hold kept keep wrote write written ran set met led built began begun became become beat hit won lost", "VERB 96 NOUN 4"),
    "number": ("one two three four five six seven eight nine ten hundred thousand million", "NUM 92 PRON 5 NOUN 3"),
    "adjective": ("new good best better great clear simple high low large small long big other own same such many few much several first last real full free old young hard easy common different", "ADJ 92 NOUN 5 ADV 3"),
}
#: name: (pattern of the whole lower-case token, shares). A capital inside a sentence is tried before the endings.
SHAPES = {"sign": (r"[^\p{L}\p{N}]+", "PUNCT 100"), "figure": (r"\p{N}.*", "NUM 100")}
NAME = ("name", "PROPN 88 NOUN 6 ADJ 6")
ENDINGS = {
    "-ly": (r".{2,}ly", "ADV 88 ADJ 8 NOUN 4"),
    "-tion": (r".{2,}(?:tion|sion|ment|ness|ity|ism|ship|ance|ence|hood|dom|ology|ture|ist|gy|cy)s?|.{2,}(?:ities|ings|gies|cies)", "NOUN 97 VERB 3"),
    "-ous": (r".{2,}(?:ous|ful|ive|able|ible|less|ical|ial|ual|ory|ish|al|ic|ary|ent|ant)", "ADJ 78 NOUN 20 VERB 2"),
    "-ing": (r".{2,}ing", "VERB 68 NOUN 22 ADJ 10"),
    "-ed": (r".{2,}ed", "VERB 82 ADJ 17 NOUN 1"),
    "-ize": (r".{2,}(?:ize|ise|ify)(?:s|d)?|.{2,}ifies", "VERB 90 NOUN 10"),
    "-ate": (r".{2,}ate", "VERB 60 ADJ 20 NOUN 20"),
    "-ss": (r".*(?:ss|us|is)", "NOUN 80 ADJ 12 VERB 8"),
    "-s": (r".*s", "NOUN 72 VERB 28"),
    "-er": (r".{2,}(?:er|or)", "NOUN 75 ADJ 13 VERB 12"),
    "other": (r".*", "NOUN 60 VERB 20 ADJ 17 ADV 3"),
}
#: Shares of the tags in English prose, and of the next tag after each; START stands before a paragraph.
UNIGRAM = "NOUN 21 PROPN 5 VERB 12 AUX 6 ADJ 8 ADV 5 PRON 6 POSS 2 DET 9 ADP 10 CCONJ 3 SCONJ 2 PART 3 NUM 2 PUNCT 12"
NEXT = {
    "START": "DET 20 PRON 16 POSS 2 NOUN 15 PROPN 10 ADP 9 ADV 9 ADJ 5 SCONJ 5 VERB 5 NUM 2 CCONJ 1 AUX 1 PUNCT 1 PART 1",
    "NOUN": "PUNCT 28 ADP 25 NOUN 9 VERB 9 AUX 9 CCONJ 7 SCONJ 3 PRON 3 POSS 0.3 PART 3 ADV 3 DET 1 ADJ 1 PROPN 1 NUM 1",
    "PROPN": "PUNCT 30 PROPN 22 ADP 10 VERB 10 AUX 8 CCONJ 7 NOUN 5 PART 4 NUM 3 ADV 1 ADJ 1 PRON 1 SCONJ 1 DET 1",
    "VERB": "DET 20 ADP 19 PRON 6 POSS 4 NOUN 12 ADV 8 ADJ 8 PUNCT 8 PART 6 SCONJ 4 VERB 3 PROPN 2 NUM 2 CCONJ 2 AUX 1",
    "AUX": "VERB 38 ADV 14 PART 10 DET 9 ADJ 10 AUX 8 PRON 3 POSS 1 ADP 4 NOUN 2 PUNCT 2 NUM 1 PROPN 1 SCONJ 1 CCONJ 1",
    "ADJ": "NOUN 58 PUNCT 10 ADJ 8 ADP 7 CCONJ 6 PROPN 3 PART 2 SCONJ 2 ADV 1 VERB 1 PRON 1 NUM 1 AUX 1 DET 1",
    "ADV": "VERB 24 ADJ 16 PUNCT 18 ADV 9 ADP 9 DET 5 PRON 5 NOUN 3 AUX 5 SCONJ 4 NUM 2 CCONJ 2 PART 1 PROPN 1",
    "PRON": "VERB 36 AUX 33 NOUN 2 ADJ 2 PUNCT 10 ADV 5 ADP 4 PRON 2 DET 2 PROPN 1 CCONJ 1 SCONJ 1 PART 1 NUM 1",
    "POSS": "NOUN 68 ADJ 24 VERB 2 PROPN 2 NUM 1 ADV 2 PUNCT 1",
    "DET": "NOUN 58 ADJ 25 PROPN 6 NUM 3 ADV 3 VERB 3 PRON 1 DET 1 ADP 1 PUNCT 1 AUX 1 CCONJ 1 SCONJ 1 PART 1",
    "ADP": "DET 32 NOUN 23 PROPN 10 PRON 6 POSS 5 ADJ 11 NUM 4 VERB 5 ADP 2 ADV 2 SCONJ 2 PUNCT 2 CCONJ 1 PART 1 AUX 1",
    "CCONJ": "NOUN 21 DET 14 ADJ 13 VERB 13 PRON 8 POSS 2 PROPN 8 ADV 8 ADP 5 AUX 4 NUM 2 PART 2 SCONJ 2 PUNCT 1 CCONJ 1",
    "SCONJ": "PRON 24 POSS 3 DET 22 NOUN 17 ADJ 7 PROPN 5 VERB 8 ADV 5 ADP 4 AUX 3 NUM 1 PART 1 PUNCT 2 SCONJ 1 CCONJ 1",
    "PART": "VERB 62 NOUN 9 AUX 8 ADV 7 ADJ 6 DET 4 ADP 2 PUNCT 4 PRON 1 PROPN 1 NUM 1 CCONJ 1 SCONJ 1 PART 1",
    "NUM": "NOUN 45 PUNCT 25 ADP 8 ADJ 6 NUM 5 CCONJ 4 PROPN 2 VERB 1 AUX 1 PRON 1 DET 1 ADV 1 SCONJ 1 PART 1",
    "PUNCT": "DET 13 PRON 11 POSS 2 NOUN 13 PUNCT 11 PROPN 8 CCONJ 8 ADP 8 ADV 7 VERB 7 ADJ 5 SCONJ 4 NUM 3 AUX 2 PART 1",
}
CLASSES = (*SHAPES, *LISTS, NAME[0], *ENDINGS)
#: Score of what isn't possible, far below any sum of a text's scores but within 64 bits.
NEVER = -(10**12)
#: Of what no path takes, further below.
BARRED = -(1 << 60)
UNIT = 1000


def _told(text: str) -> np.ndarray:
    found = dict(zip(text.split()[::2], map(float, text.split()[1::2]), strict=True))
    share = np.array([found.get(t, 0.0) for t in TAGS])
    return share / share.sum()


@dataclass(frozen=True)
class Model:
    """transition[u + 1, t]: share of tag t after u (row 0: at the start); emission[c, t]: of class c among what shows t, up to a factor of c."""

    transition: np.ndarray
    emission: np.ndarray

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        def score(x: np.ndarray) -> np.ndarray:
            return np.array([[round(UNIT * log2(v)) if v > 0 else NEVER for v in row] for row in x.tolist()], np.int64)

        return score(self.transition), score(self.emission)


def _prior() -> Model:
    shares = [x[1] for x in (*SHAPES.values(), *LISTS.values(), NAME, *ENDINGS.values())]
    after = np.array([_told(NEXT["START"]), *(_told(NEXT[t]) for t in TAGS)])
    return Model(0.999 * after + 0.001 / len(TAGS), np.array([_told(s) for s in shares]) / _told(UNIGRAM))


PRIOR = _prior()


def tokens(text) -> Column:
    """Words, numbers and signs; contractions are two tokens."""
    marked = F.regexp_replace(text, CLITIC, f"$1 {MARK}$2$3")
    return F.transform(F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0)), lambda t: F.replace(t, F.lit(MARK), F.lit("")))


def classes(array: Column) -> Column:
    """The class code of each token of an array: its place in CLASSES."""

    def code(token: Column, before: Column) -> Column:
        low, number = F.lower(token), {name: i for i, name in enumerate(CLASSES)}
        matches = lambda pattern: low.rlike(f"^(?:{pattern})$")
        out = F
        for name, (words, _) in LISTS.items():  # no listed word has a shape, and sets are looked up faster than patterns are tried
            out = out.when(low.isin(*words.split()), number[name])
        for name, (pattern, _) in SHAPES.items():
            out = out.when(matches(pattern), number[name])
        inside = before.isNotNull() & ~before.isin(".", "!", "?", ":", '"', "“")
        out = out.when(inside & token.rlike(r"^\p{Lu}"), number[NAME[0]])
        for name, (pattern, _) in ENDINGS.items():
            out = out.when(matches(pattern), number[name])
        return out

    return F.transform(F.array(array), lambda a: F.transform(a, lambda t, i: code(t, F.when(i > 0, F.get(a, i - 1)))))[0]


def _lengths(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all lists in a row, and where each begins and ends."""
    sizes = np.array([0 if v is None else v for v in pc.list_value_length(lists).to_pylist()], np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _side_by_side(ends: np.ndarray, cells: int = 1 << 16):
    """Rows in groups of like length, each of about so many cells at most, with the padded places of their tokens (the last one, repeated)."""
    sizes = np.diff(ends)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = len(order)
    while at > 0:
        longest = sizes[order[at - 1]]
        rows = order[max(0, at - max(1, cells // int(longest))) : at]
        at -= len(rows)
        yield rows, ends[rows][:, None] + np.minimum(np.arange(longest)[None, :], sizes[rows][:, None] - 1), sizes[rows]


def _lattice(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each class its possible tags (padded), the score of each at the start, and of each after each possible tag of each class; BARRED where padded."""
    step, show = model.scores()
    possible = [np.flatnonzero(row > NEVER) if (row > NEVER).any() else np.arange(len(TAGS)) for row in show]
    wide = max(map(len, possible))
    tags = np.array([np.pad(p, (0, wide - len(p))) for p in possible])
    padded = np.array([np.arange(wide) >= len(p) for p in possible])
    seen = np.where(padded, BARRED, np.take_along_axis(show, tags, 1))
    first = np.where(padded, BARRED, step[0][tags] + seen)
    ways = step[1:][tags[:, None, :, None], tags[None, :, None, :]] + seen[None, :, None, :]
    return tags, first, np.where(padded[None, :, None, :] | padded[:, None, :, None], BARRED, ways)


def decode(codes: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    """The tag of each token: of all paths through a row's lattice the one of greatest score, of equal ones the first by the last differing tag.

    A class has few possible tags, so the lattice is as wide as the class of most, not as all tags.
    """
    tags, first, ways = _lattice(model)
    out = np.zeros(len(codes), np.int64)
    for rows, place, sizes in _side_by_side(ends, 1 << 18):
        code = np.ascontiguousarray(codes[place].T)
        best, here = first[code[0]], np.arange(len(rows))
        came = np.zeros((*code.shape, tags.shape[1]), np.int8)
        for i in range(1, len(code)):
            here = here[i < sizes[here]]  # rows that go on
            reached = np.maximum(best[here], BARRED)[:, :, None] + ways[code[i - 1, here], code[i, here]]
            came[i, here] = reached.argmax(1)
            best[here] = reached.max(1)
        slot, row = best.argmax(1), np.arange(len(rows))
        for i in range(len(code) - 1, -1, -1):
            here = row[i < sizes]
            out[place[here, i]] = tags[code[i, here], slot[here]]
            if i:
                slot[here] = came[i, here, slot[here]]
    return out


_ENDS = [(len(SHAPES) + len(LISTS) + 1 + i, re.compile(pattern)) for i, (pattern, _) in enumerate(ENDINGS.values())]
_LISTED = {w: len(SHAPES) + i for i, (words, _) in reversed(list(enumerate(LISTS.values()))) for w in words.split()}
_NAME, _STOPS = CLASSES.index(NAME[0]), (".", "!", "?", ":", '"', "“")
#: Kinds of tokens that a worker remembers at most.
REMEMBERED = 1 << 18


def _kind(token: str) -> int:
    """The class of a token, in 8 bits; the next tells that it is a name inside a sentence, the next that it ends one."""
    low = token.lower()
    found, flags = _LISTED.get(low), (token in _STOPS) << 9
    if found is not None:
        return found | flags
    if all(unicodedata.category(c)[0] not in "LN" for c in low):
        return flags
    if unicodedata.category(low[0])[0] == "N":
        return 1 | flags
    return next(i for i, p in _ENDS if p.fullmatch(low)) | (unicodedata.category(token[0]) == "Lu") << 8 | flags


def codes_of(words: pa.Array, ends: np.ndarray, known: dict[str, int]) -> np.ndarray:
    """classes() of the tokens of all rows in a row, each different token looked at once; known remembers them."""
    told = words.dictionary_encode()
    if len(known) > REMEMBERED:
        known.clear()
    kinds = np.empty(len(told.dictionary), np.int64)
    for i, t in enumerate(told.dictionary.to_pylist()):
        kind = known.get(t)
        kinds[i] = known.setdefault(t, _kind(t)) if kind is None else kind
    kinds = kinds[told.indices.to_numpy(zero_copy_only=False)] if len(words) else kinds
    inside = np.ones(len(kinds), bool)
    inside[1:] = kinds[:-1] & 512 == 0
    inside[ends[:-1][np.diff(ends) > 0]] = False  # a row's first token
    return np.where(inside & (kinds & 256 != 0), _NAME, kinds & 255)


def _marked(text) -> Column:
    """The tokens of a text as they are found, those of contractions with their mark."""
    return F.coalesce(F.regexp_extract_all(F.regexp_replace(text, CLITIC, f"$1 {MARK}$2$3"), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def tag_batches(frame: DataFrame, made, ddl: str, model: Model = PRIOR, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns keep (all) of frame, and those of ddl, that made(words, ends, codes, tags) gives for a batch: its tokens in a row, where each text's end, their classes and tags."""
    kept = frame.columns if keep is None else list(keep)
    split = frame.select(*kept, _marked(text).alias("_marked"))
    schema = frame.select(*kept).schema
    for field in frame.sparkSession.createDataFrame([], ddl).schema:
        schema = schema.add(field)
    at = len(kept)

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            lists = batch.column(at)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words, ends = pc.replace_substring(lists.flatten(), MARK, ""), np.concatenate([[0], np.cumsum(sizes)])
            codes = codes_of(words, ends, known)
            yield pa.record_batch([*batch.columns[:at], *made(words, ends, codes, decode(codes, ends, model))], names=schema.names)

    return split.mapInArrow(run, schema)


def tag(paragraphs: DataFrame, model: Model = PRIOR, text: str = "text") -> DataFrame:
    """paragraphs with tags, an array of (word, tag) of their tokens, instead of a column of that name."""
    names = pa.array(TAGS)

    def made(words, ends, codes, tags):
        pairs = pa.StructArray.from_arrays([words, names.take(pa.array(tags))], ["word", "tag"])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]

    return tag_batches(paragraphs.drop("tags"), made, "tags array<struct<word:string,tag:string>>", model, text)


def path_of(ends: np.ndarray, tags: np.ndarray) -> pa.Array:
    """The tags of each row as a text, a letter of LETTERS each."""
    letters = np.frombuffer(LETTERS.encode(), np.uint8)[tags]
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters))


def paths(paragraphs: DataFrame, model: Model = PRIOR, text: str = "text", keep: tuple[str, ...] = ("doc_id", "paragraph_index")) -> DataFrame:
    """(keep..., path, score): the tags of each text as letters of LETTERS, and the score of the path, added up from the model's tables."""
    step, show = model.scores()

    def made(words, ends, codes, tags):
        before = np.concatenate([[0], tags[:-1] + 1])
        before[ends[:-1][np.diff(ends) > 0]] = 0
        each = np.concatenate([[0], np.cumsum(step[before[: len(tags)], tags] + show[codes, tags])])
        return [path_of(ends, tags), pa.array(each[ends[1:]] - each[ends[:-1]])]

    return tag_batches(paragraphs, made, "path string, score long", model, text, keep)


def count_of(path: str, names: tuple[str, ...]) -> Column:
    """How many tags of names a path() has."""
    return F.length(F.regexp_replace(path, "[^" + "".join(LETTERS[TAGS.index(n)] for n in names) + "]", ""))


def letters(tags: str) -> Column:
    """The tags as a text, a letter of LETTERS each."""
    code = F.create_map(*(x for t, c in zip(TAGS, LETTERS, strict=True) for x in (F.lit(t), F.lit(c))))
    return F.array_join(F.transform(tags, lambda x: code[x["tag"]]), "")


def expected(codes: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected counts of transitions and of (class, tag), and the log-likelihood (bits), by forward and backward sums."""
    moves, shown, told = np.zeros_like(model.transition), np.zeros_like(model.emission), 0.0
    for _, place, sizes in _side_by_side(ends):
        code, n = codes[place], place.shape[1]
        show = model.emission[code]
        ahead, scale = np.zeros(show.shape), np.ones(place.shape)
        for i in range(n):
            here = (model.transition[0][None, :] if i == 0 else ahead[:, i - 1] @ model.transition[1:]) * show[:, i]
            scale[:, i] = here.sum(1)
            scale[(i >= sizes) & (scale[:, i] == 0), i] = 1.0  # beyond a row's end
            ahead[:, i] = here / scale[:, i][:, None]
        inside = np.arange(n)[None, :] < sizes[:, None]
        told += float(np.log2(scale[inside]).sum())
        back = np.ones((len(sizes), len(TAGS)))
        for i in range(n - 1, -1, -1):
            here = inside[:, i]
            after = ahead[:, i] * back
            np.add.at(shown, code[here, i], after[here])
            into = show[:, i] * back / scale[:, i][:, None]
            if i:
                moves[1:] += model.transition[1:] * (ahead[here, i - 1].T @ into[here])
                back = np.where(here[:, None], into @ model.transition[1:].T, 1.0)
            else:
                moves[0] += model.transition[0] * into.sum(0)
    return moves, shown, told


def _counts(paragraphs: DataFrame, model: Model, text: str) -> list:
    """One row (moves, shown, likelihood) of the whole corpus: three lists of fixed size, summed by Spark."""

    def run(batches):
        for batch in batches:
            codes, ends = _lengths(batch.column(0))
            moves, shown, told = expected(codes, ends, model)
            values = np.concatenate([moves.ravel(), shown.ravel(), [told]])
            yield pa.record_batch([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])

    coded = paragraphs.select(F.coalesce(tokens(text), F.array().cast("array<string>")).alias("_t")).select(classes(F.col("_t")).alias("codes"))
    return coded.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()


def learn(paragraphs: DataFrame, rounds: int = 3, strength: float = 2000.0, start: Model = PRIOR, text: str = "text") -> tuple[Model, list[float]]:
    """The model after some rounds of expectation-maximisation over paragraphs(text), and the log-likelihood (bits) that each round found.

    The prior counts as `strength` occurrences of each tag. Tags that PRIOR rules out for a class stay ruled out.
    """
    model, history, n = start, [], start.transition.size
    weight = _told(UNIGRAM)
    for _ in range(rounds):
        found = _counts(paragraphs, model, text)
        values = np.zeros(n + start.emission.size + 1)
        values[[r["at"] for r in found]] = [r["value"] for r in found]
        moves = values[:n].reshape(start.transition.shape) + strength * PRIOR.transition
        shown = values[n:-1].reshape(start.emission.shape)
        each = shown.sum(1, keepdims=True)  # the prior of a class as shares of its tags, weighed by how much of it there is
        shares = PRIOR.emission * weight
        shares /= shares.sum(1, keepdims=True)
        mixed = shown + shares * np.minimum(each + 1, strength)
        history.append(float(values[-1]))
        tag_share = np.where(mixed.sum(0) > 0, mixed.sum(0), 1)
        left = moves.sum(1, keepdims=True)
        model = Model(np.where(left > 0, moves / np.where(left > 0, left, 1), PRIOR.transition), mixed / tag_share)
    return model, history
