"""Secrets in texts: three exact patterns, and a sliding-window entropy over candidate strings (native).

A base match of a kind is a leftmost non-overlapping match of its pattern whose secret part is long enough; its span is
the whole match. Candidates are maximal runs of LEAST or more characters of ALPHABET. Over each, a window of WINDOW
characters slides: one character enters, one leaves, and the counts of both, the sum of c * log2(c) over the counts and
the numbers of digits, letters and letters of hexadecimal digits change by that step alone. A window whose Shannon
entropy reaches the limit of its character class is hit: hexadecimal digits with letters among them have the lowest
limit, letters with digits a higher one, letters of both cases the highest; digits or letters of one case alone, as
numbers and words are, have none. Windows that overlap or touch become one span of kind `entropy`. Candidates of the
allow-list give none: UUIDs, named checksums, placeholders, and words and numbers joined by signs. Base spans are never
suppressed.

Logarithms are whole numbers of 1/65536 bit, so that no engine rounds a window to the other side.

Defined cases: a null text is empty and has no spans; ties of a start are ordered by kind; spans of different kinds may
overlap and all stay; repeated rows get equal rows; very long texts are scanned whole, each in its row, in time
linear in their length; other columns of docs are ignored, whatever their names; an empty table gives no rows.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: (pattern, the group that holds the secret, its least length), in the order of ties.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
ENTROPY = "entropy"
KINDS = (*BASE, ENTROPY)
#: Symbols in the order of their classes: 10 digits, 26 small letters, 26 capitals, signs.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
LEAST = WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Bits of entropy from which a window is hit, by class.
BITS = {"hexadecimal": 3.0, "mixed": 3.5, "letters": 4.0}
UNIT = 65536
#: c * log2(c) by count, and what the sum may be at most for a class to be hit.
TERMS = [round(UNIT * c * log2(c)) if c else 0 for c in range(WINDOW + 2)]
MOST = {name: int(UNIT * WINDOW * (log2(WINDOW) - bits)) for name, bits in BITS.items()}
#: Candidates that aren't secrets; words and numbers joined by signs are those without PUT_TOGETHER.
ALLOWED = (r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", r"^sha(1|256|384|512)[-_=]", r"[Ee]xample|EXAMPLE|[Pp]laceholder|[Cc]hange_?me|[Yy]our_|xxxxxx|XXXXXX|0123456789|abcdefghij")
PUT_TOGETHER = r"[A-Za-z]{16,}|[0-9]{9,}|[A-Za-z][0-9]|[0-9][A-Za-z]"
_CHUNK = 256


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


_FOUND = "struct<start:bigint,end:bigint,found:string>"


def located(text: Column, pattern: str) -> Column:
    """(start, end, found) of a pattern's leftmost non-overlapping matches, none of them empty, by the lengths of what stands between them.

    Matches are placed by chunks, so that growing the array costs no square of their number.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, found, lambda b, m: F.struct(F.char_length(b).cast("long").alias("gap"), m.alias("found")))
    chunked = F.transform(F.array(pairs), lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(_CHUNK)), lambda i: F.slice(a, i + 1, _CHUNK)))
    zero = F.lit(0).cast("long")

    def place(a, x):
        at = a["at"] + x["gap"]
        end = at + F.coalesce(F.char_length(x["found"]), F.lit(0))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(at.alias("start"), end.alias("end"), x["found"].alias("found")))).alias("out"), a["done"].alias("done"))

    def chunk(a, part):
        return F.aggregate(part, F.struct(a["at"].alias("at"), _none(_FOUND).alias("out"), a["done"].alias("done")), place, lambda r: F.struct(r["at"].alias("at"), F.concat(r["done"], F.array(r["out"])).alias("done")))

    placed = F.aggregate(F.flatten(chunked), F.struct(zero.alias("at"), _none(f"array<{_FOUND}>").alias("done")), chunk, lambda r: F.flatten(r["done"]))
    return F.when(text.rlike(pattern), F.filter(placed, lambda m: m["found"].isNotNull())).otherwise(_none(_FOUND))


def _number(values: list[int], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


def high_entropy(candidate: Column) -> Column:
    """(start, end) in a candidate of the unions of its hit windows.

    The counts of a window are one string, a character a symbol, whose code is 48 more than the count.
    """
    symbols = F.transform(F.split(candidate, "", -1), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(
        *(F.lit(0).alias(n) for n in ("digits", "small", "capitals", "hexes", "sum")),
        F.lit("0" * len(ALPHABET)).alias("counts"),
        F.lit(-1).alias("from"),
        F.lit(-1).alias("upto"),
        _none("struct<start:int,end:int>").alias("out"),
    )
    classes = {"digits": lambda s: s.between(1, 10), "small": lambda s: s.between(11, 36), "capitals": lambda s: s.between(37, 62), "hexes": lambda s: s.between(1, 16) | s.between(37, 42)}
    count = lambda counts, s: F.ascii(F.substr(counts, s, F.lit(1))) - 48
    put = lambda counts, s, n: F.overlay(counts, F.char(n + 48), s, F.lit(1))

    def leave(x):
        def change(a):
            s, n = x["leaves"], F.when(x["leaves"] > 0, count(a["counts"], x["leaves"])).otherwise(1)
            lower = ((a[c] - F.when(inside(s), 1).otherwise(0)).alias(c) for c, inside in classes.items())
            return F.struct(*lower, (a["sum"] - _number(TERMS, n) + _number(TERMS, n - 1)).alias("sum"), F.when(s > 0, put(a["counts"], s, n - 1)).otherwise(a["counts"]).alias("counts"), *(a[c].alias(c) for c in ("from", "upto", "out")))

        return change

    def enter(x):
        def change(a):
            s, n = x["enters"], count(a["counts"], x["enters"])
            higher = ((a[c] + F.when(inside(s), 1).otherwise(0)).alias(c) for c, inside in classes.items())
            return F.struct(*higher, (a["sum"] + _number(TERMS, n + 1) - _number(TERMS, n)).alias("sum"), put(a["counts"], s, n + 1).alias("counts"), *(a[c].alias(c) for c in ("from", "upto", "out")))

        return change

    def hit(a):
        letters = a["small"] + a["capitals"]
        both = (letters > 0) & (a["digits"] > 0)
        most = F.when(both & (a["hexes"] == WINDOW), MOST["hexadecimal"]).when(both, MOST["mixed"]).when((a["small"] > 0) & (a["capitals"] > 0), MOST["letters"]).otherwise(-1)
        return a["sum"] <= most

    def mark(x):
        def change(a):
            begin, end = x["at"] - (WINDOW - 1), x["at"] + 1
            found = (begin >= 0) & hit(a)
            apart = found & (begin > a["upto"])
            closed = F.when(apart & (a["upto"] > 0), F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["upto"].alias("end"))))).otherwise(a["out"])
            return F.struct(*(a[c].alias(c) for c in (*classes, "sum", "counts")), F.when(apart, begin).otherwise(a["from"]).alias("from"), F.when(found, end).otherwise(a["upto"]).alias("upto"), closed.alias("out"))

        return change

    def step(a, x):
        state = F.array(a)
        for change in (leave, enter, mark):
            state = F.transform(state, change(x))
        return F.element_at(state, 1)

    moves = F.transform(F.array(symbols), lambda all_: F.transform(all_, lambda s, i: F.struct(i.alias("at"), s.alias("enters"), F.when(i >= WINDOW, F.get(all_, i - WINDOW)).otherwise(0).alias("leaves"))))
    last = lambda a: F.when(a["upto"] > 0, F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["upto"].alias("end"))))).otherwise(a["out"])
    return F.aggregate(F.flatten(moves), start, step, last)


def allowed(candidate: Column) -> Column:
    known = ~candidate.rlike(PUT_TOGETHER)
    for pattern in ALLOWED:
        known = known | candidate.rlike(pattern)
    return known


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("no"), m["end"].cast("long").alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: str, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    secret = lambda m: F.regexp_extract(m["found"], pattern, group) if group else m["found"]
    return _spans(F.filter(located(F.col(text), pattern), lambda m: F.char_length(secret(m)) >= least), kind)


def entropy_spans(text: str) -> Column:
    candidates = F.filter(located(F.col(text), CANDIDATE), lambda m: ~allowed(m["found"]))
    shifted = F.transform(candidates, lambda m: F.transform(high_entropy(m["found"]), lambda w: F.struct((m["start"] + w["start"]).alias("start"), (m["start"] + w["end"]).alias("end"))))
    return _spans(F.flatten(shifted), ENTROPY)


def scan(docs: DataFrame) -> DataFrame:
    """Each row of docs(doc_id, text): doc_id, base and spans, arrays of (start, no, end, kind) by start and kind; base has those of the three patterns only."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    found = text.select("doc_id", F.concat(*(base_spans("_text", k) for k in BASE)).alias("base"), entropy_spans("_text").alias("_more"))
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "_more")).alias("spans"))


def told(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """doc_id and text of docs(doc_id, text), each union of overlapping spans replaced by the mark; a null text stays null."""
    found = scan(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text")).select("doc_id.doc_id", "doc_id.text", "spans")

    def part(a, s):
        clear = F.when(s["start"] > a["at"], F.substr("text", (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.when(s["start"] >= a["at"], F.array(F.concat(clear, F.lit(mark)))).otherwise(_none("string"))).alias("out"))

    joined = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), _none("string").alias("out")), part, lambda a: F.concat(F.array_join(a["out"], ""), F.substr("text", (a["at"] + 1).cast("int"), F.char_length("text"))))
    return found.select("doc_id", F.when(F.size("spans") > 0, joined).otherwise(F.col("text")).alias("text"))
