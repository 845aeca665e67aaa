"""Numeric, array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x, digits: int) -> Column:
    """x to decimal digits as Python's round() has it: by the exact binary value, exact halves to even.

    y = 2 * 10**digits * x is rounded, and rest is what the rounding took (a two-product by Veltkamp's split), so a y
    that is an odd integer tells on which side of the half the value lies.
    """
    s = 2.0 * 10**digits
    x = x.cast("double")
    y, c = x * s, x * 134217729.0
    high = c - (c - x)
    rest = (high * s - y) + (x - high) * s
    near = F.floor((y + 1) / 2).cast("double")
    down = (y == 2 * near - 1) & ((rest < 0) | ((rest == 0) & (near % 2 != 0)))
    return F.when(down, near - 1).otherwise(near) / 10.0**digits


def clamp(value, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def boosted(similarity, overlap, weight: float = 0.06) -> Column:
    return F.least(F.lit(1.0), similarity + weight * overlap)


def median_year(array) -> Column:
    """Exact midpoint median of an integer array, halves to even; null when empty."""
    s = F.sort_array(array)
    n = F.size(array)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0
    return F.when(n > 0, F.bround(middle, 0).cast("int"))


def yules_k(array) -> Column:
    """10^4 (sum of squared counts - N) / N^2 of a word array, by the runs of its sorted words."""
    n = F.size(array)
    step = lambda a, w: F.struct(w.alias("last"), F.when(w == a["last"], a["run"] + 1).otherwise(1).cast("long").alias("run"), (a["sum"] + F.when(w == a["last"], 2 * a["run"] + 1).otherwise(1)).cast("long").alias("sum"))
    zero = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))
    squares = F.aggregate(F.sort_array(array), zero, step, lambda a: a["sum"])
    return F.when(n < 2, F.lit(0.0)).otherwise(10000.0 * (squares - n) / (n * n))


def mean(array) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x) / F.greatest(F.size(array), F.lit(1))


def burstiness(lengths) -> Column:
    """Population standard deviation over max(mean, 1) of an integer array."""
    n = F.greatest(F.size(lengths), F.lit(1))
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    squares = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x * x)
    spread = F.sqrt((n * squares - total * total).cast("double")) / n
    return spread / F.greatest(total / n, F.lit(1.0))


def inverted_index_text(index, title) -> Column:
    """Places each word of a map word -> positions, with a space for each step to the next; of words at one position the later key stays; no index gives the title."""
    placed = F.sort_array(F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))))))
    last = lambda a: F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1)["p"] != x["p"]))
    joined = lambda a: F.array_join(F.transform(a, lambda x, i: F.concat(F.repeat(F.lit(" "), x["p"] - F.when(i == 0, 0).otherwise(F.get(a, i - 1)["p"])), x["w"])), "")
    return F.when(index.isNull() | (F.size(index) == 0), title).otherwise(F.element_at(F.transform(F.array(placed), lambda a: F.element_at(F.transform(F.array(last(a)), joined), 1)), 1))


def ai_probability(count, average) -> Column:
    """Percent from the mean burstiness of at least two paragraphs."""
    return F.when(count < 2, 0).otherwise(clamp(F.floor(100 - (average - 0.05) * 200 + 0.5), 1, 99)).cast("int")
