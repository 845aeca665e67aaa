"""How far the word shares of the sources of a language are apart, by an exact heavy-light split.

Terms are counted by (language, source) in blocks of texts and the counts summed; a language keeps the V terms of at
least LEAST of its documents. With N kept occurrences of a group, a term that occurs c times there has the share
p = 1 + floor(UNIT * (c + 1) / (N + V)); the divergence of p from q is floor((p - q)^2 / q). All numbers are whole.

The sum of divergences over all kept terms, for each two sources of a language, has two parts. Heavy terms occur in more
than LIGHT groups of the language: their shares, absent ones included, fill dense tiles of TILE terms by two bands of
BAND sources, and a tile gives the sums of its pairs at once. Light terms are postings: with z the share of an absent term,

  f(p, q) = f(zp, zq) + [f(p, zq) - f(zp, zq)] + [f(zp, q) - f(zp, zq)] + [f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)]

and only the last bracket needs both sources: it is made for the pairs of a light term's postings, LIGHT at most. The
first is the number of light terms times a number; the second and third depend on a source's share alone, so they come
from the source's distribution of shares (share, number of terms). The parts are added as whole numbers.

No row, task or driver holds more than a tile, a band's distributions or a term's light postings, however many sources
there are; a source that has a third of all rows is counted in blocks and then has one row a term. Defined cases: null
text, language and source are ''; a group without kept terms has N = 0; a language that keeps no term gives 0 for each
pair and no term rows; ties of a value are ranked by the item's UTF-8 bytes; repeated rows count as documents of their
own, and so in LEAST; very long texts are blocks of their own; other columns of docs are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import periodic_runs
from .runtime import cut, maybe_broadcast

#: Documents of a language in which a kept term occurs; the unit of shares; terms listed for a group.
LEAST, UNIT, LISTED = 3, 1_000_000_000, 200
#: Terms of more groups are heavy. Terms of a tile, sources of a band.
LIGHT, TILE, BAND = 8, 2048, 256
#: Bytes of a block's texts.
BLOCK = 8 << 20
# Separators are all ASCII bytes but letters; lower case is that of A-Z alone.
_APART = np.zeros(256, bool)
_APART[:128] = True
_APART[[*range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _group() -> Column:
    """A language and a source as one text; the length keeps ('a', 'bc') and ('ab', 'c') apart."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    return F.concat_ws(":", F.char_length(lang).cast("string"), F.concat(lang, source))


def groups(docs: DataFrame) -> DataFrame:
    """(_group, lang, source, gid): every group; gid numbers those of a language from 0, by source."""
    named = docs.select(_group().alias("_group"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    return named.withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def counted(docs: DataFrame) -> DataFrame:
    """(_group, term, n, docs): occurrences of a term in a group, and documents of the group that have it."""

    def run(batches):
        for b in B.read_blocks(batches, BLOCK):
            b.data[:] = _LOWER[b.data]
            told, row = periodic_runs.words(b, _APART)
            if not len(told):
                continue
            coded, group = told.dictionary_encode(), b.ids.dictionary_encode()
            width, code, of_row = len(coded.dictionary), coded.indices.to_numpy(), group.indices.to_numpy().astype(np.int64)
            keys, n = np.unique(of_row[row] * width + code, return_counts=True)
            pairs = np.unique(row * width + code)  # of a document and a term
            pairs = np.sort(of_row[pairs // width] * width + pairs % width)
            had = np.searchsorted(pairs, keys, "right") - np.searchsorted(pairs, keys)
            columns = [group.dictionary.take(pa.array(keys // width)), coded.dictionary.take(pa.array(keys % width)).cast(pa.binary()), pa.array(n, pa.int64()), pa.array(had, pa.int64())]
            for at in range(0, len(keys), 1 << 16):
                yield pa.record_batch([c.slice(at, 1 << 16) for c in columns], names=["_group", "term", "n", "docs"])

    parts = B.scan(docs.select(_group().alias("doc_id"), "text")).mapInArrow(run, "_group string, term binary, n long, docs long")
    return parts.groupBy("_group", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, named: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, postings): the kept terms, postings being (gid, n) of the groups that have them, as many as the language's sources at most."""
    placed = counted(docs).join(maybe_broadcast(named.select("_group", "lang", "gid")), "_group")
    terms = placed.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("total"), F.collect_list(F.struct("gid", "n")).alias("postings"))
    return terms.filter(F.col("_docs") >= least).drop("_docs")


def sized(named: DataFrame, kept: DataFrame) -> DataFrame:
    """named with all (N + V of the group), lang_all (of the language) and terms (V)."""
    own = kept.select("lang", F.explode("postings").alias("_p")).groupBy("lang", F.col("_p.gid").alias("gid")).agg(F.sum("_p.n").alias("_n"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("_v"), F.sum("total").alias("_t"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    found = named.join(own, ["lang", "gid"], "left").join(whole, "lang", "left")
    return found.select(*named.columns, (zero("_n") + zero("_v")).alias("all"), (zero("_t") + zero("_v")).alias("lang_all"), zero("_v").alias("terms"))


def _shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """p of n occurrences in groups of N + V = of; Python's whole numbers where 64 bits are too few."""
    if len(n) and int(n.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (int(a) + 1) // int(b) for a, b in zip(n, of, strict=True)], np.int64)
    return 1 + UNIT * (n + 1) // of


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tile_sums(lo: np.ndarray, hi: np.ndarray, term: np.ndarray, side: np.ndarray, at: np.ndarray, n: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Sums over the terms of a tile of the divergence of each source of lo (rows) from each of hi (columns).

    lo, hi: N + V of the sources. A posting has its term (index of heavy), side (0: lo, 1: hi), place there and n.
    """
    bands = (lo, hi)
    zero = [_shares(np.zeros(len(b), np.int64), b) for b in bands]
    base = _apart(zero[0][:, None], zero[1][None, :])
    out = base * int((~heavy).sum())
    p = np.zeros(len(n), np.int64)
    for s in (0, 1):
        p[side == s] = _shares(n[side == s], bands[s][at[side == s]])
    # heavy terms: a dense tile a side
    number = np.cumsum(heavy) - 1
    dense = []
    for s in (0, 1):
        of = heavy[term] & (side == s)
        tile = np.repeat(zero[s][None, :], int(heavy.sum()), 0)
        tile[number[term[of]], at[of]] = p[of]
        dense.append(tile)
    if heavy.any():
        for i in range(len(lo)):
            out[i] += _apart(dense[0][:, i : i + 1], dense[1]).sum(0)
    # light terms: what a posting changes against all sources of the other side, by its distribution of shares
    light = ~heavy[term]
    for s in (0, 1):
        (where, value), many = np.unique(np.stack([at[light & (side == s)], p[light & (side == s)]]), axis=1, return_counts=True)
        for part in range(0, len(where), 4096):
            w, v, m = where[part : part + 4096], value[part : part + 4096, None], many[part : part + 4096, None]
            if s == 0:
                np.add.at(out, w, m * (_apart(v, zero[1][None, :]) - base[w]))
            else:
                np.add.at(out.T, w, m * (_apart(zero[0][None, :], v) - base[:, w].T))
    # and what two postings of a term change beyond that
    first, second = np.flatnonzero(light & (side == 0)), np.flatnonzero(light & (side == 1))
    first, second = first[np.argsort(term[first], kind="stable")], second[np.argsort(term[second], kind="stable")]
    begin, many = np.searchsorted(term[second], term[first]), np.searchsorted(term[second], term[first], "right") - np.searchsorted(term[second], term[first])
    a = np.repeat(first, many)
    b = second[np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(first) else np.zeros(0, np.int64)
    za, zb = zero[0][at[a]], zero[1][at[b]]
    np.add.at(out, (at[a], at[b]), _apart(p[a], p[b]) - _apart(p[a], zb) - _apart(za, p[b]) + _apart(za, zb))
    return out


def pair_sums(totals: DataFrame, kept: DataFrame, light: int = LIGHT, tile: int = TILE, band: int = BAND) -> DataFrame:
    """(lang, a, b, value): for each two groups of a language, by gid, the sum of the divergences of a from b."""
    tiles = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / tile))
    bands = F.floor(F.col("_last") / band).cast("int")
    langs = maybe_broadcast(totals.groupBy("lang").agg(F.max("gid").alias("_last"), F.max("terms").alias("terms")).select("lang", tiles.alias("_tiles"), bands.alias("_bands")))
    both = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("_bands")), lambda i: F.transform(F.sequence(i, F.col("_bands")), lambda j: F.named_struct(F.lit("lo"), i, F.lit("hi"), j))))).alias("_b")
    of = lambda gid: F.floor(gid / band).cast("int")
    terms = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("_tiles")).alias("tile"), (F.size("postings") > light).alias("heavy"), "postings", both)
    terms = terms.select("lang", "tile", "_b.lo", "_b.hi", "heavy", F.filter("postings", lambda x: (of(x["gid"]) == F.col("_b.lo")) | (of(x["gid"]) == F.col("_b.hi"))).alias("postings"), F.lit(None).cast("int").alias("gid"), F.lit(None).cast("long").alias("all"))
    sources = totals.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias("tile"), "gid", "all", both).filter((of(F.col("gid")) == F.col("_b.lo")) | (of(F.col("gid")) == F.col("_b.hi")))
    sources = sources.select("lang", "tile", "_b.lo", "_b.hi", F.lit(None).cast("boolean").alias("heavy"), F.lit(None).cast("array<struct<gid:int,n:bigint>>").alias("postings"), "gid", "all")

    def run(rows: pa.Table) -> pa.Table:
        lang, low, high = rows["lang"][0], rows["lo"][0].as_py(), rows["hi"][0].as_py()
        is_term = pc.is_valid(rows["heavy"])
        listed, told = rows.filter(is_term), rows.filter(pc.invert(is_term))
        gid, size = told["gid"].to_numpy(), np.maximum(told["all"].to_numpy(), 1)
        order = np.argsort(gid)
        gid, size = gid[order], size[order]
        postings = listed["postings"].combine_chunks()
        flat = postings.flatten()
        term = pc.list_parent_indices(postings).to_numpy().astype(np.int64)
        own, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gid", "n"))
        heavy = listed["heavy"].to_numpy().astype(bool)
        side_of = [np.flatnonzero(gid // band == x) for x in (low, high)]
        found = []
        for first, second in ((0, 1),) if low == high else ((0, 1), (1, 0)):
            number = (low, high)
            here, there = own // band == number[first], own // band == number[second]
            chosen = np.concatenate([np.flatnonzero(here), np.flatnonzero(there)])
            side = np.repeat([0, 1], [here.sum(), there.sum()])
            at = own[chosen] - np.where(side == 0, number[first], number[second]) * band
            sums = tile_sums(size[side_of[first]], size[side_of[second]], term[chosen], side, at, n[chosen], heavy)
            a, b = (x.ravel() for x in np.meshgrid(gid[side_of[first]], gid[side_of[second]], indexing="ij"))
            apart = a != b
            found.append(pa.table([pa.array([lang.as_py()] * int(apart.sum()), pa.string()), pa.array(a[apart], pa.int32()), pa.array(b[apart], pa.int32()), pa.array(sums.ravel()[apart])], names=["lang", "a", "b", "value"]))
        return pa.concat_tables(found)

    parts = terms.unionByName(sources).groupBy("lang", "tile", "lo", "hi").applyInArrow(run, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def share(n: str, of: str) -> str:
    """p of n occurrences, in SQL; decimals hold the product at any size."""
    return f"1L + (CAST({UNIT} AS DECIMAL(10, 0)) * (CAST({n} AS DECIMAL(20, 0)) + 1)) div CAST({of} AS DECIMAL(20, 0))"


def audit(docs: DataFrame, least: int = LEAST, listed: int = LISTED, light: int = LIGHT, tile: int = TILE, band: int = BAND) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source).

    Part `pair`: for each source of a language, every other one as item, by the sum of divergences from it. Part `term`:
    the `listed` terms by which the source goes beyond its language most.
    """
    text = docs.select("lang", "source", "text")
    named = cut(groups(text), "divergence-groups")
    kept = cut(kept_terms(text, named, least), "divergence-terms")
    totals = cut(sized(named, kept), "divergence-sizes")
    ranked = lambda f: f.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    names = lambda c, s: maybe_broadcast(totals.select("lang", F.col("gid").alias(c), F.col("source").alias(s)))
    pairs = pair_sums(totals, kept, light, tile, band).join(names("a", "source"), ["lang", "a"]).join(names("b", "item"), ["lang", "b"])
    own = kept.select("lang", F.col("term").cast("string").alias("item"), "total", F.explode("postings").alias("_p")).select("lang", "item", "total", "_p.gid", "_p.n")
    shares = own.join(maybe_broadcast(totals.select("lang", "gid", "source", "all", "lang_all")), ["lang", "gid"]).select("lang", "source", "item", F.expr(share("n", "all")).alias("_p"), F.expr(share("total", "lang_all")).alias("_q"))
    terms = shares.filter("_p > _q").select("lang", "source", "item", F.expr("(_p - _q) * (_p - _q) div _q").alias("value"))
    columns = lambda f, part: f.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(ranked(pairs), "pair").unionByName(columns(ranked(terms).filter(F.col("rank") <= listed), "term"))
