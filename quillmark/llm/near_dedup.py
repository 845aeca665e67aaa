"""Near duplicates by ProbMinHash (Ertl 2020) over word shingles weighted by their counts.

A text is its runs of SHINGLE words (texts with fewer words: all of them). Every distinct shingle x of weight w
sends the points of a Poisson process of rate w, each to a random one of M components; a component keeps the shingle
of its first point. A shingle stops once its next point comes after the last component's first. Two signatures agree
in a component with the texts' probability Jaccard similarity. BANDS bands of the signature propose pairs, and a
pair is a link if its distinct shingles have a Jaccard similarity of at least SIMILAR. Where a passage is repeated, the
two measures part; a text with repeated shingles therefore has BANDS more bands, of a signature with weight 1, which
agrees with the Jaccard similarity of distinct shingles. For other texts both signatures are the same.

Exact copies are one text from the start. In a band's group no pair list is made: the group's members are compared
with one member drawn at random for the band, links are contracted to classes (large star, small star), members
that are still in other classes than that member are compared with another one, and what then is left of a group in
several classes is compared in full, in blocks where it is large. So a large group of alike texts costs a row a
member, no list of its pairs is made, and no pair of different classes is skipped.

Defined cases: null and wordless texts are alone in their class; a null doc_id is a document like any other and
never names a class that has another; repeated rows get equal classes; a pair of similarity 0.8 exactly is a link; very
long texts are compared whole, as all their shingles; keep_one() carries all other columns, whatever their names (but
_gone and _text), and keeps each row of a repeated document that names its class; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import lm_score
from .runtime import cut, maybe_broadcast

SHINGLE, SIMILAR = 5, 0.8
BANDS, DEPTH = 20, 5
M = BANDS * DEPTH
STARS = 2
#: Rows of signatures at a time, and bytes of pairs of texts.
ROWS, PAIR_BYTES = 20_000, 4 << 20
#: Groups of up to PAIRS open texts are compared as pairs, larger ones in blocks of BLOCK texts.
PAIRS, BLOCK = 16, 256
_S = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(b: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each row's distinct shingles, by row and hash."""
    b = B.Block(b.no, b.ids, _LOWER[b.data], b.offsets)
    h, row = lm_score.words(b)
    n = np.bincount(row, minlength=len(b.offsets) - 1)
    first = np.cumsum(n) - n
    length = np.minimum(n, SHINGLE)
    begins = np.flatnonzero(np.arange(len(h)) - first[row] <= (n - length)[row])
    x = length[row[begins]].astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < length[row[begins]]
        x[inside] = B.mix(x[inside] * np.uint64(_S) + h[begins[inside] + k])
    of = row[begins]
    order = np.lexsort((x, of))
    of, x = of[order], x[order]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (x[1:] != x[:-1])])) if len(of) else np.zeros(0, int)
    return of[new], x[new], np.diff(np.append(new, len(of)))


def signatures(row: np.ndarray, x: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """M components for each row: hashes of shingles. row is sorted; ROWS rows at a time bound the memory."""
    if rows > ROWS:
        at = np.searchsorted(row, np.arange(0, rows + ROWS, ROWS))
        return np.concatenate([signatures(row[i:j] - k * ROWS, x[i:j], weight[i:j], min(ROWS, rows - k * ROWS)) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True))])
    first = np.full(rows * M, np.inf)
    held = np.zeros(rows * M, np.uint64)
    alive, at, turn = np.arange(len(x)), np.zeros(len(x)), 0
    while len(alive):
        turn += 1
        u = B.mix(x[alive] + np.uint64(turn * _S % (1 << 64)))
        at = at - np.log(((u >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[alive]
        slot = row[alive] * M + (B.mix(u ^ np.uint64(_S)) % np.uint64(M)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        held[slot[won]] = x[alive[won]]
        last = first.reshape(rows, M).max(1)
        going = at < last[row[alive]]
        alive, at = alive[going], at[going]
    return held.reshape(rows, M)


def _bands(sig: np.ndarray) -> np.ndarray:
    """BANDS keys of each signature."""
    band = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for k in range(DEPTH):
        band = B.mix(band * np.uint64(_S) + sig[:, k::DEPTH])
    return band


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, text key (null for wordless texts), number of distinct shingles and distinct band keys of each row of docs(doc_id, text)."""

    def run(batches):
        for b in B.read_blocks(batches):
            row, x, weight = shingles(b)
            sig = signatures(row, x, weight, len(b.ids))
            n = np.bincount(row, minlength=len(b.ids))
            uneven = np.flatnonzero(np.bincount(row, weight > 1, len(b.ids)))
            again = np.isin(row, uneven)
            plain = signatures(np.searchsorted(uneven, row[again]), x[again], np.ones(again.sum(), int), len(uneven))
            of = np.repeat(np.concatenate([np.arange(len(b.ids)), uneven]), BANDS)
            band = np.concatenate([_bands(sig), _bands(plain)]).ravel()
            order = np.lexsort((band, of))
            of, band = of[order], band[order]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (band[1:] != band[:-1])])
            of, band = of[new], band[new]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(b.ids)))]).astype(np.int32)
            raw = b.data.tobytes()
            keys = [hashlib.sha1(raw[i:j]).digest()[:16] if k else None for i, j, k in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), n.tolist(), strict=True)]
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band.view(np.int64)))
            yield pa.record_batch([b.ids, pa.array(keys, pa.binary()), pa.array(n, pa.int64()), bands], names=["doc_id", "t", "n", "bands"])

    return B.scan(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, t binary, n long, bands array<long>")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts(t, body) are similar."""

    def similar(a: list[bytes], b: list[bytes]) -> np.ndarray:
        (ra, xa, _), (rb, xb, _) = (shingles(B._block(0, [pa.nulls(len(side))], [pa.array(side, pa.large_binary())])) for side in (a, b))
        key = lambda r, x: B.mix(x + B.mix(r.astype(np.uint64) * np.uint64(_S)))
        _, i, _ = np.intersect1d(key(ra, xa), key(rb, xb), assume_unique=True, return_indices=True)
        both = np.bincount(ra[i], minlength=len(a))
        return both >= SIMILAR * (np.bincount(ra, minlength=len(a)) + np.bincount(rb, minlength=len(a)) - both) - 1e-9

    def run(batches):
        for batch in batches:
            ok, sides, size = [], ([], []), 0
            for x, y in zip(batch.column(2), batch.column(3), strict=True):  # a bounded number of bytes at a time
                for side, blob in zip(sides, (x, y), strict=True):
                    side.append(B.spread(blob.as_py()))
                    size += len(side[-1])
                if size >= PAIR_BYTES:
                    ok.append(similar(*sides))
                    sides, size = ([], []), 0
            if sides[0]:
                ok.append(similar(*sides))
            good = pa.array(np.concatenate(ok)) if ok else pa.array([], pa.bool_())
            yield pa.record_batch([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    few = maybe_broadcast(cut(pairs, "near-pairs"))
    own = texts.withColumnsRenamed({"t": "b", "body": "_b"}).join(few, "b")
    both = own.join(texts.withColumnsRenamed({"t": "a", "body": "_a"}), "a")
    return cut(both.select("a", "b", "_a", "_b").mapInArrow(run, "a binary, b binary"), "near-links")


def linked_blocks(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) inside large groups, from rows(band, t, root, _size, _main, _rest).

    What lies outside a group's largest class, in blocks of BLOCK texts, against the whole group in such blocks: a row
    holds two blocks, and their similarities are a product of two matrices of shingles. All pairs of different classes
    are compared and none is written; each text gives one link to each other class.
    """
    piece = lambda size: F.pmod(F.xxhash64("t"), F.ceil(F.col(size) / BLOCK))
    whole = rows.join(texts, "t")
    packed = lambda f, size, names: f.groupBy("band", piece(size).alias("_piece")).agg(F.collect_list(F.struct("t", "root", "body")).alias("_x")).select("band", *(F.col(f"_x.{n}").alias(f"{n}{names}") for n in ("t", "root", "body")))
    outside, inside = packed(whole.filter(F.col("root") != F.col("_main")), "_rest", "1"), packed(whole, "_size", "2")

    def run(batches):
        for batch in batches:
            out: tuple[list[bytes], list[bytes]] = ([], [])
            for t1, r1, x1, t2, r2, x2 in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                similar = _similar_block([B.spread(x) for x in x1], [B.spread(x) for x in x2])
                seen = set()
                for i, j in zip(*np.nonzero(similar), strict=True):
                    if r1[i] != r2[j] and (t1[i], r2[j]) not in seen:
                        seen.add((t1[i], r2[j]))
                        out[0].append(min(t1[i], t2[j]))
                        out[1].append(max(t1[i], t2[j]))
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["a", "b"])

    both = outside.join(inside, "band").select("t1", "root1", "body1", "t2", "root2", "body2")
    return cut(both.mapInArrow(run, "a binary, b binary").distinct(), "near-links")


def _similar_block(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether each text of a is similar to each of b."""
    (ra, xa, _), (rb, xb, _) = (shingles(B._block(0, [pa.nulls(len(side))], [pa.array(side, pa.large_binary())])) for side in (a, b))
    na, nb = np.bincount(ra, minlength=len(a)), np.bincount(rb, minlength=len(b))
    common = np.intersect1d(xa, xb)
    both = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(common), 8192):  # columns of the matrices
        words = common[at : at + 8192]
        sides = []
        for r, x, n in ((ra, xa, len(a)), (rb, xb, len(b))):
            c = np.minimum(np.searchsorted(words, x), len(words) - 1)
            hit = words[c] == x
            m = np.zeros((n, len(words)), np.float32)
            m[r[hit], c[hit]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    return both >= SIMILAR * (na[:, None] + nb[None, :] - both) - 1e-6


def components(links: DataFrame) -> DataFrame:
    """(t, root) of every node of the links (a, b), root the least node of its component; by alternating large and small stars."""
    now, seen = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-stars"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen:
            return now.select(F.col("u").alias("t"), F.col("v").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.greatest("v", "_m").alias("u"), F.least("v", "_m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").filter("u <> v").distinct(), "near-stars")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text key and class_id (the least doc_id of the class) of each row of docs(doc_id, text)."""
    signed = cut(sign(docs.select("doc_id", "text")), "near-signatures")
    distinct = cut(signed.filter("t IS NOT NULL").groupBy("t").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-texts")
    exploded = distinct.select("t", "n", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("_size")).filter("_size > 1").select("band")
    members = cut(exploded.join(shared, "band"), "near-members")
    wanted = maybe_broadcast(cut(members.select("t").distinct().join(distinct.select("t", "rep"), "t"), "near-wanted"))

    def shrink(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([B.squeeze(x or b"", 3) for x in batch.column(1).to_pylist()], pa.binary())], names=["t", "body"])

    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("t", F.unhex(F.substring(F.sha1("text"), 1, 32)))
    alike = (keyed["t"] == wanted["t"]) & keyed["doc_id"].eqNullSafe(wanted["rep"])
    texts = cut(keyed.join(wanted, alike).select(keyed["t"], "text").mapInArrow(shrink, "t binary, body binary").dropDuplicates(["t"]), "near-bodies")

    links, roots, tried, near = None, None, None, F.least("n", "_n") >= SIMILAR * F.greatest("n", "_n")
    for star in range(STARS):
        at = members.withColumn("root", F.col("t")) if roots is None else members.join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))
        order = F.struct(F.xxhash64("t", "band", F.lit(star)).alias("_h"), F.col("t").alias("_t"), F.col("n").alias("_n"), F.col("root").alias("_root"))
        centre = at.groupBy("band").agg(F.min(order).alias("_c"), F.min("root").alias("_r0"), F.max("root").alias("_r1")).filter("_r0 <> _r1").select("band", "_c._t", "_c._n", "_c._root")
        centre = cut(centre, "near-centres")
        pairs = at.join(centre, "band").filter((F.col("root") != F.col("_root")) & near)
        new = linked(pairs.select(F.least("t", "_t").alias("a"), F.greatest("t", "_t").alias("b")).distinct(), texts)
        links = new if links is None else links.unionByName(new)
        tried = centre if tried is None else tried.unionByName(centre)
        roots = components(links)
    done = tried.select("band", F.col("_t").alias("t")).distinct()  # compared with all members of their groups
    at = cut(members.join(roots, "t", "left").withColumn("root", F.coalesce("root", "t")).join(done, ["band", "t"], "left_anti"), "near-roots")
    counts = at.groupBy("band", "root").agg(F.count("*").alias("_n"))
    several = counts.groupBy("band").agg(F.sum("_n").alias("_size"), F.max(F.struct("_n", "root")).alias("_main"), F.count("*").alias("_roots")).filter("_roots > 1")
    open_rows = cut(at.join(several.select("band", "_size", F.col("_main.root").alias("_main"), (F.col("_size") - F.col("_main._n")).alias("_rest")), "band"), "near-open")
    few = open_rows.filter(F.col("_size") <= PAIRS)
    other = few.select("band", F.col("t").alias("_t"), F.col("n").alias("_n"), F.col("root").alias("_root"))
    apart = (F.col("t") < F.col("_t")) & (F.col("root") != F.col("_root")) & near
    rest = few.select("band", "t", "n", "root").join(other, "band").filter(apart).select(F.col("t").alias("a"), F.col("_t").alias("b")).distinct()
    roots = components(links.unionByName(linked(rest, texts)).unionByName(linked_blocks(open_rows.filter(F.col("_size") > PAIRS), texts)))

    grouped = distinct.select("t", "rep", "copies").join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))
    named = grouped.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size")).filter("class_size > 1")
    named = maybe_broadcast(cut(grouped.join(named, "root").select("t", "class_id", "class_size"), "near-classes"))
    return signed.select("doc_id", "t").join(named, "t", "left").select("doc_id", F.hex("t").alias("text_key"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that name their class."""
    gone = classes(docs).filter("NOT (doc_id <=> class_id)").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_text")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_gone")) & (F.upper(F.substring(F.sha1(docs["text"].cast("binary")), 1, 32)) == F.col("_text"))
    return docs.join(maybe_broadcast(cut(gone, "near-gone")), same, "left_anti")
