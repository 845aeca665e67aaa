"""Exact-substring dedup over suffixes sorted in blocks with a difference cover (Burkhardt & Kaerkkaeinen 2003; Kaerkkaeinen 2007).

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller doc_id.

1. Buckets. The least hash of the K-byte grams inside a SPAN-byte window (its minimiser) is the window's bucket key:
   equal windows have equal keys at equal places. Blocks of texts ask hash shards which keys occur in more than one
   document; all other windows are done.
2. Segments. Neighbouring windows with one minimiser travel as one string, once for each block with the least
   doc_id that has it there, so a passage in a third of all documents meets in a shard once a block.
3. Sorting. A shard takes one group of suffix buckets at a time, bounded in bytes. Ranks of the suffixes that start
   at the positions of a difference cover modulo PERIOD are computed first; then all suffixes are sorted by their
   first PERIOD bytes, and longer ties by the precomputed ranks at the offset where both suffixes meet the cover.
   Neighbours that share SPAN bytes form a group, whose least doc_id is the answer for each window in it.
4. The answers go back to the blocks, which mark bytes, cut and hash.

Defined cases: a null text is empty; texts under SPAN bytes are kept whole; rows with one doc_id don't remove each
other; a null doc_id counts as larger than any; very long texts are blocks of their own and their matches are found
whole; remove_repeats() carries all other columns, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .runtime import cut, shards_for

SPAN, K = 50, 24
#: A perfect difference set: every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of segments that a shard sorts at a time.
BUCKET_BYTES = 1 << 20
#: Runs of windows that a block marks at a time.
RUNS = 50_000
_CHUNK = 1 << 14
LAST = np.iinfo(np.int64).max
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

#: delta of two residues: how far both are from members of the cover.
_DELTA = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])


def minimisers(b: B.Block, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: first window, number of windows, place of the minimiser, its 64-bit hash."""
    n, grams = b.size - span + 1, span - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    eight = np.ndarray((b.size + 56,), "<u8", b.data.data, strides=(1,))
    at = np.empty(n, np.int64)
    for begin in range(0, n, _CHUNK):  # pieces that stay in a processor's cache
        m = min(_CHUNK, n - begin)
        h = _gram_hash(eight[begin : begin + m + grams - 1], eight[begin + 8 : begin + 8 + m + grams - 1], eight[begin + 16 : begin + 16 + m + grams - 1])
        h &= np.uint64(0xFFFFFFFF00000000)
        h |= np.arange(m + grams - 1, dtype=np.uint64)
        width = 1
        while width * 2 <= grams:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < grams:
            h = np.minimum(h[:m], h[grams - width : grams - width + m])
        at[begin : begin + m] = (h & np.uint64(0xFFFFFFFF)).astype(np.int64) + begin
    steps = np.zeros(b.size + 1, np.int8)
    starts, ends = b.offsets[:-1], b.offsets[1:] - span + 1
    long = ends > starts
    starts, ends = starts[long], ends[long]
    steps[starts] = 1
    steps[ends] -= 1  # where the next text begins at once, nothing changes
    inside = np.cumsum(steps[:n], dtype=np.int8) > 0
    stop = np.empty(n, bool)
    stop[0] = True
    stop[1:] = at[1:] != at[:-1]
    stop[starts] = True
    stop[ends[ends < n]] = True
    cut_at = np.flatnonzero(stop)
    count = np.diff(np.append(cut_at, n))
    good = inside[cut_at]
    first, count = cut_at[good], count[good]
    place = at[first]
    return first, count, place, B.mix(_gram_hash(eight[place], eight[place + 8], eight[place + 16]))


def _gram_hash(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Of K = 24 bytes, in three words."""
    h = (x * _A) ^ (y * _B)
    h ^= h >> np.uint64(29)
    h += z * _C
    h ^= h >> np.uint64(32)
    h *= _A
    return h


def _doc_ids(b: B.Block) -> np.ndarray:
    ids = b.ids.field("doc_id") if pa.types.is_struct(b.ids.type) else b.ids
    return ids.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _ask(docs: DataFrame, n_shards: int) -> DataFrame:
    def run(batches):
        for b in B.read_blocks(batches):
            first, _, _, key = minimisers(b)
            row = np.searchsorted(b.offsets, first, "right") - 1
            placed = B.place(key, n_shards)
            order = np.argsort(placed, kind="stable")
            placed, row = placed[order], row[order]
            new = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]])) if len(placed) else np.zeros(0, int)
            last = np.append(new[1:], len(placed)) - 1
            many = row[new] != row[last] if len(new) else np.zeros(0, bool)
            yield B.questions(b, placed[new], n_shards, lambda i, j, many=many: np.packbits(many[i:j]).tobytes())

    return B.scan(docs).mapInArrow(run, B.QUESTION_DDL)


def _shared_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which keys are in more than one document, as bits in each block's order."""
    keys = [B.unpack_keys(x) for x in pdf["keys"]]
    at = np.cumsum([0, *map(len, keys)])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(pdf["extra"], keys, strict=True)]).astype(bool)
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    begin = np.flatnonzero(new)
    told = np.logical_or.reduceat(many[order], begin) | (np.diff(np.append(begin, len(keys))) > 1)
    many[order] = told[np.cumsum(new) - 1]
    return pd.DataFrame({"block": pdf["block"].values, "shard": pdf["shard"].values, "keys": [b""] * len(pdf), "extra": [np.packbits(many[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]})


def content_hash(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start : start + size]; data ends in 8 spare bytes."""
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    h = sizes.astype(np.uint64) * _A
    for at in range(0, int(sizes.max(initial=0)), 8):
        live = slice(None) if at + 8 <= sizes.min() else np.flatnonzero(sizes > at)
        have = np.minimum(sizes[live] - at, 8).astype(np.uint64)
        x = (h[live] ^ eight[starts[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - have * np.uint64(8)))) * _B
        h[live] = x ^ (x >> np.uint64(31))
    return B.mix(h)


def distinct(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments with one key and one hash are one: an order by key and hash, where each distinct one begins in it, and the number of each segment's."""
    order = np.lexsort((hashes, keys))
    k, h = keys[order], hashes[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]) if len(order) else np.zeros(0, bool)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), which


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces data[start : start + size], one after the other."""
    return data[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]


def _candidates(b: B.Block, answers: pd.DataFrame, n_shards: int) -> dict[str, np.ndarray]:
    """The block's segments in shared buckets: of each run its first window, number of windows, owner and distinct segment; of each distinct segment (d_...), by shard and key, its place and least owner."""
    first, count, place, key = minimisers(b)
    keys, inverse = np.unique(B.place(key, n_shards), return_inverse=True)
    at = B.cuts(keys, n_shards)
    wide = np.zeros(len(keys), bool)
    answered = 0
    for s, bits in zip(answers["shard"], answers["extra"], strict=True):
        wide[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[s + 1] - at[s])
        answered += at[s + 1] - at[s]
    if answered != len(keys):
        raise RuntimeError(f"block {b.no} isn't the block that asked: {len(keys)} keys, {answered} answers")
    take = wide[inverse]
    first, count, anchor, placed = first[take], count[take], (place - first)[take], keys[inverse[take]]
    ids = _doc_ids(b)[np.searchsorted(b.offsets, first, "right") - 1]
    sizes = count + SPAN - 1
    order, begin, which = distinct(placed, content_hash(b.data, first, sizes) ^ anchor.astype(np.uint64))
    of = order[begin]
    least = np.minimum.reduceat(ids[order], begin) if len(begin) else ids
    return {"first": first, "count": count, "ids": ids, "which": which, "d_placed": placed[of], "d_first": first[of], "d_size": sizes[of], "d_anchor": anchor[of].astype(np.uint8), "d_least": least}


def _block_of(pdf: pd.DataFrame) -> tuple[B.Block, pd.DataFrame]:
    body = pdf["shard"].values == -1
    return B.unpack(int(pdf["block"].iloc[0]), pdf["keys"][body].iloc[0]), pdf[~body]


def _segments(n_shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, answers = _block_of(pdf)
        c = _candidates(b, answers, n_shards)
        at = B.cuts(c["d_placed"], n_shards)
        rows = []
        for s in np.flatnonzero(np.diff(at)).tolist():
            i, j = at[s], at[s + 1]
            text = gather(b.data, c["d_first"][i:j], c["d_size"][i:j])
            rows.append((b.no, s, B.pack_keys(c["d_placed"][i:j], n_shards), B.squeeze(c["d_size"][i:j].astype(np.uint8).tobytes() + c["d_anchor"][i:j].tobytes() + c["d_least"][i:j].tobytes() + text.tobytes(), 3)))
        return pd.DataFrame(rows, columns=["block", "shard", "keys", "extra"])

    return run


def sample_ranks(text: np.ndarray, position: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Dense ranks of the strings of `left` bytes at each position (an end sorts before any byte)."""
    rank = np.zeros(len(position), np.int64)
    for at in range(0, int(left.max(initial=0)), 7):  # seven bytes and their number to a word
        word = _word(text, position + at, left - at)
        order = np.lexsort((word, rank))
        r, w = rank[order], word[order]
        fresh = np.concatenate([[0], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
        rank[order] = np.cumsum(fresh)
    return rank


def _word(text: np.ndarray, position: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to seven bytes, big-endian, then how many they are."""
    have = np.clip(left, 0, 7)
    eight = np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))
    w = eight[np.minimum(position, len(text) - 8)].astype(np.uint64)
    keep = have.astype(np.uint64) * np.uint64(8)
    return np.where(have > 0, w >> (np.uint64(64) - np.maximum(keep, np.uint64(8))) << (np.uint64(64) - np.maximum(keep, np.uint64(8))), np.uint64(0)) | have.astype(np.uint64)


def sort_suffixes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the first windows[i] suffixes of each segment i of text, to the segment's end.

    Returns the sorted positions, what is left of each segment there, and the segment. text ends in 8 spare bytes.
    """
    seg = np.repeat(np.arange(len(starts)), windows)
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    position, left = starts[seg] + inner, sizes[seg] - inner
    residue = position % PERIOD
    # ranks of the cover sample
    whole = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spot = starts[whole] + place
    sampled = np.isin(spot % PERIOD, COVER)
    ranks = np.full(len(text) + PERIOD, -1)
    ranks[spot[sampled]] = sample_ranks(text, spot[sampled], (sizes[whole] - place)[sampled])
    # the first PERIOD bytes
    words = [_word(text, position + at, np.minimum(left, PERIOD) - at) for at in range(0, PERIOD, 7)]
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for w in words:
        w = w[order]
        new[1:] |= w[1:] != w[:-1]
    group = np.cumsum(new) - 1
    # ties: of one residue by the rank at its own offset; of several, by counting the smaller ones of each other residue
    r = residue[order]
    low, high = np.minimum.reduceat(r, np.flatnonzero(new)), np.maximum.reduceat(r, np.flatnonzero(new))
    own = ranks[position[order] + _DELTA[r, r]]
    mixed = (low != high)[group]
    less = np.where(mixed, 0, own)
    if mixed.any():
        m = np.flatnonzero(mixed)
        for i in np.unique(r[m]):
            mine = m[r[m] == i]
            for j in np.unique(r[m]):
                other = m[r[m] == j]
                d = _DELTA[i, j]
                key = lambda x, d=d: group[x] * (len(ranks) + 1) + ranks[position[order[x]] + d] + 1
                theirs = np.sort(key(other))
                less[mine] += np.searchsorted(theirs, key(mine)) - np.searchsorted(theirs, group[mine] * (len(ranks) + 1))
    order = order[np.lexsort((less, group))]
    return position[order], left[order], seg[order]


def least_owner(flat: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, least: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each window of each segment (they follow each other in flat), the least owner of an equal window in any segment.

    Segments are laid out with their anchors (minimisers) on multiples of PERIOD, so equal windows have one residue.
    """
    room = (sizes + 2 * PERIOD) // PERIOD * PERIOD + PERIOD
    starts = np.cumsum(room) - room + (PERIOD - anchors.astype(np.int64) % PERIOD) % PERIOD
    text = np.zeros(int(room.sum()) + 64, np.uint8)
    text[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(len(flat))] = flat
    windows = sizes - span + 1
    position, left, seg = sort_suffixes(text, starts, sizes, windows)
    equal = np.ones(max(len(position) - 1, 0), bool)
    for at in range(0, span, 7):
        w = _word(text, position + at, np.minimum(left, span) - at)
        equal &= w[1:] == w[:-1]
    begin = np.flatnonzero(np.concatenate([[True], ~equal]))
    best = np.minimum.reduceat(least[seg], begin)
    out = np.empty(len(position), np.int64)
    base = np.cumsum(windows) - windows
    out[base[seg] + position - starts[seg]] = best[np.cumsum(np.concatenate([[0], ~equal]))]
    return out


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, the least doc_id of every window that it asked about.

    A bucket with one distinct segment is sorted as it stands; the others are sorted a bounded group at a time.
    """
    keys, sizes, anchors, least, flat = [], [], [], [], []
    for k, x in zip(pdf["keys"], pdf["extra"], strict=True):
        key, raw = B.unpack_keys(k), B.spread(x)
        n = len(key)
        keys.append(key)
        sizes.append(np.frombuffer(raw, np.uint8, n).astype(np.int64))
        anchors.append(np.frombuffer(raw, np.uint8, n, n))
        least.append(np.frombuffer(raw, np.int64, n, 2 * n))
        flat.append(np.frombuffer(raw, np.uint8, -1, 10 * n))
    each = np.cumsum([0, *map(len, keys)])
    keys, sizes, anchors, least, flat = map(np.concatenate, (keys, sizes, anchors, least, [*flat, np.zeros(64, np.uint8)]))
    starts = np.cumsum(sizes) - sizes
    order, begin, which = distinct(keys, content_hash(flat, starts, sizes) ^ anchors.astype(np.uint64))
    of, best = order[begin], np.minimum.reduceat(least[order], begin)
    windows = sizes[of] - SPAN + 1
    base = np.cumsum(windows) - windows
    owners = np.repeat(best, windows)
    bucket = np.append(np.flatnonzero(np.concatenate([[True], keys[of][1:] != keys[of][:-1]])), len(of))
    several = np.diff(bucket) > 1
    todo = np.flatnonzero(np.repeat(several, np.diff(bucket)))  # distinct segments, by key
    upto = np.cumsum(sizes[of][todo])
    ends = np.cumsum(np.diff(bucket)[several])  # of each bucket in todo
    i = 0
    while i < len(todo):  # one bounded group of suffix buckets at a time
        room = np.searchsorted(upto, (upto[i - 1] if i else 0) + BUCKET_BYTES, "right")
        fits = ends[np.searchsorted(ends, room, "right") - 1] if ends[0] <= room else 0
        j = int(fits if fits > i else ends[np.searchsorted(ends, i, "right")])
        mine = todo[i:j]
        into = np.repeat(base[mine] - np.cumsum(windows[mine]) + windows[mine], windows[mine]) + np.arange(int(windows[mine].sum()))
        owners[into] = least_owner(gather(flat, starts[of[mine]], sizes[of[mine]]), sizes[of[mine]], anchors[of[mine]], best[mine])
        i = j
    out = []
    for i, j in zip(each[:-1], each[1:], strict=True):
        w = windows[which[i:j]]
        out.append(B.numbers(owners[np.repeat(base[which[i:j]] - np.cumsum(w) + w, w) + np.arange(int(w.sum()))]))
    return pd.DataFrame({"block": pdf["block"].values, "shard": pdf["shard"].values, "keys": [b""] * len(pdf), "extra": out})


def removed(b: B.Block, keyed: pd.DataFrame, owners: pd.DataFrame, n_shards: int) -> np.ndarray:
    """True for each byte of the block that goes."""
    c = _candidates(b, keyed, n_shards)
    steps = np.zeros(b.size + 1, np.int32)
    if len(c["which"]):
        windows = c["d_size"] - SPAN + 1
        told = np.concatenate([np.frombuffer(B.spread(x), np.int64) for x in owners.sort_values("shard")["extra"]])
        base = np.cumsum(windows) - windows
        if len(told) != windows.sum():
            raise RuntimeError(f"block {b.no}: {windows.sum()} windows, {len(told)} answers")
        for i in range(0, len(c["which"]), RUNS):  # some runs at a time
            many, which = c["count"][i : i + RUNS], c["which"][i : i + RUNS]
            inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            gone = told[np.repeat(base[which], many) + inner] < np.repeat(c["ids"][i : i + RUNS], many)
            at = (np.repeat(c["first"][i : i + RUNS], many) + inner)[gone]
            np.add.at(steps, at, 1)
            np.add.at(steps, at + SPAN, -1)
    return np.cumsum(steps[:-1]) > 0


def _marked(docs: DataFrame, finish, schema: str) -> DataFrame:
    """finish(block, removed bytes) for every block of the scan of docs(doc_id, text)."""
    docs = B.steady(docs)
    n = shards_for(docs)
    keyed = cut(_ask(docs, n).groupBy("shard").applyInPandas(_shared_keys, B.QUESTION_DDL), "suffix-keys")
    bodies = B.packed_blocks(docs)
    segments = bodies.unionByName(keyed).groupBy("block").applyInPandas(_segments(n), B.QUESTION_DDL)
    owners = cut(segments.groupBy("shard").applyInPandas(_answer, B.QUESTION_DDL), "suffix-owners")

    def run(table: pa.Table) -> pa.Table:
        b, told = _block_of(table.to_pandas())
        second = told["keys"].values == b"owners"
        return finish(b, removed(b, told[~second], told[second], n))

    return bodies.unionByName(keyed).unionByName(owners.withColumn("keys", F.lit(b"owners"))).groupBy("block").applyInArrow(run, schema)


def _runs(b: B.Block, gone: np.ndarray):
    """Of each row: its bytes, its mask, the number of removed runs."""
    edge = gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]
    edge[b.offsets[:-1][b.offsets[:-1] < b.size]] = gone[b.offsets[:-1][b.offsets[:-1] < b.size]]
    upto, edges = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
    for i, j in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
        n = int(upto[j] - upto[i])
        text = b.data[i:j]
        yield text, gone[i:j], n, int(edges[j] - edges[i]), (text[~gone[i:j]] if n else text).tobytes()


def report(docs: DataFrame) -> DataFrame:
    """Each row of docs(doc_id, text) as doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(b: B.Block, gone: np.ndarray) -> pa.Table:
        rows = [(len(text), n, spans, hashlib.sha256(kept).hexdigest()) for text, _, n, spans, kept in _runs(b, gone)]
        sizes, removals, spans, digests = zip(*rows, strict=True)
        return pa.table({"doc_id": b.ids, "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removals, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests)})

    return _marked(docs.select("doc_id", "text"), finish, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with all its columns and what is left of each text; a character that loses a byte goes whole. A null text becomes empty; an n_chars column is counted anew."""
    others = [c for c in docs.columns if c != "text"]

    def finish(b: B.Block, gone: np.ndarray) -> pa.Table:
        texts = [kept.decode("utf-8", "ignore") for *_, kept in _runs(b, gone)]
        found = {c: b.ids.field(c) for c in others} | {"text": pa.array(texts, pa.string())}
        return pa.table({c: found[c] for c in docs_columns})

    docs_columns, schema = docs.columns, docs.schema
    out = _marked(docs.select(F.struct(*others).alias("doc_id"), "text"), finish, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in others else out
