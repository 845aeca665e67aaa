"""Source tracing: candidates joined by key, cosine similarity, exact containment and boosts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import numeric as N
from ..functions import text as T
from . import clauses, features
from .language import Language

#: Vectors of a block, of queries and of candidates: an eighth of a side, between these bounds.
BLOCK, WIDE = 4096, 16384
#: Rows of a block whose product with the other is held at once.
ROWS = 256
#: Candidates of a block that a piece of the product has.
COLUMNS = 1024
#: Code points of a text by which texts that contain it are found.
KEY = 40
#: Neighbouring hashes of which one is kept.
WINDOW = 24
#: Of two sources that are equally similar the one of the earlier service counts.
SERVICES = ("arxiv", "openalex")


def longest_anomalies(labelled: DataFrame, first: int = 3) -> DataFrame:
    """The longest anomalous paragraphs of each document with at least ten words."""
    order = Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "paragraph_index")
    hit = labelled.filter("cluster_id = -1").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return hit.filter(T.word_count("text") >= 10)


def paired(left: DataFrame, right: DataFrame, item: tuple[str, str], block: int = BLOCK, key: tuple[str, ...] = (), wide: int = 0) -> tuple:
    """Two groupings of rows by (key..., block of left, block of right), to be met by cogroup(): every row of left meets every row of right of its key. item: what blocks are dealt by, on each side; wide: what blocks grow to where an eighth of a side is more than block."""
    size = lambda n: -(-n // max(block, min(wide, -(-n // 8))))
    pieces = lambda f: max(1, size((f.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) if key else f.count()))
    (a, b), each = map(pieces, (left, right)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    left, right = (f.select(*(F.col(c).alias(c) for c in f.columns)) for f in (left, right))  # columns that both sides have from one table would be mixed up
    return (
        left.withColumns({"_a": dealt(item[0], a)}).select("*", each(b).alias("_b")).groupBy(*key, "_a", "_b"),
        right.withColumns({"_b": dealt(item[1], b)}).select("*", each(a).alias("_a")).groupBy(*key, "_a", "_b"),
    )


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, sources: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, source, similarity): the k most similar of s to each row of q, but those of its own id. s is in order of its sources, so a later one counts only if it is more similar (to 12 decimals) than the k before."""
    row, source, value, least = np.zeros(0, np.int64), sources[:0], np.zeros(0), None
    for at in range(0, len(s), COLUMNS):
        some = sources[at : at + COLUMNS]
        similar = q @ s[at : at + COLUMNS].T
        if least is None:
            similar[ids[:, None] == some[None, :]] = -np.inf
            least = np.partition(similar, -k, 1)[:, -k] - 1e-12 if len(some) > k else np.full(len(q), -np.inf)
        r, c = np.divmod(np.flatnonzero(similar >= least[:, None]), len(some))
        other = ids[r] != some[c]
        if not other.any():
            continue
        r, c = r[other], c[other]
        row, source, value = np.append(row, r), np.append(source, some[c]), np.append(value, similar[r, c])
        order = np.lexsort((source, -value.round(12), row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        order, rank = order[rank < k], rank[rank < k]
        row, source, value = row[order], source[order], value[order]
        full = rank == k - 1
        least = np.full(len(q), -np.inf)
        least[row[full]] = value[full].round(12) + 4e-13  # what rounds to more is 5e-13 above
    return row, source, value


def nearest(queries: DataFrame, candidates: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, source_id, similarity, rank): of each of queries(query_id, vector) the k most similar of all candidates(source_id, vector) but itself.

    Every query meets every candidate, block by block: a task holds a block of each and a piece of their product of
    matrices, and a block answers k rows a query. Rank ties (to 12 decimals) go to the smaller source_id; zero vectors are similar to none.
    """

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norm == 0, 1, norm)

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(given):
            q, s = unit(matrix(asked["vector"])), unit(matrix(given["vector"]))
            every, sources = asked["query_id"].to_numpy(), given["source_id"].to_numpy()
            order = np.argsort(sources, kind="stable")
            order = order[np.isfinite(s[order]).all(1)]
            s, sources = s[order], sources[order]
            for at in range(0, len(q), ROWS):
                ids = every[at : at + ROWS]
                row, source, value = best(q[at : at + ROWS], ids, s, sources, k)
                out.append(pa.table([pa.array(ids[row]), pa.array(source), pa.array(value)], names=["query_id", "source_id", "similarity"]))
        kinds = [("query_id", asked.schema.field("query_id").type), ("source_id", given.schema.field("source_id").type), ("similarity", pa.float64())]
        return pa.concat_tables(out) if out else pa.schema(kinds).empty_table()

    asked, given = paired(queries.select("query_id", "vector"), candidates.select("source_id", "vector"), ("query_id", "source_id"), block, wide=WIDE)
    few = asked.cogroup(given).applyInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, source_id {dict(candidates.dtypes)['source_id']}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "source_id")
    return few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def inverted_index(texts: DataFrame) -> DataFrame:
    """(doc_id, _index): of each of texts(doc_id, words) the map from word to its places, made in the row's task."""

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            told = batch.column(1).flatten().dictionary_encode()
            row, word = np.repeat(np.arange(len(sizes)), sizes), told.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((word, row))  # stable: places ascend
            row, word = row[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])])) if len(row) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(order - ends[row], pa.int32()))
            upto = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(sizes)))])
            yield pa.record_batch([batch.column(0), pa.MapArray.from_arrays(pa.array(upto, pa.int32()), told.dictionary.take(pa.array(word[first])), places)], names=["doc_id", "_index"])

    return texts.select("doc_id", "words").mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, _index map<string,array<int>>")


def accept(best: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """best(similarity, overlap, is_exact) that are similar enough after the boost, or contain the text."""
    boosted = best.withColumn("similarity", N.boosted(F.col("similarity"), F.col("overlap"), config.boost))
    return boosted.filter((F.col("similarity") >= config.similarity) | F.col("is_exact"))


def contains_exactly(text: str, abstract: str, title: str):
    low = F.lower(T.strip(text))
    return F.contains(F.lower(abstract), low) | F.contains(F.lower(title), low)


def containing(paragraphs: DataFrame, texts: DataFrame, key: int = KEY, shortest: int = 0) -> DataFrame:
    """(doc_id, paragraph_index, source_id) where the lower-cased text(source_id, body) contains the whole lower-cased paragraph.

    Both sides are winnowed: of each WINDOW neighbouring hashes of KEY code points the least is kept, so a text that
    contains a paragraph of KEY + WINDOW - 1 code points or more keeps a hash that the paragraph keeps. The index has
    hashes and ids, some 2 / WINDOW of the text's length; bodies and paragraphs meet only where a hash does, once a
    pair, and are then compared whole. Shorter paragraphs meet by their first KEY code points and all hashes; shortest, the
    least length of the paragraphs where it is known, spares the search for such. Paragraphs are longer than key.
    """
    least = key + WINDOW - 1
    bodies = texts.select("source_id", F.lower("body").alias("_body")).filter(F.length("_body") >= key)
    low = paragraphs.select("doc_id", "paragraph_index", F.lower(T.strip("text")).alias("_low"))
    first = lambda t: F.array_min(F.transform(F.sequence(F.lit(1), F.lit(WINDOW)), lambda i: F.xxhash64(F.substring(t, i, F.lit(key)))))
    marks = low.filter(F.length("_low") >= least).select("doc_id", "paragraph_index", F.transform(F.array(F.substring("_low", 1, least)), first)[0].alias("_key"))  # bound once, not made anew for each hash
    index = bodies.filter(F.length("_body") >= least).select("source_id", F.explode(_winnowed("_body", key)).alias("_key"))
    pairs = marks.join(index.hint("merge"), "_key").select("doc_id", "paragraph_index", "source_id")
    short = low.filter(F.length("_low") < least).select("doc_id", "paragraph_index", F.xxhash64(F.substring("_low", 1, key)).alias("_key"))
    if shortest < least and not short.isEmpty():
        every = bodies.select("source_id", F.explode(F.array_distinct(_hashes("_body", key))).alias("_key"))
        pairs = pairs.unionByName(short.join(every.hint("merge"), "_key").select("doc_id", "paragraph_index", "source_id"))
    met = pairs.distinct().join(low, ["doc_id", "paragraph_index"]).join(bodies, "source_id")
    return met.filter(F.contains("_body", F.col("_low"))).select("doc_id", "paragraph_index", "source_id")


def _hashes(text: str, key: int, piece: int = 1000):
    """Of every key code points of a text, by pieces, as a place in a text is found from its beginning."""
    pieces = F.transform(F.sequence(F.lit(0), F.length(text) - key, F.lit(piece)), lambda i: F.substring(text, i + 1, F.lit(piece + key - 1)))
    return F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - key + 1), lambda i: F.xxhash64(F.substring(p, i, F.lit(key))))))


def _winnowed(text: str, key: int):
    """The kept hashes of a text of key + WINDOW - 1 code points or more, each once, in order of place."""
    kept = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.array_min(F.slice(h, i, WINDOW)))
    return F.array_distinct(F.transform(F.array(_hashes(text, key)), kept)[0])


def overlap(a: str, b: str):
    return F.size(F.array_intersect(a, b))


def search(queries: DataFrame, candidates: DataFrame, k: int = DEFAULT.sources_per_service) -> DataFrame:
    """queries(query, ...) with the first k answers of each service from candidates(query, origin, rank, ...), the table of what services answered."""
    order = Window.partitionBy("query", "origin").orderBy("rank", "source_id")
    return queries.join(candidates.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).drop("_k"), "query")


def queries(paragraphs: DataFrame, language: Language | None = None) -> DataFrame:
    """(doc_id, paragraph_index, query): what a service is asked about each paragraph, by lemmas of nouns and adjectives where there is a language."""
    return features.keywords(paragraphs) if language is None else features.lemma_queries(paragraphs.select("doc_id", "paragraph_index", "text"), language.lemma, language.model)


def trace(anomalies: DataFrame, candidates: DataFrame, config: Config = DEFAULT, language: Language | None = None) -> DataFrame:
    """(doc_id, paragraph_index, source_id, origin, title, similarity): the accepted best source of each of anomalies(doc_id, paragraph_index, text, vector), with what candidates tell of it (authors, year, url, abstract).

    candidates(query, origin, rank, source_id, title, abstract, source_vector): answers of services to keyword queries.
    Ties of the similarity go to the first of SERVICES, then to the lesser rank. Ideas are clauses where there is a
    language, else runs of content words.
    """
    told = [c for c in ("authors", "year", "url") if c in candidates.columns]
    asked = anomalies.select("doc_id", "paragraph_index", "text", "vector").join(queries(anomalies, language), ["doc_id", "paragraph_index"])
    met = search(asked, candidates.filter("source_id IS NOT NULL"), config.sources_per_service).withColumn("similarity", F.coalesce(N.cosine("vector", "source_vector"), F.lit(0.0)))
    service = F.array_position(F.array(*map(F.lit, SERVICES)), F.lower("origin"))
    first = F.struct((-F.col("similarity")).alias("_s"), F.when(service > 0, service).otherwise(len(SERVICES) + 1).alias("_o"), F.lower("origin").alias("_n"), "rank", "source_id", "origin", "title", "abstract", "text", "similarity", *told)
    best = met.groupBy("doc_id", "paragraph_index").agg(F.min(first).alias("b")).select("doc_id", "paragraph_index", "b.*")
    if language is None:
        ideas = best.withColumns({"_a": features.triplet_array("text"), "_b": features.triplet_array("abstract")})
    else:
        of = lambda c, n: clauses.named(clauses.spoken(best.select("doc_id", "paragraph_index", F.col(c).alias("text")), language.model), language.lemma).withColumnRenamed("triplets", n)
        ideas = best.join(of("text", "_a"), ["doc_id", "paragraph_index"], "left").join(of("abstract", "_b"), ["doc_id", "paragraph_index"], "left")
    judged = ideas.withColumns({"overlap": F.greatest(overlap("_a", "_b"), F.lit(0)), "is_exact": contains_exactly("text", "abstract", "title")})
    return accept(judged, config).select("doc_id", "paragraph_index", "source_id", "origin", "title", N.round_even(F.col("similarity"), 4).alias("similarity"), *told, "abstract")


def union(*found: DataFrame) -> DataFrame:
    """Candidates of several services, in order, repeats kept."""
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
