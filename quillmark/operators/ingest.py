"""From documents to paragraphs and references. One row a document until the final explode: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as T


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines as they stand."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _kept(parts, least: int):
    return F.filter(F.transform(F.filter(parts, lambda t: F.length(t) >= least), T.strip), lambda t: F.length(t) >= least)


def _chunks(text: str, size: int, least: int):
    slices = lambda whole: F.transform(F.sequence(F.lit(0), F.greatest(F.length(whole) - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(whole, i + 1, F.lit(size)))
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(F.array(T.strip(F.col(text))), lambda whole: F.when(F.length(whole) > 0, _kept(slices(whole), least)))[0], none)


def paragraphs(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, paragraph_index, text): stripped lines of enough characters, numbered from 0."""
    kept = docs.select("doc_id", _kept(F.split("text", "\n", -1), config.min_paragraph_chars).alias("_p"))
    return kept.select("doc_id", F.posexplode_outer("_p").alias("paragraph_index", "text")).filter("paragraph_index IS NOT NULL")


def chunks(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, paragraph_index, text): slices of fixed length, the last fallback of extraction."""
    kept = docs.select("doc_id", _chunks("text", config.chunk_chars, config.min_paragraph_chars).alias("_p"))
    return kept.select("doc_id", F.posexplode_outer("_p").alias("paragraph_index", "text")).filter("paragraph_index IS NOT NULL")


def extraction(docs: DataFrame, config: Config = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry..., extraction_method, degraded_mode, parts): the first method in order that yields a paragraph; the raw chunks also where text is left but no chunk is.

    Where a reader of layouts gave docs a column elements, array of (type, text), its narrative texts come first, then of
    blocks, array of (kind, text), the cleaned text blocks (kind 0); then lines, pages and chunks of the text.
    """
    none, least = F.array().cast("array<string>"), config.min_paragraph_chars
    methods = [
        ("elements", _kept(F.transform(F.filter("elements", lambda e: e["type"] == "NarrativeText"), lambda e: e["text"]), least) if "elements" in docs.columns else none),
        ("blocks", _kept(F.transform(F.filter("blocks", lambda e: e["kind"] == 0), lambda e: T.clean(e["text"])), least) if "blocks" in docs.columns else none),
        ("lines", _kept(F.split("text", "\n", -1), least)),
        ("pages", _kept(F.transform(F.split("text", r"\n{2,}", -1), T.clean), least)),
        ("raw_chunk", _chunks("text", config.chunk_chars, least)),
    ]
    methods = [m for m in methods if m[0] in ("lines", "pages", "raw_chunk") or m[0] in docs.columns]
    tried = docs.select("doc_id", *carry, *(c for c in ("text", "elements", "blocks") if c in docs.columns and c not in carry))
    method = parts = None
    for i, (n, c) in enumerate(methods):  # each on what the ones before found nothing in
        tried = tried.withColumn(f"_{n}", c if i == 0 else F.when(parts.isNull(), c))
        some = F.size(f"_{n}") > 0
        if n != methods[-1][0]:
            method = F.when(some, n) if method is None else method.when(some, n)
            parts = F.when(some, F.col(f"_{n}")) if parts is None else parts.when(some, F.col(f"_{n}"))
    method = method.when(F.length(T.strip(F.coalesce("text", F.lit("")))) > 0, "raw_chunk").otherwise("none")
    degraded = ~method.isin("elements", "blocks", "lines")
    return tried.select("doc_id", *carry, method.alias("extraction_method"), degraded.alias("degraded_mode"), parts.otherwise(F.col("_raw_chunk")).alias("parts"))


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt by doc_id where its files are fewer than the cores, so that one small file doesn't keep all but one idle. Frames without files stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if 0 < len(docs.inputFiles()) < cores else docs


def parsed(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """extraction() of each document with its references, and without the parts that contain a reference's first characters.

    The references are those of merge_references() over bibliography(), here inside the row: nothing is shuffled.
    """
    tried = extraction(docs, config, carry=("text", *(c for c in docs.columns if c not in ("doc_id", "text", "elements", "blocks"))))
    all_lines = F.split("text", "\n", -1)
    heads = F.transform(all_lines, lambda x: x.rlike(T.HEADING))
    at = F.coalesce(F.array_position(heads, True), F.lit(0)).cast("int")
    after = F.when(at > 0, F.slice(all_lines, at + 1, F.greatest(F.size(all_lines) - at, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    listed = F.filter(after, lambda x: ~x.rlike(T.HEADING) & (F.length(T.strip(x)) > 10))
    mark = "\x02"  # begins an entry
    joined = F.array_join(F.transform(listed, lambda x, i: F.concat(F.when((i == 0) | x.rlike(T.ENTRY_START), F.lit(mark)).otherwise(F.lit(" ")), F.replace(T.strip(x), F.lit(mark), F.lit("")))), "")
    entries = F.when(F.size(listed) > 0, F.split(F.substr(joined, F.lit(2)), mark)).otherwise(F.array().cast("array<string>"))
    marked = tried.withColumn("references", entries).withColumn("_marks", F.filter(F.array_distinct(F.transform("references", T.fingerprint)), lambda m: m != ""))
    kept = F.filter("parts", lambda p: ~F.exists("_marks", lambda m: F.contains(F.lower(p), m)))
    return marked.withColumn("parts", F.when(F.size("_marks") > 0, kept).otherwise(F.col("parts"))).drop("_marks", "text")


def bibliography(document_lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(doc_id, line_no, line): what stands after the first heading line, if longer than 10 characters.

    With legacy_backward_bibliography pages are visited from the last to the first, and lines of a page in order.
    """
    order = [F.col("page").desc(), F.col("line_no")] if config.legacy_backward_bibliography else ([F.col("page"), F.col("line_no")] if "page" in document_lines.columns else [F.col("line_no")])
    before = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = document_lines.withColumn("_seen", F.coalesce(F.max(T.is_heading("line").cast("int")).over(before), F.lit(0)))
    return seen.filter((F.col("_seen") == 1) & ~T.is_heading("line") & (F.length(T.strip("line")) > 10)).select("doc_id", "line_no", "line")


def merge_references(reference_lines: DataFrame) -> DataFrame:
    """(doc_id, ref_index, ref_text): a line that doesn't start an entry continues the last one; the first line always starts one."""
    upto = Window.partitionBy("doc_id").orderBy("line_no")
    starts = (T.starts_entry("line") | (F.row_number().over(upto) == 1)).cast("int")
    numbered = reference_lines.withColumn("_start", starts).withColumn("ref_index", F.sum("_start").over(upto).cast("int") - 1)
    parts = F.array_sort(F.collect_list(F.struct("line_no", T.strip("line").alias("line"))))
    return numbered.groupBy("doc_id", "ref_index").agg(F.array_join(F.transform(parts, lambda x: x["line"]), " ").alias("ref_text"))


def drop_references(paragraph_rows: DataFrame, references: DataFrame) -> DataFrame:
    """Paragraphs that contain no reference's fingerprint, numbered anew. The fingerprints of a document travel as one array."""
    marks = references.select("doc_id", T.fingerprint("ref_text").alias("_mark")).filter("_mark <> ''").groupBy("doc_id").agg(F.collect_set("_mark").alias("_marks"))
    low = F.lower("text")
    kept = paragraph_rows.join(marks, "doc_id", "left").filter(F.col("_marks").isNull() | ~F.exists("_marks", lambda m: F.contains(low, m)))
    return kept.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph_index")) - 1).alias("paragraph_index"), "text")
