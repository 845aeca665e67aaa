"""WARC archives with a two-level capture index.

Records are gzip members, so each can be read alone. Every writing task puts its records into archive files of
bounded size and returns the captures (key, archive, offset, length). Keys are URLs with the host reversed; sorted
by key and page, they fill compressed blocks of BLOCK captures, and a sparse directory, at the end of each index file,
holds the first key of each block. A lookup bisects the first keys of the index files, then the file's directory, then
the block that it reads by range, and reads the records by range. Executors write below the shared folder under a name
of their task's attempt, so a repeated attempt never replaces a file that committed captures point into.

Equal payloads of at least `least` bytes have one response record, that of the least page_id; the others revisit it
(WARC 1.1, identical-payload-digest) and hold the headers only.

Defined cases: a null html is an empty payload; a null url is an empty key; a null page_id counts as larger than
any; of repeated rows with the least page_id each is a response; pages with one key stand in the index by page_id, then
by place in the archives; very long pages are records like others; other columns of pages are ignored, whatever their
names; an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, folder, maybe_broadcast, shards

BLOCK, ARCHIVE_BYTES, GAP, BATCH = 1000, 64 << 20, 64 << 10, 10_000
_DATE = "2020-01-01T00:00:00Z"  # a fixed value: runs agree byte for byte


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: https://a.b.org/x?y -> org,b,a)/x?y."""
    try:
        part = urlsplit((url or "").strip())
        host = (part.hostname or "").lower()
    except ValueError:
        return (url or "").lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (part.path or "/") + ("?" + part.query if part.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC record, not yet compressed. Content-Length of the HTTP header is that of the full payload."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record in raw: its headers in lower case, the HTTP headers likewise under http, and the payload."""
    at = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[:at].decode().split("\r\n")[1:])
    head = {k.lower(): v for k, v in head.items()}
    body = raw[at + 4 : at + 4 + int(head["content-length"])]
    if raw[at + 4 + len(body) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    stop = body.index(b"\r\n\r\n")
    http = {k.lower(): v for k, v in (line.split(": ", 1) for line in body[:stop].decode().split("\r\n")[1:])}
    return head | {"http": http, "payload": body[stop + 4 :]}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file:" + path if not path.startswith("file:") else path)


def _write(root: str, name: str, data: list[bytes]) -> None:
    """Whole or not at all: a lost or repeated attempt leaves no half of a file under the name."""
    store, base = _store(_uri(root))
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for x in data:
            out.write(x)
    store.move(draft, f"{base}/{name}")


def _uri(path: str) -> str:
    """file:/x and /x as pyarrow wants them."""
    return re.sub(r"^(file:)?/(?!/)", "file:///", path)


@dataclass(frozen=True)
class Capture:
    key: str
    page: int | None
    archive: str
    offset: int
    length: int


def decide(pages: DataFrame, least: int) -> DataFrame:
    """pages(page_id, url, html) with _sha1 and _first: the page that a revisit refers to, else null."""
    seen = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"_sha1": F.sha1(F.col("html").cast("binary")), "_size": F.octet_length("html")})
    firsts = seen.filter(F.col("_size") >= least).groupBy("_sha1", "_size").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    firsts = maybe_broadcast(cut(firsts, "warc-repeats"))
    same = seen.join(firsts, ["_sha1", "_size"], "left")
    return same.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_first"))


def write(pages: DataFrame, least: int = 0, root: str | None = None) -> str:
    """Writes archives and index below root (a fresh shared folder if None), and returns root."""
    spark = pages.sparkSession
    root = root or folder(spark, "warc")

    def archive(batches):
        task = TaskContext.get()
        name, no, held, offset = f"part-{task.partitionId():06}-{task.taskAttemptId()}", 0, [], 0
        for pdf in batches:
            rows = []
            for page, url, html, first in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["_first"], strict=True):
                payload = html.encode()
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                member = gzip.compress(record(page, url, payload, digest(payload), first), 6, mtime=0)
                rows.append((url_key(url), page, f"{name}-{no:04}.warc.gz", offset, len(member)))
                held.append(member)
                offset += len(member)
                if offset >= ARCHIVE_BYTES:
                    _write(f"{root}/archives", f"{name}-{no:04}.warc.gz", held)
                    no, held, offset = no + 1, [], 0
            yield pd.DataFrame(rows, columns=["key", "page", "archive", "offset", "length"]).astype({"page": "Int64"})
        if held:
            _write(f"{root}/archives", f"{name}-{no:04}.warc.gz", held)

    def index(batches):
        task = TaskContext.get()
        name, held, entries, offset, rows = f"index-{task.partitionId():06}-{task.taskAttemptId()}.idx", [], [], 0, []

        def full(n):
            nonlocal offset
            while len(rows) >= n and rows:
                lines, rows[:] = rows[:BLOCK], rows[BLOCK:]
                data = _pack(lines)
                entries.append((lines[0][0], offset, len(data), len(lines)))
                held.append(data)
                offset += len(data)

        for pdf in batches:
            rows += [(k, None if pd.isna(p) else int(p), a, int(o), int(n)) for k, p, a, o, n in zip(pdf["key"], pdf["page"], pdf["archive"], pdf["offset"], pdf["length"], strict=True)]
            full(BLOCK)
        full(1)
        if entries:
            held.append(_pack(entries))
            _write(f"{root}/index", name, held)
            yield pd.DataFrame([(entries[0][0], name, offset, len(held[-1]), sum(e[3] for e in entries))], columns=["first_key", "file", "offset", "length", "captures"])

    captures = cut(decide(pages, least).mapInPandas(archive, "key string, page long, archive string, offset long, length long"), "warc-captures")
    in_order = captures.repartitionByRange(shards(spark), "key", "page", "archive", "offset").sortWithinPartitions("key", "page", "archive", "offset")
    in_order.mapInPandas(index, "first_key string, file string, offset long, length long, captures long").write.parquet(f"{root}/directory")
    return root


def _pack(lines: list[tuple]) -> bytes:
    return zlib.compress("".join(json.dumps(x) + "\n" for x in lines).encode(), 6)


def _lines(root: str, file: str, offset: int, length: int) -> list[list]:
    """What _pack() packed, at a range of an index file."""
    store, base = _store(_uri(f"{root}/index"))
    with store.open_input_file(f"{base}/{file}") as f:
        return [json.loads(x) for x in zlib.decompress(f.read_at(length, offset)).decode().splitlines()]


class Lookup:
    """Captures by key, from files alone: first_keys and places of all index files in key order are what it starts with.

    Keys are best asked in order: the last directory and the last block read are kept.
    """

    def __init__(self, root: str, files: list[tuple[str, str, int, int]]):
        self.root, self.files, self.first_keys = root, files, [f[0] for f in files]
        self.last: dict[str, tuple] = {}

    def _kept(self, level: str, place: tuple) -> tuple[list, list[str]]:
        if self.last.get(level, (None,))[0] != place:
            rows = _lines(self.root, *place)
            self.last[level] = (place, rows, [r[0] for r in rows])
        return self.last[level][1:]

    def captures(self, key: str) -> Iterator[Capture]:
        """All captures of the key. It may begin in the file, or block, before the first that starts with it."""
        for _, file, offset, length in self.files[max(bisect.bisect_left(self.first_keys, key) - 1, 0) : bisect.bisect_right(self.first_keys, key)]:
            blocks, firsts = self._kept("directory", (file, offset, length))
            for _, at, size, _ in blocks[max(bisect.bisect_left(firsts, key) - 1, 0) : bisect.bisect_right(firsts, key)]:
                rows, keys = self._kept("block", (file, at, size))
                for r in rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                    yield Capture(*r)


def index_files(spark: SparkSession, root: str) -> list[tuple[str, str, int, int]]:
    """First key, name and place of the directory of every index file, in key order: a row a file, as many as partitions wrote."""
    found = spark.read.parquet(f"{root}/directory").select("first_key", "file", "offset", "length").collect()
    return sorted((tuple(r) for r in found), key=lambda r: (r[0], r[1]))


def _records(root: str, archive: str, ranges: list[tuple[int, int]]):
    """Parsed records at sorted (offset, length) ranges of one archive; ranges less than GAP apart share a read."""
    store, base = _store(_uri(f"{root}/archives"))
    with store.open_input_file(f"{base}/{archive}") as f:
        i = 0
        while i < len(ranges):
            j = i + 1
            while j < len(ranges) and ranges[j][0] - sum(ranges[j - 1]) <= GAP and sum(ranges[j]) - ranges[i][0] <= 8 << 20:
                j += 1
            data = f.read_at(sum(ranges[j - 1]) - ranges[i][0], ranges[i][0])
            for offset, length in ranges[i:j]:
                yield parse(gzip.decompress(data[offset - ranges[i][0] : offset - ranges[i][0] + length]))
            i = j


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"


def _row(r: dict) -> tuple:
    number = lambda x: int(x) if x else None
    payload = r["payload"] if r["warc-type"] == "response" else None
    if payload is not None and (digest(payload) != r["warc-payload-digest"][5:] or len(payload) != int(r["http"]["content-length"])):
        raise ValueError(f"record of page {r['x-page']} is damaged")
    return (number(r["x-page"]), r["warc-target-uri"], r["warc-type"], int(r["http"]["content-length"]), r["warc-payload-digest"][5:], number(r.get("x-refers-to-page")), None if payload is None else payload.decode())


def read(spark: SparkSession, root: str, urls: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all captures of urls(url): distinct keys in order, each bisected, then their records by range, archive by archive."""
    files = index_files(spark, root)

    def keys(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": [url_key(u if isinstance(u, str) else None) for u in pdf["url"]]})

    def search(batches):
        lookup = Lookup(root, files)
        for pdf in batches:
            found = []
            for key in pdf["key"]:
                for c in lookup.captures(key):
                    found.append((c.archive, c.offset, c.length))
                    if len(found) == BATCH:  # one key may have many captures
                        yield pd.DataFrame(found, columns=["archive", "offset", "length"])
                        found = []
            yield pd.DataFrame(found, columns=["archive", "offset", "length"])

    def fetch(batches):
        for pdf in batches:
            rows = []
            for archive, part in pdf.groupby("archive", sort=False):
                rows += [_row(r) for r in _records(root, archive, list(zip(part["offset"].tolist(), part["length"].tolist(), strict=True)))]
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
            yield frame if payloads else frame.drop(columns="payload")

    n = shards(spark)
    asked = urls.select("url").mapInPandas(keys, "key string").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    ranges = asked.mapInPandas(search, "archive string, offset long, length long")
    return ranges.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset").mapInPandas(fetch, RECORD if payloads else RECORD.removesuffix(", payload string"))


class Index:
    """Lookups of single URLs by the driver; it holds one first key an index file."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.lookup = root, Lookup(root, index_files(spark, root))

    def captures(self, url: str | None) -> list[Capture]:
        return list(self.lookup.captures(url_key(url)))

    def records(self, url: str | None) -> list[dict]:
        return [next(_records(self.root, c.archive, [(c.offset, c.length)])) for c in self.captures(url)]
