"""Search services as a data source: queries in, ranked works out, with retries; a failing query is an error row and never a failed job.

A service is a transport, a function (query, first) -> bytes of its answer, and a reader of its format: `arxiv` answers in
Atom, `openalex` in JSON whose abstracts are inverted indexes. Transports are given, so that a site decides how and
whether its executors reach a service; snapshot() is one over saved answers. ask() sends each query of a table from the
task that holds it; source() makes a Spark data source of the same, whose filters on query and origin are pushed down and
decide its partitions. Waits between attempts double, from first_wait to longest_wait seconds.
"""

from __future__ import annotations

import hashlib
import json
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

Transport = Callable[[str, int], bytes]
#: Columns of an answer; a failed query has an error and nulls.
FOUND = "query string, origin string, rank int, source_id string, title string, authors array<string>, year int, url string, abstract string, error string"
_SCHEMA = pa.schema([("query", pa.string()), ("origin", pa.string()), ("rank", pa.int32()), ("source_id", pa.string()), ("title", pa.string()), ("authors", pa.list_(pa.string())), ("year", pa.int32()), ("url", pa.string()), ("abstract", pa.string()), ("error", pa.string())])
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, FIRST = 4, 2.0, 10.0, 3
_ATOM = "{http://www.w3.org/2005/Atom}"


def _plain(text: str | None) -> str:
    return " ".join((text or "").split())


def atom(answer: bytes) -> Iterator[dict]:
    """Works of an Atom feed."""
    for entry in ET.fromstring(answer).iter(f"{_ATOM}entry"):
        told = lambda tag, of=entry: _plain(of.findtext(f"{_ATOM}{tag}"))
        year = told("published")[:4]
        yield {"source_id": told("id"), "title": told("title"), "authors": [_plain(a.findtext(f"{_ATOM}name")) for a in entry.iter(f"{_ATOM}author")], "year": int(year) if year.isdigit() else None, "url": told("id"), "abstract": told("summary")}


def rebuilt(index: dict | None) -> str:
    """The text of an inverted index, word to positions; gaps close, of words at one position the later one stays."""
    placed = {at: word for word, places in (index or {}).items() for at in places}
    return " ".join(placed[at] for at in sorted(placed))


def works(answer: bytes) -> Iterator[dict]:
    """Works of a JSON answer with inverted-index abstracts; one without an abstract has its title."""
    for work in json.loads(answer).get("results", []):
        title = work.get("title") or work.get("display_name") or ""
        place = (work.get("primary_location") or {}).get("landing_page_url")
        yield {"source_id": work.get("id"), "title": title, "authors": [(a.get("author") or {}).get("display_name") or "" for a in work.get("authorships") or []], "year": work.get("publication_year"), "url": work.get("doi") or place or work.get("id"), "abstract": rebuilt(work.get("abstract_inverted_index")) or title}


READERS = {"arxiv": atom, "openalex": works}


def snapshot(path: str, service: str) -> Transport:
    """Saved answers below a folder that every worker can open: <service>/<SHA-1 of the query>."""

    def fetch(query: str, first: int) -> bytes:
        with open(f"{path}/{service}/{hashlib.sha1(query.encode()).hexdigest()}", "rb") as f:
            return f.read()

    return fetch


def answers(query: str, origin: str, transport: Transport, first: int = FIRST, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, longest_wait: float = LONGEST_WAIT, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """The first works for a query as rows of FOUND, or one row with the last attempt's error."""
    empty = dict.fromkeys(_SCHEMA.names) | {"query": query, "origin": origin}
    error = "no attempt"
    for turn in range(attempts):
        try:
            found = list(READERS[origin.lower()](transport(query, first)))[:first]
            return [empty | {"rank": i + 1} | x for i, x in enumerate(found)]
        except Exception as e:  # noqa: BLE001  a service that fails is a result
            error = f"{type(e).__name__}: {e}"[:500]
        if turn + 1 < attempts:
            sleep(min(longest_wait, first_wait * 2**turn))
    return [empty | {"error": error}]


def ask(queries: DataFrame, transports: dict[str, Transport], **limits) -> DataFrame:
    """FOUND of each distinct query of queries(query) by each service; null and empty queries aren't asked."""
    kept = queries.select("query").filter("query <> ''").distinct()
    asked = kept.select("query", F.explode(F.array(*map(F.lit, transports))).alias("origin"))

    def run(batches):
        for batch in batches:
            for query, origin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(answers(query, origin, transports[origin], **limits), schema=_SCHEMA)

    return asked.mapInArrow(run, FOUND)


class _Part(InputPartition):
    def __init__(self, origin: str, queries: list[str]):
        self.origin, self.queries = origin, queries


def source(transports: dict[str, Transport], name: str = "search", per_partition: int = 20, **limits) -> type[DataSource]:
    """A data source to be registered with spark.dataSource.register(): reads must filter by query (=, IN) and may filter by origin.

    Its partitions hold so many queries of one service each. Spark keeps what a loaded frame was filtered by, so load() anew
    for each read; spark.sql.python.filterPushdown.enabled must be true.
    """

    class Reader(DataSourceReader):
        def __init__(self):
            self.queries, self.origins = [], list(transports)

        def pushFilters(self, filters):
            for f in filters:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
                if values is not None and f.attribute == ("query",):
                    self.queries = [v for v in dict.fromkeys(values) if v and (not self.queries or v in self.queries)]
                elif values is not None and f.attribute == ("origin",):
                    self.origins = [o for o in self.origins if o in values]
                else:
                    yield f

        def partitions(self):
            if not self.queries:
                raise ValueError("a read of a search service needs a filter on query")
            return [_Part(o, self.queries[i : i + per_partition]) for o in self.origins for i in range(0, len(self.queries), per_partition)] or [_Part("", [])]

        def read(self, part):
            for query in part.queries:
                for row in answers(query, part.origin, transports[part.origin], **limits):
                    yield tuple(row[c] for c in _SCHEMA.names)

    class Search(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return FOUND

        def reader(self, schema):
            return Reader()

    return Search
