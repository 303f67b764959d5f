"""Paginated law search as a Python data source: one partition for each keyword, or, as a stream, for each run of pages.

    spark.dataSource.register(LawSearchSource)
    spark.read.format("law_search").options(keywords="세법,관세", pages=folder).load()

With `page` only that page is read (the exact hit of a name: `display=20`,
`page=1` and operators.discovery.exact). The reply of a page comes from `pages`, a folder of files `<keyword>-<page>.xml`
(offline, on any file system Arrow reads), or from `url` with `api_key`.

readStream gives the same rows. Its offsets say how many pages of each keyword
have been read, so a stream that starts again on its checkpoint reads no page of
a finished batch twice, and pages that a search has more later come in later
batches. How many pages there are is asked by a request for one result (online)
or by the names in the folder, which count up from 1 and are listed once a
batch. A batch has TASKS partitions and one a keyword at most, each a run of a
keyword's pages, so a large search takes longer tasks, not more. A page that fails is a
row with its error; a keyword whose number of pages cannot be asked is read at
its first page, so that its error is a row too.
"""

from __future__ import annotations

import functools
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from statuta.schemas import LAW_SUMMARY
from statuta.sources.law_xml import SUMMARY_FIELDS, parse_search

SCHEMA = f"keyword string, keyword_rank int, position int, {LAW_SUMMARY}, error string"


def get(url: str, query: dict) -> str:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(query)}", timeout=30) as reply:
        return reply.read().decode()


#: Runs of pages of a batch of the stream, beside those that begin a keyword.
TASKS = 200


@functools.lru_cache(maxsize=8)
def file_system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def page_file(folder: str, keyword: str, page: int) -> tuple[arrow_fs.FileSystem, str]:
    fs, root = file_system(folder)
    return fs, f"{root}/{keyword}-{page}.xml"


def page_names(folder: str) -> set[str]:
    """Names of the files in a folder, by one listing."""
    fs, root = file_system(folder)
    return {f.base_name for f in fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)) if f.type == arrow_fs.FileType.File}


def exists(fs: arrow_fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == arrow_fs.FileType.File


def write_pages(pages: DataFrame, folder: str) -> None:
    """Put replies (keyword, page, xml) as files in a folder; a task that is retried writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for keyword, page, xml in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = page_file(folder, keyword, page)
                if (parent := os.path.dirname(path)) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(path) as out:
                    out.write(xml.encode())
            yield batch.select(["page"])

    pages.select("keyword", "page", "xml").mapInArrow(run, "page long").write.format("noop").mode("overwrite").save()


class Keyword(InputPartition):
    def __init__(self, rank: int, keyword: str):
        self.rank, self.keyword = rank, keyword


def pages(fetch: Callable[[int], str], per_page: int, cap: int, delay: float) -> Iterator[dict[str, str]]:
    """Laws page by page, until a page is empty or as many as there are, or the cap, have been read; a page is never cut."""
    read, page = 0, 1
    while True:
        laws, total = parse_search(fetch(page))
        yield from laws
        read += len(laws)
        if not laws or read >= min(total, cap):
            return
        page += 1
        time.sleep(delay)


class LawSearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.keywords = [k for k in options.get("keywords", "").split(",") if k]
        self.folder, self.url, self.key = options.get("pages"), options.get("url"), options.get("api_key") or os.environ.get("LAW_API_KEY")
        if not self.folder and not self.key:
            raise ValueError("an API key is needed to search online")
        self.per_page, self.cap, self.delay = int(options.get("display", 100)), int(options.get("max_results", 2000)), float(options.get("delay", 0 if self.folder else 0.3))
        self.page = int(options["page"]) if "page" in options else None

    def partitions(self) -> list[InputPartition]:
        return [Keyword(i, k) for i, k in enumerate(self.keywords)]

    def fetch(self, keyword: str, page: int) -> str:
        if self.folder:
            fs, path = page_file(self.folder, keyword, page)
            if not exists(fs, path):
                return "<LawSearch/>"
            with fs.open_input_stream(path) as f:
                return f.read().decode()
        return self.online(keyword, self.per_page, page)

    def online(self, keyword: str, display: int, page: int) -> str:
        return get(self.url, {"OC": self.key, "target": "law", "type": "XML", "query": keyword, "display": display, "page": page})

    def laws(self, keyword: str) -> Iterator[dict[str, str]]:
        if self.page is not None:
            return iter(parse_search(self.fetch(keyword, self.page))[0])
        return pages(lambda p: self.fetch(keyword, p), self.per_page, self.cap, self.delay)

    def read(self, partition: Keyword) -> Iterator[tuple]:
        """Rows of a keyword; one that fails gives a single row with its error."""
        i = -1
        try:
            for i, law in enumerate(self.laws(partition.keyword)):
                yield (partition.keyword, partition.rank, i, *(law[f] for f in SUMMARY_FIELDS), None)
        except Exception as e:  # noqa: BLE001  other keywords go on
            yield (partition.keyword, partition.rank, i + 1, *(None for _ in SUMMARY_FIELDS), f"{type(e).__name__}: {e}"[:500])


class Page(InputPartition):
    """A page of a keyword, or a run of pages from it to last."""

    def __init__(self, rank: int, keyword: str, page: int, last: int | None = None):
        self.rank, self.keyword, self.page, self.last = rank, keyword, page, page if last is None else last


class LawSearchStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.search, self.done = LawSearchReader(options), {}

    def pages(self, keyword: str, names: set[str]) -> int:
        """How many pages a search has now, at most those of max_results laws; names are those in the folder."""
        most = -(-self.search.cap // self.search.per_page)
        if not self.search.folder:
            total = parse_search(self.search.online(keyword, 1, 1))[1]
            return min(most, -(-total // self.search.per_page))
        n = self.done.get(keyword, 0)
        while n < most and f"{keyword}-{n + 1}.xml" in names:
            n += 1
        return n

    def initialOffset(self) -> dict:
        return {k: 0 for k in self.search.keywords}

    def latestOffset(self) -> dict:
        names = page_names(self.search.folder) if self.search.folder else set()
        for keyword in self.search.keywords:
            try:
                n = self.pages(keyword, names)
            except Exception:  # noqa: BLE001  the task that reads the first page tells
                n = 1
            self.done[keyword] = max(self.done.get(keyword, 0), n)
        return dict(self.done)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.done = {k: max(self.done.get(k, 0), start.get(k, 0), end.get(k, 0)) for k in self.search.keywords}
        todo = [(i, k, start.get(k, 0) + 1, end.get(k, 0)) for i, k in enumerate(self.search.keywords)]
        run = max(1, -(-sum(max(0, last - first + 1) for *_, first, last in todo) // TASKS))
        return [Page(i, k, p, min(p + run - 1, last)) for i, k, first, last in todo for p in range(first, last + 1, run)]

    def read(self, partition: Page) -> Iterator[tuple]:
        """Rows of a run of pages; a page that fails gives a single row with its error."""
        key = partition.keyword, partition.rank
        for page in range(partition.page, partition.last + 1):
            if page > partition.page:
                time.sleep(self.search.delay)
            first = (page - 1) * self.search.per_page
            try:
                laws = parse_search(self.search.fetch(partition.keyword, page))[0]
            except Exception as e:  # noqa: BLE001  other pages go on
                yield (*key, first, *(None for _ in SUMMARY_FIELDS), f"{type(e).__name__}: {e}"[:500])
                continue
            for i, law in enumerate(laws):
                yield (*key, first + i, *(law[f] for f in SUMMARY_FIELDS), None)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


class LawSearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "law_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LawSearchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LawSearchStream(self.options)


def detail_of(url: str, key: str | None = None) -> Callable[[str], str]:
    """A function from a law's number to its XML over HTTP; ValueError without a key."""
    key = key or os.environ.get("LAW_API_KEY")
    if not key:
        raise ValueError("an API key is needed to read laws online")
    return lambda mst: get(url, {"OC": key, "target": "law", "type": "XML", "MST": mst})


def details(laws: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """(mst, raw_xml, error) of each mst once; a law that fails has its error and no XML."""

    def one(mst: str) -> tuple[str | None, str | None]:
        try:
            return fetch(mst), None
        except Exception as e:  # noqa: BLE001  other laws go on
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mst in batch.column(0).to_pylist():  # a law's XML is large, so each is a batch of its own
                xml, error = one(mst)
                yield pa.RecordBatch.from_arrays([pa.array([mst], pa.string()), pa.array([xml], pa.string()), pa.array([error], pa.string())], ["mst", "raw_xml", "error"])

    return laws.select("mst").where("mst IS NOT NULL").distinct().mapInArrow(run, "mst string, raw_xml string, error string")
