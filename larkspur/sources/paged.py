"""A paged register as a Spark data source: `spark.read.format("paged_register")`, whose tasks ask for the pages.

How many pages there are isn't known beforehand. Task k of n asks for pages k, k + n, k + 2n and so on, and ends at its first page that isn't
full: whatever comes after it is empty. Each page is tried again by itself, and a lost task only asks for its own pages again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

_WHOLE, _BROKEN = (IntegerType, LongType, ShortType), (DoubleType, FloatType)


class RegisterError(RuntimeError):
    pass


class Refused(RegisterError):
    """An answer that asking again won't change."""


class Stripe(InputPartition):
    """The pages of one task: from first on, every step-th."""

    def __init__(self, first: int, step: int) -> None:
        super().__init__(first)
        self.first, self.step = first, step


class PagedRegister(DataSource):
    """Options: url, with {limit} and {offset}, or answers, a folder of recorded pages (page=0, page=1 and so on); with url also query, a
    text with {limit} and {offset} that is posted as a form's `query`. columns: the schema, if it isn't given with schema(). size: rows of a page (2000); tasks (8);
    attempts at a page (3), with wait (0.5) times 1, 2, ... seconds between; timeout (60).

    An answer is SPARQL JSON: results.bindings, each variable with a value. What a binding lacks is null. A page of more rows than asked for, a
    value that isn't of its column's type and a register without rows are errors; so are answers of the 4xx kind, which aren't tried again, but for 408 and 429.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_register"

    def schema(self) -> str:
        if "columns" not in self.options:
            raise RegisterError("the columns of the register aren't known: use schema() or the option columns")
        return self.options["columns"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return RegisterReader(dict(self.options), schema)


class RegisterReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        said = {k.lower(): v for k, v in options.items()}
        self.url, self.answers, self.query = said.get("url"), said.get("answers"), said.get("query")
        if (self.url is None) == (self.answers is None):
            raise RegisterError("either url or answers has to be given")
        self.size, self.tasks, self.attempts = (int(said.get(k, v)) for k, v in (("size", 2000), ("tasks", 8), ("attempts", 3)))
        self.wait, self.timeout = (float(said.get(k, v)) for k, v in (("wait", 0.5), ("timeout", 60)))
        if min(self.size, self.tasks, self.attempts) < 1:
            raise RegisterError("size, tasks and attempts have to be 1 at least")
        self.columns = [(f.name, int if isinstance(f.dataType, _WHOLE) else float if isinstance(f.dataType, _BROKEN) else str) for f in schema]

    def partitions(self) -> list[InputPartition]:
        return [Stripe(k, self.tasks) for k in range(self.tasks)]

    def read(self, partition: Stripe) -> Iterator[tuple]:
        page = partition.first
        while True:
            rows = self.asked(page)
            if not rows and not page:
                raise RegisterError("the register gave no rows")
            yield from rows
            if len(rows) < self.size:
                return
            page += partition.step

    def asked(self, page: int) -> list[tuple]:
        """The rows of a page, after so many attempts."""
        for turn in range(1, self.attempts + 1):
            try:
                return self.rows(self.answer(page), page)
            except Refused:
                raise
            except (OSError, ValueError, KeyError, TypeError) as e:
                if turn == self.attempts:
                    raise RegisterError(f"page {page} failed after {turn} attempts: {type(e).__name__}: {e}") from e
                time.sleep(self.wait * turn)
        raise AssertionError

    def answer(self, page: int) -> str:
        if self.answers is not None:
            return recorded(self.answers, page)
        fill = lambda text: text.replace("{limit}", str(self.size)).replace("{offset}", str(page * self.size))
        form = urllib.parse.urlencode({"query": fill(self.query)}).encode() if self.query else None
        request = urllib.request.Request(fill(self.url), data=form, headers={"Accept": "application/sparql-results+json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as said:
                return said.read().decode()
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code not in (408, 429):
                raise Refused(f"page {page}: the register answered {e.code}") from e
            raise

    def rows(self, text: str, page: int) -> list[tuple]:
        bindings = json.loads(text)["results"]["bindings"]
        if len(bindings) > self.size:
            raise Refused(f"page {page} has {len(bindings)} rows, {self.size} were asked for")
        return [tuple(kind(b[name]["value"]) if name in b else None for name, kind in self.columns) for b in bindings]


def recorded(folder: str, page: int) -> str:
    """A recorded page's text; that of an empty one, if it isn't there."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(f"{path}/page={page}", allow_not_found=True))
    parts = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    if not parts:
        return '{"results": {"bindings": []}}'
    with store.open_input_stream(parts[0]) as stream:
        return stream.read().decode()


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(PagedRegister)
