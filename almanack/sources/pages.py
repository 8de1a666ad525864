"""Landed pages of a paged extract, read as a table until the short page.

``land_pages`` writes the rows of each page below ``offset=<first row>/rows=<count>``. The
``landed_pages`` data source plans from these names alone: pages in order of offset, up to and with
the first that has fewer rows than a full page, or up to a gap. Pages left behind by an earlier,
longer extract are not read. Filters are pushed into the reading of a page.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from almanack.operators.numbering import number_rows

PAGE_ROWS = 1000
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


def land_pages(df: DataFrame, path: str, order: Sequence[str], size: int = PAGE_ROWS, mode: str = "overwrite") -> None:
    """Write ``df`` as pages of ``size`` rows, JSON lines, as a paged extract in ``order`` leaves them."""
    numbered = number_rows(df, list(order), "_pos", start=0).withColumn("offset", F.expr(f"_pos - _pos % {size}"))
    rows = numbered.groupBy("offset").agg(F.count(F.lit(1)).alias("rows"))
    paged = numbered.join(rows, "offset").repartition("offset").sortWithinPartitions("offset", "_pos")
    paged.drop("_pos").write.mode(mode).partitionBy("offset", "rows").json(path)


class Page(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (pa.fs.LocalFileSystem(), uri)


class PageReader(DataSourceReader):
    """One partition for ``pages`` pages; rows that fail a pushed filter leave no page."""

    TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}

    def __init__(self, path: str, schema: StructType, size: int, pages: int):
        self.path, self.schema, self.size, self.pages = path, schema, size, pages
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        simple = {f.name: f.dataType.typeName() for f in self.schema.fields}
        for f in filters:
            known = isinstance(f, (*self.TESTS, In, IsNotNull)) and len(f.attribute) == 1 and simple.get(f.attribute[0]) in ("long", "integer", "string", "double", "boolean")
            if known:
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, root = _files(self.path)
        found: dict[int, dict[int, list[str]]] = {}
        for info in files.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            parts = info.path.split("/")
            if info.is_file and parts[-1].startswith("part-"):
                offset, rows = (int(p.split("=")[1]) for p in parts[-3:-1])
                found.setdefault(offset, {}).setdefault(rows, []).append(info.path)
        kept, at = [], 0
        while at in found:
            rows = max(found[at])
            kept.append(sorted(found[at][rows]))
            if rows < self.size:
                break
            at += self.size
        groups = [kept[i : i + self.pages] for i in range(0, len(kept), self.pages)]
        return [Page([f for page in g for f in page]) for g in groups] or [Page([])]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        layout = to_arrow_schema(self.schema)
        files, _ = _files(self.path)
        for name in partition.files:
            with files.open_input_stream(name) as stream:
                rows = [json.loads(line) for line in stream.readall().splitlines() if line]
            table = pa.Table.from_pylist(rows, layout)
            if self.pushed:
                table = table.filter(reduce(pc.and_kleene, (self.test(f, table) for f in self.pushed)))
            yield from table.to_batches()

    def test(self, f: Filter, table: pa.Table) -> pa.Array:
        column = table.column(f.attribute[0])
        if isinstance(f, IsNotNull):
            return pc.is_valid(column)
        if isinstance(f, In):
            return pc.is_in(column, pa.array(list(f.value), column.type))
        return self.TESTS[type(f)](column, pa.scalar(f.value, column.type))


class LandedPages(DataSource):
    """Options: ``path``, ``page_rows`` (of a full page), ``pages`` (in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        options = self.options
        return PageReader(options["path"], schema, int(options.get("page_rows", PAGE_ROWS)), int(options.get("pages", 16)))


def read_pages(spark: SparkSession, path: str, schema: str, size: int = PAGE_ROWS, pages: int = 16) -> DataFrame:
    spark.conf.set(PUSH_DOWN, "true")
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").schema(schema).option("path", path).option("page_rows", size).option("pages", pages).load()
