"""Tolerant readers of logs, files and paged services, and keyed sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parsed_lines(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """The same for lines that are a column already."""
    ok = F.try_parse_json(F.col(line)).isNotNull() & (F.trim(F.col(line)) != "")
    return lines.where(ok).select("*", F.from_json(F.col(line), schema).alias("row"))


def kept_since(ts: Column, days: int, now: Column) -> Column:
    """Within the last days before ``now``; times that do not parse count as now. Zones are cut off, not converted."""
    t = F.try_to_timestamp(F.regexp_replace(ts, r"(Z|\+00:00)$", ""))
    return F.coalesce(t, now) >= now - F.make_dt_interval(F.lit(days))


def since(ts: Column, days: int, now: Column) -> Column:
    """The same, but times that do not parse are dropped."""
    t = F.try_to_timestamp(F.regexp_replace(ts, r"(Z|\+00:00)$", ""))
    return F.coalesce(t >= now - F.make_dt_interval(F.lit(days)), F.lit(False))


def daily_reports(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """Files named by day, one report each; a report without date gets its file's."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "2???-??-??.json").json(root).withColumn("date", F.coalesce("date", stem))


def recent_files(spark: SparkSession, root: str, pattern: str, cutoff: Column, prefixes: list[str] | None = None) -> DataFrame:
    """path, modified, size of files changed at ``cutoff`` or later; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).where(F.col("modificationTime") >= cutoff)
    if prefixes:
        name = F.element_at(F.split("path", "/"), -2)
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | name.startswith(p)
        rows = rows.where(cond)
    return rows.orderBy("modified", "path")


def glob_regex(glob: str) -> str:
    """Glob to regular expression: ``**/`` any folders, ``*`` within one, ``?`` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r".\+()[]{}^$|" else glob[i]), i + 1
    return f"^{out}$"


def included(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Paths that match an include glob and no exclude glob."""
    inside = F.lit(False)
    for g in include:
        inside = inside | path.rlike(glob_regex(g))
    for g in exclude:
        inside = inside & ~path.rlike(glob_regex(g))
    return inside


def daily_logs(spark: SparkSession, root: str, schema: StructType | str, days: int, today: str, suffix: str = "") -> DataFrame:
    """The files ``<date><suffix>.json`` of the last days up to ``today``, one JSON object each; days without a file and broken files are skipped."""
    last = dt.date.fromisoformat(today)
    names = ",".join(f"{last - dt.timedelta(days=k)}{suffix}" for k in range(days))
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "{" + names + "}.json").json(root)


def log_last_match(spark: SparkSession, path: str, marks: dict[str, str]) -> DataFrame:
    """(category, last): the time of the last line that holds each category's text; lines start with ``yyyy-MM-dd HH:mm:ss,SSS``."""
    line = F.col("value")
    kind = F.coalesce(*[F.when(line.contains(v), F.lit(k)) for k, v in marks.items()])
    at = F.try_to_timestamp(F.replace(F.substring(line, 1, 23), F.lit(","), F.lit(".")), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    found = spark.read.text(path).select(kind.alias("category"), at.alias("at")).where("category is not null and at is not null")
    return found.groupBy("category").agg(F.max("at").alias("last"))


def paged_text(spark: SparkSession, root: str, pages: Callable[[bytes], list[str]], pattern: str = "*") -> DataFrame:
    """(path, body) of binary documents: pages that are not blank, under headings with their original numbers.

    ``pages``: bytes of a file to the texts of its pages, as a PDF library gives them; a file that it cannot read has no row.
    """

    def run(batches):
        for b in batches:
            kept = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = pages(data)
                except Exception:  # noqa: BLE001 a broken document is skipped, whatever its library raises
                    continue
                kept.append((path, "\n\n".join(f"--- Page {k} ---\n{t}" for k, t in enumerate(found, 1) if t.strip())))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*kept, strict=True)], ["path", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInArrow(run, "path string, body string")


def pdf_pages(data: bytes) -> list[str]:
    """Texts of a PDF's pages; needs the optional package ``pypdf``."""
    import io

    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def form_feed_pages(data: bytes) -> list[str]:
    """Texts of the pages of a plain text."""
    return data.decode("utf-8", "replace").removesuffix("\f").split("\f")


def jdbc_vectors(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int = 64, **options) -> DataFrame:
    """Rows of a vector table of a database, read in ``parts`` ranges of a numeric key; needs its JDBC driver."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties={k: str(v) for k, v in options.items()})


class Stripe(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


class PagedReader(DataSourceReader):
    """Reads pages until one is short. Stripe k of n reads pages k, k + n, ...; each ends at its first short page, so none needs the number of pages."""

    def __init__(self, fetch: Callable[[int], list[tuple]], options: dict):
        self.fetch, self.size, self.stripes = fetch, int(options.get("pageSize", "100")), int(options.get("stripes", "4"))

    def partitions(self) -> list[Stripe]:
        return [Stripe(k, self.stripes) for k in range(self.stripes)]

    def read(self, part: Stripe) -> Iterator[tuple]:
        number = part.first
        while True:
            rows = self.fetch(number)
            yield from rows
            if len(rows) < self.size:
                return
            number += part.step


class CursorReader(DataSourceReader):
    """Follows cursors: each page names the next. One partition, as no page is known before the one ahead of it.

    Ends at the last page, after ``maxPages`` pages, or after ``limit`` rows.
    """

    def __init__(self, fetch: Callable[[str | None], tuple[list[tuple], str | None]], options: dict):
        self.fetch, self.pages, self.limit = fetch, int(options.get("maxPages", "0")), int(options.get("limit", "0"))

    def partitions(self) -> list[InputPartition]:
        return [Stripe(0, 1)]

    def read(self, part: Stripe) -> Iterator[tuple]:
        cursor, pages, sent = None, 0, 0
        while True:
            rows, cursor = self.fetch(cursor)
            if self.limit:
                rows = rows[: self.limit - sent]
            yield from rows
            pages, sent = pages + 1, sent + len(rows)
            if cursor is None or pages == self.pages or self.limit and sent >= self.limit:
                return


def service(name: str, schema: str, fetch: Callable, reader: type[DataSourceReader]) -> type[DataSource]:
    """A data source over a service; register it with ``spark.dataSource.register``."""

    class Service(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return reader(fetch, self.options)

    return Service


def paged_source(name: str, schema: str, fetch: Callable[[int], list[tuple]]) -> type[DataSource]:
    """``fetch``: page number, from 0, to rows. Options ``pageSize`` (rows of a full page) and ``stripes`` (parallel readers)."""
    return service(name, schema, fetch, PagedReader)


def cursor_source(name: str, schema: str, fetch: Callable[[str | None], tuple[list[tuple], str | None]]) -> type[DataSource]:
    """``fetch``: cursor, null at first, to rows and the next cursor, null at the end. Options ``maxPages`` and ``limit``."""
    return service(name, schema, fetch, CursorReader)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that ``df`` has rows for; each task's files are committed by Spark's protocol."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
