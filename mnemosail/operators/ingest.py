"""Issues, boards and catalogs to retained items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import included
from . import chunking as C
from .memory import keep_first

# Associations of people whose comments count, and the order of a board's columns.
TRUSTED = ["OWNER", "MEMBER", "COLLABORATOR", "CONTRIBUTOR"]
BOARD_ORDER = ["In Progress", "Next", "Review", "Backlog", "Epics", "Done", "(no status)"]


def human_comments(comments: Column, most: int = 10, least: int = 20, trusted: list[str] | None = None) -> Column:
    """The first ``most`` comments by trusted people, without bots and very short ones."""

    def good(c: Column) -> Column:
        ok = ~c["login"].endswith("[bot]") & (F.length(c["body"]) > least)
        return ok & c["association"].isin(trusted) if trusted is not None else ok

    return F.slice(F.filter(comments, good), 1, most)


def issue_header(kind: Column, number: Column, repo: Column, title: Column, author: Column, created: Column, body: Column, trim=T.strip) -> Column:
    """Title line, stable facts and description: nothing that changes with the issue's state. Ends with an empty line where there is no description."""
    name = F.when(kind == "pr", "PR").otherwise("Issue")
    head = F.concat(F.lit("# "), name, F.lit(" #"), number.cast("string"), F.lit(" ("), F.substring_index(repo, "/", -1), F.lit("): "), title)
    facts = F.concat(F.lit("Repo: "), repo, F.lit(" | Author: "), F.coalesce(author, F.lit("unknown")), F.lit(" | Created: "), F.substring(F.coalesce(created, F.lit("")), 1, 10))
    text = trim(F.coalesce(body, F.lit("")))
    return F.concat_ws("\n", head, facts, F.lit(""), F.nullif(text, F.lit("")))


def issue_tags(state: Column, kind: Column, repo: Column, labels: Column) -> Column:
    return F.concat(F.array(state, kind, repo), F.slice(labels, 1, 5))


def item_status(fields: Column) -> Column:
    """Value of the field named Status."""
    return F.coalesce(F.get(F.filter(fields, lambda f: f["field"] == "Status"), F.lit(0))["name"], F.lit("(no status)"))


def board(items: DataFrame, order: list[str] = BOARD_ORDER) -> DataFrame:
    """Per status: its titles and count; known statuses first, then as first seen. Items without title count in ``total`` only.

    items: status, title, place.
    """
    known = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    groups = items.where("title is not null").groupBy("status").agg(F.array_sort(F.collect_list(F.struct("place", "title"))).alias("_t"), F.min("place").alias("_p"), F.count("*").alias("items"))
    total = items.agg(F.count("*").alias("total"))
    rank = F.coalesce(F.try_element_at(known, F.col("status")), F.lit(len(order)))
    return groups.crossJoin(F.broadcast(total)).select("status", "items", "total", F.transform("_t", lambda x: x["title"]).alias("titles"), rank.alias("known_rank"), F.col("_p").alias("first_place"))


def catalog(tools: DataFrame, prefixed: list[str]) -> DataFrame:
    """Tools of several backends (backend, backend_order, tool) under one name each: some backends prefix theirs, and the first wins."""
    name = F.when(F.col("backend").isin(prefixed), F.concat("backend", F.lit("_"), "tool")).otherwise(F.col("tool"))
    return keep_first(tools.withColumn("name", name), ["name"], "backend_order", "tool")


def items_of(docs: DataFrame, base: Column, sep: str = "-") -> DataFrame:
    """Adds document_id to chunk rows (key, chunk)."""
    return docs.withColumn("document_id", T.document_key(base, F.col("key"), sep))


@dataclass(frozen=True)
class Flow:
    """One line of a project's configuration: which files it takes, how they are cut, and where the pieces go."""

    name: str
    kind: str
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    size: int
    overlap: int
    sink: str


def scanned(files: DataFrame, flows: list[Flow], path: str = "filepath") -> DataFrame:
    """``files`` with flow, kind, size, overlap and sink: one row for each flow that takes the file. All flows share one scan."""

    def taken(f: Flow) -> Column:
        row = F.struct(F.lit(f.name).alias("flow"), F.lit(f.kind).alias("kind"), F.lit(f.size).alias("size"), F.lit(f.overlap).alias("overlap"), F.lit(f.sink).alias("sink"))
        return F.when(included(F.col(path), list(f.include), list(f.exclude)), row)

    rows = files.select("*", F.explode(F.array_compact(F.array(*map(taken, flows)))).alias("_f"))
    return rows.select(*files.columns, "_f.*")


def flow_chunks(files: DataFrame, flows: list[Flow], path: str = "filepath", text: str = "text") -> DataFrame:
    """flow, kind, sink, path, key, chunk of every file that a flow takes, cut as the flow says."""
    rows = scanned(files, flows, path)
    out = None
    for size, overlap in sorted({(f.size, f.overlap) for f in flows}):
        own = rows.where((F.col("size") == size) & (F.col("overlap") == overlap))
        part = C.numbered(own, text, size, overlap).select("flow", "kind", "sink", path, "key", "chunk")
        out = part if out is None else out.unionByName(part)
    return out
