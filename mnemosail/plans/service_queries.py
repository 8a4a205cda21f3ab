"""Queries around services: paged sources, classifiers, formatters, replaced files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as K
from ..sources import files
from ..sources import readers as IO
from ..sources.keyed_table import KeyedTable
from .inputs import CHUNK, Inputs
from .registry import query
from .stream_queries import scratch


def page(number: int) -> list[tuple]:
    """A stand-in service: 937 items, 100 a page."""
    return [(number, k) for k in range(number * 100, min(937, number * 100 + 100))]


def cursor_page(cursor: str | None) -> tuple[list[tuple], str | None]:
    """A stand-in service that names the next page: 1437 items, newest first, 100 a page."""
    at = int(cursor or 0)
    return [(1436 - k,) for k in range(at, min(1437, at + 100))], str(at + 100) if at + 100 < 1437 else None


def read_service(i: Inputs, kind, schema: str, fetch, **options):
    name = f"mnemosail_{fetch.__name__}"
    i.spark.dataSource.register(kind(name, schema, fetch))
    return i.spark.read.format(name).options(**options).load()


@query("scan_paginated", "SELECT x//100 AS page, x AS item FROM (SELECT unnest(range(0, 937)) AS x)")
def _(i: Inputs):
    return read_service(i, IO.paged_source, "page long, item long", page, pageSize=100)


@query("scan_token_paginated", "SELECT CAST(x AS BIGINT) AS item FROM (SELECT unnest(range(1187, 1437)) AS x)")
def _(i: Inputs):
    return read_service(i, IO.cursor_source, "item long", cursor_page, limit=250)


@query("scan_graphql_cursor", "SELECT CAST(x AS BIGINT) AS item FROM (SELECT unnest(range(437, 1437)) AS x)")
def _(i: Inputs):
    return read_service(i, IO.cursor_source, "item long", cursor_page, maxPages=10)


@query("sink_declare_row", "WITH c AS (SELECT doc_id FROM documents WHERE doc_id%2=0), d AS (SELECT doc_id, lang AS x FROM documents WHERE doc_id%3<>0) SELECT doc_id, x FROM d")
def _(i: Inputs):
    d = i.table("documents")
    current, declared = d.where("doc_id % 2 = 0").select("doc_id", F.lit("old").alias("x")), d.where("doc_id % 3 <> 0").select("doc_id", F.col("lang").alias("x"))
    target = KeyedTable.create(i.spark, scratch(i), current.schema, "doc_id", buckets=16)
    target.declare(current)
    target.declare(declared)
    return target.rows()


@query("sink_atomic_replace", "SELECT doc_id, lang FROM documents WHERE doc_id%2=0")
def _(i: Inputs):
    at, d = scratch(i), i.table("documents").select("doc_id", "lang")
    files.replace_table(d, at)
    files.replace_table(files.current_table(i.spark, at).where("doc_id % 2 = 0"), at)  # from the version that it replaces
    return files.current_table(i.spark, at)


@query("sink_text_report", "SELECT event_type||': '||count(*)||' calls' AS line FROM events GROUP BY event_type")
def _(i: Inputs):
    counts = i.table("events").groupBy("event_type").count().orderBy(F.desc("count"), "event_type").collect()  # a row per type
    at = f"{scratch(i)}/report.txt"
    files.write_lines(i.spark, at, [f"{r.event_type}: {r['count']} calls" for r in counts])
    return i.spark.read.text(at).withColumnRenamed("value", "line")


@query("fn_format_results", f"WITH {CHUNK} SELECT id, filepath||chr(10)||substr(search_text,1,500)||CASE WHEN length(search_text)>500 THEN '...' ELSE '' END AS shown FROM chunk")
def _(i: Inputs):
    c = F.col("search_text")
    return i.chunks().select("id", F.concat("filepath", F.lit("\n"), F.substring(c, 1, 500), F.when(F.length(c) > 500, "...").otherwise("")).alias("shown"))


@query("fn_sha1_16", "SELECT doc_id, substr(sha1(text),1,16) AS key16 FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", T.stable_key(F.col("text")).alias("key16"))


@query("fn_sha256", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


HEAD = "lower(substr(text,1,1000))"
THE, DER = f"contains({HEAD},'the')::INT", f"contains({HEAD},'der')::INT"


@query("udf_classify_project", f"SELECT doc_id, CASE WHEN e=0 AND g=0 THEN NULL WHEN e>=g THEN 'english' ELSE 'german' END AS label, greatest(e,g)::DOUBLE AS confidence FROM (SELECT doc_id, {THE} AS e, {DER} AS g FROM documents)")
def _(i: Inputs):
    v = K.classify(F.col("text"), K.keyword_backend({"english": ["the"], "german": ["der"]}))
    return i.table("documents").select("doc_id", v.alias("v")).select("doc_id", "v.label", "v.confidence")


@query("udf_classify_off_topic", f"SELECT doc_id, contains({HEAD},'scum') OR contains({HEAD},'clown') AS off_topic, (contains({HEAD},'scum')::INT+contains({HEAD},'clown')::INT)/2.0::DOUBLE AS confidence FROM documents")
def _(i: Inputs):
    v = K.classify(F.col("text"), K.keyword_backend({"off_topic": ["scum", "clown"]}))
    return i.table("documents").select("doc_id", v.alias("v")).select("doc_id", F.col("v.label").isNotNull().alias("off_topic"), "v.confidence")


@query("udf_check_contradiction", "SELECT doc_id, doc_id%3=0 AS contradicts, CASE WHEN doc_id%3=0 THEN 1 END AS idx, 1.0::DOUBLE AS confidence FROM documents")
def _(i: Inputs):
    k = F.col("doc_id") % 3
    said = F.concat(F.lit("use "), "lang", F.lit(" here"))
    memories = F.when(k == 0, F.array(F.lit("other"), F.concat(F.lit("not "), said))).when(k == 1, F.array(said)).otherwise(F.array().cast("array<string>"))
    return i.table("documents").select("doc_id", K.contradiction(said, memories).alias("c")).select("doc_id", "c.contradicts", F.col("c.idx").cast("int").alias("idx"), "c.confidence")


