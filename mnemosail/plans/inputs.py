"""Stand-ins for the entities of the survey, derived from the driver's tables.

Each exists twice: as DataFrames, and as DuckDB common table expressions for
the oracles. Signals that invented prose lacks are put in by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.postings import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources import files

AS_OF = "2024-01-31 00:00:00"
BANKS = ["hindsight", "hindsight-docs", "hindsight-issues", "cocoindex-code"]
CODE_BANK = "cocoindex-code"


#: Indexes that this process has built, by application and input; they are deleted when the application ends.
_BUILT: dict[tuple[str, ...], object] = {}


class Inputs:
    """Tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def messages(self) -> DataFrame:
        """t, raw_idx, role, text, tool, server: one message of a transcript with at most one tool call."""
        c = self.table("conversations")
        mark = (F.col("conv_id") * 7 + F.col("turn")) % 5
        user, pick = F.col("role") == "user", (F.col("conv_id") + F.col("turn")) % 6
        text = F.when(user & (mark == 0), F.concat(F.lit("no, that's wrong. "), "text")).when(user & (mark == 1), F.concat(F.lit("we always use "), "text")).otherwise(F.col("text"))
        tool = F.when(pick == 0, "recall").when(pick == 1, "Write").when(pick == 2, "Read").when(pick == 3, "Grep").when(pick == 4, "Shell")
        server = F.when(F.col("conv_id") % 3 == 0, "project-0-alpha-hindsight-docs").when(F.col("conv_id") % 3 == 1, "user-cocoindex-code").otherwise("hindsight-docs")
        asst = F.col("role") == "assistant"
        return c.select(F.col("conv_id").alias("t"), F.col("turn").alias("raw_idx"), "role", text.alias("text"), F.when(asst, tool).alias("tool"), F.when(asst & (pick == 0), server).alias("server"))

    def blocks(self) -> DataFrame:
        """Messages in the shape that session operators take: chars and an array of tool blocks."""
        m = self.messages()
        call = F.when(F.col("server").isNotNull(), F.struct(F.col("tool").alias("tool"), F.col("server").alias("server")))
        block = F.struct(F.col("tool").alias("name"), call.alias("call"))
        tools = F.array_compact(F.array(F.when(F.col("tool").isNotNull(), block)))
        return m.select("t", "raw_idx", "role", "text", F.length("text").alias("chars"), tools.alias("tools"))

    def facts(self) -> DataFrame:
        """id, text, date, bank, tag, hash, created: stored statements."""
        d = self.table("documents")
        day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 30).cast("int"))
        return d.select(F.col("doc_id").alias("id"), fact_text().alias("text"), F.date_format(day, "yyyy-MM-dd").alias("date"), F.col("source").alias("bank"), F.col("lang").alias("tag"), F.sha1(F.col("text").cast("binary")).alias("hash"), (F.col("doc_id") * 37 % 101).alias("created"))

    def chunks(self) -> DataFrame:
        """id, filepath, search_text, embedding: code chunks."""
        e, d = self.table("embeddings"), self.table("documents")
        repo = F.when(F.col("doc_id") % 7 == 0, F.concat("source", F.lit("@release-v1.5"))).otherwise(F.col("source"))
        path = F.concat(repo, F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
        return e.join(d, e.vec_id == d.doc_id).select(F.col("vec_id").alias("id"), path.alias("filepath"), F.concat(path, F.lit(" "), "text").alias("search_text"), "embedding")

    def _index(self, kind: str, build):
        """An index of the chunks, built when the first query asks for it and again when the tables change."""
        state = [files.fingerprint(self.spark, f"{self.dir}/{t}.parquet") for t in ("embeddings", "documents")]
        key = (kind, self.spark.sparkContext.applicationId, self.dir, *state)
        if key not in _BUILT:
            _BUILT[key] = build(files.scratch(self.spark, kind))
        return _BUILT[key]

    def text_index(self) -> TextIndex:
        def build(root: str) -> TextIndex:
            index = TextIndex(self.spark, root)
            index.add(self.chunks())
            return index

        return self._index("texts", build)

    def vector_index(self) -> VectorIndex:
        return self._index("vectors", lambda root: VectorIndex.build(self.chunks(), root))

    def calls(self) -> DataFrame:
        """ts, day, raw_server, bank, hit, duration, chars: tool-call log."""
        e, k = self.table("events"), F.col("event_id") % 5
        base = F.concat(F.lit("hindsight-"), "event_type")
        server = F.when(k == 0, F.concat(F.lit("alpha-"), base)).when(k == 1, F.concat(F.lit("project-0-alpha-v1.6-"), base)).when(k == 2, F.concat(F.lit("user-"), base)).when(k == 3, F.concat(base, F.lit("::mcpScope:local"))).otherwise(base)
        bank = F.when(F.col("user_id") % 4 == 0, None).otherwise(F.concat(F.lit("bank"), (F.col("user_id") % 3).cast("string")))
        return e.select("event_id", "ts", F.to_date("ts").alias("day"), server.alias("raw_server"), bank.alias("bank"), (F.col("value") > 50).alias("hit"), F.col("value").alias("duration"), (F.col("event_id") % 997).alias("chars"))


def fact_text() -> Column:
    """Every ninth statement ages fast, every eleventh is a snapshot, every thirteenth is a rule, every seventeenth is short."""
    i, t = F.col("doc_id"), F.col("text")
    return F.when(i % 9 == 0, F.concat(F.lit("the assistant is implementing "), t)).when(i % 11 == 0, F.concat(F.lit("currently running "), t)).when(i % 13 == 0, F.concat(F.lit("we must follow the standard "), t)).when(i % 17 == 0, F.substring(t, 1, 40)).otherwise(t)


MSG = """msg AS (SELECT conv_id AS t, turn AS raw_idx, role,
  CASE WHEN role='user' AND (conv_id*7+turn)%5=0 THEN 'no, that''s wrong. '||text
       WHEN role='user' AND (conv_id*7+turn)%5=1 THEN 'we always use '||text ELSE text END AS text,
  CASE WHEN role='assistant' THEN CASE (conv_id+turn)%6 WHEN 0 THEN 'recall' WHEN 1 THEN 'Write' WHEN 2 THEN 'Read' WHEN 3 THEN 'Grep' WHEN 4 THEN 'Shell' END END AS tool,
  CASE WHEN role='assistant' AND (conv_id+turn)%6=0 THEN CASE conv_id%3 WHEN 0 THEN 'project-0-alpha-hindsight-docs' WHEN 1 THEN 'user-cocoindex-code' ELSE 'hindsight-docs' END END AS server
  FROM conversations)"""
FACT = """fact AS (SELECT doc_id AS id,
  CASE WHEN doc_id%9=0 THEN 'the assistant is implementing '||text WHEN doc_id%11=0 THEN 'currently running '||text
       WHEN doc_id%13=0 THEN 'we must follow the standard '||text WHEN doc_id%17=0 THEN substring(text,1,40) ELSE text END AS text,
  strftime(DATE '2024-01-01' + CAST(doc_id%30 AS INTEGER), '%Y-%m-%d') AS date, source AS bank, lang AS tag, sha1(text) AS hash, doc_id*37%101 AS created
  FROM documents)"""
CHUNK = """chunk AS (SELECT vec_id AS id, source||CASE WHEN doc_id%7=0 THEN '@release-v1.5' ELSE '' END||'/'||lang||'/'||doc_id AS filepath,
  source||CASE WHEN doc_id%7=0 THEN '@release-v1.5' ELSE '' END||'/'||lang||'/'||doc_id||' '||text AS search_text, embedding
  FROM embeddings JOIN documents ON vec_id=doc_id)"""
CALL = """call AS (SELECT event_id, ts, CAST(ts AS DATE) AS day,
  CASE event_id%5 WHEN 0 THEN 'alpha-hindsight-'||event_type WHEN 1 THEN 'project-0-alpha-v1.6-hindsight-'||event_type WHEN 2 THEN 'user-hindsight-'||event_type
       WHEN 3 THEN 'hindsight-'||event_type||'::mcpScope:local' ELSE 'hindsight-'||event_type END AS raw_server,
  CASE WHEN user_id%4=0 THEN NULL ELSE 'bank'||(user_id%3) END AS bank, value>50 AS hit, value AS duration, event_id%997 AS chars
  FROM events)"""
#: Server names of CALL without their variants.
SERVER = """srv AS (SELECT *, CASE WHEN s LIKE 'user-%' THEN s ELSE regexp_replace(s, '^(project-\\d+-)?[a-z0-9]+(-v[\\d.]+)?-(hindsight|cocoindex)', '\\3') END AS server
  FROM (SELECT *, regexp_replace(raw_server, '::mcpScope:.*$', '') AS s FROM call))"""
