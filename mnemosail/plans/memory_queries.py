"""Stored statements: dedup, triage, joins, contradiction routing, review, sinks by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import memory as M
from ..sources import files
from ..sources import readers as IO
from ..sources.keyed_table import KeyedTable
from .inputs import CALL, FACT, Inputs
from .registry import query
from .text_queries import TRIAGE

CUTOFF = "2024-01-15"


def triaged(i: Inputs):
    return M.triage(i.facts(), F.to_date(F.lit(CUTOFF)))


@query("agg_dedup_content_hash", f"WITH {FACT} SELECT id, hash FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY created DESC, id) AS r FROM fact) WHERE r>1")
def _(i: Inputs):
    return M.older_copies(i.facts(), "hash", "created", "id").select("id", "hash")


@query("sink_upsert_by_document_id", "WITH o AS (SELECT doc_id, source AS v, 1 AS ver FROM documents), n AS (SELECT doc_id, 'new' AS v, 2 AS ver FROM documents WHERE doc_id%3=0 UNION ALL SELECT doc_id+1000000, 'added', 2 FROM documents WHERE doc_id%10=0), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ver DESC) AS r FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) SELECT doc_id, v, ver FROM u WHERE r=1")
def _(i: Inputs):
    d = i.table("documents")
    old = d.select("doc_id", F.col("source").alias("v"), F.lit(1).alias("ver"))
    new = d.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("v"), F.lit(2).alias("ver")).unionByName(d.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("added").alias("v"), F.lit(2).alias("ver")))
    target = KeyedTable.create(i.spark, files.scratch(i.spark, "items"), old.schema, "doc_id", "ver", 16)
    target.upsert(old)
    target.upsert(new)
    return target.rows()


@query("target_state_diff", "WITH c AS (SELECT doc_id, lang AS x FROM documents WHERE doc_id%5<>0), d AS (SELECT doc_id, CASE WHEN doc_id%4=0 THEN 'zz' ELSE lang END AS x FROM documents WHERE doc_id%7<>0) SELECT coalesce(c.doc_id,d.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'insert' WHEN d.doc_id IS NULL THEN 'delete' ELSE 'update' END AS action FROM c FULL JOIN d ON c.doc_id=d.doc_id WHERE c.doc_id IS NULL OR d.doc_id IS NULL OR c.x IS DISTINCT FROM d.x")
def _(i: Inputs):
    d = i.table("documents")
    declared = d.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "zz").otherwise(F.col("lang")).alias("x"))
    return M.target_diff(d.where("doc_id % 5 <> 0").select("doc_id", F.col("lang").alias("x")), declared, "doc_id", "x")


@query("sink_append_jsonl", "SELECT doc_id, '{\"doc_id\":'||doc_id||',\"source\":\"'||source||'\"}' AS line FROM documents")
def _(i: Inputs):
    d, at = i.table("documents").select("doc_id", "source"), files.scratch(i.spark, "audit")
    IO.append_json(d.where("doc_id % 2 = 0"), at)
    IO.append_json(d.where("doc_id % 2 = 1"), at)
    return i.spark.read.text(at).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("value").alias("line"))


@query("agg_triage_summary", f"WITH {TRIAGE} SELECT r AS category, count(*) AS n FROM (SELECT unnest(reasons) AS r FROM tri) GROUP BY 1")
def summary(i: Inputs):
    return triaged(i).select(F.explode("reasons").alias("r")).groupBy(T.reason_category(F.col("r")).alias("category")).agg(F.count("*").alias("n"))


@query("sort_reason_counts", f"WITH {TRIAGE} SELECT r AS category, count(*) AS n FROM (SELECT unnest(reasons) AS r FROM tri) GROUP BY 1")
def _(i: Inputs):
    return summary(i).orderBy(F.desc("n"), "category")


@query("join_flagged_memories", f"WITH {TRIAGE}, g AS (SELECT id//4 AS doc, count(*) AS statements, count(*) FILTER (len(reasons)>0) AS flagged FROM tri GROUP BY 1) SELECT doc, statements, flagged, CASE WHEN flagged=0 THEN 'clean' WHEN flagged=statements THEN 'full' ELSE 'mixed' END AS state FROM g")
def states(i: Inputs):
    rows = triaged(i).withColumn("doc", F.floor(F.col("id") / 4))
    return M.document_state(rows, "doc", F.size("reasons") > 0)


@query("agg_triage_totals", f"WITH {TRIAGE} SELECT bank, count(*) AS total, count(*) FILTER (len(reasons)>0) AS flagged, round(count(*) FILTER (len(reasons)>0)::DOUBLE/count(*)*100,1) AS flagged_pct FROM tri GROUP BY 1")
def _(i: Inputs):
    k = F.count(F.when(F.size("reasons") > 0, 1))
    return triaged(i).groupBy("bank").agg(F.count("*").alias("total"), k.alias("flagged"), N.percent(k, F.count("*")).alias("flagged_pct"))


@query("semi_join_watched_ids", f"WITH {TRIAGE} SELECT DISTINCT id//4 AS doc FROM tri WHERE len(reasons)>0")
def _(i: Inputs):
    rows = triaged(i).withColumn("doc", F.floor(F.col("id") / 4))
    return rows.select("doc").distinct().join(rows.where(F.size("reasons") > 0).select("doc").distinct(), "doc", "left_semi")


@query("rearrange_documents", f"WITH {TRIAGE} SELECT id, id//4 AS doc, (row_number() OVER (PARTITION BY id//4 ORDER BY id)-1)//5 AS batch FROM tri WHERE len(reasons)=0")
def _(i: Inputs):
    from pyspark.sql.window import Window

    keep = triaged(i).withColumn("doc", F.floor(F.col("id") / 4)).where(F.size("reasons") == 0)
    return keep.select("id", "doc", F.floor((F.row_number().over(Window.partitionBy("doc").orderBy("id")) - 1) / 5).alias("batch"))


CLAIM = "CASE WHEN contains(lower(text),'the ') AND length(text)<2000 THEN 'common' END, CASE WHEN contains(lower(text),'scum') AND (contains(lower(text),'idiot') OR contains(lower(text),'clown')) THEN 'harsh' END"


@query("agg_repeated_facts", f"WITH {FACT}, r AS (SELECT id, date, unnest(list_filter([{CLAIM}], lambda x: x IS NOT NULL)) AS claim FROM fact), k AS (SELECT *, count(*) OVER (PARTITION BY claim) AS n, row_number() OVER (PARTITION BY claim ORDER BY date DESC, id) AS p FROM r) SELECT claim, id FROM k WHERE n>=3 AND p>1")
def _(i: Inputs):
    low = F.lower("text")
    claims = [("common", low.contains("the ") & (F.length("text") < 2000)), ("harsh", low.contains("scum") & (low.contains("idiot") | low.contains("clown")))]
    return M.restated(i.facts(), claims)


NORM = "substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '\\| when:.*$', ''), '\\| involving:.*$', ''),1,200)"


@query("join_dup_pairs_self", f"WITH {FACT}, f AS (SELECT min(id) AS id, n FROM (SELECT id, {NORM} AS n FROM fact) GROUP BY n) SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON substr(a.n,1,50)=substr(b.n,1,50) AND a.id<b.id")
def _(i: Inputs):
    return M.block_pairs(i.facts()).select("a", "b")


@query("equal_statements", f"WITH {FACT}, f AS (SELECT id, {NORM} AS n FROM fact) SELECT id, m AS first FROM (SELECT id, min(id) OVER (PARTITION BY n) AS m FROM f) WHERE id<>m")
def _(i: Inputs):
    return M.equal_copies(i.facts())


@query("fn_sequence_ratio")
def _(i: Inputs):
    return M.near_duplicates(i.facts(), block=0)


@query("find_near_duplicates_removals")
def _(i: Inputs):
    return M.near_duplicate_removals(i.facts(), block=0).distinct()


@query("join_retag_plan", "SELECT d.doc_id AS doc_id, CASE WHEN starts_with(c.w,'proj-1') THEN 'one' ELSE 'other' END AS label FROM documents d JOIN (SELECT DISTINCT conv_id, 'proj-'||(conv_id%3) AS w FROM conversations) c ON c.conv_id=d.doc_id WHERE d.doc_id%4=0 AND starts_with(c.w,'proj-') AND c.w<>'proj-2'")
def _(i: Inputs):
    docs = i.table("documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("tags"))
    index = i.table("conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("proj-"), (F.col("conv_id") % 3).cast("string")).alias("w")).distinct()
    label = T.project_label(F.col("w"), [("proj-1", "one"), ("proj-0", "other")])
    return docs.where(F.size("tags") == 0).join(index, "doc_id").select("doc_id", label.alias("label")).where("label is not null")


@query("anti_join_content_targets", "SELECT doc_id FROM documents WHERE doc_id%4=0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def targets(i: Inputs):
    return i.table("documents").where("doc_id % 4 = 0").join(i.table("labels"), "doc_id", "left_anti").select("doc_id")


@query("setop_ids_except_resolvable", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(i: Inputs):
    return i.table("documents").select("doc_id").subtract(i.table("labels").select("doc_id"))


@query("join_scope_buckets", "SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN d.doc_id%6=0 THEN 'no_transcript_id' WHEN l.doc_id IS NULL THEN 'unresolved' WHEN l.toxic=1 THEN 'to_delete' END AS b FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE b IS NOT NULL GROUP BY 1")
def _(i: Inputs):
    l = i.table("labels").select("doc_id", "toxic")
    j = i.table("documents").join(l, "doc_id", "left")
    bucket = F.when(F.col("doc_id") % 6 == 0, "no_transcript_id").when(F.col("toxic").isNull(), "unresolved").when(F.col("toxic") == 1, "to_delete")
    return j.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


@query("join_dict_fan_in_project_config", "SELECT doc_id, CASE source WHEN 'src1' THEN 'bank-a' WHEN 'src2' THEN 'bank-b' ELSE 'bank-default' END AS bank FROM documents")
def _(i: Inputs):
    conf = i.spark.createDataFrame([("src1", "bank-a"), ("src2", "bank-b")], "source string, bank string")
    return i.table("documents").join(F.broadcast(conf), "source", "left").select("doc_id", F.coalesce("bank", F.lit("bank-default")).alias("bank"))


@query("select_pattern_roots", "SELECT DISTINCT source FROM documents WHERE source IN ('src1','src3')")
def _(i: Inputs):
    return i.table("documents").where(F.col("source").isin("src1", "src3")).select("source").distinct()


@query("topk_recent_facts", f"WITH {FACT} SELECT id FROM fact WHERE date >= '2024-01-20' ORDER BY id LIMIT 40")
def _(i: Inputs):
    return i.facts().where("date >= '2024-01-20'").orderBy("id").limit(40).select("id")


@query("recall_topn", f"WITH {FACT} SELECT id FROM fact WHERE text IS NOT NULL AND text<>'' AND id%7<>0 ORDER BY id LIMIT 5")
def _(i: Inputs):
    return i.facts().where("text <> '' and id % 7 <> 0").orderBy("id").limit(5).select("id")


@query("sort_pending_desc", f"WITH {CALL} SELECT bank, count(*) AS n FROM call WHERE bank IS NOT NULL GROUP BY 1")
def _(i: Inputs):
    return i.calls().where("bank is not null").groupBy("bank").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bank")


@query("sort_file_mtime", "SELECT page_id, page_id*37%1000 AS mtime FROM pages")
def _(i: Inputs):
    return i.table("pages").select("page_id", (F.col("page_id") * 37 % 1000).alias("mtime")).orderBy("mtime", "page_id")


@query("gate_threshold_tag", "SELECT event_id FROM events WHERE event_type<>'view' AND (event_id%100)/100.0 >= 0.75 AND event_id%9<>0")
def _(i: Inputs):
    e = i.table("events").select("event_id", F.nullif("event_type", F.lit("view")).alias("label"), (F.col("event_id") % 100 / 100).alias("confidence"), F.when(F.col("event_id") % 9 == 0, "timeout").alias("error"))
    return e.where("label is not null and confidence >= 0.75 and error is null").select("event_id")


@query("gate_threshold_purge", "SELECT event_id FROM events WHERE event_type='error' AND (event_id%100)/100.0 >= 0.85 AND event_id%9<>0")
def _(i: Inputs):
    e = i.table("events").select("event_id", (F.col("event_type") == "error").alias("off_topic"), (F.col("event_id") % 100 / 100).alias("confidence"), F.when(F.col("event_id") % 9 == 0, "timeout").alias("error"))
    return e.where("off_topic and confidence >= 0.85 and error is null").select("event_id")


@query("purge_candidates", "SELECT doc_id FROM documents WHERE doc_id%4=0")
def _(i: Inputs):
    docs = i.table("documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("tags"))
    return docs.where(F.size("tags") == 0).select("doc_id")


CHECKS = "c AS (SELECT event_id, event_id%11<>0 AS enabled, event_id%13=0 AS recall_failed, event_id%4 AS n, CASE WHEN event_id%17=0 THEN 'timeout' END AS error, event_id%3=0 AS contradicts, CASE WHEN event_id%19=0 THEN NULL ELSE event_id%5-1 END AS idx, (event_id%20)/20.0::DOUBLE AS confidence FROM events)"
ACTION = "CASE WHEN NOT enabled OR recall_failed OR n<=0 OR error IS NOT NULL OR NOT contradicts OR idx IS NULL OR idx<0 OR idx>=n THEN 'retain' WHEN confidence>=0.9 THEN 'auto_resolved' ELSE 'queued' END"


def checks(i: Inputs):
    e = F.col("event_id")
    memories = F.when(e % 4 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (e % 4).cast("int")))
    return i.table("events").select(e, (e % 11 != 0).alias("enabled"), (e % 13 == 0).alias("recall_failed"), memories.alias("memories"), F.when(e % 17 == 0, "timeout").alias("error"), (e % 3 == 0).alias("contradicts"), F.when(e % 19 != 0, e % 5 - 1).alias("idx"), (e % 20 / 20).alias("confidence"))


@query("resolve_three_tier", f"WITH {CHECKS} SELECT event_id, {ACTION} AS action, {ACTION}='auto_resolved' AS invalidated FROM c")
def _(i: Inputs):
    return M.resolve(checks(i), live=True).select("event_id", "action", "invalidated")


@query("pre_action_check", f"WITH {CHECKS} SELECT event_id, {ACTION} IN ('auto_resolved','queued') AS deny FROM c")
def _(i: Inputs):
    return M.resolve(checks(i)).select("event_id", F.col("action").isin("auto_resolved", "queued").alias("deny"))


@query("review_apply", "SELECT event_id AS id, event_id%4=0 AS invalidate, event_id%4=0 AS retain, event_id%4 IN (0,1) AS dequeue FROM events WHERE event_type='error'")
def _(i: Inputs):
    queue = i.table("events").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    d = F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "r").otherwise("s")
    decisions = queue.where("id % 4 < 3").select("id", d.alias("decision"))
    return M.reviewed(queue, decisions)


LAST = "string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))"


@query("rule_drift_diff", f"SELECT doc_id, doc_id%5<>0 AS in_sync, CASE WHEN doc_id%5=0 THEN '--- stored'||chr(10)||'+++ current'||chr(10)||'@@ -'||len(ls)||' +'||len(ls)||' @@'||chr(10)||'-'||ls[-1]||chr(10)||'+'||ls[-1]||'!' ELSE '' END AS diff FROM (SELECT doc_id, {LAST} AS ls FROM documents)")
def _(i: Inputs):
    mine = T.strip(F.col("text"))
    other = F.when(F.col("doc_id") % 5 == 0, F.concat(mine, F.lit("!"))).otherwise(mine)
    return i.table("documents").select("doc_id", mine.alias("a"), other.alias("b")).select("doc_id", (F.col("a") == F.col("b")).alias("in_sync"), M.unified_diff(F.col("a"), F.col("b"), context=0).alias("diff"))
