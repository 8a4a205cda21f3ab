"""Tool-call rollups, daily and weekly reports, log scans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import text as T
from ..operators import rollups as R
from ..sources import files
from ..sources import readers as IO
from ..sources.commands import command_items
from .inputs import AS_OF, CALL, SERVER, Inputs
from .registry import query

HITS = "count(*) AS calls, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS hits, count(*)-CAST(sum(CAST(hit AS INT)) AS BIGINT) AS misses, round(sum(CAST(hit AS INT))::DOUBLE/count(*),3) AS hit_rate"


def served(i: Inputs):
    return i.calls().withColumn("server", T.server_name(F.col("raw_server")))


@query("agg_mcp_calls_by_server", f"WITH {CALL}, {SERVER} SELECT server, {HITS} FROM srv GROUP BY 1")
def _(i: Inputs):
    return R.hits_by(served(i), "server")


@query("agg_mcp_calls_by_bank", f"WITH {CALL} SELECT bank, {HITS} FROM call WHERE bank IS NOT NULL GROUP BY 1")
def _(i: Inputs):
    return R.hits_by(i.calls().where("bank is not null"), "bank")


@query("agg_mcp_calls_by_day", f"WITH {CALL}, {SERVER} SELECT day, server, {HITS} FROM srv GROUP BY 1, 2")
def _(i: Inputs):
    return R.hits_by(served(i), "day", "server")


@query("agg_mcp_calls_all", f"WITH {CALL}, {SERVER} SELECT 'server' AS level, NULL::DATE AS day, server, NULL AS bank, {HITS} FROM srv GROUP BY server UNION ALL SELECT 'bank', NULL, NULL, bank, {HITS} FROM srv WHERE bank IS NOT NULL GROUP BY bank UNION ALL SELECT 'day', day, server, NULL, {HITS} FROM srv GROUP BY day, server")
def _(i: Inputs):
    return R.hits_cube(served(i))


@query("agg_mcp_usage_raw", f"WITH {CALL} SELECT coalesce(raw_server,'unknown') AS server, {HITS} FROM call WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND starts_with(raw_server, 'project-0-alpha') GROUP BY 1")
def _(i: Inputs):
    c = i.calls().where((F.col("ts") >= F.to_timestamp(F.lit(AS_OF)) - F.expr("INTERVAL 7 DAYS")) & F.col("raw_server").startswith("project-0-alpha"))
    return R.hits_by(c, F.coalesce("raw_server", F.lit("unknown")).alias("server"))


@query("agg_recall_probes", "SELECT 'bank'||(user_id%3) AS bank, count(*) AS probes, CAST(round_even(avg(event_id%997),0) AS BIGINT) AS avg_latency, round(avg(event_id%7),1) AS avg_results FROM events WHERE event_type='view' GROUP BY 1")
def _(i: Inputs):
    e = i.table("events").where("event_type = 'view'")
    return e.groupBy(F.concat(F.lit("bank"), (F.col("user_id") % 3).cast("string")).alias("bank")).agg(F.count("*").alias("probes"), F.bround(F.avg(F.col("event_id") % 997), 0).cast("long").alias("avg_latency"), F.round(F.avg(F.col("event_id") % 7), 1).alias("avg_results"))


@query("agg_recall_write_ratio", f"WITH {CALL}, {SERVER}, g AS (SELECT server, count(*) AS recalls, count(*) FILTER (hit) AS hits, CAST(sum(chars%5) AS BIGINT) AS windows FROM srv GROUP BY 1) SELECT server, recalls, hits, round(1-hits::DOUBLE/nullif(recalls,0),3) AS empty_rate, round(windows::DOUBLE/nullif(recalls,0),4) AS writes_per_search FROM g")
def _(i: Inputs):
    n, h = F.count("*"), F.count(F.when(F.col("hit"), 1))
    return served(i).groupBy("server").agg(n.alias("recalls"), h.alias("hits"), F.round(1 - F.try_divide(h.cast("double"), n.cast("double")), 3).alias("empty_rate"), N.ratio(F.sum(F.col("chars") % 5), n, 4).alias("writes_per_search"))


# Means are cut to whole hundredths of integers, so both engines have the same inputs to roll up.
DAILY = """daily AS (SELECT CAST(ts AS DATE) AS day, 'p'||(user_id%2) AS project, count(*) AS sessions, count(*) FILTER (value>50) AS with_recall, count(*) FILTER (value<=50) AS without_recall,
  (CAST(sum(event_id%9) AS BIGINT)*100//count(*))/100.0::DOUBLE AS avg_corrections, (CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT)//count(*))/100.0::DOUBLE AS avg_tokens,
  CASE WHEN day(ts)%3=0 THEN NULL ELSE (CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT)//count(*)//100)/10.0::DOUBLE END AS reduction, CASE WHEN day(ts)%5=0 THEN NULL ELSE '2024-01-0'||(day(ts)%7+1) END AS epoch
  FROM events GROUP BY CAST(ts AS DATE), day(ts), user_id%2)"""


def daily(i: Inputs):
    """Daily reports per project, made from events."""
    v, d, n = F.col("value"), F.dayofmonth("day"), F.count("*")
    cents = F.floor(F.sum(F.round(v * 100).cast("long")) / n)
    g = i.table("events").groupBy(F.to_date("ts").alias("day"), F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("project")).agg(
        n.alias("sessions"), F.count(F.when(v > 50, 1)).alias("with_recall"), F.count(F.when(v <= 50, 1)).alias("without_recall"), (F.floor(F.sum(F.col("event_id") % 9) * 100 / n) / 100).alias("avg_corrections"), (cents / 100).alias("avg_tokens"), (F.floor(cents / 100) / 10).alias("_r")
    )
    return g.withColumns({"reduction": F.when(d % 3 != 0, F.col("_r")), "epoch": F.when(d % 5 != 0, F.concat(F.lit("2024-01-0"), (d % 7 + 1).cast("string")))}).drop("_r")


@query("agg_weighted_rollup", f"WITH {DAILY} SELECT project, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(with_recall) AS BIGINT) AS with_recall, CAST(sum(without_recall) AS BIGINT) AS without_recall, round(sum(avg_corrections*sessions)/sum(sessions),4) AS avg_corrections, round(sum(avg_tokens*sessions)/sum(sessions),4) AS avg_tokens, round(avg(reduction),4) AS avg_reduction_pct, round(sum(with_recall)::DOUBLE/(sum(with_recall)+sum(without_recall))*100,1) AS adoption_pct FROM daily GROUP BY 1")
def _(i: Inputs):
    w, wo = F.sum("with_recall"), F.sum("without_recall")
    return daily(i).groupBy("project").agg(F.sum("sessions").alias("sessions"), w.alias("with_recall"), wo.alias("without_recall"), R.weighted("avg_corrections", "sessions").alias("avg_corrections"), R.weighted("avg_tokens", "sessions").alias("avg_tokens"), F.round(F.avg("reduction"), 4).alias("avg_reduction_pct"), N.percent(w, w + wo).alias("adoption_pct"))


@query("agg_weekly_trend", f"WITH {DAILY} SELECT strftime(day,'%G-W%V') AS week, CAST(sum(sessions) AS BIGINT) AS sessions, round(sum(avg_corrections*sessions)/sum(sessions),4) AS avg_corrections, round(sum(avg_tokens*sessions)/sum(sessions),4) AS avg_tokens FROM daily WHERE sessions>0 GROUP BY 1")
def _(i: Inputs):
    return R.weekly(daily(i), ["avg_corrections", "avg_tokens"])


@query("agg_epoch_latest", f"WITH {DAILY} SELECT project, arg_max(epoch, day) AS epoch FROM daily WHERE epoch IS NOT NULL GROUP BY 1")
def _(i: Inputs):
    return daily(i).where("epoch is not null").groupBy("project").agg(F.max_by("epoch", "day").alias("epoch"))


@query("agg_compare_baselines", f"WITH {DAILY}, m AS (SELECT project, avg(avg_tokens) AS tokens, CAST(sum(sessions) AS DOUBLE) AS sessions FROM daily GROUP BY 1), l AS (SELECT project, 'tokens' AS metric, tokens AS v FROM m UNION ALL SELECT project, 'sessions', sessions FROM m UNION ALL SELECT 'p1','only_after',1.0) SELECT coalesce(a.metric,b.metric) AS metric, round(a.v,4) AS before, round(b.v,4) AS after, round(b.v-a.v,4) AS delta FROM (SELECT * FROM l WHERE project='p0') a FULL JOIN (SELECT * FROM l WHERE project='p1') b ON a.metric=b.metric")
def _(i: Inputs):
    m = daily(i).groupBy("project").agg(F.avg("avg_tokens").alias("tokens"), F.sum("sessions").cast("double").alias("sessions"))
    rows = m.select("project", F.inline(F.array(F.struct(F.lit("tokens").alias("metric"), F.col("tokens").alias("v")), F.struct(F.lit("sessions").alias("metric"), F.col("sessions").alias("v")))))
    rows = rows.unionByName(i.spark.createDataFrame([("p1", "only_after", 1.0)], "project string, metric string, v double"))
    a, b = rows.where("project = 'p0'").select("metric", F.col("v").alias("a")), rows.where("project = 'p1'").select("metric", F.col("v").alias("b"))
    return a.join(b, "metric", "full").select("metric", F.round("a", 4).alias("before"), F.round("b", 4).alias("after"), F.round(F.col("b") - F.col("a"), 4).alias("delta"))


@query("win_prev_day_trend", f"WITH {DAILY}, t AS (SELECT day, project, avg_tokens, lag(avg_tokens) OVER (PARTITION BY project ORDER BY day) AS prev FROM daily) SELECT day, project, avg_tokens, prev, CASE WHEN prev IS NULL THEN NULL WHEN abs(avg_tokens-prev)<0.01 THEN '=' WHEN avg_tokens>prev THEN '↑' ELSE '↓' END AS arrow FROM t")
def _(i: Inputs):
    prev = F.lag("avg_tokens").over(Window.partitionBy("project").orderBy("day"))
    return daily(i).withColumn("prev", prev).select("day", "project", "avg_tokens", "prev", F.when(F.col("prev").isNotNull(), N.trend_arrow(F.col("avg_tokens"), F.col("prev"))).alias("arrow"))


LAST_TWO = "r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY day DESC) AS k FROM daily), two AS (SELECT a.project AS project, a.day AS day, b.day AS past, a.avg_tokens AS tokens, b.avg_tokens AS old FROM r a LEFT JOIN r b ON b.project=a.project AND b.k=2 WHERE a.k=1)"


@query("sink_markdown_dashboard", f"WITH {DAILY}, {LAST_TWO} SELECT '# Dashboard' AS line UNION ALL SELECT '| project | latest | previous | tokens | trend |' UNION ALL SELECT '|-|-|-|-|-|' UNION ALL SELECT '| '||project||' | '||day||' | '||coalesce(CAST(past AS VARCHAR), 'none')||' | '||printf('%.2f', tokens)||' | '||CASE WHEN old IS NULL OR abs(tokens-old)<0.01 THEN '=' WHEN tokens>old THEN '↑' ELSE '↓' END||' |' FROM two")
def _(i: Inputs):
    two = daily(i).withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("day")))).where("k <= 2")
    first = lambda k, c: F.first(F.when(F.col("k") == k, F.col(c)), ignorenulls=True)
    rows = two.groupBy("project").agg(first(1, "day").alias("day"), first(2, "day").alias("past"), first(1, "avg_tokens").alias("tokens"), first(2, "avg_tokens").alias("old"))
    rows = rows.withColumn("trend", F.when(F.col("old").isNull(), "=").otherwise(N.trend_arrow(F.col("tokens"), F.col("old")))).orderBy("project").collect()  # a row per project
    at = f"{files.scratch(i.spark, 'query')}/dashboard.md"
    table = [f"| {r.project} | {r.day} | {r.past or 'none'} | {r.tokens:.2f} | {r.trend} |" for r in rows]
    files.write_lines(i.spark, at, ["# Dashboard", "| project | latest | previous | tokens | trend |", "|-|-|-|-|-|", *table])
    return i.spark.read.text(at).withColumnRenamed("value", "line")


@query("rep_adoption_verdict", f"WITH {DAILY} SELECT day, project, CASE WHEN p<50 THEN 'warning' WHEN p>=80 THEN 'healthy' END AS verdict FROM (SELECT day, project, with_recall*100.0/sessions AS p FROM daily)")
def _(i: Inputs):
    p = F.col("with_recall") * 100.0 / F.col("sessions")
    return daily(i).select("day", "project", F.when(p < 50, "warning").when(p >= 80, "healthy").alias("verdict"))


@query("rep_daily_trend_last7", f"WITH {CALL}, {SERVER}, r AS (SELECT day, server, dense_rank() OVER (ORDER BY day DESC) AS k FROM srv) SELECT day, server, count(*) AS calls FROM r WHERE k<=7 GROUP BY 1,2")
def _(i: Inputs):
    # aggregated first: the ranking sees a row per day, and no row of the log
    g = served(i).groupBy("day", "server").agg(F.count("*").alias("calls"))
    days = g.select("day").distinct().orderBy(F.desc("day")).limit(7)
    return g.join(F.broadcast(days), "day", "left_semi")


@query("agg_freshness", f"WITH {CALL}, {SERVER} SELECT server, round((epoch_us(TIMESTAMP '{AS_OF}')-epoch_us(max(ts)))/3.6e9,2) AS stale_hours, round((epoch_us(TIMESTAMP '{AS_OF}')-epoch_us(max(ts)))/6e7,1) AS stale_minutes FROM srv GROUP BY 1")
def _(i: Inputs):
    gap = F.unix_micros(F.to_timestamp(F.lit(AS_OF))) - F.unix_micros(F.max("ts").cast("timestamp"))
    return served(i).groupBy("server").agg(F.round(gap / 3.6e9, 2).alias("stale_hours"), F.round(gap / 6e7, 1).alias("stale_minutes"))


@query("rep_freshness_verdict", f"SELECT event_type, CASE WHEN event_type<>'view' THEN 'uptime only' WHEN (epoch_us(TIMESTAMP '{AS_OF}')-epoch_us(max(ts)))/3.6e9 <= 5.0/60 THEN 'Healthy' ELSE 'STALE' END AS verdict FROM events GROUP BY 1")
def _(i: Inputs):
    gap = (F.unix_micros(F.to_timestamp(F.lit(AS_OF))) - F.unix_micros(F.max("ts").cast("timestamp"))) / 3.6e9
    return i.table("events").groupBy("event_type").agg(gap.alias("h")).select("event_type", F.when(F.col("event_type") != "view", "uptime only").when(F.col("h") <= 5 / 60, "Healthy").otherwise("STALE").alias("verdict"))


@query("agg_cost_usage", "SELECT event_type, CAST(sum(event_id%100) AS BIGINT) AS input_tokens, CAST(sum(event_id%10) AS BIGINT) AS output_tokens, CAST(sum(event_id%100+event_id%10) AS BIGINT) AS total_tokens FROM events GROUP BY 1")
def _(i: Inputs):
    a, b = F.col("event_id") % 100, F.col("event_id") % 10
    return i.table("events").groupBy("event_type").agg(F.sum(a).alias("input_tokens"), F.sum(b).alias("output_tokens"), F.sum(a + b).alias("total_tokens"))


@query("agg_recall_quality", f"WITH {CALL} SELECT coalesce(bank,'none') AS bank, count(*) AS results, CAST(sum(chars%4) AS BIGINT) AS chunks, CAST(sum(chars//4) AS BIGINT) AS approx_tokens, round(avg(CASE WHEN h>=0 THEN h END),2) AS avg_staleness FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-20 00:00:00')/3.6e9-epoch_us(ts)/3.6e9 AS h FROM call) GROUP BY 1")
def _(i: Inputs):
    h = F.unix_micros(F.to_timestamp(F.lit("2024-01-20 00:00:00"))) / 3.6e9 - F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    return i.calls().groupBy(F.coalesce("bank", F.lit("none")).alias("bank")).agg(F.count("*").alias("results"), F.sum(F.col("chars") % 4).alias("chunks"), F.sum(N.tokens_floored(F.col("chars"))).alias("approx_tokens"), F.round(F.avg(F.when(h >= 0, h)), 2).alias("avg_staleness"))


@query("agg_bank_stats", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k, user_id AS nodes, event_id%13 AS links FROM events WHERE event_type='signup'")
def _(i: Inputs):
    stats = F.from_json(F.concat(F.lit('{"total_nodes":'), F.col("user_id").cast("string"), F.lit(',"total_links":'), (F.col("event_id") % 13).cast("string"), F.lit("}")), "total_nodes long, total_links long")
    return i.table("events").where("event_type = 'signup'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), stats["total_nodes"].alias("nodes"), stats["total_links"].alias("links"))


@query("agg_coverage", "SELECT source, count(*) AS total, count(l.doc_id) AS indexed, round(count(l.doc_id)::DOUBLE/count(*)*100,1) AS pct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def _(i: Inputs):
    l = i.table("labels").select("doc_id", F.lit(1).alias("k")).distinct()
    return i.table("documents").join(l, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("k").alias("indexed"), N.percent(F.count("k"), F.count("*")).alias("pct"))


LINE = "CASE event_id%7 WHEN 0 THEN '' WHEN 1 THEN '{bad' ELSE '{\"id\":'||event_id||',\"project\":'||CASE WHEN event_id%3=0 THEN 'null' ELSE '\"p'||(event_id%2)||'\"' END||'}' END"


@query("scan_jsonl_tolerant", "SELECT event_id AS id, CASE WHEN event_id%3=0 THEN NULL ELSE 'p'||(event_id%2) END AS project FROM events WHERE event_id%7>1")
def _(i: Inputs):
    lines = i.table("events").select(F.expr(LINE).alias("value"))
    return IO.parsed_lines(lines, "id long, project string").select("row.id", "row.project")


@query("agg_pending_count", "SELECT count(*) AS unscoped, count(*) FILTER (event_id%7>1 AND event_id%3<>0 AND event_id%2=1) AS scoped FROM events WHERE event_id%7>0")
def _(i: Inputs):
    row = F.from_json(F.when(F.try_parse_json("value").isNotNull(), F.col("value")), "id long, project string")
    lines = i.table("events").select(F.expr(LINE).alias("value")).where("value <> ''").withColumn("row", row)
    return lines.agg(F.count("*").alias("unscoped"), F.count(F.when(F.col("row.project") == "p1", 1)).alias("scoped"))


@query("agg_pending_by_project", "SELECT coalesce(CASE WHEN event_id%3=0 THEN NULL ELSE 'p'||(event_id%2) END,'unresolved') AS project, count(*) AS n FROM events WHERE event_id%7>1 GROUP BY 1")
def pending(i: Inputs):
    lines = IO.parsed_lines(i.table("events").select(F.expr(LINE).alias("value")), "id long, project string")
    return lines.groupBy(F.coalesce("row.project", F.lit("unresolved")).alias("project")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project")


@query("sink_pending_doc", f"WITH p AS (SELECT coalesce(CASE WHEN event_id%3=0 THEN NULL ELSE 'p'||(event_id%2) END,'unresolved') AS project FROM events WHERE event_id%7>1) SELECT '- '||project||': '||count(*) AS line FROM p GROUP BY project UNION ALL SELECT '## Last 7 days' UNION ALL SELECT CAST(ts AS DATE)||': '||count(*) FILTER (event_id%2=0)||' shadow, '||count(*) FILTER (event_id%2=1)||' live' FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY CAST(ts AS DATE)")
def _(i: Inputs):
    e = i.table("events").where(F.col("ts") >= F.to_timestamp(F.lit("2024-01-24 00:00:00")))
    days = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("event_id") % 2 == 0, 1)).alias("shadow"), F.count(F.when(F.col("event_id") % 2 == 1, 1)).alias("live")).orderBy(F.desc("day"))
    # a row per project and per day
    lines = [f"- {r.project}: {r.n}" for r in pending(i).collect()] + ["## Last 7 days"] + [f"{r.day}: {r.shadow} shadow, {r.live} live" for r in days.collect()]
    at = f"{files.scratch(i.spark, 'query')}/pending.md"
    files.write_lines(i.spark, at, lines)
    return i.spark.read.text(at).withColumnRenamed("value", "line")


@query("scan_jsonl_last_n_days", "SELECT event_id FROM events WHERE event_id%11=0 OR ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def _(i: Inputs):
    iso = F.when(F.col("event_id") % 11 == 0, "garbled").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("")))
    return i.table("events").where(IO.kept_since(iso, 7, F.to_timestamp(F.lit(AS_OF)))).select("event_id")


@query("scan_jsonl_last_n_days_strict", "SELECT event_id FROM events WHERE event_id%11<>0 AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def _(i: Inputs):
    iso = F.when(F.col("event_id") % 11 == 0, "garbled").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return i.table("events").where(IO.since(iso, 7, F.to_timestamp(F.lit(AS_OF)))).select("event_id")


def report_files(i: Inputs) -> str:
    """A folder of daily reports as JSON files, one a project and day, and one a day under the day's name; some broken, some without date."""
    root = files.scratch(i.spark, "reports")
    rows = daily(i).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "project", "sessions").collect()  # a row per project and day
    for r in rows:
        files.write_text(i.spark, f"{root}/{r.day}-{r.project}.json", f'{{"date": "{r.day}",\n "project": "{r.project}", "sessions": {r.sessions}}}')
        date = f'"date": "{r.day}", ' if int(r.day[-2:]) % 2 else ""
        files.write_text(i.spark, f"{root}/{r.day}.json", f'{{{date}"project": "all"}}')
    files.write_text(i.spark, f"{root}/2023-12-31.json", '{"date": broken')
    files.write_text(i.spark, f"{root}/notes.json", '{"date": "no report"}')
    return root


@query("scan_daily_logs", f"WITH {DAILY} SELECT day, project, sessions FROM daily WHERE day > DATE '2024-01-23' AND day <= DATE '2024-01-30' AND project='p0'")
def _(i: Inputs):
    return IO.daily_logs(i.spark, report_files(i), "date date, project string, sessions long", 7, "2024-01-30", "-p0").withColumnRenamed("date", "day")


@query("scan_all_daily_reports", "SELECT DISTINCT strftime(ts,'%Y-%m-%d') AS date FROM events")
def _(i: Inputs):
    return IO.daily_reports(i.spark, report_files(i), "date string, project string").select("date").orderBy("date")


@query("scan_log_last_match", "SELECT event_type AS category, date_trunc('milliseconds', max(ts)) AS last FROM events WHERE event_type IN ('view','error') GROUP BY 1")
def _(i: Inputs):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO did "), F.col("event_type"))
    at = files.scratch(i.spark, "log")
    i.table("events").select(line).write.mode("append").text(at)
    found = IO.log_last_match(i.spark, at, {"view": "did view", "error": "did error"})
    return found.withColumn("last", F.col("last").cast("timestamp_ntz"))


def aged_files(i: Inputs) -> str:
    """A folder of transcripts ``f<age>-<k>.jsonl``, changed so many hours before AS_OF."""
    root, now = files.scratch(i.spark, "aged"), i.spark.sql(f"SELECT unix_millis(TIMESTAMP '{AS_OF}')").first()[0]
    for r in i.table("pages").select((F.col("page_id") % 50).alias("age"), (F.col("page_id") % 3).alias("k")).distinct().collect():  # 150 at most
        folder = "Users-a-x" if r.k == 0 else "other"
        files.write_text(i.spark, f"{root}/{folder}/f{r.age}-{r.k}.jsonl", "{}\n", now - r.age * 3_600_000)
    return root


def file_name(c: str = "path"):
    return F.regexp_extract(c, r"([^/]+)\.jsonl$", 1).alias("name")


@query("scan_recent_files", "SELECT DISTINCT 'f'||(page_id%50)||'-0' AS name, page_id%50 AS age FROM pages WHERE page_id%50 <= 24 AND page_id%3=0")
def _(i: Inputs):
    now = F.to_timestamp(F.lit(AS_OF))
    rows = IO.recent_files(i.spark, aged_files(i), "*.jsonl", now - F.expr("INTERVAL 24 HOURS"), ["Users-a"])
    return rows.select(file_name(), ((F.unix_millis(now) - F.unix_millis("modified")) / 3_600_000).cast("long").alias("age"))


@query("scan_all_files_max_age", "SELECT DISTINCT 'f'||(page_id%50)||'-'||(page_id%3) AS name FROM pages WHERE page_id%50 <= 30")
def _(i: Inputs):
    return IO.recent_files(i.spark, aged_files(i), "*.jsonl", F.to_timestamp(F.lit(AS_OF)) - F.expr("INTERVAL 30 HOURS")).select(file_name())


PATH = "CASE doc_id%6 WHEN 0 THEN 'a/main.go' WHEN 1 THEN 'vendor/x/b.go' WHEN 2 THEN 'pkg/c_test.go' WHEN 3 THEN 'web/d.ts' WHEN 4 THEN 'deep/er/e.tsx' ELSE 'README.md' END"


@query("scan_glob_include_exclude", f"SELECT DISTINCT p AS path FROM (SELECT {PATH} AS p FROM documents) WHERE p IN ('a/main.go','web/d.ts','deep/er/e.tsx')")
def globbed(i: Inputs):
    p = i.table("documents").select(F.expr(PATH).alias("path"))
    return p.where(IO.included(F.col("path"), ["**/*.go", "**/*.ts", "**/*.tsx"], ["vendor/**", "**/*_test.go"])).distinct().orderBy("path")


@query("setop_distinct_files", f"SELECT DISTINCT p AS path FROM (SELECT {PATH} AS p FROM documents) WHERE p LIKE '%.go' UNION SELECT DISTINCT p FROM (SELECT {PATH} AS p FROM documents) WHERE p LIKE 'web/%'")
def _(i: Inputs):
    p = i.table("documents").select(F.expr(PATH).alias("path"))
    return p.where(IO.included(F.col("path"), ["**/*.go"])).union(p.where(IO.included(F.col("path"), ["web/**"]))).distinct()


@query("scan_issue_cli", "SELECT 'issue' AS kind, event_id, false AS failed FROM events WHERE event_type='error' UNION ALL SELECT 'pr', event_id, false FROM events WHERE event_type='signup' UNION ALL SELECT 'discussion', NULL, true")
def _(i: Inputs):
    e, at = i.table("events"), files.scratch(i.spark, "listings")
    for kind, t in (("issue", "error"), ("pr", "signup")):
        e.where(F.col("event_type") == t).select("event_id").write.json(f"{at}/{kind}")
    # stand-ins for a tracker's command line; the third is of a kind that is not there
    place = at.removeprefix("file://")
    found = command_items(i.spark, {kind: ["sh", "-c", 'cat "$0"/part-*', f"{place}/{kind}"] for kind in ("issue", "pr", "discussion")})
    return found.select("kind", F.get_json_object("item", "$.event_id").cast("long").alias("event_id"), F.col("error").isNotNull().alias("failed"))


@query("setop_union_kinds", "SELECT kind, count(*) AS n FROM (SELECT 'issue' AS kind FROM events WHERE event_type='error' UNION ALL SELECT 'pr' FROM events WHERE event_type IN ('error','signup')) GROUP BY 1")
def _(i: Inputs):
    e = i.table("events")
    both = e.where("event_type = 'error'").select(F.lit("issue").alias("kind")).unionByName(e.where("event_type in ('error','signup')").select(F.lit("pr").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("sink_csv", f"WITH {CALL}, {SERVER} SELECT day AS date, server, count(*) AS calls, NULL AS hits, NULL AS misses, NULL AS hit_rate FROM srv GROUP BY 1,2")
def _(i: Inputs):
    none, at = F.lit(None).cast("string"), files.scratch(i.spark, "csv")
    rows = served(i).groupBy(F.col("day").alias("date"), "server").agg(F.count("*").alias("calls")).select("date", "server", "calls", none.alias("hits"), none.alias("misses"), none.alias("hit_rate"))
    IO.write_csv(rows, at, "date", "server")
    return i.spark.read.option("header", True).schema("date date, server string, calls long, hits string, misses string, hit_rate string").csv(at)


@query("sort_csv", f"WITH {CALL} SELECT day, raw_server, count(*) AS calls FROM call GROUP BY 1,2")
def _(i: Inputs):
    return i.calls().groupBy("day", "raw_server").agg(F.count("*").alias("calls")).orderBy("day", "raw_server")


@query("sink_snapshot_json", f"WITH {DAILY} SELECT project, '{{\"project\":\"'||project||'\",\"sessions\":'||CAST(sum(sessions) AS BIGINT)||'}}' AS snapshot FROM daily GROUP BY 1")
def _(i: Inputs):
    rows = daily(i).groupBy("project").agg(F.sum("sessions").alias("sessions")).select("project", F.to_json(F.struct("project", "sessions")).alias("snapshot"))
    root = files.scratch(i.spark, "snapshot")
    for r in rows.collect():  # a row per project
        files.write_text(i.spark, f"{root}/{r.project}.json", r.snapshot)
    return i.spark.read.text(root).select(F.get_json_object("value", "$.project").alias("project"), F.col("value").alias("snapshot"))
