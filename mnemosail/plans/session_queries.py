"""Transcript windows, session metrics, and their rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import rollups as R
from ..operators import sessions as S
from .inputs import BANKS, CODE_BANK, MSG, Inputs
from .registry import query
from .stream_queries import deliveries
from .text_queries import CORR, INST

PARSED = f"""{MSG}, p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY raw_idx)-1 AS i, role='user' AND coalesce({CORR},false) AS fix, role='user' AND coalesce({INST},false) AS rule,
  CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END||': '||substr(text,1,300) AS line FROM msg WHERE role IN ('user','assistant') AND coalesce(text,'')<>'')"""
WIN = f"""{PARSED}, w AS (SELECT c.t, c.raw_idx, c.i, CASE WHEN c.fix THEN 'CORRECTION' ELSE 'INSTRUCTION' END AS tag,
  string_agg(CASE WHEN n.i=c.i THEN '['||CASE WHEN c.fix THEN 'CORRECTION' ELSE 'INSTRUCTION' END||'] ' ELSE '' END||n.line, chr(10)||chr(10) ORDER BY n.i) AS win
  FROM p c JOIN p n ON n.t=c.t AND n.i BETWEEN c.i-2 AND c.i+2 WHERE c.fix OR c.rule GROUP BY ALL)"""
ANN = f"""{MSG}, a0 AS (SELECT *, length(text) AS chars, role='assistant' AS asst, coalesce(tool IN ('Write','Shell'),false) AS prod, coalesce(tool IN ('Read','Grep'),false) AS expl, server IS NOT NULL AS rec,
  role='user' AND coalesce({CORR},false) AS fix, role='user' AND regexp_matches(text,'(?i)\\b(recall|memory|hindsight|remember)\\b') AS asks FROM msg),
ann AS (SELECT *, sum(CAST(asst AS INT)) OVER o AS turn, sum(chars) OVER o AS running, sum(chars) OVER (PARTITION BY t) AS total, count(*) OVER (PARTITION BY t) AS messages,
  min(CASE WHEN prod THEN raw_idx END) OVER (PARTITION BY t) AS pat FROM a0 WINDOW o AS (PARTITION BY t ORDER BY raw_idx)),
fixes AS (SELECT t, raw_idx, (coalesce(lead(running) OVER (PARTITION BY t ORDER BY raw_idx), total)-running)//2 AS rework FROM ann WHERE fix),
ses0 AS (SELECT ann.t AS t, count(*) AS messages, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (fix) AS corrections, count(*) FILTER (prod) AS productive_actions, CAST(max(turn) AS BIGINT) AS turns, count(*) FILTER (rec) AS recall_turns,
  min(CASE WHEN rec THEN turn END) AS frt, bool_or(asks) AS asked, CAST(min(CASE WHEN prod THEN turn END) AS BIGINT) AS fpt, CAST(sum(CASE WHEN role IN ('user','assistant') AND (pat IS NULL OR ann.raw_idx<pat) THEN chars ELSE 0 END) AS BIGINT) AS pre,
  CAST(coalesce(sum(rework),0) AS BIGINT) AS rework_chars, count(*) FILTER (expl AND (pat IS NULL OR ann.raw_idx<pat)) AS exploration_before_productive,
  coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN server LIKE '%hindsight-docs' THEN 'hindsight-docs' WHEN server LIKE '%cocoindex-code' THEN 'cocoindex-code' END) FILTER (server IS NOT NULL))),','),'') AS banks
  FROM ann LEFT JOIN fixes ON fixes.t=ann.t AND fixes.raw_idx=ann.raw_idx WHERE messages>=6 GROUP BY ann.t),
ses1 AS (SELECT *, recall_turns>0 AS has_recall, coalesce(fpt,turns) AS first_productive_turn, CAST(round_even(pre/4.0,0) AS BIGINT) AS context_loading_tokens, CAST(round_even(chars/4.0,0) AS BIGINT) AS total_tokens, CAST(round_even(rework_chars/4.0,0) AS BIGINT) AS rework_tokens FROM ses0),
ses AS (SELECT *, CASE WHEN total_tokens<5000 THEN 'trivial' WHEN total_tokens<15000 THEN 'small' WHEN total_tokens<100000 THEN 'medium' ELSE 'large' END AS size_bucket, has_recall AND (NOT asked OR frt=1) AS proactive,
  CASE WHEN total_tokens>0 THEN round(productive_actions/(total_tokens/1000.0::DOUBLE),4) ELSE 0.0 END AS productivity_density, CASE WHEN total_tokens>0 THEN round(rework_tokens::DOUBLE/total_tokens,4) ELSE 0.0 END AS rework_ratio FROM ses1)"""


def sessions(i: Inputs):
    return S.facts(i.blocks(), BANKS)


@query("win_parsed_index", f"WITH {PARSED} SELECT t, raw_idx, i FROM p")
def _(i: Inputs):
    return S.parsed(i.messages()).select("t", "raw_idx", "i")


@query("win_learning_windows", f"WITH {WIN} SELECT t, raw_idx, i, tag, win AS \"window\" FROM w")
def windows(i: Inputs):
    return S.learning_windows(i.messages())


@query("win_document_id", f"WITH {WIN} SELECT t, raw_idx, 'transcript-'||t||'-w'||substr(sha1(win),1,16) AS document_id FROM w")
def _(i: Inputs):
    w = S.learning_windows(i.messages())
    return w.select("t", "raw_idx", S.window_document_id(F.col("t"), F.col("window")).alias("document_id"))


@query("win_running_chars", f"WITH {ANN} SELECT t, raw_idx, CAST(running AS BIGINT) AS running FROM ann")
def _(i: Inputs):
    return S.annotated(i.blocks()).select("t", "raw_idx", "running")


@query("win_rework_tokens", f"WITH {ANN} SELECT t, rework_tokens FROM ses")
def _(i: Inputs):
    return sessions(i).select("t", "rework_tokens")


@query("win_first_productive_turn", f"WITH {ANN} SELECT t, first_productive_turn FROM ses")
def _(i: Inputs):
    return sessions(i).select("t", "first_productive_turn")


@query("win_preamble_chars", f"WITH {ANN} SELECT t, pre AS preamble_chars, context_loading_tokens FROM ses")
def _(i: Inputs):
    return sessions(i).select("t", "preamble_chars", "context_loading_tokens")


@query("win_exploration_before_productive", f"WITH {ANN} SELECT t, exploration_before_productive FROM ses")
def _(i: Inputs):
    return sessions(i).select("t", "exploration_before_productive")


@query("win_proactive_recall", f"WITH {ANN} SELECT t, has_recall, proactive FROM ses")
def _(i: Inputs):
    return sessions(i).select("t", "has_recall", "proactive")


COST = f"""{MSG}, c0 AS (SELECT *, length(text) AS chars, role='user' AND regexp_matches(substr(text,1,500), '(?i){'|'.join('(?:'+p+')' for p in T.P.CORRECTION).replace("'", "''")}') AS fix,
  sum(CAST(role='user' AS INT)) OVER (PARTITION BY t ORDER BY raw_idx) - CAST(role='user' AS INT) AS seg FROM msg),
c1 AS (SELECT *, coalesce(last_value(CASE WHEN role='assistant' THEN chars END IGNORE NULLS) OVER (PARTITION BY t, seg ORDER BY raw_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS prev FROM c0),
con AS (SELECT t, CAST(sum(chars) AS BIGINT)//4 AS tokens, count(*) FILTER (role='user') AS user_msgs, count(*) FILTER (role='assistant') AS assistant_msgs, count(tool) AS tool_calls, count(*) FILTER (fix) AS corrections,
  CAST(sum(CASE WHEN fix THEN prev+chars ELSE 0 END) AS BIGINT)//4 AS correction_cost_tokens, bool_or(server IS NOT NULL) AS has_recall FROM c1 GROUP BY t HAVING count(*) FILTER (role='user')>=2)"""


@query("win_correction_cost", f"WITH {COST} SELECT t, corrections, correction_cost_tokens FROM con")
def _(i: Inputs):
    return S.consumption(i.blocks()).select("t", "corrections", "correction_cost_tokens")


@query("agg_token_consumption", f"WITH {COST} SELECT t, tokens, user_msgs, assistant_msgs, tool_calls, corrections, correction_cost_tokens, has_recall, tokens//user_msgs AS tokens_per_request, round(tool_calls::DOUBLE/user_msgs,1) AS tool_calls_per_request FROM con")
def _(i: Inputs):
    return S.consumption(i.blocks()).drop("chars", "cost_chars")


@query("agg_token_efficiency", f"""WITH {COST}, g AS (SELECT has_recall, count(*) AS sessions, CAST(round_even(avg(tokens//user_msgs),0) AS BIGINT) AS per_request, CAST(sum(correction_cost_tokens) AS BIGINT) AS cost FROM con GROUP BY 1)
SELECT coalesce(a.sessions,0) AS with_recall, coalesce(b.sessions,0) AS without_recall, round((b.per_request-a.per_request)*100.0::DOUBLE/nullif(b.per_request,0),1) AS efficiency_pct, coalesce(a.cost,0)+coalesce(b.cost,0) AS total_cost FROM (SELECT 1 AS one) LEFT JOIN g a ON a.has_recall LEFT JOIN g b ON NOT b.has_recall""")
def _(i: Inputs):
    c, r = S.consumption(i.blocks()), F.col("has_recall")
    per = lambda w: F.bround(F.avg(F.when(w, F.col("tokens_per_request").cast("double"))), 0)
    return c.agg(F.count(F.when(r, 1)).alias("with_recall"), F.count(F.when(~r, 1)).alias("without_recall"), F.round(F.try_divide((per(~r) - per(r)) * 100, per(~r)), 1).alias("efficiency_pct"), F.sum("correction_cost_tokens").alias("total_cost"))


@query("agg_session_metrics", f"WITH {ANN} SELECT t, messages, corrections, productive_actions, turns, recall_turns, has_recall, proactive, first_productive_turn, context_loading_tokens, total_tokens, rework_tokens, rework_ratio, productivity_density, size_bucket, exploration_before_productive, banks FROM ses")
def _(i: Inputs):
    cols = "t messages corrections productive_actions turns recall_turns has_recall proactive first_productive_turn context_loading_tokens total_tokens rework_tokens rework_ratio productivity_density size_bucket exploration_before_productive".split()
    return sessions(i).select(*cols, F.array_join("banks_recalled", ",").alias("banks"))


@query("agg_size_bucket", "SELECT doc_id, CASE WHEN n_chars<5000 THEN 'trivial' WHEN n_chars<15000 THEN 'small' WHEN n_chars<100000 THEN 'medium' ELSE 'large' END AS bucket FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", N.size_bucket(F.col("n_chars")).alias("bucket"))


@query("agg_session_distribution", f"WITH {ANN} SELECT b AS size_bucket, count(*) FILTER (has_recall) AS with_recall, count(*) FILTER (NOT has_recall) AS without_recall FROM (SELECT unnest(['trivial','small','medium','large']) AS b) LEFT JOIN ses ON size_bucket=b GROUP BY 1")
def _(i: Inputs):
    return R.distribution(sessions(i))


def avg(c: str, w: str) -> str:
    return f"coalesce(round(avg({c}) FILTER ({w}),2),0.0)"


SOLID = "has_recall AND size_bucket<>'trivial'"


@query("agg_effectiveness_daily", f"""WITH {ANN} SELECT count(*) FILTER (has_recall) AS sessions_with_recall, count(*) FILTER (NOT has_recall) AS sessions_without_recall, {avg('corrections','has_recall')} AS corrections_with, {avg('corrections','NOT has_recall')} AS corrections_without,
 coalesce(round(count(*) FILTER (has_recall)::DOUBLE/nullif(count(*),0)*100,1),0.0) AS recall_adoption_pct, count(*) FILTER (proactive) AS proactive_sessions, coalesce(round(count(*) FILTER (proactive)::DOUBLE/nullif(count(*),0)*100,1),0.0) AS proactive_pct,
 CAST(coalesce(sum(turns),0) AS BIGINT) AS agent_turns, CAST(coalesce(sum(recall_turns),0) AS BIGINT) AS recall_turns, coalesce(round(sum(recall_turns)::DOUBLE/nullif(sum(turns),0)*100,1),0.0) AS turn_recall_pct, count(*) FILTER ({SOLID}) AS solid_sessions,
 {avg('corrections',SOLID)} AS avg_corrections, round({avg('rework_ratio',SOLID)}*100,2) AS avg_rework_pct, {avg('productivity_density',SOLID)} AS avg_productivity_density, {avg('first_productive_turn',SOLID)} AS avg_first_productive_turn, {avg('total_tokens',SOLID)} AS avg_total_tokens,
 {avg('context_loading_tokens',SOLID)} AS avg_context_loading_tokens, {avg('messages','has_recall')} AS messages_with, {avg('messages','NOT has_recall')} AS messages_without FROM ses""")
def _(i: Inputs):
    return R.effectiveness(sessions(i))


@query("agg_exploration_efficiency", f"WITH {ANN} " + " UNION ALL ".join(f"SELECT '{k}' AS cohort, count(*) FILTER ({w}) AS sessions, {avg('exploration_before_productive', w)} AS avg_exploration FROM ses" for k, w in {"with_recall": "has_recall", "without_recall": "NOT has_recall", "with_code": "has_recall AND contains(banks,'cocoindex-code')", "without_code": "NOT contains(banks,'cocoindex-code')"}.items()))
def _(i: Inputs):
    return R.exploration(sessions(i), CODE_BANK)


@query("rep_exploration_delta", f"WITH {ANN}, e AS (SELECT {avg('exploration_before_productive','has_recall')} AS w, {avg('exploration_before_productive','NOT has_recall')} AS wo FROM ses) SELECT CASE WHEN wo>0 THEN CAST(round_even((1-w/wo)*100,0) AS BIGINT) ELSE 0 END AS delta_pct, round(wo-w,2) AS calls_saved FROM e")
def _(i: Inputs):
    e = R.exploration(sessions(i), CODE_BANK).groupBy().pivot("cohort", ["with_recall", "without_recall"]).agg(F.first("avg_exploration"))
    w, wo = F.col("with_recall"), F.col("without_recall")
    return e.select(F.coalesce(F.bround((1 - F.try_divide(w, wo)) * 100, 0).cast("long"), F.lit(0)).alias("delta_pct"), F.round(wo - w, 2).alias("calls_saved"))


@query("rep_correction_cost_usd", f"WITH {COST} SELECT CAST(sum(correction_cost_tokens) AS BIGINT) AS wasted_tokens, round(sum(correction_cost_tokens)*3/1e6,4) AS usd FROM con")
def _(i: Inputs):
    s = F.sum("correction_cost_tokens")
    return S.consumption(i.blocks()).agg(s.alias("wasted_tokens"), F.round(s * 3 / 1e6, 4).alias("usd"))


@query("join_watermark", "WITH s AS (SELECT conv_id AS t, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id AS t, turn AS raw_idx FROM conversations JOIN s ON s.t=conv_id WHERE n > CASE WHEN conv_id%3=0 THEN 2 WHEN conv_id%3=1 THEN 100 ELSE 0 END AND turn >= CASE WHEN conv_id%3=0 THEN 2 WHEN conv_id%3=1 THEN 100 ELSE 0 END")
def _(i: Inputs):
    from ..streaming.progress import new_messages

    c = i.table("conversations").select(F.col("conv_id").alias("t"), F.col("turn").alias("raw_idx"))
    marks = c.select("t").distinct().where("t % 3 < 2").select("t", F.when(F.col("t") % 3 == 0, 2).otherwise(100).alias("message_count"))
    return new_messages(c, marks)


@query("anti_join_seen_hashes", f"WITH {WIN}, h AS (SELECT DISTINCT sha256(win) AS hash FROM w) SELECT hash FROM h WHERE hash NOT IN (SELECT sha256(win) FROM w WHERE t%2=0)")
def _(i: Inputs):
    from ..operators.memory import unseen

    w = S.learning_windows(i.messages())
    seen = w.where("t % 2 = 0").select(F.sha2(F.col("window").cast("binary"), 256).alias("hash")).distinct()
    return unseen(w, seen, "window", "t", "raw_idx").select("hash")


@query("setop_except_seen", f"WITH {WIN} SELECT sha256(win) AS hash FROM w EXCEPT SELECT sha256(win) FROM w WHERE t%2=0")
def _(i: Inputs):
    w = S.learning_windows(i.messages()).withColumn("hash", F.sha2(F.col("window").cast("binary"), 256))
    return w.select("hash").exceptAll(w.where("t % 2 = 0").select("hash")).distinct().join(w.where("t % 2 = 0").select("hash").distinct(), "hash", "left_anti")


@query("join_classifier_cache", f"WITH {MSG}, u AS (SELECT t, raw_idx, text, sha256(text) AS hash FROM msg WHERE role='user'), cache AS (SELECT DISTINCT hash FROM u WHERE t%2=0) SELECT t, raw_idx, cache.hash IS NOT NULL AS cached, CASE WHEN cache.hash IS NOT NULL THEN true ELSE coalesce({CORR},false) END AS is_correction FROM u LEFT JOIN cache USING (hash)")
def _(i: Inputs):
    from ..operators.memory import classified

    u = i.messages().where("role = 'user'")
    cache = u.where("t % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.lit(True).alias("is_correction")).distinct()
    return classified(u, cache, "text", T.is_correction).select("t", "raw_idx", "cached", "is_correction")


@query("agg_regex_vs_model", f"WITH {MSG}, u AS (SELECT coalesce({CORR},false) AS rx, (t+raw_idx)%4=0 AS model FROM msg WHERE role='user') SELECT count(*) AS n, count(*) FILTER (rx) AS regex_flagged, count(*) FILTER (model) AS model_flagged, round(count(*) FILTER (rx AND model)::DOUBLE/nullif(count(*) FILTER (model),0)*100,1) AS recall_pct, round(count(*) FILTER (rx AND model)::DOUBLE/nullif(count(*) FILTER (rx),0)*100,1) AS precision_pct FROM u")
def _(i: Inputs):
    u = i.messages().where("role = 'user'").select(T.is_correction(F.col("text")).alias("rx"), ((F.col("t") + F.col("raw_idx")) % 4 == 0).alias("model"))
    n = lambda c: F.count(F.when(c, 1))
    rx, m = F.col("rx"), F.col("model")
    return u.agg(F.count("*").alias("n"), n(rx).alias("regex_flagged"), n(m).alias("model_flagged"), N.percent(n(rx & m), n(m)).alias("recall_pct"), N.percent(n(rx & m), n(rx)).alias("precision_pct"))


@query("agg_prefilter_stats", f"WITH {MSG}, u AS (SELECT coalesce({CORR},false) AS model, regexp_matches(text, '(?i){'|'.join('(?:'+p+')' for p in T.P.LOOSE_CUES).replace("'", "''")}') AS sent FROM msg WHERE role='user') SELECT count(*) AS n, count(*) FILTER (sent) AS would_send, round((1-count(*) FILTER (sent)::DOUBLE/nullif(count(*),0))*100,1) AS reduction_pct, count(*) FILTER (sent AND model) AS caught, round(count(*) FILTER (sent AND model)::DOUBLE/nullif(count(*) FILTER (model),0)*100,1) AS recall_pct FROM u")
def _(i: Inputs):
    u = i.messages().where("role = 'user'").select(T.is_correction(F.col("text")).alias("m"), T.loose_prefilter(F.col("text")).alias("s"))
    n = lambda c: F.count(F.when(c, 1))
    s, m = F.col("s"), F.col("m")
    return u.agg(F.count("*").alias("n"), n(s).alias("would_send"), F.round((1 - F.try_divide(n(s).cast("double"), F.count("*").cast("double"))) * 100, 1).alias("reduction_pct"), n(s & m).alias("caught"), N.percent(n(s & m), n(m)).alias("recall_pct"))


@query("agg_confusion_prf", "WITH x AS (SELECT count(*) FILTER (quality=1 AND toxic=0) AS tp, count(*) FILTER (quality<>1 AND toxic=0) AS fp, count(*) FILTER (quality=1 AND toxic<>0) AS fn, count(*) FILTER (quality<>1 AND toxic<>0) AS tn FROM labels), y AS (SELECT *, coalesce(tp::DOUBLE/nullif(tp+fp,0),0) AS p, coalesce(tp::DOUBLE/nullif(tp+fn,0),0) AS r FROM x) SELECT tp, fp, fn, tn, round(p,4) AS precision, round(r,4) AS recall, round(coalesce(2*p*r/nullif(p+r,0),0),4) AS f1 FROM y")
def _(i: Inputs):
    return R.confusion(i.table("labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query("retain_routing", f"""WITH {WIN} SELECT t, raw_idx, CASE WHEN tag='INSTRUCTION' THEN 'instruction' WHEN raw_idx%3=1 THEN 'correction,supersedes-prior-memory' ELSE 'correction' END AS tags FROM w WHERE tag='INSTRUCTION' OR raw_idx%3<>2""")
def _(i: Inputs):
    from ..operators.memory import routed

    k = F.col("raw_idx") % 3
    w = S.learning_windows(i.messages()).withColumn("action", F.when(k == 0, "retain").when(k == 1, "auto_resolved").otherwise("queued"))
    return routed(w).select("t", "raw_idx", F.array_join("tags", ",").alias("tags"))


@query("win_topic_shift_counter")
def _(i: Inputs):
    from ..streaming.progress import debounced

    w = S.learning_windows(i.messages())
    hits = w.select((F.col("t") % 5).alias("bank"), (F.lit(1704067200) + F.col("t") * 1800 + F.col("raw_idx")).alias("at"), F.lit(1).alias("n"))
    return debounced(hits, 5, 4 * 3600)


@query("stream_dedup_content", f"WITH {WIN} SELECT DISTINCT sha256(win) AS hash FROM w")
def _(i: Inputs):
    w = S.learning_windows(i.messages()).select("t", F.sha2(F.col("window").cast("binary"), 256).alias("hash"))
    # every window comes twice, as files that change are delivered whole
    return deliveries(i, w.where("t % 3 <> 0"), w, stream=lambda s: s.select("hash").dropDuplicates(["hash"]))
