"""Scalar and text functions (signals, names, keys, dates) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import patterns as P
from ..functions import text as T
from ..operators import classify as K
from ..operators.evidence import holders
from .inputs import CALL, FACT, MSG, SERVER, Inputs
from .registry import query

ALT = P.any_of
q = lambda s: s.replace("'", "''")
CORR = f"(text <> '' AND length(text) <= 2000 AND (regexp_matches(text, '(?i){q(ALT(P.CORRECTION))}') OR regexp_matches(text, '(?im){q(P.CORRECTION_LINE)}')))"
INST = f"(length(text) BETWEEN 20 AND 2000 AND regexp_matches(text, '(?i){q(ALT(P.INSTRUCTION))}'))"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("is_correction_regex", f"WITH {MSG} SELECT t, raw_idx, coalesce({CORR}, false) AS is_correction FROM msg WHERE role='user'")
def _(i: Inputs):
    return i.messages().where("role = 'user'").select("t", "raw_idx", T.is_correction(F.col("text")).alias("is_correction"))


ASKED = CORR.replace("text", "substr(text,1,1500)")


@query("udf_classify_correction", f"WITH {MSG} SELECT t, raw_idx, coalesce({ASKED}, false) AS is_correction, CASE WHEN coalesce({ASKED}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM msg WHERE role='user'")
def _(i: Inputs):
    v = K.classify(F.col("text"), K.pattern_backend({"correction": [P.any_of(P.CORRECTION), f"(?m){P.CORRECTION_LINE}"]}), K.CORRECTION_LIMIT)
    return i.messages().where("role = 'user'").select("t", "raw_idx", v.alias("v")).select("t", "raw_idx", F.col("v.label").isNotNull().alias("is_correction"), "v.confidence")


@query("is_instruction", f"WITH {MSG} SELECT t, raw_idx, coalesce({INST}, false) AS is_instruction FROM msg WHERE role='user'")
def _(i: Inputs):
    return i.messages().where("role = 'user'").select("t", "raw_idx", T.is_instruction(F.col("text")).alias("is_instruction"))


@query("is_system_boilerplate", f"""WITH {MSG}, m AS (SELECT t, raw_idx, CASE raw_idx%3 WHEN 0 THEN ' <system_reminder>x</system_reminder>' WHEN 1 THEN 'Briefly inform the user about the task result and perform any follow-up actions now' ELSE text END AS text FROM msg)
SELECT t, raw_idx, (starts_with({STRIP.format('text')}, '{P.BOILERPLATE_PREFIXES[0]}') OR starts_with({STRIP.format('text')}, '{P.BOILERPLATE_PREFIXES[1]}') OR regexp_matches({STRIP.format('text')}, '{P.BOILERPLATE_TAG}')) AS boilerplate FROM m""")
def _(i: Inputs):
    k = F.col("raw_idx") % 3
    text = F.when(k == 0, " <system_reminder>x</system_reminder>").when(k == 1, P.BOILERPLATE_PREFIXES[0] + " now").otherwise(F.col("text"))
    return i.messages().select("t", "raw_idx", T.is_boilerplate(text).alias("boilerplate"))


@query("extract_user_text", f"""WITH {MSG}, m AS (SELECT t, raw_idx, role, text, raw_idx%4 AS k FROM msg WHERE role='user')
SELECT t, raw_idx, CASE k WHEN 0 THEN text WHEN 1 THEN {STRIP.format("regexp_extract('<user_query> '||text||' </user_query>', '(?s)<user_query>\\s*(.*?)\\s*</user_query>', 1)")}
 WHEN 2 THEN {STRIP.format("text")} ELSE '' END AS user_text FROM m""")
def _(i: Inputs):
    m, k = i.messages().where("role = 'user'"), F.col("raw_idx") % 4
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    query_block = block("text", F.concat(F.lit("<user_query> "), F.col("text"), F.lit(" </user_query>")))
    blocks = F.when(k == 1, F.array(block("text", F.lit("<external_links>a")), query_block)).when(k == 2, F.array(block("tool_use", F.lit("x")), block("text", F.col("text")))).otherwise(F.array(block("text", F.lit("<user_info>who"))))
    return m.select("t", "raw_idx", T.user_text(F.when(k == 0, F.col("text")), blocks).alias("user_text"))


@query("extract_assistant_text", f"WITH {MSG} SELECT t, raw_idx, {STRIP.format('text')}||chr(10)||'done' AS assistant_text FROM msg WHERE role='assistant'")
def _(i: Inputs):
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(block("text", T.strip(F.col("text"))), block("tool_use", F.lit("x")), block("text", F.lit("done ")))
    return i.messages().where("role = 'assistant'").select("t", "raw_idx", T.assistant_text(F.lit(None).cast("string"), blocks).alias("assistant_text"))


@query("loose_regex_prefilter", f"WITH {MSG} SELECT t, raw_idx, regexp_matches(text, '(?i){q(ALT(P.LOOSE_CUES))}') AS would_send FROM msg WHERE role='user'")
def _(i: Inputs):
    return i.messages().where("role = 'user'").select("t", "raw_idx", T.loose_prefilter(F.col("text")).alias("would_send"))


ACKS = "CASE raw_idx%6 WHEN 0 THEN ' Thanks! ' WHEN 1 THEN 'ok' WHEN 2 THEN 'https://example.com/x' WHEN 3 THEN 'go ahead.' ELSE text END"


@query("trivial_exclusion_filter", f"""WITH {MSG}, m AS (SELECT t, raw_idx, {STRIP.format(ACKS)} AS s FROM msg)
SELECT t, raw_idx, NOT (length(s) < 4 OR regexp_matches(s, '(?i){P.TRIVIAL_ACK}') OR regexp_matches(s, '(?i){P.BARE_URL}')) AS worth FROM m""")
def _(i: Inputs):
    return i.messages().select("t", "raw_idx", T.worth_asking(F.expr(ACKS)).alias("worth"))


LATE = "regexp_matches(l, '(?i)user (requested|instructed) ') AND NOT regexp_matches(regexp_extract(l, '(?i).*user (?:requested|instructed) (.*)', 1), '(?i)always|never|mandatory|convention')"
REASONS = f"""CASE WHEN {STRIP.format('text')} = '' THEN ['empty'] WHEN regexp_matches(text, '(?i){ALT(P.VALUABLE)}') THEN []
 ELSE list_filter([CASE WHEN regexp_matches(text, '(?i){ALT(P.EPHEMERAL)}') OR len(list_filter(string_split(text, chr(10)), lambda l: {LATE})) > 0 THEN 'ephemeral'
   WHEN regexp_matches(text, '(?i){ALT(P.SNAPSHOT)}') THEN 'snapshot' END, CASE WHEN length(text) < 80 THEN 'short' END], lambda x: x IS NOT NULL) END"""
TRIAGE = f"""{FACT}, base AS (SELECT *, {REASONS} AS r FROM fact WHERE {STRIP.format('text')} <> ''),
tri AS (SELECT id, text, date, bank, tag, CASE WHEN len(r) > 0 AND r <> ['empty'] AND CAST(date AS DATE) < DATE '2024-01-15' THEN list_append(r, 'stale') ELSE r END AS reasons FROM base)"""


@query("classify_memory", f"WITH {TRIAGE} SELECT id, array_to_string(reasons, ',') AS reasons FROM tri")
def _(i: Inputs):
    from ..operators.memory import triage

    return triage(i.facts(), F.to_date(F.lit("2024-01-15"))).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("normalize_server_name", f"WITH {CALL}, {SERVER} SELECT DISTINCT raw_server, server FROM srv")
def _(i: Inputs):
    return i.calls().select("raw_server", T.server_name(F.col("raw_server")).alias("server")).distinct()


PREFIXES = [("src1", "one"), ("src", "all"), ("x", "none")]


@query("resolve_project_label", "SELECT doc_id, CASE WHEN starts_with(source, 'src1') THEN 'one' WHEN starts_with(source, 'src') THEN 'all' WHEN starts_with(source, 'x') THEN 'none' END AS label FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", T.project_label(F.col("source"), PREFIXES).alias("label"))


@query("extract_mcp_tool_call", f"WITH {MSG} SELECT t, raw_idx, CASE WHEN raw_idx%3=0 THEN NULL ELSE tool END AS tool, CASE WHEN raw_idx%3=0 THEN NULL ELSE coalesce(server,'') END AS server FROM msg WHERE tool IS NOT NULL")
def _(i: Inputs):
    m, k = i.messages().where("tool is not null"), F.col("raw_idx") % 3
    name = F.when(k == 0, "Read").when(k == 1, "CallMcpTool").otherwise("CallDynamicTool")
    side = F.when(k == 1, F.to_json(F.struct(F.col("tool").alias("toolName"), F.col("server")))).otherwise(F.to_json(F.struct(F.col("tool").alias("toolName"), F.col("server").alias("namespace"))))
    call = m.select("t", "raw_idx", T.tool_call(F.struct(name.alias("name"), side.alias("input"))).alias("c"))
    return call.select("t", "raw_idx", "c.tool", "c.server")


@query("effective_tool_name", f"WITH {MSG} SELECT t, raw_idx, CASE raw_idx%3 WHEN 0 THEN 'Read' WHEN 1 THEN tool ELSE 'CallDynamicTool' END AS name FROM msg WHERE tool IS NOT NULL")
def _(i: Inputs):
    m, k = i.messages().where("tool is not null"), F.col("raw_idx") % 3
    name = F.when(k == 0, "Read").otherwise("CallDynamicTool")
    space = F.when(k == 1, "cursor").otherwise("other")
    block = F.struct(name.alias("name"), F.to_json(F.struct(F.col("tool").alias("toolName"), space.alias("namespace"))).alias("input"))
    return m.select("t", "raw_idx", T.effective_tool(block).alias("name"))


@query("resolve_recalled_bank", f"WITH {MSG} SELECT DISTINCT server, CASE WHEN server LIKE '%hindsight-docs' THEN 'hindsight-docs' WHEN server LIKE '%cocoindex-code' THEN 'cocoindex-code' END AS bank FROM msg WHERE server IS NOT NULL")
def _(i: Inputs):
    from .inputs import BANKS

    return i.messages().where("server is not null").select("server", T.recalled_bank(F.col("server"), BANKS).alias("bank")).distinct()


@query("detect_hit", "SELECT event_id, event_id%3=0 AS hit FROM events")
def _(i: Inputs):
    k = F.col("event_id") % 3
    inner = F.when(k == 0, '{"content":[{"type":"text","text":"a"}]}').when(k == 1, '{"content":[{"type":"text"}],"isError":true}').otherwise('{"content":[]}')
    return i.table("events").select("event_id", T.hit_of(F.to_json(F.struct(inner.alias("result")))).alias("hit"))


@query("make_document_id", "SELECT doc_id, CASE WHEN doc_id%3=0 THEN source ELSE source||'-chunk'||(doc_id%3) END AS document_id, replace(replace(source||'/'||lang||'.md','/','--'),'.md','') AS slug FROM documents")
def _(i: Inputs):
    k = F.col("doc_id") % 3
    key = F.when(k == 0, "").otherwise(F.concat(F.lit("chunk"), k.cast("string")))
    return i.table("documents").select("doc_id", T.document_key(F.col("source"), key).alias("document_id"), T.path_slug(F.concat("source", F.lit("/"), "lang", F.lit(".md"))).alias("slug"))


@query("parse_overview", "SELECT doc_id, 'about '||lang AS overview FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", T.overview(F.concat(F.lit("---\nname: x\noverview: about "), "lang", F.lit("\ntodos:\n - a\n---\n"))).alias("overview"))


@query("derive_identity", "SELECT DISTINCT source, regexp_replace(source, '^src', 'repo') AS base, CASE WHEN CAST(substr(source,4) AS INT)%2=0 THEN 'v1.'||substr(source,4) END AS line FROM documents")
def _(i: Inputs):
    n = F.substring("source", 4, 9)
    folder = F.when(n.cast("int") % 2 == 0, F.concat(F.regexp_replace("source", "^src", "repo"), F.lit("-v1."), n)).otherwise(F.regexp_replace("source", "^src", "repo"))
    return i.table("documents").select("source", F.regexp_replace(folder, r"-v\d+\.\d+$", "").alias("base"), F.nullif(F.regexp_extract(folder, r"-(v\d+\.\d+)$", 1), F.lit("")).alias("line")).distinct()


@query("release_line_detect", "SELECT DISTINCT source, CASE WHEN substr(source,4)='1' THEN '1.5' WHEN substr(source,4)='2' THEN '1.6' END AS line FROM documents")
def _(i: Inputs):
    n = F.substring("source", 4, 9)
    branch = F.when(n == "1", "release/v1.5").otherwise("main")
    folder = F.when(n == "2", "repo-v1.6").when(n == "1", "repo-v1.6").when(n == "3", "repo-v9.9").otherwise("repo")
    return i.table("documents").select("source", T.release_line(branch, folder, ["1.5", "1.6"]).alias("line")).distinct()


@query("fn_hashes", "SELECT doc_id, substr(sha1(text),1,16) AS key16, sha256(text) AS content_hash FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", T.stable_key(F.col("text")).alias("key16"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("fn_normalize_memory", f"SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace({STRIP.format('lower(text)')}, '\\s+', ' ', 'g')||'| when: x', '\\| when:.*$', ''), '\\| involving:.*$', ''),1,200) AS norm FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", T.normalized_statement(F.concat("text", F.lit("| when: x"))).alias("norm"))


ENT = " || ".join(f"regexp_extract_all(s, '{p}')" for p in P.ENTITIES)
SIG = "CASE doc_id%5 WHEN 0 THEN 'The CamelCase API must retain HTTP_URL at New York Times ' WHEN 1 THEN 'maybe recall the watermark of Old Tool ' WHEN 2 THEN 'x ' ELSE 'plain mental models here ' END"
TOPIC = "[" + ", ".join(f"CASE WHEN contains(lower(s), '{k}') THEN '{t}' END" for k, t in P.TOPICS.items()) + "]"
EXTRACT = f"""ex AS (SELECT doc_id, s, length({STRIP.format('s')}) < 8 AS small, {ENT} AS ent, list_filter({TOPIC}, lambda x: x IS NOT NULL) AS top, regexp_extract_all(lower(s), '[a-z'']+') AS w
 FROM (SELECT doc_id, {SIG} AS s FROM documents))"""
ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("fn_extract_entities", f"WITH {EXTRACT} SELECT doc_id, CASE WHEN small THEN '' ELSE array_to_string({ORDERED.format('ent')}, '|') END AS entities FROM ex")
def _(i: Inputs):
    return i.table("documents").select("doc_id", F.array_join(T.extraction(F.expr(SIG))["entities"], "|").alias("entities"))


@query("fn_extract_topics", f"WITH {EXTRACT} SELECT doc_id, CASE WHEN small THEN '' ELSE array_to_string({ORDERED.format('top')}, '|') END AS topics FROM ex")
def _(i: Inputs):
    return i.table("documents").select("doc_id", F.array_join(T.extraction(F.expr(SIG))["topics"], "|").alias("topics"))


@query("fn_salience", f"WITH {EXTRACT} SELECT doc_id, CASE WHEN small THEN 'low' WHEN list_has_any(w, {P.HIGH_SALIENCE}) THEN 'high' WHEN list_has_any(w, {P.LOW_SALIENCE}) THEN 'low' WHEN len(ent)+len(top) > 0 THEN 'medium' ELSE 'low' END AS salience FROM ex")
def _(i: Inputs):
    return i.table("documents").select("doc_id", T.extraction(F.expr(SIG))["salience"].alias("salience"))


@query("setop_intersect_words", "SELECT doc_id, list_has_any(regexp_extract_all(lower(text), '[a-z'']+'), ['the', 'worthless']) AS overlaps FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", F.arrays_overlap(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0), F.array(F.lit("the"), F.lit("worthless"))).alias("overlaps"))


@query("fn_age_str", "SELECT event_id, CASE WHEN h < 1 THEN '<1h' WHEN h < 24 THEN CAST(CAST(round_even(h,0) AS INT) AS VARCHAR)||'h' ELSE printf('%.1fd', h/24) END AS age FROM (SELECT event_id, (event_id%400)/8.0::DOUBLE AS h FROM events)")
def _(i: Inputs):
    return i.table("events").select("event_id", N.age_label((F.col("event_id") % 400) / 8).alias("age"))


@query("fn_parse_fact_ts", "SELECT event_id, CASE event_id%3 WHEN 2 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM events")
def _(i: Inputs):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 3
    return i.table("events").select("event_id", F.unix_seconds(N.fact_time(F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, iso).otherwise("not a time"))).alias("seconds"))


@query("fn_iso_week", "SELECT DISTINCT d, strftime(d, '%G-W%V') AS week FROM (SELECT CAST(ts AS DATE) + CAST(event_id%400 AS INT) AS d FROM events)")
def _(i: Inputs):
    day = F.date_add(F.to_date("ts"), (F.col("event_id") % 400).cast("int"))
    return i.table("events").select(day.alias("d")).distinct().select("d", N.iso_week(F.col("d")).alias("week"))


@query("fn_hours_between", "SELECT event_id, round(epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 3.6e9 - epoch_us(ts) / 3.6e9, 2) AS hours FROM events")
def _(i: Inputs):
    return i.table("events").select("event_id", F.round(F.unix_micros(F.to_timestamp(F.lit("2024-01-31 00:00:00"))) / 3.6e9 - F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9, 2).alias("hours"))


@query("fn_tokens_chars4", "SELECT doc_id, CAST(round_even(n_chars/4.0, 0) AS BIGINT) AS rounded, n_chars//4 AS floored FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", N.tokens_rounded(F.col("n_chars")).alias("rounded"), N.tokens_floored(F.col("n_chars")).alias("floored"))


@query("fn_productivity_density", "SELECT doc_id, CASE WHEN n_chars//4 > 0 THEN round((doc_id%7)/((n_chars//4)/1000.0::DOUBLE), 4) ELSE 0.0 END AS density FROM documents")
def _(i: Inputs):
    return i.table("documents").select("doc_id", F.coalesce(F.round(F.try_divide((F.col("doc_id") % 7).cast("double"), F.floor(F.col("n_chars") / 4) / F.lit(1000.0)), 4), F.lit(0.0)).alias("density"))


@query("fn_safe_ratio_pct", "SELECT event_type, coalesce(round(count(*) FILTER (value>100)::DOUBLE/nullif(count(*) FILTER (value>50),0)*100,1),0.0) AS pct FROM events GROUP BY 1")
def _(i: Inputs):
    e = i.table("events")
    return e.groupBy("event_type").agg(N.percent(F.count(F.when(F.col("value") > 100, 1)), F.count(F.when(F.col("value") > 50, 1)), 1, 0.0).alias("pct"))


@query("fn_evidence_exact", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def _(i: Inputs):
    return holders(i.table("documents"), i.table("benchmark"))


WS = "regexp_replace({0}, '\\s+', ' ', 'g')"


@query("fn_evidence_ws_norm", f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains({WS.format('d.text')}, {WS.format('b.text')}) WHERE b.text <> ''")
def _(i: Inputs):
    d = i.table("documents").select("doc_id", T.squeeze(F.col("text")).alias("text"))
    return holders(d, i.table("benchmark").select("item_id", T.squeeze(F.col("text")).alias("text")))


@query("fn_extract_json", "SELECT event_id, CASE WHEN event_id%2=0 THEN CAST(json_extract(props,'$.k') AS BIGINT) END AS k FROM events")
def _(i: Inputs):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("answer: "), "props", F.lit(" end"))).otherwise("no { json")
    return i.table("events").select("event_id", F.get_json_object(T.json_part(raw), "$.k").cast("long").alias("k"))


@query("fn_repo_short_name", "SELECT DISTINCT source, lang AS short FROM documents")
def _(i: Inputs):
    return i.table("documents").select("source", F.substring_index(F.concat("source", F.lit("/a/"), "lang"), "/", -1).alias("short")).distinct()


@query("fn_reason_category", "SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 'repeated-fact' WHEN 1 THEN 'near-duplicate' ELSE 'short' END AS category FROM documents")
def _(i: Inputs):
    k = F.col("doc_id") % 3
    return i.table("documents").select("doc_id", T.reason_category(F.when(k == 0, "repeated-fact: a (b)").when(k == 1, "near-duplicate (90%)").otherwise("short")).alias("category"))


@query("fn_slug", "SELECT DISTINCT source, lower(source)||'-a-'||lang AS slug FROM documents")
def _(i: Inputs):
    return i.table("documents").select("source", F.translate(F.lower(F.concat(F.upper("source"), F.lit(" a/"), "lang")), " /", "--").alias("slug")).distinct()


@query("fn_doc_id_from_chunk", "SELECT doc_id, CASE WHEN doc_id%2=0 THEN 'ab-'||doc_id ELSE '' END AS doc FROM documents")
def _(i: Inputs):
    k = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("cursor-memory_ab-"), F.col("doc_id").cast("string"), F.lit("_3"))).otherwise("other_1")
    return i.table("documents").select("doc_id", F.regexp_extract(k, "^cursor-memory_([a-f0-9-]+)_", 1).alias("doc"))


@query("fn_pct_fmt", "SELECT event_type, printf('%.1f%%', round(avg((value>50)::INT)*100,1)) AS pct FROM events GROUP BY 1")
def _(i: Inputs):
    return i.table("events").groupBy("event_type").agg(F.concat(F.format_string("%.1f", F.round(F.avg((F.col("value") > 50).cast("int")) * 100, 1)), F.lit("%")).alias("pct"))


@query("fn_trend_arrow", "SELECT event_id, CASE WHEN abs(g)<0.01 THEN '=' WHEN g>0 THEN '↑' ELSE '↓' END AS arrow FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) WHERE g IS NOT NULL")
def _(i: Inputs):
    from pyspark.sql.window import Window

    prev = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return i.table("events").withColumn("p", prev).where("p is not null").select("event_id", N.trend_arrow(F.col("value"), F.col("p")).alias("arrow"))


@query("fn_stratified_split", "SELECT lang, quality, count(*) AS n, greatest(1, least(CAST(round_even(count(*)*0.6,0) AS BIGINT), CASE WHEN count(*)>1 THEN count(*)-1 ELSE 1 END)) AS seed FROM labels JOIN documents USING (doc_id) GROUP BY 1,2")
def _(i: Inputs):
    from pyspark.sql.window import Window

    rows = i.table("labels").join(i.table("documents").select("doc_id", "lang"), "doc_id")
    w = Window.partitionBy("lang", "quality")
    n = F.count("*").over(w)
    want = F.greatest(F.lit(1), F.least(F.bround(n * 0.6, 0).cast("long"), F.when(n > 1, n - 1).otherwise(1)))
    rows = rows.withColumn("r", F.row_number().over(w.orderBy(F.xxhash64("doc_id"), "doc_id"))).withColumn("is_seed", F.col("r") <= want)
    return rows.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum(F.col("is_seed").cast("int")).alias("seed"))
