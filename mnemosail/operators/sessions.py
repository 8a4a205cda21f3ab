"""Transcript windows and session metrics, as window functions over messages.

Messages: t (transcript), raw_idx (place), role, text, chars, and tools, an
array of structs with ``name`` and ``call`` (null, or tool and server). Every
window is partitioned by transcript, which also is the only shuffle key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import text as T
from ..functions.literals import ascii_words
from ..functions.patterns import EXPLORATION_TOOLS, PRODUCTIVE_TOOLS, RECALL_REQUEST



def in_order():
    return Window.partitionBy("t").orderBy("raw_idx")


def whole():
    return Window.partitionBy("t")


def parsed(messages: DataFrame) -> DataFrame:
    """User and assistant messages with text, numbered densely as ``i`` while raw_idx stays."""
    rows = messages.where(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return rows.withColumn("i", F.row_number().over(in_order()) - 1)


def learning_windows(messages: DataFrame, start: Column | int = 0, around: int = 2) -> DataFrame:
    """t, raw_idx, i, tag, window: context around corrections, and around instructions that are no corrections.

    Texts are cut to 300 characters; ``start`` is the first raw index that may be a centre.
    """
    rows = parsed(messages)
    user = F.col("role") == "user"
    rows = rows.withColumn("fix", user & T.is_correction(F.col("text"))).withColumn("rule", user & T.is_instruction(F.col("text")))
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring("text", 1, 300))
    near = in_order().rowsBetween(-around, around)
    ctx = F.collect_list(F.struct("i", line.alias("line"))).over(near)
    tag = F.when(F.col("fix"), "CORRECTION").when(F.col("rule"), "INSTRUCTION")
    centres = rows.withColumn("ctx", ctx).withColumn("tag", tag).where(F.col("tag").isNotNull() & (F.col("raw_idx") >= start))
    marked = F.transform("ctx", lambda m: F.when(m["i"] == F.col("i"), F.concat(F.lit("["), F.col("tag"), F.lit("] "), m["line"])).otherwise(m["line"]))
    return centres.select("t", "raw_idx", "i", "tag", F.array_join(marked, "\n\n").alias("window"))


def window_document_id(t: Column, window: Column) -> Column:
    return F.concat(F.lit("transcript-"), t.cast("string"), F.lit("-w"), T.stable_key(window))


def annotated(messages: DataFrame) -> DataFrame:
    """Messages with their session state: turn, running characters, tool counts and the first productive place."""
    tools = F.col("tools")
    productive = lambda b: b["name"].isin(PRODUCTIVE_TOOLS)
    explores = lambda b: b["name"].isin(EXPLORATION_TOOLS)
    asst = F.col("role") == "assistant"
    rows = messages.withColumns(
        {
            "n_productive": F.when(asst, F.size(F.filter(tools, productive))).otherwise(0),
            "recalls": asst & F.exists(tools, lambda b: F.coalesce(F.lower(b["call"]["tool"]).contains("recall"), F.lit(False))),
            "fix": (F.col("role") == "user") & T.is_correction(F.col("text")),
            "asks": (F.col("role") == "user") & F.coalesce(F.col("text").rlike(ascii_words(RECALL_REQUEST)), F.lit(False)),
            "turn": F.sum(asst.cast("int")).over(in_order()),
            "running": F.sum("chars").over(in_order()),
            "messages": F.count("*").over(whole()),
        }
    )
    place = F.min(F.when(F.col("n_productive") > 0, F.col("raw_idx"))).over(whole())
    rows = rows.withColumn("productive_at", place)
    # tools of the first productive message count up to its first productive tool
    lead_in = F.slice(tools, 1, F.greatest(F.coalesce(F.array_position(F.transform(tools, productive), True), F.lit(1)) - 1, F.lit(0)).cast("int"))
    seen = F.when(F.col("raw_idx") == place, lead_in).when(F.coalesce(F.col("raw_idx") < place, F.lit(True)), tools)
    return rows.withColumn("n_exploring", F.when(asst, F.coalesce(F.size(F.filter(seen, explores)), F.lit(0))).otherwise(0))


def facts(messages: DataFrame, banks: list[str], least: int = 6) -> DataFrame:
    """One row of metrics per session of ``least`` messages or more."""
    rows = annotated(messages).where(F.col("messages") >= least)
    total = F.sum("chars").over(whole())
    fixes = Window.partitionBy("t", "fix").orderBy("raw_idx")
    rows = rows.withColumn("total", total)
    segment = F.lead("running", 1).over(fixes)
    rows = rows.withColumn("rework", F.when(F.col("fix"), F.floor((F.coalesce(segment, F.col("total")) - F.col("running")) / 2)).otherwise(0))
    before = F.col("role").isin("user", "assistant") & F.coalesce(F.col("raw_idx") < F.col("productive_at"), F.lit(True))
    servers = F.transform(F.filter("tools", lambda b: F.coalesce(F.lower(b["call"]["tool"]).contains("recall"), F.lit(False))), lambda b: T.recalled_bank(b["call"]["server"], banks))
    agg = rows.groupBy("t").agg(
        F.count("*").alias("messages"),
        F.sum("chars").alias("chars"),
        F.sum(F.col("fix").cast("int")).alias("corrections"),
        F.sum("n_productive").alias("productive_actions"),
        F.max("turn").alias("turns"),
        F.sum(F.col("recalls").cast("int")).alias("recall_turns"),
        F.min(F.when(F.col("recalls"), F.col("turn"))).alias("first_recall_turn"),
        F.max("asks").alias("user_asked"),
        F.min(F.when(F.col("n_productive") > 0, F.col("turn"))).alias("first_turn"),
        F.sum(F.when(before, F.col("chars")).otherwise(0)).alias("preamble_chars"),
        F.sum("rework").alias("rework_chars"),
        F.sum("n_exploring").alias("exploration_before_productive"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(servers))))).alias("banks_recalled"),
    )
    tokens = N.tokens_rounded(F.col("chars"))
    rework = N.tokens_rounded(F.col("rework_chars"))
    out = agg.withColumns({"has_recall": F.col("recall_turns") > 0, "first_productive_turn": F.coalesce(F.nullif("first_turn", F.lit(0)), "turns"), "context_loading_tokens": N.tokens_rounded(F.col("preamble_chars")), "total_tokens": tokens, "rework_tokens": rework, "size_bucket": N.size_bucket(tokens)})
    per_k = F.try_divide(F.col("productive_actions").cast("double"), F.col("total_tokens") / 1000)
    return out.withColumns(
        {
            "proactive": F.col("has_recall") & (~F.col("user_asked") | (F.col("first_recall_turn") == 1)),
            "effectiveness_ratio": F.coalesce(F.round(per_k, 3), F.lit(0.0)),
            "productivity_density": F.coalesce(F.round(per_k, 4), F.lit(0.0)),
            "rework_ratio": N.ratio(F.col("rework_tokens"), F.col("total_tokens"), 4, 0.0),
        }
    ).drop("first_turn", "rework_chars")


def consumption(messages: DataFrame) -> DataFrame:
    """Token use per session with two user messages or more; corrections cost their own text and the answer before them."""
    user, asst = F.col("role") == "user", F.col("role") == "assistant"
    rows = messages.withColumn("segment", F.sum(user.cast("int")).over(in_order()))
    # a user message belongs to the segment it ends: the one before its own count
    rows = rows.withColumn("segment", F.col("segment") - user.cast("int"))
    back = Window.partitionBy("t", "segment").orderBy("raw_idx").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.last(F.when(asst, F.col("chars")), ignorenulls=True).over(back), F.lit(0))
    fix = user & T.finds(F.substring("text", 1, 500), T.P.CORRECTION)
    rows = rows.withColumns({"fix": F.coalesce(fix, F.lit(False)), "cost": F.when(F.coalesce(fix, F.lit(False)), prev + F.col("chars")).otherwise(0)})
    recalls = F.exists("tools", lambda b: F.coalesce(F.lower(b["call"]["tool"]).contains("recall"), F.lit(False)))
    agg = rows.groupBy("t").agg(F.sum("chars").alias("chars"), F.sum(user.cast("int")).alias("user_msgs"), F.sum(asst.cast("int")).alias("assistant_msgs"), F.sum(F.size("tools")).alias("tool_calls"), F.sum(F.col("fix").cast("int")).alias("corrections"), F.sum("cost").alias("cost_chars"), F.max(recalls).alias("has_recall"))
    agg = agg.where("user_msgs >= 2").withColumns({"tokens": N.tokens_floored(F.col("chars")), "correction_cost_tokens": N.tokens_floored(F.col("cost_chars"))})
    return agg.withColumns({"tokens_per_request": F.floor(F.col("tokens") / F.col("user_msgs")), "tool_calls_per_request": F.round(F.col("tool_calls") / F.col("user_msgs"), 1)})
