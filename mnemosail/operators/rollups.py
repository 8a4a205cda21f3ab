"""Rollups of tool-call logs, sessions and daily reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N

CLASSES = ["trivial", "small", "medium", "large"]


def hits_by(calls: DataFrame, *keys: str | Column) -> DataFrame:
    """calls, hits, misses, hit_rate of each group; sums are combined before the shuffle."""
    n, hit = F.count("*"), F.sum(F.col("hit").cast("int"))
    return calls.groupBy(*keys).agg(n.alias("calls"), hit.alias("hits"), (n - hit).alias("misses"), N.ratio(hit, n, 3).alias("hit_rate"))


def hits_cube(calls: DataFrame) -> DataFrame:
    """The three call rollups (by server, by bank, by day and server) in one pass over the log, told apart by ``level``."""
    n, hit = F.count("*"), F.sum(F.col("hit").cast("int"))
    server, bank, day = (F.col(c) for c in ("server", "bank", "day"))
    sets = calls.groupingSets([[server], [bank], [day, server]], server, bank, day)
    out = sets.agg(F.grouping_id().alias("_g"), n.alias("calls"), hit.alias("hits"), (n - hit).alias("misses"), N.ratio(hit, n, 3).alias("hit_rate"))
    level = F.when(F.col("_g") == 3, "server").when(F.col("_g") == 5, "bank").otherwise("day")
    return out.where((F.col("_g") != 5) | bank.isNotNull()).select(level.alias("level"), "day", "server", "bank", "calls", "hits", "misses", "hit_rate")


def mean(c: str, when: Column, digits: int = 2) -> Column:
    return F.coalesce(F.round(F.avg(F.when(when, F.col(c).cast("double"))), digits), F.lit(0.0))


def effectiveness(sessions: DataFrame) -> DataFrame:
    """One row of cohort averages over the given sessions (an empty input gives zeros)."""
    rec, every = F.col("has_recall"), F.lit(True)
    solid = rec & (F.col("size_bucket") != "trivial")
    n = lambda c: F.count(F.when(c, 1))
    aggs = {
        "sessions_with_recall": n(rec),
        "sessions_without_recall": n(~rec),
        "corrections_with": mean("corrections", rec),
        "corrections_without": mean("corrections", ~rec),
        "recall_adoption_pct": N.percent(n(rec), n(every), 1, 0.0),
        "proactive_sessions": n(F.col("proactive")),
        "proactive_pct": N.percent(n(F.col("proactive")), n(every), 1, 0.0),
        "agent_turns": F.coalesce(F.sum("turns"), F.lit(0)),
        "recall_turns": F.coalesce(F.sum("recall_turns"), F.lit(0)),
        "turn_recall_pct": N.percent(F.sum("recall_turns"), F.sum("turns"), 1, 0.0),
        "solid_sessions": n(solid),
        "avg_corrections": mean("corrections", solid),
        "avg_rework_pct": F.round(mean("rework_ratio", solid) * 100, 2),
        "avg_productivity_density": mean("productivity_density", solid),
        "avg_first_productive_turn": mean("first_productive_turn", solid),
        "avg_total_tokens": mean("total_tokens", solid),
        "avg_context_loading_tokens": mean("context_loading_tokens", solid),
        "messages_with": mean("messages", rec),
        "messages_without": mean("messages", ~rec),
    }
    return sessions.agg(*[v.alias(k) for k, v in aggs.items()])


def exploration(sessions: DataFrame, code_bank: str) -> DataFrame:
    """cohort, sessions, avg: four cohorts that overlap (the code cohort lies within the recall cohort)."""
    rec, code = F.col("has_recall"), F.array_contains("banks_recalled", code_bank)
    cohorts = {"with_recall": rec, "without_recall": ~rec, "with_code": rec & code, "without_code": ~code}
    one = sessions.agg(F.array(*[F.struct(F.lit(k).alias("cohort"), F.count(F.when(c, 1)).alias("sessions"), mean("exploration_before_productive", c).alias("avg_exploration")) for k, c in cohorts.items()]).alias("c"))
    return one.select(F.inline("c"))


def distribution(sessions: DataFrame) -> DataFrame:
    """size_bucket, with_recall, without_recall; all four buckets are there."""
    got = sessions.groupBy("size_bucket").agg(F.count(F.when(F.col("has_recall"), 1)).alias("with_recall"), F.count(F.when(~F.col("has_recall"), 1)).alias("without_recall"))
    every = sessions.sparkSession.createDataFrame([(c,) for c in CLASSES], "size_bucket string")
    return every.join(got, "size_bucket", "left").na.fill(0)


def weighted(value: str, weight: str, digits: int = 4) -> Column:
    """Mean of daily means, weighted by their sample sizes; 0 without weight."""
    return F.coalesce(F.round(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight).cast("double")), digits), F.lit(0.0))


def weekly(days: DataFrame, values: list[str], weight: str = "sessions", day: str = "day") -> DataFrame:
    """ISO week, total weight and weighted means; days without date or weight are left out."""
    rows = days.where(F.col(day).isNotNull() & (F.coalesce(weight, F.lit(0)) > 0))
    return rows.groupBy(N.iso_week(F.col(day)).alias("week")).agg(F.sum(weight).alias(weight), *[weighted(v, weight).alias(v) for v in values])


def confusion(rows: DataFrame, truth: Column, said: Column, *keys: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 (0 where undefined)."""
    n = lambda c: F.count(F.when(c, 1))
    tp, fp, fn = n(truth & said), n(~truth & said), n(truth & ~said)
    p, r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0)), F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), n(~truth & ~said).alias("tn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))
