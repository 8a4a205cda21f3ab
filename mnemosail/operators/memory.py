"""Stored statements: deduplication, triage, scoping, contradiction routing, review."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row of each key, the first in the given total order. The row limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def older_copies(df: DataFrame, key: str, created: str, place: str) -> DataFrame:
    """All but the newest row of each key; equal times keep the first in input order. Null keys are one group."""
    w = Window.partitionBy(F.coalesce(key, F.lit(""))).orderBy(F.desc_nulls_last(created), place)
    return df.withColumn("_r", F.row_number().over(w)).where("_r > 1").drop("_r")


def target_diff(current: DataFrame, declared: DataFrame, key: str, content: str) -> DataFrame:
    """key, action (insert, update, delete) that turns the current rows into the declared ones."""
    c = current.select(F.col(key), F.col(content).alias("_c"), F.lit(True).alias("_ic"))
    d = declared.select(F.col(key), F.col(content).alias("_d"), F.lit(True).alias("_id"))
    action = F.when(F.col("_ic").isNull(), "insert").when(F.col("_id").isNull(), "delete").when(~F.col("_c").eqNullSafe(F.col("_d")), "update")
    return c.join(d, key, "full").select(key, action.alias("action")).where("action is not null")


def unseen(windows: DataFrame, seen: DataFrame, text: str, *order: str) -> DataFrame:
    """Windows whose hash was not seen before, the first of each."""
    rows = windows.withColumn("hash", F.sha2(F.col(text).cast("binary"), 256))
    return keep_first(rows.join(seen, "hash", "left_anti"), ["hash"], *order)


def classified(messages: DataFrame, cache: DataFrame, text: str, classify) -> DataFrame:
    """Adds ``is_correction`` and ``cached``: from the cache by hash, else from ``classify`` (column to column)."""
    rows = messages.withColumn("hash", F.sha2(F.col(text).cast("binary"), 256)).join(cache.withColumnRenamed("is_correction", "_c"), "hash", "left")
    return rows.withColumn("cached", F.col("_c").isNotNull()).withColumn("is_correction", F.coalesce("_c", classify(F.col(text)))).drop("_c")


def triage(facts: DataFrame, cutoff: Column) -> DataFrame:
    """facts with ``reasons``; blank statements are left out. Each pattern runs once a text at most: its outcome is a column before it is used again."""
    text = F.coalesce("text", F.lit(""))
    rows = facts.where(T.has_ink(text)).withColumn("_base", F.when(T.valuable(text), F.array().cast("array<string>")).otherwise(T.triage_base(text)))
    return rows.withColumn("reasons", T.with_stale(F.col("_base"), F.col("date"), cutoff)).drop("_base")


def unified_diff(a: Column, b: Column, context: int = 3, names: tuple[str, str] = ("stored", "current")) -> Column:
    """Unified diff of two texts by lines, '' if they are equal."""
    import difflib

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(["" if p == q else "\n".join(difflib.unified_diff((p or "").split("\n"), (q or "").split("\n"), *names, n=context, lineterm="")) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def block_pairs(facts: DataFrame, block: int = 50, text: str = "text", place: str = "id") -> DataFrame:
    """(a, b, na, nb): statements with the same first characters, a before b.

    The block join is inherent: every pair of a block is compared. Equal statements are
    one entry here (their pairs have ratio 1 by definition and come from ``equal_pairs``),
    so a group of copies is no product.
    """
    rows = facts.select(F.col(place).alias("id"), T.normalized_statement(F.col(text)).alias("n"))
    first = rows.groupBy("n").agg(F.min("id").alias("id")).withColumn("p", F.substring("n", 1, block))
    a, b = first.select(F.col("id").alias("a"), F.col("n").alias("na"), "p"), first.select(F.col("id").alias("b"), F.col("n").alias("nb"), "p")
    return a.join(b, "p").where("a < b").select("a", "b", "na", "nb")


def equal_copies(facts: DataFrame, text: str = "text", place: str = "id") -> DataFrame:
    """(id, first): copies of a normalised statement, with its first holder."""
    rows = facts.select(F.col(place).alias("id"), T.normalized_statement(F.col(text)).alias("n"))
    lead = rows.groupBy("n").agg(F.min("id").alias("first"))
    return rows.join(lead, "n").where("id <> first").select("id", "first")


def letter_bound(x: pd.Series, y: pd.Series, cells: int = 64) -> np.ndarray:
    """At least the ratio of each pair: what two texts share is no more than the letters that both have, counted by a residue of their codes."""
    texts, at = np.unique(np.concatenate([x.to_numpy(str), y.to_numpy(str)]), return_inverse=True)
    counts = np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % cells, minlength=cells) for t in texts.tolist()])
    size, (a, b) = counts.sum(axis=1), np.split(at, 2)
    both = size[a] + size[b]
    return np.where(both == 0, 1.0, 2 * np.minimum(counts[a], counts[b]).sum(axis=1) / np.maximum(both, 1))


def letter_places(text: str) -> dict[str, int]:
    """Places of each letter as the bits of a number."""
    out: dict[str, int] = {}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << k
    return out


def longest_common(text: str, places: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of a text and one of ``size`` letters, by one addition a letter (bit-parallel)."""
    full = rest = (1 << size) - 1
    for c in text:
        hit = rest & places.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return size - rest.bit_count()


def sequence_ratio(a: Column, b: Column, above: float = -1.0) -> Column:
    """Ratcliff/Obershelp similarity, with the popularity heuristic from 200 characters on; not symmetric. Null where bounds show that it is not above ``above``."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.fillna(""), y.fillna("")
        may = letter_bound(x, y) > above if len(x) else []
        out, matcher, held, indexed, places = np.full(len(x), np.nan), SequenceMatcher(), None, False, {}
        for k in np.argsort(y.to_numpy(str), kind="stable"):  # the matcher indexes its second text once for all its first ones
            if may[k]:
                if y.iloc[k] != held:
                    held, indexed = y.iloc[k], False
                    places = letter_places(held)
                text = x.iloc[k]
                # what the matcher pairs is a common subsequence
                if not text + held or above < 0 or 2 * longest_common(text, places, len(held)) > above * (len(text) + len(held)):
                    if not indexed:
                        matcher.set_seq2(held)
                        indexed = True
                    matcher.set_seq1(text)
                    out[k] = matcher.ratio()
        return pd.Series(out)

    return run(a, b)


def near_duplicates(facts: DataFrame, least: float = 0.85, block: int = 0) -> DataFrame:
    """(a, b, ratio) of representatives whose ratio is above ``least``; ``block`` as in ``close_pairs``."""
    rows = facts.select("id", T.normalized_statement(F.col("text")).alias("n"))
    first = rows.groupBy("n").agg(F.min("id").alias("first")).withColumn("last", F.col("first"))
    return close_pairs(first, least, block).select(F.col("fx").alias("a"), F.col("fy").alias("b"), "ratio")


def close_pairs(statements: DataFrame, least: float, block: int = 0, tile: int = 16_384, spread: int = 16, step: int = 2048) -> DataFrame:
    """(fx, fy, ratio) of different statements x and y with a ratio from x to y above ``least``.

    statements: n, first and last (ids of its holders); a pair counts from x to y if an id of x is before one of y.
    block: statements must have so many first characters in common; 0 compares all statements.

    A block is cut into parts of about ``tile`` statements, or into up to ``spread`` smaller ones; each pair of parts is a tile of its own,
    so no task has a whole block. A task compares ``step`` statements with as many others at a time, and pairs never become rows.
    """
    from . import close_texts as C

    rows = statements.where("n is not null").withColumn("p", F.substring("n", 1, block))
    cut = F.greatest(F.ceil(F.col("_k") / tile), F.least(F.lit(spread), F.ceil(F.col("_k") / min(tile, 1024))))
    parts = rows.groupBy("p").agg(F.count("*").alias("_k")).where("_k > 1").select("p", cut.cast("int").alias("_parts"))
    own = rows.join(parts, "p").withColumn("own", F.pmod(F.xxhash64("n"), F.col("_parts")).cast("int"))
    met = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = met.select("p", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own", "n", "first", "last")
    kind = statements.schema["first"].dataType.simpleString()
    columns = ["fx", "fy", "ratio"]

    def slices(pdf, own: int) -> list:
        """(texts, first, last) of a part, ``step`` statements of about one length each."""
        part = pdf[pdf["own"] == own]
        part = part.iloc[np.argsort(part["n"].str.len().to_numpy(), kind="stable")]
        cuts = (part.iloc[k : k + step] for k in range(0, len(part), step))
        return [(C.Texts(c["n"].tolist()), c["first"].to_numpy(), c["last"].to_numpy()) for c in cuts]

    def run(key, pdf):
        _, i, j = key
        u = slices(pdf, i)
        v = u if i == j else slices(pdf, j)
        out = []
        for s, (x, fu, lu) in enumerate(u):
            for t, (y, fv, lv) in enumerate(v):
                if i == j and t < s:
                    continue
                same = x is y

                def wanted(turned: bool, k: np.ndarray, m: np.ndarray) -> np.ndarray:
                    return fv[m] < lu[k] if turned else (fu[k] < lv[m]) & ((k != m) if same else True)

                out += [(fv[m], fu[k], r) if turned else (fu[k], fv[m], r) for turned, k, m, r in C.close(x, y, least, wanted, same)]
        return pd.DataFrame(out, columns=columns)

    # work is dealt by number, not by bytes: tiles cost far more than their bytes tell
    n = int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "p", "i", "j").groupBy("p", "i", "j").applyInPandas(run, f"fx {kind}, fy {kind}, ratio double")


def close_in_length(pairs: DataFrame, a: Column, b: Column, least: float) -> DataFrame:
    """Pairs whose lengths allow a ratio above ``least``, dealt evenly: ratios cost far more than their bytes tell, and a block's pairs lie together."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    close = pairs.where((F.length(a) + F.length(b) == 0) | (2 * F.least(F.length(a), F.length(b)) > least * (F.length(a) + F.length(b))))
    return close.repartition(n, F.xxhash64(a, b))


def duplicate_removals(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each pair the older statement goes; of two of one date the first."""
    d = facts.select("id", "date")
    dated = pairs.join(d.withColumnsRenamed({"id": "a", "date": "da"}), "a").join(d.withColumnsRenamed({"id": "b", "date": "db"}), "b")
    return dated.select(F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("id"))


def near_duplicate_removals(facts: DataFrame, least: float = 0.85, block: int = 50) -> DataFrame:
    """(id) of every statement, copies included, that some other one of ratio above ``least`` replaces: a newer one, or of the same date a later one.

    ``block`` as in ``close_pairs``. Classes of equal statements are compared, not their members. A pair's ratio is taken from the lower id to the
    higher one and is not symmetric, so classes whose ids overlap are compared both ways. Of what replaces a class
    only the ids' ends of each date are kept, so neither copies nor pairs of copies are expanded.
    """
    facts = facts.where(T.has_ink(F.coalesce("text", F.lit(""))))
    rows = facts.select("id", T.normalized_statement(F.col("text")).alias("n"), F.coalesce("date", F.lit("")).alias("date"))
    classes = rows.groupBy("n").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    links = close_pairs(classes, least, block).select("fx", "fy")
    rows = rows.join(classes.select("n", F.col("first").alias("c")), "n").select("c", "id", "date")
    dates = rows.groupBy("c", "date").agg(F.max("id").alias("hi"), F.min("id").alias("lo"))
    none = F.lit(None).cast(rows.schema["id"].dataType)
    higher = links.join(dates, links.fy == dates.c).select(F.col("fx").alias("c"), "date", "hi", none.alias("lo"))
    lower = links.join(dates, links.fx == dates.c).select(F.col("fy").alias("c"), "date", none.alias("hi"), "lo")
    ends = dates.unionByName(higher).unionByName(lower).groupBy("c", "date").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    rivals = ends.groupBy("c").agg(F.collect_list(F.struct("date", "hi", "lo")).alias("rivals"))
    replaced = F.exists("rivals", lambda r: F.coalesce((r.hi > F.col("id")) & (r.date >= F.col("date")), F.lit(False)) | F.coalesce((r.lo < F.col("id")) & (r.date > F.col("date")), F.lit(False)))
    return rows.join(rivals, "c").where(replaced).select("id")


def restated(facts: DataFrame, claims: list[tuple[str, Column]], least: int = 3) -> DataFrame:
    """(claim, id): all but the newest statement of claims made ``least`` times or more."""
    labels = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in claims]))
    rows = facts.select("id", "date", F.explode(labels).alias("claim"))
    n = rows.groupBy("claim").agg(F.count("*").alias("n"), F.max(F.struct("date", (-F.col("id")).alias("k"))).alias("newest")).where(F.col("n") >= least)
    return rows.join(F.broadcast(n), "claim").where(F.col("id") != -F.col("newest.k")).select("claim", "id")


def document_state(facts: DataFrame, doc: str, flagged: Column) -> DataFrame:
    """Per document: statements, flagged ones, and clean, mixed or full."""
    n, k = F.count("*"), F.count(F.when(flagged, 1))
    return facts.groupBy(doc).agg(n.alias("statements"), k.alias("flagged"), F.when(k == 0, "clean").when(k == n, "full").otherwise("mixed").alias("state"))


def resolve(checks: DataFrame, threshold: float = 0.9, live: bool = False) -> DataFrame:
    """Adds ``action`` and ``invalidated``: what happens to a statement after its contradiction check.

    checks: enabled, recall_failed, memories (array), error, contradicts, idx, confidence.
    """
    n = F.size("memories")
    keep = ~F.col("enabled") | F.col("recall_failed") | (n <= 0) | F.col("error").isNotNull() | ~F.coalesce("contradicts", F.lit(False)) | F.col("idx").isNull() | (F.col("idx") < 0) | (F.col("idx") >= n)
    auto = F.col("confidence") >= threshold
    action = F.when(F.coalesce(keep, F.lit(True)), "retain").when(auto, "auto_resolved").otherwise("queued")
    out = checks.withColumn("action", action)
    return out.withColumn("invalidated", (F.col("action") == "auto_resolved") & F.lit(live))


def routed(resolved: DataFrame) -> DataFrame:
    """Rows to retain, with their tags; queued ones wait for review; instructions skip the check."""
    tags = F.when(F.col("tag") == "INSTRUCTION", F.array(F.lit("instruction"))).when(F.col("action") == "auto_resolved", F.array(F.lit("correction"), F.lit("supersedes-prior-memory"))).otherwise(F.array(F.lit("correction")))
    return resolved.where((F.col("tag") == "INSTRUCTION") | (F.col("action") != "queued")).withColumn("tags", tags)


def reviewed(queue: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Adds invalidate, retain and dequeue to the queue: a approves, r rejects; others stay."""
    d = F.coalesce("decision", F.lit("s"))
    q = queue.join(decisions, key, "left")
    return q.withColumns({"invalidate": d == "a", "retain": d == "a", "dequeue": d.isin("a", "r")}).drop("decision")
