"""Importance resampling: draws the documents that look most like a target corpus.

Features of a text are its runs of consecutive words, repeats counted, hashed
into a fixed number of buckets. A bucket's gain is the scaled logarithm of its
smoothed share of the target's features over its share of the documents'
features; a document weighs the sum of its features' gains, and its score adds
seeded Gumbel noise, so the highest scores are a draw without replacement.
All scores are integers.

The draw is exact without a global sort. Scores are looked up in an array of
gains; equal scores are counted; counts of higher scores, summed over ranges
of scores on the driver (``ranges`` numbers at most) and within a range by a
window, give the first rank of each score. The cutoff score follows, and only rows at or above it
are numbered, by id within their score.

Null and empty texts have no features, weight 0 and a score from the noise
alone. A null id is hashed as the empty string and comes after other ids of its
score. Rows that tie in score and id are numbered by weight and features;
repeated rows share their score and each has a rank of its own. Empty documents
or an empty target give the smoothed gains that the formula gives. Without
rows, or with fewer than one row to draw, nothing has a rank.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import small_batches
from .common import Memo, materialize, session

#: A-Z become lower case, bytes that are no part of a word become blanks; bytes of 128 and more belong to words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Rows that one row of counted repeats becomes at a time.
REPEATS = 10_000


@dataclass(frozen=True)
class Config:
    longest: int = 1  # words in a run, from 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10
    ranges: int = 1 << 16


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def runs(ws: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by a blank."""
    out = ws
    for n in range(2, longest + 1):
        out = out + [b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)]
    return out


def bucket_memo(buckets: int) -> Memo:
    return Memo(lambda feature: zlib.crc32(feature) % buckets)


def bucket_array(ws: list[bytes], c: Config, memo: Memo) -> np.ndarray:
    features = runs(ws, c.longest)
    return np.fromiter(map(memo.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, text: str, c: Config) -> np.ndarray:
    """Features in each bucket, over all rows: one array a task, summed by bucket."""

    def count(batches):
        memo, total = bucket_memo(c.buckets), np.zeros(c.buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(bucket_array(words(t), c, memo), minlength=c.buckets)
                memo.trim()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = texts.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("_text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(c.buckets, object)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, c: Config) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket, in doubles."""
    s_all, t_all = int(sum(source)), int(sum(target))
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + c.buckets) / (float(s + 1) * float(t_all + c.buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Scaled Gumbel noise of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, c: Config = Config(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and n_words of each row, whole texts."""
    shared = session(docs).sparkContext.broadcast(gain)

    def run(batches):
        memo, g = bucket_memo(c.buckets), shared.value
        for b in batches:
            ids, n, m, weight = b.column(0).to_pylist(), [], [], []
            for t in b.column(1).to_pylist():
                ws = words(t)
                at = bucket_array(ws, c, memo)
                m.append(len(ws)), n.append(len(at)), weight.append(int(g[at].sum()))
                memo.trim()
            score = [w + noise(i, c.seed) for i, w in zip(ids, weight, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, n, weight, score, m)], ["doc_id", "n_features", "weight", "score", "n_words"])

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, "doc_id long, n_features long, weight long, score long, n_words long")


def first_ranks(counts: DataFrame, draw: int, ranges: int) -> tuple[DataFrame, int | None]:
    """(score, above) of each score that is drawn from, and the lowest of them.

    ``counts`` has one row (score, n) per score; ``above`` is the number of rows with a higher score.
    """
    ends = counts.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if draw <= 0 or ends["lo"] is None:
        return counts.select("score", F.lit(0).cast("long").alias("above")).limit(0), None
    width = (ends["hi"] - ends["lo"]) // ranges + 1
    ranged = counts.withColumn("part", F.floor((F.col("score") - F.lit(ends["lo"])) / F.lit(width)) if width == 1 else F.expr(f"(score - ({ends['lo']})) div {width}"))
    total, above = 0, []
    for r in sorted(ranged.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["part"]):  # one row per range
        above.append((r["part"], total))
        total += r["n"]
        if total >= draw:
            break  # lower ranges hold nothing that is drawn
    spark = session(counts)
    higher = F.broadcast(spark.createDataFrame(above, "part long, before long"))
    within = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(higher, "part").withColumn("above", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).where(F.col("above") < draw).select("score", "above")
    return found, found.agg(F.min("score")).first()[0]


def resample(docs: DataFrame, target: DataFrame, c: Config = Config(), doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row; the rank is null where a row is not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn, rounded down.
    """
    small_batches(session(docs))
    gain = gains(bucket_counts(docs, text, c), bucket_counts(target, target_text, c), c)
    rows = materialize(scored(docs, gain, c, doc_id, text), "scores")
    fit = F.col("n_words") >= c.least_words
    counts = materialize(rows.where(fit).groupBy("score").agg(F.count("*").alias("n")), "score_counts", 8)
    n = counts.agg(F.sum("n")).first()[0] or 0
    draw = c.percent * n // 100
    ranks, cutoff = first_ranks(counts, draw, c.ranges)
    plain = ["doc_id", "n_features", "weight", "score"]
    if cutoff is None:
        return rows.select(*plain, F.lit(None).cast("long").alias("rank"))
    drawn = F.coalesce(fit & (F.col("score") >= cutoff), F.lit(False))
    # rows alike are one until they have their ranks
    alike = rows.where(drawn).groupBy(*plain).agg(F.count("*").alias("n")).join(ranks, "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features").rowsBetween(Window.unboundedPreceding, 0)
    placed = alike.withColumn("last", F.col("above") + F.sum("n").over(order)).withColumn("first", F.col("last") - F.col("n") + 1)
    blocks = placed.withColumn("at", F.explode(F.sequence("first", "last", F.lit(REPEATS).cast("long"))))
    each = blocks.withColumn("place", F.explode(F.sequence("at", F.least("last", F.col("at") + (REPEATS - 1)))))
    ranked = each.select(*plain, F.when(F.col("place") <= draw, F.col("place")).alias("rank"))
    return rows.where(~drawn).select(*plain, F.lit(None).cast("long").alias("rank")).unionByName(ranked)
