"""Importance resampling against plain Python, and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemosail.llm import importance

SCHEMA = "doc_id long, text string"


def brute(docs, target, c):
    def features(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in t or ""))
        return ws, [" ".join(ws[i : i + n]) for n in range(1, c.longest + 1) for i in range(len(ws) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % c.buckets

    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    rows = []
    for i, x in docs:
        ws, fs = features(x)
        w = sum(math.floor(1000 * math.log((t[k] + 1) * (s.total() + c.buckets) / ((s[k] + 1) * (t.total() + c.buckets)))) for k in map(bucket, fs))
        h = int(hashlib.sha256(f"{c.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    fit = sorted((r for r in rows if r[4] >= c.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(fit[: c.percent * len(fit) // 100])]
    rest = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted([*drawn, *((*r, None) for r in rest.elements())], key=str)


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choices(["Alpha", "beta", "gaMma", "été", "x1", "ÄB", "delta-eps", "中文"], k=r.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("setup", [{}, {"longest": 3, "buckets": 50}, {"percent": 100, "ranges": 3}, {"percent": 37, "ranges": 1, "least_words": 1}, {"percent": 0}])
def test_draws_equal_brute_force(spark, setup):
    c = importance.Config(**setup)
    docs = list(enumerate(texts(150, 1))) + [(k, t) for k in (3, 4, 5) for t in texts(2, 9)] + [(700, None), (701, ""), (702, "..!"), (None, "beta " * 30), (None, "beta " * 30), (None, None)]
    docs += [(800, "beta gamma " * 15)] * 7
    target = [*texts(10, 2), None, ""]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"score": F.lit("x"), "rank": F.lit("y"), "n": F.lit(0), "weight": F.lit(None).cast("string")}).repartition(5)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), c)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, c)


def test_many_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "REPEATS", 7)
    df = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("alpha beta " * 20).alias("text"))
    got = importance.resample(df, df.limit(1), importance.Config(percent=50)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1501)) and len(got) == 3000


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b " * 20)], SCHEMA)
    assert importance.resample(none, some).count() == 0
    (one,) = importance.resample(some, none, importance.Config(percent=100)).collect()
    assert (one.doc_id, one.n_features, one["rank"]) == (1, 40, 1)


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "beta " * 500_000), (2, "beta")], SCHEMA)
    got = {r.doc_id: r for r in importance.resample(df, df, importance.Config(percent=100, least_words=1)).collect()}
    assert got[1].n_features == 500_000 and got[1].weight == 500_000 * got[2].weight
