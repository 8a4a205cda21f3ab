"""Divergence audit against plain Python with unbounded integers, and on edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemosail.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(docs, c):
    terms, held, n = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for k, (_, text, lang, source) in enumerate(docs):
        ws = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))
        held[lang or ""].update(set(ws))
        n[lang or "", source or ""].update(ws)
    out = []
    by_lang = defaultdict(list)
    for lang, source in n:
        by_lang[lang].append(source)
    for lang, sources in by_lang.items():
        kept = sorted((t for t, k in held[lang].items() if k >= c.least_docs), key=str.encode)
        v = len(kept)

        def share(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept}

        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            over = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[: c.top])):
                out += [(lang, s, part, x, -v_, k + 1) for k, (v_, _, x) in enumerate(found)]
    return sorted(out)


def corpus(n, sources, vocab, seed):
    r = random.Random(seed)
    names = [f"wört{''.join(chr(97 + int(d)) for d in str(k))}" for k in range(vocab)]
    docs = []
    for k in range(n):
        g = r.choice(["en", "de", None])
        s = r.randrange(sources)
        own = names[s * 7 % vocab :][: max(3, vocab // 4)]
        docs.append((k, " ".join(r.choices(own if r.random() < 0.7 else names, k=r.randrange(1, 60))).title(), g, None if s == 0 else f"s{s}"))
    return docs


@pytest.mark.parametrize("setup", [{}, {"block": 1, "wave": 2}, {"block": 2, "width": 9, "wave": 1}, {"block": 3, "width": 40, "top": 5}, {"held": 10, "least_docs": 1}])
def test_audit_equals_brute_force(spark, setup):
    c = divergence.Config(**setup)
    docs = corpus(160, 9, 60, 1) + [(1, None, "en", "empty"), (2, "", "xx", "a"), (3, "12 !", "xx", "b"), (None, "only once here", "yy", "alone"), (4, None, None, None)]
    docs += docs[:4] * 3  # repeated rows count
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"term": F.lit(1), "n": F.lit(2), "part": F.lit("x"), "docs": F.lit(3)}).repartition(5)
    got = divergence.audit(df, c)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(docs, c)


def test_many_sources_meet_once(spark):
    docs = corpus(120, 26, 30, 5)
    c = divergence.Config(block=3, wave=3)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(docs, SCHEMA), c).collect())) == brute(docs, c)


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7, 8])
def test_rounds_of_a_tournament(spark, blocks):
    size = blocks + blocks % 2
    rows = spark.range(blocks).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(size - 2))).alias("t"))
    met = [(r.t, r.b, r.o) for r in rows.withColumn("o", divergence.partner(F.col("b"), F.lit(size), F.col("t"))).collect()]
    for t, found in itertools.groupby(sorted(met), key=lambda m: m[0]):
        other = {b: o for _, b, o in found}
        assert all(o != b and (o >= blocks or other[o] == b) for b, o in other.items()), t
    assert sorted((b, o) for _, b, o in met if o < blocks) == list(itertools.permutations(range(blocks), 2))


def test_shares_and_vectors():
    r = random.Random(1)
    counts = [0, 1, 2, 8 * 10**15] + [r.randrange(9 * 10**15) for _ in range(200)]
    total = sum(counts[:3]) + 9 * 10**15
    assert divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (k + 1) // total for k in counts]
    place = np.array(sorted(r.sample(range(30_000), 500)))
    back = divergence.unpack(divergence.pack(place, np.arange(500) + 2**40))
    assert back[0].tolist() == place.tolist() and back[1].tolist() == (np.arange(500) + 2**40).tolist()
    assert [len(x) for x in divergence.unpack(None)] == [0, 0]


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_text(spark):
    docs = [(k, ("ab cd " * 100_000 if k == 0 else "ab ef"), "en", f"s{k % 2}") for k in range(6)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(docs, SCHEMA)).collect())) == brute(docs, divergence.Config())
