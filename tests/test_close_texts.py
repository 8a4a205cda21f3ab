"""Pairs of close texts by tiles, against every pair."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemosail.functions import text as T
from mnemosail.operators import close_texts as C
from mnemosail.operators import memory as M


def block(seed: int, n: int, size: int = 200) -> list[str]:
    """Texts with one common beginning, some of them edited copies of others."""
    r, parts = random.Random(seed), "th an er on re in ing ti ed is . , wh ly sh q z x ñ ſ 𝒳 ".split(" ")
    out: list[str] = ["the same line opens all of these statements, and it is long. "]
    out += [out[0] + "".join(r.choices(parts, k=120))[: r.choice([size, size, 60, 110])] for _ in range(n // 2)]
    while len(out) < n:
        t = list(r.choice(out))
        for _ in range(r.randrange(1, 40)):
            k = r.randrange(50, len(t))
            t[k : k + r.randrange(0, 3)] = r.choice(parts)
        out.append("".join(t))
    return list(dict.fromkeys(t[:size] for t in out))


@pytest.mark.parametrize(("seed", "size", "least"), [(1, 200, 0.85), (2, 200, 0.6), (3, 230, 0.85), (4, 190, 0.85), (5, 450, 0.8)])
def test_all_close_pairs(seed, size, least):
    a, b = block(seed, 60, size), block(seed + 10, 50, size)
    x, y = C.Texts(a), C.Texts(b + a[:15])
    ratio = lambda s, t: SequenceMatcher(None, s, t).ratio()
    want = {(turned, i, j) for i, s in enumerate(x.texts) for j, t in enumerate(y.texts) for turned in (False, True) if (ratio(t, s) if turned else ratio(s, t)) > least}
    got = C.close(x, y, least, lambda turned, i, j: np.ones(len(i), bool), False)
    assert {g[:3] for g in got} == want and len(got) == len(want) > 15
    assert all(r == (ratio(y.texts[j], x.texts[i]) if turned else ratio(x.texts[i], y.texts[j])) for turned, i, j, r in got)
    own = {g[1:3] for g in C.close(x, x, least, lambda turned, i, j: i != j, True)}
    assert own == {(i, j) for i, s in enumerate(a) for j, t in enumerate(a) if i != j and ratio(s, t) > least}


def test_few_pairs_of_a_block_are_left():
    r, parts = random.Random(0), "th an er on re in ing ti ed is st wh ly sh ou ble ion q z x .".split(" ")
    line = "ouwhea the of rend and threlyes ofthstthor nd of ouble edoution wh onharent. "
    x = C.Texts([(line + " ".join("".join(r.choices(parts, k=3)) for _ in range(40)))[:200] for _ in range(600)])
    assert sum(to_y.sum() for _, to_y, _ in C.candidates(x, x, 0.85)) < 0.03 * 600 * 600


def test_tiles_have_every_pair(spark):
    texts = block(7, 80)
    rows = spark.createDataFrame([(t, k, k + (90 if k % 9 == 0 else 0)) for k, t in enumerate(texts)] + [(None, 500, 500), ("", 501, 501)], "n string, first long, last long")
    want = {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if i != j and i < j + (90 if j % 9 == 0 else 0) and s[:50] == t[:50] and SequenceMatcher(None, s, t).ratio() > 0.85}
    for tile in (2048, 7):
        got = M.close_pairs(rows, 0.85, tile=tile).collect()
        assert {(g.fx, g.fy) for g in got} == want and len(got) == len(want) and any(i > j for i, j in want)


@pytest.mark.parametrize("sizes", [(200, 200), (150, 199), (30, 60)])
def test_pairs_of_any_beginning(spark, sizes):
    r, parts = random.Random(3), "th an er on re in ing ti ed is . , wh ly sh q z x ñ 𝒳 ".split(" ")
    texts = ["".join(r.choices(parts, k=130))[: r.randint(*sizes)] for _ in range(30)]
    for t in list(texts):
        for edits in (1, 2, 6, 9):
            c = list(t)
            for k in [r.randrange(8), *(r.randrange(len(c)) for _ in range(edits * len(c) // 60))]:
                c[k : k + r.randrange(0, 3)] = r.choice(parts)
            texts.append("".join(c)[: sizes[1]])
    texts = list(dict.fromkeys(texts))
    want = {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if i < j and SequenceMatcher(None, s, t).ratio() > 0.85}
    facts = spark.createDataFrame([(k, t, "2026-01-01") for k, t in enumerate(texts)], "id long, text string, date string")
    rows = spark.createDataFrame([(t, k, k) for k, t in enumerate(texts)], "n string, first long, last long")
    for tile, step in ((16_384, 2048), (40, 9)):
        got = M.close_pairs(rows, 0.85, 0, tile, step=step).collect()
        assert {(g.fx, g.fy) for g in got} == want and len(got) == len(want)
    assert sum(texts[i][:50] != texts[j][:50] for i, j in want) > len(want) // 2
    norm = {x.id: x.n for x in facts.select("id", T.normalized_statement(F.col("text")).alias("n")).collect()}
    if all(norm[k] == t for k, t in enumerate(texts)):
        assert {(g.a, g.b) for g in M.near_duplicates(facts, block=0).collect()} == want
        assert {g.id for g in M.near_duplicate_removals(facts, block=0).collect()} == {i for i, _ in want}
