"""The literal prefilter against the plain alternation."""

import random

import pytest
from pyspark.sql import functions as F

from mnemosail import plans
from mnemosail.functions import patterns as P
from mnemosail.functions.literals import ascii_words, finds_any, required
from tests.conftest import DATA
from tests.oracle import TABLES, connect, rows

LISTS = ["CORRECTION", "INSTRUCTION", "LOOSE_CUES", "EPHEMERAL", "EPHEMERAL_REQUEST", "SNAPSHOT", "VALUABLE"]


def test_required_texts():
    assert required(r"\bwrong\s+(file|path)") == {"wrong"} and required("(?:ab|cde)+f") is None and required("(?:abc|DEF){1,3}x?") == {"abc", "def"}
    assert required("(?:abc)?longer|other") == {"longer", "other"} and required("a.c") is None and required("abc*") is None and required("(?=word)x") is None
    assert required("x*?(abcd)y(z|q)") == {"abcd"} and required("") is None


@pytest.mark.parametrize("name", LISTS)
def test_same_as_the_alternation(spark, name):
    patterns, r = getattr(P, name), random.Random(name)
    words = "user is working on a fix because the build passed in progress assistant committed always never no that's not what I said wrong file undo this stop again, you keep making mistake for pr-12 adr-7 running version ready requested mandatory bug due to nist require why did all 12 tests pass don't do that we".split()
    odd = {"s": "ſ", "k": "K", "i": "ı", "I": "İ"}
    texts = [None, "", "\n"]
    for k in range(600):
        t = r.choice([" ", "  ", "\n", " "]).join(r.choices(words, k=r.randrange(1, 12)))
        t = r.choice([str.upper, str.title, str.lower, str])(t)
        if k % 4 == 0:
            t = "".join(odd.get(x, x) if r.random() < 0.4 else x for x in t)
        texts.append(t)
    # every alternative, as it stands in its pattern
    texts += [alternative for p in patterns for alternative in (required(p) or [])]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t").rlike("(?iU)" + P.any_of(patterns))
    rows = df.select(plain.alias("a"), finds_any(F.col("t"), patterns, "iU").alias("b")).collect()
    assert all(x.a == x.b for x in rows) and sum(bool(x.a) for x in rows) > 0


@pytest.mark.parametrize("name", LISTS)
def test_ascii_words_as_in_sql(spark, name):
    import duckdb

    patterns, r = [p for p in getattr(P, name) if "(?!" not in p], random.Random(name)
    pieces = "no that's not wrong file dir correct following don't do use keep making undo this stop confus forgot mistake for fix because due to must always use pr-12 adr-7 build passed all 12 tests pass in progress".split()
    odd = {"s": "ſ", "k": "K", "i": "ı", "I": "İ"}
    texts = ["undoñcira", "éstop", "adr-٣", "keep ñing", "Keep ſing"]
    for k in range(500):
        t = "".join(x + r.choice([" ", " ", "\n", "ñ", "\u00a0", "\u2028", "\x0b", "\r", "_", ""]) for x in r.choices(pieces, k=r.randrange(1, 9)))
        texts.append("".join(odd.get(x, x) if r.random() < 0.1 else x for x in r.choice([str.upper, str.title, str.lower])(t)))
    if not patterns:
        return
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(finds_any(F.col("t"), patterns).alias("b"), F.col("t").rlike(ascii_words(P.CORRECTION_LINE, lines=True)).alias("l")).collect()
    duck = duckdb.connect()
    for t, x in zip(texts, got, strict=True):
        assert duck.execute("SELECT regexp_matches(?, ?), regexp_matches(?, ?)", [t, "(?i)" + P.any_of(patterns), t, "(?im)" + P.CORRECTION_LINE]).fetchall() == [(x.b, x.l)], t


@pytest.mark.parametrize("name", ["loose_regex_prefilter", "agg_prefilter_stats", "is_correction_regex", "udf_classify_correction", "is_instruction"])
def test_letters_outside_ascii_end_words(spark, tmp_path, name):
    texts = ["Queas undoñcira ta", "sasasez undoñiedo en", "we don't useñ", "the ruleñ", "ñmandatoryñ but long enough", "ñno\nſtop", "fine"]
    for t in set(TABLES) - {"conversations"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/sf0.001/{t}.parquet")
    spark.createDataFrame([(k, k % 2, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    next((tmp_path / "c").glob("part-*")).rename(tmp_path / "conversations.parquet")
    assert rows(plans.QUERIES[name](spark, f"file://{tmp_path}").toPandas()) == rows(connect(str(tmp_path)).sql(plans.SQL[name]).df())
