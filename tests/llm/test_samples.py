"""Bounded samples of the text classifiers, and their scores recomputed text by text."""

import functools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemosail.llm import language_id, linear_bag, queries, toxicity
from tests.conftest import DATA

LONG = 1_000_000


def texts_of(stems, n, seed):
    r = random.Random(seed)
    return [" ".join(r.choices(stems.split(), k=12)) for _ in range(n)]


def test_a_long_text_does_not_displace_its_language(spark):
    rows_ = [(k, t, "aa") for k, t in enumerate(texts_of("bado kiru", 200, 1))] + [(1000 + k, t, "bb") for k, t in enumerate(texts_of("zeltan owix", 200, 2))]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    tickets = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1 << 20))
    first = df.where("lang = 'aa'").orderBy(tickets).first().doc_id  # the longest text has the smallest ticket
    df = df.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("bado "), LONG)).otherwise(F.col("text")))
    c = language_id.Config(sample_bytes=1 << 22)
    texts, langs = language_id.language_sample(df, F.lit(True), c)
    assert langs.count("aa") > 100 and langs.count("bb") > 100 and sum(map(len, texts)) <= c.sample_bytes
    got = language_id.predict(df, language_id.fit(texts, langs)).join(df.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() == 400


def test_a_long_text_does_not_displace_its_label(spark):
    rows_ = [(k, t, 1) for k, t in enumerate(texts_of("idiot moron scum", 100, 1))] + [(1000 + k, t, 0) for k, t in enumerate(texts_of("fine good calm kind", 300, 2))]
    df = spark.createDataFrame(rows_, "doc_id long, text string, toxic int")
    first = df.where("toxic = 1").orderBy(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30))).first().doc_id
    docs = df.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("idiot "), LONG)).otherwise(F.col("text")))
    texts, labels = toxicity.labelled_sample(docs, df.select("doc_id", "toxic"), F.lit(True), toxicity.Config(sample_bytes=1 << 22))
    assert labels.count(1) == 99 and labels.count(0) == 300
    got = toxicity.score(docs, toxicity.fit(texts, labels)).join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert all((r.score >= 0.7) == (r.toxic == 1) for r in got)


def test_no_label_is_left_empty(spark):
    rows_ = [(1, "x" * 900, "aa"), (2, "y" * 1200, "aa"), (3, "é" * 50, "bb"), (3, "é" * 50, "bb"), (4, "u" * 90, "bb"), (5, "v" * 20, "bb"), (None, "w" * 10, "bb"), (None, "q" * 5, "bb")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string").withColumn("_id", F.lit(7))
    got = linear_bag.bounded_sample(df, "lang", "text", "doc_id", F.hash("doc_id"), 10, 200)
    kept = {(g, t) for g, t in zip(got["lang"], got["text"], strict=True)}
    assert ("aa", "x" * 50) in kept and len([1 for g, _ in kept if g == "aa"]) == 1  # the beginning of the smallest
    assert {t for g, t in kept if g == "bb"} == {"v" * 20, "w" * 10, "q" * 5, "u" * 90} and len(got) == 5
    assert len(linear_bag.bounded_sample(df.limit(0), "lang", "text", "doc_id", F.hash("doc_id"), 10, 200)) == 0


def buckets(word, lo, hi, n):
    """The word's bag, gram by gram."""
    enc = b"<" + word.encode() + b">"
    out = [zlib.crc32(enc) % n]
    for width in range(lo, hi + 1):
        for i in range(len(enc) - width + 1):
            h = 0
            for k, b in enumerate(enc[i : i + width]):
                h = (h * 0x100000001B3 + b + 1 if k else b + 1) % 2**64
            z = (h + width) % 2**64
            z = ((z ^ (z >> 29)) * 0xBF58476D1CE4E5B9) % 2**64
            out.append((z >> 20) % n)
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


def test_toxicity_scores_text_by_text(spark, documents):
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    model = toxicity.fit(*toxicity.labelled_sample(documents, labels, queries.crc_mod(F.col("doc_id"), 3) != 1))
    c, got = model.config, {r.doc_id: r for r in queries.op4_toxicity(spark, f"{DATA}/sf0.001").collect()}
    margin = functools.cache(lambda w: float(np.mean([model.u[b, 0] for b in buckets(w, c.lo, c.hi, c.buckets)])))
    for r in documents.collect():
        m = [margin(w) for w in re.findall(r"\w+", (r.text or "").lower())]
        worst = model.empty if not m else sum(m) / len(m) * min(1.0, len(m) / 2) + model.bias if len(m) <= c.span else max(sum(m[i : i + c.span]) / c.span for i in range(len(m) - c.span + 1)) + model.bias
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, model.slope * worst + model.shift)))), abs=1e-9)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)
    assert len(got) == documents.count()


def test_training_stays_off_the_driver(spark, documents, monkeypatch):
    labels, usable = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"), queries.crc_mod(F.col("doc_id"), 3) != 1
    want, rows_ = toxicity.fit(*toxicity.labelled_sample(documents, labels, usable)), toxicity.labelled_rows(documents, labels, usable)
    for got, same in ((toxicity.fit_rows(rows_), want), (toxicity.fit_rows(rows_.where("false")), toxicity.fit([], []))):
        assert np.array_equal(got.u, same.u) and got.u.dtype == same.u.dtype and got.config == same.config
        assert (got.bias, got.slope, got.shift, got.empty) == (same.bias, same.slope, same.shift, same.empty)
    none = toxicity.fit_rows(toxicity.labelled_rows(documents, labels.where("false"), usable))
    assert (none.u.shape, none.slope, none.shift) == ((none.config.buckets, 1), 0.0, toxicity.fit([], []).shift)
    here = []  # workers append to copies
    monkeypatch.setattr(toxicity, "fit", lambda *a, f=toxicity.fit: here.append(len(a)) or f(*a))
    kept = corpus_pipeline.drop_toxic(spark, documents, f"{DATA}/sf0.001").count()
    assert 0 < kept < documents.count() and not here


def test_languages_text_by_text(spark, documents):
    model = language_id.fit(*language_id.language_sample(documents, queries.crc_mod(F.col("doc_id"), 4) != 2))
    c, got = model.config, {r.doc_id: r for r in queries.op9_language_id(spark, f"{DATA}/sf0.001").collect()}
    bits = functools.cache(lambda w: np.mean([model.u[b] for b in buckets(w, c.lo, c.hi, c.buckets)], axis=0))
    for r in documents.collect():
        w = re.findall(r"\w+", (r.text or "").lower())
        if not any(x.isalpha() for x in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        margin = np.mean([bits(x) for x in w], axis=0) + model.bias
        loss = [sum(k * math.log1p(math.exp(-s * m)) for k, s, m in zip(model.weight, model.code[i], margin, strict=True)) for i in range(len(model.languages))]
        best = min(range(len(loss)), key=loss.__getitem__)
        assert got[r.doc_id].lang_pred == model.languages[best]
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss), abs=1e-9)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
