"""The indexes of texts and vectors against scans of the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemosail.operators import search as S
from mnemosail.operators.postings import TextIndex
from mnemosail.operators.vector_index import Config, VectorIndex
from mnemosail.plans.inputs import Inputs
from tests.conftest import DATA

TEXT = "id long, filepath string, search_text string"


def texts(n, seed, first=0):
    r = random.Random(seed)
    return [(first + k, f"src{k % 3}/f{k}", " ".join(r.choices(["Alpha", "alps", "beta", "be", "gamma_1", "x", "(paren)", "été", "DELTA"], k=r.randrange(0, 30)))) for k in range(n)]


def same(index, rows, query, limit=1000):
    got, want = S.indexed_leg(index, query, limit).toPandas(), S.lexical_leg(rows, query, limit).toPandas()
    assert got["id"].tolist() == want["id"].tolist() and got["filepath"].tolist() == want["filepath"].tolist() and got["rank"].tolist() == want["rank"].tolist()
    assert got["score"].tolist() == pytest.approx(want["score"].tolist(), abs=1e-12)
    return len(got)


QUERIES = ["al", "alp be", "BETA", "gamma_1 al x", "src1 be", "nothing", "be be", "b be"]


def test_postings_equal_a_scan_of_the_texts(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/texts")
    rows = texts(200, 1) + [(500, "p/null", None), (501, None, "alpha beta"), (502, "p", ""), (503, "p", "alpha " * 100_000 + "beta")]
    df = spark.createDataFrame(rows, TEXT)
    index.add(df.unionByName(spark.createDataFrame([(None, "lost", "alpha")], TEXT)).withColumn("term", F.lit(1)))
    found = [same(index, df, q) for q in QUERIES]
    assert found[0] > 100 and found[1] > 20 and found[5] == 0
    assert all(index.matches(q).count() == 0 for q in ("", "  ", "(x", "é", "al (x"))
    # a second segment changes texts and adds some, a third forgets some, and merging changes nothing
    new = spark.createDataFrame(texts(40, 2, 180) + [(503, "p", "short beta")], TEXT)
    index.add(new)
    df = df.join(new, "id", "left_anti").unionByName(new)
    assert len(index.segments()) == 2 and [same(index, df, q) for q in QUERIES][0] > 100
    index.remove(spark.createDataFrame([(k,) for k in range(0, 220, 3)] + [(9999,)], "id long"))
    df = df.where("not (id < 220 and id % 3 = 0)")
    before = [same(index, df, q) for q in QUERIES]
    index.add(spark.createDataFrame(texts(5, 3), TEXT))  # ids that were removed come back
    df = df.where("id >= 5").unionByName(spark.createDataFrame(texts(5, 3), TEXT))
    assert [same(index, df, q) for q in QUERIES] != before
    index.merge()
    assert len(index.segments()) == 1 and sorted(r.id for r in index.texts().collect()) == sorted(r.id for r in df.select("id").collect())
    assert sum(same(index, df, q) for q in QUERIES)
    index.merge()
    assert len(index.segments()) == 1


def test_repeated_ids_and_empty_additions(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/texts")
    assert index.matches("al").count() == 0
    index.add(spark.createDataFrame([(1, "a", "alpha"), (1, "b", "alps alps"), (1, "b", "alps alps")], TEXT))
    (hit,) = S.indexed_leg(index, "al", 5).collect()
    assert (hit.filepath, round(hit.score, 6)) == ("b", 0.2)
    index.add(spark.createDataFrame([], TEXT))
    assert index.matches("al").count() == 1


def plan(df):
    return df._jdf.queryExecution().toString()


def test_searches_do_not_read_texts(spark):
    i = Inputs(spark, f"{DATA}/sf0.01")
    shown = plan(S.indexed_leg(i.text_index(), "th", 10))
    assert "search_text" not in shown and "documents.parquet" not in shown and "GreaterThanOrEqual(term,th), LessThan(term,ti)" in shown
    # the prefix leaves few row groups where files are many
    assert i.text_index() is i.text_index()


def clustered(n, dim, groups, seed):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(groups, dim))
    return [(k, f"src{k % 3}/f{k}", (mid[k % groups] + 0.3 * r.normal(size=dim)).astype(np.float32).tolist()) for k in range(n)]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rows = clustered(3000, 16, 30, 1)
    rows += [(5000, "n", None), (5001, "n", [0.0] * 16), (5002, "n", [float("nan")] * 16), (5003, "n", [1.0, None] * 8), (5004, "n", [1.0] * 7), (5005, "n", []), (5006, "n", [float("inf")] * 16)]
    rows += [rows[0], rows[1], (None, "x", rows[2][2])]
    df = spark.createDataFrame(rows, "id long, filepath string, embedding array<float>")
    index = VectorIndex.build(df, f"file://{tmp_path_factory.mktemp('vectors')}", Config(file_rows=50))
    return df, index


def test_exact_search_equals_a_scan(spark, vectors):
    df, index = vectors
    sound = df.where("id < 5000 or id is null")
    assert index.rows.count() == sound.count() and len(index.cells) > 20
    for seed in range(4):
        q = spark.createDataFrame([(clustered(1, 16, 1, 100 + seed)[0][2],)], "q array<float>") if seed else df.where("id = 7").select(F.col("embedding").alias("q"))
        for scope in (None, F.col("filepath").startswith("src1/")):
            rows = sound if scope is None else sound.where(scope)
            want = S.dense_leg(rows, q, 15).toPandas()
            got = S.ranked(index.exact(q, 15, scope), "score", 15).toPandas()
            assert got[["id", "filepath", "rank"]].astype(str).values.tolist() == want[["id", "filepath", "rank"]].astype(str).values.tolist()
            assert got["score"].tolist() == pytest.approx(want["score"].tolist(), abs=1e-12)
    assert index.exact(spark.createDataFrame([([0.0] * 16,)], "q array<float>"), 5).count() == 0
    assert index.exact(df.where("false").select(F.col("embedding").alias("q")), 5).count() == 0
    assert S.ranked(index.exact(df.where("id = 3").select(F.col("embedding").alias("q")), 10_000), "score", 10_000).count() == sound.count()


def test_exact_search_reads_few_cells(vectors):
    df, index = vectors
    shown = plan(index.exact(df.where("id = 7").select(F.col("embedding").alias("q")), 5))
    cells = shown.rpartition("PartitionFilters: [")[2].partition("]")[0]
    assert 1 <= cells.count(",") < len(index.cells) - 5


def test_probes_recall(spark, vectors, capsys):
    df, index = vectors
    asked = df.where("id % 50 = 0 and id < 3000").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    got = index.probe(asked, 10, cells=4)
    assert "dynamicpruning" in plan(got).lower()
    found = got.toPandas().groupby("query_id")["id"].agg(set)
    hits = [len(found[r.query_id] & {x.id for x in S.dense_leg(df.where("id < 5000"), spark.createDataFrame([(r.q,)], "q array<float>"), 10).collect()}) for r in asked.limit(12).collect()]
    recall = sum(hits) / (10 * len(hits))
    with capsys.disabled():
        print(f"recall@10 of 4 cells of {len(index.cells)}: {recall:.3f}")
    assert recall >= 0.9


def test_no_vectors(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([(1, "p", None)], "id long, filepath string, embedding array<float>"), f"file://{tmp_path}/v")
    q = spark.createDataFrame([([1.0, 2.0],)], "q array<float>")
    assert index.exact(q, 5).count() == 0 and index.probe(q.select(F.lit(1).alias("query_id"), "q"), 5).count() == 0


def test_postings_of_a_text_need_no_grouping(spark):
    from mnemosail.functions import vectors as V
    from mnemosail.operators.postings import postings

    rows = spark.createDataFrame([(k, t.lower()) for k, (_, _, t) in enumerate(texts(40, 9))] + [(90, ""), (91, "é-a_1 A"), (92, None)], "id long, low string").where("low is not null")
    want = rows.select("id", F.posexplode(V.words(F.col("low"))).alias("at", "term")).groupBy("term", "id").agg(F.sort_array(F.collect_list("at")).alias("places"))
    got = postings(rows.withColumn("low", F.lower("low")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
