"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import search as S
from .inputs import CHUNK, Inputs
from .registry import query

TERM = "th"
QV = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id=0)"
COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT q FROM q))"
WORDS = "list_filter(string_split_regex(lower(search_text||' '||filepath), '[^a-z0-9_]+'), lambda w: w <> '')"
DENSE = "dense AS (SELECT id, filepath, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, filepath, {cos} AS score FROM chunk WHERE {where} ORDER BY score DESC, id LIMIT {n}))"
LEX = "lex AS (SELECT id, filepath, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, filepath, 0.1::DOUBLE*len(list_filter({words}, lambda w: starts_with(w, '{term}'))) AS score FROM chunk WHERE {where} AND {match} ORDER BY score DESC, id LIMIT {n}))"
MAIN = "filepath NOT LIKE '%@%'"


def legs(n: int, where: str = MAIN, term: str = TERM) -> str:
    match = " AND ".join(f"len(list_filter({WORDS}, lambda w: starts_with(w, '{x}'))) > 0" for x in term.split())
    return f"{CHUNK}, {QV}, " + DENSE.format(cos=COS, where=where, n=n) + ", " + LEX.format(words=WORDS, term=term.split()[0], where=where, match=match, n=n)


RRF = "fused AS (SELECT coalesce(d.id,l.id) AS id, coalesce(d.filepath,l.filepath) AS filepath, d.score AS ds, l.score AS ls, d.rank AS dr, l.rank AS lr, coalesce(1.0::DOUBLE/(60+d.rank),0)+coalesce(1.0::DOUBLE/(60+l.rank),0) AS rrf FROM dense d FULL JOIN lex l ON d.id=l.id)"
TOP = "SELECT id, filepath, round(ds,4) AS dense_score, round(ls,4) AS lexical_score, round(rrf,6) AS rrf_score, row_number() OVER (ORDER BY rrf DESC, dr NULLS LAST, lr NULLS LAST, id) AS rank FROM fused ORDER BY rank LIMIT 10"


def searched(i: Inputs, query: str, mode: str = "hybrid", release: str | None = None):
    """The ten best, from the indexes that the mode needs."""
    texts, vectors = i.text_index() if mode != "dense" else None, i.vector_index() if mode != "lexical" else None
    return S.search(i.chunks(), vector(i), query, 10, mode, release=release, texts=texts, vectors=vectors)


def dense(i: Inputs, limit: int):
    return S.ranked(i.vector_index().exact(vector(i), limit), "score", limit)


def vector(i: Inputs):
    return i.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


@query("search_hybrid", f"WITH {legs(30)}, {RRF} {TOP}")
def hybrid(i: Inputs):
    return searched(i, TERM)


@query("search_hybrid_release", f"WITH {legs(30, "filepath LIKE '%@release-v1.5/%'")}, {RRF} {TOP}")
def _(i: Inputs):
    return searched(i, TERM, release="v1.5")


@query("search_dense", f"WITH {legs(10)} SELECT id, filepath, round(score,4) AS score, rank FROM dense")
def _(i: Inputs):
    return searched(i, TERM, "dense")


@query("search_bm25", f"WITH {legs(10)} SELECT id, filepath, round(score,4) AS score, rank FROM lex")
def _(i: Inputs):
    return searched(i, TERM, "lexical")


@query("topk_dense", f"WITH {legs(15, 'true')} SELECT id, round(score,4) AS score FROM dense")
def _(i: Inputs):
    return dense(i, 15).select("id", F.round("score", 4).alias("score"))


@query("topk_lexical", f"WITH {legs(15, 'true')} SELECT id, round(score,4) AS score FROM lex")
def _(i: Inputs):
    return S.indexed_leg(i.text_index(), TERM, 15).select("id", F.round("score", 4).alias("score"))


@query("topk_rrf", f"WITH {legs(12, 'true')}, {RRF} SELECT id, round(rrf,6) AS rrf_score FROM fused ORDER BY rrf DESC, dr NULLS LAST, lr NULLS LAST, id LIMIT 5")
def _(i: Inputs):
    return S.fuse(dense(i, 12), S.indexed_leg(i.text_index(), TERM, 12), 5).select("id", "rrf_score")


@query("win_rrf_rank", f"WITH {legs(20, 'true')} SELECT id, round(1.0::DOUBLE/(60+rank),6) AS part FROM dense")
def _(i: Inputs):
    return dense(i, 20).select("id", F.round(1 / (60 + F.col("rank")), 6).alias("part"))


@query("join_dense_lexical_full_outer", f"WITH {legs(25, 'true')}, {RRF} SELECT id, dr IS NOT NULL AS in_dense, lr IS NOT NULL AS in_lexical FROM fused")
def _(i: Inputs):
    d, x = dense(i, 25).select("id", "rank"), S.indexed_leg(i.text_index(), TERM, 25).select("id", F.col("rank").alias("lr"))
    return d.join(x, "id", "full").select("id", F.col("rank").isNotNull().alias("in_dense"), F.col("lr").isNotNull().alias("in_lexical"))


@query("cross_join_query", f"WITH {QV} SELECT vec_id, round({COS},4) AS similarity FROM embeddings")
def _(i: Inputs):
    return i.table("embeddings").crossJoin(F.broadcast(vector(i))).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 4).alias("similarity"))


@query("fn_cosine", "SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1")
def _(i: Inputs):
    e = i.table("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 4).alias("similarity"))


@query("branch_scope_filter", f"WITH {CHUNK} SELECT id, filepath LIKE 'src1@release-v1.5/%' AS release_repo, filepath LIKE '%@release-v1.5/%' AS release_any, filepath LIKE 'src1/%' AND filepath NOT LIKE '%@%' AS repo, filepath NOT LIKE '%@%' AS main FROM chunk")
def _(i: Inputs):
    p = F.col("filepath")
    return i.chunks().select("id", S.in_scope(p, "src1", "v1.5").alias("release_repo"), S.in_scope(p, None, "v1.5").alias("release_any"), S.in_scope(p, "src1").alias("repo"), S.in_scope(p).alias("main"))


@query("fn_tsquery_prefix_and", f"WITH {CHUNK} SELECT id, len(list_filter({WORDS}, lambda w: starts_with(w, 'th')))>0 AND len(list_filter({WORDS}, lambda w: starts_with(w, 'an')))>0 AS matches FROM chunk")
def _(i: Inputs):
    return i.chunks().select("id", V.matches_all(F.lower(F.concat_ws(" ", "search_text", "filepath")), "TH  an").alias("matches"))


#: Cover density of the words that start with ``th`` and with ``an``: a run for each match whose earliest last partner moved on.
COVER = f"""w AS (SELECT id, filepath, {WORDS} AS ws FROM chunk WHERE {{where}}),
e AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
m AS (SELECT id, pos, starts_with(word, 'th') AS a, starts_with(word, 'an') AS b FROM e WHERE starts_with(word, 'th') OR starts_with(word, 'an')),
s AS (SELECT *, row_number() OVER x AS k, max(CASE WHEN a THEN pos END) OVER x AS pa, max(CASE WHEN b THEN pos END) OVER x AS pb FROM m WINDOW x AS (PARTITION BY id ORDER BY pos)),
c AS (SELECT *, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN least(pa, pb) END AS low FROM s),
d AS (SELECT *, max(low) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM c),
cover AS (SELECT d.id AS id, sum(0.1::DOUBLE/(1+(d.pos-d.low)-(d.k-f.k))) AS score FROM d JOIN c f ON f.id=d.id AND f.pos=d.low WHERE d.low IS NOT NULL AND (past IS NULL OR d.low>past) GROUP BY 1)"""


@query("fn_ts_rank_cd", f"WITH {CHUNK}, {COVER.format(where='true')} SELECT w.id AS id, round(coalesce(score, 0), 4) AS score FROM w LEFT JOIN cover ON cover.id=w.id")
def _(i: Inputs):
    return i.chunks().select("id", F.round(V.rank(F.lower(F.concat_ws(" ", "search_text", "filepath")), "th an"), 4).alias("score"))


@query("search_lexical_words", f"WITH {CHUNK}, {COVER.format(where=MAIN)}, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(score, 9) AS score FROM cover)) SELECT r.id AS id, filepath, round(score, 4) AS score, rank FROM r JOIN w ON w.id=r.id WHERE rank <= 10")
def _(i: Inputs):
    return searched(i, "th an", "lexical")


@query("scan_pg_vector_table", "SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
def _(i: Inputs):
    return i.table("embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))


@query("embed_gate", "WITH s AS (SELECT embedding::DOUBLE[] AS seed FROM embeddings WHERE vec_id < 5) SELECT id, round(best,4) AS best, best >= 0.5 AS candidate FROM (SELECT vec_id AS id, max(list_cosine_similarity(embedding::DOUBLE[], seed)) AS best FROM embeddings, s GROUP BY 1)")
def _(i: Inputs):
    e = i.table("embeddings")
    seeds = e.where("vec_id < 5").select(F.col("embedding").alias("seed"))
    return S.nearest_seed(e.select(F.col("vec_id").alias("id"), "embedding"), seeds, 0.5).withColumn("best", F.round("best", 4))


@query("agg_threshold_sweep", """WITH s AS (SELECT embedding::DOUBLE[] AS seed FROM embeddings WHERE vec_id < 5),
b AS (SELECT vec_id, max(list_cosine_similarity(embedding::DOUBLE[], seed)) AS best, any_value(label) AS label FROM embeddings, s GROUP BY 1),
x AS (SELECT th, count(*) FILTER (label<3 AND best>=th) AS tp, count(*) FILTER (label>=3 AND best>=th) AS fp, count(*) FILTER (label<3 AND best<th) AS fn, count(*) FILTER (label>=3 AND best<th) AS tn FROM b, (SELECT unnest([0.30,0.35,0.40,0.45,0.50,0.55]::DOUBLE[]) AS th) GROUP BY 1),
y AS (SELECT *, coalesce(tp::DOUBLE/nullif(tp+fp,0),0) AS p, coalesce(tp::DOUBLE/nullif(tp+fn,0),0) AS r FROM x)
SELECT th AS threshold, tp, fp, fn, tn, round(p,4) AS precision, round(r,4) AS recall, round(coalesce(2*p*r/nullif(p+r,0),0),4) AS f1 FROM y""")
def _(i: Inputs):
    from ..operators.rollups import confusion

    e = i.table("embeddings")
    seeds = e.where("vec_id < 5").select(F.col("embedding").alias("seed"))
    best = S.nearest_seed(e.select(F.col("vec_id").alias("id"), "embedding"), seeds, 0.5).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    rows = best.withColumn("threshold", F.explode(F.array(*map(F.lit, (0.30, 0.35, 0.40, 0.45, 0.50, 0.55)))))
    return confusion(rows, F.col("label") < 3, F.col("best") >= F.col("threshold"), "threshold")
