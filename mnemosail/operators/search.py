"""Hybrid retrieval: a dense and a lexical leg, fused by reciprocal rank.

Each leg keeps its best ``3 * limit`` rows as a top-k (no full sort, one row list
per task), so fusion and everything after it see a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from .postings import TextIndex
from .vector_index import VectorIndex

POOL, RRF_K = 3, 60


def in_scope(filepath: Column, repo: str | None = None, release: str | None = None) -> Column:
    """Paths of one release line, of one repository, or of no release at all."""
    if release:
        return filepath.like(f"{repo}@release-{release}/%") if repo else filepath.like(f"%@release-{release}/%")
    cond = ~filepath.like("%@%")
    return filepath.like(f"{repo}/%") & cond if repo else cond


def ranked(df: DataFrame, score: str, limit: int, id_col: str = "id") -> DataFrame:
    """Best rows by score, then id, with their rank from 1. The window sees at most ``limit`` rows."""
    top = df.orderBy(F.desc(score), id_col).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def dense_leg(chunks: DataFrame, query: DataFrame, limit: int) -> DataFrame:
    """chunks: id, filepath, embedding; query: one row ``q``."""
    scored = chunks.crossJoin(F.broadcast(query.limit(1))).withColumn("score", V.cosine(F.col("embedding"), F.col("q")))
    return ranked(scored.where(F.col("score").isNotNull()).select("id", "filepath", "score"), "score", limit)


def indexed_leg(index: TextIndex, query: str, limit: int, scope: Column | None = None) -> DataFrame:
    """``lexical_leg`` from an index: of the texts, only ids, paths and places of words are read."""
    hits = index.matches(query).join(index.texts(), "id")
    return ranked(hits if scope is None else hits.where(scope), "score", limit)


def lexical_leg(chunks: DataFrame, query: str, limit: int) -> DataFrame:
    """Rows in which every query word is a prefix of a word, by ``vectors.rank``. Texts are searched as they are; only matching ones are split."""
    low = F.lower(F.concat_ws(" ", "search_text", "filepath"))
    hits = chunks.where(V.matches_all(low, query))
    return ranked(hits.select("id", "filepath", V.rank(low, query).alias("score")), "score", limit)


def fuse(dense: DataFrame, lexical: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion; ties keep dense rows first, then lexical order."""
    d = dense.select("id", F.col("filepath").alias("df"), F.col("score").alias("dense_score"), F.col("rank").alias("dr"))
    x = lexical.select("id", F.col("filepath").alias("lf"), F.col("score").alias("lexical_score"), F.col("rank").alias("lr"))
    part = lambda r: F.coalesce(1 / (RRF_K + F.col(r)), F.lit(0.0))
    both = d.join(x, "id", "full").withColumn("rrf", part("dr") + part("lr"))
    order = [F.desc("rrf"), F.asc_nulls_last("dr"), F.asc_nulls_last("lr"), F.asc("id")]
    top = both.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.select("id", F.coalesce("df", "lf").alias("filepath"), F.round("dense_score", 4).alias("dense_score"), F.round("lexical_score", 4).alias("lexical_score"), F.round("rrf", 6).alias("rrf_score"), "rank")


def search(
    chunks: DataFrame, query_vector: DataFrame, query: str, limit: int = 10, mode: str = "hybrid", repo: str | None = None, release: str | None = None,
    texts: TextIndex | None = None, vectors: VectorIndex | None = None,
) -> DataFrame:
    """Hybrid, dense or lexical search over one scope. With an index of texts or of vectors a leg reads that instead of ``chunks``; the rows are the same."""
    limit, scope = min(limit, 20), in_scope(F.col("filepath"), repo, release)
    scoped = chunks.where(scope)

    def dense(n: int) -> DataFrame:
        return dense_leg(scoped, query_vector, n) if vectors is None else ranked(vectors.exact(query_vector, n, scope), "score", n)

    def lexical(n: int) -> DataFrame:
        return lexical_leg(scoped, query, n) if texts is None else indexed_leg(texts, query, n, scope)

    if mode == "dense":
        return dense(limit).withColumn("score", F.round("score", 4))
    if mode == "lexical":
        return lexical(limit).withColumn("score", F.round("score", 4))
    return fuse(dense(POOL * limit), lexical(POOL * limit), limit)


def nearest_seed(rows: DataFrame, seeds: DataFrame, threshold: float, block: int = 10_000) -> DataFrame:
    """id, best, candidate: similarity to the closest seed.

    Seeds travel as one array of ``block`` vectors at most, so rows are neither multiplied nor shuffled; of more seeds each
    block is one pass over the rows.
    """
    parts = max(1, -(-seeds.count() // block))
    part = F.pmod(F.xxhash64("seed"), F.lit(parts))
    best = None
    for k in range(parts):
        own = seeds.where(part == k).agg(F.collect_list("seed").alias("_seeds"))  # one row
        near = F.array_max(F.transform("_seeds", lambda s: V.cosine(F.col("embedding"), s)))
        rows_of = rows.crossJoin(F.broadcast(own)).select("id", near.alias("best"))
        best = rows_of if best is None else best.unionByName(rows_of)
    if parts > 1:
        best = best.groupBy("id").agg(F.max("best").alias("best"))
    return best.withColumn("candidate", F.col("best") >= threshold)


def pattern_matches(files: DataFrame, pattern: str, limit: int, root: str = "root", path: str = "filepath", text: str = "code", group: int = 0) -> DataFrame:
    """root, path, place, hit: the first ``limit`` matches of a regular expression, by root, path and place in the text.

    Stands in for structural patterns, which need a grammar for each language.
    """
    hits = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), group)).alias("place", "hit")
    found = files.where(F.col(text).rlike(pattern)).select(root, path, hits)
    return found.orderBy(root, path, "place").limit(limit)
