"""Nearest neighbours by inner product: a vantage-point tree per shard.

Inner products become distances by one more coordinate: where the longest vector has
norm M, each vector x is lengthened by sqrt(M^2 - |x|^2) and each query by 0,
so the nearest point is the one with the largest inner product.

Shards. Up to ``most_cells`` vectors, chosen by a hash of their ids, are top vantage points; every vector is a row of the
cell of its nearest one. Cells of more than ``shard_rows`` vectors are split, so a task's memory is bounded. The
radii between which a cell's vectors lie are all that the driver learns of it.

Search, in two waves. First each query is sent to its own cell, whose k nearest bound the distance it still has to look
within. Then it is sent to the cells that the triangle inequality does not put beyond ``factor`` times that
distance, and to no others; a shard that no query needs is not read. Queries of one shard travel in blocks, so a cell that
many queries need is several tasks.

Inside a shard a node splits its points at the median distance from a vantage point. A query
visits its own side first; the other side is pruned by the same inequality and factor. Factor 1
keeps the search exact; smaller factors prune more and lose some neighbours.
Queries go through a tree together, so every visit is one matrix product.

Each shard returns its k nearest, and the lists are merged by
rank. Scores are inner products of the original vectors in double precision;
ties go to the smaller id. Vectors that are null, zero, of another length than
the most common one, or hold null or non-finite components take no part. Rows that repeat an id and a vector
are one row. An id with several vectors is as many candidates and as many queries, each
with its own ranks from 1; none of its vectors is a candidate for the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import small_batches
from .common import materialize, session

LEAF = 256


class Tree:
    """A vantage-point tree over the rows of ``points``, stored as one row order and node tuples."""

    def __init__(self, points: np.ndarray, seed: int = 3):
        self.x = points
        rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)), rng)

    def _build(self, at: np.ndarray, rng):
        if len(at) <= LEAF:
            return at
        v = int(at[rng.integers(len(at))])
        d = distance(self.x[v][None], self.x[at])[0]
        mid = np.median(d)
        near = d <= mid
        if near.all() or not near.any():  # many equal distances: cut the list
            near = np.arange(len(at)) < len(at) // 2
        a, b = at[near], at[~near]
        return v, (d[near].min(), d[near].max()), (d[~near].min(), d[~near].max()), self._build(a, rng), self._build(b, rng)

    def search(self, q: np.ndarray, k: int, factor: float = 1.0, skip: tuple[np.ndarray, np.ndarray] | None = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, rows) of each query's ``k`` nearest, unordered; rows of -1 stand for none.

        skip: ids of the queries and of the points; equal ones do not match.
        ids: of the points; break ties at the k-th distance.
        """
        n = len(q)
        best_d, best_i = np.full((n, k), np.inf), np.full((n, k), -1)
        qid, pid = skip if skip is not None else (None, None)
        pn = np.einsum("ij,ij->i", self.x, self.x)
        slack = 1e-7 * np.sqrt(pn.max(initial=0))  # what rounding may add to a distance
        qn = np.einsum("ij,ij->i", q, q)

        def leaf(rows: np.ndarray, who: np.ndarray) -> None:
            d = np.maximum(qn[who][:, None] + pn[rows][None] - 2 * (q[who] @ self.x[rows].T), 0)
            if qid is not None:
                d[qid[who][:, None] == pid[rows][None]] = np.inf
            alld = np.concatenate([best_d[who], d], axis=1)
            alli = np.concatenate([best_i[who], np.broadcast_to(rows, d.shape)], axis=1)
            pick = np.argpartition(alld, k - 1, axis=1)[:, :k]
            kth = np.take_along_axis(alld, pick, axis=1).max(axis=1)
            edge = kth + 1e-9 * np.maximum(1, kth)
            # candidates that rounding cannot tell from the k-th: settled by exact products, then ids
            for r in np.flatnonzero((np.isfinite(kth)) & ((alld <= edge[:, None]).sum(axis=1) > k)):
                c = np.flatnonzero(alld[r] <= edge[r])
                rows_r = alli[r, c]
                exact = np.einsum("j,ij->i", q[who[r]], self.x[rows_r])
                pick[r] = c[np.lexsort((rows_r if ids is None else ids[rows_r], -exact))[:k]]
            best_d[who] = np.take_along_axis(alld, pick, axis=1)
            best_i[who] = np.take_along_axis(alli, pick, axis=1)

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                leaf(node, who)
                return
            v, near, far, a, b = node
            d = distance(q[who], self.x[v][None])[:, 0]
            first_a = d <= (near[1] + far[0]) / 2
            for side, turn in ((a, first_a), (b, ~first_a)):
                visit(side, who[turn])
            for side, (lo, hi), turn in ((b, far, first_a), (a, near, ~first_a)):
                gap = np.maximum(np.maximum(lo - d, d - hi), 0)
                tau = np.sqrt(best_d[who].max(axis=1))
                visit(side, who[turn & (gap <= factor * tau * (1 + 1e-9) + slack)])

        if len(self.x):
            visit(self.root, np.arange(n))
        return best_d, best_i


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def usable(vec: Column) -> Column:
    """True where a vector may take part."""
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda v: v != 0), F.lit(False))


def lengthened(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that gives them all the norm ``sqrt(top)``."""
    return np.column_stack([x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))])


def vectors_of(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def batch_of(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def assigned(rows: DataFrame, shared, dim: int, top: float) -> DataFrame:
    """Rows with their cell and the distance from its vantage point (queries: without the added coordinate)."""

    def run(batches):
        pivots = shared.value
        for b in batches:
            ids, asks, x = b.column(0), b.column(2), vectors_of(b.column(1), dim)
            cell, d = np.empty(len(x), np.int32), np.empty(len(x))
            for k in range(0, len(x), 1024):
                far = distance(lengthened(x[k : k + 1024], top), pivots)
                cell[k : k + 1024], d[k : k + 1024] = far.argmin(axis=1), far.min(axis=1)
            yield batch_of({"id": ids, "v": b.column(1), "asks": asks, "cell": cell, "d": d})

    return rows.select("id", "v", "asks").mapInArrow(run, "id long, v array<double>, asks boolean, cell int, d double")


def in_shards(points: DataFrame, asks: DataFrame, k: int, factor: float, dim: int, top: float, parts: Column, shard_rows: int, block: int, found: str) -> DataFrame:
    """(query_id, qh, vec_id, score) of each query (cell, id, qh, v) in the cells that it asks."""
    n = asks.groupBy("cell").agg(F.count("*").alias("n"))
    blocks = n.select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # two small tables of a row per cell at most
    met = points.join(F.broadcast(blocks), "cell")
    sub = F.pmod(F.xxhash64("id"), parts).cast("int")
    met = met.select("cell", sub.alias("sub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("qh"), "v")
    asked = asks.join(F.broadcast(blocks), "cell").select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("sub"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), "id", "qh", "v")

    def answer(pid, px, qid, qh, qx):
        rows = np.column_stack([pid.view(np.float64), px])
        _, first = np.unique(rows.view(f"V{rows.strides[0]}")[:, 0], return_index=True)  # repeated rows are one
        first = first[np.argsort(pid[first], kind="stable")]
        pid, px = pid[first], px[first]
        tree = Tree(lengthened(px, top))
        for i in range(0, len(qid), 256):
            qs, at = qx[i : i + 256], slice(i, i + 256)
            _, near = tree.search(np.column_stack([qs, np.zeros(len(qs))]), k, factor, (qid[at], pid), pid)
            row, col = np.nonzero(near >= 0)
            hit = near[row, col]
            yield batch_of({"query_id": qid[at][row], "qh": qh[at][row], "vec_id": pid[hit], "score": np.einsum("ij,ij->i", qs[row], px[hit])})

    def run(batches):
        now, held = None, [[], []]

        def out():
            points, queries = held
            if points and queries:
                yield from answer(*(np.concatenate([h[c] for h in points]) for c in (0, 2)), *(np.concatenate([h[c] for h in queries]) for c in range(3)))

        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            kind, ids, qh = (b.column(i).to_numpy() for i in (3, 4, 5))
            x = vectors_of(b.column(6), dim)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1]), [True]])) if len(keys) else []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if tuple(keys[a]) != now:
                    yield from out()
                    now, held = tuple(keys[a]), [[], []]
                held[kind[a]].append((ids[a:z], qh[a:z], x[a:z]))
        yield from out()

    cells = met.unionByName(asked).repartition("cell", "sub", "block").sortWithinPartitions("cell", "sub", "block", "kind")
    return materialize(cells.mapInArrow(run, "query_id long, qh long, vec_id long, score double"), found)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, factor: float = 1.0, shard_rows: int = 20_000, min_cells: int = 24, most_cells: int = 4096, block: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest; ``queries`` is a condition on the rows."""
    spark = session(vectors)
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda v: v.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull())
    rows = rows.where(usable(F.col("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, top = sizes[0]
    rows = rows.where(F.size("v") == dim)
    cells = min(most_cells, n, max(min_cells, -(-n // shard_rows)))
    chosen = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(cells).select("v").collect()  # ``most_cells`` vectors at most
    pivots = np.unique(lengthened(np.array([r.v for r in chosen]), top), axis=0)
    shared = spark.sparkContext.broadcast(pivots)
    points = materialize(assigned(rows, shared, dim, top), "points")
    stats = points.groupBy("cell").agg(F.count("*"), F.min("d"), F.max("d")).collect()  # a row per vantage point
    low, high, parts = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.ones(len(pivots), int)
    for c, m, lo, hi in stats:
        low[c], high[c], parts[c] = lo, hi, -(-m // shard_rows)
    split = {c: p for c, p in enumerate(parts.tolist()) if p > 1}
    parts_of = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for e in split.items() for x in e]), F.col("cell")), F.lit(1)) if split else F.lit(1)
    asks = points.where("asks").select("id", F.xxhash64("v").alias("qh"), "v", "cell").dropDuplicates(["id", "qh"])
    near = in_shards(points, asks, k, factor, dim, top, parts_of, shard_rows, block, "near")
    own = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    bound = near.withColumn("r", F.row_number().over(own)).where(F.col("r") == k).select(F.col("query_id").alias("id"), "qh", "score")
    bounds = spark.sparkContext.broadcast((pivots, low, high))

    def others(batches):
        """(cell, id, qh, v) of the other cells that may hold one of a query's k nearest."""
        p, lo, hi = bounds.value
        for b in batches:
            x = vectors_of(b.column(2), dim)
            kth = b.column(4).to_numpy(zero_copy_only=False)
            square = np.einsum("ij,ij->i", x, x) + top - 2 * kth
            reach = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(square, 0)))
            for i in range(0, len(x), 1024):
                at = slice(i, i + 1024)
                d = distance(np.column_stack([x[at], np.zeros(len(x[at]))]), p)
                gap = np.maximum(np.maximum(lo - d, d - hi), 0)
                need = np.isfinite(lo) & (gap <= factor * reach[at, None] * (1 + 1e-9) + 1e-6 * np.sqrt(top))
                need[np.arange(len(d)), b.column(3).to_numpy()[at]] = False
                q, c = np.nonzero(need)
                for j in range(0, len(q), 4096):
                    t = pa.array(q[j : j + 4096] + i)
                    yield batch_of({"cell": c[j : j + 4096].astype(np.int32), "id": b.column(0).take(t), "qh": b.column(1).take(t), "v": b.column(2).take(t)})

    more = asks.join(bound, ["id", "qh"], "left").select("id", "qh", "v", "cell", F.col("score").cast("double")).mapInArrow(others, "cell int, id long, qh long, v array<double>")
    more = materialize(more, "asks")
    rest = in_shards(points, more, k, factor, dim, top, parts_of, shard_rows, block, "near")
    ranked = near.unionByName(rest).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
