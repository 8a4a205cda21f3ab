"""An inverted-file index of vectors: cells around centroids, one folder of files for each.

Centroids are spherical k-means of a bounded sample (``sample`` vectors by a
hash of their ids). Every vector goes to the cell of its nearest centroid; files are
partitioned by cell, so a search reads the folders of the cells it probes and no
others. A cell with many vectors is written by several tasks.

``exact`` finds the same rows as a scan of all vectors by cosine: the cells nearest to
the query are read first, and then those that the triangle inequality of angles leaves, given
each cell's radius and the scores found so far. ``probe`` reads the ``cells`` nearest
cells of each query and no more, which is approximate; queries come as a table and
are joined to the cells by dynamic partition pruning.

Vectors that are null, zero or of another length, or hold null or non-finite values, are in no cell and never found. Null ids are
kept. Repeated rows repeat.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..sources import files

#: Angles are found in double precision; bounds give way by this much.
SLACK = 1e-6


@dataclass(frozen=True)
class Config:
    cells: int = 4096  # at most; about the root of the number of vectors, if that is less
    sample: int = 65_536
    rounds: int = 8
    file_rows: int = 1_000_000
    seed: int = 13


def unit_rows(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which of the rows have any."""
    out, ok = np.zeros((len(vectors), dim)), np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        if v is not None and len(v) == dim and None not in v:
            a = np.asarray(v, float)
            n = float(np.sqrt((a * a).sum()))
            if 0 < n < math.inf:
                out[k], ok[k] = a / n, True
    return out, ok


def centroids(units: np.ndarray, cells: int, c: Config) -> np.ndarray:
    """Spherical k-means; cells that lose all their vectors start again at the worst placed one."""
    rng = np.random.default_rng(c.seed)
    cells = min(cells, len(units))
    at = units[np.sort(rng.choice(len(units), cells, replace=False))].copy()
    for _ in range(c.rounds):
        own, near = nearest(units, at)
        total = np.zeros_like(at)
        np.add.at(total, own, units)
        size = np.sqrt((total**2).sum(axis=1))
        lost = np.flatnonzero(size < 1e-12)
        at[size >= 1e-12] = total[size >= 1e-12] / size[size >= 1e-12][:, None]
        at[lost] = units[np.argsort(near)[: len(lost)]]
    return at


def nearest(units: np.ndarray, at: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector and the cosine to it."""
    own, near = np.zeros(len(units), np.int64), np.zeros(len(units))
    for k in range(0, len(units), block):
        cos = units[k : k + block] @ at.T
        own[k : k + block] = cos.argmax(axis=1)
        near[k : k + block] = cos.max(axis=1)
    return own, near


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        built = json.loads(files.read_text(spark, f"{root}/BUILT"))
        self.rows = spark.read.schema(T.StructType.fromJson(built["schema"])).parquet(f"{root}/vectors")
        cells = spark.read.parquet(f"{root}/cells").toPandas().sort_values("cell")  # one row per cell
        self.at, self.cells = np.array(cells["centroid"].tolist(), float).reshape(len(cells), built["dim"]), cells["cell"].to_numpy()
        self.radius = cells["radius"].to_numpy()

    @classmethod
    def build(cls, rows: DataFrame, root: str, c: Config = Config(), id_col: str = "id", embedding: str = "embedding", payload: tuple[str, ...] = ("filepath",)) -> VectorIndex:
        """Writes the index of ``rows`` (id, embedding and the columns of ``payload``) below ``root``, a shared folder."""
        spark, root = rows.sparkSession, f"{root.rstrip('/')}/i-{uuid.uuid4().hex}"
        rows = rows.select(F.col(id_col).alias("id"), F.col(embedding).alias("embedding"), *payload)
        sized = rows.where(F.size("embedding") > 0)
        lengths = sized.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
        dim, n = (lengths[0]["dim"], lengths[0]["n"]) if lengths else (0, 0)
        ticket = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("cells")), F.lit(1 << 20))
        some = sized.where((F.size("embedding") == dim) & (ticket < int((1 << 20) * min(1.0, 1.2 * c.sample / max(n, 1))) + 1)).select("embedding").limit(c.sample)
        units, ok = unit_rows(some.toPandas()["embedding"].tolist(), dim)
        at = centroids(units[ok], min(c.cells, max(1, math.isqrt(n))), c) if ok.any() else np.zeros((0, dim))
        share = np.bincount(nearest(units[ok], at)[0], minlength=len(at)) / max(1, ok.sum()) if len(at) else np.zeros(0)
        tasks = np.maximum(1, np.ceil(share * n / c.file_rows)).astype(int)
        shared = spark.sparkContext.broadcast((at, tasks))
        schema = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("near", T.DoubleType())])

        def place(batches):
            at, tasks = shared.value
            for b in batches:
                units, ok = unit_rows(b.column("embedding").to_pylist(), dim)
                ok &= len(at) > 0
                own, near = nearest(units, at) if len(at) else (np.zeros(len(units), np.int64), np.zeros(len(units)))
                part = np.arange(len(own)) % tasks[own] if len(at) else own
                extra = [pa.array(own, pa.int32(), mask=~ok), pa.array(part, pa.int32()), pa.array(near, pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "cell", "part", "near"]).filter(pa.array(ok))

        placed = rows.mapInArrow(place, schema)
        placed.repartition("cell", "part").drop("part").write.partitionBy("cell").parquet(f"{root}/vectors")
        found = spark.read.schema("near double, cell int").parquet(f"{root}/vectors").groupBy("cell").agg(F.min("near").alias("near")).collect()  # one row per cell
        table = [(int(r["cell"]), at[r["cell"]].tolist(), math.acos(max(-1.0, min(1.0, r["near"])))) for r in found]
        spark.createDataFrame(table, "cell int, centroid array<double>, radius double").coalesce(1).write.parquet(f"{root}/cells")
        kept = T.StructType([f for f in schema if f.name != "part"])
        files.write_text(spark, f"{root}/BUILT", json.dumps({"schema": kept.jsonValue(), "dim": dim}))
        return cls(spark, root)

    def _of(self, cells: np.ndarray) -> DataFrame:
        """Rows of some cells; only their folders are read."""
        return self.rows.where(F.col("cell").isin([int(x) for x in cells])) if len(cells) < len(self.cells) else self.rows

    def _near(self, query: np.ndarray) -> np.ndarray:
        """Places of the cells, nearest first."""
        return np.argsort(-(self.at @ query), kind="stable")

    def exact(self, query: DataFrame, limit: int, scope: Column | None = None, first: int = 8) -> DataFrame:
        """id, payload, score of rows among which are the ``limit`` best of the one query (column ``q``), by score and id."""
        asked = query.limit(1).collect()
        unit, ok = unit_rows([asked[0]["q"]] if asked else [None], self.at.shape[1])
        none = self.rows.limit(0).withColumn("score", F.lit(0.0)).drop("embedding", "cell", "near")
        if not ok[0] or not len(self.cells):
            return none
        vector = F.lit([float(x) for x in asked[0]["q"]])
        scored = lambda rows: (rows if scope is None else rows.where(scope)).withColumn("score", V.cosine(F.col("embedding"), vector)).drop("embedding", "cell", "near")
        order = self._near(unit[0])
        take = min(first, len(order))
        # the worst of the best so far bounds the angle that is still of interest
        least = scored(self._of(self.cells[order[:take]])).select("score").orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
        if least["n"] < limit:
            return scored(self.rows)
        angle = np.arccos(np.clip(self.at @ unit[0], -1, 1))
        open_ = np.maximum(angle - self.radius, 0) <= math.acos(max(-1.0, min(1.0, least["score"]))) + SLACK
        open_[order[:take]] = True
        return scored(self._of(self.cells[open_]))

    def probe(self, queries: DataFrame, limit: int, cells: int = 8) -> DataFrame:
        """query_id, rank, id, payload, score: the best ``limit`` rows in the ``cells`` cells nearest to each query (query_id, q)."""
        shared = self.spark.sparkContext.broadcast((self.at, self.cells))
        dim = self.at.shape[1]

        def near(batches):
            at, names = shared.value
            for b in batches:
                units, ok = unit_rows(b.column(1).to_pylist(), dim)
                if not ok.any():
                    continue
                best = np.argsort(-(units[ok] @ at.T), axis=1, kind="stable")[:, :cells]
                frame = pd.DataFrame({"k": np.repeat(np.flatnonzero(ok), best.shape[1]), "cell": names[best.ravel()]})
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(frame["k"])), b.column(1).take(pa.array(frame["k"])), pa.array(frame["cell"], pa.int32())], ["query_id", "q", "cell"])

        asked = queries.select(F.col("query_id"), F.col("q").cast("array<double>").alias("q"))
        probes = asked.mapInArrow(near, T.StructType([*asked.schema, T.StructField("cell", T.IntegerType())]))
        met = self.rows.join(probes, "cell").withColumn("score", V.cosine(F.col("embedding"), F.col("q"))).drop("embedding", "cell", "near", "q")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return met.withColumn("rank", rank).where(F.col("rank") <= limit)
