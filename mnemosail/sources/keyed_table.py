"""A table of rows by key, in hash buckets of which a change rewrites only those it touches.

A manifest names the folder that holds each bucket and is replaced in one step, so readers
see all of a change or none of it, and a change that fails leaves the table as it was. Folders that a change
replaced stay until the next change, for who reads them still. One writer at a time.

``upsert`` keeps of each key the row of the highest version, new rows before old ones; the same batch
twice leaves the same table. ``declare`` makes the table hold exactly the declared rows: rows that are no
longer declared go, and buckets without a difference keep their files. Null keys are keys like others, in a
bucket of their own hash; of rows that repeat a key in one batch one stays, by version and then content.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.memory import keep_first
from . import files

MANIFEST = "BUCKETS"


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType, key: str, version: str | None = None, buckets: int = 64) -> KeyedTable:
        """An empty table; ``version`` orders the rows of a key. Big tables take as many buckets as leave some 100 MB in each."""
        out = cls(spark, root)
        out._publish({"key": key, "version": version, "n": buckets, "schema": schema.jsonValue(), "at": {}, "old": []})
        return out

    def _state(self) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.root}/{MANIFEST}"))

    def _publish(self, state: dict) -> None:
        files.write_text(self.spark, f"{self.root}/{MANIFEST}", json.dumps(state))

    def folders(self) -> dict[int, str]:
        """The folder of each bucket that holds rows."""
        return {int(k): v for k, v in self._state()["at"].items()}

    def _read(self, state: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [v for k, v in state["at"].items() if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read(self._state())

    def _bucketed(self, df: DataFrame, state: dict) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(state["key"]).cast("string")), F.lit(state["n"])).cast("int"))

    def _touched(self, keys: DataFrame, state: dict) -> set[int]:
        return {r["_bucket"] for r in self._bucketed(keys, state).select("_bucket").distinct().collect()}  # buckets at most

    def _first(self, df: DataFrame, state: dict, *more) -> DataFrame:
        order = [F.desc_nulls_last(state["version"])] if state["version"] else []
        content = [f.name for f in StructType.fromJson(state["schema"])]
        return keep_first(df, [state["key"]], *order, *more, F.xxhash64(*content))

    def _rewrite(self, rows: DataFrame, touched: set[int], state: dict) -> None:
        """Writes the buckets anew and moves the manifest."""
        names = [f.name for f in StructType.fromJson(state["schema"])]
        place = f"{self.root}/v-{uuid.uuid4().hex}"
        self._bucketed(rows.select(*names), state).repartition("_bucket").write.partitionBy("_bucket").parquet(place)
        written = set(files.folder_names(self.spark, place))
        at, gone = dict(state["at"]), []
        for b in touched:
            if str(b) in at:
                gone.append(at.pop(str(b)))
            if f"_bucket={b}" in written:
                at[str(b)] = f"{place}/_bucket={b}"
        self._publish(state | {"at": at, "old": gone})
        for path in state["old"]:
            files.delete(self.spark, path)

    def upsert(self, batch: DataFrame) -> int:
        """Number of buckets that were rewritten."""
        state = self._state()
        touched = self._touched(batch.select(state["key"]), state)
        if touched:
            both = self._read(state, touched).withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
            self._rewrite(self._first(both, state, F.desc("_new")), touched, state)
        return len(touched)

    def declare(self, rows: DataFrame) -> int:
        """The same, and rows of keys that are not declared are dropped."""
        state = self._state()
        names = [f.name for f in StructType.fromJson(state["schema"])]
        rows = self._first(rows.select(*names), state)
        mark = F.xxhash64(*[F.struct(F.col(n).isNull(), n) for n in names])
        have, want = self._read(state).select(state["key"], mark.alias("_have")), rows.select(F.col(state["key"]).alias("_key"), mark.alias("_want"))
        both = have.join(want, have[state["key"]].eqNullSafe(F.col("_key")), "full")
        differ = both.where(~F.col("_have").eqNullSafe(F.col("_want"))).select(F.coalesce(state["key"], "_key").alias(state["key"]))
        touched = self._touched(differ, state)
        if touched:
            self._rewrite(self._bucketed(rows, state).where(F.col("_bucket").isin(touched)).drop("_bucket"), touched, state)
        return len(touched)
