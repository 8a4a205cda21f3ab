"""A positional inverted index of texts, in segments of Parquet files.

A segment holds one row per (term, text): the places of the term among the
text's words. Rows are range-partitioned and sorted by term and id, in small row groups, so the
statistics of the files leave only the row groups that a query word's prefix
can be in, and a frequent term spreads over several files. Texts are read
when a segment is built and never by a search.

Texts are added as further segments; a later text of an id replaces the
earlier one, and removed ids are listed, so no segment is ever rewritten by an addition. ``merge`` makes one
segment of all. The list of segments is replaced in one step, so a search sees
all of an addition or none of it. One writer at a time.

Null texts and texts without words are in no posting; rows without an id cannot be found and are left out;
of rows that repeat an id within one addition one counts, the last by path and text. A blank query, or one with a word that no term can start
with, matches nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.batches import small_batches
from ..sources import files
from .memory import keep_first

MANIFEST = "SEGMENTS"
#: Bytes of a row group: what a prefix that few terms share has to read.
GROUP_BYTES = 4 << 20
#: The words of lower-cased text, as ``vectors.words`` has them.
WORD = re.compile("[a-z0-9_]+")


class TextIndex:
    """An index below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def segments(self) -> list[str]:
        """Names of the segments, oldest first."""
        return json.loads(files.read_text(self.spark, f"{self.root}/{MANIFEST}") or "[]")

    def _publish(self, names: list[str]) -> None:
        files.write_text(self.spark, f"{self.root}/{MANIFEST}", json.dumps(names))

    def _read(self, kind: str, names: list[str]) -> DataFrame:
        """Rows of all segments with the segment's number."""
        parts = [self.spark.read.parquet(f"{self.root}/{name}/{kind}").withColumn("seg", F.lit(k)) for k, name in enumerate(names)]
        return reduce(DataFrame.unionByName, parts)

    def add(self, texts: DataFrame, id_col: str = "id", path: str = "filepath", text: str = "search_text") -> None:
        """Index further texts; ids that are known already get their new text."""
        name, known = f"s-{uuid.uuid4().hex}", self.segments()
        rows = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(path).alias("filepath"), F.lower(F.concat_ws(" ", text, path)).alias("low"))
        if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            rows = keep_first(rows, ["id"], F.desc("filepath"), F.desc("low"))
        # texts are dealt evenly (by a hash of their own, or a join on ids would drop the exchange), for those to index may lie in few files, and postings are written before they are sorted: to find the ranges they are read up to three times
        unsorted, n = f"{self.root}/{name}/unsorted", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        postings(rows.select("id", "low").repartition(n, F.xxhash64("id"))).write.parquet(unsorted)
        lists = self.spark.read.parquet(unsorted)
        lists.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", GROUP_BYTES).parquet(f"{self.root}/{name}/postings")
        files.delete(self.spark, unsorted)
        rows.select("id", "filepath").repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.root}/{name}/paths")
        dead = rows.select("id").limit(0)
        if known:
            dead = rows.select("id").join(self._read("paths", known).select("id").distinct(), "id", "left_semi")
        self._finish(name, known, dead)

    def remove(self, ids: DataFrame, id_col: str = "id") -> None:
        """Forget texts: an addition without texts that outdates their ids."""
        name, known = f"s-{uuid.uuid4().hex}", self.segments()
        if known:
            for kind in ("postings", "paths"):
                self._read(kind, known[:1]).drop("seg").limit(0).write.parquet(f"{self.root}/{name}/{kind}")
            self._finish(name, known, ids.select(F.col(id_col).alias("id")).distinct())

    def _finish(self, name: str, known: list[str], dead: DataFrame) -> None:
        dead.write.parquet(f"{self.root}/{name}/outdated")
        self._publish([*known, name])

    def _live(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Rows whose id no later segment outdates."""
        if len(names) < 2:
            return rows
        last = self._read("outdated", names).groupBy("id").agg(F.max("seg").alias("gone"))
        return rows.join(last, "id", "left").where(F.col("gone").isNull() | (F.col("seg") >= F.col("gone"))).drop("gone")

    def merge(self) -> None:
        """One segment of what is live; the files of the old ones stay until the next merge, for searches that read them."""
        names = self.segments()
        if len(names) < 2:
            return
        name = f"s-{uuid.uuid4().hex}"
        for kind, order in (("postings", ("term", "id")), ("paths", ("id",))):
            rows = self._live(self._read(kind, names), names).drop("seg")
            rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{self.root}/{name}/{kind}")
        self._read("outdated", names[:1]).drop("seg").limit(0).write.parquet(f"{self.root}/{name}/outdated")
        before = json.loads(files.read_text(self.spark, f"{self.root}/MERGED") or "[]")
        self._publish([name])
        files.write_text(self.spark, f"{self.root}/MERGED", json.dumps(names))
        for old in before:
            files.delete(self.spark, f"{self.root}/{old}")

    def texts(self) -> DataFrame:
        """id, filepath of every live text."""
        names = self.segments()
        return self._live(self._read("paths", names), names).select("id", "filepath")

    def matches(self, query: str) -> DataFrame:
        """id, score of the texts in which every word of the query starts a word; ``vectors.rank`` of the text, from the postings alone."""
        names, terms = self.segments(), list(dict.fromkeys(query.lower().split()))
        if not names or not terms or None in [V.prefix_pattern(t) for t in terms]:
            return self.spark.createDataFrame([], "id long, score double")
        hits = self._read("postings", names).where(reduce(lambda a, b: a | b, [starts(F.col("term"), t) for t in terms]))
        # postings of an outdated text are left out by text, which fewer rows have than postings
        if len(terms) == 1:
            found = hits.groupBy("id", "seg").agg((F.sum(F.size("places")) * 0.1).alias("score"))
            return self._live(found, names).select("id", "score")
        on = F.array(*[F.col("term").startswith(t) for t in terms])
        mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col("term").startswith(t), 1 << k).otherwise(0) for k, t in enumerate(terms)])
        marked = hits.select("id", "seg", mask.alias("mask"), F.transform("places", lambda p: F.struct(p.alias("at"), on.alias("on"))).alias("marks"))
        found = marked.groupBy("id", "seg").agg(F.bit_or("mask").alias("all"), F.flatten(F.collect_list("marks")).alias("marks")).where(F.col("all") == (1 << len(terms)) - 1)
        return self._live(found, names).select("id", V.cover_of_marks(F.array_sort("marks"), len(terms)).alias("score"))


def postings(texts: DataFrame) -> DataFrame:
    """term, id, places of every word of lower-cased texts (id, low). A text has all its postings at once, so words are neither sorted nor shuffled for them."""
    small_batches(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            terms, rows, ends, places = [], [], [0], array("i")
            for k, low in enumerate(b.column("low").to_pylist()):
                own: dict[str, list[int]] = {}
                for at, word in enumerate(WORD.findall(low)):
                    own.setdefault(word, []).append(at)
                terms.extend(own)
                rows.extend([k] * len(own))
                for found in own.values():
                    places.extend(found)
                    ends.append(len(places))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(places, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), b.column("id").take(pa.array(rows, pa.int64())), lists], ["term", "id", "places"])

    return texts.mapInArrow(run, f"term string, id {kind}, places array<int>")


def starts(term: Column, prefix: str) -> Column:
    """Terms with a prefix, as a range that files can be searched by: words are ASCII letters, digits and ``_``."""
    return (term >= prefix) & (term < prefix[:-1] + chr(ord(prefix[-1]) + 1))
