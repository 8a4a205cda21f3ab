"""Which documents hold which passages, as substrings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files

try:
    import ahocorasick
except ImportError:
    ahocorasick = None


class Passages:
    """Finds all passages of a set in one pass over a text: by an automaton, or without its package by the passages' first characters."""

    def __init__(self, items: list[tuple[int, str]], head: int = 16):
        self.ids: dict[str, list[int]] = {}
        for i, t in items:
            self.ids.setdefault(t, []).append(i)
        self.automaton, self.heads = None, {}
        self.width = min([head, *map(len, self.ids)])
        if ahocorasick is not None and self.ids:
            self.automaton = ahocorasick.Automaton()
            for t in self.ids:
                self.automaton.add_word(t, t)
            self.automaton.make_automaton()
        for t in self.ids if self.automaton is None else ():
            self.heads.setdefault(t[: self.width], []).append(t)

    def within(self, text: str) -> set[int]:
        if self.automaton is not None:
            found = {t for _, t in self.automaton.iter(text)}
        else:
            w, heads = self.width, self.heads
            found = {t for k in range(len(text) - w + 1) for t in heads.get(text[k : k + w], ()) if text.startswith(t, k)} if heads else set()
        return {i for t in found for i in self.ids[t]}


def holders(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "text", chunk: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id) of every document and every whole passage in it. Null and empty passages are in none.

    Passages are broadcast in chunks of about ``chunk`` characters, each one pass over the documents; nothing is shuffled and
    no document meets a passage that it does not hold. Of several chunks each one's result is written before the next is sent, and its broadcast released.
    """
    spark = docs.sparkSession
    items = passages.select(F.col(item_id).cast("long").alias("_i"), F.col(passage).alias("_p")).where(F.length("_p") > 0)
    chunks = max(1, -(-(items.agg(F.sum(F.length("_p"))).first()[0] or 0) // chunk))
    rows = docs.select(F.col(doc_id).cast("long").alias("_d"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    out = None
    for k in range(chunks):
        part = items.where(F.pmod(F.xxhash64("_i", "_p"), F.lit(chunks)) == k).toArrow()
        pairs = list(zip(part["_i"].to_pylist(), part["_p"].to_pylist(), strict=True))
        shared = spark.sparkContext.broadcast(pairs)

        def run(batches, shared=shared):
            found = Passages(shared.value)
            for b in batches:
                hits = [(d, i) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in sorted(found.within(t), key=lambda x: (x is None, x or 0))]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)], ["doc_id", "item_id"])

        one = rows.mapInArrow(run, "doc_id long, item_id long")
        if chunks > 1:
            place = f"{files.scratch(spark, 'passages')}/found"
            one.write.parquet(place)
            one = spark.read.schema("doc_id long, item_id long").parquet(place)
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out
