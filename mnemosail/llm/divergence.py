"""Divergence audit of sources: how each source of a language uses words unlike the others.

A language keeps the terms that at least ``least_docs`` of its documents hold. Every
(language, source) group gives each kept term a smoothed share p in parts of
10**9; the divergence of a term from shares q is floor((p - q)**2 / q). Pairs
of a language's sources are compared in both directions over all kept terms; and the terms that
a source uses more than its language does are ranked.

The comparison is a systolic rotation. A language's terms are dealt into slices
of about ``width`` terms by hash, its sources into blocks of ``block`` groups, so what
a cell (language, slice, block) holds is bounded. Cells stay in their partition; compressed
copies of other blocks come by in the rounds of a round-robin tournament, in
which any two blocks of a slice meet once, and a meeting gives both directions of all its pairs. Terms
that neither source of a pair uses are counted, not listed. ``wave`` rounds are
one shuffle. A cell ranks the terms of its groups and keeps the first ``top``, which are merged by rank.

All arithmetic is in integers and exact for counts below 9e15. Null text,
language and source are read as ''. Groups without kept terms take part with
count 0 everywhere; a language without kept terms has only pairs of value 0, a language of one source has no pairs.
Repeated rows count each time, without regard to ids; ties are ranked by item in byte order. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import small_batches
from .common import materialize, session

#: A-Z become lower case, bytes that are no part of a term become blanks; bytes of 128 and more belong to terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: A term's occurrences and documents in one number.
_ONE_DOC = 1 << 64
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Config:
    least_docs: int = 3
    top: int = 200
    width: int = 1 << 15
    block: int = 8
    wave: int = 16
    #: Distinct (group, term) entries that a task holds before it writes them.
    held: int = 400_000


def term_counts(docs: DataFrame, c: Config, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n, docs of each term of each group, and a row without a term for each group."""

    def count(batches):
        held: dict[tuple[str, str], dict[bytes | None, int]] = {}
        size = 0

        def flush():
            for (g, s), found in held.items():
                terms, sums = list(found), list(found.values())
                for k in range(0, len(terms), 50_000):
                    part = sums[k : k + 50_000]
                    at = [pa.array([x] * len(part)) for x in (g, s)]
                    names = pa.array([None if t is None else t.decode() for t in terms[k : k + 50_000]], pa.string())
                    yield pa.RecordBatch.from_arrays([*at, names, pa.array([x % _ONE_DOC for x in part]), pa.array([x // _ONE_DOC for x in part])], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            for g, s, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                found = held.setdefault((g, s), {None: 0})
                size -= len(found)
                for term, n in Counter(t.translate(_TERM_BYTES).split()).items():
                    found[term] = found.get(term, 0) + n + _ONE_DOC
                size += len(found)
                if size > c.held:
                    yield from flush()
                    size = 0
        yield from flush()

    empty = F.lit("")
    rows = docs.select(F.coalesce(lang, empty).alias("_lang"), F.coalesce(source, empty).alias("_source"), F.coalesce(text, empty).cast("binary").alias("_text"))
    parts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / total), three decimal digits at a time."""
    rest, out = counts + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        q, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + q
    return out + 1


def pack(place: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted places and their counts, compressed."""
    return zlib.compress(np.diff(place, prepend=0).astype("<u4").tobytes() + n.astype("<u8").tobytes(), 1)


def unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data) if data else b""
    k = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64)), np.frombuffer(raw, "<u8", k, 4 * k).astype(np.int64)


class Vector:
    """One group's shares in one slice: of the terms that it uses, and of any other."""

    def __init__(self, name: str, data: bytes | None, total: int):
        self.name, (self.place, n) = name, unpack(data)
        self.share, self.rest = shares(n, total), int(shares(np.zeros(1, np.int64), total)[0])


def divergences(a: Vector, b: Vector) -> tuple[int, int]:
    """Both directions over the terms that either uses, less what an unused term would add for each of them."""
    at = np.searchsorted(b.place, a.place)
    same = np.zeros(len(at), bool)
    inside = at < len(b.place)
    same[inside] = b.place[at[inside]] == a.place[inside]
    of_b = np.full(len(at), b.rest, np.int64)
    of_b[same] = b.share[at[same]]
    alone = np.ones(len(b.place), bool)
    alone[at[same]] = False
    p, q = np.concatenate([a.share, np.full(int(alone.sum()), a.rest, np.int64)]), np.concatenate([of_b, b.share[alone]])
    square = (p - q) ** 2
    unused = (a.rest - b.rest) ** 2
    return int((square // q).sum()) - len(p) * (unused // b.rest), int((square // p).sum()) - len(p) * (unused // a.rest)


def partner(block: Column, size: Column, turn: Column) -> Column:
    """Whom a block meets in a round of the tournament; ``size`` is the even number of places, one of which may be empty."""
    odd = size - 1
    other = F.pmod(turn - block, odd)
    return F.when(block == odd, F.pmod(turn * F.floor(size / 2), odd)).otherwise(F.when(other == block, odd).otherwise(other))


def meetings(cells: DataFrame, first: int, last: int, c: Config) -> DataFrame:
    """lang, source, other, value of the pairs that meet in rounds ``first`` to ``last``; round -1 is at home."""
    size = F.col("blocks") + F.col("blocks") % 2
    turns = cells.where(size - 2 >= max(first, 0)).withColumn("turn", F.explode(F.sequence(F.lit(max(first, 0)), F.least(F.lit(last), (size - 2).cast("int")))))
    turns = turns.withColumn("host", partner(F.col("block"), size, F.col("turn")).cast("int"))
    # of two that meet, the smaller travels in even rounds
    travels = (F.col("host") < F.col("blocks")) & ((F.col("block") < F.col("host")) == (F.col("turn") % 2 == 0))
    at_home = cells.withColumns({"turn": F.lit(-1), "host": F.col("block")})
    rows = at_home.unionByName(turns.where(travels)) if last >= 0 else at_home

    def meet(batches):
        key, home = None, []
        for b in batches:
            out = []
            for lang, part, host, turn, terms, groups in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                # without kept terms there is nothing to share out
                peers = [Vector(g["source"], g["data"], max(1, g["total"] + terms)) for g in groups]
                if turn < 0:
                    key, home = (lang, part, host), peers
                    pairs = [(x, y) for k, x in enumerate(home) for y in home[:k]] if first < 0 else []
                elif key != (lang, part, host):
                    raise ValueError("a travelling block found no host")
                else:
                    pairs = [(x, y) for x in home for y in peers]
                for x, y in pairs:
                    forth, back = divergences(x, y)
                    if part == 0:  # every kept term, as if neither used it
                        unused = (x.rest - y.rest) ** 2
                        forth, back = forth + terms * (unused // y.rest), back + terms * (unused // x.rest)
                    out += [(lang, x.name, y.name, forth), (lang, y.name, x.name, back)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col) for col in zip(*out, strict=True)], ["lang", "source", "other", "value"])

    dealt = rows.select("lang", "part", "host", "turn", "terms", "groups").repartition("lang", "part", "host").sortWithinPartitions("lang", "part", "host", "turn")
    return dealt.mapInArrow(meet, "lang string, source string, other string, value long").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def ranked_vectors(rows: DataFrame, c: Config) -> DataFrame:
    """One compressed vector of each group in each slice, with the terms it overuses most there."""

    def run(batches):
        for b in batches:
            data, tops = [], []
            for terms, total, all_n, entries in zip(*(b.column(k).to_pylist() for k in ("terms", "total", "lang_n", "entries")), strict=True):
                a = np.array([(e["place"], e["n"], e["lang_n"]) for e in entries or ()], np.int64).reshape(-1, 3)
                a = a[np.argsort(a[:, 0])]
                data.append(pack(a[:, 0], a[:, 1]) if len(a) else None)
                p, q = shares(a[:, 1], total + terms) if len(a) else a[:, 1], shares(a[:, 2], all_n + terms) if len(a) else a[:, 1]
                over = np.flatnonzero(p > q)
                value = (p[over] - q[over]) ** 2 // q[over]
                if len(over) > c.top:
                    most = value >= np.partition(value, -c.top)[-c.top]
                    over, value = over[most], value[most]
                first = np.lexsort((a[over, 0], -value))[: c.top]
                tops.append([{"place": int(k), "value": int(v)} for k, v in zip(a[over[first], 0], value[first], strict=True)])
            keep = [b.column(k) for k in ("lang", "source", "part", "block", "blocks", "terms", "total")]
            top = pa.array(tops, pa.list_(pa.struct([("place", pa.int64()), ("value", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*keep, pa.array(data, pa.binary()), top], ["lang", "source", "part", "block", "blocks", "terms", "total", "data", "tops"])

    return rows.mapInArrow(run, "lang string, source string, part int, block int, blocks int, terms long, total long, data binary, tops array<struct<place: long, value: long>>")


def audit(docs: DataFrame, c: Config = Config(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank of each group: 'pair' rows for its language's other sources, 'term' rows for its own words."""
    small_batches(session(docs))
    counts = materialize(term_counts(docs, c, text, lang, source), "term_counts")
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= c.least_docs).drop("docs")
    kept = materialize(kept, "kept_terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_n")).withColumn("parts", F.ceil(F.col("terms") / c.width).cast("int"))
    # languages of several slices: one for each ``width`` kept terms at most
    large = F.broadcast(sizes.where(F.col("parts") > 1).select("lang", "parts"))
    part = F.pmod(F.xxhash64("term"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = kept.join(large, "lang", "left").withColumn("part", part).drop("parts")
    placed = materialize(placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy("term")).cast("long") - 1), "placed_terms")
    entries = counts.drop("docs").join(placed, ["lang", "term"]).groupBy("lang", "source", "part").agg(F.collect_list(F.struct("place", "n", "lang_n")).alias("entries"), F.sum("n").alias("n"))
    entries = materialize(entries, "entries")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang")
    groups = counts.select("lang", "source").distinct().withColumns({"block": F.floor((F.row_number().over(order.orderBy("source")) - 1) / c.block).cast("int"), "blocks": F.ceil(F.count("*").over(order) / c.block).cast("int")})
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "lang_n", "total"])
    everywhere = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    vectors = materialize(ranked_vectors(everywhere.join(entries.drop("n"), ["lang", "source", "part"], "left"), c), "vectors")
    cells = vectors.groupBy("lang", "part", "block", "blocks", "terms").agg(F.collect_list(F.struct("source", "total", "data")).alias("groups"))
    cells = materialize(cells, "cells")
    rounds = cells.agg(F.max(F.col("blocks") + F.col("blocks") % 2 - 2)).first()[0]
    waves = [(k - 1 if k == 0 else k, k + c.wave - 1) for k in range(0, (rounds or 0) + 1, c.wave)]
    met = [meetings(cells, a, b, c) for a, b in waves]
    if len(met) > 1:
        met = [materialize(m, "meetings", 4) for m in met]
    pairs = met[0]
    for m in met[1:]:
        pairs = pairs.unionByName(m)
    if len(met) > 1:
        pairs = pairs.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    tops = vectors.select("lang", "source", "part", F.explode("tops").alias("t")).select("lang", "source", "part", "t.*").join(placed, ["lang", "part", "place"])
    words = tops.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(words.withColumn("rank", rank).where(F.col("rank") <= c.top))
