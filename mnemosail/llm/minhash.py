"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

1. Features. Each text becomes the set of hashes of its distinct word shingles. ``samples``
   MinHash values are taken; the first ``bands * rows`` of them form band keys,
   and all are folded into an odd sketch, a bitmap whose bits are the parities
   of the samples that fall on them. The set itself is folded into a second one. Texts with equal sets are one node from
   here on, so a group of copies, however large, costs one row.
2. Candidates. Two sets are candidates if they share a band and the XOR of their
   sketches has few bits: its population count estimates their similarity, and
   the bound leaves more than five standard deviations below the threshold.
   The XOR of the sets' own odd sketches never has more bits than the sets
   differ in, which bounds their similarity from above without any chance.
3. Confirmation. Links are confirmed on the full sets (64-bit hashes of all shingles).

A bucket is never expanded into all pairs. First every node is confirmed
against the best leader of its buckets; then, in rounds, the nodes of a bucket
that are not in its largest component are compared with growing sets of
leaders from other components (``leaders``, then all), a few best candidates
for each node and component first and in the last round all that remain.
Components shrink the work between rounds; the last round leaves no candidate
pair of different components untested, so components are those of all links.

With 20 bands of 3, a pair at similarity 0.8 misses every band with
probability 6e-7, and one with more shared shingles more rarely; nothing catches such a pair.
The last rounds compare the nodes of a bucket that have no link yet with all others of it by their sketches, which is
quadratic in families of texts just below the threshold. Buckets of more than ``small`` nodes are compared as arrays, by tiles
of ``tile`` nodes, at some hundredths of a microsecond a pair; what the sketches stop never becomes a row.

Empty and null texts have the empty set and link with nothing. Rows with a null
id belong to their text's group (its id, if any row has one). Rows that repeat
an id are judged each by its own text; where that id is the smallest of two groups, these are one
component. Ties fall to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import small_batches
from .common import discard, gram_hashes, materialize, mix64, session, word_hashes, word_memo, written
from .graph import components


@dataclass(frozen=True)
class Config:
    words: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 3
    samples: int = 120
    bits: int = 512
    parity: int = 1024
    far: int = 86  # XOR bits of the sketches above which a pair is no candidate
    leaders: int = 16
    tries: int = 4
    small: int = 32
    tile: int = 1024


def shingle_set(text: bytes | None, n: int, memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z are lower-cased."""
    words = (text or b"").lower().split()  # bytes.split: exactly \\x20 and \\x09-\\x0D
    h = word_hashes(words, memo)
    memo.trim()
    if not len(h):
        return h
    return np.unique(gram_hashes(h, n) if len(h) >= n else gram_hashes(h, len(h), 0xA5A5A5A5A5A5A5A5 + 2 * len(h)))


def constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12345)
    return rng.integers(0, 2**31, k, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, np.uint32)


def minhash(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set: functions of the hashes' upper 32 bits, which numpy computes several at a time."""
    high = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mul), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 2048):  # bounded memory for very long texts
        z = high[None, at : at + 2048] * mul[:, None]
        z += add[:, None]
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, z.min(axis=1))
    return out.astype(np.uint64)


def features(docs: DataFrame, c: Config, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n, s1, s2 (128-bit hash of the set), bands, sketch, own (the set's odd sketch) of each row."""

    def run(batches):
        memo, (mul, add) = word_memo(), constants(c.samples)
        place = np.arange(c.samples, dtype=np.uint64)
        for b in batches:
            n, s1, s2, bands, sketch, own = [], [], [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(t, c.words, memo)
                n.append(len(s))
                if not len(s):
                    s1.append(0), s2.append(0), bands.append([]), sketch.append([]), own.append([])
                    continue
                i = np.arange(1, len(s) + 1, dtype=np.uint64)
                s1.append(int(mix64(s * (2 * i + np.uint64(1))).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix64(s ^ (i * np.uint64(0x9E3779B97F4A7C15))).sum(dtype=np.uint64).view(np.int64)))
                m = minhash(s, mul, add)
                key = m[: c.bands * c.rows].reshape(c.bands, c.rows)
                z = mix64(np.arange(1, c.bands + 1, dtype=np.uint64))
                for j in range(c.rows):
                    z = mix64(z * np.uint64(0x9E3779B97F4A7C15) + key[:, j])
                bands.append(z.view(np.int64))
                bit = mix64(m + place * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(c.bits)
                odd = np.bincount(bit.astype(np.int64), minlength=c.bits) & 1
                sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                odd = np.bincount((s >> np.uint64(7) & np.uint64(c.parity - 1)).astype(np.int64), minlength=c.parity) & 1
                own.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, longs), pa.array(sketch, longs), pa.array(own, longs)], ["doc_id", "text_hash", "n", "s1", "s2", "bands", "sketch", "own"])

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, s1 long, s2 long, bands array<long>, sketch array<long>, own array<long>")


def full_sets(texts: DataFrame, c: Config) -> DataFrame:
    """(node, lead, members): sets as sorted 64-bit hashes; from (node, lead, _text)."""

    def run(batches):
        memo = word_memo()
        for b in batches:
            packed = [shingle_set(t, c.words, memo).astype("<u8").tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["node", "lead", "members"])

    return texts.select("node", "lead", "_text").mapInArrow(run, "node long, lead long, members binary")


def confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """(x, y, linked) of rows (x, y, mx, my) with both packed sets."""

    def run(batches):
        for b in batches:
            ok = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["x", "y", "linked"])

    return pairs.select("x", "y", "mx", "my").mapInArrow(run, "x long, y long, linked boolean")


def xor_bits(a: Column, b: Column, words: int) -> Column:
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, words)), F.bit_count(a[0].bitwiseXOR(b[0])))


def may_link(c: Config, x: str = "x", y: str = "y") -> Column:
    """Candidate test on the columns nx, sx, ox and ny, sy, oy: both odd sketches allow a link."""
    least = xor_bits(F.col(f"o{x}"), F.col(f"o{y}"), c.parity // 64)  # of the sets' difference
    total = F.col(f"n{x}") + F.col(f"n{y}")
    return (xor_bits(F.col(f"s{x}"), F.col(f"s{y}"), c.bits // 64) <= c.far) & (100 * (total - least) >= c.percent * (total + least))


def as_side(nodes: DataFrame, side: str, name: str) -> DataFrame:
    return nodes.select(*as_side_columns(side, name))


def as_side_columns(side: str, name: str | None = None) -> list[Column]:
    return [F.col("node").alias(name or side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"), F.col("own").alias(f"o{side}")]


def near_duplicates(docs: DataFrame, c: Config = Config(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, kept of every row of ``docs``."""
    spark = session(docs)
    small_batches(spark)
    mark = written()
    feats = materialize(features(docs, c, doc_id, text), "features")
    # equal sets have equal bands and sketches: any row's stand for all
    nodes = feats.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("own").alias("own"), F.first("n").alias("n"), F.min_by("text_hash", "doc_id").alias("text_hash"))
    nodes = materialize(nodes, "nodes")
    rows = nodes.select(F.explode("bands").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("lead")).where("m > 1")
    # written before it is joined: a join with an aggregate over the same key could not split a large bucket
    shared = materialize(shared, "shared", 4)
    buckets = materialize(rows.join(shared, "key"), "buckets")
    sketches = nodes.select("node", "n", "sketch", "own")

    # round 0: each node's best leader
    pairs = buckets.where("node <> lead").select("node", "lead").distinct()
    pairs = pairs.join(as_side(sketches, "x", "node"), "node").join(as_side(sketches, "y", "lead"), "lead").where(may_link(c))
    pairs = pairs.withColumn("bits", xor_bits(F.col("sx"), F.col("sy"), c.bits // 64))
    best = materialize(pairs.groupBy("node").agg(F.min_by("lead", F.struct("bits", "lead")).alias("lead")), "best", 4)
    involved = buckets.select("node").distinct().join(nodes.select("node", "text_hash"), "node").join(best, "node", "left")
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    # both sides grow with the corpus: always a shuffle, whatever their size today
    texts = texts.join(involved.hint("merge"), ["node", "text_hash"])
    sets = materialize(full_sets(texts, c).dropDuplicates(["node", "members"]), "sets")
    leads = sets.where("lead is not null").select(F.col("lead").alias("node")).distinct()
    lead_sets = materialize(sets.join(leads, "node", "left_semi"), "leads")
    first = sets.where("lead is not null").select(F.col("node").alias("x"), F.col("lead").alias("y"), F.col("members").alias("mx")).join(lead_sets.select(F.col("node").alias("y"), F.col("members").alias("my")), "y")
    tested = materialize(confirm(first, c.percent), "tested", 4)
    labels = materialize(components(tested.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))), "labels", 4)

    for leaders, tries in ((c.leaders, c.tries), (None, c.tries), (None, None)):
        pairs = candidates(buckets, labels, sketches, tested, leaders, tries, c)
        pairs = materialize(pairs, "pairs", 4, F.count("*"))
        if not pairs.table_seen:
            continue
        held = sets.select("node", "members").join(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct(), "node", "left_semi")
        both = pairs.join(held.select(F.col("node").alias("x"), F.col("members").alias("mx")), "x").join(held.select(F.col("node").alias("y"), F.col("members").alias("my")), "y")
        now = materialize(confirm(both, c.percent), "tested", 4, F.count_if("linked"))
        links = now.where("linked").select("x", "y")
        tested = tested.unionByName(now)
        if not now.table_seen:
            continue
        lx, ly = (labels.select(F.col("node").alias(v), F.col("root").alias(f"c{v}")) for v in "xy")
        ends = links.join(lx, "x", "left").join(ly, "y", "left").select(F.coalesce("cx", "x").alias("a"), F.coalesce("cy", "y").alias("b"))
        merged = components(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
        alone = merged.select(F.col("root").alias("node")).join(labels, "node", "left_anti").withColumn("root", F.col("node"))
        labels = materialize(labels.unionByName(alone).join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels", 4)

    discard(spark, mark, feats, nodes, labels)
    group = nodes.select("s1", "s2", "node").join(labels, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component"))
    out = feats.select("doc_id", "text_hash", "n", "s1", "s2").join(group, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def without_near_duplicates(docs: DataFrame, c: Config = Config(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, in all their columns, with one row of each group.

    Rows with a null id come after all others of their group, and rows that
    repeat an id and a text are one.
    """
    late = F.shiftrightunsigned(F.xxhash64(text, F.lit("late")), 2) + F.lit(1 << 62)
    rows = docs.withColumns({"_key": F.coalesce(F.col(doc_id).cast("long"), late), "_hash": F.xxhash64(text)})
    kept = near_duplicates(rows, c, "_key", text).where("kept").select(F.col("doc_id").alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    return rows.join(kept, ["_key", "_hash"], "left_semi").dropDuplicates(["_key", "_hash"]).select(*docs.columns)


def joined(rows: DataFrame, others: DataFrame, c: Config) -> DataFrame:
    """(x, y, cx, cy, bits) of candidate pairs of ``rows``, outside their buckets' largest components, with ``others``."""
    x = rows.where("c <> big").select("key", F.col("c").alias("cx"), *as_side_columns("x"))
    y = others.select("key", F.col("c").alias("cy"), *as_side_columns("y"))
    bits = xor_bits(F.col("sx"), F.col("sy"), c.bits // 64)
    return x.join(y, "key").where((F.col("cx") != F.col("cy")) & may_link(c)).select("x", "y", "cx", "cy", bits.alias("bits"))


def tiled(rows: DataFrame, c: Config) -> DataFrame:
    """The same pairs of ``rows`` as ``joined`` has, either way round. A bucket is cut into parts; each pair of parts is one task's tile."""
    parts = F.ceil(F.col("m") / c.tile).cast("int")
    met = rows.withColumnRenamed("own", "parity").withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = met.select("key", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own", "node", "c", (F.col("c") != F.col("big")).alias("out"), "n", "sketch", "parity")
    columns = ["x", "y", "cx", "cy", "bits"]

    def run(key, table):
        _, i, j = (k.as_py() for k in key)
        own, node, group, out, n = (table.column(k).to_numpy() for k in ("own", "node", "c", "out", "n"))
        sketch, parity = (table.column(k).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1) for k in ("sketch", "parity"))
        u, v = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        # all pairs with an end outside the largest component
        sides = [(u[out[u]], u)] if i == j else [(u[out[u]], v), (u[~out[u]], v[out[v]])]
        found = [close_sketches(xs[k : k + 128], ys, group, n, sketch, parity, c) for xs, ys in sides for k in range(0, len(xs), 128)]
        x, y, bits = (np.concatenate(f) for f in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        return pa.table([node[x], node[y], group[x], group[y], bits.astype(np.int32)], names=columns)

    spread = int(session(rows).conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(spread, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(run, "x long, y long, cx long, cy long, bits int")


def close_sketches(xs, ys, group, n, sketch, parity, c: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, bits) of rows xs and ys of different groups whose sketches allow a link, as ``may_link`` has it."""
    bits = np.zeros((len(xs), len(ys)), np.uint16)
    for w in range(sketch.shape[1]):
        bits += np.bitwise_count(sketch[xs, w, None] ^ sketch[ys, w])
    a, b = np.nonzero((bits <= c.far) & (group[xs, None] != group[ys]))
    bits, x, y = bits[a, b], xs[a], ys[b]
    least = np.zeros(len(x), np.int64)
    for w in range(parity.shape[1]):
        least += np.bitwise_count(parity[x, w] ^ parity[y, w])
    total = n[x] + n[y]
    may = 100 * (total - least) >= c.percent * (total + least)
    return x[may], y[may], bits[may]


def candidates(buckets: DataFrame, labels: DataFrame, sketches: DataFrame, tested: DataFrame, leaders: int | None, tries: int | None, c: Config) -> DataFrame:
    """Untested pairs (x, y) of one bucket and different components, x outside the bucket's largest."""
    rows = buckets.select("key", "node", "m").join(labels, "node", "left").select("key", "node", "m", F.coalesce("root", "node").alias("c"))
    parts = rows.groupBy("key", "c").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg(F.max_by("c", F.col("size")).alias("big"), F.count("*").alias("parts")).where("parts > 1").select("key", "big")
    rows = rows.join(materialize(mixed, "mixed", 4), "key").join(sketches, "node")
    if leaders is None:
        large = F.col("m") > c.small
        found = joined(rows.where(~large), rows.where(~large), c).unionByName(tiled(rows.where(large), c))
    else:
        found = joined(rows, rows.where(F.pmod(F.xxhash64("node", "key"), F.col("m")) < leaders), c)
    found = found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(F.col("x") < F.col("y"), F.col("cx")).otherwise(F.col("cy")).alias("cx"), F.when(F.col("x") < F.col("y"), F.col("cy")).otherwise(F.col("cx")).alias("cy"), "bits").distinct()
    done = tested.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    found = found.join(done, ["x", "y"], "left_anti")
    if tries is not None:
        best = Window.partitionBy("x", "cy").orderBy("bits", "y")
        found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= tries)
    return found.select("x", "y")
