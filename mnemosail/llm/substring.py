"""Exact removal of repeated word windows, behind a count-min prefilter.

A window is a run of ``length`` words; windows whose word sequence starts anywhere else
are removed. Counting all windows exactly would shuffle every one of them.

1. Sketch. Every window contains a content-selected gram: the one with the
   smallest hash among its ``gram``-word runs. Neighbouring windows mostly
   share it, so there are some ten times fewer grams than windows, and a gram is
   at least as frequent as any window it was selected in. Each partition
   counts its grams in a count-min sketch of two rows; sketches are merged by
   addition, block by block, and what is sent out of a cell is one bit: counted
   twice or more. A few cells of each block, the largest of those over ``heavy``, are listed
   as heavy. The sketch has ``2 ** cells`` cells a row: some 16 for each gram that the bytes of text let expect, up to
   ``most_cells``, which bounds its broadcast (64 MB for 28).
2. Exact count. A second pass groups only windows whose gram both rows
   estimate as repeated. The estimate never falls short, so no repeated window
   is lost. Neighbouring windows travel together, dealt by their gram; those of heavy grams
   travel alone, dealt by themselves. Windows that repeat within a task are settled there and only
   announced, so a window reaches its group once per task at most, however frequent it is.
3. Removal. Repeated starts meet their document, its words are marked and cut.

If an input has many more grams than cells (from some 30 GB on), estimates saturate: the result
stays exact and the second pass groups more windows, in the end all of them, at ten bytes each. A sketch that
is not broadcast would not save that: to ask its blocks, the gram places (0.4 bytes per byte of text) and then the
texts once more would have to be shuffled.

Windows are compared by 96 bits of two independent hashes. Null texts have no words. Rows are
matched to their starts by id and text hash, so null ids and repeated rows
are safe; a repeated row makes its own windows repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from .common import gram_hashes, mix64, session, window_argmin, word_hashes, word_memo

ROW_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BLOCK = 20  # cells of one block: 2 ** BLOCK
CHECK_SEED = 0x6A09E667F3BCC909


def cell(grams: np.ndarray, row: int, cells: int) -> np.ndarray:
    return mix64(grams ^ ROW_SEEDS[row]) >> np.uint64(64 - cells)


def grams_of(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, for each window the place of its selected gram)."""
    if len(h) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = gram_hashes(h, gram)
    return g, window_argmin(g, length - gram + 1)


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(did, th): an id (of the text, if null) and a hash of the text, odd where the id is null."""
    i = doc_id.cast("long")
    return F.coalesce(i, F.xxhash64(text, F.lit("id"))), F.hash(text).bitwiseAND(-2).bitwiseOR(i.isNull().cast("int"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, text and the row's key (did, th)."""
    did, th = row_key(F.col(doc_id), F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), did.alias("did"), th.alias("th"))


def sketch(docs: DataFrame, length: int, gram: int, cells: int, heavy: int, text: str = "text", most: int = 2048) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per row of the merged count-min sketch a packed bitmap of cells counted twice or more, and the sorted heavy cells."""
    block = min(BLOCK, cells)
    blocks = 1 << (cells - block)

    def count(batches):
        memo, held, size = word_memo(), [], 0

        def out():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            for row in (0, 1):
                c, inv = np.unique(cell(g, row, cells), return_inverse=True)
                total = np.bincount(inv, weights=n)
                at = np.searchsorted(c >> np.uint64(block), np.arange(blocks + 1, dtype=np.uint64))
                low = (c & np.uint64((1 << block) - 1)).astype("<u4")
                some = np.flatnonzero(np.diff(at))
                ones, more = [], []
                for k in some:
                    x, t = low[at[k] : at[k + 1]], total[at[k] : at[k + 1]]
                    ones.append(x[t == 1].tobytes())
                    more.append(np.stack([x[t > 1], t[t > 1].astype("<u4")]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(some * 2 + row, pa.int32()), pa.array(ones, pa.binary()), pa.array(more, pa.binary())], ["block", "ones", "more"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                h = word_hashes((t or b"").split(), memo)
                memo.trim()
                g, at = grams_of(h, length, gram)
                if len(at):
                    held.append(g[np.unique(at)])
                    size += len(held[-1])
                    if size > 2_000_000:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    def merge(batches):
        at, total = None, np.zeros(1 << block, np.int64)

        def out():
            top = np.flatnonzero(total > heavy)
            top = np.sort(top[np.argsort(-total[top], kind="stable")[:most]])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total > 1).tobytes()], pa.binary()), pa.array([top.astype("<u4").tobytes()], pa.binary())], ["block", "bits", "heavy"])

        for b in batches:
            for k, ones, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != at:
                    if at is not None:
                        yield out()
                        total[:] = 0
                    at = k
                total[np.frombuffer(ones, "<u4")] += 1
                x, n = np.frombuffer(more, "<u4").reshape(2, -1)
                total[x] += n
        if at is not None:
            yield out()

    parts = docs.select(text).mapInArrow(count, "block int, ones binary, more binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary, heavy binary").collect()  # of fixed size
    maps = [np.zeros((1 << cells) // 8, np.uint8) for _ in ROW_SEEDS]
    tops: list[list[np.ndarray]] = [[], []]
    step = (1 << block) // 8
    for k, bits, top in merged:
        maps[k % 2][k // 2 * step : (k // 2 + 1) * step] = np.frombuffer(bits, np.uint8)
        tops[k % 2].append(np.frombuffer(top, "<u4").astype(np.uint64) + (np.uint64(k // 2) << np.uint64(block)))
    return maps, [np.sort(np.concatenate(t)) if t else np.empty(0, np.uint64) for t in tops]


def estimated_repeated(grams: np.ndarray, maps: list[np.ndarray], cells: int) -> np.ndarray:
    ok = np.ones(len(grams), bool)
    for row, bits in enumerate(maps):
        c = cell(grams, row, cells)
        ok &= (bits[c >> np.uint64(3)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return ok


def estimated_heavy(grams: np.ndarray, tops: list[np.ndarray], cells: int) -> np.ndarray:
    ok = np.ones(len(grams), bool)
    for row, top in enumerate(tops):
        if not len(top):
            return np.zeros(len(grams), bool)
        c = cell(grams, row, cells)
        ok &= top[np.minimum(np.searchsorted(top, c), len(top) - 1)] == c
    return ok


MARK = np.dtype([("h", "<u8"), ("c", "<u4")])


def blobs(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Runs ``data[edges[k]:edges[k + 1]]`` as binary values."""
    raw = np.ascontiguousarray(data)
    offsets = (edges * raw.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def repeated_windows(rows: DataFrame, shared, length: int, gram: int, cells: int, flush: int) -> DataFrame:
    """(did, th, starts): starts of repeated windows, packed, from ``keyed`` rows; a row of ``rows`` may have several."""
    # k: what deals the row; marks: hashes of consecutive windows from pos on, or of announced ones (no did); starts: settled ones
    schema = "k long, did long, th int, pos int, marks binary, starts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def flagged(batches):
        (maps, tops), memo = shared.value, word_memo(200_000)
        docs, marks, keys, owner, place, size = [], [], [], [], [], 0

        def batch(k, did, th, pos, marks, starts):
            n = len(k)
            cols = [pa.array(k.view(np.int64)), did, th, pos, marks, starts]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        def out():
            m, k, o, p = map(np.concatenate, (marks, keys, owner, place))
            order = np.lexsort((m["c"], m["h"]))
            s = m[order]
            new = np.concatenate([[True], (s["h"][1:] != s["h"][:-1]) | (s["c"][1:] != s["c"][:-1])])
            group = np.cumsum(new) - 1
            n = np.bincount(group)
            many = np.empty(len(m), bool)
            many[order] = n[group] > 1
            did, th = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int32)
            # unsettled windows: runs of one document, one gram and consecutive places
            at = np.flatnonzero(~many)
            if len(at):
                cut = (np.diff(o[at]) != 0) | (np.diff(p[at]) != 1) | (k[at][1:] != k[at][:-1])
                edges = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(at)]])
                first = at[edges[:-1]]
                yield batch(k[first], did[o[first]], th[o[first]], p[first].astype(np.int32), blobs(m[at], edges), None)
            if many.any():
                said = order[np.flatnonzero(new)[n > 1]]  # one announcement of each window that repeats here
                said = said[np.argsort(k[said], kind="stable")]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(k[said].view(np.int64)) != 0) + 1, [len(said)]])
                yield batch(k[said[edges[:-1]]], None, None, None, blobs(m[said], edges), None)
                at = np.flatnonzero(many)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(o[at]) != 0) + 1, [len(at)]])
                who = o[at[edges[:-1]]]
                yield batch(mix64(did[who].view(np.uint64)), did[who], th[who], None, None, blobs(p[at].astype("<u4"), edges))

        for b in batches:
            for t, did, th in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = word_hashes((t or b"").split(), memo)
                memo.trim()
                g, at = grams_of(h, length, gram)
                if not len(at):
                    continue
                picked, inv = np.unique(at, return_inverse=True)
                p = np.flatnonzero(estimated_repeated(g[picked], maps, cells)[inv])
                if not len(p):
                    continue
                m = np.empty(len(p), MARK)
                m["h"], m["c"] = gram_hashes(h, length)[p], gram_hashes(h, length, CHECK_SEED)[p] >> np.uint64(32)
                k = np.where(estimated_heavy(g[picked], tops, cells)[inv][p], m["h"], g[at[p]])
                marks.append(m), keys.append(k), owner.append(np.full(len(p), len(docs), np.int32)), place.append(p.astype(np.int32))
                docs.append((did, th))
                size += len(p)
                if size > flush:
                    yield from out()
                    docs, marks, keys, owner, place, size = [], [], [], [], [], 0
        if docs:
            yield from out()

    def counted(batches):
        held: list[tuple] = []
        size = 0

        def out(part):
            data = [np.frombuffer(r[4], MARK) for r in part]
            n = np.fromiter(map(len, data), np.int64, len(data))
            m = np.concatenate(data)
            said = np.fromiter((r[1] is None for r in part), bool, len(part))
            order = np.lexsort((m["c"], m["h"]))
            s = m[order]
            new = np.concatenate([[True], (s["h"][1:] != s["h"][:-1]) | (s["c"][1:] != s["c"][:-1])])
            group = np.cumsum(new) - 1
            weight = np.bincount(group, weights=np.where(np.repeat(said, n)[order], 2, 1))
            hit = np.empty(len(m), bool)
            hit[order] = weight[group] > 1
            edge = np.concatenate([[0], np.cumsum(n)])
            found = [(r[1], r[2], (np.flatnonzero(hit[edge[k] : edge[k + 1]]) + r[3]).astype("<u4").tobytes()) for k, r in enumerate(part) if not said[k] and hit[edge[k] : edge[k + 1]].any()]
            if found:
                yield result(*zip(*found, strict=True))

        def result(did, th, starts):
            return pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(th, pa.int32()), pa.array(starts, pa.binary())], ["did", "th", "starts"])

        for b in batches:
            rows_ = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            settled = [(r[1], r[2], r[5]) for r in rows_ if r[5] is not None]
            if settled:
                yield result(*zip(*settled, strict=True))
            for r in rows_:
                if r[4] is not None:
                    if size > 200_000 and r[0] != held[-1][0]:
                        yield from out(held)
                        held, size = [], 0
                    held.append(r)
                    size += len(r[4]) // MARK.itemsize
        if held:
            yield from out(held)

    found = rows.select("text", "did", "th").mapInArrow(flagged, schema)
    return found.repartition("k").sortWithinPartitions("k").mapInArrow(counted, "did long, th int, starts binary")


def cut(rows: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """id, words, removed, kept (text of the words left) of each of the ``keyed`` rows."""
    schema = "id long, n_words long, n_removed long, kept binary"
    docs = rows.select("did", "th", F.lit(1).alias("kind"), "id", "text", F.lit(None).cast("binary").alias("starts"))
    marks = starts.select("did", "th", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "starts")
    met = docs.unionByName(marks).repartition("did", "th").sortWithinPartitions("did", "th", "kind")

    def run(batches):
        key, held = None, []
        for b in batches:
            ids, words, removed, kept = [], [], [], []
            texts = b.column(4).cast(pa.binary()).to_pylist()
            for did, th, kind, i, t, s in zip(*(b.column(k).to_pylist() for k in range(4)), texts, b.column(5).to_pylist(), strict=True):
                if (did, th) != key:
                    key, held = (did, th), []
                if kind == 0:
                    held.append(s)
                    continue
                w = (t or b"").split()
                left, n = w, len(w)
                if held:
                    at = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    left = [x for x, c in zip(w, np.cumsum(edge[:n]).tolist(), strict=True) if not c]
                ids.append(i), words.append(n), removed.append(n - len(left)), kept.append(b" ".join(left))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return met.mapInArrow(run, schema)


def cells_for(docs: DataFrame, text: str, most: int, least: int = 16) -> int:
    """log2 of the cells of a sketch row: about 16 a gram, as one gram stands for some 60 bytes of text."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(1, size / 60 * 16))), least, most))


def remove_repeats(docs: DataFrame, length: int = 35, gram: int = 16, cells: int | None = None, most_cells: int = 28, heavy: int = 2_000, flush: int = 300_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 bytes of the words left, one space between) of every row."""
    spark = session(docs)
    small_batches(spark)
    rows = keyed(docs, doc_id, text)
    cells = cells or cells_for(docs, text, most_cells)
    shared = spark.sparkContext.broadcast(sketch(docs, length, gram, cells, heavy, text))
    return cut(rows, repeated_windows(rows, shared, length, gram, cells, flush), length).withColumnRenamed("id", "doc_id")


def digest(df: DataFrame) -> DataFrame:
    """Replaces ``kept`` by its SHA-256."""
    return df.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
