"""Removal of repeated passages by sparse suffix arrays.

Suffixes are kept only where a content-selected minimiser starts: in every
window of ``length`` words the ``gram``-word run with the smallest hash. Equal
windows select equal places, so two copies of a passage keep suffixes at the
same places of it, about one in ``(length - gram) / 2`` words.

1. Suffixes whose first ``gram`` words occur once in the corpus cannot match
   and are dropped; within a task, repeated ones are settled and announced once.
2. The others get their context (``length - gram`` words to either side, as 32-bit word hashes) and are
   dealt by their first words, which makes each task a part of the suffix array. Of prefixes with more
   than ``group`` suffixes the windows that chose a suffix travel instead, by the 64-bit hash of all their
   words, so equal ones meet wherever they are; a task settles those that repeat within it, and each of its
   windows is sent once.
3. Suffixes are sorted by what follows their prefix, and again by what precedes it, and compared with their
   neighbours in either order. Matches extend to the right as far as neighbours share words, and to the
   left likewise: a window of ``length`` words is the same in two suffixes where both extensions reach its ends. No window
   is left out, however many others share parts of it.

Only a later occurrence is ever marked, so the first copy of every passage
stays. Longer passages are covered piece by piece, since each of their windows has a
suffix. Order in the corpus is by id, then place. Words are ``bytes.split`` words.

Null and empty texts and texts shorter than ``length`` words have no suffixes. Null ids stay null, and are
ordered by a hash of their text; repeated rows of one id and text are one document and keep
the same words. Ties of everything are equal and lose nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import small_batches
from .common import gram_hashes, materialize, merge_spans, mix64, session, window_argmin, word_hashes, word_memo
from .substring import keyed, row_key

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def anchors(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the suffixes that a text keeps."""
    if len(h) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = gram_hashes(h, gram)
    at = np.unique(window_argmin(g, length - gram + 1))
    return at, g[at]


def repeated_anchors(rows: DataFrame, length: int, gram: int, flush: int = 1_000_000) -> DataFrame:
    """(key, did, th, pos) of the suffixes whose first words occur more than once."""
    schema = "key long, weight int, did long, th int, pos int"

    def run(batches):
        memo, keys, did, th, pos, size = word_memo(), [], [], [], [], 0

        def out():
            k, d, t, p = map(np.concatenate, (keys, did, th, pos))
            order = np.argsort(k, kind="stable")
            k, d, t, p = k[order], d[order], t[order], p[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            n = np.diff(np.concatenate([first, [len(k)]]))
            many = np.repeat(n > 1, n)
            said = k[first[n > 1]]  # one announcement of each key that repeats here
            weight = np.concatenate([np.where(many, 0, 1), np.full(len(said), 2)]).astype(np.int32)
            void = lambda x, kind: pa.array(np.concatenate([x, np.zeros(len(said), x.dtype)]), kind, mask=np.arange(len(x) + len(said)) >= len(x))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k, said]).view(np.int64)), pa.array(weight), void(d, pa.int64()), void(t, pa.int32()), void(p, pa.int32())], ["key", "weight", "did", "th", "pos"])

        for b in batches:
            for x, i, j in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = word_hashes((x or b"").split(), memo)
                memo.trim()
                at, g = anchors(h, length, gram)
                if len(at):
                    keys.append(g), did.append(np.full(len(at), i)), th.append(np.full(len(at), j, np.int32)), pos.append(at.astype(np.int32))
                    size += len(at)
                    if size > flush:
                        yield out()
                        keys, did, th, pos, size = [], [], [], [], 0
        if size:
            yield out()

    found = rows.select("text", "did", "th").mapInArrow(run, schema)
    # settled rows need no count: they go round the window, as the others' keys are spread evenly
    settled = F.col("weight") == 0
    spread = F.when(settled, F.xxhash64("did", "pos")).otherwise(F.col("key"))
    total = F.sum("weight").over(Window.partitionBy("_k", settled))
    counted = found.withColumn("_k", spread).withColumn("total", total)
    return counted.where(F.col("did").isNotNull() & (settled | (F.col("total") > 1))).select("key", "did", "th", "pos")


def with_breadth(found: DataFrame, group: int) -> DataFrame:
    """(key, did, th, pos, wide): wide suffixes are those of prefixes with more than ``group`` of them."""
    frequent = materialize(found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key", F.lit(True).alias("wide")), "prefixes", 4)
    return found.join(frequent, "key", "left").select("key", "did", "th", "pos", F.coalesce("wide", F.lit(False)).alias("wide"))


#: What ``with_context`` hands to ``compare``; a settled span has a ``stop`` and a ``source``, a suffix has contexts.
SUFFIX, WINDOW, SETTLED = range(3)
MARKS = "key long, kind int, did long, th int, pos int, stop int, source long, right binary, left binary"
MARK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
#: Source without an id; the id of this value, if there is one, reads as null too.
NO_ID = (1 << 63) - 1
MARK_NAMES = [c.split()[0] for c in MARKS.split(", ")]


def named(did: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Ids as sources; rows without one (``row_key`` marks them) count as the largest, so that a least source has an id if any has."""
    return np.where(th & 1 == 1, NO_ID, did)


def settle(key: np.ndarray, did: np.ndarray, th: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Marks of a task's windows, given in the order of the corpus: the first of each key is a window, later ones are settled spans."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.empty(len(key), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    lead = first == np.arange(len(key))
    w, k = np.flatnonzero(lead), np.flatnonzero(~lead)
    source = named(did, th)[first[k]]
    cut = np.flatnonzero(np.concatenate([[True], (did[k][1:] != did[k][:-1]) | (th[k][1:] != th[k][:-1]) | (start[k][1:] != start[k][:-1] + 1) | (source[1:] != source[:-1])])) if len(k) else k
    end = np.append(cut[1:], len(k))[: len(cut)] - 1
    a = k[cut]
    # settled spans need no group: they are dealt by their document, as those of one passage have one key
    many = [np.concatenate([key[w], mix64(did[a].view(np.uint64))]).view(np.int64), *(np.concatenate([x[w], x[a]]) for x in (did, th, start))]
    void = np.arange(len(many[0])) < len(w)
    tail = lambda x: np.concatenate([np.zeros(len(w), x.dtype), x])
    kind = np.where(void, WINDOW, SETTLED).astype(np.int32)
    cols = [many[0], kind, many[1], many[2], many[3], pa.array(tail((start[k[end]] + length).astype(np.int32)), mask=void), pa.array(tail(source[cut]), mask=void)]
    none = pa.nulls(len(void), pa.binary())
    return pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, MARK_TYPES)), none, none], MARK_NAMES)


def with_context(rows: DataFrame, marks: DataFrame, length: int, gram: int, flush: int = 1_000_000) -> DataFrame:
    """Marks with ``right`` and ``left`` (reversed), the contexts as big-endian 32-bit word hashes; for wide ones, the windows that chose them."""
    side = length - gram
    empty = {"key": "long", "wide": "boolean", "pos": "int", "text": "string"}
    void = lambda c: F.lit(None).cast(empty[c]).alias(c)
    docs = rows.select("did", "th", F.lit(1).alias("kind"), void("key"), void("wide"), void("pos"), "text")
    asks = marks.select("did", "th", F.lit(0).alias("kind"), "key", "wide", "pos", void("text"))
    met = docs.unionByName(asks).repartition("did", "th").sortWithinPartitions("did", "th", "kind")

    def run(batches):
        memo, at, held, windows, size = word_memo(), None, [], [], 0

        def settled():
            whole = settle(*map(np.concatenate, zip(*windows, strict=True)), length)
            for k in range(0, whole.num_rows, 50_000):
                yield whole.slice(k, 50_000)

        for b in batches:
            out: list[list] = [[] for _ in MARK_TYPES]
            texts = b.column(6).cast(pa.binary()).to_pylist()
            for did, th, kind, key, wide, pos, t in zip(*(b.column(k).to_pylist() for k in range(6)), texts, strict=True):
                if (did, th) != at:
                    at, held = (did, th), []
                if kind == 0:
                    held.append((key, wide, pos))
                elif held:
                    full = word_hashes((t or b"").split(), memo)
                    h = (full >> np.uint64(32)).astype(">u4")
                    memo.trim()
                    back = h[::-1]
                    n = len(h)
                    for k, w, p in held:
                        if w:
                            continue
                        a = p + gram
                        row = (k, SUFFIX, did, th, p, None, None, h[a : a + side].tobytes(), back[n - p : n - p + side].tobytes())
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
                    chosen = [p for _, w, p in held if w]
                    if chosen:
                        start = np.flatnonzero(np.isin(window_argmin(gram_hashes(full, gram), side + 1), chosen))
                        windows.append((gram_hashes(full, length)[start], np.full(len(start), did), np.full(len(start), th, np.int32), start.astype(np.int32)))
                        size += len(start)
                    held = []  # a repeated row asks once
                    if size > flush:
                        yield from settled()
                        windows, size = [], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, MARK_TYPES, strict=True)], MARK_NAMES)
        if size:
            yield from settled()

    return met.mapInArrow(run, MARKS)


def matrix(rows: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as rows of words, zero-padded, and their lengths."""
    size = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    data = np.frombuffer(b"".join(r.ljust(4 * side, b"\0") for r in rows), ">u4").reshape(len(rows), side)
    return data, size


def sorted_runs(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a suffix array over the contexts of each group, and the words that each entry shares with the one before it (-1 at a group's first)."""
    # sizes part texts that end from texts that go on with words of hash 0, as the padding
    text = np.concatenate([group.astype(">u4")[:, None], rows, size.astype(">u4")[:, None]], axis=1)
    order = np.argsort(np.ascontiguousarray(text).view(f"S{4 * text.shape[1]}")[:, 0], kind="stable")
    g, w, n = group[order], rows[order], size[order]
    differ = np.concatenate([w[1:] != w[:-1], np.ones((max(0, len(w) - 1), 1), bool)], axis=1)
    shared = np.minimum(differ.argmax(axis=1), np.minimum(n[1:], n[:-1]))
    return order, np.concatenate([[-1], np.where(g[1:] == g[:-1], shared, -1)])


def earliest_equal(group: np.ndarray, R: np.ndarray, nr: np.ndarray, L: np.ndarray, nl: np.ndarray) -> np.ndarray:
    """For each row, given in the order of the corpus, and each l: the first row of its group with the same l words
    on the left and ``side - l`` on the right; -1 where the text has fewer.

    Neighbours in the sorted order that share k words are one run of the length-k contexts; rows of one
    run to the right and one run to the left have the same window.
    """
    n, side = R.shape
    by_right, share_right = sorted_runs(group, R, nr)
    by_left, share_left = sorted_runs(group, L, nl)
    run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
    out = np.full((n, side + 1), -1, np.int64)
    for l in range(side + 1):
        at = np.flatnonzero((nl >= l) & (nr >= side - l))
        if not len(at):
            continue
        run_right[by_right] = np.cumsum(share_right < side - l)
        run_left[by_left] = np.cumsum(share_left < l)
        w = run_right[at] * (n + 1) + run_left[at]
        order = np.argsort(w, kind="stable")
        new = np.concatenate([[True], w[order][1:] != w[order][:-1]])
        out[at[order], l] = at[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
    return out


def compare(groups: DataFrame, length: int, gram: int, chunk: int = 20_000) -> DataFrame:
    """(did, th, start, stop, source): spans of texts that an earlier place of the corpus (document ``source``) holds too."""
    side = length - gram
    schema = "did long, th int, start int, stop int, source long"
    dealt = groups.repartition("key").sortWithinPartitions("kind", "key", "did", "th", "pos")

    def batch(*columns) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["did", "th", "start", "stop", "source"])

    def windows(rows: list[tuple]) -> pa.RecordBatch | None:
        out, key, lead = [], None, None
        for k, kind, did, th, pos, stop, source, _, _ in rows:
            if kind == SETTLED:
                out.append((did, th, pos, stop, source))
            elif k != key:
                key, lead = k, (did, th, pos)
            elif (did, th, pos) != lead:
                out.append((did, th, pos, pos + length, NO_ID if lead[1] & 1 else lead[0]))
        return batch(*zip(*out, strict=True)) if out else None

    def spans(rows: list[tuple]) -> pa.RecordBatch | None:
        key, _, did, th, pos, _, _, right, left = zip(*rows, strict=True)
        n = len(rows)
        key, did, th, pos = np.array(key), np.array(did), np.array(th), np.array(pos)
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        (R, nr), (L, nl) = matrix(list(right), side), matrix(list(left), side)
        lead = earliest_equal(group, R, nr, L, nl)
        # a repeated row's suffixes are there twice
        same = (did[lead] == did[:, None]) & (th[lead] == th[:, None]) & (pos[lead] == pos[:, None])
        lead = np.where((lead < 0) | same, -1, lead)
        # neighbouring windows with one source are one span
        edge = np.full((n, 1), -1, np.int64)
        source = np.where(lead < 0, edge, named(did, th)[lead])
        marked = lead >= 0
        joins = marked[:, 1:] & marked[:, :-1] & (source[:, 1:] == source[:, :-1])
        no = np.zeros((n, 1), bool)
        i, low = np.nonzero(marked & ~np.hstack([no, joins]))
        _, high = np.nonzero(marked & ~np.hstack([joins, no]))
        if not len(i):
            return None
        return batch(did[i], th[i], pos[i] - high, pos[i] - low + length, source[i, low])

    def both_kinds(rows: list[tuple]):
        cut = next((k for k, r in enumerate(rows) if r[1] != SUFFIX), len(rows))
        for work, part in ((spans, rows[:cut]), (windows, rows[cut:])):
            out = work(part) if part else None
            if out is not None:
                yield out

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            held += zip(*(b.column(k).to_pylist() for k in range(len(MARK_NAMES))), strict=True)
            if len(held) >= chunk:
                cut = len(held)
                while cut and held[cut - 1][:2] == held[-1][:2]:
                    cut -= 1
                if cut:
                    yield from both_kinds(held[:cut])
                    held = held[cut:]
        if held:
            yield from both_kinds(held)

    return dealt.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 16, group: int = 1000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(did, th, spans): per document (``row_key``) with later copies of passages, its disjoint spans (start, stop, source), in words; source: an earlier holder's id."""
    spark = session(docs)
    small_batches(spark)
    rows = keyed(docs, doc_id, text)
    found = materialize(repeated_anchors(rows, length, gram), "suffixes")
    matches = compare(with_context(rows, with_breadth(found, group), length, gram), length, gram)
    # equal spans of several partners are one before the shuffle
    once = matches.groupBy("did", "th", "start", "stop").agg(F.min("source").alias("source"))
    return once.groupBy("did", "th").agg(F.collect_list(F.struct("start", "stop", "source")).alias("_spans")).mapInArrow(_merge, "did long, th int, spans array<struct<start:int,stop:int,source:long>>")


def id_of(did: str, th: str) -> Column:
    """The id of a row key, null if the row has none."""
    return F.when(F.col(th).bitwiseAND(1) == 0, F.col(did))


def _merge(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source", pa.int64())]))
    for b in batches:
        out = []
        for spans in b.column(2).to_pylist():
            merged = [{"start": a, "stop": z, "source": None} for a, z in merge_spans((s["start"], s["stop"]) for s in spans)]
            k = 0
            for s in sorted(spans, key=lambda s: s["start"]):
                while s["start"] >= merged[k]["stop"]:
                    k += 1
                m = merged[k]
                m["source"] = min(s["source"], NO_ID if m["source"] is None else m["source"])
            for m in merged:
                m["source"] = None if m["source"] == NO_ID else m["source"]
            out.append(merged)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], ["did", "th", "spans"])


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (and the blanks that follow them)."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for a, z in spans:
        out.append(text[done : at[a]])
        done = at[min(z, len(at) - 1)]
    return b"".join([*out, text[done:]])


def without_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with later copies of passages cut from the texts, in all their columns; other texts stay as they are."""
    spans = repeated_spans(docs, length, doc_id=doc_id, text=text, **more).withColumnsRenamed({"did": "_did", "th": "_th", "spans": "_spans"})
    t = F.col(text)
    keys = docs.withColumns(dict(zip(("_did", "_th"), row_key(F.col(doc_id), t), strict=True)))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        pairs = zip(texts, spans, strict=True)
        return pd.Series([x if s is None else cut_words(x.encode(), [(p["start"], p["stop"]) for p in s]).decode() for x, s in pairs], dtype=object)

    met = keys.join(spans, ["_did", "_th"], "left")
    return met.withColumn(text, cut(t, "_spans")).select(*docs.columns)
