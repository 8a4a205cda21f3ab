"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

1. Each partition tokenizes its documents, cuts those longer than ``capacity``
   and packs the pieces best-fit decreasing. Nearly full bins are done.
2. Underfull bins become items. They are merged up a tree of partitions: a group of one
   round holds what ``fan_in`` neighbouring groups of the round before left, and is
   packed best-fit decreasing again, up to one root. Groups of more than about ``group_items`` items
   are split, so no task grows with the input; a split root is dealt anew until a round saves no sequence.
3. Each piece follows its bin's merges to its final sequence and offset.

Only lengths and checksums travel between tasks, never ids or texts.

A document's ids come from its pre-tokens: the tokenizer drops white space, parts letters from
other signs and never looks across a pre-token, so ids of pre-tokens, encoded
once and remembered, join to the ids of the text.

Null texts are empty: a document is then its end id alone. Null ids and
repeated rows are packed like any other row, each by itself.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from .common import materialize, session

CHUNK = re.compile(r"[^ \t\r\n]+")
MODEL = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"

#: Texts with none of these are simple: composed letters below U+0250 that fold case one by one, and no special string.
HARD = "[^\\x00-\u012f\u0131-\u024f]|<\\|(?:start|end)oftext\\|>"
#: What the tokenizer's pattern parts from runs of letters, and the blanks beyond ASCII's usual ones.
APART = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[\x0b\x{85}\x{a0}]|[^\s\x0b\x{85}\x{a0}\pL\pN]+)"
BLANKS = ["", "\x0b", "\x85", "\xa0"]


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet as a translation of Latin-1 text: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


assert array("I").itemsize == 4 and sys.byteorder == "little"


class Encoder:
    """Ids of texts without a tokenizer call per text.

    Simple texts are folded, parted into pre-tokens and coded by Arrow; the
    tokenizer's model gives the ids of each pre-token once, and arrays of codes become
    arrays of ids. Other texts are joined from the ids of their blank-separated chunks.
    """

    def __init__(self, name: str = MODEL, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(public_tokenizers.path(name)), limit
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.parts = dict.fromkeys(BLANKS, b"")

    def chunk(self, w: str) -> bytes:
        return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()

    def part(self, w: str) -> bytes:
        """Ids of one folded pre-token."""
        if not (w.isascii() and w.isprintable()):
            w = w.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(w)]).tobytes()

    def lookup(self, words: list[str]) -> list[bytes]:
        if len(self.parts) > self.limit:
            self.forget()
        parts = self.parts
        out = list(map(parts.get, words))
        for k, ids in enumerate(out):
            if ids is None:
                w = words[k]
                out[k] = parts[w] = self.part(w)
        return out

    def simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of simple texts without nulls."""
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), APART, r" \1 "))
        first = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        known = self.lookup(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at, code = np.cumsum(size) - size, coded.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(size[code])])
        out = np.empty(total[-1], "<u4")
        for k in range(0, len(code), 1_000_000):  # bounded memory for index arrays
            c = code[k : k + 1_000_000]
            n, base = size[c], total[k : k + len(c)]
            place = np.repeat(at[c] - base, n)
            place += np.arange(total[k], total[k] + len(place))
            out[total[k] : total[k] + len(place)] = flat[place]
        return out, np.diff(total[first - first[0]])

    def hard(self, text: str) -> np.ndarray:
        if len(self.chunks) > self.limit // 4:
            self.chunks.clear()
        out = []
        for w in CHUNK.findall(text):
            ids = self.chunks.get(w)
            if ids is None:
                ids = self.chunks[w] = self.chunk(w)
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); null texts are empty."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, HARD).to_numpy(zero_copy_only=False)
        if not hard.any():
            return self.simple(texts)
        ids, size = self.simple(pc.if_else(pa.array(hard), pa.scalar("", texts.type), texts))
        parts, done, place = [], 0, np.cumsum(size)
        for k in np.flatnonzero(hard):
            mine = self.hard(texts[int(k)].as_py())
            parts += [ids[done : place[k]], mine]
            size[k], done = len(mine), place[k]
        return np.concatenate([*parts, ids[done:]]), size


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker process's encoder: what one task has remembered serves the next."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def bulks(batches, most: int = 12 << 20):
    """Columns of neighbouring batches joined and cut, so that each yield holds about ``most`` bytes of text, or one row."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined():
        t = pa.Table.from_batches(held)
        return t.column(0).combine_chunks(), t.column(1).combine_chunks()

    for b in batches:
        step = 1 if b.nbytes > 2 * most else max(1, b.num_rows)
        for k in range(0, b.num_rows, step):
            part = b.slice(k, step)
            n = part.nbytes
            if held and size + n > most:
                yield joined()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield joined()


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and each bin's fill.

    Open bins wait in one list per free room; a bit mask over the rooms finds
    the tightest that fits.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> n
        if fits and n:
            room = n + (fits & -fits).bit_length() - 1
            k = waiting[room].pop()
            if not waiting[room]:
                mask &= ~(1 << room)
        else:
            k, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += n
        if room > n:
            waiting[room - n].append(k)
            mask |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def cut(ids: np.ndarray, size: np.ndarray, end_id: int, capacity: int) -> tuple[np.ndarray, ...]:
    """(document, piece, start, length, crc32) of the pieces of texts with their end ids."""
    whole = size + 1
    stop = np.cumsum(whole)
    data = np.empty(stop[-1] if len(stop) else 0, "<u4")
    ends = stop - 1
    body = np.ones(len(data), bool)
    body[ends], data[ends] = False, end_id
    data[body] = ids
    count = -(-whole // capacity)
    doc = np.repeat(np.arange(len(size)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    length = np.minimum(whole[doc] - start, capacity)
    first = (stop - whole)[doc] + start
    raw = memoryview(data).cast("B") if len(data) else b""
    crc = np.fromiter((zlib.crc32(raw[a:z]) for a, z in zip((4 * first).tolist(), (4 * (first + length)).tolist(), strict=True)), np.int64, len(doc))
    return doc, piece, start, length, crc


def tokenize_and_pack(docs: DataFrame, capacity: int, end_id: int, doc_id: str, text: str, model: str) -> DataFrame:
    """Pieces of all documents with their partition's bins (PIECES)."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        enc, ids, rest = encoder(model), [], []
        for name, texts in bulks(batches):
            doc, *columns = cut(*enc.encode(texts), end_id, capacity)
            ids.append(name.take(pa.array(doc))), rest.append(columns)
        if not ids:
            return
        piece, start, length, crc = map(np.concatenate, zip(*rest, strict=True))
        bins, offsets, fill = best_fit(length, capacity)
        base = TaskContext.get().partitionId() << 32
        cols = [pa.concat_arrays(ids), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(bins + base), pa.array(offsets), pa.array(fill[bins])]
        whole = pa.RecordBatch.from_arrays(cols, names)
        for k in range(0, whole.num_rows, 50_000):
            yield whole.slice(k, 50_000)

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, PIECES)


def merge_round(items: DataFrame, capacity: int) -> DataFrame:
    """(bin, parent, shift, fill): one best-fit round over the groups (g, h) of leftovers."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        g, h, name, size = (t.column(k).to_numpy() for k in range(4))
        order = np.lexsort((name, h, g))
        g, h, name, size = g[order], h[order], name[order], size[order]
        edges = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]), [True]]))
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            bins, offsets, fill = best_fit(size[a:z], capacity)
            first = np.full(len(fill), np.iinfo(np.int64).max)
            np.minimum.at(first, bins, name[a:z])
            yield pa.RecordBatch.from_arrays([pa.array(name[a:z]), pa.array(first[bins]), pa.array(offsets), pa.array(fill[bins])], ["bin", "parent", "shift", "fill"])

    return items.repartition("g", "h").mapInArrow(run, "bin long, parent long, shift long, fill long")


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, slack: int = 8, group_items: int = 100_000, fan_in: int = 8, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    ``slack``: tokens of room below which a bin counts as full.
    """
    small_batches(session(docs))
    pieces = materialize(tokenize_and_pack(docs, capacity, end_id, doc_id, text, model), "pieces")
    left = pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill")
    rounds, level, span = [], 0, 1
    while True:
        level, span = level + 1, span * fan_in
        keyed = left.withColumn("g", F.floor(F.shiftright("bin", 32) / span).cast("long"))
        groups, count, most = keyed.groupBy("g").count().agg(F.count("*"), F.sum("count"), F.max("count")).first()
        if (count or 0) < 2:
            break
        parts = -(-most // group_items)
        keyed = keyed.select("g", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(parts)).cast("int").alias("h"), "bin", "fill")
        merged = materialize(merge_round(keyed, capacity), "packed", 4)
        rounds.append(merged)
        after = merged.where("shift = 0").groupBy(F.col("parent").alias("bin")).agg(F.first("fill").alias("fill"))
        left = after.where(F.col("fill") < capacity - slack)
        # the root is one group: what it leaves open does not fit together; split roots go on while that saves sequences
        if groups == 1 and (parts == 1 or after.count() == count):
            break
    if not rounds:
        return pieces.withColumn("sequence_id", F.col("bin")).drop("bin", "fill")

    def follow(a: DataFrame, b: DataFrame) -> DataFrame:
        nxt = b.select(F.col("bin").alias("parent"), F.col("parent").alias("p2"), F.col("shift").alias("s2"))
        return a.join(nxt, "parent", "left").select("bin", F.coalesce("p2", "parent").alias("parent"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift"))

    moves = reduce(follow, rounds[1:], rounds[0].select("bin", "parent", "shift"))
    out = pieces.join(moves, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def fill_rate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """(sequences used, least number that could hold all tokens) of a result of ``pack``."""
    tokens, used = packed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    return used, -(-(tokens or 0) // capacity)
