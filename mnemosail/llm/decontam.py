"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose
values were changed keeps its template. Windows of ``window`` template words are
joined by hash between benchmark and documents; windows with fewer than
``literals`` ordinary words are too general and are left out. Items of which such windows cover too little (a
row of numbers, a short question) are looked up whole and word for word instead, whatever their length. Matching windows of one
item that lie on one diagonal of a document are one alignment. An alignment
counts if it covers ``coverage`` of the item's words (or ``enough`` words), and if its
slots are consistent: one value of the item always meets one value of the
document, and different names meet different names, for ``agreement`` of its slots.

The benchmark is broadcast in chunks of about ``chunk_windows`` windows, one
pass over the documents each, so its size never meets a limit. Items shorter than
a window form one window with all their words, which needs ``literals`` ordinary words or only ordinary ones.
With more than one chunk each chunk's result is written before the next chunk is built, so the driver holds one at a time.

Items whose words have fewer than ``least_chars`` characters together are reported like others, but drop no document.
Windows that more than ``common`` places of the benchmark share (an instruction that opens many questions) are
looked up only for items that other windows of the document point to, or whose common windows alone could count; no match is lost by that.

Null and empty texts (on either side) match nothing. Rows with a null id are
compared too and reported under null. Repeated rows and items repeat their pairs.

Names are title-case words; units are the listed words right after a number. A title-case
word that starts a sentence may be a name or not, so each text has two templates: one where
such words are literal, and one where they are names unless listed as ordinary. Either may match.
In the second, neighbouring names or numbers are one placeholder ("Mary Ann" may stand for "Tom"), and
diagonals of one item that differ by at most ``drift`` of its length (or a window) are one alignment, as inserted
words shift what follows. Values of as many words meet word by word, others as a whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from .common import Memo, discard, gram_hashes, materialize, session, written

TOKEN = re.compile(r"[^\W\d]\w*+|\d++(?:[.,]\d+)*+|\w++|[.!?]")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees metre metres meter meters kilometre kilometres kilometer kilometers".split())
#: Words that start sentences without being names.
ORDINARY = frozenset(
    "a about above according after again all also although altogether among an and another any are as assume at because before below besides between both but by calculate can choose compute consider could describe despite determine did do does due during each either eventually every everyone evaluate except explain find finally first for four from furthermore give given had has have he hence her here hers his how however i identify if in including initially instead into is it its last lastly later let list long many may me meanwhile might more moreover most much must my name near neither next no nobody none nor not nothing now of off often on once one only or originally other others otherwise our out over per perhaps please prove same second select several shall she should show similarly since so solve some someone sometimes state still such suppose than that the their them then there therefore these they third this those though through thus to today together tomorrow two under unless until up upon us using was we were what whatever when whenever where whether which while who whom whose why will with within without would write yes yesterday yet you your".split()
)
WORD, TITLE, NUMBER, UNIT, END, ORDINARY_TITLE = range(6)
#: Windows are looked up by their first bits before they are searched for.
BITS = 22
HIGH = np.uint64(64 - BITS)
PLACEHOLDER = {NUMBER: "<number>", TITLE: "<name>", UNIT: "<unit>"}


@dataclass(frozen=True)
class Config:
    window: int = 8
    literals: int = 3
    coverage: float = 0.5
    enough: int = 25
    agreement: float = 0.8
    drift: float = 0.25
    least_chars: int = 8
    common: int = 32
    chunk_windows: int = 1_000_000


#: Kinds of listed words and signs, whatever their case.
KINDS = dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBER_WORDS, NUMBER) | dict.fromkeys(".!?", END)


def code(token: str) -> int:
    """Hash of the lower-cased token with its kind in the low 3 bits."""
    low = token.lower()
    kind = KINDS.get(low)
    if kind is None:
        if token == low:
            kind = NUMBER if token[0].isdigit() else WORD
        elif token[0].isdigit():
            kind = NUMBER
        elif len(token) > 1 and token[0].isupper() and token[1:].islower():
            kind = ORDINARY_TITLE if low in ORDINARY else TITLE
        else:
            kind = WORD
    return (xxhash.xxh3_64_intdigest(low) & ~7) | kind


SLOT_HASH = np.zeros(6, np.uint64)
for _k, _s in PLACEHOLDER.items():
    SLOT_HASH[_k] = xxhash.xxh3_64_intdigest(_s)


@dataclass(frozen=True)
class Template:
    hashes: np.ndarray
    #: kind of each placeholder, 0 for words
    slot: np.ndarray
    #: first token of each entry, and the one after its last
    at: np.ndarray
    end: np.ndarray


def templates(tokens: list[str], memo: Memo) -> tuple[Template, Template]:
    """Templates without sentence ends: title-case words that start a sentence are literal in the first; in the second all are names that are not ordinary words, and runs of names or numbers are one entry."""
    c = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    kind = (c & np.uint64(7)).astype(np.int8)
    before = np.concatenate([[END], kind[:-1]]) if len(kind) else kind
    title, inner = (kind == TITLE) | (kind == ORDINARY_TITLE), before != END
    other = np.where((kind == NUMBER) | (kind == UNIT) & (before == NUMBER), kind, 0)
    at = np.flatnonzero(kind != END)
    c = c[at] & ~np.uint64(7)

    def form(names: np.ndarray) -> Template:
        slot = np.where(names, TITLE, other)[at]
        return Template(np.where(slot > 0, SLOT_HASH[slot], c), slot, at, at + 1)

    plain, t = form(title & inner), form(kind == TITLE)
    more = (t.slot[1:] == t.slot[:-1]) & ((t.slot[1:] == TITLE) | (t.slot[1:] == NUMBER)) & (at[1:] == at[:-1] + 1)
    if not more.any():
        return plain, t
    first, last = np.flatnonzero(np.concatenate([[True], ~more])), np.flatnonzero(np.concatenate([~more, [True]]))
    return plain, Template(t.hashes[first], t.slot[first], at[first], t.end[last])


def verbatim(tokens: list[str], memo: Memo) -> Template:
    """The template in which every word stands for itself."""
    c = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    at = np.flatnonzero((c & np.uint64(7)) != END)
    return Template(c[at] & ~np.uint64(7), np.zeros(len(at), np.int64), at, at + 1)


NOTHING = verbatim([], Memo(int))


def windows(h: np.ndarray, slot: np.ndarray, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the windows that are specific enough."""
    g = gram_hashes(h, c.window, mixed=False)
    cum = np.concatenate([[0], np.cumsum(slot == 0)])
    at = np.flatnonzero(cum[c.window :] - cum[: len(g)] >= c.literals) if len(g) else np.empty(0, np.int64)
    return g[at], at


class Table:
    """One kind of templates of all items: their entries, and a sorted table of their windows."""

    def __init__(self, items: list[Template], c: Config):
        self.c, self.items = c, items
        hashes, item, start = [], [], []
        short: dict[int, list] = {}
        for k, t in enumerate(items):
            n = len(t.hashes)
            if n < c.window:
                if n and (t.slot == 0).sum() >= min(c.literals, n):
                    short.setdefault(n, []).append((int(gram_hashes(t.hashes, n, mixed=False)[0]), k))
                continue
            g, s = windows(t.hashes, t.slot, c)
            hashes.append(g), item.append(np.full(len(g), k)), start.append(s)
        none = np.empty(0, np.int64)
        hashes = np.concatenate(hashes) if hashes else none.astype(np.uint64)
        item, start = (np.concatenate(x) if x else none for x in (item, start))
        order = np.lexsort((start, item, hashes))
        hashes, item, start = hashes[order], item[order], start[order]
        run = np.concatenate([[0], np.cumsum(hashes[1:] != hashes[:-1])]) if len(hashes) else none
        common = np.bincount(run)[run] > c.common if len(hashes) else none.astype(bool)
        self.cover = self.covered(item, start)
        # common windows alone never count for the others
        alone = self.covered(item[common], start[common])
        able = (alone >= c.coverage * self.words()) | (alone >= c.enough)
        seed = ~common | able[item] if len(items) else common
        self.hashes, self.item, self.start = hashes[seed], item[seed], start[seed]
        self.more = hashes[~seed], item[~seed], start[~seed]
        self.bits = np.zeros(1 << BITS, bool)  # most windows of clean texts stop here
        self.bits[hashes >> HIGH] = True
        self.short = {n: (np.array(sorted(x[0] for x in v), np.uint64), [x[1] for x in sorted(v)]) for n, v in short.items()}

    def __len__(self) -> int:
        return len(self.hashes) + len(self.short)

    def words(self) -> np.ndarray:
        """Words of each item."""
        return np.array([(t.end - t.at).sum() for t in self.items], np.int64)

    def covered(self, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Words of each item that some windows cover: all items' entries in one row, with a gap after each."""
        size = np.fromiter((len(t.hashes) + 1 for t in self.items), np.int64, len(self.items))
        base = np.cumsum(size) - size
        edge = np.bincount(base[item] + start, minlength=size.sum()) - np.bincount(base[item] + start + self.c.window, minlength=size.sum()) if len(item) else np.zeros(size.sum(), np.int64)
        weight = np.concatenate([np.append(t.end - t.at, 0) for t in self.items]) if self.items else edge
        return np.add.reduceat(weight * (np.cumsum(edge) > 0), base) if self.items else edge

    def share(self) -> np.ndarray:
        """Share of each item's words that its windows cover."""
        out = self.cover / np.maximum(self.words(), 1)
        for _, items in self.short.values():
            out[items] = 1.0
        return out

    def hits(self, h: np.ndarray, slot: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, document start, item start, words) of matching windows: all of every item that could count."""
        out = []
        g, at = windows(h, slot, self.c)
        may = np.flatnonzero(self.bits[g >> HIGH])
        if len(may):
            lo, hi = (np.searchsorted(self.hashes, g[may], side) for side in ("left", "right"))
            for k in np.flatnonzero(hi > lo).tolist():
                p = int(at[may[k]])
                out += [(int(self.item[j]), p, int(self.start[j]), self.c.window) for j in range(lo[k], hi[k])]
        if out and len(self.more[0]):
            hashes, item, start = self.more
            known = np.unique([x[0] for x in out])
            lo, hi = (np.searchsorted(hashes, g[may], side) for side in ("left", "right"))
            for k in np.flatnonzero(hi > lo).tolist():
                p, part = int(at[may[k]]), item[lo[k] : hi[k]]
                first, last = (np.searchsorted(part, known, side) for side in ("left", "right"))
                for i, a, b in zip(known.tolist(), (first + lo[k]).tolist(), (last + lo[k]).tolist(), strict=True):
                    out += [(i, p, int(start[j]), self.c.window) for j in range(a, b)]
        for n, (table, items) in self.short.items():
            g = gram_hashes(h, n, mixed=False)
            lo, hi = (np.searchsorted(table, g, side) for side in ("left", "right"))
            for p in np.flatnonzero(hi > lo).tolist():
                out += [(items[j], p, 0, n) for j in range(lo[p], hi[p])]
        return out


class Benchmark:
    """One chunk of items, with a table for each kind of template, and one for items that only match word for word."""

    def __init__(self, items: list[tuple[int | None, str]], c: Config):
        self.c, memo = c, Memo(code)
        self.ids, self.tokens, self.places, forms = [], [], [], []
        for i, t in items:
            tokens = TOKEN.findall(t or "")
            both = templates(tokens, memo)
            if len(both[0].hashes):
                self.ids.append(i), self.tokens.append(tokens), self.places.append(both[0].at), forms.append(both)
        self.tables = [Table([f[k] for f in forms], c) for k in (0, 1)]
        found = np.maximum(*(t.share() for t in self.tables)) if forms else []
        lost = [x < c.coverage for x in found]
        self.tables.append(Table([verbatim(t, memo) if k else NOTHING for t, k in zip(self.tokens, lost, strict=True)], c))
        self.weighty = [sum(len(x) for x in t if x not in ".!?") >= c.least_chars for t in self.tokens]
        self.tokens = [[x.lower() for x in t] for t in self.tokens]

    def judge(self, item: int, mine: Template, text: Template, tokens: list[str], places: np.ndarray, line: dict[int, int], whole: bool = False) -> tuple | None:
        """(words covered, -first word, share of the item, share of consistent slots) of item entries at their shifts, if they count; ``whole``: if they are all of the item."""
        covered = sorted(line)
        n = int(sum(mine.end[s] - mine.at[s] for s in covered))
        share = n / len(self.places[item])
        if share < (1 if whole else self.c.coverage) and (whole or n < self.c.enough):
            return None
        there, back, good, total = {}, {}, 0, 0
        for s in covered:
            kind, d = int(mine.slot[s]), s + line[s]
            if kind and text.slot[d]:
                a, b = self.tokens[item][mine.at[s] : mine.end[s]], [x.lower() for x in tokens[text.at[d] : text.end[d]]]
                for x, y in zip(a, b, strict=True) if len(a) == len(b) else [(" ".join(a), " ".join(b))]:
                    total += 1
                    fits = there.setdefault((kind, x), y) == y
                    if kind == TITLE:
                        fits &= back.setdefault(y, (kind, x)) == (kind, x)
                    good += fits
        agree = good / total if total else 1.0
        if agree < self.c.agreement:
            return None
        s = covered[0]
        first = np.searchsorted(places, text.at[s + line[s]]) - np.searchsorted(self.places[item], mine.at[s])
        return n, -int(first), share, agree

    def joined(self, lines: dict[tuple[int, int], set[int]]):
        """(item, shift of each covered entry): for every diagonal, it and those up to ``drift`` further; the longer one takes what two cover."""
        shifts: dict[int, list[int]] = {}
        for item, shift in sorted(lines):
            shifts.setdefault(item, []).append(shift)
        for item, found in shifts.items():
            reach = max(self.c.window, int(self.c.drift * len(self.places[item])))
            for k, low in enumerate(found):
                near = found[k : bisect_right(found, low + reach)]
                if len(near) > 1:
                    line: dict[int, int] = {}
                    for shift in sorted(near, key=lambda x: len(lines[item, x])):
                        line.update(dict.fromkeys(lines[item, shift], shift))
                    yield item, line

    def matches(self, text: str, memo: Memo) -> list[tuple]:
        """(item id, first word, words covered, share of the item, share of consistent slots) per item, its best alignment."""
        return [(self.ids[k], -v[1] + 0, v[0], v[2], v[3]) for k, v in sorted(self.best(text, memo).items())]

    def leaks(self, text: str, memo: Memo) -> bool:
        """If an item matches that is long enough to drop a document."""
        return any(self.weighty[k] for k in self.best(text, memo))

    def best(self, text: str, memo: Memo) -> dict[int, tuple]:
        """Each matching item's best alignment, as ``judge`` has it."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return {}
        both = templates(tokens, memo)
        memo.trim()
        best: dict[int, tuple] = {}
        for table, t in zip(self.tables, (*both, verbatim(tokens, memo) if len(self.tables[2]) else NOTHING), strict=True):
            if not len(t.hashes):
                continue
            lines: dict[tuple[int, int], set[int]] = {}
            for item, p, s, n in table.hits(t.hashes, t.slot):
                lines.setdefault((item, p - s), set()).update(range(s, s + n))
            alignments = [(item, dict.fromkeys(covered, shift)) for (item, shift), covered in lines.items()]
            if t is both[1]:
                alignments += self.joined(lines)
            for item, line in alignments:
                found = self.judge(item, table.items[item], t, tokens, both[0].at, line, table is self.tables[2])
                if found and (item not in best or found > best[item]):
                    best[item] = found
        return best


def benchmark_chunks(benchmark: DataFrame, c: Config, item_id: str, item_text: str):
    """Broadcast parts of the benchmark, each of about ``chunk_windows`` windows, and whether it is the only one.

    A part is released when the next is asked for.
    """
    spark = session(benchmark)
    items = benchmark.select(F.col(item_id).cast("long").alias("_item"), F.col(item_text).alias("_text")).where(F.col("_text").isNotNull())
    # a word takes two characters at least, so this bounds the windows from above
    size = items.agg(F.sum(F.length("_text") / 2 + 1)).first()[0] or 0
    chunks = max(1, int(-(-size // c.chunk_windows)))
    for k in range(chunks):
        part = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(chunks)) == k).toArrow()
        rows = sorted(zip(part["_item"].to_pylist(), part["_text"].to_pylist(), strict=True), key=str)
        shared = spark.sparkContext.broadcast(Benchmark(rows, c))
        yield shared, chunks == 1
        if chunks > 1:
            shared.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, c: Config = Config(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, n_words, coverage, consistency: every document and benchmark item that match."""
    small_batches(session(docs))
    schema = "doc_id long, item_id long, start long, n_words long, coverage double, consistency double"
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    out = None
    for shared, only in benchmark_chunks(benchmark, c, item_id, item_text):

        def run(batches, shared=shared):
            bench, memo = shared.value, Memo(code)
            names = [x.split()[0] for x in schema.split(", ")]
            for b in batches:
                found = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in bench.matches(t, memo)]
                if found:
                    cols = list(zip(*found, strict=True))
                    kinds = [pa.int64()] * 4 + [pa.float64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names)

        found = rows.mapInArrow(run, schema)
        if only:
            return found
        found = materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, c: Config = Config(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs``, in all their columns, that match no benchmark item."""
    small_batches(session(docs))
    mark = written()
    for shared, only in benchmark_chunks(benchmark, c, item_id, item_text):

        def run(batches, shared=shared):
            bench, memo = shared.value, Memo(code)
            for b in batches:
                yield b.filter(pa.array([not (t and bench.leaks(t, memo)) for t in b.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = materialize(docs, "clean")
            discard(session(docs), mark, docs)
    return docs
