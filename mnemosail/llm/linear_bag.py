"""Words as bags of hashed n-grams, shared by the two text classifiers."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters, digits and underscores of any script.
WORD = re.compile(r"\w+")
#: Letters, and some other signs that ``str.isalpha`` tells apart.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """True if a character is a letter; superscripts, fractions and letter-like numbers are none."""
    return any(m.group().isalpha() for m in LETTER.finditer(text or ""))


_BASE = np.uint64(0x100000001B3)


def bags(words: list[str], lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of UTF-8 bytes of ``<word>``, ``lo <= n <= hi``, and of every whole word.

    All words are handled at once: one polynomial hash per n over their
    joined bytes, kept where the n-gram ends inside its word.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    enc = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    size = np.fromiter(map(len, enc), np.int64, len(enc))
    owner = np.repeat(np.arange(len(enc)), size)
    room = np.repeat(np.cumsum(size), size) - np.arange(len(owner))
    data = np.frombuffer(b"".join(enc), np.uint8).astype(np.uint64)
    who = [np.arange(len(enc))]
    where = [np.fromiter(map(zlib.crc32, enc), np.int64, len(enc)) % buckets]
    h = data + np.uint64(1)
    for n in range(2, hi + 1):
        h = h[:-1] * _BASE + data[n - 1 :] + np.uint64(1)
        if n >= lo and len(h):
            ok = room[: len(h)] >= n
            z = h[ok] + np.uint64(n)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            who.append(owner[: len(h)][ok])
            where.append(((z >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(who), np.concatenate(where)


def word_lists(words: list[str], lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bags of distinct words as one array, and the offsets of each word's part."""
    parts, size = [], np.zeros(len(words), np.int64)
    for k in range(0, len(words), 20_000):
        who, where = bags(words[k : k + 20_000], lo, hi, buckets)
        size[k : k + 20_000] = np.bincount(who, minlength=len(words[k : k + 20_000]))
        parts.append(where[np.argsort(who, kind="stable")].astype(np.int32))
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), np.concatenate([[0], np.cumsum(size)])


def word_scores(words: list[str], u: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Mean of ``u`` (buckets x outputs) over each word's bag."""
    who, where = bags(words, lo, hi, len(u))
    n = np.bincount(who, minlength=len(words)).astype(float)
    return np.stack([np.bincount(who, weights=u[where, k], minlength=len(words)) / n for k in range(u.shape[1])], axis=1) if words else np.empty((0, u.shape[1]))


class Vocabulary:
    """Word to row number of a growing table of scores; emptied when it holds more than ``limit`` words."""

    def __init__(self, u: np.ndarray, lo: int, hi: int, limit: int = 400_000):
        self.u, self.lo, self.hi, self.limit = u, lo, hi, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((0, self.u.shape[1]))

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores of each text's words; new words of all the texts are scored together."""
        if len(self.index) > self.limit:
            self.clear()
        index = self.index
        new = [w for w in dict.fromkeys(w for ws in texts for w in ws) if w not in index]
        if new:
            at = len(index)
            index.update(zip(new, range(at, at + len(new)), strict=True))
            self.table = np.concatenate([self.table, word_scores(new, self.u, self.lo, self.hi)])
        return [self.table[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))] for ws in texts]


def groups(items: list, size, most: int):
    """Runs of items whose sizes sum to ``most`` at most (single items may be larger)."""
    run, total = [], 0
    for x in items:
        n = size(x)
        if run and total + n > most:
            yield run
            run, total = [], 0
        run.append(x)
        total += n
    if run:
        yield run


def bounded_rows(rows: DataFrame, label: str, text: str, doc_id: str, ticket: Column, each: int, most_bytes: int) -> DataFrame:
    """doc_id, label and text of each label's first rows by ticket: ``each`` rows and ``most_bytes`` bytes of text of a label at most.

    Ids and sizes are ranked, and texts joined last. Texts of over a quarter of ``most_bytes`` come after all others,
    smallest first, and what no longer fits is passed over, so no text displaces the rest of its label. A label
    whose texts are all larger than ``most_bytes`` gives the beginning of its smallest. Repeated rows count once.
    """
    rows, size, mark = rows.select(doc_id, label, text), F.octet_length(text), F.xxhash64(text)
    large = F.when(size > most_bytes // 4, size).otherwise(0)
    sized = rows.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"), mark.alias("_mark"), size.alias("_size"), large.alias("_large"), ticket.alias("_ticket")).distinct()
    first = Window.partitionBy("_label").orderBy("_large", "_ticket", "_id", "_mark")
    ranked = sized.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= each)
    taken, left = [], {}
    for r in ranked.orderBy("_label", "_rank").select("_id", "_label", "_mark", "_size").collect():
        fresh = r["_label"] not in left
        room = left.setdefault(r["_label"], most_bytes)
        if r["_size"] <= room or (fresh and r["_size"] > most_bytes):
            left[r["_label"]] = max(0, room - r["_size"])
            taken.append((r["_id"], r["_label"], r["_mark"]))
    if not taken:
        return rows.where(F.lit(False))
    keys = rows.sparkSession.createDataFrame(taken, ranked.select("_id", "_label", "_mark").schema)
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col(label) == F.col("_label")) & (mark == F.col("_mark"))
    whole = F.when(size > most_bytes, F.left(text, F.lit(most_bytes // 4))).otherwise(F.col(text))
    found = rows.join(F.broadcast(keys), same).dropDuplicates(["_id", "_label", "_mark"])
    return found.select(doc_id, label, whole.alias(text))


def in_order(part: pd.DataFrame, label: str, text: str, doc_id: str) -> pd.DataFrame:
    """Rows of ``bounded_rows`` in the order in which models are fitted on them."""
    return part.sort_values([doc_id, label, text], kind="stable")


def bounded_sample(rows: DataFrame, label: str, text: str, doc_id: str, ticket: Column, each: int, most_bytes: int) -> pd.DataFrame:
    """``bounded_rows`` on the driver, in order."""
    return in_order(bounded_rows(rows, label, text, doc_id, ticket, each, most_bytes).toPandas(), label, text, doc_id)
