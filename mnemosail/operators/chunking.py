"""Content-stable chunking as table-valued functions."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import small_batches
from .code_split import code_spans

HEADING = r"(?md)^#{1,6}[ \t]+.*$"
SPANS = "array<struct<idx:int,start:int,stop:int>>"


def window_spans(text: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(index, start, stop) of windows of ``size`` characters, the next one ``overlap`` before the end of the last.

    An end moves back to the last line break in the second half of its window. Ends after line breaks are listed once and looked up by
    bisection.
    """
    if len(text) <= size:
        return [(0, 0, len(text))]
    after_lines = [m.end() for m in re.finditer("\n", text)]
    ends: list[int] = []
    starts = [0]
    while starts[-1] < len(text):
        full = starts[-1] + size
        k = bisect_right(after_lines, full) if full < len(text) else 0
        in_second_half = k and after_lines[k - 1] >= full - size + size // 2 + 2
        ends.append(after_lines[k - 1] if in_second_half else full)
        starts.append(ends[-1] - overlap)
    return [(k, a, min(z, len(text))) for k, (a, z) in enumerate(zip(starts, ends))]


def fixed_windows(c: Column, size: int = 800, overlap: int = 200) -> Column:
    """Array of (idx, start, stop). Each end depends on the one before, so this is an Arrow function, called once a text."""
    if overlap * 2 >= size:
        raise ValueError("overlap must be less than half the size")
    small_batches(SparkSession.active())

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: window_spans(t or "", size, overlap))

    return spans(c)


def even_windows(c: Column, size: int = 800, overlap: int = 200) -> Column:
    """The same for texts without line breaks, natively: starts are multiples of size - overlap."""
    n, step = F.length(c), size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil(n / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("idx"), (i * step).cast("int").alias("start"), F.least(i * step + size, n).cast("int").alias("stop")))


def piece(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["stop"] - span["start"])


def numbered(docs: DataFrame, text: str, size: int = 800, overlap: int = 200) -> DataFrame:
    """One row per window with ``key`` ('' first, then chunk1, ...) and ``chunk``."""
    rows = docs.select("*", F.explode(fixed_windows(F.col(text), size, overlap)).alias("_s"))
    key = F.when(F.col("_s.idx") == 0, "").otherwise(F.concat(F.lit("chunk"), F.col("_s.idx").cast("string")))
    return rows.select(*docs.columns, key.alias("key"), piece(F.col(text), F.col("_s")).alias("chunk"))


def sections(c: Column) -> Column:
    """Array of (ord, heading, body): text before the first heading (heading null), then one per heading line."""
    heads = F.regexp_extract_all(c, F.lit(HEADING), 0)
    bodies = F.split(c, HEADING)
    first = F.struct(F.lit(0).alias("ord"), F.lit(None).cast("string").alias("heading"), bodies[0].alias("body"))
    rest = F.transform(heads, lambda h, i: F.struct((i + 1).cast("int").alias("ord"), h.alias("heading"), F.concat(h, F.get(bodies, i + 1)).alias("body")))
    return F.concat(F.array(first), rest)


def markdown_sections(docs: DataFrame, text: str, size: int = 800, overlap: int = 200) -> DataFrame:
    """Section rows (key, chunk), keyed by a hash of the heading line, so edits elsewhere change no key.

    Texts without headings are numbered windows. Blank text before the first heading is
    dropped, and then the first section has the bare key. Sections over ``size`` are cut, keys ``...-part1`` and on.
    """
    t = F.col(text)
    plain = numbered(docs.where(~t.rlike(HEADING)), text, size, overlap)
    rows = docs.where(t.rlike(HEADING)).select("*", F.explode(sections(t)).alias("_s"), (T.strip(F.get(F.split(t, HEADING), F.lit(0))) != "").alias("_lead"))
    rows = rows.where(F.col("_s.heading").isNotNull() | F.col("_lead"))
    bare = F.col("_s.heading").isNull() | (~F.col("_lead") & (F.col("_s.ord") == 1))
    rows = rows.withColumn("_key", F.when(bare, "").otherwise(T.stable_key(F.col("_s.heading"))))
    return docs_parts(rows, docs.columns, F.col("_s.body"), F.col("_key"), size, overlap).unionByName(plain)


def docs_parts(rows: DataFrame, keep: list[str], body: Column, key: Column, size: int, overlap: int) -> DataFrame:
    """Cuts long bodies; part n >= 1 of a key is key-partn (partn for the bare key)."""
    cut = rows.withColumn("_b", body).withColumn("_k", key).select(*keep, "_b", "_k", F.explode(fixed_windows(F.col("_b"), size, overlap)).alias("_w"))
    n = F.col("_w.idx").cast("string")
    part = F.when(F.col("_w.idx") == 0, F.col("_k")).when(F.col("_k") == "", F.concat(F.lit("part"), n)).otherwise(F.concat("_k", F.lit("-part"), n))
    return cut.select(*keep, part.alias("key"), piece(F.col("_b"), F.col("_w")).alias("chunk"))


def issue_sections(rows: DataFrame, header: str, comments: str, size: int = 1200, overlap: int = 300) -> DataFrame:
    """Header chunks, and one section per comment keyed by its place, so a new comment changes no other key."""
    keep = [c for c in rows.columns if c not in (header, comments)]
    head = F.array(F.struct(F.lit("").alias("k"), F.col(header).alias("b")))
    talk = F.transform(F.coalesce(F.col(comments), F.array().cast("array<string>")), lambda b, i: F.struct(F.concat(F.lit("comment"), i.cast("string")).alias("k"), b.alias("b")))
    return docs_parts(rows.select(*keep, F.explode(F.concat(head, talk)).alias("_s")), keep, F.col("_s.b"), F.col("_s.k"), size, overlap)


def code_chunks(files: DataFrame, path: str = "filepath", code: str = "code", size: int = 1000, overlap: int = 300) -> DataFrame:
    """id ``path:i``, chunk_index, code, search_text of each chunk of each file, split by the language of its extension."""
    small_batches(files.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([code_spans(t or "", p, size, overlap) for t, p in zip(texts, paths, strict=True)])

    rows = files.select(path, code, F.explode(spans(F.col(code), F.col(path))).alias("_s"))
    chunk = piece(F.col(code), F.col("_s"))
    return rows.select(F.concat(F.col(path), F.lit(":"), F.col("_s.idx").cast("string")).alias("id"), F.col(path).alias("filepath"), F.col("_s.idx").alias("chunk_index"), chunk.alias("code"), F.concat(F.col(path), F.lit(" "), chunk).alias("search_text"))


def embed(rows: DataFrame, text: str, dim: int = 64, embedder=None) -> DataFrame:
    """Adds ``embedding``. ``embedder``: list of texts to list of vectors; the default hashes words, for tests."""
    small_batches(rows.sparkSession)
    embedder = embedder or (lambda texts: [hash_vector(t, dim) for t in texts])

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embedder([t or "" for t in s]))

    return rows.withColumn("embedding", run(F.col(text)))


def hash_vector(text: str, dim: int) -> list[float]:
    import zlib

    v = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()):
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h >> 31 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def rich_text(c: Column) -> Column:
    """Plain text of a document tree given as JSON. The tree is recursive, which no column expression is."""
    small_batches(SparkSession.active())

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(flatten_json)

    return run(c)


def flatten_json(s: str | None) -> str:
    import json

    try:
        return flatten_node(json.loads(s)) if s else ""
    except ValueError:
        return ""


#: Node types that end a line.
LINE_NODES = frozenset(["paragraph", "heading", "listItem", "codeBlock"])


def flatten_node(node) -> str:
    if isinstance(node, list):
        return "".join(map(flatten_node, node))
    if not isinstance(node, dict):
        return ""
    kind = node.get("type")
    leaf = {"text": lambda: node.get("text", ""), "mention": lambda: (node.get("attrs") or {}).get("text", ""), "hardBreak": lambda: "\n", "rule": lambda: "\n---\n"}.get(kind)
    if leaf:
        return leaf()
    return flatten_node(node.get("content") or []) + ("\n" if kind in LINE_NODES else "")
