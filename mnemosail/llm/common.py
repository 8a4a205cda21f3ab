"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Shared folder of a session that names none and whose executors are threads of this process.
LOCAL_DIR = "file:///tmp/checkpoints"
MASK64 = (1 << 64) - 1


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_DIR).rstrip("/")


def materialize(df: DataFrame, tag: str, share: int = 1, seen: Column | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor. Used where a table
    is read more than once or an iteration would otherwise grow its plan. The
    table is deleted when the application ends, or before by ``discard``.

    share: tables of narrow rows are written by one task for so many shuffle
    partitions; many tiny files cost more than they hold.

    seen: an aggregate of the rows, taken while they are written; ``table_seen``
    of the result has it. Asking the table afterwards would be a further job.
    """
    spark = session(df)
    if share > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // share))
    if seen is not None:
        noted = Observation()
        df = df.observe(noted, seen.alias("seen"))
    path = f"{shared_dir(spark)}/mnemosail/{tag}-{uuid.uuid4().hex}"
    place, fs = _filesystem(spark, path)
    fs.deleteOnExit(place)
    _WRITTEN.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    if seen is not None:
        out.table_seen = noted.get["seen"]
    return out


#: Tables that this process has written and not deleted.
_WRITTEN: list[str] = []


def _filesystem(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written() -> int:
    """A mark for ``discard``."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables that ``materialize`` wrote after a mark, but for those in ``keep``."""
    kept = {k.table_path for k in keep}
    gone = [p for p in _WRITTEN[since:] if p not in kept]
    _WRITTEN[since:] = [p for p in _WRITTEN[since:] if p in kept]
    for path in gone:
        place, fs = _filesystem(spark, path)
        fs.delete(place, True)


def stable(df: DataFrame, tag: str) -> DataFrame:
    """``df`` itself if a task that runs again gets the same rows in the same order (it projects or filters files), else written and read back."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().split(" ")[0] not in ("Project", "Filter", "Relation", "LogicalRelation"):
            return materialize(df, tag)
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id, m: int):
    """crc32 of the decimal text of an id, modulo ``m`` (null stays null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


class Memo(dict):
    """A dict that computes missing values and is emptied when it grows past ``limit``.

    ``trim`` is called between documents, so one document's lookups stay valid.
    """

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def word_memo(limit: int = 400_000) -> Memo:
    """Word (UTF-8 bytes) to 64-bit hash."""
    return Memo(xxhash.xxh3_64_intdigest, limit)


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix64(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15, mixed: bool = True) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes.

    A polynomial in an odd 64-bit base evaluated by Horner's rule over prefix
    positions, each step one vector operation, then mixed. Without mixing the
    hashes of words should fill their high bits, and so do those of runs.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(seed | 1)
    z, width, powers = mix64(h + np.uint64(seed & 0xFFFF)) if mixed else h, 1, base
    # doubling: z holds runs of ``width`` words; join two runs to get twice that
    parts: list[tuple[int, np.ndarray, np.uint64]] = [(1, z, powers)]
    with np.errstate(over="ignore"):
        while width * 2 <= n:
            z = z[:-width] * powers + z[width:]
            powers = powers * powers
            width *= 2
            parts.append((width, z, powers))
        out, done = None, 0
        for width, z, power in reversed(parts):
            if n - done >= width:
                piece = z[done : done + m]
                out = piece if out is None else out * power + piece
                done += width
        return mix64(out) if mixed else out


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` neighbours (or the one run of all, if fewer) the place of its leftmost smallest hash.

    The position sits in the low bits of each hash, so minima are unique and
    name their own place; 24 bits suit texts of up to 16 million words, and
    longer ones take as many as they need.
    """
    m = len(h)
    if m == 0:
        return np.empty(0, np.int64)
    bits = np.uint64(max(24, m.bit_length()))
    lo = ((h >> bits) << bits) | np.arange(m, dtype=np.uint64)
    w, width = min(w, m), 1
    while width * 2 <= w:
        lo = np.minimum(lo[:-width], lo[width:])
        width *= 2
    n = m - w + 1
    least = np.minimum(lo[:n], lo[w - width : w - width + n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals, sorted."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
