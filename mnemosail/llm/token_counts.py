"""Token counts without tokenizing each text.

Pieces are counted once per distinct pre-token of the corpus; a document's
count is the sum over its pre-token frequencies. Ids are never materialised.

A pre-token is what lies between places that no piece of the model can span:
a blank (or the meta symbol U+2581, which the model treats as one) after a
non-blank. ``check_model`` proves this for the model in use.

1. Each partition counts its distinct pre-tokens; the counts are summed over the
   corpus and every distinct pre-token is encoded once (``piece_counts``).
2. The most frequent ones (``head`` of them, and ``head_bytes`` bytes, at most, so the broadcast is bounded)
   are looked up while documents are read; the rest of each document's frequency
   table is joined to the piece counts by a shuffle.

Pre-tokens of more than ``longest`` characters (text without blanks) are encoded where they stand: they hardly
repeat, and as keys would take whole texts through the shuffles.

Nulls count as empty text; empty text has 0 tokens; a null id stays null; each
input row gives one output row, also for repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from .common import materialize, session, stable

META = "▁"
SEGMENT = re.compile(r" ( *[^ ]+| *\Z)")
MODEL = "piece_bpe_32k.model"


def load_model(name: str = MODEL):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


def check_model(name: str = MODEL) -> None:
    """Raise unless counts of this model may be summed over pre-tokens."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, m = load_model(name), pb.ModelProto()
    m.ParseFromString(model.serialized_model_proto())
    norm = m.normalizer_spec
    plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if not plain or norm.precompiled_charsmap or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{name}: its normalizer looks across blanks")
    bad = [p.piece for p in m.pieces if p.piece.lstrip(META).find(META) >= 0 or p.type == 4]
    if bad:
        raise ValueError(f"{name}: pieces span a blank: {bad[:5]}")


def pretokens(text: str) -> list[str]:
    """Pre-tokens, each without its first blank (the encoder puts it back)."""
    if not text:
        return []
    if META in text:
        text = text.replace(META, " ")
    parts = text.split(" ")
    return SEGMENT.findall(" " + text) if "" in parts else parts


def short(parts: list[str], longest: int) -> list[str]:
    return parts if len(max(parts, key=len, default="")) <= longest else [w for w in parts if len(w) <= longest]


def piece_counts(docs: DataFrame, text: str = "text", model: str = MODEL, flush: int = 400_000, flush_chars: int = 1 << 26, longest: int = 512) -> DataFrame:
    """(pretoken, n, pieces): each distinct pre-token of ``longest`` characters or fewer, its frequency and its pieces.

    A task hands on what it holds when it has read ``flush_chars`` characters or has ``flush`` pre-tokens.
    """

    def distinct(batches):
        seen: Counter = Counter()
        read = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(short(pretokens(t), longest))
                    read += len(t)
                    if len(seen) > flush or read > flush_chars:
                        yield out()
                        seen.clear()
                        read = 0
        if seen:
            yield out()

    def encode(batches):
        sp = load_model(model)
        for b in batches:
            words = b.column(0).to_pylist()
            pieces = [len(x) if w else 1 for w, x in zip(words, sp.encode(words, num_threads=1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces, pa.int64())], ["pretoken", "n", "pieces"])

    counted = docs.select(text).mapInArrow(distinct, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "pretoken string, n long, pieces long")


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, head: int = 300_000, head_bytes: int = 1 << 24, longest: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of ``docs``."""
    check_model(model)
    spark = session(docs)
    small_batches(spark)
    # rows are numbered as they are read
    docs = stable(docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")), "texts")
    pieces = materialize(piece_counts(docs, "_text", model, longest=longest), "pieces")
    # frequencies fall into some thousand classes; the most frequent ones that make up ``head`` at most are the head
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = pieces.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.octet_length("pretoken") + 40).alias("bytes")).collect()
    least, total, weight = (1 << 30), 0, 0
    for k, n, size in sorted(sizes, reverse=True):
        total, weight = total + n, weight + size
        if total > head or weight > head_bytes + 40 * head:
            break
        least = k
    top = pieces.where(level >= least).select("pretoken", "pieces").toArrow()
    table = spark.sparkContext.broadcast(dict(zip(top["pretoken"].to_pylist(), top["pieces"].to_pylist(), strict=True)))
    del top

    def frequencies(batches):
        known, row = table.value, TaskContext.get().partitionId() << 40
        get, sp = known.get, None
        for b in batches:
            rid, ids, size, word, count = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total = 0
                for w, n in Counter(pretokens(t or "")).items():
                    p = get(w)
                    if p is None and len(w) > longest:
                        sp = sp or load_model(model)
                        p = len(sp.encode(w, num_threads=1))
                    if p is None:
                        rid.append(row), ids.append(None), size.append(None), word.append(w), count.append(n)
                    else:
                        total += n * p
                rid.append(row), ids.append(i), size.append(len((t or "").encode())), word.append(None), count.append(total)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(word, pa.string()), pa.array(count, pa.int64())], ["rid", "id", "n_bytes", "pretoken", "n"])

    rows = docs.mapInArrow(frequencies, "rid long, id long, n_bytes long, pretoken string, n long")
    # rows without a pre-token carry the looked-up sum; left joins keep them, and nulls never meet in one task
    rare = pieces.select(F.col("pretoken").alias("p"), "pieces")
    joined = rows.withColumn("p", F.coalesce("pretoken", F.concat(F.lit(" \x00"), F.col("rid").cast("string")))).join(rare, "p", "left")
    tokens = F.sum(F.col("n") * F.when(F.col("pretoken").isNull(), F.lit(1)).otherwise(F.col("pieces")))
    return joined.groupBy("rid").agg(F.max("id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens")).drop("rid")
