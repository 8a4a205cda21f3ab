"""Training-corpus pipeline: ``documents`` to packed sequences.

Each stage reads the Parquet that the one before it wrote. Toxic documents are
dropped, one document of each near-duplicate group stays, later copies of
passages of 50 words are cut from the texts, documents that hold benchmark
items are dropped, and the rest is packed. A text that lost all its words stays as an
empty document, so that no stage removes what it does not judge.

Null and empty texts are kept: they are not toxic, are near copies of nothing, hold no passage and no benchmark item,
and are packed as their end id alone. Rows without an id are judged by their text like others; as copies they give way to
rows with one, and they are packed under null. Rows that repeat an id and a text are one row after the near-duplicate
stage; of texts that tie as copies the one with the smallest id stays. Null labels teach nothing, null benchmark items match nothing. Empty tables
give empty results. Further columns travel along unchanged up to the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosail.llm import decontam, minhash, packing, suffix_dedup, toxicity
from mnemosail.llm.common import crc_mod, discard, materialize, read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = toxicity.labelled_rows(docs, read_table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return toxicity.drop_toxic(docs, toxicity.fit_rows(sample), 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_near_duplicates(docs, minhash.Config(words=5, percent=80))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs, length=50)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: Stages train a model and follow links, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the ``documents`` of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    mark = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(spark, mark, docs)  # what the stages before left is not read again
    return STAGES[-1][1](spark, docs, sf_dir)
