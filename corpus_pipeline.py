"""The corpus pipeline: toxicity, near-duplicates, benchmark contamination, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the next one's documents. All but the last return the columns of documents, whatever further ones
there are and whatever their names. An empty table stays empty; null texts count as empty and stay null; very
long texts are read whole; repeated rows are judged alike, and of rows that repeat an id the second stage keeps one.
Rows without an id are judged by their texts, and no other row makes them go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.llm import contamination, lattice, near, pii, toxicity
from brookline.llm.queries import tokenizer_path
from brookline.llm.shared import Scratch, bounded, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from all labelled documents of the input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", F.lit(True))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 over shingles of five words, the one with the smallest id stays."""
    bounded(spark)
    return near.drop_near_duplicates(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, and whether they decode to its text, beside its columns."""
    bounded(spark)
    return lattice.encode_documents(docs, tokenizer_path(), keep=True, decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("sentencepiece", encode),
]

#: Trained scores, sketches and pieces aren't expressible in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
