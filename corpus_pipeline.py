"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every document that the stage before it kept, and calls one
operator of ``epistola.llm``. Stages but the last return the columns of ``documents``; n_chars follows the text.

toxicity: documents whose score reaches their language's threshold go.
line_dedup: lines that ten documents or more hold go from all of them; documents stay, if empty.
near_duplicates: of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, that with the smallest id stays.
decontamination: documents that hold ten consecutive words of a benchmark item, or all of a shorter item, go.
packing: what is left is tokenized and packed into sequences of 2048 tokens.

Nulls, empty texts, repeated rows, empty tables and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistola.llm.decontam import drop_contaminated
from epistola.llm.linededup import dedup_lines
from epistola.llm.ngramjoin import drop_near_copies
from epistola.llm.packing import pack_documents
from epistola.llm.runtime import bound_batches, fresh_name, materialize, table
from epistola.llm.toxicity import drop_toxic


#: Distinct chunks that packing remembers here: executors hold what all the stages before it have left.
REMEMBERED_CHUNKS = 100_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    counts = fresh_name(docs, "lines"), fresh_name(docs, "lines_dropped")
    out = dedup_lines(docs, "text", added=counts)
    n_chars = F.when(F.col(counts[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*(n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return pack_documents(docs, remembered=REMEMBERED_CHUNKS)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained scores and tokenization can't be expressed in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
