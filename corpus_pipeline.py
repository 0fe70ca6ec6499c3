"""A training-corpus pipeline over the table documents: five stages, each the operator of that name.

Every stage takes the documents its predecessor kept and returns them with the columns of documents (n_chars
follows the text); the last adds the mix's columns. Rows rejected: texts that the quality model, learned from the
labelled rows among the stage's own documents, scores under 0.5; near copies (one document of each group stays); texts
that hold a benchmark item; and documents that the mix takes no copy of.

Defined cases: null and empty texts are scored like any other text, hold no line and no benchmark item, are near copies
of each other (one of them stays), and the mix takes no copy of them, as their size is 0; a null doc_id is larger than
all others and is never held out; a null source is a source; repeated rows become one; an empty table gives no rows;
very long texts are worked on whole, a megabyte at a time; columns beside those of documents are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm import decontaminate, lines, mixing, quality, simhash
from citelake.llm.common import shared_folder, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, "_score").filter("_score >= 0.5").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines that stand on many sources."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return simhash.drop_near_copies(docs).select(*COLUMNS)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken."""
    return mixing.mix_sources(docs).filter("copies > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("near-dedup", copies_stage),
    ("decontamination", leaks_stage),
    ("mixing", mix_stage),
]

#: The quality model, the fingerprints and the alignment are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet in the shared folder and read again."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
