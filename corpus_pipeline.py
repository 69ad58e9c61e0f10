"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Toxic documents are rejected; repeated lines are cut from the texts, the first occurrence
stays; of each group of near copies one document stays; benchmark passages are cut from
the texts; the last stage encodes what is left. All but the last return the columns of
`documents`, with n_chars kept in step with the text. A document whose text becomes empty
stays a row until the near-copy stage, for which all empty texts are copies of each other.

Odd rows, in every stage: a null text is an empty one (the line and benchmark stages leave it
null); null ids are ordered first and keep their rows, but for copies; whole texts of any
length are read; columns beyond those of `documents` pass through whatever their names, up to
the last stage; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismata.llm import bpe, decontaminate, lines, near_copies, toxicity
from prismata.llm.common import crc_mod, table
from prismata.llm.queries import tokenizer_path
from prismata.operators.checkpoints import shared_folder

#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the present text, where the table has such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    size: Column = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return docs.withColumn("n_chars", size.cast(kind))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under TOXIC; equal texts score alike, an empty or null text as clean."""
    name = "_toxic"
    while name in docs.columns:
        name += "_"
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), "toxic", crc_mod("doc_id", 3) == 1, name=name)
    return scored.where(F.col(name) < TOXIC).drop(name)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that repeat an earlier one by (id, line); repeated rows are cut alike."""
    return _sized(lines.dedup(docs))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: all its rows, if the id repeats; null ids stay."""
    return near_copies.kept(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages of the benchmark; null items have none."""
    return _sized(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source as far as the table has them, n_tokens, ids and the decoded text; a null text has no ids."""
    named = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.encode(docs, tokenizer_path()).select(*named, "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near copies", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("encoding", encoding_stage),
]

#: The first stage learns a model and later ones build on what it keeps: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; intermediate tables go to the shared folder."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            _removed(spark, f"{at}/{k - 1}")
    return docs


def _removed(spark: SparkSession, folder: str) -> None:
    """A stage's table is not needed once the next one is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
