"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Counts as part of wardline.llm. Each stage takes (spark, docs, sf_dir); all but
the last return the columns of documents. run() writes each stage as Parquet in
the shared checkpoint folder and reads it again as the next one's docs; a stage
before the last two is deleted. A run that is given a folder resumes there
after its last finished stage.

Defined results: documents of null, empty or letterless text go in the first
stage; of rows that repeat doc_id and text one stays (third stage); rows that
only share a doc_id, or have none, are kept apart; texts may have any length;
further columns of documents, whatever their names, stay up to the fourth
stage; of a group of near copies the smallest doc_id stays, a null one before
all (ties: the smaller text hash); an empty table gives no piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import decontamination, language_id, line_dedup, packing, simhash
from wardline.llm.common import shared_dir, table
from wardline.llm.queries import tokenizer_file
from wardline.plans.runner import exists


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; rejected ones go."""
    return language_id.keep_identified(docs)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that at least five documents share, except in the last of these; n_chars follows the text."""
    kept = line_dedup.line_dedup_rows(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each SimHash group, once."""
    return simhash.keep_first(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences."""
    rows = packing.pack_documents(docs, tokenizer_file())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", identified), ("line_dedup", lines_once), ("simhash_near_dedup", one_of_each), ("decontamination", unseen), ("packing", packed)]

#: SQL expresses neither the classifier nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """The rows of the last stage. base: a folder that executors and driver share, where an earlier run of the same documents is taken up."""
    base = base or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    at = [f"{base}/{name}" for name, _ in STAGES]
    done = max((i for i, out in enumerate(at) if exists(spark, f"{out}/_SUCCESS")), default=-1)
    for i, (_, stage) in enumerate(STAGES):
        if i <= done:
            continue
        docs = spark.read.parquet(at[i - 1]) if i else table(spark, sf_dir, "documents")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at[i])
        if i > 1:
            remove(spark, at[i - 2])
    if len(at) > 1:
        remove(spark, at[-2])
    return spark.read.parquet(at[-1])
