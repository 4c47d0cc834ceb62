"""From raw documents to training tokens: five stages, each an operator of parchmint.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the shared
folder and reads them back as the next stage's docs, and deletes what the stage before wrote.

Documents with a null or empty text, or one without words, fail the first stage's base rule. Ids may repeat or be null.
Columns beyond those that a stage names are carried along, whatever they are called. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm import bpe, decontaminate, jaccard, rules, secrets
from parchmint.llm.common import delete, read, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or that the rules' model finds bad, go. Equal texts are judged alike; rows that repeat stay."""
    return rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar five-word shingle sets (0.8 or more) connect, that with the least doc_id stays.

    Of rows that repeat one stays; an id with several texts is judged text by text; rows without an id, or without
    words, stay.
    """
    return jaccard.keep_first(docs, jaccard.Similarity(words=5, num=4, den=5))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. A null text holds none."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are overwritten in the text; copied examples stay, and so does every document.

    A column n_chars, where there is one, is kept up with the text. A null text stays null.
    """
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids take the text's place. A null text gives an empty list."""
    return bpe.add_token_ids(docs, *bpe.default_ranks())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_redaction", secret_redaction),
    ("byte_bpe", byte_bpe),
]

#: Expectation-maximisation, link components and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, of the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
