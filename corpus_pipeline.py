"""A corpus pipeline over ``documents``: toxicity, SimHash near-duplicates, decontamination, secrets, byte-level BPE.

Each stage works on the whole output of the stage before, read again from Parquet. A stage drops or changes rows by its own
decisions only; all but the last return the columns of ``documents``. Null and empty texts pass every stage (toxicity never rejects
them; as near-duplicates they are one group); rows with a null id are rows like any other; of rows with equal id and text in one
group one stays; an empty table gives an empty one; columns beyond those of ``documents`` are carried through all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from segspark.llm.common import new_folder, remove, scratch, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on their labels, doesn't call toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the least id, of each component of near-duplicates."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document."""
    found = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(found, keep=["ids"])


STAGES = [("toxicity", without_toxic), ("simhash", one_of_each_group), ("decontamination", without_benchmark), ("secrets", without_secrets), ("bpe", encoded)]

#: Toxicity and lexing can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What passes between stages is written to the shared folder of the session; each stage's tables go
    when the next has been written, and only the last of them, which the result reads, stays until ``common.clear``."""
    docs, past = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        if past:
            remove(spark, past)
        docs, past = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
