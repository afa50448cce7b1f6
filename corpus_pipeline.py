"""Corpus pipeline over the table documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and reread as the next stage's docs. All but the last return the
columns of documents:

1. language_id: rows whose language the nearest-centroid model rejects go;
2. simhash_dedup: of each component of near-duplicates the row of least doc_id stays;
3. decontaminate: rows that contain a benchmark item (substitutions tolerated) go;
4. secret_scan: secrets in the texts are replaced by their kind in angle brackets;
5. byte_bpe: each row's token ids, with the digests that decoding them gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import bpe, decontaminate, langid, secrets, simhash_similar
from strataloom.llm.common import table
from strataloom.llm.queries import tokenizer_file
from strataloom.session import shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # shingles of five words and an exact likeness of 0.8: the rule for near-duplicate stages on word shingles
    return simhash_similar.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # smaller tables than the query's: workers here also hold what earlier stages left
    return bpe.digests(docs, tokenizer_file("byte_bpe_50k.tiktoken"), states=120_000, words=120_000)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminated),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
