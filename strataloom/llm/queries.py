"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import audit, merkle, mixing, urlfilter
from strataloom.llm.common import table


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file on this machine; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.langid import fit, predict

    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.urlfilter import judge

    return judge(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.secrets import digests

    return digests(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.tokenpack import pack_and_read

    return pack_and_read(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.minhash import edited

    return edited(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.licenses import find

    return find(table(spark, sf_dir, "documents"))


def op10_pseudolikelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataloom.llm.pseudolikelihood import fit_and_score

    return fit_and_score(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_token_pack": op7_token_pack,
    "op8_minhash": op8_minhash,
    "op9_licenses": op9_licenses,
    "op10_pseudolikelihood": op10_pseudolikelihood,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mix": op13_source_mix,
}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {"op4_url_filter": urlfilter.oracle(), "op11_filter_audit": audit.oracle(), "op12_merkle_manifest": merkle.oracle(), "op13_source_mix": mixing.oracle()}
