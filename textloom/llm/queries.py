"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rules

    return rules(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_tokens

    return pack_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import encode_digests

    return encode_digests(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import group

    return group(documents(spark, sf_dir), shingle=4, threshold=80)


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import digests

    return digests(documents(spark, sf_dir))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent import score

    return score(documents(spark, sf_dir))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_labels import classify

    return classify(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_all

    return predict_all(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(documents(spark, sf_dir))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import records
    from .spark import scratch

    folder = scratch(spark, "records")
    return records.read(records.write(documents(spark, sf_dir), folder, tokenizer_path("byte_bpe_50k.json")), folder)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_sentencepiece, op4_near_dup, op5_audio_features, op6_lm_scores, op7_weak_quality, op8_language_id, op9_license_scan, op10_token_records)}
def _oracle_sql() -> dict[str, str]:
    from .licenses import scan_sql

    return {"op9_license_scan": scan_sql()}


ORACLE_SQL = _oracle_sql()
