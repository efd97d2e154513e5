"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.language_id import fit, predict

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = predict(docs, fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.substring_dedup import passages

    return passages(_table(spark, sf_dir, "documents"), window=20)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.mixing import mix_counts

    return mix_counts(_table(spark, sf_dir, "documents"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.context_tree import scores

    return scores(_table(spark, sf_dir, "documents"), lambda i: F.crc32(i.cast("string").cast("binary")) % 5 != 1)


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.mpeg_audio import digest

    return digest(_table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.url_rules import judge

    labels = _table(spark, sf_dir, "labels").selectExpr("doc_id as id", "toxic = 1 as blocked")
    return judge(_table(spark, sf_dir, "pages"), labels)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quadrille.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_language_id, op3_substring_dedup, op4_mixing, op5_context_tree, op6_mpeg_audio, op7_url_rules, op8_html_extraction, op9_decontamination, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    from quadrille.llm.mixing import MIX_SQL

    return {"op4_mixing": MIX_SQL}
