"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``. Of rows that repeat an id the one with the least hash of its text stays after near-dedup; rows
without an id are told apart by their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.checkpoints import folder
from quadrille.llm.decontaminate import clean
from quadrille.llm.language_id import accepted, fit
from quadrille.llm.minhash import near_duplicates
from quadrille.llm.mixing import mix
from quadrille.llm.substring_dedup import remove_repeats
from quadrille.shipping import ship


_PLAIN = {"string", "byte", "short", "integer", "long", "float", "double", "decimal", "boolean", "date", "timestamp", "binary"}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is trained on a bounded sample of the labelled ones."""
    ship(spark)
    return accepted(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    ship(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    # rows without an id are known by their text, after all ids
    stand_in = F.lit(1 << 62) + F.xxhash64(text).bitwiseAND((1 << 61) - 1)
    rows = docs.toDF(*names).withColumn("key", F.coalesce(F.col(names[docs.columns.index("doc_id")]).cast("long"), stand_in))
    gone = near_duplicates(rows, k=5, percent=80, id_col="key", text_col=text).where("not kept").select("key").distinct()
    order = F.struct(F.xxhash64(text), F.xxhash64(*[f.name for f in rows.schema.fields if f.dataType.typeName() in _PLAIN]))
    one = rows.groupBy("key").agg(F.min_by(F.struct(*names), order).alias("row"))
    return one.join(gone, "key", "left_anti").select("row.*").toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur before are cut from the texts; n_chars follows."""
    ship(spark)
    cut = remove_repeats(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    ship(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, in the order of virtual finish times, with mix_copy and mix_finish."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

ORACLE_SQL = None  # trained, iterative and hashed stages; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}-{name}")
        docs = spark.read.parquet(f"{top}/{i}-{name}")
    return docs
