"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    collocations,
    decontaminate,
    language,
    licenses,
    line_dedup,
    mixing,
    nearest,
    passages,
    secrets,
    simhash,
    token_counts,
    toxicity,
    variants,
)
from tallyframe.llm.common import table
from tallyframe.llm.oracles import ORACLES
from tallyframe.registry import Registry

REGISTRY = Registry()
#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries of the operators, and the pipeline."""
    import corpus_pipeline

    return REGISTRY.queries | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Their SQL, where SQL can express them."""
    import corpus_pipeline

    return REGISTRY.oracles | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def _remainder(divisor: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@REGISTRY.add("op1_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


@REGISTRY.add("op2_source_mixing", ORACLES["op2"])
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@REGISTRY.add("op3_line_dedup", ORACLES["op3"])
def line_dedup_(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs)


@REGISTRY.add("op4_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@REGISTRY.add("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = language.dictionaries(docs.where(_remainder(4) != 2).select("doc_id", "text", "lang"))
    held = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return language.identify(docs.select("doc_id", held, "text"), content, keep=("doc_id", "held_out"))


@REGISTRY.add("op6_nearest_neighbours", ORACLES["op6"])
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@REGISTRY.add("op7_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@REGISTRY.add("op8_token_counts")
def token_counts_(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = token_counts.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), ranks)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and label of a bounded sample of the rows that toxicity may be learned from."""
    learn = _remainder(5) != 0
    labels = table(spark, sf_dir, "labels").where(learn).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.labelled_sample(table(spark, sf_dir, "documents").where(learn).select("doc_id", "text"), labels)


@REGISTRY.add("op9_toxicity")
def toxicity_(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.fit(labelled(spark, sf_dir))
    held = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", held, "text")
    scored = toxicity.score(docs, model, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@REGISTRY.add("op10_decontamination", ORACLES["op10"])
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@REGISTRY.add("op11_license_scan", ORACLES["op11"])
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


@REGISTRY.add("op12_spelling_variants", ORACLES["op12"])
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


@REGISTRY.add("op13_collocations", ORACLES["op13"])
def collocations_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
