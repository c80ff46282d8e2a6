"""The corpus pipeline: five filters over documents, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from tallyframe.llm.common import durable, fields, free_name, table
from tallyframe.llm.queries import labelled

#: Documents of this toxicity score or more are rejected.
TOXIC = 0.5
#: Whole documents that a Python worker gets at once, at most; of Spark's 10,000 the JVM and the worker hold a copy each.
BATCH = 1_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def hand_over_few(spark: SparkSession) -> None:
    """From now on the session hands BATCH rows at most to a Python worker at once; a smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    spark.conf.set(setting, str(min(now, BATCH) if now > 0 else BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled documents of sf_dir."""
    hand_over_few(spark)
    name = free_name(docs, "score")
    scored = toxicity.score(docs, toxicity.fit(labelled(spark, sf_dir)), keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) < TOXIC).select(*fields(docs))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are boilerplate at their source; n_chars follows the text."""
    cleaned = line_dedup.drop_lines(docs).select(*fields(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    hand_over_few(spark)
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    hand_over_few(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, copies and taken."""
    return mixing.mix(docs, carry=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can express neither the classifier nor the classes of near-duplicates; tests compare stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
