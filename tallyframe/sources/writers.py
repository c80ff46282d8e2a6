"""Sinks: tables, appended records, run logs, reports."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.operators.judgments import parts, remaining
from tallyframe.sources.readers import exists


def delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite", bom: bool = False) -> None:
    """Text table with a header in every part file; `bom` puts a byte-order mark before the first name."""
    names = df.toDF(*(("﻿" + c if bom and i == 0 else c) for i, c in enumerate(df.columns)))
    names.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def append(df: DataFrame, path: str) -> None:
    """Append as Parquet: files of a task appear whole or not at all, so no lock and no repair is needed."""
    df.write.mode("append").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Append the rows of which the path has no key yet, and return them; the way to resume."""
    spark = df.sparkSession
    if exists(spark, path):
        done = spark.read.schema(df.schema).parquet(path)
        df = remaining(df, [done], key, max(parts(df), parts(done)))
    append(df, path)
    return df


def run_log(spark: SparkSession, path: str, **event: Any) -> None:
    """One event as a JSON line in a file of its own."""
    line = json.dumps({"at": time.time(), **event}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def guarded(df: DataFrame, path: str, force: bool = False, dry_run: bool = False) -> str:
    """Write Parquet unless it is there; returns "written", "kept" or "dry run"."""
    if dry_run:
        return "dry run"
    if exists(df.sparkSession, path) and not force:
        return "kept"
    df.write.mode("overwrite").parquet(path)
    return "written"


def pretty_json(df: DataFrame, most: int = 10_000) -> str:
    """A small result as indented JSON; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as a table")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, default=str)


def markdown_table(df: DataFrame, title: str = "", most: int = 1000) -> str:
    """A small result as a Markdown table; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as a table")
    show = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"## {title}\n"] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(show, r)) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as one text file in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def evidence(df: DataFrame, by: list[str], line: str, order: str, limit: int = 300_000) -> DataFrame:
    """One evidence document per group, of its lines in order, cut at a limit with a note and a flag.

    Lines that start beyond the limit are left out before a group is gathered, so a document never
    holds much more than the limit.
    """
    rows = df.select(*by, F.col(order).alias("o_"), F.coalesce(F.col(line), F.lit("")).alias("t_"))
    upto = Window.partitionBy(*by).orderBy("o_", "t_").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from_", F.coalesce(F.sum(F.length("t_") + 1).over(upto), F.lit(0)))
    rows = rows.withColumn("t_", F.substring("t_", 1, limit + 1)).where(F.col("from_") <= limit)
    docs = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("o_", "t_"))).alias("x"))
    docs = docs.select(*by, F.array_join(F.transform("x", lambda r: r["t_"]), "\n").alias("body"))
    cut = F.length("body") > limit
    return docs.select(*by, F.when(cut, F.concat(F.substring("body", 1, limit), F.lit("\n[cut]"))).otherwise(F.col("body")).alias("document"), cut.alias("cut"))
