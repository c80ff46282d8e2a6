"""Joins that attach attributes: first row per key, strict, with defaults."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.stats import col
from tallyframe.operators.judgments import dedupe


def attach(df: DataFrame, attributes: DataFrame, key: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """df with the attributes of each key's first (or last) row; null where there is none."""
    return df.join(dedupe(attributes, key, order, keep).drop(*(c for c in order if c in df.columns and c not in key)), key, "left")


def strict(df: DataFrame, attributes: DataFrame, key: list[str]) -> DataFrame:
    """df with the attributes; a key without them is an error when it is met."""
    known = attributes.withColumn("known_", F.lit(True))
    rows = df.join(known, key, "left")
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in key))
    check = F.when(F.col("known_").isNull(), F.raise_error(F.concat(F.lit("no attributes for "), name)).cast("boolean")).otherwise(F.col("known_"))
    return rows.withColumn("known_", check).where("known_").drop("known_")


def lookup(df: DataFrame, values: DataFrame, key: list[str], defaults: dict[str, Any]) -> DataFrame:
    """df with columns of a dimension, and the given values where it has no row or a null."""
    rows = df.join(values.select(*key, *defaults), key, "left")
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def cell(marker: Column | str, positive: Column, target: str, names: tuple[str, str, str, str] = ("I", "II", "III", "IV")) -> Column:
    """Cell of marker and decision: target positive, target other, rest positive, rest other."""
    is_target = F.coalesce(col(marker) == target, F.lit(False))
    return F.when(is_target & positive, names[0]).when(is_target, names[1]).when(positive, names[2]).otherwise(names[3])


def parallel(first: Column | str, second: Column | str, sep: str = " ||| ") -> Column:
    """Two texts side by side."""
    return F.concat_ws(sep, F.coalesce(col(first), F.lit("")), F.coalesce(col(second), F.lit("")))


def out_of_scope(book: Column | str, prefix: str, last: int) -> Column:
    """Whether a name is the prefix with a number above `last`."""
    number = F.regexp_extract(col(book), rf"^{prefix}.*?([0-9]+)$", 1).try_cast("int")
    return F.coalesce(col(book).startswith(prefix) & (number > last), F.lit(False))


def drop_foreign(df: DataFrame, refs: str, own: Column | str, names: list[str]) -> DataFrame:
    """Rows none of whose references holds the name of another category; null references stay."""
    foreign = F.exists(F.coalesce(F.col(refs), F.array().cast("array<string>")), lambda r: F.exists(F.array(*map(F.lit, names)), lambda n: r.contains(n) & (n != col(own))))
    return df.where(~foreign)
