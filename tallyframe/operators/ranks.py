"""Rank statistics without a global sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.operators.judgments import tally
from tallyframe.operators.ordering import running_total
from tallyframe.storage import durable


def rank_table(counts: DataFrame, value: str, n: str, name: str) -> DataFrame:
    """Average rank of each value, of a table with a row per value and how often it occurs; ties share the mean place."""
    ranks = running_total(counts, value, n, "upto_")
    return ranks.select(value, (F.col("upto_") - (F.col(n) - 1) / 2).alias(name))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average rank of a value; ties share the mean of their places, null has none.

    Rows are counted per distinct value first, and the values are added up range by range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n_"))
    return df.join(rank_table(counts, value, "n_", name), value, "left")


def auc(df: DataFrame, value: str, positive: Column, weight: str | None = None) -> DataFrame:
    """Chance that a positive's value exceeds another's, ties counting half; null without both classes.

    Rows are counted per value and class first; ranks are those of the values. With `weight`, a row
    counts as often as that column says.
    """
    rows = df.where(F.col(value).isNotNull() & positive.isNotNull())
    counts = rows.groupBy(value).agg(tally(positive, weight).alias("pos_"), tally(F.lit(True), weight).alias("n_"))
    ranks = running_total(counts, value, "n_", "upto_")
    rank = F.col("upto_") - (F.col("n_") - 1) / 2
    sums = ranks.agg(F.sum("pos_").alias("n_pos"), F.sum(F.col("n_") - F.col("pos_")).alias("n_neg"), F.sum(rank * F.col("pos_")).alias("s_"))
    sums = sums.select(F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"), "s_")
    n, m = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    value_ = F.when((n > 0) & (m > 0), (F.col("s_") - n * (n + 1) / 2) / F.nullif(n * m, F.lit(0.0)))
    return sums.select("n_pos", "n_neg", value_.alias("auc"))


def pearson(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Correlation of two columns; null below three pairs or without variance. A weighted row counts as often as its weight."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if weight is not None:
        a, b, w = F.col(x).cast("double"), F.col(y).cast("double"), F.col(weight)
        means = rows.agg(F.coalesce(F.sum(w), F.lit(0)).alias("n"), (F.sum(w * a) / F.sum(w)).alias("mx"), (F.sum(w * b) / F.sum(w)).alias("my"))
        u, v = a - F.col("mx"), b - F.col("my")
        sums = rows.crossJoin(F.broadcast(means)).agg(F.first("n").alias("k"), F.sum(w * u * v).alias("uv"), F.sum(w * u * u).alias("uu"), F.sum(w * v * v).alias("vv"), F.min(x) != F.max(x), F.min(y) != F.max(y)).toDF("k", "uv", "uu", "vv", "vx", "vy")
        r = F.when((F.col("k") >= 3) & F.col("vx") & F.col("vy"), F.try_divide("uv", F.sqrt(F.col("uu") * F.col("vv"))))
        return sums.select(F.coalesce("k", F.lit(0)).alias("n"), r.alias("r"))
    sums = rows.agg(F.count("*").alias("n"), stats.correlation(x, y).alias("r"), F.min(x) != F.max(x), F.min(y) != F.max(y)).toDF("n", "r", "vx", "vy")
    return sums.select("n", F.when((F.col("n") >= 3) & F.col("vx") & F.col("vy"), F.col("r")).alias("r"))


def spearman(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Pearson's correlation of average ranks; null below three pairs or without variance.

    Pairs of values are counted once; ranks and their products come from the counts. The mean rank
    is half the number of pairs and a half.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x_"), F.col(y).alias("y_")).agg(tally(F.lit(True), weight).alias("w_"))
    pairs = durable(pairs)
    for c in ("x_", "y_"):
        pairs = pairs.join(rank_table(pairs.groupBy(c).agg(F.sum("w_").alias("n_")), c, "n_", f"r{c}"), c)
    n = pairs.agg(F.coalesce(F.sum("w_"), F.lit(0)).alias("n"))
    a, b, w = F.col("rx_") - (F.col("n") + 1) / 2, F.col("ry_") - (F.col("n") + 1) / 2, F.col("w_")
    sums = pairs.crossJoin(F.broadcast(n)).agg(F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    r = F.when(F.col("n") >= 3, F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))))
    return n.crossJoin(F.broadcast(sums)).select("n", r.alias("r"))
