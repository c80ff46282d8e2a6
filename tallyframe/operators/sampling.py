"""Samples that do not depend on partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ordering import numbered


def stride(df: DataFrame, k: int, order: list[str], by: list[str]) -> DataFrame:
    """Every max(1, n // k)-th row of each group in order, k at most; groups are numbered range by range."""
    rows = numbered(df, order, tuple(by), "at_")
    sizes = rows.groupBy(*(F.col(c).alias(f"{c}_of_") for c in by)).agg(F.count("*").alias("n_"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_of_")) for c in by], F.lit(True))
    step = F.greatest(F.lit(1), F.floor(F.col("n_") / k))
    return rows.join(sizes, same).where(F.col("at_") % step == 0).where(F.col("at_") / step < k).select(*df.columns)


def first_k(df: DataFrame, k: int, order: list[str], by: list[str], name: str = "place") -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def hashed(df: DataFrame, k: int, key: list[str], seed: int) -> DataFrame:
    """k rows at random without replacement, the same for a seed whatever the partitioning."""
    return df.orderBy(drawn(key, seed), *key).limit(k)


def pooled(df: DataFrame, k: int, key: list[str], seed: int) -> DataFrame:
    """hashed(), or an error if the pool has fewer than k rows."""
    if (n := df.limit(k).count()) < k:
        raise ValueError(f"{k} rows are asked for, the pool has {n}")
    return hashed(df, k, key, seed)


def drawn(key: list[str], seed: int) -> Column:
    """A random order that a seed fixes: MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)))


def shuffled(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """All rows in an order that a seed fixes."""
    return df.orderBy(drawn(key, seed), *key)


def by_group(df: DataFrame, k: int, key: list[str], by: list[str], seed: int) -> DataFrame:
    """Up to k random rows of each group."""
    w = Window.partitionBy(*by).orderBy(drawn(key, seed), *key)
    return df.withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= k).drop("place_")


def by_category(df: DataFrame, k: int, key: list[str], category: str, seed: int, split: Column | None = None) -> DataFrame:
    """Up to k random rows of each category, or of either side of a condition in each, with the size of their pool."""
    rows = df if split is None else df.withColumn("side", F.coalesce(split, F.lit(False)))
    by = [category] if split is None else [category, "side"]
    pools_ = rows.groupBy(*by).agg(F.count("*").alias("pool"))
    return by_group(rows, k, key, by, seed).join(pools_, by)


def spread(df: DataFrame, total: int, per_group: int, key: list[str], group: str, seed: int) -> DataFrame:
    """`total` random rows of which a group gives at most `per_group`."""
    return hashed(by_group(df, per_group, key, [group], seed), total, key, seed)


def by_ids(df: DataFrame, ids: list[str], key: list[str], sep: str = "/") -> DataFrame:
    """Rows whose key columns, joined by a separator, are listed."""
    return df.where(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)).isin(list(ids)))


def override(df: DataFrame, manifest: DataFrame | None, key: list[str], kind: str, values: dict[str, Column]) -> dict[str, DataFrame]:
    """Subsets of df by name: those of a manifest's rows of that kind if there is a manifest, else those of a condition."""
    if manifest is None:
        return {name: df.where(condition) for name, condition in values.items()}
    return {name: replay(df, manifest.where(F.col(kind) == name), key) for name in values}


def replay(df: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """Exactly the rows that a manifest lists: the way to repeat a sample drawn elsewhere."""
    return df.join(manifest.select(*key).distinct(), key, "left_semi")


def pools(df: DataFrame, arm: str, kind: Column) -> DataFrame:
    """Sizes of the pools of arm and class from which examples are drawn."""
    return df.groupBy(arm, kind.alias("kind")).agg(F.count("*").alias("n"))


def examples(df: DataFrame, by: list[str], group: str, key: list[str], seed: int, total: int = 10, per_group: int = 2) -> DataFrame:
    """Candidates for examples of each pool: by, group, key, place (from 1) and pool, the pool's size.

    Up to `per_group` random rows of each group of a pool, groups in the order of their least key, until
    there are `total`.
    """
    pool = df.groupBy(*by).agg(F.count("*").alias("pool"))
    ranked = df.groupBy(*by, group).agg(F.min(F.struct(*key)).alias("first_"))
    within = Window.partitionBy(*by, group).orderBy(drawn(key, seed), *key)
    rows = df.select(*by, group, *key).withColumn("draw_", F.row_number().over(within)).where(F.col("draw_") <= per_group)
    # Pools are narrowed to their first groups before they are put in order.
    some = Window.partitionBy(*by).orderBy("first_", group)
    ranked = ranked.withColumn("rank_", F.row_number().over(some)).where(F.col("rank_") <= total)
    rows = rows.join(ranked.drop("first_"), [*by, group])
    order = Window.partitionBy(*by).orderBy("rank_", "draw_")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= total)
    return rows.join(pool, by).select(*by, group, *key, "place", "pool")
