"""Shared helpers: word rules, durable tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.storage import durable

#: A word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Narrow rows (two numbers at most) that may be broadcast: some 100 MB in memory.
BROADCAST_ROWS = 2_000_000


def checked(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has no more than `most`.

    A join with it then leaves wide rows where they are; with more rows it is a shuffle, and the
    result is the same.
    """
    return F.broadcast(rows) if rows.count() <= most else rows


def unique_nodes(texts: DataFrame) -> DataFrame:
    """texts, a table with a row per pair of hashes h and g, with a number of its own for each: node.

    That is h, but for texts that are unlike and share h by chance: of these, all but one get a hash of both.
    """
    least = texts.groupBy("h").agg(F.min("g").alias("least_g"), F.count("*").alias("n_g")).where("n_g > 1").drop("n_g")
    rows = texts.join(checked(durable(least)), "h", "left")
    node = F.when(F.coalesce(F.col("g") != F.col("least_g"), F.lit(False)), F.xxhash64("h", "g")).otherwise(F.col("h"))
    return durable(rows.withColumn("node", node).drop("least_g"))


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quoted(name: str) -> str:
    """A column's name as an expression reads it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def fields(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not use yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node: (node, root) for every node with an edge.

    edges has long columns a and b, in any direction, repeats and loops allowed. Large-star and
    small-star steps alternate, so the number of rounds grows with the logarithm of a component's
    size. Minima are pre-aggregated before the shuffle and joined back, so a hub is never gathered
    in one group, and each round is written to the shared folder.
    """
    now = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state.n == 0 or (state.n, state.x) == before:
            break
        before = (state.n, state.x)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = durable(small.union(least).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )
