"""Places in an order, without one task that sees a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.storage import durable


#: Rows of a table that one task may put in order.
SMALL = 100_000


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def numbered(df: DataFrame, order: list[str], by: tuple[str, ...] = (), name: str = "ord") -> DataFrame:
    """df with each row's place (from 0) in its group by the order columns, which are expected to be total.

    Rows are dealt to ranges of the order and written with the number of their range, so places do
    not change when a task runs again. A group with very many rows is many ranges; counts per group
    and range give the offsets. Null groups are one group.
    """
    rows = durable(df.repartitionByRange(*map(F.col, [*by, *order])).withColumn("range_", F.spark_partition_id()))
    sizes = rows.groupBy(*by, "range_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    within = F.row_number().over(Window.partitionBy(*by, "range_").orderBy(*order)) - 1
    placed = rows.withColumn("place_", within)
    out = placed.join(sizes, _same(placed, sizes, [*by, "range_"]))
    return out.select(*(placed[c] for c in df.columns), (F.col("before_") + F.col("place_")).alias(name))


def running_total(df: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """df with the sum of an amount up to and with each row, by an order without ties.

    One range of the order a task; a table of SMALL rows at most is one range.
    """
    df = durable(df)
    if df.count() <= SMALL:
        whole = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(amount).over(whole))
    rows = durable(df.repartitionByRange(F.col(order)).withColumn("range_", F.spark_partition_id()))
    sums = rows.groupBy("range_").agg(F.sum(amount).alias("n_"))
    before = Window.partitionBy(F.lit(0)).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    within = F.sum(amount).over(Window.partitionBy("range_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within_", within).join(F.broadcast(sums), "range_").select(*df.columns, (F.col("before_") + F.col("within_")).alias(name))
