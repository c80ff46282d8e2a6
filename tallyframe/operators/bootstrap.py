"""Bootstrap intervals from counts, replicates spread over tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cramers_v_interval(counts: DataFrame, replicates: int = 2000, seed: int = 20260611, level: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """Percentile interval of Cramer's V of a 2x3 table, by multinomial redraws of each arm.

    counts has one row, or one per group of `by`, with target_o, target_s, target_x and the control's. Each replicate has a
    seed of its own, so the result does not depend on how replicates are dealt to tasks. The ends
    are order statistics: places floor(q B) - 1 and ceil((1 - q) B) - 1, from 0.
    """
    names = [f"{arm}_{k}" for arm in ("target", "control") for k in "osx"]
    replicate = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("id")
    rows = counts.select(*by, *(F.col(n).cast("long") for n in names), replicate).repartition("id")
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("v", T.DoubleType())])

    def redraw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *cells, i in zip(*(c.to_pylist() for c in batch.columns[len(by) :]), strict=True):
                rng = np.random.default_rng([seed, i])
                arms = [np.array(cells[:3]), np.array(cells[3:])]
                drawn = np.array([rng.multinomial(a.sum(), a / max(1, a.sum())) for a in arms], dtype=float)
                expected = np.outer(drawn.sum(1), drawn.sum(0)) / max(1.0, drawn.sum())
                full = expected > 0
                chi = (((drawn - expected) ** 2)[full] / expected[full]).sum()
                out.append(math.sqrt(chi / max(1.0, drawn.sum())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(out, pa.float64())], [*by, "v"])

    drawn = rows.mapInArrow(redraw, schema)
    q = (1 - level) / 2
    low, high = max(0, int(q * replicates) - 1), math.ceil((1 - q) * replicates) - 1
    ordered = drawn.withColumn("at", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("v")) - 1)
    return ordered.groupBy(*by).agg(
        F.lit(replicates).alias("replicates"),
        F.avg("v").alias("mean_v"),
        F.max(F.when(F.col("at") == low, F.col("v"))).alias("low_v"),
        F.max(F.when(F.col("at") == high, F.col("v"))).alias("high_v"),
    )
