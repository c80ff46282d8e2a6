"""Vectors keyed by row id: similarity, centroids, clusters, documents of clusters."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.stats import col
from tallyframe.operators import clusters
from tallyframe.operators.calls import SHARDS, Log
from tallyframe.operators.judgments import remaining
from tallyframe.operators.ordering import numbered
from tallyframe.storage import fresh_path


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, slack: float = 0.0) -> Column:
    """Cosine of two arrays, with a slack added to either length; null where a length is 0."""
    return dot(a, b) / F.nullif((F.sqrt(dot(a, a)) + slack) * (F.sqrt(dot(b, b)) + slack), F.lit(0.0))


def centroids(df: DataFrame, by: str, vector: str, d: int) -> DataFrame:
    """Mean vector of each group, component by component in one aggregation."""
    return df.groupBy(by).agg(F.array(*(F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(d))).alias("centroid"))


def to_centroid(df: DataFrame, by: str, vector: str, key: str, d: int) -> DataFrame:
    """Cosine of each row to its group's centroid, and its place in the group, nearest first."""
    rows = df.join(centroids(df, by, vector, d), by)
    rows = rows.select(by, key, F.round(cosine(vector, "centroid", 1e-9), 6).alias("similarity"), (-F.round(cosine(vector, "centroid", 1e-9), 6)).alias("far_"))
    placed = numbered(rows, ["far_", key], (by,), "place").drop("far_")
    return placed.withColumn("place", (F.col("place") + 1).cast("int"))


def nearest_to(df: DataFrame, query: list[float], k: int, vector: str, key: str) -> DataFrame:
    """The k rows with the largest cosine to one vector."""
    target = F.array(*map(F.lit, map(float, query)))
    rows = df.select(key, F.round(cosine(vector, target), 6).alias("similarity")).where("similarity is not null")
    return rows.orderBy(F.desc("similarity"), key).limit(k)


def cluster(df: DataFrame, vector: str, key: str, k: int, starts: int = 20, seed: int = 42) -> DataFrame:
    """Cluster of each row by the best of several starts (clusters.fit), with its cosine to the cluster's centre."""
    found = clusters.centres(df, vector, k, starts, seed)
    shared = df.sparkSession.sparkContext.broadcast(found)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            near = clusters._squares(x, shared.value).argmin(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], [key, "v", "cluster"])

    rows = df.select(key, F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    placed = rows.mapInArrow(place, f"`{key}` {dict(df.dtypes)[key]}, v array<double>, cluster int")
    middle = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cluster int, centre array<double>")
    return placed.join(F.broadcast(middle), "cluster").select(key, "cluster", cosine("v", "centre", 1e-9).alias("similarity"))


def embed(
    df: DataFrame,
    key: str,
    text: str,
    embedder: Callable[[list[str]], list[list[float]]],
    size: int = 200,
    done: DataFrame | None = None,
    log: str | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """key and vector of each text, from an injected embedder called with up to `size` texts.

    The vectors of each call are written to the log before the next one, by digest of text, so a task
    that runs again, a second action on the result, or a later run with the same log and shards asks for
    no text twice; equal texts of a shard are asked for once. Texts are dealt to `shards` parts, each
    embedded by one task at a time. log is a folder that driver and executors reach; without it the
    run has one of its own. Texts whose key is in `done` are left out before any call.
    """
    if done is not None:
        df = remaining(df, [done], [key])
    store = Log(log or f"{fresh_path(df.sparkSession)}/vectors")
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text_"), digest.alias("key_"))
    rows = rows.withColumn("shard_", F.pmod(F.xxhash64("key_"), F.lit(shards)).cast("string")).repartition(shards, "shard_").sortWithinPartitions("shard_")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, places = (batch.column(i).to_pylist() for i in (1, 2, 3))
            made: list[list[float]] = []
            for shard, group in itertools.groupby(range(len(keys)), places.__getitem__):
                own = list(group)
                known = {k: r["vector"] for k, r in store.read(shard).items()}
                todo = list({keys[i]: texts[i] for i in own if keys[i] not in known}.items())
                writer = store.writer(shard)
                for at in range(0, len(todo), size):
                    part = todo[at : at + size]
                    vectors = [[float(x) for x in v] for v in embedder([t for _, t in part])]
                    fresh = {k: v for (k, _), v in zip(part, vectors, strict=True)}
                    writer.add({"key": k, "vector": v} for k, v in fresh.items())
                    known |= fresh
                writer.close()
                made += [known[keys[i]] for i in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float32()))], [key, "vector"])

    return rows.mapInArrow(call, f"`{key}` {dict(df.dtypes)[key]}, vector array<float>")


def chunks(df: DataFrame, by: str, order: str, text: str, size: int = 50, header: str = "") -> DataFrame:
    """Documents of at most `size` texts of a group, in order, each with a header line of group and part."""
    rows = numbered(df, [order], (by,), "at_").withColumn("part", F.floor(F.col("at_") / size))
    docs = rows.groupBy(by, "part").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: F.coalesce(x["t"], F.lit(""))), "\n")
    head = F.concat(F.lit(header), F.col(by).cast("string"), F.lit("#"), F.col("part").cast("string"), F.lit("\n"))
    return docs.select(by, "part", F.size("items").alias("items"), F.concat(head, body).alias("document"))
