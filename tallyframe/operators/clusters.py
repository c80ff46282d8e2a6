"""k-means of many models in shared passes, and silhouettes of a sample against all rows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.storage import durable

#: Rows, chosen by a hash of their vector, from which starting centres are drawn, and of which silhouettes are taken.
START_ROWS, SILHOUETTE_ROWS = 20_000, 5_000
#: Passes over the rows at most, and the move of a model's centres (root of the sum of squares) at which it is done.
PASSES, SETTLED = 100, 1e-6
#: Rows that a task compares at once, and rows that are worth a file of their own.
_BLOCK, _FILE_ROWS = 256, 2_048
#: Tasks whose sums the driver adds up; those of more are added in tasks first.
_PARTS = 32


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    """v, the rows' vectors as doubles, without null ones."""
    return df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def _dealt(df: DataFrame, vector: str) -> DataFrame:
    """The rows' vectors, written once for many passes in like files, so that all cores share each pass however df is cut."""
    rows = _vectors(df, vector)
    files = min(2 * df.sparkSession.sparkContext.defaultParallelism, rows.count() // _FILE_ROWS)
    return durable(rows.repartition(max(1, files)))


def sample(rows: DataFrame, n: int, *more: str) -> tuple[np.ndarray, list]:
    """Vectors of n rows at most, the same for the same rows, and the values of a further column."""
    found = rows.orderBy(F.md5(F.to_json(F.struct("v"))), *more).limit(n).toPandas()
    return np.stack(found["v"].to_list()) if len(found) else np.zeros((0, 0)), [found[c].to_numpy() for c in more]


def starts(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k starting centres: points drawn one by one, with a chance in proportion to the squared distance from those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(points)))]
    near = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = near.sum()
        chosen.append(int(rng.choice(len(points), p=near / total)) if total > 0 else int(rng.integers(len(points))))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to rows c."""
    return np.maximum(0.0, (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T)


def _nearest(x: np.ndarray, sizes: list[int], stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and model, the place of its nearest centre in the stack of all models' centres, and the squared distance.

    One product serves all models, and one search all that have the same number of centres.
    """
    far = _squares(x, stack)
    near = np.empty((len(x), len(sizes)), np.int64)
    at = model = 0
    for k, same in itertools.groupby(sizes):
        m = sum(1 for _ in same)
        near[:, model : model + m] = far[:, at : at + m * k].reshape(len(x), m, k).argmin(2) + np.arange(at, at + m * k, k)
        at, model = at + m * k, model + m
    return near, np.take_along_axis(far, near, 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for whole in batches:
        for at in range(0, whole.num_rows, _BLOCK):
            batch = whole.slice(at, _BLOCK)
            yield np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1), batch


def _added(df: DataFrame, by: list[str], *numbers: str) -> list:
    """Sums of numbers and, component by component, of the arrays `sums` of a few rows per task."""
    total = F.reduce(F.collect_list("sums"), F.transform(F.first("sums"), lambda _: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in numbers), total.alias("sums")).collect()


def _total(rows: DataFrame, parts: int) -> np.ndarray:
    """Sum of the arrays of doubles in column part, of which each of `parts` tasks has one; many are added up in tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(0):
                total = np.frombuffer(part.as_buffer()) + (0.0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    while parts > _PARTS:
        parts = math.ceil(parts / _PARTS)
        rows = rows.repartition(parts).mapInArrow(add, "part binary")
    return np.sum([np.frombuffer(r.part) for r in rows.collect()], axis=0)


def fit(rows: DataFrame, first: dict[object, np.ndarray], passes: int = PASSES, settled: float = SETTLED) -> dict[object, tuple[np.ndarray, float]]:
    """Centres and cost (sum of squared distances) of every model, from its starting centres by Lloyd's steps.

    rows has v. One pass over them serves all models that have not settled: a task adds up the rows of
    every centre of every model, and sums per task are added before they reach the driver, which
    moves the centres. A centre without rows stays. The cost is that of the centres returned.
    """
    centres, out = dict(first), {}
    names, parts = list(first), rows.rdd.getNumPartitions()
    for turn in range(passes):
        moving = [m for m in names if m not in out]
        if not moving:
            break
        order = sorted(moving, key=lambda m: len(centres[m]))
        width = centres[order[0]].shape[1]
        shared = rows.sparkSession.sparkContext.broadcast(([len(centres[m]) for m in order], np.concatenate([centres[m] for m in order])))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sizes, stack = shared.value
            sums, counts, costs = np.zeros_like(stack), np.zeros(len(stack), np.int64), np.zeros(len(stack))
            for x, _ in _blocks(batches):
                near, far = _nearest(x, sizes, stack)
                of = np.zeros((len(x), len(stack)))
                np.put_along_axis(of, near, 1.0, 1)
                sums += of.T @ x
                counts += np.bincount(near.ravel(), minlength=len(stack))
                costs += np.bincount(near.ravel(), weights=far.ravel(), minlength=len(stack))
            yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([sums, counts, costs]).tobytes()], pa.binary())], ["part"])

        found = _total(rows.mapInArrow(step, "part binary"), parts).reshape(-1, width + 2)
        shared.unpersist()
        moved, cost, at = {}, {}, 0
        for m in order:
            sums, counts, costs = found[at : at + len(centres[m]), :-2], found[at : at + len(centres[m]), -2:-1], found[at : at + len(centres[m]), -1]
            moved[m] = np.where(counts > 0, sums / np.maximum(1, counts), centres[m])
            cost[m] = float(costs.sum())
            at += len(centres[m])
        for m in moving:
            if turn + 1 == passes or np.sqrt(((moved[m] - centres[m]) ** 2).sum()) <= settled:
                out[m] = centres[m], cost[m]
            centres[m] = moved[m]
    return out


def _scores(own: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> float | None:
    """Mean silhouette of points in clusters `own`, of their sums of distances to each cluster's rows; None with fewer than two clusters."""
    if (sizes > 0).sum() < 2 or not len(own):
        return None
    at = np.arange(len(own))
    inside = sums[own, at] / np.maximum(1, sizes[own] - 1)
    means = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], np.inf)
    means[own, at] = np.inf
    near = means.min(0)
    return float(np.where(sizes[own] > 1, (near - inside) / np.maximum(np.maximum(near, inside), 1e-300), 0.0).mean())


def _distances(rows: DataFrame, points: np.ndarray, sizes: list[int], kinds: Callable[[np.ndarray, pa.RecordBatch], list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each clustering, the sums of distances from each point to all rows of each cluster, and the rows of each cluster."""
    middle = points.mean(0)
    shared = rows.sparkSession.sparkContext.broadcast((points - middle, middle))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_zero, middle = shared.value
        sums, counts = [np.zeros((k, len(near_zero))) for k in sizes], [np.zeros(k, np.int64) for k in sizes]
        for x, batch in _blocks(batches):
            far = np.sqrt(_squares(x - middle, near_zero))
            for m, own in enumerate(kinds(x, batch)):
                of = np.zeros((sizes[m], len(x)))
                known = np.flatnonzero(own >= 0)
                of[own[known], known] = 1.0
                sums[m] += of @ far
                counts[m] += of.sum(1).astype(np.int64)
        at = [(m, k) for m, n in enumerate(sizes) for k in range(n) if counts[m][k]]
        columns = [[m for m, _ in at], [k for _, k in at], [int(counts[m][k]) for m, k in at], [sums[m][k] for m, k in at]]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["model", "kind", "n", "sums"])

    out = [(np.zeros((k, len(points))), np.zeros(k, np.int64)) for k in sizes]
    for r in _added(rows.mapInArrow(add, "model int, kind int, n long, sums array<double>"), ["model", "kind"], "n"):
        out[r.model][0][r.kind], out[r.model][1][r.kind] = r.sums, r.n
    return out


def silhouette(placed: DataFrame, vector: str, cluster: str, rows: int = SILHOUETTE_ROWS) -> float | None:
    """Mean Euclidean silhouette of up to `rows` rows against all rows; None with fewer than two clusters.

    Which rows is decided by a hash of their vector. Their mean distances, within the own cluster and to
    the others, are those to every row, so with up to `rows` rows the result is exact. A row alone in
    its cluster counts 0; rows without vector or cluster do not count.
    """
    known = placed.where(F.col(cluster).isNotNull())
    kinds = [r[0] for r in known.select(F.col(cluster).cast("string")).distinct().orderBy(cluster).collect()]
    if len(kinds) < 2:
        return None
    place = (F.array_position(F.array(*map(F.lit, kinds)), F.col(cluster).cast("string")) - 1).cast("int").alias("kind")
    every = known.select(F.col(vector).cast("array<double>").alias("v"), place).where(F.col("v").isNotNull())
    points, (own,) = sample(every, rows, "kind")
    if not len(points):
        return None
    ((sums, sizes),) = _distances(every, points, [len(kinds)], lambda _, batch: [np.asarray(batch.column(1))])
    return _scores(own, sums, sizes)


def search_k(df: DataFrame, vector: str, ks: tuple[int, ...] = tuple(range(2, 13)), tries: int = 10, seed: int = 42, rows: int = SILHOUETTE_ROWS) -> DataFrame:
    """Per number of clusters: cost of the best of several starts and its silhouette, best first.

    All numbers and starts are fitted together, one pass over the rows a step, and the silhouettes of
    all numbers are taken in one more. Ties go to fewer clusters. With few rows only as many clusters
    are tried as there are rows less one.
    """
    spark, every = df.sparkSession, _dealt(df, vector)
    n = every.count()
    points, _ = sample(every, max(START_ROWS, rows))
    wanted = [k for k in ks if k < n]
    fitted = fit(every, {(k, i): starts(points[:START_ROWS], k, seed + i) for k in wanted for i in range(tries)})
    best = {k: min((fitted[k, i] for i in range(tries)), key=lambda x: x[1]) for k in wanted}
    points, models = points[:rows], [best[k][0] for k in wanted]
    shared = spark.sparkContext.broadcast(models)
    found = _distances(every, points, wanted, lambda x, _: [_squares(x, c).argmin(1) for c in shared.value]) if wanted else []
    scores = [_scores(_squares(points, c).argmin(1), *f) for c, f in zip(models, found, strict=True)]
    out = [(k, best[k][1], s) for k, s in zip(wanted, scores, strict=True)]
    return spark.createDataFrame(out, "k int, cost double, silhouette double").orderBy(F.desc("silhouette"), "k")


def centres(df: DataFrame, vector: str, k: int, tries: int = 20, seed: int = 42) -> np.ndarray:
    """Centres of the best of several starts."""
    every = _dealt(df, vector)
    points, _ = sample(every, START_ROWS)
    fitted = fit(every, {i: starts(points, min(k, len(points)), seed + i) for i in range(tries)})
    return min(fitted.values(), key=lambda x: x[1])[0]
