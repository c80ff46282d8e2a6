"""Nearest neighbours by cosine: score-aware four-bit product quantisation and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import durable

#: Vectors that the quantiser is fitted to at most; components of a subspace; rounds of fitting.
SAMPLE, WIDTH, ROUNDS = 8192, 2, 6
#: Score above which errors matter most; it sets how much more an error along the vector weighs.
THRESHOLD = 0.2
#: Vectors of a cell on average and cells at most; the nearest cells that a query is compared with at least, which are
#: all of them up to CELL * PROBES vectors.
CELL, CELLS, PROBES = 8192, 4096, 64
#: Share of the neighbours among rows held out that the cells searched must hold; rows held out, and those of them asked.
RECALL, HELD, ASKED = 0.95, 4096, 512
#: Queries and indexed rows of a block on average; rows reranked at least for a query and a block.
QUERIES, SLICE, RERANK = 256, 1024, 32


class Quantiser:
    """Sixteen centres for each pair of components, for unit vectors.

    The loss of replacing x by c is |x - c|^2 + (eta - 1) <x - c, x>^2: the error along x, which
    distorts large inner products, weighs eta times the error across it. Codes are chosen and centres
    moved subspace by subspace, each given the others.
    """

    def __init__(self, sample: np.ndarray) -> None:
        self.d = sample.shape[1]
        self.m = 2 * -(-self.d // (2 * WIDTH))  # even, so that two codes fill a byte
        self.eta = max(1.0, (self.d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        parts = self._parts(sample)
        rng = np.random.default_rng(7)
        start = np.resize(rng.permutation(len(parts)), 16)
        self.centres = parts[start].transpose(1, 0, 2).copy() + rng.normal(0, 1e-3, (self.m, 16, WIDTH))
        codes = self.codes(sample)
        for _ in range(ROUNDS):
            along = self._along(parts, codes)
            for m in range(self.m):
                x = parts[:, m]
                mine = ((x - self.centres[m, codes[:, m]]) * x).sum(1)
                rest = along - mine
                for k in range(16):
                    of = codes[:, m] == k
                    if of.any():
                        u = x[of]
                        left = of.sum() * np.eye(WIDTH) + (self.eta - 1) * u.T @ u
                        right = u.sum(0) + (self.eta - 1) * (u * (rest[of] + (u * u).sum(1))[:, None]).sum(0)
                        self.centres[m, k] = np.linalg.solve(left, right)
                along = rest + ((x - self.centres[m, codes[:, m]]) * x).sum(1)
            codes = self.codes(sample)
        some = sample[:: max(1, len(sample) // 256)]
        exact, near = some @ sample.T, self.scores(self.tables(some), self.pack(codes))
        top = np.argsort(-near, axis=1)[:, 1:51]
        gap = np.take_along_axis(exact - near, top, axis=1)
        #: By how much a true score exceeds its estimate in all but one of a thousand cases.
        self.slack = max(0.0, float(np.quantile(gap, 0.999))) if gap.size else 0.0

    @classmethod
    def of(cls, state: dict) -> Quantiser:
        """From vars() of a fitted one, which is what is broadcast."""
        made = cls.__new__(cls)
        vars(made).update(state)
        return made

    def _parts(self, unit: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(unit), self.m * WIDTH))
        wide[:, : self.d] = unit
        return wide.reshape(len(unit), self.m, WIDTH)

    def _along(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        made = self.centres[np.arange(self.m), codes]
        return ((parts - made) * parts).sum((1, 2))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Code of each vector in each subspace, after two rounds over the subspaces."""
        parts = self._parts(unit)
        codes = np.stack([((parts[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(self.m)], axis=1)
        along = self._along(parts, codes)
        for _ in range(2):
            for m in range(self.m):
                gap = parts[:, m, None] - self.centres[m]
                each = (gap * parts[:, m, None]).sum(2)
                rest = along - np.take_along_axis(each, codes[:, m, None], 1)[:, 0]
                loss = (gap**2).sum(2) + (self.eta - 1) * (rest[:, None] + each) ** 2
                codes[:, m] = loss.argmin(1)
                along = rest + np.take_along_axis(each, codes[:, m, None], 1)[:, 0]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes in each byte."""
        return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte, its part of the score for each of the byte's 256 values."""
        single = np.einsum("qmw,mkw->qmk", self._parts(queries), self.centres).astype(np.float32)
        return (single[:, 0::2, :, None] + single[:, 1::2, None, :]).reshape(len(queries), self.m // 2, 256)

    @staticmethod
    def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Estimated inner product of each query with each packed row."""
        out = np.zeros((len(tables), len(packed)), np.float32)
        for b in range(packed.shape[1]):
            out += tables[:, b, packed[:, b]]
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaling first keeps very large and very small ones finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part: complete, finite, not zero, of the commonest length."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    common = sizes.agg(F.max(F.struct("n", "d")).alias("top")).select(F.col("top.d").alias("d"))
    rows = rows.join(F.broadcast(common), F.size("v") == F.col("d")).drop("d")
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero, not two


def centres_of(unit: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n directions by spherical k-means; one that attracts nothing stays where it was."""
    centres = unit[np.linspace(0, len(unit) - 1, n).astype(int)].copy()
    for _ in range(rounds if n > 1 else 1):
        nearest = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(unit, max(1, len(unit) // 4096))])
        order = np.argsort(nearest, kind="stable")
        names, first = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(unit[order], first, axis=0)
        length = np.sqrt((sums * sums).sum(1))
        centres[names[length > 0]] = sums[length > 0] / length[length > 0, None]
    return centres


def probes_for(held: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many of its nearest cells a query has to search, measured on rows that the cells were not fitted to.

    The k nearest of some of these are looked up among them all; the number is the least for which
    RECALL of them lie in so many cells. Neighbours among few rows are further away than those among
    all, and further neighbours are in further cells, so all rows are found at least as often.
    """
    if len(centres) <= PROBES or len(held) < 2:
        return len(centres)
    cell = (held @ centres.T).argmax(1)
    needed = []
    for at in range(0, min(ASKED, len(held)), 64):
        some = held[at : min(at + 64, ASKED)]
        near = some @ held.T
        near[np.arange(len(some)), np.arange(at, at + len(some))] = -np.inf
        found = np.argpartition(-near, min(k, len(held) - 1) - 1, axis=1)[:, :k]
        to = some @ centres.T
        own = np.take_along_axis(to, cell[found], axis=1)
        needed.append(((to[:, None, :] > own[:, :, None]).sum(2) + 1).ravel())
    return min(len(centres), max(PROBES, int(np.quantile(np.concatenate(needed), RECALL, method="higher"))))


def _blocks(rows: DataFrame, size: int, key: str, name: str) -> DataFrame:
    """Rows of each cell in blocks of about `size`, dealt by a hash of the key: cell, and an array of the given name."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))
    rest = [c for c in rows.columns if c != "cell"]
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")))
    return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("part")


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    exact: bool = False,
) -> DataFrame:
    """The k rows nearest to each query by cosine: query_id, rank (from 1), vec_id, score.

    is_query is a condition on vec_id. Equal vectors are indexed once, with their k + 1 smallest ids,
    which is all that k answers can name. Quantiser and cells are fitted to a bounded sample, taken
    by hash: SAMPLE vectors, or 16 for each cell, and HELD more on which probes are measured. Every vector is encoded and put into the cell whose
    direction is nearest. Queries are a table, too: each goes to so many of its nearest cells as the
    rows held out show to be needed (probes_for), to all of them with `exact`, where
    blocks of queries meet blocks of indexed rows by a join on the cell; a cell with very many of
    either is many blocks. A block of rows is scanned by table lookups; its best RERANK estimates,
    and every other row whose estimate is within the quantiser's slack of the k-th exact score, are
    reranked by exact cosine in double precision, so a crowd of rows that codes cannot tell apart is
    reranked as a whole. Up to CELL * PROBES distinct vectors all cells are searched.

    Rows that are null, zero, not finite or of an uncommon length take no part; ties go to the
    smaller vec_id; a query never finds its own id; with fewer candidates, all are returned; an
    empty table gives no rows.
    """
    rows = usable(vectors, vec_id, embedding).distinct()
    order = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1)
    plain = durable(ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    cells = min(CELLS, -(-plain.count() // CELL))
    taken = plain.orderBy(F.xxhash64("v"), "v").select("v").limit(max(SAMPLE, 16 * cells) + HELD * (cells > PROBES)).toPandas()["v"]
    if not len(taken):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _unit(np.stack(taken.to_list()))
    held = sample[max(SAMPLE, 16 * cells) :]
    sample = sample[: max(SAMPLE, 16 * cells)]
    centres = centres_of(sample, cells)
    probed = len(centres) if exact else probes_for(held, centres, k)
    shared = vectors.sparkSession.sparkContext.broadcast((vars(Quantiser(sample[:SAMPLE])), centres))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, centres = shared.value
        q = Quantiser.of(state)
        for batch in batches:
            unit = _unit(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, q.d)) if batch.num_rows else np.zeros((0, q.d))
            code = pa.array([x.tobytes() for x in q.pack(q.codes(unit))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, code, pa.array((unit @ centres.T).argmax(1), pa.int64())], ["v", "ids", "code", "cell"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, centres = shared.value
        n = probed
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                unit = _unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                near = np.argpartition(-(unit @ centres.T), n - 1, axis=1)[:, :n]
                each = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
                yield pa.RecordBatch.from_arrays([*each.columns, pa.array(near.ravel(), pa.int64())], ["query_id", "q", "cell"])

    index = durable(plain.mapInArrow(encode, "v array<double>, ids array<long>, code binary, cell long"))
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    asked = durable(asked.mapInArrow(probe, "query_id long, q array<double>, cell long"))
    met = _blocks(asked, QUERIES, "query_id", "asked").join(_blocks(index, SLICE, "v", "rows"), "cell").select("asked", "rows")
    found = met.mapInArrow(_scanner(shared, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _merge(
    best: list[tuple[float, int]], places: np.ndarray, rows: np.ndarray, query: np.ndarray, members: list[list[int]], mine: int, k: int
) -> list[tuple[float, int]]:
    """The k best of those known and the rows at the places, as (negated exact score, id)."""
    exact = (rows[places] * query).sum(axis=1)
    if len(places) > 4 * k:  # ids are only read of rows that can still be among the best
        worst = -best[-1][0] if len(best) == k else -np.inf
        floor = max(worst, np.partition(exact, len(exact) - k - 1)[len(exact) - k - 1])
        places, exact = places[exact >= floor], exact[exact >= floor]
    fresh = [(-float(s), i) for s, p in zip(exact, places, strict=True) for i in members[p] if i != mine]
    return sorted({*best, *fresh})[:k]


def _scanner(shared, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser.of(shared.value[0])
        for batch in batches:
            for asked, held in zip(batch.column(0), batch.column(1), strict=True):
                ids, wanted = asked.values.flatten()
                v, members, code = held.values.flatten()
                units = _unit(wanted.flatten().to_numpy().reshape(len(ids), q.d))
                rows = _unit(v.flatten().to_numpy().reshape(len(v), q.d))
                members = members.to_pylist()
                packed = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(v), -1)
                near = q.scores(q.tables(units), packed)
                least = min(RERANK, len(v))
                top = np.argpartition(-near, least - 1, axis=1)[:, :least]
                out = []
                for j, mine in enumerate(ids.to_pylist()):
                    best = _merge([], top[j], rows, units[j], members, mine, k)
                    floor = -best[-1][0] - q.slack if len(best) == k else -np.inf
                    more = np.setdiff1d(np.flatnonzero(near[j] >= floor), top[j], assume_unique=True)
                    if len(more):
                        best = _merge(best, more, rows, units[j], members, mine, k)
                    out += [(mine, i, -s) for s, i in best]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return scan
