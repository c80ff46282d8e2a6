"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import free_name, quoted

#: Rows of the labelled sample that the model is fitted to (as expected value), and features kept of them at most.
SAMPLE_ROWS, SAMPLE_FEATURES = 16_000, 20_000_000
#: Hashed features: 2 to this power.
BITS = 22
#: FTRL-proximal: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
EPOCHS = 3
#: Least positive rows among those set aside, for the decision point to be moved.
CALIBRATE = 10
#: Features whose weights are looked at together.
_PART = 1 << 16
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class _Hashes(dict):
    """Word hashes by word, up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 7)
        return found


def features(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Distinct hashed features of a text: words, pairs of neighbours, and pairs with one word between."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.int32)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    mix = np.uint64(0x9E3779B97F4A7C15)
    pairs = (h[:-1] * mix) ^ (h[1:] >> np.uint64(1))
    skips = (h[:-2] * mix + np.uint64(0x632BE59BD9B4E019)) ^ (h[2:] >> np.uint64(1))
    every = np.concatenate([h, pairs * mix, skips * mix])
    return np.unique((every >> np.uint64(64 - BITS)).astype(np.int32))


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", label: str = "label") -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and weights of the features that count, and the bias.

    The sample is bounded: rows are taken by a hash of the row at a rate that yields about `rows` rows,
    and of these as many, in order of the hash, as have SAMPLE_FEATURES features together (a text of more
    than a twentieth of that is not sampled), so the sample depends on the rows alone and not on how
    files hold them. Per-coordinate rates and the L1 term leave most weights zero, so the model that is broadcast is small. Null labels are left
    out; without rows every weight is zero and the score a half.
    """
    labelled = labelled.where(F.col(label).isNotNull())
    count = labelled.count()
    unit = F.pmod(F.xxhash64(*labelled.columns), F.lit(1 << 40))
    chosen = labelled.select(F.col(text).alias("text"), F.col(label).cast("double").alias("label"), unit.alias("unit"))
    chosen = chosen.where(F.col("unit") < F.lit(int((1 << 40) * min(1.0, rows / max(1, count)))))
    most = F.lit(3).cast("long") * F.coalesce(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0))
    chosen = chosen.withColumn("most", most).where(F.col("most") <= SAMPLE_FEATURES // 20)
    total, cut = 0, 1 << 40
    for place, size in sorted((r.unit, r.most) for r in chosen.select("unit", "most").collect()):
        total += size
        if total > SAMPLE_FEATURES:
            cut = place
            break
    chosen = chosen.where(F.col("unit") < F.lit(cut)).drop("unit", "most")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = [features(t, hashes) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), batch.column(1)], ["x", "label"])

    # The rows' features stand in one buffer: thousands of small arrays would leave the driver's memory in pieces.
    held, ends, ys = bytearray(), [], []
    for row in chosen.mapInArrow(encode, "x binary, label double").toLocalIterator():
        held += row.x
        ends.append(len(held) // 4)
        ys.append(row.label)
    xs = np.split(np.frombuffer(held, np.int32), ends[:-1]) if ends else []
    order = sorted(range(len(xs)), key=lambda i: (xxhash.xxh64_intdigest(xs[i].tobytes(), 3), ys[i]))
    aside = order[::5]
    shift = _shift([xs[i] for i in aside], [ys[i] for i in aside], train([xs[i] for k, i in enumerate(order) if k % 5], [ys[i] for k, i in enumerate(order) if k % 5]))
    kept, weights, bias = train([xs[i] for i in order], [ys[i] for i in order])
    return kept, weights, bias - shift


def train(xs: list[np.ndarray], ys: list[float]) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the rows in order, EPOCHS times: indices and weights that are not zero, and the bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    w0 = z0 = n0 = 0.0
    for _ in range(EPOCHS):
        for x, y in zip(xs, ys, strict=True):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > L1, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35)))
            g = p - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / ALPHA * w
            n[x] = nx + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w0
            n0 += g * g
            w0 = -z0 / ((BETA + np.sqrt(n0)) / ALPHA + L2)
    # Few pass the L1 term; results for all would be several arrays of the size of z in the driver.
    some = np.concatenate([at + np.flatnonzero(np.abs(z[at : at + _PART]) > L1) for at in range(0, len(z), _PART)])
    zx = z[some]
    w = (np.sign(zx) * L1 - zx) / ((BETA + np.sqrt(n[some])) / ALPHA + L2)
    return some[w != 0].astype(np.int32), w[w != 0].astype(np.float32), float(w0)


def _shift(xs: list[np.ndarray], ys: list[float], model: tuple[np.ndarray, np.ndarray, float]) -> float:
    """The margin that separates rows set aside best (by F1, in the middle of the gap); 0 with few positives.

    Rare positives leave the bias too low for a decision at one half.
    """
    if sum(ys) < CALIBRATE:
        return 0.0
    kept, values, bias = model
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = values
    margins = np.array([float(weights[x].sum(dtype=np.float64)) + bias for x in xs])
    order = np.argsort(-margins, kind="stable")
    hits = np.cumsum(np.array(ys)[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + hits[-1])
    k = int(f1.argmax())
    below = margins[order[k + 1]] if k + 1 < len(order) else margins[order[k]]
    return float((margins[order[k]] + below) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", label: str = "label") -> DataFrame:
    """docs with their label, for about `rows` labelled ids taken by hash; the largest of several labels counts.

    Labels are sampled before they meet the texts, so what is broadcast is bounded by `rows`.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(doc_id).agg(F.max(label).alias(label))
    unit = F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(1 << 20))
    chosen = known.where(unit < F.lit(int((1 << 20) * min(1.0, rows / max(1, known.count())))))
    return docs.join(F.broadcast(chosen), doc_id)


def score(
    docs: DataFrame,
    model: tuple[np.ndarray, np.ndarray, float],
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    name: str = "score",
) -> DataFrame:
    """The kept columns with the score (under the given name), the probability of label 1, of each whole text.

    Null and empty texts have no features and score by the bias alone. One row per document,
    repeated rows included; no shuffle; the broadcast holds the non-zero weights only. A text that is
    kept goes to the workers once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = keep.index(text) if text in keep else len(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, values, bias = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[kept] = values
        hashes = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sums = [float(weights[features(t, hashes)].sum(dtype=np.float64)) + bias for t in batch.column(place).to_pylist()]
                out = 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.float64())], [*keep, name])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{quoted(c)} {kinds[c]}" for c in keep) + f", {quoted(name)} double"
    more = [] if text in keep else [F.col(text).alias(free_name(docs, "text_"))]
    return docs.select(*map(quoted, keep), *more).mapInArrow(predict, schema)
