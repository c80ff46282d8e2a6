"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import durable, fields, free_name, quoted

#: Words of a window; a shorter item is one window.
WINDOW = 13
#: Words of a benchmark that is broadcast; windows of a larger one are joined with those of the documents.
TABLE_WORDS = 1_000_000
#: Places of the bitmap of suffix blocks in that join.
SUFFIXES = 1 << 26
#: Words as a Java pattern: see _FOLD.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: ASCII letters and digits are word characters, as is every byte of a non-ASCII character.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, with A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if isinstance(text, str) else []


class Searcher:
    """Shift and bucket tables for windows of one length, in blocks of two words.

    A block's shift is how far the search may move on when it ends at this block: to the block's
    last place in any window, or past the block if it is in none. At shift 0 the block's bucket
    holds the windows that end with it, and these are compared word by word.
    """

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str | None]]) -> None:
        self.length, self.size = length, min(2, length)
        self.far = length - self.size + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str | None]]] = {}
        for window, items in windows.items():
            for end in range(self.size, length + 1):
                block = window[end - self.size : end]
                self.shift[block] = min(length - end, self.shift.get(block, self.far))
            self.bucket.setdefault(window[-self.size :], {})[window] = items

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str | None]]]:
        """(first word, past the last word, items) of each occurrence."""
        end, n, size, shift, far = self.length, len(words), self.size, self.shift, self.far
        while end <= n:
            block = tuple(words[end - size : end])
            step = shift.get(block, far)
            if step:
                end += step
                continue
            window = tuple(words[end - self.length : end])
            items = self.bucket[block].get(window)
            if items is not None:
                yield end - self.length, end, items
            end += 1


def searchers(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> list[Searcher]:
    """One Searcher for each length of window among the items."""
    by: dict[int, dict[tuple[bytes, ...], set[str | None]]] = {}
    for item, words in items:
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            by.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(item)
    return [Searcher(length, found) for length, found in by.items()]


def _union(spans: list[int]) -> list[int]:
    """Spans (first word << 32 | past the last) with overlapping ones joined."""
    out: list[int] = []
    for span in sorted(spans):
        if out and span >> 32 <= out[-1] & 0xFFFFFFFF:
            out[-1] = out[-1] >> 32 << 32 | max(out[-1] & 0xFFFFFFFF, span & 0xFFFFFFFF)
        else:
            out.append(span)
    return out


def _carried(rows: DataFrame, items: list[tuple[str | None, list[bytes]]], window: int, name: str, body: int) -> DataFrame:
    """rows (a struct of the given name, whose field number `body` is the text) with n_words, spans and found.

    The shift tables are broadcast.
    """
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searchers(shared.value, window)
        for batch in batches:
            sizes, spans, found = [], [], []
            for value in batch.column(0).field(body).to_pylist():
                words, hits, ids = words_of(value), [], set()
                for table in tables:
                    for first, end, items in table.find(words):
                        hits.append(first << 32 | end)
                        ids.update(x for x in items if x is not None)
                sizes.append(len(words))
                spans.append(_union(hits))
                found.append(sorted(ids))
            new = [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], [name, "n_words", "spans", "found"])

    kind = rows.schema[name].dataType
    schema = T.StructType([T.StructField(name, kind), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("found", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(search, schema)


def _digests(words: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """First word, suffix block and 128-bit hash of each window of a length."""
    for first in range(len(words) - length + 1):
        window = words[first : first + length]
        block = xxhash.xxh64_intdigest(b" ".join(window[-2:])) % SUFFIXES
        yield first, block, *np.frombuffer(xxhash.xxh128_digest(b" ".join(window)), np.int64).tolist()


def _found_by_join(texts: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The same for a benchmark of any size: k1, k2, spans and found of the texts with occurrences.

    Windows of the items are a table. A bitmap of their suffix blocks (of one size for any benchmark)
    is broadcast; only those windows of a text that end with one of the blocks leave it, and they are
    joined with the table by length and 128-bit hash.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(body)
                length = min(window, len(words))
                out += [(length, block, h, g, item) for _, block, h, g in _digests(words, length)] if length else []
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["length", "block", "h", "g", "item"])

    windows = durable(benchmark.mapInArrow(cut, "length long, block long, h long, g long, item string").distinct())
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    bits = windows.groupBy(F.shiftright("block", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(block & 63 as int)))").alias("bits"))
    bitmap = np.zeros(SUFFIXES >> 6, np.int64)
    for row in bits.toLocalIterator():
        bitmap[row.at] = row.bits
    shared = texts.sparkSession.sparkContext.broadcast((lengths, bitmap.view(np.uint8)))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bits = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                for k1, k2, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = words_of(value)
                    for length in lengths:
                        for first, block, h, g in _digests(words, length):
                            if bits[block >> 3] >> (block & 7) & 1:
                                out.append((k1, k2, first << 32 | first + length, length, h, g))
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "span", "length", "h", "g"])

    offered = texts.mapInArrow(offer, "k1 long, k2 long, span long, length long, h long, g long").distinct()
    hits = offered.join(windows.select("length", "h", "g", "item"), ["length", "h", "g"])
    hits = hits.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item")).alias("found"))
    return durable(hits)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids of items with occurring windows) and contaminated.

    A window is `window` consecutive words of an item, or all words of a shorter item that has any. A
    word of a document is hit if it lies in an occurrence of a window; a document is contaminated if
    a word is hit and the hit ones are at least a twentieth of its words. A benchmark of up to
    TABLE_WORDS words is searched for in one pass over the documents, without a shuffle; a larger one
    by a join of windows, with the same result. Null and empty texts have no words; null items and
    those without words have no windows; a null item_id marks hits but is not listed; repeated items
    and rows are treated alike; with an empty benchmark nothing is hit. Columns of docs named like an
    added one come back with the prefix "in_".
    """
    added = ["n_words", "n_hit", "items", "contaminated"]
    rows = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c in added})
    body = text if text in rows.columns else f"in_{text}"
    names = rows.columns
    given = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body"))
    sizes = given.select(F.coalesce(F.regexp_count("body", F.lit(_WORD)), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] or 0
    none = F.array().cast("array<long>"), F.array().cast("array<string>")
    if sizes <= TABLE_WORDS:
        items = [(item, words_of(body_)) for item, body_ in given.toLocalIterator()]
        name = free_name(rows, "row")
        found = _carried(rows.select(F.struct(*fields(rows)).alias(name)), items, window, name, names.index(body))
        rows, spans, ids, size = found, F.col("spans"), F.col("found"), F.col("n_words")
        kept = [F.col(name)[c].alias(c) for c in names]
    else:
        key = [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")]
        found = _found_by_join(rows.select(*key, F.col(body).alias("body")), given, window)
        packed = rows.select(*key, F.struct(*fields(rows)).alias("row"), F.coalesce(F.regexp_count(body, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
        rows = packed.join(found, ["k1", "k2"], "left")
        spans, ids, size = F.coalesce("spans", none[0]), F.coalesce("found", none[1]), F.col("n_words")
        kept = [F.col("row")[c].alias(c) for c in names]
    low = F.lit(0xFFFFFFFF).cast("long")

    def cover(state, x):
        first, end = F.shiftright(x, 32), x.bitwiseAND(low)
        more = F.greatest(F.lit(0).cast("long"), end - F.greatest(first, state["upto"]))
        return F.struct((state["n"] + more).alias("n"), F.greatest(end, state["upto"]).alias("upto"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    n_hit = F.aggregate(F.array_sort(spans), start, cover)["n"]
    out = rows.select(*kept, size.alias("n_words"), n_hit.alias("n_hit"), ids.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones, under their own column names; options as for contamination()."""
    found = contamination(docs, benchmark, **options).where(~F.col("contaminated"))
    return found.select(*(F.col(quoted(f"in_{c}" if f"in_{c}" in found.columns and f"in_{c}" not in docs.columns else c)).alias(c) for c in docs.columns))
