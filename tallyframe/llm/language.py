"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import checked, durable, free_name

#: Bounds of the labelled sample, for each language: documents, and bytes of its dictionary.
SAMPLE_DOCS, DICTIONARY = 400, 96 * 1024
#: All dictionaries together are broadcast; with very many languages each gets an equal part of this.
ALL_DICTIONARIES = 64 * 1024 * 1024
#: Text is compressed in pieces of this many bytes, so that the dictionary matters all along it.
PIECE = 1024
LEVEL = 5
#: A best language that saves less than this share of the next one's size is no clear answer.
MARGIN = 0.01
UNKNOWN = "und"


def dictionaries(
    labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = DICTIONARY, text: str = "text", lang: str = "lang"
) -> dict[str, bytes]:
    """Raw dictionary content of each language, from a sample of rows with text and language.

    Rows are taken by a hash of the row, at a rate that yields about twice the bound, and then
    cut to `docs` rows and `size` characters a language, so what reaches one task or the driver is
    bounded. Rows of up to a 32nd of a dictionary come first, so that it holds many; a longer one
    counts with its first `size` characters.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    unit = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) / F.lit(float(1 << 20))
    body = F.substring(text, 1, size)
    rows = rows.select(body.alias("text"), F.col(lang).alias("lang"), unit.alias("unit")).where("text <> ''")
    rate = checked(durable(rows.groupBy("lang").agg((F.lit(2.0 * docs) / F.count("*")).alias("rate"))))
    order = Window.partitionBy("lang").orderBy(F.length("text") > size // 32, "unit", "text")
    chosen = (
        rows.join(rate, "lang")
        .where("unit < rate")
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= docs)
        .withColumn("upto", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("upto") <= size)
        .orderBy("lang", "k")
    )
    found: dict[str, bytearray] = {}
    for row in chosen.select("lang", "text").toLocalIterator():
        found.setdefault(row.lang, bytearray()).extend(row.text.lower().encode() + b"\n")
    each = min(size, ALL_DICTIONARIES // max(1, len(found)))
    return {k: bytes(v[:each]) for k, v in sorted(found.items())}


def _compressors(content: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, body in content.items():
        raw = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=PIECE, dict_size=len(body), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        raw.precompute_compress(compression_params=how)
        out[lang] = zstandard.ZstdCompressor(dict_data=raw, compression_params=how)
    return out


def _decide(text: str | None, compressors: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float, bool]:
    """Language, score and whether the margin is clear."""
    if not text or not compressors or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, False
    body = text.lower().encode()
    pieces = [body[i : i + PIECE] for i in range(0, len(body), PIECE)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in compressors.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0, True
    (best, lang), (next_, _) = sizes[:2]
    margin = (next_ - best) / next_
    return lang, 1 - 0.5 * math.exp(-8 * margin), margin >= MARGIN


def identify(
    docs: DataFrame, content: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The kept columns with lang_pred, score (0 to 1) and lang_accepted.

    A text's language is the one whose dictionary compresses it to the fewest bytes, ties to the
    smaller name; score rises from a half with the margin to the next one. lang_accepted is false
    where the margin is narrow. Null texts and those without a letter are `und` with score 0, as is
    every text if no language is known. One row per document; long texts are compressed piece by
    piece; there is no shuffle. A text that is kept goes to the workers once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)
    place = keep.index(text) if text in keep else len(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [_decide(t, compressors) for t in batch.column(place).to_pylist()]
                new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                names = [*keep, "lang_pred", "score", "lang_accepted"]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, lang_accepted boolean"
    more = [] if text in keep else [F.col(text).alias(free_name(docs, "text_"))]
    return docs.select(*keep, *more).mapInArrow(predict, schema)
