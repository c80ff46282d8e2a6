"""Collocations by Suffix-sigma: truncated suffixes in sorted order, all their prefixes counted by one stack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import durable

#: Words of the longest phrase, least occurrences of a phrase, phrases of each language.
LONGEST, SEEN, TOP = 3, 10, 2000
#: A phrase goes if a longer one that contains it has this percentage of its occurrences.
INSIDE = 50
#: Bytes of text whose suffixes are counted together before they are shuffled.
CHUNK = 12_000_000
#: Parts of a language whose first phrases are sought side by side.
PARTS = 64
#: A-Z are lower-cased, marks and line ends become line ends, tabs become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Stands between the words of a suffix: as the least byte, it makes all suffixes of a prefix neighbours in order.
_JOINT = b"\0"


def _escaped(text: bytes) -> bytes:
    """text without _JOINT; \\1 introduces what it stood for."""
    return text.replace(b"\1", b"\1\2").replace(_JOINT, b"\1\1") if _JOINT in text or b"\1" in text else text


def _plain(text: bytes) -> bytes:
    return text.replace(b"\1\1", _JOINT).replace(b"\1\2", b"\1") if b"\1" in text else text


def _blocks(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of a folded text, cut after line ends, of `size` bytes at most unless a piece is longer."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(b"\n", at, at + size) + 1 or text.find(b"\n", at + size) + 1
        if not cut:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def suffixes(lang: str, texts: list[bytes], longest: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct suffixes of the folded texts' pieces, cut to `longest` words, in sorted order; and their counts.

    A suffix is its first word, the language and its further words, each of them empty past the end of the piece.
    """
    body = _escaped(b"\n".join(texts).replace(b"\n", b" \n "))
    coded = pa.array([w for w in body.split(b" ") if w], pa.binary()).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    words = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary.take(order)])
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(words))
    at = rank[coded.indices.to_numpy()]
    at[at == pc.index(words, pa.scalar(b"\n", pa.binary())).as_py()] = 0  # the end of a piece
    padded = np.concatenate([at, np.zeros(longest, np.int64)])
    starts = np.flatnonzero(at)
    levels = [at[starts]]
    for d in range(1, longest):
        levels.append(np.where(levels[-1] > 0, padded[starts + d], 0))
    packed = levels[0]
    for level in levels[1:]:
        if packed.max(initial=0) >= (1 << 62) // len(words):
            packed = np.unique(packed, return_inverse=True)[1]
        packed = packed * len(words) + level
    _, first, counts = np.unique(packed, return_index=True, return_counts=True)
    parts = [words.take(pa.array(level[first])) for level in levels]
    name = pa.array([_escaped(lang.encode())] * len(first), pa.binary())
    return pc.binary_join_element_wise(parts[0], name, *parts[1:], pa.scalar(_JOINT, pa.binary())), counts


def _cut(longest: int, chunk: int):
    """Function from batches of (lang, text) to batches of (suffix, n)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                keys, counts = suffixes(lang, texts, longest)
                for i in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([keys[i : i + 100_000], pa.array(counts[i : i + 100_000])], ["suffix", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                lang, text = batch.column(0)[i].as_py(), batch.column(1)[i]
                if not text.is_valid:
                    continue
                for block in _blocks(text.as_buffer().to_pybytes().translate(_FOLD), chunk):
                    held.setdefault("und" if lang is None else lang, []).append(block)
                    size += len(block)
                    if size >= chunk:
                        yield from counted()
                        held, size = {}, 0
        yield from counted()

    return cut


def _stack(longest: int, seen: int):
    """Function from sorted batches of (suffix, n) to counts of all prefixes.

    Level d of the stack is the open prefix of d words. It and all deeper levels are closed where a
    suffix differs from the one before within its first d words, and its count is the sum since it was
    opened. What is open at either end of a batch may go on beyond, so it is given out as a part. Level
    0 sums the words of each language.
    """
    names = ["lang", "phrase", "size", "f", "part"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = pc.list_flatten(pc.split_pattern(batch.column(0), _JOINT))
            step = np.arange(0, len(fields), longest + 1)
            first, lang, *further = (fields.take(pa.array(step + i)) for i in range(longest + 1))
            n = batch.column(1).to_numpy()
            differs = lambda x: np.concatenate([[True], pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)])
            opened, out = differs(lang), []
            words: list[pa.Array] = []
            for level, word in enumerate([first, *further], 1):
                words.append(word)
                opened = opened | differs(word)
                at = np.flatnonzero(opened)
                sums = np.add.reduceat(n, at)
                part = np.zeros(len(at), bool)
                part[[0, -1]] = True
                real = pc.greater(pc.binary_length(word), 0).to_numpy(zero_copy_only=False)[at]
                kept = np.flatnonzero(real & (part | (sums >= seen)))
                rows = pa.array(at[kept])
                columns = [w.take(rows).to_pylist() for w in words]
                langs = lang.take(rows).to_pylist()
                out += [(_plain(g), _plain(b" ".join(w)), level, f, p) for g, f, p, *w in zip(langs, sums[kept].tolist(), part[kept].tolist(), *columns, strict=True)]
            coded = lang.dictionary_encode()
            totals = np.bincount(coded.indices.to_numpy(), weights=n, minlength=len(coded.dictionary)).astype(np.int64)
            out += [(_plain(g), b"", 0, f, True) for g, f in zip(coded.dictionary.to_pylist(), totals.tolist(), strict=True)]
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return count


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, seen: int = SEEN, chunk: int = CHUNK) -> DataFrame:
    """lang, phrase, size (words) and f of all phrases of `longest` words at most that occur `seen` times.

    A row of size 0 has all words of its language. Suffixes are counted by chunk of text, dealt out by
    ranges of first word, language and further words, and sorted; a first word of very many suffixes
    is split between ranges like any other, and the parts of a prefix are summed afterwards.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    cut = rows.mapInArrow(_cut(longest, chunk), "suffix binary, n long")
    placed = cut.repartitionByRange("suffix").sortWithinPartitions("suffix")
    found = placed.mapInArrow(_stack(longest, seen), "lang binary, phrase binary, size int, f long, part boolean")
    found = durable(found.withColumns({c: F.col(c).cast("string") for c in ("lang", "phrase")}))
    parts = found.where("part").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= seen) | (F.col("size") == 0))
    return durable(found.where("not part").drop("part").unionByName(parts))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    seen: int = SEEN,
    inside: int = INSIDE,
    top: int = TOP,
    chunk: int = CHUNK,
) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and split at marks and line ends into pieces, and these at spaces and
    tabs into words. a counts a phrase's occurrences within pieces, `seen` at least; l and r those of its
    two parts at the cut with the least score, floor(1000000 a a / (l r)), the first among equal ones; n all
    words of the language. A phrase inside a longer one with `inside` percent of its occurrences is left
    out. Ties go by a, then by the bytes of the phrase. Null texts have no words, a null lang is und;
    repeated rows count each time; other columns are not read; an empty table gives no rows.
    """
    counts = phrase_counts(docs, text, lang, longest, seen, chunk)
    known = counts.where("size > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    phrases = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", words.alias("w"))
    joined = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda x: f"cast({x} as decimal(15,0))"  # noqa: E731  counts of 15 digits: the products are exact
    score = F.expr(f"({wide('a')} * {wide('a')} * cast(1000000 as decimal(7,0))) div ({wide('l')} * {wide('r')})")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    span = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    longer = phrases.where("size > 2").select("lang", F.col("a").alias("most"), span.alias("phrase")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < inside * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language is too large for one task, the first phrases of its parts are not.
    kept = kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for group in (["lang", "deal"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return kept.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
