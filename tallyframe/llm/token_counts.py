"""Token counts by a unigram model over a public vocabulary, with a trie walk of distinct pre-tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a Python worker remembers before it starts afresh, and rows that it takes at once.
MEMORY, ROWS = 400_000, 2048
#: Pre-tokens of up to so many bytes are walked level by level of their trie, longer ones byte by byte.
SHORT = 40
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file with a base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def unigram(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities by Zipf's law on the rank: the vocabulary publishes ranks, not frequencies.

    Each of the 256 bytes must be a piece, so that every text can be segmented.
    """
    total = sum(1 / (r + 1) for r in ranks.values())
    return {piece: -math.log((r + 1) * total) for piece, r in ranks.items()}


def walk(words: Iterable[bytes], scores: dict[bytes, float], longest: int) -> dict[bytes, int]:
    """Tokens of each distinct word's best segmentation.

    Sorted words are the paths of a trie in depth-first order. forward[i] is the state of the node at
    depth i: the best score of any segmentation of the prefix and, among equal ones, the fewest
    tokens. A word shares the nodes of its common prefix with the word before, so each node of the
    trie is computed once; a word's terminal node holds its count.
    """
    counts: dict[bytes, int] = {}
    forward: list[tuple[float, int]] = [(0.0, 0)]
    before = b""
    for word in sorted(words):
        del forward[len(commonprefix((before, word))) + 1 :]
        for end in range(len(forward), len(word) + 1):
            best, fewest = -math.inf, 0
            for start in range(max(0, end - longest), end):
                piece = scores.get(word[start:end])
                if piece is not None:
                    score, tokens = forward[start]
                    score += piece
                    if score > best or (score == best and -tokens - 1 > fewest):
                        best, fewest = score, -tokens - 1
            forward.append((best, -fewest))
        counts[word] = forward[len(word)][1]
        before = word
    return counts


class Pieces:
    """The vocabulary by length of piece, as sorted hashes with their scores."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.scores, self.longest = scores, max(map(len, scores), default=0)
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({*map(len, scores)}):
            if n <= SHORT:
                same = [p for p in scores if len(p) == n]
                made = np.zeros(len(same), np.uint64)
                for column in np.frombuffer(b"".join(same), np.uint8).reshape(-1, n).T:
                    made = made * _BASE + column + np.uint64(1)
                order = np.argsort(made)
                self.by[n] = made[order], np.array([scores[p] for p in same])[order]

    def count(self, words: list[bytes]) -> list[int]:
        """Tokens of each distinct word's best segmentation, as walk() has them.

        All words of up to SHORT bytes are one trie, its nodes of one depth being the distinct prefixes
        of that length. A level's nodes are scored at once from the levels above: each piece that
        ends at a node starts at an ancestor, whose score is shared by all words below it.
        """
        out = np.zeros(len(words), np.int64)
        long_ = [i for i, w in enumerate(words) if len(w) > SHORT]
        if long_:
            found = walk([words[i] for i in long_], self.scores, self.longest)
            out[long_] = [found[words[i]] for i in long_]
        short = np.array([i for i, w in enumerate(words) if 0 < len(w) <= SHORT], np.int64)
        if not len(short):
            return out.tolist()
        letters = np.frombuffer(b"".join(words[i].ljust(SHORT, b"\0") for i in short.tolist()), np.uint8).reshape(-1, SHORT)
        size = np.array([len(words[i]) for i in short.tolist()])
        prefix, node = np.zeros(len(short), np.uint64), np.zeros(len(short), np.int64)
        power = np.cumprod(np.full(SHORT + 1, _BASE, np.uint64), dtype=np.uint64)  # power[n - 1] belongs to n bytes
        hashes, above, score, tokens = [np.zeros(1, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        for depth in range(1, int(size.max()) + 1):
            alive = np.flatnonzero(size >= depth)
            prefix[alive] = prefix[alive] * _BASE + letters[alive, depth - 1] + np.uint64(1)
            level, first, place = np.unique(prefix[alive], return_index=True, return_inverse=True)
            hashes.append(level)
            above.append(node[alive[first]])
            node[alive] = place
            best, fewest, up = np.full(len(level), -math.inf), np.zeros(len(level), np.int64), np.arange(len(level))
            for n in range(1, depth + 1):
                up = above[depth - n + 1][up]
                if n not in self.by:
                    continue
                known, values = self.by[n]
                piece = level - hashes[depth - n][up] * power[n - 1]
                at = np.minimum(np.searchsorted(known, piece), len(known) - 1)
                total, used = score[depth - n][up] + values[at], tokens[depth - n][up] + 1
                take = (known[at] == piece) & ((total > best) | ((total == best) & (used < fewest)))
                best, fewest = np.where(take, total, best), np.where(take, used, fewest)
            score.append(best)
            tokens.append(fewest)
            ends = alive[size[alive] == depth]
            out[short[ends]] = fewest[node[ends]]
        return out.tolist()


def count_tokens(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each whole text.

    Texts are split by a Spark function. A worker takes the distinct pre-tokens of ROWS documents at
    once, puts those that it does not know into one trie (Pieces.count), and keeps their counts up to
    a fixed number. The vocabulary is broadcast; its size is that of its file. No shuffle, and memory
    is bounded. Null and empty texts count 0; one row per document, repeated rows included; an empty
    table gives no rows. A pre-token of n bytes takes at most n times the longest piece's length in
    steps, so very long ones are linear.
    """
    shared = docs.sparkSession.sparkContext.broadcast(unigram(ranks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = Pieces(shared.value), {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                coded = pc.dictionary_encode(batch.column(1).flatten())
                words = coded.dictionary.to_pylist()
                if len(known) > MEMORY:
                    known = {}
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, pieces.count([w.encode() for w in fresh]), strict=True))
                each = np.array([known[w] for w in words], np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
                sizes = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
                upto, ends = np.concatenate([[0], np.cumsum(each)]), np.cumsum(sizes)
                tokens = upto[ends] - upto[ends - sizes]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens)], ["doc_id", "n_pretokens", "n_tokens"])

    kind = dict(docs.dtypes)[doc_id]
    # With (?U) white space is that of Unicode, as in the published pattern's own notation.
    split = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?U)" + pattern), F.lit(0))
    return docs.select(doc_id, split.alias("split")).mapInArrow(count, f"doc_id {kind}, n_pretokens long, n_tokens long")
