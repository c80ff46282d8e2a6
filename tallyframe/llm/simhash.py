"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, classes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import checked, components, durable, fields, free_name, unique_nodes

SEED = 42
#: Blocks of more fingerprints than this are searched by neighbourhoods instead of pairs.
CROWD = 64
#: Stage on word shingles: words of a shingle, and least similarity of a link. It is the cosine of two sets, which is
#: what SimHash bits measure: shared shingles over the geometric mean of the sizes.
SHINGLE, SIMILAR = 5, 0.8
#: Least share of a set's shingles that another of that similarity holds.
SHARE = SIMILAR * SIMILAR
#: Wide fingerprint of that stage: blocks, and shingles sampled for each; blocks of up to PAIRED texts give all pairs.
BLOCKS, SAMPLED, PAIRED = 24, 3, 12
#: Texts of a crowded block that a group compares with all others of it, and the ratio of sizes that parts such a block.
CELL, BAND = 256, 1.25
#: Sets of up to so many shingles have exact keys besides the blocks.
SMALL = 12
#: Bits in which the 64-bit fingerprints of two texts at the least similarity may differ: the mean is 13, the deviation 3.
FAR_BITS = 30
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, in order; of all words if there are fewer; none without words.

    Words are what ASCII white space divides, with A-Z lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    return np.fromiter((digest(body[a:b], SEED) for a, b in pairs), np.uint64, len(words) - last)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit number; 0 for no hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint (long) of each whole text; null and empty texts have fingerprint 0."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [fingerprint(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(add, f"doc_id {kind}, fingerprint long")


def close_pairs(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most two bits.

    Four blocks of 16 bits: two changed bits leave at least two blocks alike, so close fingerprints
    share one of the six pairs of blocks. Fingerprints are joined on these and verified by Hamming
    distance. Where more than CROWD share a pair of blocks, pairs would grow with the square of the
    crowd; its members are listed instead under each value that differs from them in one bit or
    none. Those listed under one value are within two bits of each other, and any two within two
    bits are listed together under some value, so linking all of a list to its least member loses
    no connection and takes 65 rows a fingerprint.

    prints has one long column, fingerprint, without repeats.
    """
    blocks = [F.shiftright(F.col("fingerprint"), 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    keys = [
        F.struct(F.lit(4 * i + j).alias("pair"), (blocks[i] * 65536 + blocks[j]).alias("value"))
        for i in range(4)
        for j in range(i + 1, 4)
    ]
    rows = prints.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    sizes = durable(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = durable(rows.join(sizes, "key"))
    few = rows.where(F.col("n") <= CROWD)
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    left, right = few.select("key", F.col("fingerprint").alias("a")), few.select("key", F.col("fingerprint").alias("b"))
    pairs = left.join(right, "key").where("a < b").where(distance <= 2).select("a", "b")
    crowd = rows.where(F.col("n") > CROWD).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = crowd.select("fingerprint", F.explode(F.transform(flips, lambda f: F.col("fingerprint").bitwiseXOR(f))).alias("value"))
    least = near.groupBy("value").agg(F.min("fingerprint").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    hubs = near.join(least, "value").where("a <> fingerprint").select("a", F.col("fingerprint").alias("b"))
    return pairs.union(hubs).distinct()


def classes(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over close links.

    Copies meet in one fingerprint before any link is sought. One row per document, repeated rows
    included; texts without words have fingerprint 0 and are one class; null ids are linked but
    never name a class unless it has no other; an empty table gives no rows.
    """
    rows = durable(fingerprints(docs, shingle, text, doc_id))
    prints = durable(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(close_pairs(prints.select("fingerprint")))
    known = prints.join(roots, prints.fingerprint == roots.node, "left")
    known = known.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(known.join(named, "root").select("fingerprint", "component_id"))
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return rows.join(named, "fingerprint").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _constants() -> tuple[np.ndarray, np.ndarray]:
    made = [xxhash.xxh64_intdigest(str(i).encode(), 5) for i in range(2 * BLOCKS)]
    return np.array(made[:BLOCKS], np.uint64)[:, None], np.array(made[BLOCKS:], np.uint64)[:, None] | np.uint64(1)


def wide_blocks(hashes: np.ndarray) -> list[int]:
    """Distinct blocks of the wide fingerprint of a set of shingles, as signed numbers.

    Each block is the SimHash of the SAMPLED shingles that come first under an order of its own. Two
    sets of Jaccard similarity s agree in a block with about s to the power SAMPLED. Sets of cosine 0.8
    have an s of 0.64 at least, so they share none of 24 blocks in seven of ten thousand cases at most.
    """
    if not len(hashes):
        return [0]
    xor, times = _constants()
    best = np.zeros((BLOCKS, 0), np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.broadcast_to(hashes[at : at + _CHUNK], (BLOCKS, len(hashes[at : at + _CHUNK])))
        best = np.concatenate([best, part], axis=1)
        if best.shape[1] > SAMPLED:
            order = (best ^ xor) * times
            best = np.take_along_axis(best, np.argpartition(order, SAMPLED - 1, axis=1)[:, :SAMPLED], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(best).view(np.uint8).reshape(BLOCKS, -1, 8), axis=2, bitorder="little")
    packed = np.packbits(2 * bits.sum(1, dtype=np.int64) > best.shape[1], axis=1, bitorder="little").view(np.int64)
    return np.unique(packed).tolist()


def small_keys(hashes: np.ndarray) -> list[int]:
    """The least hashes of a set of up to SMALL distinct shingles, so many that two such sets of similarity SIMILAR share one."""
    n = len(hashes)
    if n > SMALL:
        return []
    return np.sort(hashes)[: n - math.ceil(SHARE * n - 1e-9) + 1].view(np.int64).tolist()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = batch.column(3).to_pylist()
            sets = [np.unique(shingle_hashes(t, SHINGLE)) for t in texts]
            words = (t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts)
            both = np.frombuffer(b"".join(xxhash.xxh128_digest(b" ".join(w)) for w in words), np.int64).reshape(-1, 2)
            columns = (
                pa.array(both[:, 0]),
                pa.array(both[:, 1]),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s) for s in sets], pa.int64()),
                pa.array([list({*wide_blocks(s), *small_keys(s)}) for s in sets], pa.list_(pa.int64())),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["id", "k1", "k2", "h", "g", "n", "print", "blocks"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets = [np.unique(shingle_hashes(t, SHINGLE).view(np.int64)).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int64()))], ["k1", "k2", "shingles"])


_FACTS = ("node", "n", "print", "rest")


def _met(left: DataFrame, right: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """Pairs of rows of one block (of both tables, or of the one given) that sizes and Hamming distance leave possible, as (a, b) with a < b.

    Rows have block, node, n (shingles), print, and rest: how many shingles the two may share at most;
    with `apart` also root, which the two must not have in common.
    """
    facts = (*_FACTS, "root") if apart else _FACTS
    one, two = (df.select("block", *(F.col(c).alias(f"{c}_{side}") for c in facts)) for df, side in ((left, "a"), (right or left, "b")))
    least, most = F.least("n_a", "n_b").cast("double"), F.greatest("n_a", "n_b")
    close = (F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= FAR_BITS) | (least <= SMALL)
    shared = F.least("rest_a", "rest_b").cast("double")
    rows = one.join(two, "block").where("node_a <> node_b" if right else "node_a < node_b").where(close & (shared * shared >= SHARE * least * most))
    rows = rows.where("root_a <> root_b") if apart else rows
    return rows.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have similarity SIMILAR or more."""
    both = pairs.distinct()
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("double")
    return durable(both.where(shared * shared >= SHARE * F.size("s_a") * F.size("s_b")).select("a", "b"))


def crowd_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) among texts of crowded blocks, by their rarest shingles; nothing is left out for being many.

    With shingles in order of how many sets hold them, two sets of the least similarity share one of
    the first n - SHARE * n + 1 of either. Shingles held there by up to PAIRED texts give all pairs.
    A commoner one comes after a set's rare shingles, which the other set then lacks; texts with too
    many of these cannot be similar to any text there and leave the shingle (_by_size). Of the others the one
    with the fewest is the leader, compared with all; texts that are similar to no leader give further
    leaders, eight times as many in each round, until none are left. So every text is similar to a
    leader, or led a block itself. Texts that are then in different classes and have not led the block
    are compared with each other, so classes lack no link of these blocks.

    sets has node, n, print and shingles.
    """
    every = sets.select("node", "n", "print", F.explode("shingles").alias("block"))
    common = durable(every.groupBy("block").agg(F.count("*").alias("held")).where("held > 1"))
    mine = every.join(checked(common), "block").groupBy("node", "n", "print").agg(F.sort_array(F.collect_list(F.struct("held", "block"))).alias("shared"))
    lost = F.col("n") - F.size("shared")
    first = F.greatest(F.lit(0), (F.col("n") - F.ceil(SHARE * F.col("n") - 1e-9) + 1 - lost).cast("int"))
    rows = mine.select("node", "n", "print", lost.alias("lost"), F.posexplode(F.slice("shared", F.lit(1), first)).alias("at", "s"))
    place = F.col("lost") + F.col("at")
    rows = durable(rows.select("node", "n", "print", place.alias("place"), (F.col("n") - place).alias("rest"), F.col("s.block").alias("block")))
    sizes = durable(rows.groupBy("block").agg(F.count("*").alias("crowd"), F.min("place").alias("least")).where("crowd > 1"))
    rows = durable(rows.join(checked(sizes), "block"))
    rest = F.col("rest").cast("double")
    few = rows.where(F.col("crowd") <= PAIRED)
    many = rows.where((F.col("crowd") > PAIRED) & (rest * rest >= SHARE * F.col("n") * (rest + F.col("least")))).drop("crowd", "least")
    many = _by_size(many)
    less = many.where(F.col("crowd") <= PAIRED)
    found = _verified(_met(few).union(_met(less)), sets)
    many = durable(many.where(F.col("crowd") > PAIRED).drop("crowd"))
    open_, k, led = durable(many.select("node").distinct()), 1, many.select("block", "node").limit(0)
    while not open_.isEmpty():
        order = Window.partitionBy("block").orderBy("place", "node")
        leads = many.join(checked(open_), "node").withColumn("i", F.row_number().over(order)).where(F.col("i") <= k)
        leads = durable(leads.drop("i"))
        fresh = _verified(_met(leads, many), sets)
        done = leads.select("node").union(fresh.select("a")).union(fresh.select("b")).distinct()
        found, led, k = found.union(fresh), led.union(leads.select("block", "node")), 8 * k
        open_ = durable(open_.join(done, "node", "left_anti"))
    return found.union(_between_classes(many.join(led, ["block", "node"], "left_anti"), durable(found), sets))


def _by_size(rows: DataFrame) -> DataFrame:
    """Rows of blocks by block and size of the smaller text of a pair, without those that can be similar to no other there; crowd counts the rest.

    `block` becomes a pair of block and band of sizes. A text is in the band of its size, and below it in those of
    the smaller texts that it can be similar to. It shares no more than `rest`, so of two texts the smaller shares
    SIMILAR of its own shingles at least, and the larger is no larger than the square of what it shares allows. So of
    a crowd on one template, texts with too much of their own leave, as all others there are too large for them.
    """
    slack = 1e-9
    n, rest = F.col("n").cast("double"), F.col("rest").cast("double")
    band = lambda size: F.floor(F.log(size) / math.log(BAND)).cast("int")
    rows = rows.withColumn("most", rest * rest / (SHARE * n) * (1 + slack))
    lowest, highest = band(SHARE * n * (1 - slack)), band(F.least(n, "most"))
    rows = rows.withColumn("band", F.explode(F.sequence(lowest, F.greatest(lowest, highest))))
    rows = durable(rows.withColumn("block", F.struct("block", "band")).withColumn("small", (F.col("band") == band(n)) & (F.col("most") >= n)))
    least = durable(rows.where("small").groupBy("block").agg(F.min("n").alias("least")))
    rows = durable(rows.join(checked(least), "block").where("most >= least").drop("most", "band", "small", "least"))
    sizes = durable(rows.groupBy("block").agg(F.count("*").alias("crowd")).where("crowd > 1"))
    return durable(rows.join(checked(sizes), "block"))


def _between_classes(many: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among texts of a block that the links found leave in different classes, all such pairs being compared.

    Texts outside the largest class of a block make groups of some CELL, each of which meets all texts of the block
    once: those of the largest class are not compared with each other, and a few texts beside it are one group.
    """
    rows = many.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = durable(rows)
    held = rows.groupBy("block", "root").agg(F.count("*").alias("held")).groupBy("block")
    mixed = held.agg(F.max_by("root", F.struct("held", "root")).alias("main"), (F.sum("held") - F.max("held")).alias("others")).where("others > 0")
    rows = durable(rows.join(checked(durable(mixed)), "block"))
    cells = F.ceil(F.col("others") / CELL).cast("int")
    own, all_ = F.pmod(F.xxhash64("node"), cells).cast("int"), F.sequence(F.lit(0), cells - 1)
    one = rows.where("root <> main").withColumn("cell", own).withColumn("block", F.struct("block", "cell"))
    two = rows.withColumn("cell", F.explode(all_)).withColumn("block", F.struct("block", "cell"))
    return _verified(_met(one, two, apart=True), sets)


def similar_texts(texts: DataFrame, shingles: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between texts whose sets of five-word shingles have similarity SIMILAR or more.

    texts has node, n (shingles), print (64-bit fingerprint) and blocks; shingles gives node and
    shingles of the nodes of a table. At this similarity 13 of 64 majority bits differ, so blocks of
    bits that cannot all differ would have four bits and hold nearly everything together. Candidates
    share a block of a wider fingerprint instead (wide_blocks), and for short texts an exact key
    (small_keys). A block of up to PAIRED texts gives all pairs; the texts of larger ones are compared
    by crowd_links. Candidates are verified by Hamming distance, then by the sets themselves.
    """
    rows = texts.select("node", "n", "print", F.col("n").alias("rest"), F.explode("blocks").alias("block"))
    sizes = durable(rows.groupBy("block").agg(F.count("*").alias("crowd")).where("crowd > 1"))
    rows = durable(rows.join(checked(sizes), "block"))
    few = rows.where(F.col("crowd") <= PAIRED)
    pairs = durable(_met(few).distinct())
    crowd = durable(rows.where(F.col("crowd") > PAIRED).select("node", "n", "print").distinct())
    wanted = durable(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd.select("node")).distinct())
    sets = durable(shingles(wanted))
    found = _verified(pairs, sets)
    if crowd.isEmpty():
        return found
    return found.union(crowd_links(durable(sets.join(checked(crowd), "node")))).distinct()


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each class of near-duplicates: that of the smallest doc_id.

    Texts that have the same words are one node, so copies never meet as pairs; nodes are linked by
    similar_texts and classes are what links connect. A document without words equals others
    without words only. Null ids come last; of rows that agree in id and text, any one stays; an
    empty table stays empty; all columns are kept.
    """
    # A row is known by 128 bits of its id and text; only rows that agree in both share them.
    k1, k2 = free_name(docs, "k1"), free_name(docs, "k2")
    rows = docs.withColumn(k1, F.xxhash64(doc_id, text)).withColumn(k2, F.xxhash64(F.lit(1), doc_id, text))
    key = [F.col(k1).alias("k1"), F.col(k2).alias("k2")]
    kind = dict(docs.dtypes)[doc_id]
    sketch = rows.select(F.col(doc_id).alias("id"), *key, F.col(text).alias("text"))
    sketch = sketch.mapInArrow(_sketch, f"id {kind}, k1 long, k2 long, h long, g long, n long, print long, blocks array<long>")
    sketch = durable(sketch)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("k1"), F.col("k2")))
    texts = sketch.groupBy("h", "g").agg(first.alias("first"), *(F.first(c).alias(c) for c in ("n", "print", "blocks")))
    texts = unique_nodes(durable(texts))

    def shingles(wanted: DataFrame) -> DataFrame:
        chosen = durable(texts.join(checked(wanted), "node", "left_semi").select("node", "first.k1", "first.k2"))
        of = rows.select(*key, F.col(text).alias("text")).join(checked(chosen.drop("node")), ["k1", "k2"], "left_semi")
        sets = of.mapInArrow(_sets, "k1 long, k2 long, shingles array<long>")
        return sets.join(checked(chosen), ["k1", "k2"]).select("node", "shingles").dropDuplicates(["node"])

    roots = components(similar_texts(texts, shingles))
    known = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = known.groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2", F.lit(True).alias("keep"))
    state = durable(sketch.groupBy("k1", "k2").agg(F.count("*").alias("m")).join(kept, ["k1", "k2"], "left"))
    mine = lambda df: checked(durable(df.select(F.col("k1").alias(k1), F.col("k2").alias(k2))))
    out = rows.join(mine(state.where("keep is null")), [k1, k2], "left_anti")
    twins = state.where("keep and m > 1")
    if twins.isEmpty():
        return out.select(*fields(docs))
    twins = mine(twins)
    single = out.join(twins, [k1, k2], "left_anti")
    return single.union(out.join(twins, [k1, k2], "left_semi").dropDuplicates([k1, k2])).select(*fields(docs))
