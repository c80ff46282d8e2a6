"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import durable, fields, word_count

#: Ranges of virtual finish time per unit, and parts of each; the budget is reached near time 1.
RANGES, PARTS = 1 << 10, 1 << 10


def _source_key(source: Column) -> Column:
    """Text that sorts sources by code point, null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _range(finish: Column) -> Column:
    """Number of a finish time's range; ranges widen from time 2 on, so that there are some thousands at most."""
    late = 2 * RANGES + F.floor(F.log2(F.greatest(finish, F.lit(2.0))) * 16)
    return F.when(finish < 2, F.floor(finish * RANGES)).otherwise(late)


def _part(finish: Column) -> Column:
    """Number of a finish time's part of its range."""
    return F.floor(finish * (RANGES * PARTS))


def _crossing(copies: DataFrame, place: str, start: DataFrame) -> DataFrame:
    """First place at which the running words exceed the budget: cut, words before it, budget; nulls if none does.

    start has one row: words before all of copies, and the budget. Words are summed per place first.
    """
    every = Window.partitionBy(F.lit(0)).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    sums = copies.groupBy(place).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(every))
    sums = sums.join(F.broadcast(start)).withColumn("upto", F.col("upto") + F.col("before")).where("upto > budget")
    return sums.agg(F.min(place).alias("cut"), F.min_by(F.col("upto") - F.col("words"), place).alias("before"), F.max("budget").alias("budget"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source key: source_size and target words.

    sizes has columns sk and size. Sources in order of sk weigh weights[0], weights[1], ... in
    rotation and share all words; a target stops at cap times its source's size and the excess goes
    to the others by weight. With sources in order of size per weight, the capped ones are those
    that come first, so one pass of running sums over the sources finds the level at which the rest
    share. Works on one row per source, pre-aggregated. A corpus without words has targets 0.
    """
    rows = sizes.groupBy("sk").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    k = F.row_number().over(every.orderBy("sk")) - 1
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int")).cast("double"))
    size = F.col("source_size").cast("double")
    fill = every.orderBy(size / F.col("w"), "sk")
    until, left = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    rows = (
        rows.withColumn("all_words", F.sum("source_size").over(every).cast("double"))
        .withColumn("used", F.coalesce(F.sum("source_size").over(until), F.lit(0)).cast("double"))
        .withColumn("w_left", F.sum("w").over(left))
        .withColumn("capped", cap * size * F.col("w_left") <= F.col("w") * (F.col("all_words") - cap * F.col("used")))
        .withColumn("used", F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(every).cast("double"))
        .withColumn("w_left", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every))
    )
    share = (F.col("all_words") - cap * F.col("used")) * F.col("w") / F.col("w_left")
    return rows.select("sk", "source_size", F.when(F.col("capped"), cap * size).otherwise(share).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: str = "mix-1",
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    carry: bool = False,
) -> DataFrame:
    """Words that a mixture at target weights takes of each document.

    Documents of a source are shuffled by a seeded MD5 of their id and text; a source's pass may repeat, up to
    cap times. A copy's virtual finish time is the words of its source up to its end, over the
    source's target. Copies are dealt into narrow ranges of finish time, and the mix takes them in
    order until the next one would exceed the budget, which is the number of words of all documents.
    Running sums are kept per source and hash range, so that a hot source is never one group.

    Returns one row per document: doc_id, size, source_size, target, taken (words, repeats counted);
    with carry, all columns of docs, then size, source_size, target, copies and taken, for those
    with a copy taken. Null text has size 0; null sources are one source, last in order; repeated
    rows are separate documents; documents without words are taken 0 times; an empty table gives no
    rows. Ties in finish time go by source, then place in the shuffle. Names of docs that clash with
    the added columns are kept under the given name with the prefix "in_".
    """
    # The text is part of it, so that rows of one id, or of none, are spread, too.
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    keyed = docs.select(
        F.struct(*fields(docs)).alias("row"),
        F.col(doc_id).alias("id"),
        _source_key(F.col(source)).alias("sk"),
        hashed.alias("h"),
        word_count(F.col(text)).alias("size"),
    )
    slim = durable(keyed.drop("row"))
    shares = durable(targets(slim, weights, cap))
    piece = F.substring("h", 1, 3)
    pieces = slim.groupBy("sk", piece.alias("piece")).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sk").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(
        pieces.withColumn("offset", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words").join(shares, "sk")
    )

    def placed(rows: DataFrame) -> DataFrame:
        """end: words of the source up to the row's end, in one pass."""
        within = Window.partitionBy("sk", "piece").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("piece", piece).withColumn("end", F.sum("size").over(within))
        return rows.join(offsets, ["sk", "piece"]).withColumn("end", F.col("end") + F.col("offset"))

    slim = durable(placed(slim))
    passes = F.array(*(F.lit(e).cast("long") for e in range(cap)))
    finish = (F.col("e") * F.col("source_size") + F.col("end")) / F.col("target")
    copies = (
        slim.where("size > 0 and target > 0")
        .select("sk", "end", "size", "source_size", "target", F.explode(passes).alias("e"))
        .withColumn("finish", finish)
        .withColumn("range", _range(F.col("finish")))
        .withColumn("part", _part(F.col("finish")))
    )
    start = shares.agg(F.lit(0).cast("long").alias("before"), F.sum("source_size").alias("budget"))
    coarse = durable(_crossing(copies, "range", start).withColumnRenamed("cut", "cut_range"))
    inside = copies.join(F.broadcast(coarse.select("cut_range")), F.col("range") == F.col("cut_range"))
    fine = durable(_crossing(inside, "part", coarse.drop("cut_range")).withColumnRenamed("cut", "cut_part"))
    queue = Window.partitionBy("part").orderBy("finish", "sk", "end").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        inside.join(F.broadcast(fine), F.col("part") == F.col("cut_part"))
        .withColumn("upto", F.col("before") + F.sum("size").over(queue))
        .where("upto <= budget")
        .agg(F.max(F.struct("finish", "sk", "end")).alias("last"))
    )
    edge = durable(coarse.select("cut_range").join(fine.select("cut_part")).join(last))

    rows = (placed(keyed) if carry else slim).join(F.broadcast(edge))

    def taken(e: int) -> Column:
        at = (F.lit(e).cast("long") * F.col("source_size") + F.col("end")) / F.col("target")
        ranged, parted = _range(at), _part(at)
        ahead = (ranged < F.col("cut_range")) | ((ranged == F.col("cut_range")) & (parted < F.col("cut_part")))
        inside = (ranged == F.col("cut_range")) & (parted == F.col("cut_part"))
        inside = inside & (F.struct(at.alias("finish"), "sk", "end") <= F.col("last"))
        return F.when(F.col("cut_range").isNull() | ahead | F.coalesce(inside, F.lit(False)), 1).otherwise(0)

    n = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((taken(e) for e in range(cap)), F.lit(0))).otherwise(0)
    rows = rows.withColumn("copies", n.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    added = ["size", "source_size", "target", "copies", "taken"]
    if carry:
        kept = [F.col("row")[c].alias(f"in_{c}" if c in added else c) for c in docs.columns]
        return rows.where("copies > 0").select(*kept, *added)
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
