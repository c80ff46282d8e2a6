"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import checked, durable, fields, free_name

#: Pages with a few digests each that may be broadcast.
BROADCAST_PAGES = 500_000
#: A line on more than this share of a host's pages is boilerplate, if it is on so many pages at least.
RATIO, LEAST = 0.08, 3
#: White space that a blank line may have; its end is not part of a line.
BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _digest(line: Column) -> Column:
    """Identity of a line without the spaces around it; null for a blank line."""
    return F.when(F.btrim(line, F.lit(BLANK)) != "", F.xxhash64(F.trim(line)))


def boilerplate(docs: DataFrame, ratio: float = RATIO, text: str = "text", host: str = "source", least: int = LEAST) -> DataFrame:
    """Lines that exceed the ratio at their host: (site, line digest, pages).

    The ratio is that of pages that hold the line to all pages of the host; a line on fewer than
    `least` pages is no boilerplate however small the host is. A page counts once for a line however
    often it holds it. Counts are pre-aggregated per task and keyed by host and line, so a host with a
    third of all pages is spread over all tasks; only a line on very many pages of one host is one
    key, and it arrives as one partial count per task.
    """
    site = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    pages = docs.groupBy(site.alias("site")).agg(F.count("*").alias("total"))
    seen = F.array_distinct(F.filter(F.transform(_lines(F.col(text)), _digest), lambda d: d.isNotNull()))
    counts = docs.select(site.alias("site"), F.explode(seen).alias("line")).groupBy("site", "line").agg(F.count("*").alias("pages"))
    often = F.col("pages") > ratio * F.col("total")
    return counts.where(F.col("pages") >= least).join(pages, "site").where(often).select("site", "line", "pages")


def _kept(places: Column) -> Column:
    """For sorted places of lines to drop, whether each line up to the last of them stays: one pass over lines and places."""
    gap = lambda i: F.get(places, i) - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1
    runs = F.transform(F.sequence(F.lit(0), F.size(places) - 1), lambda i: F.concat(F.array_repeat(F.lit(True), gap(i)), F.array(F.lit(False))))
    return F.flatten(runs)


def drop_lines(
    docs: DataFrame,
    ratio: float = RATIO,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    least: int = LEAST,
) -> DataFrame:
    """docs with boilerplate lines taken out of their text, and n_lines and n_dropped.

    A host's boilerplate lines number at most its mean lines per page over the ratio. Digests of each
    page's lines are matched with the boilerplate by a join that may split hot lines, and only the
    places of those found come back to the page, as one flag per line, so a page takes time in
    proportion to its lines. Every document stays, with the other lines in order; one that holds
    boilerplate only becomes the empty text. Null text stays null with 0 lines; blank lines (ASCII
    white space only) always stay; pages with a null host form one host; repeated rows are separate
    pages that are treated alike; an empty table stays empty. Columns of docs named like an added one
    get "_".
    """
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    site = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    key = [F.xxhash64(doc_id, text, host).alias("k1"), F.xxhash64(F.lit(1), doc_id, text, host).alias("k2")]
    found = durable(boilerplate(docs, ratio, text, host, least))
    lines = docs.select(*key, site.alias("site"), F.posexplode(F.transform(_lines(F.col(text)), _digest)).alias("at", "line")).where("line is not null")
    hits = lines.join(found.select("site", "line"), ["site", "line"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("places"))
    hits = durable(hits).select("k1", "k2", F.size("places").cast("long").alias("dropped"), _kept(F.col("places")).alias("kept"))
    hits = durable(hits)

    rows = docs.select(*key, F.struct(*fields(docs)).alias("row")).join(checked(hits, BROADCAST_PAGES), ["k1", "k2"], "left")
    body = _lines(F.col("row")[text])
    keep = F.filter(body, lambda line, i: F.coalesce(F.get(F.col("kept"), i), F.lit(True)))
    cleaned = F.when(F.col("dropped").isNull(), F.col("row")[text]).otherwise(F.array_join(keep, "\n"))
    size = F.when(F.col("row")[text].isNull(), F.lit(0)).otherwise(F.size(body)).cast("long")
    out = [cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*out, size.alias(n_lines), F.coalesce("dropped", F.lit(0).cast("long")).alias(n_dropped))
