"""Test tables in the shape of the engine's inputs: judgments, cells, markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import judgments as J
from tallyframe.registry import table

KEY = ["okey", "lnum", "arm"]
RATERS = ["r1", "r2", "r3"]
ORDER = ["shipdate", "partkey", "suppkey", "quantity", "price", "discount", "tax", "flag"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def raw_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as judged items, with repeats of keys: three raters' votes and a probability."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("lnum"),
        F.col("l_linestatus").alias("arm"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_suppkey").alias("suppkey"),
        (F.col("l_suppkey") % 25).alias("book"),
        F.col("l_shipdate").alias("shipdate"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_discount") >= 0.05).alias("r1"),
        (F.col("l_quantity") > 25).alias("r2"),
        (F.col("l_tax") >= 0.04).alias("r3"),
        (F.col("l_discount") * 10).alias("p"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key, the last of its repeats."""
    rows = raw_judgments(spark, sf_dir)
    return J.dedupe(rows, KEY, ORDER).select(*KEY, "flag", "book", "discount", "quantity", "tax", "p", *RATERS)


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key and rater."""
    votes = F.explode(F.create_map(*(x for r in RATERS for x in (F.lit(r), F.col(r))))).alias("rater", "judgment")
    return wide(spark, sf_dir).select(*KEY, "flag", "book", "p", votes)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with all votes: key, votes, vote_sum."""
    return J.panel_votes(long(spark, sf_dir), [*KEY, "flag", "book", "p"], RATERS)


def items_twice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All items, and all of them judged again: every vote on a seventh of the orders is the other way."""
    rows = items(spark, sf_dir)
    turned = F.when(F.col("okey") % 7 == 0, F.lit(len(RATERS)) - F.col("vote_sum")).otherwise(F.col("vote_sum"))
    return rows, rows.withColumn("vote_sum", turned)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in four cells of quality and toxicity."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    cell = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "I").when((F.col("quality") == 1) & (F.col("toxic") == 1), "II")
    cell = cell.when((F.col("quality") == 0) & (F.col("toxic") == 0), "III").when((F.col("quality") == 0) & (F.col("toxic") == 1), "IV")
    return table(spark, sf_dir, "documents").join(labels, "doc_id").withColumn("cell", cell).where("cell is not null")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their last lower-case Latin word as marker."""
    docs = table(spark, sf_dir, "documents")
    word = F.regexp_extract(F.reverse("text"), r"^[^A-Za-z]*+([A-Za-z]+)", 1)
    return docs.select("doc_id", "lang", "source", F.coalesce(F.lower(F.reverse(word)), F.lit("")).alias("marker"))


#: The same tables in SQL, written independently.
SQL_WIDE = """
jraw AS (SELECT l_orderkey AS okey, l_linenumber AS lnum, l_linestatus AS arm, l_returnflag AS flag, l_suppkey % 25 AS book,
    l_discount >= 0.05 AS r1, l_quantity > 25 AS r2, l_tax >= 0.04 AS r3, l_discount * 10 AS p,
    l_discount AS discount, l_quantity AS quantity, l_tax AS tax,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_linestatus ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
      l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC) AS back
  FROM lineitem),
j AS (SELECT * EXCLUDE (back), r1::INT + r2::INT + r3::INT AS vs FROM jraw WHERE back = 1)"""
SQL_LONG = SQL_WIDE + """,
jl AS (SELECT okey, lnum, arm, flag, book, p, 'r1' AS rater, r1 AS judgment FROM j
  UNION ALL SELECT okey, lnum, arm, flag, book, p, 'r2', r2 FROM j UNION ALL SELECT okey, lnum, arm, flag, book, p, 'r3', r3 FROM j)"""
SQL_CELLS = """
c AS (SELECT d.*, CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 'I' ELSE 'II' END ELSE CASE WHEN toxic = 0 THEN 'III' ELSE 'IV' END END AS cell,
    quality, toxic FROM documents d JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND toxic IN (0, 1))"""
SQL_MARKERS = r"""
m AS (SELECT doc_id, lang, source, coalesce(regexp_extract(lower(regexp_replace(text, '[^A-Za-z]+$', '')), '([a-z]+)$', 1), '') AS marker FROM documents)"""
