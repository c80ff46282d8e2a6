"""Corpus profiles: terms, tokens, lengths, endings, labels, cross tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.functions.stats import col
from tallyframe.functions.text import split_markers, strip
from tallyframe.operators.ordering import numbered
from tallyframe.storage import durable


def contains_any(text: Column | str, terms: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [col(text).contains(t) for t in terms], F.lit(False))


def contains_all(text: Column | str, terms: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [col(text).contains(t) for t in terms], F.lit(True))


def term_table(df: DataFrame, terms: list[str], by: list[str], text: str = "text") -> DataFrame:
    """Per group and term: rows that contain the term, rows of the group, percent. One scan for all terms."""
    hits = F.array(*(F.struct(F.lit(t).alias("term"), F.count_if(F.col(text).contains(t)).alias("rows")) for t in terms))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), hits.alias("hits"))
    out = out.select(*by, "n", F.explode("hits").alias("h")).select(*by, "h.term", "h.rows", "n")
    return out.withColumn("pct", stats.percent("rows", "n"))


def term_contrast(df: DataFrame, terms: list[str], first: Column, second: Column, text: str = "text") -> DataFrame:
    """Per term: counts and percent in two groups of rows, and the difference in points."""
    aggs = [
        F.struct(F.lit(t).alias("term"), F.count_if(first & F.col(text).contains(t)).alias("rows_1"), F.count_if(second & F.col(text).contains(t)).alias("rows_2"))
        for t in terms
    ]
    rows = df.agg(F.count_if(first).alias("n_1"), F.count_if(second).alias("n_2"), F.array(*aggs).alias("t"))
    rows = rows.select("n_1", "n_2", F.explode("t").alias("t")).select("t.*", "n_1", "n_2")
    p, q = stats.percent("rows_1", "n_1"), stats.percent("rows_2", "n_2")
    return rows.withColumn("pct_1", p).withColumn("pct_2", q).withColumn("diff_pp", p - q)


def pair_table(df: DataFrame, pairs: list[tuple[str, str]], by: list[str], text: str = "text") -> DataFrame:
    """Per group and pair of terms: rows that contain both."""
    hits = F.array(
        *(F.struct(F.lit(a).alias("term_1"), F.lit(b).alias("term_2"), F.count_if(contains_all(text, [a, b])).alias("rows")) for a, b in pairs)
    )
    out = df.groupBy(*by).agg(hits.alias("hits"))
    return out.select(*by, F.explode("hits").alias("h")).select(*by, "h.*")


def label_table(df: DataFrame, labels: dict[str, list[str]], by: list[str], text: str = "text") -> DataFrame:
    """Per group and label: rows that contain any of the label's terms; a row may have several labels."""
    hits = F.array(*(F.struct(F.lit(k).alias("label"), F.count_if(contains_any(text, v)).alias("rows")) for k, v in labels.items()))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), hits.alias("hits"))
    out = out.select(*by, "n", F.explode("hits").alias("h")).select(*by, "h.label", "h.rows", "n")
    return out.withColumn("pct", stats.percent("rows", "n"))


def particle_table(df: DataFrame, particle: Column, target: Column) -> DataFrame:
    """2x2 of a particle and a target class, with conditional shares and chi-squared by Yates."""
    rows = df.agg(
        F.count_if(particle & target).alias("a"),
        F.count_if(particle & ~target).alias("b"),
        F.count_if(~particle & target).alias("c"),
        F.count_if(~particle & ~target).alias("d"),
    )
    return rows.select(
        *"abcd",
        stats.percent("a", F.col("a") + F.col("b")).alias("target_given_particle"),
        stats.percent("a", F.col("a") + F.col("c")).alias("particle_given_target"),
        stats.chi2_yates(*"abcd").alias("chi2_yates"),
        stats.cramers_v(stats.chi2_yates(*"abcd"), F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("cramers_v"),
    )


def top_tokens(df: DataFrame, pattern: str, k: int, by: list[str], stop: list[str] = (), text: str = "text") -> DataFrame:
    """The k most frequent tokens of each group, ties by token; counted before they are ranked."""
    token = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    counts = df.select(*by, token.alias("token")).where(~F.col("token").isin(list(stop)) if stop else F.lit(True))
    counts = counts.groupBy(*by, "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def length_histogram(df: DataFrame, edges: list[int], by: list[str], text: str = "text") -> DataFrame:
    """Rows per length bucket, in code points; bucket i holds lengths below edges[i]."""
    size = F.length(text)
    bucket = sum((F.when(size >= e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = df.where(F.col(text).isNotNull()).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("rows"))
    return rows


def tail_ngrams(df: DataFrame, size: int, k: int, text: str = "text") -> DataFrame:
    """The k most frequent endings of `size` characters, of stripped texts that are long enough; ties by ending."""
    bare = strip(text)
    rows = df.select(bare.alias("bare")).where(F.length("bare") >= size)
    counts = rows.groupBy(F.right("bare", F.lit(size)).alias("ending")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "ending").limit(k)


def value_counts(df: DataFrame, column: str, order: str, k: int) -> DataFrame:
    """The k most frequent values; ties in the order in which they first occur."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)


def marker_patterns(df: DataFrame, column: str, k: int, sep: str = ",") -> DataFrame:
    """The k most frequent sequences of markers, with their length; rows without markers do not count."""
    parts = split_markers(column, sep)
    rows = df.select(parts.alias("parts")).where(F.size("parts") > 0)
    counts = rows.groupBy(F.array_join("parts", sep).alias("pattern")).agg(F.count("*").alias("n"), F.first(F.size("parts")).alias("markers"))
    return counts.orderBy(F.desc("n"), "pattern").limit(k)


def mentions(df: DataFrame, names: list[str], first: str, second: str) -> DataFrame:
    """Per name: rows that mention it in either of two texts."""
    found = lambda c, x: F.coalesce(F.col(c).contains(x), F.lit(False))
    hits = F.array(*(F.struct(F.lit(x).alias("name"), F.count_if(found(first, x) | found(second, x)).alias("rows")) for x in names))
    return df.agg(hits.alias("h")).select(F.explode("h").alias("h")).select("h.*")


def source_table(df: DataFrame, by: str, cell: str, cells: list[str], target: list[str], positive: list[str], k: int = 20) -> DataFrame:
    """The k groups with the most rows: counts by cell, all rows, and the shares of target and of positive cells in percent."""
    part = lambda names: F.count_if(F.col(cell).isin(names))
    rows = df.where(F.col(cell).isin(cells)).groupBy(by).agg(*(part([c]).alias(c) for c in cells), F.count("*").alias("n"), part(target).alias("t_"), part(positive).alias("p_"))
    rows = rows.withColumn("target_pct", stats.percent("t_", "n")).withColumn("positive_pct", stats.percent("p_", "n")).drop("t_", "p_")
    return rows.orderBy(F.desc("n"), by).limit(k)


def audit(df: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """Values of each column with their counts, from one grouping of all columns' values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    counts = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)


def wide_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A row per group and a column per value, with counts."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def guarded_table(df: DataFrame, by: str, target: Column, positive: Column, least: int = 5) -> DataFrame:
    """2x2 per group with Yates' chi-squared and odds ratio, for groups with `least` rows in both arms."""
    rows = df.groupBy(by).agg(
        F.count_if(target & positive).alias("a"),
        F.count_if(target & ~positive).alias("b"),
        F.count_if(~target & positive).alias("c"),
        F.count_if(~target & ~positive).alias("d"),
    )
    rows = rows.where((F.col("a") + F.col("b") >= least) & (F.col("c") + F.col("d") >= least))
    return rows.withColumn("chi2_yates", stats.chi2_yates(*"abcd")).withColumn("odds_ratio", stats.plain_odds_ratio(*"abcd"))


def share_of_total(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group and their share of all rows in percent; the total is of groups, not of rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", stats.percent("n", "total"))


def exclusive_values(df: DataFrame, column: str, first: Column, second: Column, k: int) -> DataFrame:
    """Values among the k most frequent of one group of rows and not of the other."""

    def top(cond: Column, name: str) -> DataFrame:
        counts = df.where(cond).groupBy(column).agg(F.count("*").alias("n"))
        return counts.orderBy(F.desc("n"), column).limit(k).select(column, F.lit(name).alias("group"))

    a, b = top(first, "first"), top(second, "second")
    return a.join(b, column, "left_anti").unionByName(b.join(a, column, "left_anti"))


def variant_pairs(vocabulary: DataFrame, rules: list[tuple[str, Column]], marker: str = "marker", n: str = "n", least: int = 1) -> DataFrame:
    """Markers of which a rewritten form is in the vocabulary too: rule, both forms, counts.

    Each unordered pair is given once, for the first rule that yields it, with the sum of both counts
    (`together`), by which reports are sorted.
    """
    forms = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("rule"), form.alias("form")) for i, (name, form) in enumerate(rules)))
    # Written once: both sides of the join read it.
    rows = durable(vocabulary.where(F.col(n) >= least).select(F.col(marker).alias("marker"), F.col(n).alias("n")))
    made = rows.select("marker", "n", F.explode(forms).alias("r")).where(F.col("r.form").isNotNull() & (F.col("r.form") != F.col("marker")))
    other = rows.select(F.col("marker").alias("form"), F.col("n").alias("form_n"))
    found = made.select("marker", "n", "r.i", "r.rule", F.col("r.form").alias("form")).join(other, "form")
    pair = [F.least("marker", "form").alias("lo"), F.greatest("marker", "form").alias("hi")]
    best = found.groupBy(*pair).agg(F.min_by(F.struct("rule", "marker", "form", "n", "form_n"), F.struct("i", "marker")).alias("p"))
    return best.select("p.*", (F.col("p.n") + F.col("p.form_n")).alias("together"))


def placed_by(df: DataFrame, by: list[str], amount: str, ties: list[str]) -> DataFrame:
    """df with each row's place, from 1, in its group: the largest amount first, ties by further columns."""
    rows = numbered(df.withColumn("less_", -F.col(amount)), ["less_", *ties], tuple(by), "place")
    return rows.withColumn("place", F.col("place").cast("long") + 1).drop("less_")


def affix_variants(vocabulary: DataFrame, prefixes: list[str], marker: str = "marker", by: str = "class") -> DataFrame:
    """Markers whose form with a prefix is in the same class."""
    a = vocabulary.select(F.col(by), F.col(marker).alias("base"), F.explode(F.array(*(F.concat(F.lit(p), F.col(marker)) for p in prefixes))).alias("variant"))
    return a.join(vocabulary.select(F.col(by), F.col(marker).alias("variant")), [by, "variant"], "left_semi").select(by, "base", "variant")


def ordered_rates(df: DataFrame, by: str, order: list[str], positive: Column) -> DataFrame:
    """Rows, hits and percent of the groups of a fixed order; absent groups have 0."""
    groups = df.sparkSession.createDataFrame([(g, i + 1) for i, g in enumerate(order)], f"`{by}` string, ord int")
    counts = df.where(F.col(by).isin(order)).groupBy(by).agg(F.count("*").alias("n"), F.count_if(positive).alias("hits"))
    out = groups.join(counts, by, "left").fillna(0, ["n", "hits"])
    return out.withColumn("pct", stats.percent("hits", "n"))
