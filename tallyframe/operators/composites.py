"""Smaller composite reports; the large ones are derived from a cube (operators.cube)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.operators import agreement, evidence, judgments
from tallyframe.storage import durable


def tidy(df: DataFrame, part: str, item: Column | str | None = None) -> DataFrame:
    """A table's numbers as rows of part, item, measure and value; item names the row."""
    name = F.lit("") if item is None else stats.col(item).cast("string")
    used = {"string"}
    measures = [c for c, t in df.dtypes if t not in used and c != item]
    values = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures))
    rows = df.select(F.lit(part).alias("part"), name.alias("item"), F.explode(values).alias("v")).select("part", "item", "v.*")
    return rows.where("value is not null")


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def level_tables(items: DataFrame, levels: dict[str, Column], positive: Column, target: Column, least: int = 5) -> DataFrame:
    """2x2 of target and positive by each value of each level: shares, difference, odds ratio, Yates' chi-squared, p.

    All levels are counted in one scan; values with fewer than `least` rows in an arm are left out.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), v.cast("string").alias("name")) for k, v in levels.items()))).alias("l")
    rows = items.select(pairs, positive.alias("y"), target.alias("t")).select("l.*", "y", "t")
    rows = judgments.two_by_two(rows, F.col("y"), F.col("t"), ("level", "name"))
    rows = rows.where((F.col("a") + F.col("b") >= least) & (F.col("c") + F.col("d") >= least))
    t, c = stats.percent("a", F.col("a") + F.col("b")), stats.percent("c", F.col("c") + F.col("d"))
    rows = rows.select("level", "name", *"abcd", t.alias("target_pct"), c.alias("control_pct"), (t - c).alias("diff_pp"), stats.plain_odds_ratio(*"abcd").alias("odds_ratio"), stats.chi2_yates(*"abcd").alias("chi2_yates"))
    rows = rows.withColumn("p", stats.chi2_sf("chi2_yates", F.lit(1)))
    return rows.withColumn("stars", stats.stars("p"))


def sign_by_group(items: DataFrame, book: str, group: Column, positive: Column, target: Column, least: int = 5) -> DataFrame:
    """Per group of books: books that favour the target, the control, neither, and the sign test; books with `least` rows in both arms."""
    rows = items.select(F.col(book), group.alias("group"), positive.alias("y"), target.alias("t"))
    cells = judgments.two_by_two(rows, F.col("y"), F.col("t"), ("group", book)).where((F.col("a") + F.col("b") >= least) & (F.col("c") + F.col("d") >= least))
    gap = F.col("a") * (F.col("c") + F.col("d")) - F.col("c") * (F.col("a") + F.col("b"))
    sums = cells.groupBy("group").agg(F.count_if(gap > 0).alias("wins"), F.count_if(gap < 0).alias("losses"), F.count_if(gap == 0).alias("ties"))
    return sums.withColumn("p", F.coalesce(stats.sign_test("wins", "losses"), F.lit(1.0)))


def prevalence(df: DataFrame, group: Column, marker: Column, order: list[str]) -> DataFrame:
    """Rows, marked rows and percent of the groups of a fixed order, with the ratio of the rounded rates of the first and each group."""
    counts = df.groupBy(group.alias("group")).agg(F.count("*").alias("n"), F.count_if(marker).alias("hits"))
    names = df.sparkSession.createDataFrame([(g, i + 1) for i, g in enumerate(order)], "group string, ord int")
    rows = names.join(counts, "group", "left").fillna(0, ["n", "hits"]).withColumn("pct", stats.percent("hits", "n"))
    first = rows.where("ord = 1").select(F.col("pct").alias("first_pct"))
    return rows.crossJoin(F.broadcast(first)).withColumn("ratio", stats.rate_ratio("first_pct", "pct")).drop("first_pct")


def expected(a: str, b: str, c: str, d: str) -> dict[str, Column]:
    """Counts that a 2x2 table would have if rows and columns were independent."""
    x = [F.col(n).cast("double") for n in (a, b, c, d)]
    n = F.nullif(x[0] + x[1] + x[2] + x[3], F.lit(0.0))
    rows, columns = (x[0] + x[1], x[2] + x[3]), (x[0] + x[2], x[1] + x[3])
    return {f"expected_{k}": rows[i // 2] * columns[i % 2] / n for i, k in enumerate("abcd")}


def metadata_report(df: DataFrame, group: Column, hit: Column, variant: str, order: list[str], top: int = 25) -> DataFrame:
    """Rows that a condition marks by group, as rows of part, item, measure and value.

    totals and group (of the fixed order): records, hits, others and percent. test: the first group
    against all other rows, with expected counts, chi-squared with and without Yates' correction, their
    p-values and V. ratio: the first group's percent to each other's, both rounded. variant: the most
    frequent values among the hits, ties by value. One grouping of group and value serves all parts;
    a null group counts among the others, a null condition as no hit.
    """
    held = F.coalesce(hit, F.lit(False))
    counts = durable(df.groupBy(group.alias("group"), held.alias("hit"), F.when(held, F.col(variant)).alias("variant")).agg(F.count("*").alias("n")))
    hits = judgments.tally(F.col("hit"), "n").alias("hits")
    sums = lambda rows: rows.withColumn("others", F.col("records") - F.col("hits")).withColumn("pct", stats.percent("hits", "records"))
    totals = sums(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), hits))
    names = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(order)], "group string, ord int")
    groups = names.join(counts.groupBy("group").agg(F.sum("n").alias("records"), hits), "group", "left").fillna(0, ["records", "hits"])
    groups = sums(groups).withColumn("pct", F.coalesce("pct", F.lit(0.0)))
    first = F.coalesce(F.col("group") == order[0], F.lit(False))
    cells = judgments.two_by_two(counts, F.col("hit"), first, weight="n")
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    test = cells.select(*"abcd", *(v.alias(k) for k, v in expected(*"abcd").items()), stats.chi2_yates(*"abcd").alias("chi2_yates"), stats.chi2(*"abcd").alias("chi2"), n.alias("n"))
    test = test.withColumn("v_yates", stats.cramers_v("chi2_yates", "n")).withColumns({"p_yates": stats.chi2_sf("chi2_yates", F.lit(1)), "p": stats.chi2_sf("chi2", F.lit(1))})
    rates = groups.where("ord > 0").crossJoin(F.broadcast(groups.where("ord = 0").select(F.col("pct").alias("first_pct"))))
    ratio = rates.select("group", stats.rate_ratio("first_pct", "pct").alias("ratio"))
    variants = counts.where("hit and variant is not null").groupBy("variant").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "variant").limit(top)
    return together(tidy(totals, "totals"), tidy(groups.drop("ord"), "group", "group"), tidy(test, "test"), tidy(ratio, "ratio", "group"), tidy(variants, "variant", "variant"))


def particle_report(df: DataFrame, terms: list[str], target: Column, text: str = "text") -> DataFrame:
    """Particles against a target class, as rows of part, item, measure and value.

    term: rows with each particle, those of the target, and their share. target: its rows with and without
    any particle. test: the 2x2 of any particle and target, expected counts, chi-squared by Yates and
    its p-value, and the four conditional shares. Texts are read once for all particles.
    """
    features = [evidence.Feature(t, (t,), columns=(text,)) for t in terms]
    marked = evidence.annotate(df.withColumn("target_", F.coalesce(target, F.lit(False))), features, ["target_"])
    patterns = durable(marked.groupBy("target_", "features").agg(F.count("*").alias("n")))
    names = F.array(*map(F.lit, terms))
    each = patterns.select("target_", "n", F.explode("features").alias("i")).groupBy(F.element_at(names, F.col("i") + 1).alias("term"))
    each = each.agg(F.sum("n").alias("corpus_n"), judgments.tally(F.col("target_"), "n").alias("target_n"))
    each = df.sparkSession.createDataFrame([(t,) for t in terms], "term string").join(each, "term", "left").fillna(0)
    each = each.withColumn("target_pct", F.coalesce(stats.percent("target_n", "corpus_n"), F.lit(0.0)))
    cells = judgments.two_by_two(patterns, F.col("target_"), F.size("features") > 0, weight="n")
    share = lambda x, *y: stats.percent(x, sum((F.col(k) for k in y), F.lit(0)))
    test = cells.select(*"abcd", *(v.alias(k) for k, v in expected(*"abcd").items()), stats.chi2_yates(*"abcd").alias("chi2_yates"), share("a", "a", "b").alias("target_given_particle"), share("c", "c", "d").alias("target_given_none"), share("a", "a", "c").alias("particle_given_target"), share("b", "b", "d").alias("particle_given_other"))
    own = cells.select((F.col("a") + F.col("c")).alias("rows"), F.col("a").alias("with"), F.col("c").alias("without"))
    return together(tidy(each, "term", "term"), tidy(own, "target"), tidy(test.withColumn("p", stats.chi2_sf("chi2_yates", F.lit(1))), "test"))


def preflight(wanted: DataFrame, base: DataFrame, supplement: DataFrame, key: list[str], arm: str = "arm") -> DataFrame:
    """Per arm: wanted items, and how many are left without and with the supplement."""
    a = wanted.groupBy(arm).agg(F.count("*").alias("wanted"))
    b = judgments.remaining(wanted, [base], key).groupBy(arm).agg(F.count("*").alias("left_base_only"))
    c = judgments.remaining(wanted, [base, supplement], key).groupBy(arm).agg(F.count("*").alias("left_with_supplement"))
    return a.join(b, arm, "left").join(c, arm, "left").fillna(0, ["left_base_only", "left_with_supplement"])


def drift_report(frozen: DataFrame, fresh: DataFrame, items: DataFrame, again: DataFrame, key: list[str], raters: int, target: str, control: str) -> DataFrame:
    """A rerun against frozen judgments: agreement of each rater, and whether the effect keeps its direction and size.

    frozen and fresh have a row per key and rater; items and again have a row per item with its vote_sum.
    """
    old, new = (judgments.consensus(x, raters, target, control) for x in (items, again))
    return together(tidy(agreement.drift(frozen, fresh, key, ("rater",)), "rater", "rater"), tidy(agreement.direction(old, new), "direction"))


def verify_counts(df: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """Per expected value: the rows there should be, those there are, and whether they agree."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"`{by}` string, expected long")
    have = df.groupBy(by).agg(F.count("*").alias("found"))
    out = want.join(have, by, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return out.withColumn("ok", F.col("found") == F.col("expected"))
