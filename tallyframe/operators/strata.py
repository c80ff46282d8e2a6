"""Stratified 2x2 tables: Mantel-Haenszel, homogeneity, sign test, per-stratum and pooled results.

Tables of strata have a row per stratum with integer counts a, b, c, d.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.functions.stats import Z95


def _doubles(strata: DataFrame) -> DataFrame:
    rows = strata.select(*[c for c in strata.columns if c not in "abcd"], *(F.col(c).cast("double").alias(c) for c in "abcd"))
    return rows.withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))


def mantel_haenszel(strata: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Common odds ratio with the interval of Robins, Breslow and Greenland.

    Strata without one of the arms are skipped; null if no stratum has discordant cells.
    """
    rows = _doubles(strata).where("a + b > 0 and c + d > 0")
    p, q = (F.col("a") + F.col("d")) / F.col("n"), (F.col("b") + F.col("c")) / F.col("n")
    r, s = F.col("a") * F.col("d") / F.col("n"), F.col("b") * F.col("c") / F.col("n")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("strata"),
        F.coalesce(F.sum(r), F.lit(0.0)).alias("r"),
        F.coalesce(F.sum(s), F.lit(0.0)).alias("s"),
        F.sum(p * r).alias("pr"),
        F.sum(p * s + q * r).alias("mid"),
        F.sum(q * s).alias("qs"),
    )
    sums = sums.withColumn("odds_ratio", F.when((F.col("r") > 0) & (F.col("s") > 0), F.col("r") / F.nullif("s", F.lit(0.0))))
    r0, s0 = F.nullif("r", F.lit(0.0)), F.nullif("s", F.lit(0.0))
    var = F.col("pr") / (2 * r0 * r0) + F.col("mid") / (2 * r0 * s0) + F.col("qs") / (2 * s0 * s0)
    half = Z95 * F.sqrt(var)
    low, high = (F.exp(F.log("odds_ratio") + k * half) for k in (-1, 1))
    return sums.select(*by, "strata", "odds_ratio", low.alias("or_low"), high.alias("or_high"))


def woolf_homogeneity(strata: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Woolf's test that strata share an odds ratio: chi2 and df; null with fewer than two strata.

    A half is added to every cell; strata without one of the arms are skipped.
    """
    rows = _doubles(strata).where("a + b > 0 and c + d > 0")
    a, b, c, d = (F.col(x) + 0.5 for x in "abcd")
    rows = rows.select(*by, F.log(a * d / (b * c)).alias("l"), (1 / (1 / a + 1 / b + 1 / c + 1 / d)).alias("w"))
    w, l = F.col("w"), F.col("l")
    sums = rows.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * l).alias("wl"), F.sum(w * l * l).alias("wll"))
    chi = F.greatest(F.lit(0.0), F.col("wll") - F.col("wl") * F.col("wl") / F.nullif("w", F.lit(0.0)))
    return sums.select(*by, F.col("k").alias("strata"), F.when(F.col("k") >= 2, chi).alias("chi2"), F.when(F.col("k") >= 2, F.col("k") - 1).alias("df"))


def per_stratum(strata: DataFrame, name: str, least: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Shares, difference and odds ratio of each stratum with at least `least` cases in both arms."""
    rows = strata.where(F.least(F.col("a") + F.col("b"), F.col("c") + F.col("d")) >= least)
    t, c = stats.percent("a", F.col("a") + F.col("b")), stats.percent("c", F.col("c") + F.col("d"))
    value, *_ = stats.odds_ratio("a", "b", "c", "d")
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return rows.select(*by, name, *"abcd", n.alias("n"), t.alias("target_pct"), c.alias("control_pct"), (t - c).alias("diff_pp"), value.alias("odds_ratio"))


def sign_test(strata: DataFrame, least: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact sign test over strata with at least `least` cases in both arms."""
    rows = strata.where(F.least(F.col("a") + F.col("b"), F.col("c") + F.col("d")) >= least)
    # Shares are compared crosswise in integers.
    gap = F.col("a") * (F.col("c") + F.col("d")) - F.col("c") * (F.col("a") + F.col("b"))
    sums = rows.groupBy(*by).agg(F.count_if(gap > 0).alias("wins"), F.count_if(gap < 0).alias("losses"), F.count_if(gap == 0).alias("ties"))
    return sums.withColumn("p", stats.sign_test("wins", "losses"))


def pooled(strata: DataFrame, name: str, least: int = 5) -> DataFrame:
    """Strata with both arms of at least `least` cases together: pooled table, mean and weighted mean difference."""
    rows = per_stratum(strata, name, least)
    sums = rows.agg(
        F.count("*").alias("strata"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abcd"),
        F.avg("diff_pp").alias("mean_diff"),
        (F.sum(F.col("diff_pp") * F.col("n")) / F.sum("n")).alias("weighted_diff"),
        F.count_if(F.col("diff_pp") > 0).alias("wins"),
        F.count_if(F.col("diff_pp") < 0).alias("losses"),
    )
    sums = sums.withColumn("chi2_yates", stats.chi2_yates(*"abcd")).withColumn("odds_ratio", stats.plain_odds_ratio(*"abcd"))
    return sums.withColumn("sign_p", stats.sign_test("wins", "losses"))
