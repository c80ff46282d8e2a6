"""Closed-form statistics against published counts and standard values."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.operators import agreement, judgments, ranks, strata
from tallyframe.operators.bootstrap import cramers_v_interval


def one(spark, *columns, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(*columns).first()


@pytest.mark.parametrize(
    "target,control,chi2,v",
    [((1069, 1098, 439), (162, 809, 1635), 1401.76, 0.519), ((5085, 4335, 1715), (3082, 6608, 1445), 986.45, 0.210), ((239, 45, 12), (137, 76, 83), 88.68, 0.387)],
)
def test_consensus_counts(spark, target, control, chi2, v):
    names = ["to", "ts", "tx", "co", "cs", "cx"]
    rows = spark.createDataFrame([(*target, *control)], names)
    got = rows.select(stats.chi2_table([names[:3], names[3:]]).alias("c"), stats.cramers_v(stats.chi2_table([names[:3], names[3:]]), F.lit(sum(target) + sum(control))).alias("v")).first()
    assert round(got.c, 2) == chi2 and round(got.v, 3) == v


@pytest.mark.parametrize(
    "cells,diff,odds",
    [
        ((1069, 1537, 162, 2444), (34.80, 32.68, 36.89), (10.493, 8.789, 12.526)),
        ((5085, 6050, 3082, 8053), (17.99, 16.74, 19.23), (2.196, 2.077, 2.322)),
        ((5085, 1715, 3082, 1445), (6.70, 5.00, 8.41), (1.390, 1.279, 1.511)),
        ((239, 12, 137, 83), (32.95, 25.93, 39.82), (12.066, 6.358, 22.900)),
        ((257, 39, 147, 149), (37.16, 30.03, 43.75), (6.679, 4.448, 10.031)),
    ],
)
def test_bundle(spark, cells, diff, odds):
    r = spark.createDataFrame([cells], "a int, b int, c int, d int").select(stats.bundle(*"abcd").alias("e")).first().e
    assert tuple(round(x, 2) for x in (r.diff_pp, r.diff_low, r.diff_high)) == diff
    assert tuple(round(x, 3) for x in (r.odds_ratio, r.or_low, r.or_high)) == odds and not r.or_corrected


def test_zero_cell_adds_a_half(spark):
    r = spark.createDataFrame([(2, 0, 7, 15)], "a int, b int, c int, d int").select(stats.bundle(*"abcd").alias("e")).first().e
    assert tuple(round(x, 3) for x in (r.odds_ratio, r.or_low, r.or_high)) == (10.333, 0.439, 243.329) and r.or_corrected


@pytest.mark.parametrize("cells,want", [((9839, 30223, 3149, 107334), 17574.778704), ((27, 11571, 269, 138678), 0.650)])
def test_yates(spark, cells, want):
    r = spark.createDataFrame([cells], "a int, b int, c int, d int").select(stats.chi2_yates(*"abcd").alias("x")).first()
    assert math.isclose(r.x, want, rel_tol=1e-3)


def test_degenerate_tables(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0), (5, 0, 7, 0)], "a int, b int, c int, d int")
    for r in rows.select(stats.chi2(*"abcd").alias("x"), stats.chi2_yates(*"abcd").alias("y"), *[w.alias(n) for n, w in zip(("lo", "hi"), stats.wilson(F.lit(0), F.lit(0)))]).collect():
        assert (r.x, r.y, r.lo, r.hi) == (0, 0, 0, 0)
    k = [stats.cohen_kappa(F.lit(4), F.lit(0), F.lit(0), F.lit(0), m).alias(m) for m in ("one_or_null", "null", "zero")]
    assert tuple(spark.range(1).select(*k).first()) == (1.0, None, 0.0)


def test_special_functions(spark):
    assert math.isclose(stats.chi2_tail(103.63, 40), 1.5066e-07, rel_tol=1e-4)
    assert math.isclose(stats.chi2_tail(264.32, 45), 8.06e-33, rel_tol=1e-2)
    assert math.isclose(stats.chi2_tail(1295.15, 1), 1.28e-283, rel_tol=1e-2)
    assert math.isclose(stats.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.chi2_tail(3.841458820694124, 2), math.exp(-3.841458820694124 / 2), rel_tol=1e-12)
    rows = spark.createDataFrame([(36, 4), (42, 4), (6, 4), (0, 0), (3, 3)], "w int, l int").select(stats.sign_test("w", "l").alias("p")).collect()
    for got, want in zip(rows, [1.857e-07, 5.100e-09, 0.75390625, None, 1.0]):
        assert got.p is want if want is None else math.isclose(got.p, want, rel_tol=1e-3)


def test_mantel_haenszel(spark):
    for cells, want in (
        ([(53, 155, 10, 321), (187, 509, 105, 865), (800, 1837, 41, 1284), (29, 105, 6, 136)], (11.175, 9.269, 13.474)),
        ([(13, 15, 21, 27), (52, 62, 35, 110), (172, 217, 74, 137), (2, 2, 7, 22)], (4.532, 3.090, 6.648)),
    ):
        rows = spark.createDataFrame([(a, n - a, c, m - c) for a, n, c, m in cells] + [(3, 4, 0, 0)], "a int, b int, c int, d int")
        r = strata.mantel_haenszel(rows).first()
        assert tuple(round(x, 3) for x in (r.odds_ratio, r.or_low, r.or_high)) == want and r.strata == 4
    assert strata.woolf_homogeneity(rows.limit(1)).first().chi2 is None


def test_agreement(spark):
    rows = spark.createDataFrame([([1, 1, 1], 3), ([0, 0, 0], 0), ([1, 1, 1], 3)], "votes array<int>, vote_sum int")
    assert [r.kappa for r in agreement.pairwise(rows, ["x", "y", "z"]).collect()] == [1.0] * 3
    assert math.isclose(agreement.fleiss(rows, 3).first().kappa, 1.0)
    assert math.isclose(agreement.fleiss(rows.where("vote_sum = 3"), 3).first().kappa, 1.0)


def test_ranks(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.1, False), (0.2, False)], "v double, y boolean")
    assert ranks.auc(rows, "v", F.col("y")).first().auc == 1.0
    tied = spark.createDataFrame([(0.5, True), (0.5, False)], "v double, y boolean")
    assert ranks.auc(tied, "v", F.col("y")).first().auc == 0.5
    assert ranks.auc(tied.where("y"), "v", F.col("y")).first().auc is None
    assert ranks.pearson(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "x double, y double"), "x", "y").first().r is None
    constant = spark.createDataFrame([(0.2, 0.5), (0.4, 0.5), (0.9, 0.5)], "p double, q double")
    assert agreement.flip_control(constant).first().r is None


def test_swapping_arms_inverts_the_odds_ratio(spark):
    r = one(spark, stats.odds_ratio(*"abcd")[0].alias("x"), stats.odds_ratio(*"cdab")[0].alias("y"), a=17, b=5, c=9, d=21)
    assert math.isclose(r.x * r.y, 1.0)


def test_votes_and_dedupe(spark):
    long = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True)], "k int, rater string, judgment boolean")
    got = judgments.panel_votes(long, ["k"], ["a", "b"]).collect()
    assert [(r.k, r.votes, r.vote_sum) for r in got] == [(1, [1, 0], 1)]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, ord int, v string")
    assert sorted(r.v for r in judgments.dedupe(rows, ["k"], ["ord"]).collect()) == ["y", "z"]
    assert sorted(r.v for r in judgments.dedupe(rows, ["k"], ["ord"], "first").collect()) == ["x", "z"]


def test_remaining_is_null_safe(spark):
    wanted = spark.createDataFrame([("a", None), ("a", "1"), ("b", None)], "k string, s string")
    done = spark.createDataFrame([("a", None)], "k string, s string")
    assert sorted((r.k, r.s or "") for r in judgments.remaining(wanted, [done], ["k", "s"]).collect()) == [("a", "1"), ("b", "")]


def test_bootstrap_covers_the_statistic(spark):
    counts = spark.createDataFrame([(1069, 1098, 439, 162, 809, 1635)], "target_o int, target_s int, target_x int, control_o int, control_s int, control_x int")
    r = cramers_v_interval(counts, 400).first()
    assert r.low_v < 0.519 < r.high_v and r.high_v - r.low_v < 0.06
    assert r == cramers_v_interval(counts.repartition(3), 400).first()


@pytest.mark.parametrize("wins,losses", [(600, 480), (950, 1050), (1000, 1000), (450, 550), (3, 0), (0, 0), (5000, 4700)])
def test_sign_test_of_any_size(spark, wins, losses):
    n, k = wins + losses, min(wins, losses)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    want = min(1.0, 2 * math.fsum(map(math.exp, logs))) if n else None
    got = one(spark, stats.sign_test("w", "v").alias("p"), w=wins, v=losses).p
    assert got == want if want is None else math.isclose(got, want, rel_tol=1e-8)


@pytest.mark.parametrize("df", range(1, 12))
def test_chi2_tail_against_integration(df):
    density = lambda x: math.exp((df / 2 - 1) * math.log(x) - x / 2 - math.lgamma(df / 2) - df / 2 * math.log(2))
    for x in (0.5, 3.841, 10.0, 40.0):
        steps = 200_000
        width = 200 / steps
        area = width * math.fsum(density(x + (i + 0.5) * width) for i in range(steps))
        assert math.isclose(stats.chi2_tail(x, df), area, rel_tol=1e-5)
    assert stats.chi2_tail(0, df) == 1.0 and math.isnan(stats.chi2_tail(float("nan"), df))


def test_signed_phi(spark):
    r = one(spark, stats.phi(*"abcd").alias("p"), stats.signed_phi(*"abcd").alias("s"), a=2, b=8, c=7, d=3)
    assert math.isclose(r.p, -r.s) and math.isclose(r.p, math.sqrt(20 * (2 * 3 - 8 * 7) ** 2 / (10 * 10 * 9 * 11) / 20))


def test_sign_test_of_very_many_pairs(spark):
    """Beyond the sum of logarithms the result is that of the normal tail with continuity correction, and of exact sums."""
    from fractions import Fraction

    def exact(w, v):
        n, k = w + v, min(w, v)
        term, total = math.comb(n, k), 0
        while k >= 0 and (total == 0 or term * 10**25 > total):
            total += term
            term = term * k // (n - k + 1)
            k -= 1
        return min(1.0, float(Fraction(2 * total, 2**n)))

    cases = [(60_100, 59_900), (70_000, 69_000), (120_000, 119_999), (100_001, 3), (200_000, 0), (30_000, 31_000), (500, 480)]
    rows = spark.createDataFrame(cases, "w long, l long").select("w", "l", stats.sign_test("w", "l").alias("p")).collect()
    for r in rows:
        assert math.isclose(r.p, exact(r.w, r.l), rel_tol=1e-7, abs_tol=1e-300), (r, exact(r.w, r.l))
    big = spark.createDataFrame([(500_050_000, 499_950_000), (10**12, 10**12)], "w long, l long").select(stats.sign_test("w", "l").alias("p")).collect()
    want = math.erfc((100_000 - 1) / math.sqrt(10**9) / math.sqrt(2))
    assert math.isclose(big[0].p, want, rel_tol=1e-3) and math.isclose(big[1].p, 1.0, rel_tol=1e-5)
