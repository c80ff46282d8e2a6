"""Closed-form categorical statistics as column expressions over integer counts.

A 2x2 table is (a, b, c, d): positives and others of the target arm, then of the control arm.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054
INF = float("inf")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x: Column | str) -> Column:
    return col(x).cast("double")


def ratio(top: Column | str, bottom: Column | str, empty: float | None = None) -> Column:
    """top / bottom; `empty` where bottom is 0."""
    return F.when(num(bottom) == 0, F.lit(empty).cast("double")).otherwise(num(top) / num(bottom))


def percent(top: Column | str, bottom: Column | str) -> Column:
    """Share in percent, 0 without cases."""
    return ratio(100 * num(top), bottom, 0.0)


def _margins(a, b, c, d) -> tuple[Column, Column]:
    a, b, c, d = map(num, (a, b, c, d))
    return a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)


def chi2(a, b, c, d) -> Column:
    """Pearson's chi-squared of a 2x2 table; 0 if a margin is empty."""
    n, product = _margins(a, b, c, d)
    cross = num(a) * num(d) - num(b) * num(c)
    return F.when(product == 0, F.lit(0.0)).otherwise(n * cross * cross / product)


def chi2_yates(a, b, c, d) -> Column:
    """Chi-squared with continuity correction; 0 if a margin is empty."""
    n, product = _margins(a, b, c, d)
    gap = F.greatest(F.lit(0.0), F.abs(num(a) * num(d) - num(b) * num(c)) - n / 2)
    return F.when(product == 0, F.lit(0.0)).otherwise(n * gap * gap / product)


def chi2_table(rows: list[list[Column | str]]) -> Column:
    """Chi-squared of an r x c table; cells with expected count 0 add nothing."""
    cells = [[num(x) for x in row] for row in rows]
    of_row = [sum(row[1:], row[0]) for row in cells]
    of_col = [sum((r[j] for r in cells[1:]), cells[0][j]) for j in range(len(cells[0]))]
    n = sum(of_row[1:], of_row[0])
    total = F.lit(0.0)
    for i, row in enumerate(cells):
        for j, seen in enumerate(row):
            expected = of_row[i] * of_col[j] / F.nullif(n, F.lit(0.0))
            total = total + F.when(F.coalesce(expected, F.lit(0.0)) == 0, 0.0).otherwise((seen - expected) * (seen - expected) / expected)
    return total


def cramers_v(chi: Column | str, n: Column | str, least: int = 1) -> Column:
    """Square root of chi-squared over n times `least`, the smaller dimension less one; 0 without cases."""
    return F.sqrt(ratio(chi, num(n) * least, 0.0))


def phi(a, b, c, d) -> Column:
    """Root of chi-squared over all cases of a 2x2 table; 0 if a margin is empty."""
    n, _ = _margins(a, b, c, d)
    return F.sqrt(ratio(chi2(a, b, c, d), n, 0.0))


def signed_phi(a, b, c, d) -> Column:
    """phi with the sign of the difference of shares."""
    return F.signum(num(a) * num(d) - num(b) * num(c)) * phi(a, b, c, d)


def wilson(k: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a share; (0, 0) without cases."""
    k, n = num(k), num(n)
    p = k / F.nullif(n, F.lit(0.0))
    bottom = 1 + z * z / F.nullif(n, F.lit(0.0))
    mid = (p + z * z / (2 * F.nullif(n, F.lit(0.0)))) / bottom
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + z * z / (4 * F.nullif(n * n, F.lit(0.0)))) / bottom
    return F.coalesce(mid - half, F.lit(0.0)), F.coalesce(mid + half, F.lit(0.0))


def newcombe(a, b, c, d, z: float = Z95) -> tuple[Column, Column, Column]:
    """Difference of two shares with Newcombe's interval from Wilson's."""
    n1, n2 = num(a) + num(b), num(c) + num(d)
    p1, p2 = ratio(a, n1, 0.0), ratio(c, n2, 0.0)
    (l1, u1), (l2, u2) = wilson(a, n1, z), wilson(c, n2, z)
    gap = p1 - p2
    low = gap - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    high = gap + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return gap, low, high


def odds_ratio(a, b, c, d, z: float = Z95) -> tuple[Column, Column, Column, Column]:
    """Odds ratio, Woolf interval, and whether a half was added to all cells because one was 0."""
    zero = (num(a) == 0) | (num(b) == 0) | (num(c) == 0) | (num(d) == 0)
    half = F.when(zero, F.lit(0.5)).otherwise(F.lit(0.0))
    a, b, c, d = (num(x) + half for x in (a, b, c, d))
    value = a * d / (b * c)
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return value, F.exp(F.log(value) - z * se), F.exp(F.log(value) + z * se), zero


def plain_odds_ratio(a, b, c, d) -> Column:
    """ad / bc; infinite where bc is 0."""
    return ratio(num(a) * num(d), num(b) * num(c), INF)


def relative_risk(a, b, c, d) -> Column:
    """Ratio of shares; infinite where the control share is 0 or has no cases."""
    p1, p2 = ratio(a, num(a) + num(b), 0.0), ratio(c, num(c) + num(d), 0.0)
    return ratio(p1, p2, INF)


def rate_ratio(first: Column | str, second: Column | str, digits: int = 2) -> Column:
    """Ratio of two rates that were rounded for display; null where the second is 0."""
    a, b = F.round(num(first), digits), F.round(num(second), digits)
    return F.when(b != 0, F.round(a / F.nullif(b, F.lit(0.0)), digits))


def expected(row: Column | str, column: Column | str, n: Column | str) -> Column:
    return ratio(num(row) * num(column), n)


def cohen_kappa(both, first_only, second_only, neither, degenerate: str = "one_or_null") -> Column:
    """Cohen's kappa of two raters.

    Where chance agreement is complete: "one_or_null" gives 1 if they agree wholly and null else,
    "null" gives null, "zero" gives 0 (also without items; the others give null there).
    """
    a, b, c, d = map(num, (both, first_only, second_only, neither))
    n = F.nullif(a + b + c + d, F.lit(0.0))
    po = (a + d) / n
    pe = ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)
    whole = {"one_or_null": F.when(po >= 1, F.lit(1.0)), "null": F.lit(None).cast("double"), "zero": F.lit(0.0)}[degenerate]
    none = F.lit(0.0) if degenerate == "zero" else F.lit(None).cast("double")
    return F.when(n.isNull(), none).when(pe >= 1, whole).otherwise((po - pe) / (1 - pe))


def stars(p: Column | str) -> Column:
    return F.when(col(p) < 0.001, "***").when(col(p) < 0.01, "**").when(col(p) < 0.05, "*").otherwise("ns")


def p_label(p: Column | str) -> Column:
    return F.when(col(p) < 1e-300, "< 1e-300").when(col(p) < 0.001, "< 0.001").otherwise(F.format_string("%.4f", num(p)))


def bundle(a, b, c, d) -> Column:
    """Effect of a 2x2 table: shares, difference and odds ratio with intervals, chi-squared."""
    gap, low, high = newcombe(a, b, c, d)
    value, vlow, vhigh, corrected = odds_ratio(a, b, c, d)
    return F.struct(
        percent(a, num(a) + num(b)).alias("target_pct"),
        percent(c, num(c) + num(d)).alias("control_pct"),
        (100 * gap).alias("diff_pp"),
        (100 * low).alias("diff_low"),
        (100 * high).alias("diff_high"),
        value.alias("odds_ratio"),
        vlow.alias("or_low"),
        vhigh.alias("or_high"),
        corrected.alias("or_corrected"),
        chi2(a, b, c, d).alias("chi2"),
    )


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution with a whole number of degrees.

    With half the degrees whole, the tail is that of a Poisson count, a finite sum; else the same
    sum goes in halves from the normal tail. Terms are kept in logarithms.
    """
    if x is None or df is None or x != x:
        return float("nan")
    if x <= 0:
        return 1.0
    y = x / 2
    tail = math.erfc(math.sqrt(y)) if df % 2 else 0.0
    places = (j + 0.5 * (df % 2) for j in range(df // 2))
    return min(1.0, tail + math.fsum(math.exp(j * math.log(y) - y - math.lgamma(j + 1)) for j in places))


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """p-value of chi-squared with df degrees; meant for aggregated rows."""
    return pd.Series([chi2_tail(a, int(b)) for a, b in zip(x, df, strict=True)], dtype="float64")


#: Pairs of a sign test up to which logarithms are added up one by one.
MANY = 100_000


def sign_test(wins: Column | str, losses: Column | str) -> Column:
    """Exact two-sided sign test, ties left out; null without pairs.

    The largest binomial term of the tail is taken in logarithms (up to MANY pairs as a sum, beyond by
    Stirling's series), the others relative to it. Terms further from the middle than nine standard
    deviations are below the last digit, so the sum has as many terms as the root of the pairs.
    """
    w, v = col(wins).cast("long"), col(losses).cast("long")
    n, k = w + v, F.least(w, v)
    none = F.array().cast("array<bigint>")
    every = F.when((k >= 1) & (n <= MANY), F.sequence(F.lit(1).cast("long"), k)).otherwise(none)
    stirling = lambda x: (x + 0.5) * F.log(x) - x + 1 / (12 * x) - 1 / (360 * x * x * x)  # noqa: E731  without half the log of two pi
    far = n.cast("double"), k.cast("double"), (n - k).cast("double")
    log_many = F.when(k == 0, 0.0).when(k < 30, F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(k, F.lit(30))), F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i)))
    log_many = log_many.otherwise(stirling(far[0]) - stirling(far[1]) - stirling(far[2]) - 0.5 * math.log(2 * math.pi))
    log_top = F.when(n <= MANY, F.aggregate(every, F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i))).otherwise(log_many)
    reach = F.least(k, (9 * F.sqrt(n.cast("double")) + 40).cast("long"))
    places = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), reach)).otherwise(none)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s: Column, i: Column) -> Column:
        at = k - i + 1  # from C(n, at) to C(n, at - 1)
        term = s["term"] * at / (n - at + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.aggregate(places, start, step)["total"]
    tail = F.exp(log_top - n * F.log(F.lit(2.0))) * total
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson's correlation; null for a column without variance, where `corr` would divide by zero."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
