"""Agreement between raters, and how results depend on thresholds."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.operators.judgments import tally


def pairwise(items: DataFrame, raters: list[str], degenerate: str = "one_or_null") -> DataFrame:
    """Each pair of raters: counts, agreement in percent and Cohen's kappa, from one aggregation."""
    vote = lambda i: F.element_at("votes", i + 1) == 1
    aggs = []
    for i, j in combinations(range(len(raters)), 2):
        x, y = vote(i), vote(j)
        cells = (F.count_if(x & y), F.count_if(x & ~y), F.count_if(~x & y), F.count_if(~x & ~y))
        names = ("both", "first_only", "second_only", "neither")
        pair = (F.lit(raters[i]).alias("rater_1"), F.lit(raters[j]).alias("rater_2"))
        aggs.append(F.struct(*pair, *(c.alias(n) for c, n in zip(cells, names, strict=True))))
    rows = items.agg(F.array(*aggs).alias("pairs")).select(F.explode("pairs").alias("p")).select("p.*")
    n = F.col("both") + F.col("first_only") + F.col("second_only") + F.col("neither")
    kappa = stats.cohen_kappa("both", "first_only", "second_only", "neither", degenerate)
    return rows.withColumn("agreement_pct", stats.percent(F.col("both") + F.col("neither"), n)).withColumn("kappa", kappa)


def pairs(rows: DataFrame, by: tuple[str, ...] = (), weight: str | None = None, degenerate: str = "one_or_null") -> DataFrame:
    """The same for rows whose members and votes are arrays, so that groups may have other raters: one row per group and pair."""
    zipped = F.arrays_zip(F.col("members").alias("rater"), F.col("votes").alias("vote"))
    own = [*by, *([weight] if weight else [])]
    each = rows.select(*own, "members", "votes", F.posexplode(zipped).alias("i", "x"))
    rest = F.explode(F.slice(zipped, F.col("i") + 2, F.size("members")))
    each = each.where(F.col("i") + 1 < F.size("members")).select(*own, "x", rest.alias("y"))
    x, y = F.col("x.vote") == 1, F.col("y.vote") == 1
    cells = {"both": x & y, "first_only": x & ~y, "second_only": ~x & y, "neither": ~x & ~y}
    out = each.groupBy(*by, F.col("x.rater").alias("rater_1"), F.col("y.rater").alias("rater_2")).agg(*(tally(c, weight).alias(k) for k, c in cells.items()))
    n = F.col("both") + F.col("first_only") + F.col("second_only") + F.col("neither")
    return out.withColumn("agreement_pct", stats.percent(F.col("both") + F.col("neither"), n)).withColumn("kappa", stats.cohen_kappa(*cells, degenerate))


def fleiss(items: DataFrame, raters: int | str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Fleiss' kappa of binary votes, and the share of unanimous items in percent.

    From the counts of vote sums: where chance agreement is complete, 1 if raters agree wholly, else null.
    raters may name a column of `by`; with `weight`, a row counts as often as that column says.
    """
    r = (F.col(raters) if isinstance(raters, str) else F.lit(raters)).cast("double")
    s = F.col("vote_sum").cast("double")
    w = F.lit(1) if weight is None else F.col(weight)
    rows = items.groupBy(*by).agg(
        tally(F.lit(True), weight).alias("n"),
        F.sum(F.col("vote_sum") * w).alias("positive"),
        F.sum((s * s + (r - s) * (r - s)) * w).alias("squares"),
        tally((F.col("vote_sum") == 0) | (s == r), weight).alias("unanimous"),
    )
    n = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    observed = (F.col("squares") - n * r) / (n * r * (r - 1))
    p = F.col("positive") / (n * r)
    chance = p * p + (1 - p) * (1 - p)
    kappa = F.when(chance >= 1, F.when(observed >= 1, F.lit(1.0))).otherwise((observed - chance) / (1 - chance))
    return rows.select(*by, "n", "positive", "unanimous", stats.percent("unanimous", "n").alias("unanimous_pct"), kappa.alias("kappa"))


def definitions(
    items: DataFrame, raters: int | str, target: str, control: str, arm: str = "arm", by: tuple[str, ...] = (), weight: str | None = None
) -> DataFrame:
    """2x2 counts under three definitions of a positive item: all raters, more than half, any."""
    r = F.col(raters) if isinstance(raters, str) else F.lit(raters)
    cuts = {"unanimous": r, "majority": F.floor(r / 2) + 1, "any": F.lit(1)}
    rows = items.where(F.col(arm).isin(target, control))
    t = F.col(arm) == target
    aggs = []
    for name, cut in cuts.items():
        pos = F.col("vote_sum") >= cut
        cells = {"a": t & pos, "b": t & ~pos, "c": ~t & pos, "d": ~t & ~pos}
        aggs.append(F.struct(F.lit(name).alias("definition"), *(tally(x, weight).alias(k) for k, x in cells.items())))
    return rows.groupBy(*by).agg(F.array(*aggs).alias("all")).select(*by, F.explode("all").alias("s")).select(*by, "s.*")


def sensitivity(items: DataFrame, raters: int | str, target: str, control: str, arm: str = "arm", by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """The effect under each of the definitions()."""
    rows = definitions(items, raters, target, control, arm, by, weight)
    return rows.withColumn("effect", stats.bundle("a", "b", "c", "d")).select(*by, "definition", "a", "b", "c", "d", "effect.*")


def threshold_sweep(
    df: DataFrame,
    probability: Column,
    majority: Column,
    target: Column,
    cuts: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9),
    raters: dict[str, Column] | None = None,
) -> DataFrame:
    """Per cut of a probability: the 2x2 effect, and kappa against the raters' majority and each rater; one pass."""
    rows = df.where(probability.isNotNull() & target.isNotNull())
    others, aggs = {"majority": majority, **(raters or {})}, []
    for cut in cuts:
        pos = probability >= cut
        cells = {"a": target & pos, "b": target & ~pos, "c": ~target & pos, "d": ~target & ~pos}
        for name, vote in others.items():
            cells |= {f"{name}_0": pos & vote, f"{name}_1": pos & ~vote, f"{name}_2": ~pos & vote, f"{name}_3": ~pos & ~vote}
        aggs.append(F.struct(F.lit(cut).alias("cut"), *(F.count_if(x).alias(k) for k, x in cells.items())))
    rows = rows.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    gap, *_ = stats.newcombe("a", "b", "c", "d")
    kappas = [stats.cohen_kappa(*(f"{name}_{i}" for i in range(4)), "null").alias(f"kappa_{name}") for name in others]
    return rows.select("cut", "a", "b", "c", "d", (100 * gap).alias("diff_pp"), stats.chi2("a", "b", "c", "d").alias("chi2"), *kappas)


def flip_control(pairs: DataFrame, p: str = "p", q: str = "q", cut: float = 0.5) -> DataFrame:
    """Answers to a question and to its opposite: how near p + q is to one, and how often both are yes or no."""
    s = F.col(p) + F.col(q)
    return pairs.where(F.col(p).isNotNull() & F.col(q).isNotNull()).agg(
        F.count("*").alias("n"),
        F.avg(s).alias("mean_sum"),
        F.avg(F.abs(s - 1)).alias("mean_gap"),
        F.when(F.count("*") >= 3, stats.correlation(p, q)).alias("r"),
        (100 * F.avg(((F.col(p) >= cut) & (F.col(q) >= cut)).cast("int"))).alias("both_yes_pct"),
        (100 * F.avg(((F.col(p) < cut) & (F.col(q) < cut)).cast("int"))).alias("both_no_pct"),
    )


def drift(frozen: DataFrame, fresh: DataFrame, key: list[str], by: tuple[str, ...] = (), judgment: str = "judgment") -> DataFrame:
    """Agreement of judgments made twice: pairs, agreement in percent and kappa (0 where undefined)."""
    a = frozen.select(*key, *by, F.col(judgment).alias("x_"))
    b = fresh.select(*key, *by, F.col(judgment).alias("y_"))
    x, y = F.col("x_"), F.col("y_")
    rows = a.join(b, [*key, *by]).groupBy(*by).agg(
        F.count_if(x & y).alias("both"),
        F.count_if(x & ~y).alias("first_only"),
        F.count_if(~x & y).alias("second_only"),
        F.count_if(~x & ~y).alias("neither"),
    )
    n = F.col("both") + F.col("first_only") + F.col("second_only") + F.col("neither")
    kappa = stats.cohen_kappa("both", "first_only", "second_only", "neither", "zero")
    return rows.withColumn("pairs", n).withColumn("agreement_pct", stats.percent(F.col("both") + F.col("neither"), n)).withColumn("kappa", kappa)


def direction(frozen: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two one-row consensus results: signs of the O difference and the change of Cramer's V."""
    gap = lambda p: F.col(f"{p}.target_o") / F.col(f"{p}.target_n") - F.col(f"{p}.control_o") / F.col(f"{p}.control_n")
    sized = lambda df: df.withColumn("target_n", F.col("target_o") + F.col("target_s") + F.col("target_x")).withColumn(
        "control_n", F.col("control_o") + F.col("control_s") + F.col("control_x")
    )
    both = sized(frozen).alias("f").crossJoin(F.broadcast(sized(fresh)).alias("g"))
    return both.select(
        (100 * gap("f")).alias("frozen_diff"),
        (100 * gap("g")).alias("fresh_diff"),
        (F.signum(gap("f")) == F.signum(gap("g"))).alias("same_direction"),
        (F.col("g.cramers_v") - F.col("f.cramers_v")).alias("v_change"),
    )
