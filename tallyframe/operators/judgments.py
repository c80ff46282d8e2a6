"""Judgments of several raters: assembling, deduplicating, resuming, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.operators.ordering import numbered


def tally(condition: Column, weight: str | None = None) -> Column:
    """Rows of a group where the condition holds; with `weight`, each counts as often as that column says."""
    return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def dedupe(df: DataFrame, key: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row per key: the first or last by the order columns, which are expected to be total.

    A pre-aggregated minimum or maximum, so a key with very many rows is never gathered.
    """
    rest = [c for c in df.columns if c not in key]
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    chosen = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("row_"))
    return chosen.select(*key, *(F.col("row_")[c].alias(c) for c in rest)).select(*df.columns)


def union_all(*parts: DataFrame) -> DataFrame:
    """Union by name; columns that a part lacks are null in its rows."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


#: Rows of narrow keys that a task holds at once where parts are counted.
TASK_ROWS = 500_000


def parts(df: DataFrame) -> int:
    """Parts in which df has some TASK_ROWS rows each; narrow rows are packed too tightly by their bytes alone."""
    return df.count() // TASK_ROWS + 1


def remaining(wanted: DataFrame, done: list[DataFrame], key: list[str], n: int | None = None) -> DataFrame:
    """Rows of which no part has the key yet; null key columns equal each other. `n` deals both sides to so many tasks."""
    known = union_all(*(d.select(*key) for d in done)).distinct()
    if n:
        whole = F.struct(*key).alias("whole_key_")  # structs with null fields equal each other
        known = union_all(*(d.select(*key) for d in done)).select(whole).repartition(n, "whole_key_").distinct()
        return wanted.select("*", whole).repartition(n, "whole_key_").join(known, "whole_key_", "left_anti").select(*wanted.columns)
    match = [wanted[c].eqNullSafe(known[c]) for c in key]
    return wanted.join(known, match, "left_anti")


def restrict(df: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is in the base."""
    return df.join(base.select(*key).distinct(), key, "left_semi")


def panel_votes(long: DataFrame, key: list[str], raters: list[str], rater: str = "rater", judgment: str = "judgment") -> DataFrame:
    """Items that all raters judged, one row each: key, votes in the raters' order, vote_sum.

    One grouping instead of a join per rater; long holds one judgment per key and rater.
    """
    at = {r: F.max(F.when(F.col(rater) == r, F.col(judgment).cast("int"))) for r in raters}
    rows = long.where(F.col(rater).isin(raters)).groupBy(*key).agg(*(at[r].alias(f"v_{i}") for i, r in enumerate(raters)))
    votes = [F.col(f"v_{i}") for i in range(len(raters))]
    whole = rows.dropna(subset=[f"v_{i}" for i in range(len(raters))])
    return whole.select(*key, F.array(*votes).alias("votes"), sum(votes[1:], votes[0]).alias("vote_sum"))


def consensus_class(vote_sum: Column | str, raters: int | Column) -> Column:
    """O if all raters agree on true, X if none does, else S."""
    v = stats.col(vote_sum)
    return F.when(v == raters, "O").when(v == 0, "X").otherwise("S")


def arm_counts(items: DataFrame, raters: int, arm: str = "arm", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of O, S and X and of items, by arm."""
    kind = consensus_class("vote_sum", raters)
    return items.groupBy(*by, arm).agg(*(F.count_if(kind == k).alias(k.lower()) for k in "OSX"), F.count("*").alias("n"))


def consensus(
    items: DataFrame, raters: int | Column, target: str, control: str, arm: str = "arm", by: tuple[str, ...] = (), weight: str | None = None
) -> DataFrame:
    """O/S/X counts of both arms in one row, with chi-squared of the 2x3 table and Cramer's V."""
    kind = consensus_class("vote_sum", raters)
    cells = [
        tally((F.col(arm) == a) & (kind == k), weight).alias(f"{name}_{k.lower()}")
        for name, a in (("target", target), ("control", control))
        for k in "OSX"
    ]
    rows = items.where(F.col(arm).isin(target, control)).groupBy(*by).agg(*cells, tally(F.lit(True), weight).alias("n"))
    chi = stats.chi2_table([[f"{name}_{k}" for k in "osx"] for name in ("target", "control")])
    return rows.withColumn("chi2", chi).withColumn("cramers_v", stats.cramers_v("chi2", "n"))


def two_by_two(df: DataFrame, positive: Column, target: Column, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Integer counts a, b, c, d of a 2x2 table: positives and others where `target` holds, then elsewhere.

    Rows where either condition is null are left out.
    """
    rows = df.where(positive.isNotNull() & target.isNotNull())
    cells = {"a": target & positive, "b": target & ~positive, "c": ~target & positive, "d": ~target & ~positive}
    return rows.groupBy(*by).agg(*(tally(x, weight).alias(k) for k, x in cells.items()))


def rater_rates(
    long: DataFrame,
    target: str,
    control: str,
    rater: str = "rater",
    arm: str = "arm",
    judgment: str = "judgment",
    by: tuple[str, ...] = (),
    weight: str | None = None,
) -> DataFrame:
    """Per rater: items and positives of both arms, rates in percent, difference and chi-squared."""
    rows = long.where(F.col(arm).isin(target, control))
    rows = two_by_two(rows, F.col(judgment), F.col(arm) == target, (*by, rater), weight)
    t, c = stats.percent("a", F.col("a") + F.col("b")), stats.percent("c", F.col("c") + F.col("d"))
    return rows.select(
        *by,
        rater,
        (F.col("a") + F.col("b")).alias("target_n"),
        F.col("a").alias("target_positive"),
        (F.col("c") + F.col("d")).alias("control_n"),
        F.col("c").alias("control_positive"),
        t.alias("target_pct"),
        c.alias("control_pct"),
        (t - c).alias("diff_pp"),
        stats.chi2("a", "b", "c", "d").alias("chi2"),
    )


def summary(long: DataFrame, by: list[str], judgment: str = "judgment") -> DataFrame:
    """Per group: judged items, positives and their share in percent."""
    rows = long.where(F.col(judgment).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(judgment)).alias("positive"))
    return rows.withColumn("mean_pct", stats.percent("positive", "n"))


def truth_table(
    items: DataFrame, raters: int | Column, target: str, control: str, arm: str = "arm", by: tuple[str, ...] = (), weight: str | None = None
) -> DataFrame:
    """O against the rest by arm; the difference is that of the shares rounded to one digit."""
    kind = consensus_class("vote_sum", raters) == "O"
    rows = two_by_two(items.where(F.col(arm).isin(target, control)), kind, F.col(arm) == target, by, weight)
    t = F.round(stats.percent("a", F.col("a") + F.col("b")), 1)
    c = F.round(stats.percent("c", F.col("c") + F.col("d")), 1)
    return rows.select(*by, "a", "b", "c", "d", t.alias("target_pct"), c.alias("control_pct"), F.round(t - c, 1).alias("diff_pp"))


def batches(df: DataFrame, size: int, order: list[str], arm: str = "arm") -> DataFrame:
    """df with batch (from 0), of `size` rows in processing order, within each arm."""
    rows = numbered(df, order, (arm,), "ord_")
    return rows.withColumn("batch", F.floor(F.col("ord_") / size)).drop("ord_")


def coverage(long: DataFrame, base: DataFrame, key: list[str], raters: list[str], rater: str = "rater") -> DataFrame:
    """Per rater: judged items of the base, all items of the base, whether complete."""
    n = base.select(*key).distinct().agg(F.count("*").alias("base_items"))
    judged = restrict(long, base, key).groupBy(rater).agg(F.count_distinct(*key).alias("judged"))
    every = long.sparkSession.createDataFrame([(r,) for r in raters], f"{rater} string")
    out = every.join(judged, rater, "left").crossJoin(F.broadcast(n)).withColumn("judged", F.coalesce("judged", F.lit(0).cast("long")))
    return out.withColumn("complete", F.col("judged") == F.col("base_items"))


def panels(df: DataFrame, members: dict[str, list[str]], target: str, control: str, arm: str = "arm") -> DataFrame:
    """Several panels of raters over one table: O/S/X by arm, chi-squared, Cramer's V and Fleiss' kappa of each.

    df has a boolean column per rater; an item counts for a panel if all its members judged it. One
    scan serves all panels.
    """
    votes = []
    for name, raters in members.items():
        known = [F.col(r).cast("int") for r in raters]
        votes.append(F.struct(F.lit(name).alias("panel"), F.lit(len(raters)).alias("raters"), sum(known[1:], known[0]).alias("vote_sum")))
    rows = df.where(F.col(arm).isin(target, control)).select(arm, F.explode(F.array(*votes)).alias("v")).select(arm, "v.*")
    rows = rows.where(F.col("vote_sum").isNotNull())
    kind = F.when(F.col("vote_sum") == F.col("raters"), "o").when(F.col("vote_sum") == 0, "x").otherwise("s")
    cells = [
        F.count_if((F.col(arm) == a) & (kind == k)).alias(f"{name}_{k}") for name, a in (("target", target), ("control", control)) for k in "osx"
    ]
    r, s = F.col("raters").cast("double"), F.col("vote_sum").cast("double")
    sums = rows.groupBy("panel", "raters").agg(*cells, F.count("*").alias("n"), F.sum(s).alias("s_"), F.sum(s * s + (r - s) * (r - s)).alias("q_"))
    n = F.col("n").cast("double")
    p = F.col("s_") / (n * r)
    seen, chance = (F.col("q_") - n * r) / (n * r * (r - 1)), p * p + (1 - p) * (1 - p)
    kappa = F.when(chance >= 1, F.when(seen >= 1, F.lit(1.0))).otherwise((seen - chance) / (1 - chance))
    chi = stats.chi2_table([[f"{name}_{k}" for k in "osx"] for name in ("target", "control")])
    return sums.withColumn("chi2", chi).withColumn("cramers_v", stats.cramers_v("chi2", "n")).withColumn("fleiss_kappa", kappa).drop("s_", "q_")
