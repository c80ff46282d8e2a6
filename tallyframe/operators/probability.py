"""A rater that answers with probabilities, against raters that vote: all comparisons from one joint histogram."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.operators import ranks
from tallyframe.operators.judgments import tally
from tallyframe.storage import durable

CUTS = (0.5, 0.6, 0.7, 0.8, 0.9)


def histogram(df: DataFrame, p: str, raters: list[str], flip: str | None = None, other: str | None = None, arm: str = "arm") -> DataFrame:
    """arm, votes, p, q, other and items: how many items have these.

    df has a row per item with a boolean column per rater. Items without p or without a rater's vote do
    not count. q is the answer to the opposite question and other that of another model; both may be
    absent or null. One pre-aggregated grouping, written, from which the report never returns to the items.
    """
    votes = F.array(*(F.col(r).cast("int") for r in raters))
    value = lambda c: (F.lit(None) if c is None else F.col(c)).cast("double")
    rows = df.where(reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (p, *raters))))
    return durable(rows.groupBy(F.col(arm).alias("arm"), votes.alias("votes"), value(p).alias("p"), value(flip).alias("q"), value(other).alias("other")).agg(F.count("*").alias("items")))


def _crossed(x: Column, y: Column, name: str) -> list[Column]:
    """Counts of items by two conditions, as fields of one aggregation."""
    cells = (x & y, x & ~y, ~x & y, ~x & ~y)
    return [tally(c, "items").alias(f"{name}_{k}") for c, k in zip(cells, "abcd", strict=True)]


def report(hist: DataFrame, raters: list[str], target: str, control: str, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """Rows of part, item, measure and value from a histogram.

    sizes: items by arm and of unanimous votes. rank: Spearman's correlation of p and the number of votes,
    and AUC of p for unanimous items and for the arms. reference: the effect (shares of both arms,
    chi-squared, p-value, phi) of unanimous votes, of the majority and of each rater. between: kappa of
    each pair of raters. threshold: the same effect for p at each cut, with kappa against majority and
    each rater. other: another model on the items that both answered: Pearson, Spearman, kappa at 0.5,
    its own AUC. flip: answers to the opposite question. Undefined values are left out. Two by two
    tables of all parts are counted in one scan of the histogram.
    """
    rows = hist.where(F.col("arm").isin(target, control))
    rows = rows.withColumn("votes_", F.aggregate("votes", F.lit(0), lambda s, x: s + x))
    n, is_target = len(raters), F.col("arm") == target
    vote = {r: F.element_at("votes", i + 1) == 1 for i, r in enumerate(raters)}
    majority, whole = F.col("votes_") >= n // 2 + 1, F.col("votes_") == n
    effects = {"reference:unanimous": whole, "reference:majority": majority, **{f"reference:{r}": v for r, v in vote.items()}, **{f"threshold:{c}": F.col("p") >= c for c in cuts}}
    kappas: dict[tuple[str, str], tuple[Column, Column]] = {(f"between:{a}~{b}", "kappa"): (vote[a], vote[b]) for a, b in combinations(raters, 2)}
    for c in cuts:
        kappas |= {(f"threshold:{c}", f"kappa_{name}"): (F.col("p") >= c, v) for name, v in {"majority": majority, **vote}.items()}
    both = F.col("other").isNotNull()
    kappas["other:", "kappa_at_half"] = (F.when(both, F.col("p") >= 0.5), F.when(both, F.col("other") >= 0.5))
    flipped, pair = F.col("q").isNotNull(), F.col("p") + F.col("q")
    total = lambda x: F.sum(F.when(flipped, x * F.col("items")))
    counts = rows.agg(
        *(x for i, c in enumerate(effects.values()) for x in _crossed(is_target, c, f"e{i}")),
        *(x for i, (c, d) in enumerate(kappas.values()) for x in _crossed(c, d, f"k{i}")),
        *(tally(c, "items").alias(name) for name, c in {"n": F.lit(True), "n_target": is_target, "n_control": ~is_target, "n_unanimous_o": whole, "n_unanimous_x": F.col("votes_") == 0, "flip_n": flipped, "other_n": both}.items()),
        total(pair).alias("sum"),
        total(F.abs(pair - 1)).alias("gap"),
        tally((F.col("p") >= 0.5) & (F.col("q") >= 0.5), "items").alias("yes"),
        tally((F.col("p") < 0.5) & (F.col("q") < 0.5), "items").alias("no"),
    )

    def values(item: str, measures: dict[str, Column]) -> list[Column]:
        part, _, name = item.partition(":")
        return [F.struct(F.lit(part).alias("part"), F.lit(name).alias("item"), F.lit(m).alias("measure"), v.cast("double").alias("value")) for m, v in measures.items()]

    made: list[Column] = values("sizes:", {c: F.col(c) for c in ("n", "n_target", "n_control", "n_unanimous_o", "n_unanimous_x")})
    for i, item in enumerate(effects):
        abcd = [f"e{i}_{k}" for k in "abcd"]
        a, b, c, d = map(F.col, abcd)
        made += values(item, {"target_pct": stats.percent(a, a + b), "control_pct": stats.percent(c, c + d), "chi2": stats.chi2(*abcd), "phi": stats.phi(*abcd)})
    for i, (item, measure) in enumerate(kappas):
        made += values(item, {measure: stats.cohen_kappa(*(f"k{i}_{k}" for k in "abcd"), "null")})
    made += values("other:", {"n": F.nullif("other_n", F.lit(0))})
    share = lambda x: F.try_divide(F.col(x), F.nullif("flip_n", F.lit(0)))
    made += values("flip:", {"n": F.nullif("flip_n", F.lit(0)), "mean_sum": share("sum"), "mean_gap": share("gap"), "both_yes_pct": 100 * share("yes"), "both_no_pct": 100 * share("no")})
    out = counts.select(F.explode(F.array(*made)).alias("v")).select("v.*")
    chi = out.where("measure = 'chi2'").select("part", "item", F.lit("p").alias("measure"), stats.chi2_sf("value", F.lit(1)).alias("value"))
    named = lambda df, part, measure, value: df.select(F.lit(part).alias("part"), F.lit("").alias("item"), F.lit(measure).alias("measure"), F.col(value).cast("double").alias("value"))
    unanimous = rows.where(F.col("votes_").isin(0, n))
    parts = [
        out,
        chi,
        named(ranks.spearman(rows, "p", "votes_", "items"), "rank", "spearman_votes", "r"),
        named(ranks.auc(unanimous, "p", whole, "items"), "rank", "auc_unanimous", "auc"),
        named(ranks.auc(rows, "p", is_target, "items"), "rank", "auc_target", "auc"),
        named(ranks.pearson(rows, "p", "other", "items"), "other", "pearson", "r"),
        named(ranks.spearman(rows, "p", "other", "items"), "other", "spearman", "r"),
        named(ranks.auc(unanimous.where(both), "other", whole, "items"), "other", "auc_unanimous", "auc"),
        named(ranks.pearson(rows, "p", "q", "items"), "flip", "r", "r"),
    ]
    return reduce(DataFrame.unionByName, parts).where("value is not null")
