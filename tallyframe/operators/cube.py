"""A cube of sufficient statistics: counts by arm, strata and pattern of votes, from which every report of judged items follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.operators import agreement, judgments, strata
from tallyframe.operators.bootstrap import cramers_v_interval
from tallyframe.storage import durable

#: The parts of a report, in order.
PARTS = (
    "coverage consensus rater truth pair agreement agreement_arm o_against_rest o_against_x definition "
    "books crude common_book homogeneity_book sign_book book group common_group common_rater"
).split()


def cube(wide: DataFrame, raters: list[str], by: tuple[str, ...] = (), arm: str = "arm") -> DataFrame:
    """arm, the columns `by`, votes (0, 1 or null for each rater, in order) and items, the number of items with these.

    wide has a row per item and a boolean column per rater, null where that one did not judge. One
    pre-aggregated grouping; its size depends on strata and raters, not on items. It is written, so
    that what is derived from it never reads the items again.
    """
    votes = F.array(*(F.col(r).cast("int") for r in raters))
    return durable(wide.groupBy(arm, *by, votes.alias("votes")).agg(F.count("*").alias("items")))


def panels(counts: DataFrame, raters: list[str], members: dict[str, list[str]], by: tuple[str, ...] = (), base: list[str] | None = None, arm: str = "arm") -> DataFrame:
    """The cube once per panel: panel, raters (how many), members, arm, by, votes of the members, vote_sum, items, known.

    Only items that all of `base` judged count (by default all items). known says whether all members
    judged them: a panel's statistics are those of known rows, for every one of its raters, and the rest
    is what it lacks of the base.
    """
    at = {r: F.element_at("votes", i + 1) for i, r in enumerate(raters)}
    judged = lambda names: reduce(lambda x, y: x & y, (at[r].isNotNull() for r in names), F.lit(True))
    each = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(name).alias("panel"),
                    F.lit(len(own)).alias("raters"),
                    F.array(*map(F.lit, own)).alias("members"),
                    F.array(*(at[r] for r in own)).alias("votes"),
                    judged(own).alias("known"),
                )
                for name, own in members.items()
            )
        )
    )
    rows = counts.where(judged(base or [])).select(arm, *by, "items", each.alias("p")).select("p.*", arm, *by, "items")
    rows = rows.groupBy("panel", "raters", "members", arm, *by, "votes", "known").agg(F.sum("items").alias("items"))
    return rows.withColumn("vote_sum", F.aggregate("votes", F.lit(0), lambda s, x: s + x))


def coverage(rows: DataFrame) -> DataFrame:
    """Per panel: items that all members judged, items of the base, and whether the panel is complete."""
    sums = rows.groupBy("panel").agg(judgments.tally(F.col("known"), "items").alias("common"), F.sum("items").alias("base"))
    return sums.withColumn("complete", F.col("common") == F.col("base"))


def tidy(df: DataFrame, part: str | None, item: str | None = None) -> DataFrame:
    """A table's numbers as rows of panel, part, item, measure and value; item names the column that tells rows apart.

    Without a part, df has a column of that name.
    """
    measures = [c for c, t in df.dtypes if t != "string" and c not in (item, "panel", "raters")]
    values = ", ".join(f"'{c}', cast(`{c}` as double)" for c in measures)
    rows = df.select(
        "panel",
        (F.col("part") if part is None else F.lit(part)).alias("part"),
        (F.lit("") if item is None else F.col(item).cast("string")).alias("item"),
        F.expr(f"stack({len(measures)}, {values})").alias("measure", "value"),
    )
    return rows.where("value is not null")


def report(
    rows: DataFrame,
    target: str,
    control: str,
    book: str,
    group: str,
    least: int = 5,
    parts: list[str] | None = None,
    replicates: int = 0,
    allow_partial: bool = True,
) -> DataFrame:
    """All statistics of each panel as rows of panel, part, item, measure and value.

    rows are those of panels(). coverage: items judged by all members, and of the base. consensus, rater,
    truth: O, S and X with chi-squared and V, each rater's rates, the 2x2 of unanimous items. pair,
    agreement, agreement_arm: Cohen's and Fleiss' kappa. o_against_rest, o_against_x, definition: effects
    with their intervals, by definition of a positive item. books to common_rater: strata. With
    replicates, bootstrap: the interval of V. A panel that lacks items of the base is left out unless
    allow_partial; values that are not defined are left out.
    """
    wanted = PARTS if parts is None else parts
    own, size, weight = ("panel",), ("panel", "raters"), "items"
    covered = coverage(rows)
    if not allow_partial:
        rows = rows.join(F.broadcast(covered.where("complete").select("panel")), "panel", "left_semi")
        covered = covered.where("complete")
    rows = rows.where(F.col("known") & F.col("arm").isin(target, control))
    is_target, whole = F.col("arm") == target, F.col("vote_sum") == F.col("raters")
    cells = judgments.consensus(rows, F.col("raters"), target, control, by=own, weight=weight)
    votes = F.explode(F.arrays_zip(F.col("members").alias("rater"), F.col("votes").alias("vote"))).alias("v")
    each = rows.select("panel", "arm", book, weight, votes).select("panel", "arm", book, weight, "v.rater", (F.col("v.vote") == 1).alias("judgment"))
    books = judgments.two_by_two(rows, whole, is_target, (*own, book), weight)
    groups = judgments.two_by_two(rows, whole, is_target, (*own, group), weight)
    enough = F.least(F.col("a") + F.col("b"), F.col("c") + F.col("d"))
    # Effects of all parts are tables of a, b, c and d; they become bundles together.
    crossed = lambda df, part, item="''", x=tuple("abcd"): df.selectExpr("panel", f"'{part}' as part", f"{item} as item", *(f"{e} as {k}" for k, e in zip("abcd", x, strict=True)))
    tables = {
        "o_against_rest": lambda: crossed(cells, "o_against_rest", x=("target_o", "target_s + target_x", "control_o", "control_s + control_x")),
        "o_against_x": lambda: crossed(cells, "o_against_x", x=("target_o", "target_x", "control_o", "control_x")),
        "definition": lambda: crossed(agreement.definitions(rows, "raters", target, control, by=size, weight=weight), "definition", "definition"),
        "crude": lambda: crossed(books.groupBy("panel").agg(*(F.sum(c).alias(c) for c in "abcd")), "crude"),
    }
    pair = lambda: agreement.pairs(rows, own, weight).withColumn("pair", F.concat_ws("-", "rater_1", "rater_2"))
    made = {
        "coverage": lambda: (covered,),
        "consensus": lambda: (cells,),
        "rater": lambda: (judgments.rater_rates(each, target, control, by=own, weight=weight), "rater"),
        "truth": lambda: (judgments.truth_table(rows, F.col("raters"), target, control, by=own, weight=weight),),
        "pair": lambda: (pair(), "pair"),
        "agreement": lambda: (agreement.fleiss(rows, "raters", size, weight),),
        "agreement_arm": lambda: (agreement.fleiss(rows, "raters", (*size, "arm"), weight), "arm"),
        "books": lambda: (books.groupBy("panel").agg(F.count("*").alias("books"), F.count_if(enough >= 1).alias("both_arms"), F.count_if(enough >= least).alias("enough")),),
        "common_book": lambda: (strata.mantel_haenszel(books, own),),
        "homogeneity_book": lambda: (strata.woolf_homogeneity(books.where(enough >= least), own),),
        "sign_book": lambda: (strata.sign_test(books, least, own),),
        "book": lambda: (strata.per_stratum(books, book, least, own), book),
        "group": lambda: (strata.per_stratum(groups, group, by=own), group),
        "common_group": lambda: (strata.mantel_haenszel(groups, own),),
        "common_rater": lambda: (strata.mantel_haenszel(judgments.two_by_two(each, F.col("judgment"), is_target, (*own, "rater", book), weight), (*own, "rater")), "rater"),
    }
    out = [tidy(*(x := made[part]())[:1], part, *x[1:]) for part in wanted if part in made]
    if effects := [tables[part]() for part in wanted if part in tables]:
        every = reduce(DataFrame.unionByName, effects).withColumn("e", stats.bundle(*"abcd"))
        out.append(tidy(every.select("panel", "part", "item", *"abcd", "e.*"), None, "item"))
    if replicates:
        out.append(tidy(cramers_v_interval(cells, replicates, by=own), "bootstrap"))
    return reduce(DataFrame.unionByName, out)


def summary(found: DataFrame) -> DataFrame:
    """A row per panel of report(): size, shares of O, S and X by arm, chi-squared, V, kappa, effect with its intervals,
    odds ratios crude and common, differences by definition."""
    value = lambda part, measure, item="": F.max(
        F.when((F.col("part") == part) & (F.col("measure") == measure) & (F.col("item") == item), F.col("value"))
    )
    names = [f"{arm}_{k}" for arm in ("target", "control") for k in "osx"]
    rows = found.groupBy("panel").agg(
        *(value("consensus", c).alias(c) for c in [*names, "n", "chi2", "cramers_v"]),
        *(value("coverage", c).alias(c) for c in ("common", "base", "complete")),
        *(value("agreement", c).alias(f"fleiss_{c}") for c in ("kappa", "unanimous_pct")),
        *(value("o_against_rest", c).alias(c) for c in ("diff_pp", "diff_low", "diff_high", "odds_ratio", "or_low", "or_high")),
        *(value("common_book", c).alias(f"book_{c}") for c in ("odds_ratio", "or_low", "or_high")),
        *(value("definition", "diff_pp", c).alias(f"diff_{c}") for c in ("unanimous", "majority", "any")),
    )
    share = [stats.percent(f"{arm}_{k}", F.col(f"{arm}_o") + F.col(f"{arm}_s") + F.col(f"{arm}_x")).alias(f"{arm}_{k}_pct") for arm in ("target", "control") for k in "osx"]
    return rows.select("panel", "n", *share, *(c for c in rows.columns if c not in (*names, "panel", "n")))
