"""What a table of rewrite rules covers of a vocabulary: families of forms, forms it leaves alone, pairs it could join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import profile
from tallyframe.storage import durable


def families(vocabulary: DataFrame, rules: dict[str, str], marker: str = "marker", n: str = "n", rounds: int = 60) -> DataFrame:
    """form, n, normal, steps and cyclic of every form of the vocabulary and the rules.

    A form is rewritten again and again: normal is the form at which that ends, steps how many rewritings
    lead there. Each form has one next form, so paths are followed by doubling, in as many rounds as the
    logarithm of the longest path. Rules that lead in a circle have no end: cyclic is true and normal
    is the least form of the circle. Forms that only the rules have count 0; null forms are left out.
    Rules that still make new forms after `rounds` rewritings, as they lengthen them, are refused.
    """
    known = vocabulary.where(F.col(marker).isNotNull()).groupBy(F.col(marker).alias("form")).agg(F.sum(n).alias("n"))
    ends = vocabulary.sparkSession.createDataFrame([(x,) for x in sorted({*rules, *rules.values()})], "form string")
    forms = ends.join(known, "form", "full").fillna(0, ["n"])
    # Rewriting may lead to forms that neither has.
    seen, fresh = [], durable(forms.withColumn("next", text.rewrite("form", rules)))
    while fresh.head(1):
        if len(seen) == rounds:
            raise ValueError(f"the rules make new forms after {rounds} rewritings")
        seen.append(fresh)
        every = reduce(DataFrame.unionByName, seen).select("form")
        new = fresh.select(F.col("next").alias("form")).distinct().join(every, "form", "left_anti")
        fresh = durable(new.select("form", F.lit(0).cast("long").alias("n"), text.rewrite("form", rules).alias("next")))
    rows = durable(reduce(DataFrame.unionByName, seen)) if seen else fresh
    size = rows.count()
    steps = (F.col("next") != F.col("form")).cast("long")
    paths = rows.select("form", F.col("next").alias("to"), F.least("form", "next").alias("least"), steps.alias("steps"))
    reach = 1
    while reach < size:
        on = paths.select(F.col("form").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("steps").alias("steps2"))
        longer = paths.join(on, "to").select("form", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("steps") + F.col("steps2")).alias("steps"))
        longer, reach, before = durable(longer), 2 * reach, paths
        paths = longer
        if not longer.select("form", "to").exceptAll(before.select("form", "to")).head(1):
            break
    # A path's end is a form that stays as it is, or a place on a circle whose least form stands for it.
    last = paths.select(F.col("form").alias("to"), F.col("least").alias("normal"), (F.col("steps") > 0).alias("cyclic"))
    out = rows.select("form", "n").join(paths.select("form", "to", "steps"), "form").join(last, "to")
    return out.select("form", "n", F.when(F.col("cyclic"), F.col("normal")).otherwise(F.col("to")).alias("normal"), F.when(~F.col("cyclic"), F.col("steps")).alias("steps"), "cyclic")


def uncovered(vocabulary: DataFrame, rules: dict[str, str], least: int = 50, marker: str = "marker", n: str = "n") -> DataFrame:
    """Frequent forms that no rule names and that rewriting leaves alone: marker and n."""
    rows = vocabulary.where(F.col(n) >= least).select(F.col(marker).alias("marker"), F.col(n).alias("n"))
    named = F.col("marker").isin(list(rules)) if rules else F.lit(False)
    return rows.where(~named & (text.rewrite("marker", rules) == F.col("marker")))


def audit(
    vocabulary: DataFrame, rules: dict[str, str], patterns: list[tuple[str, Column]], least: int = 50, least_pair: int = 1, marker: str = "marker", n: str = "n"
) -> DataFrame:
    """Gaps of a rule table as rows of part, kind, first, second, n_first, n_second, together and place.

    pair: forms outside the table of which a pattern's rewriting is in the vocabulary too, each unordered
    pair once, for the first pattern that yields it; the most frequent pairs of each kind come first.
    uncovered: see there, the most frequent first. family: normal forms with several forms, how many
    there are (n_first) and how often they occur (n_second), the most frequent first; a circle of
    rules is of kind cyclic. Ties go by form.
    """
    named = F.col(marker).isin(list(rules)) if rules else F.lit(False)
    held = [(name, F.when(~named, form)) for name, form in patterns]
    pairs = profile.variant_pairs(vocabulary, held, marker, n, least_pair)
    groups = families(vocabulary, rules, marker, n).groupBy("normal").agg(F.count("*").alias("forms"), F.sum("n").alias("n"), F.max("cyclic").alias("cyclic")).where("forms > 1")
    none = F.lit(None).cast("string")
    shape = lambda df, part, kind, first, second, a, b, all_: df.select(F.lit(part).alias("part"), kind.alias("kind"), first.alias("first"), second.alias("second"), a.cast("long").alias("n_first"), b.cast("long").alias("n_second"), all_.cast("long").alias("together"))
    bare, zero = uncovered(vocabulary, rules, least, marker, n), F.lit(None)
    rows = [
        shape(pairs, "pair", F.col("rule"), F.col("marker"), F.col("form"), F.col("n"), F.col("form_n"), F.col("together")),
        shape(bare, "uncovered", F.lit(""), F.col("marker"), none, F.col("n"), zero, F.col("n")),
        shape(groups, "family", F.when(F.col("cyclic"), "cyclic").otherwise(""), F.col("normal"), none, F.col("forms"), F.col("n"), F.col("n")),
    ]
    return profile.placed_by(reduce(DataFrame.unionByName, rows), ["part", "kind"], "together", ["first", "second"])
