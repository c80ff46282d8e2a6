"""Registered queries over the test tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import stats, text
from tallyframe.operators import agreement, clusters, joins, judgments, profile, ranks, sampling, strata, vectors
from tallyframe.operators.bootstrap import cramers_v_interval
from tallyframe.plans import adapters as A
from tallyframe.plans import provenance
from tallyframe.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.add
DIGITS = 6
BOTH = '"both"'


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """df with its doubles rounded, as results are compared across engines."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _strata(spark: SparkSession, sf_dir: str, by: str = "book") -> DataFrame:
    rows = A.items(spark, sf_dir)
    return judgments.two_by_two(rows, F.col("vote_sum") == 3, F.col("arm") == "O", (by,))


_2X2 = """count(*) FILTER (t AND y)::BIGINT AS a, count(*) FILTER (t AND NOT y)::BIGINT AS b,
  count(*) FILTER (NOT t AND y)::BIGINT AS c, count(*) FILTER (NOT t AND NOT y)::BIGINT AS d"""
_STRATA = f"WITH {A.SQL_WIDE}, s AS (SELECT book, {_2X2} FROM (SELECT book, arm = 'O' AS t, vs = 3 AS y FROM j) GROUP BY book)"
_CHI = "CASE WHEN (a+b)::DOUBLE*(c+d)*(a+c)*(b+d) = 0 THEN 0 ELSE (a+b+c+d)::DOUBLE * (a*d-b*c)::DOUBLE * (a*d-b*c) / ((a+b)::DOUBLE*(c+d)*(a+c)*(b+d)) END"
_YATES = "CASE WHEN (a+b)::DOUBLE*(c+d)*(a+c)*(b+d) = 0 THEN 0 ELSE (a+b+c+d)::DOUBLE * power(greatest(0, abs(a*d-b*c) - (a+b+c+d) / 2.0::DOUBLE), 2) / ((a+b)::DOUBLE*(c+d)*(a+c)*(b+d)) END"

# --- consensus ---------------------------------------------------------------------------------

_CELLS6 = ", ".join(
    f"count(*) FILTER (arm = '{a}' AND vs {k})::BIGINT AS {n}_{x}"
    for n, a in (("target", "O"), ("control", "F"))
    for x, k in (("o", "= 3"), ("s", "IN (1, 2)"), ("x", "= 0"))
)
_CHI6 = " + ".join(
    f"CASE WHEN tn * (target_{k} + control_{k}) = 0 THEN 0 ELSE power({n}_{k} - {m}::DOUBLE * (target_{k} + control_{k}) / n, 2) / ({m}::DOUBLE * (target_{k} + control_{k}) / n) END"
    for n, m in (("target", "tn"), ("control", "cn"))
    for k in "osx"
)


@query(
    "consensus_osx",
    f"""WITH {A.SQL_WIDE}, g AS (SELECT {_CELLS6}, count(*)::BIGINT AS n, count(*) FILTER (arm = 'O') AS tn, count(*) FILTER (arm = 'F') AS cn FROM j WHERE arm IN ('O', 'F')),
h AS (SELECT *, {_CHI6} AS chi2 FROM g)
SELECT * EXCLUDE (tn, cn) REPLACE (round(chi2, 6) AS chi2), round(sqrt(chi2 / n), 6) AS cramers_v FROM h""",
)
def consensus_osx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judgments.consensus(A.items(spark, sf_dir), 3, "O", "F"))


@query(
    "arm_class_counts",
    f"WITH {A.SQL_WIDE} SELECT arm, count(*) FILTER (vs = 3)::BIGINT AS o, count(*) FILTER (vs IN (1,2))::BIGINT AS s, count(*) FILTER (vs = 0)::BIGINT AS x, count(*)::BIGINT AS n FROM j GROUP BY arm",
)
def arm_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments.arm_counts(A.items(spark, sf_dir), 3)


@query(
    "per_rater_rates",
    f"""WITH {A.SQL_LONG}, s AS (SELECT rater, {_2X2} FROM (SELECT rater, arm = 'O' AS t, judgment AS y FROM jl WHERE arm IN ('O','F')) GROUP BY rater)
SELECT rater, a + b AS target_n, a AS target_positive, c + d AS control_n, c AS control_positive, round(100.0::DOUBLE * a / (a + b), 6) AS target_pct,
  round(100.0::DOUBLE * c / (c + d), 6) AS control_pct, round(100.0::DOUBLE * a / (a + b) - 100.0::DOUBLE * c / (c + d), 6) AS diff_pp, round({_CHI}, 6) AS chi2 FROM s""",
)
def per_rater_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judgments.rater_rates(A.long(spark, sf_dir), "O", "F"))


@query(
    "truth_table_2x2",
    f"""WITH {A.SQL_WIDE}, s AS (SELECT {_2X2} FROM (SELECT arm = 'O' AS t, vs = 3 AS y FROM j WHERE arm IN ('O','F'))),
r AS (SELECT *, round(100.0::DOUBLE * a / (a + b), 1) AS target_pct, round(100.0::DOUBLE * c / (c + d), 1) AS control_pct FROM s)
SELECT *, round(target_pct - control_pct, 1) AS diff_pp FROM r""",
)
def truth_table_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments.truth_table(A.items(spark, sf_dir), 3, "O", "F")


# --- assembling --------------------------------------------------------------------------------


def _deduped(order: str) -> str:
    cols = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    return f"""SELECT okey, lnum, arm, partkey, discount, quantity FROM (SELECT l_orderkey AS okey, l_linenumber AS lnum, l_linestatus AS arm, l_partkey AS partkey,
  l_discount AS discount, l_quantity AS quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_linestatus ORDER BY {', '.join(c + order for c in cols)}) AS k
  FROM lineitem) WHERE k = 1"""


@query("dedupe_last_wins", _deduped(" DESC"))
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments.dedupe(A.raw_judgments(spark, sf_dir), A.KEY, A.ORDER)
    return rows.select(*A.KEY, "partkey", "discount", "quantity")


@query("dedupe_first_wins", _deduped(""))
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments.dedupe(A.raw_judgments(spark, sf_dir), A.KEY, A.ORDER, keep="first")
    return rows.select(*A.KEY, "partkey", "discount", "quantity")


@query(
    "resume_anti",
    f"""WITH {A.SQL_WIDE} SELECT arm, count(*)::BIGINT AS todo FROM j
WHERE NOT (book < 5 OR (book = 7 AND quantity > 30)) GROUP BY arm""",
)
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = A.wide(spark, sf_dir)
    base, extra = wanted.where("book < 5"), wanted.where("book = 7 and quantity > 30")
    return judgments.remaining(wanted, [base, extra], A.KEY).groupBy("arm").agg(F.count("*").alias("todo"))


@query("panel_semi", "SELECT lang, count(*)::BIGINT AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang")
def panel_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "labels").where("quality = 1")
    return judgments.restrict(table(spark, sf_dir, "documents"), base, ["doc_id"]).groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "union_drift",
    f"""WITH {A.SQL_WIDE}, u AS (SELECT arm, flag AS section, NULL::BIGINT AS level FROM j WHERE book < 10 UNION ALL SELECT arm, NULL, book FROM j WHERE book >= 10)
SELECT arm, section, level, count(*)::BIGINT AS n FROM u GROUP BY ALL""",
)
def union_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.wide(spark, sf_dir)
    base = rows.where("book < 10").select("arm", F.col("flag").alias("section"))
    extra = rows.where("book >= 10").select("arm", F.col("book").alias("level"))
    return judgments.union_all(base, extra).groupBy("arm", "section", "level").agg(F.count("*").alias("n"))


@query(
    "batch_assignment",
    f"""WITH {A.SQL_WIDE}, b AS (SELECT arm, floor((row_number() OVER (PARTITION BY arm ORDER BY okey, lnum) - 1) / 20)::BIGINT AS batch, okey FROM j)
SELECT arm, batch, count(*)::BIGINT AS items, sum(okey)::BIGINT AS key_sum FROM b GROUP BY arm, batch""",
)
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments.batches(A.wide(spark, sf_dir), 20, ["okey", "lnum"])
    return rows.groupBy("arm", "batch").agg(F.count("*").alias("items"), F.sum("okey").alias("key_sum"))


@query(
    "panel_coverage",
    f"""WITH {A.SQL_LONG}, base AS (SELECT DISTINCT okey, lnum, arm FROM j WHERE book < 20), n AS (SELECT count(*)::BIGINT AS base_items FROM base),
g AS (SELECT rater, count(DISTINCT (okey, lnum, arm))::BIGINT AS judged FROM jl WHERE (rater <> 'r3' OR flag <> 'N') AND (okey, lnum, arm) IN (SELECT (okey, lnum, arm) FROM base) GROUP BY rater)
SELECT rater, judged, base_items, judged = base_items AS complete FROM g, n""",
)
def panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.long(spark, sf_dir).where("rater <> 'r3' or flag <> 'N'")
    return judgments.coverage(rows, A.wide(spark, sf_dir).where("book < 20"), A.KEY, A.RATERS)


# --- agreement ---------------------------------------------------------------------------------

_PAIRS = " UNION ALL ".join(
    f'''SELECT '{x}' AS rater_1, '{y}' AS rater_2, count(*) FILTER ({x} AND {y})::BIGINT AS "both", count(*) FILTER ({x} AND NOT {y})::BIGINT AS first_only, count(*) FILTER (NOT {x} AND {y})::BIGINT AS second_only, count(*) FILTER (NOT {x} AND NOT {y})::BIGINT AS neither FROM j'''
    for x, y in (("r1", "r2"), ("r1", "r3"), ("r2", "r3"))
)


def _kappa_sql(both: str, first: str, second: str, neither: str) -> str:
    n = f"({both} + {first} + {second} + {neither})"
    pe = f"((({both} + {first})::DOUBLE * ({both} + {second}) + ({second} + {neither})::DOUBLE * ({first} + {neither})) / ({n}::DOUBLE * {n}))"
    return f"((({both} + {neither})::DOUBLE / {n} - {pe}) / (1 - {pe}))"


@query(
    "agreement_pairwise",
    f'''WITH {A.SQL_WIDE}, q AS ({_PAIRS}) SELECT *, round(100.0::DOUBLE * ("both" + neither) / ("both" + first_only + second_only + neither), 6) AS agreement_pct, round({_kappa_sql(BOTH, 'first_only', 'second_only', 'neither')}, 6) AS kappa FROM q''',
)
def agreement_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.pairwise(A.items(spark, sf_dir), A.RATERS))


_FLEISS = """SELECT {by}n, positive, unanimous, round(100.0::DOUBLE * unanimous / n, 6) AS unanimous_pct, round((o - ch) / (1 - ch), 6) AS kappa FROM (
  SELECT {by}count(*)::BIGINT AS n, sum(vs)::BIGINT AS positive, count(*) FILTER (vs IN (0, 3))::BIGINT AS unanimous,
    avg((vs * vs + (3 - vs) * (3 - vs) - 3)::DOUBLE / 6) AS o, power(sum(vs) / (3.0::DOUBLE * count(*)), 2) + power(1 - sum(vs) / (3.0::DOUBLE * count(*)), 2) AS ch
  FROM j {group})"""


@query("agreement_fleiss", f"WITH {A.SQL_WIDE} " + _FLEISS.format(by="", group=""))
def agreement_fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.fleiss(A.items(spark, sf_dir), 3))


@query("agreement_fleiss_by_arm", f"WITH {A.SQL_WIDE} " + _FLEISS.format(by="arm, ", group="GROUP BY arm"))
def agreement_fleiss_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.fleiss(A.items(spark, sf_dir), 3, ("arm",)))


_Z = "1.959963984540054::DOUBLE"


def _wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"({k}::DOUBLE / {n})"
    return f"(({p} + {_Z}*{_Z}/(2*{n})) / (1 + {_Z}*{_Z}/{n}) {sign} {_Z} * sqrt({p}*(1-{p})/{n} + {_Z}*{_Z}/(4.0::DOUBLE*{n}*{n})) / (1 + {_Z}*{_Z}/{n}))"


def _effect_sql(source: str, keep: str = "") -> str:
    """The bundle of a 2x2 effect in SQL, step by step."""
    return f"""SELECT {keep}a, b, c, d, round(100 * p1, 6) AS target_pct, round(100 * p2, 6) AS control_pct, round(100 * (p1 - p2), 6) AS diff_pp,
  round(100 * (p1 - p2 - sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))), 6) AS diff_low, round(100 * (p1 - p2 + sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))), 6) AS diff_high,
  round(e, 6) AS odds_ratio, round(exp(ln(e) - {_Z} * se), 6) AS or_low, round(exp(ln(e) + {_Z} * se), 6) AS or_high, z AS or_corrected, round({_CHI}, 6) AS chi2
FROM (SELECT *, (a+h)*(d+h)/((b+h)*(c+h)) AS e, sqrt(1/(a+h)+1/(b+h)+1/(c+h)+1/(d+h)) AS se FROM (
  SELECT *, a::DOUBLE/(a+b) AS p1, c::DOUBLE/(c+d) AS p2, {_wilson_sql('a', '(a+b)', '-')} AS l1, {_wilson_sql('a', '(a+b)', '+')} AS u1,
    {_wilson_sql('c', '(c+d)', '-')} AS l2, {_wilson_sql('c', '(c+d)', '+')} AS u2, a = 0 OR b = 0 OR c = 0 OR d = 0 AS z,
    CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS h FROM {source}))"""


@query("interval_2x2", f"WITH {A.SQL_WIDE}, s AS (SELECT flag, {_2X2} FROM (SELECT flag, arm = 'O' AS t, vs = 3 AS y FROM j) GROUP BY flag), f AS (SELECT * FROM s WHERE a + b > 0 AND c + d > 0) " + _effect_sql("f", "flag, "))
def interval_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments.two_by_two(A.items(spark, sf_dir), F.col("vote_sum") == 3, F.col("arm") == "O", ("flag",))
    rows = rows.where("a + b > 0 and c + d > 0").withColumn("e", stats.bundle(*"abcd"))
    return rounded(rows.select("flag", *"abcd", "e.*"))


@query(
    "sensitivity_thresholds",
    f"""WITH {A.SQL_WIDE}, k(definition, cut) AS (VALUES ('unanimous', 3), ('majority', 2), ('any', 1)),
s AS (SELECT definition, {_2X2} FROM (SELECT definition, arm = 'O' AS t, vs >= cut AS y FROM j, k) GROUP BY definition) """
    + _effect_sql("s", "definition, "),
)
def sensitivity_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.sensitivity(A.items(spark, sf_dir), 3, "O", "F"))


_SWEEP = {"majority": "m", "r2": "r2", "r3": "r3"}
_SWEEP_COUNTS = ", ".join(
    f"count(*) FILTER ({y} AND {m})::BIGINT AS {n}{i}" for n, v in _SWEEP.items() for i, (y, m) in enumerate((("y", v), ("y", f"NOT {v}"), ("NOT y", v), ("NOT y", f"NOT {v}")))
)
_SWEEP_KAPPAS = ", ".join(f"round({_kappa_sql(*(f'{n}{i}' for i in range(4)))}, 6) AS kappa_{n}" for n in _SWEEP)


@query(
    "threshold_sweep",
    f"""WITH {A.SQL_WIDE}, k AS (SELECT unnest([0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS cut),
s AS (SELECT cut, {_2X2}, {_SWEEP_COUNTS}
  FROM (SELECT cut, arm = 'O' AS t, p >= cut AS y, vs >= 2 AS m, r2, r3 FROM j, k) GROUP BY cut)
SELECT cut, a, b, c, d, round(100.0::DOUBLE * (a::DOUBLE / (a + b) - c::DOUBLE / (c + d)), 6) AS diff_pp, round({_CHI}, 6) AS chi2, {_SWEEP_KAPPAS} FROM s""",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.items(spark, sf_dir)
    own = {r: F.element_at("votes", i + 1) == 1 for i, r in enumerate(A.RATERS) if r != "r1"}
    return rounded(agreement.threshold_sweep(rows, F.col("p"), F.col("vote_sum") >= 2, F.col("arm") == "O", raters=own))


@query(
    "flip_control",
    f"""WITH {A.SQL_WIDE}, q AS (SELECT discount * 10 AS p, 1 - tax * 12 AS q FROM j)
SELECT count(*)::BIGINT AS n, round(avg(p + q), 6) AS mean_sum, round(avg(abs(p + q - 1)), 6) AS mean_gap, round(corr(p, q), 6) AS r,
  round(100 * avg((p >= 0.5 AND q >= 0.5)::INT), 6) AS both_yes_pct, round(100 * avg((p < 0.5 AND q < 0.5)::INT), 6) AS both_no_pct FROM q""",
)
def flip_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.wide(spark, sf_dir).select(*A.KEY, (F.col("discount") * 10).alias("p"), (1 - F.col("tax") * 12).alias("q"))
    return rounded(agreement.flip_control(rows.select(*A.KEY, "p").join(rows.select(*A.KEY, "q"), A.KEY)))


@query(
    "drift_agreement",
    f"""WITH {A.SQL_LONG}, f AS (SELECT okey, lnum, arm, rater, judgment AS x, CASE WHEN okey % 7 = 0 THEN NOT judgment ELSE judgment END AS y FROM jl),
s AS (SELECT rater, count(*) FILTER (x AND y)::BIGINT AS "both", count(*) FILTER (x AND NOT y)::BIGINT AS first_only, count(*) FILTER (NOT x AND y)::BIGINT AS second_only, count(*) FILTER (NOT x AND NOT y)::BIGINT AS neither FROM f GROUP BY rater)
SELECT *, "both" + first_only + second_only + neither AS pairs, round(100.0::DOUBLE * ("both" + neither) / ("both" + first_only + second_only + neither), 6) AS agreement_pct, round({_kappa_sql(BOTH, 'first_only', 'second_only', 'neither')}, 6) AS kappa FROM s""",
)
def drift_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = A.long(spark, sf_dir).select(*A.KEY, "rater", "judgment")
    fresh = frozen.withColumn("judgment", F.when(F.col("okey") % 7 == 0, ~F.col("judgment")).otherwise(F.col("judgment")))
    return rounded(agreement.drift(frozen, fresh, A.KEY, ("rater",)))


def _one(votes: str, prefix: str) -> str:
    """Consensus of all items with their vote sum given by an expression."""
    cells = _CELLS6.replace("AS target_", f"AS {prefix}t").replace("AS control_", f"AS {prefix}c")
    return f"(SELECT 100.0::DOUBLE * (count(*) FILTER (arm = 'O' AND vs = 3)::DOUBLE / count(*) FILTER (arm = 'O') - count(*) FILTER (arm = 'F' AND vs = 3)::DOUBLE / count(*) FILTER (arm = 'F')) AS {prefix}d, {cells}, count(*) FILTER (arm='O') AS {prefix}tn, count(*) FILTER (arm='F') AS {prefix}cn, count(*) AS {prefix}n FROM (SELECT arm, {votes} AS vs FROM j))"


def _v(p: str) -> str:
    parts = [
        f"power({p}{s}{k} - {p}{s}n::DOUBLE * ({p}t{k} + {p}c{k}) / {p}n, 2) / ({p}{s}n::DOUBLE * ({p}t{k} + {p}c{k}) / {p}n)" for s in "tc" for k in "osx"
    ]
    return f"sqrt(({' + '.join(parts)}) / {p}n)"


@query(
    "drift_direction",
    f"WITH {A.SQL_WIDE} SELECT round(fd, 6) AS frozen_diff, round(gd, 6) AS fresh_diff, sign(fd) = sign(gd) AS same_direction, round({_v('g')} - {_v('f')}, 6) AS v_change FROM {_one('vs', 'f')}, {_one('CASE WHEN okey % 7 = 0 THEN 3 - vs ELSE vs END', 'g')}",
)
def drift_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item is judged twice; the second time all raters change their minds on some."""
    frozen, fresh = (judgments.consensus(x, 3, "O", "F") for x in A.items_twice(spark, sf_dir))
    return rounded(agreement.direction(frozen, fresh))


# --- strata ------------------------------------------------------------------------------------


def _mh_sql(source: str, by: str = "") -> str:
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by}strata, round(r / s, 6) AS odds_ratio, round(exp(ln(r / s) - {_Z} * sqrt(pr/(2*r*r) + m/(2*r*s) + qs/(2*s*s))), 6) AS or_low,
  round(exp(ln(r / s) + {_Z} * sqrt(pr/(2*r*r) + m/(2*r*s) + qs/(2*s*s))), 6) AS or_high FROM (
  SELECT {by}count(*)::BIGINT AS strata, sum(rr) AS r, sum(ss) AS s, sum(pp*rr) AS pr, sum(pp*ss + qq*rr) AS m, sum(qq*ss) AS qs FROM (
    SELECT {by}(a+d)::DOUBLE/(a+b+c+d) AS pp, (b+c)::DOUBLE/(a+b+c+d) AS qq, a::DOUBLE*d/(a+b+c+d) AS rr, b::DOUBLE*c/(a+b+c+d) AS ss FROM {source} WHERE a+b > 0 AND c+d > 0) {group})"""


@query("mh_stratified", f"{_STRATA} {_mh_sql('s')}")
def mh_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strata.mantel_haenszel(_strata(spark, sf_dir)))


@query(
    "mh_per_rater",
    f"WITH {A.SQL_LONG}, s AS (SELECT rater, book, {_2X2} FROM (SELECT rater, book, arm = 'O' AS t, judgment AS y FROM jl) GROUP BY rater, book) {_mh_sql('s', 'rater, ')}",
)
def mh_per_rater(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judgments.two_by_two(A.long(spark, sf_dir), F.col("judgment"), F.col("arm") == "O", ("rater", "book"))
    return rounded(strata.mantel_haenszel(rows, ("rater",)))


@query(
    "woolf_homogeneity",
    f"""{_STRATA}, l AS (SELECT ln((a+0.5::DOUBLE)*(d+0.5::DOUBLE)/((b+0.5::DOUBLE)*(c+0.5::DOUBLE))) AS l, 1/(1/(a+0.5::DOUBLE)+1/(b+0.5::DOUBLE)+1/(c+0.5::DOUBLE)+1/(d+0.5::DOUBLE)) AS w FROM s WHERE a+b > 0 AND c+d > 0)
SELECT count(*)::BIGINT AS strata, round(sum(w*l*l) - power(sum(w*l), 2) / sum(w), 6) AS chi2, count(*)::BIGINT - 1 AS df FROM l""",
)
def woolf_homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strata.woolf_homogeneity(_strata(spark, sf_dir)))



@query(
    "sign_test_strata",
    f"""{_STRATA}, g AS (SELECT a * (c + d) - c * (a + b) AS gap FROM s WHERE a + b >= 1 AND c + d >= 1),
t AS (SELECT count(*) FILTER (gap > 0)::BIGINT AS w, count(*) FILTER (gap < 0)::BIGINT AS l, count(*) FILTER (gap = 0)::BIGINT AS ties FROM g),
x AS (SELECT w, l, ties, unnest(range(0, least(w, l) + 1)) AS i FROM t)
SELECT w AS wins, l AS losses, ties, round(least(1.0::DOUBLE, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2.0::DOUBLE)))), 6) AS p FROM x GROUP BY w, l, ties""",
)
def sign_test_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strata.sign_test(_strata(spark, sf_dir)))


_PER = """SELECT book, a, b, c, d, a+b+c+d AS n, 100.0::DOUBLE*a/(a+b) AS target_pct, 100.0::DOUBLE*c/(c+d) AS control_pct, 100.0::DOUBLE*a/(a+b) - 100.0::DOUBLE*c/(c+d) AS diff_pp,
  CASE WHEN a=0 OR b=0 OR c=0 OR d=0 THEN (a+0.5::DOUBLE)*(d+0.5::DOUBLE)/((b+0.5::DOUBLE)*(c+0.5::DOUBLE)) ELSE a::DOUBLE*d/(b::DOUBLE*c) END AS odds_ratio FROM s WHERE least(a+b, c+d) >= 5"""


@query("per_stratum_table", f"{_STRATA} SELECT * REPLACE (round(target_pct, 6) AS target_pct, round(control_pct, 6) AS control_pct, round(diff_pp, 6) AS diff_pp, round(odds_ratio, 6) AS odds_ratio) FROM ({_PER})")
def per_stratum_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strata.per_stratum(_strata(spark, sf_dir), "book", 5).orderBy(F.desc("n"), "book"))


@query(
    "group_controlled",
    f"""{_STRATA}, r AS ({_PER}), g AS (SELECT count(*)::BIGINT AS strata, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d, round(avg(diff_pp), 6) AS mean_diff,
  round(sum(diff_pp * n) / sum(n), 6) AS weighted_diff, count(*) FILTER (diff_pp > 0)::BIGINT AS wins, count(*) FILTER (diff_pp < 0)::BIGINT AS losses FROM r),
x AS (SELECT *, unnest(range(0, least(wins, losses) + 1)) AS i FROM g)
SELECT strata, a, b, c, d, mean_diff, weighted_diff, wins, losses, round({_YATES}, 6) AS chi2_yates, round(a::DOUBLE*d/(b::DOUBLE*c), 6) AS odds_ratio,
  round(least(1.0::DOUBLE, 2 * sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0::DOUBLE)))), 6) AS sign_p
FROM x GROUP BY strata, a, b, c, d, mean_diff, weighted_diff, wins, losses""",
)
def group_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strata.pooled(_strata(spark, sf_dir), "book"))


# --- tables ------------------------------------------------------------------------------------

_ORDERS = f"s AS (SELECT o_orderpriority AS priority, {_2X2} FROM (SELECT o_orderpriority, o_orderstatus = 'F' AS t, o_totalprice > 150000 AS y FROM orders) GROUP BY 1)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("priority", F.col("o_orderpriority"))
    return judgments.two_by_two(rows, F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F", ("priority",))


@query(
    "chi2_yates_table",
    f"WITH {_ORDERS} SELECT *, round({_CHI}, 6) AS chi2, round({_YATES}, 6) AS chi2_yates, round((a+b)::DOUBLE*(a+c)/(a+b+c+d), 6) AS expected_a, round(sqrt({_CHI} / (a+b+c+d)), 6) AS cramers_v FROM s",
)
def chi2_yates_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    rows = _orders(spark, sf_dir).withColumn("chi2", stats.chi2(*"abcd")).withColumn("chi2_yates", stats.chi2_yates(*"abcd"))
    rows = rows.withColumn("expected_a", stats.expected(F.col("a") + F.col("b"), F.col("a") + F.col("c"), n))
    return rounded(rows.withColumn("cramers_v", stats.cramers_v("chi2", n)))


@query(
    "odds_relative_risk",
    f"WITH {_ORDERS} SELECT *, round(a::DOUBLE*d/(b::DOUBLE*c), 6) AS odds_ratio, round((a::DOUBLE/(a+b))/(c::DOUBLE/(c+d)), 6) AS relative_risk FROM s",
)
def odds_relative_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("odds_ratio", stats.plain_odds_ratio(*"abcd"))
    return rounded(rows.withColumn("relative_risk", stats.relative_risk(*"abcd")))


# --- ranks -------------------------------------------------------------------------------------


@query(
    "auc_rank",
    """WITH e AS (SELECT value, event_type = 'purchase' AS y FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
r AS (SELECT y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM e),
s AS (SELECT count(*) FILTER (y)::BIGINT AS n_pos, count(*) FILTER (NOT y)::BIGINT AS n_neg, sum(r) FILTER (y) AS s FROM r)
SELECT n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg), 6) AS auc FROM s""",
)
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.auc(table(spark, sf_dir, "events"), "value", F.col("event_type") == "purchase"))


@query(
    "spearman_rank",
    f"""WITH {A.SQL_WIDE}, r AS (SELECT rank() OVER (ORDER BY discount) + (count(*) OVER (PARTITION BY discount) - 1) / 2.0::DOUBLE AS x,
  rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0::DOUBLE AS y FROM j)
SELECT count(*)::BIGINT AS n, round(corr(x, y), 6) AS r FROM r""",
)
def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.spearman(A.wide(spark, sf_dir), "discount", "quantity"))


@query(
    "sign_test_many_strata",
    f"""WITH {A.SQL_WIDE}, s AS (SELECT part, {_2X2} FROM (SELECT l_partkey AS part, l_linestatus = 'O' AS t, l_quantity > 25 AS y FROM lineitem) GROUP BY part),
g AS (SELECT a * (c + d) - c * (a + b) AS gap FROM s WHERE a + b >= 1 AND c + d >= 1),
t AS (SELECT count(*) FILTER (gap > 0)::BIGINT AS w, count(*) FILTER (gap < 0)::BIGINT AS l, count(*) FILTER (gap = 0)::BIGINT AS ties FROM g),
x AS (SELECT w, l, ties, unnest(range(0, least(w, l) + 1)) AS i FROM t)
SELECT w AS wins, l AS losses, ties, round(least(1.0::DOUBLE, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2.0::DOUBLE)))), 6) AS p FROM x GROUP BY w, l, ties""",
)
def sign_test_many_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    cells = judgments.two_by_two(rows, F.col("l_quantity") > 25, F.col("l_linestatus") == "O", ("l_partkey",))
    return rounded(strata.sign_test(cells))


@query("pearson", f"WITH {A.SQL_WIDE} SELECT count(*)::BIGINT AS n, round(corr(discount, quantity), 6) AS r FROM j")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.pearson(A.wide(spark, sf_dir), "discount", "quantity"))


@query("bootstrap_v")
def bootstrap_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cramers_v_interval(judgments.consensus(A.items(spark, sf_dir), 3, "O", "F"))


def tail_sql(chi: str) -> str:
    """p-value of chi-squared with one degree in SQL: one less the series of the error function."""
    y = f"(({chi}) / 2.0::DOUBLE)"
    term = f"exp(2 * n * ln(2.0::DOUBLE) + lgamma(n + 1) - lgamma(2 * n + 2) + (n + 0.5::DOUBLE) * ln({y}) - {y})"
    return f"CASE WHEN ({chi}) <= 0 THEN 1.0::DOUBLE WHEN ({chi}) > 300 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 600), lambda n: {term}))) END"


@query(
    "special_pvalues",
    f"""WITH {_ORDERS}, x AS (SELECT *, {_CHI} AS chi2 FROM s), y AS (SELECT *, {tail_sql('chi2')} AS p FROM x)
SELECT * REPLACE (round(chi2, 6) AS chi2, round(p, 6) AS p), CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars,
  CASE WHEN chi2 > 1374 THEN '< 1e-300' WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.4f', p) END AS label FROM y""",
)
def special_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("chi2", stats.chi2(*"abcd"))
    rows = rows.withColumn("p", stats.chi2_sf("chi2", F.lit(1)))
    return rounded(rows.withColumn("stars", stats.stars("p")).withColumn("label", stats.p_label("p")))


# --- markers -----------------------------------------------------------------------------------

#: Small demonstration rules over Latin endings; real rule tables are parameters of the operators.
RULES = {"ing": "in", "tion": "cion", "ent": "en", "er": "r", "the": "th", "th": "d", "and": "und", "en": "n"}
CLASSES = {"the": "article", "and": "joint", "of": "link", "der": "article", "la": "article", "en": "link"}
TAXONOMY = [("gerund", [".*ing$"]), ("noun", [".*tion$", ".*keit$", ".*heit$"]), ("short", ["^.{1,3}$"]), ("manner", [".*ly$"])]


@query(
    "marker_extract",
    r"SELECT doc_id, coalesce(regexp_extract(regexp_replace(regexp_replace(trim(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\([^)]*\)', ' ', 'g'), '[^a-z]+$', ''), '([a-z]+)$', 1), '') AS marker FROM documents",
)
def marker_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.trailing_run("text", "[a-z]", "[^a-z]", "").alias("marker"))


@query("marker_extract_all", "SELECT doc_id, coalesce(array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), ','), '') AS markers FROM documents")
def marker_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.all_runs("text", "[A-Z][a-z]+").alias("markers"))


def _rewrite_sql() -> str:
    done = "marker"
    for k, v in sorted(RULES.items(), key=lambda kv: -len(kv[0])):
        done = f"replace({done}, '{k}', '{v}')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RULES.items())
    return f"CASE marker {cases} ELSE {done} END"


@query("marker_normalise", f"WITH {A.SQL_MARKERS} SELECT {_rewrite_sql()} AS normal, count(*)::BIGINT AS n, count(DISTINCT marker)::BIGINT AS forms FROM m GROUP BY 1")
def marker_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.markers(spark, sf_dir).groupBy("marker").agg(F.count("*").alias("n"))
    rows = counts.withColumn("normal", text.rewrite("marker", RULES))
    return rows.groupBy("normal").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query("unique_reduction", f"WITH {A.SQL_MARKERS}, g AS (SELECT count(DISTINCT marker)::BIGINT AS forms, count(DISTINCT {_rewrite_sql()})::BIGINT AS normal FROM m) SELECT *, round(100.0::DOUBLE - 100.0::DOUBLE * normal / forms, 6) AS reduction_pct FROM g")
def unique_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = A.markers(spark, sf_dir).select("marker").distinct().withColumn("normal", text.rewrite("marker", RULES))
    rows = forms.agg(F.count("*").alias("forms"), F.count_distinct("normal").alias("normal"))
    return rounded(rows.withColumn("reduction_pct", 100 - stats.percent("normal", "forms")))


@query(
    "classify_exact",
    f"WITH {A.SQL_MARKERS} SELECT CASE marker {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in CLASSES.items())} ELSE '' END AS class, count(*)::BIGINT AS n FROM m GROUP BY 1",
)
def classify_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.markers(spark, sf_dir).withColumn("class", text.exact_class("marker", CLASSES))
    return rows.groupBy("class").agg(F.count("*").alias("n"))


_TAXONOMY_SQL = "CASE WHEN contains(marker, 'tha') THEN 'compound' WHEN regexp_matches(marker, '^(?:.*ing$)') THEN 'gerund' WHEN regexp_matches(marker, '^(?:.*tion$|.*keit$|.*heit$)') THEN 'noun' WHEN regexp_matches(marker, '^.{1,3}$') THEN 'short' WHEN regexp_matches(marker, '^(?:.*ly$)') THEN 'manner' ELSE 'other' END"


@query("classify_regex", f"WITH {A.SQL_MARKERS} SELECT {_TAXONOMY_SQL} AS class, count(*)::BIGINT AS freq, count(DISTINCT marker)::BIGINT AS markers FROM m GROUP BY 1")
def classify_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.markers(spark, sf_dir).groupBy("marker").agg(F.count("*").alias("n"))
    kind = text.regex_class("marker", TAXONOMY, (text.compound("marker", ["tha"], [], []), "compound"), "other", "missing")
    return counts.withColumn("class", kind).groupBy("class").agg(F.sum("n").alias("freq"), F.count("*").alias("markers"))


@query(
    "classify_tags",
    f"""WITH {A.SQL_MARKERS}, t AS (SELECT doc_id, marker, array_to_string(list_filter([CASE WHEN contains(marker, 'ing') THEN 'gerund' END, CASE WHEN contains(marker, 'tion') OR contains(marker, 'keit') OR contains(marker, 'heit') THEN 'noun' END, CASE WHEN contains(marker, 'ly') THEN 'manner' END], lambda x: x IS NOT NULL), ',') AS tags FROM m)
SELECT tags, count(*)::BIGINT AS n FROM t GROUP BY tags""",
)
def classify_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = [(n, ps) for n, ps in TAXONOMY if n != "short"]
    rows = A.markers(spark, sf_dir).withColumn("tags", F.array_join(text.base_tags("marker", loose), ","))
    return rows.groupBy("tags").agg(F.count("*").alias("n"))


@query(
    "affix_tags",
    f"""WITH {A.SQL_MARKERS}, t AS (SELECT array_to_string(list_filter([CASE WHEN contains(marker, 'th') THEN 'th' END, CASE WHEN starts_with(marker, 'en') THEN 'en' END], lambda x: x IS NOT NULL), ',') AS tags,
  CASE WHEN ends_with(marker, 'ing') THEN 'ing' WHEN ends_with(marker, 'er') THEN 'er' WHEN ends_with(marker, 'e') THEN 'open' ELSE 'closed' END AS ending FROM m)
SELECT CASE WHEN tags = '' THEN '' ELSE tags || ',' || ending END AS tags, count(*)::BIGINT AS n FROM t GROUP BY 1""",
)
def affix_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("marker")
    tags = text.affix_tags("marker", ["er", "ing"], [("th", m.contains("th")), ("en", m.startswith("en"))], [(m.endswith("e"), "open")], "closed")
    return A.markers(spark, sf_dir).groupBy(tags.alias("tags")).agg(F.count("*").alias("n"))


@query(
    "vocab_variant_pairs",
    f"""WITH {A.SQL_MARKERS}, v AS (SELECT marker, count(*)::BIGINT AS n FROM m WHERE marker <> '' GROUP BY marker),
f AS (SELECT 0 AS i, 'drop_e' AS rule, marker, n, regexp_replace(marker, '^e', '') AS form FROM v UNION ALL SELECT 1, 'er_to_en', marker, n, regexp_replace(marker, 'er$', 'en') FROM v
  UNION ALL SELECT 2, 'add_th', marker, n, 'th' || marker FROM v),
p AS (SELECT f.*, o.n AS form_n, row_number() OVER (PARTITION BY least(f.marker, form), greatest(f.marker, form) ORDER BY i, f.marker) AS k FROM f JOIN v o ON o.marker = form WHERE form <> f.marker)
SELECT rule, marker, form, n, form_n, n + form_n AS together FROM p WHERE k = 1 ORDER BY together DESC, marker, form""",
)
def vocab_variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = A.markers(spark, sf_dir).where("marker <> ''").groupBy("marker").agg(F.count("*").alias("n"))
    rules: list[tuple[str, Column]] = [
        ("drop_e", F.regexp_replace("marker", "^e", "")),
        ("er_to_en", F.regexp_replace("marker", "er$", "en")),
        ("add_th", F.concat(F.lit("th"), "marker")),
    ]
    return profile.variant_pairs(vocabulary, rules).orderBy(F.desc("together"), "marker", "form")


@query("hash_anonymise", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN text ELSE substr(sha256(text), 1, 16) END AS hidden FROM documents")
def hash_anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.anonymise("text").alias("hidden"))


_SAID = "CASE (conv_id + turn) % 7 WHEN 0 THEN ' True ' WHEN 1 THEN 'YES' WHEN 2 THEN chr(9) || 'o' WHEN 3 THEN '1' WHEN 4 THEN 'false' WHEN 5 THEN text ELSE NULL END"


@query("parse_bool", f"SELECT conv_id, turn, role, coalesce(lower(trim({_SAID}, ' ' || chr(9) || chr(10) || chr(13))) IN ('true', '1', 'yes', 'y', 'o'), false) AS flag FROM conversations")
def parse_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("conv_id") + F.col("turn")) % 7
    said = F.when(kind == 0, " True ").when(kind == 1, "YES").when(kind == 2, "\to").when(kind == 3, "1").when(kind == 4, "false").when(kind == 5, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.parse_bool(said).alias("flag"))


_ANSWER = "array_to_string(list_transform([1,2,3,4,5,6,7,8,9,10,11,12], lambda i: i::VARCHAR || CASE WHEN (doc_id * i) % 3 = 0 THEN '. O' WHEN (doc_id + i) % 5 = 0 THEN '.O' ELSE '. X' END), chr(10))"


@query(
    "parse_ox",
    f"WITH x AS (SELECT doc_id, {_ANSWER} AS a FROM documents) SELECT doc_id, array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN contains(a, i::VARCHAR || '. O') OR contains(a, i::VARCHAR || '.O') THEN '1' ELSE '0' END), '') AS votes FROM x",
)
def parse_ox(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lambda k: F.when((F.col("doc_id") * k) % 3 == 0, ". O").when((F.col("doc_id") + k) % 5 == 0, ".O").otherwise(". X")
    answer = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.concat(k.cast("string"), i(k))), "\n")
    votes = F.transform(text.parse_votes(answer, 12), lambda v: v.cast("int").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(votes, "").alias("votes"))


@query(
    "prompt_batches",
    """SELECT conv_id, 'Mark each line O or X.' || chr(10) || string_agg(k::VARCHAR || '. ' || text, chr(10) ORDER BY k) AS prompt FROM (
  SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id""",
)
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", text.prompt("Mark each line O or X.", F.transform("turns", lambda t: t["text"])).alias("prompt"))


# --- profiles ----------------------------------------------------------------------------------

TERMS = ["the", "and", "idiot", "ly ", "der ", "que"]
LABELS = {"article": ["the ", "der ", "la "], "joint": [" and ", " und ", " y "], "noun": ["tion", "heit", "keit"]}
_TERMS_SQL = "(VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") AS t(term)"


@query(
    "term_by_cell",
    f"WITH {A.SQL_CELLS}, g AS (SELECT cell, term, count(*) FILTER (contains(text, term))::BIGINT AS rows, count(*)::BIGINT AS n FROM c, {_TERMS_SQL} GROUP BY cell, term) SELECT *, round(100.0::DOUBLE * rows / n, 6) AS pct FROM g",
)
def term_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.term_table(A.cells(spark, sf_dir), TERMS, ["cell"]))


@query(
    "term_prevalence",
    f"""WITH {A.SQL_CELLS}, g AS (SELECT term, count(*) FILTER (cell IN ('I','II') AND contains(text, term))::BIGINT AS rows_1, count(*) FILTER (cell IN ('III','IV') AND contains(text, term))::BIGINT AS rows_2,
  count(*) FILTER (cell IN ('I','II'))::BIGINT AS n_1, count(*) FILTER (cell IN ('III','IV'))::BIGINT AS n_2 FROM c, {_TERMS_SQL} GROUP BY term)
SELECT *, round(100.0::DOUBLE * rows_1 / n_1, 6) AS pct_1, round(100.0::DOUBLE * rows_2 / n_2, 6) AS pct_2, round(100.0::DOUBLE * rows_1 / n_1 - 100.0::DOUBLE * rows_2 / n_2, 6) AS diff_pp FROM g""",
)
def term_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("cell").isin("I", "II")
    return rounded(profile.term_contrast(A.cells(spark, sf_dir), TERMS, first, ~first))


@query(
    "term_cooccurrence",
    f"WITH {A.SQL_CELLS}, p(term_1, term_2) AS (VALUES ('the', 'and'), ('the', 'idiot'), ('der ', 'und ')) SELECT cell, term_1, term_2, count(*) FILTER (contains(text, term_1) AND contains(text, term_2))::BIGINT AS rows FROM c, p GROUP BY ALL",
)
def term_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pair_table(A.cells(spark, sf_dir), [("the", "and"), ("the", "idiot"), ("der ", "und ")], ["cell"])


@query(
    "particle_2x2",
    f"""WITH {A.SQL_CELLS}, s AS (SELECT {_2X2} FROM (SELECT contains(text, 'idiot') AS t, toxic = 1 AS y FROM c))
SELECT a, b, c, d, round(100.0::DOUBLE * a / (a + b), 6) AS target_given_particle, round(100.0::DOUBLE * a / (a + c), 6) AS particle_given_target, round({_YATES}, 6) AS chi2_yates, round(sqrt({_YATES} / (a+b+c+d)), 6) AS cramers_v FROM s""",
)
def particle_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.particle_table(A.cells(spark, sf_dir), F.col("text").contains("idiot"), F.col("toxic") == 1))


@query(
    "token_top_k",
    f"""WITH {A.SQL_CELLS}, t AS (SELECT cell, unnest(regexp_extract_all(text, '[a-z]{{2,}}')) AS token FROM c),
g AS (SELECT cell, token, count(*)::BIGINT AS n FROM t WHERE token NOT IN ('the', 'and', 'of') GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, token)::INT AS rank FROM g) WHERE rank <= 30""",
)
def token_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_tokens(A.cells(spark, sf_dir), "[a-z]{2,}", 30, ["cell"], ["the", "and", "of"])


@query("length_histogram", "SELECT lang, CASE WHEN length(text) < 100 THEN 0 WHEN length(text) < 500 THEN 1 WHEN length(text) < 1500 THEN 2 WHEN length(text) < 5000 THEN 3 ELSE 4 END AS bucket, count(*)::BIGINT AS rows FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.length_histogram(table(spark, sf_dir, "documents"), [100, 500, 1500, 5000], ["lang"])


@query("tail_ngrams", r"SELECT right(b, 5) AS ending, count(*)::BIGINT AS n FROM (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents) WHERE length(b) >= 5 GROUP BY 1 ORDER BY n DESC, ending LIMIT 50")
def tail_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.tail_ngrams(table(spark, sf_dir, "documents"), 5, 50)


@query(
    "multi_label_mood",
    f"""WITH {A.SQL_CELLS}, l(label, terms) AS (VALUES ('article', ['the ', 'der ', 'la ']), ('joint', [' and ', ' und ', ' y ']), ('noun', ['tion', 'heit', 'keit'])),
g AS (SELECT cell, label, count(*) FILTER (len(list_filter(terms, lambda t: contains(text, t))) > 0)::BIGINT AS rows, count(*)::BIGINT AS n FROM c, l GROUP BY cell, label) SELECT *, round(100.0::DOUBLE * rows / n, 6) AS pct FROM g""",
)
def multi_label_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.label_table(A.cells(spark, sf_dir), LABELS, ["cell"]))


@query("source_by_cell", f"WITH {A.SQL_CELLS} SELECT source, count(*) FILTER (cell = 'I')::BIGINT AS \"I\", count(*) FILTER (cell = 'II')::BIGINT AS \"II\", count(*) FILTER (cell = 'III')::BIGINT AS \"III\", count(*) FILTER (cell = 'IV')::BIGINT AS \"IV\" FROM c GROUP BY source")
def source_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.wide_counts(A.cells(spark, sf_dir), "source", "cell", ["I", "II", "III", "IV"])


@query(
    "exclusive_sources",
    f"""WITH {A.SQL_CELLS}, a AS (SELECT source, count(*) AS n FROM c WHERE toxic = 1 GROUP BY source ORDER BY n DESC, source LIMIT 8), b AS (SELECT source, count(*) AS n FROM c WHERE toxic = 0 GROUP BY source ORDER BY n DESC, source LIMIT 8)
SELECT source, 'first' AS "group" FROM a WHERE source NOT IN (SELECT source FROM b) UNION ALL SELECT source, 'second' FROM b WHERE source NOT IN (SELECT source FROM a)""",
)
def exclusive_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = F.col("toxic") == 1
    return profile.exclusive_values(A.cells(spark, sf_dir), "source", toxic, ~toxic, 8)


@query("value_counts_top", "SELECT event_type, count(*)::BIGINT AS n, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY n DESC, first_seen LIMIT 3")
def value_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type", "event_id", 3)


@query("share_of_total", "SELECT source, lang, count(*)::BIGINT AS n, (SELECT count(*)::BIGINT FROM documents) AS total, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY ALL")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.share_of_total(table(spark, sf_dir, "documents"), ["source", "lang"]))


@query(
    "pattern_counts",
    """WITH p AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS pattern, count(*) AS markers FROM conversations WHERE trim(role) <> '' GROUP BY conv_id)
SELECT pattern, count(*)::BIGINT AS n, max(markers)::INT AS markers FROM p GROUP BY pattern ORDER BY n DESC, pattern LIMIT 100""",
)
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["role"]), " , ").alias("roles"))
    return profile.marker_patterns(rows, "roles", 100)


@query(
    "crosstab_guarded",
    f"""WITH {A.SQL_CELLS}, s AS (SELECT source, {_2X2} FROM (SELECT source, quality = 1 AS t, length(text) > 1500 AS y FROM c) GROUP BY source)
SELECT *, round({_YATES}, 6) AS chi2_yates, CASE WHEN b * c = 0 THEN 'Infinity'::DOUBLE ELSE round(a::DOUBLE*d/(b::DOUBLE*c), 6) END AS odds_ratio FROM s WHERE a + b >= 3 AND c + d >= 3""",
)
def crosstab_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.guarded_table(A.cells(spark, sf_dir), "source", F.col("quality") == 1, F.length("text") > 1500, 3)
    return rounded(rows)


@query(
    "genre_bucket",
    "SELECT CASE WHEN contains(r_name, 'AM') THEN 'west' WHEN contains(r_name, 'AS') THEN 'east' ELSE 'rest' END AS genre, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
def genre_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", text.buckets("r_name", [("west", ["AM"]), ("east", ["AS"])], "rest").alias("genre"))
    rows = table(spark, sf_dir, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("genre").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


# --- samples -----------------------------------------------------------------------------------


@query(
    "stride_sample",
    """WITH n AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT lang, doc_id FROM n WHERE pos % greatest(1, n // 20) = 0 AND pos // greatest(1, n // 20) < 20""",
)
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stride(table(spark, sf_dir, "documents").select("lang", "doc_id"), 20, ["doc_id"], ["lang"])


@query("first_k_per_group", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS place FROM documents) WHERE place <= 3")
def first_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_k(table(spark, sf_dir, "documents").select("source", "doc_id"), 3, ["doc_id"], ["source"])


def _drawn_sql(key: str) -> str:
    return f"md5('42|' || {key}::VARCHAR)"


@query("hash_sample", f"SELECT doc_id, lang FROM documents ORDER BY {_drawn_sql('doc_id')}, doc_id LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hashed(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, ["doc_id"], 42)


@query(
    "spread_sample",
    f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_drawn_sql('doc_id')}, doc_id) AS k FROM documents) WHERE k <= 2 ORDER BY {_drawn_sql('doc_id')}, doc_id LIMIT 7",
)
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.spread(table(spark, sf_dir, "documents").select("doc_id", "source"), 7, 2, ["doc_id"], "source", 42)


# --- vectors -----------------------------------------------------------------------------------

_DIMENSIONS = 64


@query(
    "cosine_to_centroid",
    """WITH k AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i),
v AS (SELECT label, list(m ORDER BY i) AS centroid FROM k GROUP BY label),
s AS (SELECT e.label, vec_id, round(list_dot_product(embedding::DOUBLE[], centroid) / ((sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9::DOUBLE) * (sqrt(list_dot_product(centroid, centroid)) + 1e-9::DOUBLE)), 6) AS similarity FROM embeddings e JOIN v USING (label))
SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id)::INT AS place FROM s""",
)
def cosine_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.to_centroid(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id", _DIMENSIONS)


@query("kmeans_k_search")
def kmeans_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.search_k(table(spark, sf_dir, "embeddings"), "embedding")


@query(
    "silhouette_of_labels",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
p AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
q AS (SELECT vec_id, max(CASE WHEN other = label AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM p GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*)::BIGINT AS rows, (SELECT count(DISTINCT label)::BIGINT FROM e) AS clusters FROM q""",
)
def silhouette_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    score = clusters.silhouette(rows, "embedding", "label")
    return rounded(rows.agg(F.lit(score).alias("silhouette"), F.count("*").alias("rows"), F.count_distinct("label").alias("clusters")))


@query("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cluster(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 8)


@query(
    "doc_chunks",
    """SELECT source, part, count(*)::INT AS items, 'docs ' || source || '#' || part::VARCHAR || chr(10) || string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS document FROM (
  SELECT source, doc_id, text, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 50)::BIGINT AS part FROM documents) GROUP BY source, part""",
)
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.chunks(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text", 50, "docs ")


@query(
    "topk_retrieval",
    """WITH q AS (SELECT list_transform(range(0, 64), lambda i: sin(i + 1.0::DOUBLE)) AS q)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 60""",
)
def topk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = [math.sin(i + 1.0) for i in range(_DIMENSIONS)]
    return vectors.nearest_to(table(spark, sf_dir, "embeddings"), target, 60, "embedding", "vec_id")


# --- sources -----------------------------------------------------------------------------------


@query("json_probability_scan", """SELECT event_type, count(*)::BIGINT AS n, count(try_cast(props->>'k' AS DOUBLE))::BIGINT AS known, round(sum(try_cast(props->>'k' AS DOUBLE)), 4) AS total FROM events GROUP BY event_type""")
def json_probability_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", text.probability("props", "k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("known"), F.round(F.coalesce(F.sum("k")), 4).alias("total"))


_MARKUP = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>"


@query(
    "html_text_extract",
    f"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(regexp_replace(html, '{_MARKUP}', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM pages",
)
def html_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    body = F.trim(F.regexp_replace(F.regexp_replace("html", _MARKUP, " "), r"[ \t\n\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), body.alias("body"))


@query("file_manifest")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.manifest(spark, sf_dir, "*.parquet")


# --- composite reports -------------------------------------------------------------------------

PANELS = {"first_two": ["r1", "r2"], "last_two": ["r2", "r3"], "all": ["r1", "r2", "r3"]}
_PANEL_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS panel, {len(m)} AS raters, arm, {' + '.join(r + '::INT' for r in m)} AS s FROM j WHERE arm IN ('O', 'F')" for name, m in PANELS.items()
)
_PANEL_CELLS = ", ".join(
    f"count(*) FILTER (arm = '{a}' AND s {k})::BIGINT AS {n}_{x}"
    for n, a in (("target", "O"), ("control", "F"))
    for x, k in (("o", "= raters"), ("s", "> 0 AND s < raters"), ("x", "= 0"))
)


@query(
    "rater_panels",
    f"""WITH {A.SQL_WIDE}, v AS ({_PANEL_ROWS}),
g AS (SELECT panel, raters, {_PANEL_CELLS}, count(*)::BIGINT AS n, count(*) FILTER (arm = 'O') AS tn, count(*) FILTER (arm = 'F') AS cn,
  avg((s * s + (raters - s) * (raters - s) - raters)::DOUBLE / (raters * (raters - 1))) AS seen, power(avg(s::DOUBLE / raters), 2) + power(1 - avg(s::DOUBLE / raters), 2) AS chance FROM v GROUP BY panel, raters),
h AS (SELECT *, {_CHI6} AS chi2 FROM g)
SELECT * EXCLUDE (tn, cn, seen, chance) REPLACE (round(chi2, 6) AS chi2), round(sqrt(chi2 / n), 6) AS cramers_v, round((seen - chance) / (1 - chance), 6) AS fleiss_kappa FROM h""",
)
def rater_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judgments.panels(A.wide(spark, sf_dir), PANELS, "O", "F"))


@query(
    "group_rates",
    """WITH d(genre, ord) AS (VALUES ('en', 1), ('fr', 2), ('xx', 3)), g AS (SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (contains(text, 'the '))::BIGINT AS hits FROM documents GROUP BY lang)
SELECT genre, ord, coalesce(n, 0)::BIGINT AS n, coalesce(hits, 0)::BIGINT AS hits, round(coalesce(100.0::DOUBLE * hits / n, 0), 6) AS pct FROM d LEFT JOIN g ON lang = genre""",
)
def group_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rounded(profile.ordered_rates(docs, "lang", ["en", "fr", "xx"], F.col("text").contains("the ")).withColumnRenamed("lang", "genre"))


# --- joins -------------------------------------------------------------------------------------


@query(
    "attach_first",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)
SELECT doc_id, role, length(f.text)::INT AS size FROM documents d LEFT JOIN f ON f.conv_id = d.doc_id AND k = 1""",
)
def attach_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.col("text").alias("said"))
    rows = joins.attach(table(spark, sf_dir, "documents").select("doc_id"), turns, ["doc_id"], ["turn", "role", "said"])
    return rows.select("doc_id", "role", F.length("said").alias("size"))


@query("lookup_default", "SELECT doc_id, coalesce(quality, -1)::INT AS quality, coalesce(toxic, 0)::INT AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return joins.lookup(docs, table(spark, sf_dir, "labels"), ["doc_id"], {"quality": -1, "toxic": 0})


@query("strict_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.strict(table(spark, sf_dir, "customer"), nation, ["c_nationkey"]).select("c_custkey", "n_name")


@query(
    "four_cells",
    f"WITH {A.SQL_WIDE} SELECT CASE WHEN arm = 'O' THEN CASE WHEN vs = 3 THEN 'I' ELSE 'II' END ELSE CASE WHEN vs = 3 THEN 'III' ELSE 'IV' END END AS cell, count(*)::BIGINT AS n, min(flag || ' ||| ' || arm) AS sample FROM j WHERE vs IN (0, 3) GROUP BY 1",
)
def four_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.items(spark, sf_dir).where("vote_sum in (0, 3)").withColumn("cell", joins.cell("arm", F.col("vote_sum") == 3, "O"))
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.min(joins.parallel("flag", "arm")).alias("sample"))
