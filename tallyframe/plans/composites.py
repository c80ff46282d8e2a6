"""Registered composite reports, with SQL put together from that of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.operators import composites, coverage, cube, judgments, probability, profile, sampling
from tallyframe.plans import adapters as A
from tallyframe.plans.reports import _2X2, _CHI, _PER, _STRATA, _YATES, BOTH, PANELS, REGISTRY, _effect_sql, _kappa_sql, _mh_sql, rounded, tail_sql

query = REGISTRY.add
_EFFECT = "a b c d target_pct control_pct diff_pp diff_low diff_high odds_ratio or_low or_high or_corrected chi2".split()
_CONSENSUS = "target_o target_s target_x control_o control_s control_x n chi2 cramers_v".split()


def tidy_sql(part: str, sql: str, measures: list[str], item: str = "''", keep: str = "") -> str:
    """A query's numbers as rows of part, item, measure and value."""
    names, values = ", ".join(f"'{m}'" for m in measures), ", ".join(f'"{m}"::DOUBLE' for m in measures)
    return f"SELECT {keep}part, item, measure, round(value, 6) AS value FROM (SELECT {keep}'{part}' AS part, ({item})::VARCHAR AS item, unnest([{names}]) AS measure, unnest([{values}]) AS value FROM ({sql})) WHERE value IS NOT NULL"


_BY = ("book", "shelf")


def _cube(spark: SparkSession, sf_dir: str, panels: dict[str, list[str]], absent: bool = False) -> DataFrame:
    """The judged items as a cube, once per panel; with `absent`, r3 did not judge items of flag N."""
    wide = A.wide(spark, sf_dir).withColumn("shelf", F.col("book") % 4)
    if absent:
        wide = wide.withColumn("r3", F.when(F.col("flag") != "N", F.col("r3")))
    return cube.panels(cube.cube(wide, A.RATERS, _BY), A.RATERS, panels, _BY, base=["r1", "r2"])


def _report(spark: SparkSession, sf_dir: str, parts: list[str]) -> DataFrame:
    rows = cube.report(_cube(spark, sf_dir, {"all": A.RATERS}), "O", "F", *_BY, parts=parts)
    return rounded(rows.drop("panel"))


_O = REGISTRY.oracles
_RATER = "target_n target_positive control_n control_positive target_pct control_pct diff_pp chi2".split()


@query(
    "report_final_stats",
    " UNION ALL ".join([
        tidy_sql("consensus", _O["consensus_osx"], _CONSENSUS),
        tidy_sql("rater", _O["per_rater_rates"], _RATER, "rater"),
        tidy_sql("truth", _O["truth_table_2x2"], "a b c d target_pct control_pct diff_pp".split()),
    ]),
)
def report_final_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, ["consensus", "rater", "truth"])


_SHELVES = _STRATA.replace("SELECT book,", "SELECT shelf,").replace("(SELECT shelf, arm", "(SELECT book % 4 AS shelf, arm").replace("GROUP BY book", "GROUP BY shelf")
_BOOK = "a b c d n target_pct control_pct diff_pp odds_ratio".split()
_STRATIFIED = [
    tidy_sql("books", f"{_STRATA} SELECT count(*) AS books, count(*) FILTER (a+b >= 1 AND c+d >= 1) AS both_arms, count(*) FILTER (a+b >= 5 AND c+d >= 5) AS enough FROM s", ["books", "both_arms", "enough"]),
    tidy_sql("crude", f"{_STRATA}, f AS (SELECT sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM s) " + _effect_sql("f"), _EFFECT),
    tidy_sql("common_book", _O["mh_stratified"], ["strata", "odds_ratio", "or_low", "or_high"]),
    tidy_sql("homogeneity_book", _O["woolf_homogeneity"].replace("WHERE a+b > 0 AND c+d > 0", "WHERE a+b >= 5 AND c+d >= 5"), ["strata", "chi2", "df"]),
    tidy_sql("sign_book", _O["sign_test_strata"].replace("WHERE a + b >= 1 AND c + d >= 1", "WHERE a + b >= 5 AND c + d >= 5"), ["wins", "losses", "ties", "p"]),
    tidy_sql("book", f"{_STRATA} {_PER}", _BOOK, "book"),
    tidy_sql("group", f"{_SHELVES} {_PER}".replace("SELECT book,", "SELECT shelf,").replace("least(a+b, c+d) >= 5", "least(a+b, c+d) >= 0"), _BOOK, "shelf"),
    tidy_sql("common_group", f"{_SHELVES} {_mh_sql('s')}", ["strata", "odds_ratio", "or_low", "or_high"]),
    tidy_sql("common_rater", _O["mh_per_rater"], ["strata", "odds_ratio", "or_low", "or_high"], "rater"),
]


_STRATA_PARTS = cube.PARTS[cube.PARTS.index("books") :]


@query("report_stratified", " UNION ALL ".join(_STRATIFIED))
def report_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, _STRATA_PARTS)


def _osx_effect(b: str, d: str) -> str:
    return f"WITH {A.SQL_WIDE}, f AS (SELECT count(*) FILTER (arm = 'O' AND vs = 3)::BIGINT AS a, count(*) FILTER (arm = 'O' AND {b})::BIGINT AS b, count(*) FILTER (arm = 'F' AND vs = 3)::BIGINT AS c, count(*) FILTER (arm = 'F' AND {d})::BIGINT AS d FROM j) " + _effect_sql("f")


@query(
    "report_robustness",
    " UNION ALL ".join([
        tidy_sql("pair", _O["agreement_pairwise"], ["both", "first_only", "second_only", "neither", "agreement_pct", "kappa"], "rater_1 || '-' || rater_2"),
        tidy_sql("agreement", _O["agreement_fleiss"], "n positive unanimous unanimous_pct kappa".split()),
        tidy_sql("o_against_rest", _osx_effect("vs < 3", "vs < 3"), _EFFECT),
        tidy_sql("o_against_x", _osx_effect("vs = 0", "vs = 0"), _EFFECT),
        tidy_sql("definition", _O["sensitivity_thresholds"], _EFFECT, "definition"),
        *_STRATIFIED,
    ]),
)
def report_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, ["pair", "agreement", "o_against_rest", "o_against_x", "definition", *_STRATA_PARTS])


#: Panels over the votes of each item, where r3 did not judge items of flag N: members' votes, their sum s and number k.
_VOTES = f"""{A.SQL_WIDE}, w AS (SELECT arm, book, book % 4 AS shelf, r1::INT AS r1, r2::INT AS r2, CASE WHEN flag <> 'N' THEN r3::INT END AS r3 FROM j),
x AS ({" UNION ALL ".join(f"SELECT '{p}' AS panel, {len(m)} AS k, {m} AS members, [{', '.join(m)}] AS votes, arm, book, shelf FROM w" for p, m in PANELS.items())}),
v AS (SELECT *, list_sum(votes)::BIGINT AS s FROM x WHERE len(list_filter(votes, lambda y: y IS NOT NULL)) = k),
each AS (SELECT panel, arm = 'O' AS t, book, unnest(members) AS rater, unnest(votes) = 1 AS y FROM v)"""
_PANEL_CONSENSUS = f"""g AS (SELECT panel, {", ".join(f"count(*) FILTER (arm = '{a}' AND s {c})::BIGINT AS {t}_{x}" for t, a in (("target", "O"), ("control", "F")) for x, c in (("o", "= k"), ("s", "> 0 AND s < k"), ("x", "= 0")))},
  count(*)::BIGINT AS n, count(*) FILTER (arm = 'O') AS tn, count(*) FILTER (arm = 'F') AS cn FROM v GROUP BY panel)"""
_PANEL_CHI = " + ".join(f"CASE WHEN {m} * (target_{k} + control_{k}) = 0 THEN 0 ELSE power({t}_{k} - {m}::DOUBLE * (target_{k} + control_{k}) / n, 2) / ({m}::DOUBLE * (target_{k} + control_{k}) / n) END" for t, m in (("target", "tn"), ("control", "cn")) for k in "osx")
_SQUARES = "avg((s*s + (k-s)*(k-s) - k)::DOUBLE / (k*(k-1)))"
_CHANCE = "power(sum(s)::DOUBLE / sum(k), 2) + power(1 - sum(s)::DOUBLE / sum(k), 2)"


def _fleiss_sql(by: str) -> str:
    return f"SELECT {by}, n, positive, unanimous, 100.0::DOUBLE*unanimous/n AS unanimous_pct, (o-ch)/(1-ch) AS kappa FROM (SELECT {by}, count(*)::BIGINT AS n, sum(s)::BIGINT AS positive, count(*) FILTER (s IN (0, k))::BIGINT AS unanimous, {_SQUARES} AS o, {_CHANCE} AS ch FROM v GROUP BY {by})"


def _panel_sql() -> str:
    """Every part of the panels' report, grouped by panel."""
    books = f"s AS (SELECT panel, book, {_2X2} FROM (SELECT panel, book, arm = 'O' AS t, s = k AS y FROM v) GROUP BY ALL)"
    groups = books.replace("book", "shelf")
    per = _PER.replace("SELECT book,", "SELECT panel, book,")
    share = f"SELECT *, a + b AS target_n, a AS target_positive, c + d AS control_n, c AS control_positive, 100.0::DOUBLE*a/(a+b) AS target_pct, 100.0::DOUBLE*c/(c+d) AS control_pct, 100.0::DOUBLE*a/(a+b) - 100.0::DOUBLE*c/(c+d) AS diff_pp, {_CHI} AS chi2"
    truth = f"t AS (SELECT panel, {_2X2} FROM (SELECT panel, arm = 'O' AS t, s = k AS y FROM v) GROUP BY panel) SELECT *, round(target_pct - control_pct, 1) AS diff_pp FROM (SELECT *, round(100.0::DOUBLE*a/(a+b), 1) AS target_pct, round(100.0::DOUBLE*c/(c+d), 1) AS control_pct FROM t)"
    pairs = f"""q AS (SELECT panel, members[i] || '-' || members[j] AS pair, count(*) FILTER (votes[i] = 1 AND votes[j] = 1)::BIGINT AS "both", count(*) FILTER (votes[i] = 1 AND votes[j] = 0)::BIGINT AS first_only,
  count(*) FILTER (votes[i] = 0 AND votes[j] = 1)::BIGINT AS second_only, count(*) FILTER (votes[i] = 0 AND votes[j] = 0)::BIGINT AS neither FROM v, (VALUES (1, 2), (1, 3), (2, 3)) o(i, j) WHERE j <= k GROUP BY ALL)
SELECT *, 100.0::DOUBLE * ("both" + neither) / ("both" + first_only + second_only + neither) AS agreement_pct, {_kappa_sql(BOTH, "first_only", "second_only", "neither")} AS kappa FROM q"""
    effect = lambda b, d: f"{_PANEL_CONSENSUS}, f AS (SELECT panel, target_o AS a, {b} AS b, control_o AS c, {d} AS d FROM g) " + _effect_sql("f", "panel, ")
    cuts = f"c(definition) AS (VALUES ('unanimous'), ('majority'), ('any')), f AS (SELECT panel, definition, {_2X2} FROM (SELECT panel, definition, arm = 'O' AS t, s >= CASE definition WHEN 'unanimous' THEN k WHEN 'majority' THEN k // 2 + 1 ELSE 1 END AS y FROM v, c) GROUP BY ALL) "
    woolf = "l AS (SELECT panel, ln((a+0.5::DOUBLE)*(d+0.5::DOUBLE)/((b+0.5::DOUBLE)*(c+0.5::DOUBLE))) AS l, 1/(1/(a+0.5::DOUBLE)+1/(b+0.5::DOUBLE)+1/(c+0.5::DOUBLE)+1/(d+0.5::DOUBLE)) AS w FROM s WHERE a+b >= 5 AND c+d >= 5)"
    sign = """g AS (SELECT panel, a * (c + d) - c * (a + b) AS gap FROM s WHERE a + b >= 5 AND c + d >= 5),
t AS (SELECT panel, count(*) FILTER (gap > 0)::BIGINT AS wins, count(*) FILTER (gap < 0)::BIGINT AS losses, count(*) FILTER (gap = 0)::BIGINT AS ties FROM g GROUP BY panel), u AS (SELECT *, unnest(range(0, least(wins, losses) + 1)) AS i FROM t)
SELECT panel, wins, losses, ties, least(1.0::DOUBLE, 2 * sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0::DOUBLE)))) AS p FROM u GROUP BY ALL"""
    kappas = ["both", "first_only", "second_only", "neither", "agreement_pct", "kappa"]
    common = ["strata", "odds_ratio", "or_low", "or_high"]
    parts = [
        ("coverage", "", "SELECT panel, count(*) FILTER (known) AS common, count(*) AS base, count(*) FILTER (known) = count(*) AS complete FROM (SELECT panel, len(list_filter(votes, lambda y: y IS NOT NULL)) = k AS known FROM x) GROUP BY panel", ["common", "base", "complete"], "''"),
        ("consensus", _PANEL_CONSENSUS, f"SELECT *, sqrt(chi2 / n) AS cramers_v FROM (SELECT *, {_PANEL_CHI} AS chi2 FROM g)", _CONSENSUS, "''"),
        ("rater", f"r AS (SELECT panel, rater, {_2X2} FROM each GROUP BY ALL)", f"{share} FROM r", _RATER, "rater"),
        ("truth", "", truth, "a b c d target_pct control_pct diff_pp".split(), "''"),
        ("pair", "", pairs, kappas, "pair"),
        ("agreement", "", _fleiss_sql("panel"), "n positive unanimous unanimous_pct kappa".split(), "''"),
        ("agreement_arm", "", _fleiss_sql("panel, arm"), "n positive unanimous unanimous_pct kappa".split(), "arm"),
        ("o_against_rest", "", effect("target_s + target_x", "control_s + control_x"), _EFFECT, "''"),
        ("o_against_x", "", effect("target_x", "control_x"), _EFFECT, "''"),
        ("definition", "", cuts + _effect_sql("f", "panel, definition, "), _EFFECT, "definition"),
        ("books", books, "SELECT panel, count(*) AS books, count(*) FILTER (a+b >= 1 AND c+d >= 1) AS both_arms, count(*) FILTER (a+b >= 5 AND c+d >= 5) AS enough FROM s GROUP BY panel", ["books", "both_arms", "enough"], "''"),
        ("crude", f"{books}, f AS (SELECT panel, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d FROM s GROUP BY panel)", _effect_sql("f", "panel, "), _EFFECT, "''"),
        ("common_book", books, _mh_sql("s", "panel, "), common, "''"),
        ("homogeneity_book", f"{books}, {woolf}", "SELECT panel, count(*)::BIGINT AS strata, sum(w*l*l) - power(sum(w*l), 2) / sum(w) AS chi2, count(*)::BIGINT - 1 AS df FROM l GROUP BY panel", ["strata", "chi2", "df"], "''"),
        ("sign_book", books, sign, ["wins", "losses", "ties", "p"], "''"),
        ("book", books, per, _BOOK, "book"),
        ("group", groups, per.replace("book,", "shelf,").replace(">= 5", ">= 0"), _BOOK, "shelf"),
        ("common_group", groups, _mh_sql("s", "panel, "), common, "''"),
        ("common_rater", f"s AS (SELECT panel, rater, book, {_2X2} FROM each GROUP BY ALL)", _mh_sql("s", "panel, rater, "), common, "rater"),
    ]
    joined = lambda with_, sql: f"WITH {_VOTES}" + (f", {with_}" if with_ else "") + (" " if sql.startswith("SELECT") else ", ") + sql
    return " UNION ALL ".join(tidy_sql(part, joined(with_, sql), measures, item, "panel, ") for part, with_, sql, measures, item in parts)


_PANELS_SQL = _panel_sql()


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.report(_cube(spark, sf_dir, PANELS, absent=True), "O", "F", *_BY)


@query("report_panels", _PANELS_SQL)
def report_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_panels(spark, sf_dir))


@query("report_panels_complete", f"SELECT * FROM ({_PANELS_SQL}) WHERE panel = 'first_two' AND part IN ('coverage', 'rater', 'o_against_rest')")
def report_panels_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cube(spark, sf_dir, PANELS, absent=True)
    return rounded(cube.report(rows, "O", "F", *_BY, parts=["coverage", "rater", "o_against_rest"], allow_partial=False))


def _summary_sql() -> str:
    at = lambda p, m, i="": f"max(value) FILTER (part = '{p}' AND measure = '{m}' AND item = '{i}')"
    share = lambda arm, k: f"round(100.0::DOUBLE * {at('consensus', f'{arm}_{k}')} / ({' + '.join(at('consensus', f'{arm}_{x}') for x in 'osx')}), 6) AS {arm}_{k}_pct"
    columns = [f"{at('consensus', 'n')} AS n", *(share(arm, k) for arm in ("target", "control") for k in "osx")]
    columns += [f"{at('consensus', c)} AS {c}" for c in ("chi2", "cramers_v")] + [f"{at('coverage', c)} AS {c}" for c in ("common", "base", "complete")]
    columns += [f"{at('agreement', c)} AS fleiss_{c}" for c in ("kappa", "unanimous_pct")] + [f"{at('o_against_rest', c)} AS {c}" for c in ("diff_pp", "diff_low", "diff_high", "odds_ratio", "or_low", "or_high")]
    columns += [f"{at('common_book', c)} AS book_{c}" for c in ("odds_ratio", "or_low", "or_high")] + [f"{at('definition', 'diff_pp', c)} AS diff_{c}" for c in ("unanimous", "majority", "any")]
    return f"SELECT panel, {', '.join(columns)} FROM ({_PANELS_SQL}) GROUP BY panel"


@query("report_panel_summary", _summary_sql())
def report_panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cube.summary(_panels(spark, sf_dir)))


_PROBABILITY = f"WITH {A.SQL_WIDE}, x AS (SELECT arm, arm = 'O' AS t, r1, r2, r3, vs, p, CASE WHEN flag <> 'R' THEN 1 - tax * 12 END AS q, CASE WHEN flag <> 'N' THEN quantity / 50 END AS o FROM j)"
_FLAGS = {"unanimous": "vs = 3", "majority": "vs >= 2", "r1": "r1", "r2": "r2", "r3": "r3"}


def _probability_sql() -> str:
    """Every part of the probability rater's report, counted over the items themselves."""
    rows = []

    def effect(part: str, item: str, flag: str, more: str = "", measures: list[str] | None = None) -> None:
        sql = f"{_PROBABILITY}, s AS (SELECT {_2X2} FROM (SELECT t, {flag} AS y FROM x)), e AS (SELECT *, {_CHI} AS chi2 FROM s) SELECT 100.0::DOUBLE*a/(a+b) AS target_pct, 100.0::DOUBLE*c/(c+d) AS control_pct, chi2, sqrt(chi2/(a+b+c+d)) AS phi, {tail_sql('chi2')} AS p{more} FROM e"
        rows.append(tidy_sql(part, sql, ["target_pct", "control_pct", "chi2", "phi", "p", *(measures or [])], f"'{item}'"))

    def kappa(u: str, v: str, where: str = "true") -> str:
        cells = [f"(SELECT count(*) FILTER ({c}) FROM x WHERE {where})" for c in (f"({u}) AND ({v})", f"({u}) AND NOT ({v})", f"NOT ({u}) AND ({v})", f"NOT ({u}) AND NOT ({v})")]
        return _kappa_sql(*cells)

    def rank(value: str, where: str = "true") -> str:
        return f"(SELECT *, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0::DOUBLE AS k FROM x WHERE {where})"

    def auc(value: str, flag: str, where: str) -> str:
        return f"(SELECT (sum(k) FILTER ({flag}) - count(*) FILTER ({flag}) * (count(*) FILTER ({flag}) + 1) / 2.0::DOUBLE) / (count(*) FILTER ({flag})::DOUBLE * count(*) FILTER (NOT ({flag}))) FROM {rank(value, where)})"

    def spearman(u: str, v: str, where: str = "true") -> str:
        place = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
        return f"(SELECT corr(u, v) FROM (SELECT {place(u)} AS u, {place(v)} AS v FROM x WHERE {where}))"

    sizes = "SELECT count(*) AS n, count(*) FILTER (t) AS n_target, count(*) FILTER (NOT t) AS n_control, count(*) FILTER (vs = 3) AS n_unanimous_o, count(*) FILTER (vs = 0) AS n_unanimous_x FROM x"
    rows.append(tidy_sql("sizes", f"{_PROBABILITY} {sizes}", ["n", "n_target", "n_control", "n_unanimous_o", "n_unanimous_x"]))
    for name, flag in _FLAGS.items():
        effect("reference", name, flag)
    for a, b in (("r1", "r2"), ("r1", "r3"), ("r2", "r3")):
        rows.append(tidy_sql("between", f"{_PROBABILITY} SELECT {kappa(a, b)} AS kappa", ["kappa"], f"'{a}~{b}'"))
    voters = {k: v for k, v in _FLAGS.items() if k != "unanimous"}
    for cut in probability.CUTS:
        more = "".join(f", {kappa(f'p >= {cut}::DOUBLE', v)} AS kappa_{k}" for k, v in voters.items())
        effect("threshold", str(cut), f"p >= {cut}::DOUBLE", more, [f"kappa_{k}" for k in voters])
    ranked = f"{_PROBABILITY} SELECT {spearman('p', 'vs')} AS spearman_votes, {auc('p', 'vs = 3', 'vs IN (0, 3)')} AS auc_unanimous, {auc('p', 't', 'true')} AS auc_target"
    rows.append(tidy_sql("rank", ranked, ["spearman_votes", "auc_unanimous", "auc_target"]))
    other = f"{_PROBABILITY} SELECT (SELECT count(o) FROM x) AS n, (SELECT corr(p, o) FROM x) AS pearson, {spearman('p', 'o', 'o IS NOT NULL')} AS spearman, {kappa('p >= 0.5', 'o >= 0.5', 'o IS NOT NULL')} AS kappa_at_half, {auc('o', 'vs = 3', 'o IS NOT NULL AND vs IN (0, 3)')} AS auc_unanimous"
    rows.append(tidy_sql("other", other, ["n", "pearson", "spearman", "kappa_at_half", "auc_unanimous"]))
    flip = f"{_PROBABILITY} SELECT count(q) AS n, avg(p + q) AS mean_sum, avg(abs(p + q - 1)) AS mean_gap, corr(p, q) AS r, 100 * avg((p >= 0.5 AND q >= 0.5)::INT) FILTER (q IS NOT NULL) AS both_yes_pct, 100 * avg((p < 0.5 AND q < 0.5)::INT) FILTER (q IS NOT NULL) AS both_no_pct FROM x"
    rows.append(tidy_sql("flip", flip, ["n", "mean_sum", "mean_gap", "r", "both_yes_pct", "both_no_pct"]))
    return " UNION ALL ".join(rows)


@query("report_probability", _probability_sql())
def report_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = A.wide(spark, sf_dir).withColumn("q", F.when(F.col("flag") != "R", 1 - F.col("tax") * 12)).withColumn("other", F.when(F.col("flag") != "N", F.col("quantity") / 50))
    return rounded(probability.report(probability.histogram(wide, "p", A.RATERS, "q", "other"), A.RATERS, "O", "F"))


_LEVELS = {"division": "book % 3", "kind": "book % 5", "title": "book"}
_LEVEL_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS level, ({v})::VARCHAR AS name, arm = 'O' AS t, vs = 3 AS y FROM j" for k, v in _LEVELS.items())


@query(
    "report_levels",
    f"""WITH {A.SQL_WIDE}, l AS ({_LEVEL_ROWS}), s AS (SELECT level, name, {_2X2} FROM l GROUP BY level, name), x AS (SELECT *, {_YATES} AS yates FROM s WHERE a + b >= 5 AND c + d >= 5), z AS (SELECT *, {tail_sql('yates')} AS pv FROM x)
SELECT level, name, a, b, c, d, round(100.0::DOUBLE*a/(a+b), 6) AS target_pct, round(100.0::DOUBLE*c/(c+d), 6) AS control_pct, round(100.0::DOUBLE*a/(a+b) - 100.0::DOUBLE*c/(c+d), 6) AS diff_pp,
  CASE WHEN b * c = 0 THEN 'Infinity'::DOUBLE ELSE round(a::DOUBLE*d/(b::DOUBLE*c), 6) END AS odds_ratio, round(yates, 6) AS chi2_yates, round(pv, 6) AS p,
  CASE WHEN pv < 0.001 THEN '***' WHEN pv < 0.01 THEN '**' WHEN pv < 0.05 THEN '*' ELSE 'ns' END AS stars FROM z""",
)
def report_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"division": F.col("book") % 3, "kind": F.col("book") % 5, "title": F.col("book")}
    return rounded(composites.level_tables(A.items(spark, sf_dir), levels, F.col("vote_sum") == 3, F.col("arm") == "O"))


@query(
    "report_sign_by_group",
    f"""WITH {A.SQL_WIDE}, s AS (SELECT book % 3 AS grp, book, {_2X2} FROM (SELECT book, arm = 'O' AS t, vs = 3 AS y FROM j) GROUP BY 1, 2),
g AS (SELECT grp, a * (c + d) - c * (a + b) AS gap FROM s WHERE a + b >= 5 AND c + d >= 5),
t AS (SELECT grp, count(*) FILTER (gap > 0)::BIGINT AS w, count(*) FILTER (gap < 0)::BIGINT AS l, count(*) FILTER (gap = 0)::BIGINT AS ties FROM g GROUP BY grp), x AS (SELECT *, unnest(range(0, least(w, l) + 1)) AS i FROM t)
SELECT grp AS "group", w AS wins, l AS losses, ties, round(least(1.0::DOUBLE, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2.0::DOUBLE)))), 6) AS p FROM x GROUP BY ALL""",
)
def report_sign_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.sign_by_group(A.items(spark, sf_dir), "book", F.col("book") % 3, F.col("vote_sum") == 3, F.col("arm") == "O"))


@query(
    "report_prevalence",
    """WITH o(grp, ord) AS (VALUES ('en', 1), ('fr', 2), ('de', 3), ('xx', 4)), g AS (SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (contains(text, 'the '))::BIGINT AS hits FROM documents GROUP BY lang),
r AS (SELECT grp, ord, coalesce(n, 0)::BIGINT AS n, coalesce(hits, 0)::BIGINT AS hits, coalesce(100.0::DOUBLE * hits / n, 0) AS pct FROM o LEFT JOIN g ON lang = grp)
SELECT grp AS "group", ord, n, hits, round(pct, 6) AS pct, CASE WHEN round(pct, 2) <> 0 THEN round((SELECT round(pct, 2) FROM r WHERE ord = 1) / round(pct, 2), 2) END AS ratio FROM r""",
)
def report_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = composites.prevalence(A.docs(spark, sf_dir), F.col("lang"), F.col("text").contains("the "), ["en", "fr", "de", "xx"])
    return rounded(docs)


@query(
    "report_drift",
    " UNION ALL ".join([
        tidy_sql("rater", _O["drift_agreement"], ["both", "first_only", "second_only", "neither", "pairs", "agreement_pct", "kappa"], "rater"),
        tidy_sql("direction", _O["drift_direction"], ["frozen_diff", "fresh_diff", "same_direction", "v_change"]),
    ]),
)
def report_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = A.long(spark, sf_dir).select(*A.KEY, "rater", "judgment")
    fresh = frozen.withColumn("judgment", F.when(F.col("okey") % 7 == 0, ~F.col("judgment")).otherwise(F.col("judgment")))
    return rounded(composites.drift_report(frozen, fresh, *A.items_twice(spark, sf_dir), A.KEY, 3, "O", "F"))


@query(
    "rater_summary",
    f"WITH {A.SQL_LONG} SELECT rater, flag, count(*)::BIGINT AS n, count(*) FILTER (judgment)::BIGINT AS positive, round(100.0::DOUBLE * count(*) FILTER (judgment) / count(*), 6) AS mean_pct FROM jl GROUP BY rater, flag",
)
def rater_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(judgments.summary(A.long(spark, sf_dir), ["rater", "flag"]))


@query(
    "category_sample",
    """WITH r AS (SELECT doc_id, source, contains(text, 'the ') AS side FROM documents), n AS (SELECT source, side, count(*)::BIGINT AS pool FROM r GROUP BY ALL)
SELECT source, side, doc_id, pool FROM (SELECT *, row_number() OVER (PARTITION BY source, side ORDER BY md5('7|' || doc_id::VARCHAR), doc_id) AS k FROM r) JOIN n USING (source, side) WHERE k <= 3""",
)
def category_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.docs(spark, sf_dir)
    return sampling.by_category(docs, 3, ["doc_id"], "source", 7, F.col("text").contains("the ")).select("source", "side", "doc_id", "pool")


@query(
    "report_preflight",
    f"""WITH {A.SQL_WIDE} SELECT arm, count(*)::BIGINT AS wanted, count(*) FILTER (NOT book < 5)::BIGINT AS left_base_only,
  count(*) FILTER (NOT (book < 5 OR (book = 7 AND quantity > 30)))::BIGINT AS left_with_supplement FROM j GROUP BY arm""",
)
def report_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = A.wide(spark, sf_dir)
    return composites.preflight(wanted, wanted.where("book < 5"), wanted.where("book = 7 and quantity > 30"), A.KEY)


@query(
    "report_cell_audit",
    f"""WITH {A.SQL_CELLS} SELECT 'cell' AS "column", cell AS value, count(*)::BIGINT AS n FROM c GROUP BY cell UNION ALL SELECT 'lang', lang, count(*)::BIGINT FROM c GROUP BY lang""",
)
def report_cell_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.audit(A.cells(spark, sf_dir), ["cell", "lang"])


@query(
    "report_verify_counts",
    """WITH e(o_orderstatus, expected) AS (VALUES ('F', 7500), ('O', 7314), ('Z', 1))
SELECT e.o_orderstatus, expected::BIGINT AS expected, coalesce(n, 0)::BIGINT AS found, coalesce(n, 0) = expected AS ok FROM e LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) o USING (o_orderstatus)""",
)
def report_verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites.verify_counts(A.orders(spark, sf_dir), "o_orderstatus", {"F": 7500, "O": 7314, "Z": 1})


@query(
    "source_table",
    f"""WITH {A.SQL_CELLS} SELECT source, count(*) FILTER (cell = 'I')::BIGINT AS "I", count(*) FILTER (cell = 'II')::BIGINT AS "II", count(*) FILTER (cell = 'III')::BIGINT AS "III", count(*) FILTER (cell = 'IV')::BIGINT AS "IV", count(*)::BIGINT AS n,
  round(100.0::DOUBLE * count(*) FILTER (cell IN ('I', 'II')) / count(*), 6) AS target_pct, round(100.0::DOUBLE * count(*) FILTER (cell IN ('I', 'III')) / count(*), 6) AS positive_pct FROM c GROUP BY source ORDER BY n DESC, source LIMIT 20""",
)
def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.source_table(A.cells(spark, sf_dir), "source", "cell", ["I", "II", "III", "IV"], ["I", "II"], ["I", "III"]))


@query(
    "mention_counts",
    """SELECT name, count(*) FILTER (contains(text, name) OR contains(source, name))::BIGINT AS rows FROM documents, (VALUES ('the'), ('web'), ('idiot')) n(name) GROUP BY name""",
)
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.mentions(A.docs(spark, sf_dir), ["the", "web", "idiot"], "text", "source")


@query(
    "phi_signed",
    f"WITH s AS (SELECT o_orderpriority AS priority, {_2X2} FROM (SELECT o_orderpriority, o_orderstatus = 'F' AS t, o_totalprice > 150000 AS y FROM orders) GROUP BY 1) SELECT priority, round(sqrt({_CHI} / (a+b+c+d)), 6) AS phi, round(sign(a*d - b*c) * sqrt({_CHI} / (a+b+c+d)), 6) AS signed_phi FROM s",
)
def phi_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.orders(spark, sf_dir).withColumn("priority", F.col("o_orderpriority"))
    rows = judgments.two_by_two(rows, F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F", ("priority",))
    return rounded(rows.select("priority", stats.phi(*"abcd").alias("phi"), stats.signed_phi(*"abcd").alias("signed_phi")))


#: Rules of which some lead on from others' results, two in a circle, and two to forms that no text has.
GAP_RULES = {"er": "re", "the": "teh", "tion": "sion", "ing": "in", "sion": "zion", "and": "und", "und": "and", "ha": "ah"}
_FOLLOW = 12


def _gap_sql() -> str:
    def rewritten(c: str) -> str:
        done = c
        for k, v in sorted(GAP_RULES.items(), key=lambda kv: -len(kv[0])):
            done = f"replace({done}, '{k}', '{v}')"
        return f"CASE {c} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in GAP_RULES.items())} ELSE {done} END"

    named = ", ".join(repr(k) for k in GAP_RULES)
    ends = ", ".join(f"({x!r})" for x in sorted({*GAP_RULES, *GAP_RULES.values()}))
    return f"""WITH RECURSIVE {A.SQL_MARKERS}, v AS (SELECT marker, count(*)::BIGINT AS n FROM m WHERE marker <> '' GROUP BY marker),
walk AS (SELECT form, form AS at_, 0 AS i FROM (SELECT marker AS form FROM v UNION SELECT * FROM (VALUES {ends})) UNION ALL SELECT form, {rewritten('at_')}, i + 1 FROM walk WHERE i < {2 * _FOLLOW}),
every AS (SELECT DISTINCT at_ AS form FROM walk), deep AS (SELECT form, form AS at_, 0 AS i FROM every UNION ALL SELECT form, {rewritten('at_')}, i + 1 FROM deep WHERE i < {2 * _FOLLOW}),
ended AS (SELECT form, min(at_) AS normal, count(DISTINCT at_) > 1 AS cyclic FROM deep WHERE i > {_FOLLOW} GROUP BY form),
fam AS (SELECT normal, count(*)::BIGINT AS forms, coalesce(sum(n), 0)::BIGINT AS n, max(cyclic) AS cyclic FROM ended LEFT JOIN v ON marker = form GROUP BY normal HAVING count(*) > 1),
f AS (SELECT 0 AS i, 'drop_e' AS rule, marker, n, regexp_replace(marker, '^e', '') AS form FROM v UNION ALL SELECT 1, 'er_to_en', marker, n, regexp_replace(marker, 'er$', 'en') FROM v UNION ALL SELECT 2, 'add_th', marker, n, 'th' || marker FROM v),
p AS (SELECT f.*, o.n AS form_n, row_number() OVER (PARTITION BY least(f.marker, form), greatest(f.marker, form) ORDER BY i, f.marker) AS k FROM f JOIN v o ON o.marker = form WHERE form <> f.marker AND f.marker NOT IN ({named})),
rows AS (SELECT 'pair' AS part, rule AS kind, marker AS first, form AS second, n AS n_first, form_n AS n_second, n + form_n AS together FROM p WHERE k = 1
  UNION ALL SELECT 'uncovered', '', marker, NULL, n, NULL, n FROM v WHERE n >= 3 AND marker NOT IN ({named}) AND {rewritten('marker')} = marker
  UNION ALL SELECT 'family', CASE WHEN cyclic THEN 'cyclic' ELSE '' END, normal, NULL, forms, n, n FROM fam)
SELECT part, kind, first, second, n_first::BIGINT AS n_first, n_second::BIGINT AS n_second, together::BIGINT AS together, row_number() OVER (PARTITION BY part, kind ORDER BY together DESC, first, second) AS place FROM rows"""


@query("report_rule_gaps", _gap_sql())
def report_rule_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = A.markers(spark, sf_dir).where("marker <> ''").groupBy("marker").agg(F.count("*").alias("n"))
    patterns: list[tuple[str, Column]] = [
        ("drop_e", F.regexp_replace("marker", "^e", "")),
        ("er_to_en", F.regexp_replace("marker", "er$", "en")),
        ("add_th", F.concat(F.lit("th"), "marker")),
    ]
    return coverage.audit(vocabulary, GAP_RULES, patterns, least=3)


_EXPECTED = "".join(f", ({r})::DOUBLE * ({c}) / (a+b+c+d) AS expected_{k}" for k, r, c in (("a", "a+b", "a+c"), ("b", "a+b", "b+d"), ("c", "c+d", "a+c"), ("d", "c+d", "b+d")))
_TEST = ["a", "b", "c", "d", "expected_a", "expected_b", "expected_c", "expected_d", "chi2_yates"]


def _metadata_sql() -> str:
    base = f"WITH {A.SQL_MARKERS}, x AS (SELECT lang AS grp, marker, marker LIKE '%n' AS hit FROM m)"
    sums = "count(*) AS records, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS others"
    groups = f"o(grp, ord) AS (VALUES ('en', 0), ('fr', 1), ('de', 2), ('xx', 3)), g AS (SELECT grp, {sums} FROM x GROUP BY grp), r AS (SELECT grp, ord, coalesce(records, 0) AS records, coalesce(hits, 0) AS hits, coalesce(others, 0) AS others, coalesce(100.0::DOUBLE * hits / records, 0) AS pct FROM o LEFT JOIN g USING (grp))"
    test = f"s AS (SELECT {_2X2} FROM (SELECT grp = 'en' AS t, hit AS y FROM x)), e AS (SELECT *, {_YATES} AS chi2_yates, {_CHI} AS chi2, a+b+c+d AS n{_EXPECTED} FROM s) SELECT *, sqrt(chi2_yates / n) AS v_yates, {tail_sql('chi2_yates')} AS p_yates, {tail_sql('chi2')} AS p FROM e"
    return " UNION ALL ".join([
        tidy_sql("totals", f"{base} SELECT {sums}, 100.0::DOUBLE * count(*) FILTER (hit) / count(*) AS pct FROM x", ["records", "hits", "others", "pct"]),
        tidy_sql("group", f"{base}, {groups} SELECT * FROM r", ["records", "hits", "others", "pct"], "grp"),
        tidy_sql("test", f"{base}, {test}", [*_TEST, "chi2", "n", "v_yates", "p_yates", "p"]),
        tidy_sql("ratio", f"{base}, {groups} SELECT grp, CASE WHEN round(pct, 2) <> 0 THEN round((SELECT round(pct, 2) FROM r WHERE ord = 0) / round(pct, 2), 2) END AS ratio FROM r WHERE ord > 0", ["ratio"], "grp"),
        tidy_sql("variant", f"{base} SELECT marker, count(*) AS rows FROM x WHERE hit GROUP BY marker ORDER BY rows DESC, marker LIMIT 25", ["rows"], "marker"),
    ])


@query("report_metadata", _metadata_sql())
def report_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.metadata_report(A.markers(spark, sf_dir), F.col("lang"), F.col("marker").endswith("n"), "marker", ["en", "fr", "de", "xx"]))


_PARTICLES = ["idiot", "web", "ly ", "nowhere at all"]


def _particle_sql() -> str:
    holds = " OR ".join(f"contains(text, '{t}')" for t in _PARTICLES)
    base = f"WITH {A.SQL_CELLS}, x AS (SELECT text, toxic = 1 AS y, coalesce({holds}, false) AS t FROM c), k(term) AS (VALUES {', '.join(f'({t!r})' for t in _PARTICLES)}), s AS (SELECT {_2X2} FROM x)"
    terms = f"{base} SELECT term, count(*) FILTER (contains(text, term)) AS corpus_n, count(*) FILTER (contains(text, term) AND y) AS target_n, coalesce(100.0::DOUBLE * count(*) FILTER (contains(text, term) AND y) / nullif(count(*) FILTER (contains(text, term)), 0), 0) AS target_pct FROM x, k GROUP BY term"
    test = f"{base}, e AS (SELECT *, {_YATES} AS chi2_yates{_EXPECTED} FROM s) SELECT *, 100.0::DOUBLE*a/(a+b) AS target_given_particle, 100.0::DOUBLE*c/(c+d) AS target_given_none, 100.0::DOUBLE*a/(a+c) AS particle_given_target, 100.0::DOUBLE*b/(b+d) AS particle_given_other, {tail_sql('chi2_yates')} AS p FROM e"
    return " UNION ALL ".join([
        tidy_sql("term", terms, ["corpus_n", "target_n", "target_pct"], "term"),
        tidy_sql("target", f'{base} SELECT a + c AS rows, a AS "with", c AS without FROM s', ["rows", "with", "without"]),
        tidy_sql("test", test, [*_TEST, "target_given_particle", "target_given_none", "particle_given_target", "particle_given_other", "p"]),
    ])


@query("report_particles", _particle_sql())
def report_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composites.particle_report(A.cells(spark, sf_dir), _PARTICLES, F.col("toxic") == 1))


@query(
    "consensus_examples",
    f"""WITH {A.SQL_WIDE}, x AS (SELECT arm, CASE vs WHEN 3 THEN 'O' ELSE 'X' END AS kind, book, okey, lnum FROM j WHERE vs IN (0, 3)),
d AS (SELECT *, count(*) OVER (PARTITION BY arm, kind) AS pool, row_number() OVER (PARTITION BY arm, kind, book ORDER BY md5('42|' || okey::VARCHAR || '|' || lnum::VARCHAR), okey, lnum) AS draw,
  min(okey * 100 + lnum) OVER (PARTITION BY arm, kind, book) AS first_ FROM x)
SELECT arm, kind, book, okey, lnum, row_number() OVER (PARTITION BY arm, kind ORDER BY first_, draw) AS place, pool::BIGINT AS pool FROM d WHERE draw <= 2 QUALIFY place <= 10""",
)
def consensus_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.items(spark, sf_dir).where("vote_sum in (0, 3)").withColumn("kind", F.when(F.col("vote_sum") == 3, "O").otherwise("X"))
    return sampling.examples(rows, ["arm", "kind"], "book", ["okey", "lnum"], 42)
