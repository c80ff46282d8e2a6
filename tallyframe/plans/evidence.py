"""Registered evidence reports over whole texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import evidence, profile
from tallyframe.plans import adapters as A
from tallyframe.plans.reports import _CHI, REGISTRY, rounded
from tallyframe.registry import table

query = REGISTRY.add

CELLS = ["I", "II", "III", "IV"]
SPEC = evidence.Spec(
    concepts=("the", "tion", "heit", "que ", "der ", "nowhere at all"),
    decision=("idiot", "is ", "not ", "ly ", "must"),
    connective=("and ", "und ", "that ", "for ", "web"),
    pairs=(("and ", "that "), ("und ", "der "), ("idiot", "web")),
    labels={"article": ("the ", "der ", "la "), "joint": (" and ", " und ", " y "), "noun": ("tion", "heit", "keit"), "none": ("nowhere at all",)},
    names=("src1", "src12", "web", "idiot"),
    stop=("the", "and", "of"),
    edges=(100, 500, 1500, 5000),
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _features_sql() -> str:
    """The specification's features as a table of values."""
    rows = [("concept", t, (t,), False) for t in SPEC.concepts] + [("decision", t, (t,), False) for t in SPEC.decision]
    rows += [("connective", t, (t,), False) for t in SPEC.connective] + [("pair", f"{a}…{b}", (a, b), True) for a, b in SPEC.pairs]
    rows += [("mood", k, v, False) for k, v in SPEC.labels.items()] + [("name", x, (x,), False) for x in SPEC.names]
    return ", ".join(f"({_quoted(p)}, {_quoted(i)}, [{', '.join(map(_quoted, t))}], {e})" for p, i, t, e in rows)


_STOP = ", ".join(map(_quoted, SPEC.stop))
_BUCKET = "CASE " + " ".join(f"WHEN length(text) < {e} THEN {i}" for i, e in enumerate(SPEC.edges)) + f" ELSE {len(SPEC.edges)} END"
_BASE = rf"""WITH {A.SQL_CELLS}, f(part, item, terms, every) AS (VALUES {_features_sql()}),
holds AS (SELECT cell, doc_id AS key, part, item FROM c, f WHERE CASE WHEN every THEN len(list_filter(terms, lambda t: contains(text, t))) = len(terms)
  ELSE len(list_filter(terms, lambda t: contains(text, t) OR (part = 'name' AND contains(source, t)))) > 0 END),
sizes AS (SELECT cell, count(*)::BIGINT AS n FROM c GROUP BY cell),
rates AS (SELECT s.cell, part, item, count(key)::BIGINT AS rows, n, round(100.0::DOUBLE * count(key) / n, 6) AS pct FROM sizes s CROSS JOIN f LEFT JOIN holds h USING (cell, part, item) GROUP BY s.cell, part, item, n),
bare AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM c),
vals AS (SELECT cell, 'source' AS part, source AS item FROM c WHERE source IS NOT NULL UNION ALL SELECT cell, 'category', lang FROM c WHERE lang IS NOT NULL UNION ALL SELECT cell, 'bucket', ({_BUCKET})::VARCHAR FROM c
  UNION ALL SELECT cell, 'tail5', right(b, 5) FROM bare WHERE length(b) >= 5 UNION ALL SELECT cell, 'tail3', right(b, 3) FROM bare WHERE length(b) >= 3),
counts AS (SELECT cell, part, item, count(*)::BIGINT AS rows FROM vals GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY cell, part ORDER BY rows DESC, item)::BIGINT AS place FROM counts)"""


def _spread_sql(rows: str, k: int) -> str:
    return f"""SELECT cell, item, pos AS place, key FROM (SELECT cell, item, key, row_number() OVER (PARTITION BY cell, item ORDER BY key) - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY cell, item) // {k}) AS step FROM {rows}) WHERE pos % step = 0 AND pos // step < {k}"""


def _out(question: str, part: str, sql: str, have: str) -> str:
    """Rows of a part; columns that it lacks are null."""
    kinds = {"place": "BIGINT", "rows": "BIGINT", "pct": "DOUBLE", "key": "BIGINT"}
    columns = ", ".join(f"{c if c in have.split() else 'NULL'}::{t} AS {c}" for c, t in kinds.items())
    return f"SELECT '{question}' AS question, cell, '{part}' AS part, {'item::VARCHAR' if 'item' in have.split() else repr('')} AS item, {columns} FROM ({sql})"


_TOKENS = f"SELECT cell, token AS item, rows, row_number() OVER (PARTITION BY cell ORDER BY rows DESC, token) AS place FROM (SELECT cell, token, count(*)::BIGINT AS rows FROM (SELECT cell, unnest(regexp_extract_all(text, '{SPEC.token}')) AS token FROM c) WHERE token NOT IN ({_STOP}) GROUP BY ALL) QUALIFY place <= 50"
_EXAMPLES = f"""SELECT cell, item, key, row_number() OVER (PARTITION BY cell ORDER BY rank, pos) AS place FROM (
  SELECT c.cell, c.source AS item, c.doc_id AS key, p.place AS rank, greatest(1, p.rows // {SPEC.examples // SPEC.sources + 1}) AS step, row_number() OVER (PARTITION BY c.cell, c.source ORDER BY c.doc_id) - 1 AS pos
  FROM c JOIN placed p ON p.cell = c.cell AND p.part = 'source' AND p.item = c.source WHERE p.place <= {SPEC.sources}) WHERE pos % step = 0 QUALIFY place <= {SPEC.examples}"""
_OF = lambda part: f"(SELECT * FROM holds WHERE part = '{part}')"
_TOP10 = "(SELECT c.cell, c.source AS item, c.doc_id AS key FROM c JOIN placed p ON p.cell = c.cell AND p.part = 'source' AND p.item = c.source WHERE p.place <= 10)"


@query(
    "evidence_by_cell",
    _BASE + " " + " UNION ALL ".join([
        _out("themes", "rows", "SELECT cell, n AS rows FROM sizes", "rows"),
        _out("themes", "source", "SELECT * FROM placed WHERE part = 'source'", "item place rows"),
        _out("themes", "category", "SELECT * FROM placed WHERE part = 'category'", "item place rows"),
        _out("themes", "token", _TOKENS, "item place rows"),
        _out("themes", "example", _EXAMPLES, "item place key"),
        _out("subpatterns", "length", "SELECT * FROM counts WHERE part = 'bucket'", "item rows"),
        _out("subpatterns", "ending", "SELECT * FROM placed WHERE part = 'tail5' AND place <= 30", "item place rows"),
        _out("subpatterns", "concept", "SELECT * FROM rates WHERE part = 'concept' AND rows > 0", "item rows pct"),
        _out("decision", "term", "SELECT * FROM rates WHERE part = 'decision'", "item rows pct"),
        _out("decision", "example", _spread_sql(_OF("decision"), 20), "item place key"),
        _out("connective", "term", "SELECT * FROM rates WHERE part = 'connective'", "item rows pct"),
        _out("connective", "example", _spread_sql(_OF("connective"), 15), "item place key"),
        _out("connective", "pair", "SELECT * FROM rates WHERE part = 'pair' AND rows > 0", "item rows pct"),
        _out("mood", "label", "SELECT * FROM rates WHERE part = 'mood'", "item rows pct"),
        _out("mood", "example", "SELECT *, row_number() OVER (PARTITION BY cell, item ORDER BY key) AS place FROM holds WHERE part = 'mood' QUALIFY place <= 10", "item place key"),
        _out("mood", "ending", "SELECT * FROM placed WHERE part = 'tail3' AND place <= 20", "item place rows"),
        _out("sources", "name", "SELECT * FROM rates WHERE part = 'name' AND rows > 0", "item rows pct"),
        _out("sources", "example", _spread_sql(_TOP10, 5), "item place key"),
    ]),
)
def evidence_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.by_cell(A.cells(spark, sf_dir), "cell", CELLS, SPEC))


def _measures(question: str, part: str, sql: str, item: str, *measures: str) -> str:
    names, values = ", ".join(f"'{m}'" for m in measures), ", ".join(f'"{m}"::DOUBLE' for m in measures)
    return f"SELECT '{question}' AS question, '{part}' AS part, item, measure, round(value, 6) AS value FROM (SELECT ({item})::VARCHAR AS item, unnest([{names}]) AS measure, unnest([{values}]) AS value FROM ({sql})) WHERE value IS NOT NULL"


def _contrast_sql(part: str, first: str, second: str) -> str:
    sums = ", ".join(f"coalesce(sum({c}) FILTER (cell IN ({g})), 0)::BIGINT AS {c}_{i}" for i, g in ((1, first), (2, second)) for c in ("rows", "n"))
    return f"SELECT *, 100.0::DOUBLE*rows_1/n_1 AS pct_1, 100.0::DOUBLE*rows_2/n_2 AS pct_2, 100.0::DOUBLE*rows_1/n_1 - 100.0::DOUBLE*rows_2/n_2 AS diff_pp FROM (SELECT item, {sums} FROM rates WHERE part = '{part}' GROUP BY item)"


_CONTRAST = ("rows_1", "n_1", "rows_2", "n_2", "pct_1", "pct_2", "diff_pp")
_ENDS = "CASE WHEN cell IN ('I', 'II') THEN 'target' ELSE 'control' END"
_ACROSS = f"""{_BASE}, tops AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY rows DESC, item) AS place FROM (SELECT {_ENDS} AS e, item, sum(rows)::BIGINT AS rows FROM counts WHERE part = 'source' GROUP BY ALL) QUALIFY place <= 20),
t AS (SELECT count(*) FILTER (cell = 'I') AS a, count(*) FILTER (cell = 'II') AS b, count(*) FILTER (cell = 'III') AS c, count(*) FILTER (cell = 'IV') AS d FROM c),
test AS (SELECT *, a + b + c + d AS n, {_CHI} AS chi2, CASE WHEN b * c = 0 THEN 'Infinity'::DOUBLE ELSE a::DOUBLE*d/(b::DOUBLE*c) END AS odds_ratio,
  CASE WHEN c = 0 THEN 'Infinity'::DOUBLE ELSE (a::DOUBLE/(a+b)) / (c::DOUBLE/(c+d)) END AS relative_risk, 100.0::DOUBLE*a/(a+b) AS target_pct, 100.0::DOUBLE*c/(c+d) AS control_pct, 100.0::DOUBLE*a/(a+b) - 100.0::DOUBLE*c/(c+d) AS diff_pp FROM t)"""
_BY_SOURCE = """SELECT source, count(*) FILTER (cell = 'I') AS "I", count(*) FILTER (cell = 'II') AS "II", count(*) FILTER (cell = 'III') AS "III", count(*) FILTER (cell = 'IV') AS "IV", count(*) AS n,
  100.0::DOUBLE * count(*) FILTER (cell IN ('I', 'II')) / count(*) AS target_pct, 100.0::DOUBLE * count(*) FILTER (cell IN ('I', 'III')) / count(*) AS positive_pct FROM c WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 20"""
_TOKENS_ENDS = f"SELECT *, row_number() OVER (PARTITION BY e ORDER BY n DESC, token) AS rank FROM (SELECT {_ENDS} AS e, token, count(*) AS n FROM (SELECT cell, unnest(regexp_extract_all(text, '{SPEC.token}')) AS token FROM c) WHERE token NOT IN ({_STOP}) GROUP BY ALL) QUALIFY rank <= 30"
_RATES = lambda part: f"SELECT * FROM rates WHERE part = '{part}'"
_ONLY = lambda one, other: f"SELECT item, rows FROM tops WHERE e = '{one}' AND item NOT IN (SELECT item FROM tops WHERE e = '{other}')"


@query(
    "evidence_across_cells",
    _ACROSS + " " + " UNION ALL ".join([
        _measures("endings", "concept", _contrast_sql("concept", "'I', 'II'", "'III', 'IV'"), "item", *_CONTRAST),
        _measures("endings", "source", "SELECT * FROM tops WHERE place <= 15", "e || ':' || item", "place", "rows"),
        _measures("endings", "token", _TOKENS_ENDS, "e || ':' || token", "rank", "n"),
        _measures("decisions", "term", _contrast_sql("decision", "'I', 'III'", "'II', 'IV'"), "item", *_CONTRAST),
        _measures("interaction", "cells", "SELECT * FROM test", "''", *"abcd", "target_pct", "control_pct", "diff_pp"),
        _measures("interaction", "term", _RATES("decision"), "cell || ':' || item", "rows", "n", "pct"),
        _measures("connective", "term", _RATES("connective"), "cell || ':' || item", "rows", "n", "pct"),
        _measures("connective", "pair", _RATES("pair"), "cell || ':' || item", "rows", "n", "pct"),
        _measures("sources", "source", _BY_SOURCE, "source", *CELLS, "n", "target_pct", "positive_pct"),
        _measures("sources", "target_only", _ONLY("target", "control"), "item", "rows"),
        _measures("sources", "control_only", _ONLY("control", "target"), "item", "rows"),
        _measures("hypothesis", "test", "SELECT * FROM test", "''", *"abcd", "n", "chi2", "odds_ratio", "relative_risk", "target_pct", "control_pct", "diff_pp"),
    ]),
)
def evidence_across_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.across(A.cells(spark, sf_dir), "cell", CELLS, SPEC))


@query(
    "vocabulary_rows",
    """WITH w AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS term FROM conversations) GROUP BY term ORDER BY n DESC, term LIMIT 1000),
h AS (SELECT lang, term, count(*)::BIGINT AS rows FROM documents, w WHERE contains(text, term) GROUP BY ALL), s AS (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang)
SELECT lang, term AS feature, rows, n, round(100.0::DOUBLE * rows / n, 6) AS pct FROM h JOIN s USING (lang)""",
)
def vocabulary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thousand most frequent words of conversations, sought in all documents at once."""
    words = profile.top_tokens(table(spark, sf_dir, "conversations").withColumn("all", F.lit(1)), "[a-z]{4,}", 1000, ["all"])
    features = [evidence.Feature(r.token, (r.token,)) for r in words.collect()]
    marked = evidence.annotate(table(spark, sf_dir, "documents"), features, ["lang"])
    return rounded(evidence.feature_rows(marked, features, ["lang"]).where("rows > 0"))
