"""Evidence of whole texts: hundreds of terms found in one pass by an automaton, and the reports that rest on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import stats
from tallyframe.functions.text import strip
from tallyframe.operators import judgments, profile
from tallyframe.operators.ordering import numbered
from tallyframe.storage import durable


@dataclass(frozen=True)
class Feature:
    """Rows that contain any of some terms, or all of them, in any of some columns."""

    name: str
    terms: tuple[str, ...]
    every: bool = False
    columns: tuple[str, ...] = ("text",)


class Finder:
    """The features' terms as one Aho-Corasick automaton per column, and the features by term."""

    def __init__(self, features: list[Feature]) -> None:
        import ahocorasick

        self.automata, self.blank, self.of = {}, {}, {}
        self.wanted = [len(set(f.terms)) if f.every else 1 for f in features]
        self.always = [i for i, f in enumerate(features) if f.every and not f.terms]
        for column in {c for f in features for c in f.columns}:
            of: dict[str, list[int]] = {}
            for i, f in enumerate(features):
                for term in set(f.terms) if column in f.columns else ():
                    of.setdefault(term, []).append(i)
            automaton = ahocorasick.Automaton()
            for term in of.keys() - {""}:
                automaton.add_word(term, term)
            if len(automaton):
                automaton.make_automaton()
            self.automata[column], self.blank[column], self.of[column] = automaton, of.keys() & {""}, of

    def find(self, texts: dict[str, str | None]) -> list[int]:
        """Places of the features that hold. Each text is read once; after that only terms that it has take time."""
        held: dict[int, set[str]] = {}
        for column, automaton in self.automata.items():
            text = texts[column]
            if text is None:
                continue
            found = {t for _, t in automaton.iter(text)} if len(automaton) else set()
            for term in found | self.blank[column]:
                for i in self.of[column][term]:
                    held.setdefault(i, set()).add(term)
        return sorted([i for i, terms in held.items() if len(terms) >= self.wanted[i]] + self.always)


def annotate(df: DataFrame, features: list[Feature], keep: list[str]) -> DataFrame:
    """Columns `keep` and features, the places of the features that hold for each row, in order.

    The automaton travels to tasks once and reads each text once, so a thousand terms cost about what
    ten do. A null text contains nothing; an empty term is in every other text.
    """
    columns = sorted({c for f in features for c in f.columns})
    rows = df.select(F.struct(*keep).alias("row"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(features)
        for batch in batches:
            texts = [batch.column(i + 1).to_pylist() for i in range(len(columns))]
            hits = [finder.find(dict(zip(columns, row, strict=True))) for row in zip(*texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], ["row", "features"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, features array<int>"
    return rows.mapInArrow(mark, schema).select("row.*", "features")


def feature_rows(marked: DataFrame, features: list[Feature], by: list[str]) -> DataFrame:
    """Per group and feature: rows for which it holds, rows of the group, percent; features without rows have 0."""
    sizes = marked.groupBy(*by).agg(F.count("*").alias("n"))
    held = marked.select(*by, F.explode("features").alias("i")).groupBy(*by, "i").agg(F.count("*").alias("rows"))
    names = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("feature")) for i, f in enumerate(features)))
    out = sizes.select(*by, "n", F.explode(names).alias("f")).select(*by, "n", "f.*").join(held, [*by, "i"], "left").fillna(0, ["rows"])
    return out.select(*by, "feature", "rows", "n", stats.percent("rows", "n").alias("pct"))


def feature_contrast(rates: DataFrame, cell: str, first: list[str], second: list[str]) -> DataFrame:
    """Of feature_rows() by cell: rows and percent of each feature in two groups of cells, and the difference in points."""
    part = lambda c, cells: F.sum(F.when(F.col(cell).isin(cells), F.col(c)).otherwise(0))
    sums = rates.groupBy("feature").agg(*(part(c, g).alias(f"{c}_{i}") for i, g in ((1, first), (2, second)) for c in ("rows", "n")))
    p, q = stats.percent("rows_1", "n_1"), stats.percent("rows_2", "n_2")
    return sums.select("feature", "rows_1", "n_1", "rows_2", "n_2", p.alias("pct_1"), q.alias("pct_2"), (p - q).alias("diff_pp"))


def ranked(counts: DataFrame, by: list[str], item: str, k: int | None = None) -> DataFrame:
    """Items of each group with their place by rows, ties by item; the first k."""
    order = Window.partitionBy(*by).orderBy(F.desc("rows"), item)
    out = counts.withColumn("place", F.row_number().over(order).cast("long"))
    return out if k is None else out.where(F.col("place") <= k)


def placed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with place, from 0 in each group's order, and size, the group's rows; groups are numbered range by range."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("size"))
    return numbered(rows, [order], tuple(by), "place").withColumn("place", F.col("place").cast("long")).join(sizes, by)


def even(rows: DataFrame, k: int) -> DataFrame:
    """Of placed() rows every s-th of each group, s being the group's size over k, at least 1: k rows at most."""
    step = F.greatest(F.lit(1), F.floor(F.col("size") / k))
    return rows.where((F.col("place") % step == 0) & (F.col("place") < step * k))


@dataclass(frozen=True)
class Spec:
    """What the questions ask for: terms by question, labels with their terms, names, tokens, sizes of samples."""

    concepts: tuple[str, ...] = ()
    decision: tuple[str, ...] = ()
    connective: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()
    labels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    names: tuple[str, ...] = ()
    token: str = "[a-z]{2,}"
    stop: tuple[str, ...] = ()
    edges: tuple[int, ...] = (30, 60, 100, 150)
    text: str = "text"
    source: str = "source"
    category: str = "lang"
    key: str = "doc_id"
    examples: int = 150
    sources: int = 15

    def features(self) -> list[Feature]:
        """All features, each under a name that tells its question's part."""
        both = (self.text, self.source)
        plain = {"concept": self.concepts, "decision": self.decision, "connective": self.connective}
        out = [Feature(f"{part}:{t}", (t,), columns=(self.text,)) for part, terms in plain.items() for t in terms]
        out += [Feature(f"pair:{a}…{b}", (a, b), True, (self.text,)) for a, b in self.pairs]
        out += [Feature(f"mood:{k}", v, columns=(self.text,)) for k, v in self.labels.items()]
        return out + [Feature(f"name:{x}", (x,), columns=both) for x in self.names]


_TIDY = ("question", "cell", "part", "item", "place", "rows", "pct", "key")


def _tidy(df: DataFrame, question: str, part: str | Column, item: Column | str | None = None) -> DataFrame:
    have = {c: F.col(c).cast(t) for c, t in (("place", "long"), ("rows", "long"), ("pct", "double"), ("key", "long")) if c in df.columns}
    kinds = {"place": "long", "rows": "long", "pct": "double", "key": "long"}
    name = F.lit("") if item is None else stats.col(item).cast("string")
    given = {"question": F.lit(question), "part": F.lit(part) if isinstance(part, str) else part, "item": F.coalesce(name, F.lit(""))}
    return df.select(*((given[c] if c in given else F.col("cell") if c == "cell" else have.get(c, F.lit(None).cast(kinds[c]))).alias(c) for c in _TIDY))


def _marked(df: DataFrame, cell: str, cells: list[str], spec: Spec) -> DataFrame:
    """Narrow rows with all that the questions need but tokens: texts are read once and stay where they are."""
    rows = df.where(F.col(cell).isin(cells)).withColumns({"cell": F.col(cell), "source_": F.col(spec.source), "category_": F.col(spec.category), "key": F.col(spec.key)})
    bare, size = strip(spec.text), F.length(spec.text)
    bucket = sum((F.when(size >= e, 1).otherwise(0) for e in spec.edges), F.lit(0))
    tail = lambda n: F.when(F.length(bare) >= n, F.right(bare, F.lit(n)))
    rows = rows.withColumns({"bucket_": F.when(size.isNotNull(), bucket), "tail5": tail(5), "tail3": tail(3)})
    keep = ["cell", "source_", "category_", "key", "bucket_", "tail5", "tail3"]
    return durable(annotate(rows, spec.features(), keep).withColumnsRenamed({"source_": "source", "category_": "category", "bucket_": "bucket"}))


def _counts(marked: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Rows of each value of several columns: part (the column), item, rows; one grouping for all."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("item")) for c in columns))).alias("v")
    return marked.select(*by, values).select(*by, "v.*").where("item is not null").groupBy(*by, "part", "item").agg(F.count("*").alias("rows"))


def _by_source(rows: DataFrame, sources: DataFrame, spec: Spec) -> DataFrame:
    """Of placed() rows of sources those at even steps, source by source in the order of their rank, until there are enough."""
    step = F.greatest(F.lit(1), F.floor(F.col("size") / (spec.examples // spec.sources + 1)))
    rank = sources.select("cell", "item", F.col("place").alias("rank"))
    taken = rows.where(F.col("place") % step == 0).join(F.broadcast(rank), ["cell", "item"])
    # Each source has a bounded number of rows here.
    order = Window.partitionBy("cell").orderBy("rank", "place")
    return taken.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= spec.examples)


def by_cell(df: DataFrame, cell: str, cells: list[str], spec: Spec) -> DataFrame:
    """Evidence for six questions in each cell, as rows of question, cell, part, item, place, rows, pct and key.

    themes: sizes, sources, categories, tokens, examples at even steps of the first sources. subpatterns:
    lengths, endings, concepts. decision and connective: rows with each term, with examples at even
    steps, and pairs of terms. mood: rows of each label, which may overlap, with the first examples, and
    endings. sources: names that occur in text or source, examples of the first sources. All counts
    are of whole texts; key is that of an example. Parts without rows are absent but for terms.
    """
    marked, features = _marked(df, cell, cells, spec), spec.features()
    counts = durable(_counts(marked, ["cell"], "source", "category", "bucket", "tail5", "tail3"))
    part = lambda name, k=None: ranked(counts.where(F.col("part") == name).drop("part"), ["cell"], "item", k)
    sizes = marked.groupBy("cell").agg(F.count("*").alias("rows"))
    rates = feature_rows(marked, features, ["cell"])
    rates = rates.withColumns({"part": F.split_part("feature", F.lit(":"), F.lit(1)), "item": F.expr("substring(feature, instr(feature, ':') + 1)")})
    rates = durable(rates)
    tokens = profile.top_tokens(df.where(F.col(cell).isin(cells)).withColumn("cell", F.col(cell)), spec.token, 50, ["cell"], list(spec.stop), spec.text)
    sources = durable(part("source"))
    name = F.element_at(F.array(*(F.lit(f.name) for f in features)), F.col("i") + 1)
    holds = marked.select("cell", "key", F.explode("features").alias("i")).select("cell", "key", name.alias("f"))
    of = lambda kind: holds.where(F.col("f").startswith(kind + ":")).select("cell", "key", F.expr("substring(f, instr(f, ':') + 1)").alias("item"))
    first10 = Window.partitionBy("cell", "item").orderBy("key")
    # Rows of which examples are taken at even steps, all numbered at once.
    top = F.broadcast(sources.where(F.col("place") <= spec.sources).select("cell", F.col("item").alias("source")))
    pools = {"decision": of("decision"), "connective": of("connective"), "source": marked.join(top, ["cell", "source"]).select("cell", "key", F.col("source").alias("item"))}
    pool = reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(kind)) for kind, df in pools.items()))
    pool = durable(placed(pool, ["kind", "cell", "item"], "key"))
    taken = lambda kind: pool.where(F.col("kind") == kind)
    first = F.broadcast(sources.where(F.col("place") <= 10).select("cell", "item"))
    parts = [
        _tidy(sizes, "themes", "rows"),
        _tidy(sources, "themes", "source", "item"),
        _tidy(part("category"), "themes", "category", "item"),
        _tidy(tokens.select("cell", F.col("token").alias("item"), F.col("n").alias("rows"), F.col("rank").alias("place")), "themes", "token", "item"),
        _tidy(_by_source(taken("source"), sources, spec), "themes", "example", "item"),
        _tidy(counts.where("part = 'bucket'"), "subpatterns", "length", "item"),
        _tidy(part("tail5", 30), "subpatterns", "ending", "item"),
        _tidy(rates.where("part = 'concept' and rows > 0"), "subpatterns", "concept", "item"),
        _tidy(rates.where("part = 'decision'"), "decision", "term", "item"),
        _tidy(even(taken("decision"), 20), "decision", "example", "item"),
        _tidy(rates.where("part = 'connective'"), "connective", "term", "item"),
        _tidy(even(taken("connective"), 15), "connective", "example", "item"),
        _tidy(rates.where("part = 'pair' and rows > 0"), "connective", "pair", "item"),
        _tidy(rates.where("part = 'mood'"), "mood", "label", "item"),
        _tidy(of("mood").withColumn("place", F.row_number().over(first10).cast("long")).where("place <= 10"), "mood", "example", "item"),
        _tidy(part("tail3", 20), "mood", "ending", "item"),
        _tidy(rates.where("part = 'name' and rows > 0"), "sources", "name", "item"),
        _tidy(even(taken("source").join(first, ["cell", "item"]), 5), "sources", "example", "item"),
    ]
    return reduce(DataFrame.unionByName, parts)


def across(df: DataFrame, cell: str, cells: list[str], spec: Spec) -> DataFrame:
    """Evidence across four cells (target and positive, target and not, control and positive, control and not), as
    rows of question, part, item, measure and value.

    endings: concepts in target and control cells with the difference in points, first sources and tokens
    of both. decisions: decision terms in positive and other cells. interaction and connective: terms and
    pairs in each cell. sources: the first 20 sources by cell with the shares of target and positive, and
    those among the first 20 of one ending only. hypothesis: the 2x2 with chi-squared, odds ratio,
    relative risk and difference.
    """
    i, ii, iii, iv = cells
    marked, features = _marked(df, cell, cells, spec), spec.features()
    rates = durable(feature_rows(marked, features, ["cell"]))
    of = lambda kind: rates.where(F.col("feature").startswith(kind + ":")).withColumn("feature", F.expr("substring(feature, instr(feature, ':') + 1)"))
    counts = durable(_counts(marked, ["cell"], "source").drop("part"))
    ends = F.when(F.col("cell").isin(i, ii), "target").otherwise("control")
    tops = ranked(counts.groupBy(ends.alias("end"), "item").agg(F.sum("rows").alias("rows")), ["end"], "item", 20)
    tops = durable(tops)
    rows = df.where(F.col(cell).isin(cells)).withColumn("end", F.when(F.col(cell).isin(i, ii), "target").otherwise("control"))
    tokens = profile.top_tokens(rows, spec.token, 30, ["end"], list(spec.stop), spec.text)
    two = marked.agg(*(F.count_if(F.col("cell") == c).alias(x) for c, x in zip(cells, "abcd", strict=True)))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    p, q = stats.percent("a", F.col("a") + F.col("b")), stats.percent("c", F.col("c") + F.col("d"))
    test = two.select(*"abcd", n.alias("n"), stats.chi2(*"abcd").alias("chi2"), stats.plain_odds_ratio(*"abcd").alias("odds_ratio"), stats.relative_risk(*"abcd").alias("relative_risk"), p.alias("target_pct"), q.alias("control_pct"), (p - q).alias("diff_pp"))
    table = profile.source_table(marked.select("source", "cell").where("source is not null"), "source", "cell", cells, [i, ii], [i, iii])
    only = lambda one, other: tops.where(F.col("end") == one).join(tops.where(F.col("end") == other).select("item"), "item", "left_anti")

    def tidy(frame: DataFrame, question: str, part: str, item: str | Column, *measures: str) -> DataFrame:
        values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("v")
        name = F.col(item) if isinstance(item, str) else item
        return frame.select(F.lit(question).alias("question"), F.lit(part).alias("part"), name.cast("string").alias("item"), values).select("question", "part", "item", "v.*").where("value is not null")

    contrast = ("rows_1", "n_1", "rows_2", "n_2", "pct_1", "pct_2", "diff_pp")
    in_cell = F.concat_ws(":", "cell", "feature")
    parts = [
        tidy(feature_contrast(of("concept"), "cell", [i, ii], [iii, iv]), "endings", "concept", "feature", *contrast),
        tidy(tops.where("place <= 15"), "endings", "source", F.concat_ws(":", "end", "item"), "place", "rows"),
        tidy(tokens, "endings", "token", F.concat_ws(":", "end", "token"), "rank", "n"),
        tidy(feature_contrast(of("decision"), "cell", [i, iii], [ii, iv]), "decisions", "term", "feature", *contrast),
        tidy(test, "interaction", "cells", F.lit(""), *"abcd", "target_pct", "control_pct", "diff_pp"),
        tidy(of("decision"), "interaction", "term", in_cell, "rows", "n", "pct"),
        tidy(of("connective"), "connective", "term", in_cell, "rows", "n", "pct"),
        tidy(of("pair"), "connective", "pair", in_cell, "rows", "n", "pct"),
        tidy(table, "sources", "source", "source", *cells, "n", "target_pct", "positive_pct"),
        tidy(only("target", "control"), "sources", "target_only", "item", "rows"),
        tidy(only("control", "target"), "sources", "control_only", "item", "rows"),
        tidy(test, "hypothesis", "test", F.lit(""), *"abcd", "n", "chi2", "odds_ratio", "relative_risk", "target_pct", "control_pct", "diff_pp"),
    ]
    return reduce(DataFrame.unionByName, parts)
