"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Everything here is a DataFrame function; no row leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import durable

# Kinds of base secrets with pattern, group that is measured, and its least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Candidates of the battery: runs of this many characters of the base64 and URL-safe alphabets.
LEAST_RUN = 20
_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % LEAST_RUN
#: Encodings from narrow to wide: name, pattern of the whole run, symbols in order of value; the first five are lower-cased.
#: Hexadecimal runs may be of mixed case and in groups, as identifiers are; the dashes between groups are left out.
ENCODINGS = (
    ("digits", r"^[0-9]+$", "0123456789"),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+|(?=[0-9-]*[A-Fa-f])[0-9A-Fa-f]+(?:-[0-9A-Fa-f]+)*)$", "0123456789abcdef"),
    ("letters", r"^(?:[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
# Shares of the letters a to z in English text, in percent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Chances in ordinary words, names and paths that an upper-case letter, a lower-case one, a digit or a sign (rows) is
#: followed by each of these (columns).
FOLLOWS = ((0.60, 0.28, 0.02, 0.10), (0.04, 0.84, 0.02, 0.10), (0.04, 0.04, 0.76, 0.16), (0.32, 0.32, 0.32, 0.04))
#: A run whose tests reject randomness at this level is ordinary text.
ALPHA = 0.001
#: Share of false discoveries allowed for each encoding and band of lengths, and the bands' lower ends.
FDR = 0.01
BANDS = (20, 28, 40, 64, 128)
#: Bins per unit of the natural logarithm in which p-values are ranked.
_BINS = 8


def _found(text: Column, kind: str, pattern: str, group: int, run: bool = False) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, null if there are none: kind and, for each, the characters
    between it and the one before, its length, the measured group's length, and the match itself if asked for.

    The text between matches and the matches alternate, so running sums of lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.arrays_zip(whole.alias("w"), part.alias("p"), F.split(text, pattern, -1).alias("b"))
    none = F.lit(None).cast("string")
    item = lambda x: F.struct(
        F.length(x["b"]).alias("gap"), F.length(x["w"]).alias("size"), F.length(x["p"]).alias("n"), (x["w"] if run else none).alias("run")
    )
    items = F.filter(F.transform(each, item), lambda x: x["size"].isNotNull())
    return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), items.alias("items")))


def _digest(hits: Column, order: tuple[str, ...]) -> Column:
    """kind:start:end of each hit by start, then kind in the given order, joined by commas."""
    sortable = F.transform(
        hits,
        lambda h: F.struct(
            h["s"].alias("s"), F.array_position(F.array(*map(F.lit, order)), h["kind"]).alias("k"), h["e"].alias("e"), h["kind"].alias("kind")
        ),
    )
    texts = F.transform(F.array_sort(sortable), lambda h: F.concat_ws(":", h["kind"], h["s"], h["e"]))
    return F.array_join(texts, ",")


def _tests(runs: DataFrame) -> DataFrame:
    """Statistics of each distinct run: p_random (randomness not rejected), log_p (text rejected), stratum.

    log_p is a bound on the chance that ordinary text has a run as much likelier under uniform random
    symbols of its encoding: by Markov's inequality that chance is at most the inverse of the ratio of
    likelihoods. Text is modelled by kinds of characters, each following the one before, and by
    letter shares.
    """
    enc = F.coalesce(*(F.when(F.col("run").rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)), F.lit(len(ENCODINGS) - 1))
    symbols = F.element_at(F.array(*(F.lit(a) for *_, a in ENCODINGS)), F.col("enc") + 1)
    plain = F.when(F.col("enc") <= 4, F.translate(F.lower("run"), "-", "")).otherwise(F.translate("run", "_-", "/+"))
    rows = runs.withColumn("enc", enc).withColumn("symbols", symbols).withColumn("run_", plain)
    rows = rows.withColumn("a", F.length("symbols").cast("double")).withColumn("n", F.length("run_").cast("double"))
    value = F.transform(F.split("run_", ""), lambda c: F.position(c, "symbols"))
    rows = rows.withColumn("v", F.filter(value, lambda x: x > 0))
    counted = F.transform(F.array_distinct("v"), lambda x: F.pow(F.size(F.filter("v", lambda y: y == x)).cast("double"), F.lit(2.0)))
    total = F.aggregate(counted, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("chi2", total * F.col("a") / F.col("n") - F.col("n"))
    # Wilson-Hilferty: the cube root of a chi-squared variable over its degrees is nearly normal.
    df = F.col("a") - 1
    spread = F.lit(2.0) / (F.lit(9.0) * df)
    rows = rows.withColumn("z_chi", (F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    # Runs of values in the lower and the upper half of the alphabet (Wald-Wolfowitz).
    half = F.transform("v", lambda x: (x > F.col("a") / 2).cast("int"))
    rows = rows.withColumn("half", half)
    ups = F.aggregate("half", F.lit(0), lambda s, x: s + x).cast("double")
    pairs = F.sequence(F.lit(1), F.size("v") - 1)
    turns = F.aggregate(F.transform(pairs, lambda i: (F.get("half", i) != F.get("half", i - 1)).cast("int")), F.lit(1), lambda s, x: s + x)
    rows = rows.withColumn("up", ups).withColumn("turns", turns.cast("double"))
    mix = 2 * F.col("up") * (F.col("n") - F.col("up"))
    mean = mix / F.col("n") + 1
    var = mix * (mix - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    rows = rows.withColumn("z_runs", F.when(var > 0, (F.col("turns") - mean) / F.sqrt(var)).otherwise(F.lit(99.0)))
    # Serial correlation of neighbouring values.
    mid = (F.col("a") + 1) / 2
    over = F.aggregate(F.transform(pairs, lambda i: (F.get("v", i) - mid) * (F.get("v", i - 1) - mid)), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("z_serial", over / (F.sqrt(F.col("n") - 1) * (F.col("a") * F.col("a") - 1) / 12))
    # Bounds on normal tails; the three tests share the level.
    upper = lambda z: F.when(z > 0, F.lit(0.5) * F.exp(-z * z / 2)).otherwise(F.lit(1.0))
    p_chi, p_runs, p_serial = upper(F.col("z_chi")), 2 * upper(F.abs("z_runs")), 2 * upper(F.abs("z_serial"))
    rows = rows.withColumn("p_random", F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)))
    low = "abcdefghijklmnopqrstuvwxyz"
    kinds = F.translate("run", low.upper() + low + "0123456789" + "+/_-", "0" * 26 + "1" * 26 + "2" * 10 + "3" * 4)
    rows = rows.withColumn("kinds", F.transform(F.split(kinds, ""), lambda k: k.cast("int")))
    chances = F.array(*(F.lit(math.log(x)) for row in FOLLOWS for x in row))
    steps = F.sequence(F.lit(1), F.size("kinds") - 1)
    moves = F.aggregate(steps, F.lit(math.log(1 / 4)), lambda s, i: s + F.get(chances, F.get("kinds", i - 1) * 4 + F.get("kinds", i)))
    share = [math.log(x / sum(LETTERS)) for x in LETTERS] + [math.log(1 / 10)] * 10 + [math.log(1 / 4)] * 4
    weights, signs = F.array(*map(F.lit, share)), F.lit(low + "0123456789+/_-")
    spelt = F.aggregate(F.split(F.lower("run"), ""), F.lit(0.0), lambda s, c: s + F.coalesce(F.get(weights, F.position(c, signs) - 1), F.lit(0.0)))
    rows = rows.withColumn("log_p", F.least(F.lit(0.0), moves + spelt + F.col("n") * F.log("a")))
    band = sum((F.when(F.col("n") >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    return rows.select("run", F.col("p_random"), "log_p", (F.col("enc") * 10 + band).alias("stratum"))


def _discoveries(tested: DataFrame, fdr: float, alpha: float) -> DataFrame:
    """Runs taken for random: Benjamini-Hochberg in each stratum of encoding and band of lengths, over binned p-values.

    A bin counts at its upper end, so binning never admits more; the table of bins is bounded.
    """
    binned = tested.withColumn("bin", F.floor(-F.col("log_p") * _BINS).cast("int")).withColumn("bin", F.least("bin", F.lit(700 * _BINS)))
    counts = binned.groupBy("stratum", "bin").agg(F.count("*").alias("k"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("k").over(down)).withColumn("m", F.sum("k").over(Window.partitionBy("stratum")))
    passed = ranked.where(F.exp(-F.col("bin") / F.lit(float(_BINS))) <= F.lit(fdr) * F.col("rank") / F.col("m"))
    cut = passed.groupBy("stratum").agg(F.min("bin").alias("cut"))
    return binned.join(F.broadcast(cut), "stratum").where((F.col("bin") >= F.col("cut")) & (F.col("p_random") >= alpha)).select("run")


def scan(
    docs: DataFrame, fdr: float = FDR, alpha: float = ALPHA, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Spans of secrets in each document: doc_id, base and random arrays of (s, e, kind, n).

    Base spans match the fixed patterns. Further runs of at least LEAST_RUN characters, not inside a
    base span, are spans of kind "random" if their inferred encoding's alphabet looks uniform, its
    halves turn as often as chance has it, and neighbours do not correlate, and if the hypothesis of
    ordinary text is rejected at a false-discovery rate kept within encodings and bands of like
    length. Distinct runs are tested once; a run in very many documents joins back by a splittable
    join. Matches become rows and their places are running sums of a document's lengths, so a text of
    very many matches takes time in proportion. Null text is empty; one row per document, repeated
    rows included, each with all spans of its id and text; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = [F.xxhash64(F.col(doc_id), body).alias("k1"), F.xxhash64(F.lit(1), F.col(doc_id), body).alias("k2")]
    found = F.array_compact(F.array(*(_found(body, *rule[:3]) for rule in BASE), _found(body, "random", _RUN, 0, run=True)))
    rows = durable(docs.select(F.col(doc_id).alias("doc_id"), *key, found.alias("found")))
    listed = rows.select("k1", "k2", F.explode("found").alias("x")).select("k1", "k2", "x.kind", "x.items")
    listed = listed.groupBy("k1", "k2", "kind").agg(F.first("items").alias("items"))  # repeated rows hold the same
    hits = listed.select("k1", "k2", "kind", F.posexplode("items").alias("i", "x"))
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("e", F.sum(F.col("x.gap") + F.col("x.size")).over(upto).cast("int"))
    hits = durable(hits.select("k1", "k2", "kind", (F.col("e") - F.col("x.size")).alias("s"), "e", "x.n", "x.run"))
    base = hits.where(sum((F.when(F.col("kind") == k, n).otherwise(0) for k, *_, n in BASE), F.lit(0)) <= F.col("n")).where("kind <> 'random'")
    runs = hits.where("kind = 'random'")
    tested = durable(_tests(runs.select("run").distinct()))
    added = runs.join(_discoveries(tested, fdr, alpha), "run")
    spans = base.drop("run").union(added.select("k1", "k2", "kind", "s", "e", "n"))
    # A base span that starts no later and ends no earlier holds the run.
    before = Window.partitionBy("k1", "k2").orderBy("s", F.col("kind") == "random").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.max(F.when(F.col("kind") != "random", F.col("e"))).over(before) >= F.col("e")
    spans = spans.withColumn("inside", F.coalesce(inside, F.lit(False))).where("kind <> 'random' or not inside")
    hit = F.struct("s", "e", "kind", "n")
    of = lambda x: F.collect_list(F.when(x, hit))
    spans = spans.groupBy("k1", "k2").agg(of(F.col("kind") != "random").alias("base"), of(F.col("kind") == "random").alias("random"))
    none = F.array().cast("array<struct<s:int,e:int,kind:string,n:int>>")
    out = rows.select("doc_id", "k1", "k2").join(spans, ["k1", "k2"], "left")
    return out.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("random", none).alias("random"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the digests of scan()'s rows."""
    count = lambda kind: F.size(F.filter("base", lambda h: h["kind"] == kind)).cast("long")
    order = tuple(k for k, *_ in BASE)
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in order),
        F.sha2(_digest(F.col("base"), order), 256).alias("base_sha256"),
        _digest(F.concat("base", "random"), (*order, "random")).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
