"""Terms at vocabulary size, and even samples, against brute force."""

import random
import time

from pyspark.sql import functions as F

from tallyframe.operators import evidence
from tallyframe.operators.evidence import Feature


def test_features_against_brute_force(spark):
    rng = random.Random(4)
    terms = ["a", "ab", "abab", "ba", "\U0001f600", "é", "", "c d", "zzz"]
    features = [Feature(f"any{i}", tuple(rng.sample(terms, 1 + i % 3)), False, ("x",)) for i in range(12)]
    features += [Feature(f"all{i}", tuple(rng.sample(terms, 2)), True, ("x",)) for i in range(8)]
    features += [Feature("either", ("ab", "é"), False, ("x", "y")), Feature("both in some", ("ab", "é"), True, ("x", "y")), Feature("none", (), False, ("x",))]
    rows = [(i, *(None if rng.random() < 0.1 else "".join(rng.choices(["a", "b", "c", " ", "d", "é", "\U0001f600"], k=rng.randrange(12))) for _ in range(2))) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, x string, y string").withColumn("g", F.col("k") % 3).withColumn("features", F.lit("clash"))

    def holds(f, row):
        texts = [row[1 if c == "x" else 2] for c in f.columns]
        seen = [any(t in text for text in texts if text is not None) for t in f.terms]
        return all(seen) if f.every else any(seen)

    marked = evidence.annotate(df, features, ["k", "g"])
    got = {r.k: r.features for r in marked.collect()}
    assert got == {row[0]: [i for i, f in enumerate(features) if holds(f, row)] for row in rows}
    rates = {(r.g, r.feature): (r.rows, r.n) for r in evidence.feature_rows(marked, features, ["g"]).collect()}
    assert rates == {(g, f.name): (sum(holds(f, r) for r in rows if r[0] % 3 == g), 100) for g in range(3) for f in features}
    assert evidence.feature_rows(evidence.annotate(df.limit(0), features, ["g"]), features, ["g"]).count() == 0


def test_a_thousand_terms_cost_about_what_ten_do():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    terms = sorted({word() for _ in range(1000)})
    texts = [" ".join(word() for _ in range(300)) for _ in range(1500)]

    def seconds(k):
        finder = evidence.Finder([Feature(t, (t,)) for t in terms[:k]])
        began = time.process_time()
        for text in texts:
            finder.find({"text": text})
        return time.process_time() - began

    seconds(10)
    assert seconds(1000) < 6 * seconds(10) + 0.5  # a pass per term would take a hundred times as long


def test_even_samples(spark):
    rows = [(g, i) for g, n in (("a", 7), ("b", 100), ("c", 1), ("d", 41)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    got = {}
    for r in evidence.even(evidence.placed(df, ["g"], "k"), 20).orderBy("g", "k").collect():
        got.setdefault(r.g, []).append(r.k)
    want = {g: [i for i in range(0, n, max(1, n // 20))][:20] for g, n in (("a", 7), ("b", 100), ("c", 1), ("d", 41))}
    assert got == want
