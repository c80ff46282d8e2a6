"""The pipeline's stages on the smallest tables and on awkward rows."""

import collections
import itertools
import re

import corpus_pipeline as P
import duckdb
from tallyframe.llm import language, queries, toxicity
from tallyframe.llm.common import durable
from tallyframe.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF).cache()
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= n
        n = docs.count()
    assert {"copies", "taken"} <= set(docs.columns)
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(queries.labelled(spark, SF))
    want = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < P.TOXIC}
    assert {r.doc_id for r in P.drop_toxic(spark, docs, SF).collect()} == want


def test_texts_go_to_workers_once_and_a_few_at_a_time(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(queries.labelled(spark, SF))
    for columns in (["text", "doc_id"], ["doc_id", "text", "lang"]):
        scored = toxicity.score(docs, model, keep=tuple(columns))
        assert "text_" not in scored._jdf.queryExecution().toString()
        assert {(r.doc_id, r.score) for r in scored.collect()} == {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    named = language.identify(docs, {}, keep=("text", "doc_id"))
    assert "text_" not in named._jdf.queryExecution().toString() and named.count() == docs.count()
    before = spark.conf.get(setting)
    try:
        for held, want in (("10000", P.BATCH), ("0", P.BATCH), ("200", 200)):
            spark.conf.set(setting, held)
            P.drop_toxic(spark, docs, SF)
            assert int(spark.conf.get(setting)) == want
    finally:
        spark.conf.set(setting, before)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def without_boilerplate(rows):
    total, pages = collections.Counter(r["source"] for r in rows), collections.Counter()
    for r in rows:
        pages.update({(r["source"], x.strip(" ")) for x in (r["text"] or "").split("\n") if x.strip(" ")} if r["text"] is not None else ())
    bad = {k for k, n in pages.items() if n >= 3 and n > 0.08 * total[k[0]]}
    for r in rows:
        if r["text"] is not None:
            r["text"] = "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in bad)
            r["n_chars"] = len(r["text"])
    return rows


def one_of_each_class(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", folded(r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) ** 2 >= 0.64 * len(sets[i]) * len(sets[j]) > 0:
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r["doc_id"], least.get(find(i), r["doc_id"]))
    return [r for r in rows if r["doc_id"] in set(least.values())]


def clean(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    windows = collections.defaultdict(set)
    for t in items:
        w = cut(t)
        n = min(13, len(w))
        windows[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for r in rows:
        w, hit = cut(r["text"]), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def test_stages_against_brute_force(spark):
    """Every stage but the classifier's training, over the whole of the smallest tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(queries.labelled(spark, SF))
    kept = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < P.TOXIC}
    rows = [r.asDict() for r in docs.collect() if r.doc_id in kept]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = [lambda x: x, without_boilerplate, one_of_each_class, lambda x: clean(x, items)]
    for (_, stage), step in zip(P.STAGES, steps, strict=False):
        docs = durable(stage(spark, docs, SF))
        rows = step(rows)
        assert sorted(docs.collect()) == sorted(docs.sparkSession.createDataFrame(rows, docs.schema).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {(i, t) for i, t in con.execute(f"SELECT doc_id, taken FROM ({ORACLES['op2']}) WHERE taken > 0").fetchall()}
    assert {(r.doc_id, r.taken) for r in P.mix_sources(spark, docs, SF).collect()} == want


def test_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size int"
    rows = [(1, None, None, None, None, 0.1, 1), (2, "", "en", "a", 0, 0.2, 2), (2, "", "en", "a", 0, 0.2, 2), (None, "x y z", "en", None, 5, 0.3, 3)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            if name != "mixing":
                assert out.columns == docs.columns
