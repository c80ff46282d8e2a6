"""Sources, sinks, raters and streams on small files."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import raters, sampling
from tallyframe.plans import provenance
from tallyframe.sources import readers, writers
from tallyframe.streaming import judgments as stream


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k,v\n1,"x\ny"\n2,"q""r"\n', encoding="utf-8")
    rows = readers.delimited(spark, f"file://{tmp_path}/a.csv", ["k", "v"])
    assert [(r.k, r.v) for r in rows.collect()] == [("1", "x\ny"), ("2", 'q"r')]
    assert readers.delimited(spark, f"file://{tmp_path}/none.csv", ["k"]).count() == 0
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.require(rows, ["k", "z"])
    assert readers.resolve(spark, f"file://{tmp_path}/a").endswith("/a.csv")
    assert readers.resolve(spark, f"file://{tmp_path}/b").endswith("/b_anon.csv")


def test_torn_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": 2\n\n{"k": 3}\n')
    good, torn = readers.json_lines(spark, f"file://{tmp_path}/a.jsonl", "k int")
    assert sorted(r.k for r in good.collect()) == [1, 3] and torn.count() == 1


def test_probabilities(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": ["a"], "noul": 0.1}\n{"key": ["a"], "noul": 0.9}\n{"key": ["a"], "noul": null}\n')
    assert [r.noul for r in readers.probabilities(spark, f"file://{tmp_path}/a.jsonl").collect()] == [0.9]


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<d><s id='1'> x<b>y</b>z </s><s id='2'/></d>")
    (tmp_path / "bad.xml").write_text("<d>")
    rows = readers.xml_sentences(spark, f"file://{tmp_path}/*.xml").orderBy("id").collect()
    assert [(r.id, r.text) for r in rows if r.error is None] == [("1", "xyz"), ("2", "")]
    assert [(r.id, r.text, r.file[-7:]) for r in rows if r.error] == [(None, None, "bad.xml")]


def test_pairs_and_answers(spark, tmp_path):
    for n in ("b_원문_1.xml", "b_번역문_1.xml", "c_원문_1.xml"):
        (tmp_path / n).write_text("x")
    assert [r.book for r in readers.file_pairs(spark, f"file://{tmp_path}", "_원문_", "_번역문_").collect()] == ["b"]
    (tmp_path / "r.md").write_text("# t\n## Answer\n yes\n---\nmeta")
    assert readers.markdown_answers(spark, f"file://{tmp_path}/r.md").first().answer == "yes"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = f"file://{tmp_path}/t"
    assert writers.append_new(df, path, ["k"]).count() == 2
    writers.append_new(df.union(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert writers.guarded(df, f"file://{tmp_path}/g", dry_run=True) == "dry run"
    assert writers.guarded(df, f"file://{tmp_path}/g") == "written" and writers.guarded(df, f"file://{tmp_path}/g") == "kept"
    writers.delimited(df, f"file://{tmp_path}/c", bom=True)
    assert readers.delimited(spark, f"file://{tmp_path}/c").columns == ["k", "v"]
    assert "| 1 | a |" in writers.markdown_table(df.orderBy("k")) and '"k": 1' in writers.pretty_json(df)
    doc = writers.evidence(df.withColumn("g", F.lit(1)), ["g"], "v", "k", 2).first()
    assert doc.document == "a\n\n[cut]" and doc.cut


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    found = provenance.manifest(spark, f"file://{tmp_path}", "*.txt")
    assert found.collect() == provenance.manifest(spark, f"file://{tmp_path}", "*.txt", whole=1).collect()
    expected = found.union(spark.createDataFrame([("b.txt", "0", 1)], "file string, sha256 string, bytes long"))
    states = provenance.verify(found, expected)
    assert {r.file: r.state for r in states.collect()} == {"a.txt": "ok", "b.txt": "missing"}
    with pytest.raises(ValueError, match="b.txt missing"):
        provenance.require(states)


def test_raters(spark, tmp_path):
    items = spark.createDataFrame([(i, "O" if i % 2 else "F", f"t{i}") for i in range(50)], "k int, arm string, text string")
    plan = raters.plan(items, "text", ["k"])
    assert plan.count() == 4 and plan.select("arm").distinct().count() == 2
    with pytest.raises(ValueError, match="budget"):
        raters.ask(plan, raters.mock_rater, 3)
    path = f"file://{tmp_path}/asked"
    writers.append(raters.ask(plan, raters.mock_rater, 4), path)
    got = raters.judgments(spark.read.parquet(path), ["k", "arm"])
    assert got.count() == 50 and got.where("judgment is null").count() == 0

    def failing(prompt):
        raise OSError("no rater")

    bad = raters.judgments(raters.ask(plan, failing, 4, tries=2, wait=0), ["k", "arm"])
    assert bad.where("judgment is null").count() == 50
    assert raters.resume(items, [bad], ["k", "arm"]).count() == 50 and raters.resume(items, [got], ["k", "arm"]).count() == 0


def test_stream(spark, tmp_path):
    src, out, ckpt = (f"file://{tmp_path}/{n}" for n in ("in", "out", "ckpt"))
    df = spark.createDataFrame([(1, True), (2, False)], "k int, judgment boolean")
    df.write.parquet(src)
    for _ in range(2):
        stream.append_stream(spark.readStream.schema(df.schema).parquet(src), out, ["k"], ckpt).awaitTermination()
        df.write.mode("append").parquet(src)
    assert spark.read.parquet(out).count() == 2


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a, b = (sorted(r.id for r in sampling.hashed(df.repartition(n), 20, ["id"], 1).collect()) for n in (2, 7))
    assert a == b and len(a) == 20


def test_joins(spark):
    from tallyframe.operators import joins

    df = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="no attributes for 2"):
        joins.strict(df, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"]).collect()
    books = spark.createDataFrame([("권8",), ("권7",), ("다른9",), (None,)], "b string")
    assert [r[0] for r in books.select(joins.out_of_scope("b", "권", 7)).collect()] == [True, False, False, False]
    refs = spark.createDataFrame([("a", ["x-b"]), ("a", ["x-a"]), ("b", None)], "own string, refs array<string>")
    assert [(r.own, r.refs) for r in joins.drop_foreign(refs, "refs", "own", ["a", "b"]).collect()] == [("a", ["x-a"]), ("b", None)]


def test_embed_and_fallback(spark):
    from tallyframe.operators import vectors

    df = spark.createDataFrame([(i, "x" * i) for i in range(450)], "k int, t string")
    got = vectors.embed(df, "k", "t", lambda texts: [[float(len(t)), float(len(texts) <= 200)] for t in texts])
    assert sorted((r.k, r.vector[0], r.vector[1]) for r in got.collect()) == [(i, float(i), 1.0) for i in range(450)]

    def broken(prompt):
        raise OSError

    assert raters.fallback(broken, raters.mock_rater)("Q\n1. a\n2. b") == "1. O\n2. X"


def test_places_in_order(spark):
    from tallyframe.operators.ordering import numbered

    rows = [(i, [None, "a", "b"][i % 3] if i > 40 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, g string").repartition(7)
    want, seen = {}, {}
    for k, g in rows:
        want[k] = seen.get(g, 0)
        seen[g] = want[k] + 1
    got = numbered(df, ["k"], ("g",), "ord")
    assert {r.k: r.ord for r in got.collect()} == want and got.columns == ["k", "g", "ord"]
    assert sorted(r.ord for r in numbered(df, ["k"], name="ord").collect()) == list(range(300))
    assert numbered(df.limit(0), ["k"], ("g",)).count() == 0


def test_budget_is_shared_with_retries(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "batch int, prompt string").repartition(3)

    def failing(prompt):
        raise OSError

    for budget, want in ((10, 10), (14, 14), (20, 20), (1000, 30)):
        asked = raters.ask(prompts, failing, budget, tries=3, wait=0)
        writers.append(asked, f"file://{tmp_path}/{budget}")
        done = spark.read.parquet(f"file://{tmp_path}/{budget}")
        assert done.agg(F.sum("calls")).first()[0] == want and done.where("status = 'ok'").count() == 0
        assert raters.usage(done, 0.5).first().cost == want / 2

    def refusing(prompt):
        raise raters.Refused

    assert raters.ask(prompts, refusing, 100, wait=0).agg(F.sum("calls")).first()[0] == 10


def test_embed_goes_on(spark):
    from tallyframe.operators import vectors

    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "k int, t string")
    done = df.where("k < 15").select("k")
    got = vectors.embed(df, "k", "t", lambda texts: [[1.0] for _ in texts], done=done)
    assert sorted(r.k for r in got.collect()) == list(range(15, 20))


def test_silhouette_against_brute_force(spark):
    import numpy as np

    from tallyframe.operators import clusters

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 1, (30, 3)) for c in (0, 3, 7)])
    kinds = np.repeat([0, 1, 2], 30)
    far = np.sqrt(((points[:, None] - points) ** 2).sum(2))
    want = []
    for i in range(90):
        inside = far[i][kinds == kinds[i]].sum() / 29
        near = min(far[i][kinds == c].mean() for c in range(3) if c != kinds[i])
        want.append((near - inside) / max(near, inside))
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(points, kinds)], "v array<double>, c int")
    assert abs(clusters.silhouette(df, "v", "c") - np.mean(want)) < 1e-9
    assert clusters.silhouette(df.where("c = 0"), "v", "c") is None
    part = clusters.silhouette(df.repartition(3), "v", "c", rows=20)  # a sample of rows, each against all rows
    assert abs(part - np.mean(want)) < 0.2 and part == clusters.silhouette(df, "v", "c", rows=20)


def test_shelves(spark):
    from tallyframe.functions import korean

    books = spark.createDataFrame([("논어집주",), ("당송팔대가문초 소식3",), ("자치통감강목5",), ("춘추좌씨전2",), ("다른 책",), (None,)], "b string")
    rows = books.select(korean.genre("b").alias("g"), korean.division("b").alias("d"), korean.shelf("b").alias("s")).collect()
    assert [r.g for r in rows] == ["經傳", "文集", "歷史書", "歷史書", "기타", "기타"]
    assert [r.d for r in rows] == ["경부(사서)", "집부", "사부", "경부(오경)", "기타", "기타"]
    assert [tuple(r.s) for r in rows[:3]] == [("경부", "사서", "논어집주"), ("집부", "당송팔대가문초", "소식"), ("사부", "편년체", "자치통감강목")]
    assert rows[4].s.title == "다른 책" and rows[4].s.kind == "미분류"
    marks = spark.createDataFrame([("어늘",), ("라",)], "m string").select(korean.dual_uses("m").alias("u")).collect()
    assert [r.u for r in marks] == [["객체_어늘", "반어"], None]


def test_small_reports_are_whole_or_refused(spark):
    df = spark.range(1001)
    with pytest.raises(ValueError, match="more than 1000"):
        writers.markdown_table(df)
    long = spark.createDataFrame([("g", i, "x" * 10) for i in range(100)], "g string, k int, v string")
    doc = writers.evidence(long, ["g"], "v", "k", 25).first()
    assert doc.document == "x" * 10 + "\n" + "x" * 10 + "\nxxx\n[cut]" and doc.cut


def test_pools_and_finished_files(spark, tmp_path):
    df = spark.range(10)
    with pytest.raises(ValueError, match="the pool has 10"):
        sampling.pooled(df, 11, ["id"], 1)
    assert sampling.pooled(df, 10, ["id"], 1).count() == 10
    (tmp_path / "a.md").write_text("x" * 300)
    (tmp_path / "b.md").write_text("x" * 10)
    wanted = spark.createDataFrame([("a.md",), ("b.md",), ("c.md",)], "file string")
    assert sorted(r.file for r in readers.unfinished(spark, wanted, f"file://{tmp_path}").collect()) == ["b.md", "c.md"]
    assert readers.unfinished(spark, wanted, f"file://{tmp_path}/none").count() == 3


def test_xml_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><book><title> T </title><by/></book></all>")
    (tmp_path / "b.xml").write_text("<all>")
    rows = readers.xml_record(spark, f"file://{tmp_path}/*.xml", "book", ["title", "by"]).orderBy("file").collect()
    assert (rows[0].title, rows[0].by, rows[0].error) == ("T", None, None) and rows[1].error


def test_xml_in_pieces(spark, tmp_path):
    """A file larger than `whole` is read in several tasks, with the same elements as in one."""
    body = "".join(f'<s id="{i}" t=">"> a{i} <b>mid {i}</b> tail<!-- x --> &amp; {"y" * (i % 90)}</s>\n<note/>' if i % 10 else f'<s id="{i}"/>' for i in range(6000))
    (tmp_path / "a.xml").write_text(f"<text><sent/>{body}</text>")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        pieces = readers.xml_sentences(spark, f"file://{tmp_path}/*.xml", whole=1000)
        assert pieces.rdd.getNumPartitions() > 3
        whole = readers.xml_sentences(spark, f"file://{tmp_path}/*.xml")
        one, other = ({(r.id, r.text, r.error) for r in df.collect()} for df in (pieces, whole))
        assert one == other and len(one) == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    (tmp_path / "b.xml").write_text("<all>" + "".join(f"<r><t>x{i}</t>{'<bad' if i == 5 else ''}</r>" for i in range(9)) + "</all>")
    rows = readers.xml_records(spark, f"file://{tmp_path}/b.xml", "r", ["t"], whole=10).collect()
    assert sorted(r.t for r in rows if r.error is None) == [f"x{i}" for i in range(9) if i != 5] and sum(r.error is not None for r in rows) == 1
    assert [r.error is not None for r in readers.xml_records(spark, f"file://{tmp_path}/b.xml", "r", ["t"]).collect()] == [True]


def test_frozen_copies(spark, tmp_path):
    from tallyframe.plans import provenance

    for name, body in (("a.csv", "h\n1\n2\n"), ("sub/b.csv", "h\n1"), ("sub/empty.csv", ""), ("big.csv", "x\n" * 5_000_000)):
        place = tmp_path / "run" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(body)
    target = f"file://{tmp_path}/frozen"
    got = {r.file: (r.bytes, r.rows) for r in provenance.freeze(spark, f"file://{tmp_path}/run", target).collect()}
    assert got == {"a.csv": (6, 2), "sub/b.csv": (3, 1), "sub/empty.csv": (0, -1), "big.csv": (10_000_000, 4_999_999)}
    assert {r.state for r in provenance.verify_frozen(spark, target).collect()} == {"ok"}
    assert not list((tmp_path / "frozen").rglob("*.half"))
    with pytest.raises(ValueError, match="in use"):
        provenance.freeze(spark, f"file://{tmp_path}/run", target)
    (tmp_path / "frozen/files/a.csv").write_text("h\n1\n3\n")  # damaged
    (tmp_path / "frozen/files/sub/b.csv").unlink()
    states = provenance.verify_frozen(spark, target)
    assert {r.file: r.state for r in states.collect()} == {"a.csv": "changed", "sub/b.csv": "missing", "sub/empty.csv": "ok", "big.csv": "ok"}
    with pytest.raises(ValueError, match="a.csv changed"):
        provenance.require(states)


def test_many_models_in_shared_passes(spark):
    import numpy as np

    from tallyframe.operators import clusters, vectors

    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, 0.6, (40, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 7, 0), (5, 5, 5))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)] + [(999, None)], "k int, v array<double>").repartition(5)
    rows = clusters._vectors(df, "v")
    first = {(k, i): clusters.starts(points, k, i) for k in (2, 3, 4, 5) for i in range(3)}

    def plain(c):
        while True:
            far = ((points[:, None] - c) ** 2).sum(2)
            near = far.argmin(1)
            moved = np.array([points[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
            if np.sqrt(((moved - c) ** 2).sum()) <= clusters.SETTLED:
                return c, far.min(1).sum()
            c = moved

    found = clusters.fit(rows, first)
    for name, c in first.items():
        centres, cost = plain(c)
        assert np.allclose(found[name][0], centres, atol=1e-6) and abs(found[name][1] - cost) < 1e-6
    best = clusters.search_k(df, "v", (2, 3, 4, 5, 6), tries=4).collect()
    assert best[0].k == 4 and len(best) == 5
    assert abs({r.k: r.cost for r in best}[4] - min(plain(clusters.starts(points, 4, s))[1] for s in range(60))) < 1e-3
    placed = vectors.cluster(df, "v", "k", 4, starts=4)
    assert abs(clusters.silhouette(placed.join(df, "k"), "v", "cluster") - best[0].silhouette) < 1e-6
    groups = [{r.k for r in placed.where(f"cluster = {c}").collect()} for c in range(4)]
    assert sorted(map(sorted, groups)) == [list(range(40 * i, 40 * i + 40)) for i in range(4)]


def test_models_are_compared_together_and_rows_dealt_evenly(spark, monkeypatch):
    """One product for all models, rows of one file over all cores, sums of many tasks added before the driver."""
    import numpy as np

    from tallyframe.operators import clusters

    rng = np.random.default_rng(8)
    points = rng.normal(size=(3000, 3))
    df = spark.createDataFrame([(v.tolist(),) for v in points], "v array<double>").coalesce(1)
    monkeypatch.setattr(clusters, "_FILE_ROWS", 300)
    every = clusters._dealt(df, "v")
    held = [r["count"] for r in every.groupBy("_metadata.file_path").count().collect()]
    assert len(held) == 2 * spark.sparkContext.defaultParallelism and max(held) - min(held) <= len(held)

    sizes = [2, 2, 3, 5]
    stack = rng.normal(size=(12, 3))
    near, far = clusters._nearest(points, sizes, stack)
    for m, (at, k) in enumerate(((0, 2), (2, 2), (4, 3), (7, 5))):
        squares = ((points[:, None] - stack[at : at + k]) ** 2).sum(2)
        assert (near[:, m] == at + squares.argmin(1)).all() and np.allclose(far[:, m], squares.min(1))

    first = {k: np.vstack([points[:k], [[99.0] * 3]]) for k in (4, 2)}  # a centre without rows stays
    want = clusters.fit(every, first, passes=3)
    monkeypatch.setattr(clusters, "_PARTS", 2)
    got = clusters.fit(every.repartition(9), first, passes=3)
    for k in first:
        assert np.allclose(want[k][0], got[k][0]) and abs(want[k][1] - got[k][1]) < 1e-6 and (got[k][0][-1] == 99).all()


def test_tables_are_deleted_on_demand(spark, monkeypatch, tmp_path):
    from tallyframe import storage

    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    assert storage.durable(spark.range(5)).count() == 5 and list(tmp_path.rglob("*.parquet"))
    (tmp_path / "tables/other-application").mkdir()
    assert storage.clear(spark) and not list(tmp_path.rglob("*.parquet")) and (tmp_path / "tables/other-application").exists()
    assert not storage.clear(spark)


def test_large_documents_are_parsed_without_a_tree(spark, tmp_path):
    """Same rows as from a tree, nested elements and broken ends included, in a tenth of its memory at most."""
    import tracemalloc
    import xml.etree.ElementTree as ET

    nested = "<t a='1'>x<s id='1'>a<b>b</b><s id='2'>c</s>d</s>tail<p><s id='3'/>y</p><s id='4'>é &amp; z</s></t>".encode()
    assert [(e.get("id"), "".join(e.itertext())) for e in readers._each(nested, "s")] == [("1", "abcd"), ("2", "c"), ("3", ""), ("4", "é & z")]
    assert [e.get("a") for e in readers._each(nested, "t")] == ["1"]
    for broken in (b"", b"<t><s>a</t>", b"<t><s>a</s>", b"<t>&no;</t>", b"<t/><t/>", nested[:-1]):
        for parse in (readers._check, ET.fromstring):
            with pytest.raises(ET.ParseError) as error:
                parse(broken)
            seen = str(error.value) if parse is readers._check else seen
        assert str(error.value) == seen
    large = b"<t>" + b"".join(b"<s id='%d'>text %d</s>" % (i, i) for i in range(50_000)) + b"</t>"
    peaks = []
    for read in (lambda: readers._check(large) or readers._each(large, "s"), lambda: ET.fromstring(large).iter("s")):
        tracemalloc.start()
        assert sum(int(e.get("id")) for e in read()) == sum(range(50_000))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[0] < 0.1 * peaks[1]
    (tmp_path / "a.xml").write_bytes(large)
    assert readers.xml_sentences(spark, f"file://{tmp_path}/*.xml").selectExpr("count(distinct id)", "count(error)").first()[:] == (50_000, 0)


def test_keys_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    from tallyframe.operators import judgments

    monkeypatch.setattr(judgments, "TASK_ROWS", 100)
    rows = spark.range(1000).selectExpr("if(id % 10 = 0, null, id) as a", "if(id % 3 = 0, null, 'x') as b", "id")
    path = f"file://{tmp_path}/t"
    writers.append_new(rows.where("id < 400"), path, ["a", "b"])
    assert writers.append_new(rows, path, ["a", "b"]).rdd.getNumPartitions() == 11
    got = sorted(r.id for r in spark.read.parquet(path).collect())
    assert got == [i for i in range(1000) if i < 400 or i % 10]
