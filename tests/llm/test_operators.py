"""Operators on small tables with nulls, ties, repeats and clashing names, against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import connect, differences, spark_rows, sql_rows
from tallyframe.llm import (
    common,
    decontaminate,
    language,
    line_dedup,
    mixing,
    nearest,
    passages,
    queries,
    secrets,
    simhash,
    token_counts,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], schema)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    got = spark_rows(queries.queries()[name](spark, SF))
    assert not differences(got, sql_rows(connect(SF), queries.oracle_sql()[name]))


# --- components --------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    pairs += [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: SimHash --------------------------------------------------------------------------------


def slow_print(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(spark, monkeypatch):
    rng = random.Random(2)
    base = words(rng, 400)
    texts = [None, "", " \t\n", "One", "one", "one TWO\x0bthree\xa0four", " ".join(base), " ".join(base).upper()]
    for _ in range(60):
        w = list(base)
        w[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(words(rng, 50)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "One"), (None, "one")]
    prints = {t: slow_print(t) for t in texts}
    known = {}
    for i, t in rows:
        known.setdefault(prints[t], []).append(i)
    group = {p: p for p in known}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(known, 2):
        if bin(a ^ b).count("1") <= 2:
            group[find(a)] = find(b)
    least = {}
    for p, ids in known.items():
        least[find(p)] = min([least.get(find(p), math.inf), *(i for i in ids if i is not None)])
    want = sorted((str(i), f"{prints[t]:016x}", least[find(prints[t])]) for i, t in rows)
    for crowd in (64, 2):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = simhash.classes(docs(spark, rows).withColumn("fingerprint", F.lit(1)).repartition(3))
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash.classes(docs(spark, [])).count() == 0


def test_simhash_long_text():
    text = " ".join(words(random.Random(3), 70_000))
    h = simhash.shingle_hashes(text, 3)
    assert simhash.fingerprint(h) & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(4)
    rows, group = [], {}
    for g in range(12):
        base = words(rng, 150, 5000)
        for c in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            if c == 0:
                w = list(base)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    rows += [(900, None), (901, ""), (902, " "), (rows[0][0], rows[0][1]), (None, rows[1][1])]
    got = simhash.drop_near_duplicates(docs(spark, rows).withColumn("node", F.lit("x")).repartition(4))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "node"]
    kept = sorted((r.doc_id for r in got.collect()), key=str)
    want = sorted([min(i for i, g in group.items() if g == k) for k in range(12)] + [900], key=str)
    assert kept == want
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def similar(a, b):
    return len(a & b) ** 2 >= 0.64 * len(a) * len(b)


def links_of(spark, texts):
    """Links of similar_texts between texts by place, and the sets of their shingles."""
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    rows = [(i, len(s), simhash.fingerprint(s), list({*simhash.wide_blocks(s), *simhash.small_keys(s)})) for i, s in enumerate(sets)]
    known = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "node long, shingles array<long>").cache()
    table = spark.createDataFrame(rows, "node long, n long, print long, blocks array<long>")
    got = simhash.similar_texts(table, lambda wanted: known.join(wanted, "node", "left_semi"))
    return {(r.a, r.b) for r in got.collect()}, [set(s.tolist()) for s in sets]


def test_near_duplicate_links_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(15):
        base = words(rng, 120, 3000)
        for e in (0, 1, 2, 3, 4, 6):
            w = list(base)
            for _ in range(e):
                w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    got, sets = links_of(spark, texts)
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(sets[a], sets[b])}
    assert got <= want and len(got) >= 0.99 * len(want) > 30


def test_near_duplicates_of_few_shingles(spark):
    rng = random.Random(22)
    texts = []
    for k in range(200):
        base = words(rng, 8 + k % 5, 10**6)
        texts += [" ".join(base), " ".join([*base, "added"] if k % 2 else ["added", *base])]
    got, _ = links_of(spark, texts)
    assert got == {(2 * k, 2 * k + 1) for k in range(200)}


def test_twins_in_a_crowd_on_one_template(spark):
    """Texts just too unlike each other, with twins among them: all twins, and nothing else, are linked."""
    rng = random.Random(27)
    template = words(rng, 300, 10**6)
    texts, want = [], set()
    for k in range(240):
        own = words(rng, 120, 10**6)
        texts.append(" ".join(template + own))
        if k % 3 == 0:
            want.add((len(texts) - 1, len(texts)))
            texts.append(" ".join(template + own[:60] + words(rng, 60, 10**6)))
    got, sets = links_of(spark, texts)
    assert want == {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(sets[a], sets[b])}
    assert got == want


def test_crowd_of_near_copies_is_one_class(spark):
    """Copies of two templates with changes: every copy that brute force links is linked, most of them to one leader."""
    rng = random.Random(28)
    texts = []
    for _ in range(2):
        base = words(rng, 200, 10**6)
        for k in range(150):
            changed = set(rng.sample(range(200), k % 12))
            texts.append(" ".join(f"y{rng.randrange(10**6)}" if i in changed else w for i, w in enumerate(base)))
    got, sets = links_of(spark, texts)
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(sets[a], sets[b])}
    assert got <= want and {x for p in want for x in p} == {x for p in got for x in p} and len(got) < len(want) / 4


def test_texts_that_follow_different_leaders_are_one_class(spark, monkeypatch):
    """Two crowds, and a text beside each: the two texts are similar to each other, and only they connect the crowds."""
    rng = random.Random(50)
    line = [rng.getrandbits(64) for _ in range(450)]
    sets = [line[:300]] * 14 + [line[150:]] * 14
    # Others make the outer ends of the line common, so that the crowds come first in every block that the two texts share.
    sets += [part + [rng.getrandbits(64) for _ in range(300)] for part in (line[:50], line[400:]) for _ in range(30)]
    sets += [line[50:350], line[100:400]]
    sets = [np.array(sorted(s), np.uint64) for s in sets]
    rows = [(i, len(s), simhash.fingerprint(s), s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "node long, n long, print long, shingles array<long>").cache()
    monkeypatch.setattr(simhash, "CELL", 7)
    got = {(r.a, r.b) for r in simhash.crowd_links(table).collect()}
    reached = {0}
    while more := {y for p in got if reached & {*p} for y in p} - reached:
        reached |= more
    assert all(similar({*rows[a][3]}, {*rows[b][3]}) for a, b in got) and (88, 89) in got
    assert reached == {*range(28), 88, 89}


def classes_of(n, pairs):
    """The least number that each of n numbers is connected with."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def table_of(spark, sets):
    sets = [np.array(sorted(s), np.uint64) for s in sets]
    rows = [(i, len(s), simhash.fingerprint(s), s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "node long, n long, print long, shingles array<long>").cache()


def test_crowds_of_many_sizes_lose_no_link(spark, monkeypatch):
    """Sets of 60 to 200 shingles around three that overlap, many just within or beyond the least similarity."""
    rng = random.Random(61)
    line = [rng.getrandbits(64) for _ in range(320)]
    sets = []
    for k in range(240):
        base = line[60 * (k % 3) : 60 * (k % 3) + rng.choice((70, 100, 130, 170, 200))]
        kept = rng.sample(base, int(len(base) * rng.uniform(0.7, 1)))
        sets.append(set(kept) | {rng.getrandbits(64) for _ in range(rng.randrange(0, 30))})
    want = {(a, b) for a, b in itertools.combinations(range(240), 2) if similar(sets[a], sets[b])}
    table = table_of(spark, sets)
    for paired, cell in ((2, 5), (12, 256)):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        monkeypatch.setattr(simhash, "CELL", cell)
        got = {(r.a, r.b) for r in simhash.crowd_links(table).collect()}
        assert got <= want and classes_of(240, got) == classes_of(240, want)
    assert 3 < len({*classes_of(240, want)}) < 200


def test_a_crowd_with_unlike_texts_beside_it_is_not_copied(spark, monkeypatch):
    """Near copies of one template, of which a fifth has too much of its own: rows compared grow no faster than the crowd."""
    rng = random.Random(62)
    line = [rng.getrandbits(64) for _ in range(146)]
    sets = []
    for k in range(400):
        own = rng.randrange(36, 46) if k % 5 == 0 else rng.randrange(0, 20)
        at = rng.randrange(146 - own)
        sets.append({*line[:at], *line[at + own :], *(rng.getrandbits(64) for _ in range(own))})
    want = {(a, b) for a, b in itertools.combinations(range(400), 2) if similar(sets[a], sets[b])}
    met, compared = simhash._met, []

    def counted(left, right=None, apart=False):
        if apart:
            compared.append((left.count(), right.count()))
        return met(left, right, apart)

    monkeypatch.setattr(simhash, "_met", counted)
    monkeypatch.setattr(simhash, "CELL", 16)
    table = table_of(spark, sets)
    got = {(r.a, r.b) for r in simhash.crowd_links(table).collect()}
    assert got <= want and classes_of(400, got) == classes_of(400, want)
    held = table.selectExpr("explode(shingles) s").groupBy("s").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert all(right <= held / 10 for _, right in compared), (compared, held)


# --- 2: mixing ---------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(6)
    rows = []
    for source, n in (("a", 300), ("b", 20), (None, 60), ("é", 100), ("Z", 0)):
        for _ in range(n):
            rows.append((len(rows), " ".join(["x"] * rng.randrange(1, 30)), "en", source, 1))
    rows += [(5000, None, "en", "a", 1), (5001, "", "en", "a", 1), rows[0], (None, "one two", "en", "b", 1)]
    got = mixing.mix(docs(spark, rows).withColumn("size", F.lit("clash")).repartition(5)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by[r.source_size, r.target] += r.taken
    total = sum(r.size for r in got)
    assert math.isclose(sum(t for _, t in by), total, rel_tol=1e-9) and all(abs(v - t) <= 60 for (_, t), v in by.items())
    again = mixing.mix(docs(spark, rows).repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    carried = mixing.mix(docs(spark, rows).withColumn("size", F.lit("clash")), carry=True)
    assert {"in_size", "copies", "text"} <= set(carried.columns)
    assert sum(r.taken for r in carried.collect()) == sum(r.taken for r in got)
    for empty in ([], [(1, None), (2, "")]):
        assert [r.taken for r in mixing.mix(docs(spark, empty)).collect()] == [0] * len(empty)


# --- 3: line dedup -----------------------------------------------------------------------------


def test_line_dedup(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        host = ["a", "b", None][i % 3]
        body = [f"line {rng.randrange(10**6)}" for _ in range(4)]
        if i % 2:
            body.insert(1, "  menu ")
        if i % 60 == 0:
            body += ["rare", ""]
        rows.append((i, "\n".join(body), "en", host, 1))
    rows += [(500, None, "en", "a", 1), (501, "", "en", "a", 1), (502, "menu\nmenu", "en", "a", 1), rows[1], (None, "menu\nown", "en", "b", 1)]
    df = docs(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = line_dedup.drop_lines(df.repartition(3))
    assert got.columns == [*df.columns, "n_lines_", "n_dropped"]
    total, pages = collections.Counter(), collections.Counter()
    for r in rows:
        total[r[3]] += 1
        pages.update({(r[3], x.strip(" ")) for x in (r[1] or "").split("\n") if x.strip(" ")} if r[1] is not None else set())
    bad = {k for k, n in pages.items() if n >= line_dedup.LEAST and n > line_dedup.RATIO * total[k[0]]}
    clean = lambda r: None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(" ")) not in bad)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(r[0]), str(clean(r))) for r in rows)
    assert bad and line_dedup.drop_lines(docs(spark, [])).count() == 0
    blank = [(i, "menu\r\n\r\nbody %d\r\n\t\nend\n\x0b" % i, "en", "a", 1) for i in range(40)]
    kept = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(docs(spark, blank)).collect()}
    assert kept == {i: (f"\r\nbody {i}\r\n\t\n\x0b", 6, 2) for i in range(40)}


def test_line_dedup_of_very_long_pages(spark):
    """Two pages of 100,000 lines each, most of them boilerplate, take time in proportion to their lines."""
    long_ = "\n".join(f"line {i}" for i in range(100_000))
    rows = [(i, long_, "en", "a", 1) for i in range(3)] + [(3, "own\n" + long_ + "\nlast", "en", "a", 1)]
    began = time.time()
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_lines(docs(spark, rows)).collect()}
    assert got == {**{i: ("", 100_000) for i in range(3)}, 3: ("own\nlast", 100_000)} and time.time() - began < 60


def test_columns_with_dots(spark):
    rows = [(i, f"word{i % 3} and more\nmenu", "en", "a", 1) for i in range(20)]
    df = docs(spark, rows).withColumn("x.y", F.col("doc_id")).withColumn("a`b", F.lit("z"))
    bench = spark.createDataFrame([(1, "word1 and more")], "item_id long, text string")
    results = [line_dedup.drop_lines(df), mixing.mix(df, carry=True), decontaminate.contamination(df, bench), decontaminate.drop_contaminated(df, bench), simhash.drop_near_duplicates(df)]
    for got in results:
        taken = got.collect()
        assert taken and all(r["x.y"] == r["doc_id"] and r["a`b"] == "z" for r in taken)


# --- 4: passages -------------------------------------------------------------------------------


def test_chains_are_optimal():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randrange(1, 40)
        i, j = rng.sample(range(300), n), rng.sample(range(300), n)
        order = sorted(range(n), key=lambda m: i[m])
        best = {}
        for m in order:
            before = [best[p] - passages.GAP * (i[m] - i[p] + j[m] - j[p]) for p in best if i[p] < i[m] and j[p] < j[m]]
            best[m] = passages.K + max([0.0, *before])
        first = passages.chains(np.array(i), np.array(j))[0]
        gaps = sum(b[0] - a[0] + b[1] - a[1] for a, b in itertools.pairwise(first))
        assert math.isclose(passages.K * len(first) - passages.GAP * gaps, max(best.values()))
        assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(first))


def test_ascending_matches_chain_as_others_do():
    rng = random.Random(29)
    for k in range(60):
        i = np.cumsum([rng.choice((1, 2, 5, 40, 90)) for _ in range(rng.randrange(1, 60))])
        j = np.cumsum([rng.choice((1, 2, 5, 40, 90)) for _ in i])
        mixed = rng.sample(range(len(i)), len(i))
        fast = passages.chains(i[mixed], j[mixed])
        # One more match far off, in the other direction, takes the general way and stands alone.
        general = passages.chains(np.append(i + 10, 5), np.append(j, 10**6))
        assert fast == [[(a - 10, b) for a, b in c] for c in general if c != [(5, 10**6)]], k


def test_ends_of_a_passage_against_word_by_word_sums():
    rng = random.Random(31)
    for n in (0, 1, 5, 255, 256, 257, 700):
        for share in (0.0, 0.1, 0.3, 1.0):
            a = np.array([rng.randrange(9) for _ in range(n)], np.uint16)
            b = np.where([rng.random() < share for _ in range(n)], a + 9, a).astype(np.uint16)
            best = score = taken = 0
            for at, (x, y) in enumerate(zip(a, b, strict=True)):
                score += 1 if x == y else -2
                if score > best:
                    best, taken = score, at + 1
                if best - score > passages.DROP:
                    break
            assert passages._extend(a, b) == (taken, int((a[:taken] == b[:taken]).sum()))


def test_a_text_of_many_pairs_is_seeded_once_a_task(monkeypatch):
    import pyarrow as pa

    rng, seen, real = random.Random(37), [], passages.seeds
    monkeypatch.setattr(passages, "seeds", lambda codes: seen.append(1) or real(codes))
    texts = [passages.encode(" ".join(words(rng, 80, 10**6)), passages._Codes()).tobytes() for _ in range(20)]
    pairs = [(p % 20, 19 - p % 20) for p in range(900)]
    columns = [[p for p, _ in pairs], [q for _, q in pairs], [texts[p] for p, _ in pairs], [texts[q] for _, q in pairs]]
    list(passages._compared(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "x", "y"])])))
    assert len(seen) == 20
    h = real(np.frombuffer(texts[0], np.uint16))
    codes = np.frombuffer(texts[0], np.uint16)
    every = passages.grams(codes, passages.K)
    least = {k + int(every[k : k + passages.DENSE].argmin()) for k in range(len(every) - passages.DENSE + 1)}
    assert set(h[1].tolist()) == least and (every[h[1]].view(np.int64) == h[0]).all()
    monkeypatch.setattr(passages, "HORNER", 9)
    fast = passages.grams(codes, 9)
    monkeypatch.setattr(passages, "HORNER", 1)
    assert fast.tolist() == passages.grams(codes, 9).tolist()


def test_passages(spark):
    rng = random.Random(9)
    fresh = lambda n: words(rng, n, 10**6)
    shared, other = fresh(70), fresh(40)
    fuzzy = list(shared)
    for k in (13, 30, 47):
        fuzzy[k] = "changed"
    del fuzzy[60]
    texts = {i: fresh(120) for i in range(20)}
    texts[1][30:30] = shared
    texts[2][90:90] = fuzzy
    texts[3][10:10] = [w.upper() for w in shared]
    texts[4][10:10] = other
    texts[5][10:10] = other
    texts[7] = list(texts[6])
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(50, None), (51, ""), (52, " ".join(shared[:20])), (53, " ".join(shared[:20])), (7, " ".join(texts[7]))]
    got = passages.repeated_passages(docs(spark, rows).withColumn("node", F.lit(1)).repartition(3)).collect()
    assert {x for r in got for x in (r.doc_id, r.other_id)} == {1, 2, 3, 6, 7}
    links = {frozenset((r.doc_id, r.other_id)) for r in got}
    assert frozenset((6, 7)) in links and len({1, 2, 3} & set().union(*(p for p in links if not p & {6, 7}))) == 3
    for r in got:
        if {r.doc_id, r.other_id} <= {1, 2, 3}:
            assert r.end_word - r.first_word >= 58 and r.equal_words >= 55
    assert passages.repeated_passages(docs(spark, [])).count() == 0


def test_passages_that_no_text_holds_first_as_a_whole(spark):
    """Many small corpora in one: parts of a passage in texts of their own, the whole in two to thirty more."""
    rng = random.Random(10)
    rows, want = [], set()
    for case in range(60):
        n = rng.choice((51, 60, 90))
        p = words(rng, n, 10**6)
        cut = sorted(rng.sample(range(n), 3))
        parts = [p[: cut[1]][-49:], p[cut[0] :][:49], p[cut[1] :][:30], p[: cut[2]][:40]]
        whole = [p] * (2 if case % 4 else 30)
        for part in parts + whole:
            body = words(rng, 60, 10**6)
            rows.append((len(rows), " ".join(body[:30] + part + body[30:])))
            if part is p:
                want.add(len(rows) - 1)
    got = passages.repeated_passages(docs(spark, rows).repartition(5)).collect()
    assert want == {x for r in got for x in (r.doc_id, r.other_id)}


def test_no_shared_run_is_left_out(spark):
    """Texts made of popular paragraphs, all orders and overlaps: brute force over runs of LEAST + 1 words."""
    rng = random.Random(24)
    stock = [words(rng, rng.randrange(20, 80), 10**6) for _ in range(12)]
    rows = [(i, " ".join(w for _ in range(4) for w in (rng.choice(stock) if rng.random() < 0.6 else words(rng, 25, 10**6)))) for i in range(150)]
    holders = collections.defaultdict(set)
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 50):
            holders[tuple(w[k : k + 51])].add(i)
    want = {i for s in holders.values() if len(s) > 1 for i in s}
    got = passages.repeated_passages(docs(spark, rows).repartition(4)).collect()
    joined = collections.defaultdict(set)
    for r in got:
        joined[r.doc_id].add(r.other_id)
        joined[r.other_id].add(r.doc_id)
    assert want <= set(joined)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            todo += [y for y in joined[todo.pop()] if y not in seen and not seen.add(y)]
        return seen

    assert all(s <= reach(min(s)) for s in holders.values() if len(s) > 1)


def test_halves_that_are_too_short_alone_make_a_passage():
    """45 equal words, up to 22 others in one or both texts, 45 equal words: at least 80 % of them are equal."""
    rng = random.Random(45)
    for trial in range(60):
        gap = 8 + trial % 15
        first, last, mid = words(rng, 45, 10**6), words(rng, 45, 10**6), words(rng, gap, 10**6)
        other = [[], words(rng, gap, 10**6)][trial % 2]
        around = [words(rng, 120, 10**6) for _ in range(4)]
        codes = passages._Codes()
        a = passages.encode(" ".join(around[0] + first + mid + last + around[1]), codes)
        b = passages.encode(" ".join(around[2] + first + other + last + around[3]), codes)
        found = passages.passages(a, b)
        assert any(s <= 122 and e >= 208 + gap for s, e, *_ in found), (trial, gap, found)
        assert all(n >= passages.EQUAL * max(e - s, f - t) for s, e, t, f, n in found)
    a = passages.encode(" ".join(words(rng, 20, 10**6) + first[:30] + words(rng, 60, 10**6) + last[:30]), codes)
    assert not passages.passages(a, passages.encode(" ".join(first[:30] + last[:30]), codes))


def test_every_place_of_a_passage_is_found():
    rng = random.Random(46)
    for n_a, n_b in ((3, 1), (1, 4), (3, 3), (6, 2)):
        shared, codes = words(rng, 60, 10**6), passages._Codes()
        texts, places = [], []
        for n in (n_a, n_b):
            text, own = [], []
            for _ in range(n):
                text += words(rng, rng.randrange(40, 90), 10**6)
                own.append(len(text))
                text += shared
            texts.append(passages.encode(" ".join(text + words(rng, 30, 10**6)), codes))
            places.append(own)
        found = passages.passages(*texts)
        for at in places[0]:
            assert any(s <= at and e >= at + 60 for s, e, *_ in found)
        for at in places[1]:
            assert any(t <= at and f >= at + 60 for _, _, t, f, _ in found)


def test_a_crowd_is_one_class(spark):
    """Of 40 fuzzy copies of a passage each has a row with some other, and all have one class and no other text has it."""
    rng = random.Random(47)
    rows = []
    for c in range(3):
        shared = words(rng, 60, 10**6)
        for k in range(40):
            w = list(shared)
            for i in rng.sample(range(60), 4):
                w[i] = f"x{rng.randrange(10**6)}"
            rows.append((100 * c + k, " ".join(words(rng, 80, 10**6) + w + words(rng, 80, 10**6))))
    rows += [(1000, rows[7][1]), (1001, " ".join(words(rng, 90, 10**6)))] * 2
    classes = collections.defaultdict(set)
    for r in passages.repeated_passages(docs(spark, rows).repartition(4)).collect():
        classes[r.doc_id].add(r.class_id)
        classes[r.other_id].add(r.class_id)
    assert all(len(x) == 1 for x in classes.values())
    assert {i: min(x) for i, x in classes.items()} == {**{100 * c + k: 100 * c for c in range(3) for k in range(40)}, 1000: 0}


def test_every_document_of_a_passage_has_rows_of_its_own(spark):
    rng = random.Random(48)
    p = words(rng, 60, 10**6)
    rows = [(i, " ".join(words(rng, 30 + 20 * i, 10**6) + p * (i % 5 != 4) + words(rng, 40, 10**6))) for i in range(10)]
    got = passages.repeated_passages(docs(spark, [*rows, (11, rows[4][1])]).repartition(3)).collect()
    assert {r.doc_id for r in got} == {r.other_id for r in got} == {0, 1, 2, 3, 4, 5, 6, 7, 8, 11}
    sides = {(r.doc_id, r.other_id, r.first_word, r.end_word, r.other_first, r.other_end, r.equal_words, r.class_id) for r in got}
    assert sides == {(b, a, t, f, s, e, n, c) for a, b, s, e, t, f, n, c in sides} and len(sides) == len(got)
    assert all(s <= 30 + 20 * i and e >= 90 + 20 * i for i, _, s, e, *_ in sides if i not in (4, 11))


def test_the_exact_way_compares_all_texts_of_crowded_seeds(spark, monkeypatch):
    """Pairs of twins that share a phrase with a crowd: every seed of a twin's passage is crowded, none in a row."""
    rng = random.Random(49)
    stock = [words(rng, 8, 10**6) for _ in range(60)]
    rows = []
    for k in range(40):
        part = [w for s in rng.sample(stock, 7) for w in [*s, f"x{rng.randrange(10**6)}"]]
        for _ in range(2):
            own = [f"y{rng.randrange(10**6)}" if w[0] == "x" else w for w in part]
            rows.append((len(rows), " ".join(words(rng, 60, 10**6) + own + words(rng, 60, 10**6))))
    rows += [(1000 + i, " ".join(w for s in rng.sample(stock, 20) for w in [*s, *words(rng, 30, 10**6)])) for i in range(60)]
    of = lambda exact: {(r.doc_id, r.other_id) for r in passages.repeated_passages(docs(spark, rows).repartition(4), exact=exact).collect()}
    want = {(i, i ^ 1) for i in range(80)}
    monkeypatch.setattr(passages, "CELL", 5)
    assert len(want & of(True)) >= 0.97 * len(want)


def test_a_chain_is_split_where_a_gap_is_too_wide():
    rng = random.Random(25)
    for left, gap, right in ((3500, 2000, 3500), (60, 40, 60), (400, 100, 55), (70, 15, 70)):
        first, last = words(rng, left, 10**6), words(rng, right, 10**6)
        codes = passages._Codes()
        a, b = (passages.encode(" ".join(first + words(rng, gap, 10**6) + last), codes) for _ in range(2))
        found = sorted(passages.passages(a, b))
        assert found[0][0] == 0 and found[-1][1] == left + gap + right
        assert sum(r[4] for r in found) >= left + right and (gap <= passages.BRIDGE or len(found) == 2)


def test_fuzzy_copies_in_a_crowd(spark):
    """Copies of a passage with a tenth of its words changed, among texts with whole parts of it."""
    rng = random.Random(26)
    rows, want = [], set()
    for size in (6, 40, 120):
        p = words(rng, 70, 10**6)
        for k in range(size):
            q = [f"x{rng.randrange(10**6)}" if rng.random() < 0.1 else w for w in p]
            want.add(len(rows))
            rows.append((len(rows), " ".join(words(rng, 50, 10**6) + q + words(rng, 50, 10**6))))
            if k % 4 == 0:
                rows.append((len(rows), " ".join(words(rng, 50, 10**6) + p[20:45] + words(rng, 50, 10**6))))
    got = passages.repeated_passages(docs(spark, rows).repartition(4)).collect()
    found = {x for r in got for x in (r.doc_id, r.other_id)}
    assert found <= want and len(found) >= 0.97 * len(want)


def test_fuzzy_passages_at_the_least_share(spark):
    rng = random.Random(21)
    rows, want = [], set()
    for n, share in ((50, 0.8), (55, 0.82), (55, 0.85), (55, 0.9), (80, 0.85), (100, 0.82)):
        for _ in range(25):
            p = words(rng, n, 10**6)
            q = list(p)
            for k in rng.sample(range(1, n - 1), int(n * (1 - share) + 1e-9)):
                q[k] = f"x{rng.randrange(10**6)}"
            want.add((len(rows), len(rows) + 1))
            rows += [(len(rows) + k, " ".join(words(rng, 200, 10**6) + part + words(rng, 200, 10**6))) for k, part in enumerate((p, q))]
    got = passages.repeated_passages(docs(spark, rows)).collect()
    found = {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in got}
    assert found <= want and len(found) >= 0.97 * len(want)
    assert all(r.equal_words >= 0.8 * (r.end_word - r.first_word) and r.end_word - r.first_word >= 50 for r in got)


# --- 5: language -------------------------------------------------------------------------------


def test_language(spark):
    parts = {"xx": ["ka", "mo", "ri", "tu"], "yy": ["sch", "ein", "ung", "tz"], "zz": ["é", "que", "oi", "ment"]}
    rng = random.Random(11)
    rows = []
    for i in range(180):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(60)), lang, "s", 1))
    train, held = docs(spark, rows[:120]), rows[120:]
    content = language.dictionaries(train)
    assert set(content) == set(parts) and all(len(v) <= language.DICTIONARY for v in content.values())
    extra = [(900, None), (901, ""), (902, "12 34 !"), (903, " ".join("".join(rng.choices(parts["xx"], k=3)) for _ in range(9000)))]
    got = {r.doc_id: r for r in language.identify(docs(spark, held + extra).withColumn("text_", F.lit(1)), content).collect()}
    assert all(got[r[0]].lang_pred == r[2] and 0 <= got[r[0]].score <= 1 for r in held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    none = language.identify(docs(spark, held), language.dictionaries(docs(spark, [])))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_language_against_plain_compression(spark):
    """The whole of sf0.001: every text's choice and score by compressing it piece by piece with each dictionary."""
    import zstandard

    table = spark.read.parquet(f"{SF}/documents.parquet")
    learn = table.where((F.crc32(F.col("doc_id").cast("string")) % 4) != 2).select("doc_id", "text", "lang")
    content = language.dictionaries(learn)
    params = lambda body: zstandard.ZstdCompressionParameters.from_level(
        language.LEVEL, source_size=language.PIECE, dict_size=len(body), write_content_size=False, write_checksum=False, write_dict_id=False
    )
    tools = {
        name: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params(body))
        for name, body in content.items()
    }
    got = {r.doc_id: r for r in queries.queries()["op5_language_id"](spark, SF).collect()}
    for r in table.collect():
        raw = (r.text or "").lower().encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        size = {n: sum(len(c.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)) for n, c in tools.items()}
        best = min(size, key=lambda n: (size[n], n))
        second = min(v for n, v in size.items() if n != best)
        assert got[r.doc_id].lang_pred == best
        assert math.isclose(got[r.doc_id].score, 1 - 0.5 * math.exp(-8 * (second - size[best]) / second), abs_tol=1e-12)
    assert len(got) == table.count()


def test_language_held_out_accuracy(spark):
    rows = queries.queries()["op5_language_id"](spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "lang_pred")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = rows.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


# --- 6: neighbours -----------------------------------------------------------------------------


def slow_neighbours(rows, k=5):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        score = {i: float((ok[q] * v).sum() / math.sqrt((ok[q] ** 2).sum() * (v**2).sum())) for i, v in ok.items() if i != q}
        out[q] = sorted(score.items(), key=lambda kv: (-round(kv[1], 12), kv[0]))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(i, rows[50][1]) for i in range(1000, 1030)]  # a crowd of equal vectors
    rows += [(i, (np.array(rows[100][1]) + rng.normal(size=8) * 1e-3).tolist()) for i in range(2001, 2300)]  # and of near ones
    rows += [(3000, None), (3050, [0.0] * 8), (3100, [1.0, None] + [0.0] * 6), (3150, [math.nan] * 8), (3200, [1.0]), (3250, [math.inf] * 8), rows[7], (3300, [1e200] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, code int").repartition(3)
    got = collections.defaultdict(list)
    for r in nearest.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = slow_neighbours([r for r in rows if r[0] != 3300])
    want_ids = {q: [i for i, _ in v] for q, v in want.items()}
    assert set(got) == set(want_ids) | {3300}
    hit = sum(len(set(want_ids[q]) & {i for i, _ in got[q]}) for q in want_ids) / (5 * len(want_ids))
    assert hit > 0.95 and [i for i, _ in got[50]] == list(range(1000, 1005)) and all(math.isfinite(s) for _, s in got[3300])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest.search(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert nearest.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_recall_in_cells(spark, monkeypatch):
    """Few of many cells: recall against brute force, with a third of all rows in one direction."""
    monkeypatch.setattr(nearest, "CELL", 100)
    monkeypatch.setattr(nearest, "PROBES", 12)
    monkeypatch.setattr(nearest, "SLICE", 64)
    monkeypatch.setattr(nearest, "QUERIES", 8)
    rng = np.random.default_rng(30)
    heads = rng.normal(size=(120, 8))
    own = np.where(rng.random(6000) < 1 / 3, 0, rng.integers(0, 120, 6000))
    rows = [(i, (heads[c] + 0.35 * rng.normal(size=8)).tolist()) for i, c in enumerate(own)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(set)
    for r in nearest.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = {q: {i for i, _ in v} for q, v in slow_neighbours(rows).items()}
    assert sum(len(got[q] & v) for q, v in want.items()) >= 0.9 * 5 * len(want)


def recall(found, vectors, k=5):
    """Share of the true k nearest, by brute force, that were found for each query."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, ids in got.items():
        near = unit @ unit[q]
        near[q] = -2
        hits += len(ids & set(np.argpartition(-near, k - 1)[:k].tolist()))
    return hits / (k * len(got))


@pytest.mark.parametrize("cells", [256, 1024])
def test_recall_of_isotropic_vectors(spark, monkeypatch, cells):
    """Vectors without any clusters, the hardest case: cells searched are as many as the sample shows to be needed."""
    rng = np.random.default_rng(cells)
    n = 24_000
    vectors = rng.normal(size=(n, 64))
    monkeypatch.setattr(nearest, "CELL", -(-n // cells))
    monkeypatch.setattr(nearest, "SAMPLE", 1024)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = nearest.search(df, F.col("vec_id") % 200 == 0).collect()
    assert len(found) == 5 * 120 and recall(found, vectors) >= 0.9


# --- 7: secrets --------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"))


def slow_secrets(text):
    hits = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    hits += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    hits += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(hits, key=lambda h: (h[1], order[h[0]]))


def test_secrets(spark):
    rng = random.Random(13)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rand = lambda n, a=b64: "".join(rng.choice(a) for _ in range(n))
    texts = [
        None, "", "Password: 'abcdefghijkl'", "token: token: abcdefghijklmn", "é𝄞 API_KEY = \"" + rand(20) + "\" x", "secret=short secret = longenough123",
        "AKIA" + rand(16, "ABCDEF0123") + " AKIAAKIA12 AKIA", "hash " + rand(40, "0123456789abcdef") + ", deadbeef", "x" * 50_000 + " token=" + "a" * 12,
        "key " + rand(48) + " end", "a_very_long_identifier_in_some_program_text", "internationalisationinternationalisation", "token=" + "0" * 16,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[9])]
    found = secrets.digest(secrets.scan(docs(spark, rows).withColumn("base", F.lit(1)).repartition(3))).collect()
    assert len(found) == len(rows)
    for r in found:
        text = texts[9] if r.doc_id is None else texts[r.doc_id] or ""
        want = slow_secrets(text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(h[0] == k for h in want) for k in ("assign", "access", "hex"))
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(filter(None, r.spans.split(",")))
        assert r.n_random == (1 if r.doc_id in (9, None) else 0)
    assert secrets.scan(docs(spark, [])).count() == 0


def test_secrets_right_after_an_equals_sign(spark):
    rng = random.Random(23)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(64))
    before = ("AWS_ACCESS_VALUE=", "https://example.org/a?sig=", "a=1&code=", "session=")
    found = secrets.scan(docs(spark, [(i, f"{b}{key} end") for i, b in enumerate(before)])).collect()
    assert {r.doc_id: [(h.s, h.e) for h in r.random] for r in found} == {i: [(len(b), len(b) + 64)] for i, b in enumerate(before)}


def ordinary(rng):
    """A run of ordinary words, names, paths or numbers."""
    stock = "release note server config value index table user account report summary window message national history of the and for".split()
    ws = [rng.choice(stock) for _ in range(9)]
    style = rng.randrange(5)
    if style == 0:
        return "".join(ws)[: rng.randrange(20, 50)]
    if style == 1:
        return "".join(w.capitalize() for w in ws)[: rng.randrange(20, 50)]
    if style == 2:
        return "_".join(ws).upper()[: rng.randrange(20, 50)]
    if style == 3:
        return ("/".join(ws[:3]) + f"/2024-0{rng.randrange(1, 9)}/page-{rng.randrange(99)}")[:50]
    return "-".join(ws[:5]) + f"-v{rng.randrange(20)}"


def test_secrets_by_encoding_at_one_percent(spark):
    rng = random.Random(29)
    alphabets = {
        "hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
        "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "letters": "abcdefghijklmnopqrstuvwxyz",
    }
    rows, kind = [], {}
    for name, a in alphabets.items():
        for n in (24, 32, 40):
            for _ in range(20):
                kind[len(rows)] = (name, n)
                rows.append((len(rows), "see " + "".join(rng.choice(a) for _ in range(n)) + " there"))
    digits = "0123456789abcdef"
    for name in ("mixed hex", "grouped hex"):
        for n in (24, 32, 40):
            for _ in range(20):
                kind[len(rows)] = (name, n)
                key = "".join(rng.choice(digits) for _ in range(n))
                if name == "mixed hex":
                    key = "".join(c.upper() if rng.random() < 0.5 else c for c in key)
                else:
                    key = "-".join(key.upper()[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, n)))
                rows.append((len(rows), f"see {key} there"))
    secret = len(rows)
    rows += [(secret + i, f"see {ordinary(rng)} there") for i in range(100 * secret)]
    found = {r.doc_id for r in secrets.scan(docs(spark, rows)).where(F.size("random") > 0).select("doc_id").collect()}
    assert len([i for i in found if i >= secret]) <= 0.02 * len(found)
    for name in (*alphabets, "mixed hex", "grouped hex"):
        for n in (24, 32, 40):
            mine = [i for i, k in kind.items() if k == (name, n)]
            assert len(found & set(mine)) >= (0.5 if name == "letters" else 0.9) * len(mine), (name, n)


def test_secrets_of_a_text_with_very_many(spark):
    text = " ".join(["token=abcdefghijkl", "deadbeefdeadbeef0"] * 100_000)
    began = time.time()
    row = secrets.digest(secrets.scan(docs(spark, [(1, text), (2, "none")]))).orderBy("doc_id").first()
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in slow_secrets(text))
    assert row.n_assign == row.n_hex == 100_000 and row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert time.time() - began < 120


# --- 8: tokens ---------------------------------------------------------------------------------


def slow_tokens(word, scores):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for e in range(1, len(word) + 1):
        best[e] = max(((best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in scores), default=(-math.inf, 0))
    return -best[-1][1]


def test_tokens(spark):
    import regex

    rng = random.Random(14)
    pieces = [bytes([b]) for b in range(256)] + [p.encode() for p in ("th", "the", " the", "in", "ing", "é", "\n\n", "thin", "aaaa")]
    ranks = {p: i for i, p in enumerate(pieces)}
    scores = token_counts.unigram(ranks)
    ws = {"".join(rng.choices("thein ga", k=rng.randrange(1, 12))).encode() for _ in range(300)}
    assert token_counts.walk(ws, scores, 4) == {w: slow_tokens(w, scores) for w in ws}
    ws = [*ws, b"", b"thing" * 30, b"the" * 13, "naïve 日本".encode()]
    assert token_counts.Pieces(scores).count(ws) == [slow_tokens(w, scores) for w in ws]
    lacking = {p: x for p, x in scores.items() if p != b"g"}
    assert token_counts.Pieces(lacking).count(ws) == [token_counts.walk(ws, lacking, 4)[w] for w in ws]
    texts = [None, "", "the thing\n\n the thé 123", "a" * 30_000, "日本語 text"]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, list(enumerate(texts))), ranks).collect()}
    for i, t in enumerate(texts):
        split = regex.findall(token_counts.PATTERN, t or "")
        assert got[i].n_pretokens == len(split) and "".join(split) == (t or "")
        assert i == 3 or got[i].n_tokens == sum(slow_tokens(w.encode(), scores) for w in split)
    assert got[3].n_tokens == 7500
    assert token_counts.count_tokens(docs(spark, []), ranks).count() == 0


# --- 9: toxicity -------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(15)
    rows = []
    for i in range(1200):
        w = words(rng, 60)
        if i % 6 == 0:
            for k in rng.sample(range(60), 3):
                w[k] = rng.choice(["foul", "vile", "rotten", "nasty"])
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    rows.append((5000, None, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.where("doc_id % 4 <> 0 or doc_id = 5000"))
    assert len(model[0]) < 1000
    got = toxicity.score(df.withColumn("text_", F.lit(1)), model, keep=("doc_id", "label")).collect()
    held = [r for r in got if r.doc_id % 4 == 0 and r.doc_id < 5000]
    assert sum((r.score >= 0.5) == r.label for r in held) >= 0.99 * len(held) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(df.limit(0))
    assert {r.score for r in toxicity.score(df.limit(3), none).collect()} == {0.5}


def slow_train(rows, labels):
    """FTRL-proximal, feature by feature."""
    z, n, z0, n0, w0 = {}, {}, 0.0, 0.0, 0.0
    a, b, l1 = toxicity.ALPHA, toxicity.BETA, toxicity.L1
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((b + math.sqrt(n[f])) / a)
    for _ in range(toxicity.EPOCHS):
        for x, y in zip(rows, labels, strict=True):
            w = {f: weight(f) for f in x}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()) + w0)))) - y
            for f in x:
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / a * w[f]
                n[f] = old + g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / a * w0
            n0 += g * g
            w0 = -z0 / ((b + math.sqrt(n0)) / a)
    return {f: weight(f) for f in z if weight(f)}, w0


def test_toxicity_training_against_brute_force():
    rng = random.Random(31)
    stock = words(rng, 40, 60)
    texts = [" ".join(rng.choice(stock) for _ in range(12)) + (" foul vile" if i % 4 == 0 else "") for i in range(300)]
    hashes = toxicity._Hashes()
    rows = [toxicity.features(t, hashes) for t in texts]
    for x, t in zip(rows, texts, strict=True):  # distinct words, pairs and skips, up to chance collisions
        w = t.split()
        assert len(x) in range(len({*w, *zip(w, w[1:]), *((u, 0, v) for u, v in zip(w, w[2:]))}) - 2, len(w) * 3 + 1)
    labels = [float(i % 4 == 0) for i in range(300)]
    kept, values, bias = toxicity.train(rows, labels)
    want, bias_ = slow_train([x.tolist() for x in rows], labels)
    assert kept.tolist() == sorted(want) and math.isclose(bias, bias_, abs_tol=1e-6)
    assert np.allclose(values, [want[f] for f in sorted(want)], atol=1e-4)


def test_training_makes_no_large_results_in_between():
    import tracemalloc

    rows = [np.array([k % 7, 50 + k % 3], np.int32) for k in range(90)]
    tracemalloc.start()
    try:
        toxicity.train(rows, [float(k % 7 == 0) for k in range(90)])
        assert tracemalloc.get_traced_memory()[1] < 8 * 1.2 * (2 << toxicity.BITS)  # two sums of doubles, and little else
    finally:
        tracemalloc.stop()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.queries()["op9_toxicity"](spark, sf).where("held_out")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    caught = sum(r.predicted and r.toxic for r in rows) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted and not r.toxic for r in rows) / sum(not r.toxic for r in rows)
    assert caught > 0.8 and wrong < 0.01


# --- 10: decontamination -----------------------------------------------------------------------


def slow_contamination(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = cut(text), set(), set()
    for i, t in items:
        x = cut(t)
        n = min(13, len(x))
        for s in range(len(x) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[s : s + n]:
                    hit.update(range(at, at + n))
                    if i is not None:
                        found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_contamination(spark, monkeypatch):
    rng = random.Random(16)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([30, 13, 12, 5, 2, 1, 0, 20])] + [(8, None), (9, "w1 w1 w1"), (None, " ".join(words(rng, 15))), (10, "Ünï-code, Test")]
    items += [(11, items[0][1])]
    texts = [None, "", "...", "unrelated words only", items[0][1].upper(), " ".join(words(rng, 300)) + " " + items[7][1], "w1 w1 w1 w1 w1", "ünï code test", items[10][1]]
    texts += [" ".join(rng.choices(["w1", "w2", "w3"], k=200)), " ".join(items[0][1].split()[5:25])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1_000_000, 20):
        monkeypatch.setattr(decontaminate, "TABLE_WORDS", most)
        got = decontaminate.contamination(docs(spark, rows).withColumn("n_hit", F.lit("clash")).repartition(3), bench)
        assert "in_n_hit" in got.columns
        for r in got.collect():
            n, hit, found = slow_contamination(texts[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.items, r.contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n)
    kept = decontaminate.drop_contaminated(docs(spark, rows).withColumn("n_hit", F.lit("clash")), bench)
    assert kept.columns[-1] == "n_hit" and {r.n_hit for r in kept.collect()} == {"clash"}
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
