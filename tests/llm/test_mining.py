"""License scans, spelling variants and collocations on small tables, against brute force."""

import collections
import itertools
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import collocations, licenses, variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOCS)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 11: license scans -------------------------------------------------------------------------


def slow_hits(text):
    """Hits of every rule without the keyword filter, and suppression over all pairs of them."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    body, found = " " + "  ".join(w) + " ", []
    for i, rule in enumerate(licenses.rules()):
        for m in re.finditer(rule.expression, body):
            assert rule.literal in m[0]
            first = len(body[: m.start()].split())
            found.append((first, first + len(m[0].split()), i, rule))

    def beats(o, x):
        inside = o[0] <= x[0] and o[1] >= x[1]
        return inside and (o[3].strength[0], o[1] - o[0], -o[2]) > (x[3].strength[0], x[1] - x[0], -x[2])

    return len(w), sorted((s, e, i) for s, e, i, r in found if r.base or not any(beats(o, (s, e, i, r)) for o in found))


NOTICES = [
    "Licensed under the Apache License, Version 2.0.",
    "GNU General Public License, version 3 or any later version",
    "SPDX-License-Identifier: LGPL-2.1-only; GPLv2, gplv3; GPL-2.0-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "CC BY-NC-SA 4.0 and CC-BY and Attribution-ShareAlike 3.0, https://creativecommons.org/licenses/by-nd/2.5/",
    "The MIT License (MIT) mit license MIT LICENSE",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "Alle Rechte vorbehalten. Tous droits réservés. Copyright (c) 2021 X. All rights reserved.",
    "This is free and unencumbered software released into the public domain. CC0 1.0; zlib/libpng license; unlicense",
    "Mozilla Public License 2.0, MPL 1.1, EUPL v1.2, Boost Software License, PHP License 3.01, Artistic License 2",
    "noncommercial use only; distributed under the terms of the BSD 3-Clause License",
]


def test_license_scan(spark):
    rng = random.Random(11)
    filler = "the of license licence under terms gnu gpl public v2 2 0 by cc mit general apache version über".split()
    texts = [None, "", "...", "ünder the ÜBER license", "cc by", "mit-license", "permit license", *NOTICES]
    texts += [" ".join(x for n in rng.sample(NOTICES, 3) for x in (*rng.choices(filler, k=5), n)) for _ in range(25)]
    texts += [" ".join(rng.choices(filler, k=300)) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8])]
    got = licenses.scan(docs(spark, rows).withColumn("hits", F.lit("clash")).withColumn("x.y", F.lit(1)).repartition(3), keep=("doc_id", "hits", "x.y"))
    assert got.columns == ["doc_id", "in_hits", "x.y", "n_words", "hits"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        n, hits = slow_hits(texts[8 if r.doc_id is None else r.doc_id])
        assert r.n_words == n and sorted((h.first, h.end, h.rule) for h in r.hits) == hits
    out = {r.doc_id: r for r in licenses.digest(licenses.scan(docs(spark, rows))).collect()}
    assert (out[0].n_words, out[0].first_word, out[0].labels, out[0].score) == (0, None, "", 0.0)
    assert (out[4].base_labels, out[4].n_base, out[5].base_labels, out[6].base_labels) == ("cc-by", 1, "mit", "")
    assert out[7].labels == "apache,apache-2.0,license-notice" and out[7].base_labels == "apache"
    assert "gpl-3.0-or-later" in out[8].labels.split(",") and out[12].n_base == 3
    assert licenses.digest(licenses.scan(docs(spark, []))).count() == 0


@pytest.mark.parametrize("notice", NOTICES)
def test_license_notices_are_found(notice):
    assert slow_hits(notice)[1]


def test_license_rules_are_many_and_gated(spark):
    table = licenses.rules()
    assert len(table) > 300 and len({r.label for r in table}) > 100
    # Time in proportion to a long text of very many hits.
    scanner = licenses.Scanner(table)
    text = b"  ".join(fold(" ".join(NOTICES)).encode().translate(licenses._FOLD).split())
    began = time.time()
    hits = scanner.kept(scanner.matches(b" " + b"  ".join([text] * 2000) + b" "))
    assert len(hits) >= 2000 * 20 and time.time() - began < 30


# --- 12: spelling variants ---------------------------------------------------------------------


def slow_words(rows, slips=97):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else len(b) - len(a) == 1 and a[p:] == b[p + 1 :])


def slow_variants(rows, slips=97):
    n = slow_words(rows, slips)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_variants(spark):
    rng = random.Random(12)
    stock = ["letter", "lettre", "éclair", "Éclair", "straße", "aaaaa", "aaaaaa", "aaaaaaa", "abcdefghij", "müller", "theorem", "theorems"]
    stock += ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))) for _ in range(150)]
    typo = lambda w: w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", w[k], "ÿ"]) + w[k + rng.randrange(2) :]
    rows = [(None, None), (1, ""), (2, "..."), (3, "a-b'c1d"), (None, "letter Letter LETTER"), (4, "x" * 50_000), (5, "x" * 50_000), (6, "x" * 50_000 + "İstanbul Ωmega")]
    for i in range(40):
        text = [w if rng.random() < 0.8 else typo(w) for w in rng.choices(stock, [1 / (1 + k) for k in range(len(stock))], k=80)]
        rows.append((10 + i, rng.choice([" ", "1", "-", "\n"]).join(text)))
    rows += [rows[-1]] * 3 + [(90, "qwert " * 4 + "qwerty " * 10 + "qwertyu " * 40)]
    for slips in (97, 3, 0):
        got = variants.variants(docs(spark, rows).withColumn("word", F.lit("clash")).repartition(3), slips=slips)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == slow_variants(rows, slips)
    assert any(r[1] and r[2] != r[1] for r in slow_variants(rows, 0))  # a chain of forms
    assert variants.variants(docs(spark, [])).count() == 0 and variants.variants(docs(spark, [(1, "words words")])).count() == 0


def test_a_crowd_of_anagrams_does_not_meet_as_a_whole(spark):
    words = sorted({"".join(p) for p in itertools.permutations("abcdefg")})
    keys = variants.anagram_keys(spark.createDataFrame([(w,) for w in words], "word string"))
    met = keys.groupBy("key", "left_", "side", "half").count().agg(F.max("count")).first()[0]
    assert met <= 24 and variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).count() == 0


# --- 13: collocations --------------------------------------------------------------------------


def slow_collocations(rows, longest=3, seen=10, inside=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(t)) if t is not None else ():
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= seen}
        kept = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= inside * a for b in longer):
                continue
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(13)
    stock = ["new", "york", "city", "of", "the", "a", "über", "\U0001f600", "�", "q\x01", "\x01", "\x01\x02", "z\xa0z", "ab", "a\x1c"]
    rows = [(None, "en"), ("", "en"), (".,;", None), ("only", "xx"), ("Of The New York", None)]
    for i in range(150):
        w = rng.choices(stock, [3, 3, 2, 8, 9, 5, 1, 1, 1, 1, 2, 1, 1, 1, 1], k=rng.randrange(1, 60))
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for x in w)
        rows.append((text.upper() if i % 7 == 0 else text, rng.choice(["en", "en", "de", None, "und", "e\x01n"])))
    return rows + [("new york city " * 400, "hot")] * 5 + [("of the , new york city. " * 30, "en")] * 4


@pytest.mark.parametrize("chunk", [1_000_000, 500])
def test_collocations(spark, prose, chunk):
    df = docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(prose)])
    got = collocations.collocations(df.withColumn("phrase", F.lit("clash")).repartition(5), chunk=chunk)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == slow_collocations(prose)


def test_collocations_of_other_lengths_and_small_batches(spark, prose):
    df = docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(prose)])
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # prefixes go on from batch to batch
        for longest, seen, top in ((2, 3, 5), (4, 2, 50)):
            got = collocations.collocations(df, longest=longest, seen=seen, top=top)
            assert sorted(map(tuple, got.collect())) == slow_collocations(prose, longest, seen, top=top)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert collocations.collocations(docs(spark, [])).count() == 0
    long_ = " ".join(f"w{i % 50} and" for i in range(200_000))
    assert collocations.collocations(docs(spark, [(1, long_, "en")])).count() > 0


def test_blocks_keep_the_text():
    text = b"a b\nccc\n" * 10 + b"d" * 30 + b"\ne"
    for size in (1, 5, 9, 1000):
        parts = list(collocations._blocks(text, size))
        assert b"".join(parts) == text and all(p.endswith(b"\n") for p in parts[:-1])
