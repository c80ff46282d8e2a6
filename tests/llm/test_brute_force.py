"""Registered queries without SQL against brute force over the whole smallest tables."""

import collections
import hashlib
import itertools
import math
import re

import pytest
import regex

from tallyframe.llm import queries, secrets, token_counts
from test_operators import slow_print, slow_secrets, slow_tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def test_op1(spark, texts):
    prints = {i: slow_print(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    changed = True
    close = [(a, b) for a, b in itertools.combinations(texts, 2) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    while changed:
        changed = False
        for a, b in close:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op1_simhash_near_dedup")}
    assert got == {i: (f"{prints[i]:016x}", least[i]) for i in texts}


def test_op4(spark, texts):
    cut = {i: t.lower().split() for i, t in texts.items()}
    holders = collections.defaultdict(set)
    for i, w in cut.items():
        for k in range(len(w) - 50):
            holders[tuple(w[k : k + 51])].add(i)
    want = {i for s in holders.values() if len(s) > 1 for i in s}
    rows = run(spark, "op4_substring_dedup")
    found = {x for r in rows for x in (r.doc_id, r.other_id)}
    assert want <= found
    for r in rows:
        a, b = cut[r.doc_id][r.first_word : r.end_word], cut[r.other_id][r.other_first : r.other_end]
        equal = sum((collections.Counter(a) & collections.Counter(b)).values())
        assert min(len(a), len(b)) >= 50 and equal >= 0.8 * max(len(a), len(b))


def battery(run):
    """(stratum, p_random, log_p) of a run, from the definitions of the tests."""
    enc = next(i for i, (_, p, _) in enumerate(secrets.ENCODINGS) if re.match(p, run))
    symbols = secrets.ENCODINGS[enc][2]
    a = len(symbols)
    body = run.lower().replace("-", "") if enc <= 4 else run.replace("_", "/").replace("-", "+")
    v, n = [symbols.index(c) + 1 for c in body], len(body)
    chi2 = sum(k * k for k in collections.Counter(v).values()) * a / n - n
    spread = 2 / (9 * (a - 1))
    z_chi = ((max(chi2, 0.0) / (a - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    half = [x > a / 2 for x in v]
    up, turns = sum(half), 1 + sum(x != y for x, y in itertools.pairwise(half))
    mix = 2 * up * (n - up)
    var = mix * (mix - n) / (n * n * (n - 1))
    z_runs = (turns - mix / n - 1) / math.sqrt(var) if var > 0 else 99.0
    mid = (a + 1) / 2
    z_serial = sum((x - mid) * (y - mid) for x, y in itertools.pairwise(v)) / (math.sqrt(n - 1) * (a * a - 1) / 12)
    tail = lambda z: 0.5 * math.exp(-z * z / 2) if z > 0 else 1.0
    p_random = min(1.0, 3 * min(tail(z_chi), 2 * tail(abs(z_runs)), 2 * tail(abs(z_serial))))
    kind = [0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in run]
    share = {c: x / sum(secrets.LETTERS) for c, x in zip("abcdefghijklmnopqrstuvwxyz", secrets.LETTERS)}
    text = math.log(1 / 4) + sum(math.log(secrets.FOLLOWS[x][y]) for x, y in itertools.pairwise(kind))
    text += sum(math.log(share[c] if c in share else 1 / 10 if c.isdigit() else 1 / 4) for c in run.lower())
    return (enc, sum(n >= b for b in secrets.BANDS)), p_random, min(0.0, text + n * math.log(a))


def random_spans(texts):
    """Spans that the battery adds to all texts, by Benjamini-Hochberg over the distinct runs of each stratum."""
    where = collections.defaultdict(set)
    for i, t in texts.items():
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", t):
            where[m[0]].add((i, m.start(), m.end()))
    strata = collections.defaultdict(list)
    for run in where:
        stratum, p_random, log_p = battery(run)
        strata[stratum].append((min(math.floor(-log_p * 8), 5600), p_random, run))
    out = set()
    for rows in strata.values():
        cuts = [b for b, *_ in rows if math.exp(-b / 8) <= 0.01 * sum(c >= b for c, *_ in rows) / len(rows)]
        out |= {x for b, p, run in rows if cuts and b >= min(cuts) and p >= 0.001 for x in where[run]}
    return out


def test_op7(spark, texts):
    rows = {r.doc_id: r for r in run(spark, "op7_secret_scan")}
    assert rows.keys() == texts.keys()
    added = random_spans(texts)
    order = {"assign": 0, "access": 1, "hex": 2, "random": 3}
    for i, t in texts.items():
        base = slow_secrets(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        fresh = [("random", s, e) for j, s, e in added if j == i and not any(x <= s and y >= e for _, x, y in base)]
        listed = sorted(base + fresh, key=lambda h: (h[1], order[h[0]], h[2]))
        assert rows[i].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in listed) and rows[i].n_random == len(fresh)


def test_op8(spark, texts):
    scores = token_counts.unigram(token_counts.read_ranks(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"))
    rows = {r.doc_id: r for r in run(spark, "op8_token_counts")}
    known = {}
    for i, t in texts.items():
        split = regex.findall(token_counts.PATTERN, t)
        for w in split:
            known[w] = known.get(w) or slow_tokens(w.encode(), scores)
        assert (rows[i].n_pretokens, rows[i].n_tokens) == (len(split), sum(known[w] for w in split))
