"""Text annotation on small cases."""

import pytest
from tallyframe.functions import text as X


def values(spark, words, f):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r[0] for r in rows.orderBy("i").select(f("w")).collect()]


def test_parse_bool(spark):
    assert values(spark, ["True", " yes ", "O", "1", "no", "", None, "2"], X.parse_bool) == [True] * 4 + [False] * 4


def test_trailing_run(spark):
    got = values(spark, ["學而時習하니라。", "(하고) 면 ", "abc", None, "가ㆍ나다 (라).", "나\n마"], X.trailing_run)
    assert got == ["하니라", "면", "", "", "가나다", "마"]


def test_all_runs(spark):
    assert values(spark, ["a하고bㄴ댄", ""], X.all_runs) == ["하고,ㄴ댄", ""]


def test_jamo(spark):
    assert values(spark, ["ᄂ댄"], X.fold_jamo) == ["ㄴ댄"]


def test_rewrite_cascades(spark):
    rules = X.merged_rules({"a": "b", "abc": "x"}, {"bb": "c", "a": "q"}, {"xc": "z"})
    assert list(rules) == ["a", "abc", "bb", "xc"] and rules["a"] == "q"

    def model(w):
        if w in rules:
            return rules[w]
        for k, v in sorted(rules.items(), key=lambda kv: -len(kv[0])):
            w = w.replace(k, v)
        return w

    words = ["a", "abc", "abcabc", "bbb", "abcc", "zabcbb", "", "bba"]
    assert values(spark, words, lambda c: X.rewrite(c, rules)) == [model(w) for w in words]
    assert X.variants_of({"은": "는", "을": "를", "ㄴ": "는"}, "는") == ["은", "ㄴ"]


def test_taxonomy(spark):
    tax = [("first", [".*니라$"]), ("second", ["하고", "하며"])]
    kind = lambda c: X.regex_class(c, tax, (X.compound(c, ["어늘"], ["하나니"], ["고", "면"]), "compound"))
    assert values(spark, ["하니라", "하고", "이하고", "어늘", "하고면", "하나니라", None], kind) == ["first", "second", "미분류", "compound", "compound", "compound", "미분류_결측"]


def test_anonymise(spark):
    assert values(spark, ["a", "", None], X.anonymise) == ["ca978112ca1bbdca", "", None]


def test_votes(spark):
    assert values(spark, ["1. O / 2. X / 3. O"], lambda c: X.parse_votes(c, 3)) == [[True, False, True]]
    assert values(spark, ["11. O"], lambda c: X.parse_votes(c, 11))[0] == [True] + [False] * 9 + [True]
    assert values(spark, ["11. O"], lambda c: X.parse_votes(c, 11, strict=True))[0] == [False] * 10 + [True]


def test_probability(spark):
    assert values(spark, ['{"noul": 0.5}', '{"noul": "x"}', '{"noul": true}', '{"noul": null}', "{}", '{"noul": 1}'], X.probability) == [0.5, None, None, None, None, 1.0]


def test_split_and_prompt(spark):
    assert values(spark, [" a, ,b "], X.split_markers) == [["a", "b"]]
    assert values(spark, [" a,b"], lambda c: X.prompt("Q", X.split_markers(c))) == ["Q\n1. a\n2. b"]


def test_korean_marks(spark):
    from tallyframe.functions import korean

    pairs = dict(zip("을 은 으로 과 이라 인댄 은댄 은가 인가 으니 으면 으리라 하야 니라 하고 면".split(), "를 는 로 와 라 ㄴ댄 ㄴ댄 ㄴ가 ㄴ가 니 면 리라 하여 니라 하고 면".split()))
    assert values(spark, list(pairs), lambda c: X.rewrite(c, korean.RULES)) == list(pairs.values())
    assert (len(korean.RULES), sum(k == v for k, v in korean.RULES.items())) == (170, 11)
    tags = ["하나니라하니", "하시니라", "하노라", "호니", "니이다", "하고", "라하소서", None]
    want = ["인용내(汎論以斷),연결", "존경,종결(夬絶之斷)", "自稱,종결(微絶之斷)", "自稱,연결", "겸양,종결", "", "인용내(微絶之斷),연결", ""]
    assert values(spark, tags, korean.compound_tags) == want
    assert values(spark, ["니라", "없음"], lambda c: X.exact_class(c, korean.CLOSINGS)) == ["夬絶之斷", ""]


def test_variant_rules(spark):
    from tallyframe.functions import korean
    from tallyframe.operators import profile

    vocabulary = spark.createDataFrame([("이니라", 5), ("니라", 9), ("하야", 2), ("하여", 3), ("고", 1)], "marker string, n int")
    got = profile.variant_pairs(vocabulary, korean.variant_rules()).collect()
    assert sorted((r.rule, r.marker, r.form, r.n, r.form_n) for r in got) == [("야-여", "하야", "하여", 2, 3), ("이", "이니라", "니라", 5, 9)]


def test_families_of_forms(spark):
    from tallyframe.operators import coverage

    rules = {"a": "b", "b": "c", "x": "y", "y": "z", "z": "x", "long": "lung"}
    words = [("a", 5), ("b", 2), ("q", 7), ("longlong", 3), ("x1", 1), (None, 4), ("q", 1)]
    vocabulary = spark.createDataFrame(words, "marker string, n long")
    got = {r.form: (r.n, r.normal, r.steps, r.cyclic) for r in coverage.families(vocabulary, rules).collect()}
    # Longer keys come first, and rules of one length in order, so one rewriting of "x1" passes x, y and z.
    assert got["a"] == (5, "c", 2, False) and got["b"] == (2, "c", 1, False) and got["c"] == (0, "c", 0, False)
    assert got["x"] == (0, "x", None, True) and got["y"][1] == got["z"][1] == "x" and got["q"] == (8, "q", 0, False)
    assert got["longlong"] == (3, "lunglung", 1, False) and got["x1"] == (1, "x1", 0, False)
    assert [r.marker for r in coverage.uncovered(vocabulary, rules, 3).collect()] == ["q"]
    with pytest.raises(ValueError, match="new forms"):
        coverage.families(vocabulary, {"q": "qq"}, rounds=5)
    assert coverage.families(vocabulary.limit(0), {}).count() == 0
