"""Text annotation: markers, rewrites, classes, tags, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.stats import col

# Words that a boolean column may hold for true.
TRUE_WORDS = ("true", "1", "yes", "y", "o")
# Leading consonants from U+1100 on and the compatibility letters that replace them.
JAMO = "".join(chr(0x1100 + i) for i in range(19))
JAMO_FOLDED = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def parse_bool(value: Column | str, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    """True for the given words in any case, false for all else and for null."""
    return F.coalesce(F.lower(strip(col(value).cast("string"))).isin(*words), F.lit(False))


def trailing_run(text: Column | str, script: str = r"\p{IsHangul}", outside: str = r"\P{IsHangul}", dropped: str = "ㆍ") -> Column:
    """The last run of a script: without bracketed parts and dropped signs, and with what follows the script cut.

    script and outside are character classes; the text is read from its end, once.
    """
    whole = col(text)
    bare = F.when(whole.contains("("), F.regexp_replace(whole, r"\([^)]*\)", " ")).otherwise(whole)
    bare = F.translate(bare, dropped, "") if dropped else bare
    return F.coalesce(F.reverse(F.regexp_extract(F.reverse(bare), f"^{outside}*({script}+)", 1)), F.lit(""))


def all_runs(text: Column | str, pattern: str = "[ㄱ-ㆎ가-힣]+") -> Column:
    """All runs that match, joined by commas."""
    return F.array_join(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)), ",")


def fold_jamo(text: Column | str) -> Column:
    return F.translate(col(text), JAMO, JAMO_FOLDED)


def merged_rules(*tables: dict[str, str]) -> dict[str, str]:
    """Rules of several tables: later values win, first positions stay."""
    merged: dict[str, str] = {}
    for rules in tables:
        merged.update(rules)
    return merged


def rewrite(text: Column | str, rules: dict[str, str]) -> Column:
    """Ordered rewriting: an exact hit gives its value; else every rule applies in turn, longest key first.

    Each rule replaces all occurrences in the result of those before it; rules of one length keep
    their order.
    """
    bare = fold_jamo(strip(text))
    pairs = sorted(rules.items(), key=lambda kv: -len(kv[0]))
    if not pairs:
        return bare
    exact = F.element_at(F.create_map(*(F.lit(x) for kv in rules.items() for x in kv)), bare) if rules else F.lit(None)
    return F.coalesce(exact, reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs, bare))


def rewrite_distinct(df: DataFrame, column: str, rules: dict[str, str], name: str) -> DataFrame:
    """df with the rewritten column: each distinct value is rewritten once and joined back."""
    known = df.select(column).where(F.col(column).isNotNull()).distinct()
    known = known.withColumn(name, rewrite(column, rules))
    return df.join(known, column, "left")


def variants_of(rules: dict[str, str], value: str) -> list[str]:
    """Keys that are rewritten to a value, in order."""
    return [k for k, v in rules.items() if v == value]


def exact_class(marker: Column | str, classes: dict[str, str], other: str = "") -> Column:
    """Class by exact match."""
    if not classes:
        return F.lit(other)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in classes.items() for x in kv)), col(marker)), F.lit(other))


def compound(marker: Column | str, contracted: list[str], cores: list[str], basics: list[str]) -> Column:
    """Whether a marker is made of several: a contracted one, a core ending inside, or two basic ones inside.

    Contracted markers count as a whole, a suffix or a part. Markers of two characters or fewer are
    never compound otherwise; core endings count if longer than two characters and not the whole.
    """
    m = col(marker)
    has = lambda words: reduce(lambda x, y: x | y, [m.contains(w) for w in words], F.lit(False))
    inside = reduce(lambda x, y: x | y, [m.contains(w) & (m != w) for w in cores if len(w) >= 3], F.lit(False))
    basic = sum((m.contains(w).cast("int") for w in basics), F.lit(0))
    return has(contracted) | ((F.length(m) > 2) & (inside | (basic >= 2)))


def regex_class(
    marker: Column | str,
    taxonomy: list[tuple[str, list[str]]],
    first: tuple[Column, str] | None = None,
    other: str = "미분류",
    missing: str = "미분류_결측",
) -> Column:
    """First class of an ordered taxonomy that has a pattern matching from the start.

    `first` is a condition with its class that precedes all; null markers are `missing`.
    """
    m = col(marker)
    out = F.when(m.isNull(), missing)
    if first is not None:
        out = out.when(first[0], first[1])
    for name, patterns in taxonomy:
        out = out.when(m.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"), name)
    return out.otherwise(other)


def base_tags(marker: Column | str, taxonomy: list[tuple[str, list[str]]]) -> Column:
    """All classes with a pattern found anywhere once its anchors are taken away."""
    loose = [(n, "|".join(f"(?:{p.replace('^', '').replace('$', '')})" for p in ps)) for n, ps in taxonomy]
    return F.array_compact(F.array(*(F.when(col(marker).rlike(p), n) for n, p in loose)))


def affix_tags(marker: Column | str, bases: list[str], rules: list[tuple[str, Column]], closing: list[tuple[Column, str]], other: str) -> Column:
    """Comma-joined tags: those of the rules that hold, then the first closing tag; empty unless a rule holds."""
    m = F.coalesce(col(marker), F.lit(""))
    tags = F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules)))
    end = reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(closing), F.lit(other))
    for base in sorted(bases, key=len):
        end = F.when(m.endswith(base), base).otherwise(end)
    return F.when(F.size(tags) > 0, F.array_join(F.concat(tags, F.array(end)), ",")).otherwise("")


def anonymise(text: Column | str, digits: int = 16) -> Column:
    """First hex digits of SHA-256; empty and null stay."""
    c = col(text)
    return F.when(c.isNull() | (c == ""), c).otherwise(F.substring(F.sha2(c, 256), 1, digits))


def buckets(value: Column | str, table: list[tuple[str, list[str]]], other: str) -> Column:
    """First bucket of which a listed part is contained in the value."""
    out = None
    for name, parts in table:
        hit = reduce(lambda x, y: x | y, [col(value).contains(p) for p in parts])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(other) if out is None else out.otherwise(other)


def parse_votes(answer: Column | str, n: int, strict: bool = False) -> Column:
    """Array of n votes from an answer that lists "1. O", "2. X" and so on.

    By default item i is true if "i. O" or "i.O" occurs anywhere, also within a larger number;
    strict asks for it at the start of a line or after a separator. No answer is false.
    """
    a = F.coalesce(col(answer), F.lit(""))
    if strict:
        return F.array(*(a.rlike(rf"(?m)(?:^|[^0-9]){i}\.\s?O") for i in range(1, n + 1)))
    return F.array(*(a.contains(f"{i}. O") | a.contains(f"{i}.O") for i in range(1, n + 1)))


def probability(json_text: Column | str, field: str = "noul") -> Column:
    """A field of a JSON object as a number; null for text, booleans and absence."""
    raw = F.get_json_object(col(json_text), f"$.{field}")
    kind = F.from_json(col(json_text), F.lit(f"`{field}` string"))[field]
    shape = F.regexp_extract(col(json_text), f'"{field}"\\s*:\\s*(-?[0-9][0-9.eE+-]*)', 1)
    return F.when(kind.isNotNull() & (shape != ""), raw.try_cast("double"))


def whole_number(value: Column | str) -> Column:
    """An integer or numeric text, else 0."""
    return F.coalesce(col(value).cast("string").try_cast("long"), F.lit(0).cast("long"))


def truncate(text: Column | str, size: int, notice: str = "") -> tuple[Column, Column]:
    """The first `size` characters, with a notice if something was cut; and whether it was."""
    cut = F.length(col(text)) > size
    return F.when(cut, F.concat(F.substring(col(text), 1, size), F.lit(notice))).otherwise(col(text)), cut


def prompt(instruction: str, items: Column | str) -> Column:
    """An instruction over a numbered list of the items."""
    lines = F.transform(col(items), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    return F.concat(F.lit(instruction + "\n"), F.array_join(lines, "\n"))


def split_markers(text: Column | str, sep: str = ",") -> Column:
    """Trimmed, non-blank parts of a list."""
    return F.filter(F.transform(F.split(col(text), sep), strip), lambda x: x != "")
