"""Spelling variants by anagram hashing: words whose letters add up to the same integer, but for one letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import durable

#: Letters of a run; a word has LEAST code points at least and occurs SEEN times at least.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST, SEEN = 5, 3
#: A run whose checksum this divides loses one letter, a planted slip of the pen; 0 leaves all runs as they are.
SLIPS = 97
#: A word's form is its near word of largest count, if that is so many times the word's own.
TIMES = 2
#: A letter counts as this power of its code point, modulo a prime: sums never overflow, however long the word.
POWER, PRIME = 5, (1 << 61) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _letter(c: Column) -> Column:
    code = F.ascii(c).cast("long")
    power = F.lit(1).cast("long")
    for _ in range(POWER):
        power = power * code
    return power


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slips: int = SLIPS, least: int = LEAST, seen: int = SEEN) -> DataFrame:
    """word and n, its occurrences in all texts, for words of `least` code points and `seen` occurrences at least.

    Counts are summed by task before the shuffle. A null text has no words; a null doc_id counts as an empty one.
    """
    # A shorter run cannot become a word, and a run of `least` letters is maximal as the pattern is greedy.
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit("[%s]{%d,}+" % (LETTERS, least)), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("word"))
    word = F.col("word")
    if slips:
        rows = rows.withColumn("h", F.crc32(F.concat("id", "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        short = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length("word")))
        word = F.when(F.col("h") % slips == 0, short).otherwise(word)
    counts = rows.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= seen)


def anagram_keys(words: DataFrame) -> DataFrame:
    """Keys under which near words meet: word, whole (no letter is taken away), key, side and half.

    The key of a word is the sum of its letters' powers, so it is that of all its anagrams. Without one
    letter it is a removal's key. Words that differ by an added letter meet where one's removal key is the
    other's whole key; words that differ by an exchanged letter have keys that differ by the exchange's
    value, so they meet in a removal key of both. One edit leaves the first half or the rest of the
    letters as they are; keys are joined with either, so a crowd of anagrams does not meet as a whole.
    """
    letters = F.transform(F.split("word", ""), _letter)
    add = lambda s, x: F.pmod(s + x, F.lit(PRIME))
    summed = words.select("word", F.length("word").alias("size"), letters.alias("letters"))
    summed = summed.withColumn("sum", F.aggregate("letters", F.lit(0).cast("long"), add))
    # 0 stands for no letter taken away.
    gone = F.explode(F.concat(F.array(F.lit(0).cast("long")), F.array_distinct("letters")))
    rows = summed.select("word", "size", "sum", gone.alias("gone"))
    whole = F.col("gone") == 0
    left = F.col("size") - F.when(whole, 0).otherwise(1)
    first = F.floor(left / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), first).alias("half")), F.struct(F.lit(1).alias("side"), F.expr("right(word, left_ - first_)").alias("half")))
    rows = rows.withColumns({"whole": whole, "left_": left, "first_": first})
    key = F.pmod(F.col("sum") - F.col("gone"), F.lit(PRIME))
    return rows.select("word", "whole", key.alias("key"), "left_", F.explode(sides).alias("x")).select("word", "whole", "key", "left_", "x.side", "x.half")


def near_pairs(words: DataFrame) -> DataFrame:
    """a and b, every pair of words that differ by one inserted, deleted or replaced code point, in one direction.

    Keys say that the letters fit; the order of letters is verified by an edit distance that stops at one.
    """
    keys = anagram_keys(words)
    a = keys.where("not whole").withColumnRenamed("word", "a").drop("whole")
    b = keys.withColumnRenamed("word", "b")
    met = a.join(b, ["key", "left_", "side", "half"]).where("whole or a < b")
    return met.where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def _roots(words: DataFrame) -> DataFrame:
    """words with root: forms are followed to the last, twice as far in each round.

    Each form has TIMES the count at least, so chains are as long as the logarithm of a count and the
    rounds as the logarithm of that.
    """
    links = durable(words.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if not moved.where("moved").head(1):
            return words.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slips: int = SLIPS, least: int = LEAST, seen: int = SEEN, times: int = TIMES) -> DataFrame:
    """Words of the texts with their spelling variants: word, form, root, n, n_near, form_n.

    Runs of letters are lower-cased in A-Z only. A word's form is the near word (one code point inserted,
    deleted or replaced) of largest n, ties to the first in code-point order, if that n is `times` its own;
    root is the last form of the chain, or the word itself. Null and empty texts have no words; repeated
    rows count each time; other columns are not read; an empty table gives no rows. A word of any length
    has as many keys as distinct letters at most.
    """
    words = durable(word_counts(docs, text, doc_id, slips, least, seen))
    pairs = durable(near_pairs(words.select("word")))
    links = pairs.union(pairs.select("b", "a"))
    near = links.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("form")))
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), first.alias("first"))
    joined = words.join(best, "word", "left")
    fits = F.coalesce(-F.col("first.less") >= times * F.col("n"), F.lit(False))
    forms = joined.select(
        "word",
        "n",
        F.when(fits, F.col("first.form")).alias("form"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("first.less")).alias("form_n"),
    )
    return _roots(durable(forms)).select("word", "form", "root", "n", "n_near", "form_n")
