"""Fixed rule tables for Korean reading marks in classical texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.stats import col
from tallyframe.functions.text import buckets, merged_rules


# Particles and their usual forms.
PARTICLES = {
    "을": "를", "은": "는", "으로": "로", "으로서": "로서", "으로써": "로써", "으론": "론",
    "으로도": "로도", "으로는": "로는", "과": "와", "이라": "라", "이며": "며", "이고": "고",
    "이니": "니", "이니라": "니라", "이라도": "라도", "이런들": "런들", "이나": "나", "인가": "ㄴ가",
    "이요": "요", "이면": "면", "이어늘": "어늘", "이러니": "러니", "이로되": "로되", "이리오": "리오",
    "이로다": "로다", "이어든": "어든", "이러라": "러라", "이어니와": "어니와", "이리라": "리라", "이리니": "리니",
    "이여": "여", "이라야": "라야", "이오": "오", "이라가": "라가", "이온": "온", "이로라": "로라",
    "이시니라": "시니라", "이시니": "시니", "이시면": "시면", "이시리오": "시리오", "이시리라": "시리라", "이로소이다": "로소이다",
    "이로대": "로대", "이로니": "로니", "이로이다": "로이다", "이로소니": "로소니", "이언정": "언정", "이언마는": "언마는",
    "이언만": "언만", "이어니": "어니", "이어나": "어나", "이어다": "어다", "이어시늘": "어시늘", "이어시든": "어시든",
    "이리이다": "리이다", "이리잇가": "리잇가", "이릿가": "릿가", "이리잇고": "리잇고", "이리오마는": "리오마는", "이러시니": "러시니",
    "이러시다": "러시다", "이러이다": "러이다", "이리니이다": "리니이다", "이삿다": "삿다", "이완대": "완대", "이야": "야",
    "이신댄": "신댄", "이오사": "오사", "이오도": "오도", "이온여": "온여", "이닛가": "닛가", "이니잇고": "니잇고",
    "이니잇가": "니잇가", "이니이다": "니이다", "이라사": "라사", "이시니이다": "시니이다", "인저": "ㄴ저",
}
# Endings and their usual forms.
ENDINGS = {
    "인댄": "ㄴ댄", "은댄": "ㄴ댄", "은가": "ㄴ가", "인가": "ㄴ가", "ㄴ가": "ㄴ가", "ㄹ진댄": "ㄹ진댄",
    "을진댄": "ㄹ진댄", "은즉": "ㄴ즉", "인즉": "ㄴ즉", "일새": "ㄹ새", "을새": "ㄹ새", "일새니라": "ㄹ새니라",
    "을새니라": "ㄹ새니라", "인대": "ㄴ대", "은대": "ㄴ대", "으니": "니", "으니라": "니라", "으니까": "니까",
    "으면": "면", "으며": "며", "올가": "ㄹ가", "을가": "ㄹ가", "으나": "나", "은들": "ㄴ들",
    "인들": "ㄴ들", "으되": "되", "으므로": "므로", "음으로써": "ㅁ으로써", "으려고": "려고", "을라고": "ㄹ라고",
    "었": "ㅆ", "았": "ㅆ", "였": "ㅆ", "으리라": "리라", "으리오": "리오", "으리니": "리니",
    "으리": "리", "었더라": "ㅆ더라", "었더니": "ㅆ더니", "았더라": "ㅆ더라", "았더니": "ㅆ더니", "인저하니": "ㄴ저하니",
}
# Compound marks and their usual forms.
COMPOUNDS = {
    "하야": "하여", "하야는": "하여는", "하얀": "하여는", "하야도": "하여도", "하얏더니": "하였더니", "하얏거늘": "하였거늘",
    "시니라": "시니라", "시니": "시니", "시고": "시고", "시며": "시며", "시면": "시면", "로다": "로다",
    "도다": "도다", "리로다": "리로다", "이라하니": "라하니", "이라하고": "라하고", "이라하니라": "라하니라", "이라하여": "라하여",
    "이라하다": "라하다", "이라하시니": "라하시니", "이라한대": "라한대", "이라하니이다": "라하니이다", "이라하면": "라하면", "이라하나이다": "라하나이다",
    "이라하더니": "라하더니", "이라하나": "라하나", "이라하며": "라하며", "이라하시니라": "라하시니라", "이라하시고": "라하시고", "이라하노이다": "라하노이다",
    "이라하사": "라하사", "이라호되": "라호되", "이라하노라": "라하노라", "이라하나니": "라하나니", "이라하노니": "라하노니", "이라하되": "라하되",
    "이라하리니": "라하리니", "이라호라": "라호라", "이라하더라": "라하더라", "이라하라": "라하라", "이라하야늘": "라하여늘", "이라하야": "라하여",
    "라하야늘": "라하여늘", "라하야": "라하여", "이라하여늘": "라하여늘", "이니이다하니": "니이다하니", "이리오하고": "리오하고", "이리오하니": "리오하니",
    "이리오하다": "리오하다", "이로다하고": "로다하고", "이라커든": "라커든", "ㄴ저": "ㄴ저",
}

#: Later tables win; each key keeps its first place.
RULES = merged_rules(COMPOUNDS, ENDINGS, PARTICLES)

# Closing marks and their classes, by exact match.
CLOSINGS = {
    "로다": "游辭以斷",
    "니라": "夬絶之斷",
    "하니라": "夬絶之斷",
    "라": "微絶之斷",
    "하다": "記史之斷",
    "러라": "敍述之斷",
    "하더라": "敍述之斷",
    "하나니라": "汎論以斷",
    "하나니": "汎論以斷",
}


# Marks with two uses.
DUAL_USES = {
    "이어늘": ["객체_어늘", "반어"],
    "어늘": ["객체_어늘", "반어"],
    "호대": ["주체_한대", "반어"],
    "이어든": ["점층", "반어"],
    "어든": ["점층", "반어"],
}

# Genre of a book by a part of its name, in order; other books are 기타.
GENRES = [
    ("歷史書", ["자치통감강목", "춘추좌씨전"]),
    ("文集", ["당송팔대가문초"]),
    ("經傳", ["예기", "논어", "맹자", "대학장구", "중용"]),
    ("詩", ["시경집전", "당시삼백수"]),
]

# Division of a book by the beginning of its name, then by a part of it; other books are 기타.
DIVISION_BEGINNINGS = [("경부(사서)", ["논어", "맹자", "대학", "중용"]), ("경부(오경)", ["시경", "서경", "주역", "예기", "춘추"])]
DIVISION_PARTS = [("집부", ["당송팔대가문초"]), ("사부", ["자치통감강목", "통감"])]

# Division, kind and title of a book by the beginning of its name, then kind and author by a part of it.
SHELF = [
    ("논어", ("경부", "사서", "논어집주")),
    ("맹자", ("경부", "사서", "맹자집주")),
    ("대학", ("경부", "사서", "대학장구")),
    ("중용", ("경부", "사서", "중용장구")),
    ("시경", ("경부", "오경", "시경집전")),
    ("서경", ("경부", "오경", "서경집전")),
    ("주역", ("경부", "오경", "주역전의")),
    ("예기", ("경부", "오경", "예기집설대전")),
    ("춘추", ("경부", "오경", "춘추좌씨전")),
    ("자치", ("사부", "편년체", "자치통감강목")),
]
AUTHORS = ["한유", "유종원", "구양수", "소순", "소식", "소철", "증공", "왕안석"]
AUTHORS_SHELF = ("집부", "당송팔대가문초")
UNSHELVED = "미분류"


def dual_uses(marker: Column | str) -> Column:
    """The uses of a mark that has two; null for others."""
    pairs = [x for k, v in DUAL_USES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.element_at(F.create_map(*pairs), col(marker))


def genre(book: Column | str) -> Column:
    """Genre of a book; 기타 for others and for null."""
    return F.coalesce(buckets(book, GENRES, "기타"), F.lit("기타"))


def division(book: Column | str) -> Column:
    """Division of a book; 기타 for others and for null."""
    name = buckets(book, DIVISION_PARTS, "기타")
    for value, beginnings in reversed(DIVISION_BEGINNINGS):
        for x in beginnings:
            name = F.when(col(book).startswith(x), value).otherwise(name)
    return F.coalesce(name, F.lit("기타"))


def shelf(book: Column | str) -> Column:
    """Struct of division, kind and title (or author) of a book; the title of an unknown book is its name."""
    place = lambda a, b, c: F.struct(F.lit(a).alias("division"), F.lit(b).alias("kind"), c.alias("title"))
    out = place(UNSHELVED, UNSHELVED, col(book))
    for author in reversed(AUTHORS):
        out = F.when(col(book).contains(author), place(*AUTHORS_SHELF, F.lit(author))).otherwise(out)
    for beginning, (a, b, c) in reversed(SHELF):
        out = F.when(col(book).startswith(beginning), place(a, b, F.lit(c))).otherwise(out)
    return out


def compound_tags(marker: Column | str) -> Column:
    """Comma-joined tags of a compound mark; empty without one.

    A quotation is a closing mark followed by 하 or 호 and more, the longest closing first. Honour,
    self-reference and modesty follow from their syllables; the last tag says how the mark ends.
    """
    m = F.coalesce(col(marker), F.lit(""))
    bases = sorted(CLOSINGS, key=len, reverse=True)
    quote, end = F.lit(None).cast("string"), F.when(m.endswith("이다"), "종결").otherwise("연결")
    for base in reversed(bases):
        quoted = (m.startswith(base + "하") | m.startswith(base + "호")) & (F.length(m) > len(base) + 1)
        quote = F.when(quoted, f"인용내({CLOSINGS[base]})").otherwise(quote)
        end = F.when(m.endswith(base), f"종결({CLOSINGS[base]})").otherwise(end)
    own = m.contains("노") | (quote.isNull() & m.startswith("호니"))
    modest = m.contains("소이") | m.contains("소니") | m.endswith("이다")
    tags = F.array_compact(F.array(quote, F.when(m.contains("시"), "존경"), F.when(own, "自稱"), F.when(modest, "겸양")))
    return F.when(F.size(tags) > 0, F.array_join(F.concat(tags, F.array(end)), ",")).otherwise("")


def variant_rules(marker: str = "marker") -> list[tuple[str, Column]]:
    """Rewrites under which two marks may be spellings of one, for profile.variant_pairs; null where one does not apply."""
    m = F.col(marker)
    swap = lambda a, b: F.when(m.contains(a), F.replace(m, F.lit(a), F.lit(b)))
    cut = lambda a, b="": F.when(m.startswith(a) & (F.length(m) > len(a)), F.concat(F.lit(b), F.substr(m, F.lit(len(a) + 1))))
    return [
        ("을-를", swap("을", "를")),
        ("은-는", swap("은", "는")),
        ("으", cut("으")),
        ("이", cut("이")),
        ("인-은", cut("인", "은")),
        ("인-ㄴ", cut("인", "ㄴ")),
        ("야-여", swap("야", "여")),
        ("았-었", swap("았", "었")),
        ("과-와", swap("과", "와")),
    ]
