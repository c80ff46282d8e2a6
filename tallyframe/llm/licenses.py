"""License scans: ordered signature rules behind a keyword prefilter; wider and stronger detections suppress narrower ones."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words: ASCII letters, with A-Z lower-cased, digits, and every byte of a non-ASCII character.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: How strong a kind of detection is: its priority, and how sure it is that the text is under the license.
TAG, NOTICE, TITLE, CLUE = (3, 0.99), (2, 0.95), (1, 0.8), (0, 0.4)


@dataclass(frozen=True)
class Rule:
    """A signature: a regular expression over words that one space parts, and the beginning of words that every match holds."""

    label: str
    keyword: str
    pattern: str
    strength: tuple[int, float] = TITLE
    base: bool = False

    @property
    def literal(self) -> str:
        """The keyword as it stands in a prepared text, where each word has a space of its own on either side."""
        return " " + self.keyword.replace(" ", "  ")

    @property
    def expression(self) -> str:
        """The pattern likewise: a match takes whole words, and neighbours share no space."""
        return " (?:" + self.pattern.replace(" ", "  ") + ") "


# Phrases that the contract of the query names.
BASE = (
    Rule("gpl", "general public license", "gnu general public license", base=True),
    Rule("apache", "apache license", "apache license", base=True),
    Rule("cc-by", "cc by", "cc by", base=True),
    Rule("mit", "mit license", "mit license", base=True),
)

#: Licenses with versions: label, short name, keyword and pattern of the title, versions.
FAMILIES = (
    ("gpl", "gpl", "general public licen", "gnu general public licen[cs]e", "1.0 2.0 3.0"),
    ("lgpl", "lgpl", "general public licen", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "2.0 2.1 3.0"),
    ("agpl", "agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "1.0 3.0"),
    ("gfdl", "gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("apache", "apache", "apache", "apache (?:software )?licen[cs]e", "1.0 1.1 2.0"),
    ("mpl", "mpl", "mozilla public", "mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("epl", "epl", "eclipse public", "eclipse public licen[cs]e", "1.0 2.0"),
    ("cddl", "cddl", "common development and", "common development and distribution licen[cs]e", "1.0 1.1"),
    ("cpl", "cpl", "common public licen", "common public licen[cs]e", "1.0"),
    ("eupl", "eupl", "european union public", "european union public licen[cs]e", "1.0 1.1 1.2"),
    ("osl", "osl", "open software licen", "open software licen[cs]e", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "afl", "academic free", "academic free licen[cs]e", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", "artistic", "(?:perl )?artistic licen[cs]e", "1.0 2.0"),
    ("bsl", "bsl", "boost software", "boost software licen[cs]e", "1.0"),
    ("busl", "busl", "business source", "business source licen[cs]e", "1.0 1.1"),
    ("cecill", "cecill", "cecill", "cecill(?: b| c)?(?: free software)? licen[cs]e(?: agreement)?", "1.0 1.1 2.0 2.1"),
    ("lppl", "lppl", "latex project", "latex project public licen[cs]e", "1.0 1.1 1.2 1.3"),
    ("ofl", "ofl", "open font", "(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("odbl", "odbl", "open database", "open database licen[cs]e", "1.0"),
    ("odc-by", "odc by", "open data commons", "open data commons attribution licen[cs]e", "1.0"),
    ("pddl", "pddl", "public domain dedication", "public domain dedication and licen[cs]e", "1.0"),
    ("zpl", "zpl", "zope public", "zope public licen[cs]e", "1.1 2.0 2.1"),
    ("psf", "psf", "python software foundation", "python software foundation licen[cs]e(?: agreement)?", "2.0"),
    ("ecl", "ecl", "educational community", "educational community licen[cs]e", "1.0 2.0"),
    ("upl", "upl", "universal permissive", "universal permissive licen[cs]e", "1.0"),
    ("ipl", "ipl", "ibm public", "ibm public licen[cs]e", "1.0"),
    ("apsl", "apsl", "apple public source", "apple public source licen[cs]e", "1.0 1.1 1.2 2.0"),
    ("npl", "npl", "netscape public", "netscape public licen[cs]e", "1.0 1.1"),
    ("spl", "spl", "sun public", "sun public licen[cs]e", "1.0"),
    ("qpl", "qpl", "q public", "q public licen[cs]e", "1.0"),
    ("rpl", "rpl", "reciprocal public", "reciprocal public licen[cs]e", "1.1 1.5"),
    ("sspl", "sspl", "server side public", "server side public licen[cs]e", "1.0"),
    ("elastic", "elastic", "elastic licen", "elastic licen[cs]e", "1.0 2.0"),
    ("php", "php", "php licen", "php licen[cs]e", "3.0 3.01"),
    ("mulanpsl", "mulanpsl", "mulan", "mulan (?:permissive software licen[cs]e|psl)", "1.0 2.0"),
    ("cpal", "cpal", "common public attribution", "common public attribution licen[cs]e", "1.0"),
    ("nasa", "nasa", "nasa open source", "nasa open source agreement", "1.3"),
    ("oclc", "oclc", "oclc research", "oclc research public licen[cs]e", "2.0"),
    ("osset", "osset", "osset public", "osset public licen[cs]e", "2.1"),
    ("polyform-nc", "polyform noncommercial", "polyform", "polyform noncommercial licen[cs]e", "1.0.0"),
    ("cc0", "cc0", "cc0", "(?:creative commons )?cc0(?: public domain dedication)?", "1.0"),
)

#: Parts that Creative Commons names are put together from, short and long.
CC_PARTS = {"sa": "share(?: )?alike", "nd": "no(?: )?deriv(?:ative)?s?(?: works)?", "nc": "non(?: )?commercial"}
CC = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

_AS_IS = "(?:this|the) software is provided (?:by [^ ]+(?: [^ ]+){0,6} )?as is"
#: Titles, notices and clues of other licenses, in order: of two detections of the same words the first stays.
SIGNATURES = (
    # Notices: sentences that put a text under a license.
    Rule("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", NOTICE),
    Rule("mit", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", NOTICE),
    Rule("mit", "shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", NOTICE),
    Rule("mit-0", "mit no attribution", "mit no attribution(?: licen[cs]e)?", NOTICE),
    Rule("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", NOTICE),
    Rule("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted", NOTICE),
    Rule("bsd-2-clause", "clause bsd", "(?:2|two) clause bsd(?: licen[cs]e)?", NOTICE),
    Rule("bsd-2-clause", "bsd 2 clause", "bsd 2 clause(?: licen[cs]e)?", NOTICE),
    Rule("bsd-2-clause", "simplified bsd", "simplified bsd(?: licen[cs]e)?", NOTICE),
    Rule("bsd-2-clause", "freebsd licen", "freebsd licen[cs]e", NOTICE),
    Rule("bsd-3-clause", "clause bsd", "(?:3|three) clause bsd(?: licen[cs]e)?", NOTICE),
    Rule("bsd-3-clause", "bsd 3 clause", "bsd 3 clause(?: licen[cs]e)?", NOTICE),
    Rule("bsd-3-clause", "bsd licen", "(?:new|modified|revised) bsd licen[cs]e", NOTICE),
    Rule("bsd-3-clause", "contributors may be used", "neither the names? of [^ ]+(?: [^ ]+){0,12} contributors may be used to endorse or promote products", NOTICE),
    Rule("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display", NOTICE),
    Rule("bsd-4-clause", "clause bsd", "(?:4|four) clause bsd(?: licen[cs]e)?", NOTICE),
    Rule("bsd-4-clause", "bsd licen", "(?:original|old) bsd licen[cs]e", NOTICE),
    Rule("0bsd", "clause bsd", "(?:0|zero) clause bsd(?: licen[cs]e)?", NOTICE),
    Rule("apache-2.0", "in compliance with the license", "you may not use this file except in compliance with the license", NOTICE),
    Rule("apache-2.0", "distributed under the license is", "software distributed under the license is distributed on an as is basis", NOTICE),
    Rule("gpl", "free software foundation", "under the terms of the gnu general public licen[cs]e as published by the free software foundation", NOTICE),
    Rule("lgpl", "free software foundation", "under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation", NOTICE),
    Rule("agpl", "free software foundation", "under the terms of the gnu affero general public licen[cs]e as published by the free software foundation", NOTICE),
    Rule("gpl-or-later", "any later version", "either version [123](?: 0)? of the licen[cs]e or(?: at your option)? any later version", NOTICE),
    Rule("gpl", "fitness for a particular purpose", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e", NOTICE),
    Rule("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", NOTICE),
    Rule("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", NOTICE),
    Rule("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain", NOTICE),
    Rule("zlib", "in no event will the authors", "in no event will the authors be held liable for any damages arising from the use of this software", NOTICE),
    Rule("json", "for good not evil", "the software shall be used for good not evil", NOTICE),
    Rule("beerware", "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer", NOTICE),
    Rule("wtfpl", "do what the fuck", "do what the fuck you want to(?: public licen[cs]e)?", NOTICE),
    Rule("boost", "obtaining a copy of the software", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", NOTICE),
    Rule("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", NOTICE),
    Rule("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", NOTICE),
    Rule("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group", NOTICE),
    Rule("artistic", "same terms as perl", "(?:this|it) (?:is|program is|library is) free software you (?:can|may) redistribute it and or modify it under the same terms as perl itself", NOTICE),
    Rule("public-domain", "public domain", "(?:is|are|was|were|been|hereby) (?:released|dedicated|placed|put) (?:in(?: )?to|in|to) the public domain", NOTICE),
    Rule("public-domain", "public domain", "no copyright(?: [^ ]+){0,4} public domain", NOTICE),
    Rule("proprietary", "proprietary and confidential", "proprietary and confidential", NOTICE),
    Rule("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)(?: [^ ]+){0,12} is strictly prohibited", NOTICE),
    Rule("proprietary", "licensed not sold", "(?:this|the) (?:software|product) is licensed not sold", NOTICE),
    Rule("non-commercial", "use only", "(?:for )?non(?: )?commercial use only", NOTICE),
    Rule("non-commercial", "commercial use", "(?:not for|no) commercial use", NOTICE),
    Rule("eula", "end user license", "end user licen[cs]e agreement", NOTICE),
    # Titles.
    Rule("mit", "mit ", "(?:the )?mit(?: x11| expat)? licen[cs]e", TITLE),
    Rule("mit", "expat", "expat licen[cs]e", TITLE),
    Rule("mit", "x11", "x11 licen[cs]e", TITLE),
    Rule("isc", "isc licen", "isc licen[cs]e", TITLE),
    Rule("bsd", "bsd ", "(?:the )?bsd(?: style)? licen[cs]e", TITLE),
    Rule("bsd", "berkeley software", "berkeley software distribution licen[cs]e", TITLE),
    Rule("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", TITLE),
    Rule("libpng", "libpng licen", "libpng licen[cs]e", TITLE),
    Rule("unlicense", "unlicense", "(?:the )?unlicense", TITLE),
    Rule("wtfpl", "wtfpl", "wtfpl", TITLE),
    Rule("openssl", "openssl licen", "openssl licen[cs]e", TITLE),
    Rule("postgresql", "postgresql licen", "postgresql licen[cs]e", TITLE),
    Rule("vim", "vim licen", "vim licen[cs]e", TITLE),
    Rule("ruby", "ruby licen", "ruby licen[cs]e", TITLE),
    Rule("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", TITLE),
    Rule("w3c", "w3c", "w3c software(?: notice and)? licen[cs]e", TITLE),
    Rule("curl", "curl licen", "curl licen[cs]e", TITLE),
    Rule("icu", "icu licen", "icu licen[cs]e", TITLE),
    Rule("unicode", "unicode", "unicode(?: inc)? licen[cs]e agreement", TITLE),
    Rule("ftl", "freetype", "freetype(?: project)? licen[cs]e", TITLE),
    Rule("tcl", "tcl tk licen", "tcl tk licen[cs]e", TITLE),
    Rule("sleepycat", "sleepycat", "sleepycat licen[cs]e", TITLE),
    Rule("blueoak-1.0.0", "blue oak", "blue oak model licen[cs]e", TITLE),
    Rule("ms-pl", "microsoft public", "microsoft public licen[cs]e", TITLE),
    Rule("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", TITLE),
    Rule("openrail", "open", "(?:creativeml |bigscience )?open(?: )?rail(?: m)?(?: licen[cs]e)?", TITLE),
    Rule("llama-community", "llama", "llama(?: [23])? community licen[cs]e(?: agreement)?", TITLE),
    Rule("ogl", "open government", "open government licen[cs]e", TITLE),
    Rule("cdla", "community data license", "community data license agreement", TITLE),
    Rule("fair-source", "fair source", "fair source licen[cs]e", TITLE),
    Rule("commons-clause", "commons clause", "commons clause(?: licen[cs]e condition)?", TITLE),
    Rule("creative-commons", "creative commons", "creative commons(?: licen[cs]e)?", TITLE),
    # Clues: a license is spoken of, or rights are claimed.
    Rule("free-restricted", "all rights reserved", "all rights reserved", CLUE),
    Rule("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]", CLUE),
    Rule("copyright", "droits", "tous droits réservés", CLUE),
    Rule("copyright", "alle rechte", "alle rechte vorbehalten", CLUE),
    Rule("copyright", "todos los derechos", "todos los derechos reservados", CLUE),
    Rule("warranty-disclaimer", "provided", _AS_IS, CLUE),
    Rule("license-notice", "licensed under", "(?:is |are )?(?:dual )?licensed under(?: the)?(?: terms of)?", CLUE),
    Rule("license-notice", "released under", "released under(?: the)?(?: terms of)?", CLUE),
    Rule("license-notice", "distributed under", "distributed under(?: the)?(?: terms of)?", CLUE),
    Rule("license-notice", "available under", "(?:made )?available under(?: the)?(?: terms of)?", CLUE),
    Rule("license-notice", "licen", "see(?: the)? licen[cs]e(?: file)?(?: for(?: more)? details)?", CLUE),
    Rule("license-notice", "sous licence", "(?:publié|distribué|diffusé)e?s? sous(?: la)? licence", CLUE),
    Rule("license-notice", "lizenz", "(?:unter|gemäß) der [^ ]+(?: [^ ]+){0,3} lizenz", CLUE),
    Rule("license-notice", "lizenziert", "lizenziert unter", CLUE),
    Rule("license-notice", "licencia", "(?:bajo|según) (?:la|una) licencia", CLUE),
    Rule("third-party-notice", "third party", "third party (?:licen[cs]es|notices)", CLUE),
)


def _number(version: str) -> str:
    """Words of a version: 2.0 may be written as 2, and v may stand before it."""
    parts = version.split(".")
    whole = parts[0] + ("(?: 0){0,%d}" % (len(parts) - 1) if not any(int(x) for x in parts[1:]) else "".join(f" {x}" for x in parts[1:]))
    return f"(?:version |ver |v )?v?{whole}"


def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, tags and titles of every version, then other signatures."""
    out = [*BASE]
    for label, short, keyword, title, versions in FAMILIES:
        for version in versions.split():
            number, name = _number(version), f"{label}-{version}"
            out.append(Rule(name, "spdx license identifier", f"spdx license identifier {short} {number}(?: only)?", TAG))
            out.append(Rule(f"{name}-or-later", "later", f"(?:spdx license identifier )?(?:{short}|{title}) {number} or(?: any)? later(?: version)?", TAG))
            out.append(Rule(name, keyword, f"{title} {number}", NOTICE))
            first = version.split(".")[0]
            out.append(Rule(name, f"{short} ", f"{short} {number}" if label not in ("apache", "elastic", "php") else f"{short} {number} licen[cs]e", NOTICE))
            if label in ("gpl", "lgpl", "agpl"):
                out.append(Rule(name, f"{short}v{first}", f"{short}v{version.removesuffix('.0').replace('.', ' ')}(?: 0)?", NOTICE))
        out.append(Rule(label, keyword, title, TITLE))
    for parts in CC:
        short = " ".join(("cc", *parts))
        long_ = "(?:creative commons )?attribution" + "".join(f" {CC_PARTS[p]}" for p in parts[1:])
        for version in CC_VERSIONS.split():
            name = "-".join(("cc", *parts, version))
            out.append(Rule(name, "cc by", f"{short} {_number(version)}", NOTICE))
            out.append(Rule(name, "attribution", f"{long_} {_number(version)}", NOTICE))
            out.append(Rule(name, "licenses", f"creativecommons org licenses {' '.join(parts)} {version.replace('.', ' ')}", TAG))
        out.append(Rule("-".join(("cc", *parts)), "cc by", short, TITLE))
        if len(parts) > 1:
            out.append(Rule("-".join(("cc", *parts)), "attribution", long_, TITLE))
    return (*out, *SIGNATURES)


class Scanner:
    """Rules by keyword, compiled when a text first holds the keyword."""

    def __init__(self, table: Sequence[Rule]) -> None:
        self.table = list(table)
        self.by: dict[bytes, list[int]] = {}
        for i, rule in enumerate(self.table):
            self.by.setdefault(rule.literal.encode(), []).append(i)
        self.compiled: dict[int, re.Pattern[bytes]] = {}

    def matches(self, body: bytes) -> list[tuple[int, int, int]]:
        """(first word, past the last word, rule) of every match of a rule whose keyword the prepared text holds."""
        out = []
        for literal, places in self.by.items():
            if literal in body:
                for i in places:
                    expression = self.compiled.get(i) or self.compiled.setdefault(i, re.compile(self.table[i].expression.encode()))
                    at = words = 0
                    for m in expression.finditer(body):
                        first = words + body.count(b" ", at, m.start()) // 2
                        words, at = first + body.count(b" ", m.start(), m.end()) // 2, m.end()
                        out.append((first, words, i))
        return out

    def kept(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Matches that no other suppresses.

        A match goes if another covers its words and has a higher priority, or the same priority and more
        words, or both the same and stands earlier in the table. Base phrases always stay.
        """
        rank = lambda x: (x[0], -x[1], -self.table[x[2]].strength[0], x[2])
        furthest: dict[int, int] = {}  # by priority, of the matches that start no later
        out = []
        for first, end, i in sorted(found, key=rank):
            rule = self.table[i]
            if rule.base or all(furthest.get(p, 0) < end for p in furthest if p >= rule.strength[0]):
                out.append((first, end, i))
            furthest[rule.strength[0]] = max(end, furthest.get(rule.strength[0], 0))
        return out


_HIT = T.ArrayType(
    T.StructType(
        [T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("rule", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("sure", T.DoubleType())]
    )
)


def scan(docs: DataFrame, table: Sequence[Rule] | None = None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep` of docs with n_words and hits: (first, end, label, rule, base, sure) of what the rules find.

    Words are counted from 0; end is past the last. hits are in order of first word. One pass over the
    texts without a shuffle; rules travel with the tasks. A text takes time in proportion to its length,
    however many hits it has. Null and empty texts have no words; one row per document, repeated rows
    included; an empty table gives no rows. Kept columns named like an added one come back as in_<name>.
    """
    table = tuple(rules() if table is None else table)
    added = ("n_words", "hits")
    names = [f"in_{c}" if c in added else c for c in keep]
    packed = docs.select(F.struct(*(docs[f"`{c}`"].alias(n) for c, n in zip(keep, names, strict=True))).alias("row"), docs[f"`{text}`"].alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table)
        kinds = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.int32()), ("base", pa.bool_()), ("sure", pa.float64())]))
        for batch in batches:
            sizes, hits = [], []
            for value in batch.column(1).cast(pa.binary()):
                words = (value.as_py() or b"").translate(_FOLD).split()
                found = scanner.kept(scanner.matches(b" " + b"  ".join(words) + b" "))
                sizes.append(len(words))
                hits.append([(first, end, (r := table[i]).label, i, r.base, r.strength[1]) for first, end, i in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hits, kinds)], ["row", *added])

    schema = T.StructType([packed.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("hits", _HIT)])
    found = packed.mapInArrow(search, schema)
    return found.select(*(F.col("row").getField(n).alias(n) for n in names), *added)


def digest(found: DataFrame) -> DataFrame:
    """Counts, labels and score of scan()'s rows.

    The score is the chance that one of the labels is right: labels are taken for independent, each as
    sure as its surest hit.
    """
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["first"])
    labels = lambda hits: F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"])))
    surest = lambda label: F.array_max(F.transform(F.filter("hits", lambda h: h["label"] == label), lambda h: h["sure"]))
    score = 1 - F.aggregate(F.col("all"), F.lit(1.0), lambda s, label: s * (1 - surest(label)))
    rows = found.withColumns({"all": labels(F.col("hits")), "starts": starts})
    return rows.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join(labels(base), ",").alias("base_labels"),
        F.array_join("all", ",").alias("labels"),
        score.alias("score"),
    )
