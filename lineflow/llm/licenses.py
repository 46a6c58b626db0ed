"""License scan: ordered signature rules over the words of a text, gated by keywords, overlaps resolved.

A text is lower-cased (A-Z) and taken as words of letters, digits and everything beyond ASCII.  A rule is a regular
expression over words with single blanks between them; it is tried only where its first word stands, and only in texts
that hold one of the keywords.  Rules have a class (1 tags and notices, 2 names, 3 mentions) and stand in order.

Where several rules match at a word, the longest wins, the earlier one among equals.  Of detections at different words,
one inside another goes, and one that overlaps a detection of a lower class goes.  What is left gives the labels.

Built-in functions only: a text is scanned where it is read, nothing is shuffled.  Detections are resolved by looking at
WINDOW neighbours, so the work grows with the text, not with its square.

Defined results: null texts are empty and hold nothing; other columns pass through, a clashing one called `licenses` is
replaced by the result (`into` names another); repeated rows are scanned each; an empty table gives none.  A text that holds
a keyword is held as an array of words while it is scanned.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a rule looks at, at the most.
WINDOW = 24
#: Every rule needs one of these substrings.
KEYWORDS = ("licen", "gpl", "spdx", "copyleft", "domain", "commons", "creative", "permission", "redistribut", "cc", "wtf", "copyright", "warrant")
#: Weight of a detection by class: the score is one less the product of what they leave.
WEIGHTS = {1: 0.9, 2: 0.75, 3: 0.4}

#: Fixed values of the operator: phrases and labels that are always reported.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label | identifier in words | names and headers (class 2), `;` between them | mentions (class 3)
LICENSES = """
gpl-1.0 | gpl 1 0(?: only| or later)? | gnu general public license (?:version |v)1(?: 0)? ; gnu gpl (?:version |v)1(?: 0)? ; gplv1 |
gpl-2.0 | gpl 2 0(?: only| or later)? | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)? ; gnu gpl (?:version |v)2(?: 0)? ; gplv2 ; gpl (?:version |v)2(?: 0)? |
gpl-3.0 | gpl 3 0(?: only| or later)? | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)? ; gnu gpl (?:version |v)3(?: 0)? ; gplv3 ; gpl (?:version |v)3(?: 0)? |
gpl | gpl | free software you can redistribute it and or modify it under the terms of the gnu general public license ; gnu public license ; gnu copyleft license | gnu general public licen[sc]e ; gnu gpl ; gpl licen[sc]ed
lgpl-2.0 | lgpl 2 0(?: only| or later)? | gnu library general public license (?:version |v)2(?: 0)? ; gnu lgpl (?:version |v)2(?: 0)? ; lgplv2 |
lgpl-2.1 | lgpl 2 1(?: only| or later)? | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)2 1 ; gnu lgpl (?:version |v)2 1 ; lgpl (?:version |v)2 1 |
lgpl-3.0 | lgpl 3 0(?: only| or later)? | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)? ; gnu lgpl (?:version |v)3(?: 0)? ; lgplv3 |
lgpl | lgpl | free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license | gnu lesser general public licen[sc]e ; gnu library general public licen[sc]e ; gnu lgpl ; lgpl licen[sc]ed
agpl-3.0 | agpl 3 0(?: only| or later)? | gnu affero general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)? ; gnu agpl (?:version |v)3(?: 0)? ; agplv3 | gnu affero general public licen[sc]e ; affero general public licen[sc]e ; gnu agpl
gfdl | gfdl 1 [123](?: only| or later| invariants only)? | gnu free documentation license(?: version| v)? 1 [0-3] ; gfdl licen[sc]ed | gnu free documentation licen[sc]e
classpath-exception | gpl 2 0(?: only| or later)? with classpath exception 2 0 | linking this library statically or dynamically with other modules is making a combined work based on this library copyright | gpl with classpath exception
apache-1.0 | apache 1 0 | apache (?:software )?license (?:version |v)?1 0 |
apache-1.1 | apache 1 1 | apache (?:software )?license (?:version |v)?1 1 |
apache-2.0 | apache 2 0 | apache (?:software )?license (?:version |v)?2(?: 0)? ; apache org licenses license 2 0 ; apache 2(?: 0)? licen[sc]e ; asl 2 0 licen[sc]e | apache (?:software )?licen[sc]e ; apache licen[sc]ed
llvm-exception | apache 2 0 with llvm exception | apache license v?(?:ersion )?2 0 with llvm exceptions? |
mit | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ; opensource org licenses mit(?: license)?(?: php)? ; expat license ; mit x11 license ; mit expat licen[sc]e | mit licen[sc]ed? ; mit style licen[sc]e
mit-0 | mit 0 | mit no attribution(?: license)? ; mit 0 license |
x11 | x11 | x11 license ; x consortium license | x11 style licen[sc]e
isc | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted ; isc license ; internet systems consortium license | isc licen[sc]ed
bsd-0 | 0bsd | zero clause bsd license ; bsd zero clause license ; 0bsd license |
bsd-2-clause | bsd 2 clause(?: patent| views)? | simplified bsd license ; bsd 2 clause license ; 2 clause bsd(?: license)? ; two clause bsd(?: license)? ; freebsd license |
bsd-3-clause | bsd 3 clause(?: clear| attribution| lbnl)? | new bsd license ; modified bsd license ; revised bsd license ; bsd 3 clause license ; 3 clause bsd(?: license)? ; three clause bsd(?: license)? |
bsd-4-clause | bsd 4 clause(?: uc)? | original bsd license ; bsd 4 clause license ; 4 clause bsd(?: license)? ; four clause bsd(?: license)? ; all advertising materials mentioning features or use of this software must display the following acknowledgement copyright |
bsd | bsd | redistribution and use in source and binary forms with or without modification are permitted ; bsd license | bsd style licen[sc]e ; bsd licen[sc]ed
mpl-1.0 | mpl 1 0 | mozilla public license (?:version |v)?1 0 ; mplv1 0 license |
mpl-1.1 | mpl 1 1 | mozilla public license (?:version |v)?1 1 ; mozilla org mpl mpl 1 1 html license |
mpl-2.0 | mpl 2 0(?: no copyleft exception)? | mozilla public license (?:version |v)?2(?: 0)? ; mpl (?:version |v)?2 0 license ; mozilla org mpl 2 0 license | mozilla public licen[sc]e
epl-1.0 | epl 1 0 | eclipse public license (?:version |v)?1 0 ; eclipse org legal epl v10 license |
epl-2.0 | epl 2 0 | eclipse public license (?:version |v)?2(?: 0)? ; eclipse org legal epl (?:2 0|v20) license | eclipse public licen[sc]e
edl-1.0 | bsd 3 clause eclipse | eclipse distribution license(?: version| v)?(?: 1 0)? |
cddl-1.0 | cddl 1 0 | common development and distribution license (?:version |v)?1 0 ; cddl (?:version |v)?1 0 license |
cddl-1.1 | cddl 1 1 | common development and distribution license (?:version |v)?1 1 ; cddl (?:version |v)?1 1 license | common development and distribution licen[sc]e ; cddl licen[sc]ed?
cpl-1.0 | cpl 1 0 | common public license(?: version| v)?(?: 1 0)? |
ipl-1.0 | ipl 1 0 | ibm public license(?: version| v)?(?: 1 0)? |
cc0-1.0 | cc0 1 0 | cc0 1 0(?: universal)? ; creative commons zero(?: v?1 0)?(?: universal)? ; creativecommons org publicdomain zero 1 0 | cc0 licen[sc]ed? ; cc zero
cc-by-1.0 | cc by 1 0 | cc by 1 0 ; creative commons attribution 1 0 ; creativecommons org licenses by 1 0 |
cc-by-2.0 | cc by 2 [05] | cc by 2 [05] ; creative commons attribution 2 [05] ; creativecommons org licenses by 2 [05] |
cc-by-3.0 | cc by 3 0(?: us| de| igo)? | cc by 3 0 ; creative commons attribution 3 0 ; creativecommons org licenses by 3 0 |
cc-by-4.0 | cc by 4 0 | cc by 4 0 ; creative commons attribution 4 0(?: international)? ; creativecommons org licenses by 4 0 |
cc-by | cc by | creative commons attribution licen[sc]e | cc by ; creative commons attribution
cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0 ; creative commons attribution share ?alike 3 0 ; creativecommons org licenses by sa 3 0 |
cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0 ; creative commons attribution share ?alike 4 0(?: international)? ; creativecommons org licenses by sa 4 0 |
cc-by-sa | cc by sa(?: [12] [05])? | creative commons attribution share ?alike licen[sc]e | cc by sa ; creative commons attribution share ?alike
cc-by-nd | cc by nd(?: [1-4] [05])? | cc by nd [1-4] [05] ; creative commons attribution no ?deriv(?:ative)?s?(?: works)? [1-4] [05] ; creativecommons org licenses by nd [1-4] [05] | cc by nd
cc-by-nc-3.0 | cc by nc 3 0 | cc by nc 3 0 ; creative commons attribution non ?commercial 3 0 ; creativecommons org licenses by nc 3 0 |
cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0 ; creative commons attribution non ?commercial 4 0(?: international)? ; creativecommons org licenses by nc 4 0 |
cc-by-nc | cc by nc(?: [12] [05])? | creative commons attribution non ?commercial licen[sc]e | cc by nc ; creative commons attribution non ?commercial
cc-by-nc-sa | cc by nc sa(?: [1-4] [05])? | cc by nc sa [1-4] [05] ; creative commons attribution non ?commercial share ?alike [1-4] [05](?: international)? ; creativecommons org licenses by nc sa [1-4] [05] | cc by nc sa
cc-by-nc-nd | cc by nc nd(?: [1-4] [05])? | cc by nc nd [1-4] [05] ; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? [1-4] [05](?: international)? ; creativecommons org licenses by nc nd [1-4] [05] | cc by nc nd
public-domain | pddl 1 0 | released into the public domain ; dedicated to the public domain ; placed in the public domain ; public domain dedication(?: and license)? | public domain licen[sc]e
unlicense | unlicense | free and unencumbered software released into the public domain ; unlicense org ; the unlicense | unlicensed software
wtfpl | wtfpl | do what the fuck you want to public license ; wtfpl license ; wtfpl (?:version |v)?2 | wtfpl
zlib | zlib(?: acknowledgement)? | permission is granted to anyone to use this software for any purpose including commercial applications ; zlib libpng license ; zlib license | zlib licen[sc]ed
libpng | libpng(?: 2 0)? | libpng license(?: version 2)? ; png reference library license |
boost-1.0 | bsl 1 0 | boost software license(?: version| v)?(?: 1 0)? ; boost org license 1 0(?: txt)? | boost licen[sc]ed?
artistic-1.0 | artistic 1 0(?: perl| cl8)? | artistic license (?:version |v)?1 0 |
artistic-2.0 | artistic 2 0 | artistic license (?:version |v)?2(?: 0)? | artistic licen[sc]e ; perl licen[sc]e
python-2.0 | python 2 0(?: 1)? | python software foundation license(?: version| v)?(?: 2)? ; psf license(?: agreement)?(?: version 2)? ; psf 2 0 license |
ruby | ruby | ruby license ; rubys license | same license as ruby
php-3.01 | php 3 0(?:1)? | php license(?: version| v)?(?: 3(?: 01| 0)?)? | php licen[sc]ed
openssl | openssl | openssl license ; openssl ssleay license ; ssleay license |
ofl-1.1 | ofl 1 [01](?: rfn| no rfn)? | sil open font license(?: version| v)?(?: 1 [01])? ; ofl 1 1 license ; scripts sil org ofl license | open font licen[sc]e
eupl-1.1 | eupl 1 [01] | european union public licen[cs]e (?:version |v)?1 1 ; eupl (?:version |v)?1 1 licen[cs]e |
eupl-1.2 | eupl 1 2 | european union public licen[cs]e (?:version |v)?1 2 ; eupl (?:version |v)?1 2 licen[cs]e | european union public licen[cs]e
cecill | cecill(?: [bc]| 2 [01]| 1 [01])? | cecill (?:free software )?license(?: agreement)?(?: version)?(?: 2(?: 1)?)? ; cecill [bc] licen[cs]e |
ms-pl | ms pl | microsoft public license ; ms pl license |
ms-rl | ms rl | microsoft reciprocal license ; ms rl license |
afl-3.0 | afl [123] [01] | academic free license(?: version| v)?(?: [123] [01])? |
osl-3.0 | osl [123] [01] | open software license(?: version| v)?(?: [123] [01])? |
ecl-2.0 | ecl [12] 0 | educational community license(?: version| v)?(?: [12] 0)? |
ncsa | ncsa | university of illinois ncsa open source license ; illinois ncsa open source license |
postgresql | postgresql | postgresql licen[cs]e ; permission to use copy modify and distribute this software and its documentation for any purpose without fee |
odbl-1.0 | odbl 1 0 | open database license(?: version| v)?(?: 1 0)? ; opendatacommons org licenses odbl | odbl licen[sc]ed?
odc-by-1.0 | odc by 1 0 | open data commons attribution license(?: v?1 0)? ; opendatacommons org licenses by |
bsl-1.1 | busl 1 1 | business source license(?: version)?(?: 1 1)? | business source licen[sc]e
sspl-1.0 | sspl 1 0 | server side public license(?: version| v)?(?: 1)? ; sspl licen[sc]ed |
elastic-2.0 | elastic 2 0 | elastic license(?: version| v)?(?: 2(?: 0)?)? |
commons-clause | commons clause | commons clause license condition(?: v1 0)? | commons clause
upl-1.0 | upl 1 0 | universal permissive license(?: version| v)?(?: 1 0)? |
qpl-1.0 | qpl 1 0 | q public license(?: version| v)?(?: 1 0)? |
vim | vim | vim license |
w3c | w3c(?: 19980720| 20150513)? | w3c software (?:notice )?(?:and )?license ; w3c software and document license |
unicode | unicode (?:3 0|dfs 201[56]|tou) | unicode license v3 ; unicode inc license agreement data files and software |
openrail | openrail | creativeml open rail m license ; bigscience rail license(?: v1 0)? ; open rail m license ; openrail licen[sc]e |
llama | llama[234] | llama (?:2|3|3 1|4) community license(?: agreement)? ; llama community license agreement |
proprietary | licenseref proprietary | all rights reserved copyright ; proprietary and confidential copyright ; unpublished copyright work | proprietary licen[sc]e ; commercial licen[sc]e ; copyright all rights reserved
"""


def rules() -> list[tuple[str, int, str]]:
    """(label, class, regular expression over words) in order: tags, notices, names, mentions."""
    tags, notices, names, mentions = [], [], [], []
    for row in LICENSES.strip().splitlines():
        label, tag, full, bare = _cells(row)
        tags.append((label, 1, f"spdx license identifier (?:{tag})"))
        full, bare = ([x.strip() for x in cell.split(" ; ") if x.strip()] for cell in (full, bare))
        named = [x for x in [*full, *bare] if len(re.sub(r"\([^()]*\)", "", x).split()) < 9]
        notices.append((label, 1, f"under (?:the )?(?:terms of (?:the )?)?(?:{'|'.join(named)})"))
        notices.append((label, 1, f"licensed under (?:the )?(?:{tag})(?: licen[sc]e)?"))
        notices.append((label, 1, f"license (?:{tag})"))
        names += [(label, 2, x) for x in full]
        mentions += [(label, 3, x) for x in bare]
    return [*tags, *notices, *names, *mentions]


def _cells(row: str) -> list[str]:
    """The four cells of a row; a bar inside brackets is no border."""
    return [x.strip() for x in re.split(r"\|(?![^(]*\))", row)]


RULES = rules()


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _gate(text: Column) -> Column:
    """Whether a text holds a keyword; a superset of what any rule or base phrase needs."""
    low = F.lower(text)
    found = F.lit(False)
    for k in KEYWORDS:
        found = found | F.contains(low, F.lit(k))
    return F.coalesce(found, F.lit(False))


def first_word(rule: str) -> str:
    return re.match(r"[a-z0-9]+", rule)[0]


def _signatures() -> Column:
    """First word -> its rules in order, one constant map; the pattern of a rule is a value, not a part of the plan."""
    of: dict[str, list] = {}
    for order, (label, kind, rule) in enumerate(RULES):
        of.setdefault(first_word(rule), []).append({"order": -order, "kind": kind, "label": label, "rule": f"^(?:{rule}) "})
    return F.from_json(F.lit(json.dumps(of)), "map<string,array<struct<order:int,kind:int,label:string,rule:string>>>")


def _detections(words: Column) -> Column:
    """One detection per word at the most, in order of words: the longest match there, the earlier rule among equals."""
    rules, firsts = _signatures(), sorted({first_word(r) for _, _, r in RULES})

    def at(word: Column, i: Column) -> Column:
        def tried(window: Column) -> Column:
            def match(rule: Column) -> Column:
                size = lambda whole: F.length(whole) - F.length(F.replace(whole, F.lit(" "), F.lit("")))
                found = lambda whole: F.when(whole.isNotNull(), F.struct(size(whole).alias("n"), rule["order"].alias("order"), rule["kind"].alias("kind"), rule["label"].alias("label"), i.cast("long").alias("start")))
                return _let(F.regexp_substr(window, rule["rule"]), found)

            return F.array_max(F.transform(F.try_element_at(rules, word), match))

        return F.when(word.isin(firsts), _let(F.concat(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " "), F.lit(" ")), tried))

    return F.filter(F.transform(words, at), lambda d: d.isNotNull())


def _resolved(found: Column) -> Column:
    """Detections that no neighbour suppresses."""

    def keep(x: Column, i: Column) -> Column:
        def beats(y: Column) -> Column:
            end = lambda d: d["start"] + d["n"]
            inside = (y["start"] <= x["start"]) & (end(y) >= end(x)) & (y["n"] > x["n"])
            overlaps = (y["start"] < end(x)) & (x["start"] < end(y)) & (y["kind"] < x["kind"])
            return inside | overlaps

        return ~F.exists(F.slice(found, F.greatest(i - WINDOW + 1, F.lit(1)), F.lit(2 * WINDOW)), beats)

    return F.filter(found, keep)


def _base(words: Column) -> Column:
    """(start, label) of every place of a base phrase."""
    phrases = {tuple(p.split()): label for p, label in BASE.items()}

    def at(word: Column, i: Column) -> Column:
        out = None
        for p, label in phrases.items():
            here = word == p[0]
            for k, w in enumerate(p[1:], 1):
                here = here & (F.get(words, i + k) == w)
            got = F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))
            out = F.when(here, got) if out is None else out.when(here, got)
        return out

    return F.filter(F.transform(words, at), lambda d: d.isNotNull())


RESULT = "struct<base:array<struct<start:bigint,label:string>>,found:array<struct<start:bigint,end:bigint,label:string,kind:int,rule:int>>>"


def scan(docs: DataFrame, into: str = "licenses") -> DataFrame:
    """Every column of docs and `into`: base places and resolved detections, starts and ends in words, ends exclusive."""

    def of(words: Column) -> Column:
        seen = lambda d: F.struct(d["start"].alias("start"), (d["start"] + d["n"]).alias("end"), d["label"].alias("label"), d["kind"].alias("kind"), (-d["order"]).alias("rule"))
        return F.struct(_base(words).alias("base"), _let(_detections(words), lambda found: F.transform(_resolved(found), seen)).alias("found"))

    nothing = F.struct(F.array().cast("array<struct<start:bigint,label:string>>").alias("base"), F.array().cast("array<struct<start:bigint,end:bigint,label:string,kind:int,rule:int>>").alias("found"))
    return docs.withColumn(into, F.when(_gate(F.col("text")), _let(_words(F.col("text")), of).cast(RESULT)).otherwise(nothing.cast(RESULT)))


def score(found: Column) -> Column:
    """Confidence that a text speaks of a license, from the classes of its detections."""
    left = lambda k: F.pow(F.lit(1 - WEIGHTS[k]), F.size(F.filter(found, lambda d: d["kind"] == k)).cast("double"))
    return F.lit(1.0) - left(1) * left(2) * left(3)


def digest(scanned: DataFrame, column: str = "licenses") -> DataFrame:
    base, found = F.col(column)["base"], F.col(column)["found"]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id",
        n_words(F.col("text")).alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"),
        joined(F.concat(base["label"], found["label"])).alias("labels"),
        score(found).alias("score"),
    )
