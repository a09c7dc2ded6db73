"""License scans by ordered signature rules, with DataFrame functions only.

A text is brought to words (A-Z lower-cased, everything between words one space). Each rule is a hand-written regular expression
over words with a keyword; a rule is tried only where its keyword occurs. All places
of all tried rules are detections (interval, label, priority, confidence). A detection whose interval lies within that of one with a
higher priority is suppressed; the labels of the others are reported, together with the base labels, which always stay.

Everything is computed within the row: no shuffle, no join, no Python. The rules are a constant of fixed size. A text is gone through
once for each rule whose keyword it has. Detections are sorted by start and cut to runs of RUN; a run is compared only with runs whose
span reaches it, so the work grows with the number of detections, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import documents, lower_ascii

#: Phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_CONFIDENCE = 0.6
#: Detections that are kept together where they are compared.
RUN = 64
DETECTION = "struct<start:int,end:int,rank:int,label:string,confidence:double>"

#: Rules in order of priority, highest first: confidence, then label | keyword | pattern. Patterns match whole words of normalised
#: text. Within {}, a rule stands for one rule for each of the listed variants.
FULL_TEXTS = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software (?:\\w+ ){0,40}without restriction (?:\\w+ ){0,40}permit persons to whom the software is furnished to do so the software is provided
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
bsd-3-clause | neither the name | neither the name of (?:\\w+ ){1,20}nor the names of its contributors may be used to endorse or promote products
bsd-2-clause | redistributions of source | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | boost software license | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | what the fuck | you just do what the fuck you want to
apache-2.0 | terms and conditions for use | terms and conditions for use reproduction and distribution 1 definitions
apache-2.0 | except in compliance | you may not use this file except in compliance with the license
gpl-3.0 | preamble | gnu general public license version 3 29 june 2007
gpl-2.0 | preamble | gnu general public license version 2 june 1991
lgpl-2.1 | preamble | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | lesser | gnu lesser general public license version 3 29 june 2007
agpl-3.0 | affero | gnu affero general public license version 3 19 november 2007
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
cddl-1.0 | cddl | subject to the terms of the common development and distribution license
openssl | openssl | this product includes software developed by the openssl project
php-3.01 | php | this product includes php software freely available from
python-2.0 | python | psf license agreement for python
postgresql | postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
curl | permission to use | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
ofl-1.1 | font | this font software is licensed under the sil open font license
artistic-2.0 | artistic | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
ms-pl | microsoft public license | this license governs use of the accompanying software if you use the software you accept this license
gpl-generic | free software foundation | free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl-generic | free software foundation | free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl-generic | free software foundation | free software you can redistribute it and or modify it under the terms of the gnu affero general public license
"""
TAGS = """
{id} | spdx license identifier {words} | spdx license identifier {words}(?! only| or)
{id}-only | {words} only | spdx license identifier {words} only
{id}-or-later | {words} or later | spdx license identifier {words} or later
"""
#: The identifiers that a tag may name.
IDENTIFIERS = """
0bsd afl-3.0 agpl-3.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware bsd-1-clause bsd-2-clause bsd-3-clause
bsd-4-clause bsl-1.0 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cddl-1.0 cecill-2.1 cpl-1.0 ecl-2.0 efl-2.0
epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 ijg isc lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng mit mit-0 mpl-1.1 mpl-2.0
ms-pl ms-rl mulanpsl-2.0 ncsa nasa-1.3 odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql python-2.0 qpl-1.0 ruby sleepycat unlicense
upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
"""
NOTICES = """
mit | mit license | (?:under|the|an?) (?:the )?(?:terms of the )?mit license
mit | expat | expat license
x11 | x11 license | (?:mit )?x11 license
apache-1.1 | apache | apache software license version 1 1
apache-2.0 | apache | apache license,? (?:version |v )?2(?: 0)?
apache-2.0 | apache | apache 2(?: 0)? licensed?
apache-2.0 | apache | licenses license 2 0
gpl-1.0 | general public license | gnu general public license (?:version |v )1
gpl-2.0-or-later | or later | general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )2(?: 0)? (?:of the license )?or (?:at your option )?(?:any )?later
gpl-3.0-or-later | or later | general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )3(?: 0)? (?:of the license )?or (?:at your option )?(?:any )?later
gpl-2.0 | general public license | general public license (?:version |v )2
gpl-3.0 | general public license | general public license (?:version |v )3
gpl-2.0 | gpl | gnu ?gpl ?v?2
gpl-3.0 | gpl | gnu ?gpl ?v?3
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gplv3 | gplv3
lgpl-2.0 | library general | gnu library general public license(?: version 2)?
lgpl-2.1 | lesser general | lesser general public license (?:version |v )2 1
lgpl-3.0 | lesser general | lesser general public license (?:version |v )3
lgpl-2.1 | lgplv2 | lgplv2 ?1?
lgpl-3.0 | lgplv3 | lgplv3
lgpl | lesser general | gnu lesser general public license
agpl-3.0 | affero | affero general public license (?:version |v )3
agpl | affero | affero general public license
agpl-3.0 | agplv3 | agplv3
classpath-exception | classpath | classpath exception
gcc-exception | runtime library exception | gcc runtime library exception
linking-exception | special exception | as a special exception (?:\\w+ ){0,12}link
bsd-2-clause | 2 clause | (?:simplified bsd|(?:bsd )?2 clause bsd|bsd 2 clause)(?: license)?
bsd-3-clause | 3 clause | (?:new bsd|revised bsd|3 clause bsd|bsd 3 clause)(?: license)?
bsd-4-clause | 4 clause | (?:original bsd|4 clause bsd|bsd 4 clause)(?: license)?
bsd-2-clause | simplified bsd | simplified bsd license
bsd-3-clause | new bsd | new bsd license
bsd | bsd | bsd (?:style )?licensed?
isc | isc license | isc license
zlib | zlib | zlib (?:libpng )?license
libpng | libpng | libpng license
bsl-1.0 | boost | boost software license
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
beerware | beer | beer ?ware license
mpl-1.0 | mozilla | mozilla public license (?:version |v )1 0
mpl-1.1 | mozilla | mozilla public license (?:version |v )1 1
mpl-2.0 | mozilla | mozilla public license (?:version |v )2
mpl | mozilla | mozilla public license
epl-1.0 | eclipse | eclipse public license (?:version |v |v1 )1? ?0
epl-2.0 | eclipse | eclipse public license (?:version |v |v2 )2? ?0
epl | eclipse | eclipse public license
edl-1.0 | eclipse | eclipse distribution license
cddl-1.0 | development and distribution | common development and distribution license
cpl-1.0 | common public | common public license
ibm-pl | ibm public | ibm public license
eupl-1.1 | european union | european union public licence (?:version |v )1 1
eupl-1.2 | european union | european union public licence (?:version |v )1 2
cecill | cecill | cecill (?:free software )?licen[cs]e
artistic-1.0 | artistic | artistic license 1 0
artistic-2.0 | artistic | artistic license (?:version |v )?2 0
artistic | artistic | artistic license
perl | perl itself | same terms as perl itself
ruby | ruby | ruby license
python-2.0 | python | python software foundation license
php | php | php license
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl license
sleepycat | sleepycat | sleepycat license
vim | vim license | vim license
ncsa | illinois | university of illinois ncsa open source license
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
apsl-2.0 | apple public source | apple public source license
afl-3.0 | academic free | academic free license
osl-3.0 | open software license | open software license
ecl-2.0 | educational community | educational community license
w3c | w3c | w3c software (?:notice and )?license
zpl | zope | zope public license
qpl-1.0 | q public | q public license
upl-1.0 | universal permissive | universal permissive license
mulan | mulan | mulan permissive software license
ofl-1.1 | open font | open font license
gfdl | free documentation | gnu free documentation license
odbl-1.0 | open database | open database license
pddl-1.0 | public domain dedication | public domain dedication and licen[cs]e
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
public-domain | public domain | (?:in|into|to|released to) the public domain
cc-pdm | public domain mark | public domain mark
elastic-2.0 | elastic license | elastic license
sspl-1.0 | server side public | server side public license
busl-1.1 | business source | business source license
commons-clause | commons clause | commons clause
polyform | polyform | polyform (?:noncommercial|small business|shield|strict) license
json | good not evil | the software shall be used for good not evil
jquery | jquery | jquery org license
icu | icu license | icu license
unicode | unicode | unicode license
bzip2 | bzip2 | bzip2 license
freetype | freetype | freetype (?:project )?license
imagemagick | imagemagick | imagemagick license
tcl | tcl tk | tcl tk license
proprietary | proprietary | proprietary (?:and confidential|license)
proprietary | commercial license | (?:under|with) a commercial license
all-rights-reserved | all rights reserved | all rights reserved
"""
#: Creative Commons, for each kind and version, by short and by long name.
CC_KINDS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s(?: works)?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _lines(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[tuple[str, str, str, float]]:
    """All rules in order of priority: label, keyword, pattern, confidence. A pattern starts and ends at a space of the text."""
    out = [(label, word, pattern, 0.98) for label, word, pattern in _lines(FULL_TEXTS)]
    for name in sorted(IDENTIFIERS.split(), key=lambda x: (-len(x), x)):  # longer names first
        spoken = name.replace("-", " ").replace(".", " ")
        out += [(*(part.replace("{id}", name).replace("{words}", spoken) for part in line), 0.99) for line in _lines(TAGS)]
    for kind, spoken in sorted(CC_KINDS.items(), key=lambda x: -len(x[0])):
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            out.append((f"cc-{kind}-{version}", "cc by", f"cc {kind.replace('-', ' ')} {number}", 0.95))
            out.append((f"cc-{kind}-{version}", "creative commons", f"creative commons {spoken}(?: {number})?(?: international| unported| generic)? (?:public )?licen[cs]e (?:version |v )?{number}", 0.95))
            out.append((f"cc-{kind}-{version}", "creative commons", f"creative commons {spoken} {number}", 0.95))
        out.append((f"cc-{kind}", "cc by", f"cc {kind.replace('-', ' ')}", 0.8))
        out.append((f"cc-{kind}", "creative commons", f"creative commons {spoken}", 0.8))
    return out + [(label, word, pattern, 0.85) for label, word, pattern in _lines(NOTICES)]


def _stems(words: list[str]) -> tuple[str, ...]:
    """The words that hold no other of them: a text with any of ``words`` has one of these."""
    return tuple(sorted(x for x in set(words) if not any(y in x for y in set(words) - {x})))


#: A text without any of these has no rule's keyword, so no rule is tried.
STEMS = _stems([word for _, word, _, _ in rules()])


def normalised(text: Column) -> Column:
    """Lower-cased words with one space between, before and after them; one space where there is no word."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cut(items: Column) -> Column:
    """An array as runs of RUN items; one empty run of an empty array."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / RUN).cast("int") - 1, F.lit(0))), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)))


def _detections(text: Column) -> Column:
    """Array of (start, end, rank, label, confidence) of all places of all rules whose keyword occurs, in order."""
    table = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(label).alias("label"), F.lit(word).alias("word"), F.lit(f" {pattern}(?= )").alias("pattern"), F.lit(confidence).alias("confidence")) for rank, (label, word, pattern, confidence) in enumerate(rules())])

    def places(rule: Column) -> Column:
        # what is before each place and the place itself, as lengths; after the last place there is none
        pieces = F.zip_with(F.split(text, rule["pattern"], -1), F.regexp_extract_all(text, rule["pattern"], F.lit(0)), lambda rest, found: F.struct(F.length(rest).alias("skip"), F.length(found).alias("size")))
        added = lambda total, x: total + x["skip"] + x["size"]

        def placed(runs: Column, before: Column) -> Column:
            """A place starts after all runs before its own, all before it in its run, and what is skipped. Sums by runs, so no long array
            is gone through for each place."""

            def of_run(run: Column, k: Column) -> Column:
                def place(base: Column) -> Column:
                    def one(x: Column, n: Column) -> Column:
                        start = base + F.aggregate(F.slice(run, F.lit(1), n), F.lit(0), added) + x["skip"]
                        return F.struct(start.alias("start"), (start + x["size"]).alias("end"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))

                    return F.transform(run, one)

                return _let(F.aggregate(F.slice(before, F.lit(1), k), F.lit(0), lambda total, x: total + x), place)

            return F.flatten(F.transform(runs, of_run))

        whole = F.filter(pieces, lambda x: x["size"].isNotNull())
        return _let(_let(whole, _cut), lambda runs: _let(F.transform(runs, lambda run: F.aggregate(run, F.lit(0), added)), lambda before: placed(runs, before)))

    found = F.flatten(F.transform(F.filter(table, lambda rule: F.contains(text, rule["word"])), places))
    return F.array_sort(found.cast(f"array<{DETECTION}>"))


def _runs(detections: Column) -> Column:
    """Sorted detections as runs: own (array), first and last start, least and greatest end."""
    ends = lambda run: F.transform(run, lambda x: x["end"])
    runs = F.filter(_let(detections, _cut), lambda run: F.size(run) > 0)
    return F.transform(runs, lambda run: F.struct(run.alias("own"), run[0]["start"].alias("first"), F.element_at(run, -1)["start"].alias("last"), F.array_min(ends(run)).alias("least"), F.array_max(ends(run)).alias("greatest")))


def _unsuppressed(runs: Column) -> Column:
    """The detections that lie in none of a higher priority."""
    within = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["rank"] < x["rank"])

    def kept(every: Column) -> Column:
        reaching = lambda run: F.filter(every, lambda other: (other["first"] <= run["last"]) & (other["greatest"] >= run["least"]))
        met = F.transform(every, lambda run: F.struct(run["own"].alias("own"), F.flatten(F.transform(reaching(run), lambda other: other["own"])).alias("near")))
        return F.flatten(F.transform(met, lambda x: F.filter(x["own"], lambda one: ~F.exists(x["near"], lambda y: within(one, y)))))

    return _let(runs, kept)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id_column``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score`` and ``detections`` (array of start, end, rank, label, confidence; characters of the normalised text).

    A null or empty text has no words and no places: counts and score are 0, positions null, labels empty. Null and repeated ids are
    returned as they are, other columns, however they are named, are ignored, an empty table gives an empty result. Equal intervals keep
    the first rule. A very long text is looked at whole, within its row; its detections are held in memory.
    """
    rows = docs.select(F.col(id_column).cast("long").alias(id_column), normalised(F.col(text_column).cast("string")).alias("w"))
    rows = rows.withColumn("n_words", F.greatest(_spaces(F.col("w")) - 1, F.lit(0)).cast("long"))
    marked = F.exists(F.array(*map(F.lit, STEMS)), lambda stem: F.contains(F.col("w"), stem))
    counts, firsts, lasts = [], [], []
    for phrase in BASE:
        there = F.contains(F.col("w"), F.lit(f" {phrase} "))
        counts.append(F.when(there, F.regexp_count(F.col("w"), F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long"))
        firsts.append(F.when(there, _spaces(F.substring_index(F.col("w"), f" {phrase} ", 1))))
        after = F.substring_index(F.col("w"), f" {phrase} ", -1)  # the words after the last place, each with a space behind it
        lasts.append(F.when(there, F.col("n_words") - _spaces(after) - len(phrase.split())))
    base = F.array_compact(F.array(*[F.when(count > 0, F.lit(label)) for count, label in zip(counts, BASE.values(), strict=True)]))
    rows = rows.select(
        id_column, "n_words", sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"), _runs(F.when(marked, _detections(F.col("w"))).otherwise(_none(f"array<{DETECTION}>"))).alias("runs"),
    )
    rows = rows.withColumn("detections", _unsuppressed(F.col("runs")))
    labels = F.array_sort(F.array_union(F.col("base"), F.transform("detections", lambda x: x["label"])))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0))
    return rows.select(
        id_column, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(sure, F.when(F.col("n_base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))).alias("score"), "detections",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("detections")
