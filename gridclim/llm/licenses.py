"""Licence scans by ordered signature rules, in DataFrame functions alone.

A text becomes words in lower case with one blank between them. A rule is a regular expression
over these words; it runs only on texts that contain its keyword. Rules are ordered by kind, from
sentences of the licences' own texts and grants that name a version down to bare names. A detection
that lies within one of an earlier kind, or within a longer one of its own kind, is suppressed. Base
phrases are detections of their own and are never suppressed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    """``kind`` orders the rules; -1 is a base phrase."""

    kind: int
    label: str
    keyword: str
    regex: str
    confidence: float


# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: (keyword, regular expression of the name, versions). Names are words without licence;
#: a version's closing 0 may be left out in a text.
FAMILIES = {
    "mit": ("mit", "mit(?: x11)?", ()),
    "mit-short": ("expat", "expat", ()),
    "apache": ("apache", "apache(?: software)?", ("1 0", "1 1", "2 0")),
    "gpl": ("general public", "(?:gnu )?general public", ("1 0", "2 0", "3 0")),
    "gpl-short": ("gpl", "gpl", ("1 0", "2 0", "3 0")),
    "lgpl": ("lesser general", "(?:gnu )?lesser general public", ("2 0", "2 1", "3 0")),
    "lgpl-short": ("lgpl", "lgpl", ("2 0", "2 1", "3 0")),
    "agpl": ("affero", "(?:gnu )?affero general public", ("1 0", "3 0")),
    "agpl-short": ("agpl", "agpl", ("1 0", "3 0")),
    "gfdl": ("free documentation", "(?:gnu )?free documentation", ("1 1", "1 2", "1 3")),
    "bsd": ("bsd", "(?:modified |simplified |new |revised )?bsd", ("2 clause", "3 clause")),
    "mpl": ("mozilla", "mozilla public", ("1 0", "1 1", "2 0")),
    "epl": ("eclipse", "eclipse public", ("1 0", "2 0")),
    "cddl": ("common development", "common development and distribution", ("1 0", "1 1")),
    "eupl": ("european union public", "european union public", ("1 1", "1 2")),
    "cc-by": ("cc by", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-sa": ("cc by sa", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc": ("cc by nc", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nd": ("cc by nd", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-sa": ("cc by nc sa", "cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    "cc-by-nc-nd": ("cc by nc nd", "cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    "cc0": ("cc0", "cc0", ("1 0",)),
    "creative-commons": (
        "creative commons", "creative commons(?: attribution)?(?: share ?alike)?",
        ("1 0", "2 0", "3 0", "4 0"),
    ),
    "artistic": ("artistic", "artistic", ("1 0", "2 0")),
    "zlib": ("zlib", "zlib", ()),
    "isc": ("isc", "isc", ()),
    "boost": ("boost", "boost software", ("1 0",)),
    "unlicense": ("unlicense", "unlicense", ()),
    "wtfpl": ("wtfpl", "wtfpl", ("2",)),
    "psf": ("python software", "python software foundation", ("2",)),
    "ofl": ("open font", "(?:sil )?open font", ("1 0", "1 1")),
    "odbl": ("open database", "open database", ("1 0",)),
    "public-domain": ("public domain", "public domain", ()),
    "all-rights-reserved": ("all rights reserved", "all rights reserved", ()),
    "proprietary": ("proprietary", "proprietary", ()),
}

#: Families whose name alone tells of a licence; other names are also those of firms, programs and
#: places. A longer name of this list is not also its beginning.
ALONE = (
    "gpl-short", "lgpl-short", "agpl-short", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd",
    "cc-by-nc-sa", "cc-by-nc-nd", "cc0", "creative-commons", "unlicense", "wtfpl", "public-domain",
    "all-rights-reserved", "proprietary",
)
LONGER = {"cc-by": "(?! (?:sa|nc|nd) )", "cc-by-nc": "(?! (?:sa|nd) )"}

#: Sentences that licences and their notices consist of: (label, keyword, regular expression).
SIGNATURES = [
    ("mit", "hereby granted",
     "permission is hereby granted free of charge to any person obtaining a copy of this software"
     " and associated documentation files(?: the software)?(?: to deal in the software)?"),
    ("mit", "permission notice",
     "the above copyright notice and this permission notice(?: including the next paragraph)? shall"
     " be included in all copies or substantial portions of the software"),
    ("ncsa", "hereby granted",
     "permission is hereby granted free of charge to any person obtaining a copy of this software"
     " and associated documentation files(?: the software)? to deal with the software"),
    ("boost-1.0", "hereby granted",
     "permission is hereby granted free of charge to any person or organization obtaining a copy of"
     " the software and accompanying documentation covered by this license"),
    ("isc", "hereby granted",
     "permission to use copy modify and(?: or)? distribute this software for any purpose with or"
     " without fee is hereby granted"),
    ("0bsd", "hereby granted",
     "permission to use copy modify and(?: or)? distribute this software for any purpose with or"
     " without fee is hereby granted the software is provided as is"),
    ("hpnd", "hereby granted",
     "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its"
     " documentation for any purpose(?: and)?(?: is hereby granted)? without fee"),
    ("postgresql", "hereby granted",
     "permission to use copy modify and distribute this software and its documentation for any"
     " purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution",
     "redistribution and use in source and binary forms with or without modification(?: are|is)?"
     " permitted"),
    ("bsd", "copyright holders",
     "this software is provided by the copyright holders(?: and contributors)? as is"),
    ("bsd-3-clause", "endorse or promote",
     "neither the names? of (?:[^ ]+ ){1,20}may be used to endorse or promote products derived from"
     " this software"),
    ("bsd-4-clause", "advertising materials",
     "all advertising materials mentioning features or use of this software must display the"
     " following acknowledge?ment"),
    ("zlib", "express or implied",
     "this software is provided as is without any express or implied warranty in no event will the"
     " authors? be held liable for any damages"),
    ("zlib", "plainly marked",
     "altered source versions must be plainly marked as such and must not be misrepresented as"
     " being the original software"),
    ("apache-2.0", "in compliance with",
     "licensed under the apache license version 2 0 the license you may not use this file except in"
     " compliance with the license"),
    ("apache-2.0", "obtain a copy",
     "you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2.0", "royalty free",
     "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty"
     " free irrevocable copyright license"),
    ("apache-1.1", "apache software foundation",
     "this product includes software developed by the apache software foundation"),
    ("gpl-2.0", "free software foundation",
     "gnu general public license as published by the free software foundation(?: either)? version 2"),
    ("gpl-3.0", "free software foundation",
     "gnu general public license as published by the free software foundation(?: either)? version 3"),
    ("lgpl-2.0", "free software foundation",
     "gnu library general public license as published by the free software foundation(?: either)?"
     " version 2"),
    ("lgpl-2.1", "free software foundation",
     "gnu lesser general public license as published by the free software foundation(?: either)?"
     " version 2 1"),
    ("lgpl-3.0", "free software foundation",
     "gnu lesser general public license as published by the free software foundation(?: either)?"
     " version 3"),
    ("agpl-3.0", "free software foundation",
     "gnu affero general public license as published by the free software foundation(?: either)?"
     " version 3"),
    ("gfdl", "free documentation",
     "permission is granted to copy distribute and or modify this document under the terms of the"
     " gnu free documentation license"),
    ("mpl-2.0", "source code form",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents of this file",
     "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "contents of this file",
     "the contents of this file are subject to the mozilla public license version 1 0"),
    ("cddl", "contents of this file",
     "the contents of this file are subject to the terms of the common development and distribution"
     " license"),
    ("epl-1.0", "accompanying materials",
     "this program and the accompanying materials are made available under the terms of the eclipse"
     " public license (?:v|version )1 0"),
    ("epl-2.0", "accompanying materials",
     "this program and the accompanying materials are made available under the terms of the eclipse"
     " public license (?:v ?|version )?2 0"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("cc-by-4.0", "creative commons", "creative commons attribution 4 0 international"),
    ("cc-by-sa-4.0", "creative commons", "creative commons attribution share ?alike 4 0 international"),
    ("cc-by-nc-4.0", "creative commons",
     "creative commons attribution non ?commercial 4 0 international"),
    ("cc-by-nd-4.0", "creative commons",
     "creative commons attribution no ?deriv(?:ative)?s 4 0 international"),
    ("cc-by-nc-sa-4.0", "creative commons",
     "creative commons attribution non ?commercial share ?alike 4 0 international"),
    ("cc-by-nc-nd-4.0", "creative commons",
     "creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0 international"),
    ("cc-by-3.0", "creative commons", "creative commons attribution 3 0 unported"),
    ("cc-by-sa-3.0", "creative commons", "creative commons attribution share ?alike 3 0 unported"),
    ("cc-by", "creativecommons", "creativecommons org licenses by"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc0", "public domain",
     "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "public domain",
     "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain",
     "(?:has been |is hereby |hereby )?(?:placed|released) (?:in|into) the public domain"),
    ("artistic-1.0", "intent of this document",
     "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "given free software",
     "this license establishes the terms under which a given free software package may be copied"
     " modified distributed and or redistributed"),
    ("ofl-1.1", "open font",
     "this font software is licensed under the sil open font license version 1 1"),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl 1 0"),
    ("psf-2", "python",
     "psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl",
     "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("wtfpl", "want to public", "you just do what the [^ ]+ you want to"),
    ("proprietary", "strictly prohibited",
     "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "confidential and proprietary",
     "(?:is|contains) the confidential and proprietary information of"),
]

GRANT = (
    "(?:licen[cs]ed|released|distributed|available|provided|published|covered) under"
    " (?:the )?(?:terms of )?(?:the )?"
)
LICENSE = "(?: (?:public )?licen[cs]e)?"
VERSION = "(?: version| v| ver)? v?"


def rules() -> list[Rule]:
    """All rules, first the base phrases, then the signatures and those of each family by kind."""
    found = [Rule(-1, label, phrase, phrase, 0.9) for phrase, label in BASE.items()]
    found += [Rule(0, label, keyword, regex, 1.0) for label, keyword, regex in SIGNATURES]
    for family, (keyword, name, versions) in FAMILIES.items():
        label = family.removesuffix("-short")
        for version in versions:
            exact = f"{label}-{version.replace(' ', '.').replace('.clause', '-clause')}"
            number = f"{version[:-2]}(?: 0)?" if version.endswith(" 0") else version
            versioned = f"{name}{LICENSE}{VERSION}{number}"
            found.append(Rule(0, exact, keyword, GRANT + versioned, 1.0))
            found.append(Rule(2, exact, keyword, versioned, 0.8))
        found.append(Rule(1, label, keyword, f"{GRANT}{name}{LICENSE}", 0.95))
        found.append(Rule(1, label, keyword, f"spdx licen[cs]e identifier {name}", 0.95))
        found.append(Rule(3, label, keyword, f"{name} licen[cs]e", 0.6))
        if family in ALONE:
            found.append(Rule(4, label, keyword, name + LONGER.get(family, ""), 0.3))
    return [
        Rule(r.kind, r.label, r.keyword, f"(?<= ){r.regex}(?= )", r.confidence) for r in found
    ]


KINDS = 5


def words_between_blanks(text: Column) -> Column:
    """The words of a text, a blank before and after each; case is left as it is."""
    closed = F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit("")), F.lit(" "))
    return F.regexp_replace(closed, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def applicable(words: Column, rule_list: list[Rule]) -> Column:
    """The rules whose keyword and pattern a text has; most texts have none of the keywords."""
    table = F.array(*[
        F.struct(
            F.lit(n).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.label).alias("label"),
            F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex"),
            F.lit(r.confidence).alias("confidence"),
        )
        for n, r in enumerate(rule_list)
    ])
    gate = F.lit(False)
    for keyword in sorted({r.keyword for r in rule_list}):
        gate = gate | F.contains(words, F.lit(keyword))
    return F.when(gate, F.filter(
        table, lambda r: F.contains(words, r["keyword"]) & F.regexp_like(words, r["regex"])
    ))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    Places are counted in words from 0. A null or empty text has no words, no labels (empty
    strings) and score 0. A null doc_id stays null; repeated rows are scanned each, told apart by
    a number that only lives within the job. The score is the confidence of the best detection
    that is left. An empty table gives an empty one."""
    raw = words_between_blanks(F.col("text"))
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        raw.alias("raw"),
    )
    # Unicode lower case decides on the gate only; A-Z alone are lowered for the rules.
    lowered = F.when(
        F.lower("raw").rlike(gate_pattern(rules())), F.translate("raw", UPPER, LOWER)
    ).otherwise(F.lit(" "))
    scanned = texts.select(
        "row", "doc_id", (blanks(F.col("raw")) - 1).cast("long").alias("n_words"),
        lowered.alias("words"),
    )
    hits = scanned.select(
        "row", "doc_id", "n_words", "words",
        F.explode_outer(applicable(F.col("words"), rules())).alias("hit"),
    ).select("row", "doc_id", "n_words", "words", "hit.*")
    pieces = F.arrays_zip(
        F.split("words", F.col("regex"), -1).alias("gap"),
        F.regexp_extract_all("words", F.col("regex"), F.lit(0)).alias("match"),
    )
    spread = hits.select(
        "row", "doc_id", "n_words", "rule", "kind", "label", "confidence",
        F.posexplode_outer(pieces).alias("n", "piece"),
    ).select(
        "row", "doc_id", "n_words", "rule", "kind", "label", "confidence", "n",
        blanks(F.col("piece.gap")).alias("gap"), blanks(F.col("piece.match")).alias("length"),
    )
    # What follows the last match is no detection; a text without any keeps its one row.
    spread = spread.where(F.col("rule").isNull() | F.col("length").isNotNull()).repartition("row")
    before = Window.partitionBy("row", "rule").orderBy("n")
    placed = spread.withColumn(
        "start",
        F.sum("gap").over(before)
        + F.coalesce(F.sum("length").over(before.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)) - 1,
    ).withColumn("end", F.col("start") + F.col("length"))
    return detections_by_text(not_contained(placed))


def gate_pattern(rule_list: list[Rule]) -> str:
    return "|".join(sorted({rule.keyword for rule in rule_list}))


def not_contained(detections: DataFrame) -> DataFrame:
    """Drops detections within one of an earlier kind, and those strictly within one of their own
    kind: among those that start no later, one of these ends no earlier. One running maximum per
    kind, so no two detections are compared."""
    earlier = (
        Window.partitionBy("row").orderBy("start")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    )
    beside = Window.partitionBy("row").orderBy("start").rangeBetween(0, 0)
    same = lambda kind: F.when(F.col("kind") == kind, F.col("end"))
    reach = {}
    for kind in range(KINDS):
        if kind:
            reach[f"reach{kind}"] = F.max(
                F.when(F.col("kind").between(0, kind - 1), F.col("end"))
            ).over(earlier)
        reach[f"before{kind}"] = F.max(same(kind)).over(before)
        reach[f"beside{kind}"] = F.max(same(kind)).over(beside)
    covered = F.lit(False)
    for kind in range(KINDS):
        within = (F.col(f"before{kind}") >= F.col("end")) | (F.col(f"beside{kind}") > F.col("end"))
        if kind:
            # A null maximum, where there is none, is not a true one.
            within = F.coalesce(within, F.lit(False)) | (F.col(f"reach{kind}") >= F.col("end"))
        covered = covered | ((F.col("kind") == kind) & F.coalesce(within, F.lit(False)))
    return detections.withColumns(reach).where(~F.coalesce(covered, F.lit(False)))


def detections_by_text(detections: DataFrame) -> DataFrame:
    base = F.col("kind") == -1
    named = lambda label: F.concat_ws(",", F.sort_array(F.collect_set(label)))
    return (
        detections.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            named(F.when(base, F.col("label"))).alias("base_labels"),
            named(F.col("label")).alias("labels"),
            F.coalesce(F.max("confidence"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
