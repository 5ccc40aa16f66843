"""Licence scans: base columns against plain counting, and the order of the rules."""

import re

from gridclim.llm.licenses import BASE, rules, scan_licenses
from gridclim.llm.tables import LOWER, UPPER

from .corpus import odd_rows, table
from helpers import plan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    tokens = WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
    starts, labels = [], set()
    for phrase, label in BASE.items():
        parts = phrase.split()
        for at in range(len(tokens)):
            if tokens[at : at + len(parts)] == parts:
                starts.append(at)
                labels.add(label)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(tokens), len(starts), first, last, ",".join(sorted(labels))


def test_base_columns(spark):
    rows = odd_rows() + [(90, "İMIT license Kit")]
    rows += [(91, "MIT-License; mit\n\nLICENSE! Apache.license")]
    result = scan_licenses(table(spark, rows)).collect()
    assert len(result) == len(rows)
    texts = dict(rows)
    for row in result:
        if row.doc_id is not None:
            assert tuple(row)[1:6] == base(texts[row.doc_id]), row
        assert 0 <= row.score <= 1
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
    assert scan_licenses(table(spark, [])).count() == 0


def labels(spark, text):
    return scan_licenses(table(spark, [(1, text)])).first()


def test_longer_and_earlier_rules_suppress_those_within(spark):
    row = labels(spark, "Licensed under the Apache License, Version 2.0.")
    assert (row.labels, row.base_labels, row.score) == ("apache,apache-2.0", "apache", 1.0)
    row = labels(spark, "Licensed under CC BY-NC 4.0.")
    assert (row.labels, row.n_base) == ("cc-by-nc-4.0", 0)
    # Outside of the longer one, the shorter one stays.
    row = labels(spark, "Mozilla Public License 2.0 and some Mozilla Public License")
    assert row.labels == "mpl,mpl-2.0"
    assert labels(spark, "some mit words, some license").labels == ""


def test_names_that_stand_alone(spark):
    wanted = {
        "All rights reserved.": ("all-rights-reserved", 0.3),
        "This is dedicated to the public domain": ("public-domain", 0.3),
        "proprietary and confidential software": ("proprietary", 0.3),
        "see the UNLICENSE file": ("unlicense", 0.3),
        "Photo: A. Person, CC BY-NC-SA": ("cc-by-nc-sa", 0.3),
        "Photo: A. Person, CC-BY and cc by nd": ("cc-by,cc-by-nd", 0.3),
        "released under the Expat license": ("mit", 0.95),
        "the expat licence": ("mit", 0.6),
        "MIT X11 license": ("mit", 0.6),
        # Within an earlier kind, the bare name is no detection of its own.
        "Licensed under the public domain": ("public-domain", 0.95),
        "the GPL license": ("gpl", 0.6),
        "GPL v2.0 or later": ("gpl-2.0", 0.8),
        "GPL v2.0, and the GPL": ("gpl,gpl-2.0", 0.8),
        "an expat in Boston, an apache helicopter, BSD sockets, zlib": ("", 0.0),
    }
    texts = list(wanted)
    found = scan_licenses(table(spark, list(enumerate(texts)))).collect()
    assert {texts[r.doc_id]: (r.labels, r.score) for r in found} == wanted


def test_sentences_of_licences(spark):
    fsf = "as published by the Free Software Foundation, either version"
    wanted = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the \"Software\"), to deal in the Software": "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the \"Software\"), to deal with the Software": "ncsa",
        "Redistribution and use in source and binary forms, with or without\n * modification, are"
        " permitted provided that": "bsd",
        "Neither the name of the University nor the names of its contributors may be used to endorse"
        " or promote products derived from this software": "bsd-3-clause",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that": "isc",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as"
        " being the original software.": "zlib",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
        " except in compliance with the License.": "apache,apache-2.0",
        f"the GNU General Public License {fsf} 2 of the License": "gpl,gpl-2.0",
        f"the GNU Lesser General Public License {fsf} 2.1 of the License": "gpl,lgpl-2.1",
        f"the GNU Affero General Public License {fsf} 3 of the License": "agpl-3.0,gpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.":
            "mpl-2.0",
        "http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
        "a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        # No version of a shorter name within a longer one; the base label stays.
        "GNU Lesser General Public License version 3.0": "gpl,lgpl-3.0",
        "GNU Affero General Public License, version 3": "agpl-3.0,gpl",
        "the GNU Lesser General Public License": "gpl,lgpl",
        "permission granted, redistribution of wealth, warranty and copyright holders": "",
    }
    texts = list(wanted)
    found = scan_licenses(table(spark, list(enumerate(texts)))).collect()
    assert {texts[r.doc_id]: r.labels for r in found} == wanted


def test_rules_are_many_and_native(spark):
    assert len(rules()) > 200 and len({r.regex for r in rules()}) > 200
    text = plan(scan_licenses(table(spark, odd_rows())))
    assert not re.search("Python|Pandas|Arrow", text)
