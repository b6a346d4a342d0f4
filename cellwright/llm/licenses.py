"""Licence recognition by sentences, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import text_of

# Sentences of widely used licence notices, as published, by identifier.
# Sentences end where the text has . ! ? : or ; before white space.
SENTENCES: dict[str, str] = {
    "mit-name": "MIT License",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-published": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-subject-v": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}

# Each rule is a sequence of sentences that follow each other among the known ones.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("spdx-mit",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty")),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("Apache-2.0", ("apache-header", "apache-may-not", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-header", "apache-may-not", "apache-as-is")),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0-only", ("gpl3-licensed",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-published", "gpl2-version")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject-v", "mpl2-copy")),
    ("Unlicense", ("unlicense-free",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
]

#: Every known sentence holds one of these words, so only sentences that do are normalised.
ANCHORS = ("licen", "permission", "copyright", "warrant", "liab", "redistribut", "endorse", "free software", "version 2", "mpl", "unencumbered")
#: A sentence ends at . ! ? : or ; before white space (a group: the mark stays).
_END = r"([.!?:;])[ \t\r\f]+"
_TAG = "(?i)(SPDX-License-Identifier):"


def normal(sentence: str) -> str:
    """Lower case; every stretch of other characters than letters a-z and digits is one blank."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


NUMBERS = {name: i + 1 for i, name in enumerate(SENTENCES)}
assert all(any(a in s.lower() for a in ANCHORS) for s in SENTENCES.values())


def _split(text: Column, joined: bool) -> Column:
    """Sentences of each line; or, joined, of the text whose single line feeds (with comment marks after them) are blanks."""
    if joined:
        text = F.regexp_replace(text, r"(\S)[ \t\r]*\n[ \t]*(?:[#*]+|//+|--+)?[ \t]*(\S)", "$1 $2")
    # the colon of an SPDX tag ends no sentence
    return F.split(F.regexp_replace(F.regexp_replace(text, _TAG, "$1"), _END, "$1\n"), "\n")


def known_sentences(text: Column, joined: bool) -> Column:
    """The numbers of the known sentences of a text, in their order."""
    table = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (normal(s), NUMBERS[name])])
    some = F.filter(_split(text, joined), lambda s: s.rlike("(?i)" + "|".join(ANCHORS)))
    plain = F.transform(some, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.array_compact(F.transform(plain, lambda s: F.try_element_at(table, s)))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `sentences` (names of the known sentences, in order) and `licenses` (sorted identifiers of the rules that match).

    Sentences are normalised and looked up in a fixed table; the numbers found form a sequence, in
    which the rules' sequences are looked for. Both readings of line feeds are tried: as ends
    of sentences (a notice amid other lines) and as blanks (a wrapped notice, also in comments);
    `sentences` are those of the reading that knows more, lines first. A null text has none. Each row stands
    alone: no shuffle. Columns of docs with a result's name are replaced.
    """
    rest = [c for c in docs.columns if c not in ("sentences", "licenses")]
    text = F.col("__text")
    # only texts that hold an anchor at all are read sentence by sentence
    read = lambda joined: F.when(text.rlike("(?i)" + "|".join(ANCHORS)), known_sentences(text, joined)).otherwise(F.array().cast("array<int>"))
    found = docs.select(*[docs[c] for c in rest], text_of(docs, text_col).alias("__text")).select(*rest, read(False).alias("__lines"), read(True).alias("__joined"))
    as_text = lambda c: F.concat(F.lit(","), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    keyed = found.withColumn("__a", as_text("__lines")).withColumn("__b", as_text("__joined"))
    sequence = lambda rule: "," + ",".join(str(NUMBERS[s]) for s in rule) + ","
    hits = [F.when(F.col("__a").contains(sequence(rule)) | F.col("__b").contains(sequence(rule)), F.lit(name)) for name, rule in RULES]
    names = F.array(*[F.lit(x) for x in SENTENCES])
    more = F.when(F.size("__joined") > F.size("__lines"), F.col("__joined")).otherwise(F.col("__lines"))
    return keyed.select(*rest, F.transform(more, lambda k: F.get(names, k - 1)).alias("sentences"), F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))).alias("licenses"))


def oracle_sql() -> str:
    """The same scan for DuckDB."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({text(normal(s))}, {NUMBERS[n]}, {text(n)})" for n, s in SENTENCES.items())
    rules = ", ".join(f"({text(name)}, {text(',' + ','.join(str(NUMBERS[s]) for s in rule) + ',')})" for name, rule in RULES)
    anchors = "|".join(ANCHORS)
    joined = r"regexp_replace(text, '(\S)[ \t\r]*\n[ \t]*(?:[#*]+|//+|--+)?[ \t]*(\S)', '\1 \2', 'g')"
    return rf"""
WITH known(s, k, name) AS (VALUES {table}), rules(license, seq) AS (VALUES {rules}),
both_ways AS (SELECT doc_id, 0 AS way, text FROM documents UNION ALL SELECT doc_id, 1, {joined} FROM documents),
parts AS (SELECT doc_id, way, string_split(regexp_replace(regexp_replace(text, '{_TAG}', '\1', 'g'), '([.!?:;])[ \t\r\f]+', '\1' || chr(10), 'g'), chr(10)) AS p
  FROM both_ways WHERE regexp_matches(text, '(?i){anchors}')),
lines AS (SELECT doc_id, way, unnest(p) AS l, unnest(range(1, len(p) + 1)) AS i FROM parts),
found AS (SELECT doc_id, way, i, k, name FROM lines JOIN known ON trim(regexp_replace(lower(l), '[^a-z0-9]+', ' ', 'g')) = s),
seqs AS (SELECT doc_id, way, count(*) AS n, ',' || string_agg(k, ',' ORDER BY i) || ',' AS ks, string_agg(name, ',' ORDER BY i) AS names FROM found GROUP BY doc_id, way),
best AS (SELECT doc_id, max(n) AS n, arg_max(names, 2 * n - way) AS names FROM seqs GROUP BY doc_id),
hit AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM
  (SELECT DISTINCT doc_id, license FROM seqs JOIN rules ON contains(ks, seq)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.n, 0) AS n_sentences, coalesce(b.names, '') AS sentences, coalesce(h.licenses, '') AS licenses
FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN hit h USING (doc_id)
"""
