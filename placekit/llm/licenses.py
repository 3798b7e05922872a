"""Licence recognition by sentences and ordered rules.

A text is cut into sentences, each is normalised (lower case, letters and digits only) and looked up among known
licence sentences; the identifiers found, in order, are matched against rules, each an ordered run of identifiers that
names a licence. Longer rules are tried first and use up what they match. Sentences that aren't known don't count.
Texts are cut twice, at line ends and across them (for notices that are wrapped); the cut that knows more counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, by identifier.
SENTENCES = {
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-the": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
                    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-project": "This project is licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
                 "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                 "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
                 "notice shall be included in all copies or substantial portions of the Software",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2",
    "gpl-redistribute-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                          "Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-redistribute-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                          "Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "lgpl3-work": "This work is licensed under the GNU Lesser General Public License, version 3",
    "agpl3-work": "This work is licensed under the GNU Affero General Public License, version 3",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd3-released": "Released under the 3-Clause BSD License",
    "bsd2-released": "Released under the 2-Clause BSD License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
                 "permission notice appear in all copies",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "cc0-waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
}
# The licence, and the sentences that name it in order.
RULES = [
    ("Apache-2.0", ["apache-licensed-the", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-licensed-the", "apache-copy"]),
    ("Apache-2.0", ["apache-licensed-the"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-only", ["gpl3-licensed"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("LGPL-3.0-only", ["lgpl3-work"]),
    ("AGPL-3.0-only", ["agpl3-work"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-title-short", "mit-grant"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-project"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("BSD-3-Clause", ["bsd3-released"]),
    ("BSD-2-Clause", ["bsd2-released"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-domain"]),
    ("CC0-1.0", ["cc0-waived"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-work"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4"]),
]
# A full stop inside "v. 2.0" ends a sentence like any other, so a known sentence may be several.
STOP, LINE, OTHER = r"[.!?]+[ \t\r\n]", r"[\r\n]+", r"[^a-z0-9\n]+"


def normal_parts(sentence: str) -> list[str]:
    """The normalised sentences a known one is cut into."""
    cut = re.sub(STOP, "\n", sentence.lower() + "\n")
    return [s for s in (p.strip() for p in re.sub(OTHER, " ", cut).split("\n")) if s]


def dictionary() -> tuple[list[str], list[tuple[str, str]]]:
    """All normalised sentences (their numbers are their places, from 1), and the rules as (licence, ``,1,2,``), longest first."""
    known: list[str] = []
    numbers = {}
    for name, sentence in SENTENCES.items():
        parts = normal_parts(sentence)
        known += [p for p in parts if p not in known]
        numbers[name] = [known.index(p) + 1 for p in parts]
    rules = [(licence, [n for s in names for n in numbers[s]]) for licence, names in RULES]
    rules.sort(key=lambda r: (-len(r[1]), r[1]))
    return known, [(licence, "," + ",".join(map(str, ns)) + ",") for licence, ns in rules]


def _numbers(lined: Column, known: Column) -> Column:
    """Numbers of the known sentences of a text whose sentences are lines."""
    found = F.transform(F.split(F.regexp_replace(lined, OTHER, " "), "\n"), lambda s: F.array_position(known, F.trim(s)))
    return F.filter(found, lambda n: n > 0)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, sentences, licenses`` of each document: known sentence numbers and licences, as comma lists in order.

    ``docs`` needs ``doc_id, text``; other columns are ignored. A licence found by several rules counts once. A null or
    empty text, or one without a known sentence, has two empty lists. Rows that repeat each give a row. An empty
    table gives an empty result.
    """
    sentences, rules = dictionary()
    known = F.array(*[F.lit(s) for s in sentences])
    low = F.concat(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit("\n"))
    stopped = docs.select("doc_id", F.regexp_replace(low, STOP, "\n").alias("lines"), F.regexp_replace(F.regexp_replace(low, LINE, " "), STOP, "\n").alias("wrapped"))
    both = stopped.select("doc_id", _numbers(F.col("lines"), known).alias("a"), _numbers(F.col("wrapped"), known).alias("b"))
    ids = both.select("doc_id", F.array_join(F.when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a")), ",").alias("sentences"))
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("run")) for n, p in rules])
    begin = F.struct(F.concat(F.lit(","), F.col("sentences"), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("found"))
    read = F.aggregate(table, begin, lambda acc, r: F.struct(
        F.replace(acc["rest"], r["run"], F.lit(",")).alias("rest"),
        F.when(F.contains(acc["rest"], r["run"]), F.array_union(acc["found"], F.array(r["name"]))).otherwise(acc["found"]).alias("found")))
    return ids.select("doc_id", "sentences", F.when(F.col("sentences") == "", F.lit("")).otherwise(F.array_join(F.array_sort(read["found"]), ",")).alias("licenses"))


def oracle() -> str:
    """The same in DuckDB."""
    sentences, rules = dictionary()
    known = "[" + ", ".join(f"'{s}'" for s in sentences) + "]"
    numbers = "list_filter(list_transform(string_split(regexp_replace({}, '" + OTHER + "', ' ', 'g'), chr(10)), lambda s: coalesce(list_position(" + known + ", trim(s)), 0)), lambda n: n > 0)"
    stop, line = STOP, LINE
    sql = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) || chr(10) AS low FROM documents),
l AS (SELECT r, doc_id, regexp_replace(low, '{stop}', chr(10), 'g') AS lines, regexp_replace(regexp_replace(low, '{line}', ' ', 'g'), '{stop}', chr(10), 'g') AS wrapped FROM d),
n AS (SELECT r, doc_id, {numbers.format('lines')} AS a, {numbers.format('wrapped')} AS b FROM l),
s0 AS (SELECT r, doc_id, array_to_string(CASE WHEN len(b) > len(a) THEN b ELSE a END, ',') AS sentences, ',' || array_to_string(CASE WHEN len(b) > len(a) THEN b ELSE a END, ',') || ',' AS rest,
  CAST([] AS VARCHAR[]) AS found FROM n)"""
    for i, (name, run) in enumerate(rules):
        sql += f""",
s{i + 1} AS (SELECT r, doc_id, sentences, replace(rest, '{run}', ',') AS rest, CASE WHEN contains(rest, '{run}') THEN list_append(found, '{name}') ELSE found END AS found FROM s{i})"""
    return sql + f"\nSELECT doc_id, sentences, array_to_string(list_sort(list_distinct(found)), ',') AS licenses FROM s{len(rules)}"
