import re

import duckdb

from placekit.llm import licenses

SCHEMA = "doc_id long, text string"
APACHE = ('Licensed under the Apache License, Version 2.0 (the "License");\n you may not use this file except in compliance\n with the License. You may obtain a copy of the License at\n'
          "http://www.apache.org/licenses/LICENSE-2.0\n")


def rows():
    return [(1, "Some text.\nReleased under the MIT License.\nMore"), (2, "LICENSED UNDER cc by-nc 4.0!"), (3, "Not released under the MIT License here."), (4, APACHE), (5, None), (6, ""),
            (7, "This work is licensed under the GNU General Public License, version 3. Released under the MIT License. Released under the MIT License."),
            (7, "This work is licensed under the GNU General Public License, version 3. Released under the MIT License. Released under the MIT License."),
            (None, "Licensed under CC BY 4.0. " * 3), (8, "word " * 200_000 + "\nReleased under the MIT License."),
            (9, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")]


def test_known_notices(stored):
    got = {r.doc_id: r.licenses for r in licenses.scan(stored(rows(), SCHEMA, extra=True)).collect()}
    assert got == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "", 4: "Apache-2.0", 5: "", 6: "", 7: "GPL-3.0-only,MIT", None: "CC-BY-4.0", 8: "MIT", 9: "MPL-2.0"}
    assert licenses.scan(stored([], SCHEMA)).collect() == []


def brute(text):
    """The longest rule at each place of the sequence of known sentences, by plain Python."""
    known, rules = licenses.dictionary()
    best = []
    for low in ((text or "").lower() + "\n", re.sub(licenses.LINE, " ", (text or "").lower() + "\n")):
        parts = re.sub(licenses.OTHER, " ", re.sub(licenses.STOP, "\n", low)).split("\n")
        ids = [known.index(p.strip()) + 1 for p in parts if p.strip() in known]
        best = ids if len(ids) > len(best) else best
    rest, found = "," + ",".join(map(str, best)) + ",", set()
    for name, run in rules:
        if run in rest:
            found.add(name)
            rest = rest.replace(run, ",")
    return ",".join(map(str, best)), ",".join(sorted(found))


def test_brute_force_and_sql_agree(stored, tmp_path):
    docs = stored(rows(), SCHEMA)
    got = sorted(((r.doc_id or 0, r.sentences, r.licenses) for r in licenses.scan(docs).collect()))
    assert got == sorted((d or 0, *brute(t)) for d, t in rows())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows())
    assert sorted((d or 0, s, n) for d, s, n in con.execute(licenses.oracle()).fetchall()) == got


def test_every_rule_names_its_licence(stored):
    docs = [(i, ". ".join(licenses.SENTENCES[s] for s in names) + ".") for i, (_, names) in enumerate(licenses.RULES)]
    got = {r.doc_id: r.licenses for r in licenses.scan(stored(docs, SCHEMA)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(licenses.RULES)}
