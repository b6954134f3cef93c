"""Quality rules, line dedup, decontamination and license scan on small fixtures, and against their SQL."""

import hashlib

import duckdb
import pytest

from reamwork.llm import decontaminate, licenses, line_dedup, quality_rules

DOCS = "doc_id bigint, text string, row string, words string, id string"


def docs(frame, *texts):
    return frame([(i, t, "r", "w", "x") for i, t in enumerate(texts)], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


GOOD = "the quick brown fox and the lazy dog sat in the sun for a long time with all of us watching it there"
ODD_TEXTS = [None, "", " \n\t ", "one", GOOD, GOOD, "a b c d e f g h " * 6, "x" * 50_000, "é ü " * 400, "\n".join(["the same line"] * 30)]


def test_quality_rules(frame):
    got = by_id(quality_rules.quality_rules(docs(frame, *ODD_TEXTS, GOOD.replace("fox", "f$$$|||x###"))))
    assert [got[i]["kept"] for i in range(11)] == [False] * 4 + [True, True] + [False] * 4 + [False]
    assert (got[6]["n_words"], got[6]["n_repeat_words"], got[6]["base_failed"]) == (48, 48, True)
    assert (got[9]["n_dup_lines"], got[0]["n_words"], got[10]["n_symbols"]) == (29, 0, 9)
    kept = quality_rules.keep_good(docs(frame, *ODD_TEXTS))
    assert kept.columns == ["doc_id", "text", "row", "words", "id"] and {r.doc_id for r in kept.collect()} == {4, 5}
    assert quality_rules.quality_rules(docs(frame, *ODD_TEXTS).limit(0)).count() == 0


def test_line_dedup(frame):
    block = "first line\nsecond line\nthird line"
    texts = [f"{block}\nmore", f"before\n{block}\n\nafter", "first line\nsecond line", None, "", block + "\n" + block, " \n\n"]
    got = by_id(line_dedup.line_dedup(docs(frame, *texts)))
    assert [got[i]["n_removed"] for i in range(7)] == [0, 3, 0, 0, 0, 6, 0]
    assert got[1]["text"] == "before\n\nafter" and got[3]["text"] is None and got[5]["text"] == "" and got[6]["text"] == " \n\n"
    kept = line_dedup.dedup_lines(docs(frame, *texts))
    assert kept.columns == ["doc_id", "text", "row", "words", "id"] and kept.count() == 7
    assert line_dedup.line_dedup(docs(frame, "a").limit(0)).count() == 0
    twice = docs(frame, block).union(docs(frame, block))
    assert [r["n_removed"] for r in line_dedup.line_dedup(twice).collect()] == [0, 0]


ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("items", [[(1, ITEM), (10, "short item"), (2, ITEM), (3, None), (4, "")], []])
def test_decontaminate_equals_sql(frame, items):
    texts = [None, "", "nothing here", f"He said: {ITEM.upper()}!", "one two three four five six seven eight nine", "a short, item b",
             (ITEM + " ") * 3, "two three four five six seven eight nine ten eleven", "w " * 3000 + ITEM + " z" * 3000]
    bench = frame(items, "item_id bigint, text string")
    table = docs(frame, *texts).union(docs(frame, *texts[:1]))
    got = sorted(decontaminate.decontaminate(table, bench).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if items:
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)) + [(0, None)])
    want = con.execute(decontaminate.ORACLE_SQL).fetchall()
    assert [tuple(r) for r in got] == sorted(want)
    clean = decontaminate.keep_clean(table, bench)
    assert clean.columns == table.columns and clean.count() == sum(not r["contaminated"] for r in got)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0]["items_sha256"] == empty


def test_license_scan(frame):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [None, "", "Text. Licensed under CC BY-NC 4.0. More.", f"MIT License\n{mit}:\n{notice}", notice,
             "Released under the MIT License.\n" * 2 + "This work is licensed under the GNU General Public License, version 3."]
    got = by_id(licenses.license_scan(docs(frame, *texts)))
    assert [got[i]["licenses"] for i in range(6)] == ["", "", "CC-BY-NC-4.0:1", "MIT:1", "", "GPL-3.0:1,MIT:2"]
    assert got[2]["recognised"] == "2:cc-by-nc-named" and got[4]["n_recognised"] == 1
    assert licenses.license_scan(docs(frame, "a").limit(0)).count() == 0


WRAPPED = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "BSD-2-Clause": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
""",
    "GPL-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
""",
}


def test_wrapped_license_texts(frame):
    got = by_id(licenses.license_scan(docs(frame, *WRAPPED.values(), *(t.replace("\n", "\r\n") for t in WRAPPED.values()), "Released under the.\nMIT license")))
    names = [*WRAPPED] * 2
    assert [got[i]["licenses"] for i in range(len(names))] == [f"{n}:1" for n in names]
    assert [got[i]["n_recognised"] for i in range(len(names))] == [3, 3, 3, 5, 1] * 2
    assert got[0]["recognised"] == "1:mit-title-short,3:mit-grant,10:mit-notice" and got[10]["n_recognised"] == 1 and got[10]["recognised"].startswith("2:")
