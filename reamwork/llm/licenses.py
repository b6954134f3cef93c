"""License scans: known sentences to identifiers, sequences of identifiers to ordered rules.

A text is cut into sentences (at line ends and after ``.``, ``!`` or ``?`` before white space) and each is
normalised: lower case, every run of characters other than letters and digits one space. A normalised
sentence of :data:`SENTENCES` is recognised as its identifier. So is one that goes on over line ends (not after ``.``,
``!`` or ``?``, other than that of ``v.``), with comment marks or empty lines between; its place is that of its first line. The identifiers of a text, in order, are
matched against :data:`RULES`: a rule is a sequence of identifiers that must occur in that order with
nothing else recognised between them. Rules are tried from the most to the least specific; what a rule
matched is taken out before the next one looks, so a version-3-or-later notice is not also version 3.

Both tables are short and fixed, so they are literals of the expressions: nothing is joined, shuffled or
broadcast, and a text is scanned inside its own row.

Defined results: a null or empty text has no sentence and no license; a sentence repeated is recognised
each time and a license found twice is named once, with its count; of rules that match the same place the earlier in
the table wins; repeated rows are scanned each for itself; an empty table gives an empty table; other columns do not
matter and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, field

#: Sentences of public license texts and notices, normalised, by identifier.
SENTENCES = {
    "apache-named": "licensed under the apache license version 2 0",
    "apache-the": "licensed under the apache license version 2 0 the license",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-named": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-named": "this work is licensed under the gnu general public license version 3",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl2-named": "licensed under the gnu general public license version 2",
    "gpl-redistribute-3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-program-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-program-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-named": "licensed under cc by nc 4 0",
    "cc-by-sa-named": "licensed under cc by sa 4 0",
    "cc-by-named": "licensed under cc by 4 0",
    "cc0-named": "licensed under cc0 1 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

#: Rules from the most to the least specific: license and sequence of identifiers.
RULES = (
    ("Apache-2.0", ("apache-the", "apache-may-not", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-the", "apache-may-not")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-title-short", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-program-3", "gpl-no-warranty", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-program-3",)),
    ("GPL-3.0-or-later", ("gpl-redistribute-3",)),
    ("GPL-2.0-or-later", ("gpl-program-2", "gpl-no-warranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-program-2",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-the",)),
    ("Apache-2.0", ("apache-named",)),
    ("MIT", ("mit-named",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("GPL-3.0", ("gpl3-named",)),
    ("GPL-3.0", ("gpl3-licensed",)),
    ("GPL-2.0", ("gpl2-named",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-named",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-named",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-4.0", ("cc-by-named",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC0-1.0", ("cc0-named",)),
    ("MPL-2.0", ("mpl2-form",)),
)


def raw_sentences(text: Column) -> Column:
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\r]+", "$1\n")
    return F.split(lines, "\n")


def _marked(s: Column, i: Column) -> Column:
    """Number, tab, normalised sentence, and how it ends: a line feed, or a return where it may go on in the next line."""
    ends = s.rlike(r"[.!?][^\p{L}\p{N}]*$") & ~s.rlike(r"(?i)(?<![\p{L}\p{N}])v\.\s*$")
    return F.concat((i + 1).cast("string"), F.lit("\t"), F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")),
                    F.when(ends, "\n").otherwise("\r"))


#: A sentence of the table, over one or more marked sentences. The longest first.
_GOES_ON = r"\r\d+\t"
_KNOWN = r"\d+\t(?:" + "|".join(
    s.replace(" ", rf"(?: |(?:{_GOES_ON})+)") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + r")[\n\r]"


def _named(sentence: Column) -> Column:
    known = iter(SENTENCES.items())
    name, first = next(known)
    case = F.when(sentence == first, F.lit(name))
    for name, text in known:
        case = case.when(sentence == text, F.lit(name))
    return case


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: recognised sentences with their places, and the licenses with their counts."""
    rows = boxed(df).select(field(doc_id).alias("doc_id"), raw_sentences(field(text)).alias("sentences"))
    known = rows.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.transform(
        F.regexp_extract_all(F.array_join(F.transform("sentences", _marked), ""), F.lit(_KNOWN), 0),
        lambda m: F.struct(F.regexp_extract(m, r"^(\d+)\t", 1).cast("int").alias("place"), F.trim(F.regexp_replace(
            F.regexp_replace(m, r"^\d+\t|[\n\r]$", ""), rf"(?:{_GOES_ON})+", " ")).alias("s"))).alias("known"))
    named = known.select("doc_id", "n_sentences", F.transform("known", lambda x: F.struct(
        x["place"].alias("place"), _named(x["s"]).alias("sentence_id"))).alias("recognised"))
    # The identifiers as one string, each between bars: "|a||b|". A matched sequence becomes "#rule#".
    start = F.array_join(F.transform("recognised", lambda x: F.concat(F.lit("|"), x["sentence_id"], F.lit("|"))), "")
    sequence = start
    for place, (_, ids) in enumerate(RULES):
        sequence = F.replace(sequence, F.lit("".join(f"|{i}|" for i in ids)), F.lit(f"#{place}#"))
    matched = named.withColumn("matched", F.when(F.size("recognised") > 0, sequence).otherwise(""))
    numbers = F.regexp_extract_all("matched", F.lit(r"#(\d+)#"), 1)
    licenses = F.array(*[F.lit(name) for name, _ in RULES])
    found = matched.withColumn("found", F.transform(numbers, lambda n: F.get(licenses, n.cast("int"))))
    return found.select(
        "doc_id", "n_sentences", F.size("recognised").cast("bigint").alias("n_recognised"), "recognised",
        F.transform(F.array_sort(F.array_distinct("found")), lambda name: F.struct(
            name.alias("license"), F.size(F.filter("found", lambda f: f == name)).cast("bigint").alias("times"))).alias("licenses"),
    )


def license_scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`scan` with its lists as strings: ``place:sentence`` and ``license:times``, comma-joined."""
    return scan(df, doc_id, text).select(
        "doc_id", "n_sentences", "n_recognised",
        F.array_join(F.transform("recognised", lambda x: F.concat_ws(":", x["place"], x["sentence_id"])), ",").alias("recognised"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["times"])), ",").alias("licenses"),
    )


#: The sentences of the tables of this repository, written out anew.
ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS ss FROM documents),
n AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS place, trim(regexp_replace(lower(unnest(ss)), '[^\p{L}\p{N}]+', ' ', 'g')) AS s FROM s),
known(s, sid, license) AS (VALUES
  ('licensed under the apache license version 2 0', 'apache-named', 'Apache-2.0'),
  ('released under the mit license', 'mit-named', 'MIT'),
  ('this work is licensed under the gnu general public license version 3', 'gpl3-named', 'GPL-3.0'),
  ('licensed under cc by nc 4 0', 'cc-by-nc-named', 'CC-BY-NC-4.0')),
hits AS (SELECT doc_id, place, sid, license FROM n JOIN known USING (s)),
seen AS (SELECT doc_id, count(*) AS n_recognised, string_agg(place || ':' || sid, ',' ORDER BY place) AS recognised FROM hits GROUP BY doc_id),
times AS (SELECT doc_id, license, count(*) AS c FROM hits GROUP BY doc_id, license),
named AS (SELECT doc_id, string_agg(license || ':' || c, ',' ORDER BY license) AS licenses FROM times GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, coalesce(n_recognised, 0) AS n_recognised,
  coalesce(recognised, '') AS recognised, coalesce(licenses, '') AS licenses
FROM s LEFT JOIN seen USING (doc_id) LEFT JOIN named USING (doc_id)
"""
