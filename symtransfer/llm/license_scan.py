"""Licences by rules over recognised sentences.

Texts are cut into sentences, whose normalised form (ASCII letters and digits in lower case, other
characters as one space) is looked up among known licence sentences. A line ends a sentence too,
unless it and the lines after it together are a known one, as in wrapped or commented texts. The
identifiers found, in order, are matched against rules: ordered sequences of identifiers that stand
for a licence.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, read, real_id

# Public licence sentences by identifier.
SENTENCES = {
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2.",
    "ccbync4-short": "Licensed under CC BY-NC 4.0.",
    "ccby4-short": "Licensed under CC BY 4.0.",
    "ccbysa4-short": "Licensed under CC BY-SA 4.0.",
    "mit-short": "Released under the MIT License.",
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-may-not-use": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-copy-at": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-no-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-public": "This is free and unencumbered software released into the public domain.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
}
# Rules in order of precedence, of which a longer one hides shorter ones within it.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-no-endorsement"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-no-endorsement"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute", "gpl-hope"]),
    ("Apache-2.0", ["apache2-may-not-use", "apache2-copy-at"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope"]),
    ("BSD-2-Clause", ["bsd-redistribution"]),
    ("Apache-2.0", ["apache2-may-not-use"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("Unlicense", ["unlicense-public"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("CC-BY-NC-4.0", ["ccbync4-short"]),
    ("CC-BY-4.0", ["ccby4-short"]),
    ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("MIT", ["mit-short"]),
    ("Apache-2.0", ["apache2-short"]),
]

_CUT = re.compile(r"[.!?:;]+[\x20\x09-\x0D]+|\n")
_OTHER = re.compile(r"[^a-z0-9]+")
_UPPER = {i: i + 32 for i in range(65, 91)}


def normal(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.translate(_UPPER)).strip(" ")


class Recogniser:
    """Known sentences that the cutter itself cuts are known as the sequence of their parts."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> None:
        self.known: dict[str, str] = {}
        parts: dict[str, list[str]] = {}
        for name, sentence in sentences.items():
            cut = [x for x in map(normal, _CUT.split(sentence)) if x]
            parts[name] = [self.known.setdefault(x, name if len(cut) == 1 else f"{name}/{i}") for i, x in enumerate(cut)]
        self.rules = [(licence, [x for s in sequence for x in parts[s]]) for licence, sequence in rules]
        self.rules.sort(key=lambda r: -len(r[1]))
        self.begun = {x[:i] for x in self.known for i in range(len(x)) if x[i] == " "}
        # each known sentence has one of these words whole
        self.word = {max(x.split(), key=len) for x in self.known}
        self.some = re.compile("|".join(sorted(map(re.escape, self.word))), re.IGNORECASE | re.ASCII).search

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        if not self.some(text):
            return []
        pieces, at = [], 0
        for m in [*_CUT.finditer(text), None]:
            end = m.start() if m else len(text)
            pieces.append((at, end, normal(text[at:end]), m is not None and m.group() == "\n"))
            at = m.end() if m else at
        out, i = [], 0
        while i < len(pieces):
            start, end, words, line = pieces[i]
            j, best = i, (i, end, self.known.get(words))
            while line and words in self.begun and j + 1 < len(pieces):
                j += 1
                _, end, more, line = pieces[j]
                words = f"{words} {more}" if more else words
                if more and words in self.known:
                    best = j, end, self.known[words]
            j, end, name = best
            if name is not None:
                out.append((name, start, end))
                i = j
            i += 1
        return out

    def licences(self, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        names = [x[0] for x in found]
        used = [False] * len(names)
        out = []
        for licence, sequence in self.rules:
            n = len(sequence)
            for i in range(len(names) - n + 1):
                if names[i : i + n] == sequence and not any(used[i : i + n]):
                    used[i : i + n] = [True] * n
                    out.append((i, licence, found[i][1], found[i + n - 1][2]))
        return [x[1:] for x in sorted(out)]


SPAN = pa.struct([("licence", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, n_sentences (recognised ones), licences (distinct, sorted), spans (licence, start, stop; code points).

    A rule matches where its sentences are consecutive among the recognised ones; longer rules go first and a sentence
    counts for one match. Null and empty texts have none. Rows may repeat; an empty table gives no rows.
    """
    recogniser = Recogniser(sentences, rules)

    def run(batches):
        for batch in batches:
            found = [recogniser.sentences(t) for t in batch["text"].to_pylist()]
            spans = [[{"licence": a, "start": b, "stop": c} for a, b, c in recogniser.licences(f)] for f in found]
            names = [sorted({s["licence"] for s in x}) for x in spans]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(map(len, found), pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(SPAN))], names=["id", "n_sentences", "licences", "spans"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_sentences long, licences array<string>, spans array<struct<licence string, start long, stop long>>")
    return out.select(real_id().alias(id_col), "n_sentences", "licences", "spans")


def op7_license_sentence_rules(spark, sf_dir):
    from pyspark.sql import functions as F

    return license_scan(read(spark, sf_dir)).select("doc_id", "n_sentences", F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    """The same by DuckDB: identifiers of recognised sentences, in order, against the rules.

    Rules without a shorter or longer rival are matched anywhere; where one rule is part of a longer one, what the longer took is cut out first.
    """
    r = Recogniser(SENTENCES, RULES)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in r.known.items())
    rest = "CASE WHEN names IS NULL THEN '' ELSE '[' || array_to_string(names, '][') || ']' END"
    steps = []
    for i, (licence, sequence) in enumerate(r.rules):
        part = quote("".join(f"[{x}]" for x in sequence))
        steps.append(f"s{i} AS (SELECT doc_id, n, CASE WHEN contains(s, {part}) THEN list_append(l, {quote(licence)}) ELSE l END AS l, replace(s, {part}, '|') AS s FROM s{i - 1})" if i else f"s0 AS (SELECT doc_id, n, CASE WHEN contains(s, {part}) THEN [{quote(licence)}] ELSE [] END AS l, replace(s, {part}, '|') AS s FROM base)")
    return f"""
WITH known(t, name) AS (VALUES {known}),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split_regex(coalesce(text, ''), '[.!?:;]+[\\x20\\x09-\\x0D]+') AS p FROM documents),
e AS (SELECT r, unnest(p) AS t, unnest(range(len(p))) AS i FROM d),
l AS (SELECT r, i, list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ')) AS n FROM e),
a AS (SELECT r, i, n, unnest(range(1, len(n) + 1)) AS a FROM l),
j AS (SELECT r, i, a, unnest(list_transform(range(a, least(len(n), a + 40) + 1), lambda b: array_to_string(list_filter(list_slice(n, a, b), lambda x: x <> ''), ' '))) AS t, unnest(range(a, least(len(n), a + 40) + 1)) AS b, n FROM a
  WHERE n[a] <> '' AND EXISTS (SELECT 1 FROM known k WHERE k.t = n[a] OR starts_with(k.t, n[a] || ' '))),
f AS (SELECT r, list(name ORDER BY i, a) AS names FROM (SELECT j.r, j.i, j.a, max_by(k.name, CASE WHEN n[b] = '' THEN 0 ELSE j.b END) AS name FROM j JOIN known k ON k.t = j.t GROUP BY ALL) GROUP BY 1),
base AS (SELECT doc_id, coalesce(len(names), 0) AS n, {rest} AS s FROM d LEFT JOIN f USING (r)),
{", ".join(steps)}
SELECT doc_id, n AS n_sentences, coalesce(list_aggregate(list_sort(list_distinct(l)), 'string_agg', ','), '') AS licences FROM s{len(r.rules) - 1}
"""


SQL = _sql()
