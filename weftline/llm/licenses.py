"""License scans by sentence rules, as one expression of built-in functions for each row.

A text is cut into sentences twice: at stops followed by white space with lines joined (wrapped license texts), and at
line ends as well (notices on a line of their own). Sentences are normalised (lower case, runs of anything but a-z and
0-9 become one space) and mapped to the identifiers of known license sentences; unknown sentences have none. A known
sentence that itself holds an end is the sequence of all its parts, one right after another. The ordered identifiers of
a text are matched against the rules of each license: its identifiers in that order, one after another.

Sentences have variable parts, such as the holders' names: before the cut ``VARIABLES`` puts fixed words in their place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Known license sentences, by identifier.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0",
    2: 'Licensed under the Apache License, Version 2.0 (the "License")',
    3: "you may not use this file except in compliance with the License",
    4: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    5: 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    6: "See the License for the specific language governing permissions and limitations under the License",
    7: "Released under the MIT License",
    8: "Licensed under the MIT License",
    9: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    10: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    11: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    12: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    13: "This work is licensed under the GNU General Public License, version 3",
    14: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    15: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    16: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    17: "See the GNU General Public License for more details",
    18: "Licensed under CC BY-NC 4.0",
    19: "Licensed under CC BY 4.0",
    20: "Licensed under CC BY-SA 4.0",
    21: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    22: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    23: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    24: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    25: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    26: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    27: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    28: "This is free and unencumbered software released into the public domain",
    29: "SPDX-License-Identifier: MIT",
    30: "SPDX-License-Identifier: Apache-2.0",
    31: "SPDX-License-Identifier: GPL-3.0-or-later",
    32: "SPDX-License-Identifier: BSD-3-Clause",
    33: "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    34: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    35: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    36: "See the GNU Lesser General Public License for more details",
    37: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    38: "See the GNU Affero General Public License for more details",
    39: "Distributed under the Boost Software License, Version 1.0",
    40: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    41: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    42: 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    43: "SPDX-License-Identifier: AGPL-3.0-or-later",
    44: "SPDX-License-Identifier: BSD-2-Clause",
    45: "SPDX-License-Identifier: BSL-1.0",
    46: "SPDX-License-Identifier: CC-BY-4.0",
    47: "SPDX-License-Identifier: CC-BY-SA-4.0",
    48: "SPDX-License-Identifier: CC0-1.0",
    49: "SPDX-License-Identifier: EPL-2.0",
    50: "SPDX-License-Identifier: GPL-2.0-only",
    51: "SPDX-License-Identifier: GPL-2.0-or-later",
    52: "SPDX-License-Identifier: GPL-3.0-only",
    53: "SPDX-License-Identifier: ISC",
    54: "SPDX-License-Identifier: LGPL-2.1-or-later",
    55: "SPDX-License-Identifier: MPL-2.0",
    56: "SPDX-License-Identifier: Unlicense",
}
# Variable parts of lower-cased texts, and the words that stand for them in the sentences above.
VARIABLES = [
    (r"neither the names? of [^.;]{1,200}? nor the names? of (?:its|their|any|other)[a-z ]{0,20}contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"in no event shall [^.;]{1,200}? be liable for any claim", "in no event shall the authors or copyright holders be liable for any claim"),
    (r"this software is provided by [^.;]{1,200}? [\"'`]{0,2}as is[\"'`]{0,2} and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"https://", "http://"),
]
# Ordered rules, license to alternatives.
RULES = {
    "Apache-2.0": [(1,), (2, 3), (2, 33), (30,)],
    "AGPL-3.0-or-later": [(37, 16, 38), (43,)],
    "BSD-2-Clause": [(22, 23, 24, 42), (44,)],
    "BSD-3-Clause": [(22, 23, 24, 25), (32,)],
    "BSL-1.0": [(39,), (45,)],
    "CC-BY-4.0": [(19,), (21,), (46,)],
    "CC-BY-NC-4.0": [(18,)],
    "CC-BY-SA-4.0": [(20,), (47,)],
    "CC0-1.0": [(41,), (48,)],
    "EPL-2.0": [(40,), (49,)],
    "GPL-2.0": [(50,)],
    "GPL-2.0-or-later": [(15, 16, 17), (51,)],
    "GPL-3.0": [(13,), (52,)],
    "GPL-3.0-or-later": [(14, 16, 17), (31,)],
    "ISC": [(26,), (53,)],
    "LGPL-2.1-or-later": [(34, 35, 36), (54,)],
    "MIT": [(7,), (8,), (9, 10, 11, 12), (29,)],
    "MPL-2.0": [(27,), (55,)],
    "Unlicense": [(28,), (56,)],
}
#: Some word of every known sentence; texts without any of them are not cut.
HINT = "licen[sc]|warrant|permission|redistribut|public domain|liable|obtain a copy|neither the name"
#: Ends of sentences: in wrapped text, and where each line end is one too. A stop within a number or name is no end.
ENDS = {"wrapped": r"[.:;!?]+\s+|\n\s*\n", "lines": r"[.:;!?]+[ \t]+|\s*\n\s*"}


def normal(sentence: str) -> str:
    """The normal form of a sentence, as the expressions below make it."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def sequences() -> dict[int, list[str]]:
    """The normal forms of all parts of each known sentence, in order."""

    def fixed(sentence: str) -> str:
        for pattern, words in VARIABLES:
            sentence = re.sub(pattern, words, sentence)
        return sentence

    return {i: [normal(part) for part in re.split(r"[.:;!?]+\s+", fixed(sentence.lower()))] for i, sentence in SENTENCES.items()}


def marks() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Normal forms of parts to marks, and (marks of all parts, mark) of each sentence, those of most parts first."""
    numbers: dict[str, int] = {}
    whole = {i: "".join(f"<{numbers.setdefault(part, len(numbers) + 1)}>" for part in parts) for i, parts in sequences().items()}
    return {"": "", **{p: f"<{k}>" for p, k in numbers.items()}}, [(mark, f"[{i}]") for i, mark in sorted(whole.items(), key=lambda x: -x[1].count("<"))]


def rule_patterns() -> list[tuple[str, str]]:
    """(license, identifiers between commas) of all rules."""
    return [(name, "," + ",".join(map(str, rule)) + ",") for name, rules in sorted(RULES.items()) for rule in rules]


def identifiers(text: Column, ends: str) -> Column:
    """The identifiers of the text's known sentences, in order, between commas.

    Parts are written as <number>, an unknown one as <0>, empty ones not at all; then sentences, those of most parts
    first, take the place of their parts.
    """
    parts, whole = marks()
    known = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    low = F.lower(text)
    for pattern, words in VARIABLES:
        low = F.regexp_replace(low, pattern, words)
    cut = F.split(low, ends)
    found = F.array_join(F.transform(cut, lambda s: F.coalesce(F.try_element_at(known, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), F.lit("<0>"))), "")
    for mark, name in whole:
        found = F.replace(found, F.lit(mark), F.lit(name))
    return F.concat(F.lit(","), F.array_join(F.regexp_extract_all(found, F.lit(r"\[([0-9]+)\]"), F.lit(1)), ","), F.lit(","))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses for every row of ``docs`` (doc_id, text).

    ``licenses`` has the names of all licenses with a rule that matches, sorted, between commas; empty if there is none,
    as for a null text. Sentences are counted by the cut at line ends. Rows are independent, so repeated rows repeat.
    """
    hinted = F.lower("text").rlike(HINT)
    found = docs.select("doc_id", *[F.when(hinted, identifiers(F.col("text"), ends)).otherwise(F.lit(",,")).alias(name) for name, ends in ENDS.items()])
    by_license: dict[str, Column] = {}
    for name, pattern in rule_patterns():
        hit = F.col("wrapped").contains(pattern) | F.col("lines").contains(pattern)
        by_license[name] = by_license[name] | hit if name in by_license else hit
    names = F.concat_ws(",", *[F.when(hit, F.lit(name)) for name, hit in by_license.items()])
    ids = F.when(F.col("lines").isNull() | (F.col("lines") == ",,"), F.lit("")).otherwise(F.trim(F.col("lines"), F.lit(",")))
    count = F.when(ids == "", 0).otherwise(F.size(F.split(ids, ",")))
    return found.select("doc_id", count.cast("long").alias("n_sentences"), ids.alias("sentence_ids"), names.alias("licenses"))


def scan_sql() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts, whole = marks()
    known, low = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in parts.items()) + "}", "lower(text)"
    for pattern, words in VARIABLES:
        low = f"regexp_replace({low}, {quote(pattern)}, {quote(words)}, 'g')"
    cut = {}
    for name, ends in ENDS.items():
        one = f"array_to_string(list_transform(regexp_split_to_array({low}, {quote(ends)}), lambda s: coalesce({known}[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))], '<0>')), '')"
        for mark, number in whole:
            one = f"replace({one}, '{mark}', '{number}')"
        cut[name] = f"',' || array_to_string(regexp_extract_all({one}, '\\[([0-9]+)\\]', 1), ',') || ','"
    by_license: dict[str, list[str]] = {}
    for name, pattern in rule_patterns():
        by_license.setdefault(name, []).extend(f"contains({c}, {quote(pattern)})" for c in ENDS)
    names = ", ".join(f"CASE WHEN {' OR '.join(hits)} THEN {quote(name)} END" for name, hits in by_license.items())
    columns = ", ".join(f"CASE WHEN regexp_matches(lower(text), {quote(HINT)}) THEN {cut[name]} ELSE ',,' END AS {name}" for name in ENDS)
    return f"""WITH found AS (SELECT doc_id, {columns} FROM documents),
ids AS (SELECT *, CASE WHEN lines IS NULL OR lines = ',,' THEN '' ELSE trim(lines, ',') END AS sentence_ids FROM found)
SELECT doc_id, CASE WHEN sentence_ids = '' THEN 0 ELSE len(string_split(sentence_ids, ',')) END::BIGINT AS n_sentences,
sentence_ids, concat_ws(',', {names}) AS licenses FROM ids"""
