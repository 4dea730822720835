"""License scan: phrase places, and an exact set-similarity join of text blocks with templates.

Templates are the usual short notices, and whole notices, headers and bodies of licenses. For a
template of W words, a text's blocks are its runs of 2 * W words that start at any of the template's
words, wherever in the text and whatever the lines: a run that starts elsewhere holds no more of the
template than the one that starts at its first common word. A template is found in a block that holds
at least `threshold` of its distinct words and, one after another, the words that decide which license
it is (a version beside its number, nc and sa in their places); words that belong to a longer
template must not stand in the block or in the W words after it. The join orders words by their
frequency over the whole corpus, rarest first, and tests

* prefix: a block without any of a template's first |T| - need + 1 words can't hold `need` of them;
* length: nor can a block with fewer than `need` words;
* position: nor one whose first common word stands too late among the template's;

first on a whole text, whose words hold those of all its blocks. In the few texts that remain, blocks
are sought around each place of a prefix word, each block at the first prefix word in it, and only
where the 4 * W words around the place hold `need`. The template side is a fixed table, so its index is a literal of the plan: documents are
scanned and neither moved nor exploded. Only the word frequencies are aggregated, one row a word.

Results for odd rows: null and empty texts have no words, places, blocks or labels and score 0;
repeated rows are scanned row by row; very long texts are one row each; an empty table gives no rows; columns other than doc_id and text are not read, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases and labels of the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: The headers of the GNU licenses: the usual sentence, with what it covers, the license and its version.
GNU = """This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the
Free Software Foundation, either version {} of the License, or (at your option) any later version."""
#: Fixed values: (label, template, what must stand in a block, words that must not). What must stand: phrases
#: between semicolons, each with its alternatives between bars.
TEMPLATES = (
    ("agpl-3.0", "licensed under the GNU Affero General Public License version 3", "gnu affero general public license;version 3|license 3|v3|v 3", ""),
    ("agpl-3.0", GNU.format("program", "Affero General Public License", 3), "gnu affero general public license;version 3 of", ""),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", "apache license;version 2|license 2|v2|v 2", ""),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "apache license;version 2|license 2|v2|v 2", "",
    ),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0", "boost software license;version 1|license 1", ""),
    ("bsd", "released under the BSD license", "bsd license", ""),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution.""",
        "redistribution;binary;source", "endorse",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of
        its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
        "redistribution;binary;source;endorse", "",
    ),
    ("cc-by-3.0", "licensed under CC BY 3.0", "cc by 3", ""),
    ("cc-by-3.0", "Creative Commons Attribution 3.0", "creative commons attribution 3", ""),
    ("cc-by-sa-3.0", "licensed under CC BY-SA 3.0", "cc by sa 3", ""),
    ("cc-by-sa-3.0", "Creative Commons Attribution-ShareAlike 3.0", "attribution sharealike 3", ""),
    ("cc-by-4.0", "licensed under CC BY 4.0", "cc by 4", ""),
    ("cc-by-4.0", "Creative Commons Attribution 4.0", "creative commons attribution 4", ""),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", "cc by nc 4", ""),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0", "attribution noncommercial 4", ""),
    ("cc-by-nc-nd-4.0", "licensed under CC BY-NC-ND 4.0", "cc by nc nd 4", ""),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0", "cc by nc sa 4", ""),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", "cc by nd 4", ""),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", "cc by sa 4", ""),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0", "attribution sharealike 4", ""),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal", "cc0 1", ""),
    ("gpl-2.0", GNU.format("program", "General Public License", 2), "gnu general public license;version 2 of", ""),
    ("gpl-2.0", "licensed under the GNU General Public License version 2", "gnu general public license;version 2|license 2|v2|v 2", ""),
    ("gpl-3.0", GNU.format("program", "General Public License", 3), "gnu general public license;version 3 of", ""),
    ("gpl-3.0", "this work is licensed under the GNU General Public License version 3", "gnu general public license;version 3|license 3|v3|v 3", ""),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        "gnu general public license;version 3", "",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
        OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
        "permission;fee;granted;disclaims", "",
    ),
    ("lgpl", GNU.format("library", "Lesser General Public License", "2.1"), "gnu lesser general public license", ""),
    ("lgpl", "licensed under the GNU Lesser General Public License", "gnu lesser general public license", ""),
    ("mit", "released under the MIT License", "mit license", ""),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
        to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
        OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "sublicense;furnished;granted", "",
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted;charge;obtaining", ""),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "mozilla public license;version 2|v 2|license 2", "",
    ),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license;version 2|v 2|license 2", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered;public domain", ""),
)
THRESHOLD = Fraction(4, 5)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



@dataclass(frozen=True)
class Entry:
    """A template's side of the index: its words rarest first, the prefix of these, the number that a
    block needs, the phrases that must stand in it, and its number of words."""

    label: str
    words: list[str]
    prefix: list[str]
    need: int
    must: list[list[str]]
    never: list[str]
    width: int


def tokens(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def lowered(text: Column) -> Column:
    """The text, null as empty, lower-cased in A-Z only."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def spaced(text: Column) -> Column:
    """Words between single spaces."""
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def lit(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t, *_ in templates for w in tokens(t)})


def split_words(docs: DataFrame) -> DataFrame:
    """doc_id, flat, the words between single spaces, and words, the array of them."""
    flat = docs.select("doc_id", spaced(lowered(F.col("text"))).alias("flat"))
    return flat.select("doc_id", "flat", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ")).alias("words"))


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Documents of the whole corpus with each template word: as many rows as the table has words."""
    known = vocabulary(templates)
    hit = split_words(docs).select(F.explode(F.array_intersect(lit(known), F.col("words"))).alias("w"))
    found = {r["w"]: r["n"] for r in hit.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: found.get(w, 0) for w in known}


def phrases_of(must: str) -> list[list[str]]:
    return [group.split("|") for group in must.split(";")]


def index(freq: dict[str, int], templates=TEMPLATES, threshold=THRESHOLD) -> list[Entry]:
    out = []
    for label, text, must, never in templates:
        ordered = sorted(set(tokens(text)), key=lambda w: (freq.get(w, 0), w))
        need = -(-threshold.numerator * len(ordered) // threshold.denominator)
        out.append(Entry(label, ordered, ordered[: len(ordered) - need + 1], need, phrases_of(must), never.split(), len(tokens(text))))
    return out


def stands(flat: Column, must: list[list[str]]) -> Column:
    """Whether one alternative of each phrase stands in words between single spaces."""
    inside = F.concat(F.lit(" "), flat, F.lit(" "))
    ok = F.lit(True)
    for group in must:
        any_of = F.lit(False)
        for p in group:
            any_of |= F.contains(inside, F.lit(f" {p} "))
        ok &= any_of
    return ok


def common(words: Column, e: Entry) -> Column:
    return F.size(F.array_intersect(lit(e.words), words))


def may_hold(have: Column, flat: Column, e: Entry) -> Column:
    """Whether a text with these distinct words can have a block with the template."""
    first = F.get(F.array_intersect(lit(e.prefix), have), F.lit(0))
    room = F.lit(len(e.words) + 1) - F.array_position(lit(e.words), first)
    return (F.size(have) >= e.need) & first.isNotNull() & (room >= e.need) & (common(have, e) >= e.need) & stands(flat, e.must)


def best_block(words: Column, e: Entry) -> Column:
    """The largest part of a template that any block of a text holds, null if none holds enough."""
    width = 2 * e.width
    start = lambda q: F.greatest(F.lit(0), q - (width - 1))
    run = lambda s, n: F.slice(words, s + 1, F.lit(n))
    rare = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(lit(e.prefix), F.get(words, i)))
    # Each place of a prefix word with the one before it: a block belongs to the first place in it.
    pairs = F.zip_with(rare, F.concat(F.array(F.lit(-1)), rare), lambda q, before: F.struct(q.alias("q"), before.alias("before")))
    near = F.filter(pairs, lambda x: x["q"].isNotNull() & (common(run(start(x["q"]), 2 * width), e) >= e.need))
    starts = F.flatten(F.transform(near, lambda x: F.filter(F.sequence(F.greatest(start(x["q"]), x["before"] + 1), x["q"]), lambda s: F.array_contains(lit(e.words), F.get(words, s)))))

    def part(s: Column) -> Column:
        held = common(run(s, width), e)
        ok = (held >= e.need) & stands(F.array_join(run(s, width), " "), e.must)
        if e.never:
            ok &= ~F.arrays_overlap(lit(e.never), run(s, width + e.width))
        return F.when(ok, held / F.lit(float(len(e.words))))

    return F.array_max(F.transform(starts, part))


def found(words: Column, flat: Column, have: Column, freq: dict[str, int], templates=TEMPLATES, threshold=THRESHOLD) -> Column:
    """Array of (label, part) of the templates that a text's blocks hold. have: the text's distinct
    words that templates have."""
    entries = index(freq, templates, threshold)
    some = [F.when(may_hold(have, flat, e), best_block(words, e)) for e in entries]
    kinds = [F.when(p.isNotNull(), F.struct(F.lit(e.label).alias("label"), p.alias("part"))) for p, e in zip(some, entries, strict=True)]
    return F.array_compact(F.array(*kinds))


def places(words: Column, flat: Column, phrases=PHRASES) -> Column:
    """Array of (at, label): where a phrase's words stand one after another. flat: words, spaced."""
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    inside = lambda p: F.contains(F.concat(F.lit(" "), flat, F.lit(" ")), F.lit(f" {p} "))

    def at(phrase: str, label: str) -> Column:
        test = lambda i: F.array(*[F.coalesce(F.get(words, i + k) == x, F.lit(False)) for k, x in enumerate(phrase.split())])
        hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.forall(test(i), lambda b: b))
        return F.when(inside(phrase), F.transform(hits, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))).otherwise(none)

    return F.concat(*[at(p, n) for p, n in phrases])


def scanned(docs: DataFrame, freq: dict[str, int], templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """doc_id, words, at (places of phrases) and found (labels and parts of templates)."""
    order = sorted(freq, key=lambda w: (freq[w], w))
    rows = split_words(docs).select("doc_id", "flat", "words", F.array_intersect(lit(order), F.col("words")).alias("have"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), places(F.col("words"), F.col("flat")).alias("at"), found(F.col("words"), F.col("flat"), F.col("have"), freq, templates, threshold).alias("found"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.
    score: the largest part of a template that a block holds; 1 where a phrase stands."""
    named = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    at = F.col("at")
    return scanned(docs, frequencies(docs, templates), templates, threshold).select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at["at"]).alias("first_word"), F.array_max(at["at"]).alias("last_word"),
        named(at["label"]).alias("base_labels"), named(F.concat(at["label"], F.col("found.label"))).alias("labels"),
        F.when(F.size(at) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("found.part")), F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same without an index: every run of every text that starts at a template's word."""
    rows = ", ".join(f"({i}, '{n}', {sorted(set(tokens(t)))}, {phrases_of(m)}::VARCHAR[][], {v.split()}::VARCHAR[], {len(tokens(t))})" for i, (n, t, m, v) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({p.split()}, '{n}')" for p, n in PHRASES)
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
template(i, label, words, must, never, width) AS (VALUES {rows}),
phrase(p, label) AS (VALUES {phrases}),
w AS (SELECT r, list_filter(regexp_split_to_array(low, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM d),
near AS (SELECT r, w, i FROM (SELECT r, w, list_distinct(w) AS s FROM w), template WHERE 5 * len(list_intersect(s, words)) >= 4 * len(words)),
start AS (SELECT r, i, unnest(list_filter(generate_series(1, len(w)), lambda k: list_contains(words, w[k]))) AS k FROM near JOIN template USING (i)),
block AS (SELECT r, label, words, must, never, w[k:k + 2 * width - 1] AS b, w[k:k + 3 * width - 1] AS wide FROM start JOIN near USING (r, i) JOIN template USING (i)),
found AS (SELECT r, label, len(list_intersect(list_distinct(b), words)) / len(words)::DOUBLE AS part FROM block
  WHERE 5 * len(list_intersect(list_distinct(b), words)) >= 4 * len(words) AND NOT list_has_any(wide, never)
  AND len(list_filter(must, lambda g: len(list_filter(g, lambda p: contains(' ' || array_to_string(b, ' ') || ' ', ' ' || p || ' '))) = 0)) = 0),
base AS (SELECT r, label, i - 1 AS i FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM w), phrase WHERE w[i:i + len(p) - 1] = p),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
f AS (SELECT r, max(part) AS part FROM found GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0)::DOUBLE END AS score
FROM d JOIN w USING (r) LEFT JOIN b USING (r) LEFT JOIN f USING (r) LEFT JOIN l USING (r)
"""
