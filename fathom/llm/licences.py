"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

One projection of built-in functions; no shuffle, no Python. Compared are a document as a whole, its lines, its
sentences, and windows of its words: wherever a bigram of a template stands, a window of the template's length is
laid so that the bigram is where the template has it. Normalising drops line ends and comment marks, so a notice
that is wrapped or commented out inside a long file is a window.
Exact bounds spare work: a unit that reaches the least coefficient t against a template of b bigrams has between
t*b/(2-t) and (2-t)*b/t of its own, and as many as the former of the template's. So a document is compared with
the templates of which it holds that many bigrams, and its bigrams are made where it holds one of the words
without which too many of a template's would be missing.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

LEAST = 0.8
#: Anchors of a template in the SQL, at most.
ANCHORS = 12
#: Letters of a word that running text seldom has.
TELLING = 6

MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

#: The notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": BSD_HEAD,
    "BSD-2-Clause-text": f"{BSD_HEAD} {BSD_TWO} {BSD_TAIL}",
    "BSD-3-Clause-text": f"{BSD_HEAD} {BSD_TWO} {BSD_THREE} {BSD_TAIL}",
    "BSD-license": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": ISC_GRANT,
    "ISC-text": f"{ISC_GRANT} {AS_IS}",
    "MIT": "Released under the MIT License.",
    "MIT-grant": MIT_GRANT,
    "MIT-text": f'{MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = "[^a-z0-9]+"
SENTENCE = "\\n|[.!?]+[ \\t]+"


def words_of(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(b: int, least: float) -> tuple[int, int, int]:
    """For a template of b bigrams: fewest and most of a unit that can reach `least`, and how many of the
    template's it may lack."""
    t = Fraction(str(least))
    return math.ceil(t * b / (2 - t)), math.floor((2 - t) * b / t), math.floor(b * (2 - 2 * t) / (2 - t))


def anchors(text: str, least: float, most: int = ANCHORS) -> list[tuple[str, int]]:
    """(bigram, its place) of a template, one more than a match may lack, `most` at most: from each of as many
    equal parts of the template that of the longest word which no other part has; those of short words alone
    are left out where two others are left."""
    words, found = words_of(text), {}
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    n = min(bounds(len(set(grams)), least)[2] + 1, most)
    for k in range(n):
        part = [i for i in range(k * len(grams) // n, (k + 1) * len(grams) // n) if grams[i] not in found]
        if part:
            best = max(part, key=lambda i: (max(map(len, grams[i].split())), len(grams[i]), -i))
            found[grams[best]] = best
    telling = {g: i for g, i in found.items() if len(longest(g)) >= TELLING}
    return list((telling if len(telling) > 1 else found).items())


def marks_of(text: str, least: float) -> list[str]:
    """Words, the longest first, of which every unit or window that reaches `least` holds one: they stand in
    more bigrams of the template than a match may lack."""
    grams = bigrams(text)
    touched: set[str] = set()
    found, lack = [], bounds(len(grams), least)[2]
    for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        new = {g for g in grams if word in g.split()} - touched
        if new and len(touched) <= lack:
            found.append(word)
            touched |= new
    return found


def longest(gram: str) -> str:
    return max(gram.split(), key=len)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_matches, licence, dice: one row per document.

    Compared are the whole text, its lines, its sentences and the windows that the templates' bigrams place;
    whichever bigrams a match lacks, it is found. n_matches counts the licences that a unit or window reaches with `least` (a unit counts for
    its best); licence and dice are of the best, by coefficient and then by name; null where there is none, as
    for null and empty texts. Texts are scanned whole; rows that repeat, with a doc_id or without, have a row
    each; an empty table gives none. Columns other than doc_id and text are not read. `templates` are few and
    part of the query; templates of one word never match.
    """
    grams = {name: g for name, text in sorted(templates.items()) if (g := bigrams(text))}
    strings = lambda x: f"array({', '.join(map(quoted, x))})"
    row_of = {n: [f"{a} {b}" for a, b in zip(w, w[1:])] for n in grams if (w := words_of(templates[n]))}
    listed = ", ".join(f"named_struct('name', {quoted(n)}, 'grams', {strings(g)}, 'places', {strings(row_of[n])}, 'low', {bounds(len(g), least)[0]}, 'high', {bounds(len(g), least)[1]})" for n, g in grams.items())
    every = strings(sorted({x for g in grams.values() for x in g}))
    marks = strings(sorted({w for n in grams for w in marks_of(templates[n], least)}))
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    plain = need(docs, "doc_id", "text").select("doc_id", low.alias("low"), F.concat(F.lit(" "), F.regexp_replace(low, WORD_GAP, " "), F.lit(" ")).alias("whole"))
    norm = f"trim(regexp_replace(x, '{WORD_GAP}', ' '))"
    units = f"array_distinct(concat(array(trim(whole)), transform(split(low, '\\n'), x -> {norm}), transform(split(low, '{SENTENCE}'), x -> {norm})))".replace("\\", "\\\\")
    word_pairs = "transform(filter(transform(units, u -> split(u, ' ')), w -> size(w) > 1), w -> array_distinct(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))))"
    # a shared bigram counts for both sides
    matched = f"""filter(transform(pairs, g -> array_min(transform(filter(near, t -> size(g) BETWEEN t.low AND t.high),
        t -> named_struct('less', -2.0D * size(array_intersect(g, t.grams)) / (size(g) + size(t.grams)), 'name', t.name)))), m -> m.less <= -{least}D)"""
    row = "CASE WHEN size(words) > 1 THEN transform(sequence(0, size(words) - 2), i -> concat(words[i], ' ', words[i + 1])) ELSE array() END"
    hits = "filter(transform(row, (g, i) -> CASE WHEN array_contains(t.grams, g) THEN named_struct('i', i, 'gram', g) END), h -> h IS NOT NULL)"
    starts = f"array_distinct(flatten(transform({hits}, h -> filter(transform(t.places, (g, at) -> CASE WHEN g = h.gram THEN h.i - at END), s -> s IS NOT NULL))))"
    cut = f"flatten(transform(near, t -> transform({starts}, s -> named_struct('t', t, 'start', greatest(s, 0), 'end', least(s + size(t.places), size(row))))))"
    seen = f"""filter(transform(transform(laid, w -> named_struct('t', w.t, 'g', array_distinct(slice(row, w.start + 1, w.end - w.start)))),
        w -> named_struct('less', -2.0D * size(array_intersect(w.g, w.t.grams)) / (size(w.g) + size(w.t.grams)), 'name', w.t.name)), m -> m.less <= -{least}D)"""
    if not grams:
        return plain.select("doc_id", F.lit(0).cast("long").alias("n_matches"), F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("dice"))
    return (
        plain.withColumn("words", F.expr("split(trim(whole), ' ')"))
        .withColumn("row", F.expr(f"CASE WHEN arrays_overlap(words, {marks}) THEN {row} END"))
        .withColumn("held", F.expr(f"array_intersect(row, {every})"))
        .withColumn("near", F.expr(f"filter(array({listed}), t -> size(held) >= t.low AND size(array_intersect(held, t.grams)) >= t.low)"))
        .withColumn("near", F.expr("CASE WHEN size(near) > 0 THEN near END"))
        .withColumn("units", F.expr(f"CASE WHEN near IS NOT NULL THEN {units} END")).withColumn("pairs", F.expr(word_pairs))
        .withColumn("laid", F.expr(cut))
        .withColumn("matches", F.expr(f"concat({matched}, {seen})"))
        .withColumn("best", F.array_min("matches"))
        .select("doc_id", F.coalesce(F.size(F.array_distinct(F.transform("matches", lambda m: m["name"]))), F.lit(0)).cast("long").alias("n_matches"), F.col("best.name").alias("licence"), (-F.col("best.less")).alias("dice"))
        .withColumn("n_matches", F.greatest("n_matches", F.lit(0).cast("long")))
    )


def scan_sql(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same in DuckDB's SQL, without the bounds, for documents whose matches hold an anchor: it lays windows
    by anchors alone, and leaves documents without any."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(n)}, [{', '.join(map(q, bigrams(t)))}], {len(words_of(t)) - 1})" for n, t in sorted(templates.items()) if bigrams(t))
    held = ", ".join(f"({q(n)}, {q(g)}, {at})" for n, t in sorted(templates.items()) for g, at in anchors(t, least))
    norm = f"trim(regexp_replace(x, '{WORD_GAP}', ' ', 'g'))"
    return f"""
WITH t(name, grams, length) AS (VALUES {rows}),
a(name, gram, place) AS (VALUES {held}),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
full_ AS (SELECT rid, string_split(w, ' ') AS w FROM (SELECT rid, {norm.replace('(x,', '(low,')} AS w FROM d) WHERE contains(w, ' ')),
rows_ AS (SELECT rid, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS g FROM full_),
placed AS (SELECT rid, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS i FROM rows_),
laid AS (SELECT DISTINCT rid, name, i - place AS start FROM placed JOIN a USING (gram)),
windows AS (SELECT rid, name, list_distinct(g[greatest(start, 0) + 1 : least(start + length, len(g))]) AS g, grams FROM laid JOIN rows_ USING (rid) JOIN t USING (name)),
seen AS (SELECT rid, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM windows),
parts AS (SELECT rid, low AS x FROM d UNION ALL SELECT rid, unnest(string_split(low, chr(10))) FROM d
          UNION ALL SELECT rid, unnest(regexp_split_to_array(low, '{SENTENCE}')) FROM d),
units AS (SELECT DISTINCT rid, {norm} AS unit FROM parts WHERE rid IN (SELECT rid FROM laid)),
words AS (SELECT rid, unit, string_split(unit, ' ') AS w FROM units),
pairs AS (SELECT rid, unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM words WHERE len(w) > 1),
dice AS (SELECT rid, unit, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM pairs, t),
best AS (SELECT rid, max(dice) AS dice, arg_min(name, (-dice, name)) AS name FROM dice WHERE dice >= {least} GROUP BY rid, unit
         UNION ALL SELECT rid, dice, name FROM seen WHERE dice >= {least}),
docs AS (SELECT rid, count(DISTINCT name) AS n, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice FROM best GROUP BY rid)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, licence, dice FROM d LEFT JOIN docs USING (rid)"""
