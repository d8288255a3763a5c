"""License scan: units and windows of a text against license templates by Dice over word bigrams.

Texts are normalised (lower case, runs of other characters than letters and digits
become one space) and cut into units: lines, and paragraphs of several lines.  Two
sets of bigrams of sizes a and b have a Dice coefficient of at most
``2 min(a, b) / (a + b)``, so a unit is compared only with templates whose size
admits the threshold.  Most texts are compared with none: to reach the threshold, a
text must share so many of a template's bigrams that it has one of the words that
:func:`anchors` picks from it.

A notice beside other words, or one that runs over paragraphs, is found by windows
over the whole text without its line breaks: where the first ``OPENING`` words of
templates stand, as many words as each of these has are compared with it.  A notice
inside a longer line whose first words are changed isn't found.

Of a unit, and of a window's place, only the best template counts, so a notice of one
license isn't reported as a similar one too.  Everything is column expressions inside
a row: nothing is exploded, joined or shuffled.

Defined cases: a null or empty text has no license and a score of 0; of equal scores
the first template in alphabetical order counts; repeated rows get equal results
each; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 80  # percent
OPENING = 3  # words

_NO_WARRANTY = "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'

#: Fixed values, public texts that have to be verbatim: name of the template, identifier of the license, notice or license text.
TEMPLATES: list[tuple[str, str, str]] = [
    ("all-rights", "LicenseRef-Proprietary", "All rights reserved."),
    ("apache-2-full", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("apache-2-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-2-conditions", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-line", "BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3-full", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3-line", "GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-full", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "Licensed under the MIT License."),
    ("mpl-2", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
    ("agpl-3-notice", "AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-2-text", "BSD-2-Clause", f"{_BSD_2} {_DISCLAIMER}{_NO_WARRANTY}"),
    ("bsd-3-conditions", "BSD-3-Clause", f"{_BSD_2} {_BSD_3}"),
    ("bsd-3-text", "BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_DISCLAIMER}{_NO_WARRANTY}"),
    ("gpl-2-notice", "GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1-notice", "LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3-notice", "LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-text", "MIT", _MIT),
]


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def prepared(templates: list[tuple[str, str, str]]) -> list[tuple[str, str, list[str], int, str]]:
    """Name, license, distinct bigrams, number of words and opening of each template (of two words at least)."""
    out = [(name, license_, list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:]))), len(w), " ".join(w[:OPENING])) for name, license_, text in templates if len(w := words_of(text)) > 1]
    if any(n < OPENING for *_, n, _ in out):
        raise ValueError(f"templates have at least {OPENING} words")
    return out


def bounds(sizes: list[int], threshold: int) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that some template admits: 2 min(a, b) >= threshold (a + b)."""
    return min(-(-n * threshold // (200 - threshold)) for n in sizes), max(n * (200 - threshold) // threshold for n in sizes)


def anchors(known: list[list[str]], threshold: int) -> list[str]:
    """Words such that a text without any of them can't share enough bigrams with any template.

    Words of many templates go first, then long ones, which are rare. For short words, which aren't, their bigrams.
    """
    of = [[set(g.split()) for g in grams] for grams in known]
    common = Counter(w for grams in of for w in set().union(*grams))
    out: dict[str, None] = {}
    for grams in of:
        may_miss = len(grams) - -(-len(grams) * threshold // (200 - threshold))
        left = [g for g in grams if not any(p in w for p in out for w in g)]
        for word in sorted(set().union(*grams), key=lambda w: (len(w) < 5, -common[w], -len(w), w)):
            if len(grams) - len(left) > may_miss:
                break
            if hit := [g for g in left if word in g]:
                out |= dict.fromkeys([word] if len(word) > 4 else [" ".join(b) for b in (x.split() for x in known[of.index(grams)]) if word in b])
                left = [g for g in left if g not in hit]
    return sorted(p for p in out if not any(q in p for q in out if q != p))


def _let(value: Column, body) -> Column:
    """The body with the value bound to a name, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: n_units, the best template, its license and score, and all licenses found."""
    known = prepared(templates)
    least, most = bounds([len(b) for _, _, b, _, _ in known], threshold)
    openings = sorted({o for *_, o in known})
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("license"), F.lit(len(b)).alias("size"), F.lit(k).alias("words"), F.lit(o).alias("opening"), F.array(*map(F.lit, b)).alias("grams")) for n, i, b, k, o in known))
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.split("plain", "\n")
    paragraphs = F.transform(F.filter(F.split("plain", "\n *\n"), lambda p: F.instr(p, "\n") > 0), lambda p: F.regexp_replace(p, "\n", " "))
    # distinct bigrams of at most `most` come from at least `least + 1` words; repeats may add any number
    units = F.filter(F.array_distinct(F.transform(F.concat(lines, paragraphs), lambda u: F.trim(F.regexp_replace(u, " +", " ")))), lambda u: F.length(u) > 2 * least)

    def grams(words: Column) -> Column:
        return _let(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))

    sized = F.filter(F.transform(F.col("units"), lambda u: grams(F.split(u, " "))), lambda g: F.size(g).between(least, most))

    def score(gram: Column, t: Column) -> Column:
        return F.struct(t["name"].alias("name"), t["license"].alias("license"), F.size(F.array_intersect(gram, t["grams"])).alias("both"), (F.size(gram) + t["size"]).alias("sum"))

    def best_of(scored: Column) -> Column:
        """The best of the scores that reach the threshold: an array of one, or of none."""
        good = F.filter(scored, lambda s: 200 * s["both"] >= threshold * s["sum"])
        return F.slice(F.array_sort(F.transform(good, lambda s: F.struct((-2.0 * s["both"] / s["sum"]).alias("minus"), s["name"].alias("name"), s["license"].alias("license")))), 1, 1)

    def of_unit(gram: Column) -> Column:
        near = F.filter(table, lambda t: 200 * F.least(F.size(gram), t["size"]) >= threshold * (F.size(gram) + t["size"]))
        return best_of(F.transform(near, lambda t: score(gram, t)))

    def of_windows(words: Column) -> Column:
        opening = lambda i: F.array_join(F.slice(words, i, OPENING), " ")
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - OPENING + 1, F.lit(1))), lambda i: F.array_contains(F.array(*map(F.lit, openings)), opening(i)))
        at = lambda i: F.transform(F.filter(table, lambda t: t["opening"] == opening(i)), lambda t: _let(grams(F.slice(words, i, t["words"])), lambda g: score(g, t)))
        return F.flatten(F.transform(places, lambda i: best_of(at(i))))

    flat = F.trim(F.regexp_replace("plain", "[ \n]+", " "))
    some = F.lit(False)
    for o in openings:  # most texts have none of them
        some = some | F.contains("flat", F.lit(o))
    windows = F.when(some, _let(F.split("flat", " "), of_windows))
    anchored = F.lit(False)
    for w in anchors([b for _, _, b, _, _ in known], threshold):
        anchored = anchored | F.contains("flat", F.lit(w))
    found = F.flatten(F.transform(sized, of_unit))
    nothing = F.filter(F.array(F.struct(F.lit(0.0).alias("minus"), F.lit("").alias("name"), F.lit("").alias("license"))), lambda x: x["minus"] < 0)
    ranked = F.array_sort(F.when(anchored & some, F.concat(found, windows)).when(anchored, found).otherwise(nothing))
    plains = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), plain.alias("plain"))
    out = plains.select("doc_id", units.alias("units"), flat.alias("flat")).select("doc_id", F.size("units").alias("n_units"), ranked.alias("ranked"))
    best = F.get("ranked", F.lit(0))
    return out.select(
        "doc_id",
        F.col("n_units").cast("long").alias("n_units"),
        best["name"].alias("template"),
        best["license"].alias("license"),
        F.round(F.coalesce(-best["minus"], F.lit(0.0)), 6).alias("score"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("ranked", lambda r: r["license"]))), ",").alias("licenses"),
    )


def scan_sql(templates: list[tuple[str, str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> str:
    """The same in DuckDB's SQL, over ``documents``."""
    known = prepared(templates)
    least, most = bounds([len(b) for _, _, b, _, _ in known], threshold)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(i)}, {k}, {quote(o)}, [{', '.join(map(quote, b))}])" for n, i, b, k, o in known)
    openings = sorted({o for *_, o in known})
    return f"""
WITH templates(name, license, words, opening, grams) AS (VALUES {rows}),
normal AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS plain FROM documents),
cut AS (SELECT r, doc_id, list_concat(string_split(plain, chr(10)), list_transform(list_filter(string_split_regex(plain, '\\n *\\n'), lambda p: contains(p, chr(10))), lambda p: replace(p, chr(10), ' '))) AS units FROM normal),
tidy AS (SELECT r, doc_id, list_filter(list_distinct(list_transform(units, lambda u: trim(regexp_replace(u, ' +', ' ', 'g')))), lambda u: length(u) > {2 * least}) AS units FROM cut),
unit AS (SELECT r, u AS place, string_split(u, ' ') AS w FROM (SELECT r, unnest(units) AS u FROM tidy)),
gram AS (SELECT r, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM unit),
flat AS (SELECT r, string_split(trim(regexp_replace(plain, '[ \\n]+', ' ', 'g')), ' ') AS w FROM normal),
opened AS (SELECT r, w, unnest(list_filter(range(1, len(w) - {OPENING - 2}), lambda i: list_contains([{', '.join(map(quote, openings))}], array_to_string(w[i:i + {OPENING - 1}], ' ')))) AS i FROM flat),
windows AS (SELECT r, '@' || i AS place, name, license, grams, w[i:i + words - 1] AS x FROM opened JOIN templates ON array_to_string(w[i:i + {OPENING - 1}], ' ') = opening),
pairs AS (
  SELECT r, place, name, license, g, grams FROM gram JOIN templates ON len(g) BETWEEN {least} AND {most} AND 200 * least(len(g), len(grams)) >= {threshold} * (len(g) + len(grams))
  UNION ALL SELECT r, place, name, license, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])), grams FROM windows),
scored AS (SELECT r, place, name, license, len(list_intersect(g, grams)) AS n, len(g) + len(grams) AS total FROM pairs),
hit AS (SELECT r, name, license, 2.0 * n / total AS dice FROM scored WHERE 200 * n >= {threshold} * total QUALIFY row_number() OVER (PARTITION BY r, place ORDER BY 2.0 * n / total DESC, name) = 1),
best AS (SELECT r, arg_min(name, (-dice, name)) AS template, arg_min(license, (-dice, name)) AS license, max(dice) AS score, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hit GROUP BY r)
SELECT t.doc_id, CAST(len(t.units) AS BIGINT) AS n_units, template, license, round(coalesce(CAST(score AS DOUBLE), 0.0), 6) AS score, coalesce(licenses, '') AS licenses
FROM tidy t LEFT JOIN best b ON t.r = b.r
"""
