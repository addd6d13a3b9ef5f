"""Licence scan by Dice coefficient over word bigrams, with DataFrame functions only.

Units of a text are compared to licence templates as sets of word bigrams, 2 |A and B| / (|A| + |B|):

* every line;
* every run of lines that read like a licence, so that a notice or a whole licence is found inside a
  longer document, wrapped at any width and behind comment marks: neighbouring lines at least half
  of whose bigrams stand in some template (a line of one word: its word), blank lines between them
  skipped;
* the text as a whole.

Text is normalised to lower-case runs of letters and digits. For a score of at least t, the smaller
set must hold t / (2 - t) of the larger one, so each template admits a range of sizes only, and
units outside every range are dropped before they are scored. The scan is one narrow stage without a
shuffle: templates are constants of the plan.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence notices, as their licences word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "proprietary": "All rights reserved.",
    # whole licences, without their copyright lines
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
}
THRESHOLD = 0.8


def bigrams(text: str) -> list[str]:
    """The sorted set of word bigrams of a text, normalised as the scan does."""
    words = re.sub(r"[^\w]+|_+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of a bigram set that can reach the threshold against a set of n, in whole numbers so that none is lost."""
    t = Fraction(str(threshold))
    return max(1, math.ceil(n * t / (2 - t))), math.floor(n * (2 - t) / t)


#: Stands for a line that no run goes through. Normalised text holds letters, digits and spaces only.
BREAK = "\x01"
#: Names of helper columns.
OWN = ("_lines", "_runs", "_m")


def _unit_words(unit: Column) -> Column:
    """The words of a unit, normalised; one empty word if it has none."""
    return F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")


def _pairs(w: Column) -> Column:
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))))
    return F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))


def known_bigrams(templates: dict[str, str]) -> tuple[list[str], list[str]]:
    """Bigrams, and single words, that stand in some template."""
    known = sorted({x for t in templates.values() for x in bigrams(t)})
    return known, sorted({w for x in known for w in x.split()})


def _stretches(runs: Column, most: int) -> Column:
    """The words of every stretch of paragraphs of a run, but for the run itself and for single lines, which are units
    already; of at most ``most`` words. Licences that stand side by side are one run, and stretches of it each."""
    parts = F.transform(runs, lambda r: F.filter(F.split(r, r"\n{2,}"), lambda x: x != ""))
    parts = F.transform(parts, lambda p: F.struct(F.transform(p, lambda x: F.split(x, "\n| ")).alias("words"), F.transform(p, lambda x: x.contains("\n")).alias("lines")))
    upto = lambda words: F.aggregate(words, F.array(F.lit(0)), lambda sums, w: F.array_append(sums, F.element_at(sums, -1) + F.size(w)))
    parts = F.transform(parts, lambda p: F.struct(p["words"].alias("words"), p["lines"].alias("lines"), upto(p["words"]).alias("upto")))

    def of_run(p: Column) -> Column:
        last = F.size(p["words"]) - 1

        def from_(i: Column) -> Column:
            wanted = lambda j: ((i > 0) | (j < last)) & ((j > i) | p["lines"][i]) & (p["upto"][j + 1] - p["upto"][i] <= most)
            return F.transform(F.filter(F.sequence(i, F.least(i + most, last)), wanted), lambda j: F.flatten(F.slice(p["words"], i + 1, j - i + 1)))

        return F.flatten(F.transform(F.sequence(F.lit(0), last), from_))

    return F.flatten(F.transform(parts, of_run))


def license_scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``license`` (template of the best match, else null), ``dice`` (its score, else null) and ``license_units`` (matching units).

    Units are lines, runs of lines that read like a licence, stretches of a run between blank lines (of at most
    twice the largest template's words), and the whole text. A unit matches if its best template scores ``threshold`` or more; equal scores go to the template
    that sorts last by name. Null and empty texts match nothing. Other columns stay as they are, but
    for those of these names and the helpers ``OWN``, which are replaced. Equal texts get equal
    values, repeated rows and null keys are rows as all others, an empty table stays empty. A row's
    text is held whole, with its words.
    """
    sets = {name: b for name, t in sorted(templates.items()) if (b := bigrams(t))}
    bounds = {name: size_bounds(len(b), threshold) for name, b in sets.items()}
    low, high = min(b[0] for b in bounds.values()), max(b[1] for b in bounds.values())
    known, words = known_bigrams(templates)

    def scored(grams: Column) -> Column:
        """The sets whose size some template admits: size, and the bigrams that any template shares."""
        sized = F.filter(grams, lambda b: F.size(b).between(low, high))
        found = F.transform(sized, lambda b: F.struct(F.size(b).alias("n"), F.filter(b, lambda x: x.isin(known)).alias("hits")))
        return F.filter(found, lambda u: F.size(u["hits"]) > 0)

    def best(u: Column) -> Column:
        scores = [
            F.when(
                u["n"].between(*bounds[name]),
                F.struct((F.lit(2.0) * F.size(F.array_intersect(u["hits"], F.array(*map(F.lit, b)))) / (u["n"] + len(b))).alias("dice"), F.lit(name).alias("template")),
            )
            for name, b in sets.items()
        ]
        return F.array_max(F.filter(F.array(*scores), lambda s: s.isNotNull()))

    def marked(line: Column) -> Column:
        """A line that a run goes through, as its words; any other as a break."""
        w, grams = line["words"], F.size(line["grams"])
        like = F.when(F.size(w) == 1, w[0].isin([*words, ""])).otherwise(2 * F.size(F.filter(line["grams"], lambda x: x.isin(known))) >= grams)
        return F.when(like, F.array_join(w, " ")).otherwise(BREAK)

    lines = F.transform(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _unit_words), lambda w: F.struct(w.alias("words"), _pairs(w).alias("grams")))
    found = docs.drop("license", "dice", "license_units", *OWN).withColumn("_lines", lines)
    found = found.withColumn("_runs", F.array_join(F.transform("_lines", marked), "\n"))
    # runs of two lines and more: one line is a unit already
    runs = F.transform(F.split("_runs", BREAK), lambda r: F.regexp_replace(r, r"^\n+|\n+$", ""))
    runs = F.filter(runs, lambda r: r.contains("\n"))
    stretches = _stretches(runs, 2 * (high + 1))
    runs = F.transform(runs, lambda r: F.split(r, r"\n+| "))
    # a set of bigrams is at most one smaller than that of the words, so a long text needs no bigrams
    whole = F.filter(F.flatten(F.transform("_lines", lambda x: x["words"])), lambda x: x != "")
    whole = F.when((F.size("_lines") > 1) & F.col("_runs").contains(BREAK), F.filter(F.array(whole), lambda w: F.size(F.array_distinct(w)) <= high + 1)).otherwise(F.array().cast("array<array<string>>"))
    # a unit of w words has at most w - 1 bigrams, so fewer than low + 1 words can't match
    longer = F.transform(F.filter(F.concat(runs, stretches, whole), lambda w: F.size(w) > low), _pairs)
    units = scored(F.concat(F.transform("_lines", lambda x: x["grams"]), longer))
    found = found.withColumn("_m", F.filter(F.transform(units, best), lambda s: s.isNotNull() & (s["dice"] >= threshold)))
    top = F.array_max(F.col("_m"))
    return found.withColumns({"license": top["template"], "dice": top["dice"], "license_units": F.size("_m").cast("long")}).drop(*OWN)
