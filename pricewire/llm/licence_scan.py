"""License scans: Dice coefficient over word bigrams against licence templates (DataFrame functions only).

A unit is a line, a paragraph (lines up to a blank one) or the whole document.  Text is normalised (copyright lines cut, A-Z
lower-cased, runs of anything but letters and digits become one space) and its distinct word bigrams are compared to
each template's: dice = 2 |common| / (|unit| + |template|).  For dice >= t the unit's size must lie between t/(2-t)
and (2-t)/t times the template's; other templates are pruned before any bigrams are compared.  Such a unit also
holds over t/(2-t) of the template's bigrams, so it must hold a word of any set that covers the rest:
documents without such an anchor word are settled by substring searches.  Everything happens inside the row; nothing
shuffles.

Defined cases: null or empty text has no licence; of equal scores the template first in the list wins; repeated rows are
scanned separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewire.llm.url_aliases import AZ

MIN_DICE = Fraction(4, 5)
# Licence notices and texts.
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
     "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
     "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
     "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
     "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
     "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
     "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
     "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
     "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
     "THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
     "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
     "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
     "for more details. You should have received a copy of the GNU General Public License along with this program. If not, "
     "see <https://www.gnu.org/licenses/>."),
)
COPYRIGHT = r"(?im)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(text, COPYRIGHT, " "), *AZ), OTHER, " "))


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    w = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def size_bounds(n: int, t: Fraction = MIN_DICE) -> tuple[int, int]:
    """Sizes of a unit that can reach dice t with a template of n bigrams."""
    return ceil(t * n / (2 - t)), floor((2 - t) * n / t)


def anchors(templates=TEMPLATES, t: Fraction = MIN_DICE) -> list[str]:
    """Words of which every unit that reaches t with some template has one: for each template, its longest words
    until the bigrams without them are fewer than the common bigrams that t asks for."""
    chosen: set[str] = set()
    for _, text in templates:
        grams = template_bigrams(text)
        need = size_bounds(len(grams), t)[0]
        for word in sorted(set(template_words(text)), key=lambda w: (-len(w), w)):
            if sum(not chosen & set(g.split()) for g in grams) < need:
                break
            chosen.add(word)
    return sorted(chosen)


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def licence_scan(docs: DataFrame, templates=TEMPLATES, min_dice: Fraction = MIN_DICE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, licence, dice, n_hits, hits array<struct<licence, unit, unit_no, dice>>.

    ``hits`` has every unit that reaches ``min_dice``, with its best template; ``licence`` and ``dice`` are those
    of the best hit (null without one).
    """
    rows = []
    for k, (name, text) in enumerate(templates):
        grams = template_bigrams(text)
        low, high = size_bounds(len(grams), min_dice)
        rows.append(F.struct(F.lit(-k).alias("rank"), F.lit(name).alias("name"), F.lit(len(grams)).alias("n"),
                             F.lit(low).alias("low"), F.lit(high).alias("high"),
                             F.array(*[F.lit(g) for g in grams]).alias("grams")))
    table = F.array(*rows)
    least = min(size_bounds(len(template_bigrams(x)), min_dice)[0] for _, x in templates)

    def scored(u: Column) -> Column:
        def one(t: Column) -> Column:
            common = F.size(F.array_intersect(u["grams"], t["grams"]))
            return F.struct((2.0 * common / (F.size(u["grams"]) + t["n"])).alias("dice"), t["rank"].alias("rank"),
                            t["name"].alias("name"))
        fit = F.filter(table, lambda t: F.size(u["grams"]).between(t["low"], t["high"]))
        best = F.array_max(F.transform(fit, one))
        return F.struct(best["dice"].alias("dice"), best["rank"].alias("rank"), (-u["no"]).alias("before"),
                        best["name"].alias("licence"), u["unit"].alias("unit"), u["no"].alias("unit_no"))

    def units(parts: Column, kind: str) -> Column:
        worded = F.transform(parts, lambda x: F.split(normalised(x), " "))  # once per unit, then used by name
        made = F.transform(worded, lambda w, i: F.struct(F.lit(kind).alias("unit"), i.alias("no"),
                                                         _bigrams(w).alias("grams")))
        return F.filter(made, lambda u: F.size(u["grams"]) >= least)

    has = F.lit(False)
    for w in anchors(templates, min_dice):
        has = has | F.contains(F.col("_lower"), F.lit(w))
    none = F.array().cast("array<string>")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("_lower", F.translate("text", *AZ))  # a column of its own, so it is made once per text
    d = d.withColumn("text", F.when(has, F.col("text"))).drop("_lower")  # null: settled, no licence
    d = d.withColumn("_lines", F.split("text", "\n")).withColumn("_paras", F.split("text", r"\n[ \t\r]*\n"))
    d = d.withColumn("_whole", F.when(F.size("_paras") > 1, F.array("text")).otherwise(none))
    d = d.withColumn("_paras", F.when(F.size("_lines") > 1, F.filter("_paras", lambda p: F.contains(p, F.lit("\n"))))
                     .otherwise(none))
    every = F.concat(units(F.col("_lines"), "line"), units(F.col("_paras"), "paragraph"), units(F.col("_whole"), "document"))
    hits = F.filter(F.transform(F.col("_units"), scored), lambda h: h["dice"] >= float(min_dice))
    d = d.withColumn("_units", F.when(F.col("text").isNotNull(), every))
    d = d.withColumn("_hits", F.coalesce(hits, F.array().cast(
        "array<struct<dice:double,rank:int,before:int,licence:string,unit:string,unit_no:int>>")))
    best = F.array_max("_hits")
    return d.select("doc_id", best["licence"].alias("licence"), best["dice"].alias("dice"),
                    F.size("_hits").cast("long").alias("n_hits"),
                    F.transform("_hits", lambda h: F.struct(
                        h["licence"].alias("licence"), h["unit"].alias("unit"), h["unit_no"].alias("unit_no"),
                        h["dice"].alias("dice"))).alias("hits"))
