"""License scans: phrases, and an exact containment join of text blocks with templates.

DataFrame functions only, without a shuffle of texts. Templates are sets of
lower-cased words. A template whose text has L words is held against every
block of ceil(L / threshold) consecutive words, wherever lines end: it is found
in a block B if |T and B| >= need, where need = ceil(threshold |T|). So as many
foreign words may stand in between as words of the template may be missing.

The templates' words are ordered by how many documents of the corpus have
them, rarest first (a count over all documents; its size is that of the
templates' vocabulary). In that order, a document that holds ``need`` words of T
must share a word with T's first |T| - need + 1 words (prefix filter), must
hold ``need`` words of the vocabulary at all (length filter), and after the
first shared word both must have words enough left (positional filter). A
document without any prefix word is done after one test. What passes is
verified over all blocks in one sweep: an occurrence of a word counts in the
blocks that begin after the word's last occurrence and reach to this one, and
the most occurrences that count together are the best block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Phrases and their labels. Fixed by the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Labels and texts of license statements to look for: short notices, then the published texts. Fixed values.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("reserved", "All rights reserved"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters beyond ASCII whose usual lower case is or has an ASCII letter.
_TO_ASCII = "[İK]"


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased; other letters may be lower-cased too, which changes no word's extent."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(_TO_ASCII), F.translate(text, upper, lower)).otherwise(F.lower(text))


def license_words(lower: Column) -> Column:
    return F.array_remove(F.split(lower, NO_WORD), "")


def _strings(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def word_list(text: str) -> list[str]:
    """The words of a template in order, in plain Python (templates are ASCII)."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def needed(words: list[str], threshold: float) -> tuple[list[str], int, int]:
    """A template's word set, how many of them a block must hold, and how many words a block has."""
    distinct = sorted(set(words))
    return distinct, max(1, math.ceil(threshold * len(distinct) - 1e-9)), math.ceil(len(words) / threshold - 1e-9)


def frequency_order(documents: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' vocabulary by document frequency over the whole corpus, rarest first."""
    vocabulary = sorted({w for _, t in templates for w in word_list(t)})
    present = documents.select(F.explode(F.array_intersect(_strings(vocabulary), license_words(lowered(F.col("text"))))).alias("word"))
    counts = {r["word"]: r["n"] for r in present.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _phrase_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase, words counted from 0."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, word in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == word)
        return same

    return F.filter(starts, here)


def most_together(words: Column, template: list[str], length: int) -> Column:
    """The most different words of ``template`` that any ``length`` consecutive words hold."""
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(template))
    placed = F.sort_array(F.transform(at, lambda i: F.struct(F.get(words, i).alias("w"), i.cast("long").alias("p"))))

    def events(p: Column) -> Column:
        # Twice the first block in which an occurrence counts, plus one; twice the first in which it does not any more.
        last = lambda e, k: F.when(F.get(p, k - 1)["w"] == e["w"], F.get(p, k - 1)["p"] + 1)
        opens = F.transform(p, lambda e, k: F.greatest(e["p"] - (length - 1), last(e, k)) * 2 + 1)
        return F.sort_array(F.concat(opens, F.transform(p, lambda e: (e["p"] + 1) * 2)))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"] + F.when(x.bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(let(placed, events), start, step)["best"]


def scan_licenses(documents: DataFrame, *, threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    score is the greatest containment of a template found, 1 for a phrase, else
    0. Blocks cross the ends of lines; a text shorter than a block is one block.
    Null counts as the empty text (no words, no labels); texts of any length are
    scanned whole; of several equally good blocks any gives the same result;
    repeated rows stay; an empty table gives an empty result; other columns are
    ignored.
    """
    order = frequency_order(documents.select("text"), templates)
    rank = {w: k for k, w in enumerate(order)}
    prepared = []
    for label, text in templates:
        distinct, need, length = needed(word_list(text), threshold)
        t = sorted(distinct, key=rank.__getitem__)
        prepared.append((label, t, need, length, t[: len(t) - need + 1]))
    vocabulary, prefix_words = _strings(order), _strings(sorted({w for *_, prefix in prepared for w in prefix}))

    def matches(words: Column, block: Column) -> Column:
        """Labels and containments of the templates in one document; ``block`` has its vocabulary words in global order."""
        found = []
        for label, t, need, length, prefix in prepared:
            template = _strings(t)
            head = F.slice(block, 1, F.greatest(F.lit(0), F.size(block) - (need - 1)))
            first = F.get(F.array_intersect(head, _strings(prefix)), 0)
            left = F.least(F.lit(len(t)) - F.array_position(template, first), F.size(block) - F.array_position(block, first)) + 1
            likely = F.when((F.size(block) >= need) & (left >= need), F.size(F.array_intersect(block, template)) >= need)
            best = F.when(likely, most_together(words, t, length)).otherwise(0)
            found.append(F.struct(F.lit(label).alias("label"), best.alias("n"), F.lit(need).alias("need"), F.lit(float(len(t))).alias("size")))
        enough = F.filter(F.array(*found), lambda x: x["n"] >= x["need"])
        return F.transform(enough, lambda x: F.struct(x["label"].alias("label"), (x["n"] / x["size"]).alias("containment")))

    none = F.array().cast("array<struct<label:string,containment:double>>")

    def scanned(lower: Column) -> Column:
        def by_words(words: Column) -> Column:
            places = [F.when(lower.contains(phrase.split()[-1]), _phrase_places(words, phrase)).otherwise(F.array().cast("array<int>")) for phrase, _ in PHRASES]
            base = F.array_compact(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, PHRASES))))
            found = let(F.array_intersect(vocabulary, words), lambda block: matches(words, block))
            return let(
                F.struct(F.concat(*places).alias("at"), base.alias("base"), F.when(F.arrays_overlap(words, prefix_words), found).otherwise(none).alias("found")),
                lambda x: F.struct(
                    F.size(words).cast("long").alias("n_words"),
                    F.size(x["at"]).cast("long").alias("n_base"),
                    F.array_min(x["at"]).cast("long").alias("first_word"),
                    F.array_max(x["at"]).cast("long").alias("last_word"),
                    F.array_join(F.sort_array(F.array_distinct(x["base"])), ",").alias("base_labels"),
                    F.array_join(F.sort_array(F.array_distinct(F.concat(x["base"], F.transform(x["found"], lambda m: m["label"])))), ",").alias("labels"),
                    F.when(F.size(x["base"]) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(x["found"], lambda m: F.round(m["containment"], 6))), F.lit(0.0))).alias("score"),
                ),
            )

        return let(license_words(lower), by_words)

    return documents.select("doc_id", let(lowered(F.col("text")), scanned).alias("r")).select("doc_id", "r.*")
