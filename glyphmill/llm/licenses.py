"""Operator 1, license scans by sentence rules.

Text is cut into pieces at line ends and at stops, pieces are normalised, and runs of them that make up a known licence
sentence are replaced by its identifier (a hash join with a small relation, whose size is the rule table's); so neither
hard wraps, comment marks nor stops within a sentence hide it. What remains of a text is a sequence of identifiers and
gaps, which is held against ordered rules; the first rule that fits names the licence of that place. Only DataFrame
functions; only recognised sentences are shuffled, never texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small

#: Known licence sentences, normalised by normalise(), and their identifiers.
SENTENCES = {
    # public licence notices and their customary short forms
    "licensed under the apache license version 2 0": "apache2.licensed",
    "released under the apache license version 2 0": "apache2.licensed",
    "this project is licensed under the apache license version 2 0": "apache2.licensed",
    "spdx license identifier apache 2 0": "apache2.spdx",
    "you may not use this file except in compliance with the license": "apache2.compliance",
    "you may obtain a copy of the license at": "apache2.copy",
    "released under the mit license": "mit.licensed",
    "licensed under the mit license": "mit.licensed",
    "this project is licensed under the mit license": "mit.licensed",
    "spdx license identifier mit": "mit.spdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "the software is provided as is without warranty of any kind express or implied": "any.warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.endorse",
    "spdx license identifier bsd 2 clause": "bsd2.spdx",
    "spdx license identifier bsd 3 clause": "bsd3.spdx",
    "this work is licensed under the gnu general public license version 3": "gpl3.licensed",
    "licensed under the gnu general public license version 3": "gpl3.licensed",
    "this work is licensed under the gnu general public license version 2": "gpl2.licensed",
    "licensed under the gnu general public license version 2": "gpl2.licensed",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3.grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2.grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl.warranty",
    "spdx license identifier gpl 3 0 only": "gpl3.spdx",
    "spdx license identifier gpl 3 0 or later": "gpl3.spdx",
    "spdx license identifier gpl 2 0 only": "gpl2.spdx",
    "licensed under the gnu lesser general public license version 3": "lgpl3.licensed",
    "licensed under the gnu affero general public license version 3": "agpl3.licensed",
    "licensed under the mozilla public license version 2 0": "mpl2.licensed",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2.licensed",
    "licensed under cc by 4 0": "ccby4.licensed",
    "licensed under cc by sa 4 0": "ccbysa4.licensed",
    "licensed under cc by nc 4 0": "ccbync4.licensed",
    "licensed under cc by nd 4 0": "ccbynd4.licensed",
    "licensed under cc by nc sa 4 0": "ccbyncsa4.licensed",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4.licensed",
    "this is free and unencumbered software released into the public domain": "unlicense.grant",
    "all rights reserved": "any.reserved",
}

_GPL = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License "
_FSF = "as published by the Free Software Foundation"
_GPL_LATER = _GPL + _FSF + "{3} either version {4} of the License, or (at your option) any later version"
_AS_IS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
_SEE = ("", " - see the LICENSE file for details", " - see the [LICENSE](LICENSE) file for details", " - see the [LICENSE.md](LICENSE.md) file for details")

#: Sentences of the standard notices and their usual variants, as they are printed, by identifier.
NOTICES = {
    "apache2.licensed": [
        'Licensed under the Apache License, Version 2.0 (the "License")',
        "Licensed under the Apache License 2.0", "Released under the Apache License 2.0", "Licensed under the Apache 2.0 license",
        *[f"This project is licensed under the Apache License{v}{x}" for v in (", Version 2.0", " 2.0") for x in _SEE],
    ],
    "apache2.compliance": ["you may not use this work except in compliance with the License", "you may not use these files except in compliance with the License"],
    "apache2.copy": [f"You may obtain a copy of the License at {x}://www.apache.org/licenses/LICENSE-2.0{y}" for x in ("http", "https") for y in ("", f" {_AS_IS}")],  # no stop behind the address: unwrapped, the next sentence goes on
    "apache2.asis": [_AS_IS],
    "apache2.see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit.licensed": [f"This project is licensed under the MIT License{x}" for x in _SEE],
    "mit.grant": [
        f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so{x}'
        for x in (", subject to the following conditions", "")
    ],
    "mit.notice": ["The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "any.warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "any.liability": [
        f"IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
        for who in ("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
    ],
    "bsd.warranty": [
        f'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT {who} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'
        for who in ("HOLDERS AND CONTRIBUTORS", "HOLDER AND CONTRIBUTORS", "OWNER AND CONTRIBUTORS")
    ],
    "bsd.liability": [
        f"IN NO EVENT SHALL THE COPYRIGHT {who} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
        for who in ("HOLDER", "HOLDERS", "OWNER")
    ],
    **{
        f"gpl{v}.grant": [_GPL_LATER.format(what, ";", "", then, v) for what in ("program", "file", "software") for then in (",", ";")]
        + [_GPL.format("program", ";", "") + x for x in (f"version {v} as published by the Free Software Foundation", f"as published by the Free Software Foundation; version {v} of the License", f"as published by the Free Software Foundation, version {v}")]
        for v in (2, 3)
    },
    **{f"gpl{v}.licensed": [f"This project is licensed under the {name}{x}" for name in (f"GNU General Public License, version {v}", f"GNU General Public License v{v}.0", f"GNU GPL v{v}") for x in _SEE] for v in (2, 3)},
    "lgpl3.licensed": [_GPL_LATER.format(what, ";", "Lesser ", ",", 3) for what in ("program", "library", "file", "software")],
    "agpl3.licensed": [_GPL_LATER.format(what, ";", "Affero ", ",", 3) for what in ("program", "file", "software")],
    "gpl.warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl.details": [f"See the GNU {x}General Public License for more details" for x in ("", "Lesser ", "Affero ")],
    "gpl.copy": [
        f"You should have received a copy of the GNU {x}General Public License along with this program{y}"
        for x in ("", "Lesser ", "Affero ")
        for y in ("", "; if not, see http://www.gnu.org/licenses/", ". If not, see <https://www.gnu.org/licenses/>")
    ],
    "mpl2.copy": [f"If a copy of the MPL was not distributed with this file, You can obtain one at {x}://mozilla.org/MPL/2.0/" for x in ("http", "https")],
}

#: Ordered rules (licence, pattern) on the sequence of identifiers, each followed by a blank; a sentence that is no
#: licence sentence breaks the sequence. Longer identifiers stand before those that they end with (AGPL before GPL).
RULES = (
    ("BSD-3-Clause", r"(any\.reserved )?bsd\.grant bsd\.source bsd\.binary bsd\.endorse |bsd3\.spdx "),
    ("BSD-2-Clause", r"(any\.reserved )?bsd\.grant bsd\.source bsd\.binary |bsd2\.spdx "),
    ("Apache-2.0", r"apache2\.(licensed|spdx) (apache2\.compliance )?(apache2\.copy )?"),
    ("MIT", r"mit\.(licensed|spdx) |mit\.grant (mit\.notice )?(any\.warranty )?"),
    ("AGPL-3.0", r"agpl3\.licensed "),
    ("LGPL-3.0", r"lgpl3\.licensed "),
    ("GPL-3.0", r"gpl3\.(licensed|spdx|grant) (gpl\.warranty )?"),
    ("GPL-2.0", r"gpl2\.(licensed|spdx|grant) (gpl\.warranty )?"),
    ("MPL-2.0", r"mpl2\.licensed "),
    ("CC-BY-NC-SA-4.0", r"ccbyncsa4\.licensed "),
    ("CC-BY-NC-4.0", r"ccbync4\.licensed "),
    ("CC-BY-ND-4.0", r"ccbynd4\.licensed "),
    ("CC-BY-SA-4.0", r"ccbysa4\.licensed "),
    ("CC-BY-4.0", r"ccby4\.licensed "),
    ("Unlicense", r"unlicense\.grant "),
    ("all-rights-reserved", r"any\.reserved "),
)

#: A piece ends at a line end, or at . ! ? ; : before white space. Version numbers ("2.0") stay whole. Comment marks that
#: are words and list letters go with the line end; others hold no letters.
END = r"(?:^|[\n\r]+)[^A-Za-z0-9\n\r]*(?:(?:REM|dnl)[ \t]+|\(?[a-h][.)][ \t]+)?|[.!?;:]+[\"')\]]*(?=[ \t]|$)"
#: Known sentences whose words are looked for in a text before it is cut.
FEW = 1000


def pieces(text: Column) -> Column:
    """Array of the normalised pieces of a text; pieces without letters stand behind a tab at the end of the last one."""
    cut = normalise(F.regexp_replace(F.coalesce(text, F.lit("")), END, "\n"), "\n")
    held = F.regexp_replace(F.regexp_replace(cut, r"\n(?=[0-9 ]*+(?:\n|\z))", "\t"), r" *\t[ \t]*", "\t")
    return F.filter(F.transform(F.split(held, "\n", -1), lambda s: F.regexp_replace(s, r"^[ \t]+|[ \t]+$", "")), lambda s: s.rlike("[a-z]"))


def normalise(text: Column, keep: str = "") -> Column:
    """ASCII letters and digits, lower-cased, other characters (but those to keep) one blank, outer blanks gone."""
    return F.trim(F.lower(F.regexp_replace(text, f"[^A-Za-z0-9{keep}]+", " ")))


def scan(docs: DataFrame, known: DataFrame, rules: list[tuple[str, str]] = list(RULES)) -> DataFrame:  # noqa: B006
    """(doc_id, licenses, sentences): of each row the licences found, in the order of the text, and licence sentences.

    known: (sentence, id). licenses: array of names, repeats in one text once, at the first; empty if none is found.
    sentences: how many were recognised. A sentence begins and ends where a piece does and may run over many; of those
    that overlap the first counts, and the longest of them. Runs of recognised sentences without another between them
    are matched on their own, from left to right; at each place the first rule in order that fits there. Null and empty
    texts have none. Rows with equal doc_id and text are alike and each stay; a null doc_id is a row like others; an
    empty table gives an empty result; other columns don't matter.
    """
    n_words = F.size(F.split("sentence", " "))
    least, longest, most, n_known = known.agg(F.coalesce(F.min(F.length("sentence")), F.lit(0)), F.coalesce(F.max(F.length("sentence")), F.lit(0)), F.coalesce(F.max(n_words), F.lit(1)), F.count("*")).first()
    key = ["doc_id", "h"]
    table = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    # A text without any known sentence's longest word can't hold one, nor can a piece begin one that has other first
    # words; both are cheaper than cutting and joining. Too many known sentences: without these tests.
    words = [r[0].split(" ") for r in known.select("sentence").collect()] if n_known <= FEW else None
    likely, starts = table, lambda s: F.lit(True)
    if words is not None:
        rare = sorted({max(w, key=len) for w in words}, key=len)
        rare = [w for i, w in enumerate(rare) if not any(x in w for x in rare[:i])]
        low = F.lower("text")
        likely = table.filter(F.greatest(F.lit(False), F.lit(False), *[F.contains(low, F.lit(w)) for w in rare]))
        firsts = sorted({x for w in words for x in (w[0], " ".join(w[:2]))})
        starts = lambda s: F.substring_index(F.substring_index(s, "\t", 1), " ", 2).isin(firsts)
    cut = likely.select(*key, pieces(F.col("text")).alias("p"))
    at = F.filter(F.transform("p", lambda s, i: F.struct(i.alias("at"), s.alias("s"))), lambda x: starts(x["s"]))
    begun = cut.select(*key, F.explode(F.transform(at, lambda x: F.struct(x["at"], F.slice("p", x["at"] + 1, F.lit(most)).alias("w")))).alias("x")).select(*key, "x.at", "x.w")
    run = begun.select(*key, "at", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n"))
    last, before = F.element_at("w", F.col("n")), F.slice("w", F.lit(1), F.col("n") - 1)
    ends = F.array_distinct(F.array(F.substring_index(last, "\t", 1), F.substring_index(last, "\t", 2)))
    rows = run.select(*key, "at", "n", F.explode(F.transform(ends, lambda e: F.translate(F.array_join(F.concat(before, F.array(e)), " "), "\t", " "))).alias("sentence"))
    # The name of the owner in BSD's last condition is free.
    rows = rows.withColumn("sentence", F.regexp_replace("sentence", "^neither the names? of .{1,120}? nor the names of (?:its|their|any|other) contributors may", "neither the name of the copyright holder nor the names of its contributors may"))
    hits = rows.filter(F.length("sentence").between(least, longest)).join(small(known, n_known), "sentence").select(*key, "at", "n", F.length("sentence").alias("l"), "id").distinct()
    by_doc = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("n"), (-F.col("l")).alias("l"), "id"))).alias("all"))
    empty = F.filter("all", lambda x: F.lit(False))
    chosen = F.aggregate("all", F.struct(F.lit(0).alias("end"), empty.alias("r")), lambda s, x: F.when(x["at"] >= s["end"], F.struct((x["at"] - x["n"]).alias("end"), F.concat(s["r"], F.array(x)).alias("r"))).otherwise(s))
    by_doc = by_doc.select(*key, chosen["r"].alias("r")).withColumn("sentences", F.size("r").cast("long"))
    # Identifiers in one string; a bar where the next one isn't the very next sentence.
    joined = F.element_at(
        F.transform(F.array("r"), lambda r: F.array_join(F.transform(r, lambda x, i: F.concat(F.when((i > 0) & (F.get(r, i - 1)["at"] - F.get(r, i - 1)["n"] < x["at"]), F.lit("| ")).otherwise(F.lit("")), x["id"], F.lit(" "))), "")), 1
    )
    named = joined
    for name, pattern in rules:  # what the first rule matches becomes its name, in which later rules can't match
        named = F.regexp_replace(named, pattern, f"<{name}> ")
    found = F.array_distinct(F.regexp_extract_all(named, F.lit("<([^>]+)>"), 1))
    marked = by_doc.select(*[F.col(c).alias(f"_{c}") for c in key], found.alias("licenses"), "sentences")
    narrow = table.select(*key)
    out = narrow.join(marked, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("sentences", F.lit(0).cast("long")).alias("sentences"))


def known_sentences(spark: SparkSession) -> DataFrame:
    printed = {re.sub("[^A-Za-z0-9]+", " ", s).strip().lower(): i for i, group in NOTICES.items() for s in group}
    return spark.createDataFrame(list((SENTENCES | printed).items()), "sentence string, id string")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_sentences(spark))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "sentences")


def _sql() -> str:
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    named = "ids"
    for name, pattern in RULES:
        named = f"regexp_replace({named}, '{pattern}', '<{name}> ', 'g')"
    return rf"""
WITH known(sentence, id) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
lines AS (SELECT k, generate_subscripts(a, 1) AS nth, unnest(a) AS s FROM (
  SELECT k, list_filter(string_split_regex(regexp_replace(replace(coalesce(text, ''), 'Identifier:', 'Identifier '), '[.!?;:]+([ \t]|$)', chr(10) || '\1', 'g'), '[\n\r]+'), lambda x: regexp_matches(x, '[A-Za-z]')) AS a FROM docs)),
hits AS (SELECT k, nth, id FROM (SELECT k, nth, trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))) AS sentence FROM lines) JOIN known USING (sentence)),
breaks AS (SELECT k, nth, CASE WHEN nth > 1 + lag(nth) OVER (PARTITION BY k ORDER BY nth) THEN '| ' ELSE '' END || id || ' ' AS id FROM hits),
joined AS (SELECT k, string_agg(id, '' ORDER BY nth) AS ids, count(*) AS n FROM breaks GROUP BY k),
found AS (SELECT k, n, regexp_extract_all({named}, '<([^>]+)>', 1) AS all_names FROM joined),
firsts AS (SELECT k, n, list_filter(all_names, lambda x, i: list_position(all_names, x) = i) AS names FROM found)
SELECT doc_id, coalesce(array_to_string(names, ','), '') AS licenses, coalesce(n, 0) AS sentences FROM docs LEFT JOIN firsts USING (k)
"""


QUERIES = {"op1_license_scans": op1_license_scans}
SQL = {"op1_license_scans": _sql()}
