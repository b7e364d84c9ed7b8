"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Only DataFrame functions.

1. *Statistics*: every form of a licence's template (title, notice, header,
   grant, whole text, tag) is a document of the TF-IDF model; terms are
   lower-case words and numbers, ``idf = ln((1 + n) / (1 + df)) + 1``, a
   term that no form has weighs ``ln(1 + n) + 1``, and function words nothing.
   Tags, and forms of few terms or of many, are told from ``STRICT`` on.
2. *Scan*: a file is cut into lines and into paragraphs (what stands between
   lines without a term, so that a wrapped header is one), and each of these and
   the whole text is compared with every form by cosine of its sparse term
   weights.  A file is a licence file if its name says so, if its whole text
   is a licence's (from ``STRICT`` on), or if it opens with a licence's title (its first
   paragraph, or its first two), whatever its length.  Units are first held
   against a few trigger words.  These are chosen from the model such that a
   unit without any of them has a cosine below the threshold to every form:
   for each form the terms that are not triggers carry less than the
   threshold of its norm.  So the filter loses nothing.
3. *Inheritance*: what licence files say of their directory is aggregated to one
   row a directory; every directory that holds files is joined to it by each of
   its ancestors' paths, the nearest one that has a licence wins, and files
   without a finding of their own take it by a join on their directory.

A unit of two different terms or more says the licence of its best form.  Of a file's units those that name a
version go before those that name a family of licences only (``FAMILIES``), and
then the best score.

Templates are a fixed, small table.  The whole text is scanned.  Defined cases:
a null or empty text has no finding of its own; a null path is the root's file
with an empty name; ties of cosine (to nine digits) go to the first licence by name; of several
licence files in a directory a version goes before a family, then the highest
score wins, then the first name;
repeated rows are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut

THRESHOLD = 0.6
STRICT = 0.83
#: Forms of so many terms, those for a sentence, are told from the threshold on.
SENTENCE = range(5, 13)
TAG = "SPDX-License-Identifier: "
#: Words that weigh nothing.
PLAIN = frozenset("a all an and any are as at be but by can do for from has if in is it its may no nor not of on one only or see shall so such that the this to under was with you your".split())
#: Words that are common in prose come last as triggers.
COMMON = frozenset("action associated case code copy event file following form free including language law library list loss means name names other out particular person persons program public published purpose source special use used way whether without work works writing".split())
#: Names of licences that come in versions, which these do not tell.
FAMILIES = ("AGPL", "Apache", "GFDL", "GPL", "LGPL", "MPL")


# The words of licences, as their authors publish them.

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""
MIT_CONDITION = """The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software."""
MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
BSD_CONDITIONS = """Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
APACHE_WARRANTY = """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:"""
ECLIPSE = """This program and the accompanying materials are made available under the terms of the Eclipse Public License {v} which
is available at {at}"""
ARTISTIC = """The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright
Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package
the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable
modifications."""
GFDL_GRANT = """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free
Documentation License, Version {v} or any later version published by the Free Software Foundation"""
GNU_HEADER = """This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."""
#: Of each licence of the family: its name, its version, its work, and the month of its title.
GNU = {
    "GPL-1.0": ("General Public License", "1", "program", "February 1989"),
    "GPL-2.0": ("General Public License", "2", "program", "June 1991"),
    "GPL-3.0": ("General Public License", "3", "program", "29 June 2007"),
    "LGPL-2.0": ("Library General Public License", "2", "library", "June 1991"),
    "LGPL-2.1": ("Lesser General Public License", "2.1", "library", "February 1999"),
    "LGPL-3.0": ("Lesser General Public License", "3", "library", "29 June 2007"),
    "AGPL-3.0": ("Affero General Public License", "3", "program", "19 November 2007"),
}
#: Of each version of the documentation licence the month of its title.
GFDL = {"1.1": "March 2000", "1.2": "November 2002", "1.3": "3 November 2008"}
#: Titles that open a licence's own text, but for those of the families above and below.
TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Artistic-1.0": "The Artistic License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal",
    "ISC": "ISC License",
    "MPL-1.1": "Mozilla Public License Version 1.1",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "Zlib": "zlib License",
}
CREATIVE_COMMONS = {
    "CC-BY-4.0": "Attribution",
    "CC-BY-SA-4.0": "Attribution-ShareAlike",
    "CC-BY-ND-4.0": "Attribution-NoDerivatives",
    "CC-BY-NC-4.0": "Attribution-NonCommercial",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
    "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives",
}


def titles() -> dict[str, str]:
    """Of each licence the title that opens its own text."""
    made = dict(TITLES)
    made |= {name: f"GNU {full} Version {version}, {month}" for name, (full, version, _, month) in GNU.items()}
    made |= {f"GFDL-{version}": f"GNU Free Documentation License Version {version}, {month}" for version, month in GFDL.items()}
    return made | {name: f"Creative Commons {kind} 4.0 International Public License" for name, kind in CREATIVE_COMMONS.items()}


def templates() -> dict[str, tuple[str, ...]]:
    """Of each licence its forms: titles, notices, headers, grants, whole texts, and the tag of its name."""
    made = {
        "Apache-2.0": (
            "Licensed under the Apache License, Version 2.0.",
            APACHE_HEADER,
            APACHE_WARRANTY,
            f"{APACHE_HEADER} {APACHE_WARRANTY}",
        ),
        "BSD-2-Clause": (f"{BSD_GRANT} {BSD_CONDITIONS} {BSD_WARRANTY}",),
        "BSD-3-Clause": (
            "BSD-style license, see the LICENSE file.",
            BSD_NAME,
            f"{BSD_GRANT} {BSD_CONDITIONS} {BSD_NAME} {BSD_WARRANTY}",
        ),
        "CC0-1.0": ("All copyright waived under Creative Commons CC0 1.0 Universal.",),
        "ISC": (
            "Permission to use, copy, modify, and/or distribute this software: ISC License.",
            "Licensed under the ISC License.",
            ISC_GRANT,
            ISC_WARRANTY,
            f"{ISC_GRANT} {ISC_WARRANTY}",
        ),
        "MIT": (
            "Released under the MIT License.",
            "Licensed under the MIT License.",
            "This project is licensed under the terms of the MIT License.",
            MIT_GRANT,
            MIT_CONDITION,
            MIT_WARRANTY,
            f"{MIT_GRANT} {MIT_CONDITION} {MIT_WARRANTY}",
        ),
        "MPL-2.0": (
            "This file is subject to the terms of the Mozilla Public License, v. 2.0.",
            MPL_HEADER,
        ),
        "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1",),
        "Artistic-1.0": (ARTISTIC, "This program is free software under the terms of the Artistic License."),
        "BSL-1.0": (BOOST, "Distributed under the Boost Software License, Version 1.0."),
        "EPL-1.0": (ECLIPSE.format(v="v1.0", at="http://www.eclipse.org/legal/epl-v10.html"), "Licensed under the Eclipse Public License 1.0."),
        "EPL-2.0": (ECLIPSE.format(v="2.0", at="https://www.eclipse.org/legal/epl-2.0/"), "Licensed under the Eclipse Public License 2.0."),
        "Zlib": (ZLIB, "Licensed under the zlib License."),
        "Unlicense": (UNLICENSE,),
        "Apache-2.0 OR MIT": (f"{TAG}MIT OR Apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    }
    for name, (full, version, work, month) in GNU.items():
        short = f"{name.split('-')[0]}v{version}"
        # A bare 1 is in too much prose to look for.
        sentences = () if version == "1" else (f"Licensed under the GNU {full}, version {version}.", f"This {work} is free software under the terms of the GNU {full}, version {version}.")
        made[name] = (
            short,
            *sentences,
            GNU_HEADER.format(work=work, name=full, v=version),
        )
    for version in GFDL:
        made[f"GFDL-{version}"] = (GFDL_GRANT.format(v=version),)
    for name, kind in CREATIVE_COMMONS.items():
        made[name] = (
            f"This work is licensed under a Creative Commons {kind} 4.0 International License.",
            f"This work is licensed under CC {name[3:-4]} 4.0.",
        )
    versioned = lambda k: k in GNU or k.startswith("GFDL")
    names = lambda k: () if " " in k else (k, f"{k}-only", f"{k}-or-later")[: 3 if versioned(k) else 1]
    tagged = {k: (*v, *(f"{TAG}{t}" for t in names(k)), *([title] if (title := titles().get(k)) else [])) for k, v in made.items()}
    return tagged | {
        "AGPL": ("GNU Affero General Public License",),
        "Apache": ("The Apache Software License.", "Licensed under the Apache License."),
        "GFDL": ("GNU Free Documentation License",),
        "GPL": ("GNU General Public License",),
        "LGPL": ("GNU Lesser General Public License",),
        "MPL": ("Mozilla Public License",),
        "Proprietary": ("Copyright. All rights reserved. Unauthorized copying of this file is prohibited.",),
    }


TEMPLATES = templates()
TERM = "[a-z0-9]+(?:\\.[0-9]+)*"
#: What stands between paragraphs: a line without a term.
GAP = "\n[^a-z0-9\n]*\n[^a-z0-9]*"
LICENSE_FILE = "(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:\\..*)?$"


@dataclass(frozen=True)
class Model:
    idf: dict[str, float]
    unseen: float
    #: Of each form (licence, number), term weights of norm 1.
    vectors: dict[tuple[str, int], dict[str, float]]
    #: Of each form the cosine from which on it counts.
    limits: dict[tuple[str, int], float]
    triggers: tuple[str, ...]
    #: Forms that open a licence's own text.
    titles: frozenset[tuple[str, int]]


def model(templates: dict[str, tuple[str, ...]], threshold: float) -> Model:
    forms = {(k, i): Counter(re.findall(TERM, text.lower())) for k, v in sorted(templates.items()) for i, text in enumerate(v)}
    n = len(forms)
    df = Counter(t for c in forms.values() for t in c)
    idf = {t: 0.0 if t in PLAIN else math.log((1 + n) / (1 + x)) + 1 for t, x in sorted(df.items())}
    vectors = {}
    for k, c in forms.items():
        norm = math.sqrt(sum((x * idf[t]) ** 2 for t, x in c.items()))
        vectors[k] = {t: x * idf[t] / norm for t, x in sorted(c.items()) if idf[t]}
    loose = {k for k, v in vectors.items() if len(v) in SENTENCE and not templates[k[0]][k[1]].startswith(TAG)}
    limits = {k: threshold if k in loose else max(threshold, STRICT) for k in vectors}
    # Take the term that lowers the open forms' rest the most; words that prose has, and short ones, last.
    triggers: list[str] = []
    rest = {k: 1.0 for k in vectors}
    while open_ := {k for k, x in rest.items() if math.sqrt(max(x, 0.0)) >= limits[k]}:
        gain = Counter()
        for k in open_:
            for t, w in vectors[k].items():
                if t not in triggers:
                    gain[t] += w * w * (1e-3 if t in COMMON else 1.0 if len(t) > 4 else 0.1 if len(t) > 2 else 1e-6)
        best = max(sorted(gain), key=gain.__getitem__)
        triggers.append(best)
        for k in rest:
            rest[k] -= vectors[k].get(best, 0.0) ** 2
    opening = frozenset(k for k in vectors if templates[k[0]][k[1]] == titles().get(k[0]))
    return Model(idf, math.log(1 + n) + 1, vectors, limits, tuple(triggers), opening)


def best_form(terms: Column, m: Model) -> Column:
    """(negated score, whether a family, licence, whether not a title) of the best form of an array of terms, or null; repeats count.

    One pass over the sorted terms, run by run, adds up the norm and all dot products.
    """
    forms = list(m.vectors)
    # By first letter, of each term its weight and then its shares of the forms; a constant of the plan.
    letters: dict[str, dict[str, list[float]]] = {}
    for t, x in m.idf.items():
        letters.setdefault(t[0], {})[t] = [x, *[x * m.vectors[k].get(t, 0.0) for k in forms]]
    table = F.from_json(F.lit(json.dumps(letters)), "map<string,map<string,array<double>>>")
    named = F.array(*[F.struct(F.lit(k[0] in FAMILIES).alias("family"), F.lit(k[0]).alias("license"), F.lit(k not in m.titles).alias("plain"), F.lit(m.limits[k]).alias("limit")) for k in forms])
    state = "struct<term:string,n:double,square:double,dots:array<double>>"

    def closed(a: Column) -> tuple[Column, Column]:
        """Square and dot products with the run that has come to its end."""
        row = F.try_element_at(F.try_element_at(table, F.left(a["term"], F.lit(1))), a["term"])
        weight = a["n"] * F.coalesce(F.get(row, 0), F.lit(m.unseen))
        more = F.zip_with(a["dots"], F.slice(row, 2, len(forms)), lambda x, y: x + a["n"] * y)
        return a["square"] + weight * weight, F.when(row.isNull(), a["dots"]).otherwise(more)

    def step(a: Column, t: Column) -> Column:
        square, dots = closed(a)
        longer = F.struct(a["term"].alias("term"), (a["n"] + 1.0).alias("n"), a["square"].alias("square"), a["dots"].alias("dots"))
        fresh = F.struct(t.alias("term"), F.lit(1.0).alias("n"), square.alias("square"), dots.alias("dots"))
        return F.when(a["term"] == t, longer.cast(state)).otherwise(fresh.cast(state))

    def finish(a: Column) -> Column:
        square, dots = closed(a)
        made = F.struct(square.alias("square"), dots.alias("dots"))
        scored = lambda s: F.zip_with(s["dots"], named, lambda d, k: F.struct((-F.floor(d / F.sqrt(s["square"]) * 1e9 + 0.5) / 1e9).alias("s"), k["family"].alias("family"), k["license"].alias("license"), k["plain"].alias("plain"), k["limit"].alias("limit")))
        every = F.get(F.transform(F.array(made), scored), 0)
        return F.when(square > 0, F.array_min(F.filter(every, lambda x: -x["s"] >= x["limit"])))

    start = F.struct(
        F.lit("").alias("term"), F.lit(0.0).alias("n"), F.lit(0.0).alias("square"), F.array_repeat(F.lit(0.0), len(forms)).alias("dots")
    ).cast(state)
    return F.aggregate(F.array_sort(terms), start, step, finish)


def any_word(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, branched by first letter, wherever the terms may have it as one.

    Terms follow each other without a space after a number's dot only, as in ``v2.0license``.
    """
    by_first: dict[str, list[str]] = {}
    for w in sorted(words):
        by_first.setdefault(w[0], []).append(re.escape(w[1:]) + ("(?![0-9])" if "." in w else "(?![a-z0-9])"))
    return "(?<![a-z])(?:" + "|".join(f"{re.escape(a)}(?:{'|'.join(rest)})" for a, rest in by_first.items()) + ")"


def scan(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    key_cols: tuple[str, ...] = ("doc_id",),
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The keys, ``path``, ``license``, ``score`` and ``origin``: header, file, the directory inherited from, or none."""
    m = model(templates, threshold)
    path = F.coalesce(F.col(path_col), F.lit(""))
    name = F.element_at(F.split(path, "/"), -1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    trigger = any_word(m.triggers)
    terms_of = lambda unit: F.regexp_extract_all(unit, F.lit(f"({TERM})"), F.lit(1))
    given = files.select(
        *key_cols,
        path.alias("path"),
        F.regexp_replace(path, "/?[^/]*$", "").alias("dir"),
        name.rlike(LICENSE_FILE).alias("named"),
        F.lower(text).alias("low"),
    )
    # Texts without a trigger are done; of others the whole comes first, then paragraphs and lines with one.
    parts = F.concat(F.split("low", GAP), F.split("low", "[\r\n]+"))
    units = F.array_distinct(F.concat(F.array("low"), F.filter(parts, lambda x: x.rlike(trigger))))
    several = lambda terms: F.size(F.array_distinct(terms)) > 1
    hits = F.transform(F.transform(units, terms_of), lambda t: F.when(several(t), best_form(t, m)))
    # How a text opens: its first paragraph, and its first two.
    paragraphs = F.filter(F.split("low", GAP), lambda x: x.rlike("[a-z0-9]"))
    openings = F.transform(F.array(*[F.array_join(F.slice(paragraphs, 1, k), "\n") for k in (1, 2)]), lambda x: F.when(x.rlike(trigger), best_form(terms_of(x), m)))
    opens = F.exists(openings, lambda h: h.isNotNull() & ~h["plain"] & ~h["family"] & (h["s"] <= -STRICT))
    # Both under one condition, as it looks through the whole text.
    said = F.when(F.col("low").rlike(trigger), F.struct(hits.alias("hits"), opens.alias("opens"))).alias("said")
    found = given.select(*key_cols, "path", "dir", "named", said)
    by_version = F.transform(F.filter("said.hits", lambda h: h.isNotNull()), lambda h: F.struct(h["family"].alias("family"), h["s"].alias("s"), h["license"].alias("license")))
    is_license = F.col("named") | F.coalesce(F.get("said.hits", 0)["s"] <= -STRICT, F.lit(False)) | F.coalesce("said.opens", F.lit(False))
    # Written once, without texts, as three plans start from it.
    own = cut(found, "licenses").select(*key_cols, "path", "dir", F.coalesce(is_license, F.lit(False)).alias("is_license"), F.array_min(by_version).alias("own"))
    says = own.where(F.col("is_license") & F.col("own").isNotNull()).groupBy(F.col("dir").alias("above")).agg(F.min("own").alias("said"))
    # All ancestors of every directory in use, itself included, by depth.
    steps = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("above")),
    )
    chains = own.select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above").distinct()
    nearest = (
        chains.join(says, "above")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "above", "said")).alias("near"))
        .select("dir", F.col("near.above").alias("from"), F.col("near.said.license").alias("inherited"), (-F.col("near.said.s")).alias("near_score"))
    )
    # One row a directory on the right: adaptive execution splits a directory of many files.
    joined = own.join(nearest, "dir", "left")
    return joined.select(
        *key_cols,
        "path",
        F.coalesce("own.license", "inherited").alias("license"),
        F.when(F.col("own").isNotNull(), -F.col("own.s")).otherwise(F.col("near_score")).alias("score"),
        F.when(F.col("own").isNotNull(), F.when(F.col("is_license"), "file").otherwise("header"))
        .when(F.col("inherited").isNotNull(), F.concat(F.lit("directory:"), F.col("from")))
        .otherwise("none")
        .alias("origin"),
    )
