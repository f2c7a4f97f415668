"""Licence scans: TF-IDF cosine of licence passages to templates, and inheritance by directory (operator 8)."""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty
from .quality_rules import let


def gnu(name: str, version: str, what: str = "program", software: str = "program is free software") -> list[str]:
    """The standard header of a GNU licence, and its first paragraph alone."""
    first = f"This {software}: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    rest = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    return [first, f"{first} {rest}"]


GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
#: Usual wordings of notices and the standard headers, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal"),
    *(("GPL-3.0", x) for x in gnu(GPL, "3")), *(("GPL-2.0", x) for x in gnu(GPL, "2")), *(("AGPL-3.0", x) for x in gnu(AGPL, "3")),
    *(("LGPL-3.0", x) for x in gnu(LGPL, "3", "library", "library is free software")), *(("LGPL-2.1", x) for x in gnu(LGPL, "2.1", "library", "library is free software")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for kind, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
)
#: Whole licence texts by SPDX name. AGPL-3.0 is GPL-3.0 with the other name and date; the two differ in one section.
TEXTS = Path(__file__).parent / "license_texts"
#: A passage has a whole text's licence from this cosine on: different licences share much of their wording.
ALIKE = 0.8
#: A block is so many adjoining paragraphs at most, as many as the longest notice has. Longer licences within a text are cut out by their title and number of paragraphs.
BLOCK = 8
CUE = r"(?i)licen[sc]|copyright|spdx|permission (?:is|to)|redistribution and use|public domain"
#: A paragraph ends at a line without letters or digits, be it empty or a comment sign alone.
PARAGRAPH = r"\r?\n(?:[^\p{L}\p{N}\n]*\n)+"
#: The last line of a comment, where a line that is no comment follows; the text's paragraph ends there too.
COMMENT = r"(?m)^([ \t]*(?://|#|\*|/\*|--|;|%|<!--)[^\n]*\n)(?=[ \t]*[^\s/#*;%<-])"
ONE = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+:]|-(?=[A-Za-z0-9]))*\)*"
SPDX = rf"(?i)SPDX-License-Identifier:[ \t]*({ONE}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{ONE})*)"
SENTENCE = r"\n|(?<=[.!?])[ \t]+(?=\p{Lu})"
SALTS = 16
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def terms(text: Column) -> Column:
    """Words and neighbouring word pairs, lower case."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)*"), F.lit(0))
    return F.concat(w, F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))))


def weighted(texts: DataFrame, idf: DataFrame) -> DataFrame:
    """(k, term, weight): unit TF-IDF vectors of (k, text)."""
    tf = texts.select("k", F.explode(terms(F.col("text"))).alias("term")).where("term IS NOT NULL").groupBy("k", "term").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "k").select("k", "term", (F.col("w") / F.col("norm")).alias("weight"))


def identifier(text: Column) -> Column:
    """The SPDX expressions of the text's identifier lines, joined by AND; null without one. Lines with a name that SPDX doesn't list are left out."""
    listed = F.split(F.lit((TEXTS / "spdx_ids").read_text().strip()), "\n")

    def valid(x: Column) -> Column:
        names = F.filter(F.split(F.regexp_replace(x, r"[()]", ""), r"[ \t]+(?:AND|OR)[ \t]+|[ \t]+WITH[ \t]+[^ \t]+|[ \t]+"), lambda n: n != "")
        return F.forall(names, lambda n: F.array_contains(listed, F.regexp_replace(n, r"[+]$", "")) | n.startswith("LicenseRef-") | n.startswith("DocumentRef-"))

    found = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), valid)))
    return F.when(F.size(found) > 0, F.array_join(found, " AND "))


@cache
def titles() -> dict[str, list[int]]:
    """First lines of the whole licence texts of more than BLOCK paragraphs, as patterns, with these numbers of paragraphs."""
    found: dict[str, list[int]] = {}
    for f in sorted(TEXTS.glob("*.txt")):
        parts = [x for x in re.split(r"\r?\n(?:[^\w\n]*\n)+", f.read_text()) if x.strip()]
        if len(parts) > BLOCK:
            line = next(x for x in f.read_text().splitlines() if x.strip()).split()
            found.setdefault(r"(?im)^\W*" + r"\s+".join(map(re.escape, line)) + r"\W*$", []).append(len(parts))
    return found


def passages(text: Column) -> Column:
    """The (level, text) that are compared: sentences or lines, blocks of paragraphs, whole licences from their title on, the whole text."""

    def blocks(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: F.get(x, i - 1).rlike(CUE))
        of = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.size(x) - i + 1)), lambda n: F.array_join(F.slice(x, i, n), "\n"))

        def long(title: str, n: int) -> Column:
            return F.transform(F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: F.get(x, i - 1).rlike(title)), lambda i: F.array_join(F.slice(x, i, F.lit(n)), "\n"))

        whole = [long(title, n) for title, sizes in titles().items() for n in sorted(set(sizes))]
        return F.array_distinct(F.concat(F.flatten(F.transform(starts, of)), *whole, F.array().cast("array<string>")))

    def level(k: int, items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(k).alias("level"), x.alias("text")))

    lines = F.array_distinct(F.filter(F.split(text, SENTENCE, -1), lambda x: x.rlike(CUE)))
    return F.concat(level(1, lines), level(2, let(F.split(F.regexp_replace(text, COMMENT, "$1\n"), PARAGRAPH, -1), blocks)), level(3, F.array(text)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, least: float = 0.6, whole: float = 0.6) -> DataFrame:
    """One row for each row of df: id, path, license, similarity and origin ('file', 'header', 'inherited' or null).

    Passages of a text with a licensing cue are compared with the templates: its sentences or lines with the
    cue, blocks of 1 to BLOCK adjoining paragraphs from each paragraph with it, as many paragraphs as a whole licence has from its title
    on, and the whole text. A passage's
    licence is that of the notice of the greatest TF-IDF cosine, if that is at least `least`, or that of a
    whole licence text from ALIKE on. A row's own licence is what its SPDX-License-Identifier lines say, as
    written and with similarity 1; else that of the passage most like a whole licence text; else that of its
    best notice. It is a licence file if its name says so or its licence passages make up the share `whole`
    of its text; a licence file speaks for its directory and all below. A row without a licence of its
    own takes that of the nearest ancestor directory with one. Files that contradict each other in a directory are
    decided by similarity, then name. Null texts count as empty, null paths as the root. Repeated rows stay; an
    empty table gives an empty result. Other columns aren't carried.

    Equal passages are compared once. Each passage meets only the templates' terms, a fixed number.
    """
    spark = df.sparkSession
    where = F.coalesce(path if path is not None else F.col(id_col).cast("string"), F.lit(""))
    source = df.select(F.col(id_col).alias("id"), where.alias("path"), text_or_empty(text_col).alias("text"))
    cued = F.col("text").rlike(CUE)
    found = F.when(cued, passages(F.col("text"))).otherwise(F.array().cast("array<struct<level:int,text:string>>"))
    spdx = F.when(cued & F.col("text").rlike("(?i)SPDX-License-Identifier:"), identifier(F.col("text")))
    rows = durable(source.select("id", "path", F.length("text").alias("chars"), spdx.alias("spdx"), found.alias("passages")).withColumn("row", F.monotonically_increasing_id()))
    passage = rows.select("row", F.explode("passages").alias("p")).select("row", "p.level", "p.text").withColumn("k", F.xxhash64("text"))
    distinct = durable(passage.groupBy("k").agg(F.min("text").alias("text")))
    fixed_texts = [(name, text, False) for name, text in TEMPLATES] + [(f.stem, f.read_text(), True) for f in sorted(TEXTS.glob("*.txt"))]
    rows_of = [F.struct(F.lit(-i).cast("long").alias("k"), F.lit(name).alias("license"), F.lit(text).alias("text"), F.lit(full).alias("full")) for i, (name, text, full) in enumerate(fixed_texts, 1)]
    templates = spark.range(1).select(F.inline(F.array(*rows_of)))
    shown = templates.select("k", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).where("term IS NOT NULL")
    seen = distinct.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    number = distinct.agg((F.count("*") + len(fixed_texts)).alias("all"))
    counts = seen.unionByName(shown.groupBy("term").agg(F.count("*").alias("n"))).groupBy("term").agg(F.sum("n").alias("n"))
    idf = durable(counts.crossJoin(F.broadcast(number)).select("term", (F.log((1.0 + F.col("all")) / (1.0 + F.col("n"))) + 1).alias("idf")))
    fixed = weighted(templates.select("k", "text"), idf).select(F.col("k").alias("t"), "term", F.col("weight").alias("u"))
    cosine = weighted(distinct, idf).join(F.broadcast(fixed), "term").groupBy("k", "t").agg(F.round(F.sum(F.col("weight") * F.col("u")), 6).alias("similarity"))
    named = cosine.join(F.broadcast(templates.select(F.col("k").alias("t"), "license", "full")), "t").where(F.col("similarity") >= F.when(F.col("full"), F.lit(max(least, ALIKE))).otherwise(F.lit(least)))
    best = durable(named.groupBy("k").agg(F.max(F.struct("full", "similarity", "license")).alias("best")).select("k", "best.*"))

    # A whole text with more than a notice in it is judged by its parts.
    mine = passage.join(best, "k").where(F.col("full") | (F.col("level") < 3))
    told = F.greatest(F.coalesce(F.sum(F.when(F.col("level") == 1, F.length("text"))), F.lit(0)), F.coalesce(F.max(F.when((F.col("level") > 1) & (F.col("similarity") >= ALIKE), F.length("text"))), F.lit(0)))
    own = mine.groupBy("row").agg(F.max(F.struct("full", "similarity", "license")).alias("top"), told.alias("told"))
    stated = F.when(F.col("spdx").isNotNull(), F.struct(F.lit(1.0).alias("similarity"), F.col("spdx").alias("license")))
    matched = F.when(F.col("top").isNotNull(), F.struct(F.col("top.similarity").alias("similarity"), F.col("top.license").alias("license")))
    rows = rows.join(own, "row", "left").select("row", "id", "path", F.coalesce(stated, matched).alias("best"), (F.col("path").rlike(FILE_NAME) | F.coalesce(F.col("told") >= F.col("chars") * whole, F.lit(False))).alias("file"))
    rows = durable(rows.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")))
    of_dir = rows.where("file AND best IS NOT NULL").groupBy("dir").agg(F.max("best").alias("given"))
    dirs = rows.where("best IS NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("above"))
    near = up.join(of_dir.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "given")).alias("near"))
    # A directory may hold a large part of all rows: they are dealt out over SALTS parts, and what it inherits goes to each.
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(near, ["dir", "salt"], "left")
    final = F.coalesce("best", "near.given")
    origin = F.when(F.col("best").isNotNull(), F.when(F.col("file"), "file").otherwise("header")).when(F.col("near").isNotNull(), "inherited")
    return out.select(F.col("id").alias(id_col), "path", final["license"].alias("license"), final["similarity"].alias("similarity"), origin.alias("origin"))
