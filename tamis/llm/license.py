"""License scans: sparse TF-IDF cosine of notices, headers and licence files to templates, then inheritance from the nearest
ancestor directory.

Built from column expressions and joins only. A text that speaks of licensing has units: its lines and sentences that do, the
passages that begin like a known header or licence, and, in a licence file, the whole text. Units are rows of words; a join
with the templates' words gives the products with all templates at once, so neither plan nor work per word grows with their
number. Texts in several files are weighed once. Licence files then give their licence to the directories below them by joins
on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

#: Wordings that one-line notices of licences use, titles among them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "Released under the BSD 3-Clause License.", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {which} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {which} for more details."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
#: Texts of licences and headers over several lines: the words that open them, and their wordings.
HEADERS = {
    "AGPL-3.0": ["is free software", _GNU.format(what="program", which="Affero General Public License", version="3")],
    "Apache-2.0": ["licensed under the apache license version 2.0 the", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": ["redistribution and use in source and binary forms", _BSD.format("")],
    "BSD-3-Clause": ["redistribution and use in source and binary forms", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")],
    "GPL-2.0": ["is free software", _GNU.format(what="program", which="General Public License", version="2")],
    "GPL-3.0": ["is free software", _GNU.format(what="program", which="General Public License", version="3")],
    "ISC": ["permission to use copy modify and", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "LGPL-2.1": ["is free software", _GNU.format(what="library", which="Lesser General Public License", version="2.1")],
    "LGPL-3.0": ["is free software", _GNU.format(what="library", which="Lesser General Public License", version="3")],
    "MIT": ["permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"],
}
#: Titles over two lines: the words that open them, and their wordings.
TITLES = {
    "Apache-2.0": ["apache license version 2.0 january", "Apache License Version 2.0, January 2004"],
    "GPL-2.0": ["gnu general public license version 2 june", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["gnu general public license version 3 29", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["gnu lesser general public license version 2.1 february", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["gnu lesser general public license version 3 29", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MPL-2.0": ["mozilla public license version 2.0 1 definitions", "Mozilla Public License Version 2.0 1. Definitions"],
}
#: What a text with the openings above matches.
OPENING = r"(?i)hereby\s+granted|redistribution\s+and\s+use|free\s+software|under\s+the\s+apache|permission\s+to\s+use|apache\s+license|general\s+public\s+license|mozilla\s+public\s+license"
#: A segment is looked at if it matches MENTION; its cosine must reach THRESHOLD.
MENTION = r"(?i)licen[sc]|copyright|spdx|\bcc0?\b|public domain|creative commons"
THRESHOLD = 0.75
#: File names of licence files.
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)([._-][^/]*)?$"
WORDS = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def headers() -> list[tuple[str, str, str]]:
    """(licence, opening, wording) of headers, bodies and titles."""
    return [(name, opening, text) for table in (HEADERS, TITLES) for name, (opening, text) in table.items()]


def licence_texts() -> dict[str, list[str]]:
    """Whole texts of licences: the files beside this module, named by licence, and the bodies among HEADERS."""
    folder = resources.files(__package__) / "licences"
    out = {f.name.removesuffix(".txt"): [f.read_text(encoding="utf-8")] for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    for name in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT"):
        out.setdefault(name, []).append(HEADERS[name][1])
    return out


def weights(templates: dict[str, list[str]]) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Inverse document frequency of the templates' words, that of any other word, and unit vectors by wording."""
    texts = [(name, Counter(words(t))) for name in sorted(templates) for t in templates[name]]
    n = len(texts)
    df = Counter(w for _, c in texts for w in c)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in sorted(df.items())}
    vectors = []
    for name, c in texts:
        size = math.sqrt(sum((k * idf[w]) ** 2 for w, k in c.items()))
        vectors.append((name, {w: k * idf[w] / size for w, k in sorted(c.items())}))
    return idf, math.log(1 + n) + 1, vectors


def kinds(templates: dict[str, list[str]] | None = None) -> dict[str, tuple]:
    """Weights of the templates of each kind of unit: line, window, file."""
    spoken: dict[str, list[str]] = {}
    for name, _, text in headers():
        spoken.setdefault(name, []).append(text)
    return {"line": weights(TEMPLATES if templates is None else templates), "window": weights(spoken), "file": weights(licence_texts())}


def windows() -> list[str]:
    """Patterns of passages, in words joined by spaces, that begin as a header does and are as long: how lines are broken or
    marked as comments makes no difference."""
    spans = sorted({(opening, len(words(t)) - len(opening.split(" "))) for _, opening, t in headers()})
    return [rf"(?:this \w+ )?{opening.replace('.', '[.]')}(?: \S+){{0,{n}}}" for opening, n in spans]


def _spoken(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)), " ")


def _units(text: Column, is_file: Column) -> Column:
    """array<struct<kind, words>> of a text."""
    unit = lambda kind: lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("words"))
    segments = F.filter(F.split(text, r"\n|(?<=[.!;])\s+"), lambda s: s.rlike(MENTION))
    lines = F.transform(F.transform(segments, _spoken), unit("line"))
    # the text's words once, for the windows and the whole
    long = F.filter(F.array(F.when(is_file | text.rlike(OPENING), _spoken(text))), lambda x: x.isNotNull())
    found = F.flatten(F.transform(long, lambda x: F.concat(*[F.regexp_extract_all(x, F.lit(w), F.lit(0)) for w in windows()])))
    whole = F.filter(F.transform(long, unit("file")), lambda _: is_file)
    return F.array_distinct(F.filter(F.concat(lines, F.transform(found, unit("window")), whole), lambda u: u["words"] != ""))


def vocabulary(spark: SparkSession, by_kind: dict[str, tuple]) -> DataFrame:
    """(kind, w, idf, entries): each word of the templates of a kind, with its weights in them. As many rows as those have
    different words, so small enough to broadcast."""
    rows = []
    for kind, (idf, _, vectors) in by_kind.items():
        entries: dict[str, list] = {}
        for t, (name, v) in enumerate(vectors):
            for w, x in v.items():
                entries.setdefault(w, []).append((t, name, x))
        rows += [(kind, w, idf[w], e) for w, e in entries.items()]
    return spark.createDataFrame(rows, "kind string, w string, idf double, entries array<struct<t:int,name:string,x:double>>")


def _scored(units: DataFrame, by_kind: dict[str, tuple]) -> DataFrame:
    """(id, s, l): the best template of each text whose cosine reaches the threshold, s its cosine below zero."""
    tf = units.select("id", "u", "kind", F.explode(F.split("words", " ")).alias("w")).groupBy("id", "u", "kind", "w").agg(F.count("*").alias("k"))
    met = tf.join(F.broadcast(vocabulary(units.sparkSession, by_kind)), ["kind", "w"], "left")
    other = F.coalesce(*[F.when(F.col("kind") == kind, other) for kind, (_, other, _) in by_kind.items()])
    sizes = met.groupBy("id", "u").agg(F.sqrt(F.sum(F.pow(F.col("k") * F.coalesce("idf", other), 2))).alias("size"))
    each = met.where("idf is not null").select("id", "u", (F.col("k") * F.col("idf")).alias("v"), F.explode("entries").alias("e"))
    dots = each.groupBy("id", "u", F.col("e.t").alias("t"), F.col("e.name").alias("name")).agg(F.sum(F.col("v") * F.col("e.x")).alias("dot"))
    scores = dots.join(sizes, ["id", "u"]).select("id", F.round(F.col("dot") / F.col("size"), 9).alias("score"), "name").where(F.col("score") >= THRESHOLD)
    return scores.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("name").alias("l"))).alias("b")).select("id", "b.s", "b.l")


def scan(df: DataFrame, text: str = "text", path: str = "path", key: str = "doc_id", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, path, license, score, basis, license_path) for each row.

    basis is `notice` if the text itself has a unit near enough to a template: a line or sentence, a passage that begins as
    a header, a licence or its title does, or, in a licence file (by its name), the whole text. License and score are the best
    of all, ties to the smaller name. Else it is `inherited` if a licence file with such a unit lies in the row's directory or the
    nearest one above that has any (of several there the best score, then the smaller path), else `none` with null license and
    score 0. A null path is a file of no directory: it inherits nothing. A null or empty text has no units. Texts are read
    whole. Repeated rows are judged alike; extra columns are not read; an empty table gives no rows. templates: other notices.
    """
    t, is_file = F.col(text), F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False))
    speaks = t.rlike(f"{MENTION}|{OPENING[4:]}")
    mark = F.concat(F.md5(t.cast("binary")), F.when(is_file, "f").otherwise("t"))
    rows = stage(df.select(F.col(key).alias("key"), F.col(path).alias("path"), is_file.alias("is_file"), F.when(speaks, F.struct(mark.alias("id"), _units(t, is_file).alias("units"))).alias("said")), "notices")
    units = rows.where("size(said.units) > 0").select(F.col("said.id").alias("id"), F.posexplode("said.units").alias("u", "unit")).select("id", "u", "unit.kind", "unit.words").distinct()
    best = _scored(units, kinds(templates)).withColumnRenamed("id", "_id")
    rows = rows.select("key", "path", "is_file", F.col("said.id").alias("id"), F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))).alias("dir"))
    rows = stage(rows.join(best, F.col("id") == F.col("_id"), "left").select("key", "path", "is_file", "dir", "s", "l"), "own")
    files = rows.where("is_file and l is not null").groupBy("dir").agg(F.min(F.struct("s", F.col("path").alias("p"), "l")).alias("b")).select(F.col("dir").alias("at"), "b")
    # each directory with files meets those above it, nearest first; files then meet their directory
    dirs = rows.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("at")))).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("at"))))
    given = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.*").join(files, "at").groupBy("dir").agg(F.max_by("b", "depth").alias("b")).withColumnRenamed("dir", "_dir")
    out = rows.join(given, F.col("dir") == F.col("_dir"), "left")
    has = F.col("l").isNotNull()
    return out.select(
        F.col("key").alias(key),
        F.col("path").alias(path),
        F.when(has, F.col("l")).otherwise(F.col("b.l")).alias("license"),
        F.when(has, -F.col("s")).otherwise(F.coalesce(-F.col("b.s"), F.lit(0.0))).alias("score"),
        F.when(has, "notice").when(F.col("b").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(has, F.col("path")).otherwise(F.col("b.p")).alias("license_path"),
    )
