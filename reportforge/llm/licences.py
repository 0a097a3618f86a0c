"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

A text is cut at line ends and after sentences. Every window of up to four neighbouring segments is a header that may state
a licence; of a licence file the whole text is one more. A term that no template holds weighs little, so names and years
around a statement do not hide it. Only windows with a term that a template cannot do without are scored: without the
heaviest terms of a template the rest can't reach the least cosine, so this leaves nothing out. Windows are scored inside
their text's row; a row gives its best statement, and paths, folders and files meet by joins.

A file's own statement counts first: the window that is nearest to a template. A file without one takes the licence of the
nearest directory above it that holds a licence file with a statement.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, staged, table
from .quality import let

# Customary statements of public licences by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License (CC BY-SA 4.0)."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The MIT License"),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
]
#: Least cosine of a statement, most segments of a window, and what a term outside the templates weighs, of its square.
NEAR, WINDOW, OUTSIDE = 0.7, 4, 0.1
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
# Words that carry no sense of their own; they are no terms.
STOP = ["a", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "from", "in", "into", "is", "it", "may", "not", "of", "on", "or", "so", "that", "the", "this", "to", "under", "with", "without", "you"]
TERM, SEGMENT = r"[a-z0-9]+(?:\.[0-9]+)*", r"\n|(?<=[.;:!?])\s+"


def terms(text: str) -> Counter:
    return Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP)


def template_weights() -> tuple[list[tuple[int, str, str, float, float]], float]:
    """(template, licence, term, weight of unit length, idf) of every template's terms, and the idf of terms in none."""
    texts = [(name, terms(text)) for name, text in TEMPLATES]
    df = Counter(t for _, c in texts for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for k, (name, counts) in enumerate(texts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        rows += [(k, name, t, n * idf[t] / norm, idf[t]) for t, n in sorted(counts.items())]
    return rows, math.log(1 + len(texts)) + 1


def needed_terms(near: float) -> list[str]:
    """Terms of which any text within `near` of a template holds one: of each the heaviest, until the rest can't reach it.

    Bare numbers come last, as texts hold many.
    """
    of, needed = defaultdict(list), set()
    for k, _, t, w, _ in template_weights()[0]:
        of[k].append((w, t))
    for own in of.values():
        rest = 1.0
        for w, t in sorted(own, key=lambda x: (x[1].isdigit(), -x[0], x[1])):
            if rest < near * near * (1 - 1e-9):
                break
            needed.add(t)
            rest -= w * w
    return sorted(needed)


def needed_pattern(near: float) -> str:
    """Any needed term as a word; terms of one first sign are tried together."""
    rest = defaultdict(list)
    for t in needed_terms(near):
        rest[t[0]].append(re.escape(t[1:]))
    return r"(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(x)})" for c, x in sorted(rest.items())) + r")(?![a-z0-9])"


def best_statement(near: float) -> Callable[[str, bool], tuple[str, float, int, int] | None]:
    """A function of a lower-case text, and whether it is a licence file: its best statement's licence, score, start, many."""
    rows, unknown = template_weights()
    needed, idf, of, name = set(needed_terms(near)), {t: x for _, _, t, _, x in rows}, defaultdict(list), {}
    for k, licence, t, w, _ in rows:
        name[k] = licence
        of[t].append((k, w))
    split, find, stop = re.compile(SEGMENT, re.ASCII).split, re.compile(TERM).findall, set(STOP)

    def scored(counts: Counter, start: int, many: int) -> Iterator[tuple[float, str, int, int]]:
        known = sorted(counts.keys() & idf.keys())
        square = sum((counts[t] * idf[t]) ** 2 for t in known)
        other = sum(n * n for n in counts.values()) - sum(counts[t] ** 2 for t in known)
        norm = math.sqrt(square + OUTSIDE * unknown**2 * other)
        if math.sqrt(square) < (near - 1e-8) * norm:  # no template's cosine is above this share
            return
        dots = Counter()
        for t in known:
            for k, w in of[t]:
                dots[k] += w * counts[t] * idf[t]
        for k, dot in dots.items():
            score = round(dot / norm, 9)
            if score >= near:
                yield -score, name[k], start, many

    def best(text: str, licence_file: bool) -> tuple[str, float, int, int] | None:
        segments = [t for t in map(find, split(text)) if t]
        hits = {i for i, t in enumerate(segments) if not needed.isdisjoint(t)}
        found = []
        for start in sorted({a for i in hits for a in range(max(0, i - WINDOW + 1), i + 1)}):
            counts, hit = Counter(), False
            for i, own in enumerate(segments[start : start + WINDOW], start):
                counts.update(t for t in own if t not in stop)
                hit = hit or i in hits
                if hit:
                    found += scored(counts, start, i - start + 1)
        if licence_file and len(segments) > WINDOW:
            found += scored(Counter(t for own in segments for t in own if t not in stop), 0, len(segments))
        if not found:
            return None
        score, licence, start, many = min(found)
        return licence, -score, start, many

    return best


def stated(path: F.Column, text: F.Column, near: float) -> F.Column:
    """(licence, score, start, many) of a row's best statement, nulls without one; a window lies in one row, so no row moves."""

    @F.pandas_udf("licence string, score double, start int, many int")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        best = best_statement(near)
        for files, texts in batches:
            rows = [None if t is None else best(t, bool(f)) for f, t in zip(files.array, texts.array, strict=True)]
            out = pd.DataFrame([r or (None,) * 4 for r in rows], columns=["licence", "score", "start", "many"])
            yield out.astype({"score": "Float64", "start": "Int32", "many": "Int32"})

    return judge(F.coalesce(path.rlike(LICENCE_FILE), F.lit(False)), F.when(F.lower(text).rlike(needed_pattern(near)), F.lower(text)))


def best_of_paths(judged: DataFrame) -> DataFrame:
    """(path, licence, score, start, many): the best statement of every path that has one, of rows (path, said)."""
    best = judged.filter("said.licence is not null").groupBy("path").agg(F.min(F.struct((-F.col("said.score")).alias("s"), "said.licence", "said.start", "said.many")).alias("x"))
    return best.select("path", F.col("x.licence").alias("licence"), (-F.col("x.s")).alias("score"), F.col("x.start").alias("start"), F.col("x.many").alias("many"))


def statements(files: DataFrame, near: float) -> DataFrame:
    """(path, licence, score, start, many): the best statement of every path that has one, and the segments that make it.

    Ties go to the first licence by name, then to the earliest and shortest window. Rows that repeat a path are read
    one by one.
    """
    bound_batches(files.sparkSession, 4 << 20)
    return best_of_paths(files.select("path", stated(F.col("path"), F.col("text"), near).alias("said")))


def above(folder: F.Column) -> F.Column:
    """A folder and all folders above it, the nearest first; the empty string is the root."""
    parts = lambda f: F.filter(F.split(f, "/"), lambda x: x != "")
    return let(parts(folder), lambda p: F.transform(F.sequence(F.size(p), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/")))


def licence_scan(files: DataFrame, near: float = NEAR) -> DataFrame:
    """(path, licence, score, how, licence_from) of every distinct path of `files` (path, text).

    how is 'own' (a statement in the text), 'inherited' (from the licence file of the nearest folder, `licence_from`)
    or 'none'. Whole texts are read, once. A null text states nothing; rows with a null path are left out; of rows that
    repeat a path the best statement counts. Of several licence files in a folder the first by name speaks for it. Other
    columns are not read. Folders, not files, meet their ancestors, and each folder once; files meet written tables, so
    that the planner can split the files of a folder that holds most of them.
    """
    named = files.filter(F.col("path").isNotNull())
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1), "^/+|/+$", "")
    bound_batches(files.sparkSession, 4 << 20)
    # One scan: every path, and what its text states.
    read = staged(named.select("path", folder.alias("folder"), stated(F.col("path"), F.col("text"), near).alias("said")), "files", "zstd")
    found = staged(best_of_paths(read), "statements", "zstd")
    paths = read.select("path", "folder").distinct()
    spoken = found.filter(F.col("path").rlike(LICENCE_FILE)).withColumn("folder", F.regexp_replace(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1), "^/+|/+$", ""))
    spoken = spoken.groupBy("folder").agg(F.min(F.struct("path", "licence", "score")).alias("file"))
    chains = read.select("folder").distinct().select("folder", F.posexplode(above(F.col("folder"))).alias("up", "at"))
    nearest = chains.join(spoken.withColumnRenamed("folder", "at"), "at").groupBy("folder").agg(F.min(F.struct("up", "at", "file")).alias("n"))
    nearest = staged(nearest, "nearest", "zstd")
    told = staged(paths.join(found.select("path", "licence", "score"), "path", "left"), "told", "zstd")
    given = told.join(nearest, "folder", "left")
    own = F.col("licence").isNotNull()
    return given.select(
        "path", F.coalesce("licence", "n.file.licence").alias("licence"), F.coalesce("score", "n.file.score").alias("score"),
        F.when(own, "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(own, F.col("path")).otherwise(F.col("n.at")).alias("licence_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/hundred/lang/doc_id.txt; every hundredth is its folder's LICENSE."""
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    source, lang = F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(lang, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", source, hundred, name).alias("path"), "text")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_scan(document_paths(table(spark, sf_dir, "documents").filter("doc_id is not null")))
    number = F.coalesce(F.regexp_extract("path", r"/(\d+)\.txt$", 1).try_cast("long"), 100 * F.regexp_extract("path", r"/(\d+)/LICENSE$", 1).try_cast("long"))
    return found.withColumn("doc_id", number)
