"""Licence detection: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor folders.

Units of a file (its sentences, its lines, runs of these of up to twice a template's words, so that a notice may be wrapped
over lines, and the file as a whole) are compared with the templates. Marks of comments hold no word. A unit whose
cosine to a template reaches `least` must hold one of the template's prefix tokens (its words, common ones last and
else the heaviest first, up to where the rest of its weight falls below `least`), so only such units are scored. Cosine finds the
family; the words that tell its members apart (versions, Affero, Lesser) must then stand in the unit, and a notice that says
that a licence does not hold is none. A file without a licence of its own gets that
of the licence file in the nearest folder above it, by joining the folder paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm.common import appended, scratch, table, with_columns, without

#: Least cosine of a match.
LEAST = 0.75
#: Rows of a table of folders that may be broadcast (some 100 bytes a row); more are joined by shuffle.
BROADCAST_DIRS = 50_000
#: Tasks that the files of one folder are spread over in that shuffle.
SALTS = 32
_GNU = "{} free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_OLD_GNU = "{} free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
#: Notices and titles by licence.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format("This program is", "Affero ", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("This program is", "", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _OLD_GNU.format("This program is", "", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("This library is", "Lesser ", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", _OLD_GNU.format("This library is", "Lesser ", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License", _BSD],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License", _BSD],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
    "Proprietary": ["Copyright. All rights reserved."],
}
#: Words that tell licences of a family apart: a notice must hold one of each set and none of the last.
MARKS: dict[str, tuple[list[set[str]], set[str]]] = {
    "ISC": ([{"isc", "fee"}], set()),
    "Apache-2.0": ([{"apache"}, {"2.0", "2", "v2.0", "v2"}], set()),
    "AGPL-3.0": ([{"affero"}, {"3", "3.0"}], {"lesser"}),
    "GPL-3.0": ([{"general"}, {"3", "3.0"}], {"affero", "lesser", "library"}),
    "GPL-2.0": ([{"general"}, {"2", "2.0"}], {"affero", "lesser", "library"}),
    "LGPL-3.0": ([{"lesser"}, {"3", "3.0"}], {"affero"}),
    "LGPL-2.1": ([{"lesser"}, {"2.1"}], {"affero"}),
    "BSD-2-Clause": ([{"2", "redistribution"}], {"3"}),
    "BSD-3-Clause": ([{"3", "redistribution"}], set()),
    "MPL-2.0": ([{"mozilla"}, {"2.0"}], set()),
    **{f"CC-{kind}-{version}": ([{"cc", "creative"}, {version}], {"BY": {"sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives"}, "BY-SA": {"nc", "nd", "noncommercial", "noderivatives"}, "BY-NC": {"sa", "nd", "sharealike", "noderivatives"}}[kind]) for kind in ("BY", "BY-SA", "BY-NC") for version in ("3.0", "4.0")},
}
#: A sentence that says that a licence does not hold.
_DENIED = re.compile(r"\b(?:not|never|no longer|isn['’]t|aren['’]t|wasn['’]t)\b(?:\W+\w+){0,2}?\W+(?:licen[sc]ed|released|distributed|published|covered|subject|available)\b")
_TAG = re.compile(r"spdx-license-identifier:\s*\(?\s*([a-z0-9.+-]+)")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_UNIT = re.compile(r"(?<=[.!?;])\s+|\n")
_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([.\-_].*)?$"


#: Words too common to be prefix tokens unless nothing else is left, the commonest last.
COMMON = "subject provided following copy file files form free general without work use may not under you with this that any all as at be are for is it by or in to of a and the".split()


def _marked(name: str, words: Mapping[str, int]) -> bool:
    """Whether a notice holds the words that tell this licence from others of its family."""
    needed, barred = MARKS.get(name, ([], set()))
    return all(any(w in words for w in some) for some in needed) and not any(w in words for w in barred)


class Scanner:
    """TF-IDF weights of the templates; a word that no template has weighs as much as the rarest."""

    def __init__(self, templates: Mapping[str, list[str]] = TEMPLATES, least: float = LEAST):
        texts = [(name, Counter(_WORD.findall(t.lower()))) for name, ts in sorted(templates.items()) for t in ts]
        held = Counter(w for _, c in texts for w in c)
        self.rarest = math.log(1 + len(texts)) + 1
        self.idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in held.items()}
        self.least = least
        self.vectors, self.by_word, prefix = [], {}, set()
        self.longest = [2 * sum(counts.values()) for _, counts in texts]
        self.owners: dict[str, list[int]] = {}
        for i, (name, counts) in enumerate(texts):
            vector = self._vector(counts)
            self.vectors.append((name, vector))
            left = 1.0
            for w in sorted(vector, key=lambda w: (COMMON.index(w) + 1 if w in COMMON else 0, -vector[w], w)):
                if left <= 0 or math.sqrt(left) < least:
                    break
                prefix.add(w)
                self.owners.setdefault(w, []).append(i)
                left -= vector[w] ** 2
            for w, x in vector.items():
                self.by_word.setdefault(w, []).append((i, x))
        self.prefix = frozenset(prefix)
        self.names = {name.lower(): name for name in templates}
        self._any = re.compile(r"(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(prefix, key=lambda w: (-len(w), w))) + r")(?![a-z0-9])")

    def _vector(self, counts: Mapping[str, int]) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.rarest) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    def score(self, unit: str) -> tuple[str | None, float]:
        """The nearest template's licence and cosine; ties to the first by name."""
        counts = Counter(_WORD.findall(unit.lower()))
        if self.prefix.isdisjoint(counts):
            return None, 0.0
        dots: dict[int, float] = {}
        for w, x in self._vector(counts).items():
            for i, y in self.by_word.get(w, ()):
                dots[i] = dots.get(i, 0.0) + x * y
        near = sorted((-dot, i) for i, dot in dots.items() if dot >= self.least)
        if not near or _DENIED.search(unit.lower()):
            return None, max(dots.values())
        return next(((self.vectors[i][0], -dot) for dot, i in near if _marked(self.vectors[i][0], counts)), (None, 0.0))

    def runs(self, units: list[list[str]]) -> tuple[str | None, float]:
        """The best licence of any run of two or more consecutive units with at most twice the template's words."""
        best: tuple[str | None, float] = (None, 0.0)
        hits: dict[int, list[int]] = {}
        for k, unit in enumerate(units):
            for i in {i for w in unit for i in self.owners.get(w, ())}:
                hits.setdefault(i, []).append(k)
        for i, places in sorted(hits.items()):
            name, vector = self.vectors[i]
            before = -1
            for k in places:
                low, room = k, self.longest[i] - len(units[k])
                while low - 1 > before and len(units[low - 1]) <= room:
                    low -= 1
                    room -= len(units[low])
                high, room = k, self.longest[i] - len(units[k])
                while high + 1 < len(units) and len(units[high + 1]) <= room:
                    high += 1
                    room -= len(units[high])
                before = k
                near = {w for unit in units[low : high + 1] for w in unit}
                # A run's cosine is at most the norm of the part of the template that it holds.
                if room < 0 or sum(x * x for w, x in vector.items() if w in near) < self.least**2 - 1e-9:
                    continue
                for start in range(low, k + 1):
                    counts: Counter[str] = Counter()
                    dot = square = 0.0
                    words = 0
                    for stop in range(start, high + 1):
                        words += len(units[stop])
                        if words > self.longest[i]:
                            break
                        for w in units[stop]:
                            x = self.idf.get(w, self.rarest)
                            dot += x * vector.get(w, 0.0)
                            square += (2 * counts[w] + 1) * x * x
                            counts[w] += 1
                        if stop > start and stop >= k and dot / math.sqrt(square) > max(best[1], self.least - 1e-12) and _marked(name, counts) and not _DENIED.search(" ".join(w for u in units[start : stop + 1] for w in u)):
                            best = (name, dot / math.sqrt(square))
        return best

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """The best licence of any unit, its cosine, and whether the whole text is that notice. A tag names a licence by its
        identifier, which counts as a cosine of 1. Of the two BSD licences, which share their notice, the one of two clauses
        holds where the text has the clause of binary forms but not that of names."""
        text = text or ""
        low = text.lower()
        tag = _TAG.search(low)
        tagged = tag and self.names.get(re.sub(r"(?:-only|-or-later|\+)$", "", tag[1]))
        if tagged:
            return tagged, 1.0, _WORD.findall(low)[:3] == ["spdx", "license", "identifier"] and len(low.split("\n")) == 1
        if not self._any.search(low):
            return None, 0.0, False
        best: tuple[str | None, float] = (None, 0.0)
        units = [u for u in _UNIT.split(low) if self._any.search(u)]
        units += [u for u in low.split("\n") if self._any.search(u)]
        for unit in dict.fromkeys(units):
            found = self.score(unit)
            if found[0] and found[1] > best[1]:
                best = found
        found = self.runs([words for u in _UNIT.split(low) if (words := _WORD.findall(u))])
        if found[0] and found[1] > best[1] + 1e-9:
            best = found
        whole = self.score(low)
        if whole[0] and whole[1] > best[1]:
            best = whole
        if best[0] in ("BSD-2-Clause", "BSD-3-Clause") and not re.search(r"bsd[\s-]+[23][\s-]+clause", low):
            best = ("BSD-2-Clause" if "redistributions in binary form" in low and "neither the name" not in low else "BSD-3-Clause", best[1])
        return (*best, whole[0] is not None)


def scan_licenses(df: DataFrame, path_col: str = "path", text_col: str = "text", templates: Mapping[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """df with license, score, via (own, inherited or null) and license_dir (of the licence file that was inherited).

    A licence file is one named LICENSE, COPYING or the like, or whose whole text is a notice; it speaks for its folder
    and all below, unless a nearer folder has one (of several in one folder the highest score, then the first name). A
    null path inherits nothing; null and empty texts have no licence of their own; repeated rows come out alike. Input
    columns named like the new ones are replaced.
    """
    base = without(df, ["license", "score", "via", "license_dir"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        rest = None
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(text_col)]
            rest = batch.drop_columns([text_col])
            yield with_columns(rest, {"__own": pa.array([f[0] for f in found], pa.string()), "__score": pa.array([f[1] if f[0] else 0.0 for f in found], pa.float64()), "__whole": pa.array([f[2] for f in found], pa.bool_())})

    own = base.mapInArrow(scanned, appended(base.drop(text_col), "__own string, __score double, __whole boolean"))
    parts = F.split(path_col, "/")
    name = F.element_at(parts, -1)
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    own = scratch(own.withColumn("__dir", F.when(F.col(path_col).isNotNull(), folder)), "scanned")
    speaks = F.col("__own").isNotNull() & F.col("__dir").isNotNull() & (F.col("__whole") | name.rlike(_FILE))
    first = F.struct(-F.col("__score"), F.col("__own"))
    dirs = own.where(speaks).groupBy(F.col("__dir").alias("license_dir")).agg(F.min(first).alias("f")).select("license_dir", F.col("f.__own").alias("__inherited"), (-F.col("f.col1")).alias("__inherited_score"))
    # Folders, not files, are joined with the folders above them; a folder of many files is one row.
    steps = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(steps, 1, k), "/")))
    folders = own.where(F.col("__own").isNull() & F.col("__dir").isNotNull()).select("__dir").distinct()
    dirs = scratch(dirs, "license-dirs")
    few = dirs.count() <= BROADCAST_DIRS
    climbs = folders.select("__dir", F.explode(F.array_distinct(above)).alias("license_dir")).join(F.broadcast(dirs) if few else dirs, "license_dir")
    nearest = Window.partitionBy("__dir").orderBy(F.desc(F.length("license_dir")))
    heirs = climbs.withColumn("r", F.row_number().over(nearest)).where("r = 1").select("__dir", "license_dir", "__inherited", "__inherited_score")
    heirs = scratch(heirs, "heirs")
    if heirs.count() <= BROADCAST_DIRS:
        met = own.join(F.broadcast(heirs), "__dir", "left")
    else:
        # A folder of many files is spread over tasks; its one row goes to each.
        salted = own.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        met = salted.join(heirs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__dir", "__salt"], "left")
    mine = F.col("__own").isNotNull()
    kept = [F.col(f"`{c}`") for c in base.columns if c != text_col]
    return met.select(
        *kept,
        F.coalesce("__own", "__inherited").alias("license"),
        F.when(mine, F.col("__score")).otherwise(F.coalesce("__inherited_score", F.lit(0.0))).alias("score"),
        F.when(mine, F.lit("own")).when(F.col("__inherited").isNotNull(), F.lit("inherited")).alias("via"),
        F.when(~mine, F.col("license_dir")).alias("license_dir"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its source's folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan_licenses(docs).select("doc_id", "path", "license", "score", "via", "license_dir")
