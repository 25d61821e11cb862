"""Licence scans: units of normalised text against licence templates by the Dice coefficient of word bigrams.

Units are the lines of a document, the document as a whole and windows of its
words. A unit and a template are alike if their sets of word bigrams have a Dice
coefficient of at least `THRESHOLD`. That bounds the size a unit may have for a
template, so lines and documents meet only templates whose admissible sizes
include theirs: a join on the size.

Windows find notices that are wrapped over lines or embedded in longer ones.
They run over the normalised words of the whole text, at every place and in
every length up to the largest admissible size; a window begins and ends with a
bigram of the template, since others at its ends only lower the coefficient. A
text is searched for a template only where enough of the template's bigrams lie
close together, which every alike window needs. Of overlapping windows the best
counts. One that overlaps an alike line or document is the same notice: it can
raise the coefficient and does not count again.

Templates are a table (license, text); `TEMPLATES` is the default, and
`PASSAGES` are added to it for windows: stretches of the full licence texts.

Defined cases: null and empty texts and units without words match nothing; a
unit of one word has that word as its only bigram, and a template of one word
has no windows; a document that repeats a
licence is one row with the number of its units; documents without match give
no row; rows that repeat an id count together; further columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

THRESHOLD = 0.8
MAX_TEMPLATES = 2000    # up to this many the table of templates is broadcast

# Names and wordings of common licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("All-Rights-Reserved", "All rights reserved."),
)

# Stretches of full texts that hold none of the notices above, or much more than one.
PASSAGES = (
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-3-Clause-text", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0-text", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("GPL-3.0-text", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """The set of word bigrams; of a single word, the word."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, words).otherwise(F.array_distinct(pairs))


class _Windows:
    """Finds the windows of a text that are alike to templates; lives in one task."""

    def __init__(self, templates: list[tuple[str, list[str]]], least: float):
        self.least = least
        self.templates = []
        holders: dict[tuple[str, str], list[int]] = {}
        for license, words in templates:
            pairs = set(zip(words, words[1:]))
            if not pairs:
                continue
            low = math.ceil(len(pairs) * least / (2 - least) - 1e-9)
            high = math.floor(len(pairs) * (2 - least) / least + 1e-9)
            for pair in pairs:
                holders.setdefault(pair, []).append(len(self.templates))
            self.templates.append((license, pairs, max(1, low), high))
        self.number = {w: i for i, w in enumerate(sorted({w for pair in holders for w in pair}), 1)}
        codes = sorted((self.number[a] * (len(self.number) + 1) + self.number[b], held) for (a, b), held in holders.items())
        self.codes = np.array([c for c, _ in codes], dtype=np.int64)
        self.holders = [held for _, held in codes]

    def found(self, text: str) -> Iterator[tuple[str, float, int]]:
        """(license, best coefficient, windows that are no line's or document's) of each licence found."""
        words = re.findall("[a-z0-9]+", text.lower())
        if len(words) < 2 or not self.holders:
            return
        ids = np.fromiter(map(self.number.get, words, itertools.repeat(0)), dtype=np.int64, count=len(words))
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        codes = ids[at] * (len(self.number) + 1) + ids[at + 1]
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[place] == codes
        at, place = at[known], place[known]
        common = Counter(t for p in np.unique(place).tolist() for t in self.holders[p])
        ends = None
        for t, n in sorted(common.items()):
            license, pairs, low, high = self.templates[t]
            if n < low:
                continue
            mine = [p for p, held in enumerate(self.holders) if t in held]
            alike = self._alike(words, at[np.isin(place, mine)], pairs, low, high)
            if not alike:
                continue
            if ends is None:
                lines = text.split("\n")
                ends = list(itertools.accumulate(len(re.findall("[a-z0-9]+", line.lower())) for line in lines))
            units = self._alike_units(words, ends, alike, pairs, high)
            taken: list[tuple[int, int]] = []
            for _, first, last in alike:
                k = bisect_right(taken, (first, last))
                before = k > 0 and taken[k - 1][1] >= first
                if not before and not (k < len(taken) and taken[k][0] <= last) and not any(a <= last and first < b for a, b in units(first, last)):
                    taken.insert(k, (first, last))
            yield license, alike[0][0], len(taken)

    def _alike(self, words: list[str], hits: np.ndarray, pairs: set, low: int, high: int) -> list[tuple[float, int, int]]:
        """(coefficient, first word, last word) of the best window from each start, best first."""
        m, out = len(pairs), []
        # Starts that have enough of the template's bigrams within reach.
        reach = np.searchsorted(hits, hits + high)
        for i, k in zip(hits.tolist(), (reach - np.arange(len(hits))).tolist()):
            if k < low:
                continue
            seen, shared, best = set(), 0, (0.0, 0, 0)
            for j in range(i, min(i + high, len(words) - 1)):
                pair = words[j], words[j + 1]
                if pair in seen:
                    continue
                seen.add(pair)
                if pair in pairs:
                    shared += 1
                    dice = 2.0 * shared / (len(seen) + m)
                    if dice > best[0]:
                        best = (dice, i, j + 1)
            if best[0] >= self.least:
                out.append(best)
        return sorted(out, key=lambda w: (-w[0], w[1]))

    def _alike_units(self, words: list[str], ends: list[int], alike: list, pairs: set, high: int):
        """A function of a window: the spans [a, b) of alike lines, or of the alike document, that it may overlap."""
        known: dict[int, bool] = {}

        def is_alike(a: int, b: int) -> bool:
            seen = set()
            for j in range(a, b - 1):
                seen.add((words[j], words[j + 1]))
                if len(seen) > high:
                    return False
            return 2.0 * len(seen & pairs) / (len(seen) + len(pairs)) >= self.least

        if is_alike(0, len(words)):
            return lambda first, last: [(0, len(words))]

        def lines(first: int, last: int) -> list[tuple[int, int]]:
            out = []
            for k in range(bisect_right(ends, first), bisect_right(ends, last) + 1):
                a, b = ends[k - 1] if k else 0, ends[k]
                if k not in known:
                    known[k] = is_alike(a, b)
                if known[k]:
                    out.append((a, b))
            return out

        return lines


def windows(documents: DataFrame, templates: list[tuple[str, str]], least: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n): the alike windows of each row's text."""
    split = [(license, re.findall("[a-z0-9]+", text.lower())) for license, text in templates]
    id_field = documents.schema["doc_id"]
    schema = StructType([StructField("doc_id", id_field.dataType)]).add("license", "string").add("dice", "double").add("n", "long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Windows(split, least)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1)):
                for hit in scanner.found(text.as_py()):
                    rows.append(i)
                    found.append(hit)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()),
            ], names=["doc_id", "license", "dice", "n"])

    return documents.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(search, schema)


def scan(documents: DataFrame, templates: DataFrame | None = None, least: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_units): the best coefficient and the number of alike units per document and licence."""
    passages = PASSAGES if templates is None else ()
    templates = templates if templates is not None else default_templates(documents.sparkSession)
    known = templates.where("text IS NOT NULL").select("license", bigrams(F.split(normalised(F.col("text")), " ")).alias("_t"))
    known = known.where(F.size("_t") > 0).withColumn("_m", F.size("_t"))
    low = F.ceil(F.col("_m") * F.lit(least / (2 - least)) - 1e-9)
    high = F.floor(F.col("_m") * F.lit((2 - least) / least) + 1e-9)
    sized = known.withColumn("_n", F.explode(F.sequence(F.greatest(low, F.lit(1)), high).cast("array<int>")))
    widest = known.agg(F.max(high).alias("w"), F.count("*").alias("n")).first()
    # Words a unit can have: repeated bigrams make it longer than its set, so only the set is bounded above.
    lines = F.filter(F.split("text", "\n"), lambda r: r != "")
    texts = documents.where("text IS NOT NULL").select("doc_id", "text", lines.alias("_l"))
    units = texts.select("doc_id", F.explode(F.when(F.size("_l") > 1, F.concat("_l", F.array("text"))).otherwise(F.col("_l"))).alias("_u"))
    # Words and bigrams come out of generators: the filters on them are then not pushed below, which would compute both again per use.
    words = units.select("doc_id", F.explode(F.array(F.split(normalised(F.col("_u")), " "))).alias("_w"))
    rows = words.select("doc_id", F.explode(F.array(bigrams(F.col("_w")))).alias("_b"))
    rows = rows.withColumn("_n", F.size("_b")).where((F.col("_n") <= F.lit(widest["w"] or 0)) & (F.get("_b", F.lit(0)) != ""))
    small = F.broadcast(sized) if widest["n"] <= MAX_TEMPLATES else sized
    both = F.size(F.array_intersect("_b", "_t"))
    met = rows.join(small, "_n").withColumn("dice", 2.0 * both / (F.col("_n") + F.col("_m"))).where(F.col("dice") >= least)
    # A table of licences is small, whatever the documents: windows take it by closure.
    listed = [(r["license"], r["text"]) for r in templates.where("text IS NOT NULL").select("license", "text").collect()]
    inside = windows(documents, [*listed, *passages], least)
    every = met.select("doc_id", "license", "dice", F.lit(1).cast("long").alias("n")).unionAll(inside)
    return every.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.sum("n").alias("n_units"))
