"""Licence scan: sparse TF-IDF cosine of text segments to licence templates, then inheritance from the nearest ancestor
directory that holds a licence file.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import cut, table, text_or_empty

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version."
)
#: Notices as their publishers word them; a licence may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal public domain dedication."),
    ("proprietary", "All rights reserved."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("GPL-3.0", _GNU.format("GNU General Public License", "3")),
    ("GPL-2.0", _GNU.format("GNU General Public License", "2")),
    ("LGPL-3.0", _GNU.format("GNU Lesser General Public License", "3")),
    ("LGPL-2.1", _GNU.format("GNU Lesser General Public License", "2.1")),
    ("GPL", "it under the terms of the GNU General Public License as published by"),
    ("LGPL", "it under the terms of the GNU Lesser General Public License as published by"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org MPL 2.0"),
    *((n, f"SPDX-License-Identifier: {n}") for n in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")),
)
#: Whole licence files, against which whole documents are scored.
FULL_TEXTS: tuple[tuple[str, str], ...] = tuple(
    (f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(files("queuelens.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name)
)
THRESHOLD = 0.75
#: A document in which licence segments hold this share of the words is a licence file, as is one with such a name.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice)(\.|$)"
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Ends of sentences: a digit after the stop goes on ("v. 2.0").
_STOP = re.compile(r"[.!?;]\s+(?![0-9\s])")
#: Distinct words whose counts a task holds before it sends them on.
HELD_WORDS = 500_000
VOCABULARY = sorted({w for _, t in TEMPLATES for w in _WORD.findall(t.lower())})
FULL_VOCABULARY = sorted({w for _, t in FULL_TEXTS for w in _WORD.findall(t.lower())})


@dataclass(frozen=True)
class Matcher:
    """Template vectors of unit length, weights of their words and of words that no text holds, the words without which
    no segment can reach the threshold, and the templates that hold each word."""

    weight: dict[str, float]
    other: float
    templates: tuple[dict[str, float], ...]
    keys: frozenset[str]
    holders: dict[str, list[int]]

    @classmethod
    def of(cls, documents: int, holding: dict[str, int], threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Matcher:
        vocabulary = sorted({w for _, t in templates for w in _WORD.findall(t.lower())})
        idf = {w: math.log((documents + 1) / (holding.get(w, 0) + 1)) + 1 for w in vocabulary}
        vectors = []
        for _, t in templates:
            v = {w: n * idf[w] for w, n in Counter(_WORD.findall(t.lower())).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            vectors.append({w: x / norm for w, x in v.items()})
        keys: set[str] = set()
        # By Cauchy-Schwarz a segment without the keys scores at most the norm of the rest of a template.
        for v in vectors:
            for w in sorted(v, key=lambda w: (-idf[w], w)):
                if math.sqrt(sum(x * x for u, x in v.items() if u not in keys)) < threshold - 1e-9:
                    break
                keys.add(w)
        holders = {w: [i for i, v in enumerate(vectors) if w in v] for w in vocabulary}
        return cls(idf, math.log(documents + 1) + 1, tuple(vectors), frozenset(keys), holders)

    def best(self, words: list[str]) -> tuple[float, int]:
        """The highest cosine and its template, the first of equal ones."""
        counts = Counter(words)
        norm = math.sqrt(sum((n * self.weight.get(w, self.other)) ** 2 for w, n in counts.items()))
        own = {w: n * self.weight[w] for w, n in counts.items() if w in self.weight}
        scores = [sum(x * v[w] for w, x in own.items() if w in v) for v in self.templates]
        at = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return (scores[at] / norm if norm else 0.0), at

    def near(self, words: set[str], threshold: float) -> bool:
        """Whether some template's part in these words has the norm without which none reaches the threshold."""
        squares = [0.0] * len(self.templates)
        for w in words:
            for t in self.holders.get(w, ()):
                squares[t] += self.templates[t][w] ** 2
        return max(squares) >= (threshold - 1e-9) ** 2

    def windows(self, words: list[str], begin: int, end: int, threshold: float) -> Iterator[tuple[int, int, int, float, float, dict[str, int]]]:
        """(begin, end, template, dot product, square of the norm of the templates' words, counts of other words) of the
        words that can reach the threshold: each template's first to last word in them, as what stands before and after
        adds to the norm alone. No word weighs less than 1, so that with 1 for the other words the cosine is a bound."""
        places: dict[int, list[int]] = {}
        for p in range(begin, end):
            for t in self.holders.get(words[p], ()):
                places.setdefault(t, []).append(p)
        for t, at in places.items():
            v = self.templates[t]
            if math.sqrt(sum(v[w] ** 2 for w in {words[p] for p in at})) < threshold - 1e-9:
                continue
            counts = Counter(words[at[0] : at[-1] + 1])
            dot = sum(n * self.weight[w] * v[w] for w, n in counts.items() if w in v)
            square = sum((n * self.weight[w]) ** 2 for w, n in counts.items() if w in self.weight)
            others = {w: n for w, n in counts.items() if w not in self.weight}
            if dot >= (threshold - 1e-9) * math.sqrt(square + sum(n * n for n in others.values())):
                yield at[0], at[-1] + 1, t, dot, square, others


def _segments(text: str, keys: re.Pattern) -> Iterator[tuple[int, int]]:
    """Begin and end of lines, of paragraphs of several lines, and of the sentences in both, that hold a key."""
    for mark in ("\n", "\n\n"):
        begin = -1
        for m in keys.finditer(text):
            if m.start() < begin:
                continue
            start = text.rfind(mark, 0, m.start())
            end = text.find(mark, m.end())
            start, begin = (0 if start < 0 else start + len(mark)), (len(text) if end < 0 else end)
            if mark == "\n" or "\n" in text[start:begin].strip("\n"):
                yield start, begin
                cuts = [start, *(s.end() for s in _STOP.finditer(text, start, begin)), begin]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b - a < begin - start and keys.search(text, a, b):
                        yield a, b


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each word; all texts under the empty word."""
    seen: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(1).to_pylist():
            seen.update({"", *_WORD.findall(text.lower())})
            if len(seen) > HELD_WORDS:
                yield counted()
                seen.clear()
    yield counted()


SCANNED = "doc_id long, path string, n_words long, found array<struct<first: long, last: long, template: int, dot: double, square: double, words: array<struct<word: string, n: long>>>>"


def _scan(matcher: Matcher, full: Matcher, threshold: float):
    keys = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(matcher.keys))) + r")(?![a-z0-9])")
    kind = pa.list_(
        pa.struct(
            [("first", pa.int64()), ("last", pa.int64()), ("template", pa.int32()), ("dot", pa.float64()), ("square", pa.float64()), ("words", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))]
        )
    )
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1).to_pylist():
                low, windows = text.lower(), {}
                words = _WORD.findall(low)
                if keys.search(low):
                    starts = [m.start() for m in _WORD.finditer(low)]
                    for a, b in _segments(low, keys):
                        for w in matcher.windows(words, bisect_left(starts, a), bisect_left(starts, b), threshold):
                            windows[w[:3]] = w
                if not full.keys.isdisjoint(words) and full.near(set(words), threshold):
                    for w in full.windows(words, 0, len(words), threshold):
                        windows[w[0], w[1], w[2] + len(TEMPLATES)] = (*w[:2], w[2] + len(TEMPLATES), *w[3:])
                sizes.append(len(words))
                found.append([dict(zip(names, (*w[:5], [{"word": x, "n": n} for x, n in w[5].items()]), strict=True)) for w in windows.values()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(found, kind)], names=["doc_id", "path", "n_words", "found"])

    return run


def scan_licenses(docs: DataFrame, path: Column, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, path, own_license, own_score, license, from_dir: the licence that a text itself states, or else that of
    the nearest directory above it that has a licence file; null where neither is found.

    Document frequencies of all words come from all texts. Lines, paragraphs and sentences are scored against notices,
    whole texts against licence files, from a template's first word in them to its last. A version-less notice gives
    "GPL" or "LGPL". A file is known by the share of words in any of its matching segments. Of several licence files in a directory the one with the highest score, then the
    least licence and id counts; ties of templates go to the first. Texts of any length are read whole. Null text counts as empty; null ids and repeated rows are kept; a null path has no
    directories; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), path.cast("string").alias("path"))
    counts = cut(rows.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    held = {r.word: r.n for r in counts.where(F.col("word").isin("", *VOCABULARY, *FULL_VOCABULARY)).collect()}
    texts = held.pop("", 0)
    scanned = cut(rows.mapInArrow(_scan(Matcher.of(texts, held, threshold), Matcher.of(texts, held, threshold, FULL_TEXTS), threshold), SCANNED).withColumn("row", F.monotonically_increasing_id()))
    found = scanned.select("row", "doc_id", "path", "n_words", F.posexplode("found").alias("at", "f")).select("row", "at", "n_words", "f.*")
    # The other words' weights come from the counts of all texts, joined to the words of segments that can still match.
    idf = F.log((F.lit(texts) + 1) / (F.coalesce("texts", F.lit(0)) + 1)) + 1
    words = found.select("row", "at", F.explode("words").alias("w")).select("row", "at", "w.word", F.col("w.n").alias("times"))
    words = words.join(counts.select("word", F.col("n").alias("texts")), "word", "left").groupBy("row", "at").agg(F.sum((F.col("times") * idf) ** 2).alias("more"))
    score = F.col("dot") / F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))
    matched = found.join(words, ["row", "at"], "left").withColumn("score", F.round(score, 9)).where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("s"), "template")).alias("best")
    # Words in any of the matching segments, each counted once.
    covered = F.expr(
        "aggregate(sort_array(collect_list(struct(first, last))), struct(0L as upto, 0L as n), "
        "(a, x) -> struct(greatest(a.upto, x.last) as upto, a.n + greatest(0L, x.last - greatest(a.upto, x.first)) as n), a -> a.n)"
    )
    matched = matched.groupBy("row").agg(best, (covered / F.max("n_words")).alias("share"))
    license_of = F.element_at(F.array(*[F.lit(n) for n, _ in TEMPLATES + FULL_TEXTS]), F.col("best.template") + 1)
    own = scanned.join(matched, "row", "left").select("doc_id", "path", F.when(F.col("best").isNotNull(), license_of).alias("own_license"), (-F.col("best.s")).alias("own_score"), F.coalesce("share", F.lit(0.0)).alias("share"))
    own = cut(own)
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    file = F.col("own_license").isNotNull() & ((F.col("share") >= FILE_SHARE) | F.element_at(parts, -1).rlike(FILE_NAME))
    first = F.min(F.struct((-F.col("own_score")).alias("s"), "own_license", "doc_id")).alias("first")
    folders = own.where(file & F.col("path").isNotNull()).groupBy(folder.alias("dir")).agg(first).select("dir", F.col("first.own_license").alias("dir_license"))
    # Each path that needs a licence meets the directories above it; the deepest one counts. Paths repeat less than rows.
    bare = own.where("own_license is null and path is not null").select(folder.alias("at")).distinct()
    up = bare.withColumn("p", F.split("at", "/")).select("at", F.explode(F.expr("transform(sequence(0, size(p)), i -> array_join(slice(p, 1, i), '/'))")).alias("dir")).distinct()
    nearest = up.join(folders, "dir").groupBy("at").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_license")).alias("up")).select("at", "up.dir", "up.dir_license")
    out = own.withColumn("at", F.when(F.col("own_license").isNull(), folder)).join(nearest, "at", "left")
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.col("dir").alias("from_dir"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, license and score of what the text itself states, and apart from it the licence of the nearest
    directory with a licence file, and that directory. Documents have no paths of their own: source and language count as
    directories, the id as the file's name, so an inherited licence is a hint and never the document's own."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    found = scan_licenses(table(spark, sf_dir, "documents"), path)
    inherited = F.when(F.col("own_license").isNull(), F.col("license"))
    return found.select("doc_id", "path", F.col("own_license").alias("license"), F.col("own_score").alias("score"), inherited.alias("inherited_license"), "from_dir")
