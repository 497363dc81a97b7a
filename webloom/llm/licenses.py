"""License scans by diagonal voting.

Every run of ``gram`` words of every text is hashed and joined by Spark with the
places where the license templates have that run. A match votes for the diagonal
(place in the text less place in the template) on which the template would lie.
Neighbouring diagonals whose votes follow each other in the text are merged, which
bridges words put in or left out. A merged span is verified word by word: in it the
template's words must come in their order, each place of the template counting once.
Its share is the words covered, divided by the words of the template or of the span,
whichever are more, so words left out and words put in both lower it; it must reach
``min_share``. Relatives share most of their wording, so a span must also hold the
same ``NAMES`` as the template: "Academic", "Affero", "NoDerivatives" or "not" in it, where
the template has none, or one of the template's left out, and it is no span of that
template. Nor is one that "not" or the like precedes by at most ``denied_within`` words.
Where verified spans of several templates overlap, those with the most words
count, so a license does not count as the shorter one that it contains; equal ones all do.

Cases: a null text is empty and has no labels. Repeated rows are scanned each by
itself, as rows and not doc_ids are grouped. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import text as tx

#: Label and phrase whose consecutive words give it.
BASE_PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Label and wording of common license grants and notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    (
        "bsd",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ),
    (
        "apache",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as "
        "published by the Free Software Foundation",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation",
    ),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("afl", "Licensed under the Academic Free License, version 3.0"),
    ("artistic", "Licensed under the Artistic License, version 2.0"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("eupl", "Licensed under the European Union Public Licence, version 1.2"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
)

#: Words, and their other spellings, that tell licenses of like wording apart, denials first.
NAMES = (
    ("not", "never", "isn", "wasn"),
    ("mit",),
    ("apache",),
    ("academic",),
    ("artistic",),
    ("eclipse",),
    ("european",),
    ("mozilla", "mpl"),
    ("affero",),
    ("lesser",),
    ("noncommercial", "commercial", "nc"),
    ("sharealike", "alike", "sa"),
    ("noderivatives", "derivatives", "noderivs", "nd"),
)
_DENIAL = 0


@dataclass(frozen=True)
class LicenseConfig:
    gram: int = 3
    min_share: float = 0.75
    denied_within: int = 2
    #: Diagonals at most this far apart are merged, and so many words may stand between their runs.
    max_shift: int = 3
    templates: tuple[tuple[str, str], ...] = field(default=TEMPLATES)
    #: A library of at most this many runs is broadcast; a larger one is joined by a shuffle.
    broadcast_grams: int = 100_000


_FLAT = "row_id long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, gram long, pos long, name_at array<long>, name array<int>"


def _phrases() -> list[tuple[str, np.ndarray]]:
    block = next(tx.blocks(pa.array([p for _, p in BASE_PHRASES])))
    w = tx.words(block, "alnum")
    return [(label, w.hashes[w.of_text[k] : w.of_text[k + 1]]) for k, (label, _) in enumerate(BASE_PHRASES)]


def _name_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all spellings of ``NAMES``, in order, and the number of each one's name."""
    spelled = [(word, k) for k, words in enumerate(NAMES) for word in words]
    hashes = tx.words(next(tx.blocks(pa.array([word for word, _ in spelled]))), "alnum").hashes
    order = np.argsort(hashes)
    return hashes[order], np.array([k for _, k in spelled])[order]


def _names_in(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of names among words, and which names they are."""
    own, number = table
    at = np.searchsorted(own, hashes)
    at[at == len(own)] = 0
    places = np.flatnonzero(own[at] == hashes)
    return places, number[at[places]]


def template_names(config: LicenseConfig) -> list[frozenset[int]]:
    """The names that each template holds."""
    w, table = tx.words(next(tx.blocks(pa.array([t for _, t in config.templates]), 1 << 62)), "alnum"), _name_table()
    return [frozenset(_names_in(w.hashes[w.of_text[k] : w.of_text[k + 1]], table)[1].tolist()) for k in range(len(config.templates))]


def _scan(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """A row of base figures for each text (gram null), and a row for each run of words."""
    phrases, table = _phrases(), _name_table()
    for batch in batches:
        for block in tx.blocks(batch.column(2)):
            w = tx.words(block, "alnum")
            n = len(block)
            counts = np.diff(w.of_text)
            text_of = np.repeat(np.arange(n), counts)
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set] = [set() for _ in range(n)]
            for label, own in phrases:
                size = len(w.hashes) - len(own) + 1
                if size <= 0:
                    continue
                here = text_of[:size] == text_of[len(own) - 1 :]
                for k, h in enumerate(own):
                    here &= w.hashes[k : k + size] == h
                at = np.flatnonzero(here)
                np.add.at(n_base, text_of[at], 1)
                local = at - w.of_text[text_of[at]]
                np.minimum.at(first, text_of[at], local)
                np.maximum.at(last, text_of[at], local)
                for t in np.unique(text_of[at]):
                    labels[t].add(label)
            none = n_base == 0
            name_at, name = _names_in(w.hashes, table)
            edges = pa.array(np.searchsorted(name_at, w.of_text), pa.int32())
            ids, docs = batch.column(0).slice(block.first, n), batch.column(1).slice(block.first, n)
            rows = [
                ids,
                docs,
                pa.array(counts, pa.int64()),
                pa.array(n_base),
                pa.array(first, pa.int64(), mask=none),
                pa.array(last.astype(np.int64), pa.int64(), mask=none),
                pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()),
                pa.ListArray.from_arrays(edges, pa.array(name_at - w.of_text[text_of[name_at]], pa.int64())),
                pa.ListArray.from_arrays(edges, pa.array(name, pa.int32())),
            ]
            columns = [c.split()[0] for c in _FLAT.split(", ")]
            yield pa.RecordBatch.from_arrays(rows, columns)
            grams = tx.gram_hashes(w.hashes, gram)
            if len(grams):
                at = np.flatnonzero(text_of[: len(grams)] == text_of[gram - 1 :])
                m = len(at)
                owner = ids.to_numpy()[text_of[at]]
                pos = at - w.of_text[text_of[at]]
                rows = [pa.array(owner, pa.int64()), *[pa.nulls(m, pa.int64())] * 5, pa.nulls(m, pa.string()), pa.array(grams[at].view(np.int64)), pa.array(pos, pa.int64())]
                rows += [pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(rows, columns)


def template_grams(config: LicenseConfig) -> list[tuple[int, int, int]]:
    """(gram, template, place) of every run of words of the templates."""
    w = tx.words(next(tx.blocks(pa.array([t for _, t in config.templates]), 1 << 62)), "alnum")
    found = []
    for k in range(len(config.templates)):
        grams = tx.gram_hashes(w.hashes[w.of_text[k] : w.of_text[k + 1]], config.gram)
        found += [(int(g), k, i) for i, g in enumerate(grams.view(np.int64))]
    return found


def verified_spans(matches: list[tuple[int, int]], n_words: int, config: LicenseConfig) -> list[tuple[int, int, int, float]]:
    """Spans (words covered, first word, word after the last, share) of a template of ``n_words``, from places (in the text, in the template) of equal runs.

    The best chain of runs to each run: both places grow, on the same or a neighbouring
    diagonal, with no more than ``max_shift`` words between runs.
    """
    gram = min(config.gram, n_words)
    matches = sorted(matches)
    covered, begin, spans, near = [], [], [], 0
    for i, (pos, place) in enumerate(matches):
        while matches[near][0] < pos - gram - config.max_shift:
            near += 1
        best, start = gram, pos
        for j in range(near, i):
            p, q = matches[j]
            if p < pos and q < place and abs((pos - place) - (p - q)) <= config.max_shift and covered[j] + min(gram, place - q, pos - p) > best:
                best, start = covered[j] + min(gram, place - q, pos - p), begin[j]
        covered.append(best)
        begin.append(start)
        share = best / max(n_words, pos + gram - start)
        if share >= config.min_share:
            spans.append((best, start, pos + gram, share))
    return spans


def same_names(span: tuple[int, int, int, float], wanted: frozenset[int], name_at: list[int], name: list[int], config: LicenseConfig) -> bool:
    """Whether the span holds the names wanted and no others, and is not denied just before."""
    _, start, end, _ = span
    first, last = bisect.bisect_left(name_at, start), bisect.bisect_left(name_at, end)
    before = bisect.bisect_left(name_at, start - config.denied_within)
    return set(name[first:last]) == wanted and _DENIAL not in name[before:first]


def chosen(spans: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Of overlapping spans those that cover the most words."""
    kept: list[tuple] = []
    starts: list[int] = []
    for span in sorted(spans, key=lambda s: (-s[0], -s[3], s[1], s[4])):
        at = bisect.bisect_right(starts, span[1])
        near = kept[max(0, at - 1) : at] + [k for k in kept[at : at + 1] if k[1] < span[2]]
        over = [k for k in near if k[1] < span[2] and span[1] < k[2]]
        if not over:
            kept.insert(at, span)
            starts.insert(at, span[1])
        elif any((k[0], k[1], k[2], k[3]) == span[:4] for k in over) and span not in kept:
            kept.insert(at, span)
            starts.insert(at, span[1])
    return kept


def _verified(batches: Iterator[pa.RecordBatch], config: LicenseConfig, n_words: dict[int, int], wanted: list[frozenset[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        added, scores = [], []
        for base, votes, name_at, name in zip(*[batch.column(c).to_pylist() for c in ("base_labels", "votes", "name_at", "name")], strict=True):
            matches: dict[int, list] = {}
            for v in votes:
                matches.setdefault(v["template"], []).extend((pos, pos - v["diagonal"]) for pos in v["at"])
            verified = [(t, span) for t, own in matches.items() for span in verified_spans(own, n_words[t], config)]
            spans = [(*span, config.templates[t][0]) for t, span in verified if same_names(span, wanted[t], name_at, name, config)]
            found = chosen(spans)
            added.append(",".join(sorted({*filter(None, base.split(",")), *(s[4] for s in found)})))
            scores.append(max((s[3] for s in found), default=0.0))
        kept = [batch.column(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(added, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )


def scan(documents: DataFrame, config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """A row per document row: words, base places, base labels, all labels, and the best verified share of a template."""
    spark: SparkSession = documents.sparkSession
    grams = template_grams(config)
    wanted = template_names(config)
    n_words = {k: sum(1 for g in grams if g[1] == k) + config.gram - 1 for k in range(len(config.templates))}
    library = spark.createDataFrame(grams, "gram long, template int, place long")
    if len(grams) <= config.broadcast_grams:
        library = F.broadcast(library)
    flat = documents.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda it: _scan(it, config.gram), _FLAT
    )
    base = F.when(F.col("gram").isNull(), F.struct("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "name_at", "name"))
    # base rows meet no run; they are dealt by their own number, so that not all go to one task
    dealt = flat.withColumn("key", F.coalesce("gram", F.xxhash64("row_id")))
    matched = dealt.join(library.withColumnRenamed("gram", "own"), (F.col("key") == F.col("own")) & F.col("pos").isNotNull(), "left")
    matched = matched.where(F.col("pos").isNull() | F.col("template").isNotNull())
    votes = (
        matched.withColumn("base", base)
        .groupBy("row_id", "template", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.max("base").alias("base"), F.collect_list("pos").alias("at"))  # no more than the template has words
    )
    per_row = votes.groupBy("row_id").agg(
        F.max("base").alias("base"),
        F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "at"))).alias("votes"),
    )
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return per_row.select("base.*", "votes").mapInArrow(lambda it: _verified(it, config, n_words, wanted), schema)
