"""License scans: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemap.llm.rows import send
from telemap.llm.words import LETTERS, Runs, Words, slices, words

#: words in a fingerprint, and fingerprints of which the smallest is kept: a run of
#: GRAM + WINNOW - 1 = 4 words that a text shares with a template always shares one
GRAM, WINNOW = 3, 2
#: templates of fewer words than this file every run of SHORT_GRAM words
SHORT, SHORT_GRAM = 20, 2
#: hits of one copy lie at most so far apart, and its words so far off
BAND = 8
MATCH, MISS, GAP = 2, -1, -1
#: least part of a template that counts as found. A copy that lacks the rest, or has other
#: words in its place, keeps a run of 4 words (of 2 in a short template) and so a fingerprint
COVERAGE = 0.8

# Notices and passages of common licenses.
TEMPLATES = (
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0 header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("MIT notice", "Released under the MIT License."),
    (
        "MIT grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so.",
    ),
    (
        "BSD terms",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met.",
    ),
)


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Places of the smallest value in each run of ``WINNOW``, the last of equal ones; all if there are fewer."""
    if len(grams) <= WINNOW:
        return np.arange(len(grams))
    runs = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
    return np.unique(np.arange(len(runs)) + WINNOW - 1 - runs[:, ::-1].argmin(axis=1))


class Index:
    """Word hashes of the templates, and their fingerprints with where they stand."""

    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.names = [name for name, _ in templates]
        found = words(pa.array([text for _, text in templates]), LETTERS)
        self.words = [found.of(i) for i in range(len(templates))]
        self.parts = {}
        for size, chosen in ((SHORT_GRAM, lambda n: n < SHORT), (GRAM, lambda n: n >= SHORT)):
            prints, template, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, own in enumerate(self.words):
                if len(own) < SHORT_GRAM:
                    raise ValueError(f"a template needs {SHORT_GRAM} words: {self.names[i]}")
                if chosen(len(own)):
                    grams = Runs(own).of(np.arange(len(own) - size + 1), size)
                    at = winnowed(grams) if size == GRAM else np.arange(len(grams))
                    prints.append(grams[at])
                    template.append(np.full(len(at), i))
                    place.append(at)
            order = np.argsort(np.concatenate(prints), kind="stable")
            self.parts[size] = tuple(np.concatenate(x)[order] for x in (prints, template, place))

    def hits(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, places in all words, templates and places in them of all shared fingerprints, by place."""
        out = []
        runs = Runs(found.hashes)
        for size, (prints, template, offset) in self.parts.items():
            starts = np.arange(max(len(found.hashes) - size + 1, 0))
            if not len(starts) or not len(prints):
                continue
            grams = runs.of(starts, size)
            low = np.searchsorted(prints, grams, "left")
            some = np.flatnonzero(prints[np.minimum(low, len(prints) - 1)] == grams)
            row = np.searchsorted(found.ends, some, "right") - 1
            some, row = (x[some + size <= found.ends[row + 1]] for x in (some, row))
            many = np.searchsorted(prints, grams[some], "right") - low[some]
            entry = np.repeat(low[some] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            out.append((np.repeat(row, many), np.repeat(some, many), template[entry], offset[entry]))
        if not out:
            return (np.zeros(0, np.int64),) * 4
        row, place, template, offset = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(place, kind="stable")
        return row[order], place[order], template[order], offset[order]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, list[tuple[int, int]]]:
    """Matched template words and matched stretches of ``text`` in the best local alignment.

    Template word i may stand at ``text[i + shift + d]`` for |d| <= ``band``.
    """
    wide = 2 * band + 1
    score = np.zeros((len(template) + 1, wide), dtype=np.int32)
    came = np.zeros((len(template) + 1, wide), dtype=np.int8)  # 0 start, 1 both, 2 template only, 3 text only
    places = shift - band + np.arange(wide)
    for i, word in enumerate(template):
        at = places + i
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(wide, dtype=bool)
        same[inside] = text[at[inside]] == word
        both = np.where(inside, score[i] + np.where(same, MATCH, MISS), -1)
        down = np.append(score[i][1:] + GAP, -1)  # the template's word has no partner
        best = np.maximum(np.maximum(both, down), 0)
        way = np.where(best == 0, 0, np.where(both >= down, 1, 2))
        for d in range(1, wide):  # a word of the text has no partner
            if best[d - 1] + GAP > best[d]:
                best[d], way[d] = best[d - 1] + GAP, 3
        score[i + 1], came[i + 1] = best, way
    i, d = np.unravel_index(int(score.argmax()), score.shape)
    matched: list[int] = []
    while i > 0 and came[i, d]:
        if came[i, d] == 1:
            at = int(places[d] + i - 1)
            if 0 <= at < len(text) and text[at] == template[i - 1]:
                matched.append(at)
            i -= 1
        elif came[i, d] == 2:
            i, d = i - 1, d + 1
        else:
            d -= 1
    matched.reverse()
    spans: list[tuple[int, int]] = []
    for at in matched:
        if spans and spans[-1][1] == at:
            spans[-1] = (spans[-1][0], at + 1)
        else:
            spans.append((at, at + 1))
    return len(matched), spans


def matches(index: Index, text: np.ndarray, place: np.ndarray, template: np.ndarray, offset: np.ndarray) -> list[dict]:
    """Templates found in one text, given its fingerprint hits in order of place.

    A copy is sought from the earliest start that a hit implies, in a window of one
    template and its band, so every hit costs at most one alignment of bounded size.
    """
    out = []
    for t in np.unique(template).tolist():
        own = index.words[t]
        wanted = COVERAGE * len(own)
        mine = template == t
        order = np.argsort((place - offset)[mine], kind="stable")
        at, shift = place[mine][order], (place - offset)[mine][order]
        open_ = np.ones(len(at), dtype=bool)
        known = np.isin(text, own)
        free = text.copy()  # words that no copy of this template has taken
        first = 0
        while first < len(at):
            if not open_[first]:
                first += 1
                continue
            low = int(shift[first])
            begin, end = max(0, low - BAND), min(len(text), low + len(own) + 3 * BAND)
            found = 0
            if known[begin:end].sum() >= wanted:
                found, spans = align(own, free[begin:end], low + BAND - begin, 2 * BAND)
            if found < wanted:
                first += 1
                continue
            spans = [(begin + a, begin + b) for a, b in spans]
            out.append(
                {
                    "template": index.names[t],
                    "coverage": found / len(own),
                    "spans": [{"start": a, "end": b} for a, b in spans],
                }
            )
            for a, b in spans:
                free[a:b] = 0
                known[a:b] = False
            near = slice(first, int(np.searchsorted(shift, low + len(own) + 4 * BAND, "right")))
            open_[near] &= (at[near] < spans[0][0]) | (at[near] >= spans[-1][1])
    return sorted(out, key=lambda m: (m["spans"][0]["start"], m["template"]))


FOUND = (
    "doc_id long, n_words long, n_candidates long, licenses array<struct<template:string,coverage:double,"
    "spans:array<struct<start:int,end:int>>>>"
)


def scan_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_candidates, licenses``: a row for each row of ``docs``.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered.
    ``licenses`` lists, in order of place, every copy of a template of which at least
    ``COVERAGE`` of the words are matched by a local alignment (match 2, miss and gap
    -1) in a band around its fingerprints, with the matched stretches [start, end) in
    words. ``n_candidates`` counts templates that share a fingerprint. Texts are scanned
    in the tasks that read them; only the templates, an argument of the caller, are
    sent. Null and empty texts have no words and no licenses; repeated rows give equal
    results; an empty table gives an empty one.
    """
    sent = send(docs.sparkSession, Index(templates))
    kind = pa.list_(
        pa.struct(
            {
                "template": pa.string(),
                "coverage": pa.float64(),
                "spans": pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()})),
            }
        )
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent()
        for batch in slices(batches, 1):
            found = words(batch.column(1), LETTERS)
            candidates = np.zeros(len(found), dtype=np.int64)
            licenses: list[list] = [[] for _ in range(len(found))]
            row, place, template, offset = index.hits(found)
            bounds = np.searchsorted(row, np.arange(len(found) + 1))
            for i in np.unique(row).tolist():
                cut = slice(bounds[i], bounds[i + 1])
                candidates[i] = len(np.unique(template[cut]))
                licenses[i] = matches(index, found.of(i), place[cut] - found.ends[i], template[cut], offset[cut])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_words": pa.array(found.counts),
                    "n_candidates": pa.array(candidates),
                    "licenses": pa.array(licenses, kind),
                }
            )

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(scan, FOUND)
