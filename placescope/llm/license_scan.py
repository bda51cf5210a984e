r"""Operator 10: license scans by an exact set-similarity join of text blocks with license templates.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became lower case. A block is a line, or, for
notices wrapped over lines, a window of as many words as the template has, anywhere in the text. A block
holds a template if at least ``CONTAINMENT`` of the template's distinct words are among its own. Words
are ordered by how many lines and texts of the whole corpus hold them, rarest first. Prefix, length and
positional filters then leave few pairs of texts and templates, and lose none; only these are searched
by lines and windows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescope.llm.arrow import narrow

CONTAINMENT = 0.85

# Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as licenses word them.
TEMPLATES = {
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}

_OTHER = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Lower case, and a space for every byte that is in no word.
_WORD_BYTES = bytes(b if b not in _OTHER else ord(chr(b).lower()) if 65 <= b <= 90 else 32 for b in range(256))
#: The same but for line ends.
_LINE_BYTES = bytes(10 if b == 10 else c for b, c in enumerate(_WORD_BYTES))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass
class Templates:
    """Templates ready for the join under one order of words."""

    rank: dict[bytes, int]
    sets: list[tuple[str, tuple[int, ...], int]] = field(default_factory=list)  # label, ranks ascending, overlap needed
    sizes: list[int] = field(default_factory=list)  # words of the template, repeated ones too
    index: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # rank in a prefix -> (template, place)
    least: int = 1 << 30

    @classmethod
    def build(cls, templates: dict[str, tuple[str, ...]], frequency: dict[bytes, int], containment: float) -> Templates:
        vocabulary = sorted({w for group in templates.values() for t in group for w in words(t)}, key=lambda w: (frequency.get(w, 0), w))
        out = cls({w: k for k, w in enumerate(vocabulary)})
        for label, group in sorted(templates.items()):
            for t in group:
                ranks = tuple(sorted({out.rank[w] for w in words(t)}))
                need = max(1, math.ceil(containment * len(ranks) - 1e-9))
                for place, r in enumerate(ranks[: len(ranks) - need + 1]):
                    out.index.setdefault(r, []).append((len(out.sets), place))
                out.sets.append((label, ranks, need))
                out.sizes.append(len(words(t)))
                out.least = min(out.least, need)
        return out

    def matches(self, block: set[bytes]) -> dict[str, float]:
        """Labels of all templates that the block holds, with the share of the template found."""
        return self.labels(self.held(block))

    def labels(self, held: dict[int, float]) -> dict[str, float]:
        """Labels of held templates with their shares.

        Of two templates one of which has all words of the other, that with the greater share counts, and the
        larger one if they are equal: a plain CC BY notice holds most words of the CC BY-NC one, but not NC.
        """
        found: dict[str, float] = {}
        sets = {k: set(self.sets[k][1]) for k in held}
        for k, share in held.items():
            if not any((sets[k] < sets[o] and x >= share) or (sets[o] < sets[k] and x > share) for o, x in held.items()):
                label = self.sets[k][0]
                found[label] = max(found.get(label, 0.0), share)
        return found

    def held(self, block: set[bytes]) -> dict[int, float]:
        """All templates that the block holds, with the share of the template found."""
        ranks = sorted(self.rank[w] for w in block if w in self.rank)
        size, seen, held = len(ranks), set(), {}
        if size < self.least:
            return held
        own = set(ranks)
        for j, r in enumerate(ranks[: size - self.least + 1]):
            for k, place in self.index.get(r, ()):
                label, template, need = self.sets[k]
                # The first common word of both orders: what may follow bounds the overlap.
                if k in seen or size < need or 1 + min(len(template) - place - 1, size - j - 1) < need:
                    continue
                seen.add(k)
                overlap = sum(x in own for x in template)
                if overlap >= need:
                    held[k] = overlap / len(template)
        return held

    def windows(self, ws: list[bytes], wanted: Iterable[int]) -> Iterator[dict[int, float]]:
        """What the windows of a text hold of the wanted templates: one row of shares for each run of overlapping windows."""
        at = [(i, r) for i, r in enumerate(map(self.rank.get, ws)) if r is not None]
        hits = []  # first word, place behind the last, template, share
        for k in wanted:
            _, template, need = self.sets[k]
            own, counts, first = set(template), Counter(), 0
            places = [(i, r) for i, r in at if r in own]
            for i, r in places:
                counts[r] += 1
                while places[first][0] <= i - self.sizes[k]:
                    gone = places[first][1]
                    counts[gone] -= 1
                    if not counts[gone]:
                        del counts[gone]
                    first += 1
                if len(counts) >= need:
                    hits.append((places[first][0], i + 1, k, len(counts) / len(template)))
        held: dict[int, float] = {}
        reach = 0
        for low, high, k, share in sorted(hits):
            if held and low >= reach:
                yield held
                held = {}
            held[k] = max(held.get(k, 0.0), share)
            reach = max(reach, high)
        if held:
            yield held


def block_frequencies(docs: DataFrame, templates: dict[str, tuple[str, ...]], id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """Number of lines and whole texts of the corpus that hold each template word; as many rows as template words."""
    vocabulary = {w for group in templates.values() for t in group for w in words(t)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                whole: set[bytes] = set()
                for line in (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LINE_BYTES).split(b"\n"):
                    found = vocabulary.intersection(line.split())
                    counts.update(found)
                    whole |= found
                counts.update(whole)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = narrow(docs, id_col, text_col).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Phrase places and labels of every whole text.

    A null text is empty: no words, no labels (empty strings), null places, score 0. ``score`` is 1 where
    a phrase stands, else the largest share of a template that a block holds. Rows with equal or null ids
    are scanned one by one; other columns are ignored; an empty table gives no rows. Templates and
    phrases are the caller's and small; they travel with the tasks.
    """
    ready = Templates.build(templates, block_frequencies(docs, templates, id_col, text_col), containment)
    sought = [(words(p), label) for p, label in sorted(phrases.items())]
    keys = {p[-1] for p, _ in sought}

    def one(text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        ws = raw.translate(_WORD_BYTES).split()
        distinct = set(ws)
        places, base = [], set()
        if not keys.isdisjoint(distinct):
            for phrase, label in sought:
                if not distinct.issuperset(phrase):
                    continue
                size, at = len(phrase), -1
                while True:
                    try:
                        at = ws.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if ws[at : at + size] == phrase:
                        places.append(at)
                        base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        likely = ready.held(distinct)
        if likely:
            found = [ready.matches(set(line.split())) for line in raw.translate(_LINE_BYTES).split(b"\n")]
            for block in (*found, *map(ready.labels, ready.windows(ws, likely))):
                for label, share in block.items():
                    labels.add(label)
                    score = max(score, share)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(ws), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(one(t.as_py() or "") for t in batch.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return narrow(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
