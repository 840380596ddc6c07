"""License scans by the rarest words of phrases and the places of templates' words.

The words of all templates and phrases form a small vocabulary.  One pass counts in how many documents
each of them stands; a second finds every phrase of each file by the phrase's own word of highest
inverse document frequency, at every place.  A mandatory key phrase names as candidates all relative
positions (place in the file less place in the template) at which its template may stand around it; one
counts if enough of the template's words stand at their places.  So a template is found whatever else
the file holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.tables import raw_texts, slices, text_only
from keysift.llm.words import alnum_words

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, text that names or grants the license, and its mandatory key phrases.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     ["apache license version 2 0"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify and or distribute"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc0", "dedicated to the public domain under cc0 1 0", ["cc0 1 0"]),
]

# The part of a template's words that must stand at their places.
LEAST_PART = 0.7
# Words by which a key phrase may stand outside its template's place.
SLACK = 3

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "found array<struct<label: string, start: long, part: double>>"
)


class Index:
    """Templates and phrases as word sequences, and numbers of their words."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str, list[str]]]):
        self.phrases = [(self.cut(p), label) for p, label in phrases.items()]
        self.templates = [(label, self.cut(text), [self.cut(k) for k in keys]) for label, text, keys in templates]
        sequences = [p for p, _ in self.phrases] + [s for _, words, keys in self.templates for s in (words, *keys)]
        self.numbers = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.size = len(self.numbers) + 1

    @staticmethod
    def cut(text: str) -> list[bytes]:
        return alnum_words(text.encode())

    def number(self, words: list[bytes]) -> np.ndarray:
        """Numbers of license words; 0 for all others."""
        get = self.numbers.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def document_frequencies(docs: DataFrame, index: Index) -> tuple[int, dict[int, int]]:
    """Number of documents, and of those that hold each license word; at most the vocabulary's size reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(index.size, np.int64)
        for part in slices(batches):
            for raw in raw_texts(part):
                total[1:] += np.bincount(index.number(alnum_words(raw)), minlength=index.size)[1:] > 0
            total[0] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(index.size)), pa.array(total)], names=["word", "n"])

    counted = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {r["word"]: r["n"] for r in counted}
    return by_word.get(0, 0), {w: n for w, n in by_word.items() if w}


class Scanner:
    def __init__(self, index: Index, n_docs: int, frequency: dict[int, int]):
        self.index = index
        self.idf = np.array([0.0] + [math.log((n_docs + 1) / (frequency.get(i, 0) + 1)) for i in range(1, index.size)])
        self.phrases = [(self._anchored(words), label) for words, label in index.phrases]
        self.templates = [
            (label, np.array([index.numbers[w] for w in words]), [self._anchored(k) for k in keys]) for label, words, keys in index.templates
        ]
        # A candidate needs a key phrase, so a file without the rarest word of any phrase is done.
        anchors = {numbers[at] for (numbers, at), _ in self.phrases} | {numbers[at] for _, _, keys in self.templates for numbers, at in keys}
        self.anchor = np.zeros(index.size, bool)
        self.anchor[list(anchors)] = True

    def _anchored(self, words: list[bytes]) -> tuple[list[int], int]:
        """Numbers of a sequence, and the place of its rarest word."""
        numbers = [self.index.numbers[w] for w in words]
        return numbers, int(np.argmax(self.idf[numbers]))

    @staticmethod
    def _places(numbers: np.ndarray, sequence: tuple[list[int], int]) -> np.ndarray:
        """All starts of a sequence: places of its rarest word that the other words' relative positions confirm."""
        wanted, at = sequence
        starts = np.flatnonzero(numbers == wanted[at]) - at
        starts = starts[(starts >= 0) & (starts + len(wanted) <= len(numbers))]
        for shift, word in enumerate(wanted):
            starts = starts[numbers[starts + shift] == word]
        return starts

    def _standing(self, numbers: np.ndarray, wanted: np.ndarray, keys: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
        """Starts around a key phrase at which enough of a template's words stand, and their part."""
        size = len(wanted)
        around = [np.add.outer(self._places(numbers, key) - SLACK, np.arange(len(key[0]) - size, 2 * SLACK + 1)).ravel() for key in keys]
        starts = np.unique(np.concatenate([np.zeros(0, np.int64), *around]))
        if not len(starts):
            return starts, np.zeros(0)
        padded = np.pad(numbers, size + SLACK)
        hits = sum((padded[starts + size + SLACK + place] == word).astype(np.int64) for place, word in enumerate(wanted.tolist()))
        enough = hits / size >= LEAST_PART
        return starts[enough], hits[enough] / size

    def scan(self, words: list[bytes]) -> tuple:
        numbers = self.index.number(words)
        if not self.anchor[numbers].any():
            return len(words), 0, None, None, "", "", 0.0, []
        base = [(start, label, len(p[0])) for p, label in self.phrases for start in self._places(numbers, p).tolist()]
        found = [(label, start, 1.0) for start, label, _ in base]
        for label, wanted, keys in self.templates:
            starts, parts = self._standing(numbers, wanted, keys)
            found += [(label, start, part) for start, part in zip(starts.tolist(), parts.tolist())]
        starts = [start for start, _, _ in base]
        base_labels = ",".join(sorted({label for _, label, _ in base}))
        labels = ",".join(sorted({label for label, _, _ in found}))
        best = max((part for _, _, part in found), default=0.0)
        return len(words), len(base), min(starts, default=None), max(starts, default=None), base_labels, labels, best, sorted(set(found))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """Licenses that each document names or grants.

    Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII.  One row per
    document: ``n_base`` places where a phrase's words stand in a row, the first and last of them
    (null without any), ``base_labels`` of the phrases, ``labels`` of phrases and templates (both
    distinct, sorted, joined by commas), ``score`` (best part of a template's words at their places;
    1 for a phrase, 0 for nothing) and ``found``.

    Null and empty texts have no words and no labels.  Repeated rows give repeated results and count as documents; other columns are not read.
    """
    index = Index(phrases, templates)
    texts = text_only(docs)
    n_docs, frequency = document_frequencies(texts, index)
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
    kinds.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("part", pa.float64())])))
    names = [column.split()[0] for column in SCHEMA.split(", ")[:8]] + ["found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(index, n_docs, frequency)
        for part in slices(batches):
            rows = [scanner.scan(alnum_words(raw)) for raw in raw_texts(part)]
            columns = [list(c) for c in zip(*rows)]
            columns[7] = [[{"label": label, "start": start, "part": share} for label, start, share in found] for found in columns[7]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return texts.mapInArrow(run, SCHEMA)
