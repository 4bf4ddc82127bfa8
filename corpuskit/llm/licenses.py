"""License scans by a positional index of rare licence words.

A first pass counts in how many files each word of the templates stands; from that every word has its IDF. The index
holds the places of words in the templates: of a short template (a phrase) all its words, of a long one (the opening of
a notice) those of highest IDF. In a file the rarest word of a template is looked up first; without it a phrase is not
there. Each occurrence at file place p of a word at template place t speaks for a start at p - t. A phrase stands where
all its words do so for one start; a notice where most of its rare words do for starts that differ by a few words, and
every mandatory key phrase stands, word for word, in the text that it covers.

Words: A-Z in lower case, then runs of letters and digits of ASCII and of all bytes beyond it.

Defined results: a null text has no words, no places, empty labels and score 0; texts are never cut; repeated rows
give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import lean

#: What a word is, over UTF-8 bytes: bytes from 0x80 on belong to words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a long template that are indexed: its rarest; the share of them that must agree; the words by which a
#: place may have moved.
RARE, AGREE, DRIFT = 12, 0.6, 4

# Phrases and their labels.
PHRASES = {
    "mit": "mit license",
    "apache": "apache license",
    "gpl": "general public license",
}

# Openings of public licence notices, by label, with the phrases that each must have.
NOTICES = {
    "apache-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
        ("licensed under the apache license version 2 0", "except in compliance with the license"),
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "the following conditions are met"),
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version",
        ("under the terms of the gnu general public license", "free software foundation"),
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted"),
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    "mpl-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("subject to the terms of the mozilla public license",),
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software released into the public domain",),
    ),
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    chosen: tuple[int, ...]
    base: bool


def words_of(text: str) -> tuple[bytes, ...]:
    return tuple(WORD.findall(text.encode().lower()))


def vocabulary(phrases: dict[str, str] | None = None, notices: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> set[bytes]:
    """The words of all templates."""
    texts = [*(PHRASES if phrases is None else phrases).values(), *(text for text, _ in (NOTICES if notices is None else notices).values())]
    return {w for text in texts for w in words_of(text)}


class Index:
    """Templates, the IDF of their words, and the places of the chosen ones. Words that no count names are rarest."""

    def __init__(self, idf: dict[bytes, float] | None = None, phrases: dict[str, str] | None = None, notices: dict[str, tuple[str, tuple[str, ...]]] | None = None, rare: int = RARE):
        self.idf = idf or {}
        weight = lambda w: self.idf.get(w, math.inf)
        raw = [(label, words_of(text), (), True) for label, text in (PHRASES if phrases is None else phrases).items()]
        raw += [(label, words_of(text), tuple(map(words_of, keys)), False) for label, (text, keys) in (NOTICES if notices is None else notices).items()]
        self.templates = []
        for label, words, keys, base in raw:
            by_idf = sorted(range(len(words)), key=lambda i: (-weight(words[i]), words[i], i))
            self.templates.append(Template(label, words, keys, tuple(by_idf if base else by_idf[:rare]), base))
        self.indexed = frozenset(t.words[i] for t in self.templates for i in t.chosen)

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        """``n_words, n_base, first_word, last_word, base_labels, labels, score`` of a text."""
        words = WORD.findall(text.lower())
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.indexed:
                at[w].append(i)
        base: dict[str, list[int]] = {}
        found: dict[str, float] = {}
        for t in self.templates if at else ():
            if t.base:
                places = self._phrase(t, at)
                if places:
                    base.setdefault(t.label, []).extend(places)
                    found[t.label] = 1.0
            elif (share := self._notice(t, at, words)) > 0:
                found[t.label] = max(share, found.get(t.label, 0.0))
        places = [p for some in base.values() for p in some]
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), max(found.values(), default=0.0)

    @staticmethod
    def _phrase(t: Template, at: dict[bytes, list[int]]) -> list[int]:
        """Starts on which all words agree, the rarest word first."""
        starts: set[int] | None = None
        for i in t.chosen:
            here = {p - i for p in at.get(t.words[i], ())}
            starts = here if starts is None else starts & here
            if not starts:
                return []
        return [s for s in starts or () if s >= 0]

    @staticmethod
    def _notice(t: Template, at: dict[bytes, list[int]], words: list[bytes]) -> float:
        """The largest share of the template's rare words near one start, of starts with all the key phrases; else 0."""
        if sum(t.words[i] in at for i in t.chosen) < AGREE * len(t.chosen):
            return 0.0
        votes: dict[int, set[int]] = defaultdict(set)
        for i in t.chosen:
            for p in at.get(t.words[i], ()):
                votes[p - i].add(i)
        best = 0.0
        for start in votes:
            share = len(set().union(*(votes.get(start + d, ()) for d in range(-DRIFT, DRIFT + 1)))) / len(t.chosen)
            if share > best and share >= AGREE:
                part = words[max(0, start - DRIFT) : start + len(t.words) + 2 * DRIFT]
                if all(_holds(part, key) for key in t.keys):
                    best = share
        return best


def _holds(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    n = len(phrase)
    return any(words[i] == phrase[0] and tuple(words[i : i + n]) == phrase for i in range(len(words) - n + 1))


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def document_frequencies(docs: DataFrame, words: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of files, and in how many of them each of ``words`` stands. Each task counts its files; what meets is
    a row a word and task, and the driver gets a row a word of the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                n += 1
                counts.update(words.intersection(WORD.findall((text.as_py() or "").encode().lower())))
        yield pa.RecordBatch.from_arrays([pa.array([*counts, b""], pa.binary()), pa.array([*counts.values(), n], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.word): r.n for r in rows}
    return found.pop(b"", 0), found


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """One row a document: what the index finds in its text. The index is a few kilobytes and goes with the task."""
    n, counts = document_frequencies(docs, vocabulary(phrases, notices))
    index = Index({w: math.log((n + 1) / c) for w, c in counts.items()}, phrases, notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [index.scan((text.as_py() or "").encode()) for text in batch.column(1)]
            columns = [batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES[1:], strict=True))] if rows else [pa.array([], t) for t in _TYPES]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lean(run), _SCHEMA)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
