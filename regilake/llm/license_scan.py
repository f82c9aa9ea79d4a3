"""Operator 5: licence scan with a positional index of rare words.

The templates' words are indexed by position. In each text that holds all
words of a template's key phrases, these and the template's words with the
highest inverse document frequency in the corpus are looked up; their
postings, moved by the positions in the text, vote for places
``(template, offset)``, so that a standing key phrase always makes its place a
candidate, whatever else the file holds. At the places with enough votes the mandatory key phrases of the
template must stand, in order, near where the template has them. Fixed
phrases (``BASE``) are found everywhere besides.

Frequencies are counted over all documents in a first pass (what reaches
the driver is one number a template word); the second pass scans the texts
with index and frequencies, both bounded by the templates.

Edge cases: null and empty texts have no words, labels or places and score
0; overlapping and repeated phrases each count; equal rows get equal
results, one row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words_py, needed, ship_package, table

# Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Opening words of common licence texts and notices, and the phrases that tell them apart.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            ("permission to use copy modify", "with or without fee")),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
               ("licensed under the apache license",)),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation", ("under the terms of the gnu general public license",)),
    "gpl-notice": ("this work is licensed under the gnu general public license version 3", ("licensed under the gnu general public license",)),
    "lgpl": ("under the terms of the gnu lesser general public license as published by the free software foundation",
             ("gnu lesser general public license",)),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0",
            ("subject to the terms of the mozilla public license",)),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
}
#: Words of a template looked up in a text besides those of its key phrases, words that a place may be off, and votes that make a place a candidate.
RAREST, SLACK, VOTES = 12, 3, 2


class Index:
    """Templates by word and position, with the weight of each word."""

    def __init__(self, templates: dict, base: dict):
        self.base = [(tuple(p.encode().split()), label) for p, label in base.items()]
        self.words = {name: text.encode().split() for name, (text, _) in templates.items()}
        self.phrases = {}
        for name, (_, phrases) in templates.items():
            found = [(tuple(p.encode().split()), _first(self.words[name], p.encode().split())) for p in phrases]
            if any(at is None for _, at in found):
                raise ValueError(f"a key phrase of {name} isn't in its template")
            self.phrases[name] = found
        self.keys = {name: frozenset(w for p, _ in found for w in p) for name, found in self.phrases.items()}
        self.postings = defaultdict(list)
        for name, words in self.words.items():
            for i, w in enumerate(words):
                self.postings[w].append((name, i))
        #: no text without one of these can have a label: each base phrase's last word, each template's key words
        self.vocabulary = frozenset(self.postings) | {w for p, _ in self.base for w in p}
        self.heads = frozenset(p[0] for p, _ in self.base)


def _first(words: list[bytes], phrase: list[bytes]) -> int | None:
    return next((i for i in range(len(words) - len(phrase) + 1) if words[i:i + len(phrase)] == phrase), None)


def scan(words: list[bytes], index: Index, idf: dict[bytes, float]) -> tuple[int, int | None, int | None, list[str], list[str], float]:
    """(n_base, first_word, last_word, base labels, all labels, score) of one text."""
    present = index.vocabulary.intersection(words)
    if not present:
        return 0, None, None, [], [], 0.0
    at = defaultdict(list)
    for i, w in enumerate(words):
        if w in present:
            at[w].append(i)
    starts, labels, score = [], set(), 0.0
    for phrase, label in index.base:
        if all(w in at for w in phrase):
            rare = min(range(len(phrase)), key=lambda k: len(at[phrase[k]]))
            found = [i - rare for i in at[phrase[rare]] if i >= rare and tuple(words[i - rare:i - rare + len(phrase)]) == phrase]
            starts += found
            if found:
                labels.add(label)
    base = set(labels)
    votes = Counter()
    for name, keys in index.keys.items():
        if not keys <= present:
            continue
        rarest = sorted(present.intersection(index.words[name]), key=lambda w: (-idf.get(w, 0.0), w))[:RAREST]
        for w in keys.union(rarest):
            for i in [i for owner, i in index.postings[w] if owner == name]:
                votes.update([(name, p - i) for p in at[w]])
    for (name, offset), n in votes.items():
        if n >= min(VOTES, len(index.words[name])) and _verified(words, at, index.phrases[name], offset):
            template = index.words[name]
            total = sum(idf.get(w, 0.0) for w in template) or 1.0
            agree = sum(idf.get(w, 0.0) for i, w in enumerate(template) if _near(at.get(w, ()), offset + i))
            labels.add(name)
            score = max(score, agree / total)
    if base:
        score = 1.0
    return (len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), min(score, 1.0))


def _near(places, at: int) -> bool:
    return bisect_left(places, at - SLACK) < bisect_right(places, at + SLACK)


def _verified(words: list[bytes], at: dict, phrases: list, offset: int) -> bool:
    """Whether each phrase stands within SLACK words of its place, one behind the other."""
    after = None
    for phrase, place in phrases:
        low = offset + place - SLACK
        low = max(low, 0) if after is None else max(low, after)
        places = at.get(phrase[0], ())
        hit = next((i for i in places[bisect_left(places, low):bisect_right(places, offset + place + SLACK)]
                    if tuple(words[i:i + len(phrase)]) == phrase), None)
        if hit is None:
            return False
        after = hit + len(phrase)
    return True


def frequencies(docs: DataFrame, index: Index) -> tuple[int, dict[bytes, int]]:
    """(documents, documents with each template word), counted over all documents."""
    words = sorted(index.postings)

    def run(batches):
        total, seen = 0, Counter()
        for b in batches:
            total += b.num_rows
            for t in b.column("text"):
                seen.update(index.vocabulary.intersection(alnum_words_py(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([None, *range(len(words))], pa.int32()),
                                          pa.array([total, *[seen[w] for w in words]], pa.int64())], names=["word", "n"])

    rows = needed(docs, "text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found.get(None, 0), {w: found.get(i, 0) for i, w in enumerate(words)}


def scan_documents(docs: DataFrame, templates: dict | None = None, base: dict | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    ship_package(docs.sparkSession)
    index = Index(TEMPLATES if templates is None else templates, BASE if base is None else base)
    total, seen = frequencies(docs, index)
    idf = {w: math.log((1 + total) / (1 + n)) for w, n in seen.items()}
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text"):
                words = alnum_words_py(t.as_py())
                n, first, last, fixed, labels, score = scan(words, index, idf)
                rows.append((len(words), n, first, last, ",".join(fixed), ",".join(labels), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                                             names=[c.split()[0] for c in schema.split(", ")])

    return needed(docs, "doc_id", "text").mapInArrow(run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
