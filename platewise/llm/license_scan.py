"""Licence scans: an exact set-similarity join of text blocks with licence templates, beside places of fixed phrases.

A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z. A **block** is a run of
``width`` words of one document; blocks begin every ``width // 2`` words, so each passage of up to
``width // 2`` words stands whole in one of them. Templates longer than that are cut into equal passages. A block
meets a template when it holds at least ``least`` of the template's distinct words (containment).

The join is exact. The words of all templates are counted over all documents and put in order, rarest first;
each template is entered under its prefix only, the words of which any qualifying block must hold one.
A block and a template whose first shared word is in that prefix meet the length filter (a block with
too few template words can't qualify) and the positional filter (the words that come after the shared one in both
orders bound the overlap); what is left is counted. Templates are an argument of the caller, at most
``MOST_TEMPLATES``, so their index is broadcast; texts are neither shuffled nor collected.

Defined cases: null and empty texts have no words and no labels; very long texts are scanned whole; repeated rows
and rows without an id are scanned like any other; an empty table gives an empty result; columns of the input that have the
name of an added column are replaced; without templates only the phrases count; a label that is found in many blocks is one label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.columns import carried, schema_of
from platewise.llm.text_arrays import blocks, released, row_starts, span_hash, word_spans

# The phrases of the base rule.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Sentences by which works state their licence, and well-known sentences of public licences.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

MOST_TEMPLATES = 10_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of words as they are (A-Z lower-cased), all others as a space.
_TO_WORDS = np.full(256, 32, np.uint8)
for _first, _last in ((48, 57), (97, 122), (128, 255)):
    _TO_WORDS[_first : _last + 1] = np.arange(_first, _last + 1)
_TO_WORDS[65:91] = np.arange(97, 123)

ADDED = ("ls_words", "ls_places", "ls_first", "ls_last", "ls_phrases", "ls_matches", "ls_labels", "ls_score")
MATCH = "struct<label: string, template: int, first_word: bigint, containment: double>"
_MATCH = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("containment", pa.float64())])


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_UPPER_TO_LOWER))


def passages(templates: Sequence[tuple[str, str]], width: int) -> list[tuple[str, list[str]]]:
    """(label, words) of each template; one of more than half a block is cut into equal passages."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    out = []
    for label, text in templates:
        words = words_of(text)
        pieces = math.ceil(len(words) / (width // 2))
        out += [(label, words[i * len(words) // pieces : (i + 1) * len(words) // pieces]) for i in range(pieces)]
    return out


def needed(size: int, least: float) -> int:
    """How many of ``size`` distinct words a block must hold."""
    return max(1, math.ceil(least * size - 1e-9))


@dataclass
class Index:
    """The words of templates and phrases, the ordered templates and the postings of their prefixes."""

    tokens: list[bytes]  # by rank: rarest first
    templates: list[np.ndarray]  # ranks of each template's words, ascending
    labels: list[str]
    required: np.ndarray
    phrases: list[tuple[list[int], str]]
    width: int

    def __post_init__(self) -> None:
        joined = b" ".join(self.tokens) + b" "
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in self.tokens]) - 1
        starts = ends - np.array([len(t) for t in self.tokens])
        hashes = span_hash(data, starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        longest = max(len(t) for t in self.tokens)
        self.sizes = np.array([len(t) for t in self.tokens])
        self.bytes = np.zeros((len(self.tokens), longest), np.uint8)
        for i, t in enumerate(self.tokens):
            self.bytes[i, : len(t)] = np.frombuffer(t, np.uint8)
        lists: list[list[tuple[int, int]]] = [[] for _ in self.tokens]
        for t, ranks in enumerate(self.templates):
            for place, rank in enumerate(ranks[: len(ranks) - self.required[t] + 1]):
                lists[rank].append((t, place))
        self.postings = np.array([p for x in lists for p in x], np.int64).reshape(-1, 2)
        self.posting_at = np.cumsum([0, *map(len, lists)])
        self.template_sizes = np.array([len(t) for t in self.templates], np.int64)

    def ranks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for those of no template; what the hashes call equal is confirmed by bytes."""
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(ends - starts <= self.bytes.shape[1])
        if not len(short):
            return out
        hashes = span_hash(data, starts[short], ends[short])
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[near] == hashes
        at, rank = short[hit], self.order[near[hit]]
        size = ends[at] - starts[at]
        same = size == self.sizes[rank]
        padded = np.append(data, np.zeros(self.bytes.shape[1], np.uint8))
        for k in range(self.bytes.shape[1]):
            same &= (k >= size) | (padded[starts[at] + k] == self.bytes[rank, k])
        out[at[same]] = rank[same]
        return out


def build_index(templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], counts: dict[str, int], least: float, width: int) -> Index:
    """Order all words by ``counts``, rarest first, and enter the prefixes of the templates."""
    cut = passages(templates, width)
    cut = [(label, words) for label, words in cut if words]
    spoken = [(words_of(p), label) for p, label in phrases]
    vocabulary = sorted({w for _, ws in cut for w in ws} | {w for ws, _ in spoken for w in ws}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    sets = [np.array(sorted({rank[w] for w in ws}), np.int64) for _, ws in cut]
    required = np.array([needed(len(s), least) for s in sets], np.int64)
    return Index([w.encode() for w in vocabulary], sets, [label for label, _ in cut], required, [([rank[w] for w in ws], label) for ws, label in spoken], width)


def phrase_places(index: Index, rank: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, place among all words) wherever a phrase's words stand consecutively in one row."""
    numbers, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, (ranks, _) in enumerate(index.phrases):
        last = len(rank) - len(ranks) + 1
        if last <= 0:
            continue
        here = rows[:last] == rows[len(ranks) - 1 :]
        for k, r in enumerate(ranks):
            here &= rank[k : last + k] == r
        found = np.flatnonzero(here)
        numbers.append(np.full(len(found), number)), places.append(found)
    return np.concatenate(numbers), np.concatenate(places)


def meeting_blocks(index: Index, rank: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, template, overlap) of each block that meets a template; ``place`` is the word's number in its row."""
    none = np.zeros(0, np.int64)
    step = index.width // 2
    known = np.flatnonzero(rank >= 0)
    if not len(known) or not index.templates:
        return none, none, none, none
    rank, row, block = rank[known], row[known], place[known] // step
    many = int(block.max()) + 2
    # a word stands in the block that begins in its half block and in the one before
    key = np.concatenate([row * many + block, (row * many + block - 1)[block > 0]])
    words = np.concatenate([rank, rank[block > 0]])
    entered = np.diff(index.posting_at) > 0
    open_ = np.unique(key[entered[words]])  # blocks that hold a word of some prefix
    inside = open_[np.minimum(np.searchsorted(open_, key), max(len(open_) - 1, 0))] == key if len(open_) else np.zeros(len(key), bool)
    tokens = len(index.tokens)
    held = np.unique(key[inside] * tokens + words[inside])
    key, words = held // tokens, held % tokens
    begin = np.searchsorted(key, open_)
    size = np.diff(np.append(begin, len(key)))
    owner = np.repeat(np.arange(len(open_)), size)
    n = np.diff(index.posting_at)[words]
    pick = np.repeat(index.posting_at[words], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    template, in_template = index.postings[pick].T if len(pick) else (none, none)
    at = np.repeat(np.arange(len(words)), n)
    block, in_block = owner[at], at - begin[owner[at]]
    _, first = np.unique(block * len(index.templates) + template, return_index=True)  # the first shared word of each pair
    block, template, in_block, in_template = block[first], template[first], in_block[first], in_template[first]
    bound = np.minimum(size[block] - in_block, index.template_sizes[template] - in_template)  # the shared word and what follows it
    keep = (size[block] >= index.required[template]) & (bound >= index.required[template])
    block, template = block[keep], template[keep]
    shared = np.zeros(len(block), np.int64)
    for t in np.unique(template):
        of = np.flatnonzero(template == t)
        for w in index.templates[t]:
            probe = open_[block[of]] * tokens + w
            shared[of] += held[np.minimum(np.searchsorted(held, probe), len(held) - 1)] == probe
    keep = shared >= index.required[template]
    block, template, shared = block[keep], template[keep], shared[keep]
    return open_[block] // many, open_[block] % many * step, template, shared


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = _TO_WORDS[data]
    return data, *word_spans(data, offsets)


def _frequencies(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.tokens), np.int64)
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                data, starts, ends, rows = _words(data, offsets)
                rank = index.ranks(data, starts, ends)
                seen = np.unique(rows[rank >= 0] * len(total) + rank[rank >= 0])
                total += np.bincount(seen % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in index.tokens]), pa.array(total)], ["token", "n"])

    return released(run)


def _scan(index: Index, names: list[str]):
    labels = np.array(index.labels, dtype=object)
    spoken = [label for _, label in index.phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                n = b - a
                data, starts, ends, rows = _words(data, offsets)
                begin = row_starts(rows, n)
                rank = index.ranks(data, starts, ends)
                place = np.arange(len(rows)) - begin[rows]
                phrase, at = phrase_places(index, rank, rows)
                count = np.bincount(rows[at], minlength=n)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(first, rows[at], place[at])
                np.maximum.at(last, rows[at], place[at])
                told: dict[int, set[str]] = {}
                for p, r in zip(phrase, rows[at], strict=True):
                    told.setdefault(int(r), set()).add(spoken[p])
                row, word, template, shared = meeting_blocks(index, rank, rows, place)
                by = np.lexsort((template, word, row))
                row, word, template, shared = row[by], word[by], template[by], shared[by]
                part = shared / np.maximum(index.template_sizes[template], 1) if len(template) else np.zeros(0)
                match = pa.StructArray.from_arrays(
                    [pa.array(labels[template] if len(template) else [], pa.string()), pa.array(template, pa.int32()), pa.array(word, pa.int64()), pa.array(part, pa.float64())],
                    fields=list(_MATCH),
                )
                out = [c.slice(a, n) for c in batch.columns[1:]]
                absent = count == 0
                out += [pa.array(np.diff(begin)), pa.array(count), pa.array(first, mask=absent), pa.array(last, mask=absent)]
                out.append(pa.array([sorted(told.get(r, ())) for r in range(n)], pa.list_(pa.string())))
                out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), match))
                yield pa.RecordBatch.from_arrays(out, names)

    return released(run)


def word_counts(docs: DataFrame, index: Index, text: str = "text") -> dict[str, int]:
    """In how many documents each word of the index stands; one row a word comes to the driver."""
    parts = docs.select(F.col(text).alias("ls_text")).mapInArrow(_frequencies(index), "token string, n long")
    return {r.token: r.n for r in parts.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, least: float = 0.9, width: int = 64, text: str = "text"
) -> DataFrame:
    """All columns of ``docs`` but the text, with words, phrase places, the matching blocks, all labels and a score.

    ``ls_matches`` has the label, template, first word and containment of each block that meets a template. The score is
    1 where a phrase stands, else the highest containment among the matches, else 0.
    """
    if not phrases and not templates:
        raise ValueError("neither templates nor phrases are given")
    index = build_index(templates, phrases, {}, least, width)
    index = build_index(templates, phrases, word_counts(docs, index, text), least, width)
    rest = carried(docs, ADDED, text)
    inner = [f"c{i}" for i in range(len(rest))]
    schema = ", ".join([*schema_of(docs, rest), "ls_words long", "ls_places long", "ls_first long", "ls_last long", "ls_phrases array<string>", f"ls_matches array<{MATCH}>"])
    picked = docs.select(F.col(text).alias("ls_text"), *(F.col(c).alias(n) for n, c in zip(inner, rest, strict=True)))
    out = picked.mapInArrow(_scan(index, [*inner, *ADDED[:6]]), schema).toDF(*rest, *ADDED[:6])
    out = out.withColumn("ls_labels", F.array_sort(F.array_distinct(F.concat("ls_phrases", F.transform("ls_matches", lambda m: m["label"])))))
    best = F.array_max(F.transform("ls_matches", lambda m: m["containment"]))
    return out.withColumn("ls_score", F.when(F.col("ls_places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))))
