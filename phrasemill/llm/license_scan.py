"""License scans by an exact set-similarity join of text blocks with templates.

A block is a sliding window: for a notice as many consecutive words, wherever lines end, as the template has, divided by
its threshold; so a notice is found over several lines, and words scattered over a long line aren't one. Phrases are looked
for in lines, extended by as many following words as the longest phrase has besides its first. A template is found in a
block that has at least its threshold's share of the template's distinct words. Words are ordered by their frequency in all texts, rarest first. A template of n words
that needs m of them must share one of its first n - m + 1 with the block (prefix filter); a block with fewer than m
words is out (length filter); and a first common word too late in either order leaves too few behind it (positional
filter). What is left is verified on the words themselves. Phrases are templates that need all their words; their places
are the ones where their words stand consecutively.

Texts are split into words by numpy over bytes. Only templates, a parameter, and the frequencies of their words are sent
to the workers.

Defined results: null counts as empty, with no words; null doc_ids and repeated rows are scanned like others; an empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.bpe import parts_of
from phrasemill.llm.common import prepare


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8


PHRASES = (Template("cc-by", "cc by", 1), Template("gpl", "general public license", 1), Template("reserved", "all rights reserved", 1))
NOTICES = (
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by", "Licensed under CC BY 4.0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", 0.9),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", 0.9),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
_MASK = np.array([(1 << (8 * n)) - 1 if n < 8 else 2**64 - 1 for n in range(9)], dtype=np.uint64)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in lower-cased UTF-8."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def keys_of(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word, from its length, first and last eight bytes; equal words have equal keys."""
    padded = bytes(8) + data + bytes(8)
    at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    n = ends - starts
    first = at[starts + 8] & _MASK[np.minimum(n, 8)]
    last = np.where(n > 8, at[ends], np.uint64(0))
    return first * np.uint64(0x9E3779B97F4A7C15) + last * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64) * np.uint64(0x165667B19E3779F9)


def plain_words(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    s, e = words_of(data)
    return [data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


class Batch:
    """The words of several texts in flat arrays."""

    def __init__(self, texts: list[str | None]) -> None:
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(parts).translate(_LOWER)
        self.text_starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
        self.starts, self.ends = words_of(self.data)
        self.first = np.searchsorted(self.starts, self.text_starts)  # of each text, its first word
        self.breaks = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)

    def keys(self) -> np.ndarray:
        return keys_of(self.data, self.starts, self.ends)


class Join:
    """Templates with their words in the global order."""

    def __init__(self, templates: tuple[Template, ...], n_phrases: int, freq: dict[bytes, int]) -> None:
        self.templates, self.n_phrases = templates, n_phrases
        self.words = [plain_words(t.text) for t in templates]
        vocab = sorted({w for ws in self.words for w in ws}, key=lambda w: (freq.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(vocab)}
        self.sets = [sorted({self.rank[w] for w in ws}) for ws in self.words]
        self.need = [max(1, math.ceil(t.threshold * len(s) - 1e-9)) for t, s in zip(templates, self.sets, strict=True)]
        self.index: dict[int, list[int]] = {}
        for k, (s, m) in enumerate(zip(self.sets, self.need, strict=True)):
            for r in s[: len(s) - m + 1]:
                self.index.setdefault(r, []).append(k)
        prefix = sorted(self.index)
        keys = vocab_keys([vocab[r] for r in prefix])
        order = np.argsort(keys)
        self.prefix_keys, self.prefix_words = keys[order], [vocab[prefix[k]] for k in order]
        self.widths = [math.ceil(len(w) / t.threshold - 1e-9) for t, w in zip(templates, self.words, strict=True)]
        self.lap = max([len(w) for w in self.words[:n_phrases]] + [1]) - 1

    def scan(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each text."""
        b = Batch(texts)
        keys = b.keys()
        at = np.minimum(np.searchsorted(self.prefix_keys, keys), len(self.prefix_keys) - 1)
        hits = np.flatnonzero(self.prefix_keys[at] == keys)
        text_of = np.searchsorted(b.first, hits, side="right") - 1
        line_of = np.searchsorted(b.breaks, b.starts[hits])
        n_words = np.diff(b.first)
        found: dict[int, tuple[set, set, set, float]] = {}
        # (block's first word, its end, the text): what shares a prefix word, with the templates of that word
        blocks: dict[tuple[int, int, int], set[int]] = {}
        # (the text, a notice): stretches of words in which all its windows with a prefix word lie
        stretches: dict[tuple[int, int], list[list[int]]] = {}
        for k, h in enumerate(hits.tolist()):
            w = self.prefix_words[at[h]]
            if b.data[b.starts[h] : b.ends[h]] != w:
                continue
            t, line = int(text_of[k]), int(line_of[k])
            lo, hi = int(b.first[t]), int(b.first[t + 1])
            for c in self.index[self.rank[w]]:
                if c < self.n_phrases:
                    continue
                a, e = max(lo, int(h) - self.widths[c] + 1), min(hi, int(h) + self.widths[c])
                own = stretches.setdefault((t, c), [])
                if own and a <= own[-1][1]:
                    own[-1][1] = e
                else:
                    own.append([a, e])
            seen = -1
            for back in range(self.lap + 1):  # its own line, and those that reach it
                p = h - back
                if p < lo:
                    break
                q = line if not back else int(np.searchsorted(b.breaks, b.starts[p]))
                if q == seen:
                    continue
                seen = q
                a = max(lo, int(np.searchsorted(b.starts, b.breaks[q - 1]))) if q else lo
                e = min(hi, int(np.searchsorted(b.starts, b.breaks[q]))) if q < len(b.breaks) else hi
                if own := [c for c in self.index[self.rank[w]] if c < self.n_phrases]:
                    blocks.setdefault((a, e, t), set()).update(own)
        for (a, e, t), candidates in blocks.items():
            hi = min(int(b.first[t + 1]), e + self.lap)
            ws = [b.data[b.starts[k] : b.ends[k]] for k in range(a, hi)]
            mine = sorted({self.rank[w] for w in ws if w in self.rank})  # once for all candidates
            for c in candidates:
                if len(ws) < self.need[c] or _overlap(self.sets[c], mine, self.need[c]) < self.need[c]:
                    continue
                x = self.words[c]
                here = [a + k - int(b.first[t]) for k in range(e - a) if ws[k : k + len(x)] == x]
                if not here:
                    continue
                base, labels, places, score = found.setdefault(t, (set(), set(), set(), [0.0]))
                base.add(self.templates[c].label), places.update((c, k) for k in here)
                labels.add(self.templates[c].label)
                score[0] = 1.0
        for (t, c), own in stretches.items():
            overlap = max(self._best([b.data[b.starts[k] : b.ends[k]] for k in range(a, e)], c) for a, e in own)
            if overlap >= self.need[c]:
                _, labels, _, score = found.setdefault(t, (set(), set(), set(), [0.0]))
                labels.add(self.templates[c].label)
                score[0] = max(score[0], overlap / len(self.sets[c]))
        for t in range(len(texts)):
            base, labels, places, score = found.get(t, ((), (), (), [0.0]))
            at_ = [k for _, k in places]
            yield int(n_words[t]), len(at_), min(at_, default=None), max(at_, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score[0]

    def _best(self, words: list[bytes], c: int) -> int:
        """The most distinct words of template c in a window of the words."""
        mine, width = set(self.words[c]), self.widths[c]
        at = [(k, w) for k, w in enumerate(words) if w in mine]
        if len(at) < self.need[c]:
            return 0
        count: dict[bytes, int] = {}
        best = first = 0
        for k, w in at:
            count[w] = count.get(w, 0) + 1
            while at[first][0] <= k - width:
                x = at[first][1]
                count[x] -= 1
                if not count[x]:
                    del count[x]
                first += 1
            best = max(best, len(count))
        return best


def vocab_keys(words: list[bytes]) -> np.ndarray:
    data = b" ".join(words)
    s, e = words_of(data)
    return keys_of(data, s, e)


def _overlap(x: list[int], y: list[int], need: int) -> int:
    """Common elements of two sorted lists, or 0 once they can't be `need`."""
    i = j = n = 0
    while i < len(x) and j < len(y):
        if n + min(len(x) - i, len(y) - j) < need:
            return 0
        if x[i] == y[j]:
            n, i, j = n + 1, i + 1, j + 1
        elif x[i] < y[j]:
            i += 1
        else:
            j += 1
    return n


def frequencies(docs: DataFrame, words: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each of the words comes in all texts; one row per word reaches the driver."""
    prepare(docs.sparkSession)
    keys = vocab_keys(words)
    order = np.argsort(keys)
    sorted_keys = keys[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), dtype=np.int64)
        for x in batches:
            for _, texts in parts_of(x.column(0), 4_000_000):
                k = Batch(texts).keys()
                at = np.minimum(np.searchsorted(sorted_keys, k), len(words) - 1)
                total += np.bincount(at[sorted_keys[at] == k], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(total)], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[r["word"]]: r["n"] for r in rows}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    score: the largest share of a found template's words that a block or window has (1 for phrases), 0 if nothing is found.
    """
    templates = (*phrases, *notices)
    freq = frequencies(docs, sorted({w for t in templates for w in plain_words(t.text)}), text_col)
    join = Join(templates, len(phrases), freq)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in parts_of(b.column(1), 4_000_000):
                cols = list(zip(*join.scan(texts), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
