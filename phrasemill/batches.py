"""Words and n-grams of Arrow batches, by whole columns: nothing here loops over the words of a text.

Texts are cut by a class per byte. What depends on a word alone (lower case, tag) is made once per different word of a
batch; n-grams are numbers there, and strings only once per different n-gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

LETTER, SPACE, MARK, LINE = range(4)
CLASSES = np.zeros(256, np.uint8)
CLASSES[list(b" \t\r\f\x0b")] = SPACE
CLASSES[list(b".,;:!?()")] = MARK
CLASSES[ord("\n")] = LINE
#: Bytes of text that are cut at once, words that are counted at once, and rows that are returned at once.
TEXT, WORDS, ROWS = 4 << 20, 2 << 20, 100_000


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets of the lines in them, text of each line, number of each line in its text). Lines are parted by \\n; a
    punctuation mark is a word of its own, white space parts the others."""
    texts = texts.cast(pa.large_binary())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0] : starts[-1]] if starts[-1] > starts[0] else np.zeros(0, np.uint8)
    starts = starts - starts[0]
    kind = CLASSES[data]
    letter = kind == LETTER
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    own = starts[:-1][starts[:-1] < starts[1:]]
    first[own] = letter[own]  # a text's first letter begins a word, whatever the text before ends with
    first |= kind == MARK
    kept = letter | (kind == MARK)
    at = np.flatnonzero(first)
    packed = data[kept]
    places = np.append((np.cumsum(kept, dtype=np.int64) - 1)[at], len(packed)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(places), pa.py_buffer(packed)])
    ends = np.flatnonzero(kind == LINE)
    before = np.searchsorted(ends, starts)
    lines = np.diff(before) + 1
    head = np.cumsum(lines) - lines
    begin = np.empty(lines.sum(), np.int64)
    rest = np.ones(len(begin), bool)
    rest[head] = False
    begin[head], begin[rest] = starts[:-1], ends + 1
    offsets = np.append(np.searchsorted(at, begin), len(at)).astype(np.int32)
    return words, offsets, np.repeat(np.arange(len(lines)), lines), np.arange(len(begin)) - np.repeat(head, lines)


def sliced(batch: pa.RecordBatch, column: str, most: int = TEXT) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < len(size):
        end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most, "right")))
        yield batch.slice(k, end - k)
        k = end


def lowered(words: pa.Array) -> pa.Array:
    low, others = pc.ascii_lower(words), pc.invert(pc.string_is_ascii(words))
    rest = [w.decode("utf-8", "replace").lower() for w in words.filter(others).cast(pa.binary()).to_pylist()]
    return pc.replace_with_mask(low, pc.fill_null(others, False), pa.array(rest, pa.string())) if rest else low


def lists(batches: Iterator[pa.RecordBatch], attr: str, extra: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(extra..., a) of (doc_id, corpus, text): the surfaces or lemmas of every line."""
    for whole in batches:
        for b in sliced(whole, "text"):
            words, offsets, text, _ = cut(b.column("text"))
            if attr == "lemma":
                coded = words.dictionary_encode()
                words = lowered(coded.dictionary).take(coded.indices)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(text)) for c in extra], pa.ListArray.from_arrays(pa.array(offsets), words)], [*extra, "a"])


def sentences(batches: Iterator[pa.RecordBatch], attrs: tuple[str, ...], tag: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sent, corpus, words) of (doc_id, corpus, text) without null texts."""
    for whole in batches:
        for b in sliced(whole, "text"):
            surface, offsets, text, sent = cut(b.column("text"))
            columns = {"surface": surface}
            if attrs != ("surface",):
                coded = surface.dictionary_encode()
                lemmas = lowered(coded.dictionary)
                columns["lemma"] = lemmas.take(coded.indices)
                if "pos" in attrs:
                    columns["pos"] = pa.array([tag(x) for x in lemmas.to_pylist()], pa.string()).take(coded.indices)
            words = pa.StructArray.from_arrays([columns[a] for a in attrs], list(attrs)) if len(surface) else pa.array([], pa.struct([(a, pa.string()) for a in attrs]))
            out = [b.column("doc_id").take(pa.array(text)), pa.array(sent, pa.int64()), b.column("corpus").take(pa.array(text)), pa.ListArray.from_arrays(pa.array(offsets), words)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "sent", "corpus", "words"])


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = WORDS) -> Iterator[pa.RecordBatch]:
    """Batches put together until their lists in `column` have `most` elements."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b.column(column).flatten())
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Grams:
    """The runs of lo..hi neighbouring words of the lists `a`; lists of different `groups` (a number each) count apart."""

    def __init__(self, a: pa.Array, groups: np.ndarray | None = None):
        self.sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = a.flatten().dictionary_encode(null_encoding="encode")
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.list_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(self.ids))
        self.groups = groups

    def ranks(self, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(n, places at which a run of n words begins, number of the run at each, how many runs differ) for 1..hi."""
        v = max(1, len(self.words))
        code = self.ids if self.groups is None else self.groups[self.list_of] * v + self.ids
        at = np.arange(len(self.ids))
        rank = np.zeros(len(self.ids), np.int64)
        for n in range(1, hi + 1):
            if n > 1:
                at = at[self.left[at] >= n]
                code = rank[at] * v + self.ids[at + n - 1]
            number, different = pd.factorize(code)
            rank[at] = number
            yield n, at, number, len(different)

    def counted(self, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, the first place of each different run, how often it comes)."""
        for n, at, number, size in self.ranks(hi):
            if n >= lo and size:
                first = np.empty(size, np.int64)
                first[number[::-1]] = at[::-1]
                yield n, first, np.bincount(number, minlength=size)

    def word(self, places: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(self.ids[places]))

    def joined(self, first: np.ndarray, n: int, sep: str) -> pa.Array:
        """Runs as strings; undefined words are left out of them."""
        if n == 1:
            return pc.fill_null(self.word(first), "")
        words = [self.word(first + k) for k in range(n)]
        if self.words.null_count:  # Arrow's skipping of nulls loses the rows of nulls only
            return pa.array([sep.join(w for w in x if w is not None) for x in zip(*[w.to_pylist() for w in words], strict=True)], pa.string())
        return pc.binary_join_element_wise(*words, sep)


def grouped(b: pa.RecordBatch, extra: tuple[str, ...]) -> np.ndarray | None:
    """A number per row, the same for rows that are equal in the columns of `extra`."""
    group = None
    for c in extra:
        coded = b.column(c).dictionary_encode(null_encoding="encode")
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group = ids if group is None else pd.factorize(group * max(1, len(coded.dictionary)) + ids)[0]
    return group


def parted(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    b = pa.RecordBatch.from_arrays(columns, names)
    for k in range(0, len(b), ROWS):
        yield b.slice(k, ROWS)


def gram_counts(batches: Iterator[pa.RecordBatch], lo: int, hi: int, sep: str, extra: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(extra..., n, ngram, cnt) of (extra..., a): counts of a run of batches, to be summed up."""
    for b in gathered(batches, "a"):
        g = Grams(b.column("a"), grouped(b, extra))
        for n, first, count in g.counted(lo, hi):
            row = pa.array(g.list_of[first])
            yield from parted([*[b.column(c).take(row) for c in extra], pa.array(np.full(len(first), n, np.int32)), g.joined(first, n, sep), pa.array(count, pa.int64())], [*extra, "n", "ngram", "cnt"])


def word_and_pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, w1, w2, o) of words (w2 null) and of neighbouring words in lists `a`: counts of a run of batches."""
    for b in gathered(batches, "a"):
        g = Grams(b.column("a"))
        for n, first, count in g.counted(1, 2):
            second = g.word(first + 1) if n == 2 else pa.nulls(len(first), pa.string())
            yield from parted([pa.array(np.full(len(first), n, np.int32)), g.word(first), second, pa.array(count, pa.int64())], ["n", "w1", "w2", "o"])
