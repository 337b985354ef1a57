"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array with the word of each. A round looks every adjacent pair up in the
sorted array of pair keys by binary search, takes each word's lowest-ranked pair, and merges it at all its places,
leftmost first. Rounds go on until no word has a pair with a rank. A round costs as much as all letters that are left, so
words of over `LONG` letters, which may need as many rounds as they have letters, are merged one by one with a heap of
pairs instead, in the same order. Words come from whole texts by the tokenizer's own
normaliser and pattern; each distinct word of a batch is merged once, and a bounded memory of words spans batches.

Defined results: null counts as empty; an empty text has no ids and decodes to nothing; strings of added tokens become
those tokens; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import prepare

MEMORY = 300_000
LONG = 1000  # letters; longer pieces aren't kept in the memory either, which bounds its bytes
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends (tokenizers' JSON): lower case, white space dropped."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = np.array([vocab[a] for a, _ in pairs], dtype=np.int64), np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        rank = np.arange(len(keys))
        new = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # of repeated pairs the first has the rank
        order = np.lexsort((rank, keys))
        first = np.r_[True, keys[order][1:] != keys[order][:-1]]
        self.keys, self.rank, self.new = keys[order][first], rank[order][first], new[order][first]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memory: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}
        self.names = [str(i) for i in range(size)]
        self.table: dict[int, tuple[int, int]] | None = None  # made when a long word comes

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: short ones merged in rounds over all of them, long ones with a heap each."""
        long = {k: self.merge_long(w) for k, w in enumerate(words) if len(w) > LONG}
        if long:
            short = iter(self._rounds([w for k, w in enumerate(words) if k not in long]))
            return [long[k] if k in long else next(short) for k in range(len(words))]
        return self._rounds(words)

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of a word in n log n steps: a linked list of symbols, and a heap of (rank, place) of adjacent pairs."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.new.tolist(), strict=True), strict=True))
        table = self.table
        flat = np.frombuffer(word, np.uint8)
        symbol = self.inner[flat]
        symbol[-1] = self.last[flat[-1]]
        symbols = symbol.tolist()
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], k, m[1], a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (m := table.get((a << 32) | b))]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != a or j < 0 or symbols[j] != b:
                continue  # one of them was merged
            symbols[k], symbols[j] = new, -1
            after[k] = z = after[j]
            if z >= 0:
                before[z] = k
                if m := table.get((new << 32) | symbols[z]):
                    heapq.heappush(heap, (m[0], k, m[1], new, symbols[z]))
            p = before[k]
            if p >= 0 and (m := table.get((symbols[p] << 32) | new)):
                heapq.heappush(heap, (m[0], p, m[1], symbols[p], new))
        return [x for x in symbols if x >= 0]

    def _rounds(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        word = np.repeat(np.arange(len(words)), lengths)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends[lengths > 0]] = self.last[flat[ends[lengths > 0]]]
        done_word, done_symbol = [], []
        top = np.int64(len(self.keys))
        none = np.iinfo(np.int64).max
        while len(symbols):
            pair = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), top - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.rank[at], none)
            best = np.full(len(words), none)
            np.minimum.at(best, word[:-1], rank)
            open_ = best[word] != none
            done_word.append(word[~open_]), done_symbol.append(symbols[~open_])
            hit = np.flatnonzero((rank != none) & (rank == best[word[:-1]]))
            if not len(hit):
                break
            # equal overlapping pairs ("aaa"): every second place of a run, from its left
            run = np.r_[True, np.diff(hit) != 1]
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            symbols = symbols.copy()
            symbols[hit] = self.new[at[hit]]
            open_[hit + 1] = False
            symbols, word = symbols[open_], word[open_]
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        flat_ids = symbols[order].tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def chunks(self, text: str) -> list[str]:
        """The text in pieces without white space, each coded by itself; added tokens are pieces with a space in front."""
        if self.split_added and "<|" in text and self.split_added.search(text):
            out: list[str] = []
            for k, part in enumerate(self.split_added.split(text)):
                out += [" " + part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            # letter by letter, so a final sigma is not special
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [x for x in _SPACE.split(text) if x] if _ODD.search(text) else text.split()

    def learn(self, chunks: set[str]) -> dict[str, tuple[str, str, int]]:
        """Put chunks into the memory: (ids as text, tokens as text, number of ids). Two generations and the length of what
        is kept bound it. Long chunks are returned instead."""
        todo, own_ = [], {}
        if len(self.memory) > MEMORY:
            self.older, self.memory = self.memory, {}
        for c in chunks.difference(self.memory):
            if (known := self.older.get(c)) is None:
                todo.append(c)
            else:
                self.memory[c] = known
        words = [() if c[0] == " " else self.pattern.findall(c) for c in todo]
        distinct = list(set().union(*words)) if todo else []
        ids = dict(zip(distinct, self.merge([w.encode("utf-8", "replace") for w in distinct]), strict=True))
        names, tokens = self.names, self.tokens
        for c, ws in zip(todo, words, strict=True):
            if len(ws) == 1:
                own = ids[ws[0]]
            else:
                own = [self.added[c[1:]]] if c[0] == " " else [i for w in ws for i in ids[w]]
            (self.memory if len(c) <= LONG else own_)[c] = (" ".join([names[i] for i in own]), " ".join([tokens[i] for i in own]), len(own))
        return own_

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
        """Of each text: its ids in decimal and its tokens, joined by spaces, and the number of ids."""
        pieces = [self.chunks(t or "") for t in texts]
        long = self.learn(set().union(*pieces) if pieces else set())
        memory = self.memory
        for ps in pieces:
            known = [long[p] if p in long else memory[p] for p in ps] if long else map(memory.__getitem__, ps)
            found = [x for x in known if x[2]]
            yield " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def parts_of(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) in parts of about `most` letters, each at least one text."""
    texts: list[str | None] = []
    size = lo = 0
    for k in range(len(column)):
        texts.append(column[k].as_py())
        size += len(texts[-1] or "")
        if size >= most or k == len(column) - 1:
            yield lo, texts
            texts, size, lo = [], 0, k + 1


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256; with_ids: also ids and decoded."""
    prepare(docs.sparkSession)
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for lo, texts in parts_of(b.column(1)):
                rows = list(bpe.encode(texts))
                cols = [
                    b.column(0).slice(lo, len(texts)),
                    pa.array([n for _, _, n in rows], pa.int64()),
                    pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _, _ in rows]),
                    pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d, _ in rows]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array([[int(x) for x in i.split()] for i, _, _ in rows], pa.list_(pa.int32())), pa.array([d for _, d, _ in rows])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)


def decode(ids: list[int], path: str) -> str:
    """As the library does for a vocabulary without a decoder: tokens joined by a space."""
    return " ".join(load(path).tokens[i] for i in ids)
