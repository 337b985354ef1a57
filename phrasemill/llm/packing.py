"""Harmonic packing of documents into token sequences.

A document's ids, ended by id 0, are cut into whole sequences and a rest. A piece of length l belongs to class
k = floor(capacity / l), and a bin of class k takes exactly k pieces, whatever their lengths, so bins are filled without
looking at what fits. A rest stays whole if k pieces of its length leave at most `PADDING` of the capacity free; else a piece
of floor(capacity / (k + 1)), which fits class k + 1, is cut off, and what is left, shorter than capacity / (k * (k + 1)), is
classified again. So a full bin has padding of at most `PADDING` and `capacity` / k - floor(capacity / k) for each piece.

Every worker fills bins of its own. Bins open at its end (fewer than k pieces, so at most a sequence per class) are laid
one after the other and cut into full sequences, and the last ids into sequences of powers of two, which need no padding.

Defined results: null text counts as empty, a document of the single id 0; null doc_id is packed like others; repeated
rows are packed as often as they come; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.bpe import parts_of
from phrasemill.llm.common import prepare

CAPACITY = 1024
MEMORY = 250_000
LONGEST = 64  # letters of a string that is kept, so the memory is bounded in bytes
PADDING = 32  # 1/32 of the capacity


class ByteIds:
    """Ids of a byte-level BPE as bytes (32 bits, little endian), kept for pieces that begin with a space."""

    def __init__(self, json_path: str, rank_path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(json_path)
        self.exact.no_truncation(), self.exact.no_padding()
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.memory: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        head = self._ids(first) if first else b""
        memory = self.memory
        try:
            return head + b"".join([memory[x] for x in rest])
        except KeyError:
            own: dict[str, bytes | None] = {}
            for x in set(rest).difference(memory):
                # before a space that other white space follows, a text can't always be cut
                kept = memory if len(x) <= LONGEST else own
                kept[x] = self.older.get(x) or (None if not x or x[0].isspace() else self._ids(" " + x))
            found = [own[x] if x in own else memory[x] for x in rest]
            if len(memory) > MEMORY:
                self.older, self.memory = memory, {}
            return self._ids(text) if None in found else head + b"".join(found)
        except TypeError:
            return self._ids(text)

    def _ids(self, text: str) -> bytes:
        return array("I", self.plain.encode_ordinary(text)).tobytes()


def pieces(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        n = rest if PADDING * (capacity - k * rest) <= capacity else capacity // (k + 1)
        out.append(n)
        rest -= n
    return out


class Bins:
    """Open bins of one worker, by class: at most k - 1 pieces of class k. A piece is (doc_id, start, length, total, ids)."""

    def __init__(self, worker: int, capacity: int = CAPACITY) -> None:
        self.next, self.capacity, self.open = worker << 40, capacity, {}

    def add(self, piece: tuple) -> list[tuple]:
        """Rows (*piece, sequence, offset) of the bin that the piece fills, if it does."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self._close(self.open.pop(k)) if len(held) == k else []

    def _close(self, held: list[tuple]) -> list[tuple]:
        self.next += 1
        out, at = [], 0
        for p in held:
            out.append((*p, self.next - 1, at))
            at += p[2]
        return out

    def finish(self) -> list[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity) + [1 << k for k in range(self.capacity.bit_length() - 1, -1, -1) if (total % self.capacity) >> k & 1]
        out, k, used = [], 0, 0
        for room in sizes:
            held = []
            while room:
                doc, start, length, whole, ids = left[k]
                n = min(room, length - used)
                held.append((doc, start + used, n, whole, ids[4 * used : 4 * (used + n)]))
                room, used = room - n, used + n
                if used == length:
                    k, used = k + 1, 0
            out += self._close(held)
        return out


_loaded: dict[tuple, ByteIds] = {}


def pack(docs: DataFrame, json_path: str, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: also its ids."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity must be a power of two")
    prepare(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (json_path, rank_path, pattern)
        if key not in _loaded:
            _loaded[key] = ByteIds(json_path, rank_path, pattern)
        coder, bins, rows = _loaded[key], Bins(TaskContext.get().partitionId(), capacity), []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            ids, cols = cols[4], [*cols[:4], *cols[5:]]
            out = [pa.array(c, pa.int64()) for c in (cols[0], cols[1], cols[2], [zlib.crc32(i) for i in ids], cols[3], cols[4], cols[5])]
            if with_ids:
                out.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for lo, texts in parts_of(b.column(1)):
                for k, t in enumerate(texts, lo):
                    ids = coder.encode(t or "") + b"\0\0\0\0"
                    total, at = len(ids) // 4, 0
                    for n in pieces(total, capacity):
                        rows += bins.add((doc_ids[k], at, n, total, ids[4 * at : 4 * (at + n)]))
                        at += n
                if rows:
                    yield batch()
        rows += bins.finish()
        if rows:
            yield batch()

    schema = ", ".join(f"{n} long" for n in names[:7]) + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
