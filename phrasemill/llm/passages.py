"""Near-duplicate passages of documents by compact windows over min-hashes.

A text is a sequence of five-word shingles. Under each of `HASHES` hash functions the Cartesian tree of its values gives
compact windows (l, c, r): all passages that start in [l, c] and end in [c, r] have the shingle at c as their min-hash.
Only windows that hold a passage of `MIN_WORDS` words are made: places that equal the morphological opening of the values,
with the nearest smaller values at both sides as their ends, all in numpy.

Windows with the same hash and shingle have a key; workers get them packed, by key (`linked`). Windows around which a whole
passage is equal, in one of `ALIGNED` alignments, are linked to the first of them, which is proof enough; windows that such
links connect are a part. In keys of up to `FEW` windows all pairs of parts are linked, window by window. In larger ones all
parts are that have the same `BLOCK` shingles before or behind c, by their first windows there: of a similar passage of
`MIN_WORDS` words with one changed, nine places in ten have such a block on one side. No group is cut, whatever its size, and
the result doesn't depend on how rows are dealt.

Links of two documents are joined as intervals across the hashes; where at least `ENOUGH` hashes overlap, the ids of the words
of both regions are fetched and verified: a passage counts if it has `MIN_WORDS` words on both sides and the Jaccard similarity of
its shingles is at least `SIMILAR`. Passages of a document that mostly overlap are one region, and regions that are linked,
also over others, are a class. Equal passages and the candidate with the smallest document come first; of the others,
those are left out whose min-hashes all lie in passages that are then in one class already.

Defined results: null counts as empty; texts shorter than a passage have none; null doc_ids take no part; rows that share
a doc_id are treated as one document, of which identical passages are reported once; an empty table gives an empty
table; repeats within one document are not reported. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm.bpe import parts_of
from phrasemill.llm.common import components, drop_written, prepare, sized, written

SHINGLE, MIN_WORDS, SIMILAR, HASHES, ENOUGH = 5, 50, 0.8, 10, 2
ALIGNED = 4  # whole passages around c that are compared
BLOCK = 12  # shingles at one side of c that two windows of a large key share
FEW = 16  # windows of a key of which all pairs are made
AT_ONCE = 5  # hashes whose windows are on disk at once
PAIRS = 2_000_000  # pairs that a worker makes at once
ROUND = 100_000_000  # letters of regions that are verified at once, or as many as all texts have
PART = 16_000_000  # letters of texts whose windows are a part
FIRST = 64  # words of a document for which the candidate with the smallest document is verified first
SPANS = 500  # regions of a document that are cut out of one copy of its text
BYTES = 4_000_000  # words of regions that are compared at once
RUNS = 16  # runs of a chain that aren't worth an array
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_INK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: lo and hi are the places of a window before and behind c; left and right the blocks that end or start there; whole passages around c.
WINDOW = np.dtype([("key", "<i8"), ("doc", "<i8"), ("c", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("left", "<u4"), ("right", "<u4"), ("whole", "<u4", (ALIGNED,))])
LINK = np.dtype([("doc", "<i8"), ("doc2", "<i8"), ("c", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("c2", "<i4"), ("lo2", "<i4"), ("hi2", "<i4"), ("key", "<i4")])
EQUAL = 16  # flag beside the hash in a link's key: a whole passage is equal
_MULT = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_ids(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit id of every word [^\\x20\\x09-\\x0D]+ in lower case, number of words per text)."""
    parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts).translate(_LOWER)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _INK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    padded = data + bytes(8)
    at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    n = ends - starts
    ids = n.astype(np.uint64) * _MULT[63]
    lane, own = 0, np.arange(len(starts))
    while len(own):
        left = n[own] - 8 * lane
        value = mixed((at[starts[own] + 8 * lane] & _MASK[np.minimum(left, 8)]) + np.uint64(lane)) * _MULT[lane % 60]
        ids[own] += value
        own = own[left > 8]
        lane += 1
    text_starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
    return ids, np.diff(np.searchsorted(starts, text_starts))


def stored_ids(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What word_ids() gave, of parts that hold the ids as bytes."""
    return np.frombuffer(b"".join(parts), np.uint64), np.array([len(p) // 8 for p in parts], dtype=np.int64)


def shingle_ids(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * _MULT[40 + k]
    return mixed(out)


def _slide(v: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over v[i : i + width] for every i; beyond the end is 0."""
    out, n = np.r_[v, np.zeros(width, v.dtype)], 1
    while 2 * n <= width:
        out = op(out[:-n], out[n:])
        n *= 2
    return op(out[: len(v)], out[width - n : width - n + len(v)])


def compact_windows(v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of windows that hold `least` places; v: hash values over 0, with zeros between texts and at both ends.

    Of equal values, the leftmost is the minimum; a later one in its window is part of it. What ends a window is smaller,
    and so has a window that holds it: ends are looked for among the places that have one, and the zeros.
    """
    low = _slide(v, least, np.minimum)
    opened = _slide(np.r_[np.zeros(least - 1, v.dtype), low], least, np.maximum)[: len(v)]
    place = np.flatnonzero(opened == v)
    val = v[place]
    levels = [val]  # levels[k][i]: minimum of val[i : i + 2^k]
    while (1 << len(levels)) < len(val):
        s = 1 << (len(levels) - 1)
        nxt = np.minimum(levels[-1][:-s], levels[-1][s:])
        if not nxt.any():  # every stretch this long crosses a text's end
            break
        levels.append(nxt)
    c = np.flatnonzero(val)
    own, r, left = val[c], c.copy(), c.copy()
    for k in range(len(levels) - 1, -1, -1):
        s, t = 1 << k, levels[k]
        step = (r + 1 < len(t)) & (t[np.minimum(r + 1, len(t) - 1)] >= own)
        r += step * s
        at = left - s
        step = (at >= 0) & (t[np.maximum(at, 0)] > own)
        left -= step * s
    first = val[left - 1] < own  # else an equal value is before it
    c, left, r = place[c[first]], place[left[first] - 1] + 1, place[r[first] + 1] - 1
    keep = r - left + 1 >= least
    return left[keep], c[keep], r[keep]


def windows_of(texts: list[str | None], hashes: int = HASHES, min_words: int = MIN_WORDS, only: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text of each, records of WINDOW without doc): compact windows of the texts under the hashes `only`, or all."""
    words, n = word_ids(texts)
    least = min_words - SHINGLE + 1
    fit = np.flatnonzero(n >= min_words)
    if not len(fit):
        return np.zeros(0, np.int64), np.zeros(0, WINDOW)
    s = shingle_ids(words)
    m = n[fit] - SHINGLE + 1  # shingles of each text, with a gap after each
    base = np.cumsum(n)[fit] - n[fit]
    place = np.cumsum(m + 1) - m
    dst = np.repeat(place - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
    size = int(place[-1] + m[-1] + 1)
    full = np.zeros(size, dtype=np.uint64)
    own = full[dst] = s[dst + np.repeat(base - place, m)]
    power, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(size, x)]) for x in (_BASE, _INVERSE))
    sums = np.r_[np.uint64(0), np.cumsum(full * power[:-1])]
    rows, out = [], []
    for h in range(hashes) if only is None else only:
        v = np.zeros(size, dtype=np.uint32)
        v[dst] = np.maximum((mixed(own + _MULT[50 + h]) >> np.uint64(32)).astype(np.uint32), 1)
        left, c, r = compact_windows(v, least)
        t = np.searchsorted(place, c, side="right") - 1

        def block(a: np.ndarray, z: np.ndarray, t: np.ndarray = t) -> np.ndarray:
            """A hash of the shingles [a, z); 0 if the text doesn't have them all."""
            ok = (a >= place[t]) & (z <= place[t] + m[t])
            a, z = np.where(ok, a, 0), np.where(ok, z, 0)
            return np.where(ok, (mixed((sums[z] - sums[a]) * inverse[a]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))

        w = np.zeros(len(c), WINDOW)
        w["key"] = ((mixed(full[c] ^ _MULT[10 + h]) >> np.uint64(4)) << np.uint64(4) | np.uint64(h)).view(np.int64)
        w["c"], w["lo"], w["hi"] = c - place[t], c - left, r - c
        w["left"], w["right"] = block(c - BLOCK + 1, c + 1), block(c, c + BLOCK)
        for k in range(ALIGNED):
            at = c - least + 1 + k * (least - 1) // (ALIGNED - 1)
            w["whole"][:, k] = block(at, at + least)
        rows.append(fit[t]), out.append(w)
    return np.concatenate(rows), np.concatenate(out)


def packed(rows: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Records as one row (part, data) per part: bytes of the same place in a record lie together, which compresses."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    flat = rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize)
    data = [np.ascontiguousarray(flat[a:z].T).tobytes() for a, z in zip(at.tolist(), np.r_[at[1:], np.full(min(len(rows), 1), len(rows))].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(data, pa.binary())], ["part", "data"])


def unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    out = [np.frombuffer(x.as_buffer(), np.uint8).reshape(kind.itemsize, -1).T for b in batches for x in b.column("data")]
    return np.ascontiguousarray(np.concatenate(out)).view(kind).ravel() if out else np.zeros(0, kind)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    return np.logical_or.reduce([np.r_[True, x[1:] != x[:-1]] for x in cols]) if len(cols[0]) else np.zeros(0, bool)


def _pairs(group: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group and different parts of it, at most about PAIRS at once; both mark first rows."""
    n = len(group)
    if not n:
        return
    ends = [np.repeat(np.r_[at[1:], n], np.diff(np.r_[at, n])) for at in (np.flatnonzero(group), np.flatnonzero(part))]
    behind = ends[0] - ends[1]
    total = np.r_[0, np.cumsum(behind)]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, side="right")) - 1)
        k = behind[lo:hi]
        a = np.repeat(np.arange(lo, hi), k)
        yield a, np.repeat(ends[1][lo:hi] - (total[lo:hi] - total[lo]), k) + np.arange(len(a))
        lo = hi


def linked(w: np.ndarray) -> Iterator[np.ndarray]:
    """Records of LINK between the windows that share a key, of different documents.

    Windows around which an equal whole passage lies, in one of the alignments, are a class: each is linked to its first, and
    that link is enough. Classes that share a window are a part, whose windows all have a way to each other. Windows of
    different parts are all linked in keys of at most FEW windows; in others, all parts that have an equal block at one side
    are, by the first window of each with it; and the first of each block is linked to that of the key.
    """
    order = np.argsort(w["key"], kind="stable")
    at = np.flatnonzero(_runs(w["key"][order]))
    doc = w["doc"][order]
    shared = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
    w = w[order[np.repeat(shared, np.diff(np.r_[at, len(w)]))]]
    w = w[np.lexsort((w["lo"], w["c"], w["doc"], w["key"]))]
    n = len(w)
    if not n:
        return
    new = _runs(w["key"])
    group = np.cumsum(new) - 1
    top = np.flatnonzero(new)[group]
    large = np.diff(np.r_[np.flatnonzero(new), n])[group] > FEW
    doc = w["doc"]

    def made(a: np.ndarray, b: np.ndarray, equal: int = 0) -> np.ndarray:
        """Links of pairs, as numbers that sort by pair, those of equal passages first; documents differ."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        own = doc[a] != doc[b]
        return (a[own] * n + b[own]) * 2 + 1 - equal

    rest, sides, classes = [], [], []
    for k in range(ALIGNED):
        x = np.where(w["whole"][:, k] > 0, w["whole"][:, k].astype(np.int64), -1 - np.arange(n))
        o = np.lexsort((x, group))
        at = np.flatnonzero(_runs(group[o], x[o]))
        first = np.empty(n, np.int64)
        first[o] = np.repeat(o[at], np.diff(np.r_[at, n]))
        classes.append((o, at, first))
        rest.append(made(np.arange(n), first, 1))
    part, old = np.arange(n), None
    while old is None or (part != old).any():
        old = part.copy()
        for o, at, _ in classes:
            part[o] = np.repeat(np.minimum.reduceat(part[o], at), np.diff(np.r_[at, n]))
    lone = (w["left"] == 0) & (w["right"] == 0)
    rest.append(made(np.flatnonzero(lone), top[lone]))
    for block, first in (("left", classes[0][2]), ("right", classes[-1][2])):
        lone |= first == np.arange(n)
        k = np.flatnonzero(w[block] > 0)
        k = k[np.lexsort((part[k], w[block][k], group[k]))]
        k = k[_runs(group[k], w[block][k], part[k])]
        start = _runs(group[k], w[block][k])
        rest.append(made(k[start], top[k[start]]))
        start, k = start[large[k]], k[large[k]]
        sides.append((k, start, np.ones(len(k), bool)))
    k = np.flatnonzero(lone & ~large)
    k = k[np.lexsort((k, part[k], group[k]))]
    sides.append((k, _runs(group[k]), _runs(group[k], part[k])))

    def records(codes: np.ndarray) -> np.ndarray:
        codes = np.sort(codes)
        codes = codes[_runs(codes >> 1)]
        a, b = codes // 2 // n, codes // 2 % n
        out = np.zeros(len(codes), LINK)
        for side, k in (("", b), ("2", a)):
            for f in ("doc", "c", "lo", "hi"):
                out[f + side] = w[f][k]
        out["key"] = (w["key"][a] & 15) + EQUAL * (1 - (codes & 1))
        return out

    size = sum(map(len, rest))
    for k, *runs in sides:
        for a, b in _pairs(*runs):
            rest.append(made(k[a], k[b]))
            size += len(rest[-1])
            if size > 2 * PAIRS:
                yield records(np.concatenate(rest))
                rest, size = [], 0
    if size:
        yield records(np.concatenate(rest))


def _letters(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def _parts(spark: SparkSession, letters: int) -> int:
    """A worker holds a part of the windows or links at once, so there are as many parts as the texts need."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-letters // PART))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, hashes: int = HASHES, letters: int | None = None) -> DataFrame:
    """Links of windows that share a min-hash, as records of LINK packed by pair of documents: (part, data). letters: those
    of all texts, if known."""
    prepare(docs.sparkSession)
    parts = _parts(docs.sparkSession, _letters(docs, text_col) if letters is None else letters)

    def make(batches: Iterator[pa.RecordBatch], only: range) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, texts in parts_of(b.column(1), 3_000_000):
                row, w = windows_of(texts, hashes, min_words, only)
                w["doc"] = ids[lo + row]
                yield packed(w, ((w["key"].view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in linked(unpacked(batches, WINDOW)):
            pair = mixed(found["doc"].astype(np.uint64) * _MULT[20] + found["doc2"].astype(np.uint64))
            yield packed(found, (pair % np.uint64(parts)).astype(np.int32))

    lean = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = None
    for at in range(0, hashes, AT_ONCE):
        only = range(at, min(at + AT_ONCE, hashes))
        w = lean.mapInArrow(lambda b, only=only: make(b, only), "part int, data binary")
        once = written(w.repartitionById(parts, "part").mapInArrow(link, "part int, data binary"), "links")
        found = once if found is None else found.unionByName(once)
    return found


def regions(df: pd.DataFrame, enough: int = ENOUGH, more: bool = False) -> pd.DataFrame:
    """Regions of the links: links of two documents whose windows meet in both are in one, however they are ordered.

    more: also between which places of both the min-hashes lie, and whether a link is of equal passages.
    """
    df = df.sort_values(["doc", "doc2", "c", "c2", "key"])
    d, d2 = df["doc"].to_numpy(), df["doc2"].to_numpy()
    left, r, l2, r2 = (df[x].to_numpy() for x in ("l", "r", "l2", "r2"))
    # runs of links that each meet the one before; runs are joined below
    cut = np.r_[True, (d[1:] != d[:-1]) | (d2[1:] != d2[:-1]) | (left[1:] > r[:-1]) | (np.maximum(l2[1:], l2[:-1]) > np.minimum(r2[1:], r2[:-1]))]
    at = runs = np.flatnonzero(cut)
    key = df["key"].to_numpy().astype(np.int64)
    # a link of equal passages counts as all hashes
    bits = np.bitwise_or.reduceat(np.where(key & EQUAL, (1 << EQUAL) - 1, 1 << (key & 15)), at)
    d, d2, lo, hi, lo2, hi2 = d[at], d2[at], np.minimum.reduceat(left, at), np.maximum.reduceat(r, at), np.minimum.reduceat(l2, at), np.maximum.reduceat(r2, at)
    pairs = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (d2[1:] != d2[:-1])])
    sizes = np.diff(np.r_[pairs, len(d)])
    several = (sizes > 1) & (np.bitwise_count(np.bitwise_or.reduceat(bits, pairs)) >= enough)
    part = np.arange(len(d))
    for k in np.flatnonzero(several).tolist():
        own = slice(pairs[k], pairs[k] + sizes[k])
        part[own] = pairs[k] + _meeting(lo[own], hi[own], lo2[own], hi2[own])
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    bits = np.bitwise_or.reduceat(bits[order], at)
    out = pd.DataFrame({"doc": d[order][at], "lo": np.minimum.reduceat(lo[order], at), "hi": np.maximum.reduceat(hi[order], at), "doc2": d2[order][at], "lo2": np.minimum.reduceat(lo2[order], at), "hi2": np.maximum.reduceat(hi2[order], at)})
    if more:
        c, c2 = df["c"].to_numpy(), df["c2"].to_numpy()
        for name, x, op in (("from", c, np.minimum), ("to", c, np.maximum), ("from2", c2, np.minimum), ("to2", c2, np.maximum)):
            out[name] = op.reduceat(op.reduceat(x, runs)[order], at)
        out["equal"] = bits == (1 << EQUAL) - 1
    return out[np.bitwise_count(bits) >= enough]


def _meeting(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """The component of each box among those that meet in both directions, by a sweep with the boxes still open."""
    root = list(range(len(lo)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    a, b, a2, b2 = lo.tolist(), hi.tolist(), lo2.tolist(), hi2.tolist()
    still: list[int] = []
    for k in np.argsort(lo, kind="stable").tolist():
        still = [x for x in still if b[x] >= a[k]]
        for x in still:
            if a2[x] <= b2[k] and a2[k] <= b2[x]:
                i, j = top(x), top(k)
                root[max(i, j)] = min(i, j)
        still.append(k)
    return np.array([top(k) for k in range(len(root))])


def candidates(found: DataFrame, enough: int = ENOUGH, letters: int = 0) -> DataFrame:
    """Regions (doc, lo, hi, doc2, lo2, hi2), in words, in which windows of at least `enough` hashes overlap; doc > doc2.
    Their min-hashes lie in [from, to] and [from2, to2]; equal: one is in equal passages."""
    names = ["doc", "lo", "hi", "doc2", "lo2", "hi2", "from", "to", "from2", "to2", "equal"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpacked(batches, LINK)
        if len(x):
            df = pd.DataFrame({"key": x["key"], "doc": x["doc"], "l": x["c"] - x["lo"], "c": x["c"], "r": x["c"] + x["hi"], "doc2": x["doc2"], "l2": x["c2"] - x["lo2"], "c2": x["c2"], "r2": x["c2"] + x["hi2"]})
            t = pa.Table.from_pandas(regions(df, enough, True)[names], preserve_index=False)
            yield from t.to_batches(100_000)

    return found.repartitionById(_parts(found.sparkSession, letters), "part").mapInArrow(join, ", ".join(f"`{x}` {'long' if x in ('doc', 'doc2') else 'boolean' if x == 'equal' else 'int'}" for x in names))


def _chained(chains: list[list[tuple[int, int, int]]], sa: list | np.ndarray, sb: list | np.ndarray, min_words: int, similar: float) -> list[tuple[int, int, int, int, float]]:
    """Passages of runs (start, length, start in b) of equal shingles that are in the order of both regions."""
    out = []
    least = min_words - SHINGLE + 1
    for chain in chains:
        left = sum(x[1] for x in chain)  # equal shingles from i on; a passage has `similar` of `least`
        if left < similar * least:
            continue
        s, n, p = zip(*chain, strict=True)
        last, i = len(s) - 1, 0
        arrays = [np.array(x, dtype=np.int64) for x in (s, n, p)] if last >= RUNS else None
        while i <= last and left >= similar * least:
            j = last
            if arrays and last - i >= RUNS:
                start, size, there = (x[i:] for x in arrays)
                inter, span, span2 = np.cumsum(size), start + size - s[i], there + size - p[i]
                ok = np.flatnonzero((inter >= similar * (span + span2 - inter)) & (np.minimum(span, span2) >= least))
                j = i + int(ok[-1]) if len(ok) else i - 1
            else:
                inter = left
                while j >= i:
                    span, span2 = s[j] + n[j] - s[i], p[j] + n[j] - p[i]
                    if min(span, span2) < least or inter < similar * least:
                        j = i - 1  # what is shorter has less
                        break
                    if inter >= similar * (span + span2 - inter):
                        break
                    inter -= n[j]
                    j -= 1
            if j < i:
                left -= n[i]
                i += 1
                continue
            whole = (s[i], s[j] + n[j], p[i], p[j] + n[j])
            jac = 1.0  # of one run
            if j > i:
                x, y = (set(v.tolist() if isinstance(v, np.ndarray) else v) for v in (sa[whole[0] : whole[1]], sb[whole[2] : whole[3]]))
                both = len(x & y)
                jac = both / (len(x) + len(y) - both)
            found = [(*whole, jac)] if jac >= similar else [(s[q], s[q] + n[q], p[q], p[q] + n[q], 1.0) for q in range(i, j + 1) if n[q] >= least]
            out += [(lo, hi + SHINGLE - 1, lo2, hi2 + SHINGLE - 1, float(v)) for lo, hi, lo2, hi2, v in found]
            left -= sum(n[i : j + 1])
            i = j + 1
    return out


def _places(sb: list) -> dict:
    """Where each shingle of b is."""
    at: dict = {}
    for k, x in enumerate(sb):
        at.setdefault(x, []).append(k)
    return at


def _chains(sa: list, sb: list, at: dict) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, start in b) of equal shingles, from the place of b that is near the last one or goes on longest."""
    chains: list[list[tuple[int, int, int]]] = [[]]  # (start, length, start in b)
    k = shift = 0
    while k < len(sa):
        places = at.get(sa[k])
        if not places:
            k += 1
            continue
        near = bisect.bisect_left(places, k + shift)
        best = (0, 0)
        for p in {places[min(near, len(places) - 1)], places[max(near - 1, 0)], places[0]}:
            n = 1
            while k + n < len(sa) and p + n < len(sb) and sa[k + n] == sb[p + n]:
                n += 1
            best = max(best, (n, -p))
        n, p = best[0], -best[1]
        last = chains[-1]
        if last and p < last[-1][2] + last[-1][1]:
            chains.append([])
        chains[-1].append((k, n, p))
        shift, k = p - k, k + n
    return chains


def verify_pair(a: list[bytes], b: list[bytes], min_words: int = MIN_WORDS, similar: float = SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end, start2, end2, similarity) in words of two regions that are near-duplicates.

    Runs of equal shingles are chained in the order of both regions; from each run on, the longest stretch of runs that is
    similar enough is a passage. Where shingles of b repeat, runs of min_words equal words that no passage holds are added.
    So every run of min_words words of a that is anywhere in b is in one.
    """
    if len(a) < min_words or len(b) < min_words:
        return []
    number: dict[bytes, int] = {}
    xa, xb = ([number.setdefault(w, len(number)) for w in x] for x in (a, b))
    sa = list(zip(*[xa[k:] for k in range(SHINGLE)], strict=False))
    sb = list(zip(*[xb[k:] for k in range(SHINGLE)], strict=False))
    at = _places(sb)
    if sum(x in at for x in sa) < similar * (min_words - SHINGLE + 1):
        return []  # a passage shares as many shingles
    out = _chained(_chains(sa, sb, at), sa, sb, min_words, similar)
    if len(at) < len(sb):
        out += _missed(xa, xb, min_words, [x[:2] for x in out])
    return out


def verify_texts(
    a: list[bytes], b: list[bytes], min_words: int = MIN_WORDS, similar: float = SIMILAR, ids_of: Callable = word_ids
) -> Iterator[list[tuple[int, int, int, int, float]]]:
    """verify_pair of each a and b, words joined by spaces, by the ids of words and shingles, about BYTES at once; with
    stored_ids as ids_of, a and b are ids of words as bytes."""
    lo = size = 0
    for k in range(len(a)):
        size += len(a[k]) + len(b[k])
        if size >= BYTES or k + 1 == len(a):
            yield from _verified(a[lo : k + 1], b[lo : k + 1], min_words, similar, ids_of)
            lo, size = k + 1, 0


def _verified(a: list[bytes], b: list[bytes], min_words: int, similar: float, ids_of: Callable) -> Iterator[list[tuple[int, int, int, int, float]]]:
    ids, n = ids_of([*a, *b])
    least = max(min_words, SHINGLE)
    if len(ids) < least:
        yield from ([] for _ in a)
        return
    shingles = shingle_ids(ids)
    at = np.cumsum(n) - n
    own = np.where(n >= least, n - SHINGLE + 1, 0)
    fit = np.minimum(own[: len(a)], own[len(a) :]) > 0
    fit &= _may_hold(shingles, at, own, len(a), min_words - SHINGLE + 1, similar)
    at, n, own = at.tolist(), n.tolist(), own.tolist()
    for k, ok in enumerate(fit.tolist()):
        if not ok:
            yield []
            continue
        i, j = at[k], at[len(a) + k]
        yield verify_ids(ids[i : i + n[k]], ids[j : j + n[len(a) + k]], shingles[i : i + own[k]], shingles[j : j + own[len(a) + k]], min_words, similar)


def _may_hold(shingles: np.ndarray, at: np.ndarray, own: np.ndarray, pairs: int, least: int, similar: float) -> np.ndarray:
    """For each pair, whether a may hold a passage: places whose place in a bit table of b's is taken are dense() somewhere."""
    bits = np.ceil(np.log2(8 * np.maximum(own[pairs:], 1))).astype(np.int64)
    base = np.cumsum(1 << bits) - (1 << bits)

    def places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = np.cumsum(size)
        x = shingles[np.arange(int(total[-1])) + np.repeat(first - (total - size), size)]
        return (x >> np.repeat((64 - bits).astype(np.uint64), size)).astype(np.int64) + np.repeat(base, size)

    taken = np.zeros(int(base[-1] + (1 << bits[-1])), bool)
    taken[places(at[pairs:], own[pairs:])] = True
    return dense(taken[places(at[:pairs], own[:pairs])], own[:pairs], least, similar)


def dense(seen: np.ndarray, sizes: np.ndarray, least: int, similar: float) -> np.ndarray:
    """For texts of these sizes, one behind the other, whether `similar` of some stretch of at least `least` places is seen.

    A passage is such a stretch: of its places, and so of its runs of equal shingles, at least as many are in the other text.
    """
    n, out = len(seen), np.zeros(len(sizes), bool)
    if n < least:
        return out
    text = np.repeat(np.arange(len(sizes)), sizes)
    # how much more than `similar` of the places before are seen; a text is so far below the one before it that none crosses
    over = np.r_[0.0, np.cumsum(seen - similar)] - (n + 1.0) * np.r_[text, text[-1]]
    lowest = np.minimum.accumulate(over[:-least])
    end = over[least:] + (n + 1.0) * (np.r_[text, text[-1]][least:] - text[least - 1 :])  # as of the text that ends there
    out[text[least - 1 :][end >= lowest - 1e-3]] = True
    return out


def verify_ids(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, min_words: int = MIN_WORDS, similar: float = SIMILAR) -> list[tuple[int, int, int, int, float]]:
    """What verify_pair finds, from the ids of the words and of the shingles: runs of equal shingles in numpy."""
    order = np.argsort(sy, kind="stable")
    known = sy[order]
    at = np.minimum(np.searchsorted(known, sx), len(known) - 1)
    place = np.where(known[at] == sx, order[at], -1)
    seen = place >= 0
    if not dense(seen, np.array([len(seen)]), min_words - SHINGLE + 1, similar)[0]:
        return []
    if (known[1:] == known[:-1]).any():
        la, lb = sx.tolist(), sy.tolist()
        out = _chained(_chains(la, lb, _places(lb)), la, lb, min_words, similar)
        width = min_words - SHINGLE + 1
        total = np.r_[0, np.cumsum(seen)]
        free = total[width:] - total[:-width] == width  # where all shingles of a stretch are in b
        for s, e, *_ in out:
            free[s : max(e - min_words + 1, s)] = False
        if free.any():
            out += _missed(x.view(np.int64).tolist(), y.view(np.int64).tolist(), min_words, [v[:2] for v in out])
        return out
    jump = (place[1:] != place[:-1] + 1) | ~seen[:-1]
    edge = np.flatnonzero(np.r_[True, jump] & seen)
    stop = np.flatnonzero(np.r_[jump, True] & seen)  # a run ends where the next place isn't one further
    chains: list[list[tuple[int, int, int]]] = [[]]
    for k, n, p in zip(edge.tolist(), (stop - edge + 1).tolist(), place[edge].tolist(), strict=True):
        last = chains[-1]
        if last and p < last[-1][2] + last[-1][1]:
            chains.append([])
        chains[-1].append((k, n, p))
    return _chained(chains, sx, sy, min_words, similar)


def _missed(a: list[int], b: list[int], width: int, held: list[tuple[int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Equal runs of at least width words at all places of b, for the stretches of width words that no one of held has."""
    x = np.array([*a, -1, *b], dtype=np.int64)
    name, n = np.unique(x, return_inverse=True)[1], 1
    while n < width:  # name[i]: equal for equal x[i : i + n]
        step = min(n, width - n)
        name = np.unique(name[:-step] * len(x) + name[step:], return_inverse=True)[1]
        n += step
    mine, theirs = name[: len(a) - width + 1], name[len(a) + 1 :]
    first = np.full(len(name), -1)
    first[theirs[::-1]] = np.arange(len(theirs))[::-1]
    places = first[mine]
    free = places >= 0
    for s, e in held:
        free[s : max(e - width + 1, s)] = False
    out, done = [], 0
    for i in np.flatnonzero(free).tolist():
        if i < done:
            continue
        p = int(places[i])
        s, q, n = i, p, width
        while s and q and a[s - 1] == b[q - 1]:
            s, q, n = s - 1, q - 1, n + 1
        while s + n < len(a) and q + n < len(b) and a[s + n] == b[q + n]:
            n += 1
        out.append((s, s + n, q, q + n, 1.0))
        done = s + n - width + 1
    return out


def _regions(docs: DataFrame, wanted: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """wanted (doc, lo, hi and others, all numbers) with the ids of the words of each region; rows: at most so many regions.

    A document of which many regions are wanted has them in lists of about SPANS, each with a copy of its text.
    """
    names = wanted.columns[1:]
    schema = wanted.schema.add("words", "binary")
    parts = wanted.groupBy("doc").agg(F.ceil(F.count("*") / SPANS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(*names), F.col("parts")).cast("int")
    lists = wanted.join(parts, "doc").withColumn("part", part).groupBy("doc", "part").agg(F.collect_list(F.struct(*names)).alias("spans")).drop("part")
    joined = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(sized(lists, rows), "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, spans = b.column("doc"), b.column("spans")
            for lo, texts in parts_of(b.column("text"), 3_000_000):
                own = spans.slice(lo, len(texts))
                flat = own.flatten()
                cols = {f: flat.field(f) for f in names}
                out, at = [], 0
                words, sizes = word_ids(texts)
                data = words.tobytes()
                ends = np.cumsum(sizes)
                for a, z, n in zip((ends - sizes).tolist(), ends.tolist(), own.value_lengths().to_pylist(), strict=True):
                    spans_ = zip(cols["lo"].slice(at, n).to_pylist(), cols["hi"].slice(at, n).to_pylist(), strict=True)
                    out += [data[8 * (a + s) : 8 * min(a + e + SHINGLE, z)] for s, e in spans_]
                    at += n
                ids = np.repeat(doc.slice(lo, len(texts)).to_numpy(), own.value_lengths().to_numpy())
                whole = pa.RecordBatch.from_arrays([pa.array(ids), *cols.values(), pa.array(out, pa.binary())], ["doc", *names, "words"])
                for k in range(0, len(out), 1000):
                    yield whole.slice(k, 1000)

    return joined.select("doc", "spans", "text").mapInArrow(cut, schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similar: float = SIMILAR) -> DataFrame:
    """doc_id, start, end, other_id, other_start, other_end, similarity: a passage (words from 0, end exclusive) and the
    one in a document with a smaller id that it nearly repeats."""
    prepare(docs.sparkSession)
    letters = _letters(docs, text_col)
    found = links(docs, id_col, text_col, min_words, letters=letters)
    cand = written(candidates(found, letters=letters).distinct(), "candidates")
    drop_written(found)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity"]
        for b in batches:
            rows = []
            doc, lo, doc2, lo2 = (b.column(c).to_pylist() for c in ("doc", "lo", "doc2", "lo2"))
            found = verify_texts(b.column("a").to_pylist(), b.column("b").to_pylist(), min_words, similar, stored_ids)
            for k, spans in enumerate(found):
                for s, e, s2, e2, j in spans:
                    rows.append((doc[k], lo[k] + s, lo[k] + e, doc2[k], lo2[k] + s2, lo2[k] + e2, j))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 6, pa.float64()), strict=True)], names)

    def verified(some: DataFrame) -> DataFrame:
        some = written(some.select("doc", "lo", "hi", "doc2", "lo2", "hi2"), "regions")
        words = some.agg(F.sum(F.col("hi") - F.col("lo") + SHINGLE)).first()[0] or 0
        # the regions of a round have about as many letters as all texts, at six a word
        rounds = max(1, -(-6 * words // max(letters, ROUND)))
        out = None
        for k in range(rounds):
            own = some.where(F.pmod(F.xxhash64("doc2"), F.lit(rounds)) == k)
            rows = own.count()
            a = _regions(docs, own, rows, id_col, text_col).withColumnRenamed("words", "a")
            b = _regions(docs, own.select(F.col("doc2").alias("doc"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi")).distinct(), rows, id_col, text_col)
            both = a.join(b.toDF("doc2", "lo2", "hi2", "b").hint("shuffle_hash"), ["doc2", "lo2", "hi2"])
            pairs = both.select("doc", "lo", "doc2", "lo2", "a", "b").mapInArrow(verify, "doc_id long, start long, end long, other_id long, other_start long, other_end long, similarity double")
            once = written(pairs.distinct(), "repeats")
            out = once if out is None else out.unionByName(once)
        drop_written(some)
        return out

    place = F.expr(f"lo div {FIRST}").alias("place")
    least = cand.groupBy("doc", place).agg(F.min("doc2").alias("least"))
    ranked = cand.withColumn("place", F.expr(f"lo div {FIRST}")).join(least, ["doc", "place"]).withColumn("now", F.col("equal") | (F.col("doc2") == F.col("least"))).drop("place", "least")
    ranked = written(ranked, "candidates")
    drop_written(cand)
    first = verified(ranked.where("now"))
    rest = ranked.where("not now")
    if rest.isEmpty():
        return first
    out = first.unionByName(verified(_open(rest, first)))
    drop_written(ranked)
    return out


def _open(rest: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates with a min-hash outside of passages that pairs already have in one class, and of which that of doc
    repeats one of a smaller document."""
    linked, of = _classed(pairs)
    spans = linked.select(F.col("doc_id").alias("d"), "start", "end", F.col("a").alias("node"), F.lit(True).alias("repeats"))
    spans = spans.unionByName(linked.select(F.col("other_id").alias("d"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), F.col("b").alias("node"), F.lit(False).alias("repeats")))
    held = spans.groupBy("d", "node").agg(
        F.min("start").alias("s2"), F.max("end").alias("e2"), F.min(F.when(F.col("repeats"), F.col("start"))).alias("s"), F.max(F.when(F.col("repeats"), F.col("end"))).alias("e")
    )
    held = written(held.join(of.select("node", "component"), "node").drop("node"), "held")
    mine = held.where("s is not null").select(F.col("d").alias("doc"), "s", "e", F.col("component").alias("k"))
    theirs = held.select(F.col("d").alias("doc2"), "s2", "e2", F.col("component").alias("k"))
    names = ["doc", "lo", "hi", "doc2", "lo2", "hi2"]
    done = rest.join(mine, "doc").where(f"s <= `from` and `to` + {SHINGLE} <= e").join(theirs, ["doc2", "k"]).where(f"s2 <= from2 and to2 + {SHINGLE} <= e2")
    return rest.join(done.select(*names).distinct(), names, "left_anti")


def region_starts(start: np.ndarray, end: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For spans sorted by document and start (new: the first of a document), the number of the region of each: a span
    joins the one before it if they share at least half of the shorter."""
    out = np.zeros(len(start), dtype=np.int64)
    at = lo = hi = 0
    for k, (s, e, n) in enumerate(zip(start.tolist(), end.tolist(), new.tolist(), strict=True)):
        if n or not k or 2 * (min(hi, e) - s) < min(e - s, hi - lo):
            at, lo, hi = k, s, e
        else:
            lo, hi = s, max(hi, e)
        out[k] = at
    return out


def _classed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs with the regions a and b of both passages; (node, d, r, component) of each region: its document, first word, class."""
    spans = pairs.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e")).unionByName(pairs.select(F.col("other_id").alias("d"), F.col("other_start").alias("s"), F.col("other_end").alias("e"))).distinct()

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None  # the last document: it may go on

        def placed(df: pd.DataFrame) -> pd.DataFrame:
            first = region_starts(df["s"].to_numpy(), df["e"].to_numpy(), np.r_[True, df["d"].to_numpy()[1:] != df["d"].to_numpy()[:-1]])
            return df.assign(r=df["s"].to_numpy()[first])

        for p in parts:
            df = p if rest is None else pd.concat([rest, p], ignore_index=True)
            tail = df["d"] == df["d"].iloc[-1] if len(df) else df["d"].isna()
            rest = df[tail]
            if (~tail).any():
                yield placed(df[~tail])
        if rest is not None and len(rest):
            yield placed(rest)

    nodes = spans.repartition("d").sortWithinPartitions("d", "s", "e").mapInPandas(place, "d long, s long, e long, r long")
    nodes = written(nodes, "spans")
    numbers = written(nodes.select("d", "r").distinct().withColumn("node", F.monotonically_increasing_id()), "span-regions")
    known = nodes.join(numbers, ["d", "r"]).select("d", "s", "e", "node")
    linked = pairs.join(known.select(F.col("d").alias("doc_id"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("node").alias("a")), ["doc_id", "start", "end"])
    linked = written(linked.join(known.select(F.col("d").alias("other_id"), F.col("s").alias("other_start"), F.col("e").alias("other_end"), F.col("node").alias("b")), ["other_id", "other_start", "other_end"]), "linked")
    comp = components(linked.select("a", "b"))
    of = numbers.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return linked, of


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similar: float = SIMILAR) -> DataFrame:
    """repeats(), with the class that a passage and the one it repeats belong to: class_id and class_start are the document
    and the first word of the class's first region."""
    linked, of = _classed(repeats(docs, id_col, text_col, min_words, similar))
    first = of.groupBy("component").agg(F.min(F.struct("d", "r")).alias("first"))
    classes = of.join(first, "component").select(F.col("node").alias("a"), F.col("first.d").alias("class_id"), F.col("first.r").alias("class_start"))
    return linked.join(classes, "a").select("doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity", "class_id", "class_start")


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similar: float = SIMILAR) -> DataFrame:
    """One row per region of a document and the class that it is in, but for the class's first region, which class_id and
    class_start name: doc_id, start, end, other_id, other_start, other_end, similarity, class_id, class_start, links.

    start and end are those of all its passages in repeats(); links is the number of these, with documents of smaller or
    larger ids, and other_* the one of the smallest document. Regions that others have in one class aren't always compared.
    """
    linked, of = _classed(repeats(docs, id_col, text_col, min_words, similar))
    ends = ("a", "doc_id", "start", "end"), ("b", "other_id", "other_start", "other_end")

    def side(own: tuple[str, ...], other: tuple[str, ...]) -> DataFrame:
        link = F.struct(F.col(other[1]).alias("other_id"), (-F.col("similarity")).alias("less"), F.col(other[2]).alias("other_start"), F.col(other[3]).alias("other_end"))
        return linked.select(F.col(own[0]).alias("node"), F.col(own[3]).alias("end"), link.alias("link"))

    found = side(*ends).unionByName(side(*ends[::-1])).groupBy("node").agg(F.max("end").alias("end"), F.min("link").alias("link"), F.count("*").alias("links"))
    first = of.groupBy("component").agg(F.min(F.struct("d", "r")).alias("first"))
    rows = found.join(of, "node").join(first, "component").where("d <> first.d or r <> first.r")
    return rows.select(
        F.col("d").alias("doc_id"), F.col("r").alias("start"), "end", "link.other_id", "link.other_start", "link.other_end", (-F.col("link.less")).alias("similarity"),
        F.col("first.d").alias("class_id"), F.col("first.r").alias("class_start"), "links",
    )


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that nearly repeat one of a document with a smaller id; a document left empty goes."""
    found = written(repeats(docs, id_col, text_col).select("doc_id", "start", "end").distinct(), "passages")
    spans = found.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    joined = docs.join(sized(spans, found.count()), docs[id_col] == F.col("__doc"), "left").drop("__doc")
    at = docs.columns.index(text_col)
    sizes = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans_ = b.column(b.num_columns - 1)
            texts, keep, changed = [], [], {}
            for k in range(b.num_rows):
                t = b.column(at)[k].as_py()
                if spans_[k].is_valid:
                    t = without(t or "", [(s["start"], s["end"]) for s in spans_[k].as_py()])
                    changed[k] = len(t)
                texts.append(t)
                keep.append(k not in changed or bool(t.strip()))
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, cols[at].type)
            if sizes is not None and changed:
                n = cols[sizes].to_pylist()
                for k, v in changed.items():
                    n[k] = v
                cols[sizes] = pa.array(n, cols[sizes].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array(keep))

    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__spans").mapInArrow(cut, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words [start, end) of each span; what is left stays as it was."""
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for s, e in sorted(spans):
        a, z = places[s][0], places[min(e, len(places)) - 1][1]
        if a > at:
            out.append(text[at:a])
        at = max(at, z)
    out.append(text[at:])
    return "".join(out)
