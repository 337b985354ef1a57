"""SimHash near-dedup by a binary trie self-join.

Fingerprints within `budget` bits of each other agree in one of `budget + 1` bit blocks. So each distinct fingerprint
goes, rotated, to the trie below each of its blocks' values; within it, pairs of trie nodes are walked together, adding
differing bits, and a pair is left once its bits exceed the budget. A pair of nodes whose remaining depth fits in the
budget links all its leaves at once. A trie too large for one task is cut into chunks, and each pair of chunks is a
task of its own, so nothing is capped. Tasks return spanning forests, not pairs; components are found by Spark.

Defined results: null text counts as empty; texts without words have fingerprint zero and are linked like any other;
null doc_ids get a fingerprint and the component that its other members have (null if none has an id); repeated rows
are returned as often as they come; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import components, prepare, sized, written

SHINGLE, BUDGET, SEED, CHUNK, FRONTIER = 4, 4, 42, 60_000, 1_000_000
_BITS = np.array([[(b >> k) & 1 for k in range(8)] for b in range(256)], dtype=np.float32)


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text, uint64: word shingles under XXH64, a bit set in over half of them is set."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    digest, space = xxhash.xxh64_intdigest, b" "
    for k, t in enumerate(texts):
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if not n:
            continue
        if n <= shingle:
            hashes.append(digest(space.join(words), SEED))
            counts[k] = 1
            continue
        line = space.join(words)
        ends, at = [], 0
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *ends[: n - shingle]]
        hashes += [digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
        counts[k] = n - shingle + 1
    out = np.zeros(len(texts), dtype=np.uint64)
    if not hashes:
        return out
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    for byte in range(8):
        hist = np.bincount(row * 256 + raw[:, byte], minlength=len(texts) * 256).reshape(-1, 256)
        bits = (hist @ _BITS) * 2 > counts[:, None]
        out |= (np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64)) << np.uint64(8 * byte)
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.empty(b.num_rows, dtype=np.uint64)
            texts, size, lo = [], 0, 0
            for k, t in enumerate(b.column(1)):  # a few megabytes of text at a time
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size > 4_000_000 or k == b.num_rows - 1:
                    fp[lo : k + 1] = fingerprints_of(texts, shingle)
                    texts, size, lo = [], 0, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Union-find whose root is the smallest index."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n, dtype=np.int64)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                self.up = up
                return up
            up = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite a[k] with b[k], all at once: hook larger roots below smaller ones until nothing changes."""
        while len(a):
            up = self.roots()
            ra, rb = up[a], up[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def trie_links(keys: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int, budget: int, spent: int = 0) -> np.ndarray:
    """Links among sorted distinct uint64 keys: a forest as parents by index (parent = itself for roots).

    left, right: rows (lo, hi) of ranges of keys that agree in their first `depth` bits each; the node pairs to start with
    (the same range twice: its pairs with itself); spent: bits that each pair has used.
    """
    forest = _Forest(len(keys))
    stack = [(depth, left.astype(np.int64), right.astype(np.int64), np.full(len(left), spent, dtype=np.int8))]
    while stack:
        d, a, b, err = stack.pop()
        if not len(a):
            continue
        if len(a) > FRONTIER:
            h = len(a) // 2
            stack += [(d, a[h:], b[h:], err[h:]), (d, a[:h], b[:h], err[:h])]
            continue
        same = (a == b).all(axis=1)
        na, nb = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
        live = (na > 0) & (nb > 0) & ~(same & (na < 2))
        whole = live & (err + (64 - d) <= budget)  # no leaf below can exceed the budget
        if whole.any():
            for x in (a[whole], b[whole]):
                n = x[:, 1] - x[:, 0]
                forest.join(np.repeat(x[:, 0], n), _ranges(x[:, 0], n))
            forest.join(a[whole][:, 0], b[whole][:, 0])
        live &= ~whole
        leaf = live & (na * nb <= 64)  # short lists: compare what is left of them
        if leaf.any():
            for sel in np.array_split(np.flatnonzero(leaf), max(1, int((na * nb)[leaf].sum() // 4_000_000))):
                la, lb, m, n = a[sel][:, 0], b[sel][:, 0], na[sel], nb[sel]
                count = m * n
                base = np.repeat(np.arange(len(sel)), count)
                k = _ranges(np.zeros(len(sel), dtype=np.int64), count)
                i, j = la[base] + k // n[base], lb[base] + k % n[base]
                near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
                forest.join(i[near], j[near])
        live &= ~leaf
        a, b, err, same = a[live], b[live], err[live], same[live]
        if not len(a):
            continue
        ma, mb = _split(keys, a, d), _split(keys, b, d)
        a0, a1 = np.stack([a[:, 0], ma], 1), np.stack([ma, a[:, 1]], 1)
        b0, b1 = np.stack([b[:, 0], mb], 1), np.stack([mb, b[:, 1]], 1)
        one = err + 1 <= budget
        two = one & ~same
        stack.append((d + 1, np.concatenate([a0, a1, a0[one], a1[two]]), np.concatenate([b0, b1, b1[one], b0[two]]), np.concatenate([err, err, err[one] + 1, err[two] + 1]).astype(np.int8)))
    return forest.roots()


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)


def _split(keys: np.ndarray, r: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit `depth` (from the top) turns to one in each range, whose keys agree above it."""
    low = np.uint64(63 - depth)
    first = keys[np.minimum(r[:, 0], len(keys) - 1)]
    want = ((first >> low) | np.uint64(1)) << low
    return np.clip(np.searchsorted(keys, want), r[:, 0], r[:, 1])


def _rotations(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of budget + 1 blocks over 64 bits, from the top."""
    n = budget + 1
    at, out = 0, []
    for k in range(n):
        w = 64 // n + (k < 64 % n)
        out.append((at, w))
        at += w
    return out


def fingerprint_links(fps: DataFrame, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): a spanning forest of each trie, all of them together enough
    for the components of "differ in at most `budget` bits"."""
    spark = fps.sparkSession
    blocks = _rotations(budget)
    rot = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"shiftleft(fp, {s}) | {f'shiftrightunsigned(fp, {64 - s})' if s else '0L'}").alias("key")) for k, (s, _) in enumerate(blocks)])
    widths = F.array(*[F.lit(64 - w) for _, w in blocks])
    rows = fps.select(F.explode(rot).alias("r")).select("r.k", "r.key").select("k", "key", F.call_function("shiftrightunsigned", F.col("key"), F.element_at(widths, F.col("k") + 1)).alias("block"))
    # at most (budget + 1) * 2^13 counts, whatever the input: a bounded table, of which only the large ones are kept
    big = rows.groupBy("k", "block").count().where(F.col("count") > chunk).select("k", "block", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(big), ["k", "block"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("k", "block", "key", "own", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"))
    width = [w for _, w in blocks]
    shift = [s for s, _ in blocks]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        n = 0

        def groups(df: pd.DataFrame) -> pa.RecordBatch:
            out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for k in np.unique(df["k"]):
                part = df[df["k"] == k]
                keys, own = part["key"].to_numpy().view(np.uint64), part["own"].to_numpy()
                task = part[["block", "c1", "c2"]].to_numpy()
                order = np.lexsort((keys, own, task[:, 2], task[:, 1], task[:, 0]))
                keys, task, own = keys[order], task[order], own[order]
                cut = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]).any(axis=1)])
                for lo, hi in _runs(cut, len(keys), task):
                    ks, d, starts = keys[lo:hi], width[k], cut[(cut >= lo) & (cut < hi)] - lo
                    if task[lo, 1] == task[lo, 2]:  # tries with themselves; block after block, so sorted as a whole
                        r = np.stack([starts, np.r_[starts[1:], hi - lo]], 1)
                        up = trie_links(ks, r, r, d, budget)
                    else:  # two chunks of a trie: the chunk takes the place of the top bit, which they share
                        n = int((own[lo:hi] == task[lo, 1]).sum())
                        marked = (ks << np.uint64(1)) >> np.uint64(1)
                        marked[n:] |= np.uint64(1) << np.uint64(63)
                        up = trie_links(marked, np.array([[0, n]]), np.array([[n, len(ks)]]), d, budget + 1, 1)
                    child = np.flatnonzero(up != np.arange(len(up)))
                    s = np.uint64(shift[k])
                    for out, x in ((out_a, ks[child]), (out_b, ks[up[child]])):
                        out.append((x >> s) | (x << (np.uint64(64) - s)) if s else x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], ["a", "b"])

        for batch in batches:
            df = batch.to_pandas()
            if not len(df):
                continue
            held.append(df)
            n += len(df)
            if n > 400_000:  # sorted input: all but the last, perhaps unfinished task can go
                df = pd.concat(held, ignore_index=True)
                last = df.iloc[-1]
                tail = (df["k"] == last["k"]) & (df["block"] == last["block"]) & (df["c1"] == last["c1"]) & (df["c2"] == last["c2"])
                if not tail.all():
                    yield groups(df[~tail])
                held = [df[tail]]
                n = len(held[0])
        if held:
            yield groups(pd.concat(held, ignore_index=True))

    prepare(spark)
    cols = ["k", "block", "c1", "c2"]
    return rows.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(solve, "a long, b long")


def _runs(cut: np.ndarray, n: int, task: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of tries that are whole, together; the tasks of a trie in chunks one by one."""
    ends = np.r_[cut[1:], n]
    whole = (task[cut, 1] == 0) & (task[cut, 2] == 0)
    k = 0
    while k < len(cut):
        j = k + 1
        while whole[k] and j < len(cut) and whole[j]:
            j += 1
        yield int(cut[k]), int(ends[j - 1])
        k = j


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row, n_links as documents in the component."""
    fp = written(fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    # copies count once; the smallest doc_id of a fingerprint stands for it
    nodes = written(fp.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "fingerprint-nodes")
    comp = components(written(fingerprint_links(nodes, budget), "links"))
    joined = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "first", "copies", F.coalesce("component", "fp").alias("component"))
    ids = joined.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("copies").alias("component_size"))
    of_fp = joined.join(ids, "component").select("fp", "component_id", "component_size")
    return fp.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns of docs; rows without an id stay."""
    gone = written(simhash_components(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return docs.join(sized(gone, gone.count()), docs[id_col] == F.col("__gone"), "left_anti").select(*docs.columns)
