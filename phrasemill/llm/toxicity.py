"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to Latin ones, reads digits and signs
used as letters as those letters, and turns other punctuation into spaces. Lexicon entries are beginnings of words. A
text's score grows with the weights of its entries over a slowly growing function of its length; places inside an
exception phrase don't count.

The lexicon is learned: word beginnings frequent in toxic and rare in other labelled texts, chosen greedily by the toxic
texts that they newly cover, with smoothed log-odds as weights, beside a small seed list whose weights are learned too
where it occurs. At most `fit_rows` labelled rows are fitted on, the smallest by a hash of the id.

Defined results: null and empty texts have the lowest score; null doc_ids are scored and count as not held out; repeated
rows are scored each; without labels the seed list alone is used; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.bpe import parts_of
from phrasemill.llm.common import prepare

FIT_ROWS, LENGTHS, PRECISION, THRESHOLD = 20_000, (4, 5, 6, 8, 11), 0.9, 0.3
SEED = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser", "trash", "clown", "imbecile", "dumbass")
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "pathetic fallacy", "circus clown", "class clown", "sore loser rule", "loser bracket", "stupid simple")

_LOOKS = {
    **dict(zip("авеёкмнорстухіјѕԁһӏѵԝ", "abeekmhopctyxijsdhlvw", strict=True)),
    **dict(zip("αβεικνορτυχγωη", "abeikvoptuxywn", strict=True)),
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ⅰ": "i", "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
}
_TABLE = str.maketrans(_LOOKS)
_FOREIGN = re.compile("[­ıłøđħɐ-ʯͰ-֏​-‍℀-ↈ﻿！-～\U0001d400-\U0001d7ff]")
_SIGNS = bytearray(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
for _a, _b in zip(b"0134578@$", b"oieastbas", strict=True):
    _SIGNS[_a] = _b
_SIGNS = bytes(_SIGNS)


def folded(text: str | None) -> str:
    """The folded text, words parted by spaces, one in front; UTF-8 bytes read as Latin-1."""
    t = (text or "").lower()
    if not t.isascii() and _FOREIGN.search(t):
        t = "".join(unicodedata.normalize("NFKC", c) if "℀" <= c <= "ↈ" or "！" <= c <= "～" or c >= "\U0001d400" else c for c in t).lower().translate(_TABLE)
    return " " + " ".join(t.encode("utf-8", "replace").translate(_SIGNS).decode("latin-1").split(" "))


class Lexicon:
    """Entries (folded beginnings of words) with weights, and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        self.weights = weights
        self.trie = ahocorasick.Automaton()
        for e, w in weights.items():
            self.trie.add_word(" " + e, (len(e), w, e))
        self.free = [" ".join(folded(x).split()) for x in exceptions]
        for x in self.free:
            self.trie.add_word(" " + x + " ", (len(x), None, x))
        self.trie.make_automaton()

    def hits(self, text: str) -> list[tuple[int, float, str]]:
        """(place, weight, entry): the heaviest entry at each word outside of exception phrases; text is folded."""
        if not self.weights:
            return []
        best: dict[int, tuple[float, str]] = {}
        free: list[tuple[int, int]] = []
        for end, (n, w, e) in self.trie.iter(text + " "):
            if w is None:
                free.append((end - n, end))
            elif (at := end - n + 1) not in best or best[at][0] < w:
                best[at] = (w, e)
        return [(at, w, e) for at, (w, e) in sorted(best.items()) if not any(a <= at < b for a, b in free)]

    def score(self, text: str | None) -> float:
        t = folded(text)
        total = sum(w for _, w, _ in self.hits(t))
        return 0.01 + 0.99 * (1 - math.exp(-0.35 * total / (1 + 0.1 * math.log1p(len(t) / 6)))) if total > 0 else 0.01


def beginnings(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(text.split()):
        if len(w) >= 4:
            out.update(w[:n] for n in LENGTHS if n < len(w))
            out.add(w[:24])
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> dict[str, float]:
    """Weights of lexicon entries. What reaches the driver is bounded by fit_rows, not by the tables."""
    prepare(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    rows = rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    fit = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id").select("id", "y", "text")
    totals = {r["y"] > 0: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = totals.get(True, 0), totals.get(False, 0)
    seeds = {" ".join(folded(s).split()): 4.0 for s in SEED}
    if not n_toxic or not n_other:
        return seeds
    least = max(5, math.ceil(0.006 * n_toxic))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                c.update(beginnings(folded(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["entry", "n"])

    proposed = fit.where("y > 0").select("text").mapInArrow(propose, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = {r["entry"] for r in proposed.collect()} | set(seeds)
    probe = Lexicon(dict.fromkeys(found, 1.0), ())
    keys = sorted(found)
    number = {e: k for k, e in enumerate(keys)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other: Counter[int] = Counter()
        for b in batches:
            rows = []
            for y, t in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                own = {number[e] for _, (_, _, e) in probe.trie.iter(folded(t.as_py()) + " ")}
                if y > 0:
                    rows.append(sorted(own))
                else:
                    other.update(own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int64()), pa.array([-1] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["n", "e", "own"])
        yield pa.RecordBatch.from_arrays([pa.array(list(other.values()), pa.int64()), pa.array(list(other), pa.int64()), pa.array([[]] * len(other), pa.list_(pa.int32()))], ["n", "e", "own"])

    both = fit.mapInArrow(incidence, "n long, e long, own array<int>").persist()
    others = Counter({r["e"]: r["n"] for r in both.where("e >= 0").groupBy("e").agg(F.sum("n").alias("n")).collect()})
    bad = {k for k in others if others[k] > 0}
    left = [set(r["own"]) for r in both.where("e < 0").select("own").collect()]
    both.unpersist()
    count = Counter(k for own in left for k in own)
    good = {k for k in count if k not in bad or count[k] / (count[k] + others[k] * n_toxic / max(n_other, 1) + 0.0) >= PRECISION and count[k] / (count[k] + others[k]) >= 0.5}
    left = [own & good for own in left]
    weights = dict(seeds)
    chosen: list[int] = []
    while True:  # greedy cover: the texts that an entry newly covers, less three for every other text that it is in
        fresh = Counter(k for own in left for k in own)
        gain = {k: n - 3 * others[k] for k, n in fresh.items()}
        top = max(gain.values(), default=0)
        if top < least:
            break
        k = min((k for k in gain if gain[k] == top), key=lambda k: (others[k], len(keys[k]), keys[k]))
        chosen.append(k)
        left = [own for own in left if k not in own]
    for k in {*chosen, *(number[s] for s in seeds)}:
        if count[k] or others[k]:
            w = math.log((count[k] + 0.5) / (n_toxic + 1)) - math.log((others[k] + 0.5) / (n_other + 1))
            weights[keys[k]] = max(0.0, w)
    return {e: w for e, w in weights.items() if w > 0}


def toxicity(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the entries found, of every row."""
    prepare(docs.sparkSession)
    made: list[Lexicon] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made[:] = made or [Lexicon(weights)]
        lexicon = made[0]
        for b in batches:
            for lo, texts in parts_of(b.column(2)):
                scores = [lexicon.score(t) for t in texts]
                found = [",".join(sorted({e.encode("latin-1").decode("utf-8", "replace") for _, _, e in lexicon.hits(folded(t))})) if s > 0.01 else "" for t, s in zip(texts, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), b.column(1).slice(lo, len(texts)), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found)], ["doc_id", "held_out", "score", "predicted", "entries"])

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return lean.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, entries string")
