"""Quality classifier: interpolated modified Kneser-Ney models of words and of UTF-8 bytes, trained on trusted text.

Words: pairs of neighbouring words are counted in all trusted texts; a word's own count is the number of words that it
follows. A log probability is a sum over what a position has: the word, the word before as a context, and the pair if it
was seen. So the model is one table key -> (value as predicted, value as context), in parts by the rest of the key. At most
`FREQUENT` keys of the highest counts are also in a table that every worker holds and looks in first. The distinct other words
and pairs of all documents go packed to the worker of their part, which reads it, and the sums packed to that of their
document, for a share of the documents after the other (`ROUNDS`). No worker holds the model, and the driver gathers nothing.

Bytes: counts of the highest order are combined per task, then summed by key; lower orders count distinct left extensions;
contexts are aggregated and joined back by key. N-grams of a few bytes saturate, so this model stays small; it is written
in shards by the two bytes before the predicted one, and a worker scores about `HELD` letters shard by shard and holds one at
a time. It knows the spelling of words that the other has never seen.

Of each model, a document's score is its mean surprise per word or byte, drawn to the language's mean by `WORD_PRIOR` words'
or `PRIOR` bytes' worth, so that short texts aren't judged on a little; the perplexities are the plain ones. A document is
rejected if one of the scores is above its language's quantile of the scores of trusted documents that the counts leave
out (1 of `FOLD` by a hash of the id), plus a margin. Languages with fewer than `FEW` of these take the quantile over all
languages.

Defined results: null and empty texts have perplexity 1, and are kept; null languages are one language; null doc_ids are
never trusted and are scored; repeated rows are scored each; without trusted text every document is kept with null scores;
an empty table gives an empty table. Words and pairs are told apart by 64-bit hashes, and documents, in the word model, by one
of id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm.bpe import parts_of
from phrasemill.llm.common import drop_written, new_path, prepare, released, sized, written
from phrasemill.llm.passages import packed, unpacked, word_ids

ORDER, PRIOR, FOLD, QUANTILE, MARGIN, FEW, SHARD_ROWS = 5, 200, 8, 0.995, 0.05, 50, 3_000_000
PART = 2_000_000
WORD_PRIOR, WORD_MARGIN, UNSEEN, ROUNDS, COUNT_ROUNDS, ROUND_DOCS, HELD = 20, 0.1, 20, 12, 2, 20_000_000, 16_000_000
FREQUENT, STEPS = 500_000, 8  # keys that every worker holds; steps of their counts for each power of two
START, COUNT = 1, 0  # a word before the first one; the key of a row with the number of words


def codes(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram key of every byte of every text, number of bytes per text); each text starts after line ends."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lead = b"\n" * (order - 1)
    data = np.frombuffer(b"".join([lead + p for p in parts]) + lead, np.uint8)
    n = np.array([len(p) for p in parts], dtype=np.int64)
    key = np.zeros(len(data) - order + 1, dtype=np.int64)
    for k in range(order):
        key = (key << 8) | data[k : len(data) - order + 1 + k]
    own = np.ones(len(key), dtype=bool)
    ends = np.cumsum(n + order - 1)
    for k in range(1, order):
        own[ends[ends - k < len(own)] - k] = False
    own[int(n.sum() + (order - 1) * len(n)) - (order - 1) :] = False
    return key[own], n


def count(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n): how often each byte n-gram of the highest order comes in all texts (column text)."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            k, n = np.concatenate(keys), np.concatenate(counts)
            o = np.argsort(k, kind="stable")
            k, n = k[o], n[o]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            return k[first], np.add.reduceat(n, first)

        size = 0
        for b in batches:
            for _, part in parts_of(b.column(0), PART):
                k, _ = codes(part, order)
                if len(k):
                    u, n = np.unique(k, return_counts=True)
                    keys.append(u), counts.append(n)
                    size += len(u)
            if size > 4_000_000:
                k, n = fold()
                if len(k) > 2_000_000:  # as much as a worker holds: the rest is combined after the shuffle
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
                    keys, counts, size = [], [], 0
                else:
                    keys, counts, size = [k], [n], len(k)
        if keys:
            k, n = fold()
            for lo in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], ["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more; plain ones where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        return d, d, d
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def estimate(top: DataFrame, order: int = ORDER) -> DataFrame:
    """The model from the counts (key, n) of the highest order: rows (tag, key, value).

    tag k: log probability of the n-gram of k bytes; tag 8 + k: log weight that its context of k - 1 bytes leaves to shorter ones.
    """
    mask = lambda k: (1 << (8 * k)) - 1
    counts = {order: written(top, "kn-counts")}
    for k in range(order - 1, 0, -1):
        counts[k] = written(counts[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask(k))).alias("key")).agg(F.count("*").alias("n")), "kn-counts")
    stats = {k: counts[k].agg(*[F.count_if(F.col("n") == c) for c in (1, 2, 3, 4)]).first() for k in counts}
    out = None
    lower: DataFrame | None = None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(*stats[k])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts[k].withColumn("context", F.shiftright("key", 8))
        ctx = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("free"))
        joined = rows.join(ctx, "context").withColumn("own", (F.col("n") - cut) / F.col("total")).withColumn("left", F.col("free") / F.col("total"))
        if lower is None:
            prob = joined.select("key", (F.col("own") + F.col("left") / 256).alias("p"))
        else:
            prob = joined.withColumn("suffix", F.col("key").bitwiseAND(F.lit(mask(k - 1)))).join(lower.withColumnRenamed("key", "suffix"), "suffix").select("key", (F.col("own") + F.col("left") * F.col("p")).alias("p"))
        lower = written(prob, "kn-prob")
        part = lower.select(F.lit(k).alias("tag"), "key", F.log("p").alias("value")).unionByName(ctx.select(F.lit(8 + k).alias("tag"), F.col("context").alias("key"), F.log(F.col("free") / F.col("total")).alias("value")))
        out = part if out is None else out.unionByName(part)
    return out


def shard_of(two: Column | np.ndarray, shards: int):
    """The shard of the two bytes before the predicted one."""
    if isinstance(two, Column):
        return F.pmod(two * 40503, F.lit(65536)) % shards
    return (two * 40503 % 65536) % shards


def store(model: DataFrame, order: int = ORDER) -> tuple[str, int]:
    """Write the model in shards; (path, number of shards)."""
    spark = model.sparkSession
    model = written(model, "kn-model")
    shards = max(1, math.ceil(model.count() / SHARD_ROWS))
    two = F.when(F.col("tag") < 8, F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(F.lit(65535))
    small = (F.col("tag") <= 2) | F.col("tag").between(9, 11)  # up to 65,536 of each
    path = new_path(spark, "kn-shards")
    placed = model.withColumn("shard", F.explode(F.when(small, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(shard_of(two, shards).cast("int")))))
    placed.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    return path, shards


class Table:
    """Open addressing over sorted home places: key -> value."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        home = self.home(keys)
        order = np.argsort(home, kind="stable")
        place = np.arange(len(keys)) + np.maximum.accumulate(home[order] - np.arange(len(keys))) if len(keys) else np.zeros(0, np.int64)
        size = int(max((1 << self.bits), place[-1] + 1 if len(keys) else 0)) + 2
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.zeros(size, dtype=np.float32)
        self.keys[place], self.values[place] = keys[order], values[order]

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, found) of each key."""
        at = self.home(keys)
        seen = self.keys[at]
        found = seen == keys
        value = np.where(found, self.values[at], np.float32(0))
        open_ = np.flatnonzero(~found & (seen != -1))
        at = at[open_]
        while len(open_):
            at = at + 1
            seen = self.keys[at]
            hit = seen == keys[open_]
            value[open_[hit]], found[open_[hit]] = self.values[at[hit]], True
            more = ~hit & (seen != -1)
            open_, at = open_[more], at[more]
        return value, found


class Shard:
    def __init__(self, path: str, shard: int, order: int) -> None:
        base, root = fs.FileSystem.from_uri(path)
        files = [f.path for f in base.get_file_info(fs.FileSelector(f"{root}/shard={shard}", recursive=True)) if f.path.endswith(".parquet")]
        t = pa.concat_tables([pq.ParquetFile(base.open_input_file(f)).read() for f in files]) if files else pa.table({"tag": [], "key": [], "value": []})
        tag, key, value = (t.column(c).to_numpy() for c in ("tag", "key", "value"))
        tag, key = tag.astype(np.int64), key.astype(np.int64)
        self.grams = {k: Table(key[tag == k], value[tag == k]) for k in range(1, order + 1)}
        self.left = {k: Table(key[tag == 8 + k], value[tag == 8 + k]) for k in range(1, order + 1)}
        self.order = order
        root_left = value[tag == 9]
        self.floor = (float(root_left[0]) if len(root_left) else 0.0) - math.log(256)

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each key after the others."""
        out, found = self.grams[self.order].get(keys)
        open_ = np.flatnonzero(~found)
        rest = np.zeros(len(open_), dtype=np.float32)
        for k in range(self.order - 1, -1, -1):
            if not len(open_):
                return out
            own = keys[open_]
            v, _ = self.left[k + 1].get((own >> 8) & ((1 << (8 * k)) - 1))  # an unseen context leaves all: log 1
            rest = rest + v
            if not k:
                # the weight of the empty context is part of the floor
                out[open_] = rest - v + np.float32(self.floor)
                return out
            v, found = self.grams[k].get(own & ((1 << (8 * k)) - 1))
            out[open_[found]] = v[found] + rest[found]
            open_, rest = open_[~found], rest[~found]
        return out


_held: dict[str, Shard] = {}


def shard(path: str, k: int, order: int) -> Shard:
    """One shard of one model at a time."""
    name = f"{path}#{k}"
    if name not in _held:
        _held.clear()
        _held[name] = Shard(path, k, order)
    return _held[name]


def surprise(docs: DataFrame, model: tuple[str, int], columns: list[str], text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The given columns with n_bytes and nll (sum of -log probabilities) of each row."""
    prepare(docs.sparkSession)
    path, shards = model
    lean = docs.select(*columns, F.col(text_col).alias("__text"))
    schema = lean.drop("__text").schema.add("n_bytes", "long").add("nll", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if shards == 1 else _merged(batches, HELD):
            n_bytes, nll = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for lo, texts in parts_of(b.column(b.num_columns - 1), PART if shards == 1 else HELD):
                keys, n = codes(texts, order)
                n_bytes[lo : lo + len(texts)] = n
                if not len(keys):
                    continue
                row = np.repeat(np.arange(len(texts)), n)
                if shards == 1:
                    p = shard(path, 0, order).log_probs(keys)
                else:
                    p = np.zeros(len(keys), np.float32)
                    place = shard_of((keys >> 8) & 65535, shards)
                    for k in range(shards):
                        own = np.flatnonzero(place == k)
                        if len(own):
                            p[own] = shard(path, k, order).log_probs(keys[own])
                nll[lo : lo + len(texts)] = -np.bincount(row, weights=p, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n_bytes), pa.array(nll)], [*columns, "n_bytes", "nll"])

    return lean.mapInArrow(run, schema)


def _merged(batches: Iterator[pa.RecordBatch], letters: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts (the last column) have so many bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.column(b.num_columns - 1).nbytes
        if size >= letters:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield from t


# words ---------------------------------------------------------------------------------------------------------------

_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hashed(*longs: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for these long columns."""
    h = np.full(len(longs[0]), 42, dtype=np.uint64)
    for x in longs:
        h = h + _P[4] + np.uint64(8)
        h = _rot(h ^ (_rot(x.astype(np.int64).view(np.uint64) * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def pairs_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, number of words per text) of every word in every text; before the first is START."""
    ids, n = word_ids(texts)
    own = ids.view(np.int64)
    before = np.r_[np.int64(START), own[:-1]] if len(own) else own
    first = (np.cumsum(n) - n)[n > 0]
    before[first] = START
    return before, own, n


def count_pairs(texts: DataFrame) -> DataFrame:
    """(a, b, n): how often each pair of neighbouring words comes in all texts (column text); equal pairs of a part are
    combined first. Pairs are counted for a share of the words after the other, which bounds the disk that it takes."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
        for b in _merged(batches, 4 * PART):
            for _, part in parts_of(b.column(0), 4 * PART):
                x, y, _ = pairs_of(part)
                own = y % COUNT_ROUNDS == share
                x, y = x[own], y[own]
                o = np.lexsort((y, x))
                x, y = x[o], y[o]
                at = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
                n = np.diff(np.r_[at, len(x)])
                for lo in range(0, len(at), 100_000):
                    own = at[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(x[own]), pa.array(y[own]), pa.array(n[lo : lo + 100_000])], ["a", "b", "n"])

    out = None
    for k in range(COUNT_ROUNDS):
        own = written(texts.select("text").mapInArrow(lambda b, k=k: run(b, k), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "kn-pairs")
        out = own if out is None else out.unionByName(own)
    return out


def _cut(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def estimate_words(pairs: DataFrame) -> tuple[str, int]:
    """The word model (key, predicted, context) of the counts (a, b, n); the row of key COUNT has the log probability of
    an unseen word. The sum of what a text's words and pairs have is its log probability. (path, number of parts by the rest of
    the key); in part -1 are copies of the most frequent keys. The tables of pairs are deleted, each when it was read."""
    few = lambda df: discounts(*df.agg(*[F.count_if(F.col("n") == c) for c in (1, 2, 3, 4)]).first())
    ones = written(pairs.groupBy("b").agg(F.count("*").alias("n")), "kn-words")
    d2, d1 = few(pairs), few(ones)
    total = ones.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(_cut(F.col("n"), d1)).alias("free")).first()
    rest = total["free"] / total["n"] / (UNSEEN * total["v"])  # of each unseen word
    words = ones.select("b", F.log((F.col("n") - _cut(F.col("n"), d1)) / total["n"] + rest).alias("p"))
    contexts = pairs.groupBy("a").agg(F.sum("n").alias("t"), F.sum(_cut(F.col("n"), d2)).alias("free"))
    contexts = written(contexts.select("a", "t", F.log(F.col("free") / F.col("t")).alias("left")), "kn-contexts")
    single = words.withColumnRenamed("b", "w").join(contexts.select(F.col("a").alias("w"), "left", "t"), "w", "full")
    floor = math.log(rest)
    out = single.select(F.xxhash64("w").alias("key"), F.coalesce(F.col("p") - floor, F.lit(0.0)).cast("float").alias("predicted"), F.coalesce("left", F.lit(0.0)).cast("float").alias("context"), F.coalesce("t", F.lit(0)).alias("n"))
    out = out.unionByName(pairs.sparkSession.createDataFrame([(COUNT, floor, 0.0, 2**62)], "key long, predicted float, context float, n long"))
    made = new_path(pairs.sparkSession, "kn-values")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _append(out, made, parts)
    for folder in sorted({f.rsplit("/", 1)[0] for f in pairs.inputFiles()}):
        share = pairs.sparkSession.read.schema(pairs.schema).parquet(folder)
        for k in range(2):
            own = share.where(F.pmod(F.xxhash64("b"), F.lit(2)) == k).join(contexts.hint("shuffle_hash"), "a").join(words.hint("shuffle_hash"), "b")
            p = (F.col("n") - _cut(F.col("n"), d2)) / F.col("t") + F.exp(F.col("left") + F.col("p"))
            _append(own.select(F.xxhash64("a", "b").alias("key"), (F.log(p) - F.col("left") - F.col("p")).cast("float").alias("predicted"), F.lit(0.0).cast("float").alias("context"), "n"), made, parts)
        drop_written(share)
    drop_written(ones, contexts)
    _copy_frequent(pairs.sparkSession, made)
    return made, parts


def _copy_frequent(spark: SparkSession, path: str) -> None:
    """Copy the keys of the highest counts, at most FREQUENT and COUNT, to part -1 of the word model."""
    values = spark.read.schema("key long, predicted float, context float, n long").parquet(path)
    values = values.withColumn("step", F.floor(F.log2(F.greatest("n", F.lit(1))) * STEPS))
    kept, least = 0, 62 * STEPS
    for step, n in values.groupBy("step").count().orderBy(F.desc("step")).collect():  # of which there are few
        kept += n
        if kept > FREQUENT:
            break
        least = step
    with released(spark):
        values.where(F.col("step") >= least).drop("step").repartition(1).write.parquet(f"{path}/part=-1")


def _append(values: DataFrame, path: str, parts: int) -> None:
    """Add values to the word model at path, which lies in parts by the rest of the key, each file by key."""
    with released(values.sparkSession):
        placed = values.withColumn("part", F.pmod("key", F.lit(parts)).cast("int")).repartitionById(parts, "part")
        placed.sortWithinPartitions("part", "key").write.mode("append").partitionBy("part").parquet(path)


def _values(path: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, predicted, context) of a part, by key."""
    base, root = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in base.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True, recursive=True)) if f.path.endswith(".parquet"))
    tables = [pq.ParquetFile(base.open_input_file(f)).read(["key", "predicted", "context"]) for f in files]
    key, predicted, context = (np.concatenate([np.zeros(0, kind), *[t.column(c).to_numpy() for t in tables]]) for c, kind in (("key", np.int64), ("predicted", np.float32), ("context", np.float32)))
    order = np.argsort(key, kind="stable")
    return key[order], predicted[order], context[order]


SEEN = np.dtype([("rid", "<i8"), ("key", "<i8"), ("n", "<i4"), ("c", "<i4")])
LOCAL = -1  # c of a record with what a document has in the frequent keys: its bits of nll as key, and its number of words
SUMS = np.dtype([("rid", "<i8"), ("nll", "<f8"), ("n", "<i8")])


_frequent: dict[str, tuple[Table, np.ndarray, np.ndarray]] = {}


def frequent(path: str) -> tuple[Table, np.ndarray, np.ndarray]:
    """(place by key, predicted, context) of the frequent keys of one model at a time."""
    if path not in _frequent:
        _frequent.clear()
        key, predicted, context = _values(path, -1)
        _frequent[path] = Table(key, np.arange(len(key))), predicted, context
    return _frequent[path]


def word_surprise(docs: DataFrame, model: tuple[str, int], rid: str = "rid", text_col: str = "text") -> DataFrame:
    """(rid, word_nll, n_words): the sum of -log probabilities of the words of the rows with this rid; no row without words.

    Frequent words and pairs are looked up at once; others go to the part of the model that has their keys, and sums back to
    their documents, packed.
    """
    prepare(docs.sparkSession)
    path, parts = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _merged(batches, PART):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, texts in parts_of(b.column(1), PART):
                before, own, n = pairs_of(texts)
                if not len(own):
                    continue
                row = np.repeat(np.arange(len(texts)), n)
                some = np.flatnonzero(n)
                table, predicted, context = frequent(path)
                word, pair = hashed(np.r_[np.int64(START), own]), hashed(before, own)
                back = np.arange(len(own))  # of the word before, after that at START
                back[(np.cumsum(n) - n)[some]] = 0
                at, known = table.get(word)
                at2, known2 = table.get(pair)
                at, at2 = at.astype(np.int64), at2.astype(np.int64)
                value = np.where(known[1:], predicted[at[1:]].astype(np.float64), 0) + np.where(known[back], context[at[back]], 0) + np.where(known2, predicted[at2], 0)
                floor = predicted[int(table.get(np.array([COUNT]))[0][0])].astype(np.float64)
                local = np.zeros(len(some), SEEN)
                local["rid"], local["n"], local["c"] = ids[lo + some], n[some], LOCAL
                local["key"] = (-np.bincount(row, value, len(texts))[some] - floor * n[some]).view(np.int64)
                rare, rare_back, rare2 = ~known[1:], ~known[back], ~known2
                rows = np.r_[row[rare], row[rare_back], row[rare2]]
                keys = np.r_[word[1:][rare], word[back][rare_back], pair[rare2]]
                pred = np.ones(len(keys), np.int32)
                pred[np.count_nonzero(rare) : len(keys) - np.count_nonzero(rare2)] = 0
                part = keys % parts
                # keys that are equal here by chance are not joined, which does no harm
                near = (part.astype(np.uint64) << np.uint64(52)) | ((rows.astype(np.uint64) & np.uint64((1 << 20) - 1)) << np.uint64(32)) | (keys.view(np.uint64) >> np.uint64(32))
                o = np.argsort(near)
                rows, keys, part, pred = rows[o], keys[o], part[o], pred[o]
                at = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]) if len(keys) else np.zeros(0, np.int64)
                out = np.zeros(len(at), SEEN)
                out["rid"], out["key"] = ids[lo + rows[at]], keys[at]
                if len(at):
                    out["n"] = np.add.reduceat(pred, at)
                    out["c"] = np.diff(np.r_[at, len(keys)]) - out["n"]
                yield packed(np.r_[out, local], np.r_[part[at], local["rid"] % parts].astype(np.int32))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}  # a task has one part
        for b in batches:
            for part in np.unique(b.column("part").to_numpy()).tolist():
                held.setdefault(part, []).append(b.filter(pc.equal(b.column("part"), part)))
        for part, own in held.items():
            yield from score(part, own)

    def score(part: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = unpacked(iter(batches), SEEN)
        here = seen["c"] == LOCAL
        local, seen = seen[here], seen[~here]
        key, predicted, context = _values(path, part)
        if not len(key):
            key, predicted, context = np.zeros(1, np.int64), np.zeros(1, np.float32), np.zeros(1, np.float32)
        at = np.minimum(np.searchsorted(key, seen["key"]), len(key) - 1)
        known = key[at] == seen["key"]
        seen, at = seen[known], at[known]
        nll = -(seen["n"] * predicted[at].astype(np.float64) + seen["c"] * context[at].astype(np.float64))
        nll, count = np.r_[nll, local["key"].copy().view(np.float64)], np.r_[np.zeros(len(seen), np.int64), local["n"]]
        yield packed(out := _sums(np.r_[seen["rid"], local["rid"]], nll, count), (out["rid"] % parts).astype(np.int32))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpacked(batches, SUMS)
        x = _sums(x["rid"], x["nll"], x["n"])
        for lo in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[f][lo : lo + 100_000])) for f in SUMS.names], ["rid", "word_nll", "n_words"])

    out = None
    lean = docs.select(F.col(rid).alias("rid"), F.col(text_col).alias("text"))
    rounds = max(ROUNDS, math.ceil(docs.count() / ROUND_DOCS))
    for k in range(rounds):
        seen = lean.where(F.pmod("rid", F.lit(rounds)) == k).mapInArrow(run, "part int, data binary").repartitionById(parts, "part")
        own = seen.mapInArrow(look, "part int, data binary").repartitionById(parts, "part").mapInArrow(total, "rid long, word_nll double, n_words long")
        own = written(own, "kn-word-sums")
        out = own if out is None else out.unionByName(own)
    return out


def _sums(rid: np.ndarray, nll: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums by rid, added in the order of the values, so that they don't depend on that of the rows."""
    order = np.lexsort((nll, rid))
    rid = rid[order]
    at = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]]) if len(rid) else np.zeros(0, np.int64)
    out = np.zeros(len(at), SUMS)
    if len(at):
        out["rid"], out["nll"], out["n"] = rid[at], np.add.reduceat(nll[order], at), np.add.reduceat(n[order], at)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", order: int = ORDER) -> tuple[tuple[str, int], tuple[str, int] | None] | None:
    """(byte model, word model) of the trusted texts; None without any."""
    trusted = written(trusted_ids(labels, id_col, label_col).where("not calibrates").select("id"), "kn-trusted")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sized(trusted, trusted.count()), "id", "left_semi").select("text")
    top = written(count(text, order), "kn-top")
    if top.isEmpty():
        return None
    made = store(estimate(top, order), order)
    pairs = count_pairs(text)
    return made, None if pairs.isEmpty() else estimate_words(pairs)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, calibrates) of trusted documents; those that calibrate are not counted."""
    ok = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("q")).where("q = 1")
    return ok.select("id", (F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLD)) == 0).alias("calibrates"))


def _limits(known: DataFrame, nll: str, n: str, prior: int, quantile: float, margin: float) -> tuple[DataFrame, DataFrame]:
    """(group, mean, limit) per language, and the same over all languages in one row."""
    known = known.where(F.col(n) > 0)
    means = known.groupBy("group").agg((F.sum(nll) / F.sum(n)).alias("mean"))
    overall = known.agg((F.sum(nll) / F.sum(n)).alias("overall"))
    drawn = (F.col(nll) + prior * F.col("mean")) / (F.col(n) + prior)
    held = known.where("calibrates").join(_few_rows(means), "group").select("group", F.round(drawn, 3).alias("s"))
    at = held.groupBy("group").agg(F.percentile("s", quantile).alias("q"), F.count("*").alias("n"))
    all_at = held.agg(F.percentile("s", quantile).alias("q_all"))
    table = means.join(at, "group", "left").crossJoin(F.broadcast(all_at))  # one row
    limit = F.when(F.col("n") >= FEW, F.col("q")).otherwise(F.coalesce(F.greatest("q", "q_all"), F.lit(1e9))) + margin
    return table.select("group", "mean", limit.alias("limit")), overall.crossJoin(all_at).select("overall", (F.coalesce("q_all", F.lit(1e9)) + margin).alias("limit_all"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, score, threshold, n_words, word_perplexity, word_score, word_threshold, kept of every row."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    model = train(docs, labels, id_col, text_col, label_col, order)
    shown = ["doc_id", "lang", "n_bytes", "perplexity", "score", "threshold", "n_words", "word_perplexity", "word_score", "word_threshold", "kept"]
    if model is None:
        null = {c: F.lit(None).cast("double") for c in ("perplexity", "score", "threshold", "word_perplexity", "word_score", "word_threshold")}
        return plain.withColumns({**null, "n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), "n_words": F.lit(None).cast("long"), "kept": F.lit(True)}).select(*shown)
    raw = written(surprise(plain, model[0], ["doc_id", "lang", "rid"], order=order), "kn-scores")
    if model[1] is None:
        raw = raw.withColumns({"word_nll": F.lit(0.0), "n_words": F.lit(0).cast("long")})
    else:
        sums = word_surprise(plain, model[1])
        # rows that repeat share a rid; their sums and numbers of words are multiples of one row's, and so is no mean
        copies = raw.groupBy("rid").agg(F.count("*").alias("k")).where("k > 1")
        joined = raw.join(sums, "rid", "left").join(copies, "rid", "left")
        raw = joined.withColumns({"word_nll": F.coalesce(F.col("word_nll") / F.coalesce("k", F.lit(1)), F.lit(0.0)), "n_words": F.coalesce((F.col("n_words") / F.coalesce("k", F.lit(1))).cast("long"), F.lit(0))}).drop("k")
    raw = written(raw.withColumn("group", F.coalesce("lang", F.lit(""))), "kn-both-scores")
    flags = trusted_ids(labels, id_col, label_col)
    known = raw.join(flags, raw["doc_id"] == flags["id"]).select("group", "n_bytes", "nll", "n_words", "word_nll", "calibrates")
    out = raw
    for nll, n, prior, m, name, plain_name, limit_name in (("nll", "n_bytes", PRIOR, margin, "score", "perplexity", "threshold"), ("word_nll", "n_words", WORD_PRIOR, WORD_MARGIN, "word_score", "word_perplexity", "word_threshold")):
        limits, rest = _limits(known, nll, n, prior, quantile, m)
        out = out.join(_few_rows(limits), "group", "left").crossJoin(F.broadcast(rest))  # one row
        s = F.when(F.col(n) == 0, 0.0).otherwise((F.col(nll) + prior * F.coalesce("mean", "overall")) / (F.col(n) + prior))
        p = F.when(F.col(n) == 0, 1.0).otherwise(F.exp(F.col(nll) / F.col(n)))
        out = out.withColumns({name: s, plain_name: p, limit_name: F.coalesce("limit", "limit_all")}).drop("mean", "limit", "overall", "limit_all")
    fine = F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)) & F.coalesce(F.col("word_score") <= F.col("word_threshold"), F.lit(True))
    return out.withColumn("kept", fine).select(*shown)


def _few_rows(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, a row per language, marked for broadcasting if it is counted to be small; else joined by a shuffle."""
    df = written(df, "kn-languages")
    return sized(df, df.count(), most)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the classifier keeps, with all columns of docs."""
    gone = written(score(docs, labels, id_col, text_col, lang_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "kn-rejected")
    return docs.join(sized(gone, gone.count()), docs[id_col] == F.col("__gone"), "left_anti").select(*docs.columns)
