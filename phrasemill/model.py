"""The data model: words, sentences, tokens and n-grams as Spark columns.

A word is STRUCT<surface, lemma, pos>; undefined attributes are NULL and group with each other. A sentence is a row
(doc_id, sent, corpus, words); tokens and n-grams are exploded from it without a shuffle.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill import batches

ATTRS = ("surface", "lemma", "pos")
WORD = "struct<surface:string,lemma:string,pos:string>"
PUNCT = r"([.,;:!?()])"
SPACES = r"[ \t\r\f\x0B]+"
DETERMINERS = ("the", "a", "an", "der", "die", "das", "le", "la", "les", "el", "los", "un", "una", "une")
PREPOSITIONS = ("of", "in", "to", "for", "on", "at", "by", "with", "von", "zu", "mit", "auf", "de", "des", "du", "en", "par", "pour", "con", "por")
CONJUNCTIONS = ("and", "or", "but", "und", "oder", "et", "ou", "y", "o")


def split_words(line: Column) -> Column:
    """Surface forms of a line: punctuation stands alone, white space parts words."""
    return F.filter(F.split(F.regexp_replace(line, PUNCT, " $1 "), SPACES), lambda x: x != "")


def tag(lemma: Column) -> Column:
    """A deterministic part of speech for invented text; a punctuation mark is a word of its own."""
    ends = lambda *xs: reduce(lambda a, b: a | b, [lemma.endswith(x) for x in xs])
    return (
        F.when(lemma.isin(*".,;:!?()"), "PCT").when(lemma.isin(*DETERMINERS), "DT").when(lemma.isin(*PREPOSITIONS), "P").when(lemma.isin(*CONJUNCTIONS), "CC")
        .when(ends("ing", "ed"), "V").when(ends("ly"), "R").when(ends("able", "ous"), "A").otherwise("N")
    )


def tag_of(lemma: str) -> str:
    """tag() of a Python string."""
    if lemma in _TAGS:
        return _TAGS[lemma]
    return "V" if lemma.endswith(("ing", "ed")) else "R" if lemma.endswith("ly") else "A" if lemma.endswith(("able", "ous")) else "N"


_TAGS = {x: t for xs, t in ((CONJUNCTIONS, "CC"), (PREPOSITIONS, "P"), (DETERMINERS, "DT"), (".,;:!?()", "PCT")) for x in xs}  # the first of tag() is the last here


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df over all cores if it has less than a split for each of them; larger inputs stay as their files are split."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    conf = spark._jsparkSession.sessionState().conf()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * conf.filesMaxPartitionBytes() else df.repartition(2 * cores, by)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpus_col: str = "lang", attrs: tuple[str, ...] = ATTRS) -> DataFrame:
    """(doc_id, sent, corpus, words): every line of a text is a sentence; null texts have none. Only the attributes that
    are asked for are made."""
    lean = dealt(docs.select(F.col(id_col).alias("doc_id"), F.col(corpus_col).alias("corpus"), F.col(text_col).cast("string").alias("text")).where("text is not null"), "doc_id")
    kinds = {c: lean.schema[c].dataType.simpleString() for c in ("doc_id", "corpus")}
    word = ",".join(f"{a}:string" for a in attrs)
    out = lean.mapInArrow(lambda bs: batches.sentences(bs, attrs, tag_of), f"doc_id {kinds['doc_id']}, sent long, corpus {kinds['corpus']}, words array<struct<{word}>>")
    out.texts = lean  # for counting(), which needn't see the words of sentences just made
    return out


def tokens(sents: DataFrame) -> DataFrame:
    """(doc_id, sent, corpus, i, surface, lemma, pos), i from 0."""
    return sents.select("doc_id", "sent", "corpus", F.posexplode("words").alias("i", "w")).select("doc_id", "sent", "corpus", F.col("i").cast("long").alias("i"), "w.*")


def attribute(words: Column, name: str) -> Column:
    return F.transform(words, lambda w: w[name])


def slices(words: Column, n: int) -> Column:
    """All runs of n neighbouring elements, in order."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda k: F.slice(words, k, n))).otherwise(F.filter(F.array(words), lambda _: F.lit(False)))


def counting(sents: DataFrame, attr: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """What run makes of batches (extra..., a), a list of words per sentence. Texts are cut in the same step, if sents is a
    table that sentences() gave, as it is."""
    lean = getattr(sents, "texts", None)
    kinds = "".join(f"`{c}` {sents.schema[c].dataType.simpleString()}, " for c in extra)
    if lean is not None and attr in ("surface", "lemma") and set(extra) <= {"doc_id", "corpus"}:
        return lean.mapInArrow(lambda bs: run(batches.lists(bs, attr, extra)), kinds + schema)
    return sents.select(*extra, attribute(F.col("words"), attr).alias("a")).mapInArrow(run, kinds + schema)


def gram_counts(sents: DataFrame, lo: int, hi: int, attr: str = "lemma", sep: str = " ", extra: tuple[str, ...] = ()) -> DataFrame:
    """(extra..., n, ngram, cnt) of the runs of lo..hi words, never across sentences; counted in batches, then summed up."""
    rows = counting(sents, attr, lambda bs: batches.gram_counts(bs, lo, hi, sep, extra), "n int, ngram string, cnt long", extra)
    return summed(rows, [*extra, "n", "ngram"], "cnt")


def summed(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counts of batches summed up behind the shuffle: before it, there is little left to add."""
    return rows.repartition(*keys).groupBy(*keys).agg(F.sum(count).alias(count))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, corpus_col: str = "lang", attrs: tuple[str, ...] = ATTRS) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), corpus_col=corpus_col, attrs=attrs)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a temporary one only in a local session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="phrasemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/phrasemill-{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


_scratch: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _scratch:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may have ended before
            return


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, in a folder per value of `by`: made once, however often it is read."""
    path = scratch(df.sparkSession, name)
    w = df.write
    (w.partitionBy(*by) if by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcasting if it is counted to have few rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
