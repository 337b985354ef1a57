"""Token counts over a stream of documents: the batch plan on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill import model


def documents(spark: SparkSession, path: str, schema_of: str) -> DataFrame:
    """Parquet files that appear in a folder, with the schema of a known file."""
    return spark.readStream.schema(spark.read.parquet(schema_of).schema).parquet(path)


def token_counts(docs: DataFrame) -> DataFrame:
    """(corpus, lemma, cnt), updated as files arrive; state is one row per word, partially aggregated before the shuffle."""
    sents = model.sentences(docs)
    return sents.select("corpus", F.explode(model.attribute(F.col("words"), "lemma")).alias("lemma")).groupBy("corpus", "lemma").agg(F.count("*").alias("cnt"))
