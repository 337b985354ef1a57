"""Agreement between raters: (item, rater, category) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pairs(r: DataFrame) -> DataFrame:
    a, b = r.select("item", F.col("rater").alias("r1"), F.col("category").alias("k1")), r.select("item", F.col("rater").alias("r2"), F.col("category").alias("k2"))
    return a.join(b, "item").where("r1 < r2")


def pairwise(r: DataFrame) -> DataFrame:
    """(r1, r2, ao, s, pi, kappa) of every pair of raters."""
    cells = _pairs(r).groupBy("r1", "r2", "k1", "k2").agg(F.count("*").alias("n"))
    ni = r.select("item").distinct().agg(F.count("*").alias("ni"))
    nk = r.select("category").distinct().agg(F.count("*").alias("nk"))
    ao = cells.groupBy("r1", "r2").agg(F.sum(F.when(F.col("k1") == F.col("k2"), F.col("n")).otherwise(0)).alias("same"))
    row, col = cells.groupBy("r1", "r2", F.col("k1").alias("k")).agg(F.sum("n").alias("row")), cells.groupBy("r1", "r2", F.col("k2").alias("k")).agg(F.sum("n").alias("col"))
    m = row.join(col, ["r1", "r2", "k"], "full").fillna(0, ["row", "col"]).groupBy("r1", "r2").agg(F.sum((F.col("row") + F.col("col")) * (F.col("row") + F.col("col"))).alias("sq"), F.sum(F.col("row") * F.col("col")).alias("prod"))
    t = ao.join(m, ["r1", "r2"]).crossJoin(F.broadcast(ni)).crossJoin(F.broadcast(nk))
    o = F.col("same") / F.col("ni")
    chance = {"s": 1 / F.col("nk"), "pi": F.col("sq") / (4.0 * F.col("ni") * F.col("ni")), "kappa": F.col("prod") / (F.col("ni") * F.col("ni"))}
    return t.select("r1", "r2", o.alias("ao"), *[F.when(e < 1, (o - e) / (1 - e)).alias(k) for k, e in chance.items()])


def pairwise_weighted(r: DataFrame, distances: DataFrame) -> DataFrame:
    """(r1, r2, weighted_kappa); distances: (k1, k2, d) of every pair of categories."""
    ni = r.select("item").distinct().agg(F.count("*").alias("ni"))
    cells = _pairs(r).groupBy("r1", "r2", "k1", "k2").agg(F.count("*").alias("n"))
    row, col = cells.groupBy("r1", "r2", "k1").agg(F.sum("n").alias("row")), cells.groupBy("r1", "r2", "k2").agg(F.sum("n").alias("col"))
    seen = cells.join(distances, ["k1", "k2"]).groupBy("r1", "r2").agg(F.sum(F.col("d") * F.col("n")).alias("od"), F.max("d").alias("dmax"))
    chance = row.join(col, ["r1", "r2"]).join(distances, ["k1", "k2"]).groupBy("r1", "r2").agg(F.sum(F.col("d") * F.col("row") * F.col("col")).alias("ed"))
    t = seen.join(chance, ["r1", "r2"]).crossJoin(F.broadcast(ni))
    dmax = F.greatest("dmax", F.lit(1e-7))
    return t.select("r1", "r2", (1 - (F.col("od") / (dmax * F.col("ni"))) / F.when(F.col("ed") > 0, F.col("ed") / (dmax * F.col("ni") * F.col("ni")))).alias("weighted_kappa"))


def multi(r: DataFrame) -> DataFrame:
    """(ao, pi, kappa) over all raters: observed agreement, Fleiss' and the mean of chance by rater."""
    sizes = r.agg(F.countDistinct("item").cast("double").alias("ni"), F.countDistinct("rater").cast("double").alias("nc"))
    nik = r.groupBy("item", "category").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"))
    nk = r.groupBy("category").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    nck = r.groupBy("rater", "category").agg(F.count("*").alias("n"))
    # sum over c1 < c2 of n1 * n2 = (square of the sum - sum of squares) / 2
    cross = nck.groupBy("category").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("x")).agg(F.sum("x").alias("x"))
    t = sizes.crossJoin(nik).crossJoin(nk).crossJoin(cross)
    ni, nc = F.col("ni"), F.col("nc")
    ao = F.col("agree") / (ni * nc * (nc - 1))
    pi, kappa = F.col("sq") / (ni * nc * ni * nc), 2 * F.col("x") / (ni * ni * nc * (nc - 1))
    return t.select(ao.alias("ao"), ((ao - pi) / (1 - pi)).alias("pi"), ((ao - kappa) / (1 - kappa)).alias("kappa"))


def multi_weighted(r: DataFrame, distances: DataFrame) -> DataFrame:
    """(alpha, alpha_kappa) under category distances."""
    d = distances
    sizes = r.agg(F.countDistinct("item").cast("double").alias("ni"), F.countDistinct("rater").cast("double").alias("nc"))
    nik = r.groupBy("item", "category").agg(F.count("*").alias("n"))
    a, b = nik.select("item", F.col("category").alias("k1"), F.col("n").alias("n1")), nik.select("item", F.col("category").alias("k2"), F.col("n").alias("n2"))
    do = a.join(b, "item").join(d, ["k1", "k2"]).agg(F.sum(F.col("d") * F.col("n1") * F.col("n2")).alias("do"))
    nk = r.groupBy("category").agg(F.count("*").alias("n"))
    by = distances.join(nk.select(F.col("category").alias("k1"), F.col("n").alias("n1")), "k1").join(nk.select(F.col("category").alias("k2"), F.col("n").alias("n2")), "k2")
    de = by.agg(F.sum(F.col("d") * F.col("n1") * F.col("n2")).alias("de"))
    nck = r.groupBy("rater", "category").agg(F.count("*").alias("n"))
    x, y = nck.select(F.col("rater").alias("c1"), F.col("category").alias("k1"), F.col("n").alias("n1")), nck.select(F.col("rater").alias("c2"), F.col("category").alias("k2"), F.col("n").alias("n2"))
    dk = x.join(d, "k1").join(y, "k2").where("c1 < c2").agg(F.sum(F.col("d") * F.col("n1") * F.col("n2")).alias("dk"))
    t = sizes.crossJoin(do).crossJoin(de).crossJoin(dk)
    ni, nc = F.col("ni"), F.col("nc")
    seen = F.col("do") / (ni * nc * (nc - 1))
    alpha = 1 - seen / (F.col("de") / (ni * nc * (ni * nc - 1)))
    return t.select(alpha.alias("alpha"), (1 - seen / (2 * F.col("dk") / (ni * ni * nc * (nc - 1)))).alias("alpha_kappa"))


def full_distances(r: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(k1, k2, d) of all pairs of categories: 0 on the diagonal, the given ones, else the largest given (1 without any)."""
    ks = r.select("category").distinct()
    all_ = ks.select(F.col("category").alias("k1")).crossJoin(ks.select(F.col("category").alias("k2")))
    if given is None:
        return all_.withColumn("d", F.when(F.col("k1") == F.col("k2"), 0.0).otherwise(1.0))
    both = given.unionByName(given.select(F.col("k2").alias("k1"), F.col("k1").alias("k2"), "d")).groupBy("k1", "k2").agg(F.max("d").alias("g"))
    top = given.agg(F.max("d").alias("top"))
    return all_.join(both, ["k1", "k2"], "left").crossJoin(top).select("k1", "k2", F.when(F.col("k1") == F.col("k2"), 0.0).otherwise(F.coalesce("g", "top")).alias("d"))


def confusion(r: DataFrame) -> DataFrame:
    """(k1, k2, n, agree): unordered category pairs; agree, on the diagonal: the share of the pairs that touch the category."""
    n = _pairs(r).groupBy(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).agg(F.count("*").alias("n"))
    touch = n.select(F.explode(F.array_distinct(F.array("k1", "k2"))).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("t"))
    return n.join(touch, F.col("k1") == F.col("k"), "left").select("k1", "k2", "n", F.when(F.col("k1") == F.col("k2"), F.col("n") / F.col("t")).alias("agree"))


def read_ratings(spark: SparkSession, path: str, sep: str = "\t", header: bool = False, item_col: bool = False) -> DataFrame:
    """(item, rater, category) of a table with a column per rater; header: the first row has their names; item_col: the
    first column names the item, else an item is a row."""
    wide = spark.read.option("sep", sep).option("header", header).csv(path)
    raters = wide.columns[1:] if item_col else wide.columns
    item = F.col(f"`{wide.columns[0]}`") if item_col else F.monotonically_increasing_id().cast("string")
    cells = F.array(*[F.struct(F.lit(r).alias("rater"), F.col(f"`{r}`").alias("category")) for r in raters])
    return wide.select(item.alias("item"), cells.alias("c")).select("item", F.explode("c").alias("x")).select("item", "x.*").where("category is not null")
