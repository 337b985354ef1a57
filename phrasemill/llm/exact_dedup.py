"""Exact dedup by deterministic block naming (DataFrame functions only).

Normalised texts are cut into blocks of a fixed size. Distinct blocks are sorted, by a 128-bit digest, and get their ranks
as names; then adjacent names are paired, distinct pairs sorted and ranked again, until every document has a single
integer. Ranks don't depend on how rows are dealt to tasks. Two documents have
equal integers of the same level exactly when their normalised texts are equal.

Occurrences refer to a block by a 128-bit digest until its name is known. The named table holds the distinct blocks
themselves, so it is checked that the digest is injective on them; if it isn't, another seed is taken. So names are
free of collisions, and the text crosses the network once, after combining equal blocks on the map side.

Defined results: null text counts as empty, and empty texts are equal to each other; null doc_id is a value of its own
and sorts last; of rows repeated as a whole one stays; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import drop_written, sized, written
from phrasemill.operators.numbering import numbered

BLOCK = 4096
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeezed(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def cut(text: Column, block: int) -> Column:
    return F.when(F.length(text) <= block, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))


def digests(x: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), x).alias("h1"), F.xxhash64(x, F.lit(seed + 1)).alias("h2"))


def named(keys: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows of keys with `name`, their rank from 1 in this order: sorted in range partitions, to each of which the
    sizes of those before are added."""
    return numbered(keys, [F.col(c) for c in order], "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, n_cp, th, sha, level, name) of every row: rid a row number, th a hash of the text, (level, name) its identity."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).select("doc_id", F.length(F.coalesce("t", F.lit(""))).cast("long").alias("n_cp"), F.xxhash64("t").alias("th"), squeezed(F.col("t")).alias("norm"))
    blocks = base.select("doc_id", "n_cp", "th", "norm", cut(F.col("norm"), block).alias("blocks"))
    seed = 0
    while True:
        distinct = written(blocks.select(F.explode("blocks").alias("block")).distinct().select(digests(F.col("block"), seed).alias("h")).select("h.*"), "block-digests")
        if distinct.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
        drop_written(distinct)
        seed += 2
    names = written(named(distinct, ["h1", "h2"]), "block-names")
    occ = written(blocks.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_cp", "th", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.transform("blocks", lambda b: digests(b, seed)).alias("hs")), "occurrences")
    first = occ.select("rid", F.posexplode("hs").alias("pos", "h")).select("rid", "pos", "h.*").join(names, ["h1", "h2"])
    cur = written(first.groupBy("rid").agg(_in_order("pos", "name")), "level-0")
    done, level = [], 0
    while True:
        done.append(cur.where(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = cur.where(F.size("names") > 1)
        if rest.isEmpty():
            break
        level += 1
        pairs = rest.select("rid", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("(size(names) - 1) div 2")), lambda k: F.struct(F.get("names", k * 2).alias("a"), F.coalesce(F.get("names", k * 2 + 1), F.lit(-1)).alias("b")))).alias("pos", "p")).select("rid", "pos", "p.*")
        pair_names = written(named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        cur = written(pairs.join(pair_names, ["a", "b"]).groupBy("rid").agg(_in_order("pos", "name")), f"level-{level}")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return occ.select("rid", "doc_id", "n_cp", "th", "sha").join(found, "rid")


def _in_order(pos: str, value: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias("names")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    ids = written(identities(docs, id_col, text_col, block), "identities")
    best = ids.groupBy("level", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("u"), "doc_id", "rid")).alias("best"),
    )
    return ids.join(best, ["level", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"), "level", "name", "n_cp", "th")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all columns of docs.

    Rows are found again by id, length and a hash of the text, so ids needn't be unique.
    """
    key = ["doc_id", "n_cp", "th"]
    rows = exact_dedup(docs, id_col, text_col).groupBy(*key).agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n"))
    rows = written(rows.where("not stays or n > 1"), "decisions")
    keyed = docs.withColumns({"__id": F.col(id_col), "__n": F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), "__t": F.xxhash64(text_col)})

    def same(other: DataFrame) -> Column:
        return F.col("__id").eqNullSafe(other["doc_id"]) & (F.col("__n") == other["n_cp"]) & (F.col("__t") == other["th"])

    gone, repeated = rows.where("not stays").select(*key), rows.where("stays").select(*key)
    out = keyed.join(sized(gone, gone.count()), same(gone), "left_anti")
    if not (n := repeated.count()):
        return out.select(*docs.columns)
    # rows that are repeated as a whole: one of each
    single = out.join(sized(repeated, n), same(repeated), "left_anti")
    several = out.join(sized(repeated, n), same(repeated), "left_semi").dropDuplicates(["__id", "__n", "__t"])
    return single.unionByName(several).select(*docs.columns)
