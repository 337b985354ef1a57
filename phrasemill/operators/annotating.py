"""Projection of a dictionary of multiword units onto sentences, and evaluation of such annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.model import small

def contiguous(sents: DataFrame, cands: DataFrame, gaps: int = 0) -> DataFrame:
    """(doc_id, sent, cand_id, places): occurrences of candidates (cand_id, lemmas) from every token on, with at most `gaps`
    other words within. An equi-join on the first lemma, in the row if there are few candidates; the rest is checked by a
    fold that prefers matches to gaps."""
    toks = sents.select("doc_id", "sent", F.transform("words", lambda w: F.coalesce(w["lemma"], w["surface"])).alias("forms"))
    starts = toks.select("doc_id", "sent", "forms", F.posexplode("forms").alias("i", "first"))
    longest = cands.agg(F.max(F.size("lemmas")).alias("m"))
    # carry only the words that a unit from here could take
    near = starts.crossJoin(F.broadcast(longest)).select("doc_id", "sent", "i", "first", F.slice("forms", F.col("i") + 1, F.col("m") + gaps).alias("ahead"))
    pairs = near.join(small(cands.select("cand_id", "lemmas", F.element_at("lemmas", 1).alias("first")).where(F.size("lemmas") > 0)), "first")
    if not gaps:
        hit = pairs.where(F.slice("ahead", 1, F.size("lemmas")) == F.col("lemmas"))
        return hit.select("doc_id", "sent", "cand_id", F.transform(F.sequence(F.lit(0), F.size("lemmas") - 1), lambda k: k + F.col("i")).alias("places"))
    begin = F.struct(F.lit(0).alias("done"), F.lit(gaps).alias("left"), F.array().cast("array<int>").alias("at"), F.lit(False).alias("dead"), F.lit(0).alias("k"))

    def step(a, x):
        full = a["dead"] | (a["done"] >= F.size("lemmas"))
        match = ~full & (x == F.get(F.col("lemmas"), a["done"]))
        return F.struct(
            F.when(match, a["done"] + 1).otherwise(a["done"]).alias("done"),
            F.when(full | match, a["left"]).otherwise(a["left"] - 1).alias("left"),
            F.when(match, F.concat(a["at"], F.array(a["k"] + F.col("i")))).otherwise(a["at"]).alias("at"),
            (a["dead"] | (~full & ~match & (a["left"] <= 0))).alias("dead"),
            (a["k"] + 1).alias("k"),
        )

    folded = pairs.withColumn("f", F.aggregate("ahead", begin, step))
    return folded.where(F.col("f.done") == F.size("lemmas")).select("doc_id", "sent", "cand_id", F.col("f.at").alias("places"))


def from_sources(sents: DataFrame, cands: DataFrame) -> DataFrame:
    """Occurrences named by candidates (cand_id, n, doc_id, sources 'sent:w1,w2;...'); sizes must agree."""
    one = cands.select("cand_id", "n", "doc_id", F.explode(F.split("sources", ";")).alias("s"))
    at = one.select("cand_id", "n", "doc_id", F.split_part("s", F.lit(":"), F.lit(1)).cast("long").alias("sent"), F.transform(F.split(F.split_part("s", F.lit(":"), F.lit(2)), ","), lambda k: k.cast("int") - 1).alias("places"))
    at = at.where(F.when(F.size("places") == F.col("n"), True).otherwise(F.raise_error(F.lit("a source has another length than its candidate"))))
    return sents.select("doc_id", "sent").join(at, ["doc_id", "sent"]).select("doc_id", "sent", "cand_id", "places")


def with_occurrences(sents: DataFrame, occ: DataFrame, only: bool = False) -> DataFrame:
    """Sentences with occs ARRAY<STRUCT<cand_id, places>>; only: just those that have some."""
    grouped = occ.groupBy("doc_id", "sent").agg(F.sort_array(F.collect_list(F.struct("cand_id", "places"))).alias("occs"))
    return sents.join(grouped, ["doc_id", "sent"], "inner" if only else "left")


def aligned(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """Sentences of two corpora side by side, by their places (a_words, b_words)."""
    from phrasemill.operators.numbering import numbered

    x = numbered(a.select(*order, F.col("words").alias("a_words")), [F.col(c) for c in order], "k").select("k", "a_words")
    y = numbered(b.select(*order, F.col("words").alias("b_words")), [F.col(c) for c in order], "k").select("k", "b_words")
    return x.join(y, "k")


def _score(pred: DataFrame, ref: DataFrame, key: list[str]) -> DataFrame:
    hits = pred.join(ref.select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("p_hit"))
    back = ref.join(pred.select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("r_hit"))
    n, m = pred.agg(F.count("*").alias("p_all")), ref.agg(F.count("*").alias("r_all"))
    t = hits.crossJoin(back).crossJoin(n).crossJoin(m)  # four single rows
    p, r = F.col("p_hit") / F.when(F.col("p_all") > 0, F.col("p_all")), F.col("r_hit") / F.when(F.col("r_all") > 0, F.col("r_all"))
    return t.select("p_hit", "p_all", "r_hit", "r_all", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"))


def exact_match(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """How many occurrences (doc_id, sent, places) the other side has too, both ways."""
    return _score(pred.select("doc_id", "sent", "places"), ref.select("doc_id", "sent", "places"), ["doc_id", "sent", "places"])


def link_based(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """The same over pairs of neighbouring places."""
    def pairs(x: DataFrame) -> DataFrame:
        linked = x.where(F.size("places") > 1)
        return linked.select("doc_id", "sent", F.explode(F.transform(F.sequence(F.lit(1), F.size("places") - 1), lambda k: F.struct(F.element_at("places", k).alias("a"), F.element_at("places", k + 1).alias("b")))).alias("l")).select("doc_id", "sent", "l.a", "l.b")

    return _score(pairs(pred), pairs(ref), ["doc_id", "sent", "a", "b"])


def gold_match(cands: DataFrame, gold: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Candidates (ngram) with a class `is_gold`: whether the gold list has the n-gram."""
    fold = F.lower if ignore_case else (lambda c: c)
    keys = gold.select(fold(F.col("ngram")).alias("__g")).distinct()
    return cands.join(keys, fold(F.col("ngram")) == F.col("__g"), "left").withColumn("is_gold", F.col("__g").isNotNull()).drop("__g")


def gold_match_words(cands: DataFrame, gold: DataFrame, ignore_pos: bool = False, ignore_case: bool = True, cross: bool = False) -> DataFrame:
    """Candidates (cand_id, words) with `is_gold`: whether an entry of gold (words) has as many words and each attribute
    that it defines. cross: a lemma may stand for a surface and the other way round. Candidates and entries meet by keys
    of their words, so it is an equi-join; then the attributes are compared."""
    fold = F.lower if ignore_case else (lambda c: c)
    own = lambda w: F.coalesce(w["lemma"], w["surface"], F.lit(""))

    def keys(words: Column) -> Column:
        forms = [own] + ([lambda w: F.coalesce(w["surface"], w["lemma"], F.lit(""))] if cross else [])
        all_of = lambda f: fold(F.array_join(F.transform(words, f), "\x1f"))
        return F.array_distinct(F.array(*map(all_of, forms)))

    def fits(g: Column, c: Column) -> Column:
        same = lambda a, b: a.isNull() | F.coalesce(fold(a) == fold(b), F.lit(False))
        form = same(g["lemma"], c["lemma"]) & same(g["surface"], c["surface"])
        if cross:
            either = lambda a: F.coalesce(fold(a) == fold(c["lemma"]), F.lit(False)) | F.coalesce(fold(a) == fold(c["surface"]), F.lit(False))
            form = form | either(g["lemma"]) | either(g["surface"])
        return form if ignore_pos else form & same(g["pos"], c["pos"])

    entries = gold.select(F.col("words").alias("__g")).distinct().select("__g", F.explode(keys(F.col("__g"))).alias("__k"))
    asked = cands.select("cand_id", "words", F.explode(keys(F.col("words"))).alias("__k"))
    hit = asked.join(entries, "__k").where((F.size("words") == F.size("__g")) & F.forall(F.zip_with("__g", "words", fits), lambda x: x))
    return cands.join(hit.select("cand_id").distinct().withColumn("is_gold", F.lit(True)), "cand_id", "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))


def precision_recall(cands: DataFrame, references: int | DataFrame) -> DataFrame:
    """Precision, recall and F1 of candidates with is_gold against a number of references (or a one-row table `refs`)."""
    t = cands.agg(F.count_if("is_gold").alias("tp"), F.count("*").alias("n"))
    t = t.withColumn("refs", F.lit(references)) if isinstance(references, int) else t.crossJoin(references)
    p, r = F.coalesce(F.col("tp") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0)), F.coalesce(F.col("tp") / F.when(F.col("refs") > 0, F.col("refs")), F.lit(0.0))
    return t.select("tp", "n", "refs", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def average_precision(rows: DataFrame, feature: str, truth: str, ties: list[str], descending: bool = True) -> DataFrame:
    """(tps, map, variance): mean and sample variance of the precisions (x100) at each true positive, ranked by a feature."""
    from phrasemill.operators.numbering import numbered

    known = rows.where(F.col(feature).isNotNull() & F.col(truth).isNotNull())
    first = F.col(feature).desc() if descending else F.col(feature).asc()
    order = [first, *[F.col(t).asc() for t in ties]]
    hits = numbered(numbered(known, order, "pos").where(F.col(truth)), [F.col("pos")], "tp")
    p = 100.0 * F.col("tp") / F.col("pos")
    return hits.agg(F.count("*").alias("tps"), F.coalesce(F.avg(p), F.lit(0.0)).alias("map"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("variance"))
