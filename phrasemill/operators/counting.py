"""Counts of words, n-grams, candidates and their forms; lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill import batches, model
from phrasemill.functions import measures, words
from phrasemill.model import attribute, gram_counts, small, stored


def ngram_counts(sents: DataFrame, lo: int, hi: int, attr: str = "lemma", extra: tuple[str, ...] = ()) -> DataFrame:
    return gram_counts(sents, lo, hi, attr, extra=extra)


def corpus_sizes(sents: DataFrame) -> DataFrame:
    return sents.groupBy("corpus").agg(F.sum(F.size("words")).cast("long").alias("size"))


def bigram_table(sents: DataFrame, attr: str = "lemma", counts: tuple[str, ...] = ("c1", "c2", "size")) -> DataFrame:
    """(w1, w2, o, counts...) of neighbouring words: c1 and c2 of the words, size of the corpus; a join for each that is
    asked for. Words and pairs are counted in one pass over the text and one shuffle, and stored."""
    rows = model.counting(sents, attr, batches.word_and_pair_counts, "n int, w1 string, w2 string, o long")
    both = stored(model.summed(rows if counts else rows.where("n = 2"), ["n", "w1", "w2"], "o"), "words-and-pairs")
    ones, out = both.where("n = 1"), both.where("n = 2 AND w1 IS NOT NULL AND w2 IS NOT NULL").select("w1", "w2", "o")
    for word, count in (("w1", "c1"), ("w2", "c2")):
        if count in counts:  # words are told apart, so the hashed side is spread evenly
            out = out.join(ones.where("w1 IS NOT NULL").select(F.col("w1").alias(word), F.col("o").alias(count)).hint("shuffle_hash"), word)
    if "size" in counts:
        out = out.crossJoin(F.broadcast(ones.agg(F.sum("o").cast("long").alias("size"))))  # one row
    return out.select("w1", "w2", "o", *counts)


def associated(sents: DataFrame, attr: str = "lemma") -> DataFrame:
    t = bigram_table(sents, attr)
    c = F.array("c1", "c2")
    return t.select("w1", "w2", "o", "c1", "c2", *measures.association(F.col("o"), c, F.col("size")))


def lookup(cands: DataFrame, counts: DataFrame, key: str = "ngram", out: str = "cnt") -> DataFrame:
    """Candidates with the count of their key; unseen ones have 0."""
    return cands.join(counts.select(key, F.col("cnt").alias("__c")), key, "left").withColumn(out, F.coalesce("__c", F.lit(0)).cast("long")).drop("__c")


def lookup_all(cands: DataFrame, sents: DataFrame, attr: str = "lemma") -> DataFrame:
    """Candidates (cand_id, words ARRAY<STRING>) with their joint count in a corpus, and those of their words and pairs:
    (cand_id, cnt, word_cnts, pair_cnts). Counted are runs of the corpus of each length that a candidate has."""
    lengths = sorted({1, 2, *[r["n"] for r in cands.select(F.size("words").alias("n")).distinct().collect() if r["n"] > 0]})  # a number per length
    runs = lambda n: F.transform(F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - (n - 1))).otherwise(F.array().cast("array<int>")), lambda k: F.slice("words", k, n))
    kind_of = lambda kind, n: F.transform(runs(n), lambda g, k: F.struct(F.lit(kind).alias("kind"), k.alias("at"), F.array_join(g, " ").alias("ngram")))
    kinds = [kind_of("w", 1), kind_of("p", 2)]
    whole = F.array(F.struct(F.lit("c").alias("kind"), F.lit(0).alias("at"), F.array_join("words", " ").alias("ngram")))
    asked = cands.select("cand_id", F.explode(F.concat(whole, *kinds)).alias("x")).select("cand_id", "x.*")
    counts = None
    for n in lengths:
        one = gram_counts(sents, n, n, attr)
        counts = one if counts is None else counts.unionByName(one)
    wanted = counts.join(asked.select("ngram").distinct(), "ngram", "left_semi").groupBy("ngram").agg(F.sum("cnt").alias("cnt"))
    got = lookup(asked, wanted)
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "cnt")))), lambda x: x["cnt"])
    return got.groupBy("cand_id").agg(F.max(F.when(F.col("kind") == "c", F.col("cnt"))).alias("cnt"), of("w").alias("word_cnts"), of("p").alias("pair_cnts"))


def dated_lookup(terms: DataFrame, cache: DataFrame, today: Column, max_days: int = -1) -> DataFrame:
    """(lang, term, freq): cached web counts, lower-cased; entries older than max_days (-1: never) count as missing."""
    fresh = cache if max_days < 0 else cache.where(F.datediff(today, "as_of") <= max_days)
    return terms.select("lang", F.lower("term").alias("term")).join(fresh.select("lang", "term", "freq"), ["lang", "term"], "left")


def merge_caches(a: DataFrame, b: DataFrame, newest: bool = True) -> DataFrame:
    """One row per (lang, term): the newest entry (or the oldest), then the larger count."""
    pick = F.max_by if newest else F.min_by
    order = F.struct("as_of", "freq")
    return a.unionByName(b).groupBy("lang", "term").agg(pick(F.struct("freq", "as_of"), order).alias("e")).select("lang", "term", "e.freq", "e.as_of")


def candidates(matches: DataFrame, keep_surface: bool = False, ignore_pos: bool = False, several: bool = True) -> DataFrame:
    """Candidates of matches (doc_id, sent, corpus, places, words): a word's surface is undefined where it has a lemma (or
    its lemma with keep_surface), and its pos with ignore_pos. several: whether the matches are of several patterns, which
    may find the same places. (base, corpus, form, base_freq, form_freq, first_source)."""
    def form_of(w: Column) -> Column:
        kept = w["surface"] if keep_surface else F.coalesce(w["lemma"], w["surface"])
        return kept if ignore_pos else F.concat(kept, F.lit("/"), w["pos"])

    # all matches of a sentence come from one row, so repeated ones are told apart there, if there can be any
    once = matches.dropDuplicates(["doc_id", "sent", "places"]) if several else matches
    keyed = once.select("corpus", F.array_join(F.transform("words", form_of), " ").alias("base"), F.array_join(F.transform("words", lambda w: w["surface"]), " ").alias("form"), F.struct("doc_id", "sent", words.source_string(F.col("sent"), F.col("places")).alias("s")).alias("src"))
    forms = keyed.groupBy("corpus", "base", "form").agg(F.count("*").alias("form_freq"), F.min("src").alias("src"))
    totals = forms.groupBy("corpus", "base").agg(F.sum("form_freq").alias("base_freq"))
    return forms.join(totals, ["corpus", "base"]).select("base", "corpus", "form", "base_freq", "form_freq", F.concat_ws(":", F.col("src.doc_id").cast("string"), F.col("src.s")).alias("first_source"))


def contrast(freqs: DataFrame, main: str, others: list[str] | None = None, pooled: bool = False) -> DataFrame:
    """Contrast measures of (ngram, source, freq): the main source against each other one that is found (or those
    named), or all of them pooled."""
    other = F.col("source") != main if others is None else F.col("source").isin(*others)
    mine = freqs.where(F.col("source") == main).select("ngram", F.col("freq").alias("f"))
    rest = freqs.where(other)
    total = rest.groupBy(F.col("source").alias("against")).agg(F.sum("freq").alias("total"))
    if pooled:
        rest = rest.groupBy("ngram").agg(F.sum("freq").alias("fc")).withColumn("against", F.lit("all"))
        total = total.agg(F.sum("total").alias("total")).withColumn("against", F.lit("all"))
    else:
        rest = rest.select("ngram", F.col("freq").alias("fc"), F.col("source").alias("against"))
    # the result has a row for each n-gram and source, seen there or not
    pairs = mine.join(small(total, 10_000))
    full = pairs.join(rest, ["ngram", "against"], "left").withColumn("fc", F.coalesce("fc", F.lit(0)))
    f, fc = F.col("f").cast("double"), F.col("fc").cast("double")
    return full.select("ngram", "against", "f", "fc", measures.csmwe(f, fc, F.col("total")).alias("csmwe"), measures.simple_diff(f, fc).alias("simplediff"), measures.simple_csmwe(f, fc).alias("simplecsmwe"))


def found(sents: DataFrame, part: list[str], attr: str = "lemma") -> DataFrame:
    """(doc_id, sent, places): sentences that have the words of part as a run, and where, without overlaps."""
    first = F.exists("words", lambda w: w[attr] == part[0]) if part else F.lit(False)
    # only sentences with its first word, and the attribute as a column of its own
    base = sents.where(first).select("doc_id", "sent", F.explode(F.array(attribute(F.col("words"), attr))).alias("a"))
    return base.select("doc_id", "sent", words.find(F.col("a"), F.array(*map(F.lit, part))).alias("places")).where(F.size("places") > 0)


def combine(freqs: DataFrame, sizes: DataFrame, main: str, web: list[str]) -> DataFrame:
    """(ngram, uniform, inverse, backoff) of (ngram, source, freq); sizes has (source, size), absent counts are 0."""
    n, s = sizes.count(), sizes.agg(F.sum("size").alias("s"))
    joined = freqs.join(small(sizes), "source").crossJoin(F.broadcast(s))
    is_web = F.col("source").isin(*web)
    main_f, main_size = F.sum(F.when(F.col("source") == main, F.col("freq")).otherwise(0)), sizes.where(F.col("source") == main).agg(F.max("size").alias("main_size"))
    agg = joined.groupBy("ngram").agg((F.sum("freq") / n).alias("uniform"), F.sum((F.col("s") - F.col("size")) / F.col("s") * F.col("freq")).alias("inverse"), main_f.alias("m"), (F.sum(F.when(is_web, F.col("freq")).otherwise(0)) / len(web)).alias("w"))
    return agg.crossJoin(F.broadcast(main_size)).select("ngram", "uniform", "inverse", F.when(F.col("m") < measures.backoff_threshold(F.col("main_size")), -F.col("w")).otherwise(F.col("m").cast("double")).alias("backoff"))


def combined_sizes(sizes: DataFrame, web: list[str]) -> DataFrame:
    """(combination, size) of (source, size): the sizes combined as the counts are, cut to whole numbers; that of `backoff`
    is the mean of the web sources' sizes."""
    s = sizes.agg(F.sum("size").alias("s"), F.count("*").alias("k"), F.sum(F.when(F.col("source").isin(*web), F.col("size")).otherwise(0)).alias("w"), F.sum(F.col("size").cast("double") * F.col("size")).alias("q"))
    each = {"uniform": F.col("s") / F.col("k"), "inverse": F.col("s") - F.col("q") / F.col("s"), "backoff": F.col("w") / len(web)}
    pairs = F.array(*[F.struct(F.lit(n).alias("combination"), c.cast("long").alias("size")) for n, c in each.items()])
    return s.select(F.explode(pairs).alias("x")).select("x.*")


def variation_entropy(forms: DataFrame, top: int = 5) -> DataFrame:
    """Entropy of a candidate's surface forms (base, form, form_freq): of all, and of the `top` most frequent."""
    from pyspark.sql import Window

    w = Window.partitionBy("base").orderBy(F.desc("form_freq"), "form")
    best = F.row_number().over(w) <= top
    ranked = forms.withColumn("__best", best)
    total = ranked.groupBy("base").agg(F.sum("form_freq").alias("n"), F.sum(F.when(F.col("__best"), F.col("form_freq")).otherwise(0)).alias("n_top"))
    p, q = F.col("form_freq") / F.col("n"), F.col("form_freq") / F.col("n_top")
    return ranked.join(total, "base").groupBy("base").agg(F.count("*").alias("variants"), F.sum(-p * F.log(p)).alias("entropy"), F.sum(F.when(F.col("__best"), -q * F.log(q)).otherwise(0.0)).alias("entropy_top"))


def features_of_pattern(cands: DataFrame) -> DataFrame:
    """(words...) with pos_pattern, n, capitalized (the commonest case class, ties to the last name) and hyphen."""
    classes = F.transform("words", lambda w: words.case_class(w["surface"]))
    best = F.array_max(F.transform(F.array_distinct(classes), lambda c: F.struct(F.size(F.filter(classes, lambda x: x == c)).alias("n"), c.alias("c"))))["c"]
    return cands.select("*", words.pos_pattern(F.col("words")).alias("pos_pattern"), F.size("words").alias("n"), best.alias("capitalized"), F.exists("words", lambda w: w["lemma"].contains("-")).alias("hyphen"))


def histogram(freqs: DataFrame, limit: int | None = None) -> DataFrame:
    """(source, freq, n, share, entropy): how many entities have each frequency, per source; entropy over all bins."""
    from pyspark.sql import Window

    bins = freqs.groupBy("source", "freq").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")
    out = bins.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("entropy", F.sum(-F.col("share") * F.log2("share")).over(w))
    if limit is not None:
        out = out.withColumn("__k", F.row_number().over(w.orderBy("freq"))).where(F.col("__k") <= limit).drop("__k")
    return out


def wc(sents: DataFrame) -> DataFrame:
    length = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + words.word_length(x))
    return sents.groupBy("corpus").agg(F.count("*").alias("sentences"), F.sum(F.size("words")).cast("long").alias("words"), F.sum(length).alias("characters"))
