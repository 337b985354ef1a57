"""Lower-casing that keeps the forms that names and acronyms prefer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.functions.words import case_class


def vocabulary(sents: DataFrame) -> DataFrame:
    """(form, low, cnt, cnt_start, pct, forms): counts of each form, of those at a sentence's start (first, or after
    [:.?!;]), and the form's smoothed share among the forms with its lower-case letters. The word before lies beside a
    word in its sentence, so only counts are shuffled."""
    placed = F.transform("words", lambda w, k: F.struct(w["surface"].alias("form"), ((k == 0) | F.get("words", k - 1)["surface"].rlike("^[:.?!;]")).alias("start")))
    seen = sents.select(F.explode(placed).alias("x")).groupBy("x.form").agg(F.count("*").alias("cnt"), F.count_if("x.start").alias("cnt_start"))
    low = Window.partitionBy("low")
    seen = seen.withColumn("low", F.lower("form")).withColumn("free", F.col("cnt") - F.col("cnt_start") + 1)
    return seen.withColumn("pct", F.col("free") / F.sum("free").over(low)).withColumn("forms", F.count("*").over(low)).drop("free")


def simple(forms: DataFrame) -> DataFrame:
    return forms.withColumn("new_form", F.lower("form"))


def aggressive(vocab: DataFrame, share: float = 0.9) -> DataFrame:
    """Lower case unless the form has nearly all of its word's free occurrences."""
    cased = ~case_class(F.col("form")).isin("lowercase", "?")
    return vocab.withColumn("new_form", F.when(cased & (F.col("pct") < share), F.col("low")).otherwise(F.col("form")))


def preferred(vocab: DataFrame) -> DataFrame:
    """(low, preferred): the form with the largest share, if it is at least 0.9 - 0.15 per form."""
    ok = vocab.where(F.col("pct") >= 0.9 - 0.15 * F.col("forms"))
    return ok.groupBy("low").agg(F.min(F.struct((-F.col("pct")).alias("p"), "form"))["form"].alias("preferred"))


def complex_case(vocab: DataFrame) -> DataFrame:
    """(form, place, new_form): for forms at a sentence's start and elsewhere."""
    v = vocab.join(preferred(vocab), "low", "left")
    cls = case_class(F.col("form"))
    best = F.coalesce("preferred", "form")
    starts = F.col("cnt_start") / F.col("cnt") >= 0.8
    both = v.withColumn("place", F.explode(F.array(F.lit("start"), F.lit("inside"))))
    both = both.where(((F.col("place") == "start") & (F.col("cnt_start") > 0)) | ((F.col("place") == "inside") & (F.col("cnt") > F.col("cnt_start"))))
    new = F.when(cls.isin("UPPERCASE", "MiXeD"), best).when(cls == "Firstupper", F.when((F.col("place") == "start") & starts, F.col("low")).otherwise(best)).otherwise(F.col("form"))
    return both.select("form", "place", new.alias("new_form"))
