"""Association, contrast and combination measures over counts, as columns.

o: joint count; c: array of the words' counts; size: words in the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected(c: Column, size: Column) -> Column:
    return F.aggregate(c, F.lit(1.0), lambda a, x: a * (x.cast("double") / size)) * (size - F.size(c) + 1)


def mle(o: Column, size: Column) -> Column:
    return o / size


def pmi(o: Column, c: Column, size: Column) -> Column:
    e = expected(c, size)
    return F.when((o == 0) | (e == 0), 0.0).otherwise(F.log2(o / e))


def t_score(o: Column, c: Column, size: Column) -> Column:
    return F.when(o == 0, 0.0).otherwise((o - expected(c, size)) / F.sqrt(o.cast("double")))


def dice(o: Column, c: Column) -> Column:
    total = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.when(total == 0, 0.0).otherwise(F.size(c) * o / total)


def log_likelihood(o: Column, c: Column, size: Column) -> Column:
    """2 * sum of O log10(O / E) over a bigram's contingency table; 0 for other sizes. Word counts are at least o."""
    n = size.cast("double") - 1
    c1, c2 = F.greatest(c[0], o).cast("double"), F.greatest(F.get(c, 1), o).cast("double")
    cells = [(o.cast("double"), c1, c2), (c1 - o, c1, n - c2), (c2 - o, n - c1, c2), (n - c1 - c2 + o, n - c1, n - c2)]
    terms = [F.when(seen > 0, seen * (F.log10(seen) - F.log10(a / size * (b / size) * n))).otherwise(0.0) for seen, a, b in cells]
    return F.when(F.size(c) == 2, 2 * (terms[0] + terms[1] + terms[2] + terms[3])).otherwise(0.0)


ASSOCIATION = {"mle": lambda o, c, n: mle(o, n), "pmi": pmi, "t": t_score, "dice": lambda o, c, n: dice(o, c), "ll": log_likelihood}


def association(o: Column, c: Column, size: Column, measures: tuple[str, ...] = tuple(ASSOCIATION)) -> list[Column]:
    return [ASSOCIATION[m](o, c, size).alias(m) for m in measures]


def backed_off_size(o: Column, c: Column, size: Column, original: Column) -> Column:
    """The corpus size of back-off counts: the original corpus's, unless a count is negative (backed off)."""
    return F.when((o < 0) | F.exists(c, lambda x: x < 0), size).otherwise(original)


def csmwe(f: Column, fc: Column, total: Column) -> Column:
    return F.atan(F.log2(f + 1.0) * ((f + 1.0) / ((fc + 1.0) / total)))


def simple_diff(f: Column, fc: Column) -> Column:
    return (f + 1.0) / (fc + 1.0)


def simple_csmwe(f: Column, fc: Column) -> Column:
    return F.log2(f + 1.0) * simple_diff(f, fc)


def backoff_threshold(size: Column) -> Column:
    return F.log2(size / 100_000)


def entropy(counts: Column, base: float = math.e) -> Column:
    """Entropy of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return -F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda a, x: a + (x / total) * F.log(x / total)) / math.log(base)
