"""Column functions that Spark has no single built-in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the speaker threshold: 1 lowered by .1 in floating point down to what is left above 0.
LADDER = (1.0, 0.9, 0.8, 0.7000000000000001, 0.6000000000000001, 0.5000000000000001, 0.40000000000000013, 0.30000000000000016, 0.20000000000000015, 0.10000000000000014, 1.3877787807814457e-16)
UNKNOWN = "<Unknown>"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim all white space, not only spaces."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def overlap_fraction(start, end, from_, to) -> Column:
    """Part of the word [start, end] inside the segment [from, to]; 0 where they are apart or only touch, or the word has no length."""
    s, e, f, t = map(col, (start, end, from_, to))
    lo, hi = F.greatest(s, f), F.least(e, t)
    return F.when((s > t) | (e < f) | (lo == hi), F.lit(0.0)).otherwise((hi - lo).cast("double") / (e - s).cast("double"))


def rung(fraction) -> Column:
    """The highest step of the ladder that a fraction reaches; null for 0."""
    steps = F.array(*(F.lit(x) for x in LADDER))
    return F.array_max(F.filter(steps, lambda x: x <= col(fraction)))


def speaker_label(speakers) -> Column:
    """Sorted speakers joined by ' & '; null ones and none at all are unknown."""
    named = F.transform(col(speakers), lambda x: F.coalesce(x, F.lit(UNKNOWN)))
    return F.coalesce(F.nullif(F.concat_ws(" & ", F.array_sort(named)), F.lit("")), F.lit(UNKNOWN))


def roman(n) -> Column:
    """Roman numeral of 1 to 3999; other numbers as digits."""
    n = col(n)
    digits = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))
    parts = [F.element_at(F.array(*map(F.lit, d)), (F.floor(n / base) % (10 if base < 1000 else 4)).cast("int") + 1) for d, base in zip(digits, (1000, 100, 10, 1))]
    return F.when(n.between(1, 3999), F.concat(*parts)).otherwise(n.cast("string"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity of two vectors in doubles; null where one is null or has no length."""
    d = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(d > 0, dot(a, b) / d)


def stem(path) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def basename(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)
