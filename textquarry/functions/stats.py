"""Statistics of in-row arrays, cleaning, ratings and vectors as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabularies import RATING_LABELS

EPSILON = 1e-12


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(0.0)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def mean(array: Column) -> Column:
    return F.when(F.size(array) > 0, total(array) / F.size(array)).otherwise(0.0)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` reads it."""
    return F.transform(F.array(value), use)[0]


def population_std(array: Column) -> Column:
    """By running means, in one pass."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def step(s: Column, x: Column) -> Column:
        moved = s["m"] + (x - s["m"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), moved.alias("m"), (s["q"] + (x - s["m"]) * (x - moved)).alias("q"))

    return F.aggregate(array, start, step, lambda s: F.when(s["n"] > 0, F.sqrt(s["q"] / s["n"])).otherwise(0.0))


def maximum(array: Column) -> Column:
    return F.coalesce(F.array_max(array), F.lit(0.0))


def median(array: Column) -> Column:
    s, n = F.array_sort(array), F.size(array)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.try_element_at(s, low) + F.try_element_at(s, high)) / 2.0).otherwise(0.0)


def entropy(shares: Column, epsilon: float = EPSILON) -> Column:
    """Shannon entropy in bits of an array of shares: with epsilon inside the logarithm, or (0) over positive shares."""
    if epsilon:
        return -F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log2(p + epsilon))
    return -F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s + p * F.log2(p))


def run_lengths(ordered: Column, same=lambda a, b: a == b) -> Column:
    """Lengths of the runs of like values of an array: distances between the places where one begins."""
    n = F.size(ordered)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: (i == 0) | ~same(ordered[i], ordered[F.greatest(i - 1, F.lit(0))]))
    return bound(begins, lambda b: F.transform(b, lambda at, k: F.coalesce(F.get(b, k + 1), n) - at))


def frequencies(array: Column) -> Column:
    """Counts of the distinct values of an array: a sort, then one pass."""
    return bound(F.array_sort(array), lambda s: run_lengths(s))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(0.0)


def nan_or_zero(x: Column) -> Column:
    """Null and NaN to 0; infinities stay."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def rating_of_label(label: Column) -> Column:
    """1 to 5 of a label, null for any other."""
    known = F.create_map(*(F.lit(x) for pair in RATING_LABELS.items() for x in pair))
    return F.try_element_at(known, F.coalesce(label, F.lit(""))).cast("double")


def strict_rating_of_label(label: Column) -> Column:
    """The same; a label that is neither null nor known stops the query."""
    return F.when(label.isNull() | label.isin(*RATING_LABELS), rating_of_label(label)).otherwise(F.raise_error(F.concat(F.lit("unknown rating label: "), label)))


def clip(x: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """Within [low, high]; null stays null, NaN stays NaN."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x))).otherwise(x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return bound(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def pairwise_block(q: Column, r: Column) -> Column:
    """[q, r, |q - r|, q r] as one array."""
    return F.concat(q, r, F.zip_with(q, r, lambda x, y: F.abs(x - y)), F.zip_with(q, r, lambda x, y: x * y))
