"""Similarities as Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOSS_WEIGHT, CHAIN_DISCOUNT, IMPUTED_DISCOUNT = 0.75, 0.95, 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; not a number where either is all zeros, 0 where either is null."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(size == 0, F.lit(float("nan"))).otherwise(dot(a, b) / size)


def item_similarity(ety_a: Column, gloss_a: Column, discount_a: Column, ety_b: Column, gloss_b: Column, discount_b: Column) -> Column:
    """Of glosses, and of etymologies too where both are there; the lower discount counts."""
    gloss = cosine(gloss_a, gloss_b)
    both = (1 - GLOSS_WEIGHT) * cosine(ety_a, ety_b) + GLOSS_WEIGHT * gloss
    return F.least(discount_a, discount_b) * F.when(ety_a.isNotNull() & ety_b.isNotNull(), both).otherwise(gloss)


def chain_similarity(chain: Column, candidate: Column) -> Column:
    """Weighted mean of a candidate's similarities with a chain of ancestors, the last one heaviest.

    Both hold structs (ety, gloss, discount).  An ancestor with an etymology on
    both sides weighs 1, one with any vector 0.75, one without none 0; each
    step back multiplies by 0.95.
    """
    empty = lambda x: x["ety"].isNull() & x["gloss"].isNull()
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("step"))

    def add(acc: Column, a: Column) -> Column:
        similarity = item_similarity(candidate["ety"], candidate["gloss"], candidate["discount"], a["ety"], a["gloss"], a["discount"])
        quality = F.when(candidate["ety"].isNotNull() & a["ety"].isNotNull(), 1.0).when(~empty(a), 0.75).otherwise(0.0)
        weight = acc["step"] * quality
        return F.struct((acc["sum"] + weight * similarity).alias("sum"), (acc["weight"] + weight).alias("weight"), (acc["step"] * CHAIN_DISCOUNT).alias("step"))

    total = F.aggregate(F.reverse(chain), zero, add)
    return F.when(empty(candidate) | (total["weight"] <= 0), F.lit(0.0)).otherwise(total["sum"] / total["weight"])


def unit(a: Column) -> Column:
    """A vector as doubles, divided by its length; the cosine of two such is their dot product. Not numbers if it is all zeros."""
    size = F.sqrt(dot(a, a))
    return F.transform(a.cast("array<double>"), lambda x: F.when(size == 0, F.lit(float("nan"))).otherwise(x / size))


def best_candidate(id: Column, similarity: Column) -> Column:
    """An aggregate: struct(id, similarity) of the best of a group, at least 0; not a number counts as 0, and the lowest id wins ties. No group is gathered."""
    value = F.greatest(F.nanvl(similarity, F.lit(0.0)), F.lit(0.0))
    return F.max_by(F.struct(id.alias("id"), value.alias("similarity")), F.struct(value, -id))


def lang_distance(a: Column, b: Column) -> Column:
    """Steps between two languages over their ancestor arrays (oldest first, themselves last); null if their oldest ancestors differ."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    breaks = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    shared = F.when(breaks == 0, F.least(F.size(a), F.size(b)).cast("long")).otherwise(breaks - 1)
    return F.when(F.get(a, 0) == F.get(b, 0), (F.size(a) + F.size(b) - 2 * shared).cast("long"))
