"""Sobol points: a digital net whose every point is computed from its number alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Spec

BITS = 30
# Of the second to the 21st dimension the degree and inner coefficients of a primitive polynomial over two elements, as
# bits, and the first direction numbers (Joe and Kuo 2008).  The first dimension has ones only.
POLYNOMIALS = (
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 1, 3, 3)),
    (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)),
    (5, 11, (1, 1, 5, 1, 1)),
    (5, 13, (1, 1, 1, 3, 11)),
    (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)),
    (6, 13, (1, 1, 1, 15, 21, 21)),
    (6, 16, (1, 3, 1, 13, 27, 49)),
    (6, 19, (1, 1, 1, 15, 7, 5)),
    (6, 22, (1, 3, 1, 15, 13, 25)),
    (6, 25, (1, 1, 5, 5, 19, 61)),
    (7, 1, (1, 3, 7, 11, 23, 15, 103)),
    (7, 4, (1, 3, 7, 13, 13, 15, 69)),
)
DIMENSIONS = len(POLYNOMIALS) + 1


def masks(dimension: int) -> list[int]:
    """What each binary digit of a point's Gray code, from the lowest, turns over in its coordinate of BITS bits."""
    if dimension == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    degree, inner, first = POLYNOMIALS[dimension - 1]
    found = [m << (BITS - 1 - k) for k, m in enumerate(first)]
    for k in range(degree, BITS):
        terms = [found[k - back] for back in range(1, degree) if inner >> (degree - 1 - back) & 1]
        found.append(reduce(int.__xor__, terms, found[k - degree] ^ (found[k - degree] >> degree)))
    return found


def coordinate(number: Column, dimension: int) -> Column:
    """The coordinate in [0, 1) of the point of this number, below 2**BITS, in one of DIMENSIONS dimensions; null beyond."""
    gray = number.bitwiseXOR(F.shiftright(number, 1))
    digit = lambda k: F.shiftright(gray, k).bitwiseAND(F.lit(1).cast("long"))
    turned = reduce(lambda a, b: a.bitwiseXOR(b), (digit(k) * F.lit(m).cast("long") for k, m in enumerate(masks(dimension))))
    return F.when((number >= 0) & (number < 1 << BITS), turned / F.lit(float(1 << BITS)))


def sobol(obs: DataFrame, specs: tuple[Spec, ...], n: int, skip: int = 42) -> DataFrame:
    """The next ``n`` points for every campaign: the sequence goes on behind ``skip`` points and as many as the campaign has trials."""
    if len(specs) > DIMENSIONS:
        raise ValueError(f"at most {DIMENSIONS} parameters")
    made = obs.groupBy("campaign_id").agg(F.count("*").alias("n_trials"))
    rows = made.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("place", F.col("place").cast("long"))
    number = F.col("place") + F.col("n_trials") + skip
    return rows.select("campaign_id", "place", *((F.lit(s.lower) + coordinate(number, i) * (s.upper - s.lower)).alias(s.name) for i, s in enumerate(specs)))
