"""Document fingerprints by consistent weighted sampling.

A document is its multiset of five-word shingles; a shingle's weight is how often it occurs.  For each of
``SAMPLES`` samples every term draws r and c from Gamma(2, 1) and b from the uniform distribution, all from hashes of the term and
the sample's number, and is given the value ln c - r * (floor(ln(weight) / r + b) + 1 - b); the least value of the
document is its sample.  Two documents have the same sample with a probability equal to their generalised
Jaccard similarity, so the share of equal samples estimates it.  Everything is DataFrame functions.

Documents are dealt into ranges of their ids once; everything else, the next document's text included, happens
within a range, whose end holds a copy of the first document of the next.  There are at most MOST_RANGES ranges, so the plan that
holds their bounds does not grow with the table; a larger range is sorted on disk where memory does not hold it.

Edge cases: a null text is empty; a text of fewer than five words has one shingle, its whole sequence; texts without
words have equal fingerprints; a null id comes first in the order; rows of equal id come in the order of their
texts; a single document is its own next; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
SAMPLES = 32
RANGE_ROWS = 1000
# A string holds under 2^31 bytes and a word and its space two, so no shingle occurs more often than these bits can say.
WEIGHT_BITS = 30
MOST_RANGES = 10_000
SPACE = r"[\x20\x09-\x0D]+"
_LEAST_ID = -(1 << 63)


def weighted(text: Column, size: int = SHINGLE) -> Column:
    """The text's distinct shingles of ``size`` words, each one long: 34 bits of its hash, then 30 of its weight."""
    words = F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    code = lambda term, weight: F.shiftleft(term, WEIGHT_BITS).bitwiseOR(weight)

    def runs(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - size, F.lit(0))
        one = F.lit(1).cast("long")
        return F.when(F.size(hashes) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: code(F.xxhash64(F.slice(hashes, i + 1, F.lit(size))), one)))

    def counted(ordered: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        times = lambda at: F.transform(at, lambda i, n: F.get(ordered, i) - 1 + F.least(F.coalesce(F.get(at, n + 1), F.size(ordered)) - i, F.lit((1 << WEIGHT_BITS) - 1)))
        return _bind(firsts, times)

    # Texts without a repeated shingle, most of them, need no counting.
    every = F.coalesce(_bind(words, runs), F.array().cast("array<bigint>"))
    return _bind(every, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), x).otherwise(_bind(F.sort_array(x), counted)))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sample(k: int) -> Column:
    """The ``k``-th value of a row of (term, weight)."""
    first, second = f"xxhash64(term, {k}L)", f"xxhash64({k}L, term)"
    unit = lambda h, shift, bits: f"((shiftright({h}, {shift}) & {(1 << bits) - 1}L) + 0.5D) * {2.0**-bits!r}D"
    c = f"(-ln({unit(first, 0, 31)} * {unit(first, 32, 31)}))"
    r = f"(-ln({unit(second, 0, 21)} * {unit(second, 21, 21)}))"
    b = f"({unit(second, 42, 21)})"
    step = f"(CASE WHEN weight = 1 THEN 0D ELSE floor(ln(cast(weight AS double)) / {r} + {b}) END)"
    return F.expr(f"ln({c}) - {r} * ({step} + 1D - {b})")


def _bounds(docs: DataFrame, rows: int) -> list[int]:
    """Ids that part ``docs`` into ranges of about ``rows`` rows, or MOST_RANGES larger ones; the first is the least id."""
    n, least = docs.agg(F.count("*"), F.min("key")).first()
    if not n:
        return [_LEAST_ID]
    parts = min(max(1, round(n / rows)), MOST_RANGES)
    inner = docs.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] if parts > 1 else []
    return sorted({least, *inner})


def _range(key: Column, bounds: list[int]) -> tuple[Column, Column]:
    """The number of the range of a key, and whether the key is the range's first; two searches of about the square root."""
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    tops = F.array(*(F.lit(g[0]) for g in groups))
    rows = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    at = F.greatest(F.size(F.filter(tops, lambda x: x <= key)), F.lit(1))
    row = F.element_at(rows, at)
    inner = F.greatest(F.size(F.filter(row, lambda x: x <= key)), F.lit(1))
    return (at - 1) * width + inner - 1, F.element_at(row, inner) == key


def neighbours(docs: DataFrame, samples: int = SAMPLES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by the start of the next document.  Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("key"))
    bounds = _bounds(own.select("key"), range_rows)
    part, first = _range(F.col("key"), bounds)
    placed = own.withColumn("part", part).withColumn("first", first)
    home = F.struct(F.col("part").alias("part"), F.lit(0).alias("guard"))
    before = F.struct(F.when(F.col("part") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("part") - 1).alias("part"), F.lit(1).alias("guard"))
    copies = placed.select("doc_id", "text", "key", F.explode(F.when(F.col("first"), F.array(home, before)).otherwise(F.array(home))).alias("at"))
    order = Window.partitionBy("part").orderBy("guard", "key", "text")
    rows = copies.select("doc_id", "text", "key", "at.part", "at.guard")
    rows = rows.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)

    # Terms that the text and its edited form have alike are drawn once.  Everything from here on stays within a range.
    own = rows.select("part", "place", "guard", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), weighted(F.col("text")).alias("a"), F.when(F.col("guard") == 0, weighted(F.col("edited"))).alias("b"))
    none, start = F.array().cast("array<bigint>"), F.array(F.lit(None).cast("bigint"))
    b = F.coalesce("b", none)
    side = lambda of, terms, info=None: F.struct(F.lit(of).alias("side"), terms.alias("terms"), (F.lit(None) if info is None else info).cast("string").alias("info"))
    sides = F.array(side(0, start, F.col("edited_sha256")), side(1, F.array_except("a", b)), side(2, F.array_except(b, "a")), side(3, F.array_intersect("a", b)))
    keys = ["part", "place", "guard", "doc_id", "n_chars", "side", "info"]
    terms = own.select("part", "place", "guard", "doc_id", "n_chars", F.inline(sides)).select(*keys, F.explode("terms").alias("code"))
    terms = terms.select(*keys, F.shiftright("code", WEIGHT_BITS).alias("term"), F.col("code").bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1)).alias("weight"))
    least = terms.groupBy(*keys).agg(*(F.min(sample(k)).alias(f"m{k}") for k in range(samples)))
    of = lambda kind, k: F.min(F.when(F.col("side").bitwiseAND(F.lit(kind)) > 0, F.col(f"m{k}")))
    docs_ = least.groupBy("part", "place", "guard", "doc_id", "n_chars").agg(F.max("info").alias("edited_sha256"), *(of(kind, k).alias(f"{name}{k}") for kind, name in ((1, "a"), (2, "b")) for k in range(samples)))
    code = lambda c: F.lpad(F.hex(F.coalesce(F.xxhash64(c).bitwiseAND(F.lit(0xFFFF)), F.lit(0))), 4, "0")
    text_of = lambda name: F.lower(F.concat(*(F.when(F.col(f"{name}{k}").isNotNull(), code(f"{name}{k}")).otherwise(F.lit("0000")) for k in range(samples))))
    prints = docs_.select("part", "place", "guard", "doc_id", "n_chars", "edited_sha256", text_of("a").alias("print"), text_of("b").alias("edited_print"))

    after = F.lead("print").over(Window.partitionBy("part").orderBy("place"))
    out = prints.select("*", after.alias("next_print")).where("guard = 0")
    near = lambda other: F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substring("print", i * 4 + 1, F.lit(4)) == F.substring(other, i * 4 + 1, F.lit(4)))) / F.lit(samples)
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"), near("edited_print").alias("near_edited"), near("next_print").alias("near_next"))
