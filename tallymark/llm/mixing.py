"""Mixing sources to target weights.

Method: hash-threshold histograms.  One pass sums sizes by source and hash bucket; from those sums
each source's budget becomes a nested threshold in hash order (a smaller budget takes a prefix of what
a larger one takes).  Only the bucket the threshold falls in is refined, by a second histogram over its
own sub-buckets and then row by row; every other row is decided by comparing its hash, without sorting.

Edge cases: a null text has size 0 and takes 0 words; null sources form one source, ordered last; a null
id hashes like an empty one; repeated rows are taken one by one; an empty table gives an empty result; an
all-empty table has targets of 0.  Further columns of the input are ignored by ``mix`` and kept by ``resample``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table
from .skew import join_skewed

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
WEIGHTS = (1, 2, 3)
BUCKET_BITS = 12
HASH_BITS = 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with place, its position from 0 in the order of source_key: ranges are numbered by themselves and moved up."""
    ranged = table(sizes.repartitionByRange("source_key").withColumn("range_no", F.spark_partition_id()), "mix-ranges")
    counts = dict(ranged.groupBy("range_no").count().collect())  # one row per shuffle partition
    before = [sum(n for other, n in counts.items() if other < i) for i in range(max(counts, default=0) + 1)]
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy("source_key"))
    place = F.element_at(F.array(*(F.lit(n).cast("long") for n in before)), F.col("range_no") + 1) + inside - 1
    return ranged.withColumn("place", place).drop("range_no")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source_key, source_size -> also weight, target: all sizes shared by weight, none above cap times its source.

    Uncapped sources have the same target per weight.  That level rises as the excess of capped sources is shared
    again, each time by one aggregation over the sources, until no further source is above its cap.
    """
    w = F.element_at(F.array(*(F.lit(x).cast("long") for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    limit = F.lit(cap) * F.col("source_size")
    steps = table(_numbered(sizes).withColumn("weight", w), "mix-weights")
    total, left, open_, capped = None, 0, 0, -1
    while True:
        # Products of word counts and weights outgrow a long.
        full = F.lit(left).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)") > limit.cast("decimal(20,0)") * F.lit(open_).cast("decimal(18,0)") if capped >= 0 else F.lit(False)
        row = steps.agg(F.sum("source_size"), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        total = row[0] or 0
        left, open_, before, capped = total - (row[1] or 0), row[2] or 0, capped, row[3]
        if capped == before or not open_:
            break
    share = F.lit(left) * F.col("weight") / F.lit(open_) if open_ else limit.cast("double")
    return steps.withColumn("target", F.when(full, limit.cast("double")).otherwise(share)).drop("place")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """How many words of each document of ``docs`` (doc_id, text, source) the mix takes.

    A source takes every document floor(target / source_size) times, then documents in hash order until its
    target is met to the word.  Returns doc_id, size, source_size, target, taken.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    sized = docs.select("doc_id", key.alias("source_key"), words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("hash"))
    sized = table(sized, "mix-sizes")
    by_source = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goal = targets(by_source, weights, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("copies", full)
    goal = goal.withColumn("budget", F.greatest(F.floor(F.col("target") + 0.5) - F.col("copies") * F.col("source_size"), F.lit(0)).cast("long"))
    goal = table(goal, "mix-targets")

    first = HASH_BITS - BUCKET_BITS
    second = first - BUCKET_BITS
    rows = sized.withColumn("bucket", F.shiftright("hash", first)).withColumn("part", F.shiftright("hash", second))
    edge = _edge(rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("size")), goal.select("source_key", "budget"), "bucket")
    near = rows.join(edge.select("source_key", "bucket", "left"), ["source_key", "bucket"])
    fine = _edge(near.groupBy("source_key", "part").agg(F.sum("size").alias("size"), F.first("left").alias("budget")), None, "part")
    plan = goal.join(edge.select("source_key", F.col("bucket").alias("edge")), "source_key", "left")
    plan = table(plan.join(fine.select("source_key", F.col("part").alias("fine"), "left"), "source_key", "left"), "mix-plan")
    decided = join_skewed(rows, plan, "source_key", "n_rows")
    # Inside the one boundary sub-bucket rows are few; they are taken in hash order until the budget is used.
    inside = decided.where(F.col("part") == F.col("fine"))
    order = Window.partitionBy("source_key").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = inside.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    taken_first = F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.col("part") < F.coalesce("fine", F.lit(0))))
    outside = decided.where(~F.coalesce(F.col("part") == F.col("fine"), F.lit(False)))
    outside = outside.withColumn("extra", F.when(taken_first & (F.col("budget") > 0), F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    return inside.unionByName(outside).select("doc_id", "size", "source_size", "target", taken)


def _edge(histogram: DataFrame, budgets: DataFrame | None, bucket: str) -> DataFrame:
    """For each source the bucket in which its budget runs out, and what of the budget is left there."""
    counts = histogram if budgets is None else histogram.join(budgets, "source_key")
    upto = Window.partitionBy("source_key").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") > F.col("budget"))
    return counts.groupBy("source_key").agg(F.min(F.struct(F.col(bucket), (F.col("budget") - F.col("upto") + F.col("size")).alias("left"))).alias("edge")).select("source_key", f"edge.{bucket}", "edge.left")


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with each document repeated as often as the mix takes it, in whole documents.

    A document that the mix takes in part counts as whole from one half; rows of equal id (null included) are
    repeated alike; documents without words hold nothing to take and go.
    """
    name = F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string")))
    taken = mix(docs, weights, cap).groupBy(name.alias("name")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.count("*").alias("n_rows"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    taken = table(taken.select("name", "n_rows", times.alias("times")), "mix-times")
    # The row travels as one value, so no column of it can clash with what is joined.
    rows = join_skewed(docs.select(name.alias("name"), F.struct("*").alias("row")), taken, "name", "n_rows").where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
