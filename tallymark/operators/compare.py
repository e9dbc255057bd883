"""Logs and rule sets against each other, leaderboards, and the audit chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import tidy


def log_compare(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Two logs joined by campaign and position, cut to the shorter: which fields agree at each position."""
    left = a.select("campaign_id", "iteration", *(F.col(f).alias(f"{f}_a") for f in fields))
    right = b.select("campaign_id", "iteration", *(F.col(f).alias(f"{f}_b") for f in fields))
    rows = left.join(right, ["campaign_id", "iteration"])
    same = {f: F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")) for f in fields}
    every = None
    for c in same.values():
        every = c if every is None else every & c
    return rows.select("campaign_id", "iteration", *(c.alias(f"same_{f}") for f, c in same.items()), every.alias("same"))


def first_divergence(compared: DataFrame) -> DataFrame:
    return compared.groupBy("campaign_id").agg(F.count("*").alias("n_compared"), F.count_if(~F.col("same")).alias("n_different"), F.min(F.when(~F.col("same"), F.col("iteration"))).alias("first_difference"))


def rule_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full outer difference of two rule sets by key: added, removed, modified or unchanged."""
    left = a.select(key, F.lit(1).alias("in_a"), *(F.col(f).alias(f"{f}_a") for f in fields))
    right = b.select(key, F.lit(1).alias("in_b"), *(F.col(f).alias(f"{f}_b") for f in fields))
    joined = left.join(right, key, "full_outer")
    changed = sum(((~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b"))).cast("int") for f in fields), F.lit(0))
    state = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(changed > 0, "modified").otherwise("unchanged")
    return joined.select(key, state.alias("state"), F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), changed).otherwise(0).cast("int").alias("n_changed"))


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical string."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def chain(log: DataFrame, columns: list[str], by: str = "campaign_id", order: str = "iteration") -> DataFrame:
    """Each row's link: the hash of the link before it in its chain and of its own content, so a link depends on all before it.

    A chain is one fold in its order; whole chains are dealt to tasks, which stream through them and hold one link of each at a time.
    """
    rows = log.withColumn("content_hash", content_hash(columns)).withColumn("chain_key", F.col(by).cast("string"))
    dealt = rows.repartition("chain_key").sortWithinPartitions("chain_key", order)
    names = [*rows.columns, "chain_hash"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, link = object(), ""
        for batch in batches:
            links = []
            for at, content in zip(batch.column("chain_key").to_pylist(), batch.column("content_hash").to_pylist()):
                if at != key:
                    key, link = at, ""
                link = hashlib.sha256((link + content).encode()).hexdigest()
                links.append(link)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(links, pa.string())], names=names)

    return dealt.mapInArrow(fold, T.StructType([*rows.schema.fields, T.StructField("chain_hash", T.StringType())])).drop("chain_key")


def verify_chain(log: DataFrame, columns: list[str], by: str = "campaign_id", order: str = "iteration") -> DataFrame:
    """Every link of a chained log against the stored link before it and its content: how many do not hold, and the first of each chain."""
    before = F.coalesce(F.lag("chain_hash").over(Window.partitionBy(by).orderBy(order)), F.lit(""))
    bad = F.coalesce(F.col("chain_hash") != F.sha2(F.concat(before, content_hash(columns)), 256), F.lit(True))
    rows = log.select(by, order, bad.alias("bad"))
    return rows.groupBy(by).agg(F.count("*").alias("n_links"), F.count_if("bad").alias("n_broken"), F.min(F.when(F.col("bad"), F.col(order))).alias("first_broken"))


def leaderboard(results: DataFrame, scenario: str, player: str, regret: str) -> DataFrame:
    """Players by wins (ties included), mean rank and mean regret over scenarios."""
    place = F.rank().over(Window.partitionBy(scenario).orderBy(regret))
    ranked = results.withColumn("place", place)
    return ranked.groupBy(player).agg(F.count("*").alias("n_scenarios"), F.count_if(F.col("place") == 1).alias("wins"), tidy(F.avg("place")).alias("mean_rank"), tidy(F.avg(regret), 4).alias("mean_regret"))


def kendall(table: DataFrame, item: str, a: str, b: str, group: str) -> DataFrame:
    """Kendall's tau of two scores of a group's items: agreeing less opposed pairs over all pairs.

    No pairs are made.  Items get their places by ``b``; two places first differ at one bit, so items are counted once at every bit: among those
    that agree above it, ordered by ``a``, each with a 1 there agrees with the 0s before it and opposes the 0s behind it.  Items without a group take no
    part; an item without a score is in all of its pairs, which neither agree nor oppose.  ``item`` tells a group's items apart.  tau is null
    where under two items have both scores, and a group of one item has no row.
    """
    rows = table.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    scored = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n_scored")).where("n > 1")
    places = scored.groupBy(group, b).agg(F.count("*").alias("same")).withColumn("y", F.row_number().over(Window.partitionBy(group).orderBy(b)) - 1).drop("same")
    # Only as many bits as the group's greatest place has.
    places = places.withColumn("bits", F.ceil(F.log2(F.max("y").over(Window.partitionBy(group)) + 1)).cast("int"))
    each = scored.select(group, F.col(a).alias("x"), b).join(places, [group, b])
    each = each.where("bits > 0").select(group, "x", "y", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bit"))
    each = each.select(group, "bit", F.call_function("shiftright", "y", F.col("bit") + 1).alias("above"), "x", F.call_function("shiftright", "y", "bit").bitwiseAND(1).alias("one"))
    steps = each.groupBy(group, "bit", "above", "x").agg(F.sum("one").alias("ones"), F.sum(1 - F.col("one")).alias("zeros"))
    line = Window.partitionBy(group, "bit", "above")
    upto = F.sum("zeros").over(line.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    score = F.col("ones") * ((upto - F.col("zeros")) - (F.sum("zeros").over(line) - upto))
    found = steps.select(group, score.alias("score")).groupBy(group).agg(F.sum("score").alias("score"))
    n_pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    tau = F.when(F.col("n_scored") > 1, F.coalesce("score", F.lit(0)) / n_pairs)
    return sizes.join(found, group, "left").select(group, n_pairs.alias("n_pairs"), tidy(tau).alias("tau"))


def merge_portfolio(parts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Partial means combined by their counts."""
    return parts.groupBy(*keys).agg(F.sum(n).alias("n"), tidy(F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n)), 4).alias("mean_value"))


def failure_taxonomy(table: DataFrame, reason: str) -> DataFrame:
    """Failure reasons counted by keyword class."""
    text = F.lower(F.coalesce(F.col(reason), F.lit("")))
    # Keywords of each class, tried in this order.
    words = {"hardware": "pump|valve|motor|sensor|leak|clog", "chemistry": "precipitat|decompos|reaction|solub", "protocol": "timeout|abort|skip|manual", "data": "missing|nan|parse|corrupt|error"}
    kind = F.lit("unknown")
    for name, pattern in reversed(words.items()):
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
    return table.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
