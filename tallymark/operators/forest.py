"""Random forests over campaigns, grown level by level from histograms."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import norm_cdf, norm_pdf, tidy
from ..model import Spec
from ..sources.tables import keep
from .prefer import unit
from .sequence import coordinate

TREES = 10
DEPTH = 5
BINS = 64
LEAF = 2
SEED = 42
MOST_TIMES = 8
NODE_BITS = 20
# Rows of a campaign that grows whole, and of all campaigns that one task grows at a time.
MOST_ROWS = 20_000
BLOCK_ROWS = 40_000
PACK = 1000


def _bin(spec: Spec, bins: int, x: Column) -> Column:
    return F.least(F.greatest(F.floor((x - spec.lower) / (spec.upper - spec.lower) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def chances() -> list[float]:
    """The chances that a row is drawn at most 0, 1, ... times when as many rows are drawn as there are."""
    upto, out = 0.0, []
    for k in range(MOST_TIMES):
        upto += math.exp(-1) / math.factorial(k)
        out.append(upto)
    return out


def times(tree: Column, *key: Column, seed: int = SEED) -> Column:
    """How often a tree draws a row: a Poisson number that depends on the tree and the row alone."""
    return _count(unit(F.lit(seed), tree, *key))


def _count(u: Column) -> Column:
    return sum((F.when(u > c, 1).otherwise(0) for c in chances()), F.lit(0))


def tried(tree: Column, node: Column, feature: int, features: int, seed: int = SEED) -> Column:
    """Whether a node tries a parameter: it tries the root of their number, those of the lowest draws."""
    draw = lambda f: unit(F.lit(seed), tree, node, F.lit(f))
    ahead = sum((F.when(draw(f) < draw(feature), 1).otherwise(0) for f in range(features) if f != feature), F.lit(0))
    return ahead < max(1, math.isqrt(features))


def _choices(trees: int, depth: int, features: int, seed: int) -> np.ndarray:
    """For every tree and node of ``depth`` levels whether it tries a parameter: what ``tried`` says, without rows."""

    def draw(tree: int, node: int, f: int) -> float:
        return (int(hashlib.md5(f"{seed}:{tree}:{node}:{f}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52

    out = np.zeros((trees, 2**depth, features), dtype=bool)
    for t in range(trees):
        for node in range(2**depth - 1):
            draws = [draw(t, node, f) for f in range(features)]
            out[t, node] = [sum(x < own for x in draws) < max(1, math.isqrt(features)) for own in draws]
    return out


def _grow_blocks(rows: DataFrame, groups: Column, n: int, trees: int, depth: int, bins: int, leaf: int, seed: int) -> DataFrame:
    """Splits and leaves of campaigns whose sums are whole numbers below 2 ** 53 in ten thousandths, many campaigns to a task's block.

    All trees of a block's campaigns grow a level at a time, as counts over campaign, tree, node, parameter and step.  The sums are exact, so the
    cuts are those of ``_grow_levels``.
    """
    chosen = _choices(trees, depth, n, seed)

    def drawn_times(keys: list[str]) -> np.ndarray:
        # What ``times`` says; 52 bits are the first of a digest's 8 bytes but 12.
        md5, heads = hashlib.md5, [f"{seed}:{t}:".encode() for t in range(trees)]
        digests = b"".join(md5(head + key).digest() for key in map(str.encode, keys) for head in heads)
        first = np.frombuffer(digests, dtype=">u8")[::2] >> np.uint64(12)
        return np.searchsorted(chances(), (first.astype(float) + 0.5) / 2.0**52, side="left").reshape(-1, trees)

    def grown(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = lambda name, width: pc.list_flatten(table[name]).to_numpy().reshape(-1, width)
        steps, times, y = flat("steps", n), drawn_times(table["name"].to_pylist()), table["units"].to_numpy().astype(float)
        names = table["campaign_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        who, count = names.indices.to_numpy(), len(names.dictionary)
        row, tree = np.nonzero(times)
        drawn, y, steps = times[row, tree].astype(float), y[row], steps[row]
        line, node = who[row].astype(np.int64) * trees + tree, np.zeros(len(row), dtype=np.int64)
        found = []
        for level in range(depth):
            first = 2**level - 1
            live = np.flatnonzero(node >= first)
            key, place = np.unique(line[live] * 2**depth + node[live], return_inverse=True)
            best = np.zeros(len(key))
            feature, cut = np.full(len(key), -1), np.zeros(len(key), dtype=np.int64)
            tries = chosen[key // 2**depth % trees, key % 2**depth]
            for f in range(n):
                # Nodes that try the parameter, numbered; ties go to the first parameter and the lowest step.
                nodes = np.flatnonzero(tries[:, f])
                number = np.full(len(key), -1)
                number[nodes] = np.arange(len(nodes))
                ours = number[place] >= 0
                at = number[place[ours]] * bins + steps[live[ours], f]
                k = drawn[live[ours]]
                cells = np.bincount(at, k, len(nodes) * bins).reshape(-1, bins)
                sums = np.bincount(at, k * y[live[ours]], len(nodes) * bins).reshape(-1, bins)
                nl, sl = cells.cumsum(axis=1), sums.cumsum(axis=1)
                nn, ss = nl[:, -1:], sl[:, -1:]
                held = (cells > 0) & (nl >= leaf) & (nn - nl >= leaf) & (nn > leaf)
                left, right, both = sl / 10000, (ss - sl) / 10000, ss / 10000
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(held, left * left / nl + right * right / (nn - nl) - both * both / nn, -np.inf)
                top = gain.argmax(axis=1) if len(nodes) else np.empty(0, dtype=int)
                most = gain[np.arange(len(nodes)), top]
                better = most > best[nodes]
                best[nodes[better]], feature[nodes[better]], cut[nodes[better]] = most[better], f, top[better]
            split = feature >= 0
            found.append((key[split] // 2**depth, key[split] % 2**depth, feature[split], cut[split], best[split]))
            own, moving = place, split[place]
            goes = steps[live, np.maximum(feature[own], 0)] <= cut[own]
            node[live] = np.where(moving, 2 * node[live] + np.where(goes, 1, 2), node[live])
            # Nodes of this level that do not split keep their number, which is below the next level's.
        ends, place = np.unique(line * 2 ** (depth + 1) + node, return_inverse=True)
        total = np.bincount(place, drawn, len(ends))
        mean = np.bincount(place, drawn * y, len(ends)) / 10000 / np.maximum(total, 1)
        parts = [np.concatenate([p[i] for p in found]) for i in range(5)]
        whose = np.concatenate([parts[0], ends // 2 ** (depth + 1)])
        some, rest = len(parts[0]), len(ends)
        holes = lambda values, front: pa.array(np.concatenate([np.zeros(some, values.dtype), values] if front else [values, np.zeros(rest, values.dtype)]), mask=np.repeat([front, not front], [some, rest]))
        made = [names.dictionary.take(pa.array(whose // trees)), pa.array((whose % trees).astype(np.int32)), pa.array(np.concatenate([parts[1], ends % 2 ** (depth + 1)]).astype(np.int32))]
        made += [holes(parts[2].astype(np.int32), False), holes(parts[3].astype(np.int32), False), holes(parts[4], False), holes(total.astype(np.int64), True), holes(mean, True)]
        return pa.Table.from_arrays(made, ["campaign_id", "tree", "node", "feature", "cut", "gain", "n", "mean"])

    schema = f"campaign_id {rows.schema['campaign_id'].dataType.simpleString()}, tree int, node int, feature int, cut int, gain double, n bigint, mean double"
    return rows.select("campaign_id", "steps", "name", (F.col("y") * 10000).cast("long").alias("units"), groups.alias("block_")).groupBy("block_").applyInArrow(grown, schema)


def grow(obs: DataFrame, specs: tuple[Spec, ...], trees: int = TREES, depth: int = DEPTH, bins: int = BINS, leaf: int = LEAF, seed: int = SEED, most: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The splits (campaign_id, tree, node, feature, cut, gain) and the leaves (campaign_id, tree, node, n, mean) of each campaign's forest.

    Successes with all parameters and an objective teach.  Parameters count by ``bins`` equal steps of their range.  A node splits where the squares of
    the sides' sums over their counts are largest, if both sides hold ``leaf`` rows; node k has the children 2k + 1 (steps up to the cut) and 2k + 2.
    Objectives are added as decimals of four digits, so results do not depend on the order of rows.  Campaigns of up to ``most`` rows and of sums that
    doubles hold exactly grow whole, many to a block; larger ones level by level over all tasks, to the same result.
    """
    n = len(specs)
    taught = obs.where("NOT is_failure").dropna(subset=["kpi", *(s.name for s in specs)])
    # What ``unit`` hashes behind the seed and the tree.
    name = F.concat_ws(":", F.col("campaign_id").cast("string"), F.col("iteration").cast("string"))
    rows = taught.select("campaign_id", name.alias("name"), F.col("kpi").cast("decimal(18,4)").alias("y"), F.array(*(_bin(s, bins, F.col(s.name)) for s in specs)).alias("steps"))
    facts = rows.groupBy("campaign_id").agg(F.count("*").alias("n_"), F.sum(F.abs("y").cast("double")).alias("size_"))
    small = (F.col("n_") <= most) & (F.col("size_") * MOST_TIMES < 2.0**52 / 10000)
    rows = keep(rows.join(facts.select("campaign_id", small.alias("small")), "campaign_id", "left").fillna(False, ["small"]), "forest-rows")
    blocks = max(1, -(-rows.where("small").count() // BLOCK_ROWS))
    whole = keep(_grow_blocks(rows.where("small"), F.pmod(F.xxhash64("campaign_id"), F.lit(blocks)), n, trees, depth, bins, leaf, seed), "forest-grown")
    splits, leaves = whole.where("feature IS NOT NULL").select("campaign_id", "tree", "node", "feature", "cut", "gain"), whole.where("n IS NOT NULL").select("campaign_id", "tree", "node", "n", "mean")
    if rows.where("NOT small").isEmpty():
        return splits, leaves
    # The numbers are made before they are compared: written out they would be hashed anew for each comparison.
    weights = F.transform(F.array(*(unit(F.lit(seed), F.lit(t), F.col("name")) for t in range(trees))), _count)
    more, ends = _grow_levels(rows.where("NOT small").select("campaign_id", "y", "steps", weights.alias("times")), n, trees, depth, leaf, seed)
    return splits.unionByName(more.select(*(F.col(f.name).cast(f.dataType) for f in splits.schema))), leaves.unionByName(ends.select(*(F.col(f.name).cast(f.dataType) for f in leaves.schema)))


def _grow_levels(rows: DataFrame, n: int, trees: int, depth: int, leaf: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Forests of campaigns of any size.  Each level adds up, for every node of every tree, the drawn rows and their objectives by parameter and
    step: sums that are partly made before the shuffle, of a size that the bins bound; no campaign comes into one task.
    """
    rows = keep(rows.withColumn("nodes", F.array_repeat(F.lit(0), trees)), "forest-rows")
    splits, key = None, ["campaign_id", "tree", "node"]
    for level in range(depth):
        drawn = rows.select("campaign_id", "y", "steps", F.posexplode(F.arrays_zip("times", "nodes")).alias("tree", "at")).select("campaign_id", "y", "steps", "tree", "at.*")
        drawn = drawn.where("times > 0").withColumnRenamed("nodes", "node").where(F.col("node") >= 2**level - 1)
        # What a node tries depends on the tree and the node alone: one row for each, at most the trees times the level's nodes.
        choices = drawn.sparkSession.range(trees * 2**level).select((F.col("id") % trees).cast("int").alias("tree"), (F.floor(F.col("id") / trees) + 2**level - 1).cast("int").alias("node"))
        choices = choices.withColumn("features", F.filter(F.array(*(F.when(tried(F.col("tree"), F.col("node"), f, n, seed), F.lit(f)) for f in range(n))), lambda f: f.isNotNull()))
        each = F.transform("features", lambda f: F.struct(f.alias("feature"), F.get("steps", f).alias("step")))
        cells = drawn.join(F.broadcast(choices), ["tree", "node"]).select(*key, "y", "times", F.inline(each)).groupBy(*key, "feature", "step").agg(F.sum("times").alias("n"), F.sum((F.col("y") * F.col("times")).cast("decimal(38,4)")).alias("s"))
        line = Window.partitionBy(*key, "feature")
        upto = line.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        sides = cells.select(*key, "feature", "step", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"), F.sum("n").over(line).alias("nn"), F.sum("s").over(line).alias("ss"))
        sides = sides.where((F.col("nl") >= leaf) & (F.col("nn") - F.col("nl") >= leaf) & (F.col("nn") > leaf))
        left, right = F.col("sl").cast("double"), (F.col("ss") - F.col("sl")).cast("double")
        gain = left * left / F.col("nl") + right * right / (F.col("nn") - F.col("nl")) - F.col("ss").cast("double") * F.col("ss").cast("double") / F.col("nn")
        sides = sides.select(*key, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("step")).alias("c")).alias("cut"))
        best = sides.groupBy(*key).agg(F.max("cut").alias("cut")).where("cut.gain > 0").select(*key, (-F.col("cut.f")).alias("feature"), (-F.col("cut.c")).alias("cut"), "cut.gain")
        best = keep(best, "forest-splits")
        splits = best if splits is None else splits.unionByName(best)
        # A campaign's splits of one level are at most its trees times the level's nodes, and go to each of its rows as one map.
        known = best.groupBy("campaign_id").agg(_mapped(F.struct("feature", "cut")).alias("known"))
        moved = F.transform("nodes", lambda node, t: _child(F.col("known"), t, node, F.col("steps")))
        rows = keep(rows.join(known, "campaign_id", "left").withColumn("nodes", moved).drop("known"), "forest-rows")
    ends = rows.select("campaign_id", "y", F.posexplode(F.arrays_zip("times", "nodes")).alias("tree", "at")).select("campaign_id", "y", "tree", "at.*").where("times > 0")
    total = F.sum((F.col("y") * F.col("times")).cast("decimal(38,4)")).cast("double")
    leaves = ends.groupBy("campaign_id", "tree", F.col("nodes").alias("node")).agg(F.sum("times").alias("n"), (total / F.sum("times")).alias("mean"))
    return splits, keep(leaves, "forest-leaves")


def _mapped(value: Column) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(_place(F.col("tree"), F.col("node")), value.alias("value"))))


def _place(tree: Column, node: Column) -> Column:
    return F.shiftleft(tree.cast("long"), NODE_BITS) + node


def _child(known: Column, tree: Column, node: Column, steps: Column) -> Column:
    """The child that a row goes to, or the node itself where it does not split."""
    split = F.try_element_at(known, _place(tree, node))
    return F.when(split.isNull(), node).otherwise(2 * node + F.when(F.get(steps, split["feature"]) <= split["cut"], 1).otherwise(2))


def predict(rows: DataFrame, splits: DataFrame, leaves: DataFrame, specs: tuple[Spec, ...], trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> DataFrame:
    """``rows`` with mu and sigma: the mean of the trees of a row's campaign and their deviation (n - 1).

    Rows fall in packs of one campaign, ``PACK`` at most, which meet its forest once: at most 2 ** (depth + 1) nodes a tree.  A tree that drew no row says nothing.
    """
    size = 2 ** (depth + 1)
    place = (F.col("tree") * size + F.col("node")).alias("at")
    splitting = splits.groupBy("campaign_id").agg(F.collect_list(F.struct(place, F.col("feature").cast("int").alias("feature"), F.col("cut").cast("int").alias("cut"))).alias("s"))
    ending = leaves.groupBy("campaign_id").agg(F.collect_list(F.struct(place, "mean")).alias("e"))
    forest = ending.join(splitting, "campaign_id", "left").select("campaign_id", F.col("e.at").alias("e_at"), "e.mean", *(F.coalesce(F.col(f"s.{c}"), F.array().cast("array<int>")).alias(f"s_{c}") for c in ("at", "feature", "cut")))
    steps = F.array(*(_bin(s, bins, F.col(s.name)) for s in specs))
    packs = rows.select("campaign_id", F.floor(F.monotonically_increasing_id() / PACK).alias("pack_"), F.struct(*rows.columns).alias("row"), steps.alias("steps"))
    packs = packs.groupBy("campaign_id", "pack_").agg(F.collect_list(F.struct("row", "steps")).alias("p")).select("campaign_id", F.col("p.row").alias("rows"), F.flatten("p.steps").alias("steps"))

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            told = []
            for i in range(len(batch)):
                steps, e_at, mean, s_at, s_feature, s_cut = (c[n][i].values.to_numpy(zero_copy_only=False) for n in ("steps", "e_at", "mean", "s_at", "s_feature", "s_cut"))
                steps = steps.reshape(-1, len(specs))
                feature, cut, said = np.full(trees * size, -1), np.zeros(trees * size), np.full(trees * size, np.nan)
                feature[s_at], cut[s_at], said[e_at] = s_feature, s_cut, mean
                node, base, every = np.zeros((len(steps), trees), dtype=int), np.arange(trees) * size, np.arange(len(steps))[:, None]
                for _ in range(depth):
                    own = base + node
                    up = steps[every, np.maximum(feature[own], 0)] <= cut[own]
                    node = np.where(feature[own] >= 0, 2 * node + np.where(up, 1, 2), node)
                says = said[base + node]
                held = ~np.isnan(says)
                n, total, spread = held.sum(axis=1), np.zeros(len(says)), np.zeros(len(says))
                for t in range(trees):
                    total += np.where(held[:, t], says[:, t], 0.0)
                mu = total / np.maximum(n, 1)
                for t in range(trees):
                    spread += np.where(held[:, t], (says[:, t] - mu) ** 2, 0.0)
                told.append((mu, np.sqrt(np.maximum(spread / np.maximum(n - 1, 1), 1e-12)), n.astype(np.int32)))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t[0]) for t in told])]).astype(np.int32))
            more = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([t[j] for t in told]))) for j in range(3)]
            yield pa.RecordBatch.from_arrays([c["rows"], *more], ["rows", "mu", "sigma", "n"])

    schema = T.StructType([T.StructField("rows", packs.schema["rows"].dataType), T.StructField("mu", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.ArrayType(T.DoubleType())), T.StructField("n", T.ArrayType(T.IntegerType()))])
    told = packs.join(forest, "campaign_id").mapInArrow(fall, schema)
    told = told.select(F.inline(F.arrays_zip("rows", "mu", "sigma", "n"))).where("n > 0")
    return told.select("rows.*", "mu", "sigma")


def suggest(obs: DataFrame, specs: tuple[Spec, ...], n: int = 3, maximize: bool = False, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """For every campaign with three successes the ``n`` of its candidates that promise the largest improvement by its forest.

    The candidates, 20 a parameter and 100 at least, are the Sobol points behind as many as the campaign has trials.  Equal promises go
    by the candidate's place.
    """
    sign = -1 if maximize else 1
    signed = obs.withColumn("kpi", sign * F.col("kpi"))
    splits, leaves = grow(signed, specs, trees, depth, seed=seed)
    good = F.when(~F.col("is_failure"), F.col("kpi"))
    known = signed.groupBy("campaign_id").agg(F.count("*").alias("n_trials"), F.min(good).alias("best"), F.count(good).alias("n_good")).where("n_good >= 3")
    rows = known.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(max(100, 20 * len(specs)) - 1))))
    number = F.col("place").cast("long") + F.col("n_trials") + seed
    rows = rows.select("campaign_id", "best", "place", *((F.lit(s.lower) + coordinate(number, i) * (s.upper - s.lower)).alias(s.name) for i, s in enumerate(specs)))
    told = predict(rows, splits, leaves, specs, trees, depth)
    gap = F.col("best") - F.col("mu")
    told = told.withColumn("promise", tidy(gap * norm_cdf(gap / F.col("sigma")) + F.col("sigma") * norm_pdf(gap / F.col("sigma")), 6))
    rank = F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("promise"), "place"))
    return told.withColumn("rank", rank).where(F.col("rank") <= n).select("campaign_id", "rank", *(s.name for s in specs), tidy(sign * F.col("mu"), 4).alias("mu"), tidy(F.col("sigma"), 4).alias("sigma"), "promise")
