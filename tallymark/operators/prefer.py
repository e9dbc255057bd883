"""Preferences over several objectives, hypervolume by point, resampled rankings, costs and strategies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_corr, tidy
from ..model import TASK_ROWS
from ..sources.tables import keep
from .pareto import front


def scalarized(objectives: dict[str, str], weights: dict[str, float], method: str = "weighted_sum") -> Column:
    """One score of several objectives ("maximize" or "minimize"), higher is better; weights are shared out to 1."""
    total = sum(weights.get(n, 1.0) for n in objectives)
    values = [((weights.get(n, 1.0) / total if total > 0 else weights.get(n, 1.0)), F.coalesce(F.col(n), F.lit(0.0)) * (-1 if way == "minimize" else 1)) for n, way in objectives.items()]
    if method == "tchebycheff":
        return F.least(*(w * v for w, v in values)) if len(values) > 1 else values[0][0] * values[0][1]
    if method == "achievement":
        return -F.greatest(*(w * F.abs(v) for w, v in values)) if len(values) > 1 else -values[0][0] * F.abs(values[0][1])
    return sum((w * v for w, v in values), F.lit(0.0))


def in_bands(table: DataFrame, bands: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows whose objectives lie in all bands, bounds included; a missing objective or bound excludes nothing."""
    test = F.lit(True)
    for name, (low, high) in bands.items():
        if low is not None:
            test = test & F.coalesce(F.col(name) >= low, F.lit(True))
        if high is not None:
            test = test & F.coalesce(F.col(name) <= high, F.lit(True))
    return table.where(test)


def focus_region(table: DataFrame, group: str, key: str, aims: dict[str, float]) -> DataFrame:
    """Each group's rows ranked by the distance of their objectives from the aims, scaled to the group's ranges."""
    bounds = table.groupBy(group).agg(*(F.min(n).alias(f"lo_{n}") for n in aims), *(F.max(n).alias(f"hi_{n}") for n in aims))
    span = lambda n: F.col(f"hi_{n}") - F.col(f"lo_{n}")
    apart = F.sqrt(sum((F.when(span(n) > 0, ((F.coalesce(F.col(n), F.lit(0.0)) - aim) / span(n)) ** 2).otherwise(0.0) for n, aim in aims.items()), F.lit(0.0)))
    rows = table.join(bounds, group).select(group, key, tidy(apart).alias("distance"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("distance", key)).cast("int"))


def hypervolume_shares(table: DataFrame, a: str, b: str, group: str, key: str) -> DataFrame:
    """Rows of each group ranked by how much of the area that two minimised objectives dominate is theirs alone.

    The reference point is the group's worst of either objective and a tenth more.  Points that others dominate, or that occur
    twice, add nothing; a point of the front adds the rectangle between its neighbours.
    """
    worst = table.groupBy(group).agg((F.max(a) * 1.1 + 1e-9).alias("ra"), (F.max(b) * 1.1 + 1e-9).alias("rb"))
    points = table.groupBy(group, a, b).agg(F.count("*").alias("n"))
    line = Window.partitionBy(group).orderBy(a, b)
    ahead = F.min(b).over(line.rowsBetween(Window.unboundedPreceding, -1))
    front = points.withColumn("ahead", ahead).where(F.col("ahead").isNull() | (F.col(b) < F.col("ahead"))).drop("ahead").join(worst, group)
    along = Window.partitionBy(group).orderBy(a)
    # What a point alone dominates ends where the next point of the front begins, unless dominated ones are uncovered: those count too.
    nxt, before = F.coalesce(F.lead(a).over(along), F.col("ra")), F.coalesce(F.lag(b).over(along), F.col("rb"))
    box = front.select(group, a, b, "n", nxt.alias("next_a"), before.alias("before_b"))
    # Every other point lies behind one point of the front, the last at or before it; a window finds it without pairing points.
    marked = points.select(group, a, b).join(box.select(group, a, b, F.struct(a, b, "next_a", "before_b").alias("f")), [group, a, b], "left")
    behind = marked.withColumn("at", F.last("f", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))).where("f IS NULL")
    inner = behind.select(group, F.col(a).alias("pa"), F.col(b).alias("pb"), "at.*").where(F.col("pb") < F.col("before_b"))
    stairs = inner.groupBy(group, a, b, "next_a", "before_b", "pa").agg(F.min("pb").alias("pb"))
    low = F.least(F.coalesce(F.min("pb").over(Window.partitionBy(group, a, b).orderBy("pa").rowsBetween(Window.unboundedPreceding, -1)), F.col("before_b")), F.col("before_b"))
    covered = stairs.withColumn("low", low).where("pb < low").groupBy(group, a, b).agg(F.sum((F.col("next_a") - F.col("pa")) * (F.col("low") - F.col("pb"))).alias("covered"))
    own = box.join(covered, [group, a, b], "left")
    share = F.when(F.col("n") == 1, (F.col("next_a") - F.col(a)) * (F.col("before_b") - F.col(b)) - F.coalesce("covered", F.lit(0.0))).otherwise(0.0)
    rows = table.join(own.select(group, a, b, share.alias("share")), [group, a, b], "left").select(group, key, tidy(F.coalesce("share", F.lit(0.0)), 4).alias("share"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("share"), key)).cast("int"))


# The most that a normal number drawn from two of ``unit`` differs from 0, sqrt(106 ln 2), and a little more.
REACH = 8.58


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that only depends on its arguments: 52 bits of their MD5."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def hypervolume_sampled(table: DataFrame, objectives: list[str], reference: list[float], group: str, samples: int = 200) -> DataFrame:
    """The volume that a group's minimised objectives dominate, by the share of repeatable random points of their box that they do.

    What lies behind a group's front decides no point, so points only meet the front.  A null objective dominates nothing.
    """
    valid = table.where(" AND ".join(f"{n} < {r!r}" for n, r in zip(objectives, reference))).where(F.col(group).isNotNull())
    valid = front(valid.select(group, *objectives), objectives, [group]).distinct()
    ideal = valid.groupBy(group).agg(*(F.min(n).alias(f"lo_{n}") for n in objectives))
    points = ideal.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    at = [(F.col(f"lo_{n}") + unit(F.col(group), F.col("draw"), F.lit(i)) * (F.lit(r) - F.col(f"lo_{n}"))).alias(f"at_{n}") for i, (n, r) in enumerate(zip(objectives, reference))]
    drawn = points.select(group, "draw", *at, *(f"lo_{n}" for n in objectives))
    under = F.lit(True)
    for n in objectives:
        under = under & (F.col(n) <= F.col(f"at_{n}"))
    hit = drawn.join(valid, group).groupBy(group, "draw", *(f"lo_{n}" for n in objectives)).agg(F.max(under.cast("int")).alias("hit"))
    box = F.lit(1.0)
    for n, r in zip(objectives, reference):
        box = box * (F.lit(r) - F.first(f"lo_{n}"))
    return hit.groupBy(group).agg(F.sum("hit").alias("n_inside"), tidy(F.sum("hit") / samples * box, 3).alias("hypervolume"))


def top_k_stability(table: DataFrame, group: str, name: str, value: str, k: int = 5, draws: int = 40) -> DataFrame:
    """How often each item stays among the ``k`` highest, and first, when values carry noise of their standard error.

    A draw moves a value by under REACH times the noise, so an item further than twice that below its group's ``k``-th highest is in no
    draw's ``k``, and only the others are drawn.  No task orders over TASK_ROWS items or draws, and only the ``k`` highest of each draw and group leave it.
    """
    facts = table.groupBy(F.col(group).alias("group_")).agg((F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("spread"))
    facts = facts.select("group_", F.when(F.col("spread") > 1e-15, F.col("spread")).otherwise(1e-6).alias("noise"))
    items = table.select(group, name, value).repartition(max(1, -(-table.count() // TASK_ROWS)), group, name)
    order = Window.partitionBy(group).orderBy(F.desc(value), name)
    real = keep(items.withColumn("real", F.row_number().over(order)).where(F.col("real") <= k), "highest")
    last = real.where(F.col("real") == k).select(F.col(group).alias("group_"), F.col(value).cast("double").alias("last"))
    facts = facts.join(last, facts["group_"].eqNullSafe(last["group_"]), "left").select(facts["group_"], "noise", "last")
    # A little lower than what the reach leaves, for rounding.  Without a floor (fewer items, nulls, NaN) all are drawn.
    floor = F.col("last") - 2 * REACH * F.col("noise") - 1e-14 * F.abs("last")
    near = items.join(facts, F.col(group).eqNullSafe(F.col("group_"))).where(floor.isNull() | F.isnan(floor) | (F.col(value) >= floor))
    near = keep(near.select(group, name, value, "noise"), "near-highest")
    near = near.repartition(max(1, -(-near.count() * draws // TASK_ROWS)), group, name)
    drawn = near.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    gauss = F.sqrt(-2 * F.ln(unit(F.col(name), F.col("draw"), F.lit("a")))) * F.cos(2 * math.pi * unit(F.col(name), F.col("draw"), F.lit("b")))
    shaken = drawn.select(group, name, "draw", (F.col(value) + F.col("noise") * gauss).alias("shaken"))
    placed = shaken.withColumn("place", F.row_number().over(Window.partitionBy(group, "draw").orderBy(F.desc("shaken"), name))).where(F.col("place") <= k)
    counts = lambda rows, top, first, real: rows.select(F.col(group).alias("group_"), F.col(name).alias("name_"), top.alias("top"), first.alias("first"), F.lit(real).alias("real"))
    every = counts(real, F.lit(0), F.lit(0), 1).unionAll(counts(placed, F.lit(1), (F.col("place") == 1).cast("int"), 0))
    found = every.groupBy("group_", "name_").agg(F.sum("top").alias("n_top"), F.sum("first").alias("n_first"), (F.max("real") > 0).alias("in_top"))
    own = items.select(group, name).distinct().join(found, F.col(group).eqNullSafe(F.col("group_")) & F.col(name).eqNullSafe(F.col("name_")), "left")
    share = lambda n: tidy(F.coalesce(F.col(n), F.lit(0)) / draws)
    return own.select(group, name, F.coalesce("in_top", F.lit(False)).alias("in_top"), share("n_top").alias("frequency"), share("n_first").alias("first_frequency"))


def correlation_interval(table: DataFrame, group: str, key: str, x: str, y: str, draws: int = 40) -> DataFrame:
    """Correlation of two columns of each group with the 95 % interval of its resamples.

    Rows are placed once and written; picks, ``draws`` for each row, meet them by place, dealt over all tasks.
    """
    line = Window.partitionBy(group)
    rows = keep(table.select(group, x, y, (F.row_number().over(line.orderBy(key)) - 1).alias("at"), F.count("*").over(line).alias("n")), "resampled")
    drawn = rows.select(group, "n", "at", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picked = drawn.select(group, "draw", F.floor(unit(F.col(group), F.col("draw"), F.col("at")) * F.col("n")).cast("int").alias("at"))
    # The planner takes picks for as few as rows, and would send all of them through the driver to every task.
    each = picked.hint("merge").join(rows.drop("n"), [group, "at"]).groupBy(group, "draw").agg(safe_corr(F.col(x), F.col(y)).alias("r"))
    spans = each.groupBy(group).agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"), F.stddev_samp("r").alias("se"))
    real = rows.groupBy(group).agg(safe_corr(F.col(x), F.col(y)).alias("r"))
    return real.join(spans, group).select(group, tidy(F.col("r"), 5).alias("r"), tidy(F.col("low"), 5).alias("low"), tidy(F.col("high"), 5).alias("high"), tidy(F.col("se"), 5).alias("std_error"))


def effect_sizes(table: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Paired samples: how many pairs, the mean difference, and the difference in deviations of the differences."""
    gap = F.col(a) - F.col(b)
    out = table.groupBy(group).agg(F.count(gap).alias("n"), F.avg(gap).alias("m"), F.stddev_samp(gap).alias("s"))
    return out.select(group, "n", tidy(F.col("m"), 4).alias("mean_difference"), tidy(F.when(F.col("s") > 0, F.abs("m") / F.col("s")).otherwise(0.0), 5).alias("effect_size"))


def rank_strategies(table: DataFrame, group: str, player: str, value: str, maximize: bool = False) -> DataFrame:
    """Strategies of each group by their median, best first."""
    mid = table.groupBy(group, player).agg(tidy(F.percentile(value, F.lit(0.5)), 4).alias("median"))
    return mid.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("median") if maximize else F.asc("median"), player)).cast("int"))


def convergence(obs: DataFrame, optimum: DataFrame, share: float = 0.01) -> DataFrame:
    """Minimised campaigns: mean gap of the best so far to the optimum against the first gap, and where it is first within ``share`` of it."""
    line = Window.partitionBy("campaign_id").orderBy("iteration")
    rows = obs.join(optimum, "campaign_id").withColumn("gap", F.min("kpi").over(line) - F.col("optimum"))
    rows = rows.withColumn("first_gap", F.first("gap").over(line))
    out = rows.groupBy("campaign_id").agg(F.avg("gap").alias("g"), F.first("first_gap").alias("f"), F.min(F.when(F.col("gap") <= share * F.col("first_gap"), F.col("iteration"))).alias("at"))
    auc = F.when(F.col("f") <= 1e-10, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("g") / F.col("f"))))
    return out.select("campaign_id", tidy(auc, 5).alias("auc"), F.when(F.col("f") <= 1e-10, 0).otherwise(F.col("at")).cast("long").alias("converged_at"))


def cost_by_level(trials: DataFrame, level: str, cost: str, value: str) -> DataFrame:
    """Trials, cost and the best and mean result of every fidelity level."""
    return trials.groupBy(level).agg(F.count("*").alias("n_trials"), tidy(F.sum(cost), 2).alias("total_cost"), tidy(F.max(value), 2).alias("best"), tidy(F.avg(value), 4).alias("mean"))


def cost_adjusted_regret(obs: DataFrame, cost: str) -> DataFrame:
    """The distance of the best so far from the campaign's best, by what had been spent until then."""
    line = Window.partitionBy("campaign_id").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.max("kpi").over(Window.partitionBy("campaign_id")) - F.max("kpi").over(line)
    return obs.select("campaign_id", "iteration", tidy(gap / F.greatest(F.sum(cost).over(line), F.lit(1e-8)), 5).alias("regret"))


def linear_uncertainty(table: DataFrame, key: str, parts: dict[str, tuple[float, float]]) -> DataFrame:
    """A weighted sum of measurements with the variance that independent errors give it; parts: column -> (weight, relative error)."""
    value = sum((w * F.col(n) for n, (w, _) in parts.items()), F.lit(0.0))
    shares = {n: (w * e * F.col(n)) ** 2 for n, (w, e) in parts.items()}
    total = sum(shares.values(), F.lit(0.0))
    main = F.array_max(F.array(*(F.struct(v.alias("v"), F.lit(n).alias("n")) for n, v in shares.items())))
    return table.select(key, tidy(value, 3).alias("value"), tidy(F.sqrt(total), 4).alias("deviation"), main["n"].alias("dominant"), tidy(F.when(total > 0, main["v"] / total).otherwise(0.0), 5).alias("dominant_share"))


def range_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Mean overlap of the ranges (name, lower, upper) that two specifications share, by key."""
    both = a.alias("a").join(b.alias("b"), [key, "name"])
    inner = F.greatest(F.lit(0.0), F.least("a.upper", "b.upper") - F.greatest("a.lower", "b.lower"))
    outer = F.greatest(F.greatest("a.upper", "b.upper") - F.least("a.lower", "b.lower"), F.lit(1e-12))
    return both.groupBy(key).agg(F.count("*").alias("n_shared"), tidy(F.avg(inner / outer)).alias("overlap"))


def subgroup_effects(obs: DataFrame, treatment: str, by: str) -> DataFrame:
    """The treatment's effect (mean objective from its upper median on, less that below) in the halves that ``by`` parts a campaign into."""
    def halves(rows: DataFrame, group: list[str], name: str, out: str) -> DataFrame:
        line = Window.partitionBy(*group)
        ranked = rows.withColumn("at", F.row_number().over(line.orderBy(name, "iteration")) - 1).withColumn("n", F.count("*").over(line))
        middle = F.max(F.when(F.col("at") == F.floor(F.col("n") / 2), F.col(name))).over(line)
        return ranked.withColumn(out, F.col(name) >= middle).drop("at", "n")

    rows = halves(halves(obs, ["campaign_id"], by, "high"), ["campaign_id", "high"], treatment, "treated")
    part = lambda t: F.avg(F.when(F.col("treated") == t, F.col("kpi")))
    return rows.groupBy("campaign_id", "high").agg(F.count("*").alias("n_obs"), tidy(F.coalesce(part(True) - part(False), F.lit(0.0)), 3).alias("effect"))


def levels(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Topological levels of a directed graph without cycles: 0 without parents, else one more than the highest parent.

    Each level takes away the edges of the vertices that no edge enters any more; what is left is written once per level.  Vertices on
    a cycle, and those behind it, have no level.
    """
    left = keep(edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).where("p IS NOT NULL AND c IS NOT NULL").distinct(), "levels")
    found, level = left.select(F.col("p").alias("node"), F.lit(0).alias("level")).limit(0), 0
    while True:
        ready = keep(left.select("p").join(left.select(F.col("c").alias("p")), "p", "left_anti").distinct(), "levels")
        if ready.isEmpty():
            return found
        gone = left.join(ready, "p", "left_semi").select("c").distinct()
        left = keep(left.join(ready, "p", "left_anti"), "levels")
        # Vertices without edges of their own are done with their last parent.
        ends = gone.join(left.select("c"), "c", "left_anti").join(edges.select(F.col(parent).alias("c")).distinct(), "c", "left_anti")
        found = found.union(ready.select("p", F.lit(level))).union(keep(ends, "levels").select("c", F.lit(level + 1)))
        level += 1


def strengths(votes: DataFrame, rounds: int = 100, epsilon: float = 1e-6, prior: float = 1.0) -> DataFrame:
    """item, score, wins, n_votes: Bradley-Terry strengths from ``votes`` (winner, loser, confidence), the greatest being 1.

    Minorise-maximise rounds: an item's new strength is its won confidence over the sum of the confidence shared with each opponent by the
    sum of both strengths.  Every round is two joins on items over the pairs that met, which are added up once before, and ends when no strength moves
    by ``epsilon``; rounds are written in the shared folder.  An item that never won has strength 0.  Votes of an item on itself, with a null
    side, or without a confidence above 0 do not count; without votes there are no rows.
    """
    sound = votes.where("winner IS NOT NULL AND loser IS NOT NULL AND winner != loser AND confidence > 0").groupBy("winner", "loser").agg(F.sum("confidence").alias("w"), F.count("*").alias("n"))
    sound = keep(sound, "votes")
    both = sound.select(F.col("winner").alias("item"), F.col("loser").alias("other"), "w").unionByName(sound.select(F.col("loser").alias("item"), F.col("winner").alias("other"), "w"))
    pairs = keep(both.groupBy("item", "other").agg(F.sum("w").alias("w")), "vote-pairs")
    won = sound.select(F.col("winner").alias("item"), F.col("w").alias("win"), "n").unionByName(sound.select(F.col("loser").alias("item"), F.lit(0).cast(sound.schema["w"].dataType).alias("win"), "n"))
    scores = keep(won.groupBy("item").agg(F.sum("win").cast("double").alias("wins"), F.sum("n").alias("n_votes")).withColumn("score", F.lit(float(prior))), "strengths")
    for _ in range(rounds):
        met = pairs.join(scores.select("item", "score"), "item").join(scores.select(F.col("item").alias("other"), F.col("score").alias("its")), "other")
        shared = met.groupBy("item").agg(F.sum(F.try_divide(F.col("w").cast("double"), F.col("score") + F.col("its"))).alias("shared"))
        raw = scores.join(shared, "item").select("item", "wins", "n_votes", F.col("score").alias("before"), F.coalesce(F.try_divide("wins", "shared"), F.col("score")).alias("score"))
        raw = keep(raw, "strengths")
        most = raw.agg(F.max("score")).first()[0]
        if not most:
            break
        scores = raw.withColumn("score", F.col("score") / most)
        moved = scores.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0]
        if moved < epsilon:
            break
    return scores.select("item", "score", "wins", "n_votes")
