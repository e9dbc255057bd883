"""Search spaces and what may be tried in them: surgery, physical limits, mediation, candidates, batches and queues."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import TINY, expected_improvement, probability_of_improvement, safe_corr, tidy, upper_confidence_bound
from ..model import Spec


def at_positions(table: DataFrame, by: list[str], x: str, **positions: Callable[[Column], Column]) -> DataFrame:
    """Each group's exact values at 0-based positions of its sorted values, and their number ``n``; nulls do not count.

    A position is a function of ``n``.  Equal values are counted before they are ordered, so repeats cost nothing.
    """
    counted = table.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("x_")).agg(F.count("*").alias("n_"))
    every = Window.partitionBy(*by)
    upto = every.orderBy("x_").rowsBetween(Window.unboundedPreceding, 0)
    sums = counted.select(*by, "x_", F.sum("n_").over(upto).alias("upto_"), F.sum("n_").over(every).alias("n_"))
    found = (F.min(F.when(F.col("upto_") > at(F.col("n_")), F.col("x_"))).alias(k) for k, at in positions.items())
    return sums.groupBy(*by).agg(F.max("n_").alias("n"), *found)


def tightened_ranges(obs: DataFrame, specs: tuple[Spec, ...], quantile: float = 0.05) -> DataFrame:
    """Parameters whose successes keep to under 80 % of their range, with the range to use: the inner quantiles and a tenth more."""
    each = F.array(*(F.struct(F.lit(s.name).alias("name"), F.lit(s.lower).alias("lo"), F.lit(s.upper).alias("hi"), F.col(s.name).cast("double").alias("x")) for s in specs))
    rows = obs.where("NOT is_failure").select("campaign_id", F.inline(each))
    ends = at_positions(rows, ["campaign_id", "name", "lo", "hi"], "x", low=lambda n: F.floor(quantile * (n - 1)), high=lambda n: F.ceil((1 - quantile) * (n - 1)))
    kept, full = F.col("high") - F.col("low"), F.col("hi") - F.col("lo")
    lower, upper = F.greatest(F.col("lo"), F.col("low") - kept * 0.1), F.least(F.col("hi"), F.col("high") + kept * 0.1)
    narrow = ends.where((F.col("n") >= 5) & (full > 0) & (kept < full * 0.8))
    return narrow.select("campaign_id", "name", tidy(lower).alias("lower"), tidy(upper).alias("upper"), tidy(F.least(F.lit(1.0), F.col("n") / 30)).alias("confidence"))


def redundant_parameters(obs: DataFrame, names: list[str], threshold: float = 0.9) -> DataFrame:
    """Parameters that follow an earlier one over a campaign's successes, with the mean to freeze them at.

    A parameter is merged into the first that it follows and that is not merged itself; under three joint values nothing is.
    """
    pairs = list(combinations(names, 2))
    both = lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    close = (F.when(both(a, b) >= 3, F.abs(safe_corr(F.col(a), F.col(b)))).alias(f"r_{a}_{b}") for a, b in pairs)
    facts = obs.where("NOT is_failure").groupBy("campaign_id").agg(*close, *(F.avg(n).alias(f"mean_{n}") for n in names))
    facts = facts.withColumn(f"into_{names[0]}", F.lit(None).cast("string"))
    for j, b in enumerate(names[1:], 1):
        follows = (F.when(F.col(f"into_{a}").isNull() & (F.col(f"r_{a}_{b}") >= threshold), F.struct(F.lit(a).alias("name"), F.col(f"r_{a}_{b}").alias("r"))) for a in names[:j])
        facts = facts.withColumn(f"by_{b}", F.coalesce(*follows)).withColumn(f"into_{b}", F.col(f"by_{b}.name"))
    each = F.array(*(F.struct(F.lit(b).alias("name"), F.col(f"into_{b}").alias("merge_into"), tidy(F.col(f"by_{b}.r"), 4).alias("correlation"), tidy(F.col(f"mean_{b}"), 4).alias("freeze_value")) for b in names[1:]))
    return facts.select("campaign_id", F.inline(each)).where("merge_into IS NOT NULL")


def out_of_range(values: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows (``name``, ``value``) beyond the physical bounds of their name, in any case of letters; unknown names pass.

    Beyond a bound by over a tenth of it is an error, as is any breach where the other side is unbounded; else a warning.
    """
    pick = lambda i: F.coalesce(*(F.when(F.lower("name") == k.lower(), F.lit(float(b[i]))) for k, b in bounds.items()))
    rows = values.withColumn("lower", pick(0)).withColumn("upper", pick(1)).where("value < lower OR value > upper")
    far = (F.col("value") < F.col("lower") - F.abs("lower") * 0.1) | (F.col("value") > F.col("upper") + F.abs("upper") * 0.1)
    open_ended = ((F.col("upper") == float("inf")) & (F.col("value") < F.col("lower"))) | ((F.col("lower") == float("-inf")) & (F.col("value") > F.col("upper")))
    return rows.withColumn("severity", F.when(far | open_ended, "error").otherwise("warning"))


def monotonicity_breaks(obs: DataFrame, variable: str, increasing: bool = True, within: tuple[float, float] | None = None) -> DataFrame:
    """Neighbouring trials of a campaign, of those with the variable in the range, that go against the stated direction."""
    rows = obs.where(F.col(variable).isNotNull() if within is None else F.col(variable).between(*within))
    order = Window.partitionBy("campaign_id").orderBy("iteration")
    steps = rows.select("campaign_id", F.lag("iteration").over(order).alias("from_iteration"), F.col("iteration").alias("to_iteration"), F.lag(variable).over(order).alias("from_value"), F.col(variable).alias("to_value"))
    return steps.where("to_value < from_value" if increasing else "to_value > from_value")


def physical_feasibility(obs: DataFrame, bounds: dict[str, tuple[float | None, float | None]], laws: dict[tuple[str, ...], tuple[float, float]]) -> DataFrame:
    """Trials with the bounds and the conservation laws they break.

    A law names variables, the sum they must have and its tolerance.  A missing variable breaks no bound, but it breaks its laws.
    """
    tests = []
    for name, (low, high) in bounds.items():
        if low is not None:
            tests.append(F.when(F.col(name) < low, F.lit(f"{name} < {low}")))
        if high is not None:
            tests.append(F.when(F.col(name) > high, F.lit(f"{name} > {high}")))
    for names, (target, tolerance) in laws.items():
        gap = F.abs(sum((F.col(n) for n in names), F.lit(0.0)) - target)
        tests.append(F.when(gap.isNull() | (gap > tolerance), F.lit(f"{' + '.join(names)} = {target}")))
    return obs.select("campaign_id", "iteration", F.array_compact(F.array(*tests)).alias("violations")).withColumn("feasible", F.size("violations") == 0)


def _middle(n: Column) -> Column:
    return F.floor(n / 2)


def mediation(obs: DataFrame, treatment: str, mediator: str, outcome: str) -> DataFrame:
    """Total effect of a high treatment (at or above its middle value) by campaign, parted into direct and mediated.

    The mediated part is the treatment's effect on the mediator times the mediator's slope within both halves, weighted by
    their rows; halves of under three rows or with a constant mediator have none.  Under four rows, or one half empty: all zero.
    """
    rows = obs.select("campaign_id", F.col(treatment).alias("t"), F.col(mediator).alias("m"), F.col(outcome).alias("y")).dropna(subset=["t", "m", "y"])
    cut = at_positions(rows, ["campaign_id"], "t", cut=_middle)
    half = rows.join(cut, "campaign_id").groupBy("campaign_id", "n", (F.col("t") >= F.col("cut")).alias("high"))
    half = half.agg(F.count("*").alias("k"), F.avg("m").alias("m"), F.avg("y").alias("y"), F.covar_pop("m", "y").alias("c"), F.var_pop("m").alias("v"))
    usable = (F.col("k") >= 3) & (F.col("v") > TINY)
    gap = lambda x: F.max(F.when(F.col("high"), F.col(x))) - F.max(F.when(~F.col("high"), F.col(x)))
    slope = F.coalesce(F.sum(F.when(usable, F.col("c") / F.col("v") * F.col("k"))) / F.sum(F.when(usable, F.col("k"))), F.lit(0.0))
    parts = half.groupBy("campaign_id", "n").agg(gap("y").alias("total"), (gap("m") * slope).alias("indirect"))
    zero = lambda x: F.when(F.col("n") >= 4, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    return parts.select("campaign_id", tidy(zero(F.col("total")), 4).alias("total"), tidy(zero(F.col("indirect")), 4).alias("indirect"), tidy(zero(F.col("total") - F.col("indirect")), 4).alias("direct"))


def frontdoor_effect(obs: DataFrame, treatment: str, mediator: str, outcome: str) -> DataFrame:
    """Effect of a high treatment through a mediator, adjusted at the front door: both parted at their middle values.

    Rows lacking one of the three take no part; an empty half or cell adds nothing.
    """
    rows = obs.select("campaign_id", F.col(treatment).alias("t"), F.col(mediator).alias("m"), F.col(outcome).alias("y")).dropna(subset=["t", "m", "y"])
    each = F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("x")) for k in "tm"))
    cuts = at_positions(rows.select("campaign_id", F.inline(each)), ["campaign_id", "name"], "x", cut=_middle)
    cuts = cuts.groupBy("campaign_id").agg(*(F.max(F.when(F.col("name") == k, F.col("cut"))).alias(f"cut_{k}") for k in "tm"))
    at = rows.join(cuts, "campaign_id").withColumn("th", F.col("t") >= F.col("cut_t")).withColumn("mh", F.col("m") >= F.col("cut_m"))
    cells = at.groupBy("campaign_id", "th", "mh").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    n = lambda test: F.coalesce(F.sum(F.when(F.expr(test), F.col("n"))), F.lit(0))
    facts = cells.groupBy("campaign_id").agg(
        n("th").alias("n1"), n("NOT th").alias("n0"), n("th AND mh").alias("n11"), n("NOT th AND mh").alias("n01"),
        *(F.coalesce(F.max(F.when(F.expr(f"{'' if t else 'NOT '}th AND {'' if m else 'NOT '}mh"), F.col("y"))), F.lit(0.0)).alias(f"y{t}{m}") for t in (0, 1) for m in (0, 1)),
    )
    total = F.col("n1") + F.col("n0")
    given = lambda m: (F.col(f"y1{m}") * F.col("n1") + F.col(f"y0{m}") * F.col("n0")) / total

    def expected(t: int) -> Column:
        share = F.col(f"n{t}1") / F.col(f"n{t}")
        return F.when(F.col(f"n{t}") > 0, share * given(1) + (1 - share) * given(0)).otherwise(0.0)

    return facts.select("campaign_id", tidy(expected(1) - expected(0), 4).alias("effect"))


def joint_variance(obs: DataFrame, names: list[str]) -> DataFrame:
    """The share of the objective's variance over successes that parting two parameters at the median of their distinct values explains."""
    rows = obs.where("NOT is_failure AND kpi IS NOT NULL").dropna(subset=names)
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names))
    distinct = rows.select("campaign_id", F.inline(each)).distinct()
    middle = at_positions(distinct, ["campaign_id", "name"], "x", below=lambda n: F.floor(n / 2) - 1, above=_middle).where("n >= 2")
    cuts = middle.groupBy("campaign_id").agg(*(F.max(F.when(F.col("name") == n, (F.col("below") + F.col("above")) / 2)).alias(f"cut_{n}") for n in names))
    sides = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) <= F.col(f"cut_{a}")).alias("la"), (F.col(b) <= F.col(f"cut_{b}")).alias("lb")) for a, b in combinations(names, 2)]
    cells = rows.join(cuts, "campaign_id", "left").select("campaign_id", "kpi", F.inline(F.array(*sides))).groupBy("campaign_id", "a", "b", "la", "lb")
    cells = cells.agg(F.count("*").alias("n"), F.avg("kpi").alias("m"), F.var_pop("kpi").alias("v"))
    n = F.sum("n")
    within = F.sum(F.col("n") * F.col("v")) / n
    total = within + F.sum(F.col("n") * F.col("m") * F.col("m")) / n - (F.sum(F.col("n") * F.col("m")) / n) ** 2
    known = F.bool_and(F.col("la").isNotNull() & F.col("lb").isNotNull())
    explained = F.when(known & (total > TINY), F.greatest(1 - within / total, F.lit(0.0))).otherwise(0.0)
    return cells.groupBy("campaign_id", "a", "b").agg(tidy(explained).alias("explained"))


def batch_size(phase: Column, n_params: int, noise: Column, failure_rate: Column, least: int = 1, most: int = 20) -> Column:
    """Trials to run next: by phase, more under noise and under failures, within the limits."""
    base = F.when(phase == "cold_start", max(2, 2 * n_params)).when(phase == "exploitation", 1).when(phase == "stagnation", max(3, n_params))
    base = base.when(phase == "learning", max(2, min(5, n_params))).otherwise(max(1, n_params))
    noisy = F.when(noise > 0.5, 2).when(noise > 0.3, 1).otherwise(0)
    failing = F.when(failure_rate > 0.3, F.greatest(F.lit(1), F.floor(base * failure_rate).cast("int"))).otherwise(0)
    return F.greatest(F.lit(least), F.least(F.lit(most), base + noisy + failing))


def noise_regime(noise: Column, signal_to_noise: Column) -> Column:
    return F.when((noise > 0.5) | (signal_to_noise < 2), "high").when((noise > 0.2) | (signal_to_noise < 5), "medium").otherwise("low")


def rank_candidates(table: DataFrame, group: str, key: str, mean: str, std: str, best: str | None = None, strategy: str = "ucb", maximize: bool = False, kappa: float = 2.0) -> DataFrame:
    """A group's candidates by an acquisition score of their predictions, ties by key; without a best value ei and pi are 0."""
    mu = -F.col(mean) if maximize else F.col(mean)
    if strategy == "ucb":
        score = upper_confidence_bound(mu, F.col(std), kappa)
    elif strategy in ("ei", "pi"):
        gain = expected_improvement if strategy == "ei" else probability_of_improvement
        score = F.lit(0.0) if best is None else F.coalesce(gain(mu, F.col(std), -F.col(best) if maximize else F.col(best)), F.lit(0.0))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    rows = table.select(group, key, mean, std, tidy(score).alias("score"))
    order = Window.partitionBy(group).orderBy(F.col("score") if strategy == "ucb" else F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))


def ready_trials(queue: DataFrame, completed: DataFrame, resources: DataFrame, n: int) -> DataFrame:
    """The first ``n`` queued trials whose dependencies are all completed and whose needs one free resource meets.

    ``queue``: key, place, deps, needs (arrays); ``completed``: key; ``resources``: resource_id, capabilities, available.  A
    dependency that nothing is known of is not completed.  Needs are matched once for each distinct set of them.
    """
    rows = queue.withColumn("needs", F.array_sort(F.array_distinct(F.coalesce("needs", F.array().cast("array<string>")))))
    open_deps = rows.select("key", F.explode("deps").alias("dep")).join(completed.select(F.col("key").alias("dep")), "dep", "left_anti").select("key").distinct()
    wanted = rows.select("needs").distinct().withColumn("capability", F.explode("needs"))
    offered = resources.where("available").select("resource_id", F.explode(F.array_distinct("capabilities")).alias("capability"))
    met = wanted.join(offered, "capability").groupBy("needs", "resource_id").agg(F.count("*").alias("k")).where("k = size(needs)").select("needs").distinct()
    free = rows.join(open_deps, "key", "left_anti").join(met.withColumn("met", F.lit(True)), "needs", "left")
    return free.where("size(needs) = 0 OR met").orderBy("place", "key").limit(n).select("key", "place")


def constraint_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """How failure thresholds (of ``failure_thresholds``) moved: new, removed, tightened, relaxed or unchanged.

    Tightened is a failure rate above the threshold that rose by over 0.05, relaxed one that fell by as much.
    """
    take = lambda t, w: t.select("campaign_id", "name", F.col("threshold").alias(f"{w}_threshold"), F.col("rate_above").alias(f"{w}_rate"), F.lit(True).alias(f"in_{w}"))
    both = take(old, "old").join(take(new, "new"), ["campaign_id", "name"], "full")
    way = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed")
    known = F.col("old_threshold").isNotNull() & F.col("new_threshold").isNotNull()
    way = way.when(known & (F.col("new_rate") > F.col("old_rate") + 0.05), "tightened").when(known & (F.col("new_rate") < F.col("old_rate") - 0.05), "relaxed").otherwise("unchanged")
    rate = lambda w: F.coalesce(F.col(f"{w}_rate"), F.lit(0.0)).alias(f"{w}_rate")
    return both.select("campaign_id", "name", "old_threshold", "new_threshold", rate("old"), rate("new"), way.alias("direction"))
