"""Causal graphs: separation, adjustment and structure, as joins over frontiers.

A graph is a table of (parent, child) links.  Questions are rows; every round moves all of them one step at once, keeps what is new
and ends when nothing is.  A round's rows are written in the shared folder, so plans do not grow with the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_corr, tidy
from ..sources.tables import keep
from .graph import ancestors, closure


def reached(links: DataFrame, asked: DataFrame, cut: str | None = None) -> DataFrame:
    """(key, node): what the ball of each row of ``asked`` (key, x, z) reaches from x, given the nodes of the array z.

    A state is a node and the way it was entered.  Entered from a child, a node outside z passes the ball on to its parents and
    children; entered from a parent, a node outside z passes it on to its children, and one that is in z or leads to a node of z
    back to its parents.  ``cut``: "into" leaves out the links into x for its own row, "from" those out of it.
    """
    links = keep(links.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct(), "ball-links")
    asked = keep(asked.select("key", "x", "z").distinct(), "ball-asked")
    given = keep(asked.select("key", F.explode("z").alias("node")).distinct(), "ball-given")
    leading = ancestors(links, given).select("key", "node").unionByName(given).distinct().withColumn("leads", F.lit(True))
    leading = keep(leading, "ball-leading")
    # Every move: from a node, upwards to a parent or downwards to a child.
    moves = links.select(F.col("child").alias("node"), F.col("parent").alias("next"), F.lit(True).alias("up"))
    moves = keep(moves.unionByName(links.select(F.col("parent").alias("node"), F.col("child").alias("next"), F.lit(False).alias("up"))), "ball-moves")

    def step(ball: DataFrame) -> DataFrame:
        met = ball.join(moves, "node")
        into, out = F.when(F.col("up"), F.col("node")).otherwise(F.col("next")), F.when(F.col("up"), F.col("next")).otherwise(F.col("node"))
        if cut == "into":
            met = met.where(into != F.col("x"))
        if cut == "from":
            met = met.where(out != F.col("x"))
        return met

    start = step(asked.select("key", "x", F.col("x").alias("node"))).select("key", "x", F.col("next").alias("node"), F.col("up").alias("entered_up")).distinct()
    frontier = seen = keep(start, "ball-frontier")
    held = given.withColumn("in_z", F.lit(True))
    while True:
        state = frontier.join(held, ["key", "node"], "left").join(leading, ["key", "node"], "left")
        free, leads = F.col("in_z").isNull(), F.col("leads").isNotNull()
        passes = F.when(F.col("entered_up"), free).otherwise(F.when(F.col("up"), leads).otherwise(free))
        met = step(state).where(passes).select("key", "x", F.col("next").alias("node"), F.col("up").alias("entered_up")).distinct()
        frontier = keep(met.join(seen, ["key", "x", "node", "entered_up"], "left_anti"), "ball-frontier")
        if frontier.isEmpty():
            return seen.select("key", "node").distinct()
        seen = seen.unionByName(frontier)


def separated(links: DataFrame, asked: DataFrame, cut: str | None = None) -> DataFrame:
    """``asked`` (x, y, z) with ``separated``: whether z blocks every path between x and y.  Rows of one x and z share their walk."""
    key = F.to_json(F.struct("x", F.sort_array("z").alias("z")))
    keyed = keep(asked.select("x", "y", F.sort_array("z").alias("z")).distinct().withColumn("key", key), "separated-asked")
    found = reached(links, keyed, cut).select("key", F.col("node").alias("y"), F.lit(True).alias("open"))
    return keyed.join(found, ["key", "y"], "left").select("x", "y", "z", F.col("open").isNull().alias("separated"))


def adjustment_sets(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (x, y) of ``pairs`` a set to adjust for when x acts on y.

    Tried in turn: the parents of x, its ancestors, each without y and without descendants of x; the first that is not empty and
    separates x from y once the links into x are gone is taken; else all nodes but x, y and the descendants of x.  ``taken``
    names the step; ``blocks_backdoor`` says whether the set separates x from y once the links out of x are gone.
    """
    pairs = keep(pairs.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL AND x != y").distinct(), "adjust-pairs")
    links = keep(links.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct(), "adjust-links")
    starts = pairs.select(F.col("x").alias("key"), F.col("x").alias("node")).distinct()
    below = keep(closure(links, starts).select(F.col("key").alias("x"), F.col("node").alias("other")), "adjust-below")
    above = ancestors(links, starts).select(F.col("key").alias("x"), F.col("node").alias("other"))
    nodes = links.select(F.inline(F.array(F.struct(F.col("parent").alias("other")), F.struct(F.col("child").alias("other"))))).distinct()
    # The candidates by step: nodes times the x asked about, of which each has one row.
    near = links.select(F.col("child").alias("x"), F.col("parent").alias("other"))
    steps = near.withColumn("step", F.lit(1)).unionByName(above.withColumn("step", F.lit(2)))
    steps = steps.unionByName(starts.select(F.col("key").alias("x")).join(nodes, F.col("x") != F.col("other")).select("x", "other").withColumn("step", F.lit(3)))
    allowed = keep(steps.distinct().join(below, ["x", "other"], "left_anti"), "adjust-allowed")
    own = pairs.join(allowed, "x").where("other != y AND other != x").groupBy("x", "y", "step").agg(F.sort_array(F.collect_set("other")).alias("z"))
    own = keep(own, "adjust-sets")
    checked = separated(links, own.where("step < 3"), "into").where("separated").select("x", "y", "z")
    good = own.where("step < 3").join(checked, ["x", "y", "z"], "left_semi").unionByName(own.where("step = 3"))
    first = good.groupBy("x", "y").agg(F.min(F.struct("step", "z")).alias("best"))
    empty = F.array().cast("array<string>") if dict(nodes.dtypes)["other"] == "string" else F.array().cast(f"array<{dict(nodes.dtypes)['other']}>")
    chosen = pairs.join(first, ["x", "y"], "left").select("x", "y", F.coalesce("best.z", empty).alias("z"), F.coalesce("best.step", F.lit(4)).alias("step"))
    chosen = keep(chosen, "adjust-chosen")
    backdoor = separated(links, chosen, "from")
    name = F.element_at(F.array(*map(F.lit, ("parents", "ancestors", "candidates", "none"))), F.col("step"))
    return chosen.join(backdoor, ["x", "y", "z"]).select("x", "y", "z", name.alias("taken"), F.col("separated").alias("blocks_backdoor"))


# ---------------------------------------------------------------- structure


def correlations(table: DataFrame, group: str, names: list[str]) -> DataFrame:
    """group, n and r, the correlations of every two of ``names`` in the order of their pairs: one aggregation over the rows that hold all variables."""
    rows = table.select(group, *names).dropna(subset=names)
    pairs = combinations(names, 2)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.array(*(safe_corr(F.col(a), F.col(b)) for a, b in pairs), F.lit(0.0)).alias("r"))


def _independent(r: np.ndarray, n: np.ndarray, given: int, level: float) -> np.ndarray:
    """Whether Fisher's z of a partial correlation stays within what ``level`` allows."""
    held = np.where(np.isnan(r), 0.9999, np.clip(r, -0.9999, 0.9999))
    z = np.abs(0.5 * np.log((1 + held) / (1 - held))) * np.sqrt(np.maximum(n - given - 3, 0))
    return z < NormalDist().inv_cdf(1 - level / 2)


def _given_one_more(ab: np.ndarray, ac: np.ndarray, bc: np.ndarray) -> np.ndarray:
    """r(ab|sc) = (r(ab|s) - r(ac|s) r(bc|s)) / sqrt((1 - r(ac|s)^2) (1 - r(bc|s)^2))."""
    base = (1 - ac * ac) * (1 - bc * bc)
    return np.where(base <= 1e-12, 0.0, (ab - ac * bc) / np.sqrt(np.where(base <= 1e-12, 1.0, base)))


def _patterns(r: np.ndarray, n: np.ndarray, known: np.ndarray, size: int, level: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links and arrows (group, a, b) of many groups at once; a group that is not ``known`` keeps all links."""
    pairs = list(combinations(range(size), 2))
    links = np.broadcast_to(~np.eye(size, dtype=bool), (len(n), size, size)).copy()
    parted, sets = np.zeros_like(links), np.zeros((len(n), size, size, size), dtype=bool)
    partial = {((), ab): r[:, i] for i, ab in enumerate(pairs)}
    for given in range(most + 1):
        near, last = links.copy(), partial
        partial, second = (last if not given else {}), []
        done = np.zeros_like(links)
        for s in combinations(range(size), given):
            for a, b in pairs:
                if a in s or b in s:
                    continue
                if given:
                    at = lambda x, y: last[s[:-1], (min(x, y), max(x, y))]
                    partial[s, (a, b)] = _given_one_more(at(a, b), at(a, s[-1]), at(b, s[-1]))
                free = near[:, a, b] & known & _independent(partial[s, (a, b)], n, given, level)
                of_a, of_b = near[:, a][:, list(s)].all(axis=1), near[:, b][:, list(s)].all(axis=1)
                # The first set of a's neighbours parts them, or else the first of b's.
                now = free & of_a & ~done[:, a, b]
                done[:, a, b] |= now
                sets[now, a, b] = sets[now, b, a] = np.isin(range(size), s)
                second.append((a, b, s, free & of_b & ~of_a))
        for a, b, s, found in second:
            now = found & ~done[:, a, b]
            done[:, a, b] |= now
            sets[now, a, b] = sets[now, b, a] = np.isin(range(size), s)
        done |= done.transpose(0, 2, 1)
        parted |= done
        links &= ~done
    arrows = np.zeros_like(links)
    triples = [(a, b, c) for a, b in pairs for c in range(size) if c != a and c != b]
    # c between a and b.
    for a, b, c in triples:
        apart = links[:, a, c] & links[:, c, b] & parted[:, a, b] & ~sets[:, a, b, c]
        arrows[:, a, c] |= apart
        arrows[:, b, c] |= apart
    while True:
        free = links & ~arrows & ~arrows.transpose(0, 2, 1)
        new = np.zeros_like(links)
        for a in range(size):
            for b in range(size):
                others = [k for k in range(size) if k not in (a, b)] if a != b else []
                for k in others:
                    # An arrow k -> a, a - b, k and b not linked; a -> k -> b beside a - b.
                    new[:, a, b] |= arrows[:, k, a] & ~links[:, k, b] | arrows[:, a, k] & arrows[:, k, b]
                for k, l in combinations(others, 2):
                    # a - k -> b and a - l -> b beside a - b, k and l not linked.
                    new[:, a, b] |= free[:, a, k] & arrows[:, k, b] & free[:, a, l] & arrows[:, l, b] & ~links[:, k, l]
        new &= free
        new &= ~(new.transpose(0, 2, 1) & np.tril(np.ones((size, size), dtype=bool)))
        if not new.any():
            return links, arrows
        arrows |= new


def cpdag(table: DataFrame, group: str, names: list[str], level: float = 0.05, most: int = 3) -> DataFrame:
    """The pattern of causal links among ``names`` in each group: source, target, directed.

    Links go as in the PC algorithm, level by level: a link goes if its ends are independent given some set of ``level`` many
    neighbours of either end; neighbours are those at the beginning of the level, so the order of variables does not matter.
    Ends of unshielded triples are pointed at the middle unless it parted them, then Meek's rules are applied until nothing changes;
    a link that two rules point both ways in one round keeps the way from the earlier variable.  Links that stay without direction
    are given from the earlier to the later variable, not directed.  The data is aggregated once; a group is then one row of
    correlations, and tasks search the patterns of many rows at once without a shuffle.
    """
    size = len(names)
    # Correlations held at once: 2 ** 22, groups times pairs times sets.
    step = max(1, (1 << 22) // (size * size * max(comb(size, k) for k in range(most + 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                r = part.column("r").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                links, arrows = _patterns(r, part.column("n").to_numpy(), part.column(0).is_valid().to_numpy(zero_copy_only=False), size, level, most)
                free = np.triu(links & ~arrows & ~arrows.transpose(0, 2, 1))
                at, a, b = np.nonzero(arrows | free)
                named = [pa.array([names[i] for i in x], pa.string()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *named, pa.array(arrows[at, a, b])], names=[group, "source", "target", "directed"])

    kind = table.select(group).schema[0].dataType.simpleString()
    return keep(correlations(table, group, names).mapInArrow(search, f"`{group}` {kind}, source string, target string, directed boolean"), "patterns")


def pattern_scores(learned: DataFrame, true: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Per group how two patterns (source, target) differ: links to add, drop or turn, one each; and the share of links found, whatever their direction."""
    place = lambda c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    low, high = F.least(place("source"), place("target")).alias("a"), F.greatest(place("source"), place("target")).alias("b")
    sides = lambda t, name: t.groupBy(group, low, high).agg(F.sort_array(F.collect_set((place("source") < place("target")).cast("int"))).alias(name))
    both = sides(learned, "p").join(sides(true, "t"), [group, "a", "b"], "full_outer")
    hit = F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull())
    wrong = F.count_if(~F.col("p").eqNullSafe(F.col("t")))
    shares = (tidy(F.try_divide(hit, F.count("p"))).alias("precision"), tidy(F.try_divide(hit, F.count("t"))).alias("recall"))
    return both.groupBy(group).agg(wrong.alias("distance"), F.count("p").alias("n_learned"), F.count("t").alias("n_true"), hit.alias("n_hit"), *shares)
