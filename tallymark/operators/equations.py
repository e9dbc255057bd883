"""Expression trees: as Spark columns, as text, and the search for a short equation that explains an objective.

A tree is a tuple: ("const", value), ("var", column), (operation, tree) or (operation, tree, tree).  Where an operation has no finite
value (a logarithm of 0, a division by nearly 0, an overflow, a null or non-finite variable) neither has any tree above it.

The search goes level by level.  All trees of one operation on leaves come first; at each further level the best trees so far are joined by
every operation to every tree of the first level.  Each tree is scaled: its error is that of the best ``offset + scale * tree``, which needs
only sums, so one pass over the rows scores a whole level.  Tasks send one row of sums per tree; trees and their sums, whose number
depends on the search alone, are all that the driver holds.  A level has under ``8 * beam`` times the trees of the first.
Trees that join two others by one of + - * / are not made row by row: the sums of all of them are products of matrices of the others' values,
their squares and reciprocals.  Only where such a sum would lose digits or a value may be too large are the tree's own values taken.
A law none of whose smaller parts lowers the error by itself can be missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tree = tuple

UNARY = ("exp", "log", "sqrt", "abs", "neg")
BINARY = ("+", "-", "*", "/")
# The greatest exponent, the least divisor.
HIGHEST, LEAST = 500.0, 1e-12


def complexity(tree: Tree) -> int:
    """The number of nodes."""
    return 1 if tree[0] in ("const", "var") else 1 + sum(map(complexity, tree[1:]))


def text(tree: Tree) -> str:
    """The tree with infix operators; a whole constant without a point, another with four digits."""
    op = tree[0]
    if op == "const":
        return str(int(tree[1])) if tree[1] == int(tree[1]) and abs(tree[1]) < 1e6 else f"{tree[1]:.4g}"
    if op == "var":
        return tree[1]
    return f"({text(tree[1])} {op} {text(tree[2])})" if op in BINARY else f"{op}({text(tree[1])})"


def _finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def column(tree: Tree) -> Column:
    """The tree over a DataFrame's columns; null where it has no finite value."""
    op = tree[0]
    if op == "const":
        return F.lit(float(tree[1]))
    if op == "var":
        return _finite(F.col(tree[1]).cast("double"))
    a = column(tree[1])
    if op in UNARY:
        return {
            "exp": lambda: F.when(a <= HIGHEST, F.exp(a)),
            "log": lambda: F.when(a > 0, F.log(a)),
            "sqrt": lambda: F.when(a >= 0, F.sqrt(a)),
            "abs": lambda: F.abs(a),
            "neg": lambda: -a,
        }[op]()
    b = column(tree[2])
    return _finite({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(F.abs(b) >= LEAST, F.try_divide(a, b))}[op]())


def value(tree: Tree) -> Column:
    """The tree's value, infinity where it has none."""
    return F.coalesce(column(tree), F.lit(float("inf")))


def values(tree: Tree, data: dict[str, np.ndarray], known: dict[Tree, np.ndarray]) -> np.ndarray:
    """The tree over a batch of rows; NaN where it has no finite value.  ``known`` holds values of trees that come up again."""
    if tree in known:
        return known[tree]
    op = tree[0]
    if op == "const":
        return np.array([float(tree[1])])
    if op == "var":
        x = data[tree[1]]
        return np.where(np.isfinite(x), x, np.nan)
    a = values(tree[1], data, known)
    if op == "exp":
        out = np.exp(np.where(a <= HIGHEST, a, np.nan))
    elif op == "log":
        out = np.log(np.where(a > 0, a, np.nan))
    elif op == "sqrt":
        out = np.sqrt(np.where(a >= 0, a, np.nan))
    elif op in ("abs", "neg"):
        out = np.abs(a) if op == "abs" else -a
    else:
        b = values(tree[2], data, known)
        out = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / np.where(np.abs(b) >= LEAST, b, np.nan)
    return np.where(np.isfinite(out), out, np.nan)


class Joins:
    """Those of ``trees`` that join one of ``left`` with one of ``shared`` by one of + - * /, and the sums of all of them over some rows.

    Each is kept as its place among the trees, its kind (the operation, with the left one first or second) and the columns of both in matrices
    of the values of ``left`` and of ``shared``, which must be finite and hold ``left``.
    """

    KINDS = {"+": (0, 0), "-": (1, 2), "*": (3, 3), "/": (4, 5)}
    # A sum or difference whose squares are below this share of its parts' is summed by its own values.
    SHARE = 0.1

    def __init__(self, trees: list[Tree], left: list[Tree], shared: list[Tree]):
        column = {t: i for i, t in enumerate(shared)}
        own = {t: i for i, t in enumerate(left)}
        found = []
        for i, t in enumerate(trees):
            if t[0] in BINARY and (t[1] in own and t[2] in column or t[2] in own and t[1] in column):
                second = not (t[1] in own and t[2] in column)
                a, b = (t[2], t[1]) if second else (t[1], t[2])
                found.append((i, self.KINDS[t[0]][second], own[a], column[b]))
        self.place, self.kind, self.a, self.b = np.array(found, dtype=np.int64).reshape(-1, 4).T
        self.left = np.array([column[t] for t in left], dtype=np.int64)

    def sums(self, m: np.ndarray, y: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
        """t, tt and ty of each tree over the rows of ``m``, NaN where a divisor is nearly 0; and which must be taken by their own values instead."""
        size = np.abs(m)
        whole = (size >= LEAST).all(axis=0)
        inverse = np.where(whole, 1 / np.where(whole, m, 1), 0)
        high, high_inverse = size.max(axis=0), np.abs(inverse).max(axis=0)
        out, reach = np.empty((len(self.kind), 3)), np.empty(len(self.kind))
        some, some_inverse = m[:, self.left], inverse[:, self.left]
        inner = some.T @ m
        for kind, p, q, most in (
            (3, some, m, np.outer(high[self.left], high)),
            (4, some, inverse, np.outer(high[self.left], high_inverse)),
            (5, some_inverse, m, np.outer(high_inverse[self.left], high)),
        ):
            at = np.flatnonzero(self.kind == kind)
            a, b = self.a[at], self.b[at]
            for k, gram in enumerate((inner if kind == 3 else p.T @ q, (p * p).T @ (q * q), (p * y[:, None]).T @ q)):
                out[at, k] = gram[a, b]
            reach[at] = most[a, b]
            if kind > 3:
                out[at[~whole[b if kind == 4 else self.left[a]]]] = np.nan
        s, ss, sy = m.sum(axis=0), (m * m).sum(axis=0), y @ m
        at = np.flatnonzero(self.kind < 3)
        a, b, kind = self.left[self.a[at]], self.b[at], self.kind[at]
        sign, turn = np.where(kind == 0, 1.0, -1.0), np.where(kind == 2, -1.0, 1.0)
        out[at, 0] = turn * (s[a] + sign * s[b])
        out[at, 1] = ss[a] + ss[b] + 2 * sign * inner[self.a[at], b]
        out[at, 2] = turn * (sy[a] + sign * sy[b])
        reach[at] = high[a] + high[b]
        own = ~(reach <= largest * (1 - 1e-9))
        own[at] |= out[at, 1] < self.SHARE * (ss[a] + ss[b])
        return out, own


def _scores(rows: DataFrame, target: str, trees: list[Tree], shared: list[Tree], largest: float, left: list[Tree] = ()) -> list[tuple[float, float, float]]:
    """Mean squared error, offset and scale of every tree in one pass; infinite where a row has no value of ``largest`` at most.

    ``left``: some of ``shared``, whose joins are many; all of ``shared`` must then have values of ``largest`` at most.
    """
    names, shared = rows.columns, list(dict.fromkeys(shared))
    joins = Joins(trees, left, shared)
    others = np.setdiff1d(np.arange(len(trees)), joins.place)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trees), 6))
        with np.errstate(all="ignore"):
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    data = {n: part.column(n).to_numpy(zero_copy_only=False) for n in names}
                    y, known = data[target], {}
                    for tree in shared:
                        known[tree] = values(tree, data, known)
                    total[:, [0, 4, 5]] += len(y), y.sum(), y @ y
                    alone = others
                    if len(joins.place):
                        m = np.stack([np.broadcast_to(known[tree], y.shape) for tree in shared], axis=1)
                        sums, own = joins.sums(m, y, largest)
                        total[joins.place[~own], 1:4] += sums[~own]
                        alone = np.concatenate([others, joins.place[own]])
                    # A tree that this task has rejected stays so.
                    for i in alone[np.isfinite(total[alone, 1])].tolist():
                        t = np.broadcast_to(values(trees[i], data, known), y.shape)
                        total[i, 1:4] += t.sum() if (np.abs(t) <= largest).all() else np.nan, t @ t, t @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(len(trees)), pa.int32())] + [pa.array(c, pa.float64()) for c in total.T], names=["tree", "n", "t", "tt", "ty", "y", "yy"])

    sums = rows.mapInArrow(add, "tree int, n double, t double, tt double, ty double, y double, yy double")
    out = [(math.inf, 0.0, 0.0)] * len(trees)
    for r in sums.groupBy("tree").agg(*(F.sum(c).alias(c) for c in ("n", "t", "tt", "ty", "y", "yy"))).collect():
        if r.n and all(map(math.isfinite, r[1:])):
            spread, shared_spread = r.tt / r.n - (r.t / r.n) ** 2, r.ty / r.n - r.t / r.n * r.y / r.n
            scale = shared_spread / spread if spread > 1e-12 * r.tt / r.n else 0.0
            out[r.tree] = (max(0.0, r.yy / r.n - (r.y / r.n) ** 2 - scale * shared_spread), (r.y - scale * r.t) / r.n, scale)
    return out


def discover(rows: DataFrame, variables: list[str], target: str, levels: int = 3, beam: int = 10, largest: int = 11, gain: float = 0.01, operations: tuple[str, ...] = BINARY + UNARY) -> DataFrame:
    """The front of error and length: equation, complexity, offset, scale, mse of ``target = offset + scale * equation``.

    An equation is on the front if it lowers the error of all shorter ones by the share ``gain`` at least.  Trees of over ``largest`` nodes are not
    tried.  Rows with a null or non-finite target or variable are left out; trees without a value, or beyond 1e12, on any other row are
    rejected.  Of equal errors the shorter tree, then the lesser text, is taken.  Without rows the front is empty.
    """
    spark = rows.sparkSession
    wanted = dict.fromkeys([*variables, target])
    rows = rows.select(*(F.col(c).cast("double").alias(c) for c in wanted)).where(" AND ".join(f"abs(`{c}`) < double('infinity')" for c in wanted))
    leaves: list[Tree] = [("var", v) for v in variables] + [("const", 1.0)]
    unary, binary = [o for o in operations if o in UNARY], [o for o in operations if o in BINARY]

    def joined(some: list[Tree], others: list[Tree]) -> list[Tree]:
        out = {}
        for a in some:
            out |= {(o, a): None for o in unary}
            for b in others:
                for o in binary:
                    out |= {(o, *sorted((a, b), key=text)): None} if o in "+*" else {(o, a, b): None, (o, b, a): None}
        return [t for t in out if complexity(t) <= largest]

    scored: dict[Tree, tuple[float, float, float]] = {}

    def score(trees: list[Tree], shared: list[Tree], left: list[Tree] = ()) -> None:
        new = [t for t in trees if t not in scored]
        if new:
            scored.update(zip(new, _scores(rows, target, new, shared, 1e12, left)))

    first = leaves + joined(leaves, leaves)
    score(first, leaves)
    if not any(math.isfinite(s[0]) for s in scored.values()):
        return spark.createDataFrame([], "equation string, complexity int, offset double, scale double, mse double")
    whole = max(s[0] for s in scored.values() if math.isfinite(s[0])) or 1.0
    rank = lambda t: (round(scored[t][0] / whole, 9), complexity(t), text(t))
    usable = [t for t in first if math.isfinite(scored[t][0])]
    for _ in range(levels - 1):
        best, errors = [], set()
        for t in sorted((t for t in scored if math.isfinite(scored[t][0])), key=rank):
            # Trees of one error are scaled forms of one another as a rule: the shortest stands for them.
            if rank(t)[0] not in errors and len(best) < beam:
                errors.add(rank(t)[0])
                best.append(t)
        score(joined(best, usable), usable + best, best)
    front: list[Tree] = []
    for t in sorted((t for t in scored if math.isfinite(scored[t][0])), key=lambda t: (complexity(t), *rank(t))):
        if not front or scored[t][0] / whole < (1 - gain) * scored[front[-1]][0] / whole - 1e-9:
            if front and complexity(front[-1]) == complexity(t):
                continue
            front.append(t)
    # The few on the front are fitted to their own values.
    scored.update(zip(front, _scores(rows, target, front, leaves, 1e12)))
    # Sums of squares lose what is left of a nearly exact law; the few on the front are measured by their residuals.
    error = [F.avg((F.lit(scored[t][1]) + F.lit(scored[t][2]) * column(t) - F.col(target)) ** 2) for t in front]
    exact = rows.agg(*(e.alias(f"e{i}") for i, e in enumerate(error))).first()
    found = [(text(t), complexity(t), scored[t][1], scored[t][2], e) for t, e in zip(front, exact)]
    return spark.createDataFrame(found, "equation string, complexity int, offset double, scale double, mse double")
