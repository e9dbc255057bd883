"""What a model's answer owes to each parameter, and the directions in which data varies most."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import tidy

EXACT = 11


def coalitions(d: int, samples: int = 1000, seed: int = 42) -> list[tuple[int, float]]:
    """Sets of parameters as bits, but the empty and the full one, with their Shapley weights: all of up to EXACT parameters, else ``samples`` drawn ones.

    A drawn set comes from a uniform size, so it weighs what makes up for that.
    """
    weight = lambda size: (d - 1) / (comb(d, size) * size * (d - size))
    if d <= EXACT:
        return [(bits, weight(bits.bit_count())) for bits in range(1, (1 << d) - 1)]
    rng = np.random.default_rng(seed)
    drawn = [sum(1 << int(i) for i in rng.choice(d, int(rng.integers(1, d)), replace=False)) for _ in range(samples)]
    return [(bits, weight(bits.bit_count())) for bits in drawn]


def shapley(rows: DataFrame, background: DataFrame, group: str, names: list[str], model: Callable[[dict[str, Column]], Column], samples: int = 1000) -> DataFrame:
    """group, item, name, value: how far each parameter moves the model's answer on a row of ``rows`` from its mean over its group's ``background``.

    rows: group, item and the parameters; few of a group.  Every background row answers once for each coalition, with the row's own
    parameters inside the coalition, and the answers are averaged as they come: nothing is kept by pairs.  The values solve the
    weighted least squares over the coalitions under the condition that they sum up to the whole difference; the normal equations are
    sums over coalitions, one small system for each row.  With all coalitions these are the Shapley values.  Rows with a missing
    parameter are left out on both sides; a row without a background has no values.
    """
    d, chosen = len(names), coalitions(len(names), samples)
    own = rows.dropna(subset=names).select(group, "item", *(F.col(n).alias(f"own_{n}") for n in names))
    pairs = background.dropna(subset=names).select(group, *names).join(own, group)
    answer = lambda bits: model({n: F.col(f"own_{n}") if bits >> i & 1 else F.col(n) for i, n in enumerate(names)})
    # One column for each coalition: a pass over the background whatever their number.
    sets = [0, (1 << d) - 1, *sorted({bits for bits, _ in chosen})]
    means = pairs.groupBy(group, "item").agg(*(F.avg(answer(bits)).alias(f"v{bits}") for bits in sets))
    kind, item = rows.schema[group].dataType.simpleString(), rows.schema["item"].dataType.simpleString()

    z = np.array([[bits >> i & 1 for i in range(d)] for bits, _ in chosen], dtype=float).reshape(len(chosen), d)
    w = np.array([x for _, x in chosen])
    # The last value is what the others leave of the whole, so d - 1 are free.
    free = z[:, :-1] - z[:, -1:]
    normal = (free * w[:, None]).T @ free

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = {bits: batch.column(f"v{bits}").to_numpy(zero_copy_only=False) for bits in sets}
            whole = v[(1 << d) - 1] - v[0]
            if d == 1:
                phi = whole[:, None]
            else:
                gain = np.stack([v[bits] - v[0] for bits, _ in chosen], axis=1) - z[:, -1] * whole[:, None]
                part = np.linalg.solve(normal, ((gain * w) @ free).T).T
                phi = np.c_[part, whole - part.sum(axis=1)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), d))
            yield pa.RecordBatch.from_arrays([batch.column(group).take(at), batch.column("item").take(at), pa.array(names * batch.num_rows), pa.array(phi.ravel())], names=[group, "item", "name", "value"])

    found = means.mapInArrow(solve, f"{group} {kind}, item {item}, name string, value double")
    return found.select(group, "item", "name", tidy(F.col("value")).alias("value"))


# ---------------------------------------------------------------- principal directions


def moments(table: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (over n - 1) of an array column of equal lengths: one pass, upper-triangle sums from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = pc.list_flatten(batch.column(column)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n, one, two = n + len(x), x.sum(axis=0), x.T @ x
                first, second = (one, two) if first is None else (first + one, second + two)
        if n:
            i, j = np.triu_indices(len(first))
            rows = [(0, 0, float(n)), *((k + 1, 0, x) for k, x in enumerate(first.tolist())), *zip((i + 1).tolist(), (j + 1).tolist(), second[i, j].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "total"])

    sums = table.select(F.col(column).cast("array<double>").alias(column)).mapInArrow(run, "i int, j int, total double")
    found = {(r.i, r.j): r.total for r in sums.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}  # a triangle of the dimensions
    n, d = int(found.get((0, 0), 0)), max((i for i, _ in found), default=0)
    mean = np.array([found[i + 1, 0] for i in range(d)]) / max(n, 1)
    cov = np.zeros((d, d))
    for (i, j), total in found.items():
        if j:
            cov[i - 1, j - 1] = cov[j - 1, i - 1] = total
    return n, mean, (cov - n * np.outer(mean, mean)) / max(n - 1, 1)


def axes(cov: np.ndarray, k: int, rounds: int = 200, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest variances and their unit directions, by power iteration and deflation; the largest entry of each is positive.

    An iteration that settles slowly, because two variances are close, is finished on the subspace that is left.
    """
    left, values, vectors = cov.copy(), [], []
    for _ in range(min(k, len(cov))):
        v = left[:, int(np.argmax(np.diag(left)))].copy()
        if not v.any():
            v = np.eye(len(cov))[len(values)]
        v /= np.linalg.norm(v)
        for _ in range(rounds):
            new = left @ v
            size = np.linalg.norm(new)
            if size == 0:
                break
            gone, v = np.abs(new / size - v).max(), new / size
            if gone < tolerance:
                break
        else:
            v = np.linalg.eigh(left)[1][:, -1]
        v = v * np.sign(v[int(np.argmax(np.abs(v)))])
        values.append(float(v @ left @ v))
        vectors.append(v)
        left = left - values[-1] * np.outer(v, v)
    return np.array(values), np.array(vectors).reshape(len(vectors), len(cov))


def project(table: DataFrame, column: str, k: int, share: float | None = None, scaled: bool = False) -> DataFrame:
    """``table`` with ``places``, each row's coordinates on the ``k`` directions of most variance, or on the first that explain ``share`` of it.

    ``scaled`` measures every component in its deviations (a constant one as it is).  Rows whose array is null, holds a null or has not the
    most frequent length have null places and no part in the directions.  The driver gets the sums and the directions, of the
    square of the dimensions; the rows stay where they are.  One row alone, or none, varies in no direction: its places are zeros.
    """
    lengths = table.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = lengths.n if lengths else 0
    good = F.col(column).isNotNull() & (F.size(column) == width) & F.coalesce(F.forall(column, lambda x: x.isNotNull()), F.lit(False))
    n, mean, cov = moments(table.where(good), column)
    size = np.sqrt(np.diag(cov)) if len(cov) else np.zeros(0)
    size = np.where(size > 0, size, 1.0) if scaled else np.ones(len(cov))
    values, vectors = axes(cov / np.outer(size, size), k)
    if share is not None and len(values):
        whole = np.trace(cov / np.outer(size, size))
        vectors = vectors[: int(np.searchsorted(np.cumsum(values) / max(whole, 1e-300), share - 1e-12)) + 1]
    to = (vectors / size).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index(column)
                x = pc.list_flatten(batch.column(at).cast(pa.list_(pa.float64()))).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                places = (x - mean) @ to
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "places"])

    rest = table.drop("places").where(~good).withColumn("places", F.lit(None).cast("array<double>"))
    schema = rest.schema
    return table.drop("places").where(good).mapInArrow(run, schema).unionByName(rest)
