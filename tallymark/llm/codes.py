"""Vector code compression.

Method: every vector is cut into parts and each part is written as the number of the nearest entry of its position's
codebook.  In each round a kd-tree over each codebook is broadcast; a branch-and-bound search, many vectors at a time,
enters the nearer child first and the other one unless its box is farther than the best entry so far, so a box at an equal
distance is entered and the lower number wins ties.  Sums and counts by entry are whole numbers, added up in the tasks and then
across them; the driver gets the sums of the entries only.

Components become whole numbers, floor(scale * x), and all that follows is exact in 64 bits: numbers are held within the
bound of ``limit``, beyond which the squares of a vector would not fit (741,000 for x at scale 256 and 64 components).

Edge cases: a null vector or one with a null or non-finite component is dropped; where lengths differ or do not divide into the
parts, vectors are filled up with zeros to the longest, rounded up; the codebook starts with fewer entries if there are fewer
ids; rows with a null id are coded but start no codebook; of repeated ids the least vector starts the codebook, each row
is coded; null labels are one label; sums of a label's errors beyond 64 bits stay at the greatest number; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import table
from .skew import join_skewed

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LEAF = 4
ROWS = 16_384
MOST = (1 << 63) - 1


class Tree:
    """A kd-tree over the entries of one codebook, with the box of every node."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray) -> tuple:
        some = self.entries[own]
        low, high = some.min(axis=0), some.max(axis=0)
        spread = high - low
        axis = int(spread.argmax()) if spread.size else 0
        if len(own) <= LEAF or not spread.any():
            return low, high, np.sort(own), None, None, None, None
        order = own[np.argsort(some[:, axis], kind="stable")]
        half = len(order) // 2
        cut = self.entries[order[half], axis]
        return low, high, None, axis, cut, self._node(order[:half]), self._node(order[half:])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry of each row and its squared distance; of equal distances the lowest number."""
        best = np.full(len(points), MOST, dtype=np.int64)
        at = np.full(len(points), len(self.entries), dtype=np.int64)
        self._visit(self.root, points, np.arange(len(points)), best, at)
        return at, best

    def _visit(self, node: tuple, points: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if not len(rows):
            return
        _, _, own, axis, cut, left, right = node
        if own is not None:
            apart = ((points[rows][:, None, :] - self.entries[own][None, :, :]) ** 2).sum(axis=2)
            first = apart.argmin(axis=1)
            distance, number = apart[np.arange(len(rows)), first], own[first]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < at[rows]))
            best[rows[better]], at[rows[better]] = distance[better], number[better]
            return
        below = points[rows, axis] < cut
        under, over = rows[below], rows[~below]
        for child, some in ((left, under), (right, over)):
            self._visit(child, points, some, best, at)
        for child, some in ((right, under), (left, over)):
            p = points[some]
            gap = np.maximum(np.maximum(child[0] - p, p - child[1]), 0)
            self._visit(child, points, some[(gap**2).sum(axis=1) <= best[some]], best, at)


def limit(width: int) -> int:
    """The bound of a component for which the squared distances of a whole vector sum up within 64 bits."""
    return isqrt(MOST // max(width, 1)) // 2


def sound(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """vec_id, label and ``x``, the sound vectors in whole numbers, and their common length, a multiple of ``parts``."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("x")).where(sound(F.col("x")))
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // parts) * parts
    most = float(limit(width))
    x = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most))))
    filled = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    return kept.select("vec_id", "label", filled.alias("x")), width


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


def first_entries(rows: DataFrame, width: int, entries: int) -> np.ndarray:
    """The vectors of the smallest ids, ascending; each task sends that many at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, ...]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                near = np.isin(ids, np.partition(np.unique(ids), min(entries, len(np.unique(ids))) - 1)[:entries])
                for i, x in zip(ids[near].tolist(), _matrix(part, width)[near].tolist()):
                    least[i] = min(least.get(i, tuple(x)), tuple(x))
            least = dict(sorted(least.items())[:entries])
        if least:
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array([list(x) for x in least.values()], pa.list_(pa.int64()))], names=["vec_id", "x"])

    found = rows.where("vec_id IS NOT NULL").select("vec_id", "x").mapInArrow(run, "vec_id long, x array<long>")
    picked = found.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(entries).collect()
    return np.array([r.x for r in picked], dtype=np.int64).reshape(len(picked), width)


def trees(books: np.ndarray) -> list[Tree]:
    return [Tree(book) for book in books]


def assigned(x: np.ndarray, grown: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """The entry of every part of every row and the rows' squared distances, summed over the parts."""
    step = x.shape[1] // len(grown)
    numbers, errors = np.empty((len(x), len(grown)), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for p, tree in enumerate(grown):
        numbers[:, p], apart = tree.nearest(x[:, p * step : (p + 1) * step])
        errors += apart
    return numbers, errors


def improve(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round: each used entry is the floored mean of its parts."""
    parts, entries, step = books.shape
    if not books.size:
        return books
    shared = rows.sparkSession.sparkContext.broadcast(trees(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, step), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(lo, ROWS), parts * step)
                numbers, _ = assigned(x, shared.value)
                for p in range(parts):
                    np.add.at(sums[p], numbers[:, p], x[:, p * step : (p + 1) * step])
                    counts[p] += np.bincount(numbers[:, p], minlength=entries)
        place, entry = np.nonzero(counts)
        if len(place):
            used = sums[place, entry]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(place, step), pa.int32()), pa.array(np.repeat(entry, step), pa.int32()), pa.array(np.tile(np.arange(step), len(place)), pa.int32()), pa.array(np.repeat(counts[place, entry], step)), pa.array(used.ravel())],
                names=["part", "entry", "component", "n", "total"],
            )

    added = rows.select("x").mapInArrow(run, "part int, entry int, component int, n long, total long")
    # Sums over all rows may outgrow a long.
    sums = added.groupBy("part", "entry", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    better = books.copy()
    for r in sums.collect():  # one row per component of the codebooks
        better[r.part, r.entry, r.component] = int(r.total) // r.n
    return better


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error and codebooks_sha256 of the sound rows of ``vectors`` (vec_id, label, embedding)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows, width = whole(vectors, parts, scale)
    start = first_entries(rows, width, entries)
    books = start.reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = improve(rows, books)
    shared = rows.sparkSession.sparkContext.broadcast(trees(books) if len(start) else None)
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                # Without an id nothing starts a codebook: there is nothing to be far from.
                numbers, errors = assigned(_matrix(part, width), shared.value) if shared.value else (np.zeros((part.num_rows, 0), dtype=np.int64), np.zeros(part.num_rows, dtype=np.int64))
                code = [raw.hex() for raw in map(bytes, numbers.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    coded = table(rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "vector-codes")
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    keyed = coded.withColumn("label_key", key)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = table(keyed.groupBy("label_key").agg(total.alias("label_error"), F.count("*").alias("n_rows")), "label-errors")
    return join_skewed(keyed, sums, "label_key", "n_rows").select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
