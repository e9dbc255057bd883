"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage is encoded by a learned layer over its byte profile
(square roots of byte frequencies and of the shares of repeated byte triples and of word lengths); gated attention,
learned from document labels alone, weighs the encoded passages, and the weighted sum is scored by a logistic layer.

Only a bounded sample of labelled documents is learned from: of each class ``SAMPLE`` at most (few enough for Spark to
limit each class before the shuffle) with ``SAMPLE_BYTES`` of text in all, the first in the order of a hash of their id; a
text that would pass the bound is left for later ones that fit.  The fit is plain numpy with a fixed seed, so reruns agree.

Edge cases: a null or empty text is one empty passage and gets a score like any other; labels that are null teach
nothing; a row with a null id is scored, not learned from and not held out; with labels of one class only every
score is that class; without labels every score is 0.5; repeated rows score alike and teach once; of rows that share an id
the one of the shortest text teaches; an empty table gives an empty result; further columns are kept, and one that has
the score's name gives way to the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

PASSAGE = 64
SAMPLE = 1000
SAMPLE_BYTES = 16 << 20
PARTS = 64
TRIPLES = 64
LENGTHS = 16
WIDTH = 256 + TRIPLES + LENGTHS + 1
HIDDEN = 32
GATE = 16
EPOCHS = 40
SEED = 7

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def passages(text: str | None) -> np.ndarray:
    """The profile of every passage of a whole text: one row per passage of PASSAGE words, at least one row."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(raw) == 0:
        out = np.zeros((1, WIDTH), dtype=np.float32)
        out[0, -1] = 1
        return out
    space = _SPACE[raw]
    ends = space.copy()
    ends[:-1] &= ~space[1:]
    at = np.cumsum(ends, dtype=np.int32)
    at -= ends
    where = at // PASSAGE
    n = int(where[-1]) + 1
    size = np.bincount(where, minlength=n).astype(np.float32)[:, None]
    out = np.zeros((n, WIDTH), dtype=np.float32)
    out[:, :256] = np.bincount(where * 256 + raw, minlength=n * 256).reshape(n, 256) / size
    if len(raw) > 2:
        wide = raw.astype(np.uint32)
        triple = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(26)
        out[:, 256 : 256 + TRIPLES] = np.bincount(where[:-2] * TRIPLES + triple, minlength=n * TRIPLES).reshape(n, TRIPLES) / size
    stops = np.flatnonzero(ends)
    long = np.diff(np.r_[-1, stops, len(raw)]) - 1
    home = where[np.r_[stops, len(raw) - 1]]
    out[:, 256 + TRIPLES : -1] = np.bincount(home * LENGTHS + np.minimum(long, LENGTHS - 1), minlength=n * LENGTHS).reshape(n, LENGTHS) / PASSAGE
    np.sqrt(out, out=out)
    out[:, -1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Attention:
    """Encoder, gated attention and score; fitted by Adam on the documents' log loss."""

    def __init__(self, bags: list[np.ndarray], labels: np.ndarray):
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": draw(WIDTH, HIDDEN) * 2, "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "w": draw(GATE, 1), "c": draw(HIDDEN, 1), "b": np.zeros((1, 1), dtype=np.float32)}
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            rate = 0.01 if epoch < EPOCHS * 3 // 4 else 0.002
            for lo in range(0, len(order), 64):
                part = order[lo : lo + 64]
                grads = self._gradients([bags[i] for i in part], labels[part])
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)

    def _forward(self, bags: list[np.ndarray]) -> tuple:
        x = np.concatenate(bags)
        first = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
        owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        h = np.tanh(x @ self.p["e"])
        v, u = np.tanh(h @ self.p["v"]), _sigmoid(h @ self.p["u"])
        a = (v * u) @ self.p["w"]
        a = np.exp(a - np.maximum.reduceat(a, first)[owner])
        a /= np.add.reduceat(a, first)[owner]
        z = np.add.reduceat(a * h, first)
        y = _sigmoid(z @ self.p["c"] + self.p["b"])[:, 0]
        return x, first, owner, h, v, u, a, z, y

    def _gradients(self, bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        x, first, owner, h, v, u, a, z, y = self._forward(bags)
        dy = ((y - labels) / len(bags)).astype(np.float32)[:, None]
        dz = dy @ self.p["c"].T
        da = (dz[owner] * h).sum(axis=1, keepdims=True)
        da = a * (da - np.add.reduceat(a * da, first)[owner])
        dvu = da @ self.p["w"].T
        dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
        dh = (a * dz[owner] + dv @ self.p["v"].T + du @ self.p["u"].T) * (1 - h * h)
        return {"e": x.T @ dh, "v": h.T @ dv, "u": h.T @ du, "w": (v * u).T @ da, "c": z.T @ dy, "b": dy.sum(axis=0, keepdims=True)}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return self._forward(bags)[-1].astype(np.float64)


class Constant:
    """What is known when the labels hold one class or none."""

    def __init__(self, value: float):
        self.value = value

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.full(len(bags), self.value)


def fit(docs: DataFrame, labels: DataFrame) -> Attention | Constant:
    """Learn from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality 0 or 1) marks."""
    spark = docs.sparkSession
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    # The first of a class are among the first of its parts, so no task ranks more than what the parts leave.
    parted = Window.partitionBy("quality", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(F.xxhash64("doc_id"), "doc_id")
    marked = marked.withColumn("rank", F.row_number().over(parted)).where(F.col("rank") <= SAMPLE).drop("rank")
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = marked.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    chosen = own.join(F.broadcast(ids), "doc_id")  # at most 2 * SAMPLE ids
    sizes = chosen.groupBy("doc_id", "quality").agg(F.min(F.struct("size", "text_key")).alias("least")).select("doc_id", "quality", "least.size", "least.text_key", F.xxhash64("doc_id").alias("turn"))
    picks, used = [], {0: 0, 1: 0}
    for r in sorted(sizes.collect(), key=lambda r: (r.turn, r.doc_id, r.quality)):
        if used[r.quality] + r.size <= SAMPLE_BYTES:
            used[r.quality] += r.size
            picks.append((r.doc_id, r.quality, r.text_key))
    if not picks:
        return Constant(0.5)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])

    some = F.broadcast(spark.createDataFrame(picks, "doc_id long, quality int, pick_key long"))
    texts = own.join(some, "doc_id").where(F.col("text_key").eqNullSafe(F.col("pick_key"))).select("doc_id", "quality", "text")
    # A word takes two bytes at least, so the bags hold some five times SAMPLE_BYTES for each class at most.
    rows = texts.mapInArrow(encode, "doc_id long, quality int, bag binary").groupBy("doc_id", "quality").agg(F.first("bag").alias("bag")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality))
    y = np.array([r.quality for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return Constant(float(y[0]))
    return Attention([np.frombuffer(bytes(r.bag), dtype=np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows], y)


def score(docs: DataFrame, model: Attention | Constant, column: str = "quality_score") -> DataFrame:
    """``docs`` with a further column: 0 to 1, higher for better texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != column.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                scores = shared.value.score([passages(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*kept, column])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(column, DoubleType())]))


def keep(docs: DataFrame, model: Attention | Constant, least: float) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    column = "quality_score"
    while column in {c.lower() for c in docs.columns}:
        column += "_"
    return score(docs, model, column).where(F.col(column) >= least).drop(column)
