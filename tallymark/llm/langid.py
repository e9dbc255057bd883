"""Language identification with string kernels.

Method: blended-spectrum presence kernels.  A text is the set of its character n-grams of 1 to 3 code points (lower case);
an n-gram is one whole number made of its code points, so no two are ever taken for each other.  The kernel of two texts
is the number of n-grams both hold, over the geometric mean of their counts.  Nyström landmarks turn the kernel into
features, one-versus-rest kernel ridge regression learns a score for each language, and texts are scored in batches by two
matrix products.

Only a bounded sample of labelled rows is learned from: ``PER_LANGUAGE`` rows of each language, ``SAMPLE`` in all, those of at
most ``LEARN_CHARS`` code points first, then in the order of a hash of their id.  Of ``LANDMARKS`` of them the n-gram sets are
collected, of the others only their kernel values.

Edge cases: a null text or one without a letter is "und" with score 0; rows with a null language teach nothing;
a row with a null id is scored but not learned from and not held out; without any labelled row every text is
"und"; repeated rows are scored alike and teach once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 3
LANDMARKS = 96
PER_LANGUAGE = 300
SAMPLE = 3000
LEARN_CHARS = 50_000
RIDGE = 1e-2
BATCH = 64
CHUNK = 1 << 20
PARTS = 64
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column, parts: int, left: int) -> Column:
    """Whether crc32(doc_id as text) mod parts is ``left``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == left, F.lit(False))


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of 1 to ORDER code points of a whole text, ascending; a code point takes 21 bits."""
    parts = []
    low = text.lower()
    for at in range(0, max(len(low), 1), CHUNK):
        codes = np.frombuffer(low[at : at + CHUNK + ORDER - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1
        gram, every = codes, [codes]
        for n in range(1, min(ORDER, len(codes))):
            gram = (gram[:-1] << 21) | codes[n:]
            every.append(gram)
        parts.append(_distinct(np.concatenate(every)))
    return parts[0] if len(parts) == 1 else _distinct(np.concatenate(parts))


class Landmarks:
    """The n-gram sets of the landmarks, as a matrix with a row for each n-gram that any of them holds."""

    def __init__(self, sets: list[np.ndarray]):
        self.vocabulary = _distinct(np.concatenate(sets))
        self.sets = np.zeros((len(self.vocabulary), len(sets)), dtype=np.float32)
        for i, own in enumerate(sets):
            self.sets[np.searchsorted(self.vocabulary, own), i] = 1
        self.sizes = np.sqrt(self.sets.sum(axis=0))

    def kernel(self, texts: list[str]) -> np.ndarray:
        held = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32)
        own = np.empty((len(texts), 1), dtype=np.float32)
        for i, text in enumerate(texts):
            keys = grams(text)
            at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
            held[i, at[self.vocabulary[at] == keys]] = 1
            own[i] = np.sqrt(len(keys))
        return (held @ self.sets) / np.maximum(own * self.sizes, 1e-9)


class Model:
    """The map from a text's kernel values with the landmarks to a score per language."""

    def __init__(self, landmarks: Landmarks, marks: np.ndarray, kernel: np.ndarray, languages: list[str]):
        """kernel: the values of the sampled texts, of which ``marks`` are the landmarks."""
        self.landmarks, self.names = landmarks, sorted(set(languages))
        y = np.array([self.names.index(x) for x in languages])
        values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
        good = values > 1e-6 * values.max(initial=1)
        root = vectors[:, good] / np.sqrt(values[good])
        features = kernel.astype(np.float64) @ root
        goal = np.where(y[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        weight = np.sqrt(len(y) / (len(self.names) * np.bincount(y, minlength=len(self.names))[y]))[:, None]
        left = features * weight
        ridge = left.T @ left + RIDGE * len(y) * np.eye(left.shape[1]) / len(self.names)
        self.map = (root @ np.linalg.solve(ridge, left.T @ (goal * weight))).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        return self.landmarks.kernel(texts) @ self.map


def fit(docs: DataFrame) -> Model | None:
    """Learn from ``docs`` (doc_id, text, lang); None without a labelled row."""
    spark = docs.sparkSession
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    named = named.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("text_key"), (F.length("text") > LEARN_CHARS).alias("long"), "text")
    order = ("long", F.xxhash64("doc_id"), "doc_id", "text_key")
    turn = Window.partitionBy("lang").orderBy(*order)
    # The first of a language are among the first of its parts, so no task ranks more than what the parts leave.
    ids = named.drop("text").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(PARTS)))
    ids = ids.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("turn") <= PER_LANGUAGE).drop("part", "turn")
    ids = ids.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= PER_LANGUAGE)
    ids = ids.drop("turn").distinct().withColumn("turn", F.row_number().over(turn)).orderBy("turn", "lang").limit(SAMPLE)
    key = ["doc_id", "lang", "text_key"]
    picked = [tuple(r[c] for c in key) for r in ids.orderBy("turn", "lang").collect()]  # at most SAMPLE rows
    if not picked:
        return None

    def of(some: list[tuple], make, kind: str) -> dict[tuple, object]:
        """What ``make`` gives for the texts of some sampled rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                made = [x for lo in range(0, len(texts), BATCH) for x in make(texts[lo : lo + BATCH])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(made, pa.binary())], names=[*key, "made"])

        chosen = F.broadcast(spark.createDataFrame(some, "doc_id long, lang string, text_key long"))
        rows = named.select(*key, "text").join(chosen, key, "left_semi").mapInArrow(run, "doc_id long, lang string, text_key long, made binary")
        return {tuple(r[:3]): np.frombuffer(bytes(r.made), dtype=kind) for r in rows.groupBy(*key).agg(F.first("made").alias("made")).collect()}

    marks = picked[:LANDMARKS]
    sets = of(marks, lambda texts: [grams(t).tobytes() for t in texts], "<i8")
    landmarks = Landmarks([sets[m] for m in marks])
    values = of(picked, lambda texts: [row.tobytes() for row in landmarks.kernel(texts)], "<f4")
    return Model(landmarks, np.arange(len(marks)), np.stack([values[p] for p in picked]), [p[1] for p in picked])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                texts = part.column("text").to_pylist()
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                at = [i for i, t in enumerate(texts) if known and t and _LETTER.search(t)]
                if at:
                    out = known.score([texts[i] for i in at])
                    best = out.argmax(axis=1)
                    for i, b in zip(at, best):
                        names[i] = known.names[b]
                    scores[at] = np.clip((out.max(axis=1) + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
