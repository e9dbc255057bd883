"""Approximate nearest neighbours by Euclidean distance.

Method: NN-descent.  A first graph comes from exact neighbours inside blocks of random one-dimensional projections;
each iteration then joins every vector's neighbours and reverse neighbours at that vector (a Spark join that brings
their codes together), compares with each other those of which at least one is new there, and keeps for each the
nearest found, until under ``SETTLED`` of the links change.  Queries walk the finished graph greedily: in rounds of
Spark joins each query expands the nearest vectors of its beam that it has not expanded yet, and measures the
neighbours that it has not met, until its beam holds no unexpanded vector; the beam is then measured exactly.

Equal vectors are one vertex.  Of each vertex the ``k + 1`` smallest ids are kept, which is all a query of ``k``
neighbours can name.  The graph works on 16-bit codes and on differences from a common centre, so it tells near-equal
vectors apart down to about 3e-5 of their largest component; the scores returned are double precision on the originals.

Edge cases: vectors that are null, empty, zero, hold null or non-finite components, or have not the table's most
frequent dimension take no part, neither as queries nor as candidates; null ids likewise; equal distances are ordered
by id; repeated rows, as queries or as candidates, are one; with fewer candidates than ``k`` all found are returned; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table

TREES = 8
BLOCK = 256
DEGREE = 40
REVERSE = 40
PER_JOIN = 16
SLICE = 512
SETTLED = 0.02
ITERATIONS = 15
BEAM = 128
EXPAND = 16
ENTRIES = 64
SEED = 11


def encode(vectors: np.ndarray) -> list[bytes]:
    """Each row as a 4-byte scale and two signed bytes per component."""
    scale = (np.abs(vectors).max(axis=1, keepdims=True) / 32767).astype(np.float32)
    codes = np.rint(np.clip(vectors / np.maximum(scale, 1e-30), -32767, 32767)).astype("<i2")
    return [a + b for a, b in zip(map(bytes, scale.astype("<f4")), map(bytes, codes))]


def decode(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
    return np.ascontiguousarray(raw[:, 4:]).view("<i2").astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    common = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.where(F.size("embedding") == (common.n if common else 0))


@dataclass
class Index:
    """vertices: node, embedding, ids (its smallest ids).  codes: node, code.  graph: node, near (neighbours' nodes)."""

    vertices: DataFrame
    codes: DataFrame
    graph: DataFrame
    k: int


def _vertices(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: node (its smallest id), embedding, and its k + 1 smallest ids."""
    salted = vectors.withColumn("salt", F.pmod("vec_id", F.lit(32)))
    for keys in (["embedding", "salt"], ["embedding"]):
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        salted = salted.withColumn("rank", order).where(F.col("rank") <= k + 1)
    return salted.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), "embedding", "ids")


def _coded(vertices: DataFrame) -> DataFrame:
    """node, code and its place on every random projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                lines = np.random.default_rng(SEED).standard_normal((x.shape[1], TREES))
                places = pa.FixedSizeListArray.from_arrays(pa.array((x @ lines).ravel()), TREES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(encode(x), pa.binary()), places], names=["node", "code", "places"])

    return vertices.select("node", "embedding").mapInArrow(run, "node long, code binary, places array<double>")


EDGES = "u long, v long, d float"


def _edges(u: list, v: list, d: list) -> pa.RecordBatch:
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
    return pa.RecordBatch.from_arrays([pa.array(join(u, np.int64)), pa.array(join(v, np.int64)), pa.array(join(d, np.float32))], names=["u", "v", "d"])


def _near_rows(near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``most`` smallest finite entries of each row."""
    most = min(most, near.shape[1])
    at = np.argpartition(near, most - 1, axis=1)[:, :most]
    rows = np.repeat(np.arange(len(near)), most)
    cols = at.ravel()
    good = np.isfinite(near[rows, cols])
    return rows[good], cols[good]


def _first_graph(coded: DataFrame) -> DataFrame:
    """Exact neighbours inside blocks of each projection's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = part.column("node").to_numpy()
                x = decode(part.column("code").to_pylist())
                x -= x.mean(axis=0)
                near = _squares(x, x)
                np.fill_diagonal(near, np.inf)
                i, j = _near_rows(near, DEGREE // 2)
                yield _edges([ids[i]], [ids[j]], [near[i, j]])

    out = None
    for tree in range(TREES):
        line = coded.select("node", "code", F.get("places", F.lit(tree)).alias("place"))
        parts = line.repartitionByRange("place").sortWithinPartitions("place", "node").select("node", "code").mapInArrow(run, EDGES)
        out = parts if out is None else out.unionByName(parts)
    return out


def _keep_nearest(edges: DataFrame, most: int) -> DataFrame:
    """Each vertex's nearest edges, every neighbour once; equal distances by hash, so that no vertex becomes everyone's choice."""
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.bool_and("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", F.xxhash64("u", "v")))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def _links(edges: DataFrame) -> DataFrame:
    """node, id, fresh: every vertex's neighbours and nearest reverse neighbours."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("d", F.xxhash64("u", "v")))
    back = edges.withColumn("rank", rank).where(F.col("rank") <= REVERSE).select(F.col("v").alias("node"), F.col("u").alias("id"), "fresh")
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("id"), "fresh").unionByName(back)
    return both.groupBy("node", "id").agg(F.bool_or("fresh").alias("fresh"))


def _around(edges: DataFrame, coded: DataFrame) -> DataFrame:
    """near: of each vertex the ids, worst kept distances, freshness and codes of those that it is linked with."""
    worst = edges.groupBy("u").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    worst = worst.select(F.col("u").alias("id"), F.when(F.col("n") >= DEGREE, F.col("d")).otherwise(F.lit(float("inf"))).cast("float").alias("worst"))
    info = coded.select(F.col("node").alias("id"), "code").join(worst, "id", "left")
    item = F.struct("id", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"), "fresh", "code")
    return _links(edges).join(info, "id").groupBy("node").agg(F.collect_list(item).alias("near"))


def _local_join(around: DataFrame) -> DataFrame:
    """Neighbours of a common neighbour, compared: those nearer to each other than what they have, one of each pair new here."""

    def compare(lists: pa.ListArray) -> pa.RecordBatch:
        u, v, d = [], [], []
        flat, cuts = lists.flatten(), lists.offsets.to_numpy()
        ids, worst = flat.field("id").to_numpy(), flat.field("worst").to_numpy()
        fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
        codes = decode(flat.field("code").to_pylist()) if len(flat) else None
        for lo, hi in zip((cuts[:-1] - cuts[0]).tolist(), (cuts[1:] - cuts[0]).tolist()):
            new = fresh[lo:hi]
            if not new.any():
                continue
            x = codes[lo:hi] - codes[lo:hi].mean(axis=0)
            near = _squares(x, x)
            near[(near >= worst[lo:hi, None]) | ~(new[:, None] | new[None, :])] = np.inf
            np.fill_diagonal(near, np.inf)
            i, j = _near_rows(near, PER_JOIN)
            u.append(ids[lo + i])
            v.append(ids[lo + j])
            d.append(near[i, j])
        return _edges(u, v, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                yield compare(batch.slice(lo, SLICE).column("near"))

    return around.select("near").mapInArrow(run, EDGES)


def build(vectors: DataFrame, k: int = 10, iterations: int = ITERATIONS) -> Index:
    """The neighbour graph over every valid vector of ``vectors`` (vec_id, embedding)."""
    vertices = table(_vertices(valid(vectors), k), "ann-vertices")
    coded = table(_coded(vertices), "ann-codes")
    edges = table(_keep_nearest(_first_graph(coded).withColumn("fresh", F.lit(True)), DEGREE), "ann-edges")
    for _ in range(iterations):
        found = _local_join(_around(edges, coded)).withColumn("fresh", F.lit(True))
        edges = table(_keep_nearest(edges.withColumn("fresh", F.lit(False)).unionByName(found), DEGREE), "ann-edges")
        changed, total = edges.select(F.count_if("fresh"), F.count("*")).first()
        if changed <= SETTLED * total:
            break
    graph = table(_links(edges).groupBy("node").agg(F.collect_list("id").alias("near")), "ann-graph")
    return Index(vertices, coded.select("node", "code"), graph, k)


def search(index: Index, queries: DataFrame) -> DataFrame:
    """For each row of ``queries`` (query_id, embedding as doubles) the nearest ``index.k`` found, itself left out.

    A walk starts at the vertex equal to the query, if there is one, and at the nearest of a fixed few vertices.
    Repeated rows of ``queries`` are one query; different vectors under one id are queries of their own.
    Returns query_id, rank, vec_id, score.
    """
    queries = queries.select("query_id", "embedding").distinct()
    return _name(index, queries, *walk(index, queries))


def walk(index: Index, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct query vectors (embedding, spot) and all that their walks measured (spot, node, d, done)."""
    spots = queries.groupBy("embedding").agg(F.min("query_id").alias("spot"))
    spots = table(spots, "ann-queries")
    home = table(_coded(spots.select(F.col("spot").alias("node"), "embedding")).select(F.col("node").alias("spot"), F.col("code").alias("home")), "ann-homes")
    # A fixed number of entry vertices, so small enough to send everywhere.
    entries = sorted(tuple(r) for r in index.vertices.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node", "embedding").collect())
    doors = np.array([n for n, _ in entries], dtype=np.int64)
    places = np.array([e for _, e in entries])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(doors):
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = _squares(x, places)
                i, j = _near_rows(near, 4)
                out = _edges([batch.column("spot").to_numpy()[i]], [doors[j]], [near[i, j]])
                yield pa.RecordBatch.from_arrays(out.columns, names=["spot", "node", "d"])

    first = spots.mapInArrow(enter, "spot long, node long, d float")
    own = spots.join(index.vertices.select("node", "embedding"), "embedding").select("spot", "node", F.lit(0.0).cast("float").alias("d"))
    seen = table(_merge(first.unionByName(own).withColumn("done", F.lit(False))), "ann-seen")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = decode(batch.column("code").to_pylist()) - decode(batch.column("home").to_pylist())
                far = pa.array((apart * apart).sum(axis=1), pa.float32())
                yield pa.RecordBatch.from_arrays([batch.column("spot"), batch.column("node"), far], names=["spot", "node", "d"])

    while True:
        ahead = table(_nearest(_nearest(seen, BEAM).where(~F.col("done")), EXPAND).select("spot", "node"), "ann-ahead")
        if ahead.isEmpty():
            return spots, seen
        met = ahead.join(index.graph, "node").select("spot", F.explode("near").alias("node")).distinct()
        met = met.join(seen.select("spot", "node"), ["spot", "node"], "left_anti")
        found = met.join(index.codes, "node").join(home, "spot").select("spot", "node", "code", "home").mapInArrow(measure, "spot long, node long, d float")
        mark = ahead.withColumn("d", F.lit(float("inf")).cast("float")).withColumn("done", F.lit(True))
        seen = table(_merge(seen.unionByName(found.withColumn("done", F.lit(False))).unionByName(mark)), "ann-seen")


def _name(index: Index, queries: DataFrame, spots: DataFrame, seen: DataFrame) -> DataFrame:
    """Each query's nearest rows by exact distance, from the beam that its walk ended with."""
    beam = _nearest(seen, BEAM).select("spot", "node")
    apart = F.aggregate(F.zip_with("embedding", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = beam.join(spots, "spot").join(index.vertices.select("node", F.col("embedding").alias("other"), "ids"), "node")
    pairs = pairs.select("spot", "ids", F.sqrt(apart).alias("score"))
    # A vertex as near as k others of smaller ids is never among the k + 1 first.
    tight = F.row_number().over(Window.partitionBy("spot").orderBy("score", F.element_at("ids", 1)))
    pairs = pairs.withColumn("rank", tight).where(F.col("rank") <= index.k + 1).drop("rank")
    asked = queries.join(spots, "embedding").select("query_id", "spot")
    named = asked.join(pairs, "spot").select("query_id", "spot", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    order = F.row_number().over(Window.partitionBy("query_id", "spot").orderBy("score", "vec_id"))
    return named.withColumn("rank", order).where(F.col("rank") <= index.k).select("query_id", "rank", "vec_id", "score")


def _merge(rows: DataFrame) -> DataFrame:
    """Every vertex that a query met once, and whether it was expanded."""
    return rows.groupBy("spot", "node").agg(F.min("d").alias("d"), F.bool_or("done").alias("done"))


def _nearest(rows: DataFrame, most: int) -> DataFrame:
    """Each query's nearest vertices."""
    rank = F.row_number().over(Window.partitionBy("spot").orderBy("d", "node"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
