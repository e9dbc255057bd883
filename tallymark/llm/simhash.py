"""SimHash near-duplicate detection.

Method: tiled exact comparison.  Distinct fingerprints are laid out in tiles by their population counts, tiles are
paired only if those counts lie within the radius of each other, and a pair of tiles is compared whole with numpy
exclusive-or and bit counts.  For a small radius a tile has one count for each 16-bit quarter: two fingerprints within the
radius differ in no more bits than the radius in all quarters together, so no pair is missed and few tiles are paired.
A tile pair reports a spanning forest of its links, never all pairs of a group.

Fingerprints have 64 bits or a multiple; the further words are mixed from the same shingle hashes.

``keep_one`` decides by the sets of distinct five-word shingles: two texts are linked if the sets share NEAR_SHARE or more of
their union.  Wide fingerprints of the sets only find candidates: at a similarity of 0.8 they differ in about 39 of 256 bits
(sets of 4 and 5 shingles, the worst case, in 48), unrelated texts in 128, so a radius of 80 is five or more standard deviations
from what must be linked.  The sets of each candidate component are then compared whole, in pairs of blocks of bounded size.
Sets of under four shingles reach 0.8 only if they are equal; equal sets are one node and need no comparison.

Edge cases: null, empty and word-less texts have fingerprint zero and are linked like any other; equal texts
have equal fingerprints; a null id belongs to its component but never names it; an empty table gives an empty
result; columns beside doc_id and text are ignored, and kept by ``keep_one`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import table
from .skew import join_skewed

SHINGLE = 3
RADIUS = 2
SEED = 42
TILE = 4096
QUARTERED = 3
NEAR_SHINGLE = 5
NEAR_WORDS = 4
NEAR_RADIUS = 80
NEAR_SHARE = (4, 5)
WIDE_TILES = 64
WIDE_MOST = 1 << 18
BLOCK = 1 << 17
PLACES = 1 << 23
_ODD = 0x9E3779B97F4A7C15


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """Further 64-bit words from each hash."""
    out = [hashes]
    for i in range(1, words):
        x = hashes + np.uint64(i * _ODD % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1, chunk: int = 1 << 14) -> list[int]:
    """The fingerprint's 64-bit words: a bit is set if it is in over half of the shingles' XXH64."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * words
    line = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = (ends - [len(w) for w in tokens]).tolist()
    last = ends[min(shingle, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(last), chunk):
        raw = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[at : at + chunk], last[at : at + chunk])])
        hashes = _mixed(np.frombuffer(raw, dtype=">u8").astype(np.uint64), words) if words > 1 else np.frombuffer(raw, dtype=">u8")
        bits = np.unpackbits(np.ascontiguousarray(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64 * words)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(last)).view(">u8").tolist()


def _names(words: int) -> list[str]:
    return [f"fp{i}" for i in range(words)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, the fingerprint's words fp0, ... as signed longs, and node, one long that stands for it."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, words) for t in batch.column("text").to_pylist()], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(fps[:, i]) for i in range(words))], names=["doc_id", *_names(words)])

    schema = ", ".join(["doc_id long", *(f"{n} long" for n in _names(words))])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, schema)
    return own.withColumn("node", F.col("fp0") if words == 1 else F.xxhash64(*_names(words)))


def _neighbours(radius: int, parts: int) -> list[int]:
    """Differences of tile keys, each unordered pair of tiles once; a part's count takes ten bits, kept off their ends."""
    near = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [sum(x << (10 * i) for i, x in enumerate(reversed(d))) for d in near if d >= (0,) * parts]


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, step: int = 64) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles of (node, words...) rows, or inside one."""
    left, right = a[:, 1:].view(np.uint64), np.ascontiguousarray(b[:, 1:].T).view(np.uint64)
    shift = 0 if same else len(a)
    tree = np.arange(shift + len(b))
    out = []
    for lo in range(0, len(a), step):
        part = left[lo : lo + step]
        bits = np.bitwise_count(part[:, :1] ^ right[0])
        for w in range(1, len(right)):
            bits += np.bitwise_count(part[:, w : w + 1] ^ right[w])
        near = bits <= radius
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            at = np.flatnonzero(near[i])
            if same:
                at = at[at > lo + i]
            if len(right) > 3:
                # The byte of a count wraps at 256 bits; what looks near is counted again.
                at = at[np.bitwise_count(part[i] ^ right[:, at].T).sum(axis=1, dtype=np.int64) <= radius]
            own = tree[lo + i]
            others, first = np.unique(tree[shift + at], return_index=True)
            for other, k in zip(others.tolist(), first.tolist()):
                if other != own:
                    tree[tree == other] = own
                    out.append((int(a[lo + i, 0]), int(b[at[k], 0])))
    return out


def _compared(words: int, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of tiles -> links, of which each batch reports a spanning forest."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over: dict[int, int] = {}
            kept = []
            for at in range(batch.num_rows):
                a, b = (batch.column(c)[at].values.to_numpy().reshape(-1, words + 1) for c in ("a", "b"))
                for pair in _forest(a, b, radius, batch.column("same")[at].as_py()):
                    u, v = pair
                    while u in over:
                        over[u] = u = over.get(over[u], over[u])
                    while v in over:
                        over[v] = v = over.get(over[v], over[v])
                    if u != v:
                        over[max(u, v)] = min(u, v)
                        kept.append((max(u, v), min(u, v)))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return compare


def links(distinct: DataFrame, words: int = 1, radius: int = RADIUS, share: tuple[int, int] | None = None) -> DataFrame:
    """Distinct (node, fp0, ...) -> (a, b): links that connect every two fingerprints of at most ``radius`` differing bits.

    share: tiles are also skipped if their ``size`` columns (of shingle sets) differ by more than this share allows.
    """
    if words > 1:
        return _wide_links(distinct, words, radius, share)
    parts = 4 if radius <= QUARTERED else 1
    ones = [F.bit_count(F.shiftrightunsigned("fp0", low).bitwiseAND(F.lit(0xFFFF))) for low in (48, 32, 16, 0)] if parts == 4 else [F.bit_count("fp0")]
    key = F.lit(0).cast("long")
    for i, count in enumerate(reversed(ones)):
        key = key + F.shiftleft((count + F.lit(radius)).cast("long"), 10 * i)
    keyed = distinct.select("node", "fp0", key.alias("tile"))
    # There are at most 17^4 tile keys, so their counts are small enough to send to every executor.
    counts = keyed.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    split = keyed.join(F.broadcast(counts), "tile").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = table(split.groupBy("tile", "part").agg(F.flatten(F.sort_array(F.collect_list(F.array("node", "fp0")))).alias("rows")), "simhash-tiles")
    step = F.explode(F.array(*(F.lit(x).cast("long") for x in _neighbours(radius, parts))))
    left = tiles.select(F.col("tile").alias("own"), F.col("part").alias("own_part"), F.col("rows").alias("a"), step.alias("step"))
    left = left.withColumn("tile", F.col("own") + F.col("step"))
    right = tiles.select("tile", "part", F.col("rows").alias("b"))
    pairs = left.join(right, "tile").where((F.col("step") != 0) | (F.col("own_part") <= F.col("part")))
    pairs = pairs.select("a", "b", ((F.col("step") == 0) & (F.col("own_part") == F.col("part"))).alias("same"))
    if parts == 1:
        # Few pairs of large tiles: deal them out one by one.
        pairs = pairs.repartition(F.xxhash64(F.get("a", F.lit(0)), F.get("b", F.lit(0))))
    return pairs.mapInArrow(_compared(words, radius), "a long, b long")


def _wide_links(distinct: DataFrame, words: int, radius: int, share: tuple[int, int] | None) -> DataFrame:
    """Links at a radius where population counts part nothing.  Tiles go by the order of set sizes, if a share is given.

    There are about WIDE_TILES tiles, more only where one would pass WIDE_MOST rows, so what is shuffled (each tile once for each
    tile it is compared with) grows with the table, not with its square; the comparisons themselves grow with the square.
    """
    names = _names(words)
    sized = distinct.select("node", *names, (F.col("size") if share else F.lit(0)).cast("long").alias("size"))
    total = sized.count()
    most = min(max(TILE, -(-total // WIDE_TILES)), WIDE_MOST)
    cuts = -(-total // most)
    bounds = sorted(set(sized.approxQuantile("size", [i / cuts for i in range(1, cuts)], 1 / (4 * cuts)))) if share and cuts > 1 else []
    bucket = sum(((F.col("size") >= F.lit(int(b))).cast("int") for b in bounds), F.lit(0)) if len(bounds) < 100 else F.size(F.filter(F.array(*(F.lit(int(b)) for b in bounds)), lambda x: x <= F.col("size")))
    sized = sized.withColumn("bucket", bucket)
    # One row per bucket, and one per tile: as many as the table has times WIDE_MOST rows, WIDE_TILES at least.
    spans = sorted(tuple(r) for r in sized.groupBy("bucket").agg(F.min("size"), F.max("size"), F.count("*")).collect())
    num, den = share or (0, 1)
    parts = [-(-n // most) for *_, n in spans]
    base = [sum(parts[:i]) for i in range(len(parts))]
    rows = []
    for i, (b, low, high, _) in enumerate(spans):
        near = [j for j, (_, low2, high2, _) in enumerate(spans) if min(high, high2) * den >= max(low, low2) * num]
        rows.append((b, base[i], parts[i], base[near[0]], base[near[-1]] + parts[near[-1]] - 1))
    plan = F.broadcast(distinct.sparkSession.createDataFrame(rows, "bucket int, base int, parts int, first int, last int"))
    tile = (F.col("base") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int").alias("tile")
    split = sized.join(plan, "bucket").select(tile, "first", "last", F.array("node", *names).alias("row"))
    tiles = table(split.groupBy("tile", "first", "last").agg(F.flatten(F.sort_array(F.collect_list("row"))).alias("rows")), "simhash-tiles")
    dealt = tiles.select("tile", "rows", F.explode(F.sequence("first", "last")).alias("other"))
    dealt = dealt.select(F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), F.struct("tile", "rows").alias("side"))
    pairs = dealt.groupBy("low", "high").agg(F.sort_array(F.collect_list("side")).alias("sides"))
    pairs = pairs.where((F.col("low") == F.col("high")) | (F.size("sides") == 2))
    pairs = pairs.select(F.element_at("sides", 1)["rows"].alias("a"), F.element_at("sides", -1)["rows"].alias("b"), (F.col("low") == F.col("high")).alias("same"))
    return pairs.mapInArrow(_compared(words, radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, words: int = 1, radius: int = RADIUS) -> DataFrame:
    """doc_id, the fingerprint's words, and component_id: the least doc_id reachable over links of at most ``radius`` bits."""
    own = table(fingerprints(docs, shingle, words), "simhash")
    distinct = table(own.groupBy("node", *_names(words)).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")), "simhash-distinct")
    linked = components(links(distinct, words, radius))
    named = linked.join(distinct.select("node", "first_id"), "node")
    least = named.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    group = distinct.select("node", "first_id", "n_rows").join(named.join(least, "root").select("node", "linked_id"), "node", "left")
    group = table(group.select("node", "n_rows", F.coalesce("linked_id", "first_id").alias("component_id")), "simhash-groups")
    return join_skewed(own, group, "node", "n_rows").select("doc_id", *_names(words), "component_id")


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The distinct XXH64 of the text's shingles, ascending."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = (ends - [len(w) for w in tokens]).astype(int).tolist()
    last = ends[min(shingle, len(tokens)) - 1 :].astype(int).tolist() if tokens else []
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[s:e], SEED) for s, e in zip(starts, last)]), dtype=">u8").astype(np.uint64))


def _set_prints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, text_key, the shingle set's node and size, and its fingerprint's words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, sizes, fps = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, shingle)
                counts = np.zeros(64 * words, dtype=np.int64)
                for at in range(0, len(own), 1 << 14):
                    bits = np.unpackbits(_mixed(own[at : at + (1 << 14)], words).astype(">u8").view(np.uint8)).reshape(-1, 64 * words)
                    counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(np.packbits(counts * 2 > len(own)).view(">u8"))
            fps = np.array(fps, dtype=np.uint64).reshape(-1, words).view(np.int64)
            columns = [pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *(pa.array(fps[:, i]) for i in range(words))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], names=["doc_id", "text_key", "node", "size", *_names(words)])

    schema = ", ".join(["doc_id long, text_key long, node long, size long", *(f"{n} long" for n in _names(words))])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(hashed, schema)


def _sets_of(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """``members`` (doc_id, text_key, ...) with their shingle sets, once for all rows of equal id and text.  A bitmap of fixed size spares most other texts the join."""
    place = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(PLACES))
    one = F.expr("shiftleft(1L, cast(place % 64 AS int))")
    found = members.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    bitmap = np.zeros(PLACES // 64, dtype=np.int64)
    bitmap[[r.word for r in found]] = [r.bits for r in found]

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            own = batch.filter(pa.array((bitmap[at >> 6] >> (at & 63) & 1).astype(bool)))
            sets = [shingle_set(t, shingle).tobytes() for t in own.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_key"), pa.array(sets, pa.binary())], names=["own_id", "own_key", "shingles"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").select("doc_id", "text_key", place.alias("place"), "text")
    pulled = keyed.mapInArrow(pull, "own_id long, own_key long, shingles binary").dropDuplicates(["own_id", "own_key"])
    return pulled.join(members, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")))


def _set_forest(nodes: list[int], sets: list[np.ndarray], parts: np.ndarray, across: bool, share: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets that share at least ``share`` of their union, or only those of two parts."""
    num, den = share
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tree = np.arange(len(sets))
    out = []
    for i, own in enumerate(sets):
        at = i + 1 + np.flatnonzero(tree[i + 1 :] != tree[i])
        at = at[(sizes[at] * den >= sizes[i] * num) & (sizes[i] * den >= sizes[at] * num)]
        if across:
            at = at[parts[at] != parts[i]]
        if not len(at):
            continue
        others = np.concatenate([sets[j] for j in at])
        hits = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
        both = np.add.reduceat(hits, np.cumsum(sizes[at]) - sizes[at], dtype=np.int64)
        for j in at[both * den >= (sizes[i] + sizes[at] - both) * num].tolist():
            if tree[j] != tree[i]:
                tree[tree == tree[j]] = tree[i]
                out.append((nodes[i], nodes[j]))
    return out


def set_links(docs: DataFrame, distinct: DataFrame, shingle: int, words: int, radius: int, share: tuple[int, int]) -> DataFrame:
    """(a, b): links that connect every two candidates of ``distinct`` whose shingle sets share at least ``share`` of their union."""
    num, den = share
    large = distinct.where(F.col("size") * (den - num) >= num)
    members = components(links(large, words, radius, share)).join(distinct.select("node", "size", "any.doc_id", "any.text_key"), "node")
    members = table(members, "simhash-candidates")
    parts = members.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("parts"))
    members = members.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = table(members, "simhash-members")
    item = F.struct("node", "part", "shingles")
    blocks = _sets_of(docs, members, shingle).groupBy("root", "part", "parts").agg(F.collect_list(item).alias("rows"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "rows")
    pairs = dealt.groupBy("root", "low", "high").agg(F.flatten(F.collect_list("rows")).alias("rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows = batch.column("rows")[at].values
                sets = [np.frombuffer(s, dtype=np.uint64) for s in rows.field("shingles").to_pylist()]
                found = _set_forest(rows.field("node").to_pylist(), sets, rows.field("part").to_numpy(), batch.column("across")[at].as_py(), share)
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return pairs.select((F.col("low") != F.col("high")).alias("across"), "rows").mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, shingle: int = NEAR_SHINGLE, words: int = NEAR_WORDS, radius: int = NEAR_RADIUS, share: tuple[int, int] = NEAR_SHARE) -> DataFrame:
    """``docs`` with one row of each component of near copies: a row of its least id.  Rows without an id stay."""
    own = table(_set_prints(docs, shingle, words), "simhash")
    row = F.struct("doc_id", "text_key")
    named = F.min(F.when(F.col("doc_id").isNotNull(), row)).alias("first")
    distinct = table(own.groupBy("node", "size", *_names(words)).agg(F.min(row).alias("any"), named), "simhash-distinct")
    linked = components(set_links(docs, distinct, shingle, words, radius, share))
    least = distinct.select("node", "first").join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = least.where("first IS NOT NULL").select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    # Rows may share an id and differ in text, so the text's key belongs to the name of what is kept.  The row travels as one value:
    # no column of it can clash with what is joined.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.struct("*").alias("row")).where("doc_id IS NOT NULL")
    kept_rows = keyed.join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi")
    first = kept_rows.dropDuplicates(["doc_id", "text_key"]).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
    return first.unionByName(docs.where(F.col("doc_id").isNull()))
