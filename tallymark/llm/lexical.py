"""Ranked lexical search.

Method: windowed bucket scoring.  Every task that reads documents is a segment of the index; it cuts its documents into
windows of ``WINDOW`` consecutive places (fewer where texts are long) and writes, for each term of a window, one posting list of
places and counts.  A search takes the items in blocks of bounded size.  Of each window a task turns the posting lists of a block's
terms into integer gains once, adds the lists of one item into an array of one number per place, which fits in the first
cache, notes the places hit in a bitset, harvests only those into a heap of the item's best documents, and clears them.
Heaps live as long as the task; at the end of a block the tasks' heaps are merged.

The index is written once (places and counts, no text) and serves any number of searches.  Only posting lists of the items'
terms are shuffled, by window, so a frequent term is spread over all windows; no list, document or item is cut.

Scores are whole numbers throughout; only a term's weight takes a logarithm, in doubles.

Edge cases: a null text has no term, like an empty one, and neither counts as a document; a null item text or one without a term
finds nothing; rows of equal item_id and text are one item, other texts of that id are items of their own under it; repeated
documents are ranked one by one; among equal scores a null doc_id comes last; empty tables give an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .scratch import table

WINDOW = 2048
WINDOW_BYTES = 32 << 20
BLOCK_TERMS = 50_000
TASK_WINDOWS = 8
BEST = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POSTINGS = "segment int, window int, term string, held long, terms long, places binary, counts binary, ids array<long>, sizes array<long>"
_NAMES = [c.split()[0] for c in POSTINGS.split(", ")]
# Letters A-Z lowered, all other ASCII but letters and digits made spaces, the rest as it is: terms are then what spaces part.
_CLEAN = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in range(256)], dtype=np.uint8)
_CLEAN[65:91] += 32


def _window(segment: int, window: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The posting lists of some documents, and in front a row without a term that holds their ids and sizes."""
    n = len(texts)
    lo, hi = np.frombuffer(texts.buffers()[1], np.int64)[[texts.offset, texts.offset + n]] if n else (0, 0)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] - lo
    raw = _CLEAN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[lo:hi]]
    clean = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
    split = pc.ascii_split_whitespace(clean)
    words = split.flatten()
    real = pc.not_equal(words, "")
    place = np.repeat(np.arange(n, dtype=np.int64), pc.list_value_length(split).to_numpy(zero_copy_only=False))[real.to_numpy(zero_copy_only=False)]
    coded = words.filter(real).dictionary_encode()
    keys, counts = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + place, return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(coded.dictionary) + 1, dtype=np.int64) * n)

    def binary(values: np.ndarray) -> pa.Array:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts * values.itemsize), pa.py_buffer(values)]).cast(pa.binary())

    sizes = np.bincount(place, minlength=n)
    rows = len(starts) - 1
    header = [pa.array([x], t) for x, t in ((segment, pa.int32()), (window, pa.int32()), (None, pa.string()), (int((sizes > 0).sum()), pa.int64()), (int(sizes.sum()), pa.int64()), (None, pa.binary()), (None, pa.binary()), (ids.to_pylist(), pa.list_(pa.int64())), (sizes.tolist(), pa.list_(pa.int64())))]
    lists = [pa.array(np.full(rows, segment, np.int32)), pa.array(np.full(rows, window, np.int32)), coded.dictionary.cast(pa.string()), pa.array(np.diff(starts)), pa.nulls(rows, pa.int64()), binary((keys % max(n, 1)).astype("<u2")), binary(counts.astype("<u4")), pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(header, lists)], names=_NAMES)


def index(docs: DataFrame, window: int = WINDOW, most: int = WINDOW_BYTES) -> DataFrame:
    """The posting lists of ``docs`` (doc_id, text), by segment and window, as a table in the shared folder.

    A window ends after ``window`` documents (at most 65,536) or ``most`` bytes of text, one document at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, at = TaskContext.get().partitionId(), 0
        ids, texts, rows, size = [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal ids, texts, rows, size, at
            made = _window(segment, at, pa.concat_arrays(ids), pa.concat_arrays(texts))
            ids, texts, rows, size, at = [], [], 0, 0, at + 1
            return made

        for batch in batches:
            some, own = batch.column("text").cast(pa.large_string()), batch.column("doc_id")
            ends = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = min(int(np.searchsorted(ends, before + most - size, side="right")), lo + window - rows, batch.num_rows)
                if hi <= lo and rows:
                    yield close()
                    continue
                hi = max(hi, lo + 1)
                ids.append(own.slice(lo, hi - lo))
                texts.append(some.slice(lo, hi - lo))
                rows, size, lo = rows + hi - lo, size + int(ends[hi - 1] - before), hi
                if rows >= window:
                    yield close()
        if rows:
            yield close()

    if not 0 < window <= 1 << 16:
        raise ValueError("a window holds 1 to 65,536 documents")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return table(texts.mapInArrow(run, POSTINGS), "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and the distinct terms of each distinct item of ``items`` (item_id, text), one row per item with a term, numbered by ``item_key``."""
    low = F.translate("text", UPPER, LOWER)
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))
    distinct = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    return distinct.select("item_id", F.xxhash64("item_id", "text").alias("item_hash"), found.alias("terms")).where(F.size("terms") > 0)


class _Scorer:
    """The items of a block and their heaps; ``window`` scores one window of the index for all of them."""

    def __init__(self, items: list[np.ndarray], documents: int, words: int, best: int):
        self.items, self.documents, self.words, self.best = items, documents, words, best
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in items]

    def window(self, ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, lists: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """ids of the window's places, whether each is not null, the documents' sizes, and (number, weight, places, counts) of the terms."""
        mass = 50 + (50 * sizes * self.documents) // self.words
        gains, bits = {}, {}
        mark = np.zeros(-(-len(ids) // 64) * 64, dtype=bool)
        for number, weight, places, counts in lists:
            tf = counts.astype(np.int64)
            gains[number] = places, weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * mass[places]))
            mark[places] = True
            bits[number] = np.packbits(mark).view(np.uint64)
            mark[places] = False
        score = np.zeros(len(ids), dtype=np.int64)
        for heap, terms in zip(self.heaps, self.items):
            held = [t for t in terms if t in gains]
            if not held:
                continue
            occupied = bits[held[0]].copy()
            for t in held:
                places, gain = gains[t]
                score[places] += gain
                occupied |= bits[t]
            hit = np.flatnonzero(np.unpackbits(occupied.view(np.uint8), count=len(ids)))
            self._harvest(heap, score[hit], ids[hit], known[hit])
            score[hit] = 0

    def _harvest(self, heap: list, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        least = heap[0][0] if len(heap) >= self.best else 1
        good = np.flatnonzero(score >= least)
        if len(good) > self.best:
            good = good[np.lexsort((ids[good], ~known[good], -score[good]))[: self.best]]
        for s, k, i in zip(score[good].tolist(), known[good].tolist(), ids[good].tolist()):
            entry = (s, int(k), -i)  # a smaller id is the better one, a null one the worst
            if len(heap) < self.best:
                heappush(heap, entry)
            elif entry > heap[0]:
                heapreplace(heap, entry)


def _score(block: DataFrame, items: list[tuple[int | None, np.ndarray]], documents: int, words: int, best: int, tasks: int) -> DataFrame:
    """item, item_id, doc_id and score of the best documents that each task finds for the items of a block."""
    shared = block.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = _Scorer([terms for _, terms in own], documents, words, best)
        current, header, lists = None, None, []

        def close() -> None:
            if header is not None and lists:
                ids, sizes = header
                known = ~np.array(ids.is_null())
                scorer.window(ids.fill_null(0).to_numpy(zero_copy_only=False), known, sizes.to_numpy(zero_copy_only=False), lists)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("segment", "window"))))
            numbers, weights = batch.column("number").to_pylist(), batch.column("weight").to_pylist()
            places, counts = batch.column("places"), batch.column("counts")
            for i, key in enumerate(keys):
                if key != current:
                    close()
                    current, header, lists = key, None, []
                if numbers[i] is None:
                    header = batch.column("ids")[i].values, batch.column("sizes")[i].values
                else:
                    lists.append((numbers[i], weights[i], np.frombuffer(places[i].as_py(), "<u2"), np.frombuffer(counts[i].as_py(), "<u4")))
        close()
        rows = [(q, own[q][0], -i if known else None, s) for q, heap in enumerate(scorer.heaps) for s, known, i in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["item", "item_id", "doc_id", "score"])

    # A window's rows come together, the one with its ids first.
    dealt = block.repartition(tasks, "segment", "window").sortWithinPartitions("segment", "window", F.col("number").asc_nulls_first())
    return dealt.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def search(postings: DataFrame, items: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``best`` documents of each row of ``items`` (item_id, text).

    A block holds at most ``block_terms`` terms and one item more; it alone is sent to every executor.
    """
    spark = postings.sparkSession
    headers = postings.where("term IS NULL").agg(F.sum("held"), F.sum("terms"), F.count("*")).first()
    documents, words, windows = headers[0] or 0, headers[1] or 0, headers[2]
    wanted = table(item_terms(items), "item-terms")
    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    # Whether the terms are broadcast or shuffled is left to Spark, by their size.
    held = postings.where("term IS NOT NULL").select("term", "held").join(terms, "term").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = table(held.select("term", weight.alias("weight"), F.xxhash64("term").alias("number")), "term-weights")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-total // block_terms) or 1
    upto = Window.partitionBy("part").orderBy("item_hash", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = wanted.withColumn("part", F.pmod("item_hash", F.lit(parts))).withColumn("block", F.floor(F.coalesce(F.sum(F.size("terms")).over(upto), F.lit(0)) / block_terms))
    blocks = table(blocks, "item-blocks")
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), windows // TASK_WINDOWS))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    turn = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    for part, block in sorted(tuple(r) for r in blocks.select("part", "block").distinct().collect()):  # one row per block
        own = blocks.where((F.col("part") == part) & (F.col("block") == block))
        # Bounded by the block: the distinct terms that documents hold, and the items' lists of them.
        used = own.select(F.explode("terms").alias("term")).distinct().join(weighed, "term").orderBy("term").collect()
        number = {r.term: i for i, r in enumerate(used)}
        asked = [(r.item_id, np.array([number[t] for t in r.terms if t in number], dtype=np.int64)) for r in own.select("item_id", "terms").collect()]
        known = F.broadcast(spark.createDataFrame([(r.term, i, r.weight) for i, r in enumerate(used)], "term string, number int, weight long"))
        lists = postings.where("term IS NOT NULL").join(known, "term").select("segment", "window", "number", "weight", "places", "counts", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes"))
        heads = postings.where("term IS NULL").select("segment", "window", F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("weight"), "places", "counts", "ids", "sizes")
        found = _score(heads.unionByName(lists), asked, documents, max(words, 1), best, tasks)
        ranked = found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= best)
        out = out.unionByName(table(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out
