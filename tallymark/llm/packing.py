"""Packing documents into fixed-length training sequences.

Method: Karmarkar-Karp multiway differencing.  Every whole window a document
fills by itself becomes a sequence of its own; what is left of the documents is
dealt into groups of a bounded number of pieces, and inside a group the pieces
are partitioned into ``k`` windows by repeatedly merging the two partial
partitions with the largest imbalance, the heaviest window of one on the
lightest window of the other.  ``k`` starts at the least number of windows that
could hold the group and rises while any window exceeds the capacity.

Only piece descriptors (about 50 bytes each) are shuffled, never token ids.

Edge cases: a null or empty text is the end token alone; repeated rows are
packed once each; a null id packs like any other; an empty table gives an empty
result; columns beside the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 1000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each size: Karmarkar-Karp multiway differencing into k windows."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    heap: list[tuple[int, int]] = []
    for i, s in enumerate(sizes.tolist()):
        row = np.zeros(k, dtype=np.int64)
        row[0] = s
        sums[i] = row
        heap.append((-s, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        sums[node] = merged
        merges.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (int(merged[-1] - merged[0]), node))
        node += 1
    # Undo the merges from the last one: slot -> window of the final partition.
    slots = {node - 1: np.arange(k, dtype=np.int32)}
    out = np.zeros(n, dtype=np.int64)
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        own = np.empty(k, dtype=np.int32)
        own[order] = slots.pop(n + at)
        for child, labels in ((a, own), (b, own[::-1])):
            if child < n:
                out[child] = labels[0]
            else:
                slots[child] = labels
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none over ``capacity``: the window count rises until all fit."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        at = difference(sizes, k)
        if np.bincount(at, weights=sizes, minlength=1).max(initial=0) <= capacity:
            return at
        k += max(1, k // 200)


class Encoder:
    """Token ids of whole texts as little-endian bytes, with a bounded cache of white-space words.

    No token spans white space and the vocabulary's pre-tokenizer looks at no neighbour beyond it, so
    the ids of a text are those of its words.  Lower-case words of letters in composed form skip the normalizers
    (which would not change them) and are encoded many at a time: each ends at a word-end token.
    The cache is emptied when it holds too many words (``limit``; LIMIT where unset) or too many bytes of them.
    """

    LIMIT = 1_200_000
    BYTES = 256 << 20
    TRAIL = ".,!?;:"

    def __init__(self, path: str, limit: int | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.limit = self.LIMIT if limit is None else limit
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _letters(self, words: list[str]) -> None:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(cuts) != len(words):
            return self._any(words)
        raw, last = ids.tobytes(), 0
        for word, cut in zip(words, cuts):
            self.words[word] = raw[4 * last : 4 * cut]
            last = cut

    def _any(self, words: list[str]) -> None:
        for word, found in zip(words, self.whole.encode_batch_fast(words, add_special_tokens=False)):
            self.words[word] = np.array(found.ids, dtype="<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        stems = [word.rstrip(self.TRAIL) for word in missing]
        lows = [stem.lower() for stem in stems]
        known, split, whole = self.words, [], []
        # Composition joins nothing across a space, so mostly one look at all words together is enough.
        composed = unicodedata.is_normalized("NFC", " ".join(stems))
        for word, stem, low in zip(missing, stems, lows):
            if stem.isalpha() and (low == stem or stem.isascii()) and (composed or unicodedata.is_normalized("NFC", stem)):
                split.append((word, low, word[len(stem) :]))
            else:
                whole.append(word)
        if need := [low for low in {low for _, low, _ in split} if low not in known]:
            self._letters(need)
        if need := list({trail for _, _, trail in split if trail and trail not in known}.union(whole)):
            self._any(need)
        for word, low, trail in split:
            if trail:
                known[word] = known[low] + known[trail]
            elif word is not low:
                known[word] = known[low]

    def encode(self, texts: list[str]) -> list[memoryview]:
        if len(self.words) > self.limit or self.held > self.BYTES:
            self.forget()
        odd = {i for i, t in enumerate(texts) if not t.isprintable() and any(c in t for c in "\x1c\x1d\x1e\x1f")}
        split = [() if i in odd else t.split() for i, t in enumerate(texts)]
        cuts = np.cumsum([0, *map(len, split)])
        # Each distinct word of the batch is looked up once; the ids of all words are then gathered at once.
        words = [w for some in split for w in some]
        at = pa.array(words, pa.string()).dictionary_encode().indices.to_numpy()
        new = np.diff(np.maximum.accumulate(at), prepend=-1) > 0  # codes are given in the order of first appearance
        distinct = [words[i] for i in np.flatnonzero(new).tolist()]
        found = list(map(self.words.get, distinct))
        if None in found:
            missing = [w for w, x in zip(distinct, found) if x is None]
            self._learn(missing)
            self.held += 8 * sum(map(len, missing))
            found = list(map(self.words.get, distinct))
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        counts = sizes[at] if len(at) else np.empty(0, np.int64)
        ends = np.cumsum(counts)
        first = (np.cumsum(sizes) - sizes)[at] if len(at) else counts
        every = ids[np.repeat(first - (ends - counts), counts) + np.arange(int(counts.sum()))]
        stops = np.r_[0, ends][cuts].tolist()
        raw = memoryview(every.tobytes())
        out = [raw[4 * lo : 4 * hi] for lo, hi in zip(stops, stops[1:])]
        for i in odd:
            out[i] = memoryview(np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes())
        return out


_ENCODERS: dict[str, Encoder] = {}
SLICE = 4 << 20
# A worker that serves other stages too: a cached word takes some 400 bytes, a slice some 40 times its own.
FRUGAL_WORDS, FRUGAL_SLICE = 150_000, 1 << 20


def encoder(path: str, limit: int | None = None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].limit = Encoder.LIMIT if limit is None else limit
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text."""
    upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def cutter(tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, frugal: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its batches of (doc_id, text); a frugal one keeps a small cache and leaves none in its worker."""
    end = int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, FRUGAL_WORDS if frugal else None)
        seen: dict[int, int] = {}
        for batch in batches:
            for part in _slices(batch, FRUGAL_SLICE if frugal else SLICE):
                rows = []
                for i, (name, raw) in enumerate(zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()))):
                    total = len(raw) // 4 + 1
                    for at in range(0, 4 * total, step):
                        piece = raw[at : at + step]
                        crc = zlib.crc32(piece)
                        length = len(piece) // 4
                        if length < capacity and at + step >= 4 * total:
                            crc, length = zlib.crc32(end, crc), length + 1
                        # Equal rows are alike, so their order in the task does not matter for a repeated task.
                        same = hash((name, at, crc))
                        seen[same] = copy = seen.get(same, -1) + 1
                        rows.append((i, at // 4, length, crc, total, copy))
                at, *numbers = (pa.array(x, pa.int64()) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), *numbers], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"])
        if frugal:
            enc.forget()

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, frugal: bool = False) -> DataFrame:
    """Each document's ids cut at multiples of ``capacity``: one row per piece, and how many equal pieces its task cut before."""
    cut = cutter(tokenizer, capacity, end_id, frugal)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES + ", copy long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, frugal: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    tokenizer: path of a tokenizers file, readable on every executor.  Returns one row per piece with
    its place in its sequence.  ``group_pieces`` bounds the pieces that are balanced at once: groups hold as many in the mean,
    and one that got more is parted.  A document leaves at most one piece to balance, so the group count follows from the row count.
    ``frugal`` gives the same rows in more time and with less memory in the Python workers, which later stages go on using.
    """
    groups = max(1, round(docs.count() / group_pieces))
    stride = 1 << 40

    def balance(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32")])
        sizes = rows.column("length").to_numpy()
        full = np.flatnonzero(sizes >= capacity)
        rest = np.flatnonzero(sizes < capacity)
        seq = np.zeros(len(sizes), dtype=np.int64)
        seq[full] = np.arange(len(full))
        used = len(full)
        shares = np.array_split(rest, max(1, round(len(rest) / group_pieces))) if len(rest) else []
        for share in shares:
            seq[share] = used + windows(sizes[share], capacity)
            used = int(seq[share].max()) + 1
        # Gapless offsets in each sequence, in the order of the rows.
        order = np.argsort(seq, kind="stable")
        run = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, seq[order][1:] != seq[order][:-1]]
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
        sequence = seq + key[0].as_py() * stride
        return rows.drop_columns(["pack_group", "copy"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    cut = pieces(docs, tokenizer, capacity, end_id, frugal)
    # Copies of a row are dealt to all groups.
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(groups))
    return cut.withColumn("pack_group", group).groupBy("pack_group").applyInArrow(balance, PACKED)
