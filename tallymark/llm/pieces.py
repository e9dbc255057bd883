"""SentencePiece encoding and decoding.

Method: exact merge-type encoding by backtracking.  The pieces that sentencepiece's merges give are the only sequence whose
neighbours are compatible: two pieces are compatible if merging their joint characters anew gives those two again (best
score first, then leftmost).  So a text is read from the left: an Aho-Corasick automaton over the reversed pieces gives the
longest piece at every place, the longest compatible one is taken, else the next shorter, else the last piece is taken
back; a bitfield remembers the places from which nothing leads on, so each place fails once at most.

A piece holds the space symbol in front only (checked when a model is loaded), so no piece lies across the end of a word and
words are encoded one by one, equal ones once; a character in no piece becomes its UTF-8 bytes and parts a word.  The words
and compatible pairs that a task keeps are bounded in bytes and number; longer words are encoded anew each time.

Models of the merge type with identity normalization, a dummy prefix and byte fallback are read; others are refused with a
clear error, never encoded wrongly.

Edge cases: a null or empty text is the end id alone and decodes to the empty text; a text that holds the space symbol itself
is encoded as the library does and decodes to a space; strings of special pieces in a text are ordinary text; bytes that are
no UTF-8 decode to one replacement character each; null and repeated ids and rows are encoded row by row; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CACHE_BYTES = 128 << 20
WORD_CHARS = 200
PAIRS = 1 << 20
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """A sentencepiece model of the merge type: its pieces, encoding and decoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        train, norm = model.trainer_spec, model.normalizer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only merge models with byte fallback, a dummy prefix and identity normalization are read")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError("a piece holds the space symbol behind other characters")
        self.bytes_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.end = self.names.index(train.eos_piece)
        self.decimals = list(map(str, range(len(self.names))))
        self.letters = {c for name in self.ids for c in name}
        # Pieces that merging their own characters gives; the others occur in no encoding.
        made = {name for name in self.ids if self.merge(name) == [name]}
        self.made = made
        self.automaton = ahocorasick.Automaton()
        for name in made:
            self.automaton.add_word(name[::-1], name)
        self.automaton.make_automaton()
        self.shorter = {name: next((name[:n] for n in range(len(name) - 1, 0, -1) if name[:n] in made), None) for name in made}
        # Runs of spaces go with the word behind them; these characters are in no piece and part words anyway.
        loose = "".join(c for c in "\n\t\r" if c not in self.letters)
        self.words = re.compile(f" *[^ {loose}]+| +|[{loose or ' '}]").findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0
        # Control pieces decode to nothing; here they are bytes of no text, so that sequences with one inside are read with care.
        self.raw = [b"\xff" if k == CONTROL else bytes([int(n[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(self.names, self.kinds)]

    def merge(self, text: str) -> list[str]:
        """The symbols of a short text after all merges: the pair of the best score first, of equal ones the leftmost."""
        symbols, scores = list(text), self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether merging the characters of two pieces gives the two again."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[pair] = found = self.merge(pair[0] + pair[1]) == list(pair)
        return found

    def backtrack(self, run: str) -> list[str]:
        """The pieces of a run of characters that pieces hold."""
        if run in self.made:
            return [run]
        n, shorter, pairs = len(run), self.shorter, self.pairs
        # Of the reversed pieces that end at one place the automaton gives the longest first; turned round, it is the last to be kept.
        longest = dict(list(self.automaton.iter(run[::-1]))[::-1])
        out, last, at, failed = [], None, 0, bytearray((n >> 3) + 1)
        token = longest[n - 1]
        while True:
            end = at + len(token)
            if not failed[end >> 3] & (1 << (end & 7)):
                pair = (last, token)
                fits = last is None or pairs.get(pair)
                if fits is None:
                    fits = self.compatible(pair)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    last, at, token = token, end, longest[n - 1 - end]
                    continue
            token = shorter[token]
            while not token:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                token, last = shorter[last], out[-1] if out else None

    def _word(self, key: str) -> bytes:
        """The ids of a word as 32-bit numbers."""
        ids: list[int] = []
        word = key.replace(" ", SPACE)
        n = len(word)
        if self.letters.issuperset(word):
            ids = [self.ids[x] for x in self.backtrack(word)]
        else:
            for held, run in groupby(word, self.letters.__contains__):
                if held:
                    ids += map(self.ids.__getitem__, self.backtrack("".join(run)))
                else:
                    ids += map(self.bytes_ids.__getitem__, "".join(run).encode())
        found = array("i", ids).tobytes()
        if n <= WORD_CHARS:
            cost = 200 + 5 * n
            if self.held + cost > CACHE_BYTES:
                self.known, self.held = {}, 0
            self.known[key] = found
            self.held += cost
        return found

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without an end id."""
        if not text:
            return []
        # The space symbol and a space are one to the model.
        words = self.words(" " + text.replace(SPACE, " "))
        try:
            found = b"".join(map(self.known.__getitem__, words))
        except KeyError:
            found = b"".join([self.known.get(w) or self._word(w) for w in words])
        return memoryview(found).cast("i").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, as the library gives it."""
        ids = list(ids)
        while ids and self.kinds[ids[-1]] == CONTROL:
            ids.pop()
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = self._decode_odd(ids)
        return text[1:] if first is not None and self.kinds[first] == NORMAL and text.startswith(" ") else text

    def _decode_odd(self, ids: list[int]) -> str:
        """Bytes are read as UTF-8 in each run of byte pieces; one that fits in no character is replaced by itself."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                run += self.raw[i]
                continue
            at = 0
            while at < len(run):
                size = next((k for k in (1, 2, 3, 4) if _is_char(run[at : at + k])), 0)
                out.append(run[at : at + size].decode() if size else "�")
                at += size or 1
            run = bytearray()
            if i >= 0 and self.kinds[i] != CONTROL:
                out.append(self.raw[i].decode())
        return "".join(out)


def _is_char(raw: bytes) -> bool:
    try:
        return len(bytes(raw).decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids, with the end id, of every row of ``docs`` (doc_id, text); model: path of a model that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for part in _slices(batch):
                ids = [[*own.encode(t), own.end] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of ``coded`` (doc_id, ids); null ids and null lists decode like absent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            texts = [own.decode(i for i in ids or () if i is not None) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """The number and digest of every document's ids and the digest of the text they decode to, with neither leaving its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for part in _slices(batch):
                counts, coded, decoded = [], [], []
                for text in part.column("text").to_pylist():
                    ids = [*own.encode(text), own.end]
                    counts.append(len(ids))
                    coded.append(hashlib.sha256(" ".join(map(own.decimals.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, ENCODED)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
