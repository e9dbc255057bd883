"""Ranked search, pieces and vector codes against brute force and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import codes, lexical, pieces
from tallymark.llm.queries import PIECES, tokenizer_path

TERM = re.compile(lexical.TERM)
DOCS = "doc_id long, text string, term string, places long"


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, best=50):
    """The contract's formula, document by document."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms_of(text)) if bag[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:best])]
    return out


def made_docs(rng, n):
    words = ["alpha", "BETA", "gamma'x", "δέλτα", "Éa", "x1", "naïve", "日本 語", "a_b", "the", "tail\x00end", "😀"]
    docs = [(i, " ".join(rng.choices(words, weights=[9, 5, 3, 2, 2, 1, 1, 1, 1, 20, 1, 1], k=rng.randrange(1, 40)))) for i in range(n)]
    docs += [(None, "alpha beta the"), (3, docs[3][1]), (3, docs[3][1]), (901, None), (902, ""), (903, " .,; "), (904, "the " * 3000 + "alpha")]
    return docs


@pytest.mark.parametrize("window,most,block", [(2048, 32 << 20, 50_000), (7, 32 << 20, 3), (64, 300, 1)])
def test_search_against_every_document(spark, window, most, block):
    rng = random.Random(4)
    docs = made_docs(rng, 300)
    items = [(1, "Alpha beta beta"), (1, "Alpha beta beta"), (1, "the"), (2, "unheard of"), (3, None), (4, ""), (None, "x1 δέλτα éa ÉA 語"), (5, "the alpha beta gamma x a b tail end 😀")]
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], DOCS).repartition(3)
    found = lexical.search(lexical.index(rows, window, most), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, term int"), block_terms=block)
    want = ranked(docs, [x for x in items if x[1]])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a word")], "item_id long, text string")
    assert lexical.search(lexical.index(docs), items).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert lexical.search(lexical.index(blank), items).count() == 0
    some = spark.createDataFrame([(1, "a word")], "doc_id long, text string")
    assert lexical.search(lexical.index(some), items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(lexical.index(some), items).collect()] == [(1, 1, 1)]


def test_search_of_one_repeated_document(spark):
    rows = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same words here").alias("text"))
    more = spark.createDataFrame([(i, "other text") for i in range(40)], "doc_id long, text string")
    found = lexical.search(lexical.index(rows.unionByName(more)), spark.createDataFrame([(1, "other words")], "item_id long, text string")).collect()
    assert [r.doc_id for r in found] == [*range(40), *[5] * 10] and [r["rank"] for r in found] == list(range(1, 51))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


TEXTS = [None, "", " ", "a", "  two  spaces ", "▁ the symbol ▁▁", "line\nline\r\n\ttab", "<s></s><unk><0x41>", "क़ 하 😀 日本語", "\x00\x01é", "e.g. U.S.A. (x)==[]{};", *[" " * n + "x" for n in range(40)], *[" " * n for n in range(1, 40)], "word" * 3000, "é" * 5000, "0123456789" * 700]


def test_pieces_as_the_library(spark, library):
    rng = random.Random(2)
    bits = [" ", "  ", "▁", "\n", "a", "the", "ing", "tion", "é", "하", "😀", "0", "==", "....", "</s>", "本語"]
    made = ["".join(rng.choice(bits) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts = TEXTS + made
    docs = spark.createDataFrame([(i if i % 7 else None, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    rows = pieces.round_trip(docs.repartition(2), tokenizer_path(PIECES)).collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        want.append((i if i % 7 else None, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert pieces.round_trip(docs.limit(0), tokenizer_path(PIECES)).count() == 0


def test_pieces_through_tables(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    coded = pieces.encode(docs, tokenizer_path(PIECES))
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: library.encode(t or "", add_eos=True) for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in pieces.decode(coded, tokenizer_path(PIECES)).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, pieces.pieces(tokenizer_path(PIECES)).ids["▁"]])], "doc_id long, ids array<int>")
    assert {r.text for r in pieces.decode(odd, tokenizer_path(PIECES)).collect()} == {""}


def test_decoding_of_any_ids(library):
    own, rng = pieces.pieces(tokenizer_path(PIECES)), random.Random(5)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), 28705, 259]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_backtracking_takes_back():
    """Where the longest piece leads nowhere the search comes back to shorter ones, and no place fails twice."""
    own = pieces.pieces(tokenizer_path(PIECES))
    rng = random.Random(8)
    longest_first = 0
    for _ in range(3000):
        word = "".join(rng.choices("aeinorst", k=rng.randrange(2, 14)))
        found = own.backtrack(word)
        assert found == own.merge(word)
        longest_first += max((n for n in range(1, len(word) + 1) if word[:n] in own.made), default=0) != len(found[0])
    assert longest_first > 20


def coded(rows, parts=16, entries=64, rounds=2):
    """The contract, vector by vector in whole numbers."""
    rows = [(i, label, [math.floor(256 * float(np.float32(c))) for c in x]) for i, label, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    width = -(-max(len(x) for *_, x in rows) // parts) * parts
    rows = [(i, label, x + [0] * (width - len(x))) for i, label, x in rows]
    step = width // parts
    least = {}
    for i, _, x in rows:
        if i is not None:
            least[i] = min(least.get(i, x), x)
    books = [[least[i][p * step : (p + 1) * step] for i in sorted(least)[:entries]] for p in range(parts)]

    def near(x):
        out = []
        for p, book in enumerate(books):
            own = x[p * step : (p + 1) * step]
            out.append(min((sum((a - b) ** 2 for a, b in zip(own, e)), n) for n, e in enumerate(book)))
        return out

    for _ in range(rounds):
        found = [near(x) for *_, x in rows]
        for p, book in enumerate(books):
            for n in range(len(book)):
                own = [x[p * step : (p + 1) * step] for (*_, x), f in zip(rows, found) if f[p][1] == n]
                if own:
                    book[n] = [sum(c) // len(own) for c in zip(*own)]
    found = [near(x) for *_, x in rows]
    sums = Counter()
    for (_, label, _), f in zip(rows, found):
        sums[label] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f), sums[label], sha) for (i, label, _), f in zip(rows, found)]


VECTORS = "vec_id long, label int, embedding array<float>, code string"


def check_codes(spark, rows):
    found = codes.compress(spark.createDataFrame([(*r, "clash") for r in rows], VECTORS).repartition(3))
    assert sorted(map(tuple, found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == sorted(coded(rows), key=repr)


def test_codes_against_every_entry(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), None if i % 5 == 0 else int(i % 3), x.tolist()) for i, x in enumerate(rng.normal(size=(300, 32)))]
    rows += [(7, 1, rows[7][2]), (7, 1, rows[9][2]), (None, 2, rows[3][2]), (400, 1, None), (401, 1, [None] * 32), (402, 1, [math.nan] * 32), (403, 1, [math.inf] + [0.0] * 31), (404, 1, [0.0] * 32), (405, 1, [1e5] * 32), (406, 1, [1.0] * 20), (407, 1, [])]
    check_codes(spark, rows)


def test_codes_with_ties_and_few_entries(spark):
    rng = np.random.default_rng(4)
    grid = rng.integers(-1, 2, size=(200, 16)).astype(float) / 256
    check_codes(spark, [(i, 1, x.tolist()) for i, x in enumerate(grid)])
    check_codes(spark, [(i, None, [0.25] * 16) for i in range(100)])
    check_codes(spark, [(i, 1, rng.normal(size=17).tolist()) for i in range(3)])


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codes.compress(empty).count() == 0
    unnamed = spark.createDataFrame([(None, 1, [1.0] * 16, "")], VECTORS)
    assert [tuple(r)[:5] for r in codes.compress(unnamed).collect()] == [(None, 1, "", 0, 0)]


def test_nearest_of_a_tree():
    rng = np.random.default_rng(6)
    for width in (1, 2, 4):
        entries, points = rng.integers(-4, 5, (64, width)), rng.integers(-6, 7, (3000, width))
        at, apart = codes.Tree(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()
