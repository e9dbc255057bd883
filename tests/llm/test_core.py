"""Small fixtures against brute force: packing, mixing, near-duplicates, secrets, archives."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymark.llm import mixing, packing, secrets, simhash, warc
from tallymark.llm.queries import tokenizer_path
from tallymark.llm.scratch import shared_path

DOCS = "doc_id long, text string, source string, lang string, n_chars long, fp0 string, node long"
TEXTS = [None, "", " \t\n", "one", "Two Words", "the same text as ever it was here", "the same text as ever it was here", "The SAME text as ever it was here", "İstanbul Σας été naïve ß", "a b c d e f g h " * 900, "tab\tsep\x0bvt\x0cff\rcr", "x\x1cy it's we'll 42 <|endoftext|>"]


def table(spark, texts=TEXTS):
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", None, None, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "an unnamed row", "s1", "en", 3, None, None), rows[6]], DOCS)


def test_pack_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(table(spark), tokenizer_path(), capacity=512).collect()
    texts = [t or "" for t in TEXTS] + ["an unnamed row", TEXTS[6]]
    want = sorted(np.array([*whole.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for t in texts)
    assert sum(r.length for r in rows) == sum(map(len, want)) // 4
    for i, text in enumerate(TEXTS):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        own = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i})
        assert [o[0] for o in own] == list(range(0, len(ids) // 4, 512))
        assert all(o[2] == zlib.crc32(ids[4 * o[0] : 4 * (o[0] + o[1])]) and o[3] == len(ids) // 4 for o in own)
    for seq in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512


def test_letters_that_composition_changes():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    letters = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and not unicodedata.is_normalized("NFC", chr(c))]
    assert len(letters) > 1000
    texts = letters + [unicodedata.normalize("NFD", w) for w in ("하늘", "été", "naïve!", "Ünder,")] + ["".join(letters[i : i + 3]) + "." for i in range(0, len(letters), 50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing.Encoder, "BYTES", 50_000)
    own = packing.Encoder(tokenizer_path())
    for i in range(40):
        own.encode([" ".join(f"{i}x{j}" + "y" * 500 for j in range(10))])
        assert own.held < 150_000 and len(own.words) <= 80


def test_frugal_packing_leaves_no_cache_in_the_worker(monkeypatch):
    monkeypatch.setattr(packing, "FRUGAL_WORDS", 300)
    monkeypatch.setattr(packing, "FRUGAL_SLICE", 2000)
    texts = [" ".join(f"word{i}x{j}, the" for j in range(50)) for i in range(100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 25), pa.int64()), pa.array(texts[lo : lo + 25])], names=["doc_id", "text"]) for lo in range(0, 100, 25)]
    held, enc = [], packing.encoder(tokenizer_path())
    encode = packing.Encoder.encode
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, some: (encode(self, some), held.append(len(self.words)))[0])
    want = pa.Table.from_batches(packing.cutter(tokenizer_path(), 64)(iter(batches))).to_pydict()
    assert max(held) > 5000 and len(enc.words) == held[-1]
    held.clear()
    assert pa.Table.from_batches(packing.cutter(tokenizer_path(), 64, frugal=True)(iter(batches))).to_pydict() == want
    assert len(held) > 20 and max(held) < 1500 and enc.words == {}


def test_pack_many_equal_rows(spark):
    docs = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same few words again " * 20).alias("text"), F.lit(1).alias("copy"))
    rows = packing.pack(docs.unionByName(docs.limit(0)), tokenizer_path(), group_pieces=500)
    loads = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.count_distinct("offset").alias("k"), F.count("*").alias("c"))
    got = loads.agg(F.sum("c"), F.max("n"), F.min(F.expr("n = stop AND k = c")), F.avg("n")).first()
    assert got[0] == 50_000 and got[1] <= 4096 and got[2] and got[3] > 0.9 * 4096
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 4000, 1500)
    at = packing.windows(sizes, 4096)
    loads = np.bincount(at, weights=sizes)
    assert loads.max() <= 4096 and loads.sum() == sizes.sum()
    assert loads.mean() > 0.96 * 4096
    assert packing.windows(np.array([], dtype=np.int64), 4096).tolist() == []
    assert packing.windows(np.full(7, 4096), 4096).max() == 6


def test_mix_meets_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 17), "abc"[min(i % 9, 2)] if i % 11 else None) for i in range(500)] + [(None, None, "a")], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source_size, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    goals = {k: v[0].target for k, v in sizes.items()}
    assert abs(sum(goals.values()) - total) < 1e-6
    for k, v in sizes.items():
        assert abs(sum(r.taken for r in v) - goals[k]) <= 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def brute_simhash(text, shingle, bits=64):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(bits) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [2, 9])
def test_simhash_components(spark, radius):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 40)) for _ in range(20)]
    texts = TEXTS[:8] + base + [b.replace(" w1", " W1", 1) + " tail" for b in base] + [b + " tail more" for b in base[:5]]
    rows = simhash.near_duplicates(table(spark, texts), radius=radius).where("doc_id IS NOT NULL").distinct().collect()
    prints = {i: brute_simhash(t, 3) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp0 & (2**64 - 1) for r in rows} == prints
    parent = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= radius and parent[j] > parent[i]:
                    parent[j] = parent[i]
                    changed = True
    assert {r.doc_id: r.component_id for r in rows} == parent


def test_wide_simhash_parts_copies(spark):
    rng = np.random.default_rng(2)
    words = [[f"w{x}" for x in rng.integers(0, 3000, 300)] for _ in range(30)]
    texts = [" ".join(w) for w in words]
    near = [" ".join(w[:150] + ["changed"] + w[151:]) for w in words]
    kept = {r.doc_id for r in simhash.keep_one(table(spark, texts + near)).collect()}
    assert kept == {*range(30), None}


def test_sets_of_repeated_rows_are_joined_once(spark):
    texts = ["one two three four five six seven eight", "one two three four five six seven nine", "quite another text with other words in it"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 500, "doc_id long, text string")
    members = docs.distinct().select("doc_id", F.xxhash64("text").alias("text_key"), F.col("doc_id").alias("node"))
    assert simhash._sets_of(docs, members, 5).count() == 3


def test_near_copies_are_decided_by_shingle_sets(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(simhash, "BLOCK", 2000)
    texts, kept = [], set()
    for case in range(60):
        # A head of fresh words put before n five-word shingles: n of n + extra are shared.
        n = int(rng.integers(8, 400))
        extra = n // 4 if case % 2 else n // 4 + 1
        base = [f"c{case}w{x}" for x in range(n + 4)]
        kept.add(len(texts))
        if not case % 2:
            kept.add(len(texts) + 1)
        texts += [" ".join(base), " ".join([f"c{case}h{x}" for x in range(extra)] + base)]
    # One group of many blocks, and texts that say the same line again and again.
    base = [f"g{x}" for x in range(100)]
    kept.add(len(texts))
    texts += [" ".join(base[:i] + [f"new{i}"] + base[i:]) for i in range(8, 90)]
    kept.add(len(texts))
    texts += ["a line that is said again and again", " ".join(["a line that is said again and again"] * 2), " ".join(["a line that is said again and again"] * 40)]
    texts.append(texts[-1] + " a line")
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "one more text under an id that is in use"), (0, texts[0])]
    assert simhash.shingle_set(None).size == 0
    found = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    sets = {t: set(simhash.shingle_set(t).tolist()) for _, t in rows}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = {r: r for r in rows}
    for _ in rows:
        before = dict(root)
        for a in rows:
            root[a] = min(root[b] for b in rows if alike(a[1], b[1]))
        if before == root:
            break
    assert sorted(found) == sorted(set(root.values()))
    assert {i for i, _ in found} >= {i for i in kept if i < 120} and (0, rows[-2][1]) in found


RULE = {"assign": (secrets.RULES[0].pattern.removeprefix("(?i)"), re.I | re.A, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 0, 20), "hex": (r"[0-9a-f]+", 0, 0, 24)}
SECRET_TEXTS = [None, "", "é token = abcdef12 and PASSWORD:'x' secret=token:abcdefgh", "AKIA" + "A1" * 9 + " AKIAAKIA short", "🙂 " + "0af" * 9 + " beef", "api_key=deadbeefdeadbeefdeadbeef01 apikey: short", "key token==a", "passwd : \"q1w2e3r4\"" * 40]


def brute_secrets(text):
    out = []
    for k, (kind, (pattern, flags, group, least)) in enumerate(RULE.items()):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return ",".join(f"{list(RULE)[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secret_places(spark):
    docs = table(spark, SECRET_TEXTS)
    rows = secrets.scan_documents(docs).collect()
    assert len(rows) == len(SECRET_TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            assert ",".join(s.label for s in r.spans) == brute_secrets(SECRET_TEXTS[r.doc_id])
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[3].text == "[SECRET] AKIAAKIA short" and clean[0].text is None
    assert clean[2].text == "é [SECRET] and PASSWORD:'x' secret=token:abcdefgh"
    assert all(brute_secrets(r.text) == "" for r in clean.values())


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([("a", "token=abcdefgh"), ("b", "token=abcdefgh"), ("c", "nothing")], "path string, text string")
    ledger = secrets.Ledger(spark)
    assert secrets.unseen(first, ledger).count() == 2
    found = secrets.findings(first, "path", ledger).collect()
    assert sorted((r.path, r.kind, r.start, r.end) for r in found) == [("a", "assign", 0, 14), ("b", "assign", 0, 14)]
    rows = ledger.read(secrets.RULES).count()
    # A second run scans nothing and finds the same.
    assert secrets.unseen(first, ledger).count() == 0
    assert sorted(secrets.findings(first, "path", ledger).collect()) == sorted(found) and ledger.read(secrets.RULES).count() == rows
    # A further version of a path is one blob more; a new version of one rule is due for every blob, alone.
    second = first.unionByName(spark.createDataFrame([("a", "secret=12345678"), ("e", "nothing")], "path string, text string"))
    assert [r.blob for r in secrets.unseen(second, ledger).collect()] == [hashlib.sha256(b"secret=12345678").hexdigest()]
    assert sorted(r.path for r in secrets.findings(second, "path", ledger).collect()) == ["a", "a", "b"]
    newer = (secrets.Rule("assign", secrets.RULES[0].pattern, 2, 9, version=2), *secrets.RULES[1:])
    due = secrets.unseen(second, ledger, newer)
    assert due.count() == 3 and {(r.kind, r.version) for r in secrets.scan(due, newer).collect()} == {("assign", 2)}
    assert secrets.findings(second, "path", ledger, newer).count() == 0


def test_redact_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x token=abcdefgh y", "s", "b", 7, 18), (1, None, "s", "b", 7, None), (None, "plain", None, "b", 7, 5)], "doc_id long, text string, spans_ string, blob string, spans int, n_chars long")
    rows = sorted(secrets.redact(docs).collect(), key=str)
    assert rows[0].asDict() == {"doc_id": 1, "text": "x [SECRET] y", "spans_": "s", "blob": "b", "spans": 7, "n_chars": 12}
    assert (rows[1].text, rows[1].n_chars, rows[2].text, rows[2].n_chars) == (None, None, "plain", 5)
    assert secrets.redact(docs.limit(0)).count() == 0 and secrets.scan_documents(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000 + "AKIA" + "B" * 20)], "doc_id long, text string")
    assert [s.label for s in secrets.scan_documents(long).first().spans] == ["access:2000000:2000024"]


PAGES = [(1, "http://a", "x" * 1200), (2, "http://b\r\nc", "x" * 1200), (3, None, "short"), (4, "http://d", "short"), (5, "u", None), (None, "n", "é\r\n\r\nWARC/1.1\r\n" * 90), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 90)]


def test_warc_round_trip(spark):
    path = shared_path(spark, "warc-test")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    rows = {r.page_id: r for r in warc.read(spark, path, "bytes").collect()}
    assert len(rows) == len(PAGES)
    for page, _, html in PAGES:
        body = (html or "").encode()
        assert (rows[page].payload_bytes, rows[page].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        revisit = page in (1, None)
        assert rows[page].record_type == ("revisit" if revisit else "response")
        assert rows[page].refers_to == ({1: 2, None: 7}[page] if revisit else None)
        assert rows[page].payload == (None if revisit else body)
    some = warc.read(spark, path).where((F.col("record_type") == "revisit") & (F.col("payload_bytes") > 1000))
    assert {r.page_id for r in some.collect()} == {1, None}
    empty = shared_path(spark, "warc-empty")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_hot_and_repeated_rows(spark):
    rows = [(i, "u", "hot payload " * 100) for i in range(3000)] + [(9, "u", "y" * 2000), (9, "v", "y" * 2000)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, key string, n int")
    path = shared_path(spark, "warc-hot")
    warc.write(pages, path)
    back = warc.read(spark, path)
    assert back.count() == len(rows) and back.where("refers_to = 2999 AND record_type = 'revisit'").count() == 2999
    assert back.where("page_id = 9 AND record_type = 'response'").count() == 2


def test_clashing_columns_survive(spark):
    names = "doc_id long, text string, source string, times int, kept_id int, text_key int, row string, n_rows int, name string, size int, node int, taken int"
    docs = spark.createDataFrame([(i, f"some words of row {i // 2} " * 5, "s", 1, 2, 3, "r", 4, "n", 5, 6, 7) for i in range(6)] + [(None, None, None, 1, 2, 3, "r", 4, "n", 5, 6, 7)], names)
    for out in (mixing.resample(docs), simhash.keep_one(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and {(r.times, r.row, r.taken) for r in rows} == {(1, "r", 7)}
    assert {r.doc_id for r in rows} == {0, 2, 4, None}
    assert mixing.mix(docs).count() == 7 and simhash.near_duplicates(docs).count() == 7


def test_targets_by_brute_force(spark):
    rng = np.random.default_rng(12)
    for n in (1, 2, 7, 40):
        sizes = [int(x) for x in rng.pareto(0.6, n) * 50]
        rows = mixing.targets(spark.createDataFrame([(f"0s{i:03d}", s) for i, s in enumerate(sizes)], "source_key string, source_size long")).collect()
        weights = [i % 3 + 1 for i in range(n)]
        capped: set[int] = set()
        while True:
            left, open_ = sum(sizes) - sum(3 * sizes[i] for i in capped), sum(w for i, w in enumerate(weights) if i not in capped)
            over = {i for i in range(n) if i not in capped and left * weights[i] > 3 * sizes[i] * open_}
            if not over:
                break
            capped |= over
        want = {f"0s{i:03d}": float(3 * sizes[i]) if i in capped else left * weights[i] / open_ for i in range(n)}
        assert {r.source_key: r.target for r in rows} == want


def test_skewed_join_equals_join(spark):
    from tallymark.llm.skew import join_skewed

    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k != 1").withColumn("v", F.col("k") * 2)
    for how, rows in (("inner", 4999), ("left", 5000)):
        got = join_skewed(left, right, "k", "n", how)
        assert got.count() == rows and got.where("v != k * 2").count() == 0
