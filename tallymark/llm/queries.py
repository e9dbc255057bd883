"""The contracts' queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, fingerprints, html, langid, lexical, mixing, packing, pieces, quality, secrets, simhash, warc
from .scratch import shared_path

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    index = ann.build(vectors, k=10)
    asked = ann.valid(vectors).where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = ann.search(index, asked)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_read(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(_read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs, _read(spark, sf_dir, "labels").where(~held))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(_read(spark, sf_dir, "documents"))
    base = [rule.kind for rule in secrets.RULES]
    listed = F.concat_ws(",", F.transform("spans", lambda x: x["label"]))
    return found.select("doc_id", *(f"n_{kind}" for kind in base), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), path)
    back = warc.read(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = lexical.index(_read(spark, sf_dir, "documents"))
    return lexical.search(postings, _read(spark, sf_dir, "benchmark"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_read(spark, sf_dir, "embeddings")).drop("label")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM src),
steps AS (
  SELECT *, row_number() OVER o AS place,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
         sum(w) OVER (ORDER BY (3 * source_size) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed WINDOW o AS (ORDER BY (3 * source_size) / w, source NULLS LAST)),
level AS (SELECT place AS lp, l AS ll, open AS lo FROM steps WHERE l * w <= 3 * source_size * open ORDER BY place LIMIT 1),
goal AS (
  SELECT source, source_size,
         CASE WHEN lp IS NULL OR place < lp THEN (3 * source_size)::DOUBLE ELSE (ll * w)::DOUBLE / lo::DOUBLE END AS target
  FROM steps LEFT JOIN level ON true),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goal),
walk AS (
  SELECT doc_id, size, source_size, target, copies,
         greatest(floor(target + 0.5)::BIGINT - copies * source_size, 0)
         - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, rest)))::BIGINT AS taken FROM walk
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_ann": op2_ann,
    "op3_html": op3_html,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_secrets": op8_secrets,
    "op9_langid": op9_langid,
    "op10_warc": op10_warc,
    "op11_lexical": op11_lexical,
    "op12_pieces": op12_pieces,
    "op13_codes": op13_codes,
}

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, h, strlen(h)::BIGINT AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM k
"""

def _op8_sql() -> str:
    """The base rules with each letter of the first in either case; a match's place is the length of the gaps and matches before it."""
    either = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    kinds = (
        ("assign", either + r"""[""']?\x20*[:=]\x20*[""']?([A-Za-z0-9+/_.=-]+)""".replace('""', '"').replace("'", "''"), 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
    )
    parts = [
        f"""SELECT doc, {i} AS place, '{kind}' AS kind, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {group})) AS held,
       unnest(string_split_regex(t, '{pattern}')) AS gap, unnest(range(1, len(string_split_regex(t, '{pattern}')) + 1)) AS i, {least} AS least FROM texts"""
        for i, (kind, pattern, group, least) in enumerate(kinds)
    ]
    return f"""
WITH texts AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({' UNION ALL '.join(parts)}),
spans AS (
  SELECT doc, place, kind, length(held) >= least AS kept,
         sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc, place ORDER BY i) AS stop, length(m) AS n
  FROM matches),
found AS (
  SELECT doc, count(*) FILTER (WHERE place = 0) AS a, count(*) FILTER (WHERE place = 1) AS b, count(*) FILTER (WHERE place = 2) AS c,
         string_agg(kind || ':' || (stop - n)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - n, place) AS s
  FROM spans WHERE n IS NOT NULL AND kept GROUP BY doc)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM texts LEFT JOIN found USING (doc)"""


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
items AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM items),
sizes AS (SELECT doc, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
stats AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM sizes),
postings AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY doc, term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats),
gains AS (SELECT doc, term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))) AS gain FROM postings JOIN sizes USING (doc) JOIN weights USING (term), stats),
scored AS (SELECT item_id, text, doc, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY item_id, text, doc, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""


def _op13_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry of its codebook, round by round; vectors whose length the parts divide."""
    nearest = """near{i} AS MATERIALIZED (
  SELECT vec, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS best
  FROM (SELECT vec, part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut JOIN book{i} USING (part))
  GROUP BY vec, part)"""
    better = """book{j} AS MATERIALIZED (
  SELECT part, entry, coalesce(n, c) AS c FROM book{i} LEFT JOIN (
    SELECT part, entry, list(m ORDER BY place) AS n FROM (
      SELECT part, best.entry AS entry, place, floor(sum(x[place])::DECIMAL(38, 0) / count(*))::BIGINT AS m FROM near{i}, range(1, (SELECT any_value(len(x)) FROM cut) + 1) AS r(place)
      GROUP BY part, best.entry, place)
    GROUP BY part, entry) USING (part, entry))"""
    steps = [step for i in range(rounds) for step in (nearest.format(i=i), better.format(i=i, j=i + 1))] + [nearest.format(i=rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS vec, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS MATERIALIZED (SELECT vec, vec_id, part, list_slice(x, part * (len(x) // {parts}) + 1, (part + 1) * (len(x) // {parts})) AS x FROM kept, range({parts}) AS p(part)),
book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM cut
  WHERE vec IN (SELECT vec FROM kept WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x) = 1 ORDER BY vec_id LIMIT {entries})),
{', '.join(steps)},
coded AS (SELECT vec, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (vec), books"""


ORACLES: dict[str, str] = {
    "op11_lexical": OP11_SQL,
    "op13_codes": _op13_sql(),
    "op8_secrets": _op8_sql(),
    "op10_warc": OP10_SQL,
    "op6_mixing": OP6_SQL,
}
