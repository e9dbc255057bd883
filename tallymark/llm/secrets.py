"""Secret scans over every version of every document.

Method: incremental blob ledger.  Texts are content-addressed by SHA-256; the ledger, a table in the shared folder, has one
row for every (blob, rule, version) ever scanned, with the places of what was found.  A run gathers the distinct blobs of all
its rows (each row is one historical version of its path), scans of each only the rules and versions that the ledger
lacks, appends the outcome, and joins the ledger's findings back to every path that has the blob.  Everything is
DataFrame functions: a match's place is the running length of the gaps and matches before it.

Edge cases: a null text is the empty blob, which has no findings; equal texts share one scan; places are code
points, ends exclusive; repeated rows each get the findings; an empty table gives an empty result; columns
beside the path and the text are ignored by scans and kept by ``redact``, whatever their names; a blob that two runs scanned at
the same time is in the ledger twice and counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import shared_path, table
from .skew import join_skewed

@dataclass(frozen=True)
class Rule:
    """A kind of secret: all leftmost matches of ``pattern``, kept if the group ``held`` has ``least`` characters."""

    kind: str
    pattern: str
    held: int
    least: int
    version: int = 1


# The base rules.  hex and access need no group: their pattern holds the least length, which for a
# greedy run of one class keeps the same matches as dropping the short runs afterwards.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
SPANS = "array<struct<start:bigint,end:bigint>>"
SCHEMA = f"blob string, kind string, version int, spans {SPANS}"


class Ledger:
    """The scanned (blob, rule, version) triples and their findings, a growing Parquet table."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        """path: the table's folder, kept from run to run; by default a new one in the cluster's shared folder."""
        self.spark, self.path = spark, path or shared_path(spark, "secrets-ledger")
        self.append(spark.range(0, 0, 1, 1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA))))

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def read(self, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, seen: one entry (kind, version, spans) for each of ``rules`` that the blob was scanned with."""
        known = F.lit(False)
        for rule in rules:
            known = known | ((F.col("kind") == rule.kind) & (F.col("version") == rule.version))
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).where(known)
        return rows.groupBy("blob").agg(F.collect_set(F.struct("kind", "version", "spans")).alias("seen"))


def blobs(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """The path, content address and text of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("content"))


def _matches(text: Column, rule: Rule) -> Column:
    """Kind and version of the rule, and for each match its length, its gap before and whether it is kept."""
    pattern = F.lit(rule.pattern)
    match = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.held)) if rule.held else match
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    rows = F.arrays_zip(F.transform(match, F.length).alias("size"), F.transform(held, lambda x: F.length(x) >= rule.least).alias("kept"), F.slice(gaps, 1, F.size(match)).alias("gap"))
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.when(text.rlike(rule.pattern), rows).alias("rows"))


def unseen(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The distinct blobs of ``docs`` (text) that lack a rule: blob, content, seen (what the ledger has, null if nothing)."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.sha2(text, 256).alias("blob"), text.alias("content")).dropDuplicates(["blob"])
    known = texts.join(ledger.read(rules), "blob", "left")
    return known.where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Distinct (blob, content, seen) -> a ledger row for each rule that ``seen`` lacks."""
    has = lambda rule: F.exists("seen", lambda x: (x["kind"] == rule.kind) & (x["version"] == rule.version))
    due = F.array(*(F.when(~F.coalesce(has(rule), F.lit(False)), _matches(F.col("content"), rule)) for rule in rules))
    hit = texts.select("blob", F.explode(F.filter(due, lambda x: x.isNotNull())).alias("hit"))
    rows = hit.select("blob", "hit.kind", "hit.version", F.posexplode_outer("hit.rows").alias("i", "m"))
    upto = Window.partitionBy("blob", "kind", "version").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("long")
    span = F.when(F.col("m.kept"), F.struct((end - F.col("m.size")).cast("long").alias("start"), end.alias("end")))
    placed = rows.select("blob", "kind", "version", span.alias("span"))
    return placed.groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list("span")).cast(SPANS).alias("spans"))


def update(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what of ``docs`` the ledger lacks and append it."""
    ledger.append(scan(unseen(docs, ledger, rules), rules))


def summaries(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Of each blob with findings: the counts by kind and the spans, by start, then in the order of the rules."""
    each = lambda rule: F.flatten(F.transform(F.filter("seen", lambda x: (x["kind"] == rule.kind) & (x["version"] == rule.version)), lambda x: x["spans"]))
    label = lambda rule, x: F.concat_ws(":", F.lit(rule.kind), x["start"], x["end"])
    span = lambda i, rule: lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("place"), label(rule, x).alias("label"), x["end"].alias("end"))
    counts = [F.size(each(rule)).cast("long").alias(f"n_{rule.kind}") for rule in rules]
    every = F.flatten(F.array(*(F.transform(each(rule), span(i, rule)) for i, rule in enumerate(rules))))
    return ledger.read(rules).select("blob", *counts, F.sort_array(every).alias("spans")).where(F.size("spans") > 0)


def findings(docs: DataFrame, path: str = "doc_id", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every finding in every row of ``docs`` (path, text): path, blob, kind, version, start, end."""
    ledger = ledger or Ledger(docs.sparkSession)
    update(docs, ledger, rules)
    own = table(blobs(docs, path).select("path", "blob"), "secrets-paths")
    known = ledger.read(rules).select("blob", F.explode("seen").alias("s")).select("blob", "s.kind", "s.version", F.explode("s.spans").alias("at"))
    known = known.groupBy("blob").agg(F.collect_list(F.struct("kind", "version", "at")).alias("all"))
    return _of_paths(own, known, "inner").select("path", "blob", F.explode("all").alias("x")).select("path", "blob", "x.kind", "x.version", "x.at.start", "x.at.end")


def _of_paths(own: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The rows of ``own``, which have a blob, with what was found in it; a blob with many rows is no burden to one task."""
    counted = own.groupBy("blob").agg(F.count("*").alias("n_rows")).join(found, "blob", how)
    return join_skewed(own, counted, "blob", "n_rows")


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) its counts by kind and its spans, an empty list if there are none."""
    ledger = ledger or Ledger(docs.sparkSession)
    update(docs, ledger, rules)
    found = summaries(ledger, rules)
    own = table(blobs(docs).select(F.col("path").alias("doc_id"), "blob"), "secrets-paths")
    each = _of_paths(own, found, "left")
    none = F.array().cast(found.schema["spans"].dataType)
    return each.select("doc_id", *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask`` (overlapping spans by one) and n_chars made to agree."""
    ledger = ledger or Ledger(docs.sparkSession)
    update(docs, ledger, rules)
    # The row travels as one value, so no column of it can clash with what is joined.
    own = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.struct("*").alias("row"))
    counts = table(docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")).agg(F.count("*").alias("n_rows")), "secrets-counts")
    found = counts.join(summaries(ledger, rules).select("blob", "spans"), "blob", "left")
    text = F.col("row")["text"]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int"))
        fresh = F.concat(acc["out"], gap, F.lit(mask))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(span["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    out = join_skewed(own, found, "blob", "n_rows").withColumn("clean", F.when(F.col("spans").isNotNull(), clean))
    new = {"text": F.coalesce("clean", text), "n_chars": F.coalesce(F.length("clean").cast("long"), F.col("row").getField("n_chars"))}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
