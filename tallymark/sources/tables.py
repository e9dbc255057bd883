"""Reading and writing trial tables: CSV, JSON (row and column form), JSON lines, and directories of campaign records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; every column stays text and blank cells are null, with the file's stem as campaign_id."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return rows.withColumn("campaign_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def observations(table: DataFrame, kpi_prefixes: tuple[str, ...] = ("kpi_", "objective_", "obj_")) -> DataFrame:
    """Text rows as observations: numeric cells of columns so prefixed are objectives, other numeric cells parameters, the rest metadata.

    One pass: each row's cells are sorted into three maps by what they parse to.
    """
    names = [c for c in table.columns if c not in ("campaign_id", "iteration")]
    cells = F.array(*(F.struct(F.lit(n).alias("name"), F.trim(F.col(n).cast("string")).alias("text"), F.expr(f"try_cast(`{n}` AS double)").alias("number")) for n in names))
    cells = F.filter(cells, lambda c: c["text"].isNotNull() & (c["text"] != ""))
    is_kpi = lambda c: F.exists(F.array(*map(F.lit, kpi_prefixes)), lambda p: F.startswith(c["name"], p))
    pick = lambda test, field: F.map_from_entries(F.transform(F.filter(cells, test), lambda c: F.struct(c["name"], c[field])))
    place = F.col("iteration").cast("long") if "iteration" in table.columns else F.monotonically_increasing_id()
    return table.select(
        F.col("campaign_id") if "campaign_id" in table.columns else F.lit("imported").alias("campaign_id"),
        place.alias("iteration"),
        pick(lambda c: c["number"].isNotNull() & ~is_kpi(c), "number").alias("parameters"),
        pick(lambda c: c["number"].isNotNull() & is_kpi(c), "number").alias("kpi_values"),
        pick(lambda c: c["number"].isNull(), "text").alias("metadata"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that holds a list of rows."""
    return spark.read.option("multiLine", True).json(path)


def columns_to_rows(table: DataFrame) -> DataFrame:
    """Rows of a table whose columns are arrays; short arrays are padded with null, scalars count as arrays of one."""
    arrays = [F.col(f.name) if isinstance(f.dataType, T.ArrayType) else F.array(F.col(f.name)) for f in table.schema]
    return table.select(F.inline(F.arrays_zip(*(a.alias(f.name) for a, f in zip(arrays, table.schema)))))


def read_records(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every campaign's record.json under a workspace, with the campaign's folder name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/campaigns/*/record.json")
    return rows.withColumn("campaign", F.regexp_extract(F.col("_metadata.file_path"), r"campaigns/([^/]+)/record\.json$", 1))


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def canonical_json(table: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with its sorted-key JSON and the first 16 digits of that JSON's SHA-256."""
    text = F.to_json(F.struct(*sorted(columns)))
    return table.withColumn("canonical", text).withColumn("row_hash", F.substring(F.sha2(text, 256), 1, 16))


def json_text(table: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of JSON lists that a column holds as text, beside the other columns; a malformed or empty text gives no row."""
    kept = [c for c in table.columns if c != column]
    return table.select(*kept, F.inline(F.from_json(column, f"array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in T.StructType.fromDDL(schema))}>>")))


def csv_text(table: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of CSV texts with a header line that a column holds, beside the other columns that do not clash; blank lines are skipped."""
    fields = T.StructType.fromDDL(schema)
    kept = [c for c in table.columns if c != column and c not in fields.names]
    lines = F.filter(F.slice(F.split(column, r"\r?\n"), 2, F.size(F.split(column, r"\r?\n"))), lambda x: F.trim(x) != "")
    return table.select(*kept, F.explode(lines).alias("line_")).select(*kept, F.from_csv("line_", schema).alias("row_")).select(*kept, "row_.*")


def detect_bounds(obs: DataFrame, params: list[str], margin: float = 0.05) -> DataFrame:
    """Bounds of every parameter of a campaign from its values, widened by a share of their range (of their size, if they are all equal)."""
    spans = obs.unpivot(["campaign_id"], params, "name", "x").groupBy("campaign_id", "name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    pad = margin * F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.greatest(F.abs("lo"), F.lit(1.0)))
    return spans.select("campaign_id", "name", (F.round(F.col("lo") - pad, 6) + 0.0).alias("lower"), (F.round(F.col("hi") + pad, 6) + 0.0).alias("upper"))


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a local one only where that is unset and the master is this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return f"{(named or '/tmp/checkpoints').rstrip('/')}/{what}-{uuid.uuid4().hex}"


def keep(table: DataFrame, what: str) -> DataFrame:
    """``table`` written once in the shared folder and read again: what comes after does not repeat what came before."""
    path = shared_path(table.sparkSession, what)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
