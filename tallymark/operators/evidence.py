"""Hypotheses as equations, and the evidence for and against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .equations import Tree, value


def verdicts(rows: DataFrame, hypotheses: dict[str, Tree], target: str, keep: list[str], band: float = 1.0) -> DataFrame:
    """One row per row and hypothesis: ``keep``, hypothesis, supports.

    A row supports a hypothesis if the target lies within ``band`` of the value predicted; a prediction that has no finite value supports
    nothing.  Rows with a null or non-finite target are no evidence.  Works on streams as on tables.
    """
    judged = F.array(*(F.struct(F.lit(name).alias("hypothesis"), (F.abs(F.col(target) - value(tree)) <= band).alias("supports")) for name, tree in hypotheses.items()))
    known = rows.where(F.abs(F.col(target)) < float("inf"))
    return known.select(*keep, F.explode(judged).alias("judged")).select(*keep, "judged.hypothesis", "judged.supports")


def tally(found: DataFrame, group: str, order: str, falsified_by: int = 3) -> DataFrame:
    """Per group and hypothesis: n_evidence, n_supporting, refuted_in_a_row at the end, falsified.

    A hypothesis is falsified while its last ``falsified_by`` rows or more all refute it.  Nothing is sorted: the end of a group is what comes after its last
    supporting row, so rows of equal ``order`` with a supporting one do not count as after it.
    """
    keys = [group, "hypothesis"]
    last = found.groupBy(*keys).agg(F.count("*").alias("n_evidence"), F.count_if("supports").alias("n_supporting"), F.max(F.when(F.col("supports"), F.col(order))).alias("last"))
    after = found.where("NOT supports").select(F.col(group).alias("of"), F.col("hypothesis").alias("about"), F.col(order).alias("at"))
    met = F.col(group).eqNullSafe(F.col("of")) & (F.col("hypothesis") == F.col("about")) & (F.col("last").isNull() | (F.col("at") > F.col("last")))
    out = last.join(after, met, "left").groupBy(*keys, "n_evidence", "n_supporting").agg(F.count("about").alias("refuted_in_a_row"))
    return out.withColumn("falsified", F.col("refuted_in_a_row") >= falsified_by)
