"""Catalogue queries of search spaces, physical limits, mediation, candidates, batches and queues."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..model import LINE_SPECS, LINE_SQL, Spec, line_observations, read
from ..operators import decide, space
from . import rules  # noqa: F401  its SQL of thresholds is used here
from .catalogue import ORACLES, PARAMS, _corr, _r, query

WIDE_SPECS = (Spec("p_quantity", -20.0, 100.0), Spec("p_discount", 0.0, 0.1), Spec("p_tax", 0.0, 0.2))


@query(f"""+ w AS (SELECT campaign_id, unnest(['p_quantity', 'p_discount', 'p_tax']) AS name, unnest([-20.0::DOUBLE, 0, 0]) AS lo, unnest([100.0::DOUBLE, 0.1, 0.2]) AS hi, unnest([p_quantity, p_discount, p_tax])::DOUBLE AS x FROM obs WHERE NOT is_failure),
v AS (SELECT campaign_id, name, lo, hi, list_sort(list(x)) AS x, count(x) AS n FROM w WHERE x IS NOT NULL GROUP BY ALL HAVING count(x) >= 5),
e AS (SELECT *, x[floor(0.05::DOUBLE * (n - 1))::INT + 1] AS a, x[ceil((1 - 0.05::DOUBLE) * (n - 1))::INT + 1] AS b FROM v)
SELECT campaign_id, name, {_r('greatest(lo, a - (b - a) * 0.1::DOUBLE)')} AS lower, {_r('least(hi, b + (b - a) * 0.1::DOUBLE)')} AS upper, {_r('least(1.0::DOUBLE, n / 30)')} AS confidence FROM e WHERE b - a < (hi - lo) * 0.8::DOUBLE""", LINE_SQL)
def range_tightening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.tightened_ranges(line_observations(spark, sf_dir), WIDE_SPECS)


# A weight that follows the quantity, and a depth that follows the weight, so also the quantity.
_DERIVED = "+ d AS (SELECT campaign_id, p_quantity AS q, p_discount AS c, 2 * p_quantity + p_tax AS w, -p_quantity AS h FROM obs WHERE NOT is_failure)"


@query(f"""{_DERIVED}, r AS (SELECT campaign_id, {', '.join(f"abs({_corr(a, b)}) AS {a}{b}" for a, b in combinations('qcwh', 2))}, avg(c) AS mc, avg(w) AS mw, avg(h) AS mh FROM d GROUP BY 1),
m AS (SELECT campaign_id, unnest(['p_discount', 'p_weight', 'p_depth']) AS name,
  unnest([CASE WHEN qc >= 0.9 THEN 'p_quantity' END, CASE WHEN qw >= 0.9 THEN 'p_quantity' WHEN qc < 0.9 AND cw >= 0.9 THEN 'p_discount' END,
    CASE WHEN qh >= 0.9 THEN 'p_quantity' WHEN qc < 0.9 AND ch >= 0.9 THEN 'p_discount' WHEN qw < 0.9 AND (qc >= 0.9 OR cw < 0.9) AND wh >= 0.9 THEN 'p_weight' END]) AS merge_into,
  unnest([mc, mw, mh]) AS mean, unnest([qc, qw, qh]) AS r FROM r)
SELECT campaign_id, name, merge_into, {_r('r', 4)} AS correlation, {_r('mean', 4)} AS freeze_value FROM m WHERE merge_into IS NOT NULL""", LINE_SQL)
def redundant_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = line_observations(spark, sf_dir).withColumns({"p_weight": 2 * F.col("p_quantity") + F.col("p_tax"), "p_depth": -F.col("p_quantity")})
    return space.redundant_parameters(obs, ["p_quantity", "p_discount", "p_weight", "p_depth"])


LIMITS = {"ce": (0.0, 105.0), "grain_size": (5.0, float("inf")), "selectivity": (0.0, 100.0)}


@query("""SELECT l_orderkey, l_linenumber, name, value, CASE WHEN name = 'grain_size' OR value > upper * 1.1::DOUBLE THEN 'error' ELSE 'warning' END AS severity FROM (
SELECT l_orderkey, l_linenumber, unnest(['CE', 'grain_size', 'selectivity', 'other']) AS name, unnest([l_quantity * 2.5::DOUBLE, l_quantity, l_tax * 1500, l_quantity]) AS value, unnest([105.0::DOUBLE, 'inf'::DOUBLE, 100, NULL]) AS upper FROM lineitem)
WHERE (name <> 'other' AND value > upper) OR (name = 'grain_size' AND value < 5)""")
def kpi_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpi = lambda name, x: F.struct(F.lit(name).alias("name"), x.cast("double").alias("value"))
    quantity = F.col("l_quantity")
    each = F.array(kpi("CE", quantity * 2.5), kpi("grain_size", quantity), kpi("selectivity", F.col("l_tax") * 1500), kpi("other", quantity))
    values = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.inline(each))
    return space.out_of_range(values, LIMITS).select("l_orderkey", "l_linenumber", "name", "value", "severity")


@query("""SELECT * FROM (SELECT campaign_id, lag(iteration) OVER o AS from_iteration, iteration AS to_iteration, lag(p_quantity) OVER o AS from_value, p_quantity AS to_value
FROM obs WHERE p_quantity BETWEEN 10 AND 30 WINDOW o AS (PARTITION BY campaign_id ORDER BY iteration)) WHERE from_value > to_value""", LINE_SQL)
def monotonicity_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.monotonicity_breaks(line_observations(spark, sf_dir), "p_quantity", within=(10.0, 30.0))


@query("""SELECT campaign_id, iteration, (p_quantity < 3)::INT + (p_quantity > 45)::INT + (abs(p_discount + p_tax - 0.09::DOUBLE) > 0.055::DOUBLE)::INT AS n_violations,
p_quantity BETWEEN 3 AND 45 AND abs(p_discount + p_tax - 0.09::DOUBLE) <= 0.055::DOUBLE AS feasible FROM obs""", LINE_SQL)
def physical_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = space.physical_feasibility(line_observations(spark, sf_dir), {"p_quantity": (3.0, 45.0), "p_tax": (None, 0.5)}, {("p_discount", "p_tax"): (0.09, 0.055)})
    return rows.select("campaign_id", "iteration", F.size("violations").alias("n_violations"), "feasible")


_MIDDLE = "list_sort(list({0}))[count({0}) // 2 + 1]"


@query(f"""+ k AS (SELECT campaign_id, {_MIDDLE.format('p_quantity')} AS cut FROM obs GROUP BY 1),
h AS (SELECT o.campaign_id, p_quantity >= cut AS high, count(*) AS n, avg(p_discount) AS m, avg(kpi) AS y, covar_pop(p_discount, kpi) AS c, var_pop(p_discount) AS v FROM obs o JOIN k USING (campaign_id) GROUP BY 1, 2),
s AS (SELECT campaign_id, sum(n) AS n, max(y) FILTER (high) - max(y) FILTER (NOT high) AS total, max(m) FILTER (high) - max(m) FILTER (NOT high) AS am, coalesce(sum(c / v * n) FILTER (n >= 3 AND v > 1e-12) / sum(n) FILTER (n >= 3 AND v > 1e-12), 0) AS slope FROM h GROUP BY 1),
z AS (SELECT campaign_id, CASE WHEN n < 4 THEN 0 ELSE coalesce(total, 0) END AS t, CASE WHEN n < 4 THEN 0 ELSE coalesce(am * slope, 0) END AS i FROM s)
SELECT campaign_id, {_r('t', 4)} AS total, {_r('i', 4)} AS indirect, {_r('t - i', 4)} AS direct FROM z""", LINE_SQL)
def mediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.mediation(line_observations(spark, sf_dir), "p_quantity", "p_discount", "kpi")


@query(f"""+ k AS (SELECT campaign_id, {_MIDDLE.format('p_discount')} AS ct, {_MIDDLE.format('p_quantity')} AS cm FROM obs GROUP BY 1),
x AS (SELECT o.campaign_id, p_discount >= ct AS t, p_quantity >= cm AS m, kpi AS y FROM obs o JOIN k USING (campaign_id)),
pt AS (SELECT campaign_id, t, count(*) / sum(count(*)) OVER (PARTITION BY campaign_id) AS p FROM x GROUP BY 1, 2),
pm AS (SELECT campaign_id, t, m, count(*) / sum(count(*)) OVER (PARTITION BY campaign_id, t) AS p FROM x GROUP BY 1, 2, 3),
ey AS (SELECT campaign_id, t, m, avg(y) AS y FROM x GROUP BY 1, 2, 3),
i AS (SELECT campaign_id, m, sum(y * p) AS y FROM ey JOIN pt USING (campaign_id, t) GROUP BY 1, 2),
e AS (SELECT campaign_id, t, sum(p * y) AS e FROM pm JOIN i USING (campaign_id, m) GROUP BY 1, 2)
SELECT campaign_id, {_r('coalesce(sum(e) FILTER (t), 0) - coalesce(sum(e) FILTER (NOT t), 0)', 4)} AS effect FROM e GROUP BY 1""", LINE_SQL)
def frontdoor_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.frontdoor_effect(line_observations(spark, sf_dir), "p_discount", "p_quantity", "kpi")


@query(f"""+ s AS (SELECT * FROM obs WHERE NOT is_failure),
u AS (SELECT campaign_id, list_sort(list(DISTINCT p_quantity)) AS q, list_sort(list(DISTINCT p_discount)) AS d, list_sort(list(DISTINCT p_tax)) AS t FROM s GROUP BY 1),
c AS (SELECT campaign_id, (q[len(q) // 2] + q[len(q) // 2 + 1]) / 2 AS cq, (d[len(d) // 2] + d[len(d) // 2 + 1]) / 2 AS cd, (t[len(t) // 2] + t[len(t) // 2 + 1]) / 2 AS ct FROM u),
x AS (SELECT s.campaign_id, kpi, unnest(['p_quantity', 'p_quantity', 'p_discount']) AS a, unnest(['p_discount', 'p_tax', 'p_tax']) AS b,
  unnest([p_quantity <= cq, p_quantity <= cq, p_discount <= cd]) AS la, unnest([p_discount <= cd, p_tax <= ct, p_tax <= ct]) AS lb FROM s JOIN c USING (campaign_id)),
g AS (SELECT campaign_id, a, b, la, lb, count(*) AS n, var_pop(kpi) AS v FROM x GROUP BY ALL), v AS (SELECT campaign_id, var_pop(kpi) AS total FROM s GROUP BY 1)
SELECT campaign_id, a, b, {_r('CASE WHEN count(la) < count(*) OR count(lb) < count(*) OR any_value(total) <= 1e-12 THEN 0 ELSE greatest(0.0::DOUBLE, 1 - sum(n * g.v) / sum(n) / any_value(total)) END')} AS explained
FROM g JOIN v USING (campaign_id) GROUP BY 1, 2, 3""", LINE_SQL)
def joint_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.joint_variance(line_observations(spark, sf_dir), PARAMS)


@query("""+ f AS (SELECT campaign_id, avg(is_failure::INT) AS fr, stddev_pop(kpi) FILTER (NOT is_failure) / avg(kpi) FILTER (NOT is_failure) AS cv, ['cold_start', 'exploitation', 'stagnation', 'learning', 'tail'][campaign_id % 5 + 1] AS phase FROM obs GROUP BY 1)
SELECT campaign_id, phase, CASE WHEN cv > 0.5 OR 1 / cv < 2 THEN 'high' WHEN cv > 0.2 OR 1 / cv < 5 THEN 'medium' ELSE 'low' END AS noise_regime,
CASE phase WHEN 'cold_start' THEN 6 WHEN 'exploitation' THEN 1 ELSE 3 END + CASE WHEN cv > 0.5 THEN 2 WHEN cv > 0.3 THEN 1 ELSE 0 END
+ CASE WHEN fr > 0.3 THEN greatest(1, floor(CASE phase WHEN 'cold_start' THEN 6 WHEN 'exploitation' THEN 1 ELSE 3 END * fr))::INT ELSE 0 END AS batch_size FROM f""", LINE_SQL)
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = F.when(~F.col("is_failure"), F.col("kpi"))
    facts = line_observations(spark, sf_dir).groupBy("campaign_id").agg(F.avg(F.col("is_failure").cast("int")).alias("fr"), (F.stddev_pop(won) / F.avg(won)).alias("cv"))
    phases = F.array(*map(F.lit, ("cold_start", "exploitation", "stagnation", "learning", "tail")))
    facts = facts.withColumn("phase", F.get(phases, (F.col("campaign_id") % 5).cast("int")))
    return facts.select("campaign_id", "phase", space.noise_regime(F.col("cv"), 1 / F.col("cv")).alias("noise_regime"), space.batch_size(F.col("phase"), 3, F.col("cv"), F.col("fr")).alias("batch_size"))


@query(f"""+ c AS (SELECT campaign_id, (p_discount * 100)::INT AS bin, {_r('avg(kpi)')} AS mean, {_r('stddev_pop(kpi)')} AS std FROM obs WHERE NOT is_failure GROUP BY 1, 2),
s AS (SELECT *, {_r('-mean - 2 * std')} AS score FROM c)
SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY score, bin)::INT AS rank FROM s""", LINE_SQL)
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = line_observations(spark, sf_dir).where("NOT is_failure").withColumn("bin", F.round(F.col("p_discount") * 100).cast("int"))
    bins = won.groupBy("campaign_id", "bin").agg(tidy(F.avg("kpi")).alias("mean"), tidy(F.stddev_pop("kpi")).alias("std"))
    return space.rank_candidates(bins, "campaign_id", "bin", "mean", "std", maximize=True)


# The next thousand open orders whose customer's order before is done, for suppliers that take their priority and status.
@query("""WITH q AS (SELECT *, lag(o_orderkey) OVER c AS dep, lag(o_orderstatus) OVER c AS dep_status FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey AS key, o_orderdate AS place FROM q WHERE o_orderstatus = 'O' AND (dep IS NULL OR dep_status = 'F')
AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 2 = 0 AND s_acctbal > 0 AND ['1-URGENT', '2-HIGH', '3-MEDIUM'][s_nationkey % 3 + 1] = o_orderpriority)
ORDER BY o_orderdate, o_orderkey LIMIT 1000""")
def ready_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    queue = orders.withColumn("dep", before).where("o_orderstatus = 'O'")
    queue = queue.select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("place"), F.array_compact(F.array("dep")).alias("deps"), F.array("o_orderpriority", "o_orderstatus").alias("needs"))
    kinds = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))
    takes = F.array_compact(F.array(F.get(kinds, F.col("s_nationkey").cast("int") % 3), F.when(F.col("s_acctbal") > 0, "O")))
    resources = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("resource_id"), takes.alias("capabilities"), (F.col("s_suppkey") % 2 == 0).alias("available"))
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return space.ready_trials(queue, done, resources, 1000)


_THRESHOLDS = ORACLES["constraint_thresholds"]
_OLD = _THRESHOLDS.replace("FROM obs)", "FROM obs WHERE iteration % 2 = 0)", 1)
_NEW = _THRESHOLDS.replace("FROM obs)", "FROM obs WHERE iteration % 2 = 1)", 1).replace("p_quantity > 45", "p_quantity > 40 AND (p_tax > 0.02 OR campaign_id % 3 > 0) AND campaign_id % 7 > 0", 1)


@query(f"""SELECT coalesce(o.campaign_id, n.campaign_id) AS campaign_id, coalesce(o.name, n.name) AS name, o.threshold AS old_threshold, n.threshold AS new_threshold, coalesce(o.rate_above, 0) AS old_rate, coalesce(n.rate_above, 0) AS new_rate,
CASE WHEN o.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'removed' WHEN n.rate_above > o.rate_above + 0.05::DOUBLE THEN 'tightened' WHEN n.rate_above < o.rate_above - 0.05::DOUBLE THEN 'relaxed' ELSE 'unchanged' END AS direction
FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.campaign_id = n.campaign_id AND o.name = n.name""")
def constraint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = line_observations(spark, sf_dir)
    late = (F.col("p_quantity") > 40) & ((F.col("p_tax") > 0.02) | (F.col("campaign_id") % 3 > 0)) & (F.col("campaign_id") % 7 > 0)
    half = lambda k, fails: decide.failure_thresholds(obs.where(F.col("iteration") % 2 == k).withColumn("is_failure", F.col("is_failure") | fails), LINE_SPECS)
    return space.constraint_changes(half(0, F.col("p_quantity") > 45), half(1, late))
