"""Further catalogue queries: confounders, drift by dimension, preferences, resampling, costs, theory and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import theory
from ..functions.numeric import norm_cdf, tidy
from ..model import LINE_SPECS, LINE_SQL, line_observations, read
from ..operators import adjust, insight, prefer
from ..sources import tables
from .catalogue import LONG, PARAMS, PART_SQL, _corr, _parts, _r, query

# Line items with a numeric confounder (the tax) and one that depends on the objective.
META_SQL = LINE_SQL + ", meta AS (SELECT *, p_tax AS m_humidity, CASE WHEN iteration % 7 <> 0 THEN kpi / 1000 + iteration % 5 END AS m_load FROM obs)"


def _with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = F.when(F.col("iteration") % 7 != 0, F.col("kpi") / 1000 + F.col("iteration") % 5)
    return line_observations(spark, sf_dir).withColumns({"m_humidity": F.col("p_tax"), "m_load": load})


@query(f"""+ w AS (SELECT campaign_id, kpi, unnest(['m_humidity', 'm_load']) AS name, unnest([m_humidity, m_load]) AS x FROM meta),
r AS (SELECT campaign_id, name, count(x) AS n, abs({_corr('x', 'kpi')}) AS r FROM w WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT campaign_id, name, n, {_r('r')} AS max_abs_correlation FROM r WHERE n >= 3 AND r > 0.3""", META_SQL)
def confounders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.confounders(_with_meta(spark, sf_dir), ["m_humidity", "m_load"])


@query(f"SELECT campaign_id, {_r('min(m_load)')} AS lower, {_r('CASE WHEN min(m_load) = max(m_load) THEN min(m_load) + 1 ELSE max(m_load) END')} AS upper, count(m_load) AS n_affected FROM meta GROUP BY 1", META_SQL)
def confounder_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.covariate(_with_meta(spark, sf_dir), "m_load")


@query("SELECT campaign_id, iteration, coalesce(m_load < 5 OR m_load > 40, false) AS flagged, CASE WHEN m_load < 5 OR m_load > 40 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM meta", META_SQL)
def confounder_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.flag_high_risk(_with_meta(spark, sf_dir), "m_load", 5.0, 40.0).select("campaign_id", "iteration", "flagged", "weight")


@query(f"SELECT campaign_id, count(kpi) AS n, {_r('avg(kpi)', 4)} AS mean, {_r('stddev_pop(kpi)', 4)} AS std, {_r('min(kpi)')} AS least, {_r('max(kpi)')} AS most FROM meta WHERE m_load IS NULL OR m_load BETWEEN 5 AND 40 GROUP BY 1", META_SQL)
def confounder_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.kpi_stats(adjust.exclude(_with_meta(spark, sf_dir), "m_load", 5.0, 40.0))


@query(f"SELECT campaign_id, {_r('regr_slope(kpi, iteration)', 4)} AS trend, 0.0::DOUBLE AS drift_slope, false AS detected, 'stable' AS direction FROM obs WHERE NOT is_failure GROUP BY 1 HAVING count(*) >= 3", LINE_SQL)
def instrument_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.instrument_drift(line_observations(spark, sf_dir))


@query(f"""+ o AS (SELECT campaign_id, kpi, least(4, greatest(0, floor((p_quantity - 1) / 49.0 * 5))) AS bin FROM obs WHERE NOT is_failure),
i AS (SELECT campaign_id, bin, count(kpi) AS n, var_pop(kpi) AS v FROM o GROUP BY 1, 2), w AS (SELECT campaign_id, {_r('sqrt(avg(v) FILTER (WHERE n >= 2))', 4)} AS w FROM i GROUP BY 1),
t AS (SELECT campaign_id, {_r('stddev_pop(kpi)', 4)} AS t, avg(kpi) AS m FROM o GROUP BY 1),
g AS (SELECT campaign_id, iteration // 10 AS b, kpi, count(*) OVER (PARTITION BY campaign_id) AS n, iteration FROM obs),
q AS (SELECT campaign_id, kpi, CASE WHEN n % 10 = 1 AND iteration = n - 1 AND b > 0 THEN b - 1 ELSE b END AS b FROM g),
h AS (SELECT campaign_id, b, count(*) AS n, avg(kpi) AS m, var_pop(kpi) AS v FROM q GROUP BY 1, 2),
u AS (SELECT h.*, x.m AS mean FROM h JOIN (SELECT campaign_id, avg(kpi) AS m FROM obs GROUP BY 1) x USING (campaign_id)),
s AS (SELECT campaign_id, count(*) AS k, sum(n) AS n, sum(n * (m - mean) ** 2) AS a, sum(n * v) AS e FROM u GROUP BY 1),
f AS (SELECT campaign_id, CASE WHEN k > 1 AND n > k AND e > 0 THEN (a / (k - 1)) / (e / (n - k)) ELSE 0 END > 3 AS detected, CASE WHEN a + e > 0 THEN a / (a + e) ELSE 0 END AS eta FROM s)
SELECT campaign_id, {_r('greatest(0.0, least(1.0, 1 - CASE WHEN t / abs(m) > 0.5 THEN 0.2 ELSE 0 END - CASE WHEN w / t > 0.7 THEN 0.1 ELSE 0 END - CASE WHEN detected THEN 0.2 * eta ELSE 0 END))', 4)} AS quality FROM t JOIN w USING (campaign_id) JOIN f USING (campaign_id)""", LINE_SQL)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = line_observations(spark, sf_dir)
    mean = obs.where("NOT is_failure").groupBy("campaign_id").agg(F.avg("kpi").alias("mean"))
    noise = insight.noise_decomposition(obs, LINE_SPECS[0]).join(mean, "campaign_id")
    noise = noise.select("campaign_id", (F.col("total_sd") / F.abs("mean")).alias("total_noise"), (F.col("within_sd") / F.col("total_sd")).alias("ratio"))
    drift = adjust.instrument_drift(obs).select("campaign_id", "detected", F.lit(0.0).alias("r_squared"))
    return adjust.quality_score(noise, insight.batch_effects(obs), drift)


RECENT = LINE_SQL + ", back AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY iteration DESC) AS k FROM obs WHERE NOT is_failure), recent AS (SELECT *, k <= 10 AS fresh FROM back WHERE k <= 20 QUALIFY count(*) OVER (PARTITION BY campaign_id) = 20)"


@query(f"""+ w AS (SELECT campaign_id, kpi, fresh, unnest(['p_quantity', 'p_discount', 'p_tax']) AS name, unnest([p_quantity, p_discount, p_tax]) AS x FROM recent),
s AS (SELECT campaign_id, name, abs({_corr('x', 'kpi', 'fresh')} - {_corr('x', 'kpi', 'NOT fresh')}) AS c, abs(avg(x) FILTER (WHERE fresh) - avg(x) FILTER (WHERE NOT fresh)) / greatest(stddev_samp(x) FILTER (WHERE NOT fresh), 1e-12) AS m FROM w GROUP BY 1, 2)
SELECT campaign_id, name, {_r('c', 5)} AS correlation_shift, {_r('m', 5)} AS mean_shift, {_r('0.6 * least(c, 1.0) + 0.4 * least(m / 3, 1.0)', 4)} AS score FROM s""", RECENT)
def drift_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.attribute_drift(line_observations(spark, sf_dir), PARAMS)


RESIDUALS = RECENT + """, fit AS (SELECT campaign_id, regr_slope(kpi, p_quantity) AS s, avg(kpi) AS my, avg(p_quantity) AS mx, stddev_samp(kpi) AS sd FROM recent WHERE NOT fresh GROUP BY 1),
rest AS (SELECT campaign_id, avg(kpi - my - coalesce(s, 0) * (p_quantity - mx)) AS m, stddev_samp(kpi - my - coalesce(s, 0) * (p_quantity - mx)) AS d, any_value(sd) AS sd FROM recent JOIN fit USING (campaign_id) WHERE fresh GROUP BY 1),
shift AS (SELECT campaign_id, m, d, least(abs(m) / greatest(sd, d, 1e-12) / 3, 1.0) AS score FROM rest)"""


@query(f"SELECT campaign_id, {_r('m', 3)} AS residual_mean, {_r('d', 3)} AS residual_std, {_r('score', 5)} AS score FROM shift", RESIDUALS)
def residual_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.residual_shift(line_observations(spark, sf_dir), "p_quantity")


@query(f"""+ n AS (SELECT campaign_id, count(*) AS n FROM obs WHERE NOT is_failure GROUP BY 1), j AS (SELECT campaign_id, n, {_r('score', 5)} AS score FROM n LEFT JOIN shift USING (campaign_id))
SELECT campaign_id, n, (CASE WHEN coalesce(score, 0) < 0.1 THEN n ELSE least(n, greatest(10, floor(n * greatest(0.25, 1 - 0.75 * score)))) END)::BIGINT AS n_kept FROM j""", RESIDUALS)
def drift_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = line_observations(spark, sf_dir)
    counts = obs.where("NOT is_failure").groupBy("campaign_id").agg(F.count("*").alias("n"))
    return adjust.drift_window(adjust.residual_shift(obs, "p_quantity"), counts, least=0.1)


@query(f"""+ o AS (SELECT campaign_id, kpi, row_number() OVER (PARTITION BY campaign_id ORDER BY iteration) - 1 AS pos, count(*) OVER (PARTITION BY campaign_id) AS n FROM obs WHERE NOT is_failure QUALIFY n >= 20),
b AS (SELECT campaign_id, avg(kpi) AS m0, stddev_samp(kpi) AS s0 FROM o WHERE pos < 10 GROUP BY 1),
g AS (SELECT campaign_id, unnest(range(0, (any_value(n) - 20) // 5 + 1)) AS k FROM o GROUP BY campaign_id),
p AS (SELECT g.campaign_id, g.k, avg(kpi) AS m, stddev_samp(kpi) AS s FROM g JOIN o ON o.campaign_id = g.campaign_id AND pos >= 10 + 5 * k AND pos < 20 + 5 * k GROUP BY 1, 2)
SELECT campaign_id, k::BIGINT AS segment, {_r('CASE WHEN s0 ** 2 + s ** 2 > 0 THEN least(abs(m0 - m) / sqrt((s0 ** 2 + s ** 2) / 2) / 4, 1.0) ELSE 0 END', 5)} AS score FROM p JOIN b USING (campaign_id)""", LINE_SQL)
def drift_rolling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.rolling_scores(line_observations(spark, sf_dir))


SCALED = "sqrt(((a.p_quantity - b.p_quantity) / 49) ** 2 + ((a.p_discount - b.p_discount) / 0.1) ** 2 + ((a.p_tax - b.p_tax) / 0.08) ** 2)"


@query(f"""+ d AS (SELECT a.campaign_id, a.iteration, b.kpi, row_number() OVER (PARTITION BY a.campaign_id, a.iteration ORDER BY {SCALED}, b.iteration) AS k FROM obs a JOIN obs b ON a.campaign_id = b.campaign_id AND a.is_failure AND NOT b.is_failure),
m AS (SELECT campaign_id, iteration, count(*)::INT AS n, avg(kpi) AS m FROM d WHERE k <= 5 GROUP BY 1, 2)
SELECT campaign_id, iteration, coalesce(n, 0)::INT AS n_near, {_r('coalesce(m, 0)', 3)} AS kpi FROM obs LEFT JOIN m USING (campaign_id, iteration) WHERE is_failure""", LINE_SQL)
def impute_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.impute_near(line_observations(spark, sf_dir), LINE_SPECS)


@query(f"""+ ok AS (SELECT * FROM obs WHERE NOT is_failure), a AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY kpi DESC, iteration) = 1),
s AS (SELECT campaign_id, max(kpi) - min(kpi) AS span FROM ok GROUP BY 1),
n AS (SELECT a.campaign_id, b.kpi - a.kpi AS dy, b.p_quantity - a.p_quantity AS d1, b.p_discount - a.p_discount AS d2, b.p_tax - a.p_tax AS d3 FROM ok b JOIN a ON a.campaign_id = b.campaign_id AND a.iteration <> b.iteration
  QUALIFY row_number() OVER (PARTITION BY a.campaign_id ORDER BY {SCALED}, b.iteration) <= 5),
u AS (SELECT campaign_id, dy, unnest(['p_quantity', 'p_discount', 'p_tax']) AS name, unnest([d1, d2, d3]) AS dx, unnest([49.0, 0.1, 0.08]::DOUBLE[]) AS wide FROM n),
g AS (SELECT campaign_id, name, avg(abs(dy / dx)) * any_value(wide) / any_value(span) AS g FROM u JOIN s USING (campaign_id) WHERE abs(dx) >= 1e-15 GROUP BY 1, 2),
l AS (SELECT campaign_id, name, {_corr('x', 'kpi')} AS r FROM wide WHERE NOT is_failure GROUP BY 1, 2)
SELECT campaign_id, name, {_r('r', 5)} AS correlation, {_r('coalesce(g, 0)', 4)} AS local_gradient, {_r('0.5 * abs(r) + 0.5 * least(1.0, greatest(0.0, coalesce(g, 0)))', 5)} AS score FROM l LEFT JOIN g USING (campaign_id, name)""".replace("+ ok AS", LONG + ", ok AS", 1), LINE_SQL)
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.sensitivity(line_observations(spark, sf_dir), LINE_SPECS)


@query(f"""{LONG}, c AS (SELECT campaign_id, name, {_r('covar_pop(x, kpi)')} AS c, abs({_corr('x', 'kpi')}) AS i FROM wide GROUP BY 1, 2)
SELECT campaign_id, name, sign(c)::DOUBLE AS direction, {_r("CASE name WHEN 'p_quantity' THEN 49 WHEN 'p_discount' THEN 0.1 ELSE 0.08 END::DOUBLE * CASE WHEN i > 0.5 THEN 0.05 WHEN i > 0.2 THEN 0.1 ELSE 0.2 END::DOUBLE")} AS step FROM c""", LINE_SQL)
def screening_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numeric import safe_corr
    from ..operators.store import long_form

    obs = line_observations(spark, sf_dir)
    weight = long_form(obs.select("campaign_id", "kpi", *PARAMS), PARAMS).groupBy("campaign_id", "name").agg(F.abs(safe_corr(F.col("x"), F.col("kpi"))).alias("importance"))
    return adjust.steps(obs, LINE_SPECS, weight)


# ---------------------------------------------------------------- preferences


@query(f"SELECT p_brand, p_partkey, {_r('-0.75 * price - 0.25 * neg_size')} AS weighted, {_r('least(-0.75 * price, -0.25 * neg_size)')} AS tchebycheff, {_r('-greatest(0.75 * price, 0.25 * abs(neg_size))')} AS achievement FROM q", PART_SQL)
def scalarized_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways, weights = {"price": "minimize", "neg_size": "minimize"}, {"price": 3.0, "neg_size": 1.0}
    score = lambda method: tidy(prefer.scalarized(ways, weights, method))
    return _parts(spark, sf_dir).select("p_brand", "p_partkey", score("weighted_sum").alias("weighted"), score("tchebycheff").alias("tchebycheff"), score("achievement").alias("achievement"))


@query("SELECT p_brand, p_partkey FROM q WHERE price BETWEEN 905 AND 910 AND neg_size <= -20", PART_SQL)
def target_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefer.in_bands(_parts(spark, sf_dir), {"price": (905.0, 910.0), "neg_size": (None, -20)}).select("p_brand", "p_partkey")


@query(f"""+ r AS (SELECT p_brand, min(price) AS l1, max(price) AS h1, min(neg_size) AS l2, max(neg_size) AS h2 FROM q GROUP BY 1),
d AS (SELECT p_brand, p_partkey, {_r('sqrt(CASE WHEN h1 > l1 THEN ((price - 1000) / (h1 - l1)) ** 2 ELSE 0 END + CASE WHEN h2 > l2 THEN ((neg_size + 40) / (h2 - l2)) ** 2 ELSE 0 END)')} AS distance FROM q JOIN r USING (p_brand))
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY distance, p_partkey)::INT AS rank FROM d""", PART_SQL)
def focus_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefer.focus_region(_parts(spark, sf_dir), "p_brand", "p_partkey", {"price": 1000.0, "neg_size": -40.0})


# Each point's share as the reference defines it: the area of all points less that of all others, swept over the a axis.
@query(f"""+ w AS (SELECT p_brand, max(price) * 1.1 + 1e-9 AS ra, max(neg_size + 60.0) * 1.1 + 1e-9 AS rb FROM q GROUP BY 1), z AS (SELECT p_brand, p_partkey, price AS a, (neg_size + 60.0) AS b FROM q),
cut AS (SELECT x.p_brand, x.p_partkey, y.a, min(y.b) AS b FROM z x JOIN z y ON x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey GROUP BY 1, 2, 3),
low AS (SELECT *, min(b) OVER (PARTITION BY p_brand, p_partkey ORDER BY a) AS top, lead(a) OVER (PARTITION BY p_brand, p_partkey ORDER BY a) AS nxt FROM cut),
without AS (SELECT p_brand, p_partkey, sum((coalesce(nxt, ra) - a) * (rb - top)) AS v FROM low JOIN w USING (p_brand) GROUP BY 1, 2),
one AS (SELECT p_brand, a, min(b) AS b FROM z GROUP BY 1, 2), line AS (SELECT *, min(b) OVER (PARTITION BY p_brand ORDER BY a) AS top, lead(a) OVER (PARTITION BY p_brand ORDER BY a) AS nxt FROM one),
whole AS (SELECT p_brand, sum((coalesce(nxt, ra) - a) * (rb - top)) AS v FROM line JOIN w USING (p_brand) GROUP BY 1),
s AS (SELECT p_brand, p_partkey, {_r('whole.v - coalesce(without.v, 0)', 4)} AS share FROM z JOIN whole USING (p_brand) LEFT JOIN without USING (p_brand, p_partkey))
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY share DESC, p_partkey)::INT AS rank FROM s""", PART_SQL)
def hypervolume_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("size", F.col("neg_size") + 60.0)
    return prefer.hypervolume_shares(rows, "price", "size", "p_brand", "p_partkey")


UNIT = "(('0x' || substr(md5({0}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"


@query(f"""+ v AS (SELECT p_brand, price, neg_size, p_partkey % 97 AS third FROM q WHERE price < 2200 AND neg_size < 0 AND p_partkey % 97 < 97), i AS (SELECT p_brand, min(price) AS a, min(neg_size) AS b, min(third) AS c FROM v GROUP BY 1),
d AS (SELECT p_brand, a, b, c, k, a + {UNIT.format("p_brand || ':' || k || ':0'")} * (2200 - a) AS x, b + {UNIT.format("p_brand || ':' || k || ':1'")} * (0 - b) AS y, c + {UNIT.format("p_brand || ':' || k || ':2'")} * (97 - c) AS z FROM i, range(200) t(k)),
h AS (SELECT d.p_brand, k, any_value((2200 - a) * (0 - b) * (97 - c)) AS box, bool_or(price <= x AND neg_size <= y AND third <= z) AS inside FROM d JOIN v ON d.p_brand = v.p_brand GROUP BY 1, 2)
SELECT p_brand, count(*) FILTER (WHERE inside) AS n_inside, {_r('count(*) FILTER (WHERE inside) / 200 * any_value(box)', 3)} AS hypervolume FROM h GROUP BY 1""", PART_SQL)
def hypervolume_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("third", F.col("p_partkey") % 97)
    return prefer.hypervolume_sampled(rows, ["price", "neg_size", "third"], [2200.0, 0.0, 97.0], "p_brand")


# ---------------------------------------------------------------- resampling and statistics


@query(f"""SELECT c_nationkey, c_custkey, real <= 5 AS in_top, {_r('count(*) FILTER (WHERE place <= 5) / 40')} AS frequency, {_r('count(*) FILTER (WHERE place = 1) / 40')} AS first_frequency FROM (
SELECT *, row_number() OVER (PARTITION BY c_nationkey, k ORDER BY c_acctbal + noise * sqrt(-2 * ln({UNIT.format("c_custkey || ':' || k || ':a'")})) * cos(2 * pi() * {UNIT.format("c_custkey || ':' || k || ':b'")}) DESC, c_custkey) AS place FROM (
SELECT c_nationkey, c_custkey, c_acctbal, coalesce(nullif(greatest(stddev_samp(c_acctbal) OVER w / sqrt(count(*) OVER w), 1e-15), 1e-15), 1e-6) AS noise, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS real
FROM customer WINDOW w AS (PARTITION BY c_nationkey)), range(1, 41) t(k)) GROUP BY 1, 2, 3""")
def top_k_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefer.top_k_stability(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_acctbal")


@query(f"""WITH c AS (SELECT c_nationkey, c_custkey, c_acctbal AS x, coalesce(t, 0) AS y FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM c),
p AS (SELECT c_nationkey, k, floor({UNIT.format("c_nationkey || ':' || k || ':' || pos")} * n)::INT AS pos FROM r, range(1, 41) t(k)),
e AS (SELECT p.c_nationkey, k, {_corr('x', 'y')} AS r FROM p JOIN r ON p.c_nationkey = r.c_nationkey AND p.pos = r.pos GROUP BY 1, 2),
o AS (SELECT c_nationkey, {_corr('x', 'y')} AS r FROM r GROUP BY 1)
SELECT c_nationkey, {_r('any_value(o.r)', 5)} AS r, {_r('quantile_cont(e.r, 0.025)', 5)} AS low, {_r('quantile_cont(e.r, 0.975)', 5)} AS high, {_r('stddev_samp(e.r)', 5)} AS std_error FROM e JOIN o USING (c_nationkey) GROUP BY 1""")
def correlation_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    rows = read(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("x"), F.coalesce("t", F.lit(0.0)).alias("y"))
    return prefer.correlation_interval(rows, "c_nationkey", "c_custkey", "x", "y")


@query(f"SELECT l_returnflag, count(*) AS n, {_r('avg(l_discount - l_tax)', 4)} AS mean_difference, {_r('CASE WHEN stddev_samp(l_discount - l_tax) > 0 THEN abs(avg(l_discount - l_tax)) / stddev_samp(l_discount - l_tax) ELSE 0 END', 5)} AS effect_size FROM lineitem GROUP BY 1")
def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefer.effect_sizes(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_discount", "l_tax")


@query(f"""SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY median DESC, c_nationkey)::INT AS rank FROM (SELECT c_mktsegment, c_nationkey, {_r('quantile_cont(c_acctbal, 0.5)', 4)} AS median FROM customer GROUP BY 1, 2)""")
def strategy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefer.rank_strategies(read(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal", maximize=True)


@query(f"""+ o AS (SELECT campaign_id, min(kpi) AS optimum FROM obs GROUP BY 1), g AS (SELECT campaign_id, iteration, min(kpi) OVER l - optimum AS gap, first_value(kpi) OVER l - optimum AS f FROM obs JOIN o USING (campaign_id) WINDOW l AS (PARTITION BY campaign_id ORDER BY iteration))
SELECT campaign_id, {_r('CASE WHEN any_value(f) <= 1e-10 THEN 0 ELSE least(1.0, greatest(0.0, avg(gap) / any_value(f))) END', 5)} AS auc, (CASE WHEN any_value(f) <= 1e-10 THEN 0 ELSE min(iteration) FILTER (WHERE gap <= 0.01 * f) END)::BIGINT AS converged_at FROM g GROUP BY 1""", LINE_SQL)
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = line_observations(spark, sf_dir)
    return prefer.convergence(obs, obs.groupBy("campaign_id").agg(F.min("kpi").alias("optimum")))


@query(f"SELECT o_orderpriority, count(*) AS n_trials, {_r('sum(o_totalprice * 0.01)', 2)} AS total_cost, {_r('max(o_totalprice)', 2)} AS best, {_r('avg(o_totalprice)', 4)} AS mean FROM orders GROUP BY 1")
def cost_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("cost", F.col("o_totalprice") * 0.01)
    return prefer.cost_by_level(rows, "o_orderpriority", "cost", "o_totalprice")


@query(f"SELECT campaign_id, iteration, {_r('(max(kpi) OVER (PARTITION BY campaign_id) - max(kpi) OVER l) / greatest(sum(p_quantity) OVER l, 1e-8)', 5)} AS regret FROM obs WINDOW l AS (PARTITION BY campaign_id ORDER BY iteration)", LINE_SQL)
def cost_adjusted_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefer.cost_adjusted_regret(line_observations(spark, sf_dir), "p_quantity")


@query(f"""SELECT p_partkey, {_r('v', 3)} AS value, {_r('sqrt(a + b)', 4)} AS deviation, CASE WHEN a > b THEN 'p_retailprice' ELSE 'p_size' END AS dominant, {_r('CASE WHEN a + b > 0 THEN greatest(a, b) / (a + b) ELSE 0 END', 5)} AS dominant_share
FROM (SELECT p_partkey, 0.4 * p_retailprice + 6.0 * p_size AS v, (0.4 * 0.05 * p_retailprice) ** 2 AS a, (6.0 * 0.2 * p_size) ** 2 AS b FROM part)""")
def linear_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefer.linear_uncertainty(read(spark, sf_dir, "part"), "p_partkey", {"p_retailprice": (0.4, 0.05), "p_size": (6.0, 0.2)})


@query(f"""{LONG}, r AS (SELECT campaign_id, name, is_failure, min(x) AS lo, max(x) AS hi FROM wide GROUP BY 1, 2, 3)
SELECT a.campaign_id, count(*) AS n_shared, {_r('avg(greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / greatest(greatest(a.hi, b.hi) - least(a.lo, b.lo), 1e-12))')} AS overlap FROM r a JOIN r b ON a.campaign_id = b.campaign_id AND a.name = b.name AND a.is_failure AND NOT b.is_failure GROUP BY 1""", LINE_SQL)
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.store import long_form

    obs = line_observations(spark, sf_dir).select("campaign_id", "is_failure", *PARAMS)
    spans = long_form(obs, PARAMS).groupBy("campaign_id", "name", "is_failure").agg(F.min("x").alias("lower"), F.max("x").alias("upper"))
    return prefer.range_overlap(spans.where("is_failure").drop("is_failure"), spans.where("NOT is_failure").drop("is_failure"), "campaign_id")


@query(f"""+ a AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY p_discount, iteration) - 1 AS k, count(*) OVER (PARTITION BY campaign_id) AS n FROM obs),
b AS (SELECT * EXCLUDE (k, n), p_discount >= max(p_discount) FILTER (WHERE k = n // 2) OVER (PARTITION BY campaign_id) AS high FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, high ORDER BY p_quantity, iteration) - 1 AS k, count(*) OVER (PARTITION BY campaign_id, high) AS n FROM b),
d AS (SELECT *, p_quantity >= max(p_quantity) FILTER (WHERE k = n // 2) OVER (PARTITION BY campaign_id, high) AS t FROM c)
SELECT campaign_id, high, count(*) AS n_obs, {_r('coalesce(avg(kpi) FILTER (WHERE t) - avg(kpi) FILTER (WHERE NOT t), 0)', 3)} AS effect FROM d GROUP BY 1, 2""", LINE_SQL)
def subgroup_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefer.subgroup_effects(line_observations(spark, sf_dir), "p_quantity", "p_discount")


@query("""SELECT 'r' || r_regionkey AS node, 0 AS level FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL
SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer UNION ALL SELECT DISTINCT 'o' || o_orderkey, 3 FROM orders""")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda table, parent, child, p, c: read(spark, sf_dir, table).select(F.concat(F.lit(p), parent).alias("parent"), F.concat(F.lit(c), child).alias("child"))
    edges = at("nation", "n_regionkey", "n_nationkey", "r", "n").union(at("customer", "c_nationkey", "c_custkey", "n", "c")).union(at("orders", "o_custkey", "o_orderkey", "c", "o"))
    return prefer.levels(edges, "parent", "child")


# ---------------------------------------------------------------- theory


@query(f"""SELECT p_partkey, {_r('1e6 * exp(greatest(-50000 / (8.314 * (p_size * 10)), -700))', 9)} AS arrhenius, {_r('2.5 * p_size / (20 + p_size)')} AS michaelis_menten, {_r('CASE WHEN p_size - 25 < 0 THEN -3 * (25 - p_size) ** 0.5 ELSE 3 * (p_size - 25) ** 0.5 END')} AS power_law FROM part""")
def theory_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    rate, speed, law = theory.arrhenius(size * 10, 1e6, 50000.0), theory.michaelis_menten(size, 2.5, 20.0), theory.power_law(size - 25, 3.0, 0.5)
    return read(spark, sf_dir, "part").select("p_partkey", tidy(rate, 9).alias("arrhenius"), tidy(speed).alias("michaelis_menten"), tidy(law).alias("power_law"))


@query(f"""SELECT vec_id, {_r('exp(-2 * list_sum([sin(pi() * abs(x - 0.25) / 0.5) ** 2 FOR x IN embedding]) / 16)')} AS similarity FROM embeddings""")
def periodic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    fixed = F.transform("e", lambda x: F.lit(0.25))
    return rows.select("vec_id", tidy(theory.periodic_kernel(F.col("e"), fixed, 4.0, 0.5)).alias("similarity"))


@query(f"""SELECT c_custkey, {_r('cos(radians(c_custkey % 181 - 90)) * cos(radians(c_custkey % 360 - 180))')} AS x, {_r('sin(radians(c_custkey % 181 - 90))')} AS z, {_r('(c_custkey % 181 - 90)::DOUBLE', 3)} AS latitude FROM customer""")
def sphere_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", theory.on_sphere(F.col("c_custkey") % 181 - 90, F.col("c_custkey") % 360 - 180).alias("p"))
    return rows.select("c_custkey", tidy(F.get("p", F.lit(0))).alias("x"), tidy(F.get("p", F.lit(2))).alias("z"), tidy(theory.from_sphere(F.col("p"))["latitude"], 3).alias("latitude"))


@query()
def cost_aware_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("m"), (F.col("p_size") * 10.0).alias("v"), F.lit(1000.0).alias("best"), (F.col("p_size") / 10).alias("cost"))
    ei = theory.cost_aware_improvement(F.col("m"), F.col("v"), F.col("best"), F.col("cost"))
    part = theory.cost_aware_improvement(F.col("m"), F.col("v"), F.col("best"), F.col("cost"), F.lit(0.5))
    stop = theory.stopping_index(F.col("best"), F.col("m"), F.sqrt("v"), F.col("cost"))
    return rows.select("p_partkey", tidy(ei).alias("per_cost"), tidy(part).alias("half_fidelity"), tidy(stop).alias("index"), tidy(norm_cdf((F.col("best") - F.col("m")) / F.sqrt("v"))).alias("chance"))


# ---------------------------------------------------------------- sources


def _file(spark: SparkSession, table: DataFrame, kind: str) -> str:
    """``table`` written as files in the folder that the cluster shares."""
    path = tables.shared_path(spark, kind)
    {"csv": tables.write_csv, "jsonl": tables.write_jsonl}[kind](table, path)
    return path


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS iteration, {_r('l_quantity')} AS quantity, {_r('l_extendedprice')} AS price, l_returnflag AS flag FROM lineitem""")
def csv_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("iteration"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("kpi_price"), F.col("l_returnflag").alias("flag"))
    rows = tables.observations(tables.read_csv(spark, _file(spark, lines, "csv")))
    return rows.select("iteration", tidy(F.col("parameters")["quantity"]).alias("quantity"), tidy(F.col("kpi_values")["kpi_price"]).alias("price"), F.col("metadata")["flag"].alias("flag"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return spark.read.schema(own.schema).json(_file(spark, own, "jsonl"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def json_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = read(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("["), "props", F.lit("]")).alias("text"))
    return tables.json_text(text, "text", "k string").select("event_id", "event_type", "k")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("n_nationkey"), F.lit(',"'), F.col("n_name"), F.lit('",'), F.col("n_regionkey"))
    text = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("file")).agg(F.concat(F.lit("n_nationkey,n_name,n_regionkey\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return tables.csv_text(text, "text", "n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name", "n_regionkey")


@query(f"""+ b AS (SELECT campaign_id, unnest(['p_quantity', 'p_discount', 'p_tax']) AS name, unnest([min(p_quantity), min(p_discount), min(p_tax)]) AS lo, unnest([max(p_quantity), max(p_discount), max(p_tax)]) AS hi FROM obs GROUP BY campaign_id)
SELECT campaign_id, name, {_r('lo - 0.05 * CASE WHEN hi > lo THEN hi - lo ELSE greatest(abs(lo), 1) END')} AS lower, {_r('hi + 0.05 * CASE WHEN hi > lo THEN hi - lo ELSE greatest(abs(lo), 1) END')} AS upper FROM b""", LINE_SQL)
def detected_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.detect_bounds(line_observations(spark, sf_dir), PARAMS)
