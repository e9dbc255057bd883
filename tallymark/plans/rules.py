"""Further catalogue queries: signals, rules and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EVENT_SQL, LINE_SPECS, LINE_SQL, event_observations, line_observations, read
from ..operators import decide, design, diagnostics, kernels, manage, pareto, signals, stats
from .catalogue import ORACLES, PARAMS, _corr, _r, query


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("y"))
    return vectors.withColumn("x", F.transform("y", lambda v, i: i.cast("double")))


CURVES = "c AS (SELECT vec_id, embedding::DOUBLE[] AS y, len(embedding) AS n FROM embeddings)"


@query(f"""+ p AS (SELECT *, list_max(y) AS peak FROM c)
SELECT vec_id, {_r('peak')} AS peak_value, {_r('(list_position(y, peak) - 1)::DOUBLE')} AS peak_position, {_r('list_sum([0.5 * (y[i] + y[i + 1]) FOR i IN range(1, n)])')} AS area_under_curve,
{_r('(y[n] - y[1]) / (n - 1)')} AS mean_slope, {_r('y[1]')} AS start_value, {_r('y[n]')} AS end_value, {_r('peak - list_min(y)')} AS value_range, {_r('list_stddev_pop(y)')} AS std_dev FROM p""", CURVES)
def curve_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.curve_features(_curves(spark, sf_dir), ["vec_id"], "x", "y")


@query(f"SELECT vec_id, coalesce(list_position([v >= 0.1 FOR v IN y], true) - 1, 'inf'::DOUBLE)::DOUBLE AS first_x, {_r('len([v FOR v IN y IF v >= 0.1]) / n')} AS share_over FROM c", CURVES)
def curve_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.threshold_features(_curves(spark, sf_dir), ["vec_id"], "x", "y", 0.1)


@query("""+ w AS (SELECT vec_id, unnest(range(1, n + 1)) AS i, unnest(y) AS v FROM c),
s AS (SELECT a.vec_id, a.i, any_value(a.v) AS v, avg(b.v) AS m, stddev_pop(b.v) AS s FROM w a JOIN w b ON a.vec_id = b.vec_id AND b.i BETWEEN a.i - 2 AND a.i + 2 AND a.i <> b.i GROUP BY 1, 2),
k AS (SELECT vec_id, count(*) FILTER (WHERE CASE WHEN s > 1e-9 THEN abs(v - m) > 4 * s ELSE abs(v - m) > 1e-9 END)::INT AS n_spikes FROM s GROUP BY 1)
SELECT vec_id, n_spikes, len([i FOR i IN range(1, n) IF y[i + 1] < y[i]]) / (n - 1) > 0.2 AS inconsistent, len([v FOR v IN y IF v < 0]) / n > 0.05 AS negative, len([v FOR v IN y IF v >= 0.99 * 0.25])::INT AS n_saturated FROM c JOIN k USING (vec_id)""", CURVES)
def signal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signal_checks(_curves(spark, sf_dir), ["vec_id"], "y", 0.25)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"SELECT c_custkey, {', '.join(f'''coalesce((c_mktsegment = '{s}')::INT, 0) AS is_{s.lower()}''' for s in SEGMENTS)}, (list_position({SEGMENTS!r}, c_mktsegment) - 1) / 4 AS place FROM customer")
def encode_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.ordinal(signals.one_hot(read(spark, sf_dir, "customer"), "c_mktsegment", SEGMENTS), "c_mktsegment", SEGMENTS)
    return rows.select("c_custkey", *(F.get("c_mktsegment_onehot", F.lit(i)).alias(f"is_{s.lower()}") for i, s in enumerate(SEGMENTS)), F.col("c_mktsegment_ordinal").alias("place"))


@query(f"""+ s AS (SELECT campaign_id, is_failure OR p_quantity > 45 AS is_failure, unnest(['p_quantity', 'p_discount', 'p_tax']) AS name, unnest([1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) AS low, unnest([4.9::DOUBLE, 0.01::DOUBLE, 0.008::DOUBLE]) AS step, unnest([p_quantity, p_discount, p_tax]) AS x FROM obs),
k AS (SELECT s.*, i FROM s CROSS JOIN range(1, 10) r(i)),
g AS (SELECT campaign_id, name, i, any_value(low + i * step) AS threshold, avg(is_failure::INT) FILTER (WHERE round((x - low) / step, 9) <= i) AS rb, avg(is_failure::INT) FILTER (WHERE round((x - low) / step, 9) > i) AS ra,
  count(*) FILTER (WHERE is_failure AND round((x - low) / step, 9) <= i) AS nb, count(*) FILTER (WHERE is_failure AND round((x - low) / step, 9) > i) AS na FROM k GROUP BY 1, 2, 3),
e AS (SELECT campaign_id, name, i, {_r('threshold')} AS threshold, {_r('rb')} AS rate_below, {_r('ra')} AS rate_above, CASE WHEN ra >= rb THEN na ELSE nb END AS n_supporting FROM g WHERE rb IS NOT NULL AND ra IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, name ORDER BY round(abs(rate_above - rate_below), 6) DESC, i) AS place FROM e WHERE round(abs(rate_above - rate_below), 6) > 0.3 AND n_supporting >= 3)
SELECT campaign_id, name, threshold, rate_below, rate_above, n_supporting FROM t WHERE place = 1""", LINE_SQL)
def constraint_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = line_observations(spark, sf_dir).withColumn("is_failure", F.col("is_failure") | (F.col("p_quantity") > 45))
    return decide.failure_thresholds(obs, LINE_SPECS)


LIMITS = {"p_quantity": (2.0, 48.0), "p_discount": (0.0, 0.08)}
LEVELS_SQL = """lv AS (SELECT campaign_id, iteration, CASE WHEN dq > 9.2 OR dd > 0.016 OR (dq > 0)::INT + (dd > 0)::INT > 1 THEN 'emergency' WHEN dq > 0 OR dd > 0 THEN 'danger' WHEN dq > -4.6 OR dd > -0.008 THEN 'warning' ELSE 'safe' END AS level
FROM (SELECT *, greatest(2.0 - p_quantity, p_quantity - 48.0) AS dq, greatest(0.0 - p_discount, p_discount - 0.08) AS dd FROM obs))"""


@query(f"+ {LEVELS_SQL} SELECT * FROM lv", LINE_SQL)
def safety_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.safety_levels(line_observations(spark, sf_dir), LIMITS)


@query(f"""+ {LEVELS_SQL}, n AS (SELECT campaign_id, count(*) FILTER (WHERE level = 'emergency') AS emergency, count(*) FILTER (WHERE level = 'danger') AS danger, count(*) FILTER (WHERE level = 'warning') AS warning, count(*) FILTER (WHERE level = 'safe') AS safe FROM lv GROUP BY 1)
SELECT *, CASE WHEN emergency > 0 OR danger >= 3 THEN 'stop' WHEN danger > 0 THEN 'fallback' WHEN warning > 0 THEN 'pause' ELSE 'continue' END AS action FROM n""", LINE_SQL)
def emergency_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.emergency_action(decide.safety_levels(line_observations(spark, sf_dir), LIMITS))


@query(f"""+ s AS (SELECT *, avg(kpi) OVER e AS m, stddev_pop(kpi) OVER e AS s FROM obs WINDOW e AS (PARTITION BY campaign_id))
SELECT campaign_id, iteration, {_r('greatest(0.1, least(1.0, CASE WHEN is_failure THEN 0.7 ELSE 1.0 END * coalesce(CASE WHEN s > 0 THEN greatest(0.3, 1 - abs(kpi - m) / (3 * s)) END, 1.0)))')} AS weight FROM s""", EVENT_SQL)
def credibility_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.credibility(event_observations(spark, sf_dir))


@query("""+ s AS (SELECT *, abs(kpi - avg(kpi) OVER e) > 3 * stddev_pop(kpi) OVER e AS far FROM obs WINDOW e AS (PARTITION BY campaign_id))
SELECT campaign_id, iteration, kpi FROM s WHERE NOT coalesce(far, false)""", EVENT_SQL)
def reject_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.reject_outliers(event_observations(spark, sf_dir)).select("campaign_id", "iteration", "kpi")


@query("""+ s AS (SELECT campaign_id, iteration, fidelity, kpi, row_number() OVER (PARTITION BY campaign_id, fidelity ORDER BY kpi DESC, iteration) AS place, count(*) OVER (PARTITION BY campaign_id, fidelity) AS n, max(fidelity) OVER (PARTITION BY campaign_id) AS top
FROM (SELECT *, (p_tax * 100)::INT // 3 AS fidelity FROM obs) WHERE kpi IS NOT NULL)
SELECT campaign_id, iteration, fidelity, kpi FROM s WHERE fidelity < top AND place <= greatest(1, ceil(n * 0.2))""", LINE_SQL)
def promotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = line_observations(spark, sf_dir).withColumn("fidelity", F.floor(F.round(F.col("p_tax") * 100) / 3).cast("int"))
    return decide.promotions(obs, "fidelity")


@query(f"""+ dg AS ({ORACLES['diagnostics']}), n AS (SELECT campaign_id, count(*) AS k FROM obs GROUP BY 1)
SELECT campaign_id, CASE WHEN k < 10 THEN 'cold_start' WHEN failure_rate > 0.5 OR miscalibration_score > 0.3 THEN 'stabilise' WHEN kpi_plateau_length > 0.3 * k AND exploration_coverage < 0.5 THEN 'explore'
WHEN convergence_trend > 0.3 AND variance_contraction < 0.7 THEN 'exploit' WHEN kpi_plateau_length > 0.5 * k THEN 'stop' ELSE 'learn' END AS phase FROM dg JOIN n USING (campaign_id)""", LINE_SQL)
def meta_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = line_observations(spark, sf_dir)
    sizes = obs.groupBy("campaign_id").agg(F.count("*").alias("n_trials"))
    return decide.next_phase(diagnostics.diagnostics(obs, LINE_SPECS).join(sizes, "campaign_id"))


@query(f"""+ d AS (SELECT p_partkey, p_brand, {_r('sqrt(CASE WHEN max(p_retailprice) OVER e > min(p_retailprice) OVER e THEN ((p_retailprice - 1000.0) / (max(p_retailprice) OVER e - min(p_retailprice) OVER e)) ** 2 ELSE 0 END + CASE WHEN max(p_size) OVER e > min(p_size) OVER e THEN ((p_size - 40) / (max(p_size) OVER e - min(p_size) OVER e)) ** 2 ELSE 0 END)')} AS distance FROM part WINDOW e AS (PARTITION BY p_brand))
SELECT p_partkey, p_brand, distance, row_number() OVER (PARTITION BY p_brand ORDER BY distance, p_partkey)::INT AS rank FROM d""", CURVES)
def aspiration_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    rows = parts.withColumn("distance", F.round(decide.distance_to(parts, {"p_retailprice": 1000.0, "p_size": 40.0}, ["p_brand"]), 6))
    return rows.select("p_partkey", "p_brand", "distance", F.row_number().over(Window.partitionBy("p_brand").orderBy("distance", "p_partkey")).alias("rank"))


@query(f"""+ s AS (SELECT l_suppkey, list(DISTINCT year(l_shipdate) || l_returnflag) AS names FROM lineitem GROUP BY 1)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, {_r('len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names)))')} AS overlap FROM s a JOIN s b ON b.l_suppkey = a.l_suppkey + 1""", CURVES)
def name_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.concat(F.year("l_shipdate"), "l_returnflag")).alias("names"))
    other = names.select((F.col("l_suppkey") - 1).alias("a"), F.col("names").alias("other"))
    pairs = names.join(other, F.col("l_suppkey") == F.col("a"))
    return pairs.select("a", (F.col("a") + 1).alias("b"), F.round(decide.name_overlap(F.col("names"), F.col("other")), 6).alias("overlap"))


@query(f"""+ d AS (SELECT a.campaign_id, a.kpi - b.kpi AS d FROM obs a JOIN obs b ON a.campaign_id = b.campaign_id AND b.iteration = a.iteration + 1 WHERE a.iteration % 2 = 0 AND abs(a.kpi - b.kpi) > 1e-12),
k AS (SELECT campaign_id, d, rank() OVER (PARTITION BY campaign_id ORDER BY round(abs(d), 9)) + (count(*) OVER (PARTITION BY campaign_id, round(abs(d), 9)) - 1) / 2 AS r FROM d),
s AS (SELECT campaign_id, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w FROM k GROUP BY 1),
z AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM s), t AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM z)
SELECT campaign_id, n AS n_pairs, {_r('w', 4)} AS w_plus, {_r('2 * exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))', 5)} AS p_value FROM t""", EVENT_SQL)
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = event_observations(spark, sf_dir)
    after = F.lead("kpi").over(Window.partitionBy("campaign_id").orderBy("iteration"))
    pairs = obs.withColumn("after", after).where("iteration % 2 = 0 AND after IS NOT NULL")
    return stats.wilcoxon(pairs, "campaign_id", "kpi", "after")


@query(f"""+ p AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, count(v) AS n_models, {_r('sum(v)', 3)} AS total_value, {_r('1 / (1 + coalesce(stddev_samp(v), 0))', 9)} AS agreement FROM p GROUP BY 1""", CURVES)
def ensemble_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("v"))
    found = stats.ensemble_confidence(models, "l_partkey", "v")
    return found.select("l_partkey", "n_models", F.round(F.col("mean_value") * F.col("n_models"), 3).alias("total_value"), "agreement")


NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_r(_corr(a, b), 6)} AS r FROM lineitem" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation_matrix(read(spark, sf_dir, "lineitem"), NAMES)


CHAINED = {"quantity": "l_quantity", "price": "l_extendedprice", "net": "l_extendedprice * (1 - l_discount)", "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "discount": "l_discount", "tax": "l_tax"}
CHAINED_SQL = f"""d AS (SELECT {', '.join(f'{x} AS {n}' for n, x in CHAINED.items())} FROM lineitem),
c AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {_r(_corr(a, b), 6)} AS r, count(*) AS n FROM d" for a in CHAINED for b in CHAINED if a != b)})"""


# Reaching |z| of 1.96 is having a p of 0.05 at most.
@query("""+ t AS (SELECT p.a, p.b, p.r, p.n, CASE WHEN (1 - q.r * q.r) * (1 - s.r * s.r) > 1e-12 THEN (p.r - q.r * s.r) / sqrt((1 - q.r * q.r) * (1 - s.r * s.r)) ELSE 0 END AS pr
FROM c p JOIN c q ON q.a = p.a AND q.b <> p.b JOIN c s ON s.a = p.b AND s.b = q.b WHERE list_position(['quantity', 'price', 'net', 'charge', 'discount', 'tax'], p.a) < list_position(['quantity', 'price', 'net', 'charge', 'discount', 'tax'], p.b)),
z AS (SELECT *, atanh(least(greatest(r, -0.999999), 0.999999)) * sqrt(n - 3) AS z0, atanh(least(greatest(pr, -0.999999), 0.999999)) * sqrt(n - 4) AS z1 FROM t)
SELECT a, b, any_value(r) AS r FROM z GROUP BY 1, 2 HAVING min(least(abs(z0), abs(z1))) >= 1.959964""", CHAINED_SQL)
def pc_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr(*(f"{x} AS {n}" for n, x in CHAINED.items()))
    return stats.skeleton(rows, list(CHAINED))


@query(f"""+ w AS (SELECT campaign_id, kpi AS y, unnest(['p_quantity', 'p_discount', 'p_tax']) AS model, unnest([p_quantity, p_discount, p_tax]) AS x FROM obs),
f AS (SELECT campaign_id, model, count(*) AS n, greatest(regr_syy(y, x) - coalesce(CASE WHEN regr_sxx(y, x) <> 0 THEN regr_sxy(y, x) ** 2 / regr_sxx(y, x) END, 0), 1e-12) AS rss FROM w GROUP BY 1, 2),
b AS (SELECT campaign_id, model, {_r('n * ln(rss / n) + 2 * ln(n)', 4)} AS bic FROM f)
SELECT campaign_id, model, bic, row_number() OVER (PARTITION BY campaign_id ORDER BY bic, model)::INT AS rank, {_r('least(exp((bic - min(bic) OVER (PARTITION BY campaign_id)) / 2), 1e6)', 3)} AS evidence_against FROM b""", LINE_SQL)
def model_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.compare_models(line_observations(spark, sf_dir), "campaign_id", "kpi", PARAMS)


@query(f"SELECT campaign_id, count(DISTINCT [least(49, greatest(0, floor((p_quantity - 1) / 49.0 * 50))), least(49, greatest(0, floor(p_discount / 0.1 * 50))), least(49, greatest(0, floor(p_tax / 0.08 * 50)))]) AS n_cells, {_r('count(DISTINCT [least(49, greatest(0, floor((p_quantity - 1) / 49.0 * 50))), least(49, greatest(0, floor(p_discount / 0.1 * 50))), least(49, greatest(0, floor(p_tax / 0.08 * 50)))]) / 125000.0::DOUBLE', 9)} AS share FROM obs GROUP BY 1", LINE_SQL)
def design_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.coverage(line_observations(spark, sf_dir), LINE_SPECS)


@query(f"""+ q AS (SELECT p_brand, p_partkey, p_retailprice AS price, -p_size AS neg_size FROM part),
f AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q r WHERE r.p_brand = q.p_brand AND r.price <= q.price AND r.neg_size <= q.neg_size AND (r.price < q.price OR r.neg_size < q.neg_size))),
d AS (SELECT f.p_brand, f.p_partkey, min((f.price - q.price) ** 2 + (f.neg_size - q.neg_size) ** 2) AS gap FROM f JOIN q ON q.p_brand = f.p_brand AND q.p_partkey % 2 = 0 GROUP BY 1, 2)
SELECT p_brand, count(*) AS n_points, {_r('avg(sqrt(gap))', 5)} AS distance FROM d GROUP BY 1""", CURVES)
def front_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("price"), (-F.col("p_size")).alias("neg_size"))
    return design.generational_distance(parts.where("p_partkey % 2 = 0"), pareto.front_2d(parts, "price", "neg_size", ["p_brand"]), ["price", "neg_size"], "p_brand")


@query(f"""+ c AS (SELECT DISTINCT campaign_id, place::BIGINT AS place FROM obs, range(16) AS r(place))
SELECT campaign_id, place, {', '.join(f"{s.lower}::DOUBLE + ((('0x' || substr(md5(concat_ws(':', 42, campaign_id, place, {i})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) * {s.upper - s.lower!r}::DOUBLE AS {s.name}" for i, s in enumerate(LINE_SPECS))} FROM c""", LINE_SQL)
def random_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.random_points(line_observations(spark, sf_dir), LINE_SPECS, 16)


@query(f"""+ c AS (SELECT DISTINCT campaign_id, place::BIGINT AS place FROM obs, range(16) AS r(place))
SELECT campaign_id, place, {', '.join(f"{s.lower}::DOUBLE + list_reduce([(floor((place + 43) / {b}::DOUBLE ** (k - 1)) % {b}) / {b}::DOUBLE ** k FOR k IN range(1, 16)], lambda x, y: x + y, 0.0::DOUBLE) * {s.upper - s.lower!r}::DOUBLE AS {s.name}" for b, s in zip((2, 3, 5), LINE_SPECS))} FROM c""", LINE_SQL)
def halton_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.halton(line_observations(spark, sf_dir), LINE_SPECS, 16)


@query()
def evolution_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.suggest_evolution(line_observations(spark, sf_dir), LINE_SPECS)


@query()
def covariance_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.suggest_covariance(line_observations(spark, sf_dir), LINE_SPECS)


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(f"""+ w AS (SELECT campaign_id, {', '.join(f"max(kpi) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS)} FROM obs GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY greatest({', '.join(KINDS)}) DESC NULLS LAST, campaign_id)::INT AS place FROM w""", EVENT_SQL)
def campaign_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manage.compare_campaigns(event_observations(spark, sf_dir), "event_type", KINDS)


@query(f"""SELECT campaign_id, count(*) AS total, {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in KINDS)} FROM obs GROUP BY 1""", EVENT_SQL)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manage.status_counts(event_observations(spark, sf_dir), "campaign_id", "event_type", KINDS)


@query(f"""+ p AS (SELECT p_brand, p_partkey, p_size::DOUBLE AS d, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1) // 4 AS batch FROM part),
b AS (SELECT p_brand, batch, max(d) AS m FROM p GROUP BY 1, 2),
s AS (SELECT p_brand, batch, {_r('coalesce(sum(m) OVER (PARTITION BY p_brand ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 2)} AS starts FROM b)
SELECT p_brand, p_partkey, batch, starts FROM p JOIN s USING (p_brand, batch)""", CURVES)
def batch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manage.schedule(read(spark, sf_dir, "part").withColumn("d", F.col("p_size").cast("double")), "p_brand", "p_partkey", "d", 4)


@query("""+ b AS (SELECT campaign_id, iteration, max(CASE WHEN NOT is_failure THEN kpi END) OVER (PARTITION BY campaign_id ORDER BY iteration) AS best FROM obs),
l AS (SELECT *, best - lag(best, 15) OVER (PARTITION BY campaign_id ORDER BY iteration) AS gain FROM b),
w AS (SELECT campaign_id, iteration, CASE WHEN iteration + 1 >= 60 THEN 'trials' WHEN gain < 0.5 THEN 'stagnation' END AS why FROM l)
SELECT campaign_id, iteration, why FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY iteration) AS k FROM w WHERE why IS NOT NULL) WHERE k = 1""", EVENT_SQL)
def stopping_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manage.stop_at(event_observations(spark, sf_dir), 15, 0.5, 60)


@query(f"""+ d AS (SELECT campaign_id, iteration, kpi - avg(kpi) OVER (PARTITION BY campaign_id) AS d FROM obs), l AS (SELECT *, lag(d) OVER (PARTITION BY campaign_id ORDER BY iteration) AS b FROM d)
SELECT campaign_id, {_r('coalesce(CASE WHEN sum(d * d) > 0 THEN sum(d * b) / sum(d * d) END, 0)')} AS r1 FROM l GROUP BY 1""", EVENT_SQL)
def lag1_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manage.lag1_autocorrelation(event_observations(spark, sf_dir))


@query(f"""+ n AS (SELECT campaign_id, iteration, kpi, count(*) OVER (PARTITION BY campaign_id) AS n FROM obs)
SELECT campaign_id, {_r('sum(kpi * 0.8::DOUBLE ** (n - 1 - iteration) * CASE WHEN iteration = 0 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END)')} AS ema FROM n GROUP BY 1""", EVENT_SQL)
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manage.smoothed(event_observations(spark, sf_dir), 0.2)


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'secret') ORDER BY n_chars DESC, doc_id LIMIT 20")
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manage.search_records(read(spark, sf_dir, "documents"), "doc_id", "text", "n_chars", ["token", "secret"], 20)


@query(f"""+ s AS (SELECT l_returnflag, l_suppkey, count(*) AS n, {_r("avg((l_discount > 0.05)::INT) * least(1.0, count(*) / 5) - avg((l_tax > 0.06)::INT)")} AS score FROM lineitem GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_suppkey)::INT AS rank FROM s""", CURVES)
def rank_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manage.rank_backends(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", F.col("l_discount") > 0.05, F.col("l_tax") > 0.06)


@query(f"""+ m AS (SELECT c_nationkey, row_number() OVER o AS rank, c_acctbal - lead(c_acctbal) OVER o AS margin, max(c_acctbal) OVER e - min(c_acctbal) OVER e AS span FROM customer WINDOW o AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), e AS (PARTITION BY c_nationkey))
SELECT c_nationkey, count(*) AS n_margins, count(*) FILTER (WHERE margin < 0.01 * span) AS n_unstable, {_r('max(margin) FILTER (WHERE rank = 1)', 4)} AS top_margin FROM m WHERE margin IS NOT NULL GROUP BY 1""", CURVES)
def decision_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manage.decision_stability(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_acctbal", 0.01)
