"""Every query of the campaign operators by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT_SQL, LINE_SPECS, LINE_SQL, event_observations, line_observations, read
from ..operators import compare, diagnostics, graph, insight, kernels, pareto, search, store, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "diagnostics"
PARAMS = [s.name for s in LINE_SPECS]


def query(sql: str | None = None, base: str | None = None):
    """Register a query; ``base`` is a common table that its SQL starts from."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            head = f"WITH {base}" if base else ""
            joint = ", " if base and sql.lstrip().startswith("+") else " "
            ORACLES[f.__name__] = head + joint + sql.lstrip().removeprefix("+")
        return f

    return put


# A column's rounding and sign of zero, the same on both sides.
def _r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


LONG = "+ wide AS (SELECT campaign_id, iteration, kpi, is_failure, unnest(['p_quantity', 'p_discount', 'p_tax']) AS name, unnest([p_quantity, p_discount, p_tax]) AS x FROM obs)"


def _corr(x: str, y: str, where: str = "true") -> str:
    f = f"FILTER (WHERE {where})"
    return f"CASE WHEN stddev_pop({x}) {f} * stddev_pop({y}) {f} > 1e-12 THEN covar_pop({x}, {y}) {f} / (stddev_pop({x}) {f} * stddev_pop({y}) {f}) ELSE 0 END"


# ---------------------------------------------------------------- store


@query("SELECT campaign_id, iteration, kpi FROM obs WHERE iteration BETWEEN 10 AND 60 AND NOT is_failure", LINE_SQL)
def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.query(line_observations(spark, sf_dir), iterations=(10, 60), only_successful=True)
    return rows.select("campaign_id", "iteration", "kpi")


@query("SELECT campaign_id, count(*) AS n_rows, count(*) FILTER (WHERE NOT is_failure) AS n_successful, count(*) FILTER (WHERE is_failure) AS n_failed, min(iteration) AS first_iteration, max(iteration) AS last_iteration FROM obs GROUP BY 1", LINE_SQL)
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.summary(line_observations(spark, sf_dir))


@query("SELECT DISTINCT campaign_id FROM obs", EVENT_SQL)
def list_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.campaigns(event_observations(spark, sf_dir))


@query("SELECT user_id AS campaign_id, coalesce(json_extract_string(props, '$.k'), event_type) AS value, count(*) AS n FROM events GROUP BY ALL")
def column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_observations(spark, sf_dir).drop("event_type", "ts", "kpi").join(read(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k")), "event_id")
    return store.column_values(rows, "k", "event_type").groupBy("campaign_id", "value").agg(F.count("*").alias("n"))


@query(f"""+ w AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_extendedprice']) AS name, unnest([l_quantity, l_discount, l_tax, l_extendedprice]) AS x FROM lineitem)
SELECT name, count(x) AS n_values, count(*) - count(x) AS n_nulls, count(DISTINCT x) AS n_unique, {_r('min(x)')} AS min_value, {_r('max(x)')} AS max_value, {_r('avg(x)', 4)} AS mean_value, {_r('stddev_pop(x)', 4)} AS std_value FROM w GROUP BY name""", LINE_SQL)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.column_profile(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])


@query("""SELECT name, n_values, CASE WHEN i = n_values THEN 'integer' WHEN f = n_values THEN 'float' WHEN b = n_values THEN 'boolean' WHEN f > 0 OR b > 0 THEN 'mixed' ELSE 'string' END AS kind FROM (
SELECT name, count(*) AS n_values, count(*) FILTER (WHERE regexp_matches(x, '^[+-]?[0-9]+$')) AS i, count(*) FILTER (WHERE try_cast(x AS DOUBLE) IS NOT NULL) AS f, count(*) FILTER (WHERE lower(x) IN ('true', 'false')) AS b
FROM (SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS name, unnest([o_orderkey::VARCHAR, o_orderstatus, o_totalprice::VARCHAR, o_orderpriority]) AS x FROM orders) WHERE trim(x) <> '' GROUP BY name)""")
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.infer_types(read(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@query("""+ s AS (SELECT name, count(x) AS n_values, count(DISTINCT x) AS n_unique, lower(name) AS low FROM (
SELECT unnest(['campaign_id', 'iteration', 'p_quantity', 'kpi', 'm_code', 'flat', 'end_date']) AS name, unnest([campaign_id::DOUBLE, iteration::DOUBLE, p_quantity, kpi, p_tax, 1.0, p_discount]) AS x FROM obs) GROUP BY name)
SELECT name, n_values, n_unique, CASE WHEN low[1:4] IN ('iter', 'step') OR low[1:5] = 'trial' THEN 'iteration' WHEN contains(low, 'time') OR contains(low, 'date') OR low = 'ts' THEN 'timestamp'
WHEN low[1:3] IN ('kpi', 'obj') OR suffix(low, 'yield') OR suffix(low, 'price') OR suffix(low, 'score') THEN 'kpi' WHEN suffix(low, '_id') OR suffix(low, 'key') OR low = 'id' THEN 'identifier'
WHEN low[1:2] = 'm_' THEN 'metadata' WHEN low[1:2] = 'p_' OR n_unique > 1 THEN 'parameter' ELSE 'unknown' END AS role FROM s""", LINE_SQL)
def role_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_observations(spark, sf_dir).withColumns({"m_code": F.col("p_tax"), "flat": F.lit(1.0), "end_date": F.col("p_discount")})
    return store.infer_roles(rows, ["campaign_id", "iteration", "p_quantity", "kpi", "m_code", "flat", "end_date"])


@query(f"""+ q AS (SELECT campaign_id, quantile_cont(kpi, 0.25) AS q1, quantile_cont(kpi, 0.75) AS q3 FROM obs GROUP BY 1)
SELECT campaign_id, iteration, {_r('kpi')} AS value FROM obs JOIN q USING (campaign_id) WHERE kpi < q1 - 1.5 * (q3 - q1) OR kpi > q3 + 1.5 * (q3 - q1)""", EVENT_SQL)
def iqr_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.iqr_anomalies(event_observations(spark, sf_dir))


@query(f"""SELECT name, count(*) - count(x) AS n_missing, {_r('(count(*) - count(x)) / count(*)')} AS share FROM (
SELECT unnest(['lang', 'source', 'text', 'doc_id']) AS name, unnest([lang, source, text, doc_id::VARCHAR]) AS x FROM documents) GROUP BY name""")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.missing_report(read(spark, sf_dir, "documents"), ["lang", "source", "text", "doc_id"])


# ---------------------------------------------------------------- ranking


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_k(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 20)


@query("SELECT * FROM (SELECT campaign_id, iteration, kpi, row_number() OVER (PARTITION BY campaign_id ORDER BY kpi DESC, iteration)::INT AS rank FROM obs WHERE NOT is_failure) WHERE rank <= 10", LINE_SQL)
def top_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = line_observations(spark, sf_dir).where("NOT is_failure").select("campaign_id", "iteration", "kpi")
    return store.top_k(good, "kpi", ["iteration"], 10, ["campaign_id"])


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.ranking(read(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", "c_custkey").select("c_custkey", "c_nationkey", "rank")


@query(f"""+ s AS (SELECT campaign_id, avg(kpi) AS m, stddev_pop(kpi) AS s FROM obs GROUP BY 1)
SELECT campaign_id, iteration, {_r('(kpi - m) / s', 5)} AS z FROM obs JOIN s USING (campaign_id) WHERE s > 0 AND abs((kpi - m) / s) > 2""", EVENT_SQL)
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.zscore_outliers(event_observations(spark, sf_dir))


@query(f"""+ r AS (SELECT l_shipdate_year, l_suppkey, sum(l_extendedprice * l_discount) AS regret FROM (SELECT year(l_shipdate) AS l_shipdate_year, * FROM lineitem) GROUP BY 1, 2),
p AS (SELECT *, rank() OVER (PARTITION BY l_shipdate_year ORDER BY round(regret, 2)) AS place FROM r)
SELECT l_suppkey, count(*) AS n_scenarios, count(*) FILTER (WHERE place = 1) AS wins, {_r('avg(place)')} AS mean_rank, {_r('avg(round(regret, 2))', 4)} AS mean_regret FROM p GROUP BY 1""", LINE_SQL)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("regret"))
    return compare.leaderboard(lines, "year", "l_suppkey", "regret")


# ---------------------------------------------------------------- windows


@query("SELECT campaign_id, iteration, max(CASE WHEN NOT is_failure THEN kpi END) OVER (PARTITION BY campaign_id ORDER BY iteration) AS best FROM obs", LINE_SQL)
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.best_so_far(line_observations(spark, sf_dir))


@query(f"SELECT campaign_id, iteration, {_r('avg(kpi) OVER (PARTITION BY campaign_id ORDER BY iteration ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 4)} AS smooth FROM obs", EVENT_SQL)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.moving_average(event_observations(spark, sf_dir), 5)


@query(f"""+ s AS (SELECT campaign_id, iteration, sum(p_quantity) OVER o AS spent, max(kpi) OVER (PARTITION BY campaign_id) - max(kpi) OVER o AS gap FROM obs WINDOW o AS (PARTITION BY campaign_id ORDER BY iteration))
SELECT campaign_id, iteration, {_r('spent')} AS spent, {_r('CASE WHEN spent > 0 THEN gap / spent ELSE 0 END')} AS regret_per_cost FROM s""", LINE_SQL)
def cumulative_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cumulative_cost(line_observations(spark, sf_dir))


@query(f"""+ a AS (SELECT campaign_id, iteration, max(iteration) OVER (PARTITION BY campaign_id) - iteration AS age, count(*) OVER (PARTITION BY campaign_id) AS n FROM obs)
SELECT campaign_id, iteration, {_r('exp(-0.01 * age)')} AS exponential, (age < 50)::DOUBLE AS sliding, {_r('(n - age) / n')} AS linear FROM a""", EVENT_SQL)
def time_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.time_weights(event_observations(spark, sf_dir))


@query(f"""+ d AS (SELECT campaign_id, iteration, kpi - avg(kpi) OVER (PARTITION BY campaign_id) AS d FROM obs),
l AS (SELECT d.campaign_id, k, d.d, d.d * e.d AS product FROM d CROSS JOIN (VALUES (3), (4), (5), (6), (7)) v(k) LEFT JOIN d e ON e.campaign_id = d.campaign_id AND e.iteration = d.iteration - k),
r AS (SELECT campaign_id, k, coalesce(CASE WHEN sum(d * d) > 0 THEN sum(product) / sum(d * d) END, 0) AS r FROM l GROUP BY 1, 2),
t AS (SELECT campaign_id, k, r, row_number() OVER (PARTITION BY campaign_id ORDER BY round(r, 6) DESC, k) AS place FROM r)
SELECT campaign_id, k AS period, {_r('r')} AS strength, r > 0.5 AS seasonal FROM t WHERE place = 1""", EVENT_SQL)
def seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.season(event_observations(spark, sf_dir), range(3, 8))


@query(f"""+ s AS (SELECT campaign_id, iteration, count(kpi) OVER b AS n1, sum(kpi) OVER b AS s1, count(kpi) OVER e AS n, sum(kpi) OVER e AS s, stddev_pop(kpi) OVER e AS sd FROM obs
  WINDOW b AS (PARTITION BY campaign_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e AS (PARTITION BY campaign_id)),
g AS (SELECT campaign_id, iteration, {_r('abs(s1 / n1 - (s - s1) / (n - n1)) / sd')} AS gap FROM s WHERE n1 >= 5 AND n - n1 >= 5 AND sd > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY gap DESC, iteration) AS place FROM g)
SELECT campaign_id, iteration AS split_at, gap FROM t WHERE place = 1""", EVENT_SQL)
def regime_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.regime_change(event_observations(spark, sf_dir))


@query("SELECT * FROM (SELECT campaign_id, iteration, lag(event_type) OVER (PARTITION BY campaign_id ORDER BY iteration) AS from_phase, event_type AS to_phase FROM obs) WHERE from_phase <> to_phase", EVENT_SQL)
def phase_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.phase_transitions(event_observations(spark, sf_dir), "event_type")


@query(f"""+ h AS (SELECT campaign_id, kpi, iteration * 2 >= count(*) OVER (PARTITION BY campaign_id) AS late, max(kpi) OVER (PARTITION BY campaign_id ORDER BY iteration) AS best FROM obs)
SELECT campaign_id, {_r('avg(kpi) FILTER (WHERE NOT late)', 8)} AS early_mean, {_r('avg(kpi) FILTER (WHERE late)', 8)} AS late_mean, {_r('stddev_samp(kpi) FILTER (WHERE NOT late)', 8)} AS early_sd, {_r('stddev_samp(kpi) FILTER (WHERE late)', 8)} AS late_sd,
{_r('max(best) - max(best) FILTER (WHERE NOT late)', 8)} AS late_gain FROM h GROUP BY 1""", EVENT_SQL)
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trends(event_observations(spark, sf_dir))


@query(f"""+ b AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY iteration DESC) AS back FROM obs),
w AS (SELECT campaign_id, kpi, back <= 10 AS fresh, unnest(['p_quantity', 'p_discount', 'p_tax']) AS name, unnest([p_quantity, p_discount, p_tax]) AS x FROM b WHERE back <= 20)
SELECT campaign_id, name, {_r(_corr('x', 'kpi', 'NOT fresh'), 5)} AS corr_before, {_r(_corr('x', 'kpi', 'fresh'), 5)} AS corr_after,
{_r('CASE WHEN stddev_pop(x) > 0 THEN (avg(x) FILTER (WHERE fresh) - avg(x) FILTER (WHERE NOT fresh)) / stddev_pop(x) ELSE 0 END', 5)} AS mean_shift FROM w GROUP BY 1, 2""", LINE_SQL)
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drift_report(line_observations(spark, sf_dir), PARAMS)


@query(f"""+ b AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY iteration DESC) <= 10 AS fresh, row_number() OVER (PARTITION BY campaign_id ORDER BY iteration DESC) AS back FROM obs),
g AS (SELECT campaign_id, abs(avg(kpi) FILTER (WHERE fresh) - avg(kpi) FILTER (WHERE NOT fresh)) AS gap, sqrt(var_samp(kpi) FILTER (WHERE fresh) / count(kpi) FILTER (WHERE fresh) + var_samp(kpi) FILTER (WHERE NOT fresh) / count(kpi) FILTER (WHERE NOT fresh)) AS e FROM b WHERE back <= 20 GROUP BY 1)
SELECT campaign_id, {_r('coalesce(CASE WHEN e > 0 THEN least(1.0, gap / e / 4) END, 0)', 5)} AS shift FROM g""", LINE_SQL)
def kpi_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.kpi_shift(line_observations(spark, sf_dir))


DIAGNOSTICS_SQL = f"""+ a AS (
  SELECT *, NOT is_failure AND kpi IS NOT NULL AS ok, CASE WHEN NOT is_failure THEN kpi END AS v FROM obs),
b AS (
  SELECT *, count(*) OVER e AS n_all, count(v) OVER e AS n, row_number() OVER l AS at_all, count(v) OVER l AS pos, max(v) OVER l AS best,
         max(v) OVER e - min(v) OVER e AS spread, avg(v) OVER q AS pm, stddev_pop(v) OVER q AS ps
  FROM a WINDOW e AS (PARTITION BY campaign_id), l AS (PARTITION BY campaign_id ORDER BY iteration), q AS (PARTITION BY campaign_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT *, greatest(floor(n * 0.25), 1) AS w, greatest(floor(n_all * 0.25), 1) AS wa FROM b),
g AS (
  SELECT *, lag(best) OVER s AS prior FROM c WHERE ok WINDOW s AS (PARTITION BY campaign_id ORDER BY iteration)),
h AS (
  SELECT *, last_value(CASE WHEN best = v AND (prior IS NULL OR prior <> best) THEN p_quantity END IGNORE NULLS) OVER s AS b1,
         last_value(CASE WHEN best = v AND (prior IS NULL OR prior <> best) THEN p_discount END IGNORE NULLS) OVER s AS b2,
         last_value(CASE WHEN best = v AND (prior IS NULL OR prior <> best) THEN p_tax END IGNORE NULLS) OVER s AS b3
  FROM g WINDOW s AS (PARTITION BY campaign_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (
  SELECT *, (abs(b1 - lag(b1) OVER s) + abs(b2 - lag(b2) OVER s) + abs(b3 - lag(b3) OVER s)) / 3 AS moved, pos > n - w AS recent FROM h WINDOW s AS (PARTITION BY campaign_id ORDER BY iteration)),
good AS (
  SELECT campaign_id, any_value(n) AS n, max(v) AS hi, min(v) AS lo, min_by(v, pos) AS first_value, regr_slope(best, iteration::DOUBLE) AS slope, max(iteration) - min(iteration) AS reach,
         max(v) FILTER (WHERE recent) - min(v) FILTER (WHERE recent) AS nr, coalesce(max(v) FILTER (WHERE NOT recent) - min(v) FILTER (WHERE NOT recent), 0) AS orr,
         var_pop(v) AS va, var_pop(v) FILTER (WHERE recent) AS vn, avg(v) FILTER (WHERE recent) AS mn, avg(moved) FILTER (WHERE pos > n - w + 1) AS moved,
         max(pos) FILTER (WHERE abs(best - prior) > 0.01 * spread) AS step_at,
         avg((CASE WHEN ps = 0 THEN v = pm ELSE abs(v - pm) <= 2 * ps END)::INT) FILTER (WHERE pos >= 4) AS inside,
         count(DISTINCT [least(floor(greatest(0, least(1, (p_quantity - 1.0) / 49.0)) * 10), 9), least(floor(greatest(0, least(1, p_discount / 0.1)) * 10), 9), least(floor(greatest(0, least(1, p_tax / 0.08)) * 10), 9)]) AS cells
  FROM k GROUP BY campaign_id),
every AS (
  SELECT campaign_id, any_value(n_all) AS n_all, avg(is_failure::INT) AS fr, avg(is_failure::INT) FILTER (WHERE at_all > n_all - wa) AS fn, avg(is_failure::INT) FILTER (WHERE at_all <= wa) AS fo,
         avg((p_quantity < 1 OR p_quantity > 50 OR p_discount < 0 OR p_discount > 0.1 OR p_tax < 0 OR p_tax > 0.08)::INT) AS violations
  FROM c GROUP BY campaign_id)
SELECT campaign_id,
  {_r('CASE WHEN n >= 2 AND hi > lo AND reach > 0 THEN greatest(-1.0, least(1.0, slope * reach / (hi - lo))) ELSE 0 END')} AS convergence_trend,
  {_r('CASE WHEN n >= 2 AND nr + orr > 0 THEN greatest(-1.0, least(1.0, (nr - orr) / (nr + orr))) ELSE 0 END')} AS improvement_velocity,
  {_r('CASE WHEN n >= 2 AND va > 0 THEN vn / va ELSE 1 END')} AS variance_contraction,
  {_r('CASE WHEN n >= 2 AND mn <> 0 THEN sqrt(vn) / abs(mn) ELSE 0 END')} AS noise_estimate,
  {_r('fr')} AS failure_rate, {_r('CASE WHEN fr > 0 THEN fn / fr ELSE 0 END')} AS failure_clustering, {_r('CASE WHEN n_all >= 2 THEN fo - fn ELSE 0 END')} AS feasibility_shrinkage,
  {_r('coalesce(moved, 0)')} AS parameter_drift, {_r('CASE WHEN n >= 2 AND mn <> 0 THEN sqrt(vn) / abs(mn) ELSE 0 END')} AS model_uncertainty,
  {_r('cells / 1000.0::DOUBLE')} AS exploration_coverage,
  {_r('(CASE WHEN n < 2 THEN 0 WHEN hi = lo THEN n - 1 ELSE n - coalesce(step_at, 1) END)::DOUBLE')} AS kpi_plateau_length,
  {_r('coalesce(hi, 0)')} AS best_kpi_value, {_r('CASE WHEN n >= 2 THEN (hi - first_value) / n_all ELSE 0 END')} AS data_efficiency, {_r('violations')} AS constraint_violation_rate,
  {_r('coalesce(least(abs(inside - 0.9545::DOUBLE), 1.0), 0)')} AS miscalibration_score, {_r('coalesce(greatest(0.0, least(1.0, (1 - inside - (1 - 0.9545::DOUBLE)) / 0.9545::DOUBLE)), 0)')} AS overconfidence_rate,
  {_r('CASE WHEN n < 2 THEN 0 WHEN vn = 0 THEN CASE WHEN mn = 0 THEN 0 ELSE 100 END ELSE least(100.0, abs(mn) / sqrt(vn)) END')} AS signal_to_noise_ratio
FROM good JOIN every USING (campaign_id)"""


@query(DIAGNOSTICS_SQL, LINE_SQL)
def diagnostics_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.diagnostics(line_observations(spark, sf_dir), LINE_SPECS)


QUERIES["diagnostics"] = QUERIES.pop("diagnostics_17")
ORACLES["diagnostics"] = ORACLES.pop("diagnostics_17")


# ---------------------------------------------------------------- insight


@query(f"{LONG} SELECT campaign_id, name, count(x) AS n, {_r(_corr('x', 'kpi'), 5)} AS r FROM wide WHERE NOT is_failure GROUP BY 1, 2 HAVING count(x) >= 5", LINE_SQL)
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.correlations(line_observations(spark, sf_dir), PARAMS)


@query(f"""+ p AS (SELECT campaign_id, kpi, unnest(['p_quantity', 'p_quantity', 'p_discount']) AS a, unnest(['p_discount', 'p_tax', 'p_tax']) AS b, unnest([p_quantity * p_discount, p_quantity * p_tax, p_discount * p_tax]) AS x FROM obs WHERE NOT is_failure)
SELECT campaign_id, a, b, count(x) AS n, {_r(_corr('x', 'kpi'), 5)} AS r FROM p GROUP BY 1, 2, 3 HAVING count(x) >= 10""", LINE_SQL)
def interaction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.interactions(line_observations(spark, sf_dir), PARAMS)


@query(f"""+ o AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY kpi DESC, iteration) <= greatest(floor(count(*) OVER (PARTITION BY campaign_id) * 0.2), 3) AS top FROM obs WHERE NOT is_failure),
w AS (SELECT campaign_id, kpi, top, unnest(['p_quantity', 'p_discount', 'p_tax']) AS name, unnest([p_quantity, p_discount, p_tax]) AS x FROM o),
z AS (SELECT *, min(CASE WHEN top THEN x END) OVER (PARTITION BY campaign_id, name) AS low, max(CASE WHEN top THEN x END) OVER (PARTITION BY campaign_id, name) AS high FROM w)
SELECT campaign_id, name, any_value(low) AS low, any_value(high) AS high, {_r('avg(kpi) FILTER (WHERE x BETWEEN low AND high)', 4)} AS mean_inside, {_r('avg(kpi) FILTER (WHERE NOT x BETWEEN low AND high)', 4)} AS mean_outside FROM z GROUP BY 1, 2""", LINE_SQL)
def optimal_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.optimal_regions(line_observations(spark, sf_dir), PARAMS)


@query(f"""{LONG}, b AS (SELECT campaign_id, name, x, row_number() OVER (PARTITION BY campaign_id, name ORDER BY x) - 1 AS pos, count(*) OVER (PARTITION BY campaign_id, name) AS n FROM wide WHERE is_failure),
z AS (SELECT campaign_id, name, max(x) FILTER (WHERE pos = n // 4) AS low, max(x) FILTER (WHERE pos = least(n - 1, 3 * n // 4)) AS high FROM b GROUP BY 1, 2),
r AS (SELECT campaign_id, name, any_value(low) AS low, any_value(high) AS high, avg(is_failure::INT) FILTER (WHERE x BETWEEN low AND high) AS zr, avg(is_failure::INT) AS r FROM wide JOIN z USING (campaign_id, name) GROUP BY 1, 2)
SELECT campaign_id, name, low, high, {_r('zr')} AS zone_rate, {_r('r')} AS rate, zr > 1.5 * r AS risky FROM r""", LINE_SQL)
def failure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.failure_patterns(line_observations(spark, sf_dir), PARAMS)


@query(f"""{LONG}, s(name, lo, hi) AS (VALUES ('p_quantity', 1.0::DOUBLE, 50.0::DOUBLE), ('p_discount', 0.0::DOUBLE, 0.1::DOUBLE), ('p_tax', 0.0::DOUBLE, 0.08::DOUBLE))
SELECT campaign_id, name, least(9, greatest(0, floor((x - lo) / (hi - lo) * 10)))::BIGINT AS bin, count(*) AS n, {_r('avg(is_failure::INT)')} AS rate FROM wide JOIN s USING (name) WHERE x IS NOT NULL GROUP BY 1, 2, 3""", LINE_SQL)
def failure_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.failure_density(line_observations(spark, sf_dir), LINE_SPECS)


@query(f"""{LONG}, s(name, lo, hi) AS (VALUES ('p_quantity', 1.0::DOUBLE, 50.0::DOUBLE), ('p_discount', 0.0::DOUBLE, 0.1::DOUBLE), ('p_tax', 0.0::DOUBLE, 0.08::DOUBLE)),
m AS (SELECT campaign_id, name, min(x) AS a, max(x) AS b FROM wide WHERE NOT is_failure GROUP BY 1, 2)
SELECT campaign_id, name, {_r('greatest(lo, a - (b - a) * 0.05)')} AS low, {_r('least(hi, b + (b - a) * 0.05)')} AS high FROM m JOIN s USING (name)""", LINE_SQL)
def safety_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.safe_bounds(line_observations(spark, sf_dir), LINE_SPECS)


@query(f"""{LONG}, p AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, name ORDER BY x, iteration) - 1 AS pos, count(*) OVER (PARTITION BY campaign_id, name) AS n FROM wide),
z AS (SELECT campaign_id, name, CASE WHEN pos < n // 2 THEN 'low' ELSE 'high' END AS half, min(x) AS low, max(x) AS high, {_r('avg(is_failure::INT)')} AS rate FROM p GROUP BY 1, 2, 3)
SELECT * FROM z WHERE rate >= 0.33""", LINE_SQL)
def danger_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.danger_zones(line_observations(spark, sf_dir), PARAMS, 0.33)


@query(f"""+ o AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY campaign_id) * 0.2), 2) AS k, row_number() OVER (PARTITION BY campaign_id ORDER BY kpi DESC, iteration) AS place, row_number() OVER (PARTITION BY campaign_id ORDER BY kpi, iteration DESC) AS back FROM obs WHERE NOT is_failure),
w AS (SELECT campaign_id, kpi, CASE WHEN place <= k THEN 1 WHEN back <= k THEN -1 ELSE 0 END AS side, unnest(['p_quantity', 'p_discount', 'p_tax']) AS name, unnest([p_quantity, p_discount, p_tax]) AS x FROM o),
s AS (SELECT campaign_id, name, abs({_corr('x', 'kpi')}) AS c, var_samp(x) AS v, var_samp(x) FILTER (WHERE side = 1) AS vt, var_samp(x) FILTER (WHERE side = -1) AS vb, avg(x) FILTER (WHERE side = 1) AS mt, avg(x) FILTER (WHERE side = -1) AS mb, count(x) FILTER (WHERE side = 1) AS nt, count(x) FILTER (WHERE side = -1) AS nb FROM w GROUP BY 1, 2)
SELECT campaign_id, name, {_r('c', 5)} AS correlation, {_r('CASE WHEN v > 0 THEN greatest(0.0, 1 - vt / v) ELSE 0 END', 5)} AS contraction, {_r('CASE WHEN vt / nt + vb / nb > 0 THEN (mt - mb) ** 2 / (vt / nt + vb / nb) ELSE 0 END', 4)} AS contrast FROM s""", LINE_SQL)
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.importance(line_observations(spark, sf_dir), PARAMS)


@query(f"""+ o AS (SELECT campaign_id, kpi, least(4, greatest(0, floor((p_quantity - 1) / 49.0 * 5))) AS bin FROM obs WHERE NOT is_failure),
i AS (SELECT campaign_id, bin, count(kpi) AS n, avg(kpi) AS m, var_pop(kpi) AS v FROM o GROUP BY 1, 2),
p AS (SELECT campaign_id, avg(v) FILTER (WHERE n >= 2) AS w, var_pop(m) AS b FROM i GROUP BY 1), t AS (SELECT campaign_id, var_pop(kpi) AS t FROM o GROUP BY 1)
SELECT campaign_id, {_r('sqrt(w)', 4)} AS within_sd, {_r('sqrt(b)', 4)} AS between_sd, {_r('sqrt(t)', 4)} AS total_sd FROM p JOIN t USING (campaign_id)""", LINE_SQL)
def noise_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.noise_decomposition(line_observations(spark, sf_dir), LINE_SPECS[0])


@query(f"""+ o AS (SELECT campaign_id, kpi, iteration, iteration // 10 AS b, count(*) OVER (PARTITION BY campaign_id) AS n FROM obs),
q AS (SELECT campaign_id, kpi, CASE WHEN n % 10 = 1 AND iteration = n - 1 AND b > 0 THEN b - 1 ELSE b END AS b FROM o),
g AS (SELECT campaign_id, b, count(*) AS n, avg(kpi) AS m, var_pop(kpi) AS v FROM q GROUP BY 1, 2),
u AS (SELECT *, sum(n * m) OVER (PARTITION BY campaign_id) / sum(n) OVER (PARTITION BY campaign_id) AS mean FROM g),
s AS (SELECT campaign_id, count(*) AS k, sum(n) AS n, sum(n * (m - mean) ** 2) AS ssb, sum(n * v) AS ssw FROM u GROUP BY 1),
f AS (SELECT *, CASE WHEN k > 1 AND n > k AND ssw > 0 THEN (ssb / (k - 1)) / (ssw / (n - k)) ELSE 0 END AS f FROM s)
SELECT campaign_id, k AS n_batches, {_r('f', 5)} AS f_statistic, {_r('CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) ELSE 0 END', 5)} AS eta_squared, f > 3 AS detected FROM f""", LINE_SQL)
def batch_effects_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.batch_effects(line_observations(spark, sf_dir))


@query(f"""{LONG}, s(name, lo, hi) AS (VALUES ('p_quantity', 1.0::DOUBLE, 50.0::DOUBLE), ('p_discount', 0.0::DOUBLE, 0.1::DOUBLE), ('p_tax', 0.0::DOUBLE, 0.08::DOUBLE)),
c AS (SELECT campaign_id, name, least(4, greatest(0, floor((x - lo) / (hi - lo) * 5))) AS bin, count(kpi) AS n, avg(kpi) AS m, stddev_pop(kpi) AS s FROM wide JOIN s USING (name) WHERE NOT is_failure GROUP BY 1, 2, 3),
r AS (SELECT campaign_id, name, max(s / abs(m)) AS h, min(s / abs(m)) AS l FROM c WHERE n >= 2 AND m <> 0 GROUP BY 1, 2)
SELECT campaign_id, name, {_r('CASE WHEN l > 0 THEN h / l ELSE 0 END', 5)} AS cv_ratio, l > 0 AND h / l > 3 AS uneven FROM r""", LINE_SQL)
def heteroscedasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.heteroscedasticity(line_observations(spark, sf_dir), LINE_SPECS)


@query(f"""+ f AS (SELECT campaign_id, avg(kpi) AS a, quantile_cont(kpi, 0.5) AS m, min(kpi) AS w FROM obs WHERE NOT is_failure GROUP BY 1)
SELECT campaign_id, iteration, {_r('CASE WHEN is_failure THEN a ELSE kpi END', 4)} AS by_mean, {_r('CASE WHEN is_failure THEN m ELSE kpi END', 4)} AS by_median, {_r('CASE WHEN is_failure THEN coalesce(w, 0) ELSE kpi END', 4)} AS by_worst FROM obs LEFT JOIN f USING (campaign_id)""", LINE_SQL)
def imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.impute(line_observations(spark, sf_dir))


@query(f"""+ f AS (SELECT campaign_id, regr_slope(kpi, p_quantity) AS s, avg(p_quantity) AS m FROM obs GROUP BY 1)
SELECT campaign_id, iteration, {_r('kpi - coalesce(s, 0) * (p_quantity - m)', 4)} AS kpi FROM obs JOIN f USING (campaign_id)""", LINE_SQL)
def confounder_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.confounder_normalize(line_observations(spark, sf_dir), "p_quantity")


@query(f"""+ p AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY p_quantity, iteration) - 1 AS pos, count(*) OVER (PARTITION BY campaign_id) AS n FROM obs),
q AS (SELECT *, p_quantity >= max(CASE WHEN pos = n // 2 THEN p_quantity END) OVER (PARTITION BY campaign_id) AS h FROM p)
SELECT campaign_id, {_r('avg(kpi) FILTER (WHERE h) - avg(kpi) FILTER (WHERE NOT h)', 4)} AS effect, {_r('sqrt(var_samp(kpi) FILTER (WHERE h) / count(kpi) FILTER (WHERE h) + var_samp(kpi) FILTER (WHERE NOT h) / count(kpi) FILTER (WHERE NOT h))', 4)} AS error FROM q GROUP BY 1""", LINE_SQL)
def ate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.treatment_effect(line_observations(spark, sf_dir), "p_quantity")


# ---------------------------------------------------------------- objectives


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"), (-F.col("p_size")).alias("neg_size"))


PART_SQL = "q AS (SELECT p_partkey, p_brand, p_retailprice AS price, -p_size AS neg_size FROM part)"
NOT_BEATEN = "NOT EXISTS (SELECT 1 FROM q r WHERE r.p_brand = q.p_brand AND r.price <= q.price AND r.neg_size <= q.neg_size AND (r.price < q.price OR r.neg_size < q.neg_size))"


@query(f"SELECT * FROM q WHERE {NOT_BEATEN}", PART_SQL)
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.front(_parts(spark, sf_dir), ["price", "neg_size"], ["p_brand"])


@query(f"SELECT * FROM q WHERE {NOT_BEATEN}", PART_SQL)
def pareto_front_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.front_2d(_parts(spark, sf_dir), "price", "neg_size", ["p_brand"])


@query(f"SELECT p_brand, n, r, CASE WHEN r < -0.3 THEN 'conflict' WHEN r > 0.3 THEN 'harmony' ELSE 'neutral' END AS kind FROM (SELECT p_brand, count(*) AS n, {_r(_corr('price', 'neg_size'), 4)} AS r FROM q GROUP BY 1) WHERE n >= 3", PART_SQL)
def tradeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.tradeoffs(_parts(spark, sf_dir), "price", "neg_size", ["p_brand"])


@query(f"""+ g AS (SELECT p_brand, p_partkey, lag(price) OVER a AS a1, lead(price) OVER a AS a2, lag(neg_size) OVER b AS b1, lead(neg_size) OVER b AS b2, max(price) OVER e - min(price) OVER e AS sa, max(neg_size) OVER e - min(neg_size) OVER e AS sb
FROM q WINDOW a AS (PARTITION BY p_brand ORDER BY price, p_partkey), b AS (PARTITION BY p_brand ORDER BY neg_size, p_partkey), e AS (PARTITION BY p_brand))
SELECT p_brand, p_partkey, {_r('CASE WHEN a1 IS NULL OR a2 IS NULL OR b1 IS NULL OR b2 IS NULL THEN NULL ELSE CASE WHEN sa > 0 THEN (a2 - a1) / sa ELSE 0 END + CASE WHEN sb > 0 THEN (b2 - b1) / sb ELSE 0 END END')} AS crowding FROM g""", PART_SQL)
def crowding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.crowding(_parts(spark, sf_dir), ["price", "neg_size"], ["p_brand"], "p_partkey")


@query(f"""+ i AS (SELECT p_brand, price, min(neg_size) AS b FROM q WHERE price < 2000 AND neg_size < 0 GROUP BY 1, 2),
s AS (SELECT *, coalesce(min(b) OVER (PARTITION BY p_brand ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS top FROM i)
SELECT p_brand, {_r('sum((2000 - price) * (top - b))', 2)} AS hypervolume FROM s WHERE b < top GROUP BY 1""", PART_SQL)
def hypervolume_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.hypervolume_2d(_parts(spark, sf_dir), "price", "neg_size", (2000.0, 0.0), ["p_brand"])


@query(f"""+ d AS (SELECT p_brand, p_partkey, {_r('sqrt(CASE WHEN max(price) OVER e > min(price) OVER e THEN ((price - min(price) OVER e) / (max(price) OVER e - min(price) OVER e)) ** 2 ELSE 0 END + CASE WHEN max(neg_size) OVER e > min(neg_size) OVER e THEN ((neg_size - min(neg_size) OVER e) / (max(neg_size) OVER e - min(neg_size) OVER e)) ** 2 ELSE 0 END)')} AS distance FROM q WINDOW e AS (PARTITION BY p_brand))
SELECT p_brand, p_partkey, distance FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY distance, p_partkey) AS k FROM d) WHERE k = 1""", PART_SQL)
def knee_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.knee(_parts(spark, sf_dir), ["price", "neg_size"], ["p_brand"], "p_partkey")


@query()
def dominance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.dominance_rank(_parts(spark, sf_dir), ["price", "neg_size"], ["p_brand"])


# ---------------------------------------------------------------- comparisons


HALVES_SQL = """h AS (SELECT o_custkey AS campaign_id, o_orderkey % 2 = 0 AS early, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 = 0 ORDER BY o_orderdate, o_orderkey) - 1 AS iteration, o_orderstatus, o_orderpriority FROM orders),
c AS (SELECT a.campaign_id, a.iteration, a.o_orderstatus = b.o_orderstatus AS same_o_orderstatus, a.o_orderpriority = b.o_orderpriority AS same_o_orderpriority, a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority AS same
FROM h a JOIN h b USING (campaign_id, iteration) WHERE a.early AND NOT b.early)"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    early = F.col("o_orderkey") % 2 == 0
    line = Window.partitionBy("o_custkey", early).orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("campaign_id"), early.alias("early"), (F.row_number().over(line) - 1).cast("long").alias("iteration"), "o_orderstatus", "o_orderpriority")
    return rows.where("early"), rows.where("NOT early")


@query("SELECT * FROM c", HALVES_SQL)
def log_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.log_compare(*_halves(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])


@query("SELECT campaign_id, count(*) AS n_compared, count(*) FILTER (WHERE NOT same) AS n_different, min(iteration) FILTER (WHERE NOT same) AS first_difference FROM c GROUP BY 1", HALVES_SQL)
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.first_divergence(compare.log_compare(*_halves(spark, sf_dir), ["o_orderstatus", "o_orderpriority"]))


RULES_SQL = """s AS (SELECT l_partkey, year(l_shipdate) <= 1994 AS early, min(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2),
a AS (SELECT l_partkey, flag, status FROM s WHERE early), b AS (SELECT l_partkey, flag, status FROM s WHERE NOT early)"""


@query("""SELECT l_partkey, CASE WHEN a.flag IS NULL THEN 'added' WHEN b.flag IS NULL THEN 'removed' WHEN a.flag <> b.flag OR a.status <> b.status THEN 'modified' ELSE 'unchanged' END AS state,
coalesce((a.flag <> b.flag)::INT + (a.status <> b.status)::INT, 0) AS n_changed FROM a FULL JOIN b USING (l_partkey)""", RULES_SQL)
def rule_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.year("l_shipdate") <= 1994
    sides = read(spark, sf_dir, "lineitem").groupBy("l_partkey", early.alias("early")).agg(F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    return compare.rule_diff(sides.where("early"), sides.where("NOT early"), "l_partkey", ["flag", "status"])


# The chain as a recursion over the rows of each campaign.
CHAIN_SQL = EVENT_SQL.replace("obs AS", "RECURSIVE obs AS", 1) + """,
c AS (SELECT campaign_id, iteration, sha256(campaign_id || '|' || iteration || '|' || event_id || '|' || event_type) AS content FROM obs),
k AS (SELECT campaign_id, iteration, sha256(content) AS chain_hash FROM c WHERE iteration = 0
      UNION ALL SELECT c.campaign_id, c.iteration, sha256(k.chain_hash || c.content) FROM k JOIN c ON c.campaign_id = k.campaign_id AND c.iteration = k.iteration + 1)"""


@query("SELECT campaign_id, iteration, chain_hash FROM k", CHAIN_SQL)
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.chain(event_observations(spark, sf_dir), ["campaign_id", "iteration", "event_id", "event_type"]).select("campaign_id", "iteration", "chain_hash")


# A link that was overwritten breaks itself and the one after it.
@query("""+ b AS (SELECT *, event_id % 97 = 0 OR coalesce(lag(event_id) OVER (PARTITION BY campaign_id ORDER BY iteration) % 97 = 0, false) AS bad FROM obs)
SELECT campaign_id, count(*) AS n_links, count(*) FILTER (WHERE bad) AS n_broken, min(iteration) FILTER (WHERE bad) AS first_broken FROM b GROUP BY 1""", EVENT_SQL)
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["campaign_id", "iteration", "event_id", "event_type"]
    log = compare.chain(event_observations(spark, sf_dir), fields)
    spoilt = log.withColumn("chain_hash", F.when(F.col("event_id") % 97 == 0, F.lit("0")).otherwise(F.col("chain_hash")))
    return compare.verify_chain(spoilt.drop("content_hash"), fields)


@query(f"""+ s AS (SELECT s_suppkey, s_nationkey AS g, s_acctbal AS a, count(l_suppkey) AS b FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)
SELECT x.g, count(*) AS n_pairs, {_r('sum(sign((x.a - y.a) * (x.b - y.b))) / count(*)')} AS tau FROM s x JOIN s y ON x.g = y.g AND x.s_suppkey < y.s_suppkey GROUP BY 1""", EVENT_SQL)
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("b"))
    rows = read(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return compare.kendall(rows, "s_suppkey", "a", "b", "g")


@query(f"""+ p AS (SELECT l_returnflag, l_linestatus, l_suppkey, avg(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag, l_linestatus, sum(n)::BIGINT AS n, {_r('sum(v * n) / sum(n)', 4)} AS mean_value FROM p GROUP BY 1, 2""", EVENT_SQL)
def partial_merge_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.avg("l_extendedprice").alias("v"), F.count("*").alias("n"))
    return compare.merge_portfolio(parts, ["l_returnflag", "l_linestatus"], "v", "n")


@query("""SELECT CASE WHEN regexp_matches(lower(text), 'pump|valve|motor|sensor|leak|clog') THEN 'hardware' WHEN regexp_matches(lower(text), 'precipitat|decompos|reaction|solub') THEN 'chemistry'
WHEN regexp_matches(lower(text), 'timeout|abort|skip|manual') THEN 'protocol' WHEN regexp_matches(lower(text), 'missing|nan|parse|corrupt|error') THEN 'data' ELSE 'unknown' END AS kind, count(*) AS n FROM conversations GROUP BY 1""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.failure_taxonomy(read(spark, sf_dir, "conversations"), "text")


# ---------------------------------------------------------------- search and graphs


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
idf AS (SELECT term, ln((SELECT count(text) FROM documents) / count(*)) AS idf FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, tf / len * idf AS w FROM tf JOIN l USING (doc_id) JOIN idf USING (term)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark),
ql AS (SELECT query_id, count(*) AS len FROM qt GROUP BY 1), qf AS (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY 1, 2),
qw AS (SELECT query_id, term, tf / len * idf AS qw FROM qf JOIN ql USING (query_id) JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY 1),
d AS (SELECT query_id, doc_id, sum(w * qw) AS dot FROM w JOIN qw USING (term) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, {_r('dot / norm / qnorm')} AS score FROM d JOIN n USING (doc_id) JOIN qn USING (query_id) WHERE norm > 0 AND qnorm > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM k WHERE rank <= 10""")
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.tfidf_search(read(spark, sf_dir, "documents"), "doc_id", "text", asked)


@query(f"""WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
g AS (SELECT p_partkey, list_distinct([substr(a, i, 3) FOR i IN range(1, greatest(length(a) - 2, 1) + 1)]) AS x, list_distinct([substr(b, i, 3) FOR i IN range(1, greatest(length(b) - 2, 1) + 1)]) AS y FROM p WHERE b IS NOT NULL)
SELECT p_partkey, {_r('len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))')} AS likeness FROM g""")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    pairs = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), after.alias("b")).where("b IS NOT NULL")
    return search.ngram_jaccard(pairs, "a", "b").select("p_partkey", "likeness")


@query(f"""+ c AS (SELECT campaign_id, iteration AS candidate_id, p_quantity AS q, p_discount AS d, p_tax AS t FROM obs WHERE iteration < 5),
n AS (SELECT c.campaign_id, candidate_id, o.iteration, is_failure, round((q / 49.0 - p_quantity / 49.0) ** 2 + (d / 0.1 - p_discount / 0.1) ** 2 + (t / 0.08 - p_tax / 0.08) ** 2, 6) + 0.0 AS dist FROM c JOIN obs o ON o.campaign_id = c.campaign_id AND o.iteration >= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, candidate_id ORDER BY dist, iteration) AS rank FROM n)
SELECT campaign_id, candidate_id, {_r('avg(is_failure::INT)')} AS p_failure, {_r('max(dist)')} AS radius FROM k WHERE rank <= 5 GROUP BY 1, 2""", LINE_SQL)
def knn_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = line_observations(spark, sf_dir)
    asked = obs.where("iteration < 5").withColumnRenamed("iteration", "candidate_id")
    return search.knn_failure(asked, obs.where("iteration >= 5"), PARAMS, [49.0, 0.1, 0.08])


@query(f"""WITH x AS (SELECT label, (unnest(range(len(embedding))))::INT AS dim, unnest(embedding) AS x FROM embeddings) SELECT label, dim, count(*) AS n, {_r('avg(x)')} AS mean FROM x GROUP BY 1, 2""")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer links."""
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    customer = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    return nation.unionByName(customer)


PLACES_SQL = "e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query("SELECT parent AS ancestor, child AS node, 1 AS depth FROM e UNION ALL SELECT a.parent, b.child, 2 FROM e a JOIN e b ON a.child = b.parent", PLACES_SQL)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.descendants(_places(spark, sf_dir))


@query("SELECT node, sum(o)::BIGINT AS out_links, sum(i)::BIGINT AS in_links FROM (SELECT parent AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT child, 0, 1 FROM e) GROUP BY 1", PLACES_SQL)
def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(_places(spark, sf_dir))


# ---------------------------------------------------------------- kernels


@query()
def lhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.latin_hypercube(line_observations(spark, sf_dir), LINE_SPECS, 16)


@query()
def gp_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.suggest_gp(line_observations(spark, sf_dir), LINE_SPECS)


@query()
def tpe_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.suggest_tpe(line_observations(spark, sf_dir), LINE_SPECS)


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.bootstrap_mean(event_observations(spark, sf_dir), rounds=100)


@query()
def bocpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.change_points(event_observations(spark, sf_dir))


@query()
def diverse_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.diversify(kernels.latin_hypercube(line_observations(spark, sf_dir), LINE_SPECS, 64), LINE_SPECS, 8)
