"""Queries on models of campaigns: forests, Shapley values, principal directions, Sobol points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import LINE_SPECS, LINE_SQL, Spec, line_observations, read
from ..operators import design, equations, evidence, explain, forest, prefer, sequence
from .catalogue import PARAMS, _r, query


def _unit_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"


def _sobol_sql(number: str, dimension: int) -> str:
    bits = (f"((xor({number}, {number} >> 1) >> {k}) & 1) * {m}" for k, m in enumerate(sequence.masks(dimension)))
    return f"({reduce(lambda a, b: f'xor({a}, {b})', bits)}) / {float(1 << sequence.BITS)}::DOUBLE"


@query(f"""+ c AS (SELECT campaign_id, place, place + 42 + count(*) AS i FROM obs, range(16) AS r(place) GROUP BY 1, 2)
SELECT campaign_id, place, {', '.join(f'{s.lower}::DOUBLE + {_sobol_sql("i", d)} * {s.upper - s.lower!r}::DOUBLE AS {s.name}' for d, s in enumerate(LINE_SPECS))} FROM c""", LINE_SQL)
def sobol_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sobol(line_observations(spark, sf_dir), LINE_SPECS, 16)


def _forest_sql(depth: int = 3, trees: int = forest.TREES, bins: int = forest.BINS, leaf: int = forest.LEAF, seed: int = forest.SEED) -> str:
    """Every cut of every node, level by level."""
    step = lambda s: f"least(greatest(floor(({s.name} - {s.lower}::DOUBLE) / {s.upper - s.lower!r}::DOUBLE * {bins}), 0), {bins - 1})::INT"
    u = _unit_sql(str(seed), "tree", "campaign_id", "iteration")
    drawn = " + ".join(f"(u > {c!r}::DOUBLE)::INT" for c in forest.chances())
    t = [f"""drawn AS (SELECT campaign_id, kpi::DECIMAL(18, 4) AS y, {', '.join(f'{step(s)} AS b{i}' for i, s in enumerate(LINE_SPECS))}, tree, {u} AS u FROM obs, range({trees}) AS t(tree) WHERE NOT is_failure)""",
         f"rows0 AS MATERIALIZED (SELECT campaign_id, y, b0, b1, b2, tree, {drawn} AS w, 0 AS node FROM drawn WHERE {drawn} > 0)"]
    for k in range(depth):
        t.append(f"""try{k} AS MATERIALIZED (SELECT tree, node, feature FROM (SELECT tree, node, feature, row_number() OVER (PARTITION BY tree, node ORDER BY {_unit_sql(str(seed), 'tree', 'node', 'feature')}) AS k
  FROM (SELECT DISTINCT tree, node FROM rows{k} WHERE node >= {2**k - 1}), range({len(LINE_SPECS)}) AS f(feature)) WHERE k <= {max(1, int(len(LINE_SPECS) ** 0.5))}),
cells{k} AS MATERIALIZED (SELECT campaign_id, tree, node, feature, [b0, b1, b2][feature + 1] AS step, sum(w) AS n, sum(y * w) AS s FROM rows{k} JOIN try{k} USING (tree, node) GROUP BY ALL),
sides{k} AS (SELECT a.campaign_id, a.tree, a.node, a.feature, a.step, sum(b.n) FILTER (WHERE b.step <= a.step)::DOUBLE AS nl, sum(b.s) FILTER (WHERE b.step <= a.step) AS sl, sum(b.n)::DOUBLE AS nn, sum(b.s) AS ss
  FROM cells{k} a JOIN cells{k} b USING (campaign_id, tree, node, feature) GROUP BY ALL),
best{k} AS MATERIALIZED (SELECT campaign_id, tree, node, max(struct_pack(gain := sl::DOUBLE * sl::DOUBLE / nl + (ss - sl)::DOUBLE * (ss - sl)::DOUBLE / (nn - nl) - ss::DOUBLE * ss::DOUBLE / nn, f := -feature, c := -step)) AS cut
  FROM sides{k} WHERE nl >= {leaf} AND nn - nl >= {leaf} AND nn > {leaf} GROUP BY 1, 2, 3 HAVING max(struct_pack(gain := sl::DOUBLE * sl::DOUBLE / nl + (ss - sl)::DOUBLE * (ss - sl)::DOUBLE / (nn - nl) - ss::DOUBLE * ss::DOUBLE / nn, f := -feature, c := -step)).gain > 0),
rows{k + 1} AS MATERIALIZED (SELECT campaign_id, y, b0, b1, b2, tree, w, CASE WHEN cut IS NULL THEN node WHEN [b0, b1, b2][1 - cut.f] <= -cut.c THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM rows{k} LEFT JOIN best{k} USING (campaign_id, tree, node))""")
    every = " UNION ALL ".join(f"SELECT * FROM best{k}" for k in range(depth))
    return "+ " + ",\n".join(t) + f"\nSELECT campaign_id, tree::INT AS tree, node::INT AS node, (-cut.f)::INT AS feature, (-cut.c)::INT AS cut, {_r('cut.gain', 0)} AS gain FROM ({every})"


@query(_forest_sql(), LINE_SQL)
def forest_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits, _ = forest.grow(line_observations(spark, sf_dir), LINE_SPECS, depth=3)
    return splits.select("campaign_id", "tree", "node", F.col("feature").cast("int").alias("feature"), F.col("cut").cast("int").alias("cut"), (F.round("gain", 0) + 0.0).alias("gain"))


@query()
def forest_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.suggest(line_observations(spark, sf_dir), LINE_SPECS, maximize=True)


def _charge(p: dict[str, Column]) -> Column:
    return p["p_quantity"] * (1 - p["p_discount"]) * (1 + p["p_tax"])


def _shapley_sql() -> str:
    """All coalitions and the marginal gains of each parameter, weighted by their orders."""
    value = lambda bits: "avg({0} * (1 - {1}) * (1 + {2}))".format(*(f"{'t' if bits >> i & 1 else 'b'}.{n}" for i, n in enumerate(PARAMS)))
    order = {0: "1.0 / 3", 1: "1.0 / 6", 2: "1.0 / 3"}
    phi = lambda i: " + ".join(f"{order[bits.bit_count()]}::DOUBLE * (v{bits | 1 << i} - v{bits})" for bits in range(8) if not bits >> i & 1)
    return f"""+ ok AS (SELECT * FROM obs WHERE NOT is_failure), t AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY kpi DESC, iteration) = 1),
v AS (SELECT b.campaign_id, t.iteration AS item, {', '.join(f'{value(bits)} AS v{bits}' for bits in range(8))} FROM ok b JOIN t USING (campaign_id) GROUP BY 1, 2)
SELECT campaign_id, item, unnest([{', '.join(f"'{n}'" for n in PARAMS)}]) AS name, unnest([{', '.join(_r(phi(i)) for i in range(3))}]) AS value FROM v"""


@query(_shapley_sql(), LINE_SQL)
def shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each parameter of a campaign's best trial adds to its charge over the campaign's successes."""
    good = line_observations(spark, sf_dir).where("NOT is_failure")
    first = F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc("kpi"), "iteration"))
    best = good.withColumn("turn", first).where("turn = 1").withColumnRenamed("iteration", "item")
    return explain.shapley(best, good, "campaign_id", PARAMS, _charge)


MEASURED = ["l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount)", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"]


@query(f"""+ m AS (SELECT {', '.join(f'avg({c}) AS m{i}, stddev_samp({c}) AS s{i}' for i, c in enumerate(MEASURED))} FROM lineitem),
c AS (SELECT [{', '.join('[' + ', '.join('1.0::DOUBLE' if a == b else f'corr({a}, {b})' for b in MEASURED) + ']' for a in MEASURED)}] AS c FROM lineitem),
p(k, v) AS (SELECT 0, [0.1::DOUBLE, 1, 1, 1] UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT k, list_transform(c, lambda r: list_dot_product(r, v)) AS w FROM p, c WHERE k < 120)),
v AS (SELECT v FROM p WHERE k = 120)
SELECT l_orderkey, l_linenumber, {_r(' + '.join(f'v[{i + 1}] * (({c}) - m{i}) / s{i}' for i, c in enumerate(MEASURED)), 5)} AS place FROM lineitem, m, v""", "RECURSIVE d AS (SELECT 1)")
def latent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item's place on the direction in which the measures, each in its deviations, vary most."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(*map(F.expr, MEASURED)).alias("measures"))
    found = explain.project(lines, "measures", 1, scaled=True)
    return found.select("l_orderkey", "l_linenumber", (F.round(F.get("places", F.lit(0)), 5) + 0.0).alias("place"))


@query()
def embedding_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's coordinates on the two directions of most variance."""
    found = explain.project(read(spark, sf_dir, "embeddings"), "embedding", 2)
    return found.select("vec_id", "label", F.get("places", F.lit(0)).alias("x"), F.get("places", F.lit(1)).alias("y"))


def _strength_sql(rounds: int = 12) -> str:
    t = ["l AS (SELECT l_orderkey, s_nationkey AS nation, l_extendedprice / l_quantity AS price FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)",
         "v AS MATERIALIZED (SELECT a.nation AS winner, b.nation AS loser, count(*)::DOUBLE AS w, count(*) AS n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.nation <> b.nation AND a.price < b.price GROUP BY 1, 2)",
         "p AS MATERIALIZED (SELECT item, other, sum(w) AS w FROM (SELECT winner AS item, loser AS other, w FROM v UNION ALL SELECT loser, winner, w FROM v) GROUP BY 1, 2)",
         "s0 AS (SELECT item, sum(win) AS wins, sum(n) AS n_votes, 1.0::DOUBLE AS score FROM (SELECT winner AS item, w AS win, n FROM v UNION ALL SELECT loser, 0, n FROM v) GROUP BY 1)"]
    for k in range(rounds):
        t.append(f"r{k} AS (SELECT a.item, a.wins, a.n_votes, a.wins / sum(p.w / (a.score + b.score)) AS score FROM s{k} a JOIN p USING (item) JOIN s{k} b ON b.item = p.other GROUP BY 1, 2, 3)")
        t.append(f"s{k + 1} AS MATERIALIZED (SELECT item, wins, n_votes, score / max(score) OVER () AS score FROM r{k})")
    return "+ " + ",\n".join(t) + f"\nSELECT item, {_r('score', 7)} AS score, wins, n_votes::BIGINT AS n_votes FROM s{rounds}"


@query(_strength_sql(), "z AS (SELECT 1)")
def preference_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers' nations win when lines of one order are compared by unit price, the lower being preferred."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    lines = lines.select("l_orderkey", F.col("s_nationkey").alias("nation"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    other = lines.select("l_orderkey", F.col("nation").alias("loser"), F.col("price").alias("dearer"))
    votes = lines.join(other, "l_orderkey").where("nation != loser AND price < dearer").select(F.col("nation").alias("winner"), "loser", F.lit(1.0).alias("confidence"))
    found = prefer.strengths(votes, rounds=12, epsilon=0.0)
    return found.select("item", (F.round("score", 7) + 0.0).alias("score"), "wins", "n_votes")


def _unit_place_sql(*specs: Spec) -> str:
    return ", ".join(f"({s.name} - {s.lower}::DOUBLE) / {s.upper - s.lower!r}::DOUBLE AS u{i}" for i, s in enumerate(specs))


@query(f"""+ p AS MATERIALIZED (SELECT campaign_id, {_unit_place_sql(*LINE_SPECS)} FROM obs), n AS (SELECT campaign_id, count(*) AS n FROM p GROUP BY 1),
{', '.join(f"a{i} AS (SELECT DISTINCT campaign_id, u{i} FROM p UNION SELECT campaign_id, 1.0 FROM p GROUP BY 1 HAVING max(u{i}) < 1)" for i in range(3))},
c AS MATERIALIZED (SELECT campaign_id, u0, u1, u2 FROM a0 JOIN a1 USING (campaign_id) JOIN a2 USING (campaign_id)),
k AS (SELECT campaign_id, u0, u1, u2, count(*) AS k FROM p GROUP BY ALL),
b AS (SELECT c.campaign_id, c.u0, c.u1, c.u2, coalesce(sum(k.k) FILTER (WHERE k.u0 <= c.u0 AND k.u1 <= c.u1 AND k.u2 <= c.u2), 0) AS k FROM c JOIN k USING (campaign_id) GROUP BY ALL)
SELECT campaign_id, any_value(n) AS n_trials, {_r('max(abs(k / n - u0 * u1 * u2))', 8)} AS discrepancy FROM b JOIN n USING (campaign_id) GROUP BY 1""", LINE_SQL)
def star_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = design.star_discrepancy(line_observations(spark, sf_dir), LINE_SPECS)
    return found.select("campaign_id", "n_trials", (F.round("discrepancy", 8) + 0.0).alias("discrepancy"))


PRICED = (Spec("p_discount", 0.0, 0.1), Spec("p_tax", 0.0, 0.08), Spec("kpi", 900.0, 105000.0))


@query(f"""+ p AS MATERIALIZED (SELECT campaign_id, iteration, {_unit_place_sql(*PRICED)} FROM obs),
d AS (SELECT a.campaign_id, min(sqrt((a.u0 - b.u0) ** 2 + (a.u1 - b.u1) ** 2 + (a.u2 - b.u2) ** 2)) AS d FROM p a JOIN p b ON a.campaign_id = b.campaign_id AND a.iteration < b.iteration GROUP BY 1)
SELECT campaign_id, count(*) AS n_trials, {_r('any_value(d)', 8)} AS distance FROM p LEFT JOIN d USING (campaign_id) GROUP BY 1""", LINE_SQL)
def least_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near a supplier's two most alike lines are by discount, tax and price."""
    found = design.least_distance(line_observations(spark, sf_dir), PRICED)
    return found.select("campaign_id", "n_trials", (F.round("distance", 8) + 0.0).alias("distance"))


_PRICE, _DISCOUNT, _TAX = (("var", x) for x in ("l_extendedprice", "l_discount", "l_tax"))
LAWS = {
    "charge": ("*", ("*", _PRICE, ("-", ("const", 1.0), _DISCOUNT)), ("+", ("const", 1.0), _TAX)),
    "share": ("/", _TAX, ("+", _TAX, _DISCOUNT)),
    "root": ("sqrt", ("-", _TAX, _DISCOUNT)),
    "logarithm": ("neg", ("log", _DISCOUNT)),
    "growth": ("exp", ("*", _PRICE, ("const", 0.01))),
}


@query(f"""+ v AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS p, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t FROM lineitem),
w AS (SELECT l_orderkey, l_linenumber, p * (1 - d) * (1 + t) AS charge, CASE WHEN abs(t + d) >= 1e-12 THEN t / (t + d) ELSE 'inf' END AS share, CASE WHEN t - d >= 0 THEN sqrt(t - d) ELSE 'inf' END AS root,
  CASE WHEN d > 0 THEN -ln(d) ELSE 'inf' END AS logarithm, CASE WHEN p * 0.01::DOUBLE <= 500 THEN ln(exp(p * 0.01::DOUBLE)) ELSE 'inf' END AS growth FROM v)
SELECT l_orderkey, l_linenumber, {', '.join(f"CASE WHEN {n} = 'inf' THEN NULL ELSE {_r(n)} END AS {n}, {n} = 'inf' AS no_{n}" for n in LAWS)} FROM w""", "z AS (SELECT 1)")
def expression_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression trees over every line item, and where they have no value; the growth by its logarithm."""
    lines = read(spark, sf_dir, "lineitem")
    inf = F.lit(float("inf"))
    found = lines.select("l_orderkey", "l_linenumber", *(equations.value(t).alias(n) for n, t in LAWS.items())).withColumn("growth", F.log("growth"))
    return found.select("l_orderkey", "l_linenumber", *(x for n in LAWS for x in (F.when(F.col(n) != inf, F.round(n, 6) + 0.0).alias(n), (F.col(n) == inf).alias(f"no_{n}"))))


@query()
def discovered_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equations of rising length for what a line item is charged, from its price, discount and tax."""
    lines = read(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount", "l_tax", equations.value(LAWS["charge"]).alias("charge"))
    return equations.discover(lines, ["l_extendedprice", "l_discount", "l_tax"], "charge")


PRICES = {
    "flat": ("const", 38000.0),
    "by_quantity": ("*", ("var", "p_quantity"), ("const", 1500.0)),
    "discounted": ("*", ("*", ("var", "p_quantity"), ("const", 1500.0)), ("-", ("const", 1.0), ("var", "p_discount"))),
}


@query(f"""+ e AS (SELECT campaign_id, iteration, h.hypothesis, abs(kpi - h.p) <= 9000 AS supports FROM (SELECT *, unnest([
  {{'hypothesis': 'flat', 'p': 38000::DOUBLE}}, {{'hypothesis': 'by_quantity', 'p': p_quantity * 1500}}, {{'hypothesis': 'discounted', 'p': p_quantity * 1500 * (1 - p_discount)}}]) AS h FROM obs)),
l AS (SELECT *, max(CASE WHEN supports THEN iteration END) OVER (PARTITION BY campaign_id, hypothesis) AS last FROM e)
SELECT campaign_id, hypothesis, count(*) AS n_evidence, count(*) FILTER (WHERE supports) AS n_supporting, count(*) FILTER (WHERE iteration > coalesce(last, -1)) AS refuted_in_a_row,
  count(*) FILTER (WHERE iteration > coalesce(last, -1)) >= 3 AS falsified FROM l GROUP BY 1, 2""", LINE_SQL)
def hypothesis_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How three equations for a line's price stand with each supplier."""
    found = evidence.verdicts(line_observations(spark, sf_dir), PRICES, "kpi", ["campaign_id", "iteration"], band=9000.0)
    return evidence.tally(found, "campaign_id", "iteration")
