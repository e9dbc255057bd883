"""Queries on causal graphs: separation, adjustment sets and learned patterns."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import dealt, read
from ..operators import causal
from .catalogue import _r, query

# Nations, linked from customers' to suppliers' where more line items go than usual; the lower key comes first, so no cycle.
NET_SQL = """f AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
WHERE c_nationkey < s_nationkey GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a AS parent, b AS child FROM f WHERE n > (SELECT avg(n) + stddev_pop(n) FROM f)),
nodes AS (SELECT parent AS node FROM e UNION SELECT child FROM e),
m AS MATERIALIZED (SELECT child AS node, parent AS next, true AS up FROM e UNION ALL SELECT parent, child, false FROM e)"""


def _net(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines = lines.join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    flows = lines.where("c_nationkey < s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    usual = flows.agg((F.avg("n") + F.stddev_pop("n")).alias("usual"))
    return flows.join(F.broadcast(usual), F.col("n") > F.col("usual")).select(F.col("c_nationkey").alias("parent"), F.col("s_nationkey").alias("child"))


def _ball(name: str, sets: str, keys: str, cut: str) -> str:
    """A recursive table (k, x, node, up): the states that the ball of each row of ``keys`` (k, x) reaches, given ``sets`` (k, node)."""
    gone = {"into": "AND CASE WHEN m.up THEN m.node ELSE m.next END <> {t}.x", "from": "AND CASE WHEN m.up THEN m.next ELSE m.node END <> {t}.x", "": ""}[cut]
    return f"""{name}_lead(k, node) AS (SELECT k, node FROM {sets} UNION SELECT l.k, e.parent FROM {name}_lead l JOIN e ON e.child = l.node),
{name}(k, x, node, up) AS (SELECT q.k, q.x, m.next, m.up FROM {keys} q JOIN m ON m.node = q.x {gone.format(t="q")}
  UNION SELECT b.k, b.x, m.next, m.up FROM {name} b JOIN m ON m.node = b.node {gone.format(t="b")} LEFT JOIN {sets} s ON s.k = b.k AND s.node = b.node LEFT JOIN {name}_lead l ON l.k = b.k AND l.node = b.node
  WHERE CASE WHEN NOT b.up AND m.up THEN l.k IS NOT NULL ELSE s.k IS NULL END)"""


@query(f"""+ keys AS (SELECT x.node || '|' || z.node AS k, x.node AS x, z.node AS z FROM nodes x JOIN nodes z ON x.node <> z.node UNION ALL SELECT node || '|', node, NULL FROM nodes),
sets AS (SELECT k, z AS node FROM keys WHERE z IS NOT NULL), {_ball("ball", "sets", "keys", "")}
SELECT x, y.node AS y, z, NOT EXISTS (SELECT 1 FROM ball b WHERE b.k = keys.k AND b.node = y.node) AS separated FROM keys JOIN nodes y ON y.node > x AND y.node IS DISTINCT FROM z""", "RECURSIVE " + NET_SQL)
def d_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two nations given every third one, and given none."""
    links = causal.keep(_net(spark, sf_dir), "net")
    nodes = links.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    given = nodes.select(F.array("node").alias("z")).unionByName(spark.createDataFrame([([],)], f"z array<{dict(nodes.dtypes)['node']}>"))
    # The question set: as many rows as nodes to the third power.
    asked = nodes.select(F.col("node").alias("x")).join(nodes.select(F.col("node").alias("y")), F.col("x") < F.col("y")).join(given, ~F.array_contains("z", F.col("x")) & ~F.array_contains("z", F.col("y")))
    return causal.separated(links, asked).select("x", "y", F.get("z", F.lit(0)).alias("z"), "separated")


@query(f"""+ pairs AS (SELECT x.node AS x, y.node AS y FROM nodes x JOIN nodes y ON x.node <> y.node),
below(x, node) AS (SELECT parent, child FROM e UNION SELECT b.x, e.child FROM below b JOIN e ON e.parent = b.node),
steps AS (SELECT child AS x, parent AS node, 1 AS step FROM e UNION SELECT b.node, b.x, 2 FROM below b UNION SELECT x.node, y.node, 3 FROM nodes x JOIN nodes y ON x.node <> y.node),
own AS (SELECT p.x || '|' || p.y || '|' || step AS k, p.x, p.y, step, node FROM pairs p JOIN steps s ON s.x = p.x AND s.node <> p.y WHERE NOT EXISTS (SELECT 1 FROM below b WHERE b.x = p.x AND b.node = s.node)),
tried AS (SELECT k, x, y, step, list(node ORDER BY node) AS z FROM own GROUP BY ALL), tk AS (SELECT k, x FROM tried WHERE step < 3), {_ball("first", "own", "tk", "into")},
good AS (SELECT x, y, step, z FROM tried t WHERE step = 3 OR NOT EXISTS (SELECT 1 FROM first b WHERE b.k = t.k AND b.node = t.y)),
best AS (SELECT p.x, p.y, coalesce(min(step), 4) AS step, coalesce(arg_min(z, step), []) AS z FROM pairs p LEFT JOIN good USING (x, y) GROUP BY 1, 2),
bk AS (SELECT x || '|' || y AS k, x, y, step, z FROM best), bs AS (SELECT k, unnest(z) AS node FROM bk), {_ball("back", "bs", "bk", "from")}
SELECT x, y, array_to_string(z, ',') AS z, ['parents', 'ancestors', 'candidates', 'none'][step] AS taken, NOT EXISTS (SELECT 1 FROM back b WHERE b.k = bk.k AND b.node = bk.y) AS blocks_backdoor FROM bk""", "RECURSIVE " + NET_SQL)
def adjustment_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation acting on every other one."""
    links = causal.keep(_net(spark, sf_dir), "net")
    nodes = links.select(F.explode(F.array("parent", "child")).alias("x")).distinct()
    pairs = nodes.join(nodes.select(F.col("x").alias("y")), F.col("x") != F.col("y"))
    return causal.adjustment_sets(links, pairs).withColumn("z", F.array_join(F.col("z").cast("array<string>"), ","))


CHAINED = {"quantity": "l_quantity", "price": "l_extendedprice", "net": "l_extendedprice * (1 - l_discount)", "day": "dayofyear(l_shipdate)", "discount": "l_discount", "tax": "l_tax"}


def _pattern_sql(tag: str, source: str, group: str, columns: dict[str, str], level: float = 0.05, rounds: int = 5) -> str:
    """The tables of one learned pattern, level by level, the names ending in ``tag``; out{tag} holds g, a, b, directed."""
    names, cut = list(columns), NormalDist().inv_cdf(1 - level / 2)
    safe = lambda x, y: f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) ELSE 0 END"
    t = [f"d{tag} AS MATERIALIZED (SELECT {group} AS g, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {source})"]
    t.append(f"p{tag}_0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g, {i}::INT AS a, {j}::INT AS b, []::INT[] AS s, count(*) AS n, {safe(a, b)} AS r FROM d{tag} GROUP BY g" for i, a in enumerate(names) for j, b in enumerate(names) if i != j) + ")")
    t.append(f"l{tag}_0 AS MATERIALIZED (SELECT g, a, b FROM p{tag}_0)")
    for k in range(4):
        if k:
            t.append(f"""p{tag}_{k} AS MATERIALIZED (SELECT x.g, x.a, x.b, list_append(x.s, y.b) AS s, x.n, CASE WHEN (1 - y.r * y.r) * (1 - z.r * z.r) > 1e-12 THEN (x.r - y.r * z.r) / sqrt((1 - y.r * y.r) * (1 - z.r * z.r)) ELSE 0 END AS r
FROM p{tag}_{k - 1} x JOIN p{tag}_{k - 1} y ON y.g = x.g AND y.a = x.a AND y.s = x.s JOIN p{tag}_{k - 1} z ON z.g = x.g AND z.a = x.b AND z.b = y.b AND z.s = x.s WHERE y.b > coalesce(x.s[-1], -1) AND y.b <> x.a AND y.b <> x.b)""")
        t.append(f"n{tag}_{k} AS (SELECT g, a, list(b) AS near FROM l{tag}_{k} GROUP BY 1, 2)")
        t.append(f"""s{tag}_{k} AS MATERIALIZED (SELECT g, a, b, min(struct_pack(second := NOT ofa, s := s)).s AS s FROM (SELECT p.*, list_has_all(u.near, p.s) AS ofa, list_has_all(v.near, p.s) AS ofb FROM p{tag}_{k} p SEMI JOIN l{tag}_{k} USING (g, a, b)
JOIN n{tag}_{k} u ON u.g = p.g AND u.a = p.a JOIN n{tag}_{k} v ON v.g = p.g AND v.a = p.b WHERE p.a < p.b AND abs(atanh(least(greatest(r, -0.9999), 0.9999))) * sqrt(greatest(n - {k + 3}, 0)) < {cut!r}) WHERE ofa OR ofb GROUP BY 1, 2, 3)""")
        t.append(f"l{tag}_{k + 1} AS MATERIALIZED (SELECT g, a, b FROM l{tag}_{k} l WHERE NOT EXISTS (SELECT 1 FROM s{tag}_{k} s WHERE s.g = l.g AND s.a = least(l.a, l.b) AND s.b = greatest(l.a, l.b)))")
    links = f"l{tag}_4"
    t.append(f"s{tag} AS (" + " UNION ALL ".join(f"SELECT * FROM s{tag}_{k}" for k in range(4)) + ")")
    t.append(f"""w{tag}_0 AS MATERIALIZED (SELECT DISTINCT u.g, u.a, u.b FROM {links} u JOIN {links} v ON v.g = u.g AND v.b = u.b AND v.a <> u.a JOIN s{tag} s ON s.g = u.g AND s.a = least(u.a, v.a) AND s.b = greatest(u.a, v.a) WHERE NOT list_contains(s.s, u.b))""")
    for k in range(rounds):
        w, free = f"w{tag}_{k}", f"f{tag}_{k}"
        t.append(f"{free} AS MATERIALIZED (SELECT * FROM {links} l WHERE NOT EXISTS (SELECT 1 FROM {w} w WHERE w.g = l.g AND ((w.a = l.a AND w.b = l.b) OR (w.a = l.b AND w.b = l.a))))")
        apart = lambda x, y: f"NOT EXISTS (SELECT 1 FROM {links} q WHERE q.g = f.g AND q.a = {x} AND q.b = {y})"
        t.append(f"""m{tag}_{k} AS MATERIALIZED (SELECT f.g, f.a, f.b FROM {free} f JOIN {w} w ON w.g = f.g AND w.b = f.a AND w.a <> f.b WHERE {apart('w.a', 'f.b')}
UNION SELECT f.g, f.a, f.b FROM {free} f JOIN {w} u ON u.g = f.g AND u.a = f.a JOIN {w} v ON v.g = f.g AND v.a = u.b AND v.b = f.b
UNION SELECT f.g, f.a, f.b FROM {free} f JOIN {free} h ON h.g = f.g AND h.a = f.a JOIN {w} u ON u.g = f.g AND u.a = h.b AND u.b = f.b JOIN {free} i ON i.g = f.g AND i.a = f.a AND h.b < i.b JOIN {w} v ON v.g = f.g AND v.a = i.b AND v.b = f.b WHERE {apart('h.b', 'i.b')})""")
        t.append(f"w{tag}_{k + 1} AS MATERIALIZED (SELECT * FROM {w} UNION SELECT * FROM m{tag}_{k} m WHERE a < b OR NOT EXISTS (SELECT 1 FROM m{tag}_{k} o WHERE o.g = m.g AND o.a = m.b AND o.b = m.a))")
    w = f"w{tag}_{rounds}"
    t.append(f"out{tag} AS (SELECT g, a, b, true AS directed FROM {w} UNION ALL SELECT g, a, b, false FROM {links} l WHERE a < b AND NOT EXISTS (SELECT 1 FROM {w} w WHERE w.g = l.g AND ((w.a = l.a AND w.b = l.b) OR (w.a = l.b AND w.b = l.a))))")
    return ",\n".join(t)


LISTED = "[" + ", ".join(f"'{n}'" for n in CHAINED) + "]"


def _chained(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return dealt(read(spark, sf_dir, "lineitem").where(where), "l_suppkey").selectExpr("l_suppkey", *(f"cast({x} AS double) AS {n}" for n, x in CHAINED.items()))


@query(f"SELECT g AS l_suppkey, {LISTED}[a + 1] AS source, {LISTED}[b + 1] AS target, directed FROM out", _pattern_sql("", "lineitem", "l_suppkey", CHAINED))
def pc_cpdag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal pattern of the line items of every supplier."""
    return causal.cpdag(_chained(spark, sf_dir, "true"), "l_suppkey", list(CHAINED))


@query(f"""+ x AS (SELECT g, least(a, b) AS u, greatest(a, b) AS v, list_sort(list(DISTINCT (a < b)::INT)) AS w FROM out_f GROUP BY 1, 2, 3), y AS (SELECT g, least(a, b) AS u, greatest(a, b) AS v, list_sort(list(DISTINCT (a < b)::INT)) AS w FROM out_o GROUP BY 1, 2, 3),
j AS (SELECT coalesce(x.g, y.g) AS g, x.w AS p, y.w AS t FROM x FULL JOIN y ON x.g = y.g AND x.u = y.u AND x.v = y.v)
SELECT g AS l_suppkey, count(*) FILTER (WHERE p IS DISTINCT FROM t) AS distance, count(p) AS n_learned, count(t) AS n_true, count(*) FILTER (WHERE p IS NOT NULL AND t IS NOT NULL) AS n_hit,
{_r('count(*) FILTER (WHERE p IS NOT NULL AND t IS NOT NULL) / nullif(count(p), 0)')} AS precision, {_r('count(*) FILTER (WHERE p IS NOT NULL AND t IS NOT NULL) / nullif(count(t), 0)')} AS recall FROM j GROUP BY 1""", _pattern_sql("_f", "(SELECT * FROM lineitem WHERE l_linestatus = 'F')", "l_suppkey", CHAINED) + ",\n" + _pattern_sql("_o", "(SELECT * FROM lineitem WHERE l_linestatus = 'O')", "l_suppkey", CHAINED))
def pattern_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the patterns of finished and open line items of a supplier are apart."""
    learned, true = (causal.cpdag(_chained(spark, sf_dir, f"l_linestatus = '{s}'"), "l_suppkey", list(CHAINED)) for s in "FO")
    return causal.pattern_scores(learned, true, "l_suppkey", list(CHAINED))
