"""The driver's star schema seen as a river network: root <- region <- nation <- supplier, a reach above each node.

Line items are the reaches' covariates, embeddings give distances between points, events give a table of models. The SQL
of the same relations stands beside each, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.points import euclidean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent, edge_id, length_km)."""
    long = lambda c: c.cast("long")
    region = table(spark, d, "region").select(long(1 + F.col("r_regionkey")).alias("child"), F.lit(0).cast("long").alias("parent"), (10.0 + F.col("r_regionkey")).alias("length_km"))
    nation = table(spark, d, "nation").select(long(100 + F.col("n_nationkey")).alias("child"), long(1 + F.col("n_regionkey")).alias("parent"), (5.0 + F.col("n_nationkey") % 7).alias("length_km"))
    supplier = table(spark, d, "supplier").select(long(1000 + F.col("s_suppkey")).alias("child"), long(100 + F.col("s_nationkey")).alias("parent"), (1.0 + F.abs("s_acctbal") / 1000).alias("length_km"))
    return region.unionByName(nation).unionByName(supplier).select("child", "parent", F.col("child").alias("edge_id"), "length_km")


TREE = """tree AS (
  SELECT CAST(1 + r_regionkey AS BIGINT) AS child, CAST(0 AS BIGINT) AS parent, CAST(1 + r_regionkey AS BIGINT) AS edge_id, CAST(10.0 + r_regionkey AS DOUBLE) AS length_km FROM region
  UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), CAST(100 + n_nationkey AS BIGINT), CAST(5.0 + n_nationkey % 7 AS DOUBLE) FROM nation
  UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), CAST(100 + s_nationkey AS BIGINT), CAST(1000 + s_suppkey AS BIGINT), CAST(1.0 AS DOUBLE) + abs(s_acctbal) / 1000 FROM supplier)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The same as undirected edges."""
    return tree(spark, d).select("edge_id", F.col("child").alias("src"), F.col("parent").alias("dst"), "length_km")


def points(spark: SparkSession, d: str) -> DataFrame:
    """(pt_idx, node_id): all suppliers."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("pt_idx"), (1000 + F.col("s_suppkey")).cast("long").alias("node_id"))


PTS = "pts AS (SELECT CAST(s_suppkey AS BIGINT) AS pt_idx, CAST(1000 + s_suppkey AS BIGINT) AS node_id FROM supplier)"


def reaches(spark: SparkSession, d: str) -> DataFrame:
    """(edge_id, pos, quantity, discount, price): each line item counts for the edges from its supplier up to the root."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    up = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.explode(F.array(*[c.cast("long") for c in (1000 + F.col("s_suppkey"), 100 + F.col("n_nationkey"), 1 + F.col("n_regionkey"))])).alias("edge_id"))
    items = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("price"))
    return items.join(F.broadcast(up) if up.count() <= 1_000_000 else up, F.col("l_suppkey") == F.col("s_suppkey")).select("edge_id", "pos", "quantity", "discount", "price")


METHODS = {"quantity": "ARITH", "discount": "ARITH", "price": "MAX"}
COVARIATES = """covariates AS (
  SELECT edge_id, avg(l_quantity) AS quantity, avg(l_discount) AS discount, max(l_extendedprice) AS price
  FROM lineitem JOIN (
    SELECT s_suppkey, unnest([CAST(1000 + s_suppkey AS BIGINT), CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT)]) AS edge_id
    FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey
  GROUP BY edge_id)"""
PREDICTORS = COVARIATES + """, predictors AS (
  SELECT edge_id,
    10.0 * (quantity - min(quantity) OVER ()) / (max(quantity) OVER () - min(quantity) OVER ()) AS quantity,
    10.0 * (discount - min(discount) OVER ()) / (max(discount) OVER () - min(discount) OVER ()) AS discount,
    10.0 * (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS price
  FROM covariates), long_predictors AS (
  SELECT edge_id, 'quantity' AS var, quantity AS value FROM predictors UNION ALL
  SELECT edge_id, 'discount', discount FROM predictors UNION ALL SELECT edge_id, 'price', price FROM predictors)"""

ANC = TREE + ", " + PTS + """, anc AS (
  SELECT node_id AS node, edge_id, child, parent, 1 AS depth FROM pts JOIN tree ON node_id = child
  UNION ALL SELECT a.node, t.edge_id, t.child, t.parent, a.depth + 1 FROM anc a JOIN tree t ON a.parent = t.child)"""
INC = ANC + """, inc AS (
  SELECT greatest(p.pt_idx, q.pt_idx) AS i, least(p.pt_idx, q.pt_idx) AS j, edge_id
  FROM pts p JOIN anc ON p.node_id = anc.node JOIN pts q ON p.pt_idx <> q.pt_idx
  GROUP BY 1, 2, 3 HAVING count(*) = 1)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, v): the embeddings that bear suppliers' keys, one for each."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).join(points(spark, d), F.col("vec_id") == F.col("pt_idx"))
    return e.select(F.col("vec_id").cast("long").alias("id"), F.col("e").alias("v"))


def response(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, value), i > j: Euclidean distances between vectors()."""
    return euclidean(vectors(spark, d))


RESP = """resp AS (
  SELECT a.vec_id AS i, b.vec_id AS j, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS value
  FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id
  WHERE a.vec_id IN (SELECT s_suppkey FROM supplier) AND b.vec_id IN (SELECT s_suppkey FROM supplier))"""

VARIABLES = ["va", "vb", "vc"]


def models(spark: SparkSession, d: str) -> DataFrame:
    """A wide table of models out of the events: one per user."""
    n, hits = F.count(F.lit(1)), lambda kind: F.count_if(F.col("event_type") == kind)
    per = table(spark, d, "events").groupBy(F.col("user_id").alias("model_id")).agg(n.alias("n"), F.round(-F.avg("value"), 3).alias("loglik"), *[hits(k).alias(v) for v, k in zip(VARIABLES, ("click", "view", "error"))])
    columns = [F.col("model_id"), F.col("loglik").alias("fitness")]
    for k, v in enumerate(VARIABLES):
        columns += [(F.col(v) % 2).alias(v), ((F.col("n") * (2 * k + 3) % 10) / 10.0).alias(f"{v}_weight"), (F.col("n") * (k + 1) % 9).alias(f"{v}_trans"), (F.col("n") * (k + 2) % 17).cast("double").alias(f"{v}_shape")]
    return per.select(*columns, "loglik", (F.col("n") % 50 / 100.0).alias("r2m"), (-2 * F.col("loglik") + 4).alias("aic"))


MODELS = "models AS (SELECT model_id, loglik AS fitness, " + ", ".join(
    f"{v} % 2 AS {v}, (n * {2 * k + 3} % 10) / 10.0::DOUBLE AS {v}_weight, n * {k + 1} % 9 AS {v}_trans, CAST(n * {k + 2} % 17 AS DOUBLE) AS {v}_shape" for k, v in enumerate(VARIABLES)
) + """, loglik, (n % 50) / 100.0::DOUBLE AS r2m, -2 * loglik + 4 AS aic FROM (
  SELECT user_id AS model_id, count(*) AS n, round(-avg(value), 3) AS loglik, count(*) FILTER (event_type = 'click') AS va,
         count(*) FILTER (event_type = 'view') AS vb, count(*) FILTER (event_type = 'error') AS vc FROM events GROUP BY user_id))"""
RANKED = MODELS + """, weighted AS (
  SELECT *, aic - min(aic) OVER () AS delta_aic_best, exp(-(aic - min(aic) OVER ()) / 2) AS raw FROM models
), ranked0 AS (
  SELECT *, raw / sum(raw) OVER () AS akaike_weight,
         sum(raw) OVER (ORDER BY fitness DESC, loglik, model_id ROWS UNBOUNDED PRECEDING) / sum(raw) OVER () AS acc_akaike_weight FROM weighted
), ranked AS (
  SELECT *, coalesce(lag(acc_akaike_weight) OVER (ORDER BY fitness DESC, loglik, model_id), 0) <= 0.95 AS keep FROM ranked0)"""

#: The grid of candidate models: transforms x shapes, with a second variable in every other model.
SHAPES = (1.0, 5.0, 20.0)


def candidates(spark: SparkSession) -> DataFrame:
    """(model_id, var, sel, weight, transform, shape)."""
    grid = spark.range(9 * len(SHAPES)).select(F.col("id").alias("model_id"), F.expr("CAST(id div 3 AS int)").alias("t"), F.get(F.array(*map(F.lit, SHAPES)), (F.col("id") % 3).cast("int")).alias("shape"))
    one = F.struct(F.lit("quantity").alias("var"), F.lit(1).alias("sel"), F.lit(0.6).alias("weight"), F.col("t").alias("transform"), F.col("shape"))
    two = F.struct(F.lit("discount").alias("var"), (F.col("model_id") % 2).cast("int").alias("sel"), F.lit(0.4).alias("weight"), ((F.col("t") + 3) % 9).alias("transform"), F.col("shape"))
    return grid.select("model_id", F.explode(F.array(one, two)).alias("x")).select("model_id", "x.*")


CURVE = """CASE WHEN t = 0 OR shape = 0 THEN value
  WHEN t IN (1, 4) THEN value * exp(-value / shape) + 1
  WHEN t = 2 THEN (low + high - value) * exp(-(low + high - value) / shape) + 1
  WHEN t = 3 THEN -(value * exp(-value / shape)) - 1
  WHEN t = 5 THEN (1 - exp(-value / shape)) + 1
  WHEN t = 6 THEN (1 - exp(-(low + high - value) / shape)) + 1
  WHEN t = 7 THEN exp(-value / shape) + 1
  WHEN t = 8 THEN exp(-(low + high - value) / shape) + 1 END"""
SURFACES = PREDICTORS + f""", candidates AS (
  SELECT m AS model_id, 'quantity' AS var, 1 AS sel, 0.6::DOUBLE AS weight, m // 3 AS t, [1.0, 5.0, 20.0][m % 3 + 1]::DOUBLE AS shape FROM range(27) r(m)
  UNION ALL SELECT m, 'discount', m % 2, 0.4::DOUBLE, (m // 3 + 3) % 9, [1.0, 5.0, 20.0][m % 3 + 1]::DOUBLE FROM range(27) r(m)
), curves0 AS (
  SELECT model_id, edge_id, var, weight, {CURVE} AS v
  FROM candidates JOIN (SELECT *, min(value) OVER (PARTITION BY var) AS low, max(value) OVER (PARTITION BY var) AS high FROM long_predictors) USING (var)
  WHERE sel = 1
), curves AS (
  SELECT *, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS c FROM curves0 WINDOW w AS (PARTITION BY model_id, var)
), summed AS (SELECT model_id, edge_id, sum(weight * c) AS s FROM curves GROUP BY 1, 2),
surfaces AS (SELECT model_id, edge_id, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS resistance FROM summed WINDOW w AS (PARTITION BY model_id))"""


def mlpe_sql(source: str, grid: int = 51) -> str:
    """CTEs from `source` (key, i, j, x, y) to `fits` (key, rho, loglik, loglik_null, slope, mse), rho on a plain grid."""
    product = lambda uv, pp, su, sv: f"(({uv}) - b * (({pp}) / own - b * ({su}) * ({sv}) * 4 / (own * total))) / a"
    return f"""pair_rows AS (SELECT * FROM {source}),
whole AS (SELECT key, CAST(count(*) AS DOUBLE) AS m, avg(x) AS mx, stddev_pop(x) AS sx, sum(y) AS y, sum(y * y) AS yy FROM pair_rows GROUP BY key),
std AS (SELECT p.key, i, j, (x - mx) / sx AS x, p.y FROM pair_rows p JOIN whole USING (key)),
ends AS (SELECT key, i AS pop, x, y FROM std UNION ALL SELECT key, j, x, y FROM std),
per_pop AS (SELECT key, pop, count(*) AS k, sum(x) AS x, sum(y) AS y FROM ends GROUP BY 1, 2),
pops AS (SELECT key, CAST(count(*) AS DOUBLE) AS n, sum(k * k) AS p11, sum(k * y) AS p1y, sum(x * x) AS pxx, sum(x * y) AS pxy, sum(y * y) AS pyy FROM per_pop GROUP BY key),
cross_sums AS (SELECT key, sum(x * y) AS xy FROM std GROUP BY key),
stats AS (SELECT * FROM whole JOIN pops USING (key) JOIN cross_sums USING (key)),
rhos AS (SELECT 0.0001 + g * (0.4999 - 0.0001) / {grid - 1} AS rho FROM range({grid}) r(g)),
at_rho AS (SELECT *, 1 - 2 * rho * rho AS a, rho * rho AS b, 1 - 2 * rho * rho + rho * rho * (n - 2) AS own, 1 - 2 * rho * rho + rho * rho * (2 * n - 2) AS total FROM stats, rhos),
grams AS (SELECT *, {product('m', 'p11', 'm', 'm')} AS a11, {product('m', 'pxx', '0', '0')} AS axx, {product('y', 'p1y', 'm', 'y')} AS a1y,
  {product('xy', 'pxy', '0', 'y')} AS axy, {product('yy', 'pyy', 'y', 'y')} AS ayy FROM at_rho),
scored AS (SELECT *, ayy - a1y * a1y / a11 - axy * axy / axx AS ssr, ayy - a1y * a1y / a11 AS ssr0,
  ln(a + 2 * b * (n - 1)) + (n - 1) * ln(own) + (m - n) * ln(a) AS logdet FROM grams),
fitted AS (SELECT key, rho, axy / axx AS slope, ssr / (m - 2) AS mse,
  -m / 2 * ln(ssr) - m / 2 * (1 + ln(pi() / (m / 2))) - logdet / 2 AS loglik,
  -m / 2 * ln(ssr0) - m / 2 * (1 + ln(pi() / (m / 2))) - logdet / 2 AS loglik_null FROM scored),
fits AS (SELECT * FROM fitted QUALIFY row_number() OVER (PARTITION BY key ORDER BY loglik DESC, rho) = 1)"""
