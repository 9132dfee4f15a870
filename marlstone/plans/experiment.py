"""The sales experiment on order lines: events are customers' order groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import experiment as ex
from .catalog import query, table


def sales(spark, sf_dir):
    """One row per sale: event (cluster), consultant, event size, treatment, money."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    sold = F.col("l_returnflag") != "R"
    rows = lines.join(orders, "l_orderkey").join(customers, "c_custkey")
    rows = rows.select(
        F.concat(F.substring("c_mktsegment", 1, 2), F.col("c_custkey").cast("string")).alias("event_id"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("large_event"),
        (F.col("c_custkey") % 2).cast("int").alias("treat_offer"),
        F.when(sold, F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(0.0).alias("amount"),
        F.when(sold, F.col("l_extendedprice") * F.col("l_discount")).otherwise(0.0).alias("discount"),
        F.when(sold & (F.col("l_quantity") > 40), 1).otherwise(0).alias("free_ship"))
    return rows.withColumns({"consultant": ex.consultant("event_id"), "profit": ex.profit("amount", "discount", "free_ship")})


_SALES = """lines AS (SELECT substr(c_mktsegment, 1, 2) || c_custkey AS event_id, substr(c_mktsegment, 1, 2) AS consultant,
  CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS large_event, (c_custkey % 2)::INTEGER AS treat_offer,
  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END AS amount,
  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * l_discount ELSE 0 END AS discount,
  CASE WHEN l_returnflag <> 'R' AND l_quantity > 40 THEN 1 ELSE 0 END AS free_ship
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
sales AS (SELECT *, amount - 0.45::DOUBLE * (amount + discount) - free_ship * 6.5::DOUBLE AS profit FROM lines)"""


@query("profit", f"WITH {_SALES} SELECT event_id, count(*) AS n, round(sum(profit), 2) AS profit, round(max(profit), 4) AS best FROM sales GROUP BY event_id")
def profit(spark, sf_dir):
    return sales(spark, sf_dir).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("profit"), 2).alias("profit"), F.round(F.max("profit"), 4).alias("best"))


@query("nonzero_subset", f"""
WITH {_SALES} SELECT consultant, large_event, count(*) FILTER (profit <> 0) AS n_profit, count(*) FILTER (amount <> 0) AS n_purchase
FROM sales WHERE profit <> 0 OR amount <> 0 GROUP BY 1, 2""")
def nonzero_subset(spark, sf_dir):
    kept = sales(spark, sf_dir).filter("profit <> 0 OR amount <> 0")
    return kept.groupBy("consultant", "large_event").agg(
        F.count(F.when(F.col("profit") != 0, 1)).alias("n_profit"), F.count(F.when(F.col("amount") != 0, 1)).alias("n_purchase"))


@query("cluster_counts", f"WITH {_SALES} SELECT consultant, event_id, large_event, treat_offer, count(*) AS freq FROM sales GROUP BY 1, 2, 3, 4")
def cluster_counts(spark, sf_dir):
    return agg.cluster_counts(sales(spark, sf_dir), ["consultant", "event_id", "large_event", "treat_offer"])


@query("purchase_rate", f"WITH {_SALES} SELECT event_id, round(avg(CASE WHEN amount <> 0 THEN 1.0 ELSE 0.0 END), 6) AS purchase_rate FROM sales GROUP BY 1")
def purchase_rate(spark, sf_dir):
    return agg.nonzero_rate(sales(spark, sf_dir), ["event_id"], "amount").withColumn("purchase_rate", F.round("purchase_rate", 6))


@query("distinct_events", f"WITH {_SALES} SELECT DISTINCT event_id, large_event, treat_offer, consultant FROM sales")
def distinct_events(spark, sf_dir):
    return events(spark, sf_dir)


def events(spark, sf_dir):
    return sales(spark, sf_dir).select("event_id", "large_event", "treat_offer", "consultant").distinct()


def _rounded(df):
    return df.select(*[F.round(c, 4).alias(c) if c in ("estimate", "std_error", "t_value", "p_value", "r2", "adj_r2") else c for c in df.columns])


@query("ols", f"""
WITH {_SALES}, f AS (SELECT regr_slope(profit, treat_offer) AS b, regr_intercept(profit, treat_offer) AS a, count(*) AS n FROM sales)
SELECT 'intercept' AS term, n, round(a, 4) AS estimate FROM f UNION ALL SELECT 'treat_offer', n, round(b, 4) FROM f""")
def ols(spark, sf_dir):
    return _rounded(ex.ols(sales(spark, sf_dir), "profit", ["treat_offer"])).select("term", "n", "estimate")


# Two-by-two closed form of the cluster-robust covariance.
_CLUSTERED = f"""{_SALES}, f AS (SELECT regr_slope(profit, treat_offer) AS b, regr_intercept(profit, treat_offer) AS a, count(*)::DOUBLE AS n,
  sum(treat_offer)::DOUBLE AS sx, sum(treat_offer * treat_offer)::DOUBLE AS sxx FROM sales),
g AS (SELECT event_id, sum(profit - a - b * treat_offer) AS s0, sum(treat_offer * (profit - a - b * treat_offer)) AS s1 FROM sales, f GROUP BY event_id),
m AS (SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11, count(*)::DOUBLE AS m FROM g),
i AS (SELECT sxx / (n * sxx - sx * sx) AS i00, -sx / (n * sxx - sx * sx) AS i01, n / (n * sxx - sx * sx) AS i11 FROM f),
v AS (SELECT a, b, n, (m / (m - 1)) * ((n - 1) / (n - 2)) AS k,
  i00 * i00 * m00 + 2 * i00 * i01 * m01 + i01 * i01 * m11 AS v00, i01 * i01 * m00 + 2 * i01 * i11 * m01 + i11 * i11 * m11 AS v11 FROM f, m, i)"""


@query("clustered_se", f"""
WITH {_CLUSTERED} SELECT 'intercept' AS term, n::BIGINT AS n, round(a, 4) AS estimate, round(sqrt(k * v00), 4) AS std_error, round(a / sqrt(k * v00), 4) AS t_value FROM v
UNION ALL SELECT 'treat_offer', n::BIGINT, round(b, 4), round(sqrt(k * v11), 4), round(b / sqrt(k * v11), 4) FROM v""")
def clustered_se(spark, sf_dir):
    return _rounded(ex.ols(sales(spark, sf_dir), "profit", ["treat_offer"], cluster="event_id")).drop("p_value")


def _robust_sql(y: str, xs: dict[str, str]) -> str:
    """Any cluster-robust fit: Gauss-Jordan on the normal equations, scores by event, tails of t by Simpson's rule."""
    p, names = len(xs) + 1, ["intercept", *xs]
    design = "[" + ", ".join(["1::DOUBLE", *[f"({x})::DOUBLE" for x in xs.values()]]) + "]"
    return f"""{_SALES}, d AS (SELECT event_id, {design} AS x, {y}::DOUBLE AS y FROM sales),
size AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT event_id)::DOUBLE AS m FROM d),
one AS (SELECT unnest(range(1, {p + 1})) AS i), two AS (SELECT a.i, b.i AS j FROM one a, one b),
products AS (SELECT i, j, sum(x[i] * x[j]) AS v FROM d, two GROUP BY 1, 2), given AS (SELECT i, sum(x[i] * y) AS v FROM d, one GROUP BY 1),
normal AS (SELECT i, list(v ORDER BY j) AS r FROM products GROUP BY i),
start AS (SELECT list(r || list_transform(range(1, {p + 1}), lambda c: CASE WHEN c = i THEN 1::DOUBLE ELSE 0::DOUBLE END) || [v] ORDER BY i) AS m FROM normal JOIN given USING (i)),
steps AS (SELECT 1 AS k, m FROM start UNION ALL SELECT k + 1, list_transform(range(1, {p + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
  ELSE list_transform(range(1, {2 * p + 2}), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END) FROM steps WHERE k <= {p}),
solved AS (SELECT m FROM steps WHERE k = {p + 1}),
b AS (SELECT i, m[i][{2 * p + 1}] AS b FROM solved, one), inv AS (SELECT i, j, m[i][{p} + j] AS v FROM solved, two),
rest AS (SELECT event_id, x, y - list_sum(list_transform(range(1, {p + 1}), lambda i: x[i] * m[i][{2 * p + 1}])) AS e FROM d, solved),
scores AS (SELECT event_id, i, sum(x[i] * e) AS s FROM rest, one GROUP BY 1, 2),
middle AS (SELECT a.i, c.i AS j, sum(a.s * c.s) AS v FROM scores a JOIN scores c USING (event_id) GROUP BY 1, 2),
var AS (SELECT l.i, sum(l.v * middle.v * r.v) AS v FROM inv l JOIN middle ON l.j = middle.i JOIN inv r ON middle.j = r.j AND r.i = l.i GROUP BY l.i),
tested AS (SELECT i, n, b, sqrt(m / (m - 1) * ((n - 1) / (n - {p})) * v) AS se FROM b JOIN var USING (i), size),
density AS (SELECT i, h.k, b / se AS t, n - {p} AS dof, abs(b / se) * h.k / 4000 AS u, n, b, se FROM tested, (SELECT unnest(range(0, 4001)) AS k) h),
curve AS (SELECT *, exp(lgamma((dof + 1) / 2) - lgamma(dof / 2) - 0.5 * ln(dof * pi()) - (dof + 1) / 2 * ln(1 + u * u / dof)) AS f FROM density),
tails AS (SELECT i, n, b, se, t, 1 - 2 * abs(t) / 4000 / 3 * sum(f * CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) AS p FROM curve GROUP BY i, n, b, se, t)
SELECT {names}[i] AS term, n::BIGINT AS n, round(b, 4) AS estimate, round(se, 4) AS std_error, round(t, 4) AS t_value, round(abs(p), 4) AS p_value FROM tails"""


@query("coef_test", "WITH RECURSIVE " + _robust_sql("amount", {"treat_offer": "treat_offer"}))
def coef_test(spark, sf_dir):
    return _rounded(ex.ols(sales(spark, sf_dir), "amount", ["treat_offer"], cluster="event_id"))


_INTERACTED = {"treat": "treat_offer", "large": "large_event", "group": "CASE WHEN consultant = 'MA' THEN 1 ELSE 0 END", "large_treat": "large_event * treat_offer",
               "group_treat": "CASE WHEN consultant = 'MA' THEN treat_offer ELSE 0 END"}


@query("interaction_model", "WITH RECURSIVE " + _robust_sql("profit", _INTERACTED))
def interaction_model(spark, sf_dir):
    design, xs = ex.interaction_design(sales(spark, sf_dir), "treat_offer", "large_event", "consultant", "MA")
    return _rounded(ex.ols(design, "profit", xs, cluster="event_id"))


@query("subgroup_ols", f"""
WITH {_SALES}, f AS (SELECT consultant, large_event, regr_slope(profit, treat_offer) AS b, regr_intercept(profit, treat_offer) AS a, count(*) AS n FROM sales GROUP BY 1, 2)
SELECT consultant, large_event, 'intercept' AS term, n, round(a, 4) AS estimate FROM f
UNION ALL SELECT consultant, large_event, 'treat_offer', n, round(b, 4) FROM f""")
def subgroup_ols(spark, sf_dir):
    fits = ex.ols(sales(spark, sf_dir), "profit", ["treat_offer"], cluster="event_id", by=["consultant", "large_event"])
    return _rounded(fits).select("consultant", "large_event", "term", "n", "estimate")


@query("balance_check", f"""
WITH {_SALES}, e AS (SELECT DISTINCT event_id, large_event, treat_offer, consultant FROM sales),
f AS (SELECT regr_slope(treat_offer, large_event) AS b, regr_intercept(treat_offer, large_event) AS a, count(*) AS n FROM e),
g AS (SELECT regr_slope(treat_offer, CASE WHEN consultant = 'MA' THEN 1 ELSE 0 END) AS b, regr_intercept(treat_offer, CASE WHEN consultant = 'MA' THEN 1 ELSE 0 END) AS a, count(*) AS n FROM e)
SELECT 'large_event' AS covariate, n, round(a, 4) AS intercept, round(b, 4) AS slope FROM f
UNION ALL SELECT 'consultant', n, round(a, 4), round(b, 4) FROM g""")
def balance_check(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("is_ma", F.when(F.col("consultant") == "MA", 1).otherwise(0))

    def check(name, x):
        fit = ex.ols(e, "treat_offer", [x])
        return fit.groupBy(F.lit(name).alias("covariate"), "n").agg(
            F.round(F.max(F.when(F.col("term") == "intercept", F.col("estimate"))), 4).alias("intercept"),
            F.round(F.max(F.when(F.col("term") == x, F.col("estimate"))), 4).alias("slope"))

    return check("large_event", "large_event").unionByName(check("consultant", "is_ma"))


@query("regression_table", f"""
WITH {_SALES}, f AS (SELECT consultant, count(*) AS n, regr_r2(profit, treat_offer) AS r2 FROM sales GROUP BY 1)
SELECT consultant, n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2)::DOUBLE, 6) AS adj_r2 FROM f""")
def regression_table(spark, sf_dir):
    out = ex.regression_table(sales(spark, sf_dir), "profit", ["treat_offer"], by=["consultant"])
    return out.withColumns({c: F.round(c, 6) for c in ("r2", "adj_r2")})
