"""Queries that apply the statistics to the numeric tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import statistics as S
from . import views as V
from .registry import query

FLAGS = ["l_returnflag", "l_linestatus"]
C = S.ERFC_FIT
SQL_ERFC_POLY = f"{C[-1]}::DOUBLE"
for _c in reversed(C[:-1]):
    SQL_ERFC_POLY = f"({_c}::DOUBLE + t * {SQL_ERFC_POLY})"


def sql_erfc(z: str, source: str) -> str:
    """A query that adds ``e``, the erfc of column ``z``, to the rows of ``source``."""
    return f"SELECT *, CASE WHEN {z} > 0 THEN f ELSE 2 - f END AS e FROM (SELECT *, t * exp(-{z} * {z} + {SQL_ERFC_POLY}) AS f FROM (SELECT *, 1 / (1 + 0.5::DOUBLE * abs({z})) AS t FROM {source}))"


def lineitem(spark, d):
    return V.table(spark, d, "lineitem")


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL")
def mean(spark, d):
    return lineitem(spark, d).groupBy(*FLAGS).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("SELECT l_returnflag, l_linestatus, median(l_quantity) AS median FROM lineitem GROUP BY ALL")
def median(spark, d):
    # the values of a quantity are few, so counts of values are what is gathered
    per = lineitem(spark, d).groupBy(*FLAGS, "l_quantity").agg(F.count("*").alias("n"))
    return per.groupBy(*FLAGS).agg(F.expr("percentile(l_quantity, 0.5D, n)").alias("median"))


@query("SELECT l_returnflag, l_linestatus, round(var_pop(l_discount), 9) AS variance FROM lineitem GROUP BY ALL")
def variance_pop(spark, d):
    return lineitem(spark, d).groupBy(*FLAGS).agg(F.round(F.var_pop("l_discount"), 9).alias("variance"))


@query("SELECT l_returnflag, l_linestatus, round(var_samp(l_discount), 9) AS variance FROM lineitem GROUP BY ALL")
def variance_samp(spark, d):
    return lineitem(spark, d).groupBy(*FLAGS).agg(F.round(F.var_samp("l_discount"), 9).alias("variance"))


@query("SELECT l_returnflag, l_linestatus, round(stddev_pop(l_discount), 9) AS sd FROM lineitem GROUP BY ALL")
def standard_deviation(spark, d):
    return lineitem(spark, d).groupBy(*FLAGS).agg(F.round(F.stddev_pop("l_discount"), 9).alias("sd"))


@query("SELECT event_type, round(stddev_pop(CASE WHEN value > 1 THEN value END) / sqrt(count(*)), 7) AS se FROM events GROUP BY ALL")
def std_error(spark, d):
    x = F.when(F.col("value") > 1, F.col("value"))
    return V.table(spark, d, "events").groupBy("event_type").agg(F.round(S.standard_error(x), 7).alias("se"))


@query(f"WITH c AS (SELECT l_returnflag, l_linestatus, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY ALL), z AS (SELECT *, abs(r) * sqrt(n) / {math.sqrt(2)!r}::DOUBLE AS z FROM c) SELECT l_returnflag, l_linestatus, round(r, 9) AS r, round(e, 9) AS p, n FROM ({sql_erfc('z', 'z')})")
def pearson(spark, d):
    c = lineitem(spark, d).groupBy(*FLAGS).agg(S.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("c"))
    return c.select(*FLAGS, F.round("c.r", 9).alias("r"), F.round("c.p", 9).alias("p"), "c.n")


@query(f"WITH z AS (SELECT event_id, (value - 10) / 5 AS z FROM events) SELECT event_id, round(e, 9) AS erfc FROM ({sql_erfc('z', 'z')})")
def erfc(spark, d):
    return V.table(spark, d, "events").select("event_id", F.round(S.erfc((F.col("value") - 10) / 5), 9).alias("erfc"))


BETA = (2.5, 3.5, 0.0, 51.0)
NORM = math.exp(S.log_beta(BETA[0], BETA[1]))


@query(f"SELECT l_quantity, count(*) AS n, round(pow(l_quantity / 51, 1.5) * pow(1 - l_quantity / 51, 2.5) / ({NORM!r}::DOUBLE * 51), 9) AS pdf FROM lineitem GROUP BY l_quantity")
def beta_pdf(spark, d):
    return lineitem(spark, d).groupBy("l_quantity").agg(F.count("*").alias("n")).withColumn("pdf", F.round(S.beta_pdf(F.col("l_quantity"), *BETA), 9))


@query(f"WITH u AS (SELECT l_quantity, count(*) AS n, l_quantity / 51 AS u FROM lineitem GROUP BY l_quantity) SELECT l_quantity, n, round((1.5 * pow(u, 0.5) * pow(1 - u, 2.5) - 2.5 * pow(u, 1.5) * pow(1 - u, 1.5)) / ({NORM!r}::DOUBLE * 51 * 51), 9) AS slope FROM u")
def beta_pdf_derivative(spark, d):
    return lineitem(spark, d).groupBy("l_quantity").agg(F.count("*").alias("n")).withColumn("slope", F.round(S.beta_pdf_derivative(F.col("l_quantity"), *BETA), 9))


@query("WITH s AS (SELECT l_orderkey, avg(l_discount) / 0.2::DOUBLE AS s FROM lineitem GROUP BY ALL) SELECT l_orderkey, round(s * 1 + 1, 9) AS alpha, round(3 - (s * 1 + 1), 9) AS beta, round(s * 3, 9) AS mean_alpha FROM s")
def beta_parameters(spark, d):
    s = lineitem(spark, d).groupBy("l_orderkey").agg(F.avg("l_discount").alias("c"))
    mode, mean_ = S.beta_parameters(F.col("c"), 3, 0, 0.2), S.beta_parameters(F.col("c"), 3, 0, 0.2, "MEAN")
    return s.select("l_orderkey", F.round(mode["alpha"], 9).alias("alpha"), F.round(mode["beta"], 9).alias("beta"), F.round(mean_["alpha"], 9).alias("mean_alpha"))


@query(
    """WITH s AS (SELECT l_returnflag, l_linestatus, l_discount AS x, l_extendedprice AS y FROM lineitem),
q AS (SELECT l_returnflag, l_linestatus, sum(y) AS w, sum(x * y) AS wx, sum(x * x * y) AS wxx, sum(y * ln(y)) AS wl, sum(x * y * ln(y)) AS wxl FROM s GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(exp((wxx * wl - wx * wxl) / (w * wxx - wx * wx)), 3) AS a, round((w * wxl - wx * wl) / (w * wxx - wx * wx), 6) AS b FROM q"""
)
def fit_exponential(spark, d):
    f = lineitem(spark, d).groupBy(*FLAGS).agg(S.fit_exponential(F.col("l_discount"), F.col("l_extendedprice")).alias("f"))
    return f.select(*FLAGS, F.round("f.a", 3).alias("a"), F.round("f.b", 6).alias("b"))


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")
def normalize(spark, d):
    # sums are added up before the shuffle and joined, so a key with many rows is no large group
    orders = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    total = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return orders.join(total, "o_custkey").select("o_orderkey", F.round(F.col("o_totalprice") / F.nullif(F.col("total"), F.lit(0.0)), 9).alias("share"))


SQL_WELCH = """WITH s AS (SELECT l_linestatus, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS m1, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') / nullif(count(*) FILTER (WHERE l_returnflag = 'A'), 0) AS a,
  count(*) FILTER (WHERE l_returnflag = 'A') AS n1, avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'A') AS m2, var_samp(l_extendedprice) FILTER (WHERE l_returnflag <> 'A') / nullif(count(*) FILTER (WHERE l_returnflag <> 'A'), 0) AS b,
  count(*) FILTER (WHERE l_returnflag <> 'A') AS n2 FROM lineitem GROUP BY ALL)
SELECT l_linestatus, round((m1 - m2) / sqrt(a + b), 7) AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 4) AS df FROM s"""


def welch_rows(spark, d):
    x, one = F.col("l_extendedprice"), F.col("l_returnflag") == "A"
    side = lambda c: (F.avg(F.when(c, x)), F.var_samp(F.when(c, x)), F.nullif(F.count(F.when(c, x)), F.lit(0)))
    return lineitem(spark, d).groupBy("l_linestatus").agg(S.welch(*side(one), *side(~one)).alias("w"))


@query(SQL_WELCH)
def welch_t(spark, d):
    return welch_rows(spark, d).select("l_linestatus", F.round("w.t", 7).alias("t"), F.round("w.df", 4).alias("df"))


# The share of Student's density within t, integrated over its angle by Simpson's rule.
@query(
    SQL_WELCH.replace("round((m1 - m2) / sqrt(a + b), 7) AS t, round(", "(m1 - m2) / sqrt(a + b) AS t, (").replace("(n2 - 1)), 4)", "(n2 - 1)))").replace("WITH s", "WITH w AS (WITH s")
    + """), a AS (SELECT *, atan(abs(t) / sqrt(df)) AS top, unnest(range(0, 4001)) AS i FROM w),
f AS (SELECT l_linestatus, df, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * cos(top * i / 4000) ** (df - 1) * top / 12000) AS area FROM a GROUP BY ALL)
SELECT w.l_linestatus, round(1 - 2 * area * exp(lgamma((w.df + 1) / 2) - lgamma(w.df / 2)) / sqrt(pi()), 7) AS p FROM w LEFT JOIN f USING (l_linestatus)"""
)
def welch_p(spark, d):
    return welch_rows(spark, d).select("l_linestatus", F.round(S.welch_p(F.col("w.t"), F.col("w.df")), 7).alias("p"))


@query("SELECT l_returnflag, l_linestatus, round(exp(avg(ln(l_extendedprice))), 4) AS gm, round(exp(stddev_pop(ln(l_extendedprice))), 6) AS gsd, round(exp(stddev_pop(ln(l_extendedprice)) / sqrt(count(*))), 8) AS gse FROM lineitem GROUP BY ALL")
def geometric_stats(spark, d):
    g = lineitem(spark, d).groupBy(*FLAGS).agg(S.geometric(F.col("l_extendedprice")).alias("g"))
    return g.select(*FLAGS, F.round("g.gm", 4).alias("gm"), F.round("g.gsd", 6).alias("gsd"), F.round("g.gse", 8).alias("gse"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 100000) = 0 AS all_none FROM orders GROUP BY ALL")
def all_none(spark, d):
    return V.table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.when(F.col("o_totalprice") > 100000, 1)) == 0).alias("all_none"))
