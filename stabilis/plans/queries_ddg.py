"""Queries on stability tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import ddg as D
from . import views as V
from .registry import query

KEYS = "family, r::INT AS r, wt, mut"


def one(spark, d, method):
    return V.stabilities(spark, d).filter(F.col("method") == method)


def rounded(df):
    return df.withColumn("ddg", F.round("ddg", 8))


@query(f"WITH {V.SQL_SITES} SELECT w.family, w.site::INT AS r, wt, m.aa AS mut, round(ln((w.n + 1)::DOUBLE / (m.n + 1)), 8) AS ddg FROM refsites JOIN counts w ON w.family = refsites.family AND w.site = refsites.site AND w.aa = wt JOIN counts m ON m.family = w.family AND m.site = w.site AND m.aa <> wt")
def consensus_ddgs(spark, d):
    p = V.proteins(spark, d)
    return rounded(D.consensus(A.site_counts(p), A.reference_sites(p), 1)).select("family", "r", "wt", "mut", "ddg")


SQL_RANKED = V.SQL_DDG + ", ranked AS (SELECT *, wt || r || mut AS mutation, row_number() OVER (PARTITION BY method, family ORDER BY ddg NULLS FIRST, wt || r || mut) AS rank FROM ddg)"


@query(f"WITH {SQL_RANKED} SELECT method, family, mutation, round(ddg, 8) AS ddg, rank::INT AS rank FROM ranked")
def sorted_ddgs(spark, d):
    return rounded(D.ranked(V.stabilities(spark, d))).select("method", "family", "mutation", "ddg", "rank")


@query(f"WITH {V.SQL_DDG} SELECT method, family, wt || r || mut AS mutation, round(ddg, 8) AS ddg FROM ddg WHERE ddg IS NOT NULL ORDER BY ddg.ddg, mutation, family, method LIMIT 20")
def topk(spark, d):
    return rounded(D.top_k(V.stabilities(spark, d).filter("ddg is not null"), 20)).select("method", "family", "mutation", "ddg")


@query(
    f"""WITH {V.SQL_DDG}, b AS (SELECT method, family, r, wt || r || mut AS mutation, ddg, row_number() OVER (PARTITION BY method, family, r ORDER BY ddg, wt || r || mut) AS k FROM ddg WHERE ddg IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY method, family ORDER BY ddg, mutation) AS rank FROM b WHERE k = 1)
SELECT method, family, rank::INT AS rank, mutation, round(ddg, 8) AS ddg FROM q WHERE rank <= 10"""
)
def best_per_residue(spark, d):
    return rounded(D.best_per_residue(V.stabilities(spark, d), 10))


def selected(ranked):
    """The selected mutations: each residue's change to alanine or, of alanine, to glycine."""
    return ranked.filter("mut = case when wt = 'A' then 'G' else 'A' end")


SQL_SELECTED = "mut = CASE WHEN wt = 'A' THEN 'G' ELSE 'A' END"


@query(f"WITH {SQL_RANKED} SELECT method, family, mutation, rank::INT AS rank FROM ranked WHERE {SQL_SELECTED}")
def rank_selected(spark, d):
    return selected(D.ranked(V.stabilities(spark, d))).select("method", "family", "mutation", "rank")


@query(f"WITH {SQL_RANKED} SELECT method, family, round(avg(rank), 6) AS mean_rank, median(rank)::DOUBLE AS median_rank, count(*) AS n FROM ranked WHERE {SQL_SELECTED} GROUP BY ALL")
def mean_median_rank(spark, d):
    s = selected(D.ranked(V.stabilities(spark, d)))
    return s.groupBy("method", "family").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.median("rank").alias("median_rank"), F.count("*").alias("n"))


# One pass over the table for each key, in place of joins of the table with itself.
SQL_BY_METHOD = f"""WITH {V.SQL_DDG}, by_method AS (
  SELECT family, r, wt, mut, max(ddg) FILTER (WHERE method = 'P1') AS p1, max(ddg) FILTER (WHERE method = 'P5') AS p5 FROM ddg GROUP BY family, r, wt, mut)"""


@query(f"{SQL_BY_METHOD} SELECT family, r::INT AS r, wt, mut, round(p1, 8) AS p1, round(p5, 8) AS p5 FROM by_method WHERE p1 IS NOT NULL AND p5 IS NOT NULL")
def zipped_ddgs(spark, d):
    z = D.zipped({"p1": one(spark, d, "P1"), "p5": one(spark, d, "P5")})
    return z.select("family", "r", "wt", "mut", F.round("p1", 8).alias("p1"), F.round("p5", 8).alias("p5"))


@query(f"WITH {V.SQL_DDG} SELECT family, round(corr(a.ddg, b.ddg), 8) AS corr, count(*) AS n FROM ddg a JOIN ddg b USING (family, r, wt, mut) JOIN ddg c USING (family, r, wt, mut) WHERE a.method = 'P1' AND b.method = 'P5' AND c.method = 'P20' AND a.ddg IS NOT NULL AND b.ddg IS NOT NULL AND c.ddg IS NOT NULL GROUP BY family")
def correlate_ddgs(spark, d):
    c = D.correlate(one(spark, d, "P1"), one(spark, d, "P5"), one(spark, d, "P20"))
    return c.select("family", F.round("corr", 8).alias("corr"), "n")


@query(f"{SQL_BY_METHOD} SELECT family, r::INT AS r, wt, mut, CASE WHEN p5 > 1 THEN round(p1, 8) END AS ddg FROM by_method")
def restrict_to_partner(spark, d):
    partner = one(spark, d, "P5").withColumn("ddg", F.when(F.col("ddg") > 1, F.col("ddg")))
    return rounded(D.restrict(one(spark, d, "P1").drop("method"), partner)).select("family", "r", "wt", "mut", "ddg")


@query(f"WITH {V.SQL_DDG}, w AS (SELECT family, site AS r, wt, unnest(['A', 'V', 'W']) AS mut FROM refsites), p AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY r DESC, mut) AS place FROM w) SELECT family, place::INT AS place, r::INT AS r, wt, mut, round(ddg, 8) AS ddg FROM p LEFT JOIN (SELECT * FROM ddg WHERE method = 'P1') d USING (family, r, wt, mut)")
def get_ddgs(spark, d):
    from pyspark.sql import Window

    refs = A.reference_sites(V.proteins(spark, d)).withColumnRenamed("site", "r").withColumn("mut", F.explode(F.array(*map(F.lit, "AVW"))))
    wanted = refs.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("r"), "mut")))
    return rounded(D.lookup(one(spark, d, "P1"), wanted)).select("family", "place", "r", "wt", "mut", "ddg")


SQL_FILL = "SELECT family, site::INT AS r, wt, aa AS mut, {value} AS ddg FROM refsites JOIN aas ON aa <> wt LEFT JOIN (SELECT family AS f, r, mut AS m, ddg FROM ddg WHERE method = 'P20') d ON f = family AND d.r = site AND m = aa {more} WHERE wt IN (SELECT aa FROM aas)"


@query(f"WITH {V.SQL_DDG} " + SQL_FILL.format(value="round(coalesce(ddg, 5.0), 8)", more=""))
def fill_empty_const(spark, d):
    return rounded(D.filled(one(spark, d, "P20"), A.reference_sites(V.proteins(spark, d)), 5.0)).select("family", "r", "wt", "mut", "ddg")


@query(f"WITH {V.SQL_DDG}, mean AS (SELECT family AS mf, avg(ddg) AS mean FROM ddg WHERE method = 'P20' GROUP BY ALL) " + SQL_FILL.format(value="round(coalesce(ddg, mean), 8)", more="LEFT JOIN mean ON mf = family"))
def fill_empty_mean(spark, d):
    return rounded(D.filled(one(spark, d, "P20"), A.reference_sites(V.proteins(spark, d)), "MEAN")).select("family", "r", "wt", "mut", "ddg")


def sql_rescale(recenter: float, scale: str, clamp: str = "x") -> str:
    return f"""WITH {V.SQL_DDG}, c AS (SELECT method, family, r, wt, mut, ddg + ({recenter} - avg(ddg) OVER (PARTITION BY method, family)) AS s FROM ddg),
l AS (SELECT method, family, list_sort(list(s) FILTER (WHERE s IS NOT NULL)) AS l, stddev_pop(s) AS sd FROM c GROUP BY ALL),
f AS (SELECT method, family, {scale} AS scale FROM l), y AS (SELECT c.*, {recenter} + (s - {recenter}) * scale AS x FROM c JOIN f USING (method, family))
SELECT method, family, r::INT AS r, wt, mut, round({clamp}, 7) AS ddg FROM y"""


def rescale(spark, d, *how):
    out = D.rescaled(V.stabilities(spark, d), *how).withColumn("ddg", F.round("ddg", 7))
    return out.select("method", "family", "r", "wt", "mut", "ddg")


@query(sql_rescale(1.0, "2.0 / sd"))
def rescale_sd(spark, d):
    return rescale(spark, d, "STANDARD_DEVIATION", 2.0, 1.0)


@query(sql_rescale(1.0, "6.0 / (l[1 + floor(0.9::DOUBLE * len(l))::INT] - l[1 + floor(0.1::DOUBLE * len(l))::INT])", "CASE WHEN x IS NOT NULL THEN greatest(-4.0, least(9.0, x)) END"))
def rescale_10_90(spark, d):
    return rescale(spark, d, "10TH_TO_90TH", 6.0, 1.0, (-4.0, 9.0))


@query(sql_rescale(1.0, "CASE WHEN l[1 + floor(0.3::DOUBLE * len(l))::INT] < 1 THEN 1.0 / (1.0 - l[1 + floor(0.3::DOUBLE * len(l))::INT]) END"))
def rescale_frac_negative(spark, d):
    return rescale(spark, d, "FRAC_NEGATIVE", 0.3, 1.0)


SQL_PARTNER = "prot2 AS (SELECT family, site AS r, wt, CASE WHEN site % 2 = 0 THEN wt WHEN wt = 'L' THEN 'I' ELSE 'L' END AS prot FROM refsites WHERE wt <> '-')"


@query(
    f"""WITH {V.SQL_DDG}, {SQL_PARTNER}, d AS (SELECT family, r, wt, mut, ddg FROM ddg WHERE method = 'P1' UNION ALL SELECT DISTINCT family, r, wt, wt, 0.0 FROM ddg WHERE method = 'P1')
SELECT d.family, d.r::INT AS r, prot AS wt, d.mut, round(CASE WHEN prot = d.wt THEN d.ddg ELSE d.ddg - b.ddg END, 8) AS ddg
FROM d JOIN prot2 USING (family, r) LEFT JOIN (SELECT family, r, mut, ddg FROM ddg WHERE method = 'P1') b ON b.family = d.family AND b.r = d.r AND b.mut = prot WHERE d.mut <> prot"""
)
def rebase_to_structure(spark, d):
    refs = A.reference_sites(V.proteins(spark, d)).filter("wt <> '-'").withColumnRenamed("site", "r")
    pairs = refs.withColumn("prot", F.when(F.col("r") % 2 == 0, F.col("wt")).otherwise(F.when(F.col("wt") == "L", "I").otherwise("L")))
    return rounded(D.rebased(one(spark, d, "P1").drop("method"), pairs)).select("family", "r", "wt", "mut", "ddg")


@query(f"WITH {V.SQL_DDG} SELECT family, r::INT AS r, wt, mut, round(avg(ddg), 8) AS ddg, count(ddg) AS n FROM ddg GROUP BY ALL")
def average_duplicates(spark, d):
    return rounded(D.averaged(V.stabilities(spark, d))).select("family", "r", "wt", "mut", "ddg", "n")


@query(f"WITH {V.SQL_DDG} SELECT family, round(avg(ddg), 8) AS mean, count(ddg) AS n FROM ddg WHERE r BETWEEN 5 AND 40 GROUP BY ALL")
def residue_range(spark, d):
    return V.stabilities(spark, d).filter(F.col("r").between(5, 40)).groupBy("family").agg(F.round(F.avg("ddg"), 8).alias("mean"), F.count("ddg").alias("n"))
