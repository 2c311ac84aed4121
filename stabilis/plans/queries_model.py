"""Queries on the substitution model, with residue frequencies of the texts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import alignment as A
from ..operators import model as M
from . import views as V
from .registry import query
from .queries_sequences import SQL_KD, SQL_TABLE

# Shares of the residues over all families, and the ratio of purines to pyrimidines in nucleotides.
SQL_SHARES = V.SQL_SITES + ", share AS (SELECT aa, sum(n) / sum(sum(n)) OVER () AS share FROM counts GROUP BY aa)"
SQL_CODONS = f"""codon AS (SELECT unnest(map_keys(m)) AS codon, unnest(map_values(m)) AS aa FROM (SELECT {SQL_TABLE} AS m)),
base(b) AS (VALUES ('A'), ('C'), ('G'), ('T')),
step AS (SELECT codon, aa AS y, substr(codon, 1, i - 1) || b || substr(codon, i + 1) AS other, substr(codon, i, 1) || b IN ('AG', 'GA', 'CT', 'TC') AS ts
  FROM codon, base, (SELECT unnest([1, 2, 3]) AS i) WHERE substr(codon, i, 1) <> b AND aa <> '*'),
many AS (SELECT aa AS y, count(*) AS n FROM codon GROUP BY aa),
told AS (SELECT step.y, CASE WHEN o.aa = '*' THEN step.y ELSE o.aa END AS x, ts, n FROM step JOIN codon o ON o.codon = other JOIN many ON many.y = step.y)"""
SQL_FLUX = "SELECT x.aa AS x, y.aa AS y, round({c}, 9) AS c, round({c} * y.share, 9) AS flux FROM aas x, share y LEFT JOIN c ON c.x = x.aa AND c.y = y.aa"


def shares(spark, d):
    c = A.site_counts(V.proteins(spark, d)).groupBy("aa").agg(F.sum("n").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select(F.col("aa").alias("y"), (F.col("n") / F.col("total")).alias("share"))


def flux(spark, d, table):
    """The table with how often each change happens at the residues' shares."""
    f = table.join(F.broadcast(shares(spark, d)), "y")
    return f.select("x", "y", F.round("c", 9).alias("c"), F.round(F.col("c") * F.col("share"), 9).alias("flux"))


@query(f"WITH {SQL_SHARES} " + "SELECT x.aa AS x, y.aa AS y, 0.05::DOUBLE AS c, round(0.05::DOUBLE * y.share, 9) AS flux FROM aas x, share y")
def cset_all_equal(spark, d):
    return flux(spark, d, M.mutation_table(spark, "ALL_EQUAL"))


@query(f"WITH {SQL_SHARES}, {SQL_CODONS}, c AS (SELECT x, y, sum(1 / 9.0::DOUBLE / n) AS c FROM told GROUP BY ALL) " + SQL_FLUX.format(c="coalesce(c, 0)"))
def cset_codon_equal(spark, d):
    return flux(spark, d, M.mutation_table(spark, "CODON_EQUAL"))


def ratio(spark, d):
    """Purines to pyrimidines in all nucleotides, as one row."""
    n = V.nucleotides(spark, d)
    count = lambda s: F.sum(F.length(F.regexp_replace("nt", f"[^{s}]", "")))
    return n.agg((4 * count("AG") / F.nullif(count("CT"), F.lit(0))).alias("ratio"))


@query(
    f"""WITH {SQL_SHARES}, {SQL_CODONS}, {V.SQL_NT},
r AS (SELECT 4 * sum(length(regexp_replace(nt, '[^AG]', '', 'g'))) / sum(length(regexp_replace(nt, '[^CT]', '', 'g'))) AS r FROM nts),
c AS (SELECT x, y, sum(CASE WHEN ts THEN r / (1 + r) / 3 ELSE 1 / (1 + r) / 6 END / n) AS c FROM told, r GROUP BY ALL) """
    + SQL_FLUX.format(c="coalesce(c, 0)")
)
def cset_ts_tv(spark, d):
    value = float(ratio(spark, d).first()["ratio"] or 1.0)
    return flux(spark, d, M.mutation_table(spark, "TRANSITION_TRANSVERSION_RATIO", F.lit(value)))


SHIFT = math.log(M.GAMMA / (1 - M.GAMMA)) / 2


@query(
    f"""WITH {V.SQL_DDG}, p AS (SELECT * FROM ddg WHERE method = 'P20')
SELECT x.family, x.r::INT AS r, y.mut AS y, x.mut AS x, round(0.5 - 0.5 * (2 / (1 + exp(-2 * (0.265::DOUBLE * (x.ddg - y.ddg) - {SHIFT!r}::DOUBLE))) - 1), 9) AS f
FROM p x JOIN p y ON x.family = y.family AND x.r = y.r AND x.mut <> y.mut WHERE x.ddg IS NOT NULL AND y.ddg IS NOT NULL"""
)
def fixation_probability(spark, d):
    p = V.stabilities(spark, d).filter("method = 'P20' and ddg is not null")
    other = p.select("family", "r", F.col("mut").alias("y"), F.col("ddg").alias("ddg_y"))
    pairs = p.join(other, ["family", "r"]).filter("mut <> y")
    return pairs.select("family", "r", "y", F.col("mut").alias("x"), F.round(M.fixation(F.col("ddg"), F.col("ddg_y")), 9).alias("f"))


@query(
    f"""WITH {V.SQL_SITES}, k AS (SELECT refsites.family, site::INT AS r, wt, aa AS mut, abs({SQL_KD}[wt] - {SQL_KD}[aa]) * 1.5 + 1 AS v FROM refsites JOIN aas ON aa <> wt WHERE wt <> '-'),
c AS (SELECT *, greatest(-19.0, least(19.0, v)) AS center FROM k)
SELECT family, r, wt, mut, round(center, 9) AS center, round((center + 20) / 40 + 1, 9) AS alpha, round(2 - (center + 20) / 40, 9) AS beta FROM c"""
)
def prior_centers_kd(spark, d):
    refs = A.reference_sites(V.proteins(spark, d)).filter("wt <> '-'").withColumn("mut", F.explode(F.array(*map(F.lit, R.AMINO_ACIDS)))).filter("mut <> wt")
    p = M.prior_centers(refs, 1.5, 1.0)
    return p.select("family", F.col("site").alias("r"), "wt", "mut", F.round("center", 9).alias("center"), F.round("beta.alpha", 9).alias("alpha"), F.round("beta.beta", 9).alias("beta"))


# Powers of the matrix of one step, squared until all its columns are the distribution.
@query(
    f"""WITH RECURSIVE {V.SQL_DDG}, {SQL_CODONS},
c AS (SELECT x, y, sum(CASE WHEN ts THEN 4 / 15.0::DOUBLE ELSE 1 / 30.0::DOUBLE END / n) AS c FROM told GROUP BY ALL),
v AS MATERIALIZED (SELECT family, r, mut AS aa, coalesce(ddg, 5.0) AS v FROM ddg WHERE method = 'P20' UNION ALL SELECT DISTINCT family, r, wt, 0.0 FROM ddg WHERE method = 'P20'),
g AS MATERIALIZED (SELECT a.family, a.r, a.aa AS x, b.aa AS y, c * (0.5 - 0.5 * (2 / (1 + exp(-2 * (0.265::DOUBLE * (a.v - b.v) - {SHIFT!r}::DOUBLE))) - 1)) AS p
  FROM v a JOIN v b ON a.family = b.family AND a.r = b.r AND a.aa <> b.aa JOIN c ON c.x = a.aa AND c.y = b.aa),
power(k, family, r, x, y, p) AS (
  SELECT 0, * FROM (SELECT * FROM g UNION ALL SELECT family, r, y, y, 1 - sum(p) FROM g GROUP BY ALL)
  UNION ALL SELECT a.k + 1, a.family, a.r, a.x, b.y, sum(a.p * b.p) FROM power a JOIN power b ON a.family = b.family AND a.r = b.r AND a.y = b.x WHERE a.k < 18 GROUP BY ALL)
SELECT family, r::INT AS r, x AS aa, round(p / sum(p) OVER (PARTITION BY family, r), 9) AS p FROM power WHERE k = 18 AND y = 'A'"""
)
def stationary_distribution(spark, d):
    """Equilibrium shares of the residues at each site, from the stability table."""
    c = M.mutation_array(M.mutation_table(spark, "TRANSITION_TRANSVERSION_RATIO", F.lit(4.0)))
    wt = F.map_from_arrays(F.array(F.first("wt")), F.array(F.lit(0.0)))
    per = V.stabilities(spark, d).filter("method = 'P20'").groupBy("family", "r").agg(F.map_concat(F.map_from_entries(F.collect_list(F.struct("mut", F.coalesce("ddg", F.lit(5.0))))), wt).alias("m"))
    rows = per.select("family", "r", F.array(*[F.coalesce(F.try_element_at("m", F.lit(a)), F.lit(5.0)) for a in R.AMINO_ACIDS]).alias("ddg"))

    def run(frames):
        for df in frames:
            p = M.equilibrium(M.rates(np.array(df["ddg"].tolist(), float).reshape(-1, 20), c))
            yield pd.DataFrame({"family": df["family"], "r": df["r"], "p": [list(map(float, x)) for x in p]})

    shares_ = rows.mapInPandas(run, "family string, r int, p array<double>")
    return shares_.select("family", "r", F.posexplode("p").alias("i", "p")).select("family", "r", F.element_at(F.array(*map(F.lit, R.AMINO_ACIDS)), F.col("i") + 1).alias("aa"), F.round("p", 9).alias("p"))
