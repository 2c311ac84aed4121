"""Operators on stability tables: (method, family, r, wt, mut, ddg), ddg null if undefined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import residues as R
from ..functions import statistics as S

KEY = ["family", "r", "wt", "mut"]


def mutation_counts(counts: DataFrame, refs: DataFrame) -> DataFrame:
    """(family, r, wt, mut, n_wt, n): counts of both residues of each mutation of the reference."""
    wt = counts.join(refs, ["family", "site"]).filter("aa = wt").select("family", "site", "wt", F.col("n").alias("n_wt"))
    both = counts.join(wt, ["family", "site"]).filter("aa <> wt")
    return both.select("family", F.col("site").alias("r"), "wt", F.col("aa").alias("mut"), "n_wt", "n")


def log_odds(pseudocount: Column, threshold: Column) -> Column:
    """ln(n_wt / n) of counts with a pseudocount; null below a threshold."""
    n, n_wt = F.col("n") + pseudocount, F.col("n_wt") + pseudocount
    return F.when((n >= threshold) & (n_wt >= threshold) & (n > 0) & (n_wt > 0), F.log(n_wt / n))


def consensus(counts: DataFrame, refs: DataFrame, pseudocount: float = 1, threshold: float = 0) -> DataFrame:
    """ln(n_wt / n_mut) for each mutation of the reference; null below ``threshold`` counts."""
    return mutation_counts(counts, refs).select("family", "r", "wt", "mut", log_odds(F.lit(pseudocount), F.lit(threshold)).alias("ddg"))


def consensus_by(counts: DataFrame, refs: DataFrame, methods: dict[str, tuple[float, float]]) -> DataFrame:
    """(method, family, r, wt, mut, ddg) for several (pseudocount, threshold), from one pass over the counts."""
    kinds = F.array(*(F.struct(F.lit(k).alias("method"), F.lit(float(p)).alias("p"), F.lit(float(t)).alias("t")) for k, (p, t) in methods.items()))
    each = mutation_counts(counts, refs).withColumn("m", F.explode(kinds))
    return each.select("m.method", "family", "r", "wt", "mut", log_odds(F.col("m.p"), F.col("m.t")).alias("ddg"))


def code() -> Column:
    return R.mutation_code(F.col("wt"), F.col("r"), F.col("mut"))


def ranked(ddg: DataFrame) -> DataFrame:
    """Rank by value, then mutation code, for each method and family; undefined ones come first."""
    w = Window.partitionBy("method", "family").orderBy(F.col("ddg").asc_nulls_first(), "mutation")
    return ddg.withColumn("mutation", code()).withColumn("rank", F.row_number().over(w))


def top_k(ddg: DataFrame, k: int) -> DataFrame:
    return ddg.withColumn("mutation", code()).orderBy(F.col("ddg").asc_nulls_first(), "mutation", "family", "method").limit(k)


def best_per_residue(ddg: DataFrame, k: int) -> DataFrame:
    """The best mutation of each residue, then the best ``k`` of each method and family."""
    best = ddg.withColumn("mutation", code()).filter("ddg is not null").groupBy("method", "family", "r").agg(F.min(F.struct("ddg", "mutation")).alias("x"))
    w = Window.partitionBy("method", "family").orderBy("x.ddg", "x.mutation")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("method", "family", "rank", "x.mutation", "x.ddg")


def zipped(tables: dict[str, DataFrame]) -> DataFrame:
    """Mutations defined in all tables, with a column for each."""
    named = [t.filter("ddg is not null").select(*KEY, F.col("ddg").alias(k)) for k, t in tables.items()]
    return reduce(lambda a, b: a.join(b, KEY), named)


def correlate(a: DataFrame, b: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(family, r, p, n) of two tables over mutations defined in both, and in ``among`` if given."""
    both = zipped({"x": a, "y": b})
    if among is not None:
        both = both.join(among.filter("ddg is not null").select(*KEY), KEY, "left_semi")
    return both.groupBy("family").agg(S.pearson(F.col("x"), F.col("y")).alias("c")).select("family", F.col("c.r").alias("corr"), "c.p", "c.n")


def restrict(a: DataFrame, partner: DataFrame) -> DataFrame:
    """``a`` with null where the partner has none."""
    p = partner.select(*KEY, F.col("ddg").alias("other"))
    return a.join(p, KEY, "left").withColumn("ddg", F.when(F.col("other").isNotNull(), F.col("ddg"))).drop("other")


def lookup(ddg: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """Values of requested (family, place, r, wt, mut) rows, in order of ``place``.

    A missing mutation gives null, or an error if ``strict``.
    """
    out = wanted.join(ddg.select(*KEY, "ddg", F.lit(True).alias("have")), KEY, "left")
    if strict:
        out = out.withColumn("ddg", F.when(F.col("have"), F.col("ddg")).otherwise(F.raise_error(F.lit("no such mutation")).cast("double")))
    return out.drop("have")


def of_residues(ddg: DataFrame, wanted: DataFrame) -> DataFrame:
    """All values of requested (family, place, r) residues; one that isn't there gives no row."""
    return wanted.join(ddg.select(*KEY, "ddg"), ["family", "r"]).select("family", "place", "r", "wt", "mut", "ddg")


def listed(ddg: DataFrame) -> DataFrame:
    """All values of each family, their place that of residue and mutation."""
    w = Window.partitionBy("family").orderBy("r", "mut")
    return ddg.select("family", (F.row_number().over(w)).alias("place"), "ddg")


def sorted_lines(ddg: DataFrame) -> DataFrame:
    """(method, family, rank, value): the lines of sorted lists, for a text sink."""
    value = F.when(F.col("ddg").isNull(), F.lit("None")).otherwise(F.format_string("%.4f", "ddg"))
    return ranked(ddg).select("method", "family", "rank", F.concat("mutation", F.lit("\t"), value).alias("value"))


def structure_residues(refs: DataFrame, offset: int, chain: str) -> DataFrame:
    """(family, r, wt, chain, structure_r): residues numbered on a structure by an offset.

    Residues of the reference are numbered from 1, gaps left out.
    """
    w = Window.partitionBy("family").orderBy("site")
    own = refs.filter("wt <> '-'").withColumn("r", F.row_number().over(w))
    return own.select("family", "r", "wt", F.lit(chain).alias("chain"), (F.col("r") + offset).cast("string").alias("structure_r"))


def filled(ddg: DataFrame, refs: DataFrame, value: float | str | None = None) -> DataFrame:
    """All 19 mutations of each reference residue; undefined ones get a constant or the mean."""
    aas = F.explode(F.array(*map(F.lit, R.AMINO_ACIDS))).alias("mut")
    grid = refs.filter(F.col("wt").isin(*R.AMINO_ACIDS)).select("family", F.col("site").alias("r"), "wt", aas).filter("mut <> wt")
    out = grid.join(ddg.select(*KEY, "ddg"), KEY, "left")
    if value == "MEAN":
        mean = ddg.groupBy("family").agg(F.avg("ddg").alias("mean"))
        return out.join(mean, "family", "left").withColumn("ddg", F.coalesce("ddg", "mean")).drop("mean")
    return out if value is None else out.withColumn("ddg", F.coalesce("ddg", F.lit(float(value))))


def at_index(fraction: float) -> Column:
    """The element int(fraction n) of the sorted defined values of a group, with no interpolation.

    A group is the mutations of one family, 19 for each residue.
    """
    values = F.array_sort(F.collect_list("shifted"))
    return F.element_at(values, F.floor(F.lit(float(fraction)) * F.size(values)).cast("int") + 1)


def rescaled(ddg: DataFrame, kind: str, value: float, recenter: float | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """Values of each method and family shifted to the mean ``recenter``, scaled about it, clamped.

    ``kind``: STANDARD_DEVIATION (the deviation becomes ``value``), 10TH_TO_90TH (that range
    does), FRAC_NEGATIVE (a share ``value`` becomes negative).  Undefined values stay so.
    """
    by = ["method", "family"]
    if recenter is not None:
        mean = ddg.groupBy(*by).agg((F.lit(float(recenter)) - F.avg("ddg")).alias("shift"))
        ddg = ddg.join(mean, by)
    else:
        ddg = ddg.withColumn("shift", F.lit(0.0))
    ddg = ddg.withColumn("shifted", F.col("ddg") + F.col("shift"))
    center = F.lit(float(recenter or 0))
    if kind == "STANDARD_DEVIATION":
        scale = F.lit(float(value)) / F.nullif(F.stddev_pop("shifted"), F.lit(0.0))
    elif kind == "10TH_TO_90TH":
        scale = F.lit(float(value)) / F.nullif(at_index(0.9) - at_index(0.1), F.lit(0.0))
    elif kind == "FRAC_NEGATIVE":
        gap = center - at_index(value)
        scale = F.when((gap != 0) & (F.signum(gap) == F.signum(center)), center / gap)
    else:
        raise ValueError(kind)
    scales = ddg.groupBy(*by).agg(scale.alias("scale"))
    out = center + (F.col("shifted") - center) * F.col("scale")
    if limits:
        out = F.when(out.isNotNull(), F.greatest(F.lit(float(limits[0])), F.least(F.lit(float(limits[1])), out)))
    return ddg.join(scales, by).withColumn("ddg", out).drop("shift", "shifted", "scale")


def rebased(ddg: DataFrame, residues: DataFrame, strict: bool = False) -> DataFrame:
    """Values measured on a structure, for the protein's own residues.

    ``residues``: (family, r, prot, wt) pairs the residue of the protein with that of the
    structure; where they differ, the value of the protein's residue is taken off.  With
    ``strict``, a residue without any value, one whose own value is missing where it is needed, and
    two values of one mutation are errors.
    """
    if strict:
        fail = lambda why: F.raise_error(F.concat_ws(" ", F.lit(why), F.col("family").cast("string"), F.col("r").cast("string"))).cast("string")
        n = ddg.groupBy("family", "r", "mut").agg(F.count("*").alias("k"), F.count("ddg").alias("known"), F.first("wt").alias("wt_of"))
        ddg = ddg.join(n, ["family", "r", "mut"]).withColumn("mut", F.when(F.col("k") == 1, F.col("mut")).otherwise(fail("a mutation has two values:"))).drop("k", "known", "wt_of")
        base = n.select("family", "r", F.col("mut").alias("prot"), "known")
        any_ = ddg.select("family", "r", "wt").distinct()
        told = residues.select("family", "r", "prot").distinct().join(any_, ["family", "r"], "left").join(base, ["family", "r", "prot"], "left")
        good = F.col("wt").isNotNull() & ((F.col("wt") == F.col("prot")) | (F.coalesce("known", F.lit(0)) > 0))
        residues = told.select("family", "r", F.when(good, F.col("prot")).otherwise(fail("no value for the residue:")).alias("prot"))
    own = ddg.select("family", "r", F.col("mut").alias("prot"), F.col("ddg").alias("base"))
    every = ddg.select("family", "r", "wt", "mut", "ddg").unionByName(ddg.select("family", "r", "wt", F.col("wt").alias("mut"), F.lit(0.0).alias("ddg")).distinct())
    out = every.join(residues.select("family", "r", "prot"), ["family", "r"]).join(own, ["family", "r", "prot"], "left")
    value = F.when(F.col("prot") == F.col("wt"), F.col("ddg")).otherwise(F.col("ddg") - F.col("base"))
    return out.filter("mut <> prot").select("family", "r", F.col("prot").alias("wt"), "mut", value.alias("ddg"))


def averaged(measured: DataFrame) -> DataFrame:
    """One value for each mutation: the mean of what was measured."""
    return measured.groupBy(*KEY).agg(F.avg("ddg").alias("ddg"), F.count("ddg").alias("n"))
