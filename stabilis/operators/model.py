"""The substitution model: codon mutation probabilities, fixation and rate matrices.

Small 20 by 20 matrices are numpy arrays inside tasks; the tables that make them are DataFrames.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import residues as R

#: Shape of the fixation curve.
GAMMA, BETA = 0.8, 0.265
TRANSITIONS = {"A": "G", "G": "A", "C": "T", "T": "C"}


def codons(spark: SparkSession) -> DataFrame:
    """(codon, aa) of the 61 coding codons and the stops."""
    return spark.createDataFrame(list(R.codon_table().items()), "codon string, aa string")


def neighbours() -> list[tuple[str, str, bool]]:
    """Codons that differ in one base, and whether by a transition."""
    out = []
    for codon in map("".join, itertools.product(R.BASES, repeat=3)):
        for i, b in itertools.product(range(3), R.BASES):
            if b != codon[i]:
                out.append((codon, codon[:i] + b + codon[i + 1 :], TRANSITIONS[codon[i]] == b))
    return out


def mutation_table(spark: SparkSession, kind: str, ratio: Column | None = None) -> DataFrame:
    """(x, y, c): probability that a mutation of residue y gives x; 400 rows, 1 for each y.

    ``kind``: ALL_EQUAL; CODON_EQUAL, all single-base changes alike; TRANSITION_TRANSVERSION_RATIO,
    where transitions are ``ratio`` times as likely as transversions.  Changes to a stop count
    as staying at y, and y's codons are averaged.
    """
    aas = spark.createDataFrame([(a,) for a in R.AMINO_ACIDS], "aa string")
    grid = aas.select(F.col("aa").alias("x")).crossJoin(aas.select(F.col("aa").alias("y")))
    if kind == "ALL_EQUAL":
        return grid.withColumn("c", F.lit(1 / 20))
    steps = spark.createDataFrame(neighbours(), "codon string, other string, ts boolean")
    if kind == "CODON_EQUAL":
        p = F.lit(1 / 9)
    else:
        # one of a codon's three bases, then its one transition or one of two transversions
        p = F.when(F.col("ts"), ratio / (1 + ratio) / 3).otherwise(F.lit(1.0) / (1 + ratio) / 6)
    table = codons(spark)
    per = table.groupBy("aa").agg(F.count("*").alias("n"))
    told = steps.join(table.select("codon", F.col("aa").alias("y")), "codon").join(table.select(F.col("codon").alias("other"), F.col("aa").alias("x")), "other").filter("y <> '*'")
    told = told.join(per.select(F.col("aa").alias("y"), "n"), "y").withColumn("x", F.when(F.col("x") == "*", F.col("y")).otherwise(F.col("x")))
    c = told.groupBy("x", "y").agg(F.sum(p / F.col("n")).alias("c"))
    return grid.join(c, ["x", "y"], "left").select("x", "y", F.coalesce("c", F.lit(0.0)).alias("c"))


def mutation_array(table: DataFrame) -> np.ndarray:
    """The 400 rows of a mutation table as c[x, y]."""
    out = np.zeros((20, 20))
    for r in table.collect():
        out[R.AMINO_ACIDS.index(r["x"]), R.AMINO_ACIDS.index(r["y"])] = r["c"]
    return out


def fixation(ddg_x: Column, ddg_y: Column) -> Column:
    """Probability that a mutation from y to x is fixed."""
    shift = float(np.log(GAMMA / (1 - GAMMA)) / 2)
    return F.lit(0.5) - F.lit(0.5) * F.tanh((ddg_x - ddg_y) * BETA - shift)


def fixation_array(ddg: np.ndarray) -> np.ndarray:
    """f[..., x, y] for stabilities ddg[..., residue]."""
    shift = np.log(GAMMA / (1 - GAMMA)) / 2
    return 0.5 - 0.5 * np.tanh(BETA * (ddg[..., :, None] - ddg[..., None, :]) - shift)


def rates(ddg: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Generators G[..., x, y] whose columns add up to 0."""
    g = fixation_array(ddg) * c
    i = np.arange(g.shape[-1])
    g[..., i, i] = 0
    g[..., i, i] = -g.sum(-2)
    return g


def equilibrium(g: np.ndarray) -> np.ndarray:
    """Stationary distributions of generators with columns that add up to 0."""
    n = g.shape[-1]
    a = g.copy()
    a[..., -1, :] = 1
    b = np.zeros((*g.shape[:-2], n, 1))
    b[..., -1, 0] = 1
    return np.linalg.solve(a, b)[..., 0]


def group_inverse(a: np.ndarray) -> np.ndarray:
    """Group inverse of I - P or of -G for a chain with one closed class, columns summing to 0."""
    n = a.shape[-1]
    w = equilibrium(-a)
    projector = w[..., :, None] * np.ones(n)
    return np.linalg.inv(a + projector) - projector


def equilibrium_slope(g: np.ndarray, dg: np.ndarray) -> np.ndarray:
    """Change of the stationary distribution with a change of the generator."""
    return np.einsum("...xy,...y->...x", group_inverse(-g), np.einsum("...xy,...y->...x", dg, equilibrium(g)))


def rates_slope(ddg: np.ndarray, c: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The slope in each stability, from the ``slope`` in each entry of the generator.

    An entry off the diagonal also counts, with its sign turned, in the diagonal of its column.
    """
    f = fixation_array(ddg)
    change = 2 * BETA * f * (1 - f) * c * (slope - np.diagonal(slope))
    np.fill_diagonal(change, 0)
    return change.sum(0) - change.sum(1)


def diagonalized(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Eigenvalues and vectors of generators with the inverse, or None if they don't give ``g`` back."""
    w, v = np.linalg.eig(g)
    try:
        inverse = np.linalg.inv(v)
    except np.linalg.LinAlgError:
        return None
    if not np.allclose((v * w[..., None, :]) @ inverse, g, rtol=1e-9, atol=1e-11 * max(1.0, np.abs(g).max())):
        return None
    return w, v, inverse


def each_diagonalized(g: np.ndarray) -> tuple[list[tuple[np.ndarray, list[np.ndarray]]], np.ndarray]:
    """As ``diagonalized`` for each of several generators: [(which, parts)] of those with real eigenvalues and of the
    others, and which have no usable eigenvectors.  No result depends on the other generators."""
    w, v = np.linalg.eig(g)
    real, out, rest = (np.imag(w) == 0).all(-1), [], []
    for rows in (np.flatnonzero(real), np.flatnonzero(~real)):
        a, b = w[rows], v[rows]
        if len(rows) and real[rows[0]]:
            a, b = a.real, b.real
        inverse, good = np.zeros_like(b), np.ones(len(rows), bool)
        try:
            inverse = np.linalg.inv(b)
        except np.linalg.LinAlgError:
            for k in range(len(rows)):
                try:
                    inverse[k] = np.linalg.inv(b[k])
                except np.linalg.LinAlgError:
                    good[k] = False
        size = 1e-11 * np.maximum(1.0, np.abs(g[rows]).max((-1, -2), initial=0.0))
        off = np.abs((b * a[:, None]) @ inverse - g[rows])
        good &= (off <= size[:, None, None] + 1e-9 * np.abs(g[rows])).all((-1, -2))
        if good.any():
            out.append((rows[good], [a[good], b[good], inverse[good]]))
        rest.append(rows[~good])
    return out, np.concatenate(rest)


def exponential(g: np.ndarray, t: np.ndarray) -> np.ndarray:
    """exp(t G) for each t, shape (..., times, n, n): one diagonalization serves all times.

    Where there is none, as with defective matrices, a series takes its place.
    """
    parts = diagonalized(g)
    if parts is None:
        return by_series(g, t)
    return of_diagonalization(parts, t)


def of_diagonalization(parts, t: np.ndarray) -> np.ndarray:
    """exp(t G) for each t from the eigenvectors of G, all times in one product."""
    w, v, inverse = parts
    n = w.shape[-1]
    scaled = v[..., None, :, :] * np.exp(w[..., None, :] * t[:, None])[..., None, :]
    out = scaled.reshape(*w.shape[:-1], len(t) * n, n) @ inverse
    return out.real.reshape(*w.shape[:-1], len(t), n, n)


def by_series(g: np.ndarray, t: np.ndarray) -> np.ndarray:
    """exp(t G) by scaling, a series and squaring."""
    a = g[..., None, :, :] * t[:, None, None]
    size = np.abs(a).sum(-2).max(initial=1e-9)
    k = max(0, int(np.ceil(np.log2(size))) + 4)
    a = a / 2.0**k
    out = np.eye(g.shape[-1]) + a
    term = a
    for i in range(2, 9):
        term = term @ a / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def prior_centers(pairs: DataFrame, scale: float, shift: float, limit: float = 20.0, bound: float = 0.95) -> DataFrame:
    """(wt, mut) rows with the prior's centre from hydropathies, and its Beta parameters.

    The centre is |difference| * scale + shift within ``bound`` of the range; the mode of a Beta
    on the range with a sum of 3 is there.
    """
    from ..functions import statistics as S

    value = F.abs(R.hydropathy(F.col("wt")) - R.hydropathy(F.col("mut"))) * scale + shift
    center = F.greatest(F.lit(-limit * bound), F.least(F.lit(limit * bound), value))
    return pairs.withColumn("center", center).withColumn("beta", S.beta_parameters(F.col("center"), 3, -limit, limit))
