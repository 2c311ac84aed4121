"""Branch lengths of greatest likelihood, and the states of interior nodes, for trees of a given shape.

Sites are independent: a row is a (tree, site) with its tips' letters, Spark deals the rows, and a
task works out all its sites of a tree together.  What concerns a branch is a sum over sites, made by an
aggregation, so a step on all branch lengths is one pass over the rows and a small table of trees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distances import Reversible
from .inference import TOGETHER, dealt, levels
from .tables import dropped, stored

#: Lengths of branches that are tried, in changes a site.
SHORTEST, LONGEST = 1e-6, 20.0
#: Interior nodes of all sites that are held at once.
STATES = 1 << 17


class Passes:
    """Probabilities of what is below each branch, and of what is not, for the sites of one tree."""

    def __init__(self, letters: list[str], left, right, lengths, model: Reversible, shape: float | None):
        k = len(model.letters)
        code = np.full(256, -1)
        code[np.frombuffer(model.letters.encode(), np.uint8)] = np.arange(k)
        self.codes = np.stack([code[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)] for s in letters])
        self.kids = np.stack([left, right], 1).astype(int)
        self.matrices = [m.reshape(len(self.kids), 2, k, k) for m in model.step(np.clip(np.asarray(lengths, float), 0, LONGEST), shape)]
        self.matrices[0] = np.maximum(self.matrices[0], 0)
        sites, nodes = len(letters), len(self.kids)
        self.order = levels(left, right)
        self.pi, self.log = model.pi, np.zeros(sites)
        self.below, self.branch = np.ones((sites, nodes, k)), np.ones((sites, nodes, 2, k))
        for some in self.order:
            for side in (0, 1):
                self.branch[:, some, side] = self.through(0, some, side)
            p = self.branch[:, some].prod(axis=2)
            top = np.maximum(p.max(axis=2), 1e-300)
            self.log += np.log(top).sum(axis=1)
            self.below[:, some] = p / top[..., None]
        total = self.below[:, -1] @ self.pi
        self.log += np.log(np.maximum(total, 1e-300))
        self.above = np.ones((sites, nodes, k))
        self.above[:, -1] = self.pi
        for some in reversed(self.order):
            for side in (0, 1):
                down = self.down(some, side)
                inner = np.flatnonzero(self.kids[some, side] < 0)
                into = np.einsum("snx,nxy->sny", down[:, inner], self.matrices[0][some[inner], side])
                self.above[:, -1 - self.kids[some[inner], side]] = into / np.maximum(into.sum(axis=2, keepdims=True), 1e-300)

    def through(self, derivative: int, some: np.ndarray, side: int) -> np.ndarray:
        """For branches below some nodes and each state at their top: the probability of what is below,
        or a derivative of it in the branch's length; ones, or zeros, for a tip without a letter."""
        kids, m = self.kids[some, side], self.matrices[derivative][some, side]
        out = np.full((len(self.codes), len(some), m.shape[1]), 1.0 if derivative == 0 else 0.0)
        inner, tips = np.flatnonzero(kids < 0), np.flatnonzero(kids >= 0)
        out[:, inner] = np.einsum("nxy,sny->snx", m[inner], self.below[:, -1 - kids[inner]])
        code = self.codes[:, kids[tips]]
        seen = m[tips[None, :], :, np.maximum(code, 0)]
        out[:, tips] = np.where((code >= 0)[..., None], seen, out[:, tips])
        return out

    def down(self, some: np.ndarray, side: int) -> np.ndarray:
        return self.above[:, some] * self.branch[:, some, 1 - side]

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the log likelihood in each branch's length, over all sites."""
        every = np.arange(len(self.kids))
        out = np.zeros((2, len(every), 2))
        for side in (0, 1):
            down = self.down(every, side)
            whole = np.maximum((down * self.branch[:, :, side]).sum(axis=2), 1e-300)
            one, two = ((down * self.through(d, every, side)).sum(axis=2) / whole for d in (1, 2))
            out[0, :, side], out[1, :, side] = one.sum(axis=0), (two - one * one).sum(axis=0)
        return out[0].ravel(), out[1].ravel()

    def states(self) -> np.ndarray:
        """Probabilities of the states of each interior node at each site."""
        p = self.below * self.above
        return p / p.sum(axis=2, keepdims=True)


def dealt_together(rows: DataFrame) -> DataFrame:
    """Rows dealt with some sites of a tree side by side, as a pass over a tree costs little more for several sites than for one."""
    return dealt(rows.withColumn("group", F.floor(F.col("site") / TOGETHER)), "tree_id", "group").drop("group")


def by_tree(df: pd.DataFrame):
    """The rows of each tree in a batch, as many at a time as ``STATES`` allows."""
    for tree, rows in df.groupby("tree_id", sort=False):
        most = max(1, STATES // max(1, len(rows["left"].iloc[0])))
        for k in range(0, len(rows), most):
            yield tree, rows.iloc[k : k + most], rows.iloc[0]


def evaluated(rows: DataFrame, trees: DataFrame, model: Reversible, shape: float | None) -> DataFrame:
    """(tree_id, lengths, log_likelihood, slope, curve) at the lengths of ``trees``, summed over sites."""

    def run(frames):
        for df in frames:
            out = []
            for tree, some, first in by_tree(df):
                p = Passes(some["letters"].tolist(), first["left"], first["right"], first["lengths"], model, shape)
                one, two = p.slopes()
                out.append((tree, float(p.log.sum()), one.tolist(), two.tolist()))
            yield pd.DataFrame(out, columns=["tree_id", "log", "one", "two"])

    parts = rows.join(trees.select("tree_id", "lengths"), "tree_id").mapInPandas(run, "tree_id long, log double, one array<double>, two array<double>")
    logs = parts.groupBy("tree_id").agg(F.sum("log").alias("log_likelihood"))
    each = parts.select("tree_id", F.posexplode(F.arrays_zip("one", "two")).alias("i", "x")).groupBy("tree_id", "i").agg(F.sum("x.one").alias("one"), F.sum("x.two").alias("two"))
    listed = each.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("i", "one", "two"))).alias("x"))
    return logs.join(listed.select("tree_id", F.col("x.one").alias("slope"), F.col("x.two").alias("curve")), "tree_id").join(trees.select("tree_id", "lengths"), "tree_id")


def fitted_lengths(rows: DataFrame, model: Reversible, shape: float | None = None, most: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """(tree_id, lengths, log_likelihood, converged): branch lengths of greatest likelihood.

    ``rows`` as of ``inference.residue_rows``; ``lengths`` in the order of theirs.  Each round takes
    Newton's step on all branches at once, with a factor that is halved where the likelihood would fall
    and doubled, to 1, where it grows.  A tree has converged when a whole step gains next to nothing.
    """
    bare = stored(dealt_together(rows.select("tree_id", "site", "letters", "left", "right")))
    start = rows.groupBy("tree_id").agg(F.first("lengths").alias("lengths"))
    start = start.withColumn("lengths", F.transform("lengths", lambda t: F.greatest(t.cast("double"), F.lit(0.01))))
    now = stored(evaluated(bare, start, model, shape).withColumn("factor", F.lit(1.0)).withColumn("converged", F.lit(False)))
    for _ in range(most):
        todo = now.filter("not converged")
        if todo.isEmpty():
            break
        # where the curve bends the wrong way, a step along the slope of the branch's own length
        step = lambda t, x: F.when(x["curve"] < 0, -x["slope"] / x["curve"]).otherwise(F.signum(x["slope"]) * t)
        held = lambda t: F.least(F.lit(LONGEST), F.greatest(F.lit(SHORTEST), t))
        # no more than threefold at a time
        near = lambda t, to: F.least(t * 3 + 0.01, F.greatest(t / 3, to))
        moved = F.zip_with("lengths", F.arrays_zip("slope", "curve"), lambda t, x: held(near(t, t + F.col("factor") * step(t, x))))
        tried = evaluated(bare, todo.withColumn("lengths", moved), model, shape)
        new = tried.select("tree_id", *(F.col(c).alias(f"new_{c}") for c in ("lengths", "log_likelihood", "slope", "curve")))
        both = now.join(new, "tree_id", "left")
        better = F.coalesce(F.col("new_log_likelihood") > F.col("log_likelihood"), F.lit(False))
        gain = F.col("new_log_likelihood") - F.col("log_likelihood")
        small = F.abs(gain) <= tolerance * (1 + F.abs("log_likelihood"))
        done = F.col("converged") | F.coalesce(small & ((F.col("factor") == 1) | (F.col("factor") < 1e-3)), F.lit(False))
        columns = [F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("lengths", "log_likelihood", "slope", "curve")]
        factor = F.when(better, F.least(F.lit(1.0), F.col("factor") * 2)).otherwise(F.col("factor") / 2)
        before, now = now, stored(both.select("tree_id", *columns, factor.alias("factor"), done.alias("converged")))
        dropped(before)
    return now.select("tree_id", "lengths", "log_likelihood", "converged")


def interior_states(rows: DataFrame, model: Reversible, shape: float | None = None) -> DataFrame:
    """(tree_id, site, internal_no, state, chance): the likeliest state of each interior node by itself,
    given all tips; the first letter of equal ones."""

    def run(frames):
        for df in frames:
            out = []
            for tree, some, first in by_tree(df):
                p = Passes(some["letters"].tolist(), first["left"], first["right"], first["lengths"], model, shape).states()
                best, chance = p.argmax(axis=2), p.max(axis=2)
                sites, nodes = best.shape
                letters = np.array(list(model.letters))[best.ravel()]
                out.append(pd.DataFrame({"tree_id": tree, "site": np.repeat(some["site"].to_numpy(), nodes), "internal_no": np.tile(np.arange(nodes), sites), "state": letters, "chance": chance.ravel()}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["tree_id", "site", "internal_no", "state", "chance"])

    return dealt_together(rows).mapInPandas(run, "tree_id long, site int, internal_no int, state string, chance double")


def interior_sequences(rows: DataFrame, nodes: DataFrame, model: Reversible, shape: float | None = None) -> DataFrame:
    """(tree_id, node_id, seq): the likeliest states put together by site, for all interior nodes."""
    each = interior_states(rows, model, shape)
    put = each.groupBy("tree_id", "internal_no").agg(F.array_sort(F.collect_list(F.struct("site", "state"))).alias("x"))
    inner = nodes.filter("not is_tip").select("tree_id", "node_id", "internal_no")
    return put.join(inner, ["tree_id", "internal_no"]).select("tree_id", "node_id", F.array_join(F.col("x.state"), "").alias("seq"))


def named_interiors(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, place): interior nodes from 1 in preorder, left before right, as programs number
    the rows of their reconstructions: the postorder of their numbers, right before left, seen from its end."""
    inner = nodes.filter("not is_tip")
    return inner.select("tree_id", "node_id", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("internal_no"))).alias("place"))
