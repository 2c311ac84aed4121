"""Exact inner-product top-k by the three phases of a uniform threshold.

A vector is cut into slices, and each slice of it has a list of partial scores for a query.

1. Each block of rows gathers, for every query and slice, the rows with the ``k`` highest
   partial scores; the whole scores of these rows only are worked out.  The k-th best of them,
   over all blocks, is a safe cutoff: at least ``k`` rows reach it.
2. The cutoffs go back to all blocks.  A row whose score reaches the cutoff must reach ``cutoff /
   slices`` in one slice at least, so each block collects the entries of its lists from there
   on.  By the lengths of the slices it knows which rows can't (Cauchy-Schwarz), so only rows
   that are long enough in a slice for some query are multiplied there.
3. The scores of the collected rows are resolved exactly; each block hands on its own ``k``
   best (ties to the smaller id, so nothing of the answer is lost) and these are merged.

Queries and rows are packed into blocks of bounded size.  Blocks lie on a grid of tasks, query
blocks dealt over its rows and row blocks over its columns, with sides that move the fewest
vectors, and each block of queries meets each block of rows once.

Components are floor(256 x), and scores are exact integers: in doubles where no sum can pass
2 ** 53, in longs where none can pass 2 ** 62, and else in integers of any length, whose scores
are held at the ends of a long.  Vectors that are null or empty, or hold null or non-finite
components, take no part, nor do rows without an id; vectors meet those of their own length; an
empty table gives an empty result; equal vectors tie and the smaller id wins; rows with a
repeated id count as candidates each, but never for a query of that id, and each query row of a
repeated id has its own ``k`` rows in the result; columns besides id and vector are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, numbered

#: Rows in a block of queries and in a block of candidates.
QUERY_BLOCK, ROW_BLOCK = 512, 4096
SLICES = 4
BLOCK = "block long, part long, uids binary, ids binary, vectors binary"
#: Sums below which doubles and longs are exact.
DOUBLE, LONG = 2.0**53, 2.0**62
#: Entries whose scores are worked out at a time.
AT_ONCE = 200_000
FOUND = "uid long, query_id long, vec_id long, score long"


def whole(batch):
    """Numbers, ids and vectors of the rows that take part, by length of vector."""
    by_dim: dict[int, tuple[list, list, list]] = {}
    for u, i, v in zip(batch.column("uid").to_pylist(), batch.column("id").to_pylist(), batch.column("vector"), strict=True):
        if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(256 * v.values.to_numpy().astype(np.float64))
        if np.isfinite(x).all():
            got = by_dim.setdefault(len(x), ([], [], []))
            for have, new in zip(got, (u, i, x), strict=True):
                have.append(new)
    return by_dim


def blocks(size: int):
    """At most ``size`` vectors of one length in each row."""

    def run(batches):
        kept: dict[int, tuple[list, list, list]] = {}
        for b in batches:
            for dim, new in whole(b).items():
                have = kept.setdefault(dim, ([], [], []))
                for x, y in zip(have, new, strict=True):
                    x.extend(y)
                while len(have[0]) >= size:
                    yield packed(dim, *(x[:size] for x in have))
                    for x in have:
                        del x[:size]
        for dim, have in kept.items():
            if have[0]:
                yield packed(dim, *have)

    return run


def packed(dim, uids, ids, vectors):
    held = (np.array(x, t).tobytes() for x, t in ((uids, np.int64), (ids, np.int64), (vectors, np.float64)))
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([uids[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in held)], names=["block", "part", "uids", "ids", "vectors"])


def exact(qs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays in a type in which the inner products, whole and of slices, are exact."""
    most = float(np.abs(qs).max(initial=0)) * float(np.abs(rows).max(initial=0)) * qs.shape[1]
    if most < DOUBLE:
        return qs, rows
    if most < LONG and max(np.abs(qs).max(), np.abs(rows).max()) < LONG:
        return qs.astype(np.int64), rows.astype(np.int64)
    return tuple(np.array([[int(c) for c in v] for v in x], object).reshape(x.shape) for x in (qs, rows))


def pairs(batches):
    """The arrays of each block of queries with each block of rows."""
    for b in batches:
        for i in range(b.num_rows):
            dim = b.column("block")[i].as_py()
            get = lambda c, t=np.int64: np.frombuffer(b.column(c)[i].as_py(), t)  # noqa: B023, E731
            qs, rows = exact(get("q_vectors", np.float64).reshape(-1, dim), get("vectors", np.float64).reshape(-1, dim))
            yield get("q_uids"), get("q_ids"), qs, get("ids"), rows, (b.column("cutoff")[i].as_py() if "cutoff" in b.schema.names else None)


def best(scores: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray):
    """Row and column of the k best allowed scores of each row, ties to the smaller id."""
    out = []
    for r in range(len(scores)):
        at = np.flatnonzero(allowed[r])
        s = scores[r][at]
        if len(s) > k and s.dtype != object:
            enough = s >= np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[enough], s[enough]
        order = sorted(range(len(at)), key=lambda i: (-s[i], ids[at[i]])) if s.dtype == object else np.lexsort((ids[at], np.negative(s)))
        at = at[np.array(order[:k], np.int64)]
        out.append(np.stack([np.full(len(at), r), at]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def cuts(dim: int, slices: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(slices, dim) + 1).astype(int)
    return list(zip(edges[:-1], edges[1:], strict=True))


def whole_scores(qs, rows, r, at) -> np.ndarray:
    """Scores of query ``r[i]`` with row ``at[i]``."""
    out = [(qs[r[x : x + AT_ONCE]] * rows[at[x : x + AT_ONCE]]).sum(axis=1) for x in range(0, len(r), AT_ONCE)]
    return np.concatenate(out) if out else np.zeros(0, qs.dtype)


def answer(uids, q_ids, ids, r, at, score):
    if score.dtype == object:
        score = np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in score], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(uids[r]), pa.array(q_ids[r]), pa.array(ids[at]), pa.array(score.astype(np.int64))], names=["uid", "query_id", "vec_id", "score"])


def local_lists(k: int, slices: int):
    """Phase 1: the heads of the lists of partial scores; their rows with whole scores."""

    def run(batches):
        for uids, q_ids, qs, ids, rows, _ in pairs(batches):
            other = q_ids[:, None] != ids[None, :]
            heads = [best(qs[:, a:e] @ rows[:, a:e].T, ids, k, other) for a, e in cuts(qs.shape[1], slices)]
            r, at = np.concatenate(heads, axis=1)
            new = np.unique(r * len(ids) + at)  # a row that heads several lists counts once
            r, at = new // max(1, len(ids)), new % max(1, len(ids))
            yield answer(uids, q_ids, ids, r, at, whole_scores(qs, rows, r, at))

    return run


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors, a little more than they are."""
    return np.sqrt(np.square(x.astype(np.float64)).sum(axis=1)) * (1 + 1e-9)


def resolve(k: int, slices: int):
    """Phases 2 and 3 in a block: entries from the cutoff on, and their exact scores."""

    def run(batches):
        for uids, q_ids, qs, ids, rows, told in pairs(batches):
            known = {x["uid"]: x["cutoff"] for x in told or []}
            have = np.array([int(u) in known for u in uids], bool)
            cutoff = np.array([known.get(int(u), 0) for u in uids], np.int64)
            parts = cuts(qs.shape[1], slices)
            enough = np.zeros((len(uids), len(ids)), bool)
            enough[~have] = True
            need = cutoff / len(parts) - 1e-9 * np.abs(cutoff) - 1
            for a, e in parts:
                one, two = lengths(qs[:, a:e]), lengths(rows[:, a:e])
                order = np.argsort(-two, kind="stable")
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(need <= 0, -np.inf, need / one)
                open_ = np.flatnonzero(have & (least <= two.max(initial=-1)))
                if not len(open_):
                    continue
                long = order[: np.searchsorted(-two[order], -least[open_].min(), "right")]
                partial = qs[open_, a:e] @ rows[long, a:e].T
                enough[np.ix_(open_, long)] |= (partial >= need[open_][:, None]).astype(bool)
            enough &= q_ids[:, None] != ids[None, :]
            r, at = np.nonzero(enough)
            score = whole_scores(qs, rows, r, at)
            keep = (~have[r] | (score >= cutoff[r])).astype(bool)
            r, at, score = r[keep], at[keep], score[keep]
            order = np.array(sorted(range(len(r)), key=lambda i: (r[i], -score[i], ids[at[i]])), np.int64) if score.dtype == object else np.lexsort((ids[at], np.negative(score), r))
            r, at, score = r[order], at[order], score[order]
            top = np.arange(len(r)) - np.searchsorted(r, r) < k
            yield answer(uids, q_ids, ids, r[top], at[top], score[top])

    return run


def members(batches):
    for b in batches:
        for part, uids in zip(b.column("part").to_pylist(), b.column("q_uids").to_pylist(), strict=True):
            uids = np.frombuffer(uids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uids), part, np.int64)), pa.array(uids)], names=["part", "uid"])


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the (id, vector) rows of ``queries`` among ``rows``."""
    n = n_partitions(rows.sparkSession)
    many = rows.count() / max(1, queries.count())
    across = max(1, min(n, round(math.sqrt(n * many))))  # columns of the grid
    down = max(1, n // across)
    q = numbered(queries.select("id", "vector")).mapInArrow(blocks(QUERY_BLOCK), BLOCK)
    q = q.select("block", "part", *(F.col(c).alias("q_" + c) for c in ("uids", "ids", "vectors")), F.pmod(F.xxhash64("part"), F.lit(down)).alias("i"))
    data = numbered(rows.select("id", "vector")).mapInArrow(blocks(ROW_BLOCK), BLOCK)
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    data = data.select("block", "ids", "vectors", F.pmod(F.xxhash64("part"), F.lit(across)).alias("j"), every(down).alias("i"))
    heads = q.select("*", every(across).alias("j")).join(data, ["block", "i", "j"]).mapInArrow(local_lists(k, slices), FOUND)
    by_score = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc("vec_id"))
    cutoff = heads.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select("uid", F.col("score").alias("cutoff"))
    owner = q.mapInArrow(members, "part long, uid long")
    have = owner.join(cutoff, "uid").groupBy("part").agg(F.collect_list(F.struct("uid", "cutoff")).alias("cutoff"))
    ready = q.join(have, "part", "left")
    found = ready.select("*", every(across).alias("j")).join(data, ["block", "i", "j"]).mapInArrow(resolve(k, slices), FOUND)
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_dot_product(q.v, r.v)::BIGINT AS score
  FROM t q JOIN t r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
