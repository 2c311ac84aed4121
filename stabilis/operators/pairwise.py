"""Global alignment of pairs of sequences with affine gap costs, in batches.

A gap of ``k`` letters costs ``gap_open + (k - 1) * gap_extend``.  The recursion runs over the rows of
all pairs of a batch at once; gaps along a row are a running maximum.  Long pairs are aligned
in a band of diagonals first.  A path that leaves the band has so many gaps that its score is
bounded; if the best one inside is no worse, it is the best of all, and else the band is doubled.

Of equal scores, a pair of letters goes before a gap in the second sequence, and that before one in
the first, seen from the end.  Sequences are ASCII; null ones have null results, empty ones align with
gaps only.  A byte for each cell of a band has to fit in a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import reference, site_counts

#: Cells of a batch, letters up to which a band is no use, half the first band.
CELLS, SHORT, BAND = 1 << 23, 128, 32
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
#: Columns that are added to the pairs.
MADE = {"score": "int", "columns": "int", "identical": "int", "gaps": "int", "aligned_a": "string", "aligned_b": "string", "placed": "string"}
GAP = ord("-")


@dataclass(frozen=True)
class Scoring:
    """Scores of pairs of bytes, and what gaps cost."""

    scores: np.ndarray
    gap_open: int = 10
    gap_extend: int = 1

    @staticmethod
    def plain(match: int = 5, mismatch: int = -4, gap_open: int = 10, gap_extend: int = 1) -> Scoring:
        scores = np.full((128, 128), mismatch, np.int32)
        np.fill_diagonal(scores, match)
        return Scoring(scores, gap_open, gap_extend)

    @staticmethod
    def of_table(table: DataFrame, other: int = -4, gap_open: int = 10, gap_extend: int = 1) -> Scoring:
        """From (x, y, score) rows, one or two for each pair of residues: 400 at most."""
        scores = np.full((128, 128), other, np.int32)
        for r in table.filter(F.col("x").isin(*LETTERS) & F.col("y").isin(*LETTERS)).select("x", "y", "score").distinct().collect():
            scores[ord(r["x"]), ord(r["y"])] = scores[ord(r["y"]), ord(r["x"])] = r["score"]
        return Scoring(scores, gap_open, gap_extend)

    def rows(self, a: np.ndarray, b: np.ndarray, kind: type):
        """A function that gives the scores of the letters at place ``i`` of all first sequences with
        those at places ``x`` to ``y`` of the second ones."""
        match, other = kind(self.scores[0, 0]), kind(self.scores[0, 1])
        even = np.full_like(self.scores, other)
        np.fill_diagonal(even, match)
        if np.array_equal(even, self.scores):
            gain = match - other
            return lambda i, x, y: (b[x:y] == a[i]) * gain + other
        table, place = self.scores.astype(kind).ravel(), b.astype(np.intp)
        return lambda i, x, y: table.take(place[x:y] + a[i].astype(np.intp) * 128)

    def __post_init__(self):
        if not 0 <= self.gap_extend <= self.gap_open:
            raise ValueError("a gap costs no more to extend than to open")


def padded(off: np.ndarray, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Letters of some rows as columns, zeros below."""
    size = off[rows + 1] - off[rows]
    at = np.arange(int(size.max(initial=0)))[:, None]
    inside = at < size
    return np.where(inside, data[np.where(inside, off[rows] + at, 0)] if len(data) else 0, 0).astype(np.uint8)


def fill(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, low: int, high: int, how: Scoring):
    """Scores of all pairs in a band of diagonals (place in b less place in a) and the steps back."""
    n, m, pairs, width = len(a), len(b), a.shape[1], high - low + 1
    largest = int(np.abs(how.scores).max()) * (min(n, m) + 1) + how.gap_open + how.gap_extend * (n + m + width)
    kind = np.int16 if 2 * largest < 1 << 14 else np.int32
    never = kind(-(1 << 14) if kind is np.int16 else -(1 << 29))
    opened, extended = kind(how.gap_open), kind(how.gap_extend)
    slope = (np.arange(width) * how.gap_extend).astype(kind)[:, None]
    best, up = np.full((width + 1, pairs), never, kind), np.full((width + 1, pairs), never, kind)
    steps = np.zeros((n + 1, width, pairs), np.uint8)
    result = np.zeros(pairs, np.int32)
    pair_scores = how.rows(a, b, kind)
    for i in range(n + 1):
        x, y = max(low, -i) - low, min(high, m - i) - low + 1
        if x >= y:
            continue
        fresh, vertical = best[x + 1 : y + 1] - opened, up[x + 1 : y + 1] - extended
        longer = vertical > fresh
        np.maximum(vertical, fresh, out=vertical)
        np.maximum(vertical, never, out=vertical)
        pair = np.empty((y - x, pairs), kind)
        first = int(i + low + x == 0)
        if i:
            pair[:first] = never
            j = i + low + x + first - 1
            np.add(best[x + first : y], pair_scores(i - 1, j, j + y - x - first), out=pair[first:])
        else:
            pair[:] = never
            pair[-low - x] = 0
        now = np.maximum(pair, vertical)
        # the level that a gap along the row leaves from, and the best of those before
        leave = now - opened
        run = now + slope[x:y]
        np.maximum.accumulate(run, axis=0, out=run)
        across = np.empty((y - x, pairs), kind)
        across[0] = never
        np.subtract(run[:-1], slope[x : y - 1] + opened, out=across[1:])
        np.maximum(now, across, out=now)
        np.maximum(now, never, out=now)
        here = (vertical != now).view(np.uint8) + np.uint8(1)
        here *= (pair != now).view(np.uint8)
        here |= longer.view(np.uint8) << 2
        here[2:] |= (across[1:-1] - extended > leave[1:-1]).view(np.uint8) << 3
        steps[i, x:y] = here
        best[x:y], up[x:y] = now, vertical
        best[y], up[y] = never, never
        if x:
            best[x - 1] = never
        ends = np.flatnonzero(la == i)
        result[ends] = best[lb[ends] - i - low, ends]
    return result, steps


def walked(a, b, la, lb, low: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both aligned sequences of each pair from their ends, and how many columns they have."""
    pairs = len(la)
    i, j, state = la.copy(), lb.copy(), np.zeros(pairs, np.int8)
    every = np.arange(pairs)
    one, two = [], []
    size = np.zeros(pairs, np.int64)
    while True:
        go = np.flatnonzero((i > 0) | (j > 0))
        if not len(go):
            break
        p, x, y = every[go], i[go], j[go]
        told = steps[x, y - x - low, p]
        s = np.where(state[go] == 0, told & 3, state[go])
        from_a, from_b = s != 2, s != 1
        letter = np.full((2, pairs), GAP, np.uint8)
        letter[0, p[from_a]] = a[x[from_a] - 1, p[from_a]]
        letter[1, p[from_b]] = b[y[from_b] - 1, p[from_b]]
        one.append(letter[0])
        two.append(letter[1])
        stay = np.where(s == 1, (told >> 2) & 1, (told >> 3) & 1)
        state[go] = np.where((s > 0) & (stay == 1), s, 0)
        i[go] -= from_a
        j[go] -= from_b
        size[go] += 1
    shape = (0, pairs)
    return np.array(one, np.uint8).reshape(-1, pairs) if one else np.zeros(shape, np.uint8), np.array(two, np.uint8).reshape(-1, pairs) if two else np.zeros(shape, np.uint8), size


def outside(la, lb, low: int, high: int, how: Scoring) -> np.ndarray:
    """The most that a path through a diagonal beyond the band can score."""
    k = lb - la
    beyond = np.minimum(np.minimum(0, k) - low, high - np.maximum(0, k)) + 1
    letters = np.maximum(np.minimum(la, lb) - beyond, 0)
    best = max(0, int(how.scores.max()))
    return letters * best - 2 * how.gap_open - (np.abs(k) + 2 * beyond - 2) * how.gap_extend


class Batch:
    """Results of the pairs of an Arrow batch, in place."""

    def __init__(self, rows: int):
        self.score, self.texts = np.zeros(rows, np.int32), [[None] * rows for _ in range(3)]
        self.counts = np.zeros((3, rows), np.int32)

    def put(self, rows, score, one, two, size) -> None:
        self.score[rows] = score
        valid = np.arange(len(one))[:, None] < size
        self.counts[0, rows] = size
        self.counts[1, rows] = ((one == two) & valid & (one != GAP)).sum(axis=0)
        self.counts[2, rows] = (((one == GAP) | (two == GAP)) & valid).sum(axis=0)
        one, two, valid = one[::-1].T, two[::-1].T, valid[::-1].T
        for texts, letters, mask in zip(self.texts, (one, two, one), (valid, valid, valid & (two != GAP)), strict=True):
            flat, end = letters[mask].tobytes(), np.cumsum(mask.sum(axis=1)).tolist()
            for r, x, y in zip(rows.tolist(), [0, *end[:-1]], end, strict=True):
                texts[r] = flat[x:y]


def solve(off_a, data_a, off_b, data_b, rows: np.ndarray, how: Scoring, out: Batch) -> None:
    la, lb = np.diff(off_a), np.diff(off_b)
    todo = rows[np.lexsort((lb[rows], la[rows]))]
    half = BAND
    while len(todo):
        again, at = [], 0
        while at < len(todo):
            # as many pairs as fit, of lengths alike
            take, size = 1, len(todo) - at
            small = np.minimum(la[todo[at:]], lb[todo[at:]]) <= SHORT
            k = lb[todo[at:]] - la[todo[at:]]
            low = np.where(small, -la[todo[at:]], np.maximum(np.minimum(0, k) - half, -la[todo[at:]]))
            high = np.where(small, lb[todo[at:]], np.minimum(np.maximum(0, k) + half, lb[todo[at:]]))
            lows, highs = np.minimum.accumulate(low), np.maximum.accumulate(high)
            cells = np.arange(1, size + 1) * (highs - lows + 1) * (np.maximum.accumulate(la[todo[at:]]) + 1)
            take = max(1, int(np.searchsorted(cells, CELLS, "right")))
            here = todo[at : at + take]
            x, y = int(lows[take - 1]), int(highs[take - 1])
            a, b = padded(off_a, data_a, here), padded(off_b, data_b, here)
            score, steps = fill(a, b, la[here], lb[here], x, y, how)
            whole = (x <= -la[here]) & (y >= lb[here])
            proven = whole | (score >= outside(la[here], lb[here], x, y, how))
            again.append(here[~proven])
            if proven.any():
                keep = np.flatnonzero(proven)
                some = steps if len(keep) == len(here) else steps[:, :, keep]
                out.put(here[keep], score[keep], *walked(a[:, keep], b[:, keep], la[here][keep], lb[here][keep], x, some))
            at += take
        todo, half = np.concatenate(again), 2 * half


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)[off[0] : off[-1]] if len(values) and values.buffers()[2] is not None else np.zeros(0, np.uint8)
    if (data >= 128).any():
        raise ValueError("sequences are ASCII")
    return off - off[0], data


def aligner(a: str, b: str, how: Scoring):
    def run(batches):
        for batch in batches:
            one, two = batch.column(a), batch.column(b)
            known = np.array(pc.and_(one.is_valid(), two.is_valid()).to_pylist(), bool)
            out = Batch(batch.num_rows)
            solve(*sequences(one), *sequences(two), np.flatnonzero(known), how, out)
            none = pa.array(~known)
            numbers = [pc.if_else(none, None, pa.array(x)) for x in (out.score, *out.counts)]
            texts = [pa.array(x, pa.binary()).cast(pa.string()) for x in out.texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers, *texts], names=[*batch.schema.names, *MADE])

    return run


def aligned(pairs: DataFrame, a: str = "a", b: str = "b", how: Scoring | None = None) -> DataFrame:
    """``pairs`` with the alignment of the sequences in columns ``a`` and ``b``.

    Adds score, columns, identical (letters), gaps (columns with one), aligned_a, aligned_b and
    ``placed``: the first sequence in the columns of the second one's letters.
    """
    kept = pairs.drop(*(c for c in MADE if c not in (a, b)))
    types = {"int": T.IntegerType(), "string": T.StringType()}
    schema = T.StructType([*kept.schema, *(T.StructField(c, types[t]) for c, t in MADE.items())])
    return kept.mapInArrow(aligner(a, b, how or Scoring.plain()), schema)


def to_reference(seqs: DataFrame, how: Scoring | None = None) -> DataFrame:
    """(family, pos, header, seq, score, identity, gaps): each row aligned to its family's reference.

    ``seqs``: (family, pos, header, seq), gaps in them left out; ``seq`` of the result is of the
    reference's length, what was inserted is dropped.  ``identity`` is the share of the columns
    without a gap that are identical, null if there is none, ``gaps`` the share of columns with one.
    """
    bare = seqs.select("family", "pos", "header", F.upper(F.regexp_replace("seq", "-", "")).alias("a"))
    ref = reference(bare.withColumnRenamed("a", "seq")).select("family", F.col("ref").alias("b"))
    done = aligned(bare.join(F.broadcast(ref), "family"), how=how)  # a row for each family; rows dealt by family would be few large groups
    paired = F.nullif(F.col("columns") - F.col("gaps"), F.lit(0))
    share = F.col("gaps") / F.nullif(F.col("columns"), F.lit(0))
    return done.select("family", "pos", "header", F.col("placed").alias("seq"), "score", (F.col("identical") / paired).alias("identity"), share.alias("gaps"))


def screened(seqs: DataFrame, least_identity: float, most_gaps: float, how: Scoring | None = None) -> DataFrame:
    """Rows that are like enough to the reference of their family, aligned to it."""
    return to_reference(seqs, how).filter((F.col("identity") >= least_identity) & (F.col("gaps") <= most_gaps)).select("family", "pos", "header", "seq")


def substitution_scores(aln: DataFrame) -> DataFrame:
    """(x, y, score), x before or equal to y: log odds of pairs in the columns of all families.

    Twice the binary logarithm of how often two residues share a column, by how often they would
    by chance, to whole numbers.  Pairs are counted from the residues of a column and not made.
    """
    n = site_counts(aln).filter("n > 0")
    other = n.select("family", "site", F.col("aa").alias("y"), F.col("n").alias("k"))
    both = n.withColumnRenamed("aa", "x").join(other, ["family", "site"]).filter("x <= y")
    count = F.when(F.col("x") == F.col("y"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("k"))
    pairs = both.groupBy("x", "y").agg(F.sum(count).alias("q")).filter("q > 0")
    total = pairs.agg(F.sum("q").alias("total"))
    half = pairs.select(F.explode(F.array("x", "y")).alias("aa"), "q").groupBy("aa").agg((F.sum("q") / 2).alias("p"))
    # at most 210 pairs and 20 residues
    told = pairs.crossJoin(total).join(half.select(F.col("aa").alias("x"), F.col("p").alias("px")), "x").join(half.select(F.col("aa").alias("y"), F.col("p").alias("py")), "y")
    chance = F.col("px") * F.col("py") * F.when(F.col("x") == F.col("y"), 1).otherwise(2) / F.col("total")
    return told.select("x", "y", F.round(2 * F.log2(F.col("q") / chance)).cast("int").alias("score"))
