"""Hard negatives of anchors by inner product, read from blocks in Hilbert order with zone maps.

Candidates are sorted by label and, in it, by their place on a Hilbert curve through all
dimensions, and written to Parquet in blocks of one label and of bounded size, each with the least
and greatest value of every dimension.  For an anchor the score of any row of a block lies between
two sums, by interval arithmetic on these zone maps.  A window (from a lowest to a highest
score, of the anchor's label or of the others) has to read a block only if the bounds meet it.

Each search reads a few promising blocks first, for a lower bound of every window's k-th best, and
then all blocks that can hold a better one:

1. positives: the rows of an anchor's own label, any score;
2. negatives: the rows of other labels between ``low`` and ``high`` hundredths of a positive's score.

Anchors are packed into groups, and groups and chosen blocks lie on a grid of tasks: a group goes
to the columns that hold its blocks, a block to the rows that hold groups which read it.  Tasks keep
the k best of each window and skip what their bounds rule out meanwhile.

Components are floor(256 x), and scores are exact integers, held at the ends of a long if they
pass them.  Rows with a null id or label, a null or empty vector, or a null or non-finite component
take no part; vectors meet those of their own length; an empty table or one without anchors gives
an empty result; equal scores go by the smaller id; rows of an anchor's id never count for it, and
each anchor row of a repeated id has rows of its own in the result; a negative positive score, or an
anchor without other rows of its label, gives no negatives; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, forget, n_partitions, numbered
from .exact_topk import exact

#: Rows in a block, anchors in a group, zone maps in a sheet, blocks of a sheet that a group reads first.
ROW_BLOCK, GROUP, SHEET, FIRST = 2048, 2048, 256, 2
#: Bits of a dimension on the curve, and the value that lies half way from the middle to the end.
BITS, MIDDLE = 4, 64.0
#: Cells of scores that are tested at a time.
CELLS = 1 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1
ROW = "uid long, id long, label long, anchor boolean, dim int, key binary, vector binary"
BLOCK = "block long, dim int, label long, zone binary, ids binary, vectors binary"
FOUND = "uid long, win long, id long, score long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of rows of cell numbers below 2 ** bits on the Hilbert curve through all columns, as
    bytes that sort as the curve runs (Skilling's transform, on all rows at once)."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for i in range(n):
            up = (x[i] >> np.uint32(b)) & np.uint32(1) == 1
            swap = np.where(up, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(b)) & np.uint32(1) == 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    planes = np.concatenate([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return np.packbits(planes.T, axis=1)


def cells_of(x: np.ndarray) -> np.ndarray:
    """Cell numbers of components: even steps of an angle, so any range fits."""
    part = np.arctan(x / MIDDLE) / math.pi + 0.5
    return np.clip((part * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def rows_of(batches):
    """The rows that take part, with their places on the curve; short integers where they do."""
    for b in batches:
        by_dim: dict[int, list] = {}
        for at, v in enumerate(b.column("vector")):
            if not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(256 * v.values.to_numpy().astype(np.float64))
            if np.isfinite(x).all():
                by_dim.setdefault(len(x), []).append((at, x))
        for dim, got in by_dim.items():
            take = pa.array([at for at, _ in got], pa.int64())
            x = np.stack([v for _, v in got])
            keys = hilbert(cells_of(x), BITS)
            vectors = [packed(v) for v in x]
            columns = [b.column(c).take(take) for c in ("uid", "id", "label", "anchor")]
            columns += [pa.array(np.full(len(got), dim, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ROW.split(", ")])


def packed(x: np.ndarray) -> bytes:
    return x.astype(np.int16).tobytes() if np.abs(x).max() < 1 << 15 else x.tobytes()


def unpacked(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * dim else np.float64).astype(np.float64)


def matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return unpacked(raw, rows * dim).reshape(rows, dim)


def cut(size: int):
    """Blocks of a sorted partition: rows of one length and label, ``size`` of them at most."""

    def made(number, dim, label, rows):
        x = np.stack([v for _, v in rows])
        zone = np.concatenate([x.min(axis=0), x.max(axis=0)])
        ids = np.array([i for i, _ in rows], np.int64)
        columns = [pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([label], pa.int64()), *(pa.array([v], pa.binary()) for v in (zone.tobytes(), ids.tobytes(), packed(x)))]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in BLOCK.split(", ")])

    def run(batches):
        number, kind, rows = TaskContext.get().partitionId() << 32, None, []
        for b in batches:
            for i, label, dim, v in zip(*(b.column(c).to_pylist() for c in ("id", "label", "dim", "vector")), strict=True):
                if rows and (kind != (dim, label) or len(rows) == size):
                    yield made(number, *kind, rows)
                    number, rows = number + 1, []
                kind = (dim, label)
                rows.append((i, unpacked(v, dim)))
        if rows:
            yield made(number, *kind, rows)

    return run


class Group:
    """The anchors and windows of a row of the grid."""

    def __init__(self, b, r: int):
        get = lambda c: b.column(c)[r].values
        anchors, windows = get("anchors"), get("windows")
        self.uids = anchors.field("uid").to_numpy()
        order = np.argsort(self.uids)
        self.uids = self.uids[order]
        self.ids, self.labels = (anchors.field(c).to_numpy()[order] for c in ("id", "label"))
        self.dim = b.column("dim")[r].as_py()
        self.vectors = np.stack([unpacked(anchors.field("vector")[int(i)].as_py(), self.dim) for i in order])
        self.at = np.searchsorted(self.uids, windows.field("uid").to_numpy())
        self.win, self.lo, self.hi = (windows.field(c).to_numpy().copy() for c in ("win", "lo", "hi"))

    def bounds(self, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a row of each zone can have with each anchor."""
        up, down = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)
        least, greatest = zones[:, : self.dim].T, zones[:, self.dim :].T
        slack = 1 + 1e-9 * (np.abs(self.vectors) @ np.maximum(np.abs(least), np.abs(greatest)))
        return up @ least + down @ greatest - slack, up @ greatest + down @ least + slack

    def needs(self, low: np.ndarray, high: np.ndarray, labels: np.ndarray, same: bool) -> np.ndarray:
        """Whether each window has to read each zone."""
        kind = (self.labels[:, None] == labels[None, :]) == same
        return kind[self.at] & (high[self.at] >= self.lo[:, None]) & (low[self.at] <= self.hi[:, None])


def choose(same: bool, first: int | None):
    """(grp, block) for the blocks that a group has to read; with ``first``, for that many of each
    sheet that are the most promising for most windows."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                g, sheet = Group(b, r), b.column("sheet")[r].values
                blocks, labels = sheet.field("block").to_numpy(), sheet.field("label").to_numpy()
                zones = np.stack([np.frombuffer(z.as_py(), np.float64) for z in sheet.field("zone")])
                low, high = g.bounds(zones)
                step = max(1, CELLS // len(blocks))
                tally = np.zeros(len(blocks), np.int64)
                every = (g.at, g.lo, g.hi)
                for x in range(0, len(every[0]), step):
                    g.at, g.lo, g.hi = (v[x : x + step] for v in every)
                    need = g.needs(low, high, labels, same)
                    if first is None:
                        tally += need.sum(axis=0)
                    else:
                        top = np.where(need, high[g.at], -np.inf)
                        some = need.any(axis=1)
                        tally += np.bincount(top[some].argmax(axis=1), minlength=len(blocks))
                order = np.argsort(-tally, kind="stable")[:first]
                take = blocks[order[tally[order] > 0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), b.column("grp")[r].as_py(), np.int64)), pa.array(take)], names=["grp", "block"])

    return run


class Best:
    """The k best entries of each window of a group so far."""

    def __init__(self, g: Group, k: int):
        self.g, self.k = g, k
        self.w = self.id = self.score = np.zeros(0, np.int64)

    def add(self, w, ids, score):
        w, ids, score = (np.concatenate(x) for x in ((self.w, w), (self.id, ids), (self.score, score)))
        # descending scores by their complement, which no long overflows
        order = np.lexsort((ids, ~score, w))
        w, ids, score = w[order], ids[order], score[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        last = rank == self.k - 1
        self.g.lo[w[last]] = score[last]
        self.w, self.id, self.score = (x[rank < self.k] for x in (w, ids, score))

    def rows(self):
        g = self.g
        return pa.RecordBatch.from_arrays([pa.array(g.uids[g.at[self.w]]), pa.array(g.win[self.w]), pa.array(self.id), pa.array(self.score)], names=["uid", "win", "id", "score"])


def whole_longs(score: np.ndarray) -> np.ndarray:
    if score.dtype == object:
        score = np.vectorize(lambda s: max(LEAST, min(MOST, s)), otypes=[np.int64])(score) if score.size else np.zeros(score.shape, np.int64)
    return score.astype(np.int64)


#: Groups whose best entries a task holds at a time; a few megabytes each.
HELD = 32


def read(same: bool, k: int):
    """The k best rows of each window in the blocks that a task is handed."""

    def run(batches):
        held: dict[int, Best] = {}
        for b in batches:
            for r in range(b.num_rows):
                grp = b.column("grp")[r].as_py()
                if grp not in held:
                    while len(held) >= HELD:
                        yield held.pop(next(iter(held))).rows()
                    held[grp] = Best(Group(b, r), k)
                scan(held[grp], b, r, same)
        for best in held.values():
            yield best.rows()

    return run


def scan(best: Best, b, r: int, same: bool) -> None:
    g = best.g
    zone = np.frombuffer(b.column("zone")[r].as_py(), np.float64)[None, :]
    need = g.needs(*g.bounds(zone), np.array([b.column("label")[r].as_py()]), same)[:, 0]
    windows = np.flatnonzero(need)
    if not len(windows):
        return
    ids = np.frombuffer(b.column("ids")[r].as_py(), np.int64)
    rows = matrix(b.column("vectors")[r].as_py(), len(ids), g.dim)
    which, of = np.unique(g.at[windows], return_inverse=True)
    qs, rows = exact(g.vectors[which], rows)
    step = max(1, CELLS // len(ids))
    for x in range(0, len(windows), step):
        w = windows[x : x + step]
        some, place = np.unique(of[x : x + step], return_inverse=True)
        score = whole_longs(qs[some] @ rows.T)[place]
        ok = (score >= g.lo[w][:, None]) & (score <= g.hi[w][:, None]) & (ids[None, :] != g.ids[g.at[w]][:, None])
        if best.k < len(ids) and ok.sum() > 4 * best.k * len(w):
            # the k-th best here is a bound too
            kth = ~np.partition(np.where(ok, ~score, MOST), best.k - 1, axis=1)[:, best.k - 1]
            ok &= score >= kth[:, None]
        i, j = np.nonzero(ok)
        best.add(w[i], ids[j], score[i, j])


def best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "win").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Library:
    """Blocks, their zone maps in sheets, and the groups of anchors."""

    def __init__(self, rows: DataFrame, is_anchor: Column, row_block: int = ROW_BLOCK, group: int = GROUP):
        self.n = n_partitions(rows.sparkSession)
        wanted = rows.select("id", F.col("label").cast("long").alias("label"), "vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor")).filter("id is not null and label is not null")
        self.rows = checkpoint(numbered(wanted).mapInArrow(rows_of, ROW))
        order = ["dim", "label", "key", "id", "uid"]
        cut_up = self.rows.repartitionByRange(self.n, *order).sortWithinPartitions(*order).select("id", "label", "dim", "vector")
        self.blocks = checkpoint(cut_up.mapInArrow(cut(row_block), BLOCK))
        count = self.blocks.count()
        sheet = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-count // SHEET))))
        self.sheets = checkpoint(self.blocks.groupBy("dim", sheet.alias("number")).agg(F.collect_list(F.struct("block", "label", "zone")).alias("sheet")))
        anchors = self.rows.filter("anchor")
        groups = max(1, -(-anchors.count() // group))
        self.across = max(1, min(self.n, round(math.sqrt(self.n * max(1, count) / groups))))
        self.down = max(1, self.n // self.across)
        # neighbours on the curve share a group, as they read the same blocks
        near = anchors.repartitionByRange(groups, *order).sortWithinPartitions(*order)
        near = near.withColumn("grp", F.spark_partition_id().cast("long") * (1 << 32) + F.floor((F.monotonically_increasing_id() % (1 << 33)) / group))
        self.groups = checkpoint(near.groupBy("dim", "grp").agg(F.collect_list(F.struct("uid", "id", "label", "vector")).alias("anchors")).withColumn("grp", F.xxhash64("dim", "grp")))
        self.members = self.groups.select("grp", F.explode("anchors.uid").alias("uid"))

    def cell(self, key: str, m: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(m)).cast("int")

    def ready(self, windows: DataFrame) -> DataFrame:
        """Groups with their windows (uid, win, lo, hi)."""
        per = windows.join(self.members, "uid").groupBy("grp").agg(F.collect_list(F.struct("uid", "win", "lo", "hi")).alias("windows"))
        return checkpoint(self.groups.join(per, "grp").withColumn("i", self.cell("grp", self.down)))

    def chosen(self, ready: DataFrame, same: bool, first: int | None) -> DataFrame:
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        sent = ready.select("*", every(self.across).alias("j"))
        sheets = self.sheets.select("dim", "sheet", self.cell("number", self.across).alias("j"), every(self.down).alias("i"))
        return checkpoint(sent.join(sheets, ["dim", "i", "j"]).mapInArrow(choose(same, first), "grp long, block long"))

    def scanned(self, ready: DataFrame, chosen: DataFrame, same: bool, k: int) -> DataFrame:
        placed = chosen.select("grp", "block", self.cell("grp", self.down).alias("i"), self.cell("block", self.across).alias("j"))
        todo = placed.groupBy("grp", "j").agg(F.collect_list("block").alias("todo"))
        sent = ready.join(todo, "grp").select("grp", "dim", "anchors", "windows", "i", "j", "todo")
        blocks = self.blocks.drop("dim").join(placed.select("block", "i", "j").distinct(), "block")
        pairs = sent.join(blocks, ["i", "j"]).filter(F.array_contains("todo", F.col("block"))).drop("todo", "block", "i", "j")
        return best_rows(pairs.mapInArrow(read(same, k), FOUND), k)

    def search(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """(uid, win, id, score, rank): the k best rows of each window."""
        ready = self.ready(windows)
        early = self.chosen(ready, same, FIRST)
        kth = self.scanned(ready, early, same, k).filter(F.col("rank") == k).select("uid", "win", F.col("score").alias("kth"))
        told = self.ready(windows.join(kth, ["uid", "win"], "left").withColumn("lo", F.greatest("lo", "kth")).drop("kth"))
        late = self.chosen(told, same, None)
        out = checkpoint(self.scanned(told, late, same, k))
        for table in (ready, early, told, late):
            forget(table)
        return out


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, row_block: int = ROW_BLOCK, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    ``rows``: (id, label, vector); labels are integers.  An anchor's positives are its ``positives``
    best rows of its label; for each, the ``negatives`` best rows of other labels whose score is
    within ``low`` and ``high`` hundredths of the positive's.
    """
    library = Library(rows, is_anchor, row_block, group)
    anyone = library.members.select("uid", F.lit(0).cast("long").alias("win"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    near = library.search(anyone, True, positives).select("uid", F.col("rank").cast("long").alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    part = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent / 100
    windows = near.filter("positive_score >= 0").select("uid", "win", F.ceil(part(low)).cast("long").alias("lo"), F.floor(part(high)).cast("long").alias("hi"))
    far = library.search(windows, False, negatives)
    ids = library.rows.filter("anchor").select("uid", F.col("id").alias("anchor_id"))
    out = far.select("uid", "win", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["uid", "win"]).join(ids, "uid")
    return out.select("anchor_id", "positive_id", F.col("win").cast("int").alias("positive_rank"), "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM t a JOIN t r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, k ORDER BY score DESC, id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE k <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
