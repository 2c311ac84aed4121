"""Near duplicates by SimHash: fingerprints compared exactly, tile by tile.

A text's fingerprint has 64 bits; a bit is set if it is set in over half the XXH64 values of its
shingles of three words, repeats counted.  Fingerprints that differ in ``radius`` bits at most
are linked.

Equal fingerprints are one row from the start, with a count.  The others are dealt to tiles by
the population counts of their two halves, and a tile into blocks of bounded size, so no task
holds a tile.  Counts of fingerprints within the radius differ by the radius at most, so a block
meets only the blocks of its own and of near tiles, and there a subtile (counts of quarters)
skips all rows of the other block whose counts are too far off.  What is left is compared in
full: exclusive-or and bit counts of whole matrices.  No link is missed; a comparison hands on
how many rows each fingerprint is linked with, and a forest in place of all links, so a cloud of
near copies gives as many rows as it has members and not their square.

Null, empty and blank texts have no shingle: fingerprint 0, linked like any other; texts of one
or two words have one shingle, the whole sequence; very long texts are read whole; bytes that are
no UTF-8 are hashed as they are; rows with equal or null ids are documents of their own (a null id
is never the least of a group, unless all are null); an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpoint, forget, slices, spread_join, utf8
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a block, cells of a matrix that is compared at a time.
BLOCK_ROWS, CELLS = 1 << 16, 1 << 18
#: Hashes whose bits are added up in one byte at a time.
LANE = 255
HALF = U64(0xFFFFFFFF)


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of a text, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate([[0], end[:-SHINGLE]])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin.tolist(), (end[SHINGLE - 1 :] - 1).tolist(), strict=True)), np.uint64, len(begin))


def majority(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For the hashes from begin[i] to begin[i + 1]: bits set in over half of them."""
    size = np.diff(begin)
    parts = -(-size // LANE)
    owner = np.repeat(np.arange(len(size)), parts)
    if not len(owner):
        return np.zeros(len(size), np.uint64)
    first = np.cumsum(parts) - parts
    at = begin[:-1][owner] + (np.arange(len(owner)) - first[owner]) * LANE
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(parts)
    for shift in range(8):
        # eight bits of each hash at a time, each in a byte of its own that can't overflow
        lanes = np.add.reduceat((h >> U64(shift)) & U64(0x0101010101010101), at)
        count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first[some], axis=0)
        bits = 2 * count > size[some][:, None]
        out[some] |= (bits.astype(np.uint64) << (U64(8) * np.arange(8, dtype=np.uint64) + U64(shift))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(batches):
    for b in batches:
        off, data = utf8(b.column("text"))
        for i, j in slices(off):
            raw = data[off[i] : off[j]].tobytes()
            each = [shingle_hashes(raw[x:y]) for x, y in zip((off[i:j] - off[i]).tolist(), (off[i + 1 : j + 1] - off[i]).tolist(), strict=True)]
            size = np.array([len(x) for x in each], np.int64)
            fp = majority(np.concatenate(each), np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(fp.view(np.int64)), pa.array(size)], names=["doc_id", "fp", "n_shingles"])


def reach(radius: int) -> list[tuple[int, int]]:
    """Steps from a tile to those that its fingerprints may have links in, one of each two."""
    steps = range(-radius, radius + 1)
    return [(x, y) for x in steps for y in steps if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]


def quarters(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fp >> U64(16 * k)) & U64(0xFFFF)) for k in range(4)], axis=1).astype(np.int16)


def matches(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Places (i, j) of fingerprints of two blocks within the radius, by parts; i < j in one block."""
    qa, qb = quarters(a), quarters(b)
    kinds, of = np.unique(qa, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(of.ravel(), minlength=len(kinds)))])
    for k, kind in enumerate(kinds):
        rows = order[edges[k] : edges[k + 1]]
        near = np.flatnonzero(np.abs(qb - kind).sum(axis=1) <= radius)
        if not len(near):
            continue
        there = b[near]
        step = max(1, CELLS // len(near))
        for x in range(0, len(rows), step):
            i, j = np.nonzero(np.bitwise_count(a[rows[x : x + step]][:, None] ^ there[None, :]) <= radius)
            i, j = rows[x + i], near[j]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def hooked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the least place of a group) after the links (i, j) are added."""
    while True:
        x, y = label[i], label[j]
        if np.array_equal(x, y):
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


#: ``v`` is set for a link of the forest, ``n`` for a number of linked rows.
COMPARED = "u long, v long, n long"


def compare(radius: int):
    """The links of each pair of blocks: a forest, and numbers of rows linked with."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                (fa, na), (fb, nb) = (column_pair(b.column(c), r) for c in ("a", "b"))
                same = b.column("same")[r].as_py()
                every = fa if same else np.concatenate([fa, fb])
                shift = 0 if same else len(fa)
                weight = na if same else np.concatenate([na, nb])
                label, count = np.arange(len(every)), np.zeros(len(every), np.int64)
                for i, j in matches(fa, fb, radius, same):
                    j = j + shift
                    count += np.bincount(i, weight[j], len(every)).astype(np.int64) + np.bincount(j, weight[i], len(every)).astype(np.int64)
                    label = hooked(label, i, j)
                child, some = np.flatnonzero(label != np.arange(len(every))), np.flatnonzero(count)
                u = np.concatenate([every[child], every[some]]).view(np.int64)
                v = pa.array(np.concatenate([every[label[child]], every[some]]).view(np.int64), mask=np.arange(len(u)) >= len(child))
                n = pa.array(np.concatenate([np.zeros(len(child), np.int64), count[some]]), mask=np.arange(len(u)) < len(child))
                yield pa.RecordBatch.from_arrays([pa.array(u), v, n], names=["u", "v", "n"])

    return run


def column_pair(column, r: int) -> tuple[np.ndarray, np.ndarray]:
    values = column[r].values
    fp, n = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return fp.view(np.uint64), n


def blocks_of(distinct: DataFrame, block_rows: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(p, q, s, rows): blocks of each tile, and the number of blocks of each tile.

    A tile is two counts of 32 bits, so there are at most 33 * 33 of them.
    """
    half = lambda c: F.bit_count(c).cast("int")
    tiled = distinct.withColumn("p", half(F.shiftrightunsigned("fp", 32))).withColumn("q", half(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
    sizes = {(r["p"], r["q"]): -(-r["count"] // block_rows) for r in tiled.groupBy("p", "q").count().collect()}
    if not sizes:
        return tiled.select("p", "q", F.lit(0).alias("s"), F.array(F.struct("fp", "n")).alias("rows")), sizes
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for (p, q), m in sizes.items() for x in (p * 64 + q, m)]), F.col("p") * 64 + F.col("q")), F.lit(1))
    salted = tiled.withColumn("s", F.pmod(F.xxhash64("fp"), many).cast("int"))
    return salted.groupBy("p", "q", "s").agg(F.collect_list(F.struct("fp", "n")).alias("rows")), sizes


def block_pairs(blocks: DataFrame, sizes: dict[tuple[int, int], int], radius: int) -> DataFrame:
    """(a, b, same): each block with the blocks that it has to be compared with."""
    spark = blocks.sparkSession
    visits = []
    for (p, q), m in sorted(sizes.items()):
        for dp, dq in reach(radius):
            visits.append((p, q, p + dp, q + dq, sizes.get((p + dp, q + dq), 0)))
    visits = spark.createDataFrame([v for v in visits if v[4]], "p int, q int, p2 int, q2 int, m int")
    to = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    # at most 33 * 33 * 25 rows, so they can be sent to all tasks
    sent = blocks.join(F.broadcast(visits), ["p", "q"]).select(F.col("p").alias("p1"), F.col("q").alias("q1"), F.col("s").alias("s1"), F.col("rows").alias("a"), F.col("p2").alias("p"), F.col("q2").alias("q"), to.alias("s"))
    home = (F.col("p1") == F.col("p")) & (F.col("q1") == F.col("q"))
    return sent.join(blocks, ["p", "q", "s"]).filter(~home | (F.col("s1") <= F.col("s"))).select("a", F.col("rows").alias("b"), (home & (F.col("s1") == F.col("s"))).alias("same"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp, n_shingles, component_id, n_links) for each row of ``docs``.

    ``fp`` is the fingerprint as a signed long; ``component_id`` the least doc_id of those that
    links lead to, the row's own included; ``n_links`` the number of other rows within the radius.
    """
    spark = docs.sparkSession
    told = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fingerprints, "doc_id long, fp long, n_shingles long"))
    distinct = checkpoint(told.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    blocks, sizes = blocks_of(distinct.select("fp", "n"), block_rows)
    blocks = checkpoint(blocks)
    if sizes:
        found = checkpoint(block_pairs(blocks, sizes, radius).mapInArrow(compare(radius), COMPARED))
        label = checkpoint(components(found.filter("v is not null").select("u", "v")))
    else:
        found = spark.createDataFrame([], COMPARED)
        label = spark.createDataFrame([], "node long, label long")
    linked = found.filter("n is not null").groupBy(F.col("u").alias("fp")).agg(F.sum("n").alias("others"))
    grouped = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    group = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    known = spread_join(grouped.join(linked, "fp", "left"), group, "label").select("fp", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = checkpoint(known)
    for table in (distinct, blocks, found if sizes else None, label if sizes else None):
        forget(table)
    return spread_join(told, known, "fp").select("doc_id", "fp", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "n_links")
