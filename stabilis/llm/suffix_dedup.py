"""Removal of long byte strings that occur more than once, by a distributed difference cover.

A difference cover is a sample of text positions such that any two suffixes reach sampled
positions after the same number of bytes; sorting the sampled suffixes then places all others.
The cover here is content-defined (a string synchronizing set): position ``a`` is sampled if
its ``KGRAM`` bytes have the least fingerprint among ``WINDOW`` consecutive ones.  Equal strings
of ``length`` bytes sample the same position at the same distance ``d < WINDOW`` from their
start, which is the property of a cover, with two positions in ``WINDOW`` sampled and not two
in three.  Then, as in the classical algorithm:

1. *sampled tuples*: each sampled position gets the name of the bytes that every string with
   this sample has in common; names are sorted, and a position whose name occurs once leaves;
2. *recursion on names*: what is left gets names of longer and longer extents, for shorter
   and shorter ranges of ``d``; equal neighbours settle a whole range of suffixes at once, and
   ranges whose common part is unique leave;
3. *merge*: suffixes that are not sampled stand ``d`` bytes before a sample; those not settled
   are sorted by the name of their own first ``length`` bytes;
4. *adjacent prefixes* that are equal mark their ``length`` bytes as repeated.

Names are fingerprints, 64 bits where they only let a range go on and 128 bits where they
settle it; sorting is by name, so equal prefixes are adjacent, but the order is not the
alphabet's.  A name that a task has seen twice is settled there and sent on once, so a string
that a third of all documents hold reaches its task once for each task that has it.

Nulls count as empty texts; texts shorter than ``length`` lose nothing; repeated rows are
documents of their own and remove each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Rolling, mix, n_partitions, numbered, rolling, slices, utf8

KGRAM, WINDOW = 24, 128
#: Widths of the ranges of ``d`` in the recursion; a width of 1 is the merge of single suffixes.
WIDTHS = (128, 16, 1)
ROW = "key long, u2 long, name long, uid long, pack long, state short"
#: state of a row: bits for settled before, settled now, known to go on, and dealt by a key that
#: is not its name, as its name needs no answer.
OLD, NEW, KNOWN, DEALT = 1, 2, 4, 8


def pack(a, far, near):
    """A sampled position in its text and its range of distances, as one long."""
    return (a * WINDOW + far) * WINDOW + near


def unpack(p):
    return p // (WINDOW * WINDOW), p // WINDOW % WINDOW, p % WINDOW


def cover(off: np.ndarray, data: np.ndarray, roll: Rolling, length: int):
    """Row, sampled position, first and last start of the strings that have this sample."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    begin, end = off[:-1], off[1:]
    long = end - begin >= length
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, begin[long], 1)
    np.add.at(step, end[long] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(step)[:n])
    if not len(p):
        return none, none, none, none
    x = np.arange(n - KGRAM + 1)
    least = roll.of(x, x + KGRAM)
    at = x.astype(np.int32)
    s = 1
    while s < WINDOW:
        left = least[:-s] <= least[s:]
        least = np.where(left, least[:-s], least[s:])
        at = np.where(left, at[:-s], at[s:])
        s *= 2
    a = at[p].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(p)]]) - 1
    return np.searchsorted(off, p[new], "right") - 1, a[new], p[new], p[last]


def once(names: list[np.ndarray]):
    """Order, first-of-group mask and group sizes in that order."""
    order = np.lexsort(names[::-1])
    first = np.ones(len(order), bool)
    if len(order) > 1:
        first[1:] = np.any([x[order][1:] != x[order][:-1] for x in names], axis=0)
    begin = np.flatnonzero(first)
    return order, first, np.diff(np.concatenate([begin, [len(order)]]))


def spread(uid, packed):
    """A key that deals settled rows evenly."""
    return mix(uid.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + packed.astype(np.uint64)).view(np.int64)


def sample(length: int):
    """Step 1, on texts: a row for each sampled position, keyed by its name."""

    def run(batches):
        for b in batches:
            off, data = utf8(b.column("text"))
            uid = b.column("uid").to_numpy()
            for i, j in slices(off):
                o, d = off[i : j + 1] - off[i], data[off[i] : off[j]]
                roll = rolling(length)(d)
                row, a, lo, hi = cover(o, d, roll, length)
                if not len(row):
                    continue
                name = roll.of(a, a + length - WINDOW + 1).view(np.int64)
                packed = pack(a - o[row], a - lo, a - hi)
                yield settle_names(name, uid[i:j][row], packed, np.zeros(len(row), np.int16))

    return run


def settle_names(name, uid, packed, state):
    """Rows with their key; a name that is here twice is settled, and one row tells the others."""
    order, first, size = once([name])
    many = np.zeros(len(name), bool)
    many[order] = np.repeat(size > 1, size)
    head = np.zeros(len(name), bool)
    head[order] = first
    open_ = (state & OLD) == 0
    if len(order):
        some = np.repeat(np.add.reduceat(open_[order].astype(np.int64), np.flatnonzero(first)) > 0, size)
        here = np.zeros(len(name), bool)
        here[order] = some
        many &= here
    key = np.where(many & ~head, spread(uid, packed), name)
    state = np.where(many, state | KNOWN, state) | np.where(many & ~head, DEALT, 0)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(uid), pa.array(packed), pa.array(state.astype(np.int16))], names=["key", "uid", "pack", "state"])


NAMED = "key long, uid long, pack long, state short"


def repeated_names(batches):
    """Of a partition dealt by key: the rows whose name is here twice, or was elsewhere."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    name, uid, packed, state = (t.column(c).to_numpy() for c in ("key", "uid", "pack", "state"))
    keep = (state & KNOWN) > 0
    at = np.flatnonzero((state & DEALT) == 0)
    order, first, size = once([name[at]])
    if len(order):
        begin = np.flatnonzero(first)
        open_ = ((state[at] & OLD) == 0)[order]
        known = keep[at][order]
        goes = (np.maximum.reduceat(known, begin)) | ((size > 1) & (np.add.reduceat(open_.astype(np.int64), begin) > 0))
        keep[at[order]] = np.repeat(goes, size)
    yield pa.RecordBatch.from_arrays([pa.array(uid[keep]), pa.array(packed[keep]), pa.array((state[keep] & OLD).astype(np.int16))], names=["uid", "pack", "state"])


def extents(length: int, width: int):
    """Steps 2 and 3, on texts with their ranges: rows named by common part and by extent."""

    def run(batches):
        for b in batches:
            off, data = utf8(b.column("text"))
            uid = b.column("uid").to_numpy()
            packs, states = b.column("packs"), b.column("states")
            per = np.diff(packs.offsets.to_numpy())
            flat, old = packs.flatten().to_numpy(), states.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(per)])
            for i, j in slices(off):
                o, d = off[i : j + 1] - off[i], data[off[i] : off[j]]
                row = np.repeat(np.arange(j - i), per[i:j])
                a, far, near = unpack(flat[at[i] : at[j]])
                state = old[at[i] : at[j]]
                blocks = far // width - near // width + 1
                which = np.repeat(np.arange(len(a)), blocks)
                block = near[which] // width + np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                row, a, state = row[which], a[which], state[which]
                lo, hi = np.maximum(near[which], block * width), np.minimum(far[which], block * width + width - 1)
                g = a + o[row]
                one, two = rolling(length)(d), rolling(length)(d, 1)
                u1, u2 = (r.of(g - hi, g - lo + length).view(np.int64) for r in (one, two))
                common = np.zeros(len(a), np.int64)  # single suffixes don't go on
                if width > 1:
                    common = mix(one.of(g - block * width, g - block * width - width + 1 + length) + block.astype(np.uint64)).view(np.int64)
                packed, who = pack(a, hi, lo), uid[i:j][row]
                order, first, size = once([u1, u2])
                twice, head = np.zeros(len(a), bool), np.zeros(len(a), bool)
                twice[order], head[order] = np.repeat(size > 1, size), first
                now = np.where(twice, state | NEW, state)
                now = np.where(twice & ~head, now | DEALT, now).astype(np.int16)
                key = np.where(twice & ~head, spread(who, packed), u1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, u2, common, who, packed, now)], names=["key", "u2", "name", "uid", "pack", "state"])

    return run


def judged(t: pa.Table):
    """The columns of a partition dealt by extent, who is settled now and who goes on.

    Rows that came with a key of their own are settled and have somebody who goes on for them.
    """
    name, uid, packed, state = (t.column(c).to_numpy() for c in ("name", "uid", "pack", "state"))
    u1, u2 = t.column("key").to_numpy(), t.column("u2").to_numpy()
    settled, goes = (state & NEW) > 0, np.zeros(len(uid), bool)
    at = np.flatnonzero((state & DEALT) == 0)
    order, first, size = once([u1[at], u2[at]])
    if len(order):
        begin = np.flatnonzero(first)
        new = np.repeat((size > 1) | np.maximum.reduceat(settled[at][order], begin), size)
        settled[at[order]] |= new
        goes[at[order[begin]]] = True
    return name, uid, packed, state, settled, goes


def settled_ranges(length: int):
    """Runs of bytes that the rows settled now cover."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            _, uid, packed, state, settled, _ = judged(pa.Table.from_batches(got))
            new = settled & ((state & OLD) == 0)
            a, far, near = unpack(packed[new])
            yield pa.RecordBatch.from_arrays([pa.array(uid[new]), pa.array(a - far), pa.array(a - near + length)], names=["uid", "b", "e"])

    return run


def open_ranges(batches):
    """The rows that go on to the next width, keyed by the name of their common part."""
    got = [b for b in batches if b.num_rows]
    if got:
        name, uid, packed, _, settled, goes = judged(pa.Table.from_batches(got))
        yield settle_names(name[goes], uid[goes], packed[goes], np.where(settled[goes], OLD, 0).astype(np.int16))


#: Columns of the result, in place of any such columns of the input.
MADE = ("n_bytes", "n_removed", "n_spans", "kept")


def erase(batches):
    """What is left of each text without its runs."""
    for b in batches:
        off, data = utf8(b.column("text"))
        spans_b, spans_e = b.column("b"), b.column("e")
        n, out = b.num_rows, ([], [], [], [])
        for i in range(n):
            text = data[off[i] : off[i + 1]]
            step = np.zeros(len(text) + 1, np.int64)
            if spans_b[i].is_valid:
                np.add.at(step, spans_b[i].values.to_numpy(), 1)
                np.add.at(step, spans_e[i].values.to_numpy(), -1)
            gone = np.cumsum(step)[:-1] > 0
            runs = int(gone[:1].sum() + np.sum(gone[1:] & ~gone[:-1]))
            for x, v in zip(out, (len(text), int(gone.sum()), runs, text[~gone].tobytes()), strict=True):
                x.append(v)
        longs = [pa.array(x, pa.int64()) for x in out[:3]]
        yield pa.RecordBatch.from_arrays([b.column("rest"), *longs, pa.array(out[3], pa.binary())], names=["rest", *MADE])


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept``, the bytes that are left.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the
    input, in the same document or another.  ``docs`` needs a column ``text``; its other columns
    stay, but for those of the names above, which are replaced.
    """
    n = n_partitions(docs.sparkSession)
    rest = [c for c in docs.columns if c not in MADE]
    # the same columns in every use, so that the texts are dealt out once and numbered once
    texts = numbered(docs.select(F.struct(*rest).alias("rest"), "text")).repartition(n, "uid")
    rows = texts.mapInArrow(sample(length), NAMED)
    spans = None
    for width in WIDTHS:
        live = rows.repartition(n, "key").mapInArrow(repeated_names, "uid long, pack long, state short")
        per = live.groupBy("uid").agg(F.collect_list(F.struct("pack", "state")).alias("x")).select("uid", F.col("x.pack").alias("packs"), F.col("x.state").alias("states"))
        named = texts.join(per, "uid").mapInArrow(extents(length, width), ROW).repartition(n, "key")
        found = named.mapInArrow(settled_ranges(length), "uid long, b long, e long")
        spans = found if spans is None else spans.unionByName(found)
        rows = named.mapInArrow(open_ranges, NAMED)
    per = spans.groupBy("uid").agg(F.collect_list(F.struct("b", "e")).alias("x")).select("uid", F.col("x.b").alias("b"), F.col("x.e").alias("e"))
    made = T.StructType([*texts.select("rest").schema, *(T.StructField(c, T.BinaryType() if c == "kept" else T.LongType()) for c in MADE)])
    return texts.join(per, "uid", "left").mapInArrow(erase, made).select("rest.*", *MADE)


def digest(batches):
    for b in batches:
        cols = [b.column(c) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
        sha = [hashlib.sha256(x.as_py()).hexdigest() for x in b.column("kept")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

#: SQL for DuckDB: every string of 200 bytes, in hexadecimal, named by its digest and grouped.
ORACLE = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, substr(h, 256 * c + 1, 654) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 256 + 1)) AS c FROM d)),
s AS MATERIALIZED (SELECT doc_id, 128 * c + j AS i, md5_number(substr(h, 2 * j + 1, 400)) AS k FROM (SELECT doc_id, c, h, unnest(range(0, least(128, length(h) // 2 - 199))) AS j FROM c)),
r AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
e AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, TRUE)::INT AS fresh FROM r),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d),
parts AS (SELECT doc_id, a, b, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM ends),
kept AS (SELECT doc_id, any_value(length(h) // 2) AS n, sum(b - a) AS removed, count(b) AS spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a, b NULLS LAST) AS k FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept"""
