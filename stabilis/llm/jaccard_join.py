"""Near-duplicate groups: an exact Jaccard join on word shingles by several global orders.

Two sets with Jaccard similarity of at least ``t`` share a token among the first
``n - ceil(t n) + 1`` of each (the prefix) under *any* order of all tokens.  Candidates have to
share prefix tokens under each of several orders before they are verified.  All orders put tokens
that are frequent over the whole table last, by a count sketch of fixed size (any order is right,
this one keeps groups small), and differ in how they hash tokens of one frequency.

Sets are handled as classes: documents with equal sets are one class, known by a fingerprint of
the set, so copies are never joined with each other.  Links are found in rounds.  In each, every
token that still joins different groups names a centre, its candidates are verified, and linked
classes become one group; the centre is the class that shares most of its prefix, which in a
cloud of near copies is what they were copied from.  After ``ROUNDS`` such rounds all pairs that
share a prefix token and are not in one group yet are candidates, so no link between groups is
lost, while pairs inside a group, whose links can't change it, aren't enumerated.

Null, empty and blank texts have an empty set and link with nothing; texts of fewer words than
a shingle have one token, the whole sequence; rows with equal or null ids are documents of their
own; very long texts are read whole; an empty table gives an empty result; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, checkpoint, forget, hot_keys, mix, n_partitions, numbered, renamed, slices, spread_join, utf8, word_names, words
from .components import components

SHINGLE, BITS = 5, 52
#: Cells of the count sketch, its rows per block, and rounds of centres before all pairs.
CELLS, BLOCK, ROUNDS = 1 << 17, 1 << 11, 2
#: Bits of the map of classes that texts are read again for.
MAP_BITS = 1 << 24
#: Parts of the tokens that are shuffled one after the other.
PARTS = 2
#: Seeds of the token orders; the first one groups candidates, the others filter them.
ORDERS = (0, 101, 202)
KNOWN, DEALT = 1, 2


def shingle_sets(off: np.ndarray, data: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of ``BITS`` bits, sorted within each row, and where each
    row's begin; a slice has fewer than 2 ** (64 - BITS) rows."""
    data = LOWER[data]
    start, end, row = words(off, data)
    n = len(off) - 1
    per = np.bincount(row, minlength=n)
    h = word_names(data, start, end)
    first = np.cumsum(per) - per
    count = np.where(per >= k, per - k + 1, 0)
    which = np.repeat(np.arange(n, dtype=np.uint64), count)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(which))
    token = chained([h[at + i] for i in range(k)], len(at))
    few = np.flatnonzero((per > 0) & (per < k))
    if len(few):
        short = np.concatenate([chained([h[first[r] + i : first[r] + i + 1] for i in range(per[r])], 1) for r in few])
        which, token = np.concatenate([which, few.astype(np.uint64)]), np.concatenate([token, short])
    both = np.sort(which << U64(BITS) | token >> U64(64 - BITS))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    size = np.bincount((both >> U64(BITS)).astype(np.int64), minlength=n)
    return both & U64((1 << BITS) - 1), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def chained(names: list[np.ndarray], n: int) -> np.ndarray:
    """One fingerprint for the words in a row."""
    h = np.full(n, U64(len(names)))
    for name in names:
        h = mix(h * U64(0x9E3779B97F4A7C15) + name)
    return h


def fingerprints(token: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of each row's set; 0 for the empty set."""
    n = np.diff(begin)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token + U64(0x5851F42D4C957F2D)))])
    h = mix((total[begin[1:]] - total[begin[:-1]]) ^ mix(n.astype(np.uint64)))
    return n, np.where(n > 0, h, U64(0)).view(np.int64)


def cell(token: np.ndarray) -> np.ndarray:
    return (token >> U64(BITS - 17)).astype(np.int64) % CELLS


def survey(batches):
    """A row for each document (its class) and the task's token counts in blocks of cells."""
    counts = np.zeros(CELLS, np.int64)
    for b in batches:
        off, data = utf8(b.column("text"))
        for i, j in slices(off):
            token, begin = shingle_sets(off[i : j + 1] - off[i], data[off[i] : off[j]])
            counts += np.bincount(cell(token), minlength=CELLS)
            n, h = fingerprints(token, begin)
            yield member_rows(b.column("doc_id").slice(i, j - i), n, h)
    rows = np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(rows), pa.array([counts[r * BLOCK : (r + 1) * BLOCK].tobytes() for r in rows], pa.binary())], names=SURVEY_COLUMNS
    )


SURVEY_COLUMNS = ["doc_id", "n", "cls", "block", "counts"]


def member_rows(doc_id, n, h):
    size = len(n)
    return pa.RecordBatch.from_arrays([doc_id, pa.array(n), pa.array(h), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], names=SURVEY_COLUMNS)


def add_counts(batches):
    have: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
            have[k] = have.get(k, 0) + np.frombuffer(v, np.int64)
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int64()), pa.array([v.tobytes() for v in have.values()], pa.binary())], names=["block", "counts"])


def levels(sketch: np.ndarray) -> np.ndarray:
    """Frequency class of each cell: 0 for usual ones, then one more for each doubling."""
    usual = max(1.0, 2 * float(sketch.mean()))
    return np.ceil(np.log2(np.maximum(sketch / usual, 1))).astype(np.uint64)


def prefix(token: np.ndarray, begin: np.ndarray, level: np.ndarray, seed: int, t: int):
    """The prefix tokens of each row under one order, as ranked names, their ranks and rows.

    A ranked name is the frequency class of a token followed by a hash of it, so that its order
    is the order of tokens.
    """
    n = np.diff(begin)
    row = np.repeat(np.arange(len(n)), n)
    name = level[cell(token)] << U64(BITS - 6) | mix(token + U64(seed)) >> U64(64 - BITS + 6)
    name = np.sort(row.astype(np.uint64) << U64(BITS) | name) & U64((1 << BITS) - 1)
    rank = np.arange(len(token)) - begin[row]
    keep = rank < (n - -(-t * n // 100) + 1)[row]
    return name[keep], rank[keep], row[keep]


def prefixes(level: np.ndarray, t: int, part: int = 0, parts: int = 1):
    """A row for each prefix token of each class of a slice, a token with company here settled.

    Only tokens of one of some parts: what becomes of a token depends on its own rows alone.
    """

    def run(batches):
        for b in batches:
            off, data = utf8(b.column("text"))
            for i, j in slices(off):
                token, begin = shingle_sets(off[i : j + 1] - off[i], data[off[i] : off[j]])
                n, h = fingerprints(token, begin)
                name, rank, row = prefix(token, begin, level, ORDERS[0], t)
                _, one = np.unique(h, return_index=True)
                mine = np.zeros(len(n), bool)
                mine[one] = True
                mine = mine[row] & (name % U64(parts) == U64(part))
                row = row[mine]
                yield company(name[mine].view(np.int64), h[row], n[row].astype(np.int32), rank[mine].astype(np.int32))

    return run


TOKENS = "key long, token long, cls long, n int, rank int, state short"


def company(token, cls, n, rank):
    order = np.argsort(token, kind="stable")
    first = np.ones(len(token), bool)
    first[1:] = token[order][1:] != token[order][:-1]
    size = np.diff(np.concatenate([np.flatnonzero(first), [len(token)]]))
    many, head = np.zeros(len(token), bool), np.zeros(len(token), bool)
    many[order], head[order] = np.repeat(size > 1, size), first
    key = np.where(many & ~head, mix(token.view(np.uint64) * U64(3) + cls.view(np.uint64)).view(np.int64), token)
    state = np.where(many, KNOWN, 0) | np.where(many & ~head, DEALT, 0)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.where(many & ~head, token, 0)), pa.array(cls), pa.array(n), pa.array(rank), pa.array(state.astype(np.int16))], names=["key", "token", "cls", "n", "rank", "state"])


def shared(t: int):
    """Of a partition dealt by token: the rows whose token is in a class of fitting size too."""

    def run(batches):
        yield from shared_rows(batches, t)

    return run


def shared_rows(batches, least: int):
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    key, token, cls, n, rank, state = (t.column(c).to_numpy() for c in t.column_names)
    own = (state & DEALT) == 0
    token = np.where(own, key, token)
    keep = ~own
    at = np.flatnonzero(own)
    at = at[np.lexsort((cls[at], n[at], token[at]))]
    if len(at):
        new = np.concatenate([[True], (token[at][1:] != token[at][:-1]) | (cls[at][1:] != cls[at][:-1])])
        known = np.maximum.reduceat(state[at] & KNOWN, np.flatnonzero(new))
        at = at[new]  # sizes ascend, so neighbours of a token fit best
        near = (token[at][1:] == token[at][:-1]) & (n[at][:-1].astype(np.int64) * 100 >= n[at][1:].astype(np.int64) * least)
        keep[at[1:]] |= near
        keep[at[:-1]] |= near
        begin = np.flatnonzero(np.concatenate([[True], token[at][1:] != token[at][:-1]]))
        size = np.diff(np.concatenate([begin, [len(at)]]))
        keep[at] |= np.repeat(np.maximum.reduceat(known, begin) > 0, size)
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, cls, n, rank)], names=["token", "cls", "n", "rank"])


def set_rows(column: str, wanted: np.ndarray, of):
    """Class and ``of`` its tokens, for classes that may be wanted; one row for the equal sets of a slice."""

    def run(batches):
        for b in batches:
            off, data = utf8(b.column("text"))
            for i, j in slices(off):
                token, begin = shingle_sets(off[i : j + 1] - off[i], data[off[i] : off[j]])
                _, h = fingerprints(token, begin)
                _, one = np.unique(h, return_index=True)
                one = one[maybe(wanted, h[one])]
                yield pa.RecordBatch.from_arrays([pa.array(h[one]), pa.array([of(token[begin[r] : begin[r + 1]]).tobytes() for r in one], pa.binary())], names=["cls", column])

    return run


def short_names(token: np.ndarray, level: np.ndarray, t: int) -> np.ndarray:
    """Size of the set, the length of its parity sketch, the sketch, and its prefix names under
    the second order, 32 bits of each."""
    names = prefix(token, np.array([0, len(token)]), level, ORDERS[1], t)[0] & U64(0xFFFFFFFF)
    odd = parity(token)
    return np.concatenate([np.array([len(token), len(odd)], np.uint32), odd, names.astype(np.uint32)])


def parity(token: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens fall in each of some cells, a power of two that is about
    four a token, as bits; two sets differ in as many tokens as cells at least."""
    m = max(32, 1 << int(4 * len(token) - 1).bit_length())
    odd = np.bincount((mix(token + U64(404)) & U64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint32)


def differ(x: np.ndarray, y: np.ndarray) -> int:
    """Cells in which two parity sketches differ; the longer one is folded."""
    if len(x) < len(y):
        x, y = y, x
    if len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def bitmap(classes: DataFrame, column: str) -> np.ndarray:
    """A bit for each class, in a map of fixed size: what it rules out needn't be shuffled.

    Bits may be set for others too, so an exact join follows wherever it matters.
    """
    spot = F.pmod(F.col(column), F.lit(MAP_BITS))
    words_ = classes.groupBy((spot / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("v")).toPandas()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words_["w"].to_numpy(np.int64)] = words_["v"].to_numpy(np.int64)
    return out


def maybe(wanted: np.ndarray, cls: np.ndarray) -> np.ndarray:
    spot = np.mod(cls, MAP_BITS)
    return (wanted[spot // 64] >> (spot % 64)) & 1 > 0


def in_map(wanted: np.ndarray):
    def run(batches):
        for b in batches:
            keep = maybe(wanted, b.column("cls").to_numpy())
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns], names=b.schema.names)

    return run


def heads_meet(t: int):
    """Pairs whose prefixes under the second order share as many names as similar sets must and
    whose parity sketches don't show too many differences.

    What is shared beyond the prefixes is at most what one of the sets has beyond its own.
    """

    def run(batches):
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(k)[i].as_buffer(), np.uint32) for k in ("x", "y"))
                nx, ny, ox, oy = int(x[0]), int(y[0]), 2 + int(x[1]), 2 + int(y[1])
                if (100 + t) * differ(x[2:ox], y[2:oy]) > (100 - t) * (nx + ny):
                    continue
                both = int(np.isin(x[ox:], y[oy:]).sum())
                good[i] = both > 0 and (100 + t) * (both + max(beyond(nx, t), beyond(ny, t))) >= t * (nx + ny)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    return run


def beyond(n, t: int):
    """Tokens of a set of ``n`` that are not in its prefix."""
    return -(-t * n // 100) - 1


def verify(level: np.ndarray, t: int):
    """Pairs whose sets pass the prefix filter of the orders left and then are similar enough."""

    def run(batches):
        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (np.frombuffer(b.column(k)[i].as_buffer(), np.uint64) for k in ("x", "y"))
                good[i] = all(meet(x, y, level, seed, t) for seed in ORDERS[2:]) and similar(x, y, t)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(c[good])], names=["u", "v"])

    return run


def meet(x, y, level, seed, t) -> bool:
    heads = [prefix(z, np.array([0, len(z)]), level, seed, t)[0] for z in (x, y)]
    return bool(np.isin(heads[0], heads[1]).any())


def similar(x, y, t) -> bool:
    both = int(np.isin(x, y, assume_unique=True).sum())
    return 100 * both >= t * (len(x) + len(y) - both)


def sizes_fit(t: int):
    """Sizes of two sets that can be similar enough."""
    return (F.col("x.n") * 100 >= F.col("y.n") * t) & (F.col("y.n") * 100 >= F.col("x.n") * t)


def rank_fits(t: int):
    """Ranks of a shared token that leave enough tokens to share, if it is the first shared one.

    A pair needs one such token; tokens after the first may fail this.
    """
    return F.lit(100 + t) * F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank")) >= F.lit(t) * (F.col("x.n") + F.col("y.n"))


def smaller_fits(t: int):
    """Rows that can be the smaller set's in ``rank_fits``, whatever the size of the larger one."""
    return (F.lit(100 + t) * (F.col("n") - F.col("rank"))) >= F.lit(2 * t) * F.col("n")


def with_both(pairs: DataFrame, data: DataFrame, column: str) -> DataFrame:
    """(a, b) with the ``column`` of both classes as x and y."""
    x, y = (data.select(F.col("cls").alias(k), F.col(column).alias(v)) for k, v in (("a", "x"), ("b", "y")))
    hot = {k: hot_keys(pairs, k) for k in "ab"}
    return spread_join(spread_join(pairs, x, "a", hot=hot["a"]), y, "b", hot=hot["b"])


def near_duplicates(docs: DataFrame, t: int = 75) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cls, component) for each row, and the (u, v) links of classes found.

    ``component`` is the least class of a group; ``t`` is the similarity in hundredths.  The
    links connect each group, and hold every one that was verified.
    """
    members, links, label = linked(docs, t)
    out = spread_join(members, label.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "n_shingles", "cls", F.coalesce("label", "cls").alias("component"))
    return out, links


def counts_fit(t: int):
    """Sets that can share as many prefix tokens as similar ones must, by the reckoning of
    ``heads_meet``, if the token is the first shared one: ``left`` counts those from there on."""
    rest = F.greatest(F.ceil(F.col("x.n") * t / 100), F.ceil(F.col("y.n") * t / 100)) - 1
    return (F.least("x.left", "y.left") + rest) * (100 + t) >= (F.col("x.n") + F.col("y.n")) * t


def with_class(column: str):
    """All columns with the class of each text and whether it has tokens."""

    def run(batches):
        for b in batches:
            off, data = utf8(b.column(column))
            cls, some = [], []
            for i, j in slices(off):
                n, h = fingerprints(*shingle_sets(off[i : j + 1] - off[i], data[off[i] : off[j]]))
                cls.append(h)
                some.append(n > 0)
            cls, some = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((cls, np.int64), (some, bool)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cls), pa.array(some)], names=[*b.schema.names, "cls", "some"])

    return run


def keep_one(docs: DataFrame, t: int = 75) -> DataFrame:
    """``docs`` with one row of each group, that of the least doc_id (null last); rows without
    tokens all stay.  Rows are numbered, so ``docs`` should be a table as it is read.  Columns
    of any names stay as they are."""
    _, _, label = linked(docs, t)
    plain, names = renamed(docs)
    schema = T.StructType([*plain.schema, T.StructField("cls", T.LongType()), T.StructField("some", T.BooleanType())])
    rows = numbered(plain.mapInArrow(with_class(names["text"]), schema), "uid")
    group = F.struct(F.when(F.col("some"), F.coalesce("label", "cls")).alias("g"), F.when(~F.col("some"), F.col("uid")).alias("own"))
    keyed = spread_join(rows.select("uid", "cls", "some", F.col(names["doc_id"]).alias("id")), label.withColumnRenamed("node", "cls"), "cls", "left")
    first = keyed.groupBy(group.alias("k")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("m"))
    return rows.join(first.select(F.col("m.uid").alias("uid")), "uid", "left_semi").select(*plain.columns).toDF(*docs.columns)


def linked(docs: DataFrame, t: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of the rows, links of classes, and (node, label) for the classes that have links."""
    spark = docs.sparkSession
    n = n_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    surveyed = checkpoint(docs.mapInArrow(survey, "doc_id long, n long, cls long, block long, counts binary"))
    members = surveyed.filter("block is null").select("doc_id", F.col("n").alias("n_shingles"), "cls")
    sketch = np.zeros(CELLS, np.int64)
    for r in surveyed.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(add_counts, "block long, counts binary").toLocalIterator():
        sketch[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["counts"], np.int64)
    level = levels(sketch)
    texts = docs.select("text")
    # a part of the tokens at a time, as their shuffle is the largest one and goes when the part is written
    groups = None
    for part in range(PARTS):
        some = checkpoint(texts.mapInArrow(prefixes(level, t, part, PARTS), TOKENS).repartition(n, "key").mapInArrow(shared(t), "token long, cls long, n int, rank int"))
        groups = some if groups is None else groups.union(some)
    share = groups.groupBy("cls").agg((F.count("*") / F.max(F.col("n") - F.ceil(F.col("n") * t / 100) + 1)).alias("share"))
    g = groups.join(share, "cls").withColumn("label", F.col("cls"))
    links = tested = label = kept = heads = None
    for step in range(ROUNDS + 1):
        if label is not None:
            g = g.drop("label").join(label, g["cls"] == label["node"], "left").withColumn("label", F.coalesce("label", "cls")).drop("node")
        mixed = g.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
        before, kept = kept or groups, checkpoint(g.join(mixed, "token"))
        forget(before)
        g = kept
        if g.isEmpty():
            break
        if step < ROUNDS:
            order = F.struct("share", F.xxhash64("cls", F.lit(step))) if step else F.struct("share", -F.col("n"), "cls")
            best = g.groupBy("token").agg(F.max_by(F.struct("cls", "n", "rank", "label"), order).alias("c")).select("token", "c.*")
            pairs = best.alias("x").join(g.alias("y"), "token").filter(sizes_fit(t))
        else:
            left = F.count("*").over(Window.partitionBy("cls").orderBy(F.desc("rank")))
            g = checkpoint(g.select("token", "cls", "n", "rank", "label", left.alias("left")))
            forget(kept)
            kept = g
            pairs = g.alias("x").join(g.filter(smaller_fits(t)).alias("y"), "token").filter("x.n > y.n or x.n = y.n and x.cls < y.cls").filter(counts_fit(t))
        pairs = pairs.filter("x.label <> y.label").filter(rank_fits(t)).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = checkpoint(pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        if heads is None:  # tokens of later rounds are among those of the first
            heads = checkpoint(texts.mapInArrow(set_rows("head", bitmap(g, "cls"), lambda x: short_names(x, level, t)), "cls long, head binary"))
        wanted = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("cls")), "cls")
        some = heads.mapInArrow(in_map(wanted), heads.schema).groupBy("cls").agg(F.first("head").alias("head"))
        close = checkpoint(with_both(pairs, some, "head").mapInArrow(heads_meet(t), "a long, b long"))
        if close.isEmpty():
            continue
        # whole sets are the largest table, so only those that passed are written, from the texts again
        both = bitmap(close.select(F.explode(F.array("a", "b")).alias("cls")), "cls")
        sets = checkpoint(texts.mapInArrow(set_rows("tokens", both, lambda x: x), "cls long, tokens binary"))
        full = sets.groupBy("cls").agg(F.first("tokens").alias("tokens"))
        found = checkpoint(with_both(close, full, "tokens").mapInArrow(verify(level, t), "u long, v long"))
        forget(sets)
        links = found if links is None else links.union(found)
        label = checkpoint(components(links))
    forget(kept)
    forget(heads)
    if links is None:
        links = spark.createDataFrame([], "u long, v long")
        label = spark.createDataFrame([], "node long, label long")
    return members, links, label


def least_ids(members: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id of the group, or the row's own."""
    some = members.filter("n_shingles > 0")
    least = some.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return spread_join(members, least, "component", "left").select("doc_id", "n_shingles", own.alias("component_id"))


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sets AS (
  SELECT id, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
tokens AS (SELECT id, unnest(s) AS token FROM sets),
common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM tokens a JOIN tokens b ON a.token = b.token AND a.id <> b.id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sets p ON p.id = x JOIN sets q ON q.id = y WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
reach(id, other) AS (SELECT id, id FROM sets UNION SELECT reach.id, y FROM reach JOIN links ON x = other)
SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN sets s ON s.id = reach.id JOIN sets o ON o.id = other GROUP BY reach.id
"""
