"""Operators on alignments: (family, pos, header, seq) rows of one length per family.

``pos`` is the order of a family; its least row is the reference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import residues as R
from .tables import stored


def reference(aln: DataFrame) -> DataFrame:
    """(family, ref_pos, ref): the first row of each family, by an aggregation."""
    best = aln.groupBy("family").agg(F.min(F.struct("pos", "seq")).alias("x"))
    return best.select("family", F.col("x.pos").alias("ref_pos"), F.col("x.seq").alias("ref"))


def with_reference(aln: DataFrame) -> DataFrame:
    """Rows with the reference of their family; there is one small row for each family, which goes to all tasks,
    as rows dealt by family would be few large groups."""
    return aln.join(F.broadcast(reference(aln)), "family")


def reference_sites(aln: DataFrame) -> DataFrame:
    """(family, site, wt) of the reference, gaps included."""
    return reference(aln).select("family", F.posexplode(R.chars(F.col("ref"))).alias("i", "wt")).select("family", (F.col("i") + 1).alias("site"), "wt")


def sites(aln: DataFrame) -> DataFrame:
    """(family, pos, site, aa), sites from 1."""
    return aln.select("family", "pos", F.posexplode(R.chars(F.col("seq"))).alias("i", "aa")).select("family", "pos", (F.col("i") + 1).alias("site"), "aa")


#: Cells of counts that a task holds before it hands them on.
CELLS, ASCII = 1 << 22, 128


def added_up(batches):
    """Counts of each letter at each site of each family, of as many rows as ``CELLS`` allows."""
    held: dict[str, tuple] = {}

    def rows(kind):
        for family, n in held.values():
            at = np.flatnonzero(n)
            columns = [pa.array([family] * len(at), kind), pa.array(at // ASCII + 1, pa.int32()), pa.array([chr(x) for x in at % ASCII], pa.string()), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["family", "site", "aa", "n"])
        held.clear()

    kind = None
    for b in batches:
        kind, families = b.schema.field("family").type, b.column("family").to_pylist()
        names = np.array([repr(x) for x in families], object)
        points, begin = R.code_points(b.column("seq"))
        size = np.diff(begin)
        site = np.arange(len(points)) - np.repeat(begin[:-1], size)
        distinct, first, which = np.unique(names, return_index=True, return_inverse=True)
        which = np.repeat(which, size)
        order = np.argsort(which, kind="stable") if len(distinct) > 1 else np.arange(len(points))
        ends = np.cumsum(np.bincount(which, minlength=len(distinct)))
        for name, i, x, y in zip(distinct, first, [0, *ends[:-1]], ends, strict=True):
            some = order[x:y]
            some, odd = some[points[some] < ASCII], some[points[some] >= ASCII]
            n = np.bincount(site[some] * ASCII + points[some])
            if name in held:
                old = held[name][1]
                n, old = (n, old) if len(n) > len(old) else (old, n)
                n = n.copy()
                n[: len(old)] += old
            held[name] = families[i], n
            if len(odd):
                columns = [pa.array([families[i]] * len(odd), kind), pa.array(site[odd] + 1, pa.int32()), pa.array([chr(p) for p in points[odd]], pa.string()), pa.array(np.ones(len(odd), np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["family", "site", "aa", "n"])
            if len(held) % 64 == 0 and sum(len(n) for _, n in held.values()) > CELLS:
                yield from rows(kind)
    yield from rows(kind)


def letter_counts(aln: DataFrame) -> DataFrame:
    """(family, site, aa, n) of the letters and gaps that there are; a task adds up its own rows, without a row for each letter."""
    rows = aln.select("family", "seq")
    kind = rows.schema["family"].dataType.simpleString()
    return rows.mapInArrow(added_up, f"family {kind}, site int, aa string, n long").groupBy("family", "site", "aa").agg(F.sum("n").alias("n"))


def site_counts(aln: DataFrame) -> DataFrame:
    """(family, site, aa, n) for all 20 residues at each site; gaps don't count.

    Every site has a letter or a gap, so the grid of 20 rows for a family's site comes from the counts
    themselves, in one pass over the rows.
    """
    each = letter_counts(aln).groupBy("family", "site").agg(F.map_from_entries(F.collect_list(F.struct("aa", "n"))).alias("told"))
    grid = each.select("family", "site", "told", F.explode(F.array(*map(F.lit, R.AMINO_ACIDS))).alias("aa"))
    return grid.select("family", "site", "aa", F.coalesce(F.try_element_at("told", F.col("aa")), F.lit(0)).alias("n"))


def frequencies(aln: DataFrame, pseudocount: float = 0.0) -> DataFrame:
    """Shares of residues at each site, with a pseudocount; null where nothing was counted."""
    n = F.col("n") + pseudocount
    total = F.sum(n).over(Window.partitionBy("family", "site"))
    return site_counts(aln).withColumn("freq", F.when(total > 0, n / total))


def shares(one: pa.Array, two: pa.Array) -> pa.Array:
    """(identity, gaps, both) of the pairs of two columns; ``both`` counts columns of two gaps."""
    (x, at), (y, other) = R.code_points(one), R.code_points(two)
    good = (np.diff(at) == np.diff(other)) & np.asarray(pc.and_(one.is_valid(), two.is_valid()))
    if not good.all():  # only pairs of one length are compared
        (x, at), (y, other) = (R.code_points(c.filter(pa.array(good))) for c in (one, two))
    a, b = x == ord("-"), y == ord("-")
    told = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    n, gaps, both, same = np.diff(at), told(a | b), told(a & b), told((R.upper_points(x) == R.upper_points(y)) & ~(a | b))
    out = np.zeros((3, len(good)))
    out[0, good], out[1, good], out[2, good] = same / np.maximum(n - gaps, 1), gaps / np.maximum(n, 1), both
    known, some = good.copy(), good.copy()
    known[good], some[good] = n > gaps, n > 0
    fields = [pa.array(out[0], mask=~known), pa.array(out[1], mask=~some), pa.array(out[2].astype(np.int64))]
    return pa.StructArray.from_arrays(fields, names=["identity", "gaps", "both"], mask=pa.array(~good))


def pair_statistics(a, b, double_gaps: bool = True):
    """Struct (identity, gaps) of two aligned strings; null if nothing can be compared."""
    s = arrow_udf(shares, "identity double, gaps double, both long")(a, b)
    out = F.when(s.isNotNull(), F.struct(s["identity"].alias("identity"), s["gaps"].alias("gaps")))
    if double_gaps:
        return out
    return F.when(s["both"] > 0, F.raise_error(F.lit("both sequences have a gap")).cast("struct<identity:double,gaps:double>")).otherwise(out)


def glycan_sites(aln: DataFrame) -> DataFrame:
    """(family, pos, site0): starts of N-X-[ST], X not P, over gaps; 0-based, gaps counted."""
    # what stands between the starts; only these are looked at, a row is not taken apart
    parts = aln.select("family", "pos", F.split("seq", "N(?=-*[^P-]-*[ST])", -1).alias("parts")).filter(F.size("parts") > 1)
    starts = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.aggregate(F.slice("parts", F.lit(1), i), i - 1, lambda n, x: n + F.length(x)))
    return parts.select("family", "pos", F.explode(starts).alias("site0"))


def corresponding_residues(aln: DataFrame) -> DataFrame:
    """(family, pos, ref_i, seq_i): ungapped 0-based indices of the reference and of each row;
    seq_i is null at its gaps.

    A residue's index is told from the letters before it, so nothing is sorted or dealt by row.
    """
    refs = reference(aln).select("family", F.col("ref"), F.posexplode(R.chars(F.col("ref"))).alias("i", "b")).filter("b <> '-'")
    before = lambda c: F.length(F.replace(F.substring(c, F.lit(1), F.col("site")), F.lit("-"), F.lit(""))) - 1
    refs = refs.withColumn("site", F.col("i") + 1).select("family", "site", before(F.col("ref")).alias("ref_i"))
    rows = aln.select("family", "pos", "seq", F.instr("seq", "-").alias("gap"))
    index = F.when((F.col("gap") == 0) | (F.col("site") < F.col("gap")), F.col("site") - 1).otherwise(before(F.col("seq")))
    letter = F.substring(F.col("seq"), F.col("site"), F.lit(1))
    return rows.join(F.broadcast(refs), "family").select("family", "pos", F.col("ref_i").cast("int"), F.when((letter != "-") & (letter != ""), index).cast("int").alias("seq_i"))


def first_of_each(aln: DataFrame) -> DataFrame:
    """The first row of each distinct sequence of a family, in upper case."""
    up = aln.withColumn("seq", F.upper("seq"))
    best = up.groupBy("family", "seq").agg(F.min(F.struct("pos", "header")).alias("x"))
    return best.select("family", F.col("x.pos").alias("pos"), F.col("x.header").alias("header"), "seq")


def duplicate_pairs(aln: DataFrame) -> DataFrame:
    """(family, pos, header, first_pos, first_header): rows that ``first_of_each`` leaves out, with the
    one that is kept in their place."""
    kept = first_of_each(aln).select("family", F.col("seq").alias("up"), F.col("pos").alias("first_pos"), F.col("header").alias("first_header"))
    both = aln.withColumn("up", F.upper("seq")).join(kept, ["family", "up"])
    return both.filter("pos <> first_pos").select("family", "pos", "header", "first_pos", "first_header")


def screen(aln: DataFrame, least_identity: float, most_gaps: float) -> DataFrame:
    """Rows that are like enough to the reference of their family."""
    s = pair_statistics(F.col("seq"), F.col("ref"))
    return with_reference(aln).withColumn("s", s).filter((F.col("s.identity") >= least_identity) & (F.col("s.gaps") <= most_gaps)).drop("s", "ref", "ref_pos")


def without(aln: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose (family, header) is not among ``names``: an outgroup, say."""
    return aln.join(names, ["family", "header"], "left_anti")


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct sequences of two sources: the first wins, in it the last header, else the first."""
    one = first.groupBy("family", "seq").agg(F.max(F.struct("pos", "header")).alias("x"), F.lit(0).alias("source"))
    two = second.groupBy("family", "seq").agg(F.min(F.struct("pos", "header")).alias("x"), F.lit(1).alias("source"))
    both = one.unionByName(two).groupBy("family", "seq").agg(F.min_by("x", "source").alias("x"), F.min("source").alias("source"))
    return both.select("family", "seq", F.col("x.pos").alias("pos"), F.col("x.header").alias("header"), "source")


def sampled(aln: DataFrame, most: int = 100) -> DataFrame:
    """At most ``most`` rows of each family, those with the least digests of their headers."""
    w = Window.partitionBy("family").orderBy(F.md5("header"), "pos")
    return aln.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")


def family_identity(aln: DataFrame, most: int = 100) -> DataFrame:
    """(family, within, to_ref): mean identities of sampled rows with each other and the reference."""
    s = sampled(aln, most)
    a, b = s.select("family", "pos", "seq"), s.select("family", F.col("pos").alias("pos2"), F.col("seq").alias("seq2"))
    within = a.join(b, "family").filter("pos < pos2").groupBy("family").agg(F.avg(pair_statistics(F.col("seq"), F.col("seq2"))["identity"]).alias("within"))
    to_ref = s.join(reference(aln), "family").groupBy("family").agg(F.avg(pair_statistics(F.col("seq"), F.col("ref"))["identity"]).alias("to_ref"))
    return to_ref.join(within, "family", "left").select("family", "within", "to_ref")


#: Rows of a family that one task of ``central`` compares with the family's counts.
COMPARED = 10_000


def central(aln: DataFrame) -> DataFrame:
    """(family, pos, mean_differences): the row with the least mean Hamming distance to the others.

    The distances of a row to all others add up over sites, so counts by site give them without
    comparing pairs; X differs from everything, and equal means go to the first row.  The counts of a
    family are one row, with a small map for each site, so the rows aren't taken apart again.  Counts of a large
    family are handed to several tasks, each with a part of its rows.
    """
    total = aln.groupBy("family").agg(F.count("*").alias("m"))
    counts = letter_counts(aln)
    by_site = counts.groupBy("family", "site").agg(F.map_from_entries(F.collect_list(F.struct("aa", "n"))).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("site", "n")), lambda x, y: x["site"] - y["site"])
    parts = F.ceil(F.col("m") / COMPARED).cast("int")
    each = by_site.groupBy("family").agg(listed.alias("x")).join(total, "family").select("family", F.col("x.n").alias("counts"), "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    # one row for so many rows of the table at least
    large = total.filter(parts > 1).select("family", parts.alias("parts"))
    told = aln.filter(F.length("seq") > 0).join(F.broadcast(large), "family", "left")
    told = told.select("family", F.pmod(F.xxhash64("pos"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "pos", "seq").join(each, ["family", "part"])
    told = told.withColumn("aa", R.chars(F.col("seq")))
    shared = F.zip_with("aa", F.slice("counts", F.lit(1), F.size("aa")), lambda a, n: F.when(a == "X", F.lit(0).cast("long")).otherwise(F.element_at(n, a) - 1))
    same = F.aggregate(shared, F.lit(0).cast("long"), lambda s, x: s + x)
    mean = told.select("family", "part", "pos", F.when(F.col("m") > 1, F.size("aa") - same / (F.col("m") - 1)).otherwise(0.0).alias("d"))
    best = mean.groupBy("family", "part").agg(F.min(F.struct("d", "pos")).alias("x")).groupBy("family").agg(F.min("x").alias("x"))
    return best.select("family", F.col("x.pos").alias("pos"), F.col("x.d").alias("mean_differences"))


#: Letters from which a row is looked for by its first ones, bits of the map of what is looked for, letters named at once.
WORD, MAP_BITS, NAMED = 12, 1 << 27, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def head_size(n: np.ndarray) -> np.ndarray:
    """Letters by which a row of ``n`` is looked for: all if they are fewer than ``WORD``, else that times a power of two."""
    high = np.floor(np.log2(np.maximum(n // WORD, 1))).astype(np.int64)
    return np.where(n < WORD, n, WORD << high)


class Windows:
    """64-bit names of the windows of some rows' letters, by family."""

    def __init__(self, letters: pa.Array, family: np.ndarray):
        self.points, begin = R.code_points(letters)
        self.begin, self.size = begin - begin[0], np.diff(begin)
        self.row, self.family = np.repeat(np.arange(len(self.size)), self.size), family.astype(np.uint64)
        power = np.full(len(self.points) + 1, BASE)
        power[0] = 1
        self.back = np.cumprod(np.concatenate([power[:1], np.full(len(self.points), pow(int(BASE), -1, 1 << 64), np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:-1])])

    def named(self, at: np.ndarray, w, row: np.ndarray) -> np.ndarray:
        """Of windows of ``w`` letters from ``at`` on."""
        x = (self.sums[at + w] - self.sums[at]) * self.back[at] + self.family[row] + np.asarray(w).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))).view(np.int64)

    def inside(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, starts and rows of all windows of ``w`` letters of longer rows."""
        at = np.flatnonzero((np.arange(len(self.points)) + w <= self.begin[self.row + 1]) & (self.size[self.row] > w))
        return self.named(at, w, self.row[at]), at, self.row[at]


def cut(batches):
    """Batches of rows that have ``NAMED`` letters together, or one row of more."""
    for b in batches:
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(b.column("letters")), 0).to_numpy(zero_copy_only=False))])
        k = 0
        while k < b.num_rows:
            end = max(k + 1, int(np.searchsorted(size, size[k] + NAMED, "right")) - 1)
            yield b.slice(k, end - k)
            k = end


def heads(batches):
    """What each row is looked for by."""
    for b in cut(batches):
        x = Windows(b.column("letters"), b.column("h").to_numpy())
        w = head_size(x.size)
        name = x.named(x.begin[:-1], w, np.arange(b.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(name), b.column("uid"), pa.array(x.size.astype(np.int32)), pa.array(w)], names=["key", "uid", "n", "w"])


def looked_for(sizes: list[int], wanted: np.ndarray):
    """Windows of longer rows with names that the map has; of those of fewer letters than ``WORD`` one of each name."""

    def run(batches):
        for b in cut(batches):
            x, family = Windows(b.column("letters"), b.column("h").to_numpy()), b.column("family")
            for w in sizes:
                name, at, row = x.inside(w)
                spot = np.mod(name, MAP_BITS)
                keep = np.flatnonzero((wanted[spot // 64] >> (spot % 64)) & 1)
                if w < WORD:
                    keep = keep[np.unique(name[keep], return_index=True)[1]]
                name, at, row = name[keep], at[keep], row[keep]
                text = pa.array(["".join(map(chr, x.points[i : i + w])) for i in at], pa.string()) if w < WORD else pa.nulls(len(at), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(name), b.column("uid").take(pa.array(row)), pa.array(x.size[row].astype(np.int32)), family.take(pa.array(row)), text], names=["key", "uid", "n", "family", "letters"])

    return run


def contained(aln: DataFrame) -> DataFrame:
    """Rows whose letters, gaps left out, aren't part of a longer kept row of the family.

    An order-free form of the containment filter: a row goes if its letters are a proper part of
    another row's, or equal an earlier row's.  A row is looked for by its first letters among the windows of longer rows,
    and a map of fixed size tells which windows may be meant, so that others aren't shuffled; pairs that meet
    are compared.  Of rows of fewer than ``WORD`` letters it is enough to know that there is such a window.
    """
    bare = aln.withColumn("letters", F.regexp_replace("seq", "-", ""))
    # 128 bits in place of the letters as a key
    one = bare.groupBy("family", F.xxhash64("letters").alias("h1"), F.xxhash64(F.lit(1), "letters").alias("h2")).agg(F.min(F.struct("pos", "header", "seq")).alias("x"))
    u = one.select("family", "x.*").withColumn("uid", F.monotonically_increasing_id()).withColumn("letters", F.regexp_replace("seq", "-", ""))
    u = stored(u.withColumn("h", F.xxhash64("family")))
    short = u.select("family", "uid", "letters", "h")
    family = u.schema["family"].dataType.simpleString()
    parts = short.mapInArrow(heads, "key long, uid long, n int, w long")
    sizes = sorted(r[0] for r in parts.select("w").distinct().collect())
    spot = F.pmod("key", F.lit(MAP_BITS))
    words = parts.groupBy((spot / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("v")).toPandas()
    wanted = np.zeros(MAP_BITS // 64, np.int64)
    wanted[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    found = lambda some: short.mapInArrow(looked_for(some, wanted), f"key long, uid long, n int, family {family}, letters string")
    inside = found([w for w in sizes if w < WORD]).select("family", "letters").distinct()
    gone = u.filter(F.length("letters") < WORD).join(inside, ["family", "letters"], "left_semi").select("uid")
    holders = found([w for w in sizes if w >= WORD]).select("key", F.col("uid").alias("b"), F.col("n").alias("nb"))
    met = parts.filter(F.col("w") >= WORD).select("key", F.col("uid").alias("a"), F.col("n").alias("na")).join(holders, "key").filter("na < nb").select("a", "b").distinct()
    met = stored(met)
    text = lambda k: u.select(F.col("uid").alias(k), F.col("family").alias(f"family_{k}"), F.col("letters").alias(f"text_{k}"))
    held = met.join(text("a"), "a").join(text("b"), "b").filter("family_a = family_b").filter(F.col("text_b").contains(F.col("text_a")))
    gone = stored(gone.unionByName(held.select(F.col("a").alias("uid")).distinct()))
    return u.join(gone, "uid", "left_anti").select("family", "pos", "header", "seq")
