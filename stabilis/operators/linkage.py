"""Single-linkage clusters of sequences at thresholds of identity and coverage.

Two sequences are linked if the edits that align them (substitutions, and one for each letter
against a gap) are at most ``1 - identity`` of the longer one's letters, and the shorter one has
``coverage`` of these letters at least.  Clusters are what links connect.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components
from .tables import dropped, stored


def thousandths(share: float) -> int:
    return round(share * 1000)


def edits(n: Column, identity: float) -> Column:
    """Edits that a sequence of ``n`` letters may have to one that is no longer."""
    return F.floor(n * (1000 - thousandths(identity)) / 1000).cast("int")


def pieces(rows: DataFrame, starts: Column | None = None) -> DataFrame:
    """``rows`` with the key of each piece of a text of ``m`` letters that is cut into ``t + 1`` even
    ones; ``starts``, in terms of a piece's number ``i``, place ``p`` and width ``w``, says where
    in ``letters`` it is looked for."""
    short = F.col("t") + 1 - F.col("m") % (F.col("t") + 1)
    base = F.expr("int(m div (t + 1))")
    cut = rows.withColumn("i", F.explode(F.sequence(F.lit(0), "t")))
    cut = cut.withColumn("p", F.col("i") * base + F.greatest(F.lit(0), F.col("i") - short)).withColumn("w", base + (F.col("i") >= short).cast("int"))
    cut = cut.withColumn("at", F.col("p") if starts is None else F.explode(starts))
    return cut.withColumn("key", F.xxhash64("family", "m", "t", "i", F.substring("letters", F.col("at") + 1, F.col("w"))))


def candidates(seqs: DataFrame, identity: float, coverage: float) -> DataFrame:
    """(a, b), a the shorter one: pairs of (uid, family, letters, n) rows that may be linked, where b may have two edits or more.

    A text cut into one piece more than there are edits has a piece in common with the other,
    shifted by no more than the edits on either side of it allow (Pass-Join: Li, Deng, Wang and
    Feng, 2011), so pieces are joined and not all pairs; every such linked pair is among them.
    """
    n = F.col("n")
    longest = edits(F.expr(f"int(n * 1000 div {thousandths(identity)})"), identity)
    cut = seqs.withColumn("m", n).filter(longest >= 2).withColumn("t", F.explode(F.sequence(F.greatest(F.lit(2), edits(n, identity)), longest)))
    index = pieces(cut).select("key", F.col("uid").alias("a"), F.col("n").alias("na"))
    least = F.ceil(n * thousandths(coverage) / 1000).cast("int")
    probe = seqs.withColumn("t", edits(n, identity)).filter("t >= 2").withColumn("m", F.explode(F.sequence(F.least(n, F.greatest(n - F.col("t"), least)), n)))
    shift, after = n - F.col("m"), F.col("t") - F.col("i")
    low = F.greatest(F.col("p") - F.col("i"), F.col("p") + shift - after, F.lit(0))
    high = F.least(F.col("p") + F.col("i"), F.col("p") + shift + after, n - F.col("w"))
    found = pieces(probe, F.when(low <= high, F.sequence(low, high))).select("key", F.col("uid").alias("b"), F.col("n").alias("nb"))
    return index.join(found, "key").filter("na < nb or na = nb and a < b").select("a", "b").distinct()


def linked(seqs: DataFrame, identity: float, coverage: float) -> DataFrame:
    """(a, b): the linked ones of the candidates."""
    text = lambda k: seqs.select(F.col("uid").alias(k), F.col("letters").alias(f"text_{k}"))
    both = candidates(seqs, identity, coverage).join(text("a"), "a").join(text("b"), "b")
    both = both.withColumn("t", edits(F.length("text_b"), identity))
    close = F.expr("levenshtein(text_a, text_b, t)") >= 0
    return both.filter(close & (F.length("text_a") * 1000 >= F.length("text_b") * thousandths(coverage))).select("a", "b")


def company(rows: DataFrame, identity: float, coverage: float) -> DataFrame:
    """(k, h, g, uid, family, first, rows, rest, long, short): rows that share an end of ``w`` letters with unlike ones, equal ones counted as one.

    They are those of one edit at most.  ``w`` is a half of the shortest text that may have one, so of two linked ones
    both ends can't be touched by it: they share one, ``k``, and differ by one edit in the ``rest``.  A row may
    be the ``long`` or equal one of a pair, or the ``short`` one.
    """
    n = F.length("letters")
    w = -(-1000 // (1000 - thousandths(identity))) // 2
    long = edits(n, identity) == 1
    short = (edits(n + 1, identity) == 1) & (n * 1000 >= (n + 1) * thousandths(coverage))
    end = lambda i, part, rest: F.struct(F.xxhash64("family", F.lit(i), part).alias("k"), rest.alias("rest"))
    ends = F.array(end(0, F.substring("letters", 1, w), F.substring("letters", w + 1, 2**31 - 1)), end(1, F.substring("letters", -w, w), F.left("letters", n - w)))
    cut = rows.select("family", "pos", "h", "g", "uid", long.alias("long"), short.alias("short"), ends.alias("ends")).filter("long or short")
    cut = cut.select("*", F.explode("ends").alias("end")).select("*", "end.*").drop("ends", "end")
    like = Window.partitionBy("k")
    unlike = lambda c: F.min(c).over(like) < F.max(c).over(like)
    some = cut.withColumn("unlike", unlike("h") | unlike("g")).filter("unlike")
    same = [F.any_value(c).alias(c) for c in ("family", "rest", "long", "short")]
    return some.groupBy("k", "h", "g").agg(F.min("uid").alias("uid"), F.min("pos").alias("first"), F.count("*").alias("rows"), *same)


def linked_by_one(some: DataFrame) -> DataFrame:
    """(u, v) that connect those rows of ``company`` that one edit links.

    Two rows that differ at one place are equal without it, and a row that lacks a letter equals the other one without it.
    So rows meet by what is left without each letter in turn, and its place; all that meet are linked, and each is
    linked to the least one only.  Rows that share an end aren't compared in pairs, so many of them are no more work each.
    """
    at = some.select("k", "uid", "rest", "long", "short", F.explode(F.sequence(F.lit(1), F.length("rest") + 1)).alias("i"))
    without = F.when(F.col("long") & (F.col("i") <= F.length("rest")), F.concat(F.left("rest", F.col("i") - 1), F.substring("rest", F.col("i") + 1, F.length("rest"))))
    told = at.select("k", "uid", "i", F.explode(F.array(without, F.when(F.col("short"), F.col("rest")))).alias("left")).filter("left is not null")
    # 128 bits in place of the letters as a key
    told = told.select("uid", F.xxhash64("k", "i", "left").alias("x"), F.xxhash64(F.lit(1), "k", "i", "left").alias("y"))
    stars = told.select("uid", F.min("uid").over(Window.partitionBy("x", "y")).alias("least"))
    return stars.filter("least < uid").select(F.col("least").alias("u"), F.col("uid").alias("v")).distinct()


def single_linkage(seqs: DataFrame, identity: float = 0.9, coverage: float = 0.9) -> DataFrame:
    """(family, pos, cluster, size) for (family, pos, seq) rows.

    Gaps and case don't count.  ``cluster`` is the least ``pos`` of a cluster and ``size`` its rows;
    clusters don't cross families.  Equal sequences are one from the start.  ``identity`` is 0.5 or
    more; both thresholds are read in thousandths.
    """
    if not 0.5 <= identity <= 1 or not 0 <= coverage <= 1:
        raise ValueError("identity is within 0.5 and 1, coverage within 0 and 1")
    rows = seqs.filter("family is not null").select("family", "pos", F.upper(F.regexp_replace(F.coalesce("seq", F.lit("")), "-", "")).alias("letters"))
    # 128 bits in place of the letters as a key
    rows = rows.withColumn("h", F.xxhash64("letters")).withColumn("g", F.xxhash64(F.lit(1), "letters"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()))
    kinds = rows.groupBy("family", "h", "g").agg(F.min("uid").alias("uid"), F.min("pos").alias("first"), F.count("*").alias("rows"))
    known = ["family", "h", "g", "first", "rows"]
    least, most = rows.agg(F.min(edits(F.length("letters") + 1, identity)), F.max(edits(F.length("letters"), identity))).first()
    nodes, edges, done = [], [], []
    if most and least < 2:
        near = stored(company(rows, identity, coverage))
        done.append(near)
        nodes.append(near.select("uid", *known))
        edges.append(linked_by_one(near))
    if most and most > 1:
        far = stored(rows.select("uid", "letters").join(kinds, "uid").withColumn("n", F.length("letters")))
        done.append(far)
        nodes.append(far.select("uid", *known))
        edges.append(linked(far, identity, coverage).select(F.col("a").alias("u"), F.col("b").alias("v")))
    # most rows are alone: only equal and linked ones are told their clusters
    told = kinds.filter("rows > 1").select(*known, F.col("first").alias("cluster"), F.col("rows").alias("size"))
    if edges:
        links = stored(reduce(DataFrame.unionByName, edges))
        label = components(links)
        met = stored(label.join(reduce(DataFrame.unionByName, nodes).dropDuplicates(["uid"]).withColumnRenamed("uid", "node"), "node"))
        done += [links, label, met]
        group = met.groupBy("label").agg(F.min("first").alias("cluster"), F.sum("rows").alias("size"))
        met = met.join(group, "label").select(*known, "cluster", "size")
        told = told.join(met, ["family", "h", "g"], "left_anti").unionByName(met)
    told = stored(told.drop("first", "rows"))
    dropped(*done)
    out = rows.select("family", "pos", "h", "g").join(told, ["family", "h", "g"], "left")
    return out.select("family", "pos", F.coalesce("cluster", "pos").alias("cluster"), F.coalesce("size", F.lit(1)).alias("size"))
