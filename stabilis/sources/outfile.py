"""Output files of tree programs: sequences of tips and reconstructed ones of interior nodes.

Such a file has, among other text, two sections of interleaved blocks.  The first is headed ``Name`` and
``Sequences``, with a line of dashes; it has the tips, dots where a letter is the first tip's, and ends at
two empty lines.  The second is headed ``Probable sequences at interior nodes:`` and lists all
nodes, letters in lower case where they are less sure.  Names hold no spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators.ancestral import named_interiors
from .text import records

TIPS, DASHES = r"^Name\s+Sequences\s*$", r"^----\s+---------\s*$"
INNER, COLUMNS = "Probable sequences at interior nodes:", r"^\s*node\s+Reconstructed sequence"
#: Letters in a line, and in a group of them.
LINE, GROUP = 60, 10


def failed(text: str, kind: str = "string"):
    return F.raise_error(F.concat(F.lit(f"{text}: "), F.col("file"))).cast(kind)


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, section, block, name, part): lines of both sections, blocks numbered within a file."""
    lines = records(spark, path, "\n").withColumn("value", F.regexp_replace("value", "\r", ""))
    heads = lines.groupBy("file").agg(
        F.min(F.when(F.col("value").rlike(TIPS), F.col("pos"))).alias("tips"),
        F.min(F.when(F.trim("value") == INNER, F.col("pos"))).alias("inner"),
        F.min(F.when(F.col("value").rlike(DASHES), F.col("pos"))).alias("dashes"),
        F.min(F.when(F.col("value").rlike(COLUMNS), F.col("pos"))).alias("columns"),
    )
    good = (F.col("tips") < F.col("dashes")) & (F.col("dashes") < F.col("inner")) & (F.col("inner") < F.col("columns"))
    heads = heads.withColumn("tips", F.when(good, F.col("tips")).otherwise(failed("no sequences of tips and interior nodes", "bigint")))
    inside = lines.join(heads, "file").filter("pos > dashes and pos < inner or pos > columns").withColumn("section", F.when(F.col("pos") < F.col("inner"), "tip").otherwise("interior"))
    order = Window.partitionBy("file", "section").orderBy("pos")
    empty = F.trim("value") == ""
    begins = (~empty & F.coalesce(F.trim(F.lag("value").over(order)) == "", F.lit(True))).cast("int")
    ends = (empty & F.coalesce(F.trim(F.lag("value").over(order)) == "", F.lit(False)) & (F.col("section") == "tip")).cast("int")
    told = inside.withColumn("block", F.sum(begins).over(order)).withColumn("over", F.sum(ends).over(order))
    told = told.filter(~empty & (F.col("over") == 0)).withColumn("line", F.trim("value"))
    part = F.regexp_replace(F.regexp_replace("line", r"^\S+", ""), r"\s", "")
    return told.select("file", "pos", "section", "block", F.regexp_extract("line", r"^(\S+)", 1).alias("name"), part.alias("part"))


def read_outfile(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(file, kind, place, name, seq): tips and interior nodes of each file, numbered in its order.

    A name that comes twice in a block, rows of unequal lengths, or interior nodes that aren't one fewer than the tips are
    an error.
    """
    parts = sections(spark, path)
    rows = parts.groupBy("file", "section", "name").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("x"), F.min("pos").alias("pos"))
    once = F.size("x") == F.size(F.array_distinct("x.block"))
    rows = rows.withColumn("seq", F.when(once, F.array_join("x.part", "")).otherwise(failed("a name twice in a block")))
    tips, inner = rows.filter("section = 'tip'"), rows.filter("section = 'interior'")
    first = tips.groupBy("file").agg(F.min_by("seq", "pos").alias("first"), F.count("*").alias("n"))
    tips = tips.join(first, "file").withColumn("seq", R.remove_dots(F.col("seq"), F.col("first"))).select("file", F.lit("tip").alias("kind"), "pos", "name", "seq")
    inner = inner.join(tips.select("file", "name"), ["file", "name"], "left_anti").select("file", F.lit("interior").alias("kind"), "pos", "name", F.upper("seq").alias("seq") if upper else "seq")
    every = tips.unionByName(inner)
    sizes = every.groupBy("file").agg((F.min(F.length("seq")) == F.max(F.length("seq"))).alias("even"), F.count_if(F.col("kind") == "tip").alias("n"), F.count_if(F.col("kind") == "interior").alias("m"))
    good = F.col("even") & (F.col("m") == F.col("n") - 1)
    place = F.row_number().over(Window.partitionBy("file", "kind").orderBy("pos"))
    out = every.withColumn("place", place).join(sizes, "file")
    return out.select("file", "kind", "place", "name", F.when(good, F.col("seq")).otherwise(failed("rows of unequal length or a wrong number of interior nodes")).alias("seq"))


def with_sequences(nodes: DataFrame, rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``nodes`` (as of ``trees.nodes``) with name and ``seq`` from ``rows`` (tree_id, kind, place, name, seq).

    Tips are found by name, interior nodes by their order, left before right from the root.
    ``names``: (name, new_name) renames tips; a tip without a row, or without a new name, is an error.
    """
    tips = rows.filter("kind = 'tip'").select("tree_id", "name", "seq")
    inner = rows.filter("kind = 'interior'").select("tree_id", "place", F.col("name").alias("new_name"), "seq")
    told = nodes.filter("is_tip").join(tips, ["tree_id", "name"], "left")
    bad = F.raise_error(F.concat(F.lit("no sequence or name for "), F.col("name"))).cast("string")
    told = told.withColumn("seq", F.coalesce("seq", bad))
    if names is not None:
        told = told.join(names, "name", "left").withColumn("name", F.coalesce("new_name", bad)).drop("new_name")
    low = nodes.filter("not is_tip").join(named_interiors(nodes), ["tree_id", "node_id"]).join(inner, ["tree_id", "place"], "left")
    low = low.withColumn("name", F.col("new_name")).drop("place", "new_name")
    return told.unionByName(low.select(*told.columns))


def write_outfile(nodes: DataFrame, path: str) -> None:
    """One file for each tree, in a folder ``tree_id=...`` of ``path``; ``nodes`` have a ``seq`` each.

    Tips come in the order of their numbers; a name of a tip of over ten letters or with a space is an error.
    """
    good = (F.length("name") <= 10) & ~F.col("name").contains(" ")
    tip = F.when(good, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("a name that doesn't fit: "), "name")).cast("string"))
    first = nodes.filter("is_tip").groupBy("tree_id").agg(F.min_by("seq", "tip_no").alias("first"), F.min("tip_no").alias("lead"))
    tips = nodes.filter("is_tip").join(first, "tree_id").withColumn("seq", F.when(F.col("tip_no") == F.col("lead"), F.col("seq")).otherwise(R.add_dots(F.col("seq"), F.col("first"))))
    rows = tips.select("tree_id", F.lit(1).alias("k"), F.col("tip_no").alias("n"), F.rpad(tip, 10, " ").alias("head"), "seq")
    inner = nodes.filter("not is_tip").join(named_interiors(nodes), ["tree_id", "node_id"])
    low = inner.select("tree_id", F.lit(3).alias("k"), F.col("place").alias("n"), F.concat(F.lpad(F.col("place").cast("string"), 6, " "), F.lit("    ")).alias("head"), "seq")
    rows = rows.unionByName(low).withColumn("b", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("seq") / LINE).cast("int")) - 1)))
    chunk = F.substring(F.col("seq"), F.col("b") * LINE + 1, F.lit(LINE))
    grouped = F.trim(F.regexp_replace(chunk, f"(.{{{GROUP}}})", "$1 "))
    body = rows.select("tree_id", "k", "b", "n", F.concat("head", F.lit(" "), grouped).alias("value"))
    empty = rows.select("tree_id", "k", "b", F.lit(1 << 30).alias("n"), F.lit("").alias("value")).distinct()
    told = [(0, 0, "Name" + " " * 37 + "Sequences"), (0, 1, "----" + " " * 37 + "---------"), (0, 2, ""), (2, 0, ""), (2, 1, INNER), (2, 2, ""), (2, 3, "  node                    Reconstructed sequence (caps if > 0.95)"), (2, 4, "")]
    heads = nodes.select("tree_id").distinct().withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(0).alias("b"), F.lit(n).alias("n"), F.lit(v).alias("value")) for k, n, v in told)))).select("tree_id", "x.*")
    lines = body.unionByName(empty).unionByName(heads).repartition("tree_id").sortWithinPartitions("tree_id", "k", "b", "n")
    lines.select("tree_id", "value").write.partitionBy("tree_id").text(path)
