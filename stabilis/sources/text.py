"""Sequence, alignment and stability files as DataFrames, read and written by Spark's text source.

Records keep their order in ``pos``, the place of their first line in their file.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, pos, value): what stands between separators, in the order of each file.

    The order is that of Spark's splits of a file, which its rows' numbers keep.
    """
    rows = spark.read.option("lineSep", sep).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, header, seq) of FASTA files; an empty sequence or a text before a header is an
    error.  A record is a split of the text at ``newline >``."""
    r = records(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "\r", "")).filter(F.trim("value") != "")
    head = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "^>", ""))
    body = F.regexp_replace(F.substring(F.col("value"), F.length(F.substring_index("value", "\n", 1)) + 2, F.length("value")), r"\s", "")
    checked = F.when(body != "", body).otherwise(F.raise_error(F.concat(F.lit("empty sequence: "), head)).cast("string"))
    return r.select("file", "pos", head.alias("header"), checked.alias("seq"))


def fasta_text(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def write_fasta(seqs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of FASTA text in the order of ``pos``."""
    seqs.orderBy("pos").select(fasta_text(F.col("header"), F.col("seq")).alias("value")).write.mode(mode).text(path)


def entries(seqs: DataFrame, wanted: DataFrame, substring: bool = False) -> DataFrame:
    """Records of requested (place, name) rows; a name is the first word of a header.

    Each request needs exactly one match; with ``substring`` it may be a part of the name.
    """
    named = seqs.withColumn("_n", F.regexp_extract("header", r"^(\S*)", 1))
    on = F.col("_n").contains(F.col("name")) if substring else F.col("_n") == F.col("name")
    found = wanted.join(named, on, "left")
    count = found.groupBy("place", "name").agg(F.count("header").alias("m"), F.first("header").alias("header"), F.first("seq").alias("seq"))
    ok = F.when(F.col("m") == 1, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("not exactly one record: "), "name")).cast("string"))
    return count.select("place", "name", "header", ok.alias("seq"))


def by_header(seqs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(place, header, seq): the first record of each requested (place, header), or an error.

    With the headers of an input as requests, this puts an aligner's output into their order.
    """
    first = seqs.groupBy("header").agg(F.min(F.struct("pos", "seq")).alias("x"))
    seq = F.when(F.col("x").isNotNull(), F.col("x.seq")).otherwise(F.raise_error(F.concat(F.lit("no record: "), "header")).cast("string"))
    return wanted.join(first, "header", "left").select("place", "header", seq.alias("seq"))


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, header, seq) of sequential files: names in the first ten columns."""
    r = records(spark, path, "\n").filter(F.trim("value") != "")
    head = F.min("pos").over(Window.partitionBy("file"))
    r = r.withColumn("_h", head).filter("pos > _h")
    return r.select("file", "pos", F.trim(F.substring("value", 1, 10)).alias("header"), F.regexp_replace(F.substring(F.col("value"), F.lit(11), F.length("value")), r"\s", "").alias("seq"))


def phylip_records(aln: DataFrame, *by: str) -> DataFrame:
    """(*by, k, pos, value): heading and rows of the alignment of each group; a name of over ten
    letters is an error."""
    name = F.when(F.length("header") <= 10, F.col("header")).otherwise(F.raise_error(F.concat(F.lit("name too long: "), "header")).cast("string"))
    head = aln.groupBy(*by).agg(F.lit(0).alias("k"), F.lit(0).cast("long").alias("pos"), F.format_string("%d %d", F.count("*"), F.max(F.length("seq"))).alias("value"))
    return head.unionByName(aln.select(*by, F.lit(1).alias("k"), F.col("pos").cast("long"), F.concat(F.rpad(name, 10, " "), "seq").alias("value")))


def phylip_lines(aln: DataFrame) -> DataFrame:
    """The lines of one alignment, for a text sink."""
    return phylip_records(aln).orderBy("k", "pos").select("value")


def write_phylip(aln: DataFrame, path: str) -> None:
    """One PHYLIP file for each family, in a folder ``family=...`` of ``path``."""
    lines = phylip_records(aln, "family").repartition("family").sortWithinPartitions("family", "k", "pos")
    lines.select("family", "value").write.partitionBy("family").text(path)


def read_ddgs(spark: SparkSession, path: str) -> DataFrame:
    """(file, r, wt, mut, ddg) of stability files: two lines of heading, then code and value.

    Two wild types of a residue, two values of a mutation, or a line that is no code and value
    (a number or None) are an error; empty lines are passed over.
    """
    first = F.min("pos").over(Window.partitionBy("file"))
    r = records(spark, path, "\n").withColumn("_first", first).filter("pos > _first + 1 and trim(value) <> ''").withColumn("p", F.split(F.trim("value"), r"\s+"))
    good = (F.size("p") == 2) & F.col("p")[0].rlike(r"^[A-Z]-?\d+[A-Z]$") & ((F.get("p", F.lit(1)) == "None") | F.expr("try_cast(get(p, 1) as double)").isNotNull())
    r = r.withColumn("p", F.when(good, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not a mutation and its value: "), "value")).cast("array<string>")))
    code = lambda i: F.regexp_extract(F.col("p")[0], r"^([A-Z])(-?\d+)([A-Z])$", i)
    out = r.select("file", code(2).cast("int").alias("r"), code(1).alias("wt"), code(3).alias("mut"), F.expr("try_cast(p[1] as double)").alias("ddg"))
    one = Window.partitionBy("file", "r")
    bad = (F.min("wt").over(one) != F.max("wt").over(one)) | (F.count("*").over(Window.partitionBy("file", "r", "mut")) > 1)
    return out.withColumn("_bad", bad).select("file", "r", "wt", F.when(~F.col("_bad"), F.col("mut")).otherwise(F.raise_error(F.lit("residue or mutation given twice")).cast("string")).alias("mut"), "ddg")


def ddg_lines(ddg: DataFrame, heading: str) -> DataFrame:
    """The lines of one stability file, in order of residue and mutation."""
    spark = ddg.sparkSession
    head = spark.createDataFrame([(0, 0, "", heading), (0, 1, "", "MUTATION\tDDG")], "k int, r int, mut string, value string")
    value = F.when(F.col("ddg").isNull(), F.lit("None")).otherwise(F.format_string("%.6f", "ddg"))
    body = ddg.select(F.lit(1).alias("k"), "r", "mut", F.concat("wt", F.col("r").cast("string"), "mut", F.lit("\t"), value).alias("value"))
    return head.unionByName(body).orderBy("k", "r", "mut").select("value")


def write_ddgs(ddg: DataFrame, path: str, heading: str) -> None:
    """One stability file for each family, in a folder ``family=...`` of ``path``."""
    value = F.when(F.col("ddg").isNull(), F.lit("None")).otherwise(F.format_string("%.6f", "ddg"))
    body = ddg.select("family", F.lit(1).alias("k"), "r", "mut", F.concat("wt", F.col("r").cast("string"), "mut", F.lit("\t"), value).alias("value"))
    titles = F.posexplode(F.array(F.lit(heading), F.lit("MUTATION\tDDG"))).alias("r", "value")
    head = ddg.select("family").distinct().select("family", F.lit(0).alias("k"), titles).select("family", "k", "r", F.lit("").alias("mut"), "value")
    lines = head.unionByName(body).repartition("family").sortWithinPartitions("family", "k", "r", "mut")
    lines.select("family", "value").write.partitionBy("family").text(path)


def read_residue_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(r, chain, structure_r) of ``PDB_RES_MAPPING r residue chain`` lines between
    START_RESIDUE_LIST and END_RESIDUE_LIST; two lines for a residue, or a malformed one, are an
    error."""
    p = records(spark, path, "\n").select(F.split(F.trim("value"), r"\s+").alias("p")).filter("p[0] = 'PDB_RES_MAPPING' and coalesce(get(p, 1), '') not in ('START_RESIDUE_LIST', 'END_RESIDUE_LIST')")
    own = F.get("p", F.lit(1))
    good = (F.size("p") == 4) & own.rlike(r"^-?\d+$") & (F.count("*").over(Window.partitionBy(own)) == 1)
    r = F.when(good, own).otherwise(F.raise_error(F.concat(F.lit("bad residue: "), F.array_join("p", " "))).cast("string"))
    return p.select(r.cast("int").alias("r"), F.try_element_at("p", F.lit(4)).alias("chain"), F.try_element_at("p", F.lit(3)).alias("structure_r"))


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, wt, r, mut, ddg) of lists of codes, with values or without; ``#`` comments."""
    r = records(spark, path, "\n").withColumn("p", F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")).filter(F.col("p")[0] != "")
    part = lambda i: F.regexp_extract(F.col("p")[0], r"^(.)(-?\d+)(.)$", i)
    return r.select("file", "pos", part(1).alias("wt"), part(2).cast("int").alias("r"), part(3).alias("mut"), F.try_element_at("p", F.lit(2)).cast("double").alias("ddg"))


@dataclass
class JobFile:
    """A key and value file: one line for each key, ``#`` in the first column for comments.

    ``repeated`` keys may come more than once; ``arity`` gives the number of values of a key.
    """

    arity: dict[str, int | None]
    repeated: frozenset[str] = field(default_factory=frozenset)
    optional: frozenset[str] = field(default_factory=frozenset)

    def parse(self, text: str) -> dict[str, list]:
        out: dict[str, list] = {}
        for line in text.splitlines():
            if not line.strip() or line.startswith("#"):
                continue
            key, *values = line.split()
            if key not in self.arity:
                raise ValueError(f"unknown key: {key}")
            if self.arity[key] is not None and len(values) != self.arity[key]:
                raise ValueError(f"{key} needs {self.arity[key]} values")
            if key in out and key not in self.repeated:
                raise ValueError(f"{key} is given twice")
            out.setdefault(key, []).append(values)
        missing = self.arity.keys() - out.keys() - self.optional
        if missing:
            raise ValueError(f"missing: {', '.join(sorted(missing))}")
        return out
