"""Queries that write the files of the library and read them again, and lookups of records.

Files go below the checkpoint folder, to a new path each time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import alignment as A
from ..operators import ddg as D
from ..operators.tables import fresh_folder
from ..sources import table_functions, text
from . import views as V
from .queries_ddg import SQL_SELECTED, one, rounded, selected
from .registry import query


def fasta(spark, d):
    """All aligned texts, from FASTA files."""
    path = fresh_folder(spark)
    text.write_fasta(V.proteins(spark, d), path)
    return text.read_fasta(spark, path)


@query(f"WITH {V.SQL_PROTEINS} SELECT header, seq FROM prot")
def fasta_files(spark, d):
    return fasta(spark, d).select("header", "seq")


@query(f"WITH {V.SQL_PROTEINS} SELECT pos // 1000000 AS doc_id, (pos % 1000000)::INT AS place, header, seq FROM prot")
def fasta_table_function(spark, d):
    """A FASTA text for each document, taken apart by SQL alone."""
    table_functions.register(spark)
    records = V.proteins(spark, d).withColumn("value", text.fasta_text(F.col("header"), F.col("seq")))
    texts = records.groupBy(F.expr("pos div 1000000").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x"))
    texts.select("doc_id", F.array_join("x.value", "\n").alias("fasta")).createOrReplaceTempView("given_fasta")
    return spark.sql("SELECT t.doc_id, r.place, r.header, r.seq FROM given_fasta t, LATERAL fasta_records(t.fasta) r")


@query(f"WITH {V.SQL_PROTEINS} SELECT doc_id AS place, header AS name, header, seq FROM prot JOIN letters ON pos = doc_id * 1000000")
def fasta_entries(spark, d):
    wanted = V.letters(spark, d).select(F.col("doc_id").alias("place"), F.format_string("D%d_0", "doc_id").alias("name"))
    return text.entries(fasta(spark, d), wanted)


@query(f"WITH {V.SQL_PROTEINS} SELECT doc_id AS place, header, seq FROM prot JOIN letters ON pos = doc_id * 1000000")
def header_lookup(spark, d):
    wanted = V.letters(spark, d).select(F.col("doc_id").alias("place"), F.format_string("D%d_0", "doc_id").alias("header"))
    return text.by_header(V.proteins(spark, d), wanted)


@query(f"WITH {V.SQL_PROTEINS} SELECT pos AS place, header, seq FROM prot")
def realigned_order(spark, d):
    """Aligned rows in an order of their own, put back into that of the input."""
    aln = V.proteins(spark, d)
    return text.by_header(aln.withColumn("pos", F.xxhash64("header")), aln.select(F.col("pos").alias("place"), "header"))


@query(f"WITH {V.SQL_PROTEINS} SELECT to_hex(pos) AS header, seq FROM prot")
def phylip_files(spark, d):
    """Alignments of up to a thousand documents each."""
    path = fresh_folder(spark)
    family = F.concat_ws("_", "family", F.floor(F.col("pos") / 1000000000).cast("string"))
    text.write_phylip(V.proteins(spark, d).withColumn("header", F.hex("pos")).withColumn("family", family), path)
    return text.read_phylip(spark, path).select("header", "seq")


@query(f"WITH {V.SQL_DDG} SELECT family, r::INT AS r, wt, mut, round(ddg, 6) AS ddg FROM ddg WHERE method = 'P20'")
def ddg_files(spark, d):
    path = fresh_folder(spark)
    text.write_ddgs(one(spark, d, "P20"), path, "consensus")
    family = F.regexp_extract("file", "family=([^/]*)/", 1)
    return text.read_ddgs(spark, path).select(family.alias("family"), "r", "wt", "mut", "ddg")


@query(f"WITH {V.SQL_DDG} SELECT wt, r::INT AS r, mut, round(ddg, 6) AS ddg FROM ddg WHERE method = 'P1' AND {SQL_SELECTED} AND ddg IS NOT NULL")
def mutation_list_files(spark, d):
    path = fresh_folder(spark)
    known = selected(one(spark, d, "P1")).filter("ddg is not null")
    known.select(F.concat_ws(" ", R.mutation_code(F.col("wt"), F.col("r"), F.col("mut")), F.format_string("%.6f", "ddg")).alias("value")).write.text(path)
    return text.read_mutations(spark, path).select("wt", "r", "mut", "ddg")


@query(f"WITH {V.SQL_PROTEINS} SELECT p.family, p.pos, p.header, p.seq FROM prot p JOIN first f ON f.family = p.family WHERE p.pos <> f.pos")
def outgroup_removal(spark, d):
    """Every family without the row that its reference names."""
    aln = V.proteins(spark, d)
    names = aln.groupBy("family").agg(F.min_by("header", "pos").alias("header"))
    return A.without(aln, names)


@query(f"WITH {V.SQL_DDG} SELECT family, (row_number() OVER (PARTITION BY family ORDER BY r, mut))::INT AS place, round(ddg, 8) AS ddg FROM ddg WHERE method = 'P1'")
def get_ddgs_all(spark, d):
    return rounded(D.listed(one(spark, d, "P1")))


@query(f"WITH {V.SQL_DDG} SELECT d.family, (61 - r)::INT AS place, r::INT AS r, wt, mut, round(ddg, 8) AS ddg FROM ddg d WHERE method = 'P1' AND r % 7 = 0")
def get_ddgs_residues(spark, d):
    """Every seventh residue from the last to the first, and some that aren't there."""
    wanted = A.reference(V.proteins(spark, d)).select("family", F.explode(F.sequence(F.lit(7), F.lit(140), F.lit(7))).alias("r")).withColumn("place", 61 - F.col("r"))
    return rounded(D.of_residues(one(spark, d, "P1"), wanted))


@query(
    f"""WITH {V.SQL_DDG} SELECT method, family, (row_number() OVER (PARTITION BY method, family ORDER BY ddg NULLS FIRST, wt || r || mut))::INT AS rank,
wt || r || mut || chr(9) || CASE WHEN ddg IS NULL THEN 'None' ELSE printf('%.4f', ddg) END AS value FROM ddg"""
)
def sorted_export(spark, d):
    return D.sorted_lines(V.stabilities(spark, d))


@query(f"WITH {V.SQL_SITES}, o AS (SELECT family, wt, row_number() OVER (PARTITION BY family ORDER BY site) AS r FROM refsites WHERE wt <> '-') SELECT family, r::INT AS r, wt, 'A' AS chain, (r + 100)::VARCHAR AS structure_r FROM o")
def structure_residues(spark, d):
    return D.structure_residues(A.reference_sites(V.proteins(spark, d)), 100, "A")
