"""Whole jobs on files: each reads its inputs, computes, and writes a folder of text.

A job is a function of a session, paths and parameters; ``main`` runs one from a key and value
file, ``python -m stabilis.plans.jobs JOB FILE``.  Residues are numbered from 1 in all files.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import residues as R
from ..functions import statistics as S
from ..operators import alignment as A
from ..operators import clusters as C
from ..operators import ddg as D
from ..operators import distances as N
from ..operators import edges as E
from ..operators import inference as I
from ..operators import model as M
from ..operators import pairwise as P
from ..operators import stepwise as W
from ..operators import trees as T
from ..sources import text


def one_family(seqs: DataFrame) -> DataFrame:
    """File records as the rows of one family, unknown residues as gaps."""
    return seqs.select(F.lit("all").alias("family"), "pos", "header", R.unknowns_to_gaps(F.upper("seq")).alias("seq"))


def stripped(aln: DataFrame) -> DataFrame:
    return A.with_reference(aln).select("family", "pos", "header", R.strip_to_reference(F.col("seq"), F.col("ref")).alias("seq"))


def method_table(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The stability files of several methods as one table."""
    parts = [text.read_ddgs(spark, path).select(F.lit(name).alias("method"), F.lit("all").alias("family"), "r", "wt", "mut", "ddg") for name, path in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def consensus_job(spark: SparkSession, alignment: str, out: str, pseudocounts: float = 1.0, heading: str = "consensus") -> DataFrame:
    """Consensus stabilities of an alignment, whose first sequence is the reference."""
    aln = stripped(one_family(text.read_fasta(spark, alignment)))
    ddg = D.consensus(A.site_counts(aln), A.reference_sites(aln), pseudocounts)
    text.ddg_lines(ddg, heading).coalesce(1).write.mode("overwrite").text(out)
    return ddg


def correlate_job(spark: SparkSession, known: str, files: dict[str, str]) -> DataFrame:
    """(method, r, p, n): predictions against measured values, repeated measures averaged."""
    measured = text.read_mutations(spark, known).groupBy("r", "wt", "mut").agg(F.avg("ddg").alias("known"))
    both = method_table(spark, files).join(measured, ["r", "wt", "mut"])
    c = both.groupBy("method").agg(S.pearson(F.col("known"), F.col("ddg")).alias("c"))
    return c.select("method", "c.r", "c.p", "c.n")


def rank_job(spark: SparkSession, selected: str, files: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Ranks of selected mutations for each method, null without a prediction, and their means."""
    ranked = D.ranked(method_table(spark, files)).select("method", "mutation", "ddg", "rank")
    wanted = text.read_mutations(spark, selected).select("pos", R.mutation_code(F.col("wt"), F.col("r"), F.col("mut")).alias("mutation"))
    methods = spark.createDataFrame([(k,) for k in files], "method string")
    each = wanted.crossJoin(F.broadcast(methods)).join(ranked, ["method", "mutation"], "left")
    mean = each.groupBy("method").agg(F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"), F.count("rank").alias("n"))
    return each, mean


def family_tree(aln: DataFrame, kind: str = "UPGMA", distance: str = "differences", cv: float = 1.0) -> str:
    """A Newick text of the one family of ``aln``.

    ``distance``: differences (shares of differing columns), or protein or dna, those of greatest
    likelihood with rates of variation ``cv``; a pair without one is as far as the farthest.  UPGMA and
    FITCH (weighted least squares) are built by joins and sums on the table of pairs, NJ (from differences) in one task.
    """
    if kind not in ("UPGMA", "FITCH"):
        return C.distance_trees(aln, kind).first()["newick"]
    if distance == "differences":
        pairs = N.pairs(aln).select("family", "a", "b", (R.hamming(F.col("seq_a"), F.col("seq_b")) / F.length("seq_a")).alias("distance"))
    else:
        pairs = N.likely_distances(aln, distance, cv)
        farthest = pairs.agg(F.coalesce(F.max("distance"), F.lit(1.0)).alias("most"))
        pairs = pairs.crossJoin(F.broadcast(farthest)).select("family", "a", "b", F.coalesce("distance", "most").alias("distance"))
    if kind == "FITCH":
        name = lambda end: aln.select("family", F.col("pos").alias(end), F.col("header").alias(f"name_{end}"))
        named = pairs.join(name("a"), ["family", "a"]).join(name("b"), ["family", "b"])
        return E.newicks(W.least_squares_trees(named.select(F.lit(0).alias("tree_id"), F.col("name_a").alias("a"), F.col("name_b").alias("b"), "distance"))).first()["newick"]
    return E.newicks(C.as_edges(C.average_linkage(pairs), aln.select("family", "pos", "header"))).first()["newick"]


def alignment_job(spark: SparkSession, homologs: list[str], alignment: str, identity: float, gaps: float, out: str, kind: str = "UPGMA", align: bool = False, distance: str = "differences") -> tuple[DataFrame, str]:
    """Homologs of a reference, screened, renamed and joined to a tree.

    The reference is the first record of ``alignment``.  ``homologs`` are aligned to it already, or,
    with ``align``, pair by pair here: what they have between its residues is dropped.  The tree is that of
    ``family_tree``.  The names given to the sequences are written beside the alignment, as
    ``SEQn header`` lines.
    """
    ref = one_family(text.read_fasta(spark, alignment))
    first = A.reference(ref).select("family", F.col("ref_pos").alias("pos"), F.lit("PROTSEQ").alias("header"), F.col("ref").alias("seq"))
    if align:
        first = first.withColumn("seq", F.replace("seq", F.lit("-"), F.lit("")))
    every = one_family(text.read_fasta(spark, homologs[0]))
    for path in homologs[1:]:
        every = every.unionByName(one_family(text.read_fasta(spark, path)))
    fresh = A.first_of_each(every).join(first.select("seq"), "seq", "left_anti")
    both = fresh.join(first.select("family", F.col("seq").alias("ref")), "family")
    if align:
        done = P.aligned(both.withColumn("a", F.replace("seq", F.lit("-"), F.lit(""))), "a", "ref")
        share = F.col("identical") / F.nullif(F.col("columns") - F.col("gaps"), F.lit(0))
        good = done.filter((share >= identity) & (F.col("gaps") / F.col("columns") <= gaps)).withColumn("seq", F.col("placed"))
        good = A.first_of_each(good.select("family", "pos", "header", "seq"))
    else:
        s = A.pair_statistics(F.col("seq"), F.col("ref"))
        good = both.withColumn("s", s).filter((F.col("s.identity") >= identity) & (F.col("s.gaps") <= gaps))
    place = F.row_number().over(Window.partitionBy("family").orderBy("pos"))
    named = good.withColumn("pos", place.cast("long")).withColumn("name", F.concat(F.lit("SEQ"), F.col("pos").cast("string")))
    named.orderBy("pos").select(F.concat_ws(" ", "name", "header")).coalesce(1).write.mode("overwrite").text(out + ".names")
    named = named.select("family", "pos", F.col("name").alias("header"), "seq")
    aln = first.withColumn("pos", F.lit(0).cast("long")).unionByName(named)
    text.write_fasta(aln, out, "overwrite")
    return aln, family_tree(aln, kind, distance)


def inference_job(spark: SparkSession, alignment: str, newick: str, out: str, mutrate: float = 5.0, ratio: float = 4.0, scale: float = 1.0, shift: float = 0.0, starts: int = 5, priors: str | None = None, initial: str | None = None, done: str | None = None) -> DataFrame:
    """Posterior stabilities of the first sequence of an alignment, along a tree of its headers.

    Prior centres come from hydropathies or from a stability file ``priors``; the first start is the
    centre or that of a stability file ``initial``.  Finished searches are kept in the folder ``done``, if
    one is given, and a job that was stopped goes on from there.
    """
    aln = stripped(one_family(text.read_fasta(spark, alignment)))
    nodes = T.nodes(spark.createDataFrame([(0, newick)], "tree_id long, newick string"))
    rows = I.residue_rows(I.tree_arrays(nodes), nodes, aln.select(F.col("header").alias("name"), "seq"))
    for name, path in (("center", priors), ("initial", initial)):
        if path:
            rows = I.with_stabilities(rows, text.read_ddgs(spark, path).select(F.col("r").alias("site"), "mut", "ddg"), name)
    table = M.mutation_table(spark, "TRANSITION_TRANSVERSION_RATIO", F.lit(float(ratio)))
    best = I.maximize(rows, M.mutation_array(table), mutrate, scale, shift, starts, folder=done)
    aas = F.array(*map(F.lit, R.AMINO_ACIDS))
    ddg = best.select(F.col("site").alias("r"), "wt", F.posexplode("ddg").alias("i", "ddg")).select("r", "wt", F.element_at(aas, F.col("i") + 1).alias("mut"), "ddg").filter("mut <> wt")
    text.ddg_lines(ddg, "posterior").coalesce(1).write.mode("overwrite").text(out)
    return ddg


def structure_job(spark: SparkSession, measured: str, mapping: DataFrame, out: str) -> DataFrame:
    """Values measured on a structure for the protein's residues.

    ``mapping``: (structure_r, r, prot) gives the residue of the protein for one of the structure.
    """
    ddg = text.read_ddgs(spark, measured).withColumnRenamed("r", "structure_r").join(mapping, "structure_r").withColumn("family", F.lit("all"))
    pairs = ddg.select("family", "r", "prot", "wt").distinct()
    based = D.rebased(ddg.select("family", "r", "wt", "mut", "ddg"), pairs, strict=True)
    text.ddg_lines(based, "structure").coalesce(1).write.mode("overwrite").text(out)
    return based


FILES = {
    "consensus": text.JobFile({"ALIGNMENT": 1, "PSEUDOCOUNTS": 1, "OUTFILE": 1}),
    "correlate": text.JobFile({"KNOWN": 1, "PREDICTIONS": 2, "OUTFILE": 1}, frozenset({"PREDICTIONS"})),
    "rank": text.JobFile({"SELECTED": 1, "PREDICTIONS": 2, "OUTFILE": 1}, frozenset({"PREDICTIONS"})),
    "infer": text.JobFile({"ALIGNMENT": 1, "TREE": 1, "MUTRATE": 1, "TRANSITION_TRANSVERSION_RATIO": 1, "PRIORS": 2, "NSTARTS": 1, "OUTFILE": 1, "PRIOR_FILE": 1, "INITIAL_FILE": 1, "DONE": 1}, optional=frozenset({"PRIOR_FILE", "INITIAL_FILE", "DONE"})),
}


def main(args: list[str]) -> None:
    job, path = args
    spark = SparkSession.builder.getOrCreate()
    with open(path) as f:
        k = FILES[job].parse(f.read())
    one = lambda key: k[key][0][0]
    if job == "consensus":
        consensus_job(spark, one("ALIGNMENT"), one("OUTFILE"), float(one("PSEUDOCOUNTS")))
    elif job == "infer":
        with open(one("TREE")) as f:
            newick = f.read()
        scale, shift = map(float, k["PRIORS"][0])
        extra = {name: one(key) for key, name in (("PRIOR_FILE", "priors"), ("INITIAL_FILE", "initial"), ("DONE", "done")) if key in k}
        inference_job(spark, one("ALIGNMENT"), newick, one("OUTFILE"), float(one("MUTRATE")), float(one("TRANSITION_TRANSVERSION_RATIO")), scale, shift, int(one("NSTARTS")), **extra)
    else:
        files = {name: file for name, file in k["PREDICTIONS"]}
        out = correlate_job(spark, one("KNOWN"), files) if job == "correlate" else rank_job(spark, one("SELECTED"), files)[0]
        out.write.mode("overwrite").csv(one("OUTFILE"), header=True)


if __name__ == "__main__":
    main(sys.argv[1:])
