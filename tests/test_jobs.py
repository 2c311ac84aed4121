"""Jobs on small files."""

import math

import pytest

from stabilis.plans import jobs
from stabilis.sources import text


def test_jobs(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">PROTSEQ\nA-CD\n>SEQ1\nAKCD\n>SEQ2\nAKCE\n>SEQ3\nGKC-\n")
    out = str(tmp_path / "ddg")
    d = {(r.r, r.mut): r.ddg for r in jobs.consensus_job(spark, str(tmp_path / "a.fasta"), out).collect()}
    assert len(d) == 3 * 19 and d[1, "G"] == pytest.approx(math.log(4 / 2)) and d[3, "E"] == pytest.approx(math.log(3 / 2))
    assert text.read_ddgs(spark, out).count() == 57
    (tmp_path / "known.txt").write_text("A1G 0.5\nD3E 0.2\nC2A 1.5\nA1G 0.7\n")
    c = jobs.correlate_job(spark, str(tmp_path / "known.txt"), {"consensus": out}).first()
    assert c.n == 3 and 0 < c.r <= 1
    each, mean = jobs.rank_job(spark, str(tmp_path / "known.txt"), {"consensus": out})
    assert {r.mutation: r["rank"] for r in each.collect()}["D3E"] == 1 and mean.first().n == 4
    tree = "((PROTSEQ:0.1,SEQ1:0.1):0.1,(SEQ2:0.2,SEQ3:0.3):0.1);"
    best = jobs.inference_job(spark, str(tmp_path / "a.fasta"), tree, str(tmp_path / "post"), starts=1)
    assert best.count() == 57 and text.read_ddgs(spark, str(tmp_path / "post")).count() == 57
    aln, newick = jobs.alignment_job(spark, [str(tmp_path / "a.fasta")], str(tmp_path / "a.fasta"), 0.2, 0.9, str(tmp_path / "aln"))
    assert aln.count() == 4 and newick.endswith(";") and newick.count("SEQ") == 4
    mapping = spark.createDataFrame([(1, 11, "A"), (3, 13, "E")], "structure_r int, r int, prot string")
    s = {(r.r, r.mut): r.ddg for r in jobs.structure_job(spark, out, mapping, str(tmp_path / "s")).collect()}
    assert s[13, "D"] == pytest.approx(-math.log(3 / 2), abs=1e-5) and s[11, "G"] == pytest.approx(math.log(2), abs=1e-5)


def test_alignment_of_unaligned_homologs(spark, tmp_path):
    (tmp_path / "ref.fasta").write_text(">ref\nMKVLAWGTRE\n")
    (tmp_path / "h.fasta").write_text(">near\nMKVLAWWWGTRE\n>far\nCCCCCCCC\n>short\nMKVLGTRE\n>same\nMKVLAWGTRE\n>other\nMKVIAWGTRQ\n")
    where = [str(tmp_path / "h.fasta")], str(tmp_path / "ref.fasta"), 0.7, 0.3, str(tmp_path / "aln")
    aln, newick = jobs.alignment_job(spark, *where, align=True, distance="protein")
    got = {r.header: r.seq for r in aln.collect()}
    assert {len(s) for s in got.values()} == {10} and got["PROTSEQ"] == "MKVLAWGTRE" and sorted(got) == ["PROTSEQ", "SEQ1", "SEQ2", "SEQ3"]
    assert got["SEQ1"] == "MKVLAWGTRE" and got["SEQ2"].replace("-", "") == "MKVLGTRE" and got["SEQ3"] == "MKVIAWGTRQ"
    assert newick.count("SEQ") == 4 and "PROTSEQ" in newick and newick.endswith(";")
