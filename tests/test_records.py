"""Records, trees without outgroups, and mappings on small inputs."""

import pytest
from pyspark.sql import functions as F

from stabilis.functions import residues as R
from stabilis.operators import alignment as A
from stabilis.operators import ddg as D
from stabilis.operators import trees as T
from stabilis.sources import text


def test_remove_outgroup(spark):
    cases = {
        "((A:1,B:2):0.5,OUT:3);": "(A:1,B:2);",
        "(A:1,B:2,OUT:3);": "(A:1,B:2);",
        "((A:1,B:1):2,C:2,OUT:3);": "((A:1,B:1):2,C:2);",
        "(C:2,(A:1,B:1):2,OUT:3) ;": "(C:2,(A:1,B:1):2);",
        "(A:1,OUT:3);": None,
        "(OUT:3,(A:1,B:1):2);": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", T.remove_outgroup(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == cases | {None: None}


def test_by_header(spark):
    seqs = spark.createDataFrame([(2, "b", "BB"), (1, "a", "A"), (3, "b", "late")], "pos long, header string, seq string")
    got = text.by_header(seqs, spark.createDataFrame([(0, "b"), (1, "a")], "place int, header string"))
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(0, "b", "BB"), (1, "a", "A")]
    with pytest.raises(Exception, match="no record: c"):
        text.by_header(seqs, spark.createDataFrame([(0, "c")], "place int, header string")).collect()


def test_strict_ddgs(spark, tmp_path):
    good = tmp_path / "good"
    good.write_text("heading\nMUTATION DDG\nA1G 0.5\n\nA1C None\n")
    assert {(r.mut, r.ddg) for r in text.read_ddgs(spark, str(good)).collect()} == {("G", 0.5), ("C", None)}
    for line in ("A1G", "A1G x", "AG 1.0", "A1G 1.0 2.0"):
        bad = tmp_path / f"bad{len(line)}{line[-1]}"
        bad.write_text(f"heading\nMUTATION DDG\n{line}\n")
        with pytest.raises(Exception, match="not a mutation and its value"):
            text.read_ddgs(spark, str(bad)).collect()


def test_residue_mappings(spark, tmp_path):
    f = tmp_path / "m"
    f.write_text("PDB_RES_MAPPING START_RESIDUE_LIST\nPDB_RES_MAPPING 1 11 A\nPDB_RES_MAPPING 2 12B A\nPDB_RES_MAPPING END_RESIDUE_LIST\n")
    assert sorted(map(tuple, text.read_residue_mapping(spark, str(f)).collect())) == [(1, "A", "11"), (2, "A", "12B")]
    f.write_text("PDB_RES_MAPPING 1 11 A\nPDB_RES_MAPPING 1 12 A\n")
    with pytest.raises(Exception, match="bad residue"):
        text.read_residue_mapping(spark, str(f)).collect()
    refs = spark.createDataFrame([("f", 1, "-"), ("f", 2, "A"), ("f", 3, "C")], "family string, site int, wt string")
    assert [(r.r, r.structure_r) for r in D.structure_residues(refs, 4, "B").orderBy("r").collect()] == [(1, "5"), (2, "6")]


def test_totals_and_dump(spark):
    nodes = T.nodes(spark.createDataFrame([(1, "(A:1,B:1);")], "tree_id long, newick string"))
    ids = {r.name: r.node_id for r in nodes.collect()}
    seqs = spark.createDataFrame([(1, ids[None], "AC"), (1, ids["A"], "AC"), (1, ids["B"], "AD")], "tree_id long, node_id int, seq string")
    assert {(r.site, r.n) for r in T.site_totals(T.site_changes(nodes, seqs), seqs).collect()} == {(1, 0), (2, 1)}
    got = [r.value for r in T.dumped(nodes, seqs.filter("seq <> 'AD'")).orderBy("tree_id", "path").collect()]
    assert got == [">ROOT INTERIOR None\nAC", ">LEFT TIP A\nAC", ">RIGHT TIP B\nNone"]


def test_random_sequence(spark):
    rows = spark.range(50).select(R.random_sequence(F.col("id").cast("int"), 3).alias("s"), "id").collect()
    assert all(len(r.s) == r.id and set(r.s) <= set(R.AMINO_ACIDS) for r in rows) and len({r.s[:5] for r in rows if r.id > 5}) > 30


def test_long_phylip_names_fail(spark):
    aln = spark.createDataFrame([(1, "12345678901", "A")], "pos long, header string, seq string")
    with pytest.raises(Exception, match="name too long"):
        text.phylip_lines(aln).collect()


def test_pair_statistics(spark):
    df = spark.createDataFrame([("A-CD", "AK-E"), ("--", "--"), ("", ""), ("A", "AB"), ("a-", "A-")], "a string, b string")
    got = [tuple(r.s) if r.s else None for r in df.select(A.pair_statistics(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [(0.5, 0.5), (None, 1.0), (None, None), None, (1.0, 0.5)]
    with pytest.raises(Exception, match="both sequences have a gap"):
        df.select(A.pair_statistics(F.col("a"), F.col("b"), False).alias("s")).collect()


def test_checkpoint_folder_needed_on_a_cluster():
    from stabilis.operators.tables import fresh_folder

    class Any:
        def __init__(self, **k):
            self.__dict__.update(k)

    unset = Any(isDefined=lambda: False)
    context = Any(master="spark://host:7077", _jsc=Any(sc=lambda: Any(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        fresh_folder(Any(sparkContext=context, conf=Any(get=lambda key, default: default)))
