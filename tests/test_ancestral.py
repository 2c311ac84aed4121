"""Likelihoods, slopes and states of trees against enumeration; output files; work that goes on."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stabilis.functions import residues as R
from stabilis.operators import ancestral as B
from stabilis.operators import distances as D
from stabilis.operators import inference as I
from stabilis.operators import model as M
from stabilis.operators import trees as T
from stabilis.operators.resume import committed, resumed
from stabilis.sources import outfile

PI = np.array([0.3, 0.2, 0.35, 0.15])
LEFT, RIGHT = [0, 2, -1], [1, 3, -2]  # ((0, 1), (2, 3))
LENGTHS = [0.1, 0.3, 0.2, 0.05, 0.4, 0.25]


def enumerated(letters, lengths, model, shape):
    """The likelihood of a site of the tree of four tips, and the probability of each interior state."""
    p = model.step(np.array(lengths), shape)[0].reshape(3, 2, 4, 4)
    joint = np.zeros((4, 4, 4))
    seen = lambda node, side, x, letter: 1.0 if letter == "-" else p[node, side, x, "ACGT".index(letter)]
    for a, b, r in itertools.product(range(4), repeat=3):
        tips = seen(0, 0, a, letters[0]) * seen(0, 1, a, letters[1]) * seen(1, 0, b, letters[2]) * seen(1, 1, b, letters[3])
        joint[a, b, r] = model.pi[r] * p[2, 0, r, a] * p[2, 1, r, b] * tips
    total = joint.sum()
    return total, np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]) / total


@pytest.mark.parametrize("shape", [None, 1.5])
def test_against_enumeration(shape):
    model = D.f84_model(PI)
    sites = ["AACC", "ACGT", "A-GG", "----", "TTTT", "GAGA"]
    p = B.Passes(sites, LEFT, RIGHT, LENGTHS, model, shape)
    for s, letters in enumerate(sites):
        total, states = enumerated(letters, LENGTHS, model, shape)
        assert np.isclose(p.log[s], np.log(total)) and np.allclose(p.states()[s], states)
    one, two = p.slopes()
    h = 1e-5
    log = lambda t: sum(np.log(enumerated(x, t, model, shape)[0]) for x in sites)
    for i in range(6):
        up, down = (log([t + (k == i) * s for k, t in enumerate(LENGTHS)]) for s in (h, -h))
        assert np.isclose(one[i], (up - down) / (2 * h), atol=1e-6) and np.isclose(two[i], (up - 2 * log(LENGTHS) + down) / h**2, atol=1e-3)


def simulated(model, sites, seed):
    rng = np.random.default_rng(seed)
    p = np.maximum(model.step(np.array(LENGTHS), None)[0].reshape(3, 2, 4, 4), 0)
    draw = lambda row: rng.choice(4, p=row / row.sum())
    out = []
    for _ in range(sites):
        r = draw(model.pi)
        a, b = draw(p[2, 0, r]), draw(p[2, 1, r])
        out.append("".join("ACGT"[draw(row)] for row in (p[0, 0, a], p[0, 1, a], p[1, 0, b], p[1, 1, b])))
    return out


def test_lengths_are_found(spark):
    model = D.f84_model(PI)
    sites = simulated(model, 3000, 1)
    rows = spark.createDataFrame([(7, i + 1, s, LEFT, RIGHT, [0.1] * 6) for i, s in enumerate(sites)], "tree_id long, site int, letters string, left array<int>, right array<int>, lengths array<double>")
    (r,) = B.fitted_lengths(rows, model).collect()
    p = B.Passes(sites, LEFT, RIGHT, r.lengths, model, None)
    assert r.converged and np.isclose(p.log.sum(), r.log_likelihood) and r.log_likelihood > B.Passes(sites, LEFT, RIGHT, LENGTHS, model, None).log.sum() - 1e-6
    one, two = p.slopes()
    assert np.abs(one / two).max() < 0.01 and np.allclose(r.lengths[:4], LENGTHS[:4], atol=0.04)
    # the root's two branches only count together
    assert abs(r.lengths[4] + r.lengths[5] - 0.65) < 0.08
    assert B.fitted_lengths(rows.limit(0), model).count() == 0


def test_states_of_trees(spark):
    nodes = T.nodes(spark.createDataFrame([(3, "((a:0.01,b:0.01):0.2,(c:0.01,d:0.01):0.2);")], "tree_id long, newick string"))
    seqs = spark.createDataFrame([("a", "ACD-"), ("b", "ACD-"), ("c", "AWDK"), ("d", "AWD-")], "name string, seq string")
    rows = I.residue_rows(I.tree_arrays(nodes), nodes, seqs)
    model = D.Reversible.of(R.AMINO_ACIDS, D.codon_exchange(), np.full(20, 0.05))
    got = {r.path: r.seq for r in B.interior_sequences(rows, nodes, model).join(nodes, ["tree_id", "node_id"]).collect()}
    assert got["left"] == "ACDK" and got["right"] == "AWDK" and got[""][0] == "A" and got[""][2] == "D"


def tree_rows(spark, width):
    rng = random.Random(width)
    nodes = T.nodes(spark.createDataFrame([(1, "((a:1,b:1):1,((c:1,d:1):1,e:1):1);"), (2, "(x:1,y:1);")], "tree_id long, newick string"))
    seqs = [(r.tree_id, r.node_id, "".join(rng.choice("ACD-") for _ in range(width))) for r in nodes.select("tree_id", "node_id").collect()]
    return nodes, nodes.join(spark.createDataFrame(seqs, "tree_id long, node_id int, seq string"), ["tree_id", "node_id"])


@pytest.mark.parametrize("width", [1, 60, 61, 145])
def test_outfile_round_trip(spark, tmp_path, width):
    nodes, full = tree_rows(spark, width)
    outfile.write_outfile(full, f"{tmp_path}/out")
    rows = outfile.read_outfile(spark, f"{tmp_path}/out").withColumn("tree_id", F.regexp_extract("file", r"tree_id=(\d+)/", 1).cast("long"))
    back = outfile.with_sequences(nodes, rows)
    got = {(r.tree_id, r.node_id): (r.name, r.seq) for r in back.collect()}
    assert {k: v[1] for k, v in got.items()} == {(r.tree_id, r.node_id): r.seq for r in full.collect()}
    inner = [got[1, r.node_id][0] for r in nodes.filter("tree_id = 1 and not is_tip").orderBy("path").collect()]
    assert inner == ["1", "2", "3", "4"]
    names = spark.createDataFrame([(x, x.upper()) for x in "abcdexy"], "name string, new_name string")
    assert {r.name for r in outfile.with_sequences(nodes, rows, names).filter("is_tip").collect()} == set("ABCDEXY")


OUTFILE = """
Amino acid ML, version 3.6

 2 species,  12  sites

Name                                     Sequences
----                                     ---------

one          ACDEFGHIKL
two          ..W.......

one          MN
two          .-


  +one
 1
  +two

 Between        And            Length
    1          one              0.1

Probable sequences at interior nodes:

  node                    Reconstructed sequence (caps if > 0.95)

    1        ACdEFGHIKL
 one         ACDEFGHIKL

    1        mN
 one         MN

"""


def test_outfile_of_a_program(spark, tmp_path):
    (tmp_path / "f").write_text(OUTFILE)
    got = [(r.kind, r.place, r.name, r.seq) for r in outfile.read_outfile(spark, f"{tmp_path}/f").orderBy("kind", "place").collect()]
    assert got == [("interior", 1, "1", "ACDEFGHIKLMN"), ("tip", 1, "one", "ACDEFGHIKLMN"), ("tip", 2, "two", "ACWEFGHIKLM-")]
    bad = [OUTFILE.replace("Probable", "Likely"), OUTFILE.replace("two          .-", "two          ."), OUTFILE.replace("    1        mN\n", "    1        mN\n    2        mN\n"), OUTFILE.replace("two          ..W.......", "one          ..W.......")]
    for i, text in enumerate(bad):
        (tmp_path / f"bad{i}").write_text(text)
        with pytest.raises(Exception, match="no sequences|unequal|twice"):
            outfile.read_outfile(spark, f"{tmp_path}/bad{i}").collect()


def test_work_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, i) for i in range(200)], "a int, b int").repartition(3)
    log = tmp_path / "log"
    log.mkdir()

    def work(stop):
        def run(frames):
            for df in frames:
                if stop and (df["b"] == 77).any():
                    raise RuntimeError("lost")
                (log / f"{random.random()}").write_text("\n".join(f"{a},{b}" for a, b in zip(df["a"], df["b"], strict=True)))
                yield df.assign(c=df["a"] * df["b"])

        return lambda some: some.mapInPandas(run, "a int, b int, c int")

    folder = str(tmp_path / "done")
    with pytest.raises(Exception, match="lost"):
        resumed(rows, ["a", "b"], work(True), folder, 4)
    kept = committed(spark, folder)
    before = spark.read.parquet(*kept).count() if kept else 0
    for f in log.iterdir():
        f.unlink()
    got = resumed(rows, ["a", "b"], work(False), folder, 5)
    assert sorted(map(tuple, got.collect())) == sorted((i % 7, i, i % 7 * i) for i in range(200))
    done = [line for f in log.iterdir() for line in f.read_text().split()]
    assert len(done) == len(set(done)) == 200 - before
    assert resumed(rows, ["a", "b"], work(True), folder, 4).count() == 200


def test_search_goes_on_and_says_whether_it_ended(spark, tmp_path):
    nodes = T.nodes(spark.createDataFrame([(1, "((a:0.1,b:0.1):0.1,(c:0.2,d:0.3):0.1);")], "tree_id long, newick string"))
    seqs = spark.createDataFrame([("a", "AC"), ("b", "AD"), ("c", "VD"), ("d", "AD")], "name string, seq string")
    rows = I.residue_rows(I.tree_arrays(nodes), nodes, seqs)
    c = M.mutation_array(M.mutation_table(spark, "TRANSITION_TRANSVERSION_RATIO", F.lit(4.0)))
    folder = str(tmp_path / "starts")
    one = {r.site: r for r in I.maximize(rows, c, 5.0, 1.0, 0.0, 2, folder=folder).collect()}
    two = {r.site: r for r in I.maximize(rows, c, 5.0, 1.0, 0.0, 2).collect()}
    assert one == two and all(r.converged for r in one.values()) and spark.read.parquet(*committed(spark, folder)).count() == 4
    cut = {r.site: r for r in I.maximize(rows, c, 5.0, 1.0, 0.0, 1, most=1).collect()}
    assert not any(r.converged for r in cut.values())
    again = {r.site: r for r in I.maximize(rows, c, 5.0, 1.0, 0.0, 1, most=8, retries=40).collect()}
    assert all(again[s].log_posterior >= cut[s].log_posterior - 1e-6 for s in cut)
