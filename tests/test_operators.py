"""Operators on small inputs with known results."""

import itertools
import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stabilis.functions import residues as R
from stabilis.functions import statistics as S
from stabilis.operators import alignment as A
from stabilis.operators import clusters as C
from stabilis.operators import ddg as D
from stabilis.operators import inference as I
from stabilis.operators import model as M
from stabilis.operators import trees as T
from stabilis.plans import queries_trees
from stabilis.sources import text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_sequence_functions(spark):
    c = F.col("s")
    assert one(spark, R.reverse_complement(c), s="ATGCaa") == "ttGCAT"
    assert one(spark, R.unknowns_to_gaps(c), s="ABZXbC") == "A---bC"
    assert one(spark, R.translate_nt(c), s="ATGGGATAA") == "MG"
    assert one(spark, R.translate_nt(c, readthrough_n=True), s="ATGNNNGGN") == "MXG"
    assert one(spark, R.translate_nt(c, translate_gaps=True), s="ATG-A-GGG") == "M-G"
    assert one(spark, R.translate_nt(c, truncate_incomplete=True), s="ATGGG") == "M"
    assert one(spark, R.translate_nt(c), s="") == ""
    assert one(spark, R.find_motifs(c, "AAN"), s="aacAAAAgU") == [0, 3]
    assert one(spark, R.three_to_one(c), s="ala") == "A"
    for bad in ("ATGTAAGGG", "ATGG", "ATNAAN"):
        with pytest.raises(Exception):
            one(spark, R.translate_nt(c), s=bad)


def test_alignment(spark):
    rows = [("f", 1, "r", "-AC-D-"), ("f", 2, "a", "GACXDG"), ("f", 3, "b", "-aC-E-"), ("f", 4, "c", "GACXDG")]
    aln = spark.createDataFrame(rows, "family string, pos long, header string, seq string")
    w = A.with_reference(aln)
    dots = {r.pos: r.x for r in w.select("pos", R.add_dots(F.col("seq"), F.col("ref")).alias("x")).collect()}
    assert dots[2] == "G..X.G" and dots[3] == "-..-E-"
    back = {r.pos: r.x for r in w.withColumn("d", R.add_dots(F.col("seq"), F.col("ref"))).select("pos", R.remove_dots(F.col("d"), F.col("ref")).alias("x")).collect()}
    assert back[2] == "GACXDG"
    strip = {r.pos: (r.x, r.y) for r in w.select("pos", R.strip_to_reference(F.col("seq"), F.col("ref")).alias("x"), R.strip_ends_to_reference(F.col("seq"), F.col("ref")).alias("y")).collect()}
    assert strip[2] == ("ACD", "ACXD")
    s = w.filter("pos = 3").select(A.pair_statistics(F.col("seq"), F.col("ref")).alias("s")).first()["s"]
    assert s["identity"] == pytest.approx(2 / 3) and s["gaps"] == pytest.approx(0.5)
    assert A.first_of_each(aln).count() == 3
    n = A.glycan_sites(spark.createDataFrame([("f", 1, "r", "N-PSNA-TNNSS")], "family string, pos long, header string, seq string"))
    assert sorted(r.site0 for r in n.collect()) == [4, 8, 9]


def test_condense_is_greedy(spark):
    seqs = ["AAAAAAAA", "AAAAAAAC", "AAAAAACC", "AAAAACCC", "CAAAAAAA", "GGGGGGGG"]
    aln = spark.createDataFrame([("f", i, str(i), s) for i, s in enumerate(seqs)], "family string, pos long, header string, seq string")
    assert sorted(r.pos for r in C.condense(aln, 1).collect()) == [0, 2, 5]
    assert sorted(r.pos for r in C.condense(aln, 1, (1,)).collect()) == [0, 2, 4, 5]


def test_contained(spark):
    aln = spark.createDataFrame([("f", 1, "a", "ACDEFGHIKLMNPQ"), ("f", 2, "b", "CDEFGHIKLMNP--"), ("f", 3, "c", "WCDEFGHIKLMNP-")], "family string, pos long, header string, seq string")
    assert sorted(r.pos for r in A.contained(aln).collect()) == [1, 3]


def test_contained_at_all_lengths(spark):
    rng = random.Random(3)
    made = {f: [(i, "".join(rng.choice("AC-") for _ in range(rng.randint(0, 30)))) for i in range(40)] for f in "xy"}
    made["x"] += [(50 + n, "ACDEFGHIKLMNPQRSTVWY"[3 : 3 + n]) for n in range(17)] + [(80, "ACDEFGHIKLMNPQRSTVWY"), (81, "W"), (82, "WW"), (83, "YYYYYYYYYYY")]
    made["z"], made["e"] = [(0, "-"), (1, "")], [(0, ""), (1, "A")]
    rows = [(f, i, f"h{i}", s) for f, x in made.items() for i, s in x]
    bare = {(f, i): s.replace("-", "") for f, i, _, s in rows}
    out = lambda f, i, s: any(g == f and (s != o and s in o or s == o and j < i) for (g, j), o in bare.items())
    got = A.contained(spark.createDataFrame(rows, "family string, pos long, header string, seq string"))
    assert sorted((r.family, r.pos) for r in got.collect()) == sorted((f, i) for (f, i), s in bare.items() if not out(f, i, s))


def test_ddg(spark):
    schema = "method string, family string, r int, wt string, mut string, ddg double"
    t = spark.createDataFrame([("m", "f", 1, "A", "C", 1.0), ("m", "f", 1, "A", "D", None), ("m", "f", 2, "K", "A", -1.0), ("m", "f", 2, "K", "C", 1.0)], schema)
    assert [(r.mutation, r["rank"]) for r in D.ranked(t).orderBy("rank").collect()] == [("A1D", 1), ("K2A", 2), ("A1C", 3), ("K2C", 4)]
    r = {(x.r, x.mut): x.ddg for x in D.rescaled(t, "STANDARD_DEVIATION", 1.0, 0.0, (-1.0, 9.0)).collect()}
    assert r[1, "D"] is None and r[2, "A"] == -1.0
    assert D.filled(t.drop("method"), spark.createDataFrame([("f", 1, "A")], "family string, site int, wt string"), 7.0).filter("ddg = 7").count() == 18
    assert D.restrict(t.drop("method"), t.drop("method")).filter("ddg is null").count() == 1
    base = D.rebased(t.drop("method"), spark.createDataFrame([("f", 2, "C", "K")], "family string, r int, prot string, wt string"))
    assert {x.mut: x.ddg for x in base.collect()} == {"A": -2.0, "K": -1.0}


def test_statistics(spark):
    x = spark.createDataFrame([(1.0, 2.0), (2.0, 3.9), (3.0, 6.2), (None, 1.0), (4.0, None)], "x double, y double")
    r = x.select(S.pearson(F.col("x"), F.col("y")).alias("p")).first()["p"]
    assert r["n"] == 3 and r["r"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 3.9, 6.2])[0, 1])
    assert r["p"] == pytest.approx(math.erfc(r["r"] * math.sqrt(3 / 2)), abs=2e-7)
    g = spark.createDataFrame([(1.2,), (1.05,), (0.95,)], "x double").select(S.geometric(F.col("x")).alias("g")).first()["g"]
    assert g["gm"] == pytest.approx(math.exp(np.mean(np.log([1.2, 1.05, 0.95]))))
    fit = spark.createDataFrame([(float(i), 3 * math.exp(0.5 * i)) for i in range(5)], "x double, y double").select(S.fit_exponential(F.col("x"), F.col("y")).alias("f")).first()["f"]
    assert fit["a"] == pytest.approx(3) and fit["b"] == pytest.approx(0.5)
    assert S.incomplete_beta(0.3, 2.0, 3.0) == pytest.approx(0.3483, abs=1e-9)
    assert S.two_sided(0.0, 5.0) == pytest.approx(1.0)


def test_mutation_tables(spark):
    for kind in ("ALL_EQUAL", "CODON_EQUAL", "TRANSITION_TRANSVERSION_RATIO"):
        t = M.mutation_table(spark, kind, F.lit(4.0))
        assert t.count() == 400
        assert all(r.s == pytest.approx(1) for r in t.groupBy("y").agg(F.sum("c").alias("s")).collect())


def chain(n=5, seed=1):
    g = np.random.default_rng(seed).random((n, n))
    np.fill_diagonal(g, 0)
    return g - np.diag(g.sum(0))


def test_markov():
    g = chain()
    p = M.equilibrium(g)
    assert np.allclose(g @ p, 0) and p.sum() == pytest.approx(1)
    w, v = np.linalg.eig(g)
    assert np.allclose(M.exponential(g, np.array([0.1, 3.0]))[1], (v @ np.diag(np.exp(3 * w)) @ np.linalg.inv(v)).real)
    assert np.allclose(M.by_series(g, np.array([0.1, 3.0])), M.exponential(g, np.array([0.1, 3.0])))
    defective = np.array([[-1.0, 0, 0], [1, -1, 0], [0, 1, 0]])
    assert np.allclose(M.exponential(defective, np.array([2.0]))[0][:, 0], [np.exp(-2), 2 * np.exp(-2), 1 - 3 * np.exp(-2)])
    a, b = -g, M.group_inverse(-g)
    assert np.allclose(a @ b @ a, a) and np.allclose(b @ a @ b, b) and np.allclose(a @ b, b @ a)
    dg = np.zeros_like(g)
    dg[1, 0], dg[0, 0] = 1, -1
    h = 1e-6
    assert np.allclose(M.equilibrium_slope(g, dg), (M.equilibrium(g + h * dg) - M.equilibrium(g - h * dg)) / (2 * h), atol=1e-6)


FOUR = "((A:0.1,B:0.2):0.05,(C:0.3,D:0.1):0.2);"


def test_newick():
    n = T.parse(FOUR)
    assert [(x[4], x[8]) for x in n] == [(None, ""), (None, "right"), ("D", "right,right"), ("C", "right,left"), (None, "left"), ("B", "left,right"), ("A", "left,left")]
    assert [x[6] for x in n] == [None, None, 0, 1, None, 2, 3] and [x[7] for x in n] == [2, 0, None, None, 1, None, None]
    deep = "(" * 2000 + "t0:1" + "".join(f",t{i}:1):1" for i in range(1, 2000)) + ",z:1);"
    assert len(T.parse(deep)) == 2 * 2001 - 1
    for bad in ("((A:1,B:1):1", "(A:1,B:1,C:1);", "(A,B);"):
        with pytest.raises(ValueError):
            T.parse(bad)


def test_tree_text(spark):
    assert one(spark, T.no_negative_branches(F.col("s")), s="(A:-0.1,B:2);") == "(A:0.0,B:2);"
    assert one(spark, T.root_to_outgroup(F.col("s")), s="((A:1,B:1):1,C:2,O:3);") == "(((A:1,B:1):1,C:2):0.0,O:3);"


def test_likelihood_against_enumeration(spark):
    c = np.full((20, 20), 0.05)
    rng = np.random.default_rng(3)
    ddg = rng.normal(0, 1, 20)
    letters = "CA-D"  # tips are numbered D, C, B, A
    trees = {}
    for n in T.parse(FOUR):
        trees[n[0]] = n
    inner = sorted((n for n in trees.values() if not n[3]), key=lambda n: n[7])
    left, right, lengths = [], [], []
    for n in inner:
        kids = {k[2]: k for k in trees.values() if k[1] == n[0]}
        for side, into in (("left", left), ("right", right)):
            k = kids[side]
            into.append(k[6] if k[3] else -1 - k[7])
            lengths.append(k[5])
    got = I.log_likelihood(ddg[None], letters, left, right, lengths, c, 2.0)[0]
    g = M.rates(ddg, c)
    m = {t: M.exponential(g, np.array([2.0 * t]))[0] for t in set(lengths)}
    pi, total = M.equilibrium(g), 0.0
    at = lambda k, states: R.AMINO_ACIDS.find(letters[k]) if k >= 0 else states[-1 - k]
    for states in itertools.product(range(20), repeat=3):
        p = pi[states[2]]
        for i in range(3):
            for side, k in enumerate((left[i], right[i])):
                x = at(k, states)
                if x >= 0:
                    p *= m[lengths[2 * i + side]][x, states[i]]
        total += p
    assert got == pytest.approx(math.log(total), rel=1e-9)


def test_posterior_optimum(spark):
    class Row:
        letters, left, right, lengths = "CA-D", [-2, 3], [0, 2], [0.1, 0.3, 0.2, 0.1]

    Row.left, Row.right, Row.lengths = [0, 2, -1], [1, 3, -2], [0.1, 0.2, 0.3, 0.1, 0.05, 0.2]
    f = I.Posterior(Row, np.full((20, 20), 0.05), 5.0, 1.0, 0.0)
    x, value = I.climb(f, f.center[f.free], 300)
    assert value >= float(f(f.center[f.free])[0])
    assert np.abs(f.gradient(x)).max() < 0.02


def test_distance_tree():
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 4], [6, 6, 4, 0]], float)
    assert C.joined_tree(list("ABCD"), d) == "((A:1.000000,B:1.000000):2.000000,(C:2.000000,D:2.000000):1.000000);"
    assert sum(x[3] for x in T.parse(C.joined_tree(list("ABCD"), d, "NJ"))) == 4


def test_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x one\nAC\nGT\n>y\nTT T\n")
    f = text.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert [(r.header, r.seq) for r in f.orderBy("pos").collect()] == [("x one", "ACGT"), ("y", "TTT")]
    text.write_fasta(f, str(tmp_path / "out"))
    assert text.read_fasta(spark, str(tmp_path / "out")).count() == 2
    got = text.entries(f, spark.createDataFrame([(0, "y")], "place int, name string")).first()
    assert got.seq == "TTT"
    text.phylip_lines(f.withColumn("seq", F.rpad("seq", 4, "-"))).coalesce(1).write.text(str(tmp_path / "p"))
    p = text.read_phylip(spark, str(tmp_path / "p"))
    assert [(r.header, r.seq) for r in p.orderBy("pos").collect()] == [("x one", "ACGT"), ("y", "TTT-")]
    ddg = spark.createDataFrame([(1, "A", "C", 0.5), (2, "K", "D", None)], "r int, wt string, mut string, ddg double")
    text.ddg_lines(ddg, "today").coalesce(1).write.text(str(tmp_path / "d"))
    back = text.read_ddgs(spark, str(tmp_path / "d"))
    assert sorted((r.wt, r.r, r.mut, r.ddg) for r in back.collect()) == [("A", 1, "C", 0.5), ("K", 2, "D", None)]
    (tmp_path / "k.txt").write_text("# list\nL78K  3.9 # measured\nA2C\n")
    k = text.read_mutations(spark, str(tmp_path / "k.txt"))
    assert [(r.wt, r.r, r.mut, r.ddg) for r in k.orderBy("pos").collect()] == [("L", 78, "K", 3.9), ("A", 2, "C", None)]
    job = text.JobFile({"SEED": 1, "PRIORS": None}, frozenset({"PRIORS"}))
    assert job.parse("# x\nSEED 1\nPRIORS a b\nPRIORS c\n") == {"SEED": [["1"]], "PRIORS": [["a", "b"], ["c"]]}
    for bad in ("SEED 1 2\nPRIORS x", "SEED 1", "OTHER 1", "SEED 1\nSEED 1\nPRIORS x"):
        with pytest.raises(ValueError):
            job.parse(bad)


def test_inference_queries_cover_all_sites(spark, sf, monkeypatch):
    monkeypatch.setattr(queries_trees, "rows", lambda spark, d, width: width)
    monkeypatch.setattr(queries_trees, "mutations", lambda spark: None)
    for name, run in (("maximize", queries_trees.maximize_posterior), ("chains", queries_trees.mcmc_trace)):
        monkeypatch.setattr(I, name, lambda width, *_: width)
        assert run(spark, sf) == 64


def test_slopes_against_differences():
    rng = np.random.default_rng(3)
    c = rng.random((20, 20))
    c /= c.sum(0)
    row = SimpleNamespace(letters="AC-DA")
    row.left, row.right, row.lengths = [0, 2, -1, -3], [1, 3, -2, 4], [0.1, 0.25, 0.4, 0.1, 0.2, 0.3, 0.15, 0.5]
    f = I.Posterior(row, c, 10.0, 1.0, 0.0)
    for _ in range(3):
        x = rng.normal(0, 3, 19)
        assert np.allclose(f.gradient(x), f.differences(x), rtol=1e-4, atol=1e-5)
        value, _ = I.log_likelihood_slope(f.full(x[None])[0], row.letters, row.left, row.right, row.lengths, c, 10.0)
        assert abs(value - I.log_likelihood(f.full(x[None]), row.letters, row.left, row.right, row.lengths, c, 10.0)[0]) < 1e-9


def test_equilibrium_slope_of_rates():
    rng = np.random.default_rng(4)
    c = rng.random((20, 20)) / 20
    x, weight = rng.normal(0, 2, 20), rng.random(20)
    g = M.rates(x, c)
    slope = M.rates_slope(x, c, np.outer(M.group_inverse(-g).T @ weight, M.equilibrium(g)))
    for k in range(20):
        e = np.eye(20)[k] * 1e-5
        up, down = (weight @ M.equilibrium(M.rates(y, c)) for y in (x + e, x - e))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-7


def test_trees_of_all_rows(spark):
    rows = [("f", i, f"s{i}", "A" * (i // 2) + "C" * (40 - i // 2)) for i in range(80)] + [("g", 1, "one", "AC")]
    aln = spark.createDataFrame(rows, "family string, pos long, header string, seq string")
    for kind in ("UPGMA", "NJ"):
        got = {r.family: r.newick for r in C.distance_trees(aln, kind).collect()}
        assert all(f"s{i}:" in got["f"] for i in range(80)) and got["g"] == "one;"


def residue_rows(spark, sites=3):
    """Rows of a tree of five tips in which one node has two internal children."""
    tree = ([0, 2, -1, -3], [1, 3, -2, 4], [0.1, 0.25, 0.4, 0.1, 0.2, 0.3, 0.15, 0.5])
    rows = [(1, i, "AC-DA" if i % 2 else "KLLKI", *tree) for i in range(1, sites + 1)]
    return spark.createDataFrame(rows, "tree_id long, site int, letters string, left array<int>, right array<int>, lengths array<double>")


def even_mutations():
    c = np.full((20, 20), 0.01)
    np.fill_diagonal(c, 0)
    return c


def test_levels_come_after_their_children():
    left, right = [0, 2, -1, -3, 5, -4], [1, 3, -2, 4, 6, -5]
    seen = set()
    groups = I.levels(left, right, 2)
    for g in groups:
        assert len(g) <= 2 and all(k >= 0 or -1 - k in seen for i in g for k in (left[i], right[i]))
        seen |= {int(i) for i in g}
    assert sum(map(len, groups)) == 6 and seen == set(range(6))


def test_coupled_chains_resume_exactly(spark):
    rows, c = residue_rows(spark), even_mutations()
    whole = {(r.site, r.step): (r.log_posterior, r.swapped) for r in I.coupled(rows, c, 10.0, 1.0, 0.0, 12).collect()}
    half = I.coupled(rows, c, 10.0, 1.0, 0.0, 5)
    rest = I.coupled(I.resumed(rows, half), c, 10.0, 1.0, 0.0, 7)
    parts = {(r.site, r.step): (r.log_posterior, r.swapped) for r in half.unionByName(rest).collect()}
    assert len(whole) == 36 and whole == parts
    assert len({r.swapped for r in half.unionByName(rest).collect()}) == 2
    places = {r.site: r.places for r in rest.filter("step = 12").collect()}
    assert all(len(p) == 3 and len(p[0]) == 19 for p in places.values())
    assert rest.filter("step < 12 and places is not null").isEmpty()


def test_chain_means_over_the_last_steps(spark):
    trace = I.chains(residue_rows(spark, 1), even_mutations(), 10.0, 1.0, 0.0, 6)
    got = I.window_means(trace, 3).orderBy("step").collect()
    v = [r.log_posterior for r in got]
    assert np.allclose([r.mean_posterior for r in got], [np.mean(v[max(0, i - 2) : i + 1]) for i in range(6)])


def test_given_centers_and_starts(spark):
    rows, c = residue_rows(spark, 2), even_mutations()
    given = spark.createDataFrame([(1, "C", 3.0), (1, "D", None), (1, "-", 9.0)], "site int, mut string, ddg double")
    own = {r.site: r.center for r in I.with_stabilities(rows, given).collect()}
    assert own[2] is None and own[1] == [0.0, 3.0] + [0.0] * 18
    flat = I.Posterior(SimpleNamespace(letters="AC", center=own[1]), c, 10.0, 1.0, 0.0)
    assert flat.center[1] == 3.0 and flat.center[2] == 0.0
    found = I.maximize(I.with_stabilities(rows, given, "initial"), c, 10.0, 1.0, 0.0, 2).collect()
    plain = {r.site: r.log_posterior for r in I.maximize(rows, c, 10.0, 1.0, 0.0, 2).collect()}
    assert all(abs(r.log_posterior - plain[r.site]) < 1e-2 for r in found)


def test_totals_of_trees(spark):
    each = I.probabilities(residue_rows(spark), even_mutations(), 10.0, 1.0, 0.0)
    rows = each.collect()
    t = I.totals(each).first()
    assert t.sites == 3 and abs(t.log_posterior - sum(r.log_likelihood + r.log_prior for r in rows)) < 1e-9
