"""Steps whose work or memory grew faster than their input."""

import itertools
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from stabilis.operators import alignment as A
from stabilis.operators import ancestral as B
from stabilis.operators import clusters as C
from stabilis.operators import inference as I
from stabilis.operators import stepwise as W
from stabilis.operators import trees as T


def caterpillar(tips):
    """left, right and lengths of a tree in which each node has one tip beside all others."""
    left, right = [0] + [-1 - i for i in range(tips - 2)], [i + 1 for i in range(tips - 1)]
    return left, right, [x for i in range(tips - 1) for x in (0.05 if i else 1.2, (i % 7 + 1) / 10)]


def test_sites_of_a_tree_are_worked_out_together(monkeypatch):
    """Values and slopes are those of each site by itself, and are found with as many steps along the tree as for one."""
    rng, tree = np.random.default_rng(5), caterpillar(12)
    c = rng.random((20, 20)) * (rng.random((20, 20)) < 0.5) / 20
    each = []
    for _ in range(6):
        row = SimpleNamespace(letters="".join(rng.choice(list("ACDEFGHIK-"), 12)))
        row.left, row.right, row.lengths = tree
        each.append(I.Posterior(row, c, 10.0, 1.0, 0.0))
    x = rng.normal(0, 3, (6, 19))
    alone = np.array([f(y)[0] for f, y in zip(each, x, strict=True)])
    slopes = np.array([f.gradient(y) for f, y in zip(each, x, strict=True)])
    by_series = np.array([I.upward_by_series(I.model.rates(f.full(y[None])[0], c), I.Tree(*tree, 10.0), I.letter_codes([f.row.letters])[0]) for f, y in zip(each, x, strict=True)])
    steps = []
    through = I.through
    monkeypatch.setattr(I, "through", lambda *a: steps.append(1) or through(*a))
    f, every = I.Sites(each), np.arange(6)
    assert np.allclose(f.parts(every, x)[0], by_series, rtol=1e-9)
    assert len(steps) <= 2 * 10  # once up the tree for generators with real eigenvalues, once for others
    assert np.array_equal(f(every, x), alone) and np.allclose(f.gradient(every, x), slopes, rtol=1e-9, atol=1e-9)
    got = I.ascents(f, every, x, 5, 1e-7)
    for k in range(6):
        one = I.ascents(f, every[k : k + 1], x[k : k + 1], 5, 1e-7)
        assert np.allclose(got[1][k], one[1][0], rtol=1e-9) and got[2][k] == one[2][0]


def test_sites_are_dealt_together(spark):
    rows = spark.range(640).selectExpr("id div 64 as tree_id", "cast(id % 64 + 1 as int) as site", "array('x') as tips")
    run = lambda df: df[["tree_id", "site"]].assign(n=len(df))
    got = I.worked(rows, run, "tree_id long, site int, n long").collect()
    assert len(got) == 640 and max(r.n for r in got) == I.TOGETHER and min(r.n for r in got if r.site < 64) == I.TOGETHER - 1
    parts = B.dealt_together(rows.drop("tips")).selectExpr("tree_id", "spark_partition_id() as p").distinct().count()
    assert parts <= 50  # at most five groups of each tree


def random_tree(rng, names):
    if len(names) == 1:
        return f"{names[0]}:0.1"
    k = rng.randint(1, len(names) - 1)
    return f"({random_tree(rng, names[:k])},{random_tree(rng, names[k:])}):0.1"


def test_nodes_without_paths(spark):
    """A deep tree has no column that grows with the square of its tips, and interior nodes keep their order."""
    rng = random.Random(3)
    texts = [(k, random_tree(rng, [f"t{i}" for i in range(n)]).removesuffix(":0.1") + ";") for k, n in enumerate([2, 3, 9, 30])]
    given = spark.createDataFrame(texts, "tree_id long, newick string")
    whole, bare = T.nodes(given), T.nodes(given, paths=False)
    assert sorted(map(tuple, whole.drop("path").collect())) == sorted(map(tuple, bare.collect()))
    for k, n in enumerate([2, 3, 9, 30]):
        paths = {r.node_id: r.path for r in whole.filter(f"tree_id = {k} and not is_tip").collect()}
        place = {r.node_id: r.place for r in B.named_interiors(bare).filter(f"tree_id = {k}").collect()}
        assert sorted(paths, key=paths.get) == sorted(place, key=place.get) and len(place) == n - 1
    deep = "(" * 29_999 + "t0:1" + "".join(f",t{i}:1):1" for i in range(1, 30_000)).removesuffix(":1") + ";"
    sizes = [b.num_rows for b in T._nodes(False)([SimpleNamespace(column=lambda c: SimpleNamespace(to_pylist=lambda: [1 if c == "tree_id" else deep]))])]
    assert sum(sizes) == 59_999 and max(sizes) == T.ROWS


def test_only_windows_that_may_be_meant_are_handed_on(spark, monkeypatch):
    """Rows of 60 letters that hold none of the others have few windows to shuffle, not one for each place."""
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACDEFGHIKL") for _ in range(60 - i % 9)) for i in range(300)]
    seqs += [seqs[0][5:53], seqs[1][:50], seqs[2][20:27], "ZZ", "Z", "", None, "é" + seqs[3][30:44], seqs[3][30:44]]
    batch = pa.RecordBatch.from_pydict({"uid": list(range(len(seqs))), "letters": seqs, "h": [7] * len(seqs), "family": ["f"] * len(seqs)})
    keys = [k for b in A.heads([batch]) for k in zip(b.column("key").to_pylist(), b.column("w").to_pylist(), strict=True)]
    wanted = np.zeros(A.MAP_BITS // 64, np.int64)
    for k, _ in keys:
        wanted[k % A.MAP_BITS // 64] |= np.array(1 << (k % A.MAP_BITS % 64), np.uint64).view(np.int64)
    sizes = sorted({w for _, w in keys})
    assert sizes == [0, 1, 2, 7, 12, 48]
    assert sum(b.num_rows for b in A.looked_for(sizes, wanted)([batch])) < 2 * len(seqs)
    monkeypatch.setattr(A, "NAMED", 100)  # slices of few rows give the same
    rows = [(f, i, f"h{i}", s) for f, (i, s) in itertools.product(("f", "g", None), enumerate(seqs))]
    got = A.contained(spark.createDataFrame(rows, "family string, pos long, header string, seq string")).collect()
    gone = {i for i, s in enumerate(seqs) if s is not None and any(o is not None and s != o and s in o for o in seqs)}
    assert len(gone) == 6
    every = set(range(len(seqs)))
    assert {r.pos for r in got if r.family == "f"} == {r.pos for r in got if r.family == "g"} == every - gone
    assert {r.pos for r in got if r.family is None} == every


def plain_tree(names, d, kind):
    """The joins by looking at all pairs in each step."""
    d, text, size, height = d.copy(), list(names), [1] * len(names), [0.0] * len(names)
    for n in range(len(names), 1, -1):
        total = d.sum(0)
        q = d.copy() if kind == "UPGMA" or n == 2 else (n - 2) * d - total - total[:, None]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), n))
        if kind == "UPGMA":
            a, b, row = d[i, j] / 2 - height[i], d[i, j] / 2 - height[j], (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            height[i] = d[i, j] / 2
        else:
            turn = (total[i] - total[j]) / (2 * (n - 2)) if n > 2 else 0.0
            a, b, row = d[i, j] / 2 + turn, d[i, j] / 2 - turn, (d[i] + d[j] - d[i, j]) / 2
        text[i] = f"({text[i]}:{max(a, 0.0):.6f},{text[j]}:{max(b, 0.0):.6f})"
        size[i] += size[j]
        d[i], d[:, i] = row, row
        d[i, i] = 0
        d = np.delete(np.delete(d, j, 0), j, 1)
        for x in (text, size, height):
            del x[j]
    return text[0] + ";"


def test_joins_look_at_few_pairs(monkeypatch):
    """Trees are those of looking at all pairs, ties too; by averages a join looks anew at few rows, and joining takes some rows at a time."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(C, "NEAR", 64)
    for n in (1, 2, 3, 5, 20, 60):
        a = rng.choice(4, (n, 12))
        d = np.stack([(a != x).mean(1) for x in a])
        for kind in ("UPGMA", "NJ"):
            assert C.joined_tree([f"s{i}" for i in range(n)], d, kind) == plain_tree([f"s{i}" for i in range(n)], d, kind)
    assert C.least_joining(d, np.zeros(60, bool), d.sum(0), 60)[0] < 60


def test_trees_of_least_squares_in_a_task_each(spark, monkeypatch):
    """Those of small families are the same as by rounds of jobs, with missing and equal distances too."""
    rng = random.Random(2)
    far = [(k, f"t{a}", f"t{b}", rng.choice([0.0, None, 0.5, rng.uniform(0.1, 2), rng.uniform(0.1, 2)])) for k, n in enumerate([2, 3, 5, 6]) for a, b in itertools.combinations(range(n), 2)]
    far = spark.createDataFrame(far, "tree_id long, a string, b string, distance double")
    told = lambda: {r[:2]: r[2:] for r in W.least_squares_trees(far).select("tree_id", "node", "parent", "side", "name", "branch").collect()}
    with monkeypatch.context() as m:
        m.setattr(W, "grown_by_joins", lambda *_: 1 / 0)
        got = told()
    monkeypatch.setattr(W, "HELD", 4)
    want = told()
    assert got.keys() == want.keys()
    for k in got:
        assert got[k][:3] == want[k][:3] and np.allclose(*(np.array([x[k][3]], float) for x in (got, want)), atol=1e-7, equal_nan=True), (k, got[k], want[k])


def test_whole_sets_are_written_of_close_classes_only(spark, monkeypatch):
    """Texts that share many shingles, but too few, are told apart without a table of their sets."""
    from stabilis.llm import jaccard_join as J

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    half = [" ".join(word() for _ in range(35)) for _ in range(40)]
    rows = [(i, f"{half[i]} {half[i - 1]}") for i in range(40)]
    near = [word() for _ in range(60)]
    rows += [(50, " ".join(near)), (51, " ".join([*near[:-1], word()]))]
    sizes, checkpoint = {}, J.checkpoint

    def told(df):
        out = checkpoint(df)
        for c in {"tokens", "head"} & set(out.columns):
            sizes[c] = sizes.get(c, 0) + out.count()
        return out

    monkeypatch.setattr(J, "checkpoint", told)
    members, links = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in J.least_ids(members).collect()} == {i: min(i, 50) for i, _ in rows}
    assert links.count() == 1 and sizes["tokens"] == 2 and sizes["head"] > 20


def test_condensing_hands_on_only_rows_with_company(spark, monkeypatch):
    """Rows that agree with no other in a part are neither shuffled with their letters nor part of the rounds; the pass is the greedy one."""
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60)) for _ in range(200)]
    for k, s in enumerate(seqs[:6]):
        for _ in range(4):
            i = [rng.randrange(60) for _ in range(k % 3 + 1)]
            seqs.append("".join(rng.choice("AC") if j in i else c for j, c in enumerate(s)))
    seqs += [s[:k] + "-" * (60 - k) for k in (1, 2, 5) for s in seqs[:3]]
    rng.shuffle(seqs)
    kept: list[tuple[int, str]] = []
    for p, s in enumerate(seqs):
        if not any(s[0] == o[0] and sum(x != y for x, y in zip(s, o, strict=True)) <= 3 or s == o for _, o in kept):
            kept.append((p, s))
    sizes, stored = [], C.stored

    def told(df):
        out = stored(df)
        sizes.append(0 if "header" in out.columns else out.count())
        return out

    monkeypatch.setattr(C, "stored", told)
    rows = [(f, p, f"h{p}", s) for f in ("f", "g") for p, s in enumerate(seqs)]
    got = C.condense(spark.createDataFrame(rows, "family string, pos long, header string, seq string"), 3, (1,)).collect()
    assert sorted((r.family, r.pos) for r in got) == [(f, p) for f in ("f", "g") for p, _ in kept]
    assert 0 < max(sizes) < 2 * 200
