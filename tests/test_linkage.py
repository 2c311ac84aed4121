"""Single linkage and connected components against plain code."""

import random

import pytest

from stabilis.operators import clusters as C
from stabilis.operators import graphs, linkage


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def groups(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def plain_clusters(rows, identity, coverage):
    keep = [(f, p, (s or "").replace("-", "").upper()) for f, p, s in rows]
    near = lambda a, b: 1000 * distance(a, b) <= (1000 - round(1000 * identity)) * max(len(a), len(b)) and 1000 * min(len(a), len(b)) >= round(1000 * coverage) * max(len(a), len(b))
    pairs = [((x[0], x[1]), (y[0], y[1])) for i, x in enumerate(keep) for y in keep[:i] if x[0] == y[0] and near(x[2], y[2])]
    label = groups([(f, p) for f, p, _ in keep], pairs)
    size = {c: list(label.values()).count(c) for c in label.values()}
    return sorted((f, p, c, size[f, c]) for (f, p), (_, c) in label.items())


def mutated(s, rng, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice("ACDE"))
        elif s and i < len(s):
            s[i : i + 1] = rng.choice("ACDE") if kind == 1 else ""
    return "".join(s)


@pytest.mark.parametrize(("identity", "coverage"), [(0.98, 0.9), (0.9, 0.9), (0.8, 0.95), (0.6, 0.5)])
def test_clusters_equal_all_pairs(spark, identity, coverage):
    rng = random.Random(int(100 * identity))
    rows = []
    for f in "pq":
        seqs = ["".join(rng.choice("ACDE") for _ in range(rng.choice([1, 3, 12, 25, 40, 60]))) for _ in range(12)]
        for s in list(seqs):
            seqs += [mutated(s, rng, k) for k in (1, 2, 4)]
        seqs += [seqs[0].lower(), seqs[1][:1] + "-" + seqs[1][1:], "", "--", None]
        rows += [(f, i + 3, s) for i, s in enumerate(seqs)]
    got = linkage.single_linkage(spark.createDataFrame(rows, "family string, pos long, seq string"), identity, coverage)
    assert sorted(map(tuple, got.collect())) == plain_clusters(rows, identity, coverage)


def test_rows_with_one_end_in_common_are_not_compared_in_pairs(spark, monkeypatch):
    """Many rows begin or end alike, few are linked: what is looked at stays in proportion to the rows."""
    rng = random.Random(22)
    word = lambda n: "".join(rng.choice("ACDE") for _ in range(n))
    head, tail = word(30), word(30)
    seqs = [head + word(rng.randint(19, 30)) for _ in range(60)] + [word(rng.randint(19, 30)) + tail for _ in range(60)]
    for s in seqs[::7]:
        i = rng.randrange(len(s) + 1)
        seqs += [s[:i] + s[i + 1 :], s[:i] + "K" + s[i:], s[:i] + "K" + s[i + 1 :], s]
    rows = [("pq"[i % 3 == 0], i + 3, s) for i, s in enumerate(seqs)] + [(None, 1, head)]
    pairs, met, candidates, by_one = [], [], linkage.candidates, getattr(linkage, "linked_by_one", None)

    def counted(into, f):
        return lambda *a: (df := f(*a), into.append(df.count()))[0]

    monkeypatch.setattr(linkage, "candidates", counted(pairs, candidates))
    monkeypatch.setattr(linkage, "linked_by_one", counted(met, by_one), raising=False)
    got = linkage.single_linkage(spark.createDataFrame(rows, "family string, pos long, seq string"), 0.98, 0.9)
    assert sorted(map(tuple, got.collect())) == plain_clusters(rows[:-1], 0.98, 0.9)
    assert sum(pairs) == 0 and 0 < sum(met) < 2 * len(rows)


def test_short_rows_of_one_edit_and_more(spark):
    rows = [("p", i, s) for i, s in enumerate(["", "A", "C", "AC", "CA", "DD", "DDE", "EEE", "EFE", "KLMN", "KMNL", "LLLL"])]
    for coverage in (0.5, 0.7, 1):
        got = linkage.single_linkage(spark.createDataFrame(rows, "family string, pos long, seq string"), 0.5, coverage)
        assert sorted(map(tuple, got.collect())) == plain_clusters(rows, 0.5, coverage)


def test_thresholds_and_empty_table(spark):
    empty = spark.createDataFrame([], "family string, pos long, seq string")
    assert linkage.single_linkage(empty).count() == 0
    with pytest.raises(ValueError):
        linkage.single_linkage(empty, 0.4)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(1000, 1600)] + [(0, i) for i in range(1, 200)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(220)] + [(7, 7), (9000, 9000)]
    rng.shuffle(pairs)
    got = dict(map(tuple, graphs.components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    real = [p for p in pairs if p[0] != p[1]]
    want = groups({n for p in real for n in p}, real)
    assert got == want
    assert graphs.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_strict_values_of_a_structure(spark):
    from stabilis.operators import ddg as D

    ddg = [("f", 1, "A", "C", 1.0), ("f", 1, "A", "D", 2.0), ("f", 2, "K", "C", 0.5)]
    table = lambda rows: spark.createDataFrame(rows, "family string, r int, wt string, mut string, ddg double")
    pairs = lambda rows: spark.createDataFrame(rows, "family string, r int, prot string, wt string")
    good = D.rebased(table(ddg), pairs([("f", 1, "C", "A"), ("f", 2, "K", "K")]), strict=True)
    assert sorted((r.r, r.wt, r.mut, r.ddg) for r in good.collect()) == [(1, "C", "A", -1.0), (1, "C", "D", 1.0), (2, "K", "C", 0.5)]
    for rows, wanted, why in ((ddg + ddg[:1], [("f", 1, "A", "A")], "two values"), (ddg, [("f", 3, "A", "A")], "no value"), (ddg, [("f", 1, "W", "A")], "no value")):
        with pytest.raises(Exception, match=why):
            D.rebased(table(rows), pairs(wanted), strict=True).collect()


def test_consensus_of_several_methods(spark):
    from stabilis.operators import ddg as D

    counts = spark.createDataFrame([("f", 1, a, n) for a, n in (("A", 9), ("C", 3), ("D", 0))], "family string, site int, aa string, n long")
    refs = spark.createDataFrame([("f", 1, "A")], "family string, site int, wt string")
    every = {(r.method, r.mut): r.ddg for r in D.consensus_by(counts, refs, {"x": (1, 0), "y": (0, 1), "z": (2, 4)}).collect()}
    for name, p, t in (("x", 1, 0), ("y", 0, 1), ("z", 2, 4)):
        assert {r.mut: r.ddg for r in D.consensus(counts, refs, p, t).collect()} == {m: v for (k, m), v in every.items() if k == name}
    assert every["y", "D"] is None and every["z", "C"] is not None and every["z", "D"] is None


def test_average_linkage_in_a_task_and_by_joins(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f, i, j, rng.randint(1, 9) / 8) for f, n in ((1, 9), (2, 5), (3, 2)) for i in range(n) for j in range(i + 1, n)]
    d = spark.createDataFrame(rows, "family long, a long, b long, distance double")
    told = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("family", "first", "size", "side", "parent_first", "parent_size", "branch", "height").na.fill("").na.fill(-1).collect())
    one = told(C.average_linkage(d))
    with monkeypatch.context() as m:
        m.setattr(C, "HELD", 4)  # only the last family is held
        assert told(C.average_linkage(d)) == one
    # rounds without jobs: the plan is one of groups
    m = monkeypatch
    m.setattr(C, "linked_by_joins", None)
    assert len(told(C.average_linkage(d))) == 17 + 9 + 3
