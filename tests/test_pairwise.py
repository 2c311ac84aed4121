"""Global alignments against the plain recursion."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stabilis.operators import pairwise as P


def best_score(a, b, how):
    """The three-state recursion, one cell at a time."""
    never = -(10**9)
    h = [[never] * (len(b) + 1) for _ in range(len(a) + 1)]
    u, v = [list(r) for r in h], [list(r) for r in h]
    h[0][0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                u[i][j] = max(h[i - 1][j] - how.gap_open, u[i - 1][j] - how.gap_extend)
            if j:
                v[i][j] = max(h[i][j - 1] - how.gap_open, v[i][j - 1] - how.gap_extend)
            pair = h[i - 1][j - 1] + how.scores[ord(a[i - 1]), ord(b[j - 1])] if i and j else never
            h[i][j] = max(h[i][j], pair, u[i][j], v[i][j])
    return int(h[-1][-1])


def score_of(one, two, how):
    total, last = 0, None
    for x, y in zip(one, two, strict=True):
        assert x != "-" or y != "-"
        gap = "a" if x == "-" else "b" if y == "-" else None
        total += how.scores[ord(x), ord(y)] if gap is None else -(how.gap_extend if gap == last else how.gap_open)
        last = gap
    return int(total)


def solved(pairs, how):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]})
    (out,) = P.aligner("a", "b", how)([batch])
    return out.to_pylist()


def some_pairs(rng, n, longest):
    out = []
    for _ in range(n):
        a = "".join(rng.choice("ACDEFG") for _ in range(rng.randrange(longest)))
        b = list(a)
        for _ in range(rng.randrange(8)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(5)] = rng.choice(["", "A", "CD", "EEEE"])
        out.append((a, "".join(b) if rng.random() < 0.8 else "".join(rng.choice("ACDEFG") for _ in range(rng.randrange(longest)))))
    return out


ODD = np.random.default_rng(3).integers(-6, 9, (128, 128))
HOW = [P.Scoring.plain(), P.Scoring.plain(2, -3, 5, 5), P.Scoring.plain(1, -1, 3, 0), P.Scoring((ODD + ODD.T).astype(np.int32), 7, 2)]


@pytest.mark.parametrize("how", HOW)
def test_scores_equal_recursion(how):
    rng = random.Random(1)
    pairs = [("", ""), ("", "ACD"), ("A", ""), ("A", "C"), ("AAAA", "A"), *some_pairs(rng, 120, 40)]
    for (a, b), r in zip(pairs, solved(pairs, how), strict=True):
        assert r["score"] == best_score(a, b, how) == score_of(r["aligned_a"], r["aligned_b"], how)
        assert (r["aligned_a"].replace("-", ""), r["aligned_b"].replace("-", "")) == (a, b)
        z = list(zip(r["aligned_a"], r["aligned_b"], strict=True))
        assert (r["columns"], r["identical"], r["gaps"]) == (len(z), sum(x == y for x, y in z), sum("-" in x for x in z))
        assert r["placed"] == "".join(x for x, y in z if y != "-")


@pytest.mark.parametrize("how", HOW)
def test_bands_widen_until_proven(how, monkeypatch):
    monkeypatch.setattr(P, "SHORT", 0)
    monkeypatch.setattr(P, "BAND", 1)
    monkeypatch.setattr(P, "CELLS", 3000)
    pairs = some_pairs(random.Random(2), 80, 60)
    assert [r["score"] for r in solved(pairs, how)] == [best_score(a, b, how) for a, b in pairs]


def test_long_pair():
    rng = random.Random(5)
    a = "".join(rng.choice(P.LETTERS) for _ in range(6000))
    b = a[:1000] + a[1100:3000] + "W" * 30 + a[3000:]
    (r,) = solved([(a, b)], P.Scoring.plain())
    assert r["score"] == 5 * 5900 - (10 + 99) - (10 + 29) and r["gaps"] == 130


def test_table(spark):
    rows = [("f", 2, "x", "acd-ef"), ("f", 1, "ref", "ACDEEFF"), ("f", 3, "y", "WWACDEEFF"), ("g", 9, "z", ""), ("g", 10, "n", None), ("g", 11, "m", "AC")]
    d = spark.createDataFrame(rows, "family string, pos long, header string, seq string").withColumn("score", F.lit("clash"))
    got = {r.pos: r for r in P.to_reference(d).collect()}
    assert (got[1].seq, got[1].identity, got[1].gaps) == ("ACDEEFF", 1.0, 0.0)
    assert got[2].seq.replace("-", "") == "ACDEF" and len(got[2].seq) == 7 and got[2].identity == 1.0 and got[2].gaps == 2 / 7
    assert got[3].seq == "ACDEEFF" and got[3].gaps == 2 / 9
    assert (got[9].seq, got[9].identity, got[9].gaps) == ("", None, None) and got[10].seq is None and (got[11].seq, got[11].gaps) == ("", 1.0)
    assert {r.pos for r in P.screened(d, 0.9, 0.25).collect()} == {1, 3}
    assert P.aligned(spark.createDataFrame([], "a string, b string")).count() == 0
    with pytest.raises(ValueError):
        P.Scoring.plain(gap_open=1, gap_extend=2)


def test_scores_of_an_alignment(spark):
    rows = [("f", i, "h", s) for i, s in enumerate(["AAC", "AAC", "AC-", "CCC"])]
    d = spark.createDataFrame(rows, "family string, pos long, header string, seq string")
    got = {(r.x, r.y): r.score for r in P.substitution_scores(d).collect()}
    # columns AAAC, AACC, CC_C: 4 pairs AA, 7 AC, 4 CC
    half = {"A": 7.5, "C": 7.5}
    q = {("A", "A"): 4, ("A", "C"): 7, ("C", "C"): 4}
    assert got == {k: round(2 * np.log2(n / (half[k[0]] * half[k[1]] * (1 if k[0] == k[1] else 2) / 15))) for k, n in q.items()}
    how = P.Scoring.of_table(P.substitution_scores(d))
    assert how.scores[ord("C"), ord("A")] == got["A", "C"] and how.scores[ord("W"), ord("A")] == -4
