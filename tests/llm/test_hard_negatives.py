"""Hard negatives against plain code."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stabilis.llm import hard_negatives

SCHEMA = "id long, label long, vector array<double>"


def plain(rows, positives=5, negatives=10, low=30, high=90):
    ok = lambda i, y, v: i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if ok(i, y, v)]
    out = []
    for i, y, v in rows:
        if i % 10:
            continue
        all_ = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in rows if j != i and len(v) == len(w)]
        for k, (s, j, _) in enumerate(sorted(x for x in all_ if x[2] == y)[:positives]):
            far = sorted(x for x in all_ if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s and low == 30 and high == 90)[:negatives]
            out += [(i, j, k + 1, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(far)]
    return sorted(out)


def vectors(n, dim, clusters, rng):
    """Clouds around a few directions, so that zone maps rule blocks out, and equal rows."""
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    rows = [(i, rng.randrange(3), [m + rng.gauss(0, 0.2) for m in rng.choice(middle)]) for i in range(n)]
    return rows + [(n + k, k % 3, rows[5][2]) for k in range(20)] + [rows[10], rows[11], rows[20]]


def odd(rng):
    nan, inf = float("nan"), float("inf")
    return [(None, 1, [1.0] * 4), (1000, None, [1.0] * 4), (1010, 1, None), (1020, 1, []), (1030, 1, [1.0, None, 1.0, 1.0]), (1040, 1, [nan, 1.0, 1.0, 1.0]), (1050, 1, [inf] * 4), (1060, 1, [0.5, 0.5]), (1061, 1, [0.5, 0.4]), (1062, 2, [0.3, 0.4]), (1070, 77, [0.9] * 4), (1080, 0, [0.0] * 4), (1090, 1, [3e5, 1.0, -2.0, 1e5]), (1091, 1, [3e5, 1.0, -2.0, 1e5]), (1092, 2, [2e5, 1.0, -2.0, 1e5])]


@pytest.mark.parametrize(("row_block", "group"), [(2048, 2048), (16, 3)])
def test_equals_plain_code(spark, row_block, group):
    rng = random.Random(row_block)
    rows = vectors(160, 4, 6, rng) + odd(rng)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("uid", F.lit("clash")).withColumn("win", F.lit(0))
    got = hard_negatives.mine(d, F.col("id") % 10 == 0, row_block=row_block, group=group).collect()
    want = plain(rows)
    assert sorted(tuple(r) for r in got) == want and len(want) > 400


def test_empty(spark):
    d = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0])], SCHEMA)
    assert hard_negatives.mine(d.filter("id > 9"), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(d, F.col("id") % 10 == 0).count() == 0


def test_huge_components(spark):
    rows = [(0, 1, [1e6, 3e6]), (1, 1, [1e6, 3e6 + 1 / 256]), (2, 1, [1e6, 3e6]), (3, 2, [5e5, 1e6]), (4, 2, [5e5, 1e6 + 1 / 256])]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain(rows) and [r.negative_id for r in got] == [4, 3, 4, 3]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_moves_one_step_at_a_time(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hard_negatives.hilbert(cells, bits)]
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_rule_out(spark):
    """Every score lies within the bounds of its block, and far blocks aren't chosen."""
    rng = random.Random(2)
    rows = [(i, 0, v) for i, _, v in vectors(600, 6, 12, rng)]
    library = hard_negatives.Library(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0, row_block=16)
    ready = library.ready(library.members.select("uid", F.lit(0).cast("long").alias("win"), F.lit(300_000).cast("long").alias("lo"), F.lit(hard_negatives.MOST).alias("hi")))
    chosen = library.chosen(ready, True, None).distinct().count()
    assert 0 < chosen < library.blocks.count() * library.groups.count()
    for b in library.blocks.limit(5).toArrow().to_batches():
        for r in ready.limit(3).toArrow().to_batches():
            for i in range(b.num_rows):
                for j in range(r.num_rows):
                    g, zone = hard_negatives.Group(r, j), np.frombuffer(b.column("zone")[i].as_py())
                    x = hard_negatives.matrix(b.column("vectors")[i].as_py(), len(b.column("ids")[i].as_py()) // 8, 6)
                    low, high = g.bounds(zone[None, :])
                    score = g.vectors @ x.T
                    assert (score >= low).all() and (score <= high).all()
