"""SimHash near duplicates against plain code."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from stabilis.llm import queries, simhash_dedup


def plain_fingerprint(text):
    words = (text or "").encode("utf-8", "surrogateescape").lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(ids, fps):
    """Least id reachable and number of other rows within three bits, over all pairs."""
    near = [[j for j, y in enumerate(fps) if j != i and (x ^ y).bit_count() <= 3] for i, x in enumerate(fps)]
    least, seen = [None] * len(fps), set()
    for i in range(len(fps)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - group
            group |= new
            todo += new
        known = [ids[j] for j in group if ids[j] is not None]
        for j in group:
            least[j] = min(known) if known else None
        seen |= group
    return least, [len(x) for x in near]


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("the of a to and in is it you that he was for on are with as".split()) + rng.choice(["", "", str(rng.randrange(40))])
    texts = [" ".join(word() for _ in range(rng.choice([5, 40, 200, 900]))) for _ in range(60)]
    for t in list(texts[:30]):
        for k in (1, 2, 5):
            w = t.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [texts[0]] * 40 + [None, "", " \t\n", "one", "One", "one two", "ONE\x0btwo", "café Été Été x", "a b c", "A B c"]
    texts.append(" ".join(word() for _ in range(40_000)))
    return [(i if i % 17 else None if i % 2 else 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block_rows", [simhash_dedup.BLOCK_ROWS, 4])
def test_equals_all_pairs(spark, block_rows):
    rows = corpus()
    fps = [plain_fingerprint(t) for _, t in rows]
    least, links = plain_groups([i for i, _ in rows], fps)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("fp", F.lit("clash")).withColumn("n", F.lit(1))
    got = simhash_dedup.near_duplicates(d, block_rows=block_rows).collect()
    want = sorted(((i, f, c, n) for (i, _), f, c, n in zip(rows, fps, least, links, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id, r.n_links) for r in got), key=repr) == want


def test_cloud_of_close_fingerprints():
    """Chains of single bits, so that few links are direct: a forest has to hold all groups together."""
    import numpy as np

    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(400):
        fps.append(rng.choice(fps) ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3, 5]))))
    fps = sorted(set(fps))
    a = np.array(fps, np.uint64)
    label = np.arange(len(a))
    for i, j in simhash_dedup.matches(a, a, 3, True):
        label = simhash_dedup.hooked(label, i, j)
    assert label.tolist() == plain_groups(list(range(len(fps))), fps)[0]


def test_halves_of_a_step():
    every = {(x, y) for x in range(-3, 4) for y in range(-3, 4) if abs(x) + abs(y) <= 3}
    half = simhash_dedup.reach(3)
    assert len(half) == 13 and {*half, *((-x, -y) for x, y in half)} == every


def test_bytes_and_empty_table(spark):
    d = spark.sql("select 1L as doc_id, cast(X'68e9ff20c3' as string) as text union all select 2L, cast(X'68e9ff20c3' as string)")
    got = simhash_dedup.near_duplicates(d).collect()
    assert {r.fp % (1 << 64) for r in got} == {xxhash.xxh64(b"h\xe9\xff \xc3", seed=42).intdigest()} and {r.component_id for r in got} == {1}
    assert simhash_dedup.near_duplicates(d.filter("doc_id > 5")).count() == 0


def test_query(spark, sf):
    got = queries.op11_simhash_dedup(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = [r.doc_id for r in got]
    fps = [plain_fingerprint(text[i]) for i in ids]
    least, links = plain_groups(ids, fps)
    assert [(r.fingerprint, r.component_id, r.n_links) for r in got] == [(f"{f:016x}", c, n) for f, c, n in zip(fps, least, links, strict=True)] and len(got) == len(text)
