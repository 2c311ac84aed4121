"""Periodic runs against plain code."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stabilis.llm import periodic_runs, queries


def plain_runs(words, least=24, times=3):
    """Every maximal stretch of every lag, those of a multiple of a smaller period left out."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if j > i and len(stretch) >= max(least, times * q) and not any(all(stretch[t] == stretch[t + r] for t in range(len(stretch) - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode("utf-8", "surrogateescape").split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    left = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(b" ".join(left)))


words_of = st.lists(st.sampled_from("ab"), min_size=1, max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(words_of, st.integers(1, 14)), max_size=8), st.sampled_from([(24, 3), (5, 3), (1, 3), (30, 4), (7, 5)]))
def test_runs_equal_plain_code(parts, how):
    words = [w.encode() for part, n in parts for w in part * n]
    assert periodic_runs.runs(words, *how) == plain_runs(words, *how)


@pytest.mark.parametrize("seed", range(6))
def test_long_periods_in_long_periods(seed):
    """Periods that are made of repetitions, so that grams recur inside a period."""
    rng = random.Random(seed)
    piece = [rng.choice("abc") for _ in range(rng.randrange(2, 30))]
    for _ in range(3):
        piece = piece * rng.randrange(2, 5) + [rng.choice("abcd") for _ in range(rng.randrange(4))]
    words = [w.encode() for w in (piece * 4)[: 700 + seed]]
    assert periodic_runs.runs(words) == plain_runs(words)


def test_one_word_over_and_over():
    words = [b"x"] * 200_000 + [b"y"] + [b"x", b"z"] * 100_000
    assert periodic_runs.runs(words) == [(0, 200_000, 1), (200_001, 200_000, 2)]
    assert periodic_runs.kept(words, periodic_runs.runs(words)) == [b"x", b"y", b"x", b"z"]


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice("the of a to and in is it".split()) + str(rng.randrange(9)) for _ in range(n))
    loop = " ".join((prose(7) + " ") * 5 for _ in range(3))
    rows = [(i, rng.choice([prose(rng.randrange(90)), loop + prose(5), "x " * rng.randrange(60), prose(3) + "\t\x0b" + "ÄÖ " * 40])) for i in range(80)]
    rows += [(None, prose(60)), (None, None), (3, ""), (3, " \n"), (rows[4][0], rows[4][1]), (10**12, "a\x85b c " * 30), (-7, prose(30))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("start", F.lit(1))
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert got == want and sum(r[1] for r in want) > 20


def test_bytes_and_empty_table(spark):
    d = spark.sql("select 5L as doc_id, repeat(concat(cast(X'68e9ff' as string), ' '), 30) as text")
    got = periodic_runs.find_runs(d)
    assert got.select(F.hex(F.col("collapsed").cast("binary"))).first()[0] == "68E9FF" and got.first()["n_words"] == 30
    assert periodic_runs.find_runs(d.filter("doc_id > 5")).count() == 0


def test_query_on_given_table(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    short = [i for i, t in text.items() if len((t or "").split()) <= 600]
    assert len(got) == len(text) and [got[i] for i in short] == [plain_row(i, text[i]) for i in short]
