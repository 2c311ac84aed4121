"""Names of words and substrings on texts that cancel in sums modulo a power of two, and odd bytes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stabilis.llm import common, decontaminate, jaccard_join, language_id, lm_score, pii, suffix_dedup


def thue_morse(n, one="a", other="b"):
    return "".join(one if i.bit_count() % 2 == 0 else other for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (256, 257, 1024, 2048, 4096)]


@pytest.mark.parametrize("seed", [0, 3, 5, 7])
def test_words_have_names_of_their_own(seed):
    rng = random.Random(seed)
    words = [w.encode() for p in PAIRS for w in p] + [bytes(rng.randrange(97, 100) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    words += [b"x" * k for k in range(1, 600)] + [b"\0" * k for k in range(1, 40)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    names = common.word_names(data, end - [len(w) for w in words], end, seed)
    assert len(set(zip(words, names.tolist(), strict=True))) == len(set(words)) == len(set(names.tolist()))


def test_long_substrings():
    for a, b in PAIRS:
        data = np.frombuffer((a + b + a).encode(), np.uint8)
        n = len(a)
        roll = common.rolling(n)(data)
        got = roll.of(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert got[0] == got[2] != got[1]
    x = np.frombuffer(random.Random(1).randbytes(3000) * 2, np.uint8)
    at = np.arange(0, 1500, 7)
    roll = common.PrimeRolling(x)
    assert (roll.of(at, at + 1200) == roll.of(at + 3000, at + 4200)).all() and len(set(roll.of(at, at + 1200).tolist())) == len(at)


def test_operators_tell_them_apart(spark):
    rows = [(2 * k + i, p[i]) for k, p in enumerate(PAIRS) for i in (0, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    members, _ = jaccard_join.near_duplicates(d)
    assert {r.component_id for r in jaccard_join.least_ids(members).collect()} == set(range(10))
    assert jaccard_join.keep_one(d).count() == 10
    scored = {r.doc_id: r.n_known for r in lm_score.score_texts(d, F.col("doc_id") % 2 == 0).collect()}
    assert scored == {i: 2 - i % 2 for i in range(10)}
    items = spark.createDataFrame([(0, " ".join(p[0] for p in PAIRS))], "item_id long, text string")
    both = spark.createDataFrame([(i, " ".join(p[i] for p in PAIRS)) for i in (0, 1)], "doc_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(both, items).collect()} == {0: True, 1: False}
    left = suffix_dedup.remove_repeats(d.filter("doc_id in (4, 5)"), 1024)
    assert {r.n_removed for r in left.collect()} == {0}
    left = suffix_dedup.remove_repeats(d.filter("doc_id in (4, 5)").union(d.filter("doc_id = 4")), 1024)
    assert sorted((r.doc_id, r.n_removed) for r in left.collect()) == [(4, 1024), (4, 1024), (5, 0)]


@pytest.mark.parametrize("text", ["jоhn@example.com", "j​ohn@example.com", "joh­n@example.com"])
def test_disguise_inside_an_address(text):
    base, every = pii.find(f"to {text}, please")
    assert base["email"] and every["email"] == sorted([(3, 3 + len(text)), *base["email"]])
    assert pii.masked(f"to {text}, please") == "to <email>, please"


def test_bytes_that_are_no_utf8(spark):
    d = spark.sql("select 1L as doc_id, cast(X'68e9ff206a6f406578616d706c652e636f6dff' as string) as text")
    got = pii.find_pii(d).first()
    assert (got.n_email, got.spans) == (1, "email:4:18") and got.base_sha256 == hashlib.sha256(b"email:4:18").hexdigest()
    assert pii.mask_pii(d).select(F.hex(F.col("text").cast("binary"))).first()[0] == "68E9FF203C656D61696C3EFF"
    assert language_id.letters_of(np.frombuffer(b"h\xe9\xff \xc3\xa9\xf0\x9d\x94\xb8", np.uint8)).tolist() == [True, False, False, False, True, True, True, True, True, True]


def test_prefix_tokens_in_parts():
    import pyarrow as pa

    from stabilis.llm import jaccard_join as J

    texts = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i % k}" for i in range(40)) for k in range(7, 40)]})
    level = np.zeros(J.CELLS, np.uint64)
    told = lambda *part: sorted(r for b in J.prefixes(level, 75, *part)(iter([texts])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    halves = [told(k, 2) for k in range(2)]
    assert sorted(halves[0] + halves[1]) == told() and min(map(len, halves)) > 0
