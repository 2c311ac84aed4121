"""Queries on tables where growth or a bound between two whole numbers tells."""

import duckdb
import pytest

from stabilis.operators import alignment as A
from stabilis.plans import catalog
from stabilis.plans import views as V


@pytest.fixture
def folder(spark, tmp_path):
    def written(documents):
        spark.createDataFrame(documents, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return written


def test_length_filter_between_two_whole_numbers(spark, folder):
    # nine tenths of 1914 are 1722.6
    d = folder([(0, "A" * 1914, "en"), (1, "C" * 1722, "en"), (2, "C" * 1723, "en")])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet/*.parquet')")
    want = con.execute(catalog.ORACLE["length_filter"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["length_filter"](spark, d).collect())) == sorted(want) == [("en", 0, 1914), ("en", 2, 1723)]


def test_blocks_are_cut_in_one_pass(spark, folder):
    text = "acdefghiklmnpqrstvwy bjouxz! " * 9000
    d = folder([(7, text, "en"), (8, "", "en"), (9, None, "en"), (10, "é 1", "de"), (11, "a" * 60, "de")])
    rows = sorted(map(tuple, V.proteins(spark, d).collect()))
    whole = "".join("-" if c in "BJOUXZ" else c for c in text.upper() if c.isascii() and c.isalpha())
    blocks = [("en", 7000000 + i, f"D7_{i}", whole[i * 60 : i * 60 + 60].ljust(60, "-")) for i in range(-(-len(whole) // 60))]
    empty = [("en", 8000000, "D8_0", "-" * 60), ("en", 9000000, "D9_0", "-" * 60), ("de", 10000000, "D10_0", "-" * 60), ("de", 11000000, "D11_0", "A" * 60)]
    assert rows == sorted(blocks + empty)
    # no block is taken by its place from a copy of the whole text
    assert "substring(" not in V.proteins(spark, d)._jdf.queryExecution().optimizedPlan().toString()


def test_letters_are_counted_without_rows_for_them(spark):
    rows = [("f", 1, "a", "AC-é"), ("f", 2, "b", "AD-"), ("g", 3, "c", ""), ("h", 4, "d", "K")]
    d = spark.createDataFrame(rows, "family string, pos long, header string, seq string")
    got = {tuple(r) for r in A.letter_counts(d).collect()}
    assert got == {("f", 1, "A", 2), ("f", 2, "C", 1), ("f", 2, "D", 1), ("f", 3, "-", 2), ("f", 4, "é", 1), ("h", 1, "K", 1)}
    for plan in (A.site_counts(d), A.central(d), A.glycan_sites(d), A.corresponding_residues(d)):
        assert "posexplode(split(seq" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_large_family_is_compared_in_parts(spark, monkeypatch):
    rows = [("f", i, "", "ACDX"[i % 3 :] + "K" * (i % 3)) for i in range(50)] + [("g", 99, "", "A")]
    d = spark.createDataFrame(rows, "family string, pos long, header string, seq string")
    whole = sorted(map(tuple, A.central(d).collect()))
    monkeypatch.setattr(A, "COMPARED", 7)
    assert sorted(map(tuple, A.central(d).collect())) == whole
    mean = {p: sum(sum(x != y or x == "X" for x, y in zip(s, t, strict=True)) for _, q, _, t in rows[:50] if q != p) / 49 for _, p, _, s in rows[:50]}
    assert whole[0][:2] == ("f", min(mean, key=lambda p: (round(mean[p], 9), p))) and whole[1] == ("g", 99, 0.0)
