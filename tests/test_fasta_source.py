"""The data source of FASTA files, and table functions of SQL."""

import random

import pytest
from pyspark.sql import functions as F

from stabilis.sources import table_functions
from stabilis.sources.fasta_source import FastaDataSource


def records(n):
    rng = random.Random(n)
    return [(f"r{i} {'>' * rng.randrange(3)}x", "".join(rng.choice("ACDE") for _ in range(rng.randrange(1, 90)))) for i in range(n)]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_of_a_file(spark, tmp_path, split):
    spark.dataSource.register(FastaDataSource)
    want = records(120 if split > 1 else 8)
    path = tmp_path / "a.fasta"
    path.write_text("\r\n".join(f">{h}\r\n" + "\r\n".join(s[i : i + 20] for i in range(0, len(s), 20)) for h, s in want))
    got = spark.read.format("fasta").option("split", split).load(str(path)).orderBy("file", "pos").collect()
    assert [(r.header, r.seq) for r in got] == want
    data = path.read_bytes()
    assert all(data[r.pos : r.pos + 1] == b">" for r in got)


def test_bad_files(spark, tmp_path):
    spark.dataSource.register(FastaDataSource)
    for text in ("ACD\n>a\nAC\n", ">a\n>b\nAC\n"):
        (tmp_path / "bad.fasta").write_text(text)
        with pytest.raises(Exception, match="before a header|empty sequence"):
            spark.read.format("fasta").load(str(tmp_path / "bad.fasta")).collect()


def test_writes_appear_as_a_whole(spark, tmp_path):
    spark.dataSource.register(FastaDataSource)
    rows = [(i, h, s) for i, (h, s) in enumerate(records(50))]
    d = spark.createDataFrame(rows, "pos long, header string, seq string").repartitionByRange(5, "pos").sortWithinPartitions("pos")
    path = tmp_path / "out"
    d.select("header", "seq").write.format("fasta").mode("append").save(str(path))
    back = spark.read.format("fasta").load(str(path)).orderBy("file", "pos").collect()
    assert [(r.header, r.seq) for r in back] == [(h.strip(), s) for _, h, s in rows]
    before = sorted(p.name for p in path.iterdir())
    bad = d.withColumn("seq", F.when(F.col("pos") != 44, F.col("seq")))
    with pytest.raises(Exception, match="without a header or sequence"):
        bad.select("header", "seq").write.format("fasta").mode("append").save(str(path))
    assert sorted(p.name for p in path.iterdir()) == before
    d.filter("pos < 3").select("header", "seq").write.format("fasta").mode("overwrite").save(str(path))
    assert spark.read.format("fasta").load(str(path)).count() == 3


def test_table_functions(spark):
    table_functions.register(spark)
    texts = [(1, ">a x\nAC\nDE\n>b\n F\n"), (2, ""), (3, None)]
    spark.createDataFrame(texts, "id int, value string").createOrReplaceTempView("fasta_texts")
    got = spark.sql("SELECT t.id, r.* FROM fasta_texts t, LATERAL fasta_records(t.value) r ORDER BY id, place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a x", "ACDE"), (1, 1, "b", "F")]
    spark.sql("SELECT 7 AS id, '(x:1,y:2);' AS newick UNION ALL SELECT 8, NULL").createOrReplaceTempView("trees_of_text")
    got = spark.sql("SELECT t.id, n.name, n.branch FROM trees_of_text t, LATERAL newick_nodes(t.newick) n WHERE n.is_tip ORDER BY name").collect()
    assert [tuple(r) for r in got] == [(7, "x", 1.0), (7, "y", 2.0)]
