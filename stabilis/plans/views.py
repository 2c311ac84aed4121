"""Sequences, alignments, stability tables and trees seen in the given tables.

The tables hold no proteins, so their texts are read as such, whole: the letters of a text, cut
into blocks of 60, are aligned sequences of the family ``lang``, and md5 digests of a text are
nucleotides.  Each view has its SQL form for DuckDB beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import alignment, ddg

BLOCK = 60
#: Pseudocounts that make the methods of the stability table.
METHODS = {"P1": 1, "P5": 5, "P20": 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, doc_id, raw): the upper-case ASCII letters of each text."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null")
    return docs.select(F.col("lang").alias("family"), "doc_id", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", "")).alias("raw"))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, pos, header, seq): aligned sequences of 60 columns, with gaps for odd letters.

    A text is cut in one pass; taking each block from the whole text anew would grow with the square of its length.
    """
    s = letters(spark, sf_dir).withColumn("s", F.regexp_replace("raw", "[BJOUXZ]", "-"))
    blocks = F.regexp_extract_all("s", F.lit(f"^$|.{{1,{BLOCK}}}"), F.lit(0))  # one of no letters for an empty text
    s = s.select("family", "doc_id", F.posexplode(blocks).alias("b", "block"))
    return s.select(
        "family",
        (F.col("doc_id") * 1000000 + F.col("b")).alias("pos"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("_"), F.col("b").cast("string")).alias("header"),
        F.rpad("block", BLOCK, "-").alias("seq"),
    )


def nucleotides(spark: SparkSession, sf_dir: str, codes: str = "ATGCATGCATGCATGC") -> DataFrame:
    """(id, nt): 96 bases from digests of each text; ``codes`` stand for the 16 hex digits."""
    t = F.coalesce("text", F.lit(""))
    md5 = [F.md5(F.concat(t, F.lit(x)).cast("binary")) for x in ("", "1", "2")]
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.translate(F.concat(*md5), "0123456789abcdef", codes).alias("nt"))


def stabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, family, r, wt, mut, ddg) for some pseudocounts, wild type from the reference row."""
    counts = alignment.site_counts(proteins(spark, sf_dir))
    refs = alignment.reference_sites(proteins(spark, sf_dir))
    return ddg.consensus_by(counts, refs, {k: (p, 3 + p) for k, p in METHODS.items()})


def newicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_id, newick): each nation's suppliers as a caterpillar, in the order of their keys."""
    s = table(spark, sf_dir, "supplier").withColumn("len", F.format_string("%d.%02d", F.col("s_suppkey") % 3, F.col("s_suppkey") % 100))
    tips = s.groupBy(F.col("s_nationkey").alias("tree_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "len"))).alias("t")).filter(F.size("t") > 1)
    tip = lambda x: F.concat(F.lit("S"), x["s_suppkey"].cast("string"), F.lit(":"), x["len"])
    rest = F.transform(F.slice("t", 2, F.size("t") - 1), lambda x: F.concat(F.lit(","), tip(x), F.lit(")")))
    return tips.select("tree_id", F.concat(F.repeat(F.lit("("), F.size("t") - 1), tip(F.col("t")[0]), F.array_join(rest, ":0.05"), F.lit(";")).alias("newick"))


#: Letters that stand for the 16 hex digits of a digest, for bases and for residues.
RELATIVE_CODES = {"dna": "ATGCATGCATGCATGC", "protein": "ACDEFGHIKLMNPQRS"}


def relatives(spark: SparkSession, sf_dir: str, kind: str = "dna") -> DataFrame:
    """(family, pos, header, seq): the suppliers of a nation as relatives of its first one.

    A supplier has the digest of a document of its own at three sites in sixteen, and that of the first
    supplier at the others.
    """
    t = F.coalesce("text", F.lit(""))
    hexes = F.concat(*[F.md5(F.concat(t, F.lit(x)).cast("binary")) for x in ("", "1", "2")]) if kind == "dna" else F.sha2(t.cast("binary"), 256)
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", hexes.alias("h"))
    # one row
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(docs.agg((F.max("doc_id") + 1).alias("n"))))
    own = s.select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") % F.col("n")).alias("doc_id")).join(docs, "doc_id")
    first = own.groupBy("family").agg(F.min_by("h", "pos").alias("first"))
    at = lambda c, i: F.substring(c, i, 1)
    mixed = F.transform(F.sequence(F.lit(1), F.length("h")), lambda i: F.when(at(F.reverse("h"), i).isin("0", "1", "2"), at(F.col("h"), i)).otherwise(at(F.col("first"), i)))
    seq = F.translate(F.array_join(mixed, ""), "0123456789abcdef", RELATIVE_CODES[kind])
    return own.join(first, "family").select("family", "pos", F.concat(F.lit("S"), F.col("pos").cast("string")).alias("header"), seq.alias("seq"))


def sql_relatives(kind: str = "dna") -> str:
    t = "coalesce(text, '')"
    hexes = f"md5({t}) || md5({t} || '1') || md5({t} || '2')" if kind == "dna" else f"sha256({t})"
    return f"""hexes AS (SELECT doc_id, {hexes} AS h FROM documents),
own AS (SELECT s_nationkey AS family, s_suppkey AS pos, h FROM supplier JOIN hexes ON doc_id = s_suppkey % (SELECT max(doc_id) + 1 FROM documents)),
firsts AS (SELECT family, arg_min(h, pos) AS first FROM own GROUP BY family),
relatives AS (SELECT family, pos, translate(array_to_string(list_transform(range(1, length(h)::INT + 1), lambda i: CASE WHEN substr(reverse(h), i::INT, 1) IN ('0', '1', '2') THEN substr(h, i::INT, 1) ELSE substr(first, i::INT, 1) END), ''),
  '0123456789abcdef', '{RELATIVE_CODES[kind]}') AS seq FROM own JOIN firsts USING (family))"""


AA_VALUES = ", ".join(f"('{a}')" for a in R.AMINO_ACIDS)
# DuckDB forms of the views, as members of a WITH list.
SQL_LETTERS = "letters AS (SELECT lang AS family, doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS raw FROM documents WHERE lang IS NOT NULL)"
SQL_PROTEINS = (
    SQL_LETTERS
    + """,
cut AS (SELECT family, doc_id, translate(raw, 'BJOUXZ', '------') AS s FROM letters),
numbered AS (SELECT family, doc_id, s, unnest(range(0, greatest(1, CAST(ceil(length(s) / 60.0) AS BIGINT)))) AS b FROM cut),
prot AS (SELECT family, doc_id * 1000000 + b AS pos, 'D' || doc_id || '_' || b AS header, rpad(substr(s, b * 60 + 1, 60), 60, '-') AS seq FROM numbered),
first AS (SELECT family, min(pos) AS pos FROM prot GROUP BY family),
ref AS (SELECT family, pos AS ref_pos, seq AS ref FROM prot JOIN first USING (family, pos))"""
)
SQL_SITES = (
    SQL_PROTEINS
    + f""",
aas(aa) AS (VALUES {AA_VALUES}),
sites AS (SELECT family, pos, unnest(range(1, 61)) AS site, unnest(string_split(seq, '')) AS aa FROM prot),
seen AS (SELECT family, site, aa, count(*) AS n FROM sites WHERE aa <> '-' GROUP BY ALL),
grid AS (SELECT family, site, aa FROM (SELECT DISTINCT family FROM prot), (SELECT unnest(range(1, 61)) AS site), aas),
counts AS MATERIALIZED (SELECT family, site, aa, coalesce(n, 0) AS n FROM grid LEFT JOIN seen USING (family, site, aa)),
refsites AS MATERIALIZED (SELECT family, unnest(range(1, 61)) AS site, unnest(string_split(ref, '')) AS wt FROM ref)"""
)
SQL_DDG = (
    SQL_SITES
    + """,
methods(method, pc) AS (VALUES ('P1', 1), ('P5', 5), ('P20', 20)),
ddg AS MATERIALIZED (
  SELECT method, m.family, m.site AS r, wt, m.aa AS mut,
    CASE WHEN m.n + pc >= 3 + pc AND w.n + pc >= 3 + pc THEN ln((w.n + pc)::DOUBLE / (m.n + pc)) END AS ddg
  FROM refsites JOIN counts w ON w.family = refsites.family AND w.site = refsites.site AND w.aa = wt
  JOIN counts m ON m.family = refsites.family AND m.site = refsites.site AND m.aa <> wt CROSS JOIN methods)"""
)
SQL_NT = "nts AS (SELECT doc_id AS id, translate(md5(coalesce(text, '')) || md5(coalesce(text, '') || '1') || md5(coalesce(text, '') || '2'), '0123456789abcdef', 'ATGCATGCATGCATGC') AS nt FROM documents)"
IUPAC_CODES = "ATGCATGCATGCRYN-"
SQL_NT_CODES = SQL_NT.replace("nts AS", "codes AS").replace("'ATGCATGCATGCATGC'", f"'{IUPAC_CODES}'")
SQL_NEWICK = """tips AS (SELECT s_nationkey AS tree_id, s_suppkey AS k, 'S' || s_suppkey || ':' || (s_suppkey % 3) || '.' || lpad((s_suppkey % 100)::VARCHAR, 2, '0') AS tip,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
newicks AS (SELECT tree_id, repeat('(', (max(n) - 1)::INT) || any_value(tip) FILTER (WHERE i = 1) || string_agg(',' || tip || ')', ':0.05' ORDER BY i) FILTER (WHERE i > 1) || ';' AS newick
  FROM tips WHERE n > 1 GROUP BY tree_id)"""
