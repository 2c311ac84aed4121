"""Queries on trees, and inference along them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import residues as R
from ..operators import alignment as A
from ..operators import ancestral as B
from ..operators import clusters as C
from ..operators import distances as D
from ..operators import edges as E
from ..operators import inference as I
from ..operators import leastsquares as Q
from ..operators import model as M
from ..operators import stepwise as W
from ..operators import trees as T
from ..operators.tables import fresh_folder, stored
from ..sources import outfile, table_functions
from . import views as V
from .registry import query

# A caterpillar's nodes in closed form: tip i of n hangs on internal node n - i, counted from the root.
SQL_NODES = (
    V.SQL_NEWICK
    + """,
t AS (SELECT *, split_part(tip, ':', 1) AS name, split_part(tip, ':', 2)::DOUBLE AS branch FROM tips WHERE n > 1),
every AS (
  SELECT tree_id, name, TRUE AS is_tip, branch, CASE WHEN i = 1 THEN 'left' ELSE 'right' END AS side,
    CASE WHEN i = 1 THEN 2 * (n - 1) ELSE 2 * (n - i) + 1 END AS node_id, CASE WHEN i = 1 THEN 2 * (n - 2) ELSE 2 * (n - i) END AS parent_id,
    n - i AS tip_no, NULL AS internal_no, CASE WHEN i = 1 THEN repeat('left,', (n - 2)::INT) || 'left' ELSE repeat('left,', (n - i)::INT) || 'right' END AS path FROM t
  UNION ALL
  SELECT tree_id, NULL, FALSE, CASE WHEN k > 0 THEN 0.05 END, CASE WHEN k > 0 THEN 'left' END, 2 * k, CASE WHEN k > 0 THEN 2 * (k - 1) END,
    NULL, n - 2 - k, rtrim(repeat('left,', k::INT), ',') FROM (SELECT tree_id, n, unnest(range(0, n - 1)) AS k FROM t WHERE i = 1))"""
)


@query(f"WITH {SQL_NODES} SELECT tree_id::BIGINT AS tree_id, node_id::INT AS node_id, parent_id::INT AS parent_id, side, is_tip, name, branch::DOUBLE AS branch FROM every")
def newick_nodes(spark, d):
    return T.nodes(V.newicks(spark, d), paths=False).select("tree_id", "node_id", "parent_id", "side", "is_tip", "name", "branch")


@query(f"WITH {SQL_NODES} SELECT tree_id::BIGINT AS tree_id, node_id::INT AS node_id, parent_id::INT AS parent_id, name, branch::DOUBLE AS branch, path FROM every")
def newick_table_function(spark, d):
    """The nodes of all trees by SQL alone."""
    table_functions.register(spark)
    V.newicks(spark, d).createOrReplaceTempView("given_newicks")
    return spark.sql("SELECT CAST(t.tree_id AS BIGINT) AS tree_id, n.node_id, n.parent_id, n.name, n.branch, n.path FROM given_newicks t, LATERAL newick_nodes(t.newick) n")


@query(f"WITH {SQL_NODES} SELECT tree_id::BIGINT AS tree_id, path, is_tip, name FROM every")
def tree_paths(spark, d):
    return T.nodes(V.newicks(spark, d)).select("tree_id", "path", "is_tip", "name")


@query(f"WITH {SQL_NODES} SELECT tree_id::BIGINT AS tree_id, node_id::INT AS node_id, tip_no::INT AS tip_no, internal_no::INT AS internal_no FROM every")
def tip_internal_numbers(spark, d):
    return T.nodes(V.newicks(spark, d), paths=False).select("tree_id", "node_id", "tip_no", "internal_no")


@query(f"WITH {V.SQL_NEWICK} SELECT tree_id, regexp_replace(replace(newick, ':0.', ':-0.'), ':-[^,);]*', ':0.0', 'g') AS newick FROM newicks")
def eliminate_negative_branches(spark, d):
    return V.newicks(spark, d).select("tree_id", T.no_negative_branches(F.replace("newick", F.lit(":0."), F.lit(":-0."))).alias("newick"))


SQL_ROOTED = "SELECT tree_id, '(' || substr(newick, 1, length(newick) - position(',' IN reverse(newick))) || '):0.0,' || split_part(reverse(split_part(reverse(newick), ',', 1)), ')', 1) || ');' AS rooted FROM newicks"


@query(f"WITH {V.SQL_NEWICK} {SQL_ROOTED}")
def root_to_outgroup(spark, d):
    return V.newicks(spark, d).select("tree_id", T.root_to_outgroup(F.col("newick")).alias("rooted"))


@query(
    f"""WITH {V.SQL_NEWICK} SELECT tree_id, CASE WHEN max(n) > 2 THEN repeat('(', (max(n) - 2)::INT) || any_value(tip) FILTER (WHERE i = 1) || string_agg(',' || tip || ')', ':0.05' ORDER BY i) FILTER (WHERE i > 1 AND i < n) || ';' END AS rooted
FROM tips WHERE n > 1 GROUP BY tree_id"""
)
def root_by_removing_outgroup(spark, d):
    return V.newicks(spark, d).select("tree_id", T.remove_outgroup(F.col("newick")).alias("rooted"))


def digests(spark, d, width=64):
    """(name, seq): residues from the digest of each document, named as the suppliers are."""
    docs = V.table(spark, d, "documents").filter("doc_id is not null")
    seq = F.translate(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), "0123456789abcdef", "ACDEFGHIKLMNPQR-")
    return docs.select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("name"), F.substring(seq, 1, width).alias("seq"))


def tip_names(nodes, seqs):
    """Each tip's sequence: that of the document of its number, or of the documents' first."""
    n = seqs.agg(F.max(F.substring("name", 2, 20).cast("long")).alias("n"))
    tips = nodes.filter("is_tip").select("name").distinct().crossJoin(F.broadcast(n))
    wanted = tips.select(F.col("name").alias("tip"), F.concat(F.lit("S"), (F.substring("name", 2, 20).cast("long") % (F.col("n") + 1)).cast("string")).alias("name"))
    return wanted.join(seqs, "name").select(F.col("tip").alias("name"), "seq")


SQL_CHANGES = f"""WITH {SQL_NODES}, m AS (SELECT max(doc_id) + 1 AS m FROM documents),
s AS (SELECT tree_id, node_id, parent_id, is_tip, translate(sha256(coalesce(text, '')), '0123456789abcdef', 'ACDEFGHIKLMNPQR-') AS seq
  FROM every, m LEFT JOIN documents ON doc_id = CASE WHEN is_tip THEN substr(name, 2)::BIGINT % m ELSE node_id END),
p AS (SELECT c.tree_id, unnest(list_zip(range(1, 65), string_split(a.seq, ''), string_split(c.seq, ''))) AS x FROM s c JOIN s a ON a.tree_id = c.tree_id AND a.node_id = c.parent_id)"""


def node_sequences(spark, d, nodes):
    """(tree_id, node_id, seq): a document's digest for each node."""
    seqs = digests(spark, d)
    tips = nodes.filter("is_tip").join(tip_names(nodes, seqs), "name").select("tree_id", "node_id", "seq")
    inner = nodes.filter("not is_tip").drop("name").withColumn("name", F.concat(F.lit("S"), F.col("node_id").cast("string"))).join(seqs, "name").select("tree_id", "node_id", "seq")
    return tips.unionByName(inner)


@query(f"{SQL_CHANGES} SELECT tree_id::BIGINT AS tree_id, x[1]::INT AS site, x[2] AS from_aa, x[3] AS to_aa, count(*) AS n FROM p WHERE x[2] <> x[3] GROUP BY ALL")
def site_change_tally(spark, d):
    nodes = T.nodes(V.newicks(spark, d), paths=False)
    return T.site_changes(nodes, node_sequences(spark, d, nodes))


@query(f"{SQL_CHANGES} SELECT tree_id::BIGINT AS tree_id, x[1]::INT AS site, count(*) FILTER (WHERE x[2] <> x[3]) AS n FROM p GROUP BY ALL")
def site_change_totals(spark, d):
    nodes = T.nodes(V.newicks(spark, d), paths=False)
    seqs = node_sequences(spark, d, nodes)
    return T.site_totals(T.site_changes(nodes, seqs), seqs)


@query(
    f"""{SQL_CHANGES} SELECT e.tree_id::BIGINT AS tree_id, e.path, '>' || CASE WHEN e.path = '' THEN 'ROOT' ELSE upper(e.path) END || CASE WHEN e.is_tip THEN ' TIP ' || name ELSE ' INTERIOR None' END || chr(10) || seq AS value
FROM every e JOIN s USING (tree_id, node_id)"""
)
def tree_dump(spark, d):
    nodes = T.nodes(V.newicks(spark, d))
    return T.dumped(nodes, node_sequences(spark, d, nodes))


def rows(spark, d, width):
    nodes = T.nodes(V.newicks(spark, d), paths=False)
    return I.residue_rows(I.tree_arrays(nodes), nodes, tip_names(nodes, digests(spark, d, width)))


def mutations(spark):
    return M.mutation_array(M.mutation_table(spark, "TRANSITION_TRANSVERSION_RATIO", F.lit(4.0)))


@query()
def log_likelihood(spark, d):
    return I.likelihoods(rows(spark, d, 64), mutations(spark), 10.0, 1.0, 0.0)


@query()
def maximize_posterior(spark, d):
    return I.maximize(rows(spark, d, 64), mutations(spark), 10.0, 1.0, 0.0)


def family_posterior(spark, d, tips, width, starts):
    """Optima along a balanced tree of the first ``tips`` documents, as large as a protein family."""
    docs = V.table(spark, d, "documents").filter("doc_id is not null").orderBy("doc_id").limit(tips)
    bits = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 512)
    seqs = docs.select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("name"), F.substring(F.translate(bits, "0123456789abcdef", "VVVVVVVIIIILLLA-"), 1, width).alias("seq"))
    parts = [f"{r['name']}:0.{i % 89 + 11:03d}" for i, r in enumerate(seqs.select("name").orderBy("name").collect())]
    while len(parts) > 1:
        pairs = [f"({a},{b}):0.{(7 * i + len(parts)) % 97 + 3:03d}" for i, (a, b) in enumerate(zip(parts[::2], parts[1::2], strict=False))]
        parts = pairs + parts[2 * len(pairs) :]
    nodes = T.nodes(spark.createDataFrame([(0, parts[0].rsplit(":", 1)[0] + ";")], "tree_id long, newick string"))
    return I.maximize(I.residue_rows(I.tree_arrays(nodes), nodes, seqs), mutations(spark), 10.0, 1.0, 0.0, starts)


@query()
def mcmc_trace(spark, d):
    return I.chains(rows(spark, d, 64), mutations(spark), 10.0, 1.0, 0.0)


@query()
def mcmc_coupled(spark, d):
    """A cold and two heated chains for each residue, stopped and gone on with half way."""
    each, c = stored(rows(spark, d, 64)), mutations(spark)
    half = stored(I.coupled(each, c, 10.0, 1.0, 0.0, 10))
    rest = I.coupled(I.resumed(each, half), c, 10.0, 1.0, 0.0, 10)
    return I.window_means(half.unionByName(rest).drop("places"))


@query()
def log_posterior_totals(spark, d):
    return I.totals(I.probabilities(rows(spark, d, 64), mutations(spark), 10.0, 1.0, 0.0))


@query()
def condense_seqs(spark, d):
    return C.condense(V.proteins(spark, d), 3, (1,))


def of_documents(spark, d):
    """Every block of every document; a document is a family."""
    return V.proteins(spark, d).withColumn("family", F.floor(F.col("pos") / 1000000).cast("string"))


@query()
def upgma(spark, d):
    return C.distance_trees(of_documents(spark, d))


@query()
def neighbour_joining(spark, d):
    return C.distance_trees(of_documents(spark, d), "NJ")


@query(
    f"""WITH {V.sql_relatives()},
r AS (SELECT family, pos, seq, string_split(seq, '') AS c FROM relatives),
p AS (SELECT family, len(list_filter(x, lambda e: e = 'A')) / len(x) AS a, len(list_filter(x, lambda e: e = 'C')) / len(x) AS c, len(list_filter(x, lambda e: e = 'G')) / len(x) AS g, len(list_filter(x, lambda e: e = 'T')) / len(x) AS t
  FROM (SELECT family, flatten(list(c)) AS x FROM r GROUP BY family)),
z AS (SELECT one.family, one.pos AS a, two.pos AS b, list_zip(one.c, two.c) AS z FROM r one JOIN r two ON one.family = two.family AND one.pos < two.pos),
n AS (SELECT family, z.a AS i, z.b AS j, len(list_filter(z, lambda e: e[1] || e[2] IN ('AG', 'GA', 'CT', 'TC'))) / len(z) AS ts, len(list_filter(z, lambda e: e[1] <> e[2] AND e[1] || e[2] NOT IN ('AG', 'GA', 'CT', 'TC'))) / len(z) AS tv FROM z),
v AS (SELECT family, i, j, ts, tv, c * t / (c + t) + a * g / (a + g) AS x, c * t + a * g AS y, (a + g) * (c + t) AS z FROM n JOIN p USING (family)),
w AS (SELECT *, 1 - ts / (2 * x) - (x - y) * tv / (2 * x * z) AS one, 1 - tv / (2 * z) AS two FROM v)
SELECT family::BIGINT AS family, i::BIGINT AS a, j::BIGINT AS b, round(CASE WHEN one > 0 AND two > 0 THEN greatest(0, -2 * x * ln(one) + 2 * (x - y - z) * ln(two)) END, 9) AS distance FROM w"""
)
def f84_distances(spark, d):
    told = D.f84_distances(V.relatives(spark, d))
    return told.select(*(F.col(c).cast("long").alias(c) for c in ("family", "a", "b")), F.round("distance", 9).alias("distance"))


@query()
def dna_distances(spark, d):
    """Distances of greatest likelihood: F84, twice as many transitions, gamma rates of variation 1."""
    return D.likely_distances(V.relatives(spark, d), "dna")


@query()
def protein_distances(spark, d):
    """Distances of greatest likelihood by a model of codons, gamma rates of variation 1."""
    return D.likely_distances(V.relatives(spark, d, "protein"))


@query()
def average_linkage(spark, d):
    """Trees of related suppliers by average linkage of their F84 distances, without a task for each."""
    family = V.relatives(spark, d)
    pairs = D.f84_distances(family).withColumn("distance", F.coalesce("distance", F.lit(5.0)))
    nodes = C.average_linkage(pairs)
    return nodes.select("family", "first", "size", "parent_first", "parent_size", "side", F.round("branch", 9).alias("branch"), F.round("height", 9).alias("height"))


@query()
def least_squares_lengths(spark, d):
    """The same trees with branch lengths by weighted least squares of the distances."""
    family = V.relatives(spark, d)
    pairs = stored(D.f84_distances(family).withColumn("distance", F.coalesce("distance", F.lit(5.0))))
    edges = stored(C.as_edges(C.average_linkage(pairs), family).withColumn("tree_id", F.col("tree_id").cast("long")))
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    told = pairs.select(F.col("family").cast("long").alias("tree_id"), name("a").alias("a"), name("b").alias("b"), "distance")
    return Q.fitted(edges, told).withColumn("branch", F.round("branch", 6))


@query()
def least_squares_trees(spark, d):
    """Trees of related suppliers, shapes and lengths, by weighted least squares of their F84 distances."""
    pairs = D.f84_distances(V.relatives(spark, d)).withColumn("distance", F.coalesce("distance", F.lit(5.0)))
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    told = stored(pairs.select(F.col("family").cast("long").alias("tree_id"), name("a").alias("a"), name("b").alias("b"), "distance"))
    return W.least_squares_trees(told).withColumn("branch", F.round("branch", 6))


def heaps(spark, d):
    """(tree_id, node, parent, side, name, branch): each nation's suppliers as a heap, two children or none."""
    s = V.table(spark, d, "supplier")
    k = (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("long")
    s = s.select(F.col("s_nationkey").cast("long").alias("tree_id"), k.alias("node"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), ((F.col("s_suppkey") % 100) / 4).alias("length"))
    n = s.groupBy("tree_id").agg(F.count("*").alias("n"))
    s = s.join(n, "tree_id").filter("node < n - 1 + n % 2")
    inner = F.col("node") > 0
    side = F.when(inner, F.when(F.col("node") % 2 == 1, "left").otherwise("right"))
    return s.select("tree_id", "node", F.when(inner, F.expr("(node - 1) div 2")).alias("parent"), side.alias("side"), "name", F.when(inner, F.col("length")).alias("branch"))


SQL_HEAPS = """heaps AS (
  SELECT tree_id, k AS node, CASE WHEN k > 0 THEN (k - 1) // 2 END AS parent, CASE WHEN k > 0 THEN CASE WHEN k % 2 = 1 THEN 'left' ELSE 'right' END END AS side, name, CASE WHEN k > 0 THEN length END AS branch
  FROM (SELECT s_nationkey::BIGINT AS tree_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY s_nationkey) AS n, 'S' || s_suppkey AS name, (s_suppkey % 100) / 4 AS length FROM supplier)
  WHERE k < n - 1 + n % 2),
above(tree_id, node, ancestor, steps, length) AS (
  SELECT tree_id, node, parent, 1, branch FROM heaps WHERE parent IS NOT NULL
  UNION ALL SELECT a.tree_id, a.node, h.parent, steps + 1, length + h.branch FROM above a JOIN heaps h ON h.tree_id = a.tree_id AND h.node = a.ancestor WHERE h.parent IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {SQL_HEAPS},
tips AS (SELECT tree_id, node FROM heaps h WHERE NOT EXISTS (SELECT 1 FROM heaps c WHERE c.tree_id = h.tree_id AND c.parent = h.node)),
under AS (SELECT tree_id, ancestor AS node, count(*) AS below, count(*) FILTER (WHERE (tree_id, node) IN (SELECT tree_id, node FROM tips)) AS tips FROM above GROUP BY ALL),
s AS (SELECT h.*, coalesce(below, 0) + 1 AS size, coalesce(tips, 1) AS tips, below IS NULL AS is_tip FROM heaps h LEFT JOIN under USING (tree_id, node)),
down(tree_id, node, node_id, parent_id, tip_before, inner_before, depth, path) AS (
  SELECT tree_id, node, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0, '' FROM s WHERE parent IS NULL
  UNION ALL
  SELECT c.tree_id, c.node, d.node_id + 1 + coalesce(r.size, 0), d.node_id, d.tip_before + coalesce(r.tips, 0), d.inner_before + coalesce(r.size - r.tips, 0), d.depth + 1, CASE WHEN d.path = '' THEN c.side ELSE d.path || ',' || c.side END
  FROM down d JOIN s c ON c.tree_id = d.tree_id AND c.parent = d.node LEFT JOIN s r ON c.side = 'left' AND r.tree_id = c.tree_id AND r.parent = c.parent AND r.side = 'right')
SELECT tree_id, node, node_id::INT AS node_id, parent_id::INT AS parent_id, side, is_tip, CASE WHEN is_tip THEN name END AS name, branch, CASE WHEN is_tip THEN tip_before END::INT AS tip_no,
  CASE WHEN NOT is_tip THEN inner_before + size - tips - 1 END::INT AS internal_no, depth::INT AS depth, path FROM down JOIN s USING (tree_id, node)"""
)
def edge_tree_nodes(spark, d):
    return E.numbered(heaps(spark, d)).drop("parent")


@query(f"WITH RECURSIVE {SQL_HEAPS} SELECT tree_id, node, ancestor, steps::BIGINT AS steps, length FROM above")
def edge_tree_ancestors(spark, d):
    return E.ancestors(heaps(spark, d))


def related_tips(spark, d):
    """Trees of suppliers, their nodes, and the letters of related residues at their tips."""
    nodes = T.nodes(V.newicks(spark, d), paths=False)
    seqs = V.relatives(spark, d, "protein").select(F.col("header").alias("name"), "seq")
    return nodes, seqs, I.residue_rows(I.tree_arrays(nodes), nodes, seqs)


def codon_model():
    return D.Reversible.of(R.AMINO_ACIDS, D.codon_exchange(), np.full(20, 0.05))


@query()
def likely_branch_lengths(spark, d):
    """Lengths of the branches of each nation's tree, of greatest likelihood for related residues."""
    _, _, rows = related_tips(spark, d)
    fitted = B.fitted_lengths(rows, codon_model(), 1.0)
    each = fitted.select("tree_id", "converged", F.round("log_likelihood", 4).alias("log_likelihood"), F.posexplode("lengths").alias("branch", "length"))
    return each.withColumn("length", F.round("length", 4))


@query()
def interior_sequences(spark, d):
    """Reconstructed residues of all interior nodes."""
    nodes, _, rows = related_tips(spark, d)
    return B.interior_sequences(rows, nodes, codon_model(), 1.0)


@query()
def reconstructed_changes(spark, d):
    """Changes along the branches, between reconstructed residues and those of the tips."""
    nodes, seqs, rows = related_tips(spark, d)
    inner = B.interior_sequences(rows, nodes, codon_model(), 1.0)
    tips = nodes.filter("is_tip").join(seqs, "name").select("tree_id", "node_id", "seq")
    return T.site_changes(nodes, tips.unionByName(inner))


@query(
    f"""{SQL_CHANGES} SELECT e.tree_id::BIGINT AS tree_id, e.node_id::INT AS node_id, e.is_tip,
  CASE WHEN e.is_tip THEN name ELSE (row_number() OVER (PARTITION BY e.tree_id, e.is_tip ORDER BY e.path))::VARCHAR END AS name, seq FROM every e JOIN s USING (tree_id, node_id)"""
)
def outfile_trees(spark, d):
    """Trees with sequences at all nodes, written as output files of a tree program and read back."""
    nodes = T.nodes(V.newicks(spark, d), paths=False)
    path = fresh_folder(spark)
    outfile.write_outfile(nodes.join(node_sequences(spark, d, nodes), ["tree_id", "node_id"]), path)
    rows = outfile.read_outfile(spark, path).withColumn("tree_id", F.regexp_extract("file", "tree_id=(\\d+)/", 1).cast("long"))
    return outfile.with_sequences(nodes, rows).select("tree_id", "node_id", "is_tip", "name", "seq")
