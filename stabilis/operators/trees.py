"""Trees as rows of nodes, read from Newick texts, and operators on them.

Texts hold strictly bifurcating trees with a length on every branch but the root's.  Each text is
parsed in one pass with a stack, so deep trees are no problem; a tree is one row of input.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[(),;]|:\s*[-+0-9.eE]+|[^(),:;\s][^(),:;]*")
NODE = "tree_id long, node_id int, parent_id int, side string, is_tip boolean, name string, branch double, tip_no int, internal_no int, path string"


#: Node rows that are handed on at once.
ROWS = 10_000


def parse(text: str, scale: float = 1.0, paths: bool = True) -> list[tuple]:
    """Nodes in preorder, right before left, root 0: (node, parent, side, is_tip, name, branch,
    tip number, internal number, path from the root, which is empty without ``paths``)."""
    open_: list[list] = [[]]  # the children so far of each open parenthesis
    for token in TOKEN.findall(text):
        if token == "(":
            open_.append([])
        elif token == ")":
            kids = open_.pop()
            if len(kids) != 2 or not open_:
                raise ValueError("a node must have two branches")
            open_[-1].append([kids, None, None])
        elif token == ";":
            break
        elif token[0] == ":":
            open_[-1][-1][2] = float(token[1:]) * scale
        elif token != ",":
            open_[-1].append([[], token.strip(), None])
    if len(open_) != 1 or len(open_[0]) != 1:
        raise ValueError("parentheses don't match")
    root = open_[0][0]
    nodes: list[list] = []
    todo = [(root, None, None, "")]
    while todo:
        node, parent, side, path = todo.pop()
        at = len(nodes)
        if node[2] is None and parent is not None:
            raise ValueError("a branch has no length")
        nodes.append([at, parent, side, not node[0], node[1], node[2] if parent is not None else None, None, None, path])
        if node[0]:
            step = f"{path}," if path else ""
            todo.append((node[0][0], at, "left", step + "left" if paths else ""))
            todo.append((node[0][1], at, "right", step + "right" if paths else ""))
    # tips and internal nodes are numbered in postorder, right first: children before parents
    order: list[int] = []
    kids: dict[int, list[int]] = {}
    for n in nodes:
        if n[1] is not None:
            kids.setdefault(n[1], []).append(n[0])
    walk = [(0, False)]
    while walk:
        n, done = walk.pop()
        if done or nodes[n][3]:
            order.append(n)
        else:
            walk.append((n, True))
            walk += [(k, False) for k in reversed(kids[n])]
    tips = inner = 0
    for n in order:
        if nodes[n][3]:
            nodes[n][6], tips = tips, tips + 1
        else:
            nodes[n][7], inner = inner, inner + 1
    return [tuple(n) for n in nodes]


def _nodes(paths: bool):
    names = [x.split()[0] for x in NODE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    width = len(names) - (not paths)

    def run(batches):
        for b in batches:
            for tree, text in zip(b.column("tree_id").to_pylist(), b.column("newick").to_pylist(), strict=True):
                told = parse(text, paths=paths) if text else []
                for k in range(0, len(told), ROWS):
                    columns = list(zip(*((tree, *n) for n in told[k : k + ROWS]), strict=True))[:width]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds[:width], strict=True)], names=names[:width])

    return run


def nodes(newicks: DataFrame, paths: bool = True) -> DataFrame:
    """Node rows of (tree_id, newick) rows; a malformed text is an error.

    Without ``paths`` there is no column of that name: the paths of a deep tree grow with the square of its tips.
    """
    some = newicks.select(F.col("tree_id").cast("long").alias("tree_id"), "newick")
    return some.mapInArrow(_nodes(paths), NODE if paths else NODE.removesuffix(", path string"))


def no_negative_branches(newick: Column) -> Column:
    return F.regexp_replace(newick, r":-[^,);]*", ":0.0")


def root_to_outgroup(newick: Column) -> Column:
    """A top level of several children becomes two: all but the last, on a branch of 0, and it."""
    body = F.regexp_replace(newick, r"\)\s*;?\s*$", "")
    cut = F.length(body) - F.length(F.substring_index(body, ",", -1))
    last_is_tip = ~F.substring_index(body, ",", -1).contains(")")
    return F.when(last_is_tip, F.concat(F.lit("("), F.substring(body, F.lit(1), cut - 1), F.lit("):0.0,"), F.substring_index(body, ",", -1), F.lit(");")))


def remove_outgroup(newick: Column) -> Column:
    """The tree without its last child, a tip: what is left at the top stays or becomes the root.

    Null if the last child is no tip, or if fewer than two tips are left.
    """
    body = F.regexp_replace(F.trim(newick), r"\)\s*;?\s*$", "")
    last = F.substring_index(body, ",", -1)
    rest = F.substring(body, F.lit(2), F.length(body) - F.length(last) - 2)
    count = lambda c: F.length(rest) - F.length(F.replace(rest, F.lit(c), F.lit("")))
    # nodes have two children, so one clade has as many commas as parentheses, and two have one more
    tree = F.when(count("(") == count(","), F.regexp_replace(rest, r"\)[^)]*$", ")")).otherwise(F.concat(F.lit("("), rest, F.lit(")")))
    return F.when(~last.contains(")") & (count(",") > 0), F.concat(tree, F.lit(";")))


def dumped(tree: DataFrame, seqs: DataFrame) -> DataFrame:
    """(tree_id, path, value): the FASTA record of every node; left before right by ``path``.

    ``seqs``: (tree_id, node_id, seq); a node without a name or sequence says None.
    """
    place = F.coalesce(F.nullif(F.upper("path"), F.lit("")), F.lit("ROOT"))
    head = F.concat_ws(" ", place, F.when(F.col("is_tip"), "TIP").otherwise("INTERIOR"), F.coalesce("name", F.lit("None")))
    value = F.concat(F.lit(">"), head, F.lit("\n"), F.coalesce("seq", F.lit("None")))
    return tree.join(seqs, ["tree_id", "node_id"], "left").select("tree_id", "path", value.alias("value"))


def site_totals(changes: DataFrame, seqs: DataFrame) -> DataFrame:
    """(tree_id, site, n): changes at each site, 0 where there are none.

    ``changes`` as of ``site_changes``, ``seqs`` as given to it.
    """
    width = seqs.groupBy("tree_id").agg(F.max(F.length("seq")).alias("w")).filter("w > 0")
    every = width.select("tree_id", F.explode(F.sequence(F.lit(1), "w")).alias("site"))
    n = changes.groupBy("tree_id", "site").agg(F.sum("n").alias("n"))
    return every.join(n, ["tree_id", "site"], "left").select("tree_id", "site", F.coalesce("n", F.lit(0)).alias("n"))


def site_changes(tree: DataFrame, seqs: DataFrame) -> DataFrame:
    """(tree_id, site, from_aa, to_aa, n): differences along the branches of trees.

    ``seqs``: (tree_id, node_id, seq) with one sequence for each node.
    """
    from ..functions import residues as R

    child = tree.filter("parent_id is not null").select("tree_id", "node_id", "parent_id").join(seqs, ["tree_id", "node_id"])
    pair = child.join(seqs.select("tree_id", F.col("node_id").alias("parent_id"), F.col("seq").alias("above")), ["tree_id", "parent_id"])
    site = pair.select("tree_id", F.posexplode(F.arrays_zip(R.chars(F.col("above")).alias("a"), R.chars(F.col("seq")).alias("b"))).alias("i", "x"))
    return site.filter("x.a <> x.b").groupBy("tree_id", (F.col("i") + 1).alias("site"), F.col("x.a").alias("from_aa"), F.col("x.b").alias("to_aa")).agg(F.count("*").alias("n"))
