"""Table functions for SQL: parsers of texts that make several rows of one.

``register`` makes them known to a session; they are used as ``FROM t, LATERAL newick_nodes(t.newick)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.trees import NODE, parse


class NewickNodes:
    """The nodes of a tree, as ``trees.nodes`` numbers them; none of a null or empty text."""

    def eval(self, newick: str):
        if newick:
            yield from parse(newick)


class FastaRecords:
    """(place, header, seq) of a FASTA text, places from 0; an empty sequence or a text before a header is
    an error."""

    def eval(self, text: str):
        place, header, parts = -1, None, []
        for line in (text or "").splitlines():
            if line.startswith(">"):
                if header is not None:
                    yield self.record(place, header, parts)
                place, header, parts = place + 1, line[1:].strip(), []
            elif line.strip():
                if header is None:
                    raise ValueError("a text before a header")
                parts.append("".join(line.split()))
        if header is not None:
            yield self.record(place, header, parts)

    @staticmethod
    def record(place: int, header: str, parts: list[str]):
        if not parts:
            raise ValueError(f"empty sequence: {header}")
        return place, header, "".join(parts)


def register(spark: SparkSession) -> None:
    nodes = ", ".join(x.replace(" ", ": ") for x in NODE.split(", ")[1:])
    spark.udtf.register("newick_nodes", udtf(NewickNodes, returnType=nodes, useArrow=True))
    spark.udtf.register("fasta_records", udtf(FastaRecords, returnType="place: int, header: string, seq: string", useArrow=True))
