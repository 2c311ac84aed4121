"""Residue tables and Column functions over sequences."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# The alphabet, the standard code in TCAG order, base codes, names, hydropathies.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
BASES = "TCAG"
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASE_CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
THREE_LETTERS = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L",
    "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y", "XAA": "X",
}
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}


def codon_table() -> dict[str, str]:
    return {"".join(c): a for c, a in zip(itertools.product(BASES, repeat=3), STANDARD_CODE, strict=True)}


def full_codon_table() -> dict[str, str]:
    """Codons of all base codes: the residue that all expansions agree on, else X."""
    plain = codon_table()
    out = {}
    for codon in itertools.product(BASE_CODES, repeat=3):
        told = {plain["".join(x)] for x in itertools.product(*(BASE_CODES[c] for c in codon))}
        out["".join(codon)] = told.pop() if len(told) == 1 else "X"
    return out


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def chars(seq: Column) -> Column:
    """The characters of a string; none for the empty string."""
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def unknowns_to_gaps(seq: Column) -> Column:
    return F.translate(seq, "BZX", "---")


def reverse_complement(nt: Column, strict: bool = True) -> Column:
    """Null, or an error if ``strict``, for letters other than ATGCatgc."""
    bad = F.raise_error(F.lit("not a plain nucleotide sequence")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(nt.rlike("^[ATGCatgc]*$"), F.reverse(F.translate(nt, "ATGCatgc", "TACGtacg"))).otherwise(bad)


def translate_nt(nt: Column, readthrough_n=False, readthrough_stop=False, truncate_incomplete=False, translate_gaps=False) -> Column:
    """Residues of a nucleotide string by the standard code.

    A last stop is dropped.  Ambiguous codons give X with ``readthrough_n``, inner stops with
    ``readthrough_stop``, codons with a gap give a gap with ``translate_gaps``, and a last
    incomplete codon is left out with ``truncate_incomplete``; otherwise each is an error.
    """
    up = F.upper(nt)
    n = F.length(up)
    fail = lambda why: F.raise_error(F.lit(why)).cast("string")
    plain = codon_table()
    ambiguous = literal_map({k: v for k, v in full_codon_table().items() if k not in plain})
    base = lambda i: F.instr(F.lit(BASES), F.substring(up, i, F.lit(1))) - 1

    def residue(i):
        codon = F.substring(up, i * 3 + 1, F.lit(3))
        place = base(i * 3 + 1) * 16 + base(i * 3 + 2) * 4 + base(i * 3 + 3)
        # plain codons by their place in the code, only the others are looked up
        aa = F.when(codon.rlike(f"^[{BASES}]{{3}}$"), F.substring(F.lit(STANDARD_CODE), place + 1, F.lit(1))).otherwise(F.try_element_at(ambiguous, codon))
        gap = F.lit("-") if translate_gaps else fail("gap in a codon")
        n_code = F.lit("X") if readthrough_n else fail("ambiguous codon")
        return F.when(codon.contains("-"), gap).when(aa == "X", n_code).when(aa.isNull(), fail("not a codon")).otherwise(aa)

    whole = F.array_join(F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.floor(n / 3).cast("int") - 1), residue)).otherwise(F.array().cast("array<string>")), "")
    whole = F.regexp_replace(whole, r"\*$", "")
    whole = F.translate(whole, "*", "X") if readthrough_stop else F.when(whole.contains("*"), fail("inner stop")).otherwise(whole)
    return whole if truncate_incomplete else F.when(n % 3 != 0, fail("incomplete codon")).otherwise(whole)


def three_to_one(name: Column, strict: bool = True) -> Column:
    one = F.try_element_at(literal_map(THREE_LETTERS), F.upper(name))
    return F.coalesce(one, F.raise_error(F.lit("unknown residue name")).cast("string")) if strict else one


def hydropathy(aa: Column, strict: bool = True) -> Column:
    value = F.try_element_at(literal_map(HYDROPATHY), F.upper(aa))
    return F.coalesce(value, F.raise_error(F.lit("no hydropathy for the residue")).cast("double")) if strict else value


def motif_pattern(motif: str) -> str:
    """A case-insensitive pattern for a motif of base codes; U counts as T."""
    codes = {c: f"[{''.join(sorted(b + ('U' if 'T' in b else '')))}]" for c, b in BASE_CODES.items()}
    return "(?i)" + "".join(codes[c] for c in motif.upper().replace("U", "T"))


def find_motifs(seq: Column, motif: str) -> Column:
    """0-based starts of the leftmost matches of a motif that don't overlap."""
    parts = F.split(seq, motif_pattern(motif), -1)
    size = len(motif)
    found = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, x: F.struct((a["at"] + F.length(x) + size).alias("at"), F.concat(a["starts"], F.array(a["at"] + F.length(x))).alias("starts"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), found, step)["starts"]


def random_sequence(length: Column, seed: int = 0) -> Column:
    """Residues drawn alike, as many as ``length``; each row has its own draws."""
    letters = F.lit("".join(AMINO_ACIDS))
    draw = F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(letters, (F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), i), F.lit(20)) + 1).cast("int"), F.lit(1)))
    return F.when(length > 0, F.array_join(draw, "")).when(length == 0, "")


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a column as numbers, and where each row's begin; nulls count as empty."""
    rows = ["" if x is None else x for x in texts.to_pylist()]
    return np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)]).astype(np.int64)


def strings(points: np.ndarray, begin: np.ndarray) -> list[str]:
    text, at = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), begin.tolist()
    return [text[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def upper_points(x: np.ndarray) -> np.ndarray:
    return np.where((x >= ord("a")) & (x <= ord("z")), x - 32, x)


def with_other(letter):
    """A function of two columns that makes each letter of the first from it and the one over it in the second."""

    def run(one: pa.Array, two: pa.Array) -> pa.Array:
        (x, at), (y, other) = code_points(one), code_points(two)
        size = np.diff(at)
        row, place = np.repeat(np.arange(len(size)), size), np.arange(len(x)) - np.repeat(at[:-1], size)
        inside = place < np.diff(other)[row]
        over = np.where(inside, y[np.where(inside, other[row] + place, 0)] if len(y) else 0, 0)
        made, kept = letter(x, over, inside)
        begin = np.concatenate([[0], np.cumsum(kept)])[at]
        return pa.array(strings(made[kept], begin), pa.string(), mask=np.asarray(pc.or_(one.is_null(), two.is_null())))

    return run


def add_dots(seq: Column, ref: Column) -> Column:
    """Residues that equal the reference's, but for its gaps, become dots."""
    letter = lambda x, y, inside: (np.where(inside & (upper_points(x) == upper_points(y)) & (y != ord("-")), ord("."), x), np.ones(len(x), bool))
    return arrow_udf(with_other(letter), "string")(seq, ref)


def remove_dots(seq: Column, ref: Column) -> Column:
    letter = lambda x, y, inside: (np.where(x == ord("."), y, x), (x != ord(".")) | inside)
    return arrow_udf(with_other(letter), "string")(seq, ref)


def strip_to_reference(seq: Column, ref: Column) -> Column:
    """The columns in which the reference has no gap."""
    kept = F.filter(F.arrays_zip(chars(seq).alias("a"), chars(ref).alias("b")), lambda x: x["b"] != "-")
    return F.array_join(F.transform(kept, lambda x: x["a"]), "")


def strip_ends_to_reference(seq: Column, ref: Column) -> Column:
    """The columns from the first to the last in which the reference has no gap."""
    first = F.length(ref) - F.length(F.regexp_replace(ref, "^-+", "")) + 1
    inner = F.length(F.regexp_replace(F.regexp_replace(ref, "^-+", ""), "-+$", ""))
    return F.substring(seq, first, inner)


def mutation_code(wt: Column, r: Column, mut: Column) -> Column:
    return F.concat(wt, r.cast("string"), mut)


def parse_mutation(code: Column) -> Column:
    """Struct (wt, r, mut) of a code such as Y96A; null if it isn't one."""
    part = lambda i: F.regexp_extract(code, r"^(.)(-?\d+)(.)$", i)
    return F.when(code.rlike(r"^.-?\d+.$"), F.struct(part(1).alias("wt"), part(2).cast("int").alias("r"), part(3).alias("mut")))


def hamming(a: Column, b: Column, always: str | None = None) -> Column:
    """Places in which two strings of one length differ; ``always`` counts as different."""
    differ = lambda x: (x["a"] != x["b"]) | F.lit(False) if always is None else (x["a"] != x["b"]) | (x["a"] == always) | (x["b"] == always)
    return F.size(F.filter(F.arrays_zip(chars(a).alias("a"), chars(b).alias("b")), differ))
