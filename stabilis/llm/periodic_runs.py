"""Periodic runs of words: passages that repeat one period over and over, and texts without them.

A run is a stretch of words with smallest period ``q`` and at least ``max(least, times * q)`` words
that no neighbouring word extends.  Its words agree with those ``q`` further on over a stretch of
its length less ``q``.

Seeds and extension: periods are taken in classes up to 16, 32, 64, ...; every run of a class has a
repeated gram of as many words as its shortest overlap has.  These grams are named exactly, by
doubling: the name of a gram is that of the names of its two halves.  The places of a gram in
one document are then listed, and two places after one another are a seed.  Grams are no shorter than
the periods of their class, so no copy of one can begin between two that are a period apart; hence
neighbours are enough, all periods found are smallest ones, and a text has no more seeds than
words.  A seed is extended both ways along its diagonal, word by word; a table of the furthest
word covered for each lag passes over the seeds that an extension has been through.

Words are bytes between ASCII spaces, case as it is.  Null, empty and blank texts have no words and
no runs; very long texts are read whole; bytes that are no UTF-8 are kept; rows with equal or null
ids are documents of their own; repeated rows have equal results; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_strings, utf8

LEAST, TIMES = 24, 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"
RESULT = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
#: Rows in a batch of results, bytes of their texts at most.
ROWS, BYTES = 2000, 1 << 22


def named(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeated(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of grams with these names at these places: those that occur more than once."""
    if not len(name):
        return name, at
    _, of, count = np.unique(name, return_inverse=True, return_counts=True)
    keep = count[of] > 1
    return of[keep], at[keep]


def joined(name: np.ndarray, at: np.ndarray, step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and places of the repeated grams that begin with one of these and have another of
    these ``step`` words later."""
    where = np.full(n + 1, -1, np.int64)
    where[at] = name
    later = where[np.minimum(at + step, n)]
    both = later >= 0
    return repeated(name[both] * (int(name.max(initial=0)) + 1) + later[both], at[both])


def seeds(word: np.ndarray, least: int, times: int):
    """Places and lags of the seeds of each class of periods."""
    n = len(word)
    name, at, size = *repeated(word, np.arange(n)), 1
    low, high = 1, max(1, least - least // times)
    while len(at) and times * low <= n:
        # the shortest overlap of runs with periods from low to high
        gram = min(max(least, times * q) - q for q in range(low, min(high, least) + 1)) if low <= least else (times - 1) * low
        high = min(high, gram)
        while 2 * size <= gram and len(at):
            name, at = joined(name, at, size, n)
            size *= 2
        full_name, full_at = (name, at) if size == gram else joined(name, at, gram - size, n)
        if len(full_at):
            order = np.lexsort((full_at, full_name))
            x, place = full_name[order], full_at[order]
            lag = np.diff(place)
            good = (x[1:] == x[:-1]) & (lag >= low) & (lag <= high)
            yield place[:-1][good], lag[good]
        low, high = high + 1, 2 * high


def agreeing(word: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from ``a`` and ``b`` (a < b) on agree, onwards or backwards."""
    total, size = 0, 64
    while True:
        most = min(size, (len(word) - b if step > 0 else a + 1) - total)
        if most <= 0:
            return total
        i = np.arange(total, total + most) * step
        other = np.flatnonzero(word[a + i] != word[b + i])
        if len(other):
            return total + int(other[0])
        total, size = total + most, 2 * size


def runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if len(words) < least:
        return []
    word, out = named(words), []
    covered: dict[int, int] = {}  # furthest word that an extension of a lag has been through
    for place, lag in seeds(word, least, times):
        for k in np.lexsort((place, lag)).tolist():
            i, q = int(place[k]), int(lag[k])
            if i < covered.get(q, 0):
                continue
            begin = i - agreeing(word, i - 1, i - 1 + q, -1) if i else 0
            end = i + agreeing(word, i, i + q, 1)
            covered[q] = end
            if end - begin + q >= max(least, times * q):
                out.append((begin, end - begin + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        step[start + q] += 1
        step[start + length] -= 1
    stay = np.cumsum(step)[:-1] == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def searched(least: int, times: int, change: Callable[[int | None, list[bytes]], list[bytes]] | None):
    def run(batches):
        ids, counts, found, left, size = [], [], [], [], 0

        def result():
            flat = [r for x in found for r in x]
            fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            off = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), lists, as_strings(left)], names=["doc_id", "n_words", "runs", "collapsed"])

        for b in batches:
            off, data = utf8(b.column("text"))
            for r, i in enumerate(b.column("doc_id").to_pylist()):
                words = data[off[r] : off[r + 1]].tobytes().split()
                if change is not None:
                    words = change(i, words)
                here = runs(words, least, times)
                for x, v in zip((ids, counts, found, left), (i, len(words), here, b" ".join(kept(words, here))), strict=True):
                    x.append(v)
                size += len(left[-1])
                if len(ids) == ROWS or size > BYTES:
                    yield result()
                    ids, counts, found, left, size = [], [], [], [], 0
        if ids:
            yield result()

    return run


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs``.

    ``runs`` are (start, length, period) in words from 0, by start, then period; ``collapsed`` the
    words that are no repetition, with single spaces.  ``times`` is 3 or more.  ``change``
    gives the words to search in place of those of a document.
    """
    if times < 3 or least < 1:
        raise ValueError("a run has three periods at least")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(searched(least, times, change), RESULT)


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document (by a digest of its id; a null id counts as empty text)
    from some word on replaced by repetitions of a period, as the registered query plants them."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run of greatest length by period, and digests of the runs and of what is left."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    # exact comparison of fractions: the products fit in a decimal of 38 digits
    wide = lambda c: c.cast("decimal(19,0)")
    more = lambda x, y: wide(x["length"]) * wide(y["period"]) - wide(y["length"]) * wide(x["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(more(y, x) > 0, y).otherwise(x))
    told = found.withColumn("best", best)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
