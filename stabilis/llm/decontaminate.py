"""Removal of benchmark passages, reordered ones too, by greedy string tiling.

A text and a benchmark item are candidates if they share seeds, runs of ``TILE`` tokens; what
the shared seeds cover of the item bounds what tiles can cover, and pairs below the threshold
stop there.  The others are tiled: the longest match of tokens not marked yet is marked in both,
again and again, down to ``TILE`` tokens; matches of one length are found by Karp-Rabin
fingerprints that run over both.  A text is contaminated if tiles cover at least ``threshold``
of an item's tokens, in whatever order they stand in the text.

Tokens are runs of letters and digits in lower case (A-Z; bytes of longer code points count as
letters), so punctuation doesn't hide a passage.  Items are handled in blocks of ``BLOCK_TOKENS``
tokens, which bounds what is sent to the tasks, and each block updates the best item of each
text.  Null or empty texts and items match nothing; items of fewer than ``TILE`` tokens only
match texts that hold all their tokens in a row; ties between items go to the smaller id; rows
that repeat get equal results; very long texts are tiled whole, and a seed that stands in many
places of an item is held once; without items nothing is contaminated, and an empty table gives
an empty result; columns named as the new
ones are replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, mix, slices, utf8, word_names

TILE, THRESHOLD = 3, 0.6
BLOCK_TOKENS = 1 << 20
GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x41:0x5B] = GAP[0x61:0x7B] = GAP[0x80:] = False
MADE = ("item_id", "coverage", "contaminated")


def tokens(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the tokens and the row of each."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = LOWER[data]
    gap = GAP[data]
    edges = off[(off > 0) & (off < len(data))]
    first = np.concatenate([[True], gap[:-1]])
    first[edges] = True
    last = np.concatenate([gap[1:], [True]])
    last[edges - 1] = True
    start, end = np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap) + 1
    return word_names(data, start, end, 3), np.searchsorted(off, start, "right") - 1


def seeds(name: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The fingerprint of the ``size`` tokens from each token on; 0 where the row ends before."""
    h = mix(size.astype(np.uint64))
    for i in range(TILE):
        at = np.minimum(np.arange(len(name)) + i, max(0, len(name) - 1))
        inside = size > i
        h = np.where(inside, mix(h * U64(0x9E3779B97F4A7C15) + name[at]), h)
        h[inside & (row[at] != row)] = 0
        if i and len(h):
            h[inside & (np.arange(len(name)) + i >= len(name))] = 0
    return h


class Items:
    """A block of benchmark items and the index of their seeds."""

    def __init__(self, ids: list, texts: list):
        off, data = utf8(pa.array(texts, pa.string()))
        name, row = tokens(off, data)
        n = np.bincount(row, minlength=len(ids))
        self.ids, self.n = np.array(ids, np.int64), n
        self.begin = np.concatenate([[0], np.cumsum(n)])
        self.name = name
        h = seeds(name, row, np.minimum(n, TILE)[row])
        place = np.arange(len(name)) - self.begin[row]
        keep = h != 0
        order = np.lexsort((place[keep], row[keep], h[keep]))
        seed, item, self.place = h[keep][order], row[keep][order], place[keep][order]
        new = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])])) if len(seed) else np.zeros(0, np.int64)
        #: each seed of an item once, with where its places are
        self.seed, self.item, self.at = seed[new], item[new], np.append(new, len(seed))
        self.short = np.unique(n[(n > 0) & (n < TILE)])

    def hits(self, name: np.ndarray, row: np.ndarray):
        """(row, number of the item's seed, token) of every shared seed."""
        out = []
        for size in [TILE, *self.short]:
            h = seeds(name, row, np.full(len(name), size))
            low = np.searchsorted(self.seed, h, "left")
            found = np.flatnonzero((low < len(self.seed)) & (self.seed[np.minimum(low, max(0, len(self.seed) - 1))] == h) & (h != 0)) if len(self.seed) else np.zeros(0, np.int64)
            count = np.searchsorted(self.seed, h[found], "right") - low[found]
            at = np.repeat(low[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            token = np.repeat(found, count)
            out.append((row[token], at, token))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def best(self, off: np.ndarray, data: np.ndarray, threshold: float) -> dict[int, tuple[float, int]]:
        """For rows with a candidate item: the best coverage and the id of its item."""
        name, row = tokens(off, data)
        if not len(name):
            return {}
        r, seed, token = self.hits(name, row)
        item = self.item[seed]
        pair = r * len(self.ids) + item
        # what distinct shared seeds can cover at most, then what they do cover
        every = np.unique(np.stack([pair, seed]), axis=1)
        pairs, inverse = np.unique(every[0], return_inverse=True)
        count = np.bincount(inverse, (self.at[every[1] + 1] - self.at[every[1]]), len(pairs))
        could = count * TILE >= threshold * self.n[pairs % len(self.ids)]
        out: dict[int, tuple[float, int]] = {}
        chosen = np.flatnonzero(np.isin(pair, pairs[could]))
        order = chosen[np.argsort(pair[chosen], kind="stable")]
        for group in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1) if len(order) else []:
            k = int(item[group[0]])
            size, width = int(self.n[k]), min(TILE, int(self.n[k]))
            held = np.zeros(size, bool)
            for x in np.unique(seed[group]):
                place = self.place[self.at[x] : self.at[x + 1]]
                for i in range(width):
                    held[place + i] = True
            if held.sum() < threshold * size:
                continue
            mine = np.unique((token[group][:, None] + np.arange(width)).ravel())
            covered = tile(self.name[self.begin[k] : self.begin[k + 1]], name[mine], np.concatenate([[True], np.diff(mine) > 1]), width) / size
            old = out.get(int(r[group[0]]))
            if old is None or (-covered, self.ids[k]) < (-old[0], old[1]):
                out[int(r[group[0]])] = (covered, int(self.ids[k]))
        return out


def runs(h: np.ndarray, free: np.ndarray, breaks: np.ndarray, length: int) -> np.ndarray:
    """Starts of the stretches of ``length`` tokens that are free and unbroken."""
    bad = np.concatenate([[0], np.cumsum(~free)])
    cut = np.concatenate([[0], np.cumsum(breaks)])
    s = np.arange(len(h) - length + 1)
    return s[(bad[s + length] == bad[s]) & (cut[s + length] == cut[s + 1])]


def fingerprint(name: np.ndarray, length: int, start: np.ndarray) -> np.ndarray:
    """Karp-Rabin fingerprints of ``length`` tokens, from a running sum."""
    base = 0x9E3779B97F4A7C15
    power, inverse = np.full(len(name) + 1, U64(base)), np.full(len(name) + 1, U64(pow(base, -1, 1 << 64)))
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(name) * power[:-1])])
    return (total[start + length] - total[start]) * inverse[start]


def tile(item: np.ndarray, text: np.ndarray, breaks: np.ndarray, least: int) -> int:
    """Tokens of ``item`` that greedy tiles cover; ``breaks`` are where the text's stretches begin."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    whole = np.zeros(len(item), bool)
    stretch = np.diff(np.concatenate([np.flatnonzero(breaks), [len(text)]])).max(initial=0)
    for length in range(int(min(len(item), stretch)), least - 1, -1):
        a, b = runs(item, free_i, whole, length), runs(text, free_t, breaks, length)
        if not len(a) or not len(b):
            continue
        where = defaultdict(list)
        for h, s in zip(fingerprint(text, length, b).tolist(), b.tolist(), strict=True):
            where[h].append(s)
        for h, s in zip(fingerprint(item, length, a).tolist(), a.tolist(), strict=True):
            if h not in where or not free_i[s : s + length].all():
                continue
            for t in where[h]:
                if free_t[t : t + length].all() and (text[t : t + length] == item[s : s + length]).all():
                    free_i[s : s + length] = free_t[t : t + length] = False
                    break
    return int((~free_i).sum())


def update(items: Items, threshold: float):
    def run(batches):
        for b in batches:
            off, data = utf8(b.column("text"))
            ids, cover = b.column("item_id").to_pylist(), b.column("coverage").to_pylist()
            for i, j in slices(off):
                for r, (c, item) in items.best(off[i : j + 1] - off[i], data[off[i] : off[j]], threshold).items():
                    if ids[i + r] is None or (-c, item) < (-cover[i + r], ids[i + r]):
                        ids[i + r], cover[i + r] = item, c
            keep = [c for c in b.schema.names if c not in ("item_id", "coverage")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.int64()), pa.array(cover, pa.float64())], names=[*keep, "item_id", "coverage"])

    return run


def item_blocks(benchmark: DataFrame):
    """The items in blocks of bounded size; each is fetched, indexed and left to its task code."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"]) // 4 + 1
        if size >= BLOCK_TOKENS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the best item_id (null if tiles of no item reach the threshold's bound), its
    coverage, and contaminated."""
    out = docs.select(*[c for c in docs.columns if c not in MADE], F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for items in item_blocks(benchmark):
        out = out.mapInArrow(update(items, threshold), schema)
    return out.withColumn("contaminated", F.col("coverage") >= threshold)
