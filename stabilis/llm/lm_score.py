"""Language-model scores by prediction by partial matching over bytes, beside a word baseline.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that
follow them in all training texts.  A text is coded byte by byte from its longest context in the
trie: a byte seen there gets its share, another one the escape share (method D: half a count of each
different byte seen) times its share in the next shorter context, where the bytes
already ruled out are excluded; below the empty context all bytes left are alike.  A sign that
no text holds marks begin and end, so probabilities are of whole texts.

The trie has all contexts of the training texts and stays a table.  The share of each byte after
each context that any text has is worked out once, length by length: a context's bytes follow its
suffix too, so what is excluded there is what the longer context has, and a step needs only the
rows of one shorter context (256 contexts of 256 bytes at most) in one place.  The parts of the
table are handed the shares that their texts need by a shuffle.  Parts are blocks of rows as they
are read, so ``docs`` should be a table as it is read; a text without its shares is an error.
With a number of ``contexts``, the trie has the most frequent ones only and is broadcast.

The baseline adds the logarithms of smoothed word frequencies; counts of all words are gathered
by a shuffle and handed back to the parts of the table that hold the words.

Null texts count as empty; without training rows all bytes are alike and word counts are 0;
equal rows get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, checkpoint, crc_mod, forget, n_partitions, numbered, slices, utf8, word_names, words

ORDER = 5
#: Bits of the number of rows in a part, and bytes of text that are sorted at a time.
PART_BITS, SORTED = 14, 1 << 23
EDGE = 0xFF
#: The name of the end that follows the last word of a text.
END = np.int64(-6148914691236517206)


def held_out(doc_id="doc_id"):
    return crc_mod(doc_id, 10) == 0


# ---- the byte model


def edged(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the ``ORDER`` bytes before each byte, the byte, and the row; with ends of texts."""
    n = len(off) - 1
    size = np.diff(off) + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    stream = np.full(int(begin[-1]), EDGE, np.uint8)
    inside = np.ones(len(stream), bool)
    inside[begin[1:] - 1] = False
    stream[inside] = data
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(stream)) - begin[row]
    code = np.zeros(len(stream), np.uint64)
    for k in range(1, ORDER + 1):
        before = np.full(len(stream), EDGE, np.uint8)
        before[k:] = stream[:-k] if k < len(stream) else before[k:]
        before[place < k] = EDGE
        code |= before.astype(np.uint64) << U64(8 * (k - 1))
    return code, stream, row


def count_grams(batches):
    """Counts of each context with the byte after it, of a task's training texts."""
    have, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in batches:
        off, data = utf8(b.column("text"))
        for i, j in slices(off):
            code, byte, _ = edged(off[i : j + 1] - off[i], data[off[i] : off[j]])
            g, c = np.unique(code << U64(8) | byte, return_counts=True)
            have, at = np.unique(np.concatenate([have, g]), return_inverse=True)
            count = np.bincount(at, np.concatenate([count, c]), len(have)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int64)), pa.array(count)], names=["gram", "c"])


def train(texts: DataFrame, contexts: int) -> Model:
    """The model of the column ``text`` with the most frequent contexts."""
    grams = texts.select("text").mapInArrow(count_grams, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    kept = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.expr(f"shiftright(gram, 8) & {(1 << 8 * k) - 1}L").alias("ctx"), F.expr("gram & 255L").alias("byte")) for k in range(ORDER + 1)))).alias("x")
    seen = checkpoint(grams.select(kept, "c").groupBy("x.k", "x.ctx", "x.byte").agg(F.sum("c").alias("c")))
    top = seen.groupBy("k", "ctx").agg(F.sum("c").alias("total")).orderBy(F.desc("total"), "k", "ctx").limit(contexts)
    rows = seen.join(F.broadcast(top.select("k", "ctx")), ["k", "ctx"]).toPandas()
    return Model.of(rows["k"].to_numpy(), rows["ctx"].to_numpy(), rows["byte"].to_numpy(), rows["c"].to_numpy())


class Model:
    """Contexts by length, and the log10 share of each byte after each of them."""

    def __init__(self, codes: list[np.ndarray], first: list[int], share: np.ndarray):
        self.codes, self.first, self.share = codes, first, share

    @classmethod
    def of(cls, k, ctx, byte, c) -> Model:
        nodes: dict[tuple[int, int], np.ndarray] = {}
        for a, x, s, n in zip(k.tolist(), ctx.tolist(), byte.tolist(), c.tolist(), strict=True):
            nodes.setdefault((a, x), np.zeros(256))[s] += n
        nodes.setdefault((0, 0), np.zeros(256))
        order = sorted(nodes)
        share = np.zeros((len(order), 256))
        for i, (a, x) in enumerate(order):
            p, left, free = share[i], 1.0, np.ones(256, bool)
            for j in range(a, -1, -1):
                n = np.where(free, nodes[j, x & ((1 << 8 * j) - 1)], 0.0)
                seen = n > 0
                d = int(seen.sum())
                if not d:
                    continue
                escape = 0.5 if d < free.sum() else 0.0  # else nothing is left to escape to
                p[seen] = left * (n[seen] - escape) / n.sum()
                left *= escape * d / n.sum()
                free &= ~seen
            p[free] = left / max(1, free.sum())
        codes = [np.array([x for a, x in order if a == j], np.uint64) for j in range(ORDER + 1)]
        return cls(codes, np.cumsum([0, *map(len, codes)])[:-1].tolist(), np.log10(share).astype(np.float32))

    def nodes(self, code: np.ndarray) -> np.ndarray:
        """The longest context in the trie for each code."""
        out = np.zeros(len(code), np.int32)
        open_ = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            have = self.codes[k]
            if not len(have) or not len(open_):
                continue
            c = code[open_] & U64((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(have, c), len(have) - 1)
            hit = have[at] == c
            out[open_[hit]] = self.first[k] + at[hit]
            open_ = open_[~hit]
        return out

    def score(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        code, byte, row = edged(off, data)
        return np.bincount(row, self.share[self.nodes(code), byte], len(off) - 1)


# ---- the byte model as a table

#: Rows of a length: the context and the byte, its count, the sum and number of the bytes after the
#: context, the share of the byte when the context has escaped, and its share.
LEVEL = "gram long, c long, total long, kinds long, escaped double, share double"


def part_grams(batches):
    """The distinct bytes with their contexts of each part, with their counts in training texts."""
    part_now, held, size = None, [], 0
    have, count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged():
        if not held:
            return have, count
        key = np.sort(np.concatenate(held))
        gram = key >> 1
        begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        c = np.add.reduceat(key & 1, begin)
        if not len(have):
            return gram[begin], c
        new, at = np.unique(np.concatenate([have, gram[begin]]), return_inverse=True)
        return new, np.bincount(at, np.concatenate([count, c]), len(new)).astype(np.int64)

    def rows():
        gram, c = merged()
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(gram), part_now, np.int64)), pa.array(c)], names=["gram", "part", "c"])

    for b in batches:
        off, data = utf8(b.column("text"))
        part = b.column("part").to_numpy()
        learn = np.array(b.column("learn").to_pylist(), bool)
        for i, j in slices(off):
            code, byte, row = edged(off[i : j + 1] - off[i], data[off[i] : off[j]])
            key = ((code << U64(8) | byte) << U64(1) | learn[i:j][row]).astype(np.int64)
            for p in np.unique(part[i:j]):  # parts ascend within a task
                if p != part_now:
                    if part_now is not None:
                        yield rows()
                    part_now, held, size = p, [], 0
                    have, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
                mine = key[part[i:j][row] == p]
                held.append(mine)
                size += len(mine)
                if size > SORTED:
                    have, count = merged()
                    held, size = [], 0
    if part_now is not None:
        yield rows()


def total_grams(batches):
    """Of a partition dealt by gram: the counts over all parts and the parts that need it."""
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        gram, part, c = (t.column(x).to_numpy() for x in ("gram", "part", "c"))
        order = np.argsort(gram, kind="stable")
        gram, part, c = gram[order], part[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        parts = pa.ListArray.from_arrays(pa.array(np.append(begin, len(gram)).astype(np.int32)), pa.array(part))
        yield pa.RecordBatch.from_arrays([pa.array(gram[begin]), pa.array(np.add.reduceat(c, begin)), parts], names=["gram", "c", "parts"])


def shorter(k: int) -> str:
    """The context of ``k`` bytes of a gram, as SQL."""
    return f"shiftright(gram, 8) & {(1 << 8 * k) - 1}L"


def deepen(gram, c, up_gram, up_c, up_total, up_kinds, up_escaped, up_share, k):
    """The columns of ``LEVEL`` for sorted grams of ``k`` bytes of context from those of one less."""
    ctx = gram >> 8
    begin = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    spread = np.diff(np.append(begin, len(ctx)))
    every = lambda x: np.repeat(np.add.reduceat(x, begin), spread)
    total, kinds = every(c), every((c > 0).astype(np.int64))
    if k:
        at = np.searchsorted(up_gram, gram & ((1 << 8 * k) - 1))
        n, d = up_c[at], up_kinds[at]
        left = up_total[at] - every(np.where(c > 0, n, 0))  # counts of the shorter context that aren't excluded
        new = d - kinds
        escape = np.where(d < 256, 0.5, 0.0)
        some = np.maximum(left, 1)
        escaped = np.where(n > 0, (n - escape) / some, np.where(new > 0, escape * new / some, 1.0) * up_escaped[at])
        below = up_share[at]
    else:
        escaped = 1 / np.maximum(256 - kinds, 1)
        below = escaped
    known = np.maximum(total, 1)
    share = np.where(c > 0, (c - np.where(kinds < 256, 0.5, 0.0)) / known, 0.5 * kinds / known * escaped)
    return total, kinds, escaped, np.where(total > 0, share, below)


def columns_of(batches, names):
    """Columns of a partition in order of gram, those of the shorter contexts first."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    up = np.array(t.column("up").to_pylist(), bool)
    out = []
    for mask in (up, ~up):
        s = t.filter(pa.array(mask))
        out.append(s.take(pa.array(np.argsort(s.column("gram").to_numpy()))))
    above = [out[0].column(x).to_numpy() for x in names]
    return above, out[1]


NAMES = [x.split()[0] for x in LEVEL.split(", ")]


def lengthened(k: int):
    def run(batches):
        got = columns_of(batches, NAMES)
        if got is not None and got[1].num_rows:
            above, rows = got
            gram, c = rows.column("gram").to_numpy(), rows.column("c").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, c, *deepen(gram, c, *above, k))], names=NAMES)

    return run


def handed(batches):
    """For each part, the sorted grams that it needs and the log10 shares, as bytes."""
    got = columns_of(batches, NAMES)
    if got is None or not got[1].num_rows:
        return
    above, rows = got
    gram, c = rows.column("gram").to_numpy(), rows.column("c").to_numpy()
    share = np.log10(deepen(gram, c, *above, ORDER)[3]).astype(np.float32)
    parts = rows.column("parts").combine_chunks()
    which = np.repeat(np.arange(len(gram)), parts.value_lengths().to_numpy())
    part = parts.flatten().to_numpy()
    order = np.argsort(part, kind="stable")
    part, which = part[order], which[order]
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for i, j in zip(begin, np.append(begin[1:], len(part)), strict=True):
        g = gram[which[i:j]]
        yield pa.RecordBatch.from_arrays([pa.array([part[i]], pa.int64()), pa.array([np.diff(g, prepend=0).tobytes()], pa.binary()), pa.array([share[which[i:j]].tobytes()], pa.binary())], names=["part", "grams", "shares"])


def shares(texts: DataFrame) -> DataFrame:
    """(part, grams, shares) of all grams of texts by the model of the training texts."""
    n = n_partitions(texts.sparkSession)
    counted = texts.select("text", "part", "learn").mapInArrow(part_grams, "gram long, part long, c long").repartition(n, "gram")
    levels = [checkpoint(counted.mapInArrow(total_grams, "gram long, c long, parts array<long>"))]
    for k in range(ORDER - 1, -1, -1):
        levels.insert(0, checkpoint(levels[0].groupBy(F.expr(f"gram & {(1 << 8 * (k + 1)) - 1}L").alias("gram")).agg(F.sum("c").alias("c"))))
    known = None
    for k, rows in enumerate(levels):
        rows = rows.withColumn("up", F.lit(False))
        if known is not None:
            rows = rows.unionByName(known.withColumn("up", F.lit(True)), allowMissingColumns=True)
        else:
            rows = rows.select("*", *(F.lit(None).cast(t).alias(x) for x, t in (y.split() for y in LEVEL.split(", ")[2:])))
        dealt = rows.repartition(n, F.expr(shorter(max(0, k - 1))))
        if k == ORDER:
            return dealt.mapInArrow(handed, "part long, grams binary, shares binary")
        before, known = known, checkpoint(dealt.mapInArrow(lengthened(k), LEVEL))
        forget(before)
        forget(levels[k])


# ---- the word baseline


def tokens(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of lower-cased texts, with an end after each text, and their rows."""
    data = LOWER[data]
    start, end, row = words(off, data)
    n = len(off) - 1
    name = word_names(data, start, end, 7).view(np.int64)
    return np.concatenate([name, np.full(n, END)]), np.concatenate([row, np.arange(n)])


def part_words(batches):
    """The distinct words of each part, with their counts in training texts."""
    have: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        off, data = utf8(b.column("text"))
        part = b.column("part").to_numpy()
        learn = np.array(b.column("learn").to_pylist(), bool)
        for i, j in slices(off):
            name, row = tokens(off[i : j + 1] - off[i], data[off[i] : off[j]])
            for p in np.unique(part[i:j]):
                mine = part[i:j][row] == p
                old, count = have.get(p, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                new, at = np.unique(np.concatenate([old, name[mine]]), return_inverse=True)
                c = np.concatenate([count, learn[i:j][row[mine]].astype(np.int64)])
                have[p] = new, np.bincount(at, c, len(new)).astype(np.int64)
    for p, (name, count) in have.items():
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(name), p, np.int64)), pa.array(count)], names=["word", "part", "c"])


def total_words(batches):
    """Of a partition dealt by word: the counts over all parts, for each part that has the word."""
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        word, part, c = (t.column(x).to_numpy() for x in ("word", "part", "c"))
        order = np.argsort(word, kind="stable")
        word, part, c = word[order], part[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total = np.add.reduceat(c, begin)
        size = np.diff(np.concatenate([begin, [len(word)]]))
        first = np.zeros(len(word), bool)
        first[begin] = True
        every = np.repeat(total, size)
        known = every > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in (word, part, every, first)], names=["word", "part", "c", "first"])


def table_of(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams of a part and their log10 shares."""
    packed = counts.filter(counts.column("grams").is_valid())
    gram = [np.cumsum(np.frombuffer(x, np.int64)) for x in packed.column("grams").to_pylist()]
    share = [np.frombuffer(x, np.float32) for x in packed.column("shares").to_pylist()]
    gram, share = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((gram, np.int64), (share, np.float32)))
    order = np.argsort(gram)
    return gram[order], share[order]


def looked_up(gram: np.ndarray, share: np.ndarray, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """log10 probability of each text from the shares of its part."""
    code, byte, row = edged(off, data)
    name = (code << U64(8) | byte).astype(np.int64)
    at = np.minimum(np.searchsorted(gram, name), len(gram) - 1)
    if not len(gram) or (gram[at] != name).any():
        raise ValueError("texts were read in another order")
    return np.bincount(row, share[at], len(off) - 1)


def scored(model: Model | None):
    """Sums for the texts of a part, with the word counts and the shares handed back to it."""

    def run(key, texts: pa.Table, counts: pa.Table) -> pa.Table:
        known = counts.filter(counts.column("grams").is_null())
        word, c = known.column("word").to_numpy(), known.column("c").to_numpy()
        order = np.argsort(word)
        word, c = word[order], c[order]
        score = model.score if model else partial(looked_up, *table_of(counts))
        out = []
        for b in texts.combine_chunks().to_batches():
            off, data = utf8(b.column("text"))
            for i, j in slices(off):
                o, d = off[i : j + 1] - off[i], data[off[i] : off[j]]
                name, row = tokens(o, d)
                at = np.minimum(np.searchsorted(word, name), max(0, len(word) - 1))
                n = np.where(word[at] == name, c[at], 0) if len(word) else np.zeros(len(name), np.int64)
                cols = [np.bincount(row, minlength=j - i), np.bincount(row, n > 0, j - i).astype(np.int64), np.bincount(row, np.log10(n + 0.1), j - i), score(o, d)]
                out.append(pa.Table.from_arrays([*(b.column(x).slice(i, j - i) for x in ("rest", "text")), *map(pa.array, cols)], names=["rest", "text", "n_tokens", "n_known", "logs", "score"]))
        return pa.concat_tables(out) if out else pa.table({"rest": texts.column("rest"), "text": texts.column("text"), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "logs": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    return run


MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_texts(docs: DataFrame, learn, contexts: int | None = None) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score; ``learn`` is the
    condition of training rows.  All contexts are kept unless a number is given."""
    n = n_partitions(docs.sparkSession)
    model = train(docs.filter(learn), contexts) if contexts else None
    names = [c for c in docs.columns if c not in MADE]
    rest = [F.col(c) for c in names if c != "text"] or [F.lit(None).cast("int").alias("nothing")]
    texts = numbered(docs.select(F.struct(*rest).alias("rest"), "text", learn.alias("learn")))
    texts = texts.withColumn("part", F.shiftright("uid", PART_BITS))
    counts = texts.select("text", "part", "learn").mapInArrow(part_words, "word long, part long, c long").repartition(n, "word").mapInArrow(total_words, "word long, part long, c long, first boolean")
    total = counts.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("train_tokens"), F.count("*").alias("types"))
    back = counts.select("word", "part", "c", *(F.lit(None).cast("binary").alias(x) for x in ("grams", "shares")))
    if model is None:
        back = back.unionByName(shares(texts), allowMissingColumns=True)
    text = T.StructField("text", T.StringType())
    longs = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")]
    doubles = [T.StructField(c, T.DoubleType()) for c in ("logs", "score")]
    out = texts.select("rest", "text", "part").groupBy("part").cogroup(back.groupBy("part")).applyInArrow(scored(model), T.StructType([*texts.select("rest").schema, text, *longs, *doubles]))
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.1 * (F.col("types") + 1))
    kept = ["text" if c == "text" else f"rest.`{c}`" for c in names]
    return out.crossJoin(F.broadcast(total)).select(*kept, "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")
