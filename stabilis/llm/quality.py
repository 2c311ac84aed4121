"""Quality of documents by co-training a classifier of contents and one of metadata.

The content view sees the bytes of a text: how often each occurs, how words are made up.  The
metadata view sees source, language and length.  Each view is a logistic regression; over some
rounds each gives the other the labels that it is most sure of on all documents without labels, at
a calibrated confidence of ``sure`` or more.  Both views are then calibrated on labelled
documents that neither has learned from, and a regression on the two calibrated scores combines
them.  A document is kept if the combined probability of quality is at least one half.

Learning fits on at most ``Settings.labelled`` labelled documents, those with the least hashes of their
ids, one row of each id (that of the least text); this is the documented bound of the sample.  Documents
without labels all take part, one row of each id, and each row without an id: their features are a table, and
what a view learns from those that it has been told of are sums over it, of slopes and curvatures, for
``newton`` steps in each round.  A told label stays.
Scores are of whole texts of all documents.  Null and empty texts get score 0 and are not kept;
null metadata counts as a value of its own; rows that repeat get equal scores; an empty table
gives an empty result; without labels of
both kinds all other documents get score 1; very long texts count whole; columns named as the
new ones are replaced.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, checkpoint, forget, slices, utf8, word_names, words


@dataclass(frozen=True)
class Settings:
    labelled: int = 6000
    rounds: int = 3
    newton: int = 2
    sure: float = 0.97
    penalty: float = 1e-3
    steps: int = 300
    balanced: bool = True


MADE = ("content_score", "metadata_score", "score", "keep")
SOURCE_CELLS, LANG_CELLS, SIZE_CELLS = 64, 16, 16
N_CONTENT = 256 + 8
#: Bytes and words added to a text's own before shares are taken, so that short ones say little.
MILD_BYTES, MILD_WORDS = 64, 8


def content(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Content features of each text: roots of byte shares and of some counts of words."""
    n = len(off) - 1
    size = np.diff(off)[:, None] + MILD_BYTES
    row = np.repeat(np.arange(n), np.diff(off))
    x = np.zeros((n, N_CONTENT), np.float32)
    x[:, :256] = np.sqrt(np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256) / size)
    start, end, at = words(off, data)
    count = np.bincount(at, minlength=n)
    per = count + MILD_WORDS
    length = end - start
    x[:, 256] = np.bincount(at, length, n) / per / 10
    x[:, 257] = np.sqrt(np.bincount(at, length.astype(float) ** 2, n) / per) / 10
    upper = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    sign = np.concatenate([[0], np.cumsum((data < 0x80) & ~SPACE[data] & ~np.isin(data, ALNUM))])
    if len(start):
        x[:, 258] = np.bincount(at, (upper[end] - upper[start]) == length, n) / per
        x[:, 259] = np.bincount(at, (sign[end] - sign[start]) >= 2, n) / per
        x[:, 260] = np.bincount(at, length == 1, n) / per
        name = word_names(data, start, end, 5)
        again = np.concatenate([[False], (name[1:] == name[:-1]) & (at[1:] == at[:-1])])
        x[:, 262] = np.bincount(at, again, n) / per
        order = np.lexsort((name, at))
        new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (at[order][1:] != at[order][:-1])])
        x[:, 263] = (count - np.bincount(at[order][new], minlength=n)) / per
    x[:, 261] = np.log10(per) / 4
    return x


ALNUM = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)


def hashed(values: list, cells: int) -> np.ndarray:
    return np.array([cells - 1 if v is None else zlib.crc32(str(v).encode()) % (cells - 1) for v in values], np.int64)


def metadata(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Metadata features: one-hot cells of source, language and size."""
    n = len(source)
    x = np.zeros((n, SOURCE_CELLS + LANG_CELLS + SIZE_CELLS), np.float32)
    at = np.arange(n)
    x[at, hashed(source, SOURCE_CELLS)] = 1
    x[at, SOURCE_CELLS + hashed(lang, LANG_CELLS)] = 1
    size = [SIZE_CELLS - 1 if v is None or v < 0 else min(SIZE_CELLS - 2, int(v).bit_length() // 2 * 2 // 2) for v in n_chars]
    x[at, SOURCE_CELLS + LANG_CELLS + np.array(size, np.int64)] = 1
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression on standardised features, fitted by gradient descent with momentum."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, s: Settings) -> Logistic:
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-6] = 1
        z = (x - mean) / scale
        w, v, b, vb = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
        share = np.full(len(y), 1 / len(y))
        if s.balanced:  # both kinds weigh alike
            share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
        rate = 4 / (1 + np.square(z).sum(1).mean() / 4)
        for _ in range(s.steps):
            g = (sigmoid(z @ w + b) - y) * share
            v = 0.9 * v - rate * (z.T @ g + s.penalty * w)
            vb = 0.9 * vb - rate * g.sum()
            w, b = w + v, b + vb
        return cls(mean, scale, w, b)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weight + self.bias


def one(z: np.ndarray) -> np.ndarray:
    return z[:, None]


PLAIN = Settings(penalty=1e-3, steps=400, balanced=False)


#: The models of a round with their calibrations.
Round = tuple[list[Logistic], list[Logistic]]
#: Size of a part of the sums of a task, in numbers.
PART = 1 << 13
#: No step of Newton's moves the logit of a labelled row by more.
REACH = 4.0


def told_labels(others: list[np.ndarray], history: list[Round], sure: float) -> list[np.ndarray]:
    """What each view has been told of each row over the rounds, -1 for nothing."""
    labels = [np.full(len(others[0]), -1) for _ in others]
    for models, scale in history:
        for i in range(len(others)):
            p = sigmoid(scale[i](one(models[i](others[i]))))
            for j in range(len(others)):
                if j != i:
                    new = (np.maximum(p, 1 - p) >= sure) & (labels[j] < 0)
                    labels[j][new] = (p[new] >= 0.5).astype(int)
    return labels


def slopes(m: Logistic, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For both kinds, in one row: number of rows, slope and curvature of their loss by weights and bias."""
    out = []
    for kind in (0, 1):
        z = ((x[y == kind] - m.mean) / m.scale).astype(np.float32)
        z = np.concatenate([z, np.ones((len(z), 1), np.float32)], axis=1)
        p = sigmoid(z @ np.append(m.weight, m.bias).astype(np.float32)).astype(np.float32)
        h = (z * (p * (1 - p))[:, None]).T @ z
        out += [[len(z)], (p - kind) @ z, h.ravel()]
    return np.concatenate(out).astype(float)


def told_slopes(others: list[np.ndarray], history: list[Round], models: list[Logistic], sure: float) -> np.ndarray:
    """Those of all views, over the rows that each has been told of."""
    labels = told_labels(others, history, sure)
    return np.concatenate([slopes(m, x[y >= 0], y[y >= 0]) for m, x, y in zip(models, others, labels, strict=True)])


def stepped(m: Logistic, x: np.ndarray, y: np.ndarray, more: np.ndarray, s: Settings) -> Logistic:
    """One step of Newton's for labelled rows and sums of others."""
    d = len(m.weight) + 1
    both = (slopes(m, x, y) + more).reshape(2, 1 + d + d * d)
    n = both[:, 0]
    share = 0.5 / np.maximum(1, n) if s.balanced else np.full(2, 1 / n.sum())
    pull = np.append(np.full(d - 1, s.penalty), 1e-9)
    at = np.append(m.weight, m.bias)
    slope = share @ both[:, 1 : 1 + d] + pull * at
    step = np.linalg.solve((share @ both[:, 1 + d :]).reshape(d, d) + np.diag(pull), slope)
    far = np.abs((x - m.mean) / m.scale @ step[:-1] + step[-1]).max(initial=0)
    at = at - step * min(1.0, REACH / max(far, 1e-12))
    return Logistic(m.mean, m.scale, at[:-1], float(at[-1]))


@dataclass
class CoTrained:
    views: list[Logistic]
    calibrated: list[Logistic]
    joint: Logistic
    added: list[int]

    @classmethod
    def fit(cls, views: list[np.ndarray], y: np.ndarray, fold: np.ndarray, others, s: Settings) -> CoTrained:
        """``fold`` marks the labelled rows kept for calibration; ``others`` have no labels: their features, or
        a function of the rounds so far and the models that gives ``told_slopes`` of all."""
        learn = ~fold
        told = others if callable(others) else lambda history, models: told_slopes(others, history, models, s.sure)
        models = [Logistic.fit(x[learn], y[learn], s) for x in views]
        history, added = [], []
        for r in range(s.rounds + 1):
            scale = [Logistic.fit(one(m(x[fold])), y[fold], PLAIN) for m, x in zip(models, views, strict=True)]
            if r == s.rounds:
                break
            history.append((models, scale))
            for step in range(s.newton):
                more = told(history, models)
                sizes = [2 * (1 + d + d * d) for d in (x.shape[1] + 1 for x in views)]
                parts = np.split(more, np.cumsum(sizes)[:-1])
                models = [stepped(m, x[learn], y[learn], p, s) for m, x, p in zip(models, views, parts, strict=True)]
                if not step:
                    added.append(int(sum(p[0] + p[len(p) // 2] for p in parts)) - sum(added))
        both = np.stack([c(one(m(x[fold]))) for c, m, x in zip(scale, models, views, strict=True)], axis=1)
        return cls(models, scale, Logistic.fit(both, y[fold], PLAIN), added)

    def __call__(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated probability by each view, and the combined one."""
        z = [c(one(m(x))) for c, m, x in zip(self.calibrated, self.views, views, strict=True)]
        return [sigmoid(v) for v in z] + [sigmoid(self.joint(np.stack(z, axis=1)))]


def featured(keep: tuple[str, ...]):
    """Tasks that give the columns ``keep`` and the features of both views."""

    def run(batches):
        for b in batches:
            off, data = utf8(b.column("text"))
            out = []
            for i, j in slices(off):
                out.append(content(off[i : j + 1] - off[i], data[off[i] : off[j]]))
            x = np.concatenate(out) if out else np.zeros((0, N_CONTENT), np.float32)
            m = metadata(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            rows = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, m)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *rows], names=[*keep, "content", "metadata"])

    return run


def features(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def summed(history: list[Round], models: list[Logistic], sure: float):
    """Tasks that give ``told_slopes`` of their rows, in parts."""

    def run(batches):
        total = 0.0
        for b in batches:
            if b.num_rows:
                total = total + told_slopes([features(b.column(c)) for c in ("content", "metadata")], history, models, sure)
        if not np.isscalar(total):
            parts = [total[i : i + PART].tobytes() for i in range(0, len(total), PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])

    return run


def added_up(batches):
    """Sums of equal parts, one row each."""
    have: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
            have[k] = have.get(k, 0) + np.frombuffer(v)
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([v.tobytes() for v in have.values()], pa.binary())], names=["part", "sums"])


def train(docs: DataFrame, labels: DataFrame, s: Settings) -> CoTrained | None:
    """The co-trained views, from documents whose ids have a label and all others."""
    order = lambda c: F.xxhash64(F.lit("quality"), F.col(c))
    told = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    told = told.withColumn("o", order("doc_id"))
    some = told.orderBy("o", "doc_id").limit(s.labelled).select(F.col("doc_id").alias("l_id"), "quality")
    docs = docs.select("doc_id", "text", "source", "lang", "n_chars").filter("text is not null and text <> ''").withColumn("o", order("doc_id"))
    mine = docs.join(F.broadcast(some), F.col("doc_id") == F.col("l_id"))
    first = F.min(F.struct("text", "source", "lang", "n_chars")).alias("d")
    some = mine.groupBy("l_id", "o", "quality").agg(first).select("o", "quality", "d.*")
    rows = some.mapInArrow(featured(("o", "quality")), "o long, quality int, content binary, metadata binary").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["o", "quality", "content"])
    views = [np.array([np.frombuffer(v, np.float32) for v in rows[c]], np.float64).reshape(len(rows), -1) for c in ("content", "metadata")]
    y = rows["quality"].to_numpy()
    fold = rows["o"].to_numpy() % 4 == 0
    if min(len(set(y[fold])), len(set(y[~fold]))) < 2:
        return None
    # ids are shuffled beside features and not beside texts
    made = docs.mapInArrow(featured(("doc_id",)), T.StructType([docs.schema["doc_id"], T.StructField("content", T.BinaryType()), T.StructField("metadata", T.BinaryType())]))
    made = made.join(told.select("doc_id"), "doc_id", "left_anti")
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("content", "metadata", F.monotonically_increasing_id()))
    one_each = made.withColumn("apart", apart).groupBy("doc_id", "apart").agg(F.min(F.struct("content", "metadata")).alias("d"))
    rest = checkpoint(one_each.select("d.*"))
    spread = docs.sparkSession.sparkContext.defaultParallelism

    def sums(history: list[Round], models: list[Logistic]) -> np.ndarray:
        each = rest.mapInArrow(summed(history, models, s.sure), "part int, sums binary").repartition(spread, "part").mapInArrow(added_up, "part int, sums binary")
        got = {r["part"]: np.frombuffer(r["sums"]) for r in each.toLocalIterator()}
        if got:
            return np.concatenate([got[k] for k in sorted(got)])
        return np.zeros(sum(2 * (1 + d + d * d) for d in (x.shape[1] + 1 for x in views)))

    model = CoTrained.fit(views, y, fold, sums, s)
    forget(rest)
    return model


def scorer(model: bytes):
    def run(batches):
        m = pickle.loads(model)
        for b in batches:
            off, data = utf8(b.column("text"))
            size = np.diff(off)
            out = np.zeros((3, b.num_rows))
            for i, j in slices(off):
                if m is None:
                    out[:, i:j] = 1
                    continue
                meta = metadata(*(b.column(c).slice(i, j - i).to_pylist() for c in ("source", "lang", "n_chars")))
                out[:, i:j] = m([content(off[i : j + 1] - off[i], data[off[i] : off[j]]), meta])
            out[:, size == 0] = 0
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out), pa.array(out[2] >= 0.5)], names=[*b.schema.names, *MADE])

    return run


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with content_score, metadata_score, score and keep."""
    docs = docs.select(*[c for c in docs.columns if c not in MADE])
    model = pickle.dumps(train(docs, labels, s))
    made = [*(T.StructField(c, T.DoubleType()) for c in MADE[:3]), T.StructField("keep", T.BooleanType())]
    return docs.mapInArrow(scorer(model), T.StructType([*docs.schema, *made]))
