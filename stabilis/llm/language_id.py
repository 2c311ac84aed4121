"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of labelled texts,
and then reads every text, window by window: each byte gets language probabilities from the
states of both directions, and a text's probabilities are the mean over its letters.

Training fits on at most ``Settings.train_docs`` labelled texts, dealt evenly over the languages
by the hashes of their ids, and ``Settings.train_windows`` windows of ``Settings.span`` bytes of
them; this is the documented bound of the sample, and only windows reach the driver.  Prediction reads every byte of every
text and nothing but the text.  Null texts and texts without a letter (a code point of Unicode category L) are ``und`` with score 0;
texts longer than a slice are read in pieces and pooled as one; repeated rows get equal results;
without any labelled row all predictions are ``und``; ties go to the lesser language; an empty
table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import pickle
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, slices, utf8


@dataclass(frozen=True)
class Settings:
    train_docs: int = 4000
    train_windows: int = 6000
    span: int = 64
    hidden: int = 12
    epochs: int = 8
    batch: int = 200
    rate: float = 0.01
    seed: int = 11


class ByteGRU:
    """Two gated recurrent layers, one in each direction, and a softmax over languages.

    Inputs are bytes, so the input weights are rows of a table; gates are (update, reset, new).
    """

    def __init__(self, hidden: int, classes: int, seed: int):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[d + "x"] = draw(256, 3 * hidden, s=0.3)
            self.p[d + "u"] = draw(hidden, 3 * hidden, s=hidden**-0.5)
            self.p[d + "o"] = draw(hidden, classes, s=hidden**-0.5)
        self.p["c"] = np.zeros(classes, np.float32)

    def states(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of direction ``d`` after each byte; x is (time, texts).

        Gates are hard sigmoids, clip(a / 4 + 1 / 2, 0, 1); the factor is in their weights here.
        """
        h, u, table = self.h, self.p[d + "u"], self.p[d + "x"]
        quarter = np.repeat(np.array([0.25, 1], u.dtype), (2 * h, h))
        half = np.repeat(np.array([0.5, 0], u.dtype), (2 * h, h))
        table, u = table * quarter + half, u * quarter
        gates, new = (np.ascontiguousarray(table[:, c]) for c in (slice(0, 2 * h), slice(2 * h, None)))
        ug, un = (np.ascontiguousarray(u[:, c]) for c in (slice(0, 2 * h), slice(2 * h, None)))
        state = np.zeros((x.shape[1], h), u.dtype)
        out = np.empty((*x.shape, h), u.dtype)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            zr = gates.take(x[t], axis=0)
            zr += state @ ug
            np.clip(zr, 0, 1, out=zr)
            z, r = zr[:, :h], zr[:, h:]
            gated = r * state
            n = gated @ un
            n += new.take(x[t], axis=0)
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, state, z, r, gated, n))
            np.subtract(state, n, out=out[t])
            out[t] *= z
            out[t] += n
            state = out[t]
        return out

    def outputs(self, x: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, dict]:
        both = {d: self.states(d, x, None if keep is None else keep.setdefault(d, [])) for d in "fb"}
        flat = both["f"].reshape(-1, self.h) @ self.p["fo"]
        flat += both["b"].reshape(-1, self.h) @ self.p["bo"]
        flat += self.p["c"]
        np.exp(flat, out=flat)  # states are at most 1, so this can't overflow
        flat /= (flat @ np.ones(flat.shape[1], flat.dtype))[:, None]
        return flat.reshape(*x.shape, -1), both

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over positions and its gradient, by backpropagation through time."""
        keep: dict = {}
        prob, both = self.outputs(x, keep)
        t, b = x.shape
        loss = -float(np.mean(np.log(prob[:, np.arange(b), y] + 1e-12)))
        prob[:, np.arange(b), y] -= 1
        prob /= t * b
        g = {"c": prob.sum((0, 1))}
        h = self.h
        for d in "fb":
            u = self.p[d + "u"]
            g[d + "o"] = np.tensordot(both[d], prob, ((0, 1), (0, 1)))
            gx, gu = np.zeros_like(self.p[d + "x"]), np.zeros_like(u)
            back = np.zeros((b, h), u.dtype)
            into = prob @ self.p[d + "o"].T
            das, xs = [], []
            for step, state, z, r, gated, n in reversed(keep[d]):
                ds = back + into[step]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (state - n) * (0.25 * ((z > 0) & (z < 1)))
                dgated = dn @ u[:, 2 * h :].T
                dr = dgated * state * (0.25 * ((r > 0) & (r < 1)))
                dzr = np.concatenate([dz, dr], axis=1, dtype=u.dtype)
                gu[:, : 2 * h] += state.T @ dzr
                gu[:, 2 * h :] += gated.T @ dn
                back = ds * z + dgated * r + dzr @ u[:, : 2 * h].T
                das.append(np.concatenate([dzr, dn], axis=1))
                xs.append(x[step])
            da, xs = np.concatenate(das), np.concatenate(xs)
            order = np.argsort(xs, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(xs[order].astype(np.int16)) != 0]))
            gx[xs[order][at]] = np.add.reduceat(da[order], at)
            g[d + "x"], g[d + "u"] = gx, gu
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, s: Settings) -> list[float]:
        """Adam over shuffled batches; x is (windows, span)."""
        rng = np.random.default_rng(s.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, step = [], 0
        for epoch in range(s.epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), s.batch):
                at = order[i : i + s.batch]
                loss, g = self.gradient(np.ascontiguousarray(x[at].T), y[at])
                step += 1
                rate = s.rate * (1 - epoch / s.epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k in self.p:
                    gk = np.clip(g[k], -1, 1)
                    m[k] += 0.1 * (gk - m[k])
                    v2[k] += 0.001 * (gk * gk - v2[k])
                    self.p[k] -= (rate * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)
                losses.append(loss)
        return losses


@functools.cache
def letter_table() -> np.ndarray:
    """Which code points are letters: Unicode categories Lu, Ll, Lt, Lm and Lo."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def letters_of(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts, one after the other, belong to letters; bytes that are no UTF-8 don't."""
    code = data
    if len(data) and data.max() >= 0x80:
        code = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[code]
    alone = (code >= 0xDC80) & (code <= 0xDCFF)  # stands for one odd byte
    return letter if code is data else np.repeat(letter, np.where(alone, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)))


def fit(docs: DataFrame, s: Settings) -> tuple[ByteGRU | None, list[str]]:
    """The network and its languages, from rows (doc_id, text, lang) that may be learned from."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = rows.select("text", "lang", F.xxhash64(F.lit(s.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "lang").alias("o"))
    per = rows.groupBy("lang").count().orderBy("lang").collect()
    langs = [r["lang"] for r in per]
    if not langs:
        return None, []
    share = max(1, s.train_docs // len(langs))
    bound = F.create_map(*[x for r in per for x in (F.lit(r["lang"]), F.lit(1.2 * share / r["count"] + 20 / r["count"]))])
    some = rows.filter((F.pmod("o", F.lit(1 << 20)) / float(1 << 20)) < F.element_at(bound, F.col("lang")))
    each = -(-2 * s.train_windows // sum(min(share, r["count"]) for r in per))
    cut = some.mapInArrow(windows(s.span, each), "lang string, o long, spans array<binary>")
    least = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "spans"))).filter(F.col("r") <= share)
    return fit_windows([(r["lang"], list(map(bytes, r["spans"]))) for r in least.orderBy("lang", "o", "spans").toLocalIterator()], langs, s)


def windows(span: int, n: int):
    """``n`` stretches of ``span`` bytes from places of each text that its hash sets."""

    def run(batches):
        for b in batches:
            spans = []
            for text, o in zip(b.column("text"), b.column("o").to_pylist(), strict=True):
                data = text.as_buffer()
                at = np.random.default_rng(o & 0xFFFFFFFF).integers(max(1, data.size - span + 1), size=n)
                spans.append([data[int(a) : int(a) + span].to_pybytes() for a in at])
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("o"), pa.array(spans, pa.list_(pa.binary()))], names=["lang", "o", "spans"])

    return run


def fit_windows(texts: list[tuple[str, list[bytes]]], langs: list[str], s: Settings) -> tuple[ByteGRU, list[str]]:
    """A network trained on windows of the texts, as many for each language."""
    rng = np.random.default_rng(s.seed)
    x, y = [], []
    for k, lang in enumerate(langs):
        mine = [w for name, spans in texts if name == lang for w in spans]
        want = max(1, s.train_windows // len(langs)) if mine else 0
        for i in rng.permutation(len(mine))[:want] if len(mine) >= want else rng.integers(len(mine), size=want):
            x.append(np.frombuffer(mine[i].ljust(s.span), np.uint8))
            y.append(k)
    net = ByteGRU(s.hidden, len(langs), s.seed)
    if len(langs) > 1:
        net.train(np.array(x), np.array(y), s)
    return net, langs


def pooled(net: ByteGRU, off: np.ndarray, data: np.ndarray, span: int, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Sums over letters of the positions' probabilities for each text, and its letters."""
    classes = len(net.p["c"])
    total = np.zeros((len(off) - 1, classes))
    letter = letters_of(data)
    so_far = np.concatenate([[0], np.cumsum(letter)])
    letters = so_far[off[1:]] - so_far[off[:-1]]
    n = -(-np.diff(off) // span)
    row = np.repeat(np.arange(len(n)), n)
    begin = off[row] + span * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    for i in range(0, len(row), at_once):
        rows, b = row[i : i + at_once], begin[i : i + at_once]
        place = b[:, None] + np.arange(span)
        inside = place < off[rows + 1][:, None]
        place = np.minimum(place, len(data) - 1)
        x = np.where(inside, data[place], 32).astype(np.uint8)
        prob, _ = net.outputs(np.ascontiguousarray(x.T))
        prob *= (inside & letter[place]).T[:, :, None]
        np.add.at(total, rows, prob.sum(0))
    return total, letters


def reader(model: bytes, span: int):
    def run(batches):
        net, langs = pickle.loads(model)
        for b in batches:
            off, data = utf8(b.column("text"))
            names, scores = [], []
            for i, j in slices(off):
                if net is None:
                    names += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                total, letters = pooled(net, off[i : j + 1] - off[i], data[off[i] : off[j]], span)
                total /= np.maximum(letters, 1)[:, None]
                top = total.argmax(1)
                for r in range(j - i):
                    names.append(langs[top[r]] if letters[r] else "und")
                    scores.append(min(1.0, float(total[r, top[r]])) if letters[r] else 0.0)
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learn: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``, learned from ``learn``."""
    net, langs = fit(learn, s)
    model = pickle.dumps((net, langs))
    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(reader(model, 2 * s.span), f"doc_id {id_type}, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    return crc_mod(doc_id, 4) == 2
