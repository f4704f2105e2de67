"""Operator 3: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word of a window is a vector of two parts: a learned embedding of the whole word, if it is in ``MIN_DOCS`` training texts (else
none), and the mean of learned embeddings of its characters' trigrams (hashed, edges marked), so that words never seen are judged by
their letters.  A GRU reads the window forwards, another one
backwards; attention weighs their states into one vector, and a logistic unit scores it.  Windows of ``WINDOW`` words overlap by half
and cover the whole text; a document's score is that of its most toxic window.

Training (``fit``): at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean labelled documents (lowest hash of their id first, texts of
at most ``FIT_CHARS`` code points) come to the driver; that bound is the only sample here.  A clean document teaches that all its
windows are clean, its highest above all, a toxic one that its highest window is toxic.  Adam, fixed seed: the same rows give the same
model.  The model (a few MB, bounded by the sample) goes
to the tasks by broadcast.  Scoring reads the text alone, needs no shuffle, and keeps the projected inputs of at most ``MEMO_WORDS``
words a worker.

Defined results: a text without words scores 0; null text is empty; if training rows of either class are missing every score is 0;
repeated rows and null ids each give a row (a null id is held out); repeated labels count once, toxic if any says so.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, ragged, with_columns

WINDOW = 32
TOXIC_ROWS, CLEAN_ROWS = 1000, 2000
FIT_CHARS = 20_000
EPOCHS = 4
MIN_DOCS = 3
MEMO_WORDS = 50_000
#: Bytes of text that are split into words at once.
SLICE_BYTES = 1 << 20
_CHAR_BUCKETS, _WORD_DIM, _CHAR_DIM, _HIDDEN = 1 << 15, 8, 8, 8
_TOKEN = re.compile(r"\w+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character trigrams, one word after the other, and how many each has (as many as letters)."""
    letters = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = ragged(np.cumsum(sizes + 2) - sizes - 2, sizes)
    return (mix((letters[at] << np.uint64(42)) | (letters[at + 1] << np.uint64(21)) | letters[at + 2]) % np.uint64(_CHAR_BUCKETS)).astype(np.int64), sizes


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by row number."""
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


def windows(n: int, size: int = WINDOW) -> np.ndarray:
    """Starts of the windows over n words: every half window, the last one begins before the last half."""
    step = size // 2
    return np.arange(0, max(1, n - step), step)


def _sigmoid(x):
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Model:
    """Parameters; ``u`` and ``d`` prefixes are the forward and backward direction."""

    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]  # rows of the word embedding; row 0: any other word
    memo: dict[str, int] = field(default_factory=dict, repr=False)

    @classmethod
    def new(cls, vocabulary: dict[str, int], seed: int = 1) -> "Model":
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        dim = _WORD_DIM + _CHAR_DIM
        p = {"word": make(len(vocabulary) + 1, _WORD_DIM, scale=0.01), "char": make(_CHAR_BUCKETS, _CHAR_DIM, scale=0.3)}
        p["word"][0] = 0
        for d in "ud":
            p |= {f"{d}_in": make(dim, 3 * _HIDDEN, scale=dim**-0.5), f"{d}_rec": make(_HIDDEN, 3 * _HIDDEN, scale=_HIDDEN**-0.5), f"{d}_bias": np.zeros(3 * _HIDDEN, np.float32)}
        p |= {"att": make(2 * _HIDDEN, scale=0.5), "out": make(2 * _HIDDEN, scale=0.5), "bias": np.full(1, -1.0, np.float32)}
        return cls(p, vocabulary)

    def embed(self, word: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Input vectors of words from their rows and trigrams."""
        chars = np.add.reduceat(self.p["char"][flat], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][word], chars], 1)

    def _gru(self, d: str, g: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction over projected inputs ``g`` (steps, rows, 3h); masked steps hold the state."""
        steps, rows, _ = g.shape
        h, n = np.zeros((rows, _HIDDEN), np.float32), _HIDDEN
        rec, states, cache = self.p[f"{d}_rec"], np.empty((steps, rows, n), np.float32), []
        for t in range(steps) if d == "u" else range(steps - 1, -1, -1):
            zr = _sigmoid(g[t, :, : 2 * n] + h @ rec[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(g[t, :, 2 * n :] + (r * h) @ rec[:, 2 * n :])
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            if keep:
                cache.append((t, h, z, r, c, m))
            h = states[t] = new
        return states, cache

    def logits(self, g: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Window scores from projected inputs (steps, rows, 3h) and the mask (steps, rows)."""
        up, cu = self._gru("u", g["u"], mask, keep)
        down, cd = self._gru("d", g["d"], mask, keep)
        s = np.concatenate([up, down], 2)
        a = s @ self.p["att"] + np.where(mask > 0, np.float32(0), np.float32(-1e9))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, s)
        return pooled @ self.p["out"] + self.p["bias"], (s, a, pooled, cu, cd)

    def gradients(self, rows: np.ndarray, x: np.ndarray, mask: np.ndarray, dz: np.ndarray, kept) -> dict[str, np.ndarray]:
        """Gradients of all parameters but the embeddings, and of the input vectors ``x`` (words, dim); ``rows`` (steps, windows) says which word stands where."""
        s, a, pooled, cu, cd = kept
        n, p = _HIDDEN, self.p
        out = {"out": pooled.T @ dz, "bias": np.array([dz.sum()], np.float32)}
        dpool = dz[:, None] * p["out"]
        da = np.einsum("tbh,bh->tb", s, dpool)
        da = a * (da - (a * da).sum(0))
        out["att"] = np.einsum("tb,tbh->h", da, s)
        ds = a[:, :, None] * dpool + da[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for d, cache, part in (("u", cu, ds[:, :, :n]), ("d", cd, ds[:, :, n:])):
            rec, dg = p[f"{d}_rec"], np.zeros((*rows.shape, 3 * n), np.float32)
            drec, dh = np.zeros_like(rec), np.zeros((rows.shape[1], n), np.float32)
            for t, h, z, r, c, m in reversed(cache):
                dh = dh + part[t]
                dnew = dh * m
                dc = dnew * z * (1 - c * c)
                dz_gate = dnew * (c - h) * z * (1 - z)
                drh = dc @ rec[:, 2 * n :].T
                dr = drh * h * r * (1 - r)
                zr = np.concatenate([dz_gate, dr], 1)
                drec[:, : 2 * n] += h.T @ zr
                drec[:, 2 * n :] += (r * h).T @ dc
                dg[t, :, : 2 * n], dg[t, :, 2 * n :] = zr, dc
                dh = dh - dnew * z + drh * r + zr @ rec[:, : 2 * n].T
            flat = _scatter(rows.ravel(), dg.reshape(-1, 3 * n), len(x))
            out |= {f"{d}_rec": drec, f"{d}_in": x.T @ flat, f"{d}_bias": flat.sum(0)}
            dx += flat @ p[f"{d}_in"].T
        return out | {"x": dx}

    # scoring

    def _project(self, words: list[str]) -> None:
        """Projected inputs of new words, kept for later texts."""
        x = self.embed(np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words)), *trigrams(words))
        new = {d: x @ self.p[f"{d}_in"] + self.p[f"{d}_bias"] for d in "ud"}
        if not self.memo:
            self.table = {d: np.zeros((1, 3 * _HIDDEN), np.float32) for d in "ud"}  # row 0: no word
            self.used = 1
        first, need = self.used, self.used + len(words)
        if len(self.table["u"]) < need:
            self.table = {d: np.concatenate([t, np.zeros((max(need, 2 * len(t)) - len(t), t.shape[1]), np.float32)]) for d, t in self.table.items()}
        for d in "ud":
            self.table[d][first:need] = new[d]
        self.memo.update(zip(words, range(first, need)))
        self.used = need

    def scores(self, texts: list[str], chunk: int = 2048) -> np.ndarray:
        """Score of each text: that of its highest window."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        said = [words_of(t) for t in texts]
        if new := list(set(chain.from_iterable(said)).difference(self.memo)):
            self._project(new)
        at, doc = [], []
        for k, words in enumerate(said):
            if words:
                row = np.zeros(max(len(words) + WINDOW, WINDOW), np.int32)
                row[: len(words)] = np.fromiter(map(self.memo.__getitem__, words), np.int32, len(words))
                starts = windows(len(words))
                at.append(row[starts[:, None] + np.arange(WINDOW)])
                doc.append(np.full(len(starts), k))
        out = np.zeros(len(texts))
        if not at:
            return out
        rows, doc = np.concatenate(at), np.concatenate(doc)
        z = np.empty(len(rows), np.float32)
        for i in range(0, len(rows), chunk):
            part = rows[i : i + chunk].T
            z[i : i + chunk] = self.logits({d: self.table[d][part] for d in "ud"}, (part > 0).astype(np.float32))[0]
        np.maximum.at(out, doc, 1 / (1 + np.exp(-z.astype(np.float64))))
        return out


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 1, batch: int = 32, rate: float = 0.01) -> Model | None:
    """A model from labelled texts; None unless both classes have a text with words."""
    rows = [(words_of(t), int(y)) for t, y in zip(texts, toxic)]
    rows = [(w, y) for w, y in rows if w]
    if len({y for _, y in rows}) < 2:
        return None
    spread = Counter(w for words, _ in rows for w in set(words))
    every = sorted(spread)
    number = {w: i + 1 for i, w in enumerate(every)}
    vocabulary = {w: i + 1 for i, w in enumerate(w for w in every if spread[w] >= MIN_DOCS)}
    word_row = np.array([vocabulary.get(w, 0) for w in every])
    flat, sizes = trigrams(every)
    first = np.cumsum(sizes) - sizes
    docs = []
    for words, y in rows:
        line = np.zeros(len(words) + WINDOW, np.int64)
        line[: len(words)] = [number[w] for w in words]
        docs.append((line[windows(len(words))[:, None] + np.arange(WINDOW)], y))
    model, rng = Model.new(vocabulary, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            part = [docs[k] for k in order[i : i + batch]]
            at, doc = np.concatenate([w for w, _ in part]), np.repeat(np.arange(len(part)), [len(w) for w, _ in part])
            used, place = np.unique(np.r_[0, at.ravel()], return_inverse=True)
            place, own = place[1:].reshape(at.shape).T, used[1:] - 1
            word, n_chars = word_row[own], sizes[own]
            chars = flat[ragged(first[own], n_chars)]
            x = np.concatenate([np.zeros((1, _WORD_DIM + _CHAR_DIM), np.float32), model.embed(word, chars, n_chars)])
            mask = (place > 0).astype(np.float32)
            g = {d: (x @ model.p[f"{d}_in"] + model.p[f"{d}_bias"])[place] for d in "ud"}
            z, kept = model.logits(g, mask, keep=True)
            top = np.zeros(len(z), bool)
            by = np.lexsort((-z, doc))
            top[by[np.r_[True, np.diff(doc[by]) != 0]]] = True
            y = np.array([y for _, y in part])[doc]
            weight = np.where(top, 1, (y == 0) / np.bincount(doc)[doc])
            dz = ((1 / (1 + np.exp(-z)) - y) * weight / len(part)).astype(np.float32)
            grad = model.gradients(place, x, mask, dz, kept)
            dx = grad.pop("x")[1:]
            grad["word"] = _scatter(word, dx[:, :_WORD_DIM], len(model.p["word"]))
            grad["word"][0] = 0
            grad["char"] = _scatter(chars, np.repeat(dx[:, _WORD_DIM:] / n_chars[:, None], n_chars, 0), _CHAR_BUCKETS)
            step += 1
            for k, value in grad.items():
                m[k] += 0.1 * (value - m[k])
                v[k] += 0.001 * (value * value - v[k])
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = (CLEAN_ROWS, TOXIC_ROWS)) -> tuple[list[str], list[int]]:
    """Labelled texts that are not held out, at most so many clean and toxic ones, brought to the driver."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # a third more than wanted: some texts may be missing or too long
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n + n // 3) for y, n in enumerate(rows)]
    chosen = F.broadcast(picked[0].union(picked[1]))
    found = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.char_length("text") <= FIT_CHARS)
    got = sorted({(r["doc_id"], r["text"], r["toxic"]) for r in found.collect()})
    both = sorted(r for y, n in enumerate(rows) for r in [r for r in got if r[2] == y][:n])
    return [t for _, t, _ in both], [y for _, _, y in both]


def fit(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = (CLEAN_ROWS, TOXIC_ROWS)) -> Model | None:
    return train(*training_rows(docs, labels, rows))


_models: dict[str, Model] = {}


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of its texts in column ``out``; 0 without a model."""
    name, sent = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast((model.p, model.vocabulary) if model else None)

    def compute(texts):
        if sent.value is None:
            return [np.zeros(len(texts))]
        if name not in _models:
            _models.clear()
            _models[name] = Model(*sent.value)
        return [_models[name].scores(texts)]

    return with_columns(df, text, [pa.field(out, pa.float64())], compute, SLICE_BYTES)
