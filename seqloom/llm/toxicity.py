"""Toxicity by a recurrent network (operator 9), written and trained in numpy.

A word's input is the embedding of the word plus the mean of those of its character n-grams, both in hashed tables; the
word is lower-cased and trimmed of punctuation. A gated recurrent network reads a window of words in both directions,
attention pools its states, and a logistic unit gives the window's score. Windows overlap by a fourth at least and cover
the whole text; a text's score is its highest window's.

Training knows the text's label only: of each text, the window that scores highest now gets the label. It takes a bounded
sample of labelled rows, the shorter texts of which say more about where the reason is.

Defined results: a null text scores as an empty one, which is one window of no word; without rows of both labels the score
is their share of label 1, or 0.5 without any; repeated rows get equal scores; an empty table gives an empty table. Only
the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .sampling import held_out, labelled

#: Labelled rows that a fit takes at most, those of label 1 among them, and the longest text it takes, in characters.
MAX_ROWS, MAX_POSITIVE, MAX_CHARS = 4500, 1500, 4000
WINDOW, STRIDE = 48, 36
DIM, HIDDEN = 16, 12
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 15
GRAMS = (3, 4, 5)
TRIM = ".,;:!?\"'()[]{}<>|*#$%&~`+=_/\\-"
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[str]:
    return [w.strip(TRIM) for w in (text or "").lower().split()]


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of all n-grams of the words, each with its bounds, and the number of n-grams of each word (3 to 5
    characters, and at least one)."""
    marked = [f"<{w}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(length)
    end_of = np.repeat(ends, length)
    owner = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(chars))
    rows, owners = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        h = np.zeros(len(chars) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ chars[k : len(chars) - n + 1 + k]) * _PRIMES[k]
            h ^= h >> np.uint64(31)
        inside = place[: len(h)] + n <= end_of[: len(h)]
        rows.append((h[inside] % np.uint64(GRAM_ROWS)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    short = np.flatnonzero(length < min(GRAMS))
    rows.append(np.zeros(len(short), np.int64))
    owners.append(short)
    all_rows, all_owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    return all_rows[order], np.bincount(all_owners, minlength=len(words))


def word_rows(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS for w in words), np.int64, len(words))


def window_starts(n: int) -> range:
    """Starts of windows that cover n words; one for no word."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Both directions are one batch of two: weights have a leading axis of 2."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": make(WORD_ROWS, DIM, scale=0.03), "gram": make(GRAM_ROWS, DIM, scale=0.03),
            "wx": make(2, DIM, 3 * HIDDEN, scale=DIM**-0.5), "wh": make(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "wa": make(2 * HIDDEN, HIDDEN, scale=(2 * HIDDEN) ** -0.5), "va": make(HIDDEN, scale=0.5), "wo": make(2 * HIDDEN, scale=0.3), "bo": np.full(1, -1.0, np.float32),
        }

    def embed(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        rows, counts = gram_rows(words)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        at = word_rows(words)
        x = self.p["word"][at] + np.add.reduceat(self.p["gram"][rows], starts, axis=0) / counts[:, None].astype(np.float32)
        return x, (rows, counts, at)

    def project(self, x: np.ndarray) -> np.ndarray:
        """The words' part of the gates, for both directions: words, 2, 3 * HIDDEN."""
        return np.einsum("nd,kdh->nkh", x, self.p["wx"]) + self.p["b"][:, 0]

    def forward(self, table: np.ndarray, index: np.ndarray, length: np.ndarray, keep: bool = False):
        """Scores (before the logistic) of windows: index (windows, WINDOW) into the projected words, length of each."""
        n, t = index.shape
        wh, h = self.p["wh"], np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((t, 2, n, HIDDEN), np.float32)
        kept = []
        for i in range(t):
            j = (i, t - 1 - i)
            g = np.stack([table[index[:, j[0]], 0], table[index[:, j[1]], 1]])
            on = np.stack([j[0] < length, j[1] < length])[:, :, None]
            u = h @ wh
            zr = sigmoid(g[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(g[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
            new = np.where(on, h + z * (c - h), h)
            if keep:
                kept.append((h, z, r, c, u[..., 2 * HIDDEN :], on))
            h = new
            states[j[0], 0], states[j[1], 1] = h[0], h[1]
        s = states.transpose(2, 0, 1, 3).reshape(n, t, 2 * HIDDEN)
        a = np.tanh(s @ self.p["wa"])
        e = a @ self.p["va"]
        e = np.where(np.arange(t) < np.maximum(length, 1)[:, None], e, -1e9)
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = (w[..., None] * s).sum(axis=1)
        out = pooled @ self.p["wo"] + self.p["bo"]
        return (out, (kept, s, a, w, pooled)) if keep else out

    def backward(self, index: np.ndarray, cache: tuple, d_out: np.ndarray, words: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights, and of the projected words."""
        kept, s, a, w, pooled = cache
        n, t = index.shape
        g = {"wo": pooled.T @ d_out, "bo": d_out.sum(keepdims=True)}
        d_pooled = d_out[:, None] * self.p["wo"]
        d_w = (s * d_pooled[:, None]).sum(axis=2)
        d_e = w * (d_w - (w * d_w).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("nt,nth->h", d_e, a)
        d_a = d_e[..., None] * self.p["va"] * (1 - a * a)
        g["wa"] = np.einsum("nts,nth->sh", s, d_a)
        d_s = w[..., None] * d_pooled[:, None] + d_a @ self.p["wa"].T
        d_states = d_s.reshape(n, t, 2, HIDDEN).transpose(1, 2, 0, 3)
        g["wh"] = np.zeros_like(self.p["wh"])
        d_table = np.zeros((words, 2, 3 * HIDDEN), np.float32)
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        for i in reversed(range(t)):
            j = (i, t - 1 - i)
            h, z, r, c, uc, on = kept[i]
            d = d_h + np.stack([d_states[j[0], 0], d_states[j[1], 1]])
            live = np.where(on, d, 0)
            d_c = live * z * (1 - c * c)
            d_z = live * (c - h) * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_c], axis=2)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=2)
            for k in (0, 1):
                np.add.at(d_table[:, k], index[:, j[k]], d_g[k])
            g["wh"] += h.transpose(0, 2, 1) @ d_u
            d_h = np.where(on, d - live * z, d) + d_u @ self.p["wh"].transpose(0, 2, 1)
        return g, d_table


def evidence(rows_of: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """How far each table row's share of texts differs between the labels, in standard errors of its log odds."""
    n = [np.full(size, 0.5), np.full(size, 0.5)]
    for rows, y in zip(rows_of, labels, strict=True):
        n[int(y)][np.unique(rows)] += 1
    of = [np.log(n[k] / ((labels == k).sum() + 1)) for k in (0, 1)]
    return np.clip((of[1] - of[0]) / np.sqrt(1 / n[0] + 1 / n[1]), -6, 6)


class Trainer:
    """Adam, by rows for the embeddings."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def update(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None), slower: float = 1.0) -> None:
        m, v = self.m[name], self.v[name]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        fix = slower * self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        self.net.p[name][rows] -= fix * m[rows] / (np.sqrt(v[rows]) + 1e-8)

    def step(self, x: np.ndarray, parts: tuple, index: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        net = self.net
        self.t += 1
        out, cache = net.forward(net.project(x), index, length, keep=True)
        p = sigmoid(out)
        grads, d_table = net.backward(index, cache, (weight * (p - y) / weight.sum()).astype(np.float32), len(x))
        grads["wx"] = np.einsum("nd,nkh->kdh", x, d_table)
        grads["b"] = d_table.sum(axis=0)[:, None]
        d_x = np.einsum("nkh,kdh->nd", d_table, net.p["wx"])
        used, counts, at = parts
        for name, rows, d in (("word", at, d_x), ("gram", used, np.repeat(d_x / counts[:, None].astype(np.float32), counts, axis=0))):
            distinct, inverse = np.unique(rows, return_inverse=True)
            grad = np.zeros((len(distinct), DIM), np.float32)
            np.add.at(grad, inverse, d)
            self.update(name, grad, distinct, 0.25)
        for name, grad in grads.items():
            self.update(name, grad.astype(np.float32))
        return float(-(weight * np.log(np.where(y > 0, p, 1 - p) + 1e-9)).sum() / weight.sum())


def windows_of(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """index, length and text of each window."""
    index, length, owner = [], [], []
    for k, ids in enumerate(texts):
        for start in window_starts(len(ids)):
            part = ids[start : start + WINDOW]
            index.append(part + [0] * (WINDOW - len(part)))
            length.append(len(part))
            owner.append(k)
    return np.array(index, np.int64).reshape(-1, WINDOW), np.array(length), np.array(owner)


class Model:
    """A network, or a constant where there was nothing to learn."""

    def __init__(self, net: Network | None, constant: float = 0.5):
        self.net, self.constant = net, constant
        self.known: dict[str, int] = {"": 0}
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return {"net": self.net, "constant": self.constant}

    def __setstate__(self, state):
        self.__init__(state["net"], state["constant"])

    def scores(self, texts: list[str | None], keep: int = 150_000) -> np.ndarray:
        """The highest window's score of each text. Projected words are kept from call to call, up to `keep`."""
        if self.net is None:
            return np.full(len(texts), self.constant)
        if self.table is None or len(self.known) > keep:
            self.known = {"": 0}
            self.table = self.net.project(self.net.embed([""])[0])
        known, held = self.known, len(self.known)
        ids = [[known.setdefault(w, len(known)) for w in words_of(t)] for t in texts]
        if len(known) > held:
            new = list(known)[held:]
            self.table = np.concatenate([self.table, *(self.net.project(self.net.embed(new[i : i + 20_000])[0]) for i in range(0, len(new), 20_000))])
        index, length, owner = windows_of(ids)
        out = np.concatenate([self.net.forward(self.table, index[i : i + 1024], length[i : i + 1024]) for i in range(0, len(index), 1024)])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, out)
        return sigmoid(best).astype(float)


def train(texts: list[str], labels: np.ndarray, steps: int = 280, batch: int = 96, rate: float = 0.02, seed: int = 3, counts_first: bool = True) -> Model:
    """Takes about so many steps, at least five epochs; a small sample has smaller batches and more epochs. counts_first: the
    embeddings begin with what counts of words and n-grams say; without, they begin at random."""
    if not len(labels) or labels.min() == labels.max():
        return Model(None, float(labels.mean()) if len(labels) else 0.5)
    net, rng = Network(seed), np.random.default_rng(seed)
    trainer = Trainer(net, rate)
    vocabulary: dict[str, int] = {"": 0}
    ids = [[vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)] for t in texts]
    words = list(vocabulary)
    index, length, owner = windows_of(ids)
    first = np.searchsorted(owner, np.arange(len(ids) + 1))
    batch = min(batch, max(16, len(texts) // 16))
    epochs = max(5, -(-steps * batch // len(texts)))
    if counts_first:
        # the embeddings' first two columns start as what word and n-gram counts say about the label
        used, counts = gram_rows(words)
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = word_rows(words)
        net.p["word"][:, 0] = evidence([at[t] for t in ids], labels, WORD_ROWS) / 3
        net.p["gram"][:, 1] = evidence([np.concatenate([used[ends[w] : ends[w + 1]] for w in set(t)] or [used[:0]]) for t in ids], labels, GRAM_ROWS) / 3
    weight = np.where(labels > 0, np.sqrt((len(labels) - labels.sum()) / labels.sum()), 1.0)
    for epoch in range(epochs):
        trainer.rate = rate * (1 - epoch / epochs) + 0.002
        if epoch:
            table = np.concatenate([net.project(net.embed(words[i : i + 20_000])[0]) for i in range(0, len(words), 20_000)])
            out = np.concatenate([net.forward(table, index[i : i + 1024], length[i : i + 1024]) for i in range(0, len(index), 1024)])
        else:
            out = rng.standard_normal(len(index))
        top = np.array([first[k] + np.argmax(out[first[k] : first[k + 1]]) for k in range(len(ids))])
        if not epoch:  # where the reason is isn't known yet: every window of a short text gets its label
            top = np.flatnonzero((first[owner + 1] - first[owner]) <= 3)
        order = rng.permutation(len(top))
        for i in range(0, len(top), batch):
            rows = top[order[i : i + batch]]
            used, local = np.unique(index[rows], return_inverse=True)
            x, parts = net.embed([words[u] for u in used])
            y = labels[owner[rows]].astype(float)
            trainer.step(x, parts, local.reshape(len(rows), WINDOW), length[rows], y, weight[owner[rows]])
    return Model(net)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_positive: int = MAX_POSITIVE, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """Learns from max_rows rows at most, of max_chars characters at most: 18 million characters at most come to the driver."""
    short = docs.where(F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) <= max_chars)
    rows = labelled(short.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")), labels, "toxic", max_rows, max_positive, id_col)
    got = sorted((r["_id"], r["_text"], r["_label"]) for r in rows.collect())
    return train([t for _, t, _ in got], np.array([y for _, _, y in got], float), **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id_col, held_out, score and predicted of each row. The model, of fixed size, is broadcast; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        out: list[float] = []
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > 1_000_000 or i + 1 == len(texts):
                out += shared.value.scores(texts[start : i + 1]).tolist()
                start, size = i + 1, 0
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")), scored, f"_id {kind}, score double")
    return rows.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
