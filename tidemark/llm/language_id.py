"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in windows of ``WINDOW`` positions, from both
ends; at every position the two hidden states together give a distribution over
the languages.  A document's probabilities are the mean of those of its letter
positions, over the whole text.  Training is backpropagation through time in
numpy, on windows of a bounded sample of rows (``rows`` for each language,
chosen by a hash of their ids).

Edge cases: a null text, or one without a letter, is ``und`` with score 0; a
null doc_id is a training row; rows that share a doc_id are read each on its
own; without a labelled row everything is ``und``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small, spill
from .toxicity import held_out

WINDOW = 128
_LETTER = np.zeros(256, dtype=np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Gru:
    """One direction: update gate z, reset gate r, candidate n; the input is a byte's row of ``x``."""

    def __init__(self, hidden: int, rng: np.random.Generator) -> None:
        self.x = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / hidden**0.5, (hidden, 2 * hidden)).astype(np.float32)
        self.c = rng.normal(0, 1 / hidden**0.5, (hidden, hidden)).astype(np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c]

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        k = h.shape[1]
        x = self.x[byte]
        gates = _sigmoid(x[:, : 2 * k] + h @ self.u)
        z, r = gates[:, :k], gates[:, k:]
        n = np.tanh(x[:, 2 * k :] + (r * h) @ self.c)
        return n + z * (h - n), (byte, h, z, r, n)

    def back(self, kept: tuple, dh: np.ndarray, grads: list[np.ndarray]) -> np.ndarray:
        """Adds the step's gradients and returns that of the state before it."""
        byte, h, z, r, n = kept
        dn = dh * (1 - z) * (1 - n**2)
        drh = dn @ self.c.T
        dz = dh * (h - n) * z * (1 - z)
        dr = drh * h * r * (1 - r)
        gates = np.concatenate([dz, dr], axis=1)
        np.add.at(grads[0], byte, np.concatenate([gates, dn], axis=1))
        grads[1] += h.T @ gates
        grads[2] += (r * h).T @ dn
        return dh * z + drh * r + gates @ self.u.T


class Network:
    def __init__(self, langs: list[str], hidden: int, rng: np.random.Generator) -> None:
        self.langs = langs
        self.ahead, self.behind = Gru(hidden, rng), Gru(hidden, rng)
        self.out = rng.normal(0, 0.1, (2 * hidden, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.ahead.params(), *self.behind.params(), self.out, self.bias]

    def label(self, windows: np.ndarray) -> np.ndarray:
        """For (time, window) bytes: each window's sum of the distributions at its letter positions."""
        steps, n = windows.shape
        k = len(self.out) // 2
        seen = np.empty((steps, n, len(self.langs)), dtype=np.float32)
        h = np.zeros((n, k), dtype=np.float32)
        for t in range(steps):
            h, _ = self.ahead.step(windows[t], h)
            seen[t] = h @ self.out[:k]
        total = np.zeros((n, len(self.langs)), dtype=np.float32)
        h[:] = 0
        for t in range(steps - 1, -1, -1):
            h, _ = self.behind.step(windows[t], h)
            p = np.exp(seen[t] + h @ self.out[k:] + self.bias)
            total += p * (_LETTER[windows[t]] / p.sum(1))[:, None]
        return total

    def fit_batch(self, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over the letter positions of some windows."""
        steps, n = windows.shape
        k = len(self.out) // 2
        kept: list[list] = [[], []]
        states = np.zeros((2, steps, n, k), dtype=np.float32)
        for d, (gru, order) in enumerate(((self.ahead, range(steps)), (self.behind, range(steps - 1, -1, -1)))):
            h = np.zeros((n, k), dtype=np.float32)
            for t in order:
                h, saved = gru.step(windows[t], h)
                states[d, t] = h
                kept[d].append(saved)
        both = np.concatenate([states[0], states[1]], axis=2)
        raw = both @ self.out + self.bias
        p = np.exp(raw - raw.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(n), y] -= 1
        weight = _LETTER[windows]
        d_raw = p * (weight / max(1.0, float(weight.sum())))[:, :, None]
        d_out = np.einsum("tnh,tnl->hl", both, d_raw)
        d_states = d_raw @ self.out.T
        grads = [np.zeros_like(x) for x in self.params()]
        for d, (gru, order) in enumerate(((self.ahead, range(steps - 1, -1, -1)), (self.behind, range(steps)))):
            dh = np.zeros((n, k), dtype=np.float32)
            own = grads[3 * d : 3 * d + 3]
            for t in order:
                dh = gru.back(kept[d].pop(), dh + d_states[t, :, d * k : (d + 1) * k], own)
        grads[-2], grads[-1] = d_out, d_raw.sum((0, 1))
        return grads


def _windows(part: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (window, time), the last window of a text filled up with zeros, and each window's text."""
    size = np.diff(text_at)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    out = np.zeros((int(count.sum()), WINDOW), dtype=np.uint8)
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(part)) - text_at[text]
    out[first[text] + place // WINDOW, place % WINDOW] = part
    return out, owner


def train(docs: DataFrame, rows: int = 400, per_row: int = 3, hidden: int = 8, updates: int = 600, seed: int = 6) -> Network | None:
    """Fits the network on ``per_row`` windows of at most ``rows`` training rows of each language."""
    docs = docs.select("doc_id", "text", "lang")
    known = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    langs = sorted(r[0] for r in known.groupBy("lang").agg(F.count("*")).select("lang").collect())
    if not langs:
        return None
    parts = None
    for lang in langs:
        one = known.where(F.col("lang") == lang).select(F.xxhash64("doc_id", F.lit(seed)).alias("k"), "doc_id", "lang")
        one = one.orderBy("k", "doc_id").limit(rows)
        parts = one if parts is None else parts.union(one)
    picked = spill(parts.select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct(), "picked")
    sample = docs.join(small(picked), (docs["doc_id"] == picked["id"]) & (docs["lang"] == picked["l"]))
    # a fixed number of windows of each, spread over the text: the fit needs no more, predictions read all of it
    sample = sample.groupBy("id", "l").agg(F.min("text").alias("text"))
    step = F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) / max(1, per_row)
    cuts = [F.substring(F.encode("text", "utf-8"), F.floor(step * k).cast("int") + 1, F.lit(WINDOW)) for k in range(per_row)]
    found = sample.orderBy("id", "l").select("l", F.explode(F.array(*cuts)).alias("w")).toArrow()
    y = np.array([langs.index(x) for x in found["l"].to_pylist()])
    x = np.zeros((len(y), WINDOW), dtype=np.uint8)
    for i, w in enumerate(found["w"].to_pylist()):
        x[i, : len(w)] = np.frombuffer(w, dtype=np.uint8)
    rng = np.random.default_rng(seed)
    order = np.lexsort((*x[:, :16].T, y))
    x, y = x[order], y[order]
    net = Network(langs, hidden, rng)
    first, second = ([np.zeros_like(p) for p in net.params()] for _ in range(2))
    n, queue = 0, []
    while n < updates:
        queue = queue or np.array_split(rng.permutation(len(y)), max(1, len(y) // 64))
        at = queue.pop()
        n += 1
        rate = 0.02 * (1 - n / (updates + 1)) * (1 - 0.999**n) ** 0.5 / (1 - 0.9**n)
        for p, g, a, b in zip(net.params(), net.fit_batch(np.ascontiguousarray(x[at].T), y[at]), first, second, strict=True):
            np.clip(g, -1, 1, out=g)
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def predict(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``; the score is the language's share."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            ids, out, letters = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out", "letters"))
            letters = letters.to_numpy(zero_copy_only=False)
            for s in tk.slices(tk.column(batch, "text"), lower=False, limit=1 << 19):
                names, score = np.full(s.texts, "und", dtype=object), np.zeros(s.texts)
                ok = letters[s.first : s.first + s.texts]
                if net is not None and ok.any():
                    windows, owner = _windows(s.data, s.text_at)
                    total = np.zeros((s.texts, len(net.langs)))
                    for i in range(0, len(windows), 4096):
                        part = net.label(np.ascontiguousarray(windows[i : i + 4096].T))
                        for k in range(len(net.langs)):
                            total[:, k] += np.bincount(owner[i : i + 4096], weights=part[:, k], minlength=s.texts)
                    best = total.argmax(1)
                    share = total[np.arange(s.texts), best] / np.maximum(total.sum(1), 1e-9)
                    names[ok] = np.array(net.langs, dtype=object)[best[ok]]
                    score[ok] = np.clip(share[ok], 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.first, s.texts), out.slice(s.first, s.texts), pa.array(names.tolist(), type=pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), letters, "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
