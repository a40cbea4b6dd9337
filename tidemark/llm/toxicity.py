"""Toxicity by a factorization machine over hashed terms.

A text's features are the hashes of its words and of the first four, five and
six bytes of longer words, present or absent.  The machine

    y = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i)

learns a weight for each feature and, through the factors, one for each pair, so
that two terms which are harmless alone may weigh together.  It is fitted by
AdaGrad on a bounded sample of labelled rows (``positives`` and ``negatives``
rows at most, chosen by a hash of their ids), on the ``features`` features that
tell the labels apart best there.  Scoring reads whole texts.

Edge cases: null and empty texts have no features and score sigmoid(w0); labels
that are null or repeated are dropped but one; a null doc_id is a training row
without a label; without labelled rows of both kinds every score is 0; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small, spill

BITS = 20
_SHIFT = np.uint64(64 - BITS)
PREFIXES = (4, 5, 6)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of all words of a slice and of their beginnings."""
    owner, size = s.owner(), s.ends - s.starts
    found, texts = [s.hashes() >> _SHIFT], [owner]
    for n in PREFIXES:
        long = size > n
        part = s._replace(starts=s.starts[long], ends=s.starts[long] + n)
        found.append((tk.mix(part.hashes() ^ np.uint64(n)) >> _SHIFT))
        texts.append(owner[long])
    return np.concatenate(found).astype(np.int64), np.concatenate(texts)


class Machine:
    """Weights and factors of the chosen features; ``place`` maps a hashed feature to its column or -1."""

    def __init__(self, chosen: np.ndarray, factors: int, rng: np.random.Generator) -> None:
        self.place = np.full(1 << BITS, -1, dtype=np.int32)
        self.place[chosen] = np.arange(len(chosen))
        self.w0 = 0.0
        self.w = np.zeros(len(chosen))
        self.v = rng.normal(0, 0.05, (len(chosen), factors))

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x @ self.v
        return self.w0 + x @ self.w + 0.5 * ((s**2) - x @ (self.v**2)).sum(1), s

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4) -> None:
        seen = [1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)]
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
                part = x[at].astype(np.float64)
                raw, s = self.raw(part)
                g = (1 / (1 + np.exp(-raw)) - y[at]) / len(at)
                gv = part.T @ (g[:, None] * s) - (part.T @ g)[:, None] * self.v + decay * self.v
                gw, g0 = part.T @ g + decay * self.w, g.sum()
                seen[0] += g0**2
                seen[1] += gw**2
                seen[2] += gv**2
                self.w0 -= rate * g0 / seen[0] ** 0.5
                self.w -= rate * gw / seen[1] ** 0.5
                self.v -= rate * gv / seen[2] ** 0.5

    def score(self, feature: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        column = self.place[feature]
        some = column >= 0
        pairs = np.unique(text[some] * np.int64(len(self.w)) + column[some])
        row, col = pairs // len(self.w), pairs % len(self.w)
        raw = np.bincount(row, weights=self.w[col], minlength=texts) + self.w0
        for f in range(self.v.shape[1]):
            v = self.v[col, f]
            raw += 0.5 * (np.bincount(row, weights=v, minlength=texts) ** 2 - np.bincount(row, weights=v**2, minlength=texts))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def _choose(y: np.ndarray, text: np.ndarray, feature: np.ndarray, features: int) -> np.ndarray:
    """The features with the largest chi-square statistic against the label."""
    with_ = np.bincount(feature, minlength=1 << BITS).astype(float)
    toxic = np.bincount(feature, weights=y[text], minlength=1 << BITS)
    n, pos = len(y), y.sum()
    gap = toxic * (n - with_ - (pos - toxic)) - (with_ - toxic) * (pos - toxic)
    below = with_ * (n - with_) * pos * (n - pos)
    chi = np.where((below > 0) & (with_ >= 3), n * gap**2 / np.maximum(below, 1), 0)
    best = np.argsort(-chi, kind="stable")[:features]
    return best[chi[best] > 0]


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, negatives: int = 6000, features: int = 1024, factors: int = 8, seed: int = 5) -> Machine | None:
    """Fits the machine on at most ``positives`` and ``negatives`` labelled training rows."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").dropDuplicates(["doc_id"]).where(~held_out(F.col("doc_id")))
    first = F.xxhash64("doc_id", F.lit(seed))
    picked = known.where("toxic = 1").orderBy(first, "doc_id").limit(positives).union(known.where("toxic = 0").orderBy(first, "doc_id").limit(negatives))
    picked = spill(picked.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")), "picked")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(batch.schema.get_field_index("toxic"))
            for s in tk.slices(tk.column(batch, "text")):
                feature, text = _features(s)
                pairs = np.unique(text << BITS | feature)
                edge = np.searchsorted(pairs >> BITS, np.arange(s.texts + 1))
                own = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                lists = [own[edge[i] : edge[i + 1]] for i in range(s.texts)]
                yield pa.RecordBatch.from_arrays(
                    [toxic.slice(s.first, s.texts), pa.array(lists, type=pa.list_(pa.int32()))], names=["toxic", "f"]
                )

    # a doc_id that many rows share counts with one of them
    docs = docs.select("doc_id", "text")
    rows = docs.join(small(picked), docs["doc_id"] == picked["id"]).groupBy("id", "toxic").agg(F.min("text").alias("text"))
    found = rows.select("toxic", "text").mapInArrow(extract, "toxic int, f array<int>").toArrow().combine_chunks()
    y = found["toxic"].to_numpy().astype(float)
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    lists = found["f"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    feature, text = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(y)), size)
    # rows arrive in any order; the fit takes them in one
    rng = np.random.default_rng(seed)
    m = Machine(_choose(y, text, feature, features), factors, rng)
    column = m.place[feature]
    x = np.zeros((len(y), len(m.w)), dtype=np.uint8)
    x[text[column >= 0], column[column >= 0]] = 1
    order = np.lexsort((*x[:, :16].T, x.sum(1), y))
    m.fit(x[order], y[order], rng)
    return m


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, out = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out"))
            for s in tk.slices(tk.column(batch, "text")):
                p = m.score(*_features(s), s.texts) if m else np.zeros(s.texts)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.first, s.texts), out.slice(s.first, s.texts), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
