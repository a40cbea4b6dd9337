"""A hidden Markov language model.

Tokens are lower-cased (A-Z) words and one end to each text.  A token belongs to
a class: the most frequent words, and the end, are classes of their own, all
other words share hashed classes.  Latent states emit classes, and a class emits
its words by smoothed counts:

    P(word | state) = B[state, class] * (c + 0.5) / Z[class].

Baum-Welch trains the states.  Each task runs the scaled forward and backward
recursions over its own whole texts and adds up expected counts; Spark sums these by parameter, so that the
driver gets a table of a fixed size however large the corpus is.  Scores use the
scaled forward recursion over each whole text, which is exact.

Word counts cover the training corpus.  The ``top`` most frequent words are
broadcast (a fixed bound); words beyond are counted for each text by a join.

Edge cases: null and empty texts are one end token; a null doc_id is a training
row; rows that share a doc_id are scored each on its own; extra columns are
ignored; without training rows every count is 0 and the states stay as they
began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import spill

#: The hash that stands for the end of a text; no word is made of these bytes.
END = np.int64(-0x61C8864680B583EB)
OWN, SHARED = 3072, 1023
CLASSES = OWN + SHARED + 1
TOP = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _count(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word, by its hash, stands in the training texts, the ends included."""

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, at = np.unique(h, return_inverse=True)
        return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            texts = tk.column(batch, "text")
            parts.append((np.array([END]), np.array([len(texts)])))
            for s in tk.slices(texts):
                u, c = np.unique(s.hashes().view(np.int64), return_counts=True)
                parts.append((u, c))
                held += len(u)
                if held > 1 << 21:
                    u, c = merge(parts)
                    parts, held = [(u, c)], 0
                    if len(u) > 1 << 21:
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["h", "c"])
                        parts = []
        if parts:
            u, c = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["h", "c"])

    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _bar(counts: DataFrame, top: int) -> int:
    """The least count that at most ``top`` words reach."""
    total, bar = 0, 1 << 62
    # there are at most sqrt(2 N) different counts
    for c, n in sorted(counts.groupBy("c").agg(F.count("*").alias("n")).collect(), reverse=True):
        total += n
        if total > top:
            break
        bar = c
    return bar


class Vocabulary:
    """The most frequent words: sorted hashes, counts, classes."""

    def __init__(self, h: np.ndarray, c: np.ndarray) -> None:
        rank = np.lexsort((h, -c))
        rank = rank[h[rank] != END]
        kind = np.full(len(h), -1, dtype=np.int16)
        kind[rank[:OWN]] = np.arange(min(OWN, len(rank)))
        order = np.argsort(h)
        self.h, self.c, self.kind = h[order], c[order], kind[order]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table or -1, class) of each hash."""
        if not len(self.h):
            return np.full(len(h), -1), np.where(h == END, CLASSES - 1, OWN + h % SHARED).astype(np.int16)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        at = np.where(self.h[at] == h, at, -1)
        own = np.where(at >= 0, self.kind[at], -1)
        return at, np.where(h == END, CLASSES - 1, np.where(own >= 0, own, OWN + h % SHARED)).astype(np.int16)


_ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, rare array<long>, classes binary"


def _encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Class sequences, the sum of log10(c + 0.5) over the words of the table, and the hashes of all other words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        rid = TaskContext.get().partitionId() << 33
        logs = np.log10(v.c + 0.5)
        at_end, _ = v.look(np.array([END]))
        end = (logs[at_end[0]], 1) if at_end[0] >= 0 else (np.log10(0.5), 0)
        last = np.array([CLASSES - 1], dtype=np.int16)
        for batch in batches:
            ids, out = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("held_out"))
            for s in tk.slices(tk.column(batch, "text")):
                h = s.hashes().view(np.int64)
                at, kind = v.look(h)
                owner = s.owner()
                some = at >= 0
                known = np.bincount(owner[some], minlength=s.texts)
                total = np.bincount(owner[some], weights=logs[at[some]], minlength=s.texts)
                far = h[~some]
                edge = np.searchsorted(owner[~some], np.arange(s.texts + 1))
                b = s.bounds
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + np.arange(s.texts)),
                        ids.slice(s.first, s.texts),
                        out.slice(s.first, s.texts),
                        pa.array(np.diff(b) + 1),
                        pa.array(known + end[1]),
                        pa.array(total + end[0]),
                        pa.array([far[edge[i] : edge[i + 1]] for i in range(s.texts)], type=pa.list_(pa.int64())),
                        pa.array([np.concatenate([kind[b[i] : b[i + 1]], last]).tobytes() for i in range(s.texts)], type=pa.binary()),
                    ],
                    names=["rid", "doc_id", "held_out", "n_tokens", "known", "logs", "rare", "classes"],
                )
                rid += s.texts

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(encode, _ENCODED)


class States:
    """Start, transition and emission probabilities."""

    def __init__(self, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.pi, self.a, self.b = pi, a, b

    @classmethod
    def begin(cls, unigram: np.ndarray, states: int, seed: int) -> States:
        rng = np.random.default_rng(seed)
        b = unigram * rng.uniform(0.5, 1.5, (states, len(unigram)))
        a = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(a, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), a, b / b.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, pi: np.ndarray, xi: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> States:
        """A little of the unigram keeps every class possible in every state."""
        b = emit + unigram + 1e-6
        a = xi + 0.1
        pi = pi + 0.1
        return cls(pi / pi.sum(), a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True))


def _packed(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes by time and then by sequence, the longest first; sequences at each time; the order taken)."""
    size = np.array([len(x) for x in seqs])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = np.concatenate([seqs[i] for i in order])
    start = np.cumsum(size) - size
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    row = np.repeat(np.arange(len(seqs)), size)
    time = np.arange(len(flat)) - start[row]
    begin = np.cumsum(active) - active
    out = np.empty_like(flat)
    out[begin[time] + row] = flat
    return out, active, order


def _borders(pieces: list[np.ndarray], last: np.ndarray, m: States) -> tuple[np.ndarray, np.ndarray]:
    """The distribution in which each piece of a sequence begins, and what follows it, up to a factor, at its end.

    ``last`` marks the pieces that end a sequence.  A piece takes the state before
    it to the state behind it by a matrix; these are multiplied for all pieces side
    by side, and then along each sequence.
    """
    k = len(m.pi)
    first = np.concatenate([[True], last[:-1]])
    enter, leave = np.tile(m.pi, (len(pieces), 1)), np.ones((len(pieces), k))
    cut = np.flatnonzero(~(first & last))
    if not len(cut):
        return enter, leave
    flat, active, order = _packed([pieces[i] for i in cut])
    bt = np.ascontiguousarray(m.b.T)
    across = np.tile(np.eye(k), (len(cut), 1, 1))
    at = 0
    for n in active:
        step = (across[:n] * bt[flat[at : at + n]][:, None, :]) @ m.a
        across[:n] = step / step.sum((1, 2))[:, None, None]
        at += n
    through = np.zeros((len(pieces), k, k))
    through[cut[order]] = across
    start, size = np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(pieces)))
    for i in range(1, int(size.max())):
        now = start[size > i] + i
        ahead = np.einsum("ni,nij->nj", enter[now - 1], through[now - 1])
        enter[now] = ahead / ahead.sum(1)[:, None]
    # what the rest of a sequence says to the state before it
    rest = np.ones((len(pieces), k))
    for i in range(int(size.max()) - 1, 0, -1):
        now = start[size > i] + i
        rest[now] = np.einsum("nij,nj->ni", through[now], np.where(last[now][:, None], 1.0, rest[(now + 1) % len(pieces)]))
        rest[now] /= rest[now].sum(1)[:, None]
        leave[now - 1] = rest[now] @ m.a.T
    return enter, leave


def expect(seqs: list[np.ndarray], m: States, segment: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions, and the log10 likelihood, of some whole sequences.

    Pieces of ``segment`` tokens are worked on side by side, each from what stands
    before and behind it; the counts are those of the whole sequences.
    """
    pieces = [x[i : i + segment] for x in seqs for i in range(0, len(x), segment)]
    last = np.zeros(len(pieces), dtype=bool)
    last[np.cumsum([-(-len(x) // segment) for x in seqs]) - 1] = True
    enter, leave = _borders(pieces, last, m)
    flat, active, order = _packed(pieces)
    enter, leave = enter[order], leave[order]
    begin = np.cumsum(active) - active
    bt = np.ascontiguousarray(m.b.T)
    e = bt[flat]
    alpha, scale = np.empty_like(e), np.empty(len(flat))
    for t, n in enumerate(active):
        at = slice(begin[t], begin[t] + n)
        now = ((now[:n] @ m.a) if t else enter) * e[at]
        c = now.sum(1)
        now = now / c[:, None]
        alpha[at], scale[at] = now, c
    size = np.array([len(x) for x in pieces])[order]
    final = alpha[begin[size - 1] + np.arange(len(size))]
    leave /= (final * leave).sum(1)[:, None]
    xi = np.zeros_like(m.a)
    gamma = np.empty_like(e)
    back = leave[: active[-1]]
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = slice(begin[t], begin[t] + n)
        if len(back) < n:
            back = np.concatenate([back, leave[len(back) : n]])
        gamma[at] = alpha[at] * back
        ahead = e[at] * back / scale[at][:, None]
        if t:
            xi += alpha[begin[t - 1] : begin[t - 1] + n].T @ ahead
            back = ahead @ m.a.T
    # from one piece to the next
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    cut = np.flatnonzero(~last)
    xi += final[place[cut]].T @ ahead[place[cut + 1]]
    first = place[np.concatenate([[True], last[:-1]])]
    emit = np.stack([np.bincount(flat, weights=gamma[:, k], minlength=m.b.shape[1]) for k in range(len(m.pi))])
    return gamma[first].sum(0), xi * m.a, emit, float(np.log10(scale).sum())


def likelihoods(seqs: list[np.ndarray], m: States) -> np.ndarray:
    """log10 likelihood of each whole sequence, by the scaled forward recursion."""
    flat, active, order = _packed(seqs)
    bt = np.ascontiguousarray(m.b.T)
    total = np.zeros(len(seqs))
    at, now = 0, None
    for t, n in enumerate(active):
        e = bt[flat[at : at + n]]
        now = (now[:n] @ m.a) * e if t else m.pi * e
        c = now.sum(1)
        now /= c[:, None]
        total[:n] += np.log10(c)
        at += n
    out = np.empty(len(seqs))
    out[order] = total
    return out


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.int16) for x in batch.column(batch.schema.get_field_index("classes")).to_pylist()]


def _round(encoded: DataFrame, m: States) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One Baum-Welch pass: the expected counts of all training sequences."""
    k, width = len(m.pi), m.b.shape[1]
    shared = encoded.sparkSession.sparkContext.broadcast(m)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros(k + k * k + k * width + 1)

        def add(part: list[np.ndarray]) -> None:
            pi, xi, emit, ll = expect(part, m)
            total[:] += np.concatenate([pi, xi.ravel(), emit.ravel(), [ll]])

        part, held = [], 0
        for batch in batches:
            for seq in _sequences(batch):
                part.append(seq)
                held += len(seq)
                if held >= 1 << 18:
                    add(part)
                    part, held = [], 0
        if part:
            add(part)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "v"])

    found = encoded.where("not held_out").select("classes").mapInArrow(collect, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(k + k * k + k * width + 1)
    out[found["slot"].to_numpy()] = found["v"].to_numpy()
    return out[:k], out[k : k + k * k].reshape(k, k), out[k + k * k : -1].reshape(k, width), float(out[-1])


def score(docs: DataFrame, states: int = 6, rounds: int = 5, seed: int = 3, top: int = TOP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    One row per row of ``docs``; scores are log10 probabilities of whole texts.
    """
    spark = docs.sparkSession
    counts = spill(_count(docs), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.where(F.col("c") >= _bar(counts, top)).toArrow()
    vocabulary = Vocabulary(head["h"].to_numpy(), head["c"].to_numpy())
    encoded = spill(_encode(docs, vocabulary), "encoded")

    # mass and words of each class, over the whole training corpus
    own = {int(h): int(k) for h, k in zip(vocabulary.h, vocabulary.kind, strict=True) if k >= 0}
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for h, k in own.items():
        mass[k] = vocabulary.c[np.searchsorted(vocabulary.h, h)]
    sums = counts.groupBy(F.pmod("h", F.lit(SHARED)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    for row in sums:
        mass[OWN + row["k"]], kinds[OWN + row["k"]] = row["c"], row["n"]
    for h, k in own.items():
        mass[OWN + h % SHARED] -= mass[k]
        kinds[OWN + h % SHARED] -= 1
    at_end, _ = vocabulary.look(np.array([END]))
    if at_end[0] >= 0:
        slot = OWN + int(END) % SHARED
        mass[slot] -= vocabulary.c[at_end[0]]
        kinds[slot] -= 1
        mass[CLASSES - 1] = vocabulary.c[at_end[0]]
    # a class of its own has one word; a shared one its known words and one place for the unknown
    log_z = np.log10(np.where(np.arange(CLASSES) < OWN, mass + 0.5, mass + 0.5 * (kinds + 1)))
    log_z[CLASSES - 1] = np.log10(mass[CLASSES - 1] + 0.5)

    unigram = (mass + 0.5) / (mass + 0.5).sum()
    m = States.begin(unigram, states, seed)
    for _ in range(rounds):
        pi, xi, emit, _ = _round(encoded, m)
        m = States.from_counts(pi, xi, emit, unigram)
    shared = spark.sparkContext.broadcast((m, log_z))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, log_z = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            seqs = _sequences(batch)
            size = np.array([len(x) for x in seqs])
            inside = np.add.reduceat(log_z[np.concatenate(seqs)], np.cumsum(size) - size)
            names = [c for c in batch.schema.names if c != "classes"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(likelihoods(seqs, m) - inside)], names=[*names, "path"]
            )

    rows = encoded.select("rid", "doc_id", "held_out", "n_tokens", "known", "logs", "classes")
    rows = rows.mapInArrow(forward, "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, path double")
    # words beyond the table: counted by a join, summed for each text
    rare = encoded.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("m"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts, "h", "left").groupBy("rid").agg(
        F.sum(F.col("m") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("found")
    )
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    floor = float(np.log10(total + 0.5 * (distinct + 1)))
    return rows.join(rare, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * floor).alias("base_score"),
        (logs + F.col("path")).alias("score"),
    )
