"""Vectorised word and shingle kernels over Arrow string columns.

Every function works on a *slice*: the bytes of a few whole texts laid end to
end, never on a prefix of a text.  Slices are bounded by ``SLICE_BYTES`` (or by
one text, where that is longer), so the temporaries stay small however many
rows a batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD1B54A32D192ED03)

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space (0x20, 0x09-0x0D) divides.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words made of ASCII digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the usual slice length."""
    have = _POWERS.get("up")
    if have is not None and len(have) >= n:
        return _POWERS["up"], _POWERS["down"]

    def run(base: np.uint64) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    up, down = run(_BASE), run(_BASE_INV)
    if n <= 4 * SLICE_BYTES:
        _POWERS.update(up=up, down=down)
    return up, down


class Slice(NamedTuple):
    """Words of the texts ``first`` to ``first + len(bounds) - 1`` of a column.

    ``bounds[i]:bounds[i + 1]`` are the words of the i-th text; ``starts`` and
    ``ends`` are byte offsets into ``data``; ``text_at`` holds each text's first
    byte there.
    """

    first: int
    data: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def owner(self) -> np.ndarray:
        """The text, counted within the slice, of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        up, down = _powers(len(self.data))
        total = np.cumsum(_BYTE[self.data] * up[: len(self.data)], dtype=np.uint64)
        before = np.where(self.starts > 0, total[self.starts - 1], _U(0))
        return mix((total[self.ends - 1] - before) * down[self.starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty texts and 64-bit offsets."""
    x = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(x.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string array, and its offsets into them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(texts: pa.Array, word_bytes: np.ndarray = SPACED, lower: bool = True, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a column into slices of whole texts and finds their words."""
    data, at = raw(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        part = data[at[first] : at[last]]
        if lower:
            part = LOWER[part]
        text_at = at[first : last + 1] - at[first]
        inside = word_bytes[part]
        opens, closes = inside.copy(), inside.copy()
        if len(part):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edge = text_at[:-1][np.diff(text_at) > 0]
            opens[edge] = inside[edge]
            edge = edge[edge > 0]
            closes[edge - 1] = inside[edge - 1]
        starts = np.flatnonzero(opens)
        yield Slice(first, part, text_at, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, text_at))
        first = last


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, whichever texts they belong to."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    end = len(words) - n + 1
    h = words[:end].copy()
    for k in range(1, n):
        h = h * _STEP + words[k : k + end]
    return mix(h + _U(n))


def shingle_sets(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct ``n``-word shingles, sorted, and the bounds of the texts in them.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    words, count = s.hashes(), np.diff(s.bounds)
    full = grams(words, n)
    owner = s.owner()
    if len(full):
        whole = owner[: len(full)] == owner[n - 1 :]
        value, text = full[whole], owner[: len(full)][whole]
    else:
        value, text = full, owner[:0]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([grams(words[s.bounds[i] : s.bounds[i + 1]], int(count[i]))[0] for i in short], dtype=np.uint64)
        value, text = np.concatenate([value, extra]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    if len(value):
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(s.texts + 1))
