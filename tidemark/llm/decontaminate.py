"""Benchmark decontamination by a broadcast set of normalised word windows.

Texts and items are lower-cased (A-Z) and cut into words of ASCII digits,
letters and everything beyond ASCII.  A window is ``n`` consecutive words of an
item, or a whole item of fewer words.  The windows' hashes are broadcast, the
documents' rolling window hashes are looked up in them, and every hit is
verified word for word before it counts.

The broadcast is bounded: benchmark texts of more than ``block_bytes`` are cut
into blocks of items, and the documents are scanned once for each block, the
hits of the blocks being merged row by row without a shuffle.

Edge cases: a null or empty text has no words and no hits; an item without words
has no window; items that share an id are one item; a null item_id marks words
as hit but is not listed; rows of equal ids are scanned each on its own; extra
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

_FILTER_BITS = 20
_FILTER_SHIFT = np.uint64(64 - _FILTER_BITS)
_SCAN = "n_words long, hit array<int>, items array<string>, cut string"


class Windows:
    """All distinct windows of some items: by length, sorted hashes with their words and items."""

    def __init__(self, ids: list, texts: pa.Array, n: int) -> None:
        found: dict[int, dict[bytes, set]] = {}
        hashes: dict[bytes, int] = {}
        for s in tk.slices(texts, tk.ALNUM):
            h = s.hashes()
            for i in range(s.texts):
                a, b = int(s.bounds[i]), int(s.bounds[i + 1])
                length = min(n, b - a)
                if not length:
                    continue
                for at, g in enumerate(tk.grams(h[a:b], length), start=a):
                    key = b" ".join(s.word(k) for k in range(at, at + length))
                    found.setdefault(length, {}).setdefault(key, set()).add(ids[s.first + i])
                    hashes[key] = int(g)
        self.by_length = {}
        for length, keys in found.items():
            rows = sorted((hashes[k], k, [str(x) for x in items if x is not None]) for k, items in keys.items())
            value = np.array([r[0] for r in rows], dtype=np.uint64)
            near = np.zeros(1 << _FILTER_BITS, dtype=bool)
            near[(value >> _FILTER_SHIFT).astype(np.int64)] = True
            self.by_length[length] = (value, near, [r[1] for r in rows], [r[2] for r in rows])

    def hits(self, s: tk.Slice) -> tuple[np.ndarray, dict[int, set]]:
        """Which words of a slice are hit, and each hit text's items."""
        words, owner = s.hashes(), s.owner()
        marked = np.zeros(len(words) + 1, dtype=np.int64)
        items: dict[int, set] = {}
        for length, (value, near, keys, names) in self.by_length.items():
            g = tk.grams(words, length)
            at = np.flatnonzero(near[(g >> _FILTER_SHIFT).astype(np.int64)])
            at = at[owner[at] == owner[at + length - 1]] if len(at) else at
            slot = np.searchsorted(value, g[at])
            ok = slot < len(value)
            ok[ok] = value[slot[ok]] == g[at[ok]]
            for i, k in zip(at[ok], slot[ok], strict=True):
                words_here = b" ".join(s.word(j) for j in range(i, i + length))
                while k < len(value) and value[k] == g[i]:
                    if keys[k] == words_here:
                        marked[i] += 1
                        marked[i + length] -= 1
                        items.setdefault(int(owner[i]), set()).update(names[k])
                    k += 1
        return np.cumsum(marked)[:-1] > 0, items


def _scan(windows, remove: bool):
    """Adds what the windows hit to what earlier blocks have hit: the hit words' places and the items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for batch in batches:
            texts = tk.column(batch, "text")
            before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit", "items")]
            n_words, hit, items, cut = [], [], [], []
            for s in tk.slices(texts, tk.ALNUM):
                marked, found = w.hits(s)
                n_words.append(np.diff(s.bounds))
                some = np.unique(s.owner()[marked]).tolist() if marked.any() else []
                here_hit, here_items = dict.fromkeys(range(s.texts), ()), {}
                for i in some:
                    here_hit[i] = np.flatnonzero(marked[s.bounds[i] : s.bounds[i + 1]]).tolist()
                    here_items[i] = found.get(i, ())
                for i in range(s.texts):
                    k = s.first + i
                    old, seen = before[0][k] or (), before[1][k] or ()
                    places = sorted({*old, *here_hit[i]}) if old and here_hit[i] else list(old or here_hit[i])
                    hit.append(places)
                    items.append(sorted({*seen, *here_items.get(i, ())}))
                    cut.append(_without(s, i, places, texts[k].as_buffer().to_pybytes()) if remove and places else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("row")),
                    batch.column(batch.schema.get_field_index("text")),
                    pa.array(np.concatenate(n_words) if n_words else [], type=pa.int64()),
                    pa.array(hit, type=pa.list_(pa.int32())),
                    pa.array(items, type=pa.list_(pa.string())),
                    pa.array(cut, type=pa.string()),
                ],
                names=["row", "text", "n_words", "hit", "items", "cut"],
            )

    return scan


def _without(s: tk.Slice, i: int, places: list[int], text: bytes) -> str:
    """A text without its runs of hit words, nor what stands between the words of a run."""
    zero, kept, at = int(s.text_at[i]), [], 0
    edges = np.flatnonzero(np.diff(places) > 1)
    for a, b in zip(np.r_[0, edges + 1], np.r_[edges, len(places) - 1], strict=True):
        start = int(s.starts[s.bounds[i] + places[a]]) - zero
        kept.append(text[at:start])
        at = int(s.ends[s.bounds[i] + places[b]]) - zero
    return b"".join([*kept, text[at:]]).decode()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 8 << 20, remove: bool = False) -> DataFrame:
    """(row, text, n_words, hit, items, cut): ``row`` is a struct of the columns of ``docs`` but the text.

    ``hit`` are the places of the hit words, ``items`` the ids, as strings, of the
    items with windows in the text, ``cut`` (with ``remove``) the text without the
    hit runs, null where nothing is hit.
    """
    spark = docs.sparkSession
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    out = docs.select(
        F.struct(*rest).alias("row") if rest else F.struct(F.lit(1).alias("none")).alias("row"),
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hit"),
        F.array().cast("array<string>").alias("items"),
        F.lit(None).cast("string").alias("cut"),
    )
    row = out.schema["row"].dataType.simpleString()
    held = benchmark.where("text is not null").select("item_id", "text")
    total = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        part = held.where(block == k).toArrow()
        texts = tk.column(part.combine_chunks().to_batches()[0], "text") if part.num_rows else pa.array([], pa.large_string())
        windows = Windows(part["item_id"].to_pylist(), texts, n)
        step = _scan(spark.sparkContext.broadcast(windows), remove and k == blocks - 1)
        out = out.mapInArrow(step, f"row {row}, text string, {_SCAN}")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The columns of ``docs`` but the text, as a struct ``row``, with n_words, n_hit, items and contaminated."""
    return scan(docs, benchmark, **how).select(
        "row",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        "items",
        (F.size("hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "span", most: float = 0.5, **how) -> DataFrame:
    """``docs`` without what the benchmark's windows hit; the columns stay, n_chars is brought up to date.

    ``mode`` "span" removes the hit runs of words, and documents of which more
    than the share ``most`` of the words is hit; "document" removes every hit document.
    """
    if mode not in ("span", "document"):
        raise ValueError(f"mode is span or document, not {mode!r}")
    out = scan(docs, benchmark, remove=mode == "span", **how)
    if mode == "document":
        out = out.where(F.size("hit") == 0)
    else:
        out = out.where(F.size("hit") <= F.lit(most) * F.col("n_words")).withColumn("text", F.coalesce("cut", "text"))
    cols = []
    for c in docs.columns:
        x = F.col("text") if c == "text" else F.col(f"row.`{c}`")
        if c == "n_chars":
            x = F.when(F.size("hit") > 0, F.length("text")).otherwise(x).cast(docs.schema[c].dataType)
        cols.append(x.alias(c))
    return out.select(*cols)
