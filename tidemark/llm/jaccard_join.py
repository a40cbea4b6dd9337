"""Exact Jaccard join of documents as a metric-space join.

The Jaccard distance is a metric, but two unrelated texts lie at distance 1
from each other and from nearly every other text, so that pivots taken from
the documents cannot tell most of them apart.  The first pivots are therefore
the one-shingle sets: a document lies at distance ``1 - 1/n`` from the pivots
it holds and at 1 from all others.  Ties between them are broken by one order
of all shingles (rare before frequent), which makes the cells a Voronoi
partition; a partner within ``r = 1 - threshold`` must have its own cell among
the document's first ``n - ceil(threshold * n) + 1`` pivots, and the document
is replicated into these and no others.

A region of up to ``leaf`` documents is joined pair by pair.  A larger region
is joined recursively: a few of its documents become pivots, the exact distance
of every document to them is computed, documents inside the ball of radius
``r`` are linked, and what is still unconnected meets only those documents whose
distances to the pivots differ by at most ``r`` (the triangle inequality).
Every surviving pair is verified on whole texts, so links are exact.

Equal sets are one class, numbered, before the join and expanded after it; what
is joined, verified and connected are classes, so that rows which share a doc_id
and differ in text stay apart.  Candidate pairs are ruled out by parities before
their texts are sent anywhere: every shingle flips one bit of its class's
signature, and two sets differ in at least as many shingles as bits.

Edge cases: null, empty and wordless texts have an empty set, link with nothing
and are their own component; of rows that share a doc_id each links by its own
text; a null doc_id is never the name of a component, and a class of which no
row has a doc_id links with nothing (its rows get null); extra columns are
ignored.  A very long text is one row of one kernel call, whose memory is some
forty times the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import connected, discard, release, small, spill

#: Counters of the rarity sketch.  Any order of the shingles is exact; this one only keeps regions small.
SKETCH_BITS = 18
_SHIFT = np.uint64(64 - SKETCH_BITS)


def _sketch(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles fall on each of the 2**SKETCH_BITS counters, over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for s in tk.slices(tk.column(batch, "text")):
                total += np.bincount((tk.grams(s.hashes(), shingle) >> _SHIFT).astype(np.int64), minlength=len(total))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])

    found = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _parities(value: np.ndarray, bounds: np.ndarray, i: int) -> bytes:
    """Bits of the i-th set, twice as many as shingles, rounded up to a power of two; every shingle flips one."""
    own = value[bounds[i] : bounds[i + 1]]
    bits = 1 << max(8, int(2 * len(own) - 1).bit_length())
    flips = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _sets(docs: DataFrame, shingle: int, threshold: float, level: np.ndarray) -> DataFrame:
    """(doc_id, n, k1, k2, home, odd): set size, a 128-bit name of the set, its first pivots in rarity order, its parities.

    Pivots are named by 32 bits: where two of a set fall together, ``home`` is
    shorter by one.
    """
    # the first document of each set in a batch carries the pivots for all its copies there
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            seen: set[tuple[int, int]] = set()
            for s in tk.slices(tk.column(batch, "text")):
                value, bounds = tk.shingle_sets(s, shingle)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(s.texts), n)
                k1, k2 = _names(value, bounds)
                order = np.lexsort((value, level[(value >> _SHIFT).astype(np.int64)], owner))
                ranked = (value[order] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                homes, odd = [], []
                for i in range(s.texts):
                    key = (int(k1[i]), int(k2[i]))
                    if n[i] == 0 or key in seen:
                        homes.append(None)
                        odd.append(None)
                        continue
                    seen.add(key)
                    home = ranked[bounds[i] : bounds[i] + _reach(int(n[i]), threshold)]
                    homes.append(home[np.sort(np.unique(home, return_index=True)[1])])
                    odd.append(_parities(value, bounds, i))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(s.first, s.texts),
                        pa.array(n.astype(np.int64)),
                        pa.array(k1),
                        pa.array(k2),
                        pa.array(homes, type=pa.list_(pa.int32())),
                        pa.array(odd, type=pa.binary()),
                    ],
                    names=["doc_id", "n", "k1", "k2", "home", "odd"],
                )

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n long, k1 long, k2 long, home array<int>, odd binary")


def _names(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of salted hashes for each set, which together name it."""
    sums = np.zeros((2, len(bounds) - 1), dtype=np.uint64)
    for row, salt in zip(sums, (0x5851F42D4C957F2D, 0x14057B7EF767814F), strict=True):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(value ^ np.uint64(salt)), dtype=np.uint64)])
        row[:] = total[bounds[1:]] - total[bounds[:-1]]
    return sums[0].view(np.int64), sums[1].view(np.int64)


def _percent(threshold: float) -> int:
    """Thresholds are whole percents, so that comparisons are exact in integers."""
    return round(threshold * 100)


def _reach(n: int, threshold: float) -> int:
    return n - -(-_percent(threshold) * n // 100) + 1


def _regions(cells: DataFrame, threshold: float, leaf: int, pivots: int) -> DataFrame:
    """Streams the cells, sorted by pivot, into candidate pairs.

    kind 0: a pair (a, b) of a small region; kind 1: a document and a pivot of
    its region, a small region having its first document for one; kind 2: a
    member (a) of a large region, with its size and place (b).  Holds at most ``leaf`` documents of a region
    at a time.
    """
    pct = _percent(threshold)

    def fits(n1, at1, n2, at2):
        need = -(-(n1 + n2) * pct // (100 + pct))
        most = 1 + np.minimum(n1 - at1, n2 - at2) - 1
        return (most >= need) & (100 * np.minimum(n1, n2) >= pct * np.maximum(n1, n2))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # rows (cell, id, n, at) of the region that may go on
        big = None  # the pivots of the region at hand, once it has outgrown a leaf

        def out(kind, cell, a, b, ordered=True):
            low, high = (np.minimum(a, b), np.maximum(a, b)) if ordered else (a, b)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(np.int32(kind), len(a)).copy() if np.ndim(kind) == 0 else kind), pa.array(np.broadcast_to(cell, len(a)).astype(np.int64)), pa.array(low), pa.array(high)],
                names=["kind", "cell", "a", "b"],
            )

        def star(rows, centres):
            for p in centres:
                if len(other := rows[rows[:, 1] != p[1]]):
                    yield out(1, other[:, 0], other[:, 1], np.full(len(other), p[1]))
            yield out(2, rows[:, 0], rows[:, 1], rows[:, 2] << 32 | rows[:, 3], ordered=False)

        def leaves(rows):
            """All pairs inside regions that are whole and small."""
            edge = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True])
            size = np.diff(edge)
            for m in np.unique(size[size > 1]):
                first = edge[:-1][size == m]
                x, y = np.triu_indices(int(m), 1)
                step = max(1, (1 << 18) // len(x))
                for k in range(0, len(first), step):
                    i, j = (first[k : k + step, None] + x).ravel(), (first[k : k + step, None] + y).ravel()
                    ok = fits(rows[i, 2], rows[i, 3], rows[j, 2], rows[j, 3]) & (rows[i, 1] != rows[j, 1])
                    if ok.any():
                        centre = np.tile(x == 0, len(i) // len(x))[ok].astype(np.int32)
                        yield out(centre, rows[i[ok], 0], rows[i[ok], 1], rows[j[ok], 1])

        def flush(rows, last):
            """Emits what is complete; returns the rows that may go on and the pivots of their region."""
            nonlocal big
            cell = rows[-1, 0]
            cut = len(rows) if last else int(np.searchsorted(rows[:, 0], cell, "left"))
            if big is not None:  # the first region goes on from before
                end = int(np.searchsorted(rows[:, 0], big[0][0], "right"))
                if end:
                    yield from star(rows[:end], big)
                rows, cut = rows[end:], max(0, cut - end)
                if not len(rows):
                    if last:
                        big = None
                    return rows
                big = None
            done, rest = rows[:cut], rows[cut:]
            if len(done):
                edge = np.flatnonzero(np.r_[True, done[1:, 0] != done[:-1, 0], True])
                size = np.diff(edge)
                for g in np.flatnonzero(size > leaf):
                    part = done[edge[g] : edge[g + 1]]
                    yield from star(part, part[:pivots])
                yield from leaves(done[np.repeat(size <= leaf, size)])
            if len(rest) > leaf:
                big = rest[:pivots].copy()
                yield from star(rest, big)
                rest = rest[:0]
            return rest

        def pump(rows, last):
            nonlocal held
            held = yield from flush(rows, last)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            if held is not None and len(held):
                rows = np.concatenate([held, rows])
            yield from pump(rows, False)
        if held is not None and len(held):
            yield from pump(held, True)

    return cells.mapInArrow(stream, "kind int, cell long, a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, share: int = 256) -> DataFrame:
    """(a, b, common, na, nb) of pairs of classes, from whole texts.

    Every b travels to its a; an a of many partners is copied to one task for
    each ``share`` of them, so that no group of copies meets in one place.  A
    row that shares the doc_id of a class's first row and has another text is
    told by the names of its set.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                sets: list[np.ndarray] = []
                own: list[np.ndarray] = []
                for s in tk.slices(tk.column(batch, "text")):
                    value, bounds = tk.shingle_sets(s, shingle)
                    sets += np.split(value, bounds[1:-1])
                    own.append(np.stack(_names(value, bounds)))
                names = np.concatenate(own, axis=1)
                a, part, b, k1, k2 = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "part", "b", "k1", "k2"))
                rows = []
                for i, found in enumerate(sets):
                    if (a[i], part[i]) != at:
                        at, centres = (a[i], part[i]), []
                    if (names[0, i], names[1, i]) != (k1[i], k2[i]):
                        continue
                    if b[i] is None:
                        centres = [found]
                        continue
                    rows += [(a[i], b[i], len(np.intersect1d(c, found, assume_unique=True)), len(c), len(found)) for c in centres]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], type=pa.int64()) for k in range(5)], names=["a", "b", "common", "na", "nb"]
                )

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / share).alias("parts"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    known = classes.select("id", "rep", "k1", "k2")
    rest = spill(dealt.join(known.withColumnRenamed("id", "b"), "b").select("rep", "a", "part", "b", "k1", "k2"), "dealt")
    ahead = rest.select("a", "part").distinct().join(known.withColumnRenamed("id", "a"), "a")
    asked = spill(rest.unionByName(ahead.withColumn("b", F.lit(None).cast("long"))), "asked")
    rows = docs.join(small(asked), docs["doc_id"] == F.col("rep")).select("a", "part", "b", "k1", "k2", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    out = spill(rows.mapInArrow(measure, "a long, b long, common long, na long, nb long").distinct(), "measured")
    for done in (rest, asked):
        discard(done)
    release(docs.sparkSession)
    return out


def _possible(pairs: DataFrame, marks: DataFrame, pct: int) -> DataFrame:
    """The pairs that may link by the sizes and parities of their sets."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("na", "nb"))
            need = -(-(na + nb) * pct // (100 + pct))
            ok = 100 * np.minimum(na, nb) >= pct * np.maximum(na, nb)
            odd = zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("oa", "ob")), strict=True)
            for i, (x, y) in enumerate(odd):
                if not ok[i]:
                    continue
                u, v = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                short = min(len(u), len(v))  # a longer signature folds
                u, v = (np.bitwise_xor.reduce(z.reshape(-1, short), axis=0) for z in (u, v))
                ok[i] = int(np.bitwise_count(u ^ v).sum()) <= na[i] + nb[i] - 2 * need[i]
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    one = marks.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    two = marks.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    both = two.join(one.join(small(pairs), "a"), "b").select("a", "b", "na", "nb", "oa", "ob")
    return both.mapInArrow(keep, "a long, b long")


def _is_hot(cell, noisy: np.ndarray):
    """Whether a pivot's counter is among the noisy ones, by a bitmap of all counters."""
    slot = F.shiftrightunsigned(cell, 32 - SKETCH_BITS)
    bits = np.packbits(noisy, bitorder="little").view(np.int64)
    bitmap = F.split(F.lit(" ".join(map(str, bits))), " ").cast("array<bigint>")
    word = F.get(bitmap, F.shiftright(slot, 6))
    return F.call_function("shiftright", word, slot.bitwiseAND(63)).bitwiseAND(1) == 1


def jaccard_components(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    leaf: int = 64,
    pivots: int = 3,
    hot: int = 1 << 16,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when their sets of ``shingle``-word shingles have a
    Jaccard similarity of at least ``threshold`` (a whole percent).  ``leaf``,
    ``pivots`` and ``hot`` (the rows a region may hold before it is dealt out
    over many tasks) steer the work, never the result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pct = _percent(threshold)
    counts = _sketch(docs, shingle)
    usual = max(1.0, float(np.median(counts)))
    level = np.floor(2 * np.log2(np.maximum(counts / usual, 1.0))).astype(np.uint8)
    sets = spill(_sets(docs, shingle, threshold, level), "sets")

    # equal sets: one class, with the smallest doc_id of its rows, and numbered by it: pivots are the first of their region,
    # and of a group of near copies the first is likelier than others to lie in the middle
    grouped = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    classes = spill(grouped.orderBy("rep", "k1", "k2").withColumn("id", F.monotonically_increasing_id()), "classes")
    # of a class's rows with pivots (one for each batch that holds a copy) one is kept: they are alike
    known = classes.where("rep is not null").select("k1", "k2", "id")
    homes = sets.where("home is not null").join(known, ["k1", "k2"])
    homes = spill(homes.select("id", "n", "home", "odd").dropDuplicates(["id"]), "homes")
    sets, whole = spill(sets.drop("home", "odd"), "sets"), sets
    discard(whole)
    release(docs.sparkSession)
    marks = homes.select("id", "n", "odd")
    cells = homes.select("id", "n", F.posexplode("home").alias("at", "cell"))
    noisy = counts > usual + hot
    calm = cells.where(~_is_hot(F.col("cell"), noisy)) if noisy.any() else cells
    found = _regions(
        calm.select("cell", "id", F.col("n").cast("int").alias("n"), "at")
        .repartition("cell")
        .sortWithinPartitions("cell", "id"),
        threshold,
        leaf,
        pivots,
    )
    if noisy.any():
        # regions that may hold a large part of all documents: dealt out by document, one pivot for all
        many = cells.where(_is_hot(F.col("cell"), noisy)).groupBy("cell", "id").agg(F.min("n").alias("n"), F.min("at").cast("long").alias("at"))
        centre = many.groupBy("cell").agg(F.min("id").alias("p"))
        starred = many.join(centre, "cell")
        found = found.union(
            starred.where("id != p").select(F.lit(1).alias("kind"), "cell", F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
        ).union(starred.select(F.lit(2).alias("kind"), "cell", F.col("id").alias("a"), F.expr("shiftleft(cast(n as bigint), 32) | at").alias("b")))
    found = spill(found, "regions")
    del cells, calm
    release(docs.sparkSession)

    def is_link(measured: DataFrame) -> DataFrame:
        return measured.where(f"100 * common >= {pct} * (na + nb - common)").select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame | None:
        """What is left of some pairs after their parities, measured on whole texts."""
        open_ = spill(pairs, "open")
        left = spill(_possible(open_, marks, pct), "pairs")
        out = None if left.isEmpty() else _verify(left, docs, classes, shingle)
        discard(open_)
        discard(left)
        return out

    # first each document and the pivot that it shares most regions with: that connects most of what there is to connect
    starred = found.where("kind = 1 and a != b").groupBy("a", "b").agg(F.count("*").alias("m"))
    nearest = starred.groupBy("b").agg(F.max(F.struct("m", (-F.col("a")).alias("a"))).alias("x"))
    tried = spill(nearest.select((-F.col("x.a")).alias("a"), "b"), "tried")
    none = docs.sparkSession.createDataFrame([], "a long, b long, common long, na long, nb long")
    measured = verified(tried)
    measured = none if measured is None else measured
    around = connected(is_link(measured), "a", "b")
    # then the pairs that are not connected yet: of small regions, and of documents and the other pivots
    pairs = _open_pairs(found.where("kind < 2 and a != b").select("a", "b").distinct(), around)
    again = verified(pairs.join(tried, ["a", "b"], "left_anti"))
    if again is not None:
        measured = measured.union(again)
        around = connected(is_link(measured), "a", "b")
    # last, inside large regions, what the balls around the pivots leave open
    members = found.where("kind = 2").select("cell", F.col("a").alias("id"), F.expr("b >> 32").alias("n"), F.expr("b & 4294967295").alias("at"))
    members = members.dropDuplicates(["cell", "id"])
    if not members.isEmpty():
        pairs = _windows(members, found, measured, around, pct).join(measured.select("a", "b"), ["a", "b"], "left_anti")
        last = verified(pairs)
        if last is not None:
            around = connected(is_link(measured.union(last)), "a", "b")
    # a component is named by the smallest doc_id of its classes
    placed = classes.join(around.withColumnRenamed("node", "id"), "id", "left").select(
        "k1", "k2", "rep", F.coalesce("component", "id").alias("component")
    )
    names = placed.groupBy("component").agg(F.min("rep").alias("name"))
    out = sets.join(placed.join(names, "component").select("k1", "k2", "name"), ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id")
    )
    out = spill(out, "components")
    for done in (sets, classes, homes, found, tried):
        discard(done)
    release(docs.sparkSession)
    return out


def _open_pairs(pairs: DataFrame, around: DataFrame) -> DataFrame:
    """The pairs whose documents are not in one component yet."""
    ca = around.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = around.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return both.where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")


def _windows(members: DataFrame, found: DataFrame, measured: DataFrame, around: DataFrame, pct: int) -> DataFrame:
    """Pairs of large regions that the balls around their pivots have not connected and the triangle inequality allows."""
    placed = members.join(around.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    size = placed.groupBy("cell", "component").agg(F.count("*").alias("m"))
    main = size.groupBy("cell").agg(F.max(F.struct("m", "component")).alias("x"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("cell", F.col("x.component").alias("main"))
    far = F.expr("1 - common / cast(na + nb - common as double)")
    # of the measured pairs of a region each is a document and a pivot; whichever names both of two documents bounds them
    pivot = found.where("kind = 1").join(members.select("cell").distinct(), "cell", "left_semi").select("cell", "a", "b").distinct()
    both = pivot.join(measured.dropDuplicates(["a", "b"]), ["a", "b"]).withColumn("far", far)
    ring = both.groupBy("cell", F.col("b").alias("id")).agg(
        F.map_from_entries(F.collect_set(F.struct(F.col("a").alias("p"), "far"))).alias("ring")
    )
    open_ = spill(placed.join(main, "cell").join(ring, ["cell", "id"], "left"), "open")
    one = open_.where("component != main").select(
        "cell", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("ring").alias("rx"), "main",
        F.col("n").alias("nx"), F.col("at").alias("ax"),
    )
    two = open_.select(
        "cell", F.col("id").alias("y"), F.col("component").alias("cy"), F.col("ring").alias("ry"),
        F.col("n").alias("ny"), F.col("at").alias("ay"),
    )
    fits = F.expr(
        f"least(nx - ax, ny - ay) >= ceil((nx + ny) * {pct} / {100 + pct}) and 100 * least(nx, ny) >= {pct} * greatest(nx, ny)"
    )
    near = F.expr(
        f"rx is null or ry is null or forall(map_keys(rx), p -> ry[p] is null or abs(rx[p] - ry[p]) <= {1 - pct / 100} + 1e-9)"
    )
    return (
        one.join(two, "cell")
        .where(fits & F.expr("cx != cy and (cy = main or x < y)") & near)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """Keeps the document with the smallest doc_id of every component; its columns stay as they are.

    Rows with a null doc_id are kept.  Of rows that share a doc_id all are kept, or none: they go only if each of them
    belongs to a component of a smaller doc_id.
    """
    found = jaccard_components(docs, **how)
    worst = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("top"))
    later = spill(worst.where("top < doc_id").select(F.col("doc_id").alias("later")), "later")
    packed = docs.select(F.col("doc_id").alias("d"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.join(small(later), F.col("d") == F.col("later"), "left_anti").select("row.*")
