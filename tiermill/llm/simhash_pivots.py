"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a table row of its Hamming distances to fixed reference fingerprints (pivots). By the
triangle inequality two fingerprints within ``distance`` bits differ by at most ``distance`` in every coordinate, so a pair
with a larger coordinate difference is discarded without looking at its bits; survivors are verified.

Pairs meet in cells. The 64 bits are cut into ``distance + 2`` blocks; a pair within ``distance`` bits agrees on two blocks at
least, so the cells of all block pairs hold every link. A cell returns a spanning forest of its links, never all pairs, and
equal fingerprints are one vertex, so copies cost nothing. Small cells are compared by vector operations across all cells
of a batch. In a large cell (many near copies of one text) a search takes one fingerprint after another and drops whatever
it has reached, after a window on the first coordinate.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; rows with a null id are returned
with a null component, yet connect the others; repeated ids keep their rows; extra columns of whatever name are ignored here and
kept by ``representatives``; very long texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import as_bytes, carried, keep, lean, own, restored, tasks
from tiermill.llm.components import components

BITS = 64
PIVOTS = 16
SMALL_CELL = 24
CHUNK = 4096


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; A-Z are lower-cased, repeats count."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    hashes = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)]
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        block = np.array(hashes[i : i + CHUNK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * votes > len(hashes)).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``id``, ``fp`` (the fingerprint as a signed long) and ``h`` (the text's hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), _signed(values), batch.column(2)], names=["id", "fp", "h"])

    rows = docs.select(F.col(id).alias("id"), as_bytes(text).alias("text"), F.xxhash64(text).alias("h"))
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long, h long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, ..., spread over the space and the same in every run."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "big")) for i in range(count)], dtype=np.uint64)


def distance_table(values: np.ndarray, references: np.ndarray) -> np.ndarray:
    """One row of Hamming distances to the references for each value."""
    return np.bitwise_count(values[:, None] ^ references[None, :])


def blocks_of(distance: int) -> list[np.uint64]:
    """Masks that cut the 64 bits into ``distance + 2`` blocks."""
    edges = np.linspace(0, BITS, distance + 3).astype(int)
    return [np.uint64((1 << int(b)) - (1 << int(a))) for a, b in zip(edges[:-1], edges[1:])]


def _table(distance: int):
    masks = [a | b for a, b in combinations(blocks_of(distance), 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows = distance_table(values, references)
            table = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(values), [None, pa.py_buffer(rows.tobytes())])
            table = table.cast(pa.binary())
            for i, mask in enumerate(masks):
                cell = (values & mask).view(np.int64)
                yield pa.record_batch(
                    [pa.array(np.full(len(values), i, np.int32)), pa.array(cell), batch.column(0), table],
                    names=["i", "cell", "fp", "d"],
                )

    return run


def _within(values: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which index pairs survive the coordinate test and the check of their bits."""
    near = np.ones(len(a), bool)
    for p in range(table.shape[1]):
        left = np.flatnonzero(near)
        if not len(left):
            break
        difference = np.abs(table[a[left], p].astype(np.int16) - table[b[left], p])
        near[left] = difference <= distance
    left = np.flatnonzero(near)
    near[left] = np.bitwise_count(values[a[left]] ^ values[b[left]]) <= distance
    return near


def _search(values: np.ndarray, table: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within one large cell, as index pairs."""
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0].astype(np.int16)
    free = np.ones(len(values), bool)  # by place in ``order``
    links_a, links_b = [], []
    for start in range(len(values)):
        if not free[start]:
            continue
        free[start] = False
        frontier = [start]
        while frontier:
            place = frontier.pop()
            low, high = np.searchsorted(first, [first[place] - distance, first[place] + distance + 1])
            left = low + np.flatnonzero(free[low:high])
            if not len(left):
                continue
            one = order[place]
            others = order[left]
            reached = _within(values, table, np.full(len(others), one), others, distance)
            if reached.any():
                free[left[reached]] = False
                links_a.append(np.full(int(reached.sum()), one))
                links_b.append(others[reached])
                frontier.extend(left[reached].tolist())
    if not links_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(links_a), np.concatenate(links_b)


def _links(distance: int):
    def forest(which: np.ndarray, cell: np.ndarray, values: np.ndarray, table: np.ndarray) -> pa.RecordBatch | None:
        changes = np.flatnonzero((which[1:] != which[:-1]) | (cell[1:] != cell[:-1])) + 1
        starts = np.concatenate(([0], changes))
        sizes = np.diff(np.concatenate((starts, [len(values)])))
        left, right = [], []
        for start, size in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist()):
            a, b = _search(values[start : start + size], table[start : start + size], distance)
            left.append(values[start + a])
            right.append(values[start + b])
        small = np.repeat(np.where(sizes <= SMALL_CELL, sizes, 0), sizes)
        place = np.arange(len(values)) - np.repeat(starts, sizes)
        for lag in range(1, int(small.max(initial=1))):
            a = np.flatnonzero(place + lag < small)
            hit = _within(values, table, a, a + lag, distance)
            left.append(values[a[hit]])
            right.append(values[a[hit] + lag])
        if not left:
            return None
        u, v = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"]) if len(u) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            table = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, PIVOTS)
            rows = [*columns[:2], columns[2].view(np.uint64), table]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            # The last cell may go on in the next batch.
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in rows]
            if cut and (out := forest(*[x[:cut] for x in rows])) is not None:
                yield out
        if held is not None and (out := forest(*held)) is not None:
            yield out

    return run


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """``u``, ``v``: links between distinct values of ``fp`` that connect all fingerprints within ``distance`` bits."""
    spark = prints.sparkSession
    if not 0 <= distance <= 30:
        raise ValueError("distance must be between 0 and 30")
    cells = prints.select("fp").mapInArrow(_table(distance), "i int, cell long, fp long, d binary")
    return (
        cells.repartition(tasks(spark), "i", "cell")
        .sortWithinPartitions("i", "cell", "fp")
        .mapInArrow(lean(_links(distance)), "u long, v long")
    )


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """``fp``, ``root``, ``lowest``: each fingerprint's component, named by one of its fingerprints, and its smallest id."""
    # One row for each fingerprint: copies are collapsed before anything is compared.
    distinct = keep(prints.groupBy("fp").agg(F.min("id").alias("lowest")), "simhash-distinct", 8)
    roots = components(links(distinct, distance))
    return distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "lowest", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable over links) of every row."""
    prints = keep(fingerprints(docs, id, text, width), "simhash")
    named = _classes(prints, distance)
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    classes = keep(named.join(lowest, "root").select("fp", "component_id"), "simhash-classes", 8)
    return prints.join(classes, "fp").select(
        F.col("id").alias(id),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def representatives(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """The rows of ``docs`` with one of each component: the one with the smallest id (null ids last, then by text hash), and
    one row of equal ones."""
    prints = keep(fingerprints(docs, id, text, width), "simhash")
    roots = keep(_classes(prints, distance).select("fp", "root"), "simhash-classes", 8)
    keys = prints.groupBy("id", "h", "fp").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("h"))
    chosen = keep(
        keys.join(roots, "fp").groupBy("root").agg(F.min_by(F.struct("id", "h", "n"), order).alias("x")).select("x.*"),
        "simhash-chosen",
        8,
    ).withColumnsRenamed({"id": "i", "h": "g"})
    rows = carried(docs)
    same = own(id).eqNullSafe(F.col("i")) & (F.xxhash64(own(text)) == F.col("g"))
    single = rows.join(chosen.where("n = 1"), same, "left_semi")
    several = rows.join(chosen.where("n > 1"), same).dropDuplicates(["i", "g"]).select("row")
    return single.unionByName(several).select(*restored(docs.columns))
