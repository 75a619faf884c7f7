"""Nearest stored vectors of many queries, through cells around fitted centres.

Vectors are scaled to length one, so the most similar one is the nearest. Centres are fitted on a sample of bounded size; every
vector lies in the cell of its nearest centre, and a cell knows its radius. A query is first compared with the cells nearest to
it. No vector of a cell can be nearer than the distance to its centre less its radius, so only cells for which that is below
the worst of the best ``k`` so far are searched after that: the result is exact. With ``exact=False`` it ends with the first
cells. Cells and query sets of any size are searched in parts and blocks by matrix products.

Vectors that have no direction (see ``vectors.unusable``) are left out. Equal similarities (to nine digits) go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.session import stored

DIGITS = 9


@dataclass(frozen=True)
class Cells:
    """A stored index: its vectors by cell (``path``), centres, and radius and number of vectors of each cell."""

    path: str
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _units(vectors: DataFrame, id: str, column: str, size: int) -> DataFrame:
    """``id`` and ``v`` (of length one) of the vectors that have a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for place, row in enumerate(batch.column(1).to_pylist()):
                if row is not None and len(row) == size and None not in row:
                    v = np.array(row, np.float64)
                    length = np.sqrt(v @ v)
                    if np.isfinite(length) and length > 0:
                        ids.append(place)
                        rows.append(v / length)
            kept = batch.column(0).take(pa.array(ids, pa.int32()))
            yield pa.record_batch([kept, pa.array(rows, pa.list_(pa.float64()))], names=["id", "v"])

    rows = vectors.select(F.col(id).alias("id"), F.col(column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>")


def fit_centres(units: DataFrame, cells: int, sample: int, rounds: int = 12) -> np.ndarray:
    """Centres of a sample of at most ``sample`` vectors, the same in every run."""
    rows = units.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    points = np.array([r.v for r in rows], np.float64)
    if not len(points):
        return np.zeros((0, 0))
    centres = points[: min(cells, len(points))].copy()
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            own = points[nearest == c]
            if len(own):
                middle = own.mean(axis=0)
                length = np.linalg.norm(middle)
                centres[c] = middle / length if length else centres[c]
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def build(
    vectors: DataFrame, path: str, size: int, id: str = "vec_id", column: str = "embedding", cells: int = 64, sample: int = 20_000
) -> Cells:
    """Store the index of all vectors of ``size`` numbers below ``path``."""
    units = stored(_units(vectors, id, column, size), "unit-vectors")
    centres = fit_centres(units, cells, sample)
    kind = units.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_matrix(batch.column(1)), centres)
                cell = far.argmin(axis=1)
                columns = [*batch.columns, pa.array(far[np.arange(len(cell)), cell]), pa.array(cell.astype(np.int32))]
                yield pa.record_batch(columns, names=["id", "v", "far", "cell"])

    placed = units.mapInArrow(run, f"id {kind}, v array<double>, far double, cell int")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    if len(centres):
        for r in vectors.sparkSession.read.parquet(path).groupBy("cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect():
            radius[r.cell], count[r.cell] = r.r, r.n
    return Cells(path, centres, radius, count)


def _asked(cells: Cells, first: int, rest: bool):
    """The cells in which each query is searched: its ``first`` nearest ones, or the others that its bound does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _distances(_matrix(batch.column(1)), cells.centres)
            rank = far.argsort(axis=1, kind="stable").argsort(axis=1)
            wanted = rank < first
            if rest:
                # Rounding must not rule out a cell on the border.
                bound = batch.column(2).to_numpy(zero_copy_only=False)[:, None] + 1e-6
                wanted = ~wanted & (far - cells.radius[None, :] <= bound)
            query, cell = np.nonzero(wanted & (cells.count > 0)[None, :])
            taken = batch.select([0, 1]).take(pa.array(query))
            yield pa.record_batch([*taken.columns, pa.array(cell.astype(np.int32))], names=["query", "v", "cell"])

    return run


def _searched(k: int):
    """The best of each group's vectors for each of its queries; rows are sorted by group, queries before vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, asked, best = None, [], [], None

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                flat = [(q, i, s) for q, found in zip(queries, best) for s, i in ((-s, i) for s, i in found)]
                if flat:
                    q, i, s = zip(*flat)
                    yield pa.record_batch([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s)], names=["query", "id", "similarity"])

        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("cell", "part", "block"))))
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != group:
                    yield from done()
                    group, queries, asked, best = keys[start], [], [], None
                rows = batch.slice(start, stop - start)
                start = stop
                is_query = rows.column("query").is_valid().to_numpy(zero_copy_only=False)
                if is_query.any():
                    own = rows.filter(pa.array(is_query))
                    queries += own.column("query").to_pylist()
                    asked.append(_matrix(own.column("v")))
                if not is_query.all() and queries:
                    own = rows.filter(pa.array(~is_query))
                    best = best or [[] for _ in queries]
                    ids = own.column("id").to_numpy(zero_copy_only=False)
                    scores = np.round(np.concatenate(asked) @ _matrix(own.column("v")).T, DIGITS)
                    few = min(k, len(ids))
                    for row, found in enumerate(best):
                        # All that reach the k-th best of this block, so that ties are settled by id.
                        limit = np.partition(scores[row], len(ids) - few)[len(ids) - few]
                        top = np.flatnonzero(scores[row] >= limit)
                        found += [(-float(scores[row, j]), int(ids[j])) for j in top.tolist()]
                        found.sort()
                        del found[k:]
        yield from done()

    return run


FOUND = "query long, id long, similarity double"


def _best(parts: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query; every searched group has sent ``k`` at most."""
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id"))), 1, k)
    return parts.groupBy("query").agg(ranked.alias("best"))


def top_k_many(
    cells: Cells,
    queries: DataFrame,
    k: int = 10,
    id: str = "vec_id",
    column: str = "embedding",
    first: int = 4,
    exact: bool = True,
    part_rows: int = 100_000,
    block_rows: int = 10_000,
) -> DataFrame:
    """``query``, ``rank`` (from 1), ``id`` and ``similarity`` of the ``k`` nearest vectors of each query; ids are whole numbers."""
    spark = queries.sparkSession
    if not len(cells.centres):
        return spark.createDataFrame([], "query long, rank int, id long, similarity double")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asking = stored(_units(queries, id, column, cells.centres.shape[1]).select(F.col("id").cast("long").alias("id"), "v"), "queries")
    blocks = max(1, -(-asking.count() // block_rows))
    number = F.array(*[F.lit(max(1, -(-int(c) // part_rows))) for c in cells.count])
    rows = spark.read.parquet(cells.path).withColumn("id", F.col("id").cast("long"))

    def search(asked: DataFrame) -> DataFrame:
        asked = stored(asked, "asked-cells")
        block = F.pmod(F.xxhash64("query"), F.lit(blocks))
        # Queries go to every part of their cell, vectors to every block that asks for their cell.
        parts = F.explode(F.sequence(F.lit(0), F.get(number, F.col("cell")) - 1))
        ours = asked.select("query", F.lit(None).cast("long").alias("id"), "v", "cell", parts.alias("part"), block.alias("block"))
        wanted = asked.select("cell", block.alias("block")).distinct()
        part = F.pmod(F.xxhash64("id"), F.get(number, F.col("cell"))).cast("int")
        theirs = rows.join(wanted, "cell").select(F.lit(None).cast("long").alias("query"), "id", "v", "cell", part.alias("part"), "block")
        group = ["cell", "part", "block"]
        both = ours.unionByName(theirs).repartition(n, *group).sortWithinPartitions(*group, F.col("query").isNull())
        return both.mapInArrow(_searched(k), FOUND)

    near = stored(search(asking.mapInArrow(_asked(cells, first, False), "query long, v array<double>, cell int")), "near-cells")
    found = near
    if exact:
        worst = F.when(F.size("best") >= k, F.element_at("best", -1).getField("s"))
        # The distance that goes with the worst similarity; without k neighbours nothing is ruled out.
        bound = _best(near, k).select(F.col("query").alias("q"), F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * worst)).alias("bound"))
        bounded = asking.join(bound, F.col("id") == F.col("q"), "left").select("id", "v", F.coalesce("bound", F.lit(9.0)).alias("bound"))
        others = bounded.mapInArrow(_asked(cells, first, True), "query long, v array<double>, cell int")
        found = near.unionByName(search(others))
    ranked = _best(found, k).select("query", F.posexplode("best").alias("p", "x"))
    return ranked.select("query", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.s")).alias("similarity"))
