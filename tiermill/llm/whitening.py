"""Whitening of embeddings by eigenvectors refined in mixed precision.

Entries become integers, so the sums and the covariance of all distinct vectors are exact: each task multiplies its centred
integers in blocks that a double holds without rounding, and the tasks' sums meet in Spark as limbs of 32 bits. Centred means
minus the integer next to the mean; the rest, below a half, is taken off exactly on the driver, which holds one matrix of the
vectors' dimension.

The eigenvectors of that covariance start in float32. Ogita-Aishima iterations correct them by matrix products alone; these
are worked out in pairs of doubles (about 100 bits), each as a sum of products of slices that a double multiplies without
rounding. Eigenvalues closer than the error bound of an iteration form a cluster, whose eigenvectors come from an eigenvalue
problem of the cluster's size, shifted by its mean so that small differences keep their digits.

Defined cases: rows whose vector is null or holds a null, NaN, an infinity or an entry beyond a long are dropped; so are those
of another length than the commonest (of equally common ones the longer). Rows with equal vectors or ids, or a null id, are
all returned, equal vectors counting once for the fit. Directions with less than 1e-24 of all variance are no components; so
one distinct vector, empty vectors and empty tables give no rows. Other columns are ignored. A deviation of more than 38
digits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import keep

LIMB = 32
#: Bits of a piece of a centred entry, and rows multiplied at once: 2 * PIECE bits and log2(ROWS) fit a double.
PIECE, ROWS = 20, 4096
LEAST_SHARE = 1e-24
#: Of the matrix's norm: closer values are always told apart within their cluster, and what is left between equal ones.
LEAST_GAP, NOISE = 2.0**-44, 2.0**-98
#: Clusters of a smaller part of the norm are refined themselves.
NARROW = 2.0**-20
#: One matrix of this dimension still fits the driver with ease.
MOST_DIMENSIONS = 8192

Pair = tuple[np.ndarray, np.ndarray]


# Products in pairs of doubles


def _two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    total = a + b
    back = total - a
    return total, (a - (total - back)) + (b - back)


def add(x: Pair, y: Pair) -> Pair:
    high, low = _two_sum(x[0], y[0])
    return _two_sum(high, low + (x[1] + y[1]))


def _slices(x: Pair, bits: int, count: int) -> list[np.ndarray]:
    """``x`` as a sum of matrices whose entries are multiples of a unit of their row, at most ``2**bits`` of it."""
    high, low = x
    top = np.abs(high).max(axis=1, keepdims=True)
    unit = np.ldexp(1.0, np.where(top > 0, np.frexp(top)[1], 0) - bits)
    found = []
    for _ in range(count):
        # Adding and taking off 1.5 * 2**52 units rounds to a multiple of the unit.
        lift = 1.5 * 2.0**52 * unit
        part = (high + lift) - lift
        found.append(part)
        high, low = _two_sum(high - part, low)
        unit = unit * 2.0**-bits
    return found


def multiply(x: Pair, y: Pair, wanted: int = 106) -> Pair:
    """The matrix product of two pairs, as a pair."""
    bits = (52 - max(1, x[0].shape[1]).bit_length()) // 2
    count = -(-wanted // bits) + 1
    left, right = _slices(x, bits, count), [p.T for p in _slices((y[0].T, y[1].T), bits, count)]
    total = (np.zeros((x[0].shape[0], y[0].shape[1])),) * 2
    for depth in reversed(range(count)):
        for i in range(depth + 1):
            product = left[i] @ right[depth - i]
            total = add(total, (product, np.zeros_like(product)))
    return total


def transposed(x: Pair) -> Pair:
    return x[0].T, x[1].T


# Refinement


def clusters(values: np.ndarray, distance: float) -> list[np.ndarray]:
    """Places of the values that follow each other within ``distance``, two or more of them."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > distance) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def _orthonormal(turn: np.ndarray) -> Pair:
    """A nearly orthonormal matrix made so to the digits of a pair, by one Newton step."""
    x: Pair = (turn, np.zeros_like(turn))
    square = multiply(transposed(x), x)
    half = add((1.5 * np.eye(len(turn)), np.zeros_like(turn)), (-square[0] / 2, -square[1] / 2))
    return multiply(x, half)


def _step(a: Pair, x: Pair, norm: float) -> tuple[Pair, Pair, float, list[np.ndarray]]:
    """One iteration: corrected vectors, values, the largest correction and the clusters."""
    size = len(a[0])
    eye = np.eye(size)
    product = multiply(transposed(x), x)
    r = add((eye, np.zeros_like(eye)), (-product[0], -product[1]))
    s = multiply(transposed(x), multiply(a, x))
    r_own, s_own = np.diag(r[0] + r[1]), (np.diag(s[0]).copy(), np.diag(s[1]).copy())
    values = _two_sum(s_own[0], s_own[1] + s_own[0] * (r_own / (1 - r_own)))
    # Symmetric, so that rounding turns the vectors but keeps them orthogonal.
    off, rest = s[0] + s[1], r[0] + r[1]
    off, rest = (off + off.T) / 2, (rest + rest.T) / 2
    np.fill_diagonal(off, 0)
    error = max(2 * (np.linalg.norm(off) + norm * np.linalg.norm(rest)), LEAST_GAP * norm)
    gap = (values[0][None, :] - values[0][:, None]) + (values[1][None, :] - values[1][:, None])
    far = np.abs(gap) > error
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.where(far, (off + values[0][None, :] * rest) / gap, rest / 2)
    moved = x[0] @ e
    x = add(x, (moved, np.zeros_like(moved)))
    near = clusters(values[0], error)
    for group in near:
        own = (x[0][:, group], x[1][:, group])
        middle = float(values[0][group].mean())
        inner, square = multiply(transposed(own), multiply(a, own)), multiply(transposed(own), own)
        # The shift is taken off before digits are lost.
        shift = multiply((np.full((1, 1), middle),) + (np.zeros((1, 1)),), (square[0].reshape(1, -1), square[1].reshape(1, -1)))
        small = add(inner, (-shift[0].reshape(square[0].shape), -shift[1].reshape(square[0].shape)))
        small = (small[0] + small[0].T) / 2, (small[1] + small[1].T) / 2
        # Equal values leave nothing to turn but noise.
        if np.abs(small[0] - np.diag(np.diag(small[0]))).max() <= NOISE * norm:
            continue
        narrow = np.linalg.norm(small[0]) < NARROW * norm
        turn = refined(small)[1] if narrow else _orthonormal(np.linalg.eigh(small[0])[1])
        x[0][:, group], x[1][:, group] = multiply(own, turn)
    return x, values, float(np.abs(e).max(initial=0.0)), near


def refined(a: Pair, rounds: int = 16) -> tuple[Pair, Pair]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric pair, both as pairs."""
    scale = float(np.abs(a[0]).max(initial=0.0))
    if not scale:
        zero = np.zeros_like(a[0])
        return (zero[0], zero[0]), (np.eye(len(zero)), zero)
    shift = -int(np.frexp(scale)[1])
    a = np.ldexp(a[0], shift), np.ldexp(a[1], shift)
    norm = float(np.linalg.norm(a[0]))
    for kind in (np.float32, np.float64):
        start = np.linalg.eigh(a[0].astype(kind))[1].astype(np.float64)
        x: Pair = (start, np.zeros_like(start))
        before = None
        for _ in range(rounds):
            x, values, moved, near = _step(a, x, norm)
            held = sorted(len(g) for g in near)
            if moved < 2.0**-56 and held == before:
                return (np.ldexp(values[0], -shift), np.ldexp(values[1], -shift)), x
            before = held
    raise ArithmeticError("the eigenvectors did not settle")


def eigen(a: Pair) -> Pair:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric pair, both correct to double precision."""
    values, vectors = refined(a)
    order = np.lexsort((-values[1], -values[0]))
    return values[0][order], vectors[0][:, order]


# Integers and their sums


def _encoded(scale: int):
    """Vectors as a width in bytes and that many bytes for each ``floor(scale * entry)``; equal vectors have equal codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes, sizes = [], [], []
            for place, row in enumerate(batch.column(1)):
                entries = row.values
                if entries is None or entries.null_count:
                    continue
                value = np.floor(scale * entries.to_numpy(zero_copy_only=False).astype(np.float64))
                if not (np.abs(value) < 2.0**62).all():
                    continue
                value = value.astype(np.int64)
                top = int(np.abs(value).max(initial=0))
                width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
                ids.append(place)
                sizes.append(len(value))
                codes.append(bytes([width]) + value.astype(f"<i{width}").tobytes())
            yield pa.record_batch(
                [batch.column(0).take(pa.array(ids, pa.int32())), pa.array(codes, pa.binary()), pa.array(sizes, pa.int32())],
                names=["id", "code", "size"],
            )

    return run


def decoded(codes: pa.Array, size: int) -> np.ndarray:
    """One row of integers for each code."""
    values = codes.to_pylist()
    widths = np.fromiter((v[0] for v in values), np.int8, len(values))
    out = np.empty((len(values), size), np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        joined = b"".join(values[i][1:] for i in rows.tolist())
        out[rows] = np.frombuffer(joined, f"<i{width}").reshape(-1, size)
    return out


def _pieces(values: np.ndarray) -> list[np.ndarray]:
    """Values as doubles of ``PIECE`` bits each, the lowest first; the last has the sign."""
    found = []
    while True:
        if (np.abs(values) < 1 << PIECE).all():
            return [*found, values.astype(np.float64)]
        found.append((values & ((1 << PIECE) - 1)).astype(np.float64))
        values = values >> PIECE


def gram(values: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of columns, as integers without a bound."""
    total = np.zeros((values.shape[1],) * 2, object)
    for start in range(0, len(values), ROWS):
        pieces = _pieces(values[start : start + ROWS])
        for i, one in enumerate(pieces):
            for j, other in enumerate(pieces):
                total += (one.T @ other).astype(np.int64).astype(object) << (PIECE * (i + j))
    return total


def limbs(values: list[int]) -> pa.RecordBatch:
    """Integers in parts whose sums over any number of tasks fit a long."""
    places, numbers, parts = [], [], []
    for place, value in enumerate(values):
        number = 0
        while value:
            last = -(1 << LIMB) < value < 1 << LIMB
            part = value if last else value & ((1 << LIMB) - 1)
            places.append(place)
            numbers.append(number)
            parts.append(part)
            value = 0 if last else value >> LIMB
            number += 1
    return pa.record_batch(
        [pa.array(places, pa.int32()), pa.array(numbers, pa.int32()), pa.array(parts, pa.int64())], names=["place", "limb", "part"]
    )


def _summed(fit: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], count: int) -> list[int]:
    """Exact sums over all vectors of the integers that ``of`` makes of a block; each task sends its own sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count, object)
        for batch in batches:
            if batch.num_rows:
                total = total + of(decoded(batch.column(0), size))
        yield limbs(total.tolist())

    parts = fit.select("code").mapInArrow(run, "place int, limb int, part long").groupBy("place", "limb").agg(F.sum("part").alias("part"))
    found = [0] * count
    for row in parts.collect():
        found[row.place] += row.part << (LIMB * row.limb)
    return found


def _columns(values: np.ndarray) -> np.ndarray:
    """Exact sums of the columns."""
    low, high = values & 0xFFFFFFFF, values >> 32
    return low.sum(axis=0).astype(object) + (high.sum(axis=0).astype(object) << 32)


@dataclass(frozen=True)
class Fit:
    """``n`` distinct vectors with column sums ``centre * n + rest``; the ``vectors`` and ``values`` of the largest components;
    their ``shares`` of all variance."""

    n: int
    size: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    shares: list[float]

    def deviations(self, values: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Centred vectors, and ``n`` squared times their squared lengths, exactly."""
        own = values - self.centre
        largest = int(np.abs(own).max(initial=0)) * self.n + max(map(abs, self.rest), default=0)
        if largest**2 * self.size < 2**62:
            whole = own * self.n - np.array(self.rest, np.int64)
            return whole / self.n, (whole * whole).sum(axis=1).tolist()
        whole = own.astype(object) * self.n - np.array(self.rest, object)
        return (whole / self.n).astype(np.float64), (whole * whole).sum(axis=1).tolist()

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred @ self.vectors) / np.sqrt(self.values)


def _as_pair(numerators: np.ndarray, divisor: int) -> Pair:
    """Exact quotients rounded to pairs of doubles."""
    size = len(numerators)
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            number = int(numerators[i, j])
            first = number / divisor
            p, q = first.as_integer_ratio()
            high[i, j] = high[j, i] = first
            low[i, j] = low[j, i] = (number * q - p * divisor) / (divisor * q)
    return high, low


def fit(distinct: DataFrame, size: int, components: int) -> Fit:
    """Components of the distinct vectors in ``code``."""
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} entries")
    n = distinct.count()
    sums = _summed(distinct, size, _columns, size)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    middle, upper = np.array(centre, np.int64), np.triu_indices(size)
    products = _summed(distinct, size, lambda values: gram(values - middle)[upper], len(upper[0]))
    numerators = np.zeros((size, size), object)
    for i, j, product in zip(*(x.tolist() for x in upper), products):
        numerators[i, j] = numerators[j, i] = n * product - rest[i] * rest[j]
    trace = sum(int(numerators[i, i]) for i in range(size))
    if not trace:
        return Fit(n, size, middle, rest, np.zeros(0), np.zeros((size, 0)), [])
    values, vectors = eigen(_as_pair(numerators, n * n))
    total = trace / (n * n)
    used = [k for k in range(min(size, components)) if values[k] > LEAST_SHARE * total]
    return Fit(n, size, middle, rest, values[used], vectors[:, used], [float(values[k]) / total for k in used])


def identity_error(distinct: DataFrame, found: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, as they come out, minus the identity."""
    count = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            if batch.num_rows:
                rows = found.project(found.deviations(decoded(batch.column(0), found.size))[0])
                total, square = total + rows.sum(axis=0), square + rows.T @ rows
        parts = np.concatenate((total, square.ravel()))
        yield pa.record_batch([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts)], names=["place", "part"])

    # Decimal sums do not depend on the order in which tasks end.
    part = F.col("part").cast("decimal(38,18)")
    rows = distinct.select("code").mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum(part).alias("part")).collect()
    parts = np.zeros(count + count * count)
    for row in rows:
        parts[row.place] = float(row.part) / found.n
    mean, square = parts[:count], parts[count:].reshape(count, count)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(count)).max(initial=0.0))


def whiten(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64
) -> DataFrame:
    """One row of ``id``, ``component`` (from 1), ``n`` (distinct vectors), ``deviation`` (decimal; ``n`` squared times the
    squared distance from the mean), ``whitened``, ``explained`` and ``identity_error`` for each usable row and component.
    Entries are taken as ``floor(scale * entry)``; any constant added to all of them changes nothing."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    coded = keep(rows.where("v IS NOT NULL").mapInArrow(_encoded(scale), f"id {kind}, code binary, size int"), "vectors", 4)
    out = f"id {kind}, deviation string, whitened array<double>"
    common = coded.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    found = None
    if common:
        alike = coded.where(F.col("size") == common["size"])
        distinct = keep(alike.select("code").distinct(), "vectors-distinct", 4)
        found = fit(distinct, common["size"], components)
    if not found or not found.shares:
        shape = f"{id} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return coded.sparkSession.createDataFrame([], shape)
    error = identity_error(distinct, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                centred, deviations = found.deviations(decoded(batch.column(1), found.size))
                projected = found.project(centred)
                starts = np.arange(len(projected) + 1, dtype=np.int32) * projected.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(projected.ravel()))
                yield pa.record_batch(
                    [batch.column(0), pa.array([str(d) for d in deviations]), lists], names=["id", "deviation", "whitened"]
                )

    shares = F.array(*[F.lit(s) for s in found.shares])
    return (
        alike.select("id", "code")
        .mapInArrow(run, out)
        .select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
        .select(
            F.col("id").alias(id),
            (F.col("k") + 1).alias("component"),
            F.lit(found.n).cast("long").alias("n"),
            F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"),
            "whitened",
            F.element_at(shares, F.col("k") + 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
