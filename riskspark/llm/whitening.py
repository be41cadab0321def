"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Vectors become whole numbers (the floor of 256 times each component), so the sums over the fit list,
which holds each distinct vector once, are exact: every task centres its vectors on the rounded-down
mean, multiplies them in blocks whose products fit a double's 53 bits, and the partial sums meet in
decimals. The covariance is divided out once, correctly rounded. A pivoted Cholesky step gives
V = L L', one-sided Jacobi rotations make the columns of L orthogonal: their norms are the square roots
of the eigenvalues, the normalised columns the components.

Only matrices of dimension x dimension reach the driver, never anything that grows with the rows; the
fit list and the packed vectors are written tables, which cut lineage and are read again after a loss.

Defined cases: vectors that are null, empty or hold null, NaN or infinite components take no part, nor
do those whose length is not the commonest one (ties: the longer). Null ids are kept like others and
equal rows are returned as often as they come. Directions without variance are no components, so a row
may have fewer than `k` results; an empty table or a single distinct vector gives none. Components beyond the long range are
cut to it; a deviation beyond it is null. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import register, table, write_shared

SCALE = 256
EXACT = 1 << 53  # whole numbers up to here are exact in a double
LONG = 1 << 63
DIGITS = 60  # bits of the low part of a partial sum
WIDTHS = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}


@dataclass
class Whitening:
    """A fitted model: `components` has a column for each of `values`, largest first."""

    n: int
    shift: list[int]  # the mean, rounded down
    rest: list[int]  # sums of what the shift leaves: the mean is shift + rest / n
    values: np.ndarray
    components: np.ndarray
    trace: float


def packed_vector(vector: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them, behind that width: equal vectors, equal bytes."""
    low, high = int(vector.min()), int(vector.max())
    width = next(w for w in WIDTHS if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + vector.astype(WIDTHS[width]).tobytes()


def unpacked(column: pa.Array) -> np.ndarray:
    """Packed vectors of one length as rows of a matrix of longs."""
    texts = column.to_pylist()
    out = None
    for width, kind in WIDTHS.items():
        at = [i for i, t in enumerate(texts) if t[0] == width]
        if at:
            found = np.frombuffer(b"".join([texts[i][1:] for i in at]), kind).reshape(len(at), -1).astype(np.int64)
            out = np.empty((len(texts), found.shape[1]), np.int64) if out is None else out
            out[at] = found
    return out


def to_packed(vectors: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """(row: the named columns, d: length, x: packed whole numbers) of the vectors that take part."""
    plain = vectors.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, at, lengths, found = batch.column("v"), [], [], []
            ends = column.offsets.to_numpy()
            values = column.values
            absent = values.is_null().to_numpy(zero_copy_only=False)
            numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
            fine = np.isfinite(numbers) & ~absent
            with np.errstate(over="ignore", invalid="ignore"):
                wide = np.floor(SCALE * np.where(fine, numbers, 0.0)) + 0.0
            whole = np.where(wide >= LONG, LONG - 1, np.where(wide < -LONG, -LONG, 0)).astype(np.int64)
            inside = (wide < LONG) & (wide >= -LONG)
            whole[inside] = wide[inside].astype(np.int64)
            for i, there in enumerate(column.is_valid().to_pylist()):
                a, b = int(ends[i]), int(ends[i + 1])
                if there and b > a and fine[a:b].all():
                    at.append(i)
                    lengths.append(b - a)
                    found.append(packed_vector(whole[a:b]))
            rows = batch.column("row").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(lengths, pa.int32()), pa.array(found, pa.binary())], names=["row", "d", "x"])

    return plain.mapInArrow(run, f"row {plain.schema['row'].dataType.simpleString()}, d int, x binary")


def shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x - shift, as longs where they hold it and as Python's whole numbers elsewhere."""
    if max(-int(x.min()), int(x.max()), *map(abs, shift)) < LONG >> 1:
        return x - np.array(shift, np.int64)
    return x.astype(object) - np.array(shift, object)


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact, as Python's whole numbers."""
    small = max(-int(x.min()), int(x.max())) * len(x) < LONG
    return x.sum(0).astype(object) if small else x.astype(object).sum(0)


def products(y: np.ndarray) -> np.ndarray:
    """Exact y'y of a matrix of whole numbers."""
    most = max(-int(y.min()), int(y.max()), 1)
    block = EXACT // most**2
    if not block:
        return y.astype(object).T @ y.astype(object)
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), block):
        part = y[at : at + block].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def summed(df: DataFrame, of_matrix, names: list[str]) -> dict[tuple[int, ...], int]:
    """Exact totals over the packed vectors of `df` of what `of_matrix` gives for a matrix: {place: number}.

    Each task sends one line per place, so the driver gets as many numbers as there are places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            if batch.num_rows:
                found = of_matrix(unpacked(batch.column("x")))
                totals = found if totals is None else totals + found
        if totals is None:
            return
        places = np.argwhere(np.ones(totals.shape, bool))
        if totals.ndim == 2:
            places = places[places[:, 0] <= places[:, 1]]  # symmetric
        numbers = [int(totals[tuple(p)]) for p in places]
        columns = [pa.array(places[:, k], pa.int32()) for k in range(totals.ndim)]
        high = pa.array([Decimal(s >> DIGITS) for s in numbers], pa.decimal128(28, 0))
        low = pa.array([Decimal(s & ((1 << DIGITS) - 1)) for s in numbers], pa.decimal128(28, 0))
        yield pa.RecordBatch.from_arrays([*columns, high, low], names=[*names, "high", "low"])

    fields = ", ".join(f"{c} int" for c in names)
    parts = df.select("x").mapInArrow(run, f"{fields}, high decimal(28,0), low decimal(28,0)")
    rows = parts.groupBy(*names).agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {tuple(r[c] for c in names): (int(r["high"]) << DIGITS) + int(r["low"]) for r in rows}


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with L L' = v up to rounding, its columns in the order of the largest remaining diagonal; rank many."""
    d = len(v)
    left, columns = v.diagonal().copy(), []
    least = d * np.finfo(float).eps * left.max(initial=0.0)
    while len(columns) < d:
        p = int(left.argmax())
        if left[p] <= least:
            break
        column = v[:, p] - sum((c * c[p] for c in columns), np.zeros(d))
        column /= np.sqrt(left[p])
        column[left < 0] = 0.0  # places that were chosen before
        columns.append(column)
        left = left - column**2
        left[p] = -np.inf
    return np.array(columns).T.reshape(d, len(columns))


def pairings(r: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs that together hold each pair of 0..r-1 once."""
    ring = list(range(r + r % 2))
    half, out = len(ring) // 2, []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if max(a, b) < r]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared column norms, falling; normalised columns) after rotating the columns orthogonal."""
    w = factor.copy()
    rank = w.shape[1]
    tolerance = max(len(w), 1) * np.finfo(float).eps
    for _ in range(60):  # a handful of sweeps is usual
        turned = False
        for i, j in pairings(rank) if rank > 1 else []:
            a, b = w[:, i], w[:, j]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            zeta = (beta - alpha) / (2 * np.where(turn, gamma, 1.0))
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            w[:, i], w[:, j] = c * a - s * b, s * a + c * b
        if not turned:
            break
    values = (w * w).sum(0)
    order = np.argsort(-values, kind="stable")
    units = w[:, order] / np.sqrt(values[order])
    # One of both signs: the largest entry is positive.
    signs = np.sign(units[np.abs(units).argmax(0), np.arange(rank)]) if rank else np.ones(0)
    return values[order], units * signs


def fit_whitening(fit_list: DataFrame, d: int, k: int) -> Whitening | None:
    """Mean, eigenvalues and components of a table of distinct packed vectors of length `d`; None if empty."""
    n = fit_list.count()
    if not n:
        return None
    sums = summed(fit_list, column_sums, ["i"])
    shift = [sums[i,] // n for i in range(d)]
    rest = [sums[i,] - n * shift[i] for i in range(d)]
    scatter = summed(fit_list, lambda x: products(shifted(x, shift)), ["i", "j"])
    v = np.empty((d, d))
    for (i, j), s in scatter.items():
        v[i, j] = v[j, i] = (n * s - rest[i] * rest[j]) / (n * n)
    trace = sum(n * scatter[i, i] - rest[i] ** 2 for i in range(d)) / (n * n)
    values, units = one_sided_jacobi(pivoted_cholesky(v))
    return Whitening(n, shift, rest, values[:k], units[:, :k], trace)


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """A row of whitened coordinates for each vector."""
    y = shifted(x, model.shift).astype(np.float64) - np.array([r / model.n for r in model.rest])
    return y @ model.components / np.sqrt(model.values)


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n * x - S)^2."""
    y = shifted(x, model.shift)
    most = model.n * (max(-int(y.min()), int(y.max())) + 1)
    y = y.astype(object) if x.shape[1] * most**2 >= LONG else y
    off = model.n * y - np.array(model.rest, y.dtype)
    return [s if s < LONG else None for s in (off * off).sum(1).tolist()]


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = projected(unpacked(batch.column("x")), model)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=names)

    k = len(model.values)
    names = [f"w{i}" for i in range(k)]
    flat = fit_list.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    # covar_pop centres before it multiplies and merges partial results that way.
    pairs = [F.abs(F.covar_pop(names[i], names[j]) - float(i == j)) for i in range(k) for j in range(i, k)]
    return max(flat.agg(*pairs).first())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vector: str, keep: list[str], k: int = 4) -> DataFrame:
    """(row: the named columns, component, n, deviation, whitened, explained, identity_error).

    A line per vector that takes part and component, up to the `k` of largest variance.
    """
    spark = vectors.sparkSession
    packed = write_shared(to_packed(vectors, vector, keep), "packed")
    common = packed.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    row_type = packed.schema["row"].dataType.simpleString()
    schema = f"row {row_type}, {OUT}"
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    packed = packed.filter(F.col("d") == d).select("row", "x")
    # A vector that fills a third of the table leaves each task as one line.
    fit_list = write_shared(packed.select("x").distinct(), "fit-list")
    model = fit_whitening(fit_list, d, k)
    found = len(model.values)
    if not found:
        return spark.createDataFrame([], schema)
    explained, error = model.values / model.trace, identity_error(fit_list, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column("x"))
            rows = len(x)
            each = pa.array(np.repeat(np.arange(rows), found))
            columns = [
                batch.column("row").take(each),
                pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * found, model.n)),
                pa.array(deviations(x, model), pa.int64()).take(each),
                pa.array(projected(x, model).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * found, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *[f.split()[0] for f in OUT.split(", ")]])

    return packed.mapInArrow(run, schema)


@register("op12_embedding_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    found = whiten(vectors, "embedding", ["vec_id"])
    return found.select("row.vec_id", *[f.split()[0] for f in OUT.split(", ")])
