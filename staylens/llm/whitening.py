"""Embedding whitening: principal components of integer vectors from exact cross-products, worked out by bit slices.

An entry c of a vector becomes the integer floor(256 c). A task takes blocks of vectors, shifts each dimension to begin
at 0, and packs each bit of it over the rows of the block into words. The cross-product of two dimensions is the sum over
their bit planes of popcount(plane AND plane) times two to the power of both bits: exact, without multiplying an entry.
The shift is taken back and the blocks' sums are added as integers; n Q - S S' centres them, still as integers, so that
rounding begins only with the covariance that eigh is given. What leaves a task, and what the driver holds, is bounded by
the square of the number of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, write_shared

BLOCK = 8192
_LIMB = 60
_CELL = "cell long, width int, low long, middle long, high long"


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as 64-bit integers; beyond their range the nearest of them."""
    scaled = np.floor(values * 256)
    edge = float(1 << 63)
    out = np.where(np.abs(scaled) < edge, scaled, 0).astype(np.int64)
    return np.where(scaled >= edge, np.iinfo(np.int64).max, np.where(scaled < -edge + 1, np.iinfo(np.int64).min, out))


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector (not null, no null or non-finite entry, not empty), and their integers, a row each. Vectors of several lengths are an error."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.zeros(len(column), np.int64)
    sizes[there] = column.drop_null().value_lengths().to_numpy(zero_copy_only=False)
    flat = column.drop_null().flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    fine = there & (sizes > 0)
    fine[row[~np.isfinite(values)]] = False
    widths = np.unique(sizes[fine])
    if len(widths) > 1:
        raise ValueError(f"vectors of several lengths: {widths.tolist()}")
    kept = values[fine[row]]
    return fine, _integers(kept.reshape(fine.sum(), -1)) if fine.any() else np.zeros((0, 0), np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of integers, a row each. Vectors of several lengths are an error."""
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sizes.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of unsigned columns packed over rows into words, the bit of each plane, and where each column's planes begin."""
    most = shifted.max(axis=0)
    n_bits = np.array([max(1, int(m).bit_length()) for m in most])
    words = -(-len(shifted) // 64)
    out = np.zeros((n_bits.sum(), words * 8), np.uint8)
    bit = np.concatenate([np.arange(n) for n in n_bits])
    owner = np.repeat(np.arange(len(n_bits)), n_bits)
    turned = np.ascontiguousarray(shifted.T)
    for k, (d, b) in enumerate(zip(owner.tolist(), bit.tolist(), strict=True)):
        packed = np.packbits((turned[d] >> np.uint64(b) & np.uint64(1)).astype(bool))
        out[k, : len(packed)] = packed
    return out.view(np.uint64), bit, np.concatenate([[0], np.cumsum(n_bits)[:-1]])


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the columns of x and sums of products of each two of them, as Python integers."""
    least = x.min(axis=0)
    shifted = x.astype(np.uint64) - least.astype(np.uint64)
    planes, bit, starts = _planes(shifted)
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for k in range(len(planes)):
        counts[k, k:] = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
    counts = np.triu(counts) + np.triu(counts, 1).T
    small = 2 * int(bit.max()) + 2 + len(x).bit_length() < 62
    kind = np.int64 if small else object
    power = np.array([1 << b for b in bit.tolist()], kind)
    products = np.add.reduceat(np.add.reduceat(counts.astype(kind) * power[:, None] * power[None, :], starts, axis=0), starts, axis=1).astype(object)
    sums = np.add.reduceat(np.diag(counts).astype(kind) * power, starts).astype(object)
    low = least.astype(object)
    n = len(x)
    return sums + low * n, products + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Python integers as three 64-bit columns, of which the highest has the sign."""
    mask = (1 << _LIMB) - 1
    return [np.array([f(v) for v in values], np.int64) for f in (lambda v: v & mask, lambda v: v >> _LIMB & mask, lambda v: v >> 2 * _LIMB)]


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task: n, the sum of each dimension, the products of each two, as numbered cells."""
    n, sums, products = 0, None, None
    for batch in batches:
        x = _matrix(batch.column("x"))
        for i in range(0, len(x), BLOCK):
            s, q = cross_products(x[i : i + BLOCK])
            n += min(BLOCK, len(x) - i)
            sums, products = (s, q) if sums is None else (sums + s, products + q)
    if n:
        cells = np.concatenate([np.array([n], object), sums, products[np.triu_indices(len(sums))]])
        width = pa.array(np.full(len(cells), len(sums), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), width, *map(pa.array, _limbs(cells))], ["cell", "width", "low", "middle", "high"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine, x = vectors(batch.column("embedding"))
        ids = batch.column("vec_id").filter(pa.array(fine))
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0), pa.array(x.ravel()))], ["vec_id", "x"])


class Model:
    """Sums of the fit list and the components of its covariance."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, components: int):
        """products are centred as integers: n Q - S S' is n squared times the covariance, and each quotient is rounded once."""
        self.n, self.sums = n, sums
        centred = n * products - np.outer(sums, sums)
        covariance = np.array([[v / (n * n) for v in row] for row in centred.tolist()], np.float64)
        values, unit = np.linalg.eigh(covariance)
        order = np.argsort(values, kind="stable")[::-1][:components]
        trace = sum(np.diag(centred).tolist()) / (n * n)
        self.values = np.maximum(values[order], 0)
        self.values[self.values <= len(covariance) * np.finfo(float).eps * max(self.values.max(initial=0), 0)] = 0
        unit = unit[:, order]
        strongest = unit[np.abs(unit).argmax(axis=0), np.arange(unit.shape[1])]
        self.unit = unit * np.where(strongest < 0, -1, 1)
        self.explained = [float(v / trace) if trace else None for v in self.values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x on each component at unit variance; a component without variance gives nan."""
        mean = np.array([int(s) / self.n for s in self.sums])
        with np.errstate(invalid="ignore", divide="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return (x - mean) @ self.unit * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S) squared, exact."""
        most = self.n * max(int(np.abs(x.astype(np.float64)).max(initial=0)), 1) + max(abs(int(s)) for s in self.sums)
        kind = np.int64 if len(self.sums) * most * most < 1 << 62 else object
        apart = x.astype(kind) * self.n - self.sums.astype(kind)
        return [int(v) for v in (apart * apart).sum(axis=1)]


def fit(x: DataFrame, components: int) -> Model | None:
    """The model of a table of distinct integer vectors (x); none if there is no vector."""
    cells = x.select("x").mapInArrow(_scattered, _CELL)
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = cells.groupBy("cell").agg(F.min("width").alias("least"), F.max("width").alias("most"), wide("low"), wide("middle"), wide("high")).collect()  # one row for each two dimensions
    if not found:
        return None
    d = found[0].most
    if any(r.least != d or r.most != d for r in found):
        raise ValueError(f"vectors of several lengths: {sorted({x for r in found for x in (r.least, r.most)})}")
    cell = np.zeros(len(found), object)
    for r in found:
        cell[r.cell] = int(r.low) + (int(r.middle) << _LIMB) + (int(r.high) << 2 * _LIMB)
    products = np.zeros((d, d), object)
    at = np.triu_indices(d)
    products[at] = cell[1 + d :]
    products[at[::-1]] = cell[1 + d :]
    return Model(int(cell[0]), cell[1 : d + 1], products, components)


def _judged(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("x"))
        w = model.whitened(x) if len(x) else np.zeros((0, 0))
        lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (w.shape[1] if len(x) else 0), pa.array(w.ravel(), from_pandas=True))
        wide = pa.array([str(v) for v in model.deviations(x)] if len(x) else [], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), wide, lists], ["vec_id", "deviation", "whitened"])


def identity_error(whitened: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance (divisor n) of arrays of k entries, less the identity; components of null entries are left out."""
    at = lambda i: F.col("whitened")[i]
    off: list[Column] = [F.abs(F.covar_pop(at(i), at(j)) - F.lit(float(i == j))).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    found = [v for v in whitened.agg(*off).first() if v is not None]
    return max(found, default=None)


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained and identity_error for each vector and component.

    embeddings: vec_id and embedding, an array of numbers. Rows whose vector is null, empty, or holds null or non-finite
    entries are dropped; vectors of several lengths are an error. The model is fitted to each distinct integer vector
    once; repeated rows each give their rows, a null vec_id stays null, further columns are left alone. Vectors of fewer
    dimensions have as many components. A component without variance has null in whitened; if all vectors are equal,
    explained is null too. An empty table gives no rows.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    entry = T.StructType([field(rows, "vec_id"), T.StructField("x", T.ArrayType(T.LongType()))])
    told = T.StructType([entry["vec_id"], T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    found = rows.mapInArrow(_entries, entry)
    listed = write_shared(found.select("x").distinct())
    model = fit(listed, components)
    if model is None:
        kinds = [entry["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)), *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]]
        return embeddings.sparkSession.createDataFrame([], T.StructType(kinds))
    judge = lambda df: df.mapInArrow(lambda it: _judged(model, it), told)
    error = identity_error(judge(listed.select(F.lit(None).cast(entry["vec_id"].dataType).alias("vec_id"), "x")), len(model.values))
    each = judge(found).select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened"))
    shares = F.array(*[F.lit(v).cast("double") for v in model.explained])
    return each.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("_at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
