"""Whitening of embeddings along their principal components, from an exact integer scatter matrix.

Each component c of a vector becomes the integer ``floor(scale * c)``; a constant added to all of them, such as one that
makes them positive, changes no result, since all are centred. The scatter matrix of these integers is counted by bit slices: in blocks of rows, each dimension is shifted by its smallest value there, bit ``b`` of all shifted
values is packed across rows into words, and the product of two dimensions is the sum over pairs of their bit planes of
``2 ** (a + b)`` times the popcount of the planes' AND. The shifts are put back in exact integers. Tasks add up their blocks
and give off one row for each pair of dimensions, in limbs of 32 bits, which Spark sums; so the driver gets as many rows as
the matrix has entries, whatever the number of vectors. There the sums are centred as integers, ``n * products - sums x
sums``, before they become doubles for ``eigh``.

Vectors that are null or hold null or non-finite entries are left out, as are those with another number of components than
most of the others (of equally many the larger number). Integers are held within 2**62. Components whose
eigenvalue is at most 1e-12 of the largest are left out, so one vector alone, or only equal ones, give no rows. A
``deviation`` that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import ROW, whole_rows

SCALE = 64
COMPONENTS = 32
BLOCK = 1 << 14
LIMB = 32
SUMS = "a int, b int, " + ", ".join(f"limb{n} bigint" for n in range(6))
NEGLIGIBLE = 1e-12
LARGEST = 2.0**62


def integers(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    """``floor(scale * c)`` of all components, one row a vector."""
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64)
    return whole.reshape(-1, dimensions)


def planes(values: np.ndarray) -> list[np.ndarray]:
    """The bit planes of non-negative values, a row a dimension, each packed across rows into 64-bit words."""
    rows = len(values)
    width = -(-rows // 64) * 64
    found = []
    for bit in range(int(values.max(initial=0)).bit_length()):
        plane = np.zeros((values.shape[1], width), dtype=np.uint8)
        plane[:, :rows] = (values >> np.uint64(bit) & np.uint64(1)).T
        found.append(np.packbits(plane, axis=1).view(np.uint64))
    return found


def products(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of each column and of the products of each two columns, as Python integers."""
    rows, dimensions = values.shape
    low = values.min(axis=0)
    shifted = values.astype(np.uint64) - low.astype(np.uint64)
    sliced = planes(shifted)
    sums = np.zeros(dimensions, dtype=object)
    cross = np.zeros((dimensions, dimensions), dtype=object)
    for a, plane in enumerate(sliced):
        sums += np.bitwise_count(plane).sum(axis=1, dtype=np.int64).astype(object) * (1 << a)
        for b in range(a + 1):
            counts = np.empty((dimensions, dimensions), dtype=np.int64)
            for j in range(dimensions):
                counts[j] = np.bitwise_count(plane[j] & sliced[b]).sum(axis=1, dtype=np.int64)
            both = counts if a == b else counts + counts.T
            cross += both.astype(object) * (1 << (a + b))
    shift = low.astype(object)
    cross += np.outer(shift, sums) + np.outer(sums, shift) + rows * np.outer(shift, shift)
    return sums + rows * shift, cross


def limbs(value: int) -> list[int]:
    """Six parts of a number, each a multiple of a further 2**32; only the last one has a sign."""
    return [value >> LIMB * n & (1 << LIMB) - 1 for n in range(5)] + [value >> LIMB * 5]


def scatter(dimensions: int, scale: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's sums: for a pair (a, b) of dimensions, products; (a, -1) the sum of a; (-1, -1) the rows."""
        rows, sums, cross = 0, np.zeros(dimensions, dtype=object), np.zeros((dimensions, dimensions), dtype=object)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                values = integers(batch.column("vector").slice(start, BLOCK), dimensions, scale)
                own, both = products(values)
                rows, sums, cross = rows + len(values), sums + own, cross + both
        if rows:
            entries = [(-1, -1, rows), *((a, -1, sums[a]) for a in range(dimensions))]
            entries += [(a, b, cross[a, b]) for a in range(dimensions) for b in range(a + 1)]
            columns = zip(*[(a, b, *limbs(int(value))) for a, b, value in entries], strict=True)
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 6]
            names = [part.split(" ")[0] for part in SUMS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return count


@dataclass(frozen=True)
class Whitening:
    """What is learnt: rows, sums, components as columns, eigenvalues, shares and the error."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    scale: int


def decompose(n: int, sums: np.ndarray, cross: np.ndarray, components: int, scale: int) -> Whitening:
    """The leading components of the covariance, which is centred in integers."""
    dimensions = len(sums)
    none = Whitening(n, [int(s) for s in sums], np.zeros((dimensions, 0)), np.zeros(0), np.zeros(0), 0.0, scale)
    if not n or not dimensions:
        return none
    centred = n * cross - np.outer(sums, sums)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in centred], dtype=np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    some = values > NEGLIGIBLE * max(values[0], 0)
    values, vectors = values[some], vectors[:, some]
    if not len(values):
        return none
    white = vectors / np.sqrt(values)
    error = float(np.abs(white.T @ covariance @ white - np.eye(len(values))).max())
    return Whitening(n, none.sums, vectors, values, values / np.trace(covariance), error, scale)


def usable(vectors: DataFrame, keep: list[str] | None, vector: str) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    frame = whole_rows(vectors, keep, vector=vector)
    return frame.where(F.coalesce((F.size("vector") > 0) & ~F.exists("vector", bad), F.lit(False)))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Learns the components from all usable vectors."""
    good = usable(vectors, [vector], vector).select("vector")
    sizes = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return decompose(0, np.zeros(0, dtype=object), np.zeros((0, 0), dtype=object), components, scale)
    dimensions = sizes["size"]
    found = good.where(F.size("vector") == dimensions).mapInArrow(scatter(dimensions, scale), SUMS)
    added = found.groupBy("a", "b").agg(*[F.sum(f"limb{n}").alias(f"limb{n}") for n in range(6)]).collect()
    n, sums, cross = 0, np.zeros(dimensions, dtype=object), np.zeros((dimensions, dimensions), dtype=object)
    for row in added:
        value = sum(row[f"limb{k}"] << LIMB * k for k in range(6))
        if row["a"] < 0:
            n = value
        elif row["b"] < 0:
            sums[row["a"]] = value
        else:
            cross[row["a"], row["b"]] = cross[row["b"], row["a"]] = value
    return decompose(n, sums, cross, components, scale)


def deviations(values: np.ndarray, model: Whitening) -> tuple[np.ndarray, pa.Array]:
    """``n * x - S`` as doubles, rounded once, and the exact sums of its squares."""
    sums = np.array(model.sums, dtype=object)
    reach = model.n * int(np.abs(values).max(initial=0)) + max(abs(s) for s in model.sums)
    if values.shape[1] * reach * reach < 1 << 63:
        off = values * np.int64(model.n) - sums.astype(np.int64)
        return off.astype(np.float64), pa.array((off * off).sum(axis=1))
    off = values.astype(object) * model.n - sums
    squares = [int(total) for total in (off * off).sum(axis=1)]
    return off.astype(np.float64), pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())


def transform(vectors: DataFrame, model: Whitening, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Each usable row as ``row`` beside its ``deviation`` and its ``whitened`` components, from the first."""
    dimensions, count = model.components.shape
    frame = usable(vectors, keep, vector).where(F.size("vector") == (dimensions if count else -1))
    white = model.components / np.sqrt(model.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                off, squares = deviations(integers(part.column("vector"), dimensions, model.scale), model)
                found = (off / model.n) @ white
                places = pa.array(np.arange(0, found.size + 1, count), pa.int32())
                whitened = pa.ListArray.from_arrays(places, pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(ROW), squares, whitened], names=[ROW, "deviation", "whitened"])

    empty = frame.select(ROW, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    return frame.mapInArrow(project, empty.schema)


def by_component(whitened: DataFrame, model: Whitening) -> DataFrame:
    """A row for each vector and component: ``row``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``."""
    shares = F.array(*[F.lit(float(share)) for share in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    rows = whitened.select(ROW, "deviation", F.posexplode("whitened").alias("place", "white"))
    return rows.select(
        ROW,
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("white").alias("whitened"),
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
