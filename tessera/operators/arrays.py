"""N-dimensional arrays as chunk rows: slices, strides, updates, preallocation.

A large array is a frame of chunk rows ``c0, c1, ..., shape, values``: the chunk's coordinates in the grid, its own shape (edge
chunks are clipped) and its elements in row-major order.  A slice becomes a filter on the coordinates, which reaches the
Parquet scan, and an explode of the chunks that are left.  Indices count from 0 and ranges are half open.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_ELEMENTS = 1 << 20
SMALL_BYTES = 8192

Index = int | slice


@dataclass(frozen=True)
class Grid:
    """Shape of an array and of its chunks."""

    dims: tuple[int, ...]
    chunk: tuple[int, ...]

    @classmethod
    def of(cls, dims: Sequence[int], chunk: Sequence[int] | None = None) -> Grid:
        """A grid of chunks of about CHUNK_ELEMENTS, cut along the first dimensions first."""
        dims = tuple(int(d) for d in dims)
        if chunk is None:
            room, found = CHUNK_ELEMENTS, []
            for d in reversed(dims):
                found.append(max(1, min(d, room)))
                room = max(1, room // max(found[-1], 1))
            chunk = tuple(reversed(found))
        chunk = tuple(int(c) for c in chunk)
        if len(chunk) != len(dims) or any(c < 1 for c in chunk):
            raise ValueError(f"chunk {chunk} does not fit dimensions {dims}")
        return cls(dims, chunk)

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-d // c) for d, c in zip(self.dims, self.chunk, strict=True))

    @property
    def names(self) -> list[str]:
        return [f"c{k}" for k in range(len(self.dims))]


def bounds(grid: Grid, index: Sequence[Index]) -> list[tuple[int, int, int]]:
    """(first, stop, step) per dimension, checked; negative indices count from the end, as in Python."""
    if len(index) != len(grid.dims):
        raise IndexError(f"{len(index)} indices for {len(grid.dims)} dimensions")
    out = []
    for i, d in zip(index, grid.dims, strict=True):
        if isinstance(i, slice):
            step = 1 if i.step is None else i.step
            if step < 1:
                raise IndexError("steps must be positive")
            first, stop = (0 if i.start is None else i.start), (d if i.stop is None else i.stop)
            first, stop = (first + d if first < 0 else first), (stop + d if stop < 0 else stop)
            if not (0 <= first <= d and 0 <= stop <= d):
                raise IndexError(f"range {first}:{stop} is outside 0:{d}")
            out.append((first, max(stop, first), step))
        else:
            at = i + d if i < 0 else i
            if not 0 <= at < d:
                raise IndexError(f"index {i} is outside 0:{d}")
            out.append((at, at + 1, 1))
    return out


def to_chunks(spark: SparkSession, array: np.ndarray, grid: Grid) -> DataFrame:
    """Chunk rows of an array that the driver holds."""
    kind = {"i": "long", "u": "long", "f": "double", "b": "boolean"}[array.dtype.kind]
    rows = []
    for at in np.ndindex(*grid.counts):
        part = array[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, grid.chunk, strict=True))]
        rows.append((*map(int, at), list(map(int, part.shape)), part.ravel().tolist()))
    names = "".join(f"{n} int, " for n in grid.names)
    return spark.createDataFrame(rows, f"{names}shape array<int>, values array<{kind}>")


def elements_to_chunks(elements: DataFrame, grid: Grid, index: Sequence[str], value: str = "value") -> DataFrame:
    """Chunk rows of a frame with a row per element: index columns and a value.  One shuffle, on the chunk's coordinates."""
    cells = [(F.col(i) / c).cast("int").alias(n) for i, c, n in zip(index, grid.chunk, grid.names, strict=True)]
    shape = F.array(*[F.least(F.lit(c), F.lit(d) - F.col(n) * c).cast("int") for d, c, n in zip(grid.dims, grid.chunk, grid.names, strict=True)])
    place = F.struct(*[F.col(i).alias(f"i{k}") for k, i in enumerate(index)], F.col(value).alias("v"))
    grouped = elements.select(*cells, place.alias("e")).groupBy(*grid.names).agg(F.array_sort(F.collect_list("e")).alias("es"))
    return grouped.select(*grid.names, shape.alias("shape"), F.transform("es", lambda e: e["v"]).alias("values"))


def _local(offset: Column, shape: Column, k: int, n: int) -> Column:
    """The k-th local index of a row-major offset."""
    behind = F.lit(1).cast("long")
    for j in range(k + 1, n):
        behind = behind * shape[j]
    return F.pmod(F.floor(offset / behind), shape[k]).cast("int")


def explode_chunks(chunks: DataFrame, grid: Grid) -> DataFrame:
    """(i0, i1, ..., value): a row per element."""
    n = len(grid.dims)
    flat = chunks.select(*grid.names, "shape", F.posexplode("values").alias("pos", "value"))
    return flat.select(*[(F.col(f"c{k}") * grid.chunk[k] + _local(F.col("pos"), F.col("shape"), k, n)).cast("int").alias(f"i{k}") for k in range(n)], "value")


def touched(chunks: DataFrame, grid: Grid, index: Sequence[Index]) -> DataFrame:
    """The chunks that a slice meets; the filter on coordinates is pushed into the scan."""
    for (first, stop, _), c, name in zip(bounds(grid, index), grid.chunk, grid.names, strict=True):
        if stop == first:
            return chunks.where(F.lit(False))
        low, high = first // c, (stop - 1) // c
        chunks = chunks.where(F.col(name) == low) if low == high else chunks.where((F.col(name) >= low) & (F.col(name) <= high))
    return chunks


def slice_chunks(chunks: DataFrame, grid: Grid, index: Sequence[Index]) -> DataFrame:
    """(i0, ..., value) of a slice, with indices of the slice itself."""
    elements = explode_chunks(touched(chunks, grid, index), grid)
    places = []
    for k, (first, stop, step) in enumerate(bounds(grid, index)):
        at = F.col(f"i{k}")
        elements = elements.where((at >= first) & (at < stop) & ((at - first) % step == 0))
        places.append(((at - first) / step).cast("int").alias(f"i{k}"))
    return elements.select(*places, "value")


def update_chunks(chunks: DataFrame, grid: Grid, index: Sequence[Index], value: Callable[..., Column]) -> DataFrame:
    """All chunk rows with the elements of a slice set to value(old, i0, i1, ...), without a shuffle."""
    n, ranges = len(grid.dims), bounds(grid, index)
    hit = F.lit(True)
    for (first, stop, _), c, name in zip(ranges, grid.chunk, grid.names, strict=True):
        hit = hit & (F.col(name) >= first // c) & (F.col(name) <= (max(stop, 1) - 1) // c) & F.lit(stop > first)
    kind = chunks.schema["values"].dataType.elementType

    def step(x: Column, pos: Column) -> Column:
        at = [F.col(f"c{k}") * grid.chunk[k] + _local(pos, F.col("shape"), k, n) for k in range(n)]
        inside = F.lit(True)
        for a, (first, stop, jump) in zip(at, ranges, strict=True):
            inside = inside & (a >= first) & (a < stop) & ((a - first) % jump == 0)
        return F.when(inside, value(x, *at).cast(kind)).otherwise(x)

    return chunks.withColumn("values", F.when(hit, F.transform("values", step)).otherwise(F.col("values")))


def put_elements(chunks: DataFrame, grid: Grid, elements: DataFrame) -> DataFrame:
    """All chunk rows with the cells that elements (i0, ..., value) lists set; untouched chunks stay as they are.

    One shuffle of the listed cells and of the cells of the chunks that they fall into.
    """
    kind = chunks.schema["values"].dataType.elementType
    index = [f"i{k}" for k in range(len(grid.dims))]
    inside = [(F.col(i) >= 0) & (F.col(i) < d) for i, d in zip(index, grid.dims, strict=True)]
    wrong = F.raise_error(F.concat(F.lit("outside the array: "), F.concat_ws(", ", *[F.col(i).cast("string") for i in index])))
    checked = elements.select(*[F.when(ok, F.col(i)).otherwise(wrong.cast("long")).cast("int").alias(i) for i, ok in zip(index, inside, strict=True)], F.col("value").cast(kind).alias("value"))
    hit = checked.select(*[F.floor(F.col(i) / c).cast("int").alias(n) for i, c, n in zip(index, grid.chunk, grid.names, strict=True)]).distinct()
    old = explode_chunks(chunks.join(hit, grid.names, "left_semi"), grid).withColumn("turn", F.lit(0))
    both = old.unionByName(checked.withColumn("turn", F.lit(1)))
    cells = both.groupBy(*index).agg(F.max(F.struct("turn", "value")).alias("x")).select(*index, F.col("x.value").alias("value"))
    return chunks.join(hit, grid.names, "left_anti").select(*grid.names, "shape", "values").unionByName(elements_to_chunks(cells, grid, index))


def filled(chunks: DataFrame, grid: Grid, fill: object = 0) -> DataFrame:
    """All chunks of a preallocated array: those never written hold the fill value."""
    spark = chunks.sparkSession
    kind = chunks.schema["values"].dataType
    every = spark.range(math.prod(grid.counts)).select(*[F.pmod(F.floor(F.col("id") / math.prod(grid.counts[k + 1 :])), F.lit(grid.counts[k])).cast("int").alias(f"c{k}") for k in range(len(grid.dims))])
    shape = F.array(*[F.least(F.lit(c), F.lit(d) - F.col(f"c{k}") * c).cast("int") for k, (d, c) in enumerate(zip(grid.dims, grid.chunk, strict=True))])
    joined = every.join(chunks, grid.names, "left")
    size = F.aggregate(shape, F.lit(1), lambda a, x: a * x)
    blank = F.array_repeat(F.lit(fill).cast(kind.elementType), size)
    return joined.select(*grid.names, shape.alias("shape"), F.coalesce("values", blank).alias("values"))


def to_numpy(elements: DataFrame, shape: Sequence[int]) -> np.ndarray:
    """A slice as a numpy array on the driver."""
    found = elements.toPandas()
    out = np.zeros(tuple(shape), dtype=found["value"].dtype if len(found) else float)
    if len(found):
        out[tuple(found[f"i{k}"].to_numpy() for k in range(len(shape)))] = found["value"].to_numpy()
    return out


# Arrays that are small enough to be one column value


def slice_column(value: Column, first: int, stop: int, step: int = 1) -> Column:
    """Elements first, first + step, ... before stop of an array column (0-based)."""
    if step == 1:
        return F.slice(value, first + 1, max(stop - first, 0))
    return F.filter(F.slice(value, first + 1, max(stop - first, 0)), lambda _, i: i % step == 0)


def element_column(value: Column, at: int) -> Column:
    """One element; an index outside the array raises."""
    return F.element_at(value, at + 1 if at >= 0 else at)


def update_column(value: Column, first: int, stop: int, new: Column) -> Column:
    return F.transform(value, lambda x, i: F.when((i >= first) & (i < stop), new).otherwise(x))


def chunk_rows(df: DataFrame, keys: Sequence[str], value: str, chunk: int) -> DataFrame:
    """(keys, chunk, size, values) of an array column cut into chunks; the last one is clipped."""
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(value) - 1) / chunk).cast("int")), lambda c: F.struct(c.alias("chunk"), F.slice(F.col(value), c * chunk + 1, F.lit(chunk)).alias("values")))
    exploded = df.where(F.size(value) > 0).select(*keys, F.explode(cuts).alias("x"))
    return exploded.select(*keys, "x.chunk", F.size("x.values").alias("size"), F.col("x.values").alias("values"))
