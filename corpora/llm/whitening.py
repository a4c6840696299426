"""Whitening of embeddings from exact cross-products, counted on bit planes.

Each entry becomes an integer. The distinct vectors are the fit list. In its tasks the entries,
shifted by the least one so that none is negative, are cut into bit planes, and each plane of each
dimension is packed across rows into 64-bit words. The product of two dimensions summed over the
rows is then the sum of 2 ** (p + q) times the set bits that plane p of one and plane q of the other
share. Tasks return only these counts, a row for each pair of dimensions and each weight; Spark adds
them up. So the cross-products are exact for any number of rows and any size of entries, and what
reaches the driver depends on dimensions and bits alone. They are centred as integers and only then
become doubles for the eigenvectors.

Nulls: rows whose vector is null, empty, or holds null or non-finite entries take no part; null ids
stay. Repeated rows stay, each with its result, but count once in the fit list. All vectors must
have one length, else it fails. Entries past the range of a long after scaling count as its ends. A
component without variance has no whitened value (null), and a deviation of more than 38 digits is
null. A table without rows gives one without rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.session import materialize

#: Rows whose planes are packed at once.
_BLOCK = 1 << 14


def integer_vectors(rows: DataFrame, scale: int, id: str, vector: str) -> DataFrame:
    """``id`` and ``x``, the vector's entries as integers, of the rows that take part."""
    given = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = given.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    # floor ends at the ends of a long
    return usable.select("id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("bigint")).alias("x"))


@dataclass(frozen=True)
class Frame:
    """What one pass over the fit list tells: rows, dimensions, least and greatest entry."""

    n: int
    dims: int
    low: int
    high: int

    @property
    def planes(self) -> int:
        return max(1, (self.high - self.low).bit_length())


def frame_of(fit: DataFrame) -> Frame | None:
    row = fit.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("d"), F.max(F.size("x")).alias("e"),
        F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"),
    ).collect()[0]
    if row.d != row.e:
        raise ValueError(f"vectors of {row.d} and of {row.e} entries cannot be whitened together")
    return Frame(row.n, row.d, row.low, row.high) if row.n else None


def bit_planes(shifted: np.ndarray, planes: int) -> np.ndarray:
    """Words of 64 rows each, by dimension and plane, of non-negative integers (rows by dimensions)."""
    n, dims = shifted.shape
    padded = np.zeros((-(-n // 64) * 64, dims), dtype=np.uint64)
    padded[:n] = shifted
    out = np.empty((dims, planes, len(padded) // 64), dtype=np.uint64)
    for p in range(planes):
        bits = (padded >> np.uint64(p) & np.uint64(1)).astype(np.uint8)
        out[:, p] = np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(np.uint64)
    return out


def weighted_counts(words: np.ndarray) -> np.ndarray:
    """Shared bits of each two dimensions i <= j, by the weight p + q of their planes.

    Places (i, j, s) hold the bits that planes p of i and q of j with p + q = s share, summed.
    """
    dims, planes, _ = words.shape
    out = np.zeros((dims, dims, 2 * planes - 1), dtype=np.int64)
    for i in range(dims):
        for p in range(planes):
            shared = np.bitwise_count(words[i, p] & words[i:]).sum(axis=2, dtype=np.int64)
            out[i, i:, p : p + planes] += shared
    return out


def cross_products(fit: DataFrame, frame: Frame) -> tuple[list[list[int]], list[int]]:
    """Exact sums over the fit list: shifted x_i * x_j, and shifted x_i.

    Of n rows with y = x - low; both as Python integers.
    """
    low, planes, dims = frame.low, frame.planes, frame.dims

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums = np.zeros((dims, dims, 2 * planes - 1), dtype=np.int64), np.zeros((dims, planes), dtype=np.int64)
        for part in frames:
            for at in range(0, len(part), _BLOCK):
                x = np.stack(part["x"].iloc[at : at + _BLOCK].to_numpy())
                # modulo 2 ** 64, where the difference fits
                words = bit_planes(x.view(np.uint64) - np.uint64(low % 2**64), planes)
                total += weighted_counts(words)
                sums += np.bitwise_count(words).sum(axis=2, dtype=np.int64)
        i, j, s = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "s": s, "n": total[i, j, s]})
        i, s = np.nonzero(sums)
        yield pd.DataFrame({"i": i, "j": -1, "s": s, "n": sums[i, s]})

    counted = fit.select("x").mapInPandas(count, "i int, j int, s int, n bigint")
    summed = counted.groupBy("i", "j", "s").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    products, sums = [[0] * dims for _ in range(dims)], [0] * dims
    for r in summed.toLocalIterator():  # dims * dims * 2 planes rows at most
        if r.j < 0:
            sums[r.i] += int(r.n) << r.s
        else:
            products[r.i][r.j] += int(r.n) << r.s
    return products, sums


@dataclass(frozen=True)
class Whitening:
    """Integer sums of the fit list, and its components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.full(len(self.values), np.nan)


def whitening_of(frame: Frame, products: list[list[int]], shifted: list[int], components: int) -> Whitening:
    """Centres the cross-products as integers and takes the leading eigenvectors.

    n * sum(x_i x_j) - S_i S_j is the same for shifted and for unshifted integers.
    """
    n, dims = frame.n, frame.dims
    covariance = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            covariance[i, j] = covariance[j, i] = (n * products[i][j] - shifted[i] * shifted[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    # what is left of the arithmetic's last digits is no variance
    values = np.where(values > dims * np.finfo(float).eps * max(trace, 0.0), values, 0.0)
    sums = tuple(s + n * frame.low for s in shifted)
    return Whitening(n, sums, vectors[:, order], values[order], trace)


def _projected(rows: DataFrame, fitted: Whitening, spread: bool) -> DataFrame:
    """``id``, ``component``, ``whitened`` and ``deviation`` (a decimal) of each row and component.

    With ``spread`` instead the sums of products of whitened values, as ``i``, ``j``, ``s``, a few
    rows for each task.
    """
    n, sums, parts = fitted.n, fitted.sums, len(fitted.values)
    mean = np.array([s / n for s in sums])
    some = fitted.values > 0
    scale = fitted.vectors / np.sqrt(np.where(some, fitted.values, 1.0))

    def whitened(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ scale

    def deviations(x: np.ndarray) -> list[int]:
        most = max(abs(int(x.min())), abs(int(x.max())), 1)
        if len(sums) * (n * most + max(map(abs, sums))) ** 2 < 2**63:
            gaps = n * x - np.array(sums, dtype=np.int64)
            return (gaps * gaps).sum(axis=1).tolist()
        return [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for part in frames:
            if not len(part):
                continue
            x = np.stack(part["x"].to_numpy())
            w = np.where(some, whitened(x), np.nan).ravel()
            yield pd.DataFrame(
                {
                    "id": part["id"].repeat(parts).to_numpy(),
                    "component": np.tile(np.arange(1, parts + 1, dtype=np.int32), len(x)),
                    "deviation": [d for v in deviations(x) for d in [Decimal(v) if v < 10**38 else None] * parts],
                    "whitened": pd.Series([None if np.isnan(v) else float(v) for v in w], dtype="object"),
                }
            )

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((parts, parts))
        for part in frames:
            if len(part):
                w = whitened(np.stack(part["x"].to_numpy()))
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    if spread:
        return rows.select("x").mapInPandas(add_up, "i int, j int, s double")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(project, f"id {kind}, component int, deviation decimal(38,0), whitened double")


def identity_error(fit: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity, measured."""
    sums = _projected(fit, fitted, spread=True).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    some = fitted.values > 0
    gaps = [abs(r.s / fitted.n - (r.i == r.j)) for r in sums if some[r.i] and some[r.j]]
    return max(gaps, default=0.0)


def whitened_embeddings(
    rows: DataFrame, components: int = 4, scale: int = 256, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    A row for each row that takes part and each of the first ``components`` components (all, if
    there are fewer dimensions). ``deviation`` is a decimal of 38 digits.
    """
    spark = rows.sparkSession
    given = integer_vectors(rows, scale, id, vector)
    given = materialize(given, "integer-vectors")
    fit = materialize(given.select("x").distinct(), "fit-list")
    frame = frame_of(fit)
    if frame is None:
        kind = given.schema["id"].dataType.simpleString()
        empty = f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], empty).withColumnRenamed("id", id)
    fitted = whitening_of(frame, *cross_products(fit, frame), components)
    error = identity_error(fit, fitted)
    shares = F.array(*[F.lit(None if np.isnan(e) else float(e)).cast("double") for e in fitted.explained])
    return _projected(given, fitted, spread=False).select(
        F.col("id").alias(id), "component", F.lit(frame.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
