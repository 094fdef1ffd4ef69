"""Operator 11, embedding whitening by digit-slice products.

Every entry c becomes the integer floor(64 * c) + OFFSET. The fit list, each
distinct integer vector once, is written; its sums are exact. For the covariance
each entry less its rounded mean is cut into signed digits of DIGIT bits, taken
from the bits of both without a subtraction that could overflow. A product of two
digit matrices of at most BLOCK rows stays below 2**53, so float64 BLAS gives it
exactly; products of one weight are added as 64-bit integers, and rows of the
Gram matrix leave a task as such sums, to be recombined as Python integers and
merged exactly where all parts of that row meet. The covariance is a quotient of
two integers, rounded once. One task a length decomposes it; the whitened vectors
of the whole fit list are summed once more for the audit `identity_error`.

Nothing but sums, models (COMPONENTS vectors a length) and one covariance a
length, in its task, is held whole: their size follows the length of a vector and
not the number of rows. Models go to the tasks in lots of MODEL_BYTES, so that
vectors of many lengths only mean more passes.

Defined results: a null vector, and one with a null or non-finite entry, is
dropped; an entry beyond the 64-bit range takes its end. Vectors of each length
are a fit of their own, with their own n; an empty vector has no components and
gives no row. Repeated vectors count once in the fit, and each row is returned; a
null vec_id is returned as such. `deviation` is null where it exceeds a long and
`deviation_exact` has it as text always. A component without variance (its
eigenvalue is within rounding of zero, as with a single distinct vector) is
returned with whitened 0.0, and the audit leaves it out. Extra columns are
ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
DIGIT = 16
#: Rows of one product: BLOCK * 2**(2 * DIGIT) is below 2**53.
BLOCK = 1 << 14
#: Products of one weight that a 64-bit sum takes: each is below 2**46, and four pairs of digits share a weight.
SUMS = 1 << 14
MODEL_BYTES = 64 << 20
_DIGITS = 64 // DIGIT
_MASK = np.int64((1 << DIGIT) - 1)

PACKED = "vec_id long, dim int, x binary"
PARTS = "dim int, row int, weight int, part binary"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, deviation_exact string"


def integers(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET, at the end of the 64-bit range where it lies beyond."""
    with np.errstate(over="ignore"):
        f = np.floor(SCALE * c)
    wide = np.abs(f) >= 2.0**62
    x = np.where(wide, 0, f).astype(np.int64) + OFFSET
    for k in np.flatnonzero(wide.ravel()).tolist():
        v = f.ravel()[k]
        x.ravel()[k] = max(-(1 << 63), min((1 << 63) - 1, int(v) + OFFSET)) if np.isfinite(v) else (-(1 << 63) if v < 0 else (1 << 63) - 1)
    return x


def pack(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry, told by the first byte: one form for each vector."""
    y = x - np.int64(OFFSET)  # wraps like the addition that undoes it
    span = np.maximum(y.max(axis=1), ~y.min(axis=1))
    out: list[bytes] = [b""] * len(x)
    width = np.select([span < 1 << 7, span < 1 << 15, span < 1 << 31], [1, 2, 4], 8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        raw = y[rows].astype(f"<i{w}").tobytes()
        size = w * x.shape[1]
        for i, r in enumerate(rows.tolist()):
            out[r] = bytes([w]) + raw[i * size : (i + 1) * size]
    return out


def unpack(rows: list[bytes]) -> np.ndarray:
    """The integer vectors, all of one length."""
    by: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(r[0], []).append(i)
    out = None
    for w, at in by.items():
        part = np.frombuffer(b"".join(rows[i][1:] for i in at), f"<i{w}").reshape(len(at), -1).astype(np.int64) + np.int64(OFFSET)
        if out is None:
            out = np.empty((len(rows), part.shape[1]), np.int64)
        out[at] = part
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, dims, rows = [], [], []
        column = b.column(1)
        sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == d)
            c = np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), d)
            good = np.isfinite(c).all(axis=1)
            at, c = at[good], c[good]
            if len(at):
                ids += b.column(0).take(pa.array(at)).to_pylist()
                dims += [d] * len(at)
                rows += pack(integers(c))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(rows, pa.binary())], names=["vec_id", "dim", "x"])


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, x) of every vector that can be whitened, x as `pack` writes it."""
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_pack, PACKED)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, x: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, integer vectors) of at most BLOCK rows, and the batch before them."""
    for b in batches:
        dims = b.column(dim).to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            for i in range(0, len(at), BLOCK):
                own = at[i : i + BLOCK]
                yield int(d), (b, own), unpack(b.column(x).take(pa.array(own)).to_pylist())


def digits(x: np.ndarray, mean: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, matrix) of the digits of x - mean that aren't all zero: x - mean is the sum of matrix * 2**weight."""
    out = []
    for k in range(_DIGITS):
        a, m = x >> np.int64(DIGIT * k), mean >> np.int64(DIGIT * k)
        d = a - m if k == _DIGITS - 1 else (a & _MASK) - (m & _MASK)
        if d.any():
            out.append((DIGIT * k, d.astype(np.float64)))
    return out




def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By length, in digits whose 64-bit sums can't overflow: the sum of the entries' high and low halves, and the number of rows."""
    low = np.int64((1 << 32) - 1)
    held: dict[int, list] = {}
    for d, _, x in _blocks(batches, 0, 1):
        n, hi, lo = held.get(d, (0, 0, 0))
        held[d] = [n + len(x), hi + (x >> np.int64(32)).sum(axis=0), lo + (x & low).sum(axis=0)]
    for d, (n, hi, lo) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["dim", "at", "n", "hi", "lo"])


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: the number of distinct vectors and the exact sum of each entry."""
    rows = fit.select("dim", "x").mapInArrow(_sum, "dim int, at int, n long, hi long, lo long")
    wide = "decimal(38,0)"
    got = rows.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("hi").cast(wide)).alias("hi"), F.sum(F.col("lo").cast(wide)).alias("lo")).orderBy("dim", "at").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in got:
        out.setdefault(r.dim, (r.n, []))[1].append((int(r.hi) << 32) + int(r.lo))
    return out


def _gram(means: dict[int, np.ndarray]):
    def rows(d: int, total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for w, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([w] * d, pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["dim", "row", "weight", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, dict[int, np.ndarray]]] = {}
        for d, _, x in _blocks(batches, 0, 1):
            times, total = held.get(d, (0, {}))
            if times == SUMS:
                yield from rows(d, total)
                times, total = 0, {}
            cut = digits(x, means[d])
            for i, (w, a) in enumerate(cut):
                for v, b in cut[i:]:
                    p = (a.T @ b).astype(np.int64)  # exact: below 2**53
                    total[w + v] = total.get(w + v, 0) + (p if w == v else p + p.T)
            held[d] = times + 1, total
        for d, (_, total) in held.items():
            yield from rows(d, total or {0: np.zeros((d, d), np.int64)})

    return run


def _merge(stats: dict[int, tuple[int, list[int]]], means: dict[int, np.ndarray]):
    """Rows of the Gram matrix, part by part, into rows of the covariance: (n * gram - rest * rest) / n**2 of centred entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def close() -> pa.RecordBatch:
            d, i = key
            n, s = stats[d]
            rest = [a - n * m for a, m in zip(s, means[d].tolist())]
            row = np.array([(n * int(g) - rest[i] * z) / (n * n) for g, z in zip(total, rest)])
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tobytes()], pa.binary())], names=["dim", "row", "v"])

        for b in batches:
            for d, i, w, part in zip(*(c.to_pylist() for c in b.columns)):
                if (d, i) != key:
                    if key is not None:
                        yield close()
                    key, total = (d, i), np.zeros(d, object)
                total += np.frombuffer(part, np.int64).astype(object) * (1 << w)
        if key is not None:
            yield close()

    return run


def _decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of covariances, length after length, into models."""
    key, rows = None, []

    def close() -> pa.RecordBatch:
        v = np.zeros((key, key))
        for i, r in rows:
            v[i] = r
        e, q = np.linalg.eigh((v + v.T) / 2)
        e, q = e[::-1][:COMPONENTS], q[:, ::-1][:, :COMPONENTS]
        real = e > max(float(e[0]), 0.0) * key * np.finfo(float).eps
        trace = float(np.trace(v))
        scaled = np.where(real, q / np.sqrt(np.where(real, e, 1.0)), 0.0)
        explained = np.where(real, e, 0.0) / (trace or 1.0)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([scaled.tobytes()], pa.binary()), pa.array([explained.tobytes()], pa.binary())], names=["dim", "scaled", "explained"])

    for b in batches:
        for d, i, v in zip(*(c.to_pylist() for c in b.columns)):
            if d != key:
                if key is not None:
                    yield close()
                key, rows = d, []
            rows.append((i, np.frombuffer(v)))
    if key is not None:
        yield close()


class Model:
    """What whitens the vectors of one length."""

    def __init__(self, dim: int, n: int, total: list[int], scaled: bytes, explained: bytes) -> None:
        self.n = n
        self.mean = np.array([s // n for s in total], np.int64)
        #: What the sums hold beyond n times the rounded mean, and that by n.
        self.rest = [s - n * m for s, m in zip(total, self.mean.tolist())]
        self.shift = np.array([r / n for r in self.rest])
        self.scaled, self.explained = np.frombuffer(scaled).reshape(dim, -1), np.frombuffer(explained)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        z = np.zeros(x.shape)
        for w, d in reversed(digits(x, self.mean)):
            z += d * 2.0**w
        return (z - self.shift) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S)**2, exact: of whole vectors of small integers by three sums, else entry by entry."""
        n, rest = self.n, self.rest
        top = int(np.abs(x.astype(float) - self.mean.astype(float)).max(initial=0)) + 1
        if len(rest) * top * max(top, n) < 1 << 62:
            z = x - self.mean
            two, one = (z * z).sum(axis=1).tolist(), (z @ np.array(rest, np.int64)).tolist()
            zero = sum(r * r for r in rest)
            return [n * n * a - 2 * n * b + zero for a, b in zip(two, one)]
        means = self.mean.tolist()
        return [sum((n * (a - m) - r) ** 2 for a, m, r in zip(row, means, rest)) for row in x.tolist()]


def fit_models(fit: DataFrame) -> tuple[list[tuple[int, bytes, bytes]], dict[int, tuple[int, list[int]]]]:
    """((length, vectors over roots of eigenvalues, shares of the trace) of each length, its n and sums) of a written fit list (dim, x)."""
    stats = sums(fit)
    means = {d: np.array([a // n for a in s], np.int64) for d, (n, s) in stats.items()}
    parts = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gram = fit.select("dim", "x").mapInArrow(_gram(means), PARTS)
    # parts of one row meet, not those of a length: tasks * length numbers in a stream
    rows = gram.repartition(parts, "dim", "row").sortWithinPartitions("dim", "row").mapInArrow(_merge(stats, means), "dim int, row int, v binary")
    models = rows.repartition("dim").sortWithinPartitions("dim").mapInArrow(_decompose, "dim int, scaled binary, explained binary").collect()
    return [(r.dim, bytes(r.scaled), bytes(r.explained)) for r in models], stats


def _lots(models: list[tuple[int, bytes, bytes]], stats: dict[int, tuple[int, list[int]]]) -> Iterator[dict[int, Model]]:
    lot, held = {}, 0
    for d, scaled, explained in sorted(models):
        if lot and held + 2 * len(scaled) > MODEL_BYTES:
            yield lot
            lot, held = {}, 0
        lot[d] = Model(d, *stats[d], scaled, explained)
        held += 2 * len(scaled)
    if lot:
        yield lot


def _audit(lot: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for d, _, x in _blocks(batches, 0, 1):
            y = lot[d].whiten(x)
            one, two = held.get(d, (0, 0))
            held[d] = [one + y.sum(axis=0), two + y.T @ y]
        for d, (one, two) in held.items():
            k = len(one)
            both = np.vstack([one, two])
            yield pa.RecordBatch.from_arrays([pa.array([d] * both.size, pa.int32()), pa.array(np.repeat(np.arange(k + 1), k), pa.int32()), pa.array(np.tile(np.arange(k), k + 1), pa.int32()), pa.array(both.ravel())], names=["dim", "i", "j", "s"])

    return run


def identity_error(fit: DataFrame, lots: list[dict[int, Model]]) -> float:
    """The largest entry, in absolute value, of the whitened fit list's covariance minus the identity."""
    worst = 0.0
    for lot in lots:
        rows = fit.where(F.col("dim").isin(list(lot))).select("dim", "x").mapInArrow(_audit(lot), "dim int, i int, j int, s double")
        got: dict[int, dict[tuple[int, int], float]] = {}
        for r in rows.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():
            got.setdefault(r.dim, {})[r.i, r.j] = r.s / lot[r.dim].n
        for d, m in got.items():
            real = np.flatnonzero(lot[d].explained > 0).tolist()
            for i in real:
                for j in real:
                    worst = max(worst, abs(m[i + 1, j] - m[0, i] * m[0, j] - (i == j)))
    return worst


def _whiten(lot: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, (b, at), x in _blocks(batches, 1, 2):
            m = lot[d]
            y, exact = m.whiten(x), m.deviations(x)
            k = y.shape[1]
            again = np.repeat(at, k)
            short = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            rows = pa.array(np.repeat(np.arange(len(at)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(k * len(at), m.n)), short.take(rows), pa.array(y.ravel()), pa.array(np.tile(m.explained, len(at))), pa.array([str(v) for v in exact]).take(rows)],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "deviation_exact"],
            )

    return run


def whiten(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> a row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    spark = vectors.sparkSession
    with scratch(spark):
        fit = written(packed(vectors).select("dim", "x").distinct(), "fit")
        models, stats = fit_models(fit)
        lots = list(_lots(models, stats))
        error = identity_error(fit, lots)
    rows = packed(vectors)
    out = None
    for lot in lots:
        own = (rows if len(lots) == 1 else rows.where(F.col("dim").isin(list(lot)))).mapInArrow(_whiten(lot), RESULT)
        out = own if out is None else out.union(own)
    if out is None:
        out = spark.createDataFrame([], RESULT)
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", F.lit(error).alias("identity_error"), "deviation_exact")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every vector of the table."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
