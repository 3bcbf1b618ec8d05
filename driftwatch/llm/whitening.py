"""Embedding whitening: principal components by QDWH spectral divide and conquer, then one broadcast projection.

Count, sums and the centred covariance are sums over the tasks. The covariance of ``d`` dimensions is a ``d x d`` matrix
whatever the number of vectors; its invariant subspaces are split by spectral projectors: the polar factor U of the
covariance shifted by s has eigenvalue 1 where the covariance lies above s and -1 below, so (U + I) / 2 projects on the
upper subspace. U comes from the dynamically weighted Halley iteration (QDWH) with QR factors only. Each subspace is split
again until it holds one direction, or until its part of the covariance is a multiple of the identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.common import give_back, store

_EPS = np.finfo(np.float64).eps
_LONG = (1 << 63) - 1
#: Dimensions up to which the covariance may come to the driver (8 * d * d bytes).
MAX_DIMENSIONS = 2048


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by the QDWH iteration; null directions stay near 0."""
    n = len(a)
    size = np.linalg.norm(a)
    if not size:
        return np.zeros_like(a)
    x, least = a / size, _EPS  # a lower bound of the singular values; smaller ones count as null
    for _ in range(30):
        square = least * least
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        step = np.linalg.norm(new - x)
        x, least = new, min(1.0, least * (wa + wb * square) / (1 + wc * square))
        if step <= np.cbrt(5 * _EPS) and 1 - least <= 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces above and below a shift; None if no shift parts the matrix beyond ``noise``."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.eye(n) * diagonal.mean())
    if n == 1 or spread <= noise:
        return None
    rng = np.random.default_rng(n)
    shifts = [np.median(diagonal), diagonal.mean(), *(diagonal.mean() + spread / np.sqrt(n) * np.linspace(-1, 1, 12)[rng.permutation(12)])]
    for shift in shifts:
        u = polar_factor(a - shift * np.eye(n))
        projector = (u + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        start = rng.standard_normal((n, k))
        for _ in range(3):
            start, _ = np.linalg.qr(projector @ start)
        basis, _ = np.linalg.qr(start, mode="complete")
        above, below = basis[:, :k], basis[:, k:]
        if np.linalg.norm(below.T @ a @ above) <= noise:
            return above, below
    return None


def principal_components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    The sign of a vector makes its largest entry (the first of equal ones) positive. Equal eigenvalues have any
    orthonormal basis of their space.
    """
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    a = (a + a.T) / 2
    noise = 64 * len(a) * _EPS * max(np.linalg.norm(a), np.finfo(float).tiny)
    found: list[np.ndarray] = []
    spaces = [np.eye(len(a))]
    # the upper space is always split first, so the spaces on the stack fall from its top
    while spaces and sum(v.shape[1] for v in found) < most:
        basis = spaces.pop()
        part = basis.T @ a @ basis
        cut = _split((part + part.T) / 2, noise)
        if cut is None:
            found.append(basis)
        else:
            spaces += [basis @ cut[1], basis @ cut[0]]
    vectors, _ = np.linalg.qr(np.hstack(found))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:most]
    vectors, values = vectors[:, order], values[order]
    signs = np.sign(vectors[np.argmax(np.round(np.abs(vectors), 12), axis=0), np.arange(len(order))])
    return values, vectors * np.where(signs == 0, 1, signs)


def _matrix(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    column = batch.column(batch.schema.names.index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(column), -1)


def _sums(rows: DataFrame, d: int, make, per_row: int) -> np.ndarray:
    """Sum over all tasks of the arrays of doubles (``per_row`` rows of ``d``) that ``make(batch)`` gives; ``d * per_row`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total = part if total is None else total + part
        if total is not None:
            for k in range(per_row):
                yield pa.RecordBatch.from_pydict({"i": pa.array([k], pa.int32()), "v": pa.array([total[k].tolist()], pa.list_(pa.float64()))})
        give_back()

    parts = rows.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((per_row, d))
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = row["v"]
    return out


def usable(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``(id, v)``: the usable vectors as doubles.

    Left out are null vectors, empty ones, those with null or non-finite entries or with entries that, scaled, reach 2**53
    (beyond it a double is no exact whole number).
    """
    limit = float(1 << 53)
    good = F.forall("v", lambda c: c.isNotNull() & (F.abs(c * scale) < limit))  # NaN is above every number
    rows = df.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & good)


def whiten(rows: DataFrame, components: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> tuple[DataFrame, dict]:
    """Whitened vectors of ``rows(id, v array<double>)`` (see ``usable``), and the model.

    Each entry c is taken as the whole number x = floor(scale * c) + offset, so counts and sums are exact.

    The frame has ``id``, ``deviation`` (sum over dimensions of (n * x - S)**2, S the sums; null where it passes a long)
    and ``whitened`` (array of double, a component each). The model has ``n``, ``sums``, ``values`` (eigenvalues of the
    covariance, falling), ``vectors``, ``trace`` and ``identity_error``, the largest entry by which the covariance of
    ``whitened``, measured over all rows, differs from the identity.

    All vectors must be of one length: those of the most frequent length (ties: the longest) are used, others left out.
    Directions without variance (within rounding) have no component, so there may be fewer than ``components``; a single
    vector, or equal ones, have none. Repeated rows and null ids stay and count. An empty table gives no rows and a model
    without components. More than ``MAX_DIMENSIONS`` dimensions raise an error.
    """
    if components < 1:
        raise ValueError("components must be positive")
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions are more than {MAX_DIMENSIONS}")
    rows = rows.filter(F.size("v") == d)
    n = sizes[0]["count"] if sizes else 0

    def whole_numbers(batch: pa.RecordBatch) -> np.ndarray:
        return np.floor(scale * _matrix(batch, "v", np.float64)).astype(np.int64) + offset

    def halves(batches: Iterator[pa.RecordBatch]):
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(d), pa.int32()), "high": high, "low": low})

    # exact sums: a total of longs may pass a long, so halves are summed as decimals
    sums = [0] * d
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    for row in rows.select("v").mapInArrow(halves, "j int, high long, low long").groupBy("j").agg(wide("high").alias("high"), wide("low").alias("low")).collect():
        sums[row["j"]] = (int(row["high"]) << 32) + int(row["low"])
    whole = np.array([s // n for s in sums], np.int64) if n else np.zeros(0, np.int64)
    left = [s - int(w) * n for s, w in zip(sums, whole)]
    part = np.array([r / n for r in left]) if n else np.zeros(0)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (whole_numbers(batch) - whole).astype(np.float64) - part

    covariance = _sums(rows, d, lambda batch: (y := centred(batch)).T @ y, d) / max(n, 1)
    values, vectors = principal_components(covariance, min(components, d))
    alive = values > 64 * max(d, 1) * _EPS * (values.max() if len(values) else 0)
    values, vectors = values[alive], vectors[:, alive]
    project = spark.sparkContext.broadcast(vectors / np.sqrt(values))
    exact_left = np.array(left, object)
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            off = whole_numbers(batch) - whole
            if (int(np.abs(off).max()) * n + n) ** 2 * d <= _LONG:
                deviation = ((n * off - exact_left.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [v if v <= _LONG else None for v in ((n * off.astype(object) - exact_left) ** 2).sum(axis=1)]
            z = (off.astype(np.float64) - part) @ project.value
            offsets = pa.array(np.arange(0, z.size + 1, max(z.shape[1], 1)) if z.shape[1] else np.zeros(len(z) + 1), pa.int32())
            white = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), white], names=["id", "deviation", "whitened"])

    made = store(rows.select("id", "v").mapInArrow(run, schema), "whitened")
    k = len(values)
    error = 0.0
    if k:
        means = _sums(made, k, lambda batch: _matrix(batch, "whitened", np.float64).sum(axis=0, keepdims=True), 1) / n
        spread = _sums(made, k, lambda batch: (z := _matrix(batch, "whitened", np.float64) - means).T @ z, k) / n
        error = float(np.abs(spread - np.eye(k)).max())
    model = {"n": n, "sums": sums, "values": values, "vectors": vectors, "trace": float(np.trace(covariance)), "identity_error": error}
    return made, model


def whitened_rows(rows: DataFrame, components: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    See ``whiten``; ``explained`` is the component's share of the whole variance.
    """
    made, model = whiten(rows, components, scale, offset)
    shares = F.array(*[F.lit(float(v / model["trace"])) for v in model["values"]]).cast("array<double>")
    out = made.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        "id", (F.col("k") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"),
        F.lit(model["identity_error"]).alias("identity_error"),
    )
