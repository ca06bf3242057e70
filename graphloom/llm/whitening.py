"""Principal components of embeddings by a randomised range finder, and whitened rows.

A basis of ``components + oversample`` random directions is refined by power
passes; each multiplies the covariance with the basis over all centred rows, in
partial sums of a task each that Spark adds up. Rayleigh-Ritz on the basis gives
the components, and the same pass gives their residuals. Where the residuals don't
fall to ``tolerance`` of the gaps between the eigenvalues, as in flat spectra, the
basis is expanded to the full dimension: the covariance itself, a block of its
columns a pass, whose Rayleigh-Ritz step is exact. The driver holds the dimension
times the basis, whatever the number of rows.

Entries are read as ``x = floor(64 * c) + 1000000``. Sums and deviations are exact
integers.

Defined results: a row without a vector, with a null or non-finite entry, or with
one whose ``x`` isn't a 64-bit integer, is left out of fit and result; a vector
shorter than the longest one ends in entries of 0; an empty vector has such entries
alone; repeated rows and ids count as often as they come; a row without id has a
null id; equal eigenvalues have any orthonormal vectors of their space; components
without variance (below 1e-12 of the trace) can't be scaled to 1 and aren't given,
so an empty table, a single row or constant rows give no rows; a deviation beyond
64 bits is null; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read, ship

SCALE, SHIFT = 64, 1_000_000
#: Bytes of a basis or of a block of columns in a task.
BLOCK_BYTES = 64 << 20
#: A component with less of the trace has no variance.
NO_VARIANCE = 1e-12


@dataclass
class Fit:
    """n vectors of one dimension with exact sums ``total``, eigenvalues and unit eigenvectors (columns), and the trace."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    basis: int


def valid_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v of rows whose entries are all finite and have an ``x``."""
    v = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c * SCALE) < float(1 << 62), F.lit(False))))


def whole(vectors: pd.Series, d: int) -> np.ndarray:
    """The ``x`` of a batch of vectors, as a table of 64-bit integers."""
    out = np.full((len(vectors), d), SHIFT, np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(SCALE * np.asarray(v, np.float64)).astype(np.int64) + SHIFT
    return out


def exact(x: np.ndarray) -> np.ndarray:
    """Integers of any size where sums of 64 bits might not do."""
    return x.astype(object) if x.size and max(int(x.max()), -int(x.min())) > 1 << 31 else x


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Rows less the mean: the difference from the mean's integer part is exact."""
    floor = np.array([t // n for t in total], dtype=np.int64)
    rest = np.array([(t % n) / n for t in total])
    return (x - floor).astype(np.float64) - rest


def added(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], d: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``partial`` over all batches: a task adds its own, Spark adds the tasks', the driver gets ``shape`` doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(shape)
        for batch in batches:
            own += partial(whole(batch["v"], d))
        yield pd.DataFrame({"i": np.arange(shape[0]), "row": list(own)})

    parts = rows.select("v").mapInPandas(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).filter("x != 0")
    out = np.zeros(shape)
    found = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out[found["i"].to_numpy(int), found["j"].to_numpy(int)] = found["x"].to_numpy(float)
    return out


def moments(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sums of ``x`` by dimension."""
    d, n = rows.agg(F.max(F.size("v")), F.count("*")).first()
    if not d:
        return n, []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [0] * d
        for batch in batches:
            own = [a + int(b) for a, b in zip(own, exact(whole(batch["v"], d)).sum(axis=0), strict=True)]
        yield pd.DataFrame({"i": np.arange(d), "s": [str(s) for s in own]})

    parts = rows.select("v").mapInPandas(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = {r["i"]: int(r["s"]) for r in parts.collect()}
    return n, [sums[i] for i in range(d)]


def fit(rows: DataFrame, components: int = 32, oversample: int = 10, power_passes: int = 3, tolerance: float = 1e-10, seed: int = 1) -> Fit:
    """Components of all ``rows`` (vec_id, v). ``power_passes`` is how often the basis is refined before it is expanded."""
    ship(rows.sparkSession)
    n, total = moments(rows)
    d, none = len(total), Fit(n, total, np.zeros(0), np.zeros((len(total), 0)), 0.0, 0)
    if not d:
        return none

    def covariance_times(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times the basis, and its trace, in one pass."""

        def partial(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, total)
            return np.vstack([c.T @ (c @ basis), np.full((1, basis.shape[1]), (c * c).sum())])

        out = added(rows, partial, d, (d + 1, basis.shape[1])) / n
        return out[:d], float(out[d, 0])

    width = min(d, components + oversample)
    basis = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for _ in range(power_passes + 1 if width < d else 0):
        image, trace = covariance_times(basis)
        if trace <= 0:
            return none
        values, vectors, residual = ritz(basis, image)
        if settled(values, residual, components, tolerance, trace):
            return Fit(n, total, *leading(values, vectors, components, trace), trace, width)
        basis = np.linalg.qr(image)[0]
    step = max(1, min(d, BLOCK_BYTES // (8 * d)))
    blocks = [covariance_times(np.eye(d)[:, a : a + step]) for a in range(0, d, step)]
    trace = blocks[0][1]
    if trace <= 0:
        return none
    values, vectors, _ = ritz(np.eye(d), np.hstack([b for b, _ in blocks]))
    return Fit(n, total, *leading(values, vectors, components, trace), trace, d)


def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values (falling), vectors and the lengths of their residuals; ``image`` is the covariance times the basis."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def settled(values: np.ndarray, residual: np.ndarray, components: int, tolerance: float, trace: float) -> bool:
    """Whether each wanted component's residual is within ``tolerance`` of the gaps beside it."""
    k = min(components, len(values) - 1)
    gaps = np.minimum(np.diff(-values[: k + 1]), np.append(np.inf, np.diff(-values[:k])))
    wanted = values[:k] > NO_VARIANCE * trace
    return bool(np.all(residual[:k][wanted] <= tolerance * gaps[wanted]))


def leading(values: np.ndarray, vectors: np.ndarray, components: int, trace: float) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.sum(values[:components] > NO_VARIANCE * trace))
    return values[:k], vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)


def projected(x: np.ndarray, model: Fit) -> np.ndarray:
    return centred(x, model.n, model.total) @ (model.vectors / np.sqrt(model.values))


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest entry, without sign, of the whitened rows' covariance less the identity, measured over all rows."""
    k = len(model.values)

    def partial(x: np.ndarray) -> np.ndarray:
        w = projected(x, model)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    out = added(rows, partial, len(model.total), (k + 1, k)) / model.n
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Fit) -> DataFrame:
    """vec_id, deviation, whitened (an entry per component) of all ``rows``."""
    n, total = model.n, model.total
    d = len(total)

    def deviations(x: np.ndarray) -> list[int | None]:
        span = max(abs(n * v - s) for s, low, high in zip(total, x.min(axis=0).tolist(), x.max(axis=0).tolist(), strict=True) for v in (low, high))
        big = n * max(abs(int(x.max())), abs(int(x.min()))) >= 1 << 62 or span * span * d >= 1 << 62
        x = x.astype(object) if big else x
        away = n * x - np.array(total, dtype=object if big else np.int64)
        return [v if v < 1 << 63 else None for v in map(int, (away * away).sum(axis=1))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = whole(batch["v"], d)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": pd.array(deviations(x), "Int64"), "whitened": list(projected(x, model))})

    # ids cross as text: a float would round them where one is null
    out = rows.withColumn("vec_id", F.col("vec_id").cast("string")).mapInPandas(run, "vec_id string, deviation long, whitened array<double>")
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))


def op13_randomised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_rows(read(spark, sf_dir, "embeddings"))
    model = fit(rows)
    k = len(model.values)
    error = identity_error(rows, model) if k else 0.0
    ship(spark)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if k else F.array().cast("array<double>")
    out = whiten(rows, model) if k else rows.limit(0).select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
