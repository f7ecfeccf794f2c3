"""Whitening of embeddings by a Chebyshev-filtered subspace iteration.

The vectors become whole numbers x and are written once, in blocks. The leading eigenvectors of their covariance V
come from products of V with a narrow matrix Q: each task adds up ``(x - mean)ᵀ ((x - mean) Q)`` of its blocks, the
sums of all tasks are added by place, and only that narrow result reaches the driver. A polynomial of V, evaluated by
the Chebyshev recurrence with one such pass per degree, damps the part of the spectrum below the block and lifts the
wanted one; QR and Rayleigh-Ritz then turn the block to eigenvectors. This is repeated until the residuals of the
wanted vectors certify them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

# Fixed by the contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
MOST = 2.0**40  # larger numbers are held here, so that sums stay exact
BLOCK_BYTES = 1_000_000
LONG = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """``components`` are wanted; the block has ``extra`` more columns. Residuals are certified below ``tolerance``
    times the largest eigenvalue; eigenvalues below ``least`` times it are rounding, and have no component."""

    components: int = 8
    extra: int = 24
    degree: int = 12
    tolerance: float = 1e-13
    least: float = 1e-12
    rounds: int = 12
    seed: int = 17


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length: exact sums S, eigenvectors as columns, eigenvalues and the trace of V."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whole(self) -> np.ndarray:
        """The mean rounded down, and ..."""
        return np.array([s // self.n for s in self.sums], np.int64)

    def part(self) -> np.ndarray:
        """... what is left of it: S = n * whole + n * part."""
        return np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole()) - self.part()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """``sum((n * x - S)²)`` of each row, exact; None beyond a long."""
        near = x - self.whole()
        rest = np.array([s % self.n for s in self.sums], object)
        top = int(np.abs(near).max(initial=0))
        if top * max(top, self.n) * x.shape[1] < 2**62:
            squares, products = (near * near).sum(axis=1).tolist(), (near @ rest.astype(np.int64)).tolist()
        else:
            exact = near.astype(object)
            squares, products = (exact * exact).sum(axis=1).tolist(), (exact @ rest).tolist()
        n, own = self.n, sum(int(r) ** 2 for r in rest)
        totals = (n * n * a - 2 * n * b + own for a, b in zip(squares, products, strict=True))
        return [t if t <= LONG else None for t in totals]


def usable() -> Column:
    """A vector without null and non-finite entries."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors in a batch: the length, the rows that have it, and their whole numbers x."""
    lists = batch.column("embedding")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(bounds)
    for dim in np.unique(sizes).tolist():
        if dim:
            rows = np.flatnonzero(sizes == dim)
            x = values[bounds[rows][:, None] + np.arange(dim)]
            yield dim, rows, np.clip(np.floor(SCALE * x), -MOST, MOST).astype(np.int64) + SHIFT


def blocks(rows: DataFrame) -> DataFrame:
    """``dim, rows, data``: the whole numbers of many vectors as 32-bit numbers, or 64-bit ones where these are too short."""

    def run(batches):
        for batch in batches:
            for dim, _, x in by_length(batch):
                step = max(1, BLOCK_BYTES // (8 * dim))
                parts = [x[at : at + step] for at in range(0, len(x), step)]
                short = [part.astype(np.int32) if np.abs(part).max() < 2**31 else part for part in parts]
                columns = [
                    pa.array([dim] * len(parts), pa.int32()),
                    pa.array([len(part) for part in parts], pa.int64()),
                    pa.array([part.tobytes() for part in short], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "rows", "data"])

    return rows.select("embedding").mapInArrow(run, "dim int, rows long, data binary")


def arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for dim, rows, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "rows", "data")), strict=True):
        yield np.frombuffer(data, np.int32 if len(data) == 4 * dim * rows else np.int64).reshape(rows, dim).astype(np.int64)


def added(parts: DataFrame, size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``work(x)``, ``size`` numbers: summed per task, then by place over all tasks."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for x in arrays(batch):
                total += work(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "value"])

    rows = parts.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(size)
    for row in rows:
        total[row["place"]] = row["value"]
    return total


def exact_sums(parts: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """For each length of vectors: how many there are, and the exact sum of each place."""

    def run(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            for x in arrays(batch):
                own = totals.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                own[0] += len(x)
                own[1] += x.sum(axis=0)
        for dim, (n, sums) in totals.items():
            columns = [pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(-1, dim), pa.int32()), pa.array([n, *sums.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "place", "value"])

    found = parts.mapInArrow(run, "dim int, place int, value long").groupBy("dim", "place")
    found = found.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    totals = {(row["dim"], row["place"]): int(row["value"]) for row in found}
    dims = sorted({dim for dim, _ in totals})
    return {dim: (totals[dim, -1], tuple(totals[dim, j] for j in range(dim))) for dim in dims}


def fitted(parts: DataFrame, n: int, sums: tuple[int, ...], how: Whitening) -> Fit:
    """The leading eigenvectors of the covariance (divisor n) of the vectors in blocks of one length, certified."""
    dim = len(sums)
    centre = Fit(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0).centred

    def spread(x: np.ndarray) -> np.ndarray:
        return np.array([np.square(centre(x)).sum()])

    def times(q: np.ndarray) -> np.ndarray:
        """V times q: one pass over the vectors."""

        def work(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return (c.T @ (c @ q)).ravel()

        return added(parts, q.size, work).reshape(q.shape) / n

    trace = float(added(parts, 1, spread)[0]) / n
    width = min(dim, how.components + how.extra)
    draw = np.random.default_rng(how.seed)
    q = np.linalg.qr(draw.normal(size=(dim, width)))[0]
    wanted = min(dim, how.components)
    before = np.inf
    for number in range(1, 10**6):
        image = times(q)
        values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(values[0], 0.0)
        real = values[:wanted] > how.least * top
        errors = np.linalg.norm(image - q * values, axis=0)[:wanted][real]
        worst = float(errors.max(initial=0.0))
        stuck = worst > before / 2 and worst <= 100 * how.tolerance * top  # as far as rounding lets it go
        if width == dim or top == 0 or worst <= how.tolerance * top or stuck:
            break
        before = worst
        if number % how.rounds == 0:  # a crowd of equal eigenvalues at the edge of the block: a wider one
            more = draw.normal(size=(dim, min(dim, 2 * width) - width))
            q = np.linalg.qr(np.hstack([q, more]))[0]
            width, before = q.shape[1], np.inf
            continue
        q = np.linalg.qr(filtered(times, q, image, float(values[-1]), top, how.degree))[0]
    vectors = q[:, :wanted][:, real]
    return Fit(n, sums, vectors, values[:wanted][real], trace)


def filtered(
    times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, image: np.ndarray, edge: float, top: float, degree: int
) -> np.ndarray:
    """A Chebyshev polynomial of V times q: small on the spectrum from 0 to ``edge``, 1 at ``top``.

    ``image`` is V times q, known from before. The degree is less where the polynomial would lift the largest
    eigenvalue so far that the other columns lose their digits.
    """
    half = edge / 2
    if half <= 1e-14 * top:  # nothing below the block
        return image
    most = int(np.log(1e7) / np.arccosh(max((top - half) / half, 1.0 + 1e-6)))
    scale = half / (top - half)
    before, now = q, (image - half * q) * (scale / half)
    factor = scale
    for _ in range(1, max(1, min(degree, most))):
        following = 1 / (2 / scale - factor)
        before, now = now, 2 * (following / half) * (times(now) - half * now) - factor * following * before
        factor = following
    return now


def audited(parts: DataFrame, fit: Fit) -> Fit:
    """The fit with its identity error: the covariance of the whitened vectors minus the identity, largest entry."""
    k = len(fit.values)
    if not k:
        return fit
    mean = added(parts, k, lambda x: fit.whitened(x).sum(axis=0)) / fit.n

    def products(x: np.ndarray) -> np.ndarray:
        z = fit.whitened(x) - mean
        return (z.T @ z).ravel()

    covariance = added(parts, k * k, products).reshape(k, k) / fit.n
    error = float(np.abs(covariance - np.eye(k)).max())
    return Fit(fit.n, fit.sums, fit.vectors, fit.values, fit.trace, error)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, how: Whitening = Whitening()) -> DataFrame:
    """Up to ``how.components`` rows per vector: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null or holds null or non-finite entries are dropped; null and repeated ids and repeated
    rows stay, each as a vector of its own. Entries become whole numbers ``floor(1024 * c) + 100000``, held at
    2^40 either way. Vectors of different lengths are fitted apart, those without entries have no components. Equal
    eigenvalues may come in any basis of theirs; where the vectors span fewer directions than wanted, there are only
    that many components. ``deviation`` is exact, and null where it is larger than a long. An empty table gives no
    rows; other columns are not read.
    """
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable())
    parts = stored(blocks(good), "blocks")
    fits = {}
    for dim, (n, sums) in exact_sums(parts).items():
        own = parts.where(F.col("dim") == dim)
        fits[dim] = audited(own, fitted(own, n, sums, how))

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for dim, places, x in by_length(batch):
                fit = fits[dim]
                k = len(fit.values)
                many = len(places) * k
                repeated = np.repeat(places, k)
                deviations = [d for d in fit.deviations(x) for _ in range(k)]
                columns = [
                    ids.take(pa.array(repeated)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))),
                    pa.array(np.full(many, fit.n, np.int64)),
                    pa.array(deviations, pa.int64()),
                    pa.array(fit.whitened(x).ravel()),
                    pa.array(np.tile(fit.values / fit.trace if fit.trace else fit.values, len(places))),
                    pa.array(np.full(many, fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in SCHEMA.split(", ")])

    return good.mapInArrow(run, SCHEMA)
