"""Whitening of embeddings by a one-sided Jacobi SVD of their centred rows.

1. Entries become whole numbers, floor(256 c); distinct vectors are the fit list.  Their number and sums are exact.
2. Blockwise TSQR: a task folds its centred rows, a block at a time, into the triangular factor R of a QR decomposition; the
   factors' rows are dealt to ever fewer tasks and folded in the same way, until there is one of them.  It has a row and a column a dimension, whatever
   the number of vectors, and the same right singular vectors and singular values as all centred rows.
3. Plane rotations make R's columns orthogonal (``jacobi``).  The rotations, accumulated, are the components; the columns' lengths over
   the root of n are standard deviations, each accurate relative to its own size, which a covariance matrix would not give.
4. Rows are projected on the components and divided by the standard deviations.

What comes to the driver are the sums, a few components and standard deviations: numbers in proportion to the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import Workspace, bound_batches, give_back

SCALE = 256
#: Rows of a block, and factors that a task folds into one after the first round.
BLOCK, FAN = 4096, 16
#: Standard deviations below DEAD times the largest are none; sweeps end at SWEEPS at the latest, a few are the rule.
DEAD, SWEEPS = 1e-12, 60


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists without nulls as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def folded(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """The triangular factor of all blocks' rows; None without rows."""
    r = None
    for block in blocks:
        for lo in range(0, len(block), BLOCK):
            some = block[lo : lo + BLOCK]
            r = np.linalg.qr(some if r is None else np.concatenate([r, some]), mode="r")
    return r


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, singular values), largest first, of a matrix with as many columns as dimensions.

    A sweep meets each pair of columns once, in rounds of pairs without a common column, as in a tournament, so that a round is one array operation; sweeps end
    when all columns are orthogonal.
    """
    d = r.shape[1]
    least = np.finfo(np.float64).eps * np.sqrt(d)  # a smaller cosine of two columns' angle is rounding
    a, v = np.array(r, np.float64), np.eye(d)
    # QR with the longest column first makes the columns nearly orthogonal from the start, and keeps small ones accurate
    order = np.argsort(-np.linalg.norm(a, axis=0), kind="stable")
    a, v = np.linalg.qr(a[:, order], mode="r"), v[:, order]
    ring = list(range(d + d % 2))  # a column that isn't there pairs with one that rests
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(x, y) for x, y in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1], strict=True) if max(x, y) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            i, j = np.sort(np.array(pairs), axis=1).T
            p, q = a[:, i], a[:, j]
            alpha, beta, gamma = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            some = np.abs(gamma) > least * np.sqrt(alpha) * np.sqrt(beta)
            if not some.any():
                continue
            turned = True
            i, j, alpha, beta, gamma = i[some], j[some], alpha[some], beta[some], gamma[some]
            zeta = (beta - alpha) / (2 * gamma)
            with np.errstate(over="ignore"):
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                p, q = m[:, i], m[:, j]
                m[:, i], m[:, j] = c * p - s * q, s * p + c * q
        if not turned:
            break
    sizes = np.linalg.norm(a, axis=0)
    order = np.argsort(-sizes, kind="stable")
    return v[:, order].T, sizes[order]


def whole_numbers(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is there and has only finite entries; x is floor(scale * entry).

    Vectors of no entries are left out, and so are those with another number of entries than most have (of equally frequent numbers, the largest).
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.where(v.isNotNull() & (F.size(v) > 0) & fine)
    widths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    d = (widths.first() or [0])[0]
    return rows.where(F.size(vector) == d).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def exact_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """(n, sums by dimension) of x; sums beyond 64 bits are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                if float(np.abs(x.astype(np.float64)).max()) * len(x) >= 2.0**62:
                    raise OverflowError("entries are too large for exact sums")
                n, part = n + len(x), x.sum(axis=0).astype(object)
                total = part if total is None else total + part
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([[int(t) for t in total]], pa.list_(pa.int64()))], ["n", "sums"])

    parts = fit.select("x").mapInArrow(run, "n long, sums array<long>").select("n", F.posexplode("sums").alias("k", "s"))
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # a row a dimension
    rows.sort(key=lambda r: r.k)
    return (rows[0].n if rows else 0), np.array([r.s for r in rows], np.int64)


def scaled_off(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - sums, exact; beyond 64 bits an error."""
    if float(np.abs(x.astype(np.float64)).max(initial=0)) * n + float(np.abs(sums.astype(np.float64)).max(initial=0)) >= 2.0**62:
        raise OverflowError("entries are too large for exact deviations")
    return n * x - sums


def triangle(work: Workspace, fit: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """(row array<double>): R of the centred rows, at most a row a dimension."""
    d = len(sums)

    def fold(centre: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = (matrix(b.column(0)) for b in batches if b.num_rows)
            r = folded(scaled_off(x, n, sums) / n if centre else x for x in own)
            if r is not None:
                yield pa.record_batch([pa.array(list(r), pa.list_(pa.float64()))], ["row"])
            give_back()

        return run

    rows, k = work.settle(fit.select("x").mapInArrow(fold(True), "row array<double>"), "r0"), 0
    while (held := rows.count()) > d or k == 0:
        k += 1
        rows = work.settle(rows.repartition(-(-held // (FAN * d))).mapInArrow(fold(False), "row array<double>"), f"r{k}")
        work.drop(f"r{k - 1}")
    return rows


def components(triangular: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, singular values, shares of the whole variance) of those with any, at most ``most``: the rotations run in one task, over R alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = folded(matrix(b.column(0)) for b in batches if b.num_rows)
        if r is not None:
            v, sizes = jacobi(r)
            live = min(most, int((sizes > DEAD * sizes[0]).sum()))
            whole = float((sizes * sizes).sum()) or 1.0
            yield pa.record_batch([pa.array(range(live)), pa.array(list(v[:live]), pa.list_(pa.float64())), pa.array(sizes[:live]), pa.array(sizes[:live] ** 2 / whole)], ["k", "v", "size", "share"])

    rows = triangular.repartition(1).mapInArrow(run, "k long, v array<double>, size double, share double").collect()  # at most ``most``
    rows.sort(key=lambda r: r.k)
    return (np.array([getattr(r, c) for r in rows], np.float64) for c in ("v", "size", "share"))


class Whitening:
    """The fitted map: n, exact sums, components, their standard deviations and shares of variance, and how far the fit list's covariance is from the identity."""

    def __init__(self, rows: DataFrame, most: int = 4):
        """From (x); ``most`` components at most, and only those along which vectors differ.  Without rows, or if all are equal, there are none."""
        work = Workspace(rows.sparkSession, "whitening")
        bound_batches(rows.sparkSession)
        fit = work.settle(rows.select("x").distinct(), "fit")
        self.n, self.sums = exact_sums(fit)
        self.v, self.sd, self.share, self.identity_error = np.zeros((0, len(self.sums))), np.zeros(0), np.zeros(0), 0.0
        if self.n > 1:
            self.v, sizes, self.share = components(triangle(work, fit, self.n, self.sums), most)
            self.sd = sizes / np.sqrt(self.n)
            self.identity_error = self._off(fit)
        work.drop()

    def white(self, off: np.ndarray) -> np.ndarray:
        """Whitened rows, from n x - sums."""
        return (off / self.n) @ self.v.T / self.sd

    def _off(self, fit: DataFrame) -> float:
        """The largest entry of the whitened fit list's covariance less the identity: means first, then products of what is centred."""
        k, n, sums, white = len(self.sd), self.n, self.sums, self.white
        if not k:
            return 0.0

        def mapped(mean: np.ndarray | None):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = 0
                for batch in batches:
                    if batch.num_rows:
                        w = white(scaled_off(matrix(batch.column(0)), n, sums))
                        total = total + (w.sum(axis=0) if mean is None else ((w - mean).T @ (w - mean)).ravel())
                if not np.isscalar(total):
                    yield pa.record_batch([pa.array(range(len(total))), pa.array(total)], ["k", "s"])

            parts = fit.select("x").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s"))
            return np.array([r.s for r in sorted(parts.collect(), key=lambda r: r.k)]) / n  # not more than components squared

        return float(np.abs(mapped(mapped(None)).reshape(k, k) - np.eye(k)).max())

    def apply(self, rows: DataFrame) -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained, identity_error) of each (vec_id, x): a row a component, numbered from 1.

        deviation is the sum of (n x - sums) squared over the dimensions, exact; beyond 64 bits it is an error.
        """
        k, n, sums, share, error, white = len(self.sd), self.n, self.sums, self.share, self.identity_error, self.white

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not k:
                    continue
                off, m = scaled_off(matrix(batch.column(1)), n, sums), batch.num_rows
                if float((off.astype(np.float64) ** 2).sum(axis=1).max()) >= 2.0**63 * (1 - 1e-12):
                    raise OverflowError("a deviation is beyond 64 bits")
                deviation = (off * off).sum(axis=1)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(deviation, k)), pa.array(white(off).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
                yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        bound_batches(rows.sparkSession)
        return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(embeddings: DataFrame, vector: str = "embedding", most: int = 4) -> DataFrame:
    """Fit on the distinct vectors and apply to all rows; see ``whole_numbers`` for which rows remain, and ``Whitening``.

    Null ids and repeated rows give rows like any other; other columns are of no account.  Where all remaining vectors are equal, or there are none, the result is empty.
    """
    rows = whole_numbers(embeddings, vector)
    return Whitening(rows, most).apply(rows)
