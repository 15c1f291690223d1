"""Whitening of embeddings by spectrum slicing.

Sums and products of the integer entries are added up exactly, map-side first,
so the covariance is the correctly rounded one.  Its leading eigenvalues are
isolated by slicing: the pivots of an LDLᵀ factorisation of the covariance less
a shift tell how many eigenvalues lie above that shift.  Inside a slice of its
own an eigenvalue is met by Rayleigh quotient iteration, and two more counts
certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import stored
from .exact_topk import usable

EPS = np.finfo(float).eps
LIMB_BITS = 20  # products of two limbs, added over CHUNK rows, stay below 2**53
CHUNK = 8_192
LEAST_SHARE = 1e-10  # of the largest eigenvalue; components below it are rounding and have no scale
EXACT = pa.decimal128(38, 0)


# ------------------------------------------------------------ exact arithmetic

def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the rows of a matrix of longs, as Python integers."""
    return ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` in digits of ``LIMB_BITS`` bits, the last one signed; one for everyday vectors."""
    made = []
    while len(y) and max(int(y.max()), -int(y.min())) >= 1 << LIMB_BITS:
        made.append((y & ((1 << LIMB_BITS) - 1)).astype(float))
        y = y >> LIMB_BITS
    return [*made, y.astype(float)]


def products(y: np.ndarray) -> np.ndarray:
    """``yᵀ y`` of a matrix of longs, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for start in range(0, len(y), CHUNK):
        parts = limbs(y[start:start + CHUNK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
    return total


def row_dots(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sum over each row of ``y * z``, as Python integers."""
    if not y.size:
        return np.zeros(len(y), dtype=object)
    most = max(int(y.max()), -int(y.min())) * max(int(z.max()), -int(z.min())) * y.shape[1]
    if most < 1 << 62:
        return (y * z.astype(np.int64)).sum(1).astype(object)
    return (y.astype(object) * z.astype(object)).sum(1)


# ------------------------------------------------------------ spectrum slicing

def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` lie above ``shift``.

    These are the positive pivots of ``a - shift * I = L D Lᵀ`` (Sylvester's
    law of inertia), with the pivoting of Bunch and Kaufman: a pivot of two
    rows and columns has one positive and one negative eigenvalue.
    """
    m = a - shift * np.eye(len(a))
    n, k, above = len(m), 0, 0
    alpha = (1 + 17 ** 0.5) / 8
    while k < n:
        size, swap = 1, k
        if k + 1 < n:
            column = np.abs(m[k + 1:, k])
            r = k + 1 + int(column.argmax())
            most = column[r - k - 1]
            if abs(m[k, k]) < alpha * most:
                row = np.abs(m[r, k:])
                row[r - k] = 0
                if abs(m[k, k]) * row.max() < alpha * most ** 2:
                    size, swap = (1, r) if abs(m[r, r]) >= alpha * row.max() else (2, r)
        at = k + size - 1
        if swap != at and swap != k:
            m[[at, swap]] = m[[swap, at]]
            m[:, [at, swap]] = m[:, [swap, at]]
        rest = slice(k + size, n)
        if size == 1:
            pivot = m[k, k]
            above += pivot > 0
            if pivot:
                m[rest, rest] -= np.outer(m[rest, k], m[rest, k] / pivot)
        else:
            above += 1
            both = m[rest, k:k + 2]
            m[rest, rest] -= both @ np.linalg.solve(m[k:k + 2, k:k + 2], both.T)
        k += size
    return int(above)


def rounding(a: np.ndarray) -> float:
    """What eigenvalues of ``a`` may be off by in double precision."""
    return 8 * EPS * len(a) * float(np.abs(a).sum(axis=1).max())


def slices(a: np.ndarray, k: int) -> list[tuple[float, float, int, int]]:
    """``(low, high, above high, above low)`` from the top, until the ``k`` largest eigenvalues are in.

    A slice holds one eigenvalue, or several that agree to rounding.
    """
    narrow = max(rounding(a), np.finfo(float).tiny)
    reach = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - reach).min()) - narrow, float((np.diag(a) + reach).max()) + narrow
    todo, made = [(low, high, 0, len(a))], []
    while todo:
        low, high, before, upto = todo.pop()
        if before == upto or before >= k:
            continue
        middle = (low + high) / 2
        if upto - before == 1 or high - low <= narrow or not low < middle < high:
            made.append((low, high, before, upto))
            continue
        count = count_above(a, middle)
        todo += [(low, middle, count, upto), (middle, high, before, count)]
    return made


def eigenvector(a: np.ndarray, low: float, high: float, before: int, found: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """The eigenvalue in ``(low, high]`` and a unit eigenvector orthogonal to the columns of ``found``.

    Inverse iteration at the middle of the slice leads in.  Once the quotient
    and its residual lie inside the slice no other eigenvalue can be met, and
    Rayleigh quotient iteration takes over.  A slice that does not get there
    in a few steps is halved by a further count.
    """
    n, narrow, identity = len(a), rounding(a), np.eye(len(a))
    x, shift, last, best = rng.standard_normal(n), (low + high) / 2, np.inf, None
    for step in range(200):
        for _ in range(2):
            x = x - found @ (found.T @ x)
            x /= np.linalg.norm(x)
        value = float(x @ a @ x)
        off = float(np.linalg.norm(a @ x - value * x))
        if off <= narrow and low - narrow <= value <= high + narrow:
            if best is None or off < best[0]:
                best = off, value, x
            if off >= last / 2:
                return best[1], best[2]
        last = off
        if low < value - off and value + off < high or best:
            shift = value
        else:
            if step % 4 == 3 and high - low > narrow:
                middle = (low + high) / 2
                low, high = (middle, high) if count_above(a, middle) > before else (low, middle)
            shift = (low + high) / 2
        try:
            x = np.linalg.solve(a - shift * identity, x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
            x = np.linalg.solve(a - (shift + narrow) * identity, x)
    if best:
        return best[1], best[2]
    raise ArithmeticError("Rayleigh quotient iteration did not converge")


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``a``, falling, and their unit eigenvectors as columns.

    Each number is certified: counts on both sides of the eigenvalue say how
    many lie above.  Equal eigenvalues get an orthonormal set of vectors.
    """
    values, vectors, rng = [], np.zeros((len(a), 0)), np.random.default_rng(1)
    margin = 4 * max(rounding(a), np.finfo(float).tiny)
    for low, high, before, upto in slices(a, k):
        for _ in range(min(upto, k) - before):
            value, x = eigenvector(a, low, high, before, vectors, rng)
            number = len(values)
            if not count_above(a, value + margin) <= number < count_above(a, value - margin):
                raise ArithmeticError(f"eigenvalue {number + 1} is not certified by its counts")
            values.append(value)
            vectors = np.column_stack([vectors, x])
    order = np.argsort(-np.array(values), kind="stable")  # inside a slice of equal ones
    return np.array(values)[order], vectors[:, order]


# ------------------------------------------------------------------- operator

@dataclass
class Whitener:
    """A fitted whitening: ``(x - near - rest) @ axes`` has the identity as covariance."""

    n: int
    sums: np.ndarray  # exact, per dimension
    near: np.ndarray  # the mean, rounded to a long
    axes: np.ndarray  # eigenvectors over the roots of their eigenvalues
    explained: np.ndarray

    @property
    def rest(self) -> np.ndarray:
        return ((self.sums - self.n * self.near.astype(object)) / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.near).astype(float) - self.rest) @ self.axes

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of ``(n * x - sums) ** 2`` as Python integers.

        ``n * x - sums = n * y - q`` with ``y`` small, so only one product a row needs more than a long.
        """
        y, q = x - self.near, self.sums - self.n * self.near.astype(object)
        return self.n ** 2 * row_dots(y, y) - 2 * self.n * row_dots(y, np.broadcast_to(q, y.shape)) + int((q * q).sum())


def matrix(lists: pa.Array, width: int, missing: int) -> np.ndarray:
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lengths), width), missing, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def added(df: DataFrame, function, value_type: str, cells: int) -> np.ndarray:
    """Cell by cell sum of what ``function`` makes of the batches: every task adds up its own before the shuffle.

    The driver gets one row per cell; their number depends on the width of the vectors alone.
    """
    kind = EXACT if value_type.startswith("decimal") else pa.float64()

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in source:
            if batch.num_rows:
                made = function(batch)
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel().tolist(), kind)], ["cell", "value"])

    rows = df.mapInArrow(task, f"cell long, value {value_type}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(cells, dtype=object if kind == EXACT else float)
    for r in rows:
        out[r["cell"]] = int(r["value"]) if kind == EXACT else r["value"]
    return out


def entries(vectors: DataFrame, grid: int, offset: int, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)`` with ``x = floor(grid * c) + offset`` as longs; vectors that are null or hold null or non-finite entries go."""
    def entry(c):
        scaled = c.cast("double") * grid
        return F.when(F.abs(scaled) < 2.0 ** 61, F.floor(scaled) + offset).otherwise(
            F.raise_error(F.lit("an entry does not fit a long")))
    return vectors.filter(usable(vector_col)).select(F.col(id_col).alias("id"), F.transform(vector_col, entry).alias("x"))


def fit(kept: DataFrame, components: int, width: int, missing: int) -> Whitener:
    """Whitening of ``kept(id, x)``: two passes, sums and then products of what is centred."""
    first = added(kept.select("x"), lambda b: np.append(column_sums(x := matrix(b.column(0), width, missing)), len(x)), "decimal(38,0)", width + 1)
    sums, n = first[:-1], int(first[-1])
    flat = Whitener(n, sums, np.zeros(width, np.int64), np.zeros((width, 0)), np.zeros(0))
    if not n or not width:
        return flat
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    gram = added(kept.select("x"), lambda b: products(matrix(b.column(0), width, missing) - near), "decimal(38,0)", width * width).reshape(width, width)
    rest = sums - n * near.astype(object)
    cov = ((n * gram - np.outer(rest, rest)) / (n * n)).astype(float)
    if not cov.any():
        return flat
    values, axes = leading(cov, min(components, width))
    there = values > max(LEAST_SHARE * values[0], 0.0)
    return Whitener(n, sums, near, axes[:, there] / np.sqrt(values[there]), values[there] / np.trace(cov))


def whiten(vectors: DataFrame, components: int = 32, grid: int = 64, offset: int = 1_000_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` for every vector and component.

    Entries become ``floor(grid * c) + offset``; ``n`` rows are fitted on,
    which are all rows that remain.  ``deviation`` is exact, of 38 digits.
    Components are numbered from 1 by falling eigenvalue; ``explained`` is the
    eigenvalue's share of the trace, ``identity_error`` the largest entry of
    the covariance of ``whitened`` less the identity, measured on the output.

    Vectors that are null or hold null or non-finite entries go; rows with a
    null id stay.  Repeated rows and ids each count and are each returned.
    Shorter vectors, and empty ones, have zeros for the entries they lack.
    An entry beyond a long stops the job.  Equal eigenvalues get some
    orthonormal vectors, the same for all rows.  Components whose eigenvalue
    is not above 1e-10 of the largest are rounding, cannot be whitened and are
    left out: one vector, equal vectors or an empty table give no rows.
    Other columns are not looked at, whatever their names.
    """
    kept = stored(entries(vectors, grid, offset, id_col, vector_col), "entries")
    width = kept.agg(F.max(F.size("x"))).first()[0] or 0
    model = fit(kept, components, width, offset)
    count = model.axes.shape[1]

    def second_moments(batch: pa.RecordBatch) -> np.ndarray:
        w = model.whitened(matrix(batch.column(0), width, offset))
        return np.vstack([w.sum(0), w.T @ w])

    moments = added(kept.select("x"), second_moments, "double", (count + 1) * count).reshape(count + 1, count) / max(model.n, 1)
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(count)).max()) if count else 0.0

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for start in range(0, whole.num_rows if count else 0, 1024):
                batch = whole.slice(start, 1024)
                x = matrix(batch.column(1), width, offset)
                rows = pa.array(np.repeat(np.arange(len(x)), count))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), model.n)), pa.array(model.deviations(x).tolist(), EXACT).take(rows),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(rows), error)),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    id_type = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(
        task, f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
