"""Operator 11: whitening of embeddings by a polarisation covariance.

Entries become whole numbers, so that every sum is exact in any order. Over the distinct vectors, tasks add up the squares of the centred values of each
dimension and of the sum of each two dimensions. A variance of a sum less the two variances is twice the covariance, which gives all cross terms; the matrix,
dimensions squared and not growing with the rows, is decomposed on the driver.

Centred values are ``n * x - S``, whole as well. Their squares pass 64 bits long before their number does, so they are added up in digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.shared import Scratch

#: An entry c becomes floor(SCALE * c) + OFFSET; beyond 2^61 on either side it stays there.
SCALE, OFFSET, FARTHEST = 64, 1_000_000, 2.0**61
#: Totals leave a task as so many digits of DIGIT bits; the last one holds all above.
DIGITS, DIGIT = 6, 40
#: Bits of the three parts that a centred value is split into before squaring: sums of products of up to 2^20 rows stay within 64 bits.
_PART = 21
_SUM_SCHEMA = "item long, " + ", ".join(f"d{k} long" for k in range(DIGITS))
#: Components whose variance is less than this part of the largest one count as none.
NEGLIGIBLE = 1e-24
#: From this ratio of the wanted eigenvalues on, the result of eigh is refined: the exact matrix is turned into its basis (as whole numbers of so many bits), and
#: what is left off the diagonal is rotated away in extended precision.
GRADED, _BASIS_BITS = 1e-7, 64


def _whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(FARTHEST)), F.lit(-FARTHEST))) + OFFSET)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x``: the id as it is, and the vector as whole numbers.

    Rows without a vector, with an empty one, or with an entry that is null, infinite or not a number are left out.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(odd, F.lit(False))).select("id", _whole(F.col("v")).alias("x"))


# -- exact sums -----------------------------------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), dtype=np.int64)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, _matrix(part.column("x"))


def _digits(totals: list[int]) -> pa.RecordBatch:
    """Totals as rows of digits."""
    low, columns = (1 << DIGIT) - 1, [pa.array(range(len(totals)), pa.int64())]
    for k in range(DIGITS):
        columns.append(pa.array([(t >> (DIGIT * k)) & low if k < DIGITS - 1 else t >> (DIGIT * k) for t in totals], pa.int64()))
    return pa.RecordBatch.from_arrays(columns, ["item", *(f"d{k}" for k in range(DIGITS))])


def _added(parts: DataFrame) -> dict[int, int]:
    """Item -> exact total over all tasks. The items are as many as there are pairs of dimensions, not rows."""
    sums = parts.groupBy("item").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS))).toArrow().to_pydict()
    return {item: sum(sums[f"d{k}"][i] << (DIGIT * k) for k in range(DIGITS)) for i, item in enumerate(sums["item"])}


def _squares(p: np.ndarray, small: bool) -> list[int]:
    """The exact sums of squares of the columns of ``p``, by three parts of each value unless their squares fit in 64 bits."""
    if p.dtype == object:
        return list((p * p).sum(axis=0))
    if small:
        q = p * p
        low = q & 0xFFFFFFFF
        return [int(a) + (int(b) << 32) for a, b in zip(low.sum(axis=0), (q >> 32).sum(axis=0), strict=True)]
    m, mask = np.abs(p), (1 << _PART) - 1
    a, b, c = m >> (2 * _PART), (m >> _PART) & mask, m & mask
    terms = ((a * a, 4), (2 * a * b, 3), (2 * a * c, 2), (b * b, 2), (2 * b * c, 1), (c * c, 0))
    out = [0] * p.shape[1]
    for term, place in terms:
        out = [o + (int(t) << (place * _PART)) for o, t in zip(out, term.sum(axis=0), strict=True)]
    return out


@dataclass(frozen=True)
class Centre:
    """What centres a whole vector: the number of distinct vectors, their sums and least entries, and the widest range of an entry."""

    n: int
    sums: tuple[int, ...]
    least: tuple[int, ...]
    width: int

    @property
    def most(self) -> int:
        """No centred value is farther from 0."""
        return self.n * self.width

    def of(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exactly: of 64 bits where the sum of two of them is, of any size otherwise."""
        kind = np.int64 if 2 * self.most < 2**62 else object
        least = np.array(self.least, dtype=np.int64)
        rest = np.array([s - self.n * lo for s, lo in zip(self.sums, self.least, strict=True)], dtype=kind)
        return (x - least).astype(kind) * self.n - rest


def centre(fit: DataFrame) -> Centre:
    """One pass over the distinct vectors ``x`` of one length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _batches(batches):
            n += len(x)
            # entries are shifted so that no part is negative; high and low halves are added apart
            moved = (x + (1 << 62)).astype(np.uint64)
            own = [int(a) + (int(b) << 32) for a, b in zip((moved & np.uint64(0xFFFFFFFF)).sum(axis=0), (moved >> np.uint64(32)).sum(axis=0), strict=True)]
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if n:
            yield _digits([n, *total])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for _, x in _batches(batches):
            lo, hi = (x.min(axis=0) if lo is None else np.minimum(lo, x.min(axis=0))), (x.max(axis=0) if hi is None else np.maximum(hi, x.max(axis=0)))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(lo)), pa.int64()), pa.array(lo), pa.array(hi)], ["item", "lo", "hi"])

    total = _added(fit.mapInArrow(sums, _SUM_SCHEMA))
    n = total.get(0, 0)
    found = fit.mapInArrow(ends, "item long, lo long, hi long").groupBy("item").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("item").collect()
    width = max((r["hi"] - r["lo"] for r in found), default=0)
    return Centre(n, tuple(total[i + 1] - n * (1 << 62) for i in range(len(found))), tuple(r["lo"] for r in found), width)


def square_sums(fit: DataFrame, middle: Centre) -> dict[tuple[int, int], int]:
    """(i, i) -> sum of the squared centred values of dimension i; (i, j) -> that of the sums of dimensions i and j."""
    dims = len(middle.sums)
    small = 2 * middle.most < 2**31

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for _, x in _batches(batches):
            d = middle.of(x)
            own = []
            for i in range(dims):
                p = d[:, i:] + d[:, i : i + 1]
                p[:, 0] = d[:, i]
                own += _squares(p, small)
            totals = own if totals is None else [a + b for a, b in zip(totals, own, strict=True)]
        if totals is not None:
            yield _digits(totals)

    total = _added(fit.mapInArrow(sums, _SUM_SCHEMA))
    pairs = ((i, j) for i in range(dims) for j in range(i, dims))
    return {pair: total[k] for k, pair in enumerate(pairs)}


def covariance(squares: dict[tuple[int, int], int], n: int, dims: int) -> list[list[Fraction]]:
    """The exact covariance of x, divisor n, by differences of variances."""
    out = [[Fraction(0)] * dims for _ in range(dims)]
    for (i, j), s in squares.items():
        twice = 2 * s if i == j else s - squares[i, i] - squares[j, j]
        out[i][j] = out[j][i] = Fraction(twice, 2 * n**3)
    return out


# -- components -----------------------------------------------------------------------------------------------------------


def _rotated(values: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a matrix that is nearly diagonal, by Jacobi's rotations in extended precision; small eigenvalues keep their digits."""
    a, q = values.astype(np.longdouble), np.eye(len(values), dtype=np.longdouble)
    for _ in range(rounds):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if a[i, j] ** 2 <= np.longdouble(1e-34) * abs(a[i, i] * a[j, j]):
                    continue
                turned = True
                t = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(t * t + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.array([[c, t * c], [-t * c, c]], dtype=np.longdouble)
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j], :] = turn.T @ a[[i, j], :]
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    return np.diag(a), q


def components_of(cov: list[list[Fraction]], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Up to ``most`` eigenvalues by falling size, their unit vectors as columns, and the trace. A vector's largest entry is positive."""
    v = np.array([[float(c) for c in row] for row in cov])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    most = min(most, len(values))
    if values[0] > 0 and values[most - 1] < GRADED * values[0]:
        unit = math.lcm(*(c.denominator for row in cov for c in row))
        exact = np.array([[int(c * unit) for c in row] for row in cov], dtype=object)
        basis = np.array([[int(c * 2**_BASIS_BITS) for c in row] for row in vectors.tolist()], dtype=object)
        turned = basis.T @ exact @ basis
        values, turns = _rotated(np.array([[np.longdouble(c) for c in row] for row in turned]))
        values = values / np.longdouble(unit) / np.longdouble(2) ** (2 * _BASIS_BITS)
        order = np.argsort(-values, kind="stable")
        wide = (vectors.astype(np.longdouble) @ turns)[:, order]
        values, vectors = values[order].astype(float), (wide / np.sqrt((wide * wide).sum(axis=0))).astype(float)
    values, vectors = values[:most], vectors[:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(most)])
    return values, vectors * signs, float(sum(cov[i][i] for i in range(len(cov))))


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation. ``identity_error`` is measured on the fit list, None where no component has any variance."""

    middle: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """1 over the root of each eigenvalue; not a number for components without variance."""
        top = self.values.max(initial=0.0)
        return np.array([1 / np.sqrt(e) if e > NEGLIGIBLE * top and e > 0 else np.nan for e in self.values])

    def of(self, d: np.ndarray) -> np.ndarray:
        """Centred whole vectors, whitened. Terms are added dimension by dimension, so that equal vectors give equal bits in any batch."""
        x, out = d.astype(float) / self.middle.n, np.zeros((len(d), len(self.values)))
        for i, row in enumerate(self.vectors):
            out += x[:, i : i + 1] * row
        return out * self.scales


def _error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened fit list's covariance less the identity, over components with variance."""
    some = np.flatnonzero(np.isfinite(model.scales))
    if not len(some):
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = mean = 0
        for _, x in _batches(batches):
            w = model.of(model.middle.of(x))[:, some]
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        if not np.isscalar(total):
            flat = np.concatenate([total.ravel(), mean])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int64()), pa.array(flat)], ["item", "value"])

    rows = fit.mapInArrow(sums, "item long, value double").groupBy("item").agg(F.sum("value").alias("value")).orderBy("item").collect()
    k, n = len(some), model.middle.n
    flat = np.array([r["value"] for r in rows])
    cov = flat[: k * k].reshape(k, k) / n - np.outer(flat[k * k :], flat[k * k :]) / n**2
    return float(np.abs(cov - np.eye(k)).max())


def fit_whitening(whole: DataFrame, components: int, scratch: Scratch) -> Whitening | None:
    """Fitted on each distinct ``x`` once; None where there is none. Copies of a vector meet after they were combined in each task."""
    fit = scratch.save("fit", whole.select("x").groupBy("x").agg(F.count("*").alias("n_rows")).select("x"))
    middle = centre(fit)
    if not middle.n:
        return None
    values, vectors, trace = components_of(covariance(square_sums(fit, middle), middle.n, len(middle.sums)), components)
    model = Whitening(middle, values, vectors, trace)
    return Whitening(middle, values, vectors, trace, _error(fit, model))


def whitened(whole: DataFrame, model: Whitening) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each of ``id, x`` and component.

    ``deviation`` is null where it passes 64 bits. A component without variance has null ``whitened`` and, if there is none at all, null ``explained``.
    """
    k, n = len(model.values), model.middle.n
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.values]
    id_type = whole.schema["id"].dataType.simpleString()
    exact = model.middle.most**2 * len(model.middle.sums) < 2**62

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, 2048):
            d = model.middle.of(x)
            dev = (d * d).sum(axis=1) if exact else [t if t < 2**63 else None for t in (d.astype(object) ** 2).sum(axis=1)]
            w = model.of(d).ravel()
            size = len(w)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, n, dtype=np.int64)),
                    pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(w, mask=~np.isfinite(w)),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([model.identity_error] * size, pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return whole.mapInArrow(rows, f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector that ``whole_vectors`` keeps, projected on the first components and scaled to unit variance.

    Vectors of another length than the most frequent one (of equally frequent ones the longest) are left out. Repeated rows return each time, and count
    once in the fit; other columns are not read; an empty table gives no rows. Copies, ties and hot vectors change nothing but the number of rows.
    """
    whole = whole_vectors(vectors, id_col, vector_col)
    lengths = whole.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    whole = whole.where(F.size("x") == (lengths[0]["dims"] if lengths else 0))
    scratch = Scratch(vectors.sparkSession, "whitening")
    model = fit_whitening(whole, components, scratch) if lengths else None
    scratch.drop("fit")
    if model is None:
        model = Whitening(Centre(0, (), (), 0), np.empty(0), np.empty((0, 0)), 0.0)
    return whitened(whole, model)
