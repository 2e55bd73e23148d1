"""Inverses and solutions of systems of linear equations, one per plane; all planes of an Arrow batch that have one size
are worked on together.

A decomposition fails where a pivot, a diagonal of R or a squared diagonal of the Cholesky factor is at most
epsilon * (longer side) * (largest size of an entry); Cholesky also where the matrix isn't symmetric up to that. Such
planes, and those with values that aren't finite, have ok = false and an empty array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gridloom.operators.consensus import solved
from gridloom.operators.kernels import _planes_of

LU, CHOLESKY, QR = 0, 3, 4
_FIELDS = "img long, c int, ok boolean, rows int, cols int, data array<double>"


def _cutoff(a: np.ndarray) -> np.ndarray:
    return np.finfo(float).eps * max(a.shape[1:]) * np.abs(a).max(axis=(1, 2), initial=0)


def by_lu(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many square systems (n, k, k) x = (n, k, m) by elimination with the largest pivot; NaN where there is none."""
    return solved(a, b, _cutoff(a))


def by_cholesky(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for symmetric positive definite matrices."""
    least, n = _cutoff(a), a.shape[1]
    bad = (np.abs(a - a.transpose(0, 2, 1)) > least[:, None, None]).any(axis=(1, 2))
    low, y = np.zeros_like(a), b.copy()
    for k in range(n):
        left = a[:, k:, k] - np.einsum("nij,nj->ni", low[:, k:, :k], low[:, k, :k])
        bad |= ~(left[:, 0] > least)
        low[:, k:, k] = left / np.sqrt(np.where(bad, 1.0, left[:, 0]))[:, None]
        low[bad, k, k] = 1.0
    for k in range(n):
        y[:, k] = (y[:, k] - np.einsum("nj,njm->nm", low[:, k, :k], y[:, :k])) / low[:, k, k, None]
    y = _back(low.transpose(0, 2, 1), y)
    y[bad] = np.nan
    return y


def by_qr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares solutions of systems with at least as many equations as unknowns."""
    q, r = np.linalg.qr(a)
    bad = (np.abs(np.diagonal(r, axis1=1, axis2=2)) <= _cutoff(a)[:, None]).any(axis=1)
    r[bad] = np.eye(a.shape[2])
    x = _back(r, q.transpose(0, 2, 1) @ b)
    x[bad] = np.nan
    return x


def _back(upper: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = y.copy()
    for k in range(upper.shape[2] - 1, -1, -1):
        x[:, k] = (x[:, k] - np.einsum("nj,njm->nm", upper[:, k, k + 1 :], x[:, k + 1 :])) / upper[:, k, k, None]
    return x


_METHODS: dict[int, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {LU: by_lu, CHOLESKY: by_cholesky, QR: by_qr}


def _answered(planes: DataFrame, method: int | None, right: bool) -> DataFrame:
    if method is not None and method not in _METHODS:
        raise ValueError("a method is LU, CHOLESKY or QR")
    arrow = to_arrow_schema(_parse_datatype_string(_FIELDS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, alike = [], {}
            for n, (img, c, a, *more) in enumerate(_planes_of(batch)):
                b = np.asarray(more[0], float) if right else np.eye(len(a)).ravel()
                rows.append([img, c, False, 0, 0, []])
                fits = len(a) > 0 and b.size % len(a) == 0 and a.shape[0] >= a.shape[1] > 0
                square = a.shape[0] == a.shape[1]
                how = (LU if square else QR) if method is None else method
                if fits and (square or (how == QR and right)) and np.isfinite(a).all() and np.isfinite(b).all():
                    alike.setdefault((a.shape, b.size, how), []).append((n, a, b))
            for (shape, size, how), systems in alike.items():
                a = np.stack([s[1] for s in systems]).astype(float)
                x = _METHODS[how](a, np.stack([s[2] for s in systems]).reshape(len(a), shape[0], size // shape[0]))
                for (n, *_), solution in zip(systems, x, strict=True):
                    if np.isfinite(solution).all():
                        rows[n][2:] = True, *solution.shape, solution.ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return planes.select("img", "c", "rows", "cols", "data", *(["_b"] if right else [])).mapInArrow(scan, _FIELDS)


def invert(planes: DataFrame, method: int = LU) -> DataFrame:
    """(img, c, ok, rows, cols, data): the inverse, or an empty array where there is none or the matrix isn't square."""
    return _answered(planes, method, False)


def solve(planes: DataFrame, right: DataFrame, method: int | None = None) -> DataFrame:
    """(img, c, ok, rows, cols, data) for the right sides of equal img and c. Without a method square systems go by LU and
    taller ones, whose answer is that of least squares, by QR; LU and CHOLESKY are for square ones, flat ones have no answer."""
    return _answered(planes.join(right.select("img", "c", F.col("data").alias("_b")), ["img", "c"]), method, True)
