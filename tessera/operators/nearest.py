"""The nearest rows of each query within one group of both, in numpy.

Sums run over the values in order, as the JVM expressions of ``vector`` do, and give the
same doubles.  For metrics that come from inner products, one matrix product with a bound
on its rounding error first rules out rows that can't be among the nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distances held at once.
CELLS = 1 << 20


def _sum(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, axis=-1)[..., -1] if x.shape[-1] else np.zeros(x.shape[:-1])


def _cosine(x, q):
    size = np.sqrt(_sum(x * x)) * np.sqrt(_sum(q * q))
    inner = _sum(x * q)
    return 1 - np.where(size == 0, 0.0 * inner, inner / size)


def _linf(x, q):
    """Values that are missing (masked) are skipped, as ``array_max`` does; -1 if all are."""
    return np.where(np.ma.getmaskarray(x) | np.ma.getmaskarray(q), -1.0, np.abs(np.ma.getdata(x) - np.ma.getdata(q))).max(axis=1, initial=-1.0)


_L2, _L1 = (lambda x, q: np.sqrt(_sum((x - q) ** 2))), (lambda x, q: _sum(np.abs(x - q)))
_DOT = lambda x, q: -_sum(x * q)
EXACT = {
    "l2": _L2, "euclidean": _L2, "l2_squared": lambda x, q: _sum((x - q) ** 2), "l1": _L1, "manhattan": _L1, "linf": _linf, "chebyshev": _linf,
    "cosine": _cosine, "cosine_distance": _cosine, "dot": _DOT, "inner_product": _DOT,
}


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat, shape = table[column].combine_chunks().flatten(), (table.num_rows, table["_dim"][0].as_py())
    found = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(shape) + 0.0
    return np.ma.array(found, mask=flat.is_null().to_numpy(zero_copy_only=False).reshape(shape)) if flat.null_count else found


def _first_copies(x: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Of equal rows the k first, as no query needs more."""
    _, group = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True) if x.shape[1] else (None, np.zeros(len(x), int))
    order = np.lexsort((rank, group))
    same = np.r_[False, group[order[1:]] == group[order[:-1]]]
    at = np.arange(len(x))
    return order[at - np.maximum.accumulate(np.where(same, 0, at)) < k]


def _candidates(x: np.ndarray, q: np.ndarray, k: int, metric: str):
    """For each query the rows that may be among its k nearest."""
    if metric not in ("l2", "euclidean", "l2_squared", "cosine", "cosine_distance", "dot", "inner_product") or len(x) <= k:
        for _ in q:
            yield np.arange(len(x))
        return
    if metric.startswith("cosine"):
        x, q = (v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1.0, n) for v in (x, q))
    own, asked = (x * x).sum(axis=1), (q * q).sum(axis=1)
    error = 4 * (x.shape[1] + 16) * np.finfo(float).eps
    step = max(1, CELLS // len(x))
    for i in range(0, len(q), step):
        near = q[i : i + step] @ x.T
        near = own - 2 * near if metric in ("l2", "euclidean", "l2_squared") else -near
        bound = np.partition(near + error * own, k - 1, axis=1)[:, k - 1] + 2 * error * asked[i : i + step]
        near -= error * own
        # What isn't a number is a candidate too.
        for found in ~(near > bound[:, None]):
            yield np.flatnonzero(found)


def nearest(rows: pa.Table, queries: pa.Table, key: str, k: int, metric: str) -> pa.Table:
    """(query_id, key, dist): the k nearest of ``rows`` (key, _v) for each of ``queries``
    (query_id, _q), all of one dimension; ties by key."""
    picked, asked, dist = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
    if k > 0 and rows.num_rows and queries.num_rows:
        x, q = _matrix(rows, "_v"), _matrix(queries, "_q")
        rank = np.empty(len(x), int)
        rank[pc.sort_indices(rows[key], null_placement="at_start").to_numpy()] = np.arange(len(x))
        kept = np.arange(len(x)) if np.ma.isMaskedArray(x) else _first_copies(x, rank, k)
        x, rank = x[kept], rank[kept]
        with np.errstate(all="ignore"):
            for j, found in enumerate(_candidates(x, q, k, metric)):
                far = EXACT[metric](x[found], q[j])
                if EXACT[metric] is _linf:
                    found, far = found[far != -1], far[far != -1]
                best = np.lexsort((rank[found], far))[:k]
                picked.append(kept[found[best]])
                asked.append(np.full(len(best), j))
                dist.append(far[best])
    return pa.table({"query_id": queries["query_id"].take(pa.array(np.concatenate(asked))), key: rows[key].take(pa.array(np.concatenate(picked))), "dist": np.concatenate(dist)})
