"""Element-wise kernels and the pairwise sum on numpy arrays.

The sum's order is fixed by the length alone: spans of more than 256 elements are halved at the
midpoint rounded up to a multiple of 8; a span adds whole groups of 8 into 8 lanes, folds the
lanes from zero and then the elements that are left. Every addition keeps the element type.
"""

from __future__ import annotations

import numpy as np

#: Fixed values that the order of additions depends on.
LANES, SPAN = 8, 256


def _same(*arrays: np.ndarray) -> None:
    if len({len(a) for a in arrays}) > 1:
        raise ValueError("length mismatch: " + " and ".join(str(len(a)) for a in arrays))


def add(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    _same(a, b, *([] if out is None else [out]))
    return np.add(a, b, out=out)


def sub(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    _same(a, b, *([] if out is None else [out]))
    return np.subtract(a, b, out=out)


def mul(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    _same(a, b, *([] if out is None else [out]))
    return np.multiply(a, b, out=out)


def mul_scalar(a: np.ndarray, scalar, out: np.ndarray | None = None) -> np.ndarray:
    _same(a, *([] if out is None else [out]))
    return np.multiply(a, a.dtype.type(scalar), out=out)


def _spans(n: int) -> tuple[list[int], list]:
    """Lengths of the spans in order, and how their sums pair up (an index or a pair)."""
    lengths: list[int] = []

    def cut(m: int):
        if m <= SPAN:
            lengths.append(m)
            return len(lengths) - 1
        left = -(-(m // 2) // LANES) * LANES
        return (cut(left), cut(m - left))

    return lengths, cut(n)


def _fold(values: np.ndarray) -> np.ndarray:
    """Left fold of the columns of rows, from zero."""
    total = np.zeros(len(values), dtype=values.dtype)
    for k in range(values.shape[1]):
        total = total + values[:, k]
    return total


def pairwise_sum(values: np.ndarray):
    """Sum of a one-dimensional array in the fixed order, as a scalar of its type."""
    if len(values) == 0:
        return values.dtype.type(0)
    lengths, tree = _spans(len(values))
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    sums = np.zeros(len(lengths), dtype=values.dtype)
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_length.setdefault(n, []).append(i)
    with np.errstate(over="ignore", invalid="ignore"):
        for n, which in by_length.items():  # spans of one length together
            rows = values[starts[which][:, None] + np.arange(n)]
            whole = n - n % LANES
            lanes = np.zeros((len(which), LANES), dtype=values.dtype)
            for at in range(0, whole, LANES):
                lanes = lanes + rows[:, at : at + LANES]
            total = _fold(lanes)
            for at in range(whole, n):
                total = total + rows[:, at]
            sums[which] = total

        def paired(node):
            return sums[node] if isinstance(node, int) else paired(node[0]) + paired(node[1])

        return values.dtype.type(paired(tree))
