"""Jaro-Winkler similarity, for which Spark has no function: all pairs of a batch side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters of names that are compared at once, about.
CELLS_AT_ONCE = 1 << 15


def _padded(texts: list[str], filler: int) -> np.ndarray:
    """Code points, a row a text; ``filler`` stands behind shorter ones and is no code point."""
    lengths = np.array([len(t) for t in texts])
    rows = np.full((len(texts), int(lengths.max())), filler, dtype=np.uint32)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return rows


def _similarities(a: list[str], b: list[str], boost_from: float, scale: float, max_prefix: int) -> np.ndarray:
    """Of pairs of texts that are not empty: a step matches one character of every first text."""
    x, y = _padded(a, 0xFFFFFFFF), _padded(b, 0xFFFFFFFE)
    n_x, n_y = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    reach = np.maximum(0, np.maximum(n_x, n_y) // 2 - 1)
    far, row = int(reach.max()), np.arange(len(a))
    found, taken = np.zeros(x.shape, dtype=bool), np.zeros(y.shape, dtype=bool)
    for k in range(min(x.shape[1], y.shape[1] + far)):
        low, high = max(0, k - far), min(y.shape[1], k + far + 1)
        fits = (y[:, low:high] == x[:, k, None]) & ~taken[:, low:high] & (np.abs(np.arange(low, high) - k) <= reach[:, None])
        first = fits.argmax(axis=1)
        found[:, k] = fits[row, first]
        taken[row, low + first] |= found[:, k]
    n = found.sum(axis=1)
    apart = np.bincount(np.nonzero(found)[0], weights=x[found] != y[taken], minlength=len(a)) // 2
    some = np.maximum(1, n)
    jaro = np.where(n > 0, (n / n_x + n / n_y + (n - apart) / some) / 3, 0.0)
    width = min(max_prefix, x.shape[1], y.shape[1])
    prefix = np.logical_and.accumulate(x[:, :width] == y[:, :width], axis=1).sum(axis=1)
    return np.where(jaro > boost_from, jaro + prefix * scale * (1 - jaro), jaro)


def jaro_winkler_pairs(a: list[str], b: list[str], boost_from: float = 0.7, scale: float = 0.1, max_prefix: int = 4) -> np.ndarray:
    """Jaro similarity of each pair, raised by the common prefix where it exceeds ``boost_from``; 0 where a text is empty.

    Pairs of like lengths are taken together, so that a long text pads no short ones.
    """
    scores = np.zeros(len(a))
    longer = np.array([max(len(x), len(y)) if x and y else 0 for x, y in zip(a, b, strict=True)], dtype=np.int64)
    order = np.argsort(longer, kind="stable")[int((longer == 0).sum()) :]
    sizes, start = longer[order], 0
    while start < len(order):
        alike = np.searchsorted(sizes, 2 * sizes[start] + 8, side="right")
        own = order[start : min(alike, start + max(1, CELLS_AT_ONCE // sizes[start]))]
        end = start + len(own)
        scores[own] = _similarities([a[k] for k in own], [b[k] for k in own], boost_from, scale, max_prefix)
        start = end
    return scores


def jaro_winkler_of(a: str, b: str, boost_from: float = 0.7, scale: float = 0.1, max_prefix: int = 4) -> float:
    return float(jaro_winkler_pairs([a], [b], boost_from, scale, max_prefix)[0])


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where a text is null; equal pairs of a batch are scored once."""
    known = (a.notna() & b.notna()).to_numpy()
    codes, pairs = pd.factorize(pd.Series(list(zip(a[known], b[known], strict=True)), dtype=object))
    scores = np.full(len(a), np.nan)
    scores[known] = jaro_winkler_pairs([x for x, _ in pairs], [y for _, y in pairs])[codes]
    return pd.Series(scores).astype("Float64").mask(~known)
