"""Tail probabilities of the test statistics, for result tables of a few rows."""

from __future__ import annotations

import math

import numpy as np


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) for whole degrees of freedom, by the finite sums."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        terms = [i * math.log(half) - math.lgamma(i + 1) - half for i in range(df // 2)]
        return min(1.0, math.fsum(math.exp(t) for t in terms))
    terms = [(i - 0.5) * math.log(half) - math.lgamma(i + 0.5) - half for i in range(1, (df - 1) // 2 + 1)]
    return min(1.0, math.erfc(math.sqrt(half)) + math.fsum(math.exp(t) for t in terms))


def normal_tail_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def studentized_range_tail(q: float, k: int) -> float:
    """P(Q > q) of the range of k standard normals (infinite degrees of freedom)."""
    z, step = np.linspace(-9.0, 9.0 + max(q, 0.0), 20_001, retstep=True)
    cdf = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    lower = 0.5 * (1 + np.vectorize(math.erf)((z - q) / math.sqrt(2)))
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    f = k * density * (cdf - lower) ** (k - 1)
    inside = step * (f.sum() - (f[0] + f[-1]) / 2)
    return float(min(1.0, max(0.0, 1.0 - inside)))


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided P of the smaller signed-rank sum for n differences without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] += ways[:-rank].copy()
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


def signed_rank_p(w: float, n: int, tie_sum: float, exact: bool) -> float:
    """Two-sided signed-rank P: exact for few untied differences, else normal with tie correction."""
    if n == 0:
        return float("nan")
    if exact:
        return signed_rank_exact(w, n)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_sum / 2) / 24)
    return normal_tail_two_sided((w - n * (n + 1) / 4) / spread) if spread else float("nan")
