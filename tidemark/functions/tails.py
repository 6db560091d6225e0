"""Tail probabilities of the test statistics, for one statistic at a time."""

from __future__ import annotations

from math import erfc, exp, inf, isfinite, lgamma, log, sqrt

import numpy as np

#: Samples of at most so many values get the exact Kolmogorov-Smirnov probability.
EXACT_UP_TO = 10_000


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square with dof degrees >= x): the regularised upper incomplete gamma function."""
    if dof < 1 or not x >= 0:
        raise ValueError("dof must be positive and x not negative")
    if x == 0:
        return 1.0
    if not isfinite(x):
        return 0.0
    a, x = dof / 2, x / 2
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:  # power series of the lower function
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a  # continued fraction of the upper function, from the front
    c, d = inf, 1 / b
    value = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return min(1.0, front * value)


def kolmogorov_tail(x: float) -> float:
    """Limit of P(sqrt(n) D >= x)."""
    if x <= 0:
        return 1.0
    if x < 1.0:  # the dual series converges faster here
        return 1 - sqrt(2 * np.pi) / x * sum(exp(-((2 * k - 1) ** 2) * np.pi**2 / (8 * x * x)) for k in range(1, 20))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_exact(d: float, n: int, m: int) -> float:
    """P(D >= d) when all orders of the two samples' n + m values are equally likely.

    An order is a lattice path from (0, 0) to (n, m). Paths are counted row by row, as long as they stay
    where the distribution functions differ by less than d; each way out adds its share of all paths.
    Every term is positive, so small probabilities keep their digits. Rows are scaled, in logarithms.
    """
    if d <= 0:
        return 1.0
    # the statistic is a multiple of 1 / lcm; compare whole numbers
    g = np.gcd(n, m)
    limit = int(round(d * (n // g) * m))  # d in units of 1 / lcm
    a, b = m // g, n // g  # |i / n - j / m| in these units is |i * a - j * b|
    j = np.arange(m + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + m + 1)))])
    all_paths = log_factorial[n + m] - log_factorial[n] - log_factorial[m]

    def share(i: int, at: np.ndarray) -> np.ndarray:
        """Logarithm of the paths from (i, at) to the end, over all paths."""
        left, right = n - i, m - at
        return log_factorial[left + right] - log_factorial[left] - log_factorial[right] - all_paths

    total, scale = 0.0, 0.0
    row = np.zeros(m + 1)
    row[0] = 1.0
    for i in range(n + 1):
        inside = np.abs(i * a - j * b) < limit
        if i:
            leaving = np.flatnonzero((row > 0) & ~inside)  # stepped from the row before to outside
            if len(leaving):
                total += float(np.exp(np.log(row[leaving]) + scale + share(i, leaving)).sum())
        lo, hi = (int(x) for x in np.flatnonzero(inside)[[0, -1]]) if inside.any() else (0, -1)
        new = np.zeros(m + 1)
        if hi >= lo:
            new[lo : hi + 1] = np.cumsum(row[lo : hi + 1])
            if hi < m and new[hi] > 0:  # one step further along the row is outside
                total += float(np.exp(np.log(new[hi]) + scale + share(i, np.asarray([hi + 1]))).sum())
        top = new.max()
        if top == 0:
            break
        scale += log(top)
        row = new / top
    return min(1.0, total)


def ks_p_value(d: float, n: int, m: int) -> tuple[float, str]:
    """Two-sided p-value and the method: exact for samples of up to EXACT_UP_TO, else the limit."""
    if max(n, m) <= EXACT_UP_TO:
        return ks_exact(d, n, m), "exact"
    return kolmogorov_tail(sqrt(n * m / (n + m)) * d), "asymptotic"


def chi2_tail_one(x: float) -> float:
    """The tail for one degree of freedom, in closed form."""
    return erfc(sqrt(x / 2))
