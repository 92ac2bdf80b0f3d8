"""Dense algebra on the driver; sizes depend on numbers of features, never on numbers of rows."""

from __future__ import annotations

import math
import warnings

import numpy as np


def eigh(a: np.ndarray, b: np.ndarray | None = None, rank: int | None = None, descending: bool = True):
    """Values and vectors of the symmetric (generalised) eigenproblem; vectors have a positive largest entry and w' b w = 1."""
    if b is None:
        vals, vecs = np.linalg.eigh((a + a.T) / 2)
    else:
        try:
            low = np.linalg.cholesky((b + b.T) / 2)
        except np.linalg.LinAlgError:
            raise ValueError("Eigenvalue problem has a singular matrix; try more regularisation") from None
        if np.diag(low).min() <= 1e-9 * np.diag(low).max():
            raise ValueError("Eigenvalue problem has a singular matrix; try more regularisation")
        half = np.linalg.solve(low, a)
        vals, vecs = np.linalg.eigh((half_ := np.linalg.solve(low, half.T)) / 2 + half_.T / 2)
        vecs = np.linalg.solve(low.T, vecs)
    order = np.argsort(-vals if descending else vals, kind="stable")[:rank]
    return vals[order], fix_signs(vecs[:, order])


def fix_signs(vecs: np.ndarray) -> np.ndarray:
    top = vecs[np.abs(vecs).argmax(axis=0), np.arange(vecs.shape[1])]
    return vecs * np.where(top < 0, -1, 1)


def svd_from_gram(gram: np.ndarray, rank: int | None = None, cut: float = 1e-9):
    """Singular values and right vectors of X from X'X; values below ``cut`` times the largest are left out."""
    vals, vecs = eigh(gram)
    svals = np.sqrt(np.maximum(vals, 0))
    keep = svals > cut * max(svals.max(initial=0), 1e-300)
    return svals[keep][:rank], vecs[:, keep][:, :rank]


def rand_orthog(n: int, k: int, rng: np.random.Generator) -> np.ndarray:
    """Uniform orthonormal columns: QR of a Gaussian with random column signs."""
    q, r = np.linalg.qr(rng.standard_normal((n, k)))
    return q * np.sign(np.diag(r)) * rng.choice([-1, 1], k)


def blocks(dims) -> list[slice]:
    ends = np.cumsum(dims)
    return [slice(int(e - d), int(e)) for d, e in zip(dims, ends, strict=True)]


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def gammainc(s: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < s + 1:
        term = total = 1 / s
        for n in range(1, 1000):
            term *= x / (s + n)
            total += term
        return total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    f, c, d = x + 1 - s, 1e300, 1 / (x + 1 - s)
    f = d
    for n in range(1, 1000):
        an, b = -n * (n - s), x + 2 * n + 1 - s
        d, c = 1 / (an * d + b), b + an / c
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - math.exp(-x + s * math.log(x) - math.lgamma(s)) * f


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return 0.0 if math.isinf(f) else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return 0.0 if math.isinf(x) else 1 - gammainc(df / 2, x / 2)


def profile_elbows(values, n_elbows: int = 2, threshold: float | None = None) -> list[int]:
    """Elbows of falling values: split points of highest two-segment Gaussian likelihood, one after another (Zhu and Ghodsi)."""
    x = np.sort(np.asarray(values, float))[::-1]
    if threshold is not None:
        x = x[x > threshold]
        if not len(x):
            raise IndexError(f"no values greater than threshold {threshold}")
    out, at = [], 0
    while len(out) < n_elbows and at < len(x):
        y = x[at:]
        n = len(y)
        if n == 1:
            out.append(at + 1)
            break
        like = []
        for q in range(1, n + 1):
            a, b = y[:q], y[q:]
            ss = ((a - a.mean()) ** 2).sum() + (((b - b.mean()) ** 2).sum() if len(b) else 0)
            var = max(ss / max(n - 1 - (q < n), 1), 1e-300)
            like.append(-n / 2 * math.log(2 * math.pi * var) - ss / (2 * var))
        at += int(np.argmax(like)) + 1
        out.append(at)
    return out


def as_list(param, n: int) -> list:
    """A scalar for each view, or a list of the right length."""
    out = list(param) if isinstance(param, (list, tuple, np.ndarray)) else [param] * n
    if len(out) != n:
        raise ValueError(f"expected {n} values, got {len(out)}")
    return out


def n_components(k, dims) -> int:
    most = int(sum(dims))
    if k is None:
        return most
    if k in ("min", "max"):
        return min(dims) if k == "min" else max(dims)
    if k > most:
        warnings.warn(f"n_components {k} is more than {most}, which is used", stacklevel=2)
    return min(int(k), most)
