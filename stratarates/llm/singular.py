"""Singular values and right singular vectors of a small square matrix by qd transforms.

``right_vectors`` bidiagonalises with Householder reflections, finds the singular values of
the bidiagonal with dqds (differential quotient-difference with shifts), and the vectors with
twisted factorisations: the stationary transform from the top and the progressive one from
the bottom meet where the twist is least, and two short recurrences from there give the vector.

Neighbouring values need care: where the vectors of a narrow cluster are not orthogonal, they
are found again by inverse iteration, each kept orthogonal to those before it.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V): ``matrix = U B V'`` with orthogonal U (not kept) and V."""
    a = np.array(matrix, float)
    n = len(a)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        # a column whose entries below the first are zero already needs none
        if not np.any(x[1:]):
            return None
        x = x / np.abs(x).max()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        return x / np.linalg.norm(x)

    for k in range(n):
        if (h := reflector(a[k:, k].copy())) is not None:
            a[k:, k:] -= 2 * np.outer(h, h @ a[k:, k:])
        if k < n - 2 and (h := reflector(a[k, k + 1:].copy())) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ h, h)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds step; None if the shift is above the least eigenvalue."""
    new_q, new_e = [], []
    d = q[0] - shift
    least = d
    for i in range(len(e)):
        if not d >= 0:
            return None
        total = d + e[i]
        if total <= TINY:
            return None
        ratio = q[i + 1] / total
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
        least = min(least, d)
    if not d >= 0:
        return None
    new_q.append(d)
    return new_q, new_e, least


def squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squared singular values of one unreduced bidiagonal, in falling order, by dqds."""
    q, e = (diagonal ** 2).tolist(), (above ** 2).tolist()
    if q[0] < q[-1]:  # the small end belongs at the bottom; the spectrum is the same
        q, e = q[::-1], e[::-1]
    found: list[float] = []
    stack = [(q, e, 0.0)]
    while stack:
        q, e, lost = stack.pop()
        guess = 0.0
        while True:
            n = len(q)
            if n == 1:
                found.append(lost + q[0])
                break
            if e[-1] <= EPS * EPS * (lost + q[-1]):
                found.append(lost + q[-1])
                q, e = q[:-1], e[:-1]
                guess = 0.0
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * lost), None)
            if cut is not None:
                stack.append((q[:cut + 1], e[:cut], lost))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            # the least eigenvalue of the last 2 x 2 block bounds the least of all from above
            half = (q[-2] + e[-1] - q[-1]) / 2
            other = q[-1] * (q[-2] / (q[-2] + e[-1])) if q[-2] + e[-1] > 0 else 0.0
            root = half + q[-1] + np.hypot(half, np.sqrt(e[-1] * q[-1]))
            shift = min(q[-1] * (q[-2] / root) if root > 0 else 0.0, other)
            shift = min(shift, guess) if guess else shift
            step = None
            for factor in (1 - 4 * EPS, 0.9, 0.5, 0.1):
                if shift * factor > 0 and (step := _transform(q, e, shift * factor)):
                    lost += shift * factor
                    break
            if step is None:
                step = _transform(q, e, 0.0)
            if step is None:  # zeros at working precision
                q, e = [max(x, TINY / EPS) for x in q], [max(x, 0.0) for x in e]
                step = _transform(q, e, 0.0)
            q, e, guess = step
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B, one column per value."""
    n, m = len(diagonal), len(values)
    d, low = diagonal ** 2, above / diagonal[:-1]
    guard = max(float(d.max()) * EPS * EPS, TINY)
    down, up = np.zeros((n, m)), np.zeros((n, m))  # multipliers L+ and U-
    s, p = np.empty((n, m)), np.empty((n, m))

    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) < guard, np.where(x < 0, -guard, guard), x)

    s[0] = -values
    for i in range(n - 1):
        pivot = safe(s[i] + d[i])
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - values
    p[n - 1] = d[n - 1] - values
    for i in range(n - 2, -1, -1):
        pivot = safe(d[i] * low[i] ** 2 + p[i + 1])
        ratio = d[i] / pivot
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - values
    twist = np.abs(s + p + values).argmin(axis=0)
    z = np.zeros((n, m))
    z[twist, np.arange(m)] = 1
    for i in range(n - 2, -1, -1):
        here = i < twist
        z[i, here] = -down[i, here] * z[i + 1, here]
    for i in range(n - 1):
        here = i >= twist
        z[i + 1, here] = -up[i, here] * z[i, here]
    return z / np.linalg.norm(z, axis=0)


def _separated(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``z`` with the vectors of narrow clusters made orthogonal."""
    n = len(values)
    tri = np.diag(diagonal ** 2)
    tri[1:, 1:] += np.diag(above ** 2)
    tri += np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    scale = float(np.abs(tri).max())
    at = 0
    while at < n:
        stop = at + 1
        while stop < n and values[stop - 1] - values[stop] < 1e-3 * values[stop - 1]:
            stop += 1
        part = z[:, at:stop]
        if stop - at > 1 and np.abs(part.T @ part - np.eye(stop - at)).max() > 64 * EPS:
            random = np.random.default_rng(at)
            for k in range(stop - at):
                shifted = tri - (values[at + k] + (k + 1) * 4 * EPS * scale) * np.eye(len(tri))
                x = part[:, k].copy()
                for attempt in range(6):
                    for _ in range(2):
                        x -= part[:, :k] @ (part[:, :k].T @ x)
                    if np.linalg.norm(x) < 0.1 * (attempt == 0):
                        x = random.standard_normal(len(x))
                        continue
                    x /= np.linalg.norm(x)
                    if attempt == 5:
                        break
                    y = np.linalg.solve(shifted, x)
                    if not np.isfinite(y).all():
                        break
                    x = y / np.linalg.norm(y)
                for _ in range(2):
                    x -= part[:, :k] @ (part[:, :k].T @ x)
                part[:, k] = x / np.linalg.norm(x)
        at = stop
    return z


def right_vectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values in falling order, right singular vectors as columns).

    Values at rounding level of the largest are set to zero; their vectors are not to be used."""
    a, b, v = bidiagonal(matrix)
    n = len(a)
    size = float(np.abs(np.concatenate([a, b])).max(initial=0))
    if size == 0:
        return np.zeros(n), np.eye(n)
    a, b = a / size, b / size
    # both changes are below the error of the reflections
    a = np.where(np.abs(a) < EPS / 8, np.copysign(EPS / 8, a), a)
    b = np.where(np.abs(b) < EPS / 8, 0.0, b)
    edges = [0, *(np.flatnonzero(b == 0) + 1).tolist(), n]
    values, vectors = np.zeros(n), np.zeros((n, n))
    for low, high in zip(edges, edges[1:]):
        d, e = a[low:high], b[low:high - 1]
        values[low:high] = squares(d, e)
        z = twisted(d, e, values[low:high])
        vectors[low:high, low:high] = _separated(d, e, values[low:high], z)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    values[values < (n * EPS) ** 2 * values[0]] = 0.0
    return values * size * size, v @ vectors
