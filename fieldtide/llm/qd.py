"""Singular values and right singular vectors of a small square matrix by its bidiagonal form.

Householder reflections make the matrix upper bidiagonal. With q and e the squares of its diagonal and superdiagonal, the
shifted differential quotient-difference transform finds the squared singular values to high relative accuracy, and a
factorisation twisted at the place where the matrix is most nearly singular gives each singular vector without a solve.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny / _EPS


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta with (I - beta v v') x along the first axis."""
    size = np.linalg.norm(x)
    if size == 0:
        return x, 0.0
    v = x / size
    v[0] += np.copysign(1.0, v[0])
    return v, 2.0 / float(v @ v)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and orthogonal ``w`` of matrix = u B w'."""
    a, size = matrix.astype(float).copy(), matrix.shape[0]
    w = np.eye(size)
    for k in range(size):
        v, beta = _reflector(a[k:, k].copy())
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < size - 2:
            v, beta = _reflector(a[k, k + 1 :].copy())
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= beta * np.outer(w[:, k + 1 :] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), w


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One transform, and the sum of the reciprocals of its differences; None if the shift was too large."""
    d = q[0] - shift
    new_q, new_e, inverse = [0.0] * len(q), [0.0] * len(e), 0.0
    for k, x in enumerate(e):
        if d < 0:
            return None
        inverse += 1 / max(d, _TINY)
        new_q[k] = total = d + x
        ratio = q[k + 1] / total if total > 0 else 1.0
        new_e[k] = x * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, inverse + 1 / max(d, _TINY)


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, falling.

    Without a shift the reciprocals of the differences add up to the trace of the inverse, whose reciprocal is a safe
    shift. What a negligible e separates goes on by itself.
    """
    found: list[float] = []
    open_parts = [((diagonal**2).tolist(), (above**2).tolist(), 0.0)]
    left = 400 * (len(diagonal) + 1)
    while open_parts:
        q, e, moved = open_parts.pop()
        while q:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= _EPS**2 * (moved + q[k + 1])), None)
            if cut is not None:
                open_parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            left -= 1
            if left < 0:
                raise ArithmeticError("the quotient-difference transform did not converge")
            q, e, inverse = _step(q, e, 0.0)
            shifted = _step(q, e, 1 / inverse)
            if shifted is not None and moved + 1 / inverse > moved:
                (q, e, _), moved = shifted, moved + 1 / inverse
    return np.sort(np.array(found))[::-1]


def _twisted(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots from the front and from the back of B'B - value, and the pivot at each twist."""
    size, least = q.size, _EPS**2 * value or _TINY
    s, p, front, back = (np.empty(size) for _ in range(4))
    s[0] = -value
    for k in range(size - 1):
        front[k] = s[k] + q[k] or least
        s[k + 1] = e[k] * (s[k] / front[k]) - value
    p[-1] = q[-1] - value
    for k in range(size - 2, -1, -1):
        back[k + 1] = e[k] + p[k + 1] or least
        p[k] = p[k + 1] * (q[k] / back[k + 1]) - value
    return front, back, s + p + value


def _vector(front: np.ndarray, back: np.ndarray, off: np.ndarray, twist: int) -> np.ndarray:
    z = np.zeros(front.size)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -off[k] / front[k] * z[k + 1]
    for k in range(twist, front.size - 1):
        z[k + 1] = -off[k] / back[k + 1] * z[k]
    return z


def _block_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) for falling values of one block. Each value is corrected by its own residual.

    Vectors of values closer than ``near`` of the largest are made orthogonal. Values that repeat to rounding may leave
    nothing of a twisted vector, or a wrong one; such a vector comes from inverse iteration inside the space that is left.
    """
    q, e, off = diagonal**2, above**2, diagonal[:-1] * above
    full = np.diag(q + np.append(0.0, e)) + np.diag(off, 1) + np.diag(off, -1)
    rng = np.random.default_rng(0)
    out, settled = np.zeros((q.size, values.size)), values.astype(float).copy()
    for j, value in enumerate(values):
        others = out[:, :j][:, np.abs(settled[:j] - value) <= near * values[0]]

        def remainder(z: np.ndarray) -> np.ndarray:
            for _ in range(2):
                z = z - others @ (others.T @ z)
            return z

        for _ in range(4):
            front, back, pivots = _twisted(q, e, value)
            twist = int(np.argmin(np.abs(pivots)))
            z = _vector(front, back, off, twist)
            step = pivots[twist] / float(z @ z)
            if not abs(step) > 2 * _EPS * value:
                break
            if abs(step) <= 1e-6 * value:  # a larger step would leave this value for a neighbour
                value += step
        best = remainder(z / np.linalg.norm(z))
        wrong = lambda z: not np.linalg.norm(full @ z - value * z) <= 1e-13 * values[0] * np.sqrt(q.size) * np.linalg.norm(z)
        if not np.linalg.norm(best) > 0.5 or wrong(best):
            value, best = float(values[j]), remainder(rng.normal(size=q.size))
            moved = full - (value + 2 * _EPS * values[0]) * np.eye(q.size)
            for _ in range(6):
                best = remainder(np.linalg.solve(moved, best / np.linalg.norm(best)))
                best = remainder(best / np.linalg.norm(best))
        out[:, j], settled[j] = best / np.linalg.norm(best), value
    return settled, out


def leading(matrix: np.ndarray, most: int, near: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All squared singular values of a square matrix, falling, then the first ``most`` of them and their right vectors.

    Values below rounding are zero and have no vectors. The bidiagonal matrix falls apart where its superdiagonal is
    below rounding: a value that repeats then belongs to several blocks, each with a vector of its own.
    """
    diagonal, above, w = bidiagonal(matrix)
    above = np.where(np.abs(above) > _EPS * (np.abs(diagonal).max(initial=0) + np.abs(above).max(initial=0)), above, 0.0)
    borders = [0, *(np.flatnonzero(above == 0) + 1).tolist(), diagonal.size]
    blocks = [slice(a, b) for a, b in zip(borders, borders[1:])]
    values = [squared_values(diagonal[b], above[b.start : b.stop - 1]) for b in blocks]
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(len(blocks)), [v.size for v in values])
    order = np.argsort(-flat, kind="stable")
    chosen = order[flat[order] > (_EPS * diagonal.size) ** 2 * flat[order[0]]][:most]
    found, z = np.zeros(chosen.size), np.zeros((diagonal.size, chosen.size))
    for k in np.unique(owner[chosen]):
        at, b = np.flatnonzero(owner[chosen] == k), blocks[k]
        found[at], z[b, at] = _block_vectors(diagonal[b], above[b.start : b.stop - 1], flat[chosen[at]], near)
    return flat[order], found, w @ z
