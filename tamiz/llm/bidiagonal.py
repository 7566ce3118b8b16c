"""Leading right singular vectors of a small triangular matrix.

Householder reflections make it bidiagonal; dqds (quotients and differences
with shifts) finds the squared singular values, each to high relative accuracy;
a twisted factorisation at each value gives its vector.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Off-diagonals below this share of what stands beside them count as zero.
_SMALL = (10 * EPS) ** 2
#: Values nearer than this share of the largest have their vectors turned
#: against each other.
CLOSE = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): diagonal and superdiagonal of a bidiagonal B with
    ``r = u B v'`` for some orthogonal u. ``r`` is square."""
    r, n = np.array(r, float), len(r)
    v = np.eye(n)

    def reflect(x: np.ndarray) -> np.ndarray | None:
        """Unit vector w of which I - 2ww' takes x to a multiple of the first axis."""
        size = np.linalg.norm(x)
        if not np.linalg.norm(x[1:]):
            return None
        w = x / size
        w[0] += np.copysign(1.0, w[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        if (w := reflect(r[k:, k])) is not None:
            r[k:, k:] -= 2 * np.outer(w, w @ r[k:, k:])
        if k < n - 2 and (w := reflect(r[k, k + 1 :])) is not None:
            r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges between which the superdiagonal is negligible."""
    size = np.abs(a[:-1]) + np.abs(a[1:])
    least = np.finfo(float).tiny
    cuts = np.flatnonzero(np.abs(b) <= EPS * size + least) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]))


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if the shift is above the least value."""
    d, n = q[0] - shift, len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
    new_q[-1] = d
    return None if d < 0 else (new_q, new_e)


def _shift(q: list[float], e: list[float]) -> float:
    """A value below the least one, near it as the last rows come loose: the
    lesser value of the last two rows less what ties them to the rest."""
    x, y, tie = q[-2] + e[-2] if len(e) > 1 else q[-2], q[-1] + e[-1], (q[-2] * e[-1]) ** 0.5
    half = (x - y) / 2
    root = (half * half + tie * tie) ** 0.5
    low = y - tie * tie / (half + root) if half + root > 0 else y
    if len(e) < 2:
        return max(0.0, low)
    first = tie / (tie * tie + (x - low) ** 2) ** 0.5 if tie else 0.0
    return max(0.0, low - (q[-3] * e[-2]) ** 0.5 * first)


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling."""
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if not scale:
        return np.zeros(len(a))
    # A zero on the diagonal counts as one that is lost in the others' rounding.
    a = np.maximum(np.abs(a) / scale, 1e-25)
    out, work = [], [((a[i:j] ** 2).tolist(), ((b[i : j - 1] / scale) ** 2).tolist(), 0.0) for i, j in blocks(a, b / scale)]
    while work:
        q, e, done = work.pop()
        if q[0] * 1.5 < q[-1]:
            q, e = q[::-1], e[::-1]
        for _ in range(60 * len(q) + 100):
            while e and e[-1] <= _SMALL * (done + q[-1]):
                out.append(done + q.pop())
                e.pop()
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= _SMALL * (done + q[k])), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], done))
                q, e = q[cut + 1 :], e[cut + 1 :]
            if not e:
                out.append(done + q[0])
                break
            shift = _shift(q, e)
            for s in (shift, 0.75 * shift, 0.25 * shift, 0.0):
                if (swept := _sweep(q, e, s)) is not None:
                    (q, e), done = swept, done + s
                    break
        else:
            raise ArithmeticError("singular values did not settle")
    return np.sort(np.array(out))[::-1] * scale * scale


def _stationary(a2: list[float], b2: list[float], value: float, least: float) -> tuple[list[float], list[float]]:
    """Pivots and remainders of B'B - value, from the top."""
    s, pivots, left = -value, [], []
    for i in range(len(a2)):
        left.append(s)
        pivots.append(p if abs(p := a2[i] + s) > least else least)
        if i < len(b2):
            s = b2[i] / pivots[i] * s - value
    return pivots, left


def _progressive(a2: list[float], b2: list[float], value: float, least: float) -> tuple[list[float], list[float]]:
    """Pivots and remainders of B'B - value, from the bottom."""
    n = len(a2)
    p, pivots, left = a2[-1] - value, [0.0] * n, [0.0] * n
    left[-1] = p
    for i in range(n - 2, -1, -1):
        pivots[i + 1] = x if abs(x := b2[i] + p) > least else least
        p = p * (a2[i] / pivots[i + 1]) - value
        left[i] = p
    return pivots, left


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of B'B for one of its values: factorised from the top and
    from the bottom to the row where the remainder is least, and solved from
    there outwards."""
    n, a2, b2 = len(a), (a * a).tolist(), (b * b).tolist()
    least = EPS * EPS * max(max(a2), value, np.finfo(float).tiny)
    down, s = _stationary(a2, b2, value, least)
    up, p = _progressive(a2, b2, value, least)
    twist = int(np.argmin(np.abs(np.array(s) + np.array(p) + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    ab = (a[:-1] * b).tolist()
    for i in range(twist - 1, -1, -1):
        z[i] = -ab[i] / down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -ab[i] / up[i + 1] * z[i]
    return z / np.linalg.norm(z)


def _solved(a: np.ndarray, b: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    """(B'B - value)^-1 x, normed."""
    a2, b2 = (a * a).tolist(), (b * b).tolist()
    pivots, _ = _stationary(a2, b2, value, EPS * max(max(a2), value))
    low = a[:-1] * b / np.array(pivots[:-1])
    x = x.copy()
    for i in range(len(low)):
        x[i + 1] -= low[i] * x[i]
    x /= pivots
    for i in range(len(low) - 1, -1, -1):
        x[i] -= low[i] * x[i + 1]
    return x / np.linalg.norm(x)


def _apart(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            x = x - (o @ x) * o
    return x


def leading_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``k`` largest squared singular values of a square
    ``r`` and unit right singular vectors as columns, in falling order."""
    a, b, v = bidiagonalise(r)
    found = []
    for i, j in blocks(a, b):
        own = squared_singular_values(a[i:j], b[i : j - 1])
        found += [(float(x), i, j, place) for place, x in enumerate(own)]
    found.sort(key=lambda f: -f[0])
    if not found or not found[0][0]:
        return np.zeros(min(k, len(a))), np.eye(len(a))[:, :k]
    # All of a close group are computed, so that its span is right.
    wide = min(k, len(found))
    while wide < len(found) and found[wide - 1][0] - found[wide][0] <= CLOSE * found[0][0] and wide < k + 64:
        wide += 1
    rng, columns = np.random.default_rng(11), []
    for value, i, j, _ in found[:wide]:
        near = [z for other, o, _, z in columns if o == i and other - value <= CLOSE * found[0][0]]
        z = _apart(twisted_vector(a[i:j], b[i : j - 1], value), near)
        for _ in range(6):
            size = np.linalg.norm(z)
            if size > 0.5:
                break
            z = _apart(_solved(a[i:j], b[i : j - 1], value, _apart(rng.normal(size=j - i), near)), near)
        columns.append((value, i, j, z / np.linalg.norm(z)))
    z = np.zeros((len(a), wide))
    for c, (_, i, j, own) in enumerate(columns):
        z[i:j, c] = own
    z = np.linalg.qr(z)[0]
    image = a[:, None] * z
    image[:-1] += b[:, None] * z[1:]
    image, z = _turned(image, z)
    order = np.argsort(-(image * image).sum(0), kind="stable")[: min(k, wide)]
    values = np.array([f[0] for f in found[: len(order)]])
    return values, v @ z[:, order]


def _turned(image: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns turned until all images are at right angles."""
    image, z = image.copy(), z.copy()
    for _ in range(30):
        turned = False
        for i in range(z.shape[1]):
            for j in range(i + 1, z.shape[1]):
                x, y, xy = image[:, i] @ image[:, i], image[:, j] @ image[:, j], image[:, i] @ image[:, j]
                if abs(xy) <= 4 * EPS * np.sqrt(x * y) or not xy:
                    continue
                turned = True
                t = (y - x) / (2 * xy)
                t = np.copysign(1.0, t) / (abs(t) + np.sqrt(1 + t * t))
                c = 1 / np.sqrt(1 + t * t)
                for m in (image, z):
                    m[:, [i, j]] = m[:, [i, j]] @ np.array([[c, c * t], [-c * t, c]])
        if not turned:
            break
    return image, z
