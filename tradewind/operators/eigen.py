"""Eigenvectors of a small symmetric matrix by Jacobi rotations.

A sweep pairs every index with every other once, in rounds of a tournament; the rotations of a round touch
disjoint pairs, so a round is one step over all cells and SQL can repeat it. The number of steps is fixed, and
so are the order and the signs: the result depends on the matrix alone.
"""

import numpy as np

SWEEPS = 10
# Digits at which the sizes of loadings are compared.
SIGN_DIGITS = 6
# Cells this small need no rotation.
NOTHING = 1e-60


def opponents(p: int, t: int) -> np.ndarray:
    """Whom each of `p` indices meets in round `t`; itself, where it sits out."""
    rounds = p - 1 + p % 2
    index = np.arange(p)
    found = (2 * t - index) % rounds
    # The one who would meet itself meets the last index, which is outside the circle.
    alone = t % rounds
    if p % 2:
        found[alone] = alone
    else:
        found[alone], found[p - 1] = p - 1, alone
    return found


def rotated(a: np.ndarray, v: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: every pair's off-diagonal cell becomes zero."""
    index = np.arange(len(a))
    low, high = np.minimum(index, other), np.maximum(index, other)
    shared = a[low, high]
    turns = (other != index) & (np.abs(shared) > NOTHING)
    theta = (a[high, high] - a[low, low]) / (2 * np.where(turns, shared, 1))
    tangent = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
    own = np.where(turns, 1 / np.sqrt(tangent * tangent + 1), 1.0)
    cross = np.where(turns, np.where(index < other, -1, 1) * tangent * own, 0.0)
    columns = a * own + a[:, other] * cross
    return columns * own[:, None] + columns[other] * cross[:, None], v * own + v[:, other] * cross


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors as columns, their first heaviest component positive."""
    p = len(matrix)
    a, v = np.array(matrix, dtype=float), np.eye(p)
    for t in range(sweeps * (p - 1 + p % 2) if p > 1 else 0):
        a, v = rotated(a, v, opponents(p, t))
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    if p:
        heaviest = np.argmax(np.abs(v).round(SIGN_DIGITS), axis=0)
        v = v * np.where(v[heaviest, np.arange(p)] < 0, -1.0, 1.0)
    return values[order], v
