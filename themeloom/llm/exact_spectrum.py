"""Leading eigenpairs of a symmetric integer matrix from its exact characteristic polynomial.

The polynomial is worked out modulo many primes (reduction to Hessenberg form) and put together by the Chinese remainder
theorem. All its roots are real, so the sign changes of the shifted polynomial count the roots above any
point exactly; bisection isolates the largest ones to any precision. Inverse iteration in high precision gives the null space
of the matrix less its root.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import isqrt

import numpy as np

#: Bits to which a root is known, relative to the largest one; roots that agree so far count as one multiple root.
BITS = 256
#: Decimal digits of the inverse iteration.
DIGITS = 130


def primes(below: int = (1 << 31) - 1) -> Iterator[int]:
    """Primes downwards from ``below``; products of two residues fit 64 bits."""
    p = below | 1
    while True:
        # these three bases decide every number below 4,759,123,141
        if all(_passes(p, a) for a in (2, 7, 61)):
            yield p
        p -= 2


def _passes(n: int, base: int) -> bool:
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(base, odd, n)
    return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1))


def primes_needed(matrix: list[list[int]]) -> list[int]:
    """Primes whose product exceeds twice every coefficient: each is a sum of principal minors, and
    ``(1 + r) ** d`` bounds the sum of all of them, r being the largest row norm."""
    d = len(matrix)
    norm = max((isqrt(sum(x * x for x in row)) + 1 for row in matrix), default=1)
    bits, found, source = 2 + d * (1 + norm).bit_length(), [], primes()
    while bits > 0:
        found.append(next(source))
        bits -= found[-1].bit_length() - 1
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(xI - matrix) modulo ``p``, lowest first; ``matrix`` holds residues."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for k in range(1, d - 1):
        at = np.flatnonzero(h[k:, k - 1])
        if not len(at):
            continue
        pivot = k + int(at[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        # a similarity: rows less factor times row k, then column k plus factor times the columns
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(1)) % p
    # polynomials of the leading blocks, by expansion along the last column
    made = np.zeros((d + 1, d + 1), np.int64)
    made[0, 0] = 1
    for k in range(1, d + 1):
        made[k, 1:] = made[k - 1, :-1]
        made[k] = (made[k] - h[k - 1, k - 1] * made[k - 1] % p) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            made[k] = (made[k] - int(h[i - 1, k - 1]) * below % p * made[i - 1] % p) % p
    return made[d].tolist()


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """Integer coefficients from those modulo each prime (Chinese remainders, signed)."""
    values, modulus = None, 1
    for p, mine in residues.items():
        if values is None:
            values, modulus = [int(c) for c in mine], p
            continue
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((c - v) * inverse % p) for v, c in zip(values, mine, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def roots_above(coefficients: list[int], point: int, shift: int) -> int:
    """How many roots exceed ``point / 2**shift``: sign changes after moving that point to zero."""
    d = len(coefficients) - 1
    # the polynomial of x * 2**shift has integer coefficients
    c = [v << (shift * (d - i)) for i, v in enumerate(coefficients)]
    for low in range(d):
        for i in range(d - 1, low - 1, -1):
            c[i] += point * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], count: int) -> list[tuple[int, int, int]]:
    """``(root, shift, multiplicity)`` of the largest positive roots, falling, until ``count`` are covered.

    A root is ``root / 2**shift``, known to BITS bits relative to the largest one, times 2.
    """
    bound = 1 + max((abs(v) for v in coefficients[:-1]), default=0)
    top = 1
    while top < bound and roots_above(coefficients, top, 0):
        top *= 2
    shift = max(0, BITS - top.bit_length())
    out, covered, high, above = [], 0, top << shift, 0
    low, positive = 0, roots_above(coefficients, 0, 0)
    while covered < min(count, positive):
        # the next root down: bisect for the largest point that has more roots above it than are known
        a, b = low, high
        n = positive
        # coarse steps first: short numbers while the interval is wide
        step = shift
        while b - a > 1:
            middle = (a + b) // 2
            drop = max(0, (b - a).bit_length() - 3)
            middle = middle >> drop << drop
            if not a < middle < b:
                middle = (a + b) // 2
                drop = 0
            cut = min(drop, step)
            found = roots_above(coefficients, middle >> cut, shift - cut)
            if found > above:
                a, n = middle, found
            else:
                b = middle
            if n == above + 1 and (fine := _simple(coefficients, a, b, shift)) is not None:
                a = fine
                break
        # the root lies above a, at most one unit away
        out.append((2 * a + 1, shift + 1, n - above))
        covered += n - above
        above, high = n, a + 1
    return out


def _simple(coefficients: list[int], a: int, b: int, shift: int) -> int | None:
    """The place of the only root in (a, b], by signs alone; None if an end is a root."""
    at = lambda x: _sign(coefficients, x, shift)
    left, right = at(a), at(b)
    if left * right >= 0:
        return None
    while b - a > 1:
        middle = (a + b) // 2
        sign = at(middle)
        if sign == 0:
            return middle - 1
        if sign == left:
            a = middle
        else:
            b = middle
    return a


def _sign(coefficients: list[int], point: int, shift: int) -> int:
    d, total = len(coefficients) - 1, 0
    for i in range(d, -1, -1):
        total = total * point + (coefficients[i] << (shift * (d - i)))
    return (total > 0) - (total < 0)


def null_space(matrix: list[list[int]], root: int, shift: int, multiplicity: int) -> list[list[Decimal]]:
    """Orthonormal vectors that ``matrix - root / 2**shift`` all but annihilates, by inverse iteration."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        scale = Decimal(max(abs(x) for row in matrix for x in row))
        # the root is known to half a unit of 2**-shift, so the matrix less it can be inverted
        value = Decimal(root) / (Decimal(2) ** shift) / scale
        rows = [[Decimal(x) / scale for x in row] for row in matrix]
        for i in range(d):
            rows[i][i] -= value
        order = _decompose(rows)
        # fixed starting vectors without structure
        start = np.random.default_rng(13).integers(1, 1 << 30, (multiplicity, d))
        block = [[Decimal(int(x)) for x in row] for row in start]
        for _ in range(4):
            block = _orthonormal([_solve(rows, order, v) for v in block])
    return block


def _decompose(rows: list[list[Decimal]]) -> list[int]:
    """Triangular factors in place, with the order of rows taken; a vanishing pivot becomes a tiny one."""
    d = len(rows)
    order = list(range(d))
    tiny = Decimal(10) ** (15 - DIGITS)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(rows[i][k]))
        if best != k:
            rows[k], rows[best] = rows[best], rows[k]
            order[k], order[best] = order[best], order[k]
        if abs(rows[k][k]) < tiny:
            rows[k][k] = tiny
        pivot, source = rows[k][k], rows[k]
        for i in range(k + 1, d):
            row = rows[i]
            if row[k]:
                factor = row[k] / pivot
                row[k] = factor
                for j in range(k + 1, d):
                    row[j] -= factor * source[j]
    return order


def _solve(rows: list[list[Decimal]], order: list[int], v: list[Decimal]) -> list[Decimal]:
    d = len(rows)
    x = [v[i] for i in order]
    for i in range(d):
        row = rows[i]
        x[i] -= sum((row[j] * x[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        row = rows[i]
        x[i] = (x[i] - sum((row[j] * x[j] for j in range(i + 1, d)), Decimal(0))) / row[i]
    return x


def _orthonormal(block: list[list[Decimal]]) -> list[list[Decimal]]:
    out: list[list[Decimal]] = []
    for v in block:
        size = max(abs(x) for x in v)
        v = [x / size for x in v]
        for _ in range(2):
            for u in out:
                along = sum((a * b for a, b in zip(u, v, strict=True)), Decimal(0))
                v = [b - along * a for a, b in zip(u, v, strict=True)]
        norm = sum((x * x for x in v), Decimal(0)).sqrt()
        out.append([x / norm for x in v])
    return out
