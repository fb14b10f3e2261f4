"""Distributions in numpy: gamma and beta functions, sums over lattices, and the split of a sum of negative binomial counts."""

from __future__ import annotations

import functools
import math

import numpy as np

#: Points of a lattice up to which its terms are added one by one.
PLAIN = 32
#: Nodes that stand for the points of a longer one.
NODES = 16
#: Logarithm of the share of a sum that may be left out.
NEGLIGIBLE = 45.0


def _series(z: np.ndarray) -> np.ndarray:
    """Stirling's series: ln Gamma(z) less (z - 1/2) ln z - z + ln(2 pi) / 2, for z of 8 or more."""
    i = 1 / (z * z)
    return (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i * (1 / 1188 - i * 691 / 360360))))) / z


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers: Stirling's series after shifting the argument to 8 or more."""
    x = np.asarray(x, dtype=float)
    z, product = x.copy(), np.ones_like(x)
    if x.size and x.min() < 8:
        for _ in range(8):
            low = z < 8
            product = np.where(low, product * np.where(low, z, 1), product)
            z = np.where(low, z + 1, z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + _series(z) - np.log(product)


def gamma_ratio(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """ln Gamma(x + a) - ln Gamma(x + 1) without the loss of digits of a difference of large numbers."""
    x, a = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(a, dtype=float))
    out = np.empty_like(x)
    far = x >= 16
    y, b = x[far], a[far]
    out[far] = (y + 0.5) * np.log1p((b - 1) / (y + 1)) + (b - 1) * (np.log(y + b) - 1) + _series(y + b) - _series(y + 1)
    y, b = x[~far], a[~far]
    out[~far] = lgamma(y + b) - lgamma(y + 1)
    return out


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x ln(x / m) + m - x for x of 0 or more (Loader 2000)."""
    v = (x - m) / (x + m)
    near = np.abs(v) < 0.1
    w = np.where(near, v * v, 0)
    tail = w * (1 / 3 + w * (1 / 5 + w * (1 / 7 + w * (1 / 9 + w * (1 / 11 + w * (1 / 13 + w * (1 / 15 + w / 17)))))))
    return np.where(near, (x - m) * v + 2 * x * v * tail, x * np.log(np.where(x > 0, x, 1) / m) + m - x)


def _stirling_error(x: np.ndarray) -> np.ndarray:
    """ln x! less its leading terms; 0 at 0, where they are left out."""
    return np.where(x > 0, _excess(np.where(x > 0, x, 1.0)), 0.0)


def _excess(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 15, _series(np.maximum(x, 15)), lgamma(x + 1) - (x + 0.5) * np.log(x) + x - 0.5 * math.log(2 * math.pi))


def log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of C(n, x) p^x (1 - p)^(n - x) for real x in [0, n] (Loader 2000)."""
    x, n, p = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(x, n, p))
    y = n - x
    inner = (x > 0) & (y > 0)
    a, b = np.where(inner, x, 1.0), np.where(inner, y, 1.0)
    out = _stirling_error(np.where(inner, n, 2.0)) - _stirling_error(a) - _stirling_error(b) - _deviance(a, (a + b) * p) - _deviance(b, (a + b) * (1 - p)) + 0.5 * np.log((a + b) / (2 * math.pi * a * b))
    return np.where(inner, out, np.where(x > 0, n * np.log(p), n * np.log1p(-p)))


def log_negative_binomial(x: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of Gamma(x + size) / (Gamma(size) x!) p^size (1 - p)^x."""
    return np.log(size / (size + x)) + log_binomial(size, size + x, p)


def log_split(x: np.ndarray, s: np.ndarray, n1: np.ndarray, n2: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Logarithm of the probability that x of a sum s fall to the first of two classes of n1 and n2 equal samples with dispersion phi.

    Binomial for phi = 0, else beta-binomial with n1 / phi and n2 / phi; by gamma ratios where these are small, else by saddle points.
    """
    x, s, n1, n2, phi = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(x, s, n1, n2, phi))
    out = np.empty_like(x)
    none = phi <= 0
    out[none] = log_binomial(x[none], s[none], n1[none] / (n1[none] + n2[none]))
    wide = ~none & ((n1 + n2) <= 1e4 * phi)
    a, b = n1[wide] / phi[wide], n2[wide] / phi[wide]
    out[wide] = gamma_ratio(x[wide], a) + gamma_ratio(s[wide] - x[wide], b) - gamma_ratio(s[wide], a + b) - lgamma(a) - lgamma(b) + lgamma(a + b)
    slim = ~none & ~wide
    a, b, t = n1[slim] / phi[slim], n2[slim] / phi[slim], s[slim]
    p = (a + b) / (a + b + t)
    out[slim] = log_negative_binomial(x[slim], a, p) + log_negative_binomial(t - x[slim], b, p) - log_negative_binomial(t, a + b, p)
    return out


@functools.lru_cache(maxsize=64)
def lattice_rule(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights in 0 .. width - 1 whose weighted sum is that over all points, for polynomials up to degree 2 NODES - 1.

    Gauss quadrature of the discrete Chebyshev polynomials (Golub and Welsch 1969)."""
    if width <= PLAIN:
        return np.arange(width, dtype=float), np.ones(width)
    k = np.arange(1, NODES, dtype=float)
    off = np.sqrt(k * k * (float(width) ** 2 - k * k) / (4 * (4 * k * k - 1)))
    value, vector = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    return value + (width - 1) / 2, width * vector[0] ** 2


def _one_negative_binomial(x: int, size: float, p: float) -> float:
    """log_negative_binomial() of one number, without the cost of arrays."""
    if not x:
        return size * math.log(p)
    n, out = size + x, math.log(size / (size + x))
    for sign, k, m in ((1, n, n), (-1, size, n * p), (-1, x, n * (1 - p))):
        if k >= 15:
            i = 1 / (k * k)
            out += sign * (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / k
        else:
            out += sign * (math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi))
        v = (k - m) / (k + m)
        if sign < 0 and abs(v) < 0.1:
            w = v * v
            out -= (k - m) * v + 2 * k * v * w * (1 / 3 + w * (1 / 5 + w * (1 / 7 + w * (1 / 9 + w * (1 / 11 + w * (1 / 13 + w * (1 / 15 + w / 17)))))))
        elif sign < 0:
            out -= k * math.log(k / m) + m - k
    return out + 0.5 * math.log(n / (2 * math.pi * size * x))


class Split:
    """One sum's split between two classes: its shape, and the parts of its outcomes that a tail consists of."""

    def __init__(self, s: int, n1: int, n2: int, phi: float):
        self.s, self.n1, self.n2, self.phi, self.slim = s, n1, n2, phi, False
        mean = s * n1 / (n1 + n2)
        spread = mean * n2 / (n1 + n2)
        if phi > 0:
            k = (n1 + n2) / phi
            self.a, self.b = n1 / phi, n2 / phi
            self.slim = k > 1e4
            spread *= (k + s) / (k + 1)
        self.mean, self.scale = mean, max(PLAIN, int(math.sqrt(spread)))

    def rise(self, x: int) -> float:
        """Sign of p(x + 1) - p(x); linear in x, so p has one mode, one least outcome or neither."""
        if self.phi > 0:
            return (self.a - 1) * (self.s - x) + (1 - self.b) * (x + 1)
        return self.n1 * (self.s - x) - self.n2 * (x + 1)

    def slope(self, x: int) -> float:
        """ln p(x + 1) - ln p(x)."""
        up, down = (x + self.a, self.s - x - 1 + self.b) if self.phi > 0 else (self.n1, self.n2)
        return math.log(up * (self.s - x)) - math.log((x + 1) * down)

    def height(self, x: int) -> float:
        """ln p(x) but for a constant."""
        if self.phi > 0 and self.slim:
            p = (self.a + self.b) / (self.a + self.b + self.s)
            return _one_negative_binomial(x, self.a, p) + _one_negative_binomial(self.s - x, self.b, p)
        if self.phi > 0:
            return (math.lgamma(x + self.a) - math.lgamma(x + 1)) + (math.lgamma(self.s - x + self.b) - math.lgamma(self.s - x + 1))
        return (x * math.log(self.n1) - math.lgamma(x + 1)) + ((self.s - x) * math.log(self.n2) - math.lgamma(self.s - x + 1))

    def blocks(self, first: int, last: int) -> list[tuple[int, int]]:
        """(least outcome, width) of blocks from first to last, either way, as far as they matter; in each, p is smooth on the scale of its width."""
        step = 1 if last >= first else -1
        out, x, fell = [], first, 0.0
        while (last - x) * step >= 0:
            room = abs(last - x) + 1
            turn = lambda y: self.slope(y) if step > 0 else -self.slope(y - 1)  # noqa: B023, E731
            g = turn(x) if 0 <= x + step <= self.s else 0.0
            end = self.s - x if step > 0 else x  # points to the end of all outcomes, and from the other end
            begun = x if step > 0 else self.s - x
            width = max(PLAIN, min(self.scale, int(8 / abs(g)) if abs(g) > 1e-12 else self.scale, end // 2, begun))
            width = 1 << (width.bit_length() - 1)
            if room <= max(width, PLAIN):
                width = min(room, PLAIN) if room < 2 * PLAIN else 1 << (min(room, width).bit_length() - 1)
            out.append((x if step > 0 else x - width + 1, width))
            x += step * width
            if (last - x) * step >= 0 and 0 <= x + step <= self.s:
                h = turn(x)
                fell += max(g, h) * width  # at most
                if fell < -NEGLIGIBLE and h < 0:
                    break
        return out

    def crossing(self, low: int, high: int, most: float) -> int:
        """The first of low .. high at which height() is at most `most`; high + 1 if none. Heights fall from low to high, or high to low if low > high."""
        step = 1 if high >= low else -1
        inside, outside = -1, abs(high - low) + 1  # steps at which it is above, and at which it is not
        while outside - inside > 1:
            mid = (inside + outside) // 2
            if self.height(low + step * mid) <= most:
                outside = mid
            else:
                inside = mid
        return low + step * outside

    def no_likelier(self, z: int) -> list[tuple[int, int]]:
        """Ranges of outcomes that are no likelier than z, the likeliest of a tail first: (first, last)."""
        s = self.s
        most = self.height(z) + 1e-7 + (0 if self.slim else 4e-16 * math.lgamma(s + 2))
        begins, ends = self.rise(0), self.rise(s - 1)
        if begins > 0 > ends:  # one mode
            low, high = 0, s  # the mode by bisection of the sign
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if self.rise(mid) > 0 else (low, mid)
            if self.height(low) <= most:
                return [(low, 0), (low + 1, s)] if low < s else [(low, 0)]
            left, right = self.crossing(low, 0, most), self.crossing(low, s, most)
            return [r for r in ((left, 0) if left >= 0 else None, (right, s) if right <= s else None) if r]
        if begins < 0 < ends:  # one least outcome
            low, high = 0, s
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if self.rise(mid) < 0 else (low, mid)
            return [(self.crossing(0, low, most), self.crossing(s, low, most))]
        if begins <= 0 and ends <= 0:
            return [(self.crossing(0, s, most), s)]
        return [(self.crossing(s, 0, most), 0)]


def split_pvalues(z1: np.ndarray, z2: np.ndarray, n1: np.ndarray, n2: np.ndarray, phi: np.ndarray, rule: str = "doubletail") -> np.ndarray:
    """P-values of splits z1 + z2 among n1 and n2 samples, all rows' terms in one pass; NaN where phi is.

    'doubletail': twice the smaller tail, at most 1. 'smallp': all outcomes that are no likelier than the observed one (to 1e-7). The rule
    and the way are the same at every size: blocks of outcomes are summed by quadrature, so a row takes some hundred terms whatever its sum.
    """
    if rule not in ("doubletail", "smallp"):
        raise ValueError(f"no rule {rule!r}")
    out = np.ones(len(z1))
    start: list[int] = []
    width: list[int] = []
    owner: list[int] = []
    for k, (a, b, c, d, f) in enumerate(zip(z1.tolist(), z2.tolist(), n1.tolist(), n2.tolist(), phi.tolist(), strict=True)):
        if f != f:
            out[k] = float("nan")
        if f != f or a + b == 0 or not c or not d:
            continue
        split = Split(int(a + b), int(c), int(d), float(f))
        ranges = [(a, 0 if a <= split.mean else split.s)] if rule == "doubletail" else split.no_likelier(a)
        for first, last in ranges:
            for x, w in split.blocks(int(first), int(last)):
                start.append(x)
                width.append(w)
                owner.append(k)
    if not owner:
        return out
    rules = [lattice_rule(w) for w in width]
    n = np.array([len(p) for p, _ in rules])
    row = np.repeat(owner, n)
    x = np.repeat(np.array(start, dtype=float), n) + np.concatenate([p for p, _ in rules])
    terms = np.exp(log_split(x, (z1 + z2)[row], n1[row], n2[row], phi[row])) * np.concatenate([w for _, w in rules])
    tail = np.bincount(row, weights=terms, minlength=len(out))
    rows = np.unique(owner)
    if rule == "doubletail":
        own = np.exp(log_split(z1[rows], (z1 + z2)[rows], n1[rows], n2[rows], phi[rows]))
        out[rows] = np.minimum(1, 2 * np.minimum(tail[rows], 1 - tail[rows] + own))
    else:
        out[rows] = np.minimum(1, tail[rows])
    return out


class Draw(Split):
    """k drawn of m marked and n others: how many are marked, less the least possible number."""

    def __init__(self, m: int, n: int, k: int):
        self.m, self.n, self.k, self.low = m, n, k, max(0, k - n)
        self.s = min(k, m) - self.low
        total = m + n
        self.mean = k * m / total - self.low if total else 0.0
        spread = k * m / total * n / total * (total - k) / max(1, total - 1) if total else 0.0
        self.scale = max(PLAIN, int(math.sqrt(spread)))

    def slope(self, x: int) -> float:
        x += self.low
        return math.log((self.m - x) * (self.k - x)) - math.log((x + 1) * (self.n - self.k + x + 1))


def log_hypergeometric(x: np.ndarray, m: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Logarithm of C(m, x) C(n, k - x) / C(m + n, k), by saddle points."""
    p = k / (m + n)
    return log_binomial(x, m, p) + log_binomial(k - x, n, p) - log_binomial(k, m + n, p)


def hypergeometric_tails(x: np.ndarray, m: np.ndarray, n: np.ndarray, k: np.ndarray, tail: str = "lower") -> np.ndarray:
    """P(X <= x) for tail='lower', P(X >= x) for 'upper', X the marked among k drawn of m marked and n others.

    The tail on the side away from the mean is summed in blocks, as in split_pvalues(), and the other is the rest; a row takes some hundred terms whatever its numbers.
    """
    out = np.empty(len(x))
    start: list[int] = []
    width: list[int] = []
    owner: list[int] = []
    rest = np.zeros(len(x), dtype=bool)
    for r, (a, b, c, d) in enumerate(zip(x.tolist(), m.tolist(), n.tolist(), k.tolist(), strict=True)):
        draw = Draw(int(b), int(c), int(d))
        at = int(a) - draw.low
        if tail == "upper":
            at -= 1  # what is left out of P(X > at)
        if at < 0 or at >= draw.s:
            out[r] = float((at >= draw.s) == (tail == "lower"))
            continue
        below = at <= draw.mean
        rest[r] = below != (tail == "lower")
        for y, w in draw.blocks(at, 0) if below else draw.blocks(at + 1, draw.s):
            start.append(y + draw.low)
            width.append(w)
            owner.append(r)
    if owner:
        rules = [lattice_rule(w) for w in width]
        count = np.array([len(p) for p, _ in rules])
        row = np.repeat(owner, count)
        at = np.repeat(np.array(start, dtype=float), count) + np.concatenate([p for p, _ in rules])
        terms = np.exp(log_hypergeometric(at, m[row], n[row], k[row])) * np.concatenate([w for _, w in rules])
        total = np.bincount(row, weights=terms, minlength=len(out))
        rows = np.unique(owner)
        out[rows] = np.clip(np.where(rest[rows], 1 - total[rows], total[rows]), 0, 1)
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 20_000):  # about the root of a and b
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h if swap else front * h


def log_gamma_tails(x: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the lower and the upper tail of the gamma distribution of shape a and scale 1 at x > 0.

    The smaller one by its series or continued fraction (Lentz), so that it keeps its digits; the other is the rest."""
    x, a = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(x, a))
    low, high = np.empty_like(x), np.empty_like(x)
    lower = x < a + 1
    front = np.where(a < 1e4, a * np.log(x) - x - lgamma(a + 1), -_deviance(a, x) - _series(np.maximum(a, 8)) - 0.5 * np.log(2 * math.pi * a))  # x^a e^-x / Gamma(a + 1)
    low[lower] = np.minimum(front[lower] + np.log(_lower_sum(x[lower], a[lower])), 0)
    high[lower] = np.log(-np.expm1(np.minimum(low[lower], -1e-17)))
    high[~lower] = np.minimum(front[~lower] + np.log(_upper_fraction(x[~lower], a[~lower])) + np.log(a[~lower]), 0)
    low[~lower] = np.log(-np.expm1(np.minimum(high[~lower], -1e-17)))
    return low, high


def _lower_sum(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """1 + x / (a + 1) + x^2 / ((a + 1) (a + 2)) + ...; rows that have settled leave the arrays."""
    out, at = np.ones_like(x), np.arange(len(x))
    term, total, k = np.ones_like(x), np.ones_like(x), 0
    while len(at):
        for _ in range(16):
            k += 1
            term = term * x / (a + k)
            total = total + term
        out[at] = total
        more = term > total * 1e-17
        at, x, a, term, total = at[more], x[more], a[more], term[more], total[more]
    return out


def _upper_fraction(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The continued fraction of the upper tail for x of a + 1 or more; rows that have settled leave the arrays."""
    tiny = 1e-300
    out, at = np.ones_like(x), np.arange(len(x))
    c, d = np.full_like(x, 1 / tiny), 1 / (x + 1 - a)
    h, k = d, 0
    while len(at):
        for _ in range(8):
            k += 1
            num, base = -k * (k - a), x + 2 * k + 1 - a
            d = num * d + base
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = base + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        out[at] = h
        more = np.abs(c * d - 1) > 2e-16
        at, x, a, c, d, h = at[more], x[more], a[more], c[more], d[more], h[more]
    return out


def gamma_quantile(log_p: np.ndarray, upper: np.ndarray, a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """x at which the gamma distribution of shape a has that logarithm of its tail; upper tells which tail.

    Newton's method on the logarithm of the tail as a function of ln x from `start`, kept inside a bracket by bisection.
    Rows that have settled leave the arrays."""
    log_p, upper, a = np.broadcast_arrays(np.asarray(log_p, dtype=float), np.asarray(upper, dtype=bool), np.asarray(a, dtype=float))
    out, at = np.empty(a.shape), np.arange(len(a))
    lo, hi = np.full(a.shape, -700.0), np.log(a + 50 * np.sqrt(a) + 800 + 2 * np.maximum(0, -log_p))
    u = np.clip(np.log(np.maximum(start, 1e-300)), lo, hi)
    for _ in range(200):
        x = np.exp(u)
        below, above = log_gamma_tails(x, a)
        tail = np.where(upper, above, below)
        over = (tail > log_p) == ~upper  # x is too large
        hi, lo = np.where(over, u, hi), np.where(over, lo, u)
        slope = np.where(upper, -1, 1) * np.exp(np.clip(_log_density(x, a) + u - tail, -700, 700))
        then = u - (tail - log_p) / slope
        then = np.where(np.isfinite(then) & (then > lo) & (then < hi), then, (lo + hi) / 2)
        out[at] = np.exp(then)
        more = np.abs(then - u) > 1e-13 * np.maximum(1, np.abs(u))
        if not more.any():
            break
        at, log_p, upper, a, lo, hi, u = at[more], log_p[more], upper[more], a[more], lo[more], hi[more], then[more]
    return out


def _log_density(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma density of shape a."""
    return np.where(a < 1e4, (a - 1) * np.log(x) - x - lgamma(a), -_deviance(a, x) - _series(np.maximum(a, 8)) + 0.5 * np.log(a / (2 * math.pi)) - np.log(x))


def moved_counts(y: np.ndarray, before: np.ndarray, after: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Counts of mean `before` as counts of mean `after`, both negative binomial with dispersion phi: the place of the same quantile.

    The quantile is that of a normal and of a gamma distribution of the same mean and variance, of which the mean is taken, each from the tail on the
    count's side of the mean (Robinson and Smyth 2008). Means of next to nothing are raised by a quarter.
    """
    y, before, after, phi = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(y, before, after, phi))
    little = (before < 1e-14) | (after < 1e-14)
    before, after = before + 0.25 * little, after + 0.25 * little
    r1, r2 = 1 + phi * before, 1 + phi * after
    normal = after + (y - before) * np.sqrt(after * r2 / (before * r1))
    upper = y >= before
    low, high = log_gamma_tails(np.maximum(y, 1e-300) / r1, before / r1)
    gamma = np.where(y > 0, gamma_quantile(np.where(upper, high, low), upper, after / r2, np.where(normal > 0, normal, after / 2) / r2) * r2, 0.0)
    return np.where(before == after, y, np.maximum(0, (normal + gamma) / 2))


def mean_rates(y: np.ndarray, size: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Per row the share b with means size * b that is most likely for negative binomial counts; y, size: rows of samples, sizes of 0 are left out."""
    b = y.sum(axis=1) / np.maximum(size.sum(axis=1), 1e-300)
    phi = np.asarray(phi, dtype=float).reshape(-1, 1)
    for _ in range(50):
        w = np.where(size > 0, 1 / (1 + phi * size * b[:, None]), 0)
        then = (w * y).sum(axis=1) / np.maximum((w * size).sum(axis=1), 1e-300)
        done = np.abs(then - b) <= 1e-14 * np.abs(b)
        b = then
        if done.all():
            break
    return b
