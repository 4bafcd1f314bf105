"""Closed-form functions of columns: kernels, gates, images, sequences, history coefficients. All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def quantised(x, digits: int = 6) -> Column:
    """Half-up in both engines; rounding functions differ between them."""
    y = _c(x) * 10.0**digits + 0.5
    # floor gives a long: values from 2^53 on are whole as they are, and those that aren't finite stay
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y) / 10.0**digits


def squared_distance(a, b) -> Column:
    """Sum in coordinate order, as doubles."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, t: s + t)


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, t: s + t.cast("double") * t.cast("double")))


def normalised(a) -> Column:
    """x / |x|; the zero vector stays."""
    n = norm(a)
    return F.transform(_c(a), lambda t: t / F.when(n == 0, 1.0).otherwise(n))


def power(x: Column, n: int) -> Column:
    out = F.lit(1.0)
    for _ in range(n):
        out = out * x
    return out


def phs(r, m: int) -> Column:
    """r^m for odd m; r^m ln r for even m, 0 at r = 0."""
    r = _c(r)
    return power(r, m) if m % 2 else F.when(r == 0, 0.0).otherwise(power(r, m) * F.log(r + 2e-16))


def phs_laplacian(r, m: int, dim: int) -> Column:
    """Laplacian of r^m, odd m."""
    return F.lit(float(m * (dim + m - 2))) * power(_c(r), m - 2)


def phs_slope(r, m: int) -> Column:
    """phi'(r) / r of r^m, odd m."""
    return F.lit(float(m)) * power(_c(r), m - 2)


def wendland_c4(s) -> Column:
    s = _c(s)
    return F.when(s < 1, power(1 - s, 6) * (1 + 6 * s + 35 * s * s / 3)).otherwise(0.0)


def pu_weight(s) -> Column:
    s = _c(s)
    return F.when(s < 1, power(1 - s, 8) * (32 * s * s * s + 25 * s * s + 8 * s + 1)).otherwise(0.0)


def matern(r, length: float, p: int = 2) -> Column:
    """Half-integer Matern, nu = p + 1/2."""
    z = _c(r) * (math.sqrt(2 * p + 1) / length)
    terms = [math.factorial(p) / math.factorial(2 * p) * math.factorial(p + i) / (math.factorial(i) * math.factorial(p - i)) * 2 ** (p - i) * power(z, p - i) for i in range(p + 1)]
    return F.exp(-z) * sum(terms[1:], terms[0])


def gaussian(r, length: float) -> Column:
    return F.exp(-power(_c(r) / length, 2) / 2)


def compact_gate(s) -> Column:
    """1 up to one half, 0 from 1, a C4 step between."""
    s = _c(s)
    t = 2 * (1 - s)
    step = power(t, 5) * (126 - 420 * t + 540 * t * t - 315 * t * t * t + 70 * power(t, 4))
    return F.when(s <= 0.5, 1.0).when(s >= 1, 0.0).otherwise(step)


def away_round(x) -> Column:
    """Nearest whole number, ties away from zero."""
    x = _c(x)
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def minimum_image(d, length: float) -> Column:
    """A coordinate difference on a circle of the given length."""
    return _c(d) - length * away_round(_c(d) / length)


def wrapped(x, length: float = 1.0) -> Column:
    return _c(x) - length * F.floor(_c(x) / length)


def sphere_chord(dot) -> Column:
    return F.sqrt(F.greatest(2 - 2 * _c(dot), F.lit(0.0)))


def periodic_chord(angle) -> Column:
    return F.sqrt(F.greatest(2 - 2 * F.cos(_c(angle)), F.lit(0.0)))


def radical_inverse(n, base: int = 2, digits: int = 32) -> Column:
    """Digit reversal behind the point."""
    rest, out, share = _c(n).cast("long"), F.lit(0.0), 1.0
    count = min(digits, int(53 * math.log(2) / math.log(base)))
    for k in range(count):
        share /= base
        out = out + F.pmod(F.floor(rest / float(base**k)).cast("long"), F.lit(base)) * share
    return out


def fibonacci_sphere(k, n: int) -> tuple[Column, Column, Column]:
    """Point k of n, evenly over the unit sphere; a turn of 2 pi over the golden ratio from each to the next. Beyond the last point
    x and y are no numbers."""
    z = 1 - 2 * (_c(k) + 0.5) / float(n)
    ring, turn = F.sqrt(1 - z * z), 2 * math.pi / ((1 + math.sqrt(5)) / 2)
    return ring * F.cos(_c(k) * turn), ring * F.sin(_c(k) * turn), z


def lat_lon(lat, lon) -> tuple[Column, Column, Column]:
    return F.cos(_c(lat)) * F.cos(_c(lon)), F.cos(_c(lat)) * F.sin(_c(lon)), F.sin(_c(lat))


def stereographic(x, y, z) -> tuple[Column, Column]:
    return _c(x) / (1 - _c(z)), _c(y) / (1 - _c(z))


def hyperviscosity_scale(k: int, q: int, dim: int, h: float, speed: float, tau: float) -> float:
    return (-1.0) ** (1 - k) * float(dim) ** (-k) * 2.0 ** (q - 2 * k) * h ** (2 * k - q) * speed * tau


#: Fixed values of backward differences: the implicit factor, then the newest level first.
BDF = {1: (1.0, (1.0,)), 2: (2 / 3, (4 / 3, -1 / 3)), 3: (6 / 11, (18 / 11, -9 / 11, 2 / 11))}
EXTRAPOLATION = {1: (1.0,), 2: (2.0, -1.0), 3: (3.0, -3.0, 1.0)}


def winding_reliable(coarse, fine, tolerance: float) -> Column:
    """Both finite and on one side of one half, the fine one near a whole number, and further from one half than the two
    differ plus the tolerance."""
    a, b = _c(coarse), _c(fine)
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    near = F.abs(b - F.floor(b + 0.5)) <= tolerance
    apart = F.abs(b - 0.5) > F.abs(a - b) + tolerance
    return F.when(finite(a) & finite(b), ((a > 0.5) == (b > 0.5)) & apart & near).otherwise(False)


def ghost(x, normal, step: float) -> Column:
    """x + step * normal."""
    return F.zip_with(_c(x), _c(normal), lambda p, q: p + step * q)


def phs_second(r, da, db, m: int, same: bool) -> Column:
    """Second derivative of r^m (even m: r^m ln r) along axes a and b, with coordinate differences da and db; 0 at r = 0."""
    r, da, db = _c(r), _c(da), _c(db)
    if m % 2:
        mixed = F.lit(float(m * (m - 2))) * da * db * F.pow(r, F.lit(float(m - 4)))
        own = F.lit(float(m)) * power(r, m - 2)
    else:
        log = F.log(r + 2e-16)
        mixed = F.pow(r, F.lit(float(m - 4))) * da * db * (2.0 * m - 2.0 + (m * m - 2.0 * m) * log)
        own = power(r, m - 2) * (1.0 + m * log)
    return F.when(r > 0, own + mixed if same else mixed).otherwise(0.0)


def phs_iterated_laplacian(r, m: int, dim: int, times: int) -> Column:
    """The Laplacian, `times` over, of r^m (odd m); 0 where it isn't finite."""
    c = math.prod((m - 2 * s) * (m + dim - 2 - 2 * s) for s in range(times))
    e = m - 2 * times
    r = _c(r)
    return F.lit(float(c)) * power(r, e) if e >= 0 else F.when(r > 0, float(c) * F.pow(r, F.lit(float(e)))).otherwise(0.0)


def anisotropic_gaussian(x, y, lower: list[list[float]]) -> Column:
    """exp(-d' L L' d / 2) of the difference d of two arrays, L lower triangular: half the sum of squares of L' d."""
    n, x, y = len(lower), _c(x), _c(y)
    parts = [sum((F.lit(float(lower[i][j])) * (x[i] - y[i]) for i in range(j + 1, n)), F.lit(float(lower[j][j])) * (x[j] - y[j])) for j in range(n)]
    return F.exp(-0.5 * sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def gibbs(d2, sx, sy) -> Column:
    """Gaussian kernel of widths that vary from point to point: the square root of 2 sx sy / (sx^2 + sy^2), times exp(-d^2 / (sx^2 + sy^2))."""
    total = _c(sx) * _c(sx) + _c(sy) * _c(sy)
    return F.sqrt(2.0 * _c(sx) * _c(sy) / total) * F.exp(-_c(d2) / total)


def spectral_mixture(x, y, weights: list[float], frequencies: list[list[float]], scales: list[float]) -> Column:
    """The sum over components and coordinates of weight * cos(frequency . d) * exp(-d_k^2 / (2 exp(2 scale)))."""
    x, y, n, out = _c(x), _c(y), len(frequencies[0]), F.lit(0.0)
    for w, f, s in zip(weights, frequencies, scales):
        phase = sum((f[k] * (x[k] - y[k]) for k in range(1, n)), f[0] * (x[0] - y[0]))
        bells = [F.exp(-0.5 * (x[k] - y[k]) * (x[k] - y[k]) / math.exp(2 * s)) for k in range(n)]
        out = out + w * F.cos(phase) * sum(bells[1:], bells[0])
    return out


def spherical(x, y, z) -> tuple[Column, Column, Column]:
    """Azimuth, elevation and radius."""
    x, y, z = _c(x), _c(y), _c(z)
    return F.atan2(y, x), F.atan2(z, F.sqrt(x * x + y * y)), F.sqrt(x * x + y * y + z * z)


def gnomonic(x, y, z) -> tuple[Column, Column]:
    """Central projection to the plane z = 1, of points above the equator."""
    return _c(x) / _c(z), _c(y) / _c(z)


def fmix32(h) -> Column:
    """A 32-bit finaliser in a long; products are split so that none overflows. Its multipliers are fixed values."""
    full = F.lit(0xFFFFFFFF)

    def times(v: Column, c: int) -> Column:
        high = F.shiftleft((v * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
        return (v * F.lit(c & 0xFFFF) + high).bitwiseAND(full)

    h = _c(h).cast("long").bitwiseAND(full)
    h = times(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), 0x85EBCA6B)
    h = times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def content_id(coordinates: list, offset: int = 0) -> Column:
    """A deterministic id of a point: its coordinates in units of 1e-10, weighted by powers of 104729, modulo 8e14 (fixed
    values), in whole decimal numbers. Coordinates below 1e5 in magnitude and three dimensions fit."""
    out = F.lit(0).cast("decimal(38,0)")
    for k, x in enumerate(coordinates):
        out = out + F.rint(_c(x) * 1e10).cast("decimal(17,0)") * F.lit(104729**k).cast("decimal(12,0)")
    return (F.abs(out) % F.lit(800_000_000_000_000).cast("decimal(38,0)")).cast("long") + F.lit(offset)


def rk3(point: list[Column], t: float, dt: float, velocity) -> list[Column]:
    """One Ralston step of third order: stages at 0, 1/2 and 3/4, weights 2, 3 and 4 ninths. velocity(t, point) gives columns."""
    k1 = velocity(t, point)
    k2 = velocity(t + dt / 2, [p + dt * k / 2 for p, k in zip(point, k1)])
    k3 = velocity(t + 3 * dt / 4, [p + 3 * dt * k / 4 for p, k in zip(point, k2)])
    return [p + dt * (2 * a + 3 * b + 4 * c) / 9 for p, a, b, c in zip(point, k1, k2, k3)]


def rk4(point: list[Column], t: float, dt: float, velocity) -> list[Column]:
    """The classical step of fourth order."""
    k1 = velocity(t, point)
    k2 = velocity(t + dt / 2, [p + dt * k / 2 for p, k in zip(point, k1)])
    k3 = velocity(t + dt / 2, [p + dt * k / 2 for p, k in zip(point, k2)])
    k4 = velocity(t + dt, [p + dt * k for p, k in zip(point, k3)])
    return [p + dt * (a + 2 * b + 2 * c + d) / 6 for p, a, b, c, d in zip(point, k1, k2, k3, k4)]


def traced_back(point: list[Column], arrival: float, dt: float, velocity) -> list[Column]:
    """Where what arrives at `point` was dt before."""
    return rk3(point, arrival, -dt, velocity)


def theta_extrapolated(levels: list, theta: float) -> Column:
    """The value at theta steps beyond the newest of up to three levels, newest first."""
    weights = {1: (1.0,), 2: (theta + 1, -theta), 3: (0.5 * (theta + 1) * (theta + 2), -theta * (theta + 2), 0.5 * theta * (theta + 1))}[len(levels)]
    return sum((w * _c(x) for w, x in zip(weights[1:], levels[1:])), weights[0] * _c(levels[0]))


def cardinal_weights(nodes: list[float], at) -> list[Column]:
    """Lagrange weights of each node at `at`, as products."""
    at = _c(at)
    return [math.prod((((at - u) / (t - u)) for j, u in enumerate(nodes) if j != i), start=F.lit(1.0)) for i, t in enumerate(nodes)]


def quality_crossing(previous, current, threshold: float, steps: float) -> tuple[Column, Column]:
    """(whether the quality, going on as it last rose, reaches the threshold within `steps`, that quality)."""
    ahead = _c(current) + max(0.0, steps) * F.greatest(F.lit(0.0), _c(current) - _c(previous))
    return ahead >= threshold, ahead


def level_set_kept(phi, inside: bool = True, tolerance: float = 0.0, clearance: float = 0.0, low: float = float("-inf"), high: float = float("inf")) -> Column:
    """Whether a point of level-set value phi (positive inside) stays: by side with a clearance, and between two values."""
    phi = _c(phi)
    side = phi >= clearance - tolerance if inside else phi <= tolerance - clearance
    return side & (phi >= low) & (phi <= high)
