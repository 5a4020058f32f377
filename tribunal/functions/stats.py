"""Exact tests as column expressions: binomial tails, Clopper-Pearson intervals, Fisher's exact test.

Probabilities are summed from the observed value outwards, where terms only fall, so a test of n trials adds about sqrt(n) terms; the first term comes
from Loader's saddle-point form, which stays accurate for any n. Nothing here runs in Python.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_TABLE = 16
#: ln n! - Stirling's approximation, where its series is not yet accurate.
_STIRLING_ERRORS = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, _TABLE)]


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _double(x) -> Column:
    return _col(x).cast("double")


def _stirling_error(n: Column) -> Column:
    small = F.element_at(F.array(*[F.lit(x) for x in _STIRLING_ERRORS]), F.least(n, F.lit(_TABLE - 1)).cast("int") + 1)
    m = F.greatest(n, F.lit(1.0))
    s = m * m
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / s) / s) / s) / s) / m
    return F.when(n < _TABLE, small).otherwise(series)


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.ln(y)).otherwise(F.lit(0.0))


def log_factorial(n) -> Column:
    n = _double(n)
    return F.when(n > 0, (n + 0.5) * F.ln(n) - n + 0.5 * math.log(2 * math.pi) + _stirling_error(n)).otherwise(F.lit(0.0))


def binomial_pmf(k: Column, n: Column, p: Column) -> Column:
    """P(X = k) for 0 <= k <= n and 0 < p < 1."""
    q, rest = 1 - p, n - k
    inner = (
        _stirling_error(n) - _stirling_error(k) - _stirling_error(rest)
        - (_xlogy(k, k / (n * p)) + n * p - k) - (_xlogy(rest, rest / (n * q)) + n * q - rest)
    )
    middle = F.sqrt(n / (2 * math.pi * k * rest)) * F.exp(inner)
    return F.when(k <= 0, F.exp(n * F.ln(q))).when(rest <= 0, F.exp(n * F.ln(p))).otherwise(middle)


def _steps(room: Column, n: Column) -> Column:
    """0, 1, ... as far as terms can matter."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.least(room, F.ceil(10 * F.sqrt(n)) + 100)).cast("long"))


def _outward(k: Column, n: Column, p: Column, up: bool) -> Column:
    """P(X >= k) if up, else P(X <= k): k lies on that side of the mean."""
    odds = p / (1 - p)
    ratio = (lambda i: (n - i) / (i + 1) * odds) if up else (lambda i: i / (n - i + 1) / odds)
    at = (lambda j: k + j) if up else (lambda j: k - j)
    start = F.struct(binomial_pmf(k, n, p).alias("t"), F.lit(0.0).alias("s"))
    return F.aggregate(_steps(n - k if up else k, n), start, lambda a, j: F.struct((a["t"] * ratio(at(j.cast("double")))).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])


def _inner(p) -> tuple[Column, Column]:
    """A p that can be divided by, and the number of events per trial where that is certain (0 or 1), else null."""
    p = _double(p)
    return F.when((p > 0) & (p < 1), p).otherwise(0.5), F.when(p <= 0, 0.0).when(p >= 1, 1.0)


def binomial_sf(k, n, p=0.5) -> Column:
    """P(X >= k); 1 without trials, or for k <= 0; 0 for k > n."""
    k, n, p, sure = _double(k), _double(n), *_inner(p)
    inside = F.when(k > n * p, _outward(k, n, p, True)).otherwise(1 - _outward(F.greatest(k - 1, F.lit(0.0)), n, p, False))
    return F.when(n <= 0, 1.0).when(k <= 0, 1.0).when(k > n, 0.0).when(sure.isNotNull(), sure).otherwise(inside)


def binomial_cdf(k, n, p=0.5) -> Column:
    """P(X <= k); 1 without trials, or for k >= n; 0 for k < 0."""
    k, n, p, sure = _double(k), _double(n), *_inner(p)
    inside = F.when(k < n * p, _outward(k, n, p, False)).otherwise(1 - _outward(F.least(k + 1, n), n, p, True))
    return F.when(n <= 0, 1.0).when(k < 0, 0.0).when(k >= n, 1.0).when(sure.isNotNull(), 1 - sure).otherwise(inside)


def binomial_two_sided(k, n, p=0.5) -> Column:
    """Twice the smaller tail, 1 at most."""
    return F.when(_double(n) <= 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.least(binomial_sf(k, n, p), binomial_cdf(k, n, p))))


def critical_value(n, alpha: float = 0.05, p: float = 0.5) -> Column:
    """The least k with P(X >= k) < alpha; n + 1 where even n events are not that rare. By halving, since tails only fall."""
    n = _double(n)
    halves = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(0.0)) + 2)).cast("int") + 1))

    def step(a, _):
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("double")
        rare = binomial_sf(middle, n, p) < alpha
        done = a["hi"] - a["lo"] <= 1
        return F.struct(F.when(done | rare, a["lo"]).otherwise(middle).alias("lo"), F.when(done | ~rare, a["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(halves, F.struct(F.lit(0.0).alias("lo"), (F.greatest(n, F.lit(0.0)) + 1).alias("hi")), step, lambda a: a["hi"]).cast("long")


#: Rounds of Newton's method, each kept between the bounds known so far; about eight are enough.
_ROUNDS = 16


def _solved(tail, slope, start: Column, target: float) -> Column:
    """The p in (0, 1) at which the rising tail(p) reaches the target; slope is its derivative."""

    def step(a, _):
        x = a["x"]
        both = F.struct(tail(x).alias("t"), slope(x).alias("d"))
        # one struct, so that the tail is summed once a round; none is summed once the value stays where it is
        return F.when(a["done"], a).otherwise(F.aggregate(F.array(both), a, lambda _, y: _next(a, y)))

    def _next(a, y):
        x, low = a["x"], y["t"] < target
        lo, hi = F.when(low, x).otherwise(a["lo"]), F.when(low, a["hi"]).otherwise(x)
        # on a log scale, where the tail is nearly straight
        new = x - F.ln(F.greatest(y["t"], F.lit(1e-300)) / target) * y["t"] / F.greatest(y["d"], F.lit(1e-300))
        to = F.when((new >= lo) & (new <= hi), new).otherwise((lo + hi) / 2)
        return F.struct(lo.alias("lo"), hi.alias("hi"), to.alias("x"), (F.abs(to - x) <= 1e-14 * x).alias("done"))

    first = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), start.alias("x"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), first, step, lambda a: a["x"])


def _wilson(k: Column, n: Column, z: float) -> Column:
    """A first guess: the normal approximation's bound z standard deviations away, inside (0, 1)."""
    share = k / n
    middle, spread = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), (middle + spread) / (1 + z * z / n)))


def clopper_pearson(k, n, alpha: float = 0.05) -> tuple[Column, Column]:
    """Exact bounds of a proportion; (0, 1) without trials. The upper bound is one less the lower one of the failures."""
    k, n = _double(k), _double(n)
    z = -NormalDist().inv_cdf(alpha / 2)

    def low(k):
        m = F.greatest(n, F.lit(1.0))
        found = _solved(lambda p: binomial_sf(k, m, p), lambda p: k / p * binomial_pmf(k, m, p), _wilson(k, m, -z), alpha / 2)
        return F.when((n <= 0) | (k <= 0), 0.0).otherwise(found)

    return low(k), F.when(n <= 0, 1.0).otherwise(1 - low(n - k))


def fisher_exact(a1, b1, a2, b2) -> Column:
    """Two-sided p of a 2 x 2 table: all tables of the same margins that are no likelier. 1 if a margin is zero.

    From the observed table outwards, each table's likelihood follows from its neighbour's by a ratio. Ties of likelihood are taken as equal within
    1e-7; tables over 40 standard deviations from the mean are left out.
    """
    a, b, c, d = (_double(x) for x in (a1, b1, a2, b2))
    row, col, n = a + b, a + c, a + b + c + d
    rest = n - row - col
    mean = row * col / n
    spread = 40 * F.sqrt(mean * (n - col) / n * (n - row) / F.greatest(n - 1, F.lit(1.0))) + 1
    lo = F.greatest(F.lit(0.0), -rest, F.least(F.floor(mean - spread).cast("double"), a))
    hi = F.least(row, col, F.greatest(F.ceil(mean + spread).cast("double"), a))
    seen = log_factorial(row) + log_factorial(n - row) + log_factorial(col) + log_factorial(n - col) - log_factorial(n)
    seen = seen - log_factorial(a) - log_factorial(row - a) - log_factorial(col - a) - log_factorial(rest + a)
    up = lambda x: (row - x) * (col - x) / ((x + 1) * (rest + x + 1))
    down = lambda x: x * (rest + x) / ((row - x + 1) * (col - x + 1))

    def outward(steps: Column, ratio, at) -> Column:
        """The sum of the likelihoods, relative to the observed table's, that don't exceed it; the first is that of its neighbour."""

        def add(s, j):
            w = s["w"] + F.ln(ratio(at(j.cast("double"))))
            return F.struct(w.alias("w"), (s["s"] + F.when(w <= 1e-7, F.exp(w)).otherwise(0.0)).alias("s"))

        some = F.when(steps >= 1, F.sequence(F.lit(0).cast("long"), steps.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(some, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")), add, lambda s: s["s"])

    total = F.exp(seen) * (1 + outward(hi - a, up, lambda j: a + j) + outward(a - lo, down, lambda j: a - j))
    return F.when((row <= 0) | (col <= 0) | (n - row <= 0) | (n - col <= 0), 1.0).otherwise(F.least(F.lit(1.0), total))


def rate(events, n) -> Column:
    """0 without trials."""
    return F.when(_col(n) > 0, _double(events) / _double(n)).otherwise(F.lit(0.0))


def trip(events, n_valid, alpha: float = 0.05, min_n: int = 20, two_sided: bool = False) -> dict[str, Column]:
    """rate, p_value, tripped, inconclusive: under min_n valid verdicts nothing is decided, and p is 1."""
    few = _col(n_valid) < min_n
    p = F.when(few, 1.0).otherwise((binomial_two_sided if two_sided else binomial_sf)(events, n_valid))
    return {"rate": rate(events, n_valid), "p_value": p, "tripped": ~few & (p < alpha), "inconclusive": few}


def kappa(table: list[list[Column]]) -> dict[str, Column]:
    """po, pe and Cohen's kappa of a square table of counts. Without counts all are 0; where pe is 1, kappa is 1 if po is, else 0."""
    n = sum((x for row in table for x in row), F.lit(0))
    rows, cols = [sum(row, F.lit(0)) for row in table], [sum((row[k] for row in table), F.lit(0)) for k in range(len(table))]
    same, chance = sum((table[k][k] for k in range(len(table))), F.lit(0)), sum((r * c for r, c in zip(rows, cols, strict=True)), F.lit(0))
    po, pe = rate(same, n), rate(chance, n * n)
    # pe = 1 is told from whole numbers
    return {"po": po, "pe": pe, "kappa": F.when(n <= 0, 0.0).when(chance == n * n, F.when(same == n, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))}


def shortened(x, digits: int = 4) -> Column:
    """A number as C's %.<digits>g writes it, but that a decimal that ends in a 5 right after these digits is rounded up."""
    x = _double(x)
    parts = F.split(F.format_string(f"%.{digits - 1}e", x), "e")
    power = parts[1].cast("int")
    bare = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    plain = F.lit(None).cast("string")
    for e in range(-4, digits):
        plain = F.when(power == e, F.format_string(f"%.{digits - 1 - e}f", x)).otherwise(plain)
    return F.when(x == 0, "0").otherwise(F.coalesce(bare(plain), F.concat(bare(parts[0]), F.lit("e"), parts[1])))
