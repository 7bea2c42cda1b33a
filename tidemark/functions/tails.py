"""Tail probabilities as column expressions: incomplete beta and gamma functions by continued fractions and series, without Python workers.

Each takes columns and gives a column; null or undefined arguments give null. Iterations follow the arguments (some six times the
root of the larger one), so they converge for samples of any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TINY = 1e-300


def steps(size: Column, half: int = 1) -> Column:
    """0, 1, 2 and so on, as many as a fraction with arguments of that size takes."""
    n = F.least(F.lit(400_000), half * (200 + 6 * F.sqrt(F.abs(size))))
    return F.sequence(F.lit(0), F.coalesce(F.when(F.isnan(n), 0).otherwise(n), F.lit(0)).cast("int"))


def nonzero(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, TINY).otherwise(x)


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series eight places up, brought back by the recurrence."""
    x = z + 8
    inverse = 1 / x
    series = inverse / 12 - F.pow(inverse, F.lit(3)) / 360 + F.pow(inverse, F.lit(5)) / 1260 - F.pow(inverse, F.lit(7)) / 1680
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - sum((F.log(z + k) for k in range(8)), F.lit(0.0))


def beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, term by term from the front."""

    def term(k: Column) -> Column:
        m = F.floor(k / 2) + 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    def step(s: Column, k: Column) -> Column:
        d, c = nonzero(1 + term(k) * s["d"]), nonzero(1 + term(k) / s["c"])
        return F.struct((1 / d).alias("d"), c.alias("c"), (s["h"] * c / d).alias("h"))

    first = 1 / nonzero(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    return F.aggregate(steps(F.greatest(a, b), 2), start, step)["h"]


def beta_share(x: Column, rest: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function of x with parameters a and b; `rest` is 1 - x, given apart so that neither end loses digits."""
    direct = x < (a + 1) / (a + b + 2)
    u, v, p, q = (F.when(direct, s).otherwise(t) for s, t in ((x, rest), (rest, x), (a, b), (b, a)))
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + p * F.log(u) + q * F.log(v)) / p
    part = front * beta_fraction(u, p, q)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(F.when(direct, part).otherwise(1 - part))


def gamma_above(s: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function: by the series of the lower one below s + 1, else by a continued fraction."""
    front = F.exp(s * F.log(x) - x - ln_gamma(s))

    def add(t: Column, k: Column) -> Column:
        new = t["term"] * x / (s + k + 1)
        return F.struct(new.alias("term"), (t["total"] + new).alias("total"))

    def step(t: Column, k: Column) -> Column:
        i = k + 1
        a, b = -i * (i - s), x + 1 - s + 2 * i
        d, c = nonzero(a * t["d"] + b), nonzero(b + a / t["c"])
        return F.struct((1 / d).alias("d"), c.alias("c"), (t["h"] * c / d).alias("h"))

    size = F.greatest(s, x)
    below = front * F.aggregate(steps(size), F.struct((1 / s).alias("term"), (1 / s).alias("total")), add)["total"]
    first = 1 / nonzero(x + 1 - s)
    above = front * F.aggregate(steps(size), F.struct(first.alias("d"), F.lit(1 / TINY).alias("c"), first.alias("h")), step)["h"]
    return F.when(x <= 0, 1.0).when(x < s + 1, 1 - below).otherwise(above)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal Z."""
    return gamma_above(F.lit(0.5), z * z / 2)


def normal_above(z: Column) -> Column:
    """P(Z >= z) of a standard normal Z."""
    half = normal_two_sided(z) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def student_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) of Student's T."""
    nu = freedom.cast("double")
    return beta_share(nu / (nu + t * t), t * t / (nu + t * t), nu / 2, F.lit(0.5))


def chi_square_above(x: Column, freedom: Column) -> Column:
    """P(X >= x) of a chi-square variable."""
    return gamma_above(freedom.cast("double") / 2, x / 2)


def binomial_at_least(k: Column, n: Column) -> Column:
    """P(X >= k) of n fair trials, exact."""
    a, b = k.cast("double"), (n - k + 1).cast("double")
    return F.when(n.isNull() | k.isNull(), None).when(k <= 0, 1.0).when(k > n, 0.0).otherwise(beta_share(F.lit(0.5), F.lit(0.5), a, b))
