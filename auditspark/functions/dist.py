"""Student t and normal distributions as Column expressions (A26 p-values, A27 bands, A28 Q-Q panel).

Spark SQL has neither, so both are built from its own functions and stay in the JVM: the incomplete beta function is
its continued fraction folded over an array, the t quantile a fold of Newton steps, the normal quantile
a rational function. ``functions/tdist.py`` holds the same t functions for single numbers.

Defined results: NULL or NaN in any argument, and degrees of freedom of 0 or less, give NULL; probabilities
outside (0, 1) give NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
#: Steps up by which the argument of the gamma ratio is large enough for its series.
_SHIFT = 16
#: log(gamma(z + 1/2) / gamma(z)) - log(z) / 2 in powers z^-1, z^-3, ...
_RATIO = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432, 691 / 180224)

#: The normal quantile's rational functions (algorithm AS 241, PPND16), lowest power first.
_CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
            4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
           (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
_MIDDLE = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
            1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
           (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
            1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
_FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
         2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
         7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


#: Terms of the continued fraction: where it is used, at most 48 change a double for any degrees of freedom.
_TERMS = 64
_NEWTON = 40


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, each computed once."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def _log_gamma_ratio(a: Column) -> Column:
    """log(gamma(a + 1/2) / gamma(a)) for a > 0."""
    def series(v: Column) -> Column:
        return reduce(lambda s, c: s / v["zz"] + c, reversed(_RATIO), F.lit(0.0)) / v["z"] + F.log(v["z"]) / 2

    below = reduce(lambda s, i: s + F.log1p(F.lit(-0.5) / (a + (i + 0.5))), range(_SHIFT), F.lit(0.0))
    return below + _let(series, z=a + _SHIFT, zz=(a + _SHIFT) * (a + _SHIFT))


def _beta_fraction(v: Column) -> Column:
    """Continued fraction of the incomplete beta function of ``v`` (a, b, x), by the modified Lentz method."""
    a, b, x = v["a"], v["b"], v["x"]

    def kept(value: Column) -> Column:
        return _let(lambda k: F.when(F.abs(k["k"]) > _TINY, k["k"]).otherwise(F.lit(_TINY)), k=value)

    def turn(s: Column, num: Column) -> Column:
        return _let(lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["d"] * n["c"]).alias("h")),
                    c=kept(1.0 + num / s["c"]), d=1.0 / kept(1.0 + num * s["d"]))

    def step(state: Column, i: Column) -> Column:
        m = i.cast("double")
        odd = _let(lambda w: w["s"], s=turn(state, m * (b - m) * x / ((a - 1.0 + 2 * m) * (a + 2 * m))))
        return _let(lambda w: turn(w["s"], -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1.0 + 2 * m))), s=odd)

    start = 1.0 / kept(1.0 - (a + b) * x / (a + 1.0))
    begin = _let(lambda w: F.struct(F.lit(1.0).alias("c"), w["d"].alias("d"), w["d"].alias("h")), d=start)
    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), begin, step, lambda s: s["h"])


def _positive(dof: Column) -> Column:
    return F.when((dof > 0) & ~F.isnan(dof.cast("double")), dof.cast("double"))


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) for T ~ t(dof): ``summary(lm)``'s Pr(>|t|)."""
    def tail(v: Column) -> Column:
        # The side on which the fraction converges fast.
        near = v["x"] < (v["a"] + 1) / (v["a"] + 2.5)
        front = F.exp(-v["a"] * F.log1p(v["q"]) + F.log(v["away"]) / 2 + _log_gamma_ratio(v["a"]) - math.log(math.pi) / 2)
        half = F.lit(0.5)
        part = _let(_beta_fraction, a=F.when(near, v["a"]).otherwise(half), b=F.when(near, half).otherwise(v["a"]),
                    x=F.when(near, v["x"]).otherwise(v["away"]))
        return F.when(near, front * part / v["a"]).otherwise(1.0 - front * part / half)

    def whole(v: Column) -> Column:
        p = _let(tail, a=v["dof"] / 2, q=v["q"], x=1.0 / (1.0 + v["q"]), away=v["q"] / (1.0 + v["q"]))
        return F.when(v["dof"].isNotNull() & ~F.isnan(v["t"]), F.when(v["t"] == 0, F.lit(1.0)).when(F.abs(v["t"]) == float("inf"), F.lit(0.0)).otherwise(p))

    t, dof = t.cast("double"), _positive(dof)
    return _let(whole, t=t, dof=dof, q=t * t / dof)


def t_quantile(p: float, dof: Column) -> Column:
    """The p-quantile of t(dof) for a fixed p in (0, 1).

    Newton steps on the upper tail from the normal quantile: it lies below, and the tail is convex, so they
    rise to the quantile without passing it."""
    tail = min(p, 1 - p)

    def found(v: Column) -> Column:
        def step(t: Column, _: Column) -> Column:
            density = F.exp(v["r"] - F.log(v["dof"] * math.pi) / 2 - (v["dof"] + 1) / 2 * F.log1p(t * t / v["dof"]))
            return t + (t_two_sided_p(t, v["dof"]) / 2 - tail) / density

        q = F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON)), F.lit(NormalDist().inv_cdf(1 - tail)), step)
        return F.when(v["dof"].isNotNull(), q if p > 0.5 else -q if p < 0.5 else F.lit(0.0))

    dof = _positive(dof)
    return _let(found, dof=dof, r=_log_gamma_ratio(dof / 2))


def normal_quantile(p: Column) -> Column:
    """``qnorm(p)``."""
    def polynomial(coefficients: tuple[float, ...], r: Column) -> Column:
        return reduce(lambda s, c: s * r + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))

    def rational(parts: tuple, r: Column) -> Column:
        return polynomial(parts[0], r) / polynomial(parts[1], r)

    def value(v: Column) -> Column:
        side = F.signum(v["q"])
        return F.when((v["p"] > 0) & (v["p"] < 1),
                      F.when(F.abs(v["q"]) <= 0.425, v["q"] * rational(_CENTRE, 0.180625 - v["q"] * v["q"]))
                      .when(v["r"] <= 5, side * rational(_MIDDLE, v["r"] - 1.6))
                      .otherwise(side * rational(_FAR, v["r"] - 5)))

    p = p.cast("double")
    return _let(value, p=p, q=p - 0.5, r=F.sqrt(-F.log(F.least(p, 1 - p))))


def normal_quantile_sql(p: str) -> str:
    """``qnorm`` of the column ``p`` as DuckDB SQL, for oracles."""
    def polynomial(coefficients: tuple[float, ...], r: str) -> str:
        return reduce(lambda s, c: f"({s} * {r} + {c:.20e})", reversed(coefficients[:-1]), f"{coefficients[-1]:.20e}")

    def rational(parts: tuple, r: str) -> str:
        return f"{polynomial(parts[0], r)} / {polynomial(parts[1], r)}"

    q, root = f"({p} - 5e-1)", f"sqrt(-ln(least({p}, 1e0 - {p})))"
    return (f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs{q} <= 4.25e-1 THEN {q} * {rational(_CENTRE, f'(1.80625e-1 - {q} * {q})')} "
            f"WHEN {root} <= 5 THEN sign{q} * {rational(_MIDDLE, f'({root} - 1.6e0)')} "
            f"ELSE sign{q} * {rational(_FAR, f'({root} - 5e0)')} END END")
