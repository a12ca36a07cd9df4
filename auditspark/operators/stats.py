"""Regression, diagnostics and histograms.

An ordinary least squares fit of y on x needs only the moments n, mean(x),
mean(y), Sxx, Syy and Sxy: one aggregate pass (``regr_*``), grouped or not, with
a partial aggregate on every mapper. Everything ``summary(lm)`` prints follows
from those moments, the p-values too (``with_p_values``); ``ml_coefficients``
takes them from Spark ML's normal-equation solver instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import dist
from auditspark.operators.ordered import attach_scalar, global_positions


def ols_moments(y: Column, x: Column) -> list[Column]:
    return [
        F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("_mx"), F.regr_avgy(y, x).alias("_my"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
    ]


def ols_from_moments(df: DataFrame, keep: list[str]) -> DataFrame:
    """Turn the moment columns into the ``summary(lm)`` table."""
    n, mx, sxx, syy, sxy = (F.col(c) for c in ("n", "_mx", "_sxx", "_syy", "_sxy"))
    slope = sxy / sxx
    intercept = F.col("_my") - slope * mx
    sse = syy - slope * sxy
    dof = n - 2
    s2 = sse / dof
    r2 = sxy * sxy / (sxx * syy)
    out = df.select(
        *keep, n.alias("n"), slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"),
        (1 - (1 - r2) * (n - 1) / dof).alias("adj_r2"), F.sqrt(s2).alias("sigma"),
        F.sqrt(s2 / sxx).alias("se_slope"), F.sqrt(s2 * (1.0 / n + mx * mx / sxx)).alias("se_intercept"),
        (r2 / (1 - r2) * dof).alias("f_stat"), dof.alias("df"),
        mx.alias("mean_x"), sxx.alias("sxx"))
    return (out.withColumn("t_slope", F.col("slope") / F.col("se_slope"))
            .withColumn("t_intercept", F.col("intercept") / F.col("se_intercept")))


def ols(df: DataFrame, y: str | Column, x: str | Column, by: list[str] | None = None) -> DataFrame:
    """Fit ``lm(y ~ x)`` (per group when ``by`` is given)."""
    y = F.col(y) if isinstance(y, str) else y
    x = F.col(x) if isinstance(x, str) else x
    by = by or []
    m = df.groupBy(*by).agg(*ols_moments(y, x)) if by else df.agg(*ols_moments(y, x))
    return ols_from_moments(m, by)


def ols_models(df: DataFrame, models: dict[str, tuple[Column, Column]], label: str = "model") -> DataFrame:
    """Several fits (name: y, x) of one table in one pass, a row each."""
    one = df.agg(*[F.struct(*ols_moments(y, x)).alias(name) for name, (y, x) in models.items()])
    pairs = [c for name in models for c in (F.lit(name), F.col(f"`{name}`"))]
    rows = one.select(F.explode(F.create_map(*pairs)).alias(label, "_m")).select(label, "_m.*")
    return ols_from_moments(rows, [label])


def ols_with_all(df: DataFrame, y: Column, x: Column, group: str, all_label: str = "All") -> DataFrame:
    """A25 + A27: one fit per group plus one over every row ("All").

    ``rollup(group)`` computes both grouping levels from one scan (Spark expands
    each row into its grouping sets before the partial aggregate), instead of
    appending a relabelled copy of the data."""
    m = (df.rollup(group).agg(*ols_moments(y, x), F.grouping(group).alias("_all"))
         .withColumn(group, F.when(F.col("_all") == 1, F.lit(all_label)).otherwise(F.col(group)))
         .drop("_all"))
    return ols_from_moments(m, [group])


def residual_table(df: DataFrame, fit: DataFrame, y: Column, x: Column, keep: list[str]) -> DataFrame:
    """What ``plot(lm)`` shows, as a table: fitted value, residual,
    leverage, standardized residual and Cook's distance per row. The one-row fit
    is attached to every row as a scalar."""
    f = fit.select(F.col("slope").alias("_b"), F.col("intercept").alias("_a"), F.col("sigma").alias("_s"),
                   F.col("n").alias("_n"), F.col("mean_x").alias("_mx"), F.col("sxx").alias("_sxx"))
    j = attach_scalar(df.select(*keep, y.alias("_y"), x.alias("_x")), f)
    fitted = F.col("_a") + F.col("_b") * F.col("_x")
    lev = 1.0 / F.col("_n") + (F.col("_x") - F.col("_mx")) ** 2 / F.col("_sxx")
    return (j.withColumn("fitted", fitted)
            .withColumn("residual", F.col("_y") - F.col("fitted"))
            .withColumn("leverage", lev)
            .withColumn("std_residual", F.col("residual") / (F.col("_s") * F.sqrt(1 - F.col("leverage"))))
            .withColumn("cooks_distance", F.col("std_residual") ** 2 / 2.0
                        * F.col("leverage") / (1 - F.col("leverage")))
            .select(*keep, "fitted", "residual", "leverage", "std_residual", "cooks_distance"))


def ml_coefficients(df: DataFrame, y: str, x: str) -> DataFrame:
    """A26 p-values: Spark ML's normal-equation fit reports standard errors, t
    and p for each term (two rows: intercept and slope)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=[x], outputCol="_f").transform(df.select(x, y).dropna())
    model = LinearRegression(featuresCol="_f", labelCol=y, solver="normal", regParam=0.0).fit(data)
    s = model.summary
    rows = [("intercept", float(model.intercept), s.coefficientStandardErrors[1], s.tValues[1], s.pValues[1]),
            ("slope", float(model.coefficients[0]), s.coefficientStandardErrors[0], s.tValues[0], s.pValues[0])]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, "
                                                 "t_value double, p_value double")


def with_p_values(fits: DataFrame) -> DataFrame:
    """``p_slope`` and ``p_intercept`` of every fit, grouped or not: column expressions of its t values."""
    return fits.withColumns({f"p_{c}": dist.t_two_sided_p(F.col(f"t_{c}"), F.col("df")) for c in ("slope", "intercept")})


def normal_qq(df: DataFrame, value_col: str, tie_cols: list[str]) -> DataFrame:
    """A28, second panel: the normal Q-Q plot as a table - each row's position among the values, its plotting
    position (i - a) / (n + 1 - 2a), with a = 3/8 up to ten values and 1/2 beyond as in ``ppoints``, and the
    normal quantile there. Missing values are left out, as ``qqnorm`` does.

    Positions come from ranges of the values, never from one window over all; ties go by ``tie_cols``."""
    known = df.filter(F.col(value_col).isNotNull() & ~F.isnan(value_col))
    n = known.agg(F.count(F.lit(1)).alias("_n"))
    placed = attach_scalar(global_positions(known, [F.asc(value_col), *[F.asc(c) for c in tie_cols]]), n)
    a = F.when(F.col("_n") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    point = (F.col("row_pos") - a) / (F.col("_n") + 1 - 2 * a)
    return (placed.withColumn("position", F.col("row_pos")).withColumn("plotting", point)
            .withColumn("theoretical", dist.normal_quantile(point)).drop("row_pos", "_n"))


# Fixed values of the break rule: a step is 1, 2, 5 or 10 times a power of ten, the first whose limit
# the wanted cell (in that power of ten) does not exceed.
PRETTY_STEPS = ((1.4, 1), (2.8, 2), (7.0, 5), (math.inf, 10))
ROUNDING_EPS = 1e-10


def sturges(n: int) -> int:
    """``nclass.Sturges``: ceiling(log2(n) + 1)."""
    return int(math.ceil(math.log2(n) + 1))


def pretty_breaks(lo: float, up: float, cells: int) -> list[float]:
    """Equally spaced round break points that cover [lo, up] in about ``cells`` steps, as R's ``pretty``
    picks them for ``hist``. A single value on a break point gets one step, towards zero."""
    size = abs(lo) or 1.0
    cell = (up - lo) / max(cells, 1) or 0.75 * min(size, 9 + size / 10)
    base = 10.0 ** math.floor(math.log10(cell))
    step = base * next(times for limit, times in PRETTY_STEPS if cell <= limit * base)
    first, last = math.floor(lo / step + ROUNDING_EPS), math.ceil(up / step - ROUNDING_EPS)
    if first == last:
        first, last = (first - 1, last) if first >= 0 else (first, last + 1)
    return [i * step for i in range(first, last + 1)]


def histogram(df: DataFrame, value: Column, breaks: list[float] | None = None) -> DataFrame:
    """``hist(x)`` counts - right-closed bins, the first one closed on
    both ends, with R's fuzz of 1e-7 of a bin width on the break points.

    Default breaks follow Sturges + ``pretty`` from a one-pass (min, max,
    count) aggregate (three numbers reach the driver). The bin of a value is one
    plus the number of inner break points below it: a column expression over a
    literal array, so counting is one grouped aggregate."""
    v = df.select(value.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if breaks is None:
        lo, up, n = v.agg(F.min("_x"), F.max("_x"), F.count(F.lit(1))).first()
        if not n:
            return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
        breaks = pretty_breaks(float(lo), float(up), sturges(int(n)))
    fuzz = 1e-7 * (breaks[1] - breaks[0])
    inner = F.array(*[F.lit(float(b) + fuzz) for b in breaks[1:-1]])
    bin_id = F.size(F.filter(inner, lambda b: b < F.col("_x"))) + 1
    counts = v.groupBy(bin_id.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = df.sparkSession.createDataFrame(
        [(i + 1, float(breaks[i]), float(breaks[i + 1])) for i in range(len(breaks) - 1)],
        "bin int, lower double, upper double")
    return (edges.join(counts, "bin", "left")
            .select("bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count")))


def confidence_band(df: DataFrame, fit: DataFrame, y: Column, x: Column, group: str | None = None,
                    level: float = 0.95) -> DataFrame:
    """``geom_smooth(method = "lm")``'s band as a table - at every distinct
    x of a group, the fitted value and fitted +/- t(level, n - 2) * s *
    sqrt(1/n + (x - mean x)^2 / Sxx). The fit rows (one per group) join the
    points on the group key; the t quantile is a column expression of the fit rows."""
    gcols = [group] if group else []
    f = fit.select(*gcols, F.col("slope").alias("_b"), F.col("intercept").alias("_a"),
                   F.col("sigma").alias("_s"), F.col("n").alias("_n"), F.col("mean_x").alias("_mx"),
                   F.col("sxx").alias("_sxx"),
                   dist.t_quantile(0.5 + level / 2.0, F.col("df")).alias("_t"))
    pts = df.select(*gcols, x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x")).distinct()
    j = pts.join(f, gcols) if gcols else attach_scalar(pts, f)
    fitted = F.col("_a") + F.col("_b") * F.col("x")
    se = F.col("_s") * F.sqrt(1.0 / F.col("_n") + (F.col("x") - F.col("_mx")) ** 2 / F.col("_sxx"))
    return j.select(*gcols, "x", fitted.alias("fitted"), (fitted - F.col("_t") * se).alias("lower"),
                    (fitted + F.col("_t") * se).alias("upper"), F.col("_t").alias("t_crit"))
