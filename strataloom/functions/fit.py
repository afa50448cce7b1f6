"""Fits of lines and laws by aggregation, and the special functions that tests of them need."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.prefix import running_sums


def line(points: DataFrame, x: Column, y: Column, by: list[str] = ()) -> DataFrame:
    """Least squares of y on x: slope, intercept, r2 and the number of points."""
    xy = points.select(*by, x.cast("double").alias("x"), y.cast("double").alias("y"))
    return xy.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_count("y", "x").alias("points"))


def zipf(counted: DataFrame, by: list[str], freq: str = "tf", tie: str = "tok", first: int = 10, last_share: float = 0.1) -> DataFrame:
    """Log-log fit of frequency on rank over ranks ``first`` .. N * ``last_share``."""
    order = Window.partitionBy(*by).orderBy(F.col(freq).desc(), F.col(tie))
    ranked = counted.select(*by, F.row_number().over(order).alias("rank"), F.col(freq).alias("freq"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    used = ranked.where((F.col("rank") >= first) & (F.col("rank") <= F.floor(F.col("n") * last_share)))
    return line(used, F.log10("rank"), F.log10("freq"), by)


def zipf_from_counts(dist: DataFrame, by: list[str], first: int = 10, last_share: float = 0.1) -> DataFrame:
    """The same fit from ``(freq, n)``, the number of terms of each frequency.

    Terms of one frequency hold a stretch of ranks, so the window sees a row for each different
    frequency (a few thousand in any corpus) instead of the whole vocabulary; each stretch is then
    laid out only where the fit uses it.
    """
    order = Window.partitionBy(*by).orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    runs = dist.select(*by, "freq", F.sum("n").over(order).alias("last"), (F.sum("n").over(order) - F.col("n") + 1).alias("begin"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    used = runs.select(*by, "freq", F.greatest("begin", F.lit(first)).alias("begin"), F.least("last", F.floor(F.col("total") * last_share)).alias("last")).where("begin <= last")
    ranks = used.select(*by, "freq", F.explode(F.sequence("begin", "last")).alias("rank"))
    return line(ranks, F.log10("rank"), F.log10("freq"), by)


def joint_correlation(joint: DataFrame, logs: bool = False) -> DataFrame:
    """Correlation and fit over the distinct pairs ``(x, y)``, each once; with ``logs`` 0 counts as 0.1. (0, 0) is left out."""
    pairs = joint.where("not (x = 0 and y = 0)")
    if logs:
        level = lambda c: F.log10(F.when(F.col(c) == 0, 0.1).otherwise(F.col(c)))
        pairs = pairs.select(level("x").alias("x"), level("y").alias("y"))
    pairs = pairs.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return pairs.agg(F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("pairs"))


def best_of_four(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Fits with linear and logarithmic axes, their mean squared error in y and which is best; points must be positive."""
    p = points.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kinds = {"linear": ("x", "y"), "logx": ("log10(x)", "y"), "logy": ("x", "log10(y)"), "loglog": ("log10(x)", "log10(y)")}
    long = p.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(a).alias("u"), F.expr(b).alias("v"), F.col("y").alias("y")) for k, (a, b) in kinds.items()))).alias("r")).select("r.*")
    fits = long.groupBy("kind").agg(F.regr_slope("v", "u").alias("slope"), F.regr_intercept("v", "u").alias("intercept"), F.regr_r2("v", "u").alias("r2"))
    value = F.col("slope") * F.col("u") + F.col("intercept")
    back = F.when(F.col("kind").isin("logy", "loglog"), F.pow(F.lit(10.0), value)).otherwise(value)
    errors = long.join(F.broadcast(fits), "kind").groupBy("kind").agg(F.avg((F.col("y") - back) * (F.col("y") - back)).alias("mse"))  # four rows
    return fits.join(errors, "kind").withColumn("best", F.col("mse") == F.min("mse").over(Window.partitionBy(F.lit(1))))


def power_law_mle(dist: DataFrame, xmin: float) -> DataFrame:
    """Exponent of a power law above ``xmin`` by maximum likelihood, and the log-likelihoods of it and of a lognormal."""
    d = dist.where(F.col("value") >= xmin).select((F.log(F.col("value"))).alias("l"), (F.log(F.col("value") / xmin)).alias("t"), "freq")
    s = d.agg(F.sum("freq").alias("n"), F.sum(F.col("t") * F.col("freq")).alias("st"), F.sum(F.col("l") * F.col("freq")).alias("sl"), F.sum(F.col("l") * F.col("l") * F.col("freq")).alias("sll"))
    s = s.withColumn("alpha", 1 + F.col("n") / F.col("st")).withColumn("mu", F.col("sl") / F.col("n")).withColumn("sigma", F.sqrt(F.col("sll") / F.col("n") - F.col("mu") * F.col("mu")))
    power = F.col("n") * F.log((F.col("alpha") - 1) / xmin) - F.col("alpha") * F.col("st")
    lognormal = -F.col("sl") - F.col("n") * (F.log(F.col("sigma")) + 0.5 * math.log(2 * math.pi) + 0.5)
    return s.select("n", "alpha", "mu", "sigma", power.alias("loglik_power"), lognormal.alias("loglik_lognormal"))


def power_law_scan(dist: DataFrame, least_tail: int = 10) -> DataFrame:
    """``(xmin, n, alpha, ks)`` for every value as the lower bound of a power law, and which has the least KS distance.

    Exponents come from sums over each tail; the distance is the largest gap between the tail's distribution and the
    law, on either side of each step. The table of different values meets itself once, so it should be binned first
    where values are many. Tails of fewer than ``least_tail`` points are left out.
    """
    d = dist.select(F.col("value").cast("double").alias("value"), "freq").where("value > 0")
    tail = d.select(F.col("value").alias("xmin")).join(d, F.col("value") >= F.col("xmin"))
    sums = tail.groupBy("xmin").agg(F.sum("freq").alias("n"), F.sum(F.log(F.col("value") / F.col("xmin")) * F.col("freq")).alias("s")).where((F.col("n") >= least_tail) & (F.col("s") > 0))
    fitted = sums.select("xmin", "n", (1 + F.col("n") / F.col("s")).alias("alpha"))
    up = Window.partitionBy("xmin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    steps = tail.join(fitted, "xmin").withColumn("cum", F.sum("freq").over(up) / F.col("n")).withColumn("before", F.col("cum") - F.col("freq") / F.col("n"))
    law = 1 - F.pow(F.col("value") / F.col("xmin"), 1 - F.col("alpha"))
    ks = steps.groupBy("xmin").agg(F.max(F.greatest(F.abs(F.col("cum") - law), F.abs(F.col("before") - law))).alias("ks"))
    scan = fitted.join(ks, "xmin")
    least = scan.agg(F.min(F.struct(F.round("ks", 12), "xmin")).alias("m"))  # one row
    return scan.crossJoin(F.broadcast(least)).select("xmin", "n", "alpha", "ks", (F.col("xmin") == F.col("m.xmin")).alias("best"))


def pareto_ml(dist: DataFrame, steps: int = 400) -> DataFrame:
    """``(shape, scale, loglik)``: a generalised Pareto law by maximum likelihood, over a grid of the one free parameter.

    With t = shape / scale the best shape is the mean of ln(1 + t x), so one pass sums it for every t of a grid, whose
    range follows from the largest value and the mean.
    """
    d = dist.select(F.col("value").cast("double").alias("x"), "freq").where("x > 0")
    s = d.agg(F.max("x").alias("top"), (F.sum(F.col("x") * F.col("freq")) / F.sum("freq")).alias("mean"), F.sum("freq").alias("n"))  # one row
    low, high = -0.999 / F.col("top"), 10 / F.col("mean")
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: low + (high - low) * k / steps)).alias("t")
    grid = d.crossJoin(F.broadcast(s.select("n", t)))  # steps + 1 rows
    k = grid.where(F.abs("t") > 1e-12).groupBy("t", "n").agg((F.sum(F.log(1 + F.col("t") * F.col("x")) * F.col("freq")) / F.first("n")).alias("shape"))
    k = k.withColumn("scale", F.col("shape") / F.col("t")).where("scale > 0 and shape > -0.5")
    like = k.withColumn("loglik", -F.col("n") * (F.log("scale") + F.col("shape") + 1))
    return like.agg(F.max_by(F.struct("shape", "scale", "loglik"), F.struct(F.round("loglik", 9), "t")).alias("r")).select("r.*")


def least_squares_rate(dist: DataFrame) -> DataFrame:
    """``(rate, scale)``: an exponential law by least squares of the logarithm of the ccdf."""
    over = Window.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a row for each different value
    c = dist.withColumn("ccdf", F.sum("freq").over(over) / F.sum("freq").over(Window.partitionBy(F.lit(1))))
    return c.agg((-F.regr_slope(F.log("ccdf"), F.col("value").cast("double"))).alias("rate"), F.exp(F.regr_intercept(F.log("ccdf"), F.col("value").cast("double"))).alias("scale"))


def four_laws(points: DataFrame, x: str, y: str) -> DataFrame:
    """``(law, a, b, chi2, r2)`` of y = a + b x, a x^b, a + b ln x and a e^(b x); chi2 is the sum of squared misses of y, points must be positive."""
    p = points.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    forms = {"linear": ("x", "y"), "power": ("ln(x)", "ln(y)"), "log": ("ln(x)", "y"), "exp": ("x", "ln(y)")}
    long = p.select(F.explode(F.array(*(F.struct(F.lit(k).alias("law"), F.expr(u).alias("u"), F.expr(v).alias("v"), F.col("y").alias("y")) for k, (u, v) in forms.items()))).alias("r")).select("r.*")
    fits = long.groupBy("law").agg(F.regr_intercept("v", "u").alias("c"), F.regr_slope("v", "u").alias("b"), F.regr_r2("v", "u").alias("r2"))
    value = F.col("c") + F.col("b") * F.col("u")
    miss = F.col("y") - F.when(F.col("law").isin("power", "exp"), F.exp(value)).otherwise(value)
    errors = long.join(F.broadcast(fits), "law").groupBy("law").agg(F.sum(miss * miss).alias("chi2"))  # four rows
    return fits.join(errors, "law").select("law", F.when(F.col("law").isin("power", "exp"), F.exp("c")).otherwise(F.col("c")).alias("a"), "b", "chi2", "r2")


def welch(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """``(t, dof)`` of Welch's test between the rows where ``group`` is true and the others."""
    s = rows.select(F.col(value).cast("double").alias("v"), group.alias("g")).where("g is not null")
    own = lambda g: F.when(F.col("g") == g, F.col("v"))
    m = s.agg(*(f(own(g)).alias(f"{n}{k}") for k, g in ((1, True), (0, False)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return m.select(((F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("dof"))


def kolmogorov_smirnov(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(d, n, m)``: the largest gap between two distributions ``(value, freq)``."""
    both = left.select("value", F.col("freq").alias("a"), F.lit(0).alias("b")).unionAll(right.select("value", F.lit(0).alias("a"), F.col("freq").alias("b"))).groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cum = running_sums(both, [], "value", {"a": "ca", "b": "cb"})
    total = both.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))  # one row
    return cum.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("ca") / F.col("n") - F.col("cb") / F.col("m"))).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))


def plane(rows: DataFrame, x1: str, x2: str, y: str) -> DataFrame:
    """``(b0, b1, b2)`` of least squares on two columns, from their covariances."""
    s = rows.agg(*(F.covar_pop(p, q).alias(n) for n, p, q in (("s11", x1, x1), ("s22", x2, x2), ("s12", x1, x2), ("s1", x1, y), ("s2", x2, y))), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("m"))
    d = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    s = s.withColumn("b1", (F.col("s1") * F.col("s22") - F.col("s2") * F.col("s12")) / d).withColumn("b2", (F.col("s2") * F.col("s11") - F.col("s1") * F.col("s12")) / d)
    return s.select((F.col("m") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2")


def sample_fits(values: DataFrame, value: str) -> DataFrame:
    """Closed-form fits: exponential and Poisson rates, lognormal parameters, generalised Pareto by moments."""
    v = F.col(value).cast("double")
    s = values.select(v.alias("v")).where("v > 0").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"), F.avg(F.log("v")).alias("ln_mu"), F.stddev_pop(F.log("v")).alias("ln_sigma"))
    ratio = F.col("mean") * F.col("mean") / F.col("var")
    return s.select("n", (1 / F.col("mean")).alias("exp_rate"), F.col("mean").alias("poisson_rate"), "ln_mu", "ln_sigma", (0.5 * (1 - ratio)).alias("gpd_shape"), (0.5 * F.col("mean") * (1 + ratio)).alias("gpd_scale"))


def chi_square(cells: DataFrame, x: str, y: str, n: str) -> DataFrame:
    """Independence of two binned variables: statistic, rows, columns, degrees of freedom (absent rows and columns do not count).

    Of the cells' number less one, rows + columns - 1 more degrees are taken, as the analyses that use it do; the
    textbook's (rows - 1) * (columns - 1) is one more.
    """
    whole = Window.partitionBy(F.lit(1))
    e = cells.withColumn("row", F.sum(n).over(Window.partitionBy(x))).withColumn("col", F.sum(n).over(Window.partitionBy(y)))
    marg = cells.groupBy(x).agg(F.sum(n).alias("row")).crossJoin(cells.groupBy(y).agg(F.sum(n).alias("col")))  # one row for each cell of the table
    full = marg.join(e.select(x, y, F.col(n).alias("n")), [x, y], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("expect", F.col("row") * F.col("col") / F.sum("n").over(whole))
    rows, cols = F.countDistinct(x), F.countDistinct(y)
    return full.agg(F.sum((F.col("n") - F.col("expect")) * (F.col("n") - F.col("expect")) / F.col("expect")).alias("chi2"), rows.alias("n_rows"), cols.alias("n_cols"), (rows * cols - rows - cols).alias("dof"))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series for small x, a continued fraction beyond."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi_square_p(chi2: float, dof: int) -> float:
    return upper_gamma(dof / 2, chi2 / 2)


def gamma_ratio_curve(spark, alphas: list[float], top: int) -> DataFrame:
    """``G(n - a + 1) / G(n + 1)`` for whole n up to ``top`` as running products of ``(n - a) / n`` in logarithms."""
    grid = spark.range(1, top + 1).select(F.col("id").alias("n"), F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    # ln G(n - a + 1) = ln G(2 - a) + sum of ln(k - a + 1) for k from 2
    over = Window.partitionBy("alpha").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    start = F.create_map(*[F.lit(v) for a in alphas for v in (float(a), math.lgamma(2 - a) if a != 2 else 0.0)])
    step = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.log((F.col("n") - F.col("alpha")) / F.col("n")))
    return grid.select("alpha", "n", F.exp(start[F.col("alpha")] + F.sum(step).over(over)).alias("ratio"))


def self_convolved(dist: DataFrame, times: int) -> DataFrame:
    """``(bin, p)`` convolved with itself ``times`` times; the grid of bins bounds each product."""
    out = dist.select("bin", "p")
    for _ in range(times):
        other = dist.select(F.col("bin").alias("b2"), F.col("p").alias("p2"))
        out = out.crossJoin(F.broadcast(other)).groupBy((F.col("bin") + F.col("b2")).alias("bin")).agg(F.sum(F.col("p") * F.col("p2")).alias("p"))
    return out
