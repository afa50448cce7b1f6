"""Queries on distributions, histograms, fits and the growth model."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog import register
from strataloom.functions import fit
from strataloom.operators import distribution as ds
from strataloom.tables import Tables, oracle

#: changes of each file, the running example
PDF = "d as (select n as value, count(*) as freq from (select file_id, count(*) as n from v_commit_files group by file_id) c group by n)"


def _dist(spark, sf_dir):
    return ds.count_of_counts(Tables(spark, sf_dir).v_commit_files, "file_id").withColumnRenamed("n", "value")


def _with(sql: str) -> str:
    return oracle(f"with {PDF} {sql}")


@register("pdf", _with("select value, freq from d"))
def pdf(spark, sf_dir):
    return _dist(spark, sf_dir)


@register("cdf", _with("select value, freq, sum(freq) over (order by value) as cum from d"))
def cdf(spark, sf_dir):
    return ds.cumulative(_dist(spark, sf_dir))


@register("ccdf_sparse", _with("select value, freq, sum(freq) over (order by value desc) as cum from d"))
def ccdf_sparse(spark, sf_dir):
    return ds.cumulative(_dist(spark, sf_dir), descending=True)


_DENSE = "g as (select unnest(range(1, (select max(value) + 1 from d))) as value), f as (select g.value, coalesce(d.freq, 0) as freq from g left join d using (value))"


@register("ccdf_dense", oracle(f"with {PDF}, {_DENSE} select value, freq, sum(freq) over (order by value desc) as cum from f"))
def ccdf_dense(spark, sf_dir):
    return ds.dense(_dist(spark, sf_dir))


@register("cdf_dense", oracle(f"with {PDF}, {_DENSE} select value, freq, sum(freq) over (order by value) as cum from f"))
def cdf_dense(spark, sf_dir):
    return ds.dense(_dist(spark, sf_dir), descending=False)


@register("ccdf_normalised", oracle(f"with {PDF}, c as (select value, sum(freq) over (order by value desc) as cum from d) select value, cum, round(cum / max(cum) over (), 9) as p from c"))
def ccdf_normalised(spark, sf_dir):
    return ds.normalised(ds.cumulative(_dist(spark, sf_dir), descending=True)).select("value", "cum", F.round("p", 9).alias("p"))


@register("pdf_from_cdf", oracle(f"with {PDF}, c as (select value, sum(freq) over (order by value) as cum from d) select value, cum, cum - coalesce(lag(cum) over (order by value), 0) as freq from c"))
def pdf_from_cdf(spark, sf_dir):
    return ds.difference(ds.cumulative(_dist(spark, sf_dir)).select("value", "cum"))


@register("moments", _with("select sum(freq) as n, round(sum(value * freq) / sum(freq), 6) as mean, round(sum(value * value * freq) / sum(freq) - power(sum(value * freq) / sum(freq), 2), 6) as variance from d"))
def moments(spark, sf_dir):
    return ds.moments(_dist(spark, sf_dir)).select("n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@register("exp_bins", _with("select cast(floor(round(ln(value) / ln(2.0), 9)) as integer) as bin, round(avg(value), 6) as avg_value, round(avg(freq), 6) as avg_freq, count(*) as points from d group by 1"))
def exp_bins(spark, sf_dir):
    return ds.exponential_bins(_dist(spark, sf_dir)).select("bin", F.round("avg_value", 6).alias("avg_value"), F.round("avg_freq", 6).alias("avg_freq"), "points")


@register("pdf_expanded", oracle("select count(*) as value from v_commit_files group by file_id"))
def pdf_expanded(spark, sf_dir):
    return ds.expanded(_dist(spark, sf_dir))


def _hist_sql(extra: int) -> str:
    return oracle(f"""with {PDF}, b as (select min(value) as lo, (max(value) + {extra} - min(value)) / cast(20 as double) as step from d),
 h as (select case when step > 0 then cast(greatest(ceil(round((value - lo) / step, 9)) - 1, 0) as integer) else 0 end as bin, sum(freq) as freq, any_value(lo) as lo, any_value(step) as step from d, b group by 1)
 select bin, round(lo + bin * step, 6) as "left", freq, sum(freq) over (order by bin desc) as ccdf from h""")


@register("hist_ref_minmax", _hist_sql(0))
def hist_ref_minmax(spark, sf_dir):
    return ds.right_closed_histogram(_dist(spark, sf_dir), 20).withColumn("left", F.round("left", 6))


@register("hist_ref_max1", _hist_sql(1))
def hist_ref_max1(spark, sf_dir):
    return ds.right_closed_histogram(_dist(spark, sf_dir), 20, top_extra=1).withColumn("left", F.round("left", 6))


@register("hist_equal_width", "select cast(least(floor((l_quantity - 1) * 500 / 49.0), 499) as integer) as bin, count(*) as freq from lineitem where l_quantity between 1 and 50 group by 1")
def hist_equal_width(spark, sf_dir):
    return ds.histogram(Tables(spark, sf_dir).lineitem, "l_quantity", 500, 1, 50)


@register("weight_hist", oracle("""with d as (select weight as value, count(*) as freq from v_bipartite group by weight), b as (select (max(value) - 0) / cast(10 as double) as step from d),
 h as (select cast(greatest(ceil(round(value / step, 9)) - 1, 0) as integer) as bin, sum(freq) as freq, any_value(step) as step from d, b group by 1)
 select bin, round(bin * step, 6) as "left", freq, sum(freq) over (order by bin desc) as ccdf from h"""))
def weight_hist(spark, sf_dir):
    dist = ds.pdf(Tables(spark, sf_dir).v_bipartite, "weight")
    return ds.right_closed_histogram(dist, 10, low=F.lit(0)).withColumn("left", F.round("left", 6))


JOINT = "j as (select x, y, count(*) as freq from (select author_id, count(*) as x, count(distinct project_id) as y from v_commits group by author_id) t group by x, y)"


def _joint(spark, sf_dir):
    each = Tables(spark, sf_dir).v_commits.groupBy("author_id").agg(F.count("*").alias("commits"), F.countDistinct("project_id").alias("projects"))
    return ds.joint(each, "commits", "projects")


@register("joint_freq", oracle(f"with {JOINT} select x, y, freq from j"))
def joint_freq(spark, sf_dir):
    return _joint(spark, sf_dir)


@register("joint_freq_corr", oracle(f"with {JOINT} select round(corr(y, x), 6) as r, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, count(*) as pairs from j where not (x = 0 and y = 0)"))
def joint_freq_corr(spark, sf_dir):
    return _rounded(fit.joint_correlation(_joint(spark, sf_dir)))


@register("joint_freq_corr_log", oracle(f"""with {JOINT}, l as (select log10(case when x = 0 then 0.1 else x end) as x, log10(case when y = 0 then 0.1 else y end) as y from j where not (x = 0 and y = 0))
 select round(corr(y, x), 6) as r, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, count(*) as pairs from l"""))
def joint_freq_corr_log(spark, sf_dir):
    return _rounded(fit.joint_correlation(_joint(spark, sf_dir), logs=True))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@register("histogram_2d", oracle("select cast(floor(additions / 5.0) as bigint) as bx, cast(floor(deletions / 2.0) as bigint) as by, count(*) as freq from v_commit_files group by 1, 2"))
def histogram_2d(spark, sf_dir):
    return ds.histogram_2d(Tables(spark, sf_dir).v_commit_files, "additions", "deletions", 5.0, 2.0)


@register("rank_ccdf", _with("select row_number() over (order by value desc) as rank, value, sum(freq) over (order by value desc) as cum from d"))
def rank_ccdf(spark, sf_dir):
    from pyspark.sql import Window

    c = ds.cumulative(_dist(spark, sf_dir), descending=True)
    return c.select(F.row_number().over(Window.orderBy(F.col("value").desc())).alias("rank"), "value", "cum")  # a row for each different value


@register("linear_fit", oracle(f"with {PDF} select round(regr_slope(freq, value), 6) as slope, round(regr_intercept(freq, value), 6) as intercept, round(regr_r2(freq, value), 6) as r2, count(*) as points from d"))
def linear_fit(spark, sf_dir):
    return _rounded(fit.line(_dist(spark, sf_dir), F.col("value"), F.col("freq")))


@register("ccdf_loglog_fit", oracle(f"""with {PDF}, c as (select value, sum(freq) over (order by value desc) as cum, row_number() over (order by value) as rk, count(*) over () as n from d)
 select round(regr_slope(log10(cum), log10(value)), 6) as slope, round(regr_intercept(log10(cum), log10(value)), 6) as intercept, count(*) as points from c where rk >= 10 and rk <= n * 0.9"""))
def ccdf_loglog_fit(spark, sf_dir):
    from pyspark.sql import Window

    c = ds.cumulative(_dist(spark, sf_dir), descending=True)
    c = c.withColumn("rk", F.row_number().over(Window.orderBy("value"))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return _rounded(fit.line(c.where("rk >= 10 and rk <= n * 0.9"), F.log10("value"), F.log10("cum"))).drop("r2")


@register("logfit_best", oracle(f"""with {PDF}, p as (select cast(value as double) as x, cast(freq as double) as y from d where value > 0 and freq > 0),
 l as (select 'linear' as kind, x as u, y as v, y from p union all select 'logx', log10(x), y, y from p union all select 'logy', x, log10(y), y from p union all select 'loglog', log10(x), log10(y), y from p),
 f as (select kind, regr_slope(v, u) as slope, regr_intercept(v, u) as intercept, regr_r2(v, u) as r2 from l group by kind),
 e as (select kind, avg(power(y - case when kind in ('logy', 'loglog') then power(10.0, slope * u + intercept) else slope * u + intercept end, 2)) as mse from l join f using (kind) group by kind)
 select kind, round(slope, 6) as slope, round(intercept, 6) as intercept, round(r2, 6) as r2, round(mse, 4) as mse, mse = min(mse) over () as best from f join e using (kind)"""))
def logfit_best(spark, sf_dir):
    f = fit.best_of_four(_dist(spark, sf_dir), "value", "freq")
    return f.select("kind", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("mse", 4).alias("mse"), "best")


@register("power_law_fit", oracle(f"""with {PDF}, t as (select ln(value) as l, ln(value / 10.0) as t, freq from d where value >= 10), s as (select sum(freq) as n, sum(t * freq) as st, sum(l * freq) as sl, sum(l * l * freq) as sll from t),
 u as (select n, st, sl, 1 + n / st as alpha, sl / n as mu, sqrt(sll / n - power(sl / n, 2)) as sigma from s)
 select n, round(alpha, 6) as alpha, round(mu, 6) as mu, round(sigma, 6) as sigma, round(n * ln((alpha - 1) / 10.0) - alpha * st, 4) as loglik_power, round(-sl - n * (ln(sigma) + 0.5 * ln(2 * pi()) + 0.5), 4) as loglik_lognormal from u"""))
def power_law_fit(spark, sf_dir):
    f = fit.power_law_mle(_dist(spark, sf_dir), 10.0)
    return f.select("n", *(F.round(c, 6).alias(c) for c in ("alpha", "mu", "sigma")), *(F.round(c, 4).alias(c) for c in ("loglik_power", "loglik_lognormal")))


@register("sample_fits", oracle("""with s as (select count(*) as n, avg(v) as mean, var_samp(v) as var, avg(ln(v)) as ln_mu, stddev_pop(ln(v)) as ln_sigma from (select cast(count(*) as double) as v from v_commit_files group by file_id) t)
 select n, round(1 / mean, 6) as exp_rate, round(mean, 6) as poisson_rate, round(ln_mu, 6) as ln_mu, round(ln_sigma, 6) as ln_sigma, round(0.5 * (1 - mean * mean / var), 6) as gpd_shape, round(0.5 * mean * (1 + mean * mean / var), 6) as gpd_scale from s"""))
def sample_fits(spark, sf_dir):
    counts = Tables(spark, sf_dir).v_commit_files.groupBy("file_id").agg(F.count("*").alias("v"))
    return _rounded(fit.sample_fits(counts, "v"))


@register("column_statistics", """select round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as sd, round(quantile_cont(l_quantity, 0.5), 4) as median, round(quantile_cont(l_quantity, 0.9), 4) as p90,
 round(corr(l_quantity, l_extendedprice), 6) as r, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem""")
def column_statistics(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"), F.round(F.percentile("l_quantity", 0.5), 4).alias("median"), F.round(F.percentile("l_quantity", 0.9), 4).alias("p90"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


_TAILS = "p as (select cast(value as double) as value, freq from d where value > 0), t as (select a.value as xmin, b.value, b.freq from p a join p b on b.value >= a.value), s as (select xmin, sum(freq) as n, sum(ln(value / xmin) * freq) as s from t group by xmin having sum(freq) >= 10 and sum(ln(value / xmin) * freq) > 0), f as (select xmin, n, 1 + n / s as alpha from s), c as (select t.xmin, n, alpha, value, sum(freq) over (partition by t.xmin order by value) / n as cum, freq / cast(n as double) as own from t join f on f.xmin = t.xmin), k as (select xmin, max(greatest(abs(cum - (1 - power(value / xmin, 1 - alpha))), abs(cum - own - (1 - power(value / xmin, 1 - alpha))))) as ks from c group by xmin)"


@register("power_law_scan", oracle(f"with {PDF}, {_TAILS} select f.xmin, n, round(alpha, 6) as alpha, round(ks, 6) as ks, row_number() over (order by round(ks, 12), f.xmin) = 1 as best from f join k on k.xmin = f.xmin"))
def power_law_scan(spark, sf_dir):
    """Every lower bound of a power law, and the one of least distance."""
    s = fit.power_law_scan(_dist(spark, sf_dir))
    return s.select("xmin", "n", F.round("alpha", 6).alias("alpha"), F.round("ks", 6).alias("ks"), "best")


@register("pareto_ml", oracle(f"with {PDF}, p as (select cast(value as double) as x, freq from d where value > 0), s as (select max(x) as top, sum(x * freq) / sum(freq) as mean, sum(freq) as n from p), g as (select -0.999 / top + (10 / mean + 0.999 / top) * i / 400 as t, n from s, range(0, 401) r(i)), k as (select t, n, sum(ln(1 + t * x) * freq) / n as shape from p, g where abs(t) > 1e-12 group by t, n), l as (select t, shape, shape / t as scale, -n * (ln(shape / t) + shape + 1) as loglik from k where shape / t > 0 and shape > -0.5) select round(shape, 6) as shape, round(scale, 6) as scale, round(loglik, 4) as loglik from l order by round(l.loglik, 9) desc, t desc limit 1"))
def pareto_ml(spark, sf_dir):
    f = fit.pareto_ml(_dist(spark, sf_dir))
    return f.select(F.round("shape", 6).alias("shape"), F.round("scale", 6).alias("scale"), F.round("loglik", 4).alias("loglik"))


@register("exponential_least_squares", oracle(f"with {PDF}, c as (select value, sum(freq) over (order by value desc) / cast(sum(freq) over () as double) as ccdf from d) select round(-regr_slope(ln(ccdf), value), 9) as rate, round(exp(regr_intercept(ln(ccdf), value)), 6) as scale from c"))
def exponential_least_squares(spark, sf_dir):
    f = fit.least_squares_rate(_dist(spark, sf_dir))
    return f.select(F.round("rate", 9).alias("rate"), F.round("scale", 6).alias("scale"))


@register("four_laws", oracle(f"with {PDF}, p as (select cast(value as double) as x, cast(freq as double) as y from d where value > 0 and freq > 0), l as (select 'linear' as law, x as u, y as v, y from p union all select 'power', ln(x), ln(y), y from p union all select 'log', ln(x), y, y from p union all select 'exp', x, ln(y), y from p), f as (select law, regr_intercept(v, u) as c, regr_slope(v, u) as b, regr_r2(v, u) as r2 from l group by law), e as (select law, sum(power(y - case when law in ('power', 'exp') then exp(c + b * u) else c + b * u end, 2)) as chi2 from l join f using (law) group by law) select law, round(case when law in ('power', 'exp') then exp(c) else c end, 4) as a, round(b, 6) as b, round(chi2, 3) as chi2, round(r2, 6) as r2 from f join e using (law)"))
def four_laws(spark, sf_dir):
    f = fit.four_laws(_dist(spark, sf_dir), "value", "freq")
    return f.select("law", F.round("a", 4).alias("a"), F.round("b", 6).alias("b"), F.round("chi2", 3).alias("chi2"), F.round("r2", 6).alias("r2"))


@register("distribution_entropy", oracle(f"with {PDF}, t as (select sum(freq) as n from d) select round(-sum(freq / cast(n as double) * log2(freq / cast(n as double))), 6) as entropy, count(*) as kinds from d, t"))
def distribution_entropy(spark, sf_dir):
    d = _dist(spark, sf_dir)
    p = F.col("freq") / F.col("n")
    return d.crossJoin(F.broadcast(d.agg(F.sum("freq").alias("n")))).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"), F.count("*").alias("kinds"))  # one row


@register("welch_test", """with s as (select avg(l_extendedprice) filter (where l_returnflag = 'R') as m1, var_samp(l_extendedprice) filter (where l_returnflag = 'R') as v1, count(l_extendedprice) filter (where l_returnflag = 'R') as n1,
 avg(l_extendedprice) filter (where l_returnflag <> 'R') as m0, var_samp(l_extendedprice) filter (where l_returnflag <> 'R') as v0, count(l_extendedprice) filter (where l_returnflag <> 'R') as n0 from lineitem)
 select round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as t, round(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)), 3) as dof from s""")
def welch_test(spark, sf_dir):
    w = fit.welch(Tables(spark, sf_dir).lineitem, "l_extendedprice", F.col("l_returnflag") == "R")
    return w.select(F.round("t", 6).alias("t"), F.round("dof", 3).alias("dof"))


@register("kolmogorov_smirnov", """with c as (select l_quantity as value, count(*) filter (where l_returnflag = 'R') as a, count(*) filter (where l_returnflag = 'N') as b from lineitem group by 1), r as (select sum(a) over (order by value) as ca, sum(b) over (order by value) as cb, sum(a) over () as n, sum(b) over () as m from c)
 select round(max(abs(ca / cast(n as double) - cb / cast(m as double))), 9) as d, max(n) as n, max(m) as m from r""")
def kolmogorov_smirnov(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    k = fit.kolmogorov_smirnov(ds.pdf(li.where("l_returnflag = 'R'"), "l_quantity"), ds.pdf(li.where("l_returnflag = 'N'"), "l_quantity"))
    return k.select(F.round("d", 9).alias("d"), "n", "m")


@register("plane_fit", """with s as (select var_pop(l_quantity) as s11, var_pop(l_discount) as s22, covar_pop(l_quantity, l_discount) as s12, covar_pop(l_quantity, l_extendedprice) as s1, covar_pop(l_discount, l_extendedprice) as s2, avg(l_quantity) as m1, avg(l_discount) as m2, avg(l_extendedprice) as m from lineitem),
 b as (select *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) as b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) as b2 from s) select round(m - b1 * m1 - b2 * m2, 3) as b0, round(b1, 5) as b1, round(b2, 3) as b2 from b""")
def plane_fit(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select(*(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_extendedprice")))
    p = fit.plane(li, "l_quantity", "l_discount", "l_extendedprice")
    return p.select(F.round("b0", 3).alias("b0"), F.round("b1", 5).alias("b1"), F.round("b2", 3).alias("b2"))


_ALPHAS = [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5]
_GAMMA = "a as (select unnest([0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5])::double as alpha), g as (select alpha, n, exp(lgamma(n - alpha + 1) - lgamma(n + 1)) as ratio from a, range(1, 1001) t(n))"


@register("gamma_ratio_curve", f"with {_GAMMA} select alpha, n, round(ratio, 9) as ratio from g")
def gamma_ratio_curve(spark, sf_dir):
    return fit.gamma_ratio_curve(spark, _ALPHAS, 1000).withColumn("ratio", F.round("ratio", 9))


@register("gamma_exponents", f"with {_GAMMA} select alpha, round(regr_slope(log10(ratio), log10(n)), 6) as exponent from g where n <= 100 group by alpha")
def gamma_exponents(spark, sf_dir):
    """The slope of each curve over n = 1 .. 100 on logarithmic axes."""
    f = fit.line(fit.gamma_ratio_curve(spark, _ALPHAS, 100), F.log10("n"), F.log10("ratio"), ["alpha"])
    return f.select("alpha", F.round("slope", 6).alias("exponent"))


FACTORS = "f as (select path, seq, log10(factor) as lf, new_size - old_size as delta from v_size_log where factor > 0)"


def _factors(spark, sf_dir):
    return Tables(spark, sf_dir).v_size_log.where("factor > 0").select("path", "seq", F.log10("factor").alias("lf"), (F.col("new_size") - F.col("old_size")).alias("delta"))


@register("log_factor_hist", oracle(f"with {FACTORS}, m as (select max(abs(lf)) as top from f) select cast(least(floor(round((lf + top) * 499 / (2 * top), 6)), 498) as integer) as bin, count(*) as freq from f, m group by 1"))
def log_factor_hist(spark, sf_dir):
    """499 bins from minus to plus the largest absolute logarithm."""
    v = _factors(spark, sf_dir)
    top = v.agg(F.max(F.abs("lf")).alias("top"))  # one row
    place = F.floor(F.round((F.col("lf") + F.col("top")) * 499 / (2 * F.col("top")), 6))
    return v.crossJoin(F.broadcast(top)).groupBy(F.least(place, F.lit(498)).cast("int").alias("bin")).agg(F.count("*").alias("freq"))


@register("initial_size_hist", oracle("select cast(floor(old_size / 1000) as bigint) as bin, count(*) as freq from v_size_log where seq = 2 group by 1"))
def initial_size_hist(spark, sf_dir):
    return Tables(spark, sf_dir).v_size_log.where("seq = 2").groupBy(F.floor(F.col("old_size") / 1000).alias("bin")).agg(F.count("*").alias("freq"))


@register("size_changes_by_file", oracle(f"with {FACTORS} select path, count(*) as changes, round(avg(lf), 6) as mean_lf, round(stddev_pop(lf), 6) as sd_lf, round(sum(delta), 2) as total_delta from f group by path"))
def size_changes_by_file(spark, sf_dir):
    f = _factors(spark, sf_dir).groupBy("path").agg(F.count("*").alias("changes"), F.round(F.avg("lf"), 6).alias("mean_lf"), F.round(F.stddev_pop("lf"), 6).alias("sd_lf"), F.round(F.sum("delta"), 2).alias("total_delta"))
    return f


@register("kth_change", oracle(f"with {FACTORS}, k as (select row_number() over (partition by path order by seq) as k, lf from f) select k, count(*) as files, round(avg(lf), 6) as mean_lf from k group by k"))
def kth_change(spark, sf_dir):
    from pyspark.sql import Window

    k = _factors(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("seq")))
    return k.groupBy("k").agg(F.count("*").alias("files"), F.round(F.avg("lf"), 6).alias("mean_lf"))


CELLS = f"{FACTORS}, k as (select lf, lead(lf) over (partition by path order by seq) as nxt from f), c as (select cast(sign(lf) as integer) * cast(least(floor(abs(lf) * 4), 2) as integer) as x, cast(sign(nxt) as integer) * cast(least(floor(abs(nxt) * 4), 2) as integer) as y, count(*) as n from k where nxt is not null group by 1, 2)"


def _cells(spark, sf_dir):
    from pyspark.sql import Window

    k = _factors(spark, sf_dir).withColumn("nxt", F.lead("lf").over(Window.partitionBy("path").orderBy("seq"))).where("nxt is not null")
    level = lambda c: F.signum(c).cast("int") * F.least(F.floor(F.abs(c) * 4), F.lit(2)).cast("int")
    return k.groupBy(level("lf").alias("x"), level("nxt").alias("y")).agg(F.count("*").alias("n"))


_CHI = """rs as (select x, sum(n) as r from c group by x), cs as (select y, sum(n) as q from c group by y), t as (select sum(n) as total from c),
 e as (select coalesce(c.n, 0) as n, r * q / cast(total as double) as ex from rs cross join cs cross join t left join c using (x, y))"""


@register("chi2_independence", oracle(f"with {CELLS}, {_CHI} select round(sum(power(n - ex, 2) / ex), 4) as chi2, (select count(*) from rs) as n_rows, (select count(*) from cs) as n_cols, (select count(*) from rs) * (select count(*) from cs) - (select count(*) from rs) - (select count(*) from cs) as dof from e"))
def chi2_independence(spark, sf_dir):
    return fit.chi_square(_cells(spark, sf_dir), "x", "y", "n").withColumn("chi2", F.round("chi2", 4))


@register("chi2_p_value")
def chi2_p_value(spark, sf_dir):
    r = fit.chi_square(_cells(spark, sf_dir), "x", "y", "n").first()
    return spark.createDataFrame([(r.chi2, r.dof, fit.chi_square_p(r.chi2, r.dof))], "chi2 double, dof bigint, p double")


_BASE = f"{FACTORS}, b as (select cast(floor(lf * 4) as integer) as bin, count(*) as n from f where lf between -2 and 2 group by 1), p as (select bin, n / cast(sum(n) over () as double) as p from b)"


@register("convolve_n", oracle(f"""with {_BASE}, c1 as (select a.bin + b.bin as bin, sum(a.p * b.p) as p from p a, p b group by 1), c2 as (select a.bin + b.bin as bin, sum(a.p * b.p) as p from c1 a, p b group by 1),
 c3 as (select a.bin + b.bin as bin, sum(a.p * b.p) as p from c2 a, p b group by 1) select bin, round(p, 9) as p from c3"""))
def convolve_n(spark, sf_dir):
    return fit.self_convolved(_base(spark, sf_dir), 3).select("bin", F.round("p", 9).alias("p"))


def _base(spark, sf_dir):
    from pyspark.sql import Window

    b = _factors(spark, sf_dir).where("lf between -2 and 2").groupBy(F.floor(F.col("lf") * 4).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return b.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("p"))  # one row for each of a few bins


@register("convolved_ccdf", oracle(f"with {_BASE}, c1 as (select a.bin + b.bin as bin, sum(a.p * b.p) as p from p a, p b group by 1) select bin, round(sum(p) over (order by bin desc), 9) as ccdf from c1"))
def convolved_ccdf(spark, sf_dir):
    c = fit.self_convolved(_base(spark, sf_dir), 1).select(F.col("bin").alias("value"), F.col("p").alias("freq"))
    return ds.cumulative(c, descending=True).select(F.col("value").alias("bin"), F.round("cum", 9).alias("ccdf"))
