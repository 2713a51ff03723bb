"""Windows and bins of observed against predicted diversity, the model, and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.operators import bins, resample, smooth, stats
from segspark.operators.model import Model, simulated
from segspark.plans import views as v
from segspark.plans.sites import draw_sql

MODEL = Model(["b1", "b2"], unit=1.0)
_WEIGHTS = (-6.0, 6.0)  # bounds of log10 weights; a weight of a millionth does nothing
PARAMETERS = [0.3, 0.1, 0.25]  # log10 weights of the two maps, and tau


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MODEL.predict(v.segments(spark, sf_dir), PARAMETERS)


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if c in columns else c for c in rows.columns])


def predicted_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_predicted(spark, sf_dir).select("chrom", "pos", "pred"), "pred")


def composite_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(MODEL.log_likelihood(v.segments(spark, sf_dir), PARAMETERS).select((F.col("cllh") / 1e5).alias("cllh")), "cllh")


def loglik_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(MODEL.gradient(v.segments(spark, sf_dir), PARAMETERS).withColumn("derivative", F.col("derivative") / 1e5), "derivative")


def loglik_bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood under block multiplicities of 0 to 3, drawn for blocks of 100 days."""
    block = F.floor((F.col("pos") - 1) / 100).cast("long")
    rows = v.segments(spark, sf_dir).withColumn("w", resample.draw(F.col("chrom"), block, 4))
    return _rounded(MODEL.log_likelihood(rows, PARAMETERS, "w").select((F.col("cllh") / 1e5).alias("cllh")), "cllh")


def optimise_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's log10 weight and tau after 80 steps of Fisher scoring, which need not end at one point where the weight goes to its least."""
    fit = Model(["b1"]).scored(v.segments(spark, sf_dir), {None: [0.0, 0.25]}, weights=_WEIGHTS)[None]
    return spark.createDataFrame([("b1", round(float(fit.parameters[0]), 3)), ("tau", round(float(fit.parameters[1]), 3))], "parameter string, value double")


def window_obs_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bins.fixed(_predicted(spark, sf_dir), 100), "obs", "pred")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.dense(bins.fixed(_predicted(spark, sf_dir), 100))


def window_rsquared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.r_squared(_windows(spark, sf_dir), "obs", "pred")
    return rows.select(F.round("r2", 2).alias("r2"), F.round("residual_term", 2).alias("residual_term"), "windows")


def sliding_obs_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bins.sliding(_predicted(spark, sf_dir), 50), "obs", "pred")


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bins.moving_average(v.segments(spark, sf_dir), "nu", 90, 30), "mean")


def equal_weight_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bins.equal_weight(_predicted(spark, sf_dir).withColumn("pred", F.round("pred", 9)), "pred", ["chrom", "pos"], "sites", 25)
    return rows.groupBy("bin").agg(F.sum("sites").alias("sites"), F.sum("het").alias("het"), F.round(F.avg("pred"), 6).alias("pred"))


def equal_count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bins.equal_count(v.segments(spark, sf_dir), "het", ["chrom", "pos"], 20)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("het").alias("low"), F.max("het").alias("high"))


def value_edge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.sites(spark, sf_dir).withColumn("bin", bins.by_edges(F.col("alt"), [10, 20, 25, 40]))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("alt").alias("alt"))


def top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bins.top_fraction(v.segments(spark, sf_dir), "het", ["chrom", "pos"], "sites", 0.1)
    return rows.select("chrom", "pos", "het")


def _map_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = F.floor((F.col("pos") - 1) / 50).cast("long")
    return v.segments(spark, sf_dir).groupBy("chrom", win.alias("win")).agg(F.round(F.avg("b1"), 9).alias("b1"), F.round(F.avg("b2"), 9).alias("b2"))


def pearson_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map_means(spark, sf_dir).agg(F.round(F.corr("b1", "b2"), 6).alias("r"))


def spearman_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(_map_means(spark, sf_dir), "b1", "b2").select(F.round("rho", 6).alias("rho"))


def ols_intercept_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.ols(_map_means(spark, sf_dir), "b1", "b2"), "slope", "intercept", "low", "high")


def error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.error_bands(_map_means(spark, sf_dir), "b1", "b2", 0.0007), "percent")


def signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.segments(spark, sf_dir).groupBy(F.floor((F.col("pos") - 1) / 20).cast("long").alias("win")).agg(F.sum("het").alias("a"), F.sum((F.col("hom") / 4).cast("long")).alias("b"))
    return stats.signed_rank(rows, "a", "b", ["win"]).select(F.col("w").cast("long").alias("w"), "n")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.segments(spark, sf_dir).groupBy("chrom", F.floor((F.col("pos") - 1) / 100).cast("long").alias("win"))
    return rows.agg(F.sum("het").alias("het"), F.sum(F.col("het") + F.col("hom")).alias("pairs"), F.sum("sites").alias("sites"), F.sum("poly").alias("poly"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.numbered(_blocks(spark, sf_dir), ["chrom", "win"], ["het", "pairs", "sites", "poly"])


def jackknife_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.leave_one_out(_numbered(spark, sf_dir), "het", "pairs", "idx"), "estimate")


def jackknife_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.jackknife_variance(resample.leave_one_out(_numbered(spark, sf_dir), "het", "pairs", "idx"))
    return rows.select("blocks", F.round("mean", 6).alias("mean"), F.round(F.col("variance") * 1e6, 4).alias("variance_e6"))


def _left_out(spark: SparkSession, sf_dir: str) -> tuple[Model, DataFrame, dict]:
    """The model of one map, segments, and for each chromosome the fit without it; a fit as in ``optimise_params``."""
    model, rows = Model(["b1"]), v.segments(spark, sf_dir)
    return model, rows, model.scored(rows, dict.fromkeys(range(5), [0.0, 0.25]), "chrom", _WEIGHTS)


def leave_one_out_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean predictions of each chromosome by the parameters fitted without it."""
    model, rows, fits = _left_out(spark, sf_dir)
    return model.predict_left_out(rows, fits, "chrom").groupBy("chrom").agg(F.round(F.avg("pred"), 5).alias("pred"))


def leave_one_out_rsquared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R^2 of windows under the predictions that leave out each window's own chromosome."""
    model, rows, fits = _left_out(spark, sf_dir)
    windows = bins.dense(bins.fixed(model.predict_left_out(rows, fits, "chrom"), 100))
    return stats.r_squared(windows, "obs", "pred").select(F.round("r2", 3).alias("r2"), "windows")


def leave_one_out_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is fitted without each chromosome: the map's weight, tau, and -1 times the mean log probability of a pair."""
    found = [(int(b), round(10 ** float(f.parameters[0]), 3), round(float(f.parameters[1]), 4), round(float(f.value) / 1e5, 6)) for b, f in _left_out(spark, sf_dir)[2].items()]
    return spark.createDataFrame(found, "chrom long, weight double, tau double, cllh double")


def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.bootstrap(_numbered(spark, sf_dir), 200, "het", "pairs"), "estimate")


def permutation_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.permutation(_numbered(spark, sf_dir).withColumn("half", F.floor(F.col("sites") / 2)).withColumn("other", F.col("sites") - F.col("half")), 499, "other", "half"), "p")


def sim_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    het, hom = simulated(F.round("pred", 9), F.col("het") + F.col("hom"))
    return _predicted(spark, sf_dir).select("chrom", "pos", het.alias("sim_het"), hom.alias("sim_hom"))


def combine_sparse_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).select("chrom", F.col("win").alias("bin"), F.col("sites").alias("n"))
    return bins.combine_sparse(rows, 60, ["chrom"])


def savgol_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(smooth.polynomial(bins.fixed(_predicted(spark, sf_dir), 100), 5, 2, ["chrom"], "win", "obs"), "smooth")


def loess_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(smooth.local_regression(bins.fixed(_predicted(spark, sf_dir), 100), 0.4, ["chrom"], "win", "obs", "n"), "smooth")


def nonredundant_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.operators.intervals import nonredundant

    genes = v.intervals_b(spark, sf_dir).groupBy("chrom", "start", "end").agg(F.count("*").alias("size")).withColumn("name", F.concat_ws("-", "start", "end"))
    return nonredundant(genes)


def merged_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.operators.intervals import merge_weighted

    rows = v.intervals_b(spark, sf_dir).groupBy("chrom", "start", "end").agg(F.count("*").alias("value"))
    return merge_weighted(rows)


QUERIES = {f.__name__: f for f in (predicted_pi, composite_loglik, loglik_gradient, loglik_bootstrap_weights, optimise_params, window_obs_pred, window_rsquared, sliding_obs_pred, moving_average, equal_weight_bins, equal_count_bins, value_edge_bins, top_fraction, pearson_maps, spearman_maps, ols_intercept_ci, error_bands, signed_rank, jackknife_blocks, jackknife_variance, leave_one_out_pred, leave_one_out_rsquared, leave_one_out_parameters, bootstrap_means, permutation_pvalue, sim_deterministic, combine_sparse_bins, savgol_windows, loess_windows, nonredundant_greedy, merged_weighted)}

_D = "cast({} as double)".format
_B, _THETA = f"greatest(exp(b1 * power({_D(10)}, {_D(0.3)}) + b2 * power({_D(10)}, {_D(0.1)})), {_D('1e-5')})", f"nu / {_D(0.25)}"
_PI = f"greatest({_THETA} / (1 / {_B} + {_THETA}), {_D('1e-5')})"
_PRED = f"{v.SEGMENTS}, pred as (select *, {_PI} as pred from segs)"
_WIN = f"{_PRED}, win as (select chrom, pos // 100 as win, cast(sum(het) as double) / cast(sum(het + hom) as double) as obs, sum(pred * sites) / cast(sum(sites) as double) as pred, cast(sum(sites) as bigint) as n from pred group by 1, 2)"
_DENSE = f"{_WIN}, dense as (select * from win where n > cast(0.2 as double) * (select avg(n) from win))"
_MEANS = f"{v.SEGMENTS}, means as (select chrom, (pos - 1) // 50 as win, round(avg(b1), 9) as b1, round(avg(b2), 9) as b2 from segs group by 1, 2)"
_BLOCKS = f"{v.SEGMENTS}, blocks0 as (select chrom, (pos - 1) // 100 as win, cast(sum(het) as bigint) as het, cast(sum(het + hom) as bigint) as pairs, cast(sum(sites) as bigint) as sites from segs group by 1, 2), blocks as (select *, row_number() over (order by chrom, win) - 1 as idx from blocks0)"
_LLH = f"(hom * ln(1 - {_PI}) + het * ln({_PI}))"
_LEFT = f"{_BLOCKS}, t as (select sum(het) as h, sum(pairs) as p from blocks), j as (select idx, cast(h - het as double) / cast(p - pairs as double) as estimate from blocks, t)"
_OUTER, _DOWN = "(het / pred - hom / (1 - pred))", f"(1 / {_B} + {_THETA})"


def _gradient(name: str, derivative: str) -> str:
    return f"select '{name}' as parameter, round(sum({_OUTER} * ({derivative})) * -1 / cast(sum(hom + het) as double), 6) as derivative from pred"


ORACLE_SQL = {
    "predicted_pi": f"with {_PRED} select chrom, pos, round(pred, 6) as pred from pred",
    "composite_loglik": f"with {v.SEGMENTS} select round(-sum({_LLH}) / cast(sum(hom + het) as double), 6) as cllh from segs",
    "loglik_gradient": f"with {_PRED} " + " union all ".join([_gradient("b1", f"pred / {_DOWN} / {_B} * b1 * power({_D(10)}, {_D(0.3)}) * ln({_D(10)})"), _gradient("b2", f"pred / {_DOWN} / {_B} * b2 * power({_D(10)}, {_D(0.1)}) * ln({_D(10)})"), _gradient("tau", f"-({_THETA} / {_D(0.25)}) * (1 / {_DOWN} - {_THETA} / ({_DOWN} * {_DOWN}))")]),
    "loglik_bootstrap_weights": f"with {v.SEGMENTS}, w as (select *, {draw_sql('chrom', '((pos - 1) // 100)', 4)} as w from segs) select round(-sum({_LLH} * w) / cast(sum((hom + het) * w) as double), 6) as cllh from w",
    "window_obs_pred": f"with {_WIN} select chrom, win, round(obs, 6) as obs, round(pred, 6) as pred, n from win",
    "window_rsquared": f"with {_DENSE}, m as (select avg(obs) as m from dense) select round(1 - sum((obs - pred) * (obs - pred)) / sum((obs - m) * (obs - m)), 2) as r2, round(2 * sum((obs - pred) * (pred - m)) / sum((obs - m) * (obs - m)), 2) as residual_term, count(*) as windows from dense, m",
    "sliding_obs_pred": f"with {_PRED}, w as (select *, unnest([pos // 50 - 1, pos // 50]) as win from pred) select chrom, win, round(cast(sum(het) as double) / cast(sum(het + hom) as double), 6) as obs, round(sum(pred * sites) / cast(sum(sites) as double), 6) as pred, cast(sum(sites) as bigint) as n from w where win >= 0 group by 1, 2",
    "moving_average": f"with {v.SEGMENTS}, k as (select unnest(generate_series(0, {v.LENGTH} // 30)) as win), w as (select chrom, win, count(*) as n, avg(nu) as mean from segs join k on pos >= win * 30 and pos < win * 30 + 90 group by 1, 2) select chrom, win, n, case when n >= cast(0.05 as double) * (select avg(n) from w) then round(mean, 6) end as mean from w",
    "equal_weight_bins": f"with {_PRED}, r as (select chrom, pos, sites, het, round(pred, 9) as pred from pred), u as (select *, sum(sites) over (order by pred, chrom, pos rows unbounded preceding) as upto, sum(sites) over () as total from r), b as (select *, upto // (total // 25) as bin, (total - 1) // (total // 25) as edges from u) select cast(bin as bigint) as bin, cast(sum(sites) as bigint) as sites, cast(sum(het) as bigint) as het, round(avg(pred), 6) as pred from b where bin < edges group by 1",
    "equal_count_bins": f"with {v.SEGMENTS}, u as (select het, row_number() over (order by het, chrom, pos) as k, count(*) over () as total from segs) select (k - 1) // (total // 20) as bin, count(*) as n, min(het) as low, max(het) as high from u group by 1",
    "value_edge_bins": f"with {v.SITES} select case when alt >= 40 then 4 when alt >= 25 then 3 when alt >= 20 then 2 when alt >= 10 then 1 else 0 end as bin, count(*) as n, cast(sum(alt) as bigint) as alt from sites group by 1",
    "top_fraction": f"with {v.SEGMENTS}, u as (select *, sum(sites) over (order by het, chrom, pos rows unbounded preceding) as upto, sum(sites) over () as total from segs) select chrom, pos, het from u where upto > (1 - cast(0.1 as double)) * total",
    "pearson_maps": f"with {_MEANS} select round(corr(b1, b2), 6) as r from means",
    "spearman_maps": f"with {_MEANS}, r as (select rank() over (order by b1) + (count(*) over (partition by b1) - 1) / cast(2 as double) as x, rank() over (order by b2) + (count(*) over (partition by b2) - 1) / cast(2 as double) as y from means) select round(corr(x, y), 6) as rho from r",
    "ols_intercept_ci": f"with {_MEANS}, s as (select regr_slope(b1, b2) as slope, regr_intercept(b1, b2) as intercept, regr_sxx(b1, b2) as sxx, regr_syy(b1, b2) as syy, regr_sxy(b1, b2) as sxy, cast(count(*) as double) as n, avg(b2) as mx from means), e as (select *, sqrt((syy - slope * sxy) / (n - 2) * (1 / n + mx * mx / sxx)) as e from s) select round(slope, 6) as slope, round(intercept, 6) as intercept, round(intercept - cast(1.96 as double) * e, 6) as low, round(intercept + cast(1.96 as double) * e, 6) as high from e",
    "error_bands": f"with {_MEANS} " + " union all ".join(f"select {k} as band, round(100 * avg(case when abs(b1 - b2) > {_D(0.0007 * 2**k)}" + (f" and abs(b1 - b2) <= {_D(0.0007 * 2 ** (k + 1))}" if k < 4 else "") + f" then {_D(1)} else {_D(0)} end), 6) as percent from means" for k in range(5)),
    "signed_rank": f"with {v.SEGMENTS}, w as (select (pos - 1) // 20 as win, sum(het) as a, sum(hom // 4) as b from segs group by 1), r as (select sign(a - b) as s, row_number() over (order by abs(a - b), win) as k from w where a <> b) select cast(sum(s * k) as bigint) as w, count(*) as n from r",
    "jackknife_blocks": f"with {_LEFT} select idx, round(estimate, 6) as estimate from j",
    "jackknife_variance": f"with {_LEFT} select count(*) as blocks, round(avg(estimate), 6) as mean, round((cast(count(*) as double) - 1) * var_pop(estimate) * 1000000, 4) as variance_e6 from j",
    "bootstrap_means": f"with {_BLOCKS}, c as (select count(*) as c from blocks), d as (select i // c as rep, i % c as k, c from (select unnest(generate_series(0, 200 * c - 1)) as i, c from c)), x as (select rep, {draw_sql('rep', 'k', 'c')} as idx from d) select rep, round(cast(sum(het) as double) / cast(sum(pairs) as double), 6) as estimate from x join blocks b on b.idx = x.idx group by rep",
    "permutation_pvalue": f"with {_BLOCKS}, b as (select idx, sites - sites // 2 - sites // 2 as d from blocks), r as (select unnest(generate_series(0, 498)) as rep), s as (select rep, sum(case when {draw_sql('rep', 'idx', 2)} = 0 then d else -d end) as s from b, r group by rep), o as (select sum(d) as observed from b) select cast(observed as bigint) as observed, cast(sum(case when abs(s) >= abs(observed) then 1 else 0 end) as bigint) as exceed, round(cast(sum(case when abs(s) >= abs(observed) then 1 else 0 end) + 1 as double) / 500, 6) as p from s, o group by observed",
    "sim_deterministic": f"with {_PRED} select chrom, pos, cast(floor(round(pred, 9) * (het + hom) + cast(0.5 as double)) as bigint) as sim_het, het + hom - cast(floor(round(pred, 9) * (het + hom) + cast(0.5 as double)) as bigint) as sim_hom from pred",
}


#: Scoring steps for one map and tau, for each fit f over the segments of other chromosomes than f.
_X = "least(greatest(x + greatest(least((gx * ftt - gt * fxt) / nullif(det, 0), 1), -1), -6), 6)"
_T = "case when x <= -6 and gx < 0 then t + gt / ftt else greatest(t + (gt * fxx - gx * fxt) / nullif(det, 0), 0.01) end"
_ONE = f"""select *, th / down as p, th * lost * a * ln({_D(10)}) / (down * down) as dx, -(th / t) * (1 / down - th / (down * down)) as dt from (
  select *, lost + th as down from (select i.f, i.k, i.x, i.t, s.het, s.hom, s.b1 * pow({_D(10)}, i.x) as a, exp(-s.b1 * pow({_D(10)}, i.x)) as lost, s.nu / i.t as th
  from steps i, segs s where s.chrom <> i.f and i.k < 80))"""
_SCORED = f"""{v.SEGMENTS}, steps as (select f, 0 as k, {_D(0)} as x, {_D(0.25)} as t from (select unnest({{fits}}) as f) union all
  select f, k + 1, coalesce({_X}, x), coalesce({_T}, t) from (select *, fxx * ftt - fxt * fxt as det from (
  select f, k, any_value(x) as x, any_value(t) as t, sum((het / p - hom / (1 - p)) * dx) as gx, sum((het / p - hom / (1 - p)) * dt) as gt,
  sum((het + hom) / (p * (1 - p)) * dx * dx) as fxx, sum((het + hom) / (p * (1 - p)) * dx * dt) as fxt, sum((het + hom) / (p * (1 - p)) * dt * dt) as ftt from ({_ONE}) group by f, k))),
  fitted as (select f, x, t from steps where k = 80)"""
_LEFT_OUT = f"with recursive {_SCORED.format(fits='[0, 1, 2, 3, 4]')}, pred as (select chrom, pos, het, hom, sites, nu / t / (exp(-b1 * pow({_D(10)}, x)) + nu / t) as pred from segs join fitted on f = chrom)"
ORACLE_SQL["optimise_params"] = f"with recursive {_SCORED.format(fits='[-1]')} select 'b1' as parameter, round(x, 3) as value from fitted union all select 'tau', round(t, 3) from fitted"
ORACLE_SQL["leave_one_out_pred"] = f"{_LEFT_OUT} select chrom, round(avg(pred), 5) as pred from pred group by chrom"
ORACLE_SQL["leave_one_out_rsquared"] = (
    f"{_LEFT_OUT}, {_DENSE[_DENSE.index('win as (') :]}, m as (select avg(obs) as m from dense) "
    "select round(1 - sum((obs - pred) * (obs - pred)) / sum((obs - m) * (obs - m)), 3) as r2, count(*) as windows from dense, m"
)
ORACLE_SQL["leave_one_out_parameters"] = (
    f"{_LEFT_OUT} select chrom, round(any_value(pow({_D(10)}, x)), 3) as weight, round(any_value(t), 4) as tau, round(any_value(cllh), 6) as cllh from (select f as chrom, x, t from fitted) "
    "join (select f.f as chrom, -sum(hom * ln(1 - p) + het * ln(p)) / cast(sum(hom + het) as double) as cllh from (select f, chrom, het, hom, nu / t / (exp(-b1 * pow(cast(10 as double), x)) + nu / t) as p from segs join fitted on f <> chrom) f group by f.f) using (chrom) group by chrom"
)


ORACLE_SQL["savgol_windows"] = (
    f"with {_WIN}, y as (select chrom, win, obs, row_number() over w as k, count(*) over (partition by chrom) as n, first_value(obs) over w as a, last_value(obs) over (partition by chrom order by win rows between unbounded preceding and unbounded following) as z "
    f"from win window w as (partition by chrom order by win)), o as (select unnest([-2, -1, 0, 1, 2]) as d, unnest([{', '.join(_D(x / 35) for x in (-3, 12, 17, 12, -3))}]) as c) "
    "select y.chrom, y.win, round(sum(c * case when y.k + d < 1 then y.a - abs(x.obs - y.a) when y.k + d > y.n then y.z + abs(x.obs - y.z) else x.obs end), 6) as smooth "
    "from y cross join o join y x on x.chrom = y.chrom and x.k = case when y.k + d < 1 then 2 - y.k - d when y.k + d > y.n then 2 * y.n - y.k - d else y.k + d end group by 1, 2"
)


def folded(rows: str, state: dict[str, tuple[str, str]]) -> str:
    """A recursive pass over ``rows`` (with chrom and k from 1): columns of the state with their first and next expression; s is the
    state before, r the row."""
    first, then = (", ".join(f"{e[j]} as {n}" for n, e in state.items()) for j in (0, 1))
    return f"f as (select r.chrom, r.k, {first} from {rows} r where r.k = 1 union all select r.chrom, r.k, {then} from f s join {rows} r on r.chrom = s.chrom and r.k = s.k + 1)"


_SPANS = f'{v.INTERVALS}, u as (select *, row_number() over (partition by chrom order by "start", "end") as k from (select chrom, "start", "end", count(*) as n from iv_b group by 1, 2, 3))'
_FREE = 'r."start" >= s.e'
_GENES = folded("u", {"g": ("cast(0 as bigint)", f"s.g + case when {_FREE} then 1 else 0 end")} | {c: (f"r.{x}", f"case when {_FREE} or r.n > s.size then r.{x} else s.{c} end") for c, x in (("b", '"start"'), ("e", '"end"'), ("size", "n"))})
_APART = 'r."start" > s.e'
_MEAN = 'cast(floor(0.5::double + cast(s.v * (s.e - s.b) + r.n * (r."end" - r."start") as double) / cast(s.e - s.b + r."end" - r."start" as double)) as bigint)'
_JOINED = folded("u", {"g": ("cast(0 as bigint)", f"s.g + case when {_APART} then 1 else 0 end"), "b": ('r."start"', f'case when {_APART} then r."start" else s.b end'), "e": ('r."end"', f'case when {_APART} then r."end" else greatest(s.e, r."end") end'), "v": ("r.n", f"case when {_APART} then r.n else {_MEAN} end")})
_FILLED = folded("u", {"g": ("cast(0 as bigint)", "s.g + case when s.held >= {m} then 1 else 0 end"), "held": ("r.n", "case when s.held >= {m} then r.n else s.held + r.n end"), "bin": ("r.bin", "r.bin"), "n": ("r.n", "r.n")})
ORACLE_SQL["nonredundant_greedy"] = f"with recursive {_SPANS}, {_GENES} select chrom, b as \"start\", e as \"end\", size, concat(b, '-', e) as name from (select chrom, g, arg_max(b, k) as b, arg_max(e, k) as e, arg_max(size, k) as size from f group by chrom, g)"
ORACLE_SQL["merged_weighted"] = f'with recursive {_SPANS}, {_JOINED} select chrom, arg_max(b, k) as "start", arg_max(e, k) as "end", arg_max(v, k) as value from f group by chrom, g'
ORACLE_SQL["combine_sparse_bins"] = f"with recursive {_BLOCKS}, u as (select chrom, win as bin, sites as n, row_number() over (partition by chrom order by win) as k from blocks), {_FILLED.format(m=60)}, t as (select chrom, g, sum(n) as t, max(g) over (partition by chrom) as last from f group by chrom, g), h as (select f.chrom, f.bin, f.n, case when t.g = last and t.g > 0 and t.t < 60 then t.g - 1 else t.g end as g from f join t on f.chrom = t.chrom and f.g = t.g) select chrom, min(bin) as first, max(bin) as last, cast(sum(n) as bigint) as n from h group by chrom, g"
