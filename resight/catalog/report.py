"""Queries over draws, intervals, and comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from resight.catalog import blocks, sheets as _sheets  # noqa: F401
from resight.catalog.base import big, cte, num, query
from resight.catalog.model import G, S, quantities, rows
from resight.catalog.sheets import _u as draw_sql
from resight.operators import histories as H, model as M, reshape, stats, summary as C
from resight.plans import views as V
from resight.session import settle
from resight.sources.sheets import split_param

YP = ("year", "param")
YP_SQL = "year::BIGINT AS year, param"
QS = (0.025, 0.25, 0.5, 0.75, 0.975)
Q_SQL = ", ".join(num(f"quantile_cont(value, {q})", n) for q, n in zip(QS, ("q2_5", "q25", "q50", "q75", "q97_5")))


def draws(spark, d):
    return V.draws(spark, d)


cte("chains", "dr", "SELECT year, param, chain, count(*) AS c_n, avg(value) AS c_mean, var_samp(value) AS c_var FROM dr GROUP BY ALL")
cte("diag", "chains dr", """
SELECT c.year, c.param, any_value(t.mean) AS mean, any_value(t.sd) AS sd, count(*) AS m, avg(c_n) AS n, var_samp(c_mean) AS b, avg(c_var) AS w, sum(c_n) AS total
FROM chains c JOIN (SELECT year, param, avg(value) AS mean, stddev_samp(value) AS sd FROM dr GROUP BY ALL) t ON c.year = t.year AND c.param = t.param GROUP BY c.year, c.param
""")


@query("summarize_draws", "diag dr", f"""SELECT d.year::BIGINT AS year, d.param, {num('mean', 'mean')}, {num('sd', 'sd')}, {num('sqrt(((n - 1) / n * w + b) / w)', 'rhat')},
{num('least(total, m * ((n - 1) / n * w + b) / b)', 'n_eff')}, q.* EXCLUDE (year, param) FROM diag d JOIN (SELECT year, param, {Q_SQL} FROM dr GROUP BY ALL) q ON d.year = q.year AND d.param = q.param""")
def _(spark, d):
    return C.summarize_draws(draws(spark, d), YP)


@query("sort_summary", "dr", f"SELECT {YP_SQL}, {num('avg(value)', 'mean')} FROM dr GROUP BY year, param")
def _(spark, d):
    return C.sort_summary(C.draw_means(draws(spark, d), YP), YP)


@query("exact_quantiles", "dr", f"SELECT {YP_SQL}, method, {Q_SQL} FROM dr GROUP BY year, param, method")
def _(spark, d):
    return C.exact_quantiles(draws(spark, d), ("year", "param", "method"), "value", QS)


@query("draw_means", "dr", f"SELECT {YP_SQL}, method, {num('avg(value)', 'mean')} FROM dr GROUP BY year, param, method")
def _(spark, d):
    return C.draw_means(draws(spark, d), ("year", "param", "method"))


@query("draw_interval", "dr", f"SELECT {YP_SQL}, {num('quantile_cont(value, 0.025)', 'lower')}, {num('quantile_cont(value, 0.975)', 'upper')} FROM dr GROUP BY year, param")
def _(spark, d):
    return C.draw_interval(draws(spark, d), YP)


cte("bw", "dr", """
SELECT year, param, n, bw, lo - 3 * bw AS x0, (hi - lo + 6 * bw) / 511 AS step FROM (
  SELECT year, param, count(*) AS n, min(value) AS lo, max(value) AS hi,
    9e-1 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34e0) * pow(count(*), -2e-1) AS bw FROM dr GROUP BY ALL)
""")
cte("binned", "bw dr", """
SELECT year, param, bin, sum(w) AS w FROM (
  SELECT d.year, d.param, CAST(floor((value - x0) / step) AS INTEGER) AS bin, 1 - ((value - x0) / step - floor((value - x0) / step)) AS w FROM dr d JOIN bw b ON d.year = b.year AND d.param = b.param
  UNION ALL
  SELECT d.year, d.param, CAST(floor((value - x0) / step) AS INTEGER) + 1, (value - x0) / step - floor((value - x0) / step) FROM dr d JOIN bw b ON d.year = b.year AND d.param = b.param)
GROUP BY ALL
""")
cte("dens", "binned bw", """
SELECT b.year, b.param, any_value(x0 + g * step) AS x, sum(w * exp(-5e-1 * pow((g - bin) * step / bw, 2))) / any_value(n * bw * sqrt(2 * pi())) AS y
FROM binned b JOIN bw ON b.year = bw.year AND b.param = bw.param, (SELECT unnest(range(0, 512)) AS g) GROUP BY b.year, b.param, g
""")


@query("draw_density", "dens", f"SELECT {YP_SQL}, {num('x', 'x', 4)}, {num('y', 'y', 4)} FROM dens", digits=4)
def _(spark, d):
    return C.draw_density(draws(spark, d), YP)


@query("draw_mode", "dens", f"SELECT {YP_SQL}, {num('arg_max(x, y)', 'mode', 4)} FROM dens GROUP BY year, param", digits=4)
def _(spark, d):
    return C.draw_mode(draws(spark, d), YP)


cte("est", "dr", "SELECT year, param, method, avg(value) AS est, stddev_samp(value) / sqrt(count(*)) AS se FROM dr GROUP BY ALL")


def estimates(spark, d):
    return draws(spark, d).groupBy("year", "param", "method").agg(
        F.avg("value").alias("est"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se")
    )


def wald_sql(scale, e, s, back):
    z = f"1.96e0 * {s}"
    return f"SELECT {YP_SQL}, method, '{scale}' AS scale, {num(back.format(x=e), 'value')}, {num(back.format(x=f'({e} - {z})'), 'lower')}, {num(back.format(x=f'({e} + {z})'), 'upper')} FROM est"


@query("wald_interval", "est", " UNION ALL ".join([
    wald_sql("identity", "est", "se", "{x}"), wald_sql("log", "ln(est)", "(se / est)", "exp({x})"), wald_sql("logit", "(est / 1e2)", "(se / 1e2)", "(1 / (1 + exp(-{x})))")]))
def _(spark, d):
    e = estimates(spark, d)
    out = None
    for scale, est, se in (("identity", F.col("est"), F.col("se")), ("log", F.log("est"), F.col("se") / F.col("est")), ("logit", F.col("est") / 100.0, F.col("se") / 100.0)):
        w = C.wald_interval(e.withColumns({"est": est, "se": se}), scale).select("year", "param", "method", F.lit(scale).alias("scale"), "value", "lower", "upper")
        out = w if out is None else reshape.append(out, w)
    return out


cte("mean_q", "jq", "SELECT t_yr, grp, t_k, avg(lm) AS lm, avg(tau) AS tau, avg(multP) AS mp, avg(v) AS v, avg(psi) AS psi, avg(temp) AS temp, avg(pent) AS delta FROM jq GROUP BY ALL")
cte("mean_v", "psiv", "SELECT t_yr, grp, t_k, avg(psi) AS psi, avg(psi * p) AS temp FROM psiv GROUP BY ALL")
cte("rates_obs", "js", "SELECT t_yr, grp, t_k, marked / nullif(seen, 0) AS v, recap_now / nullif(at_risk, 0) AS tau, recap_later / nullif(marked, 0) AS lm, first_seen / sum(first_seen) OVER (PARTITION BY t_yr, grp) AS mp FROM js")
# quantity -> method -> column of the SQL block, column of the Spark table
METHODS = {
    "v": {"sets": ("v", "v"), "obs": ("v", "obs_v")}, "tau": {"sets": ("tau", "tau"), "obs": ("tau", "obs_tau")},
    "lambda": {"sets": ("lm", "lambda"), "obs": ("lm", "obs_lambda")}, "multP": {"sets": ("mp", "multP"), "obs": ("mp", "obs_multP")},
    "delta": {"sets": ("delta", "delta"), "obs": ("mp", "obs_multP")},
    "psi": {"sets": ("psi", "psi"), "varying": ("psi", "psi")}, "temp": {"sets": ("temp", "temp"), "varying": ("temp", "temp")},
}
METHOD_BLOCKS = {"sets": "mean_q", "obs": "rates_obs", "varying": "mean_v"}


@query("compare_methods", "mean_q mean_v rates_obs", " UNION ALL ".join(
    f"SELECT t_yr::BIGINT AS t_yr, grp, t_k::BIGINT AS t_k, '{m}' AS method, {num(c, 'value')}, '{q}' AS quantity FROM {METHOD_BLOCKS[m]}"
    for q, by in METHODS.items() for m, (c, _) in by.items()))
def _(spark, d):
    """Rates of constant sets against observed ones, and presence under constant against varying rates."""
    varying = V.period_parameters(spark, d, varying=True)
    psi = M.psi_recursion(varying, S).select(*S, "t_k", "psi").join(varying.select(*S, "t_k", "p"), [*S, "t_k"])
    entry = rows(spark, d).groupBy(*G, "t_k").agg(F.avg("pent").alias("delta"))
    tables = {
        "obs": settle(stats.observed_rates(V.event_stats(spark, d))),
        "sets": settle(quantities(spark, d).groupBy(*G, "t_k").agg(*[F.avg(q).alias(q) for q in METHODS if q != "delta"]).join(entry, [*G, "t_k"])),
        "varying": settle(psi.groupBy(*G, "t_k").agg(F.avg("psi").alias("psi"), F.avg(F.col("psi") * F.col("p")).alias("temp"))),
    }
    out = None
    for q, by in METHODS.items():
        one = C.compare_methods({m: tables[m].withColumn("value", F.col(c)) for m, (_, c) in by.items()}, [*G, "t_k"], q)
        out = one if out is None else out.unionByName(one)
    return out


@query("compare_years", "dens dr est", f"""SELECT {YP_SQL}, 'draws' AS method, {num('mode', 'mean', 4)}, {num('lo', 'lower', 4)}, {num('hi', 'upper', 4)} FROM
  (SELECT year, param, arg_max(x, y) AS mode FROM dens GROUP BY ALL) JOIN (SELECT year, param, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM dr GROUP BY ALL) USING (year, param)
UNION ALL SELECT {YP_SQL}, 'estimate', {num('e', 'mean', 4)}, {num('e - 1.96e0 * s', 'lower', 4)}, {num('e + 1.96e0 * s', 'upper', 4)}
FROM (SELECT year, param, avg(value) AS e, stddev_samp(value) / sqrt(count(*)) AS s FROM dr GROUP BY ALL)""", digits=4)
def _(spark, d):
    dr = draws(spark, d)
    est = dr.groupBy(*YP).agg(F.avg("value").alias("est"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))
    return C.compare_years(dr, est, YP)


@query("total_check", "js hist", f"""SELECT t_yr::BIGINT AS t_yr, grp, {big('a', 'from_stats')}, {big('b', 'from_histories')}, {big('a - b', 'difference')}
FROM (SELECT t_yr, grp, sum(first_seen) AS a FROM js GROUP BY ALL) FULL JOIN (SELECT t_yr, grp, sum(n) AS b FROM hist GROUP BY ALL) USING (t_yr, grp)""")
def _(spark, d):
    h = settle(V.event_histories(spark, d))
    return C.total_check(H.js_from_histories(h, V.event_bounds(h), G), h, G)


@query("draw_histogram", "dr", f"""SELECT {YP_SQL}, method, {big('least(floor((value - lo) / (hi - lo) * 30) + 1, 30)', 'bin')}, count(*)::BIGINT AS n
FROM dr JOIN (SELECT year, param, min(value) AS lo, max(value) AS hi FROM dr GROUP BY ALL) USING (year, param) GROUP BY ALL""")
def _(spark, d):
    return C.draw_histogram(draws(spark, d), YP, ["method"])


KEY = "param || ':' || method || ':' || iter"
Z = f"sqrt(-2 * ln(1 - {draw_sql('9r', KEY)})) * cos(2 * pi() * {draw_sql('9a', KEY)})"


@query("normal_draws", "est", f"""SELECT {YP_SQL}, method, iter::BIGINT AS iter, {num(f'est + se * {Z}', 'value')}, {num(f'exp(ln(est) - 5e-1 * pow(se / est, 2) + se / est * {Z})', 'log_value')}
FROM est, (SELECT unnest(range(1, 201)) AS iter)""")
def _(spark, d):
    e = estimates(spark, d)
    a = C.normal_draws(e, 200, 9, ["param", "method"]).select("year", "param", "method", "iter", "value")
    logs = e.withColumns({"se": F.col("se") / F.col("est"), "est": F.log("est")})
    b = C.normal_draws(logs, 200, 9, ["param", "method"], "log").select("year", "param", "method", "iter", F.col("value").alias("log_value"))
    return a.join(b, ["year", "param", "method", "iter"])


@query("observed_vs_predicted_u", "jqs", f"SELECT t_yr::BIGINT AS t_yr, grp, set_id::BIGINT AS set_id, t_k::BIGINT AS t_k, {big('first_seen', 'observed')}, {num('multP * uTot', 'expected')} FROM jqs")
def _(spark, d):
    df = C.observed_vs_predicted_u(V.event_stats(spark, d), quantities(spark, d), G)
    return df.select(*S, "t_k", "observed", "expected")


@query("obs_vs_pred", "hist mean_q", f"""SELECT t_yr::BIGINT AS t_yr, grp, t_k::BIGINT AS t_k, {big('o', 'obs')}, {num('mp', 'pred')}
FROM (SELECT t_yr, grp, t_k, sum(n) AS o FROM hist GROUP BY ALL) FULL JOIN mean_q USING (t_yr, grp, t_k)""")
def _(spark, d):
    obs = V.event_histories(spark, d).groupBy(*G, "t_k").agg(F.sum("n").alias("value"))
    pred = quantities(spark, d).groupBy(*G, "t_k").agg(F.avg("multP").alias("value"))
    return C.obs_vs_pred(obs, pred, [*G, "t_k"])


@query("attach_group_labels", "sheets", f"""SELECT Return_Yr AS year, SPECIES AS fish_type, {big('dense_rank() OVER (ORDER BY Return_Yr, SPECIES) - 1', 'grp')}, Return_Yr || ' ' || SPECIES AS grp_id, count(*)::BIGINT AS n
FROM sheets GROUP BY Return_Yr, SPECIES""")
def _(spark, d):
    df = reshape.group_id(V.cap_sheets(spark, d), ["Return_Yr", "SPECIES"])
    counts = settle(df.groupBy("grp", "Return_Yr", "SPECIES").agg(F.count(F.lit(1)).alias("n")))
    labels = counts.select("grp", F.concat_ws(" ", "Return_Yr", "SPECIES").alias("grp_id"))
    return C.attach_group_labels(counts.select("grp", "n"), labels)


@query("series_table", "jqs", f"SELECT t_yr::BIGINT AS t_yr, grp, set_id::BIGINT AS set_id, t_k::BIGINT AS t_k, {num('lm', '\"lambda\"')}, {big('first_seen', 'detections')}, {num('psi', 'psi')}, {num('temp', 'temp')}, {num('tau', 'tau')} FROM jqs")
def _(spark, d):
    df = C.series_table(quantities(spark, d), V.event_stats(spark, d), G)
    return df.select(*S, "t_k", "lambda", "detections", "psi", "temp", "tau")


@query("split_param", "mean_q", f"SELECT 'lambda[' || t_k || ']' AS param, grp, 'lambda' AS name, t_k::BIGINT AS idx, {num('lm', 'mean')} FROM mean_q UNION ALL SELECT 'phi', grp, 'phi', NULL, {num('avg(lm)', 'mean')} FROM mean_q GROUP BY grp")
def _(spark, d):
    q = settle(quantities(spark, d).groupBy("grp", "t_k").agg(F.avg("lambda").alias("mean")))
    one = q.groupBy("grp").agg(F.avg("mean").alias("mean")).withColumn("param", F.lit("phi"))
    long = q.withColumn("param", F.concat(F.lit("lambda["), F.col("t_k"), F.lit("]"))).drop("t_k")
    return split_param(reshape.append(long, one))
