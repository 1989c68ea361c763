"""Posterior draws, intervals, comparisons and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from resight.functions.draws import standard_normal
from resight.functions.mathx import expit
from resight.operators.joins import match
from resight.operators.reshape import append
from resight.session import settle, settle_lookup

Z95 = 1.96
# Parts that a bracket of an order statistic is cut into.
BINS = 64


def _narrowed(rows: DataFrame, brackets: DataFrame, keys) -> DataFrame:
    """Brackets cut down to the parts in which their ranks lie."""
    seen = match(rows, brackets, keys).select(*keys, "x", F.explode(F.filter("asked", lambda a: F.col("x") <= a["hi"])).alias("a"))
    width = F.col("a.hi") - F.col("a.lo")
    part = F.when(F.col("x") < F.col("a.lo"), -1).when(width > 0, F.floor((F.col("x") - F.col("a.lo")) / width * BINS)).otherwise(0)
    one = [*keys, "q", "h"]
    bins = seen.groupBy(*keys, F.col("a.q").alias("q"), F.col("a.h").alias("h"), part.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # a few dozen rows for each quantile
    bins = bins.withColumn("upto", F.sum("c").over(W.partitionBy(*one).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
    first = lambda c, rank: F.min(F.when(F.col("upto") > rank, F.col(c)))
    cut = bins.groupBy(*one).agg(first("lo", F.floor("h")).alias("lo"), first("hi", F.ceil("h")).alias("hi"))
    asked = cut.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("q", "h", "lo", "hi"))).alias("asked"))
    return match(brackets.drop("asked"), asked, keys)


def exact_quantiles(df: DataFrame, keys, value: str, probs, accuracy: int = 20_000, limit: int = 512) -> DataFrame:
    """Exact interpolated quantiles per key without gathering a key's values.

    One pass builds a mergeable sketch per key, which brackets the order statistics of each
    quantile: about 4 n / accuracy of its n values lie inside. While that is more than ``limit``, a pass counts the values of each bracket in
    ``BINS`` equal parts (in part before the shuffle) and keeps the parts that hold the wanted ranks. A last pass counts all values below a bracket as one and those inside it by
    value; only these are put in order. A bracket that misses a rank, which the error
    bound of the sketch rules out, would be replaced by the key's whole range.
    """
    keys, slack = list(keys), 2.0 / accuracy
    edges = [e for q in probs for e in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.percentile_approx(value, edges, accuracy).alias("e"), F.min(value).alias("lo0"), F.max(value).alias("hi0")
    )
    asked = F.array(*[
        F.struct(
            F.lit(float(q)).alias("q"),
            (F.lit(float(q)) * (F.col("n") - 1)).alias("h"),
            (F.col("lo0") if q <= slack else F.col("e")[2 * i]).alias("lo"),
            (F.col("hi0") if q >= 1 - slack else F.col("e")[2 * i + 1]).alias("hi"),
        )
        for i, q in enumerate(probs)
    ])
    sketch = settle(sketch.select(*keys, "n", "lo0", "hi0", asked.alias("asked")))
    most = sketch.agg(F.max("n")).first()[0] or 0
    brackets = settle_lookup(sketch.drop("n"))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"))
    inside = 4 * most / accuracy
    while inside > limit:
        brackets = settle_lookup(_narrowed(rows, brackets, keys))
        inside /= BINS / 2

    def order_stats(brackets):
        """(keys, q, h, value at rank floor(h), value at rank ceil(h))."""
        seen = match(rows, brackets, keys).select(*keys, "x", F.explode(F.filter("asked", lambda a: F.col("x") <= a["hi"])).alias("a"))
        # every value below the bracket counts under a null, which sorts first
        inside = F.when(F.col("x") >= F.col("a.lo"), F.col("x"))
        counts = seen.groupBy(*keys, F.col("a.q").alias("q"), F.col("a.h").alias("h"), inside.alias("v")).agg(F.count(F.lit(1)).alias("c"))
        upto = W.partitionBy(*keys, "q", "h").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
        ranked = counts.withColumn("last", F.sum("c").over(upto) - 1).withColumn("first", F.col("last") - F.col("c") + 1)

        def at(rank):
            return F.min(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))

        return ranked.groupBy(*keys, "q", "h").agg(at(F.floor("h")).alias("x0"), at(F.ceil("h")).alias("x1"))

    got = settle(order_stats(brackets))
    lost = got.where(F.col("x0").isNull() | F.col("x1").isNull()).select(*keys).distinct()
    if not lost.isEmpty():
        whole = F.transform("asked", lambda a: a.withField("lo", F.col("lo0")).withField("hi", F.col("hi0")))
        again = order_stats(match(brackets, lost, keys, "left_semi").withColumn("asked", whole))
        got = match(got, lost, keys, "left_anti").unionByName(again)
    v = F.col("x0") + (F.col("h") - F.floor("h")) * (F.col("x1") - F.col("x0"))
    names = {q: f"q{q * 100:g}".replace(".", "_") for q in probs}
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == float(q), v)).alias(n) for q, n in names.items()])


def chain_diagnostics(draws: DataFrame, keys, chain: str = "chain", value: str = "value") -> DataFrame:
    """mean, sd, Rhat and effective size from per-chain means and variances."""
    per = draws.groupBy(*keys, chain).agg(
        F.count(value).alias("c_n"), F.avg(value).alias("c_mean"), F.var_samp(value).alias("c_var"), F.sum(value).alias("c_sum"),
        F.var_pop(value).alias("c_pop"),
    )
    g = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"), F.avg("c_n").alias("n"), F.var_samp("c_mean").alias("between"), F.avg("c_var").alias("within"),
        F.sum("c_n").alias("total"), F.sum("c_sum").alias("s1"),
        F.sum(F.col("c_n") * F.col("c_pop")).alias("ss_in"), F.sum(F.col("c_n") * F.col("c_mean") * F.col("c_mean")).alias("ss_mean"),
    )
    mean = F.try_divide("s1", "total")
    sd = F.sqrt(F.greatest(F.try_divide(F.col("ss_in") + F.col("ss_mean") - F.col("total") * mean * mean, F.col("total") - 1), F.lit(0.0)))
    plus = F.try_divide(F.col("n") - 1, F.col("n")) * F.col("within") + F.col("between")
    rhat = F.when(F.col("within") > 0, F.sqrt(plus / F.col("within"))).otherwise(1.0)
    # one chain says nothing of how chains differ; chains which agree exactly are as good as independent draws
    neff = F.when(F.col("m") < 2, F.lit(None)).when(F.col("between") > 0, F.least(F.col("total"), F.col("m") * plus / F.col("between")))
    neff = neff.otherwise(F.when(F.col("within") > 0, F.col("total")).otherwise(1.0))
    return g.select(*keys, mean.alias("mean"), sd.alias("sd"), rhat.alias("rhat"), neff.alias("n_eff"))


def summarize_draws(draws: DataFrame, keys, probs=(0.025, 0.25, 0.5, 0.75, 0.975)) -> DataFrame:
    """mean, sd, quantiles, Rhat and effective size per parameter."""
    return match(chain_diagnostics(draws, keys), exact_quantiles(draws, keys, "value", probs), keys)


def sort_summary(df: DataFrame, keys) -> DataFrame:
    return df.orderBy(*keys)


def draw_means(draws: DataFrame, keys) -> DataFrame:
    return draws.groupBy(*keys).agg(F.avg("value").alias("mean"))


def draw_interval(draws: DataFrame, keys, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    q = exact_quantiles(draws, keys, "value", (lo, hi))
    return q.toDF(*keys, "lower", "upper")


def draw_density(draws: DataFrame, keys, points: int = 512) -> DataFrame:
    """Gaussian kernel density on an even grid three bandwidths beyond the draws.

    The draws are binned linearly onto the grid first (one partial aggregation), so the
    kernel sum costs points squared per key and does not depend on the number of draws.
    """
    keys = list(keys)
    q = exact_quantiles(draws, keys, "value", (0.25, 0.75)).toDF(*keys, "q1", "q3")
    m = draws.groupBy(*keys).agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    sd = F.coalesce("sd", F.lit(0.0))
    # without spread the bandwidth follows the size of the value itself
    flat = F.when(F.col("lo") != 0, F.abs("lo")).otherwise(1.0)
    spread = F.when((iqr > 0) & (sd > 0), F.least(sd, iqr)).when(sd > 0, sd).otherwise(flat)
    info = match(m, q, keys).withColumn("bw", 0.9 * spread * F.pow("n", F.lit(-0.2)))
    info = info.select(*keys, "n", "bw", (F.col("lo") - 3 * F.col("bw")).alias("x0"), ((F.col("hi") - F.col("lo") + 6 * F.col("bw")) / (points - 1)).alias("step"))
    info = settle_lookup(info)
    pos = (F.col("value") - F.col("x0")) / F.col("step")
    left = F.floor(pos).cast("int")
    part = pos - F.floor(pos)
    both = F.array(F.struct(left.alias("bin"), (1 - part).alias("w")), F.struct((left + 1).alias("bin"), part.alias("w")))
    binned = match(draws, info, keys).select(*keys, F.explode(both).alias("b")).groupBy(*keys, F.col("b.bin").alias("bin")).agg(F.sum("b.w").alias("w"))
    packed = binned.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("bins"))
    packed = match(packed, info, keys)
    reach = F.col("step") / F.col("bw")

    def at(g):
        return F.aggregate("bins", F.lit(0.0), lambda acc, b: acc + b["w"] * F.exp(-0.5 * F.pow((g - b["bin"]) * reach, F.lit(2.0))))

    dens = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda g: F.struct((F.col("x0") + g * F.col("step")).alias("x"), at(g).alias("y")))
    scale = F.col("n") * F.col("bw") * 2.5066282746310002
    return packed.select(*keys, F.explode(dens).alias("d"), scale.alias("_c")).select(*keys, "d.x", (F.col("d.y") / F.col("_c")).alias("y"))


def draw_mode(draws: DataFrame, keys, points: int = 512) -> DataFrame:
    dens = draw_density(draws, keys, points)
    return dens.groupBy(*keys).agg(F.max_by("x", F.struct("y", (-F.col("x")).alias("_x"))).alias("mode"))


def wald_interval(df: DataFrame, scale: str = "identity", est: str = "est", se: str = "se") -> DataFrame:
    """est +- 1.96 se, on the scale of est and mapped back by exp or expit."""
    back = {"identity": lambda x: x, "log": F.exp, "logit": expit}[scale]
    e, d = F.col(est), Z95 * F.col(se)
    return df.withColumns({"value": back(e), "lower": back(e - d), "upper": back(e + d)})


def compare_methods(tables: dict, index, quantity: str) -> DataFrame:
    """Long (index, quantity, method, value) of one quantity under several methods.

    ``tables`` maps a method to a table with the index and a column ``value``.
    """
    index, out = list(index), None
    for method, df in tables.items():
        part = df.select(*index, F.col("value").alias(method))
        out = part if out is None else match(out, part, index, "full")
    return out.unpivot(index, list(tables), "method", "value").withColumn("quantity", F.lit(quantity))


def compare_years(draws: DataFrame, estimates: DataFrame, keys, draw_method: str = "draws", est_method: str = "estimate") -> DataFrame:
    """One row per key and method: draws by mode and quantiles, estimates by their Wald interval."""
    keys = list(keys)
    a = match(draw_mode(draws, keys).withColumnRenamed("mode", "mean"), draw_interval(draws, keys), keys).withColumn("method", F.lit(draw_method))
    b = wald_interval(estimates).select(*keys, F.col("value").alias("mean"), "lower", "upper").withColumn("method", F.lit(est_method))
    return append(a, b).select(*keys, "method", "mean", "lower", "upper")


def total_check(stats: DataFrame, hist: DataFrame, keys) -> DataFrame:
    """Totals per key from the statistics and from the histories."""
    a = stats.groupBy(*keys).agg(F.sum("first_seen").alias("from_stats"))
    b = hist.groupBy(*keys).agg(F.sum("n").alias("from_histories"))
    return match(a, b, keys, "full").withColumn("difference", F.col("from_stats") - F.col("from_histories"))


def draw_histogram(draws: DataFrame, keys, by=(), bins: int = 30) -> DataFrame:
    """Counts per bin over the parameter's range, split by ``by`` (for instance the method)."""
    keys = list(keys)
    span = settle_lookup(draws.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    width = F.col("hi") - F.col("lo")
    b = F.when(width <= 0, 1).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / width * bins) + 1, F.lit(bins)))
    return match(draws, span, keys).groupBy(*keys, *by, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def normal_draws(estimates: DataFrame, n: int, seed, keys, scale: str = "identity") -> DataFrame:
    """n draws per estimate; on the log scale centred by -se^2/2 and exponentiated."""
    rows = estimates.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(n))))
    z = standard_normal(seed, *keys, "iter")
    if scale == "log":
        v = F.exp(F.col("est") - 0.5 * F.col("se") * F.col("se") + F.col("se") * z)
    else:
        v = F.col("est") + F.col("se") * z
    return rows.withColumn("value", v)


def observed_vs_predicted_u(stats: DataFrame, quantities: DataFrame, group) -> DataFrame:
    """First detections and their expectation, the share times the total."""
    group = list(group)
    total = F.sum("first_seen").over(W.partitionBy(*group))
    u = stats.select(*group, "t_k", F.col("first_seen").alias("observed"), total.alias("_total"))
    return match(u, quantities, [*group, "t_k"]).withColumn("expected", F.col("multP") * F.col("_total")).drop("_total")


def obs_vs_pred(obs: DataFrame, pred: DataFrame, dims) -> DataFrame:
    """Observed and predicted cells aligned by their dimensions; either may be missing."""
    return match(obs.select(*dims, F.col("value").alias("obs")), pred.select(*dims, F.col("value").alias("pred")), dims, "full")


def attach_group_labels(pred: DataFrame, labels: DataFrame, key: str = "grp") -> DataFrame:
    """Group names of predictions; year and type are parts of the name."""
    return pred.join(labels, key, "left").withColumns(
        {"year": F.substring("grp_id", 1, 4), "fish_type": F.expr("substring(grp_id, 6)")}
    )


def series_table(quantities: DataFrame, stats: DataFrame, group) -> DataFrame:
    """lambda with detections, psi, temp and tau per period."""
    u = stats.select(*group, "t_k", F.col("first_seen").alias("detections"))
    return match(quantities, u, [*group, "t_k"], "left")
