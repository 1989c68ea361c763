"""Model quantities as table operators.

A parameter table has one row per set; a period table has one row per set and period.
A set has at most a few dozen periods, so recursions over periods run on an ordered
array of one set inside the JVM, and sets are the unit of parallelism. A period table may
come packed, one row per set with its periods as an array of structs ``path`` (t_k, ...); it
is then not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from resight.functions.mathx import as_col, bound, expit
from resight.operators.joins import match


def entry_factor(phi) -> Column:
    """Mean survival of entrants from their entry to the end of the interval."""
    phi = as_col(phi)
    return F.when(phi >= 1, 1.0).when(phi <= 0, 0.0).otherwise((phi - 1) / F.log(phi))


def lambda_const(phi, p, steps) -> Column:
    """Probability of ever being recaptured within ``steps`` further periods, constant rates."""
    phi, p, steps = as_col(phi), as_col(p), as_col(steps)
    q = phi * (1 - p)
    return F.when(q >= 1, 0.0).otherwise(phi * p * (1 - F.pow(q, steps)) / (1 - q))


def tau_of(p, lam) -> Column:
    """Share of those recaptured from now on who are recaptured now."""
    p, lam = as_col(p), as_col(lam)
    return F.try_divide(p, p + (1 - p) * lam)


def with_periods(params: DataFrame, s: str = "s", name: str = "t_k") -> DataFrame:
    """One row per set and period 1..s."""
    return params.withColumn(name, F.explode(F.when(F.col(s) >= 1, F.sequence(F.lit(1), F.col(s)))))


def free_period(t, s, rate: int) -> Column:
    """The period whose free value stands for period t: of p (``rate`` 0) an inner one, of phi (1) one before the last."""
    return F.greatest(F.lit(1), F.least(F.greatest(t, F.lit(2)) if rate == 0 else t, s - 1)).cast("int")


def expand_params(params: DataFrame, form: str = "sst") -> DataFrame:
    """Per-period p and phi from static values or period arrays.

    ``form`` has one letter each for p, phi and entry: s static, t by period. A varying
    p is free in the inner periods only: the first and last period copy their neighbour.
    """
    rows = with_periods(params)
    if form[0] == "t":
        rows = rows.withColumn("p", F.try_element_at("p", free_period(F.col("t_k"), F.col("s"), 0)))
    if form[1] == "t":
        rows = rows.withColumn("phi", F.try_element_at("phi", free_period(F.col("t_k"), F.col("s"), 1)))
    return rows


def _ordered(df: DataFrame, keys, cols, keep=()) -> DataFrame:
    """One row per set with its periods in order as an array of structs."""
    if "path" in df.columns:
        periods = F.transform("path", lambda x: F.struct(x["t_k"].alias("t_k"), *[x[c].cast("double").alias(c) for c in cols]))
        return df.select(*keys, F.array_sort(periods).alias("path"), *keep)
    periods = F.array_sort(F.collect_list(F.struct("t_k", *[F.col(c).cast("double").alias(c) for c in cols])))
    return df.groupBy(*keys).agg(periods.alias("path"), *[F.first(c).alias(c) for c in keep])


def _lambda_path() -> Column:
    """Backward recursion; the last period has nothing left to be recaptured in."""
    zero = F.struct(F.lit(None).cast("double").alias("lam"), F.lit(0.0).alias("p"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        lam = F.when(acc["lam"].isNull(), 0.0).otherwise(x["phi"] * (acc["p"] + (1 - acc["p"]) * acc["lam"]))
        return F.struct(lam.alias("lam"), x["p"].alias("p"), F.concat(F.array(lam), acc["out"]).alias("out"))

    return F.aggregate(F.reverse("path"), zero, step, lambda acc: acc["out"])


def _psi_path(first_entry: str) -> Column:
    """Forward recursion: survivors not yet detected plus the period's entrants.

    ``first_entry="twice"`` adds the first period's entrants a second time, as a
    mid-interval cohort.
    """
    zero = F.struct(
        F.lit(None).cast("double").alias("psi"), F.lit(0.0).alias("p"), F.lit(0.0).alias("phi"), F.array().cast("array<double>").alias("out")
    )

    def step(acc, x):
        start = x["pent"] * (1 + entry_factor(x["phi"])) if first_entry == "twice" else x["pent"]
        go_on = acc["psi"] * (1 - acc["p"]) * acc["phi"] + x["pent"] * entry_factor(acc["phi"])
        psi = F.when(acc["psi"].isNull(), start).otherwise(go_on)
        return F.struct(psi.alias("psi"), x["p"].alias("p"), x["phi"].alias("phi"), F.concat(acc["out"], F.array(psi)).alias("out"))

    return F.aggregate("path", zero, step, lambda acc: acc["out"])


def lambda_varying(df: DataFrame, keys) -> DataFrame:
    """Period table with p and phi -> (keys, t_k, lambda)."""
    lam = _ordered(df, keys, ["p", "phi"]).select(*keys, F.arrays_zip("path", _lambda_path().alias("lam")).alias("z"))
    return lam.select(*keys, F.explode("z").alias("z")).select(*keys, F.col("z.path.t_k").alias("t_k"), F.col("z.lam").alias("lambda"))


def psi_recursion(df: DataFrame, keys, first_entry: str = "once") -> DataFrame:
    """Period table with p, phi and pent -> (keys, t_k, psi)."""
    psi = _ordered(df, keys, ["p", "phi", "pent"]).select(*keys, F.arrays_zip("path", _psi_path(first_entry).alias("psi")).alias("z"))
    return psi.select(*keys, F.explode("z").alias("z")).select(*keys, F.col("z.path.t_k").alias("t_k"), "z.psi")


def js_quantities(df: DataFrame, keys, keep=(), first_entry: str = "once") -> DataFrame:
    """All period quantities of every set in one pass.

    Returns keys, kept columns, t_k, s, p, phi, pent, lambda, psi, temp, tau, multP, psiPtot.
    One shuffle by set; the totals are taken from the set's own array.
    """
    arr = _ordered(df, keys, ["p", "phi", "pent"], keep).withColumns({"lam": _lambda_path(), "psi": _psi_path(first_entry)})
    arr = arr.withColumn("temp", F.zip_with("psi", "path", lambda a, x: a * x["p"]))
    arr = arr.withColumn("psiPtot", F.aggregate("temp", F.lit(0.0), lambda a, x: a + x))
    z = arr.select(*keys, *keep, "psiPtot", F.size("path").alias("s"), F.explode(F.arrays_zip("path", "lam", "psi", "temp")).alias("z"))
    return z.select(
        *keys, *keep, "s", "psiPtot", F.col("z.path.t_k").alias("t_k"), "z.path.p", "z.path.phi", "z.path.pent",
        F.col("z.lam").alias("lambda"), "z.psi", "z.temp",
        tau_of(F.col("z.path.p"), F.col("z.lam")).alias("tau"),
        F.try_divide(F.col("z.temp"), F.col("psiPtot")).alias("multP"),
    )


def detection_share(df: DataFrame, keys) -> DataFrame:
    """temp = psi p, its total, and each period's share of first detections."""
    out = df.withColumn("temp", F.col("psi") * F.col("p"))
    total = F.sum("temp").over(W.partitionBy(*keys))
    return out.withColumns({"psiPtot": total, "multP": F.try_divide(F.col("temp"), total)})


def expected_counts(df: DataFrame) -> DataFrame:
    """Expected recaptures (est_rl), marks (est_mk), first detections and their total."""
    return df.withColumns(
        {
            "est_rl": F.col("lambda") * F.col("marked"),
            "est_mk": F.col("v") * F.col("seen"),
            "est_u": F.col("multP") * F.col("uTot"),
            "est_uTot": F.col("psiPtot") * F.col("nsuper"),
        }
    )


def entry_additive_ratio(df: DataFrame, keys, alternative: bool = False) -> DataFrame:
    """Entry shares and survival from log ratios per day and the days between surveys.

    The first period is the base of the ratios: its score is 1 and period i has
    exp(log_delta of i-1) times the days since i-1. ``alternative=True`` has no base
    and normalises exp(log_delta) times days of every period. Of a packed table the keys, t_k, pent and phi come back.
    """
    if "path" in df.columns:
        return _entry_path(_ordered(df, keys, ["log_delta", "days", "logit_phi"]), keys, alternative)
    order = W.partitionBy(*keys).orderBy("t_k")
    if alternative:
        score, gap = F.exp("log_delta") * F.col("days"), F.col("days")
    else:
        score = F.when(F.row_number().over(order) == 1, 1.0).otherwise(F.exp(F.lag("log_delta").over(order)) * F.col("days"))
        gap = F.lead("days").over(order)
    out = df.withColumns({"_score": score, "_gap": gap})
    return out.withColumns(
        {"pent": F.col("_score") / F.sum("_score").over(W.partitionBy(*keys)), "phi": F.pow(expit("logit_phi"), F.col("_gap"))}
    ).drop("_score", "_gap")


def _total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def _entry_path(arr: DataFrame, keys, alternative: bool) -> DataFrame:
    """``entry_additive_ratio`` on the array of every set."""

    def one(path, x, i):
        if alternative:
            score, gap = F.exp(x["log_delta"]) * x["days"], x["days"]
        else:
            score, gap = F.when(i == 0, 1.0).otherwise(F.exp(F.get(path, i - 1)["log_delta"]) * x["days"]), F.get(path, i + 1)["days"]
        return F.struct(x["t_k"].alias("t_k"), score.alias("score"), F.pow(expit(x["logit_phi"]), gap).alias("phi"))

    z = arr.select(*keys, bound(F.col("path"), lambda path: F.transform(path, lambda x, i: one(path, x, i))).alias("o"))
    z = z.withColumn("total", _total(F.transform("o", lambda x: x["score"]))).select(*keys, "total", F.explode("o").alias("z"))
    return z.select(*keys, "z.t_k", F.try_divide(F.col("z.score"), F.col("total")).alias("pent"), "z.phi")


def three_state_forward(phi, p, steps) -> Column:
    """(alive, detected, dead) after ``steps`` periods from alive; detection absorbs."""
    phi, p, steps = as_col(phi), as_col(p), as_col(steps)
    alive, found = F.pow(phi * (1 - p), steps), lambda_const(phi, p, steps)
    return F.struct(alive.alias("alive"), found.alias("detected"), (1 - alive - found).alias("dead"))


def multi_location_forward(quantities: DataFrame, shares: DataFrame, keys) -> DataFrame:
    """Available and detected by location when nobody moves: each location's entry share
    of the common path."""
    out = match(quantities, shares, keys)
    return out.withColumns({"psi_l": F.col("psi") * F.col("sp_pr"), "temp_l": F.col("temp") * F.col("sp_pr")})


def births(df: DataFrame, share: str | None = None) -> DataFrame:
    """B = exp(dev + mu), and B by location where a share is given."""
    out = df.withColumn("B", F.exp(F.col("dev") + F.col("mu")))
    return out if share is None else out.withColumn("B_ts", F.col("B") * F.col(share))


def births_total(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("B").alias("B_total"))


def abundance_path(df: DataFrame, keys, half_step: bool = False) -> DataFrame:
    """N_t = B_t + phi N_{t-1}; with ``half_step`` entrants survive half an interval first."""
    zero = F.struct(F.lit(0.0).alias("n"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        n = x["B"] * (F.sqrt(x["phi"]) if half_step else F.lit(1.0)) + acc["n"] * x["phi"]
        return F.struct(n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    path = F.aggregate("path", zero, step, lambda acc: acc["out"])
    z = _ordered(df, keys, ["B", "phi"]).select(*keys, F.explode(F.arrays_zip("path", path.alias("N"))).alias("z"))
    return z.select(*keys, F.col("z.path.t_k").alias("t_k"), F.col("z.path.B").alias("B"), "z.N")


def expected_detected(df: DataFrame) -> DataFrame:
    """Expected detected and tagged individuals."""
    e = F.col("N") * F.col("p")
    return df.withColumns({"e_total": e, "e_tagged": e * F.col("tag_rate")})


def expected_recaptures(tagged: DataFrame) -> DataFrame:
    """Expected recaptures (t_k, r_k) in every later period up to s from those tagged and available at t."""
    later = F.when(F.col("t_k") < F.col("s"), F.sequence(F.col("t_k") + 1, F.col("s")))
    cells = tagged.withColumn("r_k", F.explode(later))
    return cells.withColumn("e_r", F.col("available") * F.pow("phi", F.col("r_k") - F.col("t_k")) * F.col("p"))


def expected_recapture_totals(tagged: DataFrame, keys) -> DataFrame:
    """(keys, r_k, e_r): the same summed over t, by a forward recursion over the set's periods.

    Those tagged before r and still there are phi times those of the period before and its own.
    """
    zero = F.struct(F.lit(0.0).alias("x"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        return F.struct(((acc["x"] + x["available"]) * x["phi"]).alias("x"), F.concat(acc["out"], F.array(acc["x"] * x["p"])).alias("out"))

    path = F.aggregate("path", zero, step, lambda acc: acc["out"])
    z = _ordered(tagged, keys, ["available", "phi", "p"]).select(*keys, F.explode(F.arrays_zip("path", path.alias("e_r"))).alias("z"))
    return z.where("z.path.t_k > 1").select(*keys, F.col("z.path.t_k").alias("r_k"), "z.e_r")


def period_estimates(stats: DataFrame, keys, form: str = "ttt") -> DataFrame:
    """Closed-form estimates by period from the per-period statistics, p and phi free or pooled.

    Marked and available M = m + z R / r, z being those at risk and not seen now; p = m / M and
    phi = M' / (M - m + R) with M' that of the next period; N = n / p and entries
    B' = N' - phi (N - n + R). ``form`` has one letter for p, phi and entry: s pools a rate over its periods (sum over
    sum), t leaves it free; entries are always free. End rules: p of the first and last period is its
    neighbour's, which gives M of the last period as m / p; B of the first period is N.
    Returns keys, t_k, M, p, phi, N, B, gross (entrants with those who did not live to the survey) and the standard
    errors of free p, phi and N in inner periods. What its period can't give (no recaptures, say) is null.
    """
    cols = ["seen", "marked", "recap_later", "recap_now", "at_risk"]
    arr = _ordered(stats, keys, cols).withColumn("s", F.size("path"))
    x_of = lambda c: (lambda x: x[c])
    n, R, r, m, T = (F.transform("path", x_of(c)) for c in cols)
    arr = arr.withColumns({"_seen": n, "_mark": R, "_later": r, "_now": m, "_z": F.zip_with(T, m, lambda a, b: a - b)})
    steps = F.sequence(F.lit(1), F.col("s"))
    at = lambda c, i: F.try_element_at(c, i.cast("int"))
    inner = lambda i: (i > 1) & (i < F.col("s"))

    def marked(i):
        known = F.when(at("_z", i) == 0, at("_now", i)).otherwise(at("_now", i) + F.try_divide(at("_z", i) * at("_mark", i), at("_later", i)))
        return F.when(i == 1, 0.0).when(inner(i), known)

    arr = arr.withColumn("M", F.transform(steps, marked))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    free = F.transform(steps, lambda i: F.when(inner(i), F.try_divide(at("_now", i), at("M", i))))
    if form[0] == "s":
        seen = F.transform(steps, lambda i: F.when(inner(i) & at("M", i).isNotNull(), at("_now", i)))
        pooled = F.try_divide(total(seen), total(F.col("M")))
        arr = arr.withColumn("p", F.transform(steps, lambda i: pooled))
    else:
        arr = arr.withColumn("p", free)
        arr = arr.withColumn("p", F.transform(steps, lambda i: F.when(i == 1, at("p", F.lit(2))).when(i == F.col("s"), at("p", F.col("s") - 1)).otherwise(at("p", i))))
    arr = arr.withColumn("M", F.transform(steps, lambda i: F.when((i == F.col("s")) & (i > 1), F.try_divide(at("_now", i), at("p", i))).otherwise(at("M", i))))
    left = lambda i: at("M", i) - at("_now", i) + at("_mark", i)
    if form[1] == "s":
        pair = F.transform(steps, lambda i: F.when((i < F.col("s") - 1) & at("M", i + 1).isNotNull() & left(i).isNotNull(), F.struct(at("M", i + 1).alias("a"), left(i).alias("b"))))
        pooled = F.try_divide(total(F.transform(pair, x_of("a"))), total(F.transform(pair, x_of("b"))))
        arr = arr.withColumn("phi", F.transform(steps, lambda i: F.when(i < F.col("s"), pooled)))
    else:
        arr = arr.withColumn("phi", F.transform(steps, lambda i: F.when(i < F.col("s"), F.try_divide(at("M", i + 1), left(i)))))
    arr = arr.withColumn("N", F.transform(steps, lambda i: F.try_divide(at("_seen", i), at("p", i))))
    born = lambda i: F.when(i == 1, at("N", i)).otherwise(at("N", i) - at("phi", F.greatest(i - 1, F.lit(1))) * (at("N", F.greatest(i - 1, F.lit(1))) - at("_seen", F.greatest(i - 1, F.lit(1))) + at("_mark", F.greatest(i - 1, F.lit(1)))))
    arr = arr.withColumn("B", F.transform(steps, born))
    gross = lambda i: F.when(i == 1, at("B", i)).otherwise(F.try_divide(at("B", i), entry_factor(at("phi", F.greatest(i - 1, F.lit(1))))))
    one = F.lit(1.0)
    odd = lambda i: F.try_divide(one, at("_later", i)) - F.try_divide(one, at("_mark", i))
    N, M, phi, p = (lambda i, c=c: at(c, i) for c in ("N", "M", "phi", "p"))
    var_n = lambda i: N(i) * (N(i) - at("_seen", i)) * (F.try_divide(left(i), M(i)) * odd(i) + F.try_divide(1 - F.try_divide(M(i), N(i)), at("_now", i)))
    var_p = lambda i: F.pow(p(i) * (1 - p(i)), F.lit(2.0)) * (odd(i) + F.try_divide(one, at("_now", i)) + F.try_divide(one, at("_z", i)))
    then = lambda i: F.try_divide((M(i + 1) - at("_now", i + 1)) * left(i + 1), M(i + 1) * M(i + 1)) * odd(i + 1)
    var_phi = lambda i: phi(i) * phi(i) * (then(i) + F.try_divide(M(i) - at("_now", i), left(i)) * odd(i) + F.try_divide(1 - phi(i), M(i + 1)))
    error = lambda v: F.when(v >= 0, F.sqrt(v))
    se_p = F.transform(steps, lambda i: F.when(inner(i), error(var_p(i)))) if form[0] == "t" else F.transform(steps, lambda i: F.lit(None).cast("double"))
    se_n = F.transform(steps, lambda i: F.when(inner(i), error(var_n(i)))) if form[0] == "t" else F.transform(steps, lambda i: F.lit(None).cast("double"))
    se_phi = F.transform(steps, lambda i: F.when(i < F.col("s") - 1, error(var_phi(i)))) if form[1] == "t" else F.transform(steps, lambda i: F.lit(None).cast("double"))
    arr = arr.withColumns({"gross": F.transform(steps, gross), "se_p": se_p, "se_phi": se_phi, "se_N": se_n})
    out = ("M", "p", "phi", "N", "B", "gross", "se_p", "se_phi", "se_N")
    z = arr.select(*keys, F.explode(F.arrays_zip("path", *out)).alias("z"))
    return z.select(*keys, F.col("z.path.t_k").alias("t_k"), *[F.col(f"z.{c}").alias(c) for c in out])


def residence_abundance(df: DataFrame, keys) -> DataFrame:
    """Area under the curve of counts and of carcasses, residence time and escapement.

    Rows hold entrants, seen, marked, phi and the time steps of one set's periods; the
    abundance before a survey is carried by a recursion over the set's array.
    """
    cols = ["entrants", "seen", "marked", "phi", "time_auc"]
    zero = F.struct(
        F.lit(None).cast("double").alias("after"), F.lit(0.0).alias("phi"),
        F.lit(0.0).alias("counts"), F.lit(0.0).alias("carcasses"), F.lit(0.0).alias("last_time"),
    )

    def step(acc, x):
        first = acc["after"].isNull()
        phi = acc["phi"]
        born = F.when(first, x["entrants"]).otherwise(x["entrants"] * entry_factor(phi))
        before = F.when(first, born).otherwise(acc["after"] * phi + born)
        t = x["time_auc"]
        counts = F.when(first, 0.5 * t * before).otherwise(0.5 * t * (acc["after"] + before))
        dwell = F.when(phi >= 1, 0.5).when(phi <= 0, 0.0).otherwise(phi / (phi - 1) - 1 / F.log(phi))
        carcasses = F.when(first, 0.5 * t * born).otherwise(0.5 * t * acc["after"] * (phi + 1) + t * born * dwell)
        return F.struct(
            (before - x["seen"] + x["marked"]).alias("after"), x["phi"].alias("phi"),
            (acc["counts"] + counts).alias("counts"), (acc["carcasses"] + carcasses).alias("carcasses"), t.alias("last_time"),
        )

    end = F.aggregate("path", zero, step)
    total = F.aggregate("path", F.lit(0.0), lambda a, x: a + x["entrants"])
    out = _ordered(df, keys, cols).select(*keys, end.alias("e"), total.alias("nsuper"))
    tail = 0.5 * F.col("e.last_time") * F.col("e.after")
    out = out.select(*keys, "nsuper", (F.col("e.counts") + tail).alias("auc_counts"), (F.col("e.carcasses") + tail).alias("auc_carcasses"))
    out = out.withColumn("residence", F.try_divide("auc_carcasses", "nsuper"))
    return out.withColumn("escapement", F.bround(F.try_divide("auc_counts", "residence"), 0))


def cov_to_corr(cov: DataFrame, keys=()) -> DataFrame:
    """Long covariance (keys, k, j, value) -> sigma of k and correlation of k and j."""
    diag = cov.where(F.col("k") == F.col("j")).select(*keys, F.col("k").alias("_k"), F.sqrt("value").alias("_sd"))
    left = diag.withColumnsRenamed({"_k": "k", "_sd": "sigma"})
    right = diag.withColumnsRenamed({"_k": "j", "_sd": "sigma_j"})
    out = match(match(cov, left, [*keys, "k"]), right, [*keys, "j"])
    return out.withColumn("rho", F.try_divide(F.col("value"), F.col("sigma") * F.col("sigma_j"))).select(*keys, "k", "j", "sigma", "rho")


def age_shares(df: DataFrame, keys, delta: str = "delta_age") -> DataFrame:
    return df.withColumn("p_age", F.try_divide(F.col(delta), F.sum(delta).over(W.partitionBy(*keys))))
