"""State transition kernels as long tables ``(keys, from_l, to_l, value)``.

A kernel has at most a few dozen cells, so it is packed into one array per key; the
small matrix arithmetic runs on Arrow batches of such rows, and Spark spreads the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from resight.functions.mathx import bound
from resight.operators.joins import match
from resight.session import settle, settle_lookup

CHUNK = 512


def pack(df: DataFrame, keys, k: int, value: str = "value", name: str = "kernel") -> DataFrame:
    """Long cells -> one flat row-major array of k*k doubles per key; absent cells are 0."""
    at = ((F.col("from_l") - 1) * k + F.col("to_l") - 1).cast("int")
    cells = F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.col(value).cast("double").alias("v"))))
    flat = F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return df.groupBy(*keys).agg(cells.alias("m")).withColumn(name, flat).drop("m")


def unpack(df: DataFrame, keys, k: int, name: str = "kernel") -> DataFrame:
    rows = df.select(*keys, F.posexplode(name).alias("_at", "value"))
    return rows.select(*keys, (F.floor(F.col("_at") / k) + 1).cast("int").alias("from_l"), (F.col("_at") % k + 1).alias("to_l"), "value")


def _batches(n: int):
    return (slice(i, min(i + CHUNK, n)) for i in range(0, n, CHUNK))


def _expm(q: np.ndarray) -> np.ndarray:
    """Matrix exponential of a stack of small matrices: scale, Taylor series, square.

    Each matrix is scaled by its own norm, so its result does not depend on its batch. One with a
    rate that is not finite gives NaN.
    """
    norm = np.abs(q).sum(axis=-1).max(axis=-1)
    known = np.isfinite(norm)
    squarings = np.where(known & (norm > 0), np.maximum(0, np.ceil(np.log2(np.where(known & (norm > 0), norm, 1.0))) + 4), 0).astype(int)
    a = np.where(known[:, None, None], q, np.nan) / (2.0**squarings)[:, None, None]
    out = np.broadcast_to(np.eye(q.shape[-1]), q.shape).copy()
    term = out.copy()
    for i in range(1, 14):
        term = term @ a / i
        out += term
    for i in range(squarings.max(initial=0)):
        more = squarings > i
        out[more] = out[more] @ out[more]
    return out


def _expm_udf(k: int, dt: float):
    @F.pandas_udf("array<double>")
    def run(rates: pd.Series) -> pd.Series:
        out = []
        for part in _batches(len(rates)):
            q = np.stack(rates.iloc[part].to_numpy()).reshape(-1, k, k).astype(float)
            q[:, range(k), range(k)] = 0.0
            q[:, range(k), range(k)] = -q.sum(axis=2)
            out += list(_expm(q * dt).reshape(-1, k * k))
        return pd.Series(out)

    return run


def rate_to_transition(rates: DataFrame, keys, k: int, log_rate: str = "log_rate", dt: float = 1.0) -> DataFrame:
    """exp(Q dt) where Q has the exponentiated rates above its diagonal and zero row sums."""
    packed = pack(rates.withColumn("_r", F.exp(log_rate)), keys, k, "_r")
    return unpack(packed.withColumn("kernel", _expm_udf(k, dt)("kernel")), keys, k)


def two_state_survival(log_rate, dt: float = 1.0):
    """The 2-state case in closed form: probability of staying."""
    return F.exp(-F.exp(log_rate) * dt)


def row_softmax_transition(scores: DataFrame, keys, k: int, par: str = "par") -> DataFrame:
    """Upper-triangular scores over k live states, plus the absorbing state with score 1."""
    live = scores.where(F.col("from_l") <= F.col("to_l")).select(*keys, "from_l", "to_l", F.exp(par).alias("e"))
    lead = scores.select(*keys, "from_l").distinct().select(*keys, "from_l", F.lit(k + 1).alias("to_l"), F.lit(1.0).alias("e"))
    end = scores.select(*keys).distinct().select(*keys, F.lit(k + 1).alias("from_l"), F.lit(k + 1).alias("to_l"), F.lit(1.0).alias("e"))
    rows = live.unionByName(lead).unionByName(end)
    return rows.select(*keys, "from_l", "to_l", (F.col("e") / F.sum("e").over(W.partitionBy(*keys, "from_l"))).alias("value"))


def softmax_cells(live, k: int):
    """``row_softmax_transition`` of one row's cells: an array of (from_l, to_l, e), e being the exponentiated score."""
    total = lambda c, i: F.aggregate(F.filter(c, lambda x: x["from_l"] == i), F.lit(1.0), lambda a, x: a + F.coalesce(x["e"], F.lit(0.0)))
    cell = lambda i, j, v: F.struct(i.alias("from_l"), j.alias("to_l"), v.alias("value"))
    end = F.lit(k + 1)

    def rows(c):
        stay = F.transform(c, lambda x: cell(x["from_l"], x["to_l"], x["e"] / total(c, x["from_l"])))
        lead = F.transform(F.array_distinct(F.transform(c, lambda x: x["from_l"])), lambda i: cell(i, end, 1.0 / total(c, i)))
        return F.concat(stay, lead, F.array(cell(end, end, F.lit(1.0))))

    return bound(live, rows)


def movement_kernel(scores: DataFrame, keys, par: str = "par") -> DataFrame:
    """Upstream-only movement: diagonal score 1, exp(par) above it, rows normalised."""
    stay = F.when(F.col("from_l") == F.col("to_l"), 1.0).otherwise(F.exp(par))
    rows = scores.where(F.col("from_l") <= F.col("to_l")).select(*keys, "from_l", "to_l", stay.alias("e"))
    return rows.select(*keys, "from_l", "to_l", (F.col("e") / F.sum("e").over(W.partitionBy(*keys, "from_l"))).alias("value"))


def _forward_udf(k: int):
    @F.pandas_udf("array<double>")
    def run(kernel: pd.Series, entries: pd.Series) -> pd.Series:
        out: list = [None] * len(kernel)
        lengths = entries.map(len).to_numpy()
        for length in np.unique(lengths):
            where = np.flatnonzero(lengths == length)
            for part in _batches(len(where)):
                rows = where[part]
                m = np.stack(kernel.iloc[rows].to_numpy()).reshape(-1, k, k)
                e = np.stack(entries.iloc[rows].to_numpy()).reshape(len(rows), -1, k)
                x, states = np.zeros((len(rows), k)), np.empty_like(e)
                for t in range(e.shape[1]):
                    x = np.einsum("bi,bij->bj", x, m) + e[:, t]
                    states[:, t] = x
                for i, row in enumerate(rows):
                    out[row] = states[i].ravel()
        return pd.Series(out)

    return run


def forward_states(kernel: DataFrame, entries: DataFrame, keys, k: int) -> DataFrame:
    """x_t = x_{t-1} K + e_t for every key: long kernel and long entries (keys, t_k, loc, value).

    Returns (keys, t_k, loc, value). A key's entries are its periods times its states.
    """
    order = F.array_sort(F.collect_list(F.struct("t_k", "loc", F.col("value").cast("double").alias("v"))))
    packed = entries.groupBy(*keys).agg(order.alias("o")).withColumn("entries", F.transform("o", lambda x: x["v"]))
    return forward_packed(match(pack(kernel, keys, k).hint("merge"), packed.select(*keys, "entries"), keys), keys, k)


def forward_packed(both: DataFrame, keys, k: int) -> DataFrame:
    """``forward_states`` of rows (keys, kernel, entries): k*k numbers, and k for each period in order of period and state."""
    run = both.select(*keys, F.posexplode(_forward_udf(k)("kernel", "entries")).alias("_at", "value"))
    return run.select(*keys, (F.floor(F.col("_at") / k) + 1).cast("int").alias("t_k"), (F.col("_at") % k + 1).alias("loc"), "value")


def movement_forward(movement: DataFrame, entries: DataFrame, rates: DataFrame, keys, k: int) -> DataFrame:
    """Available undetected individuals by location when survivors may move upstream.

    ``rates`` has phi and p per key; one step keeps phi (1 - p) of the movement row. Every side has the keys' size,
    which a plan can't tell from exploded cells, so none is left to be broadcast.
    """
    step = match(movement.hint("merge"), rates.select(*keys, "phi", "p"), keys).withColumn("value", F.col("value") * F.col("phi") * (1 - F.col("p")))
    return forward_states(step, entries, keys, k)


def movement_row(score, k: int):
    """``movement_kernel`` as one flat array, from a score for each pair of states (from, to)."""
    rows = [[F.lit(1.0) if i == j else F.exp(score(i, j)) for j in range(i, k + 1)] for i in range(1, k + 1)]
    sums = [sum(row[1:], row[0]) for row in rows]
    return F.flatten(F.array(*[F.array(*[F.lit(0.0)] * i, *[e / total for e in row]) for i, (row, total) in enumerate(zip(rows, sums))]))


def movement_forward_packed(sets: DataFrame, keys, k: int) -> DataFrame:
    """``movement_forward`` of rows (keys, phi, p, kernel, entries), which need no join and no shuffle."""
    step = bound(F.col("phi") * (1 - F.col("p")), lambda stay: F.transform("kernel", lambda x: x * stay))
    return forward_packed(sets.select(*keys, step.alias("kernel"), "entries"), keys, k)


def abundance_states(rates: DataFrame, born: DataFrame, keys, k: int, log_rate: str = "log_rate") -> DataFrame:
    """N_t = Phi(1/2)' B_t + Phi' N_{t-1} over k states."""
    half = rate_to_transition(rates, keys, k, log_rate, 0.5).withColumnRenamed("value", "h")
    entered = (
        match(born.withColumnRenamed("loc", "from_l"), half, [*keys, "from_l"])
        .groupBy(*keys, "t_k", F.col("to_l").alias("loc"))
        .agg(F.sum(F.col("value") * F.col("h")).alias("value"))
    )
    return forward_states(rate_to_transition(rates, keys, k, log_rate), entered, keys, k)


def pooled_group_kernel(rates: DataFrame, born: DataFrame, keys, group: str = "grp") -> DataFrame:
    """Births-weighted mean of the groups' rate kernels per period, for rows of unknown group."""
    w = match(rates, born, [*keys, group])
    return w.groupBy(*keys, "t_k", "from_l", "to_l").agg(F.try_divide(F.sum(F.col("rate") * F.col("B")), F.sum("B")).alias("rate"))


def transition_detection(kernel: DataFrame, detect: DataFrame, keys) -> DataFrame:
    """Product of a transition and a detection kernel on the shared inner state.

    Both sides hold cells of every key, made by an explosion whose size a plan doesn't see; neither may be broadcast.
    """
    right = detect.select(*keys, F.col("from_l").alias("mid"), F.col("to_l").alias("out_l"), F.col("value").alias("d"))
    left = kernel.withColumnRenamed("to_l", "mid")
    prod = match(left.hint("merge"), right, [*keys, "mid"]).groupBy(*keys, "from_l", F.col("out_l").alias("to_l")).agg(F.sum(F.col("value") * F.col("d")).alias("value"))
    return prod.withColumn("logit", _logit())


def _logit():
    return F.when((F.col("value") > 0) & (F.col("value") < 1), F.log(F.col("value") / (1 - F.col("value"))))


def transition_detection_packed(sets: DataFrame, keys) -> DataFrame:
    """``transition_detection`` of one row a key with both kernels' cells as arrays, without a join or a shuffle."""
    def product(x):
        meet = lambda y: F.transform(F.filter("detection", lambda z: z["from_l"] == y["to_l"]), lambda z: F.struct(y["from_l"].alias("from_l"), z["to_l"].alias("to_l"), (y["value"] * z["value"]).alias("value")))
        return F.flatten(F.transform(x, meet))

    def summed(prod):
        pairs = F.array_distinct(F.transform(prod, lambda x: F.struct(x["from_l"].alias("from_l"), x["to_l"].alias("to_l"))))
        of = lambda q: F.filter(prod, lambda x: (x["from_l"] == q["from_l"]) & (x["to_l"] == q["to_l"]) & x["value"].isNotNull())
        total = lambda q: F.aggregate(of(q), F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x["value"], x["value"]))
        return F.transform(pairs, lambda q: F.struct(q["from_l"].alias("from_l"), q["to_l"].alias("to_l"), total(q).alias("value")))

    cells = bound(product("transition"), summed)
    return sets.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").withColumn("logit", _logit())


def _powers_udf(k: int):
    @F.pandas_udf("struct<found: array<double>, unseen: array<double>>")
    def run(kernel: pd.Series, detect: pd.Series, lags: pd.Series) -> pd.DataFrame:
        found, unseen = [None] * len(kernel), [None] * len(kernel)
        # keys with as many lags go through the recursion together
        steps = lags.to_numpy().astype(int) + 1
        for n in np.unique(steps):
            same = np.flatnonzero(steps == n)
            for part in _batches(len(same)):
                at = same[part]
                phi = np.stack(kernel.iloc[at].to_numpy()).astype(float).reshape(-1, k, k)
                p = np.stack(detect.iloc[at].to_numpy()).astype(float)[:, None, :]
                miss, power = phi * (1 - p), np.broadcast_to(np.eye(k), phi.shape)
                f, u = np.empty((len(at), n, k * k)), np.empty((len(at), n, k))
                for i in range(n):
                    u[:, i] = power.sum(axis=2)
                    f[:, i] = (power @ phi * p).reshape(-1, k * k)
                    power = power @ miss
                for j, x, y in zip(at, f, u):
                    found[j], unseen[j] = x.ravel(), y.ravel()
        return pd.DataFrame({"found": found, "unseen": unseen})

    return run


def history_cells(kernel: DataFrame, detect: DataFrame, lags: DataFrame, keys, k: int) -> DataFrame:
    """Cell probabilities of recapture histories for every key and lag.

    ``kernel`` has k states of which the last absorbs, ``detect`` has (keys, loc, p) for the
    live ones, ``lags`` the number of lags per key. ``outcome`` r is "found at location r
    after exactly lag periods", 0 is "never found in lag periods". Computed once per key,
    whatever the number of histories.
    """
    found_at = F.map_from_entries(F.collect_list(F.struct("loc", F.col("p").cast("double").alias("v"))))
    flat = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    dets = detect.groupBy(*keys).agg(found_at.alias("m")).withColumn("detect", flat).select(*keys, "detect")
    # settled, as both kinds of cells come from the one evaluation
    base = settle(match(match(pack(kernel, keys, k), dets, keys), lags, keys).withColumn("w", _powers_udf(k)("kernel", "detect", "lags")).select(*keys, "w"))
    kk = k * k
    hit = base.select(*keys, F.posexplode("w.found").alias("_at", "prob")).select(
        *keys, (F.floor(F.col("_at") / kk) + 1).cast("int").alias("lag"),
        (F.floor(F.col("_at") % kk / k) + 1).cast("int").alias("t_l"), (F.col("_at") % k + 1).alias("outcome"), "prob",
    )
    none = base.select(*keys, F.posexplode("w.unseen").alias("_at", "prob")).select(
        *keys, F.floor(F.col("_at") / k).cast("int").alias("lag"), (F.col("_at") % k + 1).alias("t_l"), F.lit(0).alias("outcome"), "prob",
    )
    return hit.where(F.col("outcome") < k).unionByName(none)


def history_probability(hist: DataFrame, cells: DataFrame, last: DataFrame, keys, strict_guard: bool = False) -> DataFrame:
    """Probability of every counted history, with s the last period of its key.

    A history captured in the last period has no later period to be seen in, so its
    probability is 1. ``strict_guard`` also gives 1 to never-recaptured histories with a
    single period left.
    """
    left = F.greatest(F.col("s") - F.col("t_k"), F.lit(0))
    if strict_guard:
        left = F.when(left <= 1, 0).otherwise(left)
    lag = F.when(F.col("r_k").isNull(), left).otherwise(F.col("r_k") - F.col("t_k"))
    coded = match(hist, last, keys).withColumns({"lag": lag, "outcome": F.when(F.col("r_k").isNull(), 0).otherwise(F.col("r_l"))})
    return match(coded, cells, [*keys, "lag", "t_l", "outcome"], "left").drop("lag", "outcome", "s")


def _by_period_udf(k: int, strict_guard: bool):
    @F.pandas_udf("array<double>")
    def run(kernel: pd.Series, detect: pd.Series, s: pd.Series, t_k: pd.Series, r_k: pd.Series, t_l: pd.Series, r_l: pd.Series) -> pd.Series:
        out: list = [None] * len(kernel)
        ends = s.to_numpy().astype(int)
        for last in np.unique(ends):
            same = np.flatnonzero(ends == last)
            step = max(1, CHUNK * 1024 // max(1, int(last) * k * k))
            for lo in range(0, len(same), step):
                at = same[lo : lo + step]
                phi = np.stack(kernel.iloc[at].to_numpy()).astype(float).reshape(-1, k, k)
                p = np.stack(detect.iloc[at].to_numpy()).astype(float).reshape(len(at), -1, k)
                sizes = [len(t_k.iloc[i]) for i in at]
                own = np.repeat(np.arange(len(at)), sizes)
                t, r, a, b = (np.concatenate([np.asarray(c.iloc[i], dtype=int) for i in at] or [np.zeros(0, int)]) for c in (t_k, r_k, t_l, r_l))
                prob = np.full(len(own), np.nan)
                prob[(r == 0) & (t >= last)] = 1.0
                # from the last period back: what is found in r, and what is never found, from every state of t on
                found, never = np.zeros((len(at), last + 1, k, k)), np.ones((len(at), k))
                for j in range(last - 1, 0, -1):
                    seen = p[:, j][:, None, :]
                    miss = phi * (1 - seen)
                    found[:, j + 2 :] = miss[:, None] @ found[:, j + 2 :]
                    found[:, j + 1] = phi * seen
                    never = (miss @ never[:, :, None])[:, :, 0]
                    here = np.flatnonzero(t == j)
                    gone = here[r[here] == 0]
                    prob[gone] = never[own[gone], a[gone] - 1]
                    if strict_guard and j == last - 1:
                        prob[gone] = 1.0
                    hit = here[r[here] > j]
                    prob[hit] = found[own[hit], r[hit], a[hit] - 1, b[hit] - 1]
                for i, x in zip(at, np.split(prob, np.cumsum(sizes)[:-1])):
                    out[i] = x
        return pd.Series(out)

    return run


def history_probability_by_period(hist: DataFrame, kernel: DataFrame, detect: DataFrame, last: DataFrame, keys, k: int, strict_guard: bool = False) -> DataFrame:
    """Probability of every counted history where detection varies by period as well as by location.

    ``detect`` has (keys, t_k, loc, p). A history multiplies one matrix for each period it runs through, and these
    don't commute, so a lag has no power of its own: per key the products over all segments (t, r] grow backwards from
    the last period, one period a step, and each history takes its cell where its own period is reached.
    A key's counted histories are one row, as many numbers as it has cells. Otherwise as ``history_probability``; a
    recapture that is not later than the capture has a null probability.
    """
    keys = list(keys)
    rest = [c for c in hist.columns if c not in keys]
    at = ((F.col("t_k") - 1) * k + F.col("loc") - 1).cast("int")
    dets = detect.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.col("p").cast("double").alias("v")))).alias("m"))
    packed = hist.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("h"))
    both = match(match(match(packed, last.select(*keys, "s"), keys), dets, keys), pack(kernel, keys, k), keys)
    flat = F.transform(F.sequence(F.lit(0), F.col("s") * k - 1), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)))
    cell = lambda c: F.transform("h", lambda x: F.coalesce(x[c], F.lit(0)).cast("int"))
    both = both.withColumns({"detect": flat, **{f"_{c}": cell(c) for c in ("t_k", "r_k", "t_l", "r_l")}})
    prob = _by_period_udf(k, strict_guard)("kernel", "detect", "s", "_t_k", "_r_k", "_t_l", "_r_l")
    rows = both.withColumn("prob", prob).select(*keys, F.explode(F.arrays_zip("h", "prob")).alias("z"))
    return rows.select(*keys, *[F.col(f"z.h.{c}").alias(c) for c in rest], F.nanvl("z.prob", F.lit(None).cast("double")).alias("prob")).select(*hist.columns, "prob")


def _score_sets_udf(k: int):
    @F.pandas_udf("array<double>")
    def run(kernels: pd.Series, detects: pd.Series, lag: pd.Series, t_l: pd.Series, outcome: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for m, d, lags, a, o, count in zip(kernels, detects, lag, t_l, outcome, n):
            phi = np.stack(m).astype(float).reshape(-1, k, k)
            p = np.stack(d).astype(float)[:, None, :]
            lags, a, o, count = (np.asarray(x, dtype=float if x is count else int) for x in (lags, a, o, count))
            miss, power = phi * (1 - p), np.broadcast_to(np.eye(k), phi.shape)
            score = np.zeros(len(phi))
            for step in range(int(lags.max(initial=0)) + 1):
                # "found after exactly step periods" needs one period less of not being found
                never = np.flatnonzero((o == 0) & (lags == step))
                hit = np.flatnonzero((o > 0) & (lags == step + 1))
                with np.errstate(divide="ignore"):
                    if len(never):
                        score += np.log(power.sum(axis=2)[:, a[never] - 1]) @ count[never]
                    if len(hit):
                        score += np.log((power @ phi * p)[:, a[hit] - 1, o[hit] - 1]) @ count[hit]
                power = power @ miss
            out.append(score)
        return pd.Series(out)

    return run


def score_cjs_sets(hist: DataFrame, kernels: DataFrame, detects: DataFrame, last: DataFrame, keys, sets, k: int, block: int = 256) -> DataFrame:
    """Log likelihood of the tagged histories of each key under every one of its parameter sets.

    ``kernels`` (keys, sets, from_l, to_l, value) and ``detects`` (keys, sets, loc, p) hold many sets a key. Histories
    are summed to one sparse vector of counts over (lag, place, outcome) for each key; sets come in
    blocks, and a block's log cell tables meet the vector as a whole. So no history is copied for a
    set, and a key with very many sets is spread over its blocks. Returns keys, sets, loglik, best: 1 for the
    likeliest set of its key (to six decimals), the smallest of equals.
    """
    keys, sets = list(keys), list(sets)
    lag = F.when(F.col("r_k").isNull(), F.greatest(F.col("s") - F.col("t_k"), F.lit(0))).otherwise(F.col("r_k") - F.col("t_k"))
    outcome = F.when(F.col("r_k").isNull(), 0).otherwise(F.col("r_l"))
    cells = match(hist.where("tag"), last.select(*keys, "s"), keys).groupBy(*keys, lag.cast("int").alias("lag"), "t_l", outcome.cast("int").alias("outcome")).agg(F.sum("n").cast("double").alias("n"))
    vector = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lag", "t_l", "outcome", "n"))).alias("v"))
    found_at = F.map_from_entries(F.collect_list(F.struct("loc", F.col("p").cast("double").alias("x"))))
    flat = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    dets = detects.groupBy(*keys, *sets).agg(found_at.alias("m")).withColumn("detect", flat).drop("m")
    one = settle(match(pack(kernels, [*keys, *sets], k), dets, [*keys, *sets]))
    most = one.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    blocks = one.withColumn("_block", F.pmod(F.xxhash64(*sets), F.lit(-(-most // block))))
    blocks = blocks.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct(*sets, "kernel", "detect"))).alias("b"))
    both = match(blocks, settle_lookup(vector), keys)
    part = lambda c, f: F.transform(c, lambda x: x[f])
    score = _score_sets_udf(k)(part("b", "kernel"), part("b", "detect"), part("v", "lag"), part("v", "t_l"), part("v", "outcome"), part("v", "n"))
    rows = both.withColumn("score", score).select(*keys, F.explode(F.arrays_zip("b", "score")).alias("z"))
    rows = settle(rows.select(*keys, *[F.col(f"z.b.{c}").alias(c) for c in sets], F.col("z.score").alias("loglik")))
    best = rows.groupBy(*keys).agg(F.max(F.round("loglik", 6)).alias("_best"))
    first = match(rows, best, keys).where("round(loglik, 6) = _best").groupBy(*keys).agg(F.min(F.struct(*sets)).alias("_first"))
    hit = F.col("_first") == F.struct(*sets)
    return match(rows, first, keys, "left").withColumn("best", F.coalesce(hit.cast("int"), F.lit(0))).drop("_first")
