"""Model quantities, scores and fits: published values, identities, brute force, recovery."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from resight.operators import fit, histories as H, kernels as K, model as M, score, stats
from resight.plans import abundance as A, movement
from season import COLUMNS, LAMBDA, MARK, NSUPER, P, PHI, SEASON, TAU, season


def quantities(spark, phi, p, pent, first_entry="once"):
    s = len(pent)
    cols = "set_id int, t_k int, phi double, p double, pent double"
    phi, p = np.broadcast_to(phi, s), np.broadcast_to(p, s)
    df = spark.createDataFrame([(1, i + 1, float(phi[i]), float(p[i]), float(pent[i])) for i in range(s)], cols)
    return [r for r in M.js_quantities(df, ["set_id"], first_entry=first_entry).orderBy("t_k").collect()]


# ---- published season

def test_season_identities():
    total = 0
    for _, seen, _, first, later, now, risk in SEASON:
        assert seen == first + now and risk == total
        total += later - now
    assert sum(r[4] for r in SEASON) == sum(r[5] for r in SEASON) == 780
    assert sum(r[3] for r in SEASON) == 6262


def test_mark_rate_matches_the_published_means(spark):
    got = {r.t_k: (r.v_mean, r.v_sd) for r in score.beta_posterior(season(spark)).collect()}
    for t, (mean, sd, n_eff) in MARK.items():
        assert abs(got[t][0] - mean) < 3 * sd / math.sqrt(n_eff)
        assert got[t][1] == pytest.approx(sd, rel=0.2)


def test_lambda_and_tau_match_the_published_ones(spark):
    df = spark.range(1, 17).select(F.col("id").cast("int").alias("t"), M.lambda_const(F.lit(PHI[0]), F.lit(P[0]), 16 - F.col("id")).alias("lam"))
    got = {r.t: r for r in df.withColumn("tau", M.tau_of(F.lit(P[0]), F.col("lam"))).collect()}
    for t, v in LAMBDA.items():
        assert got[t].lam == pytest.approx(v, abs=1e-3)
    for t, v in TAU.items():
        assert got[t].tau == pytest.approx(v, abs=1e-3)


def test_fit_matches_the_published_one(spark):
    stats_ = season(spark, year=2023)
    out = fit.fit_grid(fit.score_grid(stats_, ["year"], fit.grid((0.36, 0.52, 0.01), (0.70, 0.90, 0.01))), ["year"]).first()
    assert abs(out.mean_phi - PHI[0]) < PHI[1] / 2 and abs(out.mean_p - P[0]) < P[1] / 2
    assert out.mean_nsuper == pytest.approx(NSUPER[0], rel=0.01)
    assert out.sd_nsuper == pytest.approx(NSUPER[1], rel=0.1)
    assert out.sd_phi == pytest.approx(PHI[1], rel=0.15) and out.sd_p == pytest.approx(P[1], rel=0.15)


def test_fit_treats_groups_alike(spark):
    one = season(spark, grp="a")
    both = one.unionByName(season(spark, grp="b"))
    cells = fit.grid((0.40, 0.48, 0.02), (0.76, 0.84, 0.02))
    rows = fit.fit_grid(fit.score_grid(both.repartition(5), ["grp"], cells), ["grp"]).collect()
    assert len(rows) == 2 and rows[0][1:] == pytest.approx(rows[1][1:])


# ---- identities

def test_quantities_are_consistent(spark):
    rng = np.random.default_rng(3)
    phi, p, pent = rng.uniform(0.2, 0.95, 9), rng.uniform(0.1, 0.9, 9), rng.dirichlet(np.ones(9))
    q = quantities(spark, phi, p, pent)
    assert sum(r.multP for r in q) == pytest.approx(1) and q[-1]["lambda"] == 0 and q[-1].tau == 1
    psi, lam = [pent[0]], [0.0] * 9
    for i in range(8):
        psi.append(psi[i] * (1 - p[i]) * phi[i] + pent[i + 1] * (phi[i] - 1) / math.log(phi[i]))
    for i in range(7, -1, -1):
        lam[i] = phi[i] * (p[i + 1] + (1 - p[i + 1]) * lam[i + 1])
    assert [r.psi for r in q] == pytest.approx(psi) and [r["lambda"] for r in q] == pytest.approx(lam)


def test_constant_and_varying_recapture_agree(spark):
    q = quantities(spark, 0.6, 0.35, np.full(12, 1 / 12))
    df = spark.range(1, 13).select("id", M.lambda_const(F.lit(0.6), F.lit(0.35), 12 - F.col("id")).alias("x"))
    assert [r["lambda"] for r in q] == pytest.approx([r.x for r in df.orderBy("id").collect()])


def test_first_entry_twice_adds_one_more_cohort(spark):
    pent = np.full(5, 0.2)
    a, b = quantities(spark, 0.5, 0.4, pent), quantities(spark, 0.5, 0.4, pent, "twice")
    c, q = (0.5 - 1) / math.log(0.5), 0.5 * 0.6
    assert [y.psi - x.psi for x, y in zip(a, b)] == pytest.approx([0.2 * c * q**i for i in range(5)])


def test_states_sum_to_one(spark):
    r = spark.range(1).select(M.three_state_forward(F.lit(0.7), F.lit(0.4), F.lit(6)).alias("s")).select("s.*").first()
    assert r.alive + r.detected + r.dead == pytest.approx(1)
    t = np.array([[0.42, 0.28, 0.3], [0, 1, 0], [0, 0, 1]])
    assert [r.alive, r.detected, r.dead] == pytest.approx(np.linalg.matrix_power(t, 6)[0].tolist())


def long_kernel(spark, m, **keys):
    rows = [(i + 1, j + 1, float(m[i, j])) for i in range(len(m)) for j in range(len(m)) if m[i, j] != 0]
    return spark.createDataFrame(rows, "from_l int, to_l int, value double").withColumns({k: F.lit(v) for k, v in keys.items()})


def test_rates_to_transition(spark):
    rng = np.random.default_rng(0)
    r = np.triu(rng.uniform(-3, 1.5, (6, 6)), 1)
    rows = [(i + 1, j + 1, float(r[i, j])) for i in range(6) for j in range(i + 1, 6)]
    df = spark.createDataFrame(rows, "from_l int, to_l int, log_rate double").withColumn("g", F.lit(1))
    got = np.zeros((6, 6))
    for x in K.rate_to_transition(df, ["g"], 6).collect():
        got[x.from_l - 1, x.to_l - 1] = x.value
    q = np.triu(np.exp(r), 1)
    q -= np.diag(q.sum(axis=1))
    w, v = np.linalg.eig(q)
    want = (v @ np.diag(np.exp(w)) @ np.linalg.inv(v)).real
    assert np.abs(got - want).max() < 1e-10 and got.sum(axis=1) == pytest.approx(np.ones(6))
    two = spark.range(1).select(K.two_state_survival(F.lit(-0.4)).alias("x")).first().x
    assert two == pytest.approx(math.exp(-math.exp(-0.4)))


def test_movement_without_moves_is_the_common_path(spark):
    pent = np.array([0.1, 0.4, 0.3, 0.2])
    share = [0.5, 0.2, 0.1, 0.1, 0.1]
    psi = [r.psi for r in quantities(spark, 0.6, 0.5, pent)]
    c = (0.6 - 1) / math.log(0.6)
    e = [(1, t + 1, j + 1, pent[t] * share[j] * (1 if t == 0 else c)) for t in range(4) for j in range(5)]
    entries = spark.createDataFrame([(a, b, d, float(v)) for a, b, d, v in e], "g int, t_k int, loc int, value double")
    rates = spark.createDataFrame([(1, 0.6, 0.5)], "g int, phi double, p double")
    stay = long_kernel(spark, np.eye(5), g=1)
    out = {(r.t_k, r.loc): r.value for r in K.movement_forward(stay, entries, rates, ["g"], 5).collect()}
    assert [out[(t, 2)] for t in range(1, 5)] == pytest.approx([x * 0.2 for x in psi])
    # moving upstream does not change the total when detection is the same everywhere
    scores = spark.createDataFrame([(1, i, j, 0.3 * i - 0.2 * j) for i in range(1, 6) for j in range(i, 6)], "g int, from_l int, to_l int, par double")
    moved = K.movement_forward(K.movement_kernel(scores, ["g"]), entries, rates, ["g"], 5)
    total = [r.x for r in moved.groupBy("t_k").agg(F.sum("value").alias("x")).orderBy("t_k").collect()]
    assert total == pytest.approx(psi)


def test_softmax_kernel_rows_sum_to_one(spark):
    scores = spark.createDataFrame([(1, i, j, float(i - j)) for i in range(1, 4) for j in range(i, 4)], "g int, from_l int, to_l int, par double")
    rows = K.row_softmax_transition(scores, ["g"], 3).groupBy("from_l").agg(F.sum("value").alias("x")).collect()
    assert len(rows) == 4 and all(r.x == pytest.approx(1) for r in rows)


# ---- histories

def test_history_probabilities_by_hand(spark):
    phi = np.array([[0.5, 0.2, 0.3], [0, 0.6, 0.4], [0, 0, 1.0]])
    p = np.array([0.3, 0.7, 0.0])
    kernel = long_kernel(spark, phi, g=1)
    det = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.7)], "g int, loc int, p double")
    hist = spark.createDataFrame(
        [(1, 1, 3, 1, 2, True, 4), (1, 1, None, 1, None, True, 9), (1, 4, None, 2, None, True, 2), (1, 5, None, 2, None, True, 1), (1, 2, 3, 2, 1, True, 1)],
        "g int, t_k int, r_k int, t_l int, r_l int, tag boolean, n long",
    )
    last = hist.groupBy("g").agg(F.lit(5).alias("s"))
    cells = K.history_cells(kernel, det, last.select("g", F.col("s").alias("lags")), ["g"], 3)
    got = {(r.t_k, r.r_k): r.prob for r in K.history_probability(hist, cells, last, ["g"]).collect()}
    miss = phi @ np.diag(1 - p)
    assert got[(1, 3)] == pytest.approx((miss @ phi)[0, 1] * 0.7)
    assert got[(1, None)] == pytest.approx(np.linalg.matrix_power(miss, 4)[0].sum())
    assert got[(4, None)] == pytest.approx(miss[1].sum())
    assert got[(5, None)] == 1 and got[(2, 3)] == 0
    strict = {(r.t_k, r.r_k): r.prob for r in K.history_probability(hist, cells, last, ["g"], strict_guard=True).collect()}
    assert strict[(4, None)] == 1 and strict[(1, None)] == got[(1, None)]


def test_outcomes_of_a_capture_sum_to_one(spark):
    phi = np.array([[0.5, 0.2, 0.3], [0, 0.6, 0.4], [0, 0, 1.0]])
    det = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.7)], "g int, loc int, p double")
    lags = spark.createDataFrame([(1, 6)], "g int, lags int")
    cells = K.history_cells(long_kernel(spark, phi, g=1), det, lags, ["g"], 3)
    found = cells.where("outcome > 0 and lag <= 6").groupBy("t_l").agg(F.sum("prob").alias("x"))
    never = cells.where("outcome = 0 and lag = 6").select("t_l", F.col("prob").alias("y"))
    assert all(r.x + r.y == pytest.approx(1) for r in found.join(never, "t_l").where("t_l < 3").collect())


def simulate(n, phi, p, s, seed):
    """Tagged at period 1; the first later sighting, if any."""
    rng = np.random.default_rng(seed)
    out = np.zeros(n, int)
    alive = np.ones(n, bool)
    for t in range(2, s + 1):
        alive &= rng.random(n) < phi
        hit = alive & (out == 0) & (rng.random(n) < p)
        out[hit] = t
    return out


def test_simulated_histories_recover_their_rates(spark):
    """Score two-state histories under a grid of rates; the best cell is near the truth."""
    r = simulate(60_000, 0.74, 0.6, 4, 5)
    counts = [(0, 1, int(t) if t else None, 1, 1 if t else None, True, int((r == t).sum())) for t in (0, 2, 3, 4)]
    cells = [(round(float(f), 3), round(float(d), 3)) for f in np.arange(0.66, 0.83, 0.02) for d in np.arange(0.5, 0.71, 0.02)]
    sets = spark.createDataFrame([(i, math.log(-math.log(f)), d) for i, (f, d) in enumerate(cells)], "g int, log_rate double, p double")
    hist = spark.createDataFrame(counts, "z int, t_k int, r_k int, t_l int, r_l int, tag boolean, n long").join(sets.select("g").withColumn("z", F.lit(0)), "z").drop("z")
    rates = sets.select("g", F.lit(1).alias("from_l"), F.lit(2).alias("to_l"), "log_rate")
    scored = movement.fit_report(hist, rates, sets.select("g", F.lit(1).alias("loc"), "p"), ["g"], 2)[1].collect()
    best = max(scored, key=lambda x: x.loglik).g
    assert cells[best][0] == pytest.approx(0.74, abs=0.021) and cells[best][1] == pytest.approx(0.6, abs=0.031)


HIST = [(1, 1, 3, True, 4), (1, 1, None, True, 2), (1, 2, 3, True, 1), (1, 2, None, False, 5), (1, 3, None, True, 3), (1, 5, None, False, 1)]


def hist_frame(spark):
    return spark.createDataFrame(HIST, "t_yr int, t_k int, r_k int, tag boolean, n long")


def test_statistics_from_histories(spark):
    h = hist_frame(spark)
    b = H.last_period(h)
    rows = {r.t_k: r for r in H.js_from_histories(h, b).collect()}
    pick = lambda c: [rows[t][c] for t in range(1, 6)]
    assert pick("first_seen") == [6, 6, 3, 0, 1] and pick("marked") == [6, 1, 3, 0, 0]
    assert pick("recap_later") == [4, 1, 0, 0, 0] and pick("recap_now") == [0, 0, 5, 0, 0]
    assert pick("at_risk") == [0, 4, 5, 0, 0] and pick("seen") == [6, 6, 8, 0, 1]
    want = H.expand_at_risk(h, b).groupBy("period").agg(F.sum("n").alias("x"))
    got = {r.t_k: r.at_risk for r in H.at_risk(h, b).collect()}
    assert {r.period: r.x for r in want.collect()} == {k: v for k, v in got.items() if v}
    assert [r.m for r in H.recaps_by_period(h, b).orderBy("t_k").collect()] == [0, 0, 5, 0, 0]
    assert [r.m for r in H.recaps_by_period(h, b, m_by="t_k").orderBy("t_k").collect()] == [4, 1, 0, 0, 0]
    assert H.period_pairs(b).count() == 10


def test_counts_are_kept(spark):
    df = spark.range(10_000).select((F.col("id") % 7).alias("t_k"), F.when(F.col("id") % 3 == 0, 9).alias("r_k"), (F.col("id") % 2 == 0).alias("tag"))
    h = H.histories(df)
    assert h.agg(F.sum("n")).first()[0] == 10_000
    assert h.exceptAll(H.histories(df.repartition(17))).count() == 0


def test_good_periods(spark):
    rows = {(r.vector, r.pos): (r.t_k, r.n_good) for r in stats.good_periods(season(spark, year=1)).collect()}
    assert rows[("T", 1)] == (3, 13) and rows[("R", 1)] == (1, 15) and rows[("R", 15)] == (15, 15)


# ---- entries

def test_entries_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    for i in range(12):
        n = int(rng.integers(1, 10))
        u = rng.poisson(8, n).astype(float) * (rng.random(n) > 0.3)
        phi, p = rng.uniform(0.1, 0.9, 2)
        q, c = phi * (1 - p), (phi - 1) / math.log(phi)
        lag = np.arange(n)[None, :] - np.arange(n)[:, None]
        w = np.where(lag >= 0, q ** np.maximum(lag, 0.0), 0) * p
        w[1:] *= c
        b = np.full(n, u.mean() + 1)
        for _ in range(20_000):
            m = b @ w
            b = b * (w @ np.where(u > 0, u / np.maximum(m, 1e-300), 0)) / w.sum(axis=1)
        rows.append((i, u.tolist(), float(phi), float(p)))
        want.append((b @ w, w))
    df = spark.createDataFrame(rows, "i int, u array<double>, phi double, p double")
    for r in fit.deconvolve_entries(df).collect():
        mu, w = want[r.i]
        u = np.array(r.u)

        def ll(m):
            return np.sum(np.where(u > 0, u * np.log(np.maximum(m, 1e-300)), 0) - m)

        got = np.array(r.mu)
        assert min(r.entries) >= 0 and np.array(r.entries) @ w == pytest.approx(got, abs=1e-7)
        assert ll(got) >= ll(mu) - 1e-6 and got.sum() == pytest.approx(u.sum())


def test_year_report(spark):
    rows = [(2023, t, None, True, mk - later) for t, _, mk, _, later, _, _ in SEASON if mk > later]
    rows += [(2023, t, None, False, first - mk) for t, _, mk, first, _, _, _ in SEASON if first > mk]
    # recaptures: fill each period's recaptured from the earliest still waiting
    waiting = []
    for t, _, _, _, later, now, _ in SEASON:
        while now:
            a, k = waiting[0]
            use = min(k, now)
            rows.append((2023, a, t, True, use))
            now -= use
            waiting[0] = (a, k - use)
            if waiting[0][1] == 0:
                waiting.pop(0)
        if later:
            waiting.append((t, later))
    h = spark.createDataFrame(rows, "t_yr int, t_k int, r_k int, tag boolean, n long")
    r = A.year_report(h, ["t_yr"], fit.grid((0.38, 0.50, 0.02), (0.74, 0.86, 0.02))).first()
    assert r.difference == 0 and r.from_stats == sum(x[3] for x in SEASON) + sum(max(x[2] - x[3], 0) for x in SEASON)
    assert r.lower < NSUPER[0] < r.upper


# ---- scores

def test_score_js_by_hand(spark):
    q = spark.createDataFrame([(1, i, 0.6, 0.4, 1 / 16) for i in range(1, 17)], "set_id int, t_k int, phi double, p double, pent double")
    q = M.js_quantities(q.withColumns({"year": F.lit(1), "v": F.lit(0.3), "nsuper": F.lit(20000.0)}), ["year", "set_id"], ("v", "nsuper"))
    got = score.score_js(season(spark, year=1), q, ["year"], ["set_id"]).first()
    rows = q.orderBy("t_k").collect()
    lb = lambda k, n, p: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)
    want = 0.0
    for (t, seen, mk, u, later, now, risk), r in zip(SEASON, rows):
        if t < 16:
            want += lb(mk, seen, 0.3) + lb(later, mk, r["lambda"])
        if 2 <= t < 16:
            want += lb(now, risk, r.tau)
        want += u * math.log(r.multP) - math.lgamma(u + 1)
    tot = sum(x[3] for x in SEASON)
    mu = 20000 * rows[0].psiPtot
    want += math.lgamma(tot + 1) + tot * math.log(mu) - mu - math.lgamma(tot + 1)
    beta = lambda x: -0.5 * math.log(x) - 0.5 * math.log(1 - x) - 2 * math.lgamma(0.5)
    want += beta(0.6) + beta(0.4)
    assert got.loglik == pytest.approx(want, rel=1e-12)
    impossible = spark.createDataFrame([(t, s, m, u, lt, n, 0 if t == 5 else r) for t, s, m, u, lt, n, r in SEASON], COLUMNS).withColumn("year", F.lit(1))
    assert score.score_js(impossible, q, ["year"], ["set_id"]).first().loglik == -math.inf
    few = q.withColumn("nsuper", F.lit(100.0))
    assert score.score_js(season(spark, year=1), few, ["year"], ["set_id"], total="binomial").first().loglik == -math.inf


def test_end_rules_of_varying_rates(spark):
    df = spark.createDataFrame([(1, 4, [0.1, 0.2, 0.3, 0.4], [0.5, 0.6, 0.7])], "set_id int, s int, p array<double>, phi array<double>")
    got = [(r.p, r.phi) for r in M.expand_params(df, "ttt").orderBy("t_k").collect()]
    assert got == [(0.2, 0.5), (0.2, 0.6), (0.3, 0.7), (0.3, 0.7)]


# ---- histories by period, many sets, pooling, estimates by period

def _walk(phi, p, t, t_l, end):
    """State after every step from (t, t_l) to ``end`` without being found."""
    x = np.eye(len(phi))[t_l - 1]
    for j in range(t + 1, end + 1):
        x = x @ phi * (1 - p[j - 1])
    return x


def _kernels(r, keys, k):
    kernel, rows = {}, []
    for key in keys:
        q = np.triu(r.uniform(0.02, 0.5, (k, k)), 1)
        q[range(k), range(k)] = -q.sum(1)
        phi = np.linalg.matrix_power(np.eye(k) + q / 64, 64)
        kernel[key] = phi
        rows += [(key, i + 1, j + 1, float(phi[i, j])) for i in range(k) for j in range(k)]
    return kernel, rows


def test_history_probability_by_period(spark):
    r, k = np.random.default_rng(4), 4
    kernel, rows = _kernels(r, ["a", "b"], k)
    ends = {"a": 7, "b": 4}
    p = {g: np.concatenate([r.uniform(0.1, 0.9, (s, k - 1)), np.zeros((s, 1))], axis=1) for g, s in ends.items()}
    hist = [(g, t, None, a, None, True, 2) for g, s in ends.items() for t in range(1, s + 1) for a in range(1, k)]
    hist += [(g, t, u, a, b, True, 1) for g, s in ends.items() for t in range(1, s) for u in range(t + 1, s + 1) for a in range(1, k) for b in range(1, k)]
    hist = spark.createDataFrame(hist, "grp string, t_k int, r_k int, t_l int, r_l int, tag boolean, n long")
    long = spark.createDataFrame(rows, "grp string, from_l int, to_l int, value double")
    by_period = spark.createDataFrame([(g, t + 1, i + 1, float(p[g][t, i])) for g in p for t in range(ends[g]) for i in range(k - 1)], "grp string, t_k int, loc int, p double")
    last = H.last_period(hist, ["grp"])
    got = K.history_probability_by_period(hist, long, by_period, last, ["grp"], k).collect()
    assert len(got) == hist.count()
    for x in got:
        phi, q, s = kernel[x.grp], p[x.grp], ends[x.grp]
        want = _walk(phi, q, x.t_k, x.t_l, s).sum() if x.r_k is None else (_walk(phi, q, x.t_k, x.t_l, x.r_k - 1) @ phi * q[x.r_k - 1])[x.r_l - 1]
        assert x.prob == pytest.approx(want, abs=1e-12)
    # what happens to a capture adds up to one
    total = {}
    for x in got:
        total[x.grp, x.t_k, x.t_l] = total.get((x.grp, x.t_k, x.t_l), 0) + x.prob
    assert all(v == pytest.approx(1) for v in total.values())

    # constant detection gives what the powers of one matrix give
    flat = spark.createDataFrame([(g, i + 1, 0.2 + 0.1 * i) for g in p for i in range(k - 1)], "grp string, loc int, p double")
    spread = flat.join(last, "grp").selectExpr("grp", "loc", "p", "explode(sequence(1, s)) as t_k")
    for strict in (False, True):
        cells = K.history_cells(long, flat, last.withColumnRenamed("s", "lags"), ["grp"], k)
        old = {tuple(x)[:-1]: x.prob for x in K.history_probability(hist, cells, last, ["grp"], strict).select(*hist.columns, "prob").collect()}
        new = {tuple(x)[:-1]: x.prob for x in K.history_probability_by_period(hist, long, spread, last, ["grp"], k, strict).collect()}
        assert old.keys() == new.keys() and all(new[x] == pytest.approx(old[x], abs=1e-12) for x in old)


def test_many_sets_against_counted_histories(spark):
    r, k = np.random.default_rng(6), 3
    sets = [(g, i) for g in ("a", "b") for i in range(40)]
    kernel, rows = _kernels(r, sets, k)
    p = {key: np.append(r.uniform(0.1, 0.9, k - 1), 0.0) for key in sets}
    hist = [("a", t, u, a, b, tag, int(r.integers(1, 9))) for t in range(1, 6) for u in (None, *range(t + 1, 7)) for a in (1, 2) for b in ((None,) if u is None else range(a, 3)) for tag in (True, False)]
    hist += [("b", 1, 2, 1, 2, True, 3), ("b", 2, None, 1, None, True, 5)]
    h = spark.createDataFrame(hist, "grp string, t_k int, r_k int, t_l int, r_l int, tag boolean, n long")
    kernels = spark.createDataFrame([(*key, i, j, v) for key, i, j, v in rows], "grp string, set_id int, from_l int, to_l int, value double")
    detects = spark.createDataFrame([(*key, i + 1, float(p[key][i])) for key in sets for i in range(k - 1)], "grp string, set_id int, loc int, p double")
    df = K.score_cjs_sets(h, kernels, detects, H.last_period(h, ["grp"]), ["grp"], ["set_id"], k, block=7)
    got = {(x.grp, x.set_id): x for x in df.collect()}
    assert len(got) == len(sets)
    ends = {"a": 6, "b": 2}
    want = {}
    for key in sets:
        q = np.tile(p[key], (10, 1))
        want[key] = sum(
            n * np.log(_walk(kernel[key], q, t, a, ends[g]).sum() if u is None else (_walk(kernel[key], q, t, a, u - 1) @ kernel[key] * q[0])[b - 1])
            for g, t, u, a, b, tag, n in hist if tag and g == key[0])
        assert got[key].loglik == pytest.approx(want[key], rel=1e-10)
    for g in ends:
        best = max((x for x in sets if x[0] == g), key=want.get)
        assert [x for x in sets if x[0] == g and got[x].best == 1] == [best]


def test_pooling_of_many_periods_in_little_memory():
    """Four hundred periods: as before by definition, and no array of periods squared."""
    r = np.random.default_rng(1)
    u, phi, p = r.poisson(r.uniform(0, 30, (256, 400))).astype(float), r.uniform(0.3, 0.95, 256), r.uniform(0.1, 0.9, 256)
    u[:, 50:60] = 0
    tracemalloc.start()
    mu = fit._fitted(u, phi, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    np.testing.assert_allclose(mu.sum(1), u.sum(1), rtol=1e-9)
    for row in range(3):
        q = phi[row] * (1 - p[row])
        x = np.array([max(min(u[row, a : b + 1].sum() * (1 - q) / (1 - q ** (b - a + 1)) / q**a for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]) if row == 0 else None
        if x is not None:
            short = fit._fitted(u[:1, :60], phi[:1], p[:1])[0]
            np.testing.assert_allclose(short, x * q ** np.arange(60), rtol=1e-9)


def _simulated(seed, s, phi, p, marks, born):
    """Statistics of carcasses that enter, survive, are seen, marked and taken out at their second sighting."""
    r = np.random.default_rng(seed)
    stats = {c: np.zeros(s) for c in ("first_seen", "marked", "recap_later", "recap_now")}
    fresh = 0
    cohorts = []
    for t in range(s):
        fresh = r.binomial(fresh, phi[t - 1]) if t else 0
        fresh += born[t]
        for c in cohorts:
            c[1] = r.binomial(c[1], phi[t - 1])
        seen = r.binomial(fresh, p[t])
        for c in cohorts:
            again = r.binomial(c[1], p[t])
            c[1] -= again
            stats["recap_now"][t] += again
            stats["recap_later"][c[0]] += again
        stats["first_seen"][t], fresh = seen, fresh - seen
        stats["marked"][t] = r.binomial(seen, marks)
        cohorts.append([t, int(stats["marked"][t])])
    risk = np.concatenate([[0], np.cumsum(stats["recap_later"] - stats["recap_now"])[:-1]])
    return [(7, t + 1, int(stats["first_seen"][t] + stats["recap_now"][t]), *(int(stats[c][t]) for c in ("marked", "first_seen", "recap_later", "recap_now")), int(risk[t])) for t in range(s)]


@pytest.mark.parametrize("form", ["ttt", "stt", "tst"])
def test_period_estimates_recover_what_was_simulated(spark, form):
    s = 8
    phi = np.full(s, 0.7) if form[1] == "s" else np.array([0.8, 0.6, 0.7, 0.75, 0.55, 0.65, 0.7, 0.7])
    p = np.full(s, 0.4) if form[0] == "s" else np.array([0.4, 0.4, 0.5, 0.3, 0.45, 0.35, 0.4, 0.4])
    rows = _simulated(3, s, phi, p, 0.9, [60_000, 40_000, 30_000, 20_000, 10_000, 8_000, 5_000, 4_000])
    kind = "g int, t_k int, seen long, marked long, first_seen long, recap_later long, recap_now long, at_risk long"
    got = sorted(M.period_estimates(spark.createDataFrame(rows, kind), ["g"], form).collect(), key=lambda x: x.t_k)
    assert [x.t_k for x in got] == list(range(1, s + 1))
    for x in got[1 : s - 2]:
        assert abs(x.p - p[x.t_k - 1]) < (3.5 * x.se_p if form[0] == "t" else 0.01)
        assert abs(x.phi - phi[x.t_k - 1]) < (3.5 * x.se_phi if form[1] == "t" else 0.01)
        assert abs(x.B - [60, 40, 30, 20, 10, 8, 5, 4][x.t_k - 1] * 1e3) < 3500
    assert got[0].p == got[1].p and got[-1].p == got[-2].p and got[-1].phi is None
    assert (got[3].se_p is None) == (form[0] == "s") and (got[3].se_phi is None) == (form[1] == "s")


def test_period_estimates_without_recaptures(spark):
    rows = [(1, 1, 5, 5, 5, 0, 0, 0), (1, 2, 4, 2, 4, 0, 0, 0), (1, 3, 0, 0, 0, 0, 0, 0), (2, 1, 3, 3, 3, 0, 0, 0)]
    kind = "g int, t_k int, seen long, marked long, first_seen long, recap_later long, recap_now long, at_risk long"
    got = M.period_estimates(spark.createDataFrame(rows, kind), ["g"]).collect()
    assert len(got) == 4 and all(x.N is None and x.se_N is None for x in got)


def test_expected_recaptures_by_recursion_and_by_cells(spark):
    rows = [(g, t, 5, 10.0 * t + g, 0.5 + g / 10, 0.3) for g in (1, 2) for t in range(1, 6)]
    df = spark.createDataFrame(rows, "g int, t_k int, s int, available double, phi double, p double")
    cells = M.expected_recaptures(df).groupBy("g", "r_k").sum("e_r").collect()
    want = {(x.g, x.r_k): x["sum(e_r)"] for x in cells}
    got = {(x.g, x.r_k): x.e_r for x in M.expected_recapture_totals(df, ["g"]).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in got)


def test_biodata_scores(spark):
    rows = [("a", "F", "3"), ("a", "F", "4"), ("a", "M", None), ("a", None, "3"), ("b", "M", "9"), ("b", "M", "9")]
    df = spark.createDataFrame(rows, "reach string, sex string, age string")
    counts = stats.biodata_long(df, ["reach"], {"sex": F.col("sex"), "age": F.col("age")})
    assert {tuple(r) for r in counts.collect()} == {("a", "sex", "F", 2), ("a", "sex", "M", 1), ("a", "age", "3", 2), ("a", "age", "4", 1), ("b", "sex", "M", 2), ("b", "age", "9", 2)}
    shares = [(i, "sex", c, p) for i, (f, m) in enumerate([(0.4, 0.6), (1.0, 0.0)]) for c, p in (("F", f), ("M", m))] + [(i, "age", c, p) for i in (0, 1) for c, p in (("3", 0.5), ("4", 0.3), ("5", 0.2))]
    got = {(r.reach, r.kind, r.set_id): r.loglik for r in score.score_biodata(counts, spark.createDataFrame(shares, "set_id int, kind string, cls string, share double"), ["reach"], ["set_id"]).collect()}
    assert got["a", "sex", 0] == pytest.approx(math.log(3 * 0.4**2 * 0.6)) and got["a", "sex", 1] == -math.inf
    assert got["a", "age", 0] == pytest.approx(math.log(3 * 0.5**2 * 0.3)) and got["b", "sex", 0] == pytest.approx(2 * math.log(0.6))
    # a class without a share
    assert ("b", "age", 0) not in got or got["b", "age", 0] == -math.inf


# ---- packed sets

def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("Join")


def packed(long, keys, cols):
    return long.groupBy(*keys).agg(F.collect_list(F.struct("t_k", *cols)).alias("path"))


def test_packed_sets_give_the_long_tables_results_without_a_shuffle(spark):
    cols = ["phi", "p", "pent", "log_delta", "days", "logit_phi", "delta", "b"]
    rows = [(g, t, 0.5 + g / 40, 0.3 + t / 50, t / 15.0, (g - t) / 4.0, float(1 + t % 3), 2.0 + g / 5, float(1 + g * t % 4), g * t / 9.0) for g in (1, 2) for t in range(5, 0, -1)]
    long = spark.createDataFrame(rows, "g int, t_k int, phi double, p double, pent double, log_delta double, days double, logit_phi double, delta double, b double")
    # the third set comes in two equal rows
    long = long.unionByName(long.where("g = 2").withColumn("g", F.lit(3))).unionByName(long.where("g = 2").withColumn("g", F.lit(3)))
    one = packed(long, ["g"], cols).localCheckpoint()
    flat = lambda df, c: df.select("g", F.explode("path").alias("z")).select("g", "z.t_k", f"z.{c}")
    from resight.operators import reshape

    pairs = {
        "lambda": (M.lambda_varying(long, ["g"]), M.lambda_varying(one, ["g"])),
        "psi": (M.psi_recursion(long, ["g"]), M.psi_recursion(one, ["g"])),
        "js": (M.js_quantities(long, ["g"]).select("g", "t_k", "tau", "multP"), M.js_quantities(one, ["g"]).select("g", "t_k", "tau", "multP")),
        "ratio": (M.entry_additive_ratio(long, ["g"]).select("g", "t_k", "pent", "phi"), M.entry_additive_ratio(one, ["g"])),
        "days": (M.entry_additive_ratio(long, ["g"], True).select("g", "t_k", "pent", "phi"), M.entry_additive_ratio(one, ["g"], True)),
        "share": (reshape.entry_share(long, ["g"], name="x").select("g", "t_k", "x"), flat(reshape.entry_share(one, ["g"], name="x"), "x")),
        "softmax": (reshape.softmax_share(long, ["g"], name="x").select("g", "t_k", "x"), flat(reshape.softmax_share(one, ["g"], name="x"), "x")),
    }
    for name, (want, got) in pairs.items():
        assert exchanges(got) == (0, 0), name
        order = lambda df: sorted([tuple(-1.0 if v is None else round(v, 9) for v in r) for r in df.collect()])
        assert order(got) == order(want), name


def test_packed_kernels_give_the_long_ones_results_without_a_join(spark):
    score = lambda i, j: F.col("g") * i / 7.0 - 0.2 * j
    keys = spark.createDataFrame([(1, 0.6, 0.5), (2, 0.8, 0.3)], "g int, phi double, p double").localCheckpoint()
    pairs = [(i, j) for i in range(1, 4) for j in range(i, 4)]
    long = keys.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("from_l"), F.lit(j).alias("to_l"), score(i, j).alias("par")) for i, j in pairs])).alias("c")).select("g", "c.*")
    entries = [(t, j, float(t * j)) for t in (1, 2, 3, 4) for j in (1, 2, 3)]
    cells = keys.select("g", F.explode(F.array(*[F.struct(F.lit(t).alias("t_k"), F.lit(j).alias("loc"), F.lit(v).alias("value")) for t, j, v in entries])).alias("c")).select("g", "c.*")
    order = lambda df: sorted([tuple(-9.0 if v is None else round(v, 9) for v in r) for r in df.collect()])
    want = K.movement_forward(K.movement_kernel(long, ["g"]), cells, keys, ["g"], 3)
    assert "BroadcastHashJoin" not in want._jdf.queryExecution().executedPlan().toString()
    row = keys.withColumns({"kernel": K.movement_row(score, 3), "entries": F.array(*[F.lit(v) for _, _, v in entries])})
    got = K.movement_forward_packed(row, ["g"], 3)
    assert exchanges(got) == (0, 0) and order(got) == order(want)

    found = [(i, i, 0.1 * i) for i in (1, 2, 3)] + [(i, 4, 1 - 0.1 * i) for i in (1, 2, 3)] + [(4, 4, 1.0)]
    seen = F.array(*[F.struct(F.lit(i).alias("from_l"), F.lit(j).alias("to_l"), F.lit(v).alias("value")) for i, j, v in found])
    detect = keys.select("g", F.explode(seen).alias("c")).select("g", "c.*")
    want = K.transition_detection(K.row_softmax_transition(long, ["g"], 3), detect, ["g"])
    assert "BroadcastHashJoin" not in want._jdf.queryExecution().executedPlan().toString()
    live = F.array(*[F.struct(F.lit(i).alias("from_l"), F.lit(j).alias("to_l"), F.exp(score(i, j)).alias("e")) for i, j in pairs])
    got = K.transition_detection_packed(keys.select("g", K.softmax_cells(live, 3).alias("transition"), seen.alias("detection")), ["g"])
    assert exchanges(got) == (0, 0) and order(got) == order(want.select(*got.columns))
