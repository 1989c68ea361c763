"""Queries over captures: weeks and locations, counted histories, per-period statistics, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from resight.catalog import blocks, sheets as _sheets  # noqa: F401
from resight.catalog.base import big, cte, num, query
from resight.operators import clean, histories as H, periods, reshape, stats
from resight.plans import views as V
from resight.session import settle

G = ("t_yr", "grp")
GS = "t_yr::BIGINT AS t_yr, grp"


def hist(spark, d):
    return V.event_histories(spark, d)


def both(spark, d):
    h = hist(spark, d)
    return h, V.event_bounds(h)


def captures(spark, d):
    """Line items read as captures with a week and a possible recapture week."""
    o = V.cap_sheets(spark, d)
    return clean.standardize(o, "site")


# ---- period and location rules on captures

cte("orders_cap", "sheets", """
SELECT *, year(day) AS t_yr, (dayofyear(day) - 1) // 7 + 1 AS t_wk, (dayofyear(ship) - 1) // 7 + 1 AS r_wk FROM sheets
""")
cte("weekly", "orders_cap", """
SELECT * FROM (SELECT *, t_wk - min(t_wk) OVER (PARTITION BY t_yr) + 1 AS t_k, r_wk - min(t_wk) OVER (PARTITION BY t_yr) + 1 AS r_k
  FROM orders_cap WHERE t_wk > 10) WHERE r_wk IS NULL OR r_k > 0
""")


@query("period_index_week", "weekly", f"SELECT {big('t_yr', 't_yr')}, {big('t_k', 't_k')}, {big('r_k', 'r_k')}, count(*)::BIGINT AS n FROM weekly GROUP BY ALL")
def _(spark, d):
    return reshape.count_by(clean.period_index_week(captures(spark, d)), ["t_yr", "t_k", "r_k"])


@query("period_index_week_one_year", "weekly", f"SELECT {big('t_k', 't_k')}, {big('r_k', 'r_k')}, count(*)::BIGINT AS n FROM weekly WHERE t_yr = 1998 GROUP BY ALL")
def _(spark, d):
    return reshape.count_by(clean.period_index_week(captures(spark, d), year=1998), ["t_k", "r_k"])


@query("week_rollover", "orders_cap", f"""SELECT {big('CASE WHEN t_wk < 20 THEN t_wk + 52 ELSE t_wk END', 't_wk')}, {big('CASE WHEN r_wk < 20 THEN r_wk + 52 ELSE r_wk END', 'r_wk')}, count(*)::BIGINT AS n
FROM orders_cap GROUP BY ALL""")
def _(spark, d):
    from resight.functions.calendar import week_block

    df = captures(spark, d).select(week_block("Date_Maiden").alias("t_wk"), week_block("Date_Recap").alias("r_wk"))
    return reshape.count_by(clean.roll_weeks(df), ["t_wk", "r_wk"])


def rolled(spark, d):
    from resight.functions.calendar import week_block

    df = captures(spark, d).select(
        F.year("Date_Maiden").alias("t_yr"), week_block("Date_Maiden").alias("t_wk"), week_block("Date_Recap").alias("r_wk"),
        F.col("TagState").alias("t_l"), F.col("RecapState").alias("r_l"), F.col("Tag1").isNotNull().alias("tag"),
    )
    return clean.roll_weeks(df).withColumnsRenamed({"t_wk": "t_k", "r_wk": "r_k"})


ROLLED = """SELECT *, CASE WHEN t_wk < 20 THEN t_wk + 52 ELSE t_wk END AS a, CASE WHEN r_wk < 20 THEN r_wk + 52 ELSE r_wk END AS b FROM orders_cap"""
cte("rolled", "orders_cap", f"SELECT *, min(a) OVER (PARTITION BY t_yr) AS first FROM ({ROLLED})")


@query("rebase_periods", "rolled", f"SELECT {big('t_yr', 't_yr')}, {big('a - first + 1', 't_k')}, {big('b - first + 1', 'r_k')}, count(*)::BIGINT AS n FROM rolled GROUP BY ALL")
def _(spark, d):
    return reshape.count_by(clean.rebase_periods(rolled(spark, d)), ["t_yr", "t_k", "r_k"])


@query("rebase_periods_sequential", "rolled", f"SELECT {big('t_yr', 't_yr')}, {big('a - first + 1', 't_k')}, {big('b', 'r_k')}, count(*)::BIGINT AS n FROM rolled GROUP BY ALL")
def _(spark, d):
    return reshape.count_by(clean.rebase_periods(rolled(spark, d), sequential=True), ["t_yr", "t_k", "r_k"])


@query("upstream_filter", "rolled", f"SELECT {big('TagState', 't_l')}, {big('RecapState', 'r_l')}, count(*)::BIGINT AS n FROM rolled WHERE RecapState IS NULL OR RecapState >= TagState GROUP BY ALL")
def _(spark, d):
    return reshape.count_by(clean.upstream_filter(rolled(spark, d)), ["t_l", "r_l"])


@query("pool_locations", "rolled", f"SELECT 1::BIGINT AS t_l, {big('CASE WHEN RecapState IS NOT NULL THEN 1 END', 'r_l')}, count(*)::BIGINT AS n FROM rolled GROUP BY ALL")
def _(spark, d):
    return reshape.count_by(clean.pool_locations(rolled(spark, d)), ["t_l", "r_l"])


# ---- counted histories

@query("histories", "hist", f"SELECT {GS}, {big('t_k', 't_k')}, {big('r_k', 'r_k')}, {big('t_l', 't_l')}, {big('r_l', 'r_l')}, {big('tag', 'tag')}, {big('n', 'n')} FROM hist")
def _(spark, d):
    return hist(spark, d)


@query("histories_by_period", "rolled", f"SELECT {big('a', 't_k')}, {big('b', 'r_k')}, {big('Tag1 IS NOT NULL', 'tag')}, count(*)::BIGINT AS n FROM rolled GROUP BY ALL")
def _(spark, d):
    return H.histories(rolled(spark, d))


@query("first_detections", "hist slots", f"SELECT {GS}, {big('t_k', 't_k')}, {big('COALESCE((SELECT sum(n) FROM hist h WHERE h.t_yr = s.t_yr AND h.grp = s.grp AND h.t_k = s.t_k), 0)', 'u')} FROM slots s")
def _(spark, d):
    return H.first_detections(*both(spark, d), G)


@query("tag_counts", "hist slots", f"""SELECT s.t_yr::BIGINT AS t_yr, s.grp, s.t_k::BIGINT AS t_k, {big('COALESCE(sum(n), 0)', 'total')}, {big('COALESCE(sum(n) FILTER (tag), 0)', 'tagged')},
{big('COALESCE(sum(n) FILTER (NOT tag), 0)', 'untagged')} FROM slots s LEFT JOIN hist h ON h.t_yr = s.t_yr AND h.grp = s.grp AND h.t_k = s.t_k GROUP BY 1, 2, 3""")
def _(spark, d):
    return H.tag_counts(*both(spark, d), G)


@query("location_shares", "hist", f"SELECT {GS}, {big('t_l', 't_l')}, {big('sum(n)', 'n')}, {num('sum(n) / sum(sum(n)) OVER (PARTITION BY t_yr, grp)', 'sp_pr')} FROM hist GROUP BY t_yr, grp, t_l")
def _(spark, d):
    return H.location_shares(hist(spark, d), G)


@query("count_tensor", "hist slots", f"""SELECT s.t_yr::BIGINT AS t_yr, s.grp, s.t_l::BIGINT AS t_l, s.t_k::BIGINT AS t_k, {big('COALESCE(sum(n), 0)', 'total')}, {big('COALESCE(sum(n) FILTER (tag), 0)', 'tagged')}
FROM (SELECT * FROM slots JOIN (SELECT DISTINCT t_yr, grp, t_l FROM hist) USING (t_yr, grp)) s
LEFT JOIN hist h ON h.t_yr = s.t_yr AND h.grp = s.grp AND h.t_k = s.t_k AND h.t_l = s.t_l GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return H.count_tensor(*both(spark, d), ("t_yr", "grp", "t_l"))


@query("recapture_matrix", "hist", f"SELECT {GS}, {big('t_k', 't_k')}, {big('r_k', 'r_k')}, {big('sum(n)', 'n')} FROM hist WHERE tag GROUP BY t_yr, grp, t_k, r_k")
def _(spark, d):
    return H.recapture_matrix(hist(spark, d), G)


@query("recaps_by_period", "js", f"SELECT {GS}, {big('t_k', 't_k')}, {big('recap_now', 'm')} FROM js")
def _(spark, d):
    return H.recaps_by_period(*both(spark, d), G)


@query("recaps_by_tagging_period", "js", f"SELECT {GS}, {big('t_k', 't_k')}, {big('recap_later', 'm')} FROM js")
def _(spark, d):
    return H.recaps_by_period(*both(spark, d), G, m_by="t_k")


cte("risk", "hist bounds", "SELECT t_yr, grp, unnest(range(t_k, COALESCE(r_k, s) + 1)) AS period, n FROM hist JOIN bounds USING (t_yr, grp) WHERE tag")


@query("expand_at_risk", "risk", f"SELECT {GS}, {big('period', 'period')}, count(*)::BIGINT AS n_rows, {big('sum(n)', 'n')} FROM risk GROUP BY t_yr, grp, period")
def _(spark, d):
    df = H.expand_at_risk(*both(spark, d), G)
    return df.groupBy(*G, "period").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n"))


@query("at_risk", "risk slots", f"SELECT s.t_yr::BIGINT AS t_yr, s.grp, s.t_k::BIGINT AS t_k, {big('COALESCE(sum(n), 0)', 'at_risk')} FROM slots s LEFT JOIN risk e ON e.t_yr = s.t_yr AND e.grp = s.grp AND e.period = s.t_k GROUP BY 1, 2, 3")
def _(spark, d):
    return H.at_risk(*both(spark, d), G)


@query("period_pairs", "slots", "SELECT a.t_yr::BIGINT AS t_yr, a.grp, a.t_k::BIGINT AS t_k, b.t_k::BIGINT AS r_k FROM slots a JOIN slots b ON a.t_yr = b.t_yr AND a.grp = b.grp AND a.t_k < b.t_k")
def _(spark, d):
    return H.period_pairs(both(spark, d)[1], G)


@query("arrival_shares", "hist", f"SELECT {GS}, {big('t_k', 't_k')}, count(*)::BIGINT AS n_rows, {num('count(*) / sum(count(*)) OVER (PARTITION BY t_yr, grp)', 'obs')} FROM hist GROUP BY t_yr, grp, t_k")
def _(spark, d):
    return H.arrival_shares(hist(spark, d), G)


@query("mark_rate", "hist", f"SELECT {GS}, {big('t_k', 't_k')}, {big('COALESCE(sum(n) FILTER (tag), 0)', 'tagged')}, {big('sum(n)', 'n')}, {num('COALESCE(sum(n) FILTER (tag), 0) / sum(n)', 'obs_v')} FROM hist GROUP BY t_yr, grp, t_k")
def _(spark, d):
    return H.mark_rate(hist(spark, d), G)


TO = [f"to_{k}" for k in range(1, 6)] + ["to_none"]
TO_SQL = ", ".join(f"COALESCE(sum(n) FILTER (COALESCE(r_l, 0) = {k}), 0) AS {c}" for k, c in zip([1, 2, 3, 4, 5, 0], TO))


@query("transition_table", "hist", f"SELECT grp, {big('t_l', 't_l')}, {', '.join(big(c, c) for c in TO)}, " + ", ".join(
    f"CAST(round_even(CAST({c} AS DOUBLE) / ({' + '.join(TO)}), 2) AS DOUBLE) AS share_{c}" for c in TO) + f" FROM (SELECT grp, t_l, {TO_SQL} FROM hist WHERE tag GROUP BY 1, 2)")
def _(spark, d):
    return H.transition_table(hist(spark, d), ("grp",), locations=(1, 2, 3, 4, 5))


@query("js_from_histories", "js", f"SELECT {GS}, {', '.join(big(c, c) for c in ('t_k', *stats.STATS))} FROM js")
def _(spark, d):
    return V.event_stats(spark, d)


@query("observed_rates", "js", f"""SELECT {GS}, {big('t_k', 't_k')}, {num('marked / nullif(seen, 0)', 'obs_v')}, {num('recap_now / nullif(at_risk, 0)', 'obs_tau')},
{num('recap_later / nullif(marked, 0)', 'obs_lambda')}, {num('first_seen / sum(first_seen) OVER (PARTITION BY t_yr, grp)', 'obs_multP')} FROM js""")
def _(spark, d):
    return stats.observed_rates(V.event_stats(spark, d))


# ---- grouped statistics held as text

cte("gs", "js", """
SELECT t_yr, grp, DATE '2023-12-31' + CAST(t_k * 2 AS INTEGER) AS date, seen, marked, first_seen, recap_later, recap_now, at_risk - recap_now AS missed_now FROM js
""")
LONG = ("seen", "marked", "first_seen", "recap_later", "recap_now", "missed_now")
cte("cg", "gs", "SELECT t_yr, date, " + ", ".join(f"sum(CASE WHEN grp = 'view' AND '{c}' = 'seen' THEN 0 ELSE {c} END) AS {c}" for c in LONG) + " FROM gs GROUP BY 1, 2")
cte("pi", "cg", """
SELECT *, row_number() OVER (PARTITION BY t_yr ORDER BY date) AS t_k, missed_now + recap_now AS at_risk, datediff('day', lag(date) OVER (PARTITION BY t_yr ORDER BY date), date) AS days FROM cg
""")


def group_stats(spark, d):
    """Per-group statistics as text, the way they are stored; one group's counts are unreadable."""
    df = V.event_stats(spark, d).withColumn("missed_now", F.col("at_risk") - F.col("recap_now"))
    df = df.withColumn("date", F.date_add(F.lit("2023-12-31").cast("date"), (F.col("t_k") * 2).cast("int")).cast("string"))
    text = {c: F.col(c).cast("string") for c in LONG}
    text["seen"] = F.when(F.col("grp") == "view", "n/a").otherwise(text["seen"])
    return df.select("t_yr", "grp", "date", *[v.alias(c) for c, v in text.items()])


def collapsed(spark, d):
    return stats.collapse_groups(group_stats(spark, d), ("t_yr",))


@query("collapse_groups", "cg", f"SELECT t_yr::BIGINT AS t_yr, CAST(date AS VARCHAR) AS date, {', '.join(num(c, c) for c in LONG)} FROM cg")
def _(spark, d):
    return collapsed(spark, d)


@query("js_inputs", "pi", f"""SELECT t_yr::BIGINT AS t_yr, count(*)::BIGINT AS s, {num('sum(first_seen)', '"uTot"')}, {num('sum(first_seen)', '"LL"')}, {num('sum(first_seen) * 20', '"UL"')},
{num('avg(days)', 'mean_days')}, {num('ln(exp(ln(0.5) / avg(days)) / (1 - exp(ln(0.5) / avg(days))))', 'logit_phi_1_mu_prior')} FROM pi GROUP BY t_yr""")
def _(spark, d):
    return stats.js_inputs(collapsed(spark, d), ("t_yr",))


@query("period_inputs", "pi", f"SELECT t_yr::BIGINT AS t_yr, CAST(date AS VARCHAR) AS date, {', '.join(num(c, c) for c in LONG)}, {big('t_k', 't_k')}, {num('at_risk', 'at_risk')}, {big('days', 'days')} FROM pi")
def _(spark, d):
    return stats.period_inputs(collapsed(spark, d), ("t_yr",))


@query("survey_gaps", "dates_all", f"SELECT {big('Year', 'Year')}, CAST(Date AS VARCHAR) AS Date, {big('datediff(' + chr(39) + 'day' + chr(39) + ', lag(Date) OVER (PARTITION BY Year ORDER BY Date), Date)', 'days')} FROM dates_all")
def _(spark, d):
    from resight.catalog.sheets import everything

    return periods.survey_gaps(periods.union_dates(everything(spark, d)), "Date", ("Year",))


GOOD = "SELECT t_yr, grp, t_k, '{v}' AS vector FROM (SELECT *, max(t_k) OVER (PARTITION BY t_yr, grp) AS s FROM js) WHERE {c}"


@query("good_periods", "js", f"""SELECT {GS}, {big('t_k', 't_k')}, vector, {big('row_number() OVER (PARTITION BY t_yr, grp, vector ORDER BY t_k)', 'pos')}, count(*) OVER (PARTITION BY t_yr, grp, vector)::BIGINT AS n_good
FROM ({GOOD.format(v='T', c='at_risk > 0 AND t_k BETWEEN 2 AND s - 1')} UNION ALL {GOOD.format(v='R', c='marked > 0 AND t_k <= s - 1')})""")
def _(spark, d):
    return stats.good_periods(V.event_stats(spark, d), G)


@query("pool_strata", "js", " UNION ALL ".join(f"SELECT '{c}' AS section, {big('t_k', 'row')}, {num(f'sum({c})', 'value')} FROM js GROUP BY t_k" for c in stats.STATS))
def _(spark, d):
    cells = V.event_stats(spark, d).unpivot(["grp", "t_k"], list(stats.STATS), "section", "value").withColumnRenamed("t_k", "row")
    return stats.pool_strata(cells.withColumn("value", F.col("value").cast("double")))


# ---- shares, totals, shapes

@query("group_total", "hist", f"SELECT {GS}, {big('t_k', 't_k')}, {big('r_k', 'r_k')}, {big('t_l', 't_l')}, {big('r_l', 'r_l')}, {big('tag', 'tag')}, {big('n', 'n')}, {big('sum(n) OVER (PARTITION BY t_yr, t_k, t_l, tag)', 't_k_total')} FROM hist")
def _(spark, d):
    return H.obs_in_total(hist(spark, d))


@query("group_id", "sheets", f"SELECT Return_Yr, Sex, {big('dense_rank() OVER (ORDER BY Return_Yr, Sex NULLS FIRST) - 1', 'grp')}, count(*)::BIGINT AS n FROM sheets GROUP BY Return_Yr, Sex")
def _(spark, d):
    return reshape.count_by(reshape.group_id(V.cap_sheets(spark, d), ["Return_Yr", "Sex"]), ["Return_Yr", "Sex", "grp"])


@query("entry_share", "pp", f"SELECT {GS}, {big('set_id', 'set_id')}, {big('t_k', 't_k')}, {num('pent', 'pent')} FROM pp")
def _(spark, d):
    paths = V.period_paths(spark, d)
    paths = paths.withColumn("path", F.transform("path", lambda x: x.dropFields("pent")))
    shares = reshape.entry_share(paths, [*G, "set_id"])
    return shares.select(*G, "set_id", F.explode("path").alias("z")).select(*G, "set_id", "z.t_k", "z.pent")


@query("softmax_share", "hist", f"SELECT {GS}, {big('t_l', 't_l')}, {num('exp(b) / sum(exp(b)) OVER (PARTITION BY t_yr, grp)', 'share')} FROM (SELECT t_yr, grp, t_l, CASE WHEN t_l = 5 THEN 0 ELSE ln(sum(n)) / 3 END AS b FROM hist GROUP BY 1, 2, 3)")
def _(spark, d):
    b = F.when(F.col("t_l") == 5, 0.0).otherwise(F.log("n") / 3)
    return reshape.softmax_share(H.location_shares(hist(spark, d), G).withColumn("b", b), G).select(*G, "t_l", "share")


@query("head", "hist", f"SELECT {GS}, {big('t_k', 't_k')}, {big('r_k', 'r_k')}, {big('n', 'n')} FROM (SELECT t_yr, grp, t_k, r_k, sum(n) AS n FROM hist GROUP BY ALL) ORDER BY t_yr, grp, t_k, r_k NULLS FIRST LIMIT 6")
def _(spark, d):
    h = hist(spark, d).groupBy(*G, "t_k", "r_k").agg(F.sum("n").alias("n"))
    return reshape.head(h, [*G, "t_k", "r_k"])


@query("mode_of", "js", f"SELECT {GS}, {big('arg_max(t_k, first_seen * 1000 - t_k)', 'mode')} FROM js GROUP BY t_yr, grp")
def _(spark, d):
    return reshape.mode_of(V.event_stats(spark, d), G, "t_k", "first_seen")


@query("append", "js", f"SELECT grp, {big('seen', 'seen')}, {big('t_k', 't_k')} FROM js UNION ALL SELECT 'Total', {big('sum(seen)', 'seen')}, NULL FROM js")
def _(spark, d):
    st = settle(V.event_stats(spark, d))
    total = st.agg(F.sum("seen").alias("seen")).withColumn("grp", F.lit("Total"))
    return reshape.append(st.select("grp", "t_k", "seen"), total)


@query("to_long", "js", " UNION ALL ".join(f"SELECT grp, {big('t_k', 't_k')}, '{c}' AS variable, {big(c, 'value')} FROM js" for c in ("seen", "marked")))
def _(spark, d):
    return reshape.to_long(V.event_stats(spark, d), ["grp", "t_k"], ["seen", "marked"])


@query("to_wide", "hist", f"SELECT {big('t_k', 't_k')}, {', '.join(big(f'COALESCE(sum(n) FILTER (grp = {chr(39)}{g}{chr(39)}), 0)', g) for g in V.GROUPS)} FROM hist GROUP BY t_k")
def _(spark, d):
    return reshape.to_wide(hist(spark, d), ["t_k"], "grp", V.GROUPS, "n", fill=0)


@query("melt_array", "js", f"SELECT grp, {big('t_k', 'dim1')}, {big('i', 'dim2')}, {big('CASE i WHEN 1 THEN seen ELSE marked END', 'value')} FROM js, (SELECT unnest([1, 2]) AS i)")
def _(spark, d):
    arr = V.event_stats(spark, d).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("t_k", F.array("seen", "marked").alias("v")))).alias("a"))
    return reshape.melt_array(arr.withColumn("a", F.transform("a", lambda x: x["v"])), ["grp"], "a", 2)


@query("complete", "hist slots", f"SELECT s.t_yr::BIGINT AS t_yr, s.grp, s.t_k::BIGINT AS t_k, {big('COALESCE(sum(n), 0)', 'n')} FROM slots s LEFT JOIN hist h ON h.t_yr = s.t_yr AND h.grp = s.grp AND h.t_k = s.t_k GROUP BY 1, 2, 3")
def _(spark, d):
    h, b = both(spark, d)
    return reshape.complete(h.groupBy(*G, "t_k").agg(F.sum("n").alias("n")), b, G, fill={"n": 0})


@query("nonzero_cells", "hist slots", f"""SELECT a.t_yr::BIGINT AS t_yr, a.grp, a.t_k::BIGINT AS t_k, b.t_k::BIGINT AS r_k, {big('(SELECT nullif(COALESCE(sum(n), 0), 0) FROM hist h WHERE h.grp = a.grp AND h.t_yr = a.t_yr AND h.t_k = a.t_k AND h.r_k = b.t_k)', 'value')}
FROM slots a JOIN slots b ON a.t_yr = b.t_yr AND a.grp = b.grp AND a.t_k < b.t_k""")
def _(spark, d):
    h, b = both(spark, d)
    r = H.recapture_matrix(h, G).withColumnRenamed("n", "value")
    full = H.period_pairs(b, G).join(r, [*G, "t_k", "r_k"], "left").na.fill(0, ["value"])
    return reshape.nonzero_cells(full, "value", "t_k", "r_k")
