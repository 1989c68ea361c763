"""SQL blocks shared by the counterparts: captures, histories, statistics, parameter sets."""

from __future__ import annotations

from resight.catalog.base import cte

cte("ev", "", """
SELECT event_id, user_id, event_type AS grp, value, year(ts) AS t_yr, CAST(ts AS DATE) AS d0,
  CASE WHEN event_type <> 'error' AND datediff('day', CAST(ts AS DATE), CAST(nts AS DATE)) BETWEEN 1 AND 7 THEN CAST(nts AS DATE) END AS d1,
  event_type <> 'error' AS tag, user_id % 5 + 1 AS t_l,
  CASE WHEN event_type <> 'error' AND datediff('day', CAST(ts AS DATE), CAST(nts AS DATE)) BETWEEN 1 AND 7 THEN nid % 5 + 1 END AS r_l
FROM (SELECT *, lead(ts) OVER w AS nts, lead(event_id) OVER w AS nid FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
""")
cte("hist", "ev", """
SELECT t_yr, grp, datediff('day', first, d0) + 1 AS t_k, datediff('day', first, d1) + 1 AS r_k, t_l, r_l, tag, count(*) AS n
FROM (SELECT *, min(d0) OVER (PARTITION BY t_yr) AS first FROM ev) GROUP BY ALL
""")
cte("bounds", "hist", "SELECT t_yr, grp, CAST(max(greatest(t_k, COALESCE(r_k, 0))) AS BIGINT) AS s FROM hist GROUP BY ALL")
cte("slots", "bounds", "SELECT t_yr, grp, s, unnest(range(1, s + 1)) AS t_k FROM bounds")
cte("js", "slots hist", """
SELECT t_yr, grp, t_k, u + m AS seen, mk AS marked, u AS first_seen, rl AS recap_later, m AS recap_now,
  COALESCE(sum(rl - m) OVER (PARTITION BY t_yr, grp ORDER BY t_k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_risk
FROM (SELECT s.t_yr, s.grp, s.t_k,
    COALESCE((SELECT sum(n) FROM hist h WHERE h.t_yr = s.t_yr AND h.grp = s.grp AND h.t_k = s.t_k), 0) AS u,
    COALESCE((SELECT sum(n) FROM hist h WHERE h.t_yr = s.t_yr AND h.grp = s.grp AND h.t_k = s.t_k AND tag), 0) AS mk,
    COALESCE((SELECT sum(n) FROM hist h WHERE h.t_yr = s.t_yr AND h.grp = s.grp AND h.t_k = s.t_k AND tag AND r_k IS NOT NULL), 0) AS rl,
    COALESCE((SELECT sum(n) FROM hist h WHERE h.t_yr = s.t_yr AND h.grp = s.grp AND h.r_k = s.t_k AND tag), 0) AS m
  FROM slots s)
""")
cte("sets", "", """
SELECT c_custkey AS set_id, list_extract(['click','error','purchase','signup','view'], CAST(c_custkey % 5 + 1 AS INTEGER)) AS grp,
  2e-1 + (c_custkey % 100) / 161e0 AS phi, 3e-1 + (c_custkey % 97) / 211e0 AS p, 5e-1 + (c_custkey % 89) / 263e0 AS v, 5e3 + c_acctbal AS nsuper
FROM customer
""")
cte("pp", "sets slots", """
SELECT *, delta / sum(delta) OVER (PARTITION BY t_yr, grp, set_id) AS pent FROM (
  SELECT b.t_yr, a.*, b.s, b.t_k, CAST(1 + (set_id * 7 + t_k * 13) % 11 AS DOUBLE) AS delta FROM sets a JOIN slots b USING (grp))
""")
FACTOR = "(({f} - 1) / ln({f}))"
cte("lam", "pp", "SELECT *, phi * p * (1 - pow(phi * (1 - p), s - t_k)) / (1 - phi * (1 - p)) AS lm FROM pp")
cte("psi", "lam", f"""
SELECT l.*, (SELECT sum(e.pent * CASE WHEN e.t_k = 1 THEN 1 ELSE {FACTOR.format(f='l.phi')} END * pow(l.phi * (1 - l.p), l.t_k - e.t_k))
  FROM lam e WHERE e.t_yr = l.t_yr AND e.grp = l.grp AND e.set_id = l.set_id AND e.t_k <= l.t_k) AS psi FROM lam l
""")
cte("jq", "psi", """
SELECT *, p / (p + (1 - p) * lm) AS tau, psi * p AS temp, psi * p / sum(psi * p) OVER (PARTITION BY t_yr, grp, set_id) AS multP,
  sum(psi * p) OVER (PARTITION BY t_yr, grp, set_id) AS psiPtot FROM psi
""")
# rates varying by period
cte("pv", "pp", """
SELECT t_yr, grp, set_id, s, t_k, pent, delta, phi - 1e-2 * ((set_id + t_k) % 7) AS phi, p + 1e-2 * ((set_id + t_k * 3) % 5) AS p FROM pp
""")
cte("lamv", "pv", """
SELECT t_yr, grp, set_id, s, t_k, phi, p, CAST(0 AS DOUBLE) AS lm FROM pv WHERE t_k = s
UNION ALL
SELECT a.t_yr, a.grp, a.set_id, a.s, a.t_k, a.phi, a.p, a.phi * (b.p + (1 - b.p) * b.lm)
FROM lamv b JOIN pv a ON a.t_yr = b.t_yr AND a.grp = b.grp AND a.set_id = b.set_id AND a.t_k = b.t_k - 1
""")
cte("psiv", "pv", f"""
SELECT t_yr, grp, set_id, t_k, phi, p, pent AS psi FROM pv WHERE t_k = 1
UNION ALL
SELECT a.t_yr, a.grp, a.set_id, a.t_k, a.phi, a.p, b.psi * (1 - b.p) * b.phi + a.pent * {FACTOR.format(f='b.phi')}
FROM psiv b JOIN pv a ON a.t_yr = b.t_yr AND a.grp = b.grp AND a.set_id = b.set_id AND a.t_k = b.t_k + 1
""")
cte("dr", "", """
SELECT year(ts) AS year, CASE user_id % 3 WHEN 0 THEN 'phi' WHEN 1 THEN 'p' ELSE 'nsuper' END AS param, event_type AS method,
  event_id % 4 + 1 AS chain, event_id // 4 AS iter, value FROM events
""")
