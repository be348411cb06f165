"""DuckDB SQL of the registered queries, written apart from the operators."""

from __future__ import annotations

Z = "1.6448536269514722"
AS_OF = "DATE '2001-01-01'"

ORDERS = """o AS (SELECT o_orderstatus AS benchmark_id, o_orderkey AS model, o_orderdate::DATE AS date, o_totalprice AS score,
  ((o_orderkey % 5) * 100.0)::DOUBLE AS score_std, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_laggard FROM orders)"""
EVENTS = """o AS (SELECT event_type AS benchmark_id, event_id AS model, ts::DATE AS date, value AS score, NULL::DOUBLE AS score_std,
  user_id % 2 = 0 AS is_laggard FROM events)"""


def discounts(times: str, name: str = "o", benchmark: str = "l_returnflag") -> str:
    return f"{name} AS (SELECT {benchmark} AS benchmark_id, l_orderkey AS model, l_shipdate::DATE AS date, l_discount * {times} AS score, NULL::DOUBLE AS score_std, l_linestatus = 'O' AS is_laggard FROM lineitem)"


RANKED = """p AS (SELECT *, max(score) OVER (PARTITION BY benchmark_id, is_laggard ORDER BY date, score DESC, model
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)"""
FRONT = RANKED + ", f AS (SELECT * EXCLUDE before FROM p WHERE before IS NULL OR score >= before)"
RECORDS = RANKED + ", r AS (SELECT * EXCLUDE before FROM p WHERE before IS NULL OR score > before)"


def caught(a: str, a_std: str, b: str, b_std: str, tolerance: str = "1.0") -> str:
    return f"CASE WHEN {a_std} IS NOT NULL AND {b_std} IS NOT NULL AND ({a_std} > 0 OR {b_std} > 0) THEN {b} - {a} <= {Z} * sqrt({a_std} * {a_std} + {b_std} * {b_std}) ELSE {a} >= {b} - {tolerance} END"


def gaps(std: str = "score_std") -> str:
    """g: the first catch-up of each leader on the frontier f."""
    return f""", s AS (SELECT benchmark_id, model, date, score, {std} AS std, is_laggard FROM f),
pairs AS (SELECT l.benchmark_id, l.model AS lead_model, l.date AS lead_date, l.score AS lead_score, g.model AS lag_model, g.date AS lag_date, g.score AS lag_score,
  CASE WHEN g.std IS NOT NULL AND l.std IS NOT NULL AND (g.std > 0 OR l.std > 0) THEN 'analytical' ELSE 'threshold' END AS match_type
  FROM s l LEFT JOIN s g ON g.is_laggard AND g.benchmark_id = l.benchmark_id AND g.date > l.date AND {caught("g.score", "g.std", "l.score", "l.std")}
  WHERE NOT l.is_laggard),
first AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY benchmark_id, lead_model ORDER BY lag_date NULLS LAST, lag_score DESC, lag_model) = 1),
g AS (SELECT benchmark_id, lead_model, lead_date, lead_score, lag_model, lag_date, lag_score, date_diff('day', lead_date, coalesce(lag_date, {AS_OF}))::BIGINT AS gap_days,
  date_diff('day', lead_date, coalesce(lag_date, {AS_OF})) / 30.4375::DOUBLE AS gap_months, lag_date IS NOT NULL AS matched, CASE WHEN lag_date IS NOT NULL THEN match_type END AS match_type FROM first)"""


def drawn(a: str, b: str, caught_: str) -> str:
    """Whether table a's record has caught up with b's, by paired draws where both have them."""
    share = f"list_sum(list_transform(range(1, len({a}.draws) + 1), lambda i: CASE WHEN {a}.draws[i] > {b}.draws[i] THEN 1.0 ELSE 0.0 END)) / len({a}.draws)"
    return f"CASE WHEN {a}.draws IS NOT NULL AND {b}.draws IS NOT NULL THEN {share} >= 0.05 ELSE {caught_} END"


#: Adds draws to the records of p (and so of f and r).
WITH_DRAWS = RANKED.replace("FROM o)", "FROM o LEFT JOIN (SELECT vec_id, embedding::DOUBLE[] AS draws FROM embeddings) ON o.model % 101 = vec_id)")

GAP_COLUMNS = "benchmark_id, lead_model, lead_date, lead_score, lag_model, lag_date, lag_score, gap_days, round(gap_months, 6) AS gap_months, matched, match_type"


def daily(start: str | None = None, end: str | None = None) -> str:
    """d: the daily gaps of the frontier f."""
    ws = start or "greatest((SELECT min(date) FROM f x WHERE x.benchmark_id = b.benchmark_id AND x.is_laggard), (SELECT min(date) FROM f x WHERE x.benchmark_id = b.benchmark_id AND NOT x.is_laggard))"
    we = end or "(SELECT max(date) FROM f x WHERE x.benchmark_id = b.benchmark_id)"
    return f""", b AS (SELECT DISTINCT benchmark_id FROM f),
w AS (SELECT benchmark_id, {ws} AS ws, {we} AS we FROM b),
days AS (SELECT benchmark_id, unnest(generate_series(ws::TIMESTAMP, we::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM w),
lag AS (SELECT days.benchmark_id, day, model, score, score_std FROM days JOIN f ON f.benchmark_id = days.benchmark_id AND f.is_laggard AND f.date <= day
  QUALIFY row_number() OVER (PARTITION BY days.benchmark_id, day ORDER BY score DESC, date, model) = 1),
rec AS (SELECT benchmark_id, date, score, score_std FROM p WHERE NOT is_laggard AND (before IS NULL OR score > before)),
x AS (SELECT lag.benchmark_id, lag.day, lag.model AS lag_model, lag.score AS lag_score, max(rec.date) FILTER ({caught("lag.score", "lag.score_std", "rec.score", "rec.score_std")}) AS ref,
  max(rec.date) FILTER (lag.score > rec.score) AS ref_strict, min(rec.date) AS first, max(rec.score) AS best
  FROM lag JOIN rec ON rec.benchmark_id = lag.benchmark_id AND rec.date <= lag.day GROUP BY ALL),
d AS (SELECT benchmark_id, day, lag_model, date_diff('day', coalesce(ref, first), day) / 30.4375::DOUBLE AS gap_months, date_diff('day', coalesce(ref_strict, first), day) / 30.4375::DOUBLE AS strict_months,
  greatest(best, lag_score) - lag_score AS vertical FROM x)"""


METRICS = """, m AS (SELECT benchmark_id, avg(gap_months) AS avg_gap_months, avg(strict_months) AS avg_strict_months, coalesce(stddev_samp(gap_months), 0) AS gap_std, avg(vertical) AS avg_vertical,
  min(day) AS window_start, max(day) AS window_end, count(*) AS n_days, quantile_cont(gap_months, 0.05) AS gap_low, quantile_cont(gap_months, 0.95) AS gap_high,
  quantile_cont(vertical, 0.05) AS vertical_low, quantile_cont(vertical, 0.95) AS vertical_high FROM d GROUP BY benchmark_id)"""
METRIC_COLUMNS = "benchmark_id, round(avg_gap_months, 6) AS avg_gap_months, round(avg_strict_months, 6) AS avg_strict_months, round(gap_std, 6) AS gap_std, round(avg_vertical, 6) AS avg_vertical, window_start, window_end, n_days, round(gap_low, 6) AS gap_low, round(gap_high, 6) AS gap_high, round(vertical_low, 6) AS vertical_low, round(vertical_high, 6) AS vertical_high"

GRID = """bounds AS (SELECT benchmark_id, greatest(min(score), 0.0) AS low, max(score) AS high FROM o GROUP BY benchmark_id),
grid AS (SELECT benchmark_id, CASE WHEN high <= 1.05 THEN i * 0.05::DOUBLE WHEN high <= 110 THEN i * 5.0::DOUBLE ELSE low + i * ((high - low) / 20) END AS threshold FROM bounds, (SELECT unnest(generate_series(1, 19)) AS i))"""
FLOOR = "fl AS (SELECT benchmark_id, quantile_cont(score, 0.1) AS floor FROM o GROUP BY benchmark_id)"
POINTS = f"""WITH {ORDERS}, {GRID}, {FLOOR},
hits AS (SELECT grid.benchmark_id, threshold, model, date, is_laggard FROM grid JOIN o ON o.benchmark_id = grid.benchmark_id AND score >= threshold
  QUALIFY row_number() OVER (PARTITION BY grid.benchmark_id, threshold, is_laggard ORDER BY date, score DESC, model) = 1),
two AS (SELECT c.benchmark_id, c.threshold, floor, c.model AS lead_model, c.date AS lead_date, h.model AS lag_model, h.date AS lag_date FROM hits c JOIN fl ON fl.benchmark_id = c.benchmark_id
  LEFT JOIN hits h ON h.is_laggard AND h.benchmark_id = c.benchmark_id AND h.threshold = c.threshold WHERE NOT c.is_laggard),
v AS (SELECT *, date_diff('day', lead_date, lag_date)::BIGINT AS gap_days, date_diff('day', lead_date, lag_date) / 30.4375::DOUBLE AS gap_months,
  CASE WHEN lag_model IS NULL THEN date_diff('day', lead_date, {AS_OF}) / 30.4375::DOUBLE END AS gap_months_so_far, lag_model IS NOT NULL AND threshold > floor AS valid, lag_model IS NULL AS still_open FROM two),
t AS (SELECT *, NOT still_open AND bool_or(valid) OVER (PARTITION BY benchmark_id, lead_model, lag_model) AND threshold = max(threshold) OVER (PARTITION BY benchmark_id, lead_model, lag_model) AS accepted FROM v)"""

X = "date_diff('day', DATE '2000-01-01', date)::DOUBLE"


def trend(source: str, by: str, bent: str = "CASE WHEN score > 0 THEN ln(CASE WHEN score > 0 THEN score END) END", bounded: bool = False) -> str:
    """Growth figures per group of a relation with date and score."""
    k = "CASE WHEN bent_days >= 2 THEN bent_slope * 365.25 ELSE 0 END"
    rest = f"NULL::DOUBLE AS percent_per_year, NULL::DOUBLE AS multiple_per_year, NULL::DOUBLE AS doubling_years, round(bent_slope * 365.25, 4) AS logit_per_year" if bounded else f"round((exp({k}) - 1) * 100, 4) AS percent_per_year, round(exp({k}), 4) AS multiple_per_year, round(CASE WHEN {k} > 0 THEN ln(2.0) / ({k}) END, 4) AS doubling_years, NULL::DOUBLE AS logit_per_year"
    return f"""y AS (SELECT {by}, {X} AS x, date, score, {bent} AS bent FROM {source}),
z AS (SELECT {by}, count(*) AS n, regr_slope(score, x) AS slope, avg(x) AS ax, avg(score) AS ay, count(DISTINCT x) AS days, regr_slope(bent, x) AS bent_slope, count(DISTINCT x) FILTER (bent IS NOT NULL) AS bent_days, count(bent) AS bent_n,
  min(date) AS start_date, max(date) AS end_date FROM y GROUP BY {by})
SELECT {by}, n, round(slope * 365.25, 4) AS absolute_per_year, {rest}, start_date, round(ay + slope * ({X.replace("date)", "start_date)")} - ax), 4) AS start_score, end_date, round(ay + slope * ({X.replace("date)", "end_date)")} - ax), 4) AS end_score FROM z WHERE days >= 2 AND bent_n > 0"""


def periods(cut: str, least: int, wide: str) -> str:
    return f"""a AS (SELECT benchmark_id, min(date) AS lo, max(date) AS hi, count(*) AS c FROM o GROUP BY benchmark_id),
c AS (SELECT a.*, {cut} AS cut FROM a),
k AS (SELECT o.*, CASE WHEN date < cut THEN 'early' ELSE 'recent' END AS period, count(*) FILTER (date < cut) OVER (PARTITION BY o.benchmark_id) AS ne, count(*) FILTER (date >= cut) OVER (PARTITION BY o.benchmark_id) AS nr, lo, hi, c.c AS c, cut FROM o JOIN c USING (benchmark_id)),
q AS (SELECT benchmark_id, date, score, 'overall' AS period FROM o UNION ALL SELECT benchmark_id, date, score, period FROM k WHERE date_diff('day', lo, hi) > 365 AND {wide} AND ne >= {least} AND nr >= {least})"""


def trend_gap(transform: str) -> str:
    return f"""WITH {ORDERS}, {FRONT}, y AS (SELECT benchmark_id, is_laggard, {X} AS x, {transform} AS y FROM f),
z AS (SELECT benchmark_id, regr_slope(y, x) FILTER (is_laggard) AS ms, avg(x) FILTER (is_laggard) AS xs, avg(y) FILTER (is_laggard) AS ys, count(*) FILTER (is_laggard) AS ns, count(DISTINCT x) FILTER (is_laggard) AS ds,
  regr_slope(y, x) FILTER (NOT is_laggard) AS ml, avg(x) FILTER (NOT is_laggard) AS xl, avg(y) FILTER (NOT is_laggard) AS yl, count(*) FILTER (NOT is_laggard) AS nl, count(DISTINCT x) FILTER (NOT is_laggard) AS dl,
  max(x) AS now, max(y) FILTER (NOT is_laggard) AS best FROM y GROUP BY benchmark_id),
c AS (SELECT *, ys + ms * (now - xs) AS level, CASE WHEN ms > 0 THEN xs + (best - ys) / ms END AS cross_x FROM z WHERE ns >= 3 AND nl >= 3 AND ds >= 2 AND dl >= 2 AND ml > 0),
e AS (SELECT *, (cross_x - now) / 30.4375::DOUBLE AS fwd FROM c)
SELECT benchmark_id, ns AS n_laggard, nl AS n_leader, round(ms * 365.25, 4) AS laggard_per_year, round(ml * 365.25, 4) AS leader_per_year, round((now - (xl + (level - yl) / ml)) / 30.4375::DOUBLE, 4) AS backward_months,
  round((1 - ms / ml) * 12, 4) AS change_months_per_year, round(CASE WHEN fwd <= 240 THEN fwd END, 4) AS forward_months, CASE WHEN fwd <= 240 THEN DATE '2000-01-01' + round(cross_x)::INTEGER END AS catchup_date FROM e"""


def bracket(source: str, t: str, ok: str = "true") -> str:
    tf = lambda c: t.replace("score", c)
    return f"""WITH {source}, {FRONT}, q AS (SELECT * FROM f WHERE {ok}),
now AS (SELECT benchmark_id, max(date) AS now FROM q GROUP BY benchmark_id),
best AS (SELECT benchmark_id, model, score FROM q WHERE is_laggard QUALIFY row_number() OVER (PARTITION BY benchmark_id ORDER BY score DESC, date, model) = 1),
rec AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY benchmark_id ORDER BY date, score DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4 FROM q WHERE NOT is_laggard) WHERE b4 IS NULL OR score > b4),
j AS (SELECT best.benchmark_id, best.model AS lag_model, best.score AS lag_score, arg_max(rec.model, rec.score) FILTER (rec.score <= best.score) AS below_model, arg_max(rec.date, rec.score) FILTER (rec.score <= best.score) AS below_date, max(rec.score) FILTER (rec.score <= best.score) AS below_score,
  arg_min(rec.model, rec.score) FILTER (rec.score > best.score) AS above_model, arg_min(rec.date, rec.score) FILTER (rec.score > best.score) AS above_date, min(rec.score) FILTER (rec.score > best.score) AS above_score
  FROM best JOIN rec ON rec.benchmark_id = best.benchmark_id GROUP BY ALL),
e AS (SELECT j.*, now, least(greatest(({tf("lag_score")} - {tf("below_score")}) / ({tf("above_score")} - {tf("below_score")}), 0), 1) AS share FROM j JOIN now USING (benchmark_id))
SELECT benchmark_id, lag_model, lag_score, above_model IS NULL AS laggard_leads, below_model IS NULL AND above_model IS NOT NULL AS censored, below_model, above_model,
  round(CASE WHEN above_model IS NULL THEN 0 ELSE date_diff('day', above_date, now) / 30.4375::DOUBLE END, 6) AS under_months, round(CASE WHEN above_model IS NULL THEN 0 ELSE date_diff('day', below_date, now) / 30.4375::DOUBLE END, 6) AS over_months,
  round(CASE WHEN above_model IS NULL THEN 0 ELSE floor(date_diff('day', below_date, now) - date_diff('day', below_date, above_date) * share) / 30.4375::DOUBLE END, 6) AS central_months FROM e"""


def phi(z: str) -> str:
    """The same published approximation of the normal distribution function."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * {x}))"
    poly = f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))))"
    return f"(CASE WHEN {z} >= 0 THEN 1.0::DOUBLE - 0.5::DOUBLE * {poly} * exp(-{x} * {x}) ELSE 0.5::DOUBLE * {poly} * exp(-{x} * {x}) END)"


def current(prior_filter: str = "true") -> str:
    return f"""WITH {ORDERS}, {FRONT}{gaps()}, fm AS (SELECT benchmark_id, min(lag_date) AS first_match FROM g WHERE matched GROUP BY benchmark_id),
h AS (SELECT g.*, matched AND ({prior_filter}) AS m FROM g LEFT JOIN fm USING (benchmark_id)),
pool AS (SELECT benchmark_id, count(*) FILTER (m) AS nm, count(*) FILTER (m AND gap_months > 0) AS np, quantile_cont(gap_months, 0.75) FILTER (m) AS p75, quantile_cont(gap_months, 0.75) FILTER (m AND gap_months > 0) AS p75p,
  avg(ln(CASE WHEN gap_months > 0 THEN gap_months END)) FILTER (m AND gap_months > 0) AS mu, greatest(stddev_samp(ln(CASE WHEN gap_months > 0 THEN gap_months END)) FILTER (m AND gap_months > 0), 0.1) AS sigma,
  max(gap_months) FILTER (NOT matched) AS oldest, count(*) FILTER (NOT matched) AS n_unmatched FROM h GROUP BY benchmark_id),
e AS (SELECT g.benchmark_id, gap_months AS c, exp(mu + sigma * sigma / 2) AS pm, (ln(gap_months) - mu) / sigma AS z1, (mu + sigma * sigma - ln(gap_months)) / sigma AS z2 FROM g JOIN pool USING (benchmark_id) WHERE NOT matched AND gap_months > 0),
e2 AS (SELECT benchmark_id, c, pm, 1.0::DOUBLE - {phi("z1")} AS s, {phi("z2")} AS u FROM e),
avg_e AS (SELECT benchmark_id, sum(CASE WHEN s < 1e-10 THEN 2 * c ELSE pm * u / s END * c) / sum(c) AS average, max(pm) AS pm FROM e2 GROUP BY benchmark_id),
q AS (SELECT pool.*, average, pm FROM pool LEFT JOIN avg_e USING (benchmark_id))
SELECT benchmark_id, round(CASE WHEN oldest IS NULL THEN 0 WHEN nm < 3 THEN coalesce(greatest(oldest, CASE WHEN p75 IS NULL THEN oldest * 1.5 ELSE p75 END), oldest * 1.5) WHEN np < 3 THEN greatest(oldest, CASE WHEN p75p IS NULL THEN oldest * 1.5 ELSE p75p END) ELSE greatest(average, oldest) END, 4) AS estimated_gap,
  round(coalesce(oldest, 0), 4) AS min_gap, CASE WHEN oldest IS NULL THEN 'high' WHEN nm < 3 OR np < 3 OR average IS NULL THEN 'low' WHEN oldest / pm < 1.5 THEN 'high' WHEN oldest / pm < 2.5 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN oldest IS NULL THEN 'no_unmatched' WHEN nm < 3 THEN 'insufficient_data_heuristic' WHEN np < 3 THEN 'insufficient_positive_data' ELSE 'survival_analysis_mle' END AS method, n_unmatched FROM q"""


DRAWS = """v AS (SELECT label, vec_id AS a, embedding::DOUBLE[] AS x, lead(vec_id) OVER w AS b, lead(embedding::DOUBLE[]) OVER w AS y FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
pr AS (SELECT a, b, list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] > y[i] THEN 1.0 ELSE 0.0 END)) / len(x) AS p FROM v WHERE b IS NOT NULL)"""

RECORD_COLUMNS = "benchmark_id, is_laggard, model, date, score"

SQL: dict[str, str] = {
    "cumulative_rank_events": f"WITH {EVENTS}, q AS (SELECT *, row_number() OVER (PARTITION BY benchmark_id, is_laggard ORDER BY date NULLS LAST, score DESC, model) AS t FROM o) SELECT a.benchmark_id, a.model, CASE WHEN a.score IS NOT NULL THEN (SELECT count(*) FROM q b WHERE b.benchmark_id = a.benchmark_id AND b.is_laggard = a.is_laggard AND b.t < a.t AND b.score > a.score) + 1 END AS rank FROM q a",
    "cumulative_rank_top_n": f"WITH {EVENTS}, q AS (SELECT *, row_number() OVER (PARTITION BY benchmark_id, is_laggard ORDER BY date NULLS LAST, score DESC, model) AS t FROM o), r AS (SELECT a.benchmark_id, a.model, (SELECT count(*) FROM q b WHERE b.benchmark_id = a.benchmark_id AND b.is_laggard = a.is_laggard AND b.t < a.t AND b.score > a.score) + 1 AS rank FROM q a WHERE score IS NOT NULL) SELECT * FROM r WHERE rank <= 3",
    "frontier_with_ties": f"WITH {ORDERS}, {FRONT} SELECT {RECORD_COLUMNS} FROM f",
    "frontier_events": f"WITH {EVENTS}, {FRONT} SELECT {RECORD_COLUMNS} FROM f",
    "strict_records_orders": f"WITH {ORDERS}, {RECORDS} SELECT {RECORD_COLUMNS} FROM r",
    "records_since_baseline": f"WITH {ORDERS}, {RECORDS} SELECT {RECORD_COLUMNS} FROM r WHERE date >= DATE '1995-06-01'",
    "best_variant_per_key": "SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1",
    "argmax_first_tie": "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) = 1",
    "first_catchup_analytical": f"WITH {ORDERS}, {FRONT}{gaps()} SELECT {GAP_COLUMNS} FROM g",
    "first_catchup_threshold": f"WITH {ORDERS}, {FRONT}{gaps('NULL::DOUBLE')} SELECT {GAP_COLUMNS} FROM g",
    "unmatched_age": f"WITH {ORDERS}, {FRONT}{gaps()} SELECT benchmark_id, lead_model, gap_days, round(gap_months, 6) AS gap_months FROM g WHERE NOT matched",
    "match_counts": f"WITH {ORDERS}, {FRONT}{gaps()} SELECT benchmark_id, count(*) FILTER (matched) AS n_matched, count(*) FILTER (NOT matched) AS n_unmatched, bool_or(match_type = 'analytical') AS any_analytical FROM g GROUP BY benchmark_id",
    "frontier_match_pairs": f"WITH {ORDERS}, {RECORDS}, j AS (SELECT g.benchmark_id, g.model AS lag_model, l.model AS lead_model, l.date FROM r g LEFT JOIN r l ON NOT l.is_laggard AND l.benchmark_id = g.benchmark_id AND {caught('l.score', 'l.score_std', 'g.score', 'g.score_std')} WHERE g.is_laggard) SELECT benchmark_id, lag_model, lead_model FROM j QUALIFY row_number() OVER (PARTITION BY benchmark_id, lag_model ORDER BY date NULLS LAST) = 1",
    "frontier_match_map": f"WITH {ORDERS}, {RECORDS}, j AS (SELECT g.benchmark_id, g.model, bool_or(l.model IS NOT NULL) AS hit FROM r g LEFT JOIN r l ON NOT l.is_laggard AND l.benchmark_id = g.benchmark_id AND {caught('l.score', 'l.score_std', 'g.score', 'g.score_std')} WHERE g.is_laggard GROUP BY ALL) SELECT benchmark_id, count(*) AS n_laggards, count(*) FILTER (hit) AS n_matched FROM j GROUP BY benchmark_id",
    "paired_probability": f"WITH {DRAWS} SELECT a, b, round(p, 6) AS probability FROM pr",
    "caught_up_draws": f"WITH {DRAWS} SELECT a, b, p >= 0.05 AS caught, 'bootstrap' AS method FROM pr",
    "matched_semi": f"WITH {ORDERS}, {FRONT}{gaps()} SELECT benchmark_id, model, date, score FROM f WHERE NOT is_laggard AND EXISTS (SELECT 1 FROM g WHERE g.benchmark_id = f.benchmark_id AND g.lead_model = f.model AND matched)",
    "unmatched_semi": f"WITH {ORDERS}, {FRONT}{gaps()} SELECT benchmark_id, model, date, score FROM f WHERE NOT is_laggard AND EXISTS (SELECT 1 FROM g WHERE g.benchmark_id = f.benchmark_id AND g.lead_model = f.model AND NOT matched)",
    "unmatched_anti": f"WITH {ORDERS} SELECT benchmark_id, count(*) AS n, round(sum(score), 2) AS total FROM o GROUP BY benchmark_id",
    "nearest_event": f"WITH {ORDERS}, {FRONT} SELECT a.benchmark_id, a.model, a.date, b.model AS event_model, b.date AS event_date FROM f a LEFT JOIN f b ON b.benchmark_id = a.benchmark_id AND NOT b.is_laggard WHERE a.is_laggard QUALIFY row_number() OVER (PARTITION BY a.benchmark_id, a.model ORDER BY abs(date_diff('day', a.date, b.date)), b.date, b.model) = 1",
    "prev_gap": f"WITH {ORDERS}, {FRONT}{gaps()} SELECT benchmark_id, lead_model, round(gap_months, 6) AS gap_months, round(lag(gap_months) OVER (PARTITION BY benchmark_id ORDER BY lead_date, lead_model), 6) AS prev_gap_months FROM g",
    "step_vertices": f"WITH {ORDERS}, {FRONT}{gaps()}, h AS (SELECT *, lag(gap_months) OVER (PARTITION BY benchmark_id ORDER BY lead_date, lead_model) AS held FROM g) SELECT benchmark_id, lead_date, lead_model, 0 AS step, round(held, 6) AS value FROM h WHERE held IS NOT NULL UNION ALL SELECT benchmark_id, lead_date, lead_model, 1, round(gap_months, 6) FROM h",
    "region_framing_gap": f"WITH o AS (SELECT o_orderstatus AS benchmark_id, o_orderkey AS model, o_orderdate::DATE AS date, o_totalprice AS score, NULL::DOUBLE AS score_std, r_name = 'ASIA' AS is_laggard FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'AMERICA')), {FRONT}{gaps()} SELECT {GAP_COLUMNS} FROM g",
    "daily_gap_series": f"WITH {ORDERS}, {FRONT}{daily()} SELECT benchmark_id, day, lag_model, round(gap_months, 6) AS gap_months, round(strict_months, 6) AS strict_months, round(vertical, 6) AS vertical FROM d",
    "gap_metrics": f"WITH {ORDERS}, {FRONT}{daily()}{METRICS} SELECT {METRIC_COLUMNS} FROM m",
    "gap_metrics_windowed": "WITH {}, {}{}{} SELECT {} FROM m".format(ORDERS, FRONT, daily("DATE '1997-01-01'", "DATE '1997-12-31'"), METRICS, METRIC_COLUMNS),
    "gap_metrics_overall": f"WITH {ORDERS.replace('o_orderstatus AS', chr(39) + 'all' + chr(39) + ' AS').replace('((o_orderkey % 5) * 100.0)::DOUBLE', 'NULL::DOUBLE')}, {FRONT}{daily()}{METRICS} SELECT {METRIC_COLUMNS} FROM m",
    "vertical_gap_daily": f"WITH {ORDERS}, {FRONT}{daily()} SELECT benchmark_id, day, round(vertical, 6) AS vertical FROM d",
    "historical_monthly_gap": f"""WITH {ORDERS}, {FRONT}, b AS (SELECT benchmark_id, (min(date) + INTERVAL 6 MONTH)::DATE AS a FROM f GROUP BY benchmark_id),
steps AS (SELECT benchmark_id, a, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, {AS_OF}::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM b),
sp AS (SELECT benchmark_id, month + (least(day(a), min(day(last_day(month))) OVER (PARTITION BY benchmark_id ORDER BY month))::INTEGER - 1) AS day FROM steps),
spine AS (SELECT * FROM sp WHERE day <= {AS_OF}),
bg AS (SELECT spine.benchmark_id, day, model, date, score, score_std FROM spine JOIN f ON f.benchmark_id = spine.benchmark_id AND f.is_laggard AND f.date <= day QUALIFY row_number() OVER (PARTITION BY spine.benchmark_id, day ORDER BY score DESC, date, model) = 1),
bl AS (SELECT spine.benchmark_id, day, model, date, score, score_std FROM spine JOIN f ON f.benchmark_id = spine.benchmark_id AND NOT f.is_laggard AND f.date <= day QUALIFY row_number() OVER (PARTITION BY spine.benchmark_id, day ORDER BY score DESC, date, model) = 1),
lv AS (SELECT bg.benchmark_id, bg.day, min(f.date) AS at_level FROM bg JOIN f ON f.benchmark_id = bg.benchmark_id AND NOT f.is_laggard AND f.date <= bg.day AND {caught("f.score", "f.score_std", "bg.score", "bg.score_std")} GROUP BY ALL)
SELECT bg.benchmark_id, bg.day, round(coalesce(greatest(0, date_diff('day', at_level, bg.date) / 30.4375::DOUBLE), 0), 6) AS gap_months, at_level IS NULL OR {caught("bg.score", "bg.score_std", "bl.score", "bl.score_std")} AS matched,
  bl.model AS reference_model, bl.score AS reference_score, bg.model AS laggard_model, bg.score AS laggard_score FROM bg JOIN bl USING (benchmark_id, day) LEFT JOIN lv ON lv.benchmark_id = bg.benchmark_id AND lv.day = bg.day""",
    "month_spine_clamped": """WITH RECURSIVE b AS (SELECT r_name AS benchmark_id, DATE '2023-12-27' + r_regionkey::INTEGER AS a FROM region),
s AS (SELECT benchmark_id, a AS day FROM b UNION ALL SELECT benchmark_id, (day + INTERVAL 1 MONTH)::DATE FROM s WHERE (day + INTERVAL 1 MONTH)::DATE <= DATE '2025-06-30') SELECT benchmark_id, day FROM s""",
    "statistics_row": f"""WITH {ORDERS}, {FRONT}{gaps()}{daily()}{METRICS}, best AS (SELECT benchmark_id, max(score) FILTER (is_laggard) AS bg, max(score) FILTER (NOT is_laggard) AS bl FROM f GROUP BY benchmark_id),
c AS (SELECT benchmark_id, count(*) FILTER (matched) AS tm, count(*) FILTER (NOT matched) AS tu FROM g GROUP BY benchmark_id)
SELECT best.benchmark_id, round(coalesce(bl - bg, 0), 6) AS current_vertical_gap, round(coalesce(avg_gap_months, 0), 6) AS avg_gap_months, round(coalesce(avg_strict_months, 0), 6) AS avg_strict_months, round(coalesce(gap_std, 0), 6) AS gap_std, round(coalesce(gap_low, 0), 6) AS gap_low, round(coalesce(gap_high, 0), 6) AS gap_high,
  round(coalesce(avg_vertical, 0), 6) AS avg_vertical, round(coalesce(vertical_low, 0), 6) AS vertical_low, round(coalesce(vertical_high, 0), 6) AS vertical_high, coalesce(tm, 0) AS total_matched, coalesce(tu, 0) AS total_unmatched, coalesce(n_days, 0) AS n_days
FROM best LEFT JOIN m ON m.benchmark_id = best.benchmark_id LEFT JOIN c ON c.benchmark_id = best.benchmark_id""",
    "threshold_first_crosser": f"{POINTS} SELECT benchmark_id, round(threshold, 6) AS threshold, round(floor, 6) AS floor, lead_model, lead_date, lag_model, lag_date, gap_days, round(gap_months, 6) AS gap_months, round(gap_months_so_far, 6) AS gap_months_so_far, valid, still_open FROM t",
    "threshold_accepted_pairs": f"{POINTS} SELECT benchmark_id, round(threshold, 6) AS threshold, lead_model, lag_model, gap_days, round(gap_months, 6) AS gap_months FROM t WHERE accepted",
    "threshold_summary": f"{POINTS} SELECT benchmark_id, count(*) AS n_thresholds, count(*) FILTER (valid) AS n_valid, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (still_open) AS n_still_open, round(median(gap_months) FILTER (accepted), 6) AS median_gap_months FROM t GROUP BY benchmark_id",
    "threshold_pooled_medians": f"{POINTS}, u AS (SELECT *, CASE WHEN benchmark_id = 'P' THEN 'private' ELSE 'public' END AS access FROM t WHERE accepted) SELECT coalesce(access, 'overall') AS pool, round(median(gap_months), 6) AS median_gap_months, count(*) AS n_datapoints, count(DISTINCT benchmark_id) AS n_benchmarks FROM u GROUP BY GROUPING SETS ((), (access))",
    "threshold_pool_sorted": f"{POINTS} SELECT benchmark_id, lag_date, round(threshold, 6) AS threshold, row_number() OVER (ORDER BY lag_date, benchmark_id, threshold) AS position FROM t WHERE accepted",
    "auto_grid": f"WITH {ORDERS}, {GRID} SELECT benchmark_id, round(threshold, 6) AS threshold FROM grid",
    "auto_grid_percent": f"WITH {discounts('900.0::DOUBLE', 'o1')}, " + discounts("1.0::DOUBLE", "o2", "'share'") + f", o AS (SELECT * FROM o1 UNION ALL SELECT * FROM o2), {GRID} SELECT benchmark_id, round(threshold, 6) AS threshold FROM grid",
    "validity_floor": f"WITH {EVENTS}, {FLOOR} SELECT benchmark_id, round(floor, 6) AS floor FROM fl",
    "kernel_smooth": f"""{POINTS}, pts AS (SELECT lag_date AS d, gap_months AS val FROM t WHERE accepted), gr AS (SELECT unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS grid_date FROM pts),
k AS (SELECT grid_date, sum(exp(-0.5 * pow(date_diff('day', d, grid_date) / 180.0::DOUBLE, 2))) AS w, sum(exp(-0.5 * pow(date_diff('day', d, grid_date) / 180.0::DOUBLE, 2)) * val) AS s FROM gr, pts GROUP BY grid_date)
SELECT 'all' AS pool, grid_date, round(CASE WHEN w >= 1.0 THEN s / w END, 6) AS mean, round(w, 6) AS weight FROM k""",
    "trend_linear_exponential": f"WITH {ORDERS}, {trend('o', 'benchmark_id')}",
    "trend_frontier": f"WITH {ORDERS}, {FRONT}, {trend('f', 'benchmark_id, is_laggard')}",
    "trend_logit": "WITH {}, {}".format(discounts("900.0::DOUBLE"), trend("o", "benchmark_id", "ln(least(greatest(score, 0.1), 99.9) / (100.0 - least(greatest(score, 0.1), 99.9)))", bounded=True)),
    "trend_split_periods": "WITH {}, {}, {}".format(ORDERS, periods("lo + (date_diff('day', lo, hi) // 2)::INTEGER", 3, "c >= 6"), trend("q", "benchmark_id, period")),
    "trend_fixed_split": "WITH {}, {}, {}".format(ORDERS, periods("DATE '1997-04-01'", 2, "lo < cut AND cut < hi"), trend("q", "benchmark_id, period")),
    "trend_gap_point": trend_gap("score"),
    "trend_gap_log": trend_gap("ln(score)"),
    "lag_bracket_linear": bracket(ORDERS, "score"),
    "lag_bracket_log": bracket(ORDERS, "ln(score)", "score > 0"),
    "lag_bracket_logit": bracket(discounts("900.0::DOUBLE"), "ln(least(greatest(score, 0.1), 99.9) / (100.0 - least(greatest(score, 0.1), 99.9)))"),
    "lognormal_prior": f"WITH {ORDERS}, {FRONT}{gaps()}, l AS (SELECT benchmark_id, CASE WHEN matched AND gap_months > 0 THEN ln(CASE WHEN gap_months > 0 THEN gap_months END) END AS x FROM g), q AS (SELECT benchmark_id, avg(x) AS mu, greatest(stddev_samp(x), 0.1) AS sigma, count(x) AS n_positive FROM l GROUP BY benchmark_id) SELECT benchmark_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, n_positive, round(exp(mu + sigma * sigma / 2), 6) AS prior_mean FROM q",
    "current_gap_estimate": current(),
    "current_gap_first_match": current("lead_date >= first_match"),
    "current_gap_oldest": f"WITH {ORDERS}, {FRONT}{gaps()}, q AS (SELECT benchmark_id, max(gap_months) FILTER (NOT matched) AS oldest, count(*) FILTER (NOT matched) AS n FROM g GROUP BY benchmark_id) SELECT benchmark_id, round(coalesce(oldest, 0), 4) AS estimated_gap, round(coalesce(oldest, 0), 4) AS min_gap, CASE WHEN n = 0 OR n >= 2 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN n = 0 THEN 'no_unmatched' ELSE 'oldest_unmatched' END AS method, n AS n_unmatched FROM q",
    "lognormal_pdf_grid": f"WITH {ORDERS}, {FRONT}{gaps()}, l AS (SELECT benchmark_id, CASE WHEN matched AND gap_months > 0 THEN ln(CASE WHEN gap_months > 0 THEN gap_months END) END AS x FROM g), q AS (SELECT benchmark_id, avg(x) AS mu, greatest(stddev_samp(x), 0.1) AS sigma FROM l GROUP BY benchmark_id), d AS (SELECT benchmark_id, mu, sigma, i, 0.5::DOUBLE + i * ((20.0::DOUBLE - 0.5) / 199) AS x FROM q, (SELECT unnest(generate_series(0, 199)) AS i) WHERE mu IS NOT NULL) SELECT benchmark_id, i, round(x, 6) AS x, round(exp(-((ln(x) - mu) / sigma) * ((ln(x) - mu) / sigma) / 2) / (x * sigma * sqrt(2 * 3.141592653589793::DOUBLE)), 6) AS density FROM d",
    "classify_three_valued": "WITH q AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Open weights (restricted)' WHEN 1 THEN ' API access ' WHEN 2 THEN 'Unreleased' END AS l FROM part) SELECT p_partkey, CASE WHEN contains(trim(l), 'Open') THEN true WHEN trim(l) IN ('API access', 'Hosted access (no API)') THEN false END AS is_open, coalesce(contains(l, 'Open'), false) AS is_open_old FROM q",
    "classify_chain": "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN true WHEN p_size % 7 IN (1, 2) THEN false WHEN contains(lower(p_name), '1') THEN true WHEN contains(lower(p_brand), 'brand#1') THEN false WHEN contains(lower(p_brand), 'brand#2') OR contains(lower(p_brand), 'brand#3') THEN true END AS is_open FROM part",
    "classify_accessible": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE contains(lower(p_brand), 'brand#2') OR contains(lower(p_type), 'brand#2') END AS is_open FROM part",
    "region_keywords": "SELECT n_name, contains(lower(r_name), 'asia') OR contains(lower(r_name), 'east') AS is_a, contains(lower(r_name), 'america') AS is_b FROM nation JOIN region ON n_regionkey = r_regionkey",
    "two_sided_difference": f"WITH {ORDERS}, {FRONT}, j AS (SELECT l.benchmark_id, l.model AS lead_model, g.model AS lag_model, l.score AS a, g.score AS b, sqrt(l.score_std * l.score_std + g.score_std * g.score_std) AS se FROM f l JOIN f g ON g.benchmark_id = l.benchmark_id AND g.is_laggard WHERE NOT l.is_laggard) SELECT benchmark_id, lead_model, lag_model, CASE WHEN se = 0 THEN a <> b ELSE abs(a - b) > 1.959963984540054 * se END AS differs, CASE WHEN se = 0 THEN false ELSE abs(a - b) > 1.959963984540054 * se END AS differs_strict FROM j",
    "backfill_two_key": "WITH c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (Sep 2025)' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment, c_name AS plain FROM customer), r AS (SELECT c_name AS k, lower(c_mktsegment) AS kind, c_acctbal AS balance FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_name ORDER BY c_acctbal) = 1) SELECT name, coalesce(segment, kind) AS segment, balance FROM c LEFT JOIN r ON plain = k",
    "override_blank_only": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN CASE s_name WHEN 'Supplier#000000001' THEN 'Open weights' WHEN 'Supplier#000000002' THEN 'API access' ELSE ' ' END ELSE 'API access' END AS label FROM supplier",
    "version_precedence_merge": "WITH t AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (o_orderstatus = 'O') AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey) SELECT o_custkey, coalesce(o, f) AS top, CASE WHEN o IS NULL THEN 0 ELSE 1 END::BIGINT AS version FROM t",
    "key_set_diff": "SELECT o_custkey, CASE WHEN NOT bool_or(o_orderstatus = 'F') THEN 'only_b' WHEN NOT bool_or(o_orderstatus = 'O') THEN 'only_a' ELSE 'both' END AS side FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey",
    "preserve_missing": "WITH t AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT * FROM t WHERE o_orderstatus = 'P' UNION ALL SELECT * FROM t a WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.o_orderstatus = 'P' AND b.o_custkey = a.o_custkey)",
    "nested_props_projection": "SELECT event_id, len(json_keys(props))::BIGINT AS n_keys, array_to_string(list_sort(json_keys(props)), ',') AS keys, array_to_string(list_transform(list_sort(json_keys(props)), lambda k: json_extract_string(props, '$.' || k)), ',') AS vals FROM events",
    "coalesced_scaled_score": "WITH q AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN l_discount WHEN l_orderkey % 3 = 1 THEN l_tax ELSE l_quantity END AS s FROM lineitem) SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN s <= 1 THEN s * 100 ELSE s END, 6) AS score FROM q",
    "std_from_ci": "SELECT s_suppkey, round(((s_acctbal + s_suppkey) - (s_acctbal - s_suppkey)) / 3.29, 6) AS std FROM supplier",
    "coerced_numbers_dates": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS value, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE DATE '2024-02-29' END AS day FROM supplier",
    "count_distinct_per_task": "SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events GROUP BY event_type",
    "label_buckets": "SELECT o_orderstatus, count(*) AS n, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS labels FROM orders GROUP BY o_orderstatus",
    "top_k_tasks": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "sort_nulls_last": f"WITH {ORDERS}, {FRONT}{gaps()} SELECT benchmark_id, lead_model, row_number() OVER (ORDER BY lag_date ASC NULLS LAST, benchmark_id, lead_model) AS up, row_number() OVER (ORDER BY lag_date DESC NULLS LAST, benchmark_id, lead_model) AS down FROM g",
    "enumerated_order": f"WITH {ORDERS}, c AS (SELECT benchmark_id, count(*) AS n FROM o GROUP BY benchmark_id) SELECT benchmark_id, n, row_number() OVER (ORDER BY CASE benchmark_id WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 1000 END, benchmark_id) AS position FROM c",
    "ages_descending": f"WITH {ORDERS}, {FRONT}{gaps()} SELECT benchmark_id, string_agg(gap_days::VARCHAR, ',' ORDER BY gap_days DESC) AS ages FROM g WHERE NOT matched GROUP BY benchmark_id",
    "suffix_strip": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' (beta)' END AS stripped, p_name AS short FROM part",
    "id_normalize": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'gpt_5' WHEN 1 THEN 'o1_elicited' WHEN 2 THEN 'claude_3_5_sonnet' ELSE 'llama_2' END AS id, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 2 THEN 'B' ELSE 'Unknown' END AS organization FROM part",
    "display_name": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'GPT 4o Mini' WHEN 1 THEN 'DeepSeek R1' ELSE 'O3 4o Mini X' END AS name, '&lt;b&gt;&amp;&#39;' || p_brand AS html FROM part",
    "date_functions": "SELECT o_orderkey, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719163)::BIGINT AS ordinal, strftime(o_orderdate, '%b %Y') AS month, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter, (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE + 15 AS later, o_orderdate::DATE AS parsed FROM orders",
    "source_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "notebook_horizontal_levels": f"""WITH {ORDERS}, {FRONT}, s AS (SELECT benchmark_id, is_laggard, min(score) AS a, max(score) AS z FROM f GROUP BY ALL), b AS (SELECT benchmark_id, max(a) AS a, min(z) AS z FROM s GROUP BY benchmark_id),
l AS (SELECT benchmark_id, i, a + i * ((z - a) / 99) AS level FROM b, (SELECT unnest(generate_series(0, 99)) AS i)),
c AS (SELECT l.benchmark_id, i, level, date AS ld, score AS ls, score_std AS lstd FROM l JOIN f ON f.benchmark_id = l.benchmark_id AND NOT is_laggard AND score >= level QUALIFY row_number() OVER (PARTITION BY l.benchmark_id, i ORDER BY date, score DESC, model) = 1),
h AS (SELECT c.benchmark_id, i, level, ld, min(f.date) AS gd FROM c JOIN f ON f.benchmark_id = c.benchmark_id AND f.is_laggard AND (f.score >= level OR CASE WHEN f.score_std IS NULL OR lstd IS NULL THEN true
  WHEN f.score_std * f.score_std + lstd * lstd = 0 THEN f.score = ls ELSE abs(f.score - ls) <= 1.959963984540054 * sqrt(f.score_std * f.score_std + lstd * lstd) END) GROUP BY ALL)
SELECT benchmark_id, i, round(level, 4) AS level, round(date_diff('day', ld, gd) / 30.5::DOUBLE, 6) AS gap_months FROM h""",
    "notebook_vertical": f"WITH {ORDERS}, {FRONT}{daily()} SELECT benchmark_id, round(avg(vertical), 4) AS mean, round(stddev_samp(vertical), 4) AS std, round(quantile_cont(vertical, 0.05), 4) AS low, round(quantile_cont(vertical, 0.95), 4) AS high FROM d GROUP BY benchmark_id",
}



def drawn_index(draw: str, place: str, n: str) -> str:
    """Which of n points stands at a place of a draw: the same integers as the operators'."""
    state = f"({draw} * 1000003::BIGINT + {place} * 7919::BIGINT + 1) % 2147483647"
    rounds = ["s0"] + [f"(s{i} * s{i} + {a} * s{i} + {c}) % 2147483647" for i, (a, c) in enumerate(((48271, 12345), (69621, 67891), (16807, 13579), (39373, 24683)))]
    inner = f"SELECT *, {state} AS s0 FROM places"
    for i in range(1, 5):
        inner = f"SELECT *, {rounds[i]} AS s{i} FROM ({inner})"
    return f"SELECT *, s4 * {n} // 2147483647 AS i FROM ({inner})"


def smoothed(pool: str, n_boot: int, bandwidth: str, least: str) -> str:
    """The smoother and its interval of the relation pts (pool, d, val)."""
    w = f"exp(-0.5 * pow(date_diff('day', d, grid_date) / {bandwidth}::DOUBLE, 2))"
    return f"""pt AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY d, val) - 1 AS i FROM pts),
sizes AS (SELECT pool, count(*) AS n, min(d) AS a, max(d) AS z FROM pts GROUP BY pool),
gr AS (SELECT pool, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 7 DAY))::DATE AS grid_date FROM sizes),
k AS (SELECT pool, grid_date, sum({w}) AS w, sum({w} * val) AS s FROM gr JOIN pts USING (pool) GROUP BY pool, grid_date),
places AS (SELECT pool, n, draw, unnest(generate_series(0, n - 1)) AS place FROM sizes, (SELECT unnest(generate_series(0, {n_boot - 1})) AS draw)),
taken AS (SELECT pool, draw, i, count(*) AS times FROM ({drawn_index("draw", "place", "n")}) GROUP BY pool, draw, i),
per_day AS (SELECT pool, draw, d, sum(times) AS c, sum(times * val) AS t FROM taken JOIN pt USING (pool, i) GROUP BY pool, draw, d),
kernel AS (SELECT pool, grid_date, d, {w} AS w FROM gr JOIN (SELECT DISTINCT pool, d FROM pts) USING (pool)),
means AS (SELECT pool, draw, grid_date, sum(w * c) AS w, sum(w * t) AS t FROM per_day JOIN kernel USING (pool, d) GROUP BY pool, draw, grid_date),
ends AS (SELECT pool, grid_date, quantile_cont(t / w, 0.05) FILTER (w >= {least}) AS lo, quantile_cont(t / w, 0.95) FILTER (w >= {least}) AS hi FROM means GROUP BY pool, grid_date)
SELECT {pool}, grid_date, round(CASE WHEN w >= {least} THEN s / w END, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi FROM k JOIN ends USING (pool, grid_date)"""


SQL |= {
    "kernel_smooth_bootstrap": f"{POINTS}, pts AS (SELECT 'all' AS pool, lag_date AS d, gap_months AS val FROM t WHERE accepted), {smoothed('pool', 5000, '180.0', '1.0')}",
    "trend_gap_bootstrap": f"""WITH {ORDERS.replace('o_orderstatus AS', chr(39) + 'all' + chr(39) + ' AS')}, {FRONT}, y AS (SELECT benchmark_id, is_laggard, date_diff('day', DATE '2000-01-01', date)::BIGINT AS x, score AS y, row_number() OVER (PARTITION BY benchmark_id, is_laggard ORDER BY date, score DESC, model) - 1 AS i FROM f),
facts AS (SELECT benchmark_id, max(x) AS now, max(y) FILTER (NOT is_laggard) AS best, least(count(*) FILTER (is_laggard), count(*) FILTER (NOT is_laggard)) AS fewest FROM y GROUP BY benchmark_id),
sizes AS (SELECT benchmark_id, is_laggard, count(*) AS n FROM y JOIN facts USING (benchmark_id) WHERE fewest >= 8 GROUP BY ALL),
places AS (SELECT benchmark_id, is_laggard, n, draw, unnest(generate_series(0, n - 1)) AS place FROM sizes, (SELECT unnest(generate_series(0, 1999)) AS draw)),
taken AS (SELECT benchmark_id, is_laggard, draw, i, count(*) AS w FROM ({drawn_index("draw", "place", "n")}) GROUP BY ALL),
sums AS (SELECT benchmark_id, draw, is_laggard, sum(w)::BIGINT AS n, sum(w * x)::BIGINT AS sx, sum(w * x * x)::BIGINT AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy FROM taken JOIN y USING (benchmark_id, is_laggard, i) GROUP BY ALL),
lines AS (SELECT *, CASE WHEN n * sxx - sx * sx > 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS m, sx / n::DOUBLE AS ax, sy / n AS ay FROM sums),
e AS (SELECT g.benchmark_id, now, g.m AS ms, l.m AS ml, l.ax AS xl, l.ay AS yl, g.ay + g.m * (now - g.ax) AS level, CASE WHEN g.m > 0 THEN (g.ax + (best - g.ay) / g.m - now) / 30.4375::DOUBLE END AS ahead FROM lines g JOIN lines l ON l.benchmark_id = g.benchmark_id AND l.draw = g.draw AND NOT l.is_laggard JOIN facts ON facts.benchmark_id = g.benchmark_id WHERE g.is_laggard AND g.m IS NOT NULL AND l.m > 0),
v AS (SELECT benchmark_id, (now - xl - (level - yl) / ml) / 30.4375::DOUBLE AS backward, (1 - ms / ml) * 12 AS change, CASE WHEN ahead <= 240 THEN ahead END AS forward FROM e),
q AS (SELECT benchmark_id, count(*) AS n_valid, count(forward) AS nf, {", ".join(f"quantile_cont({k}, {p}) AS {k}_{n}" for k in ("backward", "change", "forward") for n, p in (("low", 0.05), ("high", 0.95)))} FROM v GROUP BY benchmark_id)
SELECT benchmark_id, coalesce(n_valid, 0) AS n_valid, {", ".join(f"round(CASE WHEN {'nf >= 100 AND nf >= 0.9 * n_valid' if k == 'forward' else 'n_valid >= 100'} THEN {k}_{n} END, 4) AS {k}_{n}" for k in ("backward", "change", "forward") for n in ("low", "high"))} FROM facts LEFT JOIN q USING (benchmark_id)""",
}

#: The daily gaps, the history and the match map with draws: the same SQL with another predicate on records that carry them.


def _with_draws(sql: str) -> str:
    """SQL on the frontier f, with draws in all the records that it compares."""
    for a, b in (("lag", "rec"), ("f", "bg"), ("bg", "bl"), ("l", "g")):
        plain = caught(f"{a}.score", f"{a}.score_std", f"{b}.score", f"{b}.score_std")
        sql = sql.replace(plain, drawn(a, b, plain))
    for cut in ("score, score_std FROM days", "score, score_std FROM p", "score, score_std FROM spine"):
        sql = sql.replace(cut, cut.replace("score_std", "score_std, draws"))
    return sql.replace(RANKED, WITH_DRAWS)


SQL |= {
    "gap_metrics_draws": _with_draws(SQL["gap_metrics"]),
    "historical_gap_draws": _with_draws(SQL["historical_monthly_gap"]),
    "frontier_match_draws": _with_draws(SQL["frontier_match_pairs"]),
    "threshold_settings": POINTS.replace(GRID, GRID.replace("grid AS (", "auto AS (") + """,
given AS (SELECT 'F' AS benchmark_id, unnest([100000.0::DOUBLE, 200000.0::DOUBLE, 300000.0::DOUBLE]) AS threshold),
grid AS (SELECT * FROM auto WHERE benchmark_id <> 'F' UNION ALL SELECT * FROM given)""")
    .replace("threshold > floor AS valid", "CASE c_id WHEN 'O' THEN threshold IN (150000.0, 250000.0) ELSE threshold > floor END AS valid")
    .replace(FLOOR, "fl AS (SELECT benchmark_id, CASE benchmark_id WHEN 'F' THEN 150000.0 ELSE quantile_cont(score, 0.1) END AS floor FROM o GROUP BY benchmark_id)")
    .replace("c_id", "benchmark_id") + " SELECT benchmark_id, round(threshold, 6) AS threshold, round(floor, 6) AS floor, lead_model, lead_date, lag_model, lag_date, gap_days, round(gap_months, 6) AS gap_months, round(gap_months_so_far, 6) AS gap_months_so_far, valid, still_open, accepted FROM t",
    "first_catchup_settings": f"WITH {ORDERS}, {FRONT}{gaps('NULL::DOUBLE')} SELECT {GAP_COLUMNS} FROM g".replace("g.score >= l.score - 1.0", "g.score >= l.score - CASE l.benchmark_id WHEN 'F' THEN 0.0 ELSE 1.0 END"),
    "round_two_places": "SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice * (1 - l_discount) / 8)::DOUBLE AS rounded FROM lineitem",
    "region_flags": "SELECT n_nationkey, n_name IN ('CHINA', 'JAPAN') AS in_asia, n_name IN ('UNITED STATES', 'CANADA') AS in_west FROM nation",
    "open_by_id": "SELECT p_partkey, starts_with(replace(lower(p_name), ' ', '_'), 'a') OR ends_with(replace(lower(p_name), ' ', '_'), 'e') AS is_open FROM part",
    "column_defaults": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'Unknown' END AS market, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Nobody' END AS name FROM customer",
    "index_lookup": "WITH f AS (SELECT p_brand, arg_min(p_size, p_partkey) AS size, min(p_partkey) AS k FROM part GROUP BY p_brand) SELECT p_partkey, CASE WHEN k % 4 > 0 THEN f.size END AS size FROM part JOIN f ON f.p_brand = part.p_brand",
    "spaced_labels": """WITH RECURSIVE v AS (SELECT o_orderstatus || '-' || (o_orderkey % 10) AS benchmark_id, o_totalprice::DOUBLE AS score FROM orders WHERE o_totalprice > 0),
pick AS (SELECT benchmark_id, min(score) AS score FROM v GROUP BY benchmark_id UNION ALL
  SELECT pick.benchmark_id, min(v.score) FROM pick JOIN v ON v.benchmark_id = pick.benchmark_id AND log10(v.score) - log10(pick.score) >= 0.2 GROUP BY pick.benchmark_id) SELECT benchmark_id, score FROM pick""",
    "fractional_dates": "SELECT event_id, round((epoch_us(ts::TIMESTAMP) - epoch_us(TIMESTAMP '2023-12-31 18:00:00')) / 86400000000.0::DOUBLE, 6) AS days, floor((epoch_us(ts::TIMESTAMP) - epoch_us(TIMESTAMP '2023-12-31 18:00:00')) / 86400000000.0::DOUBLE)::BIGINT AS whole_days FROM events",
    "quarter_ticks": "WITH e AS (SELECT o_orderstatus, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders GROUP BY 1) SELECT o_orderstatus, unnest(generate_series(date_trunc('quarter', a)::TIMESTAMP, z::TIMESTAMP, INTERVAL 3 MONTH))::DATE AS tick FROM e",
    "nested_metric": "SELECT event_id, round(value, 6) AS score, CASE WHEN user_id % 2 = 0 THEN round(3 / 3.29::DOUBLE, 6) END AS score_std FROM events WHERE value IS NOT NULL",
}


# level walk and lanes, linked tables, versioned documents

_LEVELS = SQL["notebook_horizontal_levels"].split("\nh AS")[0]
_LINES = "ln AS (SELECT l_orderkey || '-' || l_linenumber AS run_id, l_partkey % 50 AS task_id, o_custkey AS model_id, l_returnflag AS scorer, l_extendedprice AS mean, count(*) FILTER (l_linenumber % 7 > 0) OVER (PARTITION BY l_orderkey, l_linenumber) AS ns FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_TASKS = "tk AS (SELECT p_partkey AS task_id, lower(p_brand) || '/' || lower(p_name) || '/' || p_partkey AS path FROM part WHERE p_partkey < 55)"

SQL |= {
    "notebook_level_walk": _LEVELS.replace("WITH ", "WITH RECURSIVE ", 1) + """
walk AS (SELECT DISTINCT benchmark_id, -1::BIGINT AS i, DATE '0001-01-01' AS out_date, NULL::DATE AS gd FROM c UNION ALL
  SELECT benchmark_id, i, CASE WHEN p IS NULL THEN ds[len(ds)] WHEN p = 1 THEN out_date ELSE ds[p - 1] END, CASE WHEN p IS NOT NULL THEN ds[p] END FROM (
    SELECT *, CASE WHEN list_contains(ms, true) THEN list_position(ms, true) END AS p FROM (
      SELECT w.benchmark_id, w.i + 1 AS i, w.out_date, list(f.date ORDER BY f.date, f.score DESC, f.model) AS ds,
        list((f.score >= level OR CASE WHEN f.score_std IS NULL OR lstd IS NULL THEN true WHEN f.score_std * f.score_std + lstd * lstd = 0 THEN f.score = ls ELSE abs(f.score - ls) <= 1.959963984540054 * sqrt(f.score_std * f.score_std + lstd * lstd) END) ORDER BY f.date, f.score DESC, f.model) AS ms
      FROM walk w JOIN c ON c.benchmark_id = w.benchmark_id AND c.i = w.i + 1 JOIN f ON f.benchmark_id = w.benchmark_id AND f.is_laggard AND f.date > w.out_date GROUP BY ALL)))
SELECT c.benchmark_id, c.i, round(c.level, 4) AS level, round(date_diff('day', ld, gd) / 30.5::DOUBLE, 6) AS gap_months FROM walk JOIN c ON c.benchmark_id = walk.benchmark_id AND c.i = walk.i WHERE gd IS NOT NULL""",
    "label_lanes": f"""WITH RECURSIVE {ORDERS}, {RECORDS}, e AS (SELECT benchmark_id, min(date) AS a, max(date) AS z FROM r GROUP BY benchmark_id),
b AS (SELECT benchmark_id, is_laggard, model, date_diff('day', a, date) * 600.0::DOUBLE / greatest(date_diff('day', a, z), 1) AS x, length(model::VARCHAR) * 3.4::DOUBLE + 6 AS half FROM r JOIN e USING (benchmark_id)),
n AS (SELECT *, x - half AS x0, x + half AS x1, row_number() OVER (PARTITION BY benchmark_id, is_laggard ORDER BY x - half, model) AS k FROM b),
walk AS (SELECT benchmark_id, is_laggard, 0::BIGINT AS k, NULL::BIGINT AS model, '-infinity'::DOUBLE AS e0, '-infinity'::DOUBLE AS e1, NULL::BIGINT AS lane FROM (SELECT DISTINCT benchmark_id, is_laggard FROM n) UNION ALL
  SELECT benchmark_id, is_laggard, k, model, CASE WHEN lane = 0 THEN x1 ELSE e0 END, CASE WHEN lane = 1 THEN x1 ELSE e1 END, lane FROM (
    SELECT n.*, e0, e1, CASE WHEN x0 >= e0 + 4.0 THEN 0 WHEN x0 >= e1 + 4.0 THEN 1 END::BIGINT AS lane FROM walk JOIN n ON n.benchmark_id = walk.benchmark_id AND n.is_laggard = walk.is_laggard AND n.k = walk.k + 1))
SELECT benchmark_id, is_laggard, model, lane FROM walk WHERE k > 0""",
    "task_paths": f"WITH {_TASKS} SELECT path, row_number() OVER (ORDER BY path) AS position FROM tk",
    "available_tasks": f"WITH {_TASKS}, {_LINES} SELECT 'b' || tk.task_id AS benchmark_id, path, count(DISTINCT model_id) AS n_models FROM tk LEFT JOIN ln ON ln.task_id = tk.task_id WHERE tk.task_id % 3 = 0 GROUP BY tk.task_id, path",
    "exploration_report": f"WITH {_TASKS}, {_LINES} SELECT tk.task_id, path, count(run_id) AS n_runs, coalesce(sum(ns), 0)::BIGINT AS n_scores, count(DISTINCT model_id) AS n_models, count(*) FILTER (ns = 0) AS n_unscored, count(DISTINCT model_id) >= 30 AS recommended, true AS models_within, true AS quantiles_within FROM tk LEFT JOIN ln ON ln.task_id = tk.task_id GROUP BY tk.task_id, path",
    "accessibility_report": "WITH g AS (SELECT CASE n_regionkey WHEN 0 THEN 'Open weights' WHEN 1 THEN 'API access' WHEN 2 THEN 'Hosted' END AS label FROM nation) SELECT CASE WHEN label = 'Open weights' THEN 'open' WHEN label = 'API access' THEN 'closed' ELSE 'unknown' END AS kind, count(*) AS n_groups, coalesce(string_agg(DISTINCT label, '|' ORDER BY label), '') AS labels FROM g GROUP BY kind",
    "merged_versions": """WITH o AS (SELECT o_custkey AS k, o_orderstatus = 'O' AS late, max(o_totalprice) AS top, min(o_totalprice) AS low, max(o_orderdate)::DATE AS day FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL),
l AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY late DESC) = 1)
SELECT 'c' || k AS key, CASE WHEN late THEN '1.1' ELSE '1.0' END AS version, CASE WHEN n = 2 THEN '1.0,1.1' WHEN late THEN '1.1' ELSE '1.0' END AS in_versions, day AS date, round(top, 2) AS score, CASE WHEN k % 2 = 1 THEN round(low, 2) END AS low, k % 2 = 0 AS is_sota, day::VARCHAR AS release_date FROM l""",
    "version_metadata": "SELECT '1.1' AS version, '1.0,1.1' AS versions, count(DISTINCT o_custkey)::DOUBLE AS doubling_days, 1.0::DOUBLE AS doubling_low, NULL::DOUBLE AS doubling_high, NULL::DOUBLE AS recent_doubling_days, 'n/a' AS kept FROM orders WHERE o_orderstatus = 'O' AND o_custkey < 100",
}


# pooled thresholds, framings and lists

_POOL = POINTS + """, st AS (SELECT * FROM (VALUES ('F', true, 'public'), ('O', true, 'private'), ('P', false, 'public')) AS v(benchmark_id, keep, access)),
pl AS (SELECT t.*, access, unnest(['overall', access]) AS pool FROM t JOIN st USING (benchmark_id) WHERE accepted AND keep)"""
_FRAMED = """r0 AS (SELECT o_orderstatus AS benchmark_id, o_orderkey AS model, o_orderdate::DATE AS date, o_totalprice AS score, NULL::DOUBLE AS score_std, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT 'east/' || benchmark_id AS benchmark_id, model, date, score, score_std, r_name = 'ASIA' AS is_laggard FROM r0 WHERE r_name IN ('ASIA', 'AMERICA')
  UNION ALL SELECT 'south/' || benchmark_id, model, date, score, score_std, r_name IN ('AFRICA', 'MIDDLE EAST') FROM r0 WHERE r_name <> 'ASIA')"""

SQL |= {
    "threshold_pool": f"{_POOL} SELECT pool, benchmark_id, access, round(threshold, 6) AS threshold, lead_model, lead_date, lag_model, lag_date, gap_days, round(gap_months, 6) AS gap_months FROM pl",
    "threshold_pool_summary": f"{_POOL} SELECT pool, round(median(gap_months), 6) AS median_gap_months, count(*) AS n_datapoints, count(DISTINCT benchmark_id) AS n_benchmarks FROM pl GROUP BY pool",
    "threshold_pool_trends": f"{_POOL}, pts AS (SELECT pool, lag_date AS d, gap_months AS val FROM pl QUALIFY count(*) OVER (PARTITION BY pool) > 1), {smoothed('pool', 1000, '180.0', '1.0')} WHERE w >= 1.0".replace("SELECT pool, grid_date, round(CASE", "SELECT pool, grid_date AS date, round(CASE"),
    "threshold_config": f"WITH {ORDERS}, {FLOOR} SELECT benchmark_id, benchmark_id <> 'P' AS keep, CASE benchmark_id WHEN 'O' THEN 'private' ELSE 'public' END AS access, round(CASE benchmark_id WHEN 'F' THEN 150000.0 ELSE floor END, 6) AS floor, CASE benchmark_id WHEN 'F' THEN '100000,200000,300000' END AS thresholds, CASE benchmark_id WHEN 'O' THEN '150000,250000' END AS accepted FROM fl",
    "framing_history": SQL["historical_monthly_gap"].replace(ORDERS, _FRAMED),
    "framing_matches": SQL["frontier_match_pairs"].replace(ORDERS, _FRAMED),
    "model_list": f"WITH {ORDERS}, {RANKED} SELECT benchmark_id, model, date, score, is_laggard, before IS NULL OR score >= before AS on_frontier FROM p",
}


# adapters

SQL |= {
    "score_table_ingest": """WITH t AS (SELECT 'm-' || (c_custkey % 700) AS model, round(c_acctbal, 2) AS eci, round(c_acctbal - 10, 2) AS low, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal + 5, 2) END AS high,
  CASE WHEN c_custkey % 2 = 0 THEN '2023-' || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') || '-15' END AS date, c_custkey % 3 AS label FROM customer WHERE c_custkey % 5 > 0),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY model ORDER BY eci DESC, coalesce(date, ''), coalesce(low, 0)) = 1),
k AS (SELECT *, substr(model, 3)::BIGINT AS k FROM b)
SELECT 'index' AS benchmark_id, model, coalesce(date::DATE, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = k AND c_custkey < 350) THEN DATE '2022-05-01' END) AS date, round(eci, 6) AS score, round((high - low) / 3.29, 6) AS score_std,
  CASE label WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN k % 2 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = k) THEN true END END AS is_laggard FROM k""",
    "benchmark_table_ingest": """WITH t AS (SELECT 'v' || l_partkey AS model, CASE WHEN l_orderkey % 2 = 0 THEN l_discount WHEN l_orderkey % 3 = 0 THEN l_quantity END AS s, l_shipdate::DATE AS date, CASE WHEN l_orderkey % 5 > 0 THEN l_tax END AS e, l_returnflag = 'R' AS is_laggard FROM lineitem WHERE l_orderkey % 11 > 0 AND l_orderkey % 13 > 0 AND l_returnflag IN ('R', 'A'))
SELECT 'lines' AS benchmark_id, model, date, round(CASE WHEN s <= 1 THEN s * 100 ELSE s END, 6) AS score, round(coalesce(CASE WHEN e <= 1 THEN e * 100 ELSE e END, 0.0), 6) AS score_std, is_laggard FROM t WHERE s IS NOT NULL AND date IS NOT NULL""",
    "resolved_task": f"WITH {_TASKS}, k AS (SELECT task_id FROM tk WHERE contains(path, 'gear') OR contains(path, 'brand') ORDER BY NOT contains(path, 'gear'), path LIMIT 1) SELECT look, task_id FROM (SELECT 20::BIGINT AS task_id, unnest(['path', 'alternate']) AS look UNION ALL SELECT task_id, 'keyword' FROM k)",
    "run_scores": f"""WITH {_LINES.replace("o_custkey AS model_id", "o_custkey AS model_id, o_orderstatus AS status, l_linenumber")}, m AS (SELECT o_custkey AS model, min(o_orderdate)::DATE AS date FROM orders GROUP BY o_custkey)
SELECT 'runs' AS benchmark_id, model, date, round(max(s.mean), 6) AS score, 0.0::DOUBLE AS score_std, CASE WHEN n_regionkey = 0 THEN true WHEN n_regionkey IN (1, 2) THEN false ELSE contains(lower(n_name), 'india') OR contains(lower(n_name), 'japan') END AS is_laggard
FROM ln r JOIN ln s ON s.run_id = r.run_id JOIN m ON model = r.model_id JOIN customer ON c_custkey = model JOIN nation ON n_nationkey = c_nationkey WHERE r.status = 'F' AND s.l_linenumber % 7 > 0 AND s.scorer IN ('A', 'R') AND r.task_id IN (7, 8, 9) AND r.task_id IN (SELECT p_partkey FROM part WHERE p_partkey < 55) GROUP BY ALL""",
    "latest_draws": "SELECT vec_id AS model, len(embedding)::BIGINT AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 6 = 0 AND len(embedding) = 64",
    "available_benchmarks": f"WITH {ORDERS} SELECT benchmark_id, count(*) AS n_rows, count(DISTINCT model) AS n_models, row_number() OVER (ORDER BY benchmark_id) AS position FROM o GROUP BY benchmark_id",
    "published_documents": f"""{POINTS}, {FRONT}{gaps()}, a AS (SELECT benchmark_id, count(*) AS n_models FROM f GROUP BY benchmark_id), b AS (SELECT benchmark_id, count(*) AS n_gaps, count(*) FILTER (matched) AS n_matched, coalesce(max(gap_months) FILTER (NOT matched), 0) AS oldest FROM g GROUP BY benchmark_id),
c AS (SELECT benchmark_id, count(*) AS n_thresholds, count(*) FILTER (accepted) AS n_accepted FROM t GROUP BY benchmark_id) SELECT benchmark_id, n_models, n_gaps, n_thresholds, n_accepted, round(oldest, 4) AS min_gap, n_matched FROM a JOIN b USING (benchmark_id) JOIN c USING (benchmark_id)""",
}
