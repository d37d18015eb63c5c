"""The queries of the catalogue as SQL text for DuckDB.

Written on its own, from the rules: shared steps are common table expressions,
and only fixed values and texts are taken from the library.
"""

from __future__ import annotations

import re

from vitaframe.config import CORRELATION_PAIRS, METRICS
from vitaframe.sources.tables import EVENT_SETTINGS
from vitaframe.texts import (
    BADGES,
    BEHAVIOUR,
    CARD_TEXTS,
    EXPLANATIONS,
    FINDINGS,
    PROGRESS,
    RECOMMENDATIONS,
    SUMMARY,
)

S = EVENT_SETTINGS
R = S.rules


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(expr: str, alias: str) -> str:
    return f"round(({expr}) + 1e-9, 6) + 0.0 AS {alias}"


def big(expr: str, alias: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias}"


def even(expr: str, digits: int) -> str:
    scale = float(10**digits)
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {expr})"


def grouped(expr: str) -> str:
    return f"format('{{:,}}', CAST({even(expr, 0)} AS BIGINT))"


def say(template: str, *parts: str) -> str:
    pieces = template.split("{}")
    out = [q(pieces[0])]
    for part, piece in zip(parts, pieces[1:], strict=True):
        out += [part, q(piece)]
    return "(" + " || ".join(out) + ")"


def p_value(r: str, n: str) -> str:
    nu = f"({n} - 2)"
    even_terms = (
        f"coalesce(list_sum(list_transform(range(0, CAST({nu} // 2 AS BIGINT)), lambda k: "
        f"exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(1 - {r} * {r}, k))), 0)"
    )
    odd_terms = (
        f"coalesce(list_sum(list_transform(range(0, CAST(({nu} - 1) // 2 AS BIGINT)), lambda k: "
        f"exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(1 - {r} * {r}, k))), 0)"
    )
    return (
        f"CASE WHEN {r} IS NULL THEN NULL WHEN abs({r}) >= 1 THEN 0.0 "
        f"WHEN {nu} % 2 = 0 THEN 1 - abs({r}) * {even_terms} "
        f"ELSE 1 - 2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * {odd_terms}) END"
    )


# --- shared steps ---------------------------------------------------------------

METRIC_OF = (
    "CASE event_type WHEN 'click' THEN 'steps' WHEN 'view' THEN 'hr' "
    "WHEN 'purchase' THEN 'bp' WHEN 'signup' THEN 'sleep' WHEN 'error' THEN 'temp' END"
)
K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"

CTES: list[tuple[str, str]] = []


def cte(name: str, body: str) -> None:
    CTES.append((name, body))


cte(
    "ev",
    f"SELECT 'participant-' || CAST(user_id // 8 AS VARCHAR) AS pid, {METRIC_OF} AS m, ts, "
    f"epoch_us(ts) AS ep, value AS v1, {K} AS v2, event_id AS pos, event_type, props FROM events",
)
cte(
    "rec",
    "SELECT * REPLACE (2 * pos AS pos) FROM ev UNION ALL "
    "SELECT * REPLACE (2 * pos + 1 AS pos) FROM ev WHERE pos % 10 = 0",
)
cte(
    "cfg",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{m}', {i}, {c.low}, {c.high}, {c.z_threshold}, {c.iqr_factor}, {c.expected_per_day}, {q(c.unit)})"
        for i, (m, c) in enumerate(S.metrics.items())
    )
    + ") t(m, ord, lo, hi, zt, k, per_day, unit)",
)
cte(
    "dup",
    "SELECT *, row_number() OVER (PARTITION BY pid, m, ep, v1, v2 ORDER BY pos) AS rn FROM rec",
)
IN_RANGE_BAD = (
    "NOT (v1 BETWEEN 1 AND 250) OR (m = 'bp' AND v2 IS NOT NULL AND v2 <> 0 "
    "AND (NOT (v2 BETWEEN 1 AND 250) OR v1 <= v2))"
)
cte(
    "ranged",
    f"SELECT *, CASE WHEN rn > 1 THEN 'duplicate' WHEN {IN_RANGE_BAD} THEN 'invalid' "
    "ELSE 'good' END AS f1 FROM dup",
)
cte(
    "lim",
    "SELECT pid, m, count(v1) AS n1, avg(v1) AS mean1, stddev_pop(v1) AS sd1, "
    "quantile_cont(v1, 0.25) AS q1a, quantile_cont(v1, 0.75) AS q3a, "
    "count(v2) AS n2, avg(v2) AS mean2, stddev_pop(v2) AS sd2, "
    "quantile_cont(v2, 0.25) AS q1b, quantile_cont(v2, 0.75) AS q3b "
    "FROM ranged WHERE f1 = 'good' GROUP BY pid, m",
)
cte(
    "cleaned",
    "SELECT r.*, CASE WHEN f1 = 'good' AND n1 >= 5 AND ("
    "abs(v1 - mean1) / nullif(sd1, 0) > zt OR v1 < q1a - k * (q3a - q1a) OR v1 > q3a + k * (q3a - q1a) "
    "OR (n2 >= 5 AND (abs(v2 - mean2) / nullif(sd2, 0) > zt OR v2 < q1b - k * (q3b - q1b) "
    "OR v2 > q3b + k * (q3b - q1b)))) THEN 'outlier' ELSE f1 END AS flag "
    "FROM ranged r JOIN cfg USING (m) LEFT JOIN lim USING (pid, m)",
)
cte("good", "SELECT *, CAST(ts AS DATE) AS d FROM cleaned WHERE flag = 'good'")
cte(
    "dayl",
    "SELECT pid, d, m, round(CASE WHEN m = 'steps' THEN sum(v1) ELSE avg(v1) END, 9) AS v, "
    "count(*) AS n FROM good GROUP BY pid, d, m",
)
cte("pdays", "SELECT pid, d, count(*) OVER (PARTITION BY pid) AS days FROM (SELECT DISTINCT pid, d FROM dayl)")
cte("elig", "SELECT * FROM pdays WHERE days >= 7")
cte(
    "pairs",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(CORRELATION_PAIRS))
    + ") t(ord, m1, m2)",
)
cte(
    "same",
    "SELECT e.pid, e.d, p.ord, p.m1, p.m2, x.v AS a, y.v AS b FROM elig e CROSS JOIN pairs p "
    "JOIN dayl x ON x.pid = e.pid AND x.d = e.d AND x.m = p.m1 "
    "JOIN dayl y ON y.pid = e.pid AND y.d = e.d AND y.m = p.m2",
)
cte("nxt", "SELECT pid, d, lead(d) OVER (PARTITION BY pid ORDER BY d) AS nd FROM elig")
cte(
    "nextday",
    "SELECT e.pid, e.d, p.ord, p.m1, p.m2, x.v AS a, y.v AS b FROM nxt e CROSS JOIN pairs p "
    "JOIN dayl x ON x.pid = e.pid AND x.d = e.d AND x.m = p.m1 "
    "JOIN dayl y ON y.pid = e.pid AND y.d = e.nd AND y.m = p.m2",
)


def ranked(source: str, keys: str) -> str:
    return (
        "SELECT *, rank() OVER (PARTITION BY {k} ORDER BY a) + (count(*) OVER (PARTITION BY {k}, a) - 1) / 2.0 AS ra, "
        "rank() OVER (PARTITION BY {k} ORDER BY b) + (count(*) OVER (PARTITION BY {k}, b) - 1) / 2.0 AS rb FROM {s}"
    ).format(k=keys, s=source)


def coefficients(source: str, keys: str) -> str:
    return (
        f"SELECT *, {p_value('pr', 'n')} AS pp, {p_value('sr', 'n')} AS sp FROM ("
        f"SELECT {keys}, count(*) AS n, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS pr, "
        "covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS sr "
        f"FROM {source} GROUP BY {keys} HAVING count(*) >= 5)"
    )


PAIR = "pid, ord, m1, m2"
cte("same_r", ranked("same", PAIR))
cte("next_r", ranked("nextday", PAIR))
cte("corr0", coefficients("same_r", PAIR))
cte("lag0", coefficients("next_r", PAIR))
STRONGEST = "coalesce(greatest(abs(pr), abs(sr)), 0)"
CONFIDENCE = (
    f"CASE WHEN n >= 30 AND {STRONGEST} >= 0.5 THEN 'solid' "
    f"WHEN n >= 14 AND {STRONGEST} >= 0.3 THEN 'pretty sure' "
    f"WHEN {STRONGEST} >= 0.2 THEN 'might be a thing' ELSE 'not confident' END"
)
SIZE = "CASE WHEN abs(r0) >= 0.7 THEN 'Strong' WHEN abs(r0) >= 0.5 THEN 'Moderate' WHEN abs(r0) >= 0.3 THEN 'Weak' ELSE 'Very weak' END"
cte(
    "corr",
    f"SELECT *, m1 || '_vs_' || m2 AS pair, {CONFIDENCE} AS conf, coalesce(pp < 0.05, false) AS psig, "
    f"coalesce(sp < 0.05, false) AS ssig, {even('pr', 3)} AS r3, {even('pp', 4)} AS p4, "
    f"{even('sr', 3)} AS s3, {even('sp', 4)} AS sp4, "
    f"CASE WHEN coalesce(p0 < 0.05, false) THEN {SIZE} || ' ' || CASE WHEN r0 > 0 THEN 'positive' ELSE 'negative' END "
    "|| ' correlation' ELSE 'No significant relationship detected' END AS interp "
    "FROM (SELECT *, CASE WHEN abs(pr) >= abs(sr) THEN pr ELSE sr END AS r0, "
    "CASE WHEN abs(pr) >= abs(sr) THEN pp ELSE sp END AS p0 FROM corr0)",
)
cte(
    "lags",
    f"SELECT *, m1 || '_to_' || m2 || '_next_day' AS pair, {CONFIDENCE} AS conf, "
    "coalesce(pp < 0.05, false) AS psig, coalesce(sp < 0.05, false) AS ssig, "
    "CASE WHEN coalesce(pp < 0.05, false) THEN 'Higher ' || m1 || ' today ' || "
    "CASE WHEN abs(pr) >= 0.5 THEN 'strongly' WHEN abs(pr) >= 0.3 THEN 'moderately' ELSE 'slightly' END || ' ' || "
    "CASE WHEN pr > 0 THEN 'increases' ELSE 'decreases' END || ' ' || m2 || ' tomorrow' "
    "ELSE 'No significant next-day effect of ' || m1 || ' on ' || m2 END AS interp FROM lag0",
)
cte(
    "has",
    "SELECT DISTINCT e.pid, x.m FROM elig e JOIN dayl x ON x.pid = e.pid AND x.d = e.d",
)
cte("rolldays", "SELECT pid, d, row_number() OVER (PARTITION BY pid ORDER BY d) AS i FROM elig WHERE days >= 19")
cte(
    "roll",
    "SELECT t.pid, t.d, p.ord, p.m1, p.m2, count(s.a) AS n, "
    "CASE WHEN count(s.a) >= 7 THEN covar_pop(s.a, s.b) / nullif(stddev_pop(s.a) * stddev_pop(s.b), 0) END AS r "
    "FROM rolldays t CROSS JOIN pairs p "
    "JOIN has h1 ON h1.pid = t.pid AND h1.m = p.m1 JOIN has h2 ON h2.pid = t.pid AND h2.m = p.m2 "
    "JOIN rolldays w ON w.pid = t.pid AND w.i BETWEEN t.i - 14 AND t.i - 1 "
    "LEFT JOIN same s ON s.pid = t.pid AND s.d = w.d AND s.ord = p.ord "
    "WHERE t.i > 14 GROUP BY t.pid, t.d, p.ord, p.m1, p.m2",
)
cte(
    "trend",
    "SELECT pid, ord, m1, m2, m1 || '_vs_' || m2 AS pair, count(*) AS windows, count(r) AS valid, "
    "avg(r) AS mr, stddev_pop(r) AS sr, regr_slope(r, CASE WHEN r IS NOT NULL THEN i END) AS slope FROM ("
    "SELECT *, row_number() OVER (PARTITION BY pid, ord ORDER BY r IS NULL, d) - 1 AS i FROM roll) "
    "GROUP BY pid, ord, m1, m2 HAVING count(r) > 0",
)
TREND = (
    "CASE WHEN valid < 3 THEN 'insufficient_data' WHEN abs(slope) < 0.001 THEN 'stable' "
    "WHEN slope > 0.005 THEN 'strengthening' WHEN slope < -0.005 THEN 'weakening' ELSE 'stable' END"
)
cte(
    "bounds",
    "SELECT *, q1 - 2 * (q3 - q1) AS lo, q3 + 2 * (q3 - q1) AS hi, q1 - 1.5 * (q3 - q1) AS rlo, "
    "q3 + 1.5 * (q3 - q1) AS rhi FROM (SELECT x.pid, x.m, count(*) AS n, quantile_cont(v, 0.25) AS q1, "
    "quantile_cont(v, 0.75) AS q3 FROM dayl x JOIN elig e ON e.pid = x.pid AND e.d = x.d "
    "GROUP BY x.pid, x.m HAVING count(*) >= 7)",
)
cte(
    "anom0",
    "SELECT x.pid, x.m, x.d, x.v, b.n, b.lo, b.hi, b.rlo, b.rhi FROM dayl x JOIN bounds b USING (pid, m) "
    "WHERE x.v < b.lo OR x.v > b.hi",
)
cte(
    "later",
    "SELECT a.pid, a.m, a.d, s.k, e.d IS NULL AS gap, x.v BETWEEN a.rlo AND a.rhi AS back "
    "FROM anom0 a CROSS JOIN (SELECT unnest(range(1, 8)) AS k) s "
    "LEFT JOIN elig e ON e.pid = a.pid AND e.d = a.d + CAST(s.k AS INTEGER) "
    "LEFT JOIN dayl x ON x.pid = a.pid AND x.m = a.m AND x.d = a.d + CAST(s.k AS INTEGER)",
)
cte(
    "anom",
    "SELECT a.*, CASE WHEN l.back_at < l.gap_at THEN l.back_at END AS rec FROM anom0 a JOIN ("
    "SELECT pid, m, d, coalesce(min(k) FILTER (WHERE gap), 8) AS gap_at, min(k) FILTER (WHERE back) AS back_at "
    "FROM later GROUP BY pid, m, d) l USING (pid, m, d)",
)
cte("agaps", "SELECT *, d - lag(d) OVER (PARTITION BY pid, m ORDER BY d) AS gap FROM anom")
cte(
    "asum",
    f"SELECT *, {even('share', 1)} AS pct, {even('100.0 * recovered / c', 1)} AS rate FROM ("
    "SELECT pid, m, count(*) AS c, max(n) AS n, 100.0 * count(*) / max(n) AS share, count(rec) AS recovered, avg(rec) AS mrec, "
    "count(*) FILTER (WHERE gap <= 3) AS near_gaps, count(gap) AS gaps FROM agaps GROUP BY pid, m)",
)
cte(
    "series",
    "SELECT pid, m, 'primary' AS series, v1 AS v FROM good UNION ALL "
    "SELECT pid, m, 'secondary', v2 FROM good WHERE v2 IS NOT NULL",
)
cte(
    "base",
    f"SELECT *, {even('mean', 1)} AS mean1 FROM (SELECT pid, m, series, count(*) AS n, avg(v) AS mean, "
    "stddev_pop(v) AS sd, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS p25, median(v) AS med, "
    "quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90 FROM series GROUP BY pid, m, series) "
    "WHERE (pid, m) IN (SELECT (pid, m) FROM good GROUP BY pid, m HAVING count(*) >= 3)",
)
cte("prim", "SELECT * FROM base WHERE series = 'primary'")
cte("enough", "SELECT pid, m FROM good GROUP BY pid, m HAVING count(*) >= 3")
cte(
    "hours",
    "SELECT g.pid, g.m, hour(ts) AS h, avg(v1) AS mean FROM good g JOIN enough USING (pid, m) "
    "GROUP BY g.pid, g.m, hour(ts) HAVING count(*) >= 2",
)
cte(
    "hourly",
    "SELECT pid, m, arg_max(h, (mean, -h)) AS ph, max(mean) AS pv, arg_min(h, (mean, h)) AS lh, min(mean) AS lv "
    "FROM hours GROUP BY pid, m",
)
cte(
    "wdays",
    "SELECT g.pid, g.m, dayname(ts) AS wd, isodow(ts) AS dow, count(*) AS n, avg(v1) AS mean "
    "FROM good g JOIN enough USING (pid, m) GROUP BY ALL HAVING count(*) >= 2",
)
cte(
    "wext",
    "SELECT pid, m, count(*) AS n, arg_max(wd, (mean, -dow)) AS best, arg_min(wd, (mean, dow)) AS worst, max(mean) AS hi, min(mean) AS lo "
    "FROM wdays GROUP BY pid, m",
)
cte("morder", "SELECT m, ord + 1 AS ord FROM cfg")
cte(
    "finds",
    "SELECT pid, ord AS o, code, text FROM (SELECT p.*, ord, "
    f"CASE WHEN m = 'bp' AND mean1 >= {R.bp_attention} THEN 'bp_high' "
    f"WHEN m = 'hr' AND mean1 > {R.hr_attention} THEN 'hr_high' "
    f"WHEN m = 'steps' AND mean1 < {R.steps_attention} THEN 'steps_low' "
    f"WHEN m = 'sleep' AND mean1 < {R.sleep_attention} THEN 'sleep_low' "
    f"WHEN m = 'spo2' AND mean1 < {R.spo2_attention} THEN 'spo2_low' END AS code, "
    f"CASE m WHEN 'bp' THEN {say(FINDINGS['bp_high'], fixed('mean1', 1))} "
    f"WHEN 'hr' THEN {say(FINDINGS['hr_high'], fixed('mean1', 1))} "
    f"WHEN 'steps' THEN {say(FINDINGS['steps_low'], grouped('mean1'))} "
    f"WHEN 'sleep' THEN {say(FINDINGS['sleep_low'], fixed('mean1', 1))} "
    f"WHEN 'spo2' THEN {say(FINDINGS['spo2_low'], fixed('mean1', 1))} END AS text "
    "FROM prim p JOIN morder USING (m)) WHERE code IS NOT NULL",
)
cte(
    "cfinds",
    "SELECT pid, ord + 100 AS o, 'strong_relationship:' || pair AS code, "
    + say(
        FINDINGS["strong_relationship"],
        "m1",
        "m2",
        "CASE WHEN r3 > 0 THEN 'positively' ELSE 'negatively' END",
        fixed("r3", 2),
    )
    + " AS text FROM corr WHERE psig AND abs(r3) >= 0.5 AND conf IN ('solid', 'pretty sure')",
)
cte(
    "afinds",
    "SELECT pid, ord + 200 AS o, 'unusual_days:' || m AS code, "
    + say(FINDINGS["unusual_days"], "CAST(c AS VARCHAR)", "m", fixed("pct", 1))
    + f" AS text FROM asum JOIN morder USING (m) WHERE pct > {R.anomaly_share}",
)
cte("allfinds", "SELECT * FROM finds UNION ALL SELECT * FROM cfinds UNION ALL SELECT * FROM afinds")
cte(
    "peaks",
    "SELECT pid, code, CASE code "
    f"WHEN 'hr_morning_peak' THEN {say(BEHAVIOUR['hr_morning_peak'], 'CAST(ph AS VARCHAR)', fixed('pv', 1))} "
    f"WHEN 'hr_evening_peak' THEN {say(BEHAVIOUR['hr_evening_peak'], 'CAST(ph AS VARCHAR)', fixed('pv', 1))} "
    f"ELSE {say(BEHAVIOUR['bp_morning_peak'], 'CAST(ph AS VARCHAR)')} END AS text "
    "FROM (SELECT *, CASE WHEN m = 'hr' AND ph BETWEEN 6 AND 10 THEN 'hr_morning_peak' "
    "WHEN m = 'hr' AND ph BETWEEN 18 AND 22 THEN 'hr_evening_peak' "
    "WHEN m = 'bp' AND ph BETWEEN 6 AND 10 THEN 'bp_morning_peak' END AS code FROM hourly) WHERE code IS NOT NULL",
)
cte(
    "lagins",
    "SELECT pid, 'lag:' || pair AS code, interp AS text FROM lags WHERE psig AND conf IN ('solid', 'pretty sure')",
)
cte(
    "wins",
    "SELECT pid, code, CASE code "
    f"WHEN 'steps_weekdays' THEN {say(BEHAVIOUR['steps_weekdays'], 'best', grouped('hi'), 'worst', grouped('lo'))} "
    f"ELSE {say(BEHAVIOUR['sleep_weekend'], fixed('hi', 1), 'best', fixed('lo', 1), 'worst')} END AS text "
    "FROM (SELECT *, CASE WHEN m = 'steps' THEN 'steps_weekdays' "
    "WHEN m = 'sleep' AND best IN ('Saturday', 'Sunday') AND worst NOT IN ('Saturday', 'Sunday') "
    "THEN 'sleep_weekend' END AS code FROM wext WHERE n >= 5) WHERE code IS NOT NULL",
)


def advice(code: str, source: str, order: str, *figure: str, action_name: str | None = None) -> str:
    part = RECOMMENDATIONS[code]
    actions = [say(a, action_name) if action_name and "{}" in a else q(a) for a in part["actions"]]
    rank = {"High": 3, "Medium": 2, "Low": 1}[part["priority"]]
    joined = " || '; ' || ".join(actions)
    return (
        f"SELECT pid, {order} AS o, {q(code)} AS code, {q(part['category'])} AS category, "
        f"{q(part['priority'])} AS priority, {rank} AS rank, {q(part['target'])} AS target, "
        f"{joined} AS actions, {say(part['text'], *figure)} AS text FROM {source}"
    )


cte(
    "adv",
    " UNION ALL ".join(
        [
            advice("bp_high", f"prim JOIN morder USING (m) WHERE m = 'bp' AND mean1 >= {R.bp_attention}", "ord"),
            advice("steps_low", f"prim JOIN morder USING (m) WHERE m = 'steps' AND mean1 < {R.steps_goal}", "ord", grouped("mean1")),
            advice("sleep_low", f"prim JOIN morder USING (m) WHERE m = 'sleep' AND mean1 < {R.sleep_attention}", "ord", fixed("mean1", 1)),
            advice("steps_sleep", "corr WHERE pair = 'steps_vs_sleep' AND psig AND r3 > 0.3", "100"),
            advice("recovery_low", "asum JOIN morder USING (m) WHERE rate < 50", "ord + 200", "m", action_name="m"),
        ]
    ),
)
cte(
    "prog",
    f"SELECT pid, CASE {TREND} WHEN 'strengthening' THEN 'improvement:' WHEN 'weakening' THEN 'concern:' "
    f"ELSE 'stable:' END || pair AS code, CASE {TREND} "
    f"WHEN 'strengthening' THEN {say(PROGRESS['strengthening'], 'm1', 'm2')} "
    f"WHEN 'weakening' THEN {say(PROGRESS['weakening'], 'm1', 'm2')} ELSE 'stable' END AS text FROM trend "
    "UNION ALL SELECT pid, 'concern:' || m, "
    + say(PROGRESS["recent_anomalies"], "CAST(least(c, 7) AS VARCHAR)", "m")
    + " FROM asum",
)
cte(
    "summ",
    "SELECT p.pid, p.m AS code, CASE p.m "
    f"WHEN 'bp' THEN {say(SUMMARY['bp'], fixed('p.mean1', 1), 'coalesce(' + fixed('s.mean1', 1) + ', ' + q('N/A') + ')')} "
    f"WHEN 'hr' THEN {say(SUMMARY['hr'], fixed('p.mean1', 1))} "
    f"WHEN 'steps' THEN {say(SUMMARY['steps'], grouped('p.mean1'))} "
    f"WHEN 'sleep' THEN {say(SUMMARY['sleep'], fixed('p.mean1', 1))} "
    f"WHEN 'spo2' THEN {say(SUMMARY['spo2'], fixed('p.mean1', 1))} "
    f"WHEN 'temp' THEN {say(SUMMARY['temp'], fixed('p.mean1', 1))} END AS text "
    "FROM prim p LEFT JOIN base s ON s.pid = p.pid AND s.m = p.m AND s.series = 'secondary'",
)
cte(
    "bucket",
    "SELECT *, CASE WHEN bucket = 'weak' THEN stronger = 0 AND place <= 3 ELSE true END AS shown FROM ("
    "SELECT *, max(CASE WHEN bucket = 'weak' THEN 0 ELSE 1 END) OVER (PARTITION BY pid) AS stronger, "
    "row_number() OVER (PARTITION BY pid, bucket ORDER BY strength DESC, ord) AS place FROM ("
    "SELECT *, abs(r3) AS strength, CASE WHEN r3 > 0 THEN 'positive' ELSE 'negative' END AS direction, "
    "CASE WHEN abs(r3) >= 0.6 AND r3 > 0 THEN 'strong_positive' WHEN abs(r3) >= 0.6 THEN 'strong_negative' "
    "WHEN abs(r3) >= 0.3 THEN 'moderate' WHEN abs(r3) >= 0.1 THEN 'weak' END AS bucket "
    "FROM corr WHERE n >= 3 AND r3 IS NOT NULL) WHERE bucket IS NOT NULL)",
)
cte("spans", "SELECT pid, CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) AS e FROM cleaned GROUP BY pid")
cte(
    "comp",
    "SELECT *, "
    + even("greatest((expected - actual) / CAST(expected AS DOUBLE), 0.0)", 3)
    + " AS missing, "
    + even("least(good / CAST(expected AS DOUBLE) * 100.0, 100.0)", 1)
    + " AS score FROM (SELECT s.pid, c.m, s.e - s.s + 1 AS days, (s.e - s.s + 1) * c.per_day AS expected, "
    "count(x.pid) AS actual, count(x.pid) FILTER (WHERE x.flag = 'good') AS good "
    "FROM spans s CROSS JOIN cfg c LEFT JOIN cleaned x ON x.pid = s.pid AND x.m = c.m "
    "GROUP BY s.pid, c.m, s.s, s.e, c.per_day)",
)
GRADE = "CASE WHEN raw >= 90 THEN 'A' WHEN raw >= 80 THEN 'B' WHEN raw >= 70 THEN 'C' WHEN raw >= 60 THEN 'D' ELSE 'F' END"
cte(
    "overall",
    f"SELECT pid, round_even(tenths / 6.0::DOUBLE, 0) / 10.0::DOUBLE AS score, {GRADE} AS grade FROM ("
    "SELECT pid, sum(round_even(score * 10, 0)) AS tenths, sum(round_even(score * 10, 0)) / 60.0::DOUBLE AS raw "
    "FROM comp GROUP BY pid)",
)
cte(
    "dcomp",
    "SELECT p.pid, p.m, CAST(t.d AS DATE) AS d, c.per_day AS expected, count(x.pid) AS actual, "
    "count(x.pid) FILTER (WHERE x.flag = 'good') AS good, "
    + even("least(count(x.pid) FILTER (WHERE x.flag = 'good') / CAST(c.per_day AS DOUBLE) * 100.0, 100.0)", 1)
    + " AS pct FROM (SELECT DISTINCT pid, m FROM cleaned) p JOIN spans s USING (pid) JOIN cfg c USING (m) "
    "CROSS JOIN LATERAL (SELECT unnest(generate_series(CAST(s.s AS TIMESTAMP), CAST(s.e AS TIMESTAMP), INTERVAL 1 DAY)) AS d) t "
    "LEFT JOIN cleaned x ON x.pid = p.pid AND x.m = p.m AND CAST(x.ts AS DATE) = CAST(t.d AS DATE) "
    "GROUP BY p.pid, p.m, t.d, c.per_day",
)
cte(
    "meals",
    "SELECT 'participant-' || CAST(user_id // 8 AS VARCHAR) AS pid, 'dish-' || json_extract_string(props, '$.k') AS dish, "
    "epoch_ms(ts) AS t, CAST(ts AS DATE) AS d, ts FROM events WHERE event_type = 'purchase'",
)
cte(
    "named",
    "SELECT d, metric, avg(v) AS v FROM (SELECT CAST(ts AS DATE) AS d, CASE m WHEN 'bp' THEN 'systolic' "
    "WHEN 'steps' THEN 'steps' WHEN 'sleep' THEN 'sleep_duration' WHEN 'hr' THEN 'resting_hr' "
    "WHEN 'temp' THEN 'temperature' WHEN 'spo2' THEN 'spo2' END AS metric, v1 AS v FROM cleaned UNION ALL "
    "SELECT CAST(ts AS DATE), 'diastolic', v2 FROM cleaned WHERE m = 'bp' AND v2 IS NOT NULL) GROUP BY d, metric",
)
cte(
    "dstats",
    "SELECT metric, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, count(*) AS days "
    "FROM named GROUP BY metric HAVING count(*) >= 3 AND stddev_pop(v) > 0",
)
cte(
    "zdev",
    "SELECT d, metric, v, mean, (v - mean) / sd AS z FROM named JOIN dstats USING (metric) WHERE abs((v - mean) / sd) > 1.5",
)
cte(
    "pnamed",
    "SELECT pid, d, metric, avg(v) AS v FROM (SELECT pid, CAST(ts AS DATE) AS d, CASE m WHEN 'bp' THEN 'systolic' "
    "WHEN 'steps' THEN 'steps' WHEN 'sleep' THEN 'sleep_duration' WHEN 'hr' THEN 'resting_hr' "
    "WHEN 'temp' THEN 'temperature' WHEN 'spo2' THEN 'spo2' END AS metric, v1 AS v FROM cleaned UNION ALL "
    "SELECT pid, CAST(ts AS DATE), 'diastolic', v2 FROM cleaned WHERE m = 'bp' AND v2 IS NOT NULL) GROUP BY pid, d, metric",
)
LIMITS = "CASE m " + " ".join(
    f"WHEN '{m}' THEN v < {lo} OR v > {hi}" for m, (lo, hi) in S.deviation_limits.items()
) + " ELSE false END"
cte(
    "thr",
    f"SELECT * FROM (SELECT pid, d, m, v, bl, CASE WHEN bl = 0 THEN 0.0 ELSE (v - bl) / bl * 100 END AS pct, "
    f"{LIMITS} AS outside FROM (SELECT x.*, avg(v) OVER (PARTITION BY x.pid, m) AS bl FROM dayl x "
    "JOIN elig e ON e.pid = x.pid AND e.d = x.d)) WHERE abs(pct) > 10 OR outside",
)
cte(
    "cday",
    "SELECT d, m, round(CASE WHEN m = 'steps' THEN sum(v1) ELSE avg(v1) END, 9) AS v FROM good GROUP BY d, m",
)
cte(
    "files",
    "SELECT DISTINCT pid, m, CAST(ts AS DATE) AS d FROM rec",
)
cte(
    "pfiles",
    "SELECT pid, "
    + ", ".join(f"count(*) FILTER (WHERE m = '{m}') AS {m}_count" for m in METRICS)
    + ", count(*) AS total_files FROM files GROUP BY pid",
)
cte(
    "avail",
    " UNION ALL ".join(
        f"SELECT '{m}' AS m, count(*) FILTER (WHERE {m}_count > 0) AS participants FROM pfiles"
        for m in METRICS
    ),
)
cte(
    "ogap",
    "SELECT m, pid, ts, epoch_us(ts) AS us, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY m ORDER BY ts)) / 3.6e9 AS gap "
    "FROM cleaned WHERE flag = 'outlier'",
)
cte(
    "pogap",
    "SELECT m, pid, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY pid, m ORDER BY ts)) / 3.6e9 AS gap "
    "FROM cleaned WHERE flag = 'outlier'",
)
FLAGS = ["good", "outlier", "missing", "invalid", "duplicate", "interpolated"]
FLAG_COUNTS = ", ".join(f"count(*) FILTER (WHERE flag = '{f}') AS {f}" for f in FLAGS)
SHARE = r6("count(*) FILTER (WHERE flag = 'good') / CAST(count(*) AS DOUBLE) * 100.0", "{}")
cte("mq", f"SELECT m, count(*) AS total, count(DISTINCT pid) AS people, {FLAG_COUNTS}, "
    "count(*) FILTER (WHERE flag = 'good') / CAST(count(*) AS DOUBLE) * 100.0 AS share FROM cleaned GROUP BY m")
cte(
    "pmeans",
    "SELECT pid, m, avg(v1) AS v FROM good WHERE pid IN (SELECT pid FROM good GROUP BY pid HAVING count(DISTINCT m) >= 2) GROUP BY pid, m",
)
cte(
    "cpairs",
    "SELECT x.m AS m1, y.m AS m2, x.v AS a, y.v AS b FROM pmeans x JOIN pmeans y ON x.pid = y.pid AND x.m < y.m",
)
cte("cpairs_r", ranked("cpairs", "m1, m2"))
cte("ccorr", coefficients("cpairs_r", "m1, m2"))
cte(
    "minputs",
    "SELECT m, count(DISTINCT pid) AS people, count(*) AS n, avg(v1) AS mean, "
    f"count(*) FILTER (WHERE (m = 'bp' AND v1 >= {R.cohort_bp_high}) OR (m = 'steps' AND v1 >= {R.cohort_steps_goal})) AS over "
    "FROM good GROUP BY m",
)


def _needed(text: str) -> list[tuple[str, str]]:
    """The common table expressions a query uses, in order."""
    wanted: set[str] = set()
    pending = [text]
    names = dict(CTES)
    while pending:
        body = pending.pop()
        for word in set(re.findall(r"[a-z_0-9]+", body)):
            if word in names and word not in wanted and re.search(rf"(FROM|JOIN)\s+{word}\b", body):
                wanted.add(word)
                pending.append(names[word])
    return [(n, b) for n, b in CTES if n in wanted]


SQL: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    steps = _needed(text)
    head = "WITH " + ", ".join(f"{n} AS ({b})" for n, b in steps) + " " if steps else ""
    SQL[name] = head + text


# --- raw exports ---------------------------------------------------------------------

RAW = "'participant-' || CAST(user_id AS VARCHAR) AS participant_id, event_id AS row_pos"
EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"
KD = f"{K}"

sql("resolved_columns", f"SELECT {RAW}, {EPOCH} AS epoch_raw, {r6('value', 'value_1')}, {r6(KD, 'value_2')} FROM events")
sql(
    "sleep_totals",
    f"SELECT {RAW}, {EPOCH} AS epoch_raw, "
    + r6(
        f"(value + CASE WHEN event_type = 'view' THEN 0 ELSE {KD} END + CASE WHEN event_type = 'click' THEN 0 ELSE 12 END) / 60.0",
        "value_1",
    )
    + ", CAST(NULL AS DOUBLE) AS value_2 FROM events",
)
sql(
    "parsed_datetimes",
    f"SELECT {RAW}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, {r6('value', 'value_1')} FROM events WHERE event_type <> 'error'",
)
sql(
    "parsed_numbers",
    f"SELECT {RAW}, {EPOCH} AS epoch_raw, {r6('value', 'value_1')}, "
    + r6(f"CASE WHEN event_type = 'view' THEN NULL ELSE {KD} END", "value_2")
    + " FROM events WHERE event_type <> 'error'",
)
RAW_ROWS = "user_id, event_id, ts, value, event_type, props"
sql(
    "session_readings",
    f'SELECT {RAW}, {EPOCH} AS "logDateTime", {r6("value", chr(34) + "lastRate" + chr(34))}, CAST(NULL AS DOUBLE) AS "heartRate" '
    "FROM events WHERE event_type = 'signup' UNION ALL "
    f"SELECT {RAW}, {EPOCH} + 60, round(value + 1e-9, 6), round({KD} + 1e-9, 6) FROM events WHERE event_type <> 'signup' UNION ALL "
    f"SELECT {RAW}, {EPOCH} + 120, round(value + 1e-9, 6), round(value + 1 + 1e-9, 6) FROM events WHERE event_type <> 'signup'",
)
sql(
    "declared_records",
    f"SELECT {RAW}, {EPOCH} * 1000000 AS epoch_raw, {r6('value', 'value_1')}, {r6(KD, 'value_2')}, "
    "'bpm' AS unit, event_type AS device, 'good' AS quality_flag FROM events",
)
sql(
    "utc_times",
    "SELECT event_id AS row_pos, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS utc_time FROM events",
)
sql("aliased_columns", f"SELECT {RAW}, {r6('value', 'value')}, {r6(KD, 'second')} FROM events")
sql("parallel_array_rows", f"SELECT event_id // 500 AS file, event_id AS row_pos, {EPOCH} AS at, {r6('value', 'value')} FROM events")
sql(
    "nested_only_rows",
    f"SELECT {RAW}, {EPOCH} AS epoch_raw, {r6('value', 'value_1')}, {r6(KD, 'value_2')} FROM events",
)
sql(
    "file_dates",
    "SELECT CAST(min(ts) AS DATE) AS start, CAST(max(ts) AS DATE) AS end, "
    f"CAST(floor((max({EPOCH}) - min({EPOCH})) / 86400) AS BIGINT) AS span_days FROM events WHERE event_type <> 'view'",
)
sql("found_columns", f"SELECT p_partkey, {r6('p_retailprice', 'price')}, {r6('CAST(p_size AS DOUBLE)', 'size')} FROM part")
sql(
    "schema_problems",
    "SELECT 'bp' AS metric_type, 'Missing required columns: diastolic' AS problem UNION ALL "
    "SELECT 'bp', 'Invalid datetime format: ' || CAST(count(*) AS VARCHAR) || ' rows' FROM events "
    "WHERE event_type = 'error' HAVING count(*) > 0 UNION ALL "
    "SELECT 'weight', 'Unknown metric type: weight'",
)

# --- selecting and combining ------------------------------------------------------------

VIEW = f"pid AS participant_id, m AS metric_type, ep AS epoch_raw, {r6('v1', 'value_1')}, {r6('v2', 'value_2')}, pos AS row_pos"

sql(
    "flat_records",
    f"SELECT pid AS participant_id, m AS metric_type, ep AS datetime, {r6('v1', 'value_1')}, {r6('v2', 'value_2')}, "
    "'' AS unit, 'good' AS quality_flag, event_type, props FROM rec",
)
sql(
    "flat_records_by_path",
    f"SELECT pid AS participant_id, m AS metric_type, ep AS datetime, {r6('v1', 'value_1')}, event_type, props, "
    "CAST(NULL AS VARCHAR) AS device_id FROM rec",
)
sql(
    "calendar_parts",
    "SELECT pos AS row_pos, CAST(ts AS DATE) AS date, hour(ts) AS hour, dayname(ts) AS weekday, monthname(ts) AS month, "
    "strftime(ts, '%H:%M') AS clock, strftime(ts, '%Y-%m-%d') AS iso_date FROM rec",
)
sql("participant_records", f"SELECT {VIEW} FROM rec WHERE pid = 'participant-3'")
sql("metric_records", f"SELECT {VIEW} FROM rec WHERE m = 'hr'")
sql("participant_metric_records", f"SELECT {VIEW} FROM rec WHERE pid = 'participant-3' AND m = 'sleep'")
sql(
    "date_range_records",
    f"SELECT {VIEW} FROM rec WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'",
)
sql("quality_records", f"SELECT {VIEW}, flag AS quality_flag FROM cleaned WHERE flag IN ('outlier', 'invalid')")
sql("record_counts", "SELECT count(*) AS records, count(DISTINCT pid) AS participants, count(DISTINCT m) AS metrics FROM rec")
sql("distinct_participants", "SELECT DISTINCT pid AS participant_id FROM rec")
sql("distinct_metrics", "SELECT DISTINCT m AS metric_type FROM rec")
sql(
    "finding_severity",
    "SELECT pid AS participant_id, code, CASE WHEN regexp_matches(lower(text), 'elevated|high|low|below|above') "
    "THEN 'warning' ELSE 'info' END AS severity FROM allfinds",
)
sql(
    "appended_records",
    f"SELECT {VIEW} FROM rec UNION ALL SELECT {VIEW.replace('(v2)', '(CAST(NULL AS DOUBLE))')} FROM ev",
)
sql("common_dates", "SELECT d AS date FROM meals INTERSECT SELECT d FROM dayl")

# --- cleaning ---------------------------------------------------------------------------

sql(
    "duplicate_flags",
    "SELECT pos AS row_pos, pid AS participant_id, CASE WHEN rn > 1 THEN 'duplicate' ELSE 'good' END AS quality_flag FROM dup",
)
sql("range_flags", f"SELECT pos AS row_pos, m AS metric_type, CASE WHEN {IN_RANGE_BAD} THEN 'invalid' ELSE 'good' END AS quality_flag FROM rec")
sql(
    "bp_flags",
    f"SELECT pos AS row_pos, {r6('v1', 'value_1')}, {r6('v2', 'value_2')}, "
    f"CASE WHEN {IN_RANGE_BAD} THEN 'invalid' ELSE 'good' END AS quality_flag FROM rec WHERE m = 'bp'",
)
sql(
    "outlier_limits",
    f"SELECT pid AS participant_id, m AS metric_type, n1 AS n_1, {r6('mean1', 'mean_1')}, {r6('sd1', 'std_1')}, "
    f"{r6('q1a - k * (q3a - q1a)', 'lower_1')}, {r6('q3a + k * (q3a - q1a)', 'upper_1')}, n2 AS n_2, "
    f"{r6('mean2', 'mean_2')}, {r6('sd2', 'std_2')}, {r6('q1b - k * (q3b - q1b)', 'lower_2')}, "
    f"{r6('q3b + k * (q3b - q1b)', 'upper_2')} FROM lim JOIN cfg USING (m)",
)
sql("missing_flags", "SELECT pos AS row_pos, CASE WHEN m = 'temp' THEN 'missing' ELSE 'good' END AS quality_flag FROM rec")
sql("quality_flags", "SELECT pos AS row_pos, flag AS quality_flag FROM cleaned")
sql("time_ordered_records", f"SELECT {VIEW} FROM rec ORDER BY pid, m, ts, pos")
COUNTS = ", ".join(FLAGS)
sql("cleaning_stats", f"SELECT m AS metric_type, total AS total_records, {COUNTS}, {r6('share', 'good_percentage')} FROM mq")
sql(
    "range_lookup",
    f"SELECT pos AS row_pos, m AS metric_type, {r6('CAST(lo AS DOUBLE)', 'low')}, {r6('CAST(hi AS DOUBLE)', 'high')}, "
    f"{r6('CAST(zt AS DOUBLE)', 'z_threshold')}, {big('per_day', 'expected_per_day')}, unit AS config_unit FROM rec JOIN cfg USING (m)",
)

# --- quality and availability ---------------------------------------------------------------

sql(
    "overall_quality",
    "SELECT count(*) AS total_records, count(DISTINCT pid) AS total_participants, count(DISTINCT m) AS total_metrics, "
    f"{FLAG_COUNTS}, {SHARE.format('good_data_percentage')} FROM cleaned",
)
sql(
    "participant_quality",
    f"SELECT pid AS participant_id, count(*) AS total_records, {FLAG_COUNTS}, count(DISTINCT m) AS metrics_available, "
    f"{SHARE.format('good_data_percentage')} FROM cleaned GROUP BY pid",
)
sql(
    "metric_quality",
    f"SELECT m AS metric_type, total AS total_records, {COUNTS}, people AS participants_with_data, "
    f"{r6('share', 'good_data_percentage')} FROM mq",
)
sql("flag_distribution", "SELECT m AS metric_type, flag AS quality_flag, count(*) AS records FROM cleaned GROUP BY m, flag")
sql(
    "daily_quality",
    "SELECT CAST(ts AS DATE) AS date, count(*) AS total, count(*) FILTER (WHERE flag = 'good') AS good FROM cleaned GROUP BY 1",
)
sql(
    "date_range",
    'SELECT CAST(min(ts) AS DATE) AS start, CAST(max(ts) AS DATE) AS "end", '
    + big("CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) + 1", "days")
    + " FROM cleaned",
)
GOODS = "count(*) FILTER (WHERE flag = 'good') AS good_records"
sql(
    "quality_summary",
    "SELECT 'overall' AS level, CAST(NULL AS VARCHAR) AS participant_id, CAST(NULL AS VARCHAR) AS metric_type, "
    f"CAST(NULL AS VARCHAR) AS quality_flag, count(*) AS records, {GOODS} FROM cleaned UNION ALL "
    f"SELECT 'participant', pid, NULL, NULL, count(*), {GOODS} FROM cleaned GROUP BY pid UNION ALL "
    f"SELECT 'metric', NULL, m, NULL, count(*), {GOODS} FROM cleaned GROUP BY m UNION ALL "
    f"SELECT 'flag', NULL, m, flag, count(*), {GOODS} FROM cleaned GROUP BY m, flag",
)
sql(
    "participant_files",
    "SELECT pid AS participant_id, "
    + ", ".join(f"{m}_count > 0 AS has_{m}, {m}_count" for m in METRICS)
    + ", total_files FROM pfiles",
)
sql("file_count_histogram", "SELECT total_files, count(*) AS participants FROM pfiles GROUP BY total_files")
sql("metric_availability", "SELECT m AS metric_type, participants FROM avail")

# --- statistics -----------------------------------------------------------------------------

sql(
    "meals_summary",
    'SELECT count(*) AS record_count, count(DISTINCT dish) AS unique_dishes, min(d) AS start, max(d) AS "end" FROM meals',
)
sql("table_summary", "SELECT count(*) AS record_count, 'p_type,p_size,p_retailprice' AS metrics FROM part")


def quant(v: str, p: float, alias: str) -> str:
    return r6(f"quantile_cont({v}, {p})", alias)


sql(
    "metric_statistics",
    f"SELECT m AS metric_type, count(*) AS count, {r6('avg(v1)', 'mean')}, {r6('median(v1)', 'median')}, "
    f"{r6('stddev_pop(v1)', 'std')}, {r6('min(v1)', 'min')}, {r6('max(v1)', 'max')}, "
    f"{r6('quantile_cont(v1, 0.75) - quantile_cont(v1, 0.25)', 'iqr')}, "
    + ", ".join(quant("v1", p / 100, f"p{p}") for p in (25, 50, 75, 90, 95))
    + f", {r6('avg(v2)', 'secondary_mean')}, {r6('median(v2)', 'secondary_median')}, "
    f"{r6('stddev_pop(v2)', 'secondary_std')} FROM good GROUP BY m",
)
OUT = "FILTER (WHERE flag = 'outlier')"
OK = "FILTER (WHERE flag = 'good')"
sql(
    "metric_noise",
    f"SELECT m AS metric_type, count(*) AS total_records, count(*) {OK} AS good_records, count(*) {OUT} AS outlier_records, "
    f"{r6(f'avg(v1) {OK}', 'good_mean')}, {r6(f'stddev_pop(v1) {OK}', 'good_std')}, "
    f"{r6(f'max(v1) {OK} - min(v1) {OK}', 'good_range')}, {r6(f'avg(v1) {OUT}', 'outlier_mean')}, "
    f"{r6(f'stddev_pop(v1) {OUT}', 'outlier_std')}, {r6(f'max(v1) {OUT} - min(v1) {OUT}', 'outlier_range')}, "
    f"{r6(f'count(*) {OUT} / CAST(count(*) AS DOUBLE)', 'noise_ratio')}, "
    + r6(f"stddev_pop(v1) {OK} / avg(v1) {OK}", "good_cv")
    + " FROM cleaned GROUP BY m",
)
sql(
    "calendar_profiles",
    f"SELECT m AS metric_type, 'weekday' AS profile, dayname(ts) AS label, {r6('avg(v1)', 'mean')} FROM good GROUP BY ALL UNION ALL "
    "SELECT m, 'month', monthname(ts), round(avg(v1) + 1e-9, 6) FROM good GROUP BY ALL",
)
sql(
    "health_baselines",
    f"SELECT pid AS participant_id, m AS metric_type, series, n AS count, {r6('mean', 'mean')}, {r6('sd', 'std')}, "
    f"{r6('p10', 'lower')}, {r6('p25', 'p25')}, {r6('med', 'median')}, {r6('p75', 'p75')}, {r6('p90', 'upper')} FROM base",
)
BANDS = (
    "CASE WHEN series = 'secondary' THEN 'Within measured range' "
    f"WHEN m = 'bp' THEN CASE WHEN mean1 < {R.bp_bands[0]} THEN 'Normal blood pressure range' "
    f"WHEN mean1 < {R.bp_bands[1]} THEN 'Elevated blood pressure' WHEN mean1 < {R.bp_bands[2]} "
    "THEN 'Stage 1 hypertension range' ELSE 'Stage 2 hypertension range' END "
    f"WHEN m = 'hr' THEN CASE WHEN mean1 < {R.hr_bands[0]} THEN 'Below normal resting heart rate (bradycardia)' "
    f"WHEN mean1 < {R.hr_bands[1]} THEN 'Normal resting heart rate' ELSE 'Elevated resting heart rate (tachycardia)' END "
    f"WHEN m = 'temp' THEN CASE WHEN mean1 BETWEEN {R.temp_bands[0]} AND {R.temp_bands[1]} THEN 'Normal body temperature' "
    f"WHEN mean1 > {R.temp_bands[1]} THEN 'Slightly elevated temperature' ELSE 'Slightly low temperature' END "
    f"WHEN m = 'sleep' THEN CASE WHEN mean1 BETWEEN {R.sleep_bands[0]} AND {R.sleep_bands[1]} THEN 'Optimal sleep duration' "
    f"WHEN mean1 < {R.sleep_bands[0]} THEN 'Below recommended sleep duration' ELSE 'Above typical sleep duration' END "
    f"WHEN m = 'steps' THEN CASE WHEN mean1 >= {R.steps_bands[0]} THEN 'Highly active lifestyle' "
    f"WHEN mean1 >= {R.steps_bands[1]} THEN 'Moderately active lifestyle' WHEN mean1 >= {R.steps_bands[2]} "
    "THEN 'Somewhat active lifestyle' ELSE 'Sedentary lifestyle' END ELSE 'Within measured range' END"
)
sql("baseline_bands", f"SELECT pid AS participant_id, m AS metric_type, series, {BANDS} AS interpretation FROM base")
sql(
    "hourly_pattern",
    f"SELECT pid AS participant_id, m AS metric_type, {big('ph', 'peak_hour')}, {r6('pv', 'peak_value')}, "
    f"{big('lh', 'low_hour')}, {r6('lv', 'low_value')} FROM hourly",
)
sql("weekday_pattern", f"SELECT pid AS participant_id, m AS metric_type, wd AS weekday, n AS readings, {r6('mean', 'mean')} FROM wdays")
sql("daily_values", f"SELECT pid AS participant_id, d AS date, m AS metric_type, {r6('v', 'value')}, n AS readings FROM dayl")
WIDE = ", ".join(r6(f"max(v) FILTER (WHERE m = '{m}')", m) for m in METRICS)
sql("daily_wide", f"SELECT pid AS participant_id, d AS date, {WIDE} FROM dayl GROUP BY pid, d")
sql("daily_named_means", f"SELECT d AS date, metric, {r6('v', 'value')} FROM named")


def mean_of(m: str, v: str, alias: str) -> str:
    return r6(f"avg({v}) FILTER (WHERE m = '{m}')", alias)


sql(
    "headline_means",
    "SELECT "
    + ", ".join(
        [
            mean_of("hr", "v1", "avg_hr"),
            mean_of("bp", "v1", "avg_systolic"),
            mean_of("bp", "v2", "avg_diastolic"),
            mean_of("steps", "v1", "avg_steps"),
            mean_of("sleep", "v1", "avg_sleep"),
            mean_of("spo2", "v1", "avg_spo2"),
            mean_of("temp", "v1", "avg_temp"),
        ]
    )
    + " FROM good",
)
sql(
    "fuzzy_means",
    f"SELECT {r6('avg(p_retailprice)', 'avg_price')}, {r6('avg(p_size)', 'avg_size')}, CAST(NULL AS DOUBLE) AS avg_protein FROM part",
)


def daily_meals_sql(keys: str, selected: str) -> str:
    return (
        f"SELECT {selected}, d AS date, strftime(ts, '%H:%M') AS meal_time, dish, count(*) AS servings, min(before) + 1 AS first_position "
        f"FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY t) - 1 AS before FROM meals) GROUP BY {keys}, t, dish, strftime(ts, '%H:%M')"
    )


sql("daily_meals", daily_meals_sql("d", "").replace("SELECT , d", "SELECT d", 1))
sql("participant_daily_meals", daily_meals_sql("pid, d", "pid AS participant_id"))
sql(
    "correlation_data_summary",
    'SELECT e.pid AS participant_id, min(e.d) AS start, max(e.d) AS "end", count(*) AS total_days, '
    "max(h.ms) AS available_metrics FROM elig e JOIN (SELECT pid, array_to_string(list(m ORDER BY ord), ',') AS ms "
    "FROM has JOIN morder USING (m) GROUP BY pid) h ON h.pid = e.pid GROUP BY e.pid",
)
sql(
    "metric_insight_inputs",
    f"SELECT m AS metric_type, people AS participants, n AS readings, {r6('mean', 'mean')}, over AS over_limit, "
    f"{r6('over / CAST(n AS DOUBLE) * 100.0', 'over_limit_pct')} FROM minputs",
)
PCT = fixed("over / CAST(n AS DOUBLE) * 100.0", 1)
sql(
    "cohort_insights",
    "SELECT 'cohort_size' AS insight_code, 'Cohort includes ' || count(DISTINCT pid) || ' participants with ' || count(DISTINCT m) "
    "|| ' different health metrics.' AS insight FROM cleaned UNION ALL "
    "SELECT 'overall_quality', 'Overall data quality: ' || "
    + fixed("count(*) FILTER (WHERE flag = 'good') / CAST(count(*) AS DOUBLE) * 100.0", 1)
    + " || '% of records passed quality checks.' FROM cleaned UNION ALL "
    f"SELECT 'bp_high_share', 'Blood pressure: ' || {PCT} || '% of readings show elevated systolic pressure (≥140 mmHg).' "
    "FROM minputs WHERE m = 'bp' AND over > 0 UNION ALL "
    f"SELECT 'hr_elevated', 'Heart rate: Cohort average of ' || {fixed('mean', 0)} || ' bpm indicates elevated resting heart rate.' "
    f"FROM minputs WHERE m = 'hr' AND mean > {R.cohort_hr[1]} UNION ALL "
    f"SELECT 'hr_fit', 'Heart rate: Cohort average of ' || {fixed('mean', 0)} || ' bpm suggests good cardiovascular fitness.' "
    f"FROM minputs WHERE m = 'hr' AND mean < {R.cohort_hr[0]} UNION ALL "
    f"SELECT 'steps_goal_share', 'Physical activity: ' || {PCT} || '% of days meet the 10,000 steps guideline.' "
    "FROM minputs WHERE m = 'steps' AND over > 0 UNION ALL "
    f"SELECT 'sleep_short', 'Sleep: Cohort averages ' || {fixed('mean', 1)} || ' hours per night, below recommended 7-9 hours.' "
    f"FROM minputs WHERE m = 'sleep' AND mean < {R.cohort_sleep[0]} UNION ALL "
    f"SELECT 'sleep_long', 'Sleep: Cohort averages ' || {fixed('mean', 1)} || ' hours per night, above typical range.' "
    f"FROM minputs WHERE m = 'sleep' AND mean > {R.cohort_sleep[1]}",
)
sql(
    "report_metadata",
    "SELECT count(*) AS total_records, count(DISTINCT pid) AS total_participants, "
    "array_to_string(list(DISTINCT m ORDER BY m), ',') AS metrics_analyzed FROM cleaned",
)

# --- compliance ----------------------------------------------------------------------------

sql(
    "participant_spans",
    'SELECT pid AS participant_id, s AS start, e AS "end", ' + big("e - s + 1", "total_days") + " FROM spans",
)
sql(
    "metric_compliance",
    f"SELECT pid AS participant_id, m AS metric_type, {big('days', 'total_days')}, {big('expected', 'expected_records')}, "
    f"actual AS actual_records, good AS good_records, {r6('missing', 'missingness_ratio')}, {r6('score', 'compliance_score')} FROM comp",
)
sql(
    "daily_compliance",
    f"SELECT pid AS participant_id, m AS metric_type, d AS date, {big('expected', 'expected')}, actual, good, "
    f"{r6('pct', 'compliance_percentage')} FROM dcomp",
)
sql(
    "daily_compliance_summary",
    f"SELECT pid AS participant_id, m AS metric_type, {r6('avg(pct)', 'mean_compliance')}, {r6('median(pct)', 'median_compliance')}, "
    f"{r6('min(pct)', 'min_compliance')}, {r6('max(pct)', 'max_compliance')}, {r6('stddev_pop(pct)', 'std_compliance')} "
    "FROM dcomp GROUP BY pid, m",
)
sql("overall_compliance", f"SELECT pid AS participant_id, {r6('score', 'score')}, grade FROM overall")
DIST = (
    f"count(*) AS participants, {r6('avg(score)', 'mean')}, {r6('median(score)', 'median')}, {r6('stddev_pop(score)', 'std')}, "
    f"{quant('score', 0.25, 'q25')}, {quant('score', 0.75, 'q75')}"
)
sql(
    "cohort_compliance",
    f"SELECT 'overall' AS scope, {DIST} FROM overall UNION ALL SELECT m, {DIST} FROM comp GROUP BY m",
)

# --- noise and windows ------------------------------------------------------------------------

sql(
    "outlier_gaps",
    f"SELECT m AS metric_type, us AS at_micros, {r6('gap', 'gap_hours')}, count(*) AS times FROM ogap "
    "WHERE gap IS NOT NULL GROUP BY m, us, gap",
)


def clustering(source: str, keys: str, selected: str) -> str:
    return (
        f"SELECT {selected}, count(*) AS outliers, "
        + r6("count(*) FILTER (WHERE gap <= 24) / CAST(nullif(count(gap), 0) AS DOUBLE)", "clustering_ratio")
        + f", {r6('avg(gap)', 'mean_gap_hours')}, {r6('median(gap)', 'median_gap_hours')}, "
        "coalesce(count(*) FILTER (WHERE gap <= 24) / CAST(nullif(count(gap), 0) AS DOUBLE) > 0.3, false) AS clustering_detected "
        f"FROM {source} GROUP BY {keys}"
    )


sql("outlier_clustering", clustering("ogap", "m", "m AS metric_type"))
sql(
    "participant_outlier_clustering",
    clustering("pogap", "pid, m", "pid AS participant_id, m AS metric_type"),
)
sql(
    "next_day_values",
    "SELECT n.pid AS participant_id, n.d AS date, "
    + ", ".join(r6(f"max(x.v) FILTER (WHERE x.m = '{m}')", f"{m}_next") for m in METRICS)
    + " FROM (SELECT pid, d, lead(d) OVER (PARTITION BY pid ORDER BY d) AS nd FROM pdays) n "
    "LEFT JOIN dayl x ON x.pid = n.pid AND x.d = n.nd GROUP BY n.pid, n.d",
)
sql(
    "average_ranks",
    f"SELECT pid AS participant_id, d AS date, m1 AS metric_1, m2 AS metric_2, {r6('ra', 'rank_a')}, {r6('rb', 'rank_b')} FROM same_r",
)
sql(
    "rolling_correlations",
    f"SELECT pid AS participant_id, d AS date, m1 AS metric_1, m2 AS metric_2, n AS valid_days, {r6('r', 'r')} FROM roll",
)
sql(
    "rolling_summary",
    f"SELECT pid AS participant_id, pair, windows, valid AS valid_windows, {r6('mr', 'mean_correlation')}, "
    f"{r6('sr', 'std_correlation')} FROM trend",
)
sql(
    "rolling_trends",
    f"SELECT pid AS participant_id, pair, {TREND} AS trend, "
    f"{r6('CASE WHEN valid >= 3 THEN slope END', 'slope')}, {r6('CASE WHEN valid >= 3 THEN slope * valid END', 'strength_change')} FROM trend",
)
sql("anomaly_gaps", f"SELECT pid AS participant_id, m AS metric_type, d AS date, {big('gap', 'gap_days')} FROM agaps")

# --- correlation ----------------------------------------------------------------------------------

COEF = (
    f"{r6('pr', 'pearson_r')}, {r6('pp', 'pearson_p')}, coalesce(pp < 0.05, false) AS pearson_significant, "
    f"{r6('sr', 'spearman_r')}, {r6('sp', 'spearman_p')}, coalesce(sp < 0.05, false) AS spearman_significant"
)
sql("eligible_days", "SELECT pid AS participant_id, d AS date, days FROM elig")
sql("daily_correlations", f"SELECT pid AS participant_id, m1 || '_vs_' || m2 AS pair, n AS n_days, {COEF} FROM corr0")
sql(
    "lag_correlations",
    f"SELECT pid AS participant_id, m1 || '_to_' || m2 || '_next_day' AS pair, n AS n_days, {COEF} FROM lag0",
)
sql("confidence_levels", "SELECT pid AS participant_id, pair, conf AS confidence FROM corr")
sql("interpretations", "SELECT pid AS participant_id, pair, interp AS interpretation FROM corr")
sql("lag_interpretations", "SELECT pid AS participant_id, pair, conf AS confidence, interp AS interpretation FROM lags")
sql("cohort_correlations", f"SELECT m1 || '_vs_' || m2 AS pair, n AS n_participants, {COEF} FROM ccorr")
sql(
    "correlation_totals",
    "SELECT count(*) AS total_correlations, count(*) FILTER (WHERE psig) AS total_significant, "
    + r6("count(*) FILTER (WHERE psig) / CAST(count(*) AS DOUBLE) * 100.0", "significant_pct")
    + " FROM corr",
)

# --- anomalies and deviations --------------------------------------------------------------------------

sql(
    "anomaly_bounds",
    f'SELECT pid AS participant_id, m AS metric_type, n AS "values", {r6("lo", "lower")}, {r6("hi", "upper")}, '
    f"{r6('rlo', 'recovery_lower')}, {r6('rhi', 'recovery_upper')} FROM bounds",
)
sql(
    "anomaly_days",
    f'SELECT pid AS participant_id, m AS metric_type, d AS date, {r6("v", "value")}, n AS "values", '
    f"{r6('lo', 'lower')}, {r6('hi', 'upper')} FROM anom",
)
sql("recovery_days", f"SELECT pid AS participant_id, m AS metric_type, d AS date, {big('rec', 'recovered_after')} FROM anom")
sql(
    "recovery_summary",
    f"SELECT pid AS participant_id, m AS metric_type, {r6('avg(rec)', 'mean_recovery_days')}, "
    f"{r6('median(rec)', 'median_recovery_days')}, {r6('count(rec) / CAST(count(*) AS DOUBLE) * 100.0', 'recovery_rate')} "
    "FROM anom GROUP BY pid, m",
)
sql(
    "anomaly_insights",
    f"SELECT pid AS participant_id, m AS metric_type, c AS anomaly_count, {r6('pct', 'anomaly_percentage')}, "
    "CASE WHEN share > 15 THEN 'frequent' WHEN share > 5 THEN 'occasional' ELSE 'rare' END AS frequency_code, "
    "CASE WHEN rate > 80 THEN 'quick_recovery' WHEN rate > 50 THEN 'moderate_recovery' ELSE 'slow_recovery' END AS recovery_code, "
    "c > 1 AND near_gaps > gaps * 0.5 AS clustered, "
    "CASE WHEN share > 15 THEN 'Frequent' WHEN share > 5 THEN 'Occasional' ELSE 'Rare' END || ' ' || m || ' anomalies detected (' || "
    f"{fixed('share', 0)} || '% of days); ' || "
    f"CASE WHEN rate > 80 THEN 'Quick recovery typical (average ' || {fixed(even('mrec', 1), 0)} || ' days)' "
    f"WHEN rate > 50 THEN 'Moderate recovery patterns (average ' || {fixed(even('mrec', 1), 0)} || ' days)' "
    "ELSE 'Slow or incomplete recovery from anomalies' END || "
    "CASE WHEN c > 1 AND near_gaps > gaps * 0.5 THEN '; Anomalies tend to cluster together' ELSE '' END AS sentences FROM asum",
)
sql(
    "deviation_stats",
    f"SELECT metric, {r6('mean', 'mean')}, {r6('sd', 'std')}, {r6('lo', 'min')}, {r6('hi', 'max')}, days FROM dstats",
)
ZDEV = (
    f"metric, {r6('v', 'value')}, {r6('mean', 'mean')}, {r6('z', 'z_score')}, "
    "CASE WHEN z > 0 THEN 'above' ELSE 'below' END AS direction"
)
sql("z_deviations", f"SELECT d AS date, {ZDEV} FROM zdev")
sql(
    "participant_z_deviations",
    f"SELECT pid AS participant_id, d AS date, {ZDEV} FROM (SELECT *, (v - mean) / nullif(sd, 0) AS z FROM ("
    "SELECT *, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS sd, count(*) OVER w AS n FROM pnamed "
    "WINDOW w AS (PARTITION BY pid, metric)) WHERE n >= 3) WHERE abs(z) > 1.5",
)
sql(
    "deviation_day_meals",
    "SELECT x.d AS date, strftime(x.ts, '%H:%M') AS meal_time, x.dish, count(*) AS servings, max(z.ms) AS deviating_metrics FROM meals x JOIN ("
    "SELECT d, array_to_string(list(metric ORDER BY metric), ',') AS ms FROM zdev GROUP BY d) z ON z.d = x.d GROUP BY x.d, strftime(x.ts, '%H:%M'), x.dish",
)
THR = f"d AS date, m AS metric_type, {r6('v', 'value')}, {r6('bl', 'baseline')}, {r6('pct', 'deviation_pct')}, outside AS outside_threshold"
sql("threshold_deviations", f"SELECT pid AS participant_id, {THR} FROM thr")
sql(
    "cohort_threshold_deviations",
    f"SELECT {THR} FROM (SELECT *, CASE WHEN bl = 0 THEN 0.0 ELSE (v - bl) / bl * 100 END AS pct, {LIMITS} AS outside "
    "FROM (SELECT *, avg(v) OVER (PARTITION BY m) AS bl FROM cday) "
    "WHERE (SELECT count(DISTINCT d) FROM cday) >= 7) WHERE abs(pct) > 10 OR outside",
)
sql(
    "threshold_deviation_meals",
    "SELECT t.pid AS participant_id, t.d AS date, t.ms AS metrics, x.mt AS meal_time, x.dish, coalesce(x.n, 0) AS servings FROM ("
    "SELECT pid, d, array_to_string(list(m ORDER BY m), ',') AS ms FROM thr GROUP BY pid, d) t "
    "LEFT JOIN (SELECT pid, d, strftime(ts, '%H:%M') AS mt, dish, count(*) AS n FROM meals GROUP BY ALL) x ON x.pid = t.pid AND x.d = t.d",
)
sql(
    "deviating_days",
    "SELECT t.pid || '/' || CAST(t.d AS VARCHAR) AS day_id, t.pid AS participant_id, t.d AS date, coalesce(x.n, 0) AS meals, "
    f"t.n AS deviating_metrics, t.ms AS metrics, {r6('t.v', 'first_value')}, {r6('t.pct', 'first_pct')} FROM ("
    "SELECT pid, d, count(*) AS n, array_to_string(list(m || CASE WHEN outside THEN '!' ELSE '' END ORDER BY m), ',') AS ms, "
    "arg_min(v, m) AS v, arg_min(pct, m) AS pct FROM thr GROUP BY pid, d) t "
    "LEFT JOIN (SELECT pid, d, count(*) AS n FROM meals GROUP BY ALL) x ON x.pid = t.pid AND x.d = t.d",
)
sql(
    "deviating_day_dishes",
    "SELECT t.pid || '/' || CAST(t.d AS VARCHAR) AS day_id, t.pid AS participant_id, t.d AS date, strftime(x.ts, '%H:%M') AS meal_time, "
    "x.dish, count(*) AS servings FROM (SELECT DISTINCT pid, d FROM thr) t JOIN meals x ON x.pid = t.pid AND x.d = t.d GROUP BY ALL",
)


def shown(value: str) -> str:
    return (
        f"CASE WHEN metric IN ('systolic', 'diastolic') THEN {fixed(value, 0)} || ' mmHg' WHEN metric = 'resting_hr' THEN {fixed(value, 0)} || ' bpm' "
        f"WHEN metric = 'sleep_duration' THEN {fixed(value, 1)} || ' hours' WHEN metric = 'steps' THEN {fixed(value, 0)} || ' steps' "
        f"WHEN metric = 'spo2' THEN {fixed(value, 0)} || '%' ELSE {fixed(value, 1)} || '°C' END"
    )


sql(
    "deviation_report",
    f"SELECT z.d AS date, {ZDEV}, coalesce(x.n, 0) AS meals, coalesce(x.named, 'No meals recorded') AS meals_text, "
    + r6("CASE WHEN mean = 0 THEN 0 ELSE (v - mean) / mean * 100 END", "deviation_pct")
    + ", CASE WHEN abs((v - mean) / mean * 100) > 20 OR abs(z) > 1.5 THEN 'severe' ELSE 'mild' END AS severity, "
    f"{shown('v')} AS display_value, {shown('mean')} AS display_baseline "
    "FROM zdev z LEFT JOIN (SELECT d, n, named || CASE WHEN n > 50 THEN ' and ' || CAST(n - 50 AS VARCHAR) || ' more' ELSE '' END AS named "
    "FROM (SELECT d, max(n) AS n, string_agg(dish, ', ' ORDER BY i) FILTER (WHERE i <= 50) AS named FROM ("
    "SELECT d, dish, row_number() OVER (PARTITION BY d ORDER BY t, dish) AS i, count(*) OVER (PARTITION BY d) AS n FROM meals) GROUP BY d)) x ON x.d = z.d",
)

# --- meals and top lists -----------------------------------------------------------------------------

RECENT = "(SELECT d FROM (SELECT d FROM meals INTERSECT SELECT d FROM cday) ORDER BY d DESC LIMIT 5)"
sql("recent_common_dates", f"SELECT d AS date FROM {RECENT} t")
sql(
    "meal_interactions",
    "SELECT x.d AS date, x.mt AS meal_time, x.dish, x.servings, "
    + ", ".join(r6(f"w.{m}", m) for m in METRICS)
    + " FROM (SELECT d, strftime(ts, '%H:%M') AS mt, dish, count(*) AS servings FROM meals GROUP BY ALL) x JOIN (SELECT d, "
    + ", ".join(f"max(v) FILTER (WHERE m = '{m}') AS {m}" for m in METRICS)
    + f" FROM cday GROUP BY d) w ON w.d = x.d WHERE x.d IN {RECENT}",
)
sql("top_dishes", "SELECT dish, count(*) AS servings FROM meals GROUP BY dish ORDER BY servings DESC, dish LIMIT 5")
sql(
    "ranked_correlations",
    "SELECT pid AS participant_id, pair, row_number() OVER (PARTITION BY pid ORDER BY abs(coalesce(r3, 0)) DESC, ord) AS rank, "
    f"{r6('r3', 'pearson_r3')} FROM corr",
)
sql(
    "top_weak_correlations",
    f"SELECT pid AS participant_id, pair, place, {r6('strength', 'strength')} FROM bucket WHERE bucket = 'weak' AND place <= 3",
)
sql(
    "first_anomalies",
    f"SELECT pid AS participant_id, m AS metric_type, place, d AS date, {r6('v', 'value')}, greatest(c - 3, 0) AS more FROM ("
    "SELECT *, row_number() OVER (PARTITION BY pid, m ORDER BY d) AS place, count(*) OVER (PARTITION BY pid, m) AS c FROM anom) "
    "WHERE place <= 3",
)

# --- insights ---------------------------------------------------------------------------------------------

TEXT = "pid AS participant_id, code, text"
sql("health_summary", f"SELECT {TEXT} FROM summ")
sql(
    "data_quality_score",
    "SELECT pid AS participant_id, count(*) AS metrics_tracked, CAST(sum(n) AS BIGINT) AS total_records, "
    "CAST(floor(CASE WHEN sum(n) > 100 THEN least(100.0, count(*) / 6.0::DOUBLE * 100.0::DOUBLE * 1.1::DOUBLE) "
    "ELSE count(*) / 6.0::DOUBLE * 100.0::DOUBLE END) AS BIGINT) AS data_quality_score FROM prim GROUP BY pid",
)
sql("baseline_findings", f"SELECT {TEXT} FROM finds")
sql("correlation_findings", f"SELECT {TEXT} FROM cfinds")
sql("anomaly_findings", f"SELECT {TEXT} FROM afinds")
FAMILY = "SELECT pid AS participant_id, '{}' AS family, code, text FROM {}"
FAMILIES = [
    ("health_summary", "summ"),
    ("key_findings", "allfinds"),
    ("behavioral_insights", "peaks"),
    ("behavioral_insights", "lagins"),
    ("behavioral_insights", "wins"),
    ("recommendations", "adv"),
    ("progress_tracking", "prog"),
]
sql("peak_hour_insights", FAMILY.format("behavioral_insights", "peaks"))
sql("lag_insights", f"SELECT {TEXT} FROM lagins")
sql("weekday_insights", FAMILY.format("behavioral_insights", "wins"))
sql("recommendations", "SELECT pid AS participant_id, code, category, priority, target, actions, text AS recommendation FROM adv")
sql(
    "recommendations_by_priority",
    f"SELECT pid AS participant_id, {big('rank', 'priority_rank')}, {big('o', 'item_order')}, code FROM adv ORDER BY pid, rank DESC, o",
)
sql(
    "priority_groups",
    f"SELECT pid AS participant_id, priority, {big('max(rank)', 'priority_rank')}, count(*) AS recommendations FROM adv GROUP BY pid, priority",
)
sql("progress_insights", f"SELECT {TEXT} FROM prog")
sql("all_insights", " UNION ALL ".join(FAMILY.format(*family) for family in FAMILIES))


def part(name: str, item: str, figure: str, text: str, source: str) -> str:
    return (
        f"SELECT pid AS participant_id, {q(name)} AS part, {item} AS item, "
        f"round(CAST({figure} AS DOUBLE) + 1e-9, 6) + 0.0 AS figure, {text} AS text FROM {source}"
    )


sql(
    "participant_assembly",
    " UNION ALL ".join(
        [
            part("person", "pid", "count(*)", "NULL", "(SELECT DISTINCT pid FROM cleaned) GROUP BY pid"),
            part(
                "data_period",
                "CAST(min(d) AS VARCHAR) || ' to ' || CAST(max(d) AS VARCHAR)",
                "count(DISTINCT d)",
                "array_to_string(list(DISTINCT m ORDER BY m), ',')",
                "dayl WHERE pid IN (SELECT pid FROM elig) GROUP BY pid",
            ),
            part("health_baselines", "m || '/' || series", "mean1", f"CAST(n AS VARCHAR) || ' readings, ' || {fixed(even('sd', 2), 2)}", "base"),
            part("hourly_patterns", "m", even("pv", 1), "CAST(ph AS VARCHAR) || ' to ' || CAST(lh AS VARCHAR)", "hourly"),
            part("weekly_patterns", "m || '/' || wd", "mean", "NULL", "wdays"),
            part("daily", "pair", "r3", "conf || ': ' || interp", "corr"),
            part("lag_effects", "pair", "n", "conf || ': ' || interp", "lags"),
            part("rolling_trends", "pair", even("mr", 3), TREND, "trend"),
            part(
                "anomalies",
                "m",
                "pct",
                "(SELECT array_to_string(list(CAST(d AS VARCHAR) ORDER BY d), ',') FROM anom0 a WHERE a.pid = s.pid AND a.m = s.m)",
                "asum s",
            ),
            part("recommendations", "code", "rank", "category || '/' || priority || '/' || target || '/' || actions", "adv"),
            *[
                part("insights", f"'{family}/' || code", "1", "text", source)
                for family, source in FAMILIES
                if family != "recommendations"
            ],
        ]
    ),
)

# --- report tables ------------------------------------------------------------------------------------------

sql(
    "participant_overview",
    "SELECT p.pid AS participant_id, p.n AS total_records, least(p.n, 100) AS quality_score, p.c AS metrics, f.codes AS finding_codes, "
    "coalesce(f.texts, 'No significant findings') AS findings "
    "FROM (SELECT pid, CAST(sum(n) AS BIGINT) AS n, count(*) AS c FROM prim GROUP BY pid) p LEFT JOIN ("
    "SELECT pid, array_to_string(list(code ORDER BY o, code)[1:2], '; ') AS codes, array_to_string(list(text ORDER BY o, code)[1:2], '; ') AS texts FROM allfinds GROUP BY pid) f USING (pid)",
)
sql(
    "quality_tiers",
    f"SELECT m AS metric_type, total AS total_records, good AS good_records, {r6('share', 'good_data_percentage')}, "
    "CASE WHEN share >= 80 THEN 'high' WHEN share >= 50 THEN 'medium' ELSE 'low' END AS quality_tier FROM mq",
)
sql(
    "data_coverage",
    "SELECT count(*) FILTER (WHERE participants > 0) AS available_metrics, "
    + r6("count(*) FILTER (WHERE participants > 0) / 6.0 * 100.0", "data_coverage")
    + " FROM avail",
)
sql(
    "correlation_matrix",
    "SELECT participant_id, metric_type, "
    + ", ".join(
        r6(f"coalesce(max(v) FILTER (WHERE other = '{m}'), 0.0)", m) for m in METRICS
    )
    + " FROM (SELECT pid AS participant_id, m1 AS metric_type, m2 AS other, r3 AS v FROM corr UNION ALL "
    "SELECT pid, m2, m1, r3 FROM corr UNION ALL SELECT pid, m1, m1, 1.0 FROM corr UNION ALL SELECT pid, m2, m2, 1.0 FROM corr) "
    "GROUP BY participant_id, metric_type",
)
sql(
    "correlation_buckets",
    f"SELECT pid AS participant_id, pair, {r6('strength', 'strength')}, direction, bucket, shown FROM bucket",
)
BADGE = "CASE WHEN psig THEN 'significant' WHEN conf = 'pretty sure' THEN 'likely' ELSE 'emerging' END"
CODE = "direction || '_' || CASE WHEN strength >= 0.7 THEN 'high' ELSE 'medium' END"
sql(
    "pattern_badges",
    f"SELECT pid AS participant_id, pair, {BADGE} AS badge, {CODE} AS explanation_code, CASE {BADGE} "
    + " ".join(f"WHEN '{c}' THEN {q(t)}" for c, t in BADGES.items())
    + f" END AS badge_text, CASE {CODE} "
    + " ".join(f"WHEN '{a}_{b}' THEN {q(t)}" for (a, b), t in EXPLANATIONS.items())
    + " END AS explanation FROM bucket",
)
HAS_STEPS, HAS_SLEEP = "'steps' IN (m1, m2)", "'sleep' IN (m1, m2)"
HAS_HR, HAS_TEMP = "'hr' IN (m1, m2)", "'temp' IN (m1, m2)"
STRONG3 = "coalesce(greatest(abs(r3), abs(s3)), 0)"
CARD_LABEL = "CASE WHEN abs(r3) >= 0.7 THEN 'strong' WHEN abs(r3) >= 0.4 THEN 'moderate' ELSE 'weak' END"
CARD_SIGN = "CASE WHEN r3 > 0 THEN 'positive' ELSE 'negative' END"
CARD_WORDS = "CASE WHEN p4 < 0.05 THEN 'statistically significant' WHEN p4 < 0.1 THEN 'marginally significant' ELSE 'not statistically significant' END"
CARD_MAIN = (
    f"CASE WHEN p4 < 0.05 THEN {say(CARD_TEXTS['clear'], CARD_LABEL, CARD_SIGN, 'm1', 'm2', fixed('r3', 3), fixed('p4', 4), CARD_WORDS)} "
    f"ELSE {say(CARD_TEXTS['unclear'], CARD_LABEL, CARD_SIGN, 'm1', 'm2', fixed('r3', 3), CARD_WORDS, fixed('p4', 4))} END"
)
CARD_CONTEXT = (
    f"CASE WHEN {HAS_STEPS} AND {HAS_SLEEP} AND r3 > 0 THEN {q(CARD_TEXTS['steps_sleep_positive'])} "
    f"WHEN {HAS_STEPS} AND {HAS_SLEEP} THEN {q(CARD_TEXTS['steps_sleep_negative'])} "
    f"WHEN {HAS_HR} AND {HAS_STEPS} AND r3 > 0 THEN {q(CARD_TEXTS['steps_hr'])} "
    f"WHEN {HAS_HR} AND {HAS_TEMP} THEN {q(CARD_TEXTS['hr_temp'])} ELSE '' END"
)
CARD_NOTE = f"CASE WHEN n < 10 THEN {q(CARD_TEXTS['small'])} WHEN n < 20 THEN {q(CARD_TEXTS['moderate'])} ELSE {q(CARD_TEXTS['good'])} END"
sql(
    "correlation_cards",
    "SELECT pid AS participant_id, pair, n AS n_days, CASE WHEN psig OR ssig THEN 'Significant' "
    "WHEN coalesce(p4 < 0.1 OR sp4 < 0.1, false) THEN 'Marginal' ELSE 'Not Significant' END AS significance_badge, "
    f"CASE WHEN {STRONG3} >= 0.7 THEN 'Strong' WHEN {STRONG3} >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength, "
    "CASE WHEN n < 10 THEN 'small' WHEN n < 20 THEN 'moderate' ELSE 'good' END AS sample_note, "
    f"CASE WHEN {HAS_STEPS} AND {HAS_SLEEP} AND r3 > 0 THEN 'steps_sleep_positive' "
    f"WHEN {HAS_STEPS} AND {HAS_SLEEP} THEN 'steps_sleep_negative' "
    f"WHEN {HAS_HR} AND {HAS_STEPS} AND r3 > 0 THEN 'steps_hr' WHEN {HAS_HR} AND {HAS_TEMP} THEN 'hr_temp' END AS context_code, conf AS confidence, "
    f"{CARD_MAIN} || {CARD_CONTEXT} || {CARD_NOTE} AS interpretation FROM corr",
)
sql(
    "correlation_counts",
    "SELECT pid AS participant_id, count(*) AS total_tests, count(*) FILTER (WHERE psig OR ssig) AS significant_count, "
    "count(*) FILTER (WHERE conf IN ('might be a thing', 'pretty sure')) AS potential_trends, "
    + r6("count(*) FILTER (WHERE psig OR ssig) / CAST(count(*) AS DOUBLE) * 100.0", "success_rate")
    + " FROM corr GROUP BY pid",
)
sql(
    "significant_correlations",
    f"SELECT pid AS participant_id, m1 AS metric_1, m2 AS metric_2, {r6('r3', 'strength')}, {r6('p4', 'p_value')}, "
    "CASE WHEN abs(r3) >= 0.7 THEN 'high' WHEN abs(r3) >= 0.4 THEN 'medium' ELSE 'low' END AS strength_tier FROM corr WHERE psig",
)
OVERVIEW = [
    ("steps", "Steps", "avg/day"),
    ("hr", "Heart Rate", "avg bpm"),
    ("sleep", "Sleep", "avg hours"),
    ("bp", "Blood Pressure", "avg mmHg"),
    ("spo2", "SpO2", "avg %"),
    ("temp", "Temperature", "avg °F"),
]
sql(
    "metrics_overview",
    f"SELECT p.pid AS participant_id, t.m AS metric_type, t.title, t.unit, {r6('b.mean1', 'mean')} "
    "FROM (SELECT DISTINCT pid FROM prim) p CROSS JOIN (VALUES "
    + ", ".join(f"('{m}', '{title}', '{unit}')" for m, title, unit in OVERVIEW)
    + ") t(m, title, unit) LEFT JOIN prim b ON b.pid = p.pid AND b.m = t.m",
)
sql(
    "cohort_totals",
    "SELECT 'participants' AS item, count(DISTINCT pid) AS n FROM cleaned UNION ALL "
    "SELECT 'findings', count(*) FROM allfinds UNION ALL SELECT 'recommendations', count(*) FROM adv",
)
sql(
    "completeness_tiers",
    f"SELECT pid AS participant_id, {r6('score', 'score')}, grade, "
    "CASE WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS completeness_tier FROM overall",
)
TITLES = [
    ("bp", "Blood Pressure"),
    ("sleep", "Sleep Quality"),
    ("steps", "Step Count"),
    ("hr", "Heart Rate"),
    ("spo2", "Blood Oxygen"),
    ("temp", "Temperature"),
]
sql(
    "data_types_table",
    "SELECT t.m AS metric_type, t.title, a.participants > 0 AS available, coalesce(q.total, 0) AS total_records, "
    f"{r6('coalesce(q.share, 0.0)', 'good_data_percentage')}, coalesce(q.people, 0) AS participants_with_data FROM (VALUES "
    + ", ".join(f"('{m}', '{t}')" for m, t in TITLES)
    + ") t(m, title) JOIN avail a ON a.m = t.m LEFT JOIN mq q ON q.m = t.m",
)
sql(
    "source_availability",
    "SELECT 'physio' AS source, count(*) > 0 AS available FROM rec UNION ALL SELECT 'meals', count(*) > 0 FROM meals UNION ALL "
    "SELECT 'lungs', count(*) > 0 FROM part",
)


def headline(title: str, expr: str, digits: int, unit: str, source: str) -> str:
    text = f"coalesce({fixed(expr, digits)}, 'N/A')"
    return f"SELECT '{title}' AS title, {r6(expr, 'value')}, {text} AS text, '{unit}' AS unit FROM {source}"


NOTHING = "CAST(NULL AS DOUBLE)"
sql(
    "headline_table",
    " UNION ALL ".join(
        [
            headline("Heart Rate", "avg(v1)", 0, "bpm", "good WHERE m = 'hr'"),
            headline("Systolic", "avg(v1)", 0, "mmHg", "good WHERE m = 'bp'"),
            headline("Diastolic", "avg(v2)", 0, "mmHg", "good WHERE m = 'bp'"),
            headline("Steps", "avg(v1)", 0, "steps/day", "good WHERE m = 'steps'"),
            headline("Sleep", "avg(v1)", 1, "hours/day", "good WHERE m = 'sleep'"),
            headline("SpO2", "avg(v1)", 0, "%", "good WHERE m = 'spo2'"),
            headline("Temperature", "avg(v1)", 1, "°F", "good WHERE m = 'temp'"),
            headline("Calories", f"max({NOTHING})", 0, "kcal/day", "part"),
            headline("Protein", f"max({NOTHING})", 1, "g/day", "part"),
            headline("Carbs", f"max({NOTHING})", 1, "g/day", "part"),
            headline("Fat", "avg(p_size)", 1, "g/day", "part"),
            headline("FEV1", "avg(p_retailprice)", 2, "L", "part"),
            headline("FVC", f"max({NOTHING})", 2, "L", "part"),
        ]
    ),
)
