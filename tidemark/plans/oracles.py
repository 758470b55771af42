"""DuckDB SQL for the registered queries, written on its own: as-of joins, QUALIFY, range joins, lateral lists."""

from __future__ import annotations

EV = "ev AS (SELECT *, (user_id % 5)::VARCHAR AS eva FROM events)"
OBS = "obs AS (SELECT user_id AS key, ts AS obs, ts + to_seconds(floor(value)::BIGINT) AS ct, CASE WHEN event_type = 'error' THEN 'c' END AS cs, (user_id % 5)::VARCHAR AS eva FROM events)"
PLAN = """plan AS (
  SELECT (user_id % 5)::VARCHAR AS eva, event_id || '-1' AS stop_id, CASE WHEN event_type = 'view' AND later = 0 THEN 'ar' ELSE 'dp' END AS event, user_id::VARCHAR AS trip, user_id AS key, ts + to_minutes(later) AS pt,
    (event_id % 4)::VARCHAR AS pp, CASE WHEN event_id % 5 <> 0 THEN 'L' || (event_id % 6) END AS line,
    CASE WHEN later > 0 THEN 'S' || (event_id % 5) || '|S' || (event_id % 7 + 1) || '|S' || (event_id % 9 + 2) || '|S' || (event_id % 11 + 4) || '|S' || (event_id % 13 + 1) || '|S' || (event_id % 6 + 8)
      WHEN event_id % 17 <> 0 THEN 'S' || (event_id % 7) || '|S' || (event_id % 11 + 3) || CASE WHEN event_id % 3 = 0 THEN '|S' || (event_id % 13 + 5) ELSE '' END END AS path,
    CASE WHEN event_id % 19 = 0 THEN ((user_id + 1) % 150)::VARCHAR END AS wings, CASE WHEN event_id % 13 = 0 THEN (event_id + 1) || '-1' END AS tra,
    ['RE', 'S', 'ICE', 'Bus'][event_id % 4 + 1] AS cat, event_id::VARCHAR AS num, ts - to_minutes(event_id % 90) AS first_seen
  FROM events, (VALUES (0), (3)) v(later) WHERE event_type IN ('view', 'purchase') AND (later = 0 OR event_type = 'view' AND event_id % 4 = 1))"""
HUBS = "hubs AS (SELECT r_regionkey::VARCHAR AS eva, r_name AS hub FROM region)"
SPAN = "span AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)"
SEGMENT = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} = 'S' THEN 'S-Bahn' WHEN {0} = 'ICE' THEN 'long-distance' ELSE 'regional' END"


def mins(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 60000000.0::DOUBLE)"


def li(p: str) -> str:
    return f"list_filter(string_split(coalesce({p}, ''), '|'), lambda x: x <> '')"


PAIRS = f"""{PLAN}, {HUBS},
onward AS (SELECT stop_id, {li("max(path)")} AS cont FROM plan WHERE event = 'dp' AND eva IN (SELECT eva FROM hubs) GROUP BY stop_id),
judged AS (
  SELECT a.eva, a.stop_id AS sa, b.stop_id AS sb, a.trip AS ta, b.trip AS tb, a.key AS ka, b.key AS kb, a.pt AS pta, b.pt AS ptb, a.cat AS ca, b.cat AS cb, a.line AS la, a.num AS na, b.line AS lb, b.num AS nb,
    {li("a.path")} AS pa, {li("b.path")} AS pb, a.first_seen AS fa, b.first_seen AS fb, {mins("b.pt", "a.pt")} AS slack,
    coalesce(a.cat = 'Bus', false) OR coalesce(b.cat = 'Bus', false) AS r1, coalesce(a.trip = b.trip, false) AS r2,
    coalesce(a.tra = b.stop_id, false) OR coalesce(regexp_replace(a.tra, '-[0-9]+$', '') = b.trip, false) AS r3,
    coalesce(list_contains({li("a.wings")}, b.trip), false) OR coalesce(list_contains({li("b.wings")}, a.trip), false) AS r4,
    coalesce(len({li("a.path")}) > 0 AND list_contains({li("b.path")}, {li("a.path")}[-1]), false) AS r5,
    coalesce(len(o.cont) > 0 AND len({li("b.path")}) > 0 AND len(list_filter({li("b.path")}, lambda x: NOT list_contains(o.cont, x))) = 0, false) AS r6, coalesce(o.cont, []) AS cont
  FROM plan a JOIN plan b ON a.eva = b.eva AND a.event = 'ar' AND b.event = 'dp' AND b.pt >= a.pt + INTERVAL 4 MINUTE AND b.pt <= a.pt + INTERVAL 60 MINUTE LEFT JOIN onward o ON o.stop_id = a.stop_id
  WHERE a.eva IN (SELECT eva FROM hubs)),
good AS (SELECT * FROM judged WHERE NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6)),
reached AS (
  SELECT g.eva, g.sa, g.sb, g.ptb, s.station FROM good g, unnest(g.pb) AS s(station) WHERE NOT list_contains(g.pa, s.station) AND NOT list_contains(g.cont, s.station)),
kept AS (
  SELECT DISTINCT eva, sa, sb FROM reached r WHERE NOT EXISTS (SELECT 1 FROM reached e WHERE e.eva = r.eva AND e.sa = r.sa AND e.station = r.station AND e.ptb < r.ptb)),
cand AS (SELECT g.*, h.hub FROM good g JOIN kept USING (eva, sa, sb) JOIN hubs h ON h.eva = g.eva)"""

LABELLED = f"""{PAIRS}, {OBS},
final AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY key ORDER BY obs DESC, ct DESC NULLS LAST, cs DESC NULLS LAST) = 1),
lab AS (
  SELECT c.*, coalesce(a.cs = 'c', false) AS ac, coalesce(b.cs = 'c', false) AS bc, {mins("b.ct", "a.ct")} AS real_slack, {mins("a.ct", "c.pta")} AS a_final, a.obs AS ao, a.ct AS act, b.obs AS bo, b.ct AS bct
  FROM cand c LEFT JOIN final a ON a.key = c.ka LEFT JOIN final b ON b.key = c.kb),
cuts AS (SELECT l.*, cutoff_min, l.pta - to_minutes(cutoff_min) AS t_cut FROM lab l, (VALUES (60), (30), (10)) v(cutoff_min)),
sta AS (SELECT c.*, o.obs AS sao, o.ct AS sact, o.cs AS sacs FROM cuts c ASOF LEFT JOIN obs o ON c.ka = o.key AND c.t_cut >= o.obs),
stb AS (SELECT c.*, o.ct AS sbct, o.cs AS sbcs FROM sta c ASOF LEFT JOIN obs o ON c.kb = o.key AND c.t_cut >= o.obs),
stp AS (SELECT c.*, p.obs AS poll FROM stb c ASOF LEFT JOIN obs p ON c.eva = p.eva AND c.t_cut >= p.obs),
ds AS (
  SELECT *, ac OR bc OR coalesce(real_slack < 4, false) AS fail, {mins("coalesce(sact, pta)", "pta")} AS da, {mins("coalesce(sbct, ptb)", "ptb")} AS db, {mins("coalesce(sbct, ptb)", "coalesce(sact, pta)")} AS dslack,
    {mins("t_cut", "poll")} AS poll_age, coalesce(sbcs = 'c', false) AS known,
    CASE WHEN fa > t_cut OR fb > t_cut THEN 'not_known_at_cutoff' WHEN poll IS NULL OR {mins("t_cut", "poll")} > 45 THEN 'collector_gap' WHEN sacs = 'c' THEN 'a_cancelled_at_cutoff'
      WHEN NOT ((act IS NOT NULL OR ac) AND (bct IS NOT NULL OR bc)) THEN 'unobserved'
      WHEN coalesce(NOT ac AND ao < act, false) OR coalesce(NOT bc AND bo < bct, false) THEN 'stale_label' WHEN na::BIGINT % 23 = 0 THEN 'dst_ambiguous' END AS reason
  FROM stp)"""

VIEWS = f"""{OBS},
q AS (SELECT event_id, user_id AS key, ts, value, c AS cutoff_min, ts - to_minutes(c) AS t_cut FROM events, (VALUES (60), (30), (10)) v(c) WHERE event_type = 'view'),
st AS (SELECT q.*, o.obs, o.ct, o.cs FROM q ASOF LEFT JOIN obs o ON q.key = o.key AND q.t_cut >= o.obs)"""

GRID = f"""{PLAN}, {OBS},
g AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, pt - INTERVAL 30 MINUTE + INTERVAL 299999999 MICROSECOND), pt + INTERVAL 60 MINUTE, INTERVAL 5 MINUTE)) AS g FROM plan),
seen AS (SELECT * FROM g WHERE first_seen <= g),
gs AS (
  SELECT s.*, coalesce(o.cs = 'c', false) AS cancel, {mins("coalesce(o.ct, s.pt)", "s.pt")} AS delay FROM seen s ASOF LEFT JOIN obs o ON s.key = o.key AND s.g >= o.obs),
hub AS (
  SELECT eva, g, avg(cancel::INT) AS share_cancel, avg(delay) FILTER (NOT cancel) AS mean_delay, avg((delay >= 5)::INT) FILTER (NOT cancel) AS share_late
  FROM gs WHERE pt BETWEEN g - INTERVAL 30 MINUTE AND g + INTERVAL 30 MINUTE GROUP BY eva, g),
line AS (SELECT eva, g, line, avg(delay) AS line_delay FROM gs WHERE event = 'ar' AND pt <= g AND pt > g - INTERVAL 60 MINUTE AND NOT cancel AND line IS NOT NULL GROUP BY eva, g, line),
rows_ AS (SELECT stop_id, eva, line, path, key, pt, first_seen, pt - INTERVAL 30 MINUTE AS t_cut, time_bucket(INTERVAL 5 MINUTE, pt - INTERVAL 30 MINUTE) AS gg FROM plan WHERE event = 'ar')"""

ROWS = f"{PLAN}, {OBS}, rows_ AS (SELECT stop_id, key, pt, pt - INTERVAL 30 MINUTE AS t_cut FROM plan WHERE event = 'ar')"

MSGS = """msgs AS (
  SELECT user_id AS key, ts, string_split(unnest(string_split(event_type[1] || ':' || (props->>'$.k') || CASE WHEN event_id % 4 = 0 THEN '|h:7' ELSE '' END, '|')), ':') AS m FROM events),
firsts AS (SELECT key, m[1] AS type, m[2] AS code, min(ts) AS obs FROM msgs GROUP BY ALL)"""

PRED = """pred AS (
  SELECT l_orderkey, l_linenumber, ((round(l_discount * 100) * 7 + l_quantity + l_linenumber * 3) % 97 + 1) / 99.0::DOUBLE AS p_model, ((round(l_tax * 100) * 11 + l_quantity) % 89 + 1) / 91.0::DOUBLE AS p_base,
    (l_returnflag = 'R')::INT AS label, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS day, [60, 30, 10][l_linenumber % 3 + 1] AS cutoff_min, o_orderpriority AS priority, l_linestatus AS status, (l_quantity > 30)::INT AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def ll(p: str, y: str = "label") -> str:
    q = f"greatest(1e-6, least(1 - 1e-6, {p}::DOUBLE))"
    return f"(-({y} * ln({q}) + (1 - {y}) * ln(1 - {q})))"


def ranks(score: str, group: str) -> str:
    """Average rank of a score in its group, from the counts of smaller and equal ones."""
    return f"(rank() OVER (PARTITION BY {group} ORDER BY {score}) + (count(*) OVER (PARTITION BY {group}, {score}) - 1) / 2.0::DOUBLE)"


def area(r: str, y: str) -> str:
    return f"((sum({r}) FILTER ({y} = 1) - count(*) FILTER ({y} = 1) * (count(*) FILTER ({y} = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER ({y} = 1) * count(*) FILTER ({y} = 0), 0)::DOUBLE)"


BERLIN = "timezone('Europe/Berlin', timezone('UTC', {0}))"  # the local clock of a UTC timestamp

ORACLES: dict[str, str] = {
    "asof_failure_rate": f"""WITH {VIEWS}
SELECT cutoff_min, CASE WHEN obs IS NULL THEN 'unobserved' WHEN cs = 'c' THEN 'a_cancelled_at_cutoff' WHEN {mins("t_cut", "obs")} > 1440 THEN 'stale_label' ELSE 'none' END AS reason,
  count(*) AS n, round(avg((value > 60)::INT), 6) AS fail_rate, round(avg({mins("t_cut", "obs")}), 6) AS mean_age_min, round(avg({mins("coalesce(ct, ts)", "ts")}), 6) AS mean_delay_min FROM st GROUP BY ALL""",
    "asof_states": f"WITH {VIEWS} SELECT event_id, cutoff_min, epoch_us(obs) AS obs_us, epoch_us(ct) AS ct_us, cs FROM st",
    "last_poll_by_hub": f"""WITH {EV}, q AS (SELECT event_id, eva, ts - INTERVAL 30 MINUTE AS t FROM ev WHERE event_type = 'purchase'), p AS (SELECT eva, ts FROM ev WHERE event_type = 'click')
SELECT event_id, epoch_us(p.ts) AS poll_us, coalesce(p.ts >= q.t - INTERVAL 15 MINUTE, false) AS fresh FROM q ASOF LEFT JOIN p ON q.eva = p.eva AND q.t >= p.ts""",
    "plan_latest_versions": """WITH v AS (SELECT *, row(l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_tax) AS o FROM lineitem)
SELECT l_orderkey, arg_max(CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END, CASE WHEN l_partkey % 3 <> 0 THEN o END) AS brand,
  arg_max(CASE WHEN l_suppkey % 4 <> 0 THEN round(l_tax * 100)::BIGINT END, CASE WHEN l_suppkey % 4 <> 0 THEN o END) AS tax, arg_max(l_returnflag, o) AS flag, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen FROM v GROUP BY l_orderkey""",
    "final_states": f"WITH {OBS} SELECT key, epoch_us(obs) AS obs_us, epoch_us(ct) AS ct_us, cs FROM obs QUALIFY row_number() OVER (PARTITION BY key ORDER BY obs DESC, ct DESC NULLS LAST, cs DESC NULLS LAST) = 1",
    "polls_and_span": f"WITH {OBS} SELECT eva, count(DISTINCT date_trunc('minute', obs)) AS polls, epoch_us(date_trunc('minute', min(obs))) AS first_us, epoch_us(date_trunc('minute', max(obs))) AS last_us FROM obs GROUP BY eva",
    "realtime_coverage": f"WITH {PLAN}, {OBS} SELECT CASE WHEN cat = 'Bus' THEN 'bus' ELSE 'train' END AS kind, count(*) AS events, round(avg((key IN (SELECT key FROM obs WHERE cs IS NULL))::INT), 6) AS observed FROM plan GROUP BY ALL",
    "interval_pairs": f"""WITH {PLAN}, p AS (SELECT a.eva, {mins("b.pt", "a.pt")} AS s FROM plan a JOIN plan b ON a.eva = b.eva AND a.event = 'ar' AND b.event = 'dp' AND b.pt BETWEEN a.pt + INTERVAL 5 MINUTE AND a.pt + INTERVAL 90 MINUTE AND a.trip IS DISTINCT FROM b.trip)
SELECT eva, CASE WHEN s < 10 THEN 0 WHEN s < 20 THEN 1 WHEN s < 30 THEN 2 WHEN s < 60 THEN 3 ELSE 4 END AS bucket, count(*) AS pairs, round(avg(s), 6) AS mean_slack FROM p GROUP BY ALL""",
    "candidate_funnel": f"""WITH {PAIRS}, steps AS (
  SELECT eva, 'window' AS step FROM judged UNION ALL SELECT eva, 'T1 bus' FROM judged WHERE NOT r1 UNION ALL SELECT eva, 'T2 same trip' FROM judged WHERE NOT (r1 OR r2)
  UNION ALL SELECT eva, 'T3 transition' FROM judged WHERE NOT (r1 OR r2 OR r3) UNION ALL SELECT eva, 'T4 wings' FROM judged WHERE NOT (r1 OR r2 OR r3 OR r4)
  UNION ALL SELECT eva, 'T5 backtrack' FROM judged WHERE NOT (r1 OR r2 OR r3 OR r4 OR r5) UNION ALL SELECT eva, 'T6 redundant' FROM good UNION ALL SELECT eva, 'T7 first reach' FROM cand),
names AS (SELECT unnest(['window', 'T1 bus', 'T2 same trip', 'T3 transition', 'T4 wings', 'T5 backtrack', 'T6 redundant', 'T7 first reach']) AS step),
per AS (SELECT h.hub, n.step, count(s.eva) AS pairs FROM hubs h CROSS JOIN names n LEFT JOIN steps s ON s.eva = h.eva AND s.step = n.step GROUP BY ALL)
SELECT hub, step, pairs FROM per UNION ALL SELECT 'total', step, sum(pairs)::BIGINT FROM per GROUP BY step""",
    "transfer_candidates": f"""WITH {PAIRS} SELECT hub, sa AS stop_id_a, sb AS stop_id_b, round(slack, 6) AS planned_slack_min, {SEGMENT.format("ca")} AS segment_a, {SEGMENT.format("cb")} AS segment_b, pa[1] AS origin_a, pa[-1] AS prev_station_a,
  len(pa) AS n_before, pb[1] AS next_station_b, pb[-1] AS destination_b, len(pb) AS n_after FROM cand""",
    "dataset_rows": f"""WITH {LABELLED} SELECT sa AS stop_id_a, sb AS stop_id_b, cutoff_min, fail AS label_fail, CASE WHEN ac THEN 'a_cancelled' WHEN bc THEN 'b_cancelled' WHEN real_slack < 4 THEN 'delay' ELSE 'none' END AS fail_reason,
  reason AS exclusion_reason, reason IS NULL AS eligible, known AS b_cancel_known, round(da * 6e7)::BIGINT AS db_delay_a_us, round(db * 6e7)::BIGINT AS db_delay_b_us, round(dslack * 6e7)::BIGINT AS db_slack_us, round(real_slack * 6e7)::BIGINT AS real_slack_us, round(poll_age * 6e7)::BIGINT AS collector_age_us FROM ds""",
    "dataset_summary": f"""WITH {LABELLED}, e AS (SELECT *, fail::INT AS y, {ranks("-round(slack, 6)", "cutoff_min")} AS rp, {ranks("CASE WHEN known THEN 1e9 ELSE -round(dslack, 6) END", "cutoff_min")} AS rd FROM ds WHERE reason IS NULL)
SELECT d.cutoff_min, d.rows, d.eligible, round(d.fail_pct, 6) AS fail_pct, round(a.ap, 6) AS auc_planned, round(a.ad, 6) AS auc_predicted
FROM (SELECT cutoff_min, count(*) AS rows, count(*) FILTER (reason IS NULL) AS eligible, round(100 * avg(fail::INT) FILTER (reason IS NULL), 4) AS fail_pct FROM ds GROUP BY cutoff_min) d
LEFT JOIN (SELECT cutoff_min, {area("rp", "y")} AS ap, {area("rd", "y")} AS ad FROM e GROUP BY cutoff_min) a USING (cutoff_min)""",
    "dataset_exclusions": f"WITH {LABELLED} SELECT cutoff_min, coalesce(reason, 'none') AS reason, count(*) AS rows FROM ds GROUP BY ALL",
    "label_sensitivity": f"WITH {LABELLED} SELECT m AS min_transfer, count(*) AS pairs, round(avg(coalesce(real_slack < m, false)::INT), 6) AS delay_fail FROM lab, (VALUES (3), (4), (5), (7)) v(m) GROUP BY m",
    "hub_grid_state": f"WITH {GRID} SELECT eva, epoch_us(g) AS g_us, round(share_cancel, 6) AS share_cancel, floor(mean_delay * 6e7 + 0.1234)::BIGINT AS mean_delay_us, round(share_late, 6) AS share_late FROM hub",
    "line_grid_state": f"WITH {GRID} SELECT eva, epoch_us(g) AS g_us, line, round(line_delay, 6) AS mean_delay FROM line",
    "hub_features": f"""WITH {GRID} SELECT r.stop_id, round(h.share_cancel, 6) AS share_cancel, round(h.mean_delay, 6) AS mean_delay, round(l.line_delay, 6) AS line_delay
FROM rows_ r LEFT JOIN hub h ON h.eva = r.eva AND h.g = r.gg LEFT JOIN line l ON l.eva = r.eva AND l.g = r.gg AND l.line = r.line""",
    "feeder_features": f"""WITH {GRID}, feed AS (SELECT 'S' || r_regionkey AS name, r_regionkey::VARCHAR AS eva FROM region),
x AS (SELECT r.stop_id, r.gg, r.line, f.eva FROM rows_ r, unnest({li("r.path")}) AS s(n) JOIN feed f ON f.name = s.n WHERE r.first_seen <= r.t_cut),
m AS (SELECT x.stop_id, avg(h.mean_delay) AS d, avg(l.line_delay) AS ld FROM x LEFT JOIN hub h ON h.eva = x.eva AND h.g = x.gg LEFT JOIN line l ON l.eva = x.eva AND l.g = x.gg AND l.line = x.line GROUP BY x.stop_id)
SELECT r.stop_id, round(m.d, 6) AS corridor_delay, round(m.ld, 6) AS corridor_line_delay FROM rows_ r LEFT JOIN m USING (stop_id)""",
    "message_first_seen": f"WITH {MSGS} SELECT key, type, code, epoch_us(obs) AS obs_us FROM firsts",
    "message_features": f"""WITH {ROWS}, {MSGS} SELECT r.stop_id, count(*) FILTER (f.type = 'c') AS n_clicks, count(*) FILTER (f.type = 'e') AS n_errors, count(*) FILTER (f.type = 'h') AS n_notices
FROM rows_ r LEFT JOIN firsts f ON f.key = r.key AND f.obs <= r.t_cut GROUP BY r.stop_id""",
    "plan_change_keys": "SELECT l_orderkey, l_linenumber, count(DISTINCT l_shipdate) AS planned_times FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_shipdate) > 1",
    "trend_features": f"""WITH {ROWS}, q AS (SELECT r.*, b, t_cut - to_minutes(b) AS t FROM rows_ r, (VALUES (0), (60), (1440)) v(b)),
s AS (SELECT q.stop_id, q.b, {mins("coalesce(o.ct, q.pt)", "q.pt")} AS d FROM q ASOF LEFT JOIN obs o ON q.key = o.key AND q.t >= o.obs)
SELECT stop_id, round((max(d) FILTER (b = 0) - max(d) FILTER (b = 60)) * 6e7)::BIGINT AS trend_60_us, round((max(d) FILTER (b = 0) - max(d) FILTER (b = 1440)) * 6e7)::BIGINT AS trend_1440_us FROM s GROUP BY stop_id""",
    "freshness_features": f"""WITH {ROWS}, q AS (SELECT *, date_trunc('minute', t_cut) AS mark FROM rows_)
SELECT q.stop_id, round({mins("q.mark", "date_trunc('minute', o.obs)")}, 6) AS age_min FROM q ASOF LEFT JOIN obs o ON q.key = o.key AND q.mark >= o.obs""",
    "context_features": f"""WITH {PLAN}, l AS (SELECT *, {BERLIN.format("pt")} AS loc FROM plan), h AS (SELECT *, (hour(loc) + minute(loc) / 60.0::DOUBLE) * (2 * pi() / 24) AS a FROM l)
SELECT stop_id, round(sin(a), 6) + 0.0 AS hour_sin, round(cos(a), 6) + 0.0 AS hour_cos, CASE WHEN loc::DATE = DATE '2024-01-01' OR dayofweek(loc) = 0 THEN 'sunday_holiday' WHEN dayofweek(loc) = 6 THEN 'saturday' ELSE 'weekday' END AS day_type,
  (cat = 'S')::INT AS same_platform, {SEGMENT.format("cat")} AS segment FROM h""",
    "auc_by_cutoff": f"WITH {PRED}, r AS (SELECT *, {ranks('p_model', 'cutoff_min')} AS r FROM pred) SELECT cutoff_min, round({area('r', 'label')}, 6) AS auc FROM r GROUP BY cutoff_min",
    "flag_quality": f"""WITH {PRED} SELECT priority, round(sum(flag * label) / nullif(sum(flag), 0)::DOUBLE, 6) AS precision, round(sum(flag * label) / nullif(sum(label), 0)::DOUBLE, 6) AS recall,
  round(sum(flag * (1 - label)) / nullif(sum(1 - label), 0)::DOUBLE, 6) AS false_alarms FROM pred GROUP BY priority""",
    "recall_at_rule_precision": f"""WITH {PRED}, c AS (SELECT cutoff_min, p_model AS s, sum(label) AS pos, count(*) AS n FROM pred GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY cutoff_min) AS allpos, avg_ FROM c JOIN (SELECT cutoff_min, avg(label) AS avg_ FROM pred GROUP BY 1) USING (cutoff_min) WINDOW w AS (PARTITION BY cutoff_min ORDER BY s DESC)),
ok AS (SELECT * FROM t WHERE tp / k::DOUBLE >= avg_ QUALIFY row_number() OVER (PARTITION BY cutoff_min ORDER BY tp DESC, s) = 1)
SELECT cutoff_min, round(tp / allpos::DOUBLE, 6) AS recall, round(s, 6) AS threshold FROM (SELECT DISTINCT cutoff_min FROM pred) LEFT JOIN ok USING (cutoff_min)""",
    "metric_table": f"""WITH {PRED}, m AS (SELECT *, unnest(['p_model', 'p_base', 'flag']) AS model, unnest([p_model, p_base, flag::DOUBLE]) AS p FROM pred),
x AS (SELECT cutoff_min, label, model, p, unnest(['overall', 'priority', 'status']) AS slice, unnest(['all', priority, status]) AS value FROM m),
r AS (SELECT *, {ranks("p", "cutoff_min, model, slice, value")} AS r FROM x)
SELECT cutoff_min, slice, value, model, n, fail_rate, mean_p, CASE WHEN model <> 'flag' THEN round(l, 6) END AS log_loss, brier, CASE WHEN model <> 'flag' THEN round(a, 6) END AS auc FROM (
  SELECT cutoff_min, slice, value, model, count(*) AS n, round(avg(label), 6) AS fail_rate, round(avg(p), 6) AS mean_p, avg({ll("p")}) AS l, round(avg((p - label) * (p - label)), 6) AS brier, {area("r", "label")} AS a FROM r GROUP BY cutoff_min, slice, value, model)""",
    "reliability_bins": f"WITH {PRED} SELECT cutoff_min, least(floor(p_model * 10), 9)::INT AS bin, count(*) AS n, round(avg(p_model), 6) AS mean_p, round(avg(label), 6) AS observed FROM pred GROUP BY ALL",
    "log_loss_per_day": f"WITH {PRED} SELECT day, count(*) AS n, round(avg({ll('p_model')}), 6) AS p_model, round(avg({ll('p_base')}), 6) AS p_base FROM pred GROUP BY day",
    "gain_by_fold": f"""WITH {PRED}, d AS (SELECT day, 1 - avg({ll("p_model")}) / avg({ll("p_base")}) AS gain FROM pred GROUP BY day)
SELECT day % 4 AS fold, count(*) AS days, round(avg(gain), 6) AS mean_gain, count(*) FILTER (gain > 0) AS days_better FROM d GROUP BY ALL""",
    "psi_of_inputs": """WITH r AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_discount END AS discount FROM lineitem),
t AS (SELECT * FROM r WHERE l_shipdate < TIMESTAMP '1998-01-01'), n AS (SELECT * FROM r WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
lt AS (SELECT unnest(['l_quantity', 'discount', 'l_extendedprice']) AS input, unnest([l_quantity, discount, l_extendedprice]) AS x FROM t), ln AS (SELECT unnest(['l_quantity', 'discount', 'l_extendedprice']) AS input, unnest([l_quantity, discount, l_extendedprice]) AS x FROM n),
e AS (SELECT input, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM lt GROUP BY input),
b AS (SELECT 'e' AS side, input, CASE WHEN x IS NULL THEN 'm' ELSE len(list_filter(edges, lambda q: q <= x))::VARCHAR END AS bin FROM lt JOIN e USING (input) UNION ALL SELECT 'a', input, CASE WHEN x IS NULL THEN 'm' ELSE len(list_filter(edges, lambda q: q <= x))::VARCHAR END FROM ln JOIN e USING (input)
  UNION ALL SELECT 'e', 'l_returnflag', l_returnflag FROM t UNION ALL SELECT 'a', 'l_returnflag', l_returnflag FROM n),
s AS (SELECT input, bin, count(*) FILTER (side = 'e') AS ce, count(*) FILTER (side = 'a') AS ca FROM b GROUP BY ALL),
f AS (SELECT input, greatest(1e-4, ce / sum(ce) OVER (PARTITION BY input)::DOUBLE) AS e, greatest(1e-4, ca / sum(ca) OVER (PARTITION BY input)::DOUBLE) AS a FROM s),
p AS (SELECT input, sum((a - e) * ln(a / e)) AS psi FROM f GROUP BY input)
SELECT input, round(psi, 6) AS psi, CASE WHEN psi > 0.25 THEN 'large' WHEN psi > 0.1 THEN 'moderate' ELSE 'stable' END AS level, 'ok' AS status FROM p""",
    "reference_profile": """WITH e AS (SELECT list_distinct(quantile_cont(c_acctbal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM customer)
SELECT 'c_acctbal' AS input, len(list_filter(edges, lambda q: q <= c_acctbal))::VARCHAR AS bin, round(count(*) / (SELECT count(*) FROM customer)::DOUBLE, 6) AS share FROM customer, e GROUP BY ALL
UNION ALL SELECT 'c_mktsegment', c_mktsegment, round(count(*) / (SELECT count(*) FROM customer)::DOUBLE, 6) FROM customer GROUP BY ALL""",
    "history_rate_model": """WITH r AS (SELECT o_orderkey, CASE WHEN o_totalprice < 0 OR o_totalprice >= 450000 OR o_totalprice IS NULL THEN -1 WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE 3 END AS b,
  c_mktsegment AS hub, o_orderpriority AS seg, (o_orderstatus = 'F')::INT AS y, o_orderdate AS d FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT * FROM r WHERE d < TIMESTAMP '1996-01-01' AND hub <> 'MACHINERY'), r0 AS (SELECT avg(y) AS p FROM f),
r1 AS (SELECT b, (sum(y) + 50 * any_value(r0.p)) / (count(*) + 50) AS p FROM f, r0 GROUP BY b),
r2 AS (SELECT f.b, f.hub, (sum(y) + 50 * any_value(r1.p)) / (count(*) + 50) AS p FROM f JOIN r1 ON r1.b = f.b GROUP BY f.b, f.hub),
r3 AS (SELECT f.b, f.hub, f.seg, (sum(y) + 50 * any_value(r2.p)) / (count(*) + 50) AS p FROM f JOIN r2 ON r2.b = f.b AND r2.hub = f.hub GROUP BY f.b, f.hub, f.seg)
SELECT o_orderkey, round(coalesce(r3.p, r2.p, r1.p, r0.p), 6) AS p FROM r CROSS JOIN r0 LEFT JOIN r1 ON r1.b = r.b LEFT JOIN r2 ON r2.b = r.b AND r2.hub = r.hub LEFT JOIN r3 ON r3.b = r.b AND r3.hub = r.hub AND r3.seg = r.seg""",
    "missing_order_days": """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
SELECT strftime(g, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series((SELECT min(d) FROM d), (SELECT max(d) FROM d), INTERVAL 1 DAY))::DATE AS g) WHERE g NOT IN (SELECT d FROM d)""",
    "finished_days": f"""WITH d AS (SELECT DISTINCT ({BERLIN.format("ts")} - INTERVAL 4 HOUR)::DATE AS day FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day FROM d WHERE timezone('UTC', timezone('Europe/Berlin', day + INTERVAL 1 DAY + INTERVAL 4 HOUR)) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) AND day(day) % 3 <> 0""",
    "worst_psi_by_segment": "WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_orderpriority) = 1",
    "feature_skew": """WITH p AS (SELECT o_orderkey, o_totalprice AS lp, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0 END AS op, CASE WHEN o_orderkey % 7 <> 0 THEN month(o_orderdate) END AS lm, CASE WHEN o_orderkey % 14 <> 0 THEN month(o_orderdate) END AS om FROM orders),
e AS (SELECT *, abs(lp - op) <= 1e-6 AS ep, lm IS NOT DISTINCT FROM om AS em FROM p)
SELECT 'price' AS feature, count(*) AS rows, round(avg(ep::INT), 6) AS equal_share, round(avg(abs(lp - op)), 6) AS mean_abs_diff FROM e UNION ALL SELECT 'month', count(*), round(avg(em::INT), 6), round(avg(abs(lm - om)), 6) FROM e
UNION ALL SELECT '<row>', count(*), round(avg((ep AND em)::INT), 6), NULL FROM e""",
    "null_share_per_column": f"WITH {PLAN} SELECT c AS column, round(v, 6) AS null_share FROM (SELECT unnest(['line', 'path', 'wings', 'tra', 'pt', 'cat']) AS c, unnest([avg((line IS NULL)::INT), avg((path IS NULL)::INT), avg((wings IS NULL)::INT), avg((tra IS NULL)::INT), avg((pt IS NULL)::INT), avg((cat IS NULL)::INT)]) AS v FROM plan)",
    "key_uniqueness": """SELECT 'order' AS key, count(*) AS rows, count(DISTINCT l_orderkey) AS distinct FROM lineitem UNION ALL SELECT 'order,line', count(*), count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'order,part,supplier', count(*), count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) FROM lineitem""",
    "rule_agreement": "SELECT l_linestatus, count(*) AS rows, round(avg((l_returnflag = 'R')::INT), 6) AS returned, round(avg((round(l_discount * 100) = round(l_tax * 100))::INT), 6) AS discount_at_tax, round(avg((l_quantity > 25)::INT) FILTER (l_linenumber <> 2), 6) AS many FROM lineitem GROUP BY ALL",
    "delay_distribution": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL",
    "rides_contiguity": """WITH r AS (SELECT count(*) AS stops, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(DISTINCT l_linenumber) AS n, (epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 3.6e9 AS span FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS rides, round(avg((n = hi - lo + 1)::INT), 6) AS contiguous, round(avg((n < stops)::INT), 6) AS repeated, round(avg((lo = 1)::INT), 6) AS from_one, round(avg(span), 6) AS mean_span_h FROM r""",
    "rows_per_day": f"SELECT strftime(({BERLIN.format('ts')} - INTERVAL 4 HOUR)::DATE, '%Y-%m-%d') AS day, count(*) AS rows, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) FILTER (value IS NULL) AS without_value FROM events GROUP BY ALL",
    "order_violations": """WITH v AS (SELECT l_linestatus, l_shipdate < lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS back FROM lineitem)
SELECT l_linestatus, count(back) AS steps, round(avg(back::INT), 6) AS violations FROM v GROUP BY ALL""",
    "poll_gaps": f"WITH {EV}, g AS (SELECT eva, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY eva ORDER BY ts)) / 1e6 AS s FROM ev) SELECT eva, count(s) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(quantile_cont(s, 1.0), 6) AS p100 FROM g GROUP BY eva",
    "trailing_counts": f"WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY eva ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS n FROM ev",
    "top_lines_per_hub": f"""WITH {PLAN}, c AS (SELECT eva, line, count(*) AS n FROM plan GROUP BY ALL)
SELECT eva, line, n, row_number() OVER w AS rank, round(n / sum(n) OVER (PARTITION BY eva)::DOUBLE, 6) AS share FROM c WINDOW w AS (PARTITION BY eva ORDER BY n DESC, line NULLS LAST) QUALIFY rank <= 3""",
    "station_activity": f"WITH {EV} SELECT user_id, any_value(eva) AS eva, count(*) AS rows, round(count(*) / count(DISTINCT ts::DATE)::DOUBLE, 6) AS rows_per_day FROM ev GROUP BY user_id ORDER BY rows DESC, user_id LIMIT 20",
    "pair_miss_rates": f"""WITH {EV}, p AS (SELECT a.eva, {mins("b.ts", "a.ts")} AS s, b.value - a.value AS dv FROM ev a JOIN ev b ON a.eva = b.eva AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts + INTERVAL 5 MINUTE AND a.ts + INTERVAL 30 MINUTE AND a.user_id <> b.user_id)
SELECT eva, CASE WHEN s < 10 THEN 0 WHEN s < 15 THEN 1 WHEN s < 20 THEN 2 ELSE 3 END AS bucket, count(*) AS pairs, round(avg((s + dv / 60 < 5)::INT), 6) AS missed FROM p GROUP BY ALL""",
    "requests_by_type": "SELECT event_type, user_id % 3 AS status, count(*) AS requests, count(DISTINCT user_id) AS stations, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY ALL",
    "snapshots_per_key": f"""WITH {OBS}, k AS (SELECT count(*) AS s, count(DISTINCT ct) AS c, max((cs = 'c')::INT) AS x FROM obs GROUP BY key)
SELECT count(*) AS keys, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(quantile_cont(c, 0.5), 6) AS changes_p50, round(avg(coalesce(x, 0)), 6) AS cancelled FROM k""",
    "validity_by_zone": "SELECT zone, hour(timezone(zone, timezone('UTC', ts)))::INT AS hour, count(*) AS rows, round(avg((value > 60)::INT), 6) AS share FROM events, (VALUES ('UTC'), ('Europe/Berlin'), ('America/New_York')) z(zone) GROUP BY ALL",
    "hour_offsets": "SELECT (round((props->>'$.k')::INT / 4.0::DOUBLE) - hour(ts))::INT AS offset, count(*) AS n FROM events GROUP BY ALL",
    "feeder_volume": f"WITH {EV}, g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY eva ORDER BY ts)) / 1e6 AS s FROM ev WHERE event_type = 'click') SELECT eva, count(DISTINCT user_id) AS runs, count(*) AS observations, round(quantile_cont(s, 0.5), 6) AS median_gap_s FROM g GROUP BY eva",
    "preferred_run_rows": f"WITH {PLAN} SELECT eva, trip, event, stop_id FROM plan QUALIFY row_number() OVER (PARTITION BY eva, trip ORDER BY (event <> 'dp')::INT, pt, stop_id) = 1",
    "snapshot_match_rate": "SELECT count(*) AS rows, count(*) FILTER (l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)) AS matched FROM lineitem",
    "unmatched_names": """WITH n AS (SELECT replace(n_name, '_1', '-1') AS name FROM nation), m AS (SELECT DISTINCT name FROM n WHERE (name LIKE '%-1%' OR name LIKE '%2%') AND name NOT IN (SELECT n_name FROM nation))
SELECT name, n_name AS close, levenshtein(name, n_name) AS distance, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, n_name), n_name) AS rank FROM m JOIN nation ON levenshtein(name, n_name) <= 2 QUALIFY rank <= 3""",
    "prognosis_error": f"WITH {LABELLED} SELECT cutoff_min, count(*) AS rows, round(avg(abs(da - a_final)), 6) AS mae, round(avg(known::INT), 6) AS known_cancel FROM ds WHERE reason IS NULL GROUP BY cutoff_min",
    "period_pivot": "SELECT o_orderpriority AS priority, year(o_orderdate)::INT AS year, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY ALL",
    "hub_connection_counts": f"WITH {PAIRS} SELECT h.hub, count(c.sa) AS connections FROM hubs h LEFT JOIN cand c ON c.hub = h.hub GROUP BY h.hub",
    "risky_connections": f"""WITH {LABELLED}, e AS (SELECT *, round(1 / (1 + exp((dslack - 8) / 4)), 6) AS risk, count(*) OVER (PARTITION BY hub) AS hub_total FROM ds WHERE reason IS NULL AND cutoff_min = 30)
SELECT hub, sa AS stop_id_a, sb AS stop_id_b, risk, hub_total, CASE WHEN la IS NOT NULL THEN CASE WHEN starts_with(la, ca) THEN la ELSE ca || la END ELSE ca || ' ' || na END AS train_a,
  CASE WHEN slack <= 20 THEN 10 WHEN slack <= 45 THEN 30 ELSE 60 END AS nearest FROM e WHERE risk >= 0.2 ORDER BY risk DESC, pta, sa, sb LIMIT 50""",
    "data_age_status": f"WITH {EV}, a AS (SELECT eva, ((SELECT epoch_us(max(ts)) FROM ev) - epoch_us(max(ts))) / 1e6 AS s FROM ev GROUP BY eva) SELECT eva, round(s, 6) AS age_s, CASE WHEN s > 600 THEN 'error' WHEN s > 60 THEN 'degraded' ELSE 'ok' END AS status FROM a",
    "overall_age_status": """WITH a AS (SELECT user_id, ((SELECT epoch_us(max(ts)) FROM events) - epoch_us(max(ts))) / 1e6 AS s FROM events GROUP BY user_id)
SELECT round(min(s), 6) AS age_s, CASE WHEN max(s) > 86400 THEN 'error' WHEN max(s) > 3600 THEN 'degraded' ELSE 'ok' END AS status FROM a""",
    "deduplicated_tail": f"WITH {OBS}, {SPAN}, d AS (SELECT DISTINCT key, obs, ct, cs, eva FROM obs, span WHERE epoch_us(obs) <= lo + floor((hi - lo) * 0.75::DOUBLE)) SELECT eva, count(*) AS rows, epoch_us(max(obs)) AS last_us FROM d GROUP BY eva",
    "carried_states": f"WITH {OBS}, {SPAN} SELECT key, epoch_us(obs) AS obs_us, cs FROM obs, span QUALIFY row_number() OVER (PARTITION BY key ORDER BY obs DESC, ct DESC NULLS LAST, cs DESC NULLS LAST) = 1 AND epoch_us(obs) >= lo + floor((hi - lo) * 0.3::DOUBLE)",
    "scoring_status": f"""WITH {PLAN}, q AS (SELECT *, pt - INTERVAL 10 MINUTE AS t FROM plan WHERE event = 'ar'), p AS (SELECT (user_id % 5)::VARCHAR AS eva, ts FROM events WHERE event_type = 'error'),
j AS (SELECT q.*, p.ts AS poll FROM q ASOF LEFT JOIN p ON q.eva = p.eva AND q.t >= p.ts)
SELECT eva, CASE WHEN cat = 'Bus' THEN 'a_cancelled' WHEN poll IS NULL OR {mins("t", "poll")} > 45 THEN 'collector_gap' WHEN pp = '3' THEN 'dst_ambiguous' ELSE 'ok' END AS status, count(*) AS n FROM j GROUP BY ALL""",
    "status_by_source": f"WITH {OBS} SELECT eva AS source, (key % 2)::VARCHAR AS eva, count(*) AS rows, count(DISTINCT key) AS stops, epoch_us(min(obs)) AS first_us, epoch_us(max(obs)) AS last_us, count(*) FILTER (cs IS NULL AND ct IS NOT NULL) AS with_ct, count(*) FILTER (cs = 'c') AS cancelled FROM obs GROUP BY ALL",
    "prediction_outcomes": f"""WITH {PRED}, l AS (SELECT *, l_orderkey % 40 + round(p_model * 10) AS lag, l_orderkey % 200 + p_base AS age FROM pred),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY lag, p_model, p_base, flag, cutoff_min, age) = 1),
o AS (SELECT l_orderkey, l_linenumber, l_linenumber <> 5 AS eligible FROM pred GROUP BY ALL),
j AS (SELECT f.*, CASE WHEN o.eligible IS NULL THEN 'n' WHEN o.eligible THEN 'e' ELSE 'x' END AS k FROM f LEFT JOIN o USING (l_orderkey, l_linenumber))
SELECT cutoff_min, count(*) AS predictions, count(*) FILTER (k = 'e') AS evaluated, count(*) FILTER (k = 'x') AS excluded, count(*) FILTER (k = 'n') AS not_a_candidate, round(avg((k = 'e')::INT), 6) AS coverage,
  round(quantile_cont(lag, 0.5), 6) AS lag_s_p50, round(quantile_cont(lag, 0.95), 6) AS lag_s_p95, round(quantile_cont(age, 0.5), 6) AS age_s_p50, round(quantile_cont(age, 0.95), 6) AS age_s_p95, round(max(lag), 6) AS lag_s_max, round(max(age), 6) AS age_s_max FROM j GROUP BY cutoff_min""",
}
