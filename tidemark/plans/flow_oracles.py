"""DuckDB SQL for the queries of flows.py."""

from __future__ import annotations

from ..operators.features import GROUPS, feature_columns
from .oracles import BERLIN, EV, GRID, HUBS, LABELLED, MSGS, OBS, PAIRS, PLAN, PRED, SEGMENT, SPAN, area, li, ll, mins, ranks

WIRE = "strftime({0} AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin', '%y%m%d%H%M')"


def minute(t: str) -> str:
    """A time as it comes back from the wire, which has minutes."""
    return f"epoch_us(date_trunc('minute', {t}))"


RAW = f"""{PLAN},
parsed AS (
  SELECT eva, 'plan' AS source, stop_id, regexp_replace(stop_id, '-[0-9]+$', '') AS trip_key, event, cat AS tl_category, num AS tl_number, line, pp, {minute("pt")} AS pt_us, NULL::BIGINT AS ct_us, NULL::VARCHAR AS cs, path AS ppth, wings, tra,
    NULL::VARCHAR AS event_msgs, date_trunc('hour', first_seen) AS seen FROM plan
  UNION ALL SELECT (user_id % 5)::VARCHAR, 'fchg', event_id || '-1', event_id::VARCHAR, 'ar', NULL, NULL, NULL, NULL, NULL, {minute("ts + to_seconds(floor(value)::BIGINT)")}, CASE WHEN event_type = 'error' THEN 'c' END, NULL, NULL, NULL,
    event_type[1] || ':' || (props->>'$.k'), date_trunc('hour', ts) FROM events)"""
PARSED = f"WITH {RAW} SELECT eva, source, stop_id, trip_key, event, tl_category, tl_number, line, pp, pt_us, ct_us, cs, ppth, wings, tra, event_msgs, epoch_us(seen) AS seen_us, 'Hub ' || eva AS station_name FROM parsed"

CONNECTIONS = f"{PAIRS}, r AS (SELECT *, eva || '|' || sa || '|' || sb AS row, pta - INTERVAL 30 MINUTE AS t_cut, time_bucket(INTERVAL 5 MINUTE, pta - INTERVAL 30 MINUTE) AS gr FROM cand)"
#: Every feature of a connection: state at several times before, grid, ways in, messages, clock.
FEATURES = f"""{CONNECTIONS}, {GRID.removeprefix(PLAN + ", ")}, {MSGS},
asks AS (SELECT row, side || ':' || what AS ask, CASE side WHEN 'a' THEN ka ELSE kb END AS key, CASE side WHEN 'a' THEN pta ELSE ptb END AS pt, CASE what WHEN 'mark' THEN date_trunc('minute', t_cut) ELSE t_cut - to_minutes(back) END AS at
  FROM r, (VALUES ('a'), ('b')) x(side), (VALUES ('now', 0), ('mark', 0), ('15', 15), ('30', 30)) y(what, back)),
st AS (SELECT q.row, q.ask, o.cs, coalesce(o.ct, q.pt) AS pred, {mins("coalesce(o.ct, q.pt)", "q.pt")} AS d, {mins("q.at", "date_trunc('minute', o.obs)")} AS age FROM asks q ASOF LEFT JOIN obs o ON q.key = o.key AND q.at >= o.obs),
pr AS (SELECT row, max(d) FILTER (ask = 'a:now') AS da, max(d) FILTER (ask = 'b:now') AS db, {mins("max(pred) FILTER (ask = 'b:now')", "max(pred) FILTER (ask = 'a:now')")} AS slack_now, coalesce(max(cs) FILTER (ask = 'b:now') = 'c', false) AS known,
  max(age) FILTER (ask = 'a:mark') AS age_a, max(age) FILTER (ask = 'b:mark') AS age_b, max(d) FILTER (ask = 'a:15') AS a15, max(d) FILTER (ask = 'a:30') AS a30, max(d) FILTER (ask = 'b:15') AS b15 FROM st GROUP BY row),
feed AS (SELECT 'S' || r_regionkey AS name, r_regionkey::VARCHAR AS eva FROM region),
ways AS (SELECT r.row, r.gr, r.la, side, {li("p.path")} AS way FROM r, (VALUES ('a'), ('b')) x(side) JOIN plan p ON p.event = 'ar' AND p.eva = r.eva AND p.stop_id = CASE side WHEN 'a' THEN r.sa ELSE r.sb END AND p.first_seen <= r.t_cut),
via AS (SELECT w.row, w.side, w.gr, w.la, f.eva FROM (SELECT *, unnest(way) AS name FROM ways) w JOIN feed f USING (name)),
cor AS (SELECT v.row, avg(h.mean_delay) FILTER (side = 'a') AS ca_, avg(l.line_delay) FILTER (side = 'a') AS cl_, avg(h.mean_delay) FILTER (side = 'b') AS cb_
  FROM via v LEFT JOIN hub h ON h.eva = v.eva AND h.g = v.gr LEFT JOIN line l ON l.eva = v.eva AND l.g = v.gr AND l.line = v.la GROUP BY v.row),
ma AS (SELECT r.row, count(*) FILTER (f.type = 'c') AS d, count(*) FILTER (f.type = 'e') AS q FROM r JOIN firsts f ON f.key = r.ka AND f.obs <= r.t_cut GROUP BY r.row),
mb AS (SELECT r.row, count(*) FILTER (f.type = 'c') AS d FROM r JOIN firsts f ON f.key = r.kb AND f.obs <= r.t_cut GROUP BY r.row),
sm AS (SELECT event_id || '-1' AS stop_id, event_id, ts - to_minutes(event_id % 90) AS obs FROM events),
clock AS (SELECT *, (hour(loc) + minute(loc) / 60.0::DOUBLE) * (2 * pi() / 24) AS angle FROM (SELECT *, {BERLIN.format("pta")} AS loc FROM r)),
fx AS (SELECT c.row, round(pr.slack_now, 4) + 0.0 AS db_slack_min, round(pr.da, 4) + 0.0 AS db_delay_a_min, round(pr.db, 4) + 0.0 AS db_delay_b_min, pr.known AS b_cancel_known,
    round(h.mean_delay, 4) + 0.0 AS hub_mean_delay, round(h.share_late, 4) + 0.0 AS hub_share_late5, round(h.share_cancel, 4) + 0.0 AS hub_share_cancel, round(l.line_delay, 4) + 0.0 AS line_recent_delay_a, round(age_a, 4) + 0.0 AS age_a_min, round(age_b, 4) + 0.0 AS age_b_min,
    round(c.slack, 4) + 0.0 AS planned_slack_min, round(sin(angle), 4) + 0.0 AS hour_sin, round(cos(angle), 4) + 0.0 AS hour_cos, CASE WHEN loc::DATE = DATE '2024-01-01' OR dayofweek(loc) = 0 THEN 'sunday_holiday' WHEN dayofweek(loc) = 6 THEN 'saturday' ELSE 'weekday' END AS day_type,
    len(c.pa) AS n_stations_before_a, (c.na::BIGINT % 4 = c.nb::BIGINT % 4)::INT AS same_platform, {SEGMENT.format("c.ca")} AS segment_a, {SEGMENT.format("c.cb")} AS segment_b, c.hub,
    round(da - a15, 4) + 0.0 AS trend_a_15, round(da - a30, 4) + 0.0 AS trend_a_30, round(db - b15, 4) + 0.0 AS trend_b_15, coalesce(ma.d, 0) AS n_delay_codes_a, coalesce(ma.q, 0) AS n_quality_a, coalesce(mb.d, 0) AS n_delay_codes_b,
    coalesce(x.event_id % 4 = 0 AND x.obs <= c.t_cut, false)::INT AS h_notice_a, coalesce(y.event_id % 4 = 0 AND y.obs <= c.t_cut, false)::INT AS h_notice_b, coalesce(x.event_id % 6 = 0 AND x.obs <= c.t_cut, false)::INT AS c_notice_a,
    round(ca_, 4) + 0.0 AS corridor_delay_a, round(cl_, 4) + 0.0 AS corridor_line_delay_a, round(cb_, 4) + 0.0 AS corridor_delay_b
  FROM clock c JOIN pr USING (row) LEFT JOIN hub h ON h.eva = c.eva AND h.g = c.gr LEFT JOIN line l ON l.eva = c.eva AND l.g = c.gr AND l.line = c.la LEFT JOIN cor USING (row) LEFT JOIN ma USING (row) LEFT JOIN mb USING (row)
    LEFT JOIN sm x ON x.stop_id = c.sa LEFT JOIN sm y ON y.stop_id = c.sb)"""

#: The draws of the bootstrap: day numbers from MD5(seed:draw:i) for each group of rows, and every day once in draw -1.
BOOT = """days AS (SELECT {g}, day, count(*) AS n, sum(lm) AS lm, sum(lb) AS lb, sum(bm) AS bm, sum(bb) AS bb, row_number() OVER (PARTITION BY {g} ORDER BY day) - 1 AS d FROM loss GROUP BY {g}, day),
sizes AS (SELECT {g}, count(*) AS k FROM days GROUP BY {g}),
picks AS (SELECT {g}, r, ('0x' || substr(md5('0:' || r || ':' || i), 1, 8))::BIGINT % k AS d FROM sizes, range({draws}) t(r), range(k) u(i)),
weights AS (SELECT {g}, r, d, count(*)::DOUBLE AS w FROM picks GROUP BY ALL UNION ALL SELECT {g}, -1, d, 1.0 FROM days),
drawn AS (SELECT {g}, r, 1 - sum(lm * w) / sum(lb * w) AS gain, 1 - sum(bm * w) / sum(bb * w) AS brier FROM days JOIN weights USING ({g}, d) GROUP BY {g}, r),
gains AS (SELECT {g}, max(gain) FILTER (r = -1) AS gain, quantile_cont(gain, 0.025) FILTER (r >= 0) AS low, quantile_cont(gain, 0.975) FILTER (r >= 0) AS high,
  max(brier) FILTER (r = -1) AS brier, quantile_cont(brier, 0.025) FILTER (r >= 0) AS brier_low, quantile_cont(brier, 0.975) FILTER (r >= 0) AS brier_high FROM drawn GROUP BY {g}),
facts AS (SELECT {g}, count(*) AS days, sum(n)::BIGINT AS rows, avg((lm / n < lb / n)::INT) AS day_share FROM days GROUP BY {g})"""
#: The AUC of weighted counts by (group, draw, model), from running sums.
AREAS = """cnt AS (SELECT {g}, day, y, m, p, count(*) AS c FROM (SELECT {g}, day, y, unnest([1, -1]) AS m, unnest([pm, pb]) AS p FROM loss) GROUP BY ALL),
wc AS (SELECT {g}, r, m, p, sum(c * w * y) AS pos, sum(c * w * (1 - y)) AS neg FROM cnt JOIN (SELECT {g}, day, d FROM days) USING ({g}, day) JOIN weights USING ({g}, d) WHERE r < {auc} GROUP BY ALL),
run AS (SELECT *, sum(neg) OVER (PARTITION BY {g}, r, m ORDER BY p) - neg AS below FROM wc),
one AS (SELECT {g}, r, m, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS a FROM run GROUP BY {g}, r, m),
diffs AS (SELECT {g}, r, sum(a * m) AS diff FROM one GROUP BY {g}, r),
aucs AS (SELECT {g}, max(diff) FILTER (r = -1) AS diff, quantile_cont(diff, 0.025) FILTER (r >= 0) AS diff_low, quantile_cont(diff, 0.975) FILTER (r >= 0) AS diff_high FROM diffs GROUP BY {g})"""


def losses(groups: str, rows: str, label: str, model: str, base: str) -> str:
    sq = lambda p: f"({p} - {label}) * ({p} - {label})"
    return f"loss AS (SELECT {groups}, day, {label} AS y, {model} AS pm, {base} AS pb, {ll(model, label)} AS lm, {ll(base, label)} AS lb, {sq(model)} AS bm, {sq(base)} AS bb FROM {rows} WHERE {label} IS NOT NULL AND {model} IS NOT NULL AND {base} IS NOT NULL)"


VARIANTS = f"""{PRED},
v AS (SELECT label, day, cutoff_min, priority, p_model AS in_use, p_model * 0.98::DOUBLE + 0.01::DOUBLE * p_base AS reseeded, p_model * 0.5::DOUBLE + p_base * 0.5::DOUBLE AS without_hub, p_model * 0.6::DOUBLE + 0.1::DOUBLE + label * 0.2::DOUBLE AS with_trend,
  CASE WHEN day % 12 < 6 THEN p_model * 0.9::DOUBLE + label * 0.05::DOUBLE END AS with_feeder, CASE WHEN day % 12 < 6 THEN p_model END AS in_use_from_feeder FROM pred),
pairs AS (SELECT label, day, cutoff_min AS cutoff, unnest(['hub', 'trend', 'feeder', 'noise']) AS subject, unnest(['drop', 'add', 'restricted', 'noise']) AS kind,
  unnest([in_use, with_trend, with_feeder, reseeded]) AS better, unnest([without_hub, in_use, in_use_from_feeder, in_use]) AS than FROM v),
{losses("subject, kind, cutoff", "pairs", "label", "better", "than")}, {BOOT.format(g="subject, kind, cutoff", draws=1000)}"""

TRAIN = "train AS (SELECT *, pta::DATE AS day FROM ds WHERE reason IS NULL)"

FIXED = f"""{PAIRS}, {SPAN}, fixed AS (SELECT c.*, make_timestamp((lo + floor((hi - lo) * 0.6::DOUBLE))::BIGINT) AS now FROM cand c, span),
up AS (SELECT *, CASE WHEN na::BIGINT % 11 = 0 THEN 'collector_gap' ELSE 'ok' END AS status, CASE WHEN na::BIGINT % 11 <> 0 THEN 1 / (1 + exp((slack - 8) / 4)) END AS risk, {mins("pta", "now")} AS ahead FROM fixed WHERE pta > now)"""
NAME = "CASE WHEN {l} IS NOT NULL AND {l} <> '' THEN CASE WHEN starts_with({l}, {c}) THEN {l} ELSE {c} || {l} END ELSE {c} || ' ' || {n} END"
ISO = "strftime({0} AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin', '%Y-%m-%dT%H:%M:%S')"
PERIOD = "CASE WHEN day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' THEN 'train' WHEN day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN 'validation' WHEN day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN 'test' WHEN day >= DATE '1999-07-01' THEN 'robustness' ELSE 'outside' END"
MONTHS = "m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS day FROM orders), nr AS (SELECT day, row_number() OVER (ORDER BY day) AS n, count(*) OVER () AS last FROM m)"
NOW = f"{SPAN}, nowt AS (SELECT max(obs) AS now FROM obs, span WHERE epoch_us(obs) <= lo + floor((hi - lo) * 0.6::DOUBLE))"
FEED = f"""{PLAN}, {OBS},
arr AS (SELECT stop_id, eva, key, pt FROM plan WHERE event = 'ar'),
feed AS (SELECT a.stop_id, a.eva, a.key, a.pt, arg_max(row(e.ts, e.value), row(e.ts, e.value)) AS f, max(e.ts) AS f_pt, max(row(e.ts, e.value)) AS ff FROM arr a LEFT JOIN events e ON e.user_id = a.key AND e.event_type = 'click' AND e.ts < a.pt AND e.ts >= a.pt - INTERVAL 2 DAY GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "parsed_responses": PARSED,
    "streamed_parse": PARSED,
    "rebuilt_table_counts": f"WITH {RAW}, r AS (SELECT DISTINCT eva, source, seen FROM parsed), b AS (SELECT count(*) AS n FROM events WHERE event_type = 'error') SELECT (SELECT count(*) FROM r) + n AS responses, 0::BIGINT AS bad_lines, n AS parse_errors, (SELECT count(*) FROM parsed) AS rows FROM b",
    "parsed_rows_per_day": f"WITH {RAW} SELECT source, strftime(seen::DATE, '%Y-%m-%d') AS day, count(*) AS rows, count(DISTINCT stop_id) AS stops FROM parsed GROUP BY ALL",
    "loaded_window": f"""WITH {RAW}, {SPAN}, t AS (SELECT lo + floor((hi - lo) * 0.4::DOUBLE) AS t0, lo + floor((hi - lo) * 0.6::DOUBLE) AS t1 FROM span),
v AS (SELECT *, epoch_us(seen) AS s FROM parsed UNION ALL SELECT * REPLACE (NULL::VARCHAR AS line, pt_us + 10800000000 AS pt_us), epoch_us(seen) + 1200000000 FROM parsed WHERE source = 'plan' AND tl_number::BIGINT % 3 = 0),
w AS (SELECT v.* FROM v, t WHERE s BETWEEN t0 AND t1), here AS (SELECT * FROM w WHERE eva IN ('0', '1', '2')),
p AS (SELECT eva, stop_id, event, trip_key, arg_max(pt_us, s) AS pt, arg_max(pp, s) AS pp, arg_max(line, s) AS line, arg_max(ppth, s) AS path, arg_max(wings, s) AS wings, arg_max(tra, s) AS tra, arg_max(tl_category, s) AS cat, arg_max(tl_number, s) AS num, min(s) AS seen
  FROM here WHERE source = 'plan' AND pt_us IS NOT NULL GROUP BY ALL)
SELECT 'plan' AS part, eva, stop_id || '|' || event || '|' || trip_key AS key, concat_ws('|', coalesce(pp, '-'), coalesce(line, '-'), coalesce(path, '-'), coalesce(wings, '-'), coalesce(tra, '-'), coalesce(cat, '-'), coalesce(num, '-')) AS what, seen AS first_us, pt AS second_us FROM p
UNION ALL SELECT 'obs', eva, stop_id || '|' || event, cs, s, ct_us FROM here WHERE source = 'fchg' AND (ct_us IS NOT NULL OR cs IS NOT NULL)
UNION ALL SELECT DISTINCT 'polls', eva, NULL, NULL, s, NULL::BIGINT FROM here UNION ALL SELECT 'span', NULL, NULL, NULL, min(s), max(s) FROM w""",
    "replaced_days": """WITH d AS (SELECT strftime(o_orderdate, '%Y-%m') AS service_day, count(*) AS rows, sum(o_totalprice) AS price, month(min(o_orderdate)) % 3 = 0 AS twice FROM orders GROUP BY 1)
SELECT service_day, rows, round(price * CASE WHEN twice THEN 2 ELSE 1 END, 2) AS price, rows AS recorded, CASE WHEN twice THEN '2' ELSE '1' END AS version FROM d""",
    "historic_stop_keys": "SELECT l_orderkey, l_linenumber::VARCHAR AS nth, ltrim(lpad(l_suppkey::VARCHAR, 8, '0'), '0') AS eva, l_partkey || '-' || strftime(l_shipdate, '%y%m%d') AS run_key, l_partkey || '-' || strftime(l_shipdate, '%y%m%d') || '-' || l_linenumber AS stop_key FROM lineitem",
    "streamed_states": f"WITH {OBS} SELECT key, epoch_us(obs) AS obs_us, epoch_us(ct) AS ct_us, cs FROM obs QUALIFY row_number() OVER (PARTITION BY key ORDER BY obs DESC, ct DESC NULLS LAST, cs DESC NULLS LAST) = 1",
    "stored_states": f"WITH {OBS} SELECT key, epoch_us(obs) AS obs_us, epoch_us(ct) AS ct_us, cs FROM obs QUALIFY row_number() OVER (PARTITION BY key ORDER BY obs DESC, ct DESC NULLS LAST, cs DESC NULLS LAST) = 1",
    "online_outcomes": """WITH p AS (SELECT event_id, epoch_us(ts) AS s FROM events WHERE event_type = 'view'), l AS (SELECT event_id, s + event_id % 90 * 60000000 AS k FROM p WHERE event_id % 3 <> 0 AND event_id % 90 <= 60)
SELECT p.event_id, s AS scored_us, k AS known_us, CASE WHEN k IS NULL THEN 'not_a_candidate' WHEN p.event_id % 5 <> 0 THEN 'evaluated' ELSE 'excluded' END AS outcome FROM p LEFT JOIN l ON p.event_id = l.event_id""",
    "asof_of_one_key": """WITH q AS (SELECT event_id, ts - INTERVAL 10 MINUTE AS t FROM events WHERE event_type = 'purchase'), f AS (SELECT * FROM events WHERE event_type <> 'purchase')
SELECT q.event_id, epoch_us(f.ts) AS seen_us, f.event_id AS seen_id, f.event_type, round(f.value, 6) AS value FROM q ASOF LEFT JOIN f ON q.t >= f.ts""",
    "logged_once": "SELECT DISTINCT user_id AS key, epoch_us(date_trunc('hour', ts)) AS mark_us FROM events WHERE epoch_us(ts) - epoch_us(date_trunc('hour', ts)) < 300000000",
    "streamed_hub_state": f"""WITH {PLAN}, {OBS}, ends AS (SELECT min(obs) AS a, max(obs) AS b FROM obs),
g AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, pt - INTERVAL 30 MINUTE + INTERVAL 299999999 MICROSECOND), pt + INTERVAL 30 MINUTE, INTERVAL 5 MINUTE)) AS g FROM plan),
seen AS (SELECT g.* FROM g, ends WHERE first_seen <= g AND g > time_bucket(INTERVAL 5 MINUTE, a) AND g <= b),
gs AS (SELECT s.*, coalesce(o.cs = 'c', false) AS cancel, {mins("coalesce(o.ct, s.pt)", "s.pt")} AS delay FROM seen s ASOF LEFT JOIN obs o ON s.key = o.key AND s.g >= o.obs)
SELECT eva, epoch_us(g) AS g_us, round(avg(cancel::INT), 6) AS share_cancel, floor(avg(delay) FILTER (NOT cancel) * 6e7 + 0.1234)::BIGINT AS mean_delay_us, round(avg((delay >= 5)::INT) FILTER (NOT cancel), 6) AS share_late FROM gs GROUP BY eva, g""",
    "bundle_card": f"""WITH {LABELLED}, {TRAIN}, b AS (SELECT * FROM train WHERE date_diff('day', day, (SELECT max(day) FROM train)) < 14)
SELECT unnest(['min_transfer', 'cutoffs', 'p_model.first_day', 'p_model.last_day', 'p_model.days', 'p_model.rows']) AS key, unnest(['4', '60,30,10', min(day)::VARCHAR, max(day)::VARCHAR, count(DISTINCT day)::VARCHAR, count(*)::VARCHAR]) AS value FROM train
UNION ALL SELECT unnest(['p_base.first_day', 'p_base.last_day', 'p_base.days', 'p_base.rows']), unnest([min(day)::VARCHAR, max(day)::VARCHAR, count(DISTINCT day)::VARCHAR, count(*)::VARCHAR]) FROM b
UNION ALL SELECT 'rate.' || cutoff_min, printf('%.4f', round(avg(fail::INT), 6)) FROM train GROUP BY cutoff_min""",
    "bundle_profile": f"""WITH {LABELLED}, {TRAIN}, x AS (SELECT unnest(['segment_a', 'segment_b', 'hub']) AS input, unnest([{SEGMENT.format("ca")}, {SEGMENT.format("cb")}, hub]) AS bin FROM train)
SELECT input, bin, round(count(*) / (SELECT count(*) FROM train)::DOUBLE, 6) AS share FROM x GROUP BY ALL""",
    "live_failure_rates": f"""WITH {LABELLED}, {TRAIN}, f AS (SELECT cutoff_min, avg(fail::INT) AS fit FROM train GROUP BY 1)
SELECT cutoff_min AS cutoff, count(*) AS rows, round(avg(t.fail::INT), 6) AS fail_rate, round(any_value(fit), 6) AS fit_rate, round(avg(t.fail::INT) - any_value(fit), 6) AS difference FROM train t JOIN f USING (cutoff_min) WHERE day(day) > 15 GROUP BY cutoff_min""",
    "scored_stream": "WITH " + PAIRS.replace("FROM plan a JOIN plan b", "FROM near a JOIN near b").replace("FROM plan WHERE event = 'dp' AND eva IN", "FROM near WHERE event = 'dp' AND eva IN").replace("onward AS", f"{OBS}, {NOW}, near AS (SELECT p.* FROM plan p, nowt WHERE p.pt - INTERVAL 2 DAY <= now), onward AS", 1)
    + f""",
st AS (SELECT key, arg_max(row(obs, ct, cs), row(obs, ct, cs)) AS s FROM obs, nowt WHERE obs <= now GROUP BY key),
last_ AS (SELECT eva, max(obs) AS poll FROM obs, nowt WHERE obs <= now GROUP BY eva),
ev2 AS (SELECT n.*, coalesce(st.s[3] = 'c', false) AS gone, {mins("coalesce(st.s[2], n.pt)", "n.pt")} AS delay, {mins("now", "n.pt")} AS age FROM near n LEFT JOIN st USING (key), nowt),
hubst AS (SELECT eva, avg(gone::INT) AS share_cancel, avg(delay) FILTER (NOT gone) AS mean_delay FROM ev2 WHERE abs(age) <= 30 GROUP BY eva),
linest AS (SELECT eva, line, avg(delay) AS d FROM ev2 WHERE event = 'ar' AND age >= 0 AND age < 60 AND NOT gone AND line IS NOT NULL GROUP BY ALL),
goodn AS (SELECT c.*, now, {mins("c.pta", "now")} AS ahead, poll, a.s[2] AS act, a.s[3] AS acs, b.s[2] AS bct, b.s[3] AS bcs FROM cand c, nowt LEFT JOIN last_ l ON l.eva = c.eva LEFT JOIN st a ON a.key = c.ka LEFT JOIN st b ON b.key = c.kb)
SELECT sa AS stop_id_a, sb AS stop_id_b, hub, CASE WHEN coalesce(acs = 'c', false) THEN 'a_cancelled' WHEN poll IS NULL OR {mins("now", "poll")} > 45 THEN 'collector_gap' ELSE 'ok' END AS status, epoch_us(now) AS scored_us, round(ahead, 6) AS minutes_to_arrival,
  round({mins("coalesce(bct, ptb)", "coalesce(act, pta)")}, 6) AS db_slack_min, coalesce(bcs = 'c', false)::INT::DOUBLE AS b_cancel_known, round(h.mean_delay, 6) AS hub_mean_delay, round(h.share_cancel, 6) AS hub_share_cancel, round(n.d, 6) AS line_delay
FROM goodn g LEFT JOIN hubst h ON h.eva = g.eva LEFT JOIN linest n ON n.eva = g.eva AND n.line = g.la WHERE ahead >= 2 AND ahead <= 1440""",
    "connections_at_risk": f"""WITH {FIXED} SELECT sa AS stop_id_a, sb AS stop_id_b, status, round(risk, 6) AS risk, round(ahead, 6) AS minutes_to_arrival, CASE WHEN ahead <= 20 THEN 10 WHEN ahead <= 45 THEN 30 ELSE 60 END AS cutoff_min,
  {NAME.format(l="la", c="ca", n="na")} AS train_a, {NAME.format(l="lb", c="cb", n="nb")} AS train_b, {ISO.format("pta")} AS arrives, {ISO.format("ptb")} AS departs
FROM up WHERE hub = 'ASIA' AND ahead BETWEEN 0 AND 600 AND (risk IS NULL OR risk >= 0.2)""",
    "one_connection": f"WITH {FIXED} SELECT sa AS stop_id_a, sb AS stop_id_b, hub, status, round(risk, 6) AS risk, {ISO.format('pta')} AS arrives FROM up ORDER BY pta, sa, sb LIMIT 1",
    "day_periods": f"WITH d AS (SELECT o_orderdate::DATE AS day FROM orders) SELECT strftime(day, '%Y-%m-%d') AS day, {PERIOD} AS period, count(*) AS rows FROM d GROUP BY ALL",
    "unlocked_rows": "SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS price, 1 AS locked_read_refused FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'",
    "fold_days": f"""WITH {MONTHS}, f AS (SELECT unnest(range(((last - 1 - 12) // 3 + 1)::BIGINT)) AS fold FROM (SELECT any_value(last) AS last FROM nr) WHERE last > 12)
SELECT ((n - 13) // 3)::INT AS fold, strftime(day, '%Y-%m-%d') AS day, 'evaluate' AS role FROM nr WHERE n > 12
UNION ALL SELECT fold::INT, strftime(nr.day, '%Y-%m-%d'), 'fit' FROM f JOIN nr ON nr.n <= 12 + fold * 3 JOIN nr w ON w.n = 12 + fold * 3 WHERE date_diff('day', nr.day, w.day) < 400""",
    "left_out_months": f"WITH {MONTHS} SELECT (n - 1)::INT AS fold, last - 1 AS fit, strftime(day, '%Y-%m-%d') AS evaluated FROM nr",
    "rule_table": f"""WITH {LABELLED}, x AS (SELECT cutoff_min, hub, fail::INT AS fail, (coalesce(dslack < 4, false) OR known)::INT AS rule, abs(da - a_final) AS err, known FROM ds WHERE reason IS NULL)
SELECT cutoff_min, hub, count(*) AS rows, round(avg(err), 6) AS mae, round(avg(known::INT), 6) AS known_cancel, round(sum(fail * rule) / nullif(sum(rule), 0)::DOUBLE, 6) AS precision, round(sum(fail * rule) / nullif(sum(fail), 0)::DOUBLE, 6) AS recall FROM x GROUP BY ALL HAVING count(*) >= 200""",
    "decision_thresholds": f"""WITH {PRED}, g AS (SELECT cutoff_min, sum(flag * label) / nullif(sum(flag), 0)::DOUBLE AS goal FROM pred GROUP BY 1), c AS (SELECT cutoff_min, p_model AS s, sum(label) AS pos, count(*) AS n FROM pred GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY cutoff_min) AS allpos FROM c JOIN g USING (cutoff_min) WINDOW w AS (PARTITION BY cutoff_min ORDER BY s DESC)),
ok AS (SELECT * FROM t WHERE tp / k::DOUBLE >= goal QUALIFY row_number() OVER (PARTITION BY cutoff_min ORDER BY tp DESC, s) = 1),
x AS (SELECT p.cutoff_min, g.goal, ok.s, ok.tp / ok.allpos::DOUBLE AS recall, CASE WHEN ok.s IS NOT NULL THEN (p.p_model >= ok.s)::INT END AS f, label FROM pred p JOIN g USING (cutoff_min) LEFT JOIN ok USING (cutoff_min))
SELECT cutoff_min, round(goal, 6) AS precision, round(s, 6) AS threshold, round(recall, 6) AS recall, round(avg(f * label), 6) AS hit, round(avg(f * (1 - label)), 6) AS false_alarm, round(avg((1 - f) * label), 6) AS missed, round(avg((1 - f) * (1 - label)), 6) AS quiet FROM x GROUP BY cutoff_min, goal, s, recall""",
    "variant_comparison": f"""WITH {VARIANTS}, {AREAS.format(g="subject, kind, cutoff", auc=0)}
SELECT subject, kind, cutoff, days, rows, round(gain, 6) AS gain, round(low, 6) AS low, round(high, 6) AS high, round(day_share, 6) AS day_share, round(diff, 6) AS auc_diff FROM facts JOIN gains USING (subject, kind, cutoff) JOIN aucs USING (subject, kind, cutoff)""",
    "group_verdicts": f"""WITH {VARIANTS}, r AS (SELECT * FROM facts JOIN gains USING (subject, kind, cutoff)), noise AS (SELECT cutoff, abs(gain) AS noise FROM r WHERE kind = 'noise'),
l AS (SELECT greatest(0.005, coalesce(2 * max(noise) FILTER (cutoff = 30), 0)) AS least FROM noise),
j AS (SELECT subject, kind, max(r.gain) FILTER (r.cutoff = 30) AS gain, max(low) FILTER (r.cutoff = 30) AS low, max(day_share) FILTER (r.cutoff = 30) AS share, coalesce(bool_or(r.cutoff <> 30 AND r.gain < -greatest(0.002, coalesce(2 * noise, 0))), false) AS harm
  FROM r LEFT JOIN noise USING (cutoff) WHERE kind <> 'noise' GROUP BY subject, kind),
f AS (SELECT *, list_filter([CASE WHEN gain IS NULL THEN 'not_evaluated' END, CASE WHEN gain < least THEN 'gain' END, CASE WHEN low <= 0 THEN 'interval' END, CASE WHEN share < 0.6 THEN 'days' END, CASE WHEN harm THEN 'other_cutoff' END], lambda x: x IS NOT NULL) AS failed FROM j, l)
SELECT subject, kind, round(gain, 6) AS gain, round(least, 6) AS least, len(failed) = 0 AS passes, array_to_string(failed, ',') AS failed FROM f""",
    "gains_per_slice": f"WITH {VARIANTS.split(',' + chr(10) + 'pairs AS')[0]} SELECT cutoff_min, priority, count(*) AS rows, round(1 - avg({ll('with_trend')}) / avg({ll('in_use')}), 6) AS gain FROM v GROUP BY ALL",
    "recomputed_skew": f"""WITH {LABELLED}, x AS (SELECT *, na::BIGINT % 9 <> 0 AS same FROM ds)
SELECT unnest(['db_delay_a_min', 'db_delay_b_min', 'db_slack_min', 'b_cancel_known', '<row>']) AS feature, count(*) AS rows, unnest([1.0, 1.0, round(avg(same::INT), 6), 1.0, round(avg(same::INT), 6)]) AS equal_share, unnest([0.0, 0.0, round(avg((NOT same)::INT), 6), 0.0, NULL]) AS mean_abs_diff FROM x""",
    "pooled_summary": f"""WITH {PRED}, ev_ AS (SELECT * FROM pred WHERE l_linenumber <> 5), {losses("cutoff_min", "ev_", "label", "p_model", "p_base")}, {BOOT.format(g="cutoff_min", draws=1000)}, {AREAS.format(g="cutoff_min", auc=0)},
s AS (SELECT cutoff_min, avg(y) AS f, avg(lm) AS m, avg(lb) AS b FROM loss GROUP BY 1)
SELECT cutoff_min, days, rows, round(f, 6) AS fail_rate, round(m, 6) AS model_log_loss, round(b, 6) AS base_log_loss, round(gain, 6) AS log_loss_gain, round(low, 6) AS log_loss_gain_low, round(high, 6) AS log_loss_gain_high, round(diff, 6) AS auc_diff FROM facts JOIN gains USING (cutoff_min) JOIN aucs USING (cutoff_min) JOIN s USING (cutoff_min)""",
    "bootstrap_over_days": f"""WITH {PRED}, one_ AS (SELECT 1 AS g, * FROM pred), {losses("g", "one_", "label", "p_model", "p_base")}, {BOOT.format(g="g", draws=1000)}, {AREAS.format(g="g", auc=200)}
SELECT days, rows, round(day_share, 6) AS day_share, round(gain, 6) AS log_loss_gain, round(low, 6) AS log_loss_gain_low, round(high, 6) AS log_loss_gain_high, round(brier, 6) AS brier_gain, round(brier_low, 6) AS brier_gain_low, round(brier_high, 6) AS brier_gain_high,
  round(diff, 6) AS auc_diff, round(diff_low, 6) AS auc_diff_low, round(diff_high, 6) AS auc_diff_high FROM facts, gains, aucs""",
    "daily_summary": """WITH l AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS day FROM lineitem), a AS (SELECT day, count(*) AS logged, avg(l_discount) AS d, avg(l_tax) AS t FROM l GROUP BY 1), s AS (SELECT day, avg((l_linestatus = 'O')::INT) AS same FROM l GROUP BY 1)
SELECT day, logged, CASE WHEN d >= t THEN 'l_discount' ELSE 'l_tax' END AS max_psi_input, round(greatest(d, t), 6) AS max_psi, round(same, 6) AS identical_share FROM a JOIN s USING (day)""",
    "complete_days": "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events) SELECT strftime(day, '%Y-%m-%d') AS day, (SELECT max(ts) FROM events) >= day + INTERVAL 1 DAY + INTERVAL 6 HOUR AS complete FROM d",
    "observability": f"""WITH {LABELLED}, n AS (SELECT key, count(*) AS n FROM obs GROUP BY key),
x AS (SELECT hub, (act IS NOT NULL OR ac) AND (bct IS NOT NULL OR bc) AS seen, coalesce(NOT ac AND ao < act, false) OR coalesce(NOT bc AND bo < bct, false) AS stale, coalesce(a.n, 0) AS na_, coalesce(b.n, 0) AS nb_ FROM lab LEFT JOIN n a ON a.key = ka LEFT JOIN n b ON b.key = kb)
SELECT hub, count(*) AS pairs, round(avg(seen::INT), 6) AS observed, round(avg(stale::INT), 6) AS stale, round(quantile_cont(na_, 0.5), 6) AS median_a, round(quantile_cont(nb_, 0.5), 6) AS median_b FROM x GROUP BY hub""",
    "failure_rates": f"""WITH {LABELLED}, x AS (SELECT cutoff_min, unnest(['hub', 'segments', 'hour', 'slack']) AS dimension, unnest([hub, {SEGMENT.format("ca")} || '>' || {SEGMENT.format("cb")}, hour(pta)::VARCHAR, floor(slack / 10)::INT::VARCHAR]) AS value, fail::INT AS f, (NOT ac AND NOT bc AND coalesce(real_slack < 4, false))::INT AS late FROM ds WHERE reason IS NULL)
SELECT cutoff_min, dimension, value, count(*) AS rows, round(avg(f), 6) AS fail_rate, round(avg(late), 6) AS delay_rate FROM x GROUP BY ALL""",
    "slack_profile": f"WITH {PAIRS} SELECT eva, count(*) AS n, round(avg(slack), 6) AS mean, round(quantile_cont(slack, 0.05), 6) AS p05, round(quantile_cont(slack, 0.5), 6) AS p50, round(quantile_cont(slack, 0.95), 6) AS p95 FROM good GROUP BY eva",
    "category_pairs": f"""WITH {PAIRS}, c AS (SELECT eva, ca || '>' || cb AS pair, count(*) AS n FROM good GROUP BY ALL)
SELECT eva, pair, n, row_number() OVER w AS rank, round(n / sum(n) OVER (PARTITION BY eva)::DOUBLE, 6) AS share FROM c WINDOW w AS (PARTITION BY eva ORDER BY n DESC, pair) QUALIFY rank <= 5""",
    "feeder_coverage": f"""WITH {PLAN}, a AS (SELECT eva, stop_id, len(list_filter(string_split(coalesce(path, ''), '|'), lambda x: x IN ('S0', 'S1', 'S2', 'S3', 'S4'))) AS k FROM plan WHERE event = 'ar')
SELECT eva, count(*) AS arrivals, round(avg((k > 0)::INT), 6) AS covered, round(avg(k), 6) AS feeders_each FROM a GROUP BY eva""",
    "feeder_lead_times": f"""WITH {FEED}, x AS (SELECT eva, {mins("pt", "f_pt")} AS lead FROM feed)
SELECT eva, count(*) AS arrivals, round(quantile_cont(lead, 0.1), 6) AS p10, round(quantile_cont(lead, 0.5), 6) AS p50, round(quantile_cont(lead, 0.9), 6) AS p90, {", ".join(f"round(avg(coalesce(lead >= {c}, false)::INT), 6) AS passed_{c}" for c in (60, 30, 10))} FROM x GROUP BY eva""",
    "feeder_against_prognosis": f"""WITH {FEED}, q AS (SELECT *, pt - INTERVAL 30 MINUTE AS t_cut, ff[2] / 60 AS feeder FROM feed), k AS (SELECT q.*, o.ct FROM q ASOF LEFT JOIN obs o ON q.key = o.key AND q.t_cut >= o.obs),
fin AS (SELECT key, ct AS final FROM obs QUALIFY row_number() OVER (PARTITION BY key ORDER BY obs DESC, ct DESC NULLS LAST, cs DESC NULLS LAST) = 1),
r AS (SELECT eva, feeder, {mins("coalesce(ct, pt)", "pt")} AS prog, {mins("final", "pt")} AS act FROM k JOIN fin USING (key) WHERE feeder IS NOT NULL)
SELECT eva, count(*) AS rows, round(avg(abs(feeder - act)), 3) AS feeder_mae, round(avg(abs(prog - act)), 3) AS prognosis_mae, round(corr(feeder, prog), 4) AS corr FROM r GROUP BY eva""",
    "poll_within_tolerance": f"""WITH {EV}, q AS (SELECT event_id, eva, ts - INTERVAL 30 MINUTE AS t FROM ev WHERE event_type = 'purchase'), p AS (SELECT eva, ts, max(value) AS value FROM ev WHERE event_type = 'click' GROUP BY ALL),
j AS (SELECT event_id, t, p.ts AS poll, p.value FROM q ASOF LEFT JOIN p ON q.eva = p.eva AND q.t >= p.ts)
SELECT event_id, CASE WHEN poll >= t - INTERVAL 15 MINUTE THEN epoch_us(poll) END AS poll_us, CASE WHEN poll >= t - INTERVAL 15 MINUTE THEN round(value, 6) END AS value FROM j""",
    "training_days": f"""WITH {LABELLED} SELECT strftime(({BERLIN.format("pta")} - INTERVAL 4 HOUR)::DATE, '%Y-%m-%d') AS service_day, cutoff_min, count(*) AS rows, count(*) FILTER (reason IS NULL) AS eligible, count(*) FILTER (fail) AS failed, 32 AS safe_columns FROM ds GROUP BY ALL""",
    "single_inputs": f"""WITH {PRED}, x AS (SELECT label, unnest(['p_model', 'p_base', 'flag', 'turned', 'with_nulls']) AS feature, unnest([p_model, p_base, flag::DOUBLE, -p_base, CASE WHEN l_linenumber <> 3 THEN p_model END]) AS s FROM pred),
r AS (SELECT *, {ranks('s', 'feature')} AS r FROM x WHERE s IS NOT NULL), a AS (SELECT feature, {area('r', 'label')} AS a FROM r GROUP BY feature) SELECT feature, round(greatest(a, 1 - a), 6) AS auc FROM a""",
    "chosen_model": f"""WITH {PRED}, l AS (SELECT unnest(['p_base', 'p_mean', 'p_model']) AS model, unnest([avg({ll('p_base')}), avg({ll('(p_base + p_model) / 2')}), avg({ll('p_model')})]) AS loss FROM pred)
SELECT model, round(loss, 6) AS log_loss, model = (SELECT min(model) FROM l WHERE loss <= (SELECT min(loss) FROM l) * 1.01) AS chosen FROM l""",
    "connection_features": f"WITH {FEATURES} SELECT * FROM fx",
    "skew_of_all_features": f"""WITH {CONNECTIONS}, x AS (SELECT na::BIGINT % 9 <> 0 AS slack_same, na::BIGINT % 7 <> 0 AS segment_same FROM r), n AS (SELECT count(*) AS rows, avg(slack_same::INT) AS s, avg(segment_same::INT) AS g, avg((slack_same AND segment_same)::INT) AS b FROM x),
f AS (SELECT unnest([{", ".join(repr(c) for c in (*feature_columns(list(GROUPS)), "<row>"))}]) AS feature)
SELECT feature, rows, round(CASE feature WHEN 'planned_slack_min' THEN s WHEN 'segment_a' THEN g WHEN '<row>' THEN b ELSE 1 END, 6) AS equal_share, CASE WHEN feature = 'planned_slack_min' AND s < 1 THEN 2.0 END AS mean_abs_diff_where_different FROM f, n WHERE rows > 0""",
    "message_flags": f"""WITH {PLAN}, rows_ AS (SELECT stop_id, key, pt - INTERVAL 30 MINUTE AS t_cut FROM plan WHERE event = 'ar'), {MSGS} SELECT r.stop_id, count(*) FILTER (f.type = 'c') AS n_delay, count(*) FILTER (f.type = 'e') AS n_quality, count(*) FILTER (f.type = 'v') AS n_other,
  count(*) FILTER (f.type = 'h') > 0 AS h_notice, count(*) FILTER (f.type = 's') > 0 AS s_notice, count(*) FILTER (f.type = 'p') > 0 AS p_notice FROM rows_ r LEFT JOIN firsts f ON f.key = r.key AND f.obs <= r.t_cut GROUP BY r.stop_id""",
    "seeded_examples": "SELECT s_suppkey, s_name FROM supplier ORDER BY md5('3:' || s_suppkey), s_suppkey LIMIT 10",
    "page_element_census": r"""WITH t AS (SELECT unnest(regexp_extract_all(html, '(<[A-Za-z][^<>]*>)', 1)) AS tag FROM pages),
p AS (SELECT regexp_extract(tag, '^<([A-Za-z][-A-Za-z0-9_:.]*)', 1) AS element, unnest(regexp_extract_all(tag, '([A-Za-z_:][-A-Za-z0-9_:.]*\s*=\s*(?:"[^"]*"|''[^'']*''))', 1)) AS pair FROM t),
v AS (SELECT element, regexp_extract(pair, '^([-A-Za-z0-9_:.]+)', 1) AS attribute, regexp_extract(pair, '(?s)=\s*(.*)$', 1) AS q FROM p),
c AS (SELECT element, attribute, q[2:-2] AS value, count(*) AS n FROM v GROUP BY ALL)
SELECT element, attribute, value, n, row_number() OVER (PARTITION BY element, attribute ORDER BY n DESC, value) AS rank FROM c QUALIFY rank <= 3""",
    "schema_census": """WITH c AS (SELECT table_name, string_agg(column_name || ':' || CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp[us]' ELSE lower(data_type) END, ',' ORDER BY column_name) AS signature FROM duckdb_columns() WHERE table_name IN ('orders', 'lineitem', 'customer', 'part', 'region', 'nation') GROUP BY 1),
n AS (SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'nation', count(*) FROM nation)
SELECT signature, count(*) AS files, sum(rows)::BIGINT AS rows FROM c JOIN n USING (table_name) GROUP BY signature""",
    "partial_correlation": """WITH x AS (SELECT l_extendedprice AS x, l_quantity AS y, coalesce(CASE WHEN l_linenumber <> 4 THEN l_discount END, (SELECT avg(l_discount) FROM lineitem WHERE l_linenumber <> 4)) AS a, (l_linenumber = 4)::INT AS b, l_tax AS c FROM lineitem),
m AS (SELECT x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, c - avg(c) OVER () AS c FROM x),
b1 AS (SELECT sum(a * b) / sum(b * b) AS ab, sum(c * b) / sum(b * b) AS cb, sum(x * b) / sum(b * b) AS xb, sum(y * b) / sum(b * b) AS yb FROM m), m1 AS (SELECT x - xb * b AS x, y - yb * b AS y, a - ab * b AS a, c - cb * b AS c FROM m, b1),
b2 AS (SELECT sum(c * a) / sum(a * a) AS ca, sum(x * a) / sum(a * a) AS xa, sum(y * a) / sum(a * a) AS ya FROM m1), m2 AS (SELECT x - xa * a AS x, y - ya * a AS y, c - ca * a AS c FROM m1, b2),
b3 AS (SELECT sum(x * c) / sum(c * c) AS xc, sum(y * c) / sum(c * c) AS yc FROM m2), m3 AS (SELECT x - xc * c AS x, y - yc * c AS y FROM m2, b3)
SELECT count(*) AS n, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS partial_corr FROM m3""",
    "performance_report": f"""WITH {PRED}, l AS (SELECT *, l_orderkey % 40 + round(p_model * 10) AS lag, l_orderkey % 200 + p_base AS age FROM pred),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY lag, p_model, p_base, flag, cutoff_min, age) = 1),
o AS (SELECT l_orderkey, l_linenumber, max(label) AS y FROM pred GROUP BY ALL HAVING max(l_linenumber) <> 5),
j AS (SELECT f.* EXCLUDE (label), y FROM f JOIN o USING (l_orderkey, l_linenumber)), r AS (SELECT *, {ranks("p_model", "cutoff_min")} AS r FROM j),
g AS (SELECT cutoff_min, count(*) AS n, avg({ll("p_model", "y")}) AS ml, avg({ll("p_base", "y")}) AS bl, avg((p_model - y) * (p_model - y)) AS br, {area("r", "y")} AS a, sum(flag * y) / nullif(sum(flag), 0)::DOUBLE AS prec, sum(flag * y) / nullif(sum(y), 0)::DOUBLE AS rec FROM r GROUP BY 1),
c AS (SELECT cutoff_min, p_model AS s, sum(y) AS pos, count(*) AS n FROM j GROUP BY ALL), t AS (SELECT *, sum(pos) OVER w AS tp, sum(c.n) OVER w AS k, sum(pos) OVER (PARTITION BY cutoff_min) AS allpos FROM c WINDOW w AS (PARTITION BY cutoff_min ORDER BY s DESC)),
b AS (SELECT t.cutoff_min, max(tp / allpos::DOUBLE) AS rap FROM t JOIN g USING (cutoff_min) WHERE tp / k::DOUBLE >= prec GROUP BY 1)
SELECT cutoff_min, n AS model_n, round(ml, 6) AS model_log_loss, round(bl, 6) AS base_log_loss, round(br, 6) AS model_brier, round(a, 6) AS model_auc, round(prec, 6) AS rule_precision, round(rec, 6) AS rule_recall, round(rap, 6) AS recall_at_rule_precision, round(1 - ml / bl, 6) AS gain FROM g LEFT JOIN b USING (cutoff_min)""",
    "station_cover": f"""WITH {PLAN}, r AS (SELECT DISTINCT stop_id, unnest(list_filter(string_split(coalesce(path, ''), '|'), lambda x: x <> '')) AS s, num::BIGINT % 3 + 1 AS w FROM plan WHERE event = 'ar'), tot AS (SELECT sum(num::BIGINT % 3 + 1) AS t FROM plan WHERE event = 'ar'),
a AS (SELECT s, sum(w)::DOUBLE AS added FROM r GROUP BY s ORDER BY added DESC, s LIMIT 1), r2 AS (SELECT * FROM r WHERE stop_id NOT IN (SELECT stop_id FROM r JOIN a USING (s))),
b AS (SELECT s, sum(w)::DOUBLE AS added FROM r2 GROUP BY s ORDER BY added DESC, s LIMIT 1), r3 AS (SELECT * FROM r2 WHERE stop_id NOT IN (SELECT stop_id FROM r2 JOIN b USING (s))),
c AS (SELECT s, sum(w)::DOUBLE AS added FROM r3 GROUP BY s ORDER BY added DESC, s LIMIT 1)
SELECT 1 AS pick, s AS item, added, round(added / t, 6) AS share FROM a, tot UNION ALL SELECT 2, b.s, b.added, round((a.added + b.added) / t, 6) FROM a, b, tot UNION ALL SELECT 3, c.s, c.added, round((a.added + b.added + c.added) / t, 6) FROM a, b, c, tot""",
    "matched_runs": f"""WITH {PLAN}, b AS (SELECT eva, trip, event FROM plan WHERE cat <> 'Bus' QUALIFY row_number() OVER (PARTITION BY eva, trip ORDER BY (event <> 'dp')::INT, pt, stop_id, event) = 1)
SELECT p.eva, count(*) AS arrivals, round(avg((b.event IS NOT NULL)::INT), 6) AS match_rate, round(avg((b.event = 'dp')::INT), 6) AS departing FROM plan p LEFT JOIN b ON b.eva = p.eva AND b.trip = p.trip WHERE p.event = 'ar' GROUP BY p.eva""",
    "named_suppliers": """SELECT s_suppkey, s_name, count(*) AS lines, round(count(*) / count(DISTINCT l_shipdate::DATE)::DOUBLE, 6) AS lines_per_day, round(avg(l_quantity), 6) AS quantity FROM supplier JOIN lineitem ON l_suppkey = s_suppkey
WHERE s_name ILIKE '%SUPPLIER%1%' GROUP BY ALL ORDER BY lines DESC, s_suppkey LIMIT 20""",
    "cancellation_shares": f"WITH {EV} SELECT eva, hour(ts)::INT AS hour, count(*) AS rows, round(avg((event_type = 'error')::INT), 6) AS cancelled, round(avg((event_type = 'signup')::INT), 6) AS replaced, round(avg((value > 60)::INT) FILTER (event_type <> 'error'), 6) AS late FROM ev GROUP BY ALL",
    "hub_period_summary": f"WITH {LABELLED} SELECT hub, cutoff_min, week(pta)::INT AS week, count(*) AS rows, round(avg(fail::INT), 6) AS fail_rate, round(avg(slack), 6) AS mean_slack FROM ds WHERE reason IS NULL GROUP BY ALL",
    "gains_per_day_and_slice": f"WITH {PRED} SELECT day, priority, count(*) AS rows, round(1 - avg({ll('p_model')}) / avg({ll('p_base')}), 6) AS gain FROM pred GROUP BY ALL",
    "latest_from_snapshot": f"""WITH {SPAN}, e AS (SELECT events.* FROM events, span WHERE epoch_us(ts) <= lo + floor((hi - lo) * 0.7::DOUBLE))
SELECT user_id, arg_max(event_type, row(ts, event_id)) FILTER (event_type <> 'view') AS doing, round(arg_max(value, row(ts, event_id)) FILTER (value > 60), 6) AS late, epoch_us(min(ts)) AS first_us FROM e GROUP BY user_id""",
    "profiled_months": """WITH o AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'before' ELSE 'since' END AS stretch, * FROM orders)
SELECT stretch, 'o_totalprice' AS input, NULL::VARCHAR AS v, count(*) AS rows, count(*) - count(o_totalprice) AS missing, round(min(o_totalprice), 6) AS low, round(max(o_totalprice), 6) AS high, true AS close FROM o GROUP BY stretch
UNION ALL SELECT stretch, 'o_orderpriority', coalesce(o_orderpriority, '<missing>'), count(*), count(*) - count(o_orderpriority), NULL, NULL, NULL FROM o GROUP BY ALL""",
}
