"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Each one restates the meaning from scratch: plain grouping, self-joins and whole-partition windows, none of the
slicing, carrying or two-step aggregation of the Spark plans.
"""

from __future__ import annotations

HOURS_PER_WINDOW = 6
SPEED_TTL_SECONDS = 6 * 3600


def r(expr: str, digits: int) -> str:
    """Decimal rounding after dropping noise beyond the ninth digit."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"


def clamp(expr: str, top: str = "1e0") -> str:
    return f"greatest(least({expr}, {top}), 0e0)"


def level(score: str, low: str = "0.3e0", moderate: str = "0.55e0", high: str = "0.8e0") -> str:
    return (
        f"CASE WHEN {score} < {low} THEN 'LOW' WHEN {score} < {moderate} THEN 'MODERATE' "
        f"WHEN {score} < {high} THEN 'HIGH' ELSE 'SEVERE' END"
    )


def score(count: str, speed: str, stopped: str, max_count: str, max_speed: str = "60e0") -> str:
    load = clamp(f"{count} / {max_count}")
    slow = clamp(f"{speed} / {max_speed}")
    return clamp(f"0.4e0 * {load} + 0.4e0 * (1e0 - {slow}) + 0.2e0 * {stopped}")


DETECTIONS = """
keyed AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
det AS (
  SELECT k,
    CASE WHEN k % 3 = 0 THEN 'cam_0' ELSE 'cam_' || (user_id % 32) END AS camera_id,
    ts, event_id AS frame_id, 'veh_' || user_id AS vehicle_id,
    CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'bus' WHEN 'purchase' THEN 'truck'
      WHEN 'signup' THEN 'motorcycle' ELSE 'unknown' END AS vehicle_class,
    CASE WHEN k = 99 THEN 1.4e0 ELSE 0.5e0 + k / 200e0 END AS confidence,
    (event_id * 7 % 1900) / 4e0 AS bx, (event_id * 11 % 1000) / 4e0 AS by_,
    CAST(k + 80 AS DOUBLE) AS bw, k + 40.5e0 AS bh,
    CAST(event_id * 37 % 1920 AS DOUBLE) AS centroid_x, CAST(event_id * 53 % 1080 AS DOUBLE) AS centroid_y,
    CASE WHEN k % 5 <> 0 THEN k % 3 + 1 END AS lane_id,
    CASE WHEN k % 7 <> 0 THEN value / 5e0 END AS speed_kmh
  FROM keyed
),
ev AS (SELECT * FROM det WHERE vehicle_class <> 'unknown' AND confidence BETWEEN 0 AND 1)
"""

CLASSES = ("car", "bus", "truck", "motorcycle", "bicycle", "pedestrian")


def metrics(source: str = "ev", name: str = "m", interval: str = "6 hours", max_count: str = "25e0") -> str:
    """CTEs that compute window metrics of ``source`` as ``name``."""
    counts = ", ".join(f"count(*) FILTER (vehicle_class = '{c}') AS n_{c}" for c in CLASSES)
    parts = ", ".join(f"CASE WHEN n_{c} > 0 THEN '\"{c}\":' || n_{c} END" for c in CLASSES)
    s = score("vehicle_count", "avg_speed_kmh", "stopped_ratio", max_count)
    return f"""
{name}_g AS (
  SELECT camera_id, CAST(NULL AS INTEGER) AS lane_id, ts, vehicle_id, vehicle_class, speed_kmh FROM {source}
  UNION ALL
  SELECT camera_id, lane_id, ts, vehicle_id, vehicle_class, speed_kmh FROM {source} WHERE lane_id IS NOT NULL
),
{name}_a AS (
  SELECT camera_id, lane_id, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') AS window_start,
    count(DISTINCT vehicle_id) AS vehicle_count, {counts},
    coalesce({r('avg(speed_kmh)', 2)}, 0e0) AS avg_speed_kmh,
    coalesce({r('avg(CASE WHEN speed_kmh < 5 THEN 1e0 WHEN speed_kmh IS NOT NULL THEN 0e0 END)', 4)}, 0e0)
      AS stopped_ratio,
    count(DISTINCT CASE WHEN speed_kmh < 5 THEN vehicle_id END) AS queue_length
  FROM {name}_g GROUP BY ALL
),
{name}_s AS (SELECT *, {s} AS raw_score FROM {name}_a),
{name} AS (
  SELECT camera_id, window_start, window_start + INTERVAL '{interval}' AS window_end, lane_id, vehicle_count,
    '{{' || concat_ws(',', {parts}) || '}}' AS counts_by_class, avg_speed_kmh, stopped_ratio, queue_length,
    {level('raw_score')} AS congestion_level, {r('raw_score', 4)} AS congestion_score
  FROM {name}_s
)"""


BASE = "WITH " + DETECTIONS + "," + metrics()
CAMERAS = """
cameras AS (
  SELECT 'cam_' || n_nationkey AS camera_id, n_name AS name,
    CASE WHEN n_nationkey <> 6 THEN n_nationkey * 5.5e0 - 60 END AS latitude,
    CASE WHEN n_nationkey <> 6 THEN n_nationkey * 11.25e0 - 120 END AS longitude,
    CASE WHEN n_nationkey <> 7 THEN r_name END AS road_segment, CAST(NULL AS VARCHAR) AS description
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
)"""
AS_OF = "(SELECT time_bucket(INTERVAL '6 hours', max(ts), TIMESTAMP '1970-01-01') + INTERVAL '6 hours' FROM ev)"


def with_base(sql: str, *ctes: str) -> str:
    return ",".join([BASE, *ctes]) + "\n" + sql


def with_events(sql: str, *ctes: str) -> str:
    return ",".join(["WITH " + DETECTIONS, *ctes]) + "\n" + sql


LATEST = """
latest AS (
  SELECT m.* FROM m JOIN (SELECT camera_id, max(window_start) AS ws FROM m WHERE lane_id IS NULL GROUP BY 1) t
    ON m.camera_id = t.camera_id AND m.window_start = t.ws WHERE m.lane_id IS NULL
)"""


def range_a(column: str = "window_start", close: str = "<=") -> str:
    return f"({column} >= TIMESTAMP '2024-01-02' AND {column} {close} TIMESTAMP '2024-01-10')"


def range_b(column: str = "window_start") -> str:
    return f"({column} >= TIMESTAMP '2024-01-08' AND {column} <= TIMESTAMP '2024-01-20')"


LAST_DAY = f"window_start >= {AS_OF} - INTERVAL 24 HOUR AND window_start <= {AS_OF}"


def summary(where: str, table: str = "m") -> str:
    rows = f"{table} WHERE lane_id IS NULL AND {where}"
    return f"""
SELECT coalesce({r('avg(congestion_score)', 6)}, 0e0) AS average_congestion,
  CAST(coalesce(sum(vehicle_count), 0) AS BIGINT) AS vehicle_count,
  coalesce({r('avg(avg_speed_kmh)', 6)}, 0e0) AS average_speed_kmh,
  count(*) FILTER (congestion_level IN ('HIGH', 'SEVERE')) AS incident_count,
  (SELECT CAST(hour(window_start) AS INTEGER) FROM {rows} GROUP BY 1
   ORDER BY round(avg(congestion_score), 9) DESC, 1 LIMIT 1) AS peak_hour
FROM {rows}"""


ALERTS = """
a_rows AS (
  SELECT camera_id, window_start, window_end, congestion_level, congestion_score,
    CASE congestion_level WHEN 'SEVERE' THEN 'CRITICAL' WHEN 'HIGH' THEN 'WARNING' END AS severity
  FROM {metrics} WHERE lane_id IS NULL
),
a_prev AS (SELECT *, lag(severity) OVER w AS before, lead(window_end) OVER w AS next_end,
    row_number() OVER w AS place FROM a_rows WINDOW w AS (PARTITION BY camera_id ORDER BY window_start)),
a_runs AS (SELECT *, sum(CASE WHEN before IS NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY camera_id ORDER BY window_start) AS run FROM a_prev WHERE severity IS NOT NULL),
a_agg AS (
  SELECT camera_id, run, min(window_end) AS triggered_at, arg_max(severity, window_start) AS severity,
    arg_max(congestion_level, window_start) AS congestion_level,
    arg_max(congestion_score, window_start) AS congestion_score, max(place) AS last_place
  FROM a_runs GROUP BY 1, 2
),
alerts AS (
  SELECT a.camera_id || '@' || strftime(triggered_at, '%Y%m%dT%H%M%S') AS alert_id, a.camera_id,
    CASE WHEN c.camera_id IS NOT NULL THEN c.road_segment ELSE a.camera_id END AS road_segment,
    'CONGESTION' AS alert_type, a.severity, a.severity || ' congestion' AS title,
    CASE WHEN n.window_end IS NOT NULL THEN 'Congestion resolved for camera ' || a.camera_id
      ELSE a.severity || ' congestion detected at camera ' || a.camera_id END AS message,
    a.congestion_level, a.congestion_score, triggered_at, n.window_end AS resolved_at,
    CAST(NULL AS VARCHAR) AS acknowledged_by, CAST(NULL AS TIMESTAMP) AS acknowledged_at,
    '{{"source":"writer","camera_id":"' || a.camera_id || '"}}' AS payload
  FROM a_agg a LEFT JOIN a_prev n ON n.camera_id = a.camera_id AND n.place = a.last_place + 1
  LEFT JOIN cameras c ON c.camera_id = a.camera_id
)"""
ALERT_CTES = (CAMERAS, ALERTS.format(metrics="m"))
ACKS = """
stamps AS (SELECT alert_id, camera_id, CAST(epoch(triggered_at) AS BIGINT) AS stamp FROM alerts),
acks AS (
  SELECT stamp * 1000 + CAST(substr(camera_id, 5) AS BIGINT) * 10 + n AS ack_id,
    CASE WHEN n = 3 THEN alert_id || '#' WHEN n < 3 THEN alert_id END AS alert_id, 'admin_' || n AS admin_id,
    make_timestamp((stamp + 600 * (4 - n)) * 1000000) AS acknowledged_at
  FROM stamps, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE n >= 3 OR (stamp / 21600) % 3 <> 0
),
acked AS (
  SELECT a.* REPLACE (k.admin_id AS acknowledged_by, k.acknowledged_at AS acknowledged_at) FROM alerts a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY acknowledged_at, ack_id) AS nth FROM acks) k
    ON k.alert_id = a.alert_id AND k.nth = 1
)"""
ACK_CTES = (*ALERT_CTES, ACKS)

HEAT = f"""
heat AS (
  SELECT camera_id, avg(congestion_score) AS score, avg(vehicle_count) AS avg_count, max(window_end) AS last_window
  FROM m WHERE lane_id IS NULL AND window_start >= {AS_OF} - INTERVAL 1440 MINUTE GROUP BY 1
)"""

SPEED = f"""
seen AS (
  SELECT *, lag(ts) OVER w AS p_ts, lag(centroid_x) OVER w AS p_x, lag(centroid_y) OVER w AS p_y FROM ev
  WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, frame_id)
),
timed AS (SELECT *, (epoch_us(ts) - epoch_us(p_ts)) / 1e6 AS dt,
  CASE camera_id WHEN 'cam_0' THEN 0.1e0 WHEN 'cam_1' THEN 0.02e0 ELSE 0.05e0 END AS px FROM seen),
filled AS (
  SELECT * REPLACE (coalesce(speed_kmh, CASE WHEN dt > 0 AND dt <= {SPEED_TTL_SECONDS} THEN
    sqrt(power(centroid_x - p_x, 2) + power(centroid_y - p_y, 2)) * px / dt * 3.6e0 END) AS speed_kmh) FROM timed
)"""

GAPS = """
lanes AS (SELECT camera_id, lane_id, min(window_start) AS first, max(window_start) AS last FROM m
  WHERE lane_id IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT camera_id, lane_id, unnest(generate_series(first, last, INTERVAL '6 hours')) AS window_start FROM lanes),
gaps AS (
  SELECT g.camera_id, g.lane_id, g.window_start, m.vehicle_count, m.avg_speed_kmh, m.stopped_ratio,
    m.congestion_score, m.congestion_level
  FROM grid g ASOF JOIN (SELECT * FROM m WHERE lane_id IS NOT NULL) m
    ON g.camera_id = m.camera_id AND g.lane_id = m.lane_id AND g.window_start >= m.window_start
)"""
FEATURES = """
feat AS (
  SELECT camera_id, lane_id, window_start,
    greatest(least(CAST(vehicle_count AS DOUBLE), 25e0), 0e0) / 25e0 AS vehicle_count,
    greatest(least(avg_speed_kmh, 60e0), 0e0) / 60e0 AS avg_speed_kmh,
    stopped_ratio, congestion_score,
    sin(6.2831853e0 * (hour(window_start) + minute(window_start) / 60e0) / 24) AS hour_sin,
    cos(6.2831853e0 * (hour(window_start) + minute(window_start) / 60e0) / 24) AS hour_cos,
    sin(6.2831853e0 * (isodow(window_start) - 1) / 7) AS dow_sin,
    cos(6.2831853e0 * (isodow(window_start) - 1) / 7) AS dow_cos,
    CASE congestion_level WHEN 'MODERATE' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'SEVERE' THEN 2 ELSE 0 END
      AS congestion_level_idx
  FROM gaps
)"""
FEATURE_NAMES = (
    "vehicle_count", "avg_speed_kmh", "stopped_ratio", "congestion_score", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
)
NODES = """
nodes AS (
  SELECT row_number() OVER (ORDER BY CAST(substr(camera_id, 5) AS INTEGER), lane_id) - 1 AS node, camera_id, lane_id
  FROM (SELECT DISTINCT camera_id, lane_id FROM ev WHERE lane_id IS NOT NULL)
)"""
DENSE = (
    """
dense AS (
  SELECT t.t_idx, t.window_start, n.node, """
    + ", ".join(f"coalesce(f.{c}, 0e0) AS {c}" for c in FEATURE_NAMES)
    + """, coalesce(f.congestion_level_idx, 0) AS congestion_level_idx,
    CASE coalesce(f.congestion_level_idx, 0) WHEN 1 THEN 0.5e0 WHEN 2 THEN 1e0 ELSE 0e0 END AS congestion_prob
  FROM (SELECT window_start, row_number() OVER (ORDER BY window_start) - 1 AS t_idx
        FROM (SELECT DISTINCT window_start FROM feat)) t
  CROSS JOIN nodes n
  LEFT JOIN feat f ON f.window_start = t.window_start AND f.camera_id = n.camera_id AND f.lane_id = n.lane_id
)"""
)
DENSE_CTES = (GAPS, FEATURES, NODES, DENSE)
ROUNDED_FEATURES = ", ".join(f"{r(c, 6)} AS {c}" for c in FEATURE_NAMES)

EVENT_EDGES = """
elinks AS (
  SELECT a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON a.camera_id = b.camera_id AND a.lane_id < b.lane_id
  WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.camera_id = a.camera_id AND c.lane_id > a.lane_id
    AND c.lane_id < b.lane_id)
  UNION ALL
  SELECT a.node, b.node FROM nodes a JOIN nodes b ON a.lane_id = 1 AND b.lane_id = 1
    AND b.camera_id = 'cam_' || (CAST(substr(a.camera_id, 5) AS INTEGER) + 1)
),
edges AS (SELECT node AS src, node AS dst FROM nodes UNION SELECT src, dst FROM elinks UNION SELECT dst, src FROM elinks),
hop1 AS (SELECT t_idx, e.dst AS node, avg(vehicle_count) AS vehicle_count, avg(congestion_score) AS congestion_score,
    avg(avg_speed_kmh) AS avg_speed_kmh, avg(stopped_ratio) AS stopped_ratio
  FROM dense d JOIN edges e ON e.src = d.node GROUP BY 1, 2),
hop2 AS (SELECT t_idx, e.dst AS node, avg(vehicle_count) AS vehicle_count, avg(congestion_score) AS congestion_score
  FROM hop1 d JOIN edges e ON e.src = d.node GROUP BY 1, 2)"""

#: The scaled Laplacian as a dense matrix, and Chebyshev polynomials 1 and 2 of it.
CHEBYSHEV = """
adjacent AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
degree AS (SELECT src AS node, count(*) AS d FROM adjacent GROUP BY 1),
lap AS (
  SELECT a.node AS i, b.node AS j,
    CASE WHEN e.src IS NULL THEN 0e0 ELSE -1e0 / sqrt(CAST(p.d AS DOUBLE) * q.d) END AS v
  FROM nodes a CROSS JOIN nodes b LEFT JOIN adjacent e ON e.src = a.node AND e.dst = b.node
  LEFT JOIN degree p ON p.node = a.node LEFT JOIN degree q ON q.node = b.node),
squared AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM lap a JOIN lap b ON b.i = a.j GROUP BY 1, 2),
poly AS (SELECT l.i, l.j, l.v AS t1, 2 * s.v - (CASE WHEN l.i = l.j THEN 1e0 ELSE 0e0 END) AS t2
  FROM lap l JOIN squared s ON s.i = l.i AND s.j = l.j)"""

VOLUME = """
vol AS (
  SELECT 'cam_' || l_suppkey AS camera_id, l_shipdate AS ts, 'veh_' || l_partkey AS vehicle_id,
    CASE l_returnflag WHEN 'A' THEN 'car' WHEN 'N' THEN 'bus' ELSE 'truck' END AS vehicle_class,
    l_quantity AS speed_kmh, l_linenumber AS lane_id FROM lineitem
)"""
VOLUME_GRAPH = """
vlanes AS (SELECT DISTINCT l_suppkey AS pos, l_linenumber AS lane FROM lineitem),
vnodes AS (SELECT row_number() OVER (ORDER BY pos, lane) - 1 AS node, pos, lane FROM vlanes),
vlinks AS (
  SELECT a.node AS src, b.node AS dst FROM vnodes a JOIN vnodes b ON a.pos = b.pos
    AND b.lane = (SELECT min(lane) FROM vlanes c WHERE c.pos = a.pos AND c.lane > a.lane)
  UNION ALL
  SELECT a.node, b.node FROM supplier s JOIN vnodes a ON a.pos = s.s_suppkey AND a.lane = s.s_suppkey % 7 + 1
    JOIN vnodes b ON b.pos = s.s_suppkey + 1 AND b.lane = 1
),
vedges AS (SELECT node AS src, node AS dst FROM vnodes UNION SELECT src, dst FROM vlinks UNION SELECT dst, src FROM vlinks)"""
SENSORS = """
smap AS (
  SELECT s_suppkey * 10 + lane_id AS sensor_id, 'cam_' || s_suppkey AS camera_id, lane_id
  FROM supplier, (SELECT unnest([1, 2, 3, 4]) AS lane_id)
)"""

HOURLY = metrics(name="h", interval="1 hour")
SERIES = """
series AS (
  SELECT camera_id, lane_id, date_trunc('day', window_start) AS origin,
    CAST(row_number() OVER (PARTITION BY camera_id, lane_id, date_trunc('day', window_start) ORDER BY window_start) - 1
      AS INTEGER) AS step,
    CAST(vehicle_count AS DOUBLE) AS vehicle_count, congestion_score AS p, congestion_level
  FROM h WHERE lane_id IS NOT NULL
),
rise AS (SELECT a.camera_id, a.lane_id, a.origin, min(a.step) AS start_step FROM series a JOIN series b
    ON a.camera_id = b.camera_id AND a.lane_id = b.lane_id AND a.origin = b.origin AND b.step = a.step + 1
  WHERE a.p >= 0.45e0 AND b.p >= 0.45e0 GROUP BY 1, 2, 3),
fall AS (SELECT a.camera_id, a.lane_id, a.origin, min(a.step) AS end_step FROM series a JOIN series b
    ON a.camera_id = b.camera_id AND a.lane_id = b.lane_id AND a.origin = b.origin AND b.step = a.step + 1
    JOIN rise r ON r.camera_id = a.camera_id AND r.lane_id = a.lane_id AND r.origin = a.origin AND a.step >= r.start_step
  WHERE a.p <= 0.40e0 AND b.p <= 0.40e0 GROUP BY 1, 2, 3),
epi AS (
  SELECT s.camera_id, s.lane_id, s.origin, start_step, end_step,
    s.origin + to_hours(start_step + 1) AS congestion_start, s.origin + to_hours(end_step + 1) AS congestion_end,
    coalesce(max(p) FILTER (start_step IS NULL OR (step >= start_step AND (end_step IS NULL OR step < end_step))),
      max(p) FILTER (step = start_step)) AS peak_probability
  FROM series s LEFT JOIN rise USING (camera_id, lane_id, origin) LEFT JOIN fall USING (camera_id, lane_id, origin)
  GROUP BY 1, 2, 3, 4, 5
)"""


def with_series(sql: str) -> str:
    return ",".join(["WITH " + DETECTIONS, HOURLY, SERIES]) + "\n" + sql


CHANGES = """
ch AS (
  SELECT CASE WHEN o_orderkey % 101 <> 0 THEN o_orderkey END AS seq, 'admin_' || (o_custkey % 5) AS actor,
    CASE o_orderkey % 7 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'update' END AS action,
    CASE WHEN o_orderkey % 97 <> 0 THEN 'cam_' || (o_custkey % 40) END AS camera_id,
    CASE WHEN o_orderkey % 4 = 0 THEN 'name_' || o_orderkey END AS name,
    CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 5000) - 5 END AS latitude,
    CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 2500) - 20 END AS longitude,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS road_segment,
    CAST(NULL AS VARCHAR) AS description, o_orderdate AS changed_at, o_orderkey % 12 = 1 AS clears
  FROM orders
),
ch_fault AS (
  SELECT *, latitude IS NOT NULL AS located,
    CASE WHEN camera_id IS NULL THEN 'bad_camera_id' WHEN seq IS NULL THEN 'bad_seq'
      WHEN action <> 'delete' AND NOT (latitude BETWEEN -90 AND 90) THEN 'bad_latitude'
      WHEN action <> 'delete' AND NOT (longitude BETWEEN -180 AND 180) THEN 'bad_longitude'
      WHEN action = 'create' AND (latitude IS NULL OR name IS NULL) THEN 'incomplete' END AS fault
  FROM ch
),
ch_says AS (SELECT *, CASE WHEN fault IS NOT NULL THEN NULL WHEN action = 'delete' THEN false
    WHEN action = 'create' OR located THEN true END AS says FROM ch_fault),
ch_known AS (
  SELECT s.*, coalesce(last_value(says IGNORE NULLS) OVER (PARTITION BY s.camera_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c.camera_id IS NOT NULL) AS known
  FROM ch_says s LEFT JOIN cameras c ON c.camera_id = s.camera_id
),
judged AS (
  SELECT *, CASE WHEN fault IS NOT NULL THEN 'rejected: ' || fault
    WHEN action = 'create' AND known THEN 'rejected: already_exists'
    WHEN action = 'delete' AND NOT known THEN 'rejected: not_found'
    WHEN action = 'update' AND NOT known AND NOT located THEN 'rejected: not_found' ELSE 'applied' END AS status
  FROM ch_known
),
resets AS (SELECT camera_id, max(seq) AS reset FROM judged WHERE status = 'applied' AND (action = 'delete' OR NOT known)
  GROUP BY 1),
live AS (SELECT j.* FROM judged j LEFT JOIN resets r ON r.camera_id = j.camera_id
  WHERE status = 'applied' AND (reset IS NULL OR seq >= reset)),
fields AS (
  SELECT camera_id, arg_max(action, seq) AS last_action,
    arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(latitude, seq) FILTER (latitude IS NOT NULL) AS latitude,
    arg_max(longitude, seq) FILTER (longitude IS NOT NULL) AS longitude,
    arg_max({'v': road_segment}, seq) FILTER (road_segment IS NOT NULL OR clears) AS segment
  FROM live GROUP BY 1
)"""

METRIC_NAMES = (
    "camera_id, window_start, window_end, lane_id, vehicle_count, counts_by_class, avg_speed_kmh, stopped_ratio, "
    "queue_length, congestion_level, congestion_score"
)
#: The metrics after the upsert of later figures.
UPSERTED = """
up AS (
  SELECT * REPLACE (CASE WHEN queue_length > 0 THEN vehicle_count + 100 ELSE vehicle_count END AS vehicle_count) FROM m
  UNION ALL
  SELECT * REPLACE (vehicle_count + 100 AS vehicle_count, window_start + INTERVAL 400 DAY AS window_start,
    window_end + INTERVAL 400 DAY AS window_end) FROM m WHERE queue_length > 0)"""


def half_open(start: str, end: str) -> str:
    return f"window_start >= TIMESTAMP '2024-{start}' AND window_start < TIMESTAMP '2024-{end}'"


CLOSED = "mc AS (SELECT * FROM m WHERE window_end <= (SELECT max(ts) FROM ev) - INTERVAL 1 SECOND)"

FEATURE_NAMES = (
    "vehicle_count", "avg_speed_kmh", "stopped_ratio", "congestion_score", "hour_sin", "hour_cos", "dow_sin", "dow_cos"
)
WHOLE = "CAST(CAST(round(CAST(d.{c} * 10000 AS DECIMAL(18,6)), 0) AS BIGINT) AS VARCHAR)"
EXPORT_TIME = "coalesce(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z', '') AS {c}"

ENVELOPE_TS = f"{AS_OF} AS ts"

ORACLES: dict[str, str] = {
    "validate_events": with_events(
        "SELECT camera_id, date_trunc('millisecond', ts) AS timestamp, frame_id, vehicle_id, vehicle_class AS class, "
        "confidence, lane_id, speed_kmh AS speed_estimate, bx AS x, by_ AS y, bw AS w, bh AS h, centroid_x AS cx, "
        "centroid_y AS cy FROM ev WHERE k NOT IN (96, 97, 98)"
    ),
    "reject_reasons": with_events(
        "SELECT CASE WHEN k = 98 THEN 'malformed_json' WHEN k = 96 THEN 'not_an_object' WHEN k = 97 THEN 'bad_frame_id' "
        "WHEN k = 99 THEN 'confidence_out_of_range' ELSE 'unknown_class' END AS reject_reason, count(*) AS records "
        "FROM det WHERE k >= 96 OR vehicle_class = 'unknown' GROUP BY 1"
    ),
    "flatten_events": with_events(
        "SELECT camera_id, ts, vehicle_id, vehicle_class, centroid_x, centroid_y, speed_kmh, frame_id, confidence, "
        "CAST(trunc(bx) AS INTEGER) AS bbox_x, CAST(trunc(by_) AS INTEGER) AS bbox_y, CAST(trunc(bw) AS INTEGER) AS "
        "bbox_w, CAST(trunc(bh) AS INTEGER) AS bbox_h, lane_id FROM ev"
    ),
    "speed_fallback": with_events(
        f"SELECT frame_id, camera_id, vehicle_id, ts, {r('speed_kmh', 6)} AS speed_kmh FROM filled", SPEED
    ),
    "window_metrics_camera": with_base("SELECT * FROM m WHERE lane_id IS NULL"),
    "window_metrics_lane": with_base("SELECT * FROM m WHERE lane_id IS NOT NULL"),
    "volume_window_metrics": "WITH " + VOLUME + "," + metrics("vol", "v", "1 day") + "\nSELECT * FROM v",
    "window_metrics_filled": with_events("SELECT * FROM f", SPEED, metrics("filled", "f")),
    "latest_per_camera": with_base("SELECT * FROM latest", LATEST),
    "latest_per_lane": with_base(
        "SELECT m.* FROM m JOIN (SELECT camera_id, lane_id, max(window_start) AS ws FROM m WHERE lane_id IS NOT NULL "
        "GROUP BY 1, 2) t ON m.camera_id = t.camera_id AND m.lane_id = t.lane_id AND m.window_start = t.ws"
    ),
    "current_metrics": with_base(
        f"SELECT {METRIC_NAMES} FROM latest WHERE camera_id = 'cam_0' UNION ALL SELECT 'cam_none', NULL, NULL, NULL, 0, "
        "'{}', 0, 0, 0, 'LOW', 0",
        LATEST,
    ),
    "list_cameras": with_base("SELECT camera_id, max(window_end) AS last_seen FROM m GROUP BY 1"),
    "metrics_history": with_base(f"SELECT * FROM m WHERE lane_id IS NULL AND camera_id = 'cam_0' AND {range_a()}"),
    "lane_scan": with_base(
        "SELECT camera_id, lane_id, window_start, vehicle_count, avg_speed_kmh, stopped_ratio, congestion_score, "
        f"congestion_level FROM m WHERE lane_id IS NOT NULL AND {range_a(close='<')}"
    ),
    "recent_events": with_events(
        "SELECT camera_id, ts AS timestamp, vehicle_id, vehicle_class AS class, lane_id, speed_kmh, confidence FROM ev "
        "ORDER BY ts DESC, frame_id DESC LIMIT 25"
    ),
    "metrics_with_segment": with_base(
        "SELECT m.camera_id, lane_id, window_start, congestion_score, coalesce(road_segment, m.camera_id) AS segment_key "
        "FROM m LEFT JOIN cameras c ON c.camera_id = m.camera_id",
        CAMERAS,
    ),
    "range_summary": with_base(summary(range_a())),
    "last_day_summary": with_base(summary(LAST_DAY)),
    "peak_hour": with_base(f"SELECT peak_hour FROM ({summary(range_b())})"),
    "incident_summary": with_base(
        f"SELECT {r('avg(congestion_score)', 6)} AS average_congestion, "
        "count(*) FILTER (congestion_level IN ('HIGH', 'SEVERE')) AS total_incidents, "
        "count(*) FILTER (congestion_level = 'HIGH') AS high, count(*) FILTER (congestion_level = 'SEVERE') AS critical "
        f"FROM m WHERE lane_id IS NULL AND {range_a()}"
    ),
    "hourly_trends": with_base(
        f"SELECT CAST(hour(window_start) AS INTEGER) AS hour, {r('avg(congestion_score)', 6)} AS average_congestion, "
        f"{r('avg(avg_speed_kmh)', 6)} AS average_speed_kmh, CAST(sum(vehicle_count) AS BIGINT) AS vehicle_count "
        f"FROM m WHERE lane_id IS NULL AND {range_a()} GROUP BY 1"
    ),
    "top_segments": with_base(
        f"SELECT coalesce(road_segment, m.camera_id) AS segment_key, {r('avg(congestion_score)', 6)} AS "
        "average_congestion, CAST(5 * count(*) FILTER (congestion_level = 'SEVERE') AS BIGINT) AS severe_minutes, "
        f"{r('avg(queue_length)', 6)} AS average_queue_length, "
        "count(*) FILTER (congestion_level IN ('HIGH', 'SEVERE')) AS incident_count "
        f"FROM m LEFT JOIN cameras c ON c.camera_id = m.camera_id WHERE lane_id IS NULL AND {range_b()} GROUP BY 1 "
        "ORDER BY round(avg(congestion_score), 9) DESC, severe_minutes DESC, 1 LIMIT 10",
        CAMERAS,
    ),
    "compare_ranges": with_base(
        "SELECT "
        + ", ".join(f"{s}.{f} AS {s}_{f}" for s in ("a", "b") for f in (
            "average_congestion", "vehicle_count", "average_speed_kmh", "incident_count", "peak_hour"))
        + f", {r('d.c', 6)} AS congestion_delta, b.vehicle_count - a.vehicle_count AS vehicle_count_delta, "
        f"{r('d.s', 6)} AS speed_delta, b.incident_count - a.incident_count AS incident_delta "
        f"FROM ({summary(range_a())}) a, ({summary(range_b())}) b, "
        f"(SELECT avg(congestion_score) FILTER ({range_b()}) - avg(congestion_score) FILTER ({range_a()}) AS c, "
        f"avg(avg_speed_kmh) FILTER ({range_b()}) - avg(avg_speed_kmh) FILTER ({range_a()}) AS s "
        "FROM m WHERE lane_id IS NULL) d"
    ),
    "dashboard_summary": with_base(
        "SELECT (SELECT count(*) FROM alerts WHERE resolved_at IS NULL) AS active_alerts, "
        f"(SELECT count(*) FROM alerts WHERE triggered_at >= {AS_OF} - INTERVAL 24 HOUR) AS total_incidents_24h, "
        f"r.speed AS average_speed_kmh_5m, r.score AS average_congestion_score_5m, "
        "(SELECT count(*) FROM latest) AS total_cameras_active, "
        "(SELECT CAST(sum(vehicle_count) AS BIGINT) FROM latest) AS total_vehicles_last_window, "
        "r.speed AS average_speed_kmh, "
        "(SELECT '{\"LOW\":' || count(*) FILTER (congestion_level = 'LOW') || ',\"MODERATE\":' || "
        "count(*) FILTER (congestion_level = 'MODERATE') || ',\"HIGH\":' || count(*) FILTER (congestion_level = 'HIGH') "
        "|| ',\"SEVERE\":' || count(*) FILTER (congestion_level = 'SEVERE') || '}' FROM latest) AS congestion_breakdown, "
        "w.camera_id AS worst, w.congestion_level AS worst_level "
        f"FROM (SELECT {r('avg(avg_speed_kmh)', 2)} AS speed, {r('avg(congestion_score)', 4)} AS score FROM m "
        f"WHERE lane_id IS NULL AND window_start >= {AS_OF} - INTERVAL 1440 MINUTE) r, "
        "(SELECT * FROM latest ORDER BY CASE congestion_level WHEN 'SEVERE' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' "
        "THEN 1 ELSE 0 END DESC, congestion_score DESC, camera_id DESC LIMIT 1) w",
        LATEST,
        *ALERT_CTES,
    ),
    "level_breakdown": with_base(
        "SELECT "
        + ", ".join(f"count(*) FILTER (congestion_level = '{n}') AS {n.lower()}" for n in ("LOW", "MODERATE", "HIGH", "SEVERE"))
        + " FROM latest",
        LATEST,
    ),
    "worst_camera": with_base(
        "SELECT camera_id, congestion_level, congestion_score FROM latest ORDER BY CASE congestion_level WHEN 'SEVERE' "
        "THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END DESC, congestion_score DESC, camera_id DESC LIMIT 1",
        LATEST,
    ),
    "heatmap": with_base(
        "SELECT h.camera_id, latitude, longitude, road_segment, "
        f"{r('avg_count / max(avg_count) OVER ()', 4)} AS weight, {r('score', 4)} AS intensity, "
        f"{r('avg_count', 2)} AS avg_vehicle_count, last_window FROM heat h JOIN cameras c ON c.camera_id = h.camera_id "
        "WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
        CAMERAS,
        HEAT,
    ),
    "heat_snapshot": with_base(
        f"SELECT camera_id, {r('score', 4)} AS intensity, {r('avg_count', 2)} AS avg_vehicle_count FROM heat", HEAT
    ),
    **{
        name: with_base(
            "SELECT l.camera_id, latitude, longitude, road_segment, congestion_level AS severity, "
            "congestion_score AS score, vehicle_count, queue_length, avg_speed_kmh, counts_by_class, window_end "
            "FROM latest l JOIN cameras c ON c.camera_id = l.camera_id "
            f"WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND congestion_level IN ({levels})",
            LATEST,
            CAMERAS,
        )
        for name, levels in (("incidents", "'HIGH', 'SEVERE'"), ("incidents_moderate", "'MODERATE'"))
    },
    "alerts_from_metrics": with_base("SELECT * FROM alerts", *ALERT_CTES),
    "alert_history": with_base(
        "SELECT *, acknowledged_at IS NOT NULL AS acknowledged FROM acked WHERE severity = 'WARNING' AND "
        "alert_type = 'CONGESTION' AND triggered_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'",
        *ACK_CTES,
    ),
    "unacknowledged_alerts": with_base(
        "SELECT *, false AS acknowledged FROM acked WHERE acknowledged_at IS NULL", *ACK_CTES
    ),
    "unresolved_alerts": with_base("SELECT * FROM alerts WHERE resolved_at IS NULL", *ALERT_CTES),
    "acknowledge_alerts": with_base("SELECT * FROM acked", *ACK_CTES),
    "ack_results": with_base(
        "SELECT k.ack_id, k.alert_id, a.acknowledged_by AS admin_id, a.acknowledged_at, "
        "CASE WHEN a.alert_id IS NULL THEN 'not_found' WHEN a.acknowledged_by = k.admin_id THEN 'acknowledged' "
        "ELSE 'already_acknowledged' END AS status FROM acks k LEFT JOIN acked a ON a.alert_id = k.alert_id",
        *ACK_CTES,
    ),
    "new_alerts": with_base(
        "SELECT camera_id, congestion_level AS severity, congestion_score AS score, vehicle_count, window_start, "
        "window_end FROM m WHERE lane_id IS NULL AND congestion_level IN ('HIGH', 'SEVERE')"
    ),
    "alert_export": with_base(
        "SELECT alert_id, camera_id, road_segment, alert_type, severity, title, message, "
        + ", ".join(EXPORT_TIME.format(c=c) for c in ("triggered_at", "resolved_at", "acknowledged_at"))
        + ", congestion_level, congestion_score, acknowledged_at IS NOT NULL AS acknowledged, acknowledged_by FROM acked",
        *ACK_CTES,
    ),
    "reclassify_thresholds": with_base(
        f"SELECT camera_id, lane_id, window_start, "
        f"{level(score('vehicle_count', 'avg_speed_kmh', 'stopped_ratio', '25e0'), '0.25e0', '0.4e0', '0.6e0')} "
        "AS congestion_level, congestion_score FROM m"
    ),
    "retention_kept": with_base(
        f"SELECT 'event' AS kind, camera_id, ts AS at, lane_id FROM ev WHERE ts >= {AS_OF} - INTERVAL 240 HOUR UNION ALL "
        f"SELECT 'metric', camera_id, window_start, lane_id FROM m WHERE window_start >= {AS_OF} - INTERVAL 20 DAY"
    ),
    "retention_counts": with_base(
        f"SELECT (SELECT count(*) FROM ev WHERE ts < {AS_OF} - INTERVAL 240 HOUR) AS events_deleted, "
        f"(SELECT count(*) FROM m WHERE window_start < {AS_OF} - INTERVAL 20 DAY) AS metrics_deleted"
    ),
    "archive_candidates": with_base(
        f"SELECT *, CAST(window_start AS DATE) AS date FROM m WHERE window_start < {AS_OF} - INTERVAL 20 DAY"
    ),
    "upsert_metrics": with_base(
        "SELECT * REPLACE (CASE WHEN queue_length > 0 THEN vehicle_count + 100 ELSE vehicle_count END AS vehicle_count) "
        "FROM m UNION ALL SELECT * REPLACE (vehicle_count + 100 AS vehicle_count, window_start + INTERVAL 400 DAY AS "
        "window_start, window_end + INTERVAL 400 DAY AS window_end) FROM m WHERE queue_length > 0"
    ),
    "stream_upsert": with_base(
        "SELECT * REPLACE (CASE WHEN queue_length > 0 THEN vehicle_count + 100 ELSE vehicle_count END AS vehicle_count) "
        "FROM m UNION ALL SELECT * REPLACE (vehicle_count + 100 AS vehicle_count, window_start + INTERVAL 400 DAY AS "
        "window_start, window_end + INTERVAL 400 DAY AS window_end) FROM m WHERE queue_length > 0"
    ),
    "camera_changes": "WITH " + CAMERAS + "," + CHANGES + """
SELECT coalesce(c.camera_id, f.camera_id) AS camera_id,
  coalesce(f.name, CASE WHEN reset IS NULL THEN c.name END, coalesce(c.camera_id, f.camera_id)) AS name,
  coalesce(f.latitude, CASE WHEN reset IS NULL THEN c.latitude END) AS latitude,
  coalesce(f.longitude, CASE WHEN reset IS NULL THEN c.longitude END) AS longitude,
  CASE WHEN f.segment IS NOT NULL THEN f.segment.v WHEN reset IS NULL THEN c.road_segment END AS road_segment,
  CAST(NULL AS VARCHAR) AS description
FROM cameras c FULL JOIN fields f ON f.camera_id = c.camera_id
LEFT JOIN resets r ON r.camera_id = coalesce(c.camera_id, f.camera_id)
WHERE coalesce(last_action, '') <> 'delete'""",
    "camera_change_status": "WITH " + CAMERAS + "," + CHANGES + "\nSELECT seq, camera_id, action, status FROM judged",
    "audit_rows": "WITH " + CAMERAS + "," + CHANGES + """
SELECT actor, 'cameras.' || action AS action, 'cameras' AS entity_type, camera_id AS entity_id,
  CASE WHEN action <> 'delete' THEN '{' || concat_ws(',',
    CASE WHEN name IS NOT NULL THEN '"name":"' || name || '"' END,
    CASE WHEN latitude IS NOT NULL THEN '"latitude":' || CAST(latitude AS DECIMAL(9,1)) END,
    CASE WHEN longitude IS NOT NULL THEN '"longitude":' || CAST(longitude AS DECIMAL(9,1)) END,
    CASE WHEN road_segment IS NOT NULL THEN '"road_segment":"' || road_segment || '"' END,
    CASE WHEN clears THEN '"cleared":["road_segment"]' END) || '}' END AS payload,
  changed_at AS created_at
FROM judged WHERE status = 'applied'""",
    "valid_cameras": (
        f"SELECT 'cam_' || c_custkey AS camera_id, c_name AS name, {r('c_acctbal / 50', 6)} AS latitude, "
        f"{r('c_acctbal / 40', 6)} AS longitude FROM customer "
        "WHERE c_custkey % 10 <> 3 AND c_acctbal / 50 BETWEEN -90 AND 90 AND c_acctbal / 40 BETWEEN -180 AND 180"
    ),
    "gap_fill": with_base("SELECT * FROM gaps", GAPS),
    "features": with_base(
        f"SELECT camera_id, lane_id, window_start, {ROUNDED_FEATURES}, congestion_level_idx FROM feat", GAPS, FEATURES
    ),
    "dense_signal": with_base(
        f"SELECT t_idx, window_start, node, {ROUNDED_FEATURES}, congestion_level_idx, congestion_prob FROM dense",
        *DENSE_CTES,
    ),
    "recent_input": with_base(
        f"SELECT window_start, node, {ROUNDED_FEATURES}, congestion_level_idx, congestion_prob FROM dense "
        "WHERE t_idx > (SELECT max(t_idx) FROM dense) - 12",
        *DENSE_CTES,
    ),
    "sliding_samples": with_base(
        "SELECT s.node, s.t_idx AS start, "
        + ", ".join(
            f"string_agg({expr}, ',' ORDER BY d.t_idx) FILTER ({where}) AS {name}"
            for name, expr, where in (
                *((f"x_{c}", WHOLE.format(c=c), "d.t_idx < s.t_idx + 12") for c in FEATURE_NAMES),
                ("y_counts", WHOLE.format(c="vehicle_count"), "d.t_idx >= s.t_idx + 12"),
                ("y_probs", "CAST(CAST(d.congestion_prob * 10000 AS BIGINT) AS VARCHAR)", "d.t_idx >= s.t_idx + 12"),
                ("y_levels", "CAST(d.congestion_level_idx AS VARCHAR)", "d.t_idx >= s.t_idx + 12"),
            )
        )
        + " FROM dense s JOIN dense d ON d.node = s.node AND d.t_idx BETWEEN s.t_idx AND s.t_idx + 17 "
        "WHERE s.t_idx <= (SELECT max(t_idx) FROM dense) - 17 GROUP BY 1, 2",
        *DENSE_CTES,
    ),
    "ewma_forecast": with_base(
        f"""SELECT c.camera_id, CAST(step AS INTEGER) AS step,
  CASE WHEN level IS NULL THEN 0e0 ELSE {r(clamp('level + slope * step'), 4)} END AS congestion_score,
  CASE WHEN level IS NULL THEN 'LOW' ELSE {level('round(' + clamp('level + slope * step') + ', 9)')} END AS congestion_level
FROM cameras c LEFT JOIN state s ON s.camera_id = c.camera_id, (SELECT unnest(range(1, 7)) AS step)""",
        CAMERAS,
        """aged AS (SELECT camera_id, congestion_score AS v,
  row_number() OVER (PARTITION BY camera_id ORDER BY window_start DESC) - 1 AS age,
  count(*) OVER (PARTITION BY camera_id) AS n FROM m WHERE lane_id IS NULL),
state AS (SELECT camera_id,
  sum(v * CASE WHEN age = n - 1 THEN power(0.6e0, age) ELSE 0.4e0 * power(0.6e0, age) END) AS level,
  coalesce(regr_slope(v, -age) FILTER (age < 6), 0e0) AS slope FROM aged GROUP BY 1)""",
    ),
    "trend": with_base(
        f"SELECT camera_id, {r('level', 6)} AS level, {r('slope', 6)} AS slope FROM state",
        """aged AS (SELECT camera_id, congestion_score AS v,
  row_number() OVER (PARTITION BY camera_id ORDER BY window_start DESC) - 1 AS age,
  count(*) OVER (PARTITION BY camera_id) AS n FROM m WHERE lane_id IS NULL),
state AS (SELECT camera_id,
  sum(v * CASE WHEN age = n - 1 THEN power(0.6e0, age) ELSE 0.4e0 * power(0.6e0, age) END) AS level,
  coalesce(regr_slope(v, -age) FILTER (age < 6), 0e0) AS slope FROM aged GROUP BY 1)""",
    ),
    "congestion_episodes": with_series(
        "SELECT camera_id, lane_id, origin, congestion_start, congestion_end, start_step, end_step, peak_probability FROM epi"
    ),
    "first_sustained": with_series(
        "SELECT s.camera_id, s.lane_id, s.origin, min(CASE WHEN s.p <= 0.4e0 AND n.p <= 0.4e0 THEN s.step END) AS step "
        "FROM series s LEFT JOIN series n ON n.camera_id = s.camera_id AND n.lane_id = s.lane_id AND n.origin = s.origin "
        "AND n.step = s.step + 1 GROUP BY 1, 2, 3"
    ),
    "lane_summary": with_series(
        "SELECT e.camera_id, e.lane_id, e.origin, congestion_start, congestion_end, "
        "peak_probability AS peak_congestion_probability, "
        "arg_min(congestion_level, step) AS current_congestion_level, "
        f"{r('avg(vehicle_count) FILTER (step < 60)', 2)} AS next_5min_avg_count "
        "FROM epi e JOIN series s USING (camera_id, lane_id, origin) GROUP BY 1, 2, 3, 4, 5, 6"
    ),
    "congestion_outlook": with_series(
        "SELECT e.camera_id, e.lane_id, e.origin, congestion_start, congestion_end, peak_probability, "
        "string_agg(congestion_level, ',' ORDER BY step) FILTER (step % 3 = 0) AS predicted_levels "
        "FROM epi e JOIN series s USING (camera_id, lane_id, origin) GROUP BY 1, 2, 3, 4, 5, 6"
    ),
    "lane_detail": with_series(
        "SELECT e.camera_id, e.lane_id, e.origin, peak_probability, "
        "string_agg(CAST(CAST(vehicle_count * 10000 AS BIGINT) AS VARCHAR), ',' ORDER BY step) AS counts, "
        "string_agg(CAST(CAST(round(p * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY step) AS probabilities, "
        "string_agg(congestion_level, ',' ORDER BY step) AS levels, CAST(count(*) AS INTEGER) AS steps "
        "FROM epi e JOIN series s USING (camera_id, lane_id, origin) GROUP BY 1, 2, 3, 4"
    ),
    "lane_report": with_series(
        "SELECT e.camera_id, e.lane_id, e.origin, congestion_start, congestion_end, "
        "peak_probability AS peak_congestion_probability, arg_min(congestion_level, step) AS current_congestion_level, "
        f"{r('avg(vehicle_count) FILTER (step < 60)', 2)} AS next_5min_avg_count, "
        "array_to_string(list(CAST(CAST(vehicle_count * 10000 AS BIGINT) AS VARCHAR) ORDER BY step)[1:5], ',') AS counts, "
        "array_to_string(list(CAST(CAST(round(p * 10000) AS BIGINT) AS VARCHAR) ORDER BY step)[1:5], ',') AS probabilities, "
        "array_to_string(list(congestion_level ORDER BY step)[1:5], ',') AS levels, CAST(least(count(*), 5) AS INTEGER) AS steps "
        "FROM epi e JOIN series s USING (camera_id, lane_id, origin) WHERE e.camera_id = 'cam_0' AND e.lane_id = 1 "
        "GROUP BY 1, 2, 3, 4, 5, 6"
    ),
    "camera_forecast": with_series(
        "SELECT camera_id, origin, step + 1 AS step, origin + to_hours(step + 1) AS predicted_at, "
        f"{r('avg(p)', 4)} AS congestion_score, {level('round(avg(p), 9)')} AS congestion_level "
        "FROM series s WHERE step < 12 AND step <= (SELECT min(last) FROM (SELECT max(step) AS last FROM series t "
        "WHERE t.camera_id = s.camera_id AND t.origin = s.origin GROUP BY lane_id)) GROUP BY 1, 2, step"
    ),
    "history_samples": with_base(
        f"SELECT camera_id, count(*) AS history_samples FROM m WHERE lane_id IS NOT NULL AND window_start >= {AS_OF} - "
        "INTERVAL 7200 MINUTE GROUP BY 1"
    ),
    "forecast_messages": with_series(
        "SELECT e.camera_id || '/' || e.lane_id AS key, (SELECT count(*) FROM epi) AS num_lanes, "
        f"strftime({AS_OF}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS generated_at, CAST(count(*) AS INTEGER) AS steps, "
        "strftime(congestion_start, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS congestion_start, "
        f"{r('peak_probability', 4)} AS peak, "
        "strftime(congestion_end, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS congestion_end, "
        + ", ".join(
            f"'[' || string_agg({text}, ',' ORDER BY step) FILTER (step % 12 = 0) || ']' AS {name}"
            for name, text in (
                ("levels", "'\"' || congestion_level || '\"'"),
                ("times", "'\"' || strftime(e.origin + to_hours(step + 1), '%Y-%m-%dT%H:%M:%S.%f') || 'Z\"'"),
                ("counts", "CAST(CAST(vehicle_count AS DECIMAL(18,1)) AS VARCHAR)"),
            )
        )
        + " FROM epi e JOIN series s USING (camera_id, lane_id, origin) GROUP BY e.camera_id, e.lane_id, e.origin, "
        "congestion_start, congestion_end, peak_probability"
    ),
    "forecast_metrics": (
        "WITH p AS (SELECT l_quantity * (1 - l_discount) AS pc, l_quantity AS c, l_discount * 9 AS pp, l_tax * 11 AS p, "
        "floor(l_discount * 30) AS pl, floor(l_tax * 35) AS l FROM lineitem) "
        f"SELECT {r('avg(abs(pc - c))', 6)} AS count_mae, {r('sqrt(avg((pc - c) * (pc - c)))', 6)} AS count_rmse, "
        f"{r('avg(abs((pc - c) / (abs(c) + 1e-6))) * 100', 6)} AS count_mape, "
        f"{r('avg(CASE WHEN (pp >= 0.5e0) = (p >= 0.5e0) THEN 1e0 ELSE 0e0 END)', 6)} AS prob_acc, "
        f"{r('avg(CASE WHEN pl = l THEN 1e0 ELSE 0e0 END)', 6)} AS level_acc FROM p"
    ),
    "lane_nodes": "WITH " + VOLUME_GRAPH + "\nSELECT node, 'cam_' || pos AS camera_id, lane AS lane_id FROM vnodes",
    "lane_edges": "WITH " + VOLUME_GRAPH + "\nSELECT src, dst FROM vedges",
    "khop_neighbours": "WITH " + VOLUME_GRAPH + """
SELECT src, dst, CAST(min(hops) AS INTEGER) AS hops FROM (
  SELECT src, dst, CASE WHEN src = dst THEN 0 ELSE 1 END AS hops FROM vedges
  UNION ALL SELECT a.src, b.dst, 2 FROM vedges a JOIN vedges b ON a.dst = b.src WHERE a.src <> a.dst AND b.src <> b.dst
) GROUP BY 1, 2""",
    "neighbour_means": with_base(
        f"SELECT d.t_idx, d.node, {r('a.vehicle_count', 6)} AS vehicle_count_hop1, {r('a.congestion_score', 6)} AS "
        f"congestion_score_hop1, {r('b.vehicle_count', 6)} AS vehicle_count_hop2, {r('b.congestion_score', 6)} AS "
        "congestion_score_hop2 FROM dense d JOIN hop1 a USING (t_idx, node) JOIN hop2 b USING (t_idx, node)",
        *DENSE_CTES,
        EVENT_EDGES,
    ),
    "chebyshev_features": with_base(
        "SELECT x.t_idx, p.i AS node, "
        + ", ".join(
            f"{r(f'sum(p.t{k} * x.{c})', 6)} AS {c}_cheb{k}" for k in (1, 2) for c in ("vehicle_count", "congestion_score")
        )
        + " FROM poly p JOIN dense x ON x.node = p.j GROUP BY 1, 2",
        *DENSE_CTES,
        EVENT_EDGES,
        CHEBYSHEV,
    ),
    "sensor_import": "WITH " + SENSORS + f""",
raw AS (
  SELECT camera_id, l_shipdate AS window_start, l_shipdate + INTERVAL 300 SECOND AS window_end, lane_id,
    CAST(round_even(greatest(l_extendedprice / 100, 0), 0) AS BIGINT) AS vehicle_count,
    {r('greatest(l_quantity * 2, 0)', 2)} AS avg_speed_kmh, {r(clamp('l_discount * 8'), 4)} AS stopped_ratio
  FROM lineitem JOIN smap ON sensor_id = l_suppkey * 10 + l_linenumber
),
scored AS (SELECT *, {r(score('vehicle_count', 'avg_speed_kmh', 'stopped_ratio', '700e0', '110e0'), 4)} AS congestion_score
  FROM raw)
SELECT camera_id, window_start, window_end, lane_id, vehicle_count, '{{"car":' || vehicle_count || '}}' AS counts_by_class,
  avg_speed_kmh, stopped_ratio, CAST(trunc(stopped_ratio * 30) AS BIGINT) AS queue_length,
  {level('congestion_score')} AS congestion_level, congestion_score FROM scored""",
    "sensor_links": "WITH " + SENSORS + """,
s AS (SELECT DISTINCT l_suppkey * 10 + l_linenumber AS s FROM lineitem),
e AS (SELECT s AS f, s + 1 AS t FROM s UNION SELECT s, s + 10 FROM s)
SELECT a.camera_id AS from_camera, a.lane_id AS from_lane, b.camera_id AS to_camera, b.lane_id AS to_lane,
  CASE WHEN a.camera_id = b.camera_id THEN 'intra' ELSE 'cross' END AS kind
FROM e JOIN smap a ON a.sensor_id = f JOIN smap b ON b.sensor_id = t""",
    "training_table": with_base(
        f"""SELECT s.node, s.t_idx AS start, CAST(y.t_idx - s.t_idx - 1 AS INTEGER) AS step, {r('y.vehicle_count', 6)} AS count,
  y.congestion_prob AS prob, CAST(y.congestion_level_idx AS DOUBLE) AS level, 63 AS width, {r('x.total + n.total', 6)} AS total
FROM dense s JOIN dense y ON y.node = s.node AND y.t_idx BETWEEN s.t_idx + 1 AND s.t_idx + 6
JOIN (SELECT a.node, a.t_idx, sum(b.vehicle_count + b.avg_speed_kmh + b.stopped_ratio + b.congestion_score) AS total
      FROM dense a JOIN dense b ON b.node = a.node AND b.t_idx BETWEEN a.t_idx - 11 AND a.t_idx GROUP BY 1, 2) x
  ON x.node = s.node AND x.t_idx = s.t_idx
JOIN (SELECT node, t_idx, vehicle_count + avg_speed_kmh + stopped_ratio + congestion_score AS total FROM hop1) n
  ON n.node = s.node AND n.t_idx = s.t_idx
WHERE s.t_idx >= 11 AND s.t_idx <= (SELECT max(t_idx) FROM dense) - 6""",
        *DENSE_CTES,
        EVENT_EDGES,
    ),
    "stream_window_metrics": with_base("SELECT * FROM mc", CLOSED),
    "stream_rollup": with_base(
        f"SELECT camera_id, date_trunc('day', window_start) AS hour_start, {r('avg(congestion_score)', 6)} AS "
        f"average_congestion, {r('avg(avg_speed_kmh)', 6)} AS average_speed_kmh, CAST(sum(vehicle_count) AS BIGINT) AS "
        "vehicle_count FROM mc WHERE lane_id IS NULL AND date_trunc('day', window_start) + INTERVAL 1 DAY <= "
        "(SELECT max(ts) FROM ev) - INTERVAL 1 SECOND GROUP BY 1, 2",
        CLOSED,
    ),
    "stream_speed": with_events(
        f"SELECT frame_id, camera_id, vehicle_id, ts, {r('speed_kmh', 6)} AS speed_kmh FROM filled", SPEED
    ),
    "stream_alerts": with_base(
        "SELECT * FROM alerts",
        CLOSED,
        "passed AS (SELECT * FROM mc WHERE window_start <= (SELECT max(window_start) FROM mc) - INTERVAL 1 SECOND)",
        CAMERAS,
        ALERTS.format(metrics="passed"),
    ),
    "stream_detections_to_alerts": with_base(
        "SELECT * FROM alerts",
        CLOSED,
        CAMERAS,
        ALERTS.format(metrics="mc"),
    ),
    "stream_snapshots": with_base(
        "SELECT 'traffic_metrics_update' AS event, camera_id, CAST(vehicle_count AS BIGINT) AS vehicle_count, congestion_level, "
        "CAST(NULL AS DOUBLE) AS avg_vehicle_count FROM latest UNION ALL "
        f"SELECT 'heatmap_update', camera_id, NULL, NULL, {r('avg_count', 2)} FROM heat",
        LATEST,
        HEAT,
    ),
    "retention_job": with_base(
        f"SELECT (SELECT count(*) FROM ev WHERE ts < {AS_OF} - INTERVAL 250 HOUR) AS events_deleted, "
        f"(SELECT count(*) FROM m WHERE window_start < {AS_OF} - INTERVAL 20 DAY) AS metrics_deleted, "
        f"(SELECT count(*) FROM ev WHERE ts >= {AS_OF} - INTERVAL 250 HOUR) AS events_left, "
        f"(SELECT count(*) FROM m WHERE window_start >= {AS_OF} - INTERVAL 20 DAY) AS metrics_left"
    ),
    "sketched_vehicles": with_events(
        "SELECT camera_id, date_trunc('day', ts)::TIMESTAMP AS day, count(DISTINCT vehicle_id) AS vehicles, TRUE AS within FROM ev GROUP BY 1, 2 "
        "UNION ALL SELECT NULL, date_trunc('day', ts)::TIMESTAMP, count(DISTINCT vehicle_id), TRUE FROM ev GROUP BY 2"
    ),
    "rollup_hours": with_base(
        "SELECT camera_id, date_trunc('hour', window_start)::TIMESTAMP AS hour_start, "
        "CAST(sum(CAST(congestion_score AS DECIMAL(28,4))) AS DOUBLE) AS score_sum, count(congestion_score) AS score_n, "
        "CAST(sum(CAST(avg_speed_kmh AS DECIMAL(28,2))) AS DOUBLE) AS speed_sum, count(avg_speed_kmh) AS speed_n, "
        "CAST(sum(vehicle_count) AS BIGINT) AS vehicles, count(*) FILTER (congestion_level = 'HIGH') AS high, "
        "count(*) FILTER (congestion_level = 'SEVERE') AS severe, CAST(sum(queue_length) AS BIGINT) AS queue_sum, "
        "count(queue_length) AS queue_n, count(*) AS windows FROM up WHERE lane_id IS NULL GROUP BY 1, 2",
        UPSERTED,
    ),
    "rollup_summaries": with_base(
        "SELECT "
        + ", ".join(
            f"{s}.{f} AS {s}_{f}" for s in ("a", "b")
            for f in ("average_congestion", "vehicle_count", "average_speed_kmh", "incident_count", "peak_hour")
        )
        + ", i.average_congestion AS incidents_average_congestion, i.total AS incidents_total_incidents, i.high AS incidents_high, "
        f"i.critical AS incidents_critical FROM ({summary(half_open('01-02', '01-10'), 'up')}) a, "
        f"({summary(half_open('01-08', '01-20'), 'up')}) b, "
        f"(SELECT {r('avg(congestion_score)', 6)} AS average_congestion, count(*) FILTER (congestion_level IN ('HIGH', 'SEVERE')) AS total, "
        "count(*) FILTER (congestion_level = 'HIGH') AS high, count(*) FILTER (congestion_level = 'SEVERE') AS critical "
        f"FROM up WHERE lane_id IS NULL AND {half_open('01-02', '01-10')}) i",
        UPSERTED,
    ),
    "rollup_top_segments": with_base(
        f"SELECT coalesce(road_segment, up.camera_id) AS segment_key, {r('avg(congestion_score)', 6)} AS "
        "average_congestion, CAST(5 * count(*) FILTER (congestion_level = 'SEVERE') AS BIGINT) AS severe_minutes, "
        f"{r('avg(queue_length)', 6)} AS average_queue_length, "
        "count(*) FILTER (congestion_level IN ('HIGH', 'SEVERE')) AS incident_count "
        f"FROM up LEFT JOIN cameras c ON c.camera_id = up.camera_id WHERE lane_id IS NULL AND {half_open('01-08', '01-20')} "
        "GROUP BY 1 ORDER BY round(avg(congestion_score), 9) DESC, severe_minutes DESC, 1 LIMIT 10",
        UPSERTED,
        CAMERAS,
    ),
    "rollup_trends": with_base(
        f"SELECT CAST(hour(window_start) AS INTEGER) AS hour, {r('avg(congestion_score)', 6)} AS average_congestion, "
        f"{r('avg(avg_speed_kmh)', 6)} AS average_speed_kmh, CAST(sum(vehicle_count) AS BIGINT) AS vehicle_count "
        f"FROM up WHERE lane_id IS NULL AND {half_open('01-02', '01-10')} GROUP BY 1",
        UPSERTED,
    ),
    "retention_restart": with_base(
        f"SELECT CASE WHEN window_start < {AS_OF} - INTERVAL 20 DAY THEN 'archive' ELSE 'table' END AS place, camera_id, "
        "window_start, lane_id, vehicle_count, congestion_level FROM m"
    ),
    "stream_rejects": with_events(
        "SELECT reject_reason, count(*) AS records, count(*) AS written FROM (SELECT CASE WHEN k = 98 THEN 'malformed_json' "
        "WHEN k = 96 THEN 'not_an_object' WHEN k = 97 THEN 'bad_frame_id' WHEN k = 99 THEN 'confidence_out_of_range' "
        "WHEN vehicle_class = 'unknown' THEN 'unknown_class' END AS reject_reason FROM det) GROUP BY 1"
    ),
    "stream_late_windows": with_base("SELECT * FROM m"),
    "stream_late_alerts": with_base("SELECT * FROM alerts", CAMERAS, ALERTS.format(metrics="m")),
    "stream_alerts_takeover": with_base(
        "SELECT * FROM alerts",
        "passed AS (SELECT * FROM m WHERE window_start <= (SELECT max(window_start) FROM m) - INTERVAL 1 SECOND)",
        CAMERAS,
        ALERTS.format(metrics="passed"),
    ),
    "archive_roundtrip": with_base(
        f"SELECT *, CAST(window_start AS DATE) AS date FROM m WHERE window_start < {AS_OF} - INTERVAL 20 DAY"
    ),
    "stream_events": with_base(
        "SELECT 'new_alert' AS event, camera_id, congestion_level AS severity, "
        "strftime(window_end, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS window_end, congestion_score AS score FROM mc "
        "WHERE lane_id IS NULL AND congestion_level IN ('HIGH', 'SEVERE')",
        CLOSED,
    ),
    "event_envelopes": with_base(
        f"SELECT 'traffic_metrics_update' AS event, {ENVELOPE_TS}, '{{\"camera_id\":\"' || camera_id || "
        "'\",\"vehicle_count\":' || vehicle_count || ',\"congestion_level\":\"' || congestion_level || '\"}' AS data "
        "FROM latest WHERE camera_id = 'cam_0' UNION ALL "
        f"SELECT 'heatmap_update', {AS_OF}, '{{\"camera_id\":\"' || camera_id || '\",\"avg_vehicle_count\":' || "
        f"CAST({r('avg_count', 2)} AS VARCHAR) || '}}' FROM heat WHERE camera_id = 'cam_0'",
        LATEST,
        HEAT,
    ),
}
