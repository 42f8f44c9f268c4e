"""SQL that states the expected result of each registered query."""

from __future__ import annotations

from roadpass import queries as Q

FLOW = """
m AS (
  SELECT *, (event_id * 2654435761) % 1000003 AS h1,
         (event_id * 40503 + user_id * 7919) % 999983 AS h2
  FROM events
),
flow AS (
  SELECT strftime(ts, '%Y-%m-%d') AS date,
         lpad(CAST(h1 % 9 AS VARCHAR), 4, '0') AS monitor_id,
         lpad(CAST(h2 % 60 AS VARCHAR), 5, '0') AS camera_id,
         'C' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(5, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS car,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS action_time,
         CAST(h2 % 260 AS INTEGER) AS speed,
         CAST((h1 % 8) * (h2 % 7) + 1 AS VARCHAR) AS road_id,
         lpad(CAST((h1 + h2) % 8 AS VARCHAR), 2, '0') AS area_id,
         event_id AS pass_id,
         epoch_us(ts) // 1000000 AS clock
  FROM m
)"""

REGISTRY = """
registry AS (
  SELECT DISTINCT monitor_id, camera_id FROM flow WHERE monitor_id <> '0008' AND CAST(camera_id AS INTEGER) % 7 <> 0
  UNION ALL
  SELECT lpad(CAST(n_regionkey AS VARCHAR), 4, '0'), lpad(CAST(n_nationkey + 60 AS VARCHAR), 5, '0') FROM nation
  UNION ALL
  SELECT '0009', lpad(CAST(r_regionkey AS VARCHAR), 5, '0') FROM region
)"""

AREAS = """
areas AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS area_id, n_name AS area_name FROM nation
  WHERE n_nationkey <> 5
)"""

WATCHED = """
watched AS (
  SELECT DISTINCT 'C' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS car
  FROM supplier
)"""

DETAIL = "date, monitor_id, camera_id, car, action_time, speed, road_id, pass_id"


def _text(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%d %H:%M:%S')"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


ROADS = """
roads AS (
  SELECT area_id, road_id, CAST(sum(n) AS BIGINT) AS car_count,
         string_agg(monitor_id || '=' || n, '|' ORDER BY monitor_id) AS monitor_infos
  FROM (SELECT area_id, road_id, monitor_id, count(*) AS n FROM flow JOIN areas USING (area_id)
        GROUP BY ALL)
  GROUP BY area_id, road_id
)"""

STATUS_COLUMNS = """
  SELECT monitor_id, camera_count, observed_count, car_count, unseen_count, unseen_cameras,
         CASE WHEN car_count = 0 THEN 'missing' WHEN {healthy} THEN 'normal' ELSE 'abnormal' END AS status
  FROM (
    SELECT r.monitor_id, CAST(count(*) AS BIGINT) AS camera_count,
           CAST(any_value(coalesce(o.cameras, 0)) AS BIGINT) AS observed_count,
           CAST(any_value(coalesce(o.cars, 0)) AS BIGINT) AS car_count,
           CAST(count(*) FILTER (s.camera_id IS NULL) AS BIGINT) AS unseen_count,
           coalesce(string_agg(r.camera_id, ',' ORDER BY r.camera_id) FILTER (s.camera_id IS NULL), '')
             AS unseen_cameras
    FROM {registry} r
    LEFT JOIN (SELECT DISTINCT monitor_id, camera_id FROM {flow}) s USING (monitor_id, camera_id)
    LEFT JOIN (SELECT monitor_id, count(DISTINCT camera_id) AS cameras, count(*) AS cars
               FROM {flow} GROUP BY 1) o ON o.monitor_id = r.monitor_id
    GROUP BY r.monitor_id
  )"""

DISTINCT = "(SELECT DISTINCT * FROM registry)"
STATUS = STATUS_COLUMNS.format(healthy="unseen_count = 0", registry=DISTINCT, flow="flow")
STATUS_BY_COUNT = STATUS_COLUMNS.format(healthy="observed_count = camera_count", registry="registry", flow="flow")
ONE_DAY = f" day_flow AS (SELECT * FROM flow WHERE date = '{Q.STATUS_DAY}')"
STATUS_OF_DAY = STATUS_COLUMNS.format(healthy="unseen_count = 0", registry=DISTINCT, flow="day_flow")
TASK_FLOW = f" task_flow AS (SELECT * FROM flow WHERE date BETWEEN '{Q.FIRST_DAY}' AND '{Q.LAST_DAY}')"
STATUS_OF_TASK = STATUS_COLUMNS.format(healthy="unseen_count = 0", registry=DISTINCT, flow="task_flow")

SPEEDS = """
speeds AS (
  SELECT monitor_id,
         CAST(count(*) FILTER (speed >= 0 AND speed < 60) AS BIGINT) AS low,
         CAST(count(*) FILTER (speed >= 60 AND speed < 90) AS BIGINT) AS normal,
         CAST(count(*) FILTER (speed >= 90 AND speed < 120) AS BIGINT) AS medium,
         CAST(count(*) FILTER (speed >= 120) AS BIGINT) AS high
  FROM flow GROUP BY 1
),
ranked AS (
  SELECT * FROM speeds ORDER BY high DESC, medium DESC, normal DESC, low DESC, monitor_id LIMIT 50
)"""

SAMPLE = f"""
hour_cars AS (
  SELECT DISTINCT substr(action_time, 1, 10) AS date, substr(action_time, 12, 2) AS hour, car FROM flow
),
hours AS (
  SELECT date, hour, count(*) AS hour_cars FROM hour_cars GROUP BY 1, 2
),
days AS (
  SELECT date, CAST(sum(hour_cars) AS BIGINT) AS day_cars FROM hours GROUP BY 1
),
quotas AS (
  SELECT date, hour, hour_cars, day_cars,
         least(hour_cars, CAST(floor((hour_cars::DOUBLE / day_cars::DOUBLE)
               * ({Q.EXTRACT_NUM} // (SELECT count(*) FROM days))) AS BIGINT)) AS quota
  FROM hours JOIN days USING (date)
),
sample AS (
  SELECT date, hour, car FROM (
    SELECT c.*, quota, row_number() OVER (PARTITION BY c.date, c.hour
             ORDER BY md5('1000|' || c.date || '|' || c.hour || '|' || car), car) AS rn
    FROM hour_cars c JOIN quotas q ON c.date = q.date AND c.hour = q.hour
  ) WHERE rn <= quota
)"""


def _range(source: str, tie: str) -> str:
    return f"""
SELECT monitor_id,
       strftime(make_timestamp(start * 1000000), '%Y-%m-%d %H:%M') || '~' ||
       strftime(make_timestamp((start + 300) * 1000000), '%Y-%m-%d %H:%M') AS range_time,
       string_agg(car || '=' || {_text('clock')}, '|' ORDER BY clock, {tie}) AS cars
FROM (SELECT *, clock - clock % 300 AS start FROM {source})
GROUP BY monitor_id, start"""


LAST_VISITS = """
visits AS (
  SELECT car, monitor_id, max(clock) AS clock FROM flow GROUP BY 1, 2
)"""


def _conversion(source: str = "flow") -> str:
    flow = Q.ROAD_FLOW
    leads = ", ".join(
        f"lead(monitor_id, {k}) OVER w AS l{k}" if k else "monitor_id AS l0" for k in range(len(flow))
    )
    counts = []
    for k in range(1, len(flow) + 1):
        cond = " AND ".join(f"l{i} = '{flow[i]}'" for i in range(k))
        counts.append(f"CAST(count(*) FILTER ({cond}) AS BIGINT) AS c{k}")
    rows = []
    for k in range(1, len(flow) + 1):
        rate = f"CASE WHEN c{k - 1} > 0 THEN round(c{k}::DOUBLE / c{k - 1}, 2) END" if k > 1 else "CAST(NULL AS DOUBLE)"
        rows.append(
            f"SELECT '{','.join(flow[:k])}' AS flow, CAST({k} AS INTEGER) AS step, c{k} AS match_count, {rate} AS rate FROM c"
        )
    return (
        _with(
            FLOW,
            f" s AS (SELECT {leads} FROM {source} WINDOW w AS (PARTITION BY car ORDER BY clock, pass_id))",
            f" c AS (SELECT {', '.join(counts)} FROM s)",
        )
        + "\n"
        + " UNION ALL ".join(rows)
    )


def _windows(key: str, count: int) -> str:
    return f"""
windows AS (
  SELECT {key}, start, start + {count * 10} AS stop, CAST(sum(speed) AS BIGINT) AS speed_sum,
         CAST(count(*) AS BIGINT) AS n
  FROM (SELECT {key}, speed, (clock // 10) * 10 - 10 * k AS start
        FROM flow CROSS JOIN (SELECT unnest(range({count})) AS k))
  GROUP BY {key}, start
)"""


MINUTES = """
minutes AS (
  SELECT strftime(make_timestamp((clock // 60) * 60000000), '%Y%m%d') AS day, camera_id,
         strftime(make_timestamp((clock // 60) * 60000000), '%H%M') AS hhmm, clock // 60 AS minute,
         CAST(sum(speed) AS BIGINT) AS speed_sum, CAST(count(*) AS BIGINT) AS n
  FROM flow GROUP BY clock // 60, camera_id
)"""


def _features() -> str:
    width = Q.WIDTH
    cols = ", ".join(
        f"coalesce(max(CASE WHEN m.minute = l.minute - {3 - i} AND r.pos = {p} "
        f"THEN m.speed_sum::DOUBLE / m.n END), -1.0::DOUBLE) AS f{i * width + p}"
        for i in range(3)
        for p in range(width)
    )
    relations = f"""
relations AS (
  SELECT camera_id, pos, lpad(CAST((c + pos - c % 6 + 60) % 60 AS VARCHAR), 5, '0') AS related_id
  FROM (SELECT DISTINCT camera_id, CAST(camera_id AS BIGINT) AS c FROM flow)
  CROSS JOIN (SELECT unnest(range({width})) AS pos)
  WHERE pos < 3 + c % 5
)"""
    return (
        _with(FLOW, MINUTES, relations)
        + f"""
SELECT l.camera_id, l.day, l.hhmm, {cols}, any_value(l.speed_sum::DOUBLE / l.n) AS label_speed,
       CAST(least(floor(floor(any_value(l.speed_sum::DOUBLE / l.n)) / 10), 10) AS DOUBLE) AS label
FROM minutes l
JOIN relations r ON r.camera_id = l.camera_id
LEFT JOIN minutes m ON m.camera_id = r.related_id AND m.minute BETWEEN l.minute - 3 AND l.minute - 1
GROUP BY l.camera_id, l.day, l.hhmm"""
    )


def _companions(least: int) -> str:
    return (
        _with(FLOW, " entries AS (SELECT DISTINCT car, monitor_id, clock // 300 AS slot FROM flow)")
        + f"""
SELECT a.car, b.car AS companion, CAST(count(*) AS BIGINT) AS shared, CAST(count(DISTINCT a.monitor_id) AS BIGINT) AS monitors,
  {_text('min(a.slot) * 300')} AS first_start, {_text('max(a.slot) * 300')} AS last_start
FROM entries a JOIN entries b ON a.monitor_id = b.monitor_id AND a.slot = b.slot AND a.car < b.car
GROUP BY a.car, b.car HAVING count(*) >= {least} AND count(DISTINCT a.monitor_id) >= 2"""
    )


SPLIT = """
halves AS (
  SELECT camera_id, CAST(camera_id AS INTEGER) AS c,
    count(*) FILTER (substr(md5('1000|' || camera_id || '|' || day || '|' || hhmm), 1, 8) < '99999999') AS n_train,
    count(*) FILTER (substr(md5('1000|' || camera_id || '|' || day || '|' || hhmm), 1, 8) >= '99999999') AS n_test
  FROM minutes GROUP BY camera_id
),
gates AS (
  SELECT *, c % 5 <> 0 AND n_train >= 30 AND n_test > 0 AS accepted FROM halves
)"""


def sql() -> dict[str, str]:
    flow = _with(FLOW) + "\n"
    sample = _with(FLOW, SAMPLE) + "\n"
    cars = ", ".join(f"'{c}'" for c in Q.CARS)
    monitors = ", ".join(f"'{m}'" for m in Q.MONITORS.split(","))
    all_flow = FLOW.replace("flow AS (", "all_flow AS (")
    in_days = f"date BETWEEN '{Q.FIRST_DAY}' AND '{Q.LAST_DAY}'"
    task_only = f" flow AS (SELECT * FROM all_flow WHERE {in_days})"
    congestion = (
        _with(FLOW, _windows("monitor_id", 6))
        + f"""
SELECT {_text('start')} AS window_start, {_text('stop')} AS window_end, monitor_id, n AS car_count,
  speed_sum, speed_sum::DOUBLE / n AS mean_speed FROM windows"""
    )
    top3 = (
        _with(FLOW, AREAS, ROADS)
        + """
SELECT area_id, road_id, car_count, monitor_infos,
  CASE WHEN car_count > 170 THEN 'A LEVEL' WHEN car_count > 160 THEN 'B LEVEL'
       WHEN car_count > 150 THEN 'C LEVEL' ELSE 'D LEVEL' END AS flow_level
FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY car_count DESC, road_id) AS rn FROM roads)
WHERE rn <= 3"""
    )
    return {
        "stream_congestion": congestion,
        "stream_congestion_panes": congestion,
        "stream_congestion_restarted": congestion,
        "area_top3": top3,
        "area_top3_sql": top3,
        "passes": flow + f"SELECT {DETAIL}, area_id FROM flow",
        "pass_count": "SELECT CAST(count(*) AS BIGINT) AS pass_count FROM events",
        "date_range_passes": flow + f"SELECT monitor_id, car, road_id, area_id, pass_id FROM flow WHERE {in_days}",
        "listed_car_passes": flow + f"SELECT {DETAIL} FROM flow WHERE car IN ({cars})",
        "listed_cars_in_range": flow + f"SELECT {DETAIL} FROM flow WHERE car IN ({cars}) AND {in_days}",
        "vehicle_search": flow
        + f"""SELECT {DETAIL}, area_id FROM flow WHERE {in_days}
AND speed BETWEEN {Q.SPEED_RANGE[0]} AND {Q.SPEED_RANGE[1]} AND monitor_id IN ({monitors}) AND area_id = '{Q.AREA_ID}'""",
        "time_keys": flow
        + """SELECT pass_id, replace(substr(action_time, 1, 13), ' ', '_') AS date_hour,
  strftime(make_timestamp((clock - clock % 300) * 1000000), '%Y-%m-%d %H:%M') || '~' ||
  strftime(make_timestamp((clock - clock % 300 + 300) * 1000000), '%Y-%m-%d %H:%M') AS range_time,
  replace(date, '-', '') AS day, substr(action_time, 12, 2) || substr(action_time, 15, 2) AS hhmm,
  clock % 300 AS seconds_in_range, substr(action_time, 12) < '12:00:00' AS before_noon,
  substr(action_time, 12) > '18:30:00' AS evening FROM flow""",
        "prefixed_roads": flow
        + """SELECT pass_id, (pass_id % 10) || '_' || area_id || ':' || road_id AS salted,
  area_id || ':' || road_id AS plain, lpad(road_id, 2, '0') AS padded FROM flow""",
        "area_passes": _with(FLOW, AREAS)
        + "\nSELECT area_id, area_name, road_id, monitor_id, car, pass_id FROM flow JOIN areas USING (area_id)",
        "area_road_flow": _with(FLOW, AREAS, ROADS) + "\nSELECT * FROM roads",
        "salted_area_road": _with(FLOW, AREAS, ROADS) + "\nSELECT * FROM roads",
        "merged_histogram": flow
        + """SELECT area_id, CAST(sum(n) AS BIGINT) AS car_count,
  string_agg(monitor_id || '=' || n, '|' ORDER BY monitor_id) AS monitor_infos
FROM (SELECT area_id, monitor_id, count(*) AS n FROM flow GROUP BY 1, 2) GROUP BY area_id""",
        "monitor_rollup": flow
        + """SELECT f.monitor_id, any_value(l.area_id) AS area_id,
  string_agg(DISTINCT camera_id, ',' ORDER BY camera_id) AS camera_ids,
  CAST(count(DISTINCT camera_id) AS BIGINT) AS camera_count, CAST(count(*) AS BIGINT) AS car_count
FROM flow f JOIN (
  SELECT monitor_id, area_id FROM (
    SELECT m.*, f.monitor_id, f.area_id,
           row_number() OVER (PARTITION BY f.monitor_id ORDER BY m.ts DESC, f.area_id DESC) AS rn
    FROM m JOIN flow f ON f.pass_id = m.event_id) WHERE rn = 1) l ON l.monitor_id = f.monitor_id
GROUP BY f.monitor_id""",
        "registry_rollup": _with(FLOW, REGISTRY)
        + """
SELECT monitor_id, string_agg(camera_id, ',' ORDER BY camera_id) AS camera_ids,
  CAST(count(*) AS BIGINT) AS camera_count FROM registry GROUP BY 1""",
        "monitor_status": _with(FLOW, REGISTRY) + STATUS,
        "monitor_status_by_count": _with(FLOW, REGISTRY) + STATUS_BY_COUNT,
        "abnormal_cameras": _with(FLOW, REGISTRY)
        + "\nSELECT DISTINCT monitor_id, camera_id FROM registry r ANTI JOIN flow f USING (monitor_id, camera_id)",
        "network_state": _with(FLOW, REGISTRY, f" status AS ({STATUS})")
        + """
SELECT CAST(count(*) FILTER (status = 'normal') AS BIGINT) AS normal_monitor_count,
  CAST(sum(camera_count - CASE WHEN status = 'normal' THEN 0 ELSE unseen_count END) AS BIGINT) AS normal_camera_count,
  CAST(count(*) FILTER (status <> 'normal') AS BIGINT) AS abnormal_monitor_count,
  CAST(sum(CASE WHEN status = 'normal' THEN 0 ELSE unseen_count END) AS BIGINT) AS abnormal_camera_count,
  coalesce(string_agg(monitor_id || ':' || unseen_cameras, '~' ORDER BY monitor_id)
    FILTER (status <> 'normal' AND unseen_cameras <> ''), '') AS abnormal_monitor_camera_infos
FROM status""",
        "monitor_status_of_day": _with(FLOW, REGISTRY, ONE_DAY) + STATUS_OF_DAY,
        "abnormal_cameras_of_day": _with(FLOW, REGISTRY, ONE_DAY)
        + "\nSELECT DISTINCT monitor_id, camera_id FROM registry r ANTI JOIN day_flow f USING (monitor_id, camera_id)",
        "monitor_topn": _with(FLOW, REGISTRY)
        + f"""
SELECT monitor_id, CAST(count(*) AS BIGINT) AS car_count FROM flow SEMI JOIN registry USING (monitor_id)
GROUP BY 1 ORDER BY car_count DESC, monitor_id LIMIT {Q.TOP_NUM}""",
        "monitor_topn_detail": _with(FLOW, REGISTRY)
        + f"""
SELECT {DETAIL} FROM flow WHERE monitor_id IN (SELECT monitor_id FROM (
  SELECT monitor_id, count(*) AS n FROM flow SEMI JOIN registry USING (monitor_id)
  GROUP BY 1 ORDER BY n DESC, monitor_id LIMIT {Q.TOP_NUM}))""",
        "speed_rank": _with(FLOW, SPEEDS) + "\nSELECT * FROM ranked",
        "speed_top10": _with(FLOW, SPEEDS)
        + f"""
SELECT {DETAIL}, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY monitor_id
           ORDER BY speed DESC, action_time, car, camera_id, pass_id) AS rank
  FROM flow WHERE monitor_id IN (SELECT monitor_id FROM ranked))
WHERE rank <= 10""",
        "flow_conversion": _conversion(),
        "car_track": flow
        + """SELECT car, date,
  string_agg(monitor_id || '=' || action_time, '|' ORDER BY clock, pass_id) AS track FROM flow GROUP BY car, date""",
        "track_points": flow + "SELECT car, monitor_id, action_time, pass_id FROM flow",
        "last_visits": flow + "SELECT car, monitor_id, max(action_time) AS action_time FROM flow GROUP BY 1, 2",
        "track_last_visits": flow
        + "SELECT car, monitor_id, max(action_time) AS action_time FROM flow GROUP BY 1, 2",
        "range_cars_last": _with(FLOW, LAST_VISITS) + _range("visits", "car"),
        "range_cars_all": flow + _range("flow", "pass_id"),
        "companions_of_watched": flow
        + f"""SELECT a.car, b.car AS companion, CAST(count(*) AS BIGINT) AS meetings,
  CAST(count(DISTINCT a.monitor_id) AS BIGINT) AS monitors, min(a.action_time) AS first_time, max(a.action_time) AS last_time
FROM flow a
JOIN flow b ON a.monitor_id = b.monitor_id AND b.clock BETWEEN a.clock - 300 AND a.clock + 300 AND a.car <> b.car
WHERE a.car IN ({cars}) GROUP BY a.car, b.car""",
        "companion_passes": flow
        + f"""SELECT a.car, b.car AS companion, a.monitor_id, a.action_time, b.action_time AS companion_time,
  a.pass_id, b.pass_id AS companion_pass_id
FROM flow a
JOIN flow b ON a.monitor_id = b.monitor_id AND b.clock BETWEEN a.clock - 300 AND a.clock + 300 AND a.car <> b.car
WHERE a.car IN ({cars})""",
        "companion_encounters": flow
        + """SELECT a.car, CAST(count(b.pass_id) AS BIGINT) AS encounters
FROM flow a LEFT JOIN flow b
  ON a.monitor_id = b.monitor_id AND b.clock BETWEEN a.clock - 300 AND a.clock + 300 AND a.car <> b.car
GROUP BY a.car""",
        "network_companions": _companions(3),
        "network_companions_twice": _companions(2),
        "readable_car_track": flow
        + """SELECT car, date, string_agg(monitor_id || '=' || action_time, '|' ORDER BY clock, pass_id) AS track
FROM flow WHERE pass_id % 7 <> 0 GROUP BY car, date""",
        "unread_passes": flow
        + "SELECT date, CAST(count(*) AS BIGINT) AS unread FROM flow WHERE pass_id % 7 = 0 GROUP BY date",
        "range_cars_incremental": _with(FLOW, LAST_VISITS) + _range("visits", "car"),
        "sketch_salted_areas": flow
        + """SELECT area_id, CAST(count(*) AS BIGINT) AS pass_count, max(speed) AS max_speed,
  string_agg(DISTINCT car, ',' ORDER BY car) AS cars FROM flow GROUP BY area_id""",
        "flow_prefixes_sql": "\nUNION ALL ".join(
            f"SELECT n_nationkey AS task_id, '{','.join(Q.ROAD_FLOW[:k])}' AS flow, CAST({k} AS INTEGER) AS step FROM nation"
            for k in range(1, len(Q.ROAD_FLOW) + 1)
        ),
        "monitor_search": flow
        + f"""SELECT monitor_id, string_agg(DISTINCT camera_id, ',' ORDER BY camera_id) AS camera_ids,
  CAST(count(*) AS BIGINT) AS car_count FROM flow WHERE date = '{Q.FIRST_DAY}'
GROUP BY monitor_id HAVING bool_or(camera_id IN ({", ".join(f"'{c}'" for c in Q.CAMERAS.split(","))}))""",
        "minute_log_versions": _with(FLOW, MINUTES)
        + """
SELECT day, camera_id, hhmm, speed_sum, n, 'last' AS at FROM minutes
UNION ALL
SELECT day, camera_id, hhmm, speed_sum, n + CASE WHEN hhmm >= '1200' THEN 1 ELSE 0 END, 'second' FROM minutes""",
        "plate_lookup": flow + f"SELECT {DETAIL}, area_id FROM flow WHERE car IN ({cars})",
        "camera_model_gates": _with(FLOW, MINUTES, SPLIT)
        + """
SELECT camera_id, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test,
  CASE WHEN accepted THEN CAST(n_test AS BIGINT) END AS hits, accepted,
  CASE WHEN accepted THEN CAST(n_train + n_test AS BIGINT) END AS "right" FROM gates""",
        "job_monitor_state": _with(FLOW, REGISTRY, TASK_FLOW, f" status AS ({STATUS_OF_TASK})")
        + f"""
SELECT CAST({Q.TASK_ID} AS BIGINT) AS task_id, monitor_id, camera_count, observed_count, car_count, unseen_count, status,
  (SELECT CAST(count(*) FILTER (status = 'normal') AS BIGINT) FROM status) AS normal_monitor_count,
  (SELECT CAST(sum(camera_count - CASE WHEN status = 'normal' THEN 0 ELSE unseen_count END) AS BIGINT) FROM status) AS normal_camera_count,
  (SELECT CAST(count(*) FILTER (status <> 'normal') AS BIGINT) FROM status) AS abnormal_monitor_count,
  (SELECT CAST(sum(CASE WHEN status = 'normal' THEN 0 ELSE unseen_count END) AS BIGINT) FROM status) AS abnormal_camera_count
FROM status""",
        "job_topn_detail": _with(FLOW, REGISTRY, TASK_FLOW)
        + f"""
SELECT {DETAIL.removesuffix(", pass_id")} FROM task_flow WHERE monitor_id IN (SELECT monitor_id FROM (
  SELECT monitor_id, count(*) AS n FROM task_flow SEMI JOIN registry USING (monitor_id)
  GROUP BY 1 ORDER BY n DESC, monitor_id LIMIT {Q.TASK_ID}))""",
        "job_top10_speed": _with(all_flow, task_only, SPEEDS)
        + f"""
SELECT {DETAIL.removesuffix(", pass_id")} FROM (
  SELECT *, row_number() OVER (PARTITION BY monitor_id
           ORDER BY speed DESC, action_time, car, camera_id, pass_id) AS rank
  FROM flow WHERE monitor_id IN (SELECT monitor_id FROM ranked))
WHERE rank <= 10""",
        "job_extract_detail": _with(all_flow, task_only, SAMPLE)
        + f"""
SELECT {DETAIL.removesuffix(", pass_id")} FROM flow WHERE car IN (SELECT car FROM sample)""",
        "job_range_cars": _with(all_flow, task_only, LAST_VISITS) + _range("visits", "car"),
        "hour_counts": sample
        + "SELECT date, hour, CAST(hour_cars AS BIGINT) AS hour_cars, day_cars FROM quotas",
        "hour_quotas": sample
        + "SELECT date, hour, CAST(hour_cars AS BIGINT) AS hour_cars, day_cars, CAST(quota AS BIGINT) AS quota FROM quotas",
        "untimed_passes": "SELECT CAST(count(*) FILTER (ts IS NULL) AS BIGINT) AS untimed FROM events",
        "hour_sample": sample + "SELECT car, date, date || '_' || hour AS date_hour FROM sample",
        "hour_sample_detail": sample
        + f"SELECT {DETAIL} FROM flow WHERE car IN (SELECT car FROM sample)",
        "hour_sample_detail_repeated": sample
        + """SELECT f.date, f.monitor_id, f.camera_id, f.car, f.action_time, f.speed, f.road_id, f.pass_id
FROM flow f JOIN sample s ON s.car = f.car""",
        "hour_sample_track": sample
        + """SELECT car, date, string_agg(monitor_id, ',' ORDER BY clock, pass_id) AS track
FROM flow WHERE car IN (SELECT car FROM sample) GROUP BY car, date""",
        "stream_minute_store": _with(FLOW, _windows("camera_id", 2))
        + """
SELECT day, camera_id, hhmm, arg_max(speed_sum, stop) AS speed_sum, arg_max(n, stop) AS n
FROM (SELECT *, strftime(make_timestamp(stop * 1000000), '%Y%m%d') AS day,
             strftime(make_timestamp(stop * 1000000), '%H%M') AS hhmm FROM windows)
GROUP BY 1, 2, 3""",
        "stream_watchlist": _with(FLOW, WATCHED)
        + """
SELECT date, monitor_id, camera_id, car, action_time, speed, road_id, area_id
FROM flow WHERE car IN (SELECT car FROM watched)""",
        "minute_speed": _with(FLOW, MINUTES) + "\nSELECT day, camera_id, hhmm, speed_sum, n FROM minutes",
        "minute_features": _features(),
        "feature_split": _with(FLOW, MINUTES)
        + """
SELECT camera_id, day, hhmm,
  CASE WHEN substr(md5('1000|' || camera_id || '|' || day || '|' || hhmm), 1, 8) < '99999999'
       THEN 'train' ELSE 'test' END AS side
FROM minutes""",
        "speed_class_model": _with(FLOW, MINUTES)
        + """
SELECT CAST(least(floor(floor(speed_sum::DOUBLE / n) / 10), 10) AS DOUBLE) AS label,
  CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS predicted, true AS gate_sound
FROM minutes WHERE substr(md5('1000|' || camera_id || '|' || day || '|' || hhmm), 1, 8) >= '99999999' GROUP BY 1""",
        "speed_class_predictions": flow
        + f"""SELECT DISTINCT camera_id, '{Q.PREDICT_AT[0]}' AS day, '{Q.PREDICT_AT[1]}' AS hhmm, true AS valid FROM flow""",
        "pass_log_round_trip": flow
        + """SELECT date, monitor_id, camera_id, CASE WHEN pass_id % 3 = 0 THEN '"' || car ELSE car END AS car,
  action_time, speed, CASE WHEN pass_id % 5 = 0 THEN '' ELSE road_id END AS road_id, area_id FROM flow""",
        "registry_round_trip": _with(FLOW, REGISTRY) + "\nSELECT * FROM registry",
        "catalog_round_trip": flow + f"SELECT {DETAIL}, area_id FROM flow",
        "pass_store_round_trip": flow + f"SELECT {DETAIL}, area_id FROM flow",
        "minute_store_round_trip": _with(FLOW, MINUTES) + "\nSELECT day, camera_id, hhmm, speed_sum, n FROM minutes",
        "task_parameters": f"""SELECT n_nationkey AS task_id, '{Q.FIRST_DAY}' AS start_date, '{Q.LAST_DAY}' AS end_date,
  CAST(n_nationkey AS INTEGER) AS top_num, CAST({Q.EXTRACT_NUM} AS INTEGER) AS extract_num,
  '{",".join(Q.ROAD_FLOW)}' AS road_flow FROM nation WHERE n_nationkey = {Q.TASK_ID}""",
        "job_monitor_flow": _with(FLOW, REGISTRY, TASK_FLOW, f" status AS ({STATUS_OF_TASK})")
        + f"""
SELECT CAST({Q.TASK_ID} AS BIGINT) AS task_id, monitor_id, CAST(count(*) AS BIGINT) AS car_count,
  (SELECT CAST(count(*) FILTER (status = 'normal') AS BIGINT) FROM status) AS normal_monitor_count,
  (SELECT CAST(count(*) FILTER (status <> 'normal') AS BIGINT) FROM status) AS abnormal_monitor_count
FROM task_flow SEMI JOIN registry USING (monitor_id)
GROUP BY monitor_id ORDER BY car_count DESC, monitor_id LIMIT {Q.TASK_ID}""",
        "job_random_extract": _with(FLOW.replace("flow AS (", "all_flow AS ("),
            f" flow AS (SELECT * FROM all_flow WHERE {in_days})", SAMPLE)
        + "\nSELECT car, date, date || '_' || hour AS date_hour FROM sample",
        "job_with_the_car": flow
        + f"""SELECT car, date, string_agg(monitor_id || '=' || action_time, '|' ORDER BY clock, pass_id) AS track
FROM flow WHERE {in_days} GROUP BY car, date""",
        "job_area_top3": _with(FLOW, AREAS, TASK_FLOW)
        + """
SELECT area_id, road_id, car_count,
  CASE WHEN car_count > 170 THEN 'A LEVEL' WHEN car_count > 160 THEN 'B LEVEL'
       WHEN car_count > 150 THEN 'C LEVEL' ELSE 'D LEVEL' END AS flow_level
FROM (
  SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY car_count DESC, road_id) AS rn
  FROM (SELECT area_id, road_id, CAST(count(*) AS BIGINT) AS car_count FROM task_flow JOIN areas USING (area_id) GROUP BY 1, 2))
WHERE rn <= 3""",
        "job_flow_conversion": _conversion(f"flow WHERE {in_days}"),
    }
