"""SQL for the registered queries, written from the definitions and without the library's rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from fleetlens.testbed import settings as s
from fleetlens.testbed.fleet import DOMAIN, USER_PREFIX

_WEEK_AGO = "TIMESTAMP '2024-01-23 12:00:00'"
_MONTH_AGO = "TIMESTAMP '2023-12-31 12:00:00'"
_COHORT = f"""cohort AS (
  SELECT DISTINCT sensor, wguid FROM results
  WHERE resulttime >= TIMESTAMP '{s.COHORT_FROM}' AND resulttime <= TIMESTAMP '{s.COHORT_TO}')"""
# The machines of the uploaded list in place of a sensor's.
_LISTED = """cohort AS (
  SELECT DISTINCT 'uploaded' AS sensor, c_custkey AS wguid FROM customer
  WHERE 'HOST-0' || substr(c_name, 10, 9) IN (SELECT substr('HOST-0' || substr(s_name, 10, 9) || '-DOCK', 1, 15) FROM supplier))"""
_COMMON = f"""
WITH results AS (
  SELECT user_id AS wguid, upper(substr(event_type, 1, 1)) || '-' || CAST(user_id AS VARCHAR) AS systemid,
         regexp_extract(props, '([0-9]+)', 1) AS sensorid, event_type AS sensor,
         CAST(floor(value) AS INTEGER) AS severity, ts AS resulttime, CAST(ts AS DATE) AS resultdate,
         props AS instancevalue
  FROM events),
severe AS (SELECT * FROM results WHERE severity >= 8 AND systemid NOT LIKE 'V%'),
derived AS (
  SELECT o_custkey AS wguid, o_orderstatus || '-' || CAST(o_custkey AS VARCHAR) AS systemid,
         CAST(NULL AS VARCHAR) AS sensorid, o_orderpriority AS sensor,
         CAST(floor(o_totalprice / 10000) AS INTEGER) AS severity, o_orderdate AS resulttime,
         CAST(o_orderdate AS DATE) AS resultdate, o_orderstatus AS instancevalue
  FROM orders),
{_COHORT},
installs AS (
  SELECT o_custkey AS wguid, p_name, p_type, p_brand, CAST(p_size AS VARCHAR) AS p_size, l_partkey,
         l_shipdate AS installdate, o_orderdate AS starttime
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
recent_installs AS (
  SELECT * FROM installs
  WHERE installdate >= TIMESTAMP '{s.ITEMS_FROM}' AND installdate <= TIMESTAMP '{s.ITEMS_TO}'),
hosts AS (
  SELECT c_custkey AS wguid, c_name, 'HOST-0' || substr(c_name, 10, 9) AS hostname,
         c_mktsegment AS model, 'Maker-' || CAST(c_nationkey AS VARCHAR) AS manufacturer, c_nationkey,
         CAST(round((c_acctbal + 1000) * 100) AS BIGINT) * 1000 AS memory
  FROM customer),
assets AS (
  SELECT hostname, o_orderdate AS invoicedt, c_nationkey AS assetlocation
  FROM orders JOIN hosts ON o_custkey = wguid),
places AS (
  SELECT n_nationkey AS loc_id, 'SITE-' || n_name || '-A' AS loc_remark, r_name AS country, n_name AS city
  FROM nation JOIN region ON n_regionkey = r_regionkey),
asset_rows AS (
  SELECT c.sensor, h.wguid, h.manufacturer, h.model, h.hostname, a.invoicedt, a.assetlocation,
         p.loc_remark, p.country, p.city
  FROM assets a JOIN hosts h ON h.hostname = a.hostname LEFT JOIN places p ON p.loc_id = a.assetlocation
  JOIN cohort c ON c.wguid = h.wguid),
latest_faults AS (
  SELECT wguid, vwtime, appname || ' ' || appver AS app FROM (
    SELECT user_id AS wguid, ts AS vwtime, event_type AS appname,
           substr(regexp_extract(props, '([0-9]+)', 1), 1, 1) AS appver,
           row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS newest
    FROM events WHERE ts >= TIMESTAMP '2023-12-31' AND ts <= TIMESTAMP '2024-01-31')
  WHERE newest = 1),
faults AS (
  SELECT wguid, app, 30 AS days FROM latest_faults
  UNION ALL SELECT wguid, app, 7 AS days FROM latest_faults WHERE vwtime >= {_WEEK_AGO}),
health AS (
  SELECT wguid, days, CASE WHEN score <= 0 THEN NULL WHEN score <= 80 THEN 'Poor' WHEN score <= 90 THEN 'Fair'
                           WHEN score <= 97 THEN 'Good' ELSE 'Excellent' END AS health_score
  FROM (SELECT user_id AS wguid, 7 AS days, avg(value * 1.8) AS score FROM events
        WHERE ts >= {_WEEK_AGO} AND ts <= TIMESTAMP '2024-01-31' AND event_type <> 'view' GROUP BY user_id
        UNION ALL
        SELECT user_id AS wguid, 30 AS days, avg(value * 1.8) AS score FROM events
        WHERE ts >= {_MONTH_AGO} AND ts <= TIMESTAMP '2024-01-31' AND event_type <> 'view' GROUP BY user_id)),
series AS (SELECT sensor, resultdate AS ds, count(*) AS y FROM results GROUP BY ALL),
smooth AS (
  SELECT sensor, ds, y, CASE WHEN count(y) OVER around = 7 THEN avg(y) OVER around END AS trend,
         row_number() OVER (PARTITION BY sensor ORDER BY ds) - 1 AS position
  FROM series
  WINDOW around AS (PARTITION BY sensor ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
band AS (SELECT sensor, avg(trend) AS mean, stddev_samp(trend) AS std FROM smooth GROUP BY sensor),
points AS (
  SELECT smooth.sensor, ds, y, trend,
         coalesce(trend < greatest(mean - {s.EVENT_SIGMAS} * std, 0) OR trend > mean + {s.EVENT_SIGMAS} * std, FALSE)
           AS is_anomaly
  FROM smooth JOIN band ON smooth.sensor = band.sensor),
bad_days AS (SELECT sensor, ds AS anomaly_date FROM points WHERE is_anomaly),
bad_results AS (
  SELECT results.* FROM results JOIN bad_days
  ON results.sensor = bad_days.sensor AND results.resultdate = bad_days.anomaly_date),
order_series AS (SELECT sensor, resultdate AS ds, count(*) AS y FROM derived GROUP BY ALL),
order_smooth AS (
  SELECT sensor, ds, CASE WHEN count(y) OVER around = 7 THEN avg(y) OVER around END AS trend
  FROM order_series
  WINDOW around AS (PARTITION BY sensor ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
order_band AS (SELECT sensor, avg(trend) AS mean, stddev_samp(trend) AS std FROM order_smooth GROUP BY sensor),
order_days AS (
  SELECT o.sensor, ds AS anomaly_date FROM order_smooth o JOIN order_band b ON o.sensor = b.sensor
  WHERE trend < greatest(mean - {s.ORDER_SIGMAS} * std, 0) OR trend > mean + {s.ORDER_SIGMAS} * std),
order_cohort AS (
  SELECT DISTINCT d.sensor, d.wguid, r.date_from, r.date_to
  FROM derived d JOIN order_days x ON d.sensor = x.sensor AND d.resultdate = x.anomaly_date
  JOIN (SELECT sensor, CAST(min(anomaly_date) - INTERVAL 7 DAY AS DATE) AS date_from, max(anomaly_date) AS date_to
        FROM order_days GROUP BY sensor) r ON r.sensor = d.sensor),
uploaded AS (
  SELECT h.wguid, h.hostname || '{DOMAIN}' AS name FROM hosts h
  WHERE h.hostname IN (SELECT substr('HOST-0' || substr(s_name, 10, 9) || '-DOCK', 1, 15) FROM supplier)),
uploaded_results AS (
  SELECT DISTINCT sensor, wguid, systemid, resulttime, resultdate FROM (
    SELECT sensor, wguid, systemid, resulttime, resultdate FROM results
    UNION ALL SELECT sensor, wguid, systemid, resulttime, resultdate FROM severe WHERE sensor IN ('click', 'error'))
  WHERE wguid IN (SELECT wguid FROM uploaded)
    AND resulttime >= TIMESTAMP '{s.MONTH_FROM}' AND resulttime <= TIMESTAMP '{s.MONTH_TO}'),
items AS (
  SELECT 'sensor' AS kind, wguid, sensor AS item FROM results
  WHERE resulttime > TIMESTAMP '{s.COMPARE_FROM}' AND resulttime <= TIMESTAMP '{s.COMPARE_TO}'
  UNION ALL
  SELECT kind, wguid, item FROM (
    SELECT 'software' AS kind, wguid, p_type AS item, installdate FROM installs
    UNION ALL SELECT 'driver' AS kind, wguid, p_brand AS item, installdate FROM installs
    UNION ALL SELECT 'patch' AS kind, wguid, p_name AS item, installdate FROM installs
    UNION ALL SELECT 'change' AS kind, wguid, p_size AS item, installdate FROM installs)
  WHERE installdate >= TIMESTAMP '{s.COMPARE_FROM}' AND installdate <= TIMESTAMP '{s.COMPARE_TO}'),
yearly AS (
  SELECT * FROM (SELECT * FROM results UNION ALL SELECT * FROM derived)
  WHERE severity > 4 AND systemid NOT LIKE 'V%'
    AND resulttime > TIMESTAMP '{s.ENRICHED_RANGE[0]}' AND resulttime < TIMESTAMP '{s.ENRICHED_RANGE[1]}'
    AND sensor IN ({", ".join(f"'{x}'" for x in s.ENRICHED_SENSORS)})),
wide_rows AS (
  SELECT y.wguid, y.systemid, y.sensor, y.severity, y.resulttime, y.instancevalue,
         h.hostname || '{DOMAIN}' AS sconfig_systemid, h.memory / 1e7 AS memory_1e7, h.model,
         CAST(n.n_regionkey AS VARCHAR) AS sensorcategory, n.n_name AS description
  FROM yearly y LEFT JOIN hosts h ON y.wguid = h.wguid
  LEFT JOIN nation n ON y.sensorid = CAST(n.n_nationkey AS VARCHAR))
"""


def _presence(
    facts: str,
    keys: Sequence[str],
    threshold: float,
    *,
    mode: str = "rows",
    within: Sequence[str] = (),
    cohort: str = "cohort",
    condition: str = "TRUE",
) -> str:
    """Counts and machines of the joined rows, each computed on its own."""
    group = ", ".join(["c.sensor", *[f"f.{w}" for w in within]])
    names = ", ".join(f"f.{k}" for k in keys)
    amount = "count(*)" if mode == "rows" else "count(DISTINCT f.wguid)"
    plain = ", ".join(["sensor", *within])
    return f"""
      SELECT {plain}, {", ".join(keys)}, round(100.0 * n / machines, 4) AS system_percentage
      FROM (SELECT {group}, {names}, {amount} AS n FROM ({facts}) f JOIN {cohort} c ON f.wguid = c.wguid
            WHERE {condition} GROUP BY {group}, {names})
      JOIN (SELECT {group}, count(DISTINCT f.wguid) AS machines FROM ({facts}) f JOIN {cohort} c ON f.wguid = c.wguid
            WHERE {condition} GROUP BY {group}) USING ({plain})
      WHERE 100.0 * n / machines > {threshold}"""


def _counts(label: str, expression: str, condition: str = "TRUE") -> str:
    return f"""
      SELECT sensor, {expression} AS {label}, count(*) AS count FROM asset_rows
      WHERE {expression} IS NOT NULL AND {condition} GROUP BY ALL"""


_OWN_RANGE = "f.installdate >= c.date_from AND f.installdate <= c.date_to"
_PATCHES = "SELECT wguid, p_name AS patchname, installdate FROM recent_installs"
_ALL_PATCHES = "SELECT wguid, p_name AS patchname, installdate FROM installs"
_SOFTWARE = "SELECT wguid, p_type AS packagename, p_brand AS version FROM installs"
_RECENT_SOFTWARE = "SELECT wguid, p_type AS packagename, p_brand AS version FROM recent_installs"
_CONTROLLERS = "SELECT wguid, p_type AS controller FROM recent_installs"
_BIOS = """SELECT o_custkey AS wguid, o_orderpriority AS name, CAST(date_trunc('year', o_orderdate) AS DATE) AS date
           FROM orders JOIN customer ON o_custkey = c_custkey"""
_CHANGES = """SELECT wguid, software, newversion FROM (
  SELECT wguid, p_type AS software, p_brand AS newversion,
         row_number() OVER (PARTITION BY wguid, p_type ORDER BY installdate DESC, p_brand DESC) AS newest
  FROM recent_installs) WHERE newest = 1"""
_USAGE = f"""SELECT DISTINCT wguid, p_name AS applicationname FROM installs
  WHERE starttime >= TIMESTAMP '{s.ITEMS_FROM}' AND starttime <= TIMESTAMP '{s.ITEMS_TO}'"""
_MOVED = f"installdate >= TIMESTAMP '{s.MOVED_FROM}' AND installdate <= TIMESTAMP '{s.MOVED_TO}'"
_MOVED_PATCHES = f"SELECT wguid, p_name AS patchname FROM installs WHERE {_MOVED}"
_MOVED_SOFTWARE = f"SELECT wguid, p_type AS packagename, p_brand AS version FROM installs WHERE {_MOVED}"
_MOVED_USAGE = f"""SELECT wguid, p_name AS applicationname FROM installs
  WHERE starttime >= TIMESTAMP '{s.MOVED_FROM}' AND starttime <= TIMESTAMP '{s.MOVED_TO}'"""
_MOVED_CHANGES = f"""SELECT wguid, software, newversion FROM (
  SELECT wguid, p_type AS software, p_brand AS newversion,
         row_number() OVER (PARTITION BY wguid, p_type ORDER BY installdate DESC, p_brand DESC) AS newest
  FROM installs WHERE {_MOVED}) WHERE newest = 1"""
_MIDNIGHT_HEALTH = """
  SELECT c.sensor, w.days, k.rank, k.health_score, count(h.wguid) AS machine_count
  FROM cohort c CROSS JOIN (VALUES (7), (30)) w(days)
  CROSS JOIN (VALUES (1, 'Poor', 0.0, 80.0), (2, 'Fair', 80.0, 90.0), (3, 'Good', 90.0, 97.0), (4, 'Excellent', 97.0, 1e9))
    k(rank, health_score, above, upto)
  LEFT JOIN (SELECT user_id AS wguid, d.days, avg(value * 1.8) AS score FROM events, (VALUES (7), (30)) d(days)
             WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-30' - to_days(d.days) AND ts <= TIMESTAMP '2024-01-31'
             GROUP BY ALL) h
  ON h.wguid = c.wguid AND h.days = w.days AND h.score > k.above AND h.score <= k.upto
  GROUP BY ALL"""
_LOCATION = "city || ',' || country"
_TITLES = """SELECT c.sensor, 'Title ' || CAST(u.c_nationkey AS VARCHAR) AS jobtitle, count(*) AS count
  FROM hosts u JOIN (SELECT c_name FROM orders JOIN customer ON o_custkey = c_custkey) d ON d.c_name = u.c_name
  JOIN cohort c ON c.wguid = u.wguid GROUP BY ALL"""
_FAULTS = _presence("SELECT * FROM faults", ["app"], s.LOW, within=["days"])
_FAULTS_CUT = f"""
  SELECT sensor, days, app, system_percentage FROM (
    SELECT *, row_number() OVER (PARTITION BY sensor, days ORDER BY system_percentage DESC, app) AS position,
           count(CASE WHEN days = 7 THEN 1 END) OVER (PARTITION BY sensor) AS weekly
    FROM ({_FAULTS})) WHERE position <= weekly"""
_HEALTH = """
  SELECT c.sensor, w.days, k.rank, k.health_score, count(h.wguid) AS machine_count
  FROM cohort c CROSS JOIN (VALUES (7), (30)) w(days)
  CROSS JOIN (VALUES (1, 'Poor'), (2, 'Fair'), (3, 'Good'), (4, 'Excellent')) k(rank, health_score)
  LEFT JOIN health h ON h.wguid = c.wguid AND h.days = w.days AND h.health_score = k.health_score
  GROUP BY ALL"""
_ORDER_CHANGES = """
  SELECT sensor, wguid, software, newversion FROM (
    SELECT c.sensor, f.wguid, f.p_type AS software, f.p_brand AS newversion,
           row_number() OVER (PARTITION BY c.sensor, f.wguid, f.p_type ORDER BY installdate DESC, f.p_brand DESC)
             AS newest
    FROM installs f JOIN order_cohort c ON f.wguid = c.wguid
    WHERE f.installdate >= c.date_from AND f.installdate <= c.date_to)
  WHERE newest = 1"""


def _sensors_of(rows: str) -> str:
    """Percentages of rows that already carry their sensor."""
    return f"""
      SELECT sensor, software, newversion, round(100.0 * n / machines, 4) AS system_percentage
      FROM (SELECT sensor, software, newversion, count(*) AS n FROM ({rows}) GROUP BY ALL)
      JOIN (SELECT sensor, count(DISTINCT wguid) AS machines FROM ({rows}) GROUP BY ALL) USING (sensor)
      WHERE 100.0 * n / machines > {s.LOW}"""


def _top(rows: str, k: int, order: str, label: str, short: str) -> str:
    return f"""
      SELECT sensor, rank, {label} AS label, substr({short}, 1, 15) || '...' AS short_label, system_percentage FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY sensor ORDER BY system_percentage DESC, {order}) AS INTEGER)
          AS rank FROM ({rows})) WHERE rank <= {k}"""


def _timeline(rows: str) -> str:
    return f"""
      SELECT sensor, resultdate AS date, count(*) AS count FROM ({rows})
      WHERE isodow(resultdate) <= 5 GROUP BY ALL"""


_PAIRS = """
  SELECT DISTINCT a.wguid, a.resultdate, a.sensor || ':' || b.sensor AS sensor
  FROM severe a JOIN severe b ON a.wguid = b.wguid AND a.resultdate = b.resultdate AND a.sensor < b.sensor"""
_RESULT = "sensor, wguid, systemid AS sensorsystemid, resulttime, resultdate"
_IN_COHORT_RANGE = f"resulttime >= TIMESTAMP '{s.COHORT_FROM}' AND resulttime <= TIMESTAMP '{s.COHORT_TO}'"
_FIRST, _SECOND = s.COMPARED
_ROLLING = ", ".join(
    f"round(CASE WHEN count(y) OVER last{n} = {n} THEN {f}(y) OVER last{n} END, 4) AS {name}_{n}"
    for n in (7, 30)
    for f, name in (("avg", "mean"), ("stddev_samp", "std"))
)
_WIDE = ", ".join(f"min(CASE WHEN sensor = '{e}' THEN anomaly_date END) AS \"{e}\"" for e in s.EVENT_TYPES)
_MATRIX = ", ".join(
    f"nullif(count(CASE WHEN sensor = '{e}' THEN 1 END), 0) AS \"{e}\"" for e in s.EVENT_TYPES
)

_WRITTEN = """
  SELECT DISTINCT a.wguid, a.resultdate, a.sensor || ':' || b.sensor AS sensor
  FROM severe a JOIN severe b ON a.wguid = b.wguid AND a.resultdate = b.resultdate
  WHERE (a.sensor, b.sensor) IN (('view', 'click'), ('click', 'error'))"""


def _report(parts: dict[str, tuple[str, Sequence[str], str]]) -> str:
    """Datasets as rows: name, sensor, the joined columns of a row, its number."""
    rows = []
    for name, (body, columns, number) in parts.items():
        label = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in sorted(columns))
        rows.append(
            f"SELECT '{name}' AS dataset, sensor, {label} AS label, round(CAST(sum({number}) AS DOUBLE), 4) AS value "
            f"FROM ({body}) GROUP BY ALL"
        )
    return " UNION ALL ".join(rows)


_TITLES_CUT = f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY count DESC, jobtitle) AS place
                 FROM ({_TITLES})) WHERE place <= 20"""
_ASSET_COLUMNS = "wguid manufacturer model hostname invoicedt assetlocation loc_remark country".split()
_WHOLE_REPORT = {
    "patches": (_presence(_PATCHES, ["patchname"], 50), ["patchname"], "system_percentage"),
    "controllers": (_presence(_CONTROLLERS, ["controller"], 50), ["controller"], "system_percentage"),
    "software": (_presence(_RECENT_SOFTWARE, ["packagename", "version"], 50), ["packagename", "version"], "system_percentage"),
    "software_changes": (_presence(_CHANGES, ["software", "newversion"], 50), ["software", "newversion"], "system_percentage"),
    "bios": (_presence(_BIOS, ["name", "date"], s.LOW), ["name", "date"], "system_percentage"),
    "app_faults": (_FAULTS, ["app", "days"], "system_percentage"),
    "app_usage": (_presence(_USAGE, ["applicationname"], 50), ["applicationname"], "system_percentage"),
    "manufacture_years": (_counts("year", "CAST(year(invoicedt) AS INTEGER)"), ["year"], "count"),
    "models": (_counts("model", "model"), ["model"], "count"),
    "locations": (_counts("location", _LOCATION), ["location"], "count"),
    "assets": ("SELECT *, 1 AS n FROM asset_rows", _ASSET_COLUMNS, "n"),
    "job_titles": (_TITLES_CUT, ["jobtitle"], "count"),
    "health": (_HEALTH, ["days", "health_score"], "machine_count"),
    "health_members": (
        "SELECT c.sensor, h.days, h.health_score, h.wguid, 1 AS n FROM cohort c JOIN health h ON c.wguid = h.wguid "
        "WHERE h.health_score IS NOT NULL",
        ["days", "health_score", "wguid"],
        "n",
    ),
}



def _forest(smooth: str) -> str:
    """The forest as recursive SQL: every value of a tree walks from node 1, level by level, with the tree's sample."""
    key = "'42:' || tree || '"
    mean_path = "CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} END"
    return f"""WITH RECURSIVE long_series AS (
      SELECT *, count(*) OVER (PARTITION BY sensor) AS n_rows FROM ({smooth})),
    rated AS (
      SELECT sensor, ds, y, trend, row_number() OVER (PARTITION BY sensor ORDER BY ds) - 1 AS place,
             count(*) OVER (PARTITION BY sensor) AS n
      FROM long_series WHERE n_rows >= 14 AND trend IS NOT NULL),
    drawn AS (
      SELECT sensor, tree, place, trend AS v, least(n, 256) AS size,
             row_number() OVER (PARTITION BY sensor, tree ORDER BY
               CASE WHEN n > 256 THEN md5({key}:s' || place || ':' || sensor) END, place) <= 256 AS in_sample
      FROM rated, (SELECT unnest(range(100)) AS tree)),
    walkers AS (
      SELECT sensor, tree, place, v, size, FALSE AS in_sample FROM drawn
      UNION ALL SELECT sensor, tree, place, v, size, TRUE FROM drawn WHERE in_sample),
    steps AS (
      SELECT *, 1 AS node, 0 AS depth FROM walkers
      UNION ALL
      SELECT sensor, tree, place, v, size, in_sample,
             2 * node + CASE WHEN v <= lo + draw * (hi - lo) AND v < hi THEN 0 ELSE 1 END, depth + 1
      FROM (SELECT *, CAST('0x' || substr(md5({key}:n' || node || ':' || sensor), 1, 8) AS BIGINT) / 4294967296.0 AS draw
            FROM (SELECT *, min(CASE WHEN in_sample THEN v END) OVER w AS lo, max(CASE WHEN in_sample THEN v END) OVER w AS hi
                  FROM steps WINDOW w AS (PARTITION BY sensor, tree, node)))
      WHERE lo < hi AND depth < ceil(log2(greatest(size, 2)))),
    leaves AS (SELECT sensor, tree, place, size, max(depth) AS depth, arg_max(node, depth) AS node
               FROM steps WHERE NOT in_sample GROUP BY ALL),
    held AS (SELECT sensor, tree, node, count(*) AS n FROM steps WHERE in_sample GROUP BY ALL),
    paths AS (SELECT l.sensor, place, size, l.depth + {mean_path.format(n="coalesce(h.n, 0)")} AS path
              FROM leaves l LEFT JOIN held h ON h.sensor = l.sensor AND h.tree = l.tree AND h.node = l.node),
    scores AS (SELECT sensor, place,
                      -round(pow(2.0, -(sum(path) / 100) / greatest({mean_path.format(n="any_value(size)")}, 1.0)), 9) AS normality
               FROM paths GROUP BY sensor, place),
    limits AS (SELECT sensor, quantile_cont(normality, 0.1) AS least FROM scores GROUP BY sensor)
    SELECT s.sensor, s.ds, CAST(s.y AS BIGINT) AS y, round(s.trend, 4) AS trend, coalesce(normality < least, FALSE) AS is_anomaly
    FROM long_series s LEFT JOIN rated r ON r.sensor = s.sensor AND r.ds = s.ds
    LEFT JOIN scores c ON c.sensor = r.sensor AND c.place = r.place LEFT JOIN limits l ON l.sensor = s.sensor
    WHERE s.n_rows >= 14"""


_ORDER_SMOOTH = """SELECT sensor, ds, y, CASE WHEN count(y) OVER around = 7 THEN avg(y) OVER around END AS trend
  FROM order_series
  WINDOW around AS (PARTITION BY sensor ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""

_QUERIES = {
    "trend_anomalies": _forest("SELECT sensor, ds, y, trend FROM smooth"),
    "trend_anomalies_yearly": _forest(_ORDER_SMOOTH),
    "whole_report": _report(_WHOLE_REPORT),
    "uploaded_report": _report(_WHOLE_REPORT),
    "cosensor_frequent": f"""
        WITH both_kinds AS (SELECT wguid, sensor FROM severe UNION SELECT wguid, sensor FROM derived)
        SELECT a.sensor || ':' || b.sensor AS sensor, count(*) AS groups
        FROM both_kinds a JOIN both_kinds b ON a.wguid = b.wguid AND a.sensor < b.sensor
        GROUP BY ALL HAVING count(*) >= {s.SHARED}""",
    "cosensor_frequent_results": f"""
        SELECT * FROM ({_PAIRS}) p WHERE sensor IN (SELECT sensor FROM ({_PAIRS}) GROUP BY sensor HAVING count(*) >= {s.SHARED})""",
    "cosensor_as_written": _WRITTEN,
    "sensor_breakdown_sorted": "SELECT sensor, count(*) AS count FROM uploaded_results GROUP BY sensor",
    "presence_threshold_edge": _presence(_BIOS, ["name", "date"], 7),
    "drilldown_ranged": _presence(
        _ALL_PATCHES,
        ["patchname"],
        s.LOW,
        cohort="(SELECT * FROM order_cohort WHERE wguid IN (SELECT h.wguid FROM hosts h JOIN assets a "
        "ON a.hostname = h.hostname WHERE h.model = 'MACHINERY'))",
        condition=_OWN_RANGE,
    ),
    "sensor_timeline": _timeline("SELECT * FROM results"),
    "timeline_labels": f"""
        SELECT sensor, date, count, strftime(date, '%b %d %Y') AS label FROM ({_timeline("SELECT * FROM results")})""",
    "sensor_cohort": f"""SELECT {_RESULT} FROM results
        WHERE sensor IN ('error', 'click', 'purchase') AND {_IN_COHORT_RANGE}""",
    "severe_results": f"""SELECT {_RESULT} FROM severe
        WHERE sensor IN ('error', 'click', 'view') AND {_IN_COHORT_RANGE}""",
    "cohort_machines": "SELECT sensor, count(*) AS machines FROM cohort GROUP BY sensor",
    "cosensor_pairs": _PAIRS,
    "cosensor_timeline": _timeline(_PAIRS),
    "anomaly_day_cohort": "SELECT DISTINCT sensor, wguid FROM bad_results",
    "anomaly_day_timeline": _timeline("SELECT * FROM bad_results"),
    "machine_sensor_timeline": _timeline("SELECT * FROM uploaded_results"),
    "machine_sensor_breakdown": "SELECT sensor, count(*) AS count FROM uploaded_results GROUP BY sensor",
    "machine_lookup": "SELECT wguid, name FROM uploaded",
    "machine_lookup_user": f"""
        SELECT wguid, '{USER_PREFIX}' || c_name AS name FROM hosts
        WHERE substr(c_name, 10, 9) IN (SELECT substr(s_name, 10, 9) FROM supplier)""",
    "silent_sensors": """
        SELECT DISTINCT sensor FROM (SELECT sensor FROM results UNION SELECT sensor FROM derived)
        WHERE sensor NOT IN (SELECT sensor FROM cohort)""",
    "sensor_descriptions": """
        SELECT s.sensor, d.r_name AS description
        FROM (SELECT DISTINCT coalesce(n_name, sensor) AS sensor
              FROM results LEFT JOIN nation ON sensorid = CAST(n_nationkey AS VARCHAR)) s
        LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) d
        ON d.n_name = s.sensor""",
    "export_system_ids": f"""
        SELECT systemid AS sensorsystemid, sensor, resulttime AS date FROM results WHERE {_IN_COHORT_RANGE}""",
    "export_last_week": f"SELECT {_RESULT} FROM results WHERE resulttime >= TIMESTAMP '2024-01-23'",
    "patch_presence": _presence(_PATCHES, ["patchname"], 50),
    "controller_presence": _presence(_CONTROLLERS, ["controller"], 50),
    "software_presence": _presence(_RECENT_SOFTWARE, ["packagename", "version"], s.LOW),
    "software_change_presence": _presence(_CHANGES, ["software", "newversion"], 1),
    "bios_presence": _presence(_BIOS, ["name", "date"], s.LOW),
    "app_fault_presence": _FAULTS_CUT,
    "app_fault_presence_whole": _FAULTS,
    "app_usage_presence": _presence(_USAGE, ["applicationname"], 20),
    "presence_machines": _presence(_PATCHES, ["patchname"], 20, mode="machines"),
    "presence_all_sensors": _presence(
        _ALL_PATCHES, ["patchname"], 0, cohort="(SELECT DISTINCT sensor, wguid FROM results)"
    ),
    "presence_sorted": _presence(_SOFTWARE, ["packagename", "version"], s.LOW),
    "presence_top15": _top(
        _presence(_SOFTWARE, ["packagename", "version"], s.LOW),
        15,
        "packagename, version",
        "packagename || ' ' || version",
        "packagename",
    ),
    "presence_top3": _top(
        _presence(_BIOS, ["name", "date"], s.LOW),
        3,
        "name, date",
        "name || '_' || CAST(date AS VARCHAR)",
        "name || '_' || CAST(date AS VARCHAR)",
    ),
    "fault_window_compare": f"""
        SELECT sensor, CASE WHEN days = 7 THEN 'Last 7 Days' ELSE 'Last 30 days' END AS type, app AS label,
               substr(app, 1, 8) || '...' AS short_label, system_percentage AS value FROM ({_FAULTS_CUT})""",
    "drilldown_model": _presence(
        _PATCHES,
        ["patchname"],
        50,
        cohort="(SELECT DISTINCT sensor, wguid FROM asset_rows WHERE model = 'MACHINERY')",
    ),
    "drilldown_year": _presence(
        _CONTROLLERS,
        ["controller"],
        50,
        cohort="(SELECT DISTINCT sensor, wguid FROM asset_rows WHERE year(invoicedt) = 1998)",
    ),
    "asset_info": """
        SELECT sensor, wguid, manufacturer, model, hostname, invoicedt, assetlocation, loc_remark, country
        FROM asset_rows""",
    "year_counts": _counts("year", "CAST(year(invoicedt) AS INTEGER)"),
    "model_counts": _counts("model", "model"),
    "location_counts": _counts("location", _LOCATION),
    "title_top20": f"""
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sensor ORDER BY count DESC, jobtitle) AS INTEGER)
          AS rank FROM ({_TITLES})) WHERE rank <= 20""",
    "share_with_other": f"""
        WITH shares AS (SELECT sensor, location, count, sum(count) OVER (PARTITION BY sensor) AS total
                        FROM ({_counts("location", _LOCATION)}))
        SELECT sensor, location AS label, CAST(count AS BIGINT) AS value FROM shares WHERE count >= 0.05 * total
        UNION ALL
        SELECT sensor, 'Other' AS label, CAST(coalesce(sum(CASE WHEN count < 0.05 * total THEN count END), 0) AS BIGINT)
        FROM shares GROUP BY sensor""",
    "moved_patches": _presence(_MOVED_PATCHES, ["patchname"], s.LOW),
    "moved_software": _presence(_MOVED_SOFTWARE, ["packagename", "version"], 1),
    "moved_usage": _presence(_MOVED_USAGE, ["applicationname"], s.LOW, mode="machines"),
    "merged_changes": _presence(_MOVED_CHANGES, ["software", "newversion"], 1),
    "merged_health": _MIDNIGHT_HEALTH,
    "health_summary": _HEALTH,
    "health_members": """
        SELECT c.sensor, h.days, h.health_score, h.wguid FROM cohort c JOIN health h ON c.wguid = h.wguid
        WHERE h.health_score IS NOT NULL""",
    "health_two_windows": f"""
        SELECT sensor, CASE WHEN days = 7 THEN 'Last 7 Days' ELSE 'Last 30 days' END AS type,
               health_score AS label, machine_count AS value FROM ({_HEALTH})""",
    "compare_machines": f"""
        SELECT kind, item, CASE WHEN n = 2 THEN 'both' WHEN one = {_FIRST} THEN 'first' ELSE 'second' END AS side
        FROM (SELECT kind, item, count(DISTINCT wguid) AS n, min(wguid) AS one FROM items
              WHERE wguid IN ({_FIRST}, {_SECOND}) GROUP BY kind, item)""",
    "item_matrix": f"""
        SELECT wguid, {_MATRIX} FROM results
        WHERE resulttime > TIMESTAMP '{s.COMPARE_FROM}' AND resulttime <= TIMESTAMP '{s.COMPARE_TO}' GROUP BY wguid""",
    "sensor_enriched": """
        SELECT wguid, systemid, sensor, severity, resulttime, instancevalue, sconfig_systemid,
               round(memory_1e7, 4) AS memory_1e7, model, sensorcategory, description FROM wide_rows""",
    "enriched_series": "SELECT sensor, CAST(resulttime AS DATE) AS ds, count(*) AS y FROM wide_rows GROUP BY ALL",
    "daily_series": "SELECT sensor, ds, y FROM series",
    "series_all_days": """
        SELECT d.sensor, d.ds, coalesce(o.y, 0) AS y
        FROM (SELECT sensor, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds
              FROM (SELECT sensor, min(ds) AS lo, max(ds) AS hi FROM order_series GROUP BY sensor)) d
        LEFT JOIN order_series o ON o.sensor = d.sensor AND o.ds = d.ds""",
    "series_slice": f"""
        SELECT sensor, ds, y FROM series WHERE ds >= DATE '{s.COHORT_FROM}' AND ds <= DATE '{s.COHORT_TO}'""",
    "trend": "SELECT sensor, ds, y, round(trend, 4) AS trend FROM smooth",
    "decompose": """
        WITH phases AS (SELECT sensor, position % 7 AS phase, avg(y - trend) AS effect FROM smooth GROUP BY ALL),
        levels AS (SELECT sensor, avg(effect) AS level FROM phases GROUP BY sensor)
        SELECT m.sensor, ds, y, round(trend, 4) AS trend, round(effect - level, 4) AS seasonal,
               round(y - trend - (effect - level), 4) AS residual
        FROM smooth m JOIN phases p ON m.sensor = p.sensor AND m.position % 7 = p.phase
        JOIN levels l ON l.sensor = m.sensor""",
    "rolling_stats": f"""
        SELECT sensor, ds, y, {_ROLLING} FROM series
        WINDOW last7 AS (PARTITION BY sensor ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
               last30 AS (PARTITION BY sensor ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "sigma_band": """
        SELECT sensor, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std,
               round(greatest(avg(y) - 3 * stddev_samp(y), 0), 4) AS lower,
               round(avg(y) + 3 * stddev_samp(y), 4) AS upper FROM series GROUP BY sensor""",
    "sigma_anomalies": "SELECT sensor, ds, y, round(trend, 4) AS trend, is_anomaly FROM points",
    "anomaly_bounds": """
        SELECT sensor, min(anomaly_date) AS first_date, max(anomaly_date) AS last_date FROM bad_days GROUP BY sensor""",
    "anomaly_days_wide": f"""
        SELECT position, {_WIDE} FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY sensor ORDER BY anomaly_date) AS INTEGER) AS position
          FROM bad_days) GROUP BY position""",
    "snapshot_change": """
        WITH sums AS (
          SELECT sensor, coalesce(sum(CASE WHEN ds >= DATE '2024-01-21' THEN trend END), 0) AS now_sum,
                 coalesce(sum(CASE WHEN ds >= DATE '2024-01-14' AND ds < DATE '2024-01-21' THEN trend END), 0) AS before
          FROM points WHERE is_anomaly GROUP BY sensor),
        changes AS (
          SELECT sensor, CAST(round_even(now_sum, 0) AS BIGINT) AS trend_sum,
                 CAST(CASE WHEN before = 0 AND now_sum <> 0 THEN 100 WHEN before = 0 THEN NULL
                           ELSE round_even((now_sum - before) / before * 100, 0) END AS BIGINT) AS pct_change
          FROM sums)
        SELECT *, CAST(row_number() OVER (ORDER BY pct_change DESC NULLS LAST, sensor) AS INTEGER) AS rank
        FROM changes""",
    "anomaly_report_patches": _presence(
        _ALL_PATCHES, ["patchname"], s.LOW, cohort="order_cohort", condition=_OWN_RANGE
    ),
    "anomaly_report_patch_machines": _presence(
        _ALL_PATCHES, ["patchname"], s.LOW, mode="machines", cohort="order_cohort", condition=_OWN_RANGE
    ),
    "anomaly_report_changes": _sensors_of(_ORDER_CHANGES),
    "anomaly_report_usage": _presence(
        "SELECT wguid, p_name AS applicationname, starttime AS installdate FROM installs",
        ["applicationname"],
        s.LOW,
        mode="machines",
        cohort="order_cohort",
        condition=_OWN_RANGE,
    ),
}


def oracle_sql() -> dict[str, str]:
    found = {name: _with_common(body.strip()) for name, body in _QUERIES.items()}
    return found | {"uploaded_report": found["uploaded_report"].replace(_COHORT, _LISTED)}


def _with_common(body: str) -> str:
    """A query with tables of its own adds them to the common WITH list."""
    common = _COMMON.rstrip()
    if body.startswith("WITH RECURSIVE"):
        common = common.replace("WITH", "WITH RECURSIVE", 1)
    own = body.removeprefix("WITH RECURSIVE").removeprefix("WITH")
    return f"{common}{',' if own != body else ''}\n{own}"
