"""DuckDB statements that give the same rows as the queries, in their plain, unoptimised form: range
joins, self joins and all-pairs conditions where the plans use equi joins."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-02-01 12:00:00'"

# name -> (tables it needs, body)
_PARTS: dict[str, tuple[str, str]] = {
    "limits": (
        "",
        """SELECT * FROM (VALUES
            ('urban', 70::DOUBLE, 85::DOUBLE, 50::DOUBLE),
            ('suburban', 65::DOUBLE, 80::DOUBLE, 60::DOUBLE),
            ('rural', 60::DOUBLE, 75::DOUBLE, 80::DOUBLE)) v(cell_type, warn, crit, slow)""",
    ),
    "towers": (
        "",
        """SELECT s_suppkey::VARCHAR AS tower_id, s_suppkey AS k,
            ['LTE','UMTS','GSM'][s_suppkey % 3 + 1] AS radio, 510 AS mcc,
            [1,8,11,21][s_suppkey % 4 + 1] AS mnc, (s_suppkey % 100)::INT AS area, s_suppkey AS cell,
            106::DOUBLE + floor(s_suppkey / 10) * 0.01::DOUBLE AS lon,
            -6::DOUBLE + (s_suppkey % 10) * 0.01::DOUBLE AS lat,
            (s_suppkey * 100 % 9000)::INT AS range_m, (s_suppkey % 40)::INT AS samples, 1 AS changeable,
            CASE WHEN s_acctbal < 1500 THEN 'urban' WHEN s_acctbal <= 6000 THEN 'suburban' ELSE 'rural' END
                AS cell_type,
            n_name AS province_name, r_name AS island_group
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    ),
    "readings": (
        "towers",
        """SELECT tower_id, event_hour, eid, prb, (40 + eid % 21)::DOUBLE AS thr, (5 + eid % 60)::DOUBLE AS lat_ms,
            (eid % 50)::DOUBLE / 10 AS dropped, (eid % 40)::INT AS handovers, (1 + eid % 97)::INT AS subs,
            prb > 100 AS fault, event_hour::DATE AS part
        FROM (SELECT user_id::VARCHAR AS tower_id, date_trunc('hour', ts) AS event_hour,
                min(event_id) AS eid, arg_min(value, event_id) AS prb
              FROM events GROUP BY ALL)
        WHERE tower_id IN (SELECT tower_id FROM towers)""",
    ),
    "raw_sessions": (
        "",
        """SELECT event_id, (event_id % 2000)::VARCHAR AS sub,
            (user_id + event_id % 2)::VARCHAR AS tower_id, ts AS s_start,
            ts + to_minutes(floor(value)::BIGINT) AS s_end, value AS mins,
            CASE event_type WHEN 'error' THEN 'SMS' WHEN 'signup' THEN 'voice' ELSE 'data' END AS service,
            event_id * 1000 AS bytes
        FROM events""",
    ),
    "sessions": (
        "raw_sessions towers",
        """SELECT * FROM raw_sessions WHERE tower_id IN (SELECT tower_id FROM towers)
            AND sub IN (SELECT c_custkey::VARCHAR FROM customer)""",
    ),
    "dirty_readings": (
        "",
        """SELECT event_id, CASE WHEN event_id % 89 <> 0 THEN user_id::VARCHAR END AS tower_id,
            CASE WHEN event_id % 101 = 0 THEN 'not a time'
                ELSE strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') END AS event_hour,
            CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE value::VARCHAR END AS prb,
            CASE WHEN event_id % 83 <> 0 THEN CASE WHEN event_id % 211 = 0 THEN 3000000000 ELSE event_id % 40 END END
                AS handovers, (1 + event_id % 97)::INT AS subs,
            (5 + event_id % 60)::DOUBLE AS lat_ms, (event_id % 50)::DOUBLE / 10 AS dropped,
            (40 + event_id % 21)::DOUBLE AS thr
        FROM events""",
    ),
    "read_dirty": (
        "dirty_readings towers",
        """SELECT tower_id, try_cast(event_hour AS TIMESTAMP) AS event_hour, try_cast(prb AS DOUBLE) AS prb, thr,
            lat_ms, dropped, coalesce(handovers, 0)::INT AS handovers, subs
        FROM dirty_readings
        WHERE tower_id IN (SELECT tower_id FROM towers) AND try_cast(event_hour AS TIMESTAMP) IS NOT NULL
            AND coalesce(handovers, 0) <= 2147483647""",
    ),
    "dirty_sessions": (
        "raw_sessions",
        """SELECT * EXCLUDE (event_id)
            REPLACE (bytes + CASE WHEN event_id % 73 = 0 THEN 9007199254740993 ELSE 0 END AS bytes) FROM (
            SELECT event_id, sub, tower_id, s_start, s_end, mins, service, bytes FROM raw_sessions
            UNION ALL
            SELECT event_id, sub, tower_id, s_start, CASE WHEN event_id % 20 <> 0 THEN s_end END, mins + 1,
                CASE WHEN event_id % 30 <> 0 THEN 'voice' END, bytes
            FROM raw_sessions WHERE event_id % 10 = 0)""",
    ),
    "earlier": (
        "towers",
        """SELECT k + 1 AS alert_id, tower_id,
            CASE WHEN k % 3 = 2 THEN 'PATTERN' WHEN k % 2 = 0 THEN 'CRITICAL' ELSE 'WARN' END AS alert_type,
            CASE WHEN k % 3 = 2 THEN 'PEAK_HOUR' ELSE 'HOTSPOT' END AS alert_category,
            CASE WHEN k % 3 <> 2 AND k % 2 = 0 THEN 3 ELSE 2 END AS severity,
            'Earlier alert ' || tower_id AS message,
            TIMESTAMP '2024-01-05' + to_hours(k % 10) AS triggered_at,
            CASE WHEN k % 3 = 1 THEN TIMESTAMP '2024-01-06' + to_hours(k % 10) END AS resolved_at,
            CASE WHEN k % 3 = 1 THEN 'RESOLVED' ELSE 'ACTIVE' END AS status
        FROM towers""",
    ),
    "scored": (
        "readings towers limits",
        """SELECT r.*, l.warn, l.crit,
            CASE WHEN prb >= crit THEN 'CRITICAL' WHEN prb >= warn THEN 'WARN' END AS severity,
            greatest(0::DOUBLE, least(100::DOUBLE,
                100 - greatest(0::DOUBLE, (prb - warn) * 1.5::DOUBLE) - lat_ms / 10 - dropped * 10)) AS health
        FROM readings r JOIN towers USING (tower_id) JOIN limits l USING (cell_type)
        WHERE NOT fault""",
    ),
    "ev": ("scored", "SELECT tower_id, event_hour, prb, warn, crit, severity FROM scored WHERE severity IS NOT NULL"),
    "hot": (
        "readings ev",
        """SELECT tower_id,
            coalesce(100 * (count(DISTINCT e.event_hour) FILTER (d >= newest - 7))::DOUBLE
                / nullif(count(DISTINCT t.event_hour) FILTER (d >= newest - 7), 0), 0) AS f7,
            coalesce(100 * (count(DISTINCT e.event_hour) FILTER (d >= newest - 30))::DOUBLE
                / nullif(count(DISTINCT t.event_hour) FILTER (d >= newest - 30), 0), 0) AS f30,
            coalesce(avg(t.prb), 0) AS mean_prb,
            mode() WITHIN GROUP (ORDER BY hour(e.event_hour)) AS peak,
            count(DISTINCT e.event_hour) AS hours
        FROM (SELECT *, event_hour::DATE AS d, max(event_hour::DATE) OVER () AS newest FROM readings WHERE NOT fault) t
        LEFT JOIN ev e USING (tower_id, event_hour)
        GROUP BY tower_id""",
    ),
    "peaks": (
        "scored readings",
        """SELECT tower_id, hour(event_hour)::INT AS h, avg(prb) AS mean_prb,
            100 * avg((prb >= warn)::INT) AS rate, count(*) FILTER (prb >= warn) AS days
        FROM scored WHERE event_hour::DATE >= (SELECT max(part) FROM readings) - 30 GROUP BY ALL""",
    ),
    "health": (
        "scored readings",
        """SELECT tower_id, round(avg(health)::DECIMAL(18,9), 1)::DOUBLE AS score, max(subs) AS subs
        FROM scored WHERE part = (SELECT max(part) FROM readings) GROUP BY tower_id""",
    ),
    "ev_later": ("ev", "SELECT * REPLACE (event_hour + INTERVAL 30 MINUTE AS event_hour) FROM ev"),
    "impact": (
        "ev sessions",
        """SELECT tower_id, event_hour, severity, count(DISTINCT sub) AS subs, sum(mins) AS minutes,
            count(DISTINCT sub) FILTER (service = 'voice') AS voice,
            count(DISTINCT sub) FILTER (service = 'data') AS data,
            count(DISTINCT sub) FILTER (service = 'SMS') AS sms
        FROM ev LEFT JOIN sessions s USING (tower_id)
        WHERE s.sub IS NULL OR (s_start <= event_hour + INTERVAL 1 HOUR AND s_end >= event_hour)
        GROUP BY ALL
        UNION ALL
        SELECT tower_id, event_hour, severity, 0, NULL, 0, 0, 0 FROM ev
        WHERE tower_id IN (SELECT tower_id FROM sessions) AND NOT EXISTS (
            SELECT 1 FROM sessions s WHERE s.tower_id = ev.tower_id
                AND s_start <= event_hour + INTERVAL 1 HOUR AND s_end >= event_hour)""",
    ),
    "near": (
        "towers",
        """SELECT a.tower_id AS src, b.tower_id AS nb,
            6371000 * acos(least(1::DOUBLE, greatest(-1::DOUBLE,
                cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon) - radians(a.lon))
                + sin(radians(a.lat)) * sin(radians(b.lat))))) AS metres
        FROM towers a, towers b WHERE a.k <> b.k AND metres < 3000""",
    ),
    "spill": (
        "ev readings near",
        """SELECT src, nb, s.handovers AS sh, n.handovers AS nh
        FROM near JOIN ev e ON e.tower_id = src
            JOIN readings s ON s.tower_id = src AND s.event_hour = e.event_hour AND NOT s.fault
            JOIN readings n ON n.tower_id = nb AND n.event_hour = e.event_hour AND NOT n.fault
        WHERE n.handovers > 1.5 * s.handovers GROUP BY ALL""",
    ),
    "cells": (
        "",
        """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'LTE' WHEN '4-NOT SPECIFIED' THEN 'LTE'
                WHEN '2-HIGH' THEN 'UMTS' WHEN '3-MEDIUM' THEN 'GSM' ELSE 'CDMA' END AS radio,
            CASE WHEN o_orderkey % 7 = 0 THEN 404 ELSE 510 END AS mcc, [1,8,11,21,89][o_custkey % 5 + 1] AS net,
            (o_custkey % 50)::INT AS area, o_custkey * 3 + o_orderkey % 3 AS cell, 0 AS unit,
            106::DOUBLE + (o_orderkey * 7919 % 100003) / 20000.6::DOUBLE AS lon,
            CASE WHEN o_orderkey % 29 <> 0 THEN -9::DOUBLE + (o_orderkey * 104729 % 100019) / 20003.8::DOUBLE END AS lat,
            CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 50)::INT END AS "range",
            (o_orderkey % 6)::INT AS samples, 1 AS changeable, 1600000000::BIGINT AS created,
            CASE WHEN o_orderkey % 13 <> 0 THEN epoch(o_orderdate)::BIGINT + o_orderkey % 86400 END AS updated,
            -85 AS "averageSignal"
        FROM orders""",
    ),
    "chosen": ("cells", "SELECT * FROM cells WHERE mcc = 510 AND samples >= 2 AND lat IS NOT NULL"),
    "newest": (
        "chosen",
        """SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY radio, mcc, net, area, cell ORDER BY
            updated DESC NULLS LAST, unit, lon, lat, "range" NULLS FIRST, samples, changeable, created) = 1""",
    ),
    "corners": (
        "",
        """SELECT n_nationkey AS n, CASE n_nationkey WHEN 0 THEN 'Aceh' WHEN 1 THEN 'Bali' WHEN 2 THEN 'Banten'
                WHEN 3 THEN 'Papua' ELSE n_name END AS name, part, pos, 106::DOUBLE + n_nationkey % 5 + dx AS x,
            -9::DOUBLE + floor(n_nationkey / 5) + dy AS y
        FROM nation JOIN (VALUES
            (0, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE), (0, 0, 1, 1, 0), (0, 0, 2, 0.5, 0.875), (0, 0, 3, 0, 0),
            (1, 0, 0, 0, 0), (1, 0, 1, 1, 0), (1, 0, 2, 1, 0.25), (1, 0, 3, 0.25, 0.25), (1, 0, 4, 0.25, 1),
            (1, 0, 5, 0, 1), (1, 0, 6, 0, 0),
            (2, 0, 0, 0, 0), (2, 0, 1, 1, 0), (2, 0, 2, 1, 1), (2, 0, 3, 0, 1), (2, 0, 4, 0, 0),
            (2, 1, 0, 0.25, 0.25), (2, 1, 1, 0.75, 0.25), (2, 1, 2, 0.75, 0.75), (2, 1, 3, 0.25, 0.75),
            (2, 1, 4, 0.25, 0.25)) v(shape, part, pos, dx, dy) ON shape = n_nationkey % 3""",
    ),
    "tagged": (
        "newest corners",
        """SELECT c.*, (SELECT min(name) FROM (SELECT name FROM (
                SELECT name, (y1 > c.lat) <> (y2 > c.lat) AND c.lon < (x2 - x1) * (c.lat - y1) / (y2 - y1) + x1 AS cut,
                    (x2 - x1) * (c.lat - y1) = (c.lon - x1) * (y2 - y1) AND c.lon BETWEEN least(x1, x2)
                        AND greatest(x1, x2) AND c.lat BETWEEN least(y1, y2) AND greatest(y1, y2) AS touched
                FROM (SELECT name, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
                    FROM corners WINDOW w AS (PARTITION BY n, part ORDER BY pos)) WHERE x2 IS NOT NULL)
            GROUP BY name HAVING count(*) FILTER (cut) % 2 = 1 AND count(*) FILTER (touched) = 0)) AS province
        FROM newest c""",
    ),
    "placed": (
        "tagged",
        """SELECT *, CASE province WHEN 'Aceh' THEN 'Sumatera' WHEN 'Bali' THEN 'Bali Nusa' WHEN 'Banten' THEN 'Jawa'
            WHEN 'Papua' THEN 'Papua' END AS island FROM tagged""",
    ),
    "draw": (
        "newest chosen",
        """SELECT radio, mcc, net, area, cell, CASE WHEN radio IN ('LTE','UMTS','GSM')
                AND (net IN (1,8,11,21)
                    OR (SELECT count(*) FROM chosen c WHERE c.radio = newest.radio AND c.net IN (1,8,11,21)) < {third})
                THEN 0 ELSE 1 END AS prio,
            sha256(concat_ws('|', radio, mcc, net, area, cell, '{seed}')) AS digest
        FROM newest""",
    ),
}


def _with(names: str, body: str, **fill: str) -> str:
    """Statement with the common tables it needs, each after the ones it rests on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _PARTS[name][0].split():
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)

    def text(name: str) -> str:
        sql = _PARTS[name][1]
        for key, value in fill.items():
            sql = sql.replace("{" + key + "}", value)
        return sql

    return "WITH " + ",\n".join(f"{n} AS ({text(n)})" for n in ordered) + "\n" + body


_HALF_UP = "round(({0})::DECIMAL(18,9), 1)::DOUBLE"
# Tenths, a tie going to the even one.
_EVEN = """(list_transform([({0})::DECIMAL(18,9) * 10], lambda t: CASE WHEN t - floor(t) = 0.5
    THEN floor(t) + floor(t) % 2 ELSE round(t, 0) END)[1]::DOUBLE / 10)"""

_READING_COLUMNS = """tower_id, event_hour, round(({prb})::DECIMAL(28,9), 6)::DOUBLE AS prb_utilization, thr AS throughput_mbps,
    lat_ms AS latency_ms, dropped AS dropped_call_rate, handovers AS handover_count, subs AS connected_subscribers,
    {fault} AS is_sensor_fault, event_hour::DATE AS partition_date"""
_CLEAN_READINGS = "SELECT " + _READING_COLUMNS.format(prb="prb", fault="fault") + " FROM readings"


def _tower_map(window: str) -> str:
    return f"""SELECT t.tower_id, t.lat, t.lon, radio, mnc, cell_type, province_name, island_group,
        {_HALF_UP.format('avg(health)')} AS health_score, max(subs) AS connected_subscribers,
        {_HALF_UP.format('avg(prb)')} AS avg_prb_utilization
    FROM towers t LEFT JOIN (SELECT * FROM scored
        WHERE event_hour >= (SELECT max(event_hour) FROM readings) - INTERVAL {window}) s USING (tower_id)
    GROUP BY ALL"""


def _hotspot_board(column: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {column} DESC, tower_id)::INT AS rank, tower_id,
        province_name AS province, cell_type, radio, {_EVEN.format(column)} AS congestion_frequency_pct,
        {_EVEN.format('mean_prb')} AS avg_prb_pct, peak::INT AS peak_congestion_hour,
        hours AS affected_subscriber_hours
    FROM hot JOIN towers USING (tower_id) QUALIFY rank <= 20"""


def _province_board(column: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY mean DESC, province_name)::INT AS rank, * EXCLUDE (mean)
    FROM (SELECT province_name, avg({column})::DECIMAL(28,9) AS mean, max(island_group) AS island_group,
            {_HALF_UP.format(f'avg({column})')} AS avg_congestion_frequency_pct, count(*) AS tower_count,
            count(*) FILTER ({column} > 0) AS congested_towers,
            {_HALF_UP.format(f'(count(*) FILTER ({column} > 0))::DOUBLE / count(*) * 100')} AS congestion_rate_pct,
            {_HALF_UP.format('avg(score)')} AS avg_health_score,
            coalesce(sum(hours) FILTER ({column} > 0), 0)::BIGINT AS affected_subscriber_hours
        FROM towers LEFT JOIN hot USING (tower_id) LEFT JOIN health USING (tower_id)
        GROUP BY province_name HAVING count(*) FILTER ({column} > 0) > 0)"""


def _hotspot_alerts(warn: float, critical: float) -> str:
    return f"""SELECT tower_id, CASE WHEN f7 >= {critical} THEN 'CRITICAL' ELSE 'WARN' END AS alert_type,
        'HOTSPOT' AS alert_category, CASE WHEN f7 >= {critical} THEN 3 ELSE 2 END AS severity,
        'Tower ' || tower_id || ' congestion frequency ' || round(f7::DECIMAL(18,9), 1)::DECIMAL(18,1)
            || '% over 7 days' AS message,
        {NOW} AS triggered_at, 'ACTIVE' AS status
    FROM hot WHERE f7 >= {warn} AND tower_id NOT IN (
        SELECT tower_id FROM earlier WHERE alert_category = 'HOTSPOT' AND status = 'ACTIVE')"""


def _peak_alerts(rate: float, days: int) -> str:
    return f"""SELECT tower_id, 'PATTERN' AS alert_type, 'PEAK_HOUR' AS alert_category, 2 AS severity,
        'Tower ' || tower_id || ' peak congestion at hour ' || h AS message, {NOW} AS triggered_at, 'ACTIVE' AS status
    FROM peaks WHERE rate >= {rate} AND days >= {days} AND tower_id NOT IN (
        SELECT tower_id FROM earlier WHERE alert_category = 'PEAK_HOUR' AND status = 'ACTIVE')"""


_NEIGHBOUR_ALERTS = f"""SELECT nb AS tower_id, 'SPILLOVER' AS alert_type, 'NEIGHBOUR' AS alert_category,
    2 AS severity, 'Spillover detected from congested tower ' || src AS message, {NOW} AS triggered_at,
    'ACTIVE' AS status
FROM spill WHERE nb NOT IN (
    SELECT tower_id FROM earlier WHERE alert_category = 'NEIGHBOUR' AND status = 'ACTIVE')"""

_EXPIRE = f"""SELECT alert_id, tower_id, alert_type, alert_category, severity, message, triggered_at,
    CASE WHEN gone THEN {NOW} ELSE resolved_at END AS resolved_at,
    CASE WHEN gone THEN 'RESOLVED' ELSE status END AS status
FROM (SELECT *, status = 'ACTIVE' AND alert_category = 'HOTSPOT'
    AND tower_id NOT IN (SELECT tower_id FROM hot WHERE f7 >= 10) AS gone FROM {{source}})"""

_NEW_IDS = """SELECT ('0x' || substr(sha256(concat_ws('|', tower_id, alert_category, message,
        strftime(triggered_at, '%Y-%m-%d %H:%M:%S.%f'),
        row_number() OVER (PARTITION BY tower_id, alert_category, message))), 1, 15))::BIGINT AS alert_id,
    tower_id, alert_type, alert_category, severity, message, triggered_at, NULL::TIMESTAMP AS resolved_at, status
FROM fresh"""

_GRID = ", ".join(f"round((avg(prb) FILTER (hour(event_hour) = {h}))::DECIMAL(28,9), 6)::DOUBLE AS h{h:02d}" for h in range(24))

_IMPACT_ROWS = """tower_id, event_hour, severity, subs AS subscriber_count_affected,
    round(minutes::DECIMAL(28,9), 6)::DOUBLE AS degraded_session_minutes, voice AS voice_sessions, data AS data_sessions,
    sms AS sms_sessions"""

_CELL_KEY = "radio, mcc, net, area, cell"

ORACLE: dict[str, str] = {
    "cell_csv_roundtrip": _with(
        "cells", 'SELECT * REPLACE (round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon, round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat) FROM cells'
    ),
    "telemetry_lake_roundtrip": _with("readings", _CLEAN_READINGS),
    "province_geojson_bounds": _with(
        "corners",
        """SELECT name AS province_name, min(x) AS min_lon, max(x) AS max_lon, min(y) AS min_lat, max(y) AS max_lat,
            (min(x) + max(x)) / 2 AS center_lon, (min(y) + max(y)) / 2 AS center_lat FROM corners GROUP BY name""",
    ),
    "partition_volume": _with("readings", "SELECT part AS partition_date, count(*) AS row_count FROM readings GROUP BY 1"),
    "staged_telemetry_view": _with("readings", _CLEAN_READINGS),
    "staged_sessions_view": _with(
        "sessions",
        """SELECT sub AS subscriber_id, tower_id, s_start AS session_start, s_end AS session_end,
            round(mins::DECIMAL(28,9), 6)::DOUBLE AS session_duration_min, service AS service_type, bytes AS bytes_transferred,
            s_start::DATE AS partition_date FROM sessions""",
    ),
    "telemetry_clean": _with(
        "read_dirty",
        "SELECT " + _READING_COLUMNS.format(prb="prb", fault="coalesce(prb > 100, false)") + " FROM read_dirty",
    ),
    "telemetry_clean_unique_hours": _with(
        "read_dirty", "SELECT DISTINCT tower_id, event_hour, 1::BIGINT AS copies FROM read_dirty"
    ),
    "telemetry_rejects": _with(
        "dirty_readings",
        """SELECT event_id, event_hour FROM dirty_readings
        WHERE try_cast(event_hour AS TIMESTAMP) IS NULL OR handovers > 2147483647""",
    ),
    "sessions_clean": _with(
        "dirty_sessions towers",
        """SELECT sub AS subscriber_id, tower_id, s_start AS session_start, s_end AS session_end,
            round(mins::DECIMAL(28,9), 6)::DOUBLE AS session_duration_min, service AS service_type, bytes AS bytes_transferred,
            s_start::DATE AS partition_date
        FROM dirty_sessions
        WHERE service IS NOT NULL AND tower_id IN (SELECT tower_id FROM towers)
            AND sub IN (SELECT c_custkey::VARCHAR FROM customer)
        QUALIFY row_number() OVER (PARTITION BY sub, tower_id, s_start
            ORDER BY s_end NULLS FIRST, service, bytes, mins) = 1""",
    ),
    "sessions_rejected": _with(
        "dirty_sessions",
        """SELECT sub AS subscriber_id, tower_id, s_start AS session_start, service AS service_type
        FROM dirty_sessions WHERE service IS NULL""",
    ),
    "scored_telemetry": _with(
        "scored",
        """SELECT tower_id, event_hour, warn AS threshold_warn, crit AS threshold_critical, severity,
            round(health::DECIMAL(28,9), 6)::DOUBLE AS health_score FROM scored""",
    ),
    "reading_features": _with(
        "scored",
        """SELECT tower_id, event_hour, part AS event_date, hour(event_hour)::INT AS hour_of_day,
            dayofweek(event_hour)::INT AS day_of_week, ((hour(event_hour) + 7) % 24)::INT AS local_hour,
            (CASE WHEN (hour(event_hour) + 7) % 24 IN (8, 9, 18, 19, 20) THEN 1.35
                WHEN (hour(event_hour) + 7) % 24 BETWEEN 0 AND 5 THEN 0.65 ELSE 1 END)::DOUBLE AS load_factor,
            CASE WHEN health >= 70 THEN 'good' WHEN health >= 40 THEN 'warn' ELSE 'critical' END AS health_band,
            CASE WHEN subs <= 0 THEN 400 ELSE least(2500, greatest(300, subs * 1.5)) END::DOUBLE AS marker_size,
            round(prb::DECIMAL(18,9), 1)::DECIMAL(18,1)::VARCHAR || '%' AS prb_text FROM scored""",
    ),
    "health_null_handling": _with(
        "scored",
        """SELECT tower_id, event_hour, CASE WHEN handovers % 5 = 0 THEN 100 ELSE round(health::DECIMAL(28,9), 6)::DOUBLE END AS health_score,
            CASE WHEN handovers % 5 <> 0 THEN round(health::DECIMAL(28,9), 6)::DOUBLE END AS strict_score FROM scored""",
    ),
    "capacity_shares": _with(
        "towers",
        """SELECT tower_id, cell_type, weight, round((weight / sum(weight) OVER ())::DECIMAL(28,9), 6)::DOUBLE AS capacity_share
        FROM (SELECT *, CASE cell_type WHEN 'urban' THEN 3 WHEN 'suburban' THEN 2 ELSE 1 END::DOUBLE AS weight
            FROM towers)""",
    ),
    "as_of_dates": _with(
        "readings",
        """SELECT count(*) AS row_count, max(part) FILTER (NOT fault) AS last_valid_day, max(part) AS last_partition
        FROM readings""",
    ),
    "selected_cells": _with("chosen", "SELECT * REPLACE (round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon, round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat) FROM chosen"),
    "newest_cells": _with("newest", "SELECT * REPLACE (round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon, round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat) FROM newest"),
    "province_tags": _with(
        "placed", f"SELECT {_CELL_KEY}, province AS province_name, island AS island_group FROM placed"
    ),
    "tower_master_build": _with(
        "placed",
        """SELECT substr(sha256(radio || '|' || mcc || '|' || net || '|' || area || '|' || cell), 1, 12) AS tower_id,
            radio, mcc, net AS mnc, area, cell, round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon, round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat, "range" AS range_m, samples,
            changeable, CASE WHEN coalesce("range", 0) = 0 THEN 'suburban' WHEN "range" < 1000 THEN 'urban'
                WHEN "range" <= 5000 THEN 'suburban' ELSE 'rural' END AS cell_type,
            province AS province_name, island AS island_group,
            TIMESTAMP '1970-01-01' + to_seconds(updated) AS last_updated FROM placed""",
    ),
    "cell_sample": _with("draw", f"SELECT {_CELL_KEY} FROM draw ORDER BY prio, digest LIMIT 300", third="100", seed="7"),
    "cell_sample_default_seed": _with(
        "draw", f"SELECT {_CELL_KEY} FROM draw ORDER BY prio, digest LIMIT 300", third="100", seed="42"
    ),
    "cell_sample_zero_seed": _with(
        "draw", f"SELECT {_CELL_KEY} FROM draw ORDER BY prio, digest LIMIT 300", third="100", seed="0"
    ),
    "cell_sample_top_up": _with(
        "draw",
        f"""SELECT {_CELL_KEY} FROM draw ORDER BY prio, digest
        LIMIT (SELECT count(*) + 50 FROM newest WHERE radio IN ('LTE', 'UMTS', 'GSM'))""",
        third="(SELECT (count(*) + 50) // 3 FROM newest WHERE radio IN ('LTE', 'UMTS', 'GSM'))",
        seed="7",
    ),
    "cell_sample_all": _with("newest", f"SELECT {_CELL_KEY} FROM newest"),
    "tower_upsert": _with(
        "towers",
        """SELECT tower_id, radio, mcc, mnc, area, cell, round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon, round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat, range_m, samples,
            changeable, cell_type, 'Last' AS province_name, island_group FROM towers
        UNION ALL
        SELECT 'new-' || tower_id, 'NR', mcc, mnc, area, cell, round(lon::DECIMAL(28,9), 6)::DOUBLE, round(lat::DECIMAL(28,9), 6)::DOUBLE, range_m, 1, changeable,
            cell_type, 'First', island_group FROM towers""",
    ),
    "tower_upsert_truncated": _with(
        "towers",
        """SELECT tower_id, radio, mcc, mnc, area, cell, round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon, round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat,
            range_m, samples, changeable, cell_type, 'Only' AS province_name, island_group FROM towers WHERE k % 2 = 0""",
    ),
    "cell_rejects": "SELECT 'bad,' || o_orderkey AS line FROM orders WHERE o_orderkey % 17 = 0",
    "lake_row_counts": _with("readings", "SELECT part AS partition_date, count(*) AS row_count FROM readings GROUP BY 1"),
    "telemetry_clean_fixed_date": _with(
        "read_dirty",
        "SELECT * REPLACE (DATE '2024-01-15' AS partition_date) FROM (SELECT "
        + _READING_COLUMNS.format(prb="prb", fault="coalesce(prb > 100, false)")
        + " FROM read_dirty)",
    ),
    "province_upsert": _with(
        "towers",
        f"""SELECT coalesce(id, ('0x' || substr(sha256(province_name), 1, 15))::BIGINT) AS province_id, province_name,
            coalesce(island, 'Old') AS island_group, CASE WHEN id IS NULL THEN {NOW} END AS added_at
        FROM (SELECT n_nationkey::BIGINT AS id,
                CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Former ' || n_name END AS province_name FROM nation)
        FULL JOIN (SELECT DISTINCT province_name, island_group AS island FROM towers) USING (province_name)""",
    ),
    "neighbour_pairs": _with("near", "SELECT src AS source_tower_id, nb AS neighbour_tower_id FROM near"),
    "neighbour_distances": _with(
        "near", "SELECT src AS source_tower_id, nb AS neighbour_tower_id, round(metres, 2) AS metres FROM near"
    ),
    "congestion_events": _with(
        "ev",
        """SELECT tower_id, event_hour, round(prb::DECIMAL(28,9), 6)::DOUBLE AS prb_utilization, warn AS threshold_warn,
            crit AS threshold_critical, severity, false AS is_sensor_fault FROM ev""",
    ),
    "hotspot_summary": _with(
        "hot",
        """SELECT tower_id, round(f7::DECIMAL(28,9), 6)::DOUBLE AS congestion_frequency_7d, round(f30::DECIMAL(28,9), 6)::DOUBLE AS congestion_frequency_30d,
            round(mean_prb::DECIMAL(28,9), 6)::DOUBLE AS avg_prb_utilization, peak::INT AS peak_congestion_hour,
            hours AS total_affected_subscriber_hours FROM hot""",
    ),
    "hotspot_summary_repeated_hours": _with(
        "readings towers limits",
        """, twice AS (SELECT * FROM readings WHERE NOT fault UNION ALL
            SELECT * FROM readings WHERE NOT fault AND subs > 50),
        e AS (SELECT tower_id, event_hour FROM twice JOIN towers USING (tower_id) JOIN limits USING (cell_type)
            WHERE prb >= warn),
        j AS (SELECT t.*, e.event_hour AS hot_hour, part >= (SELECT max(part) FROM twice) - 7 AS wk,
                part >= (SELECT max(part) FROM twice) - 30 AS mo
            FROM twice t LEFT JOIN e ON e.tower_id = t.tower_id AND e.event_hour = t.event_hour)
        SELECT tower_id,
            round((coalesce(100 * (count(DISTINCT hot_hour) FILTER (wk))::DOUBLE
                / nullif(count(DISTINCT event_hour) FILTER (wk), 0), 0))::DECIMAL(28,9), 6)::DOUBLE AS congestion_frequency_7d,
            round((coalesce(100 * (count(DISTINCT hot_hour) FILTER (mo))::DOUBLE
                / nullif(count(DISTINCT event_hour) FILTER (mo), 0), 0))::DECIMAL(28,9), 6)::DOUBLE AS congestion_frequency_30d,
            round(avg(prb)::DECIMAL(28,9), 6)::DOUBLE AS avg_prb_utilization,
            (mode() WITHIN GROUP (ORDER BY hour(hot_hour)))::INT AS peak_congestion_hour,
            count(DISTINCT hot_hour) AS total_affected_subscriber_hours
        FROM j GROUP BY tower_id""",
    ),
    "peak_hour_patterns": _with(
        "peaks",
        """SELECT tower_id, h AS hour_of_day, round(mean_prb::DECIMAL(28,9), 6)::DOUBLE AS avg_prb_utilization,
            round(rate::DECIMAL(28,9), 6)::DOUBLE AS congestion_occurrence_rate, days AS days_congested FROM peaks""",
    ),
    "network_health_snapshot": _with(
        "health", "SELECT tower_id, score AS health_score, subs AS connected_subscribers FROM health"
    ),
    "province_summary": _with(
        "towers hot health",
        f"""SELECT province_name, max(island_group) AS island_group, count(DISTINCT tower_id) AS tower_count,
            count(DISTINCT tower_id) FILTER (f7 >= 30) AS congested_tower_count,
            {_HALF_UP.format('(count(*) FILTER (f7 >= 30))::DOUBLE / count(*) * 100')} AS congestion_rate,
            {_HALF_UP.format('avg(score)')} AS avg_health_score,
            coalesce(sum(hours), 0)::BIGINT AS total_affected_subscriber_hours_7d
        FROM towers LEFT JOIN hot USING (tower_id) LEFT JOIN health USING (tower_id) GROUP BY province_name""",
    ),
    "subscriber_impact": _with("impact", f"SELECT {_IMPACT_ROWS} FROM impact"),
    "neighbour_impact": _with(
        "spill", "SELECT src AS source_tower_id, nb AS neighbour_tower_id, true AS is_spillover FROM spill"
    ),
    "mart_row_counts": _with(
        "ev hot peaks spill impact health towers",
        """SELECT 'congestion_events' AS table_name, count(*) AS row_count FROM ev
        UNION ALL SELECT 'hotspot_summary', count(*) FROM hot
        UNION ALL SELECT 'peak_hour_patterns', count(*) FROM peaks
        UNION ALL SELECT 'neighbour_impact', count(*) FROM spill
        UNION ALL SELECT 'subscriber_impact', count(*) FROM impact
        UNION ALL SELECT 'network_health_snapshot', count(*) FROM health
        UNION ALL SELECT 'province_summary', count(DISTINCT province_name) FROM towers""",
    ),
    "hotspot_leaderboard_7d": _with("hot towers", _hotspot_board("f7")),
    "hotspot_leaderboard_30d": _with("hot towers", _hotspot_board("f30")),
    "province_leaderboard_7d": _with("hot health towers", _province_board("f7")),
    "province_leaderboard_30d": _with("hot health towers", _province_board("f30")),
    "province_towers": _with(
        "towers scored readings hot",
        f"""SELECT m.* EXCLUDE (island_group, lat, lon), round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat, round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon,
            coalesce(round(f7::DECIMAL(28,9), 6)::DOUBLE, 0) AS congestion_frequency_7d, coalesce(round(f30::DECIMAL(28,9), 6)::DOUBLE, 0) AS congestion_frequency_30d,
            coalesce(round(mean_prb::DECIMAL(28,9), 6)::DOUBLE, 0) AS hotspot_avg_prb
        FROM ({_tower_map('7 DAY')}) m LEFT JOIN hot USING (tower_id)""",
    ),
    "province_towers_view": _with(
        "towers scored readings hot",
        f"""SELECT tower_id, radio, cell_type, health_score, avg_prb_utilization AS avg_prb_pct,
            connected_subscribers AS subscribers, {_EVEN.format('coalesce(f30, 0)')} AS congestion_frequency_pct
        FROM ({_tower_map('30 DAY')}) LEFT JOIN hot USING (tower_id) WHERE province_name = 'NATION_3'""",
    ),
    "map_scope_by_tower": _with(
        "towers scored readings",
        f"""SELECT * REPLACE (round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat, round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon) FROM ({_tower_map('7 DAY')})
        WHERE province_name = (SELECT province_name FROM towers WHERE tower_id = '1')""",
    ),
    "map_scope_by_province": _with(
        "towers scored readings",
        f"""SELECT * REPLACE (round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat, round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon) FROM ({_tower_map('7 DAY')})
        WHERE province_name = 'NATION_3'""",
    ),
    "latest_reading": _with(
        "readings",
        """SELECT tower_id, event_hour, round(prb::DECIMAL(28,9), 6)::DOUBLE AS prb_utilization, subs AS connected_subscribers
        FROM readings WHERE NOT fault
        QUALIFY row_number() OVER (PARTITION BY tower_id ORDER BY event_hour DESC) = 1""",
    ),
    "tower_metadata": _with(
        "towers limits",
        """SELECT tower_id, round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat, round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon, radio, mnc, cell_type, province_name,
            island_group, warn AS prb_warn_pct, crit AS prb_critical_pct, slow AS latency_warn_ms
        FROM towers JOIN limits USING (cell_type)""",
    ),
    "prb_series": _with(
        "readings",
        """SELECT tower_id, event_hour, round(prb::DECIMAL(28,9), 6)::DOUBLE AS prb_utilization, subs AS connected_subscribers
        FROM (SELECT *, max(event_hour) OVER (PARTITION BY tower_id) AS newest FROM readings)
        WHERE NOT fault AND event_hour >= newest - INTERVAL 7 DAY""",
    ),
    "event_history": _with(
        "impact",
        """SELECT tower_id, event_hour::DATE AS event_date, hour(event_hour)::INT AS hour, severity,
            subs AS subscribers_affected, round((coalesce(minutes, 0))::DECIMAL(28,9), 6)::DOUBLE AS degraded_minutes FROM impact""",
    ),
    "peak_hour_profile": _with(
        "peaks",
        """SELECT tower_id, h AS hour_of_day, round(mean_prb::DECIMAL(28,9), 6)::DOUBLE AS avg_prb_utilization,
            round(rate::DECIMAL(28,9), 6)::DOUBLE AS congestion_occurrence_rate FROM peaks""",
    ),
    "prb_by_weekday_hour": _with(
        "readings",
        """SELECT tower_id, dayofweek(event_hour)::INT AS day_of_week, hour(event_hour)::INT AS hour_of_day,
            round(avg(prb)::DECIMAL(28,9), 6)::DOUBLE AS avg_prb FROM readings WHERE NOT fault GROUP BY ALL""",
    ),
    "weekday_hour_grid": _with(
        "readings",
        f"""SELECT s.tower_id, s.day_of_week, g.* EXCLUDE (tower_id, dow)
        FROM (SELECT DISTINCT tower_id, d::INT AS day_of_week FROM readings, range(7) r(d) WHERE NOT fault) s
        LEFT JOIN (SELECT tower_id, dayofweek(event_hour) AS dow, {_GRID} FROM readings WHERE NOT fault GROUP BY 1, 2) g
            ON g.tower_id = s.tower_id AND g.dow = s.day_of_week""",
    ),
    "neighbour_list": _with(
        "spill towers",
        """SELECT src AS source_tower_id, nb AS neighbour_tower, province_name AS province, cell_type,
            true AS spillover FROM spill JOIN towers ON tower_id = nb""",
    ),
    "impact_totals": _with(
        "impact",
        """SELECT tower_id, count(DISTINCT event_hour) AS congestion_events,
            sum(subs)::BIGINT AS total_affected_sessions, round((coalesce(sum(minutes), 0))::DECIMAL(28,9), 6)::DOUBLE AS total_degraded_minutes,
            sum(voice)::BIGINT AS voice_sessions, sum(data)::BIGINT AS data_sessions, sum(sms)::BIGINT AS sms_sessions
        FROM impact GROUP BY tower_id""",
    ),
    "province_choices": _with("towers", "SELECT DISTINCT province_name FROM towers"),
    "filter_options": _with(
        "towers",
        """SELECT DISTINCT 'province' AS filter, province_name AS choice FROM towers
        UNION SELECT DISTINCT 'island_group', island_group FROM towers
        UNION SELECT 'province', 'All' UNION SELECT 'island_group', 'All'""",
    ),
    "tower_ids": _with("towers", "SELECT tower_id FROM towers"),
    "active_alerts": _with(
        "earlier towers",
        f"""SELECT alert_id, tower_id, province_name, island_group, alert_type, alert_category, severity, message,
            triggered_at, round((date_diff('microsecond', triggered_at, {NOW}) / 1e6 / 86400)::DECIMAL(28,9), 6)::DOUBLE AS days_active
        FROM earlier JOIN towers USING (tower_id) WHERE status = 'ACTIVE'""",
    ),
    "active_alerts_filtered": _with(
        "earlier towers",
        f"""SELECT tower_id, province_name AS province, alert_type, severity, message, triggered_at,
            {_EVEN.format(f"date_diff('microsecond', triggered_at, {NOW}) / 1e6 / 86400")} AS days_active
        FROM earlier JOIN towers USING (tower_id)
        WHERE status = 'ACTIVE' AND alert_type = 'CRITICAL' AND island_group = 'ASIA'""",
    ),
    "alert_summary": _with(
        "earlier towers",
        f"""SELECT count(*) AS total_active, count(*) FILTER (alert_type = 'CRITICAL') AS critical_count,
            count(DISTINCT tower_id) AS towers_affected, count(DISTINCT province_name) AS provinces_affected,
            {_EVEN.format(f"date_diff('microsecond', min(triggered_at), {NOW}) / 1e6 / 86400")} AS oldest_alert_days
        FROM earlier JOIN towers USING (tower_id) WHERE status = 'ACTIVE'""",
    ),
    "home_metrics": _with(
        "towers earlier health",
        f"""SELECT (SELECT count(*) FROM towers) AS tower_count,
            (SELECT count(*) FROM earlier WHERE status = 'ACTIVE') AS active_alerts,
            (SELECT {_HALF_UP.format('avg(score)')} FROM health) AS avg_health_score""",
    ),
    "hotspot_alerts": _with("hot earlier", _hotspot_alerts(30, 50)),
    "hotspot_alerts_low": _with("hot earlier", _hotspot_alerts(20, 40)),
    "peak_hour_alerts": _with("peaks earlier", _peak_alerts(70, 5)),
    "peak_hour_alerts_low": _with("peaks earlier", _peak_alerts(50, 2)),
    "neighbour_alerts": _with("spill earlier", _NEIGHBOUR_ALERTS),
    "alerts_expired": _with("earlier hot", _EXPIRE.format(source="earlier")),
    "alert_cycle": _with(
        "earlier hot peaks spill",
        f""", fresh AS ({_hotspot_alerts(20, 40)} UNION ALL {_peak_alerts(50, 2)} UNION ALL {_NEIGHBOUR_ALERTS}),
        together AS (SELECT alert_id, tower_id, alert_type, alert_category, severity, message, triggered_at,
            resolved_at, status FROM earlier UNION ALL {_NEW_IDS})
        {_EXPIRE.format(source='together')}""",
    ),
    "quality_nulls": _with(
        "dirty_readings",
        """SELECT 'tower_id' AS column_name, count(*) AS violations FROM dirty_readings WHERE tower_id IS NULL
        UNION ALL SELECT 'handover_count', count(*) FROM dirty_readings WHERE handovers IS NULL""",
    ),
    "quality_duplicates": _with(
        "dirty_readings",
        """SELECT tower_id, event_hour, count(*) AS copies FROM dirty_readings WHERE tower_id IS NOT NULL
        GROUP BY ALL HAVING count(*) > 1""",
    ),
    "quality_unexpected_values": _with(
        "ev towers sessions",
        """SELECT 'severity' AS check_name, severity AS value, count(*) AS violations FROM ev
            WHERE severity <> 'WARN' GROUP BY 2
        UNION ALL SELECT 'cell_type', cell_type, count(*) FROM towers WHERE cell_type = 'rural' GROUP BY 2
        UNION ALL SELECT 'service_type', service, count(*) FROM sessions WHERE service = 'SMS' GROUP BY 2""",
    ),
    "quality_prb_range": _with(
        "readings", "SELECT count(*) AS invalid_prb_count FROM readings WHERE prb - 1 < 0 OR prb - 1 > 100"
    ),
    "quality_thresholds": _with(
        "ev towers", "SELECT tower_id, event_hour FROM ev JOIN towers USING (tower_id) WHERE cell_type = 'rural'"
    ),
    "quality_missing_hours": _with(
        "readings towers",
        """SELECT t.tower_id, day::DATE AS partition_date, (24 - count(r.event_hour))::INT AS missing_hours
        FROM towers t CROSS JOIN (SELECT unnest(generate_series(min(part)::TIMESTAMP, max(part)::TIMESTAMP,
            INTERVAL 1 DAY)) AS day FROM readings)
        LEFT JOIN readings r ON r.tower_id = t.tower_id AND r.part = day::DATE
        GROUP BY ALL HAVING count(r.event_hour) < 24""",
    ),
    "quality_telemetry_dates": _with(
        "readings towers",
        """SELECT day::DATE AS partition_date, count(tower_id) AS actual_rows,
            (SELECT count(*) * 24 FROM towers) AS expected_rows
        FROM (SELECT unnest(generate_series(min(part)::TIMESTAMP, max(part)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM readings)
        LEFT JOIN readings ON part = day::DATE GROUP BY 1 HAVING actual_rows <> expected_rows""",
    ),
    "quality_session_dates": _with(
        "sessions",
        """SELECT day::DATE AS partition_date, count(sub) AS actual_rows,
            (SELECT count(*) * 3 FROM customer) AS expected_rows
        FROM (SELECT unnest(generate_series(min(s_start)::DATE::TIMESTAMP, max(s_start)::DATE::TIMESTAMP, INTERVAL 1 DAY))
            AS day FROM sessions)
        LEFT JOIN sessions ON s_start::DATE = day::DATE GROUP BY 1 HAVING actual_rows < expected_rows * 0.95""",
    ),
    "quality_tower_master": _with(
        "towers",
        """SELECT count(*) AS towers, 0::BIGINT AS incomplete_towers, (SELECT count(*) + 1 FROM supplier) AS expected_towers
        FROM towers""",
    ),
    "quality_orphan_towers": _with(
        "raw_sessions towers",
        """SELECT tower_id, count(*) AS violations FROM raw_sessions
        WHERE tower_id NOT IN (SELECT tower_id FROM towers) GROUP BY 1""",
    ),
    "quality_standard": _with(
        "read_dirty sessions ev towers hot earlier",
        """SELECT 'telemetry tower_id/event_hour not null' AS check_name, count(*) AS violations FROM read_dirty
            WHERE tower_id IS NULL OR event_hour IS NULL
        UNION ALL SELECT 'sessions subscriber_id/tower_id not null', count(*) FROM sessions
            WHERE sub IS NULL OR tower_id IS NULL
        UNION ALL SELECT 'events tower_id/severity not null', count(*) FROM ev
            WHERE tower_id IS NULL OR severity IS NULL
        UNION ALL SELECT 'towers tower_id/cell_type not null', count(*) FROM towers
            WHERE tower_id IS NULL OR cell_type IS NULL
        UNION ALL SELECT 'hotspots tower_id not null', count(*) FROM hot WHERE tower_id IS NULL
        UNION ALL SELECT 'subscribers subscriber_id not null', count(*) FROM customer WHERE c_custkey IS NULL
        UNION ALL SELECT 'towers tower_id unique', count(*) FROM
            (SELECT 1 FROM towers GROUP BY tower_id HAVING count(*) > 1)
        UNION ALL SELECT 'hotspots tower_id unique', count(*) FROM
            (SELECT 1 FROM hot GROUP BY tower_id HAVING count(*) > 1)
        UNION ALL SELECT 'subscribers subscriber_id unique', count(*) FROM
            (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1)
        UNION ALL SELECT 'telemetry tower_id/event_hour unique', count(*) FROM
            (SELECT 1 FROM read_dirty GROUP BY tower_id, event_hour HAVING count(*) > 1)
        UNION ALL SELECT 'events severity accepted', count(DISTINCT severity) FROM ev
            WHERE severity NOT IN ('WARN', 'CRITICAL')
        UNION ALL SELECT 'towers cell_type accepted', count(DISTINCT cell_type) FROM towers
            WHERE cell_type NOT IN ('urban', 'suburban', 'rural')
        UNION ALL SELECT 'sessions service_type accepted', count(DISTINCT service) FROM sessions
            WHERE service NOT IN ('voice', 'data', 'SMS')
        UNION ALL SELECT 'alerts status accepted', count(DISTINCT status) FROM earlier
            WHERE status NOT IN ('ACTIVE', 'RESOLVED')
        UNION ALL SELECT 'telemetry prb range', count(*) FROM (SELECT count(*) AS n FROM read_dirty WHERE prb < 0) WHERE n > 0
        UNION ALL SELECT 'events tower known', count(DISTINCT tower_id) FROM ev
            WHERE tower_id NOT IN (SELECT tower_id FROM towers)
        UNION ALL SELECT 'sessions tower known', count(DISTINCT tower_id) FROM sessions
            WHERE tower_id NOT IN (SELECT tower_id FROM towers)
        UNION ALL SELECT 'events threshold defined', count(*) FROM ev JOIN towers USING (tower_id)
            WHERE cell_type NOT IN ('urban', 'suburban', 'rural')""",
    ),
}

_SPANS = {"24h": "1 DAY", "7d": "7 DAY", "30d": "30 DAY"}

for _name, _span in _SPANS.items():
    ORACLE[f"tower_map_{_name}"] = _with(
        "towers scored readings",
        f"SELECT * REPLACE (round(lat::DECIMAL(28,9), 6)::DOUBLE AS lat, round(lon::DECIMAL(28,9), 6)::DOUBLE AS lon) FROM ({_tower_map(_span)})",
    )
    ORACLE[f"province_map_{_name}"] = _with(
        "towers scored readings",
        f"""SELECT province_name, island_group, count(*) AS tower_count,
            count(*) FILTER (health_score < 40) AS congested_tower_count,
            {_EVEN.format('avg(health_score)')} AS avg_health_score,
            {_EVEN.format('avg(avg_prb_utilization)')} AS avg_prb_utilization,
            coalesce(sum(connected_subscribers), 0)::BIGINT AS total_connected_subscribers,
            {_EVEN.format('(count(*) FILTER (health_score < 40))::DOUBLE / count(*) * 100')} AS congestion_rate
        FROM ({_tower_map(_span)}) GROUP BY ALL""",
    )

_later = _PARTS["impact"][1].replace("FROM ev ", "FROM ev_later ev ").replace("FROM ev\n", "FROM ev_later ev\n")
_PARTS["impact_later"] = ("ev_later sessions", _later)
ORACLE["subscriber_impact_offset_hours"] = _with("impact_later", f"SELECT {_IMPACT_ROWS} FROM impact_later")
ORACLE["subscriber_impact_refreshed"] = ORACLE["subscriber_impact"]
ORACLE["province_geojson_document"] = ORACLE["province_geojson_bounds"]
ORACLE["tower_metadata_from_csv"] = ORACLE["tower_metadata"]
for _name in (
    "latest_reading tower_metadata prb_series event_history peak_hour_profile prb_by_weekday_hour impact_totals".split()
):
    ORACLE[f"{_name}_of_tower"] = f"SELECT * FROM ({ORACLE[_name]}) WHERE tower_id = '1'"
ORACLE["neighbour_list_of_tower"] = f"SELECT * FROM ({ORACLE['neighbour_list']}) WHERE source_tower_id = '1'"
_TOTALS = "total_affected_sessions, 0::DOUBLE AS total_degraded_minutes, 0::BIGINT AS voice_sessions, 0::BIGINT AS data_sessions"
ORACLE["impact_totals_of_no_tower"] = (
    f"SELECT count(*) AS congestion_events, 0::BIGINT AS {_TOTALS}, 0::BIGINT AS sms_sessions FROM supplier WHERE s_suppkey < 0"
)
ORACLE["impact_totals_of_tower"] = f"SELECT * EXCLUDE (tower_id) FROM ({ORACLE['impact_totals_of_tower']})"
for _mart in ("hotspot_summary", "peak_hour_patterns", "neighbour_impact", "subscriber_impact"):
    ORACLE[f"{_mart}_published"] = ORACLE[_mart]
ORACLE["province_tags_by_cover"] = ORACLE["province_tags"]
ORACLE["neighbour_pairs_updated"] = ORACLE["neighbour_pairs"]
ORACLE["dated_tree_import"] = ORACLE["staged_telemetry_view"]
# Replaying the log gives what the cycle gives, and what was there before it.
ORACLE["alert_log_replay"] = ORACLE["alert_cycle"]
ORACLE["alert_log_before"] = _with("earlier", "SELECT * FROM earlier")
ORACLE["alert_log_changes"] = f"""SELECT 'cycle' AS run_id, alert_category, status, count(*) AS changes FROM ({ORACLE['alert_cycle']})
    WHERE TIMESTAMP '2024-02-01 12:00:00' IN (triggered_at, resolved_at) GROUP BY ALL"""
