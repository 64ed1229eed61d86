"""Table schemas and the fixed reference values the plans depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _schema(columns: str) -> StructType:
    """StructType from "name TYPE [NOT NULL], ..."; unlike fromDDL it needs no running session."""
    parts = (c.split(None, 2) for c in columns.split(","))
    return StructType([StructField(p[0], _TYPES[p[1]], len(p) < 3) for p in parts])


# Column order of the public cell-site CSV, which has no header row.
CELL_SCHEMA = _schema(
    "radio STRING, mcc INT, net INT, area INT, cell BIGINT, unit INT, lon DOUBLE, lat DOUBLE, "
    "range INT, samples INT, changeable INT, created BIGINT, updated BIGINT, averageSignal INT"
)

# Columns of the stored tables, from here to the thresholds.
# `cell` is wider than the 32-bit id some stores use: LTE cell ids may need it.
TOWER_SCHEMA = _schema(
    "tower_id STRING NOT NULL, radio STRING NOT NULL, mcc INT NOT NULL, mnc INT NOT NULL, "
    "area INT NOT NULL, cell BIGINT NOT NULL, lon DOUBLE NOT NULL, lat DOUBLE NOT NULL, range_m INT, "
    "samples INT, changeable INT, cell_type STRING NOT NULL, province_name STRING, island_group STRING, "
    "last_updated TIMESTAMP_NTZ, seeded_at TIMESTAMP_NTZ"
)

PROVINCE_SCHEMA = _schema(
    "province_id BIGINT, province_name STRING NOT NULL, island_group STRING, added_at TIMESTAMP_NTZ"
)

SUBSCRIBER_SCHEMA = _schema(
    "subscriber_id STRING NOT NULL, plan_tier STRING NOT NULL, home_region STRING NOT NULL, "
    "seeded_at TIMESTAMP_NTZ"
)

ALERT_SCHEMA = _schema(
    "alert_id BIGINT, tower_id STRING NOT NULL, alert_type STRING NOT NULL, alert_category STRING NOT NULL, "
    "severity INT NOT NULL, message STRING, triggered_at TIMESTAMP_NTZ NOT NULL, "
    "resolved_at TIMESTAMP_NTZ, status STRING NOT NULL"
)

TELEMETRY_SCHEMA = _schema(
    "tower_id STRING NOT NULL, event_hour TIMESTAMP_NTZ NOT NULL, prb_utilization DOUBLE, "
    "throughput_mbps DOUBLE, latency_ms DOUBLE, dropped_call_rate DOUBLE, handover_count INT, "
    "connected_subscribers INT, is_sensor_fault BOOLEAN, partition_date DATE NOT NULL"
)

SESSION_SCHEMA = _schema(
    "subscriber_id STRING NOT NULL, tower_id STRING NOT NULL, session_start TIMESTAMP_NTZ NOT NULL, "
    "session_end TIMESTAMP_NTZ, session_duration_min DOUBLE, service_type STRING NOT NULL, "
    "bytes_transferred BIGINT, partition_date DATE NOT NULL"
)

THRESHOLD_SCHEMA = _schema(
    "cell_type STRING, prb_warn_pct DOUBLE, prb_critical_pct DOUBLE, latency_warn_ms DOUBLE, "
    "dropped_call_warn_pct DOUBLE"
)

# Default alarm thresholds per cell type, in THRESHOLD_SCHEMA order.
THRESHOLD_ROWS = [
    ("urban", 70.0, 85.0, 50.0, 2.0),
    ("suburban", 65.0, 80.0, 60.0, 2.5),
    ("rural", 60.0, 75.0, 80.0, 3.0),
]

# Province -> island group.
ISLAND_GROUPS = {
    "Aceh": "Sumatera",
    "Sumatera Utara": "Sumatera",
    "Sumatera Barat": "Sumatera",
    "Riau": "Sumatera",
    "Jambi": "Sumatera",
    "Sumatera Selatan": "Sumatera",
    "Bengkulu": "Sumatera",
    "Lampung": "Sumatera",
    "Kepulauan Bangka Belitung": "Sumatera",
    "Kepulauan Riau": "Sumatera",
    "DKI Jakarta": "Jawa",
    "Jawa Barat": "Jawa",
    "Jawa Tengah": "Jawa",
    "DI Yogyakarta": "Jawa",
    "Jawa Timur": "Jawa",
    "Banten": "Jawa",
    "Bali": "Bali Nusa",
    "Nusa Tenggara Barat": "Bali Nusa",
    "Nusa Tenggara Timur": "Bali Nusa",
    "Kalimantan Barat": "Kalimantan",
    "Kalimantan Tengah": "Kalimantan",
    "Kalimantan Selatan": "Kalimantan",
    "Kalimantan Timur": "Kalimantan",
    "Kalimantan Utara": "Kalimantan",
    "Sulawesi Utara": "Sulawesi",
    "Gorontalo": "Sulawesi",
    "Sulawesi Tengah": "Sulawesi",
    "Sulawesi Barat": "Sulawesi",
    "Sulawesi Selatan": "Sulawesi",
    "Sulawesi Tenggara": "Sulawesi",
    "Maluku": "Maluku",
    "Maluku Utara": "Maluku",
    "Papua": "Papua",
    "Papua Barat": "Papua",
    "Papua Selatan": "Papua",
    "Papua Tengah": "Papua",
    "Papua Pegunungan": "Papua",
    "Papua Barat Daya": "Papua",
}

# Vocabularies checked by the data-quality plans.
CELL_TYPES = ("urban", "suburban", "rural")
SEVERITIES = ("WARN", "CRITICAL")
SERVICE_TYPES = ("voice", "data", "SMS")
ALERT_STATUSES = ("ACTIVE", "RESOLVED")

# Radios and operator codes favoured when sampling cells.
SAMPLE_RADIOS = ("LTE", "UMTS", "GSM")
SAMPLE_MNCS = (1, 8, 11, 21)


def _inline(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Rows as an inline table, whose exact size the optimizer knows."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(schema.names)})")


def default_thresholds(spark: SparkSession) -> DataFrame:
    return _inline(spark, THRESHOLD_ROWS, THRESHOLD_SCHEMA)


def island_groups(spark: SparkSession) -> DataFrame:
    schema = _schema("province_name STRING, island_group STRING")
    return _inline(spark, list(ISLAND_GROUPS.items()), schema)
