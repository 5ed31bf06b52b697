"""Fixed schemas of the three signal tables and the enumerations they use."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the stored tables.
SPANS_DDL = """
trace_id STRING NOT NULL,
span_id STRING NOT NULL,
parent_span_id STRING,
trace_state STRING,
span_name STRING NOT NULL,
span_kind INT NOT NULL,
start_ns BIGINT NOT NULL,
end_ns BIGINT NOT NULL,
duration_ms DOUBLE NOT NULL,
service_name STRING NOT NULL,
scope_name STRING,
scope_version STRING,
schema_url STRING,
resource_attributes STRING,
span_attributes STRING,
status_code INT NOT NULL,
status_message STRING,
events STRING,
links STRING,
dropped_attributes_count INT NOT NULL,
dropped_events_count INT NOT NULL,
dropped_links_count INT NOT NULL,
flags BIGINT NOT NULL"""
LOG_RECORDS_DDL = """
time_ns BIGINT NOT NULL,
observed_time_ns BIGINT,
severity_text STRING,
severity_number INT,
service_name STRING NOT NULL,
scope_name STRING,
scope_version STRING,
schema_url STRING,
body STRING,
trace_id STRING,
span_id STRING,
event_name STRING,
log_attributes STRING,
resource_attributes STRING,
flags BIGINT NOT NULL"""
METRIC_POINTS_DDL = """
metric_name STRING NOT NULL,
metric_type STRING NOT NULL,
metric_unit STRING,
metric_description STRING,
aggregation_temporality INT,
is_monotonic BOOLEAN,
service_name STRING NOT NULL,
scope_name STRING,
scope_version STRING,
schema_url STRING,
resource_attributes STRING,
series_attributes STRING,
metric_metadata STRING,
exemplars STRING,
start_ns BIGINT,
ts_ns BIGINT NOT NULL,
value_double DOUBLE,
value_int BIGINT,
hist_count BIGINT,
hist_sum DOUBLE,
hist_min DOUBLE,
hist_max DOUBLE,
hist_bounds STRING,
hist_bucket_counts STRING,
exp_zero_count BIGINT,
exp_scale INT,
exp_zero_threshold DOUBLE,
exp_buckets STRING,
summary_count BIGINT,
summary_sum DOUBLE,
summary_quantiles STRING,
flags BIGINT NOT NULL"""
# End of the fixed values.

DDL = {"spans": SPANS_DDL, "log_records": LOG_RECORDS_DDL, "metric_points": METRIC_POINTS_DDL}
_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def _table(ddl: str) -> T.StructType:
    """The schema of plain DDL; unlike Spark's own reader of DDL it needs no session."""
    columns = [line.strip().rstrip(",").split(" ", 2) for line in ddl.strip().splitlines()]
    return T.StructType([T.StructField(name, _TYPES[kind], not required) for name, kind, *required in columns])


SPANS, LOG_RECORDS, METRIC_POINTS = (_table(ddl) for ddl in DDL.values())

TABLES = {"spans": SPANS, "log_records": LOG_RECORDS, "metric_points": METRIC_POINTS}

# The column that orders and partitions each table.
TIME_COLUMN = {"spans": "start_ns", "log_records": "time_ns", "metric_points": "ts_ns"}

# SQL type names shown by the schema listing.
SQL_TYPE_NAMES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
                  "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE",
                  "timestamp_ntz": "TIMESTAMP"}

# Enumerations of the data model.
SPAN_KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
STATUS_LABELS = {0: "UNSET", 1: "OK", 2: "ERROR"}
SEVERITY_MIN = {"trace": 1, "debug": 5, "info": 9, "warn": 13, "warning": 13, "error": 17, "fatal": 21}
SEVERITY_CLASS = {"ERROR": "destructive", "FATAL": "destructive", "WARN": "default",
                  "WARNING": "default", "INFO": "secondary"}
DELTA, CUMULATIVE = 1, 2
