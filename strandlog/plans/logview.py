"""A log corpus derived from the ``events`` table, the same in Spark and DuckDB, and the catalogue that goes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.operators.matcher import Matcher, Template

#: One shape for each event type, with variants for partial matches, shared prefixes, repeated fragments and ties.
MESSAGE = """case
 when event_type = 'error' and event_id % 7 = 0 then 'generic note uid=' || user_id || ' only'
 when event_type = 'error' then 'sshd(pam_unix)[' || (1000 + user_id) || ']: authentication failure; logname= uid=' || user_id || ' rhost=10.0.0.' || (user_id % 255)
 when event_type = 'purchase' and event_id % 7 = 1 then 'Transaction txn_' || event_id || ' completed with warnings: low balance'
 when event_type = 'purchase' then 'Transaction txn_' || event_id || ' completed successfully with amount ' || cast(value as decimal(10,2))
 when event_type = 'view' then 'Request r' || user_id || ' completed in ' || regexp_extract(props, '([0-9]+)', 1) || 'ms with status 200'
 when event_type = 'click' and event_id % 7 = 2 then 'pair 1 and 2 and 3'
 when event_type = 'click' and event_id % 7 = 3 then 'twin ' || user_id
 when event_type = 'click' then 'cpu_usage: ' || cast(value as decimal(10,1)) || '% - click load'
 else 'opaque ' || user_id end"""

LOGS_SQL = f"""select event_id as line_id, 'org-' || (user_id % 3) as org_id, 'stream-' || (user_id % 5) as log_stream_id, 'svc-' || (user_id % 4) as service,
 'region-' || (user_id % 2) as region, 'name-' || (user_id % 5) as log_stream_name, event_type as event_id, ts as timestamp, {MESSAGE} as message from events"""

SYSLOG_SQL = """select event_id as line_id, case event_id % 5
 when 0 then 'Jan 0' || (1 + event_id % 9) || ' 10:0' || (event_id % 6) || ':03 host' || (user_id % 20) || ' sshd[' || user_id || ']: ' || event_type || ' from 10.0.0.' || (user_id % 255)
 when 1 then 'Feb 1' || (event_id % 9) || ' 11:22:33 host' || (user_id % 20) || ' kernel: ' || event_type || ' value ' || (event_id % 100)
 when 2 then '2024-01-0' || (1 + event_id % 9) || 'T10:00:00 ' || event_type
 when 3 then event_type || ',' || user_id || ',' || event_id || ',x|y'
 else event_type || ' by user ' || user_id end as message from events"""

TEMPLATES = (
    Template(10, r"sshd\(pam_unix\)\[(\d+)\]: authentication failure; logname=(.*?) uid=(\d+) rhost=([\d.]+)", ["pid", "logname", "uid", "rhost"], "sshd"),
    Template(11, r"generic log with uid=(\d+) and tty=(\w+) somewhere", ["uid", "tty"], "generic"),
    Template(30, r"Transaction ([a-z0-9_]+) completed successfully with amount ([\d.]+)", ["txn", "amount"], "success"),
    Template(31, r"Transaction ([a-z0-9_]+) completed with warnings: (.*)", ["txn", "warning"], "warnings"),
    Template(40, r"Request ([a-z0-9_]+) completed in (\d+)ms with status (\d{3})", ["request", "ms", "status"], "request"),
    Template(50, r"pair (\d+) and (\d+) and (\d+)", ["a", "b", "c"], "pair"),
    Template(60, r"twin (\d+)", ["n"], "twin"),
    Template(61, r"twin (.*)", ["rest"], "twin"),
)


def catalogue(config=None) -> Matcher:
    m = Matcher.seeded(config)
    for t in TEMPLATES:
        m = m.add(t)
    return m


def events_as(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the events table; its time stamps are read as UTC instants."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(sql.replace("from events", "from {events}"), events=events)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as(spark, sf_dir, LOGS_SQL)


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as(spark, sf_dir, SYSLOG_SQL)
