"""Log format detection and syslog fields as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes by which formats are told apart.
SYSLOG = r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+"
ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
SYSLOG_FIELDS = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(\[\d+\])?\s*:\s*(.+)$"
DELIMITERS = (",", "\t", "|", ";")
FIELD_NAMES = ("timestamp", "hostname", "service", "pid", "message")


def has_pid(line: Column) -> Column:
    return line.contains("[") & line.contains("]: ")


def delimiter(line: Column) -> Column:
    """The first delimiter that stands in the line three times or more, else null."""
    times = lambda d: F.char_length(line) - F.char_length(F.replace(line, F.lit(d), F.lit("")))
    return F.coalesce(*[F.when(times(d) >= 3, F.lit(d)) for d in DELIMITERS])


def detect_format(line: Column) -> Column:
    """struct(format, has_pid, delimiter): syslog, iso_timestamp, custom_delimited or unstructured."""
    is_syslog, is_iso = F.coalesce(line.rlike(SYSLOG), F.lit(False)), F.coalesce(line.rlike(ISO), F.lit(False))
    kind = F.when(is_syslog, "syslog").when(is_iso, "iso_timestamp").when(delimiter(line).isNotNull(), "custom_delimited").otherwise("unstructured")
    return F.struct(kind.alias("format"), F.when(is_syslog, has_pid(line)).alias("has_pid"), F.when(~is_syslog & ~is_iso, delimiter(line)).alias("delimiter"))


def syslog_fields(line: Column) -> Column:
    """struct of the five fields, null if the line has not that shape; a pid keeps its brackets and may be null."""
    part = lambda i: F.regexp_extract(line, SYSLOG_FIELDS, i)
    fields = F.struct(*[(F.nullif(part(i), F.lit("")) if name == "pid" else part(i)).alias(name) for i, name in enumerate(FIELD_NAMES, 1)])
    return F.when(line.rlike(SYSLOG_FIELDS), fields)
