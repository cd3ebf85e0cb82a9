"""Schemas of the logical tables."""

from __future__ import annotations




#: DDL strings, so that this module needs no session.
LOGS = "org_id string, log_stream_id string, service string, region string, log_stream_name string, timestamp timestamp, template_id string, message string"
TEMPLATES = "org_id string, log_stream_id string, template_id long, pattern string, variables array<string>, example string, created_at timestamp"
TEMPLATE_EXAMPLES = "org_id string, log_stream_id string, service string, region string, template_id string, message string, timestamp timestamp"
TEMPLATE = "template_id long, pattern string, variables array<string>, example string"
CATALOGUE_FILE = f"next_template_id long, templates array<struct<{', '.join(f.replace(' ', ': ', 1) for f in TEMPLATE.split(', '))}>>"
INGEST = "timestamp string, org_id string, log_stream_id string, service string, region string, log_stream_name string, message string"
GROUND_TRUTH = "line_id long, log_line string, event_id string, expected_template string"
LOG_GROUP = "template_id string, log_count long, sample_messages array<string>, relative_change double"
BENCHMARK_ROW = "dataset string, templates int, logs int, matched int, match_rate double, throughput double, latency_us double, accuracy double"
