"""Every operator as a query over the test tables, with the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import formats, fragments, templates, tokens
from strandlog.operators import catalog, evaluate, generate, learn, matcher, runs, split, storage
from strandlog.plans import logview
from strandlog.plans.config import FIRST, MatcherConfig
from strandlog.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LOGS = f"logs as ({logview.LOGS_SQL})"
SYSLOG = f"lines as ({logview.SYSLOG_SQL})"
ORG, STREAM, START, END = "org-1", "stream-2", "1990-01-01 00:00:00", "2100-01-01 00:00:00"
SEP = "chr(31)"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f
    return register


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def joined(c) -> F.Column:
    return F.array_join(c, "\x1f")


# ---- matching


def matched_sql(config: MatcherConfig | None = None, weighted: bool = True, threshold: float | None = None, m: matcher.Matcher | None = None) -> str:
    """CTEs logs, hits(line_id, fragment), scored and matched(logs columns, template_id, score)."""
    m = m or logview.catalogue(config)
    threshold = m.config.fragment_match_threshold if threshold is None else threshold
    shares = ", ".join(f"({q(f)}, {t}, {w!r}, {s!r})" for f, t, w, s in m.shares(weighted))
    distinct = "distinct " if weighted else ""
    return f"""{LOGS}, shares(fragment, template_id, weight, total) as (values {shares}),
hits as (select {distinct}line_id, fragment from (select line_id, unnest(regexp_extract_all(message, {q(m.regex)}, 0)) as fragment from logs)),
scored as (select line_id, template_id, round(sum(weight::double) / any_value(total::double), 9) as score from hits join shares using (fragment) group by 1, 2),
best as (select line_id, template_id, score from scored qualify row_number() over (partition by line_id order by score desc, template_id) = 1),
matched as (select logs.*, best.template_id, best.score from logs left join best on best.line_id = logs.line_id and best.score >= {threshold})"""


MATCHED = matched_sql()
_RESULT = "select line_id, template_id::bigint as template_id, round(score, 6) as score from matched"


def matched_logs(spark: SparkSession, sf_dir: str, config: MatcherConfig | None = None) -> DataFrame:
    return matcher.match_templates(logview.logs(spark, sf_dir), logview.catalogue(config))


def _scores(df: DataFrame) -> DataFrame:
    return df.select("line_id", "template_id", F.round("score", 6).alias("score"))


@query(f"with {MATCHED} {_RESULT}")
def match_templates(spark, sf_dir):
    return _scores(matched_logs(spark, sf_dir))


@query(f"with {matched_sql(MatcherConfig(FIRST))} {_RESULT}")
def match_leftmost_first(spark, sf_dir):
    return _scores(matched_logs(spark, sf_dir, MatcherConfig(FIRST)))


@query(f"with {matched_sql(MatcherConfig(min_fragment_length=5))} {_RESULT}")
def match_min_length(spark, sf_dir):
    return _scores(matched_logs(spark, sf_dir, MatcherConfig(min_fragment_length=5)))


@query(f"with {matched_sql(MatcherConfig(fragment_match_threshold=0.9))} {_RESULT}")
def match_threshold(spark, sf_dir):
    return _scores(matched_logs(spark, sf_dir, MatcherConfig().with_fragment_threshold(0.9)))


def _demo_catalogue() -> matcher.Matcher:
    m = matcher.Matcher(MatcherConfig(FIRST, 2))
    for t in sorted(logview.catalogue().templates.values(), key=lambda t: t.template_id):
        m = m.add(t)
    return m


@query(f"with {matched_sql(weighted=False, threshold=0.7, m=_demo_catalogue())} {_RESULT}")
def demo_match(spark, sf_dir):
    return _scores(matcher.demo_match(logview.logs(spark, sf_dir), logview.catalogue()))


@query(f"with {LOGS}, h as (select line_id, regexp_extract_all(message, {q(logview.catalogue().regex)}, 0) as h from logs) select line_id, len(h)::bigint as n_hits, array_to_string(h, {SEP}) as hits from h")
def match_hits(spark, sf_dir):
    rows = logview.logs(spark, sf_dir).select("line_id", matcher.hits(F.col("message"), logview.catalogue()).alias("h"))
    return rows.select("line_id", F.size("h").cast("long").alias("n_hits"), joined("h").alias("hits"))


@query(f"""with {LOGS}, h as (select line_id, message, unnest(regexp_extract_all(message, {q(logview.catalogue().regex)}, 0)) as f from logs)
select f as fragment, count(*) as n, sum(length(f))::bigint as chars from h group by 1""")
def hit_positions(spark, sf_dir):
    """Places of hits: each hit's text is what stands at its place."""
    logs = logview.logs(spark, sf_dir)
    rows = matcher.hit_rows(logs, logview.catalogue()).join(logs.select("line_id", "message"), "line_id")
    there = F.expr("substring(message, start + 1, stop - start)")
    return rows.groupBy(there.alias("fragment")).agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).cast("long").alias("chars"))


@query(f"with {MATCHED} select line_id, template_id::bigint as template_id, round(score, 6) as score from matched where template_id is not null")
def best_template(spark, sf_dir):
    """The relational form: fragment join and arg-max."""
    found = matcher.match_by_join(logview.logs(spark, sf_dir), logview.catalogue(), spark)
    return found.select("line_id", "template_id", F.round("score", 6).alias("score"))


@query(f"with {MATCHED} select h.line_id, h.fragment, s.template_id::bigint as template_id, round(s.weight::double, 6) as weight from hits h join shares s using (fragment)")
def frag_join(spark, sf_dir):
    shares = spark.createDataFrame(logview.catalogue().shares(), "fragment string, template_id long, weight double, total double")
    rows = logview.logs(spark, sf_dir).select("line_id", F.explode(F.array_distinct(matcher.hits(F.col("message"), logview.catalogue()))).alias("fragment"))
    return rows.join(F.broadcast(shares), "fragment").select("line_id", "fragment", "template_id", F.round("weight", 6).alias("weight"))  # the catalogue's fragments


# The fragments that the catalogue's patterns must give, in order.
_EXPECTED_FRAGMENTS = {
    1: ["cpu_usage: ", "% - "], 2: ["memory_usage: ", "GB - "], 3: ["disk_io: ", "MB/s - "],
    10: ["sshd(pam_unix)[", "]: authentication failure; logname=", " uid=", " rhost="], 11: ["generic log with uid=", " and tty=", " somewhere"],
    30: ["Transaction ", " completed successfully with amount "], 31: ["Transaction ", " completed with warnings: "], 40: ["Request ", " completed in ", "ms with status "],
    50: ["pair ", " and ", " and "], 60: ["twin "], 61: ["twin "],
}


@query(f"""select template_id::bigint as template_id, ordinal::int as ordinal, fragment from (values {', '.join(f"({t}, {i}, {q(f)})" for t, fs in _EXPECTED_FRAGMENTS.items() for i, f in enumerate(fs))}) as v(template_id, ordinal, fragment)""")
def template_fragments(spark, sf_dir):
    return matcher.template_fragments(logview.catalogue(), spark).drop("weight")


_GENERIC_SQL = " or ".join(f"t = {q(p)} or (n < 8 and contains(t, {q(p)}))" for p in fragments.GENERIC_PATTERNS)
_MARK_SQL = " or ".join(f"contains(lower(message), {q(p)})" for p in fragments.DISTINCTIVE)


@query(rf"""with {LOGS}, f as (select distinct message, trim(message) as t, octet_length(encode(trim(message))) as n, octet_length(encode(message))::double as size from logs)
select message, round(least(1.0, (case when size < 5 then size / 20 when size < 20 then 0.25 + (size - 5) / 15 * 0.5 else 0.75 + least((size - 20) / 40, 0.25) end)
 * (0.2 + 0.8 * (len(regexp_extract_all(message, '[\p{{L}}\p{{N}}]')) / size)) * (case when n < 4 or {_GENERIC_SQL} then 0.3 else 1 end) * (case when {_MARK_SQL} then 1.5 else 1 end))::double, 6) as weight from f""")
def fragment_weights(spark, sf_dir):
    return logview.logs(spark, sf_dir).select("message").distinct().select("message", F.round(fragments.weight_column(F.col("message")), 6).alias("weight"))


# ---- storage queries


_RANGE = f"org_id = '{ORG}' and log_stream_id = '{STREAM}' and timestamp >= timestamp '{START}' and timestamp <= timestamp '{END}'"


@query(f"""with {MATCHED}, rows as (select coalesce(template_id::varchar, '') as template_id, timestamp, line_id, message from matched where {_RANGE}),
top as (select template_id, count(*) as log_count from rows group by 1 order by 2 desc, 1 limit 20),
first as (select * from rows qualify row_number() over (partition by template_id order by timestamp, line_id) <= 5)
select top.template_id, top.log_count, string_agg(first.message, {SEP} order by timestamp, line_id) as sample_messages, 0.0::double as relative_change from top join first using (template_id) group by 1, 2""")
def logs_grouped(spark, sf_dir):
    out = storage.query_logs_grouped(matched_logs(spark, sf_dir), ORG, STREAM, START, END)
    return out.withColumn("sample_messages", joined("sample_messages"))


@query(f"with {MATCHED} select line_id, coalesce(template_id::varchar, '') as template_id, (epoch_us(timestamp) // 1000)::bigint as ts_ms, message from matched where {_RANGE} order by timestamp desc, line_id limit 10000")
def query_logs(spark, sf_dir):
    out = storage.query_logs(matched_logs(spark, sf_dir), ORG, STREAM, START, END)
    return out.select("line_id", F.coalesce(F.col("template_id").cast("string"), F.lit("")).alias("template_id"), F.unix_millis(F.col("timestamp").cast("timestamp")).alias("ts_ms"), "message")


@query(f"with {MATCHED} select line_id, (epoch_us(timestamp) // 1000)::bigint as ts_ms, message from matched where {_RANGE} and template_id = 40 order by timestamp desc, line_id limit 10")
def template_examples(spark, sf_dir):
    rows = matched_logs(spark, sf_dir).withColumn("template_id", F.col("template_id").cast("string"))
    return storage.template_examples(rows, ORG, STREAM, "40", 10).select("line_id", F.unix_millis(F.col("timestamp").cast("timestamp")).alias("ts_ms"), "message")


@query("select p_partkey as template_id, p_name as pattern, p_brand as org_id from part where p_brand = 'Brand#12' order by 1")
def templates_for_stream(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("template_id"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("org_id"), F.col("p_brand").alias("log_stream_id"))
    return catalog.templates_for_stream(rows, "Brand#12", "Brand#12").drop("log_stream_id")


@query("select coalesce(max(p_partkey), 0)::bigint as max_template_id from part")
def max_template_id(spark, sf_dir):
    return catalog.max_template_id(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("template_id")))


@query("""with k as (select p_partkey, case when p_partkey % 4 = 0 then 0 else p_partkey end as template_id, p_name from part)
select p_name as pattern, p_partkey as seq, case when template_id = 0 then (select max(template_id) from k) + row_number() over (partition by template_id = 0 order by p_partkey) else template_id end::bigint as template_id from k""")
def insert_template_ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(F.col("p_partkey") % 4 == 0, F.lit(0)).otherwise(F.col("p_partkey")).cast("long").alias("template_id"), F.col("p_name").alias("pattern"), F.col("p_partkey").alias("seq"))
    return catalog.assign_ids(rows, rows, "seq")


@query("""select template_id, pattern, version from (select user_id as template_id, event_type as pattern, event_id as version, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1""")
def upsert_template(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("template_id"), F.col("event_type").alias("pattern"), F.col("event_id").alias("version"))
    return catalog.upsert(rows)


@query("select p_brand as dataset, p_partkey as pos, row_number() over (order by p_brand, p_partkey) as new_template_id from part")
def rekey_templates(spark, sf_dir):
    return catalog.rekey(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("pos")))


@query(f"""select template_id::bigint as template_id, pattern, variables from (values {', '.join(f"({t.template_id}, {q(t.pattern)}, {q(','.join(t.variables))})" for t in (*map(lambda r: matcher.Template(*r), matcher.SEEDS), *logview.TEMPLATES))}) as v(template_id, pattern, variables)""")
def template_catalog(spark, sf_dir):
    return logview.catalogue().dataframe(spark).select("template_id", "pattern", F.array_join("variables", ",").alias("variables"))


@query(f"with {MATCHED} select line_id, coalesce(template_id::varchar, '') as template_id, (epoch_us(timestamp) // 1000 % 1000)::bigint as ms, org_id, message from matched")
def log_sink(spark, sf_dir):
    """Rows as the log table stores them."""
    rows = matched_logs(spark, sf_dir).withColumn("log_stream_name", F.col("line_id").cast("string"))
    out = storage.to_log_rows(rows)
    return out.select(F.col("log_stream_name").cast("long").alias("line_id"), "template_id", (F.unix_millis("timestamp") % 1000).alias("ms"), "org_id", "message")


# ---- sources and joins


@query(f"with {LOGS} select line_id, message, org_id, log_stream_id from logs")
def scan_raw_log(spark, sf_dir):
    return logview.logs(spark, sf_dir).select("line_id", "message", "org_id", "log_stream_id")


@query(f"with {LOGS} select a.line_id, a.message as log_line, b.event_id from logs a join (select event_id as line_id, event_type as event_id from events) b using (line_id)")
def positional_join(spark, sf_dir):
    """Every line with its truth."""
    truth = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("line_id"), F.col("event_type").alias("event_id"))
    return evaluate.with_truth(logview.logs(spark, sf_dir).select("line_id", F.col("message").alias("log_line")), truth)


@query(f"with {LOGS}, t(event_id, template) as (values ('error', 'T-error'), ('view', 'T-view')) select line_id, logs.event_id, t.template as expected_template from logs left join t on t.event_id = logs.event_id")
def template_lookup(spark, sf_dir):
    known = spark.createDataFrame([("error", "T-error"), ("view", "T-view")], "event_id string, expected_template string")
    return logview.logs(spark, sf_dir).select("line_id", "event_id").join(F.broadcast(known), "event_id", "left")  # two rows


@query(f"with {MATCHED} select line_id, message from matched where template_id is null")
def unmatched(spark, sf_dir):
    return matched_logs(spark, sf_dir).where("template_id is null").select("line_id", "message")


@query(f"with {MATCHED} select line_id, event_id, org_id from logs where line_id in (select line_id from matched where template_id is not null)")
def matched_semi(spark, sf_dir):
    logs = logview.logs(spark, sf_dir).select("line_id", "event_id", "org_id")
    return logs.join(matched_logs(spark, sf_dir).where("template_id is not null").select("line_id"), "line_id", "left_semi")


@query("select event_type as event_id, 'T-' || max(event_id) filter (where event_id % 3 <> 0) as template from events group by 1")
def templates_from_gt(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("line_id"), F.col("event_type").alias("event_id"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("T-"), F.col("event_id").cast("string"))).alias("expected_template"))
    return catalog.from_ground_truth(rows)


@query("select count(distinct event_type)::bigint as expected_templates from events")
def expected_template_count(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.countDistinct("event_type").alias("expected_templates"))


@query("select event_id as line_id, event_type from events where event_id < 100")
def head_n(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 100").select(F.col("event_id").alias("line_id"), "event_type")


@query(f"with {LOGS}, {SYSLOG} select 'a' as dataset, line_id, message from logs union all select 'b', line_id, message from lines")
def union_datasets(spark, sf_dir):
    one = lambda df, name: df.select(F.lit(name).alias("dataset"), "line_id", "message")
    return one(logview.logs(spark, sf_dir), "a").unionByName(one(logview.syslog_lines(spark, sf_dir), "b"))


@query("select event_type as event_id from events where event_id % 2 = 0 union select event_type from events where event_id % 2 = 1")
def template_set_union(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.where("event_id % 2 = 0").select(F.col("event_type").alias("event_id")).union(e.where("event_id % 2 = 1").select("event_type")).distinct()


@query(f"with {MATCHED} select line_id, template_id::bigint as template_id from matched where template_id is not null and ('0x' || substr(md5(line_id::varchar), 1, 8))::bigint % 100 < 1")
def sample_examples(spark, sf_dir):
    return split.hash_sample(matched_logs(spark, sf_dir).where("template_id is not null"), "line_id", 1, 100).select("line_id", "template_id")


_LITERALS = ("uid=", "ms", "completed", "load", "on", "00")


@query(f"""with {LOGS}, f(literal) as (values {', '.join(f"({q(x)})" for x in _LITERALS)}),
p as (select message, unnest(generate_series(1, length(message))) as i, line_id from logs)
select p.line_id, f.literal, count(*) as n, min(p.i - 1)::bigint as first_start from p join f on substr(p.message, p.i, length(f.literal)) = f.literal group by 1, 2""")
def substring_search(spark, sf_dir):
    """All occurrences of literals, overlapping ones too."""
    rows = logview.logs(spark, sf_dir).select("line_id", "message", F.explode(F.array(*[F.lit(x) for x in _LITERALS])).alias("literal"))
    at = F.filter(F.sequence(F.lit(1), F.char_length("message")), lambda i: F.col("message").substr(i, F.char_length("literal")) == F.col("literal"))
    return rows.withColumn("at", at).where(F.size("at") > 0).select("line_id", "literal", F.size("at").cast("long").alias("n"), (F.array_min("at") - 1).cast("long").alias("first_start"))


@query("select event_id, user_id from events where user_id in (select c_custkey from customer where c_acctbal < 0)")
def bloom_member(spark, sf_dir):
    """Membership: Spark puts a runtime Bloom filter in front of the semi-join itself where that pays."""
    members = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id").join(members, "user_id", "left_semi")


# ---- evaluation


_COUNTS = """counts as (select event_id, template_id, count(*) as n from matched group by 1, 2),
major as (select event_id, template_id as majority from counts where template_id is not null qualify row_number() over (partition by event_id order by n desc, template_id) = 1),
judged as (select counts.*, majority from counts left join major using (event_id))"""


def _accuracy_sql(denominator: str) -> str:
    good = "coalesce(sum(n) filter (where template_id = majority), 0)"
    return f"""with {MATCHED}, {_COUNTS} select {good}::bigint as correct, coalesce(sum(n) filter (where template_id is not null and (majority is null or template_id <> majority)), 0)::bigint as incorrect,
coalesce(sum(n) filter (where template_id is null), 0)::bigint as unmatched, round(100.0::double * {good} / nullif({denominator}, 0), 6) as accuracy from judged"""


@query(f"with {MATCHED} select count(*) as total, count(template_id) as matched, round(100.0::double * count(template_id) / count(*), 6) as match_rate from matched")
def match_rate(spark, sf_dir):
    return evaluate.match_rate(matched_logs(spark, sf_dir))


@query(_accuracy_sql("sum(n)"))
def group_accuracy_runner(spark, sf_dir):
    return evaluate.accuracy_over_all(matched_logs(spark, sf_dir))


@query(_accuracy_sql("sum(n) filter (where majority is not null)"))
def group_accuracy_bench(spark, sf_dir):
    return evaluate.accuracy_over_grouped(matched_logs(spark, sf_dir))


@query(_accuracy_sql("sum(n) filter (where template_id is not null)"))
def group_accuracy_matched(spark, sf_dir):
    return evaluate.accuracy_over_matched(matched_logs(spark, sf_dir))


@query(f"""with {MATCHED}, {_COUNTS}, e as (select event_id, count(*) as k from counts group by 1), t as (select template_id, count(*) as k from counts where template_id is not null group by 1)
select round(100.0::double * coalesce(sum(n) filter (where e.k = 1 and t.k = 1), 0) / sum(n), 6) as strict_accuracy from counts join e using (event_id) left join t using (template_id)""")
def strict_group_accuracy(spark, sf_dir):
    return evaluate.strict_group_accuracy(matched_logs(spark, sf_dir))


@query(f"with {LOGS} select count(distinct event_id)::bigint as groups from logs")
def distinct_groups(spark, sf_dir):
    return evaluate.distinct_groups(logview.logs(spark, sf_dir))


@query("""with r as (select event_type as dataset, count(*) as logs, sum(value) as seconds, avg(value) as accuracy from events group by 1)
select sum(logs)::bigint as total_logs, round(sum(seconds), 6) as total_seconds, round(sum(logs) / sum(seconds), 6) as overall_throughput, round(avg(logs / seconds), 6) as avg_throughput, round(avg(accuracy), 6) as avg_accuracy from r""")
def throughput_summary(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("logs"), F.sum("value").alias("seconds"), F.avg("value").alias("accuracy"))
    return evaluate.throughput_summary(runs)


@query(f"""with {MATCHED}, {_COUNTS}, s as (select event_id, sum(n)::bigint as event_size from counts group by 1 order by 2 desc, 1 limit 10),
r as (select event_id, template_id, n, row_number() over (partition by event_id order by n desc, template_id) as rank from counts where template_id is not null)
select event_id, event_size, rank, template_id::bigint as template_id, n, round(100.0::double * n / event_size, 6) as share from s join r using (event_id) where rank <= 3""")
def top_groups(spark, sf_dir):
    return evaluate.top_groups(matched_logs(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {MATCHED} select coalesce(template_id::varchar, '') as template_id, count(*) as log_count from matched group by 1 order by 2 desc, 1 limit 3")
def topk_groups(spark, sf_dir):
    rows = matched_logs(spark, sf_dir)
    groups = rows.groupBy(F.coalesce(F.col("template_id").cast("string"), F.lit("")).alias("template_id")).agg(F.count("*").alias("log_count"))
    return groups.orderBy(F.desc("log_count"), "template_id").limit(3)


# ---- splits


_TAKE = "greatest(case when n - floor(n * 0.8::double) < 1 then greatest(n - 1, 0) else floor(n * 0.8::double) end, least(1, n - 1))"


@query(f"""with {LOGS}, r as (select line_id, event_id, count(*) over (partition by event_id) as n, row_number() over (partition by event_id order by md5('42-' || line_id), line_id) as k from logs)
select line_id, event_id, k <= {_TAKE} as is_train from r""")
def stratified_split(spark, sf_dir):
    return split.stratified_split(logview.logs(spark, sf_dir).select("line_id", "event_id"))


@query(f"""with {LOGS}, r as (select line_id, event_id, count(*) over () as n, row_number() over (order by md5('42-' || line_id), line_id) as k from logs)
select line_id, event_id, k <= floor(n * 0.8::double) as is_train from r""")
def random_split(spark, sf_dir):
    return split.random_split(logview.logs(spark, sf_dir).select("line_id", "event_id"))


@query(f"""with {LOGS}, r as (select event_id, count(*) over (partition by event_id) as n, row_number() over (partition by event_id order by md5('42-' || line_id), line_id) as k from logs), s as (select event_id, k <= {_TAKE} as t from r)
select count(*) filter (where t) as train_size, count(*) filter (where not t) as test_size, count(distinct event_id) filter (where t) as train_templates, count(distinct event_id) filter (where not t) as test_templates,
 count(distinct event_id) as total_templates, round((count(*) filter (where t))::double / count(*), 6) as train_ratio, round((count(*) filter (where not t))::double / count(*), 6) as test_ratio from s""")
def split_stats(spark, sf_dir):
    return split.split_stats(split.stratified_split(logview.logs(spark, sf_dir).select("line_id", "event_id")))


@query("select turn, event_type as source, event_id as line_id from (select event_type, event_id, row_number() over (partition by event_type order by event_id) - 1 as turn from events) where turn < 500")
def round_robin(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("source"), F.col("event_id").alias("line_id"))
    return split.round_robin(rows, "source", "line_id").select(F.col("turn").cast("long").alias("turn"), "source", "line_id")


# ---- formats, tokens and templates


_FORMAT = rf"""case when regexp_matches(message, {q(formats.SYSLOG)}) then 'syslog' when regexp_matches(message, {q(formats.ISO)}) then 'iso_timestamp'
 when {' or '.join(f"length(message) - length(replace(message, {q(d)}, '')) >= 3" for d in formats.DELIMITERS)} then 'custom_delimited' else 'unstructured' end"""


@query(rf"""with {SYSLOG}, f as (select *, {_FORMAT} as format from lines)
select line_id, format, case when format = 'syslog' then contains(message, '[') and contains(message, ']: ') end as has_pid,
 case when format in ('custom_delimited', 'unstructured') then case {' '.join(f"when length(message) - length(replace(message, {q(d)}, '')) >= 3 then {q(d)}" for d in formats.DELIMITERS)} end end as delimiter from f""")
def detect_format(spark, sf_dir):
    return logview.syslog_lines(spark, sf_dir).select("line_id", formats.detect_format(F.col("message")).alias("f")).select("line_id", "f.*")


@query(f"""with {SYSLOG} select line_id, {', '.join(f"case when regexp_matches(message, {q(formats.SYSLOG_FIELDS)}) then {'nullif(' if n == 'pid' else ''}regexp_extract(message, {q(formats.SYSLOG_FIELDS)}, {i}){", '')" if n == 'pid' else ''} end as {n}" for i, n in enumerate(formats.FIELD_NAMES, 1))} from lines""")
def syslog_fields(spark, sf_dir):
    return logview.syslog_lines(spark, sf_dir).select("line_id", formats.syslog_fields(F.col("message")).alias("f")).select("line_id", "f.*")


@query(rf"""with {LOGS}, v as (select line_id, list_filter([case when length(message) - length(replace(message, '.', '')) = 3 then 'ip_address' end, case when regexp_matches(message, '\d+\.\d+') then 'decimal_value' end,
 case when regexp_matches(message, '\b\d+\b') then 'number' end], lambda x: x is not null) as v from logs) select line_id, case when len(v) = 0 then 'message' else array_to_string(v, ',') end as variables from v""")
def msg_variables(spark, sf_dir):
    return logview.logs(spark, sf_dir).select("line_id", F.array_join(templates.message_variables(F.col("message")), ",").alias("variables"))


def _mask_sql(text: str) -> str:
    for kind, shape, _ in templates.VARIABLE_SHAPES:
        text = f"regexp_replace({text}, {q(shape)}, '<{kind}>', 'g')"
    return text


@query(f"with {LOGS} select {_mask_sql('message')} as masked, count(*) as n from logs group by 1")
def mask_message(spark, sf_dir):
    return logview.logs(spark, sf_dir).groupBy(templates.mask_message(F.col("message")).alias("masked")).agg(F.count("*").alias("n"))


def _list_sql(source: str, key: str, text: str, expression: str) -> str:
    return f"with {LOGS} select {key}, len(t)::bigint as n, array_to_string(t, {SEP}) as tokens from (select {key}, {expression.format(text)} as t from {source})"


def _tokens(df: DataFrame, key: str, c) -> DataFrame:
    return df.select(key, c.alias("t")).select(key, F.size("t").cast("long").alias("n"), joined("t").alias("tokens"))


def _split_sql(delimiters: str) -> str:
    return f"list_filter(regexp_split_to_array({{}}, {q(delimiters).replace('{', '{{').replace('}', '}}')}), lambda x: x <> '')"


@query(_list_sql("pages", "page_id", "url", f"regexp_extract_all({{}}, {q(tokens.CHAR_CLASSES)})"))
def char_class_tokens(spark, sf_dir):
    return _tokens(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", tokens.char_class_tokens(F.col("url")))


@query(_list_sql("documents", "doc_id", "text", _split_sql(tokens.FRAGMENT_DELIMITERS)))
def tokenize_fragment(spark, sf_dir):
    return _tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", tokens.tokenize_fragments(F.col("text")))


@query(_list_sql("documents", "doc_id", "text", _split_sql(tokens.SEMANTIC_DELIMITERS)))
def tokenize_semantic(spark, sf_dir):
    return _tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", tokens.tokenize_semantic(F.col("text")))


@query(r"""select item_id, replace(replace(regexp_replace(t, '([.^$|?+(){}\\\[\]])', '\\\1', 'g'), '<*>', '[\s\S]+?'), '<*', '<\*') as pattern
from (select item_id, replace(text, ' th', ' <*> (th*') as t from benchmark)""")
def loghub_regex(spark, sf_dir):
    t = F.replace(F.col("text"), F.lit(" th"), F.lit(" <*> (th*"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", templates.loghub_regex(t).alias("pattern"))


@query(f"select page_id, regexp_replace(url, {q(templates.ESCAPED_CHARS)}, '\\\\\\1', 'g') as escaped from pages")
def regex_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", templates.regex_escape(F.col("url")).alias("escaped"))


def _words(words) -> str:
    return q("(?:" + "|".join(words) + ")")


_STATIC_SQL = f"(regexp_matches(lower({{t}}), {_words(tokens.SERVICES + tokens.ACTIONS)}) or regexp_matches(lower({{t}}), {q('^(?:' + '|'.join(tokens.FIELDS) + ')=?$')}) or {{t}} = '')"
_EPHEMERAL_SQL = "(" + " or ".join(f"regexp_matches({{t}}, {q(x)})" for x in tokens.EPHEMERAL) + ")"
_TYPE_SQL = (f"case when regexp_matches(lower({{t}}), {_words(tokens.USER_HINTS)}) then 'user' when contains({{t}}, '.') and regexp_matches({{t}}, '\\p{{L}}') then 'location' when starts_with({{t}}, '/') then 'resource' "
             "when regexp_matches({t}, '^(?:ERR|OK)') or {t} in ('200', '404', '500') then 'action' else 'generic' end")
_CLASS_SQL = f"case when {_STATIC_SQL} then 'static' when {_EPHEMERAL_SQL} then 'ephemeral' else {_TYPE_SQL} end"
_CLASS_SQL = _CLASS_SQL.replace("{t}", "\0").replace("{{", "{").replace("}}", "}")


def class_sql(t: str) -> str:
    return _CLASS_SQL.replace("\0", t)


_FRAGMENTS_OF = f"list_filter(regexp_split_to_array(message, {q(tokens.FRAGMENT_DELIMITERS)}), lambda x: x <> '')"
_SEMANTIC_OF = f"list_filter(regexp_split_to_array(message, {q(tokens.SEMANTIC_DELIMITERS)}), lambda x: x <> '')"


@query(f"with {LOGS}, {SYSLOG}, t as (select unnest({_FRAGMENTS_OF}) as token from (select message from logs union all select message from lines)) select token, {class_sql('token')} as class, count(*) as n from t group by 1")
def classify_token(spark, sf_dir):
    both = logview.logs(spark, sf_dir).select("message").union(logview.syslog_lines(spark, sf_dir).select("message"))
    rows = both.select(F.explode(tokens.tokenize_fragments(F.col("message"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n")).select("token", tokens.classify_token(F.col("token")).alias("class"), "n")


_CONTEXT_SQL = "case " + " ".join(f"when regexp_matches(lower(ctx), {_words(h)}) then '{k}'" for k, h in tokens.CONTEXT_HINTS)


@query(f"""with t as (select distinct event_type as token, case user_id % 5 when 0 then 'UserName' when 1 then 'file' when 2 then 'exit code' when 3 then 'Server' else '' end as ctx from events)
select token, ctx, {_CONTEXT_SQL} else 'generic' end as type from t""")
def parameter_context(spark, sf_dir):
    ctx = F.element_at(F.array(*[F.lit(x) for x in ("UserName", "file", "exit code", "Server", "")]), (F.col("user_id") % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("token"), ctx.alias("ctx")).distinct()
    return rows.select("token", "ctx", tokens.parameter_type(F.col("token"), F.col("ctx")).alias("type"))


@query(f"with {LOGS} select line_id, array_to_string(list_filter({_FRAGMENTS_OF}, lambda t: {class_sql('t')} = 'static'), ' ') as signature from logs")
def log_type_signature(spark, sf_dir):
    return logview.logs(spark, sf_dir).select("line_id", tokens.log_type_signature(tokens.tokenize_fragments(F.col("message"))).alias("signature"))


@query(f"""with {LOGS} select line_id, array_to_string(list_transform(list_filter({_FRAGMENTS_OF}, lambda t: {class_sql('t')} <> 'ephemeral'),
 lambda t: case when {class_sql('t')} = 'static' then t else '<' || upper({class_sql('t')}[1]) || {class_sql('t')}[2:] || '>' end), ' ') as signature from logs""".replace("upper(case", "upper((case").replace("end[1])", "end)[1])").replace("|| case", "|| (case").replace("end[2:]", "end)[2:]"))
def template_signature(spark, sf_dir):
    return logview.logs(spark, sf_dir).select("line_id", tokens.template_signature(tokens.tokenize_fragments(F.col("message"))).alias("signature"))


_KEYWORD_SQL = f"regexp_matches(t, {_words(tokens.SEMANTIC_KEYWORDS)})"
_LIKELY_SQL = r"(t <> '' and (regexp_matches(t, '\p{N}') or regexp_matches(t, '[./-]') or octet_length(encode(t)) > 2))"
_INFER_SQL = (r"case when regexp_matches(t, '^\d+\.\d+\.\d+\.\d+$') then 'ip_address' when contains(t, '.') and regexp_matches(t, '\p{L}') then 'hostname' when regexp_matches(t, '^\p{N}*$') then 'number' "
              r"when starts_with(t, '/') then 'path' when regexp_matches(t, '^\d{2}:\d{2}:\d{2}$') then 'time' when t in (" + ", ".join(q(m) for m in tokens.MONTHS) + ") then 'month' else 'value' end")


@query(f"""with {LOGS}, t as (select line_id, unnest({_SEMANTIC_OF}) as t, generate_subscripts({_SEMANTIC_OF}, 1) as i from logs),
k as (select line_id, string_agg(t, {SEP} order by i) as keywords from t where {_KEYWORD_SQL} group by 1),
p as (select line_id, {_INFER_SQL} as p, min(i) as i from t where not {_KEYWORD_SQL} and {_LIKELY_SQL} group by 1, 2), j as (select line_id, string_agg(p, {SEP} order by i) as parameters from p group by 1)
select logs.line_id, coalesce(keywords, '') as keywords, coalesce(parameters, '') as parameters from logs left join k using (line_id) left join j using (line_id)""")
def classify_tokens(spark, sf_dir):
    rows = logview.logs(spark, sf_dir).select("line_id", generate.semantic_template(F.col("message")).alias("s"))
    return rows.select("line_id", joined("s.keywords").alias("keywords"), joined("s.parameters").alias("parameters"))


@query(f"with t as (select distinct unnest(list_filter(regexp_split_to_array(text, {q(tokens.SEMANTIC_DELIMITERS)}), lambda x: x <> '')) as t from documents) select {_INFER_SQL} as type, count(*) as n from t group by 1")
def infer_param_type(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(tokens.tokenize_semantic(F.col("text"))).alias("t")).distinct()
    return rows.groupBy(tokens.infer_parameter_type(F.col("t")).alias("type")).agg(F.count("*").alias("n"))


@query(f"select distinct event_type as name, case when lower(event_type) in ({', '.join(q(x) for x in tokens.FRAGMENT_TYPES)}) then lower(event_type) else 'static_text' end as type from events union select 'PID', 'pid' union select 'Ip_Address', 'ip_address'")
def fragment_type(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name")).distinct().union(spark.createDataFrame([("PID",), ("Ip_Address",)], "name string"))
    return names.select("name", tokens.fragment_type(F.col("name")).alias("type"))


@query("""with r as (select event_id, 'Sure: ["' || event_type || '", "' || user_id || '"] done' as reply from events)
select event_id, array_to_string(from_json(regexp_extract(reply, '(?s)\\[.*\\]', 0), '["VARCHAR"]'), ',') as classes from r""".replace("\\\\", "\\"))
def parse_llm_array(spark, sf_dir):
    reply = F.concat(F.lit('Sure: ["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"] done'))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(templates.parse_classes(reply), ",").alias("classes"))


@query(r"""with r as (select event_id, case event_id % 3 when 0 then 'x {"pattern": "^' || event_type || '$", "variables": ["a", "b"]} y' when 1 then '{"variables": []}' else 'no object' end as reply, event_type as line from events),
j as (select event_id, line, nullif(regexp_extract(reply, '(?s)\{.*\}', 0), '') as body from r)
select event_id, case when body is not null then coalesce(json_extract_string(body, '$.pattern'), line) end as pattern, case when body is not null then coalesce(array_to_string(from_json(json_extract(body, '$.variables'), '["VARCHAR"]'), ','), '') end as variables from j""")
def parse_llm_template(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('x {"pattern": "^'), "event_type", F.lit('$", "variables": ["a", "b"]} y'))).when(F.col("event_id") % 3 == 1, '{"variables": []}').otherwise("no object")
    rows = e.select("event_id", templates.parse_template(reply, F.col("event_type")).alias("t"))
    return rows.select("event_id", "t.pattern", F.array_join("t.variables", ",").alias("variables"))


# ---- generators


_VAR = learn.VARIABLES


def _case(column: str, index: int) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {q(v[index])}" for k, v in _VAR.items()) + " end"


@query(rf"""with {LOGS}, s as (select event_id || '-' || (line_id % 7) as g, message from logs), t as (select g, regexp_extract_all(message, {q(tokens.CHAR_CLASSES)}) as t from s),
r as (select g, unnest(t) as v, generate_subscripts(t, 1) as pos from t),
p as (select g, pos, min(v) as v, case when min(v) = max(v) then 'static' when bool_and(regexp_matches(v, '^[0-9]+$')) then case when bool_or(regexp_matches(v, '^[0-9]{{10}}$') and try_cast(v as bigint) <= 4294967295) then 'unix_timestamp' else 'number' end
 when bool_and(regexp_matches(v, '^[0-9A-Fa-f]+$')) then 'hex_number' when bool_or(regexp_matches(v, '^[^-]*-[^-]*-[^-]*-[^-]*-[^-]*$')) then 'uuid' else 'string' end as kind from r group by 1, 2),
n as (select *, {_case('kind', 1)} as name, row_number() over (partition by g, {_case('kind', 1)} order by pos) as nth from p)
select g, string_agg(case when kind = 'static' then regexp_replace(v, {q(templates.ESCAPED_CHARS)}, '\\\1', 'g') else {_case('kind', 0)} end, '' order by pos) as pattern,
 coalesce(string_agg(case when kind <> 'static' then name || case when nth > 1 then '_' || nth else '' end end, ',' order by pos), '') as variables from n group by g""")
def learn_pattern(spark, sf_dir):
    rows = logview.logs(spark, sf_dir).select(F.concat("event_id", F.lit("-"), (F.col("line_id") % 7).cast("string")).alias("g"), "message")
    return learn.learn_patterns(rows, "g").select("g", "pattern", F.array_join("variables", ",").alias("variables"))


@query()
def msg_pattern(spark, sf_dir):
    return logview.logs(spark, sf_dir).select("line_id", generate.message_pattern_udf(F.col("message")).alias("pattern"))


@query()
def smart_template(spark, sf_dir):
    return logview.syslog_lines(spark, sf_dir).select("line_id", generate.smart_template(F.col("message")).alias("t")).select("line_id", "t.pattern", F.array_join("t.variables", ",").alias("variables"))


@query()
def classified_pattern(spark, sf_dir):
    found = tokens.tokenize_fragments(F.col("message"))
    kinds = F.transform(found, lambda t: F.when(t.rlike("^[0-9]+$"), "number").when(t.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip_address").otherwise("static_text"))
    rows = logview.logs(spark, sf_dir).select("line_id", generate.classified_pattern_udf(found, kinds).alias("t"))
    return rows.select("line_id", "t.pattern", F.array_join("t.variables", ",").alias("variables"))


_CANDIDATES = """c as (select user_id as k, event_id as rank, case event_id % 4 when 0 then 'a  b' when 1 then 'a b ' when 2 then 'c' else event_type end as pattern from events)"""


def _candidates(spark, sf_dir):
    r = F.col("event_id") % 4
    pattern = F.when(r == 0, "a  b").when(r == 1, "a b ").when(r == 2, "c").otherwise(F.col("event_type"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("k"), F.col("event_id").alias("rank"), pattern.alias("pattern"))


@query(rf"""with {_CANDIDATES}, v as (select k, trim(regexp_replace(pattern, '\s+', ' ', 'g')) as norm, count(*) as votes, min(rank) as first_rank, arg_min(pattern, rank) as pattern from c group by 1, 2)
select k, pattern, votes, votes >= floor(n / 2) + 1 as agreed from (select *, sum(votes) over (partition by k) as n, row_number() over (partition by k order by votes desc, first_rank) as r from v) where r = 1""")
def consensus_template(spark, sf_dir):
    return generate.consensus(_candidates(spark, sf_dir), "k", "majority")


@query(f"with {_CANDIDATES} select k, arg_min(pattern, rank) as pattern from c where rank % 3 <> 0 group by 1")
def first_success(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("pattern", F.when(F.col("rank") % 3 != 0, F.col("pattern")))
    return generate.first_success(rows, "k")


# ---- ingestion


def _requests(spark, sf_dir):
    rows = logview.logs(spark, sf_dir)
    cols = ["org_id", "log_stream_id", "service", "region", "log_stream_name", "message"]
    one = F.struct(F.lit("2024-01-05T10:00:00.123Z").alias("timestamp"), *cols)
    many = rows.where("line_id % 2 = 0").groupBy((F.col("line_id") % 50).alias("g")).agg(F.to_json(F.struct(F.collect_list(one).alias("logs"))).alias("value")).select("value")
    return rows.where("line_id % 2 = 1").select(F.to_json(one).alias("value")).union(many)


@query(f"with {MATCHED} select coalesce(template_id::varchar, '') as template_id, org_id, count(*) as n, min(message) as first_message, 123::bigint as ms from matched group by 1, 2")
def ingest_batch(spark, sf_dir):
    """Single and batch requests through the whole path."""
    rows = ingest.ingest_rows(_requests(spark, sf_dir), logview.catalogue())
    return rows.groupBy("template_id", "org_id").agg(F.count("*").alias("n"), F.min("message").alias("first_message"), F.max(F.unix_millis("timestamp") % 1000).alias("ms"))


@query(f"with {MATCHED} select count(*) as accepted, count(template_id) as matched, 0::bigint as failed from matched")
def ingest_response(spark, sf_dir):
    return ingest.response(ingest.ingest_rows(_requests(spark, sf_dir), logview.catalogue()))


@query(f"with {MATCHED} select template_id::bigint as template_id, epoch_ms(time_bucket(interval '5 minutes', timestamp, timestamp '1970-01-01')) as window_ms, count(*) as log_count from matched group by 1, 2")
def windowed_counts(spark, sf_dir):
    rows = matched_logs(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return ingest.windowed_counts(rows).select("template_id", F.unix_millis("window.start").alias("window_ms"), "log_count")


@query(f"""with {MATCHED}, c as (select coalesce(template_id::varchar, '') as template_id, count(*) filter (where timestamp < timestamp '2024-01-15') as before, count(*) filter (where timestamp >= timestamp '2024-01-15') as now from matched where {_RANGE} group by 1)
select template_id, before, now, case when before > 0 then round((now - before)::double / before, 6) end as relative_change from c""")
def relative_change(spark, sf_dir):
    return storage.relative_change(matched_logs(spark, sf_dir), ORG, STREAM, (START, "2024-01-14 23:59:59.999999"), ("2024-01-15 00:00:00", END))


@query()
def throughput_run(spark, sf_dir):
    """Timed runs over two datasets; seconds differ from run to run, so only counts are kept."""
    sets = {"events": logview.logs(spark, sf_dir), "syslog": logview.syslog_lines(spark, sf_dir)}
    return runs.throughput_run(spark, sets, logview.catalogue()).select("dataset", "templates", "logs", "matched", "match_rate", "accuracy")


@query()
def match_or_generate(spark, sf_dir):
    """Templates by rules for unmatched shapes, then all lines again."""
    out, grown = runs.online_run(logview.logs(spark, sf_dir), logview.catalogue(), [generate.RuleGenerator()])
    return out.withColumn("templates", F.lit(len(grown.templates)))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
