"""The named queries: each operator over the views of the test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from workloom.functions.ids import stable_uuid
from workloom.functions.payload import canonical_payload
from workloom.functions.text import (
    first_non_blank, header, header_keys, merge_arrays, merge_changes, with_header,
)
from workloom.functions.timing import epoch_micros
from workloom.operators import (
    changes, checks, handlers, ingest, lifecycle, logs, lookup, metrics, pages, stored, traces,
)
from workloom.plans.views import stream_view, view
from workloom.session import fresh_path, use_rocksdb_state
from workloom.sources import bucketed, deadletters, export, loglines, messages, tables
from workloom.streaming import jobs
from workloom.streaming.redelivery import stream_redelivery
from workloom.streaming.replay import stream_replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DELIVERY_ORDER = ["delivered_at", "attempt", "tie"]
UPDATE_ORDER = ["requested_at", "tie1", "tie2"]
EXECUTION_ORDER = ["started_at", "tie"]


def query(build: Query) -> Query:
    QUERIES[build.__name__.removesuffix("_query")] = build
    return build


def _naive(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the test tables have them."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema])


def _effects(spark, sf_dir):
    return lifecycle.effects(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "deliveries"), DELIVERY_ORDER)


# Sources and sinks

@query
def scan_tasks(spark, sf_dir):
    path = fresh_path(spark, "tasks")
    tables.write_tasks(view(spark, sf_dir, "tasks"), path)
    return _naive(tables.read_tasks(spark, path))


@query
def scan_executions(spark, sf_dir):
    path = fresh_path(spark, "executions")
    tables.write_executions(view(spark, sf_dir, "execution_attempts"), path)
    return _naive(tables.read_executions(spark, path))


@query
def subject_match(spark, sf_dir):
    return messages.filter_subjects(view(spark, sf_dir, "task_messages"), "tasks.*").select("seq", "subject")


@query
def publish_messages(spark, sf_dir):
    path = fresh_path(spark, "messages")
    messages.publish(view(spark, sf_dir, "tasks"), path)
    return spark.read.schema("data string, subject string").parquet(path).select("subject", "data")


@query
def dlq_records(spark, sf_dir):
    letters = deadletters.to_dlq(_effects(spark, sf_dir))
    return letters.select("subject", "data", header("headers", "task_id").alias("header_task_id"))


@query
def dlq_read(spark, sf_dir):
    good, bad = deadletters.read_dlq(view(spark, sf_dir, "dead_letters"))
    kept = good.select("seq", F.lit("letter").alias("kind"), "task_id", "task_type", "attempt", "error",
                       "original_subject", F.col("original_data").cast("string").alias("original_data"),
                       F.col("failed_at").cast("timestamp_ntz").alias("failed_at"))
    return kept.unionByName(bad.select("seq", F.lit("bad").alias("kind")), allowMissingColumns=True)


@query
def dlq_round_trip(spark, sf_dir):
    path = fresh_path(spark, "letters")
    deadletters.write_dlq(deadletters.to_dlq(_effects(spark, sf_dir)), path)
    good, bad = deadletters.read_dlq(messages.read_messages(spark, path))
    kept = good.select("task_id", "attempt", "original_subject", F.col("original_data").cast("string").alias("original_data"))
    return kept.unionByName(bad.select(F.col("data").alias("original_data")), allowMissingColumns=True)


@query
def parse_logs(spark, sf_dir):
    return loglines.parse_app_logs(view(spark, sf_dir, "log_lines")).drop("line", "ts_text", "span_id")


@query
def parse_access(spark, sf_dir):
    lines = view(spark, sf_dir, "access_lines")
    return loglines.parse_access_logs(lines, generated_id=F.md5(F.col("event_id").cast("string"))).drop("line")


@query
def export_json(spark, sf_dir):
    executions = view(spark, sf_dir, "execution_attempts").drop("tie")
    return export.export_json(executions).unionAll(export.export_json(view(spark, sf_dir, "tasks")))


@query
def replicate_messages(spark, sf_dir):
    copies = messages.replicate(view(spark, sf_dir, "task_messages"), 3, "50 milliseconds")
    return copies.select("seq", "copy", "published_at", "subject")


@query
def retention(spark, sf_dir):
    events = view(spark, sf_dir, "task_messages")
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    return messages.retain(events, "published_at", as_of).select("seq", "published_at")


# Validation, projection and filters

@query
def ingest_validate(spark, sf_dir):
    return ingest.ingest_requests(view(spark, sf_dir, "create_requests")).drop("received_at", "body")


@query
def new_tasks(spark, sf_dir):
    accepted = ingest.ingest_requests(view(spark, sf_dir, "create_requests")).where("error IS NULL")
    return ingest.new_tasks(accepted, stable_uuid("event_id"), F.col("received_at"))


@query
def route_priority(spark, sf_dir):
    accepted = ingest.ingest_requests(view(spark, sf_dir, "create_requests")).where("error IS NULL")
    return ingest.route(accepted).select("event_id", "priority", "subject")


@query
def constraint_violations(spark, sf_dir):
    # Labels that the tables hold but the constraints do not allow, so that rules do break.
    tasks = view(spark, sf_dir, "tasks").withColumns({
        "status": F.when(F.col("status") == "cancelled", "stopped").otherwise(F.col("status")),
        "payload": F.when(F.col("type") != "unknown", F.col("payload")),
        "priority": F.when(F.col("type") == "fail", "urgent").otherwise(F.col("priority")),
    })
    executions = view(spark, sf_dir, "execution_attempts").withColumn(
        "status", F.when(F.col("status") == "started", "running").otherwise(F.col("status")))
    return checks.constraint_violations(tasks, executions)


@query
def unique_violations(spark, sf_dir):
    return checks.unique_violations(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "execution_attempts"))


@query
def fk_violations(spark, sf_dir):
    return checks.fk_violations(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "execution_attempts"))


@query
def violations(spark, sf_dir):
    return checks.violations(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "execution_attempts"))


@query
def violations_of_nulls(spark, sf_dir):
    executions = view(spark, sf_dir, "execution_attempts").withColumns({
        "task_id": F.when(F.col("tie") % 11 != 0, F.col("task_id")),
        "attempt": F.when(F.col("tie") % 3 != 0, F.col("attempt")),
    })
    return checks.violations(view(spark, sf_dir, "tasks"), executions)


@query
def decode_messages(spark, sf_dir):
    return ingest.decode_messages(view(spark, sf_dir, "task_messages"), exclude_dlq=True).select(
        "seq", "task_id", "priority", "reject")


@query
def decode_all_messages(spark, sf_dir):
    return ingest.decode_messages(view(spark, sf_dir, "task_messages")).select("seq", "task_id", "priority", "reject")


@query
def filter_tasks(spark, sf_dir):
    return lookup.filter_tasks(view(spark, sf_dir, "tasks"), status="queued", type="demo")


@query
def log_min_level(spark, sf_dir):
    parsed = loglines.parse_app_logs(view(spark, sf_dir, "log_lines"))
    return logs.min_level(parsed, "warn").select("event_id", "level", "msg")


@query
def http_errors(spark, sf_dir):
    return logs.flag_errors(view(spark, sf_dir, "http_requests")).select("event_id", "status", "server_error")


# Lookups, joins and change sets

@query
def get_tasks(spark, sf_dir):
    return lookup.get_tasks(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "lookup_ids"))


@query
def enrich_deliveries(spark, sf_dir):
    deliveries = view(spark, sf_dir, "deliveries").select("task_id", *DELIVERY_ORDER)
    return lookup.enrich(deliveries, view(spark, sf_dir, "tasks"))


@query
def cas_updates(spark, sf_dir):
    table, _ = changes.apply_updates(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "status_updates"), UPDATE_ORDER)
    return table.select("id", "status", "version", "updated_at")


@query
def cas_outcomes(spark, sf_dir):
    _, outcomes = changes.apply_updates(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "status_updates"), UPDATE_ORDER)
    return outcomes


@query
def insert_ignore(spark, sf_dir):
    new = view(spark, sf_dir, "execution_attempts")
    table, _ = changes.insert_executions(view(spark, sf_dir, "recorded_executions"), new, EXECUTION_ORDER)
    return table


@query
def insert_outcomes(spark, sf_dir):
    new = view(spark, sf_dir, "execution_attempts")
    _, outcomes = changes.insert_executions(view(spark, sf_dir, "recorded_executions"), new, EXECUTION_ORDER)
    return outcomes.select("id", "task_id", "attempt", "outcome")


@query
def insert_known_tasks(spark, sf_dir):
    new = view(spark, sf_dir, "execution_attempts")
    _, outcomes = changes.insert_executions(view(spark, sf_dir, "recorded_executions"), new, EXECUTION_ORDER,
                                            tasks=view(spark, sf_dir, "tasks"))
    return outcomes.select("id", "task_id", "attempt", "outcome")


@query
def finish_executions(spark, sf_dir):
    table, _ = changes.finish_executions(view(spark, sf_dir, "recorded_executions"), view(spark, sf_dir, "execution_results"),
                                         ["finished_at", "tie1", "tie2", "tie3"])
    return table


@query
def finish_outcomes(spark, sf_dir):
    _, outcomes = changes.finish_executions(view(spark, sf_dir, "recorded_executions"), view(spark, sf_dir, "execution_results"),
                                            ["finished_at", "tie1", "tie2", "tie3"])
    return outcomes


@query
def cascade_delete(spark, sf_dir):
    left, kept = changes.delete_tasks(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "execution_attempts"),
                                      view(spark, sf_dir, "deleted_ids"))
    return left.select(F.lit("tasks").alias("table_name"), "id").unionAll(
        kept.select(F.lit("task_executions"), "id"))


# The same change sets on bucketed tables, in place

BUCKETS = 16


def _stored(spark, sf_dir, name, key, sort=()):
    rows = view(spark, sf_dir, name).drop("tie")
    return bucketed.create_table(rows, fresh_path(spark, name), key, BUCKETS, sort)


@query
def stored_cas_updates(spark, sf_dir):
    table, _ = stored.apply_updates(_stored(spark, sf_dir, "tasks", "id"), view(spark, sf_dir, "status_updates"), UPDATE_ORDER)
    return bucketed.open_table(spark, table.path).df().select("id", "status", "version", "updated_at")


@query
def stored_insert_ignore(spark, sf_dir):
    table = _stored(spark, sf_dir, "recorded_executions", "task_id", ["task_id", "attempt"])
    table, _ = stored.insert_executions(table, view(spark, sf_dir, "execution_attempts"), EXECUTION_ORDER)
    return table.df()


@query
def stored_finish_executions(spark, sf_dir):
    table = _stored(spark, sf_dir, "recorded_executions", "task_id", ["task_id", "attempt"])
    return stored.finish_executions(table, view(spark, sf_dir, "execution_results"), ["finished_at", "tie1", "tie2", "tie3"])[0].df()


@query
def stored_cascade_delete(spark, sf_dir):
    left, kept = stored.delete_tasks(_stored(spark, sf_dir, "tasks", "id"), _stored(spark, sf_dir, "execution_attempts", "task_id"),
                                     view(spark, sf_dir, "deleted_ids"))
    return left.df().select(F.lit("tasks").alias("table_name"), "id").unionAll(kept.df().select(F.lit("task_executions"), "id"))


@query
def stored_list_executions(spark, sf_dir):
    return stored.list_executions(_stored(spark, sf_dir, "execution_attempts", "task_id", ["task_id", "attempt"]),
                                  "10000000-0000-4000-8000-000000000000")


@query
def stored_audit(spark, sf_dir):
    return metrics.audit(_stored(spark, sf_dir, "tasks", "id").df(), _stored(spark, sf_dir, "execution_attempts", "task_id").df())


@query
def trace_logs(spark, sf_dir):
    parsed = loglines.parse_app_logs(view(spark, sf_dir, "log_lines")).select(
        "service", "trace_id", "ts", F.col("event_id").alias("log_id"), "level")
    pairs = traces.logs_for_spans(view(spark, sf_dir, "spans"), parsed, ["service", "trace_id"])
    return pairs.select("service", "trace_id", "span_id", "log_id", "level")


@query
def trace_logs_by_ids(spark, sf_dir):
    parsed = loglines.parse_app_logs(view(spark, sf_dir, "log_lines")).select(
        "service", "trace_id", "ts", F.col("event_id").alias("log_id"), "task_id", "request_id")
    pairs = traces.logs_for_spans(view(spark, sf_dir, "spans"), parsed, ["service", "trace_id"], if_set=["task_id", "request_id"])
    return pairs.select("span_id", "log_id")


# Lifecycle

@query
def replay_dispositions(spark, sf_dir):
    replayed = lifecycle.replay(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "deliveries"), DELIVERY_ORDER)
    return replayed.select("task_id", "attempt", "delivered_at", "tie", "disposition")


@query
def replay_with_executions(spark, sf_dir):
    replayed = lifecycle.replay(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "deliveries"), DELIVERY_ORDER,
                                executions=view(spark, sf_dir, "recorded_executions"))
    return replayed.select("task_id", "attempt", "delivered_at", "tie", "disposition")


@query
def replay_final_tasks(spark, sf_dir):
    return lifecycle.final_tasks(view(spark, sf_dir, "tasks"), _effects(spark, sf_dir), DELIVERY_ORDER)


@query
def replay_executions(spark, sf_dir):
    affected = lifecycle.effects(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "deliveries"), DELIVERY_ORDER,
                                 executions=view(spark, sf_dir, "recorded_executions"))
    return lifecycle.executions_of(affected)


@query
def attempt_numbers(spark, sf_dir):
    deliveries = view(spark, sf_dir, "deliveries").select(
        "task_id", "delivered_at", F.col("attempt").alias("line"), "tie")
    return lifecycle.number_attempts(deliveries, "task_id", "delivered_at", ["line", "tie"])


@query
def retry_schedule(spark, sf_dir):
    return lifecycle.retry_schedule(_effects(spark, sf_dir)).select(
        "task_id", "attempt", "delivered_at", "disposition", "action", "delay_ms", "next_at")


# Listings

@query
def list_tasks(spark, sf_dir):
    return lookup.list_tasks(view(spark, sf_dir, "tasks"), status="queued", limit=50, offset=20)


@query
def list_tasks_by_position(spark, sf_dir):
    listing = pages.build_listing(view(spark, sf_dir, "tasks"), fresh_path(spark, "listing"), rows_per_range=5000)
    return listing.page(type="demo", limit=200, offset=700)


@query
def list_executions(spark, sf_dir):
    task_id = "10000000-0000-4000-8000-000000000000"
    return lookup.list_executions(view(spark, sf_dir, "execution_attempts"), task_id).drop("tie")


@query
def latest_executions(spark, sf_dir):
    return lookup.latest_executions(view(spark, sf_dir, "execution_attempts"), 2).select(
        "task_id", "attempt", "id", "recency")


# Metrics

@query
def m_tasks_started(spark, sf_dir):
    return metrics.tasks_started(_effects(spark, sf_dir))


@query
def m_tasks_completed(spark, sf_dir):
    return metrics.tasks_completed(_effects(spark, sf_dir))


@query
def m_tasks_failed(spark, sf_dir):
    return metrics.tasks_failed(_effects(spark, sf_dir))


@query
def m_task_duration(spark, sf_dir):
    ran = _effects(spark, sf_dir).where(F.col("disposition").isin(*lifecycle.RAN))
    return metrics.histogram(ran, "duration_seconds", [F.col("task_type").alias("type")])


@query
def m_http_requests(spark, sf_dir):
    return metrics.http_requests_total(view(spark, sf_dir, "http_requests"))


@query
def m_http_duration(spark, sf_dir):
    requests = view(spark, sf_dir, "http_requests")
    return metrics.histogram(requests, "duration_seconds", [
        metrics.route_template("path").alias("route"), "method"]).withColumn(
        "total_sum", F.round("total_sum", 4))


@query
def event_rate(spark, sf_dir):
    events = view(spark, sf_dir, "http_requests")
    return metrics.event_rate(events, "ts", "1 hour", "10 minutes").withColumn(
        "rate_per_sec", F.round("rate_per_sec", 9))


@query
def counter_rate(spark, sf_dir):
    rates = metrics.counter_rate(view(spark, sf_dir, "counter_samples"), "1 day", ["series"], tie=["event_id"])
    return rates.withColumn("rate_per_sec", F.round("rate_per_sec", 6))


@query
def counter_rate_total(spark, sf_dir):
    rates = metrics.counter_rate(view(spark, sf_dir, "counter_samples"), "1 day", ["series"], tie=["event_id"])
    return metrics.sum_rates(rates, ["window_start_us"]).withColumn("rate_per_sec", F.round("rate_per_sec", 6))


@query
def counter_rate_sliding(spark, sf_dir):
    rates = metrics.counter_rate(view(spark, sf_dir, "counter_samples"), "12 hours", ["series"], tie=["event_id"],
                                 step="3 hours")
    return rates.withColumn("rate_per_sec", F.round("rate_per_sec", 6))


@query
def histogram_p95_rate(spark, sf_dir):
    found = metrics.rate_quantile(view(spark, sf_dir, "bucket_samples"), 0.95, "1 day", ["instance"], [], tie=["event_id"])
    return found.withColumn("quantile", F.round("quantile", 6))


@query
def histogram_p95(spark, sf_dir):
    day = (F.floor(epoch_micros("ts") / 86_400_000_000)).alias("day")
    buckets = metrics.histogram(view(spark, sf_dir, "http_requests"), "duration_seconds", [
        day, metrics.route_template("path").alias("route")])
    return metrics.histogram_quantile(buckets, 0.95, ["day"]).withColumn("quantile", F.round("quantile", 6))


@query
def stream_stats(spark, sf_dir):
    return metrics.stream_stats(view(spark, sf_dir, "task_messages"), "TASKS")


@query
def execution_audit(spark, sf_dir):
    return metrics.audit(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "execution_attempts"))


# Scalar functions and sampling

@query
def merge_arrays_query(spark, sf_dir):
    subjects = F.array("subject", F.lit("tasks.normal"))
    wanted = F.array(F.lit("tasks.high"), F.lit("tasks.normal"), F.lit("tasks.low"), F.lit("tasks.dlq"))
    return view(spark, sf_dir, "task_messages").select(
        "seq", F.concat_ws(",", merge_arrays(subjects, wanted)).alias("merged"),
        merge_changes(subjects, wanted).alias("changed"))


@query
def canonical_payload_query(spark, sf_dir):
    spaced = F.concat(F.lit('{ "z" : 1, "cust" : '), F.get_json_object("payload", "$.cust"), F.lit(" }"))
    return view(spark, sf_dir, "tasks").select("id", canonical_payload(spaced).alias("payload"))


@query
def first_non_blank_query(spark, sf_dir):
    blank = F.when(F.col("event_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "subject"))
    return view(spark, sf_dir, "task_messages").withColumnRenamed("seq", "event_id").select(
        "event_id", first_non_blank(blank, F.lit("fallback")).alias("chosen"))


@query
def message_headers(spark, sf_dir):
    headers = with_header(with_header(F.create_map(F.lit("X-Request-Id"), F.col("subject")),
                                      "task_id", F.col("seq").cast("string")), "X-Request-Id", F.lit("r"))
    return view(spark, sf_dir, "task_messages").select(
        "seq", header(headers, "X-Request-Id").alias("request_id"), header(headers, "task_id").alias("task_id"),
        header(headers, "absent").alias("absent"), F.concat_ws(",", header_keys(headers)).alias("names"))


@query
def trace_sample(spark, sf_dir):
    return traces.trace_sample(view(spark, sf_dir, "spans"), 0.1).select("trace_id", "span_id")


# Handlers

@query
def run_handlers(spark, sf_dir):
    queued = view(spark, sf_dir, "tasks").where("status = 'queued'")
    return handlers.run_handlers(queued.select("id", "type", "payload"), handlers.HandlerRegistry.with_defaults()
                                 ).select("id", "type", "outcome", "error")


def _flaky(task: dict) -> None:
    if task["priority"] == "low":
        raise RuntimeError("busy")


def _with_retries(spark, sf_dir):
    registry = handlers.HandlerRegistry.with_defaults()
    registry.register("demo", _flaky)
    return handlers.run_with_retries(view(spark, sf_dir, "tasks"), registry, 3)


@query
def run_with_retries(spark, sf_dir):
    return _with_retries(spark, sf_dir)[0].select("id", "status", "version")


@query
def retry_executions(spark, sf_dir):
    return _with_retries(spark, sf_dir)[1].select("task_id", "attempt", "status", "error", "retry_after_ms")


# Streams

def _drain(stream: DataFrame) -> DataFrame:
    """Runs an append stream over what is there and reads back what it wrote."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-checkpoint")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_replay_query(spark, sf_dir):
    rows = _drain(stream_replay(stream_view(spark, sf_dir, "lineitem", "deliveries"),
                                view(spark, sf_dir, "tasks"), DELIVERY_ORDER))
    return rows.groupBy("task_id", "disposition").agg(
        F.sum("n_deliveries").alias("n_deliveries"), F.max("version").alias("version"))


@query
def stream_redelivery_query(spark, sf_dir):
    registry = handlers.HandlerRegistry.with_defaults()
    registry.register("demo", _flaky)
    queued = view(spark, sf_dir, "tasks").where("status = 'queued'")
    source = fresh_path(spark, "first-deliveries")
    first = queued.select(F.col("id").alias("task_id"), F.col("created_at").cast("timestamp").alias("delivered_at"), F.lit(1).alias("attempt"))
    first.write.parquet(source)
    # Later than all: it moves the stream's clock past the last redelivery.
    (first.agg((F.max("delivered_at") + F.expr("INTERVAL 1 DAY")).alias("delivered_at"))
     .select(F.lit(None).cast("string").alias("task_id"), "delivered_at", F.lit(1).alias("attempt")).write.mode("append").parquet(source))
    use_rocksdb_state(spark)
    stream = spark.readStream.schema(first.schema).parquet(source)
    rows = _drain(stream_redelivery(stream, queued, registry, max_attempts=3)).where("task_id IS NOT NULL")
    return _naive(rows.select("task_id", "attempt", "delivered_at", "disposition", "error", "status", "version", "next_at"))


@query
def stream_dedup(spark, sf_dir):
    stream = stream_view(spark, sf_dir, "lineitem", "execution_attempts").select("task_id", "attempt")
    return _drain(jobs.stream_dedup(stream))


@query
def stream_dlq(spark, sf_dir):
    # The log arrives in three parts; the stream runs once on each, from where it stopped before.
    source, out, checkpoint = (fresh_path(spark, label) for label in ("deliveries", "lanes", "lanes-checkpoint"))
    deliveries = view(spark, sf_dir, "deliveries")
    use_rocksdb_state(spark)
    for part in ("delivered_at < '1994-06-01'", "delivered_at >= '1994-06-01' AND delivered_at < '1997-01-01'", "delivered_at >= '1997-01-01'"):
        deliveries.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(deliveries.schema).parquet(source)
        replayed = stream_replay(stream, view(spark, sf_dir, "tasks"), DELIVERY_ORDER, carry=["subject", "data", "error", "delivered_at"])
        jobs.stream_route(replayed, out, checkpoint).awaitTermination()

    def lane(name, schema):
        return spark.read.schema(schema).parquet(f"{out}/lane={name}").withColumn("lane", F.lit(name))

    dead = lane("dead", "data string, headers map<string,string>").select(
        "lane", F.col("headers")["task_id"].alias("task_id"), "data")
    retry = lane("retry", "task_id string, attempt int, data string, next_at timestamp_ntz").select(
        "lane", "task_id", "data", "attempt", "next_at")
    good = lane("good", "disposition string, n_deliveries bigint").groupBy("lane", "disposition").agg(
        F.sum("n_deliveries").alias("n_deliveries"))
    return dead.unionByName(retry, allowMissingColumns=True).unionByName(good, allowMissingColumns=True)


@query
def stream_dedup_bounded(spark, sf_dir):
    stream = stream_view(spark, sf_dir, "events", "task_messages").select("subject", "published_at")
    return _drain(jobs.stream_dedup(stream, ["subject"], "published_at", "400 days")).select("subject")


@query
def stream_histogram(spark, sf_dir):
    stream = stream_view(spark, sf_dir, "events", "http_requests").select("ts", "method", "duration_seconds")
    made = _drain(jobs.stream_histogram(stream, "ts", "duration_seconds", "1 day", "1 hour", ["method"]))
    return _naive(made.select(F.col("window.start").alias("window_start"), "method", "le", "bucket_count", "total_count"))


@query
def stream_rate(spark, sf_dir):
    stream = stream_view(spark, sf_dir, "events", "http_requests").select("ts", "method")
    rates = _drain(jobs.stream_rate(stream, "ts", "1 day", "12 hours", "1 hour"))
    return _naive(rates).select("window_start", "window_end", "n_events")
