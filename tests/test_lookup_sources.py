import base64
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from workloom.operators import logs, lookup, traces
from workloom.schemas import EXECUTIONS, TASKS
from workloom.sources import deadletters, export, loglines, messages, tables

T0 = dt.datetime(2024, 1, 1)
TASK_DDL = ("id string, type string, payload string, priority string, status string, created_at timestamp, "
            "updated_at timestamp, version int")


def uid(n):
    return f"{n:08d}-0000-4000-8000-000000000000"


@pytest.fixture(scope="module")
def tasks(spark):
    return spark.createDataFrame(
        [(uid(i), "demo" if i % 2 else "fail", '{"hello": "world"}', "normal", "queued" if i % 3 else "failed",
          T0 + dt.timedelta(hours=i // 2), T0, 1) for i in range(120)], TASK_DDL)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_tables_round_trip(spark, tasks, tmp_path, fmt):
    tables.write_tasks(tasks, str(tmp_path / "t"), fmt)
    back = tables.read_tasks(spark, str(tmp_path / "t"), fmt)
    assert back.columns == TASKS.names
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tasks.collect()))


def test_tables_by_day_are_pruned(spark, tasks, tmp_path):
    tables.write_tasks(tasks, str(tmp_path / "t"), by_day=True)
    day = spark.read.parquet(str(tmp_path / "t")).where("created_day = DATE '2024-01-02'")
    assert "PartitionFilters: [isnotnull(created_day" in day._jdf.queryExecution().executedPlan().toString()
    assert day.count() == tasks.where("to_date(created_at) = DATE '2024-01-02'").count() == 48
    assert tables.read_tasks(spark, str(tmp_path / "t")).count() == 120


def test_filters_and_columns_reach_the_scan(spark, tasks, tmp_path):
    tables.write_tasks(tasks, str(tmp_path / "t"))
    listed = lookup.filter_tasks(tables.read_tasks(spark, str(tmp_path / "t")), "queued", "demo").select("id")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,queued)" in plan and "EqualTo(type,demo)" in plan
    assert "ReadSchema: struct<id:string,type:string,status:string>" in plan


def test_executions_round_trip_and_missing_columns_fail(spark, tmp_path):
    df = spark.createDataFrame([(uid(1), uid(2), 1, "started", None, T0, None)], EXECUTIONS)
    tables.write_executions(df, str(tmp_path / "e"))
    assert tables.read_executions(spark, str(tmp_path / "e")).first() == df.first()
    with pytest.raises(Exception):
        tables.write_executions(df.drop("attempt"), str(tmp_path / "f"))


def test_get_tasks(spark, tasks):
    asked = spark.createDataFrame([(uid(3),), (uid(3),), (uid(3).upper(),), (uid(999),), ("nope",), ("",)], "requested_id string")
    rows = {r.requested_id: r for r in lookup.get_tasks(tasks, asked).collect()}
    assert {k: r.lookup for k, r in rows.items()} == {
        uid(3): "found", uid(3).upper(): "found", uid(999): "not_found", "nope": "invalid", "": "invalid"}
    assert rows[uid(3)].task_type == "demo" and rows["nope"].task_type is None


def test_list_tasks(spark, tasks):
    rows = lookup.list_tasks(tasks, status="queued", type="demo", limit=5, offset=3).collect()
    everything = sorted((r for r in tasks.collect() if r.status == "queued" and r.type == "demo"),
                        key=lambda r: (-r.created_at.timestamp(), r.id))
    assert [r.id for r in rows] == [r.id for r in everything[3:8]]
    assert lookup.list_tasks(tasks).count() == 50
    plan = lookup.list_tasks(tasks, limit=7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 201}, {"offset": -1}, {"status": "lost"}])
def test_list_arguments(tasks, bad):
    with pytest.raises(ValueError):
        lookup.list_tasks(tasks, **bad)
    if "status" not in bad:
        assert lookup.list_tasks(tasks, strict=False, **bad).count() == 50


def test_list_and_latest_executions(spark):
    df = spark.createDataFrame([(uid(i), uid(i % 2), i, "failed", None, T0, None) for i in range(1, 9)], EXECUTIONS)
    assert [r.attempt for r in lookup.list_executions(df, uid(1), 3).collect()] == [7, 5, 3]
    assert lookup.list_executions(df, "{" + uid(1).upper() + "}").count() == 4
    assert lookup.list_executions(df, uid(77)).count() == 0
    with pytest.raises(ValueError):
        lookup.list_executions(df, "nope")
    latest = lookup.latest_executions(df, 2)
    assert {(r.task_id, r.attempt) for r in latest.collect()} == {(uid(0), 8), (uid(0), 6), (uid(1), 7), (uid(1), 5)}
    assert "WindowGroupLimit" in latest._jdf.queryExecution().executedPlan().toString()


def test_enrich(spark, tasks):
    deliveries = spark.createDataFrame([(uid(1), i) for i in range(300)] + [("gone", 1)], "task_id string, n int")
    rows = lookup.enrich(deliveries, tasks).collect()
    assert len(rows) == 301 and {r.task_type for r in rows if r.task_id == uid(1)} == {"demo"}
    assert [r.task_type for r in rows if r.task_id == "gone"] == [None]


def test_dead_letters_round_trip(spark, tmp_path):
    affected = spark.createDataFrame(
        [("t1", "demo", 5, "exhausted_dlq", "boom", "tasks.low", '{"x":1}', dt.datetime(2024, 1, 1, 0, 0, 7, 180000)),
         ("t2", 'un"k', 1, "no_handler_dlq", None, "tasks.low", "raw", T0), ("t3", "demo", 1, "completed", None, "s", "d", T0)],
        "task_id string, task_type string, attempt int, disposition string, error string, subject string, data string, "
        "delivered_at timestamp")
    deadletters.write_dlq(deadletters.to_dlq(affected), str(tmp_path / "d"))
    stored = messages.read_messages(spark, str(tmp_path / "d"), "tasks.*")
    raw = {json.loads(r.data)["task_id"]: (json.loads(r.data), r.headers) for r in stored.collect()}
    assert set(raw) == {"t1", "t2"}
    assert raw["t1"][0]["failed_at"] == "2024-01-01T00:00:07.18Z" and raw["t1"][1] == {"task_id": "t1"}
    assert base64.b64decode(raw["t1"][0]["original_data"]) == b'{"x":1}'
    assert raw["t2"][0]["error"] == 'no handler registered for type "un"k"'
    noise = spark.createDataFrame([("{",), ("[]",), ('{"attempt":"x"}',), ('{"failed_at":"noon"}',), ('{"original_data":"*"}',)],
                                  "data string")
    good, bad = deadletters.read_dlq(stored.select("data").unionAll(noise))
    assert bad.count() == 5
    rows = {r.task_id: r for r in good.collect()}
    assert bytes(rows["t1"].original_data) == b'{"x":1}'
    assert rows["t1"].failed_at == dt.datetime(2024, 1, 1, 0, 0, 7, 180000)


def test_log_lines(spark):
    lines = spark.createDataFrame(
        [("api", '{"level":"warn","timestamp":1.5,"msg":"m","request_id":"r","trace_id":"t","span_id":"s","task_id":"k"}'),
         ("api", "plain"), ("api", '{"level":"debug","msg":"d"}')], "service string, line string")
    parsed = loglines.parse_app_logs(lines)
    rows = parsed.collect()
    assert rows[0].level == "warn" and rows[0].ts_text == "1.5" and rows[0].span_id == "s"
    assert rows[1].level is None and rows[1].line == "plain"
    assert [r.msg for r in logs.min_level(parsed, "info").collect()] == ["m"]
    assert loglines.labels(parsed).columns == ["service", "level", "request_id", "trace_id", "task_id"]
    with pytest.raises(ValueError):
        logs.min_level(parsed, "loud")


def test_access_lines(spark):
    line = ('{"time":"2024-01-01T00:00:00+00:00","remote_addr":"10.0.0.1","request_id":"","method":"GET","uri":"/","status":502,'
            '"bytes_sent":12,"request_time":0.25,"upstream_addr":"a","upstream_response_time":"-","user_agent":"x"}')
    row = loglines.parse_access_logs(spark.createDataFrame([(line,)], "line string")).first()
    assert len(row.request_id) == 32 and row.status == 502 and row.request_time == 0.25 and row.bytes_sent == 12
    assert logs.flag_errors(spark.createDataFrame([(499,), (500,)], "status int")).select("server_error").collect() == [(False,), (True,)]


def test_export_leaves_nulls_out(spark, tasks):
    execution = spark.createDataFrame([(uid(1), uid(2), 1, "started", None, T0, None)], EXECUTIONS)
    assert json.loads(export.export_json(execution).first().json) == {
        "id": uid(1), "task_id": uid(2), "attempt": 1, "status": "started", "started_at": "2024-01-01T00:00:00Z"}
    assert json.loads(export.export_json(tasks.limit(1)).first().json)["payload"] == {"hello": "world"}


def test_publish_replicate_retain(spark, tasks, tmp_path):
    messages.publish(tasks, str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert stored.count() == 120 and {r.subject for r in stored.select("subject").distinct().collect()} == {"tasks.normal"}
    assert messages.read_messages(spark, str(tmp_path / "m"), "tasks.*").count() == 120
    low = messages.read_messages(spark, str(tmp_path / "m"), "tasks.low")
    assert low.count() == 0 and "PartitionFilters: [isnotnull(subject" in low._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame([("m", T0)], "data string, published_at timestamp")
    copies = messages.replicate(one, 3, "50 milliseconds").orderBy("copy").collect()
    assert [r.published_at - T0 for r in copies] == [dt.timedelta(milliseconds=50 * i) for i in range(3)]
    with pytest.raises(ValueError):
        messages.replicate(one, 0, "1 second")
    assert messages.retain(one, "published_at", F.lit(T0 + dt.timedelta(days=7))).count() == 1
    assert messages.retain(one, "published_at", F.lit(T0 + dt.timedelta(days=7, seconds=1))).count() == 0


def test_logs_for_spans_equal_brute_force(spark):
    import random
    rng = random.Random(5)
    at = lambda: T0 + dt.timedelta(minutes=rng.randint(0, 1500))
    spans = [(f"k{rng.randint(0, 2)}", i, s, s + dt.timedelta(minutes=rng.choice([0, 10, 300]))) for i in range(60) for s in [at()]]
    lines = [(f"k{rng.randint(0, 2)}", i, at()) for i in range(200)]
    pairs = traces.logs_for_spans(
        spark.createDataFrame(spans, "k string, span int, start_ts timestamp, end_ts timestamp"),
        spark.createDataFrame(lines, "k string, log int, ts timestamp"), ["k"])
    hour = dt.timedelta(hours=1)
    want = sorted((s, n) for k, s, a, b in spans for j, n, t in lines if k == j and a - hour <= t <= b + hour)
    assert sorted((r.span, r.log) for r in pairs.collect()) == want


def test_long_spans_touch_two_panes_and_meet_all_their_logs(spark):
    import random
    rng = random.Random(6)
    at = lambda: dt.datetime(1969, 12, 1) + dt.timedelta(minutes=rng.randint(0, 150_000))
    spans = [(rng.choice(["hot", "hot", "k", None]), i, s, s + dt.timedelta(minutes=rng.choice([0, 100, 5_000, 43_200, 20_000_000]))) for i in range(50) for s in [at()]]
    spans += [("hot", 98, None, T0), ("hot", 99, at(), None)]
    lines = [(rng.choice(["hot", "hot", "k", None]), i, at()) for i in range(400)] + [("hot", 900, None)]
    left = spark.createDataFrame(spans, "k string, span int, start_ts timestamp, end_ts timestamp")
    right = spark.createDataFrame(lines, "k string, log int, ts timestamp")
    hour = dt.timedelta(hours=1)
    want = sorted((s, n) for k, s, a, b in spans if k and a for j, n, t in lines if k == j and t and a - hour <= t <= (b or a) + hour)
    assert sorted((r.span, r.log) for r in traces.logs_for_spans(left, right, ["k"]).collect()) == want
    month = spark.range(1).selectExpr("1000000L AS _opens", f"{30 * 86_400_000_000}L AS _closes")
    assert len(traces._in_panes(month, 3_600_000_000).first()._panes) <= 2
    assert traces.logs_for_spans(left.limit(0), right, ["k"]).count() == traces.logs_for_spans(left, right.limit(0), ["k"]).count() == 0


def test_trace_sampling(spark):
    ids = [f"{'0' * 16}{x:016x}" for x in (0, 1, int(0.1 * 2**63) * 2 - 2, int(0.1 * 2**63) * 2, 2**64 - 1)]
    df = spark.createDataFrame([(i,) for i in ids], "trace_id string")
    assert [r.trace_id for r in traces.trace_sample(df, 0.1).collect()] == ids[:3]
    assert traces.trace_sample(df, 1.0).count() == 5 and traces.trace_sample(df, 0).count() == 0
    assert traces.trace_sample(df, 0.1, F.lit(False)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 56, 57, 58, 70, 5000])
def test_letters_of_any_size_come_back(spark, size):
    affected = spark.createDataFrame(
        [("t1", "demo", 5, "exhausted_dlq", "boom", "tasks.low", "x" * size, T0)], "task_id string, task_type string, attempt int, "
        "disposition string, error string, subject string, data string, delivered_at timestamp")
    letters = deadletters.to_dlq(affected)
    assert "\\r" not in letters.first().data
    good, bad = deadletters.read_dlq(letters)
    assert bad.count() == 0 and bytes(good.first().original_data) == b"x" * size


def test_line_ends_behind_a_value_are_not_passed_over(spark):
    from workloom.functions.ids import parse_uuid, valid_uuid
    from workloom.functions.text import route_template, subject_matches

    value = uid(3)
    df = spark.createDataFrame([(value, "tasks.high", "/api/v1/tasks/x"), (value + "\n", "tasks.high\n", "/api/v1/tasks/x\n")],
                               "id string, subject string, path string")
    rows = df.select(valid_uuid("id").alias("v"), subject_matches("subject", "tasks.*").alias("s"),
                     subject_matches("subject", "tasks.high").alias("e")).collect()
    assert [tuple(r) for r in rows] == [(value, True, True), (None, False, False)]
    assert parse_uuid(value) == value and parse_uuid(value + "\n") is None
    assert df.select(route_template("path").alias("r")).first().r == "/api/v1/tasks/{id}"


def test_levels_above_error(spark):
    df = spark.createDataFrame([(x,) for x in ("debug", "warn", "error", "dpanic", "panic", "FATAL", "odd")], "level string")
    assert [r.level for r in logs.min_level(df, "error").collect()] == ["error", "dpanic", "panic", "FATAL"]


def test_open_and_reversed_spans(spark):
    from workloom.operators import traces

    hour = dt.timedelta(hours=1)
    spans = spark.createDataFrame([(1, "k", T0, None, None), (2, "k", T0, T0 - 9 * hour, "a"), (3, "k", T0, T0 + 2 * hour, "b")],
                                  "span_id int, trace_id string, start_ts timestamp, end_ts timestamp, task_id string")
    at = spark.createDataFrame([(10, "k", T0 + hour / 2, "a"), (11, "k", T0 + 2.5 * hour, "b"), (12, "k", T0 - 2 * hour, "a")],
                               "log_id int, trace_id string, ts timestamp, task_id string")
    pairs = traces.logs_for_spans(spans, at.drop("task_id"), ["trace_id"])
    assert sorted((r.span_id, r.log_id) for r in pairs.collect()) == [(1, 10), (2, 10), (3, 10), (3, 11)]
    pairs = traces.logs_for_spans(spans, at, ["trace_id"], if_set=["task_id"])
    assert sorted((r.span_id, r.log_id) for r in pairs.collect()) == [(1, 10), (2, 10), (3, 11)]
