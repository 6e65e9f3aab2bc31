import datetime as dt

from pyspark.sql import functions as F

from workloom.functions.ids import stable_uuid, valid_uuid
from workloom.functions.payload import canonical_payload
from workloom.functions.text import (
    first_non_blank, header, header_keys, merge_arrays, merge_changes, route_template, subject_matches, with_header,
)
from workloom.operators import checks, ingest
from workloom.schemas import EXECUTIONS, TASKS
from workloom.sources.messages import filter_subjects, task_messages

T0 = dt.datetime(2024, 1, 1)
BODIES = [
    ('{"type":"demo","payload":{"hello":"world"},"priority":"normal"}', ("demo", '{"hello":"world"}', "normal", None, None)),
    ('{"type":"demo","payload":{"b":1,"a":[1, 2]}}', ("demo", '{"a":[1,2],"b":1}', "normal", None, None)),
    ('{"type":"demo","payload":{},"priority":""}', ("demo", "{}", "normal", None, None)),
    ('{"type":"demo","payload":null}', ("demo", "null", "normal", None, None)),
    ('{"type":"demo","payload":1} trailing', ("demo", "1", "normal", None, None)),
    ('{"type":"demo","payload":1,"priority":null}', ("demo", "1", "normal", None, None)),
    ('{"type":"demo","payload":1,"priority":"HIGH"}', (None, None, None, "validation_error", "priority must be low|normal|high")),
    ('{"payload":1,"priority":"urgent"}', (None, None, None, "validation_error", "type is required")),
    ('{"type":"","payload":1}', (None, None, None, "validation_error", "type is required")),
    ('{"type":null,"payload":1}', (None, None, None, "validation_error", "type is required")),
    ('{"type":"a","TYPE":"demo","payload":1,"Payload":{"x":1,"x":2}}', ("demo", '{"x":2}', "normal", None, None)),
    ('{"type":"demo","type":null,"payload":1,"priority":"low","Priority":null}', ("demo", "1", "low", None, None)),
    ('{"type":5,"type":"demo","payload":1}', (None, None, None, "invalid_json", "malformed body")),
    ('{"type":"demo","payload":1,"payload":null}', ("demo", "null", "normal", None, None)),
    ('{"type":"demo","payload":{"b":[%s, 0.50],"a":"\u00e9"}} x' % ("9" * 60), ("demo", '{"a":"é","b":[%s,0.5]}' % ("9" * 60), "normal", None, None)),
    ('{"type":"demo","payload":"%s"}' % ("9" * 60), ("demo", '"%s"' % ("9" * 60), "normal", None, None)),
    ('{"type":"demo","payload":1,"t\u0131pe":3}', ("demo", "1", "normal", None, None)),
    ("{'type':'demo','payload':1}", (None, None, None, "invalid_json", "malformed body")),
    (" null ", (None, None, None, "validation_error", "type is required")),
    ("null", (None, None, None, "validation_error", "type is required")),
    ('{"type":"demo"}', (None, None, None, "validation_error", "payload is required")),
    ('{"type":5,"payload":1}', (None, None, None, "invalid_json", "malformed body")),
    ('{"payload":1,"priority":{}}', (None, None, None, "invalid_json", "malformed body")),
    ("[]", (None, None, None, "invalid_json", "malformed body")),
    ('"text"', (None, None, None, "invalid_json", "malformed body")),
    ("{bad", (None, None, None, "invalid_json", "malformed body")),
    ("", (None, None, None, "invalid_json", "malformed body")),
    (None, (None, None, None, "invalid_json", "malformed body")),
]


def test_create_requests(spark):
    raw = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BODIES)], "n int, body string")
    rows = {r.n: tuple(r)[2:] for r in ingest.ingest_requests(raw).collect()}
    for i, (body, want) in enumerate(BODIES):
        assert rows[i] == want, body


def test_new_tasks_have_the_defaults(spark):
    raw = spark.createDataFrame([(BODIES[0][0],)], "body string")
    accepted = ingest.ingest_requests(raw).where("error IS NULL")
    row = ingest.new_tasks(accepted).first()
    assert (row.status, row.version, row.priority, row.type) == ("queued", 1, "normal", "demo")
    assert row.created_at == row.updated_at and len(row.id) == 36
    fixed = ingest.new_tasks(accepted, stable_uuid("body"), F.lit(T0))
    assert fixed.first().id == fixed.first().id and fixed.first().created_at == T0
    assert fixed.columns == TASKS.names


U = "0f8fad5b-d9cb-469f-a165-70867728950e"
MESSAGES = [
    (f'{{"task_id":"{U}","priority":"low"}}', (U, "low", None)),
    (f'{{"task_id":"{U.upper()}"}}', (U, "", None)),
    (f'{{"task_id":"urn:uuid:{U}"}}', (U, "", None)),
    (f'{{"task_id":"{{{U}}}"}}', (U, "", None)),
    (f'{{"task_id":"{U.replace("-", "")}"}}', (U, "", None)),
    (f' {{"task_id":"{U}"}} ', (U, "", None)),
    (f'{{"task_id":"{U}"}} trailing', (None, None, "bad_message")),
    (f'{{"task_id":"{U}"}}{{}}', (None, None, "bad_message")),
    (f'{{"task_id":"{U}"}},1', (None, None, "bad_message")),
    (f'{{"task_id":"{U}"}}]', (None, None, "bad_message")),
    (f'{{"task_id":"{U}","priority":3}}', (None, None, "bad_message")),
    ('{"task_id":5}', (None, None, "bad_message")),
    ("[1]", (None, None, "bad_message")), ("{bad", (None, None, "bad_message")), ("", (None, None, "bad_message")),
    ("{}", (None, None, "bad_task_id")), ("null", (None, None, "bad_task_id")),
    (f'{{"task_id":"x","Task_ID":"{U}","priority":"low","priority":null}}', (U, "low", None)),
    (f'{{"task_id":"{U}","taſk_id":"x"}}', (None, None, "bad_task_id")), (f'{{"task_id":1,"task_id":"{U}"}}', (None, None, "bad_message")),
    (f'{{"task_id":"{U}","x":{{"y":1,"y":2}}}}', (U, "", None)), (f'{{"task_id":"{U}"}},"x":{{}}', (None, None, "bad_message")),
    ("null null", (None, None, "bad_message")), (None, (None, None, "bad_message")),
    ('{"task_id":null}', (None, None, "bad_task_id")), ('{"task_id":"x"}', (None, None, "bad_task_id")),
]


def test_messages_decode_strictly(spark):
    df = spark.createDataFrame([(i, "tasks.low", m) for i, (m, _) in enumerate(MESSAGES)], "n int, subject string, data string")
    rows = {r.n: (r.task_id, r.priority, r.reject) for r in ingest.decode_messages(df).collect()}
    for i, (message, want) in enumerate(MESSAGES):
        assert rows[i] == want, message
    dead = df.withColumn("subject", F.lit("tasks.dlq"))
    assert ingest.decode_messages(dead, exclude_dlq=True).count() == 0


def test_parsing_happens_once_under_a_filter(spark):
    raw = spark.createDataFrame([(b,) for b, _ in BODIES], "body string").where("body <> 'x'")
    plan = ingest.ingest_requests(raw).where("error IS NULL")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_text_columns(spark):
    df = spark.range(1).select(
        first_non_blank(F.lit(" \t"), F.lit(" a "), F.lit("b")).alias("a"), first_non_blank(F.lit(""), F.lit(None)).alias("b"),
        F.array(*[subject_matches(F.lit(s), "tasks.*") for s in ("tasks.low", "tasks.dlq", "tasks", "tasks.a.b", "xtasks.a")]).alias("c"),
        F.array(*[route_template(F.lit(p)) for p in ("/api/v1/tasks", "/api/v1/tasks/7", "/api/v1/tasks/7/executions", "/x")]).alias("d"),
        merge_arrays(F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("a"))).alias("e"),
        merge_changes(F.array(F.lit("a")), F.array(F.lit("a"))).alias("f"),
        canonical_payload(F.lit('{ "b":1, "a": {"z":null} }')).alias("g"),
        F.array(*[valid_uuid(F.lit(x)) for x in ("zz", "", U[:-1], U.replace("-", "_"))]).alias("h"))
    row = df.first()
    assert row.a == " a " and row.b == ""
    assert row.c == [True, True, False, False, False]
    assert row.d == ["/api/v1/tasks", "/api/v1/tasks/{id}", "/api/v1/tasks/{id}/executions", "/x"]
    assert row.e == ["b", "a", "c"] and row.f is False
    assert row.g == '{"a":{"z":null},"b":1}' and row.h == [None] * 4


def test_canonical_payloads_keep_long_numbers_and_the_last_key(spark):
    cases = [('{"a":1,"b":{"z":1,"z":2},"a":3}', '{"a":3,"b":{"z":2}}'), ("1" * 60, "1" * 60), ("-" + "1" * 60 + ".500", "-" + "1" * 60 + ".5"),
             ('{"b":1e3,"a":%s.00}' % ("2" * 45), '{"a":%s,"b":1000}' % ("2" * 45)), ('["%s"]' % ("3" * 60), '["%s"]' % ("3" * 60)),
             ("[%s," % ("1" * 60), None), ("", None), (None, None), ("[]", "[]"),
             ('{"x":1e999999999,"y":%s}' % ("4" * 50), '{"x":1e999999999,"y":%s}' % ("4" * 50)),
             ("[0.%s0]" % ("5" * 50), "[0.%s]" % ("5" * 50)), ('{"k":%s,"k":%s1}' % ("6" * 50, "6" * 50), '{"k":%s1}' % ("6" * 50))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "n int, t string")
    got = {r.n: r.c for r in df.select("n", canonical_payload("t").alias("c")).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i] == want, text


def test_headers(spark):
    empty = F.lit(None).cast("map<string,string>")
    row = spark.range(1).select(
        header(with_header(empty, "k", F.lit("v")), "k").alias("a"), header(empty, "k").alias("b"),
        header(with_header(F.create_map(F.lit("k"), F.lit("old")), "k", F.lit("new")), "k").alias("c"),
        header_keys(with_header(F.create_map(F.lit("b"), F.lit("1")), "a", F.lit("2"))).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("v", "", "new", ["a", "b"])


def test_messages_of_tasks(spark):
    tasks = spark.createDataFrame([("a", "high", "r1", None), ("b", "low", "", None)],
                                  "id string, priority string, rid string, tp string")
    rows = {r.subject: r for r in task_messages(tasks, "rid", "tp").collect()}
    assert rows["tasks.high"].data == '{"task_id":"a","priority":"high"}'
    assert rows["tasks.high"].headers == {"X-Request-Id": "r1"} and rows["tasks.low"].headers == {}
    assert filter_subjects(task_messages(tasks), "tasks.high").count() == 1


def test_violations(spark):
    tasks = spark.createDataFrame(
        [("a", "demo", "{}", "low", "queued", T0, T0, 1), ("a", "demo", "{}", "top", "lost", T0, T0, 1),
         ("b", None, "{}", "low", "queued", T0, None, 1)],
        "id string, type string, payload string, priority string, status string, created_at timestamp, "
        "updated_at timestamp, version int")
    execs = spark.createDataFrame(
        [("e1", "a", 1, "started", None, T0, None), ("e2", "a", 1, "odd", None, T0, None), ("e3", "z", 1, "failed", "x", T0, T0)],
        "id string, task_id string, attempt int, status string, error string, started_at timestamp, finished_at timestamp")
    assert [f.name for f in EXECUTIONS] == execs.columns
    got = {(r.table_name, r.rule, r.key_value): r.n_rows for r in checks.violations(tasks, execs).collect()}
    assert got == {
        ("tasks", "primary key", "a"): 2, ("tasks", "priority check", "a"): 1, ("tasks", "status check", "a"): 1,
        ("tasks", "type not null", "b"): 1, ("tasks", "updated_at not null", "b"): 1,
        ("task_executions", "status check", "e2"): 1, ("task_executions", "unique task_id attempt", "a/1"): 2,
        ("task_executions", "foreign key task_id", "z"): 1}
    assert checks.constraint_violations(tasks, execs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_unique_keys_are_told_apart_in_more_tasks_the_more_rows(spark, monkeypatch):
    monkeypatch.setattr(checks, "ROWS_PER_TASK", 100)
    tasks = spark.range(450).select(F.when(F.col("id") < 440, F.concat(F.lit("k"), F.col("id") % 437)).alias("id"))
    execs = spark.range(1000).select(F.concat(F.lit("e"), "id").alias("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(
        F.concat(F.lit("t"), "id")).alias("task_id"), F.when(F.col("id") % 10 > 0, 1).alias("attempt"))
    found = checks.unique_violations(tasks, execs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("task_executions", "unique task_id attempt", "hot/1", 400),
                                                   *[("tasks", "primary key", f"k{i}", 2) for i in range(3)]]
    assert plan.count("Exchange") == 3 and plan.count(", 5), REPARTITION_BY_NUM") == 1 and plan.count(", 10), REPARTITION_BY_NUM") == 2
