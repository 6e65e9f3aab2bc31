"""The test tables seen as tasks, deliveries, messages, requests, logs, spans and samples.

Each view is one SQL text that Spark and the checking engine both run, over whole tables. Ids
are UUIDs made from the row keys. Every fiftieth supplier's deliveries name a task that does not
exist.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from workloom.session import use_rocksdb_state

_TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations"


def _uuid(key: str, tail: str = "'000000000000'") -> str:
    """SQL for an id made from a whole number; `tail` gives its last twelve hex digits.

    The digits come lowest first, so that ids differ in their first characters as random ones do.
    """
    digits = f"reverse(lpad(cast({key} AS string), 12, '0'))"
    return f"concat(substr({digits}, 1, 8), '-', substr({digits}, 9, 4), '-4000-8000-', {tail})"


_ABSENT = "'ffffffffffff'"
_TASK_ID = _uuid("l_orderkey", "CASE WHEN l_suppkey % 50 = 0 THEN 'ffffffffffff' ELSE '000000000000' END")
_PAIR_ID = _uuid("l_orderkey", "lpad(cast(l_linenumber AS string), 12, '0')")
_ATTEMPT_ID = _uuid("l_orderkey", "concat(lpad(cast(l_linenumber AS string), 3, '0'), lpad(cast(l_partkey AS string), 9, '0'))")

VIEWS = {
    "tasks": f"""
        SELECT {_uuid('o_orderkey')} AS id,
               CASE o_custkey % 10 WHEN 0 THEN 'unknown' WHEN 1 THEN 'fail' ELSE 'demo' END AS type,
               concat('{{"cust":', cast(o_custkey AS string), '}}') AS payload,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
                    WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'normal' END AS priority,
               CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'F' THEN 'completed'
                    WHEN o_orderkey % 4 = 0 THEN 'processing' WHEN o_orderkey % 4 = 1 THEN 'failed'
                    WHEN o_orderkey % 4 = 2 THEN 'cancelled' ELSE 'queued' END AS status,
               o_orderdate AS created_at, o_orderdate AS updated_at, 1 AS version
        FROM orders""",
    "execution_attempts": f"""
        SELECT {_ATTEMPT_ID} AS id,
               {_TASK_ID} AS task_id, l_linenumber AS attempt,
               CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'started' END AS status,
               CASE l_returnflag WHEN 'R' THEN concat('handler error ', cast(l_suppkey AS string)) END AS error,
               l_shipdate AS started_at,
               CASE WHEN l_returnflag <> 'N' THEN l_shipdate + INTERVAL 1 DAY END AS finished_at,
               l_partkey AS tie
        FROM lineitem""",
    "recorded_executions": f"""
        SELECT {_PAIR_ID} AS id,
               {_uuid('l_orderkey')} AS task_id, l_linenumber AS attempt, 'failed' AS status,
               'recorded before' AS error, min(l_shipdate) AS started_at, max(l_shipdate) AS finished_at
        FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey, l_linenumber""",
    "deliveries": f"""
        SELECT {_TASK_ID} AS task_id,
               CASE l_partkey % 40 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE l_linenumber END AS attempt, l_shipdate AS delivered_at,
               l_partkey AS tie,
               CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'R' THEN 'permanent' ELSE 'retryable' END AS outcome,
               concat('handler error ', cast(l_suppkey AS string)) AS error,
               CASE l_suppkey % 3 WHEN 0 THEN 'tasks.high' WHEN 1 THEN 'tasks.normal' ELSE 'tasks.low' END AS subject,
               CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS message_priority,
               concat('{{"task_id":"', {_TASK_ID}, '","priority":"', CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END, '"}}') AS data,
               l_quantity / 8 AS duration_seconds
        FROM lineitem""",
    "status_updates": f"""
        SELECT {_TASK_ID} AS id, CASE WHEN l_partkey % 30 <> 0 THEN 1 + l_linenumber % 3 END AS expected_version,
               CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'processing' END AS new_status,
               l_shipdate AS requested_at, l_linenumber AS tie1, l_partkey AS tie2
        FROM lineitem""",
    "create_requests": """
        SELECT event_id, ts AS received_at,
               CASE WHEN event_id % 97 = 1 THEN concat('{"type":"x","Type":"demo","payload":1,"PAYLOAD":{"n":2,"n":', event_id, '}}')
                    WHEN event_id % 97 = 2 THEN concat('{"type":"demo","type":null,"payload":{"big":', repeat('7', 50), event_id, '}}')
                    WHEN event_id % 97 = 3 THEN '{"type":"demo","Priority":5,"payload":{},"priority":"low"}'
               ELSE CASE event_id % 12
                 WHEN 0 THEN '{bad json'
                 WHEN 1 THEN '{"payload":{"k":1}}'
                 WHEN 2 THEN '{"type":"demo"}'
                 WHEN 3 THEN concat('{"type":"demo","payload":', props, ',"priority":"urgent"}')
                 WHEN 4 THEN concat('{"type":"demo","payload":', props, '}')
                 WHEN 5 THEN concat('{"type":"demo","payload":', props, ',"priority":"low"}')
                 WHEN 6 THEN concat('{"type":"fail","payload":', props, ',"priority":"high"}')
                 WHEN 7 THEN '{"type":"demo","payload":null}'
                 WHEN 8 THEN concat('{"type":"","payload":', props, '}')
                 WHEN 9 THEN concat('{"type":7,"payload":', props, '}')
                 WHEN 10 THEN concat('{"type":"demo","payload":', props, ',"priority":""}')
                 ELSE concat('{"type":"unknown","payload":', props, ',"priority":"normal"}') END END AS body
        FROM events""",
    "task_messages": f"""
        SELECT event_id AS seq, ts AS published_at,
               CASE WHEN event_id % 50 = 0 THEN concat('tasks.high', chr(10)) WHEN event_id % 50 = 1 THEN 'jobs.low'
                    WHEN user_id % 4 = 0 THEN 'tasks.high' WHEN user_id % 4 = 1 THEN 'tasks.normal' WHEN user_id % 4 = 2 THEN 'tasks.low' ELSE 'tasks.dlq' END AS subject,
               CASE WHEN event_id % 97 = 1 THEN concat('{{"task_id":"x","TASK_ID":"', {_uuid('user_id')}, '","priority":"low","priority":null}}')
               ELSE CASE event_id % 20
                 WHEN 0 THEN '{{bad'
                 WHEN 1 THEN '{{"task_id":"not-a-uuid","priority":"low"}}'
                 WHEN 2 THEN '[1]'
                 WHEN 3 THEN '{{"task_id":5,"priority":"low"}}'
                 WHEN 4 THEN '{{"priority":"low"}}'
                 WHEN 5 THEN concat('{{"task_id":"', replace({_uuid('user_id')}, '-', ''), '"}}')
                 WHEN 6 THEN concat('{{"task_id":"URN:UUID:', upper({_uuid('user_id')}), '","priority":"high"}}')
                 WHEN 7 THEN concat('{{"task_id":"{{', {_uuid('user_id')}, '}}","priority":"high"}}')
                 WHEN 8 THEN concat('{{"task_id":"', {_uuid('user_id')}, chr(92), 'n","priority":"high"}}')
                 ELSE concat('{{"task_id":"', {_uuid('user_id')}, '","priority":"normal"}}') END END AS data
        FROM events""",
    "http_requests": """
        SELECT event_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
               CASE event_type WHEN 'purchase' THEN '/api/v1/tasks' WHEN 'signup' THEN '/api/v1/tasks'
                    WHEN 'view' THEN concat('/api/v1/tasks/', cast(event_id AS string))
                    WHEN 'click' THEN concat('/api/v1/tasks/', cast(event_id AS string), '/executions')
                    ELSE '/api/v1/health' END AS path,
               CASE event_type WHEN 'error' THEN 500 WHEN 'purchase' THEN 201 WHEN 'signup' THEN 400 ELSE 200 END AS status,
               CASE WHEN event_id % 61 <> 0 THEN value / 100 END AS duration_seconds
        FROM events""",
    "log_lines": """
        SELECT event_id, ts, CASE user_id % 2 WHEN 0 THEN 'api' ELSE 'worker' END AS service,
               CASE WHEN event_id % 25 = 0 THEN 'not json' ELSE
               concat('{"level":"', CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'fatal' WHEN 1 THEN 'panic' WHEN 2 THEN 'dpanic' ELSE 'error' END WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END,
                      '","msg":"', event_type, '","request_id":"r', cast(event_id AS string), '","trace_id":"', md5(cast(user_id AS string)),
                      '","task_id":"', cast(user_id AS string), '"}') END AS line
        FROM events""",
    "access_lines": """
        SELECT event_id,
               concat('{"time":"2024-01-01T00:00:00+00:00","remote_addr":"10.0.0.', cast(user_id % 250 AS string),
                      '","request_id":"', CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('r', cast(event_id AS string)) END,
                      '","method":"GET","uri":"/api/v1/tasks/', cast(event_id AS string),
                      '","status":', CASE event_type WHEN 'error' THEN '502' ELSE '200' END,
                      ',"bytes_sent":', cast(user_id * 10 AS string), ',"request_time":0.25',
                      ',"upstream_addr":"api:8080","upstream_response_time":"0.010","user_agent":"probe"}') AS line
        FROM events""",
    "spans": """
        SELECT md5(cast(user_id AS string)) AS trace_id, event_id AS span_id, event_type AS name,
               CASE user_id % 2 WHEN 0 THEN 'api' ELSE 'worker' END AS service,
               ts AS start_ts, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ts - INTERVAL 5 HOUR ELSE ts + INTERVAL 10 MINUTE END AS end_ts,
               CASE WHEN event_id % 3 = 0 THEN cast(user_id AS string) END AS task_id,
               CASE WHEN event_id % 5 = 0 THEN concat('r', cast(event_id AS string)) END AS request_id
        FROM events""",
    "counter_samples": """
        SELECT event_type AS series, event_id, ts, CASE WHEN event_id % 97 <> 0 THEN cast(event_id % 200 AS double) END AS value
        FROM events""",
    "bucket_samples": """
        SELECT user_id % 5 AS instance, event_id, ts, le,
               cast(sum(CASE WHEN value / 100 <= CASE le WHEN '+Inf' THEN 1e300 ELSE cast(le AS double) END THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id % 5, le ORDER BY ts, event_id) AS double) AS value
        FROM events CROSS JOIN (VALUES ('0.5'), ('1'), ('2.5'), ('+Inf')) AS bounds(le)""",
    "dead_letters": f"""
        SELECT event_id AS seq, 'tasks.dlq' AS subject,
               CASE event_id % 6
                 WHEN 0 THEN '{{"task_id":'
                 WHEN 1 THEN '{{"task_id":"a","attempt":"five"}}'
                 WHEN 2 THEN CASE event_id % 4 WHEN 0 THEN '{{"task_id":"a","original_data":"e30"}}'
                                  ELSE '{{"task_id":"a","failed_at":"2024-01-02 03:04:05"}}' END
                 WHEN 3 THEN concat('{{"task_id":"b","attempt":2,"original_data":"', 'eyJ0YXNrX2lkIjoi', chr(92), 'r', chr(92), 'nMDEyMyJ9","failed_at":"2024-01-02T03:04:05Z"}}')
                 ELSE concat('{{"task_id":"', {_uuid('user_id')}, '","task_type":"', event_type,
                      '","attempt":', cast(1 + user_id % 5 AS string),
                      ',"error":"boom","original_subject":"tasks.low","original_data":"e30=","failed_at":"2024-01-02T03:04:05Z"}}')
               END AS data
        FROM events""",
    "lookup_ids": f"""
        SELECT CASE user_id % 10 WHEN 0 THEN concat('bad-', cast(user_id AS string))
                    WHEN 1 THEN {_uuid('event_id', _ABSENT)}
                    WHEN 2 THEN upper({_uuid('event_id')})
                    ELSE {_uuid('event_id')} END AS requested_id
        FROM events""",
    "execution_results": f"""
        SELECT CASE WHEN l_suppkey % 7 = 0 THEN {_uuid('l_orderkey', _ABSENT)}
                    ELSE {_PAIR_ID} END AS id,
               CASE l_returnflag WHEN 'A' THEN 'succeeded' ELSE 'failed' END AS status,
               CASE l_returnflag WHEN 'A' THEN NULL ELSE concat('late error ', cast(l_suppkey AS string)) END AS error,
               l_shipdate AS finished_at, l_linenumber AS tie1, l_partkey AS tie2, l_orderkey AS tie3
        FROM lineitem""",
    "deleted_ids": f"""
        SELECT {_uuid('o_orderkey')} AS id FROM orders WHERE o_orderstatus = 'P'""",
}


def view_sql(name: str) -> str:
    return VIEWS[name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the parquet files of `sf_dir`."""
    return spark.sql(re.sub(rf"\bFROM ({_TABLES})\b", rf"FROM parquet.`{sf_dir}/\1.parquet`", VIEWS[name]))


def stream_view(spark: SparkSession, sf_dir: str, table: str, name: str) -> DataFrame:
    """A view as a stream: its table's file is read as files are while they arrive."""
    use_rocksdb_state(spark)
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    literal = VIEWS[name].replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\bFROM {table}\b", "FROM {source}", literal), source=raw)
