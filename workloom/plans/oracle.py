"""For each named query, SQL with the same result for a single-node engine."""

from workloom.plans.views import view_sql
from workloom.schemas import HISTOGRAM_BOUNDS

ORACLES: dict[str, str] = {}

_UUID_FORM = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _dashed(h: str) -> str:
    return (f"lower(concat(substr({h},1,8),'-',substr({h},9,4),'-',substr({h},13,4),'-',"
            f"substr({h},17,4),'-',substr({h},21,12)))")


def _canonical_id(x: str) -> str:
    core = (f"(CASE WHEN length({x}) = 45 AND lower(substr({x},1,9)) = 'urn:uuid:' THEN substr({x},10) "
            f"WHEN length({x}) = 38 THEN substr({x},2,36) ELSE {x} END)")
    return (f"CASE WHEN regexp_full_match({core}, '{_UUID_FORM}') THEN lower({core}) "
            f"WHEN regexp_full_match({x}, '[0-9a-fA-F]{{32}}') THEN {_dashed(x)} END")


def _with(views: str, body: str) -> str:
    parts = [f"{name} AS ({view_sql(name)})" for name in views.split()]
    head = "WITH RECURSIVE " + ",\n".join(parts)
    body = body.strip()
    return f"{head},\n{body[1:].lstrip()}" if body.startswith(",") else f"{head}\n{body}"


def _add(name: str, views: str, body: str) -> None:
    ORACLES[name] = _with(views, body)


# Sources and sinks

_TASK_COLUMNS = "id, type, payload, priority, status, created_at, updated_at, version"

_add("scan_tasks", "tasks", f"SELECT {_TASK_COLUMNS} FROM tasks")
_add("scan_executions", "execution_attempts",
     "SELECT id, task_id, attempt, status, error, started_at, finished_at FROM execution_attempts")
_add("subject_match", "task_messages",
     "SELECT seq, subject FROM task_messages WHERE regexp_full_match(subject, 'tasks[.][^.]+') AND NOT contains(subject, chr(10))")
_add("publish_messages", "tasks", """
SELECT concat('tasks.', priority) AS subject,
       concat('{"task_id":"', id, '","priority":"', priority, '"}') AS data FROM tasks""")
_add("replicate_messages", "task_messages", """
SELECT seq, cast(c.copy AS integer) AS copy, published_at + to_microseconds(c.copy * 50000) AS published_at, subject
FROM task_messages CROSS JOIN (VALUES (0), (1), (2)) c(copy)""")
_add("retention", "task_messages", """
SELECT seq, published_at FROM task_messages
WHERE published_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOUR""")
_add("dlq_read", "dead_letters", """
, fields AS (
  SELECT seq, json_valid(data) AS ok, CASE WHEN json_valid(data) THEN data ELSE '{}' END AS data FROM dead_letters),
judged AS (
  SELECT *, replace(replace(data->>'original_data', chr(13), ''), chr(10), '') AS code,
         ok AND coalesce(json_type(data, '$.attempt'), 'NULL') IN ('UBIGINT', 'BIGINT', 'NULL')
         AND coalesce(regexp_full_match(data->>'failed_at', '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})'), true)
         AND coalesce(regexp_full_match(replace(replace(data->>'original_data', chr(13), ''), chr(10), ''),
               '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?'), true) AS good FROM fields)
SELECT seq, CASE WHEN good THEN 'letter' ELSE 'bad' END AS kind,
       CASE WHEN good THEN data->>'task_id' END AS task_id, CASE WHEN good THEN data->>'task_type' END AS task_type,
       CASE WHEN good THEN cast(data->>'attempt' AS integer) END AS attempt, CASE WHEN good THEN data->>'error' END AS error,
       CASE WHEN good THEN data->>'original_subject' END AS original_subject,
       CASE WHEN good THEN decode(from_base64(code)) END AS original_data,
       CASE WHEN good THEN cast(cast(data->>'failed_at' AS timestamptz) AT TIME ZONE 'UTC' AS timestamp) END AS failed_at
FROM judged""")
_LOG_FIELDS = ", ".join(f"CASE WHEN json_valid(line) THEN line->>'{f}' END AS {f}"
                        for f in ("level", "msg", "request_id", "trace_id", "task_id"))
_add("parse_logs", "log_lines", f"SELECT event_id, ts, service, {_LOG_FIELDS} FROM log_lines")
_add("parse_access", "access_lines", """
SELECT event_id, line->>'time' AS time, line->>'remote_addr' AS remote_addr,
       CASE WHEN line->>'request_id' = '' THEN md5(cast(event_id AS string)) ELSE line->>'request_id' END AS request_id,
       line->>'method' AS method, line->>'uri' AS uri, cast(line->>'status' AS integer) AS status,
       cast(line->>'bytes_sent' AS bigint) AS bytes_sent, cast(line->>'request_time' AS double) AS request_time,
       line->>'upstream_addr' AS upstream_addr, line->>'upstream_response_time' AS upstream_response_time,
       line->>'user_agent' AS user_agent
FROM access_lines""")
_DAY = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
_add("export_json", "tasks execution_attempts", f"""
SELECT concat('{{"id":"', id, '","task_id":"', task_id, '","attempt":', attempt, ',"status":"', status, '"',
              CASE WHEN error IS NOT NULL THEN concat(',"error":"', error, '"') ELSE '' END,
              ',"started_at":"', {_DAY.format('started_at')}, '"',
              CASE WHEN finished_at IS NOT NULL THEN concat(',"finished_at":"', {_DAY.format('finished_at')}, '"') ELSE '' END,
              '}}') AS json FROM execution_attempts
UNION ALL
SELECT concat('{{"id":"', id, '","type":"', type, '","payload":', payload, ',"priority":"', priority,
              '","status":"', status, '","created_at":"', {_DAY.format('created_at')}, '","updated_at":"',
              {_DAY.format('updated_at')}, '","version":', version, '}}') AS json FROM tasks""")

# Validation, projection and filters

_INGEST = """
, shaped AS (
  SELECT event_id, received_at, body, json_valid(body) AS ok,
         CASE WHEN json_valid(body) THEN json_type(body, '$.type') END AS type_kind,
         CASE WHEN json_valid(body) THEN json_type(body, '$.priority') END AS priority_kind,
         CASE WHEN json_valid(body) THEN coalesce(body->>'type', '') END AS t,
         CASE WHEN json_valid(body) THEN coalesce(body->>'priority', '') END AS p,
         CASE WHEN json_valid(body) THEN list_contains(json_keys(body), 'payload') END AS has_payload,
         CASE WHEN json_valid(body) THEN cast(json_extract(body, '$.payload') AS string) END AS payload_text
  FROM create_requests),
judged AS (
  SELECT *, CASE WHEN NOT ok OR coalesce(type_kind, 'NULL') NOT IN ('VARCHAR', 'NULL')
                      OR coalesce(priority_kind, 'NULL') NOT IN ('VARCHAR', 'NULL') THEN 'malformed body'
                 WHEN t = '' THEN 'type is required'
                 WHEN NOT has_payload THEN 'payload is required'
                 WHEN p NOT IN ('', 'low', 'normal', 'high') THEN 'priority must be low|normal|high' END AS details
  FROM shaped),
ingested AS (
  SELECT event_id, received_at,
         CASE WHEN details IS NULL THEN t END AS type,
         CASE WHEN details IS NULL THEN replace(payload_text, ' ', '') END AS payload,
         CASE WHEN details IS NULL THEN CASE p WHEN '' THEN 'normal' ELSE p END END AS priority,
         CASE WHEN details = 'malformed body' THEN 'invalid_json'
              WHEN details IS NOT NULL THEN 'validation_error' END AS error, details
  FROM judged WHERE event_id % 97 NOT IN (1, 2, 3)
  UNION ALL SELECT event_id, received_at, 'demo', concat('{"n":', event_id, '}'), 'normal', NULL, NULL
  FROM create_requests WHERE event_id % 97 = 1
  UNION ALL SELECT event_id, received_at, 'demo', concat('{"big":', repeat('7', 50), event_id, '}'), 'normal', NULL, NULL
  FROM create_requests WHERE event_id % 97 = 2
  UNION ALL SELECT event_id, received_at, NULL, NULL, NULL, 'invalid_json', 'malformed body'
  FROM create_requests WHERE event_id % 97 = 3)
"""
_add("ingest_validate", "create_requests",
     _INGEST + "SELECT event_id, type, payload, priority, error, details FROM ingested")
_add("new_tasks", "create_requests", _INGEST + f"""
SELECT {_dashed('md5(cast(event_id AS string))')} AS id, type, payload, priority, 'queued' AS status,
       received_at AS created_at, received_at AS updated_at, 1 AS version
FROM ingested WHERE error IS NULL""")
_add("route_priority", "create_requests", _INGEST + """
SELECT event_id, priority, concat('tasks.', priority) AS subject FROM ingested WHERE error IS NULL""")

_add("constraint_violations", "tasks execution_attempts", """
SELECT 'tasks' AS table_name, id AS row_id, 'status check' AS rule FROM tasks WHERE status = 'cancelled'
UNION ALL SELECT 'tasks', id, 'payload not null' FROM tasks WHERE type = 'unknown'
UNION ALL SELECT 'tasks', id, 'priority check' FROM tasks WHERE type = 'fail'
UNION ALL SELECT 'task_executions', id, 'status check' FROM execution_attempts WHERE status = 'started'""")
_UNIQUE = """
SELECT 'tasks' AS table_name, 'primary key' AS rule, id AS key_value, count(*) AS n_rows
FROM tasks GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'task_executions', 'primary key', id, count(*) FROM execution_attempts GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'task_executions', 'unique task_id attempt', concat(task_id, '/', attempt), count(*)
FROM execution_attempts GROUP BY task_id, attempt HAVING count(*) > 1"""
_DANGLING = """
SELECT task_id, count(*) AS n_rows FROM execution_attempts
WHERE NOT EXISTS (SELECT 1 FROM tasks WHERE tasks.id = task_id) GROUP BY task_id"""
_add("unique_violations", "tasks execution_attempts", _UNIQUE)
_add("fk_violations", "tasks execution_attempts", _DANGLING)
_add("violations", "tasks execution_attempts", f"""{_UNIQUE}
UNION ALL SELECT 'task_executions', 'foreign key task_id', task_id, n_rows FROM ({_DANGLING})""")

_add("violations_of_nulls", "tasks execution_attempts", f"""
, holed AS (
  SELECT id, CASE WHEN tie % 11 <> 0 THEN task_id END AS task_id, CASE WHEN tie % 3 <> 0 THEN attempt END AS attempt
  FROM execution_attempts)
SELECT 'tasks' AS table_name, 'primary key' AS rule, id AS key_value, count(*) AS n_rows
FROM tasks GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'task_executions', 'primary key', id, count(*) FROM holed GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'task_executions', 'unique task_id attempt', concat(task_id, '/', attempt), count(*)
FROM holed WHERE task_id IS NOT NULL AND attempt IS NOT NULL GROUP BY task_id, attempt HAVING count(*) > 1
UNION ALL SELECT 'task_executions', 'foreign key task_id', task_id, count(*) FROM holed
WHERE task_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tasks WHERE tasks.id = task_id) GROUP BY task_id
UNION ALL SELECT 'task_executions', 'task_id not null', id, count(*) FROM holed WHERE task_id IS NULL GROUP BY id
UNION ALL SELECT 'task_executions', 'attempt not null', id, count(*) FROM holed WHERE attempt IS NULL GROUP BY id""")
_DECODED = f"""
, shaped AS (
  SELECT seq, data, json_valid(data) AND json_type(data) IN ('OBJECT', 'NULL')
         AND coalesce(json_type(data, '$.task_id'), 'NULL') IN ('VARCHAR', 'NULL')
         AND coalesce(json_type(data, '$.priority'), 'NULL') IN ('VARCHAR', 'NULL') AS ok
  FROM (SELECT seq, CASE WHEN json_valid(data) THEN data ELSE '0' END AS data
        FROM task_messages WHERE {{0}})),
fields AS (
  SELECT seq, ok, CASE WHEN seq % 97 = 1 THEN data->>'TASK_ID' WHEN ok THEN data->>'task_id' END AS raw_id,
         CASE WHEN seq % 97 = 1 THEN 'low' WHEN ok THEN coalesce(data->>'priority', '') END AS p FROM shaped),
ids AS (SELECT *, {_canonical_id('raw_id')} AS task_id FROM fields)
SELECT seq, task_id, CASE WHEN task_id IS NOT NULL THEN p END AS priority,
       CASE WHEN NOT ok THEN 'bad_message' WHEN task_id IS NULL THEN 'bad_task_id' END AS reject FROM ids"""
_add("decode_messages", "task_messages", _DECODED.replace("{0}", "subject <> 'tasks.dlq'"))
_add("decode_all_messages", "task_messages", _DECODED.replace("{0}", "true"))
_add("filter_tasks", "tasks", "SELECT * FROM tasks WHERE status = 'queued' AND type = 'demo'")
_add("log_min_level", "log_lines", """
SELECT event_id, line->>'level' AS level, line->>'msg' AS msg
FROM (SELECT event_id, CASE WHEN json_valid(line) THEN line ELSE '{}' END AS line FROM log_lines)
WHERE line->>'level' IN ('warn', 'error', 'dpanic', 'panic', 'fatal')""")
_add("http_errors", "http_requests",
     "SELECT event_id, status, status >= 500 AS server_error FROM http_requests")

# Lookups, joins and change sets

_add("get_tasks", "tasks lookup_ids", f"""
, asked AS (SELECT DISTINCT requested_id, {_canonical_id('requested_id')} AS id FROM lookup_ids)
SELECT requested_id, CASE WHEN asked.id IS NULL THEN 'invalid' WHEN tasks.id IS NOT NULL THEN 'found' ELSE 'not_found' END AS lookup,
       type AS task_type, payload AS task_payload, priority AS task_priority, status AS task_status,
       created_at AS task_created_at, updated_at AS task_updated_at, version AS task_version
FROM asked LEFT JOIN tasks ON tasks.id = asked.id""")
_add("enrich_deliveries", "tasks deliveries", """
SELECT d.task_id, d.delivered_at, d.attempt, d.tie, t.type AS task_type, t.priority AS task_priority,
       t.status AS task_status, t.version AS task_version
FROM deliveries d LEFT JOIN tasks t ON t.id = d.task_id""")

_CAS = """
, numbered AS (
  SELECT u.*, row_number() OVER (PARTITION BY u.id ORDER BY requested_at, tie1, tie2) AS n
  FROM status_updates u),
walk AS (
  SELECT t.id, 0::bigint AS n, t.version, t.status, t.updated_at, NULL::boolean AS taken FROM tasks t
  UNION ALL
  SELECT w.id, r.n, CASE WHEN r.expected_version = w.version THEN w.version + 1 ELSE w.version END,
         CASE WHEN r.expected_version = w.version THEN r.new_status ELSE w.status END,
         CASE WHEN r.expected_version = w.version THEN r.requested_at ELSE w.updated_at END,
         r.expected_version = w.version
  FROM walk w JOIN numbered r ON r.id = w.id AND r.n = w.n + 1)
"""
_add("cas_updates", "tasks status_updates", _CAS + """
SELECT id, arg_max(status, n) AS status, cast(arg_max(version, n) AS integer) AS version,
       arg_max(updated_at, n) AS updated_at FROM walk GROUP BY id""")
_add("cas_outcomes", "tasks status_updates", _CAS + """
SELECT r.id, r.requested_at, r.tie1, r.tie2, r.expected_version, r.new_status,
       CASE WHEN w.id IS NULL THEN 'not_found' WHEN w.taken THEN 'updated' ELSE 'version_conflict' END AS outcome
FROM numbered r LEFT JOIN walk w ON w.id = r.id AND w.n = r.n""")

_INSERTED = """
, ranked AS (
  SELECT e.*, row_number() OVER (PARTITION BY task_id, attempt ORDER BY started_at, tie) AS nth,
         EXISTS (SELECT 1 FROM recorded_executions r WHERE r.task_id = e.task_id AND r.attempt = e.attempt) AS known
  FROM execution_attempts e)
"""
_add("insert_ignore", "recorded_executions execution_attempts", _INSERTED + """
SELECT id, task_id, attempt, status, error, started_at, finished_at FROM recorded_executions
UNION ALL SELECT id, task_id, attempt, status, error, started_at, finished_at FROM ranked WHERE nth = 1 AND NOT known""")
_add("insert_outcomes", "recorded_executions execution_attempts", _INSERTED + """
SELECT id, task_id, attempt, CASE WHEN nth = 1 AND NOT known THEN 'inserted' ELSE 'already_exists' END AS outcome
FROM ranked""")
_add("insert_known_tasks", "tasks recorded_executions execution_attempts", """
, ranked AS (
  SELECT e.*, row_number() OVER (PARTITION BY task_id, attempt ORDER BY started_at, tie, id) AS nth,
         EXISTS (SELECT 1 FROM recorded_executions r WHERE r.task_id = e.task_id AND r.attempt = e.attempt) AS known,
         EXISTS (SELECT 1 FROM tasks t WHERE t.id = e.task_id) AS has_task
  FROM execution_attempts e)
SELECT id, task_id, attempt, CASE WHEN NOT has_task THEN 'unknown_task' WHEN nth = 1 AND NOT known THEN 'inserted'
       ELSE 'already_exists' END AS outcome FROM ranked""")
_FINISHED = """
, last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY finished_at DESC, tie1 DESC, tie2 DESC, tie3 DESC) AS r
                 FROM execution_results) WHERE r = 1)
"""
_add("finish_executions", "recorded_executions execution_results", _FINISHED + """
SELECT e.id, e.task_id, e.attempt, CASE WHEN l.id IS NULL THEN e.status ELSE l.status END AS status,
       CASE WHEN l.id IS NULL THEN e.error ELSE l.error END AS error, e.started_at,
       CASE WHEN l.id IS NULL THEN e.finished_at ELSE l.finished_at END AS finished_at
FROM recorded_executions e LEFT JOIN last l ON l.id = e.id""")
_add("finish_outcomes", "recorded_executions execution_results", _FINISHED + """
SELECT l.id, CASE WHEN e.id IS NULL THEN 'not_found' ELSE 'finished' END AS outcome
FROM last l LEFT JOIN recorded_executions e ON l.id = e.id""")
_add("cascade_delete", "tasks execution_attempts deleted_ids", """
SELECT 'tasks' AS table_name, id FROM tasks WHERE id NOT IN (SELECT id FROM deleted_ids)
UNION ALL SELECT 'task_executions', id FROM execution_attempts WHERE task_id NOT IN (SELECT id FROM deleted_ids)""")
_add("trace_logs", "spans log_lines", """
, parsed AS (
  SELECT event_id AS log_id, ts, service, line->>'trace_id' AS trace_id, line->>'level' AS level
  FROM log_lines WHERE json_valid(line))
SELECT s.service, s.trace_id, s.span_id, p.log_id, p.level
FROM spans s JOIN parsed p ON p.service = s.service AND p.trace_id = s.trace_id
  AND p.ts BETWEEN s.start_ts - INTERVAL 1 HOUR AND greatest(s.start_ts, coalesce(s.end_ts, s.start_ts)) + INTERVAL 1 HOUR""")
_add("trace_logs_by_ids", "spans log_lines", """
, parsed AS (
  SELECT event_id AS log_id, ts, service, line->>'trace_id' AS trace_id, line->>'task_id' AS task_id,
         line->>'request_id' AS request_id FROM log_lines WHERE json_valid(line))
SELECT s.span_id, p.log_id
FROM spans s JOIN parsed p ON p.service = s.service AND p.trace_id = s.trace_id
  AND (s.task_id IS NULL OR p.task_id = s.task_id) AND (s.request_id IS NULL OR p.request_id = s.request_id)
  AND p.ts BETWEEN s.start_ts - INTERVAL 1 HOUR AND greatest(s.start_ts, coalesce(s.end_ts, s.start_ts)) + INTERVAL 1 HOUR""")

# Lifecycle


def _replayed(existing: bool) -> str:
    known = ("EXISTS (SELECT 1 FROM recorded_executions r WHERE r.task_id = d.task_id AND r.attempt = d.attempt)"
             if existing else "false")
    return f"""
, placed AS (
  SELECT d.*, t.id AS known_id, t.type AS task_type, t.status AS first_status, {known} AS pair_exists,
         row_number() OVER (PARTITION BY d.task_id, d.attempt ORDER BY delivered_at, d.attempt, tie) AS nth,
         row_number() OVER (PARTITION BY d.task_id ORDER BY delivered_at, d.attempt, tie) AS seq
  FROM (SELECT * REPLACE (cast(greatest(coalesce(attempt, 1), 1) AS integer) AS attempt) FROM deliveries) d
  LEFT JOIN tasks t ON t.id = d.task_id),
own AS (
  SELECT *, CASE WHEN known_id IS NULL THEN 'not_found'
    WHEN first_status IN ('completed', 'failed', 'cancelled') THEN 'terminal_noop'
    WHEN first_status = 'processing' THEN 'in_flight_noop'
    WHEN attempt > 5 THEN 'max_attempts_dlq'
    WHEN task_type NOT IN ('demo', 'fail') THEN 'no_handler_dlq'
    WHEN nth > 1 OR pair_exists THEN 'dup_execution_stuck'
    WHEN outcome = 'ok' THEN 'completed' WHEN outcome = 'permanent' THEN 'permanent_dlq'
    WHEN attempt >= 5 THEN 'exhausted_dlq' ELSE 'requeued' END AS loc FROM placed),
looked AS (
  SELECT *, count(CASE WHEN loc <> 'requeued' THEN 1 END) OVER w AS prior_end,
         first_value(CASE WHEN loc <> 'requeued' THEN loc END IGNORE NULLS) OVER w AS prior_loc
  FROM own WINDOW w AS (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
replayed AS (
  SELECT *, CASE WHEN prior_end = 0 OR known_id IS NULL OR first_status <> 'queued' THEN loc
                 WHEN prior_loc = 'dup_execution_stuck' THEN 'in_flight_noop' ELSE 'terminal_noop' END AS disposition
  FROM looked)
"""


_REPLAY = _replayed(False)
_REPLAY_KNOWN = _replayed(True)
_EFFECTIVE = "disposition NOT IN ('not_found', 'terminal_noop', 'in_flight_noop')"
_RAN = "disposition IN ('completed', 'permanent_dlq', 'exhausted_dlq', 'requeued')"
_ERROR = """CASE disposition WHEN 'max_attempts_dlq' THEN 'max attempts exceeded (5)'
  WHEN 'no_handler_dlq' THEN concat('no handler registered for type "', task_type, '"')
  WHEN 'permanent_dlq' THEN error WHEN 'exhausted_dlq' THEN error WHEN 'requeued' THEN error END"""

_add("replay_dispositions", "tasks deliveries", _REPLAY +
     "SELECT task_id, attempt, delivered_at, tie, disposition FROM replayed")
_add("replay_with_executions", "tasks deliveries recorded_executions", _REPLAY_KNOWN +
     "SELECT task_id, attempt, delivered_at, tie, disposition FROM replayed")
_add("replay_final_tasks", "tasks deliveries", _REPLAY + f"""
, changed AS (
  SELECT task_id, arg_max(disposition, seq) AS last, arg_max(delivered_at, seq) AS changed_at,
         sum(CASE WHEN disposition IN ('max_attempts_dlq', 'dup_execution_stuck') THEN 1 ELSE 2 END) AS steps
  FROM replayed WHERE {_EFFECTIVE} GROUP BY task_id)
SELECT id, type, payload, priority,
       CASE WHEN last IS NULL THEN status WHEN last = 'completed' THEN 'completed' WHEN last = 'requeued' THEN 'queued'
            WHEN last = 'dup_execution_stuck' THEN 'processing' ELSE 'failed' END AS status,
       created_at, coalesce(changed_at, updated_at) AS updated_at, cast(version + coalesce(steps, 0) AS integer) AS version
FROM tasks LEFT JOIN changed ON task_id = id""")
_add("replay_executions", "tasks deliveries recorded_executions", _REPLAY_KNOWN + f"""
SELECT {_dashed("md5(concat(task_id, ':', attempt))")} AS id, task_id, attempt,
       CASE disposition WHEN 'completed' THEN 'succeeded' ELSE 'failed' END AS status, {_ERROR} AS error,
       delivered_at AS started_at, delivered_at AS finished_at
FROM replayed WHERE {_RAN} OR (disposition IN ('max_attempts_dlq', 'no_handler_dlq') AND NOT pair_exists)""")
_add("dlq_records", "tasks deliveries", _REPLAY + f"""
SELECT 'tasks.dlq' AS subject,
       concat('{{"task_id":"', task_id, '","task_type":"', task_type, '","attempt":', attempt, ',"error":',
              to_json({_ERROR}), ',"original_subject":"', subject, '","original_data":"', to_base64(encode(data)),
              '","failed_at":"', strftime(delivered_at, '%Y-%m-%dT%H:%M:%SZ'), '"}}') AS data,
       task_id AS header_task_id
FROM replayed WHERE disposition IN ('max_attempts_dlq', 'no_handler_dlq', 'permanent_dlq', 'exhausted_dlq')""")
_add("attempt_numbers", "deliveries", """
SELECT task_id, delivered_at, attempt AS line, tie,
       cast(row_number() OVER (PARTITION BY task_id ORDER BY delivered_at, attempt NULLS FIRST, tie) AS integer) AS attempt
FROM deliveries""")
_add("retry_schedule", "tasks deliveries", _REPLAY + f"""
, timed AS (
  SELECT *, CASE disposition WHEN 'requeued' THEN
    cast(least(500 * (1::bigint << (least(greatest(attempt, 1) - 1, 40))::integer), 10000) AS bigint) END AS delay_ms
  FROM replayed WHERE {_EFFECTIVE})
SELECT task_id, attempt, delivered_at, disposition,
       CASE disposition WHEN 'requeued' THEN 'retry' ELSE 'ack' END AS action, delay_ms,
       delivered_at + to_milliseconds(delay_ms) AS next_at FROM timed""")

# Listings

_add("list_tasks", "tasks", f"""
SELECT {_TASK_COLUMNS} FROM tasks WHERE status = 'queued' ORDER BY created_at DESC, id LIMIT 50 OFFSET 20""")
_add("list_tasks_by_position", "tasks", f"""
SELECT {_TASK_COLUMNS} FROM tasks WHERE type = 'demo' ORDER BY created_at DESC, id LIMIT 200 OFFSET 700""")
_add("list_executions", "execution_attempts", """
SELECT id, task_id, attempt, status, error, started_at, finished_at FROM execution_attempts
WHERE task_id = '10000000-0000-4000-8000-000000000000' ORDER BY attempt DESC, id LIMIT 50""")
_add("latest_executions", "execution_attempts", """
SELECT task_id, attempt, id, cast(recency AS integer) AS recency FROM (
  SELECT task_id, attempt, id, row_number() OVER (PARTITION BY task_id ORDER BY attempt DESC, id) AS recency
  FROM execution_attempts) WHERE recency <= 2""")

# Metrics

_add("m_tasks_started", "tasks deliveries", _REPLAY + f"""
SELECT task_type AS type, message_priority AS priority, count(*) AS value FROM replayed WHERE {_RAN} GROUP BY ALL""")
_add("m_tasks_completed", "tasks deliveries", _REPLAY + """
SELECT task_type AS type, count(*) AS value FROM replayed WHERE disposition = 'completed' GROUP BY ALL""")
_add("m_tasks_failed", "tasks deliveries", _REPLAY + """
SELECT task_type AS type, CASE disposition WHEN 'permanent_dlq' THEN 'permanent' ELSE 'retryable' END AS reason,
       count(*) AS value FROM replayed
WHERE disposition IN ('permanent_dlq', 'exhausted_dlq', 'requeued') GROUP BY ALL""")

_BOUNDS = ", ".join(f"('{b:g}', {b!r}::double)" for b in HISTOGRAM_BOUNDS) + ", ('+Inf', 'infinity'::double)"
_ROUTE = """CASE WHEN regexp_matches(path, '^/api/v1/tasks/[^/]+$') THEN '/api/v1/tasks/{id}'
     WHEN regexp_matches(path, '^/api/v1/tasks/[^/]+/executions$') THEN '/api/v1/tasks/{id}/executions' ELSE path END"""
_add("m_task_duration", "tasks deliveries", _REPLAY + f"""
, ran AS (SELECT task_type AS type, duration_seconds AS v FROM replayed WHERE {_RAN}),
totals AS (SELECT type, sum(v) AS total_sum, count(*) AS total_count FROM ran GROUP BY type)
SELECT ran.type, le, count(CASE WHEN v <= bound THEN 1 END) AS bucket_count, any_value(total_sum) AS total_sum,
       any_value(total_count) AS total_count
FROM ran JOIN totals ON totals.type = ran.type CROSS JOIN (VALUES {_BOUNDS}) b(le, bound) GROUP BY ran.type, le""")
_add("m_http_requests", "http_requests", f"""
SELECT {_ROUTE} AS route, method, cast(status AS string) AS status, count(*) AS value FROM http_requests GROUP BY ALL""")
_add("m_http_duration", "http_requests", f"""
, r AS (SELECT {_ROUTE} AS route, method, duration_seconds AS v FROM http_requests WHERE duration_seconds IS NOT NULL)
SELECT route, method, le, count(CASE WHEN v <= bound THEN 1 END) AS bucket_count,
       round(sum(v), 4) AS total_sum, count(*) AS total_count
FROM r CROSS JOIN (VALUES {_BOUNDS}) b(le, bound) GROUP BY route, method, le""")
_add("event_rate", "http_requests", """
, starts AS (
  SELECT (epoch_us(ts) // 600000000 - back) * 600000000 AS window_start_us
  FROM http_requests CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) o(back))
SELECT window_start_us, count(*) AS n_events, round(count(*) / 3600.0::double, 9) AS rate_per_sec
FROM starts GROUP BY window_start_us""")


def _rates(samples: str, labels: str, window_us: int, step_us: int) -> str:
    """Rates in windows of window_us that start every step_us, from (labels, event_id, ts, value)."""
    return f"""
, placed AS (
  SELECT {labels}, event_id, value, epoch_us(ts) AS us, (epoch_us(ts) // {step_us} - back) * {step_us} AS window_start_us
  FROM {samples} CROSS JOIN range(0, {window_us // step_us}) o(back) WHERE value IS NOT NULL),
stepped AS (
  SELECT *, lag(value) OVER (PARTITION BY {labels}, window_start_us ORDER BY us, event_id) AS before FROM placed),
summed AS (
  SELECT {labels}, window_start_us, count(*) AS n,
         sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END) AS inc,
         min(us) AS t0, max(us) AS t1, arg_min(value, (us, event_id)) AS v0
  FROM stepped GROUP BY {labels}, window_start_us HAVING count(*) >= 2 AND max(us) > min(us)),
spread AS (
  SELECT *, (t1 - t0) / 1e6::double AS covered, (t1 - t0) / 1e6::double / (n - 1) AS distance,
         (t0 - window_start_us) / 1e6::double AS to_start, (window_start_us + {window_us} - t1) / 1e6::double AS to_end
  FROM summed),
gaps AS (
  SELECT *, CASE WHEN to_start >= distance * 1.1::double THEN distance / 2 ELSE to_start END AS start_gap,
         CASE WHEN to_end >= distance * 1.1::double THEN distance / 2 ELSE to_end END AS end_gap FROM spread),
rates AS (
  SELECT {labels}, window_start_us, n AS n_samples, inc AS increase,
         inc * (covered + CASE WHEN inc > 0 AND v0 >= 0 THEN least(start_gap, covered * v0 / inc) ELSE start_gap END + end_gap)
         / covered / {window_us / 1e6}::double AS rate_per_sec FROM gaps)
"""


_RATES = _rates("counter_samples", "series", 86_400_000_000, 86_400_000_000)
_add("counter_rate_sliding", "counter_samples", _rates("counter_samples", "series", 43_200_000_000, 10_800_000_000) +
     "SELECT series, window_start_us, n_samples, increase, round(rate_per_sec, 6) AS rate_per_sec FROM rates")
_add("histogram_p95_rate", "bucket_samples", _rates("bucket_samples", "instance, le", 86_400_000_000, 86_400_000_000) + """
, summed_rates AS (
  SELECT window_start_us, CASE le WHEN '+Inf' THEN 'infinity'::double ELSE cast(le AS double) END AS bound, sum(rate_per_sec) AS n
  FROM rates GROUP BY ALL),
ranked AS (
  SELECT *, lag(bound) OVER w AS low, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY window_start_us) AS total,
         max(n) OVER (PARTITION BY window_start_us) * 0.95::double AS rank
  FROM summed_rates WINDOW w AS (PARTITION BY window_start_us ORDER BY bound)),
hit AS (SELECT *, row_number() OVER (PARTITION BY window_start_us ORDER BY bound) AS r FROM ranked WHERE n >= rank OR isinf(bound))
SELECT window_start_us, round(CASE WHEN total = 0 THEN 'nan'::double WHEN isinf(bound) THEN low
       ELSE coalesce(low, 0) + (bound - coalesce(low, 0)) * (rank - before) / (n - before) END, 6) AS quantile
FROM hit WHERE r = 1""")
_add("counter_rate", "counter_samples", _RATES +
     "SELECT series, window_start_us, n_samples, increase, round(rate_per_sec, 6) AS rate_per_sec FROM rates")
_add("counter_rate_total", "counter_samples", _RATES +
     "SELECT window_start_us, round(sum(rate_per_sec), 6) AS rate_per_sec FROM rates GROUP BY window_start_us")
_add("histogram_p95", "http_requests", f"""
, counted AS (
  SELECT epoch_us(ts) // 86400000000 AS day, bound, count(CASE WHEN duration_seconds <= bound THEN 1 END)::double AS n
  FROM http_requests CROSS JOIN (VALUES {_BOUNDS}) b(le, bound) WHERE duration_seconds IS NOT NULL GROUP BY day, bound),
placed AS (
  SELECT *, lag(bound) OVER w AS low, coalesce(lag(n) OVER w, 0) AS before,
         max(n) OVER (PARTITION BY day) * 0.95::double AS rank
  FROM counted WINDOW w AS (PARTITION BY day ORDER BY bound)),
hit AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY bound) AS r FROM placed WHERE n >= rank)
SELECT day, round(CASE WHEN isinf(bound) THEN low
       ELSE coalesce(low, 0) + (bound - coalesce(low, 0)) * (rank - before) / (n - before) END, 6) AS quantile
FROM hit WHERE r = 1""")
_add("stream_stats", "task_messages", """
, per AS (SELECT subject, count(*) AS n_messages, sum(strlen(data)) AS n_bytes FROM task_messages GROUP BY subject)
SELECT 'TASKS' AS stream, subject, n_messages, cast(n_bytes AS bigint) AS n_bytes, 1::bigint AS n_subjects FROM per
UNION ALL SELECT 'TASKS', '*', cast(sum(n_messages) AS bigint), cast(sum(n_bytes) AS bigint), count(*) FROM per""")
_add("execution_audit", "tasks execution_attempts", """
, per AS (
  SELECT task_id, count(*) AS n, count(DISTINCT attempt) AS a,
         bool_or(coalesce(contains(error, 'no handler registered for type'), false)) AS explained
  FROM execution_attempts GROUP BY task_id)
SELECT id, type, status, coalesce(n, 0) AS n_executions, coalesce(a, 0) AS n_attempts,
       CASE WHEN type = 'demo' AND status = 'completed' AND coalesce(n, 0) > 1 THEN 'repeated_execution'
            WHEN type = 'demo' AND status = 'completed' AND coalesce(n, 0) = 0 THEN 'missing_execution'
            WHEN type NOT IN ('demo', 'fail') AND status = 'failed' AND NOT coalesce(explained, false) THEN 'wrong_error'
            ELSE 'ok' END AS finding
FROM tasks LEFT JOIN per ON task_id = id""")

# Scalar functions and sampling

_add("merge_arrays", "task_messages", """
, wanted AS (SELECT seq, [subject, 'tasks.normal'] AS own, ['tasks.high', 'tasks.normal', 'tasks.low', 'tasks.dlq'] AS asked FROM task_messages),
items AS (SELECT seq, unnest(own || asked) AS item, generate_subscripts(own || asked, 1) AS place FROM wanted),
firsts AS (SELECT seq, item, min(place) AS place FROM items GROUP BY seq, item)
SELECT f.seq, string_agg(f.item, ',' ORDER BY f.place) AS merged, bool_or(f.place > 2) AS changed FROM firsts f GROUP BY f.seq""")
_add("canonical_payload", "tasks", """
SELECT id, concat('{"cust":', payload->>'cust', ',"z":1}') AS payload FROM tasks""")
_add("first_non_blank", "task_messages", """
SELECT seq AS event_id, CASE WHEN seq % 2 = 0 THEN 'fallback' ELSE concat(' ', subject) END AS chosen FROM task_messages""")
_add("message_headers", "task_messages", """
SELECT seq, 'r' AS request_id, cast(seq AS string) AS task_id, '' AS absent, 'X-Request-Id,task_id' AS names
FROM task_messages""")
_add("trace_sample", "spans", f"""
SELECT trace_id, span_id FROM spans
WHERE (concat('0x', substr(trace_id, 17, 16))::ubigint >> 1) < {int(0.1 * 2**63)}""")

# Handlers and streams

_add("run_handlers", "tasks", """
SELECT id, type, CASE type WHEN 'demo' THEN 'ok' WHEN 'fail' THEN 'permanent' ELSE 'no_handler' END AS outcome,
       CASE type WHEN 'demo' THEN NULL WHEN 'fail' THEN 'requested failure for demo'
            ELSE concat('no handler registered for type "', type, '"') END AS error
FROM tasks WHERE status = 'queued'""")
_add("run_with_retries", "tasks", """
SELECT id, CASE WHEN status <> 'queued' THEN status WHEN type = 'demo' AND priority <> 'low' THEN 'completed'
                ELSE 'failed' END AS status,
       cast(CASE WHEN status <> 'queued' THEN 1 WHEN type = 'demo' AND priority = 'low' THEN 7 ELSE 3 END AS integer) AS version
FROM tasks""")
_add("retry_executions", "tasks", """
SELECT id AS task_id, cast(a.attempt AS integer) AS attempt,
       CASE WHEN type = 'demo' AND priority <> 'low' THEN 'succeeded' ELSE 'failed' END AS status,
       CASE WHEN type = 'demo' AND priority = 'low' THEN 'busy' WHEN type = 'fail' THEN 'requested failure for demo'
            WHEN type <> 'demo' THEN concat('no handler registered for type "', type, '"') END AS error,
       CASE WHEN type = 'demo' AND priority = 'low' AND a.attempt < 3 THEN 500 * a.attempt END::bigint AS retry_after_ms
FROM tasks JOIN (VALUES (1), (2), (3)) a(attempt) ON a.attempt = 1 OR (type = 'demo' AND priority = 'low')
WHERE status = 'queued'""")
_add("stream_redelivery", "tasks", """
, runs AS (
  SELECT *, a.attempt AS nth, type = 'demo' AND priority = 'low' AS flaky
  FROM tasks JOIN (VALUES (1), (2), (3)) a(attempt) ON a.attempt = 1 OR (type = 'demo' AND priority = 'low') WHERE status = 'queued'),
timed AS (SELECT *, created_at::timestamp + to_milliseconds(500 * ((1 << (nth - 1)) - 1)) AS moment FROM runs)
SELECT id AS task_id, nth::integer AS attempt, moment AS delivered_at,
       CASE WHEN flaky AND nth < 3 THEN 'requeued' WHEN flaky THEN 'exhausted_dlq' WHEN type = 'demo' THEN 'completed'
            WHEN type = 'fail' THEN 'permanent_dlq' ELSE 'no_handler_dlq' END AS disposition,
       CASE WHEN flaky THEN 'busy' WHEN type = 'fail' THEN 'requested failure for demo'
            WHEN type <> 'demo' THEN concat('no handler registered for type "', type, '"') END AS error,
       CASE WHEN flaky AND nth < 3 THEN 'queued' WHEN type = 'demo' AND NOT flaky THEN 'completed' ELSE 'failed' END AS status,
       (1 + 2 * nth)::integer AS version, CASE WHEN flaky AND nth < 3 THEN moment + to_milliseconds(500 * nth) END AS next_at
FROM timed""")
_TOTALS = """
, counted AS (SELECT task_id, disposition, count(*) AS n, max(seq) AS last_seq FROM replayed GROUP BY task_id, disposition),
versions AS (
  SELECT task_id, disposition, seq, known_id,
         1 + sum(CASE WHEN disposition IN ('max_attempts_dlq', 'dup_execution_stuck') THEN 1
                      WHEN disposition IN ('not_found', 'terminal_noop', 'in_flight_noop') THEN 0 ELSE 2 END)
             OVER (PARTITION BY task_id ORDER BY seq) AS v FROM replayed)
"""
_add("stream_replay", "tasks deliveries", _REPLAY + _TOTALS + """
SELECT task_id, disposition, count(*) AS n_deliveries,
       cast(max(CASE WHEN known_id IS NOT NULL THEN v END) AS integer) AS version
FROM versions GROUP BY task_id, disposition""")
_add("stream_dedup", "execution_attempts", "SELECT DISTINCT task_id, attempt FROM execution_attempts")
_add("dlq_round_trip", "tasks deliveries", _REPLAY + """
SELECT task_id, attempt, subject AS original_subject, data AS original_data
FROM replayed WHERE disposition IN ('max_attempts_dlq', 'no_handler_dlq', 'permanent_dlq', 'exhausted_dlq')""")
_add("stream_dlq", "tasks deliveries", _REPLAY + f"""
SELECT 'dead' AS lane, task_id,
       concat('{{"task_id":"', task_id, '","task_type":"', task_type, '","attempt":', attempt, ',"error":',
              to_json({_ERROR}), ',"original_subject":"', subject, '","original_data":"', to_base64(encode(data)),
              '","failed_at":"', strftime(delivered_at, '%Y-%m-%dT%H:%M:%SZ'), '"}}') AS data,
       NULL::integer AS attempt, NULL::timestamp AS next_at, NULL AS disposition, NULL::bigint AS n_deliveries
FROM replayed WHERE disposition IN ('max_attempts_dlq', 'no_handler_dlq', 'permanent_dlq', 'exhausted_dlq')
UNION ALL
SELECT 'retry', task_id, data, attempt, delivered_at + to_milliseconds(
         cast(least(500 * (1::bigint << (least(attempt - 1, 40))::integer), 10000) AS bigint)), NULL, NULL
FROM replayed WHERE disposition = 'requeued'
UNION ALL
SELECT 'good', NULL, NULL, NULL, NULL, disposition, count(*) FROM replayed
WHERE disposition IN ('completed', 'dup_execution_stuck', 'not_found', 'terminal_noop', 'in_flight_noop') GROUP BY disposition""")
_add("stream_dedup_bounded", "task_messages", "SELECT DISTINCT subject FROM task_messages")
_add("stream_histogram", "http_requests", f"""
, kept AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, method, duration_seconds AS v FROM http_requests
           WHERE duration_seconds IS NOT NULL),
ended AS (SELECT * FROM kept WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM http_requests))
SELECT window_start, method, le, count(CASE WHEN v <= bound THEN 1 END) AS bucket_count, count(*) AS total_count
FROM ended CROSS JOIN (VALUES {_BOUNDS}) b(le, bound) GROUP BY window_start, method, le""")
_add("stream_rate", "http_requests", """
, starts AS (
  SELECT make_timestamp((epoch_us(ts) // 43200000000 - back) * 43200000000) AS window_start
  FROM http_requests CROSS JOIN (VALUES (0), (1)) o(back)),
counted AS (SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS n_events FROM starts GROUP BY window_start)
SELECT * FROM counted WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM http_requests)""")

# Change sets on bucketed tables have the results of those on plain ones.
for _name, _plain in (("stored_cas_updates", "cas_updates"), ("stored_insert_ignore", "insert_ignore"),
                      ("stored_finish_executions", "finish_executions"), ("stored_cascade_delete", "cascade_delete"),
                      ("stored_list_executions", "list_executions"), ("stored_audit", "execution_audit")):
    ORACLES[_name] = ORACLES[_plain]
