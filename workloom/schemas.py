"""Table schemas and the value sets every operator shares."""

from pyspark.sql import types as T

# Statuses, priorities, subjects, limits and buckets that results must agree on.
TASK_STATUSES = ("queued", "processing", "completed", "failed", "cancelled")
TERMINAL_STATUSES = ("completed", "failed", "cancelled")
PRIORITIES = ("low", "normal", "high")
DEFAULT_PRIORITY = "normal"
EXECUTION_STATUSES = ("started", "succeeded", "failed")
SUBJECTS = {"low": "tasks.low", "normal": "tasks.normal", "high": "tasks.high"}
DEAD_LETTER_SUBJECT = "tasks.dlq"
SUBJECT_PATTERN = "tasks.*"
LOG_LEVELS = ("debug", "info", "warn", "error", "dpanic", "panic", "fatal")
MAX_ATTEMPTS = 5
BACKOFF_BASE_MS = 500
BACKOFF_CAP_MS = 10_000
LIST_LIMIT_DEFAULT = 50
LIST_LIMIT_MAX = 200
RETENTION_DAYS = 7
TRACE_SAMPLE_RATIO = 0.1
HISTOGRAM_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
BUILTIN_TASK_TYPES = ("demo", "fail")

# Names and texts of errors.
INVALID_JSON = "invalid_json"
VALIDATION_ERROR = "validation_error"
TYPE_REQUIRED = "type is required"
PAYLOAD_REQUIRED = "payload is required"
PRIORITY_RANGE = "priority must be low|normal|high"
INVALID_STATUS = "invalid status"
INVALID_TASK_ID = "invalid task id"
LIMIT_RANGE = "limit must be 1..200"
OFFSET_RANGE = "offset must be >= 0"
BAD_MESSAGE = "bad_message"
BAD_TASK_ID = "bad_task_id"
NO_HANDLER_TEXT = "no handler registered for type "
MAX_ATTEMPTS_TEXT = "max attempts exceeded "
DEMO_FAILURE_TEXT = "requested failure for demo"

# Dispositions a delivery can end in, grouped by what they do.
RAN = ("completed", "permanent_dlq", "exhausted_dlq", "requeued")
DEAD_LETTERED = ("max_attempts_dlq", "no_handler_dlq", "permanent_dlq", "exhausted_dlq")
NO_EFFECT = ("not_found", "terminal_noop", "in_flight_noop")
EFFECTIVE = RAN + ("max_attempts_dlq", "no_handler_dlq", "dup_execution_stuck")

TASKS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("payload", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("version", T.IntegerType(), False),
])

EXECUTIONS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("task_id", T.StringType(), False),
    T.StructField("attempt", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("error", T.StringType(), True),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("finished_at", T.TimestampType(), True),
])

MESSAGES = T.StructType([
    T.StructField("subject", T.StringType(), False),
    T.StructField("data", T.StringType(), True),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("seq", T.LongType(), True),
    T.StructField("published_at", T.TimestampType(), True),
])

DEAD_LETTER = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("original_subject", T.StringType()),
    T.StructField("original_data", T.StringType()),
    T.StructField("failed_at", T.StringType()),
])

APP_LOG_FIELDS = ("level", "timestamp", "msg", "request_id", "trace_id", "span_id", "task_id")

ACCESS_LOG = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("remote_addr", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("request_time", T.DoubleType()),
    T.StructField("upstream_addr", T.StringType()),
    T.StructField("upstream_response_time", T.StringType()),
    T.StructField("user_agent", T.StringType()),
])
