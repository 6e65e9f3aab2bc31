"""From raw request bodies and messages to typed rows, with every reject explained."""

from pyspark.sql import Column, DataFrame, functions as F

from workloom.functions.ids import valid_uuid
from workloom.functions.once import computed_once
from workloom.functions.payload import entries, fields, is_text_or_null, last_text, with_long_numbers
from workloom.functions.text import subject_of
from workloom.schemas import (
    BAD_MESSAGE, BAD_TASK_ID, DEAD_LETTER_SUBJECT, DEFAULT_PRIORITY, INVALID_JSON, PAYLOAD_REQUIRED,
    PRIORITIES, PRIORITY_RANGE, TYPE_REQUIRED, VALIDATION_ERROR,
)
from workloom.session import last_key_wins

#: The members of a JSON null, which sets no field.
_NO_MEMBERS = "cast(array() AS array<struct<key:string,value:variant>>)"
_MALFORMED = "malformed body"


def ingest_requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """Create-task requests with `type`, `payload`, `priority`, or `error` and `details`.

    The first failing rule names the error. Text after the first JSON value is ignored. Field names match in
    any case; of repeated fields the last counts, but a null leaves `type` and `priority` as they were, and one
    of a wrong kind makes the body malformed. Sets `last_key_wins`.
    """
    last_key_wins(raw.sparkSession)
    members = F.when(F.regexp_like(body, F.lit(r"^[ \t\r\n]*null")), F.expr(_NO_MEMBERS)).otherwise(entries(F.col(body)))
    text = raw.withColumn("_members", members).withColumns({
        "_types": fields(F.col("_members"), "type"),
        "_payload": F.try_element_at(fields(F.col("_members"), "payload"), F.lit(-1)),
        "_priorities": fields(F.col("_members"), "priority"),
    }).withColumns({"_type_text": last_text(F.col("_types")), "_priority_text": last_text(F.col("_priorities"))})
    well_formed = F.col("_members").isNotNull() & is_text_or_null(F.col("_types")) & is_text_or_null(F.col("_priorities"))
    details = (
        F.when(~F.coalesce(well_formed, F.lit(False)), F.lit(_MALFORMED))
        .when(F.col("_type_text") == "", F.lit(TYPE_REQUIRED))
        .when(F.col("_payload").isNull(), F.lit(PAYLOAD_REQUIRED))
        .when(~F.col("_priority_text").isin("", *PRIORITIES), F.lit(PRIORITY_RANGE))
    )
    checked = text.withColumn("details", details).withColumn(
        "error",
        F.when(F.col("details") == _MALFORMED, F.lit(INVALID_JSON))
        .when(F.col("details").isNotNull(), F.lit(VALIDATION_ERROR)),
    )
    accepted = F.col("error").isNull()
    read = computed_once(
        checked,
        type=F.when(accepted, F.col("_type_text")),
        payload=F.when(accepted, F.to_json("_payload")),
        priority=F.when(accepted, F.coalesce(F.nullif("_priority_text", F.lit("")),
                                             F.lit(DEFAULT_PRIORITY))),
        error=F.col("error"), details=F.col("details"),
    )
    asked = F.when(F.col("error").isNull(), F.col(body))
    return read.select(*raw.columns, "type", with_long_numbers(F.col("payload"), asked, "payload").alias("payload"),
                       "priority", "error", "details")


def new_tasks(accepted: DataFrame, id_column: Column | None = None,
              clock: Column | None = None) -> DataFrame:
    """Task rows for accepted requests: queued, version 1, both times now.

    Pass `id_column` and `clock` for results that a re-run must reproduce; a generated id is
    drawn anew whenever a lost task runs again.
    """
    now = F.current_timestamp() if clock is None else clock
    return accepted.select(
        (F.uuid() if id_column is None else id_column).alias("id"),
        "type", "payload", "priority",
        F.lit("queued").alias("status"),
        now.alias("created_at"), now.alias("updated_at"),
        F.lit(1).alias("version"),
    )


def route(df: DataFrame, priority: str = "priority") -> DataFrame:
    """Adds `subject`; null where the priority is outside the value set."""
    return df.withColumn("subject", subject_of(priority))


def decode_messages(messages: DataFrame, exclude_dlq: bool = False) -> DataFrame:
    """Adds `task_id`, `priority` and `reject` (null, bad_message or bad_task_id).

    Unlike a request body, a message may hold nothing after its JSON value. The value is parsed as the first member
    of an object whose second and last one is named by the message's own digest. Fields are read as in `ingest_requests`.
    """
    last_key_wins(messages.sparkSession)
    if exclude_dlq:
        messages = messages.where(F.col("subject") != DEAD_LETTER_SUBJECT)
    framed = F.concat(F.lit('{"":'), F.col("data"), F.lit(',"'), F.md5(F.col("data").cast("binary")), F.lit('":{}}'))
    is_null = F.regexp_like("data", F.lit(r"^[ \t\r\n]*null[ \t\r\n]*\z"))
    parsed = messages.withColumn("_frame", entries(framed, "map<string,map<string,variant>>")).withColumn(
        "_members", F.when(is_null, F.expr(_NO_MEMBERS)).otherwise(F.map_entries(F.col("_frame")[0]["value"]))
    ).withColumns({"_ids": fields(F.col("_members"), "task_id"), "_priorities": fields(F.col("_members"), "priority")})
    shaped = (
        (F.size("_frame") == 2) & (F.col("_frame")[1]["key"] == F.md5(F.col("data").cast("binary")))
        & F.col("_members").isNotNull() & is_text_or_null(F.col("_ids")) & is_text_or_null(F.col("_priorities"))
    )
    decoded = parsed.withColumns({
        "_shaped": F.coalesce(shaped, F.lit(False)),
        "_id": valid_uuid(last_text(F.col("_ids"))),
    })
    return computed_once(
        decoded,
        task_id=F.when(F.col("_shaped"), F.col("_id")),
        priority=F.when(F.col("_shaped") & F.col("_id").isNotNull(),
                        last_text(F.col("_priorities"))),
        reject=F.when(~F.col("_shaped"), F.lit(BAD_MESSAGE))
        .when(F.col("_id").isNull(), F.lit(BAD_TASK_ID)),
    ).select(*messages.columns, "task_id", "priority", "reject")

