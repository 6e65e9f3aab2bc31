"""Dead-letter messages: writing and reading."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from workloom.functions.once import computed_once
from workloom.functions.text import with_header
from workloom.functions.timing import rfc3339
from workloom.operators.lifecycle import error_text
from workloom.schemas import DEAD_LETTER, DEAD_LETTER_SUBJECT, DEAD_LETTERED, MAX_ATTEMPTS, MESSAGES

# Fixed patterns: a time with an offset, and padded base64.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"

_LINE_ENDS = "\r\n"


def _unbroken(text) -> Column:
    """Base64 without the line ends that Spark's encoder puts in and decoders pass over."""
    return F.translate(text, _LINE_ENDS, "")


def to_dlq(affected: DataFrame, max_attempts: int = MAX_ATTEMPTS, clock: str = "delivered_at",
           data: str = "data", headers: str | None = None) -> DataFrame:
    """A dead-letter message for each row of `effects` that ended in one.

    Needs the delivery's subject and data; the data travels in base64. Trace headers, when
    given, are kept and the task id is added to them.
    """
    carried = F.col(headers) if headers else F.create_map().cast("map<string,string>")
    record = F.struct(
        "task_id", "task_type", "attempt", error_text(max_attempts).alias("error"),
        F.col("subject").alias("original_subject"),
        _unbroken(F.base64(F.col(data).cast("binary"))).alias("original_data"),
        rfc3339(clock).alias("failed_at"))
    return affected.where(F.col("disposition").isin(*DEAD_LETTERED)).select(
        F.lit(DEAD_LETTER_SUBJECT).alias("subject"),
        F.to_json(record).alias("data"),
        with_header(carried, "task_id", F.col("task_id")).alias("headers"),
        F.col(clock).alias("published_at"))


def write_dlq(letters: DataFrame, path: str, mode: str = "append") -> None:
    """Appends dead letters in the message layout that `read_messages` reads."""
    columns = [F.col(f.name).cast(f.dataType) if f.name in letters.columns
               else F.lit(None).cast(f.dataType).alias(f.name) for f in MESSAGES]
    letters.select(*columns).write.mode(mode).parquet(path)


def parse_dlq(messages: DataFrame) -> DataFrame:
    """Adds the letter's fields and `bad`: text that is no such record. Works on streams too."""
    parsed = computed_once(messages, _letter=F.from_json(
        "data", T.StructType([*DEAD_LETTER, T.StructField("_corrupt", T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    letter = {name: F.col(f"_letter.{name}") for name in DEAD_LETTER.names}
    bad = (
        F.col("_letter").isNull() | F.col("_letter._corrupt").isNotNull()
        | ~F.coalesce(letter["failed_at"].rlike(RFC3339), F.lit(True))
        | ~F.coalesce(_unbroken(letter["original_data"]).rlike(BASE64), F.lit(True))
    )
    fields = [F.when(~F.col("bad"), value).alias(name) for name, value in letter.items()]
    return (parsed.withColumn("bad", bad)
            .select(*messages.columns, "bad", *fields)
            .withColumn("original_data", F.unbase64(_unbroken("original_data")))
            .withColumn("failed_at", F.try_to_timestamp("failed_at")))


def read_dlq(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(letters, messages that are no letters); a bad message never fails the job."""
    parsed = parse_dlq(messages)
    return (parsed.where(~F.col("bad")).drop("bad"),
            parsed.where(F.col("bad")).select(*messages.columns))
