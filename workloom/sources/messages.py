"""Message streams: reading by subject, publishing, repeating and ageing out."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from workloom.functions.text import subject_matches, subject_of, with_header
from workloom.functions.timing import micros_of, shifted
from workloom.schemas import MESSAGES, RETENTION_DAYS, SUBJECT_PATTERN


def read_messages(spark: SparkSession, path: str, pattern: str = SUBJECT_PATTERN,
                  streaming: bool = False, fmt: str = "parquet", **options) -> DataFrame:
    """Messages whose subject fits a pattern, from files, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return filter_subjects(
        reader.schema(MESSAGES).format(fmt).options(**options).load(path), pattern)


def read_kafka(spark: SparkSession, servers: str, pattern: str = SUBJECT_PATTERN,
               streaming: bool = True, **options) -> DataFrame:
    """The same columns from Kafka, topics standing for subjects. Needs the Kafka connector."""
    reader = spark.readStream if streaming else spark.read
    topics = "^" + r"\.".join("[^.]+" if t == "*" else t for t in pattern.split(".")) + "$"
    raw = (reader.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribePattern", topics).option("includeHeaders", "true")
           .options(**options).load())
    headers = F.map_from_entries(F.transform("headers", lambda h: F.struct(
        h["key"].alias("key"), h["value"].cast("string").alias("value"))))
    return raw.select(F.col("topic").alias("subject"), F.col("value").cast("string").alias("data"),
                      headers.alias("headers"), F.col("offset").alias("seq"),
                      F.col("timestamp").alias("published_at"))


def filter_subjects(messages: DataFrame, pattern: str = SUBJECT_PATTERN) -> DataFrame:
    return messages.where(subject_matches("subject", pattern))


def task_messages(tasks: DataFrame, request_id: str | None = None,
                  traceparent: str | None = None) -> DataFrame:
    """One message per task, on the subject of its priority.

    `request_id` and `traceparent` name columns that travel as headers where they are not empty.
    """
    headers = F.create_map().cast("map<string,string>")
    for key, column in (("X-Request-Id", request_id), ("traceparent", traceparent)):
        if column:
            headers = F.when(F.coalesce(F.col(column), F.lit("")) != "",
                             with_header(headers, key, F.col(column))).otherwise(headers)
    return tasks.select(
        subject_of("priority").alias("subject"),
        F.to_json(F.struct(F.col("id").alias("task_id"), "priority")).alias("data"),
        headers.alias("headers"),
    )


def publish(tasks: DataFrame, path: str, mode: str = "append", **headers: str) -> None:
    """Writes the messages of `tasks`, one folder per subject; `headers` as for `task_messages`."""
    task_messages(tasks, **headers).write.mode(mode).partitionBy("subject").parquet(path)


def publish_kafka(tasks: DataFrame, servers: str, **headers: str) -> None:
    """Sends the messages of `tasks` to Kafka, the subject as topic. Needs the Kafka connector."""
    (task_messages(tasks, **headers)
     .select(F.col("subject").alias("topic"), F.col("data").alias("value"),
             F.transform(F.map_entries("headers"), lambda e: F.struct(
                 e["key"].alias("key"), e["value"].cast("binary").alias("value"))).alias("headers"))
     .write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("includeHeaders", "true").save())


def replicate(messages: DataFrame, n: int, interval: str, ts: str = "published_at") -> DataFrame:
    """Each message n times, `interval` apart, numbered by `copy` from 0."""
    if n <= 0:
        raise ValueError("n must be > 0")
    step = micros_of(interval)
    return (messages.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn(ts, shifted(ts, F.col("copy").cast("long") * step)))


def retain(df: DataFrame, ts: str, as_of: Column, keep: str = f"{RETENTION_DAYS} days") -> DataFrame:
    """Rows not older than `keep` at the time `as_of`; a literal time reaches the file scan."""
    return df.where(F.col(ts) >= shifted(as_of, -micros_of(keep)))
