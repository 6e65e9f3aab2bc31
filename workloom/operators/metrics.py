"""Counters, histograms, rates and quantiles."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from workloom.functions.chain import chained
from workloom.functions.text import route_template
from workloom.functions.timing import epoch_micros, micros_of, pane_start
from workloom.operators.lifecycle import failure_class
from workloom.schemas import HISTOGRAM_BOUNDS, NO_HANDLER_TEXT, RAN


def _rows() -> Column:
    return F.count(F.lit(1))


def tasks_started(replayed: DataFrame, priority: str = "message_priority") -> DataFrame:
    """Runs by task type and message priority; dead letters that never ran do not count."""
    return (replayed.where(F.col("disposition").isin(*RAN))
            .groupBy(F.col("task_type").alias("type"), F.col(priority).alias("priority"))
            .agg(_rows().alias("value")))


def tasks_completed(replayed: DataFrame) -> DataFrame:
    return (replayed.where(F.col("disposition") == "completed")
            .groupBy(F.col("task_type").alias("type")).agg(_rows().alias("value")))


def tasks_failed(replayed: DataFrame) -> DataFrame:
    """Failed runs by task type and reason (permanent or retryable)."""
    return (replayed.where(F.col("disposition").isin("permanent_dlq", "exhausted_dlq", "requeued"))
            .groupBy(F.col("task_type").alias("type"), failure_class().alias("reason"))
            .agg(_rows().alias("value")))


def http_requests_total(requests: DataFrame) -> DataFrame:
    """Requests by route, method and status; the status is text, as in a label."""
    return (requests.groupBy(route_template("path").alias("route"), "method",
                             F.col("status").cast("string").alias("status"))
            .agg(_rows().alias("value")))


def _bound_text(bound: float) -> str:
    return f"{bound:g}"


def histogram(df: DataFrame, value: str, by: list, bounds=HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative buckets (`le`, `bucket_count`) with the series' sum and count.

    All buckets are counted in one aggregation, so one row per series and map task is shuffled. Rows
    without a value are no observations.
    """
    bounds = sorted(bounds)
    df = df.where(F.col(value).isNotNull())
    counts = [F.count_if(F.col(value) <= bound).alias(f"_b{i}") for i, bound in enumerate(bounds)]
    series = df.groupBy(*by).agg(F.struct(*counts, _rows().alias("_all"), F.sum(value).alias("_sum")).alias("_counted"))
    buckets = F.array(*[
        F.struct(F.lit(_bound_text(bound)).alias("le"), F.col("_counted")[f"_b{i}"].alias("bucket_count"))
        for i, bound in enumerate(bounds)
    ], F.struct(F.lit("+Inf").alias("le"), F.col("_counted._all").alias("bucket_count")))
    return series.withColumn("_bucket", F.explode(buckets)).select(
        *[c for c in series.columns if c != "_counted"], "_bucket.le", "_bucket.bucket_count",
        F.col("_counted._sum").alias("total_sum"), F.col("_counted._all").alias("total_count"))


def le_value(le: Column | str = "le") -> Column:
    le = F.col(le) if isinstance(le, str) else le
    return F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.cast("double"))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str], le: str = "le",
                       count: str = "bucket_count") -> DataFrame:
    """The q-quantile of each series from cumulative buckets, linear inside a bucket.

    In the +Inf bucket the last finite bound is returned; an empty series, one with no finite
    bucket or one without a +Inf bucket gives NaN. Buckets are summed per bound first, so any
    number of series may be folded together. Each window holds one series' bounds only.
    """
    summed = buckets.groupBy(*by, le_value(le).alias("_le")).agg(F.sum(count).cast("double").alias("_n"))
    if not 0 <= q <= 1:
        edge = float("-inf") if q < 0 else float("inf")
        return summed.groupBy(*by).agg(F.lit(edge).alias("quantile"))
    series = Window.partitionBy(*by)
    rising = series.orderBy("_le")
    placed = summed.withColumns({
        "_prev_le": F.lag("_le").over(rising),
        "_prev_n": F.coalesce(F.lag("_n").over(rising), F.lit(0.0)),
        "_total": F.max("_n").over(series),
        "_top": F.max("_le").over(series),
    }).withColumn("_rank", F.col("_total") * q)
    hit = (F.col("_n") >= F.col("_rank")) | (F.col("_le") == F.col("_top"))
    inside = F.coalesce("_prev_le", F.lit(0.0)) + (
        F.col("_le") - F.coalesce("_prev_le", F.lit(0.0))
    ) * F.try_divide(F.col("_rank") - F.col("_prev_n"), F.col("_n") - F.col("_prev_n"))
    estimate = (
        F.when((F.col("_total") == 0) | (F.col("_top") != float("inf")), F.lit(float("nan")))
        .when(F.col("_le") == float("inf"), F.coalesce("_prev_le", F.lit(float("nan"))))
        .when(F.col("_prev_le").isNull() & (F.col("_le") <= 0), F.col("_le"))
        .otherwise(F.coalesce(inside, F.lit(float("nan"))))
    )
    return (placed.where(hit).withColumn("_estimate", estimate)
            .groupBy(*by).agg(F.min_by("_estimate", "_le").alias("quantile")))


def event_rate(df: DataFrame, ts: str, window: str, slide: str, by: list[str] = ()) -> DataFrame:
    """Events per second in sliding windows, by window start and the `by` columns.

    Events are first counted in panes as long as the slide; only pane counts are shuffled and
    copied to the windows that hold them. The window must be a multiple of the slide.
    """
    length, step = micros_of(window), micros_of(slide)
    if length % step:
        raise ValueError("the window must be a multiple of the slide")
    panes = (
        df.groupBy(*by, pane_start(epoch_micros(ts), step).alias("_pane"))
        .agg(_rows().alias("_n"))
    )
    offsets = F.sequence(F.lit(0), F.lit(length // step - 1))
    return (
        panes.withColumn("_back", F.explode(offsets))
        .groupBy(*by, (F.col("_pane") - F.col("_back").cast("long") * step).alias("window_start_us"))
        .agg(F.sum("_n").alias("n_events"))
        .withColumn("rate_per_sec", F.col("n_events") / (length / 1_000_000))
    )


def counter_rate(samples: DataFrame, window: str, series: list[str], ts: str = "ts",
                 value: str = "value", tie: list[str] = (), step: str | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Per-second rate of cumulative counters in half-open windows that start every `step`.

    Without `step`, windows follow one another. A drop counts as a restart from zero. The increase
    is extended towards the window's ends: by the whole gap when it is shorter than 1.1 average
    sample distances, else by half a distance, and never below where the counter would have been
    zero. Windows with fewer than two samples or no time between them give no row; samples without a
    value or a time are no samples.

    Each sample's gain over the one before comes from chained ranges (see `chained`), so a series of any
    length is spread over as many tasks as it needs. Gains are added up per step with combining on the map
    side, and a window adds its steps; the gain of a window's first sample, whose predecessor lies outside, is left out.
    """
    length = micros_of(window)
    stride = length if step is None else micros_of(step)
    if length % stride:
        raise ValueError("the window must be a multiple of the step")
    placed = (
        samples.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
        .select(*series, epoch_micros(ts).alias("_us"), *tie, F.col(value).cast("double").alias("_v"))
    )
    order = ["_us", *tie]
    gain = (F.when(F.col("_was").isNull(), 0.0).when(F.col("_v") < F.col("_was"), F.col("_v"))
            .otherwise(F.col("_v") - F.col("_was")))
    opens = F.coalesce(F.col("_was_us") < F.col("_step"), F.lit(True))  # the first sample of its step
    steps = (
        chained(placed, list(series), order, lags={"_was": "_v", "_was_us": "_us"}, partitions=partitions)
        .withColumn("_step", pane_start(F.col("_us"), stride)).withColumn("_gain", gain)
        .groupBy(*series, "_step")
        .agg(F.sum(F.when(~opens, F.col("_gain"))).alias("_inside"), F.sum(F.when(opens, F.col("_gain"))).alias("_joint"),
             F.max(F.when(opens, F.col("_was_us"))).alias("_was_us"), _rows().alias("_n"),
             F.min("_us").alias("_first_us"), F.max("_us").alias("_last_us"),
             F.min_by("_v", F.struct(*order)).alias("_first_v"))
    )
    group = [*series, "window_start_us"]
    joint = F.when(F.col("_was_us") >= F.col("window_start_us"), F.col("_joint")).otherwise(0.0)
    whole = (
        steps.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(length // stride - 1))))
        .withColumn("window_start_us", F.col("_step") - F.col("_back").cast("long") * stride)
        .groupBy(*group)
        .agg(F.sum(F.coalesce("_inside", F.lit(0.0)) + joint).alias("_inc"), F.sum("_n").alias("_n"),
             F.min("_first_us").alias("_t0"), F.max("_last_us").alias("_t1"),
             F.min_by("_first_v", "_step").alias("_v0"))
        .where((F.col("_n") >= 2) & (F.col("_t1") > F.col("_t0")))
    )
    covered = (F.col("_t1") - F.col("_t0")) / 1e6
    distance = covered / (F.col("_n") - 1)
    to_start = (F.col("_t0") - F.col("window_start_us")) / 1e6
    to_end = (F.col("window_start_us") + length - F.col("_t1")) / 1e6
    start_gap = F.when(to_start >= distance * 1.1, distance / 2).otherwise(to_start)
    zero_gap = F.when((F.col("_inc") > 0) & (F.col("_v0") >= 0), covered * F.col("_v0") / F.col("_inc"))
    start_gap = F.least(start_gap, F.coalesce(zero_gap, start_gap))
    end_gap = F.when(to_end >= distance * 1.1, distance / 2).otherwise(to_end)
    rate = F.col("_inc") * (covered + start_gap + end_gap) / covered / (length / 1e6)
    return whole.select(*group, F.col("_n").alias("n_samples"), F.col("_inc").alias("increase"),
                        rate.alias("rate_per_sec"))


def sum_rates(rates: DataFrame, by: list[str]) -> DataFrame:
    return rates.groupBy(*by).agg(F.sum("rate_per_sec").alias("rate_per_sec"))


def rate_quantile(bucket_samples: DataFrame, q: float, window: str, series: list[str], by: list[str], step: str | None = None,
                  ts: str = "ts", value: str = "value", le: str = "le", tie: list[str] = (), partitions: int | None = None) -> DataFrame:
    """The q-quantile of each window from samples of cumulative bucket counters.

    Each bucket counter's rate is taken first, rates are summed per bound and `by` columns, and the
    quantile is read off these. `series` names the labels of a counter besides `le`.
    """
    rates = counter_rate(bucket_samples, window, [*series, le], ts, value, tie, step, partitions)
    return histogram_quantile(rates, q, [*by, "window_start_us"], le, "rate_per_sec")


def stream_stats(messages: DataFrame, stream: str) -> DataFrame:
    """Messages and bytes per subject, and per stream with its number of subjects."""
    per_subject = messages.groupBy("subject").agg(
        _rows().alias("n_messages"),
        F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n_bytes"))
    total = per_subject.agg(
        F.coalesce(F.sum("n_messages"), F.lit(0)).alias("n_messages"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), _rows().alias("n_subjects"))
    columns = [F.lit(stream).alias("stream"), "subject", "n_messages", "n_bytes", "n_subjects"]
    return (per_subject.withColumn("n_subjects", F.lit(1).cast("bigint")).select(*columns)
            .unionAll(total.withColumn("subject", F.lit("*")).select(*columns)))


def audit(tasks: DataFrame, executions: DataFrame, type_once: str = "demo",
          registered=("demo", "fail")) -> DataFrame:
    """Executions per task and a finding: repeated_execution, missing_execution, wrong_error or ok.

    Completed tasks of `type_once` should have one execution; failed tasks of a type without a
    handler should carry the text that says so. `attempts` tells lawful retries from repeats.
    Executions are counted per task before the join.
    """
    per_task = executions.groupBy(F.col("task_id").alias("id")).agg(
        _rows().alias("n_executions"), F.count_distinct("attempt").alias("n_attempts"),
        F.bool_or(F.coalesce(F.contains(F.col("error"), F.lit(NO_HANDLER_TEXT.strip())), F.lit(False)))
        .alias("_explained"))
    counted = tasks.select("id", "type", "status").join(per_task, "id", "left").withColumns({
        "n_executions": F.coalesce("n_executions", F.lit(0)),
        "n_attempts": F.coalesce("n_attempts", F.lit(0)),
    })
    done_once = (F.col("type") == type_once) & (F.col("status") == "completed")
    unhandled = ~F.col("type").isin(*registered) & (F.col("status") == "failed")
    finding = (
        F.when(done_once & (F.col("n_executions") > 1), "repeated_execution")
        .when(done_once & (F.col("n_executions") == 0), "missing_execution")
        .when(unhandled & ~F.coalesce("_explained", F.lit(False)), "wrong_error")
        .otherwise("ok")
    )
    return counted.select("id", "type", "status", "n_executions", "n_attempts", finding.alias("finding"))
