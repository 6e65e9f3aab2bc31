"""Session construction and the shared folder for data that must outlive an executor."""

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "workloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        _STATE_STORE: _ROCKSDB,
        _REPEATED_KEYS: "true",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_rocksdb_state(spark: SparkSession) -> None:
    """Makes streams started from now on keep their state in RocksDB."""
    spark.conf.set(_STATE_STORE, _ROCKSDB)


def last_key_wins(spark: SparkSession) -> None:
    """Makes JSON objects that repeat a key keep the last one instead of being refused."""
    spark.conf.set(_REPEATED_KEYS, "true")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="workloom-"), "workloom"), "zip",
                                  root_dir=os.path.dirname(package), base_dir=os.path.basename(package))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master falls back to a scratch folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="workloom-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Use it where two branches must see the very same rows (for example the same range
    boundaries), or where a loop would otherwise grow its lineage. A lost executor costs a
    re-read, not a recomputation.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
