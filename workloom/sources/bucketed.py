"""Tables kept in buckets of a key, each change an atomic new version.

A table is a folder:

    manifest/00000007.json        the layout, and the folders that make up each bucket in version 7
    data/<generation>/bucket=12/  the rows of one bucket that one change wrote

The version is the manifest with the highest number that can be read. A change writes a generation that holds only the
buckets it touches, then the next manifest, whose file must not exist yet: of two changes made at once, one fails. A change
that is killed leaves files that no manifest names, and the old version stays. Buckets are those of Spark's
bucketed tables, so Spark reads one bucket for one key, and joins and groups by the key without an exchange. Joins by
the key and further columns do so too where `spark.sql.requireAllClusterKeysForCoPartition` is off.
"""

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKET, GENERATION = "_bucket", "_generation"


class ConcurrentChange(RuntimeError):
    """Another change made the next version first."""


def bucket_of(key: Column | str, buckets: int) -> Column:
    """The bucket that Spark puts a key into."""
    return F.pmod(F.hash(key), F.lit(buckets))


class _Folder:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self._fs.exists(self._path):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._path))

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def create(self, name: str, text: str) -> None:
        """Writes a new file; one of that name must not exist."""
        try:
            out = self._fs.create(self._file(name), False)
        except Exception as error:
            if self._fs.exists(self._file(name)):
                raise ConcurrentChange(name) from error
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._file(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def size(self) -> int:
        return self._fs.getContentSummary(self._path).getLength()


@dataclass(frozen=True)
class BucketedTable:
    """One version of a table. `parts` names the generations of every bucket that holds rows."""

    spark: SparkSession
    path: str
    version: int
    key: str
    buckets: int
    sort: tuple[str, ...]
    schema: T.StructType
    parts: dict[int, tuple[str, ...]]

    # Reading

    def df(self) -> DataFrame:
        """All rows, as a bucketed table that Spark knows."""
        return self._scan().select(self.schema.names)

    def part(self, buckets: Iterable[int]) -> DataFrame:
        """The rows of some buckets; no other bucket's files are listed or read."""
        return self._scan().where(F.col(BUCKET).isin(sorted(buckets))).select(self.schema.names)

    def rows_of(self, key) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        return self._scan().where((F.col(BUCKET) == bucket_of(F.lit(key), self.buckets)) & (F.col(self.key) == F.lit(key))).select(self.schema.names)

    def _scan(self) -> DataFrame:
        name = f"bucketed_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}_{self.version}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            sort = f"SORTED BY ({', '.join(self.sort)}) " if self.sort else ""
            self.spark.sql(f"CREATE TABLE {name} ({columns}, {BUCKET} INT, {GENERATION} STRING) USING parquet "
                           f"PARTITIONED BY ({BUCKET}, {GENERATION}) CLUSTERED BY (`{self.key}`) {sort}INTO {self.buckets} BUCKETS "
                           f"LOCATION '{self.path}/data'")
            places = [f"PARTITION ({BUCKET}={b}, {GENERATION}='{g}') LOCATION '{self.path}/data/{g}/{BUCKET}={b}'"
                      for b, generations in sorted(self.parts.items()) for g in generations]
            for i in range(0, len(places), 500):
                self.spark.sql(f"ALTER TABLE {name} ADD {' '.join(places[i:i + 500])}")
        return self.spark.table(name)

    # Changing

    def touched(self, keys: DataFrame, column: str | None = None) -> list[int]:
        """The buckets that a column's values fall into: at most as many numbers as there are buckets."""
        kind = self.schema[self.key].dataType
        values = keys.select(F.col(column or self.key).cast(kind).alias("k")).where("k IS NOT NULL")
        return sorted(r.b for r in values.select(bucket_of("k", self.buckets).alias("b")).distinct().collect())

    def replace(self, rows: DataFrame, buckets: Iterable[int]) -> "BucketedTable":
        """A version in which `buckets` hold `rows`, which must fall into them, and the others what they held."""
        buckets = set(buckets)
        if not buckets:
            return self
        generation, written = self._write(rows)
        if not written <= buckets:
            raise ValueError(f"rows fall into other buckets: {sorted(written - buckets)}")
        parts = {b: g for b, g in self.parts.items() if b not in buckets} | {b: (generation,) for b in written}
        return self._commit(parts)

    def append(self, rows: DataFrame) -> "BucketedTable":
        """A version with `rows` added; nothing that is there is written again."""
        generation, written = self._write(rows)
        if not written:
            return self
        return self._commit(self.parts | {b: (*self.parts.get(b, ()), generation) for b in written})

    def compact(self, most: int = 8) -> "BucketedTable":
        """A version in which buckets of more than `most` generations are one generation each."""
        many = [b for b, generations in self.parts.items() if len(generations) > most]
        return self.replace(self.part(many), many) if many else self

    def generation_bytes(self) -> dict[str, int]:
        return {g: _Folder(self.spark, f"{self.path}/data/{g}").size() for g in _Folder(self.spark, f"{self.path}/data").names()}

    def _write(self, rows: DataFrame) -> tuple[str, set[int]]:
        generation = uuid.uuid4().hex
        where, name = f"{self.path}/data/{generation}", f"generation_{generation}"
        placed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn(
            BUCKET, bucket_of(self.key, self.buckets))
        # Ranges, not one task per bucket: a bucket with a hot key is written by as many tasks as it needs.
        layout = dict.fromkeys([BUCKET, self.key, *self.sort])
        writer = placed.repartitionByRange(*layout).write.format("parquet").partitionBy(BUCKET).bucketBy(self.buckets, self.key)
        if self.sort:
            writer = writer.sortBy(*self.sort)
        writer.option("path", where).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay
        folders = [x for x in _Folder(self.spark, where).names() if x.startswith(f"{BUCKET}=")]
        return generation, {int(x.partition("=")[2]) for x in folders}

    def _commit(self, parts: dict[int, tuple[str, ...]]) -> "BucketedTable":
        version = self.version + 1
        manifest = {"key": self.key, "buckets": self.buckets, "sort": self.sort, "schema": self.schema.jsonValue(),
                    "parts": {str(b): list(g) for b, g in sorted(parts.items())}}
        _Folder(self.spark, f"{self.path}/manifest").create(f"{version:08d}.json", json.dumps(manifest))
        return BucketedTable(self.spark, self.path, version, self.key, self.buckets, self.sort, self.schema, parts)


def create_table(df: DataFrame, path: str, key: str, buckets: int, sort: Iterable[str] = ()) -> BucketedTable:
    """Writes `df` as version 1 of a table in a new folder. Rows without a key are kept, in a bucket of Spark's choice."""
    spark = df.sparkSession
    if _Folder(spark, f"{path}/manifest").names():
        raise ValueError(f"there is a table in {path}")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    empty = BucketedTable(spark, path, 0, key, buckets, tuple(sort), schema, {})
    generation, written = empty._write(df)
    return empty._commit({b: (generation,) for b in written})


def open_table(spark: SparkSession, path: str, version: int | None = None) -> BucketedTable:
    """The newest version, or a given one. A manifest whose writing was cut short is passed over."""
    folder = _Folder(spark, f"{path}/manifest")
    numbers = sorted((int(n[:-5]) for n in folder.names() if n.endswith(".json")), reverse=True)
    for number in [n for n in numbers if version in (None, n)]:
        try:
            found = json.loads(folder.read(f"{number:08d}.json"))
        except (json.JSONDecodeError, PySparkException):
            continue
        return BucketedTable(spark, path, number, found["key"], found["buckets"], tuple(found["sort"]), T.StructType.fromJson(found["schema"]),
                             {int(b): tuple(g) for b, g in found["parts"].items()})
    raise FileNotFoundError(f"no version of a table in {path}")
