"""Nearest neighbours: what the driver and the exchanges carry."""

import os
import subprocess
import sys
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from workloom.llm import ann

SCHEMA = "id bigint, v array<double>"
SMALL_RESULTS = """
from pyspark.sql import functions as F
from workloom.llm import ann
from workloom.session import build_session

spark = build_session("small-results", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions=4,
                      spark__driver__maxResultSize="4m")
v = [F.sin(F.col("vec_id") * F.lit(0.37 * (i + 1))).cast("float") for i in range(16)]
vectors = spark.range(0, 300_000, 1, 60).withColumnRenamed("id", "vec_id").withColumn("embedding", F.array(v))
assert ann.nearest(vectors, vectors.where("vec_id in (5, 70)")).count() == 20
print("whole")
"""


def test_the_sample_does_not_pass_the_driver():
    """Each of 60 tasks holds more rows than the sample; all their rows together are not the driver's to merge."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", SMALL_RESULTS], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=240)
    assert "whole" in done.stdout, done.stderr[-2000:]


def test_centre_of_the_sample(spark):
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(900)] + [(i, [1.0, None]) for i in range(900, 930)] + [(i, [1.0]) for i in range(930, 960)] + [
        (i, []) for i in range(960, 1000)] + [(5, [50.0, -50.0])] * 40  # a row that repeats
    for n in (1, 10, 300, 2000):
        some = spark.createDataFrame(rows, SCHEMA).repartition(5).orderBy(F.xxhash64("id"), "id").limit(n).collect()
        every, d, centre = ann.centre_of(spark.createDataFrame(rows, SCHEMA).repartition(5), n)
        usable = [r.v for r in some if len(r.v) == 2 and None not in r.v and any(r.v)]
        assert every == len(rows) and (d == 2 or not usable)
        if 5 not in {r.id for r in some[-1:]}:  # else it's open which of the repeated rows are in
            assert np.allclose(centre, np.mean(usable, 0) if usable else np.zeros(d), atol=1e-12)
    assert ann.centre_of(spark.createDataFrame([], SCHEMA), 10) is None
    assert ann.centre_of(spark.createDataFrame([(1, []), (2, [])], SCHEMA), 10) is None
    every, d, centre = ann.centre_of(spark.range(9).selectExpr("id", "array(double(id), 1D)").toDF("id", "v"), 100)
    assert (every, d) == (9, 2) and np.allclose(centre, [4, 1])


def test_no_block_is_copied_to_meet_another(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = spark.range(0, 600, 1, 3).selectExpr("id vec_id", "array(float(id % 13 + 1), float(id % 17), float(id % 5)) embedding")
        plan = ann.nearest(v, v.where("vec_id % 20 = 0"), block=50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" in plan and "Generate" not in plan and "SortMergeJoin" not in plan


def test_result_lists_stay_below_the_vectors():
    for n, asked in ((23_400_000, 234_000), (234_000_000, 2_340_000), (10 ** 8, 10 ** 8), (10 ** 9, 1), (10 ** 6, 10 ** 4)):
        parts, groups = ann.grid(n, asked, 64, 10, 8_192, 512)
        assert 1 <= parts <= -(-n // 8_192) and (groups - 1) * 8_192 < asked <= groups * 8_192
        assert parts == 1 or parts * asked * 10 * 24 <= max(n * 64 * 4, ann.LISTS)
    assert ann.grid(5, 0, 64, 10, 8_192, 512) == (1, 1)


def test_parts_do_not_change_the_neighbours(spark, monkeypatch):
    g = np.random.default_rng(9)
    x = g.standard_normal((700, 16)).astype(np.float32)
    x[300:360] = x[300]
    rows = [(i % 690, [float(a) for a in v]) for i, v in enumerate(x)]  # ten ids twice
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3, "vec_id")
    asked = vectors.where("vec_id % 9 = 0").withColumn("embedding", F.col("embedding").cast("array<double>"))

    def found(parts, groups, broadcast):
        monkeypatch.setattr(ann, "grid", lambda *a: (parts, groups))
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            return sorted(map(tuple, ann.nearest(vectors, asked, block=32, query_block=5).collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

    whole = found(1, 1, "-1")
    assert whole == found(7, 4, "-1") == found(40, 1, "10m")
    hits = 0
    keys, all_x = np.array([r[0] for r in rows]), x.astype(float)
    singles = [i for i in range(0, 690, 9) if i >= 10]
    for i in singles:
        d = np.sqrt(((all_x - all_x[i]) ** 2).sum(1))
        d[keys == i] = np.inf
        want = keys[np.lexsort((keys, d))[:10]].tolist()
        own = [r for r in whole if r[0] == i]
        assert [r[1] for r in own] == list(range(1, 11)) and [r[3] for r in own] == sorted(r[3] for r in own)
        hits += sum((Counter(r[2] for r in own) & Counter(want)).values())
    assert hits >= .95 * 10 * len(singles)
