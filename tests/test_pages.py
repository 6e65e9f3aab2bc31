import datetime as dt

import pytest
from pyspark.sql import functions as F

from workloom.operators import lookup, pages
from workloom.schemas import TASKS

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tasks(spark):
    rows = [(f"t{i * 7919 % 1000:04}", "demo" if i % 3 else "rare" if i % 40 == 0 else None, "{}", "low", ("queued", "failed", None)[i % 7 % 3],
             None if i % 50 == 0 else T0 if i % 3 == 0 else T0 + dt.timedelta(minutes=i % 200), T0, 1) for i in range(1000)]
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TASKS)).withColumn("extra", F.lit("a column that no page holds"))


@pytest.fixture(scope="module")
def listing(tasks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("listing") / "l")
    pages.build_listing(tasks, path, rows_per_range=60)
    return pages.open_listing(tasks.sparkSession, path)


@pytest.mark.parametrize("chosen", [{}, {"status": "queued"}, {"type": "rare"}, {"status": "failed", "type": "demo"}, {"type": "none"}])
def test_pages_are_those_of_the_list(tasks, listing, chosen):
    # A third of all tasks share one creation time, some have none.
    in_order = sorted(lookup.filter_tasks(tasks, **chosen).select(*lookup.TASK_COLUMNS).collect(),
                      key=lambda r: (r.created_at is None, -(r.created_at or T0).timestamp(), r.id))
    assert sum(n for _, n in listing.counts(**chosen)) == len(in_order)
    for offset, limit in ((0, 5), (59, 2), (333, 200), (len(in_order) - 1, 10), (5000, 3)):
        if offset >= 0:
            assert listing.page(**chosen, offset=offset, limit=limit).collect() == in_order[offset:offset + limit]


def test_a_page_reads_the_ranges_that_hold_it(listing):
    assert len(listing.counts()) > 12  # ranges are cut by a sample
    deep = listing.page(offset=800, limit=10)
    assert len({f.split("/")[-2] for f in deep.inputFiles()}) <= 2
    assert len(listing.page(offset=200, limit=200).inputFiles()) >= 2


def test_arguments_and_empty_tables(spark, tasks, listing, tmp_path):
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"status": "lost"}):
        with pytest.raises(ValueError):
            listing.page(**bad)
    assert listing.page(strict=False, limit=0).count() == 50
    empty = pages.build_listing(tasks.limit(0), str(tmp_path / "e"))
    assert empty.page().count() == 0 and empty.page().columns == list(lookup.TASK_COLUMNS) and empty.counts() == []
    assert pages.open_listing(spark, str(tmp_path / "e")).page(offset=3).count() == 0
    with pytest.raises(Exception):
        pages.build_listing(tasks, listing.path)
