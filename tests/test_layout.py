"""Look-ups and searches that open few files, with the rows of a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from baitline.operators import history
from baitline.sources import layout


def rows_read(df):
    """Rows that the file scans of an executed plan put out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        elif name == "FileSourceScanExec":
            found += plan.metrics().apply("numOutputRows").value()
        for k in range(plan.children().size()):
            todo.append(plan.children().apply(k))
    return found


def test_a_look_up_reads_few_row_groups(spark, tmp_path):
    scans = spark.range(40_000).selectExpr("id * 7919 % 1000003 AS scan_id", "concat('u', id) AS url")
    layout.write_keyed(scans, str(tmp_path / "keyed"), "scan_id", files=16, rows_per_file=2500)
    stored = spark.read.parquet(str(tmp_path / "keyed"))
    assert stored.count() == 40_000
    for key in (7919, 123 * 7919 % 1000003, 5):
        got = history.get_scan(stored, key)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in scans.filter(F.col("scan_id") == key).collect()]
        assert rows_read(stored.filter(F.col("scan_id") == key)) <= 40_000 / 16 * 2


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("search")
    rng = random.Random(2)
    for k in range(8):
        rows = [(k * 100 + i, f"https://Site{k}-{rng.randrange(5)}.example/p%q_{'rare' if (k, i) == (3, 7) else 'x'}") for i in range(100)]
        rows += [(k * 100 + 99, None), (k * 100 + 98, "ab")]
        spark.createDataFrame(rows, "scan_id LONG, url STRING").selectExpr("*", "timestamp_ntz'2024-01-01' AS created_at").coalesce(1).write.mode("append").parquet(f"{path}/scans")
    layout.write_postings(spark, f"{path}/scans", f"{path}/postings")
    return f"{path}/scans", f"{path}/postings"


@pytest.mark.parametrize("text,most", [
    ("site3", 1), ("RARE", 1), ("example/p%q", 8), ("si%rare", 1), ("ab", None), ("a_c", None), ("", None), ("absent", 0), ("site2-_.exam", 1)])
def test_searches_open_files_that_have_all_pieces(spark, searched, text, most):
    scans, postings = searched
    files = layout.search_files(spark, postings, text)
    assert files is None if most is None else len(files) <= most
    rows = lambda df: sorted(tuple(r) for r in history.top_search_scans(df, text).collect())
    assert rows(layout.read_candidates(spark, scans, postings, text)) == rows(spark.read.parquet(scans))
