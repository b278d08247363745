"""The cost feed over several micro-batches with late and replayed runs."""

from datetime import datetime, timedelta
from decimal import Decimal

from mullion.streaming import feeds

START = datetime(2024, 1, 1, 8)
SCHEMA = "run_id bigint, project_id bigint, app_version string, created_at timestamp, cost_usd decimal(18,4)"


def run(i, minutes, project=1):
    return (i, project, "v1", START + timedelta(minutes=minutes), Decimal("0.1"))


def feed(spark, source, tmp_path):
    runs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    feeds.cost_feed(runs, str(tmp_path / "out"), str(tmp_path / "ck"))
    return {(r.project_id, r.window_start): r for r in feeds.cost_windows(spark, str(tmp_path / "out")).collect()}


def test_open_and_closed_windows_hold_every_run_once(spark, tmp_path):
    source = str(tmp_path / "runs")
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    add([run(1, 5), run(2, 30), run(3, 30, 2), run(4, 70)])
    first = feed(spark, source, tmp_path)
    assert [(k[1].hour, r.runs, r.closed) for k, r in sorted(first.items())] == [(8, 2, False), (9, 1, False), (8, 1, False)]
    add([run(2, 30), run(5, 250)])  # a replay, and a run that closes the first two hours
    add([run(6, 40), run(4, 70), run(7, 250)])  # late for a closed window, a replay, an open one
    got = feed(spark, source, tmp_path)
    assert [(k[0], k[1].hour, r.runs, r.closed, r.usd) for k, r in sorted(got.items())] == [
        (1, 8, 3, True, Decimal("0.3")), (1, 9, 1, True, Decimal("0.1")), (1, 12, 2, False, Decimal("0.2")), (2, 8, 1, True, Decimal("0.1"))]
    assert got[1, START].batch > first[1, START].batch and got[2, START].batch == first[2, START].batch
    again = feed(spark, source, tmp_path)
    assert again == got


def test_a_feed_without_rows_is_empty(spark, tmp_path):
    source = str(tmp_path / "runs")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert feed(spark, source, tmp_path) == {}
