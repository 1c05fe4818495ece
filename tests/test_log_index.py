"""The index of a log against a scan of the whole log, over changes of its files."""

import gzip
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from facetledger.sources import log_index, spend_log
from facetledger.plans.report import report
from facetledger.runtime import scratch, stage

LINE = '{{"schema_version": {v}, "timestamp": "{t}", "call_id": "{c}", "session_id": "s", "model": "m", "agent": "a", "pipeline_version": null, "cost_usd": {cost}, "tokens": {{"input": 1, "output": 1, "cache_creation": 0, "cache_read": 0}}, "facets": {facets}, "prompt_prefix": "", "classifier_error": {error}}}'


def line(t, c, cost=0.5, v=1, facets="null", error="null"):
    return LINE.format(t=t, c=c, cost=cost, v=v, facets=facets, error=error)


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "spend-2026-01-01.jsonl").write_text("\n".join([line("2026-01-01T10:00:00Z", "a"), "", "not json", line("2026-01-01T11:00:00Z", "b", v=99), line("2026-03-01T00:30:00Z", "far", 7)]) + "\n")
    (folder / "spend-2026-01-02.jsonl").write_text("\n".join([line("2026-01-02T23:30:00Z", "c", 2), line("2026-01-02T10:00:00Z", "d", error='"E: x"'), line("2026-01-02T10:00:00Z", "e", facets='{"context": {"value": "x", "confidence": 0.5}}', error='"E: y"')]) + "\n")
    (folder / "spend-2026-01-03.jsonl").write_text("")
    return folder


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


RANGES = [(None, None, "UTC"), (date(2026, 1, 2), None, "UTC"), (None, date(2026, 1, 1), "UTC"), (date(2026, 1, 3), date(2026, 1, 3), "Asia/Tokyo"), (date(2026, 2, 28), date(2026, 3, 1), "UTC"), (date(2030, 1, 1), None, "UTC")]


def same_as_scan(spark, log, index):
    for first, last, zone in RANGES:
        whole = spend_log.tag_lines(spend_log.read_lines(spark, str(log)), first, last, zone)
        found = log_index.tagged(spark, index, first, last, zone)
        assert log_index.load_stats(index, found).first().asDict() == spend_log.load_stats(whole).first().asDict()
        calls = lambda tagged: rows_of(spend_log.kept_rows(tagged).select("call_id", "cost_usd", "timestamp"))
        assert calls(found) == calls(whole)
    assert rows_of(log_index.version_histogram(index)) == rows_of(spend_log.version_histogram(spend_log.tag_lines(spend_log.read_lines(spark, str(log)))))


def test_index_equals_a_scan_over_changes(spark, log, tmp_path):
    folder = str(tmp_path / "index")
    index = log_index.refresh(spark, str(log), folder)
    same_as_scan(spark, log, index)
    parsed = lambda: spark.read.parquet(f"{folder}/rows").count()
    before = parsed()
    log_index.refresh(spark, str(log), folder)
    assert parsed() == before  # nothing is parsed again
    (log / "spend-2026-01-02.jsonl").write_text(line("2026-01-02T10:00:00Z", "changed", 9) + "\n")
    (log / "spend-2026-01-04.jsonl").write_text(line("2026-01-04T10:00:00Z", "new") + "\n")
    index = log_index.refresh(spark, str(log), folder)
    assert parsed() == before + 2  # only the changed and the new file
    same_as_scan(spark, log, index)
    (log / "spend-2026-01-01.jsonl").unlink()
    same_as_scan(spark, log, log_index.refresh(spark, str(log), folder))


def test_a_lost_refresh_leaves_nothing_behind(spark, log, tmp_path):
    folder = tmp_path / "index"
    index = log_index.refresh(spark, str(log), str(folder))
    (log / "spend-2026-01-05.jsonl").write_text(line("2026-01-05T10:00:00Z", "late") + "\n")
    spark.read.parquet(str(folder / "files")).limit(0)
    lost = spark.read.parquet(str(folder / "rows")).withColumn("refresh", F.lit("lost")).where("path like '%01-02%'")
    lost.write.mode("append").partitionBy("utc_month").parquet(str(folder / "rows"))  # rows without their line in ``files``
    same_as_scan(spark, log, log_index.refresh(spark, str(log), index.folder))


def test_a_range_reads_its_days_only(spark, log, tmp_path):
    index = log_index.refresh(spark, str(log), str(tmp_path / "index"))
    narrow = log_index.tagged(spark, index, date(2026, 1, 2), date(2026, 1, 2))
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(utc_month" in plan and "GreaterThanOrEqual(utc_date,2026-01-01)" in plan
    tables = report(spark, str(log), first=date(2026, 1, 2), last=date(2026, 1, 2), index=str(tmp_path / "index"))
    assert tables["load"].first().rows_kept == 3 and tables["load"].first().rows_seen == 8 and tables["summary"].first().calls == 3


def test_rows_of_a_large_refresh_stay_in_their_tasks(spark, log, tmp_path, monkeypatch):
    """Nothing wide is shuffled: the rows of a month that two files hold lie in two files of the index, not moved into one."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with gzip.open(log / "part-06.jsonl.gz", "wt") as packed:
        packed.write("\n".join([line("2026-01-06T10:00:00Z", "p"), line("2025-12-31T10:00:00Z", "q"), line("2026-01-05T10:00:00Z", "o"), "{"]) + "\n")
    layout = {}
    for name, limit in (("moved", 1 << 20), ("large", 0)):
        monkeypatch.setattr(log_index, "MOVED_BYTES", limit)
        folder = tmp_path / name
        same_as_scan(spark, log, log_index.refresh(spark, str(log), str(folder)))
        files = [pq.ParquetFile(f).read(["path", "utc_date"]).to_pydict() for f in (folder / "rows" / "utc_month=2026-01").glob("*.parquet")]
        layout[name] = [len(set(f["path"])) for f in files]
        assert all(f["utc_date"] == sorted(f["utc_date"]) for f in files)
    assert layout["moved"] == [3] and layout["large"] == [1, 1, 1]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_scratch_removes_what_is_staged(spark, tmp_path):
    with scratch(spark):
        staged = stage(spark.range(10))
        files = staged.inputFiles()
        assert staged.count() == 10
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
