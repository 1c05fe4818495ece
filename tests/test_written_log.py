"""The written log: compressed lines, rows moved before their lines are made, and the bytes that files state."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from facetledger.sources import spend_log
from facetledger.sources.tables import SPEND_TIME, spend_from_items


@pytest.fixture
def items(spark):
    return spark.range(3000).selectExpr(
        "id as l_orderkey", "id % 40 as l_partkey", "id % 9 as l_suppkey", "1 + id % 7 as l_linenumber", "cast(id % 50 as double) as l_quantity",
        "cast(id as double) as l_extendedprice", "0.05D as l_discount", "'N' as l_returnflag", "'O' as l_linestatus",
        "if(id % 100 = 99, null, date_add(date'1996-01-01', cast(id % 3 as int))) as l_shipdate",
    )


def size(folder):
    return sum(map(os.path.getsize, glob.glob(f"{folder}/utc_date=*/part-*")))


def test_lines_are_compressed_and_the_same_either_way(spark, items, tmp_path):
    rows, plain, packed, narrow = spend_from_items(items), *(str(tmp_path / x) for x in ("plain", "packed", "narrow"))
    spend_log.append_daily(rows, plain, codec="none")
    spend_log.append_daily(rows, packed)
    spend_log.append_daily(spend_from_items(spend_log.by_day(items.withColumn("utc_date", F.to_date(F.expr(SPEND_TIME))))), narrow)
    lines = lambda folder: sorted(tuple(r) for r in spend_log.read_lines(spark, folder).select("line", F.regexp_extract("file", spend_log.DAY_IN_PATH, 1)).collect())
    assert lines(plain) == lines(packed) == lines(narrow) and len(lines(plain)) == 3000
    assert max(size(packed), size(narrow)) * 4 < size(plain)


def test_files_state_the_bytes_of_their_lines(spark, items, tmp_path):
    folder = str(tmp_path / "log")
    spend_log.append_daily(spend_from_items(items), folder)
    spend_log.append_daily(spend_from_items(items), folder, codec="none")
    stated = {r.path: r.bytes for r in spend_log.line_bytes(spark, folder).collect()}
    held = spend_log.read_lines(spark, folder).groupBy("file").agg(F.sum(F.octet_length("line") + 1).alias("n"))
    assert len(stated) >= 8 and sorted(stated.values()) == sorted(r.n for r in held.collect())


def test_lines_are_made_after_the_rows_have_moved(spark, items, tmp_path):
    moved = spend_log.by_day(items.withColumn("utc_date", F.to_date(F.expr(SPEND_TIME))))
    plan = spend_from_items(moved).select("utc_date", spend_log.spend_line())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("to_json") < plan.index("RebalancePartitions") and "to_json" not in plan[plan.index("RebalancePartitions"):]


def test_classified_rows_lie_in_even_tasks(spark, monkeypatch):
    from facetledger.sources import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    rows = tables.evenly(spark.range(0, 5000, 1, 1))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert rows.count() == 5000 and len(sizes) == 50 and max(sizes) <= 200


def test_a_costly_step_runs_once_and_after_the_move(spark):
    from facetledger.operators.scan import CHUNK, ROW, in_order

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    step = lambda rows: rows.mapInArrow(count, rows.schema)
    made = in_order(spark.range(1000), ["id"], [], 4, then=step)
    assert [r.id for r in made.orderBy(ROW).collect()] == list(range(1000)) and made.select(CHUNK).distinct().count() == 4
    assert seen.value == 1000  # sampling the ranges does not run it
