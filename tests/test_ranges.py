"""Tables in buckets by range: scans over them and joins of them move no rows, and carry what whole groups would give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from facetledger.operators import scan
from facetledger.operators.scan import CHUNK, ROW, in_order, next_value, previous_value, running_min, running_sum, stage_ranges
from facetledger.runtime import setting


@pytest.fixture
def rows(spark):
    """One group over many ranges, small ones, one that ends with a range, and one without a key."""
    return spark.range(2000).selectExpr(
        "case when id < 900 then 'a' when id < 1000 then concat('b', id % 30) when id < 1900 then 'c' end as key", "id as at",
        "if(id % 97 = 3, named_struct('n', id, 'text', repeat('x', 20)), null) as found", "id % 13 as n",
    )


def dealt(rows, ranges=7):
    return in_order(rows, ["key"], ["at"], ranges)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def files(frame):
    return [f.rsplit("/", 1)[-1] for f in frame.inputFiles()]


def test_each_range_has_a_bucket_of_its_own(rows):
    made = dealt(rows)
    by_file = made.groupBy(F.input_file_name().alias("file")).agg(F.count_distinct(CHUNK).alias("n")).collect()
    assert len(by_file) == 7 and all(r.n == 1 for r in by_file)
    starts = made.groupBy(CHUNK).agg(F.min(ROW).alias("low"), F.max(ROW).alias("high")).orderBy(CHUNK).collect()
    assert len(starts) == 7 and all(a.high < b.low for a, b in zip(starts, starts[1:]))
    assert not [t for t in made.sparkSession.catalog.listTables() if t.name.startswith("facetledger_")]


@pytest.mark.parametrize("forward", [True, False])
def test_scans_equal_windows_over_whole_groups(rows, forward):
    made = dealt(rows)
    order = F.asc if forward else F.desc
    whole = Window.partitionBy("key").orderBy(order("at"))
    before, up_to = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, 0)
    value = previous_value if forward else next_value
    got = value(made, ["key"], {"seen": F.col("found")})
    got = value(got, ["key"], {"held": F.col("found.n")}, inclusive=True)
    got = running_sum(got, ["key"], {"total": F.col("n")}, forward=forward)
    got = running_min(got, ["key"], {"least": F.col("found")}, inclusive=False, forward=forward)
    wanted = rows.select(
        "at", F.last("found", True).over(before).alias("seen"), F.last("found.n", True).over(up_to).alias("held"), F.sum("n").over(up_to).alias("total"), F.min("found").over(before).alias("least")
    )
    listed = lambda frame: sorted(map(tuple, frame.select("at", "seen", "held", "total", "least").collect()))
    assert listed(got) == listed(wanted)


def test_groups_whose_rows_lie_apart_are_scanned_whole(rows):
    made = dealt(rows.withColumn("part", F.expr("if(at % 3 = 0, null, (at % 3) * (at div 400))")))
    got = running_sum(previous_value(made, ["part"], {"seen": F.col("found")}), ["part"], {"total": F.col("n")})
    before = Window.partitionBy("part").orderBy(ROW)
    wanted = made.select("at", F.last("found", True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("seen"), F.sum("n").over(before).alias("total"))
    listed = lambda frame: sorted(map(tuple, frame.select("at", "seen", "total").collect()))
    assert listed(got) == listed(wanted)


def test_scans_move_only_what_they_carry(rows):
    made = dealt(rows)
    got = next_value(previous_value(made, ["key"], {"seen": F.col("found")}), ["key"], {"later": F.col("found")})
    moved = plan(got).split("BroadcastExchange")[0]  # the rows themselves come first, what is carried after them
    assert "Window" in moved and "Bucketed: true" in moved and "Exchange" not in moved


def test_joins_by_range_and_row_move_nothing(spark, rows):
    made = dealt(rows)
    with setting(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        other = stage_ranges(scan.by_range(made.select(CHUNK, ROW, (F.col("n") * 2).alias("double"))))
        joined = stage_ranges(made.join(other, [CHUNK, ROW], "left"))
    assert len(files(other)) == len(files(joined)) == 7  # rows that were moved by both keys would leave several files a range
    assert joined.filter("double = 2 * n").count() == 2000
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_a_range_has_a_bounded_number_of_rows(rows, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_A_RANGE", 100)
    made = in_order(rows, ["key"], ["at"])
    sizes = [r["count"] for r in made.groupBy(CHUNK).count().collect()]
    assert scan.ranges_of(made) == scan.ranges_of(made.filter("n > 3").select(CHUNK)) == 20 and len(sizes) == 20 and max(sizes) <= 300
