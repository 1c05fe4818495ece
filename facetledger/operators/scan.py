"""Ordered scans over long groups: previous and next values and running minima without one task per group.

Rows are first dealt to ranges of (group, order) of about equal size (``in_order``), by rows and not by time, so a group with
a third of all rows, or a million rows of one hour, lies in as many ranges as its size asks for. A window runs inside each
(group, range); the ranges' own results, one row per group and range, are scanned per group and carried back. Only what a
group has after its first range needs a carry, and every range begins in at most one group, so the carry has fewer rows than
there are ranges, whatever the data. Groups that lie in one range are left out by a hash of their keys before anything moves.

The dealt rows are written in buckets by their range, one each, and so is every table a chain of scans writes
(``stage_ranges``): windows by (group, range) and joins by (range, row) move nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetledger.runtime import setting, stage

CHUNK = "_chunk"
ROW = "_row"


ROWS_A_RANGE = 50_000
RANGES = "ranges"  # in the metadata of ``_chunk``


def in_order(
    rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None, then: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Deals rows to ranges of (keys, order) and adds the range as ``_chunk`` and the place among all rows as ``_row`` (a
    number that grows along the order). Rows that have both are left as they are. The dealt rows are written, as the limits
    of the ranges are drawn from a sample of the rows: all scans must see the same ones. ``ranges``: how many, by default
    the session's shuffle partitions, or more so that a range has about ``ROWS_A_RANGE`` rows and its windows fit in memory.
    ``then``: a costly step whose result is written instead (it keeps both columns); the sample, for which all rows are made
    once more, and the move come before it."""
    if {CHUNK, ROW} <= set(rows.columns):
        return stage_ranges(then(rows)) if then else rows
    spark = rows.sparkSession
    count = ranges or max(_partitions(spark), -(-rows.count() // ROWS_A_RANGE))
    dealt = rows.repartitionByRange(count, *keys, *order).sortWithinPartitions(*keys, *order)
    label = F.get(F.array(*map(F.lit, _labels(spark, count))), F.spark_partition_id())
    numbered = dealt.select("*", label.alias(CHUNK, metadata={RANGES: count}), F.monotonically_increasing_id().alias(ROW))
    return stage_ranges(then(numbered) if then else numbered, count)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges_of(rows: DataFrame) -> int:
    """How many ranges rows were dealt to."""
    return rows.schema[CHUNK].metadata.get(RANGES) or _partitions(rows.sparkSession)


def by_range(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Moves rows to the tasks of their ranges."""
    return rows.repartition(ranges or ranges_of(rows), CHUNK)


def stage_ranges(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Writes rows in the buckets of their ranges. They should lie by ranges (read from such a table, or ``by_range``), as each
    task writes a file for every range it has. Joins by the range and a second key need no other order either."""
    with setting(rows.sparkSession, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        return stage(rows, CHUNK, ranges or ranges_of(rows))


def _labels(spark: SparkSession, count: int) -> list[int]:
    """Growing numbers for the ranges, of which each falls into a bucket of its own; a number falls into that of its hash."""
    spread = spark.range(20 * count + 200).select(F.col("id").cast("int").alias("n"))
    found = spread.groupBy(F.pmod(F.hash("n"), F.lit(count)).alias("bucket")).agg(F.min("n").alias("n")).collect()
    return sorted(row.n for row in found) if len(found) == count else list(range(count))


def _carry(rows: DataFrame, keys: list[str], values: dict[str, Column], kind: str, forward: bool, inclusive: bool) -> DataFrame:
    data = rows
    for name, value in values.items():
        data = data.withColumn(f"_v_{name}", value)
    direction = F.asc if forward else F.desc
    local_end = Window.currentRow if inclusive else -1
    local = Window.partitionBy(*keys, CHUNK).orderBy(direction(ROW)).rowsBetween(Window.unboundedPreceding, local_end)
    picks = {
        "last": (
            lambda c: F.last(c, ignorenulls=True),
            lambda c: (F.max_by if forward else F.min_by)(c, F.when(c.isNotNull(), F.col(ROW))),
        ),
        "min": (F.min, F.min),
        "sum": (F.sum, F.sum),
    }
    over_rows, over_chunk = picks[kind]
    # Most groups lie in one range; a hash that two groups share only adds one to those that are looked at.
    name = F.xxhash64(*keys)
    spans = rows.groupBy(name.alias("_group")).agg(F.min(CHUNK).alias("_low"), F.max(CHUNK).alias("_high")).filter("_low < _high")
    several = data.join(F.broadcast(spans.select("_group")), name == F.col("_group"), "left_semi")
    totals = several.groupBy(*keys, CHUNK).agg(*[over_chunk(F.col(f"_v_{n}")).alias(f"_c_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy(direction(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, CHUNK, *[over_rows(F.col(f"_c_{n}")).over(before).alias(f"_c_{n}") for n in values])
    useful = F.lit(False)
    for name in values:
        useful = useful | F.col(f"_c_{name}").isNotNull()
    renamed = carried.filter(useful).select(
        *[F.col(k).alias(f"_k_{k}") for k in (*keys, CHUNK)], *[f"_c_{n}" for n in values]
    )
    windowed = data.select("*", *[over_rows(F.col(f"_v_{n}")).over(local).alias(f"_l_{n}") for n in values])
    same = None
    for key in (*keys, CHUNK):
        match = F.col(key).eqNullSafe(F.col(f"_k_{key}"))
        same = match if same is None else same & match
    joined = windowed.join(F.broadcast(renamed), same, "left")  # fewer rows than ranges
    combine = {
        "last": lambda l, c: F.coalesce(l, c),
        "min": lambda l, c: F.when(c.isNull() | (l <= c), l).otherwise(c),
        "sum": lambda l, c: F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0)),
    }[kind]
    results = [combine(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in values]
    return joined.select(*[c for c in rows.columns if c not in values], *results)


def previous_value(rows: DataFrame, keys: list[str], values: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """Adds, per name, the last non-null value before each row (or up to it) in its group."""
    return _carry(rows, keys, values, "last", True, inclusive)


def next_value(rows: DataFrame, keys: list[str], values: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """Adds, per name, the first non-null value after each row (or from it on) in its group."""
    return _carry(rows, keys, values, "last", False, inclusive)


def running_sum(rows: DataFrame, keys: list[str], values: dict[str, Column], inclusive: bool = True, forward: bool = True) -> DataFrame:
    return _carry(rows, keys, values, "sum", forward, inclusive)


def running_min(rows: DataFrame, keys: list[str], values: dict[str, Column], inclusive: bool = True, forward: bool = True) -> DataFrame:
    """Smallest value so far; for structs the smallest by their fields in order."""
    return _carry(rows, keys, values, "min", forward, inclusive)
