"""A columnar index of a spend log: every file is parsed once, and a range of days reads only the days it needs.

The index has two tables. ``rows`` holds the readable rows, partitioned by the UTC month and ordered by the UTC day of the
row's own time (not of the file's name), so a row is found under its day whichever file it lies in; the statistics of the
files skip other days inside a month. ``files`` has one line a parsed file: path, time and
size (the fingerprint), days and counters by reason, which the load counters are sums of. Refreshing parses the files whose
fingerprint is new; a file that has changed is parsed again and its old rows no longer count.

The rows of a large refresh are written by the tasks that parse them, so that nothing wide is shuffled. A file of a log holds
mostly one day, so a month gets about as many files as the log has for it; the rows of a small refresh are moved to few files.

A refresh writes its rows first and its files after them, and rows count only with a line in ``files`` of the same refresh;
so a refresh that is lost on the way, or that runs twice, leaves nothing behind that is ever read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetledger.runtime import checkpoint_dir, setting, stage
from facetledger.schemas import SPEND_LINE
from facetledger.sources import spend_log

FORMAT = 2  # of the tables below: an index of another format is another folder
FILES = (
    "path string, modificationTime timestamp, length bigint, refresh string, at timestamp, first_day date, last_day date, rows_seen bigint, "
    "rows_readable bigint, rows_blank bigint, rows_parse bigint, rows_schema bigint, versions map<int,bigint>"
)
MOVED_BYTES = 32 << 20  # of a refresh's files: the rows of more are written where they are parsed
PACKED_BYTES = 16 << 20  # of packed files in a task, whose lines are ten times larger and are ordered in memory


@dataclass(frozen=True)
class LogIndex:
    """``folder`` of the index, ``directory`` of the log it is of, and the lines of its files as of the refresh, so that all
    tables of a report are of one state of the log."""

    folder: str
    directory: str
    files: DataFrame


def default_folder(spark: SparkSession, directory: str) -> str:
    """Where the index of a log lies unless a folder is named: by the log's path, in the shared folder."""
    name = spark.range(1).select(F.sha1(F.lit(directory.rstrip("/")))).first()[0]
    return f"{checkpoint_dir(spark).rstrip('/')}/log-index-{FORMAT}-{name}"


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    """Path (as rows name it), time, size, and the path to read, of each file of the log; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", spend_log.LOG_GLOB).option("recursiveFileLookup", "true").load(directory)
    return files.select(F.col("_metadata.file_path").alias("path"), "modificationTime", "length", F.col("path").alias("to_read"))


def known_files(spark: SparkSession, folder: str, there: DataFrame) -> DataFrame:
    """The lines of the files that are there, as they are: the newest refresh of each fingerprint."""
    newest = Window.partitionBy("path").orderBy(F.desc("at"), F.desc("refresh"))
    lines = _table(spark, folder, "files", FILES).join(there, ["path", "modificationTime", "length"], "left_semi")
    return lines.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def refresh(spark: SparkSession, directory: str, folder: str | None = None) -> LogIndex:
    """Brings the index of a log up to date; parses new and changed files only."""
    folder = folder or default_folder(spark, directory)
    there = stage(fingerprints(spark, directory))
    known = stage(known_files(spark, folder, there))
    new = there.join(known.select("path"), "path", "left_anti")
    listed = new.select("to_read", "length").collect()  # the driver lists the files of a scan anyway
    paths = [row.to_read for row in listed]
    if not paths:
        return LogIndex(folder, directory, known)
    number = uuid.uuid4().hex
    text = spark.read.option("recursiveFileLookup", "true").text(paths)
    lines = text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    tagged = spend_log.tag_lines(lines).withColumn("utc_date", F.to_date(spend_log.parse_timestamp(F.col("row.timestamp"))))
    readable = F.col("reject").isNull()
    # One parse for both tables: readable rows and the fate of the other lines, by day (null for lines without one).
    parsed = tagged.select(
        "path", "reject", F.when(readable | (F.col("reject") == "schema"), F.col("row.schema_version")).alias("version"),
        F.when(readable, F.col("row")).alias("row"), F.when(readable, F.col("utc_date")).alias("utc_date"),
    )
    dated = parsed.withColumn("utc_month", F.date_format("utc_date", "yyyy-MM"))
    if sum(row.length for row in listed) <= MOVED_BYTES:
        dated = dated.hint("rebalance", "utc_month")
    ordered = dated.sortWithinPartitions("utc_month", "utc_date").withColumn("refresh", F.lit(number))
    packed = {"spark.sql.files.maxPartitionBytes": PACKED_BYTES} if any(path.endswith(".gz") for path in paths) else {}
    with setting(spark, **packed):
        ordered.write.mode("append").partitionBy("utc_month").parquet(f"{folder}/rows", compression="zstd")
    own = _rows(spark, folder).filter(F.col("refresh") == number)
    count = lambda reason: F.count_if(F.col("reject") == reason).alias(f"rows_{reason}")
    totals = own.groupBy("path").agg(
        F.min("utc_date").alias("first_day"), F.max("utc_date").alias("last_day"), F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(F.col("reject").isNull()).alias("rows_readable"), *[count(r) for r in ("blank", "parse", "schema")],
    )
    versions = own.filter("version is not null").groupBy("path", "version").agg(F.count(F.lit(1)).alias("n"))
    by_path = versions.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("version", "n"))).alias("versions"))
    files = new.join(totals, "path", "left").join(by_path, "path", "left").withColumns({"refresh": F.lit(number), "at": F.current_timestamp()})
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("rows_seen", "rows_readable", "rows_blank", "rows_parse", "rows_schema")}
    columns = [part.strip().split()[0] for part in FILES.replace("map<int,bigint>", "map").split(",")]
    files.withColumns(zero).select(*columns).coalesce(1).write.mode("append").parquet(f"{folder}/files")
    return LogIndex(folder, directory, stage(known_files(spark, folder, there)))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    schema = f"refresh string, path string, reject string, version int, row struct<{', '.join(x.replace(' ', ':', 1) for x in _fields())}>, utc_date date, utc_month string"
    return _table(spark, folder, "rows", schema)


def _fields() -> list[str]:
    """The fields of a spend line, with the column that marks a line that does not parse."""
    out, depth, word = [], 0, ""
    for c in SPEND_LINE + ", _corrupt string":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def tagged(spark: SparkSession, index: LogIndex, first: date | None = None, last: date | None = None, zone: str = "UTC") -> DataFrame:
    """Readable rows in the shape of ``spend_log.tag_lines``, of the days that an inclusive range of local dates can touch:
    rows outside the range are marked, other days are not read."""
    rows = _rows(spark, index.folder).filter("reject is null")
    local = F.to_date(F.from_utc_timestamp(spend_log.parse_timestamp(F.col("row.timestamp")), zone))
    outside = F.lit(False)
    if first is not None:
        day = first - timedelta(days=1)
        rows = rows.filter((F.col("utc_month") >= day.strftime("%Y-%m")) & (F.col("utc_date") >= F.lit(day)))
        outside = outside | (local < F.lit(first))
    if last is not None:
        day = last + timedelta(days=1)
        rows = rows.filter((F.col("utc_month") <= day.strftime("%Y-%m")) & (F.col("utc_date") <= F.lit(day)))
        outside = outside | (local > F.lit(last))
    valid = index.files.select("path", "refresh")
    return rows.join(valid, ["path", "refresh"], "left_semi").withColumn("reject", F.when(outside, F.lit("date"))).withColumnRenamed("path", "file")


def load_stats(index: LogIndex, rows: DataFrame) -> DataFrame:
    """The load counters of the whole log, for the rows of a range (see ``tagged``): files, lines and their faults are
    sums over the files' lines; a readable row that is not kept was skipped by its date."""
    files = index.files.agg(
        F.count_if(F.col("rows_seen") > 0).alias("files_seen"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows_seen", "rows_readable", "rows_blank", "rows_parse", "rows_schema")],
    )
    failed = F.col("row.classifier_error").isNotNull()
    kept = rows.filter("reject is null").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.count_if(failed & F.col("row.facets").isNull()).alias("rows_classifier_error"),
        F.count_if(failed & F.col("row.facets").isNotNull()).alias("rows_meta_skipped"),
    )
    return files.crossJoin(kept).select(  # one row each
        "files_seen", "rows_seen", "rows_kept", F.col("rows_blank").alias("rows_skipped_blank"), F.col("rows_parse").alias("rows_skipped_parse"),
        F.col("rows_schema").alias("rows_skipped_schema"), (F.col("rows_readable") - F.col("rows_kept")).alias("rows_skipped_date"),
        "rows_classifier_error", "rows_meta_skipped",
    )


def version_histogram(index: LogIndex) -> DataFrame:
    """Readable lines per schema version, of the whole log."""
    return index.files.select(F.explode("versions").alias("schema_version", "n")).groupBy("schema_version").agg(F.sum("n").alias("rows"))
