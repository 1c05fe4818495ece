"""The spend log: lines of JSON in daily files, read with a reason for every rejected line, and written back."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetledger.operators.resolve import facet_lists
from facetledger.schemas import SCHEMA_VERSION, SPEND_LINE, TOKENS
from facetledger.vocab import TOKEN_ALIASES

LOG_GLOB = "{spend-*.jsonl,part-*}"  # daily files, and the files that ``append_daily`` writes in daily folders
DAY_IN_PATH = r"(?:spend-|utc_date=)(\d{4}-\d{2}-\d{2})"
KNOWN_VERSIONS = (SCHEMA_VERSION,)
REJECTS = ("blank", "parse", "schema", "date")


def read_lines(spark: SparkSession, directory: str, pattern: str = LOG_GLOB) -> DataFrame:
    """Raw lines with the file they came from."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(directory)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def fingerprint(spark: SparkSession, directory: str, pattern: str = LOG_GLOB) -> DataFrame:
    """Path, time and size of each input file; no content is read. Changes when any file changes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    return files.select("path", "modificationTime", "length")


def parse_timestamp(text: Column) -> Column:
    """ISO time; text without a zone is UTC (the session's zone); null when it cannot be read."""
    return F.try_to_timestamp(text)


def tag_lines(lines: DataFrame, first: date | None = None, last: date | None = None, zone: str = "UTC") -> DataFrame:
    """Parses lines and adds ``reject``: null for rows to keep, else why the line is skipped.

    A line of another version may have another shape, so the version is judged before the other fields.
    """
    parsed = F.from_json(
        "line", SPEND_LINE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    rows = lines.select("*", F.explode(F.array(parsed)).alias("row"))
    row = F.col("row")
    corrupt = row["_corrupt"].isNotNull()
    broken = corrupt & (~F.startswith(F.ltrim("line"), F.lit("{")) | F.try_parse_json("line").isNull())
    moment = parse_timestamp(row["timestamp"])
    null_cost = row["cost_usd"].isNull() & F.regexp_like("line", F.lit(r'"cost_usd"\s*:\s*null'))
    local = F.to_date(F.from_utc_timestamp(moment, zone))
    outside = F.lit(False)
    if first is not None:
        outside = outside | (local < F.lit(first))
    if last is not None:
        outside = outside | (local > F.lit(last))
    known = F.coalesce(row["schema_version"].isin(*KNOWN_VERSIONS), F.lit(False))
    reject = (
        F.when(F.trim("line") == "", F.lit("blank"))
        .when(broken, F.lit("parse"))
        .when(~known, F.lit("schema"))
        .when(corrupt | moment.isNull() | null_cost, F.lit("parse"))
        .when(outside, F.lit("date"))
    )
    return rows.withColumn("reject", reject)


def kept_rows(tagged: DataFrame) -> DataFrame:
    """Spend rows of the kept lines, with the defaults readers expect."""
    return tagged.filter("reject is null").select("row.*").drop("_corrupt").withColumns(
        {
            "timestamp": parse_timestamp(F.col("timestamp")),
            "cost_usd": F.coalesce("cost_usd", F.lit(0).cast("decimal(18,6)")),
            "model": F.coalesce("model", F.lit("unknown")),
            "agent": F.coalesce("agent", F.lit("unknown")),
            "tokens": F.struct(
                *[F.coalesce(F.col(f"tokens.{name}"), F.lit(0)).cast("bigint").alias(name) for name in TOKEN_ALIASES]
            ),
        }
    )


def load_spend(spark: SparkSession, directory: str, first: date | None = None, last: date | None = None, zone: str = "UTC") -> DataFrame:
    """Spend rows of a log folder inside an inclusive range of local dates. All files are read, as a row may lie in the file
    of another day; ``log_index`` reads only the days of a range."""
    return kept_rows(tag_lines(read_lines(spark, directory), first, last, zone))


def load_stats(tagged: DataFrame) -> DataFrame:
    """One row of load counters; seen equals kept plus all rejects."""
    kept = F.col("reject").isNull()
    failed = F.col("row.classifier_error").isNotNull()
    return tagged.agg(
        F.count_distinct("file").alias("files_seen"),
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(kept).alias("rows_kept"),
        *[F.count_if(F.col("reject") == reason).alias(f"rows_skipped_{reason}") for reason in REJECTS],
        F.count_if(kept & failed & F.col("row.facets").isNull()).alias("rows_classifier_error"),
        F.count_if(kept & failed & F.col("row.facets").isNotNull()).alias("rows_meta_skipped"),
    )


def version_histogram(tagged: DataFrame) -> DataFrame:
    """Readable lines per schema version."""
    readable = tagged.filter("reject is null or reject in ('schema', 'date')")
    return readable.groupBy(F.col("row.schema_version").alias("schema_version")).agg(F.count(F.lit(1)).alias("rows"))


def normalize_tokens(usage: Column, aliases: Mapping[str, tuple[str, ...]] = TOKEN_ALIASES) -> Column:
    """The four token counters from a map of any accepted spellings. The first spelling present is taken, even
    when its value is null or unreadable (then 0)."""

    def counter(names: tuple[str, ...]) -> Column:
        out = F
        for name in names:
            value = F.element_at(usage, name).try_cast("bigint")
            out = out.when(F.map_contains_key(usage, name), F.coalesce(value, F.lit(0)))
        return out.otherwise(F.lit(0)).cast("bigint")

    return F.struct(*[counter(names).alias(name) for name, names in aliases.items()]).cast(TOKENS)


def spend_records(results: DataFrame, prefix_length: int = 80) -> DataFrame:
    """Spend rows from classified calls with ``cost_usd``, ``usage`` (map), ``classifications`` (null on failure),
    ``prompt_text`` and ``classifier_error``. A prefix length of 0 leaves the prompt out."""
    text = F.coalesce("prompt_text", F.lit(""))
    filled = lambda name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown"))
    return results.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "timestamp", "call_id", "session_id",
        filled("model").alias("model"), filled("agent").alias("agent"), "pipeline_version",
        F.bround("cost_usd", 6).cast("decimal(18,6)").alias("cost_usd"),
        normalize_tokens(F.coalesce("usage", F.create_map().cast("map<string,string>"))).alias("tokens"),
        facet_lists(F.col("classifications")).alias("facets"),
        (F.substring(text, 1, prefix_length) if prefix_length > 0 else F.lit("")).alias("prompt_prefix"),
        "classifier_error",
    )


def spend_line(timestamp: str = "timestamp") -> Column:
    """A row as its JSON line, nulls written out."""
    iso = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    names = [part.split()[0] for part in (
        "schema_version", "timestamp", "call_id", "session_id", "model", "agent", "pipeline_version", "cost_usd", "tokens",
        "facets", "prompt_prefix", "classifier_error",
    )]
    fields = [iso.alias("timestamp") if n == "timestamp" else F.col(n) for n in names]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def by_day(rows: DataFrame) -> DataFrame:
    """Rows with a column ``utc_date``, dealt and ordered by it. The rebalance hint splits a hot day and merges small ones."""
    return rows.hint("rebalance", "utc_date").sortWithinPartitions("utc_date")


def append_daily(rows: DataFrame, directory: str, mode: str = "append", codec: str = "gzip") -> None:
    """Writes rows under one folder per UTC day, compressed. Rows are moved and ordered before their lines are made, which are
    several times larger. Rows that have ``utc_date`` lie in the order of ``by_day`` already, which is cheaper still for
    rows made from a narrower table."""
    dated = rows if "utc_date" in rows.columns else by_day(rows.withColumn("utc_date", F.to_date("timestamp")))
    dated.select("utc_date", spend_line().alias("value")).write.mode(mode).partitionBy("utc_date").text(directory, compression=codec)


def line_bytes(spark: SparkSession, directory: str, pattern: str = LOG_GLOB) -> DataFrame:
    """Path of each file and the bytes of its lines as the file itself states them: its size, or what a gzip file of less
    than 4 GiB of lines notes in its last four bytes. Files are read whole, but not unpacked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    tail = F.hex(F.substring("content", -4, 4))  # the least byte first
    noted = F.conv(F.concat(*[F.substring(tail, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    return files.select("path", F.when(F.col("path").endswith(".gz"), noted).otherwise(F.col("length")).alias("bytes"))


def last_per_id(rows: DataFrame, order: Column, key: str = "id") -> DataFrame:
    """The last row of each id. Combined before the shuffle, so a hot id costs one row per task."""
    others = [F.col(c) for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def load_keyed(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """JSON lines as one row an id: the last line of an id counts, in the order of the files' paths and of the lines in a
    file. Lines that do not parse or have no id are left out."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    parsed = text.select(place.alias("_place"), F.from_json("value", schema).alias("row")).filter(F.col(f"row.{key}").isNotNull())
    return last_per_id(parsed.select("row.*", "_place"), F.col("_place"), key).drop("_place")
