"""Analytics over classified messages: coverage, confidence, depth, consistency, inheritance, volume.

Messages carry ``session_id``, ``call_id`` and ``paths``: array of (path, confidence). Each report is one
aggregation; per-session questions keep one small set per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetledger.operators.attribution import ratio


def coverage(messages: DataFrame) -> DataFrame:
    matched = F.count_if(F.size("paths") > 0)
    n = F.count(F.lit(1))
    return messages.agg(n.alias("messages"), matched.alias("matched"), (n - matched).alias("unmatched"), (ratio(matched, n) * 100).alias("matched_pct"))


def confidence_bucket(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.95, F.lit(">=0.95")).when(confidence >= 0.85, F.lit("0.85-0.94")).when(confidence >= 0.70, F.lit("0.70-0.84"))
        .when(confidence >= 0.50, F.lit("0.50-0.69")).otherwise(F.lit("<0.50"))
    )


def exploded(messages: DataFrame) -> DataFrame:
    return messages.select("session_id", "call_id", F.inline("paths"))


def _shares(counted: DataFrame) -> DataFrame:
    """Counts with their share of all counted rows; the total is a scalar subquery over the small result."""
    return counted.withColumn("pct", F.col("n") / counted.agg(F.sum("n")).scalar() * 100.0)


def confidence_histogram(messages: DataFrame) -> DataFrame:
    buckets = exploded(messages).groupBy(confidence_bucket(F.col("confidence")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean")
    )
    return _shares(buckets)


def depth_distribution(messages: DataFrame) -> DataFrame:
    return _shares(exploded(messages).groupBy(F.size(F.split("path", "/")).alias("depth")).agg(F.count(F.lit(1)).alias("n")))


def category_shares(messages: DataFrame, level: int = 1) -> DataFrame:
    """Shares of the first path segments; paths that are too short do not count, but stay in the denominator."""
    paths = exploded(messages)
    total = paths.agg(F.count(F.lit(1))).scalar()
    named = paths.filter(F.size(F.split("path", "/")) >= level)
    counted = named.groupBy(F.substring_index("path", "/", level).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.col("n") / total * 100.0)


def common_paths(messages: DataFrame, top: int = 30) -> DataFrame:
    return exploded(messages).groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(top)


def long_tail(messages: DataFrame) -> DataFrame:
    counted = exploded(messages).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    paths, once = F.count(F.lit(1)), F.count_if(F.col("n") == 1)
    return counted.agg(paths.alias("paths"), once.alias("once"), (ratio(once, paths) * 100).alias("once_pct"))


def session_categories(messages: DataFrame) -> DataFrame:
    """Messages and top categories per session. Categories are made distinct before the session level."""
    tops = F.array_distinct(F.transform("paths", lambda p: F.substring_index(p["path"], "/", 1)))
    rows = messages.select("session_id", tops.alias("tops"))
    counted = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    pairs = rows.select("session_id", F.explode("tops").alias("top")).distinct()
    sets = pairs.groupBy("session_id").agg(F.count(F.lit(1)).alias("categories"))
    return counted.join(sets, "session_id", "left").na.fill(0, ["categories"])


def session_consistency(messages: DataFrame) -> DataFrame:
    """Sessions of several messages whose messages share one top category."""
    several = session_categories(messages).filter("messages >= 2")
    return several.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("categories") <= 1).alias("consistent"),
        F.count_if(F.col("categories") > 1).alias("inconsistent"),
    )


def inheritance(classified: DataFrame) -> DataFrame:
    """Verdicts taken from the session or an anchor, and calls with any."""
    from_session = F.filter("classifications", lambda c: F.startswith(c["source"], F.lit("session-inherited-from-")))
    from_anchor = F.filter("classifications", lambda c: F.startswith(c["source"], F.lit("anchor-inherited-from-")))
    return classified.agg(
        F.sum(F.size(from_session)).alias("session_inherited"), F.sum(F.size(from_anchor)).alias("anchor_inherited"),
        F.count_if((F.size(from_session) > 0) | (F.size(from_anchor) > 0)).alias("calls_with_any"), F.count(F.lit(1)).alias("calls"),
    )


def run_costs(messages: DataFrame) -> DataFrame:
    """Totals and means of cost, model calls and time per message."""
    n = F.count(F.lit(1))
    total = {c: F.sum(c) for c in ("cost_usd", "model_calls", "elapsed_sec")}
    return messages.agg(
        n.alias("messages"), *[t.alias(f"total_{c}") for c, t in total.items()], *[ratio(t, n).alias(f"avg_{c}") for c, t in total.items()]
    )


def quality_issues(messages: DataFrame) -> DataFrame:
    """Counts of doubtful results. ``inherited``: whether the message has inherited verdicts."""
    count = lambda test: F.sum(F.size(F.filter("paths", test)))
    return messages.agg(
        count(lambda p: p["confidence"] < 0.70).alias("low_confidence"),
        count(lambda p: F.size(F.split(p["path"], "/")) <= 2).alias("shallow"),
        F.count_if((F.size("paths") == 0) & F.col("inherited")).alias("inherited_only"),
        F.count_if(F.size("paths") >= 3).alias("multi_path"),
    )


def facet_statistics(classified: DataFrame) -> DataFrame:
    """Per facet: calls with a verdict, verdicts, distinct values, mean confidence, inherited verdicts, updates."""
    rows = classified.select("call_id", F.inline("classifications"))
    starts = lambda prefix: F.count_if(F.startswith("source", F.lit(prefix)))
    return rows.groupBy("facet").agg(
        F.count_distinct("call_id").alias("calls"), F.count(F.lit(1)).alias("verdicts"), F.count_distinct("value").alias("distinct_values"),
        F.avg("confidence").alias("mean_confidence"), starts("session-inherited-from-").alias("inherited"),
        starts("back-propagated-from-").alias("back_propagated"),
    )


def facet_values(classified: DataFrame) -> DataFrame:
    """Counts per facet, value and confidence bucket."""
    rows = classified.select(F.inline("classifications"))
    return rows.groupBy("facet", "value", confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def arc_shares(calls: DataFrame, costs: DataFrame) -> DataFrame:
    """An arc's cost, time and model calls split evenly over its calls. ``costs`` has one row per arc."""
    sizes = calls.groupBy("arc_id").agg(F.count(F.lit(1)).alias("arc_size"))
    per_call = costs.join(sizes, "arc_id").select(
        "arc_id", "arc_size", F.bround(F.col("model_calls") / F.col("arc_size"), 2).alias("model_calls"),
        F.bround(F.col("cost_usd") / F.col("arc_size"), 4).alias("cost_usd"), F.bround(F.col("elapsed_sec") / F.col("arc_size"), 2).alias("elapsed_sec"),
    )
    return calls.select("call_id", "arc_id").join(per_call, "arc_id")


def dominant_topics(classified: DataFrame, facet: str = "tags") -> DataFrame:
    """The most frequent value per session, ties to the smaller; counted before the session level."""
    rows = classified.select("session_id", F.inline("classifications")).filter(F.col("facet") == facet)
    counted = rows.groupBy("session_id", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    return counted.groupBy("session_id").agg(best.alias("b"), F.sum("n").alias("verdicts")).select(
        "session_id", F.col("b.value").alias("topic"), (-F.col("b.neg")).alias("n"), "verdicts"
    )


def longest_sessions(calls: DataFrame, top: int = 20) -> DataFrame:
    sessions = calls.filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"))
    return sessions.orderBy(F.desc("calls"), "session_id").limit(top)


def volume(calls: DataFrame, zone: str = "UTC") -> DataFrame:
    """Calls by hour of day, weekday (Monday 0) and month, in long form from one pass."""
    local = F.from_utc_timestamp("timestamp", zone)
    unit = lambda name, value: F.struct(F.lit(name).alias("unit"), value.cast("string").alias("value"))
    units = F.array(unit("hour", F.hour(local)), unit("weekday", F.weekday(local)), unit("month", F.date_format(local, "yyyy-MM")))
    return calls.select(F.inline(units)).groupBy("unit", "value").agg(F.count(F.lit(1)).alias("calls"))


def session_flags(classified: DataFrame, tag: str = "sensitive") -> DataFrame:
    """Sessions with a flagged tag, and sessions that mix business and personal calls."""
    has = lambda facet, value: F.exists("classifications", lambda c: (c["facet"] == facet) & (c["value"] == value))
    flags = classified.filter("session_id is not null").groupBy("session_id").agg(
        F.bool_or(has("tags", tag)).alias("flagged"), F.bool_or(has("context", "business")).alias("business"),
        F.bool_or(has("context", "personal")).alias("personal"),
    )
    return flags.select("session_id", "flagged", (F.col("business") & F.col("personal")).alias("mixed")).filter("flagged or mixed")
