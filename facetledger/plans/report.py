"""The cost report and the corpus job as library calls."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetledger.operators import attribution as at
from facetledger.operators.classify import Classifier
from facetledger.operators.sessions import SessionJob, SessionRules, run_sessions
from facetledger.runtime import scratch
from facetledger.sources import log_index, spend_log
from facetledger.sources.exports import write_corpus


def report(
    spark: SparkSession, directory: str, first: date | None = None, last: date | None = None, days: int | None = None,
    by: Iterable[str] = at.ALL_FACETS, top: int = 20, zone: str = "UTC", today: date | None = None, index: str | None = None,
) -> dict[str, DataFrame]:
    """All tables of a spend report over a log folder, keyed by name. ``days`` counts back from today.

    The log's index (in ``index``, by default in the shared folder) is brought up to date first, so a file is parsed once
    for all reports, and only the days of the range are read. ``load`` and ``versions`` are of the whole log, whatever the
    range; of the counters only the kept rows and those skipped by date depend on it."""
    if days is not None and first is None:
        first = (today or date.today()) - timedelta(days=days - 1)
    log = log_index.refresh(spark, directory, index)
    tagged = log_index.tagged(spark, log, first, last, zone)
    spend = at.flatten_spend(spend_log.kept_rows(tagged), zone)
    tables = {
        "load": log_index.load_stats(log, tagged), "versions": log_index.version_histogram(log), "summary": at.report_summary(spend),
        "kpis": at.kpis(spend), "matrix": at.domain_activity(spend), "agent": at.top_buckets(at.breakdown(spend, "agent"), top),
    }
    for facet in by:
        column = {"tags": "primary_tag", "project": "primary_project"}.get(facet, facet)
        tables[f"{facet}/primary"] = at.top_buckets(at.breakdown(spend, column), top)
        tables[f"{facet}/diagnostics"] = at.diagnostics(spend, column, top, report_style=True)
        if facet in ("tags", "project"):
            tables[f"{facet}/any"] = at.top_buckets(at.any_lens(spend, "tags" if facet == "tags" else "projects"), top)
    return tables


def classify_corpus(
    calls: DataFrame, path: str, classifiers: Mapping[str, Classifier] | None = None, rules: SessionRules = SessionRules(),
) -> SessionJob:
    """Runs both passes over a corpus and writes the final verdicts with the start of each prompt, one row about the run,
    and the tables of changes. The tables that the job stages on the way are removed; those returned are the written ones."""
    spark = calls.sparkSession
    with scratch(spark):
        job = run_sessions(calls, classifiers, rules)
        flushed = job.revisions.filter("phase = 'flush'")
        by_agent = job.final.groupBy(F.coalesce("agent", F.lit("unknown")).alias("agent")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("agent", "n"))))
        meta = job.final.agg(
            F.count(F.lit(1)).alias("total_messages"), F.count_distinct("session_id").alias("total_sessions"), by_agent.scalar().alias("messages_by_agent"),
        ).select(
            "*", flushed.agg(F.count_distinct("arc_id")).scalar().alias("revised_arcs"), flushed.agg(F.count(F.lit(1))).scalar().alias("revised_updates"),
            job.updates.agg(F.count(F.lit(1))).scalar().alias("back_propagated"), F.current_timestamp().alias("generated_at"),
        )
        write_corpus(job.final, meta, path, calls)
        tables = {"final": job.final, "updates": job.updates, "revisions": job.revisions, "changes": job.changes}
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return SessionJob(**{name: spark.read.parquet(f"{path}/{name}") for name in tables})
