"""Structured Streaming jobs: ingest, online session labels, rolling session state and live rollups.

Sessions are kept as typed keyed state: the facets carried along, the calls that may still change, and a buffer in which
calls wait until the watermark has passed them. They leave it in the order of their times, so the micro-batch in which a call
arrives, and its place there, do not matter as long as it is no later than the watermark allows. Changes to earlier calls
leave as append-only records, never as updates in place.

Typed state needs the RocksDB state store; ``typed_state`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import date
from decimal import Decimal

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from facetledger.operators import resolve as rs
from facetledger.operators.classify import Classifier, bind, with_candidates
from facetledger.operators.sessions import FROM_ARC, SessionRules, classify_sessions, is_anchor, revise_by_text, with_arcs
from facetledger.runtime import stage
from facetledger.sources import api_log, spend_log
from facetledger.streaming import fold

RECORD = "session_id string, call_id string, kind string, facet string, value string, confidence double, source string"
SESSION_STATE = (
    "session_id string, call_id string, updated_at timestamp, total_cost_usd double, call_count bigint, "
    "context string, domain string, activity string, project array<string>, "
    "tags array<struct<value:string,confidence:double,turns_since_seen:int>>"
)


def read_spend_stream(spark: SparkSession, directory: str) -> DataFrame:
    """New spend-log lines as they appear; the checkpoint remembers which files were read."""
    lines = spark.readStream.option("pathGlobFilter", spend_log.LOG_GLOB).option("recursiveFileLookup", "true").text(directory)
    return spend_log.tag_lines(lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")))


def logged_calls(log: DataFrame, classifiers: Mapping[str, Classifier] | None = None, prefix_length: int = 80) -> DataFrame:
    """Every API call of a session as a spend row: transcripts handed on are not classified but keep their cost.
    Works on a batch or a stream."""
    calls = api_log.extract_calls(log).filter("session_id is not null")
    classified = rs.classify(calls, classifiers)
    kept = classified.withColumn("classifications", F.when(F.col("classifier_error").isNull(), F.col("classifications")))
    return spend_log.spend_records(kept, prefix_length)


def prepared(calls: DataFrame, rules: SessionRules, classifiers: Mapping[str, Classifier] | None = None) -> DataFrame:
    """Calls with their candidates and the few fields the session fold reads. Runs in the JVM."""
    slim = F.transform(
        "candidates", lambda c: F.struct(c["facet"].alias("facet"), c["value"].alias("value"), c["confidence"].alias("confidence"), c["source"].alias("source"))
    )
    return with_candidates(calls, classifiers).filter("session_id is not null").select(
        "session_id", "call_id", "timestamp", (F.unix_micros("timestamp") / 1e6).alias("at"), F.col("working_directory").alias("workdir"),
        F.element_at("request_tags", "context").alias("declared"), F.coalesce(is_anchor(rules.anchor_min_chars), F.lit(False)).alias("anchor"),
        slim.alias("candidates"),
    )


VERDICT = "struct<facet:string,value:string,confidence:double,source:string>"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_state(spark: SparkSession) -> None:
    """The state store that typed state, timers and the reader of state need."""
    if spark.conf.get(STORE, "") != ROCKS:
        spark.conf.set(STORE, ROCKS)


def _text(value):
    return None if value is None or value != value else str(value)


def _verdicts(items) -> list[dict]:
    return [dict(zip(("facet", "value", "confidence", "source"), item)) for item in items]


def _plain(value):
    """What a state variable gives, in the types that it takes."""
    if isinstance(value, tuple):
        return tuple(map(_plain, value))
    return [_plain(x) for x in value] if isinstance(value, list) else value


class Buffered(StatefulProcessor):
    """Rows of a session wait until the watermark has passed them, and are handed on in order of time and id."""

    waiting_schema = ""  # begins with at (seconds) and call_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def waiting_row(self, row: dict) -> tuple:
        raise NotImplementedError

    def released(self, session: str, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def next_timer(self) -> int | None:
        """When, beside the rows that wait, this session has something to do (milliseconds)."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [self.waiting_row(row) for part in rows for row in part.to_dict("records")]
        if new:
            self.waiting.appendList(new)
            self._set_timer(min(int(row[0] * 1000) for row in new), timerValues)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = sorted((_plain(row) for row in self.waiting.get()), key=lambda row: row[:2])
        ready = [row for row in rows if int(row[0] * 1000) <= watermark]
        later = rows[len(ready) :]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        yield from self.released(key[0], ready, watermark)
        moments = [int(later[0][0] * 1000)] if later else []
        own = self.next_timer()
        if own is not None:
            moments.append(own)
        if moments:
            self._set_timer(min(moments), timerValues)

    def _set_timer(self, moment: int, values) -> None:
        # A timer fires when the watermark is beyond it; a moment that has passed is due at once.
        watermark = values.getCurrentWatermarkInMs()
        self.handle.registerTimer(moment - 1 if moment - 1 > watermark else max(moment, watermark + 1) if moment > watermark else watermark)

    def close(self) -> None:
        pass


def _records(session: str, events: list[dict]) -> pd.DataFrame:
    columns = ["session_id", "call_id", "kind", "facet", "value", "confidence", "source"]
    return pd.DataFrame([{"session_id": session, **e} for e in events], columns=columns)


class LabelCalls(Buffered):
    """Advances a session call by call; closes its arc and forgets it when the watermark says that it has ended."""

    waiting_schema = f"at double, call_id string, workdir string, declared string, anchor boolean, candidates array<{VERDICT}>"

    def __init__(self, rules: SessionRules, reach_seconds: float | None) -> None:
        self.rules, self.reach = rules, reach_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.facets = handle.getMapState("facets", "facet string", "value string, confidence double, source string, call_id string")
        self.calls = handle.getListState("calls", f"at double, call_id string, workdir string, anchor boolean, closed boolean, verdicts array<{VERDICT}>")
        self.ends: int | None = None

    def waiting_row(self, row: dict) -> tuple:
        candidates = [tuple(c[k] for k in ("facet", "value", "confidence", "source")) for c in row["candidates"]]
        return float(row["at"]), row["call_id"], _text(row["workdir"]), _text(row["declared"]), bool(row["anchor"]), candidates

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A session that begins with facets from elsewhere (see ``read_facets``)."""
        for row in initialState.to_dict("records"):
            self.facets.updateValue((row["facet"],), (row["value"], float(row["confidence"]), row["source"], row["call_id"]))

    def next_timer(self) -> int | None:
        return self.ends

    def released(self, session: str, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        names = ("at", "call_id", "workdir", "anchor", "closed", "verdicts")
        history = [dict(zip(names, call)) | {"session_id": session, "verdicts": _verdicts(call[5])} for call in self.calls.get()]
        facets = {key[0]: {"facet": key[0], **dict(zip(("value", "confidence", "source", "call_id"), value))} for key, value in self.facets.iterator()}
        state, events = {"facets": facets, "history": history}, []
        for at, call_id, workdir, declared, anchor, candidates in rows:
            call = {"session_id": session, "call_id": call_id, "at": at, "workdir": workdir, "declared": declared, "anchor": anchor, "candidates": _verdicts(candidates)}
            events += fold.step(state, call, self.rules)
        last = int(state["history"][-1]["at"] * 1000) if state["history"] else watermark
        closes, ends = last + int(self.rules.arc_gap_minutes * 60_000) + 1, last + int(self.rules.gap_minutes * 60_000) + 1
        if watermark >= closes:
            events += fold.close(state, self.rules)
        if watermark >= max(closes, ends):
            self.calls.clear()
            self.facets.clear()
            self.ends = None
        else:
            fold.forget(state, self.rules, self.reach)
            pack = lambda verdicts: [tuple(v[k] for k in ("facet", "value", "confidence", "source")) for v in verdicts]
            kept = [(c["at"], c["call_id"], c["workdir"], c["anchor"], bool(c.get("closed")), pack(c["verdicts"])) for c in state["history"]]
            self.calls.put(kept) if kept else self.calls.clear()
            for facet in set(facets) - set(state["facets"]):
                self.facets.removeKey((facet,))
            for facet, held in state["facets"].items():
                self.facets.updateValue((facet,), (held["value"], held["confidence"], held["source"], held["call_id"]))
            self.ends = closes if watermark < closes else ends
        if events:
            yield _records(session, events)


def label_sessions(
    calls: DataFrame, rules: SessionRules = SessionRules(), watermark: str = "1 hour", classifiers=None, reach_minutes: float | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Online labels: verdicts with inheritance, back-propagation records, and revision records when an arc ends.

    An arc ends when a later call comes after the gap, or when the watermark passes its last call plus the gap; it is
    revised once. When the watermark passes the end of the session, its state is removed. ``reach_minutes`` bounds how far
    back a strong verdict acts, and with it the state of a session of weak calls; without it nothing bounds that, as in the
    batch job. ``initial``: facets (session_id, facet, value, confidence, source, call_id) that sessions begin with.
    An arc without an anchor is only reported here; ``silent_arc_labels`` labels it from its calls.
    """
    typed_state(calls.sparkSession)
    rows = prepared(calls, rules, classifiers).withWatermark("timestamp", watermark)
    work = LabelCalls(rules, None if reach_minutes is None else reach_minutes * 60)
    begun = initial.groupBy("session_id") if initial is not None else None
    return rows.groupBy("session_id").transformWithStateInPandas(work, RECORD, "Append", "EventTime", begun)


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """One state variable of a stream as of its last batch (session_id and the variable's fields), read from its checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    if "user_map_key" in rows.columns:
        return rows.select(F.col("key.session_id").alias("session_id"), "user_map_key.*", "user_map_value.*")
    value = F.col("list_element" if "list_element" in rows.columns else "value")
    return rows.select(F.col("key.session_id").alias("session_id"), value.alias("value")).select("session_id", "value.*")


def read_facets(spark: SparkSession, checkpoint: str, session: str | None = None) -> DataFrame:
    """What sessions carry along (of one session, if named): facet, value, confidence, source, call_id."""
    rows = read_state(spark, checkpoint, "facets")
    return rows if session is None else rows.filter(F.col("session_id") == session)


def silent_arc_labels(records: DataFrame, calls: DataFrame, rules: SessionRules = SessionRules(), classifiers=None) -> DataFrame:
    """Revision records for the arcs without an anchor that a stream has reported, from the logged calls of their sessions.
    A job over a batch of records, for ``foreachBatch`` or afterwards."""
    reported = records.filter("kind = 'arc-without-anchor'").select("session_id", F.concat_ws(":", "session_id", "call_id").alias("arc_id"))
    own = calls.join(reported.select("session_id").distinct(), "session_id", "left_semi")
    classified = classify_sessions(own, classifiers, rules)
    arcs = with_arcs(classified, rules.arc_gap_minutes).join(reported.select("arc_id").distinct(), "arc_id", "left_semi")
    revised = revise_by_text(arcs, arcs.drop("classifications", "pipeline_version", "reason", "is_new", "segment"), classifiers, rules)
    taken = revised.select("session_id", "call_id", F.lit("revision").alias("kind"), F.inline("_revised"))
    return taken.filter(F.startswith("source", F.lit(FROM_ARC))).select("session_id", "call_id", "kind", "facet", "value", "confidence", "source")


class RollingState(Buffered):
    """Cost, calls and fading tags of a session, one row out per turn."""

    waiting_schema = f"at double, call_id string, moment timestamp, cost string, verdicts array<{VERDICT}>"

    def __init__(self, expire_seconds: float) -> None:
        self.expire = expire_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.totals = handle.getValueState("totals", "last double, cost string, calls bigint")
        self.tags = handle.getValueState("tags", "held array<struct<value:string,confidence:double,turns_since_seen:int>>")
        self.ends: int | None = None

    def waiting_row(self, row: dict) -> tuple:
        verdicts = [tuple(v[k] for k in ("facet", "value", "confidence", "source")) for v in row["verdicts"]]
        return float(row["at"]), row["call_id"], row["timestamp"].to_pydatetime(), str(row["paid"]), verdicts

    def next_timer(self) -> int | None:
        return self.ends

    def released(self, session: str, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        last, cost, calls = tuple(self.totals.get()) if self.totals.exists() else (None, "0", 0)
        cost, out = Decimal(cost), []
        held = [dict(zip(("value", "confidence", "turns_since_seen"), t)) for t in self.tags.get()[0]] if self.tags.exists() else []
        for at, call_id, moment, paid, verdicts in rows:
            if last is not None and at - last > self.expire:
                cost, calls, held = Decimal(0), 0, []
            own = [v for v in _verdicts(verdicts) if v["value"] != "unknown"]
            ranked = sorted(own, key=lambda v: -v["confidence"])
            named = lambda facet: [v["value"] for v in ranked if v["facet"] == facet]
            held = fold.merge_turn(held, [v for v in own if v["facet"] == "tags"])
            last, cost, calls = at, cost + Decimal(paid), calls + 1
            first = {f: (named(f) or [None])[0] for f in ("context", "domain", "activity")}
            out.append({"session_id": session, "call_id": call_id, "updated_at": moment, "total_cost_usd": float(cost), "call_count": calls, **first, "project": named("project"), "tags": held})
        self.ends = int((last + self.expire) * 1000) + 1 if last is not None else None
        if self.ends is not None and watermark >= self.ends:
            self.totals.clear()
            self.tags.clear()
            self.ends = None
        elif out:
            self.totals.update((last, str(cost), calls))
            self.tags.update(([(t["value"], t["confidence"], t["turns_since_seen"]) for t in held],))
        if out:
            yield pd.DataFrame(out)


def session_state(turns: DataFrame, watermark: str = "1 hour", expire_minutes: float = 7 * 24 * 60) -> DataFrame:
    """Rolling state per session: cost, calls, own facets of the latest turn, fading tags. One row per turn. A session
    without a turn for ``expire_minutes`` begins anew, and its state is removed.

    ``turns``: session_id, call_id, timestamp, cost_usd, classifications.
    """
    typed_state(turns.sparkSession)
    slim = F.transform(
        "classifications", lambda c: F.struct(c["facet"].alias("facet"), c["value"].alias("value"), c["confidence"].alias("confidence"), c["source"].alias("source"))
    )
    # One struct, as column pruning loses plain columns between the generators of a classification and a keyed state.
    row = F.struct(
        "session_id", "call_id", "timestamp", (F.unix_micros("timestamp") / 1e6).alias("at"), F.col("cost_usd").cast("decimal(18,6)").cast("string").alias("paid"), slim.alias("verdicts"),
    )
    rows = bind(turns.filter("session_id is not null"), "_row", row).select("_row.*").withWatermark("timestamp", watermark)
    return rows.groupBy("session_id").transformWithStateInPandas(RollingState(expire_minutes * 60), SESSION_STATE, "Append", "EventTime")


def rollup(spend: DataFrame, every: str = "1 day", watermark: str = "1 hour", *dimensions: str) -> DataFrame:
    """Live cost per tumbling window and dimension; aggregated map-side before the shuffle."""
    windows = spend.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", every).alias("_w"), *dimensions)
    return windows.agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd")).select(
        F.col("_w.start").alias("window_start"), *dimensions, "calls", "cost_usd"
    )


def write_until_done(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over everything available now into a parquet folder, then stops."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").option("path", path).start().awaitTermination()


def upsert(batch: DataFrame, batch_id: int, path: str, keys: list[str], part: str) -> None:
    """Puts the rows of a micro-batch into a table that is partitioned by ``part``: rows with the same keys are replaced,
    other partitions are not touched, and of these only the ones that the batch has rows of are read.

    Each row keeps the number of the batch it comes from, and a partition is written as a whole, so a batch that is
    played again changes nothing: rows of its own number, and of later ones, stay as they are.
    """
    spark = batch.sparkSession
    new = batch.withColumn("_batch", F.lit(batch_id).cast("long"))
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], new.schema)
    touched = stage(new.select(part).distinct())
    rows = old.join(touched, part, "left_semi").unionByName(new)
    others = [c for c in new.columns if c not in keys]
    # Of two rows with the same keys the one of the later batch counts; of one batch number the stored one is the same row.
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row")).select(*keys, "_row.*")
    merged = stage(kept.select(*new.columns))
    merged.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def upsert_until_done(stream: DataFrame, path: str, checkpoint: str, keys: list[str], part: str) -> None:
    """Keeps a table of a stream's changing rows up to date: only rows that change leave the stream, and only the
    partitions they lie in are written. Stops when everything available now is in."""
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, number: upsert(batch, number, path, keys, part)).start().awaitTermination()


# --- upkeep of the log ---


def compact(spark: SparkSession, directory: str, target: str) -> None:
    """Daily JSON lines as monthly parquet. The rebalance hint sizes files from the data, splitting a hot month."""
    rows = spend_log.load_spend(spark, directory).withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    rows.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(target)


def flat_tags(rows: DataFrame) -> DataFrame:
    """Labels per call as flat text ``auto:<facet>:<value>``."""
    flat = lambda facet, values: F.transform(values, lambda v: F.concat(F.lit(f"auto:{facet}:"), v))
    from facetledger.operators.attribution import ALL_FACETS, facet_values

    return rows.select("call_id", F.concat(*[flat(f, facet_values(f)) for f in ALL_FACETS]).alias("labels"))


def retain(rows: DataFrame, oldest: date) -> DataFrame:
    """Rows not older than a day; a plain comparison the scan prunes on."""
    return rows.filter(F.col("timestamp") >= F.lit(f"{oldest} 00:00:00").cast("timestamp"))


def scrub_prompts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prompt_prefix", F.lit(""))
