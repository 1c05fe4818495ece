"""Chat exports: message trees and flat message lists as calls, and the sink for a classified corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetledger.operators.scan import CHUNK, ROW, in_order, next_value
from facetledger.schemas import MESSAGE

TREE = (
    "conversation_id string, id string, current_node string, mapping map<string,struct<parent:string,"
    "message:struct<id:string,author:struct<role:string>,content:struct<parts:array<variant>>,create_time:double,"
    "metadata:struct<model_slug:string>>>>"
)
FLAT = "uuid string, chat_messages array<struct<uuid:string,sender:string,text:string,created_at:string>>"


def read_tree_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(TREE).json(path)


def read_flat_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(FLAT).json(path)


def branch_to(mapping: Column, current: Column) -> Column:
    """Messages from the root to the current node, following parent pointers inside the conversation's own row."""
    step = lambda s, _: F.struct(
        F.when(F.map_contains_key(mapping, s["node"]), F.element_at(mapping, s["node"])["parent"]).alias("node"),
        F.when(F.map_contains_key(mapping, s["node"]), F.concat(F.array(s["node"]), s["path"])).otherwise(s["path"]).alias("path"),
    )
    start = F.struct(current.alias("node"), F.array().cast("array<string>").alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.size(mapping)), start, step, lambda s: s["path"])
    messages = F.transform(path, lambda node: F.element_at(mapping, node)["message"])
    return F.filter(messages, lambda m: m.isNotNull())


def tree_turns(export: DataFrame) -> DataFrame:
    """All messages of the current branch in order: one row per message."""
    usable = export.filter((F.size("mapping") > 0) & F.col("current_node").isNotNull())
    ordered = usable.select(
        F.coalesce("conversation_id", "id").alias("session_id"),
        F.posexplode(branch_to(F.col("mapping"), F.col("current_node"))).alias("position", "m"),
    )
    texts = F.transform(
        F.filter("m.content.parts", lambda p: F.schema_of_variant(p) == "STRING"), lambda p: p.try_cast("string")
    )
    return ordered.select(
        "session_id", "position", F.col("m.id").alias("call_id"), F.col("m.author.role").alias("role"),
        F.regexp_replace(F.coalesce(F.array_join(texts, " "), F.lit("")), r"^\s+|\s+$", "").alias("text"),
        F.timestamp_seconds("m.create_time").alias("timestamp"),
        F.coalesce(F.nullif(F.col("m.metadata.model_slug"), F.lit("")), F.lit("chatgpt")).alias("model"),
    )


def _calls(turns: DataFrame, agent: str) -> DataFrame:
    message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    return turns.select(
        "call_id", "session_id", "timestamp", F.lit(agent).alias("agent"), "model",
        F.array(message).cast(f"array<{MESSAGE}>").alias("messages"),
    )


def tree_export_calls(export: DataFrame) -> DataFrame:
    """User turns with text and time, as calls."""
    return _calls(tree_turns(export).filter("role = 'user' and text <> '' and timestamp is not null"), "chatgpt")


def flat_export_calls(export: DataFrame) -> DataFrame:
    """Human turns with text, as calls."""
    turns = export.select(F.col("uuid").alias("session_id"), F.inline("chat_messages")).select(
        "session_id", F.col("uuid").alias("call_id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("text"),
        "sender", F.try_to_timestamp("created_at").alias("timestamp"), F.lit("claude").alias("model"),
    )
    return _calls(turns.filter("sender = 'human' and text <> ''"), "claude.ai")


def with_replies(turns: DataFrame, snippet: int = 200) -> DataFrame:
    """User turns with the start of the next assistant reply, if one comes before the next user turn.

    ``turns``: session_id, position, call_id, role, text, timestamp and any other columns.
    """
    speaks = F.when(F.col("role").isin("user", "assistant"), F.struct("role", F.substring("text", 1, snippet).alias("text")))
    rows = in_order(turns, ["session_id"], ["position", "call_id"])
    paired = next_value(rows, ["session_id"], {"_next": speaks}).drop(CHUNK, ROW)
    reply = F.when(F.col("_next.role") == "assistant", F.nullif(F.col("_next.text"), F.lit("")))
    return paired.filter("role = 'user'").withColumn("reply", reply).drop("_next")


def with_reply_messages(turns: DataFrame, snippet: int = 200) -> DataFrame:
    """User turns as calls whose messages are the prompt and, where there is one, the reply's start."""
    user = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    reply = F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content"))
    messages = F.when(F.col("reply").isNull(), F.array(user)).otherwise(F.array(user, reply))
    return with_replies(turns, snippet).withColumn("messages", messages.cast(f"array<{MESSAGE}>"))


def corpus_records(final: DataFrame, calls: DataFrame, snippet: int = 200) -> DataFrame:
    """Final verdicts per call as they are kept: with the start of the call's first message, confidences to three digits."""
    first = F.coalesce(F.get("messages", F.lit(0))["content"], F.lit(""))
    texts = calls.select("call_id", F.substring(first, 1, snippet).alias("text")).groupBy("call_id").agg(F.min("text").alias("text"))
    verdicts = F.transform(
        "classifications", lambda c: F.struct(c["facet"].alias("facet"), c["value"].alias("value"), F.bround(c["confidence"], 3).alias("confidence"), c["source"].alias("source"))
    )
    kept = [c for c in final.columns if c != "classifications"]
    return final.join(texts, "call_id", "left").select(*kept, "text", verdicts.alias("classifications"))


def write_corpus(final: DataFrame, meta: DataFrame, path: str, calls: DataFrame) -> None:
    """Final verdicts per call, and one row about the run, as JSON."""
    corpus_records(final, calls).write.mode("overwrite").json(f"{path}/records")
    meta.write.mode("overwrite").json(f"{path}/meta")


def corpus_calls(samples: DataFrame, agent: str = "eval") -> DataFrame:
    """Samples (``id``, ``text``) as calls of one user message."""
    message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    return samples.select(
        F.col("id").alias("call_id"), F.lit(None).cast("string").alias("session_id"), F.lit(agent).alias("agent"),
        F.array(message).cast(f"array<{MESSAGE}>").alias("messages"),
    )
