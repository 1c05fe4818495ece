"""Raw API log: request and response bodies as JSON text, turned into calls with cost and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetledger.functions.pricing import estimate_cost
from facetledger.operators.classify import bind
from facetledger.schemas import GIT, MESSAGE, SIGNALS, TOOL_CALL
from facetledger.sources.spend_log import normalize_tokens
from facetledger.vocab import API_LOG_AGENT, SESSION_HEADERS, TRANSCRIPT_LENGTH, TRANSCRIPT_MARKERS, TRANSCRIPT_SKIP


def _array(value: Column) -> Column:
    return F.coalesce(value.try_cast("array<variant>"), F.array().cast("array<variant>"))


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _field(value: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def flatten_content(content: Column, separator: str = "\n", plain_items: bool = True) -> Column:
    """Text of a content field: the text itself, or its text blocks joined; empty for anything else."""
    text = lambda b: F.when(_is_text(b), b.try_cast("string") if plain_items else F.lit(None)).when(
        _field(b, "type") == "text", F.coalesce(_field(b, "text"), F.lit(""))
    )
    joined = F.array_join(F.filter(F.transform(_array(content), text), lambda t: t.isNotNull()), separator)
    return F.when(_is_text(content), content.try_cast("string")).otherwise(joined)


def is_transcript(text: Column) -> Column:
    """Whether a message hands a whole transcript to another agent: a marker, or very long."""
    marked = F.length(text) >= TRANSCRIPT_LENGTH
    for marker in TRANSCRIPT_MARKERS:
        marked = marked | F.contains(text, F.lit(marker))
    return marked


def latest_user_text(messages: Column) -> Column:
    """The last user message with text; null when there is none."""
    user = F.filter(_array(messages), lambda m: F.coalesce(_field(m, "role"), F.lit("user")) == "user")
    texts = F.filter(
        F.transform(user, lambda m: flatten_content(F.try_variant_get(m, "$.content", "variant"))),
        lambda t: F.regexp_like(F.coalesce(t, F.lit("")), F.lit(r"\S")),
    )
    return F.try_element_at(texts, F.lit(-1))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _line_after(text: Column, label: str) -> Column:
    found = F.regexp_extract(text, rf"(?md)^?{label}:\s*(.+?)$", 1)
    return F.nullif(_stripped(found), F.lit(""))


def environment(system: Column) -> Column:
    """Working directory and git context named in a system prompt, as a struct."""
    workdir = _line_after(system, "Primary working directory")
    name = F.substring_index(F.substring_index(F.regexp_replace(workdir, r"[/\\]+$", ""), "/", -1), "\\", -1)
    in_git = F.regexp_like(system, F.lit(r"(?i)Is a git repository:\s*true"))
    git = F.struct(name.alias("repo"), _line_after(system, "Current branch").alias("branch"), F.lit(None).cast("string").alias("ref"))
    return F.struct(workdir.alias("working_directory"), F.when(in_git, git).cast(GIT).alias("git_context"))


def tool_calls(content: Column) -> Column:
    """Tool-use blocks of a response's content."""
    blocks = F.filter(_array(content), lambda b: _field(b, "type") == "tool_use")
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.coalesce(_field(b, "name"), F.lit("")).alias("name"),
            F.coalesce(_field(b, "input", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("arguments"),
        ),
    ).cast(f"array<{TOOL_CALL}>")


def extract_calls(log: DataFrame) -> DataFrame:
    """Calls from log rows (``call_id``, ``timestamp``, ``request_body``, ``response_body``, ``headers``).

    Adds ``cost_usd``, ``usage``, ``prompt_text`` and ``classifier_error``. A transcript handed to another agent
    keeps its cost but has no messages. Rows that cannot be read keep a null session and are not dropped here.
    """
    rows = bind(log, "_request", F.try_parse_json("request_body"))
    rows = bind(rows, "_response", F.try_parse_json("response_body"))
    request, response = F.col("_request"), F.col("_response")
    rows = bind(rows, "_text", latest_user_text(F.try_variant_get(request, "$.messages", "variant")))
    system = flatten_content(F.try_variant_get(request, "$.system", "variant"), " ", plain_items=False)
    rows = bind(rows, "_env", environment(F.coalesce(system, F.lit(""))))
    usage = F.coalesce(_field(response, "usage", "map<string,string>"), F.create_map().cast("map<string,string>"))
    headers = F.from_json("headers", "map<string,string>")
    session = F.coalesce(*[F.nullif(F.element_at(headers, h), F.lit("")) for h in SESSION_HEADERS])
    usable = F.col("_text").isNotNull() & ~is_transcript(F.col("_text"))
    messages = F.when(usable, F.array(F.struct(F.lit("user").alias("role"), F.col("_text").alias("content"))))
    model = F.coalesce(_field(request, "model"), F.lit("unknown"))
    tokens = lambda name: F.coalesce(F.element_at(usage, name).try_cast("bigint"), F.lit(0))
    return rows.select(
        "call_id", session.alias("session_id"), "timestamp", F.lit(API_LOG_AGENT).alias("agent"), model.alias("model"),
        F.coalesce(messages, F.array().cast(f"array<{MESSAGE}>")).cast(f"array<{MESSAGE}>").alias("messages"),
        tool_calls(F.try_variant_get(response, "$.content", "variant")).alias("tool_calls"),
        F.create_map().cast("map<string,string>").alias("request_tags"),
        F.lit(None).cast("string").alias("team_alias"), F.lit(None).cast("string").alias("user_id"),
        F.col("_env.working_directory").alias("working_directory"), F.col("_env.git_context").alias("git_context"),
        F.struct(F.array().cast("array<string>").alias("hashtags"),
                 F.array().cast("array<struct<name:string,args:string>>").alias("commands")).cast(SIGNALS).alias("in_prompt"),
        estimate_cost(model, tokens("input_tokens"), tokens("output_tokens")).alias("cost_usd"),
        usage.alias("usage"),
        F.coalesce(F.when(usable, F.col("_text")), F.lit("")).alias("prompt_text"),
        F.when(~F.coalesce(usable, F.lit(False)), F.lit(TRANSCRIPT_SKIP)).alias("classifier_error"),
    )


def reassemble(events: DataFrame) -> DataFrame:
    """Responses put together from their streamed events (``request_id``, ``seq``, ``data``).

    Text pieces are joined per block, JSON pieces joined and parsed, usage merged with the latest value winning.
    One response is one bounded group: a model reply, not a data-size key.
    """
    parsed = bind(events.filter(F.startswith("data", F.lit("data: ")) & (F.trim("data") != "data: [DONE]")), "_e", F.try_parse_json(F.substr("data", F.lit(7))))
    event = F.col("_e")
    kind = _field(event, "type")
    rows = parsed.filter(event.isNotNull()).select(
        "request_id", "seq", kind.alias("type"), _field(event, "index", "int").alias("index"),
        F.try_variant_get(event, "$.content_block", "map<string,string>").alias("block"),
        _field(event, "delta.type").alias("delta_type"), _field(event, "delta.text").alias("text"),
        _field(event, "delta.partial_json").alias("json"),
        F.coalesce(
            F.when(kind == "message_start", _field(event, "message.usage", "map<string,string>")),
            F.when(kind == "message_delta", _field(event, "usage", "map<string,string>")),
        ).alias("usage"),
        F.when(kind == "message_start", _field(event, "message.model")).alias("model"),
        F.when(kind == "message_start", _field(event, "message.role")).alias("role"),
    )
    entry = F.struct("type", "index", "delta_type", "text", "json", "model", "role")
    pairs = lambda name: F.map_from_entries(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("seq", name))))
    grouped = rows.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", entry.alias("e")))).alias("events"),
        pairs("block").alias("starts"), pairs("usage").alias("usages"),
    )
    order = F.array_sort(F.map_keys("starts"))
    deltas = lambda i, what: F.array_join(
        F.transform(
            F.filter(
                "events",
                lambda x: (x["e"]["type"] == "content_block_delta") & (x["e"]["delta_type"] == what)
                & (F.coalesce(x["e"]["index"], F.size(F.filter(order, lambda s: s < x["seq"])) - 1) == i),
            ),
            lambda x: F.coalesce(x["e"]["text"] if what == "text_delta" else x["e"]["json"], F.lit("")),
        ),
        "",
    )
    content = F.transform(
        order,
        lambda s, i: F.struct(
            F.element_at(F.element_at("starts", s), "type").alias("type"),
            F.element_at(F.element_at("starts", s), "name").alias("name"),
            F.concat(F.coalesce(F.element_at(F.element_at("starts", s), "text"), F.lit("")), deltas(i, "text_delta")).alias("text"),
            F.when(
                deltas(i, "input_json_delta") != "",
                F.coalesce(F.from_json(deltas(i, "input_json_delta"), "map<string,string>"), F.create_map().cast("map<string,string>")),
            ).alias("input"),
        ),
    )
    merge = lambda old, seq: F.map_concat(
        F.map_filter(old, lambda k, _: ~F.map_contains_key(F.element_at("usages", seq), k)), F.element_at("usages", seq)
    )
    usage = F.aggregate(F.array_sort(F.map_keys("usages")), F.create_map().cast("map<string,string>"), merge)
    first = lambda name: F.get(F.filter(F.transform("events", lambda x: x["e"][name]), lambda v: v.isNotNull()), F.lit(0))
    return grouped.select("request_id", first("model").alias("model"), first("role").alias("role"), content.alias("content"), usage.alias("usage"))
