"""Domain tables derived from the supplied parquet tables.

The supplied tables hold no assistant calls, so line items stand for spend rows, conversations and events for
calls, and embeddings for taxonomy vectors. Every mapping is a projection: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetledger.runtime import use_utc
from facetledger.vocab import ACTIVITY_VALUES, TAG_KEYWORDS

SPEND_DOMAINS = ("engineering", "legal", "marketing", "finance", "unknown")
TAG_NAMES = tuple(TAG_KEYWORDS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    use_utc(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


FEW_SPLITS = 4


def spread(rows: DataFrame) -> DataFrame:
    """Spreads the scan of a table of a few splits over the cores. Such a table is some hundred megabytes at most, on any
    cluster; a larger one is left as it is. Pruned columns and filters still reach the scan."""
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = rows.rdd.getNumPartitions()
    return rows.repartition(cores) if splits <= FEW_SPLITS and splits * 2 < cores else rows


ROWS_A_TASK = 50_000


def evenly(rows: DataFrame) -> DataFrame:
    """Deals the rows of a narrow table to tasks of about ``ROWS_A_TASK`` rows, at least one a core, for work that costs far
    more than moving a row. A scan's own tasks follow the files' row groups, which may hold a million rows each."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))  # a count reads no column
    return rows.repartition(tasks)


def words(values) -> str:
    """A SQL array literal."""
    return "array(" + ",".join(f"'{v}'" for v in values) + ")"


def pick(values, index: str) -> str:
    return f"element_at({words(values)}, cast({index} + 1 as int))"


def scored(value: str, confidence: str) -> str:
    return f"named_struct('value', {value}, 'confidence', {confidence})"


SPEND_TIME = "timestampadd(MINUTE, cast((l_partkey * 7 + l_suppkey * 13) % 1440 as int), cast(l_shipdate as timestamp))"


def spend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend_from_items(load(spark, sf_dir, "lineitem"))


def spend_from_items(table: DataFrame) -> DataFrame:
    """Line items as spend-log rows, with nested facets, failures, missing facets and empty tag lists. A column ``utc_date``
    is kept."""
    tag_one = f"if(l_quantity % 4 <> 0, {scored(pick(TAG_NAMES, 'l_partkey % 10'), '0.8D')}, null)"
    tag_two = f"if(l_linenumber % 2 = 1, {scored(pick(TAG_NAMES, 'l_suppkey % 10'), '0.65D')}, null)"
    project_one = f"if(l_suppkey % 9 <> 0, {scored('''concat('proj-', l_suppkey % 40)''', '0.95D')}, null)"
    project_two = f"if(l_quantity > 25, {scored('''concat('proj-', l_partkey % 40)''', '0.9D')}, null)"
    context_value = pick(("business", "personal", "unknown"), "l_suppkey % 3")
    return table.selectExpr(
        *[c for c in table.columns if c == "utc_date"],
        "1 as schema_version",
        f"{SPEND_TIME} as timestamp",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as call_id",
        "if(l_partkey % 50 = 0, null, concat('s', l_orderkey)) as session_id",
        "concat('model-', l_linestatus, '-', l_suppkey % 3) as model",
        "concat('agent-', l_returnflag) as agent",
        "if(l_linenumber % 3 = 0, null, concat('v', l_linenumber % 3)) as pipeline_version",
        "cast(cast(l_extendedprice as decimal(18,2)) * cast(0.0001 as decimal(5,4)) as decimal(18,6)) as cost_usd",
        "named_struct('input', cast(l_quantity as bigint) * 100, 'output', cast(l_quantity as bigint) * 10, "
        "'cache_creation', cast(l_linenumber as bigint) * 5, "
        "'cache_read', cast(round(l_quantity * l_discount * 1000) as bigint)) as tokens",
        "if(l_linenumber = 7, null, named_struct("
        f"'context', if(l_partkey % 17 = 0, null, {scored(context_value, '0.85D')}), "
        f"'domain', {scored(pick(SPEND_DOMAINS, 'l_partkey % 5'), '0.8D')}, "
        f"'activity', {scored(pick(ACTIVITY_VALUES, 'l_partkey % 11'), '0.9D')}, "
        f"'project', filter(array({project_one}, {project_two}), p -> p is not null), "
        f"'tags', filter(array({tag_one}, {tag_two}), t -> t is not null))) as facets",
        "concat('Order ', l_orderkey, ' part ', l_partkey) as prompt_prefix",
        "if(l_linenumber = 7 and l_partkey % 5 <> 0, 'ValueError: bad input', null) as classifier_error",
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a time that leaves some gaps inside and some beyond the arc limit."""
    return load(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("session_id"),
        F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("call_id"),
        F.col("turn").alias("position"),
        "role",
        "text",
        F.expr(
            "timestampadd(MINUTE, cast(conv_id * 1440 + turn * 3 + pmod(turn * turn * 7 + conv_id, 11) as int), "
            "timestamp'2024-01-01 00:00:00')"
        ).alias("timestamp"),
    )


EVENT_BRANCHES = {
    "error": "concat('fix/LOG-', 10 + k)",
    "purchase": "concat('feat/checkout-', k)",
    "signup": "concat('docs/SIGN-', 100 + k)",
}


def _event_text() -> Column:
    """Prompt text from the event's own fields: some topical, some short replies, some bare."""
    return F.expr(
        "case when k % 5 = 0 then 'yes' "
        "when k % 5 = 1 then concat('refactor the ', event_type, ' function and fix the bug in the code') "
        "when k % 5 = 2 then concat('budget forecast for ', event_type, ' revenue and one invoice, ticket PAY-', 10 + k) "
        "when k % 5 = 3 then concat('find a flight, a hotel and a hotel recipe about ', event_type, ' please now') "
        "else concat('note ', event_type, ' ', k) end"
    )


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return calls_from_events(evenly(spark.read.parquet(f"{sf_dir}/events.parquet")))


def calls_from_events(table: DataFrame) -> DataFrame:
    """Events as calls: the user is the session, and the event fields give workdir, branch and prompt."""
    branch = "case event_type " + " ".join(f"when '{k}' then {v}" for k, v in EVENT_BRANCHES.items()) + " end"
    events = table.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return events.select(
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("call_id"),
        F.expr("if(user_id % 40 = 7, null, concat('u', user_id))").alias("session_id"),
        "timestamp",
        F.expr("if(value < 20, 'cli', 'ide')").alias("agent"),
        F.concat(F.lit("model-"), F.col("user_id") % 3).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), _event_text().alias("content"))).alias("messages"),
        F.expr(
            "if(k % 6 = 0, array(named_struct('name', 'Edit', 'arguments', "
            "map('file_path', concat('/a/', event_type, '_test.py')))), "
            "cast(array() as array<struct<name:string,arguments:map<string,string>>>))"
        ).alias("tool_calls"),
        F.expr(
            "case when event_id % 50 = 0 then map('project', concat('req-', k % 4)) "
            "when event_id % 23 = 1 then map('context', element_at(array('business', 'personal', 'unknown'), k % 3 + 1)) "
            "else cast(map() as map<string,string>) end"
        ).alias("request_tags"),
        F.expr("if(k % 9 = 0, concat('team-', user_id % 5), null)").alias("team_alias"),
        F.concat(F.lit("user-"), "user_id").alias("user_id"),
        F.expr(
            "case when user_id % 3 = 0 then '/home/u/repos/shop/' when user_id % 3 = 1 then '/home/u/taxes/y2024' "
            "when event_id % 97 = 0 then '/tmp/other' else '/tmp/plain' end"
        ).alias("working_directory"),
        F.expr(
            f"if(event_type = 'view', null, named_struct('repo', if(k % 4 = 0, concat('repo-', user_id % 7), "
            f"cast(null as string)), 'branch', {branch}, 'ref', cast(null as string)))"
        ).alias("git_context"),
        F.expr(
            "named_struct('hashtags', if(k % 25 = 0, array(concat('project:tagged-', user_id % 3), 'other'), "
            "cast(array() as array<string>)), 'commands', if(k % 33 = 0, "
            "array(named_struct('name', 'new-project', 'args', concat(' cmd-', user_id % 2, ' domain=x'))), "
            "cast(array() as array<struct<name:string,args:string>>)))"
        ).alias("in_prompt"),
        (F.round(F.col("value") * 100).cast("decimal(18,6)") / 10000).cast("decimal(18,6)").alias("cost_usd"),
    )


EVAL_SOURCES = ("yahoo-answers", "massive", "stackoverflow", "hh-rlhf-red-team", "dbpedia")
EVAL_TOPICS = ("Sports", "Health", "Society & Culture", "Business & Finance")
EVAL_SCENARIOS = ("music", "weather", "alarm", "cooking")
EVAL_LEVELS = ("Agent", "Event", "Work")
EVAL_TAGS = ("music", "sports", "fitness", "sensitive-topic", "engineering", "food", "news", "weather")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as gold annotations."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(load(spark, sf_dir, "labels"), "doc_id")
    tag = lambda name, when: f"if({when}, '{name}', null)"
    tags = ", ".join((
        tag("music", "doc_id % 3 = 0"), tag("sports", "doc_id % 4 = 1"), tag("sensitive-topic", "toxic = 1"),
        tag("engineering", "quality = 1 and doc_id % 2 = 0"), tag("food", "n_chars > 1500"),
    ))
    return joined.selectExpr(
        "concat('d', doc_id) as id",
        f"{pick(EVAL_SOURCES, 'doc_id % 5')} as source",
        "named_struct('context', if(quality = 1, 'business', 'personal'), "
        "'domain', case lang when 'en' then 'engineering' when 'fr' then 'marketing' when 'de' then 'finance' else 'unknown' end, "
        f"'activity', {pick(ACTIVITY_VALUES, 'doc_id % 11')}, "
        "'project', if(doc_id % 4 = 0, array('unknown'), array(concat('proj-', doc_id % 5))), "
        f"'tags', filter(array({tags}), t -> t is not null)) as facets",
        f"map('yahoo_topic', {pick(EVAL_TOPICS, 'doc_id % 4')}, 'massive_scenario', {pick(EVAL_SCENARIOS, 'doc_id % 4')}, "
        f"'dbpedia_l1', if(doc_id % 7 = 0, '', {pick(EVAL_LEVELS, 'doc_id % 3')})) as weak_labels",
        "named_struct('input', n_chars, 'output', doc_id % 50, 'cache_creation', if(doc_id % 2 = 0, doc_id % 9, null), "
        "'cache_read', n_chars % 100) as usage",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as predictions from their own text, with raw tag candidates."""
    raw = ", ".join(
        f"if((doc_id + n_chars * {i + 1}) % 3 = 0, named_struct('value', '{EVAL_TAGS[i % 8]}', 'confidence', "
        f"(15 + (doc_id * {i + 3} + n_chars) % 70) / 100.0D), null)"
        for i in range(14)
    )
    return load(spark, sf_dir, "documents").selectExpr(
        "concat('d', doc_id) as id",
        "named_struct('context', if(n_chars > 900, 'business', 'personal'), "
        "'domain', case when contains(text, 'the ') then 'engineering' when contains(text, ' ch') then 'finance' "
        "when contains(text, 'ou') then 'marketing' else 'unknown' end, "
        f"'activity', {pick(ACTIVITY_VALUES, '(doc_id - doc_id % 2) % 11')}, "
        "'project', if(n_chars % 3 = 0, array('unknown'), array(concat('proj-', doc_id % 5), concat('proj-', n_chars % 5))), "
        f"'tags', transform(slice(filter(array({raw}), t -> t is not null), 1, 5), t -> t.value)) as facets",
        f"filter(array({raw}), t -> t is not null) as raw",
        "text", "n_chars",
    )


def taxonomy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-level tree over the embedding labels; each node's vector is the unit mean of its members."""
    members = load(spark, sf_dir, "embeddings").select(
        F.posexplode("embedding").alias("pos", "x"),
        F.expr(
            "array(named_struct('id', concat('a', label % 2), 'parent_id', cast(null as string), 'ord', label % 2), "
            "named_struct('id', concat('a', label % 2, '/b', label % 4), 'parent_id', concat('a', label % 2), 'ord', label % 4), "
            "named_struct('id', concat('a', label % 2, '/b', label % 4, '/c', label), "
            "'parent_id', concat('a', label % 2, '/b', label % 4), 'ord', label))"
        ).alias("levels"),
    )
    sums = members.select("pos", "x", F.inline("levels")).groupBy("id", "parent_id", "ord", "pos").agg(
        F.avg(F.col("x").cast("double")).alias("m")
    )
    means = sums.groupBy("id", "parent_id", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e["m"] * e["m"]))
    return means.select(
        "id", "parent_id", F.element_at(F.split("id", "/"), -1).alias("label"), F.lit("").alias("description"),
        F.col("ord").cast("int").alias("ord"), F.transform("v", lambda e: e["m"] / norm).alias("vector"),
    )
