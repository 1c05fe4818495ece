"""Classifier quality over labelled documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetledger.operators import classify as cl
from facetledger.operators import evaluation as ev
from facetledger.operators import resolve as rs
from facetledger.plans.cost_queries import sql_list
from facetledger.plans.label_queries import LANGUAGE_WORDS
from facetledger.plans.registry import plain, query
from facetledger.runtime import checkpoint_dir
from facetledger.sources.tables import (
    EVAL_LEVELS, EVAL_SCENARIOS, EVAL_SOURCES, EVAL_TAGS, EVAL_TOPICS, annotations, load, predictions,
)
from facetledger.vocab import ACTIVITY_VALUES, FORUM_TOPIC_TAGS, L1_LEAVES, SCENARIO_DOMAIN, SCENARIO_TAGS, TOPIC_GROUPS, WEAK_SCENARIO_TAGS

RAW = ", ".join(
    f"CASE WHEN (doc_id + n_chars * {i + 1}) % 3 = 0 THEN {{'value': '{EVAL_TAGS[i % 8]}', 'confidence': "
    f"CAST(15 + (doc_id * {i + 3} + n_chars) % 70 AS DOUBLE) / 100.0::DOUBLE, 'ord': {i}}} END"
    for i in range(14)
)


def at_index(values, index: str) -> str:
    return f"{sql_list(values)}[CAST({index} + 1 AS INT)]"


EVAL_CTE = f"""
WITH ann AS (
  SELECT concat('d', doc_id) AS id, doc_id, n_chars, {at_index(EVAL_SOURCES, 'doc_id % 5')} AS source,
    CASE WHEN quality = 1 THEN 'business' ELSE 'personal' END AS context,
    CASE lang WHEN 'en' THEN 'engineering' WHEN 'fr' THEN 'marketing' WHEN 'de' THEN 'finance' ELSE 'unknown' END AS domain,
    {at_index(ACTIVITY_VALUES, 'doc_id % 11')} AS activity,
    CASE WHEN doc_id % 4 = 0 THEN ['unknown'] ELSE [concat('proj-', doc_id % 5)] END AS project,
    list_filter([CASE WHEN doc_id % 3 = 0 THEN 'music' END, CASE WHEN doc_id % 4 = 1 THEN 'sports' END,
      CASE WHEN toxic = 1 THEN 'sensitive-topic' END, CASE WHEN quality = 1 AND doc_id % 2 = 0 THEN 'engineering' END,
      CASE WHEN n_chars > 1500 THEN 'food' END], lambda t: t IS NOT NULL) AS tags,
    {at_index(EVAL_TOPICS, 'doc_id % 4')} AS topic, {at_index(EVAL_SCENARIOS, 'doc_id % 4')} AS scenario,
    CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE {at_index(EVAL_LEVELS, 'doc_id % 3')} END AS l1
  FROM documents JOIN labels USING (doc_id)
), pred AS (
  SELECT concat('d', doc_id) AS id, CASE WHEN n_chars > 900 THEN 'business' ELSE 'personal' END AS context,
    CASE WHEN contains(text, 'the ') THEN 'engineering' WHEN contains(text, ' ch') THEN 'finance'
      WHEN contains(text, 'ou') THEN 'marketing' ELSE 'unknown' END AS domain,
    {at_index(ACTIVITY_VALUES, '(doc_id - doc_id % 2) % 11')} AS activity,
    CASE WHEN n_chars % 3 = 0 THEN ['unknown'] ELSE list_distinct([concat('proj-', doc_id % 5), concat('proj-', n_chars % 5)]) END AS project,
    list_filter([{RAW}], lambda t: t IS NOT NULL) AS raw, text, n_chars
  FROM documents
), j AS (
  SELECT a.id, a.doc_id, a.source, a.topic, a.scenario, a.l1, a.context AS g_context, p.context AS p_context, a.domain AS g_domain,
    p.domain AS p_domain, a.activity AS g_activity, p.activity AS p_activity,
    list_filter(a.project, lambda x: x <> 'unknown') AS g_project, list_filter(p.project, lambda x: x <> 'unknown') AS p_project,
    a.tags AS g_tags, list_filter(list_transform(p.raw[1:5], lambda t: t.value),
      lambda v, i: list_position(list_transform(p.raw[1:5], lambda t: t.value), v) = i) AS p_tags, p.raw, p.text
  FROM ann a JOIN pred p ON a.id = p.id
)
"""


def joined(spark, sf_dir):
    return ev.gold_with_predictions(annotations(spark, sf_dir), predictions(spark, sf_dir))


def pr_sql(extra: str = "") -> str:
    return (
        "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, "
        "round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall" + extra
    )


F1 = "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1"


@query(
    "binary_metrics",
    f"{EVAL_CTE}, c AS (SELECT source, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, "
    "count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn FROM "
    "(SELECT source, g_context = 'business' AS g, p_context = 'business' AS p FROM j) GROUP BY 1) "
    f"SELECT source, tp, fp, fn, tn, {pr_sql()}, {F1}, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c",
)
def binary_metrics(spark, sf_dir):
    rows = joined(spark, sf_dir)
    return plain(
        ev.binary_metrics(rows, F.col("gold.context") == "business", F.col("pred.context") == "business", "source")
    )


@query("confusion", f"{EVAL_CTE} SELECT g_domain AS gold, p_domain AS pred, count(*) AS n FROM j GROUP BY ALL")
def confusion(spark, sf_dir):
    return ev.confusion(joined(spark, sf_dir), "gold.domain", "pred.domain")


CLASSES = f"""{EVAL_CTE}, c AS (SELECT label, sum(CASE WHEN g = label AND p = label THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN g <> label AND p = label THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN g = label AND p <> label THEN 1 ELSE 0 END) AS fn
  FROM (SELECT DISTINCT unnest([g_domain, p_domain]) AS label FROM j) l, (SELECT g_domain AS g, p_domain AS p FROM j) r GROUP BY 1)"""


@query("multiclass", f"{CLASSES} SELECT label, {pr_sql()}, CAST(tp + fn AS BIGINT) AS support FROM c")
def multiclass(spark, sf_dir):
    return plain(ev.multiclass(joined(spark, sf_dir), "gold.domain", "pred.domain"))


@query(
    "scalar_facet_metrics",
    f"{CLASSES}, m AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM c) "
    "SELECT CAST(sum(tp + fn) AS BIGINT) AS n, round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(sum(tp) / sum(tp + fp), 6) AS micro_precision, "
    "round(sum(tp) / sum(tp + fn), 6) AS micro_recall, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, "
    "round(avg(f1) FILTER (WHERE tp + fn > 0), 6) AS macro_f1 FROM m",
)
def scalar_facet_metrics(spark, sf_dir):
    return plain(ev.scalar_metrics(joined(spark, sf_dir), "gold.domain", "pred.domain"))


@query(
    "facet_metrics_by_source",
    f"""{EVAL_CTE}, e AS (SELECT unnest(['(all)', source]) AS slice, f AS facet,
    CASE f WHEN 'context' THEN g_context WHEN 'domain' THEN g_domain ELSE g_activity END AS g,
    CASE f WHEN 'context' THEN p_context WHEN 'domain' THEN p_domain ELSE p_activity END AS p
  FROM j, (VALUES ('context'), ('domain'), ('activity')) v(f)),
l AS (SELECT slice, facet, unnest(list_distinct([g, p])) AS label, g, p FROM e),
c AS (SELECT slice, facet, label, count(*) FILTER (WHERE g = label AND p = label) AS tp, count(*) FILTER (WHERE g <> label AND p = label) AS fp,
  count(*) FILTER (WHERE g = label AND p <> label) AS fn FROM l GROUP BY ALL),
m AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM c)
SELECT slice, facet, CAST(sum(tp + fn) AS BIGINT) AS n, round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(sum(tp) / sum(tp + fp), 6) AS micro_precision,
  round(sum(tp) / sum(tp + fn), 6) AS micro_recall,
  round(CASE WHEN sum(tp) = 0 THEN 0.0 ELSE 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END, 6) AS micro_f1,
  round(coalesce(avg(f1) FILTER (WHERE tp + fn > 0), 0), 6) AS macro_f1 FROM m GROUP BY ALL""",
)
def facet_metrics_by_source(spark, sf_dir):
    return plain(ev.facet_slices(joined(spark, sf_dir)))


SET_SCORES = """
  len(list_intersect(g, p))::DOUBLE AS i, len(g) AS ng, len(p) AS np, len(list_distinct(list_concat(g, p))) AS nu
"""
SET_AGG = """
  avg(CASE WHEN np > 0 THEN i / np WHEN ng = 0 THEN 1.0 ELSE 0.0 END) AS {0}precision,
  avg(CASE WHEN ng > 0 THEN i / ng WHEN np = 0 THEN 1.0 ELSE 0.0 END) AS {0}recall,
  avg(CASE WHEN ng = 0 AND np = 0 THEN 1.0 WHEN i = 0 THEN 0.0 ELSE 2 * (i / np) * (i / ng) / (i / np + i / ng) END) AS {0}f1,
  avg(CASE WHEN nu > 0 THEN i / nu ELSE 1.0 END) AS {0}jaccard
"""


@query(
    "set_metrics",
    f"{EVAL_CTE}, s AS (SELECT {SET_SCORES} FROM (SELECT g_tags AS g, p_tags AS p FROM j)) "
    "SELECT n, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1, "
    f"round(macro_jaccard, 6) AS macro_jaccard FROM (SELECT count(*) AS n, {SET_AGG.format('macro_')} FROM s)",
)
def set_metrics(spark, sf_dir):
    return plain(ev.set_metrics(joined(spark, sf_dir), "gold.tags", "pred.tags"))


@query(
    "set_metrics_project",
    f"{EVAL_CTE}, s AS (SELECT source, {SET_SCORES} FROM (SELECT source, g_project AS g, p_project AS p FROM j)) "
    "SELECT source, n, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1, "
    f"round(macro_jaccard, 6) AS macro_jaccard FROM (SELECT source, count(*) AS n, {SET_AGG.format('macro_')} FROM s GROUP BY 1)",
)
def set_metrics_project(spark, sf_dir):
    return plain(ev.set_metrics(joined(spark, sf_dir), "gold.project", "pred.project", "source"))


LABELS = f"""{EVAL_CTE}, l AS (SELECT unnest(list_distinct(list_concat(g_tags, p_tags))) AS label, g_tags, p_tags FROM j),
c AS (SELECT label, count(*) FILTER (WHERE list_contains(g_tags, label) AND list_contains(p_tags, label)) AS tp,
  count(*) FILTER (WHERE NOT list_contains(g_tags, label)) AS fp, count(*) FILTER (WHERE NOT list_contains(p_tags, label)) AS fn FROM l GROUP BY 1)"""


@query("label_metrics", f"{LABELS} SELECT label, tp, fp, fn, {pr_sql()}, {F1}, tp + fn AS support FROM c")
def label_metrics(spark, sf_dir):
    return plain(ev.label_metrics(joined(spark, sf_dir), "gold.tags", "pred.tags"))


@query("labels_by_support", f"{LABELS} SELECT label, {pr_sql()}, tp + fn AS support FROM c ORDER BY support DESC, label LIMIT 4")
def labels_by_support(spark, sf_dir):
    labels = ev.label_metrics(joined(spark, sf_dir), "gold.tags", "pred.tags")
    return plain(ev.labels_by_support(labels.select("label", "precision", "recall", "support"), 4))


@query(
    "top_k_accuracy",
    f"{EVAL_CTE} SELECT count(*) AS n, round(avg(CASE WHEN list_contains(p_tags[1:2], CASE WHEN len(g_tags) > 0 THEN g_tags[1] ELSE 'none' END) "
    "THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM j",
)
def top_k_accuracy(spark, sf_dir):
    rows = joined(spark, sf_dir).select(
        F.coalesce(F.get("gold.tags", F.lit(0)), F.lit("none")).alias("g"), F.array_distinct("pred.tags").alias("ranked")
    )
    return plain(ev.top_k_accuracy(rows, "g", "ranked", 2))


def crosswalk_case(crosswalk, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in crosswalk.items() if v) + " END"


@query(
    "crosswalk_top_k",
    f"{EVAL_CTE}, h AS (SELECT coalesce(list_has_any(p_tags[1:3], {crosswalk_case(L1_LEAVES, 'l1')}), FALSE) AS hit FROM j) "
    "SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 6) AS rate FROM h",
)
def crosswalk_top_k(spark, sf_dir):
    docs = annotations(spark, sf_dir).select("id", "weak_labels")
    rows = joined(spark, sf_dir).join(docs, "id").withColumn("ranked", F.array_distinct("pred.tags"))
    accepted = ev.accepted_labels(L1_LEAVES, F.col("weak_labels")["dbpedia_l1"])
    return plain(ev.crosswalk_hits(rows, accepted, "ranked", 3))


@query(
    "crosswalk_accuracy",
    f"{EVAL_CTE} SELECT count(*) AS n, count(*) FILTER (WHERE g = p_domain) AS correct, round(count(*) FILTER (WHERE g = p_domain) / count(*), 6) AS accuracy "
    "FROM (SELECT CASE scenario WHEN 'iot' THEN 'engineering' ELSE 'unknown' END AS g, p_domain FROM j)",
)
def crosswalk_accuracy(spark, sf_dir):
    docs = annotations(spark, sf_dir).select("id", "weak_labels")
    mapping = F.create_map(*[F.lit(x) for pair in SCENARIO_DOMAIN.items() for x in pair])
    rows = joined(spark, sf_dir).join(docs, "id").select(
        F.coalesce(F.element_at(mapping, F.col("weak_labels")["massive_scenario"]), F.lit("unknown")).alias("g"),
        F.col("pred.domain").alias("p"),
    )
    return plain(ev.accuracy(rows, "g", "p"))


@query(
    "group_fired_recall",
    f"{EVAL_CTE}, c AS (SELECT count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, "
    "count(*) FILTER (WHERE NOT g AND NOT p) AS tn FROM (SELECT list_has_any(g_tags, ['music','sports']) AS g, "
    "len(list_filter(raw, lambda t: t.value IN ('music','sports'))) > 0 AS p FROM j)) "
    f"SELECT tp, fp, fn, tn, {pr_sql()}, {F1}, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c",
)
def group_fired_recall(spark, sf_dir):
    groups = F.array(F.lit("music"), F.lit("sports"))
    gold = F.arrays_overlap("gold.tags", groups)
    return plain(ev.binary_metrics(joined(spark, sf_dir), gold, ev.fired(F.col("raw"), groups)))


def group_sql(topic: str, groups) -> str:
    """Counts per group: rows whose topic belongs to it against rows where it fired."""
    names = sorted({t for tags in groups.values() for t in tags})
    own = " ".join(f"WHEN '{name}' THEN {sql_list(tags)}" for name, tags in groups.items() if tags)
    return (
        f"{EVAL_CTE}, x AS (SELECT coalesce(CASE {topic} {own} END, []) AS own, list_transform(raw, lambda t: t.value) AS fired FROM j JOIN ann USING (id)), "
        f"g AS (SELECT unnest({sql_list(names)}) AS \"group\"), c AS (SELECT \"group\", count(*) FILTER (WHERE list_contains(own, \"group\") AND list_contains(fired, \"group\")) AS tp, "
        "count(*) FILTER (WHERE NOT list_contains(own, \"group\") AND list_contains(fired, \"group\")) AS fp, count(*) FILTER (WHERE list_contains(own, \"group\") AND NOT list_contains(fired, \"group\")) AS fn, "
        "count(*) FILTER (WHERE NOT list_contains(own, \"group\") AND NOT list_contains(fired, \"group\")) AS tn FROM x, g GROUP BY 1) "
        "SELECT *, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall FROM c"
    )


def group_rows(spark, sf_dir):
    return joined(spark, sf_dir).join(annotations(spark, sf_dir).select("id", "weak_labels"), "id")


@query("topic_group_recall", group_sql("ann.topic", TOPIC_GROUPS))
def topic_group_recall(spark, sf_dir):
    return plain(ev.group_recall(group_rows(spark, sf_dir), F.col("weak_labels")["yahoo_topic"], F.col("raw"), TOPIC_GROUPS))


@query("scenario_group_recall", group_sql("ann.scenario", SCENARIO_TAGS))
def scenario_group_recall(spark, sf_dir):
    return plain(ev.group_recall(group_rows(spark, sf_dir), F.col("weak_labels")["massive_scenario"], F.col("raw"), SCENARIO_TAGS))


@query(
    "positives_and_negatives",
    f"{EVAL_CTE}, c AS (SELECT count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, "
    "count(*) FILTER (WHERE NOT g AND NOT p) AS tn FROM (SELECT source = 'hh-rlhf-red-team' AS g, "
    "list_contains(p_tags, 'sensitive-topic') AS p FROM j WHERE source IN ('hh-rlhf-red-team', 'massive'))) "
    f"SELECT tp, fp, fn, tn, {pr_sql()}, {F1}, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c",
)
def positives_and_negatives(spark, sf_dir):
    rows = joined(spark, sf_dir)
    positives = rows.filter(F.col("source") == "hh-rlhf-red-team").withColumn("g", F.lit(True))
    negatives = rows.filter(F.col("source") == "massive").withColumn("g", F.lit(False))
    both = positives.unionByName(negatives)
    return plain(ev.binary_metrics(both, F.col("g"), F.array_contains("pred.tags", "sensitive-topic")))


@query(
    "kappa",
    f"{EVAL_CTE}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE g_domain = p_domain) / count(*) AS po FROM j), "
    "a AS (SELECT g_domain AS k, count(*) AS c FROM j GROUP BY 1), b AS (SELECT p_domain AS k, count(*) AS c FROM j GROUP BY 1), "
    "e AS (SELECT CAST(sum(a.c * b.c) AS DOUBLE) AS s FROM a JOIN b USING (k)) "
    "SELECT n, round(po, 6) AS observed, round(s / (n * n), 6) AS expected, round((po - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, e",
)
def kappa(spark, sf_dir):
    return plain(ev.cohens_kappa(joined(spark, sf_dir), "gold.domain", "pred.domain"))


WILSON_SQL = """round(greatest(0.0, (p + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4.0 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS ci_low,
  round(least(1.0, (p + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4.0 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS ci_high"""


@query(
    "wilson",
    f"{EVAL_CTE}, s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE g_domain = p_domain) AS correct FROM j GROUP BY 1) "
    f"SELECT source, n, correct, {WILSON_SQL} FROM (SELECT *, correct / n AS p FROM s)",
)
def wilson(spark, sf_dir):
    per_source = ev.accuracy(joined(spark, sf_dir), "gold.domain", "pred.domain", "source")
    bounds = ev.wilson_bounds(F.col("correct"), F.col("n"))
    return plain(per_source.select("source", "n", "correct", bounds["low"].alias("ci_low"), bounds["high"].alias("ci_high")))


@query(
    "target_summary",
    f"{EVAL_CTE}, s AS (SELECT source AS test, count(*) AS n, count(*) FILTER (WHERE g_domain = p_domain) / count(*) AS v FROM j "
    "WHERE source IN ('massive', 'dbpedia', 'stackoverflow') GROUP BY 1), t AS (SELECT *, CASE test WHEN 'massive' THEN 0.6::DOUBLE WHEN 'dbpedia' THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END AS target, "
    "round_even(v * n, 0) / n AS p FROM s) SELECT test, n, round(v, 6) AS value, target, "
    f"{WILSON_SQL}, CASE WHEN (test <> 'stackoverflow' AND v >= target) OR (test = 'stackoverflow' AND v <= target) THEN 'PASS' ELSE 'FAIL' END AS status FROM t",
)
def target_summary(spark, sf_dir):
    metrics = ev.accuracy(joined(spark, sf_dir), "gold.domain", "pred.domain", "source")
    named = metrics.select(F.col("source").alias("test"), "n", F.col("accuracy").alias("value"))
    return plain(ev.against_targets(named, {"massive": (0.6, True), "dbpedia": (0.4, True), "stackoverflow": (0.05, False)}))


@query(
    "threshold_sweep",
    f"""{EVAL_CTE}, grid AS (SELECT s.s AS sim, t.t AS top_n FROM
  (SELECT unnest([0.20::DOUBLE, 0.25, 0.27, 0.30, 0.33, 0.35, 0.40]) AS s) s, (SELECT unnest([5, 7, 10]) AS t) t),
tag AS (SELECT sim, top_n, id, r.value AS value, max(r.confidence) AS conf, min(-r.confidence * 1000 + r.ord / 1000.0::DOUBLE) AS o
  FROM grid, (SELECT id, unnest(raw) AS r FROM j) WHERE r.confidence >= sim GROUP BY ALL),
top AS (SELECT sim, top_n, id, list(value) AS p FROM (SELECT * FROM tag QUALIFY row_number() OVER (PARTITION BY sim, top_n, id ORDER BY o) <= top_n) GROUP BY ALL),
e AS (SELECT grid.sim, grid.top_n, j.id, j.g_tags AS g, coalesce(top.p, []::VARCHAR[]) AS p FROM j CROSS JOIN grid LEFT JOIN top ON top.sim = grid.sim AND top.top_n = grid.top_n AND top.id = j.id),
s AS (SELECT sim, top_n, {SET_SCORES} FROM e),
a AS (SELECT sim, top_n, count(*) AS n, {SET_AGG.format('per_sample_')}, avg(np) AS avg_tags_per_sample, avg(CASE WHEN np > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS pct_with_tags,
  avg(CASE WHEN np >= top_n THEN 1.0::DOUBLE ELSE 0.0 END) AS pct_capped_at_topn FROM s GROUP BY ALL),
l AS (SELECT sim, top_n, unnest(list_distinct(list_concat(g, p))) AS label, g, p FROM e),
c AS (SELECT sim, top_n, label, count(*) FILTER (WHERE list_contains(g, label) AND list_contains(p, label)) AS tp,
  count(*) FILTER (WHERE NOT list_contains(g, label)) AS fp, count(*) FILTER (WHERE NOT list_contains(p, label)) AS fn FROM l GROUP BY ALL),
m AS (SELECT sim, top_n, avg(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END) AS mp, avg(tp / (tp + fn)) AS mr,
  avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END) AS mf, count(*) AS k FROM c WHERE tp + fn > 0 GROUP BY ALL)
SELECT sim, top_n, n, round(per_sample_precision, 6) AS per_sample_precision, round(per_sample_recall, 6) AS per_sample_recall,
  round(per_sample_f1, 6) AS per_sample_f1, round(per_sample_jaccard, 6) AS per_sample_jaccard, round(avg_tags_per_sample, 6) AS avg_tags_per_sample,
  round(pct_with_tags, 6) AS pct_with_tags, round(pct_capped_at_topn, 6) AS pct_capped_at_topn, round(mp, 6) AS macro_label_precision,
  round(mr, 6) AS macro_label_recall, round(mf, 6) AS macro_label_f1, k AS labels_with_support FROM a JOIN m USING (sim, top_n)""",
)
def threshold_sweep(spark, sf_dir):
    rows = joined(spark, sf_dir).select(F.col("gold.tags").alias("gold_tags"), "raw")
    return plain(ev.threshold_sweep(rows, "gold_tags", "raw"))


@query(
    "top_confusions",
    f"{EVAL_CTE} SELECT g_domain AS gold, p_domain AS pred, count(*) AS n FROM j WHERE g_domain <> p_domain GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 5",
)
def top_confusions(spark, sf_dir):
    return ev.top_confusions(ev.confusion(joined(spark, sf_dir), "gold.domain", "pred.domain"), 5)


@query(
    "miss_samples",
    f"{EVAL_CTE}, t AS (SELECT *, replace(text, chr(10), ' ') AS flat FROM j) SELECT id, g_domain AS gold, p_domain AS pred, "
    "CASE WHEN length(flat) > 200 THEN concat(left(flat, 200), '…') ELSE flat END AS text "
    "FROM t WHERE g_domain <> p_domain ORDER BY id LIMIT 20",
)
def miss_samples(spark, sf_dir):
    texts = predictions(spark, sf_dir).select("id", "text")
    rows = joined(spark, sf_dir).join(texts, "id")
    found = ev.example_samples(rows, F.col("gold.domain") != F.col("pred.domain"))
    return found.select("id", F.col("gold.domain").alias("gold"), F.col("pred.domain").alias("pred"), "text")


@query(
    "facet_distributions",
    f"{EVAL_CTE}, v AS (SELECT 'context' AS facet, context AS value FROM ann UNION ALL SELECT 'domain', domain FROM ann UNION ALL SELECT 'activity', activity FROM ann) "
    "SELECT facet, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM ann) * 100.0, 6) AS pct FROM v GROUP BY ALL",
)
def facet_distributions(spark, sf_dir):
    return plain(ev.facet_distributions(annotations(spark, sf_dir)))


@query(
    "tag_frequency",
    f"{EVAL_CTE} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM ann) GROUP BY 1 ORDER BY n DESC, tag LIMIT 30",
)
def tag_frequency(spark, sf_dir):
    return ev.tag_frequency(annotations(spark, sf_dir))


@query(
    "source_mix",
    f"{EVAL_CTE} SELECT source, count(*) AS n, round(avg(CASE WHEN project = ['unknown'] THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS project_unknown_rate, "
    "round(avg(CASE WHEN len(tags) = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS empty_tags_rate FROM ann GROUP BY 1",
)
def source_mix(spark, sf_dir):
    return plain(ev.source_mix(annotations(spark, sf_dir)))


def agreement_sql(source: str, key: str, crosswalk) -> str:
    return (
        f"{EVAL_CTE}, x AS (SELECT tags, {crosswalk_case(crosswalk, key)} AS ok FROM ann WHERE source = '{source}') "
        "SELECT count(*) AS n_total, count(ok) AS n_eligible, count(*) FILTER (WHERE list_has_any(ok, tags)) AS n_agree, "
        "round(CASE WHEN count(ok) = 0 THEN NULL ELSE count(*) FILTER (WHERE list_has_any(ok, tags)) / count(ok) END, 6) AS rate FROM x"
    )


@query("weak_label_agreement", agreement_sql("yahoo-answers", "topic", FORUM_TOPIC_TAGS))
def weak_label_agreement(spark, sf_dir):
    return plain(ev.weak_label_agreement(annotations(spark, sf_dir), "yahoo-answers", "yahoo_topic", FORUM_TOPIC_TAGS))


@query("weak_scenario_agreement", agreement_sql("massive", "scenario", WEAK_SCENARIO_TAGS))
def weak_scenario_agreement(spark, sf_dir):
    return plain(ev.weak_label_agreement(annotations(spark, sf_dir), "massive", "massive_scenario", WEAK_SCENARIO_TAGS))


@query(
    "source_domain_agreement",
    f"{EVAL_CTE} SELECT count(*) AS n_total, count(*) FILTER (WHERE domain = 'engineering') AS n_agree, "
    "round(count(*) FILTER (WHERE domain = 'engineering') / count(*), 6) AS rate FROM ann WHERE source = 'stackoverflow'",
)
def source_domain_agreement(spark, sf_dir):
    return plain(ev.domain_agreement(annotations(spark, sf_dir), "stackoverflow"))


@query(
    "red_team_tags",
    f"{EVAL_CTE} SELECT count(*) AS n_total, count(*) FILTER (WHERE len(tags) = 0) AS n_empty_tags, "
    "count(*) FILTER (WHERE len(list_filter(tags, lambda t: t LIKE '%sensitive%' OR t LIKE '%harmful%')) > 0) AS n_with_named_tag, "
    "round(count(*) FILTER (WHERE len(tags) = 0) / count(*), 6) AS empty_rate FROM ann WHERE source = 'hh-rlhf-red-team'",
)
def red_team_tags(spark, sf_dir):
    return plain(ev.empty_tag_behavior(annotations(spark, sf_dir), "hh-rlhf-red-team"))


@query(
    "level_tagging_coverage",
    f"{EVAL_CTE} SELECT l1 AS label, count(*) AS n, count(*) FILTER (WHERE len(tags) > 0) AS tagged FROM ann WHERE source = 'dbpedia' GROUP BY 1",
)
def level_tagging_coverage(spark, sf_dir):
    return ev.tagging_coverage(annotations(spark, sf_dir), "dbpedia", "dbpedia_l1")


@query(
    "usage_totals",
    f"""{EVAL_CTE}, u AS (SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS i, CAST(sum(doc_id % 50) AS BIGINT) AS o,
  CAST(coalesce(sum(CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 END), 0) AS BIGINT) AS w, CAST(sum(n_chars % 100) AS BIGINT) AS r FROM ann),
c AS (SELECT *, i * 3.0::DOUBLE / 1000000 * 0.5::DOUBLE AS ci, o * 15.0::DOUBLE / 1000000 * 0.5::DOUBLE AS co, w * 3.75::DOUBLE / 1000000 * 0.5::DOUBLE AS cw,
  r * 0.3::DOUBLE / 1000000 * 0.5::DOUBLE AS cr FROM u)
SELECT n, i AS input, o AS output, w AS cache_creation, r AS cache_read, round(ci, 6) AS cost_input, round(co, 6) AS cost_output,
  round(cw, 6) AS cost_cache_creation, round(cr, 6) AS cost_cache_read, round(ci + co + cw + cr, 6) AS cost_total FROM c""",
)
def usage_totals(spark, sf_dir):
    return plain(ev.usage_totals(annotations(spark, sf_dir)))


RAW_ANNOTATION = """CASE doc_id % 6
  WHEN 0 THEN concat('{"context":"business","domain":"legal","activity":"building","project":["a"],"tags":["t',doc_id,'"]}')
  WHEN 1 THEN concat('{"context":"office","domain":"legal","activity":"building","project":[],"tags":[]}')
  WHEN 2 THEN 'not json at all'
  WHEN 3 THEN concat('{"context":"personal","domain":"research","activity":"planning","project":["unknown"],"tags":[]}')
  WHEN 4 THEN concat('{"context":"unknown","domain":"health","activity":"debugging","project":[],"tags":["x"]}')
  ELSE '{"context":"personal","domain":"finance","activity":"reviewing","tags":["y"]}' END"""


def raw_annotations(spark, sf_dir):
    return load(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) as id", f"{RAW_ANNOTATION} as text")


@query(
    "annotation_validation",
    "SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'context' WHEN 2 THEN 'json_parse_failed' "
    "WHEN 3 THEN 'domain' WHEN 4 THEN 'activity' ELSE 'project' END AS reason FROM documents) GROUP BY 1",
)
def annotation_validation(spark, sf_dir):
    checked = ev.validate_annotations(raw_annotations(spark, sf_dir))
    return checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "annotation_repair",
    "SELECT domain, activity, count(*) AS n FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'legal' WHEN 1 THEN 'legal' WHEN 3 THEN 'unknown' WHEN 4 THEN 'health' ELSE 'finance' END AS domain, "
    "CASE doc_id % 6 WHEN 0 THEN 'building' WHEN 1 THEN 'building' WHEN 3 THEN 'planning' WHEN 4 THEN 'investigating' ELSE 'reviewing' END AS activity "
    "FROM documents WHERE doc_id % 6 <> 2) GROUP BY ALL",
)
def annotation_repair(spark, sf_dir):
    checked = ev.validate_annotations(raw_annotations(spark, sf_dir)).filter("facets is not null")
    return ev.repair_labels(checked).groupBy("facets.domain", "facets.activity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "annotation_audit",
    "SELECT concat('d', doc_id) AS id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) "
    "UNION ALL SELECT concat('d', doc_id + 1000000), 'fabricated' FROM labels WHERE quality = 0",
)
def annotation_audit(spark, sf_dir):
    samples = load(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) as id")
    labels = load(spark, sf_dir, "labels")
    written = labels.selectExpr("concat('d', doc_id) as id").unionByName(
        labels.filter("quality = 0").selectExpr("concat('d', doc_id + 1000000) as id")
    )
    return ev.audit_ids(samples, written)


# The language whose words occur most often (three and more are alike), the first of equal ones.
GUESSES = """WITH w AS (SELECT doc_id, lang, string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+') AS words FROM documents),
t AS (SELECT doc_id, lang, unnest([""" + ", ".join(
    f"{{'tag': '{t}', 'ord': {i}, 'n': len(list_filter(words, lambda x: x IN ({','.join(repr(v) for v in w)})))}}" for i, (t, w) in enumerate(LANGUAGE_WORDS.items())
) + """]) AS t FROM w),
g AS (SELECT concat('d', doc_id) AS id, any_value(CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE lang END) AS gold, coalesce(arg_min(t.tag, (-least(t.n, 3), t.ord)) FILTER (WHERE t.n > 0), 'unknown') AS pred FROM t GROUP BY doc_id)"""


def guessed(spark, sf_dir, words=LANGUAGE_WORDS):
    """Documents classified by the library's keyword tagger, with the best tag as the prediction."""
    docs = load(spark, sf_dir, "documents").selectExpr(
        "concat('d', doc_id) as id", "case lang when 'en' then 'english' when 'fr' then 'french' when 'de' then 'german' else lang end as gold",
        "array(named_struct('role', 'user', 'content', text)) as messages",
    )
    classified = rs.classify(docs, {"tags": lambda: cl.keyword_tagger(words)})
    return ev.evaluate(classified, F.coalesce(rs.best(F.col("classifications"), "tags")["value"], F.lit("unknown"))).select("id", "gold", "pred")


@query("evaluate_examples", f"{GUESSES} SELECT id, gold, pred FROM g")
def evaluate_examples(spark, sf_dir):
    return guessed(spark, sf_dir)


def first_words(batch):
    """A batch classifier: up to two words that begin a text, or one that begins with a vowel; it fails on every 97th document."""
    out = []
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        if doc % 97 == 0:
            raise ValueError(f"document {doc} is refused")
        words = [w for w in text.split(" ") if w][:2]
        value = words[0] if words and words[0][0] in "AEIOUaeiou" else words
        out.append([{"facet": "project", "value": value, "confidence": 0.5 + 0.1 * (doc % 3), "source": "first-words"}])
    return out


@query(
    "batch_classifier",
    "WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '')[1:2] AS w FROM documents) SELECT concat('d', doc_id) AS id, "
    "CASE WHEN doc_id % 97 <> 0 THEN CASE WHEN regexp_matches(w[1], '^[AEIOUaeiou]') THEN w[1] ELSE array_to_string(w, ',') END END AS value, "
    "CASE WHEN doc_id % 97 <> 0 THEN round(0.5::DOUBLE + 0.1::DOUBLE * (doc_id % 3), 6) END AS confidence, CASE WHEN doc_id % 97 = 0 THEN concat('ValueError: document ', doc_id, ' is refused') END AS error FROM w",
)
def batch_classifier(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    ran = ev.run_classifier(docs, first_words, ["doc_id", "text"])
    first = F.get("raw", F.lit(0))
    return plain(ran.select(F.concat(F.lit("d"), "doc_id").alias("id"), first["text"].alias("value"), first["confidence"].alias("confidence"), "error"))


FEWER_WORDS = {t: w[:1] for t, w in LANGUAGE_WORDS.items()}


@query(
    "eval_runs",
    f"{GUESSES}, f AS (SELECT doc_id, unnest([" + ", ".join(
        f"{{'tag': '{t}', 'ord': {i}, 'n': len(list_filter(words, lambda x: x = '{w[0]}'))}}" for i, (t, w) in enumerate(LANGUAGE_WORDS.items())
    ) + "]) AS t FROM w), b AS (SELECT concat('d', doc_id) AS id, coalesce(arg_min(t.tag, (-least(t.n, 3), t.ord)) FILTER (WHERE t.n > 0), 'unknown') AS pred FROM f GROUP BY doc_id) "
    "SELECT id, gold, b.pred AS before, g.pred AS after, CASE WHEN b.pred = g.pred THEN 'same' WHEN g.pred = gold THEN 'fixed' WHEN b.pred = gold THEN 'broken' ELSE 'changed' END AS change "
    "FROM g JOIN b USING (id)",
)
def eval_runs(spark, sf_dir):
    """Two runs are kept, the second is written again, and both are read back side by side."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/eval-{uuid.uuid4().hex}"
    ev.write_run(guessed(spark, sf_dir, FEWER_WORDS), path, "few-words")
    for rows in (guessed(spark, sf_dir, FEWER_WORDS), guessed(spark, sf_dir)):
        ev.write_run(rows, path, "all-words")
    return ev.compare_runs(ev.read_run(spark, path, "few-words"), ev.read_run(spark, path, "all-words"))


@query("reservoir_sample", "SELECT doc_id AS id, source, lang FROM documents ORDER BY md5(concat('42-', doc_id)), doc_id LIMIT 40")
def reservoir_sample(spark, sf_dir):
    return ev.reservoir(load(spark, sf_dir, "documents").selectExpr("doc_id as id", "source", "lang"), 40, 42)


@query(
    "stratified_sample",
    "SELECT doc_id AS id, source, lang FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42-', doc_id)), doc_id) "
    "<= CASE lang WHEN 'en' THEN 20 WHEN 'fr' THEN 15 WHEN 'de' THEN 10 ELSE 1000000 END",
)
def stratified_sample(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id as id", "source", "lang")
    return ev.stratified(rows, "lang", {"en": 20, "fr": 15, "de": 10, "es": 1000000}, 42)


@query(
    "stratified_sample_sizes",
    "SELECT lang, least(count(*), CASE lang WHEN 'en' THEN 20 WHEN 'fr' THEN 15 WHEN 'de' THEN 10 ELSE 1000000 END) AS n FROM documents "
    "WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY lang",
)
def stratified_sample_sizes(spark, sf_dir):
    return stratified_sample(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("rare_cluster_sample")
def rare_cluster_sample(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding", "label")
    return ev.rare_cluster_sample(vectors, "embedding", 60, 42).select("id", "label", "cluster", "cluster_size")


@query(
    "weak_labels_attached",
    "SELECT concat('d', doc_id) AS id, CASE WHEN toxic = 1 THEN 'toxic' END AS risk, CAST(quality AS VARCHAR) AS quality FROM labels",
)
def weak_labels_attached(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").selectExpr(
        "concat('d', doc_id) as id", "quality", "toxic", "map('quality', 'old') as weak_labels"
    )
    marked = ev.attach_weak_labels(
        rows, risk=F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("")), quality=F.col("quality")
    )
    return marked.select("id", F.col("weak_labels")["risk"].alias("risk"), F.col("weak_labels")["quality"].alias("quality"))


@query(
    "unique_samples",
    "SELECT source AS id, min(doc_id) AS first_doc FROM documents GROUP BY 1",
)
def unique_samples(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").selectExpr("source as id", "doc_id as first_doc")
    return ev.unique_by_id(rows, F.col("first_doc"))
