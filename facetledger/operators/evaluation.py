"""Classifier quality: binary, multi-class and set metrics, agreement, sweeps, audits and samples.

Counts are aggregated map-side first; metrics are arithmetic on the few aggregated rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from facetledger.operators.attribution import ratio
from facetledger.vocab import (
    ACTIVITY_REPAIRS, ACTIVITY_VALUES, BATCH_DISCOUNT, BATCH_PRICES, CONTEXT_VALUES, DOMAIN_VALUES,
    SWEEP_SIMILARITIES, SWEEP_TOP_N,
)


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def wilson_bounds(successes: Column, n: Column, z: float = 1.96) -> Column:
    """95 % score interval of a proportion as a struct, clipped to [0, 1]; (0, 0) when n is 0."""
    size = n.cast("double")
    p = F.try_divide(successes.cast("double"), size)
    scale = 1 + F.try_divide(F.lit(z * z), size)
    centre = (p + F.try_divide(F.lit(z * z), 2 * size)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), size) + F.try_divide(F.lit(z * z), 4 * size * size)) / scale
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(0.0))
    return F.struct(low.alias("low"), high.alias("high"))


def binary_metrics(rows: DataFrame, gold: Column, pred: Column, *group: str) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy of one target label."""
    counts = rows.groupBy(*group).agg(
        F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"),
        F.count_if(gold & ~pred).alias("fn"), F.count_if(~gold & ~pred).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    scored = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return scored.withColumn("f1", f1_of(F.col("precision"), F.col("recall"))).withColumn(
        "accuracy", ratio(tp + tn, tp + fp + fn + tn)
    )


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(rows: DataFrame, gold: str, pred: str, *group: str) -> DataFrame:
    """tp, fp and fn per class. Each row gives at most two entries; equal pairs are merged before that."""
    pairs = rows.groupBy(*group, F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    entry = lambda label, tp, fp, fn: F.struct(
        label.alias("label"), (F.col("n") * tp).alias("tp"), (F.col("n") * fp).alias("fp"), (F.col("n") * fn).alias("fn")
    )
    entries = F.when(F.col("g") == F.col("p"), F.array(entry(F.col("g"), 1, 0, 0))).otherwise(
        F.array(entry(F.col("g"), 0, 0, 1), entry(F.col("p"), 0, 1, 0))
    )
    exploded = pairs.select(*group, F.inline(entries))
    return exploded.groupBy(*group, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def with_class_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return scored.withColumn("f1", f1_of(F.col("precision"), F.col("recall"))).withColumn("support", tp + fn)


def multiclass(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Per-class precision and recall; a class on one side only scores zero on the other."""
    return with_class_metrics(class_counts(rows, gold, pred)).select("label", "precision", "recall", "support")


def accuracy(rows: DataFrame, gold: str, pred: str, *group: str) -> DataFrame:
    correct = F.count_if(F.col(gold) == F.col(pred))
    n = F.count(F.lit(1))
    return rows.groupBy(*group).agg(n.alias("n"), correct.alias("correct"), ratio(correct, n).alias("accuracy"))


def scalar_metrics(rows: DataFrame, gold: str, pred: str, *group: str) -> DataFrame:
    """Accuracy, micro and macro averages per group; macro only over classes that occur in gold."""
    classes = with_class_metrics(class_counts(rows, gold, pred, *group))
    sums = classes.groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    micro = sums.withColumn("micro_precision", ratio(tp, tp + fp)).withColumn("micro_recall", ratio(tp, tp + fn))
    return micro.select(
        *group, (tp + fn).alias("n"), ratio(tp, tp + fn).alias("accuracy"), "micro_precision", "micro_recall",
        f1_of(F.col("micro_precision"), F.col("micro_recall")).alias("micro_f1"), "macro_f1",
    )


def set_scores(gold: Column, pred: Column) -> dict[str, Column]:
    """Per-example precision, recall, F1 and Jaccard of two sets; two empty sets agree fully."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    both = F.size(F.array_intersect(g, p)).cast("double")
    union = F.size(F.array_union(g, p))
    none = F.when(union == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    precision = F.when(F.size(p) > 0, both / F.size(p)).otherwise(none)
    recall = F.when(F.size(g) > 0, both / F.size(g)).otherwise(none)
    f1 = F.when(both > 0, 2 * precision * recall / (precision + recall)).otherwise(none)
    return {"precision": precision, "recall": recall, "f1": f1, "jaccard": F.when(union > 0, both / union).otherwise(F.lit(1.0))}


def set_metrics(rows: DataFrame, gold: str, pred: str, *group: str) -> DataFrame:
    scores = set_scores(F.col(gold), F.col(pred))
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"macro_{name}") for name, c in scores.items()]
    )


def label_entries(gold: Column, pred: Column) -> Column:
    """One entry per label of either set, flagged tp, fp or fn."""
    entry = lambda tp, fp, fn: lambda v: F.struct(
        v.alias("label"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn")
    )
    return F.concat(
        F.transform(F.array_intersect(gold, pred), entry(1, 0, 0)),
        F.transform(F.array_except(pred, gold), entry(0, 1, 0)),
        F.transform(F.array_except(gold, pred), entry(0, 0, 1)),
    )


def label_metrics(rows: DataFrame, gold: str, pred: str, *group: str) -> DataFrame:
    """Per-label precision, recall, F1 and support of set predictions."""
    entries = rows.select(*group, F.inline(label_entries(F.col(gold), F.col(pred))))
    return with_class_metrics(
        entries.groupBy(*group, "label").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])
    )


def top_k_accuracy(rows: DataFrame, gold: str, ranked: str, k: int) -> DataFrame:
    hit = F.array_contains(F.slice(F.col(ranked), 1, k), F.col(gold))
    return rows.agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(hit), F.count(F.lit(1))).alias("accuracy"))


def crosswalk_hits(rows: DataFrame, accepted: Column, ranked: str, k: int) -> DataFrame:
    """Share of rows whose top k holds any accepted label."""
    hit = F.coalesce(F.arrays_overlap(F.slice(F.col(ranked), 1, k), accepted), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), ratio(F.count_if(hit), F.count(F.lit(1))).alias("rate")
    )


def cohens_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement beyond chance; 1 when chance agreement is complete. Only label counts are joined."""
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("label"), F.col("n").alias("in_a"), F.lit(0).cast("bigint").alias("in_b"),
                         F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same")),
                F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("in_a"), F.col("n").alias("in_b"),
                         F.lit(0).cast("bigint").alias("same")),
            )
        )
    )
    labels = sides.groupBy("label").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"), F.sum("same").alias("same"))
    total = labels.agg(
        F.sum("in_a").alias("n"), F.sum("same").alias("same"),
        F.sum(F.col("in_a").cast("decimal(19,0)") * F.col("in_b").cast("decimal(19,0)")).alias("product"),
    )
    po = ratio(F.col("same"), F.col("n"))
    pe = ratio(F.col("product"), F.col("n").cast("double") * F.col("n").cast("double"))
    kappa = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.lit(0.0)).when(pe == 1.0, F.lit(1.0)).otherwise(
        F.try_divide(po - pe, 1 - pe)
    )
    return total.select(F.coalesce("n", F.lit(0)).alias("n"), po.alias("observed"), pe.alias("expected"), kappa.alias("kappa"))


def gold_with_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows present on both sides; sets of projects drop the placeholder. Both sides hold one row per id."""
    g = gold.select("id", "source", F.col("facets").alias("gold"))
    p = predictions.select("id", F.col("facets").alias("pred"), *(c for c in predictions.columns if c == "raw"))
    joined = g.join(p, "id")
    for side in ("gold", "pred"):
        joined = joined.withColumn(
            side, F.col(side).withField("project", F.array_remove(F.col(f"{side}.project"), "unknown"))
        )
    return joined


def facet_slices(joined: DataFrame, facets=("context", "domain", "activity")) -> DataFrame:
    """Scalar metrics of each facet, overall and per source, from one aggregation of label pairs."""
    entries = F.array(
        *[
            F.struct(F.lit(f).alias("facet"), F.col(f"gold.{f}").alias("g"), F.col(f"pred.{f}").alias("p"))
            for f in facets
        ]
    )
    rows = joined.select(
        F.explode(F.array(F.lit("(all)"), F.coalesce("source", F.lit("?")))).alias("slice"), entries.alias("entries")
    ).select("slice", F.inline("entries"))
    return scalar_metrics(rows, "g", "p", "slice", "facet")


def derive_tags(raw: Column, similarity: Column, top_n: Column) -> Column:
    """Tags kept at a threshold: most confident first, each value once, at most ``top_n``."""
    indexed = F.transform(raw, lambda t, i: F.struct((-t["confidence"]).alias("c"), i.alias("i"), t["value"].alias("v")))
    kept = F.filter(indexed, lambda t: -t["c"] >= similarity)
    return F.slice(F.array_distinct(F.transform(F.array_sort(kept), lambda t: t["v"])), F.lit(1), top_n)


def threshold_sweep(
    joined: DataFrame, gold: str, raw: str, similarities=SWEEP_SIMILARITIES, top_ns=SWEEP_TOP_N,
) -> DataFrame:
    """Metrics of every grid point in one job. The grid is a literal exploded per row, not a join."""
    grid = F.array(
        *[
            F.struct(F.lit(float(s)).alias("sim"), F.lit(int(n)).alias("top_n"))
            for s in similarities for n in top_ns
        ]
    )
    points = joined.select(F.col(gold).alias("gold"), F.col(raw).alias("raw"), F.explode(grid).alias("g"))
    pred = points.select(
        F.col("g.sim").alias("sim"), F.col("g.top_n").alias("top_n"), F.array_distinct("gold").alias("gold"),
        derive_tags(F.col("raw"), F.col("g.sim"), F.col("g.top_n")).alias("pred"),
    )
    scores = set_scores(F.col("gold"), F.col("pred"))
    per_sample = pred.groupBy("sim", "top_n").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"per_sample_{name}") for name, c in scores.items()],
        F.avg(F.size("pred")).alias("avg_tags_per_sample"),
        F.avg((F.size("pred") > 0).cast("double")).alias("pct_with_tags"),
        F.avg((F.size("pred") >= F.col("top_n")).cast("double")).alias("pct_capped_at_topn"),
    )
    labels = label_metrics(pred, "gold", "pred", "sim", "top_n").filter(F.col("support") > 0)
    per_label = labels.groupBy("sim", "top_n").agg(
        *[F.avg(c).alias(f"macro_label_{c}") for c in ("precision", "recall", "f1")],
        F.count(F.lit(1)).alias("labels_with_support"),
    )
    filled = per_sample.join(per_label, ["sim", "top_n"], "left")
    return filled.na.fill(0.0, [f"macro_label_{c}" for c in ("precision", "recall", "f1")]).na.fill(0, ["labels_with_support"])


def fired(verdicts: Column, groups: Column) -> Column:
    """Whether any verdict's value is among the groups."""
    return F.exists(verdicts, lambda v: F.array_contains(groups, v["value"]))


def group_recall(rows: DataFrame, topic: Column, raw: Column, groups: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Counts per group of a topic crosswalk: rows whose topic belongs to the group against rows where it fired."""
    crosswalk = F.create_map(*[x for name, tags in groups.items() for x in (F.lit(name), F.array(*map(F.lit, tags)).cast("array<string>"))])
    every = F.array(*[F.lit(g) for g in sorted({t for tags in groups.values() for t in tags})])
    own = F.coalesce(F.element_at(crosswalk, topic), F.array().cast("array<string>"))
    marked = rows.select(own.alias("own"), F.transform(raw, lambda t: t["value"]).alias("fired"), F.explode(every).alias("group"))
    gold, pred = F.array_contains("own", F.col("group")), F.array_contains("fired", F.col("group"))
    return marked.groupBy("group").agg(
        F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"),
        F.count_if(~gold & ~pred).alias("tn"),
    ).withColumn("recall", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0)))


def top_confusions(counts: DataFrame, top: int = 10) -> DataFrame:
    return counts.filter(F.col("gold") != F.col("pred")).orderBy(F.desc("n"), "gold", "pred").limit(top)


def labels_by_support(labels: DataFrame, top: int = 20) -> DataFrame:
    return labels.orderBy(F.desc("support"), "label").limit(top)


def example_samples(rows: DataFrame, condition: Column, limit: int = 20) -> DataFrame:
    """The first rows by id that meet a condition, with the text on one line."""
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    short = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("…"))).otherwise(text)
    return rows.filter(condition).orderBy("id").limit(limit).withColumn("text", short)


def against_targets(metrics: DataFrame, targets: dict[str, tuple[float, bool]]) -> DataFrame:
    """Pass or fail per test, with the interval of the proportion. ``targets``: name -> (value, higher is better)."""
    entries = [x for name, (value, higher) in targets.items() for x in (F.lit(name), F.struct(F.lit(value).alias("target"), F.lit(higher).alias("higher")))]
    goal = F.element_at(F.create_map(*entries), F.col("test"))
    judged = metrics.withColumn("goal", goal).filter(F.col("goal").isNotNull())
    passed = F.when(F.col("goal.higher"), F.col("value") >= F.col("goal.target")).otherwise(F.col("value") <= F.col("goal.target"))
    interval = wilson_bounds(F.bround(F.col("value") * F.col("n"), 0), F.col("n"))
    return judged.select(
        "test", "n", "value", F.col("goal.target").alias("target"), interval["low"].alias("ci_low"),
        interval["high"].alias("ci_high"), F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
    )


def facet_distributions(annotations: DataFrame, facets=("context", "domain", "activity")) -> DataFrame:
    """Counts and shares per facet value; the share divides by a per-facet total of the counted rows."""
    entries = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f"facets.{f}").alias("value")) for f in facets])
    counts = annotations.select(F.inline(entries)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy("facet")) * 100.0)


def tag_frequency(annotations: DataFrame, top: int = 30) -> DataFrame:
    tags = annotations.select(F.explode("facets.tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(top)


def source_mix(annotations: DataFrame) -> DataFrame:
    """Rows per source with the shares of unknown projects and empty tag lists."""
    share = lambda flag: F.avg(flag.cast("double"))
    return annotations.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("facets.project") == F.array(F.lit("unknown"))).alias("project_unknown_rate"),
        share(F.size("facets.tags") == 0).alias("empty_tags_rate"),
    )


def accepted_labels(crosswalk: dict[str, tuple[str, ...]], key: Column) -> Column:
    """Accepted labels of a weak label; null where the crosswalk has none."""
    pairs = [x for name, labels in crosswalk.items() if labels for x in (F.lit(name), F.array(*map(F.lit, labels)))]
    return F.element_at(F.create_map(*pairs), key)


def weak_label_agreement(annotations: DataFrame, source: str, label: str, crosswalk: dict[str, tuple[str, ...]]) -> DataFrame:
    """Share of mapped rows of a source whose tags hold an accepted label."""
    weak = F.col("weak_labels")[label]
    pool = annotations.filter((F.col("source") == source) & (F.coalesce(weak, F.lit("")) != ""))
    accepted = accepted_labels(crosswalk, weak)
    agree = F.coalesce(F.arrays_overlap(accepted, F.col("facets.tags")), F.lit(False))
    counts = pool.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(accepted.isNotNull()).alias("n_eligible"), F.count_if(agree).alias("n_agree")
    )
    return counts.withColumn("rate", F.try_divide(F.col("n_agree").cast("double"), F.col("n_eligible").cast("double")))


def domain_agreement(annotations: DataFrame, source: str, domain: str = "engineering") -> DataFrame:
    hits = F.count_if(F.col("facets.domain") == domain)
    n = F.count(F.lit(1))
    return annotations.filter(F.col("source") == source).agg(
        n.alias("n_total"), hits.alias("n_agree"), F.try_divide(hits.cast("double"), n.cast("double")).alias("rate")
    )


def empty_tag_behavior(annotations: DataFrame, source: str, words=("sensitive", "harmful")) -> DataFrame:
    named = F.exists(
        "facets.tags",
        lambda t: F.contains(F.lower(t), F.lit(words[0])) | F.contains(F.lower(t), F.lit(words[1])),
    )
    empty, n = F.count_if(F.size("facets.tags") == 0), F.count(F.lit(1))
    return annotations.filter(F.col("source") == source).agg(
        n.alias("n_total"), empty.alias("n_empty_tags"), F.count_if(named).alias("n_with_named_tag"),
        F.try_divide(empty.cast("double"), n.cast("double")).alias("empty_rate"),
    )


def tagging_coverage(annotations: DataFrame, source: str, label: str) -> DataFrame:
    group = F.coalesce(F.nullif(F.col("weak_labels")[label], F.lit("")), F.lit("unknown")).alias("label")
    return annotations.filter(F.col("source") == source).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("facets.tags") > 0).alias("tagged")
    )


def validation_error(facets: Column) -> Column:
    """Why an annotation is not valid; null when it is."""
    listed = lambda name: F.exists(facets[name], lambda v: v.isNull())
    return (
        F.when(facets.isNull(), F.lit("json_parse_failed"))
        .when(~F.coalesce(facets["context"].isin(*CONTEXT_VALUES), F.lit(False)), F.lit("context"))
        .when(~F.coalesce(facets["domain"].isin(*DOMAIN_VALUES), F.lit(False)), F.lit("domain"))
        .when(~F.coalesce(facets["activity"].isin(*ACTIVITY_VALUES), F.lit(False)), F.lit("activity"))
        .when(facets["project"].isNull() | listed("project"), F.lit("project"))
        .when(facets["tags"].isNull() | listed("tags"), F.lit("tags"))
    )


ANNOTATION_FACETS = "struct<context:string,domain:string,activity:string,project:array<string>,tags:array<string>>"


def validate_annotations(raw: DataFrame) -> DataFrame:
    """Parses annotation text and adds ``reason``: null for valid rows, else why the row failed."""
    parsed = F.from_json("text", ANNOTATION_FACETS, {"mode": "PERMISSIVE"})
    shaped = F.when(F.try_parse_json("text").isNotNull(), parsed)
    return raw.withColumn("facets", shaped).withColumn("reason", validation_error(F.col("facets")))


def audit_ids(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """Sample ids nobody annotated and annotated ids that are not samples."""
    ids, known = annotations.select("id"), samples.select("id")
    missing = known.join(ids, "id", "left_anti").withColumn("problem", F.lit("missing"))
    made_up = ids.join(known, "id", "left_anti").withColumn("problem", F.lit("fabricated"))
    return missing.unionByName(made_up)


def repair_labels(annotations: DataFrame) -> DataFrame:
    """Labels outside the lists: near activities are renamed, all others become unknown."""
    repairs = F.create_map(*[F.lit(x) for pair in ACTIVITY_REPAIRS.items() for x in pair])
    keep = lambda name, allowed, other: F.when(F.col(f"facets.{name}").isin(*allowed), F.col(f"facets.{name}")).otherwise(other)
    nearest = F.coalesce(F.element_at(repairs, F.col("facets.activity")), F.lit("unknown"))
    return annotations.withColumn(
        "facets",
        F.col("facets").withField("context", keep("context", CONTEXT_VALUES, F.lit("unknown")))
        .withField("domain", keep("domain", DOMAIN_VALUES, F.lit("unknown")))
        .withField("activity", keep("activity", ACTIVITY_VALUES, nearest)),
    )


def usage_totals(annotations: DataFrame) -> DataFrame:
    """Token totals and batch-priced dollars. ``usage`` is a struct of the four canonical counters."""
    total = lambda name: F.coalesce(F.sum(f"usage.{name}"), F.lit(0))
    dollars = lambda name: total(name) * F.lit(BATCH_PRICES[name]) / 1_000_000 * F.lit(BATCH_DISCOUNT)
    names = ("input", "output", "cache_creation", "cache_read")
    cost = dollars("input") + dollars("output") + dollars("cache_creation") + dollars("cache_read")
    return annotations.agg(
        F.count(F.lit(1)).alias("n"), *[total(n).alias(n) for n in names],
        *[dollars(n).alias(f"cost_{n}") for n in names], cost.alias("cost_total"),
    )


def evaluate(examples: DataFrame, prediction: Column) -> DataFrame:
    """Eval rows: each example beside its prediction."""
    return examples.withColumn("pred", prediction)


def value_text(value: Column) -> Column:
    """A verdict's VARIANT value as text: a list's items joined by commas."""
    items = F.try_variant_get(value, "$", "array<string>")
    return F.when(items.isNotNull(), F.array_join(items, ",")).otherwise(F.try_variant_get(value, "$", "string"))


RAW_VERDICTS = "array<struct<facet:string,value:variant,text:string,confidence:double,source:string>>"
BatchClassifier = Callable[[pa.RecordBatch], list[list[dict]]]


def run_classifier(examples: DataFrame, classify: BatchClassifier, columns: list[str]) -> DataFrame:
    """Adds ``raw`` (verdicts: facet, value as VARIANT, its text, confidence, source) and ``error`` from any batch classifier.

    ``classify`` gets Arrow batches of ``columns`` and gives a list of verdicts for each row (dicts with facet, value,
    confidence, source; a value may be a list). If it fails on a batch, the rows are tried one by one, and only those
    that fail alone have an error and no verdicts.
    """
    names = [c for c in examples.columns if c not in {"raw", "error"}]

    def judged(batch: pa.RecordBatch) -> list[tuple[str | None, str | None]]:
        try:
            found = classify(batch.select(columns))
            if len(found) != batch.num_rows:
                raise ValueError(f"{len(found)} results for {batch.num_rows} rows")
            return [(json.dumps(x, ensure_ascii=False, allow_nan=False), None) for x in found]
        except Exception as failure:  # whatever a classifier raises belongs to its rows
            if batch.num_rows == 1:
                return [(None, f"{type(failure).__name__}: {failure}")]
            return [x for k in range(batch.num_rows) for x in judged(batch.slice(k, 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = judged(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in out], pa.string()) for k in (0, 1))], names=[*names, "raw", "error"])

    schema = StructType([*examples.select(*names).schema.fields, StructField("raw", StringType()), StructField("error", StringType())])
    ran = examples.select(*names).mapInArrow(run, schema)
    verdicts = F.transform(
        F.try_variant_get(F.try_parse_json("raw"), "$", "array<struct<facet:string,value:variant,confidence:double,source:string>>"),
        lambda v: F.struct(v["facet"].alias("facet"), v["value"].alias("value"), value_text(v["value"]).alias("text"), v["confidence"].alias("confidence"), v["source"].alias("source")),
    )
    return ran.withColumn("raw", verdicts.cast(RAW_VERDICTS))


def write_run(rows: DataFrame, path: str, run: str) -> None:
    """Keeps the rows of an eval run under its name. A run that is written again replaces itself and no other."""
    rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The rows of one run; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("run") == run).drop("run")


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Examples of two runs side by side: ``id``, ``gold``, both predictions, and what became of the example (fixed, broken,
    changed, same, added, dropped)."""
    old = before.select("id", F.col("gold").alias("gold_before"), F.col("pred").alias("before"), F.lit(True).alias("_old"))
    new = after.select("id", F.col("gold").alias("gold_after"), F.col("pred").alias("after"), F.lit(True).alias("_new"))
    both = old.join(new, "id", "full")
    right = lambda pred, gold: F.coalesce(F.col(pred).eqNullSafe(F.col(gold)), F.lit(False))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "dropped")
        .when(F.col("before").eqNullSafe(F.col("after")), "same")
        .when(right("after", "gold_after"), "fixed").when(right("before", "gold_before"), "broken").otherwise("changed")
    )
    return both.select("id", F.coalesce("gold_after", "gold_before").alias("gold"), "before", "after", change.alias("change"))


# --- sampling: ordered by a hash of the id, so a rerun gives the same sample on any cluster ---


def sample_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def reservoir(rows: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    """k rows drawn uniformly: the smallest hashes, found by a distributed top-k."""
    return rows.orderBy(sample_order(key, seed), key).limit(k)


def stratified(rows: DataFrame, bucket: str, targets: dict[str, int], seed: int, key: str = "id") -> DataFrame:
    """Up to the target number of rows of each listed bucket; short buckets are kept whole.

    Each task keeps no more rows of a bucket than the largest target before the buckets are put together.
    """
    wanted = F.element_at(F.create_map(*[x for name, n in targets.items() for x in (F.lit(name), F.lit(n))]), F.col(bucket))
    marked = rows.withColumn("_want", wanted).filter(F.col("_want").isNotNull()).withColumn("_order", sample_order(key, seed))
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy(bucket).orderBy("_order", key)))
    return ranked.filter((F.col("_rank") <= max(targets.values())) & (F.col("_rank") <= F.col("_want"))).drop("_want", "_order", "_rank")


def rare_cluster_sample(
    rows: DataFrame, vectors: str, n_rare: int, seed: int, key: str = "id", clusters: int = 50,
) -> DataFrame:
    """Rows of the smallest clusters first, until there are ``n_rare``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    prepared = rows.withColumn("_features", array_to_vector(F.transform(vectors, lambda x: x.cast("double"))))
    k = max(2, min(clusters, rows.count() // 10))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster", maxIter=20).fit(prepared)
    labelled = model.transform(prepared).drop("_features")
    # One row per cluster, at most ``clusters`` rows: an unpartitioned running sum is safe here.
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    before = Window.orderBy("cluster_size", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    quota = sizes.withColumn("_left", F.lit(n_rare) - F.coalesce(F.sum("cluster_size").over(before), F.lit(0)))
    wanted = labelled.join(F.broadcast(quota.filter(F.col("_left") > 0)), "cluster")
    # Cluster members are needed up to the global quota only: a top-k, never a whole cluster in one task.
    return wanted.orderBy("cluster_size", "cluster", sample_order(key, seed), key).limit(n_rare).drop("_left")


def attach_weak_labels(rows: DataFrame, **labels: Column) -> DataFrame:
    """Adds weak labels to the map; null and empty ones are left out, later ones win."""
    added = F.map_filter(
        F.create_map(*[x for name, c in labels.items() for x in (F.lit(name), c.cast("string"))]),
        lambda _, v: v.isNotNull() & (v != ""),
    )
    old = F.coalesce("weak_labels", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(added), k))
    return rows.withColumn("weak_labels", F.map_concat(kept, added))


def unique_by_id(rows: DataFrame, order: Column, key: str = "id") -> DataFrame:
    """One row per id, the first by the given order. Map-side combined, so hot ids shrink before the shuffle."""
    columns = [F.col(c) for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return best.select(key, "_row.*")
