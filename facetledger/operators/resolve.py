"""From candidate verdicts to one verdict per scalar facet and the top values per array facet.

Everything happens inside the row: a call's candidates are few (bounded by the classifier list), so sorting them
in an array expression is cheaper than a shuffle by call.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetledger.operators.classify import Classifier, bind, with_candidates
from facetledger.schemas import ARRAY_FACETS, FACETS, FACETS_STRUCT, SCALAR_FACETS, SCORED, VERDICTS, Facet

PIPELINE_VERSION = "1.0"


def by_confidence(items: Column) -> Column:
    """Most confident first; equal ones keep their order."""
    indexed = F.transform(items, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    order = lambda a, b: (
        F.when(a["c"]["confidence"] > b["c"]["confidence"], -1)
        .when(a["c"]["confidence"] < b["c"]["confidence"], 1)
        .when(a["i"] < b["i"], -1)
        .otherwise(1)
    )
    return F.transform(F.array_sort(indexed, order), lambda x: x["c"])


def once(value: Column, use) -> Column:
    """Evaluates ``value`` a single time for all uses in ``use``, which must return an array."""
    return F.flatten(F.transform(F.array(value), use))


def viable(candidates: Column, facet: Facet) -> Column:
    return F.filter(candidates, lambda c: (c["facet"] == facet.name) & (c["confidence"] >= facet.min_confidence))


def resolve_scalar(candidates: Column, facet: Facet) -> Column:
    """The most confident candidate; the others become its alternatives. Empty when none reaches the floor."""

    def pick(ranked: Column) -> Column:
        losers = F.transform(
            F.slice(ranked, F.lit(2), F.size(ranked)),
            lambda c: F.struct(c["value"].alias("value"), c["confidence"].alias("confidence")),
        )
        return F.transform(
            F.slice(ranked, 1, 1), lambda w: w.withField("alternatives", F.concat(w["alternatives"], losers))
        )

    return once(by_confidence(viable(candidates, facet)), pick)


def keep_best_per_value(items: Column, kind: str = VERDICTS) -> Column:
    """One item per value, the most confident, in order of the value's first appearance."""
    merge = lambda kept, c: F.when(
        F.exists(kept, lambda k: k["value"] == c["value"]),
        F.transform(kept, lambda k: F.when((k["value"] == c["value"]) & (c["confidence"] > k["confidence"]), c).otherwise(k)),
    ).otherwise(F.concat(kept, F.array(c)))
    return F.aggregate(items, F.array().cast(kind), merge)


def resolve_array(candidates: Column, facet: Facet) -> Column:
    """Values above the floor, each once at its best confidence, most confident first, at most ``top_n``."""
    return F.slice(by_confidence(keep_best_per_value(viable(candidates, facet))), 1, facet.top_n)


def resolve(candidates: Column, facets: Mapping[str, Facet] = FACETS) -> Column:
    """All facets' verdicts; candidates of facets outside the registry are dropped."""
    return F.concat(*[(resolve_array if f.array else resolve_scalar)(candidates, f) for f in facets.values()])


def classify(
    calls: DataFrame, classifiers: Mapping[str, Classifier] | None = None, facets: Mapping[str, Facet] = FACETS,
    version: str = PIPELINE_VERSION,
) -> DataFrame:
    """Calls with their resolved ``classifications``. One projection over the scan."""
    candidates = with_candidates(calls, classifiers)
    resolved = bind(candidates, "classifications", resolve(F.col("candidates"), facets)).drop("candidates")
    return resolved.withColumn("pipeline_version", F.lit(version))


def long_form(classified: DataFrame, *keys: str) -> DataFrame:
    """One row per verdict, with its position inside the facet list."""
    return classified.select(*(keys or ("call_id",)), F.posexplode("classifications").alias("ord", "v")).select(
        *(keys or ("call_id",)), "ord", "v.*"
    )


def best(verdicts: Column, facet: str) -> Column:
    """The first verdict of a facet as a struct; null when the facet is missing."""
    return F.get(F.filter(verdicts, lambda c: c["facet"] == facet), F.lit(0))


def values_of(verdicts: Column, facet: str) -> Column:
    return F.transform(F.filter(verdicts, lambda c: c["facet"] == facet), lambda c: c["value"])


def with_defaults(verdicts: Column, facets: Mapping[str, Facet] = FACETS) -> Column:
    """Facet values as a struct, defaults where nothing cleared the floor."""
    columns = []
    for facet in facets.values():
        if facet.array:
            values = values_of(verdicts, facet.name)
            default = F.array(*map(F.lit, facet.default)).cast("array<string>")
            columns.append(F.when(F.size(values) > 0, values).otherwise(default).alias(facet.name))
        else:
            columns.append(F.coalesce(best(verdicts, facet.name)["value"], F.lit(facet.default[0])).alias(facet.name))
    return F.struct(*columns)


def prediction(verdicts: Column) -> Column:
    """The eval shape: best scalar values, unique project (3) and tag (5) lists, unknown where missing."""
    top = lambda name, n: F.slice(F.array_distinct(F.transform(by_confidence(F.filter(verdicts, lambda c: c["facet"] == name)), lambda c: c["value"])), 1, n)
    scalar = lambda name: F.coalesce(
        F.get(by_confidence(F.filter(verdicts, lambda c: c["facet"] == name)), F.lit(0))["value"], F.lit("unknown")
    )
    projects = top("project", 3)
    return F.struct(
        *[scalar(f).alias(f) for f in SCALAR_FACETS],
        F.when(F.size(projects) > 0, projects).otherwise(F.array(F.lit("unknown"))).alias("project"),
        top("tags", 5).alias("tags"),
    )


def facet_lists(verdicts: Column) -> Column:
    """The spend row's facets: best scalar, unique arrays by confidence, confidences to 4 digits.

    Null verdicts (the classifier failed) give null; facets without verdicts are null fields.
    """
    item = lambda c: F.struct(c["value"].alias("value"), F.bround(c["confidence"], 4).alias("confidence"))
    ranked = lambda name: by_confidence(F.filter(verdicts, lambda c: c["facet"] == name))
    scalar = lambda name: F.get(F.transform(F.slice(ranked(name), 1, 1), item), F.lit(0))
    array = lambda name: F.nullif(
        F.transform(keep_best_per_value(ranked(name)), item), F.array().cast(f"array<{SCORED}>")
    )
    columns = [scalar(f).alias(f) for f in SCALAR_FACETS] + [array(f).alias(f) for f in ARRAY_FACETS]
    shaped = F.struct(*columns).cast(FACETS_STRUCT)
    return F.when(verdicts.isNotNull(), shaped)
