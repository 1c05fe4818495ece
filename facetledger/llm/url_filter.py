"""URL verdicts: host rules first, gradient-boosted trees on lexical features for the rest.

All of it is DataFrame expressions and Spark's own tree learner. Urls that a rule decides are the labelled urls; the trees
are fitted on a bounded sample of them (``sample`` distinct urls of each verdict, in the order of their hashes). Suffix
statistics are counted over all urls.

Defined results: a null url or one without ``://`` has an empty host and path, no rule fits it, and the trees judge its
features like any other's; the longest rule wins, of equally long ones the first by name; without labelled urls, or with
one verdict among them, the method's verdict is that one, else allow; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy",
    "n_parameters", "has_fragment", "longest_label", "suffix_share", "domain_share", "suffix_domains",
)


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains if the url's path starts with ``/path``."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith(f".{self.host}")
        return host & F.col("path").startswith(self.path)


def split_url(urls: DataFrame) -> DataFrame:
    """Adds host (after the first ``://``, A-Z lower-cased) and path (behind it up to ``?`` or ``#``)."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    take = lambda k: F.coalesce(F.regexp_extract("url", parts, k), F.lit(""))
    return urls.withColumns({"host": F.translate(take(1), UPPER, LOWER), "path": take(2)})


def match_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds the longest rule that fits and its verdict, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern), reverse=True):
        rule, verdict = F.when(r.fits(), r.pattern).otherwise(rule), F.when(r.fits(), r.verdict).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def _count(column: str, pattern: str) -> Column:
    return F.length(column) - F.length(F.regexp_replace(column, pattern, ""))


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of the url, and how common its suffix and its domain are among all urls.

    The suffix is the last label of the host, the domain its last two. Counts are summed per domain in each task before
    they are shuffled, and joined back on the domain.
    """
    labels = F.split("host", r"\.")
    length = F.greatest(F.length("__url"), F.lit(1))
    letters = F.filter(F.split("__url", ""), lambda c: c != "")
    share = lambda n: -(n / length) * F.log2(n / length)
    one = urls.withColumns({
        "__url": F.coalesce("url", F.lit("")),
        "__suffix": F.element_at(labels, -1), "__domain": F.concat_ws(".", F.slice(F.concat(F.array(F.lit("")), labels), -2, 2)),
    })
    counts = one.groupBy("__suffix", "__domain").agg(F.count("*").alias("_n"))
    by_suffix = counts.groupBy("__suffix").agg(F.sum("_n").alias("_s"), F.count("*").alias("_domains"))
    total = by_suffix.select(F.sum("_s").alias("_total"))
    known = counts.join(by_suffix, "__suffix").join(F.broadcast(total)).select(  # one row
        "__domain", (F.col("_s") / F.col("_total")).alias("suffix_share"), (F.col("_n") / F.col("_total")).alias("domain_share"), F.log1p("_domains").alias("suffix_domains"),
    )
    lexical = {
        "url_length": F.length("__url"), "host_length": F.length("host"), "path_length": F.length("path"),
        "host_depth": _count("host", r"\."), "path_depth": _count("path", "/"),
        "digit_ratio": _count("__url", "[0-9]") / length, "host_digit_ratio": _count("host", "[0-9]") / F.greatest(F.length("host"), F.lit(1)),
        "hyphens": _count("host", "-"),
        "entropy": F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s + share(F.length("__url") - F.length(F.replace("__url", c, F.lit(""))))),
        "n_parameters": F.when(F.instr("__url", "?") > 0, _count("__url", "&") + 1).otherwise(0),
        "has_fragment": F.when(F.instr("__url", "#") > 0, 1).otherwise(0),
        "longest_label": F.array_max(F.transform(labels, F.length)),
    }
    return one.withColumns({k: v.cast("double") for k, v in lexical.items()}).join(known, "__domain").drop("__url", "__suffix", "__domain")


def labelled_sample(judged: DataFrame, per_verdict: int = SAMPLE) -> DataFrame:
    """Distinct labelled urls, at most ``per_verdict`` of each verdict; the ranking is cut in each task first."""
    order = Window.partitionBy("rule_verdict").orderBy(F.xxhash64("url"), "url")
    distinct = judged.where("rule_verdict is not null").select("url", "rule_verdict", *FEATURES).dropDuplicates(["url"])
    return distinct.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_verdict).drop("_rank")


def fit(sample: DataFrame, trees: int = 10, depth: int = 3) -> GBTClassificationModel | str:
    """The trees, or the only verdict there is."""
    labels = [r[0] for r in sample.select("rule_verdict").distinct().limit(2).collect()]
    if len(labels) < 2:
        return labels[0] if labels else "allow"
    rows = sample.select((F.col("rule_verdict") == "block").cast("double").alias("label"), *FEATURES)
    learner = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7)
    return learner.fit(assemble(rows).select("label", "_features").coalesce(4))


def assemble(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="keep").transform(rows)


def judge(urls: DataFrame, rules: Sequence[Rule], per_verdict: int = SAMPLE) -> DataFrame:
    """The rows with host, path, rule, verdict (the rule's, else the trees') and ``block_probability``."""
    own = {"host", "path", "rule", "verdict", "block_probability", "rule_verdict", "probability", "rawPrediction", "prediction", *FEATURES}
    plain = urls.drop(*[c for c in urls.columns if c in own])
    judged = with_features(match_rules(split_url(plain), rules))
    model = fit(labelled_sample(judged.select("url", "rule_verdict", *FEATURES), per_verdict))
    if isinstance(model, str):
        scored = judged.withColumn("block_probability", F.lit(float(model == "block")))
    else:
        scored = model.transform(assemble(judged)).withColumn("block_probability", vector_to_array("probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return scored.select(*plain.columns, "host", "path", "rule", verdict.alias("verdict"), "block_probability")
