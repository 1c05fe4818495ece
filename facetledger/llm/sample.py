"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % n


def sample_ids(docs: DataFrame, labelled: DataFrame, label: str, per_label: int, limit_bytes: int) -> DataFrame:
    """Ids of each label with the length of their text (``_bytes``): at most ``per_label``, and none after
    ``per_label * limit_bytes`` bytes of text, so the first text of a label is taken whatever its length.

    Texts of up to ``limit_bytes`` come first, then those of up to twice that, and so on; in each of these bands ids go by
    their hashes, so the same rows come whatever the partitioning. An id without a text is none. ``labelled`` has doc_id and
    the label, and may be ``docs`` itself. Of a band with many rows only hashes in a range that holds three times as many
    ids as wanted are ranked. The labels are a closed set; the driver gets one count for each label and band.
    """
    # Bands by doubling: 0, 1, 2, ... of lengths up to limit, 2 * limit, 4 * limit, ...
    size = F.octet_length("text").cast("long")
    if labelled is docs:
        one = docs.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max(label).alias(label), F.min(size).alias("_bytes"))
    else:
        sizes = docs.where("doc_id is not null and text is not null").select("doc_id", size.alias("_bytes"))
        one = labelled.where("doc_id is not null").join(sizes, "doc_id").groupBy("doc_id").agg(F.max(label).alias(label), F.min("_bytes").alias("_bytes"))
    one = one.withColumn("_band", F.length(F.bin(F.expr(f"(greatest(_bytes, 1) - 1) div {limit_bytes}"))) - F.expr(f"if(_bytes <= {limit_bytes}, 1, 0)"))
    counts = one.groupBy(label, "_band").count().collect()
    wide = F.lit(False)
    for value, band, n in counts:
        wide = wide | ((F.col(label) == value) & (F.col("_band") == band) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) * n < 3 * per_label * (1 << 31)))
    order = Window.partitionBy(label).orderBy("_band", F.xxhash64("doc_id"), "doc_id")
    before = F.coalesce(F.sum("_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = one.where(wide).withColumns({"_rank": F.row_number().over(order), "_before": before})
    return ranked.where((F.col("_rank") <= per_label) & (F.col("_before") < per_label * limit_bytes)).drop("_rank", "_before", "_band")


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The sampled ids with one text each, the shortest (of equally long ones the first).

    The ids are a sample of bounded size, so they may be broadcast.
    """
    names = [c for c in ids.columns if c != "_bytes"]
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.octet_length("text") == F.col("_bytes"))
    return texts.groupBy(*names).agg(F.min("text").alias("text"))
