"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned by their order key, each partition becomes one file, and a file's stripes can be read by
different tasks. A block is one file; it keeps the number of the block and, for each document, its first token in the
block, so that a reader finds global offsets from one total per block.

Defined results: null counts as an empty text and gives the end id alone; repeated document ids lie side by side in the
order of their texts' hashes; a null id comes first; an empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetledger.llm.memo import piece_ids
from facetledger.llm.text import buffer_of, slices
from facetledger.runtime import checkpoint_dir

STORED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("first_token", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20), "compression": "zstd",
}


def _encoder(tokenizer: str, end: int | None) -> Callable:
    tail = [] if end is None else [end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, block, total = piece_ids(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch):
                found, sizes = ids.encode(*buffer_of(part.column("text")))
                found = np.insert(found.view(np.int32), np.repeat(np.cumsum(sizes), len(tail)), np.tile(tail, len(sizes)))
                ends = np.concatenate(([0], np.cumsum(sizes + len(tail))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(part.num_rows, block), pa.int32()), pa.array(ends[:-1] + total), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))],
                    names=STORED.fieldNames(),
                )
                total += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = None, order: list[str] | None = None) -> None:
    """Writes the ids of all texts to ``path`` in ascending order of the ``order`` columns (the document id if none are
    given). ``tokenizer``: path of a tokenizers file on every machine; ``end``: an id behind each document."""
    key = [F.col(c) for c in order] if order else [F.col("doc_id"), F.xxhash64("text")]
    named = [k.alias(f"_key{i}") for i, k in enumerate(key)]
    keys = [f"_key{i}" for i in range(len(key))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *named)
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    rows.mapInArrow(_encoder(tokenizer, end), STORED).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` only those documents, found through the row indexes and Bloom filters."""
    rows = spark.read.schema(STORED).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _checker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("block"), batch.column("first_token"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "block", "first_token", "n_tokens", "ids_crc32"],
        )


def describe_tokens(rows: DataFrame) -> DataFrame:
    """For each stored document: ``start`` (ids of all documents before it), ``n_tokens`` and the crc32 of its ids."""
    schema = "doc_id long, block int, first_token long, n_tokens long, ids_crc32 long"
    read = rows.select("doc_id", "block", "first_token", "ids").mapInArrow(_checker, schema)
    sizes = rows.groupBy("block").agg(F.sum("n_tokens").alias("total"))  # one row a file, from a small column
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.select("block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    return read.join(totals, "block").select("doc_id", (F.col("before") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
