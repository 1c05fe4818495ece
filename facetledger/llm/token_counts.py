"""Exact token counts at every prefix of a text.

The count of a prefix is the count of the prefix without its last piece plus that piece's tokens, so one pass over the
pieces of a text gives the counts of all its prefixes. Truncation and budget questions are then answered from the stored
counts, without the tokenizer.

Defined results: null counts as empty, an empty text has no prefix and no token, repeated rows are counted one by one,
extra columns are kept, columns named like the operator's own are replaced. A text of any length is one row; a task holds
a few megabytes of text at a time, or one longer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetledger.llm.memo import PieceCounts, gather, piece_counts
from facetledger.llm.text import buffer_of, hash_runs, slices

TOTALS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
PREFIXES = T.StructType([T.StructField("prefix_bytes", T.ArrayType(T.IntegerType())), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[first])


def _prefixes(counts: PieceCounts, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and tokens of each prefix that ends with a piece (or with a character inside a piece), and the first prefix of
    each text. A ▁ in a text is taken as the space it stands for, but counts its own bytes."""
    raw, starts, ends, first = counts.pieces(data, offsets)
    begin, size = counts.table.look_up(raw, starts, ends, hash_runs(np.frombuffer(raw, np.uint8), starts, ends - starts))
    tokens = gather(counts.table.flat, begin, size).astype(np.int64)
    last = np.cumsum(size) - 1
    before = np.concatenate(([0], np.cumsum(tokens[last])))[:-1] if len(last) else np.zeros(0, np.int64)
    tokens += np.repeat(before, size)
    first = np.concatenate(([0], np.cumsum(size)))[first]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    tokens -= np.concatenate(([0], tokens))[first[:-1]][text]
    # Characters: of the texts with the space in front of each that is not empty.
    characters = (data & 0xC0) != 0x80
    size_of = np.diff(np.append(np.flatnonzero(characters), len(data)))
    per_text = np.add.reduceat(np.append(characters, False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0)
    begins = np.concatenate(([0], np.cumsum(per_text)))
    widths = np.insert(size_of, begins[:-1][per_text > 0], 0)  # the space in front has no byte
    if counts.every:
        steps = widths
    else:
        letters = np.frombuffer(raw, np.uint8)
        at = np.concatenate(([0], np.cumsum((letters & 0xC0) != 0x80)))
        steps = np.add.reduceat(widths, at[starts]) if len(starts) else widths
    reach = np.cumsum(steps)
    reach -= np.concatenate(([0], reach))[first[:-1]][text] if len(text) else 0
    return reach, tokens, first


def _counter(model: str, names: list[str], schema: pa.Schema, grain: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(model, grain == "character")
        for batch in batches:
            for part in slices(batch):
                data, offsets = buffer_of(part.column("text"))
                columns = [part.column(n) for n in names] + [pa.array(np.diff(offsets), pa.int64())]
                if grain is None:  # the last prefix only
                    tokens, _, first = counts.count(data, offsets)
                    columns.append(pa.array(_sums(tokens, first), pa.int64()))
                else:
                    reach, tokens, first = _prefixes(counts, data, offsets)
                    last = np.where(np.diff(first) > 0, np.append(tokens, 0)[np.maximum(first[1:] - 1, 0)], 0)
                    kept = reach > 0  # the model's own space in front of a text is no prefix of it
                    ends = np.concatenate(([0], np.cumsum(kept)))[first]
                    columns.append(pa.array(last, pa.int64()))
                    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[kept], pa.int32())) for x in (reach, tokens)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def prefix_counts(docs: DataFrame, model: str, grain: str | None = "word", columns: list[str] | None = None) -> DataFrame:
    """Documents with ``n_bytes``, ``n_tokens`` and, for each prefix, ``prefix_bytes`` and ``prefix_tokens``.

    ``grain``: prefixes that end with a word or line end (``word``), all prefixes of whole characters (``character``), or
    the whole text alone (None). ``model``: path of a sentencepiece file on every machine.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = TOTALS.fields + (PREFIXES.fields if grain else [])
    names = [c for c in (columns or docs.columns) if c not in {f.name for f in own}]
    schema = T.StructType([f for f in docs.schema.fields if f.name in names] + own)
    read = docs.select(*names, *([] if "text" in names else ["text"]))
    return read.mapInArrow(_counter(model, [f.name for f in schema.fields if f.name in names], to_arrow_schema(schema), grain), schema)


def bytes_within(budget: Column | int) -> Column:
    """Bytes of the longest stored prefix with at most ``budget`` tokens."""
    fits = F.filter(F.arrays_zip("prefix_bytes", "prefix_tokens"), lambda x: x["prefix_tokens"] <= (F.lit(budget) if isinstance(budget, int) else budget))
    return F.coalesce(F.array_max(F.transform(fits, lambda x: x["prefix_bytes"])), F.lit(0))


def tokens_within(size: Column | int) -> Column:
    """Tokens of the longest stored prefix with at most ``size`` bytes."""
    fits = F.filter(F.arrays_zip("prefix_bytes", "prefix_tokens"), lambda x: x["prefix_bytes"] <= (F.lit(size) if isinstance(size, int) else size))
    return F.coalesce(F.try_element_at(F.transform(fits, lambda x: x["prefix_tokens"]), F.lit(-1)), F.lit(0))
