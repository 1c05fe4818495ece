"""Word hashing of whole Arrow text columns, in slices of bounded size.

A word class is a set of bytes, so words are found and hashed on the UTF-8 buffers without a Python string per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Texts come in batches of some megabytes from here on: by rows alone a batch of long texts would be many times that,
    in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != f"{BATCH_BYTES}b":
        spark.conf.set(name, f"{BATCH_BYTES}b")


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that is true for the bytes of the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Every byte but white space: the class [^\x20\x09-\x0D].
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and digits and all of the rest of Unicode: the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, or one row if a single text is longer."""
    _, offsets = buffer_of(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and where each row begins (one more entry for the end). Null is empty."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """All words of some texts: 64-bit hash, first byte and end byte in the joint buffer; where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> Words:
    """The maximal runs of bytes of a class inside each text, hashed after lower-casing A-Z."""
    raw = data.tobytes()
    if lower:
        raw = raw.lower()  # of bytes: A-Z only
        data = np.frombuffer(raw, np.uint8)
    inside = np.frombuffer(raw.translate(table.view(np.uint8).tobytes()), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edges = np.concatenate(([0], edges))
    if len(data) and inside[-1]:
        edges = np.append(edges, len(data))
    cuts = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # a word ends and another begins where two texts meet
    if len(cuts):
        edges = np.sort(np.concatenate((edges, cuts, cuts)))
    starts, ends = edges[::2], edges[1::2]
    return Words(hash_runs(data, starts, ends - starts), starts, ends, np.searchsorted(starts, offsets))


def hash_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes: eight at a time, mixed one after the other into its length."""
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(9, np.uint8))), strides=(1,))
    value = lengths.astype(np.uint64)
    at, starts, left = slice(None), starts, lengths
    while len(left):
        part = eights[starts]
        spare = np.maximum(8 - left, 0).astype(np.uint64) << np.uint64(3)
        part = (part << spare) >> spare
        value[at] = mix(value[at] * BASE + part)
        longer = np.flatnonzero(left > 8)
        at = longer if isinstance(at, slice) else at[longer]
        starts, left = starts[longer] + 8, left[longer] - 8
    return value


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text (all its words as one run if it has fewer, none if it has no
    words), and where each text's runs begin."""
    counts = words.counts
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate(([0], np.cumsum(runs)))
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) - np.repeat(first[:-1], runs) + np.repeat(words.first[:-1], runs)
    width = np.repeat(np.minimum(counts, size), runs)
    padded = np.concatenate((words.hashes, np.zeros(size, np.uint64)))
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        value = np.where(k < width, mix(value * BASE + padded[at + k]), value)
    return value, first


def distinct_runs(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's values begin."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[first]
