"""Rows of one group met inside a task, and groups cut into blocks that meet pair by pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Each batch as arrays; a column of lists becomes an array of arrays."""
    for batch in batches:
        rows = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if pa.types.is_list(column.type):
                ends, values = column.offsets.to_numpy().tolist(), column.values.to_numpy()
                rows[name] = np.empty(batch.num_rows, object)
                for k in range(batch.num_rows):
                    rows[name][k] = values[ends[k] : ends[k + 1]]
            else:
                rows[name] = column.to_numpy(zero_copy_only=False)
        yield rows


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of rows that are sorted by their keys: several groups at a time, never a part of one."""
    kept: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([x[c] for x in kept]) for c in kept[0]} if len(kept) > 1 else kept[0]

    last_of = lambda x, k: x[k][-1]
    for rows in columns_of(batches):
        if not len(rows[keys[0]]):
            continue
        same = np.logical_and.reduce([rows[k] == last_of(rows, k) for k in keys])
        if same.all() and (not kept or all(last_of(kept[-1], k) == last_of(rows, k) for k in keys)):
            kept.append(rows)  # one group goes on
            continue
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        kept.append({c: x[:cut] for c, x in rows.items()})
        yield joined()
        kept = [{c: x[cut:] for c, x in rows.items()}]
    if kept:
        yield joined()


def each_group(rows: dict[str, np.ndarray], *keys: str) -> Iterator[slice]:
    """Where each group lies among sorted rows."""
    change = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])
    edges = np.concatenate(([0], 1 + np.flatnonzero(change), [len(rows[keys[0]])])).tolist()
    return (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True))


BLOCK_VALUES = 1 << 20  # values of all sets in a block


def in_blocks(rows: DataFrame, group: str, block: int, size: str | None = None) -> DataFrame:
    """Deals the rows (which have an ``id``) of each group to blocks by hash, and copies each to the cells in which its block
    meets every block of the group, its own included. A block has about ``block`` rows, or fewer, if their values (the
    column ``size``) add up to more than ``BLOCK_VALUES``. Adds ``block``, and ``low`` and ``high`` of the cell; every two
    rows of a group are together in one cell whose blocks are theirs."""
    values = F.sum(F.col(size).cast("long")) if size else F.lit(0)
    sizes = rows.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(values / BLOCK_VALUES)).cast("long").alias("_blocks"))
    dealt = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id"), "_blocks"))
    copies = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return copies.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_blocks", "_other")


def met(cells: DataFrame, group: str) -> DataFrame:
    """The rows of a cell side by side."""
    return cells.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", "id")


def common_counts(lists: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values every two lists of distinct values share, by products of their membership tables."""
    n = len(lists)
    common = np.zeros((n, n), np.float32)
    if not n:
        return common
    _, column = np.unique(np.concatenate(lists), return_inverse=True)
    column = column.ravel()
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    many = np.bincount(column) > 1
    number, keep = np.cumsum(many) - 1, many[column]
    row, column = row[keep], number[column[keep]]
    for start in range(0, int(many.sum()), width):
        mine = (column >= start) & (column < start + width)
        table = np.zeros((n, min(width, int(many.sum()) - start)), np.float32)
        table[row[mine], column[mine] - start] = 1
        common += table @ table.T
    return common


def spanning(left: np.ndarray, right: np.ndarray, n: int, root: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the given links connect, without a circle. A list of n numbers, 0 to n - 1 at first, that is
    given to several calls spares what earlier ones have connected."""
    root = list(range(n)) if root is None else root

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out
