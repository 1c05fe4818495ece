"""Near-duplicate vectors: int8 tile products with error bounds, full precision where a pair may reach the threshold.

A vector u of length one is stored as q * s, q being int8 and s its own step; e is the length of u - q * s. For any two,
the cosine lies within e1 + e2 + e1 * e2 of s1 * s2 * (q1 . q2), and q1 . q2 is exact: products of int8 are added up in
float32, at most 1,024 components at a time, which is below 2**24. So a pair below the threshold by more than the bound is
not linked, for certain; every other pair is computed in double precision from the vector itself.

Equal vectors are one node from the start. Nodes are dealt to blocks by hash, one row a block, and each block meets each
other one and itself once, in a tile. Within a tile all pairs of a strip of nodes are looked at together, and a pair is
never a row: a tile returns each node's linked vectors as a sum, and for each connected set as many links as connect it.
A pair so near to the threshold that the order of adding could decide is settled by a correctly rounded sum.

Defined results: a vector that is null, empty, zero, or holds a null or a component that is not finite links with nothing
(no links, its own component), and so does a row without an id (its component is null); vectors of different numbers of
components don't link; each row is a vector, so a repeated row is one more link, and rows with one id are in one component;
the component is the smallest id that can be reached; a very long vector makes its block smaller; extra columns don't
matter, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetledger.llm.components import components
from facetledger.llm.groups import each_group, whole_groups
from facetledger.runtime import stage

THRESHOLD = 0.9
BLOCK_BYTES = 10 << 20  # of quantised and full vectors in a block
BLOCK_ROWS = 16_384
LEAST_BLOCKS = 12  # of a table that has more rows than a block of this many
LEAST_ROWS = 1_024
STRIP_PAIRS = 1 << 21
EXACT_WIDTH = 1_024
PAIRS_AT_ONCE = 1 << 16
DENSE = 0.02  # share of a strip's pairs from which on a full-precision product of the strip costs less than single pairs
NEAR_TIE = 1e-12
SLACK = 1e-9  # far above the rounding of the bounds themselves


def usable_vectors(x: np.ndarray) -> np.ndarray:
    """Which rows of a table of doubles are finite and not zero."""
    return np.isfinite(x).all(1) & (x != 0).any(1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to one half up to one, so that squares neither
    overflow nor vanish."""
    _, power = np.frexp(np.abs(x).max(1))
    return np.ldexp(x, -power[:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, step and error length of each row, after it is brought to length one."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    step = np.abs(unit).max(1) / 127
    q = np.rint(unit / step[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * step[:, None]) ** 2).sum(1))
    return q, step, error


def _rows_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with equally many components, none of them null, as one table of doubles, and their numbers."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes nan
    ends = column.offsets.to_numpy()
    sizes = np.where(np.asarray(column.is_valid()), np.diff(ends), 0)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, values[ends[at][:, None] + np.arange(dim)]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data: list[bytes | None] = [None] * batch.num_rows
        dims = np.zeros(batch.num_rows, np.int32)
        for at, x in _rows_of(batch.column("embedding")):
            good = usable_vectors(x)
            for i, row in zip(at[good].tolist(), x[good] + 0.0, strict=True):  # no negative zeros
                data[i] = row.tobytes()
            dims[at[good]] = x.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims), pa.array(data, pa.binary())], names=["vec_id", "dim", "x"])


def read_vectors(vectors: DataFrame) -> DataFrame:
    """For each row: vec_id, mark (of the exact vector, null if the row takes no part), dim, x (doubles)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = rows.mapInArrow(_reader, "vec_id long, dim int, x binary")
    return read.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.sha2("x", 256)).alias("mark"), "dim", "x")


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: ids, how many vectors each node stands for, quantised and full vectors, steps, errors."""
    for rows in whole_groups(batches, "dim", "block"):
        out: list[list] = [[] for _ in range(8)]
        for at in each_group(rows, "dim", "block"):
            x = scaled(np.frombuffer(b"".join(rows["x"][at].tolist())).reshape(at.stop - at.start, -1))
            for to, value in zip(out, (int(rows["dim"][at][0]), int(rows["block"][at][0]), rows["id"][at].tobytes(), rows["n"][at].tobytes(), *(v.tobytes() for v in quantise(x)), x.tobytes()), strict=True):
                to.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(v, pa.binary()) for v in out[2:])], names=list(PACKED))


PACKED = {"dim": "int", "block": "long", "ids": "binary", "ns": "binary", "q": "binary", "step": "binary", "error": "binary", "x": "binary"}


def packed(nodes: DataFrame, blocks: int) -> DataFrame:
    dealt = nodes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    sorted_ = dealt.repartition("dim", "block").sortWithinPartitions("dim", "block", "id")
    return sorted_.select("dim", "block", "id", "n", "x").mapInArrow(_packer, ", ".join(f"{c} {t}" for c, t in PACKED.items()))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows."""
    if left.shape[1] <= EXACT_WIDTH:
        return left.astype(np.float32) @ right.astype(np.float32).T
    total = np.zeros((len(left), len(right)))
    for k in range(0, left.shape[1], EXACT_WIDTH):
        part = slice(k, k + EXACT_WIDTH)
        total += left[:, part].astype(np.float32) @ right[:, part].astype(np.float32).T
    return total


def _settled(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the cosine in exact arithmetic, rounded once, reaches the threshold."""
    sums = [math.fsum(a * b for a, b in zip(u.tolist(), v.tolist(), strict=True)) for u, v in ((x, y), (x, x), (y, y))]
    return sums[0] / math.sqrt(sums[1] * sums[2]) >= threshold


class Side:
    """A block's nodes, unpacked."""

    def __init__(self, row: dict) -> None:
        self.ids, self.ns = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ns"], np.int64)
        self.q = np.frombuffer(row["q"], np.int8).reshape(len(self.ids), -1)
        self.step, self.error = np.frombuffer(row["step"]), np.frombuffer(row["error"])
        self.x = np.frombuffer(row["x"]).reshape(len(self.ids), -1)
        self.squares = (self.x * self.x).sum(1)


def possible(left: Side, part: slice, right: Side, threshold: float) -> np.ndarray:
    """Which pairs of a strip of nodes with a block may reach the threshold, going by the quantised vectors."""
    worst = left.error[part] + right.error.max() * (1 + left.error[part]) + SLACK
    dots = products(left.q[part], right.q)
    step = left.step[part] * np.where(threshold > worst, right.step.max(), right.step.min())
    i, j = np.nonzero(dots >= np.floor((threshold - worst) / step)[:, None])  # by the worst of the block
    e, f = left.error[part][i], right.error[j]
    near = dots[i, j] * (left.step[part][i] * right.step[j]) >= threshold - (e + f + e * f) - SLACK
    return np.stack([i[near], j[near]])


def linked_pairs(left: Side, part: slice, right: Side, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of a strip with a block; in a block's own tile each pair once."""
    i, j = possible(left, part, right, threshold)
    if same:
        i, j = i[j > i + part.start], j[j > i + part.start]
    if len(i) > DENSE * (part.stop - part.start) * len(right.ids):
        cosines = (left.x[part] @ right.x.T)[i, j]
    else:
        cosines = np.empty(len(i))
        for k in range(0, len(i), PAIRS_AT_ONCE):
            some = slice(k, k + PAIRS_AT_ONCE)
            cosines[some] = np.einsum("ab,ab->a", left.x[part][i[some]], right.x[j[some]])
    cosines /= np.sqrt(left.squares[part][i] * right.squares[j])
    linked = cosines >= threshold
    for k in np.flatnonzero(np.abs(cosines - threshold) <= NEAR_TIE).tolist():
        linked[k] = _settled(left.x[part][i[k]], right.x[j[k]], threshold)
    return i[linked] + part.start, j[linked]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of the pairs; a label is the least number of its class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = x[apart], y[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def tile(left: Side, right: Side, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with linked vectors and the number of these, and links that connect what is linked."""
    ids = left.ids if same else np.concatenate([left.ids, right.ids])
    shift = 0 if same else len(left.ids)
    label, linked = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    strip = max(1, STRIP_PAIRS // len(right.ids))
    for k in range(0, len(left.ids), strip):
        i, j = linked_pairs(left, slice(k, min(k + strip, len(left.ids))), right, threshold, same)
        linked += np.bincount(i, right.ns[j], len(ids)).astype(np.int64) + np.bincount(j + shift, left.ns[i], len(ids)).astype(np.int64)
        unite(label, i, j + shift)
    some, joined = np.flatnonzero(linked), np.flatnonzero(label != np.arange(len(ids)))
    return ids[some], linked[some], ids[joined], ids[label[joined]]


def _tiler(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if row["low"] != row["high"] and [row[c] for c in ("dim", "low", "high")] != [first.get(c) for c in ("dim", "low", "high")]:
                    first = row  # the other block of the tile comes next, if there is one
                    continue
                other = row if row["low"] == row["high"] else first
                one = Side(row)
                ids, linked, u, v = tile(one, one if other is row else Side(other), threshold, other is row)
                count = len(ids) + len(u)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids, u])), pa.array(np.concatenate([linked, np.zeros(len(u), np.int64)])), pa.array(np.concatenate([np.zeros(len(ids), np.int64), v]), mask=np.arange(count) < len(ids))],
                    names=["id", "linked", "v"],
                )

    return run


def find_links(nodes: DataFrame, size: int, dim: int, threshold: float) -> DataFrame:
    """id and linked (vectors of other nodes), summed by tile; or with ``v`` one of the links that connect the nodes."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (9 * max(dim, 1) + 32)))
    blocks = max(1, math.ceil(size / rows), min(LEAST_BLOCKS, size // LEAST_ROWS))
    table = stage(packed(nodes, blocks))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    copies = table.withColumn("other", others).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    met = copies.drop("other", "block").repartition(max(1, blocks * (blocks + 1) // 2), "dim", "low", "high").sortWithinPartitions("dim", "low", "high")
    return met.mapInArrow(_tiler(threshold), "id long, linked long, v long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each row: vec_id, n_links (other rows linked directly), component_id, kept (whether the id is its component's)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0, up to 1")
    rows = stage(read_vectors(vectors))
    part = rows.where("mark is not null")
    nodes = stage(part.groupBy("mark", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("x").alias("x")).withColumn("id", F.monotonically_increasing_id()))
    size, dim = nodes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    found = stage(find_links(nodes.select("dim", "id", "n", "x"), size, dim, threshold))
    linked = found.where("v is null").groupBy("id").agg(F.sum("linked").alias("linked"))
    # An id that has several vectors connects them.
    named = part.select("vec_id", "mark").distinct()
    several = named.groupBy("vec_id").agg(F.count("*").alias("marks")).where("marks > 1").select("vec_id")
    own = named.join(several, "vec_id").join(nodes.select("mark", "id"), "mark")
    same = own.join(own.groupBy("vec_id").agg(F.min("id").alias("v")), "vec_id").select(F.col("id").alias("u"), "v").where("u <> v")
    classes = components(found.where("v is not null").select(F.col("id").alias("u"), "v").unionByName(same)).withColumnRenamed("node", "id")
    placed = classes.join(nodes.select("id", "least"), "id")
    homes = placed.join(placed.groupBy("component").agg(F.min("least").alias("home")), "component").select("id", "home")
    known = nodes.select("id", "mark", "n", "least").join(linked, "id", "left").join(homes, "id", "left").select(
        "mark", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("home", "least").alias("home"),
    )
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("home", "vec_id"))
    return rows.select("vec_id", "mark").join(known, "mark", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
