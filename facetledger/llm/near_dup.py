"""Near-duplicate documents by MinHash with tensored banding.

Each document gets two collections of ``rows`` half keys, a half key being ``depth`` minhashes. A table key is a pair of
half keys, one of each collection: rows * rows tables of 2 * depth minhashes each, from 2 * rows * depth minhashes in all
instead of their square. There are as many rows as it takes for two sets at the least similarity to share a table with
probability 0.99995 (12 of 3 minhashes for 0.85); the chance grows with the similarity. Candidates are confirmed on the
full sets.

A table key can hold very many documents, so pairs inside a key are never formed as rows. Equal sets are one node from the
start. Nodes that share a table key, directly or over others, are a neighbourhood; it is cut into blocks of bounded numbers
of sets and of shingles, and two blocks meet in one task. There sizes and 2-bit sketches of all pairs are compared first (a pair of similarity 0.85 differs in 8
of 72 sketch entries on average, and the limit lies six standard deviations above). Nodes with a candidate meet once more
with their full sets, by products of membership tables, and a task tells only as many links as it takes to connect what it
found connected. The candidates, at the table keys and by the sketches, are the only step with a chance of a miss (each below
0.0001 for a pair at the least similarity, and far less above it); what is found is confirmed exactly.

Defined results: a document without words, a null text and a null id are linked with nothing; rows with one id are one
document; the component is the smallest id that can be reached; repeated rows and equal texts are links; extra columns
don't matter. A text of any length is one row; a set that is larger than a block is a block of its own. ``keep_one`` keeps
one row of an id: of different texts the one that is smallest as text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetledger.llm.components import components
from facetledger.llm.groups import common_counts, each_group, in_blocks, met, spanning, whole_groups
from facetledger.llm.text import NOT_SPACE, buffer_of, distinct_runs, find_words, mix, shingles, slices
from facetledger.runtime import stage

BLOCK = 512
ID_BITS = 1 << 23
_LOW_BITS = 0x5555555555555555


@dataclass(frozen=True)
class Bands:
    """Words in a shingle, least similarity in percent, minhashes in a half key; rows and sketch limit follow."""

    size: int = 3
    percent: int = 85
    depth: int = 3
    miss: float = 5e-5

    @property
    def rows(self) -> int:
        return math.ceil(math.log(self.miss / 2) / math.log(1 - (self.percent / 100) ** self.depth))

    @property
    def hashes(self) -> int:
        return 2 * self.rows * self.depth

    @property
    def numbers(self) -> int:
        """64-bit numbers that hold a sketch of two bits a hash."""
        return (self.hashes + 31) // 32

    @property
    def limit(self) -> int:
        differ = 0.75 * (1 - self.percent / 100)
        return math.ceil(self.hashes * differ + 6 * math.sqrt(self.hashes * differ * (1 - differ)))


NEAR = Bands()


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return x[:n], x[n:] | np.uint64(1)


def sketch(values: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """For sets that are not empty: 2 * rows half keys, and the last two bits of each minhash (32 in a number)."""
    sets = len(first) - 1
    flips, factors = _seeds(bands.hashes)
    keys, bits = np.zeros((sets, 2 * bands.rows), np.uint64), np.zeros((sets, bands.numbers), np.uint64)
    for k in range(bands.hashes):
        least = mix(np.minimum.reduceat((values ^ flips[k]) * factors[k], first[:-1]))
        row = k // bands.depth
        keys[:, row] = mix(keys[:, row] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(row))
        bits[:, k // 32] |= (least & np.uint64(3)) << np.uint64(2 * (k % 32))
    return keys, bits


def _sketcher(bands: Bands) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, first = distinct_runs(*shingles(find_words(*buffer_of(part.column("text")), NOT_SPACE), bands.size))
                counts = np.diff(first)
                some = np.flatnonzero(counts)
                marks = np.zeros((2, part.num_rows), np.uint64)
                keys, bits = np.zeros((part.num_rows, 2 * bands.rows), np.uint64), np.zeros((part.num_rows, bands.numbers), np.uint64)
                if len(some):
                    begins = first[some]
                    for k in (0, 1):
                        marks[k, some] = np.add.reduceat(mix(values ^ np.uint64(0xA0761D6478BD642F + k)), begins)
                    keys[some], bits[some] = sketch(values, np.append(begins, len(values)), bands)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, bits)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), *lists],
                    names=["doc_id", "n_shingles", "mark_a", "mark_b", "halves", "bits"],
                )

    return run


def sketches(docs: DataFrame, bands: Bands = NEAR) -> DataFrame:
    """For each row: doc_id, n_shingles, a 128-bit mark of the set, half keys, sketch bits."""
    schema = "doc_id long, n_shingles long, mark_a long, mark_b long, halves array<long>, bits array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketcher(bands), schema)


def table_keys(nodes: DataFrame, rows: int) -> DataFrame:
    """key and id for all table keys made of half keys that some other node has too."""
    halves = nodes.select("id", F.posexplode("halves").alias("at", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    both = halves.join(shared, "half").groupBy("id").agg(
        F.collect_list(F.when(F.col("at") < rows, F.col("half"))).alias("left"), F.collect_list(F.when(F.col("at") >= rows, F.col("half"))).alias("right"),
    )
    pairs = F.flatten(F.transform("left", lambda x: F.transform(F.col("right"), lambda y: F.xxhash64(x, y))))
    return both.select("id", F.explode(pairs).alias("key"))


def neighbourhoods(nodes: DataFrame, rows: int) -> DataFrame:
    """node, component for all nodes that share a table key with another, directly or over others."""
    keys = stage(table_keys(nodes, rows))
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("key", "leader")
    return components(keys.join(leaders, "key").select(F.col("id").alias("u"), F.col("leader").alias("v")))


def _candidates(bands: Bands) -> Callable:
    """The rows of each cell that have a candidate there: sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "component", "low", "high"):
            found = [np.zeros(0, np.int64)]
            for at in each_group(rows, "component", "low", "high"):
                n, block = rows["n"][at], rows["block"][at]
                if len(n) < 2:
                    continue
                bits = np.stack(rows["bits"][at]).view(np.uint64)
                crossing = rows["low"][at][0] != rows["high"][at][0]
                active = np.zeros(len(n), bool)
                for k in range(0, len(n), 256):  # a strip of rows against all
                    part = slice(k, k + 256)
                    small, large = np.minimum(n[part, None], n[None, :]), np.maximum(n[part, None], n[None, :])
                    fits = 100 * small >= bands.percent * large
                    if crossing:  # pairs inside one block meet in that block's own cell
                        fits &= block[part, None] != block[None, :]
                    fits[np.arange(len(fits)), np.arange(k, k + len(fits))] = False
                    differ = np.zeros(fits.shape, np.uint8)
                    for w in range(bits.shape[1]):
                        x = bits[part, None, w] ^ bits[None, :, w]
                        differ += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_LOW_BITS))
                    active[part] = (fits & (differ <= bands.limit)).any(1)
                found.append(np.flatnonzero(active) + at.start)
            keep = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][keep]) for c in CELL], names=list(CELL))

    return run


CELL = ("component", "low", "high", "id", "block")


def _links(bands: Bands) -> Callable:
    """Links that connect what the full sets of each cell's rows connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "component", "low", "high"):
            out = []
            for at in each_group(rows, "component", "low", "high"):
                lists, ids = list(rows["values"][at]), rows["id"][at]
                sizes, common = np.array([len(x) for x in lists]), common_counts(lists)
                linked = np.triu((100 * common >= bands.percent * (sizes[:, None] + sizes[None, :] - common)) & (common > 0), 1)
                out += [(ids[a], ids[b]) for a, b in spanning(*np.nonzero(linked), len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """id and the distinct shingle hashes of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, first = distinct_runs(*shingles(find_words(*buffer_of(part.column("text")), NOT_SPACE), size))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "values"])

    return texts.mapInArrow(run, "id long, values array<long>")


def likely_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents whose ids are listed, and of some others: those that share a place in a bit table of
    fixed size (by id modulo its bits). It spares most other texts the shuffle of a join on the id. The table is at most
    ``ID_BITS / 64`` rows, whatever the ids, and its bits are tested in the scan."""
    place = F.pmod("id", F.lit(ID_BITS))
    bits = ids.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("_part")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_bits"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("_place", place)
    found = rows.join(F.broadcast(bits), F.expr("cast(_place div 64 as int) = _part"))
    return found.where("getbit(_bits, cast(_place % 64 as int)) = 1").select("id", "text")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents whose ids are listed."""
    return likely_rows(docs, ids).join(ids, "id", "left_semi")


def find_components(docs: DataFrame, bands: Bands = NEAR) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, kept (whether the document is the one of its component)."""
    rows = stage(sketches(docs, bands))
    mark = ["n_shingles", "mark_a", "mark_b"]
    linkable = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = linkable.groupBy(*mark).agg(F.min(F.struct("doc_id", "halves", "bits")).alias("x"))
    nodes = stage(nodes.select(*mark, F.col("x.doc_id").alias("id"), F.col("x.halves").alias("halves"), F.col("x.bits").alias("bits")))
    members = neighbourhoods(nodes, bands.rows).join(nodes.select(F.col("id").alias("node"), F.col("n_shingles").alias("n"), "bits"), "node").withColumnRenamed("node", "id")
    near = stage(met(in_blocks(members, "component", BLOCK, "n"), "component").mapInArrow(_candidates(bands), ", ".join(f"{c} long" for c in CELL)))
    sets = stage(full_sets(texts_of(docs, near.select("id").distinct()), bands.size))
    found = stage(met(near.join(sets, "id"), "component").mapInArrow(_links(bands), "u long, v long"))
    # A node is a set; an id that has several sets links them.
    named = linkable.select(*mark, "doc_id").distinct()
    several = named.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id")
    named = named.join(several, "doc_id").join(nodes.select(*mark, "id"), mark)
    same = named.select("doc_id", "id").join(named.groupBy("doc_id").agg(F.min("id").alias("v")), "doc_id").select(F.col("id").alias("u"), "v").where("u <> v")
    labels = components(found.unionByName(same))
    homes = nodes.select(*mark, "id").join(labels, F.col("id") == F.col("node"), "left").select(*mark, F.coalesce("component", "id").alias("home"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("home", "doc_id"))
    return rows.join(homes, mark, "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, bands: Bands = NEAR) -> DataFrame:
    """One row of each component: the document with the smallest id. Rows without an id stay."""
    kept = find_components(docs, bands).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    several = named.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("doc_id")
    one = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text"), F.xxhash64(*docs.columns))
    first = named.join(several, "doc_id", "left_semi").withColumn("_rank", F.row_number().over(one)).where("_rank = 1").drop("_rank")
    alone = named.join(several, "doc_id", "left_anti")
    return alone.unionByName(first).unionByName(docs.where("doc_id is null")).select(*docs.columns)
