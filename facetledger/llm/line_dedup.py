"""Near-equal lines across documents: an exact set-similarity join, and removal of later matches.

A line is the set of its words. Words are ordered by rarity; two sets of Jaccard similarity 0.8 share a word among the
first n - ceil(0.8 n) + 1 of each (of the smaller set even among fewer). Sets meet at such a word if their lengths, the
places of the word and the parities of their words in 64 bits (128 or 512 for longer lines) allow that similarity; all three tests
are exact bounds.

A word can lead very many sets, and near copies are similar to one another in great numbers, so no pair becomes a row. A
word's sets are dealt to cells of bounded size, and whole cells to parts of bounded size, to which a task sends its entries
packed, many in a row; a cell is known there by 32 bits, as a wrong meeting only costs a comparison. A task tells only as
many candidates as it takes to connect what it found connected. Sets that candidates connect are a neighbourhood, and all links lie inside one. It is cut into blocks of full
sets, and a block is verified against a block in one product of matrices: each set's links and its earliest similar line,
and again only as many links as connect the set's class.

Rarity is counted over all lines in ``COUNT_BUCKETS`` buckets of words, a table of fixed size; words that share a bucket
count as equally common and are ordered by their hashes. A word's key is the place of its bucket in this order before the
other bits of its 64-bit hash, so keys tell words apart as the hashes do. A set meets others at a prefix word only if a
table of fixed size does not show that no other set has it. Sets, words and classes are known by 64-bit hashes.

Defined results: lines are what lies between line ends, a null or empty text has none; a line without words is never
matched; earlier means the smaller document id, then the smaller line number; a null id is neither matched nor counted as
earlier; rows with one id count as one document, so that equal lines of theirs with one number are the same line; a text or
line of any length is one row; other columns are kept by ``without_later_matches`` and don't matter elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetledger.llm.components import components
from facetledger.llm.groups import common_counts, each_group, in_blocks, met, spanning, whole_groups
from facetledger.llm.near_dup import likely_rows
from facetledger.llm.text import ALNUM, buffer_of, distinct_runs, find_words, mix, slices
from facetledger.runtime import stage

PERCENT = 80
COUNT_BUCKETS = 1 << 18
SHARED_BUCKETS = 1 << 22
CELL = 20_000
BLOCK = 512
PAIRS_AT_ONCE = 1 << 18
PART = 1 << 18  # entries that meet in one step of a task
HELD = 1 << 18  # entries that a task packs together
SLICE = 1 << 19  # bytes of text at a time: their words fit a cache
SHORT = 64  # lines of at most so many words keep 64 parities: the two numbers folded into one
LONG = 200
MORE = 6  # further 64-bit numbers of parities for lines of more than LONG words
LINES = "doc_id long, line int, id long, n int, bits_a long, bits_b long, more binary, prefix binary"
LINE_NAMES = [f.split()[0] for f in LINES.split(", ")]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """How many words of all lines fall into each bucket. Each task adds up its own; the parts of the tables are added up in
    as many tasks as there are parts."""
    width = COUNT_BUCKETS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                seen += np.bincount(_bucket(find_words(*buffer_of(part.column("text")), ALNUM).hashes), minlength=COUNT_BUCKETS)
        parts = seen.reshape(64, width)
        own = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([parts[k].tobytes() for k in own.tolist()], pa.binary())], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
                totals[part] = totals.get(part, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["part", "n"])

    counted = docs.select("text").mapInArrow(run, "part int, n binary")
    found = np.zeros(COUNT_BUCKETS, np.int64)
    for part, n in counted.repartition("part").mapInArrow(add, "part int, n binary").collect():  # of a fixed size
        found[part * width : (part + 1) * width] = np.frombuffer(n, np.int64)
    return found


@dataclass(frozen=True)
class Rarity:
    """For each bucket its place from the rarest on; for each place how many cells a word's sets are dealt to (no more sets
    can meet at a word than its bucket counts)."""

    place: np.ndarray
    cells: np.ndarray


def rarity(counts: np.ndarray) -> Rarity:
    order = np.argsort(counts, kind="stable")
    place = np.empty(len(counts), np.uint64)
    place[order] = np.arange(len(counts), dtype=np.uint64)
    return Rarity(place, np.maximum(1, -(-counts[order] // CELL)))


def keys_of(hashes: np.ndarray, rank: Rarity) -> np.ndarray:
    """Numbers that grow with the count of a word's bucket, one for each hash."""
    return (rank.place[_bucket(hashes)] << np.uint64(46)) | (hashes & np.uint64((1 << 46) - 1))


def cells_of(keys: np.ndarray, rank: Rarity) -> np.ndarray:
    """Into how many cells the sets of each word are dealt."""
    return rank.cells[(keys >> np.uint64(46)).astype(np.int64)]


def line_sets(data: np.ndarray, offsets: np.ndarray, rank: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with words: their text, their number in it, their distinct word keys from the rarest on, and where each begins."""
    words = find_words(data, offsets, ALNUM)
    if not len(words.hashes):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    ends = np.flatnonzero(data == 10)
    text = words.text_of()
    line = np.searchsorted(ends, words.starts) - np.searchsorted(ends, offsets[:-1])[text]
    new = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (text[1:] != text[:-1]))))
    values, first = distinct_runs(keys_of(words.hashes, rank), np.append(new, len(words.hashes)))
    return text[new], line[new], values, first


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _more(keys: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """Further parities of the long lines, null for the others."""
    out: list = [None] * len(n)
    for i in np.flatnonzero(n > LONG).tolist():
        place = (mix(keys[first[i] : first[i + 1]] + np.uint64(3)) % np.uint64(64 * MORE)).astype(np.int64)
        odd = (np.bincount(place, minlength=64 * MORE) & 1).astype(np.uint8)
        out[i] = np.packbits(odd).tobytes()
    return pa.array(out, pa.binary())


def _as_binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values as bytes, as the JVM copies an array of numbers one by one."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _keys_in(prefix: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all prefixes, one after the other, and how many each has."""
    prefix = prefix.cast(pa.large_binary())
    if not len(prefix):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, offsets, data = prefix.buffers()
    offsets = np.frombuffer(offsets, np.int64)[prefix.offset : prefix.offset + len(prefix) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint64), np.diff(offsets) // 8


def _earliest(ids: np.ndarray, doc: pa.Array, line: np.ndarray) -> np.ndarray:
    """Of the lines that have a document id the first one of each set."""
    known = np.flatnonzero(doc.is_valid().to_numpy(zero_copy_only=False))
    docs = doc.fill_null(0).to_numpy()
    order = known[np.lexsort((line[known], docs[known], ids[known]))]
    new = np.ones(len(order), bool)
    new[1:] = ids[order[1:]] != ids[order[:-1]]
    return np.sort(order[new])


def _liner(rank, percent: int) -> Callable:
    """Only the first line of a set among those at hand gets its parities and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                data, offsets = buffer_of(part.column("text"))
                text, line, keys, first = line_sets(data, offsets, rank.value)
                n = np.diff(first)
                marks, bits = np.zeros(len(n), np.uint64), np.zeros((2, len(n)), np.uint64)
                if len(n):
                    mixed = mix(keys)
                    marks = np.add.reduceat(mix(mixed + np.uint64(1)), first[:-1])
                    for k in (0, 1):
                        mine = (mixed >> np.uint64(6)) & np.uint64(1) == k
                        bits[k] = np.bitwise_xor.reduceat(np.where(mine, np.uint64(1) << (mixed & np.uint64(63)), np.uint64(0)), first[:-1])
                bits[0] ^= np.where(n <= SHORT, bits[1], np.uint64(0))
                bits[1][n <= SHORT] = 0
                more = _more(keys, first, n)
                size = prefix_sizes(n, percent)
                ends = np.concatenate(([0], np.cumsum(size)))
                at = np.arange(ends[-1]) - np.repeat(ends[:-1] - first[:-1], size)
                doc = part.column("doc_id").take(pa.array(text))
                ends_of = np.concatenate(([0], np.cumsum(data == 10)))[offsets]
                lines = np.where(np.diff(offsets) > 0, np.diff(ends_of) + 1, 0)
                empty = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(part.num_rows, -1), pa.int32()), empty, pa.array(lines, pa.int32()), empty, empty, pa.nulls(part.num_rows, pa.binary()), pa.nulls(part.num_rows, pa.binary())],
                    names=LINE_NAMES,
                )
                full = pa.RecordBatch.from_arrays(
                    [doc, pa.array(line, pa.int32()), pa.array(marks.view(np.int64)), pa.array(n, pa.int32()), pa.array(bits[0].view(np.int64)), pa.array(bits[1].view(np.int64)), more,
                     _as_binary(keys[at], ends)],
                    names=LINE_NAMES,
                )
                lead = _earliest(marks, doc, line)
                yield full.take(pa.array(lead))
                again = full.take(pa.array(np.delete(np.arange(len(n)), lead)))
                yield pa.RecordBatch.from_arrays([*again.columns[:4], *(pa.nulls(again.num_rows, c.type) for c in again.columns[4:])], names=LINE_NAMES)

    return run


SETS = "id long, doc_id long, line int, n int, bits_a long, bits_b long, more binary, prefix binary"


def distinct_sets(lines: DataFrame) -> DataFrame:
    """Each set once, with the earliest of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if len(ids):
                new = np.concatenate(([ids[0] != last], ids[1:] != ids[:-1]))
                last = ids[-1]
                yield batch.filter(pa.array(new))

    known = lines.where("prefix is not null").select(*(f.split()[0] for f in SETS.split(", ")))
    return known.repartition("id").sortWithinPartitions("id", "doc_id", "line").mapInArrow(run, SETS)


def _shared_place(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(11)) >> np.uint64(64 - SHARED_BUCKETS.bit_length() + 1)).astype(np.int64)


def shared_words(nodes: DataFrame, rank) -> tuple[np.ndarray, int]:
    """For each bucket of words whether the prefixes of two sets or more have one of it, and how many entries all words of
    prefixes would give. Each task counts up to two; the parts of the tables are added up in as many tasks as there are parts."""
    width = SHARED_BUCKETS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(SHARED_BUCKETS, np.int32), 0
        for batch in batches:
            keys, _ = _keys_in(batch.column("prefix"))
            np.add.at(seen, _shared_place(keys), 1)
            total += int(cells_of(keys, rank.value).sum())
        parts = np.minimum(seen, 2).astype(np.uint8).reshape(64, width)
        own = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([parts[k].tobytes() for k in own.tolist()], pa.binary()), pa.array(total * (np.arange(len(own)) == 0))], names=["part", "seen", "entries"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        many: dict[int, int] = {}
        for batch in batches:
            for part, seen, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals[part] = totals.get(part, np.zeros(width, np.uint32)) + np.frombuffer(seen, np.uint8)
                many[part] = many.get(part, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([np.packbits(x >= 2).tobytes() for x in totals.values()], pa.binary()), pa.array(list(many.values()), pa.int64())], names=["part", "bits", "entries"])

    counted = nodes.select("prefix").mapInArrow(count, "part int, seen binary, entries long")
    found, total = np.zeros(SHARED_BUCKETS, bool), 0
    for part, bits, n in counted.repartition("part").mapInArrow(add, "part int, bits binary, entries long").collect():  # of a fixed size
        found[part * width : (part + 1) * width] = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        total += n
    return found, total


# An entry as it moves, by the length of its set: of SHORT words at most, of LONG at most, longer. ``meet`` stands for word and
# cell, ``at`` is four times the place in the prefix plus the side of the cell: 0 if all sets of the cell meet, else 1 or 2.
HEAD = [("meet", "<u4"), ("id", "<i8"), ("bits_a", "<u8")]
KINDS = (
    np.dtype([*HEAD, ("n", "u1"), ("at", "u1")]),
    np.dtype([*HEAD, ("bits_b", "<u8"), ("n", "u1"), ("at", "<u2")]),
    np.dtype([*HEAD, ("bits_b", "<u8"), ("n", "<i4"), ("at", "<i8"), ("more", "<u8", (MORE,))]),
)


def _packed(held: list[tuple[np.ndarray, np.ndarray]], kind: int) -> pa.RecordBatch:
    """A row for each part: its entries, one after the other."""
    part, rows = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    columns = [pa.array(part[first]), pa.array(np.full(len(first), kind), pa.int32()), _as_binary(rows, np.append(first, len(part)))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "rows"])


def entries(nodes: DataFrame, rank, shared, parts: int) -> DataFrame:
    """An entry for each set, word of its prefix that other sets may have too, and cell of that word; a cell is a pair of
    subsets, numbered as one. Entries of one part are packed (part, kind, rows); a cell lies in one part."""

    def made(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        keys, sizes = _keys_in(batch.column("prefix"))
        row = np.repeat(np.arange(batch.num_rows), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = np.flatnonzero(shared.value[_shared_place(keys)])
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        bits_a, bits_b = (batch.column(c).to_numpy().view(np.uint64) for c in ("bits_a", "bits_b"))
        subset = (mix(ids.view(np.uint64) + np.uint64(7)) >> np.uint64(1)).astype(np.int64)
        kinds = (n > SHORT).astype(np.int8) + (n > LONG)
        long = np.flatnonzero(kinds == 2)
        number = np.zeros(len(n), np.int64)
        number[long] = np.arange(len(long))
        more = np.frombuffer(b"".join(batch.column("more").take(pa.array(long)).to_pylist()), "<u8").reshape(-1, MORE)
        total = np.cumsum(cells_of(keys[kept], rank.value))
        cuts = np.searchsorted(total, np.arange(HELD, total[-1] if len(total) else 0, HELD))
        for some in np.split(kept, cuts):
            cells = cells_of(keys[some], rank.value)
            copies = np.repeat(some, cells)
            other = np.arange(len(copies)) - np.repeat(np.cumsum(cells) - cells, cells)
            r = row[copies]
            sub = subset[r] % np.repeat(cells, cells)
            low, high = np.minimum(sub, other), np.maximum(sub, other)
            side = np.where(low == high, 0, np.where(sub == low, 1, 2))
            where = mix(keys[copies] ^ mix(((low << 32) | high).view(np.uint64)))
            part = (((where >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
            for kind, layout in enumerate(KINDS):
                mine = np.flatnonzero(kinds[r] == kind)
                if len(mine):
                    x, rows = r[mine], np.empty(len(mine), layout)
                    rows["meet"] = where[mine] & np.uint64(0xFFFFFFFF)
                    rows["id"], rows["n"], rows["bits_a"] = ids[x], n[x], bits_a[x]
                    rows["at"] = 4 * place[copies[mine]] + side[mine]
                    if kind:
                        rows["bits_b"] = bits_b[x]
                    if kind == 2:
                        rows["more"] = more[number[x]]
                    yield kind, part[mine], rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        many = [0, 0, 0]
        for batch in batches:
            for kind, part, rows in made(batch):
                held[kind].append((part, rows))
                many[kind] += len(rows)
                if many[kind] >= HELD:
                    yield _packed(held[kind], kind)
                    held[kind], many[kind] = [], 0
        for kind, x in enumerate(held):
            if x:
                yield _packed(x, kind)

    return nodes.select("id", "n", "bits_a", "bits_b", "more", "prefix").mapInArrow(run, "part int, kind int, rows binary")


def _unpacked(blobs: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
    """The entries of a part sorted by ``key``, which is ``meet`` before n; ``long`` numbers those that have more parities."""
    rows = [np.frombuffer(b"".join([x for k, x in blobs if k == kind]), layout) for kind, layout in enumerate(KINDS)]
    n = np.concatenate([x["n"].astype(np.int64) for x in rows])
    key = (np.concatenate([x["meet"] for x in rows]).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
    at = np.concatenate([x["at"].astype(np.int64) for x in rows])
    bits_b = np.concatenate([np.zeros(len(rows[0]), np.uint64), rows[1]["bits_b"], rows[2]["bits_b"]])
    long = np.concatenate([np.full(len(rows[0]) + len(rows[1]), -1), np.arange(len(rows[2]))])
    order = np.argsort(key)
    out = {"key": key, "n": n, "id": np.concatenate([x["id"] for x in rows]), "place": at >> 2, "side": at & 3, "bits_a": np.concatenate([x["bits_a"] for x in rows]), "bits_b": bits_b, "long": long}
    return {c: x[order] for c, x in out.items()} | {"more": rows[2]["more"]}


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The entries of one part after the other, from rows that are sorted by it."""
    held: list[tuple[int, bytes]] = []
    last = None
    for batch in batches:
        for part, kind, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and part != last:
                yield _unpacked(held)
                held = []
            last = part
            held.append((kind, rows))
    if held:
        yield _unpacked(held)


def candidate_pairs(rows: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one word and cell (sorted by n) that pass length, place and parity bounds. At most some hundred
    thousand pairs are looked at together."""
    key, n, place, side, long, more, one, two = (rows[c] for c in ("key", "n", "place", "side", "long", "more", "bits_a", "bits_b"))
    last = np.searchsorted(key, ((key >> np.uint64(32)) << np.uint64(32)) | (n * 100 // percent).astype(np.uint64), "right")
    # The set that comes first is not longer, so it has a common word among fewer of its first ones.
    leads = place < n - -(-2 * percent * n // (100 + percent)) + 1
    own = np.arange(len(n))
    many = np.where(leads, last - own - 1, 0)
    total = np.cumsum(many)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        some = many[start:end]
        left = np.repeat(own[start:end], some)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some)
        need = -(-percent * (n[left] + n[right]) // (100 + percent))
        fits = np.minimum(n[left] - place[left], n[right] - place[right]) >= need
        fits &= (side[left] == 0) | (side[left] != side[right])
        left, right, need = left[fits], right[fits], need[fits]
        a, b = one[left] ^ one[right], two[left] ^ two[right]
        folded = np.bitwise_count(a ^ b).astype(np.int64)  # the shorter one comes first
        differ = np.where(n[left] <= SHORT, folded, np.bitwise_count(a).astype(np.int64) + np.bitwise_count(b))
        bound = n[left] + n[right] - 2 * need
        fits = differ <= bound
        left, right, bound = left[fits], right[fits], bound[fits]
        both = np.flatnonzero(long[left] >= 0)  # the longer one comes second
        if len(both):
            apart = np.bitwise_count(more[long[left[both]]] ^ more[long[right[both]]]).sum(1) > bound[both]
            left, right = np.delete(left, both[apart]), np.delete(right, both[apart])
        yield left, right
        start = end


def _connecting(percent: int) -> Callable:
    """As many candidates of each part as connect what its candidates connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_parts(batches):
            ids, number = np.unique(rows["id"], return_inverse=True)
            root = list(range(len(ids)))
            for left, right in candidate_pairs(rows, percent):
                links = spanning(number[left], number[right], len(ids), root)
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.array([x[k] for x in links], np.int64)], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def full_sets(docs: DataFrame, wanted: DataFrame, rank) -> DataFrame:
    """id and all word keys of the wanted sets (doc_id, line, id), from the documents that hold them first."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))  # lines of one document
    rows = likely_rows(docs, wanted.select(F.col("doc_id").alias("id"))).join(lists.withColumnRenamed("doc_id", "id"), "id").select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                text, line, keys, first = line_sets(*buffer_of(part.column("text")), rank.value)
                where = {(t, k): i for i, (t, k) in enumerate(zip(text.tolist(), line.tolist(), strict=True))}
                ids, at = [], []
                for t, lines in enumerate(part.column("wanted").to_pylist()):
                    for x in lines:
                        if (i := where.get((t, x["line"]))) is not None:
                            ids.append(x["id"])
                            at.append(i)
                marks = np.add.reduceat(mix(mix(keys) + np.uint64(1)), first[:-1]).view(np.int64) if len(keys) else np.zeros(0, np.int64)
                good = [(x, i) for x, i in zip(ids, at, strict=True) if marks[i] == x]  # rows with one id may differ
                lists_ = [keys[first[i] : first[i + 1]].view(np.int64) for _, i in good]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in good], pa.int64()), pa.array(lists_, pa.list_(pa.int64()))], names=["id", "keys"])

    return rows.mapInArrow(run, "id long, keys array<long>").dropDuplicates(["id"])


def class_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Sets (id, class, doc_id, line, keys) of a neighbourhood, dealt to blocks by hash; two blocks meet in one product. A row
    tells a set's links to others there and the earliest place among them; or, with ``v``, one of the links that connect
    what is linked there."""
    cell = in_blocks(sets.select("class", "id", "doc_id", "line", "keys", F.size("keys").alias("_words")), "class", BLOCK, "_words").drop("_words")

    def products(rows: dict[str, np.ndarray]) -> Iterator[tuple]:
        for at in each_group(rows, "class", "low", "high"):
            lists, block = list(rows["keys"][at]), rows["block"][at]
            if len(lists) < 2:
                continue
            sizes, common = np.array([len(x) for x in lists]), common_counts(lists)
            linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
            np.fill_diagonal(linked, False)
            if rows["low"][at][0] != rows["high"][at][0]:  # pairs inside one block meet in that block's own cell
                linked &= block[:, None] != block[None, :]
            links = linked.sum(1)
            docs, lines, ids = rows["doc_id"][at], rows["line"][at], rows["id"][at]
            order = np.lexsort((lines, docs))
            first = order[np.argmax(linked[:, order], 1)]
            for k in np.flatnonzero(links).tolist():
                yield int(ids[k]), int(links[k]), int(docs[first[k]]), int(lines[first[k]]), None
            for a, b in spanning(*np.nonzero(np.triu(linked)), len(ids)):
                yield int(ids[a]), 0, None, None, int(ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "class", "low", "high"):
            found = list(products(rows))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(5)], names=["id", "links", "first_doc", "first_line", "v"])

    return met(cell, "class").mapInArrow(run, "id long, links long, first_doc long, first_line long, v long")


def find_matches(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, line, id; one more row a document with line -1 and its number of lines as n), and all sets: id,
    class, links, the place of the earliest equal or similar line, the smallest document of the class."""
    rank = docs.sparkSession.sparkContext.broadcast(rarity(word_counts(docs)))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = stage(read.mapInArrow(_liner(rank, percent), LINES))
    whole = stage(distinct_sets(lines))
    found, many = shared_words(whole, rank)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    dealt = entries(whole, rank, shared, max(1, -(-many // PART))).repartition("part").sortWithinPartitions("part")
    near = components(dealt.mapInArrow(_connecting(percent), "u long, v long")).withColumnsRenamed({"node": "id", "component": "class"})
    firsts = whole.select("id", F.struct("doc_id", "line").alias("first"))
    members = stage(near.join(firsts, "id").select("id", "class", "first.doc_id", "first.line"))
    sets = full_sets(read, members.select("doc_id", "line", "id"), rank)
    found = stage(class_links(members.join(sets, "id"), percent))
    links = found.where("v is null").groupBy("id").agg(F.sum("links").alias("links"), F.min(F.struct("first_doc", "first_line")).alias("earliest"))
    labels = components(found.where("v is not null").select(F.col("id").alias("u"), "v")).withColumnsRenamed({"node": "id", "component": "class"})
    placed = labels.join(firsts, "id")
    classes = labels.join(placed.groupBy("class").agg(F.min("first.doc_id").alias("class_doc")), "class")
    linked = F.struct(F.col("earliest.first_doc").alias("doc_id"), F.col("earliest.first_line").cast("int").alias("line"))
    earliest = F.when(F.col("earliest").isNotNull(), F.least(F.col("first"), linked))
    every = firsts.join(classes, "id", "left").join(links, "id", "left").select(
        "id", F.coalesce("class", "id").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce(earliest, "first").alias("earliest"),
        F.coalesce("class_doc", "first.doc_id").alias("class_doc"),
    )
    return lines.select("doc_id", "line", "id", "n"), every


def judged_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, line, id, n, links, class_doc, removed for every line with words (and the rows with line -1)."""
    lines, sets = find_matches(docs, percent)
    later = F.col("doc_id").isNotNull() & (F.struct("doc_id", "line") > F.col("earliest"))
    return lines.join(sets, "id", "left").select("doc_id", "line", "id", "n", "links", "class_doc", F.coalesce(later, F.lit(False)).alias("removed"))


def summary(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each document: lines, removed lines, links of its lines' sets to other sets, and the smallest document that has
    a line of the class of one of its lines (its own id if it has none)."""
    own = F.col("line") < 0
    return judged_lines(docs, percent).groupBy("doc_id").agg(
        F.max(F.when(own, F.col("n"))).cast("long").alias("n_lines"), F.count_distinct(F.when(F.col("removed"), F.col("line"))).alias("n_removed"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"), F.min("class_doc").alias("class_doc"),
    ).select("doc_id", "n_lines", "n_removed", "n_links", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_doc", "doc_id")).alias("class_id"))


def without_later_matches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, with the texts that remain when every line is removed that has an earlier match."""
    gone = judged_lines(docs, percent).where("removed").groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    both = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left")
    kept = F.filter(F.split("d.text", "\n"), lambda x, k: ~F.array_contains("g.lines", k))
    text = F.when(F.col("g.lines").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
