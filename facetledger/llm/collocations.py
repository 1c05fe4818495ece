"""Phrases whose words occur together more often than chance, counted in suffix subtrees by vertical partitioning.

The suffix at a word is the word and those after it in its piece, truncated to ``longest`` words, and earlier where the
words so far are too rare for any phrase. Suffixes are grouped by their first words so that a group fits a budget of
memory: rare first words share a group, and a first word with more occurrences than the budget is prolonged by the second
word, the third, and so on. A group's suffixes meet in one task, ordered by their words, which is its subtree in depth-first
order; the leaves hold totals, and the count of every prefix is the sum of its leaves. A task adds up equal suffixes before
they move, and moves a group's suffixes as one block, so one suffix with very many occurrences is one leaf a task. Only what
lies above the prefixes that were prolonged is added up over groups.

What is too rare and where to prolong comes from one pass over the texts, in tables of fixed size: counts of words and of
runs of two and more words by buckets of hashes. Words that share a bucket only make the filter weaker and groups smaller;
every count in the result is of the phrase itself. The tables are the only thing that is broadcast.

Defined results: a null text is empty and a null language is ``und``; A-Z are lower-cased; repeated rows count again; a text
of any length is one row; other columns, ids included, don't matter; an empty table gives no rows. Words are told apart by
64-bit hashes while suffixes are added up, and by their text after that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetledger.llm.text import BASE, buffer_of, byte_class, find_words, mix, slices
from facetledger.runtime import stage

LEAST = 100
LONGEST = 5
TOP = 2_000
PERCENT = 100  # of a phrase's count that a longer one needs to replace it

WORD_BUCKETS = 1 << 20
RUN_BUCKETS = 1 << 22
PREFIX_BUCKETS = 1 << 16
PART = 1 << 16  # buckets in a row of a table
BUDGET = 1 << 20  # occurrences of suffixes in a group
SATURATED = 255
KEPT_LEAVES = 1_000_000  # distinct suffixes that a task adds up before it passes them on

PIECE_END = byte_class((0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
WORD = ~(PIECE_END | byte_class((0x20, 0x20), (0x09, 0x09)))
NOT_BLANK = ~byte_class((0x20, 0x20))


@dataclass
class Suffixes:
    """The words of some texts: their bytes (lower-cased), where they start and end, the text of each, whether the next one
    is in the same piece, and hashes of the runs of 1, 2, ... words that start at each (of use inside a piece)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    joined: np.ndarray
    runs: list[np.ndarray]


def suffixes(part: pa.RecordBatch, longest: int) -> Suffixes:
    data, offsets = buffer_of(part.column("text"))
    data = np.frombuffer(data.tobytes().lower(), np.uint8)  # of bytes: A-Z only
    words = find_words(data, offsets, WORD, lower=False)
    text = words.text_of()
    pieces = np.cumsum(PIECE_END[data], dtype=np.int32)[words.starts]
    joined = np.zeros(len(text), bool)
    joined[:-1] = (text[1:] == text[:-1]) & (pieces[1:] == pieces[:-1])
    languages = part.column("language").to_numpy().view(np.uint64)
    runs = [mix(words.hashes + mix(languages * BASE + np.uint64(1))[text])]
    for k in range(1, longest):
        after = np.zeros(len(text), np.uint64)
        after[:-k] = words.hashes[k:]
        runs.append(mix(runs[-1] * BASE + after))
    return Suffixes(data, words.starts, words.ends, text, joined, runs)


def within(linked: np.ndarray, longest: int) -> np.ndarray:
    """How many words from each one on are linked one to the next, itself included, up to ``longest``."""
    size, going = np.ones(len(linked), np.int64), np.ones(len(linked), bool)
    for k in range(longest - 1):
        ahead = np.zeros(len(linked), bool)
        ahead[: len(linked) - k] = linked[k:]
        going &= ahead
        size += going
    return size


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


TOTAL, WORDS = -1, 0  # kinds of tables; k for runs of k + 1 words, and from RUNS on the same runs by prefix bucket
RUNS = 100
TABLE = "kind int, part int, lang string, n long, data binary"
TABLE_NAMES = [f.split()[0] for f in TABLE.split(", ")]


def _table_rows(kind: int, table: np.ndarray) -> Iterator[tuple]:
    for k in range(0, len(table), PART):
        if table[k : k + PART].any():
            yield kind, k // PART, None, None, table[k : k + PART].tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=TABLE_NAMES)


def _counter(least: int, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(WORD_BUCKETS, np.int64)
        seen = [np.zeros(RUN_BUCKETS, np.int32) for _ in range(longest - 1)]
        totals: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch):
                found = suffixes(part, longest)
                for lang, n in zip(part.column("lang").to_pylist(), np.bincount(found.text, minlength=part.num_rows).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                np.add.at(words, _bucket(found.runs[0], WORD_BUCKETS), 1)
                size = within(found.joined, longest)
                for k, table in enumerate(seen):
                    np.add.at(table, _bucket(found.runs[k + 1][size > k + 1], RUN_BUCKETS), 1)
        tables = {WORDS: words}
        for k, table in enumerate(seen, 1):
            tables[RUNS + k] = table.reshape(PREFIX_BUCKETS, -1).sum(1).astype(np.int64)
            tables[k] = np.minimum(table, min(least, SATURATED)).astype(np.uint8)
        for kind, table in tables.items():
            for row in _table_rows(kind, table):
                yield _rows([row])
        yield _rows([(TOTAL, 0, lang, n, None) for lang, n in totals.items()])

    return run


def _added(least: int) -> Callable:
    """Sums of the tasks' tables; of runs only whether enough are there, as bits; of words these bits and sums by prefix
    bucket."""

    def finish(kind: int, part: int, lang: str | None, total: np.ndarray) -> tuple:
        if kind == TOTAL:
            return kind, part, lang, int(total[0]), None
        if WORDS < kind < RUNS:
            return kind, part, None, None, np.packbits(total >= min(least, SATURATED)).tobytes()
        if kind == WORDS:
            sums = total.reshape(-1, WORD_BUCKETS // PREFIX_BUCKETS).sum(1)
            return kind, part, None, None, np.packbits(total >= least).tobytes() + sums.tobytes()
        return kind, part, None, None, total.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["kind"], row["part"], row["lang"])
                value = np.array([row["n"]]) if row["kind"] == TOTAL else np.frombuffer(row["data"], np.uint8 if WORDS < row["kind"] < RUNS else np.int64).astype(np.int64)
                if own == key:
                    total += value
                    continue
                if key:
                    yield _rows([finish(*key, total)])
                key, total = own, value
        if key:
            yield _rows([finish(*key, total)])

    return run


@dataclass(frozen=True)
class Partition:
    """For runs of 1, 2, ... words by bucket: whether they are frequent enough; the group; whether they have to be prolonged."""

    frequent: list[np.ndarray]
    groups: list[np.ndarray]
    heavy: list[np.ndarray]


def _bits(parts: dict[int, np.ndarray], buckets: int) -> np.ndarray:
    out = np.zeros(buckets, bool)
    for part, data in parts.items():
        out[part * PART : (part + 1) * PART] = np.unpackbits(data)
    return out


def partition(tables: dict[int, dict[int, np.ndarray]], longest: int, budget: int) -> Partition:
    """Packs neighbouring buckets into groups of about ``budget`` occurrences, at each length of a prefix."""
    words = tables.get(WORDS, {})
    frequent = [_bits({part: data[: PART // 8] for part, data in words.items()}, WORD_BUCKETS)]
    frequent += [_bits(tables.get(k, {}), RUN_BUCKETS) for k in range(1, longest)]
    counts = [np.zeros(PREFIX_BUCKETS, np.int64) for _ in range(longest)]
    few = PART * PREFIX_BUCKETS // WORD_BUCKETS
    for part, data in words.items():
        counts[0][part * few : (part + 1) * few] = data[PART // 8 :].view(np.int64)
    for k in range(1, longest):
        for part, data in tables.get(RUNS + k, {}).items():
            counts[k][part * PART : (part + 1) * PART] = data.view(np.int64)
    heavy = [c > budget for c in counts]
    groups, first = [], 0
    for c, h in zip(counts, heavy, strict=True):
        own = first + np.cumsum(np.where(h, 0, c)) // budget
        groups.append(own.astype(np.int32))
        first = int(own[-1]) + 1
    return Partition(frequent, groups, heavy)


BLOCK = "grp int, lang string, leaf array<string>, n array<long>, cut array<int>"
BLOCK_NAMES = [f.split()[0] for f in BLOCK.split(", ")]


def leaf_texts(found: Suffixes, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words of suffixes (first word and number of words), a blank after each."""
    word = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
    width = found.ends[word] - found.starts[word] + 1
    ends = np.cumsum(width)
    place = np.repeat(found.starts[word] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)
    out = np.append(found.data, np.uint8(0x20))[place]
    out[ends - 1] = 0x20
    offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(size)))]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


def truncated(found: Suffixes, parts: Partition, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of all suffixes that begin with a frequent word, their sizes, hashes, groups, and the length of the prefix
    that the group is of (one more than the size if the whole suffix was prolonged in vain)."""
    whole = within(found.joined, longest)
    size = np.zeros(len(whole), np.int64)
    for k, bits in enumerate(parts.frequent):  # a frequent run begins with frequent ones
        size += (size == k) & (whole > k) & bits[_bucket(found.runs[k], WORD_BUCKETS if k == 0 else RUN_BUCKETS)]
    at = np.flatnonzero(size)
    size = size[at]
    key, group, cut = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
    for k in range(longest):
        run = found.runs[k][at]
        key = np.where(size == k + 1, run ^ np.uint64(k), key)
        bucket = _bucket(run, PREFIX_BUCKETS)
        here = (cut == 0) & (size > k)
        heavy = parts.heavy[k][bucket]
        group[here] = parts.groups[k][bucket[here]]
        cut[here & ~heavy] = k + 1
    return at, size, key, group, np.where(cut == 0, size + 1, cut).astype(np.int32)


def added_up(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each key, with the sum of ``n``."""
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    _, first, inverse = np.unique(whole.column("key").to_numpy(), return_index=True, return_inverse=True)
    n = np.bincount(inverse, whole.column("n").to_numpy()).astype(np.int64)
    own = whole.take(pa.array(first))
    return own.set_column(own.schema.get_field_index("n"), "n", pa.array(n))


def blocks(leaves: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """One row for each group and language, with the lists of its leaves."""
    lang = leaves.column("lang").dictionary_encode().indices.to_numpy()
    groups = leaves.column("grp").to_numpy()
    order = np.lexsort((lang, groups))
    own = leaves.take(pa.array(order))
    new = np.flatnonzero(np.concatenate(([True], (groups[order][1:] != groups[order][:-1]) | (lang[order][1:] != lang[order][:-1]))))
    for k in range(0, len(new), 64):
        begin = new[k : k + 64]
        end = new[k + 64] if k + 64 < len(new) else len(order)
        part = own.slice(begin[0], end - begin[0])
        offsets = pa.array(np.append(begin, end) - begin[0], pa.int32())
        first = pa.array(begin - begin[0])
        lists = [pa.ListArray.from_arrays(offsets, part.column(c)) for c in BLOCK_NAMES[2:]]
        yield pa.RecordBatch.from_arrays([part.column("grp").take(first), part.column("lang").take(first), *lists], names=BLOCK_NAMES)


def _leaves(parts, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for part in slices(batch):
                found = suffixes(part, longest)
                at, size, key, group, cut = truncated(found, parts.value, longest)
                if not len(at):
                    continue
                distinct, first, n = np.unique(key, return_index=True, return_counts=True)
                own = at[first]
                kept.append(pa.RecordBatch.from_arrays(
                    [pa.array(distinct), pa.array(group[first]), part.column("lang").take(pa.array(found.text[own])), leaf_texts(found, own, size[first]), pa.array(n.astype(np.int64)), pa.array(cut[first])],
                    names=["key", *BLOCK_NAMES],
                ))
                rows += len(distinct)
                if rows > KEPT_LEAVES:
                    kept = [added_up(kept)]
                    rows = kept[0].num_rows
                    if rows > KEPT_LEAVES // 2:
                        yield from blocks(kept.pop())
                        rows = 0
        if kept:
            yield from blocks(added_up(kept))

    return run


def whole_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of whole groups, one row a leaf, from blocks that are sorted by group."""
    kept: list[pa.RecordBatch] = []

    def flat() -> pa.RecordBatch:
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        row = pa.array(np.repeat(np.arange(whole.num_rows), whole.column("n").value_lengths().to_numpy()))
        return pa.RecordBatch.from_arrays([*(whole.column(c).take(row) for c in BLOCK_NAMES[:2]), *(whole.column(c).flatten() for c in BLOCK_NAMES[2:])], names=BLOCK_NAMES)

    for batch in batches:
        groups = batch.column("grp").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True]))).tolist() if len(groups) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if kept and kept[-1].column("grp")[0].as_py() != groups[a]:
                yield flat()
                kept = []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield flat()


def prefix_totals(leaves: pa.RecordBatch, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth of a group's subtree: the first leaf of each node, the node's total, the bytes of its text."""
    data, offsets = buffer_of(leaves.column("leaf"))
    words = find_words(data, offsets, NOT_BLANK, lower=False)
    size = words.counts
    column = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], size)
    path = np.zeros((leaves.num_rows, longest + 1), np.uint64)
    path[:, 0] = leaves.column("lang").dictionary_encode().indices.to_numpy()
    path[words.text_of(), column + 1] = words.hashes
    order = np.lexsort(path.T[::-1])
    n = leaves.column("n").to_numpy()
    for depth in range(1, longest + 1):
        row = order[size[order] >= depth]
        if not len(row):
            return
        own = path[row, : depth + 1]
        begin = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(1))))
        first = row[begin]
        yield depth, first, np.add.reduceat(n[row], begin), words.ends[words.first[first] + depth - 1] - offsets[first]


def _nodes(least: int, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaves in whole_subtrees(batches):
            cut, data, offsets = leaves.column("cut").to_numpy(), *buffer_of(leaves.column("leaf"))
            for depth, first, total, width in prefix_totals(leaves, longest):
                keep = np.flatnonzero((cut[first] > depth) | (total >= least))  # a part of a node, or a frequent one
                begin = offsets[first[keep]]
                phrase = pa.array([data[a:b].tobytes().decode() for a, b in zip(begin.tolist(), (begin + width[keep]).tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [leaves.column("lang").take(pa.array(first[keep])), phrase, pa.array(np.full(len(keep), depth), pa.int32()), pa.array(total[keep])], names=["lang", "phrase", "size", "f"],
                )

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that occur at least ``least`` times in a language (lang, phrase, size, f), and
    the number of words of each language (lang, n)."""
    if least < 1 or not 2 <= longest:
        raise ValueError("a phrase occurs once at least, and phrases have two words or more")
    lang = F.coalesce("lang", F.lit("und"))
    read = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("language"), "text")
    counted = read.mapInArrow(_counter(least, longest), TABLE)
    tables = stage(counted.repartition("kind", "part", "lang").sortWithinPartitions("kind", "part", "lang").mapInArrow(_added(least), TABLE))
    found: dict[int, dict[int, np.ndarray]] = {}
    for row in tables.where(F.col("kind") != TOTAL).select("kind", "part", "data").collect():  # tables of a fixed size
        found.setdefault(row.kind, {})[row.part] = np.frombuffer(row.data, np.uint8)
    parts = docs.sparkSession.sparkContext.broadcast(partition(found, longest, budget))
    leaves = read.mapInArrow(_leaves(parts, longest), BLOCK)
    dealt = leaves.repartition("grp").sortWithinPartitions("grp")
    nodes = dealt.mapInArrow(_nodes(least, longest), "lang string, phrase string, size int, f long")
    phrases = stage(nodes.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    return phrases, tables.where(F.col("kind") == TOTAL).select("lang", "n")


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """The phrases of two words or more with their lowest score: lang, phrase, words, a, l, r, n, score. A score is
    floor(1000 * a * n / (l * r)) of the counts of the whole, of its first words and of the rest, in decimals of 38 digits;
    of equal scores the cut after the fewest words counts."""
    count = phrases.select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = phrases.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(1, F.col("k")), "rest": part(F.col("k") + 1, F.size("words") - F.col("k"))})
    left, right = count.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), count.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    exact = met.withColumns({"above": F.lit(1000).cast("decimal(38,0)") * _wide("a") * _wide("n"), "below": _wide("l") * _wide("r")})
    least = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut")
    return exact.groupBy("lang", "phrase", "words", "a", "n").agg(least).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def without_parts(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Drops phrases that lie inside a longer one which has at least ``percent`` of their count."""
    size = F.size("words")
    longer = found.where(size > 2).select("lang", F.col("a").alias("longer"), "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("width"))
    inner = longer.select("lang", "longer", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1), lambda k: F.array_join(F.slice("words", k, F.col("width")), " "))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(most, ["lang", "phrase"], "left")
    return kept.where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer", "words")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language, ranked in parts before the best of the parts meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, budget: int = BUDGET) -> DataFrame:
    """For each language its first ``top`` phrases by score, then count, then text: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, least, longest, budget)
    return ranked(without_parts(scored(phrases, totals), percent), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
