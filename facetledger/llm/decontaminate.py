"""Benchmark decontamination with suffix arrays over the training documents.

Each task builds suffix arrays over the words of its documents (a shard is a slice of an Arrow batch) and binary-searches
every test suffix in them. A suffix whose first words do not all occur in the test set cannot match a window and is left
out of the array, so a shard costs little more than finding its words. The test set goes to the tasks in blocks of at
most ``block_words`` words; more blocks mean more passes, never a larger broadcast.

Defined results: a null or word-less text has no words and is never hit; an item without words has no window; items with
a null id count as hits but are not listed; equal items are all listed; repeated rows are judged one by one; extra
columns are kept, and columns named like the operator's own are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetledger.llm.text import ALNUM, buffer_of, find_words, slices
from facetledger.runtime import stage

WINDOW = 10
BLOCK_WORDS = 1_000_000
MATCH = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()),
    T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType()),
])
OWN = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(MATCH)), T.StructField("hit_mask", T.BinaryType()),
])


@dataclass
class TestBlock:
    """Some items as runs of word numbers, and the distinct windows of their words."""

    ids: list[str | None]
    words: np.ndarray  # numbers from 1, all items one after the other
    first: np.ndarray
    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place plus 1
    windows: np.ndarray  # distinct windows, zeros after a short one
    lengths: np.ndarray
    window_of: np.ndarray  # for each test suffix its window, -1 if it is shorter than a window
    item_of: np.ndarray


def test_blocks(items: DataFrame, window: int, block_words: int, id_column: str = "item_id") -> Iterator[TestBlock]:
    """The items in blocks of at most ``block_words`` words (or one longer item), read one partition at a time."""
    ids, hashes, size = [], [], 0
    for row in items.select(F.col(id_column).cast("string"), "text").toLocalIterator():
        words = find_words(*buffer_of(pa.array([row[1]], pa.string())), ALNUM).hashes
        if not len(words):
            continue
        if ids and size + len(words) > block_words:
            yield _block(ids, hashes, window)
            ids, hashes, size = [], [], 0
        ids.append(row[0])
        hashes.append(words)
        size += len(words)
    if ids:
        yield _block(ids, hashes, window)


def _block(ids: list[str | None], hashes: list[np.ndarray], window: int) -> TestBlock:
    vocabulary, words = np.unique(np.concatenate(hashes), return_inverse=True)
    words = words.ravel().astype(np.int64) + 1
    sizes = np.array([len(h) for h in hashes])
    first = np.concatenate(([0], np.cumsum(sizes)))
    item_of = np.repeat(np.arange(len(ids)), sizes)
    left = np.repeat(first[1:], sizes) - np.arange(len(words))
    need = np.minimum(window, np.repeat(sizes, sizes))
    padded = np.concatenate((words, np.zeros(window, np.int64)))
    table = padded[np.arange(len(words))[:, None] + np.arange(window)]
    table[np.arange(window) >= need[:, None]] = 0
    starts = left >= need
    windows, number = np.unique(table[starts], axis=0, return_inverse=True)
    window_of = np.full(len(words), -1)
    window_of[starts] = number.ravel()
    return TestBlock(ids, words, first, vocabulary, windows, (windows > 0).sum(1), window_of, item_of)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` numbers at least, by doubling the ranked length."""
    _, rank = np.unique(text, return_inverse=True)
    rank, known = rank.ravel().astype(np.int64) + 1, 1
    while known < depth:
        after = np.zeros_like(rank)
        after[:-known] = rank[known:]
        distinct, rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        rank, known = rank.ravel().astype(np.int64) + 1, known * 2
        if len(distinct) == len(rank):
            break
    return np.argsort(rank, kind="stable")


def find_windows(text: np.ndarray, order: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the block the range of the suffix array that begins with it."""
    width = block.windows.shape[1]
    padded = np.concatenate((text, np.zeros(width, text.dtype)))
    reach = np.arange(width)
    used = reach < block.lengths[:, None]

    def search(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(block.windows), np.int64), np.full(len(block.windows), len(order))
        while (open_ := low < high).any():
            middle = (low + high) // 2
            seen = padded[order[np.minimum(middle, len(order) - 1)][:, None] + reach]
            differs = (seen != block.windows) & used
            at = differs.argmax(1)
            less = np.take_along_axis(seen, at[:, None], 1)[:, 0] < np.take_along_axis(block.windows, at[:, None], 1)[:, 0]
            up = np.where(differs.any(1), less, after_equal)
            low, high = np.where(open_ & up, middle + 1, low), np.where(open_ & ~up, middle, high)
        return low

    return search(False), search(True)


def match_lengths(text: np.ndarray, places: np.ndarray, words: np.ndarray, known: int) -> np.ndarray:
    """How many words of a test suffix follow at each of the places, which agree with it in ``known`` words."""
    length = np.full(len(places), known)
    going = np.arange(len(places))
    while len(going) and known < len(words):
        going = going[places[going] + known < len(text)]
        going = going[text[places[going] + known] == words[known]]
        known += 1
        length[going] = known
    return length


def search_shard(data: np.ndarray, offsets: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray, dict, dict]:
    """Number of words of each text, a hit mark for each word, the items of each text, and the longest matches."""
    words = find_words(data, offsets, ALNUM)
    hit = np.zeros(len(words.hashes) + 1, np.int64)
    items: dict[int, set[int]] = {}
    matches: dict[int, list[tuple]] = {}
    number = np.searchsorted(block.vocabulary, words.hashes)
    number[number == len(block.vocabulary)] = 0
    known = block.vocabulary[number] == words.hashes
    # Runs of known words inside a text that are long enough for the shortest window.
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    edges = words.first[(words.first > 0) & (words.first < len(known))]
    begins[edges] = known[edges]
    run = np.cumsum(begins) - 1
    sizes = np.bincount(run[known], minlength=int(begins.sum()))
    keep = known.copy()
    keep[known] = sizes[run[known]] >= block.lengths.min()
    at = np.flatnonzero(keep)
    if not len(at):
        return words.counts, hit[:-1] > 0, items, matches
    # The kept runs one after the other with a zero behind each; a zero equals no word, so no match crosses it.
    last = np.ones(len(at), bool)
    last[:-1] = run[at[1:]] != run[at[:-1]]
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(last)[:-1]))
    text = np.zeros(place[-1] + 2, np.int64)
    text[place] = number[at] + 1
    word_at = np.full(len(text), -1)
    word_at[place] = at
    order = suffix_array(text, int(np.diff(block.first).max()))
    low, high = find_windows(text, order, block)
    found = np.flatnonzero(low < high)
    text_of = lambda p: np.searchsorted(words.first, word_at[p], "right") - 1
    items_of = _items_by_window(block, found)
    for w in found:
        places = order[low[w] : high[w]]
        np.add.at(hit, word_at[places], 1)
        np.add.at(hit, word_at[places] + block.lengths[w], -1)
        for t in np.unique(text_of(places)).tolist():
            items.setdefault(t, set()).update(items_of[w])
    is_found = np.zeros(len(block.windows) + 1, bool)
    is_found[found] = True
    item, before = -1, {}  # the end of the last longest match of this item in each text, so that only maximal matches are told
    for suffix in np.flatnonzero(is_found[block.window_of]).tolist():
        if block.item_of[suffix] != item:
            item, before = block.item_of[suffix], {}
        w = block.window_of[suffix]
        places = np.sort(order[low[w] : high[w]])
        length = match_lengths(text, places, block.words[suffix : block.first[item + 1]], int(block.lengths[w]))
        texts = text_of(places)
        best = np.lexsort((places, -length, texts))  # in each text the longest, of equally long ones the first
        best = best[np.concatenate(([True], texts[best[1:]] != texts[best[:-1]]))]
        for t, p, n in zip(texts[best].tolist(), places[best].tolist(), length[best].tolist(), strict=True):
            if suffix + n > before.get(t, 0):
                matches.setdefault(t, []).append((block.ids[item], int(suffix - block.first[item]), int(word_at[p] - words.first[t]), n))
            before[t] = max(before.get(t, 0), suffix + n)
    return words.counts, np.cumsum(hit[:-1]) > 0, items, matches


def _items_by_window(block: TestBlock, found: np.ndarray) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {int(w): set() for w in found}
    wanted = np.isin(block.window_of, found)
    for w, item in zip(block.window_of[wanted].tolist(), block.item_of[wanted].tolist(), strict=True):
        out[w].add(item)
    return out


def _searcher(shared, names: list[str], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value if shared is not None else None
        for batch in batches:
            for part in slices(batch):
                data, offsets = buffer_of(part.column("text"))
                if block is None:
                    counts, hit, items, matches = find_words(data, offsets, ALNUM).counts, None, {}, {}
                else:
                    counts, hit, items, matches = search_shard(data, offsets, block)
                first = np.concatenate(([0], np.cumsum(counts)))
                earlier = {k: part.column(k).to_pylist() for k in ("items", "matches", "hit_mask")} if "hit_mask" in part.schema.names else None
                own: dict[str, list] = {k: [] for k in ("n_hit", "items", "matches", "hit_mask")}
                for t in range(part.num_rows):
                    mask = hit[first[t] : first[t + 1]] if t in items else None
                    listed = {block.ids[k] for k in items.get(t, ())} - {None}
                    told = [dict(zip(MATCH.fieldNames(), m, strict=True)) for m in matches.get(t, [])]
                    if earlier:
                        listed, told = listed | set(earlier["items"][t]), told + earlier["matches"][t]
                        if earlier["hit_mask"][t] is not None:
                            old = np.unpackbits(np.frombuffer(earlier["hit_mask"][t], np.uint8), count=int(counts[t])).astype(bool)
                            mask = old if mask is None else mask | old
                    own["n_hit"].append(0 if mask is None else int(mask.sum()))
                    own["items"].append(sorted(listed))
                    own["matches"].append(told)
                    own["hit_mask"].append(None if mask is None else np.packbits(mask).tobytes())
                columns = [part.column(n) for n in names] + [pa.array(counts, pa.int64())]
                columns += [pa.array(own[k], schema.field(k).type) for k in own]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def search_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, columns: list[str] | None = None) -> DataFrame:
    """Documents with ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``items`` (sorted ids of the items
    whose windows occur), ``matches`` (longest verbatim match of each test suffix in the document, without those inside the match before: item, place in the item,
    place in the document, words) and ``hit_mask`` (one bit for each word)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    names = [c for c in (columns or docs.columns) if c not in OWN.fieldNames()]
    carried = names if "text" in names else [*names, "text"]
    state = docs.select(*carried)
    blocks = test_blocks(items, window, block_words)
    block = next(blocks, None)
    while True:
        following = next(blocks, None) if block is not None else None
        kept = names if following is None else carried
        schema = T.StructType([f for f in state.schema.fields if f.name in kept] + OWN.fields)
        shared = spark.sparkContext.broadcast(block) if block is not None else None
        state = state.mapInArrow(_searcher(shared, kept, to_arrow_schema(schema)), schema)
        if following is None:
            return state
        state, block = stage(state), following


def remove_affected(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that no window of the items occurs in, with their own columns."""
    own = {c: f"_own_{c}" for c in docs.columns if c in OWN.fieldNames()}
    searched = search_items(docs.withColumnsRenamed(own), items, window).where("n_hit = 0").drop(*OWN.fieldNames())
    return searched.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def items_digest(items: str = "items") -> str:
    return f"sha2(concat_ws(',', {items}), 256)"


def digest(ids: list[str]) -> str:
    """What ``items_digest`` gives, for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
