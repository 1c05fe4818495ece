"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 * q) words that no neighbouring word
extends. At scale L = 1, 2, 4, ... all runs with L <= q < 2 * L are found. The text is cut into blocks of L words; a block's
occurrences without a mismatch at a distance d, L <= d < 2 * L, are where the sum of its squared differences to the
following window of 2 * L words is zero. These sums come from a number-theoretic transform modulo a prime, word numbers
being written in digits so small that every sum is below the prime: the sums are exact integers, not residues. A block and
a distance are a seed. Seeds of one distance in adjacent blocks form a chain, and a chain is extended word by word.

What is left out cannot belong to a run of the scale, for these reasons:

* All words of such a block occur again within 2 * L - 1 words, so other blocks are not transformed.
* A run has at least 3 * q words that equal the word q later, so its chain has more than 3 * d / L - 2 blocks, which is at
  least two; and its stretch ends less than a block away from its chain.
* A stretch of L + d words that lies in a known run of period r < L is in no run of smallest period d: they would share
  r + d words, so by the theorem of Fine and Wilf d would not be smallest. Such seeds are dropped, which keeps the work at a
  repeated word or phrase of any length in proportion to the length.

Word numbers are the ranks of 64-bit hashes inside a document. Defined results: a null or empty text has no words and no
run; a null id leaves the text as it is; rows with one id are rows of their own; a text of any length is one row, held in
one task; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetledger.llm.text import NOT_SPACE, buffer_of, find_words, slices

PRIME = 2_013_265_921  # 15 * 2**27 + 1
ROOT = 31  # a generator of its multiplicative group
CELLS = 1 << 19  # numbers in a transform at once
STEP = 64  # words by which chains are extended at once
LEAST_LENGTH = 6
LEAST_POWER = 4  # a run is at least so many periods long


def _power(base: int, count: int) -> np.ndarray:
    """The first powers of a number modulo the prime."""
    out = np.ones(count, np.uint64)
    known = 1
    while known < count:
        out[known : 2 * known] = out[: min(known, count - known)] * np.uint64(pow(base, known, PRIME)) % np.uint64(PRIME)
        known *= 2
    return out


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    return _power(pow(root, PRIME - 2, PRIME) if inverse else root, max(1, size // 2))


def forward(x: np.ndarray) -> np.ndarray:
    """Transforms of rows of a power of two of numbers, in bit-reversed order."""
    p, rows, size = np.uint64(PRIME), len(x), x.shape[1]
    x, half = x.astype(np.uint64), size // 2
    while half:
        view = x.reshape(rows, -1, 2, half)
        a, b = view[:, :, 0], view[:, :, 1]
        low = a - b + p
        view[:, :, 0] = (a + b) % p
        view[:, :, 1] = low * _roots(2 * half, False) % p
        half //= 2
    return x


def backward(x: np.ndarray) -> np.ndarray:
    """The rows that ``forward`` gives these transforms for."""
    p, rows, size = np.uint64(PRIME), len(x), x.shape[1]
    x, half = x.copy(), 1
    while half < size:
        view = x.reshape(rows, -1, 2, half)
        a, b = view[:, :, 0], view[:, :, 1] * _roots(2 * half, True) % p
        low = a + p - b
        view[:, :, 0] = (a + b) % p
        view[:, :, 1] = low % p
        half *= 2
    return x * np.uint64(pow(size, PRIME - 2, PRIME)) % p


def digit_bits(length: int, top: int) -> int:
    """Bits of a digit for which the products of blocks of this length, added up over all digits of ``top``, stay below
    the prime."""
    for bits in range(15, 0, -1):
        digits = -(-max(1, int(top).bit_length()) // bits)
        if digits * length * ((1 << bits) - 1) ** 2 < PRIME:
            return bits
    raise ValueError("a block of more than two thousand million words")


def square_sums(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For rows of L numbers and of 2 * L numbers (not negative): a row of L sums, the o-th being of the squared
    differences of the digits of the block and the window from its o-th number on."""
    length = blocks.shape[1]
    top = int(max(blocks.max(), windows.max()))
    bits = digit_bits(length, top)
    mask = (1 << bits) - 1
    squares = np.zeros((len(blocks), length), np.int64)
    product = np.zeros((len(blocks), 2 * length), np.uint64)
    for shift in range(0, max(1, top.bit_length()), bits):
        b, w = (blocks >> shift) & mask, (windows >> shift) & mask
        turned = np.zeros((len(b), 2 * length), np.int64)
        turned[:, 0], turned[:, length + 1 :] = b[:, 0], b[:, :0:-1]
        product = (product + forward(turned) * forward(w) % np.uint64(PRIME)) % np.uint64(PRIME)
        sums = np.cumsum(np.pad(w * w, ((0, 0), (1, 0))), 1)
        squares += (b * b).sum(1)[:, None] + sums[:, length : 2 * length] - sums[:, :length]
    return squares - 2 * backward(product)[:, :length].astype(np.int64)


def word_numbers(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the words of some texts, one after the other: a number for each distinct word of a text, and how many words later
    it comes again there (a number beyond all words if it doesn't)."""
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    same = np.zeros(n, bool)
    same[1:] = (hashes[order[1:]] == hashes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    rank = np.cumsum(~same)
    number = np.empty(n, np.int64)
    number[order] = rank
    begins = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    least = np.minimum.reduceat(number, begins) if n else np.zeros(0, np.int64)
    number -= np.repeat(least, np.diff(np.append(begins, n)))
    gap = np.full(n, n + 1)
    again = np.flatnonzero(same)
    gap[order[again - 1]] = order[again] - order[again - 1]
    return number, gap


def _seeds(number: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (by their place in the list) and distances at which they occur again inside their text (which ends at ``end``)."""
    found = [np.zeros((2, 0), np.int64)]
    rows = max(1, CELLS // (2 * length))
    for k in range(0, len(start), rows):
        at, last = start[k : k + rows, None], end[k : k + rows, None]
        blocks = number[at + np.arange(length)]
        place = at + length + np.arange(2 * length)
        # Beyond the text stands a number that no block holds.
        windows = np.where(place < last, number[np.minimum(place, len(number) - 1)], blocks.max() + 1)
        found.append(np.stack(np.nonzero(square_sums(blocks, windows) == 0)) + np.array([[k], [length]]))
    return tuple(np.concatenate(found, 1))


def _reaches(number: np.ndarray, at: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words on from ``at`` (step 1) or back from it (step -1) equal the word ``d`` later, ``most`` at most, staying
    in the text (``low`` to ``high``)."""
    out = np.zeros(len(at), np.int64)
    going = np.arange(len(at))
    for done in range(0, most, STEP):
        width = min(STEP, most - done)
        place = at[going, None] + step * (done + np.arange(width))
        inside = (place >= low[going, None]) & (place + d[going, None] < high[going, None])
        place = np.where(inside, place, low[going, None])
        equal = inside & (number[place] == number[np.where(inside, place + d[going, None], place)])
        good = np.where(equal.all(1), width, np.argmin(equal, 1))
        out[going] += good
        going = going[good == width]
        if not len(going):
            break
    return out


def find_runs(number: np.ndarray, gap: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts whose words' numbers stand one after the other, text t at ``first[t]``: where they start and end (of
    all words) and their period, ordered by start, then period."""
    n, sizes = len(number), np.diff(first)
    runs = np.zeros((3, 0), np.int64)
    length = 1
    while n and (texts := np.flatnonzero(sizes >= max(LEAST_LENGTH, LEAST_POWER * length))).size:
        # Blocks whose words all come again soon, and which have such a neighbour.
        few = sizes[texts] // length
        text = np.repeat(texts, few)
        start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(few) - few, few)) * length
        missing = np.concatenate(([0], np.cumsum(gap >= 2 * length)))
        soon = missing[start + length] == missing[start]
        follows = (start[1:] == start[:-1] + length) & (text[1:] == text[:-1]) & soon[1:] & soon[:-1]
        near = np.zeros(len(start), bool)
        near[1:] |= follows
        near[:-1] |= follows
        reach = np.zeros(n + 1, np.int64)
        np.maximum.at(reach, runs[0], runs[1])
        reach = np.maximum.accumulate(reach)
        near &= reach[start] < start + 3 * length - 1
        start, text = start[near], text[near]
        block, d = _seeds(number, start, first[text + 1], length)
        known = reach[start[block]] >= start[block] + length + d
        block, d = block[~known], d[~known]
        if len(block):
            order = np.lexsort((start[block], d))
            block, d = block[order], d[order]
            at, of = start[block], text[block]
            new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (at[1:] != at[:-1] + length) | (of[1:] != of[:-1]))))
            blocks = np.diff(np.append(new, len(at)))
            enough = (blocks + 2) * length > (LEAST_POWER - 1) * d[new]
            new, blocks = new[enough], blocks[enough]
            at, d, of = at[new], d[new], of[new]
            low, high = first[of], first[of + 1]
            left = _reaches(number, at - 1, d, low, high, -1, length)
            right = _reaches(number, at + blocks * length, d, low, high, 1, length)
            begin, stop = at - left, at + blocks * length + right + d
            good = (left < length) & (right < length) & (stop - begin >= np.maximum(LEAST_LENGTH, LEAST_POWER * d))
            runs = np.concatenate([runs, np.stack([begin, stop, d])[:, good]], 1)
            # One stretch is one run, of its smallest period.
            runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
            keep = np.ones(runs.shape[1], bool)
            keep[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(0)
            runs = runs[:, keep]
        length *= 2
    return tuple(runs[:, np.lexsort((runs[2], runs[0]))])


def looped(n: int, begin: int, period: int) -> np.ndarray:
    """Word numbers of a text of n words in which, from ``begin`` on, the words of one period come again and again."""
    at = np.arange(n)
    at[begin:] = begin + (at[begin:] - begin) % period
    return at


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words lie in a run (start, end, period) after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, end, period in runs:
        change[start + period] += 1
        change[end] -= 1
    return np.cumsum(change[:-1]) > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by its period; of equal ones the first, then that of the smallest period."""
    best = None
    for start, end, period in runs:
        if best is None or (end - start) * best[2] > (best[1] - best[0]) * period:
            best = (start, end, period)
    return best


RESULT = "n_words long, n_runs long, starts array<long>, lengths array<long>, periods array<long>, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"


def _judge(loop: Callable | None, columns: list[str], collapse: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from _judged(part, loop, columns, collapse)

    return run


def _judged(part: pa.RecordBatch, loop: Callable | None, columns: list[str], collapse: str) -> Iterator[pa.RecordBatch]:
    data, offsets = buffer_of(part.column("text"))
    words = find_words(data, offsets, NOT_SPACE, lower=False)
    counts = words.counts
    places: dict[int, np.ndarray] = {}
    hashes = words.hashes
    for t, (begin, period) in (loop(part, counts) if loop else {}).items():
        places[t] = looped(int(counts[t]), begin, period)
        own = slice(words.first[t], words.first[t + 1])
        hashes[own] = hashes[own][places[t]]
    begin, stop, period = find_runs(*word_numbers(hashes, words.text_of()), words.first)
    cuts = np.searchsorted(begin, words.first)  # a run starts inside its text
    raw, out = data.tobytes(), []
    for t in range(part.num_rows):
        at, some = words.first[t], slice(cuts[t], cuts[t + 1])
        runs = list(zip((begin[some] - at).tolist(), (stop[some] - at).tolist(), period[some].tolist(), strict=True))
        said = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
        kept = raw[offsets[t] : offsets[t + 1]].split()  # of bytes: at ASCII white space
        if t in places:
            kept = [kept[k] for k in places[t].tolist()]
        if runs:
            kept = [kept[k] for k in np.flatnonzero(~dropped_words(len(kept), runs)).tolist()]
        text = b" ".join(kept)
        best = strongest(runs)
        top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        out.append((int(counts[t]), len(runs), [x[0] for x in runs], [x[1] - x[0] for x in runs], [x[2] for x in runs], *top, hashlib.sha256(said.encode()).hexdigest(), text.decode() if collapse == "text" else hashlib.sha256(text).hexdigest()))
    schema = pa.schema([("n_words", pa.int64()), ("n_runs", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("starts", "lengths", "periods")), *((c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed", pa.string())])
    found = [pa.array(list(x), field.type) for x, field in zip(zip(*out, strict=True), schema, strict=True)]
    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *found], names=[*columns, *schema.names])


def periodic_runs(docs: DataFrame, loop: Callable | None = None, id_column: str = "doc_id", collapse: str = "text") -> DataFrame:
    """For each row: its id, n_words, the runs (starts, lengths, periods as lists, and their SHA-256), the strongest run, and
    the text without what runs repeat (``collapse="text"``) or its SHA-256 (``"sha256"``).

    ``loop`` may change texts before: for a batch and its numbers of words it gives, for some rows, a word and a period
    from which on the text repeats (see ``looped``)."""
    if collapse not in {"text", "sha256"}:
        raise ValueError("collapse is text or sha256")
    rows = docs.select(F.col(id_column), "text")
    return rows.mapInArrow(_judge(loop, [id_column], collapse), f"{id_column} {dict(rows.dtypes)[id_column]}, {RESULT}")
