"""Interleaving sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With weight w, block i of a source may start at slot floor(i / w) and must be
done before slot ceil((i + 1) / w). Every slot takes the released block with the earliest deadline, so at any slot the
number of blocks taken from a source is less than one block away from slot * w.

Weights are exact: a weight w of the sum W, both whole numbers without a common divisor, has windows floor(i * W / w) and
ceil((i + 1) * W / w), so equal weights are 1 of n. A float stands for the decimal number that it prints as. The schedule
repeats after W slots: one period is worked out from the weights alone, and the slot of any block follows by arithmetic;
a period that outlasts a source is worked out only to that source's end. When a source has no block left, the others go
on with their own weights, and the deviation is counted from there. All documents are placed; none is dropped or repeated.

The driver holds one number a source (its blocks) and, for each phase, the slots of one period or of the phase if that is
shorter; so weights of many digits cost a number a block of the table, others a number a slot of their short period.

Defined results: a null source is a source of its own; a source without a weight gets the least positive given weight; a source
of weight 0 comes after all others, where such sources weigh the same; a source with a weight and no document has no block;
a deadline beyond the largest long is that long; documents of a source follow each other by the hash of their ids, equal ids by the
hash of the text; the last block of a source may be shorter and leaves a gap in the positions.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 16
PERIOD = 1000
CHUNK_DOCS = 20_000
CHUNK_SLOTS = 1000
BROADCAST_SLOTS = 2_000_000
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Phase:
    """From slot ``start`` on, while all its sources have blocks: shares of the period, the slots of a period (or of the
    phase, if it is shorter) by source, blocks taken before and in this phase."""

    start: int
    period: int
    shares: dict[str | None, int]
    slots: dict[str | None, array]
    before: dict[str | None, int]
    taken: dict[str | None, int]


def checked(weights: Mapping[str | None, float]) -> None:
    if not all(math.isfinite(w) for w in weights.values()) or sum(weights.values()) <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative, and one must be positive")


def reduced(shares: Mapping[str | None, int]) -> dict[str | None, int]:
    divisor = math.gcd(*shares.values())
    return {s: n // divisor for s, n in shares.items()}


def exact_shares(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """The weights as the smallest whole numbers in the same proportions."""
    if not weights:
        return {}
    checked(weights)
    exact = {s: Fraction(repr(float(w))) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(x.denominator for x in exact.values()))
    return reduced({s: int(x * common) for s, x in exact.items()})


def whole_shares(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Weights rounded to shares of a period, at least one each, by largest remainders: only for a caller who asks for a
    period of that length."""
    if not weights:
        return {}
    checked(weights)
    total = sum(weights.values())
    period = max(period, len(weights))
    exact = {s: w / total * period for s, w in weights.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s is None, s or ""))
    for s in order[: max(0, period - sum(shares.values()))]:
        shares[s] += 1
    return shares


def release(i: int, share: int, period: int) -> int:
    return i * period // share


def deadline(i: int, share: int, period: int) -> int:
    return -(-(i + 1) * period // share)


def one_period(shares: Mapping[str | None, int], blocks: Mapping[str | None, int]) -> dict[str | None, array]:
    """The slots of each source in one period, or until a source is out of blocks: in every slot the released block with
    the earliest deadline, ties by name."""
    period = sum(shares.values())
    waiting = [(0, s is None, s or "", s, 0) for s in shares]  # by release
    ready: list[tuple] = []
    heapq.heapify(waiting)
    slots = {s: array("q") for s in shares}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, last, name, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(i, shares[s], period), last, name, s, i))
        due, last, name, s, i = heapq.heappop(ready)
        assert t < due
        slots[s].append(t)
        if i + 1 == blocks[s]:
            break
        if i + 1 < shares[s]:
            heapq.heappush(waiting, (release(i + 1, shares[s], period), last, name, s, i + 1))
    return slots


def phases(blocks: Mapping[str | None, int], shares: Mapping[str | None, int]) -> list[Phase]:
    """Phases until every source is out of blocks; a phase ends when its first source is. Sources without a share have
    theirs when all others are out of blocks."""
    left = {s: n for s, n in blocks.items() if n}
    before, start, out = dict.fromkeys(left, 0), 0, []
    while left:
        now = reduced({s: shares[s] for s in left if shares[s]} or dict.fromkeys(left, 1))
        period, slots = sum(now.values()), one_period(now, left)
        if any(len(x) == left[s] for s, x in slots.items()):
            taken = {s: len(x) for s, x in slots.items()}
            end = sum(taken.values())
        else:
            end = min((left[s] - 1) // n * period + slots[s][(left[s] - 1) % n] for s, n in now.items()) + 1
            taken = {s: end // period * n + sum(t < end % period for t in slots[s]) for s, n in now.items()}
        out.append(Phase(start, period, now, slots, {s: before[s] for s in now}, taken))
        for s, n in taken.items():
            before[s] += n
        left = {s: n - taken.get(s, 0) for s, n in left.items() if n > taken.get(s, 0)}
        start += end
    return out


def numbered(docs: DataFrame, rows: int, source: str = "source", chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """Adds each document's number among those of its source, by hash. The range of hashes is cut into chunks of some
    thousand documents; a number is the rank in the chunk plus the sizes of the earlier chunks, so no source is one task."""
    bits = (rows // chunk_docs).bit_length()
    chunk = F.shiftright("_hash", 64 - bits) if bits else F.lit(0).cast("long")
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    keyed = docs.withColumns({"_hash": F.xxhash64("doc_id", F.lit(11)), "_tie": tie}).withColumn("_chunk", chunk)
    sizes = keyed.groupBy(F.col(source).alias("_s"), F.col("_chunk").alias("_c")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_s", "_c", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(source, "_chunk").orderBy("_hash", "doc_id", "_tie"))
    joined = keyed.withColumn("_rank", rank).join(offsets, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return joined.withColumn("_number", F.col("_offset") + F.col("_rank") - 1).drop("_hash", "_tie", "_chunk", "_s", "_c", "_offset", "_rank")


def interleave(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_docs: int = BLOCK_DOCS, period: int | None = None, source: str = "source") -> DataFrame:
    """Documents with ``block`` (of their source), ``slot``, its ``release`` and ``deadline``, and ``position``: the slot
    times the size of a block plus the place in the block. Without weights all sources weigh the same. With a ``period``
    the weights are first rounded to whole shares of it; without, they are exact."""
    own = ("block", "slot", "release", "deadline", "position")
    plain = docs.drop(*own)
    counts = {r[0]: r[1] for r in plain.groupBy(source).count().collect()}  # one row a source
    given = weights or {}
    least = min((w for w in given.values() if w > 0), default=1)
    targets = {s: given.get(s, least) for s in counts}
    shares = whole_shares(targets, period) if period else exact_shares(targets)
    plan = phases({s: -(-n // block_docs) for s, n in counts.items()}, shares)
    # A phase that is shorter than its period never gets to the period's end.
    spans = [
        (s, k, p.before[s], p.before[s] + p.taken[s], p.start, min(p.period, LONG), min(p.shares[s], LONG))
        for k, p in enumerate(plan) for s in p.shares if p.taken[s]
    ]
    windows = [
        (s, k, c, slots[i:j].tolist(), [release(x, p.shares[s], p.period) for x in range(i, j)], [min(deadline(x, p.shares[s], p.period), LONG - p.start) for x in range(i, j)])
        for k, p in enumerate(plan) for s, slots in p.slots.items()
        for c, i in enumerate(range(0, len(slots), CHUNK_SLOTS)) for j in [min(i + CHUNK_SLOTS, len(slots))]
    ]
    spark = docs.sparkSession
    span = spark.createDataFrame(spans, "_s string, _phase int, _from long, _to long, _start long, _period long, _share long")
    window = spark.createDataFrame(windows, "_w string, _of int, _part long, _slots array<long>, _releases array<long>, _deadlines array<long>")
    if sum(len(w[3]) for w in windows) <= BROADCAST_SLOTS:
        window = F.broadcast(window)
    number = numbered(plain, sum(counts.values()), source).withColumn("block", F.expr(f"_number div {block_docs}"))
    mine = F.col(source).eqNullSafe(F.col("_s")) & (F.col("block") >= F.col("_from")) & (F.col("block") < F.col("_to"))
    found = number.join(F.broadcast(span), mine).withColumns({"_i": F.expr("(block - _from) % _share"), "_begin": F.expr("_start + (block - _from) div _share * _period")})
    part = F.col(source).eqNullSafe(F.col("_w")) & (F.col("_phase") == F.col("_of")) & (F.expr(f"_i div {CHUNK_SLOTS}") == F.col("_part"))
    at = f"cast(_i % {CHUNK_SLOTS} + 1 as int)"
    placed = found.join(window, part).withColumns({n: F.expr(f"_begin + element_at(_{n}s, {at})") for n in ("slot", "release", "deadline")})
    return placed.withColumn("position", F.expr(f"slot * {block_docs} + _number % {block_docs}")).select(*plain.columns, *own)


def in_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The documents with their own columns in the order of the mixture: range partitions by position, each sorted."""
    placed = interleave(docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in ("block", "slot", "release", "deadline", "position")}), weights, block_docs)
    ordered = placed.repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select(*[F.col(f"_own_{c}").alias(c) if f"_own_{c}" in placed.columns else F.col(c) for c in docs.columns])
