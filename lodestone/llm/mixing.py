"""Mixing sources to target weights by Pfair scheduling.

A source's documents come in blocks. A source of weight w gives its j-th block
(from 1) the release time floor((j-1)/w) and the deadline ceil(j/w); among the
released blocks the one with the earliest deadline takes the next slot. At every
slot t of a phase, each source then has had within one block of w * t.

Weights are the targets to 1/PERIOD = 2**-60, more slots than any mixture has, so
nothing adds up over the slots. The driver goes through the slots once and keeps
how many blocks each source has had at every STEP-th; from there the executors
go through the slots between. When a source has no block left, the phase ends
and the others go on with their weights scaled up; sources whose target is 0
come last: every document has a place in the order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free_names, group_ranks, map_arrow, materialise

#: Units that the weights of a phase add up to.
PERIOD = 1 << 60
#: Slots between two states that the driver keeps.
STEP = 2048

_NONE = "\u0000none"  # stands for a missing source
_LAST = 2**63 - 1  # deadlines beyond this count as this

_STATE = "phase int, start long, lo long, hi long, key array<string>, units array<long>, had array<long>, first array<long>"
_PLACE = "place_key string, place_nth long, phase int, block long, weight double, release long, deadline long, slot long"


class State(NamedTuple):
    """Slots lo..hi-1 of a phase, counted from its start, and what came before."""

    phase: int
    start: int  # the phase's first slot
    lo: int
    hi: int
    units: dict[str, int]  # weight * PERIOD
    had: dict[str, int]  # blocks that each source has had in the phase before lo
    first: dict[str, int]  # first block of each source in the phase


def units(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as positive multiples of 1/period that add up to 1, by largest
    remainder; ties by name."""
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    names = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    gap = period - sum(out.values())
    for s in names[: max(gap, 0)]:
        out[s] += 1
    for _ in range(-gap):
        out[max(out, key=lambda s: (out[s] - exact[s], out[s], s))] -= 1
    return out


def turns(units: dict[str, int], period: int, had: dict[str, int], lo: int = 0) -> Iterator[tuple[int, str, int]]:
    """(slot, source, block) from slot lo on, before which each source has had
    `had` blocks; earliest deadline first.

    Ties go to the block whose window overlaps the next one of its source, then
    to the heavier source, then by name. The order depends on nothing else, so
    it is the same from whatever slot it is taken up.
    """
    waiting = [(had[s] * period // units[s], s, had[s] + 1) for s in units if units[s]]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple] = []
    t = lo
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            deadline = -(-j * period // units[s])
            heapq.heappush(ready, (deadline, j * period % units[s] == 0, -units[s], s, j))
        if ready:
            s, j = heapq.heappop(ready)[-2:]
            yield t, s, j
            heapq.heappush(waiting, (j * period // units[s], s, j + 1))
        t += 1


def period_slots(units: dict[str, int], period: int) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period."""
    slots: dict[str, list[int]] = {s: [] for s in units}
    for t, s, _ in turns(units, period, dict.fromkeys(units, 0)):
        if t >= period:
            return slots
        slots[s].append(t)
    return slots


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD, step: int = STEP) -> Iterator[State]:
    """The states from which all slots follow, until no source has a block left."""
    if bad := [s for s, w in weights.items() if not (math.isfinite(w) and w >= 0)]:
        raise ValueError(f"targets must be finite and not negative: {bad[:5]}")
    left = {s: n for s, n in blocks.items() if n}
    phase = start = 0
    while left:
        shares = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1)
        u = units(shares, period)
        first = {s: blocks[s] - left[s] for s in u}
        had, before, lo = dict.fromkeys(u, 0), dict.fromkeys(u, 0), 0
        for t, s, j in turns(u, period, had.copy()):
            had[s] = j
            if (over := j == left[s]) or t + 1 - lo == step:
                yield State(phase, start, lo, t + 1, u, before, first)
                before, lo = had.copy(), t + 1
            if over:
                break
        phase, start = phase + 1, start + lo
        left = {s: n - had.get(s, 0) for s, n in left.items() if n > had.get(s, 0)}


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slot of the states."""
    names = [c.split()[0] for c in _PLACE.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for r in batch.to_pylist():
            u, had, first = (dict(zip(r["key"], r[c], strict=True)) for c in ("units", "had", "first"))
            start, out = r["start"], []
            for t, s, j in turns(u, PERIOD, had, r["lo"]):
                if t >= r["hi"]:
                    break
                release, deadline = start + (j - 1) * PERIOD // u[s], start - (-j * PERIOD // u[s])
                out.append((s, first[s] + j - 1, r["phase"], j, u[s] / PERIOD, min(release, _LAST), min(deadline, _LAST), start + t))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, block_rows: int = 16) -> DataFrame:
    """doc_id, source, phase, block, weight, release, deadline, slot, position for
    every row of docs; position orders the mixture.

    weights are targets by source; without them a source counts with its number
    of rows to the power `flatten`, and so does a source that weights leave out.
    A source whose target is 0 has no share while others have blocks left; such
    sources then follow in equal shares. A negative target is an error.
    block counts within source and phase, from 1; release, deadline and slot
    count from the mixture's start. docs needs doc_id and source; other columns
    are ignored. A null source is a source of its own. Rows are placed as often
    as they come. A source's last block may be short; positions there have gaps.
    """
    found = _short(docs, F.monotonically_increasing_id())
    return _placed(materialise(found, "mix-rows"), weights, flatten, block_rows).drop("rid")


def _short(docs: DataFrame, rid: Column) -> DataFrame:
    source = F.col("source").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(source, F.lit(_NONE)).alias("key"), rid.alias("rid")
    )


def _placed(rows: DataFrame, weights: dict[str, float] | None, flatten: float, block_rows: int) -> DataFrame:
    spark = rows.sparkSession
    counts = {r["key"]: r["count"] for r in rows.groupBy("key").count().collect()}  # a row for each source
    targets = {s: (weights or {}).get(s, n**flatten) for s, n in counts.items()}
    states = [
        (x.phase, x.start, x.lo, x.hi, list(x.units), list(x.units.values()), [x.had[s] for s in x.units], [x.first[s] for s in x.units])
        for x in schedule({s: -(-n // block_rows) for s, n in counts.items()}, targets)
    ]
    places = map_arrow(spark.createDataFrame(states, _STATE), _slots, _PLACE)
    ranked = group_ranks(rows, "key", "rid", "rank").withColumn("nth", F.floor(F.col("rank") / block_rows))
    here = (F.col("key") == F.col("place_key")) & (F.col("nth") == F.col("place_nth"))
    position = F.col("slot") * block_rows + F.col("rank") % block_rows
    return ranked.join(places, here).select(
        "doc_id", "source", "phase", "block", "weight", "release", "deadline", "slot", position.cast("long").alias("position"), "rid"
    )


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, block_rows: int = 16, position: str | None = None
) -> DataFrame:
    """The rows of docs in the order of the mixture; same columns. With `position`,
    each row has its place as that column instead, and the rows aren't sorted: a
    reader that goes by places needs no order of rows. Every row has its own place,
    rows that repeat a doc_id or have none like the others; null texts and sources
    stay as they are, an empty table gives an empty one."""
    rid, at = free_names(docs, "mix_rid", "mix_at")
    numbered = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-docs")
    places = _placed(_short(numbered, F.col(rid)), weights, flatten, block_rows)
    placed = numbered.join(places.select(F.col("rid").alias(rid), F.col("position").alias(at)), rid)
    if position is None:
        return placed.orderBy(at).select(*docs.columns)
    return placed.select(*[c for c in docs.columns if c != position], F.col(at).alias(position))
