"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns virtual nodes on a ring; a key belongs to the arc that ends at
the next virtual node clockwise. Each shard takes rows only up to its bound. The
bounds add up to the number of rows and differ by at most one, so the shards end
up at most one row apart: what overflows a full shard continues clockwise to the
next virtual node of a shard that still has room.

The walk is decided on row counts by arc, a table of shards * virtual nodes
rows, never on single keys: rows of an arc are ranked, and the plan says which
ranks of which arc end where. The rows themselves are only joined with that plan.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import group_ranks, materialise, whole_text

#: Positions on the ring.
CELLS = 1 << 16


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes, clockwise. A position that two of
    them hash to belongs to the lower shard."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
            nodes.setdefault(int.from_bytes(digest, "big") % CELLS, shard)
    return sorted(nodes.items())


def walk(nodes: list[tuple[int, int]], counts: dict[int, int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rows, shard, first slot): where the rows of each arc go.

    Rows first ask the shard at the end of their arc. In each round every node
    admits, clockwise, what its shard has room for; the rest moves on to the next
    node of a shard with room.
    """
    room = list(bounds)
    plan: list[tuple[int, int, int, int, int]] = []
    waiting = {arc: [(arc, 0, n)] for arc, n in counts.items() if n}
    while waiting:
        beyond: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for at in sorted(waiting):
            shard = nodes[at][1]
            for arc, rank, n in waiting[at]:
                taken = min(n, room[shard])
                if taken:
                    plan.append((arc, rank, taken, shard, bounds[shard] - room[shard]))
                    room[shard] -= taken
                if n > taken:
                    beyond[at].append((arc, rank + taken, n - taken))
        waiting = defaultdict(list)
        for at, left in beyond.items():
            while room[nodes[at][1]] == 0:
                at = (at + 1) % len(nodes)
            waiting[at] += left
    return plan


def shard(docs: DataFrame, shards: int = 16, virtual_nodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The law is `rows`: counts at most one apart; as a row's place then depends on
    the others, grown_shard is null. docs needs doc_id and text; other columns
    are ignored. A null text has size 1, a missing doc_id is a key like any
    other. Rows that repeat a doc_id share an arc and go where it has room, each
    with its own slot. With fewer rows than shards the last shards stay empty.
    """
    spark = docs.sparkSession
    text = whole_text()
    nodes = ring(shards, virtual_nodes)
    positions = [p for p, _ in nodes]
    arcs, arc = [], 0
    for cell in range(CELLS):
        while arc < len(positions) and positions[arc] < cell:
            arc += 1
        arcs.append((cell, arc % len(positions)))
    cells = spark.createDataFrame(arcs, "cell int, arc int")  # CELLS rows, always
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(CELLS)).cast("int").alias("cell"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = materialise(rows.join(F.broadcast(cells), "cell").drop("cell"), "shard-rows")
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}  # a row for each arc at most
    total = sum(counts.values())
    bounds = [total // shards + (k < total % shards) for k in range(shards)]
    plan = spark.createDataFrame(
        walk(nodes, counts, bounds), "plan_arc int, first long, n long, shard int, first_slot long"
    )  # a row for each arc, and one for each time that a shard fills up while an arc is being dealt
    ranked = group_ranks(rows, "arc", "rid", "rank")
    here = (F.col("arc") == F.col("plan_arc")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    return ranked.join(F.broadcast(plan), here).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
