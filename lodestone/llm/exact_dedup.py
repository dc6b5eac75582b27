"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition turns its texts into one sorted run of digests. The runs
then meet in binomial rounds: the partitions are the nodes of a tree with
fan-in F, written as R digits to the base F. In round r the nodes that differ
only in digit r exchange their runs: an entry goes to the member of that group
whose digit r is the digit r of the entry's home (a hash of its digest). Runs
travel as blocks of sorted entries, cut at the same digests everywhere, so the
receiver merges range by range: up to F sorted runs, two by two, without sorting
anything again. Of each distinct text it keeps one entry: the preferred identifier
and how many rows it stands for. After R rounds every digest has met all its
equals. Equals collapse at every level, so a text that fills a third of the corpus
sends one entry for each node and round.

Entries count as equal only if the whole 256-bit digest, the byte length and a
second, independent 64-bit hash agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free_names, map_arrow, materialise, shuffle_partitions, whole_text

#: Runs that one node merges in a round.
FAN_IN = 4
#: Entries in a range of a node's run, about: what a merge holds.
RANGE = 50_000
#: Bytes of a key: digest, length and second hash.
_WIDTH = 48

_ENTRY = "key binary, home int, keep_id long, keep_rid long, n long"
_BLOCK = "node int, range int, run int, seq int, block binary"


class Run(NamedTuple):
    """Entries sorted by key, each key once."""

    key: np.ndarray  # of _WIDTH bytes
    home: np.ndarray
    named: np.ndarray  # whether keep_id is an id
    keep_id: np.ndarray
    keep_rid: np.ndarray
    n: np.ndarray

    def take(self, at: np.ndarray) -> Run:
        return Run(*(x[at] for x in self))

    def pack(self) -> bytes:
        return b"".join(np.ascontiguousarray(x).tobytes() for x in self)


_TYPES = (f"S{_WIDTH}", "<i4", "?", "<i8", "<i8", "<i8")
_SIZE = sum(np.dtype(t).itemsize for t in _TYPES)


def unpack(raw: bytes) -> Run:
    count, at, columns = len(raw) // _SIZE, 0, []
    for t in _TYPES:
        columns.append(np.frombuffer(raw, t, count, at))
        at += count * np.dtype(t).itemsize
    return Run(*columns)


def joined(runs: list[Run]) -> Run:
    return Run(*(np.concatenate(x) for x in zip(*runs, strict=True)))


def _zipped(a: Run, b: Run) -> Run:
    """Two sorted runs as one; of equal keys the first run's come first."""
    at = np.searchsorted(a.key, b.key, "right") + np.arange(len(b.key))
    from_b = np.zeros(len(a.key) + len(b.key), bool)
    from_b[at] = True
    out = []
    for x, y in zip(a, b, strict=True):
        both = np.empty(len(from_b), x.dtype)
        both[from_b], both[~from_b] = y, x
        out.append(both)
    return Run(*out)


def collapse(run: Run, largest: bool) -> Run:
    """Equal keys, which are neighbours, as one: the counts added up, and the entry to
    keep. Entries without an id come last, then it goes by id and by row."""
    if not len(run.key):
        return run
    fresh = np.r_[True, run.key[1:] != run.key[:-1]]
    starts = np.flatnonzero(fresh)
    if len(starts) == len(fresh):
        return run
    group = np.cumsum(fresh) - 1
    by_id = np.where(run.named, ~run.keep_id if largest else run.keep_id, 0)  # ~ turns the order and can't overflow
    order = np.lexsort((run.keep_rid, by_id, ~run.named, group))
    return run.take(order[starts])._replace(n=np.add.reduceat(run.n, starts))


def merge(runs: list[Run], largest: bool) -> Run:
    """Sorted runs as one sorted run with each key once: merged two by two, as a
    tournament, equals collapsed at the end."""
    while len(runs) > 1:
        runs = [_zipped(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return collapse(runs[0], largest)


def _from_batch(batch: pa.RecordBatch) -> Run:
    key = np.frombuffer(b"".join(batch["key"].to_pylist()), f"S{_WIDTH}")
    keep_id = batch["keep_id"]
    plain = lambda c: batch[c].to_numpy(zero_copy_only=False)
    return Run(key, plain("home"), ~np.array(keep_id.is_null()), keep_id.fill_null(0).to_numpy(zero_copy_only=False), plain("keep_rid"), plain("n"))


def _to_batch(run: Run) -> pa.RecordBatch:
    key = pa.Array.from_buffers(pa.binary(_WIDTH), len(run.key), [None, pa.py_buffer(run.key.tobytes())]).cast(pa.binary())
    columns = [key, pa.array(run.home, pa.int32()), pa.array(run.keep_id, pa.int64(), mask=~run.named), pa.array(run.keep_rid, pa.int64()), pa.array(run.n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["key", "home", "keep_id", "keep_rid", "n"])


def _ranges(run: Run, ranges: int) -> np.ndarray:
    """The range of each entry: by the digest's first 32 bits, so it grows with the key."""
    head = np.frombuffer(run.key.tobytes(), ">u4").reshape(-1, _WIDTH // 4)[:, 0].astype(np.uint64)
    return (head * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _blocks(run: Run, source: int, node: int, unit: int, fan_in: int, ranges: int, seq: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """What a node sends in the round of `unit`: a block for each range and member of
    its group; entries keep their order. source numbers the sorted run."""
    digit = node // unit % fan_in
    target = node + (run.home // unit % fan_in - digit) * unit
    where = _ranges(run, ranges)
    order = np.lexsort((where, target))  # stable, so each block is sorted by key
    run, target, where = run.take(order), target[order], where[order]
    cuts = np.flatnonzero(np.r_[True, (target[1:] != target[:-1]) | (where[1:] != where[:-1]), True]) if len(order) else np.zeros(1, int)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(target[a]), int(where[a]), source, seq, run.take(slice(a, b)).pack()


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])


def _first_runs(nodes: int, fan_in: int, ranges: int, largest: bool):
    """The input's sorted runs, equals collapsed, as the blocks of the first round. A
    task holds a batch and the entries of one key beyond it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, part, seq = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["part"][0].as_py()
            run = _from_batch(batch)
            run = collapse(run if carry is None else joined([carry, run]), largest)
            carry, run = run.take(slice(-1, None)), run.take(slice(0, -1))
            yield _block_batch(list(_blocks(run, part, part % nodes, 1, fan_in, ranges, seq)))
            seq += 1
        if carry is not None:
            yield _block_batch(list(_blocks(carry, part, part % nodes, 1, fan_in, ranges, seq)))

    return rows


def _merged(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[tuple[int, Run]]:
    """(node, merged range) of blocks sorted by node, range, run and seq."""

    def each() -> Iterator[tuple]:
        for batch in batches:
            names = ("node", "range", "run", "seq")
            yield from zip(*(batch[c].to_pylist() for c in names), batch["block"].to_pylist(), strict=True)

    for (node, _), blocks in groupby(each(), key=lambda x: x[:2]):
        runs = [joined([unpack(x[4]) for x in own]) for _, own in groupby(blocks, key=lambda x: x[2])]
        yield node, merge(runs, largest)


def _round(unit: int, fan_in: int, ranges: int, largest: bool):
    """Merges what came and sends it on to the next round."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, (node, run) in enumerate(_merged(batches, largest)):
            yield _block_batch(list(_blocks(run, node, node, unit, fan_in, ranges, seq)))

    return rows


def _last(largest: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run in _merged(batches, largest):
            yield _to_batch(run)

    return rows


def merge_runs(entries: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One row for each distinct text: its key, keep_id, keep_rid and n.

    entries has a row for each document: doc_id long, key binary(48) and rid long
    (unique), written in a table.
    """
    largest = keep == "largest"
    nodes, rounds = fan_in, 1
    while nodes < shuffle_partitions(entries.sparkSession):
        nodes, rounds = nodes * fan_in, rounds + 1
    ranges = max(1, -(-entries.count() // (nodes * RANGE)))
    runs = entries.select(
        "key", F.pmod(F.xxhash64("key"), F.lit(nodes)).cast("int").alias("home"), F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.lit(1).cast("long").alias("n")
    )
    local = runs.sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    blocks = map_arrow(local, _first_runs(nodes, fan_in, ranges, largest), _BLOCK)
    for r in range(1, rounds + 1):
        met = blocks.repartition(nodes, "node").sortWithinPartitions("node", "range", "run", "seq")
        if r == rounds:
            return map_arrow(met, _last(largest), _ENTRY).drop("home")
        blocks = map_arrow(met, _round(fan_in**r, fan_in, ranges, largest), _BLOCK)
    raise AssertionError


def digest_entries(docs: DataFrame) -> DataFrame:
    """A short row for each document, written in the shared folder."""
    text = whole_text()
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))  # noqa: E731  so that keys sort as bytes
    entries = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.concat(F.unhex(F.sha2("t", 256)), eight(F.octet_length("t").cast("long")), eight(F.xxhash64("t"))).alias("key"),
        F.monotonically_increasing_id().alias("rid"),
        F.spark_partition_id().alias("src"),
    )
    return materialise(entries, "dedup-entries")


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    docs needs doc_id and text; other columns are ignored, whatever their names.
    A null text counts as empty. Rows without a doc_id stay only if no row of
    their group has one; among rows that repeat the id to keep, the first read
    stays, so exactly one row of each group is kept. An empty table gives an
    empty result.
    """
    entries = digest_entries(docs)
    groups = merge_runs(entries, keep)
    # The way back down: an answer for each (text, input partition), so that the
    # rows of a text that fills the corpus stay spread over the partitions.
    answers = entries.select("key", "src").distinct().join(groups, "key")
    return entries.join(answers, ["key", "src"]).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs without the rows that repeat a text; same columns. The row that stays is
    that of exact_dedup: rows without a doc_id only where no row of the text has
    one, and of several with the id that stays one. A null text counts as empty,
    and one such row stays; an empty table gives an empty one."""
    key, sha = free_names(docs, "key", "sha")
    absent = F.lit(-(2**63))  # a row without an id; one with this id wins over it
    winners = exact_dedup(docs, keep).where("kept").select(
        F.coalesce("doc_id", absent).alias(key), F.unhex("text_sha256").alias(sha)
    )
    marked = docs.withColumns(
        {key: F.coalesce(docs["doc_id"].cast("long"), absent), sha: F.unhex(F.sha2(whole_text(), 256))}
    )
    return marked.join(winners, [key, sha], "left_semi").dropDuplicates([key, sha]).select(*docs.columns)
