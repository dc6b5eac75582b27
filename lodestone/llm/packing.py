"""Best-fit packing of tokenised documents into sequences of fixed length.

One pass tokenises the texts and cuts those longer than a sequence; what it
writes is short. The packing itself is decided on the histogram of lengths (see
packing_plan) and carried out by rank: the r-th piece of a length finds its
sequence and place in the plan, so that no task gathers pieces of a sequence.

Where the documents have an order, such as a mixture's, they are packed window by
window of that order, a task for each: sequences come in the order of their
windows and, within one, of their first documents.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import group_ranks, map_arrow, materialise, whole_text
from lodestone.llm.packing_plan import plan

#: Encoded words that a worker keeps; at most some 200 bytes each.
CACHE_WORDS = 100_000

#: A length up to this share of a sequence is small. A plan is made for each and
#: the one with the fewest sequences is carried out.
SMALL = (1 / 4, 1 / 2)

#: Places of an order that are packed together, and groups of their plans. A
#: window's cost doesn't depend on how many there are.
WINDOW, WINDOW_GROUPS = 8192, 16

#: Windows up to which their offsets are sent to every executor.
BROADCAST_ROWS = 100_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, Encoder] = {}


def _ranked(spec: dict):
    """A byte-level BPE of the tokenizers library as ranks: in such a vocabulary a
    token's id is its rank among the merges, after the 256 bytes."""
    import tiktoken
    from public_tokenizers import PATTERN

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokeniser always cuts before a single space between two
    characters that are no white space, so the ids of a text are those of its
    words, each with the space before it, in a row. Words come from a cache; new
    ones are encoded many at a time with the same vocabulary as ranks, which
    gives the same ids (held against the tokeniser in the tests) in less time.
    Texts with a word between spaces that is empty or has white space at an end,
    or with a special token's string, are encoded whole by the tokeniser itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _ranked(json.loads(self.tokenizer.to_str()))
        starts = [self.fast.decode_single_token_bytes(k).startswith(b" ") for k in range(self.fast.n_vocab)]
        self.starts = np.array(starts)
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(part)), "<u4")
            raw = ids.tobytes()  # each word begins at an id whose token begins with a space
            cuts = [*(4 * np.flatnonzero(self.starts[ids])).tolist(), len(raw)]
            self.words.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        split = [t.split(" ") if not any(s in t for s in self.specials) else [t] for t in texts]
        heads = [words.pop(0) for words in split]
        new = set().union(*split).difference(self.words)
        odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        self._learn(list(new - odd))
        known = self.words.__getitem__
        return [
            self.whole(text) if odd and not odd.isdisjoint(words) else b"".join([self.whole(head), *map(known, words)])
            for text, head, words in zip(texts, heads, split, strict=True)
        ]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """(start, ids) of the pieces: all but the first are full."""
    n = len(ids) // 4
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, ids[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]


def piece_rows(path: str, capacity: int, end_id: int) -> Callable:
    """Pieces of (doc_id, text, at): at is the document's place in an order, if any."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                out = [
                    (doc_id, k, start, len(ids) // 4, zlib.crc32(ids), place)
                    for doc_id, place, found in zip(
                        part["doc_id"].to_pylist(), part["at"].to_pylist(), encode(part["text"].to_pylist()), strict=True
                    )
                    for k, (start, ids) in enumerate(cut(found + end, capacity))
                ]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "at"])

    return rows


def _places(runs: np.ndarray) -> Callable:
    """runs: rows of packing_plan.Run, sorted by length and rank."""
    starts = runs[:, 0] << 44 | runs[:, 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = runs[np.searchsorted(starts, length << 44 | rank, "right") - 1]
            place, column = np.divmod(rank - run[:, 1], np.maximum(run[:, 2], 1))
            table = pa.Table.from_batches([batch]).drop_columns(["at", "rank", "rid"])
            table = table.append_column("sequence_id", pa.array(run[:, 4] + column, pa.int64()))
            table = table.append_column("offset", pa.array(run[:, 5] + place * length, pa.int64()))
            yield from table.to_batches()

    return rows


def best_plan(hist: dict[int, int], capacity: int, groups: int) -> np.ndarray:
    """Rows of packing_plan.Run, sorted by length and rank."""
    plans = [plan(hist, capacity, groups, small) for small in SMALL]
    best = min(plans, key=lambda runs: max((r.seq + r.bins for r in runs), default=0))
    return np.array(sorted(best), np.int64).reshape(-1, 6)


def _packed_window(capacity: int) -> Callable:
    """The pieces of a window with sequences from 0, by their first documents."""

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "ascending"), ("at", "ascending"), ("piece", "ascending"), ("rid", "ascending")])
        length, at = group["length"].to_numpy(), group["at"].to_numpy()
        lengths, starts, counts = np.unique(length, return_index=True, return_counts=True)
        rank = np.arange(len(length)) - np.repeat(starts, counts)
        runs = best_plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacity, WINDOW_GROUPS)
        run = runs[np.searchsorted(runs[:, 0] << 44 | runs[:, 1], length << 44 | rank, "right") - 1]
        place, column = np.divmod(rank - run[:, 1], run[:, 2])
        _, seq = np.unique(run[:, 4] + column, return_inverse=True)
        first = np.full(seq.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, seq, at)
        number = np.argsort(np.argsort(first, kind="stable"))
        group = group.drop_columns(["at", "rid"])
        group = group.append_column("sequence_id", pa.array(number[seq], pa.int64()))
        return group.append_column("offset", pa.array(run[:, 5] + place * length, pa.int64()))

    return packed


def _pack_in_order(pieces: DataFrame, capacity: int, window: int) -> DataFrame:
    grouped = pieces.withColumn("window", F.floor(F.col("at") / window)).groupBy("window")
    schema = f"{_PIECES}, window long, sequence_id long, offset long"
    placed = materialise(grouped.applyInArrow(_packed_window(capacity), schema), "packed-windows")
    sizes = placed.groupBy("window").agg((F.max("sequence_id") + 1).alias("n")).orderBy("window").collect()  # a row for each window
    before = np.cumsum([0, *(r["n"] for r in sizes)]).tolist()
    offsets = [(r["window"], b) for r, b in zip(sizes, before, strict=False)]
    known = placed.sparkSession.createDataFrame(offsets, "window long, before long")
    joined = placed.join(F.broadcast(known) if len(offsets) <= BROADCAST_ROWS else known, "window")
    return joined.withColumn("sequence_id", F.col("before") + F.col("sequence_id")).drop("window", "before")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, groups: int = 48, order: str | None = None, window: int = WINDOW
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Sequences are numbered from 0 and filled from place 0 without gaps.

    docs needs doc_id and text; other columns are ignored. A null or empty text
    is the end token alone. Repeated rows are packed as often as they come, rows
    without a doc_id like the others. An empty table gives an empty result. Of
    pieces of equal length, which goes where is settled by the written row ids.

    order names a column with each row's place in an order, as mixing.mixed gives
    it. All pieces of the places k*window to (k+1)*window-1 then stand in
    sequences of their own, before those of later places.
    """
    at = F.lit(0).cast("long") if order is None else F.coalesce(F.col(order).cast("long"), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), at.alias("at"))
    pieces = map_arrow(texts, piece_rows(tokenizer, capacity, end_id), f"{_PIECES}, at long")
    pieces = materialise(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    if order is not None:
        return _pack_in_order(pieces, capacity, window)
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = best_plan(hist, capacity, groups)
    ranked = group_ranks(pieces, "length", "rid", "rank")
    return map_arrow(ranked, _places(runs), f"{_PIECES}, sequence_id long, offset long")
