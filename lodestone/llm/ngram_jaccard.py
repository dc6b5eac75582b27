"""N-gram Jaccard join: which documents link by shared word shingles.

Universe-partition pigeonhole (see jaccard_segments): every distinct set sends a
key for each of its first segments' subsets; sets that share keys are candidates
and are verified exactly. Three things keep it linear:

- Equal sets are one class, and a task sends the keys of a class once.
- Keys travel as blocks of numbers, and only keys that two classes share leave
  the task that sees them: as pairs, counted, where at most FEW classes share a
  key, and as members of the key otherwise. A pair must share a proven number of
  keys. It has at least half of them among the first kind, and is then found as
  a pair, or among the second; its two sets then both have that many keys of the
  second kind, and such sets are tied to the smallest member of each.
- Pairs and ties only say which sets must meet, by components. A large component
  is mostly held together by passages that many texts share; there only sets that
  also share one of their rarest shingles (a prefix filter: linked sets do) stay
  together. What is left is dealt out in chunks of bounded size. The sets of a chunk meet first, then one
  set of each group that these found, over the chunks; only where a component
  isn't one group by then do its chunks meet two by two, without those that are
  of one group. A task compares a set only with sets that it isn't connected
  with yet. Links that span the components come out, never all pairs.

What a Python worker holds is bounded: HELD keys before they are sent, about as
many of a bucket (a key that more classes share is passed on as it comes), two
chunks of sets, and the names of SEEN classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import jaccard_segments as J
from lodestone.llm.common import free_names, map_arrow, materialise, shuffle_partitions, tidy, whole_text
from lodestone.llm.components import components

#: Classes that share a key up to which their pairs are counted.
FEW = 12
#: Keys that a task holds before it sends them, or passes on what many share.
HELD = 500_000
#: Pairs that a task adds up before it passes them on.
PAIRS = 200_000
#: Names of classes that a task remembers not to send their keys again.
SEEN = 200_000
#: Shingles in a chunk of a component of candidates, about; every set counts as
#: SET more.
CHUNK, SET = 1_000_000, 32
#: Shingles of a component, counted alike, beyond which it is taken apart first.
LARGE = 1 << 15
#: Buckets of keys for each shuffle partition.
SPREAD = 8
#: Buckets of document ids by which texts are preselected for verification. The
#: buckets in use are broadcast: BUCKETS numbers at most.
BUCKETS = 1 << 19

_DOC, _PAIR, _MEMBER = 0, 1, 2
_SURE = 1 << 30  # counts for a key of a neighbourhood: one is enough
_NOBODY = -(2**63)  # in place of a missing doc_id

_MAPPED = "kind int, doc_id long, rid long, src int, size long, a long, b long, bucket int, block binary"
_REDUCED = "kind int, doc_id long, rid long, src int, size long, a long, b long, n long"


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    arrays = [pa.array(columns[n], types[t]) if n in columns else pa.nulls(rows, types[t]) for n, t in fields]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _mapped(buckets: int):
    """A row for each document, and blocks of (keys, classes) by key bucket."""

    def blocks(keys: list[np.ndarray], classes: list[int]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        flat, owner = np.concatenate(keys), np.repeat(np.array(classes, np.int64), [len(k) for k in keys])
        bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        flat, owner, bucket = flat[order], owner[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        parts = [flat[i:j].tobytes() + owner[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
        for at in range(0, len(parts), 1000):
            some = parts[at : at + 1000]
            yield _batch(_MAPPED, len(some), kind=[_MEMBER] * len(some), bucket=bucket[cuts[:-1]][at : at + 1000], block=some)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, classes, held = [], [], 0
        for batch in batches:
            sizes, names = [], []
            for text in batch["text"]:
                s = J.shingles(text.as_py())
                name = J.digest(s)
                sizes.append(len(s))
                names.append(name)
                if len(s) and name[0] not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()  # to send keys twice changes nothing
                    seen.add(name[0])
                    keys.append(J.allocation(s))
                    classes.append(name[0])
                    held += len(keys[-1])
                    if held > HELD:
                        yield from blocks(keys, classes)
                        keys, classes, held = [], [], 0
            n = batch.num_rows
            rid = batch["rid"].to_numpy()
            yield _batch(
                _MAPPED, n, kind=[_DOC] * n, doc_id=batch["doc_id"], rid=rid, src=batch["src"], size=sizes,
                a=[x for x, _ in names], b=[x for _, x in names], bucket=(rid % buckets).astype(np.int32),
            )
        yield from blocks(keys, classes)

    return rows


def _distinct(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, classes) sorted and without repetitions, and each key's start and count."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])] if len(keys) else np.empty(0, bool)
    keys, classes = keys[fresh], classes[fresh]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys, classes, starts, np.diff(np.r_[starts, len(keys)])


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs once each, with the sum of their counts."""
    found, at = np.unique(np.rec.fromarrays([a, b], names="a,b"), return_inverse=True)
    return found["a"], found["b"], np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)


def _pairs(classes: np.ndarray, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, count) of the pairs under keys of 2 to FEW classes."""
    a, b, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in range(2, FEW + 1):
        own = starts[sizes == size]
        weight = np.where(keys[own] & np.uint64(1), _SURE, 1)
        for i in range(size):
            for j in range(i + 1, size):
                a.append(classes[own + i])
                b.append(classes[own + j])
                n.append(weight)
    return _summed(np.concatenate(a), np.concatenate(b), np.concatenate(n))


def shared_in(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all the classes that have each key: (a, b, count) of the pairs under keys
    of at most FEW classes, and (key, class) of the members of the others."""
    keys, classes, starts, sizes = _distinct(keys, classes)
    many = np.repeat(sizes > FEW, sizes)
    return *_pairs(classes, keys, starts, sizes), keys[many], classes[many]


class Bucket:
    """The keys of one bucket as they come in. A key that more than FEW classes
    share by the time that HELD are held is passed on, and later classes of it as
    they come, so a key's classes are never gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.hot, self.held, self.bound = np.empty(0, np.uint64), 0, HELD

    def add(self, keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, class) that need not be held."""
        out = [(keys[:0], classes[:0])]
        if len(self.hot):
            at = np.isin(keys, self.hot)
            out.append((keys[at], classes[at]))
            keys, classes = keys[~at], classes[~at]
        self.parts.append((keys, classes))
        self.held += len(keys)
        if self.held > self.bound:
            keys, classes, starts, sizes = _distinct(*self._all())
            many = np.repeat(sizes > FEW, sizes)
            out.append((keys[many], classes[many]))
            self.hot = np.union1d(self.hot, keys[starts[sizes > FEW]])
            self.parts = [(keys[~many], classes[~many])]
            self.held = len(self.parts[0][0])
            self.bound = max(HELD, 2 * self.held)  # what is left is FEW for each key at most
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _all(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))

    def end(self) -> tuple[np.ndarray, ...]:
        return shared_in(*self._all())


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; a bucket's keys are held, no more."""

    def members(key: np.ndarray, member: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 50_000):
            some = slice(at, at + 50_000)
            odd = (key[some] & np.uint64(1)).astype(np.int64)
            yield _batch(_REDUCED, len(odd), kind=np.full(len(odd), _MEMBER), a=key[some].view(np.int64), b=member[some], n=odd * _SURE)

    def passed(found: list) -> Iterator[pa.RecordBatch]:
        if found:
            a, b, n = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
            for at in range(0, len(a), 50_000):
                some = slice(at, at + 50_000)
                yield _batch(_REDUCED, len(a[some]), kind=np.full(len(a[some]), _PAIR), a=a[some], b=b[some], n=n[some])
            found.clear()

    def ended(bucket: Bucket) -> Iterator[pa.RecordBatch]:
        *pairs, key, member = bucket.end()
        found.append(pairs)
        if sum(len(x[0]) for x in found) > PAIRS:
            yield from passed(found)
        yield from members(key, member)

    found: list[list[np.ndarray]] = []
    number, bucket = None, None
    for batch in batches:
        is_doc = np.array(batch["kind"].to_numpy() == _DOC)
        docs = batch.filter(pa.array(is_doc))
        if docs.num_rows:
            yield _batch(_REDUCED, docs.num_rows, **{c: docs[c] for c in ("kind", "doc_id", "rid", "src", "size", "a", "b")})
        blocks = batch.filter(pa.array(~is_doc))
        for k, block in zip(blocks["bucket"].to_pylist(), blocks["block"], strict=True):
            if k != number:
                if bucket is not None:
                    yield from ended(bucket)
                number, bucket = k, Bucket()
            raw = np.frombuffer(block.as_py(), np.uint64)
            yield from members(*bucket.add(raw[: len(raw) // 2], raw[len(raw) // 2 :].view(np.int64)))
    if bucket is not None:
        yield from ended(bucket)
    yield from passed(found)


def _allotment(size: Column) -> Column:
    need = F.floor(size / 4) + 1
    return need + F.ceil(need / 4)


def shared_keys(x: Column, y: Column) -> Column:
    """Plain keys that linked sets of these sizes share, at least."""
    return F.least(_allotment(x), _allotment(y)) - F.floor((x + y) / 9)


def least_shared(size: Column) -> Column:
    """What shared_keys is at least, over all sizes y that a linked set can have.
    shared_keys rises and falls by rounding, so the ends of the range don't tell.
    But an allotment is 5/16 * (size + 1) or more: for y <= size, shared_keys is at
    least 5/16 * (y + 1) - (size + y) / 9, which grows with y and is size / 20 + 5/16
    at y = 4/5 * size; for larger y it is more. The whole number above that counts."""
    return F.ceil((4 * size + 25) / 80)


def _half(n: Column) -> Column:
    return F.greatest(F.ceil(n / 2), F.lit(1))


def _candidates(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs and ties between classes that must meet."""
    size = classes.select("id", "size")  # a row for each class
    sa, sb = size.select(F.col("id").alias("a"), F.col("size").alias("x")), size.select(F.col("id").alias("b"), F.col("size").alias("y"))
    pairs = found.where(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.sum("n").alias("n")).join(sa, "a").join(sb, "b")
    x, y = F.col("x"), F.col("y")
    near = (F.least(x, y) * 5 >= F.greatest(x, y) * 4) & (F.col("n") >= _half(shared_keys(x, y)))
    pairs = pairs.where(near).select("a", "b")
    members = found.where(F.col("kind") == _MEMBER).select(F.col("a").alias("key"), F.col("b").alias("id"), "n")
    often = members.groupBy("id").agg(F.sum(F.greatest("n", F.lit(1))).alias("n")).join(size, "id")
    least = least_shared(F.col("size"))  # those of the second kind that are left if the first are too few
    enough = often.where(F.col("n") >= least - _half(least) + 1).select("id")
    tied = members.select("key", "id").join(enough, "id")
    first = tied.groupBy("key").agg(F.min("id").alias("first"))
    ties = tied.join(first, "key").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return pairs.unionByName(ties)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets by class; one that repeats an id and text comes once from a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc"].to_pylist(), batch["text"], strict=True):
            found = J.shingles(text.as_py())
            name = J.digest(found)[0]
            if (doc, name) not in seen:
                if len(seen) >= SEEN:
                    seen.clear()  # _links drops what comes twice
                seen.add((doc, name))
                out.append((doc, name, found.tobytes()))
        columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "id", "elements"])


def _links(group: pa.Table) -> pa.Table:
    ids, at = np.unique(group["id"].to_numpy(), return_index=True)
    group = group.take(pa.array(at))
    sets = [np.frombuffer(e, np.uint64) for e in group["elements"].to_pylist()]
    links = np.array(J.spanning_links(sets, group["mark"].to_pylist()), np.int64).reshape(-1, 2)
    if group.nbytes > 1 << 20:
        del sets, group
        tidy()
    return pa.table({"a": ids[links[:, 0]], "b": ids[links[:, 1]]})


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, id, elements of the sets of wanted (doc), and of some others."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    used = wanted.select(bucket("doc").alias("bucket")).distinct()  # BUCKETS rows at most
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NOBODY)).alias("doc"), whole_text().alias("text"))
    texts = texts.withColumn("bucket", bucket("doc")).join(F.broadcast(used), "bucket", "left_semi").select("doc", "text")
    return map_arrow(texts, _sets, "doc long, id long, elements binary")


def _met(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """Links (a, b) among the sets that meet. dealt: id, doc, mark, label, i, j;
    sets of one mark are connected."""
    met = dealt.join(_texts(docs, dealt), ["id", "doc"]).select("label", "i", "j", "id", "mark", "elements")
    return met.groupBy("label", "i", "j").applyInArrow(_links, "a long, b long")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20):
            part = batch.slice(at, 20)
            sets = [np.frombuffer(e, np.int64) for e in part["elements"].to_pylist()]
            often = [len(x) for x in sets]
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            columns = [np.repeat(part[c].to_numpy(), often) for c in ("id", "size")] + [flat]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["id", "size", "e"])


def _refined(docs: DataFrame, known: DataFrame) -> DataFrame:
    """known (id, doc, size, label) with new labels: that of the sets with which a set
    shares, directly or by others, one of its rarest shingles; other sets go.

    With the shingles of every set in one order, by how many of the sets have them,
    two linked sets share one of the first size - ceil(4/5 * size) + 1 of each. A set
    that comes twice has more places, so nothing is lost."""
    sets = known.select("id", "doc", "size").join(_texts(docs, known), ["id", "doc"]).select("id", "size", "elements")
    each = materialise(map_arrow(sets, _spread, "id long, size long, e long"), "jaccard-spread")
    often = each.groupBy("e").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("id")
    alone = F.col("size") - F.count("*").over(own)  # shingles that no other set has come first
    place = F.row_number().over(own.orderBy("n", "e")) + alone
    first = each.join(often, "e").select("id", "e", "size", place.alias("place")).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * 4 / 5) + 1)
    first = materialise(first.select("id", "e"), "jaccard-first")
    least = first.groupBy("e").agg(F.min("id").alias("a"))
    label = components(first.join(least, "e").select("a", F.col("id").alias("b")))
    return known.drop("label").join(label, "id")


def _chunked(known: DataFrame) -> DataFrame:
    chunks = known.groupBy("label").agg(F.sum(F.col("size") + SET).alias("weight")).withColumn("chunks", F.ceil(F.col("weight") / CHUNK).cast("int"))
    return known.join(chunks, "label").select("id", "doc", "size", "label", "chunks", "weight", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("own"))


def _verified(docs: DataFrame, meet: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that span what the candidates' links connect. meet: id, label."""
    known = meet.join(classes, "id").select("id", "label", "size", "doc")
    dealt = materialise(_chunked(known), "jaccard-dealt")
    large = dealt.where(F.col("weight") > LARGE)
    if not large.isEmpty():
        refined = _chunked(_refined(docs, large.select("id", "label", "size", "doc")))
        dealt = materialise(dealt.where(F.col("weight") <= LARGE).unionByName(refined), "jaccard-dealt")
    alone = dealt.select("id", "doc", F.col("id").alias("mark"), "label", F.col("own").alias("i"), F.col("own").alias("j"))
    links = materialise(_met(docs, alone), "jaccard-links")
    several = dealt.where("chunks > 1")
    if several.isEmpty():
        return links
    # One set of each group that a chunk found, over the chunks of the component.
    marked = _marked(several, links)
    spoken = marked.groupBy("label", "own", "mark").agg(F.count("*").alias("n"), F.max_by(F.struct("id", "doc", "size"), "size").alias("x")).where("n > 1")
    spoken = _two_by_two(_chunked(spoken.select("label", "mark", "x.*")).join(spoken.select("x.id", "mark"), "id"), within=True)
    links = links.unionByName(materialise(_met(docs, spoken), "jaccard-links"))
    # Chunks two by two, where their sets aren't all of one group yet.
    marked = materialise(_marked(several, links), "jaccard-marked")
    held = marked.groupBy("label", "own").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    whole = held.groupBy("label").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("label")
    pairs = _two_by_two(marked.join(whole, "label", "left_semi"), within=False)
    first, second = (held.select("label", F.col("own").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi")) for c in "ij")
    todo = pairs.select("label", "i", "j").distinct().join(first, ["label", "i"]).join(second, ["label", "j"])
    todo = todo.where("NOT (i_lo = i_hi AND j_lo = j_hi AND i_lo = j_lo)").select("label", "i", "j")
    return links.unionByName(materialise(_met(docs, pairs.join(todo, ["label", "i", "j"], "left_semi")), "jaccard-links"))


def _marked(dealt: DataFrame, links: DataFrame) -> DataFrame:
    """dealt with a mark that sets have in common if links connect them."""
    group = components(links).withColumnRenamed("label", "mark")
    return dealt.join(group, "id", "left").withColumn("mark", F.coalesce("mark", "id"))


def _two_by_two(dealt: DataFrame, within: bool) -> DataFrame:
    """Every set in a row for each other chunk (own of chunks) that its chunk meets;
    one without others meets itself if within."""
    numbers = F.sequence(F.lit(0), F.col("chunks") - 1)
    to = F.filter(numbers, lambda c: (c != F.col("own")) | (F.lit(within) & (F.col("chunks") == 1)))
    spread = dealt.withColumn("to", F.explode(to))
    return spread.select("id", "doc", "mark", "label", F.least("to", "own").alias("i"), F.greatest("to", "own").alias("j"))


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, rid for every row of docs; rid numbers the rows.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a
    document's set are its distinct shingles of 5 words, or the whole sequence if
    there are fewer. Documents link when their sets' Jaccard similarity is 0.8 or
    more; component_id is the smallest doc_id that links lead to.

    docs needs doc_id and text; other columns are ignored. A null text, or one
    without words, has an empty set and stands alone. Rows without a doc_id link
    like others but name no component, unless no row there has an id. Repeated
    rows come as often as they are there. Sets are told apart by 64-bit hashes.
    """
    return _labelled(docs, F.monotonically_increasing_id()).drop("label")


def _labelled(docs: DataFrame, rid: Column) -> DataFrame:
    """linked_documents, with the rows numbered by rid and the label of their
    component, which rows without words don't have."""
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        rid.alias("rid"),
        F.spark_partition_id().alias("src"),
        whole_text().alias("text"),
    )
    mapped = map_arrow(rows, _mapped(SPREAD * parts), _MAPPED)
    found = materialise(map_arrow(mapped.repartition(parts, "bucket").sortWithinPartitions("bucket"), _reduced, _REDUCED), "jaccard-keys")
    entries = found.where(F.col("kind") == _DOC).select("doc_id", "rid", "src", "size", F.col("a").alias("id"))
    full = entries.where("size > 0")
    classes = materialise(
        full.groupBy("id").agg(F.min("size").alias("size"), F.min("doc_id").alias("first"))
        .withColumn("doc", F.coalesce("first", F.lit(_NOBODY))), "jaccard-classes"
    )
    meet = components(_candidates(found, classes))
    member = components(_verified(docs, meet, classes))
    named = classes.join(member, "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    answers = named.join(smallest, "label").select("id", "component_id", "label")
    # An answer for each (class, input partition) first: see exact_dedup.
    local = full.select("id", "src").distinct().join(answers, "id")
    grouped = full.join(local, ["id", "src"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id", "rid", "label")
    alone = entries.where("size = 0").select(
        "doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), "rid", F.lit(None).cast("long").alias("label")
    )
    return grouped.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one with its smallest doc_id; same
    columns. Rows without words, or with a null text, all stay. Of rows that share
    that id the first stays, and so it does in a component without ids. An empty
    table gives an empty one."""
    (rid,) = free_names(docs, "jaccard_rid")
    numbered = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "jaccard-docs")
    decided = materialise(_labelled(numbered, F.col(rid)).select("doc_id", "rid", "label"), "jaccard-decided")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"]
    chosen = decided.where("label IS NOT NULL").groupBy("label").agg(first.alias(rid)).select(rid)
    stay = chosen.unionByName(decided.where("label IS NULL").select(F.col("rid").alias(rid)))
    return numbered.join(stay, rid, "left_semi").select(*docs.columns)
