import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lodestone.llm import mixing, ngram_jaccard, packing
from lodestone.llm.common import materialise
from lodestone.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_language_jaccard import _brute, _set, recognisable


def test_stages(spark, docs, awkward, tmp_path):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    known = recognisable(docs, awkward)
    assert len(known) > 100
    one = corpus_pipeline.identify_language(spark, docs, "")
    assert Counter(r.text for r in one.collect()) == Counter(x[1] for x in known)
    last = {}
    for x in known:
        last[x[1]] = max(last.get(x[1], x), x, key=lambda x: (x[0] is not None, x[0] or 0))
    two = corpus_pipeline.drop_copies(spark, one, "")
    assert {(r.doc_id, r.text) for r in two.collect()} == {(x[0], t) for t, x in last.items()}
    three = corpus_pipeline.drop_near_copies(spark, two, "").collect()
    want = {d for d, n, c in _brute(list(last.values())) if d == c}
    assert {r.doc_id for r in three} == want and len(three) == len(want)


def _order_of_sources(counts, block_rows=16):
    """The sources at each place of the mixture, slot by slot: of the blocks whose
    release has come the one with the earliest deadline, by exact fractions."""
    left = {s: -(-n // block_rows) for s, n in counts.items()}
    rows = dict(counts)
    target = {s: Fraction(n**0.5) for s, n in counts.items()}
    out = []
    while left:
        total = sum(target[s] for s in left)
        weight = {s: target[s] / total for s in left}
        had, t = dict.fromkeys(left, 0), 0
        while all(had[s] < n for s, n in left.items()):
            ready = [s for s in left if (had[s] / weight[s]).__floor__() <= t]
            s = min(ready, key=lambda s: (-((-(had[s] + 1) / weight[s]).__floor__()), -weight[s], s))
            had[s] += 1
            take = min(block_rows, rows[s])
            rows[s] -= take
            out += [s] * take
            t += 1
        left = {s: n - had[s] for s, n in left.items() if n > had[s]}
    return out


def test_run_against_a_plain_version(spark, make, awkward, tmp_path):
    """Rejection, copies, links, the mixture's sources and the packed tokens by loops."""
    from tokenizers import Tokenizer

    rng = random.Random(31)
    base = [" ".join(rng.choices(["der", "the", "and", "une", "la", "casa", "haus", "maison"], k=60)) for _ in range(12)]
    items = list(awkward)
    for k, text in enumerate(base):  # near copies, with ids that others have too, and without
        items += [(3000 + k, text + " a", "en", "near"), (3000 + k, text + " b", "en", "a"), (None, text + " c", "de", None), (3050 + k, text + " a", "en", "b")]
    items += [(3000, "quite another text of its own that no other row is like at all", "en", "near"), (4000, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)), None, "odd"), (4001, "語", None, "odd")]
    make(items).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = recognisable(make(items), items)
    assert {4000, 4001} & {x[0] for x in known} == {4001} and len(known) > 150
    last = {}
    for x in known:
        last[x[1]] = max(last.get(x[1], x), x, key=lambda x: (x[0] is not None, x[0] or 0))
    kept = list(last.values())
    sets = [_set(t) for _, t, _, _ in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    chosen = {}
    for x, g in zip(kept, group, strict=True):
        chosen.setdefault(g, []).append(x)
    options = [[x for x in xs if (x[0] is None, x[0] or 0) == min((y[0] is None, y[0] or 0) for y in xs)] for xs in chosen.values()]
    encode = Tokenizer.from_file(tokenizer_path()).encode
    tokens = lambda t: [*encode(t, add_special_tokens=False).ids, 2]

    def pieces(doc_id, text):
        ids = tokens(text)
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        return [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]

    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole)
    picked = []
    for xs in options:  # of rows that share the smallest id any may stand for its component
        fits = [x for x in xs if not Counter(pieces(x[0], x[1])) - got]
        assert fits, xs
        got -= Counter(pieces(fits[0][0], fits[0][1]))
        picked.append(fits[0])
    assert not got
    sequences = {}
    for r in whole:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(r.length for r in whole)
    bins = []
    for n in sorted((r.length for r in whole), reverse=True):  # best fit, longest first
        k = min((b for b in range(len(bins)) if bins[b] + n <= 1024), key=lambda b: 1024 - bins[b], default=None)
        bins.append(n) if k is None else bins.__setitem__(k, bins[k] + n)
    assert -(-total // 1024) <= len(sequences) <= len(bins)


def test_run_of_an_empty_table_and_of_one_row(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/0/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/0").collect() == []
    make([(1, "the house and the garden", "en", "a")]).write.parquet(f"{tmp_path}/1/documents.parquet")
    assert [(r.doc_id, r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, f"{tmp_path}/1").collect()] == [(1, 0, 0)]


def test_the_mixture_against_slots_one_by_one(make):
    items = [(k, f"t{k}", None, "abcdd"[k % 5]) for k in range(700)]
    rows = mixing.mixed(make(items), position="at").orderBy("at").collect()
    assert [r.source for r in rows] == _order_of_sources(Counter(s for _, _, _, s in items))


@pytest.mark.parametrize("n", range(1, 11))
def test_a_query_for_each_operator(n):
    names = [q for q in __spark_entry__.queries() if q.startswith(f"op{n}_")]
    assert len(names) == 1 and names[0] in QUERIES and "pipeline" in __spark_entry__.queries()


def test_near_copies_leave_one_row_of_each_component(make):
    """Rows without an id, and ids that stand for texts that don't link."""
    lone = [" ".join(f"{x}{k}" for k in range(12)) for x in "abcdef"]
    near = " ".join(f"n{k}" for k in range(60))
    items = [(None, t, None, None) for t in lone[:3]] + [(None, near, None, None), (20, near + " end", None, None)]
    items += [(7, lone[3], None, None), (7, lone[4], None, None), (None, lone[5], None, None), (8, lone[5].upper(), None, None)]
    items += [(None, near.replace("n", "m"), None, None), (None, near.replace("n", "m") + " end", None, None), (None, "", None, None), (None, "", None, None)]
    kept = Counter((r.doc_id, r.text) for r in ngram_jaccard.one_of_each(make(items).repartition(3)).collect())
    pair = [x for x in kept if x[1].startswith("m0")]
    assert len(pair) == 1 and pair[0][0] is None
    want = [(None, t) for t in lone[:3]] + [(20, near + " end"), (7, lone[3]), (7, lone[4]), (8, lone[5].upper()), (None, ""), (None, ""), pair[0]]
    assert kept == Counter(want)


def test_sequences_follow_the_mixture(spark, make):
    items = [(k, f"text {k} of some words", None, "hot" if k % 5 else "a") for k in range(1500)]
    mixed = mixing.mixed(make(items), {"hot": 1.0, "a": 1.0}, block_rows=4, position="at")
    source = {d: s for d, _, _, s in items}
    rows = packing.pack(mixed, tokenizer_path(), capacity=64, order="at", window=64).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(source))
    starts = Counter(r.sequence_id for r in rows)
    assert sorted(starts) == list(range(len(starts)))
    had, n = Counter(), 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        n += 1
        had[source[r.doc_id]] += 1
        if had["a"] < 300:  # until the smaller source ends; a prefix reaches into one window at most
            assert abs(had["hot"] - n / 2) <= 4 + 64 / 2
            if n % 64 == 0:  # whole windows
                assert abs(had["hot"] - n / 2) <= 4


def test_the_last_stage_keeps_the_order_of_the_one_before(spark, make):
    items = [(k, " ".join([f"w{k}"] * (1 + k % 90)), None, "hot" if k % 5 else "a") for k in range(400)]
    mixed = materialise(corpus_pipeline.mix_sources(spark, make(items), ""), "mixed")
    at = {d: k for k, d in enumerate(r.doc_id for r in mixed.orderBy(mixed.columns[-1]).collect())}
    first = {}
    for r in corpus_pipeline.pack_sequences(spark, mixed, "").collect():
        first[r.sequence_id] = min(first.get(r.sequence_id, len(at)), at[r.doc_id])
    assert len(first) > 10 and [first[k] for k in range(len(first))] == sorted(first.values())


def test_rows_without_an_id_have_places_of_their_own(make):
    rows = mixing.mixed(make([(None, f"t{k}", None, "a") for k in range(40)]), position="at").collect()
    assert sorted(r["at"] for r in rows) == list(range(40)) and len({r.text for r in rows}) == 40
