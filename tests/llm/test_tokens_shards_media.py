import bisect
import hashlib
import json
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm import media, mixing, ogg, sharding, token_counts
from lodestone.llm.queries import tokenizer_path


def _best(word, scores, least):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            s = scores.get(word[start:end])
            if s is not None:
                options.append((best[start][0] + s, -best[start][1] - 1))
        if scores.get(word[end - 1]) is None:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * least, -best[end - 1][1] - n))
        s, n = max(options)
        best[end] = (s, -n)
    return best[-1][1]


def test_counts_match_plain_programming():
    rng = random.Random(4)
    pieces = {"".join(rng.choices("ab▁c", k=rng.randint(1, 4))): -rng.randint(1, 9) / 2 for _ in range(30)}
    counter = token_counts.Counter(pieces)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    for text, (pre, n) in zip(texts, counter(texts), strict=True):
        words = text.split(" ") if text else []
        assert pre == len(words) and n == sum(_best("▁" + w, pieces, counter.least) for w in words)


def test_shared_prefixes_are_computed_once():
    counter = token_counts.Counter({"a": -1.0, "b": -1.0})
    counter(["aaaa aaab aab", "aaaa"])
    assert counter.nodes == len({p for w in ("▁aaaa", "▁aaab", "▁aab") for p in (w[:k] for k in range(1, len(w) + 1))})


def test_counts_match_the_library(docs, awkward):
    from tokenizers import Tokenizer, models

    counter = token_counts.Counter.load(tokenizer_path("piece_bpe_32k.model"))
    check = Tokenizer(models.Unigram([("<unk>", 0.0), *counter.scores.items()], 0, False))
    rows = token_counts.token_counts(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(awkward)
    known = set("".join(counter.scores))
    want = Counter((d, sum(len(check.encode("▁" + w).ids) for w in t.split(" "))) for d, t, _, _ in awkward if t and set(t.replace(" ", "")) <= known)
    assert want and not want - Counter((r.doc_id, r.n_tokens) for r in rows)


def test_counts_of_nothing(empty):
    assert token_counts.token_counts(empty, tokenizer_path("piece_bpe_32k.model")).collect() == []


def test_shards(docs, awkward, empty):
    rows = sharding.shard(docs, shards=16).collect()
    assert len(rows) == len(awkward) and {r.law for r in rows} == {"rows"}
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in awkward)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want and all(r.grown_shard is None for r in rows)
    assert sharding.shard(empty).collect() == []


def test_one_key_for_all_rows_still_balances(make):
    rows = sharding.shard(make([(5, f"t{k}", None, None) for k in range(50)]), shards=4).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [12, 12, 13, 13]


def test_one_more_shard_moves_little():
    rng = random.Random(1)
    keys = [rng.randrange(sharding.CELLS) for _ in range(20000)]

    def place(shards):
        nodes = sharding.ring(shards, 128)
        arcs = defaultdict(list)
        for k, cell in enumerate(keys):
            arcs[next((i for i, (p, _) in enumerate(nodes) if p >= cell), 0)].append(k)
        plan = sharding.walk(nodes, {a: len(ks) for a, ks in arcs.items()}, [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)])
        return {arcs[arc][r]: shard for arc, first, n, shard, _ in plan for r in range(first, first + n)}

    a, b = place(8), place(9)
    assert sum(a[k] != b[k] for k in a) < 0.5 * len(keys)  # dealing anew would move 8 of 9


def test_shards_against_a_walk_of_single_keys(make):
    """Every key walks by itself: it asks the node at its arc's end, and node after node
    clockwise as long as the shard there is full. How many of an arc's keys end up
    where must agree; which of them do is settled by row."""
    import xxhash

    rng = random.Random(2)
    ids = [rng.randrange(10**6) for _ in range(700)] + [17] * 300
    nodes = sharding.ring(5, 16)
    arcs = [bisect.bisect_left([p for p, _ in nodes], struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", d), 42)))[0] % sharding.CELLS) % len(nodes) for d in ids]
    room = [200] * 5
    got = Counter()
    queues = {a: [a] * n for a, n in Counter(arcs).items()}
    while queues:
        beyond = defaultdict(list)
        for at in sorted(queues):
            for arc in queues[at]:
                shard = nodes[at][1]
                if room[shard]:
                    room[shard] -= 1
                    got[arc, shard] += 1
                else:
                    beyond[at].append(arc)
        queues = defaultdict(list)
        for at, keys in beyond.items():
            while not room[nodes[at][1]]:
                at = (at + 1) % len(nodes)
            queues[at] += keys
    of = dict(zip(ids, arcs, strict=True))
    rows = sharding.shard(make([(d, f"t{k}", None, None) for k, d in enumerate(ids)]).repartition(3), shards=5, virtual_nodes=16).collect()
    assert Counter((of[r.doc_id], r.shard) for r in rows) == got and set(Counter(r.shard for r in rows).values()) == {200}


def _plain_crc(data):
    r = 0
    for byte in data:
        r ^= byte << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else r << 1
    return r


def test_checksum():
    for data in (b"", b"a", bytes(range(256)), b"OggS" * 20):
        assert ogg.checksum(data) == _plain_crc(data)


def test_packets_over_pages_and_streams():
    writer, sizes = ogg.Writer(), [0, 1, 254, 255, 256, 510, 65025, 65026, 200000, 3]
    for k, n in enumerate(sizes):
        writer.packet(7 + k % 2, bytes([k]) * n, k)
    found = ogg.read(writer.close())
    assert found.bad == 0 and all(s.ended for s in found.streams.values())
    for k, n in enumerate(sizes):
        assert found.streams[7 + k % 2].packets[k // 2] == bytes([k]) * n


def _plain_read(stored):
    """A second reader: pages by their fields, packets by their lacing values, one byte at a time."""
    streams, at = defaultdict(lambda: {"packets": [], "open": b"", "page": []}), 0
    while at < len(stored):
        assert stored[at : at + 4] == b"OggS" and stored[at + 4] == 0
        granule = int.from_bytes(stored[at + 6 : at + 14], "little", signed=True)
        s = streams[int.from_bytes(stored[at + 14 : at + 18], "little")]
        assert int.from_bytes(stored[at + 18 : at + 22], "little") == len(s["page"])
        count = stored[at + 26]
        table, body = stored[at + 27 : at + 27 + count], at + 27 + count
        end = body + sum(table)
        page = bytearray(stored[at:end])
        page[22:26] = bytes(4)
        assert _plain_crc(page) == int.from_bytes(stored[at + 22 : at + 26], "little")
        done = 0
        for value in table:
            s["open"] += stored[body : body + value]
            body += value
            if value < 255:
                s["packets"].append(s["open"])
                s["open"], done = b"", done + 1
        s["page"].append((granule, done))
        at = end
    return streams


@pytest.mark.parametrize("n", [1, 5000, 300_000])
def test_a_second_reader_agrees(n):
    samples = media.payload(random.Random(n).randbytes(n))
    stored = media.store(samples)
    back, facts = media.load(stored)
    found = list(_plain_read(stored).values())
    bodies = [s["packets"][1:] for s in found]
    assert b"".join(bodies[k % 2][k // 2] for k in range(sum(map(len, bodies)))) == samples == back
    ends = ogg.read(stored, media._span).streams
    for s, (_, stream) in zip(found, ends.items(), strict=True):
        total, packets, want = 0, iter(s["packets"]), []
        for granule, done in s["page"]:
            for _ in range(done):
                p = next(packets)
                total += 0 if not want else len(p)
                want.append(total)
            assert granule == (total if done else -1)
        assert stream.ends == want
    assert facts["seconds"] == round(len(samples) / media.RATE, 6) and sum(facts["ends"]) == pytest.approx(facts["seconds"], abs=1e-5)


def test_a_granule_off_the_time_line_is_found():
    writer = ogg.Writer()
    for channel, serial in enumerate(media._SERIALS):
        writer.packet(serial, media._HEAD.pack(b"samples8", media.RATE, channel, 128), 0, flush=True)
    writer.packet(media._SERIALS[0], bytes(64), 64)
    writer.packet(media._SERIALS[1], bytes(64), 65)
    with pytest.raises(ValueError, match="time line"):
        media.load(writer.close())


@pytest.mark.parametrize("n", [0, 1, 64, 4096, 4097, 70000])
def test_round_trip_and_damage(n):
    samples = media.payload(random.Random(n).randbytes(n))
    stored = media.store(samples)
    assert media.load(stored)[0] == samples
    for at in (30, len(stored) // 2, len(stored) - 1):
        damaged = bytearray(stored)
        damaged[at] ^= 16
        with pytest.raises(ValueError):
            media.load(bytes(damaged))


def test_media_column(docs, awkward, empty):
    rows = media.media_column(docs).collect()
    want = Counter()
    for d, t, _, _ in awkward:
        p = media.payload((t or "").encode())
        want[(d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert all(json.loads(r.feature)["seconds"] == round(r.payload_bytes / media.RATE, 6) for r in rows)
    assert media.media_column(empty).collect() == []


def test_period_keeps_every_window():
    units = mixing.units({"a": 5, "b": 3, "c": 0.001, "d": 1}, 64)
    slots = mixing.period_slots(units, 64)
    assert sum(map(len, slots.values())) == 64 == sum(units.values())
    for s, u in units.items():
        for k, t in enumerate(slots[s]):
            assert k * 64 // u <= t < -(-(k + 1) * 64 // u)


def test_mixture_stays_within_a_block(docs, awkward, empty):
    rows = mixing.mix(docs, {"hot": 3.0, "a": 1.0}, block_rows=2).collect()
    assert len(rows) == len(awkward) and len({r.position for r in rows}) == len(rows)
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((d, s) for d, _, _, s in awkward)
    for r in rows:
        assert r.release <= r.slot < r.deadline
    for phase in {r.phase for r in rows}:
        own = [r for r in rows if r.phase == phase]
        first, last = min(r.slot for r in own), max(r.slot for r in own)
        for source in {r.source for r in own}:
            slots, weight = {r.slot for r in own if r.source == source}, next(r.weight for r in own if r.source == source)
            for t in range(first, last + 2):
                assert abs(sum(s < t for s in slots) - weight * (t - first)) < 1 + 1e-9
    assert mixing.mix(empty).collect() == []


def test_mixed_returns_the_documents(docs, awkward):
    out = mixing.mixed(docs, block_rows=2)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((d, t) for d, t, _, _ in awkward)


def test_mixture_keeps_to_the_targets_themselves(make):
    """Over many times 1024 slots, with targets that no 1024th meets, a rare one and one of 0."""
    targets = {f"s{k}": 1.0 for k in range(20)} | {"rare": 0.002, "last": 0.0}
    items = [(k, None, None, s) for s in targets for k in range(3 if s in ("rare", "last") else 1000)]
    rows = mixing.mix(make(items), targets, block_rows=1).collect()
    assert sorted((r.doc_id, r.source) for r in rows) == sorted((d, s) for d, _, _, s in items)
    order = [r.source for r in sorted(rows, key=lambda r: r.position)]
    assert order[-3:] == ["last"] * 3
    total, had, end = sum(targets.values()), Counter(), sum(r.phase == 0 for r in rows)
    assert end > 19_000
    for t, source in enumerate(order[:end], 1):
        had[source] += 1
        if t % 50 == 0 or t == end:
            assert all(abs(had[s] - w / total * t) < 1 + 1e-6 for s, w in targets.items())


def test_mixture_of_bad_targets(make):
    with pytest.raises(ValueError):
        mixing.mix(make([(1, None, None, "a")]), {"a": -1.0})


def test_slots_are_the_same_from_every_state():
    blocks, weights = {"a": 700, "b": 300, "c": 41}, {"a": 3.0, "b": 2**0.5, "c": 0.1}
    whole = [x[:2] for x in mixing.schedule(blocks, weights, step=10**9)]
    assert [p for p, _ in whole] == [0, 1, 2]
    found = {}
    for step in (10**9, 7):
        found[step] = []
        for x in mixing.schedule(blocks, weights, step=step):
            for t, s, j in mixing.turns(x.units, mixing.PERIOD, x.had, x.lo):
                if t >= x.hi:
                    break
                found[step].append((x.start + t, s, x.first[s] + j))
    assert found[7] == found[10**9] and [t for t, _, _ in found[7]] == list(range(1041))
    assert Counter(s for _, s, _ in found[7]) == blocks
