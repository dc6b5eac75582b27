import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import jaccard_segments as J
from lodestone.llm import components as components_module
from lodestone.llm import language_id, ngram_jaccard
from lodestone.llm.components import components


def _sample(lang, rng):
    syllables = {"en": ["the", "ing", "and", "tion"], "de": ["sch", "ung", "der", "keit"], "fr": ["eau", "oi", "les", "que"], "es": ["ción", "ado", "los", "ñar"]}
    return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 30)))


@pytest.fixture(scope="module")
def labelled(make):
    rng = random.Random(6)
    return make([(k, _sample(lang, rng), lang, None) for k in range(600) for lang in [rng.choice(["en", "de", "fr", "es"])]])


def recognisable(docs, items):
    """The items with a letter that decoding doesn't reject, by the rule itself: long, and
    even the codeword that loses least loses for every bit."""
    model = language_id.train(docs)

    def rejected(text):
        f = _plain_trigrams(text)
        margins = sum(model.weights[x].astype(float) for x in f) / len(f)
        loss = min(sum(q * np.logaddexp(0, -c * m) for q, c, m in zip(model.trust, word, margins, strict=True)) for word in model.code)
        return len(f) >= language_id.LONG and loss / sum(model.trust) > language_id.MISFIT

    return [x for x in items if x[1] and any(c.isalpha() for c in x[1]) and not rejected(x[1])]


def test_codewords_differ_in_half_of_the_bits():
    for k in (2, 3, 4, 7, 12):
        code = language_id.codewords([str(i) for i in range(k)])
        least = min(np.sum(code[i] != code[j]) for i in range(k) for j in range(i))
        assert len(np.unique(code, axis=0)) == k and least >= (code.shape[1] // 4 if k > 7 else 2 ** (k - 2))


def test_held_out_accuracy(labelled):
    truth = {r.doc_id: r.lang for r in labelled.collect()}
    rows = language_id.identify(labelled).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def _plain_trigrams(text):
    raw = f" {text.lower()} ".encode()
    return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % 2**32) >> 18 for i in range(len(raw) - 2)]


def test_against_plain_classifiers(make, awkward):
    """Counts, log odds of each bit, and losses by loops over dictionaries."""
    rng = random.Random(16)
    items = [(k, _sample(lang, rng), lang, None) for k in range(120) for lang in [rng.choice(["en", "de", "fr"])]] + awkward
    counts = {}
    for d, t, lang, _ in items:
        if lang and zlib.crc32(b"" if d is None else str(d).encode()) % 5:
            counts.setdefault(lang, Counter()).update(_plain_trigrams(t or ""))
    names = sorted(counts)
    code = [[1 if not (k and (bits >> (k - 1)) & 1) else -1 for k in range(len(names))] for bits in range(1, 2 ** (len(names) - 1))]
    sums = {x: sum(counts[x].values()) for x in names}
    more = 0.5 * len(sums) / sum(sums.values())
    share = {x: (lambda c, n: lambda f: (c[f] / n + more) / (1 + more * language_id.FEATURES))(counts[x], sums[x]) for x in names}

    def odds(bit, f):
        up = [share[x](f) for k, x in enumerate(names) if bit[k] > 0]
        down = [share[x](f) for k, x in enumerate(names) if bit[k] < 0]
        return np.log(sum(up) / len(up)) - np.log(sum(down) / len(down))

    trust = []
    table = [[odds(bit, f) for f in range(language_id.FEATURES)] for bit in code]
    for bit, w in zip(code, table, strict=True):
        trust.append(max(1e-6, min(bit[k] * sum(w[f] * share[x](f) for f in range(language_id.FEATURES)) for k, x in enumerate(names))))
    mean = sum(trust) / len(trust)
    rows = {(r.doc_id, r.lang_pred, round(r.score, 3)) for r in language_id.identify(make(items).repartition(3)).collect()}
    for d, t, _, _ in items:
        if not t or not any(c.isalpha() for c in t):
            assert (d, "und", 0.0) in rows
            continue
        f = _plain_trigrams(t)
        margins = [sum(w[x] for x in f) * min(1, language_id.EVIDENCE / len(f)) for w in table]
        loss = [sum(q / mean * np.logaddexp(0, -bit[k] * m) for q, bit, m in zip(trust, code, margins, strict=True)) for k in range(len(names))]
        first, second = sorted(loss)[:2]
        score = np.tanh((second - first) / 2)
        assert any(x == d and p == names[loss.index(first)] and abs(s - score) < 0.01 for x, p, s in rows), (d, t[:40])


def test_decoding_rejects_what_fits_no_codeword(make):
    """Long random letters and a script that no row has go, short ones stay; so do
    clean texts, and a wanted language alone where that is asked."""
    rng = random.Random(15)
    clean = [(k, " ".join(_sample(lang, rng) for _ in range(4)), lang, None) for k in range(300) for lang in [rng.choice(["en", "de", "fr", "es"])]]
    odd = [(2000, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)), None, None), (2001, "語言", None, None), (2002, "".join(rng.choices("абвгджзклмнпрстуфхцчшщюя ", k=900)), None, None)]
    docs = make(clean + odd).repartition(3)
    assert {r.doc_id for r in language_id.recognised(docs).collect()} == {d for d, _, _, _ in clean} | {2001}
    assert {r.doc_id for r in language_id.identify(docs).where("rejected").collect()} == {2000, 2002}
    model = language_id.train(docs)
    wanted = {d for d, t, _, _ in clean + odd if language_id.predict(model, t)[0] in ("de", "fr") and d not in (2000, 2002)}
    assert {r.doc_id for r in language_id.recognised(docs, ("de", "fr")).collect()} == wanted


def test_a_wrong_bit_is_corrected():
    model = language_id.fit({x: np.bincount(language_id.features(_sample(x, random.Random(1))), minlength=language_id.FEATURES) for x in ("de", "en", "es", "fr")})
    for k in range(4):
        for bit in range(model.code.shape[1]):
            margins = 4 * model.code[k]
            margins[bit] = -margins[bit] / 4
            assert language_id.decode(model, margins)[0] == k


def test_awkward_texts(docs, awkward, empty):
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(awkward)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (2, 3, 7, 10)) and by_id[1].lang_pred != "und"
    kept = language_id.recognised(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for _, t, _, _ in recognisable(docs, awkward))
    assert language_id.identify(empty).collect() == []


def _set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _brute(items):
    sets = [_set(t) for _, t, _, _ in items]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for k, (d, _, _, _) in enumerate(items):
        if d is not None:
            ids[find(k)] = min(ids.get(find(k), d), d)
    return Counter((d, len(sets[k]), ids.get(find(k)) if sets[k] else d) for k, (d, _, _, _) in enumerate(items))


def _near(rng, n, words, edits):
    base = rng.choices([f"w{k}" for k in range(500)], k=words)
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(9999)}"]
        out.append(" ".join(copy))
    return out


def _compare(make, items):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.linked_documents(make(items).repartition(3)).collect())
    assert got == _brute(items)


def test_links_of_awkward_rows(make, awkward, empty):
    _compare(make, awkward)
    assert ngram_jaccard.linked_documents(empty).collect() == []


def test_links_of_near_copies_and_shared_passages(make):
    """A large group of near copies (every key hot), small groups, and a passage in many documents."""
    rng = random.Random(8)
    texts = _near(rng, 60, 120, 6) + [t for _ in range(15) for t in _near(rng, 4, rng.randint(5, 200), 4)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [" ".join(rng.choices([f"w{k}" for k in range(500)], k=rng.randint(1, 80))) + " " + passage for _ in range(60)]
    texts += _near(rng, 30, 8, 1) + ["a b", "a b", "A B", "a", ""]
    _compare(make, [(1000 - k, t, None, None) for k, t in enumerate(texts)])


@pytest.mark.parametrize("large", [300, 1 << 40])
def test_chunks_of_a_component_meet(make, monkeypatch, large):
    """Components in many chunks: groups that the chunks' sets make and that only
    pairs of chunks do, sets that don't link with a passage in common."""
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 900)
    monkeypatch.setattr(ngram_jaccard, "LARGE", large)
    rng = random.Random(12)
    texts = _near(rng, 60, 60, 3) + _near(rng, 40, 40, 5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(rng.choices([f"w{k}" for k in range(90)], k=rng.randint(6, 24))) for _ in range(50)]
    _compare(make, [(k, t, None, None) for k, t in enumerate(texts)])


def test_repeated_ids_and_texts_without_an_id(make):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    _compare(make, [(None, a, None, None)] * 9 + [(None, a + " x", None, None), (3, b, None, None), (3, b, None, None), (3, b + " y", None, None), (3, "", None, None)])


def test_a_bucket_passes_on_what_many_share():
    rng = np.random.default_rng(4)
    keys = np.r_[np.full(900, 8, np.uint64), rng.integers(0, 200, 600).astype(np.uint64) * 2 + 100, np.full(5, 7, np.uint64)]
    classes = rng.integers(-300, 300, len(keys))
    whole = ngram_jaccard.shared_in(keys, classes)
    bucket, passed = ngram_jaccard.Bucket(), []
    bucket.bound = 150
    for at in range(0, len(keys), 70):
        passed.append(bucket.add(keys[at : at + 70], classes[at : at + 70]))
        bucket.bound = min(bucket.bound, 400)
    a, b, n, key, member = bucket.end()
    assert bucket.held < 700 and 8 in bucket.hot
    many = {*zip(*(x.tolist() for x in whole[3:]), strict=True)}
    got = {*zip(key.tolist(), member.tolist(), strict=True)} | {x for k, m in passed for x in zip(k.tolist(), m.tolist(), strict=True)}
    assert got == many
    assert {*zip(a.tolist(), b.tolist(), n.tolist(), strict=True)} == {*zip(*(x.tolist() for x in whole[:3]), strict=True)}


def test_least_shared_is_the_least(spark):
    """Against all sizes that a linked set can have."""
    from pyspark.sql import functions as F

    allot = J.allotment
    got = {r.id: r.n for r in spark.range(1, 1500).select("id", ngram_jaccard.least_shared(F.col("id")).alias("n")).collect()}
    for s, n in got.items():
        true = min(min(allot(s), allot(y)) - (s + y) // 9 for y in range(-(-s * 4 // 5), s * 5 // 4 + 1))
        assert true - 1 <= n <= true


def test_one_of_each(make):
    rng = random.Random(9)
    items = [(k, t, "en", "s") for k, t in enumerate([t for _ in range(8) for t in _near(rng, 4, 60, 2)] + ["", None, "  "])]
    kept = ngram_jaccard.one_of_each(make(items)).collect()
    want = {c for d, _, c in _brute(items) if c == d}
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)


@given(st.integers(1, 120), st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**32))
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_a_key(common, left, right, seed):
    """The pigeonhole: whatever the hashes, linked sets have a key in common, and
    enough plain ones if both have them all."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**64, common + left + right, np.uint64))
    if seed % 3 == 0:  # elements that fall together in few segments
        pool = np.unique(pool >> np.uint64(seed % 7))
    rng.shuffle(pool)
    a, b = np.sort(pool[: common + left]), np.sort(np.r_[pool[:common], pool[common + left :]])
    both, size = len(np.intersect1d(a, b)), len(a) + len(b)
    if len(a) and len(b) and 100 * both >= 80 * (size - both):
        shared = np.intersect1d(J.allocation(a), J.allocation(b))
        assert len(shared) and ((shared & np.uint64(1)).any() or len(shared) >= min(J.allotment(len(a)), J.allotment(len(b))) - size // 9)


def test_spanning_links_connect_what_all_links_do():
    rng = random.Random(10)
    for _ in range(20):
        sets = [np.unique(J.shingles(t)) for t in _near(rng, 25, 40, 4)]
        links = [(i, j) for i in range(25) for j in range(i) if J.linked(np.array([len(np.intersect1d(sets[i], sets[j]))]), len(sets[i]), np.array([len(sets[j])]))[0]]

        def label(edges):
            at = list(range(25))
            for _ in range(25):
                for i, j in edges:
                    at[i] = at[j] = min(at[i], at[j])
            return at

        assert label(J.spanning_links(sets)) == label(links)


@pytest.mark.parametrize("bound", [components_module.ONE_TASK, 0])
def test_components(spark, monkeypatch, bound):
    """In one task, and in rounds."""
    monkeypatch.setattr(components_module, "ONE_TASK", bound)
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    rng = random.Random(bound)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(300, k) for k in range(300, 360)]
    at = list(range(400))
    for _ in range(400):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    want = {v: at[v] for e in edges for v in e if e[0] != e[1]}
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
