"""Secret scans: known forms, and character Markov models for the rest.

Three forms are found by pattern. Beyond them, what they leave of every long run
of identifier characters is judged by two Markov chains of order 2 over
characters, one trained on random strings and one on ordinary identifiers: the
log-likelihood ratio, per character, must pass a threshold, over the whole part
or else over a long enough segment of it. Both chains are trained from
labelled samples: strings that the patterns found in the corpus and seeded random
strings on one side, ordinary words of the corpus and composed identifiers,
numbers and addresses on the other. What is taken from the corpus is bounded.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, whole_text

# The three known forms. Letters of the key words count in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

#: Rows of the corpus, the lowest by a hash of doc_id, that give labelled samples.
SAMPLE_ROWS = 1000
#: Labelled strings of each kind that are kept of them.
SAMPLE_STRINGS = 4000
#: Characters from which on a run is judged, and the mean log ratio (nats for
#: each character) above which it counts as random.
LEAST, THRESHOLD = 16, 0.8

# Ordinary words that identifiers are made of, whatever the corpus.
WORDS = """
account action active address and api array as author between binary block buffer button byte cache call case change char class client code
color column command comment common config connection console content context control copy count create current customer data date default
delete description detail display document domain download email empty enable end entry event example field file filter find first font for
format found from function general get global group handle hash header identifier image import index int item key label language large last
level line link list local manager map max message method min mode model month move name next node normal note number object open option
order other owner page parent part path position post process product project property public query read record report request result
return select server service session set setting size some sort source start state status step stop stream string system table target test
text the this time title type unit update user value view width window word work world write year zone
""".split()

_SEPARATORS = "+/_=-"
_SYMBOLS = 96  # printable ASCII without space, and one for the start
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_PIECE = re.compile(r"[A-Za-z0-9]{%d,}" % LEAST)
_ASSIGN = re.compile(ASSIGN, re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # leftmost runs of 20 characters and more
_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the known forms."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(b"\x20\x20" + word.encode("ascii"), np.uint8).astype(np.int32) - 32


def train(words: Iterable[str], weight: float = 0.5) -> np.ndarray:
    """log P(c | a b) of the words' characters, with additive smoothing that backs
    off to the characters' own shares."""
    counts = np.zeros((_SYMBOLS,) * 3)
    for word in words:
        c = _codes(word)
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    single = counts.sum(axis=(0, 1)) + weight
    pair = counts.sum(axis=0) + 10 * single / single.sum()
    pair /= pair.sum(axis=1, keepdims=True)
    counts += 10 * pair[None]
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def random_strings(n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", upper + digits, lower + digits, "0123456789abcdef"]
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(LEAST, 64))) for _ in range(n)]


def composed_identifiers(words: list[str], n: int, seed: int = 7) -> list[str]:
    """Names, numbers, dates and paths as code and records have them."""
    rng = random.Random(seed)
    words = [w for w in words if w.isalpha() and len(w) < 16]
    words += WORDS * max(1, len(words) // (4 * len(WORDS)))
    pick = lambda k: rng.choices(words, k=k)
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    makers = [
        lambda: "_".join(pick(rng.randint(2, 5))).lower(),
        lambda: "_".join(pick(rng.randint(2, 5))).upper(),
        lambda: "-".join(pick(rng.randint(2, 5))).lower(),
        lambda: "/".join(pick(rng.randint(2, 6))).lower(),
        lambda: "".join(w.capitalize() for w in pick(rng.randint(2, 5))),
        lambda: "".join(pick(rng.randint(2, 6))).lower(),
        lambda: "".join(pick(rng.randint(2, 6))).upper(),
        lambda: pick(1)[0] + number(rng.randint(1, 6)),
        lambda: number(rng.randint(8, 24)),
        lambda: f"{number(4)}-{number(2)}-{number(2)}T{number(2)}-{number(2)}-{number(2)}",
        lambda: "-".join(number(rng.randint(3, 5)) for _ in range(rng.randint(3, 5))),
        lambda: rng.choice("=-_") * rng.randint(LEAST, 60),
    ]
    return [rng.choice(makers)() for _ in range(n)]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of the patterns, label 1, and the other ASCII words, label 0. A long
    word has no label: it is what the models must judge."""
    for batch in batches:
        strings: dict[tuple[str, int], None] = {}
        for text in batch["text"].to_pylist():
            spans = base_spans(text)
            strings |= {(text[a:end], 1): None for _, _, end, a in spans}
            rest = list(text)
            for start, _, end, _ in spans:
                rest[start:end] = " " * (end - start)
            words = re.findall(r"[A-Za-z0-9+/_=-]{3,}", "".join(rest))
            strings |= {(w, 0): None for w in words if len(w) < LEAST}
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in strings], pa.string()), pa.array([k for _, k in strings], pa.int32())], ["string", "label"]
        )


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_strings: int = SAMPLE_STRINGS) -> np.ndarray:
    """The log ratio log P(random) - log P(ordinary) of each character after two
    others, as a cube of float32. sample_rows and sample_strings bound what of the
    corpus is labelled: rows, and strings of each label."""
    marked = docs.select("text", F.xxhash64("doc_id").alias("h"), F.monotonically_increasing_id().alias("rid"))
    chosen = marked.select("h", "rid").orderBy("h", "rid").limit(sample_rows).select("rid")  # short rows only
    rows = marked.join(F.broadcast(chosen), "rid", "left_semi").select("text")
    strings = map_arrow(rows, _labelled, "string string, label int").distinct()
    found: dict[int, list[str]] = {}
    for label in (0, 1):
        own = strings.where(F.col("label") == label).orderBy(F.xxhash64("string"), "string").limit(sample_strings)
        found[label] = [r["string"] for r in own.collect()]
    secret = found[1] + random_strings(max(0, 2 * sample_strings - len(found[1])))
    ordinary = found[0] + composed_identifiers(found[0], 2 * sample_strings)
    return (train(secret) - train(ordinary)).astype(np.float32)


def covers(base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The known forms, which may overlap, as spans that don't, in order."""
    out: list[tuple[int, int]] = []
    for start, _, end, _ in base:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _uncovered(text: str, start: int, end: int, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The long parts of a run between the known forms, without the separators
    that stand next to those."""
    at = start
    first = bisect.bisect_right(covered, start, key=lambda x: x[1])
    last = bisect.bisect_left(covered, end, lo=first, key=lambda x: x[0])
    for s, e in [*covered[first:last], (end, end)]:
        lo, hi = at, min(s, end)
        while lo > start and lo < hi and text[lo] in _SEPARATORS:
            lo += 1
        while hi < end and lo < hi and text[hi - 1] in _SEPARATORS:
            hi -= 1
        if hi - lo >= LEAST:
            yield lo, hi
        at = max(at, e)


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """The segments of at least LEAST characters whose scores add up to the most
    beyond THRESHOLD for each, one after the other; they don't overlap."""
    found, todo = [], [(0, len(scores))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        total = np.concatenate([[0.0], np.cumsum(scores[lo:hi] - THRESHOLD)])
        end = int((total - np.minimum.accumulate(total)).argmax())
        start = int(total[: end + 1].argmin())
        if start == end:
            continue
        if end - start >= LEAST:
            found.append((lo + start, lo + end))
        todo += [(lo, lo + start), (lo + end, hi)]
    return found


def _mean(word: str, ratio: np.ndarray) -> float:
    c = _codes(word)
    return ratio[c[:-2], c[1:-1], c[2:]].mean()


def _snapped(run: str, start: int, end: int) -> tuple[int, int]:
    """A segment whose ends go to the separator or the run's end that is less than
    three characters away."""
    for k in (0, 1, 2, -1, -2, -3):
        if start - k == 0 or (0 < start - k and run[start - k - 1] in _SEPARATORS and run[start - k] not in _SEPARATORS):
            start -= k
            break
    for k in (0, 1, 2, -1, -2, -3):
        if end + k == len(run) or (end + k < len(run) and run[end + k] in _SEPARATORS and run[end + k - 1] not in _SEPARATORS):
            end += k
            break
    return start, end


def random_parts(run: str, ratio: np.ndarray) -> list[tuple[int, int]]:
    """The run if it counts as random as a whole; or else what does so between two
    separators, and segments, which join what they overlap."""
    c = _codes(run)
    scores = ratio[c[:-2], c[1:-1], c[2:]]
    if scores.mean() > THRESHOLD:
        return [(0, len(run))]
    found = [_snapped(run, i, j) for i, j in segments(scores)]
    found += [m.span() for m in _PIECE.finditer(run) if _mean(m.group(), ratio) > THRESHOLD]
    out: list[tuple[int, int]] = []
    for i, j in sorted(found):
        if out and i < out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def spans(text: str, ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, by start and kind."""
    base = base_spans(text)
    out = [(start, kind, end) for start, kind, end, _ in base]
    covered = covers(base)
    for m in _RUN.finditer(text):
        for start, end in _uncovered(text, *m.span(), covered):
            out += [(start + i, 3, start + j) for i, j in random_parts(text[start:end], ratio)]
    return sorted(out)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def _scan(ratio: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t.as_py(), ratio) for t in batch["text"]]
            kinds = [[k for _, k, _ in f] for f in found]
            base = [_joined([x for x in f if x[1] < 3]) for f in found]
            columns = [
                batch["doc_id"],
                *(pa.array([ks.count(k) for ks in kinds], pa.int64()) for k in range(4)),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                pa.array([_joined(f) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows


def scan(docs: DataFrame, ratio: np.ndarray | None = None, sample_rows: int = SAMPLE_ROWS, sample_strings: int = SAMPLE_STRINGS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for every
    row of docs; spans count code points, their ends are exclusive. A span of the
    Markov models never overlaps one of the known forms, and runs of fewer than LEAST
    characters are not judged: they say too little. A long text is scanned whole.

    docs needs doc_id and text; other columns are ignored. A null or empty text
    has no spans. Repeated rows come as often as they are there. On an empty
    table the models rest on the made samples alone.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_arrow(texts, _scan(fit(texts, sample_rows, sample_strings) if ratio is None else ratio), f"doc_id long, {counts}, base_sha256 string, spans string")
