"""Language identification by error-correcting output codes.

Each language has a codeword; with k languages the code is exhaustive, with
2**(k-1) - 1 bits, up to BITS bits, beyond which a seeded choice of splits is
taken. A binary classifier over hashed byte n-grams predicts each bit of a
text's codeword. Decoding weighs each bit by how well its classifier did on the
training rows and chooses the codeword with the least weighted logistic loss;
the margin to the second gives the score, and a small one flags ambiguity.

The classifiers are naive Bayes models. They need no more than how often each
feature occurs in each language, so training is one aggregation over all
training rows, of a result as large as languages * FEATURES.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, whole_text

#: Hash buckets of byte trigrams.
FEATURES = 1 << 14
#: Bits of a codeword at most.
BITS = 63
#: Features up to which a text's evidence counts in full: n-grams of a longer
#: text aren't independent, and its margin grows no further.
EVIDENCE = 200.0
#: Score below which a prediction counts as ambiguous.
AMBIGUOUS = 0.05
#: Features from which on a text can be rejected, and the loss for each feature and
#: bit, of the codeword that loses least, above which it is: its bits are undecided,
#: so it fits no codeword, however long it is. A bit without any evidence loses
#: log 2 = 0.69; a text half in one language and half in another some 0.4. The largest
#: of 50,057 long test documents is 0.52, in three languages.
LONG, MISFIT = 100, 0.6

_NONE = "und"


def features(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, with a space around it."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - 14)


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(languages: list[str]) -> np.ndarray:
    """A row of +1 and -1 for each language; the first row is all +1."""
    k = len(languages)
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
    else:
        rng, seen = random.Random(11), {}
        while len(seen) < BITS:
            c = tuple(rng.choice((1, -1)) for _ in range(k - 1))
            if -1 in c:
                seen[c] = None
        columns = list(seen)
    return np.array([(1, *c) for c in columns], float).T


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages * bits
    weights: np.ndarray  # FEATURES * bits: log odds of a bit being +1
    trust: np.ndarray  # of each bit


def held_out() -> Column:
    """Rows that training leaves out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            found = np.bincount(features(text.as_py()), minlength=FEATURES)
            total[lang] = total[lang] + found if lang in total else found
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.array([c.astype("<i8").tobytes() for c in total.values()], pa.binary())],
        ["lang", "counts"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch["lang"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            found = np.frombuffer(raw, "<i8")
            total[lang] = total[lang] + found if lang in total else found
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["lang", "counts"]
    )


def train(docs: DataFrame) -> Model:
    """A model from all rows that aren't held out and have a language."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select("lang", whole_text().alias("text"))
    schema = "lang string, counts binary"
    # One row for each language and task, added up in a tree of two levels.
    parts = map_arrow(rows, _counts, schema).withColumn("part", F.spark_partition_id() % 16)
    parts = map_arrow(parts.repartition(16, "part").drop("part"), _merge, schema)
    total: dict[str, np.ndarray] = {}
    for r in parts.collect():  # 16 rows for each language at most
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], "<i8")
    return fit({k: total[k] for k in sorted(total)})


def fit(total: dict[str, np.ndarray]) -> Model:
    languages = list(total)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((FEATURES, 1)), np.ones(1))
    code = codewords(languages)
    # languages * FEATURES. Every language counts alike, and a feature that none has
    # speaks for none: what is added to the shares is the same for all of them.
    sums = np.array([max(int(c.sum()), 1) for c in total.values()], float)
    share = np.array([c / n for c, n in zip(total.values(), sums, strict=True)]) + 0.5 / sums.mean()
    share /= share.sum(axis=1, keepdims=True)
    plus = (code > 0).T.astype(float)
    minus = 1 - plus
    up = plus @ share / np.maximum(plus.sum(axis=1, keepdims=True), 1)
    down = minus @ share / np.maximum(minus.sum(axis=1, keepdims=True), 1)
    weights = np.where(minus.sum(axis=1, keepdims=True) > 0, np.log(np.maximum(up, 1e-12)) - np.log(np.maximum(down, 1e-12)), 1.0)
    # A classifier's trust: the mean signed log odds of an n-gram over languages,
    # at its weakest language, against the mean of all classifiers.
    signed = (weights @ share.T) * code.T
    trust = np.maximum(signed.min(axis=1), 1e-6)
    return Model(languages, code, np.ascontiguousarray(weights.T.astype(np.float32)), trust / trust.mean())


def _losses(model: Model, margins: np.ndarray) -> np.ndarray:
    """What each codeword loses, for the log odds of each bit."""
    return (model.trust * np.logaddexp(0, -model.code * margins)).sum(axis=1)


def decode(model: Model, margins: np.ndarray) -> tuple[int, float]:
    """(language, score) for the log odds of each bit."""
    loss = _losses(model, margins)
    order = np.argsort(loss, kind="stable")
    if len(order) == 1:
        return 0, 1.0
    return int(order[0]), float(np.tanh((loss[order[1]] - loss[order[0]]) / 2))


def misfit(model: Model, margins: np.ndarray) -> float:
    """What the best codeword loses for each bit, for the log odds of one feature; 0
    with a single language, which has no bits to decide."""
    return float(_losses(model, margins).min() / model.trust.sum()) if len(model.languages) > 1 else 0.0


def judge(model: Model, text: str) -> tuple[str, float, bool]:
    """(language, score, rejected)."""
    if not model.languages or not letters(text):
        return _NONE, 0.0, True
    f = features(text)
    margins = model.weights[f].sum(axis=0, dtype=np.float64)
    k, score = decode(model, margins * min(1.0, EVIDENCE / len(f)))
    return model.languages[k], score, len(f) >= LONG and misfit(model, margins / len(f)) > MISFIT


def predict(model: Model, text: str) -> tuple[str, float]:
    return judge(model, text)[:2]


def _predictions(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(model, t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["held_out"],
                    pa.array([x for x, _, _ in found], pa.string()),
                    pa.array([s for _, s, _ in found], pa.float64()),
                    pa.array([x != _NONE and s < AMBIGUOUS for x, s, _ in found], pa.bool_()),
                    pa.array([r for _, _, r in found], pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "rejected"],
            )

    return rows


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, rejected for every row of docs.

    docs needs doc_id, text and, to train on, lang; other columns are ignored.
    A text that is null or has no letter is `und` with score 0, and so is every
    text where there is no row to train on; these are rejected, and so is a text of
    LONG features or more that fits no codeword. With a single
    language, that one is predicted with score 1. Equal losses go to the language
    first by name. Repeated rows come as often as they are there; an empty table
    gives an empty result.
    """
    model = train(docs) if model is None else model
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text"))
    return map_arrow(texts, _predictions(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, rejected boolean")


def recognised(docs: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """docs without the rows that decoding rejects (no letters, or a long text that fits
    no codeword), and only those of the wanted languages, if given; same columns.

    Short texts that are ambiguous stay: they can be as good as any. A null text
    goes, rows without a doc_id are judged like others, repeated rows stay as often
    as they are there. Without a row to train on every row goes; an empty table
    gives an empty one.
    """
    model = train(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [judge(model, t.as_py() or "") for t in texts]
            known = [not rejected and (wanted is None or language in wanted) for language, _, rejected in found]
            yield batch.filter(pa.array(known, pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
