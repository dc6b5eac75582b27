"""Token counts under a unigram vocabulary by dynamic programming over a trie.

A text's pre-tokens are its words between spaces, each with the mark that stands
for the space before it. A task counts each distinct pre-token once: the new ones
of a block of texts are put in order, which is the depth-first order of their
trie, and the forward scores (best log-probability of a prefix, and how many
pieces it takes) are computed once for each trie node; a word takes over the
scores of the prefix that it shares with the word before it. The count at a
word's end is stored, and a text's count is the sum over its pre-tokens. Texts
are never moved between tasks.

Piece probabilities follow Zipf's law in the vocabulary's order: the vocabulary
is public and has ranks, and no tokeniser is trained here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, whole_text

MARK = "▁"  # fixed by the vocabulary: stands for a space
#: Counts of distinct pre-tokens that a worker keeps.
CACHE_WORDS = 300_000
#: A pre-token beyond this length is counted and not stored.
CACHE_CHARS = 200

_counters: dict[str, Counter] = {}


class Counter:
    """Counts of pieces on the best path; ties go to fewer pieces."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        tails: dict[str, set[int]] = {}  # lengths of the pieces that end in two characters
        for piece in scores:
            if len(piece) > 1:
                tails.setdefault(piece[-2:], set()).add(len(piece))
        self.tails = {t: sorted(n) for t, n in tails.items()}
        self.least = min(scores.values(), default=0.0) - 10.0  # of each byte of an unknown character
        self.stored: dict[str, int] = {}
        self.nodes = 0  # trie nodes computed

    @classmethod
    def load(cls, path: str) -> Counter:
        """From a sentencepiece model file: plain pieces only."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        return cls({model.id_to_piece(k): -math.log(n + 1) for n, k in enumerate(plain, 1)})

    def learn(self, words: list[str]) -> dict[str, int]:
        """Counts of distinct words, given in order."""
        get, tails, least = self.scores.get, self.tails.get, self.least
        best, count = [0.0], [0]  # of the prefixes of the word before
        last, out = "", {}
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                score = get(word[end - 1])
                size = 1 if score is not None else len(word[end - 1].encode("utf-8", "replace"))
                top = best[end - 1] + (score if score is not None else size * least)
                n = count[end - 1] + size
                for length in tails(word[end - 2 : end], ()):
                    if length > end:
                        break
                    score = get(word[end - length : end])
                    if score is not None:
                        score += best[end - length]
                        if score > top or (score == top and count[end - length] + 1 < n):
                            top, n = score, count[end - length] + 1
                best.append(top)
                count.append(n)
            self.nodes += len(word) - shared
            out[word] = count[-1]
            last = word
        return out

    def __call__(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.stored) > CACHE_WORDS:
            self.stored.clear()
        split = [t.split(" ") if t else [] for t in texts]
        new = set().union(*split).difference(self.stored)
        found = self.learn(sorted(MARK + w for w in new))
        self.stored.update((w[1:], n) for w, n in found.items())
        known = self.stored.__getitem__
        out = [(len(words), sum(map(known, words))) for words in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.stored[w]
        return out


def _counted(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = _counters[path](part["text"].to_pylist())
                columns = [part["doc_id"], *(pa.array([x[k] for x in found], pa.int64()) for k in range(2))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_tokens"])

    return rows


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of docs.

    docs needs doc_id and text; other columns are ignored. A null or empty text
    has no tokens. Spaces in a row make pre-tokens of the mark alone. Characters
    that the vocabulary lacks count as many tokens as they have bytes in UTF-8.
    Repeated rows come as often as they are there.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return map_arrow(texts, _counted(vocabulary), "doc_id long, n_pretokens long, n_tokens long")
