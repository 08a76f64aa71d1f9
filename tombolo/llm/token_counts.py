"""Token counts under a unigram model, by dynamic programming that distinct
pre-tokens share along a trie.

The distinct pre-tokens of a batch form a trie, walked depth first: in sorted
order, with one forward state per depth, so that the best score of a prefix is
computed once for all pre-tokens below it and the state at a pre-token's end
is its count. Counts of recent pre-tokens are kept from batch to batch; each
document's count is their sum. Nothing is shuffled.

The model is a vocabulary file of byte-level pieces. Such a file has ranks and
no probabilities, so a piece of rank r is given Zipf's, (r + 2.7) ** -1
normalised over the vocabulary. Of segmentations with the same score the one
with the fewest pieces counts.

Defined results: a null or empty text has no pre-tokens, no tokens and score 0;
repeated rows are counted once each; very long texts and pre-tokens are counted
whole; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tombolo.llm.common import byte_letters, in_parts

PART_CHARS, KEPT_WORDS = 2_000_000, 300_000
ZIPF_SHIFT = 2.7


class Unigram:
    """Best segmentations of byte-level pre-tokens; ``scores`` maps a piece to its log probability and holds every single byte."""

    def __init__(self, scores: dict[str, float], pattern: str):
        self.scores, self.pattern = scores, regex.compile(pattern)
        self.longest = max(map(len, scores))
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.new: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}
        self.steps = 0

    def count(self, words: Iterable[str]) -> None:
        """Walk the trie of ``words`` and store (tokens, score) at each terminal."""
        get, longest, far = self.scores.get, self.longest, -math.inf
        best, tokens = [0.0], [0]  # forward state per depth of the present path
        path = ""
        for spelled, word in sorted((w.encode().decode("latin-1").translate(self.letters), w) for w in words):
            shared = 0
            for a, b in zip(path, spelled, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(spelled) + 1):
                top, n = far, 0
                for begin in range(max(0, end - longest), end):
                    s = get(spelled[begin:end])
                    if s is not None:
                        s += best[begin]
                        if s > top or s == top and tokens[begin] < n - 1:
                            top, n = s, tokens[begin] + 1
                best.append(top)
                tokens.append(n)
            self.steps += len(spelled) - shared
            path = spelled
            self.new[word] = (tokens[-1], best[-1])

    def totals(self, texts: list[str]) -> tuple[list[int], list[int], list[float]]:
        """Pre-tokens, tokens and score of each text."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.new) > KEPT_WORDS:  # two generations: pre-tokens still in use move on
            self.old, self.new = self.new, {}
        missing = []
        for w in set(chain.from_iterable(split)):
            if w not in self.new:
                if w in self.old:
                    self.new[w] = self.old[w]
                else:
                    missing.append(w)
        self.count(missing)
        found = [list(map(self.new.__getitem__, words)) for words in split]
        return [len(x) for x in found], [sum(c for c, _ in x) for x in found], [math.fsum(s for _, s in x) for x in found]


def zipf_scores(vocabulary: str) -> dict[str, float]:
    """Log probability of each ordinary piece of a byte-level file, by its rank."""
    from tokenizers import Tokenizer

    ranks = Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=False)
    total = math.fsum(1 / (r + ZIPF_SHIFT) for r in ranks.values())
    return {p: -math.log((r + ZIPF_SHIFT) * total) for p, r in ranks.items()}


@lru_cache(maxsize=2)
def model(vocabulary: str) -> Unigram:
    from public_tokenizers import PATTERN

    return Unigram(zipf_scores(vocabulary), PATTERN)


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = model(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in in_parts([len(t) for t in texts], PART_CHARS):
                words, tokens, scores = unigram.totals(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())],
                    ["doc_id", "n_pretokens", "n_tokens", "score"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("text")).mapInArrow(
        run, "doc_id long, n_pretokens long, n_tokens long, score double"
    )
