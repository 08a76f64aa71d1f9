"""BPE encoding and decoding by speculation and verification.

The distinct words of a batch are split by greedy longest match. A split is
what the merges give if every token can be reached by merging its own letters
and every adjacent pair is compatible, that is, no merge earlier than those
inside both tokens crosses their border. The test runs on arrays over all
pairs at once and its verdicts are kept; words that fail are merged exactly.
Words known from earlier batches of a task are not split again.

Text is normalised and split into words by one quick regular expression where
that surely does what the library does: texts whose every character is no mark
and no Hangul letter of its own, and comes out of the library's normaliser and
splitter as it does here, which is asked once per character. All other texts
are normalised and split by the library, whose tables of Unicode are of another
version than Python's.

Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows are encoded once each; very long texts and words are
encoded whole; an empty table gives an empty result; only the named columns are
read. The strings of special tokens in a text become their ids, as in the
``tokenizers`` library's default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tombolo.llm.common import byte_letters, in_parts

#: Characters handled at once, and words whose splits a task keeps.
PART_CHARS, KEPT_WORDS = 2_000_000, 300_000
END = "</w>"
#: White space as the file's regular expressions take it.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def _lowered(text: str) -> str:
    """Each character lower-cased by itself, so that a sigma never takes its final form."""
    return text.replace("Σ", "σ").lower()


class WordBPE:
    """Encoder for a vocabulary file whose words end in ``</w>`` and whose text is lower-cased NFC."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary)
        self.normalised, self.pre_split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.simple, self.odd = set(map(chr, range(128))), set()
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [a + b.removesuffix(END) + (END if b.endswith(END) else "") for a, b in merges]
        later = set(made)
        base = [t for t in vocab if t not in later]
        # tokens are numbered by the time at which merging makes them: letters first, then merge by merge
        self.names = base + made
        if len(set(self.names)) != len(self.names):
            raise ValueError("two merges make the same token")
        self.ids = [vocab[t] for t in self.names]
        self.number = {t: n for n, t in enumerate(self.names)}
        self.n_base = len(base)
        self.rank = {m: r for r, m in enumerate(merges)}
        left = np.arange(len(self.names))
        right = np.arange(len(self.names))
        left[self.n_base :] = [self.number[a] for a, _ in merges]
        right[self.n_base :] = [self.number[b] for _, b in merges]
        self.left, self.right = left, right
        pairs = left[self.n_base :] * len(self.names) + right[self.n_base :]
        order = np.argsort(pairs)
        self.pair_keys, self.pair_made = pairs[order], order + self.n_base
        self.longest = max(map(len, self.names))
        #: the longest token that begins with two letters; others have one
        self.reach: dict[str, int] = {}
        for t in self.names:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 0))
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.reached: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.id_text: dict[str, str] = {}
        self.token_text: dict[str, str] = {}
        self.old: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.failed = self.learned = 0

    # -- splitting a text ------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The words of a text in order; special tokens stand as themselves."""
        if self.special_at and "<|" in text and self.special_at.search(text):
            out = []
            for part in self.special_at.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and self._holds_odd(text):
            text = self.normalised(text)
            return [text[a:b] for _, (a, b) in self.pre_split(text)]
        return _WORD.findall(_lowered(text))

    def _holds_odd(self, text: str) -> bool:
        letters = set(text)
        for c in letters - self.simple - self.odd:
            (self.simple if self._is_simple(c) else self.odd).add(c)
        return not letters.isdisjoint(self.odd)

    def _is_simple(self, c: str) -> bool:
        """Does ``c`` stay apart from its neighbours, and is it changed, and split from letters and signs, as the library does it?"""
        if unicodedata.category(c)[0] in "MC" or "\u1100" <= c <= "\u11ff":  # Hangul letters join into syllables
            return False
        here, there = _lowered(c), self.normalised(c)
        if here != there and not (here.isspace() and there == " "):
            return False
        return all(len(_WORD.findall(x + here + x)) == len(self.pre_split(x + there + x)) for x in "a!")

    # -- speculation -----------------------------------------------------------

    def greedy(self, letters: str) -> list[int] | None:
        """Numbers of the longest matches from left to right; None where a letter is in no token."""
        number, reach, out, i, n = self.number, self.reach, [], 0, len(letters)
        while i < n:
            if n - i + len(END) <= self.longest and (t := number.get(letters[i:] + END)) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + reach.get(letters[i : i + 2], 1)), i, -1):
                if (t := number.get(letters[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    # -- verification ----------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does merging their joint letters give the two back?

        The later of the two tokens is undone step by step on the side of the
        border; a merge across the border that comes before the last one undone
        would have been made first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), len(self.names), np.int64)
        out = np.ones(len(a), bool)
        active = np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            key = x * len(self.names) + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == key) & (self.pair_made[at] < limit[active])
            out[active[crossed]] = False
            active = active[~crossed]
            x, y = a[active], b[active]
            # which one was made last; of two letters neither can be undone. An equal pair undoes the right one first
            undo_left = x > y
            new_limit = np.where(undo_left, x, y + 1)
            step_x = np.where(undo_left, self.right[x], x)
            step_y = np.where(undo_left, y, self.left[y])
            stuck = (step_x == x) & (step_y == y)
            other_left = stuck & ~undo_left
            other_right = stuck & undo_left
            # the later one is a letter: then both are, for letters are numbered first
            done = other_left | other_right
            a[active], b[active], limit[active] = step_x, step_y, new_limit
            active = active[~done]
        return out

    def reachable(self, token: int) -> bool:
        """Does merging a token's own letters give the token?"""
        if token not in self.reached:
            name = self.names[token]
            end = name.endswith(END) and name != END
            letters = list(name.removesuffix(END) if end else name)
            if end:
                letters[-1] += END
            self.reached[token] = self._merge(letters) == [name]
        return self.reached[token]

    def learn(self, words: Iterable[str]) -> None:
        """Split new words: proposals, one test over all their pairs, exact merges for those that fail."""
        words = list(words)
        spelled = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        proposed = [self.greedy(s) for s in spelled]
        size = len(self.names)
        keys = {k for p in proposed if p for a, b in zip(p, p[1:], strict=False) if (k := a * size + b) not in self.fits}
        if keys:
            flat = np.fromiter(keys, np.int64, len(keys))
            self.fits.update(zip(flat.tolist(), self.compatible(flat // size, flat % size).tolist(), strict=True))
        fits = self.fits
        for word, letters, p in zip(words, spelled, proposed, strict=True):
            if p is None or not all(map(self.reachable, p)) or not all(fits[a * size + b] for a, b in zip(p, p[1:], strict=False)):
                self.failed += 1
                names = self._merge([*letters[:-1], letters[-1] + END])
                p = [self.number[t] for t in names if t in self.number]
            self.id_text[word] = " ".join(str(self.ids[t]) for t in p)
            self.token_text[word] = " ".join(self.names[t] for t in p)
        self.learned += len(words)

    def _merge(self, symbols: list[str]) -> list[str]:
        """The exact result: the earliest merge first, the leftmost of several places."""
        rank, n = self.rank, len(symbols)
        if n <= 40:
            return self._merge_short(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # a heap of rank and place in one number; a pair that has changed since has another rank now, or none
        never = len(rank)
        heap = [r * n + i for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(p, never)) < never]
        heapq.heapify(heap)
        alive: list[str | None] = list(symbols)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j >= n or alive[i] is None or rank.get((alive[i], alive[j])) != r:
                continue
            alive[i], alive[j] = alive[i] + alive[j], None
            after[i] = end = after[j]
            if end < n:
                before[end] = i
                if (r := rank.get((alive[i], alive[end]), never)) < never:
                    heapq.heappush(heap, r * n + i)
            k = before[i]
            if k >= 0 and (r := rank.get((alive[k], alive[i]), never)) < never:
                heapq.heappush(heap, r * n + k)
        return [s for s in alive if s is not None]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The same by a look at all pairs before each merge, which is quicker for the usual word."""
        never = len(self.rank)
        rank = self.rank.get
        ranks = [rank(p, never) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), never)
        return symbols

    # -- whole texts -----------------------------------------------------------

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids, decoded text) of each text, the ids in decimal with a space between."""
        split = [self.words(t) for t in texts]
        if len(self.id_text) > KEPT_WORDS:  # two generations: words still in use move on to the new one
            self.old, self.id_text, self.token_text = (self.id_text, self.token_text), {}, {}
        if len(self.fits) > 4 * KEPT_WORDS:
            self.fits.clear()
        for s, i in self.special.items():
            self.id_text[s], self.token_text[s] = str(i), s
        new = {w for w in set(chain.from_iterable(split)) if w not in self.id_text}
        known = {w for w in new if w in self.old[0]}
        for w in known:
            self.id_text[w], self.token_text[w] = self.old[0][w], self.old[1][w]
        self.learn(new - known)
        ids, tokens = self.id_text.__getitem__, self.token_text.__getitem__
        for words in split:
            yield " ".join(filter(None, map(ids, words))), " ".join(filter(None, map(tokens, words)))


@lru_cache(maxsize=2)
def coder(vocabulary: str) -> WordBPE:
    return WordBPE(vocabulary)


def encode_decode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", content: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded), or with ``digests`` (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in in_parts([len(t) for t in texts], PART_CHARS):
                rows = list(bpe.encode(texts[i:j]))
                keys = batch.column(0).slice(i, j - i)
                if digests:
                    hexed = [[hashlib.sha256(r[k].encode()).hexdigest() for r in rows] for k in (0, 1)]
                    counts = [r[0].count(" ") + 1 if r[0] else 0 for r in rows]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(hexed[0], pa.string()), pa.array(hexed[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids = pa.array([[int(x) for x in r[0].split()] for r in rows], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys, ids, pa.array([r[1] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("text")).mapInArrow(run, schema)
