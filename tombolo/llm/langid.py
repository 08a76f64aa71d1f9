"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. An
n-gram's vector binds its letters' vectors, each permuted by its place, by
elementwise products. A text's vector bundles (sums) those of its n-grams; a
language's prototype bundles the n-grams of its training texts. Before
comparison the mean of the prototypes is taken from texts and prototypes, which
leaves what sets languages apart, and the prototype with the largest cosine is
predicted.

Texts are lower-cased; letters are what Unicode calls letters, and every run of
other characters is one boundary, so that n-grams see where words begin and end.

Defined results: a null text and one without a letter is ``und`` with score 0;
training rows with a null text or language count for nothing; where no language
could be learned all texts are ``und``; of equal cosines the alphabetically
first language is predicted; repeated rows are predicted once each; very long
texts are read whole, all their n-grams at once; an empty table gives an empty
result; only the named columns are read. More than 2000 different values of the
language column raise an error, as they are no languages and each is a vector
on the driver.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tombolo.llm.common import in_parts

DIMENSION, N = 1024, 3
#: Characters and documents handled at once.
PART_CHARS, PART_ROWS = 1_000_000, 512
#: N-grams whose vectors are held at once.
BLOCK = 8192
UND = "und"
#: Different values of the language column, at most.
LANGUAGES = 2000
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    is_letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return np.where(is_letter, points, 0).astype(np.uint32)


def letter_vectors(points: np.ndarray, dimension: int) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same everywhere and always."""
    words = -(-dimension // 64)
    x = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)[None]
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = x + np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(points), -1), axis=1)[:, :dimension]
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray, dimension: int, n: int) -> np.ndarray:
    """The bound vectors of n-grams whose letters are packed 21 bits each into ``codes``."""
    out = None
    for place in range(n):
        points = (codes >> np.int64(21 * (n - 1 - place))) & 0x1FFFFF
        some, which = np.unique(points, return_inverse=True)
        turned = np.roll(letter_vectors(some, dimension), n - 1 - place, axis=1)[which]
        out = turned if out is None else out * turned
    return out


def gram_codes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, packed n-gram) of all n-grams of the texts that hold a letter."""
    joined = "\n".join([t.lower() for t in texts])
    lengths = np.array([len(t.lower()) for t in texts], np.int64)
    points = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[: len(points)]
    # runs of boundaries become one; texts always have one between them
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])
    points, owner = points[keep].astype(np.int64), owner[keep]
    if len(points) < n:
        # one or two letters: boundaries around them make up the n-gram
        points, owner = np.pad(points, (n - 1, n - 1)), np.pad(owner, (n - 1, n - 1), mode="edge") if len(owner) else np.zeros(2 * n - 2, np.int64)
    code = np.zeros(len(points) - n + 1, np.int64)
    same = np.ones(len(code), bool)
    for place in range(n):
        code = (code << 21) | points[place : place + len(code)]
        same &= owner[place : place + len(code)] == owner[: len(code)]
    same &= code != 0
    return owner[: len(code)][same], code[same]


def bundle(texts: list[str], dimension: int = DIMENSION, n: int = N, group: np.ndarray | None = None) -> np.ndarray:
    """The vectors of the texts as rows, zeros for a text without a letter; with ``group``, a number per text, the exact sums of the groups."""
    # a boundary at either end, so that the shortest texts have n-grams too
    owner, code = gram_codes([f"\n{t}\n" for t in texts], n)
    size = len(texts) if group is None else int(group.max(initial=-1)) + 1
    kind = np.float32 if len(code) < 1 << 24 else np.float64  # sums of this many signs are exact
    if group is not None:
        owner = group[owner]
    out = np.zeros((size, dimension), kind)
    some, which = np.unique(code, return_inverse=True)
    counts = np.bincount(owner * max(1, len(some)) + which, minlength=size * len(some)).reshape(size, len(some)) if size * len(some) <= 1 << 24 else None
    for begin in range(0, len(some), BLOCK):
        end = min(len(some), begin + BLOCK)
        if counts is None:
            inside = (which >= begin) & (which < end)
            part = np.bincount(owner[inside] * (end - begin) + which[inside] - begin, minlength=size * (end - begin)).reshape(size, end - begin)
        else:
            part = counts[:, begin:end]
        out += part.astype(kind) @ gram_vectors(some[begin:end], dimension, n).astype(kind)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _parts(texts: list[str | None]) -> list[tuple[int, int]]:
    return in_parts([max(len(t or ""), PART_CHARS // PART_ROWS) for t in texts], PART_CHARS)


def fit(train: DataFrame, language: str = "lang", content: str = "text", dimension: int = DIMENSION, n: int = N) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes as rows) from all rows of ``train``.

    Each task adds up one vector per language; what reaches the driver is one
    vector per language, whatever the size of the input.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in _parts(texts):
                own, group = np.unique(np.array(names[i:j], object), return_inverse=True)
                for name, total in zip(own, bundle(texts[i:j], dimension, n, group), strict=True):
                    sums[name] = sums.get(name, 0) + total.astype(np.int64)
        place = np.arange(dimension, dtype=np.int32)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimension), pa.array(place), pa.array(total)], ["language", "place", "total"])

    rows = (
        train.select(F.col(language).cast("string").alias("language"), F.col(content).alias("text"))
        .dropna()
        .mapInArrow(add, "language string, place int, total long")
        .groupBy("language", "place")
        .agg(F.sum("total").alias("total"))
        .limit(LANGUAGES * dimension + 1)
        .collect()
    )
    if len(rows) > LANGUAGES * dimension:
        raise ValueError(f"column {language} has more than {LANGUAGES} values")
    names = sorted({r["language"] for r in rows})
    out = np.zeros((len(names), dimension))
    for r in rows:
        out[names.index(r["language"]), r["place"]] = r["total"]
    keep = np.linalg.norm(out, axis=1) > 0 if len(names) else np.zeros(0, bool)
    return [x for x, k in zip(names, keep, strict=True) if k], _unit(out[keep])


def distinct_words(text: str) -> str:
    """The different words of a text, in lower case."""
    return " ".join(dict.fromkeys(_WORD.findall(text.lower())))


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, content: str = "text", n: int = N, distinct: bool = False, added: tuple[str, str, str] = ("lang_pred", "score", "letters")) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the cosine cut to 0 to 1, to the columns of ``docs``.

    With ``distinct``, each word of a text counts once, and ``letters``, how
    many letters its different words have, is added, too. ``added`` gives the
    three other names where ``docs`` has these.
    """
    dimension = prototypes.shape[1] if len(names) else DIMENSION
    middle = prototypes.mean(0) if len(names) > 1 else np.zeros(dimension)
    centred = _unit(prototypes - middle).T.astype(np.float32) if len(names) else None
    at = docs.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, j in _parts(texts):
                part = [distinct_words(t or "") for t in texts[i:j]] if distinct else texts[i:j]
                some = [_has_letter(t) for t in part]
                best, score = [UND] * (j - i), np.zeros(j - i)
                if centred is not None and any(some):
                    vectors = _unit(_unit(bundle([t or "" for t in part], dimension, n)) - middle.astype(np.float32))
                    cosines = vectors @ centred
                    best = [names[k] if ok else UND for k, ok in zip(cosines.argmax(1), some, strict=True)]
                    score = np.where(some, np.clip(cosines.max(1), 0, 1), 0).astype(np.float64)
                cut = batch.slice(i, j - i)
                more = [pa.array([len(t) - t.count(" ") for t in part], pa.int64())] if distinct else []
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(best, pa.string()), pa.array(score), *more], [*batch.schema.names, *added[: 2 + distinct]])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    kinds = ("string", "double", "long")[: 2 + distinct]
    return docs.mapInArrow(run, ", ".join([schema, *[f"`{c}` {t}" for c, t in zip(added, kinds, strict=False)]]))


def held_out(key: str = "doc_id"):
    """Is a document kept from training? One in five is, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
