"""Best-fit packing of tokenised documents by pattern counts.

Documents are tokenised where they lie; the longer ones are cut into pieces of
the capacity, the first piece taking what is left over. Only the histogram of
piece lengths, at most one count per length, comes to the driver. There a
non-negative least-squares fit gives each pattern of up to three lengths that
fill a sequence exactly a repeat count; the counts are rounded, and the pieces
they leave over are packed best fit, longest first, on the histogram as well.
The plan is a table of slots (length, range of ranks, sequence, offset) whose
size depends on the capacity alone; each piece finds its slot by its rank among
the pieces of its length.

Defined results: a null or empty text is one piece that holds the end token;
repeated rows are packed once each; rows with a null id are packed as others
are; very long texts are tokenised whole and cut; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tombolo.llm.common import byte_letters, written

CAPACITY = 1024
END_ID = 2
#: Longest run without white space that the quick encoder gets; its merge is quadratic in such a run.
LONG_RUN = 1000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """A function from a text to its ids, those of the ``tokenizers`` library for the file ``vocabulary``.

    ``tiktoken`` gives the same ids several times faster; the vocabulary is
    handed to it as it stands. Texts with a very long run of one kind, and any
    that it gives up on, go to ``tokenizers``.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    byte_of = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in slow.get_vocab(with_added_tokens=False).items() if t not in special}
    quick = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        if len(text) <= LONG_RUN or max(map(len, text.split()), default=0) <= LONG_RUN:
            try:
                return quick.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # its regular expressions can run out of stack
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", content: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its partition and its rank there among the pieces of its length."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, texts = batch.columns[0], batch.columns[1]
            which, number, start, length, crc, nth = [], [], [], [], [], []
            for row in range(batch.num_rows):
                ids = np.append(encode(texts[row].as_py() or ""), end_id).astype("<u4")
                for k, (at, n) in enumerate(cut_points(len(ids), capacity)):
                    which.append(row)
                    number.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n]))
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(which, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(which), part, np.int32)), pa.array(nth, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("text")).mapInArrow(tokenise, PIECES)


# -- the plan, on the histogram -----------------------------------------------


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0, a > 0 and sum ``capacity`` whose non-zero lengths occur."""
    ok = np.zeros(capacity + 1, bool)
    ok[present] = True
    ok[0] = True
    a, b = np.meshgrid(np.arange(capacity + 1), np.arange(capacity + 1), indexing="ij")
    c = capacity - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    out = np.stack([a[keep], b[keep], c[keep]], 1)
    return out[ok[out].all(1) & (out[:, 0] > 0)]


def fit(shapes: np.ndarray, counts: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: repeat counts whose pieces come closest to ``counts``.

    Every step is a gather and a scatter over the non-zero lengths, so that the
    matrix is never formed.
    """
    size = len(counts)
    weight = np.ones(size)
    weight[0] = 0.0  # no piece
    weight[1:9] = 0.09  # the shortest fit in anywhere
    scale = max(1.0, counts[1:].max())
    goal = counts / scale

    def ahead(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(shapes[:, j], x, size) for j in range(shapes.shape[1]))

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[shapes[:, j]] for j in range(shapes.shape[1]))

    v = np.ones(len(shapes))
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = back(weight * ahead(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(weight * ahead(v))) + 1e-12)
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(weight * (ahead(y) - goal)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats): every counted piece is placed in exactly one sequence."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[1:].sum() == 0:
        return out
    out.append(((capacity,), int(left[capacity])))
    left[capacity] = 0
    shapes = patterns(capacity, np.flatnonzero(left))
    if len(shapes):
        x = fit(shapes, left.astype(float))
        for k in np.lexsort((np.arange(len(x)), -x)):
            if x[k] < 0.5:
                break
            lengths = [int(n) for n in shapes[k] if n]
            n = min(int(x[k] + 0.5), *(int(left[m]) // lengths.count(m) for m in lengths))
            if n > 0:
                out.append((tuple(lengths), n))
                for m in lengths:
                    left[m] -= n
    # open sequences by the room left in them: lists of (lengths, repeats)
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for m in range(capacity, 0, -1):
        n = int(left[m])
        while n:
            at = next((r for r in range(m, capacity) if room[r]), None)
            if at is None:
                fill = capacity // m  # best fit puts as many of this length together as go in
                if n >= fill:
                    room[capacity - fill * m].append(((m,) * fill, n // fill))
                    n %= fill
                if n:
                    room[capacity - n * m].append(((m,) * n, 1))
                break
            lengths, repeats = room[at].pop()
            each = min(at // m, n)
            use = min(repeats, n // each)
            if repeats > use:
                room[at].append((lengths, repeats - use))
            room[at - each * m].append((lengths + (m,) * each, use))
            n -= use * each
    return out + [x for rows in room for x in rows]


def slots(shapes: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: first rank, first sequence and offset of the ranks from there on."""
    rows, rank, sequence = [], {}, 0
    for lengths, repeats in shapes:
        at = 0
        for m in lengths:
            rows.append((m, rank.get(m, 0), sequence, at))
            rank[m] = rank.get(m, 0) + repeats
            at += m
        sequence += repeats
    table = np.array(sorted(r for r in rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", content: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    cutted = written(pieces(docs, vocabulary, doc_id, content, capacity, end_id), "pieces")
    # few counts per partition: ranks of a length run on from partition to partition
    per_part = cutted.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "base")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cutted.groupBy("length").count().toLocalIterator():  # one row per length at most
        counts[row["length"]] = row["count"]
    where = slots(plan(counts, capacity))
    # rank and length in one sortable number
    keys = where["length"] * (1 << 52) + where["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = {n: batch.column(n) for n in batch.schema.names}
            length, rank = d["length"].to_numpy().astype(np.int64), d["rank"].to_numpy()
            at = np.searchsorted(keys, length * (1 << 52) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [d["doc_id"], d["piece"], d["start"], pa.array(length), d["ids_crc32"], pa.array(where["sequence"][at] + rank - where["rank"][at]), pa.array(where["offset"][at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cutted.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
