"""Language-model scores of documents by stupid backoff.

The model is the n-gram counts of all documents; a document is scored without
its own counts, so that a text is not its own evidence. A word scores the count
of its n-gram over that of its context; where the n-gram was not seen elsewhere
the next shorter one counts, times 0.4 for each step. A word seen nowhere else
scores as if seen once.

Documents are tokenised into chunks of bounded size, which are written once.
A chunk asks for the totals of its distinct n-grams, an n-gram by its hash,
which has so many bits that at most one n-gram in 2**20 shares its own with
another, whatever the size of the corpus: the requests, with the chunk's own counts, are dealt by hash, so that a
partition holds one part of the count table, and the totals go back to the
chunks that asked, where they are joined to the n-grams of every document and
summed. An n-gram is asked for once per chunk however many documents hold it;
therefore none is hot.

``relational_scores`` is the same in plain relations, n-grams exploded into rows
and joined to a table of counts: fit for small corpora, as its shuffles are
several times the input.

The score of a document is the mean of its words' log scores; their sum, which
follows a document's length, stands beside it.

Words are maximal runs of letters, digits and underscores, lower-cased.

Defined results: a null text is the empty text, with 0 words and score 0;
repeated rows count and are scored once each; a very long text is a chunk of its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tombolo.llm.common import in_parts, split_join, written
from tombolo.llm.near_dup import _WORD, WordHashes, _mix

ORDER, BACKOFF = 3, 0.4
#: Words of a chunk, unless a single document has more.
CHUNK = 1_000_000
#: Distinct n-grams of chunks that a partition of the count table is meant to get.
SHARE = 3_000_000
PART_CHARS = 1_000_000
_U = np.uint64
#: Bits of an n-gram's hash beyond those that number all n-grams, its bits at most, and the fewest that tell its bucket.
SPARE_BITS, MOST_BITS, _BUCKET_BITS = 20, 60, 8
_CHUNKS = "chunk long, doc_ids array<long>, sizes binary, words binary, places binary, n long"


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes, all lowest bytes first, which are worth more to the compressor than whole numbers."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _short(h: np.ndarray, base: int) -> bytes:
    """The sorted hashes of one bucket, which begins at ``base``, as steps of as few bytes as the largest needs; the highest bytes are compressed."""
    steps = np.diff(h, prepend=_U(base)).astype("<u8")
    width = max(2, -(-int(steps.max()).bit_length() // 8))
    planes = steps.view(np.uint8).reshape(-1, 8)
    top = zstandard.ZstdCompressor(level=3).compress(planes[:, width - 1].tobytes())
    return bytes([width]) + len(h).to_bytes(4, "little") + planes[:, : width - 1].tobytes() + top


def _long(b: bytes, base: int) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:5], "little")
    low = n * (width - 1)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : width - 1] = np.frombuffer(b, np.uint8, low, 5).reshape(n, width - 1)
    planes[:, width - 1] = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[5 + low :]), np.uint8)
    return _U(base) + np.cumsum(planes.view("<u8").reshape(-1), dtype=_U)


def chunks(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", size: int = CHUNK) -> DataFrame:
    """Chunks of documents: ids, words per document, distinct word hashes, and for each word its place among those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
        ids, own, total = [], [], 0

        def flushed() -> pa.RecordBatch:
            words, places, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            often = np.argsort(-times, kind="stable")  # frequent words get small numbers, which compress well
            words, places = words[often], np.argsort(often)[places]
            sizes = np.array([len(w) for w in own], "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([_packed(sizes)], pa.binary()), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([_packed(places.astype("<u4"))], pa.binary()), pa.array([total], pa.int64())],
                ["chunk", "doc_ids", "sizes", "words", "places", "n"],
            )

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in in_parts([len(t) for t in texts], PART_CHARS):
                hashes.trim()
                for key, text in zip(keys[i:j], texts[i:j], strict=True):
                    w = _WORD.findall(text.lower())
                    ids.append(key)
                    own.append(np.fromiter(map(hashes.__getitem__, w), _U, len(w)))
                    total += len(w)
                    if total >= size:
                        yield flushed()
                        number, ids, own, total = number + 1, [], [], 0
        if ids:
            yield flushed()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("text")).mapInArrow(run, _CHUNKS)


def hash_bits(words: int, order: int) -> int:
    """Bits of a hash for a corpus of so many words."""
    return min(MOST_BITS, (words * order).bit_length() + SPARE_BITS)


def grams(flat: np.ndarray, sizes: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """For n = 1 to ``order`` the hash of the n-gram that ends at each word; 0 where the document has fewer words before."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            if n == 1:
                h = _mix(flat + _U(1))
            else:
                before = np.concatenate([np.zeros(1, _U), out[-1][:-1]])[: len(flat)]
                h = _mix(before * _U(0x9E3779B97F4A7C15) + flat + _U(n))
            out.append(np.where(place >= n - 1, h, _U(0)))
    return [np.where(place >= n, np.maximum(h >> _U(64 - bits), _U(1)), _U(0)) for n, h in enumerate(out)]


def _opened(words: bytes, places: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(words, "<u8")[_unpacked(places, "<u4")], _unpacked(sizes, "<u4").astype(np.int64)


def _asked(flat: np.ndarray, sizes: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk in order of hash, and their counts."""
    keys, counts = np.unique(np.concatenate(grams(flat, sizes, order, bits)), return_counts=True)
    return (keys[1:], counts[1:]) if len(keys) and keys[0] == 0 else (keys, counts)


def _placed(flat: np.ndarray, sizes: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What ``_asked`` gives, and for each order the place of every word's n-gram among the distinct ones, -1 where it has none.

    Orders are sorted one by one and then merged, which takes less memory than all at once.
    """
    own = []
    for h in grams(flat, sizes, order, bits):
        found, which, counts = np.unique(h, return_inverse=True, return_counts=True)
        none = int(len(found) > 0 and found[0] == 0)
        own.append((found[none:], (which - none).astype(np.int32), counts[none:]))
    keys = np.sort(np.concatenate([found for found, _, _ in own]), kind="stable")  # merges sorted runs
    keys = keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]
    times, places = np.zeros(len(keys), np.int64), []
    for found, which, counts in own:
        at = np.searchsorted(keys, found)
        times[at] += counts
        places.append(np.append(at, -1)[which])
    return keys, times, places


def requests(chunked: DataFrame, bits: int, bucket_bits: int, order: int) -> DataFrame:
    """(bucket, chunk, hashes, counts): a chunk's n-grams, by the first ``bucket_bits`` bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                keys, counts = _asked(*_opened(get("words"), get("places"), get("sizes")), order, bits)
                bucket = (keys >> _U(bits - bucket_bits)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket)) + 1
                parts = [(a, b) for a, b in zip([0, *edges], [*edges, len(keys)], strict=True) if a < b]
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket[a] for a, _ in parts], pa.int64()), pa.array([get("chunk")] * len(parts), pa.int64()), pa.array([_short(keys[a:b], int(bucket[a]) << (bits - bucket_bits)) for a, b in parts], pa.binary()), pa.array([_packed(counts[a:b].astype("<u4")) for a, b in parts], pa.binary())],
                        ["bucket", "chunk", "hashes", "counts"],
                    )

    return chunked.select("chunk", "sizes", "words", "places").mapInArrow(run, "bucket long, chunk long, hashes binary, counts binary")


def replies(asked: DataFrame, partitions: int, bits: int, bucket_bits: int) -> DataFrame:
    """(chunk, bucket, totals): the counts of each request's n-grams in all other chunks, in the request's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def answered() -> pa.RecordBatch:
            keys = [_long(h, current << (bits - bucket_bits)) for _, h, _ in held]
            _, which = np.unique(np.concatenate(keys), return_inverse=True)
            own = np.concatenate([_unpacked(c, "<u4") for _, _, c in held])
            others = np.bincount(which, own)[which] - own  # mostly 0, and a chunk knows its own counts
            ends = np.cumsum([len(k) for k in keys])
            blobs = [_packed(others[e - len(k) : e].astype("<u8")) for e, k in zip(ends, keys, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in held], pa.int64()), pa.array([current] * len(held), pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "bucket", "totals"])

        for batch in batches:
            bucket, chunk, h, c = (batch.column(i).to_pylist() for i in range(4))
            for k in range(batch.num_rows):
                if bucket[k] != current:
                    if held:
                        yield answered()
                    current, held = bucket[k], []
                held.append((chunk[k], h[k], c[k]))
        if held:
            yield answered()

    return asked.repartition(partitions, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, "chunk long, bucket long, totals binary")


def score_chunk(flat: np.ndarray, sizes: np.ndarray, others: np.ndarray, words: int, bits: int, order: int = ORDER, backoff: float = BACKOFF) -> np.ndarray:
    """Sum of log scores per document; ``others`` are the counts in other chunks of this one's distinct n-grams, in order of hash, ``words`` all words of the corpus."""
    keys, times, places = _placed(flat, sizes, order, bits)
    totals = others + times
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rest = (words - sizes)[owner].astype(np.float64)  # words of the other documents
    elsewhere = []  # counts of each word's n-grams in the other documents
    for at in places:
        _, which, own = np.unique(owner * (len(keys) + 1) + at, return_inverse=True, return_counts=True)
        elsewhere.append(np.where(at < 0, 0, totals[at] - own[which]) if len(totals) else np.zeros(0))
    score = np.log(np.maximum(elsewhere[0], 1) / np.maximum(rest, 1))
    context = [np.concatenate([np.zeros(1), e[:-1]])[: len(flat)] for e in elsewhere]
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for n in range(2, order + 1):
        seen = elsewhere[n - 1] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.log(elsewhere[n - 1] / context[n - 2])
        # a word with fewer words before it has no n-gram of this length to back off from
        score = np.where(seen, ratio, score + np.where(place >= n - 1, np.log(backoff), 0.0))
    return np.bincount(owner, score, len(sizes)) if len(flat) else np.zeros(len(sizes))


_SCORES = "doc_id long, n_words long, score double, log_sum double"


def _scored(ids: list, sizes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums / np.maximum(sizes, 1), pa.float64()), pa.array(sums, pa.float64())], ["doc_id", "n_words", "score", "log_sum"])


def scores(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", order: int = ORDER, backoff: float = BACKOFF, size: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, score, log_sum): the mean of a document's log scores per word, and their sum."""
    spark = docs.sparkSession
    chunked = written(chunks(docs, doc_id, content, size), "lm-chunks")
    words = chunked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = hash_bits(words, order)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(width, -(-words * order // SHARE))
    bucket_bits = min(bits, max(_BUCKET_BITS, (4 * partitions - 1).bit_length()))
    answers = replies(requests(chunked, bits, bucket_bits, order), partitions, bits, bucket_bits)
    both = chunked.select("chunk", F.lit(-1).cast("long").alias("bucket"), "doc_ids", "sizes", "words", "places", F.lit(None).cast("binary").alias("totals")).unionByName(answers, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals = None, []

        def scored() -> pa.RecordBatch:
            ids, sizes_, words_, places = held
            flat, sizes = _opened(words_, places, sizes_)
            total = np.concatenate([_unpacked(t, "<u8") for t in totals]).astype(np.float64) if totals else np.zeros(0)
            sums = score_chunk(flat, sizes, total, words, bits, order, backoff)
            return _scored(ids, sizes, sums)

        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                if get("bucket") < 0:
                    if held:
                        yield scored()
                    held, totals = tuple(map(get, ("doc_ids", "sizes", "words", "places"))), []
                else:
                    totals.append(get("totals"))
        if held:
            yield scored()

    # about a chunk a task, however large the corpus
    return both.repartition(max(width, -(-words // size)), "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, _SCORES)


def relational_scores(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """The rows of ``scores`` by relations: documents' n-grams exploded and counted, joined to the table of all counts, and brought back by document."""
    rows = written(chunks(docs, doc_id, content, 1), "lm-documents")  # a document each
    words = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = hash_bits(words, order)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                keys, counts = _asked(*_opened(get("words"), get("places"), get("sizes")), order, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), get("chunk"), np.int64)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["chunk", "gram", "own"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flat, sizes = _opened(r["words"], r["places"], r["sizes"])
                others = np.array([x["others"] for x in r["found"] or []], np.float64)
                yield _scored(r["doc_ids"], sizes, score_chunk(flat, sizes, others, words, bits, order, backoff))

    exploded = rows.select("chunk", "sizes", "words", "places").mapInArrow(explode, "chunk long, gram long, own long")
    table = exploded.groupBy("gram").agg(F.sum("own").alias("total"))
    # an n-gram stands in no more documents than its total says
    found = split_join(exploded, table, "gram", F.col("chunk"), rows="total").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("gram", (F.col("total") - F.col("own")).alias("others")))).alias("found"))
    return rows.join(found, "chunk", "left").select("doc_ids", "sizes", "words", "places", "found").mapInArrow(score, _SCORES)
