"""Near-duplicate documents by improved consistent weighted sampling.

A document's features are its five-word shingles, weighted by term frequency
times inverse document frequency. Document frequencies are counted over all
documents in 2**20 hashed cells, a table of fixed size. Improved consistent
weighted sampling draws each of 192 samples over all shingles of a document. A
shingle that stands there m times is m copies, and a copy weighs the same in
every text: what the method draws for it is then one exponential number with
the copy's weight as its rate, so that two texts have the same sample with a
probability that is their weighted Jaccard similarity, and samples are
independent of each other, for texts of any length and for repeated lines. Six
samples make a band, 32 bands make the buckets: texts of similarity 0.8 miss
each other with probability (1 - 0.8**6)**32 = 6e-5.

Links are pairs whose weighted Jaccard similarity, computed from the texts, is
at least 0.8. The classes are the connected components over links.

* Exact copies are one node, so no copy is compared.
* Every member of a bucket is compared with the bucket's smallest id. The members
  that very many share a leader with are dealt to several tasks, each of which
  gets the leader's text once.
* What is left, members of one bucket in different classes, are compared with
  each other in tiles. A link joins two classes, which are not compared any
  more. Nothing is capped: two members of a bucket end up in one class, or were
  compared and found to differ.

Inverse document frequency runs from 1 to 2, 1 + ln((1 + N) / (1 + df)) / ln(1 + N),
so that the copies of a very large group, whose common shingles are no longer
rare, still reach 0.8 by what they share.

Words are maximal runs of letters, digits and underscores, lower-cased. A text
of fewer than five words has one shingle, all its words.

Defined results: a null text is the empty text; texts without a word are
similar to their exact copies alone; rows with a null id are not compared and
have a null class; rows that repeat an id count as one document; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tombolo.llm.common import salted_left_join, split_join, text_parts, written

WORDS, SIMILAR = 5, 0.8
ROWS, BANDS = 6, 32
SAMPLES = ROWS * BANDS
CELLS = 1 << 20
_CELL_BLOCKS = 64
PART_CHARS = 500_000
#: Copies of shingles whose points are drawn at once.
COPY_BLOCK = 1 << 17
#: Members of a bucket in a tile, and how many times as many may go past it in one task.
TILE, LANE = 256, 16
#: Members of a bucket that one task compares with the bucket's leader.
FOLLOWERS = 256
_WORD = re.compile(r"\w+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place on its argument."""
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


class WordHashes(dict):
    """Hash of a word, made when first asked for; kept within bounds by ``trim``."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def trim(self, most: int = 150_000) -> None:
        if len(self) > most:
            self.clear()


def shingles(texts: list[str], hashes: WordHashes, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times it stands there), sorted, over all texts."""
    hashes.trim()
    get = hashes.__getitem__
    own = [np.fromiter(map(get, w), _U, len(w)) for w in (_WORD.findall(t.lower()) for t in texts)]
    sizes = np.array([len(w) for w in own], np.int64)
    flat = np.concatenate([*own, np.zeros(k - 1, _U)]) if len(own) else np.zeros(k - 1, _U)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = sizes[owner]
    h = np.zeros(len(owner), _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = flat[j : j + len(h)]
            h = np.where(place + j < size, h * _U(0x9E3779B97F4A7C15) + part + _U(j + 1), h) if j else part.copy()
    whole = (place + k <= size) | ((place == 0) & (size < k))
    h, owner = _mix(h[whole]), owner[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> _U(44)).astype(np.int64)


def document_frequencies(docs: DataFrame, content: str = "text") -> tuple[int, np.ndarray]:
    """(number of documents, documents per cell): every task counts its own, and blocks of cells are summed apart."""
    width = CELLS // _CELL_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells, n = WordHashes(), np.zeros(CELLS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, some in text_parts(batch.column(0), PART_CHARS):
                owner, h, _ = shingles(some, hashes)
                cells += np.bincount(np.unique(owner * CELLS + _cell(h)) % CELLS, minlength=CELLS)
        if n:
            blocks = [cells[b * width : (b + 1) * width].astype("<u4").tobytes() for b in range(_CELL_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_CELL_BLOCKS), pa.int32()), pa.array([n] * _CELL_BLOCKS, pa.int64()), pa.array(blocks, pa.binary())], ["block", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        total: dict[int, int] = {}
        for batch in batches:
            for b, n, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(c, "<u4").astype(np.int64)
                total[b] = total.get(b, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(total.values()), pa.int64()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["block", "n", "counts"])

    schema = "block int, n long, counts binary"
    rows = docs.select(F.col(content)).mapInArrow(count, schema).repartition(_CELL_BLOCKS, "block").mapInArrow(add, schema).collect()
    out, n = np.zeros(CELLS, np.int64), 0
    for r in rows:
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
        n = r["n"]
    return n, out


def inverse_frequencies(n: int, frequencies: np.ndarray) -> np.ndarray:
    return (1 + np.log((1 + n) / (1 + np.minimum(frequencies, n))) / max(np.log(1 + n), 1e-9)).astype(np.float32)


def samples(owner: np.ndarray, h: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """A row of ``SAMPLES`` consistent weighted samples for each of ``n`` documents; rows of zeros where there is no shingle.

    A shingle that stands in a text several times is as many copies of weight
    ``idf``. Each copy has a Poisson process of that rate for each sample, the
    same in every text, and a sample is the copy whose process comes first. All
    samples of a copy are one process whose points are dealt to the samples at
    random; it is followed until it has passed the slowest sample of its text.
    """
    first, chosen = np.full(n * SAMPLES, np.inf), np.zeros(n * SAMPLES, _U)
    sizes = np.bincount(owner, times, n).astype(np.int64)
    ends = np.cumsum(times)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, COPY_BLOCK):
        copy = np.arange(begin, min(begin + COPY_BLOCK, int(ends[-1])))
        of = np.searchsorted(ends, copy, "right")
        with np.errstate(over="ignore"):
            key = _mix(h[of] + (copy - (ends - times)[of]).astype(_U) * _U(0xD6E8FEB86659FD93))
        text, rate = owner[of], idf[of].astype(np.float64) * SAMPLES
        at, drawn = np.zeros(len(copy)), np.zeros(len(copy), np.int64)
        # long texts need few points of each copy, short ones many
        more = np.maximum(1, 5 * SAMPLES // sizes[text])
        going = np.arange(len(copy))
        while len(going):
            for part in np.split(going, np.searchsorted(np.cumsum(more[going]), np.arange(COPY_BLOCK, int(more[going].sum()), COPY_BLOCK))):
                if not len(part):
                    continue
                m = more[part]
                stop = np.cumsum(m)
                start = stop - m
                point = np.repeat(np.arange(len(part)), m)
                with np.errstate(over="ignore"):
                    number = (drawn[part] - start)[point] + np.arange(len(point))
                    x = _mix(key[part][point] + (number + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
                gap = -np.log(((x >> _U(20)).astype(np.float64) + 0.5) * 2.0**-44) / rate[part][point]
                total = np.cumsum(gap)
                when = total + (at[part] - (total[start] - gap[start]))[point]
                sample = text[part][point] * SAMPLES + (((x & _U(0xFFFFF)) * _U(SAMPLES)) >> _U(20)).astype(np.int64)
                soon = np.flatnonzero(when < first[sample])
                sample, when_soon = sample[soon], when[soon]
                np.minimum.at(first, sample, when_soon)
                won = when_soon == first[sample]
                chosen[sample[won]] = key[part][point[soon[won]]] | _U(1)
                at[part], drawn[part] = when[stop - 1], drawn[part] + m
            slowest = first.reshape(n, SAMPLES).max(1)
            going = going[at[going] < slowest[text[going]]]
            more = np.maximum(1, more // 2)
    return chosen.reshape(n, SAMPLES)


def buckets(drawn: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` bucket numbers for each row of samples."""
    bands = drawn.reshape(len(drawn), ROWS, BANDS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=_U)[None].repeat(len(drawn), 0)
        for k in range(ROWS):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + bands[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    """(doc_id, key, buckets): the text's hash and its buckets in all bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i, j, some in text_parts(batch.column(1), PART_CHARS):
                owner, h, times = shingles(some, hashes)
                n = np.bincount(owner, minlength=len(some))
                drawn = samples(owner, h, times, idf[_cell(h)], len(some))
                own = [b if m else [] for b, m in zip(buckets(drawn), n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([xxhash.xxh128_digest(t) for t in some], pa.binary()),
                        pa.array(own, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "key", "buckets"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("text")).mapInArrow(run, "doc_id long, key binary, buckets array<long>")


class Weighted:
    """Exact weighted Jaccard similarity of texts."""

    def __init__(self, idf: np.ndarray):
        self.idf, self.hashes = idf, WordHashes()

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        _, h, times = shingles([text], self.hashes)
        return h, times * self.idf[_cell(h)].astype(np.float64)

    def similarity(self, a: tuple, b: tuple) -> float:
        (ha, wa), (hb, wb) = a, b
        if not len(ha) or not len(hb):
            return 0.0
        at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
        hit = ha[at] == hb
        x, y = wa[at[hit]], wb[hit]
        both = np.minimum(x, y).sum()
        return float(both / (wa.sum() + wb.sum() - both))


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float = SIMILAR, followers: int = FOLLOWERS) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, n) that are similar enough; ``texts`` has one row (doc_id, text) per id.

    ``n`` is at least the number of pairs with that ``a`` in one bucket; it says
    over how many lanes they are dealt. A lane gets its leader's text once and
    the others' texts after it, so that no task has all of a hot leader's pairs.
    """
    lane = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / followers)).alias("lane")
    dealt = pairs.select("a", lane, "b")
    fields = ("a", "lane", "side", F.col("doc_id").alias("id"), "text")
    leaders = dealt.select("a", "lane").distinct().join(texts, F.col("a") == F.col("doc_id")).withColumn("side", F.lit(0)).select(*fields)
    others = dealt.join(texts, F.col("b") == F.col("doc_id")).withColumn("side", F.lit(1)).select(*fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, leader = Weighted(idf), None
        for batch in batches:
            found = []
            for a, side, i, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                own = weighted.vector(text)
                if side == 0:
                    leader = own
                elif (s := weighted.similarity(leader, own)) >= least:
                    found.append((a, i, s))
            weighted.hashes.trim()
            yield _links(found)

    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return leaders.unionByName(others).repartition(width, "a", "lane").sortWithinPartitions("a", "lane", "side").mapInArrow(run, "a long, b long, similarity double")


def _links(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])


def components(edges: DataFrame) -> DataFrame:
    """(id, class): the smallest id that edges (a, b) connect an id with.

    Each round takes the smallest class among neighbours and then the class
    which that one had before; it is written out, so a round never recomputes
    earlier ones. An id with very many neighbours is split in the joins.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
    both = written(both.union(both.select("id", "id")).distinct(), "edges")
    now = written(both.groupBy("id").agg(F.min("other").alias("class")), "classes")
    total = None
    while True:
        new_total = now.agg(F.sum(F.col("class").cast("decimal(38,0)"))).first()[0]
        if new_total == total:  # classes only ever get smaller
            return now
        total = new_total
        near = split_join(both, now.withColumnRenamed("id", "other"), "other", F.col("id")).groupBy("id").agg(F.min("class").alias("class"))
        before = now.select(F.col("id").alias("class"), F.col("class").alias("next"))
        now = written(split_join(near, before, "class", F.col("id")).select("id", F.col("next").alias("class")), "classes")


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` after ``links`` (a, b) between members of different classes, which are few against all."""
    of = lambda name: classes.select(F.col("id").alias(name), F.col("class").alias(f"class_{name}"))
    between = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    new = components(between).select(F.col("id").alias("class"), F.col("class").alias("new"))
    known = split_join(classes, new, "class", F.col("id"), "left").select("id", F.coalesce("new", "class").alias("class"))
    # an id that had no link before is its own class
    return written(known.unionByName(new.select(F.col("class").alias("id"), F.col("new").alias("class"))).distinct(), "classes")


def classed(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of buckets of more than two, with their classes so far."""
    of = classes.select(F.col("id").alias("doc_id"), F.col("class"))
    rows = shared.filter("n_members > 2").join(of, "doc_id", "left")
    return rows.select("bucket", "leader", "doc_id", "n_members", F.coalesce("class", "doc_id").alias("class"))


def vectors(texts: DataFrame) -> DataFrame:
    """(doc_id, hashes, times): the distinct shingles of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i, j, some in text_parts(batch.column(1), PART_CHARS):
                owner, h, times = shingles(some, hashes)
                edges = np.searchsorted(owner, np.arange(j - i + 1))
                of = lambda x, kind: pa.array([x[p:q].astype(kind).tobytes() for p, q in zip(edges, edges[1:], strict=False)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), of(h, "<u8"), of(times, "<u4")], ["doc_id", "hashes", "times"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes binary, times binary")


class Tile:
    """Some members of a bucket, and the classes that links found here have joined."""

    def __init__(self, held: list[dict], idf: np.ndarray, least: float):
        self.ids = np.array([r["doc_id"] for r in held])
        self.out = np.array([r["out"] for r in held])
        self.roots = np.array([r["class"] for r in held])
        self.idf, self.least = idf, least
        self.root_of: dict[int, int] = {}
        own = [self._vector(r) for r in held]
        self.totals = np.array([w.sum() for _, w in own])
        # who holds a shingle, and with what weight: one list by shingles
        h = np.concatenate([x for x, _ in own])
        order = np.argsort(h, kind="stable")
        self.member = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x, _ in own])[order]
        self.weight = np.concatenate([w for _, w in own])[order]
        self.hashes, self.begin = np.unique(h[order], return_index=True)
        self.begin = np.append(self.begin, len(h))

    def _vector(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(row["hashes"], "<u8")
        return h, np.frombuffer(row["times"], "<u4") * self.idf[_cell(h)].astype(np.float64)

    def similarities(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Exact similarity of a document to every member."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        begin = self.begin[at[hit]]
        m = self.begin[at[hit] + 1] - begin
        place = np.repeat(begin - (np.cumsum(m) - m), m) + np.arange(m.sum())
        both = np.bincount(self.member[place], np.minimum(self.weight[place], np.repeat(w[hit], m)), len(self.ids))
        return both / (w.sum() + self.totals - both)

    def links(self, row: dict) -> list[tuple[int, int, float]]:
        """Links of a document to members of other classes: each joins two classes, so that what they join is not compared again."""
        root = self.root_of.get(row["class"], row["class"])
        may = (self.roots != root) & (self.ids != row["doc_id"]) & (~self.out | (self.ids > row["doc_id"]))
        if not may.any():
            return []
        s = self.similarities(*self._vector(row))
        at = np.flatnonzero(may & (s >= self.least))
        out = []
        for k in at[np.argsort(-s[at], kind="stable")]:
            if self.roots[k] == root:
                continue
            doc, other = row["doc_id"], int(self.ids[k])
            out.append((min(doc, other), max(doc, other), float(s[k])))
            old = int(self.roots[k])
            self.roots[self.roots == old] = root
            self.root_of = {c: root if r == old else r for c, r in self.root_of.items()} | {old: root}
        return out


def rest_links(rows: DataFrame, texts: DataFrame, idf: np.ndarray, least: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """(a, b, similarity): links that join classes which meet in a bucket.

    The largest class of a bucket lies in tiles, every member of the others is
    taken to all tiles of its bucket and to those of the others. Similarities
    to all members of a tile are computed exactly, over the shingles they
    share; classes that a link has joined in a tile are compared no more, so a
    tile returns fewer links than it has members.
    """
    sizes = rows.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("rows"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("rows", "class")).alias("m"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("bucket", F.col("m.class").alias("main"))
    rows = split_join(rows, largest, "bucket", F.col("doc_id")).select("bucket", "doc_id", "n_members", "class", (F.col("class") != F.col("main")).alias("out"))
    rows = written(rows, "near-dup-rest")
    some = texts.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = rows.join(vectors(some), "doc_id")
    tiles = F.ceil(F.col("n_members") / F.lit(tile)).cast("int")
    # what goes past a tile is split too, so that no task gets more rows than a few tiles hold
    lanes = F.ceil(F.col("n_members") / F.lit(LANE * tile)).cast("int")
    fields = ("doc_id", "class", "out", "hashes", "times")
    fixed = rows.select("bucket", F.pmod(F.xxhash64("doc_id"), tiles).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"), F.lit(0).alias("side"), *fields)
    lane = F.pmod(F.xxhash64("doc_id", F.lit(1)), lanes).cast("int").alias("lane")
    moving = rows.filter("out").select("bucket", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), lane, F.lit(1).alias("side"), *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, built = None, [], None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                here = (r["bucket"], r["tile"], r["lane"])
                if here != current:
                    current, held, built = here, [], None
                if r["side"] == 0:
                    held.append(r)
                    continue
                if held:
                    built = built or Tile(held, idf, least)
                    found += built.links(r)
            yield _links(found)

    dealt = fixed.unionByName(moving)
    width = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(width, "bucket", "tile", "lane").sortWithinPartitions("bucket", "tile", "lane", "side").mapInArrow(run, "a long, b long, similarity double")
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(classes, links): (doc_id, class_id) for every row of ``docs``, and verified links (a, b, similarity) between different texts that make up the classes."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(content).alias("text"))
    idf = inverse_frequencies(*document_frequencies(docs))
    sigs = written(signatures(docs, idf), "near-dup-signatures")
    known = sigs.filter(F.col("doc_id").isNotNull())
    # exact copies: few groups have more than one member, and only those are joined back
    copies = known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    members = written(salted_left_join(known.select("doc_id", "key"), copies, "key", F.col("doc_id")).select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct(), "near-dup-copies")
    same = members.filter("rep <> doc_id")
    nodes = sigs.join(same.select("doc_id"), "doc_id", "left_anti").filter(F.col("doc_id").isNotNull())

    placed = nodes.select("doc_id", F.explode("buckets").alias("bucket"))
    leaders = placed.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_members")).filter("leader < last").drop("last")
    leaders = written(leaders, "near-dup-leaders")
    shared = written(split_join(placed, leaders, "bucket", F.col("doc_id"), rows="n_members").select("bucket", "leader", "doc_id", "n_members"), "near-dup-buckets")
    pairs = shared.filter("leader < doc_id").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n_members").alias("n"))
    pairs = written(pairs, "near-dup-pairs")

    involved = shared.select("doc_id").distinct()
    texts = docs.filter(F.col("doc_id").isNotNull()).join(involved, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    texts = written(texts, "near-dup-texts")
    links = written(verified(pairs, texts, idf, least), "near-dup-links")
    classes = components(links.select("a", "b"))

    more = written(rest_links(classed(shared, classes), texts, idf, least), "near-dup-links")
    if not more.isEmpty():
        links = links.union(more)
        classes = merged(classes, more)

    # ids that repeat may tie several groups of copies together
    ties = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
    tied = ties.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("z")).filter("a < z")
    if not tied.isEmpty():
        classes = components(links.select("a", "b").union(ties))
    first = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    of = first.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("class", "rep").alias("class_id"))
    return docs.select("doc_id").join(of, "doc_id", "left"), links


def keep_one(docs: DataFrame, doc_id: str = "doc_id", content: str = "text", least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` without those whose class has a smaller id; rows with a null id stay."""
    classes, _ = near_duplicates(docs, doc_id, content, least)
    gone = classes.filter("class_id < doc_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
