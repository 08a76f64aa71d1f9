"""Exact top-k search by inner product, with columnar branch and bound.

Vectors become integers, floor(256 x), and lie in blocks, one row of the block
per dimension. A task holds one block of candidates and takes the queries block
by block. It adds up scores some dimensions at a time; after each step the
largest score that a candidate can still reach, its sum so far plus the product
of what the query's and its own remaining dimensions weigh (Cauchy-Schwarz), is
compared with the query's k-th best score known, and the candidates that fall
short are dropped, the rest moved together. The dimensions that weigh most in
the block come first. Candidates equal to the bound stay, so ties are exact.

Queries are a stated share of the rows and are dealt to all candidate blocks;
every block returns at most k rows per query, and the best k of those are the
answer. No block or set of queries reaches the driver.

Defined results: a null vector or one with a null or non-finite component takes
no part; neither does a row whose id is null; vectors of different lengths are
not compared; an id that repeats is a candidate as often as it stands, but a
query once, with the smallest of its vectors, and never a candidate of its own
query; fewer than k candidates give fewer rows; an empty table gives an empty
result; other columns are ignored. Scores beyond 64 bits are cut to the nearest that fits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, K = 256, 5
#: Dimensions added between two tests.
STEP = 16
#: Vectors of a candidate block, at most and at least, and queries taken at once.
BLOCK, LEAST, QUERIES = 65_536, 512, 256
_LIMIT = (-(1 << 63), (1 << 63) - 1)


def by_length(ids: np.ndarray, vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vector: the ids and the vectors as rows."""
    lengths, values = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
    begin = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths):
        mine = np.flatnonzero(lengths == n)
        out[int(n)] = ids[mine], values[begin[mine, None] + np.arange(n)]
    return out


def scaled(rows: np.ndarray) -> np.ndarray:
    """floor(256 x) as rows of float64 where all products stay exact, else of Python's integers."""
    x = np.floor(rows * SCALE)
    top = np.abs(x).max(initial=0)
    if top * top * max(1, x.shape[1]) < 2**52 and np.isfinite(top):
        return x
    return np.array([[math.floor(SCALE * v) if math.isfinite(SCALE * v) else int(v) * SCALE for v in r] for r in rows.tolist()], object).reshape(len(rows), -1)


class Block:
    """Candidates in vertical layout: ``columns[d]`` has dimension ``d`` of all of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        self.exact = rows.dtype == object
        weight = (rows.astype(np.float64) ** 2).sum(0) if len(rows) else np.zeros(rows.shape[1])
        self.order = np.argsort(-weight, kind="stable")
        self.columns = np.ascontiguousarray(rows[:, self.order].T)
        # what each candidate's dimensions from d on weigh, for the steps' ends
        self.edges = [*range(0, rows.shape[1], STEP), rows.shape[1]]
        squares = self.columns.astype(np.float64) ** 2
        total = np.zeros(len(ids))
        self.rest = [total]
        for a, b in reversed(list(zip(self.edges, self.edges[1:], strict=False))):
            total = total + squares[a:b].sum(0)
            self.rest.append(total)
        self.rest = [np.sqrt(r) for r in reversed(self.rest)]
        self.tested = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(query id, its best (score, id) here) for each query, best first, ties to smaller ids."""
        if not len(self.ids):
            return
        if self.exact or queries.dtype == object:
            for q, row in zip(query_ids, queries.astype(object), strict=True):
                scores = [int(s) for s in row[self.order] @ self.columns.astype(object)] if len(row) else [0] * len(self.ids)
                yield q, sorted(((s, i) for s, i in zip(scores, self.ids.tolist(), strict=True) if i != q), key=lambda x: (-x[0], x[1]))[:k]
            return
        queries = queries[:, self.order]
        first = self.edges[1] if len(self.edges) > 1 else 0
        partial = queries[:, :first] @ self.columns[:first]  # of all queries at once
        weights = np.sqrt(np.stack([(queries[:, e:] ** 2).sum(1) for e in self.edges], 1)) * (1 + 1e-9)
        for n, (q, row) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
            sums, at = partial[n], np.arange(len(self.ids))
            own = np.flatnonzero(self.ids == q)
            # exact scores of the candidates that lead so far bound the k-th best from below
            lead = sums.argpartition(-min(len(sums), k + len(own)))[-(k + len(own)) :] if len(sums) > k + len(own) else at
            lead = lead[self.ids[lead] != q]
            known = np.sort(row @ self.columns[:, lead])[::-1] if len(lead) else np.zeros(0)
            least = known[k - 1] if len(known) >= k else -math.inf
            for step in range(1, len(self.edges) - 1 if len(self.edges) > 1 else 0):
                most = sums + weights[n, step] * self.rest[step][at] * (1 + 1e-9) + 1e-6
                keep = most >= least
                if not keep.all():
                    sums, at = sums[keep], at[keep]
                a, b = self.edges[step], self.edges[step + 1]
                self.tested += len(at) * (b - a)
                sums = sums + row[a:b] @ (self.columns[a:b] if len(at) == len(self.ids) else self.columns[a:b, at])
            other = self.ids[at] != q
            sums, ids = sums[other], self.ids[at][other]
            if len(sums) > k:
                edge = np.partition(sums, -k)[-k]
                sums, ids = sums[sums >= edge], ids[sums >= edge]
            best = np.lexsort((ids, -sums))[:k]
            yield q, [(int(sums[b]), int(ids[b])) for b in best]


def _valid(vector: str) -> Column:
    return F.expr(f"`{vector}` IS NOT NULL AND forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query, among all rows but those of its own id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & _valid("v"))
    n, cores = rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    # small tables are dealt to all cores, but never in blocks too small to be worth a look at each query
    n_blocks = max(1, -(-n // block), min(4 * cores, -(-n // LEAST)))
    candidates = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(False).alias("q"), "id", "v")
    queries = rows.filter("q").groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("q"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks = [], None  # rows come sorted by block, then candidates before queries
        current = None

        def answers(ids: np.ndarray, vectors: pa.ListArray) -> list[tuple[int, int, int]]:
            out = []
            for n, (own, rows) in by_length(ids, vectors).items():
                if n in blocks:
                    out += [(q, i, s) for q, found in blocks[n].search(own, scaled(rows), k) for s, i in found]
            return out

        def built() -> dict[int, Block]:
            parts: dict[int, list] = {}
            for ids, vectors in held:
                for n, x in by_length(ids, vectors).items():
                    parts.setdefault(n, []).append(x)
            return {n: Block(np.concatenate([i for i, _ in x]), scaled(np.concatenate([v for _, v in x]))) for n, x in parts.items()}

        for batch in batches:
            block_of, is_q = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(block_of) != 0) | (np.diff(is_q.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if block_of[a] != current:
                    current, held, blocks = block_of[a], [], None
                if not is_q[a]:
                    held.append((part.column(2).to_numpy(), part.column(3)))
                    continue
                if blocks is None:
                    blocks, held = built(), []
                for at in range(0, part.num_rows, QUERIES):
                    some = part.slice(at, QUERIES)
                    found = answers(some.column(2).to_numpy(), some.column(3))
                    if found:
                        q, i, s = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array([min(max(x, _LIMIT[0]), _LIMIT[1]) for x in s], pa.int64())], ["query_id", "vec_id", "score"])

    dealt = candidates.unionByName(queries).repartition(n_blocks, "block").sortWithinPartitions("block", "q")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
