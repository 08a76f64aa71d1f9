import math
import random

import pytest
from pyspark.sql import functions as F

from tombolo.llm import topk

SCHEMA = "vec_id long, embedding array<double>, id string, q string"


def brute(rows, k):
    """Scores of Python's own integers; a repeated id asks once, with its smallest vector."""
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(topk.SCALE * x) if abs(x) < 1e300 else int(x) * topk.SCALE for x in v]) for i, v in good]
    asked = {}
    for (i, v), (_, w) in zip(good, whole, strict=True):
        if i % 50 == 0 and (i not in asked or v < asked[i][0]):
            asked[i] = v, w
    out = []
    for i, (_, a) in asked.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in whole if j != i and len(a) == len(b))[:k]
        cut = lambda s: max(min(s, 2**63 - 1), -(2**63))
        out += [(i, n + 1, j, cut(-s)) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "clash", "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("block", [topk.BLOCK, 130])
def test_blocks_ties_repeats_and_lengths_against_brute_force(spark, block):
    rng = random.Random(3)
    # few different components, so that scores tie
    rows = [(i, [rng.choice((-1.0, -0.25, 0.0, 0.5, 1.0)) for _ in range(24)]) for i in range(700)]
    rows += [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(700, 900)]
    rows += [(100, [9.0] * 24), (100, [-9.0] * 24), (101, [9.0] * 24), (150, [1.0]), (151, [2.0]), (200, []), (201, [])]
    rows += [(None, [99.0] * 24), (902, None), (903, [None] * 24), (904, [math.nan] * 24), (905, [math.inf] * 24)]
    assert found(spark, rows, block=block) == brute(rows, topk.K)


def test_numbers_beyond_exact_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice((1e7, 3e6, -1e6)) * rng.random() for _ in range(8)]) for i in range(120)] + [(50, [2e17, 3.0]), (51, [1.0, 5.0]), (52, [1.0, 6.0]), (53, [1e300, 0.0])]
    assert found(spark, rows, block=40) == brute(rows, topk.K)


def test_fewer_candidates_than_asked_for(spark):
    assert found(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []
