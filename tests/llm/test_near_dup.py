import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tombolo.llm import common
from tombolo.llm import near_dup as nd

SCHEMA = "doc_id long, text string, class_id string"


def brute(texts):
    """The smallest id of each text's component over all pairs of similarity 0.8 or more."""
    bags = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df, n = Counter(g for b in bags for g in b), len(texts)
    weight = {g: 1 + math.log((1 + n) / (1 + df[g])) / math.log(1 + n) for g in df}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = bags[i], bags[j]
        both = sum(min(a[g], b[g]) * weight[g] for g in a.keys() & b.keys())
        either = sum(max(a[g], b[g]) * weight[g] for g in a.keys() | b.keys())
        if (texts[i] or "") == (texts[j] or "") or either and both / either >= 0.8:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def corpus(seed, base=400):
    """Copies, near copies, a chain whose ends differ, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    out = [" ".join(text(rng.randint(1, 120))) for _ in range(base)]
    hot = text(300)
    out += [" ".join(edited(rng, hot, rng.choice([1, 2, 3, 9]))) for _ in range(150)]
    link = text(400)
    for _ in range(12):
        out.append(" ".join(link))
        link = edited(rng, link, 4)
    out += [out[3]] * 40 + [None, "", " ... ", "one two", "one two", "One, TWO!"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("tile, followers, hot", [(256, nd.FOLLOWERS, common.HOT_ROWS), (16, 20, 30)])
def test_classes_against_brute_force(spark, monkeypatch, tile, followers, hot):
    monkeypatch.setattr(nd.rest_links, "__defaults__", (nd.SIMILAR, tile))
    monkeypatch.setattr(nd.verified, "__defaults__", (nd.SIMILAR, followers))
    monkeypatch.setattr(common.split_join, "__defaults__", (*common.split_join.__defaults__[:-1], hot))
    texts = corpus(1)
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    classes, links = nd.near_duplicates(frame)
    got = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert len(got) == len(texts)
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert all(r["similarity"] >= 0.8 and r["a"] < r["b"] for r in links.collect())


def test_links_between_classes_merge_them(spark):
    classes = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8)], "id long, class long")
    links = spark.createDataFrame([(2, 6), (3, 8), (9, 10)], "a long, b long")
    got = {r["id"]: r["class"] for r in nd.merged(classes, links).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 3: 3, 8: 3, 9: 9, 10: 9}


def test_keep_one_keeps_columns_and_clean_documents(spark):
    texts = corpus(2, base=60)
    frame = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], SCHEMA)
    kept = nd.keep_one(frame).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(brute(texts)))
    assert kept[0].asDict().keys() == {"doc_id", "text", "class_id"}


def test_empty_table_null_and_repeated_ids(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA))[0].count() == 0
    text = "a b c d e f g h"
    rows = [(5, text, ""), (5, "quite another text of more words", ""), (None, text, ""), (7, text, ""), (9, "quite another text of more words", "")]
    classes, _ = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["doc_id"] or -1, r["class_id"]) for r in classes.collect()) == [(-1, None), (5, 5), (5, 5), (7, 5), (9, 5)]
    kept = nd.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 5, 5]


def planted(seed, make, pairs=40):
    """Texts in pairs ``make(rng, words)`` and what brute force says of them."""
    rng = random.Random(seed)
    texts = [" ".join(t) for _ in range(pairs) for t in make(lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)])]
    return texts, brute(texts)


def classes_of(spark, texts):
    classes, _ = nd.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA))
    got = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    return [got[i] for i in range(len(texts))]


def test_pairs_whose_weight_lies_in_repeated_lines(spark):
    def make(words):
        line = words(8) * 25
        return line + words(10), line + words(10)

    texts, expected = planted(3, make)
    assert expected == [i - i % 2 for i in range(len(texts))]
    assert classes_of(spark, texts) == expected


def test_members_of_a_tile_against_pairwise_similarity():
    rng, idf = random.Random(5), np.random.default_rng(5).uniform(1, 2, nd.CELLS).astype(np.float32)
    hot = [f"w{i}" for i in range(30)]
    texts = [" ".join(edited(rng, hot * rng.randint(1, 3), rng.randint(0, 6))) for _ in range(40)] + ["one two"]
    weighted = nd.Weighted(idf)
    own = [nd.shingles([t], weighted.hashes)[1:] for t in texts]
    rows = [{"doc_id": i, "class": i, "out": True, "hashes": h.tobytes(), "times": t.astype("<u4").tobytes()} for i, (h, t) in enumerate(own)]
    tile = nd.Tile(rows, idf, 0.8)
    for i, t in enumerate(texts):
        expected = [weighted.similarity(weighted.vector(t), weighted.vector(u)) for u in texts]
        np.testing.assert_allclose(tile.similarities(*tile._vector(rows[i])), expected, rtol=1e-12)


def test_short_texts_that_differ_by_a_word(spark):
    def make(words):
        text = words(10)
        return text, text + words(1)

    texts, expected = planted(4, make, 60)
    assert expected == [i - i % 2 for i in range(len(texts))]
    assert classes_of(spark, texts) == expected


@pytest.mark.parametrize("size, more", [(1, 0), (10, 1), (52, 3), (600, 40)])
def test_samples_agree_as_often_as_texts_are_similar(size, more):
    rng = random.Random(size)
    weighted = nd.Weighted(np.ones(nd.CELLS, np.float32))
    agree, similar = [], []
    for _ in range(60):
        text = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        pair = [" ".join(text), " ".join(text + [f"x{rng.randrange(10**6)}" for _ in range(more)])]
        owner, h, times = nd.shingles(pair, weighted.hashes)
        a, b = nd.samples(owner, h, times, np.ones(len(h), np.float32), 2)
        assert len({*a}) > 1 or size < 6
        agree.append((a == b).mean())
        similar.append(weighted.similarity(*map(weighted.vector, pair)))
    p = np.mean(similar)
    # mean and spread are those of independent samples
    assert abs(np.mean(agree) - p) < 5 * np.sqrt(p * (1 - p) / nd.SAMPLES / 60) + 1e-9
    assert np.std(agree) < 1.5 * np.sqrt(p * (1 - p) / nd.SAMPLES) + 1e-9


#: Words of a text, and words more in its near copy: similarity 0.8 or just above where whole shingles allow it.
EDITS = ((6, 0), (10, 1), (14, 2), (20, 4), (40, 9), (100, 24), (300, 74))


@pytest.mark.parametrize("size, more", EDITS)
def test_recall_of_near_pairs_by_length(size, more):
    """At least 99 in 100 of 500 pairs share a bucket, at every length."""
    rng, hashes, idf = random.Random(size), nd.WordHashes(), np.ones(nd.CELLS, np.float32)
    found = 0
    for _ in range(500):
        text = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        pair = [" ".join(text), ", ".join(text + [f"x{rng.randrange(10**6)}" for _ in range(more)])]
        owner, h, times = nd.shingles(pair, hashes)
        a, b = nd.buckets(nd.samples(owner, h, times, idf[nd._cell(h)], 2))
        found += bool((a == b).any())
    assert found >= 495


def test_a_split_join_gives_the_rows_of_a_join(spark):
    left = spark.range(1000).selectExpr("id", "if(id < 700, 7L, id % 5) AS lane")
    right = spark.createDataFrame([(7, "a", 700), (1, "b", 60), (9, "c", 0)], "lane long, lanes string, n long")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "lane", how).collect()), key=str)
        for rows in (None, "n"):
            got = common.split_join(left, right, "lane", common.F.col("id"), how, rows, 50)
            assert sorted(map(tuple, got.collect()), key=str) == want
