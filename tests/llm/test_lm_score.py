import math
import random
import re
from collections import Counter

import pytest

from tombolo.llm import lm_score

SCHEMA = "doc_id long, text string, score string"


def brute(texts, order):
    split = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(w, n) for w in split), Counter()) for n in range(1, order + 1)]
    words = sum(map(len, split))
    out = []
    for w in split:
        own = [grams(w, n) for n in range(1, order + 1)]
        c = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        s = 0.0
        for i in range(len(w)):
            n, factor = min(order, i + 1), 1.0
            while n > 1 and c(tuple(w[i - n + 1 : i + 1])) <= 0:
                n, factor = n - 1, factor * lm_score.BACKOFF
            g = tuple(w[i - n + 1 : i + 1])
            s += math.log(factor * (c(g) / c(g[:-1]) if n > 1 else max(1, c(g)) / max(1, words - len(w))))
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_brute_force(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefg é Ж x9".split()) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    texts += [None, "", "only once here", texts[0], texts[0], "the " * 2000]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for scored in (lm_score.scores(frame, order=order, size=50), lm_score.relational_scores(frame, order=order)):
        got = {r["doc_id"]: r for r in scored.collect()}
        assert len(got) == len(texts)
        for i, (n, s) in enumerate(brute(texts, order)):
            assert got[i]["n_words"] == n
            assert got[i]["log_sum"] == pytest.approx(s, abs=1e-6)
            assert got[i]["score"] == pytest.approx(s / max(n, 1), abs=1e-6)


def test_empty_table_and_lone_document(spark):
    assert lm_score.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = lm_score.scores(spark.createDataFrame([(None, "a b", "")], SCHEMA)).collect()
    assert r["doc_id"] is None and r["n_words"] == 2
