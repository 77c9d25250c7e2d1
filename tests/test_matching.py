"""The token join against all pairs written out, with common tokens folded."""

import math

import numpy as np
import pytest

from meridia.operators import matching

WORDS = ["alpha", "study", "model", "learning", "visual", "corpus", "graph", "token", "robust", "sparse", "kernel", "neural"]


def tables(spark, n=60, m=80):
    rng = np.random.default_rng(4)
    weights = np.array([8, 6, 5, 3, 2, 2, 1, 1, 1, 1, 1, 1], float)
    pick = lambda k: " ".join(rng.choice(WORDS, k, replace=False, p=weights / weights.sum()))
    names = ["smith", "li", "oz", "", None]
    left = [(i, f"{rng.choice(names[:3]) if i % 3 else ''}{pick(int(rng.integers(1, 5)))} {2018 + i % 4 if i % 2 else ''}") for i in range(n)] + [(900, None), (901, "")]
    right = [(100 + j, pick(int(rng.integers(1, 6))), str(2018 + j % 4) if j % 5 else None, names[j % 5]) for j in range(m)] + [(990, None, None, None)]
    return left, right, spark.createDataFrame(left, "l long, t string"), spark.createDataFrame(right, "r long, t string, y string, a string")


@pytest.mark.parametrize("common", [0, 3, 25, 1000])
@pytest.mark.parametrize("author", [True, False])
def test_best_matches_equal_all_pairs(spark, common, author):
    left, right, l, r = tables(spark)  # noqa: E741
    from pyspark.sql import functions as F

    from meridia.functions.text import first_year, title_tokens

    lk = {x.l: x for x in l.select("l", F.lower("t").alias("t"), title_tokens(F.col("t")).alias("k"), first_year(F.col("t")).alias("y")).collect()}
    rk = {x.r: x for x in r.select("r", title_tokens(F.col("t")).alias("k"), "y", F.lower("a").alias("a")).collect()}
    want = {}
    for i, a in lk.items():
        best = None
        for j, b in sorted(rk.items()):
            both = len(set(a.k or []) & set(b.k or []))
            if both:
                score = both / (len(a.k) + len(b.k) - both) + 0.2 * (a.y is not None and a.y == b.y) + 0.2 * (author and bool(b.a) and b.a in a.t)
                if best is None or round(score, 12) > round(best[1], 12):
                    best = (j, score, both)
        if best and (best[1] >= 0.15 and best[2] >= 2 or best[1] >= 0.1):
            want[i] = best
    got = {x.l: (x.match_id, x.score, x.shared) for x in matching.fuzzy_best_match(l, r, "l", "t", "r", "t", "y", "a" if author else None, common=common).collect()}
    assert set(got) == set(want)
    for i, (j, score, both) in want.items():
        assert got[i][0] == j and math.isclose(got[i][1], score, abs_tol=1e-12), (i, got[i], want[i])
        assert got[i][2] == both
