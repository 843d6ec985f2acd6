import math

import numpy as np

from thresher.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>, label int, v string, shard int"


def brute(rows, k, every):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in kept if i % every == 0}):
        own = min(v for i, v in kept if i == q)
        scored = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(own, v)))), i)
                        for i, v in kept if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "v", 2) for r in rows], SCHEMA)
    return sorted(map(tuple, top_k(df, **options).select("query_id", "rank", "vec_id", "score").collect()))


def test_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 190)]                      # ties
    rows += [(200, None), (201, [1.0, None]), (250, [float("nan")] * 8), (300, [float("inf")] * 8),
             (None, rows[0][1]), (400, []), (401, [1.0, 2.0]), rows[50], rows[7]]
    expected = brute(rows, 5, 10)
    assert run(spark, rows, query_every=10) == expected
    assert run(spark, rows, query_every=10, shard_rows=16, block_queries=4, fan_in=2) == expected


def test_large_components_few_rows_and_no_rows(spark):
    rows = [(0, [1e13, 1.0]), (1, [1e13, -3.0]), (2, [-1e13, 5.0]), (3, [3.0, 0.25])]
    assert run(spark, rows, query_every=1) == brute(rows, 5, 1)
    assert run(spark, []) == []
