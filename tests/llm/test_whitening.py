import math
from collections import defaultdict

import numpy as np

from thresher.llm.whitening import eigenvalues_above, top_eigenpairs, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, x string, id int, n int, component string"


def run(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "c") for r in rows], SCHEMA).repartition(parts)
    found = whiten(df, **options)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return sorted(found.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["deviation"], r["component"]))


def brute(rows, k):
    """Kept rows, exact deviations, numpy's components of the covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 2 ** 52 for c in v)]
    d = max(len(v) for _, v in kept)
    x = [[math.floor(1024 * c) + 100000 for c in [*v, *[0.0] * (d - len(v))]] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(r, s)] for r in x]
    z = np.array([[float(a) / n for a in r] for r in y])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return ([i for i, _ in kept], n, [sum(a * a for a in r) for r in y], z @ vectors / np.sqrt(values),
            values / np.trace(z.T @ z / n))


def compare(spark, rows, k):
    ids, n, deviation, white, explained = brute(rows, k)
    found = run(spark, rows, components=k)
    assert len(found) == len(ids) * k
    places = defaultdict(list)          # equal rows are compared as often as they stand there
    for j, (i, v) in enumerate(zip(ids, deviation)):
        places[i, v].append(j)
    for (i, v), equal in places.items():
        mine = [r for r in found if (r["vec_id"], r["deviation"]) == (i, v)]
        assert [r["component"] for r in mine] == [c for c in range(1, k + 1) for _ in equal]
        assert {r["n"] for r in mine} == {n}
        for r in mine:
            c = r["component"] - 1
            assert math.isclose(abs(r["whitened"]), abs(white[equal[0], c]), abs_tol=1e-9)
            assert math.isclose(r["explained"], explained[c], rel_tol=1e-9)
    errors = {r["identity_error"] for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=12) * np.linspace(3, 0.3, 12)).tolist()) for i in range(150)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, [None] * 12), (902, [math.nan] * 12), (903, [math.inf] * 12), (904, [1e300] * 12)]
    compare(spark, rows, 8)


def test_large_entries_and_short_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(0, 4)).tolist()) for i in range(60)]
    rows += [(70, [1.0]), (71, []), (72, [-0.001] * 6)]
    compare(spark, rows, 4)


def test_same_covariance_however_rows_are_dealt(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(80)]
    plain = [[(r["vec_id"], r["whitened"], r["explained"]) for r in run(spark, rows, parts)] for parts in (1, 7)]
    assert np.allclose([r[1] for r in plain[0]], [r[1] for r in plain[1]], atol=0, rtol=1e-12)


def test_nothing_to_whiten(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []
    assert run(spark, [(1, [2.0, 3.0])] * 4) == []
    flat = run(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])      # rank one
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] > 0.999999


def test_beyond_a_long(spark):
    rows = [(i, [float(i) * 2 ** 40, 0.0]) for i in range(4)]
    assert {r["deviation"] for r in run(spark, rows)} == {2 ** 63 - 1}


def test_eigenpairs_and_inertia():
    rng = np.random.default_rng(3)
    for d, rank in ((3, 3), (20, 20), (40, 40), (50, 5)):
        m = rng.normal(size=(d, rank)) * np.geomspace(1, 30, rank)
        v = m @ m.T
        if d == 20:     # repeated eigenvalues
            q = np.linalg.qr(v)[0]
            v = q @ np.diag([5.0] * 6 + [4.0] * 6 + [1.0] * 8) @ q.T
        values, vectors = top_eigenpairs((v + v.T) / 2, 8)
        true = np.linalg.eigvalsh(v)
        assert len(values) == min(8, rank)
        assert np.allclose(values, true[::-1][:len(values)], rtol=1e-12)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
        assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * values[0]
        for shift in rng.uniform(-1, true[-1] * 1.1, 10):
            assert eigenvalues_above(v, shift) == (true > shift).sum()
