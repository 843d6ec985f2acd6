import re
from collections import Counter

import numpy as np

from tests.llm.edge import documents, empty, frame
from thresher.llm import linking
from thresher.llm.linking import connected_components
from thresher.llm.neardup import MinHash, most_differing, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent=80):
    last = 1 << 62
    sets = [(d if d is not None else last, shingles(t, n)) for d, t, *_ in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    shown = lambda d: None if d == last else d
    return Counter((shown(d), len(s), shown(find(d) if s else d), find(d) == d if s else True) for d, s in sets)


def edited(rng, base, n, edits, first_id):
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.integers(0, edits)):
            words[rng.integers(0, len(words))] = f"e{rng.integers(0, 10 ** 6)}"
        out.append((first_id + i, " ".join(words), None, None, 0))
    return out


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(linking, "TILE", 8)
    rng = np.random.default_rng(5)
    rows = documents(seed=1)
    # a chain and groups that straddle the threshold, far from any common centre
    for g, length in enumerate((40, 90, 200)):
        rows += edited(rng, [f"g{g}w{i}" for i in range(length)], 40, length // 9, 1000 * (g + 1))
    chain = [f"c{i}" for i in range(200)]
    rows += [(5000 + i, " ".join(chain[2 * i:2 * i + 80]), None, None, 0) for i in range(30)]
    got = near_duplicates(frame(spark, rows), shingle=4).collect()
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert found == brute(rows, 4)
    assert len({r.component_id for r in got}) < len(got) - 60


def test_repeated_and_null_ids_with_near_copies(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(12):             # two texts under one id, each with a near copy under another
        shared, near_one, near_two = None if g > 9 else 10 * g + 7, 10 * g + 4, 10 * g + 9
        for t, near in enumerate((near_one, near_two)):
            base = [f"g{g}t{t}w{i}" for i in range(40 + 30 * rng.integers(0, 4))]
            copy = list(base)
            copy[rng.integers(0, len(copy))] = "edited"
            rows += [(d, " ".join(x), None, None, 0) for d, x in ((shared, base), (near, copy))]
    rows += [rows[0], rows[-2], (None, "", None, None, 0), (7, None, None, None, 0)]
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept)
                    for r in near_duplicates(frame(spark, rows), shingle=4).collect())
    assert found == brute(rows, 4)


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root if x not in alone}


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    minhash = MinHash(36, 5, 1024)
    for share in (0.8, 0.9, 1.0):
        common = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        own = int(900 * (1 - share) / (2 * share))
        sets = [np.append(common, rng.integers(0, 1 << 63, own, dtype=np.uint64)) for _ in range(2)]
        a, b = minhash.odd_sketches(minhash.samples(sets))
        bits = int(np.bitwise_count(a ^ b).sum())
        estimate = 1 + 1024 / 2 * np.log(1 - 2 * bits / 1024) / (2 * 180)
        assert abs(estimate - share) < 0.1
        assert bits <= most_differing(1024, 180, 0.66)


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_small_buckets_are_dealt_once_and_all_pairs_found(spark):
    from thresher.llm.linking import _dealt, _tiled_pairs
    # bucket 1 is one tile, bucket 2 two by two; node n is close to n + 1 only if n is even
    rows = [(key, n, 10, [n // 2 * 7919], n if n else 0, 10, 0, count, count - 1)
            for key, count in ((1, 6), (2, 1500)) for n in range(count)]
    rows = spark.createDataFrame(rows, "key long, node long, size long, bits array<long>, root long, shared long,"
                                 " main long, rows long, outside long")
    assert _dealt(rows.where("key = 1")).count() == 6
    for key, count in ((1, 6), (2, 1500)):
        got = _tiled_pairs(rows.where(f"key = {key}"), 0, 0, 80, None, None).distinct()
        assert {tuple(r) for r in got.collect()} == {(n, n + 1) for n in range(0, count, 2)}


def test_links_do_not_depend_on_the_nearest_round(spark, monkeypatch):
    from pyspark.sql import functions as F
    from thresher.llm import linking
    rng = np.random.default_rng(3)
    members = spark.createDataFrame([(int(k), int(n)) for n in range(120) for k in set(rng.integers(0, 12, 3))],
                                    "key long, node long")
    traits = spark.createDataFrame([(n, 10, [int(rng.integers(0, 16))]) for n in range(120)],
                                   "node long, size long, bits array<long>")
    asked = []

    def confirm(pairs):
        asked.append(1)
        return pairs.where((F.col("a") + F.col("b")) % 5 != 0)
    found = []
    for few, sliced in ((0, linking.SLICED_ROWS), (linking.FEW_PAIRS, linking.SLICED_ROWS), (0, 1)):
        monkeypatch.setattr(linking, "FEW_PAIRS", few)
        monkeypatch.setattr(linking, "SLICED_ROWS", sliced)
        asked.clear()
        groups = linking.linked_groups(members, traits, confirm, 1, 80)
        found.append(({tuple(r) for r in groups.collect()}, len(asked)))
    assert found[0][0] == found[1][0] == found[2][0] and [n for _, n in found] == [3, 2, 3]
