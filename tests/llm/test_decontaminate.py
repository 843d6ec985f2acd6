import re

import numpy as np

from tests.llm.edge import documents, empty, frame
from thresher.llm.decontaminate import benchmark_overlaps

ITEMS = "item_id long, text string, h string, tokens string, at long"


def tokens(text):
    plain = [re.sub(r"[\W_]+", "", w.lower()) for w in re.split(r"[\x20\x09-\x0D]+", text or "")]
    return [w for w in plain if w]


def brute(rows, items):
    first_item = {}
    for i, text in items:
        if text is not None:
            first_item[text] = min(first_item.get(text, i), i)
    out = {}
    for text, item in first_item.items():
        b = tokens(text)
        w = min(16, len(b))
        if w < 8:
            continue
        for doc, t, *_ in rows:
            a = tokens(t)
            for i in range(len(a) - w + 1):
                for j in range(len(b) - w + 1):
                    equal = sum(x == y for x, y in zip(a[i:i + w], b[j:j + w]))
                    if equal >= w - (w // 4 - 2):
                        lo, hi, most = out.get((doc, item), (i, i + w, 0))
                        out[doc, item] = (min(lo, i), max(hi, i + w), max(most, equal))
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_against_all_alignments(spark):
    rng = np.random.default_rng(4)
    rows = [r for r in documents(seed=2, n=40) if len(r[1] or "") < 5000]
    items = [(i, " ".join(f"b{x}" for x in rng.integers(0, 500, n)))
             for i, n in enumerate([5, 7, 8, 9, 11, 12, 13, 15, 16, 17, 25, 40])]
    for n, (i, text) in enumerate(items * 6):
        words = text.split()
        for _ in range(n // 12):
            words[rng.integers(0, len(words))] = "sub"
        cut = words[rng.integers(0, 3):len(words) - rng.integers(0, 3)] if n % 2 else words
        rows.append((500 + n, "Before, it " + ", ".join(cut).title() + " -- after", None, None, 0))
    rows += [(900, "a b " * 300, None, None, 0), rows[-1]]
    items += [(50, items[9][1]), (3, None), (51, ""), (52, "a b " * 20)]
    df = spark.createDataFrame([(*i, "h", "t", 1) for i in items], ITEMS)
    got = benchmark_overlaps(frame(spark, rows), df).collect()
    expected = brute(rows, items)
    assert sorted(map(tuple, got), key=str) == expected
    assert len(expected) > 20
    assert benchmark_overlaps(empty(spark), df).count() == 0
    assert benchmark_overlaps(frame(spark, rows), df.limit(0)).count() == 0
