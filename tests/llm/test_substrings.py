import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.edge import documents, empty, frame
from thresher.llm import substrings
from thresher.llm.substrings import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    split = [(d if d is not None else 1 << 62, WORD.findall(t or "")) for d, t, *_ in rows]
    for doc, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    out = []
    for (doc, words), (d, *_) in zip(split, rows):
        gone = {j for i in range(len(words) - window + 1) if first[tuple(words[i:i + window])] < (doc, i)
                for j in range(i, i + window)}
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window,seed,batch", [(20, 10, 1 << 23), (6, 3, 2000)])
def test_against_all_windows(spark, monkeypatch, window, seed, batch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    rows = documents(seed=window, n=90)
    rng = np.random.default_rng(3)
    rows += [(200 + i, " ".join(f"v{x}" for x in rng.integers(0, 2, 150)), None, None, 0) for i in range(3)]
    got = dedup_substrings(frame(spark, rows), window=window, seed=seed).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, window)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    assert sum(r.n_removed for r in got) > 100


def test_empty_table(spark):
    assert dedup_substrings(empty(spark)).count() == 0
