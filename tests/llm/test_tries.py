import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from thresher.llm import tries
from thresher.llm.tries import numbered_turns, prefix_trie, share_heads

# the extra columns carry names that the operator uses inside
SCHEMA = "conv_id long, turn long, role string, text string, pos int, key string, chunk int, at string, xa long"
WORDS = "\x20\t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "at", 3) for r in rows], SCHEMA).repartition(3)


def n_words(text):
    for c in WORDS:
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def conversations(rows):
    """conv_id -> turns in the documented order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5((hashlib.md5(role.encode()).hexdigest()
                               + hashlib.md5(text.encode()).hexdigest()).encode()).hexdigest()
            out[conv].append(((turn is not None, turn or 0, key), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in out.items()}


def shared(convs, every=20, most=4):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = (len(members[node]) - 1) * n_words(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(kids[node]),
                   leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node)).encode()).hexdigest())
                  for node, m in members.items())


def run(spark, rows, share=False):
    turns = numbered_turns(frame(spark, rows))
    ids = turns.select("conv_id").distinct()
    found = prefix_trie(share_heads(turns, ids) if share else turns, ids).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"],
                   r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found)


def edge_rows():
    rng = np.random.default_rng(0)
    rows = []
    for c in range(70):
        for t in range(rng.integers(0, 7)):
            rows.append((c, t, ["user", "assistant", None][rng.integers(0, 3)], ["a b", "c", "", None, "x\ty z "][rng.integers(0, 5)]))
    rows += [(200 + c, t, "u", "same start") for c in range(30) for t in range(c % 9)]      # one path, many ends
    rows += [(300 + c, t, "u", "copy") for c in range(25) for t in range(4)]                # exact copies
    rows += [(400, None, "u", "null turn"), (400, 1, "u", "later"), (400, 1, "u", "later"), (400, 1, None, "tie"),
             (None, 1, "u", "no conversation"), (420, 0, "u", "long " * 30_000), (-7, 0, "u", "negative"),
             (421, 5, "u|", "x"), (422, 5, "u", "|x"), (440, 1, "u", "Ünï   x")]
    return rows


def test_against_all_prefixes(spark):
    assert run(spark, edge_rows()) == brute(conversations(edge_rows()))


@pytest.mark.parametrize("chunk", [1, 4])
def test_pieces_of_few_turns(spark, monkeypatch, chunk):
    """Conversations of many pieces, ends at and beside the borders, three levels of sums."""
    monkeypatch.setattr(tries, "CHUNK", chunk)
    monkeypatch.setattr(tries, "SUPER", 2)
    rows = [(c, t, "u", f"turn {min(t, 3 * c)}") for c in range(8) for t in range(4 * (c % 4) + c % 3 + 4)]
    assert run(spark, rows) == brute(conversations(rows))


def test_shared_heads(spark):
    rows = [(c, t, "u", f"{c} {t}") for c in [*range(45), 61, 62, 63, 80, -3, -21, -20, 0]
            for t in range(abs(c) % 6)] + [(60, 0, "u", "one turn"), (80, 9, None, None)]
    assert run(spark, rows, share=True) == brute(shared(conversations(rows)))


def test_a_long_conversation_and_a_deep_comb(spark):
    rows = [(1, t, "u", f"w {t}") for t in range(700)] + [(2, t, "u", f"w {t}") for t in range(600)]
    rows += [(10 + c, t, "u", f"w {t}" if t < c else f"off {c}") for c in range(1, 40) for t in range(c + 1)]
    assert run(spark, rows) == brute(conversations(rows))


def test_empty_and_turnless(spark):
    assert run(spark, []) == []
    turns = numbered_turns(frame(spark, []))
    only = spark.createDataFrame([(4,), (2,)], "conv_id long")
    root = prefix_trie(turns, only).collect()
    assert [tuple(r) for r in root] == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]
