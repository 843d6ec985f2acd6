import numpy as np
import pytest

from corpus_pipeline import line_dedup
from thresher.llm.decontaminate import TokenHashes
from thresher.llm.lines import (FAR_WORDS, HELD, SIZE_BITS, dedup_lines, edit_distance, line_hashes, line_tokens, most_edits,
                                parity_sketches, partner_groups, simhashes, with_partner)
from thresher.llm.queries import op10_line_dedup

SCHEMA = "doc_id long, text string, node string, root int, key string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tokens_of(line, cache):
    return line_tokens([line.encode()], cache)[0]


def blocks_of(lines):
    """The 16-bit blocks of the lines' SimHashes, one row a line."""
    return simhashes(np.concatenate(lines), np.array(list(map(len, lines)))).view("<u2")


def brute(docs):
    """Removed line numbers per (id, text), by all pairs."""
    cache, first, blocks, size = TokenHashes(), {}, {}, {}
    places = []
    for doc, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            own = tokens_of(line, cache)
            if len(own):
                node = int(line_hashes(own, np.array([len(own)]))[0][0])
                place = (doc is None, doc or 0, n)
                places.append((place, node, text))
                first[node] = min(first.get(node, place), place)
                blocks[node], size[node] = blocks_of([own])[0], own
    nodes, root = sorted(first), {}
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            longest = max(len(size[a]), len(size[b]))
            if abs(len(size[a]) - len(size[b])) <= 0.1 * longest + 1e-9 and (blocks[a] == blocks[b]).any():
                if distance(size[a].tolist(), size[b].tolist()) <= 0.1 * longest + 1e-9:
                    root[find(a)] = find(b)
    keep = {}
    for place, node, _ in places:
        keep[find(node)] = min(keep.get(find(node), place), place)
    gone = {}
    for place, node, text_of in places:
        if keep[find(node)] != place:
            gone.setdefault((*place[:2], text_of), set()).add(place[2])
    return gone


@pytest.mark.parametrize("seed", range(20))
def test_edit_distance(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64)
    b = a.copy() if seed % 2 else rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64)
    for _ in range(seed % 4):
        b = np.insert(np.delete(b, rng.integers(0, max(1, len(b)))) if len(b) else b, 0, 7)
    true = distance(a.tolist(), b.tolist())
    for most in range(0, 30, 3):
        assert min(edit_distance(a, b, most), most + 1) == min(true, most + 1)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}" for i in range(60)]
    base = [list(rng.choice(vocabulary, rng.integers(3, 90))) for _ in range(25)]
    docs = []
    for doc in range(120):
        lines = []
        for _ in range(rng.integers(0, 6)):
            line = list(base[rng.integers(0, len(base))])
            for _ in range(rng.integers(0, 3)):
                line[rng.integers(0, len(line))] = str(rng.choice(vocabulary))
            lines.append(" ".join(line).title() + rng.choice(["", ".", "!", "  "]))
        docs.append((doc if doc % 40 else None, "\n".join(lines)))
    docs += [(7, None), (8, ""), (9, "\n\n"), (10, "a b"), (11, "a b"), docs[5], docs[5], (3, "x " * 20000)]
    expected = brute(docs)
    got = dedup_lines(spark.createDataFrame([(d, t, "n", 1, "k") for d, t in docs], SCHEMA)).collect()
    assert len(got) == len(docs)
    texts = {(d is None, d or 0, t) for d, t in docs}
    for row in got:
        same_id = (row.doc_id is None, row.doc_id or 0)
        source = [t for *i, t in texts if tuple(i) == same_id
                  and "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in row.removed) == (row.text or "")
                  and set(row.removed) == expected.get((*same_id, t), set()) and (t is None) == (row.text is None)]
        assert source, row
        assert row.n_lines == (0 if row.text is None else source[0].count("\n") + 1)
        assert row.n_removed == len(row.removed)
    assert sum(r.n_removed for r in got) >= sum(map(len, expected.values())) > 50


def edited(rng, line, edits):
    line = list(line)
    for kind in rng.integers(0, 3, edits):
        at = rng.integers(0, len(line))
        if kind == 0:
            line[at] = f"new{rng.integers(0, 10 ** 6)}"
        elif kind == 1:
            line.insert(at, f"new{rng.integers(0, 10 ** 6)}")
        else:
            del line[at]
    return line


def similar_pairs(seed, vocabulary):
    """Pairs of lines with as many edits as similarity 0.9 allows, spread over the line."""
    rng = np.random.default_rng(seed)
    for size in [*range(9, 70), 100, 150, 400] * 3:
        a = [f"v{i}" for i in rng.integers(0, vocabulary, size)]
        b = edited(rng, a, rng.integers(1, max(2, size // 10 + 1)))
        if distance(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9:
            yield a, b


@pytest.mark.parametrize("vocabulary", [3, 5000])
def test_sketches_of_similar_lines_are_close(vocabulary):
    cache = TokenHashes()
    for pair in similar_pairs(2, vocabulary):
        x, y = (line_hashes(own, np.array([len(own)]))[1][0] for own in (tokens_of(" ".join(p), cache) for p in pair))
        assert int(x ^ y).bit_count() <= 2 * most_edits(max(map(len, pair)), 0.9)
        x, y = parity_sketches([tokens_of(" ".join(p), cache) for p in pair])
        assert np.bitwise_count(x ^ y).sum() <= 2 * most_edits(max(map(len, pair)), 0.9)


@pytest.mark.parametrize("size", [9, 10, 12, 20, 30, 50, 100, 200, 400])
def test_recall_of_blocks_by_length(size):
    """Lines with as many edits as allowed share a block in at least nine cases of ten."""
    rng = np.random.default_rng(size)
    cache, pairs = TokenHashes(), []
    while len(pairs) < 400:
        a = [f"v{i}" for i in rng.integers(0, 5000, size)]
        b = edited(rng, a, max(1, size // 10))
        if distance_within(a, b):
            pairs.append((a, b))
    blocks = blocks_of([tokens_of(" ".join(x), cache) for pair in pairs for x in pair])
    assert (blocks[::2] == blocks[1::2]).any(1).mean() >= 0.9


def distance_within(a, b):
    most = most_edits(max(len(a), len(b)), 0.9)
    x, y = (np.array([hash(t) & 0xFFFFFFFF for t in line], np.uint32) for line in (a, b))
    return edit_distance(x, y, most) <= most


def test_similar_pairs_are_found(spark):
    pairs = list(similar_pairs(3, 5000))
    docs = [(i, " ".join(x), "n", 1, "k") for i, x in enumerate(x for pair in pairs for x in pair)]
    removed = {r.doc_id for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).where("n_removed = 1").collect()}
    assert len(pairs) > 100 and all(i % 2 for i in removed)
    assert len(removed) >= 0.95 * len(pairs)


@pytest.mark.parametrize("seed", range(6))
def test_edit_distance_of_long_lines(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 30, 300).astype(np.uint32)
    b = np.array(edited(rng, a.tolist(), 5 * seed * seed), dtype=object)
    b = np.array([int(str(t).removeprefix("new")) for t in b], np.uint32)
    true = distance(a.tolist(), b.tolist())
    for most in (17, 30, 60, 200):
        assert min(edit_distance(a, b, most), most + 1) == min(true, most + 1)


def test_edit_distance_of_a_very_long_line():
    a = np.random.default_rng(0).integers(0, 1 << 32, 300_000).astype(np.uint32)
    b = np.delete(a, [5, 100_000, 299_000])
    b[[7, 200_000]] = 1
    assert edit_distance(a, b, 30_000) == 5


def test_rows_with_a_partner():
    rng = np.random.default_rng(4)
    bucket, size = rng.integers(0, 40, 500), rng.integers(5, 60, 500)
    key = np.sort(bucket << SIZE_BITS | size)
    sketch = rng.integers(0, 1 << 6, 500).astype(np.uint64)
    found = with_partner(key, sketch, 0.9)
    for i in range(500):
        true = any(i != j and key[i] >> SIZE_BITS == key[j] >> SIZE_BITS
                   and 10 * min(s := int(key[i] & 0xFFFFF), t := int(key[j] & 0xFFFFF)) >= 9 * max(s, t)
                   and int(sketch[i] ^ sketch[j]).bit_count() <= 2 * most_edits(max(s, t), 0.9) for j in range(500))
        assert found[i] == true


def test_many_copies_of_one_template(spark):
    """More lines in a bucket than a task compares, spread over batches, and a pair beside them."""
    n = HELD + 2500
    base = " ".join(f"w{i}" for i in range(40))
    docs = [(i, f"{base} number{i}", "n", 1, "k") for i in range(n)]
    other = [f"z{i}" for i in range(30)]
    docs += [(n, " ".join(other), "n", 1, "k"), (n + 1, " ".join(other[:-1]), "n", 1, "k")]
    left = [r.doc_id for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).where("n_removed = 0").collect()]
    assert sorted(left) == [0, n]


def test_short_lines_count_in_query_and_pipeline(spark, tmp_path):
    docs = [(1, "Read more\n\nok", 0), (2, "read MORE!\n\nnew", 0), (3, "unspaced-line\nOK\n--", 0),
            (4, "UnspacedLine", 0), (5, "--\nx y", 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    removed = {r.doc_id: r.n_removed for r in op10_line_dedup(spark, str(tmp_path)).collect()}
    assert removed == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}
    kept = {r.doc_id: r.text for r in line_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == {1: "Read more\n\nok", 2: "\nnew", 3: "unspaced-line\n--", 5: "--\nx y"}


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wide_tables_are_gone_before_lines_are_linked(spark, monkeypatch):
    from pyspark.sql import functions as F
    from thresher.llm import lines
    written, deleted, seen = {}, set(), []

    def staged(df, name, old=lines.staged):
        out = old(df, name)
        written[name] = out
        return out

    def unstaged(table, old=lines.unstaged):
        deleted.update(name for name, out in written.items() if out is table)
        deleted.update("wide lines" for _ in [0] if "tokens" in table.columns and "doc" in table.columns)
        old(table)

    def linked(*arguments, old=lines.linked_groups, **options):
        seen.append(set(deleted))
        return old(*arguments, **options)
    for name, own in (("staged", staged), ("unstaged", unstaged), ("linked_groups", linked)):
        monkeypatch.setattr(lines, name, own)
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words), (2, words.replace("w7", "x")), (3, "one other line")],
                                 "doc_id long, text string")
    got = dedup_lines(docs).groupBy().agg(F.sum("n_removed")).first()[0]
    assert got == 1 and {"sketches", "wide lines"} <= seen[0]


def far_words(lines):
    """The words of the SimHashes that are compared in each round of blocks."""
    words = simhashes(np.concatenate(lines), np.array(list(map(len, lines))))
    return [words[:, [at, (at + 1) % words.shape[1]]] for at in range(0, words.shape[1], FAR_WORDS)]


@pytest.mark.parametrize("size", [48, 60, 100, 200, 400, 1000])
def test_long_lines_of_a_bucket_are_told_apart_by_their_simhashes(size):
    """Those that are not similar go; no pair with as many edits as allowed does."""
    rng = np.random.default_rng(size)
    cache, pairs = TokenHashes(), []
    while len(pairs) < 200:
        a = [f"v{i}" for i in rng.integers(0, 10 ** 7, size)]
        b = edited(rng, a, size // 10)
        if distance_within(a, b):
            pairs.append((a, b))
    tokens = [tokens_of(" ".join(x), cache) for pair in pairs for x in pair]
    sketch = np.zeros(2, np.uint64)
    for words in far_words(tokens):
        near = [with_partner(np.sort([len(tokens[i]), len(tokens[j])]), sketch, 0.9, words[[i, j]]).any()
                for i, j in ((2 * n, 2 * n + 1) for n in range(len(pairs)))]
        apart = [with_partner(np.array([size, size]), sketch, 0.9, words[[i, i + 2]]).any()
                 for i in range(0, len(tokens) - 2, 2)]
        assert all(near) and sum(apart) <= 3        # a chance of 3e-4 each


def test_pairs_of_one_bucket_that_have_nothing_in_common_part():
    rng = np.random.default_rng(5)
    size = np.sort(rng.integers(20, 40, 300))
    sketch = rng.integers(0, 1 << 62, 30).astype(np.uint64)[rng.integers(0, 30, 300)]
    sketch ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    group = partner_groups(size, sketch, 0.9)
    reached = list(range(300))
    for _ in range(300):
        before = list(reached)
        for i in range(300):
            for j in range(i):
                if 10 * size[j] >= 9 * size[i] and int(sketch[i] ^ sketch[j]).bit_count() <= 2 * (size[i] // 10):
                    reached[i] = reached[j] = min(reached[i], reached[j])
        if before == reached:
            break
    assert group.tolist() == reached and len(set(reached)) > 25


def one_bucket(seed, n, copies):
    """Rows of one bucket, sorted by key: ``n`` unrelated lines and ``copies`` of some of them with a few edits."""
    from thresher.llm.lines import ROW, parities
    rng = np.random.default_rng(seed)
    lines = [rng.integers(0, 10 ** 6, rng.integers(9, 60)).astype(np.uint32) for _ in range(n)]
    for i in rng.integers(0, n, copies):
        line = lines[i].copy()
        line[rng.integers(0, len(line), len(line) // 10)] = rng.integers(0, 10 ** 6)
        lines.append(np.delete(line, 0) if len(line) > 9 and rng.random() < 0.3 else line)
    size = np.array(list(map(len, lines)))
    rows = np.zeros(len(lines), ROW)
    rows["key"], rows["node"], rows["parity"] = size, np.arange(len(lines)), parities(np.concatenate(lines), size)
    return rows[np.argsort(rows["key"], kind="stable")]


@pytest.mark.parametrize("seed", range(3))
def test_splitting_a_bucket_loses_no_possible_pair(seed):
    from thresher.llm.lines import possible_pairs, split_members, split_pairs
    rows = one_bucket(seed, 1500, 600)
    wanted = {(i, j) for x, y in possible_pairs(rows["key"], rows["parity"], 0.9) for i, j in zip(x.tolist(), y.tolist())}
    found = {(min(i, j), max(i, j)) for x, y in split_pairs(rows, 0.9) for i, j in zip(x.tolist(), y.tolist())}
    assert len(wanted) > 500 and found == wanted
    node, _, key = split_members(rows, 0.9)
    keys = {}
    for n, k in zip(node.tolist(), key.tolist()):
        keys.setdefault(n, set()).add(k)
    assert all(keys[a] & keys[b] for a, b in ((rows["node"][i], rows["node"][j]) for i, j in wanted))


def test_unrelated_lines_of_a_large_bucket_do_not_go_on():
    from thresher.llm.lines import bucket_pairs
    rows = one_bucket(9, HELD + 500, 40)
    found = list(bucket_pairs(rows, 0.9))
    assert all(key is None for _, _, key in found)
    assert 30 <= len({pair for a, b, _ in found for pair in zip(a.tolist(), b.tolist())}) <= 60


def test_a_set_of_lines_that_many_blocks_find_is_one():
    from thresher.llm.lines import set_keys
    node = np.array([5, -7, 9, 11, 12])
    one, other = set_keys(np.array([0, 0, 2, 2, 4]), node), set_keys(np.array([0, 1, 1, 3, 3]), node[[4, 2, 3, 1, 0]])
    assert one[0] == one[1] == other[3] == other[4] and one[2] == one[3] == other[1] == other[2]
    assert len(set(one.tolist()) | set(other.tolist())) == 3


@pytest.mark.parametrize("seed", range(3))
def test_what_is_taken_for_similar_without_edit_distance_is_so(seed):
    from thresher.llm.lines import few_differ
    rng, taken = np.random.default_rng(seed), 0
    for _ in range(2000):
        a = rng.integers(0, 6, rng.integers(5, 25))
        b = np.array([int(str(t).removeprefix("new")) for t in edited(rng, a.tolist(), rng.integers(0, 4))] or [0])
        most = int(rng.integers(0, 4))
        if few_differ(a, b, most):
            taken += 1
            assert distance(a.tolist(), b.tolist()) <= most
    assert taken > 300
