import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st

from tests.llm.edge import documents, empty, frame
from thresher.llm.packing import WordTokenizer, first_fit_decreasing, load_tokenizer, pack, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_sequences(sequences, lengths, capacity):
    pieces = defaultdict(list)
    for sequence in sequences:
        n = sum(p[2] for p in sequence)
        assert 0 < n <= capacity
        assert n == capacity or n & (n - 1) == 0        # nothing is padded
        for doc, start, length in sequence:
            assert length > 0
            pieces[doc].append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([1, 2, 16, 64, 100]))
def test_pack_places_every_token_once(lengths, capacity):
    sequences = pack(lengths, capacity)
    if capacity & (capacity - 1) == 0:
        check_sequences(sequences, lengths, capacity)
    assert sum(p[2] for s in sequences for p in s) == sum(lengths)


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    sizes = sorted(rng.integers(1, 100, 200).tolist(), reverse=True)
    bins = []
    for i, size in enumerate(sizes):
        for found in bins:
            if sum(sizes[j] for j in found) + size <= 100:
                found.append(i)
                break
        else:
            bins.append([i])
    assert first_fit_decreasing(sizes, 100) == bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), max_size=8))
def test_ids_are_those_of_whole_texts(texts):
    tokenizer, words = load_tokenizer(PATH), WordTokenizer(PATH)
    texts = texts + [t.upper() + "!! x." for t in texts] + ["<|endoftext|>. a<|startoftext|>b \x01 \x01"]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    rows = documents()
    got = pack_documents(frame(spark, rows), PATH, group_bytes=20_000).collect()
    tokenizer = load_tokenizer(PATH)
    expected = defaultdict(int)
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected[doc, np.array(ids, "<u4").tobytes()] += 1
    found, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        found[r.doc_id, r.doc_tokens].setdefault(r.start, []).append(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) >= 0
    for sequence in sequences.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
    assert sum(len(r.ids) for r in got) == sum(len(ids) * n for (_, ids), n in expected.items())
    for (doc, ids), n in expected.items():
        pieces, at = found[doc, len(ids) // 4], 0
        while at < len(ids) // 4:       # follow the pieces that spell these ids
            piece = next(p for p in pieces[at] if p == ids[4 * at:4 * at + len(p)])
            at += len(piece) // 4
    assert pack_documents(empty(spark), PATH).count() == 0


def test_few_words_are_held_and_frequent_ones_stay(monkeypatch):
    from thresher.llm import packing
    assert packing.CACHED_WORDS <= 300_000
    monkeypatch.setattr(packing, "CACHED_WORDS", 400)
    tokenizer, words = load_tokenizer(PATH), WordTokenizer(PATH)
    for turn in range(30):
        text = " ".join(f"The rare{turn}x{i}. again, Again!" for i in range(100))
        ids, none = words.encode([text.encode(), b""])
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and not len(none)
        assert len(words.words) <= 400 + 103 and {b"The", b"again,", b"Again!"} <= words.words.keys()
        if turn == 20:
            known = words._learn
            words._learn = lambda: (seen.extend(words.words.new), known())
            seen = []
    assert len(seen) == 900 and not {b"The", b"again,", b"Again!"} & set(seen)
