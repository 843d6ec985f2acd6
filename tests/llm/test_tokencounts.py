import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import edge
from thresher.llm import tokencounts
from thresher.llm.tokencounts import PATTERN, UNSURE, Counter, count_tokens, pack, unpack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def direct(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False))


def texts():
    return ["it's we'll 'S ''s 1234567 ½²", "a\n\n b \t c  \r\n", "<|endoftext|>a<|endoftext|> <|endoftext", "﻿​",
            "naïve — “quotes” 中文字 ひらがな 한국어 😀👩‍👩‍👧", "Ḁ֋\U0001e900 x y\u0085z\x1c\x1dq",
            "long" * 5000, " " * 3000, "x" * 20_000 + " y" * 20_000, "ǅ̈́ ͸퟼"]


def test_against_the_library(spark, tokenizer):
    rows = edge.documents() + [(1000 + i, t, None, None, 1) for i, t in enumerate(texts())]
    found = count_tokens(edge.frame(spark, rows), PATH, limit=100)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    wanted = [(i, len((t or "").encode()), n, n > 100) for i, t, *_ in rows for n in [direct(tokenizer, t)]]
    order = lambda r: (r[0] is None, r[0], r[1], r[2])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(wanted, key=order)
    assert count_tokens(edge.empty(spark), PATH).collect() == []


def test_no_count_depends_on_the_table(spark):
    docs = edge.frame(spark, edge.documents())
    counts = [sorted(map(str, count_tokens(docs, PATH, **o).collect()))
              for o in ({}, {"table_pieces": 0}, {"table_pieces": 50}, {"sample": 3})]
    assert all(c == counts[0] for c in counts)


def test_long_texts_and_a_full_cache(tokenizer, monkeypatch):
    monkeypatch.setattr(tokencounts, "CUT_CHARACTERS", 50)
    monkeypatch.setattr(tokencounts, "CACHED_PIECES", 7)
    counter = Counter(PATH, pack({" the": 1, "the": 1}))
    for text in [*texts(), "the cat's  mat, the\n\nhat; " * 40, "a b " * 100 + "  c" * 50]:
        assert counter.count(text) == direct(tokenizer, text)
    assert len(counter.lengths) <= 9 and counter.lengths["the"] == 1


def test_packed_table():
    table = {" the": 1, "naïve": 3, "\n\n": 1, "": 0}
    assert unpack(pack(table)) == table and unpack(None) == {}


def test_classes_of_characters(tokenizer):
    """Where the pattern is trusted, it cuts every character as the tokenizer does."""
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    for point in range(0x110000):
        c = chr(point)
        if 0xD800 <= point < 0xE000 or UNSURE.search(c):
            continue
        text = f"a{c}1{c}!{c} {c}x\n{c}"
        assert [text[a:b] for _, (a, b) in cut(text)] == PATTERN.findall(text), hex(point)


def test_other_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    counter = Counter(path)
    for text in texts():
        assert counter.count(text) == direct(other, text)
