"""Language, toxicity and quality: held-out accuracy, and the odd cases."""

import numpy as np
import pytest

from tests.llm.edge import SCHEMA, EXTRA, documents, empty, frame
from thresher.llm import language
from thresher.llm.language import fit_language_model, predict_language
from thresher.llm.quality import CODED, WordCodes, encode, fit_attention, fit_quality, score_quality
from thresher.llm.toxicity import VOTERS, _decode, _encode, drop_toxic, fit_label_model, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = language.held_out("doc_id", 3, 1)
    return docs, labels, held


def accuracy(scored, labels, column, at):
    rows = scored.join(labels, "doc_id").select("score", column).collect()
    good = [r.score for r in rows if r[column] == 1]
    bad = [r.score for r in rows if r[column] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    return auc, np.mean([(r.score >= at) == (r[column] == 1) for r in rows])


def test_language_held_out(spark, corpus, monkeypatch):
    docs, _, held = corpus
    model = fit_language_model(docs.where(~held).select("lang", "text"))
    out = predict_language(docs.where(held), model).join(docs, "doc_id").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.99
    assert all(0 <= r.score <= 1 for r in out)
    # counts and scores by hand: every n-gram of a lower-cased text, line ends after it
    texts = ["Ab", "ünï", "x" * 5, "ab ab"]
    grams = {n: [t.lower() + "\n\n" for t in texts] for n in language.NGRAMS}
    for i, text in enumerate(texts):
        rows, begins, ends = language.hashed_ngrams([text])
        assert rows.shape == (2, len(text)) and (begins[0], ends[0]) == (0, len(text))
        alone = [model.weights[rows[k]].sum(0) for k in range(2)]
        together = model.scores(texts)[i] - model.prior
        assert np.allclose(together, sum(alone), atol=1e-3), grams
    long = "der und die " * 200_000
    cut = model.scores([long])[0]
    monkeypatch.setattr(language, "CHUNK", 1 << 24)
    assert np.allclose(cut, model.scores([long])[0], rtol=1e-3)


def test_language_odd_cases(spark, monkeypatch):
    rows = documents() + [(70, "12345 !?", "en", None, 0), (71, "tie", None, None, 0)]
    df = frame(spark, rows)
    model = fit_language_model(df.select("lang", "text"))
    out = predict_language(df, model).collect()
    assert len(out) == len(rows)
    named = {r.doc_id: r for r in out}
    for doc in (1, 2, 4, 70):
        assert (named[doc].lang_pred, named[doc].score) == ("und", 0.0)
    assert named[0].lang_pred == "en"
    nothing = fit_language_model(empty(spark).select("lang", "text"))
    assert {r.lang_pred for r in predict_language(df, nothing).collect()} == {"und"}
    assert predict_language(empty(spark), model).count() == 0
    monkeypatch.setattr(language, "MAX_LANGUAGES", 0)
    with pytest.raises(ValueError):
        fit_language_model(df.select("lang", "text"))


def test_toxicity_held_out(spark, corpus):
    docs, labels, held = corpus
    model = fit_toxicity(docs.where(~held), labels.where(~held))
    auc, right = accuracy(score_toxicity(docs.where(held), model), labels, "toxic", 0.7)
    assert auc > 0.85 and right > 0.9
    kept = drop_toxic(docs, model, 0.7)
    assert kept.columns == docs.columns
    assert kept.count() == score_toxicity(docs, model).where("score < 0.7").count() < docs.count()


def test_label_model_finds_accuracies_and_repeats():
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.2
    votes = np.zeros((len(y), VOTERS), int)
    for j in range(VOTERS - 1):
        votes[:, j] = (rng.random(len(y)) < np.where(y, 0.3 + 0.04 * j, 0.02))
    votes[:, -1] = votes[:, -2]                     # a voter that repeats another
    codes, n = np.unique(_encode(votes), return_counts=True)
    assert (_decode(codes) == votes[np.unique(_encode(votes), return_index=True)[1]]).all()
    known = [(votes[:200][y[:200] == c], np.ones((y[:200] == c).sum())) for c in (0, 1)]
    model = fit_label_model(_decode(codes), n.astype(float), known)
    for j in range(VOTERS - 1):
        assert abs(model.chance[1, j, 2] - (0.3 + 0.04 * j)) < 0.12
    assert model.correlation[-1, -2] > 0.9 and model.weight[-1] < 0.6 < model.weight[0]
    right = (model.posterior(votes) > 0.5) == y
    assert right.mean() > 0.95


def test_toxicity_odd_cases(spark):
    rows = documents()
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 6 == 3), 1, "x") for i in range(60) if i != 20]
                                   + [(None, 1, 0, "x"), (21, None, None, "x"), (22, 0, 1, "x"), (22, 0, 1, "x")],
                                   "doc_id long, toxic int, quality int, text string")
    model = fit_toxicity(df, labels)
    out = score_toxicity(df.select("doc_id", "text"), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert drop_toxic(df, model, 2.0).count() == len(rows)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        flat = fit_toxicity(df, few)
        assert len({r.score for r in score_toxicity(df.select("doc_id", "text"), flat).collect()}) == 1
    assert score_toxicity(empty(spark).select("doc_id", "text"), model).count() == 0
    assert fit_toxicity(empty(spark), labels).weight is not None


def test_quality_held_out(spark, corpus):
    docs, labels, _ = corpus
    held = language.held_out("doc_id", 5, 0)
    model = fit_quality(docs.where(~held), labels.where(~held))
    auc, right = accuracy(score_quality(docs.where(held).select("doc_id", "text"), model), labels, "quality", 0.3)
    assert auc > 0.97 and right > 0.95


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(400):
        bag = rng.normal(size=(rng.integers(1, 30), CODED))
        if i % 3 == 0:
            bag[rng.integers(0, len(bag)), :4] += 5      # one passage of many marks the document
        bags.append(bag)
        labels.append(int(i % 3 != 0))
    model = fit_attention(bags[:300], np.array(labels[:300]))
    scores = model.score(bags[300:])
    assert np.mean((scores > 0.5) == np.array(labels[300:])) > 0.9


def plain_passages(text):
    """Passages of at most 80 words, as even as they go, word by word."""
    words = text.split()
    n = -(-len(words) // 80)
    return [[w for i, w in enumerate(words) if i * n // len(words) == p] for p in range(n)]


def test_passages_one_by_one_and_in_a_batch():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["Ab", "ab", "x1", "12", "end.", "Ünï", "zz"], n)).encode()
             for n in (0, 1, 79, 80, 81, 500, 3, 20_000)]
    together = encode(texts, WordCodes())
    for text, bag in zip(texts, together):
        assert np.allclose(bag, encode([text], WordCodes())[0]) and bag.shape[1] == CODED
        passages = plain_passages(text)
        assert len(passages) == len(bag)
        for words, row in zip(passages, bag):
            assert np.isclose(row[0], np.mean([min(len(w.decode()), 40) / 10 for w in words]))
            assert np.isclose(row[-1], np.log1p(len(words)))
            if len(passages) == 1:
                assert np.isclose(row[-3], np.mean([0, *(a == b for a, b in zip(words, words[1:]))]))


def test_one_bad_passage_in_a_very_long_text():
    """Passages keep their length, so attention can find one of 250."""
    rng = np.random.default_rng(2)
    fine = lambda n: " ".join(rng.choice(["plain", "Words", "of", "prose,", "and", "more."], n))
    bad = lambda n: " ".join(rng.choice(["$$$", "!!!", "###", "%%%"], n))
    texts, labels = [], []
    for i in range(240):
        words = fine(int(rng.integers(100, 900)) if i % 5 else 16_000)
        texts.append((words + " " + bad(80) if i % 3 == 0 else words).encode())
        labels.append(int(i % 3 != 0))
    codes = WordCodes()
    model = fit_attention(encode(texts, codes), np.array(labels))
    clean, dirty = fine(20_000), fine(12_000) + " " + bad(160) + " " + fine(7_840)
    scores = model.score(encode([clean.encode(), dirty.encode()], codes))
    assert scores[0] > 0.5 > scores[1]


def test_quality_odd_cases(spark):
    codes = WordCodes()
    assert [bag.shape for bag in encode([b"", b" \n"], codes)] == [(0, CODED)] * 2 and encode([], codes) == []
    long = encode([b"word " * 200_001], codes)[0]
    assert len(long) == 2501 and np.allclose(long[:, 0], long[0, 0])
    rows = documents()
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(50)], "doc_id long, quality int")
    model = fit_quality(df, labels)
    out = score_quality(df.select("doc_id", "text"), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    flat = fit_quality(df, labels.limit(0))
    assert {r.score for r in score_quality(df.select("doc_id", "text"), flat).collect()} == {0.5}
    assert score_quality(empty(spark).select("doc_id", "text"), model).count() == 0
    assert len(SCHEMA.split(",")) == 5 + len(EXTRA)
