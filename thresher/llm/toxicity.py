"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are lexicons of words and of word beginnings, mined from a bounded sample of
labelled texts, and patterns of writing. The label model knows only how the voters vote
on all documents: expectation maximisation estimates what each one says of toxic and of
clean texts, and the correlations left within a class lower the weight of voters that
repeat each other. Its posteriors are the labels on which the linear classifier is fitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thresher.llm.sampling import drawn, labelled_sample
from thresher.llm.words import CACHED_WORDS, slices

SAMPLE = 16_000             # labelled documents for the lexicons and the start of the label model
FITTED = 16_000             # documents for the linear classifier
TERMS = 1024
MIN_RATIO = 19.5
MIN_ODDS = 4.0              # a term that clean texts hold as well adds up in long ones
BEGINNING = 4               # characters of a word beginning
WORD_LEXICONS, BEGINNING_LEXICONS = 5, 4
PATTERNS = 4
VOTERS = WORD_LEXICONS + BEGINNING_LEXICONS + PATTERNS      # 3 ** 13 vote patterns at most
ENOUGH_WORDS = 60           # a text that long without a hit in any lexicon is called clean
NOT_LETTER = re.compile(r"[\W\d_]+")


def word_terms(word: bytes) -> tuple[str, ...]:
    """The word in lower case, letters only, and its beginning."""
    plain = NOT_LETTER.sub("", word.decode().lower())
    return (plain, plain[:BEGINNING] + "*") if len(plain) >= BEGINNING else (plain,) if plain else ()


class TermIds(dict):
    """Word bytes -> number of a set of terms; the sets are in ``sets``."""

    def __init__(self, ids: dict[str, int]) -> None:
        self.ids, self.sets, self.numbers = ids, [()], {(): 0}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = tuple(self.ids[t] for t in word_terms(word) if t in self.ids)
        if found not in self.numbers:
            self.numbers[found] = len(self.sets)
            self.sets.append(found)
        number = self[word] = self.numbers[found]
        return number

    def of(self, text: bytes) -> tuple[set[int], int]:
        """The terms in a text, and its number of words."""
        words = text.split()
        numbers = np.unique(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        return {t for n in numbers.tolist() for t in self.sets[n]}, len(words)


def _patterns(text: bytes, words: int) -> list[int]:
    codes = np.frombuffer(text, np.uint8)
    upper = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
    lower = int(np.count_nonzero((codes >= 97) & (codes <= 122)))
    shouts = upper / max(1, upper + lower)
    return [1 if shouts > 0.5 else -1 if shouts < 0.1 else 0,
            1 if text.count(b"!!") > 0.2 * words else 0,
            1 if text.count(b"***") > 0.2 * words else 0]


@dataclass
class Lexicons:
    """Terms, the log odds they had in the sample, and the lexicon each belongs to."""

    terms: dict[str, int]
    odds: np.ndarray
    lexicon: np.ndarray

    def votes(self, found: set[int], words: int, text: bytes) -> list[int]:
        """1 toxic, -1 clean, 0 no opinion, of each voter."""
        hit = set(self.lexicon[list(found)].tolist()) if found else set()
        return ([int(j in hit) for j in range(WORD_LEXICONS + BEGINNING_LEXICONS)]
                + [-1 if words >= ENOUGH_WORDS and not hit else 0] + _patterns(text, words))


def _encode(votes: np.ndarray) -> np.ndarray:
    return (votes + 1) @ (3 ** np.arange(VOTERS))


def _decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(VOTERS) % 3 - 1


def mine_lexicons(sample: DataFrame) -> Lexicons:
    """Terms that mark toxic texts, from their document counts in the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in slices(batches):
            for text, label in zip(batch.column("text").cast(pa.binary()).to_pylist(),
                                   batch.column("label").to_pylist()):
                for term in {t for w in set((text or b"").split()) for t in word_terms(w)}:
                    counts.setdefault(term, [0, 0])[1 if label else 0] += 1
        items = list(counts.items())
        for at in range(0, len(items), 1 << 15):
            part = items[at:at + (1 << 15)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in part]), pa.array([n[0] for _, n in part], pa.int64()),
                 pa.array([n[1] for _, n in part], pa.int64())], names=["term", "clean", "toxic"])

    clean, toxic = sample.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    if not clean or not toxic:
        return Lexicons({}, np.empty(0), np.empty(0, np.int64))
    p1 = (F.col("toxic") + 0.1) / (toxic + 0.2)
    p0 = (F.col("clean") + 0.1) / (clean + 0.2)
    odds = F.log(p1 / (1 - p1)) - F.log(p0 / (1 - p0))
    # likelihood ratio against equal shares in both classes; chance reaches MIN_RATIO in one of 10^5 terms
    n = F.col("toxic") + F.col("clean")
    both = lambda seen, of: F.when(F.col(seen) > 0, 2 * F.col(seen) * F.log(
        F.col(seen) * (toxic + clean) / (n * of))).otherwise(0.0)
    best = (sample.mapInArrow(run, "term string, clean long, toxic long")
            .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .withColumn("odds", odds)
            .where((F.col("odds") > MIN_ODDS) & (both("toxic", toxic) + both("clean", clean) > MIN_RATIO))
            .withColumn("gain", F.col("toxic") * F.col("odds"))
            .orderBy(F.desc("gain"), "term").limit(TERMS)
            .select("term", "odds", F.pmod(F.xxhash64("term"), F.lit(1 << 30)).alias("h")).collect())
    lexicon = [WORD_LEXICONS + r["h"] % BEGINNING_LEXICONS if r["term"].endswith("*") else r["h"] % WORD_LEXICONS
               for r in best]
    return Lexicons({r["term"]: i for i, r in enumerate(best)},
                    np.array([r["odds"] for r in best]), np.array(lexicon, np.int64))


def vote_counts(rows: DataFrame, lexicons: Lexicons) -> DataFrame:
    """``label``, ``votes`` (a code) and ``n`` over all rows of ``text`` and ``label``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = TermIds(lexicons.terms), {}
        for batch in slices(batches):
            for text, label in zip(batch.column("text").cast(pa.binary()).to_pylist(),
                                   batch.column("label").to_pylist()):
                found, words = ids.of(text or b"")
                key = (label, int(_encode(np.array(lexicons.votes(found, words, text or b"")))))
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int64()),
             pa.array(list(counts.values()), pa.int64())], names=["label", "votes", "n"])

    return (rows.mapInArrow(run, "label int, votes long, n long")
            .groupBy("label", "votes").agg(F.sum("n").alias("n")))


@dataclass
class LabelModel:
    """``chance[y, voter, vote + 1]`` given class ``y``, ``prior`` of toxic, ``weight`` of voters."""

    chance: np.ndarray
    prior: float
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.chance[1]) - np.log(self.chance[0])
        odds = np.log(self.prior / (1 - self.prior)) + (
            self.weight * ratio[np.arange(VOTERS), votes + 1]).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _chances(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.stack([(n[:, None] * (votes == v)).sum(0) for v in (-1, 0, 1)], 1) + 0.05
    return out / out.sum(1, keepdims=True)


def _within_class(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Correlations of the votes under weights ``n``."""
    total = max(n.sum(), 1e-9)
    centred = votes - (n @ votes) / total
    cov = centred.T @ (n[:, None] * centred) / total
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return cov / np.outer(scale, scale)


def fit_label_model(patterns: np.ndarray, n: np.ndarray, labelled: list[tuple[np.ndarray, np.ndarray]],
                    rounds: int = 25) -> LabelModel:
    """``patterns`` and counts ``n`` of all documents; ``labelled``: those of clean and toxic samples.

    The labelled documents start the estimates and hold the two classes in place: together
    they weigh as much as all others, whose class is estimated.
    """
    prior = float(np.clip(labelled[1][1].sum() / max(1, sum(c.sum() for _, c in labelled)), 1e-4, 0.9999))
    start = np.stack([_chances(*labelled[y]) for y in (0, 1)])
    model = LabelModel(start, prior, np.ones(VOTERS), np.eye(VOTERS))
    scale = n.sum() / max(1.0, sum(c.sum() for _, c in labelled))
    for _ in range(rounds):
        toxic = model.posterior(patterns)
        model.chance = np.stack([
            _chances(np.concatenate([patterns, known]), np.concatenate([n * share, scale * count]))
            for share, (known, count) in zip((1 - toxic, toxic), labelled)])
        # what two voters share within a class is no second piece of evidence
        model.correlation = ((1 - prior) * _within_class(patterns, n * (1 - toxic))
                             + prior * _within_class(patterns, n * toxic))
        extra = np.abs(model.correlation) - np.eye(VOTERS)
        model.weight = 1 / (1 + np.where(extra > 0.2, extra, 0).sum(1))
    return model


@dataclass
class ToxicityModel:
    """The lexicons' terms, with a weight each."""

    lexicons: Lexicons
    weight: np.ndarray
    bias: float

    def score(self, found: set[int]) -> float:
        odds = self.bias + float(self.weight[list(found)].sum()) if found else self.bias
        return 1 / (1 + float(np.exp(-np.clip(odds, -30, 30))))


def _fit_linear(rows: list[list[int]], labels: np.ndarray, terms: int, rounds: int = 300,
                penalty: float = 1.0, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on term indicators, by Adam on the whole sample."""
    of = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    term = np.fromiter((t for row in rows for t in row), np.int64, len(of))
    x, m, v = np.zeros(terms + 1), np.zeros(terms + 1), np.zeros(terms + 1)
    for step in range(1, rounds + 1):
        odds = x[-1] + np.bincount(of, x[term], len(rows))
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels
        grad = np.append(np.bincount(term, error[of], terms), error.sum())
        grad[:-1] += penalty * x[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        x -= rate * 0.98 ** (step / 3) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return x[:-1], float(x[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", sample: int = SAMPLE, fitted: int = FITTED) -> ToxicityModel:
    """Fits on ``labels`` and on the texts of ``docs``.

    At most about ``sample`` labelled documents give the lexicons and the start of the label
    model; its votes are counted over all documents; about ``fitted`` documents with its
    posteriors fit the classifier. The driver sees vote counts (3 ** 13 rows at most) and the
    terms of the ``fitted`` documents. Without labels of both kinds every score is the prior.
    """
    chosen = labelled_sample(docs, labels, label_col, sample, id_col, text_col)
    lexicons = mine_lexicons(chosen)
    rates = labels.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    rate = float(np.clip(rates if rates is not None else 0.0, 1e-4, 0.9999))
    nothing = ToxicityModel(lexicons, np.zeros(len(lexicons.terms)), float(np.log(rate / (1 - rate))))
    if not lexicons.terms:
        return nothing

    def table(rows: DataFrame) -> list:
        found = vote_counts(rows, lexicons).toArrow()
        label, votes, n = (found.column(c).to_numpy() for c in ("label", "votes", "n"))
        return [(_decode(votes[pick]), n[pick].astype(float)) for pick in
                (np.nan_to_num(label.astype(float), nan=-1) == y for y in (-1, 0, 1))]

    text = F.col(text_col).cast("string").alias("text")
    all_votes = table(docs.select(text, F.lit(None).cast("int").alias("label")))[0]
    model = fit_label_model(*all_votes, table(chosen)[1:])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds(lexicons.terms)
        for batch in slices(batches):
            terms, votes = [], []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                found, words = ids.of(value or b"")
                terms.append(sorted(found))
                votes.append(lexicons.votes(found, words, value or b""))
            chance = model.posterior(np.array(votes).reshape(-1, VOTERS))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int32())), pa.array(chance)],
                                             names=["terms", "chance"])

    share = min(1.0, fitted / max(1.0, all_votes[1].sum()))
    part = docs.where(drawn(share, F.lit("fit"), id_col))
    rows = part.select(text).mapInArrow(features, "terms array<int>, chance double").toArrow()
    if not rows.num_rows:
        return nothing
    # rows come in no fixed order; sums of floating point numbers depend on it
    terms, chance = zip(*sorted(zip(rows.column("terms").to_pylist(), rows.column("chance").to_pylist())))
    weight, bias = _fit_linear(list(terms), np.array(chance), len(lexicons.terms))
    return ToxicityModel(lexicons, weight, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: toxic is likelier), with the columns of ``docs``
    that are not the text. A column of ``docs`` named ``score`` gives way to the new one.

    Null and empty texts hold no term and get the score of the bias. One row per input row,
    repeated rows alike; an empty table gives none. Texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text_col, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds(shared.value.lexicons.terms)
        for batch in slices(batches, text_col):
            scores = [shared.value.score(ids.of(t or b"")[0])
                      for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(scores, pa.float64())], names=[*others, "score"])

    schema = docs.select(*others).schema.add("score", "double")
    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, at: float, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that score ``at`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds(shared.value.lexicons.terms)
        for batch in slices(batches, text_col):
            keep = [shared.value.score(ids.of(t or b"")[0]) < at
                    for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
