"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from thresher.llm.words import slices

BUCKETS = 1 << 16
MAX_LANGUAGES = 256         # bounds the broadcast matrix: 64 MB
UNKNOWN = "und"
CHUNK = 1 << 19             # characters of a text handled at once
NGRAMS = (2, 3)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; rows without an id do."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


def hashed_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams at each position (one row per n), and each text's span.

    A text is lower-cased and followed by line ends, so n-grams at its end are whole.
    """
    tail = "\n" * (max(NGRAMS) - 1)
    lowered = [text.lower() for text in texts]
    codes = np.frombuffer((tail.join(lowered) + tail).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    begins = np.cumsum(sizes + len(tail)) - sizes - len(tail)
    count = len(codes) - len(tail)
    key, rows = np.zeros(count, np.uint32), []
    for i in range(max(NGRAMS)):
        key = key * np.uint32(0x01000193) + codes[i:i + count] + np.uint32(1)
        if i + 1 in NGRAMS:
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            rows.append((mixed >> np.uint32(16)) % np.uint32(BUCKETS))
    return np.stack(rows), begins, begins + sizes


def chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about ``CHUNK`` characters; a longer one is cut, n-grams kept whole.

    An n-gram that a cut would split is counted twice at most, by the text after the cut.
    """
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            owners.append(i)
            parts.append(text[at:at + CHUNK])
            size += len(parts[-1])
            if size >= CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def ngram_counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all of ``lang`` and ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            for owners, parts in chunks(batch.column("text").to_pylist()):
                grams, begins, ends = hashed_ngrams(parts)
                of = [langs[i] for i in owners]
                for lang in set(of):
                    own = np.zeros(grams.shape[1] + 1, np.int8)
                    for a, b, name in zip(begins, ends, of):
                        if name == lang and a < b:
                            own[a], own[b] = 1, own[b] - 1
                    inside = np.cumsum(own[:-1]).astype(bool)
                    sums[lang] = sums.get(lang, 0) + np.bincount(
                        grams[:, inside].ravel(), minlength=BUCKETS)
        for lang, counts in sums.items():
            bucket = np.flatnonzero(counts)
            for at in range(0, len(bucket), 1 << 15):
                part = bucket[at:at + (1 << 15)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part.astype(np.int32)),
                     pa.array(counts[part].astype(np.int64))], names=["lang", "bucket", "n"])

    return (rows.mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


class NaiveBayes:
    """``weights[bucket, language]`` are log probabilities, ``prior[language]`` too."""

    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.weights, self.prior = languages, weights, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.prior, (len(texts), 1))
        for owners, parts in chunks(texts):
            grams, begins, ends = hashed_ngrams(parts)
            each = self.weights[grams[0]]
            for more in grams[1:]:
                each += self.weights[more]
            # the line ends after a text belong to no text
            edges = np.stack([begins, ends], 1).ravel()
            each = np.concatenate([each, np.zeros((1, each.shape[1]), each.dtype)])
            np.add.at(out, owners, np.add.reduceat(each.astype(np.float64), edges)[::2])
        return out


def fit_language_model(rows: DataFrame, smoothing: float = 0.5) -> NaiveBayes:
    """Fits on all rows of ``lang`` and ``text``; both must be present to count.

    The driver receives one number per language and bucket. More languages than
    ``MAX_LANGUAGES`` are an error: the label is a closed set.
    """
    rows = rows.where("lang is not null and text is not null and text != ''")
    found = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sizes = dict(sorted((r["lang"], r["count"]) for r in found))
    languages = list(sizes)
    counts = np.full((BUCKETS, len(languages)), smoothing)
    if languages:
        sums = ngram_counts(rows).toArrow()
        column = {lang: i for i, lang in enumerate(languages)}
        at = np.fromiter(map(column.__getitem__, sums.column("lang").to_pylist()), np.int64, len(sums))
        counts[sums.column("bucket").to_numpy(), at] += sums.column("n").to_numpy()
    prior = np.log(np.array(list(sizes.values()), float) / max(1, sum(sizes.values())))
    return NaiveBayes(languages, (np.log(counts) - np.log(counts.sum(0))).astype(np.float32), prior)


def predict_language(docs: DataFrame, model: NaiveBayes, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score``, the posterior probability of that language.

    Null texts, texts without a letter and models without a language give ``und`` and 0.
    Ties go to the language that sorts first. Very long texts are scored whole, in chunks.
    One row per input row; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes: NaiveBayes = shared.value
        for batch in slices(batches, most=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if bayes.languages:
                scores = bayes.scores(texts)
                top = scores.argmax(1)
                chance = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
                for i, text in enumerate(texts):
                    if any(map(str.isalpha, text)):
                        names[i], best[i] = bayes.languages[top[i]], chance[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(best)],
                names=["doc_id", "lang_pred", "score"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, "
                             "lang_pred string, score double"))
