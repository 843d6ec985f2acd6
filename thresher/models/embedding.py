"""Texts to token states, pooled embeddings, and classifiers on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from thresher.functions.columns import as_text, terms
from thresher.models.base import WEIGHT, Fitted, Model, describe, in_parallel, merge_rows, settled
from thresher.models.ensemble import Voting
from thresher.models.linear import Logistic, SupportVector
from thresher.models.trees import Forest
from thresher.operators.folds import stratified_folds
from thresher.operators.text import SEARCH_SIZES, extraction_aliases, extraction_grid
from thresher.operators.vectors import pool

MAX_LENGTH = 128
BATCH_ROWS = 256                # texts that a user's encoder gets at a time
BATCH_CHARACTERS = 1 << 20
PRIORITY = ("paragraph", "sentence", "word")


class WordVectorEncoder:
    """Token states from hashed character n-grams: every term has a vector.

    A term's vector is the mean of random directions drawn by hash for the term and for its
    ``ngram``-character pieces, so related spellings are near each other. Nothing is fitted, so
    nothing can pass from one fold or table to another.
    """

    def __init__(self, size: int = 32, max_length: int = MAX_LENGTH, ngram: int = 3, seed: int = 42):
        self.size, self.max_length, self.ngram, self.seed = size, max_length, ngram, seed

    def fit(self, texts: DataFrame) -> "WordVectorEncoder":
        return self

    def _vector(self, term):
        marked = F.concat(F.lit("<"), term, F.lit(">"))
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - self.ngram + 1)),
                             lambda i: F.substring(marked, i, F.lit(self.ngram)))
        hashes = F.transform(F.concat(F.array(marked), pieces), lambda p: F.xxhash64(p, F.lit(self.seed)))
        return _directions(self.size)(hashes)

    def states(self, texts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(id, keep, pos, vec) for the first ``max_length`` terms of each text."""
        first = F.slice(terms(as_text("text")), 1, self.max_length)
        return (texts.select("id", *keep, F.posexplode(first).alias("pos", "term"))
                .select("id", *keep, "pos", self._vector(F.col("term")).alias("vec")))

    @property
    def empty(self):
        return F.array_repeat(F.lit(0.0), self.size)


def _xxhash(h: np.ndarray, dim: int) -> np.ndarray:
    """Spark's ``xxhash64(h, dim)`` of a long and an int, for many longs."""
    one, two, three, four, five = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, by):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(x):
        x = (x ^ (x >> np.uint64(33))) * two
        x = (x ^ (x >> np.uint64(29))) * three
        return x ^ (x >> np.uint64(32))
    seed = mixed(turned((np.uint64(42 + 8) + five) ^ (turned(h * two, 31) * one), 27) * one + four)
    return mixed(turned((seed + five + np.uint64(4)) ^ (np.array([dim], np.uint64) * one), 23) * two + three)


def _directions(size: int):
    """array<long> of piece hashes to the mean of their directions; equal hashes are drawn once a batch."""
    scale = float(2 ** 63) / 3 ** 0.5           # unit variance of each direction

    def vectors(hashes: pa.Array) -> pa.Array:
        sizes = pa.compute.list_value_length(hashes).to_numpy(False).astype(np.int64)
        distinct, at = np.unique(hashes.flatten().to_numpy(False).view(np.uint64), return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        out = np.empty((len(sizes), size), np.float32)
        for j in range(size):
            value = _xxhash(distinct, j).view(np.int64) / scale
            out[:, j] = np.add.reduceat(value[at], begins) / sizes if len(sizes) else 0
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * size), pa.array(out.ravel()))
    vectors.__annotations__ = {"hashes": pa.Array, "return": pa.Array}
    return F.arrow_udf(vectors, "array<float>")


class FunctionEncoder:
    """Token states from a user's batch function, for instance one that runs a
    language model: ``fn`` maps batches of (id, text) to batches of (id, pos, vec).
    Ids keep the type they come with. A failure in it fails the job. A batch has at most
    BATCH_ROWS texts, and no second one beyond BATCH_CHARACTERS."""

    def __init__(self, fn: Callable[[Iterator], Iterator], size: int):
        self.fn, self.size = fn, size

    def fit(self, texts: DataFrame) -> "FunctionEncoder":
        return self

    def states(self, texts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        src = texts.select("id", as_text("text").alias("text"))
        id_type = src.schema["id"].dataType.simpleString()
        out = src.mapInPandas(_in_pieces(self.fn), f"id {id_type}, pos int, vec array<float>")
        return out.join(texts.select("id", *keep), "id") if keep else out

    @property
    def empty(self):
        return F.array_repeat(F.lit(0.0), self.size)


def _in_pieces(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` on small batches: its states are many times as large as the texts."""
    def pieces(batches):
        for pdf in batches:
            ends = pdf["text"].str.len().cumsum().to_numpy()
            start = 0
            while start < len(pdf):
                before = ends[start - 1] if start else 0
                end = min(start + BATCH_ROWS, max(start + 1, int(np.searchsorted(
                    ends, before + BATCH_CHARACTERS, side="right"))))
                yield pdf.iloc[start:end].reset_index(drop=True)
                start = end
    return lambda batches: fn(pieces(batches))


def embed(texts: DataFrame, encoder, strategy: str = "hybrid") -> DataFrame:
    """Adds ``features``: the pooled vector of each text, zero for a text without terms."""
    pooled = pool(encoder.states(texts), "id", strategy)
    copies = 3 if strategy == "hybrid" else 1
    zero = F.concat(*[encoder.empty] * copies)
    return (texts.join(pooled, "id", "left")
            .withColumn("features", array_to_vector(F.coalesce("embedding", zero)))
            .drop("embedding"))


def embedding_head(kind: str) -> Model:
    if kind == "logistic_regression":
        return Logistic(input="embedding")
    if kind == "svm":
        return SupportVector("rbf", input="embedding")
    if kind == "ensemble":
        return Voting({"lr": Logistic(), "rf": Forest(50, max_depth=30),
                       "svm": SupportVector("rbf")}, input="embedding")
    raise ValueError(f"unknown classifier type: {kind}")


class EmbeddingClassifier(Model):
    """A classifier on pooled embeddings; brings its own features from the text."""
    input = "text"

    def __init__(self, classifier: str = "logistic_regression", strategy: str = "hybrid",
                 encoder=None):
        self.head, self.strategy = embedding_head(classifier), strategy
        self.encoder = encoder or WordVectorEncoder()

    def fit(self, train, ctx):
        encoder = self.encoder.fit(train)       # a fitted one, held by the fitted model only
        rows = settled(embed(train.drop("features"), encoder, self.strategy), ctx.n).persist()
        width = encoder.size * (3 if self.strategy == "hybrid" else 1)
        inner = self.head.fit(rows, replace(ctx, n_features=width))
        rows.unpersist()
        return FittedEmbedding(inner, encoder, self.strategy)


class FittedEmbedding(Fitted):
    narrow = False

    def __init__(self, inner, encoder, strategy):
        self.inner, self.encoder, self.strategy = inner, encoder, strategy

    def predict(self, df, keep=()):
        return self.inner.predict(embed(df.drop("features"), self.encoder, self.strategy), keep)


class MultilevelClassifier(Model):
    """Chooses the best size of every level by cross-validated accuracy, refits it, and
    predicts with one level: the first by priority, or the one with the best score."""
    input = "text"

    def __init__(self, sizes: dict[str, Sequence[int]] | None = None,
                 classifier: str = "logistic_regression", folds: int = 3,
                 choose: str = "priority", encoder=None):
        if choose not in ("priority", "score"):
            raise ValueError(f"unknown choice: {choose}")
        self.sizes, self.classifier = sizes or SEARCH_SIZES, classifier
        self.folds, self.choose = folds, choose
        self.encoder = encoder or WordVectorEncoder()

    def fit(self, train, ctx):
        encoder = self.encoder.fit(train)
        base = stratified_folds(train.select("id", "label", "text"), "id", "label",
                                self.folds, ctx.seed)
        # equal extractions are embedded and scored once
        aliases = extraction_aliases(train, self.sizes, baseline=False)
        source: dict[str, tuple[str, str]] = {}
        for level, size, _, src in aliases:
            source.setdefault(src, (level, size))
        wanted = F.array(*[F.lit(f"{lv}:{s}") for lv, s in source.values()])
        grid = extraction_grid(base, sizes=self.sizes, baseline=False)
        kept = grid.where(F.array_contains(wanted, F.concat_ws(":", "level", "size")))
        if embedding_head(self.classifier).mergeable:
            kept = merge_rows(kept, "fold", "level", "size")
        else:
            kept = kept.withColumn(WEIGHT, F.lit(1.0))
        kept = kept.persist()
        held = kept.count()
        keyed = kept.withColumn("id", F.concat_ws("|", F.col("id").cast("string"), "level", "size"))
        features = settled(embed(keyed, encoder), min(held, ctx.n)).persist()
        features.count()
        width = encoder.size * 3

        def head(rows):
            facts = replace(describe(rows, width, ctx.seed), parallelism=1)
            return embedding_head(self.classifier).fit(rows, facts)

        def cell(src):
            level, size = source[src]
            return features.where((F.col("level") == level) & (F.col("size") == size))

        def held_out(src, f):
            def run():
                rows = cell(src)
                return head(rows.where(F.col("fold") != f)).predict(
                    rows.where(F.col("fold") == f), ["fold", "label", WEIGHT]).withColumn(
                    "source", F.lit(src))
            return run
        parts = in_parallel([held_out(src, f) for src in source for f in range(self.folds)],
                            ctx.parallelism)
        preds = parts[0]
        for p in parts[1:]:
            preds = preds.unionByName(p)
        per_fold = preds.groupBy("source", "fold").agg(
            (F.sum((F.col("pred") == F.col("label")).cast("double") * F.col(WEIGHT)) / F.sum(WEIGHT)).alias("a"))
        accuracy = {r["source"]: r["a"] for r in       # one row per distinct extraction
                    per_fold.groupBy("source").agg(F.avg("a").alias("a")).collect()}
        best: dict[str, tuple[str, float]] = {}
        chosen = {}
        for level, size, _, src in aliases:            # the first size wins a tie
            if level not in best or accuracy[src] > best[level][1]:
                best[level], chosen[level] = (size, accuracy[src]), src
        level = (max(best, key=lambda lv: (best[lv][1], -PRIORITY.index(lv)))
                 if self.choose == "score" else next(lv for lv in PRIORITY if lv in best))
        heads = dict(zip(best, in_parallel(
            [lambda lv=lv: head(cell(chosen[lv])) for lv in best], ctx.parallelism)))
        features.unpersist()
        kept.unpersist()
        return FittedMultilevel(train.sparkSession, best, heads, level, encoder)


class FittedMultilevel(Fitted):
    narrow = False

    def __init__(self, spark, best, heads, level, encoder):
        self.spark, self.best, self.heads = spark, best, heads
        self.level, self.encoder = level, encoder

    def selection(self) -> DataFrame:
        """(level, size, accuracy, used): the chosen size of every available level."""
        return self.spark.createDataFrame(
            [(lv, s, float(a), lv == self.level) for lv, (s, a) in sorted(self.best.items())],
            "level string, size string, accuracy double, used boolean")

    def predict(self, df, keep=()):
        size = self.best[self.level][0]
        cut = extraction_grid(df.select("id", *keep, "text"), sizes={self.level: [int(size)]},
                              baseline=False)
        return self.heads[self.level].predict(embed(cut, self.encoder), keep)
