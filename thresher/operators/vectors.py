"""Bag of words and pooled vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from thresher.functions.columns import distinct_terms

MAX_FEATURES = 5000
RANK_BUCKETS = 32
POOLING = ("cls", "mean", "max", "hybrid")


def document_frequencies(docs: DataFrame, text: str = "text",
                         keys: Sequence[str] = ()) -> DataFrame:
    return (docs.select(*keys, F.explode(distinct_terms(text)).alias("term"))
            .groupBy(*keys, "term").agg(F.count("*").alias("df")))


def vocabulary(docs: DataFrame, text: str = "text", max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` terms found in most documents (ties: smaller term)."""
    return (document_frequencies(docs, text).orderBy(F.desc("df"), F.asc("term"))
            .limit(max_features))


def keyed_vocabulary(frequencies: DataFrame, keys: Sequence[str],
                     max_features: int = MAX_FEATURES) -> DataFrame:
    """``vocabulary`` per group: first within hash buckets of terms, then among what is left,
    so the last ranking of a group sees at most ``RANK_BUCKETS * max_features`` rows."""
    order = [F.desc("df"), F.asc("term")]
    bucket = F.pmod(F.xxhash64("term"), F.lit(RANK_BUCKETS))
    for part in ([*keys, bucket], list(keys)):
        w = Window.partitionBy(*part).orderBy(*order)
        frequencies = (frequencies.withColumn("_rank", F.row_number().over(w))
                       .where(F.col("_rank") <= max_features).drop("_rank"))
    return frequencies


def vocabulary_pairs(docs: DataFrame, id_col: str, vocab: DataFrame,
                     text: str = "text") -> DataFrame:
    """(id, term) for every vocabulary term of every document.

    The vocabulary is at most ``max_features`` rows, hence the broadcast.
    """
    return (docs.select(id_col, F.explode(distinct_terms(text)).alias("term"))
            .join(F.broadcast(vocab.select("term")), "term").select(id_col, "term"))


class BagOfWords:
    """Binary term vectors over a vocabulary fitted on one set of documents."""

    def __init__(self, max_features: int = MAX_FEATURES):
        self.max_features = max_features
        self.terms: list[str] = []
        self._model: CountVectorizerModel | None = None

    def fit(self, docs: DataFrame, text: str = "text") -> "BagOfWords":
        self.terms = sorted(r["term"] for r in
                            vocabulary(docs, text, self.max_features).select("term").collect())
        if self.terms:
            self._model = CountVectorizerModel.from_vocabulary(
                docs.sparkSession.sparkContext and self.terms, inputCol="_terms",
                outputCol="features")
            self._model.setBinary(True)
        return self

    def transform(self, docs: DataFrame, text: str = "text") -> DataFrame:
        if self._model is None:
            raise ValueError("empty vocabulary")
        with_terms = docs.withColumn("_terms", distinct_terms(text))
        return self._model.transform(with_terms).drop("_terms")


def _vector(vec: str) -> Column:
    return array_to_vector(F.col(vec))


def pool(states: DataFrame, id_col: str, strategy: str = "hybrid", pos: str = "pos",
         vec: str = "vec") -> DataFrame:
    """(id, embedding) from token states (id, pos, vec); one shuffle for any strategy.

    A masked position is a row that is not there. Sums are merged before the
    shuffle, so a long or hot id never sends its states to one task.
    """
    if strategy not in POOLING:
        raise ValueError(f"unknown pooling strategy: {strategy}")
    aggs = []
    if strategy in ("cls", "hybrid"):
        aggs.append(F.min_by(F.when(F.col(pos) == 0, F.col(vec).cast("array<double>")),
                             F.when(F.col(pos) == 0, F.col(pos))).alias("_cls"))
    if strategy in ("mean", "hybrid"):
        aggs.append(Summarizer.mean(F.col("_vector")).alias("_mean"))
    if strategy in ("max", "hybrid"):
        aggs.append(Summarizer.max(F.col("_vector")).alias("_max"))
    src = states.select(id_col, pos, vec, _vector(vec).alias("_vector"))
    pooled = src.groupBy(id_col).agg(*aggs)
    parts = {"cls": [F.col("_cls")], "mean": [vector_to_array("_mean")],
             "max": [vector_to_array("_max")],
             "hybrid": [F.col("_cls"), vector_to_array("_mean"), vector_to_array("_max")]}
    return pooled.select(id_col, F.concat(*parts[strategy]).alias("embedding"))


def fuse_levels(embeddings: DataFrame, id_col: str, levels: Sequence[str],
                strategy: str = "concatenate") -> DataFrame:
    """One vector per id from one vector per (id, level)."""
    if strategy not in ("concatenate", "average"):
        raise ValueError(f"unknown fusion strategy: {strategy}")
    wide = embeddings.groupBy(id_col).agg(*[
        F.first(F.when(F.col("level") == lv, F.col("embedding")), ignorenulls=True)
        .alias(f"_{i}") for i, lv in enumerate(levels)])
    cols = [F.col(f"_{i}") for i in range(len(levels))]
    if strategy == "concatenate":
        out = F.concat(*cols)
    else:
        out = cols[0]
        for c in cols[1:]:
            out = F.zip_with(out, c, lambda a, b: a + b)
        out = F.transform(out, lambda x: x / F.lit(float(len(levels))))
    return wide.select(id_col, out.alias("embedding"))
