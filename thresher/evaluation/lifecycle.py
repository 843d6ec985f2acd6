"""Whole analyses: from a table or a file to ranked models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from thresher.evaluation.evaluate import benchmark, evaluate_models, sorted_models
from thresher.models import registry
from thresher.models.base import Model
from thresher.operators.prepare import preprocess
from thresher.operators.rules import choose_label, with_topics
from thresher.sources.tables import open_dataset


def topic_dataset(data: DataFrame, rules, id_col: str, label: str | None = None) -> DataFrame:
    """(id, text, label) from a clean numeric table: topics and the chosen label."""
    labelled = choose_label(with_topics(data, rules), label)
    return labelled.select(labelled[id_col].alias("id"), "text", "label")


def classify(data: DataFrame, rules, models: dict[str, Model] | None = None,
             id_col: str = "patient_id", label: str | None = None, sizes=None, k: int = 5,
             **options) -> dict[str, DataFrame]:
    """Clean, extract topics, choose labels, evaluate all models over all extractions.

    Two classes or more: metrics follow the labels. Without ``label`` the topic
    counts give three classes.
    """
    clean = preprocess(data, label=label)
    texts = topic_dataset(clean, rules, id_col, label).persist()
    return benchmark(texts, models or registry.all_models(), sizes, k, **options)


def quick_evaluation(spark: SparkSession, path: str, label: str, rules,
                     models: dict[str, Model] | None = None, id_col: str = "patient_id",
                     engineer: Callable[[DataFrame], DataFrame] | None = None,
                     **options) -> dict[str, DataFrame]:
    """``classify`` on a file."""
    data = open_dataset(spark, path=path, handle_missing="drop")
    if engineer is not None:
        data = data.transform(engineer)
    if label not in data.columns:
        raise ValueError(f"no label column {label!r}")
    return classify(data, rules, models, id_col, label, **options)


def benchmark_named(data: DataFrame, names: Sequence[str], k: int = 5, **options) -> DataFrame:
    """Sorted metrics of models by name on (id, text, label) rows."""
    known = {**registry.all_models(external=True), **registry.optimized_classical_models(),
             **registry.clinical_classical_models(), **registry.optimized_ensemble_models(True),
             **registry.clinical_ensemble_models(True), **registry.stacking_models()}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    return sorted_models(evaluate_models(data, {n: known[n] for n in names}, k, **options))
