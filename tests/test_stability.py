"""Results that must not depend on partitions, sizes, paths or earlier fits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from thresher.evaluation import evaluate as E
from thresher.models import registry
from thresher.models.base import describe
from thresher.models.embedding import EmbeddingClassifier, FunctionEncoder, MultilevelClassifier, WordVectorEncoder
from thresher.models.linear import HingeLinear, Ridge
from thresher.models.trees import poisson_weight
from thresher.operators.rules import rule_table, topics_by_join, topics_from_table
from thresher.operators.vectors import BagOfWords, document_frequencies, keyed_vocabulary


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        label = int(i % 4 == 0)
        words = rng.choice([f"t{j}" for j in range(30)], 6).tolist() + ["mark"] * label * int(i % 12 > 0)
        rows.append((i, " ".join(words), label))
    return spark.createDataFrame(rows, "id long, text string, label int").persist()


@pytest.mark.parametrize("name", ["RandomForestClassifier", "GradientBoostingClassifier", "ExtraTreesClassifier"])
def test_tree_scores_do_not_depend_on_partitions(spark, docs, name):
    bag = BagOfWords().fit(docs)
    model = registry.ensemble_models()[name]
    got = []
    for parts in (1, 6):
        train = docs.repartition(parts)
        fitted = E.fit_model(model, train, bag, describe(train, len(bag.terms)))
        got.append({r.id: r.score for r in fitted.predict(bag.transform(docs)).collect()})
    assert max(abs(got[0][i] - got[1][i]) for i in got[0]) < 1e-9


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + rng.normal(size=60) > 1.2).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(60)]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame(rows, "id long, label int, a double, b double, c double"))
    t = 2.0 * y - 1
    xc = x - x.mean(0)
    beta = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (t - t.mean()))
    expected = t.mean() + xc @ beta
    got = {r.id: r.score for r in Ridge().fit(df, describe(df, 3)).predict(df).collect()}
    assert max(abs(got[i] - expected[i]) for i in range(60)) < 1e-8


def test_hinge_is_at_its_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = np.where(x @ [1.0, -2.0] + rng.normal(size=80) > 0, 1, 0)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(
        [(i, int(y[i]), *map(float, x[i])) for i in range(80)], "id long, label int, a double, b double"))
    fitted = HingeLinear(C=1.0).fit(df, describe(df, 2))
    scores = np.array([r.score for r in fitted.predict(df).orderBy("id").collect()])
    t = 2 * y - 1
    w = np.linalg.lstsq(np.hstack([x, np.ones((80, 1))]), scores, rcond=None)[0]

    def objective(v):
        return np.maximum(0, 1 - t * (x @ v[:2] + v[2])).mean() + 0.5 / 80 * v[:2] @ v[:2]
    best, v = objective(w), w.copy()
    for step in range(20_000):      # subgradient descent from there finds nothing better
        active = t * (x @ v[:2] + v[2]) < 1
        g = np.append(-(t * active) @ x / 80 + v[:2] / 80, -(t * active).mean())
        v = v - 0.05 / (1 + step) ** 0.5 * g
        best = min(best, objective(v))
    assert objective(w) <= best * 1.001


def test_rule_paths_agree_on_repeated_ids(spark):
    rows = [(1, 5.0, "a"), (1, 50.0, None), (2, 0.5, "b"), (2, 0.5, "b"), (None, 9.0, "c")]
    df = spark.createDataFrame(rows, "id long, v double, s string")
    rules = rule_table(spark, {"hi": ("v", ">", 1.0), "vhi": ("v", ">", 10.0), "text": ("s", "!=", 1.0)})
    inline = sorted(map(tuple, topics_from_table(df, "id", rules).collect()), key=str)
    joined = sorted(map(tuple, topics_by_join(df, "id", rules).collect()), key=str)
    assert inline == joined and len(inline) == 5


def test_encoders_hold_nothing_and_know_every_term(spark, docs):
    encoder = WordVectorEncoder(size=8)
    first = {(r.id, r.pos): r.vec for r in encoder.fit(docs).states(docs).collect()}
    other = spark.createDataFrame([(1, "never seen words", 0)], "id long, text string, label int")
    encoder.fit(other)
    again = {(r.id, r.pos): r.vec for r in encoder.states(docs).collect()}
    assert first == again
    assert all(any(r.vec) for r in encoder.states(other).collect())


def test_embedding_models_take_a_users_encoder_and_any_id(spark, docs):
    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, p, [float(w == "mark"), 1.0]) for i, t in zip(pdf["id"], pdf["text"])
                                for p, w in enumerate(t.split())], columns=["id", "pos", "vec"])
    named = docs.withColumn("id", F.concat(F.lit("k"), F.col("id").cast("string")))
    for data in (docs, named):
        fitted = EmbeddingClassifier(encoder=FunctionEncoder(encode, 2)).fit(data, describe(data))
        assert fitted.predict(data, ["label"]).where("pred = label").count() > 135
    levels = MultilevelClassifier({"word": [5], "paragraph": [0]}, encoder=FunctionEncoder(encode, 2))
    fitted = levels.fit(docs, describe(docs))
    assert fitted.predict(docs, ["label"]).count() == 150


def test_poisson_table_reaches_large_rates(spark):
    r = spark.range(20_000).select(poisson_weight("id", 3, 25.0).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(r[0] - 25) < 0.2 and abs(r[1] - 25) < 1.0


def test_keyed_vocabulary_ranks_in_two_steps(spark, docs):
    found = document_frequencies(docs, keys=["label"])
    got = keyed_vocabulary(found, ["label"], 7)
    for label in (0, 1):
        best = sorted(((-r.df, r.term) for r in found.where(f"label = {label}").collect()))[:7]
        assert sorted((-r.df, r.term) for r in got.where(f"label = {label}").collect()) == best
