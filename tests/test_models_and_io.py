import pytest
from pyspark.sql import functions as F

from thresher.evaluation import evaluate as E
from thresher.models import registry
from thresher.models.base import DegenerateTraining, describe
from thresher.models.bayes import NaiveBayes, cross_validated_bayes
from thresher.models.ensemble import Voting, build_ensemble
from thresher.models.neighbours import nearest, vote
from thresher.models.trees import poisson_weight
from thresher.operators.folds import stratified_folds
from thresher.operators.vectors import BagOfWords, pool, vocabulary
from thresher.sources import tables as T


@pytest.fixture(scope="module")
def data(spark):
    """Topic texts where 'anemia' goes with label 1."""
    rows = []
    for i in range(120):
        words = [w for w, on in (("anemia", i % 3 == 0), ("hypoxemia", i % 2 == 0), ("oliguria", i % 5 == 0)) if on]
        rows.append((i, " ".join(words) or "normal", int(i % 3 == 0 and i % 10 != 0)))
    return spark.createDataFrame(rows, "id long, text string, label int").persist()


QUICK = ("LogisticRegression", "RidgeClassifier", "BernoulliNB", "ComplementNB", "MultinomialNB",
         "DecisionTreeClassifier", "KNeighborsClassifier", "LinearDiscriminantAnalysis",
         "QuadraticDiscriminantAnalysis", "RandomForestClassifier", "ExtraTreesClassifier")


@pytest.mark.parametrize("name", QUICK)
def test_every_row_is_predicted_once(spark, data, name):
    models = {**registry.classical_models(), **registry.ensemble_models()}
    bag = BagOfWords().fit(data)
    fitted = E.fit_model(models[name], data, bag, describe(data, len(bag.terms)))
    p = fitted.predict(bag.transform(data), ["label"]).collect()
    assert sorted(r.id for r in p) == list(range(120))
    assert all(abs(sum(r.proba) - 1) < 1e-6 for r in p)
    assert sum(r.pred == r.label for r in p) / 120 > 0.8


def test_three_classes(spark, data):
    three = data.withColumn("label", (F.col("id") % 3).cast("int")).withColumn(
        "text", F.concat(F.lit("class"), F.col("label").cast("string")))
    bag = BagOfWords().fit(three)
    ctx = describe(three, len(bag.terms))
    for m in (registry.Logistic(), registry.HingeLinear(max_iter=5), NaiveBayes(), registry.Tree(3)):
        p = E.fit_model(m, three, bag, ctx).predict(bag.transform(three), ["label"])
        assert p.where("pred <> label").count() == 0
        assert p.where(F.col("score").isNotNull()).count() == 0


def test_merged_rows_give_the_same_model(spark, data):
    bag = BagOfWords().fit(data)
    ctx = describe(data, len(bag.terms))
    m = registry.Logistic()
    merged = E.fit_model(m, data, bag, ctx).predict(bag.transform(data)).select("id", "score")
    plain = m.fit(bag.transform(data), ctx).predict(bag.transform(data)).select(
        "id", F.col("score").alias("s2"))
    assert merged.join(plain, "id").where(F.abs(F.col("score") - F.col("s2")) > 1e-3).count() == 0


def test_vote_of_one_model_is_the_model(spark, data):
    bag = BagOfWords().fit(data)
    ctx = describe(data, len(bag.terms))
    rows = bag.transform(data)
    for m in (registry.Tree(4), NaiveBayes()):
        alone = m.fit(rows, ctx).predict(rows).select("id", "pred")
        voted = Voting({"m": m}).fit(rows, ctx).predict(rows).select("id", "pred")
        assert alone.exceptAll(voted).count() == 0
    with pytest.raises(ValueError):
        build_ensemble("other")


def test_cross_validated_bayes_equals_single_fits(spark, data):
    folded = stratified_folds(data, "id", "label", 3).persist()
    for kind in ("multinomial", "bernoulli", "complement"):
        together = cross_validated_bayes(folded, kind, k=3).select("id", "pred", F.round("score", 5).alias("s"))
        for f in range(3):
            train = folded.where(F.col("fold") != f)
            single = NaiveBayes(kind).fit(train, describe(train)).predict(
                folded.where(F.col("fold") == f)).select("id", "pred", F.round("score", 5).alias("s"))
            assert single.exceptAll(together).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbours_match_brute_force(spark, metric):
    import numpy as np
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 3)) + (np.arange(300)[:, None] % 4) * 4, 2)
    x[100:200] = x[0]                           # a third of the rows are copies
    df = spark.createDataFrame([(i, i % 2, x[i].tolist()) for i in range(300)],
                               "id long, label int, vec array<double>")
    q, t = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    got = {}
    for r in nearest(q, t, 4, metric, block_rows=32).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    train = [i for i in range(300) if i % 3]
    for i in range(0, 300, 3):
        diff = np.abs(x[train] - x[i])
        d = diff.sum(axis=1) if metric == "manhattan" else np.sqrt((diff ** 2).sum(axis=1))
        want = [train[j] for j in np.lexsort((train, d))[:4]]
        assert [n for _, n in sorted(got[i])] == want


def test_exact_matches_vote_alone(spark):
    n = spark.createDataFrame([(1, 10, 0.0, 1), (1, 11, 0.001, 0), (1, 12, 0.001, 0), (2, 10, 1.0, 1), (2, 11, 1.0, 0)],
                              "id long, neighbour long, distance double, label int")
    assert {r.id: r.pred for r in vote(n, (0, 1)).collect()} == {1: 1, 2: 0}


def test_poisson_weights(spark):
    r = spark.range(20000).agg(F.avg(poisson_weight("id", 1, 0.8)), F.var_pop(poisson_weight("id", 1, 0.8))).first()
    assert abs(r[0] - 0.8) < 0.03 and abs(r[1] - 0.8) < 0.05


def test_vocabulary_ranks_by_documents(spark):
    d = spark.createDataFrame([(1, "bb bb bb bb"), (2, "aa cc"), (3, "aa dd"), (4, "x")], "id int, text string")
    assert [(r.term, r.df) for r in vocabulary(d, max_features=2).collect()] == [("aa", 2), ("bb", 1)]


def test_pooling(spark):
    s = spark.createDataFrame([(1, 0, [1.0, -5.0]), (1, 1, [3.0, -1.0]), (2, 0, [0.0, 2.0])],
                              "id int, pos int, vec array<float>")
    got = {r.id: r.embedding for r in pool(s, "id").collect()}
    assert got[1] == [1.0, -5.0, 2.0, -3.0, 3.0, -1.0] and got[2] == [0.0, 2.0] * 3
    with pytest.raises(ValueError):
        pool(s, "id", "sum")


def test_evaluation_marks_failures(spark, data):
    class Broken(registry.Model):
        def fit(self, train, ctx):
            raise RuntimeError("no")
    r = E.evaluate_models(data, {"MultinomialNB": NaiveBayes(), "Broken": Broken()}, k=3)
    assert [x.status for x in r.where("model = 'Broken'").collect()] == ["failed: RuntimeError"]
    assert r.where("model = 'MultinomialNB' and status = 'ok'").count() == 18
    with pytest.raises(DegenerateTraining):
        E.cross_validated_predictions(data.withColumn("label", F.lit(1)), {"m": NaiveBayes()})


def test_benchmark_covers_all_cells(spark, data):
    tables = E.benchmark(data, {"MultinomialNB": NaiveBayes()}, k=3)
    assert tables["scores"].count() == 13
    best = tables["best_overall"].first()
    assert (best.level, best.size) == ("paragraph", "0")        # equal extractions, first wins
    with pytest.raises(ValueError):
        E.benchmark(data.drop("label"), {})


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text\nline'), (2, None)], "id int, s string")
    for fmt in T.FORMATS:
        path = str(tmp_path / f"t.{fmt}")
        T.export(df, path, fmt)
        assert set(T.load_data(spark, path, schema="id int, s string").collect()) == set(df.collect())
    with pytest.raises(ValueError):
        T.export(df, str(tmp_path / "x"), "xlsx")
    with pytest.raises(FileNotFoundError):
        T.load_data(spark, str(tmp_path / "none.csv"))
    T.export(df, str(tmp_path / "t.dat"), "json")
    with pytest.raises(ValueError):
        T.load_data(spark, str(tmp_path / "t.dat"))
    with pytest.raises(ValueError):
        T.open_dataset(spark)


def test_every_query_is_registered_with_unique_sql():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["sphere", "far", "copies", "outlier", "zero", "short"])
def test_bounds_of_distances_lose_no_neighbour(metric, kind):
    import numpy as np
    from thresher.models.neighbours import _best
    rng = np.random.default_rng(5)
    n = 4 if kind == "short" else 900
    x = rng.normal(size=(n, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "far":
        x += 1e5                                # bounds in single precision say little here
    if kind == "copies":
        x[100:600], x[600:700] = x[0], x[1] + 1e-9 * rng.normal(size=(100, 20))
    if kind == "outlier":
        x[3], x[4] = 1e9, -1e5
    if kind == "zero":
        x[:] = 0
    fold = np.arange(n) % 3
    got = [np.concatenate(parts) for parts in zip(*_best(x, fold, x, fold, 6, metric))]
    for i in range(0, n, 7):
        diff = np.abs(x - x[i])
        d = diff.sum(axis=1) if metric == "manhattan" else np.sqrt((diff * diff).sum(axis=1))
        d[fold == fold[i]] = np.inf
        want = [j for j in np.lexsort((np.arange(n), d))[:6].tolist() if np.isfinite(d[j])]
        assert got[1][got[0] == i].tolist() == want and got[2][got[0] == i].tolist() == d[want].tolist()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_few_distances_are_measured(metric, monkeypatch):
    import numpy as np
    from thresher.models import neighbours
    x = np.random.default_rng(1).normal(size=(3000, 64))
    measured, plain = [], neighbours._measured
    monkeypatch.setattr(neighbours, "_measured", lambda a, b, m: measured.append(len(a)) or plain(a, b, m))
    none = np.full(3000, -1)
    found = [len(q) for q, _, _ in neighbours._best(x, none, x, none + 1, 5, metric)]
    assert sum(found) == 15000 and sum(measured) < 0.05 * 3000 ** 2


def test_directions_are_those_of_the_hash(spark):
    """Vectors drawn by batch equal those of Spark's own hash, piece by piece."""
    from thresher.models.embedding import WordVectorEncoder
    texts = spark.createDataFrame([(1, "alpha beta alpha ab"), (2, "\u00e9t\u00e9 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 12")],
                                  "id long, text string")
    states = WordVectorEncoder(size=5).states(texts)
    terms = spark.createDataFrame([(1, i, t) for i, t in enumerate("alpha beta alpha ab".split())] + [
        (2, i, t) for i, t in enumerate(("\u00e9t\u00e9", "x" * 45, "12"))], "id long, pos int, term string")
    marked = F.concat(F.lit("<"), "term", F.lit(">"))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - 2)), lambda i: F.substring(marked, i, F.lit(3)))
    hashes = F.transform(F.concat(F.array(marked), pieces), lambda p: F.xxhash64(p, F.lit(42)))
    want = terms.select("id", "pos", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.aggregate(
        hashes, F.lit(0.0), lambda total, h: total + F.xxhash64(h, j) / F.lit(float(2 ** 63) / 3 ** 0.5)) / F.size(hashes)).alias("want"))
    rows = states.join(want, ["id", "pos"]).collect()
    assert len(rows) == 7 and all(abs(a - b) < 1e-6 for r in rows for a, b in zip(r["vec"], r["want"]))
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan            # hashes once a term, not once a dimension


def test_user_encoders_get_small_batches(spark):
    from thresher.models.embedding import BATCH_CHARACTERS, FunctionEncoder

    def encode(batches):
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "pos": 0, "vec": [[float(len(pdf)), float(pdf["text"].str.len().sum())]] * len(pdf)})
    long = BATCH_CHARACTERS // 3
    texts = spark.range(0, 5000, 1, 1).select("id", F.when(F.col("id") % 500 == 1, F.repeat(F.lit("a"), long))
                                              .otherwise(F.lit("b")).alias("text"))
    rows = FunctionEncoder(encode, 2).states(texts).select("id", F.col("vec")[0].alias("n"), F.col("vec")[1].alias("c")).collect()
    assert sorted(r["id"] for r in rows) == list(range(5000))
    assert max(r["n"] for r in rows) <= 256 and max(r["c"] for r in rows) <= BATCH_CHARACTERS


def test_kinds_of_bayes_share_their_counts(spark, monkeypatch):
    from thresher.models import bayes
    rows = [(i, f"t{i % 3} t{i % 5} t{i % 7}", int(i % 3 == 0), i % 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string, label int, fold int")
    counted = []
    monkeypatch.setattr(bayes, "_counts", lambda *a, old=bayes._counts: counted.append(1) or old(*a))
    together = bayes.cross_validated_kinds(docs, bayes.KINDS)
    assert counted == [1]
    for kind, got in zip(bayes.KINDS, together):
        alone = bayes.cross_validated_bayes(docs, kind)
        assert got.columns == alone.columns and sorted(got.collect()) == sorted(alone.collect())


@pytest.mark.parametrize("name", ["GradientBoostingClassifier", "LGBMClassifier", "SVC"])
def test_boosting_and_machines_read_merged_rows(spark, data, monkeypatch, name):
    from thresher.models import base, histograms, linear, trees
    model = {**registry.all_models(), **registry.external_boosters()}[name]
    bag = BagOfWords().fit(data)
    ctx = describe(data, len(bag.terms))
    merged, plain = [], model.fit(base.settled(bag.transform(data).drop("text"), ctx.n), ctx)
    monkeypatch.setattr(linear, "merge_rows", lambda *a: merged.append(1) or base.merge_rows(*a))
    monkeypatch.setattr(E, "merge_rows", lambda *a: merged.append(1) or base.merge_rows(*a))
    found = E.fit_model(model, data, bag, ctx)
    rows = bag.transform(data)
    a, b = ({r["id"]: r["proba"] for r in m.predict(rows).collect()} for m in (plain, found))
    assert merged and max(abs(x - y) for i in a for x, y in zip(a[i], b[i])) < 1e-4
