import statistics

import pytest
from pyspark.sql import functions as F

from thresher.operators import agreement as G, metrics as M, prepare as P, ranking as K
from thresher.operators.folds import stratified_folds
from thresher.operators.ordering import exact_quantiles, running_sums, shuffled_row_number


def test_fill_median_and_mode(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1.0, "b", None), (2.0, "b", None), (3.0, "a", None), (10.0, "a", None), (nan, None, None)],
        "x double, s string, empty string")
    rows = P.fill_missing(df).collect()
    assert [r for r in rows if r.x == 2.5][0].s == "a"
    assert {r.empty for r in rows} == {"unknown"}


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 1.0)], "id int, x double")
    assert P.drop_duplicates(df).count() == 2
    assert P.drop_missing(df).count() == 1
    v = {(r["column"], r["statistic"]): r["value"] for r in P.validate(df).collect()}
    assert v["x", "missing"] == "2" and v["", "duplicates"] == "1" and v["", "rows"] == "3"


def test_label_cast(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,)], "y double")
    assert [r.y for r in P.cast_label(df, "y").collect()] == [1, -1]
    with pytest.raises(Exception, match="missing label"):
        P.cast_label(spark.createDataFrame([(float("nan"),)], "y double"), "y").collect()


def test_cut_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (0.8,)], "x double")
    c = P.cut("x", [0, 0.3, 0.7], ["mild", "moderate"])
    assert [r[0] for r in df.select(c).collect()] == [None, "mild", "moderate", None]


@pytest.mark.parametrize("hot", [False, True])
def test_quantiles_match_brute_force(spark, hot):
    values = [(i * 7919) % 997 / 7.0 for i in range(3000)] + ([5.0] * 2000 if hot else [])
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("k", F.lit(1))
    r = exact_quantiles(df, ["k"], "x", {"q": 0.25, "m": 0.5}).first()
    assert r.m == pytest.approx(statistics.median(values))
    assert r.q == pytest.approx(statistics.quantiles(values, n=4, method="inclusive")[0])


def test_running_sums_match_brute_force(spark):
    data = [(g, (i * 31) % 1009, i % 5) for g in (0, 1) for i in range(1009)]
    df = spark.createDataFrame(data, "g int, v int, n int")
    got = {(r.g, r.v): (r.n_before, r.n_total) for r in
           running_sums(df, ["g"], "v", ["n"], splitters=16).collect()}
    for g in (0, 1):
        rows = sorted((v, n) for gg, v, n in data if gg == g)
        total, before = sum(n for _, n in rows), 0
        for v, n in rows:
            assert got[g, v] == (before, total)
            before += n


def test_row_numbers_with_a_hot_group(spark):
    df = spark.range(5000).withColumn("g", (F.col("id") % 10 == 0).cast("int"))
    numbered = shuffled_row_number(df, ["g"], "id", 42, "r", digits=1)
    for g, n in ((0, 4500), (1, 500)):
        rows = [r.r for r in numbered.where(F.col("g") == g).collect()]
        assert sorted(rows) == list(range(1, n + 1))


def test_folds_and_split(spark):
    df = spark.range(103).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    folds = stratified_folds(df, "id", "label", 5)
    assert folds.count() == 103
    for label in (0, 1):
        sizes = [r["count"] for r in folds.where(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert folds.exceptAll(stratified_folds(df.repartition(7), "id", "label", 5)).count() == 0
    split = P.train_test_split(df, "id", "label")
    assert {(r.label, r["count"]) for r in split.where("split = 'test'").groupBy("label").count().collect()} == {
        (0, 15), (1, 5)}


ROWS = [(1, .9), (0, .8), (1, .7), (0, .7), (1, .2), (0, .1)]


def test_auc_and_average_precision(spark):
    df = spark.createDataFrame([(y, s) for y, s in ROWS], "label int, score double").withColumn("m", F.lit(1))
    r = M.ranking_metrics(df, ["m"]).first()
    assert round(r.roc_auc, 6) == 0.611111 and round(r.pr_auc, 6) == 0.7


def test_auc_equals_spark_ml(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df = spark.range(500).select(
        (F.col("id") % 3 == 0).cast("int").alias("label"),
        ((F.col("id") * 37) % 41 / 41.0 + F.col("id") % 3 * 0.1).alias("score"), F.lit(1).alias("m"))
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert M.ranking_metrics(df, ["m"]).first().roc_auc == pytest.approx(ml)


def test_one_class_is_degenerate(spark):
    df = spark.createDataFrame([("m", 0, 1, 1, .5), ("m", 0, 1, 0, .4)],
                               "model string, fold int, label int, pred int, score double")
    got = {r.metric: (r.value, r.status) for r in M.fold_metrics(df, ["model"]).collect()}
    assert got["roc_auc"] == (None, "degenerate") and got["accuracy"] == (0.5, "ok")


def test_macro_average_beyond_two_classes(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 1, 1), ("m", 2, 1), ("m", 2, 2)],
                               "model string, label int, pred int")
    r = M.threshold_metrics(df, ["model"]).first()
    assert r.accuracy == 0.75 and r.recall == pytest.approx((1 + 1 + .5) / 3)


SCORES = "model string, model_ord int, level string, size string, size_ord int, score double"


def test_winner_ties(spark):
    s = spark.createDataFrame([
        ("A", 0, "word", "5", 0, .9), ("B", 1, "word", "5", 0, .9), ("A", 0, "word", "10", 1, .9),
        ("B", 1, "paragraph", "0", 0, .9), ("A", 0, "paragraph", "1", 1, .9)], SCORES)
    best = K.best_overall(s).first()
    assert (best.level, best.size, best.model) == ("paragraph", "0", "B")     # size before model
    rep = K.report_best(s).first()
    assert (rep.level, rep.size, rep.model) == ("paragraph", "1", "A")        # model before size
    assert {(r.level, r.model, r.size) for r in K.best_per_level(s).collect()} == {
        ("word", "A", "5"), ("paragraph", "B", "0")}


def test_categories(spark):
    names = {"BERT-Ensemble": "bert_based", "VotingClassifier_Basic": "ensemble",
             "OptimizedLightGBM": "classical", "StackingClassifier_LR": "classical",
             "ClinicalSVM": "classical", "XGBClassifier": "ensemble"}
    df = spark.createDataFrame([(n,) for n in names], "model string")
    assert {r.model: r.c for r in df.select("model", K.model_category().alias("c")).collect()} == names


def test_improvement_needs_both_sides(spark):
    s = spark.createDataFrame([("SVC", 0, "word", "5", 0, .5), ("BERT-LR", 1, "word", "5", 0, .6)], SCORES)
    rows = K.improvements(s).collect()
    assert len(rows) == 1 and rows[0].relative_improvement == pytest.approx(20.0)


def test_yule_q_skips_zero_denominators(spark):
    rows = [("a", 1, 1, 1), ("b", 1, 1, 1), ("a", 2, 1, 1), ("b", 2, 1, 1)]
    p = spark.createDataFrame(rows, "model string, id int, label int, pred int")
    pairs = G.model_pairs(p)
    assert G.pairwise_diversity(pairs).first().q_statistic is None
    assert G.yule_q(pairs).first()[0] == 0.0
    with pytest.raises(Exception, match="at least 2"):
        G.accuracy_spread(p.where("model = 'a'")).collect()
