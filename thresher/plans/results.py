"""Metrics, winners, rankings and reports over deterministic predictions of all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.operators import advice, agreement as G, metrics as M, ranking as K
from thresher.operators.folds import stratified_folds
from thresher.operators.ordering import running_sums
from thresher.plans.common import (AP_SQL, AUC_SQL, CELLS_SQL, MODELS, ORACLES, PREDS_SQL, RESULTS_SQL,
                                   SCORES_SQL, SUMMARY_SQL, cell_predictions, predictions, query,
                                   results, scores, summary, table)
from thresher.session import cut_lineage


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("A1_cross_validated", "WITH " + RESULTS_SQL + """ SELECT model, level, size, metric,
  round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS folds
  FROM metrics GROUP BY model, level, size, metric""")
def _(spark, sf):
    return rounded(K.cross_validated(results(spark, sf)), "mean", "std")


@query("A2_threshold_metrics", "WITH " + PREDS_SQL + """ SELECT model, fold,
  round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
  round(coalesce(count(*) FILTER (label = 1 AND pred = 1)::DOUBLE / nullif(count(*) FILTER (pred = 1), 0), 0), 6) AS precision,
  round(coalesce(count(*) FILTER (label = 1 AND pred = 1)::DOUBLE / nullif(count(*) FILTER (label = 1), 0), 0), 6) AS recall,
  round(coalesce(2.0::DOUBLE * count(*) FILTER (label = 1 AND pred = 1)
    / nullif(count(*) FILTER (pred = 1) + count(*) FILTER (label = 1), 0), 0), 6) AS f1
  FROM preds GROUP BY model, fold""")
def _(spark, sf):
    return rounded(M.threshold_metrics(predictions(spark, sf), ["model", "fold"]),
                   "accuracy", "precision", "recall", "f1")


@query("A3_roc_auc", "WITH " + PREDS_SQL + ", " + AUC_SQL + """ SELECT model, fold, round(value, 6) AS roc_auc FROM auc""")
def _(spark, sf):
    return rounded(M.ranking_metrics(predictions(spark, sf), ["model", "fold"]), "roc_auc").drop("pr_auc")


@query("A4_pr_auc", "WITH " + PREDS_SQL + ", " + AP_SQL + """ SELECT model, fold, round(value, 6) AS pr_auc FROM ap""")
def _(spark, sf):
    return rounded(M.ranking_metrics(predictions(spark, sf), ["model", "fold"]), "pr_auc").drop("roc_auc")


@query("W3_average_ranks", "WITH " + PREDS_SQL + """ SELECT DISTINCT model, fold, score, rank() OVER (PARTITION BY model, fold ORDER BY score)
  + (count(*) OVER (PARTITION BY model, fold, score) - 1) / 2.0::DOUBLE AS avg_rank FROM preds""")
def _(spark, sf):
    counts = predictions(spark, sf).groupBy("model", "fold", "score").agg(F.count("*").alias("n"))
    r = running_sums(counts, ["model", "fold"], "score", ["n"])
    return r.select("model", "fold", "score",
                    (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"))


@query("W4_running_counts", "WITH " + PREDS_SQL + ", " + AP_SQL + """ SELECT model, fold, score,
  CAST(tp AS BIGINT) AS tp, CAST(seen AS BIGINT) AS seen FROM running""")
def _(spark, sf):
    counts = predictions(spark, sf).groupBy("model", "fold", "score").agg(
        F.sum("label").alias("pos"), F.count("*").alias("n"))
    r = running_sums(counts, ["model", "fold"], "score", ["pos", "n"])
    return r.select("model", "fold", "score", (F.col("pos_total") - F.col("pos_before")).alias("tp"),
                    (F.col("n_total") - F.col("n_before")).alias("seen"))


# three classes: order status against a price band
THREE_SQL = """p3 AS (SELECT o_orderkey AS id, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INT) AS label,
  CAST(CASE WHEN o_totalprice < 150000 THEN 0 WHEN o_totalprice < 350000 THEN 1 ELSE 2 END AS INT) AS pred FROM orders)"""


def three_classes(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"),
        F.when(F.col("o_totalprice") < 150000, 0).when(F.col("o_totalprice") < 350000, 1).otherwise(2).alias("pred"))


@query("A5_confusion_matrix", "WITH " + PREDS_SQL + """, grid AS (SELECT DISTINCT model, a.v AS label, b.v AS pred FROM preds
  CROSS JOIN (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) b(v)), c AS (SELECT model, label, pred, count(*) AS n FROM preds GROUP BY ALL)
SELECT model, CAST(label AS INT) AS label, CAST(pred AS INT) AS pred, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (model, label, pred)""")
def _(spark, sf):
    return M.confusion_matrix(predictions(spark, sf), ["model"])


@query("A5_confusion_three_classes", "WITH " + THREE_SQL + """ SELECT CAST(a.v AS INT) AS label, CAST(b.v AS INT) AS pred,
  (SELECT count(*) FROM p3 WHERE label = a.v AND pred = b.v) AS n FROM (VALUES (0), (1), (2)) a(v) CROSS JOIN (VALUES (0), (1), (2)) b(v)""")
def _(spark, sf):
    return M.confusion_matrix(three_classes(spark, sf))


@query("A6_classification_report", "WITH " + THREE_SQL + """, cls AS (SELECT v AS c,
  count(*) FILTER (label = v AND pred = v)::DOUBLE AS tp, count(*) FILTER (pred = v)::DOUBLE AS pp, count(*) FILTER (label = v)::DOUBLE AS s
  FROM p3 CROSS JOIN (VALUES (0), (1), (2)) k(v) GROUP BY v),
m AS (SELECT c, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r, coalesce(2 * tp / nullif(pp + s, 0), 0) AS f, s FROM cls)
SELECT CAST(c AS VARCHAR) AS row, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM m
UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS a, count(*) AS n FROM p3)
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM m""")
def _(spark, sf):
    return rounded(M.classification_report(three_classes(spark, sf)), "precision", "recall", "f1")


@query("A7_metric_statistics", "WITH " + SUMMARY_SQL + """ SELECT metric, round(avg(mean), 6) AS mean,
  round(stddev_samp(mean), 6) AS std, round(min(mean), 6) AS min, round(max(mean), 6) AS max,
  round(max(mean) - min(mean), 6) AS range FROM summary GROUP BY metric""")
def _(spark, sf):
    return rounded(K.metric_statistics(summary(spark, sf)), "mean", "std", "min", "max", "range")


@query("A8_best_per_model", "WITH " + SCORES_SQL + " SELECT model, max(score) AS best_score FROM scores GROUP BY model")
def _(spark, sf):
    return K.best_per_model(scores(spark, sf))


PICK = "SELECT {cols} FROM scores QUALIFY row_number() OVER ({part} ORDER BY score DESC, {order}) = 1"


@query("A9_best_per_level", "WITH " + SCORES_SQL + " " + PICK.format(
    cols="level, model, size, score", part="PARTITION BY level", order="size_ord, model_ord"))
def _(spark, sf):
    return K.best_per_level(scores(spark, sf))


OVERALL_SQL = "WITH " + SCORES_SQL + " " + PICK.format(
    cols="model, level, size, score", part="", order="level_ord, size_ord, model_ord")


@query("A10_best_overall", OVERALL_SQL)
def _(spark, sf):
    return K.best_overall(scores(spark, sf))


@query("V7_best_model", OVERALL_SQL)
def _(spark, sf):
    return K.best_overall(scores(spark, sf))


@query("A11_report_best", "WITH " + SCORES_SQL + " " + PICK.format(
    cols="model, level, size, score", part="", order="level_ord, model_ord, size_ord"))
def _(spark, sf):
    return K.report_best(scores(spark, sf))


@query("A12_best_per_category", "WITH " + SCORES_SQL + " " + PICK.format(
    cols="category, model, level, size, score", part="PARTITION BY category",
    order="level_ord, model_ord, size_ord"))
def _(spark, sf):
    return K.best_per_category(scores(spark, sf))


GAIN_SQL = """best AS (SELECT max(score) FILTER (category = 'classical') AS c, max(score) FILTER (category = 'bert_based') AS b,
  max(score) FILTER (category = 'ensemble') AS e FROM scores),
gains AS (SELECT 'bert_vs_classical' AS comparison, c AS classical_best, b AS other_best FROM best
  UNION ALL SELECT 'ensemble_vs_classical', c, e FROM best)"""


@query("A13_improvements", "WITH " + SCORES_SQL + ", " + GAIN_SQL + """ SELECT comparison, classical_best, other_best,
  round(other_best - classical_best, 6) AS absolute_improvement,
  round((other_best - classical_best) / classical_best * 100, 6) AS relative_improvement FROM gains WHERE classical_best > 0""")
def _(spark, sf):
    return rounded(K.improvements(scores(spark, sf)), "absolute_improvement", "relative_improvement")


@query("A14_evaluation_count", "WITH " + SCORES_SQL + " SELECT count(*) AS total_model_evaluations FROM scores")
def _(spark, sf):
    return K.evaluation_count(scores(spark, sf))


PAIR_SQL = """pairs AS (SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, count(*) FILTER (a.pred <> b.pred) AS differ,
  count(*) FILTER (a.pred = a.label AND b.pred = b.label) AS n11, count(*) FILTER (a.pred = a.label AND b.pred <> b.label) AS n10,
  count(*) FILTER (a.pred <> a.label AND b.pred = b.label) AS n01, count(*) FILTER (a.pred <> a.label AND b.pred <> b.label) AS n00
  FROM preds a JOIN preds b ON a.id = b.id AND a.model < b.model GROUP BY 1, 2),
q AS (SELECT differ::DOUBLE / n AS d, abs((n11 * n00 - n01 * n10)::DOUBLE / nullif(n11 * n00 + n01 * n10, 0)) AS q FROM pairs)"""


@query("J2_model_pairs", "WITH " + PREDS_SQL + ", " + PAIR_SQL + " SELECT * FROM pairs")
def _(spark, sf):
    return G.model_pairs(predictions(spark, sf))


@query("A15_disagreement", "WITH " + PREDS_SQL + ", " + PAIR_SQL + """ SELECT round(avg(d), 6) AS average_disagreement,
  round(max(d), 6) AS max_disagreement, round(min(d), 6) AS min_disagreement FROM q""")
def _(spark, sf):
    d = G.disagreement(G.model_pairs(predictions(spark, sf)))
    return rounded(d, *d.columns)


@query("A16_yule_q", "WITH " + PREDS_SQL + ", " + PAIR_SQL + " SELECT round(coalesce(avg(q), 0), 6) AS average_q_statistic FROM q")
def _(spark, sf):
    return rounded(G.yule_q(G.model_pairs(predictions(spark, sf))), "average_q_statistic")


@query("A17_diversity", "WITH " + PREDS_SQL + ", " + PAIR_SQL + """, a AS (SELECT model,
  avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM preds GROUP BY model)
SELECT round(avg(d), 6) AS average_disagreement, round(max(d), 6) AS max_disagreement, round(min(d), 6) AS min_disagreement,
  round(coalesce(avg(q), 0), 6) AS average_q_statistic, (SELECT count(*) FROM a) AS models,
  (SELECT round(stddev_pop(accuracy), 6) FROM a) AS accuracy_std FROM q""")
def _(spark, sf):
    return rounded(G.diversity(predictions(spark, sf)), "average_disagreement", "max_disagreement",
                   "min_disagreement", "average_q_statistic", "accuracy_std")


@query("A17_accuracies", "WITH " + PREDS_SQL + """ SELECT model, round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)
  AS accuracy FROM preds GROUP BY model""")
def _(spark, sf):
    return rounded(G.model_accuracies(predictions(spark, sf)), "accuracy")


@query("A17_accuracy_spread", "WITH " + PREDS_SQL + """, a AS (SELECT model, avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  AS accuracy FROM preds GROUP BY model) SELECT count(*) AS models, round(stddev_pop(accuracy), 6) AS accuracy_std FROM a""")
def _(spark, sf):
    return rounded(G.accuracy_spread(predictions(spark, sf)), "accuracy_std")


# ---- characteristics of many datasets: lines per flag, events per type, customers per nation ----

CHARACTERISTICS_SQL = """cells AS (
  SELECT 'lines_' || l_returnflag AS dataset, CAST(l_discount > 0.08 AS INT) AS label, 3 AS d,
    CAST(l_quantity = 0 AS INT) + CAST(l_discount = 0 AS INT) + CAST(l_tax = 0 AS INT) AS z FROM lineitem
  UNION ALL SELECT 'events_' || event_type, CAST(value > 50 AS INT), 1, CAST(value = 0 AS INT) FROM events
  UNION ALL SELECT 'nation_' || c_nationkey, CAST(c_acctbal > 4000 AS INT), 2,
    CAST(c_acctbal = 0 AS INT) + CAST(c_nationkey = 0 AS INT) FROM customer),
per AS (SELECT dataset, label, max(d) AS d, count(*) AS n, sum(z) AS z FROM cells GROUP BY 1, 2),
c AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS n_samples, CAST(max(d) AS INT) AS n_features,
  sum(z)::DOUBLE / (sum(n) * max(d)) AS sparsity, min(n)::DOUBLE / max(n) AS class_balance FROM per GROUP BY 1)"""


def characteristics(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("lines_"), "l_returnflag").alias("dataset"), "l_quantity", "l_discount", "l_tax",
        (F.col("l_discount") > 0.08).cast("int").alias("label"))
    events = table(spark, sf, "events").select(
        F.concat(F.lit("events_"), "event_type").alias("dataset"), "value",
        (F.col("value") > 50).cast("int").alias("label"))
    people = table(spark, sf, "customer").select(
        F.concat(F.lit("nation_"), "c_nationkey").alias("dataset"), "c_acctbal", "c_nationkey",
        (F.col("c_acctbal") > 4000).cast("int").alias("label"))
    out = None
    for df, features in ((lines, ["l_quantity", "l_discount", "l_tax"]), (events, ["value"]),
                         (people, ["c_acctbal", "c_nationkey"])):
        c = advice.table_characteristics(df, features, "label", ["dataset"])
        out = c if out is None else out.unionByName(c)
    return out


@query("A18_characteristics", "WITH " + CHARACTERISTICS_SQL + """ SELECT dataset, n_samples, n_features,
  round(sparsity, 6) AS sparsity, round(class_balance, 6) AS class_balance FROM c""")
def _(spark, sf):
    return rounded(characteristics(spark, sf), "sparsity", "class_balance")


@query("A18_text_characteristics", r"""WITH d AS (SELECT quality, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS t
  FROM documents JOIN labels USING (doc_id)), v AS (SELECT count(DISTINCT x) AS w FROM (SELECT unnest(t) AS x FROM d)),
b AS (SELECT min(n)::DOUBLE / max(n) AS class_balance FROM (SELECT count(*) AS n FROM d GROUP BY quality))
SELECT count(*) AS n_samples, CAST(max(w) AS INT) AS n_features, round(1 - sum(len(t))::DOUBLE / (count(*) * max(w)), 6) AS sparsity,
  round(max(class_balance), 6) AS class_balance FROM d CROSS JOIN v CROSS JOIN b""")
def _(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rounded(advice.text_characteristics(docs, "text", "quality"), "sparsity", "class_balance")


def _case(*conditions: str) -> str:
    return " + ".join(f"CASE WHEN {c.split(' -> ')[0]} THEN {c.split(' -> ')[1]} ELSE 0 END" for c in conditions)


@query("A19_suitability", "WITH " + CHARACTERISTICS_SQL + " " + " UNION ALL ".join(
    f"SELECT dataset, '{m}' AS model, greatest(0, least(1, round(({b} + {_case(*c)})::DOUBLE, 6))) AS score FROM c"
    for m, b, c in (
        ("LogisticRegression", 0.8, ("n_samples < 1000 -> -0.1", "class_balance < 0.3 -> -0.1")),
        ("SVC", 0.7, ("n_samples > 5000 -> -0.2", "n_features > n_samples -> 0.1", "sparsity > 0.5 -> 0.1")),
        ("MultinomialNB", 0.6, ("sparsity > 0.3 -> 0.2", "n_samples < 500 -> 0.1", "class_balance < 0.2 -> -0.2")),
        ("DecisionTreeClassifier", 0.6, ("n_features < 50 -> 0.1", "class_balance < 0.3 -> -0.1")),
        ("KNeighborsClassifier", 0.5, ("n_samples < 1000 -> 0.2", "n_features > 100 -> -0.2", "sparsity > 0.5 -> -0.2")),
        ("MLPClassifier", 0.4, ("n_samples > 2000 -> 0.3", "n_features > 50 -> 0.2", "class_balance < 0.2 -> -0.2")))))
def _(spark, sf):
    return advice.suitability(characteristics(spark, sf), ["dataset"])


_BALANCED = "CASE WHEN class_balance < 0.3 THEN 'balanced' END"
_SETTINGS_SQL = {
    ("LogisticRegression", "C"): "CASE WHEN n_samples < 500 THEN '0.1' WHEN n_samples > 5000 THEN '10.0' ELSE '1.0' END",
    ("LogisticRegression", "class_weight"): _BALANCED,
    ("LogisticRegression", "max_iter"): "CAST(least(2000, greatest(1000, n_samples // 10)) AS VARCHAR)",
    ("SVC", "C"): "CASE WHEN n_features > n_samples THEN '0.1' ELSE '1.0' END",
    ("SVC", "kernel"): "CASE WHEN n_samples < 1000 THEN 'linear' ELSE 'rbf' END",
    ("SVC", "class_weight"): _BALANCED,
    ("DecisionTreeClassifier", "max_depth"): "CASE WHEN n_samples < 500 THEN '5' WHEN n_samples > 5000 THEN '15' ELSE '10' END",
    ("DecisionTreeClassifier", "min_samples_split"): "CASE WHEN n_samples < 500 THEN '20' WHEN n_samples > 5000 THEN '10' ELSE '15' END",
    ("DecisionTreeClassifier", "class_weight"): _BALANCED,
    ("MLPClassifier", "hidden_layer_sizes"): "CASE WHEN n_samples < 1000 THEN '50' WHEN n_samples > 5000 THEN '200,100' ELSE '100' END",
    ("MLPClassifier", "alpha"): "CASE WHEN n_features > n_samples THEN '0.01' ELSE '0.001' END",
    ("MLPClassifier", "max_iter"): "CAST(least(1000, greatest(500, n_samples // 5)) AS VARCHAR)",
    ("RandomForestClassifier", "n_estimators"): "CASE WHEN n_samples < 1000 THEN '50' WHEN n_samples > 10000 THEN '200' ELSE '100' END",
    ("RandomForestClassifier", "max_features"): "CASE WHEN n_features < 10 THEN 'None' ELSE 'sqrt' END",
    ("RandomForestClassifier", "class_weight"): _BALANCED,
    ("RandomForestClassifier", "max_depth"): "CASE WHEN n_samples < 500 THEN '5' ELSE '10' END",
    ("RandomForestClassifier", "min_samples_split"): "CASE WHEN n_samples < 500 THEN '20' ELSE '10' END",
    ("GradientBoostingClassifier", "n_estimators"): "CASE WHEN n_samples < 1000 THEN '50' WHEN n_samples > 5000 THEN '200' ELSE '100' END",
    ("GradientBoostingClassifier", "learning_rate"): "CASE WHEN n_samples > 5000 THEN '0.05' ELSE '0.1' END",
    ("GradientBoostingClassifier", "max_depth"): "CASE WHEN n_features < 20 THEN '3' ELSE '6' END",
    ("GradientBoostingClassifier", "subsample"): "CASE WHEN n_samples < 1000 THEN '1.0' ELSE '0.8' END",
    ("GradientBoostingClassifier", "min_samples_split"): "CASE WHEN n_samples < 1000 THEN '20' ELSE '10' END",
    ("XGBClassifier", "n_estimators"): "CASE WHEN n_samples < 1000 THEN '50' WHEN n_samples > 10000 THEN '300' ELSE '100' END",
    ("XGBClassifier", "learning_rate"): "CASE WHEN n_samples > 10000 THEN '0.03' ELSE '0.1' END",
    ("XGBClassifier", "max_depth"): "CASE WHEN n_samples < 1000 THEN '3' WHEN n_samples > 10000 THEN '8' ELSE '6' END",
    ("XGBClassifier", "reg_alpha"): "CASE WHEN n_features > n_samples THEN '0.1' END",
    ("XGBClassifier", "reg_lambda"): "CASE WHEN n_features > n_samples THEN '0.1' END",
    ("XGBClassifier", "subsample"): "'0.8'", ("XGBClassifier", "colsample_bytree"): "'0.8'",
    ("LGBMClassifier", "n_estimators"): "CASE WHEN n_samples < 1000 THEN '50' ELSE '100' END",
    ("LGBMClassifier", "learning_rate"): "'0.1'",
    ("LGBMClassifier", "max_depth"): "CASE WHEN n_samples < 1000 THEN '3' ELSE '6' END",
    ("LGBMClassifier", "num_leaves"): "CASE WHEN n_samples < 1000 THEN '15' ELSE '31' END",
    ("LGBMClassifier", "subsample"): "'0.8'", ("LGBMClassifier", "colsample_bytree"): "'0.8'",
}


@query("A20_suggested_settings", "WITH " + CHARACTERISTICS_SQL + ", s AS (" + " UNION ALL ".join(
    f"SELECT dataset, '{m}' AS model, '{p}' AS param, {e} AS value FROM c" for (m, p), e in _SETTINGS_SQL.items())
    + ") SELECT * FROM s WHERE value IS NOT NULL")
def _(spark, sf):
    return advice.suggested_settings(characteristics(spark, sf), ["dataset"])


@query("A21_recommendation", "WITH " + CHARACTERISTICS_SQL + """ SELECT dataset, 'primary' AS kind,
  CASE WHEN n_samples < 1000 THEN 'RandomForestClassifier' ELSE 'GradientBoostingClassifier' END AS model,
  CASE WHEN n_samples < 1000 THEN 'Random Forest works well with small datasets and provides good baseline performance'
    ELSE 'Gradient Boosting provides good performance when XGBoost is not available' END AS reason FROM c
UNION ALL SELECT dataset, 'secondary', CASE WHEN class_balance < 0.3 THEN 'VotingClassifier'
    WHEN n_features > n_samples THEN 'RandomForestClassifier' ELSE 'ExtraTreesClassifier' END,
  CASE WHEN class_balance < 0.3 THEN 'Voting ensemble can help with imbalanced data by combining diverse models'
    WHEN n_features > n_samples THEN 'Random Forest handles high-dimensional data well'
    ELSE 'Extra Trees provides good alternative with more randomness' END FROM c
UNION ALL SELECT dataset, 'clinical', 'ClinicalRandomForest',
  'Designed specifically for clinical data with interpretability and stability in mind' FROM c""")
def _(spark, sf):
    return advice.ensemble_recommendation(characteristics(spark, sf), ["dataset"])


@query("A22_summary_report", "WITH " + SUMMARY_SQL + """, rs AS (SELECT model, metric, round(mean, 6) AS mean, std FROM summary),
stats AS (SELECT metric, avg(mean) AS mean, stddev_samp(mean) AS std,
  min(mean) AS min, max(mean) AS max, max(mean) - min(mean) AS range FROM rs GROUP BY metric),
best AS (SELECT * FROM rs WHERE metric = 'accuracy' ORDER BY mean DESC, model LIMIT 1),
r AS (SELECT metric, model, rank() OVER (PARTITION BY metric ORDER BY mean DESC) AS k FROM rs WHERE metric IN ('accuracy', 'f1', 'roc_auc'))
SELECT 'totals' AS section, '' AS item, 'models' AS statistic, count(DISTINCT model)::DOUBLE AS value FROM summary
UNION ALL SELECT 'totals', '', 'metrics', count(DISTINCT metric)::DOUBLE FROM summary
UNION ALL SELECT 'best_model', model, 'accuracy', round(mean, 6) FROM best UNION ALL SELECT 'best_model', model, 'std', round(std, 6) FROM best
UNION ALL SELECT 'statistics', metric, 'mean', round(mean, 6) FROM stats UNION ALL SELECT 'statistics', metric, 'std', round(std, 6) FROM stats
UNION ALL SELECT 'statistics', metric, 'min', round(min, 6) FROM stats UNION ALL SELECT 'statistics', metric, 'max', round(max, 6) FROM stats
UNION ALL SELECT 'statistics', metric, 'range', round(range, 6) FROM stats
UNION ALL SELECT 'ranking_' || metric, model, 'rank', k::DOUBLE FROM r""")
def _(spark, sf):
    return rounded(K.summary_report(cut_lineage(rounded(summary(spark, sf), "mean"))), "value")


@query("W6_model_ranking", "WITH " + SUMMARY_SQL + """ SELECT metric, model, round(mean, 6) AS mean,
  CAST(rank() OVER (PARTITION BY metric ORDER BY round(mean, 6) DESC) AS INT) AS rank FROM summary""")
def _(spark, sf):
    return K.model_ranking(rounded(summary(spark, sf), "mean"))


@query("O1_sorted_models", "WITH " + SUMMARY_SQL + " SELECT model, round(mean, 6) AS mean, round(std, 6) AS std FROM summary WHERE metric = 'accuracy' ORDER BY mean DESC, model")
def _(spark, sf):
    return rounded(K.sort_models(summary(spark, sf)), "mean", "std").select("model", "mean", "std")


@query("O2_top_models", "WITH " + SUMMARY_SQL + " SELECT model, round(mean, 6) AS mean FROM summary WHERE metric = 'roc_auc' ORDER BY round(mean, 6) DESC, model LIMIT 3")
def _(spark, sf):
    return K.top_models(cut_lineage(rounded(summary(spark, sf), "mean")), 3, "roc_auc").select("model", "mean")


@query("V5_model_category", "WITH " + SCORES_SQL + " SELECT category, model, count(*) AS cells FROM scores GROUP BY 1, 2")
def _(spark, sf):
    return scores(spark, sf).groupBy(K.model_category().alias("category"), "model").agg(
        F.count("*").alias("cells"))


@query("V6_benchmark_report", "WITH " + SCORES_SQL + ", " + GAIN_SQL + """,
o AS (SELECT * FROM scores ORDER BY score DESC, level_ord, model_ord, size_ord LIMIT 1),
cat AS (SELECT *, CASE category WHEN 'classical' THEN 0 WHEN 'ensemble' THEN 1 ELSE 2 END AS co FROM scores
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, level_ord, model_ord, size_ord) = 1),
lv AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY level ORDER BY score DESC, model_ord, size_ord) = 1),
g AS (SELECT *, CASE comparison WHEN 'bert_vs_classical' THEN 0 ELSE 1 END AS go FROM gains),
l(s, i, j, line) AS (
  VALUES (0, 0, 0, repeat('=', 80)), (0, 0, 1, 'TOPIC BENCHMARK REPORT'), (0, 0, 2, repeat('=', 80)), (0, 0, 3, ''),
    (1, 0, 1, ''), (2, 0, 0, 'BEST OVERALL PERFORMANCE:'), (2, 0, 4, ''), (3, -1, 0, 'BEST PERFORMANCE BY CATEGORY:'),
    (4, -1, 0, ''), (4, -1, 1, 'EXTRACTION METHOD COMPARISON:'), (5, -1, 0, ''), (6, -1, 0, 'IMPROVEMENT ANALYSIS:'),
    (7, 0, 0, ''), (8, 0, 0, repeat('=', 80))
  UNION ALL SELECT 0, 0, 4, 'Total Model Evaluations: ' || count(*) FROM scores
  UNION ALL SELECT 1, 0, 0, 'Extraction Methods: [' || string_agg('''' || level || '''', ', ' ORDER BY level_ord) || ']' FROM (SELECT DISTINCT level, level_ord FROM scores)
  UNION ALL SELECT 2, 0, 1, '  Model: ' || model FROM o UNION ALL SELECT 2, 0, 2, '  Extraction: ' || level || ' (size: ' || size || ')' FROM o
  UNION ALL SELECT 2, 0, 3, printf('  Score: %.4f', score) FROM o
  UNION ALL SELECT 3, co, 0, '  ' || upper(category) || ':' FROM cat UNION ALL SELECT 3, co, 1, '    Model: ' || model FROM cat
  UNION ALL SELECT 3, co, 2, printf('    Score: %.4f', score) FROM cat
  UNION ALL SELECT 3, co, 3, '    Extraction: ' || level || ' (size: ' || size || ')' FROM cat
  UNION ALL SELECT 4, level_ord, 0, '  ' || upper(level) || ':' FROM lv UNION ALL SELECT 4, level_ord, 1, printf('    Best Score: %.4f', score) FROM lv
  UNION ALL SELECT 4, level_ord, 2, '    Best Model: ' || model FROM lv UNION ALL SELECT 4, level_ord, 3, '    Best Size: ' || size FROM lv
  UNION ALL SELECT 6, go, 0, '  ' || upper(comparison) || ':' FROM g
  UNION ALL SELECT 6, go, 1, printf('    Absolute Improvement: %.4f', other_best - classical_best) FROM g
  UNION ALL SELECT 6, go, 2, printf('    Relative Improvement: %.2f%%', (other_best - classical_best) / classical_best * 100) FROM g)
SELECT CAST(row_number() OVER (ORDER BY s, i, j) AS INT) AS line_no, line FROM l""")
def _(spark, sf):
    return K.benchmark_report(cut_lineage(scores(spark, sf)))


# The saved report holds the lines of the report, its lines are those of V6.
ORACLES["S7_save_results"] = f"SELECT line FROM ({ORACLES['V6_benchmark_report']})"
