"""Inputs shared by the registered queries, and the registry itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from thresher.operators.folds import stratified_folds
from thresher.operators.metrics import fold_metrics
from thresher.operators.prepare import entity_features
from thresher.operators.rules import with_topics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Rules on user features of the event log, and on order lines.
USER_RULES = {
    "high_max": {"column": "v_max", "operator": ">", "threshold": 200.0},
    "low_min": {"column": "v_min", "operator": "<", "threshold": 0.5},
    "high_avg": {"column": "v_avg", "operator": ">", "threshold": 50.0},
    "wide_range": {"column": "v_range", "operator": ">", "threshold": 250.0},
    "high_spread": {"column": "v_std", "operator": ">", "threshold": 55.0},
}
LINE_RULES = {
    "bulk": ("l_quantity", ">=", 40), "single": ("l_quantity", "==", 1),
    "discounted": ("l_discount", ">", 0.05), "taxed": ("l_tax", "!=", 0.0),
    "cheap": ("l_extendedprice", "<", 20000), "small": ("l_quantity", "<=", 5),
}


def users(spark: SparkSession, sf: str) -> DataFrame:
    return entity_features(table(spark, sf, "events"), "user_id", "value")


def user_topics(spark: SparkSession, sf: str) -> DataFrame:
    return with_topics(users(spark, sf), USER_RULES)


def labelled_users(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text, label): topic text of each user, label 1 if errors exceed a fifth."""
    errors = (table(spark, sf, "events").groupBy("user_id").agg(
        (F.avg((F.col("event_type") == "error").cast("double")) > 0.2).cast("int").alias("label")))
    return user_topics(spark, sf).join(errors, "user_id").select(
        F.col("user_id").alias("id"), "text", "label")


def line_topics(spark: SparkSession, sf: str) -> DataFrame:
    return with_topics(table(spark, sf, "lineitem"), LINE_RULES)


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"),
                                               F.col("quality").alias("label"))
    return docs.join(labels, "id")


FEATURES_SQL = """feat AS (SELECT user_id, max(value) AS v_max, min(value) AS v_min,
  avg(value) AS v_avg, max(value) - min(value) AS v_range, stddev_samp(value) AS v_std
  FROM events GROUP BY user_id)"""
TOPICS_SQL = FEATURES_SQL + """, joined AS (SELECT *, concat_ws(' ',
  CASE WHEN v_max > 200 THEN 'high_max' END, CASE WHEN v_min < 0.5 THEN 'low_min' END,
  CASE WHEN v_avg > 50 THEN 'high_avg' END, CASE WHEN v_range > 250 THEN 'wide_range' END,
  CASE WHEN v_std > 55 THEN 'high_spread' END) AS j FROM feat),
topics AS (SELECT *, CASE WHEN j = '' THEN 'normal' ELSE j END AS text,
  CASE WHEN j = '' THEN [] ELSE string_split(j, ' ') END AS toks FROM joined)"""
LINES_SQL = """joined AS (SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(' ',
  CASE WHEN l_quantity >= 40 THEN 'bulk' END, CASE WHEN l_quantity = 1 THEN 'single' END,
  CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_tax <> 0 THEN 'taxed' END,
  CASE WHEN l_extendedprice < 20000 THEN 'cheap' END,
  CASE WHEN l_quantity <= 5 THEN 'small' END) AS j FROM lineitem),
topics AS (SELECT *, CASE WHEN j = '' THEN 'normal' ELSE j END AS text,
  CASE WHEN j = '' THEN [] ELSE string_split(j, ' ') END AS toks FROM joined)"""

# Deterministic predictions over all orders: six named models, scores with ties.
MODELS = ("LogisticRegression", "MultinomialNB", "RandomForestClassifier",
          "VotingClassifier_Basic", "BERT-LR", "OptimizedLightGBM")
CELLS = (("paragraph", "0", 0, 0), ("paragraph", "Baseline", 1, 0), ("sentence", "1", 0, 1),
         ("word", "5", 0, 2), ("word", "10", 1, 1))     # level, size, size_ord, shift


def orders_folded(spark: SparkSession, sf: str) -> DataFrame:
    label = ((F.col("o_totalprice") > 220000) != (F.col("o_orderkey") % 7 == 0)).cast("int")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), "o_totalprice", "o_custkey", label.alias("label"))
    return stratified_folds(rows, "id", "label")


def _scored(rows: DataFrame) -> DataFrame:
    g = F.col("model_ord").cast("double") / 2
    g = F.floor(g).cast("double")
    score = F.floor(F.col("o_totalprice") / (2000.0 * (g + 1)) + F.col("o_custkey") % (g + 2)) / 300.0
    return rows.withColumn("score", score)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, fold, model, model_ord, label, pred, score)"""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("model_ord"))
                       for i, m in enumerate(MODELS)])
    rows = orders_folded(spark, sf).select("*", F.inline(models))
    g = F.floor(F.col("model_ord") / 2).cast("double")
    cut = F.lit(110.0) / (g + 1) / 300.0
    return _scored(rows).select("id", "fold", "model", "model_ord", "label",
                                (F.col("score") > cut).cast("int").alias("pred"), "score")


def cell_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``predictions`` for every cell of a small extraction grid."""
    cells = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(s).alias("size"),
                               F.lit(o).alias("size_ord"), F.lit(h).alias("shift"))
                      for lv, s, o, h in CELLS])
    rows = predictions(spark, sf).select("*", F.inline(cells))
    g = F.floor(F.col("model_ord") / 2).cast("double")
    cut = (F.lit(110.0) + F.lit(10.0) * F.col("shift") * (g + 1)) / (g + 1) / 300.0
    return rows.withColumn("pred", (F.col("score") > cut).cast("int")).drop("shift")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Long accuracy / precision / recall / f1 results per model, cell and fold."""
    preds = cell_predictions(spark, sf).drop("score")
    return fold_metrics(preds, ["model", "model_ord", "level", "size", "size_ord"])


def scores(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).where(F.col("metric") == "accuracy")
    return (r.groupBy("model", "model_ord", "level", "size", "size_ord")
            .agg(F.round(F.avg("value"), 6).alias("score")))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """(model, metric, mean, std, folds) of the models on the full text."""
    from thresher.operators.ranking import cross_validated
    return cross_validated(fold_metrics(predictions(spark, sf).drop("model_ord"), ["model"]),
                           ["model"])


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


FOLDED_SQL = """labelled AS (SELECT o_orderkey AS id, o_totalprice, o_custkey,
  CAST(CASE WHEN (o_totalprice > 220000) <> (o_orderkey % 7 = 0) THEN 1 ELSE 0 END AS INT) AS label
  FROM orders),
folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label
  ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1) % 5 AS INT) AS fold FROM labelled)"""
PREDS_SQL = FOLDED_SQL + f""",
models(model, model_ord) AS (VALUES {_values(zip(MODELS, range(len(MODELS))))}),
scored AS (SELECT id, fold, model, model_ord, model_ord // 2 AS g, label,
  floor(o_totalprice / (2000.0::DOUBLE * (model_ord // 2 + 1)) + o_custkey % (model_ord // 2 + 2))
  / 300.0::DOUBLE AS score FROM folded CROSS JOIN models),
preds AS (SELECT *, CAST(CASE WHEN score > 110.0::DOUBLE / (g + 1) / 300.0::DOUBLE
  THEN 1 ELSE 0 END AS INT) AS pred FROM scored)"""
CELLS_SQL = PREDS_SQL + f""",
cells(level, size, size_ord, shift) AS (VALUES {_values(CELLS)}),
cell_preds AS (SELECT id, fold, model, model_ord, level, size, size_ord, label, score,
  CAST(CASE WHEN score > (110.0::DOUBLE + 10.0::DOUBLE * shift * (g + 1)) / (g + 1) / 300.0::DOUBLE
  THEN 1 ELSE 0 END AS INT) AS pred FROM scored CROSS JOIN cells)"""


def metric_rows_sql(source: str, keys: str) -> str:
    """(keys, fold, metric, value) of the four threshold metrics, positive class 1."""
    return f"""counted AS (SELECT {keys}, fold, count(*)::DOUBLE AS n,
  count(*) FILTER (label = pred)::DOUBLE AS hit,
  count(*) FILTER (label = 1 AND pred = 1)::DOUBLE AS tp,
  count(*) FILTER (pred = 1)::DOUBLE AS pp, count(*) FILTER (label = 1)::DOUBLE AS p
  FROM {source} GROUP BY {keys}, fold),
metrics AS (
  SELECT {keys}, fold, 'accuracy' AS metric, hit / n AS value FROM counted UNION ALL
  SELECT {keys}, fold, 'precision', coalesce(tp / nullif(pp, 0), 0) FROM counted UNION ALL
  SELECT {keys}, fold, 'recall', coalesce(tp / nullif(p, 0), 0) FROM counted UNION ALL
  SELECT {keys}, fold, 'f1', coalesce(2 * tp / nullif(pp + p, 0), 0) FROM counted)"""


RESULTS_SQL = CELLS_SQL + ", " + metric_rows_sql(
    "cell_preds", "model, model_ord, level, size, size_ord")
SCORES_SQL = RESULTS_SQL + """,
scores AS (SELECT model, model_ord, level, size, size_ord,
  CASE level WHEN 'paragraph' THEN 0 WHEN 'sentence' THEN 1 ELSE 2 END AS level_ord,
  CASE WHEN contains(model, 'BERT') THEN 'bert_based'
       WHEN contains(model, 'RandomForest') OR contains(model, 'Voting') THEN 'ensemble'
       ELSE 'classical' END AS category,
  round(avg(value), 6) AS score FROM metrics WHERE metric = 'accuracy'
  GROUP BY model, model_ord, level, size, size_ord)"""
AUC_SQL = """ranked AS (SELECT model, fold, label,
  rank() OVER (PARTITION BY model, fold ORDER BY score)
  + (count(*) OVER (PARTITION BY model, fold, score) - 1) / 2.0::DOUBLE AS r FROM preds),
auc AS (SELECT model, fold, (sum(r) FILTER (label = 1)
  - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS value
  FROM ranked GROUP BY model, fold)"""
AP_SQL = """steps AS (SELECT model, fold, score, count(*) FILTER (label = 1) AS pos, count(*) AS n
  FROM preds GROUP BY model, fold, score),
running AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen,
  sum(pos) OVER (PARTITION BY model, fold) AS p FROM steps
  WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC)),
ap AS (SELECT model, fold, sum(pos::DOUBLE / p * tp / seen) AS value
  FROM running GROUP BY model, fold)"""
SUMMARY_SQL = (PREDS_SQL + ", " + metric_rows_sql("preds", "model") + ", " + AUC_SQL + ", " + AP_SQL
               + """, every AS (SELECT * FROM metrics
  UNION ALL SELECT model, fold, 'roc_auc', value FROM auc
  UNION ALL SELECT model, fold, 'pr_auc', value FROM ap),
summary AS (SELECT model, metric, avg(value) AS mean, stddev_pop(value) AS std,
  count(*) AS folds FROM every GROUP BY model, metric)""")
