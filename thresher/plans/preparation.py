"""Sources, sinks, table preparation and profile over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thresher.operators import prepare
from thresher.operators.folds import stratified_folds
from thresher.operators.ordering import exact_quantiles
from thresher.operators.ranking import compare_models
from thresher.operators.rules import rule_table
from thresher.plans.common import (FEATURES_SQL, LINE_RULES, SCORES_SQL, SUMMARY_SQL, query,
                                   scores, summary, table, users)
from thresher.session import cut_lineage
from thresher.sources import tables as io

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("S1_load_data", "SELECT * FROM supplier")
def _(spark, sf):
    return io.load_data(spark, f"{sf}/supplier.parquet")


@query("S2_csv_source", CUSTOMER_SQL)
def _(spark, sf):
    path = io.scratch_path(spark, "customer") + ".csv"
    io.export(table(spark, sf, "customer"), path, "csv")
    return io.load_data(spark, path, schema=CUSTOMER)


@query("S3_json_source", CUSTOMER_SQL)
def _(spark, sf):
    path = io.scratch_path(spark, "customer") + ".json"
    io.export(table(spark, sf, "customer"), path, "json")
    return io.load_data(spark, path, schema=CUSTOMER)


@query("S4_parquet_source", """SELECT l_returnflag, l_linestatus, count(*) AS n,
  round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity > 25
  GROUP BY l_returnflag, l_linestatus""")
def _(spark, sf):
    lines = io.load_data(spark, f"{sf}/lineitem.parquet")
    return (lines.where(F.col("l_quantity") > 25).groupBy("l_returnflag", "l_linestatus")
            .agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")))


@query("S5_open_dataset", """SELECT DISTINCT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
  CAST(trunc(c_acctbal) AS INT) AS target FROM customer
  WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0""")
def _(spark, sf):
    src = gappy(table(spark, sf, "customer")).withColumn("target", F.col("c_acctbal"))
    return io.open_dataset(spark, data=src, label="target")


@query("S6_results_sink", "WITH " + SUMMARY_SQL + """ SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std, format
  FROM summary, (VALUES ('csv'), ('json'), ('parquet')) AS f(format)""")
def _(spark, sf):
    out = None
    s = cut_lineage(summary(spark, sf))
    for fmt in io.FORMATS:
        path = io.scratch_path(spark, "results")
        io.export(s, path, fmt)
        back = io.load_data(spark, path, fmt, s.schema.simpleString()[7:-1]
                            .replace(":", " ")).withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out.select("model", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "format")


@query("S7_save_results")
def _(spark, sf):
    path = io.scratch_path(spark, "saved")
    io.save_results(scores(spark, sf), path)
    return spark.read.text(f"{path}/evaluation_report").withColumnRenamed("value", "line")


@query("S8_load_results", "WITH " + SCORES_SQL + """
SELECT model, CAST(model_ord AS INT) AS model_ord, size, CAST(size_ord AS INT) AS size_ord, score,
  level FROM scores""")
def _(spark, sf):
    path = io.scratch_path(spark, "saved")
    io.save_results(scores(spark, sf), path)
    return io.load_results(spark, path)


@query("S9_export_tables", "WITH " + SCORES_SQL + """
SELECT 'level_scores' AS name, count(*) AS rows FROM scores
UNION ALL SELECT 'performance_summary', count(DISTINCT model) FROM scores
UNION ALL SELECT 'best_models', count(DISTINCT category) FROM scores
UNION ALL SELECT 'benchmark_summary', 7 + 3 * count(DISTINCT level) FROM scores""")
def _(spark, sf):
    path = io.scratch_path(spark, "tables")
    names = io.export_tables(scores(spark, sf), path, "parquet")
    out = None
    for n in names:
        rows = spark.read.parquet(f"{path}/{n}").agg(F.count("*").alias("rows")).withColumn(
            "name", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("S10_flatten_summary", "WITH " + SCORES_SQL + """,
overall AS (SELECT * FROM scores ORDER BY score DESC, level_ord, size_ord, model_ord LIMIT 1),
per_level AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY level
  ORDER BY score DESC, size_ord, model_ord) = 1)
SELECT 'task_type' AS category, 'value' AS metric, 'binary' AS value
UNION ALL SELECT 'total_model_evaluations', 'value', CAST(count(*) AS VARCHAR) FROM scores
UNION ALL SELECT 'extraction_methods_evaluated', 'value', string_agg(level, ', ' ORDER BY level_ord)
  FROM (SELECT DISTINCT level, level_ord FROM scores)
UNION ALL SELECT 'best_overall', 'model', model FROM overall
UNION ALL SELECT 'best_overall', 'extraction_type', level FROM overall
UNION ALL SELECT 'best_overall', 'extraction_size', size FROM overall
UNION ALL SELECT 'best_overall', 'score', printf('%.6f', score) FROM overall
UNION ALL SELECT 'extraction_best', level || '.model', model FROM per_level
UNION ALL SELECT 'extraction_best', level || '.extraction_size', size FROM per_level
UNION ALL SELECT 'extraction_best', level || '.score', printf('%.6f', score) FROM per_level""")
def _(spark, sf):
    from thresher.operators.ranking import flatten_summary
    return flatten_summary(cut_lineage(scores(spark, sf)))


@query("S11_rules_round_trip", """WITH r(ord, name, "column", op, threshold) AS (VALUES
  (0, 'bulk', 'l_quantity', '>=', 40.0::DOUBLE), (1, 'single', 'l_quantity', '==', 1.0::DOUBLE),
  (2, 'discounted', 'l_discount', '>', 0.05::DOUBLE), (3, 'taxed', 'l_tax', '!=', 0.0::DOUBLE),
  (4, 'cheap', 'l_extendedprice', '<', 20000.0::DOUBLE), (5, 'small', 'l_quantity', '<=', 5.0::DOUBLE)),
cells AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT 'l_tax', l_tax FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT CAST(ord AS INT) AS ord, name, op, threshold, count(*) FILTER (CASE op WHEN '>=' THEN v >= threshold
  WHEN '==' THEN v = threshold WHEN '>' THEN v > threshold WHEN '!=' THEN v <> threshold
  WHEN '<' THEN v < threshold ELSE v <= threshold END) AS n
FROM r JOIN cells USING ("column") GROUP BY ord, name, op, threshold""")
def _(spark, sf):
    """Saved and loaded rules, with the number of order lines each one holds for."""
    from thresher.operators.rules import topic_frequencies, topics_from_table
    path = io.scratch_path(spark, "rules")
    io.save_rules(rule_table(spark, LINE_RULES), path)
    rules = io.load_rules(spark, path)
    found = topics_from_table(table(spark, sf, "lineitem"), "l_orderkey", rules)
    counts = topic_frequencies(found).withColumnRenamed("topic", "name")
    return rules.join(counts, "name", "left").select(
        "ord", "name", "op", "threshold", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def gappy(customer: DataFrame) -> DataFrame:
    """Customers with missing cells: NULL and NaN balances, NULL segments."""
    key = F.col("c_custkey")
    return customer.select(
        "c_custkey", "c_nationkey",
        F.when(key % 7 == 0, F.lit(None)).when(key % 13 == 0, F.lit(float("nan")))
        .otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(key % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))


GAPPY_SQL = """gappy AS (SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 13 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"""


@query("F1_drop_duplicates", "SELECT DISTINCT md5(text) AS digest, lang, source, n_chars FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("text", "lang", "source", "n_chars")
    return prepare.drop_duplicates(docs).select(
        F.md5("text").alias("digest"), "lang", "source", "n_chars")


@query("F2_drop_missing", "WITH " + GAPPY_SQL + """ SELECT * FROM gappy
  WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def _(spark, sf):
    return prepare.drop_missing(gappy(table(spark, sf, "customer")))


@query("F3_fill_missing", "WITH " + GAPPY_SQL + """,
seg AS (SELECT c_mktsegment AS m FROM gappy WHERE c_mktsegment IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, c_nationkey, round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM gappy)), 6)
  AS c_acctbal, coalesce(c_mktsegment, (SELECT m FROM seg)) AS c_mktsegment FROM gappy""")
def _(spark, sf):
    filled = prepare.fill_missing(gappy(table(spark, sf, "customer")), ["c_acctbal", "c_mktsegment"])
    return filled.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("F4_ignore_missing", "WITH " + GAPPY_SQL + " SELECT DISTINCT * FROM gappy")
def _(spark, sf):
    return prepare.preprocess(gappy(table(spark, sf, "customer")), "ignore")


@query("F5_entity_features", "WITH " + FEATURES_SQL + """ SELECT user_id, v_max, v_min,
  round(v_avg, 6) AS v_avg, round(v_range, 6) AS v_range, round(v_std, 6) AS v_std FROM feat""")
def _(spark, sf):
    f = users(spark, sf)
    return f.select("user_id", "v_max", "v_min",
                    *[F.round(c, 6).alias(c) for c in ("v_avg", "v_range", "v_std")])


@query("F6_cast_label", "SELECT o_orderkey, CAST(trunc(o_totalprice / 100000.0::DOUBLE) AS INT) AS label FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000.0).alias("label"))
    return prepare.cast_label(o, "label")


def _validate_sql() -> str:
    types = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
    parts = ["SELECT '' AS \"column\", 'rows' AS statistic, CAST(count(*) AS VARCHAR) AS value FROM gappy",
             "SELECT '', 'columns', '4'",
             "SELECT '', 'duplicates', CAST((SELECT count(*) FROM gappy) - (SELECT count(*) FROM "
             "(SELECT DISTINCT * FROM gappy)) AS VARCHAR)"]
    for c, t in types.items():
        parts.append(f"SELECT '{c}', 'missing', CAST(count(*) - count({c}) AS VARCHAR) FROM gappy")
        parts.append(f"SELECT '{c}', 'type', '{t}'")
    return "WITH " + GAPPY_SQL + " " + " UNION ALL ".join(parts)


@query("F7_validate", _validate_sql())
def _(spark, sf):
    return prepare.validate(gappy(table(spark, sf, "customer")))


@query("F7_duplicate_count", """SELECT count(*) - (SELECT count(*) FROM
  (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicates FROM documents""")
def _(spark, sf):
    return prepare.duplicate_count(table(spark, sf, "documents").select(
        "text", "lang", "source", "n_chars"))


@query("F8_missing_required", """WITH need(c) AS (VALUES ('c_custkey'), ('target_label'), ('c_acctbal'),
  ('risk')) SELECT c AS "column" FROM need WHERE c NOT IN (SELECT column_name FROM
  (DESCRIBE customer))""")
def _(spark, sf):
    return prepare.missing_required(table(spark, sf, "customer"),
                                    ["c_custkey", "target_label", "c_acctbal", "risk"])


def _missing_sql() -> str:
    cols = ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    parts = [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
             f"round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM gappy"
             for c in cols]
    total = " + ".join(f"count(*) - count({c})" for c in cols)
    parts.append(f"SELECT '', {total}, CAST(NULL AS DOUBLE) FROM gappy")
    return "WITH " + GAPPY_SQL + " " + " UNION ALL ".join(parts)


@query("F9_missing_summary", _missing_sql())
def _(spark, sf):
    out = prepare.missing_summary(gappy(table(spark, sf, "customer")))
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("F10_numeric_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS p25,
  round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75,
  max({c}) AS max FROM lineitem""" for c in LINE_NUMBERS))
def _(spark, sf):
    s = prepare.numeric_summary(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return s.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min",
                    *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("F10_quantiles_by_flag", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
  round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    q = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice",
                        {"p10": 0.1, "p99": 0.99})
    return q.select("l_returnflag", F.round("p10", 4).alias("p10"), F.round("p99", 4).alias("p99"))


def _categorical_sql(src: str, columns) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM {src} WHERE {c} IS NOT NULL"""
        for c in columns)
    return f"""WITH vals AS ({parts}), counts AS (SELECT "column", value, count(*) AS n FROM vals GROUP BY 1, 2)
SELECT "column", count(*) OVER (PARTITION BY "column") AS unique_values,
  CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INT) AS rank, value, n
FROM counts QUALIFY rank <= 10"""


@query("F11_categorical_summary", _categorical_sql("part", ("p_name", "p_brand", "p_type")))
def _(spark, sf):
    return prepare.categorical_summary(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query("O3_top_values", _categorical_sql("events", ("event_type", "props")))
def _(spark, sf):
    return prepare.categorical_summary(table(spark, sf, "events"), ["event_type", "props"])


@query("F12_target_distribution", "WITH " + GAPPY_SQL + """ SELECT c_mktsegment, count(*) AS n
  FROM gappy WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return prepare.target_distribution(gappy(table(spark, sf, "customer")), "c_mktsegment")


@query("F13_feature_columns", """SELECT p_partkey, p_retailprice, p_size FROM part""")
def _(spark, sf):
    part = table(spark, sf, "part")
    return prepare.select_features(part, "p_partkey", label="p_size")


@query("F14_stratified_split", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY quality
  ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS r,
  count(*) OVER (PARTITION BY quality) AS c FROM labels)
SELECT doc_id, quality, CASE WHEN r <= round(c * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM n""")
def _(spark, sf):
    return prepare.train_test_split(table(spark, sf, "labels"), "doc_id", "quality").select(
        "doc_id", "quality", "split")


@query("W2_split_rows", """WITH n AS (SELECT o_orderkey, o_orderpriority, row_number() OVER
  (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey) AS r,
  count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders)
SELECT o_orderkey, CASE WHEN r <= round(c * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM n""")
def _(spark, sf):
    return prepare.train_test_split(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority",
                                    0.3, 7).select("o_orderkey", "split")


@query("W1_stratified_folds", """SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality
  ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1) % 5 AS INT) AS fold FROM labels""")
def _(spark, sf):
    return stratified_folds(table(spark, sf, "labels"), "doc_id", "quality").select(
        "doc_id", "quality", "fold")


@query("F15_weighted_score", """SELECT l_orderkey, l_linenumber, l_partkey, round(0.3::DOUBLE * l_quantity +
  0.5::DOUBLE * l_discount + 0.2::DOUBLE * l_tax, 6) AS risk FROM lineitem""")
def _(spark, sf):
    w = prepare.weighted_score({"l_quantity": 0.3, "l_discount": 0.5, "l_tax": 0.2})
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(w, 6).alias("risk"))


@query("F16_cut", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 AND l_discount <= 0.03 THEN 'mild'
  WHEN l_discount > 0.03 AND l_discount <= 0.07 THEN 'moderate'
  WHEN l_discount > 0.07 AND l_discount <= 1 THEN 'severe' END AS severity FROM lineitem""")
def _(spark, sf):
    c = prepare.cut("l_discount", [0, 0.03, 0.07, 1.0], ["mild", "moderate", "severe"])
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", c.alias("severity"))


@query("F17_feature_engineer", """SELECT o_orderkey, round(o_totalprice / 1000.0::DOUBLE, 6) AS price_k,
  CASE WHEN o_totalprice / 1000.0::DOUBLE > 250 THEN 1 ELSE 0 END AS expensive FROM orders""")
def _(spark, sf):
    def step(df):
        return df.withColumn("price_k", F.col("o_totalprice") / 1000.0).withColumn(
            "expensive", (F.col("price_k") > 250).cast("int"))
    return prepare.engineer(table(spark, sf, "orders"), step).select(
        "o_orderkey", F.round("price_k", 6).alias("price_k"), "expensive")


@query("F18_composite_label", "WITH " + FEATURES_SQL + """, n AS (SELECT user_id,
  CAST(v_max > 200 AS INT) + CAST(v_min < 0.5 AS INT) + CAST(v_avg > 50 AS INT)
  + CAST(v_range > 250 AS INT) + CAST(v_std > 55 AS INT) AS n FROM feat)
SELECT user_id, CAST(CASE WHEN n >= 2 THEN 1 ELSE 0 END AS INT) AS label2,
  CAST(CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END AS INT) AS label3 FROM n""")
def _(spark, sf):
    c = [F.col("v_max") > 200, F.col("v_min") < 0.5, F.col("v_avg") > 50,
         F.col("v_range") > 250, F.col("v_std") > 55]
    return users(spark, sf).select("user_id", prepare.composite_label(c).alias("label2"),
                                   prepare.composite_label(c, (2, 4)).alias("label3"))


@query("F19_compare_models", "WITH " + SUMMARY_SQL + """ SELECT model, metric, round(mean, 6) AS mean
  FROM summary WHERE model IN ('LogisticRegression', 'BERT-LR') AND contains(metric, 'auc')""")
def _(spark, sf):
    s = compare_models(cut_lineage(summary(spark, sf)), ["LogisticRegression", "BERT-LR", "Nobody"], ["auc"])
    return s.select("model", "metric", F.round("mean", 6).alias("mean"))


@query("F19_filter_without_hit", "WITH " + SUMMARY_SQL + """ SELECT model, metric, round(mean, 6) AS mean
  FROM summary WHERE contains(metric, 'acc') OR contains(metric, 'f1')""")
def _(spark, sf):
    s = compare_models(cut_lineage(summary(spark, sf)), ["Nobody"], ["acc", "f1"])
    return s.select("model", "metric", F.round("mean", 6).alias("mean"))
