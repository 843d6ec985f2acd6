"""Rules, topics and labels over the given tables; text extraction; joins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from thresher.functions.columns import SPACE_CLASS, TERM, as_text, distinct_terms, terms
from thresher.operators import rules as R, text as X
from thresher.plans.common import (CELLS_SQL, FEATURES_SQL, LINE_RULES, LINES_SQL, PREDS_SQL,
                                   TOPICS_SQL, USER_RULES, line_topics, predictions, query,
                                   scores, table, user_topics, users)

LINE_KEY = "l_orderkey, l_linenumber, l_partkey"
KEY = ("l_orderkey", "l_linenumber", "l_partkey")


@query("T1_topic_text", "WITH " + TOPICS_SQL + " SELECT user_id, text FROM topics")
def _(spark, sf):
    return user_topics(spark, sf).select("user_id", "text")


@query("T2_operators", "WITH " + LINES_SQL + f" SELECT {LINE_KEY}, text FROM topics")
def _(spark, sf):
    return line_topics(spark, sf).select(*KEY, "text")


@query("T3_skipped_rules", """SELECT event_id, CASE WHEN t = '' THEN 'normal' ELSE t END AS text FROM (
  SELECT event_id, concat_ws(' ', CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND value > 50 THEN 'high' END,
  CASE WHEN event_type IS NOT NULL THEN 'typed' END,
  CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND value <= 1 THEN 'low' END,
  CASE WHEN event_type = 'error' THEN 'failed' END) AS t FROM events)""")
def _(spark, sf):
    """Missing and NaN values, absent columns, unknown operators, text columns."""
    key = F.col("event_id")
    value = (F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.lit(float("nan")))
             .otherwise(F.col("value")))
    ev = table(spark, sf, "events").select("event_id", "event_type", value.alias("value"))
    rules = {"high": ("value", ">", 50), "absent": ("nothing", ">", 1), "odd": ("value", "~", 1),
             "unordered": ("event_type", ">", 1.2), "never": ("event_type", "==", 1.2),
             "typed": ("event_type", "!=", 1.2), "low": ("value", "<=", 1),
             "failed": ("event_type", "==", "error")}
    return R.with_topics(ev, rules).select("event_id", "text")


@query("T4_table_rules", "WITH " + TOPICS_SQL + " SELECT user_id, text FROM topics")
def _(spark, sf):
    return R.topics_from_table(users(spark, sf), "user_id", R.rule_table(spark, USER_RULES))


@query("J4_rules_by_join", "WITH " + TOPICS_SQL + " SELECT user_id, text FROM topics")
def _(spark, sf):
    return R.topics_by_join(users(spark, sf), "user_id", R.rule_table(spark, USER_RULES))


@query("T5_changed_rules", "WITH " + FEATURES_SQL + """ SELECT user_id, CASE WHEN t = '' THEN 'normal' ELSE t END AS text
  FROM (SELECT user_id, concat_ws(' ', CASE WHEN v_max > 200 THEN 'high_max' END,
    CASE WHEN v_min < 0.1 THEN 'low_min' END, CASE WHEN v_range > 250 THEN 'wide_range' END,
    CASE WHEN v_std > 55 THEN 'high_spread' END, CASE WHEN v_avg <= 45 THEN 'low_avg' END) AS t FROM feat)""")
def _(spark, sf):
    """One rule replaced in place, one removed, one appended."""
    t = R.rule_table(spark, USER_RULES)
    t = R.add_rule(t, R.Rule("low_min", "v_min", "<", 0.1))
    t = R.remove_rule(t, "high_avg")
    t = R.add_rule(t, R.Rule("low_avg", "v_avg", "<=", 45.0))
    return R.topics_from_table(users(spark, sf), "user_id", t)


@query("T6_custom_extractor", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' AND l_quantity > 30
  THEN 'large_return' WHEN l_returnflag = 'R' THEN 'return' ELSE 'normal' END AS text FROM lineitem""")
def _(spark, sf):
    def extractor(row):
        if row["l_returnflag"] != "R":
            return "normal"
        return "large_return" if row["l_quantity"] > 30 else "return"
    return R.with_custom_topics(table(spark, sf, "lineitem"), extractor,
                                ["l_returnflag", "l_quantity"]).select(*KEY, "text")


@query("U1_column_extractor", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.05
  THEN 'tax_' || l_linestatus ELSE 'normal' END AS text FROM lineitem""")
def _(spark, sf):
    @R.as_column
    def extractor(df):
        return F.when(df["l_tax"] > 0.05, F.concat(F.lit("tax_"), df["l_linestatus"])).otherwise("normal")
    return R.with_custom_topics(table(spark, sf, "lineitem"), extractor).select(*KEY, "text")


@query("T8_topic_frequencies", "WITH " + LINES_SQL + """ SELECT topic, count(*) AS n
  FROM (SELECT unnest(toks) AS topic FROM topics) GROUP BY topic""")
def _(spark, sf):
    return R.topic_frequencies(line_topics(spark, sf))


@query("T9_topics_per_row", "WITH " + LINES_SQL + """ SELECT CAST(len(toks) AS INT) AS topics, count(*) AS n
  FROM topics GROUP BY 1""")
def _(spark, sf):
    return R.topics_per_row(line_topics(spark, sf))


@query("T10_topic_totals", "WITH " + LINES_SQL + """ SELECT count(*) AS total_rows,
  count(*) FILTER (text IS DISTINCT FROM 'normal') AS rows_with_topics,
  round(avg(len(toks)), 6) AS average_topics,
  (SELECT count(DISTINCT t) FROM (SELECT unnest(toks) AS t FROM topics)) AS unique_topics FROM topics""")
def _(spark, sf):
    return R.topic_totals(line_topics(spark, sf)).withColumn(
        "average_topics", F.round("average_topics", 6))


PAIRS_SQL = """sorted AS (SELECT list_sort(toks) AS s FROM topics),
places AS (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM sorted),
pairs AS (SELECT s, i, unnest(range(i + 1, len(s) + 1)) AS j FROM places)
SELECT s[i] || '+' || s[j] AS pair, count(*) AS n FROM pairs GROUP BY 1"""


@query("T11_topic_pairs", "WITH " + LINES_SQL + ", " + PAIRS_SQL)
def _(spark, sf):
    return R.topic_pairs(line_topics(spark, sf))


@query("T11_repeated_tokens", f"""WITH topics AS (SELECT
  regexp_extract_all(array_to_string([event_type, event_type, CASE WHEN value > 50 THEN 'high' ELSE 'error' END], ' '),
  '[^ ]+') AS toks FROM events), """ + PAIRS_SQL)
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.concat_ws(
        " ", "event_type", "event_type", F.when(F.col("value") > 50, "high").otherwise("error"))
        .alias("text"))
    return R.topic_pairs(ev)


@query("T12_count_labels", "WITH " + LINES_SQL + f""" SELECT {LINE_KEY}, CAST(CASE WHEN len(toks) >= 3 THEN 2
  WHEN len(toks) >= 1 THEN 1 ELSE 0 END AS INT) AS label FROM topics""")
def _(spark, sf):
    return R.topic_labels(line_topics(spark, sf)).select(*KEY, "label")


@query("T13_severity_labels", "WITH " + LINES_SQL + f""", s(topic, v) AS (VALUES ('bulk', 1), ('cheap', 2), ('taxed', 1), ('single', 3))
SELECT {LINE_KEY}, CAST(coalesce(list_max(list_transform(toks, lambda t: (CASE t WHEN 'bulk' THEN 1 WHEN 'cheap' THEN 2
  WHEN 'taxed' THEN 1 WHEN 'single' THEN 3 END))), 0) AS INT) AS label FROM topics""")
def _(spark, sf):
    severity = {"bulk": 1, "cheap": 2, "taxed": 1, "single": 3}
    return R.topic_labels(line_topics(spark, sf), "severity_based", severity=severity).select(
        *KEY, "label")


@query("T14_chosen_label", "WITH " + TOPICS_SQL + """ SELECT user_id, CAST(CASE WHEN len(toks) >= 3 THEN 2
  WHEN len(toks) >= 1 THEN 1 ELSE 0 END AS INT) AS label FROM topics""")
def _(spark, sf):
    return R.choose_label(user_topics(spark, sf), "target_label").select("user_id", "label")


@query("T14_given_label", "WITH " + TOPICS_SQL + " SELECT user_id, CAST(user_id % 3 AS INT) AS label FROM topics")
def _(spark, sf):
    given = user_topics(spark, sf).withColumn("target_label", F.col("user_id") % 3)
    return R.choose_label(given, "target_label").select("user_id", "label")


# ---- text ----

SPLIT_SQL = f"""d AS (SELECT doc_id, text, regexp_extract_all(text, '[^{SPACE_CLASS}]+') AS t FROM documents)"""


def _cut_sql(expr: str) -> str:
    return f"""WITH {SPLIT_SQL} SELECT doc_id, md5(CASE WHEN text = '' OR text = 'normal' THEN text
  ELSE {expr} END) AS digest FROM d"""


def _documents_cut(spark, sf, level, size):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(X.extract("text", level, size)).alias("digest"))


@query("X1_words", _cut_sql("CASE WHEN 20 < len(t) THEN array_to_string(t[1:20], ' ') ELSE text END"))
def _(spark, sf):
    return _documents_cut(spark, sf, "word", 20)


@query("X2_sentences", _cut_sql("array_to_string(t[1:15], ' ')"))
def _(spark, sf):
    return _documents_cut(spark, sf, "sentence", 3)


@query("X3_paragraphs", _cut_sql("array_to_string(t[1:20], ' ')"))
def _(spark, sf):
    return _documents_cut(spark, sf, "paragraph", 2)


@query("X4_dispatch", _cut_sql("text"))
def _(spark, sf):
    return _documents_cut(spark, sf, "paragraph", 0)


@query("X4_dispatch_levels", " UNION ALL ".join(
    f"SELECT '{level}' AS level, {size} AS size, doc_id, digest FROM ({_cut_sql(cut)})" for level, size, cut in (
        ("word", 5, "CASE WHEN 5 < len(t) THEN array_to_string(t[1:5], ' ') ELSE text END"),
        ("sentence", 1, "array_to_string(t[1:5], ' ')"), ("paragraph", 1, "array_to_string(t[1:10], ' ')"),
        ("paragraph", 0, "text"))))
def _(spark, sf):
    """One entry point for all levels, by name."""
    parts = [_documents_cut(spark, sf, level, size).select(
        F.lit(level).alias("level"), F.lit(size).alias("size"), "doc_id", "digest")
        for level, size in (("word", 5), ("sentence", 1), ("paragraph", 1), ("paragraph", 0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _grid_sql(sizes, baseline: bool) -> str:
    parts = []
    for level, size, i in X.grid_cells(sizes, baseline):
        if size == X.BASELINE or (level == "paragraph" and size == "0"):
            e = "text"
        else:
            n = int(size) * {"word": 1, "sentence": 5, "paragraph": 10}[level]
            e = f"array_to_string(t[1:{n}], ' ')"
            if level == "word":
                e = f"CASE WHEN {n} < len(t) THEN {e} ELSE text END"
        parts.append(f"""SELECT doc_id, '{level}' AS level, '{size}' AS size, {i} AS size_ord,
  md5(CASE WHEN text = '' OR text = 'normal' THEN text ELSE {e} END) AS digest FROM d""")
    return f"WITH {SPLIT_SQL} " + " UNION ALL ".join(parts)


@query("X5_extraction_grid", _grid_sql(None, True))
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return X.extraction_grid(docs).select("doc_id", "level", "size", "size_ord",
                                          F.md5("text").alias("digest"))


@query("X6_search_grid", _grid_sql(X.SEARCH_SIZES, False))
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return X.extraction_grid(docs, sizes=X.SEARCH_SIZES, baseline=False).select(
        "doc_id", "level", "size", "size_ord", F.md5("text").alias("digest"))


@query("O4_baseline_rows", """SELECT level, size, count(*) AS n, count(DISTINCT text) AS texts FROM
  (SELECT text, unnest(['word', 'sentence', 'paragraph']) AS level, 'Baseline' AS size FROM documents) GROUP BY ALL""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return (X.extraction_grid(docs).where(F.col("size") == X.BASELINE).groupBy("level", "size")
            .agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts")))


@query("X7_terms", f"""SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TERM}') AS t FROM documents)""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.size(terms("text")).cast("long").alias("n_terms"),
                       F.size(distinct_terms("text")).cast("long").alias("n_distinct"),
                       F.md5(F.array_join(terms("text"), " ")).alias("digest"))


STOPS = ("the", "and", "der", "die", "und", "le", "la", "de", "el", "en")


@query("X8_clean_text", r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(
  regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> '' AND NOT list_contains("""
       + str(list(STOPS)) + """, w)), ' ')) AS digest FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(X.clean_text("text", stop_words=STOPS)).alias("digest"))


@query("X9_as_text", """SELECT o_orderkey, coalesce(CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS VARCHAR), '') AS text
  FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", as_text(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")))
                    .alias("text"))


# ---- alignment ----

@query("J1_aligned", "WITH " + TOPICS_SQL + """, lab AS (SELECT user_id, CAST(avg(CASE WHEN event_type = 'error'
  THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.2 AS INT) AS label FROM events GROUP BY user_id)
SELECT user_id AS id, text, label FROM topics JOIN lab USING (user_id)""")
def _(spark, sf):
    from thresher.plans.common import labelled_users
    return labelled_users(spark, sf)
