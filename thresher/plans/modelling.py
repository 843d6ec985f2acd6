"""Vectors, models and whole evaluations over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thresher.evaluation import evaluate as E
from thresher.functions.columns import TERM
from thresher.models import registry
from thresher.models.base import Model, class_list, describe
from thresher.models.bayes import cross_validated_bayes, cross_validated_kinds
from thresher.models.embedding import (FunctionEncoder, MultilevelClassifier,
                                       WordVectorEncoder)
from thresher.models.ensemble import build_ensemble, meta_features
from thresher.models.neighbours import nearest, vote
from thresher.models.trees import soft_vote
from thresher.operators.folds import stratified_folds
from thresher.operators.metrics import ranking_metrics
from thresher.operators.prepare import train_test_split
from thresher.operators.vectors import (BagOfWords, fuse_levels, pool, vocabulary,
                                        vocabulary_pairs)
from thresher.session import cut_lineage
from thresher.plans.common import (labelled_documents, labelled_users, query, table, user_topics)

DOCS_SQL = f"""d AS (SELECT doc_id AS id, quality AS label, text FROM documents JOIN labels USING (doc_id)),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1) % 5 AS INT) AS fold FROM d)"""
TERMS_SQL = f"unnest(list_distinct(regexp_extract_all(lower(text), '{TERM}'))) AS term"


@query("E1_vocabulary", "WITH " + DOCS_SQL + f""" SELECT term, count(*) AS df FROM (SELECT {TERMS_SQL} FROM d)
  GROUP BY term ORDER BY df DESC, term LIMIT 5000""")
def _(spark, sf):
    return vocabulary(labelled_documents(spark, sf))


@query("E1_document_terms", f"""WITH t AS (SELECT doc_id, {TERMS_SQL} FROM documents),
v AS (SELECT term FROM t GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000)
SELECT doc_id, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM t JOIN v USING (term) GROUP BY doc_id""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return vocabulary_pairs(docs, "doc_id", vocabulary(docs)).groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.min("term").alias("first_term"),
        F.max("term").alias("last_term"))


@query("E1_bag_of_words", f"""WITH t AS (SELECT doc_id, {TERMS_SQL} FROM documents),
v AS (SELECT term FROM t GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000),
n AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS i FROM v)
SELECT doc_id, count(*) AS filled, CAST(sum(i) AS BIGINT) AS index_sum FROM t JOIN n USING (term) GROUP BY doc_id""")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = BagOfWords().fit(docs).transform(docs)
    cells = rows.select("doc_id", F.posexplode(vector_to_array("features")).alias("i", "v"))
    return cells.where("v <> 0").groupBy("doc_id").agg(
        F.sum("v").cast("long").alias("filled"), F.sum("i").alias("index_sum"))


def vector_states(spark, sf) -> DataFrame:
    """Embeddings as token states: the label is the text, the rank of the id its position."""
    e = table(spark, sf, "embeddings")
    firsts = e.groupBy("label").agg(F.min("vec_id").alias("_first"))
    return e.join(firsts, "label").select(
        F.col("label").alias("id"), (F.col("vec_id") - F.col("_first")).cast("int").alias("pos"),
        F.col("embedding").alias("vec"))


def _spread(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("embedding").alias("dim", "value")).select(
        "id", "dim", F.round("value", 6).alias("value"))


POOL_SQL = """e AS (SELECT label AS id, vec_id, CAST(i - 1 AS INT) AS dim, CAST(embedding[i] AS DOUBLE) AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
cls AS (SELECT id, dim, round(x, 6) AS value FROM e QUALIFY row_number() OVER (PARTITION BY id, dim ORDER BY vec_id) = 1),
mean AS (SELECT id, dim, round(avg(x), 6) AS value FROM e GROUP BY id, dim),
top AS (SELECT id, dim, round(max(x), 6) AS value FROM e GROUP BY id, dim)"""


@query("E3_cls_pooling", "WITH " + POOL_SQL + " SELECT * FROM cls")
def _(spark, sf):
    return _spread(pool(vector_states(spark, sf), "id", "cls"))


@query("E4_mean_pooling", "WITH " + POOL_SQL + " SELECT * FROM mean")
def _(spark, sf):
    return _spread(pool(vector_states(spark, sf), "id", "mean"))


@query("E5_max_pooling", "WITH " + POOL_SQL + " SELECT * FROM top")
def _(spark, sf):
    return _spread(pool(vector_states(spark, sf), "id", "max"))


@query("E6_hybrid_pooling", "WITH " + POOL_SQL + """ SELECT * FROM cls
  UNION ALL SELECT id, CAST(dim + 64 AS INT), value FROM mean UNION ALL SELECT id, CAST(dim + 128 AS INT), value FROM top""")
def _(spark, sf):
    return _spread(pool(vector_states(spark, sf), "id", "hybrid"))


def _level_embeddings(spark, sf) -> DataFrame:
    s = vector_states(spark, sf)
    parts = [pool(s, "id", how).withColumn("level", F.lit(lv))
             for lv, how in (("word", "cls"), ("sentence", "mean"), ("paragraph", "max"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("E7_fusion_concatenate", "WITH " + POOL_SQL + """ SELECT * FROM cls
  UNION ALL SELECT id, CAST(dim + 64 AS INT), value FROM mean UNION ALL SELECT id, CAST(dim + 128 AS INT), value FROM top""")
def _(spark, sf):
    return _spread(fuse_levels(_level_embeddings(spark, sf), "id", ["word", "sentence", "paragraph"]))


@query("E7_fusion_average", """WITH e AS (SELECT label AS id, vec_id, CAST(i - 1 AS INT) AS dim, CAST(embedding[i] AS DOUBLE) AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
SELECT id, dim, round((arg_min(x, vec_id) + avg(x) + max(x)) / 3, 6) AS value FROM e GROUP BY id, dim""")
def _(spark, sf):
    return _spread(fuse_levels(_level_embeddings(spark, sf), "id",
                               ["word", "sentence", "paragraph"], "average"))


@query("E2_token_states", f"""SELECT doc_id AS id, least(128, len(t)) AS tokens, 16 AS width
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TERM}') AS t FROM documents) WHERE len(t) > 0""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    encoder = WordVectorEncoder(size=16).fit(docs)
    return encoder.states(docs).groupBy("id").agg(
        F.count("*").alias("tokens"), F.max(F.size("vec")).alias("width"))


@query("E2_custom_encoder", f"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+')[1:128] AS t FROM documents)
SELECT id, len(t) AS tokens, CAST(list_sum(list_transform(t, lambda x: len(x))) AS DOUBLE) AS letters FROM t WHERE len(t) > 0""")
def _(spark, sf):
    """A user's batch encoder: one state per word, its length and its place."""
    def encode(batches):
        import re
        import pandas as pd
        for pdf in batches:
            rows = [(i, p, [float(len(w)), float(p)])
                    for i, text in zip(pdf["id"], pdf["text"])
                    for p, w in enumerate(re.findall("[a-z]+", text.lower())[:128])]
            yield pd.DataFrame(rows, columns=["id", "pos", "vec"])
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return FunctionEncoder(encode, 2).states(docs).groupBy("id").agg(
        F.count("*").alias("tokens"), F.sum(F.col("vec")[0].cast("double")).alias("letters"))


# ---- naive Bayes: the whole cross-validation in one statement ----

def bayes_sql(kind: str, alpha: float) -> str:
    weight, prior, offset = {
        "multinomial": ("ln((n + a) / (t + a * v))", "ln(d / dd)", "0"),
        "bernoulli": ("ln((n + a) / (d + 2 * a)) - ln(1 - (n + a) / (d + 2 * a))", "ln(d / dd)",
                      "ln(1 - (n + a) / (d + 2 * a))"),
        "complement": ("-ln((df - n + a) / (tt - t + a * v))", "0", "0")}[kind]
    return "WITH " + DOCS_SQL + f""",
tok AS (SELECT id, label, fold, {TERMS_SQL} FROM f),
k5 AS (SELECT unnest(range(5)) AS k), cls AS (SELECT DISTINCT label AS c FROM f),
tr AS (SELECT k, term, label AS c, count(*) AS n FROM tok JOIN k5 ON fold <> k GROUP BY ALL),
vocab AS (SELECT k, term, sum(n) AS df FROM tr GROUP BY k, term
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY sum(n) DESC, term) <= 5000),
dc AS (SELECT k, label AS c, count(*)::DOUBLE AS d, sum(count(*)) OVER (PARTITION BY k)::DOUBLE AS dd
  FROM f JOIN k5 ON fold <> k GROUP BY k, label),
g AS (SELECT v.k, v.term, v.df::DOUBLE AS df, cls.c, coalesce(tr.n, 0)::DOUBLE AS n, {alpha}::DOUBLE AS a
  FROM vocab v CROSS JOIN cls LEFT JOIN tr ON tr.k = v.k AND tr.term = v.term AND tr.c = cls.c),
tot AS (SELECT k, c, sum(n) AS t, count(*) AS v, sum(df) AS tt FROM g GROUP BY k, c),
w AS (SELECT k, term, c, {weight} AS w, {offset} AS off FROM g JOIN tot USING (k, c) JOIN dc USING (k, c)),
base AS (SELECT dc.k, dc.c, {prior} + (SELECT sum(off) FROM w WHERE w.k = dc.k AND w.c = dc.c) AS b FROM dc),
s AS (SELECT tok.id, w.c, sum(w) AS s FROM tok JOIN w ON tok.fold = w.k AND tok.term = w.term GROUP BY tok.id, w.c),
jll AS (SELECT f.id, f.fold, f.label, base.c, round(coalesce(s.s, 0) + b, 6) AS j
  FROM f JOIN base ON base.k = f.fold LEFT JOIN s ON s.id = f.id AND s.c = base.c),
pred AS (SELECT id, fold, label, max(j) FILTER (c = 0) AS j0, max(j) FILTER (c = 1) AS j1 FROM jll GROUP BY id, fold, label)"""


BAYES_OUT = """ SELECT id, fold, label, CAST(CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS INT) AS pred,
  round(1 / (1 + exp(j0 - j1)), 4) AS score FROM pred"""


def _bayes(spark, sf, kind, alpha):
    folded = stratified_folds(labelled_documents(spark, sf), "id", "label")
    p = cross_validated_bayes(folded, kind, alpha)
    return p.select("id", "fold", "label", "pred", F.round("score", 4).alias("score"))


@query("M7_multinomial", bayes_sql("multinomial", 1.0) + BAYES_OUT)
def _(spark, sf):
    return _bayes(spark, sf, "multinomial", 1.0)


@query("M7_multinomial_half", bayes_sql("multinomial", 0.5) + BAYES_OUT)
def _(spark, sf):
    return _bayes(spark, sf, "multinomial", 0.5)


@query("M7_multinomial_tenth", bayes_sql("multinomial", 0.1) + BAYES_OUT)
def _(spark, sf):
    return _bayes(spark, sf, "multinomial", 0.1)


@query("M7_bernoulli", bayes_sql("bernoulli", 1.0) + BAYES_OUT)
def _(spark, sf):
    return _bayes(spark, sf, "bernoulli", 1.0)


@query("M7_complement", bayes_sql("complement", 1.0) + BAYES_OUT)
def _(spark, sf):
    return _bayes(spark, sf, "complement", 1.0)


# ---- neighbours ----

NEAREST_SQL = """v AS (SELECT vec_id AS id, label, CAST((row_number() OVER (PARTITION BY label
  ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) - 1) % 5 AS INT) AS fold, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dist AS (SELECT q.id, q.fold, q.label, t.id AS neighbour, t.label AS c, {metric} AS d FROM v q JOIN v t ON q.fold <> t.fold),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS r FROM dist QUALIFY r <= {k}),
votes AS (SELECT id, fold, label, c, round(sum(CASE WHEN z = 1 THEN CAST(d = 0 AS INT)::DOUBLE ELSE 1 / d END), 6) AS w
  FROM (SELECT *, max(CAST(d = 0 AS INT)) OVER (PARTITION BY id) AS z FROM near) GROUP BY id, fold, label, c)"""
EUCLIDEAN = "list_distance(q.e, t.e)"
MANHATTAN = "list_sum(list_transform(list_zip(q.e, t.e), lambda p: abs(p[1] - p[2])))"


def folded_vectors(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    return stratified_folds(e, "id", "label")


def _neighbours(spark, sf, k, metric):
    rows = folded_vectors(spark, sf).persist()
    near = nearest(rows, rows, k, metric, by_fold=True)
    return rows.select("id", "fold", "label").join(vote(near, class_list(rows)), "id").select(
        "id", "fold", "label", "pred")


PREDICTED = """ SELECT id, fold, label, CAST(c AS INT) AS pred FROM votes
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, c) = 1"""


@query("M9_nearest_euclidean", "WITH " + NEAREST_SQL.format(metric=EUCLIDEAN, k=5) + PREDICTED)
def _(spark, sf):
    return _neighbours(spark, sf, 5, "euclidean")


@query("M9_nearest_manhattan", "WITH " + NEAREST_SQL.format(metric=MANHATTAN, k=7) + PREDICTED)
def _(spark, sf):
    return _neighbours(spark, sf, 7, "manhattan")


@query("J3_nearest_pairs", "WITH " + NEAREST_SQL.format(metric=EUCLIDEAN, k=5) + """
SELECT id, neighbour, CAST(r AS INT) AS rank, round(d, 6) AS distance FROM near""")
def _(spark, sf):
    rows = folded_vectors(spark, sf).persist()
    return nearest(rows, rows, 5, by_fold=True).select(
        "id", "neighbour", "rank", F.round("distance", 6).alias("distance"))


@query("W5_k_nearest", "WITH " + NEAREST_SQL.format(metric=EUCLIDEAN, k=3) + """
SELECT id, count(*) AS n, round(max(d), 6) AS radius FROM near GROUP BY id""")
def _(spark, sf):
    rows = folded_vectors(spark, sf).persist()
    return nearest(rows, rows, 3, by_fold=True).groupBy("id").agg(
        F.count("*").alias("n"), F.round(F.max("distance"), 6).alias("radius"))


# ---- voting and stacking on predictions tables ----

@query("M19_soft_vote", "WITH " + ",\n".join(
    f"{k} AS ({bayes_sql(k, 1.0)} SELECT id, fold, label, 1 / (1 + exp(j0 - j1)) AS p FROM pred)"
    for k in ("multinomial", "bernoulli", "complement")) + """
SELECT id, fold, label, CAST(CASE WHEN round(avg(p), 9) > round(1 - avg(p), 9) THEN 1 ELSE 0 END AS INT) AS pred, round(avg(p), 4) AS score
  FROM (SELECT * FROM multinomial UNION ALL SELECT * FROM bernoulli UNION ALL SELECT * FROM complement) GROUP BY id, fold, label""")
def _(spark, sf):
    folded = stratified_folds(labelled_documents(spark, sf), "id", "label").persist()
    parts = [p.select("id", "fold", "label", "proba")
             for p in cross_validated_kinds(folded, ("multinomial", "bernoulli", "complement"))]
    votes = soft_vote(parts[0].unionByName(parts[1]).unionByName(parts[2]),
                      ["id", "fold", "label"], (0, 1))
    return votes.select("id", "fold", "label", "pred", F.round("score", 4).alias("score"))


@query("J5_meta_features", "WITH " + ",\n".join(
    f"{k} AS ({bayes_sql(k, 1.0)} SELECT id, label, 1 / (1 + exp(j0 - j1)) AS p FROM pred)"
    for k in ("multinomial", "bernoulli")) + """
SELECT id, m.label, round(m.p, 4) AS multinomial, round(b.p, 4) AS bernoulli FROM multinomial m JOIN bernoulli b USING (id)""")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array
    folded = stratified_folds(labelled_documents(spark, sf), "id", "label").persist()
    names = ["multinomial", "bernoulli"]
    parts = cross_validated_kinds(folded, names)
    wide = meta_features(parts, names, ["label"], 2).withColumn("v", vector_to_array("features"))
    return wide.select("id", "label", F.round(F.col("v")[0], 4).alias("multinomial"),
                       F.round(F.col("v")[1], 4).alias("bernoulli"))


# ---- one query per model: trained on four fifths of the users, applied to the rest ----

def held_out(spark: SparkSession, sf: str, name: str, model: Model) -> DataFrame:
    data = labelled_users(spark, sf)
    split = train_test_split(data, "id", "label").persist()
    train = split.where("split = 'train'").drop("split")
    test = split.where("split = 'test'").drop("split")
    bag = BagOfWords().fit(train)
    fitted = E.fit_model(model, train, bag, describe(train, len(bag.terms)))
    p = fitted.predict(bag.transform(test).persist(), ["label"])
    return p.select("id", F.lit(name).alias("model"), "label", "pred",
                    F.transform("proba", lambda x: F.round(x, 6)).alias("proba"))


def _register_models() -> None:
    groups = {
        "M1": ("LogisticRegression", "OptimizedLogisticRegression", "ClinicalLogisticRegression"),
        "M2": ("RidgeClassifier",), "M3": ("SGDClassifier",), "M4": ("LinearSVC",),
        "M5": ("SVC", "ClinicalSVM"), "M6": ("OptimizedSVC",),
        "M7": ("MultinomialNB", "BernoulliNB", "ComplementNB", "ClinicalNaiveBayes"),
        "M8": ("DecisionTreeClassifier", "OptimizedDecisionTree", "ClinicalDecisionTree"),
        "M9": ("KNeighborsClassifier",), "M10": ("MLPClassifier", "ClinicalMLP"),
        "M11": ("LinearDiscriminantAnalysis",), "M12": ("QuadraticDiscriminantAnalysis",),
        "M13": ("RandomForestClassifier", "ClinicalRandomForest"),
        "M14": ("ExtraTreesClassifier",),
        "M15": ("GradientBoostingClassifier", "ClinicalGradientBoosting"),
        "M16": ("ClinicalXGBoost", "LGBMClassifier"), "M17": ("AdaBoostClassifier",),
        "M18": ("ClinicalBagging",),
        "M19": ("VotingClassifier_Diverse", "ClinicalVotingClassifier"),
        "M20": ("StackingClassifier_LR",), "M22": ("BERT-LR", "BERT-SVM"),
        "M23": ("BERT-Multilevel",),
    }
    known = {**registry.all_models(), **registry.optimized_classical_models(),
             **registry.clinical_classical_models(), **registry.clinical_ensemble_models(True),
             **registry.optimized_ensemble_models(True), **registry.external_boosters(),
             **registry.stacking_models()}
    for group, names in groups.items():
        for n in names:
            query(f"{group}_{n.replace('-', '_')}")(
                lambda spark, sf, n=n: held_out(spark, sf, n, known[n]))


_register_models()


@query("M21_voting_by_type")
def _(spark, sf):
    members = {"lr": registry.Logistic(), "nb": registry.NaiveBayes(), "tree": registry.Tree()}
    return held_out(spark, sf, "voting", build_ensemble("voting", members))


@query("M21_stacking_by_type")
def _(spark, sf):
    members = {"nb": registry.NaiveBayes(), "tree": registry.Tree()}
    return held_out(spark, sf, "stacking", build_ensemble("stacking", members))


@query("M21_bagging_by_type")
def _(spark, sf):
    return held_out(spark, sf, "bagging", build_ensemble("bagging", {"tree": registry.Tree(5)}))


@query("M24_chosen_sizes")
def _(spark, sf):
    data = labelled_users(spark, sf).persist()
    fitted = MultilevelClassifier(encoder=WordVectorEncoder(size=8)).fit(data, describe(data))
    return fitted.selection()


@query("U2_custom_model")
def _(spark, sf):
    from pyspark.ml.classification import FMClassifier
    return held_out(spark, sf, "factorisation", registry.CustomModel(
        lambda ctx: FMClassifier(factorSize=4, maxIter=20, seed=ctx.seed)))


@query("U3_feature_engineer", """SELECT user_id, count(*) AS n, CASE WHEN max(value) > 200 THEN 'normal high' ELSE 'normal' END AS text
  FROM events GROUP BY user_id""")
def _(spark, sf):
    from thresher.operators.prepare import engineer
    def step(df):
        return df.groupBy("user_id").agg(
            F.count("*").alias("n"), F.when(F.max("value") > 200, "normal high").otherwise("normal").alias("text"))
    return engineer(table(spark, sf, "events"), step)


# ---- evaluations ----

def few_models() -> dict[str, Model]:
    c = registry.classical_models()
    return {n: c[n] for n in ("LogisticRegression", "MultinomialNB", "DecisionTreeClassifier")}


@query("V1_evaluate_model")
def _(spark, sf):
    return E.evaluate_model(labelled_users(spark, sf), "DecisionTreeClassifier",
                            few_models()["DecisionTreeClassifier"])


@query("V1_bayes_metrics", bayes_sql("multinomial", 1.0) + """, o AS (SELECT fold, label,
  CAST(CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS INT) AS p, round(1 / (1 + exp(j0 - j1)), 9) AS s FROM pred),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0::DOUBLE AS k FROM o)
SELECT fold, round(avg(CASE WHEN p = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
  round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS roc_auc FROM r GROUP BY fold""")
def _(spark, sf):
    folded = stratified_folds(labelled_documents(spark, sf), "id", "label").persist()
    p = cut_lineage(cross_validated_bayes(folded).withColumn("score", F.round("score", 9)))
    acc = p.groupBy("fold").agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6)
                                .alias("accuracy"))
    auc = ranking_metrics(p, ["fold"]).select("fold", F.round("roc_auc", 6).alias("roc_auc"))
    return acc.join(auc, "fold")


@query("V2_evaluate_models")
def _(spark, sf):
    return E.sorted_models(E.evaluate_models(labelled_users(spark, sf), few_models()))


def _grid_bayes_sql() -> str:
    """Accuracy of multinomial Bayes (alpha 1) on every word and sentence cut of the documents."""
    from thresher.functions.columns import SPACE_CLASS
    cuts = [("word", str(n), n) for n in (5, 10, 15, 20)] + [("sentence", str(n), 5 * n) for n in (1, 2, 3)]
    parts = " UNION ALL ".join(
        f"SELECT id, label, fold, '{lv}' AS level, '{s}' AS size, CASE WHEN len(ws) > {n} OR '{lv}' = 'sentence' "
        f"THEN array_to_string(ws[1:{n}], ' ') ELSE text END AS text FROM tk" for lv, s, n in cuts)
    return "WITH " + DOCS_SQL + f""", tk AS (SELECT *, regexp_extract_all(text, '[^{SPACE_CLASS}]+') AS ws FROM f),
x AS ({parts}), tok AS (SELECT id, label, fold, level, size, {TERMS_SQL} FROM x),
k5 AS (SELECT unnest(range(5)) AS k), cls AS (SELECT DISTINCT label AS c FROM f),
tr AS (SELECT level, size, k, term, label AS c, count(*) AS n FROM tok JOIN k5 ON fold <> k GROUP BY ALL),
vocab AS (SELECT level, size, k, term FROM tr GROUP BY level, size, k, term QUALIFY row_number() OVER (PARTITION BY level, size, k ORDER BY sum(n) DESC, term) <= 5000),
dc AS (SELECT k, label AS c, count(*)::DOUBLE AS d, sum(count(*)) OVER (PARTITION BY k)::DOUBLE AS dd FROM f JOIN k5 ON fold <> k GROUP BY k, label),
g AS (SELECT v.*, cls.c, coalesce(tr.n, 0)::DOUBLE AS n FROM vocab v CROSS JOIN cls LEFT JOIN tr
  ON tr.level = v.level AND tr.size = v.size AND tr.k = v.k AND tr.term = v.term AND tr.c = cls.c),
w AS (SELECT level, size, k, term, c, ln((n + 1) / (sum(n) OVER z + count(*) OVER z)) AS w FROM g WINDOW z AS (PARTITION BY level, size, k, c)),
s AS (SELECT level, size, tok.id, w.c, sum(w) AS s FROM tok JOIN w USING (level, size, term) WHERE tok.fold = w.k GROUP BY ALL),
j AS (SELECT x.level, x.size, x.id, x.fold, x.label, dc.c, round(coalesce(s.s, 0) + ln(d / dd), 6) AS j
  FROM x JOIN dc ON dc.k = x.fold LEFT JOIN s ON s.level = x.level AND s.size = x.size AND s.id = x.id AND s.c = dc.c),
p AS (SELECT level, size, id, fold, label, CASE WHEN max(j) FILTER (c = 1) > max(j) FILTER (c = 0) THEN 1 ELSE 0 END AS pred FROM j GROUP BY ALL)
SELECT level, size, fold, count(*) AS n, round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy
FROM p GROUP BY level, size, fold"""


@query("V3_bayes_over_extractions", _grid_bayes_sql())
def _(spark, sf):
    """Every word and sentence cell and every fold of one model in a single plan."""
    p = E.bayes_over_extractions(labelled_documents(spark, sf), "MultinomialNB",
                                 registry.NaiveBayes(), {"word": (5, 10, 15, 20), "sentence": (1, 2, 3)},
                                 baseline=False)
    return p.groupBy("level", "size", "fold").agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query("V3_evaluate_extractions")
def _(spark, sf):
    r = E.evaluate_extractions(labelled_users(spark, sf), few_models())
    return E.cell_scores(r, list(few_models()))


def _bayes_cells() -> dict:
    return {"word": (5, 10, 15, 20), "sentence": (1, 2, 3)}


@query("V4_bayes_benchmark", f"SELECT level, size, round(avg(accuracy), 4) AS score FROM ({_grid_bayes_sql()}) GROUP BY level, size")
def _(spark, sf):
    """The whole benchmark with one model, against the statement that counts its accuracies."""
    docs = labelled_documents(spark, sf)
    tables = E.benchmark(docs, {"MultinomialNB": registry.NaiveBayes()}, _bayes_cells())
    return (tables["scores"].where("size <> 'Baseline'")
            .select("level", "size", F.round("score", 4).alias("score")))


@query("V3_linear_grid")
def _(spark, sf):
    """Every cell and fold of the documents, fitted together."""
    models = {"LogisticRegression": registry.classical_models()["LogisticRegression"]}
    return E.cell_scores(E.evaluate_extractions(labelled_documents(spark, sf), models), list(models))


@query("V4_benchmark")
def _(spark, sf):
    return E.benchmark(labelled_users(spark, sf), few_models())["extraction_best"]


@query("V8_binary_classification")
def _(spark, sf):
    from thresher.evaluation.lifecycle import classify
    from thresher.plans.common import USER_RULES
    data = user_topics(spark, sf).drop("text").withColumn("target", (F.col("v_std") > 45).cast("double"))
    return classify(data, USER_RULES, few_models(), "user_id", label="target")["best_overall"]


@query("V8_multiclass_classification")
def _(spark, sf):
    from thresher.evaluation.lifecycle import classify
    from thresher.plans.common import USER_RULES, users
    return classify(users(spark, sf), USER_RULES, few_models(), "user_id")["scores"]


@query("V9_quick_evaluation")
def _(spark, sf):
    from thresher.evaluation.lifecycle import quick_evaluation
    return quick_evaluation(spark, f"{sf}/customer.parquet", "c_nationkey_high", {
        "rich": ("c_acctbal", ">", 5000), "poor": ("c_acctbal", "<", 0), "mid": ("c_acctbal", ">", 2500)},
        {"DecisionTreeClassifier": few_models()["DecisionTreeClassifier"]}, "c_custkey",
        engineer=lambda df: df.withColumn("c_nationkey_high", (F.col("c_nationkey") > 12).cast("int")))[
            "best_overall"]


@query("V10_named_benchmark")
def _(spark, sf):
    from thresher.evaluation.lifecycle import benchmark_named
    return benchmark_named(labelled_users(spark, sf), ["RidgeClassifier", "BernoulliNB"])


# ---- ridge on two features against the normal equations ----

RIDGE_SQL = """WITH d AS (
  SELECT doc_id AS id, n_chars / 1000.0 AS x, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS z, 2.0 * toxic - 1 AS y
  FROM documents JOIN labels USING (doc_id)),
m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM d),
s AS (SELECT sum((x - mx) * (x - mx)) + 1 AS xx, sum((z - mz) * (z - mz)) + 1 AS zz, sum((x - mx) * (z - mz)) AS xz,
  sum((x - mx) * (y - my)) AS xy, sum((z - mz) * (y - my)) AS zy FROM d, m),
b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM s)
SELECT id, round(my + bx * (x - mx) + bz * (z - mz), 6) + 0.0 AS score FROM d, m, b"""


@query("M2_ridge_closed_form", RIDGE_SQL)
def _(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = table(spark, sf, "documents").join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "label", (F.col("n_chars") / 1000).alias("x"),
        F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("z"))
    rows = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(rows)
    fitted = registry.classical_models()["RidgeClassifier"].fit(rows, describe(rows, 2))
    scored = fitted.predict(rows)
    return scored.select("id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


# ---- squared hinge on two features against active-set Newton steps; the gap of kernel machines ----

def _squared_hinge_sql(steps: int = 15) -> str:
    """Each step solves (I + 2 sum x x') b = 2 sum y x over the rows within the margin."""
    chain = ["""d AS (SELECT doc_id AS id, n_chars / 1000.0::DOUBLE AS x, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS z,
  2.0::DOUBLE * toxic - 1 AS y FROM documents JOIN labels USING (doc_id)),
p0 AS (SELECT 0.0::DOUBLE AS bx, 0.0::DOUBLE AS bz, 0.0::DOUBLE AS b)"""]
    for i in range(steps):
        chain.append(f"""s{i} AS (SELECT 1 + 2 * sum(x * x) AS a, 2 * sum(x * z) AS b, 2 * sum(x) AS c, 1 + 2 * sum(z * z) AS e, 2 * sum(z) AS f,
  1 + 2 * count(*)::DOUBLE AS i, 2 * sum(y * x) AS u, 2 * sum(y * z) AS v, 2 * sum(y) AS w FROM d, p{i} WHERE y * (bx * x + bz * z + p{i}.b) < 1),
t{i} AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM s{i}),
p{i + 1} AS (SELECT (u * (e * i - f * f) - b * (v * i - f * w) + c * (v * f - e * w)) / det AS bx,
  (a * (v * i - f * w) - u * (b * i - f * c) + c * (b * w - v * c)) / det AS bz,
  (a * (e * w - v * f) - b * (b * w - v * c) + u * (b * f - e * c)) / det AS b FROM t{i})""")
    return "WITH " + ",\n".join(chain) + f""" SELECT id, CAST(CASE WHEN s > 0 THEN 1 ELSE 0 END AS INT) AS pred, round(s, 5) + 0.0::DOUBLE AS score
  FROM (SELECT id, bx * x + bz * z + p{steps}.b AS s FROM d, p{steps})"""


def two_columns(spark, sf) -> DataFrame:
    """(id, label, features): length and language of the labelled documents, label toxic."""
    from pyspark.ml.feature import VectorAssembler
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = table(spark, sf, "documents").join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "label", (F.col("n_chars") / 1000).alias("x"),
        F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("z"))
    return VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(rows)


@query("M4_squared_hinge", _squared_hinge_sql())
def _(spark, sf):
    rows = two_columns(spark, sf)
    fitted = registry.classical_models()["LinearSVC"].fit(rows, describe(rows, 2))
    return fitted.predict(rows).select("id", "pred", (F.round("score", 5) + F.lit(0.0)).alias("score"))


def _duality(spark, sf, name: str) -> DataFrame:
    """Rows, rank and the relative gap between primal and dual objective of a machine on documents."""
    from thresher.models.linear import FittedSupport
    model = {**registry.classical_models(), **registry.optimized_classical_models()}[name]
    data = labelled_documents(spark, sf)
    bag = BagOfWords().fit(data)
    fitted: FittedSupport = E.fit_model(model, data, bag, describe(data, len(bag.terms)))
    gap = float((fitted.found.gap / fitted.found.objective).max())
    return data.groupBy("label").agg(F.count("*").alias("n")).select(
        F.lit(name).alias("model"), "label", "n", F.lit(gap < 1e-3).alias("gap_below"))


GAP_SQL = """SELECT '{}' AS model, quality AS label, count(*) AS n, true AS gap_below
  FROM documents JOIN labels USING (doc_id) GROUP BY quality"""


@query("M5_dual_gap", GAP_SQL.format("SVC"))
def _(spark, sf):
    return _duality(spark, sf, "SVC")


@query("M6_dual_gap", GAP_SQL.format("OptimizedSVC"))
def _(spark, sf):
    return _duality(spark, sf, "OptimizedSVC")


# ---- two rounds of second-order boosting on two columns ----

TWO_ROUNDS = dict(rate=0.3, l1=0.001, l2=0.1, min_hessian=0.1)


def _two_rounds_sql() -> str:
    """Each round: the best cut of all rows, then of the side where it gains most (three leaves)."""
    rate, l1, l2, least = (TWO_ROUNDS[c] for c in ("rate", "l1", "l2", "min_hessian"))

    def gain(g, h):
        return f"power(greatest(abs({g}) - {l1}, 0), 2) / ({h} + {l2}) / 2"

    def best(name, rows):
        return f"""{name} AS (SELECT * FROM (SELECT col, thr, gl, hl, gt - gl AS gr, ht - hl AS hr,
  round({gain('gl', 'hl')} + {gain('(gt - gl)', '(ht - hl)')} - {gain('gt', 'ht')}, 9) AS gain FROM (
  SELECT col, thr, sum(g) FILTER (v <= thr) AS gl, sum(h) FILTER (v <= thr) AS hl, sum(g) AS gt, sum(h) AS ht,
    count(*) FILTER (v <= thr) AS nl, count(*) AS n FROM (SELECT g, h, col, thr, CASE WHEN col = 0 THEN x ELSE z END AS v FROM {rows}, cuts) GROUP BY col, thr)
  WHERE nl > 0 AND nl < n AND hl >= {least} AND ht - hl >= {least}) ORDER BY gain DESC, col, thr LIMIT 1)"""

    def leaf(g, h):
        return f"(-sign({g}) * greatest(abs({g}) - {l1}, 0) / ({h} + {l2}) * {rate})"
    parts = ["""d AS (SELECT doc_id AS id, least(n_chars // 400, 9)::DOUBLE AS x,
  CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 0 END::DOUBLE AS z, quality AS y FROM documents JOIN labels USING (doc_id)),
cuts AS (SELECT 0 AS col, i + 0.5::DOUBLE AS thr FROM range(9) t(i) UNION ALL SELECT 1, i + 0.5::DOUBLE FROM range(3) t(i)),
m0 AS (SELECT *, 0.0::DOUBLE AS m FROM d)"""]
    side = "(CASE WHEN b.col = 0 THEN x ELSE z END <= b.thr)"
    for i in range(2):
        p = "(1 / (1 + exp(-m)))"
        parts += [f"g{i} AS (SELECT *, {p} - y AS g, {p} * (1 - {p}) AS h FROM m{i})", best(f"b{i}", f"g{i}"),
                  f"s{i} AS (SELECT g{i}.*, {side} AS l FROM g{i}, b{i} b)",
                  best(f"l{i}", f"(SELECT * FROM s{i} WHERE l)"), best(f"r{i}", f"(SELECT * FROM s{i} WHERE NOT l)"),
                  f"c{i} AS (SELECT *, true AS side FROM l{i} UNION ALL SELECT *, false FROM r{i} ORDER BY gain DESC, side DESC LIMIT 1)",
                  f"""m{i + 1} AS (SELECT s.id, x, z, y, m + CASE WHEN a.gain <= 0 THEN {leaf('(a.gl + a.gr)', '(a.hl + a.hr)')}
  WHEN s.l = b.side AND b.gain > 0 THEN CASE WHEN {side} THEN {leaf('b.gl', 'b.hl')} ELSE {leaf('b.gr', 'b.hr')} END
  WHEN s.l THEN {leaf('a.gl', 'a.hl')} ELSE {leaf('a.gr', 'a.hr')} END AS m FROM s{i} s, b{i} a, c{i} b)"""]
    return "WITH " + ",\n".join(parts) + " SELECT id, round(1 / (1 + exp(-m)), 8) AS score FROM m2"


@query("M16_two_rounds", _two_rounds_sql())
def _(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from thresher.models.histograms import BoostSettings, SecondOrderBoosting
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = table(spark, sf, "documents").join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "label", F.least(F.floor(F.col("n_chars") / 400), F.lit(9)).cast("double").alias("x"),
        F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3)
        .otherwise(0).cast("double").alias("z"))
    rows = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(rows)
    model = SecondOrderBoosting(BoostSettings(rounds=2, max_depth=2, leaves=3, **TWO_ROUNDS))
    return model.fit(rows, describe(rows, 2)).predict(rows).select("id", F.round("score", 8).alias("score"))
