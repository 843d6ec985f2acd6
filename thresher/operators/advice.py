"""Model suitability, settings and recommendations from dataset characteristics.

``characteristics``: (n_samples, n_features, sparsity, class_balance), one row
per dataset, plus any key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from thresher.functions.columns import distinct_terms



def _c(name: str) -> Column:
    return F.col(name)


def table_characteristics(df: DataFrame, features: Sequence[str], label: str,
                          keys: Sequence[str] = ()) -> DataFrame:
    """Characteristics of wide numeric tables; sparsity is the share of zero cells."""
    zeros = F.lit(0)
    for f in features:
        zeros = zeros + (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) == 0).cast("int")
    per_class = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.sum(zeros).alias("z"))
    return per_class.groupBy(*keys).agg(
        F.sum("n").alias("n_samples"), F.lit(len(features)).alias("n_features"),
        (F.sum("z").cast("double") / (F.sum("n") * len(features))).alias("sparsity"),
        (F.min("n").cast("double") / F.max("n")).alias("class_balance"))


def text_characteristics(docs: DataFrame, text: str, label: str) -> DataFrame:
    """Characteristics of the binary bag of words of a labelled text table."""
    counted = docs.select(label, F.size(distinct_terms(text)).alias("k"))
    rows = counted.groupBy(label).agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    base = rows.agg(F.sum("n").alias("n_samples"), F.sum("k").alias("_filled"),
                    (F.min("n").cast("double") / F.max("n")).alias("class_balance"))
    width = (docs.select(F.explode(distinct_terms(text)).alias("t")).distinct()
             .agg(F.count("*").cast("int").alias("n_features"))).scalar()
    return base.withColumn("n_features", width).select(
        "n_samples", "n_features",
        (1 - F.col("_filled") / (F.col("n_samples") * F.col("n_features"))).alias("sparsity"),
        "class_balance")


# Base score, then (column, comparison, limit, change) per model.
SUITABILITY = {
    "LogisticRegression": (0.8, [("n_samples", "<", 1000, -0.1), ("class_balance", "<", 0.3, -0.1)]),
    "SVC": (0.7, [("n_samples", ">", 5000, -0.2), ("n_features", ">", "n_samples", 0.1),
                  ("sparsity", ">", 0.5, 0.1)]),
    "MultinomialNB": (0.6, [("sparsity", ">", 0.3, 0.2), ("n_samples", "<", 500, 0.1),
                            ("class_balance", "<", 0.2, -0.2)]),
    "DecisionTreeClassifier": (0.6, [("n_features", "<", 50, 0.1), ("class_balance", "<", 0.3, -0.1)]),
    "KNeighborsClassifier": (0.5, [("n_samples", "<", 1000, 0.2), ("n_features", ">", 100, -0.2),
                                   ("sparsity", ">", 0.5, -0.2)]),
    "MLPClassifier": (0.4, [("n_samples", ">", 2000, 0.3), ("n_features", ">", 50, 0.2),
                            ("class_balance", "<", 0.2, -0.2)]),
}


def _test(column: str, op: str, limit) -> Column:
    right = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return F.col(column) < right if op == "<" else F.col(column) > right


def suitability(characteristics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, model, score in [0, 1])."""
    rows = []
    for model, (base, changes) in SUITABILITY.items():
        score = F.lit(base)
        for column, op, limit, change in changes:
            score = score + F.when(_test(column, op, limit), F.lit(change)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(model).alias("model"), F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))).alias("score")))
    return characteristics.select(*keys, F.inline(F.array(*rows)))


def _steps(column: str, low, below: str, high, above: str, middle: str) -> Column:
    """``below`` under ``low``, ``above`` over ``high``, ``middle`` between."""
    return F.when(_c(column) < low, below).when(_c(column) > high, above).otherwise(middle)


def _balanced() -> Column:
    return F.when(_c("class_balance") < 0.3, "balanced")


def _bounded(low: int, high: int, divisor: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.expr(f"n_samples div {divisor}"))).cast("string")


def _wide() -> Column:
    return _c("n_features") > _c("n_samples")


def _settings() -> dict[str, dict[str, Column]]:
    """Suggested settings; a NULL value is a setting not suggested."""
    lit = F.lit
    return {
        "LogisticRegression": {
            "C": _steps("n_samples", 500, "0.1", 5000, "10.0", "1.0"),
            "class_weight": _balanced(),
            "max_iter": _bounded(1000, 2000, 10)},
        "SVC": {
            "C": F.when(_wide(), "0.1").otherwise("1.0"),
            "kernel": F.when(_c("n_samples") < 1000, "linear").otherwise("rbf"),
            "class_weight": _balanced()},
        "DecisionTreeClassifier": {
            "max_depth": _steps("n_samples", 500, "5", 5000, "15", "10"),
            "min_samples_split": _steps("n_samples", 500, "20", 5000, "10", "15"),
            "class_weight": _balanced()},
        "MLPClassifier": {
            "hidden_layer_sizes": _steps("n_samples", 1000, "50", 5000, "200,100", "100"),
            "alpha": F.when(_wide(), "0.01").otherwise("0.001"),
            "max_iter": _bounded(500, 1000, 5)},
        "RandomForestClassifier": {
            "n_estimators": _steps("n_samples", 1000, "50", 10000, "200", "100"),
            "max_features": F.when(_c("n_features") < 10, "None").otherwise("sqrt"),
            "class_weight": _balanced(),
            "max_depth": F.when(_c("n_samples") < 500, "5").otherwise("10"),
            "min_samples_split": F.when(_c("n_samples") < 500, "20").otherwise("10")},
        "GradientBoostingClassifier": {
            "n_estimators": _steps("n_samples", 1000, "50", 5000, "200", "100"),
            "learning_rate": _steps("n_samples", 1000, "0.1", 5000, "0.05", "0.1"),
            "max_depth": F.when(_c("n_features") < 20, "3").otherwise("6"),
            "subsample": F.when(_c("n_samples") < 1000, "1.0").otherwise("0.8"),
            "min_samples_split": F.when(_c("n_samples") < 1000, "20").otherwise("10")},
        "XGBClassifier": {
            "n_estimators": _steps("n_samples", 1000, "50", 10000, "300", "100"),
            "learning_rate": _steps("n_samples", 1000, "0.1", 10000, "0.03", "0.1"),
            "max_depth": _steps("n_samples", 1000, "3", 10000, "8", "6"),
            "reg_alpha": F.when(_wide(), "0.1"), "reg_lambda": F.when(_wide(), "0.1"),
            "subsample": lit("0.8"), "colsample_bytree": lit("0.8")},
        "LGBMClassifier": {
            "n_estimators": F.when(_c("n_samples") < 1000, "50").otherwise("100"),
            "learning_rate": lit("0.1"),
            "max_depth": F.when(_c("n_samples") < 1000, "3").otherwise("6"),
            "num_leaves": F.when(_c("n_samples") < 1000, "15").otherwise("31"),
            "subsample": lit("0.8"), "colsample_bytree": lit("0.8")},
    }


def suggested_settings(characteristics: DataFrame, keys: Sequence[str] = (),
                       models: Sequence[str] | None = None) -> DataFrame:
    """(keys, model, param, value) with values as text."""
    rows = [F.struct(F.lit(m).alias("model"), F.lit(p).alias("param"), v.alias("value"))
            for m, params in _settings().items() if models is None or m in models
            for p, v in params.items()]
    return (characteristics.select(*keys, F.inline(F.array(*rows)))
            .where(F.col("value").isNotNull()))


# Reasons given with a recommendation.
REASONS = {
    "small": "Random Forest works well with small datasets and provides good baseline performance",
    "lgbm": "LightGBM is efficient for large datasets",
    "xgb": "XGBoost provides excellent performance for medium-sized datasets",
    "gb": "Gradient Boosting provides good performance when XGBoost is not available",
    "voting": "Voting ensemble can help with imbalanced data by combining diverse models",
    "wide": "Random Forest handles high-dimensional data well",
    "extra": "Extra Trees provides good alternative with more randomness",
    "clinical": "Designed specifically for clinical data with interpretability and stability in mind",
}


def ensemble_recommendation(characteristics: DataFrame, keys: Sequence[str] = (),
                            has_lightgbm: bool = False, has_xgboost: bool = False) -> DataFrame:
    """(keys, kind, model, reason) for kinds primary, secondary and clinical."""
    def choice(model: str, reason: str) -> Column:
        return F.struct(F.lit(model).alias("model"), F.lit(REASONS[reason]).alias("reason"))

    default = choice("XGBClassifier", "xgb") if has_xgboost else choice(
        "GradientBoostingClassifier", "gb")
    primary = F.when(_c("n_samples") < 1000, choice("RandomForestClassifier", "small"))
    if has_lightgbm:
        primary = primary.when(_c("n_samples") > 10000, choice("LGBMClassifier", "lgbm"))
    primary = primary.otherwise(default)
    secondary = (F.when(_c("class_balance") < 0.3, choice("VotingClassifier", "voting"))
                 .when(_wide(), choice("RandomForestClassifier", "wide"))
                 .otherwise(choice("ExtraTreesClassifier", "extra")))
    clinical = choice("ClinicalRandomForest", "clinical")
    rows = [F.struct(F.lit(kind).alias("kind"), c["model"].alias("model"),
                     c["reason"].alias("reason"))
            for kind, c in (("primary", primary), ("secondary", secondary),
                            ("clinical", clinical))]
    return characteristics.select(*keys, F.inline(F.array(*rows)))
