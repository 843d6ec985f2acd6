"""Named models with their fixed settings, and custom ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from thresher.models.base import Context, Fitted, Model
from thresher.models.bayes import NaiveBayes
from thresher.models.discriminant import Discriminant
from thresher.models.embedding import EmbeddingClassifier, MultilevelClassifier
from thresher.models.ensemble import Stacking, Voting
from thresher.models.histograms import BoostSettings, ExtraTrees, SecondOrderBoosting
from thresher.models.linear import (HingeLinear, Logistic, Perceptron, Ridge, SquaredHinge,  # noqa: F401
                                    SupportVector)
from thresher.models.neighbours import NearestNeighbours
from thresher.models.stochastic import AdamPerceptron, StochasticHinge
from thresher.models.trees import AdaBoost, Bagging, Boosting, Forest, Tree

# Trees of unlimited depth: Spark ML allows 30 levels.
UNLIMITED = 30


def classical_models() -> dict[str, Model]:
    return {
        "LogisticRegression": Logistic(),
        "RidgeClassifier": Ridge(),
        "SGDClassifier": StochasticHinge(alpha=1e-4, tol=1e-3),
        "SVC": SupportVector("linear", C=1.0),
        "LinearSVC": SquaredHinge(C=1.0),
        "MultinomialNB": NaiveBayes("multinomial", 1.0),
        "BernoulliNB": NaiveBayes("bernoulli", 1.0),
        "ComplementNB": NaiveBayes("complement", 1.0),
        "DecisionTreeClassifier": Tree(max_depth=10, min_leaf=2),
        "KNeighborsClassifier": NearestNeighbours(5, "euclidean"),
        "MLPClassifier": AdamPerceptron((100,), max_iter=500),
        "LinearDiscriminantAnalysis": Discriminant(),
        "QuadraticDiscriminantAnalysis": Discriminant(quadratic=True, ridge=1e-3),
    }


def optimized_classical_models() -> dict[str, Model]:
    return {
        "OptimizedLogisticRegression": Logistic(C=0.1, max_iter=2000),
        "OptimizedSVC": SupportVector("rbf", C=10.0),
        "OptimizedDecisionTree": Tree(max_depth=15, min_leaf=5),
        "OptimizedMLP": AdamPerceptron((200, 100), max_iter=1000, alpha=1e-3, held_out=0.15),
        "OptimizedKNN": NearestNeighbours(7, "manhattan"),
        "OptimizedMultinomialNB": NaiveBayes("multinomial", 0.5),
    }


def clinical_classical_models() -> dict[str, Model]:
    return {
        "ClinicalLogisticRegression": Logistic(C=1.0, max_iter=2000, balanced=True),
        "ClinicalSVM": SupportVector("linear", C=0.1, balanced=True),
        "ClinicalNaiveBayes": NaiveBayes("multinomial", 0.1),
        "ClinicalDecisionTree": Tree(max_depth=5, min_leaf=10, balanced=True),
        "ClinicalMLP": Perceptron((50,), max_iter=1000),
    }


def voting_models() -> dict[str, Model]:
    lr = Logistic()
    rf = Forest(50, max_depth=UNLIMITED)
    gb = Boosting(50, 0.1, 3)
    return {
        "VotingClassifier_Basic": Voting({"lr": lr, "rf": rf, "svm": SupportVector("rbf")}),
        "VotingClassifier_Diverse": Voting({"lr": lr, "rf": rf, "nb": NaiveBayes(), "gb": gb}),
        "VotingClassifier_TreeBased": Voting({
            "rf": rf, "et": ExtraTrees(50, max_depth=UNLIMITED), "gb": gb}),
    }


def depthwise_booster(rounds: int, rate: float, max_depth: int, l1: float = 0.0, l2: float = 1.0) -> Model:
    """Level by level to a depth, L2 1 and a hessian of 1 in every leaf unless said otherwise."""
    return SecondOrderBoosting(BoostSettings(rounds, rate, max_depth, l1=l1, l2=l2, subsample=0.8, column_share=0.8))


def leafwise_booster(rounds: int, rate: float, max_depth: int, leaves: int, l1: float = 0.0,
                     l2: float = 0.0) -> Model:
    """The leaf of highest gain first, 20 rows and a hessian of 0.001 in every leaf, from the log
    odds. A row share without a bagging frequency has no effect there, so all rows are taken."""
    return SecondOrderBoosting(BoostSettings(rounds, rate, max_depth, leaves, l2, l1, 1e-3, 20.0,
                                             column_share=0.8, from_average=True))


def external_boosters() -> dict[str, Model]:
    """The three families of boosting libraries: by level, by leaf, and with symmetric trees."""
    return {
        "XGBClassifier": depthwise_booster(100, 0.1, 6),
        "LGBMClassifier": leafwise_booster(100, 0.1, 6, 31),
        "CatBoostClassifier": SecondOrderBoosting(BoostSettings(100, 0.1, 6, l2=3.0, min_hessian=0.0, symmetric=True)),
    }


def ensemble_models(external: bool = False) -> dict[str, Model]:
    models: dict[str, Model] = {
        "RandomForestClassifier": Forest(100, max_depth=10, min_leaf=2),
        "GradientBoostingClassifier": Boosting(100, 0.1, 6, min_leaf=4),
        "ExtraTreesClassifier": ExtraTrees(100, max_depth=10, min_leaf=2, min_split=5),
        "AdaBoostClassifier": AdaBoost(50, 1.0, 1),
        "BaggingClassifier": Bagging(50, 0.8, 0.8),
    }
    if external:
        models.update(external_boosters())
    models.update(voting_models())
    return models


def optimized_ensemble_models(external: bool = False) -> dict[str, Model]:
    models: dict[str, Model] = {
        "OptimizedRandomForest": Forest(200, max_depth=15, min_leaf=4, balanced=True),
        "OptimizedGradientBoosting": Boosting(150, 0.05, 8, min_leaf=10, subsample=0.8,
                                              feature_subset="sqrt"),
        "OptimizedExtraTrees": ExtraTrees(200, max_depth=12, min_leaf=3, min_split=8, balanced=True,
                                          bootstrap=True),
        "OptimizedAdaBoost": AdaBoost(100, 0.5, 3),
    }
    if external:
        models["OptimizedXGBoost"] = depthwise_booster(200, 0.05, 8, 0.1, 0.1)
        models["OptimizedLightGBM"] = leafwise_booster(200, 0.05, 8, 63, 0.1, 0.1)
    return models


def clinical_ensemble_models(external: bool = False) -> dict[str, Model]:
    models: dict[str, Model] = {
        "ClinicalRandomForest": Forest(50, max_depth=8, min_leaf=10, balanced=True),
        "ClinicalGradientBoosting": Boosting(50, 0.05, 4, min_leaf=15, subsample=0.8),
        "ClinicalVotingClassifier": Voting({
            "lr": Logistic(balanced=True), "nb": NaiveBayes(alpha=0.1),
            "rf": Forest(30, max_depth=6, balanced=True)}),
        "ClinicalBagging": Bagging(30, 0.8, 0.8, Tree(max_depth=6, min_leaf=10, balanced=True)),
    }
    if external:
        models["ClinicalXGBoost"] = depthwise_booster(50, 0.05, 4, 0.1, 0.1)
    return models


def stacking_models() -> dict[str, Model]:
    def members() -> dict[str, Model]:
        return {"lr": Logistic(), "rf": Forest(50, max_depth=UNLIMITED),
                "svm": SupportVector("rbf"), "nb": NaiveBayes(), "gb": Boosting(50, 0.1, 3)}
    return {"StackingClassifier_LR": Stacking(members(), Logistic()),
            "StackingClassifier_RF": Stacking(members(), Forest(50, max_depth=UNLIMITED))}


def embedding_models(encoder_factory: Callable[[], object] | None = None) -> dict[str, Model]:
    new = encoder_factory or (lambda: None)
    return {
        "BERT-LR": EmbeddingClassifier("logistic_regression", encoder=new()),
        "BERT-SVM": EmbeddingClassifier("svm", encoder=new()),
        "BERT-Ensemble": EmbeddingClassifier("ensemble", encoder=new()),
        "BERT-Multilevel": MultilevelClassifier(encoder=new()),
    }


def all_models(external: bool = False) -> dict[str, Model]:
    return {**classical_models(), **ensemble_models(external), **embedding_models()}


class CustomModel(Model):
    """A user's Spark ML estimator (probability output) under the library's interface.

    ``make`` maps a Context to an unfitted Estimator on ``features`` / ``label``.
    """

    def __init__(self, make: Callable[[Context], object], input: str = "bow"):
        self.make, self.input = make, input

    def fit(self, train: DataFrame, ctx: Context) -> Fitted:
        from thresher.models.linear import FittedProbabilities
        from thresher.models.trees import indexed
        return FittedProbabilities(self.make(ctx).fit(indexed(train, ctx.classes)), ctx.classes)
