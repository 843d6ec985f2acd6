"""Linear and quadratic discriminant analysis from distributed second moments."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from thresher.models.base import Context, Fitted, Model, softmax

# Wider input is projected first: the d x d moments are solved on the driver.
MAX_WIDTH = 256


def class_moments(train: DataFrame, width: int):
    """Per class: row count, sum vector and sum of outer products.

    Each task sends one partial triangle per class; partial sums are merged by
    a shuffle on (class, i, j), so the driver only receives the final sums.
    """
    import numpy as np

    def partial(batches):
        import numpy as np
        import pandas as pd
        sums = {}
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                x = np.stack(part["vec"].to_numpy())
                x = np.hstack([np.ones((len(x), 1)), x])
                gram = x.T @ x
                sums[label] = sums[label] + gram if label in sums else gram
        for label, gram in sums.items():
            i, j = np.triu_indices(len(gram))
            yield pd.DataFrame({"label": int(label), "i": i.astype("int32"),
                                "j": j.astype("int32"), "v": gram[i, j]})

    rows = train.select(F.col("label").cast("int").alias("label"),
                        vector_to_array("features").alias("vec"))
    cells = (rows.mapInPandas(partial, "label int, i int, j int, v double")
             .groupBy("label", "i", "j").agg(F.sum("v").alias("v")).toPandas())
    out = {}
    for label, part in cells.groupby("label"):
        gram = np.zeros((width + 1, width + 1))
        gram[part["i"], part["j"]] = part["v"]
        gram = gram + np.triu(gram, 1).T
        out[int(label)] = (gram[0, 0], gram[0, 1:], gram[1:, 1:])
    return out


class Discriminant(Model):
    def __init__(self, quadratic: bool = False, ridge: float = 1e-6, max_width: int = MAX_WIDTH):
        self.quadratic, self.ridge, self.max_width = quadratic, ridge, max_width

    def fit(self, train: DataFrame, ctx: Context) -> "FittedDiscriminant":
        import numpy as np
        width, projection = ctx.n_features, None
        if width > self.max_width:
            projection = PCA(k=self.max_width, inputCol="features", outputCol="_pca").fit(train)
            train = _project(projection, train)
            width = self.max_width
        moments = class_moments(train, width)
        n = sum(m[0] for m in moments.values())
        means = {c: s / m for c, (m, s, _) in moments.items()}
        scatter = {c: g - m * np.outer(means[c], means[c]) for c, (m, _, g) in moments.items()}
        pooled = sum(scatter.values()) / max(1.0, n - ctx.k)
        constant, linear, quadratic = [], [], []
        for c in ctx.classes:
            m = moments[c][0]
            cov = scatter[c] / max(1.0, m - 1) if self.quadratic else pooled
            cov = cov + self.ridge * np.eye(width)
            inverse = np.linalg.inv(cov)
            const = np.log(m / n) - 0.5 * means[c] @ inverse @ means[c]
            if self.quadratic:
                const -= 0.5 * np.linalg.slogdet(cov)[1]
                quadratic.append(inverse)
            constant.append(const)
            linear.append(inverse @ means[c])
        return FittedDiscriminant(projection, ctx.classes, np.array(constant), np.array(linear),
                                  np.array(quadratic) if self.quadratic else None)


def _project(model, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("features").withColumnRenamed("_pca", "features")


class FittedDiscriminant(Fitted):
    def __init__(self, projection, classes, constant, linear, quadratic):
        self.projection, self.classes = projection, classes
        self.constant, self.linear, self.quadratic = constant, linear, quadratic

    def columns(self, df):
        import pandas as pd
        constant, linear, quadratic = self.constant, self.linear, self.quadratic

        def scores(s):
            import numpy as np
            import pandas as pd
            if not len(s):
                return pd.Series([], dtype="object")
            x = np.stack(s.to_numpy())
            out = x @ linear.T + constant
            if quadratic is not None:
                out = out - 0.5 * np.einsum("ni,cij,nj->nc", x, quadratic, x)
            return pd.Series(list(out))
        scores.__annotations__ = {"s": pd.Series, "return": pd.Series}
        source = "features"
        if self.projection is not None:
            df, source = self.projection.transform(df), "_pca"
        udf = F.pandas_udf(scores, "array<double>")
        scored = df.withColumn("_scores", udf(vector_to_array(source)))
        return scored, softmax(F.col("_scores")), None, None
