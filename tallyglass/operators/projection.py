"""Two-dimensional view of corpus and query vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def project_2d(corpus: DataFrame, queries: DataFrame, digits: int = 4) -> DataFrame:
    """Principal components fitted on the corpus, applied to corpus and queries.

    Returns ``kind, id, x, y`` and the explained variance of both axes. The fit is a distributed
    covariance of dims x dims; vectors are centred first because the model does not centre when it
    transforms. The sign of an axis is arbitrary.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def side(df, kind, key):
        return df.where("embedding is not null").select(
            F.lit(kind).alias("kind"),
            F.col(key).cast("string").alias("id"),
            array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"),
        )

    base = side(corpus, "chunk", "chunk_id")
    stages = [
        StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False),
        PCA(k=2, inputCol="centred", outputCol="xy"),
    ]
    model = Pipeline(stages=stages).fit(base)
    ratio = model.stages[-1].explainedVariance
    both = model.transform(base.unionByName(side(queries, "query", "query_id")))
    xy = vector_to_array("xy")
    return both.select(
        "kind",
        "id",
        F.round(xy[0], digits).alias("x"),
        F.round(xy[1], digits).alias("y"),
        F.lit(round(float(ratio[0]), digits)).alias("variance_x"),
        F.lit(round(float(ratio[1]), digits)).alias("variance_y"),
    )
