"""Steps after extraction: cleaning, scaling, similarity search and clustering of feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.numeric import div


def _features(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def nan_to_null(df: DataFrame, keys: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if kinds[c] == "double" and c not in keys else F.col(f"`{c}`") for c in df.columns))


def drop_null_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Without the feature columns that hold a null; one aggregation counts them all."""
    features = _features(df, keys)
    if not features:
        return df
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(features))).first()
    return df.select(*(F.col(f"`{c}`") for c in keys), *(F.col(f"`{c}`") for k, c in enumerate(features) if counts[f"c{k}"] == counts["n"]))


def zscore(df: DataFrame, keys: list[str]) -> DataFrame:
    """Feature columns minus their mean, by their deviation; null where that is 0."""
    features = _features(df, keys)
    stats = df.agg(*(F.avg(F.col(f"`{c}`")).alias(f"__m{k}") for k, c in enumerate(features)), *(F.stddev_samp(F.col(f"`{c}`")).alias(f"__s{k}") for k, c in enumerate(features)))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*(F.col(f"`{c}`") for c in keys), *(div(F.col(f"`{c}`") - F.col(f"__m{k}"), F.col(f"__s{k}")).alias(c) for k, c in enumerate(features)))


def cosine_top_k(df: DataFrame, columns: list[str], query: dict[str, float], k: int, ties: list[str]) -> DataFrame:
    """The k rows most like ``query`` (a value per column), with their ``similarity``; ties by the columns of ``ties``."""
    terms = [(F.col(f"`{c}`"), float(query[c])) for c in columns]

    def total(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    size = sum(q * q for _, q in terms) ** 0.5
    similarity = div(total([c * q for c, q in terms]), F.sqrt(total([c * c for c, _ in terms])) * size)
    return df.withColumn("similarity", similarity).where("similarity is not null").orderBy(F.desc("similarity"), *ties).limit(k)


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """``df`` with each row's ``cluster``; rows with a null or NaN in ``columns`` fall out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    plain = df.select("*", *(F.col(f"`{c}`").alias(f"__f{i}") for i, c in enumerate(columns)))
    made = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(columns))], outputCol="__features", handleInvalid="skip").transform(plain)
    made = made.where(~F.exists(F.array(*(F.col(f"__f{i}") for i in range(len(columns)))), F.isnan))
    model = KMeans(featuresCol="__features", predictionCol="cluster", k=k, seed=seed).fit(made)
    return model.transform(made).drop("__features", *(f"__f{i}" for i in range(len(columns))))
