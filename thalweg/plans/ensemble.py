"""Ensembles: model tables of several runs, ranked together and averaged over one network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cleaning, inference
from ..operators.surface import averaged, effective_resistance, surfaces
from ..operators.tree import TreePaths
from ..sources.tables import read_many
from ..storage import stored


def combine(models: DataFrame, only_keep: bool = False, max_keep: int | None = None, threshold: float = 0.95) -> DataFrame:
    """Signs normalised, optionally only kept models or the fittest max_keep; ranked anew."""
    df = cleaning.normalise_sign(cleaning.finite_fitness(models))
    if only_keep and "keep" in df.columns:
        df = df.where(F.col("keep").cast("string").isin("True", "true"))
    df = inference.dedup_models(df.drop(*inference.DERIVED))
    return inference.ranked(inference.top_models(df, max_keep) if max_keep else df, threshold)


def read_runs(spark: SparkSession, prefix: str, only_best: bool = False) -> DataFrame:
    """All `.HallOfFame.tsv` files of a prefix, numbers where `-` stood, numbered as models. Stored aic is negated back."""
    raw = cleaning.numeric(read_many(spark, prefix, ".HallOfFame.tsv", head=1 if only_best else None))
    order = W.orderBy(F.col("fitness").desc_nulls_last(), *[c for c in raw.columns if c != "fitness"])
    return raw.withColumn("model_id", F.row_number().over(order).cast("long"))


def distinct_coordinates(points: DataFrame) -> DataFrame:
    """The first sample by name of each coordinate."""
    once = W.partitionBy("lat", "long").orderBy("sample")
    return points.withColumn("__r", F.row_number().over(once)).where("__r = 1").drop("__r")


def model_average(ranked: DataFrame, variables: list[str], predictors: DataFrame, paths: DataFrame | TreePaths) -> tuple[DataFrame, DataFrame]:
    """Akaike-weighted edge and pair resistances over kept models; weights are not renormalised over those.

    Resistances along paths are sums over edges, so those of the averaged edges are the averages over models.
    """
    kept = ranked.where("keep")
    edges = stored(averaged(surfaces(inference.long_models(kept, variables), predictors), kept, ["edge_id"]), "averaged-edges")
    if isinstance(paths, TreePaths):
        return edges, paths.path_sums(edges, [])
    return edges, effective_resistance(edges.withColumn("model_id", F.lit(0)), paths).drop("model_id")
