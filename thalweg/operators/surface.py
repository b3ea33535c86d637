"""Predictors, resistance surfaces of many models at once, and effective resistances between points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggregators import aggregate
from ..functions.transforms import rescale, rescale_columns, transform
from .cleaning import nan_to_null, scrub_bad_columns
from .graph import stored


def edge_covariates(reaches: DataFrame, methods: dict[str, str], order: str | None = None) -> DataFrame:
    """(edge_id, covariates...) -> one row per edge, each covariate by its own aggregator."""
    by = F.col(order) if order else None
    return nan_to_null(reaches).groupBy("edge_id").agg(*[aggregate(m, v, by).cast("double").alias(v) for v, m in methods.items()])


def predictors(reaches: DataFrame, methods: dict[str, str], order: str | None = None, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """Covariates per edge, useless ones dropped, each rescaled to [low, high] over all edges.

    The table of edges is stored once: which columns vary, and their ranges, are asked of it and not of the reaches.
    """
    wide = scrub_bad_columns(stored(edge_covariates(reaches, methods, order)), list(methods))
    return rescale_columns(wide, [v for v in methods if v in wide.columns], low, high)


def long_predictors(wide: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """(edge_id, var, value)."""
    names = variables or [c for c in wide.columns if c != "edge_id"]
    return wide.unpivot("edge_id", names, "var", "value")


def transformed(long: DataFrame, curves: DataFrame, final: bool = True) -> DataFrame:
    """curves: distinct (var, transform, shape) -> (var, transform, shape, edge_id, value), each curve in [0, 1] over edges.

    A curve is computed once however many models share it. A constant curve is null.
    """
    bounds = long.groupBy("var").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    raw = long.join(bounds, "var").join(curves, "var")
    raw = raw.select("var", "transform", "shape", "edge_id", transform(F.col("value"), F.col("low"), F.col("high"), F.col("transform"), F.col("shape")).alias("value"))
    if not final:
        return raw
    over = W.partitionBy("var", "transform", "shape")
    return raw.withColumn("value", rescale(F.col("value"), F.min("value").over(over), F.max("value").over(over)))


def surfaces(models: DataFrame, long: DataFrame, final: bool = True, by_model: bool = False) -> DataFrame:
    """models: (model_id, var, sel, weight, transform, shape) -> (model_id, edge_id, resistance).

    The weighted sum of the selected variables' curves, in [0, 1] per model if final. Models that select nothing have no
    rows. by_model deals rows out by model before they are summed: with many models, all that follows (rescaling, path
    sums, likelihood) then goes without another exchange.
    """
    chosen = models.where("sel = 1").select("model_id", "var", "weight", "transform", F.col("shape").cast("double").alias("shape"))
    curves = transformed(long, chosen.select("var", "transform", "shape").distinct())
    parts = chosen.join(curves, ["var", "transform", "shape"])
    summed = (parts.repartition("model_id") if by_model else parts).groupBy("model_id", "edge_id").agg(F.sum(F.col("weight") * F.col("value")).alias("resistance"))
    if not final:
        return summed
    over = W.partitionBy("model_id")
    return summed.withColumn("resistance", rescale(F.col("resistance"), F.min("resistance").over(over), F.max("resistance").over(over)))


def effective_resistance(surface: DataFrame, incidence: DataFrame) -> DataFrame:
    """(model_id, edge_id, resistance) x (i, j, edge_id) -> (model_id, i, j, resistance): sums along paths."""
    return incidence.join(surface, "edge_id").groupBy("model_id", "i", "j").agg(F.sum("resistance").alias("resistance"))


def symmetric(values: DataFrame, points: DataFrame, column: str = "resistance") -> DataFrame:
    """(i, j, value) of the lower triangle -> the whole matrix with a zero diagonal."""
    lower = values.select("i", "j", F.col(column).alias("value"))
    zero = points.select(F.col("pt_idx").cast("long").alias("i"), F.col("pt_idx").cast("long").alias("j"), F.lit(0.0).alias("value"))
    return lower.unionByName(lower.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).unionByName(zero)


def averaged(values: DataFrame, weights: DataFrame, keys: list[str], column: str = "resistance") -> DataFrame:
    """Sum of weight x value over models; weights are used as they are, not renormalised."""
    return values.join(weights.select("model_id", F.col("akaike_weight").alias("__w")), "model_id").groupBy(*keys).agg(F.sum(F.col("__w") * F.col(column)).alias(column))
