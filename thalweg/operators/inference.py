"""Multi-model inference on a wide table of models: fitness, per variable `v, v_weight, v_trans, v_shape`, and metrics.

Larger fitness is better. Order is fitness, largest first, then every column that tells rows apart, so that running sums
and cuts do not depend on how rows arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import aic as aic_of
from ..functions.scalars import bic as bic_of
from ..functions.scalars import selected_count

DERIVED = ("delta_aic_best", "akaike_weight", "acc_akaike_weight", "keep")
#: Fitness metrics by the names that users give: fixed values.
METRICS = {"loglik": "loglik", "r2m": "r2m", "aic": "aic", "delta": "delta_aic_null", "delta_aic_null": "delta_aic_null"}


def fitness_metric(name: str) -> str:
    if name not in METRICS:
        raise ValueError(f"unknown fitness metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


def by_fitness(df: DataFrame) -> list[Column]:
    ties = [c for c in ("loglik", "model_id") if c in df.columns]
    return [F.col("fitness").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]


def delta_aic(df: DataFrame) -> DataFrame:
    """aic above the least of the table."""
    least = df.agg(F.min("aic").alias("__least"))
    return df.crossJoin(F.broadcast(least)).withColumn("delta_aic_best", F.col("aic") - F.col("__least")).drop("__least")


def akaike_weights(df: DataFrame) -> DataFrame:
    """exp(-delta / 2), normalised over the table; the normaliser is one aggregate, joined back as a single row."""
    raw = df if "delta_aic_best" in df.columns else delta_aic(df)
    share = F.exp(-F.col("delta_aic_best") / 2)
    total = raw.agg(F.sum(share).alias("__total"))
    return raw.crossJoin(F.broadcast(total)).withColumn("akaike_weight", share / F.col("__total")).drop("__total")


def cumulative_keep(df: DataFrame, threshold: float = 0.95, max_models: int | None = None) -> DataFrame:
    """Running sum of weights in order of fitness, and keep: rows up to and including the first over the threshold.

    A threshold that is not within (0, 1) keeps all. A running sum needs one order over the table, so max_models, if
    given, first takes that many of the fittest (a top-k, not a sort).
    """
    table = top_models(df, max_models) if max_models else df
    rows = W.orderBy(*by_fitness(table)).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = table.withColumn("acc_akaike_weight", F.sum("akaike_weight").over(rows))
    if not 0 < threshold < 1:
        return summed.withColumn("keep", F.lit(True))
    before = F.lag("acc_akaike_weight").over(W.orderBy(*by_fitness(table)))
    return summed.withColumn("keep", F.coalesce(before, F.lit(0.0)) <= threshold)


def ranked(df: DataFrame, threshold: float = 0.95, max_models: int | None = None) -> DataFrame:
    """All derived columns."""
    return cumulative_keep(akaike_weights(delta_aic(df.drop(*DERIVED))), threshold, max_models)


def _kept(df: DataFrame, only_kept: bool) -> DataFrame:
    return df.where("keep") if only_kept and "keep" in df.columns else df


def _per_variable(df: DataFrame, variables: list[str]) -> DataFrame:
    """(variable, w, sel, weight), one row per model and variable."""
    items = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("sel"), F.col(f"{v}_weight").cast("double").alias("weight")) for v in variables])
    return df.select(F.col("akaike_weight").alias("w"), F.explode(items).alias("x")).select("w", "x.*")


def variable_importance(df: DataFrame, variables: list[str], only_kept: bool = True) -> DataFrame:
    """(variable, RVI): share of Akaike weight of the models that select it."""
    return _per_variable(_kept(df, only_kept), variables).groupBy("variable").agg((F.sum(F.col("sel") * F.col("w")) / F.sum("w")).alias("RVI"))


def averaged_weights(df: DataFrame, variables: list[str], natural: bool = False, only_kept: bool = True) -> DataFrame:
    """(variable, MAW): model-averaged weight over all models, or (natural) over those that select the variable."""
    rows = _per_variable(_kept(df, only_kept), variables)
    used = (F.col("sel") != 0) & F.col("weight").isNotNull()
    if natural:
        value = F.try_divide(F.sum(F.when(used, F.col("weight") * F.col("w"))), F.sum(F.when(used, F.col("w"))))
    else:
        value = F.sum(F.coalesce(F.col("weight"), F.lit(0.0)) * F.col("w")) / F.sum("w")
    return rows.groupBy("variable").agg(value.alias("MAW"))


def information_criteria(df: DataFrame, variables: list[str], n: int) -> DataFrame:
    """k = selected variables, with AIC and BIC from the log-likelihood."""
    k = selected_count(variables)
    return df.withColumn("k", k).withColumn("aic_k", aic_of(F.col("loglik"), F.col("k"))).withColumn("bic", bic_of(F.col("loglik"), F.col("k"), F.lit(float(n))))


def best_model(df: DataFrame, variables: list[str]) -> DataFrame:
    """(variable, weight, shape, transform) of the fittest model's selected variables."""
    top = df.orderBy(*by_fitness(df)).limit(1)
    items = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("long").alias("sel"), *[F.col(f"{v}_{s}").cast("double").alias(n) for s, n in (("weight", "weight"), ("shape", "shape"), ("trans", "transform"))]) for v in variables])
    return top.select(F.explode(items).alias("x")).select("x.*").where("sel = 1").drop("sel")


def top_models(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(*by_fitness(df)).limit(k)


def dedup_models(df: DataFrame) -> DataFrame:
    """One row for each (fitness, loglik), the first by model_id."""
    first = W.partitionBy("fitness", "loglik").orderBy(*[c for c in ("model_id",) if c in df.columns] or [F.lit(0)])
    return df.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def merge_top(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """The k fittest distinct models of both tables."""
    return top_models(dedup_models(old.unionByName(new, allowMissingColumns=True)), k)


def best_per_chain(trials: DataFrame, chain: str = "chain") -> DataFrame:
    """The trial of least loss of each chain, the earliest of equals."""
    first = W.partitionBy(chain).orderBy("loss", "tid")
    return trials.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def best_per_variable(fits: DataFrame) -> DataFrame:
    """(variable, transform, shape, fitness): the fittest curve of each variable; ties: least shape, then least transform."""
    top = F.max(F.struct("fitness", (-F.col("shape")).alias("s"), (-F.col("transform")).alias("t"), "shape", "transform")).alias("b")
    return fits.groupBy("variable").agg(top).select("variable", F.col("b.transform").alias("transform"), F.col("b.shape").alias("shape"), F.col("b.fitness").alias("fitness"))


def generation_log(trials: DataFrame, generation: str = "generation") -> DataFrame:
    """Worst, best, mean and population deviation of fitness per generation; mean and deviation are null where any fitness
    is infinite."""
    odd = F.bool_or(F.col("fitness").isin(float("inf"), float("-inf")))
    return trials.groupBy(generation).agg(
        F.min("fitness").alias("worst"), F.max("fitness").alias("best"), F.when(~odd, F.avg("fitness")).alias("mean"), F.when(~odd, F.stddev_pop("fitness")).alias("stdev")
    )


def loss_summary(trials: DataFrame, settings: list[str]) -> DataFrame:
    """Mean and deviation of the loss per setting, best first."""
    return trials.groupBy(*settings).agg(F.avg("loss").alias("mean_loss"), F.stddev_pop("loss").alias("sd_loss")).orderBy("mean_loss", *settings)


def ic_profile(df: DataFrame) -> DataFrame:
    """Data of the information-criterion profile: models numbered by aic, with weights rounded for display."""
    return df.select(F.row_number().over(W.orderBy("aic", "model_id")).cast("long").alias("model"), F.round("aic", 3).alias("aic"), F.round("akaike_weight", 3).alias("akaike_weight"))


def curve_heat_map(fits: DataFrame, transforms: list[int]) -> DataFrame:
    """Fitness by shape (rows) and transform (columns)."""
    return fits.groupBy("shape").pivot("transform", transforms).agg(F.max("fitness"))


def long_models(df: DataFrame, variables: list[str]) -> DataFrame:
    """Wide models as rows (model_id, var, sel, weight, transform, shape)."""
    items = F.array(
        *[
            F.struct(F.lit(v).alias("var"), F.coalesce(F.col(v), F.lit(0)).cast("int").alias("sel"), F.coalesce(F.col(f"{v}_weight"), F.lit(0.0)).cast("double").alias("weight"), F.coalesce(F.col(f"{v}_trans"), F.lit(0)).cast("int").alias("transform"), F.bround(F.coalesce(F.col(f"{v}_shape"), F.lit(0.0))).cast("double").alias("shape"))
            for v in variables
        ]
    )
    return df.select("model_id", F.explode(items).alias("x")).select("model_id", "x.*")


def wide_models(models: DataFrame, variables: list[str]) -> DataFrame:
    """The reverse: one row per model."""
    pick = lambda v, c: F.max(F.when(F.col("var") == v, F.col(c)))
    return models.groupBy("model_id").agg(*[pick(v, c).alias(v + s) for v in variables for c, s in (("sel", ""), ("weight", "_weight"), ("transform", "_trans"), ("shape", "_shape"))])
