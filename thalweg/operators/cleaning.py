"""Column pruning, null handling and sign conventions of model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Suffixes of a variable's columns in a wide model table: fixed values.
SUFFIXES = ("_weight", "_trans", "_shape")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN sorts above all numbers in Spark and would win every max; null is skipped."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def _useless(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without a value, or with a single one: one aggregate over all columns."""
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    return [c for i, c in enumerate(columns) if row[f"n_{i}"] == 0 or row[f"low_{i}"] == row[f"high_{i}"]]


def scrub_bad_columns(df: DataFrame, variables: list[str]) -> DataFrame:
    """Drops variables that are all null or constant; names that df lacks are ignored."""
    if df.isEmpty():
        raise ValueError("the table is empty")
    present = [v for v in variables if v in df.columns]
    if not present:
        raise ValueError("none of the variables is a column")
    bad = _useless(nan_to_null(df), present)
    if len(bad) == len(present):
        raise ValueError("no variable is left: all are empty or constant")
    return df.drop(*bad)


def columns_vary(df: DataFrame) -> bool:
    """Whether every column has a value and more than one distinct."""
    return not df.isEmpty() and not _useless(nan_to_null(df), df.columns)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if row[c]])


def variables_of(df: DataFrame) -> list[str]:
    """Variable names of a wide model table, by its suffixed columns, sorted."""
    stems = {c[: -len(s)] for c in df.columns for s in SUFFIXES if c.endswith(s)}
    return sorted(stems - {"akaike", "acc_akaike"})


def mask_unselected(df: DataFrame, variables: list[str]) -> DataFrame:
    """Null weight, transform and shape where a variable is not selected; fitness back to its positive sign where the
    first model (the fittest) has fitness = -aic."""
    masked = df.withColumns({v + s: F.when(F.col(v) == 0, None).otherwise(F.col(v + s)) for v in variables for s in SUFFIXES if v + s in df.columns})
    if not {"fitness", "aic"} <= set(df.columns):
        return masked
    flip = df.agg(F.max_by(F.col("fitness") == -F.col("aic"), F.struct("fitness", "aic")).alias("__flip"))
    return masked.crossJoin(F.broadcast(flip)).withColumn("fitness", F.when(F.col("__flip"), -F.col("fitness")).otherwise(F.col("fitness"))).drop("__flip")


def numeric(df: DataFrame, keep: tuple[str, ...] = ("keep",)) -> DataFrame:
    """Text columns of a model file as numbers: `-` is 0, what is no number is null."""
    return df.withColumns({c: F.when(F.col(c) == "-", 0.0).otherwise(F.expr(f"try_cast(`{c}` AS double)")) for c, t in df.dtypes if t == "string" and c not in keep})


def normalise_sign(df: DataFrame) -> DataFrame:
    """Fitness turned so that larger is better where all of it equals aic."""
    same = df.agg(F.bool_and(F.col("fitness") == F.col("aic")).alias("__same"))
    return df.crossJoin(F.broadcast(same)).withColumn("fitness", F.when(F.col("__same"), -F.col("fitness")).otherwise(F.col("fitness"))).drop("__same")


def finite_fitness(df: DataFrame) -> DataFrame:
    return df.where((F.col("fitness") > float("-inf")) & ~F.isnan("fitness"))


def better_than(df: DataFrame, fitness: float) -> DataFrame:
    return df.where(F.col("fitness") > fitness)


def in_both(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each table whose key the other has too."""
    return left.join(right.select(key), key, "left_semi"), right.join(left.select(key), key, "left_semi")
