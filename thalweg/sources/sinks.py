"""Sinks: tab-separated tables and matrices, one file where the consumer expects one, and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, header: bool = True, null: str = "", single: bool = True) -> None:
    """One part file if single: for results whose size is that of a report. Lists are comma-joined."""
    flat = df.withColumns({c: F.concat_ws(",", c) for c, t in df.dtypes if t.startswith("array")})
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("sep", "\t").option("header", header).option("nullValue", null).csv(path)


def edge_resistances(df: DataFrame) -> DataFrame:
    """EDGE_ID with Resistance, or with Resistance_Downstream and Resistance_Upstream."""
    for columns in (["resistance"], ["downstream", "upstream"]):
        if set(columns) <= set(df.columns):
            names = ["Resistance"] if len(columns) == 1 else ["Resistance_Downstream", "Resistance_Upstream"]
            return df.select(F.col("edge_id").alias("EDGE_ID"), *[F.col(c).alias(n) for c, n in zip(columns, names)]).orderBy("EDGE_ID")
    raise ValueError("edges need a resistance, or one for each direction")


def matrix(df: DataFrame, labels: list[str], row: str = "i", col: str = "j", value: str = "value", fill: float | None = None) -> DataFrame:
    """(row, col, value) -> one row per label with a column per label; labels are given, so pivoting needs no extra scan."""
    wide = df.groupBy(row).pivot(col, list(range(len(labels)))).agg(F.first(value))
    wide = wide.select(row, *[F.coalesce(F.col(f"`{k}`"), F.lit(fill)).alias(n) for k, n in enumerate(labels)])
    names = F.array(*[F.lit(n) for n in labels])
    return wide.orderBy(row).select(F.get(names, F.col(row).cast("int")).alias("label"), *[f"`{n}`" for n in labels])


def incidence_matrix(incidence: DataFrame, edges: list[int]) -> DataFrame:
    """0/1 by pair (in order of the lower triangle) and edge."""
    wide = incidence.withColumn("one", F.lit(1)).groupBy("i", "j").pivot("edge_id", edges).agg(F.max("one")).fillna(0)
    return wide.orderBy("i", "j").drop("i", "j")


def adjacency_matrix(adjacency: DataFrame, edges: list[int]) -> DataFrame:
    return adjacency.groupBy("edge_i").pivot("edge_j", edges).agg(F.max("dir")).fillna(0).orderBy("edge_i")


def used_reaches(network: DataFrame, used: DataFrame, key: str = "edge_id") -> DataFrame:
    """The part of the layer that the analysis used."""
    return network.join(used.select(key), key, "left_semi")


def geojson(lines: DataFrame) -> DataFrame:
    """One GeoJSON feature a row, of lines with x1, y1, x2, y2."""
    point = lambda a, b: F.array(F.col(a), F.col(b))
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(point("x1", "y1"), point("x2", "y2")).alias("coordinates"))
    properties = F.struct(*[c for c in lines.columns if c not in ("x1", "y1", "x2", "y2")])
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def write_models(df: DataFrame, path: str) -> None:
    """A model table as text: missing parameters are `-`, keep is True or False."""
    text = df.withColumn("keep", F.initcap(F.col("keep").cast("string"))) if "keep" in df.columns else df
    write_tsv(text, path, null="-")


def write_by_model(df: DataFrame, path: str) -> None:
    """Outputs of many models, a folder each."""
    df.write.mode("overwrite").partitionBy("model_id").parquet(path)
