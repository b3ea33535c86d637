"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Sanders' scheme for random permutations on distributed memory, in DataFrame operations only: (1) the number of rows that
each input partition sends to each shard is drawn from the multivariate hypergeometric law, down a tree of partitions,
so the matrix is drawn in parallel and its row and column sums are exact; (2) each partition
permutes its rows and deals them out by its row of the matrix; (3) rows are exchanged; (4) each shard permutes again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import tidy
from .common import durable, field, let, numbered, sweep, uniform

#: Children of a node of the tree of partitions.
FAN_OUT = 8


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked items among `drawn` of `total`, by inversion of the exact law at u.

    The support is cut 9 standard deviations (and 9) from the mean, beyond what the 53 bits of u can tell apart.
    """
    n, k, t = drawn.cast("double"), marked.cast("double"), F.greatest(total.cast("double"), F.lit(1.0))
    mean = n * k / t
    sd = F.sqrt(F.greatest(mean * (1 - k / t) * (t - n) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0)))
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), F.floor(mean - 9 * sd - 9))
    high = F.least(marked, drawn, F.ceil(mean + 9 * sd + 9))

    def inverted(span: Column) -> Column:
        def ratio(i: Column) -> Column:
            return (k - i) * (n - i) / ((i + 1) * F.greatest(t - k - n + i + 1, F.lit(1.0)))

        ks = F.sequence(span["low"], span["high"])
        weight = F.aggregate(
            ks, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), lambda a, i: F.struct((a["w"] * ratio(i)).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"]
        )
        return let(
            weight * u,
            lambda goal: F.aggregate(
                ks,
                F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), span["low"].alias("at")),
                lambda a, i: F.struct((a["w"] * ratio(i)).alias("w"), (a["sum"] + a["w"]).alias("sum"), F.when(a["sum"] + a["w"] <= goal, F.least(i + 1, span["high"])).otherwise(a["at"]).alias("at")),
                lambda a: a["at"],
            ),
        )

    return let(F.struct(low.alias("low"), F.greatest(low, high).alias("high")), inverted)


def _deal(node: Column, n_shards: int, seed: int, level: int) -> Column:
    """For a node (idx, caps, parts: the children's (child, n), not empty) the children with the rows that each shard gets
    from them: one hypergeometric draw after another over the shards, child by child; the last child gets what is left."""
    total = lambda caps: F.aggregate(caps, F.lit(0).cast("long"), lambda a, x: a + x)

    def take(caps: Column, part: Column) -> Column:
        start = F.struct(total(caps).alias("total"), part["n"].alias("want"), F.array().cast("array<bigint>").alias("out"))

        def step(a: Column, cap: Column) -> Column:
            k = hypergeometric(a["total"], cap, a["want"], uniform(seed, level, part["child"], F.size(a["out"])))
            return let(k, lambda k: F.struct((a["total"] - cap).alias("total"), (a["want"] - k).alias("want"), F.array_append(a["out"], k).alias("out")))

        return F.aggregate(caps, start, step, lambda a: a["out"])

    def child(a: Column, part: Column) -> Column:
        mine = F.when(F.size(a["done"]) == F.size(node["parts"]) - 1, a["caps"]).otherwise(take(a["caps"], part))
        return let(mine, lambda mine: F.struct(F.zip_with(a["caps"], mine, lambda c, m: c - m).alias("caps"), F.array_append(a["done"], F.struct(part["child"].alias("idx"), mine.alias("caps"))).alias("done")))

    empty = F.array().cast("array<struct<idx:bigint,caps:array<bigint>>>")
    return F.aggregate(node["parts"], F.struct(node["caps"].alias("caps"), empty.alias("done")), child, lambda a: a["done"])


@tidy
def communication_matrix(counts: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """counts: (pid, n) with pid from 0 -> (pid, sends): sends[s] rows of partition pid go to shard s.

    Row sums are n; column sums differ by at most one; among such matrices the draw follows the law that a uniformly
    random permutation of all rows has. Partitions without rows may be missing. No rows: no rows.

    Partitions are the leaves of a tree of FAN_OUT children a node. Counts are summed up the tree, level by level, as rows;
    then every node deals its rows of each shard out to its children, again level by level, all nodes of a level at once.
    """
    counts = durable(counts.where("n > 0").select(F.col("pid").cast("long").alias("pid"), "n"))
    top, whole = counts.agg(F.max("pid"), F.sum("n")).first()
    if top is None:
        return counts.sparkSession.createDataFrame([], "pid long, sends array<bigint>")
    levels = 0
    while FAN_OUT**levels <= top:
        levels += 1
    caps = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.lit(whole // n_shards).cast("long") + (s < whole % n_shards).cast("long"))
    nodes = counts.sparkSession.range(1).select(F.col("id").alias("idx"), caps.alias("caps"))
    for level in range(levels):
        width = FAN_OUT ** (levels - level - 1)
        child = F.expr(f"pid div {width}L")
        sums = counts.groupBy(child.alias("child")).agg(F.sum("n").alias("n"))
        parts = sums.groupBy(F.expr(f"child div {FAN_OUT}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("parts"))
        dealt = nodes.join(parts, "idx").repartition("idx").select(F.explode(_deal(F.struct("idx", "caps", "parts"), n_shards, seed, level)).alias("x"))
        nodes = durable(dealt.select("x.*"), keep=level == levels - 1)
    return nodes.select(F.col("idx").alias("pid"), F.col("caps").alias("sends"))


def assign_shards(rows: DataFrame, n_shards: int, seed: int = 0, bucket_rows: int = 8192) -> DataFrame:
    """rows: (rid) as numbered() stores them -> (rid, shard, slot), slots gapless from 0.

    The upper bits of rid are the input partition. Permuting a shard is done in buckets of about bucket_rows rows (the
    leading part of the sort key is the bucket), so no task ever holds a shard.
    """
    placed = rows.select("rid", F.shiftright("rid", 33).alias("pid"))
    counts = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    matrix = durable(communication_matrix(counts, n_shards, seed))
    n_buckets = max(1, math.ceil((counts.agg(F.sum("n")).first()[0] or 0) / n_shards / bucket_rows))
    local = placed.withColumn("rank", F.row_number().over(W.partitionBy("pid").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "rid"), "rid")) - 1)
    ends = matrix.select("pid", F.aggregate("sends", F.array().cast("array<bigint>"), lambda a, x: F.array_append(a, x + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))).alias("ends"))
    dealt = local.join(ends, "pid").select("rid", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"), F.xxhash64(F.lit(seed), F.lit("shard"), "rid").alias("key"))
    dealt = dealt.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 32), F.lit(n_buckets)))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset"))
    slot = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("key", "rid")) - 1 + F.col("offset")
    return dealt.join(offsets, ["shard", "bucket"]).select("rid", "shard", slot.cast("long").alias("slot"))


def shuffle_into_shards(df: DataFrame, n_shards: int = 40, seed: int = 0) -> DataFrame:
    """All rows and columns of df plus shard INT and slot BIGINT (gapless from 0): a uniform shuffle, exact sizes.

    Columns of df named shard or slot, in any case, are replaced. Nulls and repeated rows are rows like any other; an empty
    table stays empty. Shard sizes differ by at most one row. Rows are numbered and stored once, with their payload, which
    is then shuffled once, joined by row number.
    """
    stored = numbered(df, "shard-rows")
    sweep(df.sparkSession)
    where = durable(assign_shards(stored.select("rid"), n_shards, seed))
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    return stored.join(where, "rid").select(*[field("row", c).alias(c) for c in names], "shard", "slot")
