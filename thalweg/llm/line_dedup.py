"""Line deduplication over a corpus: explode, hash, count distinct documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WHITESPACE, durable


def line_key(line: Column) -> Column:
    """A line without surrounding white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITESPACE)), UPPER, UPPER.lower())


def _hashes(value: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits as two independent 64-bit hashes: at 10^12 lines 64 bits alone would collide."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """Removes lines that occur in many documents, but for the one in the document of largest id.

    Returns one row per input row: doc_id, n_lines, n_dropped, kept (the text that stays).
    A line's key is line_key(); keys of at least min_length code points held by at least min_docs distinct ids lose all
    their lines except in the largest id that holds them.
    Null or empty text: one empty line. A null id counts as one document, smaller than all others.
    Repeated rows: all rows of one id are one document to the counts; each row comes back. Empty table: no rows.

    A line that a third of all documents hold is pre-aggregated before it is counted (distinct ids, then a partial count);
    joining the verdicts back shuffles only hashes and positions, and both sides of that join are plain exchanges, so
    adaptive execution splits the hot key. Texts are shuffled once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    own = [F.col(id_col).alias("id"), *_hashes(text, ("t1", "t2"))]
    keyed = docs.select(*own, F.posexplode(lines).alias("pos", "line")).select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
    keyed = durable(keyed.where(F.length("key") >= min_length).select("id", "t1", "t2", "pos", *_hashes(F.col("key"), ("k1", "k2"))))
    held = keyed.select("k1", "k2", "id").distinct()
    common = durable(held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n"))
    losing = keyed.join(common, ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    losing = losing.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("gone")).select(F.col("id").alias("gid"), F.col("t1").alias("g1"), F.col("t2").alias("g2"), "gone")
    whole = docs.select(*own, lines.alias("lines"))
    on = (whole["t1"] == losing["g1"]) & (whole["t2"] == losing["g2"]) & whole["id"].eqNullSafe(losing["gid"])
    joined = whole.join(losing.hint("shuffle_hash"), on, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
