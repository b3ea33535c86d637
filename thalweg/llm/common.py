"""Helpers shared by the corpus operators: word patterns, shared storage for intermediate results, hash-based draws."""

from __future__ import annotations

import gc
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from ..storage import delete, durable, fresh_path, numbered, scratch, shared_folder, stored

__all__ = ["delete", "durable", "fresh_path", "numbered", "scratch", "shared_folder", "stored"]

#: The white space of every contract here: space and the five ASCII controls TAB..CR.
WHITESPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage now: Spark deletes the shuffle files of a phase when nothing in the driver refers to
    them any more, which it otherwise notices whenever its heap happens to fill up. Stored tables do not depend on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(operator):
    """For an operator (docs, ...) that keeps what its result reads: deletes the rest of what it stored on the way."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options):
        with scratch(docs.sparkSession):
            out = operator(docs, *args, **options)
        sweep(docs.sparkSession)
        return out

    return run


def uniform(*parts) -> Column:
    """A double in [0, 1) that depends only on the given values: reruns and retried tasks draw the same."""
    return F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11) * F.lit(2.0**-53)


def let(value: Column, body) -> Column:
    """body(value), evaluating value once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: str | Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def field(row: str, column: str) -> Column:
    """A field of a struct, whatever characters its name holds."""
    return F.col(f"{row}.`{column}`")


def map_texts(docs: DataFrame, text: str | Column, carried: dict[str, Column], fields: dict[str, str], start) -> DataFrame:
    """(carried columns, fields): what Python finds in each text, beside columns that it never sees.

    start() is called once in each task and returns a function from a list of texts (null: empty; or of the values of a
    column, as they are) to one list, or Arrow array, for each of `fields` (name -> SQL type). Carried columns pass as Arrow arrays, so that no id or nullable number is turned into a
    float. Spark bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch); no session setting is changed.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text), F.lit("")) if isinstance(text, str) else text
    frame = docs.select(text.alias("text"), F.struct(*[c.alias(n) for n, c in (carried or {"none": F.lit(True)}).items()]).alias("row"))
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
    types = [f.type for f in to_arrow_schema(added)]
    kept = frame.schema["row"]

    def run(batches):
        work = start()
        for batch in batches:
            found = work(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(found, types, strict=True))], ["row", *fields])

    out = frame.mapInArrow(run, T.StructType([kept, *added.fields]))
    return out.select(*[field("row", n).alias(n) for n in carried], *[f"`{n}`" for n in fields])
