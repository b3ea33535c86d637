"""Tables that operators write on the way, in the folder that driver and executors share, and who deletes them.

Whatever an operator stores belongs to the run it is part of: scratch() opens one, and deletes at its end what was stored
within, also after an error. Runs are kept in a context variable, so operators that work at the same time in several
threads own their tables each. What a lazy result still reads is stored with keep=True: it belongs to the run outside, or,
where there is none, stays in the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_RUNS: ContextVar[tuple[list[str], ...]] = ContextVar("thalweg_runs", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and the executors live in the driver's process (tests), a temporary folder; on a cluster that would
    be another folder on every machine, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='thalweg-')}")
    return sc.getCheckpointDir()


def _own(path: str, keep: bool) -> None:
    runs = _RUNS.get()
    owner = runs[:-1] if keep else runs
    if owner:
        owner[-1].append(path)


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _own(path, keep)
    return path


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def scratch(spark: SparkSession):
    """A run: what is stored within, by this thread, is deleted at its end."""
    mine: list[str] = []
    token = _RUNS.set((*_RUNS.get(), mine))
    try:
        yield
    finally:
        _RUNS.reset(token)
        for path in mine:
            delete(spark, path)


def tidy(operator):
    """For an operator (df, ...) that keeps what its result reads: the rest of what it stored is deleted."""

    @wraps(operator)
    def run(df: DataFrame, *args, **options):
        with scratch(df.sparkSession):
            return operator(df, *args, **options)

    return run


def stored(df: DataFrame, name: str = "stored", keep: bool = False) -> DataFrame:
    """Written as Parquet and read: for what goes round in a loop. A checkpoint keeps the planner's estimate of its size, and
    joins multiply estimates from round to round until they fill the driver; a table has its true size."""
    path = fresh_path(df.sparkSession, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str = "stored", keep: bool = False, **seen: Column) -> tuple[DataFrame, dict]:
    """stored() with aggregates of the rows, had from the same job: whether a loop goes on takes no job of its own.

    A stage that runs again after a lost executor may count rows twice: ask for extremes and whether there are any.
    """
    watch = Observation()
    out = stored(df.observe(watch, *[c.alias(n) for n, c in seen.items()]), name, keep)
    return out, watch.get


def numbered(df: DataFrame, name: str = "rows", keep: bool = False) -> DataFrame:
    """(rid LONG, row STRUCT): the rows of df, numbered and stored.

    Numbers depend on how the input is split, and a second scan may be split otherwise, as executors come and go; so number
    and row are written once, together, and everything after reads that table. The upper bits of rid are the partition.
    """
    return stored(df.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[f"`{c}`" for c in df.columns]).alias("row")), name, keep)


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, so that lost executors cost a read, not a recomputation."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    _own(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get(), keep)
    return out
