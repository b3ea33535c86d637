import pytest


@pytest.fixture()
def frame(spark, tmp_path):
    """Stores rows as a table, as the operators number rows of stored tables."""

    def make(rows, schema, partitions=3):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}.parquet")
        spark.createDataFrame(rows, schema).repartition(partitions).write.parquet(path)
        return spark.read.parquet(path)

    make.path = tmp_path
    return make


@pytest.fixture()
def restless(spark, monkeypatch):
    """Executors that come and go: the parallelism that splits of files follow changes before and after every checkpoint."""
    seen = []

    def turn():
        seen.append(1)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 2 if len(seen) % 2 else 16)

    kind = type(spark.range(1))
    checkpoint = kind.checkpoint

    def changed(self, *args, **options):
        turn()
        try:
            return checkpoint(self, *args, **options)
        finally:
            turn() if len(seen) % 3 else None

    monkeypatch.setattr(kind, "checkpoint", changed)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield seen
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.openCostInBytes")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(texts, lang="en", source="s"):
    return [(k, t, lang, source, len(t or "")) for k, t in enumerate(texts)]
