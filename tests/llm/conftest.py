import uuid

import pytest

# columns that clash with names the operators use inside, and with those they return
EXTRA = "slot long, size long, target double, taken long, _row long, tree long, leaf long, n_shingles long, score double, held_out boolean, name string, host string, rank int"


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Store rows as a parquet table of several files and read it back, with extra columns on demand."""
    top = tmp_path_factory.mktemp("llm")

    def make(rows, schema, extra=False, files=3):
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(7).cast(kind).alias(name) for name, kind in (c.rsplit(" ", 1) for c in EXTRA.split(", ")) if kind != "boolean"])
        path = str(top / uuid.uuid4().hex)
        df.repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make
