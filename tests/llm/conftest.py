import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame from rows and a schema, with extra columns whose names clash with internal ones."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F

        for c in ("k", "rep", "n", "step", "root", "block", "start", "word", "ids", "a", "b", "size", "source_tokens", "_u", "low"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make
