import pytest


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables (name -> rows, schema) as Parquet and gives their folder."""

    def build(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return build
