import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables as Parquet and gives the folder that a query takes."""

    def write(**frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
