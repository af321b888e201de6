import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """rows(schema, tuples) -> DataFrame over a few partitions."""
    def make(schema, data, parts=3):
        return spark.createDataFrame(data, schema).repartition(parts)
    return make
